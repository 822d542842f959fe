"""Personal data with offset-preserving deobfuscation.

Plain detectors find e-mail addresses, IPv4 addresses, card and phone numbers.
For disguised ones, small transducers rewrite the text - homoglyphs and wide
forms to ASCII, runs of spelled digits to digits, ``[at]`` / ``(dot)`` / `` at
... dot `` to ``@`` and ``.`` - and keep, for every character they write, the
source interval it came from.  The same detectors run on the rewritten text;
spans that touch a rewritten character are mapped back to source offsets and
added where they don't overlap a plain span.

Edge cases: a null text is empty and has no spans; ties between kinds are
listed in the order of KINDS; repeated rows are scanned each; empty tables give
no rows; other columns of the input are ignored.  Patterns, edits and the
comparison of spans are linear in the text (a sort of the spans aside), however
long its runs of letters, digits or spelled digits are.

A spoken "at" is an @ before a host whose dots are disguised, or before a plain
host if the word on its left looks like a mailbox (a dot, digit or underscore
in it) or a contact word stands shortly before and that word is no pronoun.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import merge_spans, slices, table

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")  # a run of digits that fails at its first digit fails at all
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){15,}")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

# fixed values: characters that look like ASCII ones
HOMOGLYPHS = str.maketrans(
    "авеёіјкмнорсстухѕԁԛԝАВЕІЈКМНОРСТУХЅαβεικνορτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ․。∙＠﹫‐‑‒–−",
    "abeeijkmhopcctyxsdqwABEIJKMHOPCTYXSabeiknoptuxABEZHIKMNOPTYX...@@-----",
) | {0xFF01 + i: chr(0x21 + i) for i in range(94)} | {0x0660 + i: str(i) for i in range(10)} | {0x06F0 + i: str(i) for i in range(10)} | {0x0966 + i: str(i) for i in range(10)}
INVISIBLE = {0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0x00AD}
LOOKALIKE = re.compile("[" + "".join(re.escape(chr(c)) for c in sorted({*HOMOGLYPHS, *INVISIBLE})) + "]")

# fixed values: names of the digits
NAMES = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_NAME = "|".join(sorted(NAMES, key=len, reverse=True))
_POINT = r"\s{1,3}(?:dot|point|punkt|punto)\s{1,3}"
SPELLED = re.compile(rf"(?i)\b(?:plus\b[\s,.-]{{1,3}})?(?:{_NAME})\b(?:(?:[\s,.-]{{1,3}}|{_POINT})(?:{_NAME})\b){{3,}}")
POINT = re.compile(rf"(?i){_POINT}")
ONE_NAME = re.compile(rf"(?i)\b(?:{_NAME}|plus)\b")
BRACKET = re.compile(r"(?i)\s{0,3}[\[({<]\s{0,2}(at|dot|@|\.)\s{0,2}[\])}>]\s{0,3}")
_HOST = r"[a-z0-9-]{1,63}(?:(?:\s{1,3}dot\s{1,3}|\.)[a-z0-9-]{1,63}){1,6}\b"
WORDY = re.compile(rf"(?i)(?<=[a-z0-9])\s{{1,3}}(at)\s{{1,3}}(?={_HOST})|(?<=[a-z0-9])\s{{1,3}}(dot)\s{{1,3}}(?=[a-z])")
HOST, DOT = re.compile(rf"(?i){_HOST}"), re.compile(r"(?i)\sdot\s")
MAILBOX, LEFT_WORD = re.compile(r"[0-9._]"), re.compile(r"[A-Za-z0-9._%+-]{1,64}\Z")
# fixed values: words that announce an address, and words that are no mailbox behind them
CONTACT = re.compile(r"(?i)\b(?:e-?mail|mail|contact|reach|write|kontakt|schreiben|correo|contacto|courriel|adresse|address)\b")
PRONOUNS = frozenset(("us", "me", "him", "her", "them", "it", "you", "uns", "mich", "ihn", "sie", "nous", "moi", "nos", "out", "in", "him", "page", "site", "here"))
#: for a quick look whether a transducer can apply at all
BREAKS = bytes(c if 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
SPOKEN = frozenset(x.encode().translate(BREAKS) for n in NAMES for x in (n, n.upper()))


def luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else (int(d) * 2 - 9 if d > "4" else int(d) * 2) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def plain_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start; leftmost non-overlapping per kind."""
    out = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    if DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in (y.lstrip("0")[:4] or "0" for y in m[0].split(".")))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


class Rewritten:
    """A text with, for each character, the source interval [start, end) and whether a transducer wrote it."""

    def __init__(self, text: str):
        self.text, self.start, self.end, self.new = text, array("i", range(len(text))), array("i", range(1, len(text) + 1)), bytearray(len(text))

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """Edits are disjoint, ordered (start, end, replacement); each written character stands for the whole interval."""
        text, start, end, new, at = [], array("i"), array("i"), bytearray(), 0
        for s, e, put in edits:
            text += [self.text[at:s], put]
            start += self.start[at:s] + self.start[s : s + 1] * len(put)
            end += self.end[at:s] + self.end[e - 1 : e] * len(put)
            new += self.new[at:s] + b"\x01" * len(put)
            at = e
        self.text, self.start, self.end, self.new = "".join([*text, self.text[at:]]), start + self.start[at:], end + self.end[at:], new + self.new[at:]


def deobfuscated(text: str) -> Rewritten | None:
    """The text after all transducers; None if none of them applies."""
    r = None
    if not text.isascii() and (hits := list(LOOKALIKE.finditer(text))):
        r = Rewritten(text)
        r.replace([(m.start(), m.end(), "" if ord(m[0]) in INVISIBLE else m[0].translate(HOMOGLYPHS)) for m in hits])
    at = r.text if r else text
    words = at.encode("utf-8", "surrogatepass").translate(BREAKS).split()
    if sum(map(SPOKEN.__contains__, words)) >= 4 and (hits := list(SPELLED.finditer(at))):
        r = r or Rewritten(text)
        edits = []
        for m in hits:
            gap = None  # where the gap behind the name before begins
            for x in ONE_NAME.finditer(at, m.start(), m.end()):
                if gap is not None and gap < x.start():
                    edits.append((gap, x.start(), "." if POINT.fullmatch(at, gap, x.start()) else ""))
                edits.append((x.start(), x.end(), NAMES.get(x[0].lower(), "+")))
                gap = x.end()
        r.replace(edits)
    at = r.text if r else text
    disguises = [(m.start(), m.end(), "@" if m[1].lower() in ("at", "@") else ".") for m in BRACKET.finditer(at)] if any(c in at for c in "[({<") else []
    if disguises:
        r = r or Rewritten(text)
        r.replace(disguises)
        at = r.text
    if b"dot" in words or (b"at" in words and "." in at):

        def means_at(m: re.Match) -> bool:
            host = HOST.match(at, m.end())
            if DOT.search(host[0]) or (r is not None and any(r.new[host.start() : host.end()])):
                return True
            left = LEFT_WORD.search(at, max(0, m.start() - 64), m.start())
            if left is None or "." not in host[0]:
                return False
            return bool(MAILBOX.search(left[0].strip("._"))) or (left[0].lower() not in PRONOUNS and bool(CONTACT.search(at, max(0, left.start() - 40), left.start())))

        if edits := [(m.start(), m.end(), "@" if m[1] else ".") for m in WORDY.finditer(at) if not m[1] or means_at(m)]:
            r = r or Rewritten(text)
            r.replace(edits)
    return r


def pii_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Plain spans and added ones, in code points of the source; of an added span the parts outside plain ones."""
    base = plain_spans(text)
    r, added = deobfuscated(text), []
    if r is not None:
        taken = merge_spans([(s, e) for _, s, e in base])
        starts, free = [s for s, _ in taken], 0
        found = [(r.start[s], max(r.end[s:e]), kind) for kind, s, e in plain_spans(r.text) if any(r.new[s:e])]
        for a, b, kind in sorted(found, key=lambda x: (x[0], -x[1], KINDS.index(x[2]))):
            at = max(a, free)
            free = max(free, b)
            k = max(0, bisect_right(starts, at) - 1)
            while at < b:
                while k < len(taken) and taken[k][1] <= at:
                    k += 1
                stop = min(b, taken[k][0]) if k < len(taken) else b
                if any(c.isalnum() for c in text[at:stop]):
                    added.append((kind, at, stop))
                at = max(stop, min(b, taken[k][1]) if k < len(taken) else b)
    return base, added


def digest(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        rows = []
        for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            base, added = pii_spans(text or "")
            count = [sum(x[0] == k for x in base) for k in KINDS]
            both = sorted(base + added, key=lambda x: (KINDS.index(x[0]), x[1]))
            rows.append((doc, *count, hashlib.sha256(digest(base).encode()).hexdigest(), digest(both), [{"kind": k, "start": s, "end": e} for k, s, e in both]))
        kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))]
        names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "found"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def find_pii(docs: DataFrame) -> DataFrame:
    """Counts and digest of plain spans, all spans as a string and as structs, of every row of docs(doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, found array<struct<kind:string,start:int,end:int>>"
    return rows.mapInArrow(_scan, schema)


def redact_text(text: str | None) -> str | None:
    """The text with every span replaced by its kind in angle brackets; of overlapping spans the earlier and longer one counts."""
    if not text:
        return text
    base, added = pii_spans(text)
    out, at = [], 0
    for kind, s, e in sorted(base + added, key=lambda x: (x[1], -x[2])):
        if s < at:
            if e > at:  # the rest of an overlapping span goes too
                at = e
            continue
        out += [text[at:s], f"<{kind.upper()}>"]
        at = e
    return "".join([*out, text[at:]])


def redact_pii(docs: DataFrame) -> DataFrame:
    """docs with text redacted and n_chars, if there, made to fit; all other columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            at = b.schema.get_field_index("text")
            yield b.set_column(at, "text", pa.array([redact_text(x) for x in b.column(at).to_pylist()], pa.string()))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents")).drop("found")
