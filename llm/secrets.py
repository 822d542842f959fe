"""Secret scan with a linear-chain conditional random field.

Fixed patterns give the base spans.  A CRF with the states outside, begin and
inside adds spans: emission scores come from the shape of a token, its
neighbours and features of the file, transitions from a learnt 3 x 3 matrix,
and Viterbi decodes each text.  Plain tokens (short, or letters only) that
aren't beside a key word are outside by a hard constraint of the lattice, so
that the chain falls apart into runs of other tokens that are decoded on their
own.  A decoded run is a span from end to end, without quotes, brackets and the
name it is assigned to; where base spans cover parts of it, the rest is kept.

The likelihood is that of whole runs: begin, transitions and the transition to
outside behind the last token, the same terms that Viterbi maximises.  Training is on the driver from a bounded sample: ``sample_rows`` whole texts of
``sample_chars`` characters at most (about; by the hash of their ids, never more
than twice as many) labelled by the base patterns, and
``synthetic_rows`` generated lines with secrets of many formats and look-alikes;
runs of more than ``TRAIN_RUN`` tokens teach in pieces, decoding never cuts them.

Edge cases: a null text is empty; an empty table still trains on generated
lines and gives no rows; equal starts are ordered by kind, equal scores go to the
state nearest to outside; a text of any length is decoded whole, in time in
proportion; repeated rows are scanned each; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import slices, table

KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # the runs of [0-9a-f]+ that have 16 characters or more
KEYWORD = re.compile(r"(?i:passw|secret|token|api_?-?key|bearer|credential|private|auth)", re.ASCII)
KNOWN = re.compile(r"AKIA|ASIA|ghp_|gho_|sk-|sk_|pk_|xox[abp]-|eyJ|AIza|ya29|glpat-|-----BEGIN|npm_")
EDGE = " \t\n\r\x0b\x0c.,;:!?\"'()[]{}<>#*$%&|=`"
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
LEFT, RIGHT = " \t\n\r\x0b\x0c\"'`([{<,;", " \t\n\r\x0b\x0c\"'`)]}>.,;"
NAME = re.compile(r"""["'`(\[{<]*+([^\s:=]++)[:=](?!//)""")  # what a value may be assigned to
LETTERS = re.compile(r"""[A-Za-z_.-]+["']*""")
ALNUM = re.compile(r"[^\W_]")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind."""
    out = []
    if ":" in text or "=" in text:
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def plain(word: str) -> bool:
    """Whether the lattice holds the token outside any secret, unless it is beside a key word."""
    if len(word) < 8 or word.isalpha():
        return True
    core = word.strip(EDGE)
    return len(core) < 8 or core.isalpha()


def shape(word: str) -> list[float]:
    """Features of one token that isn't plain."""
    core = word.strip(EDGE)
    value = core.rpartition("=")[2] if "=" in core.rstrip("=") else core
    value = value.rpartition(":")[2].strip("\"'") or core
    n = max(1, len(value))
    digit, upper, lower = (sum(f(c) for c in value) / n for f in (str.isdigit, str.isupper, str.islower))
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    flips = sum(a.isdigit() != b.isdigit() or a.isupper() != b.isupper() for a, b in zip(value, value[1:])) / n  # noqa: B905
    return [
        1.0, n >= 12, n >= 16, n >= 20, n >= 32, n > 80, digit, digit > 0.9, upper, lower, 0 < upper < 1 and lower > 0 and digit > 0,
        all(c in "0123456789abcdef" for c in value), all(c in "0123456789+().- " for c in value), entropy > 2.8, entropy > 3.3, entropy > 3.8, flips > 0.25, flips > 0.45,
        bool(KNOWN.match(value)), bool(KEYWORD.search(core)) and core != value, "://" in word or "www." in word, "@" in word, value.count("/") > 1, value.count("-") > 2, value.count(".") > 1,
        not value.isascii(), any(c in "|&<>$%#*" for c in core),
    ]


def beside(word: str | None) -> list[float]:
    """Features of a neighbour."""
    if word is None:
        return [0.0] * 4
    return [bool(KEYWORD.search(word)), word[-1] in "=:", plain(word), word.strip(EDGE) in ("", "=", ":", "->")]


def assigned(words: list[str], i: int) -> bool:
    """Whether a key word and a sign of assignment stand before the token."""
    if i > 0 and words[i - 1][-1] in "=:" and KEYWORD.search(words[i - 1]):
        return True
    return i > 1 and words[i - 1] in ("=", ":", ":=", "=>", "->") and bool(KEYWORD.search(words[i - 2]))


def file_features(words: list[str], odd: int, keys: int) -> list[float]:
    """Features of the file: how many tokens aren't plain, its length, key words, and whether it looks like code or settings."""
    n, ends = len(words), sum(w[-1] in ";={}:," for w in words)
    return [odd > 0.2 * n, odd > 0.05 * n, n < 40, n > 2000, keys > 0, keys > 0.02 * n, ends > 0.15 * n]


N_FEATURES = len(shape("abcdefgh1")) + 2 * 4 + 4 + 7 + 4
#: tokens of a run in training
TRAIN_RUN = 32


def lattice(words: list[str]) -> tuple[list[int], list[list[float]]]:
    """Positions of the tokens that aren't plain or are beside a key word, and their features."""
    at = [i for i, w in enumerate(words) if len(w) >= 8 and not w.isalpha() and not plain(w)]
    odd, keys = len(at), []
    if KEYWORD.search(" ".join(words)):
        keys = [i for i, w in enumerate(words) if len(w) >= 4 and KEYWORD.search(w)]
        near = {i for k in keys for i in (k - 1, k + 1) if 0 <= i < len(words)} | {k + 2 for k in keys if k + 2 < len(words) and words[k + 1].strip(EDGE) in ("", "=", ":", "->", "is")}
        at = sorted(set(at) | {i for i in near if ALNUM.search(words[i])})
    if not at:
        return [], []
    whole, near = file_features(words, odd, len(keys)), lambda i: beside(words[i] if 0 <= i < len(words) else None)
    out = []
    for i in at:
        easy, after, own = plain(words[i]), assigned(words, i), bool(KEYWORD.search(words[i]))
        out.append([*map(float, [*shape(words[i]), *near(i - 1), *near(i + 1), *near(i - 2), *whole, easy, after, easy and after, easy and own])])
    return at, out


def viterbi(emit: np.ndarray, trans: np.ndarray, begin: np.ndarray) -> list[int]:
    score, back = emit[0] + begin, []
    for e in emit[1:]:
        all_ways = score[:, None] + trans
        back.append(all_ways.argmax(0))
        score = all_ways.max(0) + e
    path = [int((score + trans[:, 0]).argmax())]  # what follows is outside
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def _spend(rng: random.Random, alphabet: str, low: int, high: int) -> str:
    return "".join(rng.choice(alphabet) for _ in range(rng.randint(low, high)))


def generated(rng: random.Random) -> tuple[list[str], list[int]]:
    """A line of tokens with its states."""
    low, digit = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    up, b64 = low.upper(), low + low.upper() + digit
    word = lambda: _spend(rng, low, 2, 11)
    secret = rng.choice((
        lambda: _spend(rng, b64, 20, 48), lambda: "AKIA" + _spend(rng, up + digit, 16, 16), lambda: "ghp_" + _spend(rng, b64, 36, 36), lambda: "sk-" + _spend(rng, b64, 32, 48),
        lambda: _spend(rng, digit + "abcdef", 32, 64), lambda: "eyJ" + _spend(rng, b64, 20, 30) + "." + _spend(rng, b64, 30, 60) + "." + _spend(rng, b64, 30, 43), lambda: _spend(rng, b64 + "+/", 40, 64) + "==",
        lambda: "xoxb-" + _spend(rng, digit, 10, 12) + "-" + _spend(rng, b64, 24, 24), lambda: _spend(rng, b64 + "_.-", 14, 24),
    ))
    harmless = rng.choice((
        lambda: f"https://www.{word()}.com/{word()}/{word()}?id={rng.randint(1, 9999)}", lambda: f"{word()}.{word()}@{word()}.com", lambda: _spend(rng, digit, 8, 20), lambda: f"+1-{_spend(rng, digit, 3, 3)}-{_spend(rng, digit, 3, 3)}-{_spend(rng, digit, 4, 4)}",
        lambda: f"20{rng.randint(10, 26)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}T10:2{rng.randint(0, 9)}:00", lambda: f"{word()}_{word()}_{word()}", lambda: f"/usr/{word()}/{word()}.{word()}", lambda: f"{word()}-{word()}-{word()}", lambda: f"{word()}.{word()}",
        lambda: f"{word()}{rng.randint(1, 99)}{word()}", lambda: f"192.168.{rng.randint(0, 255)}.{rng.randint(0, 255)}", lambda: f"{word()}###{word()}", lambda: f"{word()}|{word()}", lambda: f"{rng.randint(1, 999)},{rng.randint(100, 999)}.{rng.randint(10, 99)}", lambda: f"v{rng.randint(1, 9)}.{rng.randint(0, 99)}.{rng.randint(0, 99)}-beta",
    ))
    key = rng.choice(("password", "secret", "token", "api_key", "apikey", "SECRET_KEY", "auth_token", "Authorization:", "credentials"))
    left, right = [word() for _ in range(rng.randint(2, 6))], [word() for _ in range(rng.randint(2, 6))]
    if (kind := rng.random()) < 0.24:  # values of letters only, short ones and ones with symbols beside a key word; key words in prose
        name = key.rstrip(":")
        value = rng.choice((lambda: _spend(rng, low, 4, 16), lambda: _spend(rng, low + up, 6, 20), lambda: _spend(rng, b64, 4, 7), lambda: _spend(rng, b64 + "$!#&%@^*", 8, 18) + rng.choice(digit)))()
        if kind < 0.14:
            middle, states = rng.choice((([f"{name}:", value], [0, 1]), ([f"{name}=", value], [0, 1]), ([name, rng.choice("=:"), value], [0, 0, 1]), ([f"{name}={value}"], [1])))
        else:
            middle = [word(), rng.choice(("secret", "private", "author", "authority", "token", "password", "secretary")), *rng.choice(([], ["is"])), word()]
            states = [0] * len(middle)
        return left + middle + right, [0] * len(left) + states + [0] * len(right)
    kind = rng.random()
    if kind < 0.45:
        middle, states = [harmless()], [0]
    elif kind < 0.55:
        middle, states = [f"{key}={harmless()}" if rng.random() < 0.3 else key, harmless()], [0, 0]
    elif kind < 0.7:
        middle, states = [secret()], [1]
    elif kind < 0.85:
        middle, states = [key, rng.choice("=:"), f'"{secret()}"'], [0, 0, 1]
    elif kind < 0.95:
        middle, states = [f"{key}={secret()}"], [1]
    else:
        middle, states = [secret() for _ in range(3)], [1, 2, 2]
    return left + middle + right, [0] * len(left) + states + [0] * len(right)


class Model:
    """Weights of the CRF: emission (features x 3), transition (3 x 3), begin of a run (3)."""

    def __init__(self, weights: np.ndarray, trans: np.ndarray, begin: np.ndarray):
        self.weights, self.trans, self.begin = weights, trans, begin

    def runs(self, words: list[str]) -> list[tuple[int, int]]:
        """Token intervals [first, last] of the tagged secrets."""
        at, features = lattice(words)
        if not at:
            return []
        emit, out, k = np.array(features) @ self.weights, [], 0
        while k < len(at):
            j = k
            while j + 1 < len(at) and at[j + 1] == at[j] + 1:
                j += 1
            states = viterbi(emit[k : j + 1], self.trans, self.begin)
            for i, s in enumerate(states):
                if s == 1:
                    out.append((at[k + i], at[k + i]))
                elif s == 2 and out and out[-1][1] == at[k + i] - 1:
                    out[-1] = (out[-1][0], at[k + i])
            k = j + 1
        return out


def fit(lines: list[tuple[list[str], list[int]]], steps: int = 150, rate: float = 0.3, decay: float = 1e-3) -> Model:
    """Maximum likelihood by full-batch Adagrad; the runs of all lines are padded into one batch for forward-backward."""
    runs = []
    for words, states in lines:
        at, features = lattice(words)
        k = 0
        while k < len(at):
            j = k
            while j + 1 < len(at) and at[j + 1] == at[j] + 1 and j + 1 - k < TRAIN_RUN:
                j += 1
            runs.append((np.array(features[k : j + 1]), [states[i] for i in at[k : j + 1]]))
            k = j + 1
    n, t = len(runs), max(len(s) for _, s in runs)
    x, y, mask = np.zeros((n, t, N_FEATURES)), np.zeros((n, t), int), np.zeros((n, t), bool)
    for i, (f, s) in enumerate(runs):
        x[i, : len(s)], y[i, : len(s)], mask[i, : len(s)] = f, s, True
    one = np.eye(3)[y] * mask[..., None]
    pair = np.einsum("nti,ntj->ij", one[:, :-1], one[:, 1:])
    pair[:, 0] += one[np.arange(n), mask.sum(1) - 1].sum(0)  # what follows a run is outside
    w, a, b = np.zeros((N_FEATURES, 3)), np.zeros((3, 3)), np.zeros(3)
    forbid = np.zeros((3, 3))
    forbid[0, 2] = -30.0  # inside never follows outside
    past = [np.full(v.shape, 1e-6) for v in (w, a, b)]
    first_forbid = np.array([0.0, 0.0, -30.0])
    lse = lambda v, axis: np.log(np.exp(v - v.max(axis, keepdims=True)).sum(axis)) + v.max(axis)
    for _ in range(steps):
        emit, tr = x @ w, a + forbid
        alpha, beta = np.zeros((n, t, 3)), np.zeros((n, t, 3))
        alpha[:, 0] = emit[:, 0] + b + first_forbid
        for i in range(1, t):
            step = lse(alpha[:, i - 1, :, None] + tr, 1) + emit[:, i]
            alpha[:, i] = np.where(mask[:, i, None], step, alpha[:, i - 1])
        beta[:, t - 1] = tr[:, 0]
        for i in range(t - 2, -1, -1):
            step = lse(tr + (emit[:, i + 1] + beta[:, i + 1])[:, None, :], 2)
            beta[:, i] = np.where(mask[:, i + 1, None], step, tr[:, 0])
        last = alpha[:, -1] + tr[:, 0]
        z = lse(last, 1)
        prob = np.exp(alpha + beta - z[:, None, None]) * mask[..., None]
        both = np.exp(alpha[:, :-1, :, None] + tr + (emit[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
        moves = both.sum((0, 1))
        moves[:, 0] += np.exp(last - z[:, None]).sum(0)
        grads = (np.einsum("ntf,nts->fs", x, prob - one) / n + decay * w, (moves - pair) / n + decay * a, (prob[:, 0] - one[:, 0]).mean(0))
        for v, g, p in zip((w, a, b), grads, past, strict=True):
            p += g * g
            v -= rate * g / np.sqrt(p)
    return Model(w, a + forbid, b + first_forbid)


def train(docs: DataFrame, sample_rows: int = 300, sample_chars: int = 20_000, synthetic_rows: int = 1500, seed: int = 7) -> Model:
    rng = random.Random(seed)
    lines = [generated(rng) for _ in range(synthetic_rows)]
    step = max(1, docs.count() // sample_rows)
    sample = docs.select(F.col("text").cast("string").alias("text"), F.xxhash64("doc_id").alias("h")).where((F.pmod("h", F.lit(step)) == 0) & (F.length("text") <= sample_chars)).orderBy("h", "text").limit(2 * sample_rows)
    for row in sample.collect():  # a bounded training sample
        spans, words, states, before = base_spans(row["text"]), [], [], None
        for m in TOKEN.finditer(row["text"]):
            words.append(m[0])
            of = next(((s, e) for _, s, e in spans if s < m.end() and m.start() < e and not row["text"][s:e].isdigit()), None)
            secret = of is not None and (not plain(m[0]) or assigned(words, len(words) - 1))
            states.append((2 if of == before and states[-1] else 1) if secret else 0)  # inside, if the span goes on
            before = of if secret else None
        lines.append((words, states))
    return fit(lines)


def value_of(text: str, start: int, end: int) -> int:
    """Where the value begins in a decoded run, behind the name it is assigned to."""
    piece = text[start:end]
    if "://" in piece:
        lead = piece.find("=") + 1 if "=" in piece.rstrip("=\"'.,;") else 0
    else:
        lead = 0
        while (m := NAME.match(piece, lead)) and (KEYWORD.search(m[1]) or (lead == 0 and LETTERS.fullmatch(m[1]))) and ALNUM.search(piece, m.end()):
            lead = m.end()
    return start + lead


def rest_of(text: str, start: int, end: int, base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """The parts of [start, end) outside base spans, without quotes and brackets around them."""
    parts = []
    for _, x, y in [*base, ("", end, end)]:  # by start
        if (stop := min(x, end)) > start:
            s, e = start, stop
            while s < e and text[s] in LEFT:
                s += 1
            while e > s and text[e - 1] in RIGHT:
                e -= 1
            if ALNUM.search(text, s, e):
                parts.append((s, e))
        start = max(start, y)
    return parts


def secret_spans(text: str, model: Model) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans and the spans that the CRF adds, by start, then kind."""
    base, added = base_spans(text), []
    if runs := model.runs(TOKEN.findall(text)):
        place = [m.span() for m in TOKEN.finditer(text)]
        for first, last in runs:
            start, end = place[first][0], place[last][1]
            added += [("crf", s, e) for s, e in rest_of(text, value_of(text, start, end), end, base)]
    return base, added


def digest(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scan_secrets(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Counts and digest of base spans and all spans of every row of docs(doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    model = model or train(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                base, added = secret_spans(text or "", model)
                both = sorted(base + added, key=lambda x: (x[1], KINDS.index(x[0])))
                out.append((doc, *(sum(x[0] == k for x in base) for k in KINDS[:3]), hashlib.sha256(digest(base).encode()).hexdigest(), digest(both)))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))
