"""Counts and digests of secrets and personal data against the plain patterns; held_out of the classifiers against zlib."""

import hashlib
import os
import random
import re
import zlib

import pytest
from llm import pii, quality_classifier, secrets

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ASSIGN = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def digits(text):
    return re.sub("[^0-9]", "", text)


def plain_secrets(text):
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    order = ["assign", "access", "hex"]
    return sorted(out, key=lambda s: (s[1], order.index(s[0]))), order


def plain_pii(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m[0])) <= 15]
    return out, ["email", "ip", "card", "phone"]


def expected(text, plain):
    spans, kinds = plain(text or "")
    return (*(sum(k == s[0] for s in spans) for k in kinds), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest())


def odd_texts():
    r = random.Random(9)
    pieces = ["password", "PASSWD", "apiKey", "api_key", "Token", "secret", ":", "=", " ", "  ", '"', "'", "AKIA", "ABCD1234EFGH56789", "abcdef0123456789ab", "0f", "é", "ß", "中", "\n", "\t", "x", "+", "-", ".", "/", "@", "_", "%",
              "12", "4111 1111 1111 1111", "4111-1111-1111-1112", "255", "256", "1.2.3.4", "10.0.0", "+1 (415) 555-0123", "+49", "(0)", "jo.e", "ex-ample.org", "a@b", "a@b.c", "٠", "K", "ſ", "\x00", "longvaluelongvalue", "0123456789"]
    out = ["".join(r.choice(pieces) for _ in range(r.randrange(1, 14))) for _ in range(4000)]
    return [*out, None, "", "password" * 5000, "1 " * 5000, "+1" * 4000, "a@" * 4000, "9" * 3000, "1." * 3000, "token=" + "a" * 9000]


@pytest.mark.parametrize("name", ["documents", "odd"])
def test_secrets_and_pii_follow_the_patterns(spark, name):
    if name == "documents":
        docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    else:
        docs = spark.createDataFrame(list(enumerate(odd_texts())), "doc_id long, text string")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for rows, plain, counts in ((secrets.scan_secrets(docs), plain_secrets, ("n_assign", "n_access", "n_hex")), (pii.find_pii(docs), plain_pii, ("n_email", "n_ip", "n_card", "n_phone"))):
        got = {r["doc_id"]: (*(r[c] for c in counts), r["base_sha256"]) for r in rows.collect()}
        wrong = [(i, texts[i]) for i in texts if got[i] != expected(texts[i], plain)]
        assert len(got) == len(texts) and not wrong, (plain.__name__, [(t or "")[:200] for _, t in wrong[:3]])


def test_held_out_is_a_fifth_by_crc(spark):
    out = quality_classifier.op7_quality_classifier(spark, SF).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out) and len(out) > 100
