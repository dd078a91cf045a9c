"""Secrets against searching patterns and against tokens with right and wrong checksums."""
import hashlib
import re
import string
import zlib

import pytest
from hypothesis import given, settings as examples
from hypothesis import strategies as st

from tracewell.llm import queries, secret_scan, shared

TABLES = "/root/testdata/sf0.01"


@pytest.fixture(autouse=True)
def settings(spark):
    shared.configure(spark)


def any_case(word):
    return "".join(f"[{c}{c.upper()}]" if c in string.ascii_lowercase else c for c in word)


WORDS = "|".join(any_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
PLAIN = {
    "assign": (re.compile(rf"""({WORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
    "access": (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    "hex": (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
}


def base(text):
    found = [(m.start(), i, name, m.end()) for i, (name, (pattern, good)) in enumerate(PLAIN.items()) for m in pattern.finditer(text or "") if good(m)]
    return [(name, start, end) for start, _, name, end in sorted(found)]


def listed(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def crc_token(prefix, body):
    number, digits = zlib.crc32(body.encode()), ""
    while len(digits) < 6:
        digits = secret_scan.BASE62[number % 62] + digits
        number //= 62
    return prefix + body + digits


BODY = "a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5"
WALLET = "xprv9s21ZrQH143K3QTDL4LXw2F7HEK3wJUD2nW2nRk4stbPy6cq3jPPqjiChkVvvNKmPGJxWUtg6LnF5kejMRNNU3TGtRBeJgk33yuGBxrMPHi"  # published test vector
AGE = "AGE-SECRET-KEY-1GFPYYSJZGFPYYSJZGFPYYSJZGFPYYSJZGFPYYSJZGFPYYSJZGFPQ4EGAEX"  # published test vector
ODD = [None, "", "token", "token:", "token=abcde", "token=abcdef", "TOKEN' : \"a/b+c=d.e_f-g", "password=secret=abcdef", "password: token: abcdefg", "api_key=123456 apikey=123456",
       "apiikey=123456", "toKen=abcdef paſſword=abcdef", "é漢🙂 secret=abcdef", "AKIA" * 8, "AKIA" + "A" * 15, "AKIA" + "A" * 16, "akia" + "A" * 16, "0" * 23, "0" * 24, "A" + "0a" * 12 + "g" + "f" * 30,
       "passwd=" + "x" * 100_000, "f" * 100_000, "secret" + " " * 50_000 + "=abcdef", "tokentoken=abcdef", "secret\n=abcdef", "token=éabcdef", "tokens=abcdef", "\x00token=abcdef\x00",
       crc_token("ghp_", BODY), crc_token("ghp_", BODY)[:-1] + "!", "ghp_" + BODY + "000000", "x ghs_ghs_" + crc_token("", BODY), "npm_" + crc_token("", BODY), "npm_" + crc_token("", BODY) + "a",
       f"token={crc_token('gho_', BODY)}", WALLET, WALLET[:-1] + "j", AGE, AGE[:-1] + "Q", AGE.lower()]


def test_spans(spark):
    docs = spark.createDataFrame([(i, t, "old", i) for i, t in enumerate(ODD)] + [(None, "secret=abcdef", None, None), (5, "token=abcdef", "y", 1)],
                                 "doc_id bigint, text string, Spans string, scanned int").repartition(3)
    rows = secret_scan.scan(docs, redacted="clean").collect()
    assert rows[0].__fields__ == ["doc_id", "text", "scanned", "spans", "clean"]
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in rows) == sorted((i is None, i or 0, t or "") for i, t, _, _ in docs.collect())
    for r in rows:
        assert [tuple(s) for s in r.spans if s.kind in secret_scan.BASE] == base(r.text), r.text[:60]
        assert (r.clean is None) == (r.text is None)
        assert r.text is None or (secret_scan.MARK in r.clean) == bool(r.spans)
    extra = {r.text: [s.kind for s in r.spans if s.kind not in secret_scan.BASE] for r in rows if r.text}
    want = {crc_token("ghp_", BODY): ["github"], "x ghs_ghs_" + crc_token("", BODY): ["github"], "npm_" + crc_token("", BODY): ["npm"],
            f"token={crc_token('gho_', BODY)}": ["github"], WALLET: ["wallet"], AGE: ["bech32"]}
    assert {t: k for t, k in extra.items() if k} == want
    assert secret_scan.scan(docs.limit(0)).count() == 0


def test_redacted():
    text = "a token=abcdef, 漢 " + "0f" * 14 + " z"
    spans = secret_scan.Scanner().spans(text)
    assert secret_scan.masked(text, spans, "#") == "a #, 漢 # z"
    assert secret_scan.masked("0123456789", [("a", 1, 4), ("b", 2, 6), ("c", 6, 8)], "#") == "0##89"


@examples(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["token", "Secret", "PASSWD", "api_key", "=", ":", " ", '"', "'", "abc", "12345678", "f" * 11, "AKIA", "Z9Z9Z9Z9", "é", "\n", "_", "K"]), max_size=25))
def test_base_as_searched(parts):
    text = "".join(parts)
    assert [s for s in secret_scan.Scanner().spans(text) if s[0] in secret_scan.BASE] == base(text)


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.QUERIES["op11_secret_scan"](spark, TABLES).collect()
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        want = base(texts[r.doc_id])
        counts = [sum(k == kind for k, _, _ in want) for kind in secret_scan.BASE]
        assert [r.n_assign, r.n_access, r.n_hex] == counts
        assert r.base_sha256 == hashlib.sha256(listed(want).encode()).hexdigest()
        assert set(filter(None, listed(want).split(","))) <= set(r.spans.split(","))
    assert any(r.n_assign for r in rows)
