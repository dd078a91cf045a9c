"""One pass over a text finds the plain words of all rules; the banks give what testing every rule gives."""
from __future__ import annotations

import re

from pyspark.sql import functions as F

from tracewell.plans import catalogue, rules as R


def test_any_of_finds_words_inside_and_behind_each_other():
    words = ["rate", "rate limit", "limit", "mit", "a.b", "[x]", "x", " end", "é1", *"bcdefghijkl"]
    pattern = re.compile(catalogue.any_of(words))
    for text in ("", "rate limits", "rat rate limi", "a.b axb [x] the end", "é1 é2", "abcdefghijklm"):
        found = {w for m in pattern.finditer(text) for w in words if m.group(1).startswith(w)}
        assert found == {w for w in words if w in text}


def test_banks_equal_the_test_of_every_rule(spark, monkeypatch):
    book = R.load()
    book["causes"] = [*book["causes"], {"id": "bare", "scope": "", "pattern": "[0-9]{7}", "needles": []}]
    texts = [r["example"] for r in (*book["causes"], *book["events"]) if "example" in r] + [None, "", "x", "1234567", "FAILED İ timed out"]
    texts += [f"{a} {b}" for a, b in zip(texts[::3], texts[1::3])]
    rows = spark.createDataFrame([(i, t, t and t.lower()) for i, t in enumerate(texts)], "k int, body string, body_lower string").selectExpr(
        "*", "array('llm', 'tool', 'platform') AS scopes", "k % 5 = 4 AS is_observation", "k % 7 = 6 AS is_continuation",
        "CAST(k % 300 AS bigint) AS exit_code", "CAST(429 AS bigint) AS http_status")

    def matched():
        return sorted(R.match_events(R.match_causes(rows, book["causes"]), book["events"]).select(
            "k", "cause_matches", "_causes", "event_matches", "_events", "_operation").collect())

    got = matched()
    assert sum(len(r.cause_matches or ()) for r in got) > 150
    monkeypatch.setattr(R, "_named_parts", lambda rules, lowered: F.lit((1 << R.PARTS) - 1))  # test every rule
    assert got == matched()


def test_a_bank_tests_only_the_parts_that_are_named(spark):
    book = R.load()
    causes = book["causes"]
    lines = spark.createDataFrame([("all is well",), (f"x {causes[0]['needles'][0]} y",), (None,)], "low string")
    found = [r[0] for r in lines.select(R._named_parts(causes, "low")).collect()]
    assert found[0] == 0 and found[1] & 1 and bin(found[1]).count("1") < 6 and found[2] is None
