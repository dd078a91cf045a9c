"""URL filter against its SQL on the tables and against a loop over the rules."""
import re

import pytest

from tests.llm.sql import same_as_sql
from tracewell.llm import shared, url_rules

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/es/", "allow"), ("example.org", "/es/a", "allow"),
         ("example.org", "/es/ab", "block"), ("a.example.org", "/es/ab", "allow"), ("com", "", "block"), ("", "/x", "block"), (None, "/", "block"),
         ("net", None, "block"), ("b.net", "/q", None), ("münchen.de", "/ü", "block")]


@pytest.fixture(autouse=True)
def settings(spark):
    shared.configure(spark)


def brute(url):
    found = re.search(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host = "".join(c.lower() if c.isascii() else c for c in found[1]) if found else ""
    path = found[2] if found else ""
    best = max(((len(h + (p or "")), len(h), v, h + (p or "")) for h, p, v in RULES
                if h is not None and v is not None and (host == h or host.endswith("." + h)) and path.startswith(p or "")), default=None)
    return host, path, best[3] if best else None, best[2] if best else "allow"


URLS = [None, "", "no scheme", "http://", "http:///x", "http://ORG/", "http://org", "https://example.org/es/abc?x=1#y", "x://a.example.org/es/ab", "x://A.b.Example.org/es/abz",
        "x://example.org/es/", "x://example.org/es", "x://example.com", "x://com/", "x://xcom/", "x://dot./x/y", "x://a.net/", "x://b.net/q", "x://münchen.de/üb", "x://münchen.de/u",
        "a://b://c.org/", "x://example.org:80/es/", "x://example.org/es/ab\n", "x://a..org/é", "x://example.org/es/\U0010ffff"] * 2


def test_rules(spark):
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(URLS)], "page_id int, url string, rule string").repartition(5)
    rows = url_rules.judge(pages, spark.createDataFrame(RULES, "host string, path string, verdict string")).collect()
    assert sorted((r.page_id, r.host, r.path, r.rule or "-", r.verdict) for r in rows) == sorted(
        (i, h, p, r or "-", v) for i, u in enumerate(URLS) for h, p, r, v in [brute(u)])


def test_empty(spark):
    none = spark.createDataFrame([], "page_id int, url string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    assert url_rules.judge(none, rules).count() == 0
    one = spark.createDataFrame([(1, "x://a.org/")], "page_id int, url string")
    assert url_rules.judge(one, rules.limit(0), default="block").collect()[0].verdict == "block"


def test_query(spark):
    same_as_sql(spark, "op3_url_filter")


def test_native_plan(spark):
    from tracewell.llm import queries
    plan = queries.QUERIES["op3_url_filter"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct", plan)


def test_clashing_columns_are_kept(spark):
    pages = spark.createDataFrame([(1, "x://a.org/es/", "kept")], "page_id int, url string, _best string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    row = url_rules.judge(pages, rules).collect()[0]
    assert (row._best, row.rule, row.verdict) == ("kept", "org/", "allow")
