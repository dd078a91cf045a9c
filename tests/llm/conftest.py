import pytest


@pytest.fixture(scope="module")
def odd_texts():
    """Null, empty, blank, repeated, long and mixed texts."""
    return [
        None, "", " ", "  \n\t ", "a", "don't we'll 'twas I've ''re '’s '", "x  y   z ", "\n\n a\r\nb \u00a0c\u2003 d", "The the THE the",
        "naïve façade 漢字かな 한글 שלום नमस्ते e\u0301 \u0301x", "🙂👍🏽 emoji \U0001f468\u200d\U0001f469", "1234567 3.14 ½ Ⅷ", "!!! ??? *** $$$ a!b",
        "word " * 3000, "z" * 3000, "<|endoftext|> <|startoftext|>", "tab\tsep\x0bvt\x0cff\x1cfs\x85nel", "The the THE the", " 's 't's're'sound 'llama",
        "x\x00y \ufffd\ue000", "a" + " " * 700 + "b", "'s", "''s", " '", "a 's\n's",
    ]


@pytest.fixture(scope="module")
def odd_docs(spark, odd_texts):
    rows = [(i, t, "x", i) for i, t in enumerate(odd_texts)] + [(None, "no id", None, None), (3, "second row of id 3", "y", 1)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, part string, ids int").repartition(4)


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id bigint, text string")
