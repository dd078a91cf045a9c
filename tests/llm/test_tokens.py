"""Token operators against the libraries' own encoders on whole texts."""
import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from tracewell.llm import bpe_cache, byte_bpe, packing, queries, shared, token_files

SMOKE = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def settings(spark):
    shared.configure(spark)


def library(name):
    found = Tokenizer.from_file(P.path(name))
    found.encode_special_tokens = True
    return lambda text: found.encode(text or "", add_special_tokens=False).ids


def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def documents(spark):
    return spark.read.parquet(f"{SMOKE}/documents.parquet")


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_files_match_library(spark):
    encode = library("byte_bpe_50k.json")
    got = {r.doc_id: r for r in queries.QUERIES["op9_token_files"](spark, SMOKE).collect()}
    start = 0
    for r in documents(spark).orderBy("doc_id").collect():
        ids = encode(r.text) + [0]
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)
    assert len(got) == documents(spark).count()


def test_files_odd(spark, odd_docs, no_docs):
    encode = library("byte_bpe_50k.json")
    parts = token_files.write(odd_docs, P.path("byte_bpe_50k.json"), 0)
    rows = sorted(token_files.read(parts).collect(), key=lambda r: r.start)
    assert sum(r.n_tokens for r in rows) == rows[-1].start + rows[-1].n_tokens
    assert [r.doc_id for r in rows] == sorted((r.doc_id for r in rows), key=lambda x: (x is not None, x or 0))
    want = sorted((r.doc_id if r.doc_id is not None else -1, bytes(np.array(encode(r.text) + [0], "<u4").tobytes())) for r in odd_docs.collect())
    assert want == sorted((r.doc_id if r.doc_id is not None else -1, bytes(r.ids)) for r in rows)
    assert token_files.read(token_files.write(no_docs, P.path("byte_bpe_50k.json"), 0)).count() == 0


def check_pieces(rows, want):
    """Pieces give back every document and fill sequences without gaps."""
    places = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    at = 0
    for sequence, offset, length in places:
        assert sequence * 2048 + offset == at and offset + length <= 2048 and length > 0
        at += length
    assert at == sum(len(x) for x in want)


def test_packing(spark):
    encode = library("word_bpe_49k.json")
    pieces = packing.pack(documents(spark), P.path("word_bpe_49k.json"), 1).collect()
    docs = {r.doc_id: encode(r.text) + [1] for r in documents(spark).collect()}
    check_pieces(pieces, docs.values())
    again = {}
    for r in sorted(pieces, key=lambda r: (r.doc_id, r.start)):
        held = again.setdefault(r.doc_id, [])
        assert len(held) == r.start and r.doc_tokens == len(docs[r.doc_id])
        held += np.frombuffer(r.ids, "<u4").tolist()
        assert r.goes_on == (len(held) < r.doc_tokens)
    assert again == docs
    rows = queries.QUERIES["op6_packing"](spark, SMOKE).collect()
    assert all(crc(docs[r.doc_id][r.start:r.start + r.length]) == r.ids_crc32 for r in rows)
    whole = packing.sequences(packing.pack(documents(spark), P.path("word_bpe_49k.json"), 1)).collect()
    total = sum(map(len, docs.values()))
    assert len(whole) == -(-total // 2048) and all(len(r.ids) == 4 * 2048 for r in whole)


def test_packing_odd(spark, odd_docs, no_docs):
    encode = library("word_bpe_49k.json")
    rows = packing.pack(odd_docs, P.path("word_bpe_49k.json"), 1).collect()
    want = [encode(r.text) + [1] for r in odd_docs.collect()]
    check_pieces(rows, want)
    joined = b"".join(bytes(r.ids) for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)))
    ids = np.frombuffer(joined, "<u4").tolist()
    texts, held = [], []
    for x in ids:
        held.append(x)
        if x == 1 and tuple(held) in {tuple(w) for w in want}:
            texts.append(tuple(held))
            held = []
    assert sorted(texts) == sorted(map(tuple, want))
    assert packing.pack(no_docs, P.path("word_bpe_49k.json"), 1).count() == 0


def test_byte_bpe(spark, odd_docs):
    encode = tik()
    for docs in (documents(spark), odd_docs):
        encoded = byte_bpe.encode(docs, P.path("byte_bpe_multi_50k.tiktoken"))
        rows = byte_bpe.decode(encoded, P.path("byte_bpe_multi_50k.tiktoken")).collect()
        want = sorted((r.doc_id if r.doc_id is not None else -1, encode.encode_ordinary(r.text or ""), (r.text or "").encode()) for r in docs.collect())
        got = sorted((r.doc_id if r.doc_id is not None else -1, np.frombuffer(r.ids, "<u4").tolist(), bytes(r.decoded)) for r in rows)
        assert got == want


def test_byte_bpe_query(spark):
    encode = tik()
    rows = {r.doc_id: r for r in queries.QUERIES["op7_byte_bpe"](spark, SMOKE).collect()}
    for r in documents(spark).collect():
        ids = encode.encode_ordinary(r.text)
        assert rows[r.doc_id].n_tokens == len(ids)
        assert rows[r.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_every_code_point(spark):
    """Classes and merges agree with the library for each code point next to letters, digits and spaces."""
    encode, table = tik(), byte_bpe.ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    import pyarrow as pa

    from tracewell.llm.words import buffers
    texts = ["".join(f"a{c}1{c} {c}{c}'s\n" for c in map(chr, points[i:i + 512])) for i in range(0, len(points), 512)]
    mine = table.encode(buffers(pa.array(texts)))
    bad = [i for i, (t, x) in enumerate(zip(texts, mine)) if np.frombuffer(x, "<u4").tolist() != encode.encode_ordinary(t)]
    assert not bad, [hex(points[i * 512]) for i in bad][:10]


def test_offsets(spark):
    text = "naïve 漢字 don't stop  now 🙂"
    table = byte_bpe.ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    import pyarrow as pa

    from tracewell.llm.words import buffers
    ids = table.encode(buffers(pa.array([text])))[0]
    offsets = table.offsets(np.frombuffer(ids, "<u4")).astype("<i8").tobytes()
    raw = text.encode()
    for a in range(0, len(raw), 3):
        for b in range(a, len(raw) + 1, 5):
            assert byte_bpe.decode_range(ids, offsets, a, b, P.path("byte_bpe_multi_50k.tiktoken")) == raw[a:b]


def test_long_merge():
    table = byte_bpe.ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    pieces = [b"a" * 300, b"ab" * 170, bytes(range(128, 256)), "über".encode() * 90, b"x"]
    assert [table.merge_long(p) for p in pieces] == table.merge_all(pieces)


MARKED = ["a <|endoftext|> b", "a <|startoftext|> b", "<|endoftext|><|startoftext|>", "  <|endoftext|>  x \n<|startoftext|>\n", "a  <|endoftext|>",
          "<|ENDOFTEXT|> <|endoftext| >", "<|end<|endoftext|>oftext|>", "e\u0301<|startoftext|>\u0301e don<|endoftext|>'t", "no mark"]


def by_default(name):
    found = Tokenizer.from_file(P.path(name))
    return lambda text: found.encode(text, add_special_tokens=False).ids


def test_special_tokens(spark, tmp_path):
    """The queries and the last stage give the library's default ids for texts that name special tokens."""
    import random

    import corpus_pipeline
    rnd = random.Random(3)
    bits = ["<|endoftext|>", "<|startoftext|>", " ", "  ", "\n", "a", "The", "'s", "<|", "|>", "7", "é", "\t", "\u00a0"]
    texts = MARKED + ["".join(rnd.choices(bits, k=rnd.randint(1, 12))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    encode, start = by_default("byte_bpe_50k.json"), 0
    for r in queries.QUERIES["op9_token_files"](spark, str(tmp_path)).orderBy("doc_id").collect():
        ids = encode(texts[r.doc_id]) + [0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)
    want = [by_default("word_bpe_49k.json")(t) + [1] for t in texts]
    rows = queries.QUERIES["op6_packing"](spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} == set(range(len(texts)))
    assert all((r.doc_tokens, r.ids_crc32) == (len(want[r.doc_id]), crc(want[r.doc_id][r.start:r.start + r.length])) for r in rows)
    again = {}
    for r in sorted(corpus_pipeline.packed(spark, docs, str(tmp_path)).collect(), key=lambda r: (r.doc_id, r.start)):
        again.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert again == dict(enumerate(want))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_merges_match_library(name, odd_texts):
    """Pieces encoded by merges alone are those of the library: every plain character alone, in pairs and between letters, and random pieces."""
    coder, whole = bpe_cache.Encoder(P.path(name)), Tokenizer.from_file(P.path(name))
    assert coder.merges is not None
    signs = [chr(c) for c in [*range(0x21, 0x7F), *range(0xA1, 0x100)]]
    rng = np.random.default_rng(3)
    pieces = signs + [a + b for a in signs for b in signs[::7]] + [f"ab{c}cd" for c in signs] + [f"{c}'S{c}" for c in signs] + [f"a{c}" for c in signs]
    pieces += ["".join(rng.choice(signs, int(rng.integers(1, 12)))) for _ in range(5000)] + ["".join(rng.choice(list("aeinrst'.,S1"), 9)) for _ in range(5000)]
    pieces += ["İ", "ﬁ", "e\u0301", "Σ", "Σας", "ΑΣ", "漢字", "ab\u00a0cd", "x\x85y", "\x7f", "\x00", "y" * 300]
    texts = ["", " ", *pieces, " ".join(pieces), *(t or "" for t in odd_texts)] + [f" {x} {x}" for x in pieces[::11]]
    found = coder.encode(texts, special=True)
    want = whole.encode_batch(texts, add_special_tokens=False)
    for text, mine, ids in zip(texts, found, want):
        assert np.frombuffer(mine, f"<u{coder.width}").tolist() == ids.ids, text[:80]


def test_calls_per_new_piece():
    """The work in Python for pieces not seen before is a few calls each: it is most of the time of op9."""
    import cProfile

    coder = bpe_cache.Encoder(P.path("byte_bpe_50k.json"))
    letters = "abcdefghijklmnopqrst"
    texts = [" ".join(a + b + c + d for c in letters for d in letters) for a in letters for b in letters[:2]]
    profile = cProfile.Profile()
    found = profile.runcall(coder.encode, texts)
    calls = sum(x.callcount for x in profile.getstats())
    assert calls < 14 * sum(len(x.split(" ")) for x in texts)
    assert [np.frombuffer(x, "<u2").tolist() for x in found] == [x.ids for x in coder.library.encode_batch(texts, add_special_tokens=False)]
