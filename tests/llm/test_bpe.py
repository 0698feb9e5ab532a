import random

import public_tokenizers as P
import pytest
import tiktoken

from newsloom.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def samples():
    r = random.Random(3)
    alphabet = "abcdefghij  \n\t'ststre.,!?0123éß北京🎉"
    return ["", None, "a" * 5000, "ab" * 3000, "aaa aaa", "<|endoftext|> x", "  \n \n", "don't we'll", *("".join(r.choice(alphabet) for _ in range(r.randint(0, 300))) for _ in range(200)), "".join(chr(r.randrange(32, 0x2FFF)) for _ in range(3000))]


def test_encode_decode_equal_tiktoken(spark, reference):
    rows = samples()
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(rows)], "doc_id long, text string, decoded2 string").repartition(3)
    out = bpe.decode(bpe.encode(df, PATH, P.PATTERN), PATH).collect()
    assert len(out) == len(rows)
    for r in out:
        text = rows[r.doc_id] or ""
        assert r.ids == reference.encode_ordinary(text)
        assert bytes(r.decoded) == text.encode()


def test_lower_ranks_opened_by_a_merge():
    # merging (a, b) opens "abc", whose rank is below that of "ab"
    ranks = {bytes([i]): i for i in range(256)} | {b"bc": 300, b"abc": 256, b"ab": 257, b"ca": 258}
    pairs = bpe.pair_ranks(ranks)
    r = random.Random(1)
    for _ in range(500):
        piece = bytes(r.choice(b"abc") for _ in range(r.randint(1, 30)))
        want = [ranks[piece]] if piece in ranks else bpe.strict(piece, ranks, pairs)
        assert bpe.replay([piece], ranks, pairs) == [want]
        assert piece in ranks or bpe.strict_heap(piece * 10, ranks, pairs) == bpe.strict(piece * 10, ranks, pairs)


def test_memory_is_bounded(monkeypatch, reference):
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    enc = bpe.Encoder(PATH, P.PATTERN)
    for t in samples():
        ids, at = enc.encode([t or ""])
        assert ids.tolist() == reference.encode_ordinary(t or "") and at.tolist() == [0, len(ids)]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(df, PATH, P.PATTERN), PATH).collect() == []


def test_columns_of_any_name(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = spark.createDataFrame([(1, "some text", [9], "own")], "doc_id long, text string, ids array<int>, decoded string")
    got = bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN), path).first()
    assert bytes(got.decoded) == b"some text" and got.doc_id == 1 and got.ids != [9]
