import random
import re

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from newsloom.llm import bpe

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages_take_effect(spark, tmp_path):
    r = random.Random(7)
    words = ["w%d" % i for i in range(500)]
    clean = [" ".join(r.choice(words) for _ in range(60)) for _ in range(20)]
    near = clean[0].split()
    near[3] = "changed"
    rows = [(i, t, "en", "ab"[i % 2], len(t)) for i, t in enumerate(clean)]
    rows += [(20, clean[0], "en", "a", len(clean[0])), (21, " ".join(near), "en", "b", len(clean[0])), (22, "too short", "en", "a", 9), (23, None, None, None, 0), (24, "again and again " * 30, "en", "a", 480), (25, clean[5] + " x token=abcdefgh1", "fr", "b", 0)]
    spark.createDataFrame([(*x, "extra") for x in rows], "doc_id long, text string, lang string, source string, n_chars long, own_key string").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = {x.doc_id: x.text for x in docs.collect()}
    assert set(seen["quality"]) == {*range(22), 25}
    # 20 is a copy and 21 a near copy of 0; 25 differs from 5 by two words of 62
    assert set(seen["near copies"]) == set(range(20))
    assert seen["secrets"] == {i: clean[i] for i in range(20)}

    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    sizes = {"a": 0, "b": 0}
    for x in final:
        assert x.text == clean[x.doc_id] and x.ids == enc.encode_ordinary(x.text) and x.n_tokens == len(x.ids)
        sizes[x.source] += len(WORD.findall(x.text))
    total = sum(len(WORD.findall(t)) for t in clean)
    assert abs(sizes["a"] - total * 5 / 7) <= 60 and abs(sizes["b"] - total * 2 / 7) <= 60


def test_secrets_are_masked(spark, tmp_path):
    df = spark.createDataFrame([(1, "key token=abcdefgh1 end", "en", "a", 23)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [(x.text, x.n_chars) for x in corpus_pipeline.secrets(spark, df, "").collect()] == [("key [SECRET] end", 16)]


def test_near_copies_drop_only_equal_rows(spark):
    """Two texts of one id are two documents; a third of another id stays too; empty tables stay empty."""
    texts = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(3)]
    rows = [(1, texts[0]), (1, texts[1]), (2, texts[2]), (2, texts[2]), (None, texts[1]), (None, None), (5, None), (6, ""), (7, "long " * 200_000)]
    df = spark.createDataFrame([(*x, "en", "a", 0, "own") for x in rows], "doc_id long, text string, lang string, source string, n_chars long, own string")
    got = sorted(((x.doc_id or -1), (x.text or "")[:9]) for x in corpus_pipeline.near_copies(spark, df, "").collect())
    assert got == sorted([(1, texts[0][:9]), (1, texts[1][:9]), (2, texts[2][:9]), (-1, ""), (5, ""), (6, ""), (7, "long long")])
    empty = df.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").collect() == []
