"""Corpus preparation: quality rules, near copies, secrets, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which the
caller writes as Parquet and reads again as the next stage's documents.  All
but the last keep the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.bpe import decode, encode
from newsloom.llm.line_rules import apply_line_rules
from newsloom.llm.mixing import apply_mix
from newsloom.llm.ngram_join import ngram_jaccard_join
from newsloom.llm.scratch import Scratch
from newsloom.llm.secrets import redact


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines leave the texts; documents that the rules reject go."""
    return apply_line_rules(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays.

    A document is a pair of id and text: rows equal in both are one document
    and one of them stays, different texts of one id are documents each.
    Documents without words link with nothing and stay; a null id is last.
    """
    own = F.xxhash64("doc_id", "text")
    rows = docs.select(own.alias("own"), "doc_id", "text")
    linked = ngram_jaccard_join(rows.select(F.col("own").alias("doc_id"), "text")).select(F.col("doc_id").alias("own"), "component_id").distinct()
    ids = rows.select("own", F.col("doc_id").isNull().alias("last"), "doc_id").distinct()
    first = linked.join(ids, "own").groupBy("component_id").agg(F.min(F.struct("last", "doc_id", "own")).alias("first")).select("first.own")
    names = [f"c{i}" for i in range(len(docs.columns))]
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns], own).toDF(*names, "own").join(first, "own", "left_semi").dropDuplicates(["own"])
    return kept.select(*names).toDF(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are masked."""
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to source weights takes them."""
    return apply_mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids, their number and the text decoded from them."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = decode(encode(docs.select("doc_id", "source", "text"), path, public_tokenizers.PATTERN), path)
    return out.select("doc_id", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), F.col("decoded").cast("string").alias("text"))


STAGES = [("quality", quality), ("near copies", near_copies), ("secrets", secrets), ("mixing", mixing), ("tokens", tokens)]
#: Rounding is random and tokens need the merge rules: tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.save(docs, name.replace(" ", "-"))
    return docs
