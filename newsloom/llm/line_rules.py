"""Quality rules with cross-document line frequency.

Every line of a text is normalised (A-Z to lower case, digits to 0, white
space runs to one blank, trimmed) and hashed.  For each host the distinct
documents that hold a line are counted; lines of any length held by more than
``max_docs`` documents of the host are above the limit.  A document that has
more than ``max_lost`` percent of its words in such lines is depleted.

The verdict tells boilerplate from copies.  Boilerplate stands in documents
that mostly have something else to say; a line of which at least ``copies``
percent of the holding documents are depleted is itself what these documents
say, so they are copies or near copies of one another.  Such lines stay (which
copy to keep is a question for near-duplicate removal); all other lines above
the limit are removed, and documents depleted by removed lines are rejected,
as are those that fail the base rules (fewer than 20 words, or over 30 % of
words in repeated 8-word windows).

A document is a pair of doc_id and text within its host, so repeated rows
count once and get equal results.  Nulls: a null text has no words and fails
the base rules; a null host is a host of its own; a null doc_id is an id like
any other.  Ties do not arise: all rules are counts.  Extra columns are
ignored by ``line_rules`` and kept by ``apply_line_rules``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.scratch import Scratch
from newsloom.llm.words import _WORD, chunks, shingles, slices, word_hashes

MAX_DOCS, MAX_LOST, COPIES = 100, 75, 90
#: A line may be in very many documents: joins with lines are dealt out by document too.
SALTS = 16
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LOWER_ZERO = bytes(ord("0") if 48 <= b <= 57 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def line_key(raw: bytes) -> tuple[int, int]:
    """Hash and word count of a line's normal form."""
    words = raw.translate(_LOWER_ZERO).split()
    return xxhash.xxh3_64_intdigest(b" ".join(words)) - 2**63, len(words)


def document_key(host: str) -> Column:
    """What the rows of one document share: hash of id, host and text."""
    return F.xxhash64("doc_id", F.col(host), "text")


def repeated_words(hashes: np.ndarray, k: int = 8) -> int:
    """Words inside k-word windows that occur twice or more, the first included."""
    runs = shingles(hashes, k)
    if len(runs) < 2:
        return 0
    order = np.argsort(runs, kind="stable")
    same = runs[order][1:] == runs[order][:-1]
    if not same.any():
        return 0
    hit = np.zeros(len(runs), bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    cover = np.zeros(len(hashes) + 1, np.int64)
    starts = np.flatnonzero(hit)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + k, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


PROFILE = "doc_id long, host long, key long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, line array<long>, line_words array<int>"


def profiles(docs: DataFrame, host: str) -> DataFrame:
    """Base figures of every row, and its distinct lines with their words in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            for a, b, data, offsets in chunks(batch.column(3).to_pylist()):
                buf = np.frombuffer(data, np.uint8)
                hashes, starts, _ = word_hashes(data)
                cut = np.searchsorted(starts, offsets)
                chars = np.r_[0, np.cumsum(_WORD[buf] & ((buf & 0xC0) != 0x80))]
                symbols = np.r_[0, np.cumsum(_SYMBOL[buf])]
                offsets = np.minimum(offsets, len(buf))
                rows: dict[str, list] = {x: [] for x in ("words", "dup", "repeat", "line", "count")}
                for i in range(b - a):
                    raw = data[offsets[i] : offsets[i + 1]]
                    if i < b - a - 1:
                        raw = raw[:-1]
                    own = [x for x in raw.split(b"\n") if x.split()]
                    lines: dict[int, int] = {}
                    for x in own:
                        h, n = line_key(x)
                        lines[h] = lines.get(h, 0) + n
                    rows["words"].append(int(cut[i + 1] - cut[i]))
                    rows["dup"].append(len(own) - len(set(own)))
                    rows["repeat"].append(repeated_words(hashes[cut[i] : cut[i + 1]]))
                    rows["line"].append(list(lines))
                    rows["count"].append(list(lines.values()))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(j).slice(a, b - a) for j in range(3)), pa.array(rows["words"], pa.int64()), pa.array(np.diff(chars[offsets])), pa.array(np.diff(symbols[offsets])),
                        pa.array(rows["dup"], pa.int64()), pa.array(rows["repeat"], pa.int64()), pa.array(rows["line"], pa.list_(pa.int64())), pa.array(rows["count"], pa.list_(pa.int32())),
                    ],
                    ["doc_id", "host", "key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line", "line_words"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col(host)).alias("host"), document_key(host).alias("key"), "text").mapInArrow(run, PROFILE)


def _dealt(lines: DataFrame, few: DataFrame, how: str = "inner") -> DataFrame:
    """``lines`` joined with ``few`` by host and line, both salted by document."""
    salted = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return lines.withColumn("salt", F.pmod("key", F.lit(SALTS)).cast("int")).join(salted, ["host", "line", "salt"], how).drop("salt")


def removed_lines(scratch: Scratch, every: DataFrame, max_docs: int, max_lost: int, copies: int) -> DataFrame:
    """(key, line, words): the lines that each document loses, once for each document."""
    lines = every.select("host", "key", "n_words", F.explode(F.arrays_zip("line", "line_words")).alias("x")).select("host", "key", "n_words", F.col("x.line").alias("line"), F.col("x.line_words").alias("words"))
    # partial counts go before the shuffle: a line held by a third of all documents is a few rows
    held_by = lines.groupBy("host", "line").agg(F.countDistinct("key").alias("docs")).where(F.col("docs") > max_docs)
    above = scratch.save(_dealt(lines, held_by).dropDuplicates(["host", "line", "key"]), "above")
    if above.isEmpty():
        return above.select("key", "line", "words")
    depleted = above.groupBy("key").agg(F.sum("words").alias("in_lines"), F.max("n_words").alias("n_words")).where(F.col("in_lines") * 100 > F.col("n_words") * max_lost).select("key")
    said = above.join(depleted, "key", "left_semi").groupBy("host", "line").agg(F.count(F.lit(1)).alias("depleted"), F.max("docs").alias("docs"))
    own = said.where(F.col("depleted") * 100 >= F.col("docs") * copies).select("host", "line")
    lost = _dealt(above, own, "left_anti")
    return scratch.save(lost.select("key", "line", "words"), "removed")


def _verdicts(scratch: Scratch, docs: DataFrame, host: str, max_docs: int, max_lost: int, copies: int) -> tuple[DataFrame, DataFrame]:
    """The verdict of each row, and the removed lines (key, line, words) of each document."""
    every = scratch.save(profiles(docs, host), "profiles")
    removed = removed_lines(scratch, every, max_docs, max_lost, copies)
    lost = removed.groupBy("key").agg(F.sum("words").alias("lost_words"))
    out = every.drop("line", "line_words").join(lost, "key", "left")
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    lost_words = F.coalesce("lost_words", F.lit(0)).cast("long")
    out = out.select("doc_id", "key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (lost_words * 100 <= F.col("n_words") * max_lost)).alias("kept"), lost_words.alias("lost_words"))
    return out, removed


def line_rules(docs: DataFrame, host: str = "source", max_docs: int = MAX_DOCS, max_lost: int = MAX_LOST, copies: int = COPIES) -> DataFrame:
    """Per row: doc_id, base figures, base_failed, kept and lost_words."""
    out, _ = _verdicts(Scratch(docs.sparkSession, "line-rules"), docs, host, max_docs, max_lost, copies)
    return out.drop("key")


def apply_line_rules(docs: DataFrame, host: str = "source", max_docs: int = MAX_DOCS, max_lost: int = MAX_LOST, copies: int = COPIES) -> DataFrame:
    """The kept rows of ``docs``, their columns unchanged but for the text without its removed lines.

    An ``n_chars`` column, if there, follows the text.  The rejected keys and
    the removed lines are joined to the rows by document, which no group of
    copies shares.
    """
    scratch = Scratch(docs.sparkSession, "line-rules")
    out, removed = _verdicts(scratch, docs, host, max_docs, max_lost, copies)
    gone = removed.groupBy("key").agg(F.collect_set("line").alias("gone"))
    decided = scratch.save(out.where("kept").select("key").distinct().join(gone, "key", "left"), "decided")
    columns, names = docs.columns, [f"c{i}" for i in range(len(docs.columns))]
    at = columns.index("text")
    plain = docs.select(*[F.col(f"`{c}`") for c in columns], document_key(host)).toDF(*names, "key")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            texts = batch.column(at).to_pylist()
            for i, gone in enumerate(batch.column(len(names)).to_pylist()):
                if gone and texts[i]:
                    drop = set(gone)
                    texts[i] = "\n".join(x for x in texts[i].split("\n") if not x.encode().split() or line_key(x.encode())[0] not in drop)
            made = list(batch.columns[:-1])
            made[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(made, names)

    joined = plain.join(decided, "key").drop("key")
    done = joined.mapInArrow(cut, ", ".join(f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, columns, strict=True))).toDF(*columns)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in columns else done
