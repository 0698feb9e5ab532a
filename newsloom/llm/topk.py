"""Exact top-k by inner product: columnar branch and bound.

Vectors become integers, floor(scale * x).  Queries and candidates are packed
in blocks, candidates dimension by dimension (vertical layout).  Each pair of
blocks is a cell; in it a query takes its dimensions in falling order of
weight, some at a time, adding to the partial products of the surviving
candidates.  What the remaining dimensions can add is bounded by the remaining
masses of query and candidate (Cauchy-Schwarz); candidates whose upper bound
is below the k-th best lower bound leave, and the survivors are compacted.
Ties stay until the end, where the smaller id wins.

Vectors that are null, hold a null or a non-finite component, or have a null
id take no part.  Vectors of different lengths are padded with zeros.  A
query's own id is no candidate, repeated rows of other ids are candidates
each.  Query rows that are equal ask once; an id with several different
vectors asks once for each of them.  Cells are a grid of blocks: each block of candidates meets each block
of queries once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CANDIDATES, QUERIES, STEP = 8192, 1024, 8


def top_of(query: np.ndarray, own: int, ids: np.ndarray, columns: np.ndarray, mass: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of a query's k best in a block (columns: dimension by candidate)."""
    alive = np.flatnonzero(ids != own)
    acc, left = np.zeros(len(alive), columns.dtype), mass[alive].copy()
    rest = float((query.astype(float) ** 2).sum())
    order = np.argsort(-np.abs(query), kind="stable")
    for a in range(0, len(order), STEP):
        dims = order[a : a + STEP]
        part = columns[np.ix_(dims, alive)]
        acc = acc + query[dims] @ part
        if a + STEP >= len(order) or len(alive) <= k:
            continue
        left = left - (part.astype(float) ** 2).sum(axis=0)
        rest -= float((query[dims].astype(float) ** 2).sum())
        slack = np.sqrt(np.maximum(left, 0) * max(rest, 0)) * (1 + 1e-9) + 1
        bar = np.partition(acc - slack, len(acc) - k)[len(acc) - k]
        keep = acc + slack >= bar
        if keep.sum() < 0.75 * len(keep):
            alive, acc, left = alive[keep], acc[keep], left[keep]
    best = np.lexsort((ids[alive], -acc))[:k]
    return ids[alive[best]], acc[best].astype(np.int64)


def top_of_all(asked: np.ndarray, own: np.ndarray, ids: np.ndarray, columns: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """``top_of`` for many queries (rows of ``asked``), in doubles that hold all sums exactly.

    The dimensions are taken in falling order of the block's mass.  While most
    candidates survive, one matrix product serves a batch of queries; a query
    whose survivors are a quarter of the block leaves with them compacted.
    """
    order = np.argsort(-(columns**2).sum(axis=1), kind="stable")
    columns, asked = np.ascontiguousarray(columns[order]), np.ascontiguousarray(asked[:, order])
    dims, n = columns.shape
    starts = list(range(0, dims, 2 * STEP))
    cut = [slice(a, min(a + 2 * STEP, dims)) for a in starts]
    # the roots of what is left after each step
    left_c = [np.sqrt((columns[c.stop :] ** 2).sum(axis=0)) for c in cut]
    left_q = [np.sqrt((asked[:, c.stop :] ** 2).sum(axis=1)) for c in cut]
    found: list[tuple[np.ndarray, np.ndarray]] = [None] * len(asked)  # type: ignore[list-item]

    def alive(acc: np.ndarray, slack: np.ndarray) -> np.ndarray:
        low = acc - slack
        return np.flatnonzero(acc + slack >= np.partition(low, len(low) - k)[len(low) - k])

    def best(q: int, acc: np.ndarray, at: np.ndarray) -> None:
        keep = np.flatnonzero(acc > -np.inf)
        if len(keep) > k:
            keep = keep[acc[keep] >= np.partition(acc[keep], len(keep) - k)[len(keep) - k]]
        keep = keep[np.lexsort((ids[at[keep]], -acc[keep]))[:k]]
        found[q] = ids[at[keep]], acc[keep].astype(np.int64)

    for first in range(0, len(asked), 64):
        open_ = np.arange(first, min(first + 64, len(asked)))
        sums = np.zeros((len(open_), n))
        for row, q in enumerate(open_):
            sums[row, ids == own[q]] = -np.inf
        for s, c in enumerate(cut):
            sums += asked[open_, c] @ columns[c]
            if s == len(cut) - 1 or n <= k:
                continue
            stays = []
            for row, q in enumerate(open_):
                at = alive(sums[row], left_q[s][q] * left_c[s] * (1 + 1e-9) + 1)
                if len(at) > n // 4:
                    stays.append(row)
                    continue
                acc = sums[row, at]
                for t in range(s + 1, len(cut)):
                    acc = acc + asked[q, cut[t]] @ columns[cut[t]][:, at]
                    if t < len(cut) - 1 and len(at) > k:
                        keep = alive(acc, left_q[t][q] * left_c[t][at] * (1 + 1e-9) + 1)
                        at, acc = at[keep], acc[keep]
                best(q, acc, at)
            open_, sums = open_[stays], sums[stays]
            if not len(open_):
                break
        for row, q in enumerate(open_):
            best(q, sums[row], np.arange(n))
    return found


def _packed(df: DataFrame, block: str, count: int) -> DataFrame:
    """One row for each block: number, ids, dimensions and dimension-major components."""

    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids = table.column("vec_id").to_numpy()
        lists = table.column("v").combine_chunks()
        size = lists.value_lengths().to_numpy(zero_copy_only=False)
        out = np.zeros((len(ids), max(size.max(), 1)), np.int64)
        row = np.repeat(np.arange(len(ids)), size)
        out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = lists.flatten().to_numpy()
        # a block travels once for each block of the other side: in the smallest type that holds it
        kind = next(t for t in ("i1", "i2", "i4", "i8") if np.iinfo(t).min <= out.min(initial=0) and out.max(initial=0) <= np.iinfo(t).max)
        return pa.table(
            {
                block: pa.array([key[0].as_py()], pa.int32()),
                "ids": [ids.astype(np.int64).tobytes()],
                "asks": [table.column("ask").to_numpy().astype(np.int64).tobytes()],
                "dims": pa.array([out.shape[1]], pa.int32()),
                "kind": [kind],
                "data": [out.T.astype(kind).tobytes()],
            }
        )

    dealt = df.withColumn(block, F.pmod(F.xxhash64(F.lit(block), "vec_id"), F.lit(count)).cast("int"))
    return dealt.groupBy(block).applyInArrow(pack, f"{block} int, ids binary, asks binary, dims int, kind string, data binary")


def exact_top_k(vectors: DataFrame, k: int = 20, scale: int = 64, every: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of ``vectors`` whose vec_id ``every`` divides."""
    fine = F.forall("embedding", lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    rows = vectors.where("vec_id is not null and embedding is not null").where(fine)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * float(scale)).cast("long")).alias("v"))
    rows = rows.withColumn("ask", F.xxhash64("v"))
    queries = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "ask"])
    # counts only fix the number of blocks
    n, q = rows.agg(F.count(F.lit(1)), F.count_if(F.col("vec_id") % every == 0)).first()
    n_blocks, q_blocks = max(1, -(-n // CANDIDATES)), max(1, -(-q // QUERIES))
    left = _packed(rows, "cb", n_blocks).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    right = _packed(queries, "qb", q_blocks).toDF("qb", "q_ids", "q_asks", "q_dims", "q_kind", "q_data").withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.to_pylist():
                ids, own, asks = (np.frombuffer(cell[x], np.int64) for x in ("ids", "q_ids", "q_asks"))
                columns = np.frombuffer(cell["data"], cell["kind"]).reshape(cell["dims"], len(ids)).astype(np.int64)
                asked = np.frombuffer(cell["q_data"], cell["q_kind"]).reshape(cell["q_dims"], len(own)).T.astype(np.int64)
                dims = min(columns.shape[0], asked.shape[1])
                columns, asked = columns[:dims], asked[:, :dims]
                most = float(np.abs(columns).max(initial=0)) * float(np.abs(asked).max(initial=0)) * dims
                if most < 2**52 and dims:  # products and sums are exact in doubles
                    got = top_of_all(asked.astype(float), own, ids, columns.astype(float), k)
                else:
                    mass = (columns.astype(float) ** 2).sum(axis=0)
                    got = [top_of(asked[i], own[i], ids, columns, mass, k) for i in range(len(own))]
                each = [len(g[0]) for g in got]
                yield pa.record_batch([pa.array(np.repeat(own, each)), pa.array(np.repeat(asks, each)), pa.array(np.concatenate([g[0] for g in got])), pa.array(np.concatenate([g[1] for g in got]))], ["query_id", "ask", "vec_id", "score"])

    cells = left.join(right, ["qb", "cb"]).select("ids", "dims", "kind", "data", "q_ids", "q_asks", "q_dims", "q_kind", "q_data")
    found = cells.mapInArrow(search, "query_id long, ask long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id", "ask").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
