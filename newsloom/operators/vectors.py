"""Similarity recall, requests and caches: JN02-JN04, JN07, SO02, EM03, SNK06, SNK07, UD02."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.sources import workdir

#: Events and queries of one block of the recall.
EVENT_BLOCK, QUERY_BLOCK = 2000, 500
#: Pivots of a scope at most, salts of a hot key, and tasks (groups of cells) that its cells are dealt to, so that often is a query sent at most.
MOST_PIVOTS, SPREAD, COPIES = 1024, 64, 24


def _matrix(vectors: list | pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors padded to one width, their lengths and their norms."""
    if isinstance(vectors, pa.Array):
        size = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = vectors.flatten().to_numpy(zero_copy_only=False)
    else:
        size = np.fromiter((len(v) if v is not None else 0 for v in vectors), np.int64, len(vectors))
        flat = np.concatenate([np.asarray(v, float) for v in vectors if v is not None and len(v)]) if size.sum() else np.zeros(0)
    out = np.zeros((len(size), max(size.max(initial=0), 1)))
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out, size, np.sqrt((out * out).sum(axis=1))


def _similarity(dots: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, norm_a: np.ndarray, norm_b: np.ndarray) -> np.ndarray:
    """Cosines from dot products; 0 for empty or unequal lengths or a zero norm."""
    norm = norm_a * norm_b
    fine = (size_a == size_b) & (size_a > 0) & (norm > 0) & np.isfinite(norm)
    return np.divide(dots, norm, out=np.zeros_like(dots), where=fine)


@F.pandas_udf(T.DoubleType())
def cosine_batches(a: pd.Series, b: pd.Series) -> pd.Series:
    """UD02: cosine similarity of two vector columns; 0 for empty or unequal lengths or a zero norm."""
    (x, nx, lx), (y, ny, ly) = _matrix(a.tolist()), _matrix(b.tolist())
    width = min(x.shape[1], y.shape[1])
    return pd.Series(_similarity(np.einsum("ij,ij->i", x[:, :width], y[:, :width]), nx, ny, lx, ly))


def _blocks(df: DataFrame, key: list[str], name: str, most: int) -> DataFrame:
    """Rows of a key packed in arrays of about ``most``, with the array's number ``part``.

    The number of parts is joined on key and salt, so no task gets all rows of a hot key.
    """
    rows = [c for c in df.columns if c not in key]
    salted = df.withColumn("salt", F.pmod(F.xxhash64(rows[0]), F.lit(SPREAD)).cast("int"))
    each = salted.groupBy(*key, "salt").agg(F.count(F.lit(1)).alias("n"))
    parts = each.groupBy(*key).agg(F.ceil(F.sum("n") / most).alias("parts"), F.collect_list("salt").alias("salts")).withColumn("salt", F.explode("salts")).drop("salts")
    dealt = salted.join(parts, [*key, "salt"]).withColumn("part", F.pmod(F.xxhash64(F.lit(1), rows[0]), "parts"))
    return dealt.groupBy(*key, "part").agg(F.collect_list(F.struct(*rows)).alias(name))


def _best(score: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of the ``k`` best of each row above minus infinity, ties to the smaller ``order``."""
    rank = np.argsort(order, kind="stable")
    score = score[:, rank]
    k = min(k, score.shape[1])
    least = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
    row, column = np.nonzero((score >= least[:, None]) & (score > -np.inf))
    value = score[row, column]
    by = np.lexsort((column, -value, row))
    row, column, value = row[by], column[by], value[by]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[kept], rank[column[kept]], value[kept]


def _nearest(q: DataFrame, e: DataFrame, key: list[str], k: int, hours: int) -> DataFrame:
    """The ``k`` most similar events of each query within each cell of blocks of equal key.

    The event blocks of a key are dealt to ``COPIES`` tasks at most, each of
    which gets the key's queries once.  Where events carry a ``pivot``, a block
    holds one pivot's events and meets the queries that have it in ``wanted``;
    pairs worse than a query's ``best``, if it has one, are left out.
    """
    celled = "pivot" in e.columns
    tasks = int(e.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    qs = _blocks(q, key, "qs", QUERY_BLOCK).drop("part")
    es = _blocks(e, [*key, "pivot"] if celled else key, "es", EVENT_BLOCK)
    if celled:
        qs, es = (df.withColumn("salt", F.lit(0)) for df in (qs, es))
    else:
        salts = e.groupBy(*key).agg(F.least(F.ceil(F.count(F.lit(1)) / EVENT_BLOCK), F.lit(COPIES)).cast("int").alias("salts"))
        qs = qs.join(salts, key).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        es = es.withColumns({"salt": (F.col("part") % COPIES).cast("int"), "pivot": F.lit(0)})
    # a cell costs far more than its bytes show: a stated number of tasks is not coalesced
    met = [df.repartition(tasks, *key, "salt") for df in (qs, es)]
    cells = met[0].join(met[1], [*key, "salt"]).select("scope", "qs", "es", "pivot")
    types = {c: t for df in (q, e) for c, t in df.dtypes}
    columns = ["scope", "query_id", "event_id", "ordinal", "similarity"]
    reach = hours * 3_600_000_000
    bounded = "best" in q.columns

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in range(batch.num_rows):
                qs, es = batch.column(1)[cell].values, batch.column(2)[cell].values
                if celled:
                    wanted = qs.field("wanted")
                    asker = np.repeat(np.arange(len(qs)), wanted.value_lengths().to_numpy(zero_copy_only=False))
                    asker = asker[wanted.flatten().to_numpy(zero_copy_only=False) == batch.column(3)[cell].as_py()]
                    if not len(asker):
                        continue
                    qs = qs.take(pa.array(asker))
                x, nx, lx = _matrix(qs.field("q_vector"))
                y, ny, ly = _matrix(es.field("e_vector"))
                width = min(x.shape[1], y.shape[1])
                score = _similarity(x[:, :width] @ y[:, :width].T, nx[:, None], ny, lx[:, None], ly)
                at = [side.to_numpy(zero_copy_only=False).astype(float) for side in (qs.field("q_at").cast(pa.float64(), safe=False), es.field("e_at").cast(pa.float64(), safe=False))]
                with np.errstate(invalid="ignore"):
                    out = np.abs(at[0][:, None] - at[1]) > reach  # a missing time is in reach of all
                names, _ = pd.factorize(np.array(qs.field("exclude_id").to_pylist() + [str(i) for i in es.field("event_id").to_pylist()], object))
                out |= names[: len(qs), None] == names[len(qs) :]
                out |= np.isnan(score)
                if bounded:
                    best = qs.field("best").fill_null(-np.inf).to_numpy(zero_copy_only=False)
                    out |= score < best[:, None] - 1e-12
                score[out] = -np.inf
                row, hit, value = _best(score, es.field("ordinal").to_numpy(zero_copy_only=False), k)
                scope = pa.array([batch.column(0)[cell].as_py()] * len(row), batch.schema.field(0).type)
                yield pa.RecordBatch.from_arrays([scope, qs.field("query_id").take(pa.array(row)), es.field("event_id").take(pa.array(hit)), es.field("ordinal").take(pa.array(hit)), pa.array(value)], columns)

    return cells.mapInArrow(search, ", ".join(f"{c} {types.get(c, 'double')}" for c in columns))


def recall(queries: DataFrame, events: DataFrame, k: int = 5, hours: int = 72) -> DataFrame:
    """JN03/JN04/SO02: the k most similar events of each query within so many hours.

    ``queries``: query_id, at (instant), vector, optional exclude_id and
    scope; ``events``: event_id, at, vector, ordinal and scope.  ``scope`` is
    the run (or day) that both belong to.  Times in reach share a bucket or are
    in adjacent ones: the vectors of a bucket meet in cells of two blocks of
    bounded size, one matrix product and a top k for each, so no pair leaves
    its cell beyond the top k.  An event or query without a time is in reach of
    everything in its scope; those pairs go through ``nearest_anytime``.
    Ties go to the smaller ordinal.
    """
    q, e = _sides(queries, events)
    bucket = lambda c: F.floor(F.col(c) / (hours * 3_600_000_000))
    timed = q.where("q_at is not null").withColumn("bucket", F.explode(F.array(*[bucket("q_at") + d for d in (-1, 0, 1)])))
    near = _nearest(timed, e.where("e_at is not null").withColumn("bucket", bucket("e_at")), ["scope", "bucket"], k, hours)
    # queries without a time meet all events of their scope, the others the undated ones
    loose = e.join(q.where("q_at is null").select("scope").distinct(), "scope", "left_semi")
    sided = q.withColumn("dated", F.col("q_at").isNotNull())
    found = e.where("e_at is null").withColumn("dated", F.lit(True)).unionByName(loose.withColumn("dated", F.lit(False)))
    return _ranked(near.unionByName(_anytime(sided, found, ["scope", "dated"], k, EVENT_BLOCK)), k)


def nearest_anytime(queries: DataFrame, events: DataFrame, k: int = 5, cell: int = EVENT_BLOCK) -> DataFrame:
    """The k most similar events of each query in its scope whatever the times, exactly.

    Columns, scope and ties as for ``recall``.  Events of a scope are dealt to
    the nearest of some pivots (one for every ``cell`` events, up to
    ``MOST_PIVOTS``; the events whose hash is smallest), so a scope is as many
    keys as it has cells and no task holds it.  A query first meets the
    nearest cells that hold more than k events; its k-th best so far goes
    along to the rest.  Angles obey the triangle inequality: a cell whose
    angles to its pivot lie in lo..hi has nothing nearer than ``angle - hi`` and
    ``lo - angle`` for a query at ``angle`` from that pivot, and is skipped if
    that is worse than the k-th best.  Vectors that are null, empty, zero or
    hold null or non-finite components, and pairs of unequal lengths, have
    similarity 0 and stand by their ordinals alone.
    """
    q, e = _sides(queries, events)
    return _ranked(_anytime(q, e, ["scope"], k, cell), k)


def _sides(queries: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    q, e = (df if "scope" in df.columns else df.withColumn("scope", F.lit(0)) for df in (queries, events))
    if "exclude_id" not in q.columns:
        q = q.withColumn("exclude_id", F.lit(None).cast("string"))
    vector = lambda c: F.col(c).cast("array<double>")
    q = q.select("scope", "query_id", F.unix_micros("at").alias("q_at"), vector("vector").alias("q_vector"), F.col("exclude_id").cast("string").alias("exclude_id"))
    return q, e.select("scope", "event_id", "ordinal", F.unix_micros("at").alias("e_at"), vector("vector").alias("e_vector"))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("scope", "query_id").orderBy(F.desc("similarity"), "ordinal")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _kind(vector: str) -> Column:
    """The length of a vector that can be compared, else 0."""
    squares = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x)
    return F.when((squares > 0) & (squares < float("inf")), F.size(vector)).otherwise(0)


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    unit = lambda v: v / np.sqrt((v * v).sum(axis=1))[:, None]
    return np.arccos(np.clip(unit(x) @ unit(pivots).T, -1.0, 1.0))


def _anytime(q: DataFrame, e: DataFrame, scope: list[str], k: int, cell: int) -> DataFrame:
    """The pairs that ``nearest_anytime`` ranks; ``scope``: the columns of a scope."""
    key = [*scope, "kind"]
    q, e = (df.withColumn(at, F.lit(None).cast("long")).withColumn("kind", _kind(v)) for df, at, v in ((q, "q_at", "q_vector"), (e, "e_at", "e_vector")))
    live = e.where("kind > 0")
    able = q.where("kind > 0").select("query_id", *[c for c in q.columns if c != "query_id"])
    if live.groupBy(*key).count().where(F.col("count") > cell).isEmpty():  # one block a scope: nothing to skip
        near = _nearest(able, live, key, k, 0)
    else:
        near = _by_pivots(able, live, key, k, cell)
    # similarity 0 whatever the vectors: of each kind so many by ordinal that k are left without any one event
    one = Window.partitionBy(*key, "event_id").orderBy("ordinal")
    front = e.withColumn("nth", F.row_number().over(one)).where(F.col("nth") <= k).withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy("ordinal"))).where(F.col("nth") <= 2 * k)
    front = front.select(*scope, F.col("kind").alias("e_kind"), "event_id", "ordinal")
    unlike = (F.col("kind") != F.col("e_kind")) | (F.col("kind") == 0)
    flat = q.join(front, scope).where(unlike & (F.col("exclude_id").isNull() | (F.col("exclude_id") != F.col("event_id").cast("string"))))
    flat = flat.select("scope", "query_id", "event_id", "ordinal", F.lit(0.0).alias("similarity"))
    return near.unionByName(flat)


def _by_pivots(q: DataFrame, e: DataFrame, key: list[str], k: int, cell: int) -> DataFrame:
    """Pairs that hold the ``k`` nearest of each query, from cells around pivots; all vectors of a key can be compared."""
    # every part of a hot scope meets the scope's pivots under a salt of its own
    salts = F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)))
    sizes = e.groupBy(*key).agg(F.least(F.ceil(F.count(F.lit(1)) / cell), F.lit(MOST_PIVOTS)).alias("n"))
    by_hash = Window.partitionBy(*key).orderBy(F.xxhash64("event_id", "ordinal"), "event_id", "ordinal")
    first = e.withColumn("nth", F.row_number().over(by_hash)).where(F.col("nth") <= MOST_PIVOTS).join(sizes, key).where("nth <= n")
    pivots = workdir.written(first.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "e_vector"))), lambda x: x["e_vector"]).alias("pivots")), "pivots")
    types = dict(e.dtypes) | dict(q.dtypes)
    fields = lambda columns: ", ".join(f"{c} {types.get(c) or {'pivot': 'int', 'angle': 'double', 'best': 'double', 'wanted': 'array<int>', 'group': 'int'}[c]}" for c in columns)
    salted = lambda df, name, most: _blocks(df, key, name, most).withColumn("salt", (F.col("part") % SPREAD).cast("int"))

    own = [c for c in e.columns if c not in key]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = batch.column("es")[i].values
                angle = _angles(_matrix(rows.field("e_vector"))[0], _matrix(batch.column("pivots")[i].as_py())[0])
                home = angle.argmin(axis=1)
                head = [pa.array([batch.column(c)[i].as_py()] * len(home), batch.schema.field(c).type) for c in key]
                yield pa.RecordBatch.from_arrays([*head, *(rows.field(c) for c in own), pa.array(home, pa.int32()), pa.array(angle[np.arange(len(home)), home])], [*key, *own, "pivot", "angle"])

    blocks = salted(e, "es", EVENT_BLOCK).join(pivots.withColumn("salt", salts), [*key, "salt"]).select(*key, "es", "pivots")
    dealt = workdir.written(blocks.mapInArrow(deal, fields([*key, *own, "pivot", "angle"])), "pivot-cells")
    cells = dealt.groupBy(*key, "pivot").agg(F.min("angle").alias("lo"), F.max("angle").alias("hi"), F.count(F.lit(1)).alias("n"))
    shape = workdir.written(cells.groupBy(*key).agg(F.collect_list(F.struct("pivot", "lo", "hi", "n")).alias("cells")).join(pivots, key), "pivot-shape")

    asked = [c for c in q.columns if c not in key]

    def route(rest: bool):
        """Queries with the cells of their first search, or with those that may still hold a better event."""
        sent = [*asked, "best"] if rest else asked

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    rows, at = batch.column("qs")[i].values, batch.column("cells")[i].values
                    pivot, lo, hi, n = (at.field(c).to_numpy(zero_copy_only=False) for c in ("pivot", "lo", "hi", "n"))
                    angle = _angles(_matrix(rows.field("q_vector"))[0], _matrix(batch.column("pivots")[i].as_py())[0][pivot])
                    order = angle.argsort(axis=1, kind="stable")
                    before = np.cumsum(n[order], axis=1) - n[order]
                    taken = np.zeros(angle.shape, bool)
                    np.put_along_axis(taken, order, before <= k, axis=1)
                    if rest:
                        best = np.array([-np.inf if b is None else b for b in rows.field("best").to_pylist()], float)
                        gap = np.maximum(np.maximum(angle - hi, lo - angle) - 1e-6, 0.0)  # angles are right to 1e-7
                        taken = ~taken & (np.cos(gap) >= best[:, None] - 1e-12)
                    # a query goes once to each group of cells: what leaves is never more than a block
                    group = pivot % COPIES
                    for g in np.unique(group[taken.any(axis=0)]):
                        some = np.flatnonzero(group == g)
                        inside = taken[:, some]
                        chosen = np.flatnonzero(inside.any(axis=1))
                        row, column = np.nonzero(inside[chosen])
                        ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(chosen)))])
                        wanted = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(pivot[some[column]], pa.int32()))
                        head = [pa.array([batch.column(x)[i].as_py()] * len(chosen), batch.schema.field(x).type) for x in key]
                        yield pa.RecordBatch.from_arrays([*head, *(rows.field(x).take(pa.array(chosen)) for x in sent), wanted, pa.array(np.full(len(chosen), g), pa.int32())], [*key, *sent, "wanted", "group"])

        return run

    def search(queries: DataFrame, rest: bool) -> DataFrame:
        met = salted(queries, "qs", QUERY_BLOCK).join(shape.withColumn("salt", salts), [*key, "salt"]).select(*key, "qs", "cells", "pivots")
        sent = met.mapInArrow(route(rest), fields([*key, *asked, *(["best"] if rest else []), "wanted", "group"]))
        return _nearest(sent, dealt.drop("angle").withColumn("group", (F.col("pivot") % COPIES).cast("int")), [*key, "group"], k, 0)

    near = workdir.written(search(q, False), "pivot-first")
    best = near.groupBy("scope", "query_id").agg(F.sort_array(F.collect_list("similarity"), False).alias("s")).select("scope", "query_id", F.get("s", F.lit(k - 1)).alias("best"))
    far = search(q.join(best, ["scope", "query_id"], "left").select("query_id", *[c for c in q.columns if c != "query_id"], "best"), True)
    return near.unionByName(far)


def without_pairs(found: DataFrame, skip: DataFrame) -> DataFrame:
    """JN04: recalled pairs that are not in the skip set (query_id, event_id)."""
    return found.join(skip, ["query_id", "event_id"], "left_anti")


def coarse_bucket(vector: Column, bits: int = 8, dimensions: int = 64, seed: int = 7) -> Column:
    """Sign bits against fixed random directions: near vectors mostly share the bucket."""
    planes = np.random.default_rng(seed).normal(size=(bits, dimensions)).round(4)
    out = F.lit(0)
    for b in range(bits):
        direction = F.array(*[F.lit(float(x)) for x in planes[b]])
        dot = F.aggregate(F.zip_with(vector, direction, lambda x, y: F.coalesce(x.cast("double") * y, F.lit(0.0))), F.lit(0.0), lambda s, v: s + v)
        out = out + F.when(dot >= 0, 1 << b).otherwise(0)
    return out


def cache_lookup(work: DataFrame, cache: DataFrame, key: str = "cache_key") -> tuple[DataFrame, DataFrame]:
    """JN07/EM03: (rows with their cached value, rows still to do)."""
    return work.join(cache, key), work.join(cache.select(key), key, "left_anti")


def upsert(cache: DataFrame, new: DataFrame, key: str = "cache_key", at: str = "created_at") -> DataFrame:
    """SNK06/SNK07/WN08: one row for each key, the new one before the old, the latest of either."""
    both = cache.withColumn("fresh", F.lit(0)).unionByName(new.withColumn("fresh", F.lit(1)), allowMissingColumns=True)
    order = Window.partitionBy(key).orderBy(F.desc("fresh"), F.desc(at))
    return both.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth", "fresh")


def batches(rows: DataFrame, groups: DataFrame, payload: list[str], by: list[str] | None = None) -> DataFrame:
    """EM02/EM04/EM06: one JSON request for each group, its rows in group order."""
    by = by or ["run_id"]
    joined = groups.join(rows.withColumn("key", F.col("key").cast("string")), [*by, "key"])
    one = F.struct("position", F.struct(*payload).alias("row"))
    return joined.groupBy(*by, "group_index").agg(F.to_json(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["row"]), {"ignoreNullFields": "false"}).alias("request"), F.count(F.lit(1)).alias("size"))


def pending(requests: DataFrame, responses: DataFrame, key: list[str]) -> DataFrame:
    """Requests without a landed response."""
    return requests.join(responses.select(*key), key, "left_anti")
