"""Stateful streams: online assignment of items to open events (STR04) and bounded log tails (STR01).

Both hold their state in RocksDB, so it may outgrow an executor's memory and
is taken up again after a restart.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

#: Events of one block of state.
BLOCK_EVENTS = 256
#: Seconds between the times at which events can leave.
TICK = 60
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside hold their state in RocksDB."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.sqrt((v * v).sum())
    return v / n if n else v


class _Open:
    """The open events of a bucket, block by block, as one matrix while a batch is assigned."""

    def __init__(self, blocks: dict[int, tuple], room: int, width: int):
        rows = [(b, slot) for b, (ids, *_) in sorted(blocks.items()) for slot in range(len(ids))]
        self.at_block = rows
        n, room = len(rows), len(rows) + room
        self.n = n
        self.ids: list[str] = [blocks[b][0][s] for b, s in rows]
        self.times, self.size = np.full(room, -np.inf), np.zeros(room, int)
        self.rows = np.zeros((room, max([width, *(len(blocks[b][2][s]) // 8 for b, s in rows)])))
        for i, (b, s) in enumerate(rows):
            v = np.frombuffer(blocks[b][2][s], float)
            self.rows[i, : len(v)], self.size[i], self.times[i] = v, len(v), blocks[b][1][s]

    def nearest(self, v: np.ndarray, now: float, reach: float) -> tuple[int, float]:
        """The most similar event in reach, the oldest of equals; -1 if there is none."""
        n = self.n
        score = np.where((self.size[:n] == len(v)) & (np.abs(self.times[:n] - now) <= reach), self.rows[:n, : len(v)] @ v, -2.0)
        best = int(score.argmax()) if n else -1
        return (best, float(score[best])) if best >= 0 and score[best] > -2.0 else (-1, -2.0)

    def open(self, name: str, v: np.ndarray, now: float) -> None:
        i = self.n
        self.rows[i, : len(v)], self.size[i], self.times[i] = v, len(v), now
        self.ids.append(name)
        self.n += 1


class AssignOnline(StatefulProcessor):
    """The nearest open event in reach and similar enough takes an item, else the item opens an event.

    Events stand in blocks of ``BLOCK_EVENTS``; a batch rewrites the blocks
    that it changes.  Every event has a timer at its last item's time plus the
    horizon: when the watermark passes it, no item can reach the event any
    more and it leaves.  There is no bound on the number of open events.
    """

    def __init__(self, threshold: float, hours: int):
        self.threshold, self.reach = threshold, hours * 3600.0

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.blocks = handle.getMapState("blocks", "block int", "ids array<string>, at array<double>, vectors array<binary>")
        # blocks of which an event is due at a timer's time
        self.due = handle.getMapState("due", "ms long", "blocks array<int>")
        self.last = handle.getValueState("last", "block int")

    def _timer(self, second: float) -> int:
        return (int((second + self.reach) // TICK) + 1) * TICK * 1000

    def _note(self, ms: int, block: int) -> None:
        known = self.due.getValue((ms,)) if self.due.containsKey((ms,)) else None
        blocks = set(known[0]) if known else set()
        if not known:
            self.handle.registerTimer(ms)
        if block not in blocks:
            self.due.updateValue((ms,), (sorted(blocks | {block}),))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True).sort_values(["at", "item_id"], kind="stable")
        asked = [_unit(np.asarray([] if v is None else v, float)) for v in frame["vector"]]
        blocks = {k[0]: v for k, v in self.blocks.iterator()} if self.blocks.exists() else {}
        held = _Open(blocks, len(frame), max(map(len, asked), default=0))
        old, out = held.n, []
        changed: set[int] = set()
        for item, now, v in zip(frame["item_id"], frame["at"].map(lambda t: t.timestamp()), asked, strict=True):
            best, score = held.nearest(v, now, self.reach)
            if best >= 0 and score >= self.threshold:
                if now > held.times[best]:
                    held.times[best] = now
                    changed.add(best)
                out.append((item, held.ids[best], "assign"))
            else:
                changed.add(held.n)
                held.open(f"evt_{item}", v, now)
                out.append((item, held.ids[-1], "create"))
        # old events keep their block; new ones fill the last block, then others
        last = self.last.get()[0] if self.last.exists() else 0
        filled = len(blocks[last][0]) if last in blocks else 0
        place = list(held.at_block)
        for _ in range(old, held.n):
            if filled == BLOCK_EVENTS:
                last, filled = last + 1, 0
            place.append((last, filled))
            filled += 1
        members: dict[int, list[int]] = {}
        for i, (b, _) in enumerate(place):
            members.setdefault(b, []).append(i)
        for b in sorted({place[i][0] for i in changed}):
            own = members[b]
            self.blocks.updateValue((b,), ([held.ids[i] for i in own], [float(held.times[i]) for i in own], [held.rows[i, : held.size[i]].tobytes() for i in own]))
        for ms, b in sorted({(self._timer(held.times[i]), place[i][0]) for i in changed}):
            self._note(ms, b)
        if held.n > old:
            self.last.update((last,))
        yield pd.DataFrame(out, columns=["item_id", "event_id", "decision"])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        ms = expiredTimerInfo.getExpiryTimeInMs()
        for b in self.due.getValue((ms,))[0] if self.due.containsKey((ms,)) else []:
            if not self.blocks.containsKey((b,)):
                continue
            ids, at, vectors = self.blocks.getValue((b,))
            live = [i for i, t in enumerate(at) if self._timer(t) > ms]  # one that an item has reached since then has a later timer
            if not live:
                self.blocks.removeKey((b,))
            elif len(live) < len(ids):
                self.blocks.updateValue((b,), ([ids[i] for i in live], [at[i] for i in live], [vectors[i] for i in live]))
        self.due.removeKey((ms,))
        return iter([])

    def close(self) -> None:
        pass


def assign_online(items: DataFrame, threshold: float = 0.8, hours: int = 72, late: str | None = None) -> DataFrame:
    """STR04: item_id, event_id, decision of items (item_id, at, bucket, vector) as they come.

    Items meet the open events of their similarity bucket within ``hours``;
    an event stands where its first item's vector points and is as old as its
    newest item.  Items of a batch are taken by time and id, batches as they
    come; items later than ``late`` (default: the horizon) behind the newest
    one are dropped by the watermark.  A null vector is similar to nothing.
    Start the stream inside ``rocksdb``.
    """
    timed = items.select("item_id", "at", "bucket", "vector").withWatermark("at", late or f"{hours} hours")
    return timed.groupBy("bucket").transformWithStateInPandas(AssignOnline(threshold, hours), "item_id string, event_id string, decision string", "append", "eventTime")


class Tail(StatefulProcessor):
    """The last entries of a run by event time, however late they come."""

    def __init__(self, entries: int, days: int):
        self.entries, self.ms = entries, days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ring = handle.getListState("ring", "us long, seq long, type string")
        self.due = handle.getValueState("due", "ms long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        kept = [tuple(x) for x in self.ring.get()] if self.ring.exists() else []
        for frame in rows:
            kept += list(zip(frame["us"].astype(int).tolist(), frame["seq"].astype(int).tolist(), frame["type"].tolist(), strict=True))
            kept = sorted(kept, key=lambda r: r[:2])[-self.entries :]
        self.ring.put(kept)
        due = kept[-1][0] // 1000 + self.ms
        old = self.due.get()[0] if self.due.exists() else None
        if due != old:
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(due)
            self.due.update((due,))
        yield pd.DataFrame([(key[0], i, *r) for i, r in enumerate(kept)], columns=["run_id", "pos", "us", "seq", "type"])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.ring.clear()
        self.due.clear()
        return iter([])

    def close(self) -> None:
        pass


def log_tails(log: DataFrame, entries: int = 5000, days: int = 30) -> DataFrame:
    """STR01: for each run that a batch touches, its last ``entries`` rows (run_id, pos, us, seq, type).

    ``log``: run_id, ts, seq (breaks ties of time), type.  The buffer of a run
    is that long at most and goes when the log is ``days`` beyond its last
    entry; rows later than that are dropped.  Start the stream inside
    ``rocksdb``.
    """
    rows = log.select("run_id", "ts", F.unix_micros("ts").alias("us"), F.col("seq").cast("long").alias("seq"), "type").withWatermark("ts", f"{days} days")
    kind = rows.schema["run_id"].dataType.simpleString()
    return rows.groupBy("run_id").transformWithStateInPandas(Tail(entries, days), f"run_id {kind}, pos int, us long, seq long, type string", "update", "eventTime")
