"""Streams whose result depends on the order of arrival: groups given out when their key ends, greedy quotas over several
buckets, similarity to the last vectors, and scans that end themselves.

The order is kept within a scope (a shard, a split); scopes are independent, so a stream has as many tasks as it has scopes.
State lies in the state store and comes back after a restart. Of a micro-batch a task holds one scope's rows, which
maxFilesPerTrigger bounds; rows that come in a later micro-batch count as later, whatever their order column says.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sievery.operators.places import binned, numbered
from sievery.sources.tables import exists

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """A query started within keeps its state in RocksDB; the session's own setting comes back afterwards."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def ordered(batches: Iterator[pd.DataFrame], order: str) -> pd.DataFrame:
    return pd.concat(list(batches)).sort_values(order, kind="stable").reset_index(drop=True)


class KeyedFlush(StatefulProcessor):
    """Rows wait in a list until their scope's key changes, or until the watermark is `idle` past the group's last time."""

    def __init__(self, key: str, order: str, time: str, idle_ms: int, columns: list[str], schema: str, page: int = 10_000):
        self.key, self.order, self.time, self.idle_ms, self.columns, self.schema, self.page = key, order, time, idle_ms, columns, schema, page

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schema)
        self.group = handle.getValueState("group", "run long, key string, timer long")

    def given_out(self, run: int) -> Iterator[pd.DataFrame]:
        """The waiting rows, a page at a time."""
        page: list[tuple] = []
        nth = 0
        for row in self.waiting.get():
            nth += 1
            page.append((run, nth, *row))
            if len(page) == self.page:
                yield pd.DataFrame(page, columns=["run", "nth", *self.columns])
                page = []
        if page:
            yield pd.DataFrame(page, columns=["run", "nth", *self.columns])
        self.waiting.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        run, current, timer = self.group.get() if self.group.exists() else (0, None, -1)
        batch = ordered(rows, self.order)
        names = batch[self.key].map(lambda v: None if pd.isna(v) else str(v)).tolist()
        last = [k for k in range(len(names)) if k + 1 == len(names) or names[k + 1] != names[k]]
        start = 0
        for end in last:
            if run == 0 or names[end] != current:
                yield from self.given_out(run)
                run, current = run + 1, names[end]
            self.waiting.appendList([tuple(plain(v) for v in r) for r in batch.loc[start:end, self.columns].itertuples(index=False)])
            start = end + 1
        if self.idle_ms:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            timer = int(batch[self.time].max().timestamp() * 1000) + self.idle_ms
            self.handle.registerTimer(timer)
        self.group.update((run, current, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The group ends; a later row of its key begins another one."""
        run, _, _ = self.group.get()
        yield from self.given_out(run)
        self.group.update((run, "\0ended", -1))

    def close(self) -> None:
        pass


def plain(value: object) -> object:
    """A pandas value as the state store takes it."""
    if value is None or (not isinstance(value, (list, np.ndarray, dict)) and pd.isna(value)):
        return None
    if isinstance(value, pd.Timestamp):
        return value.to_pydatetime()
    return value.item() if isinstance(value, np.generic) else value


def keyed_groups(rows: DataFrame, scope: str, key: str, order: str, time: str, delay: str, idle_ms: int = 0) -> DataFrame:
    """rows with run (group of consecutive rows of one key within the scope, from 1) and nth, given out when the group ends.

    With idle_ms, a group also ends once the watermark (delay behind `time`) passes its last row by so much. Null keys are
    a key of their own; a group that nothing ends stays in the state. The scope's column comes from the rows."""
    columns = rows.columns
    schema = T.StructType([T.StructField("run", T.LongType()), T.StructField("nth", T.LongType()), *rows.schema.fields])
    timed = rows.withWatermark(time, delay)
    each = KeyedFlush(key, order, time, idle_ms, columns, rows.schema)
    return timed.groupBy(scope).transformWithStateInPandas(each, schema, "append", "eventTime")


class GreedyQuota(StatefulProcessor):
    """A row is taken if its id is not known and any of its buckets has room; it fills all of its buckets that have room."""

    def __init__(self, key: str, buckets: str, order: str, targets: dict[str, int], forget: float | None, columns: list[str]):
        self.key, self.buckets, self.order, self.targets, self.forget, self.columns = key, buckets, order, targets, forget, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.filled = handle.getMapState("filled", "bucket string", "n long")
        self.seen = handle.getListState("seen", "id string, at double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        filled = {b: n for (b,), (n,) in self.filled.iterator()}
        room = {b: n - filled.get(b, 0) for b, n in self.targets.items()}
        if not any(r > 0 for r in room.values()):
            return  # nothing is read of the rows once all buckets are full
        seen, far = dict(self.seen.get()), math.inf if self.forget is None else self.forget
        batch, taken, needs = ordered(rows, self.order), [], []
        places = batch[self.order].astype(float).tolist()
        for k, (item, names) in enumerate(zip(batch[self.key].astype(str).tolist(), batch[self.buckets].tolist(), strict=True)):
            needed = [b for b in dict.fromkeys(names if names is not None else []) if room.get(b, 0) > 0]
            if not needed or (item in seen and places[k] - seen[item] <= far):
                continue
            seen[item] = places[k]
            for b in needed:
                room[b] -= 1
            taken.append(k)
            needs.append(needed)
        if taken:  # the store is asked for everything at once: a call to it is slower than many rows
            held = [(item, at) for item, at in seen.items() if places[-1] - at <= far]
            self.seen.put(held) if held else self.seen.clear()
        for b, n in self.targets.items():
            if n - room[b] != filled.get(b, 0):
                self.filled.updateValue((b,), (n - room[b],))
        if taken:
            yield batch.loc[taken, self.columns].assign(needed=needs)

    def close(self) -> None:
        pass


def greedy_quota_stream(rows: DataFrame, scope: str, key: str, buckets: str, order: str, targets: dict[str, int], forget: float | None = None) -> DataFrame:
    """The rows taken within each scope, with needed, the buckets that they fill; sampling.greedy_quota() is the batch form.

    A scope's state is a number a bucket and the ids taken, at most the sum of the targets; with `forget`, an id may be taken
    again where the (numeric) order is more than so much beyond the row that took it. Rows without a bucket that has a target don't reach the shuffle."""
    some = rows.where(F.arrays_overlap(buckets, F.array(*map(F.lit, sorted(targets)))))
    schema = T.StructType([*rows.schema.fields, T.StructField("needed", T.ArrayType(T.StringType()))])
    each = GreedyQuota(key, buckets, order, targets, forget, rows.columns)
    return some.groupBy(scope).transformWithStateInPandas(each, schema, "append", "none")


class LastVectors(StatefulProcessor):
    """A ring of the last `size` unit vectors of each view; every row is compared with those before it."""

    def __init__(self, views: dict[str, float], size: int, order: str, columns: list[str]):
        self.views, self.size, self.order, self.columns = views, size, order, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getValueState("ring", "vectors binary, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = ordered(rows, self.order)
        now = [units(batch[v]) for v in self.views]
        held, n = self.ring.get() if self.ring.exists() else (b"", 0)
        count = min(n, self.size)
        width = sum(x.shape[1] for x in now)
        past = np.frombuffer(held, np.float32).reshape(-1, width)[:count] if held else np.zeros((0, width), np.float32)
        both, at = np.concatenate((past, np.concatenate(now, axis=1))), 0
        like = np.zeros((2, len(batch)), np.int64)
        for start in range(0, len(batch), 256):
            rows_at = np.arange(start, min(start + 256, len(batch)))
            low = max(0, count + start - self.size)
            window, at = both[low : count + rows_at[-1]], 0
            place = count + rows_at[:, None] - (low + np.arange(len(window)))[None, :]
            valid, any_view = (place > 0) & (place <= self.size), np.zeros((len(rows_at), len(window)), bool)
            for x, least in zip(now, self.views.values(), strict=True):
                any_view |= x[rows_at] @ window[:, at : at + x.shape[1]].T > least
                at += x.shape[1]
            like[0, rows_at], like[1, rows_at] = valid.sum(axis=1), (any_view & valid).sum(axis=1)
        self.ring.update((np.ascontiguousarray(both[-self.size :]).tobytes(), n + len(batch)))
        yield batch[self.columns].assign(n_compared=like[0], n_similar=like[1])

    def close(self) -> None:
        pass


def units(vectors: pd.Series) -> np.ndarray:
    x = np.array(vectors.tolist(), np.float32)
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def last_vectors_stream(rows: DataFrame, scope: str, order: str, views: dict[str, float], size: int, keep: list[str]) -> DataFrame:
    """keep's columns with n_compared and n_similar: how many of the `size` rows before, in the scope, are alike in any view.

    views: columns of vectors and the cosine above which two are alike. The ring of a scope is size x width floats;
    retrieval.similar_to_last() is the batch form."""
    kinds = [f for f in rows.schema.fields if f.name in keep]
    schema = T.StructType([*sorted(kinds, key=lambda f: keep.index(f.name)), T.StructField("n_compared", T.LongType()), T.StructField("n_similar", T.LongType())])
    return rows.groupBy(scope).transformWithStateInPandas(LastVectors(views, size, order, keep), schema, "append", "none")


def run_until(stream: DataFrame, out: str, checkpoint: str, keep: Column, order: str, target: int, most: int) -> dict[str, int]:
    """Writes the stream's kept rows to out/rows until there are `target` of them or `most` rows were examined, then ends the query itself.

    Each micro-batch writes its own folder and then a row of counts, both over again if it is repeated, so a restart goes on
    from the counts on disk and doubles nothing. The micro-batch that crosses a bound is cut at the row that does, in
    the order (numeric, without ties); files beyond it are listed but never opened. Returns examined and written."""
    spark = stream.sparkSession
    counts_at, rows_at = f"{out}/counts", f"{out}/rows"

    def so_far(session: SparkSession, before: int | None = None) -> tuple[int, int]:
        found = session.read.schema("batch long, examined long, written long").json(counts_at) if exists(session, counts_at) else None
        if found is None:
            return 0, 0
        return tuple(found.where(F.lit(before is None) | (F.col("batch") < (before or 0))).agg(F.coalesce(F.sum("examined"), F.lit(0)), F.coalesce(F.sum("written"), F.lit(0))).first())

    def step(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        examined, written = so_far(session, number)
        if examined >= most or written >= target:
            return  # the batch is never read
        marked = batch.withColumn("_keep", F.coalesce(keep, F.lit(False)))
        n, kept = marked.agg(F.count("*"), F.count_if("_keep")).first()
        if n > most - examined:
            marked = numbered(binned(marked, order), [], [order]).where(F.col("_nth") <= most - examined).drop("_nth")
            n, kept = marked.agg(F.count("*"), F.count_if("_keep")).first()
        some = marked.where("_keep").drop("_keep")
        if kept > target - written:
            some = numbered(binned(some, order), [], [order]).where(F.col("_nth") <= target - written)
            end = some.agg(F.max(F.when(F.col("_nth") == target - written, F.col(order)))).first()[0]
            some, kept = some.drop("_nth"), target - written
            n = marked.where(F.col(order) <= F.lit(end)).count()
        some.write.mode("overwrite").parquet(f"{rows_at}/batch={number}")
        session.createDataFrame([(number, n, kept)], "batch long, examined long, written long").coalesce(1).write.mode("overwrite").json(f"{counts_at}/of={number}")

    def ended() -> bool:
        examined, written = so_far(spark)
        return examined >= most or written >= target

    if not ended():
        query = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        known = None
        try:
            while not query.awaitTermination(0.2):  # ends by itself where the source has nothing more
                progress = query.lastProgress
                if progress is not None and progress["batchId"] != known:
                    known = progress["batchId"]
                    if ended():
                        break
        finally:
            query.stop()
    examined, written = so_far(spark)
    return {"examined": int(examined), "written": int(written)}
