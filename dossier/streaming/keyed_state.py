"""Streams that keep their state by key in the state store: live consensus by context, and the wait that each call would need."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from dossier.functions.text import upper_trimmed
from dossier.operators.feedback import adjusted, context_counts
from dossier.sources.keyed import KeyedTable

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
CONTEXT = ["clause_type", "row_offering", "row_solution"]


@contextmanager
def keyed_store(spark: SparkSession):
    """Streams started within use the state store that keyed state needs; a stream keeps its own once started."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


class _Reviews(StatefulProcessor):
    """The last review of each document, clause type and reviewer. A newer one takes the old one's count back and gives its own."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getValueState("last", "at long, id long, row_offering string, row_solution string, suggested_level string, agreement string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        fields = ("at", "id", "row_offering", "row_solution", "suggested_level", "agreement")
        old = self._last.get() if self._last.exists() else None
        order = lambda r: (r[0] is not None, r[0], r[1])
        newest = max((tuple(r[f] for f in fields) for r in rows), key=order)
        if old is not None and order(tuple(old)) >= order(newest):
            return
        self._last.update(newest)
        for sign, r in ((-1, old), (1, newest)):
            if r is not None:
                yield Row(clause_type=key[1], row_offering=r[2], row_solution=r[3], reviewer=hash_of(key), suggested_level=r[4], agreement=r[5], id=r[1], sign=sign)

    def close(self) -> None:
        pass


def hash_of(key: tuple) -> int:
    """A number for a key that is the same in every worker."""
    return zlib.crc32(repr(tuple(key)).encode())


class _Counts(StatefulProcessor):
    """Rows of each level in a slice of a context: all, those that found it too high, too low, and the first id."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._levels = handle.getMapState("levels", "level string", "n long, high long, low long, first long")
        self._ids = handle.getMapState("ids", "level string, id long", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        touched, orphaned = {}, set()
        for r in rows:
            level = "" if r["suggested_level"] is None else "=" + r["suggested_level"]
            if level not in touched:
                touched[level] = list(self._levels.getValue((level,))) if self._levels.containsKey((level,)) else [0, 0, 0, None]
            now, sign = touched[level], r["sign"]
            for k, count in enumerate((1, r["agreement"] == "too_high", r["agreement"] == "too_low")):
                now[k] += sign * count
            at = (level, r["id"])
            n = (self._ids.getValue(at)[0] if self._ids.containsKey(at) else 0) + sign
            if n:
                self._ids.updateValue(at, (n,))
            else:
                self._ids.removeKey(at)
            if sign > 0:
                now[3] = r["id"] if now[3] is None else min(now[3], r["id"])
            elif r["id"] == now[3]:
                orphaned.add(level)
        if orphaned:  # the first id of a level went: the next is looked up among those that are left
            first: dict[str, int] = {}
            for (level, i), _ in self._ids.iterator():
                if level in orphaned:
                    first[level] = min(i, first.get(level, i))
            for level in orphaned:
                touched[level][3] = first.get(level)
        for level, now in touched.items():
            self._levels.updateValue((level,), tuple(now))
            yield Row(clause_type=key[0], row_offering=key[1], row_solution=key[2], part=key[3], suggested_level=level[1:] if level else None, n=now[0], high=now[1], low=now[2], first=now[3])

    def close(self) -> None:
        pass


def consensus_changes(rows: DataFrame, *, parts: int = 16) -> DataFrame:
    """A stream of feedback as a stream of changed counts: clause_type, row_offering, row_solution, part, suggested_level, n, high, low, first.

    Each reviewer's last row on a clause counts; a row seen again, or older than the one that counts, changes
    nothing. Counts are kept in the state store for each context and level, in `parts` slices of reviewers, so a busy context
    is the work of many tasks, and a batch costs its own rows however many came before.
    """
    slim = rows.select("doc", "clause_type", "user_id", F.unix_micros(F.col("created_at").cast("timestamp")).alias("at"), F.col("id").cast("long").alias("id"), upper_trimmed("offering").alias("row_offering"), upper_trimmed("solution").alias("row_solution"), "suggested_level", "agreement")
    reviews = slim.groupBy("doc", "clause_type", "user_id").transformWithState(_Reviews(), "clause_type string, row_offering string, row_solution string, reviewer long, suggested_level string, agreement string, id long, sign int", "Append", "None")
    dealt = reviews.withColumn("part", F.pmod("reviewer", F.lit(parts)).cast("int"))
    return dealt.groupBy(*CONTEXT, "part").transformWithState(_Counts(), "clause_type string, row_offering string, row_solution string, part int, suggested_level string, n long, high long, low long, first long", "Append", "None")


def counts_table(spark: SparkSession, path: str) -> KeyedTable:
    return KeyedTable(spark, f"{path}/counts", "context", buckets=32)


def live_levels(spark: SparkSession, path: str, targets: DataFrame, *, share: float = 0.5) -> DataFrame:
    """targets (clause_type, offering, solution, system_level) with the level that the counts under path call for just now; see feedback.adjusted."""
    counts = counts_table(spark, path)
    held = counts.read().where("n > 0").select(*CONTEXT, "suggested_level", "n", "high", "low", "first") if counts.versions() else context_counts(spark.createDataFrame([], "id long, clause_type string, offering string, solution string, suggested_level string, agreement string"))
    return adjusted(held, targets, share=share)


def consensus_stream(rows: DataFrame, path: str, checkpoint: str, *, parts: int = 16) -> StreamingQuery:
    """Keep the counts of feedback by context and level under path, from which live_levels tells every target's level.

    A batch patches its changed counts into the table, which holds as many rows as there are contexts, levels and parts,
    whatever the history. A batch that is run again, as after a restart, writes what it wrote. The last two versions stay.
    """
    counts = counts_table(rows.sparkSession, path)

    def merge(batch: DataFrame, number: int) -> None:
        changed = batch.withColumn("context", F.xxhash64(*CONTEXT)).persist()
        try:
            if not changed.isEmpty():
                same = lambda old, new: [old[c].eqNullSafe(new[c]) for c in ("context", *CONTEXT, "part", "suggested_level")]
                counts.patch(changed, [], lambda old, new, _: old.join(new, same(old, new), "left_anti").unionByName(new))
                counts.vacuum(2)
        finally:
            changed.unpersist()

    with keyed_store(rows.sparkSession):
        return consensus_changes(rows, parts=parts).writeStream.outputMode("append").foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class _Waits(StatefulProcessor):
    """A provider's last calls and its last refusal, worked through in order of time."""

    def __init__(self, caps: dict[str, int], window: int, cooldown: int, least: int) -> None:
        self._caps, self._window, self._cooldown, self._least = caps, window, cooldown, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._pending = handle.getMapState("pending", "at long, call_id long", "status int, retry_after int, n int")
        self._ring = handle.getMapState("ring", "place int", "at long")
        self._so_far = handle.getValueState("so_far", "calls long, refused long, wait long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        """Calls wait for the watermark, so that late ones come in order."""
        for r in rows:
            at = (r["at"], r["call_id"])
            n = self._pending.getValue(at)[2] if self._pending.containsKey(at) else 0
            self._pending.updateValue(at, (r["status"], r["retry_after"], n + 1))
            self._handle.registerTimer(r["at"] * 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        due = timerValues.getCurrentWatermarkInMs()
        calls = sorted(((*at, *v) for at, v in self._pending.iterator() if at[0] * 1000 <= due), key=lambda c: c[:2])
        total, refused, wait = self._so_far.get() if self._so_far.exists() else (0, None, None)
        cap, new = self._caps.get(key[0]), None
        for k, (at, call_id, status, retry_after, n) in enumerate(calls):
            if new is not None and new[0] < at:  # refusals count for later seconds only, of one second the longest
                (refused, wait), new = new, None
            open_ = refused is not None and at < refused + wait
            for _ in range(n):
                slot, left = (total % cap,) if cap else None, 0
                if cap and total >= cap:
                    left = max(0, self._ring.getValue(slot)[0] + self._window - at)
                if cap:
                    self._ring.updateValue(slot, (at,))
                total += 1
                yield Row(provider=key[0], call_id=call_id, wait=max(left, refused + wait - at if open_ else 0), in_cooldown=open_)
            if status == 429:
                mine = (at, max(self._cooldown if retry_after is None else retry_after, self._least))
                new = mine if new is None else max(new, mine)
            self._pending.removeKey((at, call_id))
        if new is not None:
            refused, wait = new
        if calls:
            self._so_far.update((total, refused, wait))

    def close(self) -> None:
        pass


def call_waits(calls: DataFrame, caps: dict[str, int], *, window: int = 60, cooldown: int = 180, least: int = 10, late: str = "1 minute") -> DataFrame:
    """A stream of calls (provider, call_id, at in seconds, status, retry_after) as a stream of provider, call_id, wait, in_cooldown.

    What jobs.call_rates says of a table. Calls are held until the watermark has passed them and are then worked through in order of at
    and call_id; a ring of a provider's last `cap` times, by place in the state store, tells the call whose leaving
    the window frees a place. caps has a row for each provider and is small by nature. Start it within keyed_store.
    """
    rows = calls.select("provider", F.col("call_id").cast("long").alias("call_id"), F.col("at").cast("long").alias("at"), F.col("status").cast("int").alias("status"), F.col("retry_after").cast("int").alias("retry_after"), F.timestamp_seconds("at").alias("time")).withWatermark("time", late)
    return rows.groupBy("provider").transformWithState(_Waits(caps, window, cooldown, least), "provider string, call_id long, wait long, in_cooldown boolean", "Append", "EventTime")
