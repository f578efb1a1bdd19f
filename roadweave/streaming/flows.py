"""Streams of observations and what is kept of them."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.graph import shared_path

#: Shares of keyed state; fixed, as a stream's state is dealt by it.
SHARES = 2048


def observations(spark: SparkSession, folder: str, name: str = "events") -> DataFrame:
    """A file stream of observations; event time becomes a timestamp, as watermarks need."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*.parquet").parquet(folder)
    return raw.select("event_id", F.col("event_type").alias("node_id"), F.col("user_id").alias("entity_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("speed"))


def windowed(stream: DataFrame, width: str, late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts of every window and node; rows later than the watermark are dropped. A speed that isn't positive is
    unknown, so it is no queue."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width, slide), "node_id").agg(F.count("*").alias("n"), F.count_if((F.col("speed") > 0) & (F.col("speed") < 5)).alias("queued"), F.approx_count_distinct("entity_id").alias("entities"))


def once_a_frame(stream: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def journeys(stream: DataFrame, timeout: str, late: str = "1 hour") -> DataFrame:
    """Sessions of an entity that end after a pause."""
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", timeout), "entity_id").agg(F.count("*").alias("legs"))


def distinct_entities(stream: DataFrame, width: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Each entity once for every window and key, to be counted exactly downstream. State
    is dealt by entity, so that no window's set lies in one place, and goes with the watermark."""
    return stream.withWatermark("ts", late).withColumn("window", F.window("ts", width)).dropDuplicates(["window", *keys, "entity_id"])


def transfers(left: DataFrame, right: DataFrame, most: str, late: str = "1 hour") -> DataFrame:
    """Pairs of an entity's sightings at two nodes, the second at most so much later."""
    a = left.withWatermark("ts", late).select(F.col("entity_id").alias("who"), F.col("event_id").alias("before"), F.col("ts").alias("t0"))
    b = right.withWatermark("ts", late).select("entity_id", F.col("event_id").alias("after"), F.col("ts").alias("t1"))
    near = (F.col("who") == F.col("entity_id")) & (F.col("t1") > F.col("t0")) & (F.col("t1") <= F.col("t0") + F.expr(f"interval {most}"))
    return a.join(b, near).select("entity_id", "before", "after")


def keyed(stream: DataFrame, keys: list[str], start: tuple, step: Callable, expires: Callable, out: str, state: str, ended: Callable | None = None, late: str = "1 hour") -> DataFrame:
    """What ``step(state, row) -> (state, rows)`` makes of each key's rows in order of time,
    the state being kept between micro-batches.

    ``expires(state)`` is the last second of event time in which a key is still held. Past it,
    by a row of its own or by the watermark, ``ended(state)`` names the rows of that moment and
    the key starts anew, so results don't depend on how rows fall into batches. Rows later than the watermark are
    dropped; others that come after a later row of their key's earlier batch are taken as they come.
    A row has the stream's columns and ``us``, its microseconds. Rows out begin with the keys.

    Keys are dealt into ``SHARES`` shares, and a share's keys are one state, read and written together: a call for each key
    costs far more than its rows do. Keys go through it as text, so that nulls don't turn others into floats."""
    close = ended or (lambda now: [])
    fields = out.split(", ")
    names, kinds = [field.split()[0] for field in fields], dict(field.split(maxsplit=1) for field in fields[: len(keys)])
    own = [f"__{k}" for k in keys]
    texts = lambda columns, between: [f"{c}{between}string" for c in columns]
    share = ",".join([*texts(own, ":"), *[field.replace(" ", ":", 1) for field in state.split(", ")]])

    def follow(_: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        mark = held.getCurrentWatermarkMs()
        states = {tuple(s[: len(keys)]): tuple(s[len(keys) :]) for s in held.get[0]} if held.exists else {}
        made, seen = [], set()
        if not held.hasTimedOut:
            rows = pd.concat(list(batches)).sort_values(["us", "event_id"])
            for who, row in zip(zip(*[rows[k] for k in own], strict=True), rows.itertuples(index=False), strict=True):
                now = states.get(who, start)
                if now != start and row.us // 1_000_000 > expires(now):
                    made += [(*who, *r) for r in close(now)]
                    now = start
                states[who], new = step(now, row)
                made += [(*who, *r) for r in new]
                seen.add(who)
        for who in [who for who, now in states.items() if now == start or (who not in seen and (expires(now) + 1) * 1000 < mark)]:
            now = states.pop(who)
            if now != start:
                made += [(*who, *r) for r in close(now)]
        if states:
            held.update(([(*who, *now) for who, now in states.items()],))
            held.setTimeoutTimestamp(max((min(map(expires, states.values())) + 1) * 1000, mark + 1))
        elif held.exists:
            held.remove()
        if made:
            yield pd.DataFrame(made, columns=names)

    timed = stream.withWatermark("ts", late).withColumns({"us": F.unix_micros("ts"), **{c: F.col(k).cast("string") for c, k in zip(own, keys, strict=True)}, "__share": F.pmod(F.xxhash64(*keys), F.lit(SHARES))})
    rows = timed.groupBy("__share").applyInPandasWithState(follow, ", ".join([*texts(keys, " "), *fields[len(keys) :]]), f"held array<struct<{share}>>", "append", GroupStateTimeout.EventTimeTimeout)
    return rows.select(*[F.col(k).cast(kinds[k]).alias(k) for k in keys], *names[len(keys) :])


def tracks(stream: DataFrame, lost_s: int = 43200, forget_s: int = 3 * 86400, late: str = "1 hour") -> DataFrame:
    """The state of each entity's track at every hit: NEW, then TENTATIVE, from the third
    hit on CONFIRMED; REACTIVATED after a pause of over ``lost_s``, REMOVED after one of over ``forget_s``."""

    def step(now: tuple, row) -> tuple:
        hits, last = now[0] + 1, now[1]
        at = row.us // 1_000_000
        name = "NEW" if hits == 1 else "TENTATIVE" if hits < 3 else "REACTIVATED" if at - last > lost_s else "CONFIRMED"
        return (hits, max(last, at)), [(row.event_id, name, hits)]

    out = "entity_id long, event_id long, state string, hits long"
    return keyed(stream, ["entity_id"], (0, 0), step, lambda now: now[1] + forget_s, out, "hits long, last long", lambda now: [(None, "REMOVED", now[0])], late)


def incidents(stream: DataFrame, step_s: int, first: float = 0.5, late: str = "1 hour") -> DataFrame:
    """Incidents of an entity at a node: OPENED, REINFORCED by 0.05 in each next step,
    RESOLVED in the first step without a sighting, known by a later one or by the watermark."""

    def step(now: tuple, row) -> tuple:
        last, confidence = now
        at = row.us // 1_000_000 // step_s
        if last is None:
            return (at, first), [(at, "OPENED", first)]
        if at <= last:
            return now, []
        confidence = min(1.0, confidence + 0.05)
        return (at, confidence), [(at, "REINFORCED", round(confidence, 4))]

    out = "entity_id long, node_id string, step long, status string, confidence double"
    return keyed(stream, ["entity_id", "node_id"], (None, first), step, lambda now: (now[0] + 2) * step_s - 1, out, "last long, confidence double", lambda now: [(now[0] + 1, "RESOLVED", round(now[1], 4))], late)


def liveness(stream: DataFrame, silence_s: int, late: str = "1 hour") -> DataFrame:
    """When a source became LIVE and, after a silence, STALE."""

    def step(now: tuple, row) -> tuple:
        at = row.us // 1_000_000
        return ((at,), [(at, "LIVE")]) if now[0] is None else ((max(now[0], at),), [])

    out = "entity_id long, at long, status string"
    return keyed(stream, ["entity_id"], (None,), step, lambda now: now[0] + silence_s, out, "last long", lambda now: [(now[0] + silence_s, "STALE")], late)


@dataclass(frozen=True)
class Attempts:
    """When a costly reading of a sighting is tried."""

    least_size: float = 10.0
    retry_size: float = 40.0
    sure_size: float = 60.0
    most: int = 10
    frame_s: int = 3600
    every_frames: int = 5
    cache_s: int = 43200
    forget_s: int = 30 * 86400


def throttled(stream: DataFrame, rules: Attempts = Attempts(), late: str = "1 hour") -> DataFrame:
    """Each sighting with whether it is read, and why. ``speed`` stands for its size; a
    reading of ``sure_size`` confirms the key, and then it is left alone for ``cache_s``."""

    def why(now: tuple, size: float, at: int) -> str:
        tries, frame, last, sure = now
        if not size >= rules.least_size:
            return "TOO_SMALL"
        if tries == 0:
            return "NEW"
        if sure and at - last < rules.cache_s:
            return "CONFIRMED"
        if tries >= rules.most and (sure or size < rules.retry_size):
            return "SPENT"
        return "TOO_SOON" if at // rules.frame_s - frame < rules.every_frames else "DUE"

    def step(now: tuple, row) -> tuple:
        at = row.us // 1_000_000
        size = float("nan") if row.speed is None else float(row.speed)
        reason = why(now, size, at)
        read = reason in ("NEW", "DUE")
        if read:
            now = (now[0] + 1, at // rules.frame_s, at, bool(now[3] or size >= rules.sure_size))
        return now, [(row.event_id, read, reason)]

    out = "entity_id long, event_id long, read boolean, reason string"
    return keyed(stream, ["entity_id"], (0, 0, 0, False), step, lambda now: now[2] + rules.forget_s, out, "tries long, frame long, last long, sure boolean", None, late)


def recent(stream: DataFrame, steps: int = 60, forget_s: int = 30 * 86400, late: str = "1 hour") -> DataFrame:
    """At each sighting, the values that a model sees: the last ``steps`` of its key, oldest first."""

    def step(now: tuple, row) -> tuple:
        value = None if row.speed is None or row.speed != row.speed else float(row.speed)
        kept = [*now[1], value][-steps:]
        return (max(now[0], row.us // 1_000_000), kept), [(row.event_id, kept)]

    out = "entity_id long, event_id long, history array<double>"
    return keyed(stream, ["entity_id"], (0, []), step, lambda now: now[0] + forget_s, out, "last long, kept array<double>", None, late)


class DroppedRows(StreamingQueryListener):
    """How many rows each query's stateful operators dropped behind the watermark, as it runs."""

    def __init__(self):
        self.counts: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self.counts.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        n = sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)
        self.counts[str(event.progress.id)] = self.counts.get(str(event.progress.id), 0) + n

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def with_late_rows(stream: DataFrame, keys: list[str], late_ms: int, label: str) -> tuple[DataFrame, DataFrame, int]:
    """(rows in time, late rows, number that Spark dropped) of a stream with event time ``ts``, run to its end.

    Rows in time are those of ``once_a_frame`` by ``keys``. A row is late if its time isn't past the latest time of
    the micro-batches up to the last but one before its own, less ``late_ms``: by that watermark Spark drops rows, as
    a batch may still feed later operators with what the newer one makes old. Late rows go to a table of their own, by batch, so that
    a batch that is run again replaces its rows; so do the batches' latest times, one row each."""
    spark = stream.sparkSession
    path = shared_path(spark, label)
    listener = DroppedRows()
    spark.streams.addListener(listener)

    def aside(batch: DataFrame, number: int) -> None:
        batch.persist()
        latest = f"{path}/latest"
        earlier = spark.read.schema("ms long, batch long").parquet(latest).where(F.col("batch") < number - 1).agg(F.max("ms")).first()[0] if number else None
        late = batch.where(F.unix_millis("ts") <= F.lit(earlier - late_ms)) if earlier is not None else batch.limit(0)
        late.write.mode("overwrite").parquet(f"{path}/late/batch={number}")
        batch.agg(F.max(F.unix_millis("ts")).alias("ms")).write.mode("overwrite").parquet(f"{latest}/batch={number}")
        batch.unpersist()

    try:
        kept = stream.withWatermark("ts", f"{late_ms} milliseconds").dropDuplicatesWithinWatermark(keys)
        q = kept.writeStream.outputMode("append").option("checkpointLocation", f"{path}/kept-state").trigger(availableNow=True).foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/kept/batch={number}")).start()
        q.awaitTermination()
        side = stream.writeStream.option("checkpointLocation", f"{path}/late-state").trigger(availableNow=True).foreachBatch(aside).start()
        side.awaitTermination()
        said = sum(op["numRowsDroppedByWatermark"] for p in q.recentProgress for op in p["stateOperators"])  # of the last hundred batches
        deadline = time.time() + 30
        while listener.counts.get(str(q.id), 0) < said and time.time() < deadline:
            time.sleep(0.1)  # progress reaches listeners a moment later
    finally:
        spark.streams.removeListener(listener)
    read = lambda name: spark.read.schema(stream.schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{path}/{name}")
    return read("kept"), read("late"), listener.counts.get(str(q.id), 0)


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """The state store that arbitrary state needs, for the streams started within."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def drained(stream: DataFrame, mode: str, label: str, keys: list[str] | None = None) -> DataFrame:
    """Run a stream over all that is there into a table of the shared folder. In
    ``update`` mode the newest row of each key is kept, in ``complete`` mode the last batch."""
    spark = stream.sparkSession
    path = shared_path(spark, label)

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("__batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()
    if not q.lastProgress and not spark.read.option("recursiveFileLookup", "true").schema(stream.schema).parquet(f"{path}/*").take(1):
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.parquet(f"{path}/rows").drop("batch")
    if mode == "complete":
        rows = rows.where(F.col("__batch") == rows.agg(F.max("__batch")).first()[0])
    if mode != "update":
        return rows.drop("__batch")
    values = F.struct(*[c for c in rows.columns if c not in (keys or []) and c != "__batch"])
    return rows.groupBy(*keys).agg(F.max_by(values, "__batch").alias("v")).select(*keys, "v.*")
