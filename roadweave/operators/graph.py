"""Graphs as node and edge tables: adjacency, propagation, paths, components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import traffic
from ..functions.traffic import half_up


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder ``spark.checkpoint.dir``; without one (local
    tests), in the session's warehouse. On a cluster that may be a folder of one
    machine, so there it is an error."""
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or (held.get() if held.isDefined() else None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage through a table in the shared folder."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def normalised_adjacency(edges: DataFrame) -> DataFrame:
    """D^-1/2 (A + I) D^-1/2 over (source, target, w), with row degrees of 1e-6 at least."""
    nodes = edges.select(F.col("source").alias("n")).union(edges.select("target")).distinct()
    loops = edges.select("source", "target", F.col("w").cast("double").alias("w")).unionByName(nodes.select(F.col("n").alias("source"), F.col("n").alias("target"), F.lit(1.0).alias("w"))).groupBy("source", "target").agg(F.sum("w").alias("w"))
    degree = loops.groupBy("source").agg(F.greatest(F.lit(1e-6), F.sum("w")).alias("d"))
    return loops.join(degree, "source").join(degree.select(F.col("source").alias("target"), F.col("d").alias("e")), "target").select("source", "target", (F.col("w") / F.sqrt(F.col("d") * F.col("e"))).alias("w"))


def dynamic_weight(w, count, speed_factor, confidence, has_gap, a: float = 0.5):
    """A weight raised by its evidence; without evidence it stays."""
    seen = F.coalesce(count, F.lit(0))
    factor = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(speed_factor, F.lit(1.0)))) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(confidence, F.lit(1.0))))
    return w * (1 + a * F.tanh(F.log1p(seen) * factor * F.when(F.coalesce(has_gap, F.lit(False)), 0.8).otherwise(1.0)))


def propagated(adjacency: DataFrame, values: DataFrame, hops: int = 1, by: list[str] | None = None) -> DataFrame:
    """``hops`` steps of x <- A x; ``values``: node, x and the keys ``by``."""
    by = by or []
    for _ in range(hops):
        values = adjacency.join(values.withColumnRenamed("node", "target"), "target").groupBy("source", *by).agg(F.sum(F.col("w") * F.col("x")).alias("x")).withColumnRenamed("source", "node")
    return values


def _rounds(most: int | None) -> Iterator[int]:
    """Round numbers without end; with a bound, an error once it is passed."""
    for n in count():
        if n == most:
            raise RuntimeError(f"not settled after {most} rounds")
        yield n


def shortest_paths(edges: DataFrame, origins: DataFrame, goals: DataFrame | None = None, rounds: int | None = None, sums: tuple[str, ...] = ("metres",)) -> DataFrame:
    """(origin, node, cost, path, metres) of the cheapest path to every node that is
    reached, or to the goals only. ``edges``: source, target, cost and the columns
    ``sums`` (metres) that are added up along a path.

    Each round relaxes the edges that leave what the round before improved; it
    ends when nothing improves, and fails if ``rounds`` is given and doesn't do. Equal costs: the path that comes first."""
    best = written(origins.select(F.col("node").alias("origin"), "node", F.lit(0.0).alias("cost"), F.array("node").alias("path"), *[F.lit(0.0).alias(x) for x in sums]), "paths")
    frontier = best
    e = edges.select("source", F.col("target").alias("to"), F.col("cost").alias("c"), *[F.col(x).alias(f"__{x}") for x in sums])
    for _ in _rounds(rounds):
        steps = frontier.join(e, frontier["node"] == e["source"]).where(~F.array_contains("path", F.col("to")))
        new = steps.select("origin", F.col("to").alias("node"), (F.col("cost") + F.col("c")).alias("cost"), F.concat("path", F.array("to")).alias("path"), *[(F.col(x) + F.col(f"__{x}")).alias(x) for x in sums])
        both = best.withColumn("old", F.lit(1)).unionByName(new.withColumn("old", F.lit(0)))
        merged = both.groupBy("origin", "node").agg(F.min(F.struct("cost", "path", *sums, "old")).alias("b")).select("origin", "node", "b.cost", "b.path", *[f"b.{x}" for x in sums], "b.old")
        merged = written(merged, "paths")
        best, frontier = merged.drop("old"), merged.where("old = 0").drop("old")
        if frontier.isEmpty():
            break
    return best if goals is None else best.join(goals, ["origin", "node"], "left_semi")


def predictive_routes(edges: DataFrame, origins: DataFrame, goals: DataFrame | None = None) -> DataFrame:
    """The cheapest route by forecast time, congestion, uncertainty and incidents, with its
    time, bounds, and delay against a minute a kilometre.

    ``edges``: source, target, seconds, congestion, spread, metres, incident."""
    e = edges.withColumn("cost", traffic.road_cost("seconds", "congestion", "spread", "metres", F.col("incident")))
    found = shortest_paths(e, origins, goals, sums=("metres", "seconds"))
    delay = F.greatest(F.lit(0.0), F.col("seconds") - 60.0 * F.col("metres") / 1000.0)
    return found.select("*", half_up(delay, 2).alias("delay"), half_up(F.col("seconds") * 0.9, 2).alias("lower"), half_up(F.col("seconds") * 1.15, 2).alias("upper"))


def timed_paths(edges: DataFrame, profile: DataFrame, origins: DataFrame, rounds: int | None = None) -> DataFrame:
    """Earliest arrivals with travel times that depend on the time of entry.

    ``profile``: source, target, from_s, to_s, seconds, without overlaps and such that
    who leaves later doesn't arrive earlier. Outside, the edge's own ``cost`` holds.
    Fails if ``rounds`` is given and doesn't do."""
    best = written(origins.select(F.col("node").alias("origin"), "node", F.col("start").cast("double").alias("arrival"), F.array("node").alias("path")), "arrivals")
    frontier = best
    e = edges.select("source", F.col("target").alias("to"), F.col("cost").alias("c"))
    p = profile.select(F.col("source").alias("ps"), F.col("target").alias("pt"), "from_s", "to_s", "seconds")
    for _ in _rounds(rounds):
        steps = frontier.join(e, frontier["node"] == e["source"]).where(~F.array_contains("path", F.col("to")))
        timed = steps.join(p, (F.col("node") == F.col("ps")) & (F.col("to") == F.col("pt")) & (F.col("arrival") >= F.col("from_s")) & (F.col("arrival") < F.col("to_s")), "left")
        new = timed.select("origin", F.col("to").alias("node"), (F.col("arrival") + F.coalesce("seconds", "c")).alias("arrival"), F.concat("path", F.array("to")).alias("path"))
        both = best.withColumn("old", F.lit(1)).unionByName(new.withColumn("old", F.lit(0)))
        merged = written(both.groupBy("origin", "node").agg(F.min(F.struct("arrival", "path", "old")).alias("b")).select("origin", "node", "b.arrival", "b.path", "b.old"), "arrivals")
        best, frontier = merged.drop("old"), merged.where("old = 0").drop("old")
        if frontier.isEmpty():
            break
    return best


def in_out(transitions: DataFrame) -> DataFrame:
    """(node_id, n_in, n_out) of every node that transitions touch, in one aggregation."""
    ends = F.explode(F.array(F.struct(F.col("target").alias("node_id"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("source").alias("node_id"), F.lit(0).alias("i"), F.lit(1).alias("o"))))
    return transitions.select(ends.alias("e")).groupBy("e.node_id").agg(F.sum("e.i").alias("n_in"), F.sum("e.o").alias("n_out"))


def components(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, component) of (a, b) links; the least node names a component. Fails if ``rounds`` is given and doesn't do."""
    once = written(links.select("a", "b"), "links")
    both = once.union(once.select("b", "a")).distinct()
    labels = written(both.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct(), "labels")
    for _ in _rounds(rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("m"))
        new = labels.join(near, labels["node"] == near["a"], "left").select("node", F.least("component", F.coalesce("m", "component")).alias("component"))
        # jump to the component of the component
        up = new.select(F.col("node").alias("c"), F.col("component").alias("cc"))
        new = written(new.join(up, new["component"] == up["c"], "left").select("node", F.coalesce("cc", "component").alias("component")), "labels")
        moved = new.join(labels.withColumnRenamed("component", "was"), "node").where("component <> was").isEmpty()
        labels = new
        if moved:
            break
    return labels


def chains(links: DataFrame) -> DataFrame:
    """(node, component) as ``components`` has it, of (before, after) links that give each node one before it and one after it at most.

    Each round doubles how far back a node looks, so a chain of n nodes takes log2(n) rounds, in whatever order its names are. Links in a
    circle have no first node: an error."""
    ups = written(links.select(F.col("after").alias("node"), F.col("before").alias("up")), "chains")
    for _ in _rounds(64):
        further = ups.select(F.col("node").alias("__node"), F.col("up").alias("__up"))
        new = ups.join(further, ups["up"] == further["__node"], "left")
        ups = written(new.select("node", F.coalesce("__up", "up").alias("up"), F.col("__up").isNotNull().alias("moved")), "chains")
        if ups.where("moved").isEmpty():
            break
    whole = ups.groupBy("up").agg(F.least("up", F.min("node")).alias("component"))
    return ups.join(whole, "up").select("node", "component").unionByName(whole.select(F.col("up").alias("node"), "component"))


def upsert_edges(updates: DataFrame) -> DataFrame:
    """Multi-edges keyed by type and time (time 0 is one edge); the later write wins."""
    key = F.when(F.col("at") == 0, F.lit("0")).otherwise(F.concat_ws("@", "type", F.col("at").cast("string")))
    return updates.withColumn("key", key).groupBy("source", "target", "key").agg(F.max_by("value", "seq").alias("value"), F.count("*").alias("writes"))


def symmetric(edges: DataFrame, n: str = "n", last: str = "l") -> DataFrame:
    """Evidence of both directions on either: the larger count and the later struct ``last``."""
    back = edges.where("source <> target").select(F.col("target").alias("source"), F.col("source").alias("target"), *[c for c in edges.columns if c not in ("source", "target")])
    return edges.unionByName(back).groupBy("source", "target").agg(F.max(n).alias(n), F.max(last).alias(last))


def indexed(nodes: DataFrame, key: str, out: str = "i") -> DataFrame:
    """``nodes`` with the place of each row, from 0, in the order of ``key`` (null first; equal ones in any order).

    Range partitions are sorted by themselves, and places go on from one to the next by the partitions' counts, of
    which there is one row each: no task sorts or numbers all nodes."""
    dealt = nodes.repartitionByRange(key).sortWithinPartitions(key)
    placed = written(dealt.withColumns({"__part": F.spark_partition_id(), "__place": F.monotonically_increasing_id() % (1 << 33)}), "indexed")
    before = F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    first = placed.groupBy("__part").agg(F.count("*").alias("n")).select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    return placed.join(F.broadcast(first), "__part").withColumn(out, F.col("__before") + F.col("__place")).drop("__part", "__place", "__before")


def edge_index(edges: DataFrame, source: str, target: str, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """(source_i, target_i) of each distinct edge whose ends are among the ``indexed`` nodes (columns key, i)."""
    each = edges.select(F.col(source).alias("__s"), F.col(target).alias("__t")).distinct()
    of = lambda nodes, name, out: nodes.select(F.col("key").alias(name), F.col("i").alias(out))
    return each.join(of(sources, "__s", "source_i"), "__s").join(of(targets, "__t", "target_i"), "__t").select("source_i", "target_i")
