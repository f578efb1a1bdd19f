"""The trie of conversation prefixes and sums over its subtrees.

1. Turns are numbered within their conversation by range partitions with carries, so that no task
   gets all of a long one. Rebuilt conversations are joined from light rows (hashes and lengths).
2. A prefix is known by a 128-bit hash: the exclusive or of every turn's hash mixed with
   its place. Blocks of a conversation have carries too. Conversations with one
   prefix are pre-aggregated to a node; a node's name is its smallest member and its depth.
3. Subtree sums by centroid decomposition of the forest of parent edges. In each round
   every component is split at its centroid: the deepest node whose subtree has half of the
   component's weight or more, weights being members of nodes, known without a
   roll-up. The total of the centroid's subtree is added to it and to the nodes
   from it to the component's top; the subtrees of its children and the rest go on as components
   of at most half the weight. Whether a node is under the centroid is one look-up:
   its smallest member's prefix at the centroid's depth. Components of ``SMALL`` nodes or
   fewer are finished, by the same method, where they lie.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import broadcast_if_small, materialize, ship_package, whole_groups

#: Conversations whose first turns come from one of them.
FAMILY = 100
#: A rebuilt conversation takes fewer first turns than this from its family's first.
MOST_SHARED = 6
#: Binary logarithms of the turns of a block, for running hashes, and of the ids that
#: a chunk of a node's list of ends may hold.
BLOCK_BITS, CHUNK_BITS = 12, 12
#: Components of so many nodes at most are finished within a task.
SMALL = 2000


def numbered_turns(turns: DataFrame) -> DataFrame:
    """(conv, i, a, b, chars) of every turn: its place i from 0 in its conversation, two hashes of role
    and text, and the text's code points.

    Order is by turn, null first; turns of one number are ordered by hash, so that the
    result is the same however the table is split. Null role and text are empty.
    Rows without a conv_id belong to no conversation and are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    light = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), "turn", F.xxhash64(role, text).alias("a"), F.xxhash64(text, role, F.lit(1)).alias("b"), F.length(text).cast("long").alias("chars"))
    order = ["conv", F.col("turn").asc_nulls_first(), "a", "b"]
    dealt = materialize(light.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "turns")
    counts = dealt.groupBy("conv", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carries = counts.select("conv", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("carry")).where("carry > 0")
    own = F.row_number().over(Window.partitionBy("conv", "part").orderBy(*order[1:])) - 1
    return dealt.withColumn("own", own).join(carries, ["conv", "part"], "left").select("conv", (F.col("own") + F.coalesce("carry", F.lit(0))).cast("long").alias("i"), "a", "b", "chars")


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv, i, a, b, chars) of rebuilt conversations, (conv, length) of all of them).

    Conversation c takes the first h turns of c - c % 100 (fewer if it has fewer), h being the
    unsigned crc32 of its decimal id modulo 6, and then its own without their first h.
    """
    own = materialize(numbered_turns(turns), "numbered")
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % MOST_SHARED
    convs = own.groupBy("conv").agg(F.count("*").alias("n")).withColumn("h", h)
    first = own.where(F.col("i") < MOST_SHARED - 1)
    shared = convs.select(F.col("conv").alias("to"), "h", (F.col("conv") - F.col("conv") % FAMILY).alias("conv")).join(first, "conv").where(F.col("i") < F.col("h"))
    taken = convs.select((F.col("conv") - F.col("conv") % FAMILY).alias("base"), "conv", "n", "h").join(convs.select(F.col("conv").alias("base"), F.col("n").alias("has")), "base", "left")
    taken = materialize(taken.select("conv", "n", "h", F.least("h", F.coalesce("has", F.lit(0))).alias("taken")), "taken")
    rest = own.join(taken, "conv").where(F.col("i") >= F.col("h")).select("conv", (F.col("i") - F.col("h") + F.col("taken")).alias("i"), "a", "b", "chars")
    lengths = taken.select("conv", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    return shared.select(F.col("to").alias("conv"), "i", "a", "b", "chars").unionByName(rest), lengths


def prefixes(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """(conv, depth, p, q, up, uq, chars, length): every prefix of every conversation but the empty one,
    its hash (p, q), that of the prefix before it (up, uq), and the code points of its last text."""
    mixed = turns.select("conv", "i", F.shiftright("i", BLOCK_BITS).alias("block"), F.xxhash64("a", "b", "i").alias("x"), F.xxhash64("i", "b", "a", F.lit(2)).alias("y"), "chars")
    long = broadcast_if_small(materialize(lengths.where(F.col("length") > 1 << BLOCK_BITS).select("conv"), "long"), 16)
    totals = mixed.join(long, "conv", "left_semi").groupBy("conv", "block").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carries = totals.select("conv", "block", F.bit_xor("x").over(before).alias("cx"), F.bit_xor("y").over(before).alias("cy")).where("block > 0")
    run = Window.partitionBy("conv", "block").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    running = mixed.withColumns({"p": F.bit_xor("x").over(run), "q": F.bit_xor("y").over(run)}).join(carries, ["conv", "block"], "left")
    whole = lambda c, k: F.col(c).bitwiseXOR(F.coalesce(k, F.lit(0)))
    running = running.select("conv", "i", "x", "y", "chars", whole("p", "cx").alias("p"), whole("q", "cy").alias("q"))
    out = running.select("conv", (F.col("i") + 1).alias("depth"), "p", "q", F.col("p").bitwiseXOR(F.col("x")).alias("up"), F.col("q").bitwiseXOR(F.col("y")).alias("uq"), "chars")
    return out.join(lengths, "conv")


def trie_nodes(paths: DataFrame, lengths: DataFrame) -> DataFrame:
    """(p, q, conv_id, depth, up, uq, n_convs, chars, weight) of every node, the root included if there is any conversation."""
    weight = F.sum(F.col("length") - F.col("depth") + 1).alias("weight")
    nodes = paths.groupBy("p", "q", "depth").agg(F.min("conv").alias("conv_id"), F.max("up").alias("up"), F.max("uq").alias("uq"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"), weight)
    root = lengths.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.sum(F.col("length") + 1).alias("weight")).where("n_convs > 0")
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    root = root.select(zero.alias("p"), zero.alias("q"), "conv_id", zero.alias("depth"), none.alias("up"), none.alias("uq"), "n_convs", zero.alias("chars"), "weight")
    return nodes.select(*root.columns).unionByName(root)


def local_sums(parent: list[int], values: np.ndarray) -> np.ndarray:
    """Sums over the subtrees of one tree by centroid decomposition. Nodes stand in order
    of depth; ``parent`` has each one's place, -1 for the top."""
    out = np.zeros_like(values)
    todo = [list(range(len(parent)))] if parent else []
    while todo:
        nodes = todo.pop()
        if len(nodes) == 1:
            out[nodes[0]] += values[nodes[0]]
            continue
        top, size = nodes[0], dict.fromkeys(nodes, 1)
        for v in reversed(nodes[1:]):
            size[parent[v]] += size[v]
        centre = min((v for v in nodes if 2 * size[v] >= len(nodes)), key=size.__getitem__)  # the sizes of a chain of nodes
        under, below = {centre: -1}, {}
        for v in nodes:
            above = parent[v]
            if v != centre and above in under:
                under[v] = v if above == centre else under[above]
                below.setdefault(under[v], []).append(v)
        total = values[list(under)].sum(axis=0)
        v = centre
        while True:
            out[v] += total
            if v == top:
                break
            v = parent[v]
        todo += below.values()
        if centre != top:
            todo.append([v for v in nodes if v not in under])
    return out


def _finished(batches):
    """Rows sorted by component and depth: sums of every whole component."""
    names = ["p", "q", "leaves", "saved"]

    def sums(rows: pa.Table):
        comp = np.stack([rows[0].to_numpy(), rows[1].to_numpy()])
        ends = np.append(np.flatnonzero((comp[:, 1:] != comp[:, :-1]).any(axis=0)) + 1, rows.num_rows)
        values = np.stack([rows["leaves"].to_numpy(), rows["saved"].to_numpy()], axis=1)
        keys, ups = (list(zip(rows[x].to_pylist(), rows[y].to_pylist(), strict=True)) for x, y in (("p", "q"), ("up", "uq")))
        out, start = np.zeros_like(values), 0
        for end in ends.tolist():
            place = {k: i for i, k in enumerate(keys[start:end])}
            parent = [-1, *[place[k] for k in ups[start + 1 : end]]]
            out[start:end] = local_sums(parent, values[start:end])
            start = end
        return pa.RecordBatch.from_arrays([rows["p"].combine_chunks(), rows["q"].combine_chunks(), pa.array(out[:, 0]), pa.array(out[:, 1])], names=names)

    for table in whole_groups(batches, "c", "d"):
        yield sums(table)


def subtree_sums(nodes: DataFrame, paths: DataFrame, small: int = SMALL) -> DataFrame:
    """(p, q, leaves, saved) summed over the subtree of every node, given written nodes
    (p, q, conv_id, depth, up, uq, weight, leaves, saved) and paths (conv, depth, p, q)."""
    state = nodes.select(F.lit(0).cast("long").alias("c"), F.lit(0).cast("long").alias("d"), "p", "q", "conv_id", "depth", "up", "uq", "weight", "leaves", "saved")
    added: list[DataFrame] = []
    ready: list[DataFrame] = []  # components that are small enough
    names = state.columns
    while True:
        counted = state.groupBy("c", "d").agg(F.count("*").alias("n"), F.max("weight").alias("total"))
        large = materialize(counted.where(F.col("n") > small).select("c", "d", "total"), "large")
        if large.isEmpty():
            break
        ready.append(state.join(large.select("c", "d"), ["c", "d"], "left_anti").select(*names))
        active = state.join(large, ["c", "d"])
        heavy = active.where(2 * F.col("weight") >= F.col("total"))  # a chain from the top
        centre = heavy.groupBy("c", "d").agg(F.max_by(F.struct("p", "q", F.col("conv_id").alias("conv"), "depth", "weight"), "depth").alias("centre"), F.min("depth").alias("top"))
        centres = materialize(centre.select("c", "d", "top", *[F.col(f"centre.{x}").alias(f"{x}_") for x in ("p", "q", "conv", "depth", "weight")]), "centres")
        marked = active.drop("total").join(centres, ["c", "d"])
        deeper = marked.where(F.col("depth") > F.col("depth_")).withColumn("at", F.col("depth_") + 1)
        # a node is under the centroid if the prefix one below hangs from it
        hung = paths.select(F.col("conv").alias("conv_id"), F.col("depth").alias("at"), F.col("p").alias("ap"), F.col("q").alias("aq"), F.col("up").alias("bp"), F.col("uq").alias("bq"))
        deeper = deeper.join(hung, ["conv_id", "at"], "left")
        under = (F.col("bp") == F.col("p_")) & (F.col("bq") == F.col("q_"))
        itself = (F.col("p") == F.col("p_")) & (F.col("q") == F.col("q_")) & (F.col("depth") == F.col("depth_"))
        shallow = marked.where(F.col("depth") <= F.col("depth_")).withColumns({x: F.lit(None).cast("long") for x in ("at", "ap", "aq", "bp", "bq")})
        placed = deeper.unionByName(shallow).withColumns({"itself": itself, "under": F.coalesce(under, F.lit(False))})
        placed = materialize(placed.drop("at", "bp", "bq"), "placed")
        totals = placed.where("under or itself").groupBy("c", "d").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        totals = materialize(totals.join(centres, ["c", "d"]).select("c", "d", "conv_", "depth_", "top", "p_", "q_", "weight_", "leaves", "saved"), "totals")
        # the way from the centroid to the top of its component: prefixes of its smallest member
        way = totals.where("depth_ > 0").join(hung.select(F.col("conv_id").alias("conv_"), "at", "ap", "aq"), "conv_").where("at between top and depth_").select("c", "d", F.col("ap").alias("p"), F.col("aq").alias("q"), "leaves", "saved", F.col("at").alias("depth"), "weight_")
        zero = F.lit(0).cast("long")
        way = way.unionByName(totals.where("top = 0").select("c", "d", zero.alias("p"), zero.alias("q"), "leaves", "saved", zero.alias("depth"), "weight_"))
        way = materialize(way, "way")
        added.append(way.select("p", "q", "leaves", "saved"))
        less = way.select("c", "d", "p", "q", F.col("weight_").alias("less"))
        parts = placed.where("not itself").withColumns({"nc": F.when(F.col("under"), F.col("ap")).otherwise(F.col("c")), "nd": F.when(F.col("under"), F.col("aq")).otherwise(F.col("d"))})
        parts = parts.join(less, ["c", "d", "p", "q"], "left").withColumn("weight", F.col("weight") - F.when(F.col("under"), F.lit(0)).otherwise(F.coalesce("less", F.lit(0))))
        state = materialize(parts.select(F.col("nc").alias("c"), F.col("nd").alias("d"), *names[2:]), "components")
    local = reduce(DataFrame.unionByName, ready, state).repartition("c", "d").sortWithinPartitions("c", "d", "depth").select("c", "d", "p", "q", "up", "uq", "leaves", "saved")
    added.append(local.mapInArrow(_finished, "p bigint, q bigint, leaves bigint, saved bigint"))
    return reduce(DataFrame.unionByName, added).groupBy("p", "q").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def _digests(batches):
    """Rows sorted by node and chunk: the digest of each node's whole list, streamed."""
    key, h = None, None

    def row():
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([h.hexdigest()])], names=["p", "q", "ends_sha256"])

    for batch in batches:
        done = []
        for p, q, ids in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if key == (p, q):
                h.update(b"," + ids.encode())
                continue
            if key is not None:
                done.append((*key, h.hexdigest()))
            key, h = (p, q), hashlib.sha256(ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done], pa.int64()), pa.array([x[2] for x in done])], names=["p", "q", "ends_sha256"])
    if key is not None:
        yield row()


def ends_of(paths: DataFrame, lengths: DataFrame) -> DataFrame:
    """(p, q, ends_sha256) of the nodes at which conversations end: SHA-256 of their ids, ascending,
    comma-joined. Ids are joined to chunks first, so that a node's task streams few rows."""
    zero = F.lit(0).cast("long")
    last = paths.where(F.col("depth") == F.col("length")).select("p", "q", "conv").unionByName(lengths.where("length = 0").select(zero.alias("p"), zero.alias("q"), "conv"))
    chunks = last.groupBy("p", "q", F.shiftright("conv", CHUNK_BITS).alias("chunk")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))
    return chunks.repartition("p", "q").sortWithinPartitions("p", "q", "chunk").select("p", "q", "ids").mapInArrow(_digests, "p bigint, q bigint, ends_sha256 string")


def prefix_trie(conversations: DataFrame, small: int = SMALL) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations: conv_id, depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``conversations`` has conv_id, turn, role and text; other columns take no part. A
    conversation whose rebuilt form has no turns is a member of the root alone. Equal rows are
    turns of their own. For ties of turn and missing ids see ``numbered_turns``. An
    empty table has no root and no rows. Long texts count by code points and are moved by hash only.
    """
    ship_package(conversations.sparkSession)
    turns, lengths = rebuilt_turns(conversations)
    lengths = materialize(lengths, "lengths")
    paths = materialize(prefixes(turns, lengths), "paths")
    nodes = materialize(trie_nodes(paths, lengths), "nodes")
    children = nodes.where("up is not null").groupBy(F.col("up").alias("p"), F.col("uq").alias("q")).agg(F.count("*").alias("n_children"))
    own = nodes.join(children, ["p", "q"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    own = materialize(own.withColumns({"leaves": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("chars")}), "own")
    sums = subtree_sums(own, paths.select("conv", "depth", "p", "q", "up", "uq"), small)
    above = nodes.select(F.col("p").alias("up"), F.col("q").alias("uq"), F.col("conv_id").alias("parent_conv_id"))
    ends = ends_of(paths, lengths)
    out = own.join(sums.withColumnsRenamed({"leaves": "n_leaves", "saved": "saved_tokens"}), ["p", "q"]).join(ends, ["p", "q"], "left").join(above, ["up", "uq"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
