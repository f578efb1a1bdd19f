"""MinHash near-duplicate detection with sequential Bayesian verification.

1. One pass over the texts: distinct word shingles as 64-bit hashes, a digest of
   the set, the keys of the bands of ``N_HASHES`` min-hashes, and the first
   ``COMPARED`` of these.
   They are chosen so that a pair at the threshold shares no band with a
   probability of ``UNBANDED`` at most, and a more similar one with less.
2. Texts with equal sets collapse to one class (aggregated by digest).
3. Classes that share a band key form a bucket, and a bucket never emits all its
   pairs. Each member is compared with one centre first; that joins most copies.
   The members of buckets that stay apart then order their shingles by how many of
   these members have them, rarest first. Two sets at the threshold share one of
   the first n - ceil(t n) + 1 shingles of either, and at its places enough must be
   left for the overlap that is asked for; a pair that fails this can't be similar,
   so nothing is lost. Lists of members by such a shingle are again compared with
   the member with the most links, and then with ``CENTRES`` at a time, until few
   pairs are left between components or such a round joins little. What is left
   meets by shingle and by the sizes of both sets, and a member is in a list for a
   size only as far up in its order as a similar set of that size allows: of a
   family of loose copies, whose own rare shingles come first, none meet.
4. A candidate's signatures are compared in batches of ``BATCH`` hashes. After
   each, the pair is dropped if the posterior probability of a similarity at the
   threshold or above (uniform prior) is under ``MISS``.
5. Survivors are verified on the full shingle sets. Verified links merge components.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import NOT_SPACE, Words, blocks, materialize, mix64, ship_package

SHINGLE = 5
SIMILARITY_PERCENT = 80
N_HASHES = 256
UNBANDED = 1e-4
BATCH = 32
#: Hashes of a signature that verification compares at most.
COMPARED = 128
#: A counted list of ids is broadcast to its join up to so many bytes, at so many a row in a join's table; a longer one is shuffled.
MAX_BROADCAST, ROW_BYTES = 32 << 20, 64
#: Posterior probability of being similar below which a candidate is dropped.
MISS = 1e-6
#: Centres of a list in each round. Rounds end when so few pairs a row
#: of the lists are left between components, or when one leaves more than that share of them.
CENTRES, FEW, WORTH = 8, 4, 0.8
#: Sizes of sets fall into classes, each so much wider than the one before.
CLASS = 1.04
#: Columns of the min-hash product that are held at once.
COLUMNS = 4096

_FACTORS = mix64(np.arange(1, N_HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_BAND_FACTORS = mix64(np.arange(1, N_HASHES + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)


def shingle_sets(texts: pa.Array, size: int = SHINGLE):
    """Sorted distinct shingle hashes of each text, in order. Fewer words than
    ``size``: all of them as one shingle; no words: an empty set."""
    split = Words(NOT_SPACE)
    parts = mix64(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
    for _, data, offsets in blocks(texts):
        starts, ends, counts = split.spans(data, offsets)
        words = split.hashes(data, starts, ends)
        n = max(0, len(words) - size + 1)
        grams = np.zeros(n, np.uint64)
        for k in range(size):
            grams += words[k : k + n] * parts[k]
        grams = mix64(grams)
        at = 0
        for count in counts.tolist():
            if count >= size:
                yield np.unique(grams[at : at + count - size + 1])
            elif count:
                yield mix64(np.array([(words[at : at + count] * parts[:count]).sum(dtype=np.uint64) ^ np.uint64(count)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)
            at += count


def signature(grams: np.ndarray) -> np.ndarray:
    best = np.full(N_HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), COLUMNS):
        np.minimum(best, (_FACTORS[:, None] * grams[None, at : at + COLUMNS]).min(axis=1), out=best)
    return (best >> np.uint64(32)).astype(np.uint32)


def banding(percent: int, unbanded: float = UNBANDED) -> tuple[int, int]:
    """(bands, rows): the longest bands with which a pair at the threshold is found."""
    for rows in range(N_HASHES, 1, -1):
        bands = N_HASHES // rows
        if (1 - (percent / 100) ** rows) ** bands <= unbanded:
            return bands, rows
    return N_HASHES, 1


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    banded = signatures[:, : bands * rows].reshape(len(signatures), bands, rows).astype(np.uint64)
    mixed = mix64(banded + np.uint64(1)) * _BAND_FACTORS[:rows]
    return mix64(mixed.sum(axis=2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _signed(size: int, bands: int, rows: int):
    def run(batches):
        for batch in batches:
            digests, counts, signatures, keys = [], [], [], []
            for grams in shingle_sets(batch.column(1), size):
                counts.append(len(grams))
                if len(grams):
                    digests.append(xxhash.xxh3_128_digest(grams.tobytes()))
                    sig = signature(grams)
                    signatures.append(sig[:COMPARED].tobytes())
                    keys.append(sig)
                else:
                    digests.append(None)
                    signatures.append(None)
            banded = iter(band_keys(np.array(keys), bands, rows).tolist() if keys else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary()), pa.array([next(banded) if d else None for d in digests], pa.list_(pa.int64()))],
                names=["id", "row", "n_shingles", "digest", "sig", "keys"],
            )

    return run


def _sets(size: int):
    def run(batches):
        for batch in batches:
            made = list(shingle_sets(batch.column(0), size))
            same = [xxhash.xxh3_128_digest(g.tobytes()) == d for g, d in zip(made, batch.column(2).to_pylist(), strict=True)]
            table = pa.RecordBatch.from_arrays([batch.column(1), pa.array([g.view(np.int64) for g in made], pa.list_(pa.int64()))], names=["node", "grams"])
            yield table.filter(pa.array(same, pa.bool_()))

    return run


def least_matches(percent: int, miss: float, n_hashes: int = COMPARED, batch: int = BATCH) -> list[tuple[int, int]]:
    """(hashes compared, fewest matches to go on): with m of n equal and a uniform
    prior, P(similarity >= t) = P(Binomial(n + 1, t) <= m)."""
    t, out = percent / 100, []
    for n in range(batch, n_hashes + 1, batch):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append((n, m))
    return out


def _lists(column: pa.Array) -> list[np.ndarray]:
    """The lists of a column, without copying."""
    offsets = column.offsets.to_numpy()
    return np.split(column.values.to_numpy()[: offsets[-1]], offsets[1:-1]) if len(column) else []


def _pruned(bounds: list[tuple[int, int]]):
    """Pairs with a common band that the batches of their signatures leave."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sigs = [np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint32).reshape(-1, COMPARED) for k in (2, 3)]
            keys = [np.stack(_lists(batch.column(k))) for k in (4, 5)]
            live, at = np.flatnonzero((keys[0] == keys[1]).any(axis=1)), 0
            matches = np.zeros(batch.num_rows, np.int64)
            for n, least in bounds:
                matches[live] += (sigs[0][live, at:n] == sigs[1][live, at:n]).sum(axis=1)
                live, at = live[matches[live] >= least], n
            kept = pa.array(live)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(kept), batch.column(1).take(kept)], names=["a", "b"])

    return run


def _verified(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(_lists(batch.column(2)), _lists(batch.column(3)), strict=True):
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return run


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``links``; root is the least node of its component.

    Alternating large-star and small-star steps; each is an aggregation and a
    join by node, so that a node with very many links is pre-aggregated and its
    join can be split. Every step is written, and the loop ends when a step
    changes nothing; only counts reach the driver.
    """
    edges = materialize(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    if edges.isEmpty():
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges = materialize(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.countDistinct("u")).first()
        if now == state:
            break
        state = now
        if now[0] == now[2] and edges.join(edges.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty():
            break  # every node has one link, and to a root
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = SIMILARITY_PERCENT, miss: float = MISS) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of ``docs``.

    Documents are linked if 100 * |A & B| >= percent * |A | B| for their shingle
    sets; component_id is the smallest id reachable, kept is id = component_id.
    Null or empty text, or one without words: an empty set, linked with nothing
    (repeated ids included). Rows with one id and one text are one document, and
    each of them returns; rows with one id and different texts are compared as
    different texts. A null id is kept only if alone. An empty table gives none.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    numbered = rows.select("id", "text", F.monotonically_increasing_id().alias("row"))
    signed = materialize(numbered.mapInArrow(_signed(shingle, *banding(percent)), f"id {id_type}, row bigint, n_shingles bigint, digest binary, sig binary, keys array<bigint>"), "signed")
    # a class is named by the row of its smallest id
    least = signed.where("digest is not null").groupBy("digest").agg(F.min(F.struct("id", "row")).alias("first"), F.first("n_shingles").alias("n"))
    classes = materialize(least.select("digest", F.col("first.id").alias("first_id"), F.col("first.row").alias("node"), "n"), "classes")
    roots = _components(rows, signed, classes, shingle, percent, miss)
    named = classes.select("node", "digest", "first_id").join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("root"), "first_id")
    names = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_digest = named.join(names, "root").select("digest", "component_id")
    return (
        signed.select("id", "n_shingles", "digest")
        .join(by_digest, "digest", "left")
        .select("id", "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
        .withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
    )


def _small(table: DataFrame) -> DataFrame:
    """A written table of ids, to be broadcast if it is counted and found small."""
    return F.broadcast(table) if table.count() * ROW_BYTES <= MAX_BROADCAST else table


def _components(rows: DataFrame, signed: DataFrame, classes: DataFrame, shingle: int, percent: int, miss: float) -> DataFrame:
    """(node, root) of the classes that share a bucket with others."""
    keyed = signed.select(F.col("row").alias("node"), "keys").join(classes.select("node", F.col("n").cast("int").alias("n")), "node").select("node", "n", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key")
    buckets = materialize(keyed.join(shared, "key").select("key", "node", "n"), "buckets")
    nodes = _small(materialize(buckets.select("node").distinct(), "nodes"))
    held = materialize(signed.select(F.col("row").alias("node"), "sig", "keys").join(nodes, "node", "left_semi"), "held")
    wanted = _small(materialize(classes.join(nodes, "node", "left_semi").select(F.col("first_id").alias("id"), "node", "digest"), "wanted"))
    named = rows.join(wanted, rows["id"].eqNullSafe(wanted["id"])).select("text", "node", "digest")
    grams = materialize(named.mapInArrow(_sets(shingle), "node bigint, grams array<bigint>").dropDuplicates(["node"]), "grams")
    search = _Search(held, grams, percent, miss)

    # every member of a bucket with its centre; the smallest hash, so that buckets with the same members have the same centre
    order = F.struct(F.xxhash64("node").alias("h"), "node", "n")
    centres = materialize(buckets.groupBy("key").agg(F.min(order).alias("c")).select("key", F.col("c.node").alias("centre"), F.col("c.n").alias("m")), "centres")
    near = (F.col("node") != F.col("centre")) & (100 * F.least("n", "m") >= percent * F.greatest("n", "m"))
    search.compare(buckets.join(centres, "key").where(near).select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")))

    marked = buckets.join(search.roots, "node")
    apart = marked.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    members = materialize(marked.join(apart, "key", "left_semi").select("node").distinct(), "members")
    if members.isEmpty():
        return search.roots
    lists = materialize(_prefixes(grams.join(members, "node", "left_semi"), percent), "prefixes")
    seed, before = 0, math.inf
    while True:
        own = materialize(lists.join(search.roots, "node"), "lists")
        between = _pairs_between(own)
        if between <= FEW * own.count() or between > WORTH * before:
            break
        before = between
        # centres with few rare shingles before the list's own are near to what its members come from; ever coarser, to vary them
        orders = [F.struct((-F.shiftright("at", k)).alias("rare"), F.xxhash64("node", F.lit(seed + k)).alias("h")) for k in range(CENTRES)]
        found = own.groupBy("gram").agg(F.array_distinct(F.array(*[F.max_by(F.struct("node", "n", "at", "root"), o) for o in orders])).alias("c"), F.min("root").alias("low"), F.max("root").alias("high"))
        each = found.where("low <> high").select("gram", F.explode("c").alias("c"))
        centres = materialize(each.select("gram", *[F.col(f"c.{x}").alias(f"{x}_") for x in ("node", "n", "at", "root")]), "centres")
        search.compare(own.join(centres, "gram").where(_possible(percent)).select(F.least("node", "node_").alias("a"), F.greatest("node", "node_").alias("b")))
        seed += CENTRES
    search.compare(_met(own, percent).where(_possible(percent)).select(F.least("node", "node_").alias("a"), F.greatest("node", "node_").alias("b")))
    return search.roots


def _pairs_between(lists: DataFrame) -> int:
    """At most so many pairs of members of one list are in different components."""
    each = lists.groupBy("gram", "root").agg(F.count("*").alias("c"))
    by_list = each.groupBy("gram").agg(((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))) / 2).alias("pairs"))
    return by_list.agg(F.sum("pairs")).first()[0] or 0


def _possible(percent: int) -> Column:
    """Whether two members of a list can be similar, if its shingle is the first that they
    share: they are in different components, and enough is left of both from there on."""
    left = F.least(F.col("n") - F.col("at"), F.col("n_") - F.col("at_"))
    return (F.col("root") != F.col("root_")) & (100 * F.least("n", "n_") >= percent * F.greatest("n", "n_")) & ((100 + percent) * left >= percent * (F.col("n") + F.col("n_")))


def _met(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs of members of a list, the second (``_``) in the same or a larger class of sizes, that share the
    list's shingle at places that leave enough of either for a similar set of the other's size.

    Members of the component that most of a list belongs to meet only the others of the list,
    so no more meet than about the pairs between components."""
    t = percent / 100
    of = lambda n: F.floor(F.log(n) / math.log(CLASS)).cast("int")
    least = F.floor(F.pow(F.lit(CLASS), F.col("other")))  # no set of that class is smaller
    fits = F.col("at") <= F.col("n") - t / (1 + t) * (F.col("n") + least) + 1e-6
    classed = lists.withColumn("own", of(F.col("n")))
    small = classed.withColumn("other", F.explode(F.sequence("own", of(F.col("n") / t) + 1))).where(fits)
    large = classed.withColumn("other", F.explode(F.sequence(of(F.greatest(F.lit(1.0), F.col("n") * t)), "own"))).where(fits)
    large = large.select("gram", F.col("other").alias("own"), F.col("own").alias("other"), "node", "n", "at", "root")
    key = ["gram", "own", "other"]
    each = small.select(*key, "root").unionByName(large.select(*key, "root")).groupBy(*key, "root").agg(F.count("*").alias("c"))
    most = each.groupBy(*key).agg(F.max_by("root", F.struct("c", "root")).alias("most"), F.count("*").alias("roots")).where("roots > 1").select(*key, "most")
    inside = F.col("root") == F.col("most")
    left = small.join(most, key).withColumn("with", inside.cast("int")).drop("most")
    right = large.join(most, key).withColumn("with", F.explode(F.when(inside, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))))
    right = right.select(*key, "with", *[F.col(x).alias(f"{x}_") for x in ("node", "n", "at", "root")])
    return left.join(right, [*key, "with"]).where("own <> other or node < node_")


def _prefixes(grams: DataFrame, percent: int) -> DataFrame:
    """(gram, node, n, at) of the shingles of each set that a similar one must share.

    Shingles are in order of the number of sets that have them, then of their
    hash; ``at`` is a shingle's place in that order. Those of one set alone come
    first; they count for the places of the others and have no rows.
    """
    each = grams.select("node", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    common = materialize(each.groupBy("gram").agg(F.count("*").alias("f")).where("f > 1"), "frequencies")
    own = each.join(common, "gram")
    of = Window.partitionBy("node")
    own = own.withColumn("at", F.col("n") - F.count("*").over(of) + F.row_number().over(of.orderBy("f", "gram")) - 1)
    return own.where(F.col("at") <= F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100)).select("gram", "node", "n", F.col("at").cast("int").alias("at"))


class _Search:
    """The components of the links verified so far."""

    def __init__(self, held: DataFrame, grams: DataFrame, percent: int, miss: float):
        self.held, self.grams, self.percent, self.bounds = held, grams, percent, least_matches(percent, miss)
        self.roots = held.select("node", F.col("node").alias("root"))

    def compare(self, pairs: DataFrame) -> None:
        """Prune and verify candidate pairs, and merge the components of those that hold."""
        fresh = materialize(pairs.distinct(), "pairs")
        pending = materialize(_with_both(fresh, self.held, ["sig", "keys"]).mapInArrow(_pruned(self.bounds), "a bigint, b bigint"), "pending")
        held = materialize(_with_both(pending, self.grams, ["grams"]).mapInArrow(_verified(self.percent), "a bigint, b bigint"), "links")
        if held.isEmpty():
            return
        of = lambda side: self.roots.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root"))
        between = held.join(of("a"), "a").join(of("b"), "b").select("a_root", "b_root").where("a_root <> b_root")
        moved = connected_components(between, "a_root", "b_root").select(F.col("node").alias("root"), F.col("root").alias("to"))
        self.roots = materialize(self.roots.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots")


def _with_both(pairs: DataFrame, values: DataFrame, names: list[str]) -> DataFrame:
    """(a, b, and each value of a and of b) of written pairs. Only values of nodes in the
    pairs are moved, as long as the pairs are few enough to be broadcast."""
    of = lambda side: values.select(F.col("node").alias(side), *[F.col(x).alias(f"{x}_{side}") for x in names])
    left = of("a").join(_small(materialize(pairs.select("a").distinct(), "side")), "a", "left_semi")
    right = _small(pairs).join(of("b"), "b")
    return right.join(left, "a").select("a", "b", *[f"{x}_{side}" for x in names for side in ("a", "b")])


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """``docs`` with the document of the smallest id of each component of near-duplicates.

    Rows with one id stay or go together; rows without an id stay.
    """
    gone = near_duplicates(docs, id_col, text_col, **parameters).where("not kept").select(F.col("id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)
