"""How filters interact: what each removes after which others, in every order.

1. One pass over the texts tests every filter. The ids that fail a filter are stored as
   that filter's own table (id, part, labels), one folder each, with one shuffle for the
   filter that compares texts.
2. What a filter removes depends on the set of filters before it, not on their order. The
   survivors of all sets are one relation (set, id): for one filter after the other, every
   set goes on without it and with it, and a left-anti join with the filter's table takes
   out the ids that fail it from the sets with it. So there is one join a filter, not one
   a set. Documents that fail nothing are in no join; they are counted by part.
3. A left-semi join of the survivors with a filter's table leaves what that filter removes
   next, after every set without it, with its label losses. These are added up by set,
   filter and part, at most 80 rows a part with five filters. Survivors, redundancies
   and shares of every order come from these sums.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations, permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, new_folder

#: So many orders are listed at most: 120 of five filters.
MOST_FILTERS = 5
#: Words of the contract: anything but space and \\t..\\r.
_GAPS = r"[\x20\x09-\x0D]+"


def text_filters(text: Column) -> dict[str, Column]:
    """Failure of the four filters that look at one text alone; null is an empty text."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    words = F.filter(F.split(text, _GAPS), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    return {"A": n < 200, "B": 100 * distinct < 50 * n, "C": 100 * capitals > 2 * F.length(text), "D": text.rlike(r"[#$%&*|]")}


def tested_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part: Column | str = "source") -> DataFrame:
    """(row, part, good, toxic, fails) of every row of ``docs``; fails names its filters.

    Filter E fails on a text that a smaller id has too, whatever other filters do: equal
    rows and rows of one id don't fail by each other, a null id never does. Null text is
    empty, and so equal to other empty ones; null part is ''. A document is good or toxic if
    any row of ``labels`` with its id has quality or toxic 1. Extra columns take no part.
    """
    text = F.col(text_col)
    facts = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("id"),
        F.coalesce((F.col(part) if isinstance(part, str) else part).cast("string"), F.lit("")).alias("part"),
        F.array_compact(F.array(*[F.when(failed, name) for name, failed in text_filters(text).items()])).alias("fails"),
        F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)).alias("digest"),
    )
    facts = materialize(facts, "facts")
    repeated = facts.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    one = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c)
    labelled = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(one("quality"), one("toxic"))
    again = F.coalesce(F.col("id") > F.col("first"), F.lit(False))
    flag = lambda c: F.coalesce(c, F.lit(False))
    joined = facts.join(repeated, "digest", "left").join(labelled, "id", "left")
    return materialize(joined.select("row", "part", flag("quality").alias("good"), flag("toxic").alias("toxic"), F.when(again, F.array_append("fails", F.lit("E"))).otherwise(F.col("fails")).alias("fails")), "tested")


class FailingIds:
    """One written table of failing ids for each filter."""

    def __init__(self, tested: DataFrame, filters: Sequence[str]):
        if len(set(filters)) != len(filters) or not 1 <= len(filters) <= MOST_FILTERS:
            raise ValueError(f"name 1 to {MOST_FILTERS} different filters")
        self.filters, self.tested = sorted(filters), tested
        rows = tested.select("row", "part", "good", "toxic", F.explode("fails").alias("filter"))
        self.folder = new_folder(tested.sparkSession, "failing")
        rows.write.partitionBy("filter").option("compression", "zstd").parquet(self.folder)
        self.all = tested.sparkSession.read.schema(rows.schema).parquet(self.folder)

    def of(self, name: str) -> DataFrame:
        return self.all.where(F.col("filter") == name).select("row")

    def survivors(self) -> DataFrame:
        """(row, part, good, toxic, before): every failing row with each set of filters that it passes, '' among them."""
        left = self.tested.where(F.size("fails") > 0).select("row", "part", "good", "toxic", F.lit("").alias("before"))
        for name in self.filters:
            left = left.select("row", "part", "good", "toxic", F.explode(F.array("before", F.concat("before", F.lit(name)))).alias("before"))
            failing = self.of(name).select(F.col("row").alias("row_"))
            left = left.join(failing, (F.col("row") == F.col("row_")) & F.endswith("before", F.lit(name)), "left_anti")
        return left

    def removals(self) -> DataFrame:
        """(part, key, n, good, toxic): what a filter removes after a set of others; key: '<set>><filter>'."""
        left = materialize(self.survivors(), "survivors")
        each = [left.where(~F.contains("before", F.lit(name))).join(self.of(name), "row", "left_semi").select("part", F.concat("before", F.lit(">" + name)).alias("key"), "good", "toxic") for name in self.filters]
        return reduce(DataFrame.unionAll, each).groupBy("part", "key").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))


def _orders(filters: Sequence[str]) -> list[Mapping]:
    """Every order and step: its own key, the keys of the path up to it, and for its
    filter's share each key with the number of orders that pass it."""
    key = lambda before, name: "".join(sorted(before)) + ">" + name
    n = len(filters)
    share = {f: [{"key": key(b, f), "n": factorial(k) * factorial(n - 1 - k)} for k in range(n) for b in combinations([x for x in filters if x != f], k)] for f in filters}
    out = []
    for order in permutations(filters):
        keys = [key(order[:k], f) for k, f in enumerate(order)]
        out += [{"filter_order": "".join(order), "step": k + 1, "own": keys[k], "alone": ">" + f, "last": key([x for x in filters if x != f], f), "path": keys[: k + 1], "share": share[f]} for k, f in enumerate(order)]
    return out


def audit(tested: DataFrame, filters: Sequence[str] = "ABCDE") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley) for every part, order and step, zeros included.

    ``tested`` is a written table as of ``tested_documents``; filters have names of one letter. A filter that
    nothing fails has zeros; a part of clean documents keeps all of them; an empty table
    has no parts and no rows.
    """
    removals = FailingIds(tested, filters).removals()
    sums = removals.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("key", F.struct("n", "good", "toxic")))).alias("sums"))
    parts = tested.groupBy("part").agg(F.count("*").alias("total")).join(sums, "part", "left")
    kind = "array<struct<filter_order:string,step:int,own:string,alone:string,last:string,path:array<string>,share:array<struct<key:string,n:bigint>>>>"
    each = parts.select("part", "total", "sums", F.explode(F.from_json(F.lit(json.dumps(_orders(sorted(filters)))), kind)).alias("o"))
    none = F.lit(0).cast("long")
    of = lambda key, what="n": F.coalesce(F.col("sums")[key][what], none)
    removed = of(F.col("o.own"))
    return each.select(
        "part",
        "o.filter_order",
        "o.step",
        (F.col("total") - F.aggregate("o.path", none, lambda s, k: s + of(k))).alias("kept"),
        removed.alias("removed"),
        (of(F.col("o.alone")) - removed).alias("redundant"),
        of(F.col("o.last")).alias("unique_fails"),
        of(F.col("o.own"), "good").alias("good_lost"),
        of(F.col("o.own"), "toxic").alias("toxic_lost"),
        F.aggregate("o.share", none, lambda s, x: s + x["n"] * of(x["key"])).alias("shapley"),
    )
