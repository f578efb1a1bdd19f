"""Personal data: fixed patterns, and contexts learned from what they find.

Everything is DataFrame expressions. The fixed patterns (email, ip, card, phone)
give the seed entities. The words that stand before and after an entity are its
lexical patterns; how often those words occur at all, over the whole corpus, says
how surely they announce an identifier. On the graph between patterns and instances
(identifier-like tokens) scores are passed until no instance becomes sure any more:
a pattern is as sure as the share of its occurrences that stand beside known
identifiers, an instance as sure as its sure patterns together, and what is sure
stays so. Sure instances are found identifiers of kind ``context``.

Occurrences are counted exactly, by 64-bit hash, and only for the patterns that
stand beside enough different instances; no other word or pair is shuffled.
Patterns are whole words, however long: a word glued to an entity or broken
by the match before is none, as it isn't counted as a word of the corpus either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize
from .quality import normal, words_of

# The base patterns, written so that a failed attempt is not
# repeated from each of its characters, and repetition needs no recursion.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: A white-space token with a digit.
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"

#: Kinds by number, in the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone", "context")
#: Code points of a gap in which two whole words are looked for first; where there are fewer, the whole gap is searched.
NEAR = 48
_S, _W = r"[\x20\x09-\x0D]++", r"[^\x20\x09-\x0D]++"
#: At most so many patterns are broadcast to count them; more are joined after their counts are shuffled.
MOST_BROADCAST = 1_000_000
#: A pattern needs so many different known instances and such a share of its occurrences, an instance such a score.
LEAST_SUPPORT, LEAST_SHARE, LEAST_SCORE = 5, 0.5, 0.8
#: An instance has so many code points and digits.
LEAST_LENGTH, LEAST_DIGITS = 6, 4


def _words_before(gap: Column, first: Column) -> Column:
    """The last two words of a gap with what stands after each, if white space ends it; a word that is glued to the match before is none."""
    near = F.regexp_extract(F.right(gap, F.lit(NEAR)), rf"(?<=[\x20\x09-\x0D])(?:{_W}{_S}){{2}}$", 0)
    whole = F.when(first, gap).otherwise(F.regexp_replace(gap, rf"^{_W}", ""))
    return F.when(near != "", near).otherwise(F.regexp_extract(whole, rf"(?<![^\x20\x09-\x0D])(?:{_W}{_S}){{1,2}}$", 0))


def _words_after(gap: Column, last: Column) -> Column:
    """The first two words of a gap with what stands before each, if white space begins it; a word that is glued to the next match is none."""
    found = F.regexp_extract(gap, rf"^{_S}{_W}(?:{_S}{_W})?", 0)
    return F.when(last | (F.length(found) < F.length(gap)), found).otherwise(F.regexp_replace(found, rf"(?<![^\x20\x09-\x0D]){_W}$", ""))


def _matches(text: Column, pattern: str, kind: int) -> Column:
    """Every match with the length of the gap before it and the text around it."""
    both = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    return F.element_at(
        F.transform(
            F.array(both),
            lambda t: F.transform(
                t["hits"],
                lambda h, i: F.struct(
                    F.lit(kind).alias("kind"),
                    i.alias("at"),
                    F.length(F.get(t["gaps"], i)).alias("gap"),
                    h.alias("value"),
                    _words_before(F.get(t["gaps"], i), i == 0).alias("left"),
                    _words_after(F.get(t["gaps"], i + 1), i + 2 == F.size(t["gaps"])).alias("right"),
                ),
            ),
        ),
        1,
    )


def _holds(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, r"[^0-9]", "")
    n = F.length(digits)
    return (
        F.when(kind == 0, True)
        .when(kind == 1, value.rlike(r"^0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(\.0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$"))
        .when(kind == 2, n.between(13, 19) & F.call_function("luhn_check", digits))
        .when(kind == 3, n.between(9, 15))
        .otherwise((F.length(value) >= LEAST_LENGTH) & (n >= LEAST_DIGITS))
    )


def candidates(text: Column) -> Column:
    """All matches of a text, before their places and validity are known."""
    text = F.coalesce(text, F.lit(""))
    none = F.expr("cast(array() as array<struct<kind:int,at:int,gap:int,value:string,left:string,right:string>>)")
    maybe = lambda test, kind, pattern: F.when(test, _matches(text, pattern, kind)).otherwise(none)
    digit = text.rlike("[0-9]")
    return F.concat(
        maybe(F.contains(text, F.lit("@")), 0, EMAIL),
        F.when(digit, F.concat(maybe(F.contains(text, F.lit(".")), 1, IP), _matches(text, CARD, 2), maybe(F.contains(text, F.lit("+")), 3, PHONE), _matches(text, TOKEN, 4))).otherwise(none),
    )


def matches(found: DataFrame) -> DataFrame:
    """(row, kind, start, end, value, left, right) of all matches that hold, given (row,
    found); kind 4 are identifier-like tokens that meet no match of the base kinds."""
    each = found.where(F.size("found") > 0).select("row", F.explode("found").alias("m")).select("row", "m.*")
    placed = each.withColumn("end", F.sum(F.col("gap") + F.length("value")).over(Window.partitionBy("row", "kind").orderBy("at")))
    placed = placed.withColumn("start", F.col("end") - F.length("value"))
    # tokens lose the punctuation around them
    token = F.col("kind") == 4
    lead = F.length(F.regexp_extract("value", r"^[\"'(\[<{.,;:!?]*+", 0))
    bare = F.regexp_replace(F.regexp_replace("value", r"^[\"'(\[<{.,;:!?]++", ""), r"(?<![\"')\]>}.,;:!?])[\"')\]>}.,;:!?]++$", "")
    placed = placed.withColumn("start", F.when(token, F.col("start") + lead).otherwise(F.col("start"))).withColumn("value", F.when(token, bare).otherwise(F.col("value")))
    placed = placed.withColumn("end", F.when(token, F.col("start") + F.length("value")).otherwise(F.col("end")))
    held = placed.where(_holds(F.col("kind"), F.col("value"))).select("row", "kind", "start", "end", "value", "left", "right")
    order = Window.partitionBy("row").orderBy("start", "kind")
    base = F.col("kind") < 4
    before = F.max(F.when(base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(base, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    beside = held.withColumn("before", before).withColumn("after", after)
    clear = (F.coalesce("before", F.lit(0)) <= F.col("start")) & (F.coalesce("after", F.col("end")) >= F.col("end"))
    return beside.where(base | clear).drop("before", "after")


def _patterns(left: Column, right: Column) -> Column:
    """The last word and the last two words before an entity, and the first ones
    after it, as (context, after): the hash of the words, and their side."""
    none = F.expr("cast(array() as array<string>)")
    split = lambda text: F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    before = F.when(left.rlike(r"[\x20\x09-\x0D]$"), split(left)).otherwise(none)
    after = F.when(right.rlike(r"^[\x20\x09-\x0D]"), split(right)).otherwise(none)
    found = []
    for words, ends, side in ((before, (-1, -2), False), (after, (1, 2), True)):
        one, two = F.try_element_at(words, F.lit(ends[0])), F.try_element_at(words, F.lit(ends[1]))
        both = (one, two) if side else (two, one)
        found += [F.when(one.isNotNull(), F.struct(_context(one).alias("context"), F.lit(side).alias("after"))), F.when(two.isNotNull(), F.struct(_context(*both).alias("context"), F.lit(side).alias("after")))]
    return F.filter(F.array(*found), lambda p: p.isNotNull())


def _context(*words: Column) -> Column:
    """A context's hash."""
    return F.xxhash64(*words, F.lit(len(words)))


def context_counts(docs: DataFrame, contexts: DataFrame, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(context, total): occurrences in all texts of the words and pairs of neighbours that are among ``contexts``, which are distinct."""
    words = words_of(F.lower(normal(F.col("text"))))
    rows = docs.select(words.alias("words"))
    both = F.concat(F.transform("words", lambda w: _context(w)), F.zip_with("words", F.slice("words", 2, F.size("words") + 1), lambda a, b: F.when(b.isNotNull(), _context(a, b))))
    each = rows.select(F.explode(both).alias("context")).where("context is not null")
    count = F.count("*").alias("total")
    if contexts.count() <= most_broadcast:
        return each.join(F.broadcast(contexts), "context", "left_semi").groupBy("context").agg(count)
    return each.groupBy("context").agg(count).join(contexts, "context", "left_semi")


def sure_instances(found: DataFrame, docs: DataFrame) -> DataFrame:
    """(instance, score) of the identifier-like tokens that the graph makes sure."""
    seed = F.col("kind") < 4
    key = ["context", "after"]
    edges = found.select(F.xxhash64("value").alias("instance"), seed.alias("seed"), F.explode(_patterns(F.col("left"), F.col("right"))).alias("p")).select("instance", "seed", "p.*")
    edges = materialize(edges.groupBy(*key, "instance").agg(F.count("*").alias("n"), F.max("seed").alias("seed")), "edges")
    patterns = materialize(edges.groupBy(*key).agg(F.count("*").alias("instances")).where(F.col("instances") >= LEAST_SUPPORT).select(*key), "patterns")
    total = materialize(context_counts(docs, patterns.select("context").distinct()), "totals")
    # only patterns with enough instances can become sure
    live = materialize(edges.join(patterns, key, "left_semi").join(total, "context"), "edges")
    sure, before = None, 0
    while True:
        if sure is None:
            scored = live.withColumn("s", F.col("seed").cast("double"))
        else:
            scored = live.join(sure, "instance", "left").withColumn("s", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("score", F.lit(0.0)))).drop("score")
        known = scored.groupBy(*key).agg((F.sum(F.col("n") * F.col("s")) / F.first("total")).alias("share"), F.count_if(F.col("s") >= LEAST_SCORE).alias("support"))
        known = known.where((F.col("share") >= LEAST_SHARE) & (F.col("support") >= LEAST_SUPPORT)).select(*key, F.least("share", F.lit(0.999)).alias("share"))
        by_instance = live.where("not seed").join(known, key).groupBy("instance").agg((1 - F.exp(F.sum(F.log1p(-F.col("share"))))).alias("score"))
        now = by_instance.where(F.col("score") >= LEAST_SCORE)
        if sure is not None:
            now = now.unionByName(sure).groupBy("instance").agg(F.max("score").alias("score"))
        sure = materialize(now, "sure")
        n = sure.count()
        if n == before:
            return sure
        before = n


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, spans) for every row of ``docs``: base spans and all spans as arrays of
    (kind, start, end), code points, end exclusive, by kind and start.

    Null or empty text: none. Every row is searched for itself, repeated rows and
    ids too, and very long texts whole. Extra columns of ``docs``, whatever their
    names, take no part. An empty table gives no rows.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    held = materialize(rows.select("row", "id", candidates(F.col("text")).alias("found")), "candidates")
    found = materialize(matches(held.select("row", "found")), "found")
    sure = sure_instances(found, rows)
    extra = found.where("kind = 4").withColumn("instance", F.xxhash64("value")).join(sure, "instance").select("row", "kind", "start", "end")
    spans = found.where("kind < 4").select("row", "kind", "start", "end").unionByName(extra)
    by_row = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("spans"))
    none = F.expr("cast(array() as array<struct<kind:int,start:bigint,end:bigint>>)")
    joined = held.select("id", "row").join(by_row, "row", "left").select("id", F.coalesce("spans", none).alias("spans"))
    return joined.select("id", F.filter("spans", lambda s: s["kind"] < 4).alias("base"), "spans")


def spans_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
