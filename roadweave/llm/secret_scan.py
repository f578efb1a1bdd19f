"""Secret scan with corpus-wide ownership frequency.

One pass finds candidates in every whole text: the base kinds (assign, access,
hex) and opaque tokens, which look random but carry no marker of their own.
Candidates go on as digests. A digest's owners and repositories are counted over
the whole corpus, pre-aggregated by (digest, owner, repository), so that a value
copied into a third of all texts reaches its task as one row per map task. A
value that many owners share is an example, and so is one that stands in several
repositories and in many texts an owner; another that a single owner has and that
looks random is live. Opaque tokens become spans only if they are live.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, ship_package

# The base patterns and their least lengths.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
LEAST_ASSIGN, LEAST_ACCESS = 6, 20

#: Kinds by number, in the order in which spans at one place are listed.
KINDS = ("assign", "access", "hex", "token")
#: An opaque token: so many characters at least, of upper case, lower case and digits, with so many bits of entropy a character.
LEAST_TOKEN, LEAST_ENTROPY = 20, 3.0
TOKEN = rf"[A-Za-z0-9+/_=-]{{{LEAST_TOKEN},}}"
#: A value of at most so many owners is owner-specific, one of at least so many an example.
MAX_LIVE_OWNERS, MIN_EXAMPLE_OWNERS = 1, 3
#: Within fewer owners a value of at least so many distinct repositories is an example too, if it stands in so many texts an owner.
MIN_EXAMPLE_REPOSITORIES, MIN_EXAMPLE_TEXTS = 3, 20

_PATTERNS = {0: re.compile(ASSIGN.encode(), re.IGNORECASE), 1: re.compile(ACCESS.encode()), 2: re.compile(HEX.encode()), 3: re.compile(TOKEN.encode())}
#: What a text must hold to be searched for a kind, for a linear-time matcher.
_MAY_HOLD = {0: r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", 1: "AKIA", 2: r"[0-9a-f]{24}", 3: r"[A-Za-z0-9+/_=-]{20}"}


def entropy(value: bytes) -> float:
    """Bits a character."""
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def opaque(value: bytes) -> bool:
    return len(value) >= LEAST_TOKEN and any(48 <= c < 58 for c in value) and any(65 <= c < 91 for c in value) and any(97 <= c < 123 for c in value) and entropy(value) >= LEAST_ENTROPY


def find(text: bytes, kinds: list[int]) -> list[tuple[int, int, int, bytes]]:
    """(start, kind, end, value) in bytes, in order of start and kind."""
    out: list[tuple[int, int, int, bytes]] = []
    for kind in kinds:
        if kind == 3:
            continue
        for m in _PATTERNS[kind].finditer(text):
            value = m[2] if kind == 0 else m[0]
            if kind == 0 and len(value) < LEAST_ASSIGN or kind == 1 and len(value) < LEAST_ACCESS:
                continue
            out.append((m.start(), kind, m.end(), value))
    out.sort()
    if 3 in kinds:
        base, at = out[:], 0
        ends = 0
        for m in _PATTERNS[3].finditer(text):
            while at < len(base) and base[at][0] < m.end():
                ends = max(ends, base[at][2])
                at += 1
            if ends > m.start() or not opaque(m[0]):
                continue  # overlaps a base span, or is no secret's form
            out.append((m.start(), 3, m.end(), m[0]))
        out.sort()
    return out


def in_code_points(text: bytes, found: list[tuple[int, int, int, bytes]]) -> list[tuple[int, int, int, bytes]]:
    if text.isascii():
        return found
    places, at, points = {}, 0, 0
    for p in sorted({x for s, _, e, _ in found for x in (s, e)}):
        points += len(text[at:p].decode())
        places[p], at = points, p
    return [(places[s], k, places[e], v) for s, k, e, v in found]


_CANDIDATE = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("digest", pa.binary()), ("random", pa.bool_())])


def _candidates(batches):
    for batch in batches:
        texts = batch.column(4)
        may = {k: pc.match_substring_regex(texts, p).fill_null(False).to_pylist() for k, p in _MAY_HOLD.items()}
        rows = []
        for i in range(len(texts)):
            kinds = [k for k in may if may[k][i]]
            if not kinds:
                rows.append([])
                continue
            text = texts[i].as_buffer().to_pybytes()
            rows.append([{"start": s, "kind": k, "end": e, "digest": hashlib.sha256(v).digest(), "random": entropy(v) >= LEAST_ENTROPY} for s, k, e, v in in_code_points(text, find(text, kinds))])
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(rows, pa.list_(_CANDIDATE))], names=["row", "id", "owner", "repository", "found"])


def ownership(
    candidates: DataFrame,
    max_live_owners: int = MAX_LIVE_OWNERS,
    min_example_owners: int = MIN_EXAMPLE_OWNERS,
    min_example_repositories: int = MIN_EXAMPLE_REPOSITORIES,
    min_example_texts: int = MIN_EXAMPLE_TEXTS,
) -> DataFrame:
    """(digest, n_owners, n_repositories, n_texts, n_uses, verdict) of candidate rows (row,
    digest, owner, repository, random). A null owner counts as one owner of its own."""
    texts = candidates.groupBy("digest", "owner", "repository", "row").agg(F.count("*").alias("n"), F.max("random").alias("random"))
    each = texts.groupBy("digest", "owner", "repository").agg(F.count("*").alias("n_texts"), F.sum("n").alias("n"), F.max("random").alias("random"))
    owners = each.groupBy("digest", "owner").agg(F.count("*").alias("n_repositories"), F.sum("n_texts").alias("n_texts"), F.sum("n").alias("n"), F.max("random").alias("random"))
    total = owners.groupBy("digest").agg(F.count("*").alias("n_owners"), F.sum("n_repositories").alias("n_repositories"), F.sum("n_texts").alias("n_texts"), F.sum("n").alias("n_uses"), F.max("random").alias("random"))
    copied = (F.col("n_repositories") >= min_example_repositories) & (F.col("n_texts") >= min_example_texts * F.col("n_owners"))
    verdict = F.when((F.col("n_owners") >= min_example_owners) | copied, "example").when((F.col("n_owners") <= max_live_owners) & F.col("random"), "live").otherwise("shared")
    return total.select("digest", "n_owners", "n_repositories", "n_texts", "n_uses", verdict.alias("verdict"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: Column | str = "source", repository: Column | str | None = None, **limits) -> DataFrame:
    """One row for each of ``docs``: id, base spans and all spans (start, kind, end in
    code points, by start and then kind), n_live and n_example candidates, and of
    every candidate by start and kind its place, verdict and counts (``counts``).

    Null or empty text: no spans. Every row is scanned for itself, repeated rows
    and ids too; copies within one repository stay owner-specific. An empty table
    gives no rows. Digests are of the values alone, so no secret leaves a task.
    """
    ship_package(docs.sparkSession)
    owner = F.col(owner) if isinstance(owner, str) else owner
    repository = owner if repository is None else F.col(repository) if isinstance(repository, str) else repository
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), owner.cast("string").alias("owner"), repository.cast("string").alias("repository"), F.col(text_col).cast("string").alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    span = "start:bigint,kind:int,end:bigint"
    found = materialize(rows.mapInArrow(_candidates, f"row bigint, id {id_type}, owner string, repository string, found array<struct<{span},digest:binary,random:boolean>>"), "candidates")
    each = found.where(F.size("found") > 0).select("row", "owner", "repository", F.explode("found").alias("c")).select("row", "owner", "repository", "c.*")
    judged = each.select("row", "start", "kind", "end", "digest").join(ownership(each, **limits), "digest")
    live_token = (F.col("kind") == 3) & (F.col("verdict") == "live")
    by_row = judged.groupBy("row").agg(
        F.count_if(F.col("verdict") == "live").alias("n_live"),
        F.count_if(F.col("verdict") == "example").alias("n_example"),
        F.collect_list(F.when(live_token, F.struct("start", "kind", "end"))).alias("added"),
        F.array_sort(F.collect_list(F.struct("start", "kind", "end", "verdict", "n_owners", "n_repositories", "n_texts", "n_uses"))).alias("counts"),
    )
    base = F.transform(F.filter("found", lambda c: c["kind"] < 3), lambda c: F.struct(c["start"], c["kind"], c["end"]))
    none = F.expr(f"cast(array() as array<struct<{span}>>)")
    uncounted = F.expr(f"cast(array() as array<struct<{span},verdict:string,n_owners:bigint,n_repositories:bigint,n_texts:bigint,n_uses:bigint>>)")
    return found.join(by_row, "row", "left").select(
        "id",
        base.alias("base"),
        F.array_sort(F.concat(base, F.coalesce("added", none))).alias("spans"),
        F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"),
        F.coalesce("n_example", F.lit(0)).cast("long").alias("n_example"),
        F.coalesce("counts", uncounted).alias("counts"),
        "row",
    )


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def counts_text(counts: Column) -> Column:
    """verdict:owners:repositories:texts:uses of each candidate, comma-joined."""
    said = lambda c: F.concat_ws(":", c["verdict"], *[c[n].cast("string") for n in ("n_owners", "n_repositories", "n_texts", "n_uses")])
    return F.array_join(F.transform(counts, said), ",")


def redact(docs: DataFrame, text_col: str = "text", placeholder: str = "[secret]", **names) -> DataFrame:
    """``docs`` with every span of ``scan`` replaced by ``placeholder``.

    Only texts that may hold a candidate are written, scanned and joined with
    their spans; the others pass through. Overlapping spans are replaced as one.
    Null and empty texts stay as they are, very long ones are searched whole, and
    equal rows and rows of one id are each redacted for themselves. All columns return,
    whatever their names; an empty table gives an empty one.
    """
    text = F.col(text_col)
    number = "__row"
    while number in map(str.lower, docs.columns):
        number += "_"
    may = F.coalesce(text.rlike("|".join(f"({p})" for p in _MAY_HOLD.values())), F.lit(False))
    columns = docs.columns
    held = materialize(docs.where(may).select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("doc")), "held")
    spans = scan(held.select("doc.*", F.col("row").alias(number)), id_col=number, text_col=text_col, **names).where(F.size("spans") > 0)
    own = F.col(f"doc.{text_col}")
    part = lambda start, n: F.substring(own, (start + 1).cast("int"), n.cast("int"))
    clean = F.aggregate(
        "spans",
        F.struct(F.lit("").alias("t"), F.lit(0).cast("long").alias("at")),
        lambda done, s: F.when(s["start"] >= done["at"], F.struct(F.concat(done["t"], part(done["at"], s["start"] - done["at"]), F.lit(placeholder)).alias("t"), s["end"].alias("at"))).otherwise(
            F.struct(done["t"].alias("t"), F.greatest(done["at"], s["end"]).alias("at"))
        ),
        lambda done: F.concat(done["t"], part(done["at"], F.length(own))),
    )
    joined = held.join(spans.select(F.col("id").alias("row"), "spans"), "row", "left")
    changed = F.when(F.col("spans").isNotNull(), clean).otherwise(own)
    return docs.where(~may).unionByName(joined.select(*[changed.alias(c) if c == text_col else F.col(f"doc.`{c}`") for c in columns]))
