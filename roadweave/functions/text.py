"""Noisy-key text functions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .traffic import c, clip, half_up

# State codes, confusable characters, words that are never a key.
STATES = ("TN", "KA", "MH", "DL", "KL", "AP", "TS", "HR", "UP", "WB", "GJ", "RJ", "MP", "PB", "PY", "CH", "OD", "CG", "UK", "JH", "BR")
TO_LETTER = ("0185", "OIBS")
TO_DIGIT = ("OQILSBZA", "00115824")
PREFIXES = {"1N": "TN", "IN": "TN", "TH": "TN", "7N": "TN", "K1": "KA", "K4": "KA", "M1": "MH", "M0": "MH", "D1": "DL"}
NOISE = "INVALID|ERROR|TEST|UNKNOWN|NONE"
CONFUSED = ("OISBZ", "01582")


def key(x) -> Column:
    """Upper case without spaces and hyphens; null is empty."""
    return F.trim(F.regexp_replace(F.upper(F.coalesce(c(x), F.lit(""))), "[ -]", ""))


def folded(x) -> Column:
    """Confusable letters become their digits."""
    return F.translate(key(x), *CONFUSED)


def normalize(x) -> Column:
    """Position-aware repair of a noisy key."""
    up = F.trim(F.upper(F.coalesce(c(x), F.lit(""))))
    plain = F.regexp_replace(up, r"[^A-Z0-9\s]", "")
    rest = F.trim(F.regexp_replace(plain, r"^(IND|INDIA)\s*", ""))
    bare = F.regexp_replace(F.when(F.length(rest) >= 8, rest).otherwise(plain), r"\s+", "")
    tail = F.substring(bare, 2, 12)
    noisy_lead = F.substring(bare, 1, 1).isin("P", "F", "E") & ~F.substring(bare, 1, 2).isin(*STATES) & (F.substring(tail, 1, 2).isin(*STATES) | tail.rlike("^[A-Z]{2,3}[0-9]{2,4}$"))
    n = F.length(bare)
    lead = F.substring(bare, 1, 2)
    known = F.create_map(*[F.lit(v) for kv in PREFIXES.items() for v in kv])
    state = F.coalesce(F.try_element_at(known, lead), F.translate(lead, *TO_LETTER))
    fixed = F.concat(
        state,
        F.translate(F.substring(bare, 3, 2), *TO_DIGIT),
        F.translate(F.substring(bare, F.lit(5), n - 8), *TO_LETTER),
        F.translate(F.substring(bare, n - 3, F.lit(4)), *TO_DIGIT),
    )
    return F.when(up.rlike(NOISE), up).when(n.between(5, 7), F.when(noisy_lead, tail).otherwise(bare)).when((n < 8) | (n > 11), bare).otherwise(fixed)


def validate(x) -> Column:
    """(status, confidence) of a key's format."""
    t = F.regexp_replace(F.upper(F.coalesce(c(x), F.lit(""))), r"[ .-]", "")
    n = F.length(t)
    level = lambda status, p: F.struct(F.lit(status).alias("status"), F.lit(p).alias("confidence"))
    return (
        F.when((n < 5) | (n > 12) | F.contains(t, F.lit("INVALID")), level("INVALID", 0.0))
        .when(t.rlike("^[A-Z]{2}[0-9]{2}[A-Z]{1,3}[0-9]{4}$"), level("VALID", 0.95))
        .when(F.substring(t, 1, 2).isin(*STATES) & (n >= 8) & t.rlike("^..[0-9]{2}.*[0-9]{4}$"), level("UNCERTAIN", 0.65))
        .when(t.rlike("[0-9]") & t.rlike("[A-Z]"), level("FORMAT_MISMATCH", 0.40))
        .otherwise(level("INVALID", 0.1))
    )


def strip_candidates(x) -> Column:
    """The text and what is left of it without one or two leading characters, where that looks like a short key."""
    t = c(x)
    cut = F.array(F.substring(t, 2, 20), F.substring(t, 3, 20))
    good = F.filter(cut, lambda s: F.length(s).between(5, 6) & s.rlike("^[A-Z]{2,3}[0-9]+$"))
    return F.when(F.length(t) >= 7, F.array_distinct(F.concat(F.array(t), good))).otherwise(F.array(t))


def confusion_distance(a, b, penalty: float = 0.5) -> Column:
    """Edit distance in which confusable characters cost ``penalty``; rows of the
    table are folded one after the other."""
    x, y = F.split(c(a), ""), F.split(c(b), "")
    fold = lambda ch: F.translate(ch, *CONFUSED)
    first = F.transform(F.sequence(F.lit(0), F.length(c(b))), lambda i: i.cast("double"))

    def next_row(row: Column, left: Column) -> Column:
        start = F.struct(F.array(F.element_at(row, 1) + 1.0).alias("cells"))
        return F.aggregate(
            F.sequence(F.lit(1), F.length(c(b))),
            start,
            lambda done, j: F.struct(
                F.concat(
                    done["cells"],
                    F.array(
                        F.least(
                            F.element_at(row, j + 1) + 1.0,
                            F.element_at(done["cells"], -1) + 1.0,
                            F.element_at(row, j) + F.when(left == F.element_at(y, j), 0.0).when(fold(left) == fold(F.element_at(y, j)), penalty).otherwise(1.0),
                        )
                    ),
                ).alias("cells")
            ),
            lambda done: done["cells"],
        )

    full = F.element_at(F.aggregate(x, first, next_row), -1)
    return F.when(F.length(c(a)) == 0, F.length(c(b)).cast("double")).when(F.length(c(b)) == 0, F.length(c(a)).cast("double")).otherwise(full)


def key_similarity(a, b) -> Column:
    """Share of equal positions; unknown is 0.5, different states are nearly 0."""
    x, y = key(a), key(b)
    unknown = lambda t: (t == "") | (t == "UNKNOWN")
    same = F.aggregate(F.sequence(F.lit(1), F.least(F.length(x), F.length(y))), F.lit(0), lambda n, i: n + F.when(F.substring(x, i, F.lit(1)) == F.substring(y, i, F.lit(1)), 1).otherwise(0))
    share = half_up(same / F.greatest(F.length(x), F.length(y)), 3)
    return F.when(unknown(x) | unknown(y), 0.5).when(x == y, 1.0).when(F.substring(x, 1, 2) != F.substring(y, 1, 2), F.least(F.lit(0.05), 0.1 * share)).otherwise(share)


def is_subsequence(short, long) -> Column:
    """All characters of one text occur in the other in order."""
    s = c(short)
    reached = F.aggregate(F.split(c(long), ""), F.lit(1), lambda i, ch: F.when(F.substring(s, i, F.lit(1)) == ch, i + 1).otherwise(i))
    return (F.length(s) == 0) | (reached > F.length(s))


def evidence_score(confidence, validity, quality) -> Column:
    part = lambda x: F.coalesce(c(x), F.lit(0.5))
    return clip(0.45 * part(confidence) + 0.30 * part(validity) + 0.25 * part(quality), 0.05, 1)


def alias_of(a, b) -> Column:
    """Equal names, or one is the other with a suffix after ``_``; any case."""
    x, y = F.upper(F.trim(c(a))), F.upper(F.trim(c(b)))
    return (x == y) | F.startswith(x, F.concat(y, F.lit("_"))) | F.startswith(y, F.concat(x, F.lit("_")))
