"""Words, chunks and shingles that a polynomial hash mixes up are kept apart."""

import math
import random

import pytest

from roadweave.llm import decontam, near_dedup, substring_dedup


def twins(letters="ab", doublings=10):
    """Two words that every polynomial hash modulo 2**64 with an odd base takes for one."""
    a, b = letters
    for _ in range(doublings):
        a, b = a + b, b + a
    return a, b


def test_near_dedup(spark):
    a, b = twins()
    docs = spark.createDataFrame([(1, a), (2, b), (3, f"{a} x y z"), (4, f"{b} x y z")], "doc_id long, text string")
    assert all(r.kept for r in near_dedup.near_duplicates(docs).collect())


def test_decontamination(spark):
    a, b = twins()
    rest = " ".join(f"w{k}" for k in range(9))
    docs = spark.createDataFrame([(1, f"{a} {rest}"), (2, f"{b} {rest}")], "doc_id long, text string")
    bench = spark.createDataFrame([("i", f"{a} {rest}")], "item_id string, text string")
    got = {r.doc_id: r.found.n_hit for r in decontam.annotate(docs, bench).collect()}
    assert got == {1: 10, 2: 0}


def test_chunks(spark):
    a, b = twins("xy", 10)  # no cut falls into them, or they are cut alike
    docs = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    for r in substring_dedup.repeated_passages(docs, least=500).collect():
        assert a[r.start : r.end] in b if r.id == 1 else b[r.start : r.end] in a


def test_passage_twice_in_one_text(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(3, 8)))
    passage = " ".join(word() for _ in range(60))
    text = f"{' '.join(word() for _ in range(80))} {passage} {' '.join(word() for _ in range(80))} {passage} end"
    clean = " ".join(word() for _ in range(300))
    docs = spark.createDataFrame([(1, text), (2, clean), (3, None), (4, "")], "doc_id long, text string")
    got = substring_dedup.repeated_documents(docs).collect()
    assert [r.id for r in got] == [1] and got[0].n_passages == 2
    kept = {r.doc_id: r.text for r in substring_dedup.deduplicated(docs).collect()}
    assert (kept[2], kept[3], kept[4]) == (clean, None, "")
    assert len(kept[1]) == len(text) - got[0].removed_chars and kept[1].startswith(text[: text.index(passage) + len(passage)])


def test_first_occurrence_is_by_id(spark):
    """However the table is split and ordered, the smallest id keeps the passage."""
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(3, 8)))
    passage = " ".join(word() for _ in range(60))
    rows = [(k, f"{' '.join(word() for _ in range(20))} {passage} {' '.join(word() for _ in range(20))}") for k in (9, 4, 7)]
    for parts in (1, 3):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got = {r.id: r.removed_chars for r in substring_dedup.repeated_documents(docs).collect()}
        assert set(got) == {4, 7, 9} and got[4] == 0 and got[7] >= 110 and got[9] >= 110


def test_loose_group_makes_few_pairs(spark, monkeypatch):
    """Texts at 0.6 to 0.9 of one another: whole results, and far fewer pairs than the square."""
    rnd = random.Random(7)
    base = [f"w{k}" for k in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 800):
        own = base[:]
        for k in rnd.sample(range(200), rnd.randint(1, 9)):
            own[k] = f"x{i}_{k}"
        rows.append((i, " ".join(own)))
    made = []
    keep = near_dedup.materialize

    def counted(df, label):
        out = keep(df, label)
        made.extend([out.count()] if label == "pairs" else [])
        return out

    monkeypatch.setattr(near_dedup, "materialize", counted)
    got = {r.id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, percent=85).collect()}
    sets = {i: {tuple(t.split()[k : k + 3]) for k in range(198)} for i, t in rows}
    own: dict = {i: i for i in sets}

    def root(i):
        while own[i] != i:
            own[i] = own[own[i]]
            i = own[i]
        return i

    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            both = len(sets[a] & sets[b])
            if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                own[y] = x
    assert got == {i: root(i) for i in sets}
    print("pairs", made)
    assert sum(made) < len(rows) ** 2 / 20  # a tenth of all pairs


@pytest.mark.parametrize("percent", [80, 85])
def test_met_pairs_lose_nothing(spark, percent):
    """Every pair that can be similar by place and size meets, once."""
    rnd = random.Random(percent)
    rows = []
    for k in range(400):
        n = rnd.choice([1, 2, 3, 7, 20, 100, 101, 119, 125, 400])
        rows.append((rnd.randint(0, 4), k, n, rnd.randint(0, max(0, n - math.ceil(n * percent / 100))), k % 90))
    lists = spark.createDataFrame(rows, "gram long, node long, n int, at int, root long")
    got = [tuple(sorted((r.node, r.node_))) for r in near_dedup._met(lists, percent).where(near_dedup._possible(percent)).collect()]
    wanted = set()
    for g, a, n, at, root in rows:
        for h, b, m, bt, other in rows:
            if g == h and a < b and root != other and 100 * min(n, m) >= percent * max(n, m) and (100 + percent) * min(n - at, m - bt) >= percent * (n + m):
                wanted.add((a, b))
    assert len(got) == len(set(got)) and set(got) == wanted and wanted


def test_loose_family_meets_little(spark, monkeypatch):
    """Of texts with 7 of 200 words changed, none linked, that share nearly all of their shingles, few meet."""
    met = {}
    keep = near_dedup._met

    def counted(lists, percent):
        out = keep(lists, percent)
        met[n] = out.count()
        return out

    monkeypatch.setattr(near_dedup, "_met", counted)
    for n in (500, 2000):
        rnd = random.Random(n)
        rows = []
        for i in range(n):
            own = [f"w{k}" for k in range(200)]
            for k in rnd.sample(range(200), 7):
                own[k] = f"x{i}_{k}"
            rows.append((i, " ".join(own)))
        got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, percent=85).collect()
        assert sum(r.kept for r in got) >= 0.9 * n  # few pairs chose the same words
    print("met", met)
    assert met[2000] <= 0.1 * 2000**2 / 2  # they met in several lists each before: twenty times all pairs
