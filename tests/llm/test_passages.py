"""Repeated passages: each as a whole stands at another place; few that are long enough are missed."""

import random

import pytest

from roadweave.llm import substring_dedup


def occurrences(texts, passage):
    """At how many places the passage stands, overlapping ones counted; at most two are counted."""
    n = 0
    for text in texts:
        at = text.find(passage)
        while at >= 0 and n < 2:
            n, at = n + 1, text.find(passage, at + 1)
        if n >= 2:
            break
    return n


def passages(spark, rows, least=1, parts=3):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    return substring_dedup.repeated_passages(docs, least=least).collect()


def test_given_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = substring_dedup.repeated_passages(docs).collect()
    assert len(got) > 300 and sum(r.end - r.start >= 101 for r in got) > 50
    for r in got:
        assert occurrences(texts.values(), texts[r.id][r.start : r.end]) == 2
    spans = {}
    for r in sorted(got, key=lambda r: (r.id, r.start)):  # none within another
        assert r.end > spans.get(r.id, -1)
        spans[r.id] = r.end


@pytest.mark.parametrize("parts", [1, 6])
def test_shuffled_lines(spark, parts):
    """Lines in other orders are repeated one by one; two of them only where they stand so twice."""
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 8)))
    lines = [" ".join(word() for _ in range(9)) for _ in range(12)]
    rows = [(k, "\n".join(rnd.sample(lines, 12))) for k in range(40)]
    rows += [(100 + k, " ".join(word() for _ in range(150))) for k in range(20)]
    texts = dict(rows)
    got = passages(spark, rows, parts=parts)
    assert {r.id for r in got} == set(range(40))
    for r in got:
        assert occurrences(texts.values(), texts[r.id][r.start : r.end]) == 2
    for k in range(40):  # nearly all of each text is in passages
        held = set()
        for r in got:
            if r.id == k:
                held |= set(range(r.start, r.end))
        assert len(held) >= 0.75 * len(texts[k])


def test_hot_line_does_not_split_a_passage(spark):
    """A line that stands in most texts lies within a passage that two of them share."""
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    hot = text(15)
    shared = f"{text(40)} {hot} {text(40)}"
    rows = [(k, f"{text(30)} {hot} {text(30)}") for k in range(200)]
    rows += [(k, f"{text(30)} {shared} {text(30)}") for k in (1000, 77_000)]
    got = [r for r in passages(spark, rows, least=101) if r.id >= 1000]
    assert len(got) == 2 and all(r.end - r.start >= len(shared) - 80 for r in got)


@pytest.mark.parametrize(("length", "least_recall"), [(110, 0.85), (500, 1.0)])
def test_recall_of_planted_passages(spark, length, least_recall):
    """Passages of so many code points in two texts each; found if both texts have a passage within it."""
    rnd = random.Random(length)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    rows, planted = [], {}
    for k in range(150):
        passage = text(length // 3)[:length]
        for j in range(2):
            before = text(rnd.randint(20, 60))
            planted[2 * k + j] = (len(before), len(before) + length)
            rows.append((2 * k + j, f"{before}{passage}{text(40)}"))
    found = {i: 0 for i in planted}
    for r in passages(spark, rows):
        start, end = planted[r.id]
        found[r.id] += max(0, min(end, r.end) - max(start, r.start))
    hit = sum(found[2 * k] > 0 and found[2 * k + 1] > 0 for k in range(150))
    print(f"recall at {length}: {hit / 150:.3f}; code points covered: {sum(found.values()) / len(found) / length:.2f}")
    assert hit >= least_recall * 150


def test_repeated_rows_and_names(spark):
    """Equal rows are texts of their own: one of them keeps its passages; all columns return."""
    rnd = random.Random(12)
    text = " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(3, 8))) for _ in range(200))
    rows = [(1, text, 5, "d"), (1, text, 5, "d"), (2, text, 6, "e"), (None, text, 7, "f"), (3, None, 1, "g"), (4, "", 1, "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row long, digest string")
    left = substring_dedup.deduplicated(docs)
    assert left.columns == docs.columns
    got = sorted(((r.doc_id or 99, len(r.text) if r.text is not None else None, r.row, r.digest) for r in left.collect()), key=str)
    assert [g for g in got if g[0] in (3, 4)] == [(3, None, 1, "g"), (4, 0, 1, "h")]
    of_one = sorted(n for i, n, _, _ in got if i == 1)
    assert of_one[1] == len(text) and of_one[0] < 60 and all(n < 60 for i, n, _, _ in got if i in (2, 99))
    assert substring_dedup.deduplicated(docs.limit(0)).collect() == [] and substring_dedup.repeated_passages(docs.limit(0)).collect() == []
