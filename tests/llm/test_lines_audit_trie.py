"""Line dedup, filter audit and prefix trie: edge cases and plain Python."""

import collections
import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadweave.llm import filter_audit, line_dedup, prefix_trie

DOCS = "doc_id long, text string, source string, tag long, row long, bitmap string, good string, part string, id string"
EXTRA = (1, 2, "b", "g", "p", "i")
SPACE = " \t\n\x0b\x0c\r"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def kept_lines(rows, least=10):
    """(lines, dropped, text left) of every (id, text)."""
    order = lambda i: (i is None, i or 0)
    holders = collections.defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key := lower(line.strip(SPACE))) >= least:
                holders[key].add(order(i))
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        left = [x for x in lines if len(holders.get(lower(x.strip(SPACE)), ())) < 2 or min(holders[lower(x.strip(SPACE))]) == order(i)]
        out.append((i, len(lines), len(lines) - len(left), "\n".join(left)))
    return out


def line_rows(n, seed):
    """Texts of few lines, a hot one among them, with repeated and missing ids, and long ones."""
    rnd = random.Random(seed)
    pool = [f"line number {k:04d} of them" for k in range(60)] + ["short", "", "  \t", "exactly 10", "nine char", "ÄÖÜ äöü ß€ 12", "ÄÖÜäöü"]
    rows = []
    for _ in range(n):
        lines = [rnd.choice(pool) for _ in range(rnd.randint(0, 12))]
        if rnd.random() < 0.4:
            lines.insert(rnd.randint(0, len(lines)), rnd.choice(["The hot line of all", "  the HOT line of all\r", "\tThe hot line of all\x0b"]))
        rows.append((rnd.choice([None, *range(n // 2)]), "\n".join(lines)))
    rows += [(0, None), (1, ""), (None, None), (3, "\n"), (4, "\n\n\n"), (5, "a line that is long enough\n" * 3), (6, "A line that is long enough"), (7, "x" * 200_000 + "\n" + "y" * 100_000), (8, "y" * 100_000)]
    rows += rows[:3]
    return rows


@pytest.mark.parametrize(("parts", "batch"), [(1, 10000), (7, 3), (40, 1)])
def test_line_dedup(spark, parts, batch):
    rows = line_rows(150, parts)
    docs = spark.createDataFrame([(i, t, "s", *EXTRA) for i, t in rows], DOCS).repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        bitmaps = line_dedup.keep_bitmaps(docs)
        got = sorted(map(tuple, line_dedup.report(docs, bitmaps).collect()), key=repr)
        clean = line_dedup.deduplicated(docs, bitmaps)
        texts = collections.Counter((r.doc_id, r.text) for r in clean.collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    wanted = kept_lines(rows)
    assert got == sorted(((i, n, gone, hashlib.sha256(t.encode()).hexdigest()) for i, n, gone, t in wanted), key=repr)
    assert clean.columns == docs.columns
    assert texts == collections.Counter((i, None if old is None else t) for (i, old), (_, _, _, t) in zip(rows, wanted, strict=True))
    assert any(gone for _, _, gone, _ in wanted)


def test_line_dedup_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    bitmaps = line_dedup.keep_bitmaps(docs)
    assert bitmaps.collect() == [] and line_dedup.report(docs, bitmaps).collect() == [] and line_dedup.deduplicated(docs, bitmaps).collect() == []


def test_line_dedup_text_ids(spark):
    docs = spark.createDataFrame([("b", "a line of some length"), ("a", "A line of some length"), ("c", "other lines of text")], "name string, body string")
    bitmaps = line_dedup.keep_bitmaps(docs, "name", "body")
    assert {r.name: r.body for r in line_dedup.deduplicated(docs, bitmaps, "name", "body").collect()} == {"a": "A line of some length", "b": "", "c": "other lines of text"}


@pytest.mark.parametrize("n", [1, 7, 8, 9, 1000])
def test_bitmaps(n):
    rnd = random.Random(n)
    dropped = sorted(rnd.sample(range(n), max(1, n // 3)))
    keep = line_dedup.decode_bitmap(line_dedup.encode_bitmap(dropped), n + 20)
    assert np.flatnonzero(~keep).tolist() == dropped
    assert line_dedup.decode_bitmap(None, n).all()
    assert len(line_dedup.encode_bitmap([99_999])) < 200


def audited(docs, labels):
    """Rows of the audit in plain Python, by part, order and step."""
    quality = {k: any(q == 1 for i, q, _ in labels if i == k) for k, _, _ in labels if k is not None}
    toxic = {k: any(x == 1 for i, _, x in labels if i == k) for k, _, x in labels if k is not None}
    fails, out = [], {}
    for i, text, _ in docs:
        text = text or ""
        words = [w for w in "".join("\n" if c in SPACE else c for c in text).split("\n") if w]
        f = set()
        f |= {"A"} if len(words) < 200 else set()
        f |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        f |= {"C"} if 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text) else set()
        f |= {"D"} if set(text) & set("#$%&*|") else set()
        f |= {"E"} if i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs) else set()
        fails.append(f)
    for part in {s or "" for _, _, s in docs}:
        own = [(f, quality.get(i, False), toxic.get(i, False)) for f, (i, _, s) in zip(fails, docs, strict=True) if (s or "") == part]
        share = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, name in enumerate(order, 1):
                gone = [x for x in left if name in x[0]]
                left = [x for x in left if name not in x[0]]
                share[name] += len(gone)
                failing = sum(name in f for f, _, _ in own)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), sum(f == {name} for f, _, _ in own), sum(g for _, g, _ in gone), sum(t for _, _, t in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(share[order[step - 1]])
    return out


def test_filter_audit(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdef") for _ in range(6))
    docs = [(1, None, "a"), (2, "", None), (3, "", ""), (None, "", "a"), (4, "x " * 5000, "a"), (4, "x " * 5000, "a"), (5, "x " * 5000, "hot"), (6, " \t\n", "clean only?")]
    for k in range(10, 60):
        text = " ".join(word() for _ in range(rnd.choice([20, 220, 220])))
        if rnd.random() < 0.3:
            text += " ABCDEFGHIJ" * 5
        if rnd.random() < 0.3:
            text += " #"
        docs.append((k, text, "hot" if k % 3 else "b"))
    docs += [(k + 100, t, s) for k, t, s in docs[10:30]]
    docs.append((500, " ".join(f"word{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(250)), "clean"))
    labels = [(k, rnd.randint(0, 1), rnd.randint(0, 1)) for k in range(5, 120)] + [(12, 1, None), (12, 0, 1), (None, 1, 1), (14, None, None)]
    table = spark.createDataFrame([(i, t, s, *EXTRA) for i, t, s in docs], DOCS).repartition(4)
    tested = filter_audit.tested_documents(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in filter_audit.audit(tested).collect()}
    wanted = audited(docs, labels)
    assert len(got) == 600 * 6 and got == wanted
    assert all(v == [1, 0, 0, 0, 0, 0, 0] for (p, _, _), v in got.items() if p == "clean")
    two = {(r.part, r.filter_order, r.step): r.removed for r in filter_audit.audit(tested, "DA").collect()}
    assert two["hot", "AD", 1] == got["hot", "ABCDE", 1][1] and two["hot", "DA", 1] == got["hot", "DABCE", 1][1] and len(two) == 6 * 4
    with pytest.raises(ValueError):
        filter_audit.audit(tested, "AAB")


def test_filter_audit_empty_table(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(filter_audit.tested_documents(spark.createDataFrame([], DOCS), labels)).collect() == []
    one = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(300)), "s", *EXTRA)], DOCS)  # nothing fails
    assert {(r.kept, r.removed) for r in filter_audit.audit(filter_audit.tested_documents(one, labels)).collect()} == {(1, 0)}


def trie(rows):
    """Nodes in plain Python, by depth and smallest member."""
    convs = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    made = {c: own.get(c - int(np.fmod(c, 100)), [])[: h[c]] + own[c][h[c] :] for c in own}
    members = collections.defaultdict(list)
    for c in sorted(made):
        for d in range(len(made[c]) + 1):
            members[tuple(made[c][:d])].append(c)
    children, leaves, saved = collections.Counter(), collections.Counter(), collections.Counter()
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1]) if p else 0)
    ends = lambda p: hashlib.sha256(",".join(str(c) for c in members[p] if len(made[c]) == len(p)).encode()).hexdigest()
    return {(members[p][0], len(p)): (members[p[:-1]][0] if p else None, len(members[p]), children[p], leaves[p], saved[p], ends(p)) for p in members}


def nodes_of(df):
    rows = df.collect()
    out = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


def conversations(seed, n=60):
    rnd = random.Random(seed)
    rows = []
    for c in [*range(n), *range(100, 100 + n), -150, -7, 305, 9_007_199_254_740_993, 9_007_199_254_740_994]:
        turns = rnd.randint(1, 8)
        rows += [(c, t, rnd.choice(["user", "assistant"]), rnd.choice(["hello", "hi é", "yes"])) for t in range(turns)]
    rows += [(400 + k, t, "user", f"t{t % 7}") for k in range(3) for t in range(90)]  # long, equal but for their families
    rows += [(1000 + 100 * k, t, "user", "hot") for k in range(40) for t in range(3)]  # one group of copies
    rows += [(701, None, None, None), (701, None, None, "x"), (702, 0, "user", ""), (703, 0, None, None), (None, 0, "user", "lost"), (704, 5, "a", "bc"), (705, 5, "ab", "c")]
    rows += [(12, 0, "user", "again")]  # its number is another turn's
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("small", [1, 3, 20, 2000])
def test_prefix_trie(spark, small):
    rows = [(c, t, r, x) for c, t, r, x in conversations(3) if c not in (12, 701)]  # ties of turns are told apart by hash
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth long, p string").repartition(6)
    assert nodes_of(prefix_trie.prefix_trie(df, small)) == trie(rows)


def test_prefix_trie_blocks(spark, monkeypatch):
    """Carries over blocks and partitions, lists of ends in chunks."""
    monkeypatch.setattr(prefix_trie, "BLOCK_BITS", 2)
    monkeypatch.setattr(prefix_trie, "CHUNK_BITS", 1)
    rows = [(c, t, r, x) for c, t, r, x in conversations(5) if c not in (12, 701)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert nodes_of(prefix_trie.prefix_trie(df, 10)) == trie(rows)


def test_prefix_trie_ties_and_nothing(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert prefix_trie.prefix_trie(spark.createDataFrame([], schema)).collect() == []
    rows = conversations(6)
    once, again = (nodes_of(prefix_trie.prefix_trie(spark.createDataFrame(rows, schema).repartition(k))) for k in (1, 9))
    assert once == again and sum(n for (_, d), (_, n, *_) in once.items() if d == 0) == len({c for c, *_ in rows} - {None})
    turnless = [(150, 0, "user", "x")]  # takes its first turns from 100, which isn't there
    got = nodes_of(prefix_trie.prefix_trie(spark.createDataFrame(turnless, schema)))
    assert got == trie(turnless)


def test_local_sums():
    rnd = random.Random(8)
    for n in (1, 2, 3, 50, 300):
        for parents in ([-1, *range(n - 1)], [-1, *[0] * (n - 1)], [-1, *[rnd.randint(max(0, k - 4), k) for k in range(n - 1)]]):
            depth = [0] * n
            for k in range(1, n):
                depth[k] = depth[parents[k]] + 1
            order = sorted(range(n), key=depth.__getitem__)
            place = {v: k for k, v in enumerate(order)}
            parent = [-1 if parents[v] < 0 else place[parents[v]] for v in order]
            values = np.array([[rnd.randint(0, 9), rnd.randint(0, 9)] for _ in range(n)])
            wanted = values.copy()
            for k in range(n - 1, 0, -1):
                wanted[parent[k]] += wanted[k]
            assert (prefix_trie.local_sums(parent, values) == wanted).all()


def test_one_hot_text_many_batches(spark):
    """A digest of a very common text doesn't depend on how it is split."""
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("the same two lines\nof text everywhere").alias("text"))
    bitmaps = line_dedup.keep_bitmaps(docs)
    rows = line_dedup.report(docs, bitmaps).collect()
    assert sum(r.n_dropped for r in rows) == 2 * 399 and [r.n_dropped for r in rows if r.id == 0] == [0]
