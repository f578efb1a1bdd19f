"""Queries against plain Python on the smallest tables."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest

from roadweave.llm import near_dedup, personal_data, substring_dedup
from roadweave.llm.queries import QUERIES, vocabulary

SF = "/root/testdata/sf0.001"
SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows(spark, name, key="doc_id"):
    return {r[key]: r for r in QUERIES[name](spark, SF).collect()}


def test_op1(spark, texts):
    assign = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    got = rows(spark, "op1_secret_scan")
    for i, x in texts.items():
        found = [(m.start(), 0, m.end()) for m in assign.finditer(x) if len(m[2]) >= 6]
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", x) if len(m[0]) >= 20]
        found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", x) if len(m[0]) >= 24]
        said = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))
        assert got[i].base_sha256 == hashlib.sha256(said.encode()).hexdigest()


def test_op2_op5(spark, texts):
    from tokenizers import Tokenizer

    got, at = rows(spark, "op2_token_files"), 0
    t = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    for i in sorted(texts):
        ids = np.array([*t.encode(texts[i], add_special_tokens=False).ids, 2], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    t = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    pieces = {(r.doc_id, r.piece): r for r in QUERIES["op5_best_fit_packing"](spark, SF).collect()}
    total, n = 0, 0
    for i, x in texts.items():
        ids = np.array([*t.encode(x, add_special_tokens=False).ids, 1], "<u4")
        total += len(ids)
        for k, a in enumerate(range(0, len(ids), 4096)):
            r, own = pieces[i, k], ids[a : a + 4096]
            assert (r.start, r.length, r.ids_crc32) == (a, len(own), zlib.crc32(own.tobytes()))
            n += 1
    assert n == len(pieces)
    assert len({r.sequence_id for r in pieces.values()}) <= -(-total // 4096) + 1


def test_op3_planted(spark):
    import random

    rnd = random.Random(2)
    text = lambda n, low=2, high=8: " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(low, high))) for _ in range(n))
    planted = []
    for k in range(100):
        p = text(51) if k % 2 else text(51, 3, 4)  # short words too
        planted += [(2 * k + j, f"{text(rnd.randint(5, 80))} {p} {text(rnd.randint(5, 80))}") for j in range(2)]
    clean = [(1000 + i, text(200)) for i in range(100)]
    got = {r.id for r in substring_dedup.repeated_documents(spark.createDataFrame(planted + clean, "doc_id long, text string")).collect()}
    assert got == set(range(200))


def test_op4(spark, texts):
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    got = rows(spark, "op4_personal_data")

    def luhn(d):
        return sum(x - 9 * (x > 9) for x in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d)))) % 10 == 0

    for i, x in texts.items():
        found = []
        for k, p in enumerate(patterns):
            for m in re.finditer(p, x):
                d = re.sub("[^0-9]", "", m[0])
                good = [True, all(q.isdigit() and int(q) <= 255 for q in m[0].split(".")), 13 <= len(d) <= 19 and luhn(d), 9 <= len(d) <= 15][k]
                if good:
                    found.append(f"{('email', 'ip', 'card', 'phone')[k]}:{m.start()}:{m.end()}")
        assert got[i].base_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()


@pytest.mark.parametrize("most_broadcast", [1_000_000, 0])
def test_op4_rare_context(spark, monkeypatch, most_broadcast):
    """A rare label is learned however common the words are that share 20 bits of its hash;
    one that mostly stands before other words isn't, nor is a word glued to entities."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(personal_data.context_counts, "__defaults__", (most_broadcast,))
    place = lambda *x: F.pmod(F.xxhash64(*x, F.lit(len(x))), F.lit(1 << 20))
    word = F.concat(F.lit("f"), F.col("id"))
    label = spark.range(1).select(place(F.lit("zqlabel")), place(F.lit("our"), F.lit("zqlabel"))).first()
    foreign = [r.w for r in spark.range(4_000_000).select(word.alias("w"), place(word).alias("p")).where(F.col("p").isin(*label)).collect()]
    assert len(foreign) >= 2
    rows = [(k, f"our zqlabel mail{k}@host.org and") for k in range(8)] + [(20 + k, f"our zqlabel 70{k}-88{k}19 and") for k in range(5)]
    rows += [(40 + k, f"the common mail{k}@host.net and") for k in range(8)] + [(60 + k, f"the common 60{k}-77{k}19 and") for k in range(5)]
    rows += [(80 + k, f"so glued:mail{k}@host.com and") for k in range(8)] + [(100 + k, f"so glued: 50{k}-66{k}19 and") for k in range(5)]
    rows += [(200, " ".join(foreign * 60)), (201, "the common thing " * 60)]
    got = {r.id: [(s.kind, s.start, s.end) for s in r.spans if s.kind == 4] for r in personal_data.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[20 + k] == [(4, 12, 21)] for k in range(5))
    assert not any(got[i] for i in got if i not in range(20, 25))


def test_op6(spark, texts):
    got = rows(spark, "op6_minhash_near_dedup")
    sets = {}
    for i, x in texts.items():
        w = SPACE_WORD.findall(low(x))
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()
    of = {i: i for i in sets}
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((of[a], of[b]))
                of = {i: x if c == y else c for i, c in of.items()}
    for i in ids:
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), of[i], of[i] == i)


def test_op6_loose_group(spark):
    """Copies that are similar to one text only, not to one another."""
    import random

    rnd = random.Random(4)
    base = [f"w{k}" for k in range(300)]
    made = [(0, " ".join(base))]
    for i in range(1, 60):
        w = base[:]
        for k in rnd.sample(range(300), 7):
            w[k] = f"x{i}_{k}"
        made.append((i, " ".join(w)))
    got = near_dedup.near_duplicates(spark.createDataFrame(made, "doc_id long, text string"), shingle=3, percent=85).collect()
    sets = {i: {tuple(t.split()[k : k + 3]) for k in range(298)} for i, t in made}
    want = {i for i in sets if 100 * len(sets[i] & sets[0]) >= 85 * len(sets[i] | sets[0])}
    assert {r.id for r in got if r.component_id == 0} >= want


def test_op8(spark):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = rows(spark, "op8_language_id")
    held = [r for r in got.values() if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.95 * len(held)


def test_op9(spark, texts):
    got = rows(spark, "op9_quality_rules")
    for i, x in texts.items():
        w, r = SPACE_WORD.findall(x), got[i]
        n = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        again = {j for k in range(len(w) - 2) if n[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
        lines = [line for line in x.split("\n") if SPACE_WORD.search(line)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), len(lines) - len(set(lines)), len(again))
        assert r.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w)) and not (r.base_failed and r.kept)


def test_op10(spark, texts):
    got, windows = rows(spark, "op10_decontamination"), {}
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = ALNUM_WORD.findall(low(r.text))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(r.item_id))
    for i, x in texts.items():
        w, hit, items = ALNUM_WORD.findall(low(x)), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    items |= own
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == (len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest())


def test_pipeline(spark):
    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SF)
        assert docs.columns == before.columns
    assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()} == {r.doc_id for r in docs.collect()}
