"""The pipeline from raw texts to packed ids, each stage against plain Python on its own input."""

import collections
import math
import re
import statistics
import zlib

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from roadweave.llm import quality
from roadweave.llm.common import materialize
from roadweave.llm.queries import trusted_ids, vocabulary

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def steps(spark):
    """(name, rows before, rows after) of every stage, as the pipeline runs them."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        made = materialize(stage(spark, docs, SF), name)
        out.append((name, docs.collect(), made.collect()))
        docs = made
    return out


def test_quality(spark, steps):
    name, before, after = steps[0]
    ids = {r["__id"]: r["__held"] for r in quality.chosen(trusted_ids(spark, SF)).collect()}
    words = {r.doc_id: WORD.findall((r.text or "")) for r in before}
    half = quality.PLACES // 2
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    of_word = lambda w: xxhash.xxh64_intdigest(w.encode(), 42)
    of_pair = lambda x, y: xxhash.xxh64_intdigest(y.to_bytes(8, "little"), xxhash.xxh64_intdigest(x.to_bytes(8, "little"), 42))
    raw, own = collections.Counter(), collections.Counter()
    both = {}
    for i, g in words.items():
        h = [of_word(w) for w in g]
        both[i] = [signed(x) % half for x in h] + [signed(of_pair(x, y)) % half + half for x, y in zip(h, h[1:], strict=False)]
        raw.update(both[i])
        own.update(both[i] if ids.get(i) is False else [])
    n_raw, n_own = sum(raw.values()), sum(own.values())
    weight = {g: round(math.log((own[g] + quality.SMOOTHING * n / n_raw) / (n_own + quality.SMOOTHING) / (n / n_raw)), 3) for g, n in raw.items()}
    mean = {i: statistics.fmean(weight[x] for x in g) if g else 0.0 for i, g in both.items()}
    held = sorted(mean[i] for i, h in ids.items() if h and len(words[i]) >= 50)
    place = quality.LOW * (len(held) - 1)
    least = held[int(place)] + (held[min(int(place) + 1, len(held) - 1)] - held[int(place)]) * (place % 1)
    least -= quality.MARGIN * (statistics.median(held) - least)
    kept, unsure = set(), set()
    for i, w in words.items():
        seen = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        inside = {k + j for k, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if seen[x] > 1 for j in range(3)}
        if len(w) >= 50 and 100 * len(inside) <= 50 * len(w):
            kept |= {i} if mean[i] >= least else set()
            unsure |= {i} if abs(mean[i] - least) <= 1e-5 else set()  # rounding
    got = {r.doc_id for r in after}
    assert got ^ kept <= unsure and len(unsure) < 3 and 0.5 * len(words) < len(got) < len(words)
    own = {r.doc_id: tuple(r) for r in before}
    assert all(tuple(r) == own[r.doc_id] for r in after)


def test_near_duplicates(steps):
    name, before, after = steps[1]
    sets = {}
    for r in before:
        w = WORD.findall(low(r.text))
        sets[r.doc_id] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root[a], root[b]))
                root = {i: x if c == y else c for i, c in root.items()}
    assert {r.doc_id for r in after} == {i for i, c in root.items() if i == c} and len(after) < len(before)


def test_decontamination(spark, steps):
    name, before, after = steps[2]
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = split(r.text)
        n = min(10, len(w))
        windows |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
    sizes = {len(w) for w in windows}
    clean = set()
    for r in before:
        w = split(r.text)
        if not any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1)):
            clean.add(r.doc_id)
    assert {r.doc_id for r in after} == clean and len(after) < len(before)


def entropy(value):
    return -sum(n / len(value) * math.log2(n / len(value)) for n in collections.Counter(value).values())


def test_secrets(steps):
    name, before, after = steps[3]
    assign = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    base, tokens, owners, repositories, texts = {}, {}, *(collections.defaultdict(set) for _ in range(3))
    for r in before:
        t = r.text or ""
        base[r.doc_id] = [(m.start(), m.end(), m[2]) for m in assign.finditer(t) if len(m[2]) >= 6]
        base[r.doc_id] += [(m.start(), m.end(), m[0]) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        base[r.doc_id] += [(m.start(), m.end(), m[0]) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        looks = lambda v: re.search("[0-9]", v) and re.search("[A-Z]", v) and re.search("[a-z]", v) and entropy(v) >= 3
        tokens[r.doc_id] = [(m.start(), m.end(), m[0]) for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", t) if looks(m[0]) and not any(s < m.end() and e > m.start() for s, e, _ in base[r.doc_id])]
        for _, _, v in base[r.doc_id] + tokens[r.doc_id]:
            owners[v].add(r.source)
            repositories[v].add((r.source, r.lang))
            texts[v].add(r.doc_id)
    live = {v for v in owners if len(owners[v]) == 1 and entropy(v) >= 3 and not (len(repositories[v]) >= 3 and len(texts[v]) >= 20)}
    got, n = {r.doc_id: r for r in after}, 0
    assert set(got) == {r.doc_id for r in before}
    for r in before:
        spans = sorted((s, e) for s, e, v in base[r.doc_id] + [x for x in tokens[r.doc_id] if x[2] in live])
        out, at = "", 0
        for s, e in spans:
            if s >= at:
                out, at = out + r.text[at:s] + "[secret]", e
            else:
                at = max(at, e)
        wanted = None if r.text is None else out + r.text[at:]
        assert got[r.doc_id].text == wanted and got[r.doc_id].n_chars == (r.n_chars if wanted is None else len(wanted))
        n += bool(spans)
    assert n > 3


def test_packing(steps):
    name, before, after = steps[4]
    t = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    pieces, total = {(r.doc_id, r.piece): r for r in after}, 0
    assert len(pieces) == len(after)
    n = 0
    for r in before:
        ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        total += len(ids)
        for k, at in enumerate(range(0, len(ids), 4096)):
            p, own = pieces[r.doc_id, k], ids[at : at + 4096]
            assert (p.start, p.length, p.ids_crc32) == (at, len(own), zlib.crc32(own.tobytes()))
            n += 1
    assert n == len(pieces)
    bins = collections.defaultdict(list)
    for p in after:
        bins[p.sequence_id].append((p.offset, p.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= -(-total // 4096) + 1


def test_run_is_the_chain(spark, steps):
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, corpus_pipeline.run(spark, SF).collect())) == sorted(map(key, steps[4][2]))
