"""Contracts on odd strings: special tokens, signs that aren't letters, random Unicode."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from roadweave.llm import decontam, language_id, packing, personal_data, quality, token_files
from roadweave.llm.common import new_folder
from roadweave.llm.encode import PieceEncoder
from roadweave.llm.queries import vocabulary


def texts(n, seed=1):
    rnd = random.Random(seed)
    pools = ["abc deF ", " \n\t\r", "éßÄø ", "日本語。", "0123456789", ".,;:!?'\"()", "  ​", "😀👍🏽", "<|endoftext|>"]
    out = ["", " ", "\n", "<|endoftext|>", "a <|endoftext|> b", "x<|endoftext|>\n\ny  <|endoftext|>", "don't I'll WE'RE"]
    for _ in range(n):
        out.append("".join(rnd.choice(rnd.choice(pools)) if rnd.random() < 0.97 else "<|endoftext|>" for _ in range(rnd.randint(1, 120))))
    return out


@pytest.mark.parametrize(("name", "kind"), [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
@pytest.mark.parametrize("special", [True, False])
def test_pieces_encode_like_whole_texts(name, kind, special):
    whole = Tokenizer.from_file(vocabulary(name))
    whole.encode_special_tokens = not special
    e = PieceEncoder(vocabulary(name), kind, special)
    some = texts(1500)
    for text, raw in zip(some, e.encode(some), strict=True):
        assert np.frombuffer(raw, e.dtype).tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_special_token_ids(spark):
    docs = spark.createDataFrame([(1, "a <|endoftext|> b"), (2, "c")], "doc_id long, text string")
    folder = new_folder(spark, "t")
    token_files.write_token_files(docs, folder, vocabulary("byte_bpe_50k.json"))
    got = token_files.read_token_files(spark, folder).orderBy("start").collect()
    t = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    assert got[0].ids == [*t.encode("a <|endoftext|> b", add_special_tokens=False).ids, 2] and 50256 in got[0].ids


def test_letters():
    assert not any(map(language_id.has_letter, ["", "² ½ ①", "12 _ 3", "!?"]))
    assert all(map(language_id.has_letter, ["² a", "ß", "日", "½é"]))


def test_clashing_names_are_refused(spark):
    docs = spark.createDataFrame([(1, "a", "x", "y")], "doc_id long, text string, found string, quality string")
    bench = spark.createDataFrame([("i", "a")], "item_id string, text string")
    with pytest.raises(ValueError):
        decontam.annotate(docs, bench)
    with pytest.raises(ValueError):
        quality.assess(docs, docs)


def best_fit(lengths, capacity):
    """One document after the other into the tightest open bin."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [(room, k) for k, room in enumerate(rooms) if room >= n]
        if fits:
            rooms[min(fits)[1]] -= n
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


def test_bins_of_the_plan():
    rnd = random.Random(3)
    for _ in range(60):
        capacity = rnd.choice([7, 16, 50])
        lengths = [rnd.randint(1, capacity) for _ in range(rnd.randint(0, 120))]
        counts = {n: lengths.count(n) for n in set(lengths)}
        p = packing.plan(counts, capacity)
        numbered, used = sorted(lengths, reverse=True), {}
        for k, n in enumerate(numbered):
            run = int(np.searchsorted(p["first"], k, side="right")) - 1
            within = k - int(p["first"][run])
            bin_ = int(p["bin"][run]) + within // int(p["each"][run])
            assert int(p["offset"][run]) + within % int(p["each"][run]) * n == used.get(bin_, 0)  # gapless
            used[bin_] = used.get(bin_, 0) + n
        assert sorted(capacity - u for u in used.values()) == best_fit(lengths, capacity)


def test_packed_rows(spark):
    rnd = random.Random(4)
    docs = spark.createDataFrame([(k, " ".join("word" for _ in range(rnd.randint(0, 90)))) for k in range(200)], "doc_id long, text string")
    got = packing.pack(docs, vocabulary("word_bpe_49k.json"), capacity=64, with_ids=True).collect()
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert len(by) == len(best_fit([r.length for r in got], 64))


def test_contexts_find_unseen_identifiers(spark):
    """Left and right contexts are learned from emails; identifiers found through them
    make a further context sure; clean texts, cut and glued words get nothing."""
    rows = [(k, f"{'x' * 70} contact desk user{k}@mail.org today") for k in range(8)]
    rows += [(20 + k, f"{'x' * 70} contact desk ID-77{k}{k}91 okay") for k in range(6)]
    rows += [(40 + k, f"lorem user{k + 50}@mail.net signed off {'y' * 60}") for k in range(8)]
    rows += [(60 + k, f"ipsum QQ-31{k}{k}55 signed off {'y' * 60}") for k in range(5)]
    # a second step: only identifiers that the first one found stand after this word
    rows += [(80 + k, f"{'z' * 50} ticketno ID-77{k}{k}91 !") for k in range(6)]
    rows += [(90, f"{'z' * 50} ticketno ZZ-999111 !")]
    clean = [(200 + k, f"the room {1000 + k}-{2000 + k} was free and the room was clean") for k in range(20)]
    docs = spark.createDataFrame(rows + clean, "doc_id long, text string")
    got = {r.id: [(s.start, s.end) for s in r.spans if s.kind == 4] for r in personal_data.find(docs).collect()}
    text = dict(rows + clean)
    found = {text[i][a:b] for i in got for a, b in got[i]}
    assert found == {f"ID-77{k}{k}91" for k in range(6)} | {f"QQ-31{k}{k}55" for k in range(5)} | {"ZZ-999111"}
    assert not any(got[i] for i, _ in clean)


def test_scores_in_plain_python(spark):
    """The verdict of the quality rules: mean log ratio and threshold, by hand."""
    import math
    import statistics

    rnd = random.Random(8)
    good, bad = [f"good{k}" for k in range(20)], [f"bad{k}" for k in range(20)]
    rows = [(k, " ".join(rnd.choice(good) for _ in range(rnd.randint(60, 90)))) for k in range(80)]
    rows += [(100 + k, " ".join(rnd.choice(bad) for _ in range(rnd.randint(60, 90)))) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    trusted = spark.createDataFrame([(k,) for k in range(60)], "doc_id long")
    ids = {r["__id"]: r["__held"] for r in quality.chosen(trusted).collect()}
    assert len(ids) == 60 and 5 <= sum(ids.values()) <= 25
    grams = lambda t: t.split() + list(zip(t.split(), t.split()[1:], strict=False))
    raw, own = {}, {}
    for i, t in rows:
        for g in grams(t):
            raw[g] = raw.get(g, 0) + 1
            own[g] = own.get(g, 0) + (ids.get(i) is False)
    n_raw, n_own = sum(raw.values()), sum(own.values())
    weight = {g: math.log((own[g] + quality.SMOOTHING * raw[g] / n_raw) / (n_own + quality.SMOOTHING) / (raw[g] / n_raw)) for g in raw}
    mean = {i: statistics.fmean(weight[g] for g in grams(t)) for i, t in rows}
    got = {r.doc_id: r.quality for r in quality.assess(docs, trusted).collect()}
    worst = max(abs(got[i].mean_ratio - mean[i]) for i in mean)
    assert worst < 0.02, worst  # rounding, and a few shared places
    held = sorted(mean[i] for i, h in ids.items() if h)
    low = held[0] + (held[1] - held[0]) * quality.LOW * (len(held) - 1)
    least = low - quality.MARGIN * (statistics.median(held) - low)
    assert all(got[i].kept == (mean[i] >= least) for i in mean if abs(mean[i] - least) > 0.02)
    assert not any(got[i].kept for i in got if i >= 100) and all(got[i].kept for i in ids)


def test_repeated_words_of_a_long_text(spark):
    """A million words with one repeated window: exact."""
    words = [f"w{k}" for k in range(1_000_000)]
    words[700_000:700_003] = words[10:13]
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    got = quality.assess(docs, docs.select("doc_id").limit(0)).first().quality
    assert (got.n_words, got.n_repeat_words) == (1_000_000, 6)


@pytest.mark.parametrize("length", [3, 46, 50, 300])
def test_context_words_of_any_length(spark, length):
    """A label announces identifiers however long it is, before or after them, next to a text's ends or between matches."""
    one, two = (start + "x" * (length - 2) for start in ("zq", "vw"))
    rows = [(k, f"our {one} mail{k}@host.org and{k}") for k in range(8)] + [(20 + k, f"our {one} 70{k}-88{k}19 or{k}") for k in range(5)]
    rows += [(40 + k, f"by{k} mail{k}@host.net\n{two} end") for k in range(8)] + [(60 + k, f"at{k} 50{k}-66{k}19 {two} end") for k in range(5)]
    rows += [(80 + k, f"x mail{k}@host.com{one} 90{k}-11{k}19 z") for k in range(5)]  # glued to the match before
    got = {r.id: [s for s in r.spans if s.kind == 4] for r in personal_data.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(len(got[20 + k]) == 1 and len(got[60 + k]) == 1 and not got[80 + k] for k in range(5))


def test_every_trusted_text_takes_part(spark):
    """No more than 20,000 of them did."""
    ids = quality.chosen(spark.range(25_000).withColumnRenamed("id", "doc_id"))
    counted, held = ids.where("not __held").count(), ids.where("__held").count()
    assert counted + held == 25_000 and 5_000 < held < 7_500
