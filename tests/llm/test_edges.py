"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from roadweave.llm import decontam, language_id, near_dedup, packing, personal_data, quality, secret_scan, substring_dedup, token_files, warc
from roadweave.llm.common import new_folder
from roadweave.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, row long, key string, found string, quality string, spans string, id string"
LONG = "word and other words " * 20000
ROWS = [
    (1, None, "en", "a", 1, "x", "f", "q", "s", "i"),
    (2, "", "en", None, 1, "x", "f", "q", "s", "i"),
    (3, "  \n\t ", None, "a", 1, "x", "f", "q", "s", "i"),
    (4, LONG, "en", "a", None, None, None, None, None, None),
    (4, LONG, "en", "a", None, None, None, None, None, None),
    (5, LONG, "de", "b", 2, "x", "f", "q", "s", "i"),
    (None, "one two", "fr", "b", 2, "x", "f", "q", "s", "i"),
    (6, "password=abcdef123456 mail a.b@c.de", "en", "b", 2, "x", "f", "q", "s", "i"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def keyed(rows, key="id"):
    out = {}
    for r in rows:
        out.setdefault(r[key], []).append(r)
    return out


def test_secret_scan(docs, none):
    got = keyed(secret_scan.scan(docs).collect())
    assert sum(map(len, got.values())) == len(ROWS) and len(got[4]) == 2
    assert got[1][0].base == [] and got[2][0].base == []
    assert [(s.start, s.kind, s.end) for s in got[6][0].base] == [(0, 0, 21)]
    assert secret_scan.scan(none).collect() == []
    clean = secret_scan.redact(docs)
    assert clean.columns == docs.columns and clean.count() == len(ROWS)
    assert [r.text for r in clean.where("doc_id = 6").collect()] == ["[secret] mail a.b@c.de"]


def test_redact_with_names_of_its_own(spark):
    """Columns named as those that the code adds, long, empty and repeated rows."""
    rows = [(1, "password=abcdef123456", "a", 1, 2, "x", "y"), (1, "password=abcdef123456", "a", 1, 2, "x", "y"), (2, None, None, 3, 4, "x", "y"), (3, "", "a", 5, 6, None, None), (4, LONG + "token=abcdef123456", "a", 7, 8, "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, __row long, `row` long, doc string, spans string")
    clean = secret_scan.redact(docs)
    assert clean.columns == docs.columns
    got = sorted(((r.doc_id, r.text, r["__row"], r["row"], r.doc) for r in clean.collect()), key=repr)
    assert got == sorted([(1, "[secret]", 1, 2, "x")] * 2 + [(2, None, 3, 4, "x"), (3, "", 5, 6, None), (4, LONG + "[secret]", 7, 8, "x")], key=repr)
    assert secret_scan.redact(docs.limit(0)).collect() == []


def test_secret_scan_hot_source(spark):
    """A sample in all repositories of one owner is an example; copies in one repository stay live."""
    sample, own = "Zx81Kq90Lm22Vb73Nc64", "Qw12Er34Ty56Ui78Op90"
    rows = [(k, f"see {sample} here", "hot", f"l{k % 4}") for k in range(80)] + [(100 + k, f"see {own} here", "hot", "l0") for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = {r.id: r for r in secret_scan.scan(docs, repository=F.concat_ws("/", "source", "lang")).collect()}
    assert all(got[k].spans == [] and (got[k].n_live, got[k].n_example) == (0, 1) for k in range(80))
    assert all(len(got[100 + k].spans) == 1 and got[100 + k].n_live == 1 for k in range(80))
    at = lambda k: [tuple(c)[3:] for c in got[k].counts]
    assert at(0) == [("example", 1, 4, 80, 80)] and at(100) == [("live", 1, 1, 80, 80)]
    clean = secret_scan.redact(docs, repository=F.concat_ws("/", "source", "lang"))
    assert {r.text for r in clean.collect()} == {f"see {sample} here", "see [secret] here"}


def test_token_files(spark, docs, none):
    folder = new_folder(spark, "t")
    token_files.write_token_files(docs, folder, vocabulary("byte_bpe_50k.json"))
    got = token_files.read_token_files(spark, folder).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1, 2, 3, 4, 4, 5, 6]
    assert got[1].n_tokens == 1 and got[1].ids == [2]
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    folder = new_folder(spark, "t")
    token_files.write_token_files(none, folder, vocabulary("byte_bpe_50k.json"))
    assert token_files.read_token_files(spark, folder).collect() == []


def test_substring_dedup(docs, none):
    got = keyed(substring_dedup.repeated_documents(docs).collect())
    assert sorted(got) == [4, 5] and len(got[4]) == 2
    assert substring_dedup.repeated_documents(none).collect() == []


def test_personal_data(docs, none):
    got = keyed(personal_data.find(docs).collect())
    assert sum(map(len, got.values())) == len(ROWS)
    assert got[1][0].spans == [] and [(s.kind, s.start, s.end) for s in got[6][0].base] == [(0, 27, 35)]
    assert personal_data.find(none).collect() == []


def test_packing(docs, none):
    got = packing.pack(docs, vocabulary("word_bpe_49k.json"), with_ids=True)
    rows = got.collect()
    by_seq = {}
    for r in rows:
        assert r.length == len(r.ids) <= packing.CAPACITY
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_seq.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= packing.CAPACITY
    assert {r.id: r.length for r in rows if r.id in (1, 2, 3)} == {1: 1, 2: 1, 3: 1}
    assert packing.sequences(got).count() == len(by_seq)
    assert packing.pack(none, vocabulary("word_bpe_49k.json")).collect() == []


def test_near_dedup(docs, none):
    got = keyed(near_dedup.near_duplicates(docs).collect())
    assert got[1][0].n_shingles == 0 and got[1][0].kept and got[3][0].kept
    assert [r.component_id for r in got[4]] == [4, 4] and all(r.kept for r in got[4])
    assert got[5][0].component_id == 4 and not got[5][0].kept
    assert got[None][0].n_shingles == 1
    assert near_dedup.near_duplicates(none).collect() == []
    left = near_dedup.keep_one_of_each(docs)
    assert left.columns == docs.columns and sorted(r.doc_id or 0 for r in left.collect()) == [0, 1, 2, 3, 4, 4, 6]


def test_warc(spark):
    html = "<p>" + "x" * 200
    rows = [(3, "u", html, "k"), (1, "u\r\nX: y", html, "k"), (2, None, html, "k"), (4, "v", None, "k"), (5, "v", "", "k"), (6, "v", "é" * 10, "k"), (7, "v", "é" * 10, "k"), (None, "v", html, "k"), (1, "u", html, "k")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    folder = new_folder(spark, "w")
    got = keyed(warc.read_archives(spark, folder, warc.write_archives(pages, folder)).collect(), "page_id")
    assert [r.record_type for r in got[1]] == ["response"] * 2
    assert all(got[k][0].record_type == "revisit" and got[k][0].refers_to == 1 and got[k][0].payload_bytes == 203 for k in (2, 3, None))
    assert all(got[k][0].record_type == "response" for k in (4, 5, 6, 7)) and got[6][0].payload_bytes == 20
    folder = new_folder(spark, "w")
    names = warc.write_archives(pages.limit(0), folder)
    assert names == [] and warc.read_archives(spark, folder, names).collect() == []


def test_warc_damage():
    import io

    out = io.BytesIO()
    w = warc.Writer(out, [b"abc" * 50])
    head = [("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>"), ("WARC-Date", "2024-01-01T00:00:00Z")]
    w.write(head, b"hello")
    raw = out.getvalue()
    assert warc.records_of(raw)[0][1] == b"hello"
    for bad in (raw[:-3], raw[8:], b"\0" * 8 + raw[8:]):
        with pytest.raises(warc.ArchiveError):
            warc.records_of(bad)
    with pytest.raises(warc.ArchiveError):
        warc.parse(warc.record(head, b"hello").replace(b"Length: 5", b"Length: 6"))


def test_language_id(docs, none):
    got = keyed(language_id.identify(docs).collect())
    assert got[1][0].lang_pred == "und" and got[2][0].lang_pred == "und" and got[3][0].lang_pred == "und"
    assert all(0 <= r.score <= 1 for rows in got.values() for r in rows)
    assert sum(map(len, got.values())) == len(ROWS)
    assert language_id.identify(none).collect() == []


def test_quality(docs, none):
    labels = docs.select("doc_id").where("doc_id = 4")
    got = quality.assess(docs, labels, out="judged").collect()
    by = keyed(got, "doc_id")
    assert len(got) == len(ROWS) and by[1][0].judged.n_words == 0 and by[1][0].judged.base_failed
    assert by[4][0].judged.n_repeat_words == 80000 and not by[4][0].judged.kept
    assert quality.assess(none, labels, out="judged").collect() == []
    assert quality.keep_good(docs, labels.limit(0)).columns == docs.columns


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame([(1, "one two"), (10, "Words word AND other words"), (2, None), (3, "")], "item_id long, text string")
    got = keyed(decontam.annotate(docs, items, out="hit").collect(), "doc_id")
    assert got[None][0].hit.n_hit == 2 and got[None][0].hit["items"] == ["1"]
    assert got[4][0].hit.n_hit == 79997 and got[4][0].hit["items"] == ["10"]
    assert got[1][0].hit.n_words == 0 and got[6][0].hit.n_hit == 0
    assert decontam.annotate(none, items, out="hit").collect() == []
    assert decontam.annotate(docs, items.limit(0), out="hit").where("hit.n_hit > 0").collect() == []
    assert decontam.cut_spans(docs, items).where("doc_id is null").first().text == ""
    left = decontam.remove_contaminated(docs, items)
    assert left.columns == docs.columns and left.count() == 4


def test_decontamination_blocks(spark, docs, monkeypatch):
    items = spark.createDataFrame([(1, "one two"), (2, "mail a"), (3, "b c de"), (4, "a b c")], "item_id long, text string")
    whole = decontam.annotate(docs, items, out="hit").orderBy("doc_id").collect()
    monkeypatch.setattr(decontam.item_blocks, "__defaults__", (1,))
    parts = decontam.annotate(docs, items, out="hit").orderBy("doc_id").collect()
    assert [(r.hit.n_words, r.hit.n_hit, r.hit["items"]) for r in whole] == [(r.hit.n_words, r.hit.n_hit, r.hit["items"]) for r in parts]
