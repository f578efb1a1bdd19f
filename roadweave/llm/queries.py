"""The operators over the given tables: one query each, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, filter_audit, language_id, line_dedup, near_dedup, packing, personal_data, prefix_trie, quality, secret_scan, substring_dedup, token_files, warc
from .common import new_folder, read_table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = secret_scan.scan(docs, owner="source", repository=F.concat_ws("/", "source", "lang"))
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        F.col("id").alias("doc_id"),
        n(0).alias("n_assign"),
        n(1).alias("n_access"),
        n(2).alias("n_hex"),
        F.sha2(secret_scan.spans_text(F.col("base")), 256).alias("base_sha256"),
        secret_scan.spans_text(F.col("spans")).alias("spans"),
        "n_live",
        "n_example",
        secret_scan.counts_text(F.col("counts")).alias("counts"),
    )


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "tokens")
    token_files.write_token_files(read_table(spark, sf_dir, "documents"), folder, vocabulary("byte_bpe_50k.json"))
    return token_files.read_token_files(spark, folder, with_ids=False)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with repeated passages; the others have no row."""
    return substring_dedup.repeated_documents(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.find(read_table(spark, sf_dir, "documents"))
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        F.col("id").alias("doc_id"),
        n(0).alias("n_email"),
        n(1).alias("n_ip"),
        n(2).alias("n_card"),
        n(3).alias("n_phone"),
        F.sha2(personal_data.spans_text(F.col("base")), 256).alias("base_sha256"),
        personal_data.spans_text(F.col("spans")).alias("spans"),
    )


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(read_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return packed.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(read_table(spark, sf_dir, "documents"), shingle=3, percent=85)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    names = warc.write_archives(read_table(spark, sf_dir, "pages"), folder)
    return warc.read_archives(spark, folder, names, with_payload=False)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the documents that the labels call good and not toxic."""
    return read_table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.assess(docs, trusted_ids(spark, sf_dir)).select("doc_id", "quality.*")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.annotate(docs, read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "found.n_words",
        "found.n_hit",
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"),
        (F.col("found.n_hit") > 0).alias("contaminated"),
    )


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.report(docs, line_dedup.keep_bitmaps(docs)).withColumnRenamed("id", "doc_id")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    tested = filter_audit.tested_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return filter_audit.audit(tested)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(read_table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_token_files": op2_token_files,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_personal_data": op4_personal_data,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_warc": op7_warc,
    "op8_language_id": op8_language_id,
    "op9_quality_rules": op9_quality_rules,
    "op10_decontamination": op10_decontamination,
    "op11_line_dedup": op11_line_dedup,
    "op12_filter_audit": op12_filter_audit,
    "op13_prefix_trie": op13_prefix_trie,
}

#: Only A-Z are lower-cased by the contracts.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: DuckDB SQL of those that SQL can express on whole tables.
ORACLE_SQL: dict[str, str] = {
    "op6_minhash_near_dedup": rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
 s AS (SELECT doc_id, CASE WHEN len(ws) >= 3 THEN list_distinct([ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FOR i IN range(1, len(ws) - 1)]) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS shingles FROM w),
 n AS (SELECT doc_id, len(shingles) AS n_shingles FROM s), u AS (SELECT doc_id, unnest(shingles) AS g FROM s),
 b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM u x JOIN u y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
 l AS (SELECT a, b FROM b JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n_shingles + q.n_shingles - c)), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
 r(doc_id, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.root = e.a)
 SELECT doc_id, CAST(n_shingles AS BIGINT) AS n_shingles, min(root) AS component_id, doc_id = min(root) AS kept FROM r JOIN n USING (doc_id) GROUP BY doc_id, n_shingles""",
    "op7_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS html, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes FROM pages), f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY html) ELSE page_id END AS first FROM p)
 SELECT page_id, payload_bytes, sha256(html) AS payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, nullif(first, page_id) AS refers_to FROM f""",
    "op10_decontamination": rf"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents), i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE item_id IS NOT NULL),
 v AS (SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[p : p + least(10, len(ws)) - 1], ' ') AS w FROM (SELECT *, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS p FROM i WHERE len(ws) > 0)),
 k AS (SELECT DISTINCT n FROM v), x AS (SELECT doc_id, p, n, array_to_string(ws[p : p + n - 1], ' ') AS w FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM d, k WHERE len(ws) >= n)),
 h AS (SELECT doc_id, p, x.n, item_id FROM x JOIN v ON v.n = x.n AND v.w = x.w), c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY ALL),
 o AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM h GROUP BY ALL)
 SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN o USING (doc_id)""",
    "op11_line_dedup": """WITH l AS (SELECT doc_id, p, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS p FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
 f AS (SELECT k, min(doc_id) AS first FROM l WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1), m AS (SELECT l.*, coalesce(doc_id > first, false) AS gone FROM l LEFT JOIN f USING (k))
 SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id""",
    "op12_filter_audit": r"""WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents), g AS (SELECT x, min(doc_id) AS first FROM w GROUP BY x),
 f AS (SELECT part, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic, [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws), 100 * len(regexp_extract_all(x, '[A-Z]')) > 2 * length(x), regexp_matches(x, '[#$%&*|]'), doc_id > first] AS b FROM w JOIN g USING (x) LEFT JOIN labels USING (doc_id)),
 m AS (SELECT part, b, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL), e AS (SELECT unnest(range(1, 6)) AS e),
 o AS (SELECT [a.e, b.e, c.e, d.e, z.e] AS o FROM e a, e b, e c, e d, e z WHERE a.e NOT IN (b.e, c.e, d.e, z.e) AND b.e NOT IN (c.e, d.e, z.e) AND c.e NOT IN (d.e, z.e) AND d.e <> z.e),
 s AS (SELECT o, array_to_string(list_transform(o, lambda i: 'ABCDE'[i]), '') AS filter_order, e AS step, o[e] AS me, o[:e - 1] AS before FROM o, e),
 r AS (SELECT part, filter_order, step, me, n, good, toxic, b[me] AS fails, coalesce(list_bool_or(list_transform(before, lambda i: b[i])), false) AS earlier, len(list_filter(b, lambda v: v)) AS failed FROM m, s),
 c AS (SELECT part, filter_order, step, me, coalesce(sum(n) FILTER (NOT earlier AND NOT fails), 0) AS kept, coalesce(sum(n) FILTER (NOT earlier AND fails), 0) AS removed, coalesce(sum(n) FILTER (earlier AND fails), 0) AS redundant, coalesce(sum(n) FILTER (fails AND failed = 1), 0) AS unique_fails,
  coalesce(sum(good) FILTER (NOT earlier AND fails), 0) AS good_lost, coalesce(sum(toxic) FILTER (NOT earlier AND fails), 0) AS toxic_lost FROM r GROUP BY ALL)
 SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, me) AS BIGINT) AS shapley FROM c""",
    "op13_prefix_trie": """WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS i, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
 k AS (SELECT c, n, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda y: [ascii(y), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda s, y: CASE WHEN y >= 0 THEN xor(s, y) ELSE xor(s >> 1, 3988292384 * (s & 1)) END), 4294967295) % 6 AS h FROM (SELECT c, count(*) AS n FROM t GROUP BY c)),
 b AS (SELECT k.c, t.i, r, x FROM k JOIN t ON t.c = k.c - k.c % 100 AND t.i < k.h UNION ALL SELECT k.c, t.i - k.h + least(k.h, coalesce(o.n, 0)), r, x FROM k JOIN t ON t.c = k.c AND t.i >= k.h LEFT JOIN k o ON o.c = k.c - k.c % 100),
 l AS (SELECT k.c, coalesce(s, []) AS s FROM k LEFT JOIN (SELECT c, list({'r': r, 'x': x} ORDER BY i) AS s FROM b GROUP BY c) USING (c)), p AS (SELECT c, d, len(s) AS n, s[1:d] AS pre FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM l)),
 n AS (SELECT d, pre, min(c) AS m, count(*) AS n_convs, (count(*) - 1) * coalesce(length(pre[d].x), 0) AS own, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (d = n) AS ends FROM p GROUP BY d, pre), q AS (SELECT p.c, p.d, n.m FROM p JOIN n USING (d, pre)),
 a AS (SELECT n.m, n.d, q.m AS parent FROM n LEFT JOIN q ON q.c = n.m AND q.d = n.d - 1), h AS (SELECT parent AS m, d - 1 AS d, count(*) AS n_children FROM a WHERE d > 0 GROUP BY ALL),
 z AS (SELECT q.m, q.d, sum(CASE WHEN n_children IS NULL THEN 1 ELSE 0 END) AS leaves, sum(own) AS saved FROM n LEFT JOIN h USING (m, d) JOIN q ON q.c = n.m AND q.d <= n.d GROUP BY ALL)
 SELECT n.m AS conv_id, n.d AS depth, parent AS parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256 FROM n JOIN a USING (m, d) JOIN z USING (m, d) LEFT JOIN h USING (m, d)""",
}
