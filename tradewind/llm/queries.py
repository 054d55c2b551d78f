"""Registered queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.llm import decontaminate, fixity, forest_neighbours, jaccard_join, language_id, line_blocks, ranked_search, secret_ownership, suffix_dedup, surrogates, token_alignment, trie_bpe, url_lists
from tradewind.llm.common import read_table
from tradewind.llm.url_lists import url_host, url_path

def tokenizer_file(name: str) -> str:
    """A public tokenizer's file, from the folder that is set or else from the installed package."""
    folder = os.environ.get("TOKENIZER_DIR")
    return f"{folder}/{name}" if folder else public_tokenizers.path(name)


def op1_forest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    found = forest_neighbours.nearest(read_table(spark, folder, "embeddings"), F.col("id") % 50 == 0)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


def op2_secret_ownership(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    found = secret_ownership.audit(docs, owner_col="source", repository_col=F.concat_ws("/", "source", "lang"))

    def written(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def many(spans, field, value):
        return F.size(F.filter(spans, lambda s: s[field] == value)).cast("long").alias(f"n_{value}")

    base = F.filter("spans", lambda s: s["kind"].isin(*secret_ownership.BASE_KINDS))
    return found.select(
        F.col("id").alias("doc_id"),
        *[many("spans", "kind", kind) for kind in secret_ownership.BASE_KINDS],
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
        *[many("classed", "class", name) for name in ("live", "shared", "example")],
    )


def op3_url_list_asof(spark: SparkSession, folder: str) -> DataFrame:
    """Captures are the pages, fetched on days that follow from their ids. Every host, parent domain and first folder of
    the pages is listed, taken off and listed again, on days that follow from its first page and number of pages."""
    url = F.col("url")
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(365)).cast("int"))
    captures = read_table(spark, folder, "pages").select("page_id", "url", day.alias("day"))
    host = url_host(url)
    keys = F.array(
        F.struct(F.lit("host").alias("list"), host.alias("key")),
        F.struct(F.lit("domain").alias("list"), F.regexp_replace(host, r"^[^.]*\.", "").alias("key")),
        F.struct(F.lit("folder").alias("list"), F.concat(host, F.lit("/"), F.get(F.split(url_path(url), "/"), F.lit(1)), F.lit("/")).alias("key")),
    )
    listed = captures.select("page_id", F.explode(keys).alias("k")).groupBy("k.list", "k.key").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    added = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("first") * 13, F.lit(365)).cast("int"))
    removed = F.date_add(added, (20 + F.col("n") % 40).cast("int"))
    events = F.array(
        F.struct(F.lit("add").alias("action"), added.alias("day")),
        F.struct(F.lit("remove").alias("action"), removed.alias("day")),
        F.struct(F.lit("add").alias("action"), F.date_add(removed, 30).alias("day")),
    )
    dated = listed.select("list", "key", F.explode(events).alias("e")).select("list", "key", "e.action", "e.day")
    return url_lists.active_entries(captures, url_lists.intervals(dated), "page_id", "url", "day")


SQL_OP3 = """
WITH capture AS (
  SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)) AS host,
         regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS path, DATE '2024-01-01' + CAST(page_id % 365 AS INTEGER) AS day
  FROM pages),
key_ AS (
  SELECT 'host' AS list, host AS key, page_id FROM capture
  UNION ALL SELECT 'domain', regexp_replace(host, '^[^.]*\\.', ''), page_id FROM capture
  UNION ALL SELECT 'folder', host || '/' || string_split(path, '/')[2] || '/', page_id FROM capture),
listed AS (
  SELECT list, key, DATE '2024-01-01' + CAST((min(page_id) * 13) % 365 AS INTEGER) AS added, CAST(20 + count(*) % 40 AS INTEGER) AS days
  FROM key_ GROUP BY list, key),
span AS (
  SELECT list, key, added AS valid_from, added + days AS valid_to FROM listed WHERE key IS NOT NULL
  UNION ALL SELECT list, key, added + days + 30, NULL FROM listed WHERE key IS NOT NULL),
part AS (SELECT page_id, day, host, path, string_split(host, '.') AS labels, string_split(path, '/') AS folders FROM capture),
own AS (
  SELECT DISTINCT page_id, day, unnest([host, host || path]
    || list_transform(range(1, len(labels)), lambda i: array_to_string(labels[i:], '.'))
    || list_transform(range(1, len(folders)), lambda i: host || array_to_string(folders[:i], '/') || '/')) AS key
  FROM part WHERE host <> ''),
hit AS (
  SELECT page_id, count(*) AS n, array_to_string(list_sort(list(DISTINCT list)), ',') AS lists, min(valid_from) AS since
  FROM own JOIN span USING (key) WHERE day >= valid_from AND (valid_to IS NULL OR day < valid_to) GROUP BY page_id)
SELECT page_id, day, n IS NOT NULL AS blocked, CAST(coalesce(n, 0) AS BIGINT) AS n_entries, coalesce(lists, '') AS lists, since
FROM capture LEFT JOIN hit USING (page_id)
"""


def op4_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    return surrogates.replace_entities(docs, os.environ.get("SURROGATE_KEY", "a key for tests"))


def op5_trie_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return trie_bpe.encode(
        read_table(spark, folder, "documents"),
        tokenizer_file("word_bpe_49k.json"),
        columns=("n_tokens", "ids_sha256", "decoded_sha256"),
    )


def op6_qgram_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contaminated(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "item_id", "segments", "edits")


def op7_adaptive_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    found = jaccard_join.similar_documents(read_table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op8_merkle_audit(spark: SparkSession, folder: str) -> DataFrame:
    """The pages as response records, 1000 to a file, and a second replica of them with damage: in some records a byte
    was changed, some are missing, and some files hold a record that was put in at their end."""
    pages = read_table(spark, folder, "pages").select(
        F.concat(F.lit("crawl-"), F.lpad(F.expr("CAST(page_id DIV 1000 AS STRING)"), 9, "0"), F.lit(".warc")).alias("file"),
        F.col("page_id").alias("place"),
        fixity.warc_record(F.col("url"), F.col("html")).alias("record"),
    )
    first = fixity.laid_out(pages)
    changed = F.when(F.col("place") % 97 == 5, F.concat(F.lit("w"), F.expr("substring(record, 2)"))).otherwise(F.col("record"))
    damaged = fixity.laid_out(pages.withColumn("record", changed))
    extra = damaged.groupBy("file").agg(F.max(F.col("offset") + F.col("length")).alias("offset"))
    extra = extra.select("file", "offset", F.lit(6).cast("long").alias("length"), F.sha2(F.lit("put in").cast("binary"), 256).alias("hash"))
    second = damaged.filter("place % 101 <> 7").select("file", "offset", "length", "hash").unionByName(extra)
    return fixity.audit(first, second)


SQL_OP8 = """
WITH record AS (
  SELECT 'crawl-' || lpad(CAST(page_id // 1000 AS VARCHAR), 9, '0') || '.warc' AS file, page_id,
         CAST(strlen('WARC/1.1rnWARC-Type: responsernWARC-Target-URI: ' || coalesce(url, '') || 'rnContent-Length: '
           || CAST(strlen(coalesce(html, '')) AS VARCHAR) || 'rnrn' || coalesce(html, '') || 'rnrn') AS BIGINT) AS length
  FROM pages),
placed AS (
  SELECT *, CAST(coalesce(sum(length) OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
  FROM record)
SELECT file, "offset", length, CASE WHEN page_id % 101 = 7 THEN 'missing' ELSE 'changed' END AS status
FROM placed WHERE page_id % 101 = 7 OR page_id % 97 = 5
UNION ALL SELECT file, max("offset" + length), 6, 'extra' FROM placed GROUP BY file
"""


def op9_line_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return line_blocks.extract(read_table(spark, folder, "pages"))


def op10_language_fusion(spark: SparkSession, folder: str) -> DataFrame:
    found = language_id.identify(read_table(spark, folder, "documents"), declared=F.col("lang"), host=F.col("source"))
    return found.select(F.col("id").alias("doc_id"), "declared", "language", "by_text", "probability", "accepted")


def op11_identity_alignment(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    found = token_alignment.align(docs, tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"), with_groups=False)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_prefix_doubling(spark: SparkSession, folder: str) -> DataFrame:
    found = suffix_dedup.without_repeats(read_table(spark, folder, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        (F.length("kept") + removed).cast("long").alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op13_limited_accumulators(spark: SparkSession, folder: str) -> DataFrame:
    found = ranked_search.search(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))
    return found.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


SQL_OP13 = r"""
WITH word AS (
  SELECT doc_id, row, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT doc_id, text, row_number() OVER () AS row FROM documents)),
held AS (SELECT row, any_value(doc_id) AS doc_id, term, CAST(count(*) AS BIGINT) AS tf FROM word GROUP BY row, term),
size AS (SELECT row, CAST(sum(tf) AS BIGINT) AS n FROM held GROUP BY row),
whole AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS total FROM size),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM held, whole GROUP BY term),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
scored AS (
  SELECT item_id, doc_id, row, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total)))) AS BIGINT) AS score
  FROM asked JOIN held USING (term) JOIN size USING (row) JOIN weight USING (term), whole GROUP BY item_id, doc_id, row)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 10
"""

QUERIES = {f.__name__: f for f in (op1_forest_neighbours, op2_secret_ownership, op3_url_list_asof, op4_surrogates, op5_trie_bpe, op6_qgram_decontamination, op7_adaptive_jaccard, op8_merkle_audit, op9_line_blocks, op10_language_fusion, op11_identity_alignment, op12_prefix_doubling, op13_limited_accumulators)}
SQL: dict[str, str] = {"op3_url_list_asof": SQL_OP3, "op8_merkle_audit": SQL_OP8, "op13_limited_accumulators": SQL_OP13}
