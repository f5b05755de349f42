"""The queries ``opN_<name>`` over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TOKENIZER, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def tokenizer_path(name: str) -> str:
    """A public vocabulary file; its place is a parameter of the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    out = pack(_table(spark, sf_dir, "documents"), tokenizer_path(TOKENIZER), tokenizer_pattern())
    return out.withColumnRenamed("id", "doc_id")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import duplicate_lines

    out = duplicate_lines(_table(spark, sf_dir, "documents"), every=True)
    return out.withColumnRenamed("id", "doc_id").withColumnRenamed("class_id", "class_doc_id")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    trusted = _table(spark, sf_dir, "labels").filter("quality = 1")
    return quality_rules(_table(spark, sf_dir, "documents"), trusted).withColumnRenamed("id", "doc_id")


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    out = near_duplicates(_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op6_vp_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    rows = _table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.filter(F.col("vec_id") % 20 == 0))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_folder, read_archives, write_archives

    pages = _table(spark, sf_dir, "pages")
    folder = archive_folder(pages)
    records = read_archives(write_archives(pages, folder), folder)
    return records.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import remove_repeats

    out = remove_repeats(_table(spark, sf_dir, "documents"))
    return out.withColumnRenamed("id", "doc_id")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece_codec import encode_digests

    out = encode_digests(_table(spark, sf_dir, "documents"), tokenizer_path(PIECES))
    return out.withColumnRenamed("id", "doc_id")


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract

    return extract(_table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


# SQL of the queries over the same tables.

NEAR_DUPLICATES = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w FROM documents),
 s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) END s FROM w),
 u AS (SELECT doc_id, unnest(s) g FROM s),
 p AS (SELECT a.doc_id a, b.doc_id b, count(*) c FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
 l AS (SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * c >= 85 * (len(x.s) + len(y.s) - c)),
 e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
 r AS (SELECT DISTINCT a n, a m FROM e UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.n),
 c AS (SELECT n, min(m) m FROM r GROUP BY n)
 SELECT doc_id, len(s)::BIGINT n_shingles, coalesce(m, doc_id) component_id, coalesce(m, doc_id) = doc_id kept FROM s LEFT JOIN c ON n = doc_id"""
ARCHIVES = """WITH p AS (SELECT page_id, coalesce(html, '') h FROM pages), d AS (SELECT page_id, octet_length(encode(h)) b, sha1(h) s FROM p), g AS (SELECT *, max(page_id) OVER (PARTITION BY s) m FROM d)
 SELECT page_id, b::BIGINT payload_bytes, s payload_digest, CASE WHEN b >= 1000 AND page_id <> m THEN 'revisit' ELSE 'response' END record_type, CASE WHEN b >= 1000 AND page_id <> m THEN m END refers_to FROM g"""
REPEATS = r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w FROM documents),
 h AS (SELECT doc_id, [md5(array_to_string(w[i:i + 34], ' ')) for i in range(1, len(w) - 33)] h FROM w WHERE len(w) >= 35),
 x AS (SELECT doc_id, unnest(h) g, generate_subscripts(h, 1) i FROM h),
 t AS (SELECT g FROM x GROUP BY g HAVING count(*) > 1),
 r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) i FROM x WHERE g IN (SELECT g FROM t)),
 k AS (SELECT doc_id, unnest(w) x, generate_subscripts(w, 1) i FROM w),
 j AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) t FROM k ANTI JOIN r USING (doc_id, i) GROUP BY 1),
 n AS (SELECT doc_id, count(*) n FROM r GROUP BY 1)
 SELECT doc_id, len(w)::BIGINT n_words, coalesce(n, 0)::BIGINT n_removed, sha256(coalesce(t, '')) kept_sha256 FROM w LEFT JOIN j USING (doc_id) LEFT JOIN n USING (doc_id)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_toxicity, op3_line_dedup, op4_quality_rules, op5_minhash, op6_vp_trees, op7_warc, op8_substring_dedup, op9_sentencepiece, op10_html_extract)}


def oracle_sql() -> dict[str, str]:
    return {"op5_minhash": NEAR_DUPLICATES, "op7_warc": ARCHIVES, "op8_substring_dedup": REPEATS}
