"""The queries of the training-data operators: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import chat, decontaminate, exact_dedup, fill_middle, fingerprint, html_text, ngram_join, packing, pii, quality, token_count, warc, whitening
from lodestone.llm.common import table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), columns=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chat.rotate(table(spark, sf_dir, "conversations"))
    mask = F.expr("array_join(transform(mask, m -> concat(m.start, ':', m.end)), ',')")
    return made.select(F.col("conv").alias("conv_id"), "part", "speaker", "n_turns", "rendered", mask.alias("mask"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), columns=["doc_id"])


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_duplicates(table(spark, sf_dir, "documents"), columns=["doc_id"])


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"), columns=["doc_id"])


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve_revisits(warc.records_of_pages(table(spark, sf_dir, "pages")))
    headers = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return found.withColumn("headers", headers)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"), columns=["page_id", "url"])


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), columns=["doc_id"])


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = ngram_join.link_documents(table(spark, sf_dir, "documents"))
    return marked.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = whitening.whiten(table(spark, sf_dir, "embeddings"), columns=["vec_id"])
    # The exact number in full, and as a long where it fits one.
    return made.withColumnRenamed("deviation", "deviation_exact").withColumn("deviation", F.expr("try_cast(deviation_exact as bigint)"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.restore(fill_middle.fill_in_middle(table(spark, sf_dir, "documents"), columns=["doc_id"]))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fingerprint.compare_with_next(table(spark, sf_dir, "documents"))
    return made.withColumns({c: fingerprint.rendered(F.col(c)) for c in ("fingerprint", "edited_fingerprint")})


_ALL = (
    op1_best_fit_packing,
    op2_benchmark_decontamination,
    op3_chat_perspectives,
    op4_quality_classifier,
    op5_exact_dedup,
    op6_personal_data,
    op7_warc_revisits,
    op8_html_extraction,
    op9_token_counts,
    op10_ngram_jaccard_join,
    op11_embedding_whitening,
    op12_fill_in_middle,
    op13_fingerprints,
)
QUERIES = {f.__name__: f for f in _ALL}

ORACLE_SQL = {
    "op3_chat_perspectives": chat.ORACLE,
    "op7_warc_revisits": warc.ORACLE,
    "op13_fingerprints": fingerprint.ORACLE,
    "op12_fill_in_middle": """
        WITH a AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS h FROM documents),
        b AS (SELECT *, length(t) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
          ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM a),
        c AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS p, greatest(h1 % (n + 1), h2 % (n + 1)) AS q,
          CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
            WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM b),
        d AS (SELECT *, substr(t, 1, p) AS pre, substr(t, p + 1, q - p) AS mid, substr(t, q + 1, n - q) AS suf FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN q - p END AS middle_chars,
          sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
            ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
        FROM d
    """,
    "op5_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
          doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
}
