"""The given tables in the shape of the records that the operators work on.

Each adapter is one SELECT over the given tables, in SQL that Spark and DuckDB both read, so a query and its SQL twin start
from the same rows; only ``SPACES`` is written for each engine. The second key of samples, inchikey, is of the whole text in lower
case with white space collapsed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "labels")
#: Runs of white space made one space, as each engine writes it.
SPACES = "one_space(lower(d.text))"
SPACES_SPARK = r"regexp_replace(lower(d.text), '[\\x09-\\x0d ]+', ' ')"
SPACES_DUCKDB = r"regexp_replace(lower(d.text), '[\x09-\x0d ]+', ' ', 'g')"

SQL = {
    "samples": f"""
        SELECT d.doc_id AS sample_id, d.source AS source_document, d.lang AS category,
          CASE WHEN l.toxic = 1 THEN 'reject' ELSE 'recognize' END AS expected_action,
          CASE l.quality WHEN 1 THEN 'verified' WHEN 0 THEN 'rejected' ELSE 'pending' END AS review_status,
          md5(d.text) AS content_key, md5(trim({SPACES})) AS inchikey,
          CONCAT(d.lang, ':', CAST(d.n_chars % 23 AS STRING)) AS scaffold_key,
          CASE WHEN d.doc_id % 10 < 8 THEN 'train' WHEN d.doc_id % 10 = 8 THEN 'validation' ELSE 'test' END AS split,
          CASE d.doc_id % 8 WHEN 0 THEN 'CC BY 4.0' WHEN 1 THEN 'https://creativecommons.org/licenses/by-sa/3.0/'
            WHEN 2 THEN 'CC0' WHEN 3 THEN 'CC BY' WHEN 4 THEN 'Public Domain (PubChem)'
            WHEN 5 THEN 'No explicit repository license found' WHEN 6 THEN '' ELSE 'CC BY-NC 4.0' END AS source_license,
          CASE d.doc_id % 5 WHEN 0 THEN 'none' WHEN 1 THEN '' ELSE 'blur' END AS perturbation,
          d.n_chars AS size_bytes
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
    """,
    "predictions": """
        SELECT o_orderkey AS sample_id, CASE WHEN o_orderstatus = 'P' THEN 'reject' ELSE 'recognize' END AS expected_action,
          CONCAT('K', CAST(o_orderkey % 7 AS STRING)) AS truth_key,
          CASE WHEN o_custkey % 11 = 0 THEN NULL WHEN o_custkey % 4 = 0 THEN CONCAT('K', CAST(o_custkey % 7 AS STRING))
            ELSE CONCAT('K', CAST(o_orderkey % 7 AS STRING)) END AS predicted_key,
          o_custkey % 13 <> 0 AS recognition_success,
          (CAST(floor(o_totalprice) AS BIGINT) % 1001) / 1000.0 AS confidence,
          CAST(floor(o_totalprice) AS BIGINT) % 1001 AS confidence_milli,
          CAST(floor(o_totalprice) AS BIGINT) % 20000 AS inference_time_ms,
          CASE o_orderkey % 4 WHEN 0 THEN 'accepted' WHEN 1 THEN 'accepted_with_warning' WHEN 2 THEN 'review_needed'
            ELSE 'rejected' END AS recognition_decision,
          o_orderkey % 3 = 0 AS manual_review_recommended,
          o_orderpriority AS category, o_orderstatus AS image_quality, CONCAT('doc', CAST(o_custkey % 37 AS STRING)) AS source_document,
          CASE o_orderkey % 5 WHEN 0 THEN 'none' WHEN 1 THEN '' ELSE 'blur' END AS perturbation,
          CASE o_orderkey % 6 WHEN 0 THEN 'stereo;charge' WHEN 1 THEN 'ring' WHEN 2 THEN 'ring;salt' ELSE '' END AS structure_features,
          CASE WHEN o_custkey % 13 = 0 THEN CASE o_orderkey % 5 WHEN 0 THEN 'CUDA out of memory at /var/lib/models/a.bin' WHEN 1 THEN 'request timed out'
            WHEN 2 THEN 'cannot identify image file' WHEN 3 THEN 'worker return code 9' ELSE 'strange' END ELSE '' END AS message,
          CASE WHEN o_custkey % 11 = 0 THEN NULL WHEN o_custkey % 4 <> 0 THEN 1.0 ELSE (CAST(floor(o_totalprice * 7) AS BIGINT) % 1000) / 1000.0 END AS tanimoto_similarity,
          o_orderkey % 3 = 1 AS stereo_required, o_custkey % 5 <> 0 AS stereo_match, o_custkey % 6 <> 0 AS atom_count_match,
          o_custkey % 9 <> 0 AS charge_match, o_custkey % 10 <> 0 AS bond_type_match, o_custkey % 8 = 4 AS equivalent,
          o_custkey % 13 <> 0 AND o_orderkey % 9 <> 0 AS backend_success, o_custkey % 11 <> 0 AND o_custkey % 7 <> 0 AS connectivity_exact,
          o_custkey % 4 <> 0 AND o_custkey % 5 <> 0 AS isomeric_exact, o_custkey % 4 <> 0 AND o_custkey % 11 <> 0 AS key_exact,
          o_custkey % 4 <> 0 AND o_custkey % 9 <> 0 AND o_custkey % 11 <> 0 AS full_key_exact, o_custkey % 6 <> 0 AND o_custkey % 11 <> 0 AS formula_match,
          o_custkey % 11 <> 0 AS connectivity_match, o_custkey % 7 <> 0 AND o_custkey % 4 <> 0 AS nonisomeric_exact,
          CASE o_custkey % 4 WHEN 0 THEN 'journal' WHEN 1 THEN 'patent' WHEN 2 THEN 'render' ELSE '' END AS source,
          CASE o_orderkey % 9 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN NULL ELSE 'low' END AS complexity,
          CASE o_orderkey % 10 WHEN 8 THEN 'validation' WHEN 9 THEN 'test' ELSE 'train' END AS split,
          CONCAT('m', CAST(o_orderkey % 3 AS STRING)) AS backend, CASE o_custkey % 3 WHEN 0 THEN 'raw' WHEN 1 THEN 'binary' ELSE 'denoised' END AS preprocessing_strategy,
          CASE WHEN o_custkey % 17 = 0 THEN 'Multiple fragments' ELSE 'single' END AS supported_scope, CASE WHEN o_custkey % 19 = 0 THEN 'metal complex' END AS notes,
          CASE o_orderkey % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'rejected' ELSE 'verified' END AS review_status,
          CASE o_orderkey % 7 WHEN 0 THEN 'license unclear' WHEN 1 THEN '' ELSE 'CC BY 4.0' END AS source_license,
          CONCAT('I', CAST(o_custkey AS STRING)) AS identity_key, CASE WHEN o_custkey % 23 = 0 THEN 'none' ELSE CONCAT('S', CAST(o_custkey % 101 AS STRING)) END AS scaffold_key
        FROM orders
    """,
    "candidates": """
        SELECT l_orderkey AS sample_id, CONCAT('m', CAST(l_linenumber AS STRING)) AS backend, l_linenumber AS priority,
          CASE WHEN l_returnflag = 'R' THEN 'failed' ELSE 'success' END AS status,
          CASE WHEN l_returnflag = 'R' THEN NULL ELSE CONCAT('K', CAST(l_partkey % 5 AS STRING)) END AS canonical_key,
          l_suppkey % 9 <> 0 AS valid, CAST(l_quantity AS BIGINT) AS atom_count, CAST(l_partkey % 3 AS BIGINT) - 1 AS formal_charge,
          CONCAT('K', CAST(l_orderkey % 5 AS STRING)) AS truth_key
        FROM lineitem
    """,
    "boxes": """
        SELECT l_orderkey - l_orderkey % 8 AS page_id, CASE WHEN l_linenumber % 2 = 1 THEN 'truth' ELSE 'proposal' END AS side,
          l_orderkey * 10 + l_linenumber AS box_id,
          (l_partkey * 37) % 400 AS x1, (l_suppkey * 53 + l_orderkey) % 400 AS y1,
          (l_partkey * 37) % 400 + 60 + CAST(l_quantity AS BIGINT) AS x2,
          (l_suppkey * 53 + l_orderkey) % 400 + 60 + CAST(l_quantity AS BIGINT) AS y2,
          CASE l_orderkey % 3 WHEN 0 THEN 'accept_molecule' WHEN 1 THEN 'review_needed' ELSE 'reject_negative' END AS decision
        FROM lineitem
    """,
    "votes": """
        SELECT event_id - event_id % 6 AS sample_id, user_id AS reviewer, ts AS voted_at, event_id AS seq,
          CASE WHEN event_type IN ('error', 'view') THEN 'reject' ELSE 'approve' END AS decision,
          CASE WHEN event_type IN ('error', 'view') THEN '' WHEN event_id % 12 < 9 THEN 'K0' ELSE CONCAT('K', CAST(event_id % 2 AS STRING)) END AS canonical_key
        FROM events
    """,
    "classes": """
        SELECT l_orderkey * 10 + l_linenumber AS sample_id, CONCAT('doc', CAST(l_suppkey % 10 AS STRING)) AS source_document,
          CASE l_partkey % 5 WHEN 0 THEN 'molecule' WHEN 1 THEN 'text' WHEN 2 THEN 'table' WHEN 3 THEN 'reaction' ELSE 'uncertain' END AS truth_class,
          CASE WHEN l_linenumber = 1 THEN 'molecule' ELSE CASE l_partkey % 5 WHEN 0 THEN 'molecule' WHEN 1 THEN 'text' WHEN 2 THEN 'table'
            WHEN 3 THEN 'reaction' ELSE 'uncertain' END END AS predicted_class
        FROM lineitem
    """,
    "history": """
        SELECT CONCAT('a', CAST(o_orderkey AS STRING)) AS analysis_id, o_orderdate AS created_at,
          CONCAT('file_', CAST(o_custkey AS STRING), '.png') AS filename,
          CASE WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'success' END AS status, o_orderpriority AS decision,
          o_orderkey % 10 = 0 AS is_favorite, o_orderkey % 17 = 0 AS protected, CAST(floor(o_totalprice) AS BIGINT) AS size_bytes
        FROM orders
    """,
    "properties": """
        SELECT p_partkey AS compound_id, CAST(floor(p_retailprice) AS BIGINT) % 900 AS molecular_weight, p_size % 8 AS logp,
          p_size % 7 AS hbd, p_size % 13 AS hba, p_partkey % 14 AS rotatable_bonds, p_partkey % 6 AS ring_count,
          p_partkey % 3 AS formal_charge, CONCAT(p_brand, ';', p_type) AS structure_features
        FROM part
    """,
}


def records(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The rows of an adapter over the tables in ``sf_dir``."""
    text = SQL[name].replace(SPACES, SPACES_SPARK)
    for t in TABLES:
        for word in ("FROM", "JOIN"):
            text = text.replace(f"{word} {t}", f"{word} parquet.`{sf_dir}/{t}.parquet`")
    return spark.sql(text)


def twin(body: str, *names: str) -> str:
    """SQL text for DuckDB: ``body`` after the adapters that it names."""
    return "WITH " + ", ".join(f"{n} AS ({SQL[n].replace(SPACES, SPACES_DUCKDB)})" for n in names) + (", " if body.lstrip()[:6].upper() != "SELECT" else " ") + body
