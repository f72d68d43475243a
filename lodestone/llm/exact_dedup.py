"""Exact deduplication by two-pass Bloom filtering, with DataFrame operations only.

Pass one puts the hash of every text into a filter of ``BITS_PER_ROW`` bits a row, and finds the bits that more than one row
has set. As a table this filter is sparse: a row for each bit set, counted in the tasks first, so one text with a third of
all rows is one row a task. (Whole bitmaps, one a task, would be larger from about a dozen tasks on: 2 bytes a row of the table
for each task, against one narrow row for each row of the table.) The hashes whose bit is set more than once fill a Bloom
filter that is broadcast.

Pass two tests every row against it where it lies. Rows that it rules out have a text that no other row has, and pass straight
through; only the others, repeated rows and a few false positives, are joined with the groups of equal texts. The filter
has at most ``filter_bytes``: beyond about two million repeated hashes a MB its false positives rise slowly. No plan changes
with the size of the table, and the texts of rows that are ruled out are in no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import discard, fresh, materialise, whole
from lodestone.llm.filters import FILTER_BYTES, bloom, tested

BITS_PER_ROW = 16


def _bit(sha: str, n_rows: int) -> Column:
    return F.expr(f"pmod(xxhash64(`{sha}`), {max(1, n_rows * BITS_PER_ROW)}L)")


def repeated_bits(prints: DataFrame, n_rows: int) -> DataFrame:
    """The bits (bit) of a filter for ``n_rows`` rows that more than one row of ``prints`` (column ``sha``) has set."""
    return prints.groupBy(_bit("sha", n_rows).alias("bit")).agg(F.count("*").alias("n")).where("n > 1").select("bit")


def mark_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", columns: list[str] | None = None, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """All rows of ``docs``, with all columns or those named, with ``keep_id``, ``group_size`` (long), ``kept`` (boolean) and ``text_sha256``.

    Texts are equal when their UTF-8 bytes are (their SHA-256 is compared). Of equal texts the row with the largest id stays.
    With ``columns`` the texts are read once, and what is decided on is a table of these columns and fingerprints; otherwise
    whole rows are carried.

    - A null text counts as the empty text. Empty texts are equal to each other.
    - A null id is smaller than any id; ``keep_id`` is null where all ids of a group are.
    - Repeated rows (same text, same id): exactly one of them has ``kept``.
    - An empty table gives an empty result. Very long texts are hashed like others.
    - Columns of ``docs`` named like a new one are replaced by it.
    """
    named = [c for c in (docs.columns if columns is None else columns) if c not in ("keep_id", "group_size", "kept", "text_sha256")]
    own, sha = fresh(docs, "row_id"), fresh(docs, "sha")
    rows = docs.select(*[F.col(f"`{c}`") for c in named], F.col(f"`{id_col}`").alias(own), F.unhex(F.sha2(whole(text_col), 256)).alias(sha))
    if columns is not None:
        rows = materialise(rows, "prints")
    prints = rows if columns is not None else materialise(rows.select(own, sha), "prints")
    narrow = prints.select(F.col(own).alias("id"), F.col(sha).alias("sha"))
    n_rows = narrow.count()
    bits = materialise(repeated_bits(narrow, n_rows), "bits")
    known = bloom(bits.select(F.xxhash64("bit").alias("h")), bits.count(), filter_bytes)
    tests = lambda df, sha, name: tested(df, F.xxhash64(_bit(sha, n_rows)), known, name)

    # Groups of two rows or more: narrow, few, and used twice, so written once.
    again = tests(narrow, "sha", "maybe").where("maybe").groupBy("sha", "id").agg(F.count("*").alias("n"))
    groups = again.groupBy("sha").agg(F.max(F.struct("id", "n")).alias("top"), F.sum("n").alias("group_size")).where("group_size > 1")
    size, top, ties, maybe, task, turn = (fresh(rows, n) for n in ("group_size_", "top_id", "ties", "maybe", "task", "turn"))
    groups = materialise(groups.select(F.col("sha").alias(sha), F.col("top.id").alias(top), F.col("group_size").alias(size), F.col("top.n").alias(ties)), "groups")
    if columns is None:
        discard(prints)

    # Groups with a thousandth of all rows or more, a thousand at most, are told to the rows where they lie.
    large = F.col(size) >= max(1, n_rows // 1000)
    probed = tests(rows, sha, maybe).join(F.broadcast(groups.where(large)), sha, "left")
    here = ~F.col(maybe) | F.col(size).isNotNull()
    moved = probed.where(~here).drop(size, top, ties).join(groups.where(~large), sha, "left")
    known_rows = probed.where(here).unionByName(moved)
    alone = F.col(size).isNull()
    decided = known_rows.withColumns({
        "keep_id": F.when(alone, F.col(own)).otherwise(F.col(top)),
        "group_size": F.coalesce(F.col(size), F.lit(1)).cast("long"),
        "kept": alone | F.col(own).eqNullSafe(F.col(top)),
        "text_sha256": F.lower(F.hex(sha)),
    })
    out = [*[F.col(f"`{c}`") for c in named], "keep_id", "group_size", "kept", "text_sha256"]
    if groups.where(F.col(ties) > 1).isEmpty():
        return decided.select(out)
    # Repeated rows that share the id that stays: the first of each task, then the first of these.
    tied = F.col("kept") & (F.coalesce(F.col(ties), F.lit(1)) > 1)
    turns = decided.where(tied).withColumn(task, F.spark_partition_id())
    turns = turns.withColumn(turn, F.row_number().over(Window.partitionBy(sha, task).orderBy("keep_id")))
    turns = turns.withColumn(task, F.when(F.col(turn) == 1, -1).otherwise(F.col(task)))
    turns = turns.withColumn("kept", (F.row_number().over(Window.partitionBy(sha, task).orderBy("keep_id")) == 1) & (F.col(turn) == 1))
    return decided.where(~tied).select(out).unionByName(turns.select(out))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, with its columns; see ``mark_duplicates``."""
    named = docs.columns
    safe = docs.toDF(*[f"c{i}" for i in range(len(named))])
    at = {c: f"c{i}" for i, c in enumerate(named)}
    marked = mark_duplicates(safe, at[id_col], at[text_col], **options)
    return marked.where("kept").select(*[F.col(at[c]).alias(c) for c in named])
