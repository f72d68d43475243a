"""Adapters hand on every row, and keys read whole texts."""

from lodestone.plans import QUERIES
from lodestone.sources.adapters import records


def test_every_line_is_a_box(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    boxes = records(spark, sf, "boxes")
    ids = lines.selectExpr("l_orderkey * 10 + l_linenumber AS box_id")
    assert boxes.count() == lines.count() and not ids.exceptAll(boxes.select("box_id")).count()
    assert QUERIES["p50_scaled_boxes"](spark, sf).count() == lines.count()


def test_second_key_is_of_the_whole_text(spark, tmp_path):
    start = "the same opening of both documents, longer than forty-eight characters: "
    texts = [start + "one", start + "two", start.upper() + "\t One\n", " " + start.replace(" ", "  \n ") + "one ", None]
    spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = {r.sample_id: r for r in records(spark, str(tmp_path), "samples").collect()}
    assert rows[0].inchikey == rows[2].inchikey == rows[3].inchikey != rows[1].inchikey
    assert rows[4].inchikey is None and len({rows[i].content_key for i in range(4)}) == 4
