"""The pipeline against a plain version of each stage, on the smallest tables."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers

import corpus_pipeline
from lodestone.llm.quality import score_documents
from tests.llm.test_ngram_join import plain
from tests.llm.test_texts import check_packing, plain_contamination


def test_pipeline(spark, sf):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good = {r.doc_id for r in score_documents(docs, labels, columns=["doc_id"]).where("predicted = 1").collect()}
    assert good
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect() if r.doc_id in good]
    last = {}
    for i, t in rows:
        last[t] = max(i, last.get(t, i))
    rows = sorted((i, t) for t, i in last.items())
    rows = [r for r, (i, _, c) in zip(rows, plain(rows), strict=True) if c == i]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = [(i, t) for i, t in rows if not plain_contamination(t, items, 10)[-1]]
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in got} == {i for i, _ in rows}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own = defaultdict(list)
    for r in got:
        own[r.doc_id].append(r)
    for i, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        pieces = sorted(own[i], key=lambda r: r.piece)
        assert [r.ids_crc32 for r in pieces] == [zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in pieces]
        assert sum(r.length for r in pieces) == len(ids)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.length, r.offset))
    check_packing(bins, 1024)


def test_stages_keep_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns
