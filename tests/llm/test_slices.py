"""Parts of a batch give what the whole batch gives."""

import public_tokenizers
import pyarrow as pa

from lodestone.llm import ngram_join, packing, slices, token_count
from tests.llm.test_texts import texts


def test_slices_cut_no_row_and_change_no_result():
    rows = texts(600, 11)
    whole = pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array(rows)], names=["id", "text"])
    parts = list(slices.slices(iter([whole]), 1, 500))
    assert len(parts) > 20
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(len(rows)))
    assert [t for p in parts for t in slices.texts_of(p.column(1)).to_pylist()] == [t or "" for t in rows]
    encoder = packing.ByteBpe(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    path = public_tokenizers.path("piece_bpe_32k.model")
    counter = token_count._Counter(path, token_count.proven(path))
    for f in (encoder.encode, counter.texts, lambda x: ngram_join.shingle_sets(x, 5)):
        at_once = [x.tolist() for x in f(slices.texts_of(whole.column(1)))]
        assert [x.tolist() for p in parts for x in f(slices.texts_of(p.column(1)))] == at_once
