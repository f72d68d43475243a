"""The fill-in-the-middle transformation against a plain version, and its round trip."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import fill_middle

ODD = ["", "a", "é", "<P>", "x<S>y", "<M", "<", "S>", "<S", "a<", "<P", "M>", "日本語", "😀😀", "line\nline", "<P<S<M", "z" * 9000 + "é" * 3000, "<Q>", "ab", "<p>"]


def plain(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    p, q = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    pre, mid, suf = text[:p], text[p:q], text[q:]
    if h4 % 100 < 20:
        return n, "spm", p, q - p, f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", p, q - p, f"<P>{pre}<S>{suf}<M>{mid}"


def corpus(n=400, seed=5):
    rng = random.Random(seed)
    bits = ["a", "é", "日", "😀", "<", "P", "S", ">", "M", " ", "\n", "word "]
    texts = [*ODD, None] + ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(n)]
    return [(rng.randrange(10**6) if i % 50 else None, t, "clash", i) for i, t in enumerate(texts)]


def test_whole_table(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string, draw1 int").repartition(3)
    made = fill_middle.fill_in_middle(docs)
    assert sorted(made.columns) == sorted(["doc_id", "text", "draw1", "n", "form", "prefix_chars", "middle_chars", "output"])
    got = fill_middle.restore(made).collect()
    assert len(got) == len(rows) and {r.form for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain(r.doc_id, r.text)
        assert r.restored == (r.text or "")
    none = spark.createDataFrame([], "doc_id long, text string")
    assert fill_middle.restore(fill_middle.fill_in_middle(none)).count() == 0


@pytest.mark.parametrize("span", [1, 7, 1 << 20])
def test_spans_of_any_size(span, monkeypatch):
    monkeypatch.setattr(fill_middle, "SPAN", span)
    monkeypatch.setattr(fill_middle, "BLOCK", max(1, span // 2))
    rng = random.Random(span)
    rows = [(i, t or "") for i, (_, t, _, _) in enumerate(corpus(60, span)) if len(t or "") < 500]
    rng.shuffle(rows)
    hs = [[int(hashlib.sha256(f"1:{i}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for i, _ in rows] for k in range(4)]
    texts = pa.array([t for _, t in rows], pa.large_string())
    n, form, _, _, out = fill_middle.scatter(texts, [np.array(h) for h in hs])
    assert out.to_pylist() == [plain(i, t)[-1] for i, t in rows]
    assert fill_middle.gather(out.cast(pa.large_string()), form).to_pylist() == texts.to_pylist()


def test_a_damaged_output_is_an_error():
    with pytest.raises(ValueError):
        fill_middle.gather(pa.array(["<P>a<S>b"], pa.large_string()), np.array([fill_middle.PSM]))


def test_very_long_text(spark):
    text = "wörd " * 2_000_000
    docs = spark.createDataFrame([(4, text), (5, "a")], "doc_id long, text string")
    got = {r.doc_id: r for r in fill_middle.restore(fill_middle.fill_in_middle(docs)).collect()}
    assert got[4].output == plain(4, text)[-1] and got[4].restored == text and got[5].restored == "a"
