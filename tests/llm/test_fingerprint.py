"""Fingerprints against a plain version: sums over paragraphs, edited texts, the next document, and likeness."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.llm import fingerprint as fp

MASK = (1 << 32) - 1


def plain(text):
    """The lanes of a text."""
    lanes = [0] * fp.LANES
    for part in re.split(r"[\r\n]+", text or ""):
        if not part:
            continue
        sha = hashlib.sha256(part.encode()).hexdigest()
        for k in range(fp.EXACT):
            lanes[k] += int(sha[8 * k : 8 * k + 8], 16)
        words = re.split(r"[ \t]", part)
        for w, after in zip(words, [*words[1:], ""], strict=True):
            if not w:
                continue
            h = int(hashlib.md5((f"{w} {after}" if after else w).encode()).hexdigest()[:16], 16)
            g = h ^ ((h << 17 | h >> 47) & ((1 << 64) - 1))
            lanes[fp.EXACT] += 1
            at = fp.EXACT + 1
            for value in (h, g):
                for k in range(8):
                    for m in range(4):
                        for half in (0, 1):
                            lanes[at] += 1 if value >> (8 * (m + 4 * half) + k) & 1 else -1
                            at += 1
    return [v & MASK for v in lanes]


def near(a, b):
    signed = lambda v: [x - (1 << 32) if x >> 31 else x for x in v[fp.EXACT + 1 :]]
    x, y = signed(a), signed(b)
    squares = sum(p * p for p in x) + sum(p * p for p in y)
    return max(0.0, 2 * sum(p * q for p, q in zip(x, y, strict=True)) / squares) if squares else float(a == b)


def corpus(n=60, seed=2):
    rng = random.Random(seed)
    words = ["a", "the", "né", "日本", "word", "  ", "\t", "x\ty", "\n", "\r\n", "\n\n", "😀", "end."]
    return [None, "", "\n", " ", "one", "one\n", "two words", "long " * 400, "l\n" * 300, "same", "same"] + [" ".join(rng.choice(words) for _ in range(rng.randrange(60))) for _ in range(n)]


@pytest.mark.parametrize("seed, ids", [(1, "distinct"), (2, "equal"), (3, "null")])
def test_whole_table(spark, seed, ids):
    rng = random.Random(seed)
    rows = [({"distinct": 3 * i - 50, "equal": i % 5, "null": None if i % 3 else i}[ids], t, "clash") for i, t in enumerate(corpus(seed=seed))]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, range string").repartition(3)
    got = fp.compare_with_next(docs)
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    got = got.collect()
    assert len(got) == len(rows)
    low = -(1 << 63)
    tie = dict(spark.createDataFrame([(t or "",) for _, t, _ in rows], "t string").select("t", F.xxhash64("t")).collect())
    order = sorted(((low if i is None else i, tie[t or ""], i, t or "") for i, t, _ in rows), key=lambda r: r[:2], reverse=True)
    want = Counter()
    for (_, _, i, t), (_, _, _, after) in zip(order, order[1:] + order[:1], strict=True):
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        own, new, following = plain(t), plain(edited), plain(after)
        want[i, len(t), hashlib.sha256(edited.encode()).hexdigest(), tuple(own), tuple(new), round(near(own, new), 12), round(near(own, following), 12)] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, tuple(r.fingerprint), tuple(r.edited_fingerprint), round(r.near_edited, 12), round(r.near_next, 12)) for r in got) == want


def test_one_row_and_none(spark):
    one = fp.compare_with_next(spark.createDataFrame([(5, "abc def\nghi")], "doc_id long, text string")).collect()
    assert [(r.near_next, r.n_chars) for r in one] == [(1.0, 11)]
    assert fp.compare_with_next(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_homomorphic(spark):
    texts = {"ab": "a b\nc d", "ba": "c d\n\na b", "a": "a b", "c": "c d", "none": ""}
    rows = spark.createDataFrame(list(texts.items()), "name string, body string")
    prints = {r.name: r.fingerprint for r in fp.fingerprint(rows, ["name"], "body").collect()}
    assert prints["ab"] == prints["ba"] == plain(texts["ab"]) != prints["a"] and not any(prints["none"])
    pair = spark.createDataFrame([(prints["a"], prints["c"], prints["ab"])], "a array<long>, c array<long>, ab array<long>")
    r = pair.select(fp.added(F.col("a"), F.col("c")), fp.removed(F.col("ab"), F.col("c")), fp.parsed(fp.rendered(F.col("ab"))), fp.likeness(F.col("ab"), F.col("ab"))).first()
    assert (r[0], r[1], r[2], r[3]) == (prints["ab"], prints["a"], prints["ab"], 1.0)
    # Parts of one document are added up, wherever they are.
    parts = spark.createDataFrame([(1, 0, "a b"), (2, 0, "x"), (1, 1, "c d")], "doc long, part long, body string").repartition(3)
    whole = fp.together(fp.fingerprint(parts, ["doc", "part"], "body"), ["doc"])
    assert {r.doc: r.fingerprint for r in whole.collect()} == {1: prints["ab"], 2: plain("x")}
