"""Packing, decontamination, exact dedup and token counts against plain versions of themselves."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from lodestone.llm import decontaminate, exact_dedup, packing, token_count

ODD = [None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a   b", "a \n b", "x\n\n  y", "tab\t here", "<|endoftext|>", "a <|endoftext|> b", "x<|endoftext|>  y", "</s> <s> <unk>", "▁a ▁▁b", "don't we'll", "né à l’été", "日本語 テキスト", " x   y", "　 a", "12 345 6.7", "!!! ??? ...", "A" * 3000, "z " * 5000, "😀 😀😀", "a\x1c b\x1c \x1cc", "same", "same", "é å"]


def texts(n=200, seed=1):
    rng = random.Random(seed)
    bits = ["the", "and ", " of", "x", "\n", " ", "  ", "é", "9", "1234", ".", "!", "ß", "\t", "Thing", "'s", "_", "日", " ", "▁", "word"]
    return ODD + ["".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randrange(60))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "clash") for i, t in enumerate(texts())] + [(None, "no id", None, None), (7, "a  b", "en", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, rep string")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def test_byte_bpe_equals_the_library():
    from tokenizers import Tokenizer

    all_texts = [t or "" for t in texts(1500, 3)]
    encoder = packing.ByteBpe(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = encoder.encode(pa.array(all_texts, pa.large_string()))
    want = library.encode_batch(all_texts, add_special_tokens=False)
    assert [g.tolist() for g in got] == [w.ids for w in want]


def check_packing(rows, capacity):
    for bin_rows in rows.values():
        at = 0
        for length, offset in sorted(bin_rows, key=lambda r: r[1]):
            assert offset == at
            at += length
        assert at <= capacity


def test_pack(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack(docs.repartition(3), capacity=128).collect()
    by_bin = defaultdict(list)
    for r in got:
        by_bin[r.sequence_id].append((r.length, r.offset))
    check_packing(by_bin, 128)
    want = Counter()
    for r in docs.collect():
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        start = 0
        for k, n in enumerate(packing.cut(len(ids), 128)):
            want[r.doc_id, k, start, n, zlib.crc32(ids[start : start + n].tobytes())] += 1
            start += n
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert len(by_bin) <= 1.1 * sum(r.length for r in got) / 128 + 1
    assert packing.pack(empty(spark)).count() == 0
    with_ids = packing.pack(docs, capacity=128, keep_ids=True).collect()
    assert all(zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32 for r in with_ids)


@pytest.mark.parametrize("seed", range(30))
def test_plan_places_every_turn_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([9, 30, 100])
    counts = {n: rng.randrange(40) for n in rng.sample(range(1, capacity + 1), rng.randrange(1, capacity))}
    rows = packing.plan(counts, capacity).tolist()
    bins, seen = defaultdict(list), Counter()
    for length, a, b, seq, each, off in rows:
        for t in range(a, b):
            bins[seq + (t - a) // each].append((length, off + (t - a) % each * length))
            seen[length, t] += 1
    assert set(seen.values()) <= {1} and len(seen) == sum(counts.values())
    check_packing(bins, capacity)
    assert all(sum(3 * n > capacity for n, _ in b) <= 2 for b in bins.values())
    # First-fit decreasing needs about as many.
    free = []
    for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        k = next((i for i, f in enumerate(free) if f >= n), None)
        free.append(capacity - n) if k is None else free.__setitem__(k, free[k] - n)
    assert len(bins) <= len(free) * 1.02 + 1


def test_token_counts(spark, docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = token_count.count_tokens(docs, limit=50).collect()
    assert len(got) == docs.count() and got[0].lang == "en"
    for r in got:
        t = r.text or ""
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), len(sp.encode(t)), len(sp.encode(t)) > 50), repr(t)
    assert token_count.count_tokens(empty(spark)).count() == 0


def test_exact_dedup(spark, docs):
    got = exact_dedup.mark_duplicates(docs).collect()
    narrow = exact_dedup.mark_duplicates(docs, columns=["doc_id"])
    digest = lambda r: (r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256)
    assert narrow.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert Counter(map(digest, narrow.collect())) == Counter(map(digest, got))
    by_text = defaultdict(list)
    for r in docs.collect():
        by_text[r.text or ""].append(-1 if r.doc_id is None else r.doc_id)
    assert len(got) == docs.count()
    for r in got:
        own = by_text[r.text or ""]
        assert (r.keep_id, r.group_size) == ((max(own) if max(own) >= 0 else None), len(own))
        assert r.text_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert Counter(r.text or "" for r in got if r.kept) == Counter(by_text.keys())
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns and kept.count() == len(by_text)
    assert exact_dedup.mark_duplicates(empty(spark)).count() == 0
    twice = spark.createDataFrame([(1, "t"), (1, "t"), (None, "u"), (None, "u")], "doc_id long, text string")
    marked = exact_dedup.mark_duplicates(twice, filter_bytes=0).collect()
    assert sorted((r.text, r.kept) for r in marked) == [("t", False), ("t", True), ("u", False), ("u", True)]


def plain_contamination(text, items, size):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(decontaminate.WORD, low)
    hit, own = set(), set()
    for item, t in items:
        w = re.findall(decontaminate.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        for win in {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else ():
            for i in range(len(words) - len(win) + 1):
                if tuple(words[i : i + len(win)]) == win:
                    hit.update(range(i, i + len(win)))
                    if item is not None:
                        own.add(item)
    names = ",".join(sorted(map(str, own)))
    return len(words), len(hit), len(own), hashlib.sha256(names.encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block", [1, 500_000])
def test_contamination(spark, docs, block):
    items = [(0, "the word"), (1, "A"), (2, None), (3, ""), (4, "?!"), (10, "word 9 Thing the x"), (None, "1234"), (5, "été l"), (6, "the word"), (7, "z z z")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_contamination(docs, bench, size=3, block_windows=block).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == plain_contamination(r.text, items, 3), repr(r.text)
        assert sum(len(re.findall("[0-9A-Za-z\x80-\U0010ffff]+", r.text[s.start : s.end])) for s in r.hit_spans) == r.n_hit
    clean = decontaminate.decontaminate(docs, bench, size=3)
    assert clean.columns == docs.columns and clean.count() == sum(not r.contaminated for r in got)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_contamination(docs, none).where("contaminated").count() == 0
    assert decontaminate.find_contamination(empty(spark), bench).count() == 0


def test_columns_named_like_new_ones_are_replaced(spark):
    docs = spark.createDataFrame([(1, "a b c", "old", "old", 3, "kept")], "doc_id long, text string, n_tokens string, n_hit string, whole_text int, other string")
    items = spark.createDataFrame([(7, "a b c")], "item_id long, text string")
    counted = token_count.count_tokens(docs)
    assert sorted(counted.columns) == sorted(["doc_id", "text", "n_hit", "whole_text", "other", "n_bytes", "n_tokens", "over_limit"])
    assert counted.first().n_tokens > 0 and counted.first().whole_text == 3
    found = decontaminate.find_contamination(docs, items)
    assert sorted(found.columns) == sorted(["doc_id", "text", "n_tokens", "whole_text", "other", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_spans"])
    assert (found.first().n_hit, found.first().n_tokens, found.first().other) == (3, "old", "kept")


def test_benchmark_in_several_blocks(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(14)))) for i in range(40)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(30)) + " " + rng.choice(items)[1]) for i in range(60)]
    docs, benchmark = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one, many = (sorted(tuple(r) for r in decontaminate.find_contamination(docs, benchmark, size=4, block_windows=n).collect()) for n in (10**6, 60))
    assert one == many and any(r[-2] for r in one)


@pytest.mark.parametrize("separator", ["\n", "\t,", "?", " "])
def test_windows_of_items_without_spaces_are_counted(spark, separator):
    words = [f"W{i}é" for i in range(500)]
    items = [(1, separator.join(words)), (2, "one two"), (3, "?!"), (4, None)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    get, n = decontaminate._blocks(benchmark.select("item_id", "text").toDF("item", "text"), 10, 100)
    blocks = [get(k) for k in range(n)]
    held = [[len(decontaminate.windows(t, 10)) for _, t in b] for b in blocks]
    assert n == 5 and sum(map(sum, held)) == 492 and max(map(max, filter(None, held))) <= 100
    assert {w for b in blocks for _, t in b for w in decontaminate.windows(t, 10)} == {w for _, t in items for w in decontaminate.windows(t or "", 10)}
    docs = spark.createDataFrame([(k, " ".join(words[k : k + 30])) for k in range(0, 480, 7)], "doc_id long, text string")
    one, many = (sorted(tuple(r) for r in decontaminate.find_contamination(docs, benchmark, block_windows=m).collect()) for m in (10**6, 100))
    assert one == many and all(r[-2] for r in one)
