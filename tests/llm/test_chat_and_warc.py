"""Perspectives and revisits against plain versions, with odd rows."""

import random
import re
from collections import defaultdict

import pytest

from lodestone.llm import chat, warc


def plain_rotation(rows, part_turns):
    by = defaultdict(list)
    for c, t, r, x in rows:
        name = re.sub("[\r\n]+", " ", r or "").replace("<|", "< |").replace("|>", "| >").strip()
        by[c].append((t if t is not None else -1, name or "unknown", (x or "").replace("<|", "< |")))
    out = {}
    for c, turns in by.items():
        turns.sort()
        speakers = {r for _, r, _ in turns if r != "system"}
        step = part_turns or len(turns)
        for k in range(0, len(turns), step):
            for s in speakers:
                text, mask = "", []
                for _, r, x in turns[k : k + step]:
                    text += "<|system|>\n" if r == "system" else "<|assistant|>\n" if r == s else f"<|user name={r}|>\n"
                    if r == s:
                        mask.append((len(text), len(text) + len(x) + 7))
                    text += x + "<|end|>\n"
                out[c, k // step, s] = (len(turns[k : k + step]), text, mask)
    return out


@pytest.mark.parametrize("part_turns", [3, 64, None])
def test_rotation(spark, part_turns):
    rng = random.Random(part_turns or 0)
    rows = [(rng.randrange(6), rng.randrange(9), rng.choice(["ann", "bob", "cy", "system", None, "  "]), rng.choice(["hi", "", None, "é😀 <|end|> x", "long " * 50])) for _ in range(120)]
    rows += [(None, 0, "ann", "lost"), (None, 1, "bob", "too"), (7, 0, "system", "alone"), (8, None, "ann", "no number"), (8, None, "ann", "no number"), (9, 1, "<|x", "odd name"), (9, 2, "a|>\nFAKE", "forged")]
    rows += [(10, k, rng.choice(["ann", "bob", "system"]), "turn " * (5000 if k == 70 else 3)) for k in range(200)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, rank string, part int").repartition(4)
    got = {(r.conv, r.part, r.speaker): (r.n_turns, r.rendered, [(m.start, m.end) for m in r["mask"]]) for r in chat.rotate(df, part_turns=part_turns).collect()}
    want = plain_rotation(rows, part_turns)
    assert {k: (v[0], v[2]) for k, v in got.items()} == {k: (v[0], v[2]) for k, v in want.items()}
    assert got == want
    for _, text, mask in got.values():
        assert all(text[b - 7 : b] == "<|end|>" for _, b in mask)
    assert chat.rotate(df.limit(0)).count() == 0


def record(i, url, ts, kind, etag=None, lm=None, digest=None, headers=None):
    return (i, url, ts, kind, etag, lm, digest, headers)


SCHEMA = "record_id long, url string, ts long, kind string, etag string, last_modified string, digest string, headers map<string,string>"


def test_revisits(spark):
    rows = [
        record(1, "http://www.A.example/p/?b=2&a=1&utm_source=x#f", 10, "response", "e1", headers={"Content-Type": "text/html", "Date": "d1", "Age": "5"}),
        record(2, "https://a.example/p?a=1&b=2", 20, "revisit", "W/e1", headers={"date": "d2", "Content-Type": "x", "Expires": "never"}),
        record(3, "http://a.example:80/p?a=1&b=2", 5, "revisit", "e1"),
        record(4, "http://a.example/p?a=1&b=2", 10, "revisit", "e1"),
        record(5, "http://a.example/p?a=1&b=2", 30, "revisit", "e2"),
        record(6, "http://a.example/p?a=1&b=2", 25, "response", "e2", headers=None),
        record(7, "http://a.example/p?a=1&b=2", 25, "response", "e3"),
        record(8, "http://b.example/", 1, "response", lm="m"),
        record(9, "http://b.example", 2, "revisit", "e", lm="m"),
        record(10, "http://b.example", 3, "revisit"),
        record(11, None, 4, "revisit", "e"),
        record(12, "not a url", 4, "revisit", "e"),
        record(13, "http://b.example", None, "revisit", lm="m"),
        record(14, "http://b.example", 9, "other", lm="m"),
        record(2, "https://a.example/p?a=1&b=2", 20, "revisit", "W/e1", headers={"date": "d2", "Content-Type": "x", "Expires": "never"}),
    ]
    got = warc.resolve_revisits(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    by = {r.record_id: r for r in got}
    assert len(got) == 10 and sum(r.record_id == 2 for r in got) == 2
    assert by[2].response_id == 1 and by[2].response_ts == 10
    assert by[2].headers == {"content-type": "text/html", "date": "d2", "age": "5", "expires": "never"}
    assert {k: by[k].status for k in (3, 4, 5, 9, 10, 11, 12, 13)} == {3: "no earlier response", 4: "no earlier response", 5: "validator mismatch", 9: "resolved", 10: "no validator", 11: "no earlier response", 12: "no earlier response", 13: "no earlier response"}
    assert by[2].canonical_url == "a.example/p?a=1&b=2" and by[9].canonical_url == "b.example"
    assert warc.resolve_revisits(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_url_over_many_tasks(spark):
    rng = random.Random(6)
    rows = [record(i, rng.choice(["http://x.example/"] * 4 + ["http://y.example/"]), rng.randrange(400), rng.choice(["response", "revisit", "revisit"]), digest="d") for i in range(900)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        got = {r.record_id: r.response_id for r in warc.resolve_revisits(spark.createDataFrame(rows, SCHEMA)).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[0])
        spark.conf.set("spark.sql.shuffle.partitions", before[1])
    for i, url, ts, kind, *_ in rows:
        if kind == "revisit":
            earlier = [(t, j) for j, u, t, k, *_ in rows if k == "response" and u == url and t < ts]
            assert got[i] == (max(earlier)[1] if earlier else None)


def test_odd_urls_and_columns(spark):
    long = "http://c.example/" + "p" * 50_000
    rows = [
        record(1, "", 1, "response", "e"), record(2, "", 2, "revisit", "e"), record(3, long, 1, "response", "e", headers={"X": "v" * 50_000}), record(4, long + "#f", 2, "revisit", "e"), record(5, long + "q", 3, "revisit", "e"),
    ]
    df = spark.createDataFrame([(*r, "x", True, "y", 7) for r in rows], SCHEMA + ", id string, full boolean, own string, answer long")
    got = {r.record_id: r for r in warc.resolve_revisits(df).collect()}
    assert {k: (r.status, r.response_id) for k, r in got.items()} == {2: ("resolved", 1), 4: ("resolved", 3), 5: ("no earlier response", None)}
    assert len(got[4].headers["x"]) == 50_000 and len(got[5].canonical_url) > 50_000
