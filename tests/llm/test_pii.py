"""Base spans against the plain patterns, message passing against enumeration, and the spans that the field adds."""

import hashlib
import itertools
import random
import re

import numpy as np

from lodestone.llm import pii

PLAIN = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain(text):
    out = []
    for k, p in enumerate(PLAIN):
        for m in p.finditer(text):
            d = re.sub("[^0-9]", "", m[0])
            if (k == 0) or (k == 1 and all(int(x) <= 255 for x in m[0].split("."))) or (k == 2 and 12 <= len(d) <= 19 and pii.luhn(d)) or (k == 3 and 9 <= len(d) <= 15):
                out.append((*m.span(), k))
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_base_spans():
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice(["a", "b_", "@", ".", "-", " ", "+", "1", "22", "255", "256", "4111 1111 1111 1111", "x@y.z", "(", ")", "é", "00", "10.0.0.1", "+1 (70"]) for _ in range(rng.randrange(14)))
        assert pii.base_spans(text) == plain(text), text
    for text in ("a" * 50_000 + "@" + "b" * 50_000, "1" * 100_000, "1." * 50_000, "+1 " * 30_000, "@" * 50_000, "a@" * 30_000):
        pii.find(text, pii.fit([]), 0.95)


def test_messages_give_exact_marginals_on_trees():
    rng = np.random.default_rng(3)
    labels = len(pii.KINDS) + 1
    for n in (1, 2, 4):
        field = pii.Field(rng.normal(size=(labels, pii._FEATURES)), rng.normal(size=(2, labels, labels)))
        features = [[k, 10 + k] for k in range(n)]
        links = [(i, i + 1, i % 2) for i in range(n - 1)]
        seen = [None] * (n - 1) + [2]
        want = np.zeros((n, labels))
        for y in itertools.product(range(labels), repeat=n):
            if y[-1] == 2:
                score = sum(field.node[k, f].sum() for k, f in zip(y[:-1], features[:-1], strict=True)) + sum(field.pair[k][y[i], y[j]] for i, j, k in links)
                for i, k in enumerate(y):
                    want[i, k] += np.exp(score)
        got = field.posteriors(features, links, seen, rounds=100)
        assert np.allclose(got, want / want.sum(1, keepdims=True), atol=1e-3)


def test_table(spark):
    texts = [
        "Call +1 (706) 555-3138 now. Later call 706 555 3138 again.", "mail a.b@c.example.com, card 4644348398010899 at 10.0.0.1 x", None, "", "no data here", "order 12345678 and 99 bottles", "z " * 20_000 + "q@r.st",
    ] * 6
    rows = [(i if i % 9 else None, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string").repartition(3)
    got = pii.find_personal_data(docs, least=0.8).collect()
    assert len(got) == len(rows)
    for r in got:
        base = plain(r.text or "")
        names = [f"{pii.KINDS[k]}:{s}:{e}" for s, e, k in base]
        assert r.base_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for *_, k in base) for x in range(4)]
        spans = r.spans.split(",") if r.spans else []
        assert set(names) <= set(spans) and len(spans) == len(names) + r.added
        if not base:
            assert not spans
    assert any(r.added for r in got if r.text and r.text.startswith("Call"))
    assert pii.find_personal_data(docs.limit(0)).count() == 0
    quiet = spark.createDataFrame([(1, "nothing")], "doc_id long, text string")
    assert [r.spans for r in pii.find_personal_data(quiet).collect()] == [""]


def test_labels_cross_long_chains():
    labels, weight = len(pii.KINDS) + 1, 10.0
    field = pii.Field(np.zeros((labels, pii._FEATURES)), np.stack([np.zeros((labels, labels)), weight * np.eye(labels)]))
    for n in (10, 60, 400):
        got = field.posteriors([[0]] * n, [(i, i + 1, 1) for i in range(n - 1)], [4] + [None] * (n - 1))
        fade = (np.exp(weight) - 1) / (np.exp(weight) + labels - 1)
        assert np.allclose(got[:, 4], 1 / labels + (1 - 1 / labels) * fade ** np.arange(n), atol=1e-3)


def test_spans_are_added_at_the_usual_threshold(spark):
    known = [f"555-{1000 + i} or write to a{i}@b.example.com" for i in range(150)]
    texts = [f"Call +1 (706) {t} now, or +1 706 {t} today. Order {7654321 + 13 * i} of {20240000 + i} came." for i, t in enumerate(known)]
    texts += [f"Call +1 (706) 555-{3000 + i} now. Later call 706 555 {3000 + i} again. Order {31415926 + 7 * i} came." for i in range(30)]
    rows = pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        number = f"706 555 {2850 + r.doc_id}"
        at = r.text.find(number)
        assert r.added == (at >= 0) and (at < 0 or f"phone:{at}:{at + len(number)}" in r.spans.split(",")), (r.text, r.spans)


def test_other_forms_are_found_and_other_numbers_left_alone():
    """Fitted on some documents; in others, forms that no pattern has are found beside numbers of the same forms."""
    rng = random.Random(8)
    number = lambda form: re.sub("d", lambda _: str(rng.randrange(10)), form)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(80)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [f"{some(20)} {number('+1 (ddd) 555-dddd')} {some(9)} {some(5)}{i}@mail{i % 9}.example.com {some(4)} {number('dd.1dd.dd.7')} {some(5)} {number('dddddddd')} {some(3)}" for i in range(260)]
    field = pii.fit(texts[:200])
    field.cut = pii.calibrate(texts[:200], 0.95)
    assert field.cut is not None
    right = missed = wrong = 0
    for t in texts[200:]:
        s, e, _ = next(x for x in pii.base_spans(t) if x[2] == 3)
        d = re.sub("[^0-9]", "", t[s:e])[-10:]
        form = rng.choice((f"{d[:3]} {d[3:6]} {d[6:]}", f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}"))
        other = number(re.sub("[0-9]", "d", form))
        text = f"{t} {some(3)} {other} {some(4)} {form} {some(2)}"
        at = text.rindex(form)
        got = pii.find(text, field, 0.95)[1]
        right += (at, at + len(form), 3) in got
        missed += (at, at + len(form), 3) not in got
        wrong += len([g for g in got if g != (at, at + len(form), 3)])
    assert right >= 0.85 * (right + missed) and wrong <= 0.05 * right, (right, missed, wrong)


def test_runs_of_several_numbers_are_taken_apart():
    text = "a 7536784127813050 4845168114407329 b"
    assert [text[s:e] for s, e, _ in pii.units(text, pii.base_spans(text))] == ["7536784127813050", "4845168114407329"]
