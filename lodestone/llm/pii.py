"""Personal data: patterns, and a skip-chain conditional random field that carries their labels to similar tokens.

Four patterns give the base spans. The field then runs over the document's candidate units, runs of characters that look
like a number or an address: units next to each other are linked (the chain), and so are units anywhere in the document
that repeat or resemble each other (the skip edges: same digits at the end, same address, same name part). Base spans are
observed; loopy sum-product message passing spreads their labels over both kinds of edges until the messages settle, and a
unit whose posterior for one label is high enough becomes a span too: the posterior from which, on held-out labels, the share
``least`` of such units had the right one.

Weights are learnt from the documents themselves, by the pseudo-likelihood of the labels that the patterns give, on a bounded
sample of documents with candidates (``sample`` rows, chosen by a hash of the id). As no pattern labels what the field is to
find, base spans are written again into those texts in forms that the patterns miss (other separators, no +, a host without
its domain), beside other numbers of the same forms that are no personal data; see ``replanted``. Then each text is
labelled where it lies.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import fresh, small_batches, whole
from lodestone.llm.slices import slices

KINDS = ("email", "ip", "card", "phone")
_LOCAL = re.compile("[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Runs of digits are taken whole: a start inside one matches nothing that its beginning doesn't.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile("[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Units of the field: addresses, and runs of at least six digits with what stands between them.
_UNIT = re.compile(r"[^\s@,;<>\"]{1,200}@[^\s@,;<>\"]{1,200}|\+?\(?[0-9](?:[ ().-]{0,3}[0-9]){5,}")
#: Parts of a run of more digits than the longest number has.
_PART = re.compile(r"\+?\(?[0-9](?:[().-]{0,3}[0-9]){5,}")
_FEATURES = 64


def luhn(digits: str) -> bool:
    """The check sum of card numbers."""
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of what the patterns find, in the order of the contract."""
    found = []
    if "@" in text:
        done, at = 0, text.find("@")
        while at >= 0:
            start = at
            while start > done and _LOCAL.match(text[start - 1]):
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                found.append((start, m.end(), 0))
                done = m.end()
            at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append((*m.span(), 1))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((*m.span(), 2))
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((*m.span(), 3))
    return sorted(found, key=lambda s: (s[0], s[2]))


_DIGIT = re.compile("[0-9]")


def units(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int | None]]:
    """(start, end, label or None) in text order: base spans first, then candidates that touch none of them."""
    own: list[tuple[int, int, int | None]] = []
    end = 0
    for s, e, k in base:
        if s >= end:
            own.append((s, e, k + 1))
            end = e
    if "@" in text or _DIGIT.search(text):
        edges = [(s, e) for s, e, _ in base]
        k = 0
        for m in _UNIT.finditer(text):
            while k < len(edges) and edges[k][1] <= m.start():
                k += 1
            if not any(s < m.end() and e > m.start() for s, e in edges[k : k + 8]):
                own += [(a, b, None) for a, b in _parts(m)]
    return sorted(own, key=lambda u: u[:2])


def _parts(unit: re.Match) -> list[tuple[int, int]]:
    """A candidate, or, if it has more digits than any number of these kinds, its parts between white space."""
    if "@" in unit[0] or sum(c.isdigit() for c in unit[0]) <= 19:
        return [unit.span()]
    return [(unit.start() + m.start(), unit.start() + m.end()) for m in _PART.finditer(unit[0])]


def describe(text: str, start: int, end: int) -> list[int]:
    """Numbers of the features of a unit."""
    unit = text[start:end]
    digits = re.sub("[^0-9]", "", unit)
    before = re.search(r"(\w+)\W*$", text[max(0, start - 24) : start])
    shape = [0, 1 + min(20, len(digits))]
    tests = ("@" in unit, unit[:1] == "+", "(" in unit, " " in unit, "-" in unit, unit.count(".") == 3, "." in unit, len(digits) >= 12 and luhn(digits), unit.isdigit(), bool(before and before[1].isdigit()), start == 0 or text[start - 1].isspace(), end == len(text) or text[end].isspace(), end < len(text) and text[end] in ".,", bool(re.search(r"@\w+\.\w", unit)), before is None)
    shape += [22 + k for k, yes in enumerate(tests) if yes]
    if before:
        shape.append(40 + int(hashlib.md5(before[1].lower().encode("utf-8", "surrogatepass")).hexdigest(), 16) % 24)
    return shape


def keys(unit: str) -> set[str]:
    """What similar units share."""
    if "@" in unit:
        low = unit.lower().strip(".,:;()[]")
        return {f"@{low}", f"@{low.partition('@')[0]}"} if low.partition("@")[0] else {f"@{low}"}
    digits = re.sub("[^0-9]", "", unit)
    return {f"#{digits}", *([f"~{digits[-7:]}"] if len(digits) >= 7 else [])}


def edges(text: str, own: list[tuple]) -> list[tuple[int, int, int]]:
    """(unit, later unit, 0 for the chain or 1 for a skip edge). A unit is linked to the last one that shares a key."""
    found = {(i, i + 1, 0) for i in range(len(own) - 1)}
    last: dict[str, int] = {}
    for i, (s, e, _) in enumerate(own):
        for k in keys(text[s:e]):
            if k in last:
                found.add((last[k], i, 1))
            last[k] = i
    return sorted(found)


@dataclass
class Field:
    """Weights: label by feature, and label by label for chain and skip edges. Label 0 is no personal data."""

    node: np.ndarray
    pair: np.ndarray
    #: The posterior that a span needs, where held-out labels tell it.
    cut: float | None = None

    def posteriors(self, features: list[list[int]], links: list[tuple[int, int, int]], seen: list[int | None], rounds: int = 20) -> np.ndarray:
        """Beliefs of each unit by loopy sum-product; labels in ``seen`` are observed.

        After ``rounds`` rounds of all messages at once, what has not settled is swept in the order of the text and back, so
        labels cross a chain of any length; only loops that never settle are left after 100 sweeps.
        """
        n, labels = len(features), len(KINDS) + 1
        local = np.stack([self.node[:, f].sum(1) for f in features])
        for i, k in enumerate(seen):
            if k is not None:
                local[i] = -40.0
                local[i, k] = 0.0
        a, b, kind = (np.array(x, dtype=np.int64) for x in zip(*links, strict=True)) if links else (np.zeros(0, np.int64),) * 3
        source, target = np.concatenate([a, b]), np.concatenate([b, a])
        strength = np.concatenate([self.pair[kind], self.pair[kind].transpose(0, 2, 1)]) if links else np.zeros((0, labels, labels))
        back = (np.arange(len(source)) + len(a)) % max(1, len(source))
        sent = np.zeros((len(source), labels))
        for _ in range(rounds):
            belief = local.copy()
            np.add.at(belief, target, sent)
            out = (belief[source] - sent[back])[:, :, None] + strength
            top = out.max(1)
            new = top + np.log(np.exp(out - top[:, None, :]).sum(1))
            new -= new.max(1, keepdims=True)
            moved = np.abs(new - sent).max() if len(new) else 0
            sent = 0.5 * sent + 0.5 * new
            if moved < 1e-4:
                break
        else:
            self._sweep(local, source, target, strength, back, sent)
        belief = local.copy()
        np.add.at(belief, target, sent)
        p = np.exp(belief - belief.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


    @staticmethod
    def _sweep(local: np.ndarray, source: np.ndarray, target: np.ndarray, strength: np.ndarray, back: np.ndarray, sent: np.ndarray) -> None:
        """Update the messages ``sent`` one after the other, forwards by their sources and then backwards, until they settle."""
        belief = local.copy()
        np.add.at(belief, target, sent)
        half = len(source) // 2
        order = [*range(half), *(half + np.argsort(-source[half:], kind="stable")).tolist()]
        for sweep in range(100):
            step, moved = 1.0 if sweep < 10 else 0.5, 0.0
            for m in order:
                new = np.logaddexp.reduce((belief[source[m]] - sent[back[m]])[:, None] + strength[m], axis=0)
                change = step * (new - new.max() - sent[m])
                moved = max(moved, np.abs(change).max())
                sent[m] += change
                belief[target[m]] += change
            if moved < 1e-4:
                break


def replanted(text: str) -> tuple[str, dict[tuple[int, int], int]]:
    """A text with its base spans once more, in forms that the patterns miss, and with numbers of the same forms that are none.

    The second value has the label of each place that was added (0 for none). What is added follows from the text alone.
    """
    rng = random.Random(zlib.crc32(text.encode("utf-8", "surrogatepass")))
    words, made = [w for w in text.split() if not _DIGIT.search(w) and "@" not in w] or ["x"], []

    def grouped(digits: str, kind: int) -> str:
        mark = rng.choice(" .-" if kind == 3 else ".")
        if kind == 3:
            first, digits = digits[:-7], digits[-7:]
            first = f"({first[-3:]}) " if rng.random() < 0.3 else f"{first[-3:] if rng.random() < 0.7 else first}{mark}"
            return rng.choice((f"{first}{digits[:3]}{mark}{digits[3:]}", f"{first}{digits}"))
        return mark.join(digits[i : i + 4] for i in range(0, len(digits), 4))

    def other(form: str) -> str:
        return "".join(str(rng.randrange(10)) if c.isdigit() else rng.choice("abcdefgh") if c.isalpha() else c for c in form)

    for s, e, kind in base_spans(text)[:50]:
        span = text[s:e]
        digits = re.sub("[^0-9]", "", span)
        form = span.partition("@")[0] + "@" + span.partition("@")[2].partition(".")[0] if kind == 0 else span.replace(".", "-") if kind == 1 else grouped(digits, kind)
        made += [(form, kind + 1), (other(form), 0)]
    rng.shuffle(made)
    gold = {}
    for form, label in made:
        text += f" {rng.choice(words)} "
        gold[len(text), len(text) + len(form)] = label
        text += f"{form} {rng.choice(words)}"
    return text, gold


def fit(texts: list[str], epochs: int = 200, rate: float = 0.5, decay: tuple[float, float] = (1e-2, 1e-4)) -> Field:
    """Weights by the pseudo-likelihood of the labels of ``replanted`` texts; skip edges prefer equal labels from the start.

    ``decay`` is the penalty on weights of shapes and on weights of edges: few texts tell by shape what they happen to hold.
    """
    labels = len(KINDS) + 1
    rows, near, gold = [], [], []
    for text in texts:
        text, told = replanted(text)
        own = units(text, base_spans(text))
        # What resembles a labelled unit, and was not added, is what the field is to decide: it is not learnt from.
        shared = {x for s, e, k in own if k is not None for x in keys(text[s:e])}
        own = [(s, e, k) for s, e, k in own if k is not None or (s, e) in told or shared.isdisjoint(keys(text[s:e]))]
        y = [k or told.get((s, e), 0) for s, e, k in own]
        around = np.zeros((len(own), 2, labels))
        for i, j, kind in edges(text, own):
            around[i, kind, y[j]] += 1
            around[j, kind, y[i]] += 1
        rows += [describe(text, s, e) for s, e, _ in own]
        near += list(np.minimum(around, 3).reshape(len(own), -1))
        gold += y
    node, pair = np.zeros((labels, _FEATURES)), np.zeros((2, labels, labels))
    prior = np.stack([np.zeros((labels, labels)), 3.0 * np.eye(labels)])
    if rows:
        x = np.zeros((len(rows), _FEATURES))
        for r, f in enumerate(rows):
            x[r, f] = 1
        x = np.hstack([x, np.stack(near)])
        target = np.eye(labels)[gold]
        w = np.zeros((labels, x.shape[1]))
        fixed = x[:, _FEATURES:] @ np.concatenate([prior[0], prior[1]])
        speed = np.zeros_like(w) + 1e-8
        penalty = np.repeat(decay, [_FEATURES, x.shape[1] - _FEATURES])
        for _ in range(epochs):
            z = x @ w.T + fixed
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = (p - target).T @ x / len(x) + penalty * w
            speed += g * g
            w -= rate * g / np.sqrt(speed)
        node = w[:, :_FEATURES]
        pair = w[:, _FEATURES:].reshape(labels, 2, labels).transpose(1, 0, 2)
    pair = pair + prior
    return Field(node, (pair + pair.transpose(0, 2, 1)) / 2)


def calibrate(texts: list[str], least: float, cases: int = 20) -> float | None:
    """The lowest posterior, a half at least, from which the share ``least`` of held-out units has the right label.

    The field is fitted without every fifth text. In those, ``replanted``, the units that were added are to be told from the
    others, and from all that resembles no labelled unit. None where fewer than ``cases`` units of a kind were added.
    """
    field = fit([t for i, t in enumerate(texts) if i % 5])
    found, hidden = [], 0
    for text in texts[::5]:
        text, told = replanted(text)
        own = units(text, base_spans(text))
        links = edges(text, own)
        near = {i for a, b, kind in links if kind for i, j in ((a, b), (b, a)) if own[j][2] is not None}
        asked = [i for i, (s, e, k) in enumerate(own) if k is None and ((s, e) in told or i not in near)]
        if asked:
            p = field.posteriors([describe(text, s, e) for s, e, _ in own], links, [k for *_, k in own])
            found += [(p[i].max(), p[i].argmax() == told.get(own[i][:2], 0)) for i in asked if p[i].argmax() > 0]
            hidden += sum(told.get(own[i][:2], 0) > 0 for i in asked)
    if hidden < cases:
        return None
    found.sort(key=lambda x: -x[0])
    cut, right = np.inf, 0
    for n, (p, good) in enumerate(found, 1):
        right += bool(good)
        if p >= 0.5 and right >= least * n and (n == len(found) or found[n][0] < p):
            cut = p
    return float(cut)


def find(text: str, field: Field, least: float) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, spans that the field adds)."""
    base = base_spans(text)
    own = units(text, base)
    least = least if field.cut is None else field.cut
    if all(k is not None for *_, k in own):
        return base, []
    p = field.posteriors([describe(text, s, e) for s, e, _ in own], edges(text, own), [k for *_, k in own])
    return base, [(s, e, int(p[i].argmax()) - 1) for i, (s, e, k) in enumerate(own) if k is None and p[i].argmax() > 0 and p[i].max() >= least]


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], x[2])))


def train(docs: DataFrame, id_col: str, text_col: str, sample: int, least: float) -> Field:
    """Fit on at most ``sample`` documents with an @ or six digits in a row or nearly so, those whose ids have the least hashes."""
    may = docs.select(F.col(f"`{id_col}`").alias("id"), whole(text_col).alias("text")).where("id is not null").where(F.col("text").rlike("@|[0-9](?:[ ().-]{0,3}[0-9]){5}"))
    ids = may.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(sample)
    own = may.join(F.broadcast(ids), "id").groupBy("id").agg(F.min("text").alias("text"))

    def learn(batches):
        texts = [around(t) for rows in batches for t in rows.column(1).to_pylist()]
        field = fit(texts)
        yield pa.RecordBatch.from_arrays([*(pa.array([x.ravel().tolist()], pa.list_(pa.float64())) for x in (field.node, field.pair)), pa.array([calibrate(texts, least)], pa.float64())], names=["node", "pair", "cut"])

    row = own.repartition(1).sortWithinPartitions(F.xxhash64("id"), "id").mapInArrow(learn, "node array<double>, pair array<double>, cut double").collect()  # one row of a fixed size
    labels = len(KINDS) + 1
    return Field(np.array(row[0]["node"]).reshape(labels, _FEATURES), np.array(row[0]["pair"]).reshape(2, labels, labels), row[0]["cut"]) if row else fit([])


def around(text: str, reach: int = 40) -> str:
    """What stands near the units of a text: all that a fit needs of it."""
    parts: list[tuple[int, int]] = []
    for m in _UNIT.finditer(text):
        start, end = max(0, m.start() - reach), m.end() + reach
        # Parts that meet are one, so no unit is cut.
        parts.append((parts.pop()[0], end) if parts and start <= parts[-1][1] else (start, end))
    return "\n".join(text[s:e] for s, e in parts)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 5000, least: float = 0.95, columns: list[str] | None = None) -> DataFrame:
    """All rows of ``docs``, with all columns or those named, with counts of base spans and all spans.

    New columns: ``n_email``, ``n_ip``, ``n_card``, ``n_phone`` (long), ``base_sha256``, ``spans`` (kind:start:end, code points,
    joined by commas) and ``added`` (the number of spans that the field added).

    - A null text counts as empty: no spans. Very long texts are read whole, in linear time.
    - A null id is labelled but not learnt from; repeated rows are labelled alike.
    - ``least`` is a share of right labels on held-out units; where those are too few it is the posterior itself.
    - Candidates of the field are addresses of at most 200 characters on each side of the @, and runs of at least six digits; the
      24 characters before a candidate count for its features, and fits read 40 on each side. Base spans have no such bounds.
    - Without candidates anywhere the field has its first weights. An empty table gives an empty result.
    - Columns of ``docs`` named like a new one are replaced by it.
    """
    small_batches(docs.sparkSession)
    new = {**{f"n_{k}": T.LongType() for k in KINDS}, "base_sha256": T.StringType(), "spans": T.StringType(), "added": T.LongType()}
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, id_col, text_col, sample, least))
    text = fresh(docs, "whole_text")
    named = [c for c in (docs.columns if columns is None else columns) if c not in new]
    rows = docs.select(*[F.col(f"`{c}`") for c in named], whole(text_col).alias(text))
    n = len(named)
    schema = T.StructType([*rows.schema.fields[:n], *(T.StructField(k, v) for k, v in new.items())])

    def run(batches):
        for part in slices(batches, n):
            made = []
            for t in part.column(n).to_pylist():
                base, more = find(t, sent.value, least)
                counts = [sum(k == kind for _, _, k in base) for kind in range(len(KINDS))]
                made.append((*counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined([*base, *more]), len(more)))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([*part.columns[:n], *(pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True))], names=[f.name for f in schema.fields])

    return rows.mapInArrow(run, schema)
