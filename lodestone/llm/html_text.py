"""Main text of web pages: the maximum-scoring contiguous run of tokens.

A page is a sequence of tags and words. Words of a main text score positive, tags negative; the weights come from labelled
pages, those that mark their main text with a single ``article`` or ``main`` element: how often words of a context (the
container they stand in, the block, whether inside a link) and tags lie inside it or outside. One linear scan finds the
contiguous run with the greatest sum. What the run holds of menus, notices, comments and the like is left out, and the rest
is joined block by block. Such containers are known by their element, or by a class, id or role of which every part is a
word of the list below (``cookie-notice``, but not ``with-sidebar``); one that encloses an article, or all that a page has,
is a wrapper and not left out.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import fresh, small_batches, whole
from lodestone.llm.slices import slices

#: Elements whose content is no text of the page, with what ends each.
_RAW = {n: re.compile(rf"</{n}\s*+>", re.I) for n in "script style noscript template iframe svg textarea title select button object canvas video audio".split()}
_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)", re.S)
#: Attributes as far as the end of the tag or the quote that opens a value; a quote elsewhere is a character like others.
_STEP = re.compile("(?:[^>=]++|=\\s*+[^\\s\"'>][^\\s>]*+)*+(?:=\\s*+)?+([>\"'])")
_BLOCKS = frozenset("p div h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th section article main header footer nav aside blockquote pre figure figcaption hr form fieldset legend address details summary body html head center dialog menu hgroup search option".split())
_CONTAINERS = frozenset("head body div section article main header footer nav aside form fieldset table ul ol dl figure dialog menu details address".split())
_INNER = frozenset("p h1 h2 h3 h4 h5 h6 li td th pre blockquote dt dd figcaption summary".split())
#: Containers that never hold main text.
_NEVER = frozenset("head header footer nav aside form fieldset dialog menu".split())
#: Words of class, id or role names that mark containers without main text.
_MARKS = frozenset("ad ads adv advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer form header login masthead menu modal nav navbar navigation newsletter notice popup promo related reply replies share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
#: Words that may stand beside one of those in a name.
_BESIDE = frozenset("area bar block body bottom box container content global inner item items left link links list main page panel primary right section site text title top widget wrap wrapper".split())
_ATTRIBUTE = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile("[a-z]+|[0-9]+")
#: What a word, and a tag, of an unseen context score.
WORD, BAD_WORD, TAG = 1.0, -1.0, -0.05


def _names(attributes: str) -> tuple[str, ...]:
    """Words of the class, id and role of a tag."""
    found = _ATTRIBUTE.findall(attributes) if "=" in attributes else ()
    return tuple(w for groups in found for w in _WORD.findall("".join(groups).lower()) if w.isalpha())


def _marked(attributes: str) -> bool:
    """Whether a class, id or role names a container without main text: all parts of one name are words of the lists."""
    for groups in _ATTRIBUTE.findall(attributes) if "=" in attributes else ():
        for name in "".join(groups).lower().split():
            parts = [w for w in _WORD.findall(name) if w.isalpha()]
            if not _MARKS.isdisjoint(parts) and all(w in _MARKS or w in _BESIDE for w in parts):
                return True
    return False


class _Marked:
    """Containers of a page that are marked as boilerplate, as a forest: what each lies in, where it starts and ends."""

    def __init__(self):
        self.inside, self.start, self.end, self.wraps = [], [], [], []

    def open(self, inside: int, at: int) -> int:
        for column, value in ((self.inside, inside), (self.start, at), (self.end, None), (self.wraps, False)):
            column.append(value)
        return len(self.inside) - 1

    def wrap(self, k: int) -> None:
        """An article opens in container ``k``: neither it nor what it lies in is boilerplate."""
        while k >= 0 and not self.wraps[k]:
            self.wraps[k] = True
            k = self.inside[k]

    def dropped(self) -> list[bool]:
        """For each container, and for none (the last), whether it is left out."""
        out = []
        for k, inside in enumerate(self.inside):
            out.append(not self.wraps[k] or (inside >= 0 and out[inside]))
        return [*out, False]


def _tag_end(page: str, at: int, dead: set[int]) -> int:
    """Where the tag whose attributes start at ``at`` ends: after the first > outside quoted values, or else after the first >.

    ``dead`` has the opening quotes from which the page is known to end inside a tag, so each is followed once at most.
    """
    opened, here = [], at
    while m := _STEP.match(page, here):
        if m[1] == ">":
            return m.end()
        quote = m.end() - 1
        close = -1 if quote in dead else page.find(m[1], quote + 1)
        opened.append(quote)
        if close < 0:
            break
        here = close + 1
    dead.update(opened)
    return page.find(">", at) + 1 or len(page)


def tokens(page: str, marked: _Marked | None = None):
    """(is a word run, feature, text or tag, innermost container in ``marked`` or -1, in a labelled element) in page order."""
    marked = _Marked() if marked is None else marked
    stack: list[tuple[str, str, int, bool]] = [("", "", -1, False)]
    opened: Counter = Counter()  # containers in the stack by name, so that an end without a start looks for none
    inner, links, at, n_tokens = "", 0, 0, 0

    def words(raw):
        name, label, never, main = stack[-1]
        return True, f"{label}|{inner}|{'a' if links else ''}", html.unescape(raw), never, main

    end = page.rfind(">") + 1  # what opens after it has no end
    if unended := re.search("<[a-zA-Z/!?]", page[end:]):
        page = page[: end + unended.start()]
    dead: set[int] = set()
    while m := _TOKEN.search(page, at):
        if m.start() > at:
            n_tokens += 1
            yield words(page[at : m.start()])
        at = m.end()
        close, name = m[1], m[2]
        if not name:
            continue
        name = name.lower()
        at = _tag_end(page, at, dead)
        if name in _RAW and not close:
            if name != "svg" or page[at - 2] != "/":  # no other of these can close itself
                at = end.end() if (end := _RAW[name].search(page, at)) else len(page)
            continue
        attributes = page[m.end() : at - 1]
        if name == "a":
            links = 0 if close else 1
        if close and name in _CONTAINERS:
            k = next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == name) if opened[name] else 0
            main = stack[k][3] if k else False
            label = stack[k][1]
            if k:
                for gone, _, never, _main in stack[k:]:
                    opened[gone] -= 1
                    if never >= 0 and marked.end[never] is None and never != stack[k - 1][2]:
                        marked.end[never] = n_tokens
                del stack[k:]
            inner, links = "", 0
        elif not close and name in _CONTAINERS:
            marks = _names(attributes)
            label = ".".join((name, *marks[:3])) if name in ("div", "section") or not stack[-1][1] or name in _NEVER or name in ("article", "main") else stack[-1][1]
            never, own = stack[-1][2], name in _NEVER or (name != "body" and _marked(attributes))
            if own:
                never = marked.open(never, n_tokens)
            elif name in ("article", "main"):
                marked.wrap(never)
            main = stack[-1][3] or name in ("article", "main")
            stack.append((name, label, never, main))
            opened[name] += 1
            inner, links = "", 0
        else:
            label, main = stack[-1][1], stack[-1][3]
            if name in _INNER:
                inner = "" if close else name
        n_tokens += 1
        yield False, f"{label}|{'/' if close else ''}{name}", name, stack[-1][2], main
    if at < len(page):
        yield words(page[at:])


def labelled(page: str) -> bool:
    """Whether the page marks its main text: one ``article`` element, or else one ``main`` element."""
    low = page.lower()
    return len(re.findall("<article[\\s>]", low)) == 1 or ("<article" not in low and len(re.findall("<main[\\s>]", low)) == 1)


def observe(pages, seen: Counter) -> None:
    """Count words and tags of labelled pages by feature, inside and outside of the marked element."""
    for page in pages:
        if labelled(page):
            for is_text, feature, text, _, main in tokens(page):
                n = len(text.split()) if is_text else 1
                if n:
                    seen[is_text, feature, main] += n


def weights(seen: Counter) -> dict[tuple[bool, str], float]:
    """Weights of all features: log-odds of lying inside, held to positive words, negative words and small costs of tags."""
    total = {main: sum(n for (_, _, m), n in seen.items() if m == main) + 1 for main in (True, False)}
    by = Counter()
    for (is_text, feature, _), n in seen.items():
        by[is_text, feature] += n
    found = {}
    for is_text, feature in by:
        odds = math.log((seen[is_text, feature, True] + 0.5) / total[True]) - math.log((seen[is_text, feature, False] + 0.5) / total[False])
        found[is_text, feature] = (max(BAD_WORD * 2, min(WORD, odds)) if abs(odds) > 0.1 else 0.1) if is_text else max(-1.0, min(TAG, odds))
    return found


def _best_run(scores: list[float]) -> tuple[int, int]:
    """The contiguous run with the greatest sum, as [start, end); empty if no score is positive."""
    best, start, end, total, first = 0.0, 0, 0, 0.0, 0
    for k, s in enumerate(scores):
        if total <= 0:
            total, first = 0.0, k
        total += s
        if total > best:
            best, start, end = total, first, k + 1
    return start, end


def extract(page: str, known: dict[tuple[bool, str], float]) -> str:
    """The main text of a page: blocks joined by line ends; empty if no words score positive."""
    marked = _Marked()
    sequence = [(is_text, feature, text, never) for is_text, feature, text, never, _ in tokens(page, marked)]

    def scored(dropped: list[bool]) -> tuple[int, int]:
        scores = []
        for is_text, feature, text, never in sequence:
            if is_text:
                weight = known.get((True, feature), BAD_WORD if dropped[never] or feature.endswith("|a") else WORD)
                # White space alone belongs to whatever run it stands in.
                scores.append(len(text.split()) * (min(weight, BAD_WORD) if dropped[never] else weight))
            else:
                scores.append(known.get((False, feature), TAG))
        return _best_run(scores)

    dropped = marked.dropped()
    start, end = scored(dropped)
    if start == end and any(dropped):
        # Nothing is left: what encloses the best run by the weights alone is a wrapper.
        start, end = scored([False] * len(dropped))
        for k in range(len(marked.start)):
            if start < end and marked.start[k] <= start and end <= (len(sequence) if marked.end[k] is None else marked.end[k]):
                marked.wraps[k] = True
        dropped = marked.dropped()
        start, end = scored(dropped)
    blocks, block = [], []
    for is_text, _, text, never in sequence[start:end]:
        if is_text:
            if not dropped[never]:
                block.append(text)
        elif text in _BLOCKS:
            blocks.append("".join(block))
            block = []
        elif text == "br":
            block.append(" ")
    blocks.append("".join(block))
    return "\n".join(b for b in (" ".join(b.split()) for b in blocks) if b)


def is_labelled(html: F.Column) -> F.Column:
    """``labelled`` as a column."""
    low = F.lower(html)
    return (F.regexp_count(low, F.lit(r"<article[\s>]")) == 1) | (~F.contains(low, F.lit("<article")) & (F.regexp_count(low, F.lit(r"<main[\s>]")) == 1))


def learn(pages: DataFrame, key_col: str, html_col: str, sample: int) -> dict[tuple[bool, str], float]:
    """Weights from at most ``sample`` labelled pages, those whose keys have the least hashes. All contexts of these pages count."""
    named = pages.select(F.col(f"`{key_col}`").alias("k"), whole(html_col).alias("html"))
    chosen = named.where(F.col("k").isNotNull() & is_labelled(F.col("html"))).select("k").distinct().orderBy(F.xxhash64("k"), "k").limit(sample)
    own = named.join(F.broadcast(chosen), "k").groupBy("k").agg(F.min("html").alias("html"))

    def run(batches):
        seen: Counter = Counter()
        for rows in batches:
            observe(rows.column(0).to_pylist(), seen)
        rows = list(seen.items())
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in rows], pa.bool_()), pa.array([k[1] for k, _ in rows], pa.string()), pa.array([k[2] for k, _ in rows], pa.bool_()), pa.array([n for _, n in rows], pa.int64())], names=["is_text", "feature", "main", "n"])

    counted = own.select("html").mapInArrow(run, "is_text boolean, feature string, main boolean, n long").groupBy("is_text", "feature", "main").agg(F.sum("n").alias("n"))
    return weights(Counter({(r.is_text, r.feature, r.main): r.n for r in counted.orderBy("feature", "is_text", "main").collect()}))  # the contexts of ``sample`` pages


def extract_text(pages: DataFrame, key_col: str = "page_id", html_col: str = "html", sample: int = 2000, columns: list[str] | None = None) -> DataFrame:
    """All rows of ``pages``, with all columns or those named, with ``text`` and ``n_chars`` (its code points).

    Weights are learnt when this is called, from at most ``sample`` labelled pages; contexts that these don't have get the weights
    of unseen ones. White space inside a block becomes one space, blocks are joined by one line end; ``br`` is white space inside a block.

    - A null or empty page, and one without main text, has the empty text.
    - Pages that are repeated, or have no key, are extracted alike; of equal keys one page at most is learnt from.
    - Without labelled pages the weights of unseen contexts hold. Very long pages are read whole, in linear time.
    - An empty table gives an empty result. Columns of ``pages`` named like a new one are replaced by it.
    """
    small_batches(pages.sparkSession)
    sent = pages.sparkSession.sparkContext.broadcast(learn(pages, key_col, html_col, sample))  # the contexts of ``sample`` pages
    page = fresh(pages, "whole_html")
    named = [c for c in (pages.columns if columns is None else columns) if c not in ("text", "n_chars")]
    rows = pages.select(*[F.col(f"`{c}`") for c in named], whole(html_col).alias(page))
    n = len(named)

    def run(batches):
        for part in slices(batches, n):
            texts = [extract(p, sent.value) for p in part.column(n).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[f.name for f in schema.fields])

    schema = T.StructType([*rows.schema.fields[:n], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return rows.mapInArrow(run, schema)
