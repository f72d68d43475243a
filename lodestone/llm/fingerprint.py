"""Document fingerprints: a homomorphic multiset hash, with DataFrame operations only.

A document is the multiset of its paragraphs. Every paragraph hashes to a wide vector, and the fingerprint is the sum of these
vectors modulo 2^32 in each lane. So it does not depend on the order of paragraphs, a paragraph is put in or taken out by adding
or subtracting its vector, and parts of a document can be summed anywhere and added up (see ``added``, ``removed``).

The vector of a paragraph has three runs of lanes:

- ``EXACT`` lanes, 32 bits each of a SHA-256: equal sums mean equal multisets of paragraphs, but for a chance of about 2^-256;
- one lane with the number of its units, which are its words, each with the word after the next space;
- ``SIGNS`` lanes, the sum over its units of a vector of +1 and -1 drawn from the unit's hash. The squared length of the
  difference of two such sums estimates in how many units two documents differ, so likeness comes from fingerprints alone.

A unit's hash is 64 bits and their sum with themselves turned by 17 places, which is 128 bits of which any two are independent.
Set bits are counted in bytes of longs over at most 127 units at a time, and these counts in halves of longs over a whole text: no
text has 2^31 units. So few sums are kept for each text while its units pass by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import whole

EXACT = 8
SIGNS = 128
LANES = EXACT + 1 + SIGNS
_MASK = (1 << 32) - 1
#: Ranges of documents for each shuffle partition: enough that few partitions get many more than others.
RANGES = 4

#: Units counted in bytes.
_RUN = 127
_TURN = 17


def _added_lanes(a: Column, b: Column, sign: int) -> Column:
    return F.zip_with(a, b, lambda x, y: (x + sign * y).bitwiseAND(F.lit(_MASK)))


def added(a: Column, b: Column) -> Column:
    """The fingerprint of two multisets of paragraphs together. Null where either is."""
    return _added_lanes(a, b, 1)


def removed(a: Column, b: Column) -> Column:
    """The fingerprint of the first multiset without the paragraphs of the second. Null where either is."""
    return _added_lanes(a, b, -1)


def rendered(lanes: Column) -> Column:
    """A fingerprint as text: eight hexadecimal digits a lane."""
    return F.array_join(F.transform(lanes, lambda v: F.lpad(F.lower(F.hex(v)), 8, "0")), "")


def parsed(text: Column) -> Column:
    """The lanes of a rendered fingerprint."""
    return F.transform(F.sequence(F.lit(0), F.lit(LANES - 1)), lambda k: F.conv(F.substr(text, k * 8 + 1, F.lit(8)), 16, 10).cast("long"))


def likeness(a: Column, b: Column) -> Column:
    """How alike two multisets are by their fingerprints, from 0 to 1: twice their common units' share, estimated from the signed lanes.

    Equal fingerprints give 1. Two documents without words have 1 if equal, else 0. Null where either is null.
    """
    signs = lambda c: F.transform(F.slice(c, EXACT + 2, SIGNS), lambda v: F.when(v >= 1 << 31, v - (1 << 32)).otherwise(v).cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    x, y = signs(a), signs(b)
    squares = dot(x, x) + dot(y, y)
    return F.when(squares > 0, F.greatest(F.lit(0.0), 2 * dot(x, y) / squares)).otherwise((a == b).cast("double"))


def fingerprint(rows: DataFrame, keys: list[str], text: str, name: str = "fingerprint") -> DataFrame:
    """(keys, fingerprint as an array of longs) for the text of each row; the ``keys`` tell rows apart.

    Paragraphs are what stands between line ends; blank ones count as none. Null and empty texts have no paragraphs and the
    fingerprint of zeros. Where rows are already dealt by some of the keys, nothing moves; otherwise what moves is a row for
    each text or ``_RUN`` words of it.
    """
    by = [f"key{i}" for i in range(len(keys))]
    given = rows.select(*[F.col(f"`{k}`").alias(b) for k, b in zip(keys, by, strict=True)], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    digests = r"transform(filter(split(text, '[\r\n]+'), p -> p <> ''), p -> sha2(p, 256))"
    # What stands between spaces, with a line end as a word of its own: no unit goes over it.
    words = r"split(replace(replace(replace(text, '\t', ' '), '\r', '\n'), '\n', ' \n '), ' ')"
    texts = given.select(*by, F.expr(digests).alias("digests"), F.expr(words).alias("word"))
    lane = "aggregate(digests, 0L, (s, d) -> s + cast(conv(substring(d, {at}, 8), 16, 10) as bigint))"
    exact = F.array(*[F.expr(lane.format(at=8 * k + 1)) for k in range(EXACT)]).alias("exact")
    pairs = texts.select(*by, exact, "word", F.expr("slice(word, 2, size(word))").alias("following"))
    units = pairs.select(*by, "exact", F.posexplode(F.arrays_zip("word", "following")).alias("at", "u")).select(*by, "exact", "at", "u.word", "u.following")
    word = lambda c: F.when(~F.col(c).isin("", "\n"), F.col(c))
    digest = F.md5(F.concat_ws(" ", word("word"), word("following")).cast("binary"))
    hashed = units.select(*by, "exact", F.expr(f"at div {_RUN}").alias("run"), F.when(word("word").isNotNull(), F.conv(F.substring(digest, 1, 16), 16, -10).cast("long")).alias("h"))
    turned = F.shiftleft("h", _TURN).bitwiseOR(F.shiftrightunsigned("h", 64 - _TURN))
    in_bytes = F.lit(0x0101010101010101)
    runs = hashed.withColumn("g", turned.bitwiseXOR(F.col("h"))).groupBy(*by, "exact", "run").agg(F.count("h").alias("units"), *[F.sum(F.shiftright(c, k).bitwiseAND(in_bytes)).alias(f"{c}{k}") for c in "hg" for k in range(8)])
    in_halves = F.lit(0x000000FF000000FF)
    counted = [(f"{c}{k}", m) for c in "hg" for k in range(8) for m in range(4)]
    halves = [F.coalesce(F.sum(F.shiftright(c, 8 * m).bitwiseAND(in_halves)), F.lit(0)).alias(f"{c}_{m}") for c, m in counted]
    found = runs.groupBy(*by, "exact").agg(F.sum("units").alias("units"), *halves)
    ones = [half for c, m in counted for half in (F.col(f"{c}_{m}").bitwiseAND(F.lit(_MASK)), F.shiftright(f"{c}_{m}", 32))]
    wide = F.concat("exact", F.array("units", *[2 * c - F.col("units") for c in ones]))
    return found.select(*[F.col(b).alias(k) for k, b in zip(keys, by, strict=True)], F.transform(wide, lambda v: v.bitwiseAND(F.lit(_MASK))).alias(name))


def together(prints: DataFrame, keys: list[str], name: str = "fingerprint") -> DataFrame:
    """(keys, fingerprint): the sum of all fingerprints with the same keys, such as those of the parts of one document."""
    lanes = prints.select(*keys, F.posexplode(name).alias("lane", "value")).groupBy(*keys, "lane").agg(F.sum("value").bitwiseAND(F.lit(_MASK)).alias("value"))
    in_order = F.array_sort(F.collect_list(F.struct("lane", "value")))
    return lanes.groupBy(*keys).agg(F.transform(in_order, lambda x: x["value"]).alias(name))


def _boundaries(keys: DataFrame, ranges: int) -> list[tuple[int, int]]:
    """The greatest (id, tie) of each of about ``ranges`` equal ranges of the rows, in order; the last is the greatest of all."""
    dealt = keys.repartitionByRange(ranges, "id", "tie").groupBy(F.spark_partition_id().alias("range"))
    return sorted({tuple(r["top"]) for r in dealt.agg(F.max(F.struct("id", "tie")).alias("top")).collect()})


def _place(tops: list[tuple[int, int]]) -> tuple[Column, Column]:
    """The range of a row (how many of the sorted pairs are less than its (id, tie), by halving), and whether it ends its range."""
    ids, ties = (f"array({', '.join(f'cast({t[k]} as bigint)' for t in tops)})" for k in (0, 1))
    steps = ", ".join(str(1 << k) for k in reversed(range(len(tops).bit_length())))
    at = "get({}, at + step - 1)"
    less = f"{at.format(ids)} < id or ({at.format(ids)} = id and {at.format(ties)} < tie)"
    place = f"aggregate(array({steps}), 0, (at, step) -> if(at + step <= {len(tops)} and ({less}), at + step, at))"
    return F.expr(place), F.expr(f"get({ids}, range) = id and get({ties}, range) = tie")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """The named columns of all rows (the id alone by default) with ``text``, ``next_text``, ``range``, ``turn`` and ``copy``.

    The next document is that with the next smaller id; after the smallest comes the greatest. Rows are dealt once, by ranges
    of their ids, and are numbered by ``turn`` in each. The greatest row of a range is dealt to the range above as well, where it
    is the document after the last: this second one has ``copy`` and no next text. What reaches the driver is a key for each range.
    A null text counts as the empty text, and a null id as the smallest long. Rows of one id are ordered by a hash of their texts, so
    an id may have any share of the rows; rows of the same id and text follow each other.
    """
    named = [id_col] if columns is None else columns
    given = [F.col(f"`{c}`").alias(f"given{i}") for i, c in enumerate(named)]
    keyed = docs.select(*given, whole(text_col).alias("text"), F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(1 << 63)).cast("long")).alias("id"))
    keyed = keyed.withColumn("tie", F.xxhash64("text"))
    ranges = RANGES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tops = _boundaries(keyed.select("id", "tie"), ranges) or [(0, 0)]
    place, last = _place(tops)
    here = F.struct(F.col("range"), F.lit(False).alias("copy"))
    above = F.struct(((F.col("range") + 1) % len(tops)).alias("range"), F.lit(True).alias("copy"))
    dealt = keyed.withColumn("range", place).withColumn("at", F.explode(F.when(last, F.array(here, above)).otherwise(F.array(here))))
    order = Window.partitionBy("range").orderBy("copy", F.desc("id"), F.desc("tie"))
    seen = dealt.select(*[f"given{i}" for i in range(len(named))], "text", "id", "tie", "at.range", "at.copy").withColumns({"turn": F.row_number().over(order), "next_text": F.lead("text").over(order)})
    return seen.select(*[F.col(f"given{i}").alias(c) for i, c in enumerate(named)], "text", F.when(~F.col("copy"), F.col("next_text")).alias("next_text"), "range", "turn", "copy")


def edited(text: str, next_text: str) -> Column:
    """A text whose last third (its code points div 3) is replaced by the first as many of another, or all of it."""
    return F.expr(f"concat(left(`{text}`, char_length(`{text}`) - char_length(`{text}`) div 3), left(`{next_text}`, char_length(`{text}`) div 3))")


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id of every row with the fingerprints of its text and of its edited text, and how near the edited and the next text are.

    The edited text's fingerprint is that of the lines that stay with that of the new lines added, as the text's is with that of its
    own last lines. Columns: ``id_col``, ``n_chars`` (code points), ``edited_sha256``, ``fingerprint`` and ``edited_fingerprint`` (lanes),
    ``near_edited`` and ``near_next``. Texts move once, as in ``with_next``; all else happens where they were dealt.

    - A null text counts as the empty text, a null id as the smallest long.
    - Repeated rows each get a row, and each is the next document of the one before it.
    - A single row is its own next document. An empty table gives an empty result.
    - Very long texts are read whole; the words of a paragraph are an array in one task.
    - Other columns of ``docs`` are not read.
    """
    n, cut = "char_length(text)", "char_length(text) div 3"
    rows = with_next(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias("given"), "range", "turn", "copy", F.expr(n).cast("long").alias("n_chars"), "text", "next_text", F.expr(f"left(text, {n} - {cut})").alias("left"))
    # The last line of what stays goes on in either text; what is before it is hashed once.
    rows = rows.withColumn("rest", F.substring_index("left", "\n", -1)).withColumn("head", F.expr("left(left, char_length(left) - char_length(rest))"))
    tail, new = F.expr(f"concat(rest, right(text, {cut}))"), F.expr(f"concat(rest, left(next_text, {cut}))")
    piece = lambda k, c: F.struct(F.lit(k).alias("piece"), c.alias("text"))
    pieces = F.when(F.col("copy"), F.array(piece(0, F.col("text")), piece(1, F.lit("")))).otherwise(F.array(piece(0, F.col("head")), piece(1, tail), piece(2, new)))
    keys = ["range", "turn", "copy", "given", "n_chars", "sha", "piece"]
    sha = F.sha2(edited("text", "next_text").cast("binary"), 256).alias("sha")
    prints = fingerprint(rows.select(*keys[:5], sha, F.explode(pieces).alias("p")).select(*keys[:6], "p.piece", "p.text"), keys, "text", "lanes")
    # The pieces of a document follow each other, and those of the next document follow them.
    order = Window.partitionBy("range").orderBy("turn", "piece")
    after = {c: F.lead("lanes", k).over(order) for k, c in enumerate(("tail", "new", "next_head", "next_tail"), 1)}
    firsts = prints.withColumns(after).where("not copy and piece = 0")
    made = {"fingerprint": added(F.col("lanes"), F.col("tail")), "edited_fingerprint": added(F.col("lanes"), F.col("new")), "next": added(F.col("next_head"), F.col("next_tail"))}
    own = firsts.withColumns(made)
    near = {f"near_{k}": likeness(F.col("fingerprint"), F.col(c)) for k, c in (("edited", "edited_fingerprint"), ("next", "next"))}
    return own.withColumns(near).select(F.col("given").alias(id_col), "n_chars", F.col("sha").alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def _oracle() -> str:
    """SQL for DuckDB that gives the rows of ``op13_fingerprints``."""
    exact = ", ".join(f"coalesce(sum(('0x' || substr(d, {8 * k + 1}, 8))::BIGINT), 0) AS e{k}" for k in range(EXACT))
    bit = lambda j: f"(w{1 - j // 32} >> {j % 32})"
    places = [8 * (m + 4 * half) + k for k in range(8) for m in range(4) for half in (0, 1)]
    drawn = [f"{bit(j)} & 1" for j in places] + [f"xor({bit(j)}, {bit((j - _TURN) % 64)}) & 1" for j in places]
    ones = ", ".join(f"count(*) FILTER (({x}) = 1) AS s{i}" for i, x in enumerate(drawn))
    lanes = ", ".join([*[f"coalesce(e{k}, 0) & {_MASK}" for k in range(EXACT)], "coalesce(units, 0)", *[f"coalesce(2 * s{k} - units, 0) & {_MASK}" for k in range(SIGNS)]])
    words = ", ".join(f"('0x' || substr(m, {8 * k + 1}, 8))::BIGINT AS w{k}" for k in range(2))
    dot = "list_sum(list_transform(range({}, {}), lambda k: (CASE WHEN {}[k] >= 2147483648 THEN {}[k] - 4294967296 ELSE {}[k] END)::DOUBLE * (CASE WHEN {}[k] >= 2147483648 THEN {}[k] - 4294967296 ELSE {}[k] END)))"
    of = lambda x, y: dot.format(EXACT + 2, LANES + 1, x, x, x, y, y, y)
    near = lambda x, y: f"CASE WHEN {of(x, x)} + {of(y, y)} > 0 THEN greatest(0.0, 2 * {of(x, y)} / ({of(x, x)} + {of(y, y)})) ELSE ({x} = {y})::INT::DOUBLE END"
    text = lambda x: f"array_to_string(list_transform({x}, lambda v: format('{{:08x}}', v)), '')"
    return f"""
        WITH a AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER (ORDER BY doc_id DESC) AS r, count(*) OVER () AS n FROM documents),
        b AS (SELECT x.doc_id, x.r, x.t, length(x.t) AS n_chars, y.t AS next, y.r AS next_r FROM a x JOIN a y ON y.r = x.r % x.n + 1),
        v AS (SELECT r, 0 AS version, t FROM b UNION ALL
          SELECT r, 1, left(t, n_chars - n_chars // 3) || left(next, n_chars // 3) FROM b),
        p AS (SELECT r, version, row_number() OVER () AS p, p AS part FROM (
          SELECT r, version, unnest(list_filter(regexp_split_to_array(t, '[\\r\\n]+'), lambda x: x <> '')) AS p FROM v)),
        e AS (SELECT r, version, {exact} FROM (SELECT r, version, sha256(part) AS d FROM p) GROUP BY r, version),
        u AS (SELECT r, version, md5(concat_ws(' ', z[1], CASE WHEN z[2] NOT IN ('', '\n') THEN z[2] END)) AS m FROM (
          SELECT r, version, unnest(list_zip(ws, ws[2:])) AS z FROM (
            SELECT r, version, string_split(replace(replace(replace(t, '\t', ' '), '\r', '\n'), '\n', ' \n '), ' ') AS ws FROM v))
          WHERE z[1] NOT IN ('', '\n')),
        s AS (SELECT r, version, count(*) AS units, {ones} FROM (SELECT r, version, {words} FROM u) GROUP BY r, version),
        l AS (SELECT v.r, v.version, [{lanes}] AS lanes, sha256(v.t) AS sha FROM v LEFT JOIN e USING (r, version) LEFT JOIN s USING (r, version))
        SELECT b.doc_id, b.n_chars, y.sha AS edited_sha256, {text('x.lanes')} AS fingerprint, {text('y.lanes')} AS edited_fingerprint,
          {near('x.lanes', 'y.lanes')} AS near_edited, {near('x.lanes', 'z.lanes')} AS near_next
        FROM b JOIN l x ON x.r = b.r AND x.version = 0 JOIN l y ON y.r = b.r AND y.version = 1 JOIN l z ON z.r = b.next_r AND z.version = 0
    """


ORACLE = _oracle()
