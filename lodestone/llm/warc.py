"""Web archive records: resolving "not modified" revisits.

A revisit record stands for a page that the server called unchanged; its content is in an earlier record. Each revisit is
joined as of its time to the latest earlier full response of the same canonical URL, the validators of both are checked, and
the headers that a "not modified" answer may renew are merged into those of the response.

The as-of join is one pass over records dealt by ranges of (URL, time): each task carries the last response forward, and
what the tasks' first URLs need from earlier tasks is found from one summary row for each task. A URL may hold any share of
the records, as ranges also split by time. Payloads are not moved.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import materialise

#: Headers that describe the stored body or one connection: never renewed by a revisit.
KEPT = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade")
#: Parameters that name a visitor's way here, not a page.
TRACKING = "^(utm_[^=]*|ref|fbclid|gclid)(=.*)?$"
_PARTS = "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::([0-9]*))?([^?#]*)(?:[?]([^#]*))?"


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www.``, port unless usual, path without last slash, sorted parameters without tracking; other texts as they are."""
    host, port, path, query = (F.regexp_extract(url, _PARTS, k) for k in range(1, 5))
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    made = F.concat(
        F.regexp_replace(F.lower(host), "^www[.]", ""),
        F.when(port.isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), port)),
        F.regexp_replace(path, "/+$", ""),
        F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""),
    )
    return F.when(url.rlike(_PARTS), made).otherwise(url)


_NARROW = "url string, id {kind}, full boolean, own string, answer string, task long, pending boolean"


def as_of(records: DataFrame) -> DataFrame:
    """(id, own, answer) for each revisit of ``records`` (url, ts, id, full, own): ``own`` of the latest earlier full record of its URL."""
    kind = records.schema["id"].dataType.simpleString()

    def carry(batches):
        task, first, url, last = TaskContext.get().partitionId(), None, None, None
        for rows in batches:
            out = []
            for u, i, full, own in zip(*(rows.column(k).to_pylist() for k in range(4)), strict=True):
                if first is None:
                    first = u
                if u != url:
                    url, last = u, None
                if full:
                    last = own
                else:
                    out.append((u, i, False, own, last, task, last is None and u == first))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types(rows), strict=True)], names=names)
        if first is not None:
            ends = [(first, None, True, None, None, 2 * task, False), (url, None, True, None, last, 2 * task + 1, False)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*ends, strict=True), types(rows), strict=True)], names=names)

    def types(rows):
        return [pa.string(), rows.schema.field(1).type, pa.bool_(), pa.string(), pa.string(), pa.int64(), pa.bool_()]

    names = ["url", "id", "full", "own", "answer", "task", "pending"]
    order = [F.col("url"), F.col("ts"), F.col("full"), F.col("id")]
    dealt = records.repartitionByRange(*order).sortWithinPartitions(*order).select("url", "id", "full", "own")
    found = materialise(dealt.mapInArrow(carry, _NARROW.format(kind=kind)), "visits")
    # Two rows for each task: what its first URL asks for, and what its last URL hands on.
    so_far = Window.partitionBy("url").orderBy("task").rowsBetween(Window.unboundedPreceding, 0)
    ends = found.where("full").select("url", "task", F.last("answer", ignorenulls=True).over(so_far).alias("answer"))
    asked = ends.where("task % 2 = 0").select((F.col("task") / 2).cast("long").alias("task"), F.col("answer").alias("handed"))
    visits = found.where("not full")
    here = visits.where("not pending").select("id", "url", "own", "answer")
    return here.unionByName(visits.where("pending").join(asked, "task", "left").select("id", "url", "own", F.col("handed").alias("answer")))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """(record_id, canonical_url, ts, response_id, response_ts, status, headers) for each revisit of ``records``.

    ``records`` has record_id, url, ts (long), kind ("response" or "revisit"), etag, last_modified, digest (strings) and
    headers (map of strings). ``status`` is "resolved", "no earlier response", "validator mismatch" or "no validator"; only
    resolved revisits have headers: those of the response, renewed by the revisit's except ``KEPT``.

    - Earlier means a smaller ``ts``; of responses of one time the largest record_id counts. Validators: the entity tags
      where both sides have one (weak ones compare by value), else the times of modification, else the digests.
    - Records with a null URL match nothing; a null time of a response is before all others, that of a revisit has no
      earlier response. Records of other kinds are left out.
    - Repeated revisits each have a row. Null headers are empty. An empty table gives an empty result.
    - URLs without a scheme and host, empty ones among them, are one URL if they are equal after the same rewriting. URLs and headers of any
      length are kept whole. Other columns are not read, whatever their names.
    """
    wanted = records.where(F.col("kind").isin("response", "revisit")).select(
        F.col("record_id").alias("id"), canonical_url(F.col("url")).alias("url"), F.coalesce("ts", F.lit(-(1 << 62))).alias("ts"), F.col("ts").alias("given"), (F.col("kind") == "response").alias("full"),
        "etag", "last_modified", "digest", F.transform_keys(F.coalesce("headers", F.create_map().cast("map<string,string>")), lambda k, _: F.lower(k)).alias("headers"),
    )
    shape = f"id {records.schema['record_id'].dataType.simpleString()}, given long, etag string, last_modified string, digest string, headers map<string,string>"
    sent = wanted.select("url", "ts", "id", "full", F.to_json(F.struct("id", "given", "etag", "last_modified", "digest", "headers")).alias("own"))
    joined = as_of(sent.where("url is not null")).unionByName(sent.where("url is null and not full").select("id", "url", "own", F.lit(None).cast("string").alias("answer")))
    both = joined.select("url", F.from_json("own", shape).alias("v"), F.from_json("answer", shape).alias("r"))
    tag = lambda c: F.regexp_replace(c, "^W/", "")
    same = F.coalesce(tag(F.col("v.etag")) == tag(F.col("r.etag")), F.col("v.last_modified") == F.col("r.last_modified"), F.col("v.digest") == F.col("r.digest"))
    status = F.when(F.col("r").isNull(), "no earlier response").when(same.isNull(), "no validator").when(~same, "validator mismatch").otherwise("resolved")
    renewed = F.map_filter("v.headers", lambda k, _: ~k.isin(*KEPT))
    rest = F.map_filter("r.headers", lambda k, _: ~F.map_contains_key(F.col("v.headers"), k) | k.isin(*KEPT))
    ok = F.col("status") == "resolved"
    return both.withColumn("status", status).select(
        F.col("v.id").alias("record_id"), F.col("url").alias("canonical_url"), F.col("v.given").alias("ts"),
        F.when(ok, F.col("r.id")).alias("response_id"), F.when(ok, F.col("r.given")).alias("response_ts"), "status",
        F.when(ok, F.map_concat(rest, renewed)).alias("headers"),
    )


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Captures that follow from ``pages``: a response for each page, revisits before and after it, some of a changed page."""
    digest = F.md5(F.coalesce("html", F.lit("")))
    page = F.col("page_id")
    capture = lambda n, shift, kind, etag, headers: F.struct(
        (page * 4 + n).alias("record_id"), (page * 1000 + shift).alias("ts"), F.lit(kind).alias("kind"), etag.alias("etag"), headers.alias("headers")
    )
    text = lambda x: F.lit(x) if isinstance(x, str) else x.cast("string")
    headers = lambda **h: F.create_map(*[y for k, v in h.items() for y in (F.lit(k.replace("_", "-")), text(v))])
    known = F.when(page % 5 != 0, digest)
    return pages.select("url", F.when(page % 3 != 0, (page % 7).cast("string")).alias("last_modified"), digest.alias("digest"), F.explode(F.array(
        capture(0, 0, "response", known, headers(Content_Type="text/html", Content_Length=F.length(F.coalesce("html", F.lit(""))), Cache_Control="max-age=60", Date=page)),
        capture(1, 5000, "revisit", known, headers(cache_control="no-cache", content_length="0", Date=page + 5000)),
        capture(2, -3000, "revisit", F.lit(None).cast("string"), headers(Date=page - 3000)),
        capture(3, 9000, "revisit", F.concat(F.lit("W/"), F.when(page % 2 == 0, known).otherwise("changed")), headers(Expires="0")),
    )).alias("c")).select("url", "last_modified", "digest", "c.*")


ORACLE = r"""
    WITH p AS (
      SELECT page_id, url, md5(coalesce(html, '')) AS digest, length(coalesce(html, '')) AS n,
        CASE WHEN page_id % 3 <> 0 THEN CAST(page_id % 7 AS VARCHAR) END AS lm, CASE WHEN page_id % 5 <> 0 THEN md5(coalesce(html, '')) END AS known FROM pages
    ), q AS (
      SELECT *, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::([0-9]*))?([^?#]*)(?:[?]([^#]*))?' AS e FROM p
    ), k AS (
      SELECT *, list_sort(list_filter(string_split(regexp_extract(url, e, 4), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid)(=.*)?$'))) AS kept FROM q
    ), c AS (
      SELECT page_id, digest, n, lm, known, regexp_replace(lower(regexp_extract(url, e, 1)), '^www[.]', '')
        || CASE WHEN regexp_extract(url, e, 2) IN ('', '80', '443') THEN '' ELSE ':' || regexp_extract(url, e, 2) END
        || regexp_replace(regexp_extract(url, e, 3), '/+$', '') || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS u
      FROM k
    ), v AS (
      SELECT page_id * 4 + 1 AS record_id, u, page_id * 1000 + 5000 AS ts, known AS etag, lm, digest, page_id + 5000 AS d, 1 AS form FROM c UNION ALL
      SELECT page_id * 4 + 2, u, page_id * 1000 - 3000, NULL, lm, digest, page_id - 3000, 2 FROM c UNION ALL
      SELECT page_id * 4 + 3, u, page_id * 1000 + 9000, CASE WHEN page_id % 2 = 0 THEN known ELSE 'changed' END, lm, digest, NULL, 3 FROM c
    ), j AS (
      SELECT v.*, r.page_id AS rp, r.n AS rn, r.known AS retag, r.lm AS rlm, r.digest AS rdigest
      FROM v LEFT JOIN c r ON v.u = r.u AND r.page_id * 1000 < v.ts
      QUALIFY row_number() OVER (PARTITION BY v.record_id ORDER BY r.page_id DESC NULLS LAST) = 1
    ), s AS (
      SELECT *, CASE WHEN rp IS NULL THEN 'no earlier response' WHEN coalesce(etag = retag, lm = rlm, digest = rdigest) IS NULL THEN 'no validator'
        WHEN NOT coalesce(etag = retag, lm = rlm, digest = rdigest) THEN 'validator mismatch' ELSE 'resolved' END AS status FROM j
    )
    SELECT record_id, u AS canonical_url, ts, CASE WHEN status = 'resolved' THEN rp * 4 END AS response_id, CASE WHEN status = 'resolved' THEN rp * 1000 END AS response_ts, status,
      CASE WHEN status <> 'resolved' THEN NULL ELSE
        CASE form WHEN 1 THEN 'cache-control=no-cache' ELSE 'cache-control=max-age=60' END || ';content-length=' || CAST(rn AS VARCHAR) || ';content-type=text/html;date='
        || CAST(coalesce(d, rp) AS VARCHAR) || CASE form WHEN 3 THEN ';expires=0' ELSE '' END END AS headers
    FROM s
"""
