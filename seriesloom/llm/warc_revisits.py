"""Resolution of not-modified revisits in web captures.

A revisit record says that a page had not changed. It is resolved by an as-of join on the canonical URL:
the latest full response before it, by (time, record id). Its validators must agree: the entity tag by
weak comparison if the revisit has one, else the date of last modification. The headers of the response
are then updated by those of the revisit that a not-modified answer may change.

The as-of join is a window per URL and time slice, whose carry-in is the last response of the earlier
slices: one aggregate row per URL and slice. Slices are the quantiles of all capture times, so a URL
with a third of all records is spread over ``SLICES`` tasks. Only records are moved, payloads are not.

Defined cases: revisits without URL, time or id, without an earlier response, without a validator or with
another one are returned unresolved with the reason; responses without URL, time or id serve nobody;
equal times are ordered by record id; repeated rows each count; NULL headers are no headers; of header
names that differ in case only, the last counts; an empty table gives an empty result; extra columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICES = 256

# Parameters that do not tell pages apart, headers that a not-modified answer may not change.
TRACKING = r"^(utm_[^=]*|gclid|fbclid|ref)(=|$)"
NOT_PERMITTED = (
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive",
    "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade",
)
PARTS = r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def canonical_url(url: Column) -> Column:
    """Host in lower case without www. and default port, path without final slash, sorted parameters
    without tracking ones; scheme and fragment do not count."""
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(url, PARTS, 1)), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(url, PARTS, 2), r"/+$", "")
    wanted = F.filter(F.split(F.regexp_extract(url, PARTS, 3), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    query = F.array_join(F.array_sort(wanted), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def lower_names(headers: Column) -> Column:
    """A header map with names in lower case; of equal names the last counts."""
    pairs = F.transform(
        F.coalesce(F.map_entries(headers), F.array()), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))
    )
    last = F.filter(
        pairs, lambda e, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda later: later["key"] == e["key"])
    )
    return F.map_from_entries(last)


def _tag(headers: Column) -> Column:
    return F.regexp_replace(headers["etag"], "^W/", "")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per revisit of records (record_id, url, ts, kind, headers): its canonical URL, response_id, reason
    ('resolved' or why not) and the merged headers (those of the revisit where it is not resolved).

    ``kind`` is 'response' or 'revisit'; other kinds are left aside.
    """
    rows = records.filter(F.col("kind").isin("response", "revisit")).select(
        "record_id", canonical_url(F.col("url")).alias("canonical_url"), "ts", "kind", lower_names(F.col("headers")).alias("headers")
    )
    complete = F.col("record_id").isNotNull() & F.col("canonical_url").isNotNull() & F.col("ts").isNotNull()
    usable = rows.filter(complete)
    limits = usable.agg(F.percentile_approx("ts", [i / SLICES for i in range(1, SLICES)], 10_000)).first()[0] or []
    cuts = sorted(set(limits))
    number = F.expr("0") if not cuts else F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: F.col("ts") > c))
    response = F.when(F.col("kind") == "response", F.struct("ts", "record_id", "headers"))
    placed = usable.withColumns({"slice": number, "response": response})
    url, slice_ = Window.partitionBy("canonical_url"), Window.partitionBy("canonical_url", "slice")
    carried = (
        placed.groupBy("canonical_url", "slice")
        .agg(F.max_by("response", F.when(F.col("response").isNotNull(), F.struct("ts", "record_id"))).alias("latest"))
        .withColumn("before", F.last("latest", True).over(url.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)))
        .select("canonical_url", "slice", "before")
    )
    local = F.last("response", True).over(slice_.orderBy("ts", "record_id").rowsBetween(Window.unboundedPreceding, -1))
    found = (
        placed.withColumn("here", local)
        .filter(F.col("kind") == "revisit")
        .join(carried, ["canonical_url", "slice"])
        .withColumn("found", F.coalesce("here", "before"))
    )
    own, theirs = F.col("headers"), F.col("found.headers")
    agree = F.when(_tag(own).isNotNull(), _tag(own).eqNullSafe(_tag(theirs))).otherwise(
        own["last-modified"].eqNullSafe(theirs["last-modified"])
    )
    reason = (
        F.when(F.col("found").isNull(), "no earlier response")
        .when(_tag(own).isNull() & own["last-modified"].isNull(), "no validator")
        .when(~agree, "validator differs")
        .otherwise("resolved")
    )
    permitted = F.map_filter(own, lambda k, v: ~k.isin(*NOT_PERMITTED))
    merged = F.map_concat(F.map_filter(theirs, lambda k, v: ~F.map_contains_key(permitted, k)), permitted)
    resolved = found.withColumn("reason", reason).select(
        "record_id", "canonical_url", F.when(F.col("reason") == "resolved", F.col("found.record_id")).alias("response_id"),
        "reason", F.when(F.col("reason") == "resolved", merged).otherwise(own).alias("headers"),
    )
    rest = rows.filter((F.col("kind") == "revisit") & ~complete).select(
        "record_id", "canonical_url", F.lit(None).cast(rows.schema["record_id"].dataType).alias("response_id"),
        F.lit("incomplete record").alias("reason"), "headers",
    )
    return resolved.unionByName(rest)


def captures_of(pages: DataFrame) -> DataFrame:
    """Capture records derived from pages (page_id, url, html), in page order.

    Every page gives a full response and, half a million ticks later, a revisit: with its entity tag, without
    one if page_id divides by 5, with another one if it divides by 7. Pages divided by 11 also have a revisit
    just before their response.
    """
    tag = F.md5("html")
    day = F.concat(F.lit("day "), F.col("page_id").cast("string"))
    text = lambda s: F.lit(s)
    full = F.create_map(
        text("ETag"), tag, text("Last-Modified"), day, text("Content-Type"), text("text/html"),
        text("Cache-Control"), text("max-age=60"), text("Content-Length"), F.length("html").cast("string"),
    )
    more = [text("Cache-Control"), text("max-age=600"), text("Content-Length"), text("0")]
    again = (
        F.when(F.col("page_id") % 5 == 0, F.create_map(text("Last-Modified"), day, *more))
        .when(F.col("page_id") % 7 == 0, F.create_map(text("ETag"), text("other"), *more))
        .otherwise(F.create_map(text("ETag"), F.concat(text("W/"), tag), *more))
    )
    record = lambda n, shift, kind, headers: F.struct(
        (F.col("page_id") * 4 + n).alias("record_id"), (F.col("page_id") * 1000 + shift).alias("ts"), text(kind).alias("kind"),
        headers.alias("headers"),
    )
    made = F.array(
        record(0, 0, "response", full), record(1, 500_000, "revisit", again),
        F.when(F.col("page_id") % 11 == 0, record(2, -1, "revisit", again)),
    )
    return pages.withColumn("r", F.explode(F.filter(made, lambda r: r.isNotNull()))).select("url", "r.*")
