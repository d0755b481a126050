"""Resolving WARC revisit records that say "not modified".

A revisit record (304, no payload of its own) stands for an earlier full response of the same page. Each
one is joined as-of: to the latest full response of the same canonical URL at or before its own time
(at equal times the one with the larger record id; a response isn't later than a revisit of its time).
The pair holds if their validators agree: equal ETags if both have one (weak marks aside), else equal
Last-Modified if both have one, else equal payload digests if both have one. If none can be compared, the
earlier response is taken too but marked ``unchecked``. The resolved record has the response's headers,
with those that a 304 may renew taken from the revisit.

A URL may hold any share of the records: its records are first reduced to one row per time, times are cut
into parts, and the latest response of every part is carried into the parts after it. Payloads don't
move; the result names the record that has it.

Null URLs or times resolve to nothing (status ``no_url``, ``no_time``). Null headers count as none; names
of headers compare in lower case, and of repeated names the last counts. Repeated rows each give a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Headers a 304 response may renew; others keep the stored response's value.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that don't name another page.
TRACKING = r"(?:utm_[a-z]+|ref|fbclid|gclid|sessionid)"


def canonical_url(url: Column) -> Column:
    """Lower-case host, no scheme, "www.", default port, fragment, tracking parameters or slash at the end."""
    plain = F.regexp_replace(F.trim(url), r"#.*$", "")
    host = F.lower(F.regexp_extract(plain, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r":(?:80|443)$", "")
    rest = F.regexp_replace(plain, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?]*", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^([^?]*)", 1), r"/+$", "")
    kept = F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(f"^{TRACKING}(?:=|$)"))
    query = F.array_join(F.array_sort(kept), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def lower_names(headers: Column) -> Column:
    """Header names in lower case, the last of equal ones; an array of (name, value) by name."""
    entries = F.transform(F.coalesce(headers, F.array().cast("array<struct<name:string,value:string>>")),
                          lambda h, i: F.struct(F.lower(F.trim(h["name"])).alias("name"), h["value"].alias("value"), i.alias("at")))
    last = F.filter(entries, lambda h: h["name"].isNotNull() & ~F.exists(entries, lambda o: (o["name"] == h["name"]) & (o["at"] > h["at"])))
    return F.transform(F.array_sort(last), lambda h: F.struct(h["name"].alias("name"), h["value"].alias("value")))


def header(headers: Column, name: str) -> Column:
    return F.get(F.filter(headers, lambda h: h["name"] == name), F.lit(0))["value"]


def merged_headers(stored: Column, fresh: Column) -> Column:
    """The stored headers with PERMITTED ones from the fresh, by name."""
    new = F.filter(fresh, lambda h: h["name"].isin(*PERMITTED))
    old = F.filter(stored, lambda h: ~F.exists(new, lambda o: o["name"] == h["name"]))
    return F.array_sort(F.concat(old, new))


def resolve_revisits(records: DataFrame, part_seconds: int = 86_400) -> DataFrame:
    """One row per revisit record.

    ``records``: record_id long, kind ("response" or "revisit"), url, time (timestamp), digest, headers
    (array of name, value). The result: record_id, url_key, resolved_id, status (resolved, unchecked,
    mismatch, no_response, no_url, no_time) and the merged headers, null where nothing is resolved.
    """
    given = records.select(
        F.col("record_id").cast("long").alias("record_id"), F.lower("kind").alias("kind"),
        canonical_url(F.col("url")).alias("url_key"), F.unix_micros(F.col("time").cast("timestamp")).alias("at"), "digest",
        lower_names(F.col("headers")).alias("headers"))
    usable = given.where("url_key is not null and at is not null")
    response = F.col("kind") == "response"
    # one row per URL and time, whatever number of records share them
    times = usable.groupBy("url_key", "at").agg(F.max(F.when(response, F.col("record_id"))).alias("id"))
    times = times.select("url_key", "at", F.floor(F.col("at") / (1_000_000 * part_seconds)).alias("part"),
                         F.when(F.col("id").isNotNull(), F.struct("at", "id")).alias("own"))
    earlier = W.partitionBy("url_key").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    carried = times.groupBy("url_key", "part").agg(F.max("own").alias("own")).select(
        "url_key", "part", F.max("own").over(earlier).alias("carried"))
    so_far = W.partitionBy("url_key", "part").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    latest = times.withColumn("near", F.max("own").over(so_far)).join(carried, ["url_key", "part"]).select(
        "url_key", "at", F.coalesce("near", "carried").alias("latest"))
    stored = usable.where(response).groupBy(
        F.col("url_key").alias("stored_key"), F.col("at").alias("stored_at"), F.col("record_id").alias("stored_id")).agg(
        F.min(F.struct("digest", "headers")).alias("stored"))
    matched = given.where("kind = 'revisit'").join(latest, ["url_key", "at"], "left")
    joined = matched.join(stored, (F.col("url_key") == F.col("stored_key")) & (F.col("latest.at") == F.col("stored_at"))
                          & (F.col("latest.id") == F.col("stored_id")), "left")
    tag = lambda h: F.regexp_replace(header(h, "etag"), "^W/", "")
    old, new = F.col("stored.headers"), F.col("headers")
    agree = F.coalesce(tag(old) == tag(new), header(old, "last-modified") == header(new, "last-modified"),
                       F.col("stored.digest") == F.col("digest"))
    status = (F.when(F.col("url_key").isNull(), "no_url").when(F.col("at").isNull(), "no_time")
              .when(F.col("stored_id").isNull(), "no_response").when(agree.isNull(), "unchecked")
              .when(agree, "resolved").otherwise("mismatch"))
    holds = F.col("status").isin("resolved", "unchecked")
    return joined.withColumn("status", status).select(
        "record_id", "url_key", F.when(holds, F.col("stored_id")).alias("resolved_id"), "status",
        F.when(holds, merged_headers(old, new)).alias("headers"))
