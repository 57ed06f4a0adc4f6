"""Not-modified revisits of a web archive, resolved to what they revisit.

A revisit record says that a page had not changed. It is joined, as of its time,
to the latest earlier full response of the same canonical URL; it is resolved if
its validators (entity tag, else last-modified, else payload digest) agree with
that response's, and then takes that response's headers, updated with those of
its own that a 304 may update.

A URL that very many records share is split by time: the latest response of each
(URL, slice of time) is aggregated before the shuffle and carried to the later
slices, and windows only run within a slice. The found response's headers come
by a join on its record id, whose frequent values Spark splits; revisits that
found none leave before it.

Defined results: only responses strictly earlier than the revisit count, and of
equal times the largest record id is the latest; null validators are absent
ones; null or empty urls match nothing; a null time is earlier than nothing and
has nothing earlier; responses that repeat a record id are one record's copies,
of which the latest counts, at equal times the one with the largest digest and
headers; revisits that repeat one are judged each as the latest of them;
a null record id finds nothing; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Headers that a 304 response may update in the stored one (lower case).
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
#: Query parameters that name no other page.
TRACKING = r"^(utm_[a-z]+|gclid|fbclid|ref|sessionid|phpsessid|jsessionid)(=.*)?$"
SLICES = 256


def canonical_url(url: Column) -> Column:
    """Host in lower case without scheme, user, www and default port; path without a last slash;
    query in order of its parameters without tracking ones; no fragment. Null for a null or empty url."""
    plain = F.regexp_replace(F.trim(url), r"#.*$", "")
    rest = F.regexp_replace(plain, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1)), r"^[^@]*@", ""), r"^www[0-9]*\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.array_join(F.array_sort(F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda x: (x != "") & ~F.lower(x).rlike(TRACKING))), "&")
    return F.when(F.trim(url) != "", F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """The revisits with outcome (resolved, mismatch, unresolved), refers_to and, where resolved, merged headers.

    records: record_id long, url string, ts long, kind string (response or revisit), headers
    map<string, string> with names in lower case, payload_digest string."""
    rows = records.select("record_id", canonical_url(F.col("url")).alias("page"), "ts", "kind", "headers", "payload_digest")
    span = rows.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    lo, width = span["lo"] or 0, ((span["hi"] or 0) - (span["lo"] or 0)) // SLICES + 1
    timed = rows.filter("page is not null and ts is not null").select("record_id", "page", "ts", (F.col("kind") == "response").alias("full"), F.floor((F.col("ts") - lo) / width).alias("slice"))
    mark = F.struct("ts", "record_id")
    last = timed.filter("full").groupBy("page", "slice").agg(F.max(mark).alias("last"))
    # what a slice finds of earlier ones: a page has at most SLICES slices
    steps = last.union(timed.filter(~F.col("full")).select("page", "slice").distinct().select("page", "slice", F.lit(None).cast(last.schema["last"].dataType)))
    steps = steps.groupBy("page", "slice").agg(F.max("last").alias("last"))
    before = Window.partitionBy("page").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = steps.select("page", "slice", F.max("last").over(before).alias("carried"))
    within = Window.partitionBy("page", "slice").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    latest = timed.withColumn("near", F.max(F.when(F.col("full"), mark)).over(within)).filter(~F.col("full"))
    found = latest.join(carried, ["page", "slice"], "left").select("record_id", F.coalesce("near", "carried").alias("near"))
    found = found.groupBy("record_id").agg(F.max("near")["record_id"].alias("refers_to")).filter("refers_to is not null")

    version = F.struct("ts", "payload_digest", header_lines(F.col("headers")))
    stored = rows.filter(F.col("kind") == "response").groupBy(F.col("record_id").alias("refers_to")).agg(F.max_by(F.struct("headers", "payload_digest"), version).alias("x"))
    stored = stored.select("refers_to", F.col("x.headers").alias("stored"), F.col("x.payload_digest").alias("stored_digest"))
    asked = rows.filter(F.col("kind") == "revisit").join(found, "record_id", "left")
    revisits = asked.filter("refers_to is not null").join(stored, "refers_to", "left")
    lost = asked.filter("refers_to is null").withColumn("stored", F.lit(None).cast("map<string,string>")).withColumn("stored_digest", F.lit(None).cast("string"))
    revisits = revisits.unionByName(lost)
    tag = lambda c: F.regexp_replace(F.element_at(c, "etag"), "^W/", "")  # noqa: E731  compared weakly
    since = lambda c: F.element_at(c, "last-modified")
    agree = F.when(tag("headers").isNotNull(), tag("headers") == tag("stored")).when(since("headers").isNotNull(), since("headers") == since("stored")).otherwise(F.col("payload_digest") == F.col("stored_digest"))
    outcome = F.when(F.col("refers_to").isNull(), "unresolved").when(F.coalesce(agree, F.lit(False)), "resolved").otherwise("mismatch")
    own = F.map_filter("headers", lambda k, _: k.isin(PERMITTED))
    kept = F.map_filter("stored", lambda k, _: ~F.array_contains(F.map_keys(own), k))
    judged = revisits.withColumn("outcome", outcome)
    merged = F.when(F.col("outcome") == "resolved", F.map_concat(kept, own))
    digest = F.when(F.col("outcome") == "resolved", F.col("stored_digest"))
    return judged.select("record_id", "page", "ts", "outcome", "refers_to", merged.alias("headers"), digest.alias("payload_digest"))


def header_lines(headers: Column) -> Column:
    """Headers as sorted lines."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")
