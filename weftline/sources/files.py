"""Captured inputs: sitemaps, robots files, provider payloads; and the JSON report sink."""

from __future__ import annotations

import zlib
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

RANKED = T.StructType([T.StructField("keyword", T.StringType()), T.StructField("search_volume", T.IntegerType()), T.StructField("cpc", T.DoubleType()), T.StructField("position", T.IntegerType()), T.StructField("url", T.StringType())])
PLACE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("displayName", T.StructType([T.StructField("text", T.StringType())])),
        T.StructField("businessStatus", T.StringType()),
        T.StructField("primaryTypeDisplayName", T.StructType([T.StructField("text", T.StringType())])),
        T.StructField("formattedAddress", T.StringType()),
        T.StructField("internationalPhoneNumber", T.StringType()),
        T.StructField("websiteUri", T.StringType()),
        T.StructField("regularOpeningHours", T.StructType([T.StructField("weekdayDescriptions", T.ArrayType(T.StringType()))])),
        T.StructField("userRatingCount", T.IntegerType()),
        T.StructField("photos", T.ArrayType(T.StructType([T.StructField("name", T.StringType())]))),
        T.StructField("location", T.StructType([T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType())])),
        T.StructField("addressComponents", T.ArrayType(T.StructType([T.StructField("longText", T.StringType()), T.StructField("types", T.ArrayType(T.StringType()))]))),
    ]
)


#: Bytes of a sitemap that are read, and documents of a site.
SITEMAP_BYTES, SITEMAPS = 10 << 20, 25


def unpacked(body, url, content_type):
    """Text of a fetched body (binary): unzipped where the type or the address says so; null where that fails."""
    zipped = F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("gzip")) | F.lower(url).endswith(".gz")
    return F.when(zipped, _gunzipped(body)).otherwise(F.decode(F.substring(body, 1, SITEMAP_BYTES), "UTF-8"))


@pandas_udf(T.StringType())
def _gunzipped(body: pd.Series) -> pd.Series:
    def one(b):
        try:
            return zlib.decompressobj(31).decompress(bytes(b), SITEMAP_BYTES).decode("utf-8", "replace")
        except zlib.error:
            return None

    return body.map(one, na_action="ignore")


_XML = "url array<struct<loc:string>>, sitemap array<struct<loc:string>>, _bad string"


def _parsed(documents: DataFrame) -> DataFrame:
    """documents (url, body) with xml: what the XML reader makes of the body; null where there is none or it is cut off at its limit."""
    body = F.when(F.octet_length("body") <= SITEMAP_BYTES, F.col("body"))
    return documents.withColumn("xml", F.from_xml(body, _XML, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "ignoreNamespace": "true"}))


def _locations(documents: DataFrame) -> DataFrame:
    """source, kind, pos, loc of well-formed documents."""
    kinds = [F.transform(F.coalesce(f"xml.{c}", F.array().cast("array<struct<loc:string>>")), lambda x, i: F.struct(F.lit(k).alias("kind"), i.alias("pos"), F.trim(F.regexp_replace(x["loc"], r"^\s+|\s+$", "")).alias("loc"))) for c, k in (("url", "page"), ("sitemap", "sitemap"))]  # noqa: B023
    rows = _parsed(documents).filter("xml is not null and xml._bad is null").select(F.col("url").alias("source"), F.inline(F.concat(*kinds)))
    return rows.filter("loc <> ''")


def sitemap_urls(documents: DataFrame) -> DataFrame:
    """Locations of sitemap texts (url, body): source, kind (page or sitemap), loc; each once for its source. Documents are read as XML, whatever prefixes, comments
    or character data they have; what is no XML, or longer than 10 MiB, gives none."""
    return _locations(documents).select("source", "kind", "loc").distinct()


def sitemap_sources(files: DataFrame) -> DataFrame:
    """site, url, pos of the sitemaps that a site begins with: those its robots file lists, in order, else /sitemap.xml. files: site, origin (scheme and host), body (null: no robots file)."""
    lines = F.filter(F.split(F.coalesce("body", F.lit("")), r"\r?\n"), lambda x: x.rlike(r"(?i)^\s*sitemap\s*:\s*\S"))
    listed = F.transform(lines, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "#.*$", ""), r"(?i)^\s*sitemap\s*:", "")))
    first = F.array(F.concat(F.regexp_replace("origin", "/+$", ""), F.lit("/sitemap.xml")))
    return files.select("site", F.posexplode(F.when(F.size(listed) > 0, listed).otherwise(first)).alias("pos", "url")).select("site", "url", "pos")


def sitemap_errors(read: DataFrame, documents: DataFrame) -> DataFrame:
    """site, url, error of the sources (site, url) that could not be read, and sources, how many their site has. documents: url, body, status if known."""
    status = F.col("status").cast("string") if "status" in documents.columns else F.lit("no response")
    told = _parsed(documents).select(F.col("url").alias("__url"), F.col("body").isNotNull().alias("__got"), F.coalesce(F.col("xml").isNull() | F.col("xml._bad").isNotNull(), F.lit(False)).alias("__bad"), status.alias("__status"))
    met = read.join(told, F.col("url") == F.col("__url"), "left")
    error = F.when(~F.coalesce("__got", F.lit(False)), F.concat(F.col("url"), F.lit(" returned "), F.coalesce("__status", F.lit("no response")))).when(F.col("__bad"), F.concat(F.col("url"), F.lit(": no well-formed XML")))
    counted = read.groupBy(F.col("site").alias("__site")).agg(F.count("*").cast("int").alias("sources"))
    return met.withColumn("error", error).filter("error is not null").join(counted, F.col("site") == F.col("__site")).select("site", "url", "error", "sources")


def sitemap_walk(documents: DataFrame, start: DataFrame, limit: int = SITEMAPS) -> tuple[DataFrame, DataFrame]:
    """(sources: site, url, round, place from 1; distinct page locations: site, loc) of the sitemaps that can be reached from start (site, url, pos if they have an order).

    documents: url, body (null where the fetch failed). A site's sitemaps stand in a queue: those of an index come behind all that were named before, in
    its order. Each round reads what the last one named, as long as a site has fewer than `limit`. One join a round."""
    from ..operators.site import saved

    found = saved(_locations(documents.filter("body is not null")))
    nested = found.filter("kind = 'sitemap'").groupBy("source", F.col("loc").alias("named")).agg(F.min("pos").alias("pos"))
    by = F.struct(F.lit(0).alias("parent"), (F.col("pos") if "pos" in start.columns else F.lit(0)).cast("int").alias("pos"))
    todo = start.groupBy("site", "url").agg(F.min(by).alias("by"))
    read = None
    for step in count():
        place = F.row_number().over(Window.partitionBy("site").orderBy("by", "url"))
        if read is not None:
            used = read.groupBy(F.col("site").alias("__site")).agg(F.count("*").alias("__used"))
            todo = todo.join(used, F.col("site") == F.col("__site"), "left").drop("__site")
        else:
            todo = todo.withColumn("__used", F.lit(0))
        taken = todo.withColumn("place", (place + F.coalesce("__used", F.lit(0))).cast("int")).filter(F.col("place") <= limit).select("site", "url", F.lit(step).alias("round"), "place")
        taken = saved(taken)
        if step and taken.isEmpty():
            break
        read = taken if read is None else saved(read.unionByName(taken))
        named = taken.join(nested, F.col("url") == F.col("source")).groupBy("site", F.col("named").alias("url")).agg(F.min(F.struct(F.col("place").alias("parent"), "pos")).alias("by"))
        todo = named.join(read.select("site", "url"), ["site", "url"], "left_anti")
    pages = read.join(found.filter("kind = 'page'"), F.col("url") == F.col("source")).select("site", "loc").distinct()
    return read, pages


def ranked_items(payloads: DataFrame, *keys: str) -> DataFrame:
    """keys and rows of captured ranking payloads (payload: a JSON array) with ord, their place."""
    rows = payloads.select(*keys, F.posexplode(F.from_json("payload", T.ArrayType(RANKED))).alias("ord", "r"))
    return rows.select(*keys, "r.*", "ord")


def places(payloads: DataFrame) -> DataFrame:
    """Profiles of captured place payloads (payload: JSON). Counts stay null where the payload doesn't have them."""
    p = payloads.select(F.from_json("payload", PLACE).alias("p"))

    def part(*kinds):
        def one(kind):
            return F.try_element_at(F.filter("p.addressComponents", lambda a: F.array_contains(a["types"], kind)), F.lit(1))["longText"]

        return F.coalesce(*[one(k) for k in kinds])

    place = F.coalesce(part("postal_town", "locality", "administrative_area_level_2", "administrative_area_level_1"), F.lit(""))
    country = F.coalesce(part("country"), F.lit(""))
    market = F.when(place == "", country).when((country == "") | (place == country), place).otherwise(F.concat_ws(", ", place, country))
    return p.select(
        F.col("p.id").alias("place_id"), F.col("p.displayName.text").alias("name"), F.col("p.businessStatus").alias("business_status"), F.col("p.primaryTypeDisplayName.text").alias("category"),
        F.col("p.formattedAddress").alias("address"), F.col("p.internationalPhoneNumber").alias("phone"), F.col("p.websiteUri").alias("website"), F.col("p.regularOpeningHours.weekdayDescriptions").alias("hours"),
        F.col("p.userRatingCount").alias("reviews"), F.when(F.col("p.photos").isNotNull(), F.size("p.photos")).alias("photos"), F.col("p.location.latitude").alias("latitude"), F.col("p.location.longitude").alias("longitude"), market.alias("market"), country.alias("country"),
    )


def write_report(df: DataFrame, path: str) -> None:
    """One JSON object a line, nulls and all."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def report_text(df: DataFrame) -> DataFrame:
    """The same objects as rows of text, for a console or an answer."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def report_name(at, url):
    """<UTC time in milliseconds>-<host>.json, which sorts by time."""
    from ..functions.urls import host_key

    return F.concat(F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyyMMdd'T'HHmmss.SSS'Z'"), F.lit("-"), host_key(url), F.lit(".json"))
