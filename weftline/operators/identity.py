"""Does a business profile belong to the audited site?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import phone_digits
from ..functions.urls import domain


def verify(profiles: DataFrame, hosts: DataFrame, phones: DataFrame) -> DataFrame:
    """place_id, identity: matched, mismatch or unverified. profiles: place_id, site, website, phone; hosts: site, host;
    phones: site, phone.

    With a website only hosts decide: a profile's host and its parent domains meet the site's hosts and theirs by equality, so no
    pair of profile and host is made without a relation. Without one, phones of seven digits or more do, whole or by the last nine."""
    host = domain(F.col("website"))
    p = profiles.withColumn("host", F.when(F.coalesce("website", F.lit("")) != "", host)).withColumn("digits", F.coalesce(phone_digits(F.col("phone")), F.lit("")))

    def parents(c):
        parts = F.split(c, r"\.")
        return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))

    sites = hosts.select("site", F.lower("host").alias("h")).distinct()
    up = p.filter("host is not null").select("place_id", "site", F.explode(parents(F.col("host"))).alias("h")).join(sites, ["site", "h"], "left_semi")
    down = p.filter("host is not null").select("place_id", "site", F.col("host").alias("h")).join(sites.select("site", F.explode(parents(F.col("h"))).alias("h")).distinct(), ["site", "h"], "left_semi")
    by_host = up.select("place_id").union(down.select("place_id")).distinct().withColumn("host_ok", F.lit(True))
    known = phones.select("site", phone_digits(F.col("phone")).alias("d")).filter(F.length("d") >= 7).distinct()
    counted = known.groupBy("site").agg(F.count("*").alias("n_phones"))

    def forms(c):
        return F.array_distinct(F.array(F.concat(F.lit("="), c), F.when(F.length(c) >= 9, F.right(c, F.lit(9))).otherwise(F.concat(F.lit("="), c))))

    wanted = p.filter(F.length("digits") >= 7).select("place_id", "site", F.explode(forms(F.col("digits"))).alias("f"))
    by_phone = wanted.join(known.select("site", F.explode(forms(F.col("d"))).alias("f")).distinct(), ["site", "f"], "left_semi").select("place_id").distinct().withColumn("phone_ok", F.lit(True))
    out = p.join(by_host, "place_id", "left").join(by_phone, "place_id", "left").join(counted, "site", "left")
    identity = (
        F.when(F.col("host").isNotNull(), F.when(F.col("host") == "", "unverified").when(F.col("host_ok"), "matched").otherwise("mismatch"))
        .when((F.coalesce("phone", F.lit("")) != "") & F.col("phone_ok"), "matched")
        .when((F.coalesce("phone", F.lit("")) != "") & (F.coalesce("n_phones", F.lit(0)) > 0), "mismatch")
        .otherwise("unverified")
    )
    site = F.coalesce(F.col("start"), F.lit(""))
    first = hosts.groupBy(F.col("site").alias("__site")).agg(F.min("host").alias("start"))
    out = out.join(first, F.col("site") == F.col("__site"), "left").withColumn("identity", identity)
    evidence = (
        F.when(F.col("identity") == "unverified", "no comparable website domain and no matching public website phone")
        .when(F.coalesce(F.col("host"), F.lit("")) != "", F.concat(F.lit("website host "), F.col("host"), F.when(F.col("identity") == "matched", " matches the audited site").otherwise(F.concat(F.lit(" differs from audited host "), site))))
        .otherwise(F.concat(F.lit("phone "), F.col("phone"), F.when(F.col("identity") == "matched", " matches a public website phone").otherwise(F.concat(F.lit(" differs from "), F.coalesce("n_phones", F.lit(0)).cast("string"), F.lit(" public website phone numbers")))))
    )
    return out.select("place_id", "identity", evidence.alias("evidence"))


def audited_hosts(start, pages: DataFrame) -> DataFrame:
    """host: the distinct hosts of a site's start address and its pages' final addresses."""
    every = pages.select(F.col("final_url").alias("url")).union(pages.sparkSession.range(1).select(start.alias("url")))
    return every.select(domain(F.col("url")).alias("host")).filter("host <> ''").distinct()
