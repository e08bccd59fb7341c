"""Join shapes used by the domain queries."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.extract import trigram_similarity, trigrams
from cohortlens.functions.ranking import numbered, prefix_sums

col, lit = F.col, F.lit
Tables = Mapping[str, DataFrame]


def active_providers_with_primary_affiliation(t: Tables) -> DataFrame:
    p = t["providers"].where(col("record_status") == "ACTIVE").select(
        "provider_id", "full_name", "specialty_primary", "license_state")
    a = t["affiliations"].where(col("is_primary_affiliation") & col("end_date").isNull()).select(
        "provider_id", "facility_id", "start_date")
    f = t["facilities"].select("facility_id", "facility_name", "facility_type", "city", "state_province")
    return p.join(a, "provider_id").join(f, "facility_id").drop("facility_id")


def provider_activity_summary(t: Tables) -> DataFrame:
    """Activities are reduced per (provider, facility), then per provider, and only then meet the providers."""
    a = t["activities"]
    per_site = a.groupBy("provider_id", "facility_id").agg(
        F.count("activity_id").alias("n"), F.min("activity_date").alias("d0"), F.max("activity_date").alias("d1"),
        F.count_if(col("activity_type") == "PUBLICATION").alias("pubs"),
        F.sum("citation_count").alias("cites"), F.count("citation_count").alias("cited"))
    per_provider = per_site.groupBy("provider_id").agg(
        F.sum("n").alias("total_activities"), F.count("facility_id").alias("facilities_count"),
        F.min("d0").alias("first_activity"), F.max("d1").alias("latest_activity"),
        F.sum("pubs").alias("publication_count"), (F.sum("cites") / F.sum("cited")).alias("avg_citations"))
    p = t["providers"].where(col("record_status") == "ACTIVE").select("provider_id", "full_name", "specialty_primary")
    return p.join(per_provider, "provider_id", "left").withColumns({
        n: F.coalesce(n, lit(0)) for n in ("total_activities", "facilities_count", "publication_count")})


def date_spine(df: DataFrame, date: str, value: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """Every day between the first and last date (per key) with the aggregated value, 0 where there is none."""
    daily = df.groupBy(*keys, date).agg(value.alias("value"))
    span = daily.groupBy(*keys).agg(F.min(date).alias("_lo"), F.max(date).alias("_hi"))
    days = span.select(*keys, F.explode(F.sequence("_lo", "_hi")).alias(date))
    return days.join(daily, [*keys, date], "left").withColumn("value", F.coalesce("value", lit(0)))


def shared_partner_counts(df: DataFrame, node: str, a: str, b: str) -> DataFrame:
    """Partners of each node under the OR condition ``same a or same b``.

    The number of distinct partners is |same a| + |same b| - |same a and b| - 1, so the result comes from three
    group sizes and the pairs are never produced.
    """
    ga = df.groupBy(a).agg(F.count(lit(1)).alias("_na"))
    gb = df.groupBy(b).agg(F.count(lit(1)).alias("_nb"))
    gab = df.groupBy(a, b).agg(F.count(lit(1)).alias("_nab"))
    sizes = gab.join(ga, a).join(gb, b)
    return df.select(node, a, b).join(sizes, [a, b]).select(
        node, (col("_na") - 1).alias("same_" + a), (col("_nb") - 1).alias("same_" + b),
        (col("_na") + col("_nb") - col("_nab") - 1).alias("partners"))


def exists_shared_facility(candidates: DataFrame, affiliations: DataFrame) -> DataFrame:
    """Candidate pairs ``(s1_id, s2_id)`` whose providers share a facility; only candidate pairs are expanded."""
    a = affiliations.select("provider_id", "facility_id").distinct()
    left = candidates.select("s1_id", "s2_id").join(a.withColumnRenamed("provider_id", "s1_id"), "s1_id")
    hits = left.join(a.withColumnRenamed("provider_id", "s2_id"), ["s2_id", "facility_id"], "left_semi")
    return candidates.join(hits.select("s1_id", "s2_id").distinct(), ["s1_id", "s2_id"], "left_semi")


def similar_names(left: DataFrame, right: DataFrame, name: str = "name", threshold: float = 0.8) -> DataFrame:
    """Pairs of distinct names ``(n1, n2, similarity)`` with trigram similarity above ``threshold``, exact.

    Prefix filter: two sets with Jaccard over t share a trigram among the first ``size - ceil(t*size) + 1`` of each
    when trigrams are put in one global order. Rare trigrams come first, so candidates meet on rare keys, and a
    length test removes pairs that cannot reach t before the sets are compared.
    """
    l = left.select(col(name).alias("_n")).where(col("_n").isNotNull()).distinct()
    r = right.select(col(name).alias("_n")).where(col("_n").isNotNull()).distinct()
    long = lambda d: d.select("_n", F.explode(trigrams(col("_n"))).alias("_g"))
    freq = long(l).unionByName(long(r)).groupBy("_g").agg(F.count(lit(1)).alias("_f"))

    def prefixes(d: DataFrame) -> DataFrame:
        grams = long(d).join(freq, "_g").groupBy("_n").agg(
            F.sort_array(F.collect_list(F.struct("_f", "_g"))).alias("_s"))
        size = F.size("_s")
        keep = size - F.ceil(size * lit(threshold)) + 1
        return grams.select("_n", size.alias("_z"), F.explode(F.slice("_s", lit(1), keep)).alias("_p")).select(
            "_n", "_z", col("_p._g").alias("_g"))

    pl = prefixes(l).select(col("_n").alias("n1"), col("_z").alias("z1"), "_g")
    pr = prefixes(r).select(col("_n").alias("n2"), col("_z").alias("z2"), "_g")
    near = (F.least("z1", "z2") > lit(threshold) * F.greatest("z1", "z2"))
    return (
        pl.join(pr, "_g").where(near).select("n1", "n2").distinct()
        .withColumn("similarity", trigram_similarity(col("n1"), col("n2")))
        .where(col("similarity") > threshold))


def overlapping_intervals(df: DataFrame, key: str, item: str, start: str, end: str) -> DataFrame:
    """Per row, how many earlier-starting rows of the same key are still open when it starts.

    A sweep over start and end events counts open intervals, so a key with many rows gives one output row per
    input row instead of all pairs. Ties: an interval ending on the start day still overlaps.
    """
    far = F.to_date(lit("9999-12-31"))
    opened = df.select(key, item, col(start).alias("_d"), lit(0).alias("_kind"), lit(1).alias("_delta"))
    closed = df.select(key, item, F.coalesce(col(end), far).alias("_d"), lit(1).alias("_kind"), lit(-1).alias("_delta"))
    events = opened.unionByName(closed)
    swept = prefix_sums(events, [key], [col("_d"), col("_kind"), col(item)], None, {"_open": col("_delta")})
    return swept.where(col("_kind") == 0).select(key, item, col("_d").alias(start), (col("_open") - 1).alias("overlaps"))


def positional_pairs(df: DataFrame, group: str, order: str, left: str, right: str) -> DataFrame:
    """Pairs the n-th non-NULL ``left`` with the n-th non-NULL ``right`` of a group (an accident kept as an option)."""
    bucket = F.floor(col(order) / 100_000)
    l = numbered(df.where(col(left).isNotNull()).select(group, order, left), [group], [col(order)], bucket)
    r = numbered(df.where(col(right).isNotNull()).select(group, order, right), [group], [col(order)], bucket)
    return l.select(group, "pos", left).join(r.select(group, "pos", right), [group, "pos"])
