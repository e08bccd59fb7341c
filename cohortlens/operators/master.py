"""Provider ETL, record matching over several sources, golden records, change capture and business rules."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.ranking import exact_quantiles
from cohortlens.operators.aggregates import joined_values
from cohortlens.operators.graph import connected_components
from cohortlens.operators.joins import similar_names
from cohortlens.operators.windows import monthly_counts, monthly_with_rolling, monthly_with_stats
from cohortlens.session import cut_lineage, stored

col, lit = F.col, F.lit
Tables = Mapping[str, DataFrame]

# Configured limits and specialty limits.
LIMITS = {"max_facilities": 5, "max_monthly_activities": 50, "min_career_years": 1, "max_career_years": 60,
          "min_graduation_age": 22, "max_graduation_age": 40}
SPECIALTY_LIMITS = (("Family Medicine", 2, 30), ("Emergency Medicine", 3, 50), ("Surgery", 1, 10))
# Credibility per source (weight), used for golden records.
CREDIBILITY = (("source1", 0.95), ("source2", 0.85), ("source3", 0.75))


# --- ETL

def name_parts(c: Column) -> Column:
    clean = F.regexp_replace(F.trim(c), r"(?U)[^\w\s\-']", "")
    return F.filter(F.split(clean, r"\s+"), lambda x: x != "")


def parse_name(df: DataFrame, name: str) -> DataFrame:
    """first_name, last_name, middle_initial of a full name; one part serves as both names."""
    p = name_parts(col(name))
    n = F.size(p)
    return df.withColumns({
        "first_name": F.when(n > 0, F.get(p, lit(0))),
        "last_name": F.when(n > 0, F.element_at(p, -1)),
        "middle_initial": F.when(n > 2, F.substring(F.get(p, lit(1)), 1, 1))})


def npi_from_id(c: Column) -> Column:
    """Ten digits from the hash of the id; a second hash and zeros pad the rare short case the same way every time."""
    digits = lambda x: F.regexp_replace(F.md5(x), "[^0-9]", "")
    return F.substring(F.concat(digits(c), digits(F.concat(c, lit("#"))), lit("0" * 10)), 1, 10)


def padded(number: Column, digits: int = 6) -> Column:
    """Number as text with leading zeros; longer numbers keep all their digits."""
    text = number.cast("string")
    return F.lpad(text, F.greatest(lit(digits), F.length(text)), lit("0"))


def license_from_id(state: Column, c: Column) -> Column:
    return F.concat(state, F.upper(F.substring(F.md5(F.concat(state, c)), 1, 8)))


def authors_to_providers(authors: DataFrame, asof_year: int = 2025) -> DataFrame:
    """Author rows -> provider rows. Attributes that have no source value are input columns, never drawn."""
    nonblank = lambda c: F.when(col(c) != "", col(c))
    pid = F.when(col("author_id").isNotNull(), F.substring(F.replace("author_id", lit(" "), lit("_")), 1, 20)).otherwise(
        padded(col("row_no")))
    base = authors.select(
        F.concat(lit("PROV_"), pid).alias("provider_id"),
        F.coalesce(nonblank("full_name"), nonblank("authors"), F.concat(lit("Provider "), col("row_no"))).alias("full_name"),
        "license_state", "birth_year")
    return parse_name(base, "full_name").select(
        "provider_id", npi_from_id(col("provider_id")).alias("npi_number"), "full_name", "first_name", "last_name", "middle_initial",
        license_from_id(col("license_state"), col("provider_id")).alias("license_number"), "license_state", "birth_year",
        F.greatest(lit(0), lit(asof_year) - col("birth_year") - 25).alias("years_in_practice"),
        lit("AUTHORS_TRANSFORMED").alias("data_source"), lit("ACTIVE").alias("record_status"), lit(True).alias("is_golden_record"))


# --- matching

def name_variants(providers: DataFrame, all_levels: bool = False) -> DataFrame:
    """Blocks (soundex of the surname, first initial) holding several spellings, with the confidence band.

    Spellings are counted before blocks are formed. Listed spellings are the distinct ones of blocks that can be
    reported, which have at most three.
    """
    key = [F.soundex("last_name").alias("soundex_last"), F.substring("first_name", 1, 1).alias("first_initial")]
    names = providers.select(*key, "full_name").groupBy("soundex_last", "first_initial", "full_name").agg(F.count(lit(1)).alias("n"))
    blocks = names.groupBy("soundex_last", "first_initial").agg(
        F.count("full_name").alias("name_variations"), F.sum("n").alias("total_records")).where(col("name_variations") > 1)
    v, t = col("name_variations"), col("total_records")
    conf = F.when((v == 2) & (t > 5), "HIGH_CONFIDENCE").when((v <= 3) & (t > 2), "MEDIUM_CONFIDENCE").otherwise("LOW_CONFIDENCE")
    blocks = blocks.withColumn("duplicate_confidence", conf)
    if all_levels:
        return blocks
    kept = blocks.where(col("duplicate_confidence") != "LOW_CONFIDENCE")
    same = col("soundex_last").eqNullSafe(col("_s")) & col("first_initial").eqNullSafe(col("_i"))
    listed = names.where(col("full_name").isNotNull()).select(col("soundex_last").alias("_s"), col("first_initial").alias("_i"), "full_name")
    return kept.join(listed, same).groupBy(*kept.columns).agg(
        F.concat_ws("; ", F.sort_array(F.collect_list("full_name"))).alias("all_variations"))


def npi_usage(providers: DataFrame) -> DataFrame:
    """NPIs used by several providers or of wrong length: usage, distinct providers, status, and one row per name.

    Names stay in rows of their own with a count, because one NPI may be shared by very many records.
    """
    rows = providers.where(col("npi_number").isNotNull()).groupBy("npi_number", "provider_id", "full_name").agg(F.count(lit(1)).alias("n"))
    per = rows.groupBy("npi_number", "provider_id").agg(F.sum("n").alias("n"))
    g = per.groupBy("npi_number").agg(F.sum("n").alias("usage_count"), F.count(lit(1)).alias("distinct_providers"))
    bad = g.where((col("distinct_providers") > 1) | (F.length("npi_number") != 10))
    status = F.when(col("distinct_providers") > 1, "DUPLICATE_NPI").when(F.length("npi_number") != 10, "INVALID_FORMAT").when(
        ~F.rlike("npi_number", lit(r"^[0-9]{10}\z")), "NON_NUMERIC").otherwise("VALID")
    names = rows.groupBy("npi_number", col("full_name").alias("associated_name")).agg(F.sum("n").alias("name_count"))
    return bad.withColumn("validation_status", status).join(names, "npi_number")


def _members(df: DataFrame, source: str, key: Column, kind: str) -> DataFrame:
    return df.select(lit(kind).alias("match_type"), key.alias("match_key"), lit(source).alias("source"), "provider_id")


def _keys_in_all(parts: Sequence[DataFrame]) -> DataFrame:
    """Members whose key occurs in every part. Only key sets are joined, so a hot key never multiplies records."""
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p)
    full = stacked.select("match_key", "source").where(col("match_key").isNotNull()).distinct().groupBy("match_key").agg(
        F.count(lit(1)).alias("_n")).where(col("_n") == len(parts)).select("match_key")
    return stacked.join(full, "match_key", "left_semi").select("match_type", "match_key", "source", "provider_id")


def exact_matches(s1: DataFrame, s2: DataFrame, s3: DataFrame) -> DataFrame:
    """Members of NPI groups present in all three sources: one row per record, not one per combination."""
    return _keys_in_all([_members(d, n, col("npi_number"), "NPI_MATCH") for n, d in (("source1", s1), ("source2", s2), ("source3", s3))])


def fuzzy_matches(s1: DataFrame, s2: DataFrame, exact: DataFrame) -> DataFrame:
    """Members of (soundex, initial, licence) groups present in both sources, without source-1 ids matched before."""
    key = F.concat_ws("|", F.soundex("last_name"), F.substring("first_name", 1, 1), "license_number")
    whole = F.when(col("last_name").isNotNull() & col("first_name").isNotNull() & col("license_number").isNotNull(), key)
    taken = exact.where(col("source") == "source1").select("provider_id").distinct()
    left = s1.join(taken, "provider_id", "left_anti")
    return _keys_in_all([_members(left, "source1", whole, "FUZZY_MATCH"), _members(s2, "source2", whole, "FUZZY_MATCH")])


def institutional_matches(s1: DataFrame, s2: DataFrame, affiliations: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Members of groups (name pair above the threshold, shared facility). Names are compared once per distinct pair.

    A member stays if the other source has the other name of the pair at the facility. So each row meets the names of its
    pairs and moves once, and the texts of the keys are made of what stays.
    """
    pairs = similar_names(s1.select(col("full_name").alias("name")), s2.select(col("full_name").alias("name")), "name", threshold)
    # Both sides read the pairs; written, their size is known when they are joined.
    pairs = stored(pairs.select("n1", "n2", "similarity"), "pairs")
    a = affiliations.select("provider_id", "facility_id").distinct()
    placed = lambda d, n: d.select("provider_id", col("full_name").alias(n)).join(a, "provider_id")
    r1, r2 = placed(s1, "n1"), placed(s2, "n2")

    def side(rows: DataFrame, others: DataFrame, source: str, n: str, other: str) -> DataFrame:
        # Looked up by hash: the rows, once for each name they meet, need no sort.
        there = others.select(col(other).alias("_n"), col("facility_id").alias("_f")).distinct().hint("shuffle_hash")
        kept = rows.join(pairs, n).join(there, (col(other) == col("_n")) & col("facility_id").eqNullSafe(col("_f")), "left_semi")
        key = F.concat_ws("@", F.concat_ws("~", "n1", "n2"), "facility_id")
        return kept.select(lit("INSTITUTIONAL_MATCH").alias("match_type"), key.alias("match_key"), lit(source).alias("source"), "provider_id", "similarity")

    return side(r1, r2, "source1", "n1", "n2").unionByName(side(r2, r1, "source2", "n2", "n1"))


def all_matches(s1: DataFrame, s2: DataFrame, s3: DataFrame, affiliations: DataFrame) -> DataFrame:
    """Members of all three levels with their score: 1 for NPI, 0.9 for the licence block, the name similarity else."""
    exact = exact_matches(s1, s2, s3)
    fuzzy = fuzzy_matches(s1, s2, exact)
    inst = institutional_matches(s1, s2, affiliations)
    return exact.withColumn("score", lit(1.0)).unionByName(fuzzy.withColumn("score", lit(0.9))).unionByName(
        inst.withColumnRenamed("similarity", "score"))


def credibility(spark, rows: Sequence[tuple[str, float]] = CREDIBILITY) -> DataFrame:
    return spark.createDataFrame(list(rows), "source string, weight double")


def stack_sources(sources: Mapping[str, DataFrame], fields: Sequence[str]) -> DataFrame:
    out = None
    for name, d in sources.items():
        part = d.select(lit(name).alias("source"), "provider_id", "last_updated", *fields)
        out = part if out is None else out.unionByName(part)
    return out


def weighted_sources(sources: Mapping[str, DataFrame], fields: Sequence[str]) -> DataFrame:
    """All records with their source weight. The weight table has one row per source, so it is broadcast."""
    stacked = stack_sources(sources, fields)
    return stacked.join(F.broadcast(credibility(stacked.sparkSession)), "source")


def resolve_conflicts(matches: DataFrame, records: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Value per match group and field: the newest non-NULL value, ties to the later source."""
    m = matches.join(records, ["source", "provider_id"])
    newest = F.struct("last_updated", "source", "provider_id")
    return m.groupBy("match_key").agg(*[
        F.max_by(col(f), F.when(col(f).isNotNull(), newest)).alias(f"resolved_{f}") for f in fields], *[
        (F.count_distinct(f) > 1).alias(f"conflict_{f}") for f in fields])


def golden_records(matches: DataFrame, records: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One record per matched cluster.

    Clusters are the connected components of the graph record - match key, in which the smallest record of a key stands for
    the key. The value of a field is the one of the most credible source, then the newest; ``confidence`` is the mean
    weight of the cluster's records.
    """
    rec = F.concat_ws(":", "source", "provider_id")
    # Written once: the matches may be an expensive plan, and they are read for the smallest records and for the edges.
    members = cut_lineage(matches.select(rec.alias("src"), F.concat_ws(":", "match_type", "match_key").alias("_key")))
    first = members.groupBy("_key").agg(F.min("src").alias("dst"))
    comp = connected_components(members.join(first, "_key").select("src", "dst"))
    tagged = records.withColumn("node", rec).join(comp, "node", "left").withColumn(
        "golden_id", F.coalesce("component", "node"))
    best = F.struct("weight", "last_updated", "node")
    return tagged.groupBy("golden_id").agg(
        *[F.max_by(col(f), F.when(col(f).isNotNull(), best)).alias(f) for f in fields],
        F.count(lit(1)).alias("record_count"), F.count_distinct("source").alias("source_count"),
        F.avg("weight").alias("confidence"), F.max_by("source", best).alias("lead_source"), F.max("last_updated").alias("newest_update"))


# --- change capture

def capture_changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """INSERT / UPDATE / DELETE rows between two snapshots with changed columns and before / after images as maps."""
    cols = [c for c in new.columns if c != key]

    def image(side: str) -> Column:
        return F.map_from_arrays(F.array(*[lit(c) for c in cols]), F.array(*[col(f"{side}_{c}").cast("string") for c in cols]))

    o = old.select(col(key), lit(True).alias("_in_old"), *[col(c).alias(f"o_{c}") for c in cols])
    n = new.select(col(key), lit(True).alias("_in_new"), *[col(c).alias(f"n_{c}") for c in cols])
    j = o.join(n, key, "full_outer")
    before, after = image("o"), image("n")
    changed = F.map_filter(after, lambda k, v: ~v.eqNullSafe(F.element_at(before, k)))
    op = F.when(col("_in_old").isNull(), "INSERT").when(col("_in_new").isNull(), "DELETE").when(F.size(changed) > 0, "UPDATE")
    return j.select(
        col(key).alias("record_id"), op.alias("operation_type"), F.when(op == "UPDATE", changed).alias("changed_columns"),
        F.when(op != "INSERT", before).alias("before_values"), F.when(op != "DELETE", after).alias("after_values")).where(
        col("operation_type").isNotNull())


def apply_batch(changes: DataFrame, batch_date: dt.date, batch_id: str) -> DataFrame:
    """The change log after a daily batch: pending rows of the date become COMPLETED under the batch id."""
    hit = (col("processed_status") == "PENDING") & (F.to_date("change_timestamp") == lit(batch_date))
    return changes.withColumn("batch_id", F.when(hit, lit(batch_id))).withColumn(
        "processed_status", F.when(hit, "COMPLETED").otherwise(col("processed_status")))


def batch_log(changes: DataFrame, batch_date: dt.date, batch_id: str) -> DataFrame:
    hit = (col("processed_status") == "PENDING") & (F.to_date("change_timestamp") == lit(batch_date))
    return changes.where(hit).agg(
        F.count(lit(1)).alias("records_processed"),
        *[F.count_if(col("operation_type") == op).alias(f"{op.lower()}s") for op in ("INSERT", "UPDATE", "DELETE")]).select(
        lit(batch_id).alias("batch_id"), lit(batch_date).alias("batch_date"), lit("COMPLETED").alias("status"), "*")


def apply_changes(current: DataFrame, changes: DataFrame, key: str, order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Current table after the changes: the latest change per key wins, DELETE removes, others set ``values``.

    The latest change is a map-side combined ``max_by``, so a key with very many changes is no burden.
    """
    latest = changes.groupBy(col("record_id").alias(key)).agg(
        F.max_by(F.struct("operation_type", *values), F.struct(*order)).alias("_c"))
    rest = [c for c in current.columns if c != key and c not in values]
    joined = current.join(latest, key, "full_outer")
    touched = col("_c").isNotNull()
    return joined.where(~touched | (col("_c.operation_type") != "DELETE")).select(
        key, *rest, *[F.when(touched, col(f"_c.{v}")).otherwise(col(v)).alias(v) for v in values]).select(*current.columns)


# --- business rules

def too_many_facilities(t: Tables, limit: int = LIMITS["max_facilities"]) -> DataFrame:
    """Providers with more current facilities than allowed. Names are listed for the violating providers only."""
    a = t["affiliations"].where(col("end_date").isNull()).select("provider_id", "facility_id").distinct()
    over = a.groupBy("provider_id").agg(F.count(lit(1)).alias("facility_count")).where(col("facility_count") > limit)
    named = a.join(over, "provider_id").join(t["facilities"].select("facility_id", "facility_name"), "facility_id")
    listed = joined_values(named, "provider_id", "facility_id", "facility_name").where(col("n_values") > limit)
    return listed.select(
        lit("MAX_AFFILIATIONS").alias("rule_name"), "provider_id", col("n_values").alias("facility_count"), "part",
        col("values_text").alias("facilities"), lit("VIOLATION").alias("status"))


def activity_spikes(activities: DataFrame) -> DataFrame:
    m = monthly_with_rolling(activities, "provider_id", "activity_date")
    c, r = col("monthly_count"), col("rolling_avg")
    return m.where(c > r * 2).select(
        lit("ACTIVITY_SPIKE").alias("rule_name"), "provider_id", "month", "monthly_count", "rolling_avg",
        F.when(c > r * 3, "SEVERE_ANOMALY").when(c > r * 2, "MODERATE_ANOMALY").otherwise("NORMAL").alias("anomaly_level"))


def monthly_anomalies(activities: DataFrame) -> DataFrame:
    m = monthly_with_stats(activities, "provider_id", "activity_date").where(col("std_monthly") > 0)
    c, a, s = col("monthly_count"), col("avg_monthly"), col("std_monthly")
    level = F.when(c > a + 2 * s, "HIGH_ANOMALY").when(c > a + s, "MEDIUM_ANOMALY").otherwise("NORMAL")
    return m.withColumn("anomaly_level", level).where(col("anomaly_level") != "NORMAL")


def configured_limits(t: Tables, limits: Mapping[str, int] = LIMITS) -> DataFrame:
    """Rows ``rule_name, provider_id, observed`` outside the configured limits."""
    months = monthly_counts(t["activities"], "provider_id", "activity_date").where(
        col("monthly_count") > limits["max_monthly_activities"]).select(
        lit("max_monthly_activities").alias("rule_name"), "provider_id", col("monthly_count").alias("observed"))
    p, years = t["providers"], col("years_in_practice")
    age = col("graduation_year") - col("birth_year")
    found = F.array(
        F.when((years < limits["min_career_years"]) | (years > limits["max_career_years"]),
               F.struct(lit("career_years").alias("rule_name"), years.cast("bigint").alias("observed"))),
        F.when((age < limits["min_graduation_age"]) | (age > limits["max_graduation_age"]),
               F.struct(lit("graduation_age").alias("rule_name"), age.cast("bigint").alias("observed"))))
    rows = p.select("provider_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("v")).select(
        "v.rule_name", "provider_id", "v.observed")
    return rows.unionByName(months)


def specialty_limits(t: Tables, rows: Sequence[tuple[str, int, int]] = SPECIALTY_LIMITS) -> DataFrame:
    """Providers with more current facilities than typical for their specialty."""
    a = t["affiliations"].where(col("end_date").isNull()).select("provider_id", "facility_id").distinct()
    n = a.groupBy("provider_id").agg(F.count(lit(1)).alias("facility_count"))
    lim = n.sparkSession.createDataFrame(list(rows), "specialty_primary string, typical_facilities int, max_patients_per_day int")
    p = t["providers"].select("provider_id", "specialty_primary").join(F.broadcast(lim), "specialty_primary")
    return p.join(n, "provider_id").where(col("facility_count") > col("typical_facilities"))


def high_affiliation_counts(t: Tables) -> DataFrame:
    """Affiliation count above the 95th percentile over providers, and whether facilities lie in several states."""
    a = t["affiliations"].select("provider_id", "facility_id")
    f = t["facilities"].select("facility_id", "state_province")
    per = a.join(f, "facility_id", "left").groupBy("provider_id").agg(
        F.count(lit(1)).alias("affiliations"), F.count_distinct("state_province").alias("states"))
    p95 = exact_quantiles(per, "affiliations", {"p95": 0.95})
    return per.join(F.broadcast(p95)).select(
        "provider_id", "affiliations", "states", (col("affiliations") > col("p95")).alias("above_p95"),
        (col("states") > 1).alias("multi_state")).where(col("above_p95") | col("multi_state"))


def state_mismatch(t: Tables) -> DataFrame:
    """Current affiliations in a state other than the licence state."""
    a = t["affiliations"].where(col("end_date").isNull()).select("provider_id", "facility_id")
    p = t["providers"].select("provider_id", "license_state")
    f = t["facilities"].select("facility_id", "state_province")
    return a.join(p, "provider_id").join(f, "facility_id").where(col("license_state") != col("state_province"))
