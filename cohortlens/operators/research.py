"""Summaries, insights, meta-analysis and quality of the unified study rows.

Input is one long table: ``source_category, source_table, row_ordinal`` and the study columns. Counts per text
value are aggregated before anything is ranked, so a popular category never forms one task.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.functions import extract as X
from cohortlens.functions.ranking import exact_quantiles
from cohortlens.operators.aggregates import histogram, merged_top_counts, value_counts
from cohortlens.session import stored

col, lit = F.col, F.lit

# Category folders and their names.
CATEGORIES = {
    "1_population": "Population Management",
    "2_relevant_factors": "Relevant Factors",
    "3_patient_descriptions": "Patient Descriptions",
    "4_models_and_open_questions": "Models and Open Questions",
    "5_materials": "Materials Research",
    "6_diagnostics": "Diagnostics",
    "7_therapeutics_interventions_and_clinical_studies": "Therapeutics & Clinical Studies",
    "8_risk_factors": "Risk Factors",
}
PATIENTS, DIAGNOSTICS, THERAPEUTICS, RISK = (
    "3_patient_descriptions", "6_diagnostics", "7_therapeutics_interventions_and_clinical_studies", "8_risk_factors")
# Evidence scores, first contained key decides.
EVIDENCE = (
    ("Randomized Controlled Trial", 5), ("Systematic Review", 5), ("Meta-analysis", 5),
    ("Prospective Observational Study", 4), ("Cohort Study", 4), ("Case-Control Study", 3),
    ("Retrospective Observational Study", 2), ("Case Series", 2), ("Expert Review", 1), ("Editorial", 1),
)
# Design scores; the keys hold underscores, so ordinary text only meets "cohort".
DESIGNS = (
    ("systematic_review", 5), ("meta_analysis", 5), ("randomized_controlled", 4), ("cohort", 3), ("case_control", 2),
    ("cross_sectional", 2), ("case_series", 1), ("case_report", 1),
)
REPORTING = ("sample_size", "study_type", "study_date", "journal", "accuracy_text", "clinical_improvement", "severe", "fatality")
OUTCOMES = ("clinical_improvement", "severe", "fatality")
COMORBIDITIES = ("Diabetes", "Hypertension", "Heart Disease", "COPD", "Cancer")
DEMOGRAPHICS = ("Male Gender", "Race Black Vs White", "Race Asian Vs White")
DIMENSION_WEIGHTS = (("sample_size", 0.3), ("study_design", 0.3), ("reporting", 0.2), ("bias_risk", 0.2))


def category_name(c: Column) -> Column:
    return F.element_at(X.const_map(CATEGORIES), c)


def _in(df: DataFrame, *categories: str) -> DataFrame:
    return df.where(col("source_category").isin(*categories))


def _stack(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _integers(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return df.select(*keys, F.explode(X.all_integers(col("sample_size"))).alias("n"))


# --- summaries

def category_summary(rows: DataFrame) -> DataFrame:
    per_table = rows.groupBy("source_category", "source_table").agg(
        F.count(lit(1)).alias("records"), F.min("study_date").alias("lo"), F.max("study_date").alias("hi"))
    base = per_table.groupBy("source_category").agg(
        F.count(lit(1)).alias("total_tables"), F.sum("records").alias("total_records"),
        F.min("lo").alias("earliest"), F.max("hi").alias("latest"))
    types = rows.where(col("study_type").isNotNull()).groupBy("source_category", "study_type").agg(F.count(lit(1)).alias("n"))
    top = types.groupBy("source_category").agg(
        F.count(lit(1)).alias("study_types"), F.max_by("study_type", F.struct("n", "study_type")).alias("top_study_type"),
        F.max("n").alias("top_study_type_count"))
    return base.join(top, "source_category", "left").withColumn("category_name", category_name(col("source_category")))


def journal_counts(rows: DataFrame, per_table: int = 10) -> DataFrame:
    """Journal counts per category, merged from each table's most frequent journals."""
    counts = rows.where(col("journal").isNotNull()).groupBy("source_category", "source_table", "journal").agg(
        F.count(lit(1)).alias("n"))
    w = Window.partitionBy("source_category", "source_table").orderBy(col("n").desc(), "journal")
    return counts.withColumn("_r", F.row_number().over(w)).where(col("_r") <= per_table).groupBy(
        "source_category", "journal").agg(F.sum("n").alias("n"))


def risk_table_metrics(rows: DataFrame) -> DataFrame:
    r = _in(rows, RISK)
    base = r.groupBy("source_table").agg(
        F.count("severe").alias("severe_outcomes"), F.count("fatality").alias("fatality_outcomes"),
        F.count("sample_size").alias("total_studies"))
    ints = _integers(r, ["source_table"])
    stats = ints.groupBy("source_table").agg(F.sum("n").alias("total_patients"), F.avg("n").alias("avg_sample_size"))
    med = exact_quantiles(ints, "n", {"median_sample_size": 0.5}, ["source_table"])
    return base.join(stats, "source_table", "left").join(med, "source_table", "left")


def patient_table_metrics(rows: DataFrame) -> DataFrame:
    r = _in(rows, PATIENTS)
    base = r.groupBy("source_table").agg(
        F.count("sample_size").alias("total_studies"), F.count("age").alias("studies_with_age"))
    pct = r.select("source_table", F.explode(X.all_percents(col("asymptomatic"))).alias("p"))
    stats = pct.groupBy("source_table").agg(
        F.avg("p").alias("asymptomatic_mean"), F.min("p").alias("asymptomatic_min"), F.max("p").alias("asymptomatic_max"),
        F.count("p").alias("asymptomatic_studies"))
    med = exact_quantiles(pct, "p", {"asymptomatic_median": 0.5}, ["source_table"])
    return base.join(stats, "source_table", "left").join(med, "source_table", "left")


def factor_table_metrics(rows: DataFrame) -> DataFrame:
    per_factor = rows.where(col("factors").isNotNull()).groupBy("source_table", "factors").agg(
        F.count(lit(1)).alias("n"), F.count_if(col("influential") == "Y").alias("y"), F.count_if(col("influential") == "N").alias("no"))
    return per_factor.groupBy("source_table").agg(
        F.count(lit(1)).alias("unique_factors"), F.sum("n").alias("total_factor_studies"),
        F.sum("y").alias("influential_yes"), F.sum("no").alias("influential_no"))


def diagnostic_table_metrics(rows: DataFrame, top_n: int = 10) -> DataFrame:
    """Long rows ``source_table, metric, item, n``: top methods, approval counts, accuracy presence."""
    r = _in(rows, DIAGNOSTICS)
    methods = r.where(col("detection_method").isNotNull()).groupBy("source_table", col("detection_method").alias("item")).agg(
        F.count(lit(1)).alias("n"))
    w = Window.partitionBy("source_table").orderBy(col("n").desc(), "item")
    top = methods.withColumn("_r", F.row_number().over(w)).where(col("_r") <= top_n)
    approvals = r.where(col("fda_approval").isNotNull()).groupBy("source_table", col("fda_approval").alias("item")).agg(F.count(lit(1)).alias("n"))
    acc = r.groupBy("source_table").agg(F.count("accuracy_text").alias("n"))
    return _stack([
        top.select("source_table", lit("detection_method").alias("metric"), "item", "n"),
        approvals.select("source_table", lit("fda_approval").alias("metric"), "item", "n"),
        acc.select("source_table", lit("studies_with_accuracy").alias("metric"), lit("").alias("item"), "n")])


def therapeutic_table_metrics(rows: DataFrame) -> DataFrame:
    r = _in(rows, THERAPEUTICS)
    count = lambda c: r.where(col(c).isNotNull()).groupBy("source_table", col(c).alias("item")).agg(
        F.count(lit(1)).alias("n"))
    methods = count("treatment").groupBy("source_table").agg(F.count(lit(1)).alias("n"))
    return _stack([
        count("clinical_improvement").select("source_table", lit("clinical_improvement").alias("metric"), "item", "n"),
        methods.select("source_table", lit("therapeutic_methods").alias("metric"), lit("").alias("item"), "n"),
        count("severity_of_disease").select("source_table", lit("severity_of_disease").alias("metric"), "item", "n")])


def cross_category(rows: DataFrame) -> DataFrame:
    """One row: time span, number of tables (called studies), leading study type and journal."""
    span = rows.agg(F.min("study_date").alias("earliest_study"), F.max("study_date").alias("latest_study"))
    tables = rows.select("source_category", "source_table").distinct().agg(F.count(lit(1)).alias("total_studies"))
    lead = lambda df, c, name: df.groupBy(c).agg(F.sum("n").alias("n")).agg(
        F.max_by(c, F.struct("n", c)).alias(f"top_{name}"), F.max("n").alias(f"top_{name}_count"))
    types = lead(rows.where(col("study_type").isNotNull()).groupBy("study_type").agg(F.count(lit(1)).alias("n")), "study_type", "study_type")
    journals = lead(journal_counts(rows), "journal", "journal")
    # Four one-row aggregates side by side.
    out = span.join(F.broadcast(tables)).join(F.broadcast(types)).join(F.broadcast(journals))
    return out.withColumn("time_span_days", F.datediff("latest_study", "earliest_study"))


def monthly_publications(rows: DataFrame) -> DataFrame:
    return rows.where(col("study_date").isNotNull()).groupBy(F.date_format("study_date", "yyyy-MM").alias("month")).agg(
        F.count(lit(1)).alias("studies"))


def risk_factor_table(rows: DataFrame) -> DataFrame:
    """Long rows ``section, item, n`` of the risk-factor overview, with the five largest samples."""
    r = _in(rows, RISK).withColumn("risk_factor", X.title_case(col("source_table")))
    section = lambda c, name, k: value_counts(r, c, k).select(lit(name).alias("section"), col(c).alias("item"), "n")
    samples = r.select(F.explode(X.all_patients(col("sample_size"))).alias("n"), "row_ordinal")
    top = samples.orderBy(col("n").desc(), "row_ordinal").limit(5)
    total = samples.agg(F.count(lit(1)).alias("c"), F.sum("n").alias("s"))
    return _stack([
        section("risk_factor", "studies", 15), section("severe_significant", "significance", None), section("study_type", "study_type", 8),
        top.select(lit("largest_sample").alias("section"), col("row_ordinal").cast("string").alias("item"), "n"),
        total.select(lit("samples").alias("section"), lit("count").alias("item"), col("c").alias("n")),
        total.select(lit("samples").alias("section"), lit("patients").alias("item"), col("s").alias("n"))])


def asymptomatic_rates(rows: DataFrame) -> DataFrame:
    return _in(rows, PATIENTS).select(
        "source_table", "row_ordinal", X.first_percent(col("asymptomatic")).alias("rate")).where(col("rate").isNotNull())


def outcome_histogram(rows: DataFrame, bins: int = 30, below: int = 10000) -> DataFrame:
    return histogram(_integers(_in(rows, PATIENTS, THERAPEUTICS)).where(col("n") < below), "n", bins)


def outcome_dashboard(rows: DataFrame) -> DataFrame:
    r = _in(rows, PATIENTS, THERAPEUTICS)
    imp = value_counts(_in(rows, THERAPEUTICS), "clinical_improvement").select(
        lit("improvement").alias("section"), col("clinical_improvement").alias("item"), "n")
    months = monthly_publications(r).select(lit("month").alias("section"), col("month").alias("item"), col("studies").alias("n"))
    return imp.unionByName(months)


def key_findings(rows: DataFrame) -> DataFrame:
    cats = category_summary(rows).agg(
        F.max_by("category_name", F.struct("total_records", "source_category")).alias("c"), F.max("total_records").alias("n"))
    x = cross_category(rows)
    return _stack([
        cats.select(lit("Most Researched Area").alias("finding"), col("c").alias("subject"), col("n").alias("amount")),
        x.select(lit("Dominant Study Type").alias("finding"), col("top_study_type").alias("subject"), col("top_study_type_count").alias("amount")),
        x.select(lit("Research Timeline").alias("finding"),
                 F.concat_ws(" to ", col("earliest_study").cast("string"), col("latest_study").cast("string")).alias("subject"),
                 col("time_span_days").cast("bigint").alias("amount"))])


def actionable_insights(rows: DataFrame, asof: dt.date) -> DataFrame:
    """Text rows: smallest categories, observational share, small samples, age of the newest study, leading risk factors."""
    cats = category_summary(rows).select("category_name", "total_records").orderBy("total_records", "category_name").limit(3)
    gaps = cats.select(lit("gap").alias("kind"), F.format_string(
        "Increase research focus in %s - currently only %d records", "category_name", "total_records").alias("insight"))
    t = F.lower("study_type")
    obs = (F.contains(t, lit("observational")) | F.contains(t, lit("retrospective"))).cast("int")
    design = rows.where(col("study_type").isNotNull()).agg(F.avg(obs).alias("share")).where(col("share") > 0.6).select(
        lit("design").alias("kind"),
        lit("Need more randomized controlled trials - currently dominated by observational studies").alias("insight"))
    size = _integers(rows).where(col("n") < 100000).agg(F.avg("n").alias("m")).where(col("m") < 500).select(
        lit("sample").alias("kind"), F.format_string(
            "Increase sample sizes - current average is only %.0f patients", F.bround("m", 0)).alias("insight"))
    age = rows.agg(F.datediff(lit(asof), F.max("study_date")).alias("d")).where(col("d") > 180).select(
        lit("stale").alias("kind"), F.format_string("Research may be outdated - latest study is %d days old", "d").alias("insight"))
    risk = value_counts(_in(rows, RISK).withColumn("f", X.title_case(col("source_table"))), "f", 5).select(
        lit("risk").alias("kind"), F.format_string("%s: %d studies", "f", "n").alias("insight"))
    return _stack([gaps, design, size, age, risk])


# --- insights

def risk_severity(rows: DataFrame, align: str = "row") -> DataFrame:
    """Odds ratio per study with effect size and direction. ``align='positional'`` pairs the n-th non-NULL values."""
    r = _in(rows, RISK)
    if align == "positional":
        from cohortlens.operators.joins import positional_pairs

        r = positional_pairs(r, "source_table", "row_ordinal", "severe", "severe_significant").withColumnRenamed("pos", "row_ordinal")
    o = col("odds_ratio")
    return r.where(col("severe").isNotNull() & col("severe_significant").isNotNull()).select(
        X.title_case(col("source_table")).alias("risk_factor"), "row_ordinal", X.odds_ratio(col("severe")).alias("odds_ratio"),
        col("severe_significant").alias("significant")).where(o.isNotNull()).select(
        "*", F.when(o > 2.0, "High").when(o > 1.5, "Moderate").otherwise("Low").alias("effect_size"),
        F.when(o < 1.0, "Protective").otherwise("Risk").alias("direction"))


def risk_severity_top(rows: DataFrame, top_n: int = 15) -> DataFrame:
    return risk_severity(rows).orderBy(col("odds_ratio").desc(), "row_ordinal").limit(top_n)


def risk_severity_summary(rows: DataFrame) -> DataFrame:
    s = risk_severity(rows)
    return s.agg(
        F.count(lit(1)).alias("studies"), F.count_if(col("significant") == "Significant").alias("significant"),
        F.count_if(col("direction") == "Protective").alias("protective"),
        F.max_by("risk_factor", F.struct("odds_ratio", -col("row_ordinal"))).alias("highest_factor"),
        F.max("odds_ratio").alias("highest_odds_ratio"))


def therapy_rows(rows: DataFrame) -> DataFrame:
    r = _in(rows, THERAPEUTICS).where(col("clinical_improvement").isNotNull() & col("treatment").isNotNull())
    return r.select(F.substring("treatment", 1, 50).alias("treatment"), col("clinical_improvement").alias("effective"),
                    F.coalesce(X.patients(col("sample_size")), lit(0)).alias("patients"))


def therapy_rates(rows: DataFrame, min_studies: int = 2, top_n: int = 10) -> DataFrame:
    g = therapy_rows(rows).groupBy("treatment").agg(
        F.count("effective").alias("studies"), F.count_if(col("effective") == "Y").alias("effective_studies"))
    g = g.where(col("studies") >= min_studies).withColumn("rate", col("effective_studies") / col("studies"))
    return g.orderBy(col("rate").desc(), "treatment").limit(top_n)


def therapy_summary(rows: DataFrame) -> DataFrame:
    e = col("effective")
    return therapy_rows(rows).agg(
        F.count(lit(1)).alias("studies"), F.count_if(e == "Y").alias("effective_studies"),
        (F.count_if(e == "Y") / F.count(lit(1)) * 100).alias("overall_rate"),
        F.avg(F.when(e == "Y", col("patients"))).alias("mean_patients_effective"),
        F.avg(F.when(e == "N", col("patients"))).alias("mean_patients_ineffective"))


def diagnostic_accuracy(rows: DataFrame) -> DataFrame:
    return _in(rows, DIAGNOSTICS).select(
        "row_ordinal", X.title_case(col("source_table")).alias("test_type"), "detection_method",
        X.sensitivity(col("accuracy_text")).alias("sensitivity"), X.specificity(col("accuracy_text")).alias("specificity"),
        "fda_approval")


def diagnostic_summary(rows: DataFrame) -> DataFrame:
    d = diagnostic_accuracy(rows)
    both = col("sensitivity").isNotNull() & col("specificity").isNotNull()
    combined = (col("sensitivity") + col("specificity")) / 2
    best = F.struct(combined, -col("row_ordinal"))
    return d.agg(
        F.count(lit(1)).alias("tests"),
        F.avg(F.when(both, col("sensitivity"))).alias("mean_sensitivity"), F.avg(F.when(both, col("specificity"))).alias("mean_specificity"),
        F.max_by("test_type", F.when(both, best)).alias("best_test"), F.max(F.when(both, combined)).alias("best_accuracy"),
        (F.count_if(col("fda_approval") == "Y") / F.count("fda_approval") * 100).alias("approval_rate"))


def vulnerability(rows: DataFrame) -> DataFrame:
    """Risk level rows: every age ratio, and the first ratio of each named comorbidity and demographic factor.

    Table names are title-cased before the lookup, so the name ``COPD`` never matches.
    """
    r = _in(rows, RISK).select(X.title_case(col("source_table")).alias("factor"), "row_ordinal",
                               X.odds_ratio(col("severe")).alias("risk_level")).where(col("risk_level").isNotNull())
    age = r.where(col("factor") == "Age").select("factor", "risk_level", lit("Demographic").alias("category"))
    first = r.where(col("factor").isin(*COMORBIDITIES, *DEMOGRAPHICS)).groupBy("factor").agg(
        F.min_by("risk_level", "row_ordinal").alias("risk_level"))
    named = first.select(
        F.replace("factor", lit(" Vs "), lit(" vs ")).alias("factor"), "risk_level",
        F.when(col("factor").isin(*COMORBIDITIES), "Comorbidity").otherwise("Demographic").alias("category"))
    v = col("risk_level")
    return age.unionByName(named).withColumn(
        "band", F.when(v > 2.0, "Priority").when(v > 1.5, "High").when(v > 1.2, "Moderate").otherwise("Low"))


def vulnerability_summary(rows: DataFrame) -> DataFrame:
    v = col("risk_level")
    return vulnerability(rows).agg(
        F.count_if(v > 1.5).alias("high_risk"), F.count_if((v > 1.2) & (v <= 1.5)).alias("moderate_risk"),
        F.avg(F.when(col("category") == "Comorbidity", v)).alias("comorbidity_mean"),
        F.avg(F.when(col("category") == "Demographic", v)).alias("demographic_mean"), F.max(v).alias("highest"))


def study_profile(rows: DataFrame) -> DataFrame:
    """Counts of study rows at four grains from one scan, written once: what the one-row summaries need.

    ``grain`` is ``table`` (per category and table: rows, filled cells ``has_<column>``, significant hits, case studies, sum and
    number of sample sizes), ``type`` (per study type), ``day`` (per study date) or ``value`` (per number in a sample size);
    ``c`` counts. Each row is expanded once per grain without its texts and combined before the shuffle, so what is
    shuffled and written is distinct keys, not rows.
    """
    cells = list(dict.fromkeys((*REPORTING, *OUTCOMES, "severe_significant", "clinical_improvement")))
    ints, t = X.all_integers(col("sample_size")), F.lower("study_type")
    grain = lambda name, **keys: F.struct(lit(name).alias("grain"), *[keys.get(k, lit(None)).cast(kind).alias(k) for k, kind in (
        ("source_category", "string"), ("source_table", "string"), ("type", "string"), ("day", "date"), ("n", "bigint"))])
    grains = F.concat(
        F.array(grain("table", source_category=col("source_category"), source_table=col("source_table"))),
        F.filter(F.array(grain("type", type=col("study_type"))), lambda g: g["type"].isNotNull()),
        F.filter(F.array(grain("day", day=col("study_date"))), lambda g: g["day"].isNotNull()),
        F.transform(F.coalesce(ints, F.array().cast("array<bigint>")), lambda n: grain("value", n=n)))
    # Flags as 0 or 1, so that texts are not copied for every grain.
    flags = {f"has_{c}": col(c).isNotNull().cast("int") for c in cells}
    flags["hits"] = F.coalesce(F.contains(F.lower("severe_significant"), lit("significant")), lit(False)).cast("int")
    flags["case_study"] = F.coalesce(F.contains(t, lit("case report")) | F.contains(t, lit("case series")), lit(False)).cast("int")
    flags["n_total"] = F.coalesce(F.aggregate(ints, lit(0).cast("bigint"), lambda x, y: x + y), lit(0))
    flags["n_count"] = F.coalesce(F.size(ints), lit(0))
    flat = rows.select(grains.alias("g"), *[c.alias(n) for n, c in flags.items()]).select(F.explode("g").alias("g"), *flags).select("g.*", *flags)
    of_table = col("grain") == "table"
    return stored(flat.groupBy("grain", "source_category", "source_table", "type", "day", "n").agg(
        F.count(lit(1)).alias("c"), *[F.sum(F.when(of_table, col(f))).alias(f) for f in flags]), "study-profile")


def _of(profile: DataFrame, grain: str) -> DataFrame:
    return profile.where(col("grain") == grain)


def research_quality(rows: DataFrame) -> DataFrame:
    """One row with the four parts of the evidence score (each at most 5), their mean and band. The rows are scanned once."""
    p = study_profile(_in(rows, RISK, THERAPEUTICS, DIAGNOSTICS, PATIENTS))
    n, c = col("n"), col("c")
    share = lambda cond: F.sum(F.when(cond, c).otherwise(0)) / F.sum("c") * 100
    sizes = _of(p, "value").where((n >= 10) & (n <= 100000))
    ints = sizes.agg(
        F.coalesce(F.sum("c"), lit(0)).alias("sample_studies"), (F.sum(n * c) / F.sum("c")).alias("mean_sample_size"),
        share(n < 100).alias("small_studies_pct"), share(n > 1000).alias("large_studies_pct"), share(n > 400).alias("adequate_power_pct"))
    med = exact_quantiles(sizes, "n", {"median_sample_size": 0.5}, weight="c")
    t = F.lower("type")
    high = F.contains(t, lit("randomized")) | F.contains(t, lit("meta-analysis")) | F.contains(t, lit("systematic"))
    types = _of(p, "type").agg(
        (F.sum(X.ordered_score(col("type"), EVIDENCE) * c) / F.sum("c")).alias("avg_quality_score"), share(high).alias("high_quality_pct"))
    # The share of recent studies needs the newest day.
    days = _of(p, "day")
    newest = days.agg(F.max("day").alias("hi"), F.min("day").alias("lo"))
    when = days.join(F.broadcast(newest)).agg(
        F.max(F.datediff("hi", "lo")).alias("time_span_days"),
        (F.sum("c") / F.greatest(lit(1), F.max(F.datediff("hi", "lo"))) * 30).alias("studies_per_month"),
        share(F.datediff("hi", "day") <= 365).alias("recent_studies_pct"))
    # A table with a significance column gives those values; a table without one gives its improvement rows.
    sig = col("has_severe_significant")
    used = F.when(sig > 0, sig).otherwise(col("has_clinical_improvement"))
    rigor = _of(p, "table").agg(
        F.sum(used).alias("studies_with_stats"), (F.sum("hits") / F.sum(used) * 100).alias("significant_findings_pct"),
        (F.sum(used) / F.count(lit(1)) * 100).alias("statistical_testing_rate"))
    out = ints.join(F.broadcast(med)).join(F.broadcast(types)).join(F.broadcast(when)).join(F.broadcast(rigor))
    five = lambda x: F.least(lit(5.0), col(x) / 20)
    score = (five("adequate_power_pct") + col("avg_quality_score") + five("recent_studies_pct") + five("statistical_testing_rate")) / 4
    return out.withColumn("overall_score", score).withColumn(
        "quality_level", F.when(score >= 4, "EXCELLENT").when(score >= 3, "GOOD").when(score >= 2, "MODERATE").otherwise("NEEDS IMPROVEMENT"))


# --- meta-analysis

def treatment_meta_rows(rows: DataFrame) -> DataFrame:
    size = F.coalesce(X.first_integer(col("sample_size")), lit(0))
    return _in(rows, THERAPEUTICS).where(col("clinical_improvement").isNotNull()).select(
        F.substring(F.coalesce("treatment", lit("Unknown")), 1, 30).alias("treatment"),
        X.yes_flag(col("clinical_improvement")).cast("int").alias("improvement"), size.alias("patients")).where(col("patients") > 0)


def _rate_summary(df: DataFrame, key: str, flag: str) -> DataFrame:
    return df.groupBy(key).agg(
        F.sum(flag).alias("positive"), F.count(flag).alias("studies"), F.bround(F.avg(flag), 3).alias("rate"),
        F.sum("patients").alias("patients"))


def treatment_meta(rows: DataFrame) -> DataFrame:
    return _rate_summary(treatment_meta_rows(rows), "treatment", "improvement")


def treatment_meta_overall(rows: DataFrame, min_studies: int = 3) -> DataFrame:
    return treatment_meta_rows(rows).agg(
        F.count(lit(1)).alias("total_studies"), F.avg("improvement").alias("overall_effectiveness"),
        F.sum("patients").alias("total_patients")).where(col("total_studies") >= min_studies)


def risk_meta_rows(rows: DataFrame) -> DataFrame:
    size = F.coalesce(X.first_integer(col("sample_size")), lit(0))
    return _in(rows, RISK).where(col("severe_significant").isNotNull()).select(
        X.title_case(col("source_table")).alias("risk_factor"),
        X.yes_flag(col("severe_significant")).cast("int").alias("significant"), size.alias("patients")).where(col("patients") > 0)


def risk_meta(rows: DataFrame, top_n: int = 5) -> DataFrame:
    return _rate_summary(risk_meta_rows(rows), "risk_factor", "significant").orderBy(col("rate").desc(), "risk_factor").limit(top_n)


def diagnostic_meta_rows(rows: DataFrame) -> DataFrame:
    return _in(rows, DIAGNOSTICS).select(
        col("source_table").alias("diagnostic_type"), X.first_percent(col("accuracy_text")).alias("accuracy")).where(col("accuracy").isNotNull())


def diagnostic_meta(rows: DataFrame, top_n: int = 5) -> DataFrame:
    g = diagnostic_meta_rows(rows).groupBy("diagnostic_type").agg(
        F.bround(F.avg("accuracy"), 2).alias("mean_accuracy"), F.bround(F.stddev_samp("accuracy"), 2).alias("std_accuracy"),
        F.count(lit(1)).alias("studies"))
    return g.orderBy(col("mean_accuracy").desc(), "diagnostic_type").limit(top_n)


def meta_scalars(rows: DataFrame) -> DataFrame:
    t = treatment_meta_overall(rows).select("overall_effectiveness", "total_studies", "total_patients")
    r = risk_meta_rows(rows).agg(F.avg("significant").alias("significance_rate"), F.count(lit(1)).alias("risk_studies"))
    d = diagnostic_meta_rows(rows).agg(F.avg("accuracy").alias("diagnostic_accuracy"), F.count(lit(1)).alias("diagnostic_studies"))
    return t.join(F.broadcast(r)).join(F.broadcast(d))


FIGURES = "severe_accuracy double, gaps long, gap_areas long, clusters int, silhouette double"


def model_figures(spark: SparkSession, scores: DataFrame | None = None, gaps: DataFrame | None = None, source: str = "source_table",
                  scan: DataFrame | None = None) -> DataFrame:
    """One row of what models, gap search and clustering found, for :func:`recommendations`; NULL for what was not run.

    ``scores`` are those of the severe-outcome models (the best one counts), ``gaps`` the rows of ``text.research_gaps`` with
    the column ``source`` (ten sources at most are reported as areas), ``scan`` the table of ``learning.kmeans_scan``.
    """
    none = lambda schema: spark.createDataFrame([], schema)
    s = (none("is_best boolean, score double") if scores is None else scores).agg(F.max(F.when(col("is_best"), col("score"))).alias("severe_accuracy"))
    g = none(f"`{source}` string") if gaps is None else gaps
    # Sources are reduced to one row each before they are counted.
    per = g.groupBy(source).agg(F.count(lit(1)).alias("n")).agg(
        F.sum("n").alias("gaps"), F.least(F.count(source), lit(10)).alias("gap_areas"))
    k = (none("k int, chosen boolean, silhouette double") if scan is None else scan).agg(
        F.max(F.when(col("chosen"), col("k"))).alias("clusters"), F.max(F.when(col("chosen"), col("silhouette"))).alias("silhouette"))
    return s.join(F.broadcast(per)).join(F.broadcast(k))


def recommendations(rows: DataFrame, figures: DataFrame | None = None) -> DataFrame:
    """Rules over the meta-analysis scalars and, where given, the one row of :func:`model_figures`."""
    found = rows.sparkSession.createDataFrame([(None,) * 5], FIGURES) if figures is None else figures
    s = meta_scalars(rows).join(F.broadcast(found))
    pct = lambda c: F.format_string("%.1f%%", col(c) * 100)
    # Condition, priority, category, and the texts of recommendation and evidence.
    rules = [
        (col("overall_effectiveness") < 0.6, "HIGH", "Treatment Optimization",
         lit("Current treatment effectiveness is below 60%. Consider combination therapies and personalized medicine approaches."),
         F.concat(lit("Meta-analysis of "), col("total_studies"), lit(" studies shows "), pct("overall_effectiveness"), lit(" effectiveness"))),
        (col("total_studies").isNotNull(), "MEDIUM", "Treatment Monitoring",
         lit("Implement real-time treatment response monitoring using AI-powered predictive models."),
         F.concat(lit("Analysis of "), col("total_patients"), lit(" patients across multiple studies"))),
        (col("severe_accuracy").isNotNull(), "HIGH", "Risk-Based Treatment",
         lit("Use AI risk prediction models to stratify patients and personalize treatment intensity."),
         F.concat(lit("ML model achieved "), pct("severe_accuracy"), lit(" accuracy in predicting severe outcomes"))),
        (col("gaps").isNotNull(), "HIGH", "Research Gap Closure",
         F.concat(lit("Address "), col("gaps"), lit(" identified research gaps through targeted funding.")),
         F.concat(lit("NLP analysis identified specific knowledge gaps across "), col("gap_areas"), lit(" research areas"))),
        (col("clusters").isNotNull(), "MEDIUM", "Patient Subgroup Research",
         F.concat(lit("Focus research on "), col("clusters"), lit(" distinct patient phenotypes identified through ML clustering.")),
         F.concat(lit("Clustering analysis revealed "), col("clusters"), lit(" patient subgroups with silhouette score "), F.format_string("%.2f", "silhouette"))),
        (col("risk_studies") >= 3, "HIGH", "Risk Assessment Protocol",
         F.concat(lit("Implement standardized risk assessment using the "), pct("significance_rate"), lit(" significant risk factors identified.")),
         F.concat(lit("Meta-analysis of "), col("risk_studies"), lit(" studies on risk factors"))),
        ((col("diagnostic_studies") >= 3) & (col("diagnostic_accuracy") < 90), "HIGH", "Diagnostic Improvement",
         F.format_string("Current diagnostic accuracy at %.1f%% needs improvement through AI-enhanced diagnostics.", "diagnostic_accuracy"),
         lit("Meta-analysis of diagnostic studies")),
    ]
    made = F.array(*[F.when(c, F.struct(lit(p).alias("priority"), lit(k).alias("category"), r.alias("recommendation"), e.alias("evidence")))
                     for c, p, k, r, e in rules])
    out = s.select(F.explode(F.filter(made, lambda x: x.isNotNull())).alias("r")).select("r.*")
    return out.withColumn("timeline", F.when(col("priority") == "HIGH", "immediate").when(col("priority") == "MEDIUM", "short_term")
                          .otherwise("long_term"))


def priority_counts(recs: DataFrame) -> DataFrame:
    return recs.groupBy("priority", "timeline").agg(F.count(lit(1)).alias("n"))


def findings_report(rows: DataFrame, recs: DataFrame) -> DataFrame:
    eff = treatment_meta_overall(rows).select(F.concat(
        lit("Meta-analysis shows "), F.format_string("%.1f%%", col("overall_effectiveness") * 100),
        lit(" overall treatment effectiveness across studies")).alias("finding"))
    n = recs.agg(F.count(lit(1)).alias("n")).select(F.concat(
        lit("Generated "), col("n"), lit(" AI-powered actionable recommendations across multiple categories")).alias("finding"))
    return eff.unionByName(n)


# --- study quality

def letter(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")


def _capped(score: Column) -> Column:
    """A score kept within 0 and 100; NULL where there is nothing to score."""
    return F.when(score.isNotNull(), F.greatest(lit(0.0), F.least(lit(100.0), score)))


def power(n: Column) -> Column:
    """Estimated power of a study of ``n`` patients."""
    return F.when(n >= 64, 0.8).when(n >= 26, 0.5 + (n - 26) * (0.3 / 38)).otherwise(F.greatest(lit(0.2), n * 0.5 / 26))


def sample_adequacy(rows: DataFrame) -> DataFrame:
    d = _integers(rows).where(col("n") < 100000)
    n, p = col("n"), power(col("n"))
    out = d.agg(
        F.count(lit(1)).alias("total_studies"), F.avg("n").alias("mean_sample_size"), F.stddev_pop("n").alias("std_sample_size"),
        F.count_if(n < 50).alias("small_studies"), F.count_if((n >= 100) & (n < 500)).alias("adequate_studies"),
        F.count_if(n >= 500).alias("large_studies"), F.avg(p).alias("mean_power"), F.count_if(p >= 0.8).alias("studies_with_power"),
        F.count_if(p < 0.5).alias("underpowered_studies"))
    score = _capped((col("adequate_studies") + col("large_studies")) / F.nullif(col("total_studies"), lit(0)) * 100)
    med = exact_quantiles(d, "n", {"median_sample_size": 0.5})
    return out.join(F.broadcast(med)).withColumn("quality_score", score).withColumn("quality_grade", letter(col("quality_score")))


def study_power(rows: DataFrame) -> DataFrame:
    return _integers(rows, ["row_ordinal"]).where(col("n") < 100000).select("row_ordinal", "n", power(col("n")).alias("power"))


def design_quality(rows: DataFrame) -> DataFrame:
    s = X.ordered_score(col("study_type"), DESIGNS, default=1)
    out = rows.where(col("study_type").isNotNull()).agg(
        F.count(lit(1)).alias("total_studies"), F.avg(s).alias("mean_design_score"), F.count_if(s >= 4).alias("high_quality_studies"),
        F.count_if(s <= 2).alias("low_quality_studies"))
    return out.withColumn("quality_score", col("mean_design_score") / 5 * 100).withColumn("quality_grade", letter(col("quality_score")))


def reporting_by_table(rows: DataFrame) -> DataFrame:
    """Per table: share of the reporting columns it has and how full they are. A column with no value counts as absent."""
    n = F.count(lit(1))
    fills = [F.count(c) / n for c in REPORTING]
    present, total = lit(0), lit(0.0)
    for f in fills:
        present, total = present + (f > 0).cast("int"), total + f
    g = rows.groupBy("source_category", "source_table").agg(present.alias("p"), total.alias("t"))
    return g.select("source_category", "source_table", F.when(
        col("p") > 0, (col("p") / len(REPORTING) + col("t") / col("p")) / 2).otherwise(0.0).alias("completeness"))


def reporting_quality(rows: DataFrame) -> DataFrame:
    c = col("completeness")
    per = reporting_by_table(rows)
    out = per.agg(F.avg(c).alias("mean_completeness"), F.count_if(c >= 0.8).alias("complete_tables"), F.count_if(c < 0.5).alias("incomplete_tables"))
    med = exact_quantiles(per, "completeness", {"median_completeness": 0.5})
    return out.join(F.broadcast(med)).withColumn("quality_score", col("mean_completeness") * 100).withColumn(
        "quality_grade", letter(col("quality_score")))


def bias_by_table(rows: DataFrame) -> DataFrame:
    n = F.count(lit(1))
    miss, seen = lit(0.0), lit(0)
    for c in OUTCOMES:
        has = F.count(c) > 0
        miss, seen = miss + F.when(has, 1 - F.count(c) / n).otherwise(0.0), seen + has.cast("int")
    ints = X.all_integers(col("sample_size"))
    total = F.sum(F.aggregate(ints, lit(0).cast("bigint"), lambda a, x: a + x))
    count = F.sum(F.when(col("sample_size").isNotNull(), F.size(ints)))
    t = F.lower("study_type")
    case = F.max((F.contains(t, lit("case report")) | F.contains(t, lit("case series"))).cast("int"))
    g = rows.groupBy("source_category", "source_table").agg(
        F.when(total / F.nullif(count, lit(0)) < 50, 2).otherwise(0).alias("small"), F.when(seen > 0, miss / seen * 3).otherwise(0.0).alias("missing"),
        F.coalesce(case, lit(0)).alias("case_study"))
    return g.select("source_category", "source_table", (col("small") + col("missing") + col("case_study")).cast("double").alias("bias_score"))


def bias_quality(rows: DataFrame) -> DataFrame:
    b = col("bias_score")
    out = bias_by_table(rows).agg(F.avg(b).alias("mean_bias_score"), F.count_if(b <= 1).alias("low_bias"), F.count_if(b >= 3).alias("high_bias"))
    return out.withColumn("quality_score", _capped(100 - col("mean_bias_score") * 20)).withColumn(
        "quality_grade", letter(col("quality_score")))


def dimension_scores(profile: DataFrame) -> DataFrame:
    """``dimension, quality_score`` from a :func:`study_profile`: the scores of :func:`sample_adequacy`, :func:`design_quality`,
    :func:`reporting_quality` and :func:`bias_quality`."""
    n, c = col("n"), col("c")
    fills = [col(f"has_{x}") / c for x in REPORTING]
    present, total = lit(0), lit(0.0)
    for f in fills:
        present, total = present + (f > 0).cast("int"), total + f
    complete = F.when(present > 0, (present / len(REPORTING) + total / present) / 2).otherwise(0.0)
    miss, seen = lit(0.0), lit(0)
    for x in OUTCOMES:
        has = col(f"has_{x}") > 0
        miss, seen = miss + F.when(has, 1 - col(f"has_{x}") / c).otherwise(0.0), seen + has.cast("int")
    bias = (F.when(col("n_total") / F.nullif(col("n_count"), lit(0)) < 50, 2).otherwise(0) + F.when(seen > 0, miss / seen * 3).otherwise(0.0)
            + F.least(col("case_study"), lit(1)))
    at = lambda grain, e: F.when(col("grain") == grain, e)
    small = at("value", F.when(n < 100000, c))
    s = profile.agg(
        _capped(F.sum(F.when(n >= 100, small).otherwise(at("value", lit(0)))) / F.sum(small) * 100).alias("sample_size"),
        (F.sum(at("type", X.ordered_score(col("type"), DESIGNS, default=1) * c)) / F.sum(at("type", c)) / 5 * 100).alias("study_design"),
        (F.avg(at("table", complete)) * 100).alias("reporting"),
        _capped(100 - F.avg(at("table", bias)) * 20).alias("bias_risk"))
    return s.select([col(x).cast("double").alias(x) for x in s.columns]).unpivot([], s.columns, "dimension", "quality_score")


def overall_study_quality(rows: DataFrame) -> DataFrame:
    """One row per dimension with its score, the weighted overall score, grade, and advice where the score is under 70."""
    # Advice per dimension.
    advice = {
        "sample_size": ("HIGH", "Increase sample sizes to improve statistical power"),
        "study_design": ("HIGH", "Improve study design quality"),
        "reporting": ("MEDIUM", "Improve reporting completeness"),
        "bias_risk": ("HIGH", "Implement bias reduction measures"),
    }
    # Reading of the overall score.
    reading = ((90, "Excellent quality with minimal limitations"), (80, "Good quality with minor limitations"),
               (70, "Acceptable quality with some limitations"), (60, "Fair quality with notable limitations"))
    long = dimension_scores(study_profile(rows))
    overall = long.agg((F.sum(col("quality_score") * F.element_at(X.const_map(dict(DIMENSION_WEIGHTS)), col("dimension")))
                        / F.sum(F.element_at(X.const_map(dict(DIMENSION_WEIGHTS)), col("dimension")))).alias("overall_score"))
    text = None
    for limit, words in reading:
        text = F.when(col("overall_score") >= limit, words) if text is None else text.when(col("overall_score") >= limit, words)
    low = col("quality_score") < 70
    return long.join(F.broadcast(overall)).select(
        "dimension", "quality_score", "overall_score", letter(col("overall_score")).alias("grade"),
        text.otherwise("Poor quality with significant limitations").alias("interpretation"),
        F.when(low, F.element_at(X.const_map({k: v[0] for k, v in advice.items()}), col("dimension"))).alias("priority"),
        F.when(low, F.element_at(X.const_map({k: v[1] for k, v in advice.items()}), col("dimension"))).alias("recommendation"))
