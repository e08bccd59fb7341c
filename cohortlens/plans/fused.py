"""Standard rules fused into passes: rules that look at the same rows share a scan, a shuffle and a join.

1. ``name``, ``temporal``: both are judged on each provider where it is read; nothing is shuffled.
2. ``npi``, ``contact``: each provider goes out once by its NPI and once by its e-mail, keyed by (kind, value), with the
   columns of that rule only. Counts of the shared values of both kinds come from one aggregate and meet the rows in one join.
3. ``affiliation``, ``cross reference``: both keys of the affiliations are counted together, with the statistics of the
   provider's; one full join with the entities gives the matched ones (anomalies) and the unmatched ones (orphans).

The third pass serves runs without row limits only: the affiliation rule's limit asks for an order of its hits alone. A rule
that is the only one asked for of its pass is planned on its own. Each row comes out in the runner's common schema.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Set

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.predicates import is_blank
from cohortlens.operators import rules as R

col, lit = F.col, F.lit

LONG_COLUMNS = ("rule_name", "entity_id", "provider_id", "facility_id", "issue_description", "severity", "details")


def long_row(out: Mapping[str, Column]) -> Column:
    """A provider rule's columns as one struct in the common schema."""
    rest = [c.alias(n) for n, c in out.items() if n not in LONG_COLUMNS]
    provider = out["provider_id"].cast("string")
    parts = (out["rule_name"], provider, provider, lit(None).cast("string"), out["issue_description"], out["severity"], F.to_json(F.struct(*rest)))
    return F.struct(*[c.alias(n) for n, c in zip(LONG_COLUMNS, parts, strict=True)])


def judged(rule: R.RowRule) -> Column:
    """The struct of a row that the rule reports, else NULL."""
    when, out = rule
    return F.when(when, long_row(out))


def provider_rows(tables: R.Tables, asof: dt.date) -> DataFrame:
    found = F.array(judged(R.name_rule()), judged(R.temporal_rule("standard", asof)))
    return tables["providers"].select(F.inline(found)).where(col("rule_name").isNotNull())


def shared_values(tables: R.Tables, asof: dt.date) -> DataFrame:
    p = tables["providers"]
    by = lambda kind, value, phone: F.struct(
        lit(kind).alias("kind"), value.cast("string").alias("value"), phone.cast("string").alias("phone_number"))
    keys = F.array(by("npi", col("npi_number"), lit(None)), by("email", F.when(~is_blank(col("email")), col("email")), col("phone_number")))
    rows = p.select("provider_id", "full_name", F.inline(keys)).where(col("value").isNotNull())
    counts = rows.groupBy("kind", "value").agg(F.count(lit(1)).alias("duplicate_count")).where(col("duplicate_count") > 1)
    met = rows.join(counts, ["kind", "value"], "left").withColumns({"npi_number": col("value"), "email": col("value")})
    npi = col("kind") == "npi"
    return met.select(F.when(npi, judged(R.npi_rule())).otherwise(judged(R.contact_rule())).alias("v")).where(col("v").isNotNull()).select("v.*")


def links(tables: R.Tables, asof: dt.date) -> DataFrame:
    met = R.linked_entities(tables, stats=True)
    provider = col("side") == "provider"
    anomaly = R.affiliation_rule()
    matched = col("checked").isNotNull() & col("uses").isNotNull()
    orphan = col("checked").isNull() | (col("uses").isNull() & col("checked"))
    kind, name = R.orphan_kind(), R.orphan_name()
    entity = F.coalesce("entity_id", lit("unknown"))
    missing = F.struct(*[c.alias(n) for n, c in zip(LONG_COLUMNS, (
        lit("cross_reference_integrity"), entity, F.when(provider, entity), F.when(~provider, entity), lit(R.ORPHAN), lit("HIGH"),
        F.to_json(F.struct(kind.alias("entity_type"), name.alias("entity_name")))), strict=True)])
    named = met.withColumns({"provider_id": col("entity_id"), "full_name": col("name")})
    v = F.when(orphan, missing).when(matched & provider, judged(anomaly))
    out = named.select(v.alias("v"), F.when(orphan, F.coalesce("uses", lit(1))).otherwise(lit(1)).alias("times")).where(col("v").isNotNull())
    return R.repeated(out, "times").select("v.*")


PASSES = (
    ({"provider_name_inconsistency", "temporal_consistency"}, provider_rows),
    ({"npi_validation", "contact_validation"}, shared_values),
    ({"affiliation_anomaly", "cross_reference_integrity"}, links),
)


def passes(tables: R.Tables, asof: dt.date, wanted: Set[str], limits: bool) -> tuple[DataFrame | None, set[str]]:
    """Violations of the passes whose rules are all wanted, and the names of these rules. A pass that cannot be planned is left out."""
    out, done = None, set()
    for names, build in PASSES:
        if not names <= wanted or (build is links and limits):
            continue
        try:
            part = build(tables, asof)
        except (AnalysisException, KeyError):
            continue
        out = part if out is None else out.unionByName(part)
        done |= names
    return out, done
