"""Treatment recommendation from interaction rows ``patient_id, treatment, outcome, severity_score, age_group``."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.extract import severity_from_text, yes_flag
from cohortlens.session import cut_lineage

col, lit = F.col, F.lit

# Example profiles (severity, age group, comorbidities).
PROFILES = (("profile_0", 4, "elderly", 3), ("profile_1", 2, "young", 0), ("profile_2", 3, "middle", 1))


def interactions_from_rows(rows: DataFrame) -> DataFrame:
    """Interaction rows from therapy study rows."""
    return rows.select(
        F.concat(lit("patient_"), col("row_ordinal")).alias("patient_id"),
        F.coalesce(F.substring("treatment", 1, 50), lit("unknown")).alias("treatment"),
        F.coalesce(yes_flag(col("clinical_improvement")).cast("int"), lit(0)).alias("outcome"),
        severity_from_text(F.coalesce("severity_of_disease", lit("unknown"))).alias("severity_score"))


def success_rates(inter: DataFrame, k: int | None = 5) -> DataFrame:
    out = inter.groupBy("treatment").agg(F.bround(F.avg("outcome"), 3).alias("mean_outcome"), F.count("outcome").alias("n"))
    return out if k is None else out.orderBy(col("mean_outcome").desc(), "treatment").limit(k)


def patient_features(inter: DataFrame, groups: Sequence[str] = ("elderly", "middle", "young")) -> DataFrame:
    return inter.groupBy("patient_id").agg(
        F.avg("severity_score").alias("severity_score"), *[F.avg((col("age_group") == g).cast("int")).alias(f"age_{g}") for g in groups])


def effectiveness(inter: DataFrame) -> DataFrame:
    """Mean outcome per treatment overall, by severity and by age group, in long form ``treatment, facet, value, score, n``."""
    g = inter.groupBy("treatment", "severity_score", "age_group").agg(F.sum("outcome").alias("s"), F.count("outcome").alias("n"))
    long = g.select("treatment", F.explode(F.array(
        F.struct(lit("overall").alias("facet"), lit("all").alias("value")),
        F.struct(lit("severity").alias("facet"), col("severity_score").cast("string").alias("value")),
        F.struct(lit("age_group").alias("facet"), col("age_group").alias("value")))).alias("f"), "s", "n")
    return long.groupBy("treatment", "f.facet", "f.value").agg((F.sum("s") / F.sum("n")).alias("score"), F.sum("n").alias("n"))


def best_treatment(inter: DataFrame) -> DataFrame:
    e = effectiveness(inter).where(col("facet") == "overall")
    return e.orderBy(col("score").desc(), "treatment").limit(1).select("treatment", "score", "n")


def hybrid(inter: DataFrame, top_n: int = 3, collab_weight: float = 0.6) -> DataFrame:
    e = effectiveness(inter).where(col("facet") == "overall").select("treatment", col("score").alias("content_score"))
    c = success_rates(inter, None)
    return c.join(e, "treatment").select(
        "treatment", (col("mean_outcome") * collab_weight + col("content_score") * (1 - collab_weight)).alias("hybrid_score"),
        col("mean_outcome").alias("collab_score"), "content_score", "n").orderBy(col("hybrid_score").desc(), "treatment").limit(top_n)


def score_profiles(inter: DataFrame, profiles: Sequence[tuple] = PROFILES, top_n: int = 3) -> DataFrame:
    """Best treatments for given profiles: mean of the severity and age effects, each falling back to the overall one."""
    e = effectiveness(inter)
    spark = inter.sparkSession
    p = spark.createDataFrame([(r[0], str(r[1]), r[2]) for r in profiles], "profile string, severity string, age string")
    wide = e.groupBy("treatment").agg(
        F.max(F.when(col("facet") == "overall", col("score"))).alias("overall"),
        F.map_from_entries(F.collect_list(F.when(col("facet") == "severity", F.struct("value", "score")))).alias("sev"),
        F.map_from_entries(F.collect_list(F.when(col("facet") == "age_group", F.struct("value", "score")))).alias("age_map"))
    # The profiles are a handful of given rows; each is scored against every treatment.
    scored = wide.join(F.broadcast(p)).select("profile", "treatment", (
        (F.coalesce(F.try_element_at("sev", col("severity")), col("overall")) + F.coalesce(F.try_element_at("age_map", col("age")), col("overall"))) / 2).alias("score"))
    w = Window.partitionBy("profile").orderBy(col("score").desc(), "treatment")
    return scored.withColumn("rank", F.row_number().over(w)).where(col("rank") <= top_n)


def treatments(inter: DataFrame) -> list[str]:
    """The distinct treatments in order. They become vector components, so more than ``spark.sql.pivotMaxValues`` are an
    error, as for a pivot; none is dropped."""
    limit = int(inter.sparkSession.conf.get("spark.sql.pivotMaxValues", "10000"))
    found = [r[0] for r in inter.where(col("treatment").isNotNull()).select("treatment").distinct().orderBy("treatment").limit(limit + 1).collect()]
    if len(found) > limit:
        raise ValueError(f"more than {limit} treatments; raise spark.sql.pivotMaxValues or group them first")
    return found


def directions(inter: DataFrame, items: Sequence[str] | None = None) -> DataFrame:
    """``patient_id, u``: mean outcome per treatment as a unit vector, items in the given order (by default all treatments
    of the data). Patients without any mean other than 0 have no direction and are left out."""
    items = treatments(inter) if items is None else list(items)
    if not items:
        return inter.select("patient_id", F.array().cast("array<double>").alias("u")).limit(0)
    place = F.array_position(lit(items), col("treatment")).cast("int") - 1
    means = inter.where(col("treatment").isin(*items)).groupBy("patient_id", place.alias("i")).agg(F.avg("outcome").alias("m")).where(col("m") != 0)
    per = means.groupBy("patient_id").agg(F.map_from_entries(F.collect_list(F.struct("i", "m"))).alias("v"))
    dense = F.transform(F.sequence(lit(0), lit(len(items) - 1)), lambda i: F.coalesce(F.try_element_at("v", i), lit(0.0)))
    norm = F.sqrt(F.aggregate("d", lit(0.0), lambda a, x: a + x * x))
    return per.select("patient_id", dense.alias("d")).select("patient_id", F.transform("d", lambda x: x / norm).alias("u"))


ROOT = "r"
SLABS = 16  # parts into which a round cuts a cell that is too large
SLACK = 1e-8  # squared distance that covers similarities which are equal after rounding


def _boxes(members: DataFrame) -> DataFrame:
    """``cell, lo, hi, n, axis, diameter`` (squared) from ``cell, u``: minimum and maximum by component, combined before the shuffle."""
    sides = members.select("cell", F.posexplode("u").alias("axis", "x")).groupBy("cell", "axis").agg(
        F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(lit(1)).alias("n"))
    b = sides.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("axis", "lo", "hi"))).alias("b"), F.max("n").alias("n"),
                                  F.max_by("axis", F.struct(col("hi") - col("lo"), -col("axis"))).alias("axis"))
    return b.select("cell", col("b.lo").alias("lo"), col("b.hi").alias("hi"), "n", "axis",
                    F.aggregate("b", lit(0.0), lambda a, x: a + (x["hi"] - x["lo"]) * (x["hi"] - x["lo"])).alias("diameter"))


def cells(vectors: DataFrame, cell_rows: int) -> tuple[DataFrame, list[DataFrame]]:
    """Cut distinct vectors ``vid, u, ids`` into cells of at most ``cell_rows``.

    Returns the vectors with their cell and, level by level, the boxes ``cell, parent, lo, hi, n, diameter``. A round cuts
    every cell that is too large across its widest component, at quantiles and at the middle. The middle lies below the
    maximum, so both sides hold a vector and the rounds end whatever the values are.
    """
    members = cut_lineage(vectors.withColumn("cell", lit(ROOT)))
    boxes = cut_lineage(_boxes(members).withColumn("parent", lit(ROOT)))
    levels = [boxes]
    while not (large := boxes.where(col("n") > cell_rows)).isEmpty():
        wide = members.join(large.select("cell", "axis", F.element_at("lo", col("axis") + 1).alias("a"), F.element_at("hi", col("axis") + 1).alias("z")),
                            "cell", "left").withColumn("x", F.when(col("axis").isNotNull(), F.element_at("u", col("axis") + 1)))
        middle = (F.first("a") + F.first("z")) / 2
        cuts = wide.where(col("axis").isNotNull()).groupBy("cell").agg(F.array_union(
            F.percentile_approx("x", [i / SLABS for i in range(1, SLABS)], 1000),
            F.array(F.when(middle < F.first("z"), middle).otherwise(F.first("a")))).alias("cuts"))
        slab = F.size(F.filter("cuts", lambda c: col("x") > c))
        members = cut_lineage(wide.join(cuts, "cell", "left").select(
            "vid", "u", "ids", col("cell").alias("parent"),
            F.when(col("cuts").isNull(), col("cell")).otherwise(F.concat_ws(".", "cell", slab.cast("string"))).alias("cell")))
        parents = members.select("cell", "parent").distinct()
        boxes = cut_lineage(_boxes(members).join(parents, "cell"))
        members = members.drop("parent")
        levels.append(boxes)
    return members, levels


def _gap(lo_a, hi_a, lo_b, hi_b):
    """Squared distance of two boxes given as arrays."""
    low = F.zip_with(lo_a, hi_b, lambda x, y: F.greatest(x - y, lit(0.0)))
    high = F.zip_with(lo_b, hi_a, lambda x, y: F.greatest(x - y, lit(0.0)))
    return F.aggregate(F.zip_with(low, high, lambda x, y: F.greatest(x, y)), lit(0.0), lambda s, x: s + x * x)


def near_cells(levels: Sequence[DataFrame], k: int) -> DataFrame:
    """``a, b``: cells ``b`` that can hold one of the ``k`` nearest of some vector of ``a``, found from the root down.

    A cell of more than ``k`` vectors bounds the search of its vectors by its own diameter, a smaller one by its
    parent's. Pairs of children are made only from pairs of parents that stayed.
    """
    far = lit(5.0)  # above the largest squared distance of two unit vectors
    pairs = None
    for boxes in levels:
        side = lambda n: boxes.select(*[col(c).alias(f"{n}_{c}") for c in ("cell", "parent", "lo", "hi", "n", "diameter")])  # noqa: B023, E731
        own = F.when(col("a_n") > k, col("a_diameter")).otherwise(far)
        if pairs is None:
            made = side("a").join(side("b"), col("a_parent") == col("b_parent")).withColumn("bound", own)
        else:
            made = pairs.join(side("a"), col("a") == col("a_parent")).join(side("b"), col("b") == col("b_parent")).withColumn(
                "bound", F.least("bound", own))
        pairs = cut_lineage(made.where(_gap(col("a_lo"), col("a_hi"), col("b_lo"), col("b_hi")) <= col("bound") + SLACK).select(
            col("a_cell").alias("a"), col("b_cell").alias("b"), "bound"))
    return pairs.where(col("a") != col("b")).select("a", "b")


def _best(left_q: pd.Series, left_u: np.ndarray, right: pd.DataFrame, keep: int, digits: int) -> pd.DataFrame:
    """For each left vector the ``keep`` best right directions by (rounded similarity, first id)."""
    base = np.stack(right["u"].to_numpy()).astype(float)
    ids = right["ids"].to_numpy()
    first = np.array([i[0] for i in ids])
    qs = left_q.to_numpy()
    out_q, out_i, out_s = [], [], []
    step = max(1, 4_000_000 // len(base))
    for s in range(0, len(qs), step):
        sims = np.round(left_u[s:s + step] @ base.T, digits)
        for q, row in zip(qs[s:s + step], sims):
            best = np.lexsort((first, -row))[:keep]
            out_q.extend([q] * len(best))
            out_i.extend(ids[j] for j in best)
            out_s.extend(row[best])
    return pd.DataFrame({"q": out_q, "ids": out_i, "sim": out_s})


_EMPTY = pd.DataFrame({"q": pd.Series(dtype="int64"), "ids": pd.Series(dtype=object), "sim": pd.Series(dtype=float)})


def _own_cell(members: DataFrame, k: int, digits: int) -> DataFrame:
    """Best directions of each vector within its own cell. A cell holds at most ``cell_rows`` vectors."""
    def search(part: pd.DataFrame) -> pd.DataFrame:
        return _best(part["vid"], np.stack(part["u"].to_numpy()).astype(float), part, k + 1, digits)

    return cut_lineage(members.groupBy("cell").applyInPandas(search, "q bigint, ids array<bigint>, sim double"))


def visits(members: DataFrame, levels: Sequence[DataFrame], own: DataFrame, k: int) -> DataFrame:
    """``q, qu, cell``: other cells that a vector has to look at. The similarity of its best ``k`` + 1 patients so far
    bounds the distance; a cell whose box is farther away cannot hold a better one."""
    reach = own.select("q", F.explode("ids").alias("i"), "sim").groupBy("q").agg(F.sort_array(F.collect_list("sim"), asc=False).alias("s"))
    limit = F.when(F.size("s") > k, 2 - 2 * F.get("s", lit(k))).otherwise(lit(5.0))
    bounded = members.join(reach, col("vid") == col("q")).select(col("q"), col("u").alias("qu"), col("cell").alias("a"), limit.alias("far"))
    last = levels[-1].select(col("cell").alias("b"), "lo", "hi")
    return bounded.join(near_cells(levels, k), "a").join(last, "b").where(
        _gap(col("qu"), col("qu"), col("lo"), col("hi")) <= col("far") + SLACK).select("q", "qu", col("b").alias("cell"))


def nearest_patients(inter: DataFrame, items: Sequence[str] | None = None, k: int = 5, digits: int = 9, cell_rows: int = 4096,
                     block_rows: int = 50_000) -> DataFrame:
    """The ``k`` patients with the highest cosine similarity to each patient, exact, ties to the smaller id.

    Equal directions are one vector, named by its smallest patient id. The vectors are cut into cells of at most
    ``cell_rows``; each is first compared with its own cell, then with the cells whose box may hold a better one (see
    ``visits``). Visitors of a popular cell are cut into blocks, so a task never holds more than a cell and a block.
    With very many treatments boxes tell little apart and most cells are visited; the answer stays exact.
    """
    units = directions(inter, items)
    # k + 1 smallest ids per direction are enough: no answer can need more of one direction.
    w = Window.partitionBy("u").orderBy("patient_id")
    vectors = units.withColumn("_r", F.row_number().over(w)).where(col("_r") <= k + 1).groupBy("u").agg(
        F.sort_array(F.collect_list("patient_id")).alias("ids")).select(F.element_at("ids", 1).alias("vid"), "u", "ids")
    members, levels = cells(vectors, cell_rows)
    own = _own_cell(members, k, digits)
    found = own
    if len(levels) > 1:
        going = cut_lineage(visits(members, levels, own, k))
        load = going.groupBy("cell").agg(F.ceil(F.count(lit(1)) / block_rows).alias("groups"))
        left = going.join(load, "cell").select("cell", F.pmod(F.xxhash64("q"), col("groups")).alias("grp"), "q", "qu")
        right = members.join(load, "cell").select("cell", F.explode(F.sequence(lit(0).cast("bigint"), col("groups") - 1)).alias("grp"), "u", "ids")

        def match(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(a) or not len(b):
                return _EMPTY
            return _best(a["q"], np.stack(a["qu"].to_numpy()).astype(float), b, k + 1, digits)

        found = own.unionByName(left.groupBy("cell", "grp").cogroup(right.groupBy("cell", "grp")).applyInPandas(
            match, "q bigint, ids array<bigint>, sim double"))
    wq = Window.partitionBy("q").orderBy(col("sim").desc(), "neighbour")
    top = found.select("q", F.explode("ids").alias("neighbour"), "sim").withColumn("_r", F.row_number().over(wq)).where(
        col("_r") <= k + 1).groupBy("q").agg(F.array_sort(F.collect_list(F.struct("_r", "neighbour", "sim"))).alias("best"))
    # Every patient of a direction shares its candidates and leaves itself out. The vector itself is the key.
    per = units.join(top.join(members.select(col("vid").alias("q"), "u"), "q").select("u", "best"), "u")
    mine = F.slice(F.filter("best", lambda b: b["neighbour"] != col("patient_id")), 1, k)
    return per.select("patient_id", F.posexplode(mine).alias("p", "b")).select(
        "patient_id", col("b.neighbour").alias("neighbour"), col("b.sim").alias("similarity"), (col("p") + 1).alias("rank"))
