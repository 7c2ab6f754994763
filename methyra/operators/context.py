"""Cell composition and cytotoxicity beside measurements, and how strongly they confound; comparisons of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLACK = 1e-12


def composition_checks(fractions: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Per sample: sum of fractions, missing ones, and whether the sum is off."""
    per = fractions.groupBy("dataset_id", "sample_id").agg(F.sum("fraction").alias("total"), F.count_if(F.col("fraction").isNull()).alias("n_missing"))
    return per.withColumn("bad_sum", F.abs(F.col("total") - 1) > tolerance + SLACK)


def composition_shift(fractions: DataFrame, samples: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Per dose group against the control group: largest change of a cell type's mean fraction over samples with records
    (an absent type counts 0), and how many types change by more than the threshold."""
    own = samples.select("dataset_id", "sample_id", "dose_group_id", "dose_value")
    rows = fractions.join(own, ["dataset_id", "sample_id"])
    size = rows.groupBy("dataset_id", "dose_group_id").agg(F.countDistinct("sample_id").alias("n"))
    means = rows.groupBy("dataset_id", "dose_group_id", "dose_value", "cell_type").agg(F.sum("fraction").alias("s")).join(size, ["dataset_id", "dose_group_id"])
    means = means.withColumn("mean", F.col("s") / F.col("n"))
    control = means.where("dose_value = 0").select("dataset_id", "cell_type", F.col("mean").alias("base"))
    groups = means.where("dose_value <> 0").select("dataset_id", "dose_group_id").distinct()
    types = means.select("dataset_id", "cell_type").distinct()
    grid = groups.join(types, "dataset_id").join(means.select("dataset_id", "dose_group_id", "cell_type", "mean"), ["dataset_id", "dose_group_id", "cell_type"], "left").join(control, ["dataset_id", "cell_type"], "left")
    delta = F.abs(F.coalesce("mean", F.lit(0.0)) - F.coalesce("base", F.lit(0.0)))
    return grid.withColumn("delta", delta).groupBy("dataset_id", "dose_group_id").agg(F.max("delta").alias("max_delta"), F.count_if(F.col("delta") > threshold + SLACK).alias("n_shifted"))


#: Levels of confounding, in blocking order, and what stands where there is no context.
LEVELS = ("unlikely_confounding", "possible_confounding", "likely_confounding", "dominant_confounding", "review_required")
NO_CONTEXT = "no_context_available"
#: Where a sample's cell composition comes from; the first four are reliable.
SOURCES = ("measured_flow_cytometry", "measured_sorting", "externally_estimated", "declared_pure", "declared_mixed_unknown_fractions", "not_declared")


def filled(declarations: DataFrame, fractions: DataFrame) -> DataFrame:
    """Fractions with those of samples that are declared pure filled in: their declared type has all (A-11)."""
    pure = declarations.where("source = 'declared_pure' and declared_cell_type is not null")
    rest = fractions.join(pure, ["dataset_id", "sample_id"], "left_anti")
    return rest.unionByName(pure.select("dataset_id", "sample_id", F.col("declared_cell_type").alias("cell_type"), F.lit(1.0).alias("fraction")), allowMissingColumns=True)


def composition_class(shifts: DataFrame, checks: DataFrame, declarations: DataFrame) -> DataFrame:
    """Per dataset of ``declarations`` (dataset_id, sample_id, source, declared_cell_type) how strongly cell composition
    confounds, whether it blocks, and the warning: no context, contradictions, the largest shift of a group, or the
    reliability of the sources, in this order."""
    s = shifts.groupBy("dataset_id").agg(F.max("max_delta").alias("delta"), F.bool_or(F.col("n_shifted") > 0).alias("shifted"))
    bad = checks.groupBy("dataset_id").agg(F.bool_or("bad_sum").alias("bad"))
    source, pure = F.col("source"), F.col("source") == "declared_pure"
    told = declarations.groupBy("dataset_id").agg(
        F.bool_and(source == "not_declared").alias("silent"), F.bool_or(source == "not_declared").alias("some_silent"), F.bool_and(source == SOURCES[4]).alias("unknown"), F.bool_or(source == SOURCES[4]).alias("some_unknown"),
        F.bool_or(source.isin(*SOURCES[:4])).alias("some_reliable"), F.bool_and(source.isin(*SOURCES[:4])).alias("reliable"), F.bool_and(pure).alias("pure"),
        F.countDistinct(F.when(pure, F.col("declared_cell_type"))).alias("n_types"), F.count_if(pure & F.col("declared_cell_type").isNull()).alias("n_untyped"),
    )
    rows = told.join(bad, "dataset_id", "left").join(s, "dataset_id", "left")
    d, on = F.col("delta"), lambda c: F.coalesce(c, F.lit(False))
    data = F.col("bad").isNotNull() | F.col("some_reliable")
    none = ~data & ~F.col("unknown")
    mixed = (F.col("some_silent") & ~F.col("silent")) | (F.col("some_unknown") & F.col("some_reliable"))
    shift = on(F.col("shifted"))
    by_shift = F.when(d > 0.5 + SLACK, LEVELS[3]).when(d > 0.3 + SLACK, LEVELS[2]).when(d > 0.1 + SLACK, LEVELS[1]).otherwise(LEVELS[0])
    sure = (F.col("pure") & (F.col("n_types") == 1) & (F.col("n_untyped") == 0)) | (F.col("reliable") & d.isNotNull())
    level = F.when(none, NO_CONTEXT).when(on(F.col("bad")) | mixed | (F.col("n_types") > 1), LEVELS[4]).when(shift, by_shift).when(sure, LEVELS[0]).otherwise(LEVELS[1])
    warning = (
        F.when(none, "EPIW001_CELL_COMPOSITION_CONTEXT_MISSING").when(on(F.col("bad")), "CC_FRACTION_SUM_MISMATCH").when(mixed, "CC_MIXED_DECLARATIONS")
        .when(F.col("n_types") > 1, "CC_CONFLICTING_PURE_TYPES").when(shift | ~sure, "EPIW002_CELL_TYPE_SHIFT_POSSIBLE")
    )
    blocks = on(F.col("bad")) & ~none | ~none & ~on(F.col("bad")) & ~mixed & (F.col("n_types") > 1)
    return rows.select("dataset_id", "delta", level.alias("confounding"), blocks.alias("blocks"), warning.alias("warning"))


#: Kinds of assays that count, evidence that a note must have, and the share of dying cells that is elevated.
VIABILITY, DYING, DECLARED, ELEVATED = "viability", "apoptosis_necrosis", "declared", 0.2


def cytotoxicity(assays: DataFrame, datasets: DataFrame | None = None) -> DataFrame:
    """Per dataset: malformed entries (negative or no numbers), least viability, stress flags, whether cytotoxicity is detected
    (never where entries are malformed), its class, and whether that blocks. Notes count where the evidence is declared.
    ``datasets`` without assays have no context."""
    x = F.col("value")
    valid = ~F.isnan(x) & (F.abs(x) < float("inf"))
    told = (F.col("evidence_source") == DECLARED) & (F.instr(F.lower("notes"), "cytotoxic") > 0)
    per = assays.groupBy("dataset_id").agg(
        F.count("*").alias("n"), F.count_if((x < 0) | F.isnan(x)).alias("malformed"), F.min(F.when((F.col("metric") == VIABILITY) & valid & (x >= 0), x)).alias("viability"),
        F.max(F.when((F.col("metric") == DYING) & valid, x)).alias("dying"), F.max("n_stress").alias("stress"), F.coalesce(F.bool_or(told), F.lit(False)).alias("declared"),
    )
    if datasets is not None:
        per = datasets.select("dataset_id").distinct().join(per, "dataset_id", "left").withColumn("malformed", F.coalesce("malformed", F.lit(0)))
    low, stressed = F.col("viability"), F.coalesce(F.col("stress") > 0, F.lit(False))
    declared = F.coalesce("declared", F.lit(False))
    base = F.when(low < 0.5 - SLACK, 3).when(low < 0.7 - SLACK, 2).when(low < 0.8 - SLACK, 1).otherwise(0)
    told = F.when(declared & (base < 2), 2).otherwise(base)
    raised = F.when((told == 0) & (F.col("dying") > ELEVATED), 1).otherwise(told)
    level = F.least(F.lit(3), raised + F.when(stressed, 1).otherwise(0))
    detected = (F.col("malformed") == 0) & (F.coalesce(low < 0.8 - SLACK, F.lit(False)) | stressed | declared)
    named = F.when(F.col("malformed") > 0, LEVELS[4]).when(F.col("n").isNull(), NO_CONTEXT).otherwise(F.element_at(F.array(*map(F.lit, LEVELS[:4])), level + 1))
    out = per.select("dataset_id", "malformed", "viability", "stress", detected.alias("detected"), named.alias("confounding"))
    return out.withColumn("blocks", F.col("confounding").isin(*LEVELS[3:]))


def alignment(assays: DataFrame, samples: DataFrame) -> DataFrame:
    """Assay entries whose dose and timepoint lie in the design within slack, or whose dose group does (of equal id).

    Doses and timepoints are matched on their value rounded to slack and both neighbours, so the join has equal keys.
    """
    key = lambda c: F.round(F.col(c) / SLACK).cast("decimal(38,0)")
    design = samples.select("dataset_id", F.col("dose_value").alias("d"), F.col("timepoint_hours").alias("t"), key("dose_value").alias("k")).distinct()
    near = design.select("dataset_id", "d", "t", F.explode(F.array(F.col("k") - 1, F.col("k"), F.col("k") + 1)).alias("k"))
    rows = assays.withColumn("nth", F.monotonically_increasing_id()).withColumn("k", key("dose_value"))
    meets = (F.abs(rows["dose_value"] - near["d"]) < SLACK) & (F.abs(rows["timepoint_hours"] - near["t"]) < SLACK)
    by_dose = rows.join(near, (rows["dataset_id"] == near["dataset_id"]) & (rows["k"] == near["k"]) & meets, "left_semi")
    if "dose_group_id" not in assays.columns:
        return by_dose.drop("nth", "k")
    groups = samples.select("dataset_id", "dose_group_id").distinct()
    by_group = rows.join(near, (rows["dataset_id"] == near["dataset_id"]) & (rows["k"] == near["k"]) & meets, "left_anti").join(groups, ["dataset_id", "dose_group_id"], "left_semi")
    return by_dose.unionByName(by_group).drop("nth", "k")


def merge_findings(*parts: DataFrame) -> DataFrame:
    """Findings (dataset_id, code, category, severity, message, ...) of several checks; those equal in these are one."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.dropDuplicates(["dataset_id", "code", "category", "severity", "message"])


def differences(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of either side without a partner, and of partners the columns that differ (null-safe)."""
    columns = [c for c in a.columns if c not in keys]
    left = a.select(*keys, F.struct(*columns).alias("l"), F.lit(1).alias("in_l"))
    right = b.select(*keys, F.struct(*columns).alias("r"), F.lit(1).alias("in_r"))
    both = left.join(right, keys, "full_outer")
    changed = F.array_compact(F.array(*(F.when(~F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")), F.lit(c)) for c in columns)))
    what = F.when(F.col("in_l").isNull(), "only_right").when(F.col("in_r").isNull(), "only_left").otherwise(F.concat_ws(",", changed))
    return both.select(*keys, what.alias("difference")).where("difference <> ''")


#: Uses that a screening hand-off may not name, in any case.
BLOCKED_USES = (
    "risk|regulatory|safe|safety|advers|legal|compliance|acceptable daily intake|reference dose|"
    "tolerable daily intake|derived no effect level|margin of exposure|health[- ]?based guidance|guidance value|threshold of toxicological concern|"
    r"safe dose|safe level|permitted daily exposure|occupational exposure limit|market authoriz|\b(adi|rfd|tdi|dnel|oel|hbgv|pde|mrl|ttc)\b"
)


def folded(text: Column) -> Column:
    """A text with its dashes and underscores as single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[-_‐-―−⁃]+", " "), r"\s+", " "))


def names_blocked_use(text: Column) -> Column:
    """Whether a text names a use that is blocked, as it stands or with its separators as spaces."""
    return text.rlike(f"(?i){BLOCKED_USES}") | folded(text).rlike(f"(?i){BLOCKED_USES}")


def overclaims(texts: DataFrame) -> DataFrame:
    """Texts (id, text) that name a use that is blocked, and the first words that do, in lower case."""
    found = texts.where(names_blocked_use(F.col("text"))).withColumn("text", folded(F.col("text")))
    return found.select("id", F.lower(F.regexp_extract("text", f"(?i)({BLOCKED_USES})", 1)).alias("word"))
