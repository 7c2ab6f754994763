"""Designs of many studies at once: replicates, batches, dose axes, readiness, claims, sample coverage.

A registry has one row per sample: dataset_id, sample_id, dose_group_id, dose_value, dose_unit, timepoint_hours,
replicate_type, batch_id, control_flag. Verdicts have one row per dataset or group; all are grouped aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import number_strict

MIN_LEVELS, MIN_NONZERO, PREFERRED_LEVELS, MIN_REPLICATES, PREFERRED_REPLICATES = 2, 2, 4, 2, 3


#: Warnings of a dose group's kinds of replicates.
REPLICATE_WARNINGS = ("EPIR001_TECHNICAL_REPLICATE_ONLY", "EPIR002_POOLED_SAMPLE", "EPIR003_PSEUDOBULK_SAMPLE", "EPIR004_MIXED_REPLICATE_TYPES")


def replicates(samples: DataFrame, n1_policy: str = "review_required") -> DataFrame:
    """Per dose group: samples by type, effective biological replicates, status, and warnings. A group of one is up for
    review where the policy says so, else excluded."""
    kind = F.coalesce("replicate_type", F.lit("biological"))
    per = samples.groupBy("dataset_id", "dose_group_id").agg(
        F.count_if(kind == "biological").alias("biological"), F.count_if(kind == "technical").alias("technical"),
        F.count_if(kind == "pooled").alias("pooled"), F.count_if(kind == "pseudobulk").alias("pseudobulk"),
    )
    n = F.col("biological") + F.col("pooled") + F.col("pseudobulk")
    one = F.lit("review_required" if n1_policy == "review_required" else "excluded")
    status = F.when(n >= PREFERRED_REPLICATES, "preferred").when(n >= MIN_REPLICATES, "accepted").when(n == 1, one).otherwise("excluded")
    kinds = sum((F.when(F.col(c) > 0, 1).otherwise(0) for c in ("technical", "pooled", "pseudobulk")), F.when(F.col("biological") > 0, 1).otherwise(0))
    tests = ((n == 0) & (F.col("technical") > 0), F.col("pooled") > 0, F.col("pseudobulk") > 0, kinds > 1)
    warnings = F.concat_ws(",", *(F.when(t, code) for t, code in zip(tests, REPLICATE_WARNINGS)))
    return per.withColumn("effective", n).withColumn("status", status).withColumn("warnings", warnings)


def replicate_verdicts(groups: DataFrame) -> DataFrame:
    """Per dataset of ``replicates`` rows: the most restrictive status, least effective replicates, groups blocked and
    under the preferred number."""
    order = ("excluded", "review_required", "accepted", "preferred")
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("status"))
    per = groups.groupBy("dataset_id").agg(F.min(rank).alias("r"), F.min("effective").alias("least"), F.count_if(F.col("status") == "excluded").alias("n_blocked"), F.count_if(F.col("effective") < PREFERRED_REPLICATES).alias("n_under_preferred"))
    return per.select("dataset_id", F.element_at(F.array(*map(F.lit, order)), F.col("r").cast("int")).alias("overall"), "least", "n_blocked", "n_under_preferred", (F.col("r") > 1).alias("valid"))


def batch_provenance(samples: DataFrame, corrections: DataFrame | None = None) -> DataFrame:
    """Per dataset: batches, whether every sample names one, whether some dose group lies in one batch while the dataset has
    several, and warnings. ``corrections`` (dataset_id, method, n_parameters, structure_kept) declares upstream
    corrections, whose gaps are warnings too. Blank names count as absent."""
    rows = samples.withColumn("batch_id", F.nullif(F.trim("batch_id"), F.lit("")))
    per = rows.groupBy("dataset_id", "dose_group_id").agg(F.countDistinct("batch_id").alias("k"))
    nested = per.groupBy("dataset_id").agg(F.bool_or(F.col("k") == 1).alias("inside"))
    whole = rows.groupBy("dataset_id").agg(F.countDistinct("batch_id").alias("n_batches"), F.count("batch_id").alias("named"), F.count("*").alias("n"))
    out = whole.join(nested, "dataset_id").withColumn("complete", F.col("named") == F.col("n")).withColumn("nested", (F.col("n_batches") > 1) & F.col("inside"))
    told = [F.when(F.col("named") == 0, "BATCH_MISSING_METADATA").when(~F.col("complete"), "BATCH_PARTIAL_METADATA"), F.when(F.col("nested"), "BATCH_DOSE_CONFOUNDING")]
    if corrections is not None:
        out = out.join(corrections.select("dataset_id", "method", "n_parameters", "structure_kept"), "dataset_id", "left")
        some = F.col("method").isNotNull()
        told += [F.when(some & (F.coalesce("n_parameters", F.lit(0)) == 0), "BATCH_CORRECTION_NO_PARAMS"), F.when(some & ~F.coalesce("structure_kept", F.lit(False)), "BATCH_CORRECTION_NO_PRE_STRUCTURE")]
    return out.select("dataset_id", "n_batches", "complete", "nested", F.concat_ws(",", *told).alias("warnings"))


def perfect_confounding(samples: DataFrame) -> DataFrame:
    """Per dataset: every group in exactly one batch and every batch in exactly one group, given complete batch names."""
    pairs = samples.select("dataset_id", "dose_group_id", "batch_id").where("batch_id is not null").distinct()
    g = pairs.groupBy("dataset_id", "dose_group_id").agg(F.count("*").alias("k")).groupBy("dataset_id").agg(F.max("k").alias("per_group"), F.count("*").alias("groups"))
    b = pairs.groupBy("dataset_id", "batch_id").agg(F.count("*").alias("k")).groupBy("dataset_id").agg(F.max("k").alias("per_batch"), F.count("*").alias("batches"))
    whole = samples.groupBy("dataset_id").agg((F.count("batch_id") == F.count("*")).alias("complete"))
    joined = whole.join(g, "dataset_id", "left").join(b, "dataset_id", "left")
    hit = F.col("complete") & (F.col("per_group") == 1) & (F.col("per_batch") == 1) & (F.col("batches") > 1)
    return joined.select("dataset_id", F.coalesce(hit, F.lit(False)).alias("confounded"))


def dose_axis(samples: DataFrame) -> DataFrame:
    """Groups by dose and then id (without case first): position, sample count, sorted samples, and the first control."""
    per = samples.groupBy("dataset_id", "dose_value", "dose_group_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("sample_id")), ",").alias("samples"))
    order = Window.partitionBy("dataset_id").orderBy("dose_value", F.lower("dose_group_id"), "dose_group_id")
    return per.withColumn("position", F.row_number().over(order)).withColumn("is_control", (F.col("dose_value") == 0) & (F.col("position") == 1))


def control_axis(samples: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """Per dataset: control groups (dose 0, or every sample flagged), units, timepoints, and what is wrong. ``declared``
    (dataset_id, control_group, normalisation) names the control, and how mixed units were normalised. A named group must be
    one of the design's and a control; without a name there must be exactly one control. Designs of several timepoints are
    refused before their controls are looked at."""
    groups = samples.groupBy("dataset_id", "dose_group_id", "dose_value", "dose_unit", "timepoint_hours").agg(F.bool_and("control_flag").alias("flagged"))
    is_control = (F.col("dose_value") == 0) | F.coalesce("flagged", F.lit(False))
    if declared is not None:
        groups = groups.join(declared.select("dataset_id", "control_group", "normalisation"), "dataset_id", "left")
    else:
        groups = groups.withColumn("control_group", F.lit(None).cast("string")).withColumn("normalisation", F.lit(None).cast("string"))
    here = F.col("dose_group_id") == F.col("control_group")
    per = groups.groupBy("dataset_id").agg(
        F.countDistinct(F.when(is_control, F.col("dose_group_id"))).alias("n_controls"), F.countDistinct(F.nullif(F.trim("dose_unit"), F.lit(""))).alias("n_units"),
        F.countDistinct(F.coalesce(F.col("timepoint_hours").cast("string"), F.lit("none"))).alias("n_timepoints"), F.max("control_group").alias("control_group"),
        F.coalesce(F.bool_or(here), F.lit(False)).alias("known"), F.coalesce(F.bool_or(here & is_control), F.lit(False)).alias("named"), F.coalesce(F.bool_or(F.trim("normalisation") != ""), F.lit(False)).alias("normalised"),
        F.count_if(F.coalesce(F.trim("dose_unit"), F.lit("")) == "").alias("n_unitless"), (F.count("*") > F.countDistinct("dose_group_id")).alias("repeated"),
    )
    unnamed = F.col("control_group").isNull()
    control = (
        F.when(~unnamed & ~F.col("known"), "unknown_control_group").when(~unnamed & ~F.col("named"), "named_group_is_no_control")
        .when(unnamed & (F.col("n_controls") == 0), "no_control").when(unnamed & (F.col("n_controls") > 1), "several_controls")
    )
    problems = F.concat_ws(",",
        F.when(F.col("n_timepoints") == 1, control), F.when(F.col("n_unitless") > 0, "missing_dose_unit"), F.when((F.col("n_units") > 1) & ~F.col("normalised"), "mixed_dose_units"),
        F.when(F.col("n_timepoints") > 1, "multi_timepoint"), F.when(F.col("repeated"), "repeated_dose_group"),
    )
    warnings = F.when((F.col("n_units") > 1) & F.col("normalised"), "mixed_dose_units_normalised").otherwise("")
    return per.select("dataset_id", "n_controls", "n_units", "n_timepoints", problems.alias("problems"), warnings.alias("warnings"))


def split_timepoints(samples: DataFrame) -> DataFrame:
    """One design per timepoint: datasets with several get the timepoint in their name."""
    n = F.size(F.collect_set(F.coalesce("timepoint_hours", F.lit(-1.0))).over(Window.partitionBy("dataset_id")))
    name = F.when(n > 1, F.concat("dataset_id", F.lit("_tp"), F.coalesce(F.col("timepoint_hours").cast("int").cast("string"), F.lit("none"))))
    return samples.withColumn("dataset_id", F.coalesce(name, "dataset_id"))


def split_designs(samples: DataFrame) -> DataFrame:
    """Per design after ``split_timepoints``: samples, groups, whether it has a control, least samples in a group, and
    whether it stands: one without a control does not, one of fewer than two groups is warned of."""
    rows = split_timepoints(samples)
    sizes = rows.groupBy("dataset_id", "dose_group_id").agg(F.count("*").alias("k")).groupBy("dataset_id").agg(F.min("k").alias("min_replicates"), F.count("*").alias("n_groups"))
    per = rows.groupBy("dataset_id").agg(F.count("*").alias("n_samples"), F.bool_or((F.col("dose_value") == 0) | F.coalesce("control_flag", F.lit(False))).alias("has_controls")).join(sizes, "dataset_id")
    state = F.when(~F.col("has_controls"), "no_control").when(F.col("n_groups") < 2, "few_groups").otherwise("ready")
    return per.select("dataset_id", "n_samples", "n_groups", "has_controls", "min_replicates", state.alias("state"))


def readiness(samples: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """Per dataset: dose levels, least effective replicates, blockers in order, and the status they leave. A design is invalid
    with any problem of ``control_axis`` or a sample that it lists twice; doses other than zero count as treated."""
    levels = samples.groupBy("dataset_id").agg(
        F.countDistinct("dose_value").alias("levels"), F.countDistinct(F.when(F.col("dose_value") != 0, F.col("dose_value"))).alias("nonzero"), (F.count("*") > F.countDistinct("sample_id")).alias("twice")
    )
    least = replicates(samples).groupBy("dataset_id").agg(F.min("effective").alias("least"))
    axis = control_axis(samples, declared).select("dataset_id", "problems", "n_timepoints")
    rows = levels.join(least, "dataset_id").join(axis, "dataset_id").join(perfect_confounding(samples), "dataset_id")
    invalid = (F.col("problems") != "") | F.col("twice")
    common = [
        F.when(invalid, "structural_validation_failed"), F.when(F.col("nonzero") == 0, "no_treated_dose"),
        F.when(F.col("least") < MIN_REPLICATES, "insufficient_biological_replicates"), F.when(F.col("confounded"), "dose_batch_confounding"),
        F.when(F.col("n_timepoints") > 1, "multi_timepoint_requires_split"),
    ]
    only_dose = [F.when(F.col("levels") < MIN_LEVELS, "insufficient_total_dose_levels"), F.when((F.col("nonzero") > 0) & (F.col("nonzero") < MIN_NONZERO), "insufficient_nonzero_dose_levels")]
    compare, dose = F.array_compact(F.array(*common)), F.array_compact(F.array(*common[:2], *only_dose, *common[2:]))
    rows = rows.withColumn("compare", compare).withColumn("dose", dose)
    status = (
        F.when((F.size("dose") == 0) & (F.col("levels") >= PREFERRED_LEVELS) & (F.col("least") >= PREFERRED_REPLICATES), "dose_response_preferred")
        .when(F.size("dose") == 0, "dose_response_minimum").when(F.size("compare") == 0, "comparison_only").when(~invalid, "structural_only").otherwise("invalid")
    )
    return rows.select("dataset_id", "levels", "nonzero", "least", F.concat_ws(",", "dose").alias("blockers"), status.alias("status"))


def context(samples: DataFrame) -> DataFrame:
    """Per dataset: batch names, how many samples lack one, and the timepoint status."""
    n = F.countDistinct("timepoint_hours")
    gaps = F.count_if(F.col("timepoint_hours").isNull())
    return samples.groupBy("dataset_id").agg(
        F.array_join(F.array_sort(F.collect_set("batch_id")), ",").alias("batches"), F.count_if(F.col("batch_id").isNull()).alias("n_unnamed"),
        F.when(n > 1, "multiple").when(n == 0, "unspecified").when(gaps > 0, "partial").otherwise("single").alias("timepoint_status"),
    )


def guard_claims(designs: DataFrame, samples: DataFrame) -> DataFrame:
    """Designs with persistence and reversibility reset where fewer than two timepoints exist (an unnamed one counts), and
    heritability taken away without the multigenerational flag."""
    times = samples.groupBy("dataset_id").agg(F.countDistinct(F.coalesce("timepoint_hours", F.lit(-1.0))).alias("n_times"))
    rows = designs.join(times, "dataset_id")
    enough = F.col("n_times") > 1
    return rows.select(
        "dataset_id", F.when(enough, F.col("persistence_status")).otherwise("not_assessed").alias("persistence_status"),
        F.when(enough, F.col("reversibility_status")).otherwise("not_assessed").alias("reversibility_status"),
        F.when(F.coalesce("multigenerational", F.lit(False)), F.col("heritability_claim")).alias("heritability_claim"),
    )


def coverage(matrix: DataFrame, samples: DataFrame) -> DataFrame:
    """Per dataset, samples of the matrix against the design both ways: matched, only in either, duplicates, complete."""
    m = matrix.groupBy("dataset_id", "sample_id").agg(F.count("*").alias("m"))
    d = samples.groupBy("dataset_id", "sample_id").agg(F.count("*").alias("d"), F.bool_or(F.col("dose_group_id").isNull()).alias("groupless"))
    both = m.join(d, ["dataset_id", "sample_id"], "full_outer")
    per = both.groupBy("dataset_id").agg(
        F.count_if(F.col("m").isNotNull() & F.col("d").isNotNull()).alias("matched"), F.count_if(F.col("d").isNull()).alias("not_in_design"),
        F.count_if(F.col("m").isNull()).alias("not_in_matrix"), F.count_if(F.col("d") > 1).alias("duplicated"), F.count_if("groupless").alias("groupless"),
    )
    return per.withColumn("complete", (F.col("not_in_design") + F.col("not_in_matrix") + F.col("duplicated") + F.col("groupless")) == 0)


def read_design(rows: DataFrame) -> DataFrame:
    """Typed samples from text columns sample_id, group_id, dose_value, dose_unit, timepoint, replicate_type, control_flag and
    file_row: booleans and replicate types by their words, replicate index by file order among the kept rows of a group,
    and the state: kept, or why a row is rejected (no id, no number as dose, unknown words, a sample met before)."""
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    flag, kind, dose = F.lower(text("control_flag")), F.lower(text("replicate_type")), number_strict(F.col("dose_value"))[0]
    typed = rows.select(
        "dataset_id", "sample_id", "group_id", "dose_unit", "file_row", dose.alias("dose"), number_strict(F.col("timepoint"))[0].alias("timepoint_hours"),
        F.when(flag.isin("true", "yes", "1", "control", "ctrl"), True).when(flag.isin("", "false", "no", "0", "treatment"), False).alias("is_control"),
        F.when(kind.isin("biological", "bio"), "biological").when(kind.isin("technical", "tech"), "technical").alias("kind"), (kind == "").alias("unsaid"),
    )
    fault = (
        F.when((text("sample_id") == "") | (text("group_id") == ""), "missing_id").when(F.col("dose").isNull(), "bad_dose").when(F.col("is_control").isNull(), "bad_control_flag")
        .when(F.col("kind").isNull() & ~F.col("unsaid"), "bad_replicate_type")
    )
    by_sample = Window.partitionBy("dataset_id", "sample_id").orderBy("file_row")
    state = F.coalesce("fault", F.when(F.sum(F.col("fault").isNull().cast("int")).over(by_sample.rowsBetween(Window.unboundedPreceding, 0)) > 1, "repeated"), F.lit("kept"))
    ruled = typed.withColumn("fault", fault).withColumn("state", state)
    group = Window.partitionBy("dataset_id", "group_id", "dose", "dose_unit", "timepoint_hours", F.col("state") == "kept").orderBy("file_row")
    index = F.when(F.col("state") == "kept", F.row_number().over(group) - 1)
    return ruled.withColumn("replicate_index", index).drop("fault", "unsaid", "file_row")


def dose_groups(samples: DataFrame) -> DataFrame:
    """Per dataset of ``read_design`` rows: kept samples, dose groups (id, dose, unit, timepoint), least samples in one, and
    whether there is a control."""
    kept = samples.where("state = 'kept'")
    per = kept.groupBy("dataset_id", "group_id", "dose", "dose_unit", "timepoint_hours").agg(F.count("*").alias("k"), F.bool_or("is_control").alias("c"))
    return per.groupBy("dataset_id").agg(F.sum("k").alias("n_samples"), F.count("*").alias("n_groups"), F.min("k").alias("min_replicates"), F.bool_or(F.col("c") | (F.col("dose") == 0)).alias("has_controls"))
