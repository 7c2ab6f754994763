"""Group summaries, replicate spread and response patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import sign
from .qc import present


def group_summary(cells: DataFrame, features: DataFrame, samples: DataFrame) -> DataFrame:
    """Per feature and dose group: mean, sample standard deviation (0 for fewer than two values), n, missing count and
    fraction. Groups without values still appear."""
    own = samples.select("dataset_id", "sample_id", "dose_group_id")
    stats = cells.where(present()).join(own, ["dataset_id", "sample_id"]).groupBy("dataset_id", "feature_id", "dose_group_id").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.count("*").alias("n")
    )
    groups = samples.groupBy("dataset_id", "dose_group_id").agg(F.count("*").alias("n_samples"))
    every = features.select("dataset_id", "feature_id").join(groups, "dataset_id")
    n = F.coalesce("n", F.lit(0))
    return every.join(stats, ["dataset_id", "feature_id", "dose_group_id"], "left").select(
        "dataset_id", "feature_id", "dose_group_id", "mean", F.coalesce("sd", F.lit(0.0)).alias("sd"), n.alias("n"),
        (F.col("n_samples") - n).alias("n_missing"), F.coalesce(F.try_divide(F.col("n_samples") - n, "n_samples"), F.lit(0.0)).alias("missing_fraction"),
    )


def replicate_consistency(summary: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Per group over features with values: mean of feature means, mean and median of their standard deviations and
    coefficients of variation, features over the threshold, and a warning where they exceed a quarter."""
    cv = F.when((F.col("n") >= 2) & (F.abs("mean") >= 1e-12), F.col("sd") / F.abs("mean"))
    out = summary.where("n > 0").withColumn("cv", cv).groupBy("dataset_id", "dose_group_id").agg(
        F.avg("mean").alias("mean_of_means"), F.avg("sd").alias("mean_sd"), F.percentile("sd", F.lit(0.5)).alias("median_sd"),
        F.avg("cv").alias("mean_cv"), F.percentile("cv", F.lit(0.5)).alias("median_cv"), F.max("cv").alias("max_cv"),
        F.count("cv").alias("n_evaluable"), F.count_if(F.col("cv") > threshold).alias("n_over"),
    )
    return out.withColumn("spread_warning", F.coalesce(F.try_divide("n_over", "n_evaluable") > 0.25, F.lit(False)))


def dose_profile(cells: DataFrame, features: DataFrame, samples: DataFrame) -> DataFrame:
    """Per feature and numeric dose: mean, standard deviation (null for fewer than two values), n. Group labels that share
    a dose are pooled."""
    own = samples.select("dataset_id", "sample_id", "dose_value")
    finite = F.when(F.abs("value") <= 1.7976931348623157e308, F.col("value"))
    stats = cells.where(present()).join(own, ["dataset_id", "sample_id"]).groupBy("dataset_id", "feature_id", "dose_value").agg(
        F.avg(finite).alias("mean"), F.stddev_samp(finite).alias("sd"), F.count(finite).alias("n"), F.count_if(finite.isNull()).alias("n_invalid")
    )
    doses = samples.select("dataset_id", "dose_value").distinct()
    every = features.select("dataset_id", "feature_id").join(doses, "dataset_id")
    return every.join(stats, ["dataset_id", "feature_id", "dose_value"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def design_problems(samples: DataFrame, invalid: DataFrame | None = None) -> DataFrame:
    """(dataset_id, unsound, mixed_units, several_times) of designs; ``invalid`` holds those that failed validation."""
    per = samples.groupBy("dataset_id").agg((F.countDistinct(F.coalesce("dose_unit", F.lit(""))) > 1).alias("mixed_units"), (F.countDistinct(F.coalesce(F.col("timepoint_hours").cast("string"), F.lit("unspecified"))) > 1).alias("several_times"))
    if invalid is None:
        return per.withColumn("unsound", F.lit(False))
    return per.join(invalid.select("dataset_id").distinct().withColumn("unsound", F.lit(True)), "dataset_id", "left").withColumn("unsound", F.coalesce("unsound", F.lit(False)))


def response_pattern(profile: DataFrame, designs: DataFrame | None = None, tolerance: float = 0.0) -> DataFrame:
    """Pattern over the dose axis of each feature, reversals among non-zero steps, direction from the control, dynamic
    range, largest difference from the control, and what blocks an assessment (``designs`` are ``design_problems``; without them designs are taken as sound)."""
    by = Window.partitionBy("dataset_id", "feature_id")
    along = by.orderBy("dose_value")
    step = sign(F.col("mean") - F.lag("mean").over(along), tolerance)
    rows = profile.withColumn("step", F.when(F.lag("mean").over(along).isNotNull() & F.col("mean").isNotNull(), step))
    rows = rows.withColumn("control", F.max(F.when(F.col("dose_value") == 0, F.col("mean"))).over(by))
    moved = F.when(F.col("step") != 0, F.col("step"))
    before = F.last(moved, True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("turn", F.coalesce((moved != before).cast("int"), F.lit(0)))
    diff = F.when(F.col("dose_value") != 0, F.col("mean") - F.col("control"))
    per = rows.withColumn("diff", diff).groupBy("dataset_id", "feature_id").agg(
        F.count_if(F.col("step") > 0).alias("ups"), F.count_if(F.col("step") < 0).alias("downs"), F.sum("turn").alias("reversals"),
        F.min("diff").alias("low"), F.max("diff").alias("high"), (F.max("mean") - F.min("mean")).alias("dynamic_range"),
        F.count_if(F.col("mean").isNull()).alias("gaps"), F.count("*").alias("levels"), F.min("dose_value").alias("least"), F.count_if(F.col("dose_value") == 0).alias("controls"), F.coalesce(F.sum("n_invalid"), F.lit(0)).alias("invalid"), F.max(F.abs("diff")).alias("farthest"), F.max("control").alias("control"),
    )
    sound = F.lit(False)
    per = per.withColumns({"unsound": sound, "mixed_units": sound, "several_times": sound}) if designs is None else per.join(designs, "dataset_id")
    blockers = F.array_compact(F.array(
        F.when(F.col("unsound"), "structurally_invalid_design"), F.when(F.col("controls") == 0, "no_zero_dose_control"), F.when(F.col("least") < 0, "negative_dose_value"),
        F.when(F.col("levels") < 3, "insufficient_distinct_dose_levels"), F.when(F.col("gaps") > 0, "incomplete_dose_level"), F.when(F.col("invalid") > 0, "non_finite_value"),
        F.when(F.col("mixed_units"), "mixed_dose_units"), F.when(F.col("several_times"), "multi_timepoint_design"),
    ))
    pattern = F.when((F.col("ups") == 0) & (F.col("downs") == 0), "flat_within_tolerance").when(F.col("downs") == 0, "monotonic_nondecreasing").when(F.col("ups") == 0, "monotonic_nonincreasing").otherwise("non_monotonic")
    direction = (
        F.when((F.abs("low") <= tolerance) & (F.abs("high") <= tolerance), "unchanged")
        .when((F.col("low") >= -tolerance) & (F.col("high") > tolerance), "increasing")
        .when((F.col("high") <= tolerance) & (F.col("low") < -tolerance), "decreasing")
        .otherwise("mixed")
    )
    ok = F.size(blockers) == 0
    return per.select(
        "dataset_id", "feature_id", F.concat_ws(",", blockers).alias("blockers"), F.when(ok, pattern).alias("pattern"),
        F.when(ok, F.col("reversals")).alias("reversals"), F.when(ok, direction).otherwise("not_assessed").alias("direction"), "dynamic_range",
        F.when(F.col("control").isNotNull(), F.coalesce("farthest", F.lit(0.0))).alias("farthest"),
    )


def page(df: DataFrame, keys: list[str], offset: int, limit: int) -> DataFrame:
    """Rows of a page in key order; ``has_more`` tells whether others follow."""
    some = df.orderBy(*keys).offset(offset).limit(limit + 1)
    numbered = some.withColumn("row", F.row_number().over(Window.orderBy(*keys)))
    return numbered.withColumn("has_more", F.max("row").over(Window.partitionBy()) > limit).where(F.col("row") <= limit).drop("row")
