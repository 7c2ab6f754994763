"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], and the qualification of data sets of 6 samples as in the
published baseline (10 000 features, and 100 times as many); prints one JSON line."""

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
NAMES = ["a1_missingness", "a3_group_summary", "a6_replicate_stability", "w2_response_pattern", "t3_exact_permutation", "w3_p_adjustment", "a16_design_readiness", "j3_promoter_overlap", "j5_nearest_gene", "q1_qualification", "p6_long_rows", "d1_table_shape", "q4_cytotoxicity"]


def packet(spark: SparkSession, n: int, base: str) -> str:
    """The baseline's workload as tables: n features of one data set, three dose groups of two samples, every tenth feature
    without two of its values."""
    f = spark.range(n).select(F.lit("d").alias("dataset_id"), F.concat(F.lit("f"), "id").alias("feature_id"), F.lit("cpg_methylation").alias("feature_class"), F.lit("chr1").alias("chrom"), F.lit("GRCh38").alias("build"), F.lit("ucsc_bed_0based_half_open").alias("coord_system"), "id")
    f.drop("id").write.parquet(f"{base}/features")
    cells = f.select("dataset_id", "feature_id", "id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("s")).where((F.col("id") % 10 != 0) | (F.col("s") < 4))
    cells.select("dataset_id", "feature_id", F.concat(F.lit("s"), "s").alias("sample_id"), (F.rand(1) * 0.8 + 0.1).alias("value")).write.parquet(f"{base}/cells")
    s = spark.range(6).select(
        F.lit("d").alias("dataset_id"), F.concat(F.lit("s"), "id").alias("sample_id"), F.concat(F.lit("g"), F.floor(F.col("id") / 2)).alias("dose_group_id"), F.floor(F.col("id") / 2).cast("double").alias("dose_value"),
        F.lit("uM").alias("dose_unit"), F.lit(24.0).alias("timepoint_hours"), F.lit("biological").alias("replicate_type"), F.lit("b").alias("batch_id"), (F.col("id") < 2).alias("control_flag"),
    )
    s.write.parquet(f"{base}/samples")
    return base


def qualified(spark: SparkSession, base: str):
    from methyra.operators import qualify

    f, c, s = (spark.read.parquet(f"{base}/{t}") for t in ("features", "cells", "samples"))
    level = s.select("dataset_id").distinct().withColumn("confounding", F.lit("unlikely_confounding"))
    mappings = spark.createDataFrame([], "dataset_id string, feature_id string, n_genes int, method string, ambiguous boolean")
    policy = qualify.policies(spark.createDataFrame([("base",)], "policy_id string"))
    return qualify.cascade(qualify.measured(f, c, s), qualify.dataset_verdicts(s, {"cell_composition": level, "cytotoxicity": level}), mappings, policy)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from methyra.plans.queries import QUERIES

    run = lambda df: df.write.format("noop").mode("overwrite").save()
    run(QUERIES["a5_variance"](spark, SF))  # starts the workers and compiles
    took = {}
    for name in NAMES:
        began = time.time()
        run(QUERIES[name](spark, SF))
        took[name] = round(time.time() - began, 3)
    total = round(sum(took.values()), 3)
    with tempfile.TemporaryDirectory(prefix="spark-bench-") as base:
        for n in (10_000, 1_000_000):
            tables = packet(spark, n, f"{base}/{n}")
            run(qualified(spark, tables))
            began = time.time()
            run(qualified(spark, tables))
            took[f"qualification_{n}x6"] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": total, "unit": "sec", "queries": took, "sf": os.path.basename(SF.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
