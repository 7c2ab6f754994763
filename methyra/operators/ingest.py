"""From raw rows to canonical features: reshaping, keep-first and keep-last duplicates, class detection, shape detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import header_key, number_lenient, number_melt, number_strict, trimmed
from .genes import REGION_CLASSES

#: Normalised column names that tell the shape of a table.
FEATURE_NAMES = ("featureid", "feature", "probeid", "cpgid", "peakid", "regionid")
SAMPLE_NAMES = ("sampleid", "sample")
VALUE_NAMES = ("value", "responsevalue", "response", "signal", "betavalue", "beta", "mvalue", "measurement", "methylation")
SUMMARY_NAMES = (
    "group", "groupid", "contrast", "comparison", "effectsize", "effect", "logfc", "log2fc", "foldchange", "fc", "pvalue", "pval", "qvalue", "qval", "fdr",
    "adjustedp", "statistic", "stat", "tstat", "zscore", "se", "stderr", "cilower", "ciupper", "logodds",
)
PLACE_NAMES = ("chr", "chrom", "chromosome", "seqnames", "start", "end", "strand", "width", "gene", "geneid", "symbol", "annotation", "type", "context", "build", "genome")


def melt(wide: DataFrame, ids: list[str], samples: list[str]) -> DataFrame:
    """Cells of a wide table of texts: value, and whether the text was a number or a word for none."""
    long = wide.unpivot(ids, samples, "sample_id", "raw")
    value, ok = number_melt(F.col("raw"))
    return long.withColumn("value", value).withColumn("ok", ok)


#: Column names that are no samples in a wide table, normalised.
METADATA_NAMES = (
    "featureid", "feature", "probeid", "cpgid", "peakid", "regionid", "chr", "chrom", "chromosome", "seqnames", "start", "end", "strand", "width", "gene", "geneid", "symbol",
    "annotation", "type", "context", "build", "genome",
)


def sample_columns(columns: list[str], feature: str) -> list[str]:
    """The columns of a wide table that hold samples: all but the feature's own and those with names of metadata."""
    plain = lambda c: "".join(x for x in c.lower() if not x.isspace() and x not in "_-")
    return [c for c in columns if plain(c) != plain(feature) and plain(c) not in METADATA_NAMES]


def melted(wide: DataFrame, feature: str) -> DataFrame:
    """As ``melt``, the sample columns told by their names, with a note for each cell: a number, a word for none, or neither."""
    out = melt(wide.select(F.col(f"`{feature}`").alias("feature_id"), *(f"`{c}`" for c in sample_columns(wide.columns, feature))), ["feature_id"], sample_columns(wide.columns, feature))
    return out.withColumn("note", F.when(~F.col("ok"), "not_numeric").when(F.col("value").isNull(), "missing").otherwise(""))


def long_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with value and state: the first usable row of a key is kept, later ones are duplicates (EPI006), unusable ones errors."""
    value, ok = number_strict(F.col("raw"))
    named = F.lit(True)
    for k in keys:
        named = named & (F.trim(F.coalesce(k, F.lit(""))) != "")
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("file_row"))
    state = F.when(~named, "missing_key").when(~ok, "not_numeric").when(nth > 1, "EPI006").otherwise("kept")
    return rows.withColumn("value", value).withColumn("state", state)


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The latest valid row of each key, and how many rows it stands for."""
    value, ok = number_strict(F.col("raw"))
    good = rows.withColumn("value", value).where(ok)
    by = Window.partitionBy(*keys)
    return good.withColumn("nth", F.row_number().over(by.orderBy(F.desc("file_row")))).withColumn("n_rows", F.count("*").over(by)).where("nth = 1").drop("nth")


def densify(cells: DataFrame, features: DataFrame, samples: DataFrame) -> DataFrame:
    """The full grid of features and samples of each dataset; absent cells are null."""
    grid = features.select("dataset_id", "feature_id").join(samples.select("dataset_id", "sample_id"), "dataset_id")
    return grid.join(cells, ["dataset_id", "feature_id", "sample_id"], "left")


def canonical_features(rows: DataFrame, samples: DataFrame) -> DataFrame:
    """Features over samples from long rows (dataset_id, feature_id, sample_id, raw, file_row, and optionally probe_id,
    peak_id, measured_id): the latest valid row of a cell, the full grid with nulls, and the measured identifier: the
    probe's, the peak's or the measured id of the feature's latest row that has one, else the feature's own id."""
    keys = ["dataset_id", "feature_id", "sample_id"]
    filled_ = lambda c: F.nullif(F.trim(c), F.lit("")) if c in rows.columns else F.lit(None).cast("string")
    own = F.coalesce(*(filled_(c) for c in ("probe_id", "peak_id", "measured_id")))
    features = rows.groupBy("dataset_id", "feature_id").agg(F.max_by(own, F.when(own.isNotNull(), F.col("file_row"))).alias("own"))
    grid = densify(latest(rows, keys).select(*keys, "value"), features, samples)
    return grid.join(features, ["dataset_id", "feature_id"]).withColumn("measured_identifier", F.coalesce("own", "feature_id")).drop("own")


#: What a row can be, in the order in which ties for the dominant class are broken.
ROW_CLASSES = ("cpg_methylation", "dmr", "atac_peak", "histone_mark_peak", "chromatin_interaction", "generic_region_feature", "ambiguous", "unknown")


def row_class(rows: DataFrame) -> DataFrame:
    """Feature class of each row from its filled columns, by assay ``family``: probe or region in DNA methylation; peak
    format, mark or plain region otherwise (an interaction if the ``modality`` is hic). Conflicts are ambiguous."""
    filled = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != ""
    area = filled("chrom") & filled("start") & filled("end")
    probe, mark, peak = filled("probe"), filled("mark"), filled("peak_format")
    methyl = F.when(probe & area, "ambiguous").when(probe, "cpg_methylation").when(area, "dmr").otherwise("unknown")
    other = (
        F.when(peak & mark, "ambiguous").when(peak, "atac_peak").when(mark, "histone_mark_peak")
        .when(area & (F.col("modality") == "hic"), "chromatin_interaction").when(area, "generic_region_feature").otherwise("unknown")
    )
    return rows.withColumn("row_class", F.when(F.col("family") == "dna_methylation", methyl).otherwise(other))


def mixed_tables(classified: DataFrame, order: tuple[str, ...] = ROW_CLASSES) -> DataFrame:
    """Per file: rows, classes, dominant class (ties by ``order``), and whether it is mixed."""
    per = classified.groupBy("file_id", "row_class").agg(F.count("*").alias("n"))
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("row_class"))
    first = F.row_number().over(Window.partitionBy("file_id").orderBy(F.desc("n"), rank))
    known = F.count_if(~F.col("row_class").isin("unknown", "ambiguous")).over(Window.partitionBy("file_id"))
    top = per.withColumn("k", first).withColumn("total", F.sum("n").over(Window.partitionBy("file_id"))).withColumn("classes", known)
    return top.where("k = 1").select("file_id", F.col("total").alias("n_rows"), F.col("row_class").alias("dominant"), "classes", (F.col("classes") > 1).alias("mixed"))


def mixed_policy(mixed: DataFrame, policy: str = "review_required") -> DataFrame:
    """What becomes of each file of ``mixed_tables``: proceed if it is not mixed, else as the policy says (block,
    review_required or split)."""
    action = {"block": "blocked", "review_required": "review_required", "split": "split_by_class"}[policy]
    return mixed.withColumn("action", F.when(F.col("mixed"), action).otherwise("proceed"))


def split_rows(classified: DataFrame, ruled: DataFrame) -> DataFrame:
    """Rows of files that are not blocked, with the part they go to: a table per class, unknown and ambiguous rows in parts of
    their own; rows without any indicator are warned of, ambiguous ones are errors."""
    rows = classified.join(ruled.where("action <> 'blocked'").select("file_id", "action"), "file_id")
    severity = F.when(F.col("row_class") == "ambiguous", "error").when(F.col("row_class") == "unknown", "warning")
    return rows.withColumn("part", F.concat_ws("/", "file_id", "row_class")).withColumn("severity", severity)


def constraint_findings(features: DataFrame) -> DataFrame:
    """Row and class constraints, one row per finding."""
    share = lambda c: (F.col(c) < 0) | (F.col(c) > 1)
    tests = [
        ("EPI_ANCHOR", F.col("chrom").isNull() & F.col("measured_identifier").isNull()),
        ("EPI_OTHER_TEXT", (F.col("signal_metric") == "declared_other") & F.col("declared_other").isNull()),
        ("EPI_REGION", F.col("feature_class").isin(*REGION_CLASSES) & F.col("chrom").isNull()),
        ("EPI_PROBABILITY", F.coalesce(share("p_value"), F.lit(False)) | F.coalesce(share("q_value"), F.lit(False))),
        ("EPI_ARRAY_PLATFORM", (F.col("feature_class") == "cpg_methylation") & (F.col("modality") == "dna_methylation_array") & F.col("platform").isNull()),
    ]
    found = F.array_compact(F.array(*(F.when(F.coalesce(hit, F.lit(False)), F.lit(code)) for code, hit in tests)))
    return features.select("dataset_id", "feature_id", F.explode(found).alias("code"))


_METHYL = ("beta_value", "m_value", "percent_methylation", "delta_beta", "delta_m")
_TESTED = ("effect_size", "q_value")
_PEAK = ("peak_score", "read_count", "normalized_signal", *_TESTED)
_READS = ("normalized_signal", *_TESTED, "read_count")
#: The metrics that each feature class may carry, besides declared_other.
ALLOWED = {
    "cpg_methylation": _METHYL,
    "dmr": (*_METHYL, *_TESTED),
    "differential_methylated_region": (*_METHYL, *_TESTED),
    "atac_peak": ("accessibility_signal", *_PEAK),
    "chip_peak_narrow": _PEAK,
    "chip_peak_broad": _PEAK,
    "histone_mark_peak": _PEAK,
    "generic_region_feature": ("accessibility_signal", *_PEAK),
    "chromatin_interaction": _READS,
    "ncrna_expression": _READS,
    "mirna_expression": _READS,
    "gene_linked_feature": (*_METHYL, "accessibility_signal", *_PEAK),
}


def allowed(spark: SparkSession) -> DataFrame:
    """(feature_class, signal_metric) pairs of the allowlist."""
    return spark.createDataFrame([(c, m) for c, ms in ALLOWED.items() for m in ms], "feature_class string, signal_metric string")


def incompatible(features: DataFrame, allowed: DataFrame) -> DataFrame:
    """Features whose (class, metric) pair is not in ``allowed``; declared_other is allowed everywhere."""
    return features.where("signal_metric <> 'declared_other'").join(allowed, ["feature_class", "signal_metric"], "left_anti")


def table_shape(files: DataFrame) -> DataFrame:
    """Shape of each file from its ``headers``: long, wide, summary or ambiguous by integer scores, and confidence."""
    keys = F.transform("headers", header_key)
    rows = files.withColumn("keys", keys)
    among = lambda words: F.size(F.filter("keys", lambda k: k.isin(*words)))
    rows = rows.select("file_id", among(FEATURE_NAMES).alias("f"), among(SAMPLE_NAMES).alias("s"), among(VALUE_NAMES).alias("v"), among(SUMMARY_NAMES).alias("m"),
        F.size(F.filter("keys", lambda k: ~k.isin(*FEATURE_NAMES, *SAMPLE_NAMES, *VALUE_NAMES, *SUMMARY_NAMES, *PLACE_NAMES))).alias("o"))
    i = lambda c: c.cast("int")
    f, s, v = F.col("f") > 0, F.col("s") > 0, F.col("v") > 0
    two, three = F.col("o") >= 2, F.col("o") >= 3
    long = i(f) + i(s) + i(v) + i(f & s & v)
    counter = F.when(two, F.when(F.col("m") == 0, 1).otherwise(-1) - i(F.col("m") >= 2) + F.when(v, -2).otherwise(1)).otherwise(0)
    wide = F.when(f, 1 + i(two) + i(three) + counter).otherwise(0)
    summ = F.when(f, 1 + F.least("m", F.lit(3)) - i(two) - i(three) - i(v)).otherwise(0)
    rows = rows.select("file_id", long.alias("long"), wide.alias("wide"), summ.alias("summary"))
    top = F.greatest("long", "wide", "summary")
    ties = i(F.col("long") == top) + i(F.col("wide") == top) + i(F.col("summary") == top)
    clear = (top > 0) & (ties == 1)
    shape = F.when(~clear, "ambiguous").when(F.col("long") == top, "long").when(F.col("wide") == top, "wide").otherwise("summary")
    sure = F.when(~clear, "low").when(top >= 4, "high").when(top >= 3, "medium").otherwise("low")
    return rows.select("file_id", "long", "wide", "summary", shape.alias("shape"), sure.alias("confidence"))


def group_statistics(rows: DataFrame, designs: DataFrame) -> DataFrame:
    """(dataset_id, feature_id, group, dose_value, mean, sd, n) from a map of column names such as Low_mean, low sd, LOW-N and
    texts, with the dose groups of ``designs`` (dataset_id, dose_group_id, dose_value).

    Names are read without case and separators; a metric without a group in front is none. Only finite numbers count (a blank
    text is 0), whole numbers of samples are rounded down, and of names that say the same the last one stays. A dose group
    whose id begins a name with a number is one of the feature's groups too, with or without statistics; other groups take
    the dose of the design's group of equal name. The groups of a design go to its features as one list, and all
    is worked out beside the feature.
    """
    told = designs.select("dataset_id", "dose_group_id", "dose_value").distinct()
    told = told.groupBy("dataset_id").agg(F.array_sort(F.collect_list(F.struct(F.col("dose_group_id").alias("id"), header_key(F.col("dose_group_id")).alias("key"), "dose_value"))).alias("told"))
    pattern = r"^(.*?)(mean|sd|se|stderr|n|median)$"
    long = rows.select("dataset_id", "feature_id", F.posexplode(F.map_entries("raw_values")).alias("place", "e")).select("dataset_id", "feature_id", "place", header_key(F.col("e.key")).alias("key"), F.col("e.value").alias("raw"))
    x = F.when(trimmed(F.col("raw")) == "", 0.0).otherwise(number_lenient(F.col("raw")))
    long = long.withColumn("x", x).where("x is not null")
    named = long.select("dataset_id", "feature_id", "place", F.regexp_extract("key", pattern, 1).alias("group"), F.regexp_extract("key", pattern, 2).alias("metric"), "x").where("metric <> '' and `group` <> ''")
    ids = ["dataset_id", "feature_id", "group"]
    pick = lambda m: F.max_by("x", F.when(F.col("metric") == m, F.col("place")))
    own = named.groupBy(*ids).agg(pick("mean").alias("mean"), pick("sd").alias("sd"), F.floor(pick("n")).cast("double").alias("n"))
    by_design = long.join(told, "dataset_id").select("dataset_id", "feature_id", F.explode(F.filter("told", lambda g: F.col("key").startswith(g["key"]))).alias("g"))
    matched = by_design.select("dataset_id", "feature_id", F.col("g.id").alias("group"), F.col("g.dose_value").alias("own_dose")).distinct()
    both = own.join(matched, ids, "full_outer").join(told, "dataset_id", "left")
    same = F.filter("told", lambda g: g["key"] == header_key(F.col("group")))
    return both.select(*ids, F.coalesce("own_dose", F.get(same, F.lit(0))["dose_value"]).alias("dose_value"), "mean", "sd", "n")


def summary_evidence(stats: DataFrame, designs: DataFrame) -> DataFrame:
    """Per feature, whether group statistics support a dose response: two group means or more, one of a group of the design
    whose dose is not zero. Features of data sets without a design, and all others, are exploratory."""
    groups = designs.select("dataset_id", F.col("dose_group_id").alias("group"), (F.col("dose_value") != 0).alias("treated")).distinct()
    rows = stats.join(groups, ["dataset_id", "group"], "left")
    per = rows.groupBy("dataset_id", "feature_id").agg(F.count("mean").alias("n_means"), F.count_if(F.col("mean").isNotNull() & F.col("treated")).alias("n_treated"))
    ok = (F.col("n_means") >= 2) & (F.col("n_treated") >= 1)
    return per.withColumn("supports", ok).withColumn("status", F.when(ok, "accepted_for_pod").otherwise("exploratory_only"))


def qualifications(evidence: DataFrame) -> DataFrame:
    """Evidence of summaries as decisions of features, as a hand-off takes them: nothing is mapped to genes."""
    warnings = F.col("warning") if "warning" in evidence.columns else F.lit(None).cast("string")
    return evidence.select(
        "dataset_id", "feature_id", "status", F.coalesce(warnings, F.lit("")).alias("notes"), F.lit("").alias("genes"), F.lit("none").alias("mapping_confidence"), F.lit("unknown").alias("mapping_method")
    )


#: What the key of a contrast holds, normalised, and how the label of a group begins.
CONTRAST_WORDS = ("contrast", "vs", "versus", "comparison", "diff", "change")
GROUP_LABEL = r"(?i)^(ctrl|control|low|mid|high|dose|treatment|group)"


def _contrast(key: Column) -> Column:
    return header_key(key).rlike("|".join(CONTRAST_WORDS))


def contrast_only(keys: DataFrame, samples: DataFrame) -> DataFrame:
    """Per feature, from its value keys: not contrast-only if more than half are samples; so if more than half look like
    contrasts, or all look like contrasts or labels of groups. Also whether all keys are samples, or dose groups."""
    ids = samples.select("dataset_id", F.col("sample_id").alias("key"), F.lit(1).alias("is_sample")).distinct()
    groups = samples.select("dataset_id", F.col("dose_group_id").alias("key"), F.lit(1).alias("is_group")).distinct()
    rows = keys.join(ids, ["dataset_id", "key"], "left").join(groups, ["dataset_id", "key"], "left")
    told, label = _contrast(F.col("key")), F.col("key").rlike(GROUP_LABEL)
    per = rows.groupBy("dataset_id", "feature_id").agg(
        F.avg(F.coalesce("is_sample", F.lit(0))).alias("s"), F.avg(told.cast("int")).alias("c"), F.bool_and(told | label).alias("labels"), F.avg(F.coalesce("is_group", F.lit(0))).alias("g")
    )
    only = F.when(F.col("s") > 0.5, False).otherwise((F.col("c") > 0.5) | F.col("labels"))
    return per.select("dataset_id", "feature_id", only.alias("contrast_only"), (F.col("g") == 1).alias("by_group"), (F.col("s") == 1).alias("by_sample"))


def evidence_type(features: DataFrame) -> DataFrame:
    """Per dataset of ``contrast_only`` rows, what more than half of its features are."""
    half = lambda c: F.avg(F.col(c).cast("int")) > 0.5
    kind = F.when(half("contrast_only"), "contrast_summary").when(half("by_group"), "group_summary").when(half("by_sample"), "per_sample").otherwise("ambiguous")
    return features.groupBy("dataset_id").agg(kind.alias("evidence"))


def contrast_evidence(values: DataFrame) -> DataFrame:
    """Per feature of (dataset_id, feature_id, key, value, nth): the last contrast, its first effect size and q-value (a
    value from 0 up to a half counts as one), and status; without dose groups all are exploratory."""
    rows = values.where(_contrast(F.col("key")) & F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") <= 1.7976931348623157e308))
    small = (F.col("value") >= 0) & (F.col("value") < 0.5)
    first = lambda hit, name: F.min_by(F.when(hit, F.col("value")), F.when(hit, F.col("nth"))).alias(name)
    per = rows.groupBy("dataset_id", "feature_id").agg(F.max_by("key", "nth").alias("contrast"), first(~small, "effect_size"), first(small, "q_value"))
    every = values.select("dataset_id", "feature_id").distinct().join(per, ["dataset_id", "feature_id"], "left")
    return every.withColumn("status", F.lit("exploratory_only")).withColumn("warning", F.lit("EPIW007_CONTRAST_ONLY_VALUES"))


#: Rows of an ingestion batch by default and at most.
BATCH, LARGEST_BATCH = 2_000, 5_000


def ingestion_result(rows: DataFrame, samples: DataFrame, provenance: DataFrame, detail: int = 20, batch: int = BATCH) -> DataFrame:
    """Per dataset of ``long_rows`` output: rows, features, samples, batches of ``batch`` rows, first and last
    feature, errors and warnings (duplicates), the first ``detail`` errors in file order, and whether it is ingested: it
    has data, a design, and provenance that names it."""
    if not 1 <= batch <= LARGEST_BATCH:
        raise ValueError(f"a batch has 1 to {LARGEST_BATCH} rows")
    kept = F.when(F.col("state") == "kept", F.col("feature_id"))
    bad = F.when(~F.col("state").isin("kept", "EPI006"), F.struct("file_row", F.concat_ws(":", F.col("state"), F.coalesce("feature_id", F.lit("")))).alias("e"))
    per = rows.groupBy("dataset_id").agg(
        F.count("*").alias("n_rows"), F.countDistinct(kept).alias("n_features"), F.countDistinct("sample_id").alias("n_samples"), F.ceil(F.count("*") / batch).alias("n_batches"),
        F.min_by("feature_id", "file_row").alias("first_feature"), F.max_by("feature_id", "file_row").alias("last_feature"),
        F.count(bad).alias("n_errors"), F.count_if(F.col("state") == "EPI006").alias("n_warnings"),
    )
    # the first few errors of a data set: ranked within it, so no list grows with the errors
    order = Window.partitionBy("dataset_id").orderBy("file_row")
    few = rows.where(bad.isNotNull()).withColumn("k", F.row_number().over(order)).where(F.col("k") <= detail)
    texts = few.groupBy("dataset_id").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("k", "state"))), lambda x: x["state"])).alias("first_errors"))
    designs = samples.select("dataset_id").distinct().withColumn("has_design", F.lit(True))
    known = provenance.select("dataset_id").distinct().withColumn("has_provenance", F.lit(True))
    out = per.join(texts, "dataset_id", "left").join(designs, "dataset_id", "left").join(known, "dataset_id", "left")
    on = lambda c: F.coalesce(c, F.lit(False))
    return out.select(*per.columns, F.coalesce("first_errors", F.lit("")).alias("first_errors"), ((F.col("n_features") > 0) & on("has_design") & on("has_provenance")).alias("ingested"))
