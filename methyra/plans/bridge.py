"""Views of the given tables as measurements, studies, regions, genes and assays, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chromosomes

DOSES = (0.0, 1.0, 10.0, 100.0)


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dose(k):
    return F.element_at(F.array(*map(F.lit, DOSES)), (k + 1).cast("int"))


def cells(spark: SparkSession, sf_dir: str, k: int = 12) -> DataFrame:
    rows = t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p"), (F.col("l_suppkey") % k).alias("s"), "l_discount")
    per = rows.groupBy("p", "s").agg(F.round(F.avg("l_discount"), 6).alias("value"))
    return per.select(F.concat(F.lit("DS"), F.col("p") % 5).alias("dataset_id"), F.concat(F.lit("F"), "p").alias("feature_id"), F.concat(F.lit("S"), "s").alias("sample_id"), "value")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p")).distinct()
    return p.select(F.concat(F.lit("DS"), F.col("p") % 5).alias("dataset_id"), F.concat(F.lit("F"), "p").alias("feature_id"))


def samples(spark: SparkSession, sf_dir: str, k: int = 12, groups: int = 4) -> DataFrame:
    """The samples that the cells of a dataset have."""
    rows = t(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 5).alias("d"), (F.col("l_suppkey") % k).alias("s")).distinct()
    g = F.col("s") % groups
    return rows.select(
        F.concat(F.lit("DS"), "d").alias("dataset_id"), F.concat(F.lit("S"), "s").alias("sample_id"), F.concat(F.lit("D"), g).alias("dose_group_id"), _dose(g).alias("dose_value"),
        F.lit("uM").alias("dose_unit"), F.lit(24.0).alias("timepoint_hours"), F.when(F.col("s") == 11, "technical").otherwise("biological").alias("replicate_type"),
        F.concat(F.lit("B"), F.when(F.col("d") == 0, g).otherwise(F.floor(F.col("s") / groups) % 2)).alias("batch_id"), (g == 0).alias("control_flag"),
    )


CELLS = """cells AS (SELECT 'DS' || (p % 5) AS dataset_id, 'F' || p AS feature_id, 'S' || s AS sample_id, v AS value FROM
  (SELECT l_partkey AS p, l_suppkey % {k} AS s, round(avg(l_discount), 6) AS v FROM lineitem GROUP BY 1, 2)),
features AS (SELECT DISTINCT 'DS' || (l_partkey % 5) AS dataset_id, 'F' || l_partkey AS feature_id FROM lineitem),
samples AS (SELECT 'DS' || d AS dataset_id, 'S' || s AS sample_id, 'D' || (s % {g}) AS dose_group_id, [0.0, 1.0, 10.0, 100.0][s % {g} + 1]::DOUBLE AS dose_value,
  CASE WHEN s = 11 THEN 'technical' ELSE 'biological' END AS replicate_type, 'B' || (CASE WHEN d = 0 THEN s % {g} ELSE (s // {g}) % 2 END) AS batch_id
  FROM (SELECT DISTINCT l_partkey % 5 AS d, l_suppkey % {k} AS s FROM lineitem))"""
CELLS12, CELLS9 = CELLS.format(k=12, g=4), CELLS.format(k=9, g=3)


def trend_samples(spark: SparkSession, sf_dir: str, k: int, groups: int) -> DataFrame:
    """``samples`` of one batch, but for data set DS3 with several; DS4 has a technical sample."""
    d = F.col("dataset_id")
    kind = F.when((d == "DS4") & (F.col("sample_id") == "S0"), "technical").otherwise("biological")
    return samples(spark, sf_dir, k, groups).withColumn("batch_id", F.when(d == "DS3", F.col("batch_id")).otherwise("B0")).withColumn("replicate_type", kind)


TREND_SAMPLES = """ts AS (SELECT dataset_id, sample_id, dose_group_id, dose_value, 'uM' AS dose_unit, 24.0 AS timepoint_hours, CASE WHEN dataset_id = 'DS3' THEN batch_id ELSE 'B0' END AS batch_id,
  CASE WHEN dataset_id = 'DS4' AND sample_id = 'S0' THEN 'technical' ELSE 'biological' END AS replicate_type FROM samples)"""


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many small studies: a customer is a study, its orders are the samples."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    return t(spark, sf_dir, "orders").select(
        F.concat(F.lit("C"), c).alias("dataset_id"), F.concat(F.lit("O"), o).alias("sample_id"), F.concat(F.lit("G"), o % 4).alias("dose_group_id"), _dose(o % 4).alias("dose_value"),
        F.when((c % 7 == 0) & (o % 4 == 3), "mM").when((c % 13 == 0) & (o % 4 == 2), " ").otherwise("uM").alias("dose_unit"), F.when(c % 5 == 0, F.floor((o % 8) / 4) * 24.0).otherwise(24.0).alias("timepoint_hours"),
        F.when(o % 9 == 0, "technical").when(o % 9 == 1, "pooled").when(o % 9 != 2, "biological").alias("replicate_type"),
        F.when(o % 11 != 0, F.concat(F.lit("B"), F.when(c % 3 == 0, o % 4).otherwise(o % 2))).alias("batch_id"), (o % 4 == 0).alias("control_flag"),
    )


REGISTRY = """reg AS (SELECT 'C' || o_custkey AS dataset_id, 'O' || o_orderkey AS sample_id, 'G' || (o_orderkey % 4) AS dose_group_id,
  [0.0, 1.0, 10.0, 100.0][o_orderkey % 4 + 1]::DOUBLE AS dose_value, CASE WHEN o_custkey % 7 = 0 AND o_orderkey % 4 = 3 THEN 'mM' WHEN o_custkey % 13 = 0 AND o_orderkey % 4 = 2 THEN ' ' ELSE 'uM' END AS dose_unit,
  CASE WHEN o_custkey % 5 = 0 THEN ((o_orderkey % 8) // 4) * 24.0 ELSE 24.0 END::DOUBLE AS timepoint_hours,
  CASE WHEN o_orderkey % 9 = 0 THEN 'technical' WHEN o_orderkey % 9 = 1 THEN 'pooled' WHEN o_orderkey % 9 <> 2 THEN 'biological' END AS replicate_type,
  CASE WHEN o_orderkey % 11 <> 0 THEN 'B' || (CASE WHEN o_custkey % 3 = 0 THEN o_orderkey % 4 ELSE o_orderkey % 2 END) END AS batch_id, o_orderkey % 4 = 0 AS control_flag
  FROM orders)"""


_CLASSES = ("cpg_methylation", "dmr", "generic_region_feature", "atac_peak", "chip_peak_narrow", "chip_peak_broad", "histone_mark_peak", "chromatin_interaction")
_METRICS = ("beta_value", "peak_score", "read_count", "declared_other", "effect_size", "accessibility_signal")
_MODALITIES = ("dna_methylation_array", "atac_seq", "chip_seq", "hic")


def word(k, *ws: str | None):
    """The k-th of some words, counted around."""
    return F.element_at(F.array(*(F.lit(w) for w in ws)), (k % len(ws) + 1).cast("int"))


def regions(spark: SparkSession, sf_dir: str, folded: bool = False) -> DataFrame:
    """Regions; ``folded`` leaves all starts in one million bases, where each of them meets more genes as there are more."""
    p = F.col("p_partkey")
    start = (F.lit(0) if folded else F.floor(p / 20_000) % 200 * 1_000_000) + (p * 7919) % 1_000_000 + F.when(p % 43 == 0, 300_000_000).otherwise(0)
    return t(spark, sf_dir, "part").select(
        F.concat(F.lit("DS"), p % 5).alias("dataset_id"), F.concat(F.lit("P"), p).alias("feature_id"), word(p, *_CLASSES).alias("feature_class"), word(p, *_MODALITIES).alias("modality"),
        F.when(p % 53 == 0, "chrUn").when(p % 47 == 0, (1 + p % 22).cast("string")).when(p % 17 != 0, F.concat(F.lit("chr"), 1 + p % 22)).alias("chrom"), start.alias("start"),
        (start + F.when(p % 61 == 0, 0).otherwise(200 + F.col("p_size") * 10)).alias("end"),
        F.when(p % 5 == 4, word(p, "hg38", "mm10")).when(p % 13 != 0, F.when(p % 29 == 0, "hg17").otherwise("hg38")).alias("build"),
        F.when(p % 19 == 0, "gff_gtf_1based_closed").when(p % 31 == 0, "platform_native_probe").when(p % 37 == 0, "no_coordinates_feature_id_only").when(p % 41 == 0, "bed").when(p % 23 != 0, "ucsc_bed_0based_half_open").alias("coord_system"),
        F.when(p % 3 != 0, F.concat(F.lit("cg"), p)).alias("measured_identifier"), F.when(p % 7 != 0, "450k").alias("platform"), F.when(p % 9 != 0, "1.2").alias("manifest_version"), F.when(p % 11 != 0, "ab12").alias("annotation_hash"),
        word(F.floor(p / 3), *_METRICS).alias("signal_metric"), F.when(p % 8 != 3, "x").alias("declared_other"), (F.col("p_size") / 45.0).alias("p_value"), (F.col("p_size") / 48.0).alias("q_value"),
    )


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


REGIONS = f"""regions AS (SELECT *, r_start AS "start", r_start + CASE WHEN p % 61 = 0 THEN 0 ELSE 200 + p_size * 10 END AS "end" FROM (SELECT p_partkey AS p, p_size, 'DS' || (p_partkey % 5) AS dataset_id, 'P' || p_partkey AS feature_id,
  {_list(_CLASSES)}[p_partkey % 8 + 1] AS feature_class, {_list(_MODALITIES)}[p_partkey % 4 + 1] AS modality,
  CASE WHEN p_partkey % 53 = 0 THEN 'chrUn' WHEN p_partkey % 47 = 0 THEN (1 + p_partkey % 22)::VARCHAR WHEN p_partkey % 17 <> 0 THEN 'chr' || (1 + p_partkey % 22) END AS chrom, p_partkey // 20000 % 200 * 1000000 + (p_partkey * 7919) % 1000000 + CASE WHEN p_partkey % 43 = 0 THEN 300000000 ELSE 0 END AS r_start,
  CASE WHEN p_partkey % 5 = 4 THEN ['hg38', 'mm10'][p_partkey % 2 + 1] WHEN p_partkey % 13 <> 0 THEN CASE WHEN p_partkey % 29 = 0 THEN 'hg17' ELSE 'hg38' END END AS build,
  CASE WHEN p_partkey % 19 = 0 THEN 'gff_gtf_1based_closed' WHEN p_partkey % 31 = 0 THEN 'platform_native_probe' WHEN p_partkey % 37 = 0 THEN 'no_coordinates_feature_id_only' WHEN p_partkey % 41 = 0 THEN 'bed' WHEN p_partkey % 23 <> 0 THEN 'ucsc_bed_0based_half_open' END AS coord_system,
  CASE WHEN p_partkey % 3 <> 0 THEN 'cg' || p_partkey END AS measured_identifier, CASE WHEN p_partkey % 7 <> 0 THEN '450k' END AS platform, CASE WHEN p_partkey % 9 <> 0 THEN '1.2' END AS manifest_version, CASE WHEN p_partkey % 11 <> 0 THEN 'ab12' END AS annotation_hash,
  {_list(_METRICS)}[(p_partkey // 3) % 6 + 1] AS signal_metric, CASE WHEN p_partkey % 8 <> 3 THEN 'x' END AS declared_other, p_size / 45.0 AS p_value, p_size / 48.0 AS q_value FROM part))"""


def genes(spark: SparkSession, sf_dir: str, folded: bool = False) -> DataFrame:
    o = F.col("o_orderkey")
    start = (F.lit(0) if folded else F.floor(o / 150_000) % 200 * 1_000_000) + (o * 104729) % 1_000_000  # so many keys to a million bases, as of regions
    return t(spark, sf_dir, "orders").select(F.concat(F.lit("G"), o).alias("gene_id"), F.concat(F.lit("chr"), 1 + o % 21).alias("chrom"), start.alias("start"), (start + 1000 + (o % 50) * 100).alias("end"), F.when(o % 2 == 0, "+").otherwise("-").alias("strand"))


GENES = """genes AS (SELECT 'G' || o_orderkey AS gene_id, 'chr' || (1 + o_orderkey % 21) AS chrom, o_orderkey // 150000 % 200 * 1000000 + (o_orderkey * 104729) % 1000000 AS "start", o_orderkey // 150000 % 200 * 1000000 + (o_orderkey * 104729) % 1000000 + 1000 + (o_orderkey % 50) * 100 AS "end",
  CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand FROM orders)"""


FOLDED_REGIONS, FOLDED_GENES = REGIONS.replace("p_partkey // 20000 % 200 * 1000000 + ", ""), GENES.replace("o_orderkey // 150000 % 200 * 1000000 + ", "")


SIZES = "sizes(build, chrom, length) AS (VALUES " + ", ".join(f"('{b}', '{c}', {n})" for b, c, n in chromosomes.rows()) + ")"


def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of upstream work: a supplier is a step of the data set supplier % 5."""
    k = F.col("s_suppkey")
    return t(spark, sf_dir, "supplier").select(F.concat(F.lit("DS"), k % 5).alias("dataset_id"), k.alias("step_no"), word(k, "align", "LiftOver hg19", "call peaks", "normalise").alias("step_name"), word(k, "bwa", "ucsc", "macs2", "crossMap").alias("tool_name"))


PROVENANCE = "prov AS (SELECT 'DS' || (s_suppkey % 5) AS dataset_id, s_suppkey AS step_no, ['align', 'LiftOver hg19', 'call peaks', 'normalise'][s_suppkey % 4 + 1] AS step_name, ['bwa', 'ucsc', 'macs2', 'crossMap'][s_suppkey % 4 + 1] AS tool_name FROM supplier)"


def fractions(spark: SparkSession, sf_dir: str, n: int = 30, name: str = "U") -> DataFrame:
    """Cell fractions: event types as cell types, shares of a user's values; a user is a sample of the study user % n."""
    e = t(spark, sf_dir, "events")
    per = e.groupBy("user_id", "event_type").agg(F.sum("value").alias("v"))
    whole = e.groupBy("user_id").agg(F.sum("value").alias("w"))
    k = F.col("user_id") % n
    return per.join(whole, "user_id").select(F.concat(F.lit(name), k).alias("dataset_id"), F.concat(F.lit("S"), "user_id").alias("sample_id"), F.col("event_type").alias("cell_type"),
        F.when(k % 9 == 4, F.col("v") / F.col("w") * 1.2).otherwise(F.col("v") / F.col("w")).alias("fraction"))


def users(spark: SparkSession, sf_dir: str, n: int = 30, name: str = "U") -> DataFrame:
    u = t(spark, sf_dir, "events").select("user_id").distinct()
    g = F.floor(F.col("user_id") / n) % 3
    return u.select(F.concat(F.lit(name), F.col("user_id") % n).alias("dataset_id"), F.concat(F.lit("S"), "user_id").alias("sample_id"), F.concat(F.lit("D"), g).alias("dose_group_id"), _dose(g).alias("dose_value"))


def declarations(spark: SparkSession, sf_dir: str, n: int = 30, name: str = "U") -> DataFrame:
    """Where the composition of each user's sample comes from; most studies are of one kind, some contradict themselves."""
    u = t(spark, sf_dir, "events").select("user_id").distinct()
    k, odd = F.col("user_id") % n, F.floor(F.col("user_id") / n) % 2 == 1
    source = (
        F.when(k % 7 == 1, "declared_pure").when(k % 7 == 2, "declared_mixed_unknown_fractions").when((k % 7 == 3) & odd, "not_declared").when((k % 7 == 5) & odd, "declared_mixed_unknown_fractions")
        .when(k % 7 == 6, "measured_sorting").otherwise("measured_flow_cytometry")
    )
    return u.select(F.concat(F.lit(name), k).alias("dataset_id"), F.concat(F.lit("S"), "user_id").alias("sample_id"), source.alias("source"), F.when(k % 7 == 1, F.when((k == 8) & odd, "glia").otherwise("neuron")).alias("declared_cell_type"))


def _fractions(n: int, name: str) -> str:
    return f"""fractions AS (SELECT '{name}' || (user_id % {n}) AS dataset_id, 'S' || user_id AS sample_id, event_type AS cell_type,
  sum(value) / any_value(w) * (CASE WHEN user_id % {n} % 9 = 4 THEN 1.2 ELSE 1.0 END) AS fraction
  FROM events JOIN (SELECT user_id, sum(value) AS w FROM events GROUP BY 1) USING (user_id) GROUP BY user_id, event_type),
users AS (SELECT DISTINCT '{name}' || (user_id % {n}) AS dataset_id, 'S' || user_id AS sample_id, 'D' || ((user_id // {n}) % 3) AS dose_group_id, [0.0, 1.0, 10.0][(user_id // {n}) % 3 + 1]::DOUBLE AS dose_value FROM events),
told AS (SELECT DISTINCT '{name}' || (user_id % {n}) AS dataset_id, 'S' || user_id AS sample_id, CASE user_id % {n} % 7 WHEN 1 THEN 'declared_pure' WHEN 2 THEN 'declared_mixed_unknown_fractions' WHEN 6 THEN 'measured_sorting'
  WHEN 3 THEN CASE WHEN (user_id // {n}) % 2 = 1 THEN 'not_declared' ELSE 'measured_flow_cytometry' END WHEN 5 THEN CASE WHEN (user_id // {n}) % 2 = 1 THEN 'declared_mixed_unknown_fractions' ELSE 'measured_flow_cytometry' END ELSE 'measured_flow_cytometry' END AS source,
  CASE WHEN user_id % {n} % 7 = 1 THEN CASE WHEN user_id % {n} = 8 AND (user_id // {n}) % 2 = 1 THEN 'glia' ELSE 'neuron' END END AS declared_cell_type FROM events)"""


FRACTIONS, DS_FRACTIONS = _fractions(30, "U"), _fractions(5, "DS")


def assays(spark: SparkSession, sf_dir: str, n: int = 30, name: str = "U") -> DataFrame:
    e, u, k = t(spark, sf_dir, "events"), F.col("user_id"), F.col("user_id") % n
    return e.select(
        F.concat(F.lit(name), k).alias("dataset_id"), F.col("event_id").alias("entry_no"), F.when(F.col("event_type") == "click", "apoptosis_necrosis").otherwise("viability").alias("metric"), F.when(F.col("event_id") % 3 == 0, "declared").otherwise("measured").alias("evidence_source"),
        F.when((F.col("event_id") % 499 == 0) & (k % 5 == 4), -F.col("value")).when(F.col("event_type") == "click", F.col("value") / 1000).otherwise(0.45 + k / (2.0 * n) + F.col("value") / 1000).alias("value"),
        ((k == 7) & (F.col("event_type") == "error")).cast("int").alias("n_stress"), F.when((k == 9) | ((k == 11) & (F.col("event_id") % 3 != 0)), "Cytotoxic above 10").alias("notes"),
        _dose(F.col("event_id") % 4).alias("dose_value"), F.lit(24.0).alias("timepoint_hours"),
    )


def _assays(n: int, name: str) -> str:
    return f"""assays AS (SELECT '{name}' || (user_id % {n}) AS dataset_id, event_id AS entry_no, CASE WHEN event_type = 'click' THEN 'apoptosis_necrosis' ELSE 'viability' END AS metric, CASE WHEN event_id % 3 = 0 THEN 'declared' ELSE 'measured' END AS evidence_source,
  CASE WHEN event_id % 499 = 0 AND user_id % {n} % 5 = 4 THEN -value WHEN event_type = 'click' THEN value / 1000 ELSE 0.45 + (user_id % {n}) / {2 * n}.0 + value / 1000 END AS value,
  (user_id % {n} = 7 AND event_type = 'error')::INT AS n_stress, CASE WHEN user_id % {n} = 9 OR user_id % {n} = 11 AND event_id % 3 <> 0 THEN 'Cytotoxic above 10' END AS notes, [0.0, 1.0, 10.0, 100.0][event_id % 4 + 1]::DOUBLE AS dose_value, 24.0 AS timepoint_hours FROM events)"""


ASSAYS, DS_ASSAYS = _assays(30, "U"), _assays(5, "DS")


def raw_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long rows of texts with repeated keys and unusable numbers."""
    li, o = t(spark, sf_dir, "lineitem"), F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return li.select(
        F.concat(F.lit("DS"), F.col("l_partkey") % 5).alias("dataset_id"), F.concat(F.lit("F"), "l_partkey").alias("feature_id"), F.when(o % 97 != 0, F.concat(F.lit("S"), F.col("l_suppkey") % 12)).otherwise(" ").alias("sample_id"),
        F.when(o % 31 == 0, " NA ").when(o % 37 == 0, "12d").when(o % 41 == 0, "inf").when(o % 43 == 0, "1e400").otherwise(F.col("l_quantity").cast("int").cast("string")).alias("raw"),
        F.struct(o.alias("o"), F.col("l_partkey"), "l_suppkey", "l_extendedprice", "l_discount", "l_tax").alias("file_row"),
    )


RAW = """raw_cells AS (SELECT 'DS' || (l_partkey % 5) AS dataset_id, 'F' || l_partkey AS feature_id, CASE WHEN o % 97 <> 0 THEN 'S' || (l_suppkey % 12) ELSE ' ' END AS sample_id,
  CASE WHEN o % 31 = 0 THEN ' NA ' WHEN o % 37 = 0 THEN '12d' WHEN o % 41 = 0 THEN 'inf' WHEN o % 43 = 0 THEN '1e400' ELSE l_quantity::INT::VARCHAR END AS raw, o, l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax
  FROM (SELECT *, l_orderkey * 8 + l_linenumber AS o FROM lineitem))"""
