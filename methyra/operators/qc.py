"""Missingness, variability and replicate agreement of measurements.

Measurements are (dataset_id, feature_id, sample_id, value); samples are (dataset_id, sample_id, dose_group_id, ...).
A cell that is null, NaN or absent counts as missing. Sample registries are small beside measurements and are joined
by whatever join Spark finds cheapest; nothing is broadcast by hand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WARN, EXCLUDE = 0.05, 0.2


def band(fraction: Column, warn: float = WARN, exclude: float = EXCLUDE) -> Column:
    return F.when(fraction >= exclude, "exclusion").when(fraction >= warn, "warning").otherwise("acceptable")


def present(value: str = "value") -> Column:
    return F.col(value).isNotNull() & ~F.isnan(value)


def missingness(cells: DataFrame, features: DataFrame, samples: DataFrame, warn: float = WARN, exclude: float = EXCLUDE) -> DataFrame:
    """(dataset_id, level, key, n_cells, n_missing, fraction, band) at the levels feature, sample, group and dataset.

    Counts of present cells come from one pass with grouping sets; the full grid of features and samples is counted, not
    built. A group in which some feature is wholly missing has the band exclusion.
    """
    on = ["dataset_id", "sample_id"]
    known = cells.where(present()).join(features.select("dataset_id", "feature_id"), ["dataset_id", "feature_id"], "left_semi").join(samples.select(*on, "dose_group_id"), on)
    sizes = samples.groupBy("dataset_id").agg(F.count("*").alias("n_samples"))
    totals = features.groupBy("dataset_id").agg(F.count("*").alias("n_features"))
    d, f, s, g = (F.col(c) for c in ("dataset_id", "feature_id", "sample_id", "dose_group_id"))
    first = known.groupingSets([[d, f, g], [d, s]], d, f, s, g).agg(F.grouping_id().alias("level"), F.count("*").alias("n_present"))
    # the other levels, and how many features each group saw, come from the counts by feature and group
    counts = first.where("level = 2")
    sets = counts.groupingSets([[d, f], [d, g], [d]], d, f, g).agg(F.grouping_id().alias("g"), F.sum("n_present").alias("n_present"), F.count("*").alias("n_seen"))
    level = F.when(F.col("g") == 1, "feature").when(F.col("g") == 2, "group").otherwise("dataset")
    got = sets.select("dataset_id", level.alias("level"), F.coalesce("feature_id", "dose_group_id", "dataset_id").alias("key"), "n_present", "n_seen")
    got = got.unionByName(first.where("level = 5").select("dataset_id", F.lit("sample").alias("level"), F.col("sample_id").alias("key"), "n_present", F.lit(None).cast("long").alias("n_seen")))
    groups = samples.groupBy("dataset_id", "dose_group_id").agg(F.count("*").alias("n_group"))
    none = F.lit(None).cast("long").alias("n_features")
    wanted = (
        features.join(sizes, "dataset_id").select("dataset_id", F.lit("feature").alias("level"), F.col("feature_id").alias("key"), F.col("n_samples").alias("n_cells"), none)
        .unionByName(samples.join(totals, "dataset_id").select("dataset_id", F.lit("sample").alias("level"), F.col("sample_id").alias("key"), F.col("n_features").alias("n_cells"), none))
        .unionByName(groups.join(totals, "dataset_id").select("dataset_id", F.lit("group").alias("level"), F.col("dose_group_id").alias("key"), (F.col("n_group") * F.col("n_features")).alias("n_cells"), "n_features"))
        .unionByName(totals.join(sizes, "dataset_id").select("dataset_id", F.lit("dataset").alias("level"), F.col("dataset_id").alias("key"), (F.col("n_samples") * F.col("n_features")).alias("n_cells"), none))
    )
    keys = ["dataset_id", "level", "key"]
    out = wanted.join(got, keys, "left").withColumn("n_missing", F.col("n_cells") - F.coalesce("n_present", F.lit(0)))
    fraction = F.coalesce(F.try_divide("n_missing", "n_cells"), F.lit(0.0))
    dropout = F.coalesce("n_seen", F.lit(0)) < F.col("n_features")
    return out.select(*keys, "n_cells", "n_missing", fraction.alias("fraction"), F.when(dropout, "exclusion").otherwise(band(fraction, warn, exclude)).alias("band"))


def design_flags(samples: DataFrame) -> DataFrame:
    """Per dataset, what the design has: sufficient_replicates, dose_range_declared, controls_present, batch_known."""
    groups = samples.groupBy("dataset_id", "dose_group_id").agg(F.count("*").alias("k")).groupBy("dataset_id").agg((F.min("k") >= 2).alias("sufficient_replicates"), (F.count("*") >= 2).alias("dose_range_declared"))
    whole = samples.groupBy("dataset_id").agg(F.bool_or((F.col("dose_value") == 0) | F.coalesce("control_flag", F.lit(False))).alias("controls_present"), F.bool_or(F.col("batch_id").isNotNull()).alias("batch_known"))
    return groups.join(whole, "dataset_id")


def simple_qc(cells: DataFrame, samples: DataFrame) -> DataFrame:
    """Per dataset: share of features with a missing recorded value, the design's flags, and whether it passes (a share of at
    most 0.1, with replicates, doses and controls)."""
    per = cells.groupBy("dataset_id", "feature_id").agg(F.bool_or(~present()).alias("gap"))
    whole = per.groupBy("dataset_id").agg(F.count("*").alias("n_features"), F.count_if("gap").alias("n_incomplete"))
    rate = F.try_divide("n_incomplete", "n_features")
    out = whole.join(design_flags(samples), "dataset_id")
    passed = (rate <= 0.1) & F.col("sufficient_replicates") & F.col("dose_range_declared") & F.col("controls_present")
    return out.select("dataset_id", "n_features", "n_incomplete", rate.alias("rate"), "sufficient_replicates", "dose_range_declared", "controls_present", "batch_known", passed.alias("passed"))


def variance(cells: DataFrame) -> DataFrame:
    """Per feature: n, mean, variance (0 for fewer than two values), coefficient of variation, dynamic-range band. The band looks
    at 15 places of the variance, so a value on a limit does not fall to the order in which it was summed."""
    per = cells.where(present()).groupBy("dataset_id", "feature_id").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.var_samp("value").alias("v"))
    v = F.when(F.col("n") < 2, 0.0).otherwise(F.col("v"))
    cv = F.when(F.abs("mean") >= 1e-12, F.sqrt(v) / F.abs("mean"))
    told = F.round(v, 15)
    level = F.when(F.col("n") < 2, "not_applicable").when(told >= 0.01, "high").when(told >= 0.001, "moderate").otherwise("low")
    return per.select("dataset_id", "feature_id", "n", "mean", v.alias("variance"), cv.alias("cv"), level.alias("dynamic_range"))


#: Samples of a block, numbers of a dense block of features, and numbers of partial matrices that a task holds.
BLOCK, DENSE, HELD = 1024, 1 << 22, 1 << 25
_MOMENTS = "n long, mx double, my double, cxx double, cyy double, cxy double"


class _Moments:
    """Sums over features for all pairs of samples of two blocks, about a shift near each sample's values."""

    def __init__(self, left: int, right: int):
        self.shift = [np.full(left, np.nan), np.full(right, np.nan)]
        self.n, self.sx, self.sy, self.sxx, self.syy, self.sxy = (np.zeros((left, right)) for _ in range(6))

    def add(self, sides: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Values (zero where missing) and marks of presence, features by samples, of both blocks."""
        moved = []
        for shift, (x, mark) in zip(self.shift, sides):
            seen = mark.sum(0)
            new = np.isnan(shift) & (seen > 0)
            shift[new] = x.sum(0)[new] / seen[new]
            moved.append(np.where(mark > 0, x - np.nan_to_num(shift), 0.0))
        (a, b), (p, q) = moved, (sides[0][1], sides[1][1])
        self.n += p.T @ q
        self.sx += a.T @ q
        self.sy += p.T @ b
        self.sxx += (a * a).T @ q
        self.syy += p.T @ (b * b)
        self.sxy += a.T @ b

    def rows(self, same: bool) -> tuple[np.ndarray, ...]:
        """(i, j, n, means, co-moments) of the pairs with common features; i < j within one block."""
        i, j = np.nonzero(np.triu(self.n, 1) if same else self.n)
        n, sx, sy = self.n[i, j], self.sx[i, j], self.sy[i, j]
        centred = (x[i, j] - u * v / n for x, u, v in ((self.sxx, sx, sx), (self.syy, sy, sy), (self.sxy, sx, sy)))
        return (i, j, n.astype(np.int64), self.shift[0][i] + sx / n, self.shift[1][j] + sy / n, *centred)


def _partial_moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial moments of rows (dataset_id, dose_group_id, n_own, xs), xs being the (number, value) of a feature's samples."""
    held: dict[tuple, _Moments] = {}

    def out(key: tuple) -> pa.RecordBatch:
        ds, group, bi, bj = key
        i, j, *rest = held.pop(key).rows(bi == bj)
        ids = [pa.array([x] * len(i), pa.string()) for x in (ds, group)]
        return pa.RecordBatch.from_arrays([*ids, *map(pa.array, (i + bi * BLOCK, j + bj * BLOCK, *rest))], names=["dataset_id", "dose_group_id", "s1", "s2", *(x.split()[0] for x in _MOMENTS.split(", "))])

    for b in batches:
        keys = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()))
        xs = b.column(3)
        offsets, flat = xs.offsets.to_numpy(), xs.values
        number, value = flat.field(0).to_numpy(False), flat.field(1).to_numpy(False)
        for ds, group, k in sorted(set(keys), key=str):
            mine = np.array([i for i, x in enumerate(keys) if x == (ds, group, k)])
            for chunk in np.array_split(mine, -(-len(mine) * min(k, BLOCK) // DENSE)):
                row = np.repeat(np.arange(len(chunk)), offsets[chunk + 1] - offsets[chunk])
                at = np.concatenate([np.arange(offsets[i], offsets[i + 1]) for i in chunk])
                col, val = number[at], value[at]
                dense = []
                for start in range(0, k, BLOCK):
                    width = min(BLOCK, k - start)
                    own = (col >= start) & (col < start + width)
                    x, mark = np.zeros((2, len(chunk), width))
                    x[row[own], col[own] - start] = val[own]
                    mark[row[own], col[own] - start] = 1
                    dense.append((x, mark))
                for i, left in enumerate(dense):
                    for j, right in enumerate(dense[i:], i):
                        key = (ds, group, i, j)
                        if key not in held:
                            if sum(m.n.size * 6 for m in held.values()) > HELD:
                                yield from map(out, list(held))
                            held[key] = _Moments(left[0].shape[1], right[0].shape[1])
                        held[key].add([left, right])
    yield from map(out, list(held))


def _added(a: Column, b: Column) -> Column:
    """Moments of two parts together."""
    n = a["n"] + b["n"]
    dx, dy, share = b["mx"] - a["mx"], b["my"] - a["my"], a["n"] * b["n"] / n
    parts = {
        "n": n, "mx": a["mx"] + dx * b["n"] / n, "my": a["my"] + dy * b["n"] / n,
        "cxx": a["cxx"] + b["cxx"] + dx * dx * share, "cyy": a["cyy"] + b["cyy"] + dy * dy * share, "cxy": a["cxy"] + b["cxy"] + dx * dy * share,
    }
    return F.struct(*(v.alias(k) for k, v in parts.items()))


def sample_moments(cells: DataFrame, samples: DataFrame) -> DataFrame:
    """(dataset_id, dose_group_id, s1, s2, n, means and co-moments) of every pair of samples of a group over the features that
    both have; s1 and s2 number the group's samples in order of id.

    One shuffle brings the values of a feature and group together. Tasks turn features into dense blocks of samples and take
    the sums of all pairs at once as products of matrices, so no row is made for a pair and a feature. A task sends one row
    for each pair and the parts are added up; the features of a group are dealt over as many parts as there are partitions.
    """
    of = Window.partitionBy("dataset_id", "dose_group_id")
    own = samples.select("dataset_id", "sample_id", "dose_group_id").distinct()
    own = own.withColumn("number", F.row_number().over(of.orderBy("sample_id")) - 1).withColumn("n_own", F.count("*").over(of))
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cells.where(present()).join(own, ["dataset_id", "sample_id"]).withColumn("part", F.pmod(F.xxhash64("feature_id"), F.lit(parts)))
    rows = rows.select("dataset_id", "dose_group_id", "n_own", "part", "feature_id", F.struct("number", "value").alias("x")).repartition("dataset_id", "dose_group_id", "part")
    per = rows.groupBy("dataset_id", "dose_group_id", "part", "feature_id").agg(F.any_value("n_own").alias("n_own"), F.collect_list("x").alias("xs")).where(F.size("xs") > 1)
    sums = per.select("dataset_id", "dose_group_id", "n_own", "xs").mapInArrow(_partial_moments, f"dataset_id string, dose_group_id string, s1 long, s2 long, {_MOMENTS}")
    fields = [x.split()[0] for x in _MOMENTS.split(", ")]
    lists = sums.groupBy("dataset_id", "dose_group_id", "s1", "s2").agg(F.collect_list(F.struct(*fields)).alias("parts"))
    whole = F.aggregate(F.slice("parts", 2, F.size("parts")), F.get("parts", F.lit(0)), _added)
    return lists.select("dataset_id", "dose_group_id", "s1", "s2", whole.alias("m")).select("dataset_id", "dose_group_id", "s1", "s2", "m.*")


def replicate_stability(cells: DataFrame, samples: DataFrame) -> DataFrame:
    """Per dose group: Pearson correlations of all pairs of non-technical samples over shared features: pairs used, mean,
    least, and stable, unstable or not_assessed. Pairs with fewer than two shared values or a constant side are dropped."""
    own = samples.where(F.coalesce("replicate_type", F.lit("biological")) != "technical")
    usable = (F.col("n") >= 2) & (F.col("cxx") > 1e-18) & (F.col("cyy") > 1e-18)
    pairs = sample_moments(cells, own).where(usable).select("dataset_id", "dose_group_id", (F.col("cxy") / F.sqrt(F.col("cxx") * F.col("cyy"))).alias("r"))
    per = pairs.groupBy("dataset_id", "dose_group_id").agg(F.count("*").alias("n_pairs"), F.avg("r").alias("mean_r"), F.min("r").alias("min_r"))
    groups = samples.select("dataset_id", "dose_group_id").distinct()
    state = F.when(F.col("mean_r").isNull(), "not_assessed").when((F.col("mean_r") >= 0.9) & (F.col("min_r") >= 0.7), "stable").otherwise("unstable")
    return groups.join(per, ["dataset_id", "dose_group_id"], "left").select("dataset_id", "dose_group_id", F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"), "mean_r", "min_r", state.alias("stability"))


def variance_band(spread: DataFrame, stability: DataFrame) -> DataFrame:
    """Per dataset of ``variance`` rows: warning where replicates disagree over all groups or a feature has a low dynamic
    range, not_applicable where no feature has two values, else acceptable."""
    n = F.col("n_pairs")
    agree = stability.groupBy("dataset_id").agg(F.sum(n).alias("n"), F.round(F.try_divide(F.sum(n * F.coalesce("mean_r", F.lit(0.0))), F.sum(n)), 6).alias("mean"), F.round(F.min("min_r"), 6).alias("least"))
    unstable = F.coalesce((F.col("mean") < 0.9) | (F.col("least") < 0.7), F.lit(False))
    kinds = spread.groupBy("dataset_id").agg(F.bool_or(F.col("dynamic_range") == "low").alias("low"), F.bool_and(F.col("dynamic_range") == "not_applicable").alias("none"))
    band_ = F.when(F.col("unstable"), "warning").when(F.col("none"), "not_applicable").when(F.col("low"), "warning").otherwise("acceptable")
    rows = kinds.join(agree.select("dataset_id", unstable.alias("unstable")), "dataset_id", "left").withColumn("unstable", F.coalesce("unstable", F.lit(False)))
    return rows.select("dataset_id", band_.alias("variance_band"))


def overall(missing: DataFrame, spread: DataFrame, stability: DataFrame, consistency: DataFrame, batches: DataFrame) -> DataFrame:
    """Per dataset the bands of missingness (the worst of its features, samples and groups), variance, replicates (spread
    warnings of ``replicate_consistency``) and batches (nested in doses), and the worst of the four."""
    bands = F.array(*map(F.lit, ("acceptable", "warning", "exclusion")))
    rank = lambda c: F.when(c == "exclusion", 3).when(c == "warning", 2).otherwise(1)
    m = missing.where("level <> 'dataset'").groupBy("dataset_id").agg(F.max(rank(F.col("band"))).alias("m"))
    s = consistency.groupBy("dataset_id").agg(F.bool_or("spread_warning").alias("s"))
    rows = m.join(variance_band(spread, stability), "dataset_id", "left").join(s, "dataset_id", "left").join(batches.select("dataset_id", "nested"), "dataset_id", "left")
    told = lambda c: F.when(F.coalesce(c, F.lit(False)), 2).otherwise(1)
    worst = F.greatest("m", rank(F.col("variance_band")), told(F.col("s")), told(F.col("nested")))
    return rows.select(
        "dataset_id", F.element_at(bands, F.col("m")).alias("missingness_band"), F.coalesce("variance_band", F.lit("not_applicable")).alias("variance_band"),
        F.when(F.coalesce("s", F.lit(False)), "unstable").otherwise("stable").alias("replicate_band"), F.coalesce("nested", F.lit(False)).alias("batch_confounding"), F.element_at(bands, worst).alias("overall"),
    )
