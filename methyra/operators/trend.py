"""Ordered-trend tests over dose: Jonckheere-Terpstra statistic, exact and sampled permutation p-values, families.

The null distribution depends on group sizes and the pattern of ties alone, so it is worked out once per distinct
pattern and joined back to features. Data sets that break the test's assumptions, and features with missing values, are
not tested; their blockers say why.
"""

from __future__ import annotations

import itertools
import math
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

EXACT_LIMIT, RESAMPLES, BOOTSTRAPS, SEED = 50_000, 4_999, 1_999, 20260727
#: Pair comparisons that one exact test may take, and by default one family of tests.
MOST_COMPARISONS = 100_000_000
#: Why a data set or a feature is not tested, in order.
BLOCKERS = (
    "structurally_invalid_design", "no_zero_dose_control", "negative_dose_value", "insufficient_distinct_dose_levels", "mixed_dose_units", "multi_timepoint_design",
    "multi_batch_design_not_supported", "undeclared_or_non_biological_replicate_type", "insufficient_observations_per_dose", "missing_value", "non_finite_value",
)


def design_blockers(samples: DataFrame, invalid: DataFrame | None = None) -> DataFrame:
    """(dataset_id, shared): what in the design of a data set forbids the test. ``invalid`` holds the data sets whose
    designs failed validation. An unnamed timepoint or batch counts as one of its own."""
    per = samples.groupBy("dataset_id").agg(
        F.bool_or(F.col("dose_value") == 0).alias("zero"), F.min("dose_value").alias("least"), F.countDistinct("dose_value").alias("levels"), F.countDistinct(F.coalesce("dose_unit", F.lit(""))).alias("units"),
        F.countDistinct(F.coalesce(F.col("timepoint_hours").cast("string"), F.lit("unspecified"))).alias("times"), F.countDistinct(F.coalesce("batch_id", F.lit("unspecified"))).alias("batches"),
        F.bool_or(F.coalesce(F.col("replicate_type") != "biological", F.lit(True))).alias("other"),
    )
    bad = F.lit(False)
    if invalid is not None:
        per, bad = per.join(invalid.select("dataset_id").distinct().withColumn("bad", F.lit(True)), "dataset_id", "left"), F.coalesce("bad", F.lit(False))
    tests = [bad, ~F.col("zero"), F.col("least") < 0, F.col("levels") < 3, F.col("units") > 1, F.col("times") > 1, F.col("batches") > 1, F.col("other")]
    return per.select("dataset_id", F.array_compact(F.array(*(F.when(t, code) for t, code in zip(tests, BLOCKERS)))).alias("shared"))


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(values.astype(np.int32)))


def _runs(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by row and value, and the dense rank from 1 of each value within its row, in that order."""
    order = np.lexsort((value, row))
    r, v = row[order], value[order]
    fresh = np.r_[True, r[1:] != r[:-1]][: len(r)]
    step = np.cumsum(fresh | np.r_[True, v[1:] != v[:-1]][: len(v)])
    return order, step - np.repeat(step[fresh], np.diff(np.r_[np.flatnonzero(fresh), len(r)])) + 1


def _laid_out(obs: pa.Array, doses: pa.Array) -> pa.Array:
    """Ranks, groups, numbers by dose and by tie of all features of a batch at once."""
    sizes, n_doses = obs.value_lengths().to_numpy(False), doses.to_numpy(False)
    flat = obs.flatten()
    group, value = flat.field(0).to_numpy(False), flat.field(2).to_numpy(False)
    row = np.repeat(np.arange(len(obs)), sizes)
    order, rank = _runs(row, value)
    ranks = np.empty(len(row), np.int64)
    ranks[order] = rank
    n = np.bincount((np.cumsum(n_doses) - n_doses)[row] + group - 1, minlength=n_doses.sum())
    top = np.zeros(len(obs), np.int64)
    np.maximum.at(top, row, ranks)
    ties = np.bincount((np.cumsum(top) - top)[row] + ranks - 1, minlength=top.sum())
    return pa.StructArray.from_arrays([_lists(ranks, sizes), _lists(group, sizes), _lists(n, n_doses), _lists(ties, top)], names=["ranks", "groups", "n", "ties"])


def observations(cells: DataFrame, samples: DataFrame) -> DataFrame:
    """Per feature with cells: values, dose ranks and value ranks (ties share one) in order of dose and, within a dose, of the
    design (its column ``position`` where there is one, else the sample's id), sizes of all dose groups of the design, tie
    pattern, and what in the values forbids the test (own). Ranks of a batch of features are found by one sort."""
    place = F.col("position" if "position" in samples.columns else "sample_id")
    own = samples.groupBy("dataset_id", "sample_id", "dose_value").agg(F.min(place).alias("place"))
    own = own.withColumn("level", F.dense_rank().over(Window.partitionBy("dataset_id").orderBy("dose_value")))
    whole = own.groupBy("dataset_id").agg(F.countDistinct("sample_id").alias("n_samples"), F.max("level").alias("n_doses"))
    x = F.col("value")
    known = x.isNotNull() & ~F.isnan(x)
    finite = known & (F.abs(x) <= 1.7976931348623157e308)
    per = cells.join(own, ["dataset_id", "sample_id"]).groupBy("dataset_id", "feature_id").agg(
        F.sort_array(F.collect_list(F.when(finite, F.struct("level", "place", "value")))).alias("obs"), F.count_if(known).alias("n_known"), F.count_if(known & ~finite).alias("n_infinite")
    )
    laid_out = F.arrow_udf(_laid_out, "ranks array<int>, groups array<int>, n array<int>, ties array<int>")
    rows = per.join(whole, "dataset_id").withColumn("l", laid_out("obs", "n_doses"))
    blocked = F.array_compact(F.array(
        F.when(F.coalesce(F.array_min("l.n"), F.lit(0)) < 2, BLOCKERS[8]), F.when(F.col("n_known") < F.col("n_samples"), BLOCKERS[9]), F.when(F.col("n_infinite") > 0, BLOCKERS[10]),
    ))
    return rows.select(
        "dataset_id", "feature_id", F.col("obs.value").alias("values"), "l.ranks", "l.groups", "l.n",
        F.concat_ws("-", F.col("l.n").cast("array<string>")).alias("sizes"), F.concat_ws("-", F.col("l.ties").cast("array<string>")).alias("ties"), blocked.alias("own"),
    )


def blockers(obs: DataFrame, designs: DataFrame) -> DataFrame:
    """Adds ``blockers``, joined by commas; empty for features that may be tested."""
    return obs.join(designs, "dataset_id").withColumn("blockers", F.concat_ws(",", "shared", "own")).drop("shared", "own")


def _doubled(groups: pa.Array, ranks: pa.Array) -> pa.Array:
    """Doubled statistics of all features of a batch: for each bit of the dose rank, from the highest, the pairs that it
    decides are counted by running numbers of zeros in value order, so n observations take n log n steps for each bit."""
    sizes = groups.value_lengths().to_numpy(False)
    row = np.repeat(np.arange(len(groups)), sizes)
    group, rank = (x.flatten().to_numpy(False).astype(np.int64) for x in (groups, ranks))
    total = np.zeros(len(groups), np.int64)
    for bit in range(int(group.max(initial=0)).bit_length() - 1, -1, -1):
        block, one = group >> (bit + 1), (group >> bit) & 1
        order = np.lexsort((rank, block, row))
        r, b, k, o = row[order], block[order], rank[order], one[order]
        starts = np.r_[True, (r[1:] != r[:-1]) | (b[1:] != b[:-1])][: len(r)]
        tie = np.flatnonzero(starts | np.r_[True, k[1:] != k[:-1]][: len(k)])
        zeros = np.r_[0, np.cumsum(1 - o)]
        ties = np.diff(np.r_[tie, len(r)])
        both = np.repeat(zeros[tie] + zeros[tie + ties], ties) - 2 * np.repeat(zeros[np.flatnonzero(starts)], np.diff(np.r_[np.flatnonzero(starts), len(r)]))
        np.add.at(total, r, np.where(o == 1, both, 0))
    return pa.array(total)


def statistic(obs: DataFrame) -> DataFrame:
    """Adds twice the statistic (ties count one), twice its maximum, and the effect in [-1, 1]."""
    total = F.expr("aggregate(n, 0L, (t, x) -> t + x)")
    pairs = total * total - F.expr("aggregate(n, 0L, (t, x) -> t + x * x)")
    out = obs.withColumn("doubled", F.arrow_udf(_doubled, "long")("groups", "ranks")).withColumn("doubled_max", pairs)
    return out.withColumn("effect", F.try_divide(F.col("doubled") * 2.0, "doubled_max") - 1.0)


def mode(stats: DataFrame, resamples: int = RESAMPLES, limit: int = EXACT_LIMIT) -> DataFrame:
    """Adds the number of label allocations and how the p-value is to be found: exact or monte_carlo."""
    ways = F.expr("aggregate(n, named_struct('t', 1D, 'k', 0), (a, x) -> named_struct('t', aggregate(sequence(1, greatest(x, 1)), a.t, (t, i) -> t * (a.k + i) / i), 'k', a.k + x), a -> a.t)")
    size = F.size("groups")
    exact_ = (F.col("allocations") <= limit) & (F.col("allocations") <= resamples + 1) & (F.col("allocations") * (size * (size - 1) / 2) <= MOST_COMPARISONS)
    return stats.withColumn("allocations", F.round(ways)).withColumn("mode", F.when(exact_, "exact").otherwise("monte_carlo"))


def allocations(sizes: str) -> int:
    """The number of label allocations of sizes such as 3-3-3, for checks of ``mode``."""
    ns = [int(x) for x in sizes.split("-")]
    return math.factorial(sum(ns)) // math.prod(math.factorial(x) for x in ns)


def work(stats: DataFrame, resamples: int = RESAMPLES, bootstraps: int = BOOTSTRAPS) -> DataFrame:
    """Per data set the pair comparisons that resampling all its features would take, by those of its first feature that
    may be tested, and whether they exceed ``MOST_COMPARISONS``."""
    n = F.size("groups")
    each = resamples * (n * (n - 1) / 2) + bootstraps * F.col("doubled_max") / 2
    per = stats.groupBy("dataset_id").agg(F.count("*").alias("n_features"), F.min_by(F.when(F.col("blockers") == "", each), F.when(F.col("blockers") == "", F.col("feature_id"))).alias("each"))
    return per.select("dataset_id", "n_features", (F.col("n_features") * F.col("each")).alias("comparisons")).withColumn("over", F.coalesce(F.col("comparisons") > MOST_COMPARISONS, F.lit(False)))


def _distribution(sizes: list[int], ties: list[int]) -> dict[int, int]:
    """Doubled statistic -> allocations, by adding tie classes one after another.

    State: how many of each dose group are placed so far. A class placed adds, for each of its members in group j, two
    for every earlier value in a lower group, and one for every pair within the class in different groups.
    """
    states: dict[tuple[int, ...], dict[int, int]] = {tuple([0] * len(sizes)): {0: 1}}
    for t in ties:
        new: dict[tuple[int, ...], dict[int, int]] = {}
        for used, dist in states.items():
            for take in itertools.product(*(range(min(t, s - u) + 1) for s, u in zip(sizes, used))):
                if sum(take) != t:
                    continue
                ways = math.factorial(t) // math.prod(math.factorial(k) for k in take)
                add = sum(2 * sum(used[:j]) * k for j, k in enumerate(take)) + (t * t - sum(k * k for k in take)) // 2
                into = new.setdefault(tuple(u + k for u, k in zip(used, take)), {})
                for s, c in dist.items():
                    into[s + add] = into.get(s + add, 0) + c * ways
        states = new
    return states[tuple(sizes)]


def exact_tails(patterns: DataFrame) -> DataFrame:
    """(sizes, ties, doubled, total, up, down, two) for every attainable statistic of each distinct pattern."""

    def run(frames):
        for pdf in frames:
            rows = []
            for sizes, ties in zip(pdf["sizes"], pdf["ties"]):
                dist = _distribution([int(x) for x in sizes.split("-")], [int(x) for x in ties.split("-")])
                total, at = sum(dist.values()), sorted(dist)
                counts = np.array([dist[s] for s in at], dtype=float)
                mean = sum(s * dist[s] for s in at) / total
                far = np.abs(np.array(at) - mean)
                for i, s in enumerate(at):
                    rows.append((sizes, ties, s, float(total), counts[i:].sum() / total, counts[: i + 1].sum() / total, counts[far >= far[i] - 1e-9].sum() / total))
            yield pd.DataFrame(rows, columns=["sizes", "ties", "doubled", "total", "p_up", "p_down", "p_two"])

    # few rows with much work each: dealt out by number, so that they are not put together for their size
    n = int(patterns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return patterns.select("sizes", "ties").distinct().repartition(n, "sizes", "ties").mapInPandas(run, "sizes string, ties string, doubled long, total double, p_up double, p_down double, p_two double")


def exact(stats: DataFrame) -> DataFrame:
    """Adds total, p_up, p_down and p_two. Tails are looked up in a map for each pattern: a join on the statistic would push
    a filter on it below the columns that it is made of, which are then worked out again for every pair of values."""
    stats = written(stats)  # asked for its patterns first
    values = F.struct("total", "p_up", "p_down", "p_two")
    tails = exact_tails(stats).groupBy("sizes", "ties").agg(F.map_from_entries(F.collect_list(F.struct("doubled", values))).alias("tails"))
    return stats.join(tails, ["sizes", "ties"]).withColumn("t", F.element_at("tails", F.col("doubled"))).select("*", "t.*").drop("tails", "t")


#: The offset and factor of the 32-bit hash of ids, the state that stands for zero, and the shifts of the generator.
FNV_OFFSET, FNV_FACTOR, ZERO_STATE, SHIFTS = 0x811C9DC5, 0x01000193, 0x9E3779B9, (13, 17, 5)


def _hash32(text: str) -> int:
    h = FNV_OFFSET
    for unit in np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2").tolist():
        h = (h ^ unit) * FNV_FACTOR & 0xFFFFFFFF
    return h


def stream_seed(seed: int, feature_id: str, salt: str) -> int:
    """The 32-bit seed of a feature's own stream for one purpose."""
    return seed ^ _hash32(feature_id) ^ _hash32(salt)


def _next(state: np.ndarray) -> np.ndarray:
    """The generator's next 32-bit states."""
    left, right, last = (np.uint32(x) for x in SHIFTS)
    state = state ^ (state << left)
    state = state ^ (state >> right)
    return state ^ (state << last)


def _applied(columns: np.ndarray, states: np.ndarray) -> np.ndarray:
    """A linear map on 32 bits, given by the images of the single bits, looked up a byte at a time."""
    out = np.zeros_like(states)
    for byte in range(4):
        table = np.zeros(256, np.uint32)
        for bit in range(8):
            table[1 << bit : 2 << bit] = table[: 1 << bit] ^ columns[8 * byte + bit]
        out ^= table[(states >> np.uint32(8 * byte)) & np.uint32(255)]
    return out


@lru_cache(maxsize=4)
def _start_tables(draws: int, count: int) -> np.ndarray:
    """States before draws 0, ``draws``, 2 ``draws``, ... of every value of each four bits of a seed: the generator is linear
    over bits, so the second half of any run of starts is one map of the first, and each doubling squares the map."""
    jump = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(draws):
        jump = _next(jump)
    bits = np.empty((32, count), np.uint32)
    bits[:, 0] = np.uint32(1) << np.arange(32, dtype=np.uint32)
    have = 1
    while have < count:
        more = min(have, count - have)
        bits[:, have : have + more] = _applied(jump, bits[:, :more])
        jump = _applied(jump, jump)
        have += more
    tables = np.zeros((8, 16, count), np.uint32)
    for bit in range(32):
        part, at = tables[bit // 4], 1 << bit % 4
        part[at : 2 * at] = part[:at] ^ bits[bit]
    return tables


def _starts(seed: int, draws: int, count: int) -> np.ndarray:
    """States of a stream before draws 0, ``draws``, 2 ``draws``, ..., put together from those of the parts of its seed."""
    tables, state = _start_tables(draws, count), seed or ZERO_STATE
    out = np.zeros(count, np.uint32)
    for i in range(8):
        out ^= tables[i, state >> 4 * i & 15]
    return out


def _below(state: np.ndarray, n: int) -> np.ndarray:
    """floor(u n) for u = state / 2^32, in whole numbers."""
    return (state.astype(np.uint64) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _ties(ranks: np.ndarray) -> list[np.ndarray]:
    """Places of equal values, in ascending order of value."""
    order = np.argsort(ranks, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(ranks[order])) + 1)


def _apart(below: np.ndarray, size) -> np.ndarray:
    """Pairs of different groups among ``size`` equal values, of which so many are of groups lower than each."""
    each, last = np.diff(below, axis=0), size - below[-1]
    return (np.square(size) - (each * each).sum(0) - last * last) // 2


def permuted(groups: np.ndarray, ranks: np.ndarray, resamples: int, seed: int) -> np.ndarray:
    """Doubled statistics of shuffled labels. All shuffles of a feature go on side by side; values are then met in ascending
    order with running numbers of lower labels, so a shuffle of n labels takes n steps for each group."""
    n, g = len(groups), int(groups.max())
    # labels of a shuffle lie side by side, so a swap touches one place
    labels = np.repeat((groups - 1)[None, :].astype(np.min_scalar_type(g)), resamples, 0)
    state, flat, base = _starts(seed, n - 1, resamples), labels.reshape(-1), np.arange(resamples) * n
    for i in range(n - 1, 0, -1):
        state = _next(state)
        j = _below(state, i + 1)
        j += base
        held = labels[:, i].copy()
        labels[:, i] = flat.take(j)
        flat[j] = held
    labels = np.ascontiguousarray(labels.T)
    lower, total = np.zeros((g, resamples), np.int32), np.zeros(resamples, np.int64)
    where, row = labels.astype(np.int64), np.arange(resamples)
    where *= resamples
    where += row
    for places in _ties(ranks):
        before = lower.copy()
        for k in places:
            total += 2 * lower.take(where[k])
        for k in places:
            for x in range(1, g):
                lower[x] += labels[k] < x
        if len(places) > 1:
            total += _apart(lower - before, len(places))
    return total


def resampled(groups: np.ndarray, ranks: np.ndarray, resamples: int, seed: int) -> np.ndarray:
    """Doubled statistics of samples drawn with replacement within each group; a draw counts how often it took each value."""
    n, g = len(groups), int(groups.max())
    state, row = _starts(seed, n, resamples), np.arange(resamples)
    first = np.searchsorted(groups, groups)  # groups ascend
    size = np.bincount(groups)[groups]
    times = np.zeros((n, resamples), np.int64)
    flat = times.reshape(-1)
    for k in range(n):
        state = _next(state)
        at = _below(state, int(size[k]))
        at += first[k]
        at *= resamples
        at += row
        flat[at] += 1
    lower, total = np.zeros((g, resamples), np.int64), np.zeros(resamples, np.int64)
    for places in _ties(ranks):
        before = lower.copy()
        for k in places:
            total += 2 * times[k] * before[groups[k] - 1]
            lower[groups[k] :] += times[k]
        if len(places) > 1:
            total += _apart(lower - before, times[places].sum(0))
    return total


def percentile(ascending: np.ndarray, share: float) -> float:
    at = share * (len(ascending) - 1)
    low, high = math.floor(at), math.ceil(at)
    part = at - low
    return float(ascending[low]) if low == high else float(ascending[low]) * (1 - part) + float(ascending[high]) * part


def sampled(stats: DataFrame, resamples: int = RESAMPLES, bootstraps: int = BOOTSTRAPS, confidence: float = 0.95, seed: int = SEED) -> DataFrame:
    """Monte-Carlo permutation p-values (one added to both counts), their resolution and standard error, and a
    dose-stratified percentile interval of the effect. Each feature has 32-bit streams of its own, one for labels and one for the
    interval, seeded by its id, so results depend on no partition and equal those of any other program with these streams."""
    tail = (1 - confidence) / 2
    names = ["dataset_id", "feature_id", "p_up", "p_down", "p_two", "resolution", "standard_error", "effect_low", "effect_high"]

    def run(frames):
        for pdf in frames:
            rows = []
            for r in pdf.itertuples():
                g, k, most = np.asarray(r.groups), np.asarray(r.ranks), int(r.doubled_max)
                got = permuted(g, k, resamples, stream_seed(seed, r.feature_id, "permutation"))
                far = np.abs(2 * got - most) >= abs(2 * r.doubled - most)
                up, down, two = (int(x.sum() + 1) / (resamples + 1) for x in (got >= r.doubled, got <= r.doubled, far))
                effect = np.sort(2 * resampled(g, k, bootstraps, stream_seed(seed, r.feature_id, "bootstrap")) / most - 1)
                rows.append((r.dataset_id, r.feature_id, up, down, two, 1 / (resamples + 1), math.sqrt(two * (1 - two) / (resamples + 1)), percentile(effect, tail), percentile(effect, 1 - tail)))
            yield pd.DataFrame(rows, columns=names)

    cols = stats.select("dataset_id", "feature_id", "groups", "ranks", "doubled", "doubled_max")
    # small rows with much work each: dealt out by number, so that they are not put together for their size
    cols = cols.repartition(int(stats.sparkSession.conf.get("spark.sql.shuffle.partitions")), "dataset_id", "feature_id")
    return cols.mapInPandas(run, "dataset_id string, feature_id string, " + ", ".join(f"{c} double" for c in names[2:]))


def tested(stats: DataFrame, resamples: int = RESAMPLES, bootstraps: int = BOOTSTRAPS) -> DataFrame:
    """p-values of features without blockers, exact or sampled as ``mode`` says."""
    rows = written(mode(stats.where("blockers = ''"), resamples))
    columns = ["dataset_id", "feature_id", "effect", "mode", "allocations", "p_up", "p_down", "p_two", "resolution"]
    one = exact(rows.where("mode = 'exact'")).withColumn("resolution", 1 / F.col("total")).select(*columns)
    many = rows.where("mode = 'monte_carlo'")
    drawn = sampled(many, resamples, bootstraps).select("dataset_id", "feature_id", "p_up", "p_down", "p_two", "resolution")
    return one.unionByName(many.select(*columns[:5]).join(drawn, ["dataset_id", "feature_id"]).select(*columns))


def family(stats: DataFrame, tests: DataFrame, threshold: float = 0.05, method: str = "by", most: float | None = None) -> DataFrame:
    """Every feature of a data set, the family: tested ones with adjusted p-value and evidence, the others with blockers.
    With ``most``, a family whose resampling would take more comparisons fails the query, naming the data set."""
    label = F.when(F.col("q") <= threshold, "fdr_below_threshold").otherwise("not_below_threshold")
    done = adjust(tests, "p_two", ["dataset_id"], ["feature_id"], method).select("dataset_id", "feature_id", "p_two", "q", label.alias("evidence"))
    rows = stats.select("dataset_id", "feature_id", "effect", "blockers")
    if most is not None:
        fail = F.raise_error(F.concat(F.lit("trend family over the resampling budget: "), "dataset_id"))
        over = work(stats).select("dataset_id", F.when(F.col("comparisons") > most, fail.cast("boolean")).otherwise(True).alias("within"))
        rows = rows.join(over, "dataset_id").where("within").drop("within")
    return rows.join(done, ["dataset_id", "feature_id"], "left").withColumn("status", F.when(F.col("blockers") == "", "assessed").otherwise("not_assessed"))


def step_up(df: DataFrame, p: str, family: list[str], tie: list[str]) -> DataFrame:
    """Adds ``rank``, the family's size ``m`` and ``least``, the smallest p m / rank of this and all later ranks.

    Rows are dealt out in ranges of (family, p, tie), so a family of any size is spread over as many tasks as it needs; a
    row's number in its range and the range's first number in the family give its rank. From each range and family only its
    count and its least value go on: running sums of the counts place a range, and the least values of later ranges are
    carried back to it.
    """
    order = [*family, p, *tie]
    base = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_row", 33))
    at, along = [*family, "_part"], Window.partitionBy(*family).orderBy("_part")
    counts = base.groupBy(*at).agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = counts.select(*at, "_first", before.alias("_before"), F.sum("_n").over(Window.partitionBy(*family)).alias("m"))
    rows = base.join(places, at).withColumn("rank", F.col("_before") + F.col("_row") - F.col("_first") + 1).withColumn("_scaled", F.col(p) * F.col("m") / F.col("rank"))
    later = F.min("_own").over(along.rowsBetween(1, Window.unboundedFollowing))
    carried = rows.groupBy(*at).agg(F.min("_scaled").alias("_own")).select(*at, later.alias("_later"))
    here = F.min("_scaled").over(Window.partitionBy(*at).orderBy(F.desc("_row")).rowsBetween(Window.unboundedPreceding, 0))
    out = rows.join(carried, at).withColumn("least", F.least(here, "_later"))
    return out.select(*df.columns, "rank", "m", "least")


def harmonic(m: Column) -> Column:
    """The sum of 1/k for k = 1 to m: added up for small m, by its expansion beyond (which is as exact there as the sum)."""
    x = m.cast("double")
    small = F.aggregate(F.sequence(F.lit(1), F.least(m, F.lit(256)).cast("int")), F.lit(0.0), lambda t, k: t + 1.0 / k)
    return F.when(m <= 256, small).otherwise(F.log(x) + 0.5772156649015329 + 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * x * x * x * x))


def corrected(least: Column, m: Column, method: str) -> Column:
    """The adjusted p-value from a row of ``step_up``."""
    return F.least(F.lit(1.0), least * harmonic(m) if method == "by" else least)


def adjust(df: DataFrame, p: str, family: list[str], tie: list[str], method: str = "by") -> DataFrame:
    """Step-up adjustment within families: adds ``rank`` and ``q``."""
    return step_up(df, p, family, tie).withColumn("q", corrected(F.col("least"), F.col("m"), method)).drop("least", "m")
