"""Operators on the small fixtures with known answers."""

import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import connection
from methyra.functions import chromosomes
from methyra.functions import scalars as fx
from methyra.operators import classes, context, genes, qc, qualify, summaries, trend
from methyra.plans.queries import QUERIES, SQL
from methyra.sources import tables
from methyra.streaming import ingest as live


def _cells(spark, groups):
    rows, samples = [], []
    for g, values in enumerate(groups):
        for i, v in enumerate(values):
            rows.append(("d", "f", f"s{g}_{i}", float(v) if v is not None else None))
            samples.append(("d", f"s{g}_{i}", f"g{g}", float(g), "biological"))
    return spark.createDataFrame(rows, "dataset_id string, feature_id string, sample_id string, value double"), spark.createDataFrame(samples, "dataset_id string, sample_id string, dose_group_id string, dose_value double, replicate_type string")


@pytest.mark.parametrize("groups, doubled, up, down, two", [
    ([[1, 2], [3, 4], [5, 6]], 24, 1 / 90, 1, 2 / 90),
    ([[6, 5], [4, 3], [2, 1]], 0, 1, 1 / 90, 2 / 90),
    ([[1, 1], [1, 1], [1, 1]], 12, 1, 1, 1),
])
def test_exact_trend(spark, groups, doubled, up, down, two):
    c, s = _cells(spark, groups)
    r = trend.exact(trend.statistic(trend.observations(c, s))).first()
    assert (r["doubled"], r["total"]) == (doubled, 90)
    assert np.allclose([r["p_up"], r["p_down"], r["p_two"]], [up, down, two])


def test_distribution_is_enumeration():
    values, sizes = [1, 1, 2, 3, 3, 3], [2, 1, 3]
    want: dict[int, int] = {}
    for labels in set(itertools.permutations([0, 0, 1, 2, 2, 2])):
        s = sum((2 if x < y else x == y) for (a, x), (b, y) in itertools.product(zip(labels, values), repeat=2) if a < b)
        want[int(s)] = want.get(int(s), 0) + 1
    assert trend._distribution(sizes, [2, 1, 3]) == want


def test_sampled_agrees_with_exact(spark):
    c, s = _cells(spark, [[1, 2, 4], [3, 5, 6], [7, 8, 9]])
    stats = trend.statistic(trend.observations(c, s))
    exact, drawn = trend.exact(stats).first(), trend.sampled(stats).first()
    assert abs(exact["p_two"] - drawn["p_two"]) < 4 * (exact["p_two"] / 5000) ** 0.5 + 2e-4
    assert drawn["effect_low"] <= exact["effect"] <= drawn["effect_high"] + 1e-9


def test_adjustment(spark):
    p = spark.createDataFrame([("a", 1, 0.01), ("a", 2, 0.04), ("a", 3, 0.03)], "family string, id int, p double")
    get = lambda m: [round(r["q"], 5) for r in trend.adjust(p, "p", ["family"], ["id"], m).orderBy("id").collect()]
    assert get("bh") == [0.03, 0.04, 0.04]
    assert get("by") == [0.055, 0.07333, 0.07333]


def test_missingness_bands_and_dropout(spark):
    c, s = _cells(spark, [[None, None], [1, 2], [3, 4]])
    f = spark.createDataFrame([("d", "f"), ("d", "g")], "dataset_id string, feature_id string")
    more = s.select("dataset_id", F.lit("g").alias("feature_id"), "sample_id", F.lit(1.0).alias("value"))
    got = {(r["level"], r["key"]): (r["n_missing"], r["band"]) for r in qc.missingness(c.unionByName(more), f, s).collect()}
    assert got["feature", "f"] == (2, "exclusion") and got["feature", "g"] == (0, "acceptable")
    assert got["group", "g0"] == (2, "exclusion") and got["group", "g1"] == (0, "acceptable")
    assert got["dataset", "d"] == (2, "warning")


def test_nan_counts_as_missing(spark):
    c, s = _cells(spark, [[float("nan"), 1], [1, 2]])
    f = c.select("dataset_id", "feature_id").distinct()
    assert {r["key"]: r["n_missing"] for r in qc.missingness(c, f, s).where("level = 'feature'").collect()} == {"f": 1}


def test_patterns(spark):
    def one(groups):
        c, s = _cells(spark, groups)
        r = summaries.response_pattern(summaries.dose_profile(c, c.select("dataset_id", "feature_id").distinct(), s)).first()
        return r["pattern"], r["reversals"], r["direction"], r["blockers"]

    assert one([[1, 1], [2, 2], [3, 3]]) == ("monotonic_nondecreasing", 0, "increasing", "")
    assert one([[2, 2], [3, 3], [1, 1], [4, 4]])[:3] == ("non_monotonic", 2, "mixed")
    assert one([[1, 1], [1, 1], [1, 1]])[0] == "flat_within_tolerance"
    assert one([[1, 1], [None, None], [1, 1]])[3] == "incomplete_dose_level"


def test_replicate_spread(spark):
    c, s = _cells(spark, [[0.80, 0.82, 0.84]])
    more = spark.createDataFrame([("d", "g", f"s0_{i}", v) for i, v in enumerate((0.20, 0.22, 0.24))], c.schema)
    both = c.unionByName(more)
    r = summaries.replicate_consistency(summaries.group_summary(both, both.select("dataset_id", "feature_id").distinct(), s)).first()
    assert round(r["mean_of_means"], 6) == 0.52 and not r["spread_warning"]


def test_composition_shift(spark):
    rows = [("d", "s0_0", "a", 0.8), ("d", "s0_0", "b", 0.2), ("d", "s1_0", "a", 0.2), ("d", "s1_0", "b", 0.8)]
    _, s = _cells(spark, [[1], [1]])
    f = spark.createDataFrame(rows, "dataset_id string, sample_id string, cell_type string, fraction double")
    r = context.composition_shift(f, s).first()
    assert round(r["max_delta"], 6) == 0.6 and r["n_shifted"] == 2


def test_numbers(spark):
    raw = spark.createDataFrame([(x,) for x in (" 1.5 ", "NA", "", None, "12d", "inf", "1e400", "0x10", "-3e2", ".5")], "raw string")
    strict = raw.select(*[c.alias(n) for c, n in zip(fx.number_strict(F.col("raw")), ("v", "ok"))]).collect()
    assert [r["v"] for r in strict] == [1.5, None, None, None, None, None, None, None, -300.0, 0.5]
    assert [r["ok"] for r in strict] == [True, True, True, True, False, False, False, False, True, True]
    assert [r["ok"] for r in raw.select(fx.number_melt(F.col("raw"))[1].alias("ok")).collect()][5]


def test_coordinates_agree(spark):
    r = spark.range(1).select(fx.canonical_start(F.lit(1001), F.lit(fx.ONE_BASED)).alias("a"), fx.canonical_start(F.lit(1000), F.lit(fx.CANONICAL)).alias("b"), fx.round_up_half(F.lit(-2.5), 0).alias("c")).first()
    assert (r["a"], r["b"], r["c"]) == (1000, 1000, -2.0)


def test_empty_tables(spark):
    c, s = _cells(spark, [[1, 2]])
    none = c.limit(0)
    assert qc.variance(none).count() == 0
    assert qc.replicate_stability(none, s).first()["stability"] == "not_assessed"


def test_feature_type_without_headers(spark):
    schema = "file_id int, headers array<string>, family string, modality string, shape string, semantics string, explicit_class string, enabled array<string>, mixed boolean"
    rows = [(1, None, None, None, None, None, None, None, None), (2, [], "dna_methylation", None, "wide", None, None, [], False), (3, [None, "CG-ID"], "dna_methylation", None, None, None, None, None, True), (4, ["x"], None, None, None, None, "atac_peak", ["accessibility"], None)]
    files = spark.createDataFrame(rows, schema)
    got = {r.file_id: (r.feature_class, r.confidence, r.action) for r in classes.feature_type(files).collect()}
    assert got == {1: ("unclassified", "low", "blocked"), 2: ("unclassified", "low", "blocked"), 3: ("cpg_methylation", "high", "split_table"), 4: ("atac_peak", "override", "proceed")}
    assert classes.methylation_class(files.limit(0)).count() == classes.region_class(files.limit(0)).count() == 0


def test_canonical_summary_reads_named_columns_only(spark):
    rows = spark.createDataFrame([("a", 1, "2.5", "x", "n"), ("a", 2, "3", None, "n"), (" ", 3, "1", "1", "n"), (None, 4, "1", "1", "n")], "id string, at int, `Log2-FC` string, `P value` string, note string")
    out = classes.canonical_summary(rows, "id", "at")
    assert [tuple(r)[:5] for r in out.collect()] == [("a", 2, 3.0, None, None)]


def test_nearest_sites_against_brute_force(spark):
    rng = np.random.default_rng(2)
    sites = [(f"c{c}", f"g{i}", int(p), int(p) + 5, "+" if i % 2 else "-") for c in range(2) for i, p in enumerate(rng.integers(0, 60_000, 40))]
    asks = [(f"f{i}", f"c{i % 3}", int(p), int(p) + int(n)) for i, (p, n) in enumerate(zip(rng.integers(0, 80_000, 120), rng.integers(1, 4000, 120)))]
    got = genes.nearest(
        spark.createDataFrame(asks, "feature_id string, chrom string, start long, end long"), spark.createDataFrame(sites, "chrom string, gene_id string, start long, end long, strand string"), size=1000
    ).collect()
    want = set()
    for f, c, a, e in asks:
        own = [(g, s if strand == "+" else t) for k, g, s, t, strand in sites if k == c]
        far = {g: a - p if p < a else max(0, p - e) for g, p in own}
        want |= {(f, g, x) for g, x in far.items() if x == min(far.values())}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    places = spark.createDataFrame([(a, e, p) for _, _, a, e in asks[:20] for p in (a - 3, a, (a + e) // 2, e, e + 7)], "start long, end long, site long")
    assert [r["distance"] for r in genes.checked_distance(places).collect()] == [3, 0, 0, 0, 7] * 20


def test_adjustment_against_brute_force(spark):
    rng = np.random.default_rng(4)
    p = rng.integers(1, 30, 60) / 40
    df = spark.createDataFrame([("a" if i % 3 else "b", i, float(x)) for i, x in enumerate(p)], "family string, id int, p double")
    got = {r["id"]: r["q"] for r in trend.adjust(df, "p", ["family"], ["id"], "by").collect()}
    for name in "ab":
        own = sorted((x, i) for i, x in enumerate(p) if ("a" if i % 3 else "b") == name)
        m = len(own)
        scaled = [x * m * sum(1 / k for k in range(1, m + 1)) / r for r, (x, _) in enumerate(own, 1)]
        for r, (_, i) in enumerate(own):
            assert abs(got[i] - min(1, *scaled[r:])) < 1e-12


def _design(spark, rows):
    schema = "dataset_id string, sample_id string, dose_value double, dose_unit string, timepoint_hours double, batch_id string, replicate_type string"
    return spark.createDataFrame(rows, schema)


def test_trend_blockers(spark):
    good = [("ok", f"s{i}", float(i // 2), "uM", 24.0, "b", "biological") for i in range(6)]
    bad = [("bad", f"s{i}", float(i // 2 - 1), "uM" if i else "mM", None if i else 1.0, None if i else "b", None if i else "biological") for i in range(4)]
    s = _design(spark, good + bad)
    shared = {r["dataset_id"]: list(r["shared"]) for r in trend.design_blockers(s, spark.createDataFrame([("bad",)], "dataset_id string")).collect()}
    assert shared["ok"] == []
    assert shared["bad"] == [x for x in trend.BLOCKERS[:8] if x != "no_zero_dose_control"]
    cells = [("ok", "full", f"s{i}", float(i)) for i in range(6)] + [("ok", "gap", f"s{i}", None if i == 2 else float(i)) for i in range(5)] + [("ok", "inf", f"s{i}", float("inf") if i == 0 else 1.0) for i in range(6)]
    c = spark.createDataFrame(cells, "dataset_id string, feature_id string, sample_id string, value double")
    obs = trend.statistic(trend.blockers(trend.observations(c, s), trend.design_blockers(s)))
    got = {r["feature_id"]: (r["blockers"], r["doubled"], r["doubled_max"]) for r in obs.collect()}
    assert got["full"] == ("", 24, 24)
    assert got["gap"][0] == "insufficient_observations_per_dose,missing_value" and got["inf"][0] == "insufficient_observations_per_dose,non_finite_value"
    family = trend.family(obs, trend.tested(obs)).collect()
    assert sorted((r["feature_id"], r["status"]) for r in family) == [("full", "assessed"), ("gap", "not_assessed"), ("inf", "not_assessed")]
    with pytest.raises(Exception, match="resampling budget"):
        trend.family(obs, trend.tested(obs), most=10.0).collect()


@pytest.mark.parametrize("sizes, mode", [("3-3-3", "exact"), ("3-3-3-3", "monte_carlo"), ("2-2-2", "exact"), ("2-3-4", "exact"), ("20-20", "monte_carlo")])
def test_exact_or_sampled(spark, sizes, mode):
    n = [int(x) for x in sizes.split("-")]
    stats = spark.createDataFrame([(n, [g for g, k in enumerate(n) for _ in range(k)])], "n array<int>, groups array<int>")
    r = trend.mode(stats).first()
    assert r["mode"] == mode and abs(r["allocations"] / trend.allocations(sizes) - 1) < 1e-12


def test_classes_go_through_findings_to_decisions(spark):
    files = [(1, ["chr", "start", "end"], "chromatin", "chip_seq", None, None, None, ["histone"], False), (2, ["chr", "start", "end"], "chromatin", "atac_seq", None, None, None, ["accessibility"], False), (3, ["chr", "start", "end"], "chromatin", "other", None, None, None, [], False)]
    schema = "file_id int, headers array<string>, family string, modality string, shape string, semantics string, explicit_class string, enabled array<string>, mixed boolean"
    kinds = classes.region_class(spark.createDataFrame(files, schema)).select("file_id", "feature_class")
    rows = kinds.select(
        F.lit("d").alias("dataset_id"), F.concat(F.lit("f"), "file_id").alias("feature_id"), "feature_class", F.lit(None).cast("string").alias("modality"), F.lit("chr1").alias("chrom"), F.lit(10).cast("long").alias("start"), F.lit(300_000_000).cast("long").alias("end"),
        F.lit("hg38").alias("build"), F.when(F.col("file_id") != 2, F.lit(fx.CANONICAL)).alias("coord_system"), *(F.lit(None).cast("string").alias(x) for x in ("measured_identifier", "platform", "manifest_version", "annotation_hash")),
    )
    found = {(r["feature_id"], r["code"], r["kind"]) for r in genes.findings(rows, chromosomes.sizes(spark)).collect()}
    assert found == {("f1", "EPI009", "beyond_end"), ("f2", "EPI009", "beyond_end"), ("f3", "EPI009", "beyond_end"), ("f2", "EPI002", "no_system")}
    samples = _design(spark, [("d", f"s{i}", float(i // 3), "uM", 24.0, "b", "biological") for i in range(12)]).withColumns({"dose_group_id": F.concat(F.lit("g"), "dose_value"), "control_flag": F.col("dose_value") == 0})
    cells = spark.createDataFrame([("d", f"f{f}", f"s{i}", 1.0) for f in (1, 2, 3) for i in range(12)], "dataset_id string, feature_id string, sample_id string, value double")
    nothing = spark.createDataFrame([], "dataset_id string, feature_id string, n_genes int, method string, ambiguous boolean")
    contexts = {k: spark.createDataFrame([("d", "unlikely_confounding")], "dataset_id string, confounding string") for k in ("cell_composition", "cytotoxicity")}
    policy = qualify.policies(spark.createDataFrame([("p",)], "policy_id string"))
    decided = qualify.cascade(qualify.measured(rows, cells, samples), qualify.dataset_verdicts(samples, contexts), nothing, policy)
    assert {(r["feature_id"], r["rule"], r["notes"]) for r in decided.collect()} == {("f1", "009", "EPIW003_PROXIMITY_NOT_CAUSALITY"), ("f2", "009", "EPIW003_PROXIMITY_NOT_CAUSALITY"), ("f3", "010", "")}
    # one replicate a group: excluded, or for review where the policy says so; missing context may block
    one = samples.where("sample_id in ('s0', 's3', 's6', 's9')")
    review = qualify.policies(spark.createDataFrame([("a", 1, "review_required", None), ("b", 1, None, None), ("c", None, None, None)], "policy_id string, min_replicates int, n1_policy string, block_missing_context boolean"))
    decided = qualify.cascade(qualify.measured(rows, cells, one), qualify.dataset_verdicts(one, contexts), nothing, review)
    assert {(r["policy_id"], r["status"], r["rule"]) for r in decided.collect()} == {("a", "exploratory_only", "004"), ("b", "excluded_qc_failure", "004"), ("c", "excluded_qc_failure", "004")}
    strict = qualify.policies(spark.createDataFrame([("s", True)], "policy_id string, block_missing_context boolean"))
    bare = qualify.dataset_verdicts(samples, {k: v.limit(0) for k, v in contexts.items()})
    assert {r["rule"] for r in qualify.cascade(qualify.measured(rows, cells, samples), bare, nothing, strict).collect()} == {"007"}
    assert {r["rule"] for r in qualify.cascade(qualify.measured(rows, cells, samples), bare, nothing, policy).collect()} == {"009", "010"}


def test_policies_of_another_version_fail(spark):
    with pytest.raises(Exception, match="another version"):
        qualify.policies(spark.createDataFrame([("p", "9.9")], "policy_id string, version string")).collect()


def test_request_without_response_fails(spark):
    requests = spark.createDataFrame([("d", "a"), ("d", "b")], "dataset_id string, feature_id string")
    one = spark.createDataFrame([("d", "a", 1, "nearest_gene", "low", False, 5, 1), ("d", "a", 0, "unknown_target_gene", "none", True, None, 2)], "dataset_id string, feature_id string, n_genes int, method string, confidence string, rollup_allowed boolean, distance long, nth int")
    pairs = {r["feature_id"]: r for r in genes.paired(requests, one).collect()}
    assert (pairs["a"]["method"], pairs["a"]["warnings"], pairs["b"]["state"]) == ("unknown_target_gene", "MAPPING_NO_TARGET", "missing")
    with pytest.raises(Exception, match="missing mapping response for feature b"):
        genes.paired(requests, one, strict=True).collect()
    assert [r["inconsistent"] for r in genes.guarded(one).orderBy("nth").collect()] == [False, True]


def test_native_and_placeless_systems(spark):
    rows = spark.createDataFrame([(x, 10, 11) for x in (*fx.SYSTEMS, "bed", None)] + [(fx.ONE_BASED, 0, 5), (fx.CANONICAL, 5, 5)], "coord_system string, start long, end long")
    got = [(r["canonical_start"], r["target_start"], r["error"]) for r in genes.normalised(rows, fx.ONE_BASED).collect()]
    assert got == [(10, 11, None), (9, 10, None), (10, 11, None), (None, None, "no coordinates to normalise"), (None, None, "unsupported coordinate system"), (None, None, "no coordinate system"), (None, None, "negative start"), (None, None, "empty interval")]


def test_documents_come_in_bounded_parts(spark):
    decided = spark.createDataFrame([("p", "d", f"f{i}", "accepted_for_pod", "010", "") for i in range(50)], "policy_id string, dataset_id string, feature_id string, status string, rule string, notes string")
    found = spark.createDataFrame([("d", "EPI004", None, 3)], "dataset_id string, code string, feature_id string, n long")
    docs = [json.loads(r["document"]) for r in tables.documents(decided, found, per_document=20).collect()]
    assert len(docs) == 3 and {d["parts"] for d in docs} == {3}
    assert sorted(x["feature_id"] for d in docs for x in d["decisions"]) == sorted(f"f{i}" for i in range(50))
    assert [d["blocking"][0]["code"] for d in docs if "blocking" in d] == ["EPI004"]


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    def put(name, rows):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text("dataset_id,feature_id,sample_id,raw\n" + "".join(",".join(r) + "\n" for r in rows))

    run = lambda: live.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), 1)
    put("a.csv", [("d", "f", "s1", "1"), ("d", "f", "s2", "x"), ("e", "f", "s1", "NA")])
    run()
    run()  # nothing new
    put("b.csv", [("d", "g", "s1", "2"), ("d", "g", "s2")])
    run()
    total = {r["dataset_id"]: (r["n"], r["bad"]) for r in spark.read.parquet(str(tmp_path / "out/batches")).groupBy("dataset_id").agg(F.sum("n_rows").alias("n"), F.sum("n_bad").alias("bad")).collect()}
    assert total == {"d": (4, 2), "e": (1, 0)}
    clean = spark.read.parquet(str(tmp_path / "out/clean"))
    assert sorted(r["value"] for r in clean.where("value is not null").collect()) == [1.0, 2.0]
    # a batch that runs again replaces what it wrote
    import shutil

    shutil.copytree(tmp_path / "state", tmp_path / "again")
    for name in ("1", ".1.crc"):
        (tmp_path / "again" / "commits" / name).unlink(missing_ok=True)
    live.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "again"), 1)
    assert spark.read.parquet(str(tmp_path / "out/clean")).count() == 3
    assert {r["n_bytes"] for r in live.digests(spark, str(tmp_path / "in")).collect()} == {p.stat().st_size for p in (tmp_path / "in").iterdir()}


def test_headers_and_quoted_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,note\n1,"two\nlines"\n2,plain\n3\n')
    good, bad = tables.delimited(spark, str(tmp_path), lines_in_quotes=True)
    assert sorted(r["note"] for r in good.collect()) == ["plain", "two\nlines"] and bad.count() == 1
    (tmp_path / "b.csv").write_text("note,id\nx,1\n")
    assert {r["file_name"]: r["header"] for r in tables.headers(spark, str(tmp_path)).collect()} == {"a.csv": "id,note", "b.csv": "note,id"}


def test_white_space_of_any_kind_is_trimmed(spark):
    raw = spark.createDataFrame([("\t1.5 ",), ("\n NA\r",), ("﻿2",)], "raw string")
    assert [r["v"] for r in raw.select(fx.number_strict(F.col("raw"))[0].alias("v")).collect()] == [1.5, None, 2.0]


def test_variance_on_a_limit_does_not_depend_on_order(spark):
    # exactly 0.001; summed in this order a little less
    cells = spark.createDataFrame([("d", "f", f"s{i}", x) for i, x in enumerate((0.075, 0.085, 0.045, 0.005, 0.065))], "dataset_id string, feature_id string, sample_id string, value double").coalesce(1)
    assert qc.variance(cells).first()["dynamic_range"] == "moderate"
    # 0.00062103125 and the like: halves of the tenth place
    q = SQL["a5_variance"]
    con = connection("/root/testdata/sf0.1")
    want = {r[1]: r[4] for r in con.sql(q).fetchall()}
    got = {r["feature_id"]: r["variance"] for r in QUERIES["a5_variance"](spark, "/root/testdata/sf0.1").collect()}
    assert got == want


def test_numbers_stand_in_the_plan_once(spark):
    texts = [None, "", " NA ", "1", " +1.5e3\t", " .5﻿", "1.", "12d", "inf", "1e400", "-1E-2", "1 2", "--1", "1\n", "nan", "Missing", "0x1", "1f", " "]
    df = spark.createDataFrame([(x,) for x in texts], "raw string")
    value, ok = fx.number_strict(F.col("raw"))
    numbers = {"1": 1.0, " +1.5e3\t": 1500.0, " .5﻿": 0.5, "1.": 1.0, "-1E-2": -0.01, "1\n": 1.0}
    null = {None, "", " NA ", "nan", "Missing", " "}
    for raw, v, o in df.select("raw", value, ok).collect():
        assert (v, o) == (numbers.get(raw), raw in numbers or raw in null), raw
    assert df.select(value.alias("v"))._jdf.queryExecution().optimizedPlan().toString().count("regexp") == 1
