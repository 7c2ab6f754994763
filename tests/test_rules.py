"""Rules whose words and limits others rely on, on small cases, and the hand-off that follows from them."""

import json

import pytest
from pyspark.sql import functions as F

from methyra.operators import context, design, handoff, qc, qualify

ASSAYS = "dataset_id string, metric string, evidence_source string, value double, n_stress int, notes string"


@pytest.mark.parametrize("rows, confounding, detected", [
    ([("viability", "measured", 0.95, 0, None)], "unlikely_confounding", False), ([("viability", "measured", 0.75, 0, None)], "possible_confounding", True),
    ([("viability", "measured", 0.45, 0, None)], "dominant_confounding", True), ([("viability", "measured", 0.7 - 1e-13, 0, None)], "possible_confounding", True),
    ([("viability", "measured", 0.8 - 1e-13, 0, None)], "unlikely_confounding", False), ([("viability", "measured", 0.95, 0, "Cytotoxic")], "unlikely_confounding", False),
    ([("viability", "declared", 0.95, 0, "very CYTOTOXIC")], "likely_confounding", True), ([("apoptosis_necrosis", "measured", 0.2, 0, None)], "unlikely_confounding", False),
    ([("apoptosis_necrosis", "measured", 0.2 + 1e-13, 0, None)], "possible_confounding", False), ([("apoptosis", "measured", 0.9, 0, None)], "unlikely_confounding", False),
    ([("viability", "measured", 0.75, 2, None)], "likely_confounding", True), ([("viability", "measured", -0.1, 1, None)], "review_required", False), ([("viability", "measured", float("nan"), 0, None)], "review_required", False),
    ([("viability", "measured", float("inf"), 0, None), ("viability", "measured", 0.9, 0, None)], "unlikely_confounding", False),
])
def test_cytotoxicity(spark, rows, confounding, detected):
    r = context.cytotoxicity(spark.createDataFrame([("d", *r) for r in rows], ASSAYS)).first()
    assert (r["confounding"], r["detected"], r["blocks"]) == (confounding, detected, confounding in ("dominant_confounding", "review_required"))


def test_public_words(spark):
    rows = [("accepted_with_caveats", "009"), ("accepted_for_pod", "010"), ("exploratory_only", "004"), ("exploratory_only", "007"), ("excluded_qc_failure", "005"), ("excluded_mapping_failure", "008"), ("excluded_coordinate_ambiguity", "001")]
    d = spark.createDataFrame([("p", "d", f"f{i}", s, r, "") for i, (s, r) in enumerate(rows)], "policy_id string, dataset_id string, feature_id string, status string, rule string, notes string")
    got = [(r["public"], r["use_rule"]) for r in qualify.public_status(d).orderBy("feature_id").collect()]
    assert got == [("accepted_with_warnings", "allow_with_warning"), ("accepted_for_pod", "allow"), ("review_required", "review_required"), ("excluded_confounding_dominant", "block"), ("excluded_high_missingness", "block"), ("excluded_mapping_ambiguous", "block"), ("excluded_missing_genome_build", "block")]


def _samples(spark, groups, unit="uM", times=None):
    rows = [("d", f"{g}{i}", g, dose, unit, (times or {}).get(g, 24.0), "biological", None, flag) for g, (dose, flag) in groups.items() for i in range(3)]
    return spark.createDataFrame(rows, "dataset_id string, sample_id string, dose_group_id string, dose_value double, dose_unit string, timepoint_hours double, replicate_type string, batch_id string, control_flag boolean")


@pytest.mark.parametrize("groups, declared, unit, times, problems, status", [
    ({"a": (0.0, False), "b": (1.0, False), "c": (2.0, False)}, None, "uM", None, "", "dose_response_minimum"), ({"a": (0.0, False), "b": (1.0, False), "c": (2.0, False), "e": (3.0, False)}, None, "uM", None, "", "dose_response_preferred"),
    ({"a": (0.0, False), "b": (1.0, False), "c": (2.0, False)}, ("b", None), "uM", None, "named_group_is_no_control", "invalid"), ({"a": (0.0, False), "b": (1.0, False), "c": (2.0, False)}, ("x", None), "uM", None, "unknown_control_group", "invalid"),
    ({"a": (0.0, False), "b": (0.5, True), "c": (2.0, False)}, None, "uM", None, "several_controls", "invalid"), ({"a": (0.0, False), "b": (0.5, True), "c": (2.0, False)}, ("b", None), "uM", None, "", "dose_response_minimum"),
    ({"a": (0.0, False), "b": (1.0, False), "c": (2.0, False)}, None, " ", None, "missing_dose_unit", "invalid"), ({"a": (0.0, False), "b": (1.0, False)}, ("b", None), "uM", {"b": 48.0}, "multi_timepoint", "invalid"),
    ({"a": (0.0, False), "b": (-1.0, False)}, None, "uM", None, "", "comparison_only"), ({"b": (1.0, False)}, None, "uM", None, "no_control", "invalid"),
])
def test_controls_and_readiness(spark, groups, declared, unit, times, problems, status):
    s = _samples(spark, groups, unit, times)
    told = spark.createDataFrame([("d", *declared)], "dataset_id string, control_group string, normalisation string") if declared else None
    assert design.control_axis(s, told).first()["problems"] == problems
    assert design.readiness(s, told).first()["status"] == status


def test_overall_takes_the_worst_of_features_and_spread(spark):
    missing = spark.createDataFrame([("a", "feature", "f", "exclusion"), ("a", "dataset", "a", "acceptable"), ("b", "sample", "s", "warning"), ("c", "group", "g", "acceptable"), ("d", "dataset", "d", "exclusion"), ("d", "feature", "f", "acceptable")], "dataset_id string, level string, key string, band string")
    names = ["a", "b", "c", "d"]
    spread = spark.createDataFrame([(x, "f", "moderate") for x in names], "dataset_id string, feature_id string, dynamic_range string")
    # replicates agree in one group and not in the other: over all pairs they do not
    stability = spark.createDataFrame([(x, g, 10, m, m) for x in names for g, m in (("g", 0.99), ("h", 0.75 if x == "b" else 0.95))], "dataset_id string, dose_group_id string, n_pairs long, mean_r double, min_r double")
    consistency = spark.createDataFrame([(x, "g", x == "c") for x in names], "dataset_id string, dose_group_id string, spread_warning boolean")
    batches = spark.createDataFrame([(x, False, x == "d") for x in names], "dataset_id string, complete boolean, nested boolean")
    got = {r["dataset_id"]: (r["missingness_band"], r["variance_band"], r["replicate_band"], r["overall"]) for r in qc.overall(missing, spread, stability, consistency, batches).collect()}
    assert got == {"a": ("exclusion", "acceptable", "stable", "exclusion"), "b": ("warning", "warning", "stable", "warning"), "c": ("acceptable", "acceptable", "unstable", "warning"), "d": ("acceptable", "acceptable", "stable", "warning")}


@pytest.mark.parametrize("text, hit", [("RfD", True), ("surfd", False), ("reference_dose", True), ("margin-of exposure", True), ("a safe_level", True), ("plain words", False), ("Health based-guidance", True), ("market authorization", True), ("padi", False)])
def test_blocked_uses(spark, text, hit):
    assert spark.createDataFrame([(text,)], "text string").select(context.names_blocked_use(F.col("text"))).first()[0] is hit


@pytest.mark.parametrize("text, true", [("no-BER-or-final-risk-decision", True), ("No_BER  or: FINAL‐risk decision", True), ("pod-interpretation-and-ber-policy-owned-by-external-orchestrator", True), ("no ber", False), ("final risk decision", False), ("n0-ber-or-final-risk-decision", False)])
def test_boundaries(spark, text, true):
    assert spark.createDataFrame([(text,)], "text string").select(handoff.is_boundary(F.col("text"))).first()[0] is true


def test_caveats_come_once_in_order_of_first_occurrence(spark):
    schema = "dataset_id string, feature_id string, position long, nth long, code string, category string, severity string, message string, blocks boolean"
    rows = [("d", "f9", 1, 2, "B", "c", "error", "first", True), ("d", "f1", 5, 0, "B", "c", "error", "later", True), ("d", "f1", 5, 1, "A", "c", "error", "m", True), ("d", None, None, 3, "Z", "c", "error", "whole", True), ("d", "f9", 1, 0, "N", "c", "warning", "no", False), ("e", None, None, 0, "Q", "c", "error", "other", True)]
    caveats = handoff.mandatory_caveats(spark.createDataFrame(rows, schema).repartition(5), spark.createDataFrame([("p", "d"), ("q", "d")], "policy_id string, dataset_id string"))
    for policy in "pq":
        got = [(r["place"], r["code"], r["message"], r["feature_id"]) for r in caveats.where(F.col("policy_id") == policy).orderBy("place").collect()]
        assert got == [(0, "Z", "whole", None), (1, "B", "first", "f9"), (2, "A", "m", "f1")]


def test_packets_are_written_in_parts_and_read_as_one(spark, tmp_path):
    decided = [("p", "d", f"f{i}", "accepted_for_pod" if i % 3 else "excluded_qc_failure", "010" if i % 3 else "005", "") for i in range(50)] + [("p", "e", "f1", "accepted_for_pod", "010", ""), ("p", "g", "f1", "excluded_qc_failure", "005", "")]
    d = spark.createDataFrame(decided, "policy_id string, dataset_id string, feature_id string, status string, rule string, notes string")
    designs = spark.createDataFrame([("d", "dose_response_minimum"), ("e", "comparison_only"), ("g", "dose_response_preferred")], "dataset_id string, status string")
    caveats = spark.createDataFrame([("p", "d", 0, "A", "c", "error", "m", None), ("p", "d", 1, "B", "c", "error", "n", "f1")], "policy_id string, dataset_id string, place int, code string, category string, severity string, message string, feature_id string")
    claims = spark.createDataFrame([("d", "not_assessed", "reversible", None)], "dataset_id string, persistence_status string, reversibility_status string, heritability_claim string")
    steps = spark.createDataFrame([("d", 2, "call", "macs2"), ("d", 1, "align", "bwa")], "dataset_id string, step_no long, step_name string, tool_name string")
    out = handoff.packets(d, designs, caveats, claims, steps, 8)
    out.select("document").write.text(f"{tmp_path}/packets")
    docs = [json.loads(r[0]) for r in spark.read.text(f"{tmp_path}/packets").collect()]
    assert {x["source"] for x in docs} == {"d"} and sum("mandatory_caveats" in x for x in docs) == 1  # others are not ready, or have nothing accepted
    heads, rows = handoff.read_packets(spark, f"{tmp_path}/packets")
    h = heads.collect()
    assert len(h) == 1 and h[0]["parts"] == 7 and [c["code"] for c in h[0]["mandatory_caveats"]] == ["A", "B"] and [s["step_name"] for s in h[0]["provenance"]] == ["align", "call"]
    assert (h[0]["persistence_status"], h[0]["reversibility_status"], h[0]["heritability_claim"]) == ("not_assessed", "reversible", None)
    got = {(r["list"], r["feature_id"], r["status"]) for r in rows.collect()}
    assert got == {("qualified" if i % 3 else "excluded", f"f{i}", "accepted_for_pod" if i % 3 else "excluded_qc_failure") for i in range(50)} and rows.count() == 50


def test_audit_has_a_row_for_each_rule(spark):
    decided = spark.createDataFrame([("p", "d", "f1", "accepted_for_pod", "010", ""), ("p", "d", "f2", "accepted_for_pod", "010", ""), ("p", "e", "f1", "excluded_qc_failure", "005", "")], "policy_id string, dataset_id string, feature_id string, status string, rule string, notes string")
    ready = decided.where("dataset_id = 'd'")
    positions = spark.createDataFrame([("d", "f1", 9), ("d", "f2", 3)], "dataset_id string, feature_id string, position long")
    schema = "dataset_id string, feature_id string, position long, nth long, code string, category string, severity string, message string, blocks boolean"
    warnings = spark.createDataFrame([("d", "f2", 3, 0, "T", "cytotoxicity", "warning", "m", False), ("d", "f2", 3, 1, "S", "stress_response", "error", "m", True), ("d", "f1", 9, 0, "B", "batch_effect", "warning", "m", False), ("d", None, None, 0, "W", "c", "error", "m", True)], schema)
    claims = spark.createDataFrame([("d", "heritable", None, None, None), ("e", None, "of course", "inside", "nothing")], "dataset_id string, heritability_claim string, transition string, domain string, boundary string")
    texts = spark.createDataFrame([("d", "a reference-dose"), ("d", "plain"), ("e", "plain")], "dataset_id string, text string")
    rows = handoff.audit(decided, ready, positions, warnings, handoff.mandatory_caveats(warnings, ready), claims, texts).collect()
    got = {d: {r["rule"]: (r["verdict"], r["n"]) for r in rows if r["dataset_id"] == d} for d in "de"}
    assert got["d"] == {
        "qualification_status": ("fit_for_screening", None), "cytotoxicity": ("possible", None), "batch_effect": ("not_detected", None), "control_status": ("failed", None), "applicability_domain": ("inside", None),
        "claim_transition": ("allowed_with_review", None), "overclaims": ("surfaced", 2), "ceilings": ("limited", 6), "blockers": ("S", 1),
    }
    assert got["e"] == {
        "qualification_status": ("blocked", None), "cytotoxicity": ("not_assessed", None), "batch_effect": ("not_assessed", None), "control_status": ("not_assessed", None), "applicability_domain": ("inside", None),
        "claim_transition": ("blocked", None), "overclaims": ("none", 0), "ceilings": ("absent", 0), "blockers": ("", 0),
    }


def test_groups_of_one_dose_are_ordered_without_case(spark):
    s = spark.createDataFrame([("d", f"s{i}", g, x) for i, (g, x) in enumerate([("B", 0.0), ("a", 0.0), ("b", 0.0), ("A", 1.0)])], "dataset_id string, sample_id string, dose_group_id string, dose_value double")
    assert [r["dose_group_id"] for r in design.dose_axis(s).orderBy("position").collect()] == ["a", "B", "b", "A"]


def test_causes_of_exclusion(spark):
    decided = spark.createDataFrame([("p", "d", "f1", "accepted_for_pod"), ("p", "d", "f2", "excluded_qc_failure"), ("p", "d", "f3", "excluded_qc_failure"), ("p", "e", "f1", "accepted_with_caveats")], "policy_id string, dataset_id string, feature_id string, status string")
    designs = spark.createDataFrame([("d", "invalid"), ("e", "comparison_only")], "dataset_id string, status string")
    coordinates = spark.createDataFrame([("d", True), ("e", False)], "dataset_id string, valid boolean")
    got = {(r["dataset_id"], r["cause"]): r["n"] for r in qualify.exclusion_causes(decided, designs, coordinates).collect()}
    assert got == {("d", "design_validation_failed"): 1, ("d", "excluded_qc_failure"): 2, ("e", "coordinate_validation_failed"): 1}
