"""The rule cascade that decides which features go on to dose-response modelling, its policies, and hand-offs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import BUILDS, HALF_OPEN, convention, stable_id
from .context import LEVELS, NO_CONTEXT, names_blocked_use
from .design import readiness
from .genes import PEAK_CLASSES, builds

#: What a policy holds by default.
DEFAULTS = {"warn_missing": 0.1, "max_missing": 0.2, "min_replicates": 2, "preferred_replicates": 3, "n1_policy": "excluded", "preferred_levels": 4, "block_level": "dominant_confounding", "block_missing_context": False}
VERSION = "0.1.0"


def policies(overrides: DataFrame) -> DataFrame:
    """One row per policy: defaults where an override is null or has no such column. An override of another version than
    ``VERSION`` fails the query."""
    value = lambda k, v: F.coalesce(F.col(k), F.lit(v)) if k in overrides.columns else F.lit(v)
    rows = overrides
    if "version" in overrides.columns:
        fail = F.raise_error(F.concat(F.lit("policy "), "policy_id", F.lit(" is of another version")))
        rows = overrides.where(F.when(F.coalesce("version", F.lit(VERSION)) == VERSION, True).otherwise(fail.cast("boolean")))
    return rows.select("policy_id", *(value(k, v).alias(k) for k, v in DEFAULTS.items()), *(["dataset_id"] if "dataset_id" in overrides.columns else []))


def _rank(c: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, LEVELS)), c)


def dataset_verdicts(samples: DataFrame, contexts: dict[str, DataFrame]) -> DataFrame:
    """(dataset_id, design_blocked, levels, least, and one column of confounding for each context): the design's readiness
    without its replicate blocker, and the classes of ``contexts`` (category -> dataset_id, confounding)."""
    ready = readiness(samples)
    others = F.filter(F.split("blockers", ","), lambda x: ~x.isin("", "insufficient_biological_replicates"))
    out = ready.select("dataset_id", (F.size(others) > 0).alias("design_blocked"), "levels", "least")
    for category, classes in contexts.items():
        out = out.join(classes.select("dataset_id", F.col("confounding").alias(category)), "dataset_id", "left").withColumn(category, F.coalesce(category, F.lit(NO_CONTEXT)))
    return out


def measured(features: DataFrame, cells: DataFrame, samples: DataFrame) -> DataFrame:
    """``features`` with the share of the design's samples that have no value, and whether a value is infinite."""
    sizes = samples.groupBy("dataset_id").agg(F.countDistinct("sample_id").alias("n_samples"))
    x = F.col("value")
    own = cells.join(samples.select("dataset_id", "sample_id").distinct(), ["dataset_id", "sample_id"])
    per = own.groupBy("dataset_id", "feature_id").agg(F.count_if(x.isNotNull() & ~F.isnan(x)).alias("n_present"), F.bool_or(F.abs(x) == float("inf")).alias("infinite"))
    rows = features.join(sizes, "dataset_id", "left").join(per, ["dataset_id", "feature_id"], "left")
    missing = 1 - F.coalesce(F.try_divide(F.coalesce("n_present", F.lit(0)), "n_samples"), F.lit(0.0))
    return rows.withColumn("missing_fraction", missing).withColumn("non_finite", F.coalesce("infinite", F.lit(False))).drop("n_samples", "n_present", "infinite")


def cascade(features: DataFrame, designs: DataFrame, mappings: DataFrame, policy: DataFrame, contexts: tuple[str, ...] = ("cell_composition", "cytotoxicity")) -> DataFrame:
    """(policy_id, dataset_id, feature_id, status, rule, notes): the first rule that fires decides; notes are the warnings
    gathered before it.

    ``features`` carries missing_fraction and non_finite (``measured``), ``designs`` are ``dataset_verdicts`` with a column of
    confounding for each of ``contexts``. Policies that name data sets hold for these; others for all, whose decisions
    are then as many times the features. Dataset and policy rows are few and join onto features without moving them
    further than by dataset.
    """
    ruled = designs.join(builds(features), "dataset_id")
    ruled = ruled.join(policy, "dataset_id") if "dataset_id" in policy.columns else ruled.crossJoin(policy)
    rows = features.join(mappings, ["dataset_id", "feature_id"], "left").join(ruled, "dataset_id")
    has_region = F.col("chrom").isNotNull()
    level = lambda c: _rank(F.col(c))
    limit = _rank(F.col("block_level"))
    missing = [F.col("block_missing_context") & (F.col(c) == NO_CONTEXT) for c in contexts]
    blocked = [level(c) >= limit for c in contexts]
    stopped = F.lit(False)
    for x in (*missing, *blocked):
        stopped = stopped | x
    one = F.col("least") == 1
    steps: list[tuple[Column, str, str]] = [
        (has_region & F.col("build").isNull(), "001", "excluded_coordinate_ambiguity"),
        (has_region & (~F.col("build").isin(*BUILDS) | (F.col("n_builds") > 1)), "002", "excluded_coordinate_ambiguity"),
        (F.col("design_blocked"), "003", "excluded_insufficient_design"),
        ((F.col("least") < F.col("min_replicates")) | (one & (F.col("n1_policy") == "excluded")), "004", "excluded_qc_failure"),
        (one & (F.col("n1_policy") == "review_required"), "004", "exploratory_only"),
        (F.col("missing_fraction") >= F.col("max_missing"), "005", "excluded_qc_failure"),
        (F.col("non_finite"), "006", "excluded_qc_failure"),
        (stopped, "007", "exploratory_only"),
        (F.coalesce("ambiguous", F.lit(False)), "008", "excluded_mapping_failure"),
    ]
    notes = [
        (2, "EPIW001_COORDINATE_SYSTEM_NONSTANDARD", has_region & (convention(F.col("coord_system")) != HALF_OPEN)),
        (3, "EPIW005_BELOW_PREFERRED_DOSE_GROUPS", F.col("levels") < F.col("preferred_levels")),
        (5, "EPIW006_BELOW_PREFERRED_REPLICATES", F.col("least") < F.col("preferred_replicates")),
        (6, "EPIW002_ELEVATED_MISSINGNESS", F.col("missing_fraction") >= F.col("warn_missing")),
        *((8, f"EPIW004_{c.upper()}_CONFOUNDING", F.col(c).isin(*LEVELS[1:4]) & ~b) for c, b in zip(contexts, blocked)),
        (9, "EPIW003_PROXIMITY_NOT_CAUSALITY", F.col("feature_class").isin(*PEAK_CLASSES)),
        (9, "EPIW007_NEAREST_GENE_ONLY", (F.col("method") == "nearest_gene") & (F.col("n_genes") > 0)),
    ]
    last = len(steps) + 1
    fired = F.lit(last)
    for i in range(len(steps), 0, -1):
        fired = F.when(F.coalesce(steps[i - 1][0], F.lit(False)), i).otherwise(fired)
    rows = rows.withColumn("fired", fired)
    kept = F.array_compact(F.array(*(F.when(F.coalesce(hit, F.lit(False)) & (F.col("fired") > after), code) for after, code, hit in notes)))
    rows = rows.withColumn("notes", F.concat_ws(",", kept))
    status, rule = F.when(F.col("notes") != "", "accepted_with_caveats").otherwise("accepted_for_pod"), F.when(F.col("notes") != "", "009").otherwise("010")
    for i, (_, r, s) in enumerate(steps, 1):
        status, rule = F.when(F.col("fired") == i, s).otherwise(status), F.when(F.col("fired") == i, r).otherwise(rule)
    return rows.select("policy_id", "dataset_id", "feature_id", status.alias("status"), rule.alias("rule"), "notes")


#: The statuses of the second vocabulary that are no exclusions.
PUBLIC = ("accepted_for_pod", "accepted_with_warnings", "review_required", "exploratory_only")


def public_status(decided: DataFrame) -> DataFrame:
    """The second vocabulary and the use rule that follows from it."""
    s, r = F.col("status"), F.col("rule")
    public = (
        F.when((s == "exploratory_only") & (r == "004"), "review_required").when((s == "exploratory_only") & (r == "007"), "excluded_confounding_dominant")
        .when((s == "excluded_coordinate_ambiguity") & (r == "001"), "excluded_missing_genome_build").when(s == "excluded_coordinate_ambiguity", "excluded_invalid_coordinates")
        .when((s == "excluded_qc_failure") & (r == "005"), "excluded_high_missingness").when((s == "excluded_qc_failure") & (r == "006"), "excluded_non_numeric_response")
        .when((s == "excluded_qc_failure") & (r == "004"), "excluded_insufficient_design").when(s == "excluded_mapping_failure", "excluded_mapping_ambiguous")
        .when(s == "accepted_with_caveats", PUBLIC[1]).otherwise(s)
    )
    rule = F.when(F.col("public") == PUBLIC[0], "allow").when(F.col("public") == PUBLIC[1], "allow_with_warning").when(F.col("public") == "review_required", "review_required").when(F.col("public") == "exploratory_only", "exploratory_only").otherwise("block")
    return decided.withColumn("public", public).withColumn("use_rule", rule).withColumn("decision_id", stable_id(F.col("policy_id"), F.col("dataset_id"), F.col("feature_id"), F.col("rule")))


#: What each rule says (with places for the feature, the threshold and what was observed), what to do about it, the policy
#: that it follows from, and whether a person must look.
TEXTS = (
    ("001", "{feature}: a region without a genome build ({observed}); the policy requires one", "name the build of the region", "coordinate.requireGenomeBuild", True),
    ("002", "{feature}: build {observed} is not allowed, or the data set mixes builds", "use one allowed build", "coordinate.allowedGenomeBuilds", True),
    ("003", "{feature}: the design has blockers; {observed} dose levels", "resolve the design's blockers and qualify again", "designReadiness / doseGroup / replicate", True),
    ("004", "{feature}: {observed} biological replicates in the smallest group, {threshold} required", "add replicates, or let groups of one be reviewed", "replicate.minBiologicalReplicatesPerGroup", True),
    ("005", "{feature}: {observed} of the values missing, {threshold} excludes", "look into missing samples", "missingness.exclusionThreshold", True),
    ("006", "{feature}: values that are not finite", "check normalisation for overflows", "platform_numeric_validity", True),
    ("007", "{feature}: confounding {observed} reaches {threshold}", "add context, or raise the level that blocks", "confounding.BlockLevel", True),
    ("008", "{feature}: the mapping to genes is ambiguous", "use a mapping of higher confidence", "mapping.allowedMappingMethods", True),
    ("009", "{feature}: accepted with {observed} warnings", "read the warnings", "warning_accumulation", False),
    ("010", "{feature}: accepted", None, "none", False),
)


def explain(decided: DataFrame, measured_: DataFrame | None = None, designs: DataFrame | None = None, policy: DataFrame | None = None) -> DataFrame:
    """Decisions with their text, remedy, policy and need of review. Given the features as measured, the dataset verdicts and
    the policies, the texts hold the threshold and what was observed."""
    texts = decided.sparkSession.createDataFrame(TEXTS, "rule string, template string, remedy string, reference string, needs_review boolean")
    rows = decided.join(texts, "rule")
    observed, threshold = F.when(F.col("rule") == "009", F.size(F.split("notes", ",")).cast("string")), F.lit(None).cast("string")
    if measured_ is not None and designs is not None and policy is not None:
        keys = ["dataset_id", "feature_id"]
        rows = rows.join(measured_.select(*keys, "build", "missing_fraction"), keys, "left").join(designs.select("dataset_id", "levels", "least", F.greatest(*(_rank(F.col(c)) for c in ("cell_composition", "cytotoxicity"))).alias("top")), "dataset_id", "left")
        rows = rows.join(policy.select("policy_id", "max_missing", "min_replicates", "block_level"), "policy_id", "left")
        r, text = F.col("rule"), lambda c: F.col(c).cast("string")
        level = F.element_at(F.array(*map(F.lit, LEVELS)), F.col("top").cast("int"))
        observed = F.when(r.isin("001", "002"), F.coalesce("build", F.lit("none"))).when(r == "003", text("levels")).when(r == "004", text("least")).when(r == "005", F.format_string("%.1f%%", F.col("missing_fraction") * 100)).when(r == "007", level).otherwise(observed)
        threshold = F.when(r == "004", text("min_replicates")).when(r == "005", F.format_string("%.1f%%", F.col("max_missing") * 100)).when(r == "007", F.col("block_level"))
    put = lambda t, place, v: F.replace(t, F.lit("{" + place + "}"), F.coalesce(v, F.lit("?")))
    message = put(put(put(F.col("template"), "feature", F.col("feature_id")), "observed", observed), "threshold", threshold)
    return rows.withColumn("observed", observed).withColumn("threshold", threshold).withColumn("text", message).select(*decided.columns, "text", "remedy", "reference", "needs_review", "observed", "threshold")


def summary(public: DataFrame, blocking: DataFrame) -> DataFrame:
    """Per policy and dataset: decisions by public status, exclusions by reason (as text), worst use rule (block where a
    blocking finding exists), whether a review is needed, and an id that follows from all these."""
    order = F.array(*map(F.lit, ("allow", "allow_with_warning", "review_required", "exploratory_only", "block")))
    p = F.col("public")
    named = PUBLIC
    by = public.groupBy("policy_id", "dataset_id", "public").agg(F.count("*").alias("k"), F.max(F.array_position(order, F.col("use_rule"))).alias("worst"), F.bool_or(~F.col("rule").isin("009", "010")).alias("review"))
    n = lambda s: F.coalesce(F.sum(F.when(p == s, F.col("k"))), F.lit(0))
    reasons = F.array_sort(F.collect_list(F.when(~p.isin(*named), F.concat(p, F.lit(":"), F.col("k").cast("string")))))
    per = by.groupBy("policy_id", "dataset_id").agg(
        F.sum("k").alias("n"), n(named[0]).alias("n_accepted"), n(named[1]).alias("n_caveats"), n(named[2]).alias("n_review"), n(named[3]).alias("n_exploratory"),
        F.coalesce(F.sum(F.when(~p.isin(*named), F.col("k"))), F.lit(0)).alias("n_excluded"), F.concat_ws(",", reasons).alias("excluded_by_reason"), F.max("worst").alias("worst"), F.bool_or("review").alias("needs_review"),
    )
    out = per.join(blocking.select("dataset_id").distinct().withColumn("b", F.lit(True)), "dataset_id", "left")
    out = out.withColumn("use_rule", F.when(F.col("b"), "block").otherwise(F.element_at(order, F.col("worst").cast("int")))).drop("b", "worst")
    return out.withColumn("summary_id", stable_id(*(F.col(c).cast("string") for c in ("dataset_id", "n", "n_accepted", "n_caveats", "n_review", "n_exploratory", "n_excluded", "use_rule", "needs_review", "policy_id"))))


def rule_counts(decided: DataFrame) -> DataFrame:
    return decided.groupBy("policy_id", "dataset_id", "rule").agg(F.count("*").alias("n"))


def qualified_table(features: DataFrame, public: DataFrame) -> DataFrame:
    """Every feature with its decision; one without is excluded and up for review."""
    return features.select("dataset_id", "feature_id").join(public.select("dataset_id", "feature_id", "public", "use_rule"), ["dataset_id", "feature_id"], "left").select(
        "dataset_id", "feature_id", F.coalesce("public", F.lit("excluded_no_decision")).alias("public"), F.coalesce("use_rule", F.lit("block")).alias("use_rule"), F.col("public").isNull().alias("needs_review")
    )


ACCEPTED = ("accepted_for_pod", "accepted_with_caveats")


def handoff(decided: DataFrame, designs: DataFrame) -> DataFrame:
    """Accepted features (with or without caveats) of datasets that are ready for dose-response."""
    ready = designs.where(F.col("status").isin("dose_response_minimum", "dose_response_preferred")).select("dataset_id")
    return decided.where(F.col("status").isin(*ACCEPTED)).join(ready, "dataset_id", "left_semi")


def first_blocking(findings: DataFrame) -> DataFrame:
    """The first blocking finding of each code in each dataset, by feature; one of the whole dataset comes first."""
    order = F.struct(F.col("feature_id").isNotNull().alias("one"), F.col("feature_id").alias("feature_id"))
    bad = findings.where("severity = 'error'").groupBy("dataset_id", "code").agg(F.min(order).alias("first"), F.count("*").alias("n"))
    return bad.select("dataset_id", "code", F.col("first.feature_id").alias("feature_id"), "n")


def audit(ready: DataFrame, qualified: DataFrame, excluded: DataFrame) -> DataFrame:
    """Per policy and dataset of a hand-off: ready features that are not qualified, qualified with a status that is not
    accepted, or excluded; features both qualified and excluded, repeated in either, and excluded ones of an accepted status.
    ``ready`` and the others carry source_ref; a hand-off of several or of another source than its ready rows is mixed."""
    keys = ["policy_id", "dataset_id", "feature_id"]
    part = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name), F.max(F.col("status").isin(*ACCEPTED)).alias(f"{name}_ok"), F.max("source_ref").alias(f"{name}_ref"), F.countDistinct("source_ref").alias(f"{name}_refs"))
    both = part(ready, "r").join(part(qualified, "q"), keys, "full_outer").join(part(excluded, "e"), keys, "full_outer")
    r, q, e = (F.col(c).isNotNull() for c in "rqe")
    n = lambda hit, name: F.count_if(F.coalesce(hit, F.lit(False))).alias(name)
    faults = [
        n(r & ~q, "n_unknown"), n(r & q & ~F.col("q_ok"), "n_not_accepted"), n(r & e, "n_excluded"), n(q & e, "n_both"), n((F.col("q") > 1) | (F.col("e") > 1) | (F.col("r") > 1), "n_repeated"),
        n(e & F.col("e_ok"), "n_accepted_excluded"), n((F.col("r_ref") != F.coalesce("q_ref", "r_ref")) | (F.col("r_refs") > 1), "n_other_source"),
    ]
    out = both.groupBy("policy_id", "dataset_id").agg(n(r, "n_ready"), *faults)
    names = [c for c in out.columns if c.startswith("n_") and c != "n_ready"]
    return out.withColumn("consistent", sum((F.col(c) for c in names), F.lit(0)) == 0)


def readiness_audit(ready: DataFrame, decided: DataFrame, findings: DataFrame, notes: DataFrame) -> DataFrame:
    """Per policy and dataset with decisions: a representative ready feature (the first by id), the confounding categories in
    the notes of ready features, blocking findings that touch ready features, texts that claim too much, and flags.
    ``notes`` are (dataset_id, text)."""
    keys = ["policy_id", "dataset_id"]
    own = ready.groupBy(*keys).agg(F.min("feature_id").alias("representative"), F.count("*").alias("n_ready"))
    told = ready.select(*keys, F.explode(F.split("notes", ",")).alias("note")).where(F.col("note").rlike("^EPIW004_"))
    confounding = told.select(*keys, F.regexp_replace("note", "^EPIW004_(.*)_CONFOUNDING$", "$1").alias("c")).groupBy(*keys).agg(F.concat_ws(",", F.array_sort(F.collect_set("c"))).alias("confounding"))
    touching = ready.select(*keys, "feature_id").join(findings.where("severity = 'error'").select("dataset_id", "feature_id", "code"), ["dataset_id", "feature_id"]).groupBy(*keys).agg(F.countDistinct("code").alias("n_blocking"))
    claims = notes.where(names_blocked_use(F.col("text"))).groupBy("dataset_id").agg(F.count("*").alias("n_claims"))
    out = decided.select(*keys).distinct().join(own, keys, "left").join(confounding, keys, "left").join(touching, keys, "left").join(claims, "dataset_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = out.select(*keys, "representative", zero("n_ready"), F.coalesce("confounding", F.lit("")).alias("confounding"), zero("n_blocking"), zero("n_claims"))
    flags = F.concat_ws(",", F.when(F.col("n_ready") == 0, "nothing_ready"), F.when(F.col("confounding") != "", "confounded"), F.when(F.col("n_blocking") > 0, "blocked_features_ready"), F.when(F.col("n_claims") > 0, "overclaims"))
    return out.withColumn("flags", flags)


def validation_rollup(features: DataFrame, decided: DataFrame, mappings: DataFrame, contexts: DataFrame, claims: DataFrame) -> DataFrame:
    """Per policy and dataset: features, those with a region, exclusions, mapping counts, and the inferences refused: of
    confounding without full context, of targets from nearest genes only, of persistence, reversibility or heritability.
    ``contexts``: (dataset_id, complete); ``claims``: ``guard_claims`` rows."""
    rows = decided.join(features.select("dataset_id", "feature_id", F.col("chrom").isNotNull().alias("placed")), ["dataset_id", "feature_id"]).join(mappings, ["dataset_id", "feature_id"], "left")
    n = lambda hit, name: F.count_if(F.coalesce(hit, F.lit(False))).alias(name)
    per = rows.groupBy("policy_id", "dataset_id").agg(
        F.count("*").alias("n_features"), n(F.col("placed"), "n_regions"), n(~F.col("status").isin(*ACCEPTED), "n_exclusions"), n(F.col("n_genes") > 0, "n_mapped"),
        n((F.col("method") == "nearest_gene") & (F.col("n_genes") > 0), "n_nearest_only"), n(F.col("n_genes") > 1, "n_ambiguous"), n(~F.col("rollup_allowed"), "n_rollup_blocked"),
    )
    out = per.join(contexts, "dataset_id", "left").join(claims, "dataset_id", "left")
    refused = F.concat_ws(",",
        F.when(~F.coalesce("complete", F.lit(False)), "confounding_adjustment"), F.when(F.col("n_nearest_only") > 0, "nearest_gene_targets"), F.when(F.col("persistence_status") == "not_assessed", "persistence"),
        F.when(F.col("reversibility_status") == "not_assessed", "reversibility"), F.when(F.col("heritability_claim").isNull(), "heritability"),
    )
    return out.select(*per.columns, refused.alias("refused"))


def exclusion_causes(decided: DataFrame, designs: DataFrame, coordinates: DataFrame) -> DataFrame:
    """(policy_id, dataset_id, cause, n): why a report excludes: its design (a status of ``readiness`` that is invalid), its
    coordinates (``genes.validity``), and features by their status."""
    packets = decided.select("policy_id", "dataset_id").distinct()
    whole = lambda rows, cause: packets.join(rows.select("dataset_id").distinct(), "dataset_id", "left_semi").select("policy_id", "dataset_id", F.lit(cause).alias("cause"), F.lit(1).cast("long").alias("n"))
    own = decided.where(~F.col("status").isin(*ACCEPTED)).groupBy("policy_id", "dataset_id", F.col("status").alias("cause")).agg(F.count("*").alias("n"))
    return whole(designs.where("status = 'invalid'"), "design_validation_failed").unionByName(whole(coordinates.where("not valid"), "coordinate_validation_failed")).unionByName(own)


def class_counts(features: DataFrame) -> DataFrame:
    """Features by class and by modality of each dataset."""
    by = lambda c: features.groupBy("dataset_id", F.lit(c).alias("kind"), F.coalesce(c, F.lit("none")).alias("name")).agg(F.count("*").alias("n"))
    return by("feature_class").unionByName(by("modality"))
