"""Hand-off packets of qualified features: mandatory caveats, documents in parts, and the audit of what a packet claims.

Warnings are rows (dataset_id, feature_id, position, nth, code, category, severity, message, blocks) and may name a
policy_id; those of a packet as a whole have no feature and come first, others follow the position of their feature and
then ``nth``. Order is carried as columns, so it holds through any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import stable_id
from .context import names_blocked_use
from .qualify import ACCEPTED
from .qualify import handoff as accepted

KEYS = ["policy_id", "dataset_id"]
#: Phrases of a boundary of which all of one family must stand in it, claims of heredity and the use they amount to.
BOUNDARIES = (("no ber", "final risk decision"), ("ber policy", "external orchestrator"))
STANDING_BOUNDARY = "pod-interpretation-and-ber-policy-owned-by-external-orchestrator"
HEREDITY = {"heritable": "heritability_adversity_claim", "transgenerational": "transgenerational_adversity_claim"}
DOMAINS = ("inside", "outside", "boundary", "unknown_with_blocker", "not_assessed")
TRANSITIONS = ("allowed", "allowed_with_review", "blocked", "not_assessed")


def mandatory_caveats(warnings: DataFrame, packets: DataFrame) -> DataFrame:
    """(policy_id, dataset_id, place, code, category, severity, message, feature_id): of each packet the warnings that block, each
    code once, as it was first met, in that order. A code's first row is found by a map-side minimum."""
    order = F.struct(F.col("feature_id").isNotNull().alias("own"), F.coalesce("position", F.lit(0)).cast("long").alias("position"), F.coalesce("nth", F.lit(0)).cast("long").alias("nth"))
    blocking = warnings.where("blocks")
    on = [c for c in KEYS if c in warnings.columns]
    first = blocking.groupBy(*on, "code").agg(F.min(F.struct(order.alias("at"), "category", "severity", "message", "feature_id")).alias("first"))
    rows = first.join(packets.select(*KEYS).distinct(), on)
    place = F.row_number().over(Window.partitionBy(*KEYS).orderBy("first.at", "code")) - 1
    return rows.select(*KEYS, place.alias("place"), "code", "first.category", "first.severity", "first.message", "first.feature_id")


def packets(decided: DataFrame, designs: DataFrame, caveats: DataFrame, claims: DataFrame, provenance: DataFrame, per_document: int = 10_000) -> DataFrame:
    """(policy_id, dataset_id, part, document): JSON documents of the hand-offs, of data sets that are ready for dose-response
    and have an accepted feature only.

    Every decision is in one part; parts hold about ``per_document`` of them, dealt by a hash of the feature, so no data set
    goes through one task. The first part carries the caveats in order, the guarded claims and the steps of provenance.
    """
    ready = accepted(decided, designs)
    sent = ready.select(*KEYS).distinct()
    own = decided.join(sent, KEYS, "left_semi")
    n = own.groupBy(*KEYS).agg(F.ceil(F.count("*") / per_document).alias("parts"))
    dealt = own.join(n, KEYS).withColumn("part", F.pmod(F.xxhash64("feature_id"), F.col("parts")))
    good = F.col("status").isin(*ACCEPTED)
    decision = F.struct("feature_id", "status", "rule", "notes")
    rows = dealt.groupBy(*KEYS, "part").agg(F.any_value("parts").alias("parts"), F.sort_array(F.collect_list(F.when(good, decision))).alias("qualified"), F.sort_array(F.collect_list(F.when(~good, decision))).alias("excluded"))
    told = caveats.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("place", "code", "category", "severity", "message", "feature_id"))).alias("mandatory_caveats"))
    steps = provenance.groupBy("dataset_id").agg(F.sort_array(F.collect_list(F.struct("step_no", "step_name", "tool_name"))).alias("provenance"))
    head = sent.join(told, KEYS, "left").join(claims.select("dataset_id", "persistence_status", "reversibility_status", "heritability_claim"), "dataset_id", "left").join(steps, "dataset_id", "left")
    head = head.withColumn("part", F.lit(0).cast("long"))
    # the hash may deal nothing to the first part
    whole = rows.join(head, [*KEYS, "part"], "full_outer").join(n.select(*KEYS, F.col("parts").alias("of")), KEYS)
    none = F.array().cast(rows.schema["qualified"].dataType)
    body = F.struct(
        F.lit("0.1.0").alias("schema_version"), stable_id(F.col("policy_id"), F.col("dataset_id"), F.lit("handoff")).alias("handoff_id"), "policy_id", F.col("dataset_id").alias("source"), "part", F.col("of").alias("parts"),
        F.coalesce("qualified", none).alias("qualified"), F.coalesce("excluded", none).alias("excluded"), "mandatory_caveats", "persistence_status", "reversibility_status", "heritability_claim", "provenance",
    )
    return whole.select(*KEYS, "part", F.to_json(body).alias("document"))


_DECISION = "array<struct<feature_id: string, status: string, rule: string, notes: string>>"
_CAVEAT = "array<struct<place: int, code: string, category: string, severity: string, message: string, feature_id: string>>"
_STEP = "array<struct<step_no: bigint, step_name: string, tool_name: string>>"
DOCUMENT = (
    f"schema_version string, handoff_id string, policy_id string, source string, part long, parts long, qualified {_DECISION}, excluded {_DECISION}, mandatory_caveats {_CAVEAT}, "
    f"persistence_status string, reversibility_status string, heritability_claim string, provenance {_STEP}"
)


def read_packets(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(heads, decisions) of written documents, the parts of a packet put together: a head for each packet with the number of
    parts found, and a row for each decision with its list (qualified or excluded)."""
    docs = spark.read.schema(DOCUMENT).json(path).withColumnRenamed("source", "dataset_id")
    fields = ["mandatory_caveats", "persistence_status", "reversibility_status", "heritability_claim", "provenance"]
    first = lambda c: F.max_by(c, F.col("part") == 0).alias(c)
    heads = docs.groupBy(*KEYS).agg(F.any_value("handoff_id").alias("handoff_id"), F.count("*").alias("n_parts"), F.max("parts").alias("parts"), *map(first, fields))
    one = lambda name: docs.select(*KEYS, F.lit(name).alias("list"), F.explode(name).alias("d")).select(*KEYS, "list", "d.*")
    return heads, one("qualified").unionByName(one("excluded"))


def is_boundary(text: Column) -> Column:
    """Whether a text has all phrases of one family, marks and separators aside."""
    plain = F.lower(F.regexp_replace(F.regexp_replace(text, r"[\p{Mn}\p{Cf}]", ""), r"[-_\s‐-―−⁃]+", " "))
    has = [F.lit(True), F.lit(True)]
    for i, family in enumerate(BOUNDARIES):
        for phrase in family:
            has[i] = has[i] & plain.contains(phrase)
    return has[0] | has[1]


def representatives(ready: DataFrame, positions: DataFrame) -> DataFrame:
    """The first ready feature of each packet by its position."""
    rows = ready.select(*KEYS, "feature_id").join(positions.select("dataset_id", "feature_id", "position"), ["dataset_id", "feature_id"])
    return rows.groupBy(*KEYS).agg(F.min_by("feature_id", F.struct("position", "feature_id")).alias("feature_id"))


def audit(decided: DataFrame, ready: DataFrame, positions: DataFrame, warnings: DataFrame, caveats: DataFrame, claims: DataFrame, texts: DataFrame) -> DataFrame:
    """(policy_id, dataset_id, rule, verdict, n): what every packet with decisions claims, a row for each rule.

    Of the representative ready feature the categories of its warnings decide cytotoxicity, batch effects and (where they block)
    the controls. ``claims``: (dataset_id, heritability_claim, transition, domain, boundary), null where nothing is declared;
    ``texts``: (dataset_id, text), labels and declared uses. Ceilings count the caveats, the warnings of all features and a true
    boundary; blockers are the codes of blocking warnings that name ready features.
    """
    sent = decided.select(*KEYS).distinct()
    by_policy = warnings if "policy_id" in warnings.columns else warnings.join(sent, "dataset_id")
    one = representatives(ready, positions)
    ids = [*KEYS, "feature_id"]
    mine = one.join(by_policy, ids, "left").groupBy(*KEYS).agg(
        F.coalesce(F.bool_or(F.col("category") == "cytotoxicity"), F.lit(False)).alias("toxic"), F.coalesce(F.bool_or(F.col("category") == "batch_effect"), F.lit(False)).alias("batch"),
        F.coalesce(F.bool_or(F.col("category").isin("cell_composition", "stress_response") & F.col("blocks")), F.lit(False)).alias("uncontrolled"), F.lit(True).alias("some"),
    )
    counts = by_policy.where("feature_id is not null").join(decided.select(*ids), ids, "left_semi").groupBy(*KEYS).agg(F.count("*").alias("n_warnings"))
    touching = by_policy.where("blocks and feature_id is not null").join(ready.select(*ids), ids, "left_semi").groupBy(*KEYS).agg(F.array_sort(F.collect_set("code")).alias("blockers"))
    held = caveats.groupBy(*KEYS).agg(F.count("*").alias("n_caveats"))
    told = texts.where(names_blocked_use(F.col("text"))).groupBy("dataset_id").agg(F.count("*").alias("n_texts"))
    rows = sent.join(mine, KEYS, "left").join(counts, KEYS, "left").join(touching, KEYS, "left").join(held, KEYS, "left").join(told, "dataset_id", "left").join(claims, "dataset_id", "left")
    some, on, zero = F.coalesce("some", F.lit(False)), lambda c: F.coalesce(c, F.lit(False)), lambda c: F.coalesce(c, F.lit(0)).cast("long")
    verdict = lambda hit, yes, no: F.when(~some, "not_assessed").when(on(hit), yes).otherwise(no)
    heir = F.col("heritability_claim").isin(*HEREDITY)
    boundary = is_boundary(F.coalesce("boundary", F.lit(STANDING_BOUNDARY)))
    domain = F.when(F.col("domain").isin(*DOMAINS), F.col("domain")).when(F.col("domain").isNull() & some, "inside").otherwise("absent")
    transition = F.when(F.col("transition").isin(*TRANSITIONS), F.col("transition")).when(on(heir), TRANSITIONS[1]).otherwise(TRANSITIONS[2])
    n_uses = zero("n_texts") + on(heir).cast("long")
    n_ceilings = zero("n_caveats") + zero("n_warnings") + on(boundary).cast("long")
    blockers = F.concat_ws(",", "blockers")
    rule = lambda name, v, n=F.lit(None).cast("long"): F.struct(F.lit(name).alias("rule"), v.alias("verdict"), n.alias("n"))
    every = F.array(
        rule("qualification_status", F.when(some, "fit_for_screening").otherwise("blocked")), rule("cytotoxicity", verdict(F.col("toxic"), "possible", "ruled_out")),
        rule("batch_effect", verdict(F.col("batch"), "unresolved", "not_detected")), rule("control_status", verdict(F.col("uncontrolled"), "failed", "passed")), rule("applicability_domain", domain),
        rule("claim_transition", transition), rule("overclaims", F.when(n_uses > 0, "surfaced").otherwise("none"), n_uses), rule("ceilings", F.when(n_ceilings > 0, "limited").otherwise("absent"), n_ceilings),
        rule("blockers", blockers, F.coalesce(F.size(F.coalesce("blockers", F.array().cast("array<string>"))), F.lit(0)).cast("long")),
    )
    return rows.select(*KEYS, F.explode(every).alias("r")).select(*KEYS, "r.*")
