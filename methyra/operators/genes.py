"""Regions and genes: validation, overlap joins, nearest genes, evidence lookups and what may be rolled up.

Overlap is an equi-join on chromosome, level and bin with the overlap as residual: an interval lies in at most two bins
of the level that fits its length and looks up the bins of all coarser levels, so its length costs no rows. A pair is given
out in its first common bin only, so no distinct is needed. Bins with very many intervals are split on both sides. The
nearest start is found by one scan in each direction inside bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import BUILDS, CANONICAL, HALF_OPEN, NO_PLACES, ONE_BASED, SYSTEMS, canonical_start, chromosome, convention, distance_to_point, promoter, start_on, tss
from ..sources.scratch import written

#: Levels of bins: powers of two that are their sizes in bases.
LEVELS = (12, 16, 20, 24, 28, 32)
#: Intervals of one side that a bin holds before it is split.
DENSE = 200_000
#: Least bin in which promoters are listed, a power of two as above, and how many promoters and regions such a bin may have.
NEAR, CROWD = 10, (50_000, 5_000)
#: Feature classes that must declare a coordinate system, and those that bear peaks.
REGION_CLASSES = ("atac_peak", "chip_peak_narrow", "chip_peak_broad", "histone_mark_peak", "chromatin_interaction", "dmr", "differential_methylated_region")
PEAK_CLASSES = ("atac_peak", "chip_peak_narrow", "chip_peak_broad", "histone_mark_peak")
#: What needs the provenance of a platform, and words that tell of a lift-over.
ARRAY_MODALITIES, PROBE_CLASSES = ("dna_methylation_array",), ("cpg_methylation",)
LIFTOVER = ("liftover", "crossmap", "chain_file_conversion", "coordinate_liftover")


def normalised(features: DataFrame, target: str = CANONICAL) -> DataFrame:
    """Starts on the canonical system, on ``target``, whether the result is a region, and the error or the operation."""
    start = canonical_start(F.col("start"), F.col("coord_system"))
    error = (
        F.when(F.col("coord_system").isNull(), "no coordinate system").when(~F.col("coord_system").isin(*SYSTEMS), "unsupported coordinate system")
        .when(F.col("coord_system") == NO_PLACES, "no coordinates to normalise").when(start < 0, "negative start").when(F.col("end") <= start, "empty interval")
        .when(start.isNull() | F.col("end").isNull(), "no coordinates to normalise")
    )
    out = features.withColumn("error", error).withColumn("valid", F.col("error").isNull())
    done = F.when(F.col("coord_system") == ONE_BASED, "start shifted by -1").otherwise("unchanged")
    out = out.withColumn("canonical_start", F.when(F.col("valid"), start)).withColumn("operation", F.when(F.col("valid"), done))
    return out.withColumn("target_start", start_on(F.col("canonical_start"), F.lit(target)))


def _found(rows: DataFrame, tests: list[tuple]) -> DataFrame:
    hits = F.array_compact(F.array(*(F.when(F.coalesce(hit, F.lit(False)), F.struct(F.lit(c).alias("code"), F.lit(k).alias("kind"), F.lit(s).alias("severity"))) for c, k, s, hit in tests)))
    return rows.select("dataset_id", "feature_id", F.explode(hits).alias("f")).select("dataset_id", "feature_id", "f.*")


def findings(features: DataFrame, sizes: DataFrame, provenance: DataFrame | None = None, aliases: bool = False, need_hash: bool = False) -> DataFrame:
    """One row per finding: (dataset_id, feature_id, code, kind, severity) of coordinate systems (EPI002), builds (EPI004),
    bounds (EPI009), platforms (EPI010), names and conventions (EPIW). A feature has a region if it has a chromosome.

    ``sizes``: (build, chrom, length), joined as Spark chooses; ``provenance``: (dataset_id, step_name, tool_name). With
    ``aliases`` chromosome names are made canonical first, and each change is a finding. Findings of a dataset as a whole
    (mixed builds, lift-over) have no feature.
    """
    name = chromosome(F.col("chrom"))
    rows = features.withColumn("named", name if aliases else F.col("chrom")).join(sizes.withColumnRenamed("chrom", "named"), ["build", "named"], "left")
    rows = rows.join(sizes.select("build").distinct().withColumn("sized", F.lit(True)), "build", "left")
    system, placed = F.col("coord_system"), F.col("chrom").isNotNull() & F.col("build").isNotNull()
    start = F.col("start") - F.when(convention(system) == HALF_OPEN, 0).when(convention(system).isNotNull(), 1).otherwise(0)
    derived = F.coalesce(F.col("modality").isin(*ARRAY_MODALITIES), F.lit(False)) | (F.col("feature_class").isin(*PROBE_CLASSES) & F.col("measured_identifier").isNotNull())
    tests = [
        ("EPI002", "no_system", "error", F.col("feature_class").isin(*REGION_CLASSES) & system.isNull()),
        ("EPI002", "no_coordinates", "error", F.col("feature_class").isin(*REGION_CLASSES) & (system == NO_PLACES)),
        ("EPI002", "unsupported_system", "error", ~system.isin(*SYSTEMS)),
        ("EPI004", "missing_build", "error", F.col("chrom").isNotNull() & F.col("build").isNull()),
        ("EPI004", "unsupported_build", "error", F.col("chrom").isNotNull() & ~F.col("build").isin(*BUILDS)),
        ("EPI009", "alias", "warning", placed & (F.col("named") != F.col("chrom"))),
        ("EPI009", "build_without_sizes", "error", placed & F.col("sized").isNull()),
        ("EPI009", "unknown_chromosome", "error", placed & F.col("sized") & F.col("length").isNull()),
        ("EPI009", "negative_start", "error", placed & F.col("length").isNotNull() & (start < 0)),
        ("EPI009", "beyond_end", "error", placed & (F.col("end") > F.col("length"))),
        ("EPI009", "empty_interval", "error", placed & F.col("length").isNotNull() & (F.col("end") <= start)),
        ("EPI010", "no_platform", "error", derived & F.col("platform").isNull()),
        ("EPI010", "no_manifest", "error", derived & F.col("platform").isNotNull() & F.col("manifest_version").isNull()),
        ("EPIW", "name", "warning", F.col("build").rlike("^(hg|mm|rn)") & F.col("build").isin(*BUILDS) & ~F.col("chrom").startswith("chr")),
        ("EPIW", "convention", "warning", F.col("chrom").isNotNull() & (convention(system) != HALF_OPEN)),
    ]
    if need_hash:
        tests.append(("EPI010", "no_hash", "warning", derived & F.col("platform").isNotNull() & F.col("manifest_version").isNotNull() & F.col("annotation_hash").isNull()))
    whole = lambda df, kind, severity: df.select("dataset_id", F.lit(None).cast("string").alias("feature_id"), F.lit("EPI004").alias("code"), F.lit(kind).alias("kind"), F.lit(severity).alias("severity"))
    out = _found(rows, tests).unionByName(whole(builds(features).where("n_builds > 1"), "mixed_builds", "error"))
    if provenance is not None:
        step = F.lower(F.concat_ws(" ", "step_name", "tool_name"))
        out = out.unionByName(whole(provenance.where(step.rlike("|".join(LIFTOVER))), "liftover", "warning"))
    return out


def builds(features: DataFrame) -> DataFrame:
    """Per dataset the number of allowed builds among features with a region."""
    used = F.when(F.col("chrom").isNotNull() & F.col("build").isin(*BUILDS), F.col("build"))
    return features.groupBy("dataset_id").agg(F.countDistinct(used).alias("n_builds"))


def validity(found: DataFrame) -> DataFrame:
    """Per dataset with findings: errors, warnings, whether it is valid, and whether interpretation is blocked (EPI010)."""
    return found.groupBy("dataset_id").agg(
        F.count_if(F.col("severity") == "error").alias("n_errors"), F.count_if(F.col("severity") == "warning").alias("n_warnings"),
        (F.count_if(F.col("severity") == "error") == 0).alias("valid"), F.bool_or(F.col("code") == "EPI010").alias("blocks_interpretation"),
    )


_BIN = ["chrom", "turn", "level", "bin"]


def _level(start: Column, end: Column) -> Column:
    """The finest level whose bins are at least as long as the interval."""
    size = end - start
    out = F.lit(LEVELS[-1])
    for level in reversed(LEVELS[:-1]):
        out = F.when(size <= 1 << level, level).otherwise(out)
    return out


def _sides(a: DataFrame, b: DataFrame) -> list[tuple[int, list[int]]]:
    """Number of intervals and the levels that occur (six at most) of both sides of an overlap."""
    told = [df.agg(F.count("*").alias("n"), F.collect_set(_level(F.col(s), F.col(e))).alias("levels")).withColumn("side", F.lit(i)) for i, (df, s, e) in enumerate(((a, "start", "end"), (b, "o_start", "o_end")))]
    return [(r["n"], sorted(r["levels"])) for r in sorted(told[0].unionByName(told[1]).collect(), key=lambda r: r["side"])]


def _binned(df: DataFrame, start: str, end: str, first: bool, others: list[int]) -> DataFrame:
    """Rows by bin. In turn 0 the first side looks up its own and coarser levels and the second stands on its own; in turn 1
    the second looks up coarser levels and the first stands on its own. So two intervals meet in one turn and level only,
    the coarser of theirs. Only the levels that occur on the other side are looked up."""
    own = _level(F.col(start), F.col(end))
    every = F.array(*map(F.lit, others)).cast("array<int>")
    keyed = lambda turn, levels: F.transform(levels, lambda x: F.struct(F.lit(turn).alias("turn"), x.alias("level")))
    stands = F.filter(F.array(own), lambda x: F.lit(min(others, default=99)) < x) if first else F.filter(F.array(own), lambda x: F.lit(min(others, default=99)) <= x)
    if first:
        places = F.concat(keyed(0, F.filter(every, lambda x: x >= own)), keyed(1, stands))
    else:
        places = F.concat(keyed(0, stands), keyed(1, F.filter(every, lambda x: x > own)))
    rows = df.select("*", F.explode(places).alias("_at")).select(*df.columns, "_at.turn", "_at.level")
    at = F.expr(f"shiftright(cast({start} as bigint), level)")
    return rows.withColumn("bin", F.explode(F.sequence(at, F.greatest(at, F.expr(f"shiftright(cast({end} as bigint) - 1, level)")))))


def _sliced(rows: DataFrame, by: list[str], own: DataFrame, other: DataFrame, mine: str, theirs: str) -> DataFrame:
    """Rows of split bins: dealt over their own side's slices by a hash of ``by``, once for each slice of the other side."""
    rows = rows.join(own.withColumnRenamed("k", "_own"), _BIN, "left").join(other.withColumnRenamed("k", "_other"), _BIN, "left")
    dealt = F.pmod(F.xxhash64(*by), F.coalesce("_own", F.lit(1))).cast("int")
    return rows.withColumn(mine, dealt).withColumn(theirs, F.explode(F.sequence(F.lit(0), F.coalesce("_other", F.lit(1)) - 1))).drop("_own", "_other")


def overlaps(regions: DataFrame, others: DataFrame, dense: int = DENSE) -> DataFrame:
    """All pairs of ``regions`` (feature_id, chrom, start, end) and ``others`` (gene_id, chrom, o_start, o_end) that overlap.

    Levels that occur are asked first. Where a side has more than ``dense`` intervals, bins that hold as many are counted;
    there the side is dealt over slices and the other side sent to each of them, so no task has a whole dense bin."""
    (n, la), (m, lb) = _sides(regions, others)
    a, b = _binned(regions, "start", "end", True, lb), _binned(others, "o_start", "o_end", False, la)
    keys = _BIN
    if max(n, m) > dense:
        crowded = lambda rows: rows.groupBy(*_BIN).agg(F.count("*").alias("n")).where(F.col("n") > dense).select(*_BIN, F.ceil(F.col("n") / dense).cast("int").alias("k"))
        tagged = written(crowded(a).withColumn("side", F.lit(0)).unionByName(crowded(b).withColumn("side", F.lit(1))))
        if not tagged.isEmpty():  # few rows by their making: one for ``dense`` intervals; Spark broadcasts them by their size
            ka, kb = (tagged.where(F.col("side") == i).drop("side") for i in (0, 1))
            a, b = _sliced(a, ["feature_id", "start", "end"], ka, kb, "s0", "s1"), _sliced(b, ["gene_id", "o_start", "o_end"], kb, ka, "s1", "s0")
            keys = [*_BIN, "s0", "s1"]
    meets = (F.col("start") < F.col("o_end")) & (F.col("o_start") < F.col("end"))
    first = F.expr("bin = greatest(shiftright(cast(start as bigint), level), shiftright(cast(o_start as bigint), level))")
    out = a.join(b, keys).where(meets & first)
    return out.select("chrom", *(c for c in [*regions.columns, *others.columns] if c != "chrom"))


def promoter_overlaps(regions: DataFrame, genes: DataFrame, up: int = 2000, down: int = 500) -> DataFrame:
    low, high = promoter(F.col("start"), F.col("end"), F.col("strand"), up, down)
    return overlaps(regions, genes.select("gene_id", "chrom", low.alias("o_start"), high.alias("o_end")))


def body_overlaps(regions: DataFrame, genes: DataFrame) -> DataFrame:
    return overlaps(regions, genes.select("gene_id", "chrom", F.col("start").alias("o_start"), F.col("end").alias("o_end")))


def nearest(regions: DataFrame, genes: DataFrame, size: int = 1_000_000) -> DataFrame:
    """Genes whose start site is nearest to each region, all of equal distance; regions on chromosomes without genes have
    none. The best distance comes from the last site before and the first at or after the region's start.

    Sites and starts are laid out by chromosome and bin of ``size`` bases and scanned once in each direction inside a bin.
    Where a bin has no site on a side, the nearest border site of the other bins serves: these are two rows per filled bin,
    so only they pass through a window of a whole chromosome, whose length bounds their number.
    """
    sites = genes.select("chrom", "gene_id", tss(F.col("start"), F.col("end"), F.col("strand")).alias("site"))
    bin_of = lambda c: F.floor(F.col(c) / size).alias("bin")
    points = sites.select("chrom", bin_of("site"), F.col("site").alias("pos"), F.lit(None).cast("string").alias("feature_id"), F.lit(None).cast("long").alias("end"), F.col("site").alias("at"), F.lit(0).alias("kind")).distinct()
    asks = regions.select("chrom", bin_of("start"), F.col("start").alias("pos"), "feature_id", F.col("end").cast("long").alias("end"), F.lit(None).cast("long").alias("at"), F.lit(1).alias("kind"))
    line = Window.partitionBy("chrom", "bin")
    ahead, back = line.orderBy("pos", F.desc("kind")), line.orderBy(F.desc("pos"), "kind")
    seen = Window.unboundedPreceding
    both = points.unionByName(asks).withColumn("left", F.last("at", True).over(ahead.rowsBetween(seen, -1))).withColumn("right", F.last("at", True).over(back.rowsBetween(seen, 0)))
    # borders of all bins that hold regions or sites: the last site before the bin, the first after it
    bins = both.groupBy("chrom", "bin").agg(F.min("at").alias("low"), F.max("at").alias("high"))
    along = Window.partitionBy("chrom")
    borders = bins.select(
        "chrom", "bin", F.last("high", True).over(along.orderBy("bin").rowsBetween(seen, -1)).alias("before"), F.last("low", True).over(along.orderBy(F.desc("bin")).rowsBetween(seen, -1)).alias("after")
    )
    asked = both.where("kind = 1").join(borders, ["chrom", "bin"]).select("chrom", "feature_id", F.col("pos").alias("start"), "end", F.coalesce("left", "before").alias("left"), F.coalesce("right", "after").alias("right"))
    right = F.when(F.col("right") <= F.col("end"), 0).otherwise(F.col("right") - F.col("end"))
    best = asked.withColumn("distance", F.least(F.col("start") - F.col("left"), right)).where("distance is not null")
    inside = overlaps(
        best.where("distance = 0").select("feature_id", "chrom", "start", (F.col("end") + 1).alias("end")),
        sites.select("gene_id", "chrom", F.col("site").alias("o_start"), (F.col("site") + 1).alias("o_end")),
    ).select("feature_id", "gene_id", F.lit(0).cast("long").alias("distance"))
    away = best.where("distance > 0").select("chrom", "feature_id", "distance", F.explode(F.array(F.col("start") - F.col("distance"), F.col("end") + F.col("distance"))).alias("site"))
    return inside.unionByName(away.join(sites, ["chrom", "site"]).select("feature_id", "gene_id", "distance"))


def checked_distance(pairs: DataFrame) -> DataFrame:
    """Distances of (start, end, site) pairs, for checks of ``nearest``."""
    return pairs.withColumn("distance", distance_to_point(F.col("start"), F.col("end"), F.col("site")))


#: Mapping methods; those that may be rolled up to pathways; those that bear no causal claim; confidence.
METHODS = ("direct_promoter_overlap", "promoter_overlap", "gene_body_overlap", "enhancer_target_from_database", "chromatin_interaction_supported", "nearest_gene", "inferred_target_gene", "unknown_target_gene")
ROLLUP = METHODS[:5]
NO_CAUSE = METHODS[5:]
CONFIDENCE = ("high", "medium", "low", "none")
#: What a mapping may be used for.
ALLOW, BLOCK_ROLLUP, EXPLORATORY, BLOCK_ALL = "allow_contextual_gene_linkage_and_pathway_rollup", "block_pathway_rollup", "exploratory_only", "block_gene_and_pathway_rollup"


def supported(features: DataFrame, evidence: DataFrame) -> DataFrame:
    """Database evidence of each feature: genes, method, use rule from how well the biosample matches, and the warning of a
    poor match. A feature without evidence has no gene, no method and an unknown match."""
    rows = features.select("feature_id").join(evidence.distinct(), "feature_id", "left").withColumn("match", F.coalesce("match", F.lit("unknown")))
    good = F.col("match").isin("exact", "close")
    rule = F.when(good, ALLOW).when(F.col("match") == "distant", BLOCK_ROLLUP).otherwise(EXPLORATORY)
    return rows.select("feature_id", "gene_id", "method", "match", rule.alias("use_rule"), F.when(~good, "EPIW005_BIOSAMPLE_CONTEXT_MISMATCH").alias("warning"))


def _gathered(mappings: DataFrame, *more: Column) -> DataFrame:
    """Per feature its sorted genes and its methods without doubles, the rank of its least confidence, if a target is unknown,
    and ``more``."""
    rank = F.array_position(F.array(*map(F.lit, CONFIDENCE)), F.col("confidence"))
    n = int(mappings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return mappings.repartition(n, "dataset_id", "feature_id").groupBy("dataset_id", "feature_id").agg(  # moved as rows, gathered in one step
        F.sort_array(F.collect_set("gene_id")).alias("genes"), F.collect_set("method").alias("methods"), F.max(rank).alias("rank"), F.bool_or(F.col("method") == "unknown_target_gene").alias("ambiguous"), *more
    )


def _told(rows: DataFrame) -> DataFrame:
    """What ``collapse`` gives, from ``_gathered`` rows; a null among the sorted genes comes first and is none."""
    n = F.size("genes") - F.when((F.size("genes") > 0) & F.get("genes", F.lit(0)).isNull(), 1).otherwise(0)
    method = F.when(F.size("methods") > 1, "multiple_methods").otherwise(F.get("methods", F.lit(0)))
    level = F.element_at(F.array(*map(F.lit, CONFIDENCE)), F.col("rank").cast("int"))
    return rows.select("dataset_id", "feature_id", F.concat_ws(",", "genes").alias("genes"), n.alias("n_genes"), method.alias("method"), level.alias("confidence"), "ambiguous")


def collapse(mappings: DataFrame) -> DataFrame:
    """Per feature of (dataset_id, feature_id, gene_id, method, confidence): sorted genes, least confidence, one method or
    multiple_methods, ambiguous if one mapping has an unknown target. Null genes are none."""
    return _told(_gathered(mappings))


def promoter_collapse(regions: DataFrame, genes: DataFrame, mappings: DataFrame, up: int = 2000, down: int = 500, crowd: tuple[int, int] = CROWD) -> DataFrame:
    """``collapse`` of the promoter overlaps of ``regions`` (dataset_id, feature_id, chrom, start, end) together with other
    ``mappings``, without a row for each pair: where genes lie close, pairs grow with the square of the data.

    Promoters are listed once for each bin in which a region that meets them may start, sorted by gene. A feature with one
    region no longer than a bin stands in the bin of its start, together with its other mappings, and takes its genes out of
    that list; they are not moved again. Features with several or longer regions, and those in bins of more than ``crowd``
    promoters or regions, go by ``overlaps``, so no list outgrows a task."""
    keys, at, spark = ["dataset_id", "feature_id"], ["chrom", "bin"], regions.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = max(NEAR, ((up + down) // 4).bit_length())
    bin_of = lambda c: F.shiftright(c.cast("long"), bits)
    low, high = promoter(F.col("start"), F.col("end"), F.col("strand"), up, down)
    sites = genes.select("gene_id", "chrom", low.alias("o_start"), high.alias("o_end"))
    first, last = bin_of(F.col("o_start") - (1 << bits) + 1), bin_of(F.col("o_end") - 1)
    near = sites.withColumn("bin", F.explode(F.sequence(first, F.greatest(first, last))))

    placed = regions.select(*keys, F.struct("chrom", "start", "end").alias("place"))
    told = mappings.select(*keys, "gene_id", "method", "confidence", F.lit(True).alias("mapped")).unionByName(placed, allowMissingColumns=True)
    one = F.get("places", F.lit(0))
    wide = F.coalesce((F.size("places") > 1) | (one["end"] - one["start"] > 1 << bits), F.lit(False))
    rows = _gathered(told, F.collect_list("place").alias("places"), F.coalesce(F.bool_or("mapped"), F.lit(False)).alias("mapped"))
    rows = written(rows.select("*", one["chrom"].alias("chrom"), one["start"].alias("start"), one["end"].alias("end"), bin_of(one["start"]).alias("bin"), wide.alias("wide")))
    plain, rest = rows.where("not wide"), rows.where("wide")
    many = lambda df, most: df.groupBy(*at).agg(F.count("*").alias("n")).where(F.col("n") > most).select(*at)
    crowded = written(many(near, crowd[0]).unionByName(many(plain.where("chrom is not null and bin is not null"), crowd[1])).distinct())
    if not crowded.isEmpty():
        plain, rest = plain.join(crowded, at, "left_anti"), rest.unionByName(plain.join(crowded, at, "left_semi"))

    lists = near.repartition(parts, *at).groupBy(*at).agg(F.sort_array(F.collect_list(F.struct("gene_id", "o_start", "o_end"))).alias("_near"))
    lists = lists.withColumn("_once", F.size(F.array_distinct("_near.gene_id")) == F.size("_near")).hint("merge")  # larger than the plan reckons
    meets = lambda g: (g["o_start"] < F.col("end")) & (F.col("start") < g["o_end"])
    found = plain.repartition(parts, *at).join(lists, at, "left")
    out = _directly(found.withColumn("_direct", F.coalesce(F.exists("_near", meets), F.lit(False))).withColumn("_hits", F.filter("_near", meets)["gene_id"]))
    if not rest.isEmpty():
        pairs = overlaps(rest.select(*keys, F.explode("places").alias("_p")).select(*keys, "_p.*"), sites)
        hits = pairs.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.collect_set("gene_id").alias("_hits"))
        same = F.col("dataset_id").eqNullSafe(F.col("_dataset_id")) & F.col("feature_id").eqNullSafe(F.col("_feature_id"))
        out = out.unionByName(_directly(rest.join(hits, same, "left").withColumn("_direct", F.col("_hits").isNotNull()).withColumn("_once", F.lit(True))))
    return _told(out)


def _directly(rows: DataFrame) -> DataFrame:
    """``_gathered`` rows, if ``mapped`` or ``_direct``, together with the genes (``_hits``, each ``_once`` or not) of the
    promoters that a feature overlaps, if it does (``_direct``)."""
    direct, none = F.col("_direct"), F.array().cast("array<string>")
    methods, hits, others = F.col("methods"), F.coalesce("_hits", none), F.col("genes")
    both = F.when(F.col("_once") & ~F.arrays_overlap(hits, others), F.concat(hits, others)).otherwise(F.array_union(hits, others))  # a union hashes all genes
    return rows.where(direct | F.col("mapped")).select(
        "dataset_id", "feature_id", F.sort_array(both).alias("genes"),
        F.when(direct, F.array_union(methods, F.array(F.lit(METHODS[0])))).otherwise(methods).alias("methods"),
        F.when(direct, F.greatest("rank", F.lit(CONFIDENCE.index("high") + 1).cast("long"))).otherwise(F.col("rank")).alias("rank"), F.when(direct, F.coalesce("ambiguous", F.lit(False))).otherwise(F.col("ambiguous")).alias("ambiguous"),
    )


def method_bit(method: Column) -> Column:
    """The bit of a method in a set of methods; a word that is none fails the query."""
    bit = F.when(method.isNotNull(), F.raise_error(F.concat(F.lit("no mapping method: "), method)).cast("int"))
    for i, m in enumerate(METHODS):
        bit = F.when(method == m, 1 << i).otherwise(bit)
    return bit


def collapsed_counts(mappings: DataFrame, keys: tuple[str, ...] = ("dataset_id", "feature_id")) -> DataFrame:
    """What decisions need of ``collapse``: number of genes, method and ambiguity of each feature, counted without lists.

    Methods go along as a set of bits (``methods``, made from ``method`` where it is not there), so both steps hash fixed
    numbers and sort nothing; rows are moved once, by ``keys``."""
    rows = mappings if "methods" in mappings.columns else mappings.withColumn("methods", method_bit(F.col("method")))
    n = int(mappings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(*keys, "gene_id", "methods").repartition(n, *keys)
    per = dealt.groupBy(*keys, "gene_id").agg(F.bit_or("methods").alias("methods")).groupBy(*keys).agg(F.count("gene_id").cast("int").alias("n_genes"), F.bit_or("methods").alias("methods"))
    one, unknown = F.lit(None).cast("string"), 1 << METHODS.index("unknown_target_gene")
    for i, m in enumerate(METHODS):
        one = F.when(F.col("methods") == 1 << i, m).otherwise(one)
    method = F.when(F.bit_count("methods") > 1, "multiple_methods").otherwise(one)
    return per.select(*keys, "n_genes", method.alias("method"), (F.col("methods").bitwiseAND(unknown) != 0).alias("ambiguous"))


def last_mapping(mappings: DataFrame) -> DataFrame:
    """The last mapping (by ``nth``) of each feature: n_genes, method, confidence, rollup_allowed, distance."""
    return mappings.groupBy("dataset_id", "feature_id").agg(F.max_by(F.struct("n_genes", "method", "confidence", "rollup_allowed", "distance"), "nth").alias("m")).select("dataset_id", "feature_id", "m.*")


def pathway_eligibility(features: DataFrame, mappings: DataFrame) -> DataFrame:
    """eligible if the last mapping allows the roll-up and its method may be rolled up; blocked, or unmapped without one."""
    may = F.col("rollup_allowed") & F.col("method").isin(*ROLLUP)
    state = F.when(F.col("method").isNull(), "unmapped").when(may, "eligible").otherwise("blocked")
    return features.select("dataset_id", "feature_id").join(last_mapping(mappings), ["dataset_id", "feature_id"], "left").select("dataset_id", "feature_id", state.alias("eligibility"), F.when(state == "blocked", "EPIW008_PATHWAY_ROLLUP_BLOCKED").alias("warning"))


def paired(requests: DataFrame, mappings: DataFrame, strict: bool = False) -> DataFrame:
    """Each request (dataset_id, feature_id) with its response, the last mapping, its warnings and why a roll-up is blocked.
    A request without a response is an error: state missing, or with ``strict`` the query fails and names it."""
    rows = requests.select("dataset_id", "feature_id").join(last_mapping(mappings), ["dataset_id", "feature_id"], "left")
    state = F.when(F.col("method").isNotNull(), "paired").otherwise(F.raise_error(F.concat(F.lit("missing mapping response for feature "), "feature_id")).cast("string") if strict else F.lit("missing"))
    warnings = F.array_compact(F.array(
        F.when(F.col("n_genes") == 0, "MAPPING_NO_TARGET"), F.when(F.col("n_genes") > 1, "MAPPING_AMBIGUOUS"), F.when((F.col("method") == "nearest_gene") & (F.col("n_genes") > 0), "MAPPING_NEAREST_GENE_ONLY"),
    ))
    reason = F.when(~F.col("rollup_allowed"), F.when(F.col("method").isin(*ROLLUP), "policy").otherwise("method"))
    return rows.withColumn("state", state).withColumn("warnings", F.concat_ws(",", warnings)).withColumn("blocked_reason", reason)


def mapping_report(pairs: DataFrame) -> DataFrame:
    """Counts of ``paired`` rows per dataset: requested, answered, mapped, unmapped, ambiguous, roll-ups and reasons, warnings."""
    got, some = F.col("state") == "paired", F.col("n_genes") > 0
    n = lambda hit, name: F.count_if(F.coalesce(hit, F.lit(False))).alias(name)
    return pairs.groupBy("dataset_id").agg(
        F.count("*").alias("requested"), n(got, "answered"), n(some, "mapped"), n(F.col("n_genes") == 0, "unmapped"), n(F.col("n_genes") > 1, "ambiguous"),
        n(F.col("rollup_allowed"), "rollup_allowed"), n(~F.col("rollup_allowed"), "rollup_blocked"), n(F.col("blocked_reason") == "method", "blocked_by_method"), n(F.col("blocked_reason") == "policy", "blocked_by_policy"),
        n(F.col("warnings").contains("NO_TARGET"), "n_no_target"), n(F.col("warnings").contains("NEAREST"), "n_nearest_only"),
    )


def inferred_targets(pairs: DataFrame) -> DataFrame:
    """Mappings to genes that a heuristic inferred, from (dataset_id, feature_id, gene_id, distance) with null genes for none:
    of low confidence, never rolled up or causal, with a warning where there is a gene."""
    per = pairs.groupBy("dataset_id", "feature_id").agg(F.countDistinct("gene_id").cast("int").alias("n_genes"), F.min("distance").alias("distance"))
    some = F.col("n_genes") > 0
    return per.select(
        "dataset_id", "feature_id", "n_genes", F.lit(METHODS[6]).alias("method"), F.when(some, CONFIDENCE[2]).otherwise(CONFIDENCE[3]).alias("confidence"), "distance", F.lit(False).alias("rollup_allowed"),
        F.lit(BLOCK_ROLLUP).alias("use_rule"), F.lit(True).alias("blocked_rollup"), F.lit(True).alias("blocked_cause"), F.when(some, "EPIW011_INFERRED_TARGET_GENE").otherwise("").alias("warnings"),
    )


def unknown_targets(features: DataFrame) -> DataFrame:
    """Mappings of features (dataset_id, feature_id) that no method gave a gene: nothing may be made of them."""
    return features.select("dataset_id", "feature_id").distinct().select(
        "dataset_id", "feature_id", F.lit(0).alias("n_genes"), F.lit(METHODS[7]).alias("method"), F.lit(CONFIDENCE[3]).alias("confidence"), F.lit(None).cast("long").alias("distance"), F.lit(False).alias("rollup_allowed"),
        F.lit(BLOCK_ALL).alias("use_rule"), F.lit(True).alias("blocked_rollup"), F.lit(True).alias("blocked_cause"), F.lit("EPIW012_UNKNOWN_TARGET_GENE").alias("warnings"),
    )


def guarded(mappings: DataFrame) -> DataFrame:
    """Each mapping with what it blocks: pathway roll-up by its method, causal claims, and whether it declares a roll-up that
    its method does not bear; with the warnings of these."""
    bears = F.col("method").isin(*ROLLUP)
    rows = mappings.withColumn("blocked_rollup", ~bears).withColumn("blocked_cause", F.col("method").isin(*NO_CAUSE)).withColumn("inconsistent", F.col("rollup_allowed") & ~bears)
    warnings = F.array_compact(F.array(
        F.when((F.col("method") == "inferred_target_gene") & (F.col("n_genes") > 0), "EPIW011_INFERRED_TARGET_GENE"), F.when(F.col("method") == "unknown_target_gene", "EPIW012_UNKNOWN_TARGET_GENE"),
        F.when(F.col("blocked_rollup"), "EPIW008_PATHWAY_ROLLUP_BLOCKED"), F.when(F.col("inconsistent"), "EPIW013_PATHWAY_ROLLUP_INCONSISTENT"),
    ))
    return rows.withColumn("warnings", F.concat_ws(",", warnings))


def guarded_external(evidence: DataFrame) -> DataFrame:
    """Database mappings with what they block: never a causal claim, and no roll-up from a distant or unknown biosample."""
    return evidence.withColumn("blocked_rollup", ~F.coalesce(F.col("match").isin("exact", "close"), F.lit(False))).withColumn("blocked_cause", F.lit(True))


def guard_counts(guards: DataFrame) -> DataFrame:
    """Per dataset: mappings allowed and blocked for roll-up, blocked causal claims, inconsistent ones."""
    return guards.groupBy("dataset_id").agg(
        F.count_if(~F.col("blocked_rollup")).alias("n_allowed"), F.count_if("blocked_rollup").alias("n_blocked"), F.count_if("blocked_cause").alias("n_blocked_causes"), F.count_if("inconsistent").alias("n_inconsistent"),
    )


def by_vocabulary(collapsed: DataFrame, column: str, words: tuple[str, ...]) -> DataFrame:
    """Counts by a closed vocabulary, rows of zero included."""
    spark = collapsed.sparkSession
    every = spark.createDataFrame([(w,) for w in words], f"{column} string")
    return every.join(collapsed.groupBy(column).agg(F.count("*").alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def normalise_symbols(wanted: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, unmapped) of symbols against a reference table (symbol, canonical_id, and whatever names its release): genes,
    species, cell types alike."""
    return wanted.join(aliases, "symbol"), wanted.join(aliases, "symbol", "left_anti")


def pathway_members(wanted: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per pathway of ``members`` (pathway_id, gene_id) its size and the number of ``wanted`` genes in it; and the genes that no
    pathway holds."""
    distinct, genes_ = members.select("pathway_id", "gene_id").distinct(), wanted.select("gene_id").distinct()
    hit = distinct.join(genes_.withColumn("hit", F.lit(1)), "gene_id", "left")
    sizes = hit.groupBy("pathway_id").agg(F.count("*").alias("n_members"), F.count("hit").alias("n_hits"))
    return sizes, genes_.join(distinct, "gene_id", "left_anti")
