"""From the headers of tables to feature classes and the next step; from raw rows to typed and to summary features.

Files are rows with ``headers``, ``family``, ``modality``, ``shape``, ``semantics``, ``explicit_class`` and ``enabled`` (the
reserved parts that are switched on). Null headers count as none. Every decision is one projection, so nothing is dealt anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import header_key, number_strict

#: Normalised column names that tell what a table holds.
STRONG_IDS = ("probeid", "cpgid", "cgid", "probe")
WEAK_IDS = ("id", "featureid")
CHROMOSOMES = ("chr", "chrom", "chromosome", "seqnames")
POSITIONS = ("position", "pos", "bp", "coordinate")
EFFECTS = ("effectsize", "effect", "deltabeta", "deltam")
P_VALUES = ("pvalue", "pval", "p")
Q_VALUES = ("qvalue", "qval", "fdr", "adjustedp")
PEAK_FORMATS = ("peakformat", "format", "caller", "peakcaller")
MARKS = ("mark", "markname", "histonemark", "antibody")
GENE_IDS = ("geneid", "ensemblid", "entrezid", "symbol", "genesymbol", "hgncid", "linkedgene", "targetgene")
SUMMARY_STATISTICS = ("effectsize", "effect", "pvalue", "pval", "qvalue", "qval", "fdr", "adjustedp", "logfc", "log2fc", "foldchange", "fc")
#: Names of interval columns as the summary test knows them.
INTERVALS = (("chr", "chrom", "chromosome"), ("start", "chromstart"), ("end", "chromend"))
#: Classes that need a part to be switched on.
RESERVED = {
    "atac_peak": "accessibility", "histone_mark_peak": "histone", "chip_peak_narrow": "histone", "chip_peak_broad": "histone",
    "mirna_expression": "mirna", "ncrna_expression": "ncrna",
}
#: Columns of a summary table, each with its names in order of preference.
SUMMARY_COLUMNS = {
    "effect_size": ("effectsize", "effect", "logfc", "log2fc", "foldchange", "fc"), "p_value": ("pvalue", "pval"), "q_value": ("qvalue", "qval", "fdr"),
    "se": ("se", "stderror", "standarderror", "stderr"), "ci_lower": ("cilower", "confintlow"), "ci_upper": ("ciupper", "confinthigh"),
    "statistic": ("statistic", "stat", "tstat", "zscore"),
}


def _keys() -> Column:
    return F.transform(F.coalesce("headers", F.array().cast("array<string>")), header_key)


def _any(names: tuple[str, ...]) -> Column:
    return F.coalesce(F.arrays_overlap(_keys(), F.array(*map(F.lit, names))), F.lit(False))


def _is(column: str, *values: str) -> Column:
    return F.coalesce(F.col(column).isin(*values), F.lit(False))


def _interval() -> Column:
    return _any(CHROMOSOMES) & _any(("start",)) & _any(("end",))


def _verdict(kind: Column | str, confidence: Column | str) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(lit(kind).alias("feature_class"), lit(confidence).alias("confidence"))


def _scores() -> tuple[Column, Column]:
    n = lambda hit: hit.cast("int")
    strong, place = _any(STRONG_IDS), _interval()
    weak = ~strong & _any(WEAK_IDS)
    bare = (_any(EFFECTS) | _any(P_VALUES) | _any(Q_VALUES)) & ~strong
    level, change = _is("semantics", "beta_value", "m_value", "percent_methylation"), _is("semantics", "delta_beta", "delta_m")
    summary = _is("shape", "summary")
    cpg = 4 * n(strong) + 2 * n(weak) + n(_any(POSITIONS)) + n(~place) + n(level) + n(change) + n(_is("shape", "wide")) - n(summary) - n(bare)
    dmr = 3 * n(place) + n(change | _is("semantics", "effect_size", "q_value")) + 2 * n(bare) + n(summary) - 2 * n(strong) - n(weak) - n(level)
    return cpg, dmr


def _methylation() -> Column:
    cpg, dmr = _scores()
    torn = _any(STRONG_IDS) & _interval() & (_any(EFFECTS) | _any(P_VALUES) | _any(Q_VALUES))
    sure = lambda score: F.when(score >= 5, "high").otherwise("medium")
    return (
        F.when(torn, _verdict("unclassified", "low")).when((cpg > dmr) & (cpg >= 3), _verdict("cpg_methylation", sure(cpg)))
        .when((dmr > cpg) & (dmr >= 3), _verdict("dmr", sure(dmr))).otherwise(_verdict("unclassified", "low"))
    )


def _enabled(part: str) -> Column:
    return F.coalesce(F.array_contains("enabled", part), F.lit(False))


def _region() -> Column:
    atac, chip = _is("modality", "atac_seq") & _enabled("accessibility"), _is("modality", "chip_seq") & _enabled("histone")
    return (
        F.when(~_interval(), _verdict("unclassified", "low"))
        .when(atac, _verdict("atac_peak", F.when(_any(PEAK_FORMATS), "high").otherwise("medium")))
        .when(chip & _any(MARKS), _verdict("histone_mark_peak", "high")).when(chip, _verdict("chip_peak_narrow", "medium"))
        .when(_is("modality", "hic"), _verdict("chromatin_interaction", "high")).otherwise(_verdict("generic_region_feature", "high"))
    )


def _chosen() -> Column:
    """The class that the caller names, unless its part is switched off; null where none is named."""
    closed = F.lit(False)
    for kind, part in RESERVED.items():
        closed = closed | (_is("explicit_class", kind) & ~_enabled(part))
    return F.when(closed, _verdict("unclassified", "low")).when(F.col("explicit_class").isNotNull(), _verdict(F.col("explicit_class"), "override"))


def methylation_class(files: DataFrame) -> DataFrame:
    """Scores for single sites and for regions, the class and its confidence, per file."""
    cpg, dmr = _scores()
    named = F.when(F.col("explicit_class").isNotNull(), _verdict(F.col("explicit_class"), "override"))
    return files.select("file_id", cpg.alias("cpg_score"), dmr.alias("dmr_score"), F.coalesce(named, _methylation()).alias("v")).select("file_id", "cpg_score", "dmr_score", "v.*")


def region_class(files: DataFrame) -> DataFrame:
    """Class of interval tables by assay, switched-on parts and format columns; without an interval there is none."""
    given = F.when(_interval(), _chosen())
    return files.select("file_id", F.coalesce(given, _region()).alias("v")).select("file_id", "v.*")


def feature_type(files: DataFrame) -> DataFrame:
    """Class of any table, whether it is summary-only, and the action to take. A named class goes first, then gene ids, then
    summaries, then the family's own rules. ``mixed`` marks files whose rows fall in several classes (``mixed_tables``)."""
    hits = F.size(F.filter(_keys(), lambda k: k.isin(*SUMMARY_STATISTICS)))
    placed = _any(INTERVALS[0]) & _any(INTERVALS[1]) & _any(INTERVALS[2])
    only = ~placed & (hits > 0) & (_is("shape", "summary") | (2 * hits >= F.size(_keys())))
    own = F.when(_is("family", "dna_methylation"), _methylation()).otherwise(_region())
    gene = F.when(_any(GENE_IDS), _verdict("gene_linked_feature", "high"))
    found = F.coalesce(_chosen(), gene, F.when(only, _verdict("summary_only", "high")), own)
    rows = files.select("file_id", F.coalesce("mixed", F.lit(False)).alias("mixed"), only.alias("summary_only"), found.alias("v")).select("file_id", "mixed", "summary_only", "v.*")
    # an unclassified table that no caller named comes with an error, and errors block; a caller may name "unclassified"
    failed = (F.col("feature_class") == "unclassified") & (F.col("confidence") == "low")
    action = (
        F.when(failed, "blocked").when(F.col("mixed"), "split_table").when(F.col("feature_class") == "unclassified", "provide_explicit_class")
        .when(F.col("confidence").isin("low", "medium"), "review_required").otherwise("proceed")
    )
    return rows.select("file_id", "feature_class", "confidence", "summary_only", action.alias("action"))


def typed_features(rows: DataFrame) -> DataFrame:
    """Rows with feature_id and state. The id is the id column, else the probe, else the place; classes other than single sites
    need a valid place (start at least 0, end beyond it). Blank texts count as absent; a row without any id is ``no_id``."""
    text = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    valid = F.coalesce(text("chrom").isNotNull() & (F.col("start") >= 0) & (F.col("end") > F.col("start")), F.lit(False))
    place = F.when(valid, F.concat(text("chrom"), F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string")))
    out = rows.withColumn("feature_id", F.coalesce(text("id"), text("probe"), place))
    single = F.coalesce(F.col("feature_class") == "cpg_methylation", F.lit(False))
    return out.withColumn("state", F.when(F.col("feature_id").isNull(), "no_id").when(~single & ~valid, "no_region").otherwise("kept"))


def canonical_summary(rows: DataFrame, feature: str, order: str) -> DataFrame:
    """Summary rows under canonical names. Columns are found once, from the names of ``rows``, so that a scan reads only those;
    texts that are no finite numbers become null; blank ids go, and of a repeated id the row latest by ``order`` stays."""
    keys = {}
    for c in rows.columns:
        keys.setdefault("".join(x for x in c.lower() if not x.isspace() and x not in "_-"), c)
    found = {name: next((keys[a] for a in aliases if a in keys), None) for name, aliases in SUMMARY_COLUMNS.items()}
    # only the texts of the rows that stay are read as numbers
    texts = F.struct(*((F.col(f"`{c}`").cast("string") if c else F.lit(None).cast("string")).alias(name) for name, c in found.items()))
    good = rows.select(F.trim(F.col(feature)).alias("feature_id"), F.col(order).alias("at"), texts.alias("v")).where("feature_id <> ''")
    last = good.groupBy("feature_id").agg(F.max_by("v", "at").alias("v"), F.count("*").alias("n_rows"))
    return last.select("feature_id", "n_rows", *((number_strict(F.col("v")[name])[0] if c else F.lit(None).cast("double")).alias(name) for name, c in found.items()))
