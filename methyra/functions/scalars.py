"""Column expressions for parsing, coordinates, ids and rounding. All are built-in expressions; none needs Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that stand for a missing number, and those for infinity.
NULL_WORDS = ("", "na", "n/a", "nan", "null", "none", "missing")
INFINITE_WORDS = ("inf", "-inf", "infinity", "-infinity")
#: Decimal syntax; Spark's own cast accepts more (12d, inf) and is guarded by it.
DECIMAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
#: The same between white space of any kind.
PADDED = r"^[\s\x{a0}\x{feff}]*(" + DECIMAL[1:-1] + r")[\s\x{a0}\x{feff}]*\z"

#: Coordinate systems that a source may declare; the first is canonical, the last has no places.
SYSTEMS = ("ucsc_bed_0based_half_open", "gff_gtf_1based_closed", "platform_native_probe", "no_coordinates_feature_id_only")
CANONICAL, ONE_BASED, NATIVE, NO_PLACES = SYSTEMS
#: Coordinate conventions of a region.
HALF_OPEN, CLOSED = "0-based-half-open", "1-based-closed"
#: The genome builds that a policy allows by default.
BUILDS = ("GRCh37", "GRCh38", "hg19", "hg38", "mm9", "mm10", "mm39", "rn6", "rn7")


def header_key(c: Column) -> Column:
    """Column names without case, underscores, white space and hyphens."""
    return F.regexp_replace(F.lower(c), r"[_\s-]", "")


def trimmed(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^[\s\x{a0}\x{feff}]+|[\s\x{a0}\x{feff}]+$", "")


def _decimal(raw: Column) -> Column:
    """The finite decimal number that a text is between white space, else null. One pass over the text; the number stands in the
    plan once, as it would be worked out anew wherever it stood."""
    number = F.regexp_extract(raw, PADDED, 1).try_cast("double")
    return F.get(F.filter(F.array(number), lambda x: F.abs(x) <= 1.7976931348623157e308), F.lit(0))


def _missing(raw: Column, *words: str) -> Column:
    return F.coalesce(F.lower(trimmed(raw)).isin(*words), F.lit(True))


def number_strict(raw: Column) -> tuple[Column, Column]:
    """(value, ok): null words give null, anything else must be a finite decimal number. No number is a null word."""
    value = _decimal(raw)
    return value, value.isNotNull() | _missing(raw, *NULL_WORDS)


def number_melt(raw: Column) -> tuple[Column, Column]:
    """As ``number_strict``, with the words for infinity null as well."""
    value = _decimal(raw)
    return value, value.isNotNull() | _missing(raw, *NULL_WORDS, *INFINITE_WORDS)


def number_lenient(raw: Column) -> Column:
    """A decimal number, else null."""
    return _decimal(raw)


def round_up_half(x: Column, places: int) -> Column:
    """Halves go towards plus infinity."""
    return F.floor(x * 10.0**places + 0.5) / 10.0**places


def sign(x: Column, tolerance: float) -> Column:
    return F.when(x > tolerance, 1).when(x < -tolerance, -1).otherwise(0)


def convention(system: Column) -> Column:
    """The convention of a region's coordinates in a declared system; null where the system has no places."""
    return F.when(system == ONE_BASED, CLOSED).when(system.isin(CANONICAL, NATIVE), HALF_OPEN)


def region(chrom: Column, start: Column, end: Column, build: Column, system: Column) -> Column:
    """A region struct, or null if any part is invalid. ``system`` is a convention."""
    valid = chrom.rlike(r"^(chr)?[0-9XYM]+$") & (start >= 0) & (end > start) & build.isin(*BUILDS) & system.isin(HALF_OPEN, CLOSED)
    return F.when(valid, F.struct(chrom.alias("chrom"), start.alias("start"), end.alias("end"), build.alias("build"), system.alias("system")))


def canonical_start(start: Column, system: Column) -> Column:
    """The start on the canonical system; null for systems without places."""
    return start - F.when(system == ONE_BASED, 1).when(system.isin(CANONICAL, NATIVE), 0)


def start_on(start: Column, target: Column) -> Column:
    """A canonical start on the target system; null for systems without places."""
    return start + F.when(target == ONE_BASED, 1).when(target.isin(CANONICAL, NATIVE), 0)


def chromosome(c: Column) -> Column:
    """Aliases to ``chr`` names; MT and chrMT to chrM."""
    bare = F.regexp_replace(c, "^chr", "")
    known = bare.isin(*map(str, range(1, 23)), "X", "Y", "M", "MT")
    return F.when(known, F.concat(F.lit("chr"), F.when(bare == "MT", "M").otherwise(bare))).otherwise(c)


def promoter(start: Column, end: Column, strand: Column, up: int, down: int) -> tuple[Column, Column]:
    minus = strand == "-"
    low = F.when(minus, end - down).otherwise(start - up)
    high = F.when(minus, end + up).otherwise(start + down)
    return F.greatest(F.lit(0), low), high


def tss(start: Column, end: Column, strand: Column) -> Column:
    return F.when(strand == "-", end).otherwise(start)


def distance_to_point(start: Column, end: Column, point: Column) -> Column:
    return F.when(point < start, start - point).when(point > end, point - end).otherwise(0)


def stable_id(*parts: Column) -> Column:
    """SHA-256 of the parts joined by bars, in the shape of a version-4 identifier."""
    h = F.sha2(F.concat_ws("|", *parts).cast("binary"), 256)
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("4"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
