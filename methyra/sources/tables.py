"""Delimited, JSON and binary sources, and sinks. Paths may lie in any store that Spark reads."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CORRUPT = "_corrupt"
#: Columns of headerless peak files.
PEAK_COLUMNS = ("chrom", "start", "end", "feature_id", "score", "strand", "signal", "minus_log10_p", "minus_log10_q", "peak_offset")


def delimiter(line: str) -> str:
    """Tab if there are at least as many as commas, then the first of comma, semicolon and bar that occurs."""
    if "\t" in line and line.count("\t") >= line.count(","):
        return "\t"
    return next((d for d in ",;|" if d in line), ",")


def delimiter_of(line: Column) -> Column:
    """The same for a column of lines."""
    count = lambda c: F.length(line) - F.length(F.translate(line, c, ""))
    rest = F.when(line.contains(","), ",").when(line.contains(";"), ";").when(line.contains("|"), "|").otherwise(",")
    return F.when(line.contains("\t") & (count("\t") >= count(",")), "\t").otherwise(rest)


def delimited(spark: SparkSession, path: str | list[str], header: bool = True, columns: tuple[str, ...] | None = None, encoding: str = "UTF-8", lines_in_quotes: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, malformed) of delimited files, all columns as text. Quotes are doubled inside quotes, and hold line breaks with
    ``lines_in_quotes`` (a file is then one task's); compressed files are read by suffix; blank rows are passed over. Rows
    of another width are malformed and keep their text; all rows carry ``file_name``. All columns are
    parsed even where few are asked for: a pruned scan would not see that a row has another width. Files are taken to have
    the first one's header; ``headers`` tells files of other shapes apart before a scan."""
    first = spark.read.text(path).limit(1).collect()
    sep = delimiter(first[0][0]) if first else ","
    reader = spark.read.option("sep", sep).option("quote", '"').option("escape", '"').option("encoding", encoding).option("multiLine", lines_in_quotes)
    if columns is None:
        columns = tuple(reader.option("header", header).csv(path).columns)
    if len(set(columns)) != len(columns) or any(not c.strip() for c in columns):
        raise ValueError("column names must be distinct and not empty")
    schema = ", ".join([*(f"`{c}` string" for c in columns), f"`{CORRUPT}` string"])
    raw = reader.option("header", header).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).option("columnPruning", False).schema(schema).csv(path)
    rows = raw.select("*", F.input_file_name().alias("file_name"))
    # Spark refuses queries on the corrupt text alone, so malformed rows are told by another column as well
    other = F.coalesce(F.length(f"`{columns[0]}`"), F.lit(0)) >= 0
    return rows.where(F.col(CORRUPT).isNull()).drop(CORRUPT), rows.where(F.col(CORRUPT).isNotNull() & other)


_LINES = "file_path", "block"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with their file, the start of their split in it and a number that ascends within the split."""
    raw = spark.read.option("lineSep", "\n").text(path)
    value = F.regexp_replace("value", "\r$", "")
    return raw.select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), value.alias("value"))


def blocks(read: DataFrame) -> DataFrame:
    """(file_path, block, first, before): of each split of ``lines`` its first number and the lines of its file before it. A
    row for each split, so a file of any size is numbered by running sums over its splits."""
    along = Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return read.groupBy(*_LINES).agg(F.min("n").alias("first"), F.count("*").alias("_m")).select(*_LINES, "first", F.coalesce(F.sum("_m").over(along), F.lit(0)).alias("before"))


def file_name(path: str = "file_path") -> Column:
    return F.element_at(F.split(path, "/"), -1)


def headers(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, file_name, header) of text files, the first line of each: files of several shapes are told apart before a scan."""
    top = lines(spark, path).where("block = 0").groupBy("file_path").agg(F.min_by("value", "n").alias("header"))
    return top.select("file_path", file_name().alias("file_name"), "header")


def n_fields(line: Column, sep: str) -> Column:
    """Fields of a line, separators inside quotes not counted."""
    bare = F.regexp_replace(line, '"(?:[^"]|"")*+"', "")
    return F.length(bare) - F.length(F.translate(bare, sep, "")) + 1


def line_problems(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """(file_path, file_name, line_no, kind, message) of blank and malformed lines, each against the header of its own file.

    Lines are numbered from 1 over all splits of a file, header and blank lines included. Only lines with a problem are
    joined to the numbers of their splits; all others leave the scan as three numbers. Without ``sep`` a file's separator is
    that of its header."""
    read = lines(spark, path)
    chosen = F.lit(sep) if sep else delimiter_of(F.col("header"))
    top = headers(spark, path).select("file_path", chosen.alias("sep"), "header")
    found = {r[0] for r in top.select("sep").distinct().collect()}  # of four
    width = lambda line: reduce(lambda rest, s: F.when(F.col("sep") == s, n_fields(line, s)).otherwise(rest), found, F.lit(None).cast("int"))
    counted = [n_fields(F.col("value"), s).alias(f"n_{i}") for i, s in enumerate(sorted(found))]
    slim = read.select(*_LINES, "n", (F.trim("value") == "").alias("blank"), *counted)
    got = reduce(lambda rest, x: F.when(F.col("sep") == x[1], F.col(f"n_{x[0]}")).otherwise(rest), enumerate(sorted(found)), F.lit(None).cast("int"))
    rows = slim.join(top.select("file_path", "sep", width(F.col("header")).alias("wanted")), "file_path").withColumn("got", got)
    odd = rows.where(F.col("blank") | (F.col("got") != F.col("wanted"))).join(blocks(read), list(_LINES)).withColumn("line_no", F.col("before") + F.col("n") - F.col("first") + 1).where("line_no > 1")
    # fixed values: the texts of both findings
    text = F.when(F.col("blank"), F.format_string("Skipped empty row at line %d", "line_no")).otherwise(F.format_string("Malformed row at line %d: expected %d columns, got %d", "line_no", "wanted", "got"))
    return odd.select("file_path", file_name().alias("file_name"), "line_no", F.when(F.col("blank"), "blank").otherwise("malformed").alias("kind"), text.alias("message"))


def delimited_shapes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, problems) of delimited files of several shapes: files are read together with those of the same header, columns
    that a file lacks are null, and problems are ``line_problems``. Paths go to the driver, as they do in any listing of files."""
    shapes: dict[str, list[str]] = {}
    for r in headers(spark, path).select("file_path", "header").collect():
        shapes.setdefault(r["header"], []).append(r["file_path"])
    read = [delimited(spark, paths)[0] for _, paths in sorted(shapes.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), read), line_problems(spark, path)


def json_features(spark: SparkSession, path: str) -> DataFrame:
    """Cells of feature documents {feature_id, values: {sample: number}}."""
    docs = spark.read.schema("feature_id string, `values` map<string,double>").json(path)
    return docs.select("feature_id", F.explode("values").alias("sample_id", "value"))


#: Bytes of a file up to which it is hashed as one value, and of the pieces that longer ones are hashed by.
WHOLE, PIECE = 1 << 28, 1 << 20
#: The longest binary value, and the mark that the reader of lines leaves out.
LONGEST = (1 << 31) - 1024
_MARK = b"\xef\xbb\xbf"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of a split in order, put together to pieces of about ``PIECE`` bytes; each line ends with a line break."""
    names = ["file_path", "file_size", "block", "n", "piece"]
    held: list[bytes] = []
    at, size = None, 0

    def out() -> pa.RecordBatch:
        piece = b"".join(held)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in (*at, piece)], names=names)

    for b in batches:
        for path, length, block, n, value in zip(*(c.to_pylist() for c in b.columns)):
            if held and (at[0] != path or at[2] != block or size >= PIECE):
                yield out()
            if not held:
                at, size = (path, length, block, n), 0
            held += [value, b"\n"]
            size += len(value) + 1
    if held:
        yield out()


class _Content:
    """Running digest of what a gzip file holds, over all its members; None where it is damaged."""

    def __init__(self):
        self.hash, self.size, self.broken, self._member = hashlib.sha256(), 0, False, zlib.decompressobj(31)

    def update(self, data: bytes) -> None:
        try:
            while data and not self.broken:
                for got in iter(lambda: self._member.decompress(data, PIECE), b""):  # noqa: B023
                    self.hash.update(got)
                    self.size += len(got)
                    data = self._member.unconsumed_tail
                if not self._member.eof:
                    return
                data, self._member = self._member.unused_data, zlib.decompressobj(31)
        except zlib.error:
            self.broken = True


_DIGESTS = "file_path string, n_bytes long, sha256 string, content_bytes long, content_sha256 string"


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in _DIGESTS.split(", ")])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of gzip files that are one value each, inflated a piece at a time."""
    for b in batches:
        for path, data in zip(b.column(0).to_pylist(), b.column(1)):
            data, content = data.as_py(), _Content()
            content.update(data)
            inner = (None, None) if content.broken else (content.size, content.hash.hexdigest())
            yield _digest_rows([(path, len(data), hashlib.sha256(data).hexdigest(), *inner)])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of pieces that stand in order by file. The file's size tells whether there is a last line break, and a mark
    before the first line; both digests go on side by side until then. Without a size (decompressed) there is the one and
    not the other."""
    now, h, marked, n, size, tail = None, None, None, 0, 0, b""

    def put(data: bytes) -> None:
        nonlocal n
        h.update(data)
        marked.update(data)
        n += len(data)

    def out() -> pa.RecordBatch:
        nonlocal h, n
        if size is not None and n + len(tail) < size:
            h, n = marked, n + len(_MARK)
        last = tail if size is None else tail[: size - n]
        h.update(last)
        n += len(last)
        return _digest_rows([(now, n, h.hexdigest(), n, h.hexdigest())])

    for b in batches:
        for path, length, piece in zip(*(b.column(i).to_pylist() for i in (0, 1, 4))):
            if path != now:
                if now is not None:
                    yield out()
                now, h, marked, n, size, tail = path, hashlib.sha256(), hashlib.sha256(_MARK), 0, length, b""
            put(tail)
            tail = piece
    if now is not None:
        yield out()


def _by_piece(spark: SparkSession, paths: list[str], stored: bool) -> DataFrame:
    raw = spark.read.option("lineSep", "\n").text(paths)
    size = F.col("_metadata.file_size") if stored else F.lit(None).cast("long")
    rows = raw.select(F.col("_metadata.file_path").alias("file_path"), size.alias("file_size"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), F.col("value").cast("binary").alias("value"))
    pieces = rows.mapInArrow(_pieces, "file_path string, file_size long, block long, n long, piece binary")
    return pieces.repartition("file_path").sortWithinPartitions("file_path", "block", "n").mapInArrow(_hashed, _DIGESTS)


def digests(spark: SparkSession, path: str | list[str], whole: int = WHOLE) -> DataFrame:
    """(file_path, n_bytes, sha256, content_bytes, content_sha256) of files: as stored, and decompressed where the name ends
    with .gz (null where that is damaged).

    Files of up to ``whole`` bytes are one value to the scan. Longer ones are read by splits and put together in order, a piece
    of about a megabyte at a time, so memory is bounded for files of any size; one file is one task's in the end, for the
    hashes are sequential. Contents of compressed files beyond ``whole`` bytes are read in the same way, as the reader
    decompresses them, and taken to end with a line break; as stored these are hashed up to ``LONGEST`` bytes (else null), since
    no reader gives the stored bytes of a compressed file in pieces. Paths go to the driver, as they do in any listing."""
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("path"), "length", "content")
    n, sha, small, packed = F.col("length"), F.sha2("content", 256), F.col("length") <= whole, F.col("path").endswith(".gz")
    out = files.where(small & ~packed).select(F.col("path").alias("file_path"), n.alias("n_bytes"), sha.alias("sha256"), n.alias("content_bytes"), sha.alias("content_sha256"))
    listed = files.select("path", packed.alias("packed"), small.alias("small")).collect()
    plain = lambda x: re.sub("^([a-z0-9]+):/+", r"\1:///", x)
    nothing = hashlib.sha256(b"").hexdigest()
    if empty := {plain(x) for x in files.inputFiles()} - {plain(r["path"]) for r in listed}:  # scans pass over these
        out = out.unionByName(spark.createDataFrame([(x, 0, nothing, 0, nothing) for x in sorted(empty)], _DIGESTS))
    if any(r["packed"] and r["small"] for r in listed):
        out = out.unionByName(files.where(small & packed).select("path", "content").mapInArrow(_unpacked, _DIGESTS))
    if long := [r["path"] for r in listed if not r["packed"] and not r["small"]]:
        out = out.unionByName(_by_piece(spark, long, True))
    if large := [r["path"] for r in listed if r["packed"] and not r["small"]]:
        stored = files.where(~small & packed & (n <= LONGEST)).select(F.col("path").alias("file_path"), sha.alias("_sha"))
        sizes = files.where(~small & packed).select(F.col("path").alias("file_path"), n.alias("_n"))
        inner = _by_piece(spark, large, False).select("file_path", "content_bytes", "content_sha256")
        both = sizes.join(stored, "file_path", "left").join(inner, "file_path", "left")
        out = out.unionByName(both.select("file_path", F.col("_n").alias("n_bytes"), F.col("_sha").alias("sha256"), "content_bytes", "content_sha256"))
    return out


def manifest(spark: SparkSession, path: str, expected: DataFrame, name: Column | None = None) -> DataFrame:
    """Files against an expected manifest (name, n_bytes, sha256): ok, missing, unexpected or mismatch. A file's name is its
    last part unless ``name`` says otherwise in terms of its ``path``."""
    name = F.element_at(F.split("path", "/"), -1) if name is None else name
    found = digests(spark, path).withColumnRenamed("file_path", "path").select(name.alias("name"), F.col("n_bytes").alias("got_bytes"), F.col("sha256").alias("got"))
    both = found.join(expected, "name", "full_outer")
    state = F.when(F.col("got").isNull(), "missing").when(F.col("sha256").isNull(), "unexpected").when((F.col("got") != F.col("sha256")) | (F.col("got_bytes") != F.col("n_bytes")), "mismatch").otherwise("ok")
    return both.select("name", state.alias("state"))


def peak_summary(peaks: DataFrame) -> DataFrame:
    """Two features per sample and chromosome: number of peaks, and sum of their signal."""
    per = peaks.groupBy("sample_id", "chrom").agg(F.count("*").cast("double").alias("peak_count"), F.round(F.sum(F.col("signal").cast("double")), 5).alias("signal_sum"))
    return per.unpivot(["sample_id", "chrom"], ["peak_count", "signal_sum"], "metric", "value")


def write_tables(df: DataFrame, path: str) -> None:
    df.write.partitionBy("dataset_id").parquet(path)


def documents(decided: DataFrame, findings: DataFrame, per_document: int = 10_000) -> DataFrame:
    """JSON documents of each policy and dataset: parts of at most ``per_document`` decisions in order of feature, and in the
    first part the blocking findings (code, first feature, number). Parts are numbered within ranges of the feature's
    hash, so no dataset goes through one task."""
    n = decided.groupBy("policy_id", "dataset_id").agg(F.ceil(F.count("*") / per_document).alias("parts"))
    dealt = decided.join(n, ["policy_id", "dataset_id"]).withColumn("part", F.pmod(F.xxhash64("feature_id"), F.col("parts")))
    rows = dealt.groupBy("policy_id", "dataset_id", "part").agg(F.any_value("parts").alias("parts"), F.array_sort(F.collect_list(F.struct("feature_id", "status", "rule", "notes"))).alias("decisions"))
    codes = findings.groupBy("dataset_id").agg(F.array_sort(F.collect_list(F.struct("code", "feature_id", "n"))).alias("blocking"))
    out = rows.join(codes, "dataset_id", "left").withColumn("blocking", F.when(F.col("part") == 0, F.col("blocking")))
    return out.select("policy_id", "dataset_id", F.to_json(F.struct("policy_id", "dataset_id", "part", "parts", "decisions", "blocking")).alias("document"))
