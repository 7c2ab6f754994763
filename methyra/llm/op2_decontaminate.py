"""Benchmark decontamination by size-partitioned MinHash containment search; DataFrame functions only.

Short test items are looked for inside documents of any length. Items are partitioned by the size of their shingle
set (powers of two). The MinHash signature of an item is the least hashes of its own set, as many as its size class
needs: a document that holds at least ``share`` of the item's shingles lacks fewer than that many, so it has at least one
of them, and no contaminated document is missed. All shingles of a document are probed against the signatures (a sketch
of a long document would lose the short items inside), documents too small for a class are passed over, and each
candidate pair is verified on the shingles themselves.

Returned are the pairs (doc_id, item_id) with the number of common shingles, the item's number, and their quotient.
Words are runs without ASCII white space, A-Z in lower case. Shingles have ``size`` words; an item of fewer words is one
shingle of all its words, and is found in every document that holds these words in a row. Null and empty texts hold
nothing and are held nowhere. Repeated documents or items each have their pairs, null ids included. Extra columns are
dropped (``without_leaks`` keeps them, of any name).

Signatures are broadcast while their count is at most ``BROADCAST`` rows, the shingles of distinct items while these have
at most ``BYTES`` bytes of text; beyond that both are joined by a shuffle, where an item of many candidates is dealt over
parts. Item ids are joined as Spark chooses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import null_safe, table, written

SIZE, SHARE = 5, 0.8
#: Rows of signatures that may be broadcast (24 bytes each), and bytes of the texts of items (their shingles have
#: up to ``SIZE`` times as many).
BROADCAST, BYTES = 1_000_000, 16_000_000
#: Candidates of one item that meet beside one copy of its shingles.
PART = 4096
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str | Column) -> Column:
    low = F.translate(null_safe(text), _UPPER, _LOWER)
    return F.filter(F.split(low, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _runs(ws: Column, size: int | Column, of) -> Column:
    """``of`` applied to all runs of ``size`` words; an empty array if there are fewer words."""
    n, k = F.size(ws), F.lit(size) if isinstance(size, int) else size
    starts = F.when((n < k) | (n == 0), F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))))
    return F.transform(starts, lambda i: of(F.slice(ws, i, k)))


def _text(run: Column) -> Column:
    return F.array_join(run, " ")


def shingles_of(text: str, sizes: list[int]) -> Column:
    """Distinct shingles of all ``sizes`` of a text column, its words split once."""
    return F.flatten(F.transform(F.array(words(text)), lambda ws: F.array_distinct(F.concat(*(_runs(ws, k, _text) for k in sizes)))))


def signatures(items: DataFrame, share: float = SHARE) -> DataFrame:
    """(hash, item, least size of a document) of the least hashes of each item."""
    n = F.size("hashes")
    # The class is [2^k, 2^(k+1)); its signatures have as many hashes as its largest size can lack, and one more.
    low = F.pow(F.lit(2), F.floor(F.log2(n))).cast("int")
    most = F.floor((low * 2 - 1) * (1 - share) + 1e-9).cast("int") + 1
    sized = items.withColumn("hashes", F.array_sort(F.array_distinct("hashes"))).where(F.size("hashes") > 0)
    return sized.select("item", F.explode(F.slice("hashes", 1, F.least(most, n))).alias("hash"), F.ceil(low * share - 1e-9).cast("int").alias("least"))


def contained(docs: DataFrame, items: DataFrame, share: float = SHARE, size: int = SIZE) -> DataFrame:
    """Pairs of documents and items at least ``share`` of whose shingles they hold."""
    named = items.select("item_id", words("text").alias("ws")).where(F.size("ws") > 0).withColumn("item", F.xxhash64("ws"))
    kinds = named.select("item", "ws").dropDuplicates(["item"]).withColumn("k", F.least(F.size("ws"), F.lit(size)))
    sizes = sorted(r[0] for r in kinds.select("k").distinct().collect()) or [size]  # at most ``size`` numbers
    signed = signatures(kinds.withColumn("hashes", _runs(F.col("ws"), F.col("k"), F.xxhash64)), share)
    small = signed.count() <= BROADCAST
    light = (kinds.agg(F.sum(F.octet_length(_text(F.col("ws"))))).first()[0] or 0) <= BYTES

    rows = docs.select("doc_id", "text").withColumn("key", F.xxhash64("doc_id", "text"))
    dealt = rows.repartition("key")
    hashed = dealt.withColumn("ws", words("text")).select("key", F.greatest(F.size("ws") - size + 1, F.lit(1)).alias("places"), F.explode(F.concat(*(_runs(F.col("ws"), k, F.xxhash64) for k in sizes))).alias("hash"))
    found = hashed.join(F.broadcast(signed) if small else signed, "hash").where("places >= least")
    candidates = found.groupBy("key").agg(F.collect_set("item").alias("items"))

    # the shingles of its candidates go to the document, which is cut into shingles once and then compared beside them
    wanted = kinds.select("item", F.array_distinct(_runs(F.col("ws"), F.col("k"), _text)).alias("wanted"))
    pairs = candidates.select("key", F.explode("items").alias("item"))
    near = (pairs.join(F.broadcast(wanted), "item") if light else _dealt(pairs, wanted)).groupBy("key").agg(F.collect_list(F.struct("item", "wanted")).alias("wants"))
    texts = rows.join(near, "key").withColumn("held", shingles_of("text", sizes))
    common = lambda w: F.size(F.array_intersect(w["wanted"], F.col("held"))).cast("long").alias("n_common")
    counted = F.transform("wants", lambda w: F.struct(w["item"].alias("item"), common(w), F.size(w["wanted"]).cast("long").alias("n_item")))
    kept = texts.select("doc_id", F.explode(F.filter(counted, lambda c: c["n_common"] >= share * c["n_item"] - 1e-9)).alias("c")).select("doc_id", "c.*")
    return kept.join(named.select("item", "item_id"), "item").select("doc_id", "item_id", "n_common", "n_item", (F.col("n_common") / F.col("n_item")).alias("containment"))


def _dealt(pairs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Candidate pairs (key, item) with the shingles of the item. An item of very many candidates is dealt over parts by the
    key, with a copy of its shingles for each."""
    pairs = written(pairs, "pairs")
    crowd = written(pairs.groupBy("item").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")).where("parts > 1"), "crowd")
    parts = F.coalesce("parts", F.lit(1))
    left = pairs.join(crowd, "item", "left").select("key", "item", F.pmod("key", parts).cast("int").alias("part"))
    right = wanted.join(crowd, "item", "left").select("item", "wanted", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    return left.join(right, ["item", "part"]).select("key", "item", "wanted")


def without_leaks(docs: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item. Documents are told apart by id and text."""
    key = F.concat(F.sha2(null_safe("text").cast("binary"), 256), F.coalesce(F.concat(F.lit(" "), F.col("doc_id").cast("string")), F.lit("")))
    hit = contained(docs.select(key.alias("doc_id"), "text"), items, share).select(F.col("doc_id").alias("key")).distinct()
    return docs.select(F.struct("*").alias("row"), key.alias("key")).join(hit, "key", "left_anti").select("row.*")


def op2_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws
  FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws
  FROM benchmark
), k AS (SELECT DISTINCT least(len(ws), 5) AS k FROM b WHERE len(ws) > 0
), ds AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS s FROM d JOIN k ON len(ws) >= k
), bs AS (
  SELECT DISTINCT item_id, unnest(list_transform(range(1, len(ws) - least(len(ws), 5) + 2), lambda i: array_to_string(ws[i:i + least(len(ws), 5) - 1], ' '))) AS s FROM b WHERE len(ws) > 0
), n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY 1)
SELECT doc_id, item_id, count(*) AS n_common, any_value(n_item) AS n_item, count(*)::DOUBLE / any_value(n_item) AS containment
FROM ds JOIN bs USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(n_item) - 1e-9
"""
