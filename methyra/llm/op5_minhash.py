"""Near-duplicate documents by b-bit MinHash.

Of each document's shingle set ``SLOTS`` minima are taken. Bands of four minima give candidates; of every minimum only
the lowest ``BITS`` bits are kept, packed as bit planes, and the similarity of a candidate pair is estimated by counting
equal slots, corrected for chance collisions of the low bits. Pairs whose estimate lies far below the threshold (over
four standard errors) are passed over, all others are confirmed on their full shingle sets.

Documents of equal sets are one class from the start. Within a bucket not all pairs are made. First each class is paired
with the bucket's pivot, the class that has most neighbours over all buckets, and links join classes to components.
Where a bucket then still holds several components, the classes outside its largest one are paired with a few of its
members, twice, which joins most; then each class that is still outside is paired with every class of other components
there. These last estimates use a finer signature of ``FINE`` slots, taken only of classes in such buckets, so that few pairs
well below the threshold go on to be confirmed. A pair left out lies within one component, so components are those of all links.

Rows: null and empty texts have no shingles and link with nothing. A component's id is its smallest document id; null ids
count as larger than all others, and a component of null ids alone has a null id. ``kept`` is true for the document whose
id is its component's (for all rows that repeat it), and where the component has no id. Extra columns are dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE, WordHasher, arrow_map, batch_of, col_of, mix64, shingle_set, spread, table, texts_of, words_of, written

SIZE, SLOTS, ROWS, BANDS, BITS = 5, 256, 4, 32, 2
#: Similarity below the threshold at which an estimate rules a pair out: four standard errors at 0.8.
MARGIN = 0.12
#: Slots of the finer signature, and its four standard errors.
FINE, FINE_MARGIN = 1024, 0.06
#: Pairs that are confirmed beside one copy of the text that they share.
PART = 512
#: Rounds in which classes outside a bucket's largest component meet some of its members before they meet all.
ROUNDS, PIVOTS = 2, 2



def _permutations(slots: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    flip = rng.integers(0, 1 << 63, slots, dtype=np.uint64)[:, None]
    return flip, (rng.integers(0, 1 << 63, slots, dtype=np.uint64) | np.uint64(1))[:, None]


_COARSE = _permutations(SLOTS, 20240229)


def minima(shingles: np.ndarray, permutations: tuple[np.ndarray, np.ndarray] = _COARSE) -> np.ndarray:
    """Smallest value of each slot's permutation over the set."""
    flip, mult = permutations
    out = None
    for at in range(0, len(shingles), 1024):
        part = shingles[at : at + 1024]
        low = ((part[None, :] ^ flip) * mult).min(1)
        out = low if out is None else np.minimum(out, low)
    return out


def band_keys(mins: np.ndarray) -> np.ndarray:
    grid = mins[: BANDS * ROWS].reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + grid[:, i])
    return key.view(np.int64)


def planes(mins: np.ndarray) -> list[int]:
    """The low bits of all slots, one plane of ``WORDS`` longs per bit."""
    low = mix64(mins)
    out = []
    for bit in range(BITS):
        flags = ((low >> np.uint64(bit)) & np.uint64(1)).astype(np.uint8)
        out += np.packbits(flags).view(np.int64).tolist()
    return out


def set_key(shingles: np.ndarray) -> int:
    """A 64-bit name of a set: equal sets are one class."""
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).view(np.int64))


WORDS = SLOTS // 64
_SIG = [f"s{i}" for i in range(WORDS * BITS)]
_FINE_SIG = [f"f{i}" for i in range(FINE // 64 * BITS)]


def features(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, text_key, n_shingles, node (set class, null for empty sets), signature planes and band keys."""
    names = ["doc_id", "text_key", "n_shingles", "node", *_SIG, "bands"]

    def make():
        hasher = WordHasher()

        def fn(b: pa.RecordBatch) -> pa.RecordBatch:
            n, node, sig, bands = [], [], [], []
            for t in texts_of(b):
                s = shingle_set(hasher(words_of(t)), size)
                n.append(len(s))
                if len(s):
                    m = minima(s)
                    node.append(set_key(s))
                    sig.append(planes(m))
                    bands.append(band_keys(m))
                else:
                    node.append(None)
                    sig.append([0] * len(_SIG))
                    bands.append(np.empty(0, np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in bands])]).astype(np.int32)
            cols = [pa.array(c, pa.int64()) for c in zip(*sig)] if sig else [pa.array([], pa.int64())] * len(_SIG)
            return batch_of(names, [col_of(b, "doc_id"), col_of(b, "text_key"), pa.array(n, pa.int64()), pa.array(node, pa.int64()), *cols, pa.ListArray.from_arrays(offsets, np.concatenate(bands))])

        return fn

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, text_key long, n_shingles long, node long, " + ", ".join(f"{s} long" for s in _SIG) + ", bands array<long>"
    return arrow_map(docs.select("doc_id", "text_key", "text"), make, schema)


def fine_signatures(texts: DataFrame, size: int = SIZE) -> DataFrame:
    """node and the planes of the finer signature of every row (node, text)."""

    def make():
        hasher, permutations = WordHasher(), _permutations(FINE, 20240301)

        def fn(b: pa.RecordBatch) -> pa.RecordBatch:
            rows = [planes(minima(shingle_set(hasher(words_of(t)), size), permutations)) for t in texts_of(b)]
            cols = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * len(_FINE_SIG)
            return batch_of(["node", *_FINE_SIG], [col_of(b, "node"), *cols])

        return fn

    return arrow_map(texts.select("node", "text"), make, "node long, " + ", ".join(f"{s} long" for s in _FINE_SIG))


def estimate(a: str, b: str, slots: int = SLOTS, name: str = "s") -> Column:
    """Collision-corrected similarity of the signatures in columns ``a``.s0.. and ``b``.s0.."""
    differ, words = F.lit(0), slots // 64
    for word in range(words):
        bits = None
        for bit in range(BITS):
            x = F.col(f"{a}.{name}{words * bit + word}").bitwiseXOR(F.col(f"{b}.{name}{words * bit + word}"))
            bits = x if bits is None else bits.bitwiseOR(x)
        differ = differ + F.bit_count(bits)
    chance = 2.0**-BITS
    return (1 - differ / F.lit(float(slots)) - chance) / (1 - chance)


def _plausible(a: str, b: str, percent: int, margin: float = MARGIN) -> Column:
    near = estimate(a, b) >= percent / 100 - margin
    sizes = F.least(f"{a}.n", f"{b}.n") * 100 >= F.greatest(f"{a}.n", f"{b}.n") * percent
    return near & sizes


def _confirm(pairs: DataFrame, texts: DataFrame, percent: int, size: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets reach the threshold.

    Pairs meet by b, in parts of about ``PART``; each part gets the text of b once, as its first row, so the text of a class
    that very many pairs share is neither copied into every pair nor met in one task.
    """
    parts = pairs.groupBy("b").agg(F.ceil(F.count("*") / PART).alias("parts"))
    heads = parts.join(texts.withColumnRenamed("node", "b"), "b").select("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("a"), "text")
    dealt = pairs.join(parts, "b").select("b", F.pmod(F.xxhash64("a"), F.col("parts")).alias("part"), "a")
    rows = dealt.join(texts.withColumnRenamed("node", "a"), "a").select("b", "part", "a", "text")

    def run(batches):
        hasher = WordHasher()
        key, head = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                some = batch.slice(at, SLICE)
                found = []
                for b, part, a, text in zip(*(some.column(i).to_pylist() for i in range(4))):
                    s = shingle_set(hasher(words_of(text)), size)
                    if a is None:
                        key, head = (b, part), s
                        continue
                    if key != (b, part):
                        raise ValueError(f"no text of class {b}")
                    common = len(np.intersect1d(s, head, assume_unique=True))
                    if 100 * common >= percent * (len(s) + len(head) - common):
                        found.append((a, b))
                if found:
                    yield batch_of(["a", "b"], [pa.array(c, pa.int64()) for c in zip(*found)])

    order = heads.unionByName(rows).repartition("b", "part").sortWithinPartitions("b", "part", F.col("a").asc_nulls_first())
    return order.select("b", "part", "a", "text").mapInArrow(run, "a long, b long")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, comp): the smallest node that links reach, for every node. Labels fall to the smallest among neighbours,
    then to the label of the label; each round is written to the shared folder."""
    edges = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("comp").alias("m"))
        lower = labels.join(near, labels["node"] == near["a"]).select("node", F.col("comp").alias("old"), F.least("comp", "m").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("via"))
        new = written(lower.join(jump, "comp", "left").select("node", "old", F.least("comp", F.coalesce("via", "comp")).alias("comp")), "labels")
        labels = new.select("node", "comp")
        if new.where("comp <> old").isEmpty():
            break
    return nodes.select("node").join(labels, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"))


def _open(members: DataFrame, comps: DataFrame, sig: DataFrame) -> DataFrame:
    """Members (bucket, node, comp, signature) of buckets with several components, and the largest of these (main)."""
    inside = members.select("bucket", "node").join(comps, "node")
    counts = inside.groupBy("bucket", "comp").agg(F.count("*").alias("k"))
    largest = counts.groupBy("bucket").agg(F.max(F.struct("k", "comp"))["comp"].alias("main"), F.count("*").alias("parts")).where("parts > 1")
    return written(inside.join(largest.select("bucket", "main"), "bucket").join(sig, "node"), "open")


def _some_pairs(open_: DataFrame, percent: int, number: int) -> DataFrame:
    """Pairs that are likely links, of classes outside the largest component with ``PIVOTS`` of its members."""
    main = open_.where("comp = main").select("bucket", "node", "n", *_SIG)
    row = F.struct(F.xxhash64("node", F.lit(number)).alias("h"), *main.columns)
    # the first by hash of each residue: partial aggregation keeps one row a bucket and residue in each task
    picked = main.groupBy("bucket", F.pmod(F.xxhash64("node", F.lit(-1 - number)), F.lit(PIVOTS)).alias("r")).agg(F.min(row).alias("p")).select("p.*")
    few, some = open_.where("comp <> main").alias("a"), picked.alias("b")
    return few.join(some, (F.col("a.bucket") == F.col("b.bucket")) & _plausible("a", "b", percent, 0.02))


def near_duplicates(docs: DataFrame, percent: int = 85, size: int = SIZE) -> DataFrame:
    """doc_id, text_key (hash of the text), n_shingles, component_id and kept of every document; links are pairs of a similarity of ``percent`` or more."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    feats = written(features(spread(rows, "doc_id", "text_key"), size), "features")
    classes = feats.where("node is not null").groupBy("node").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first"),
        F.min_by(F.struct(F.col("n_shingles").alias("n"), *_SIG, "bands"), F.col("text_key")).alias("f"),
    )
    nodes = written(classes.select("node", F.col("first.doc_id").alias("doc_id"), F.col("first.text_key").alias("text_key"), "f.*"), "nodes")
    sig = nodes.select("node", "n", *_SIG)

    buckets = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("held")).where("held > 1")
    members = written(buckets.join(shared, "bucket"), "members")
    weight = members.groupBy("node").agg(F.sum("held").alias("weight"))
    pivots = members.join(weight, "node").groupBy("bucket").agg(F.max(F.struct("weight", "node"))["node"].alias("pivot"))
    stars = members.join(pivots, "bucket").where("node <> pivot").select(F.col("node").alias("one"), F.col("pivot").alias("other")).distinct()
    a, b = sig.alias("a"), sig.alias("b")
    first = stars.join(a, F.col("one") == F.col("a.node")).join(b, F.col("other") == F.col("b.node")).where(_plausible("a", "b", percent))
    first = written(first.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")), "pairs")

    # texts of the classes in shared buckets, once each
    wanted = nodes.join(weight.select("node"), "node", "left_semi").select("node", F.col("doc_id").alias("id"), "text_key")
    texts = rows.join(wanted.hint("shuffle_hash"), (rows["text_key"] == wanted["text_key"]) & rows["doc_id"].eqNullSafe(F.col("id"))).select("node", "text")
    texts = written(_one_each(texts), "texts")

    links = written(_confirm(first, texts, percent, size), "links")
    comps = written(components(nodes, links), "components")
    tested = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    for number in range(ROUNDS + 1):
        open_ = _open(members, comps, sig)
        if open_.isEmpty():
            break
        if number < ROUNDS:
            late = _some_pairs(open_, percent, number)
        else:
            # Every bucket that two classes of different components share is open, so a pair is given out in the first only.
            fine = fine_signatures(texts.join(open_.select("node").distinct(), "node", "left_semi"), size)
            wide = open_.join(nodes.select("node", "bands"), "node").join(written(fine, "fine"), "node")
            few, all_ = wide.where("comp <> main").alias("a"), wide.alias("b")
            shared_bands = F.filter(F.zip_with("a.bands", "b.bands", lambda x, y: F.when(x == y, x)), lambda x: x.isNotNull())
            once = (F.col("b.comp") == F.col("b.main")) | (F.col("a.node") < F.col("b.node"))
            apart = (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.comp") != F.col("b.comp")) & once
            near = _plausible("a", "b", percent) & (estimate("a", "b", FINE, "f") >= percent / 100 - FINE_MARGIN)
            late = few.join(all_, apart & near & (F.get(shared_bands, F.lit(0)) == F.col("a.bucket")))
        late = late.select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")).distinct()
        late = written(late.join(tested, ["a", "b"], "left_anti"), "late")
        more = written(_confirm(late, texts, percent, size), "links")
        tested = tested.unionByName(late)
        if not more.isEmpty():
            links = links.unionByName(more)
            comps = written(components(nodes, links), "components")

    named = nodes.select("node", "doc_id").join(comps, "node")
    ids = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    of_node = named.join(ids, "comp").select("node", "component_id")
    linked = feats.where("node is not null").select("doc_id", "text_key", "n_shingles", "node").join(of_node, "node").select("doc_id", "text_key", "n_shingles", "component_id")
    alone = feats.where("node is null").select("doc_id", "text_key", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def _one_each(texts: DataFrame) -> DataFrame:
    """One row per node; copies of a row lie in one partition after the join by its key."""

    def run(batches):
        seen: set[int] = set()
        for b in batches:
            keep = []
            for x in b.column(0).to_pylist():
                keep.append(x not in seen)
                seen.add(x)
            if any(keep):
                yield b.filter(pa.array(keep))

    return texts.mapInArrow(run, "node long, text string")


def op5_minhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_key")


def one_of_each(docs: DataFrame, percent: int = 80, size: int = SIZE) -> DataFrame:
    """The rows of ``docs``, all columns, of which one document of each component stays."""
    kept = near_duplicates(docs, percent, size).where("kept").select("doc_id", "text_key").distinct()
    keyed = docs.select(F.struct("*").alias("row"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"))
    return keyed.join(kept, (keyed["key"] == kept["text_key"]) & F.col("row.doc_id").eqNullSafe(kept["doc_id"]), "left_semi").select("row.*")


OP5_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws
  FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(ws) - 4, 1) + 1), lambda i: array_to_string(ws[i:i + 4], ' '))) AS s FROM d WHERE len(ws) > 0
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), links AS MATERIALIZED (
  SELECT x.doc_id AS a, y.doc_id AS b
  FROM s x JOIN s y USING (s) JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id
  WHERE x.doc_id <> y.doc_id
  GROUP BY 1, 2 HAVING 100 * count(*) >= 85 * (any_value(nx.n) + any_value(ny.n) - count(*))
), reach AS (
  SELECT doc_id AS node, doc_id AS seen FROM n
  UNION
  SELECT reach.node, links.b FROM reach JOIN links ON links.a = reach.seen
), c AS (SELECT node AS doc_id, min(seen) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id, d.doc_id = coalesce(c.component_id, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
