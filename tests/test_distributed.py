"""Operators that spread one large group over tasks, against brute force; and sources of many splits."""

import gzip
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import DATA
from methyra.plans.queries import QUERIES
from methyra.operators import genes, qc, trend
from methyra.sources import tables
from methyra.streaming import ingest as live


def _stepped(ps):
    """(rank, bh, by) of p-values in the order of (p, place)."""
    m = len(ps)
    order = sorted(range(m), key=lambda i: (ps[i], i))
    c, least, out = sum(1 / k for k in range(1, m + 1)), np.inf, {}
    for k in range(m, 0, -1):
        least = min(least, ps[order[k - 1]] * m / k)
        out[order[k - 1]] = (k, min(1, least), min(1, least * c))
    return out


def test_one_family_over_many_ranges(spark):
    rng = random.Random(2)
    families = {"big": [round(rng.random() ** 3, 3) for _ in range(5000)], "one": [0.2], "ties": [0.5] * 40, "mid": [rng.random() for _ in range(300)]}
    rows = [(f, i, p) for f, ps in families.items() for i, p in enumerate(ps)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = trend.step_up(spark.createDataFrame(rows, "family string, id long, p double").repartition(7), "p", ["family"], ["id"])
        got = {(r["family"], r["id"]): r for r in out.withColumns({k: trend.corrected(F.col("least"), F.col("m"), k) for k in ("bh", "by")}).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(got) == len(rows)
    for f, ps in families.items():
        for i, (rank, bh, by) in _stepped(ps).items():
            r = got[f, i]
            assert r["rank"] == rank and r["m"] == len(ps) and abs(r["bh"] - bh) < 1e-12 and abs(r["by"] - by) < 1e-12


def test_harmonic_numbers(spark):
    ms = [1, 2, 255, 256, 257, 1000, 100_000]
    got = spark.createDataFrame([(m,) for m in ms], "m long").select("m", trend.harmonic(F.col("m")).alias("h")).collect()
    assert all(abs(r["h"] - sum(1 / k for k in range(1, r["m"] + 1))) < 1e-11 for r in got)


def test_statistic_equals_pairs(spark):
    rng = random.Random(5)
    rows = []
    for i in range(200):
        sizes = [rng.randrange(0, 6) for _ in range(rng.randrange(1, 7))]
        groups = [g for g, n in enumerate(sizes, 1) for _ in range(n)]
        values = [rng.randrange(4) for _ in groups]
        levels = sorted(set(values))
        rows.append((i, groups, [levels.index(v) + 1 for v in values], sizes))
    got = {r["i"]: r for r in trend.statistic(spark.createDataFrame(rows, "i int, groups array<int>, ranks array<int>, n array<int>")).collect()}
    for i, groups, ranks, sizes in rows:
        pairs = [(ranks[a], ranks[b]) for a in range(len(groups)) for b in range(len(groups)) if groups[a] < groups[b]]
        assert got[i]["doubled"] == sum(2 * (x < y) + (x == y) for x, y in pairs) and got[i]["doubled_max"] == 2 * len(pairs)


def test_layout_of_observations(spark):
    cells = spark.createDataFrame([("d", "f", s, v) for s, v in zip("abcdef", [3.0, 1.0, 1.0, 2.0, 3.0, 1.0])] + [("d", "g", "a", 1.0)], "dataset_id string, feature_id string, sample_id string, value double")
    samples = spark.createDataFrame([("d", s, dose, place) for s, dose, place in zip("abcdef", [10.0, 0.0, 0.0, 5.0, 5.0, 10.0], [6, 2, 1, 4, 3, 5])], "dataset_id string, sample_id string, dose_value double, position int")
    got = {r["feature_id"]: r for r in trend.observations(cells, samples).collect()}
    assert got["f"]["values"] == [1.0, 1.0, 3.0, 2.0, 1.0, 3.0] and got["f"]["ranks"] == [1, 1, 3, 2, 1, 3]
    assert got["f"]["groups"] == [1, 1, 2, 2, 3, 3] and got["f"]["n"] == [2, 2, 2] and (got["f"]["sizes"], got["f"]["ties"]) == ("2-2-2", "3-1-2")
    assert got["g"]["n"] == [0, 0, 1] and "missing_value" in got["g"]["own"]


def _draws(seed):
    state = seed or 0x9E3779B9
    while True:
        state ^= state << 13 & 0xFFFFFFFF
        state ^= state >> 17
        state ^= state << 5 & 0xFFFFFFFF
        yield state


def _score(groups, ranks):
    return sum(2 * (ranks[a] < ranks[b]) + (ranks[a] == ranks[b]) for a in range(len(groups)) for b in range(len(groups)) if groups[a] < groups[b])


@pytest.mark.parametrize("seed", [0, 1, 20260727, 0xFFFFFFFF])
@pytest.mark.parametrize("groups, ranks", [([1, 1, 2, 2, 3, 3], [1, 4, 2, 2, 5, 3]), ([1] * 3 + [2] * 4 + [3] * 2 + [4] * 3, [1, 2, 2, 3, 5, 4, 4, 1, 6, 7, 7, 2])])
def test_streams_equal_draw_by_draw(seed, groups, ranks):
    n, draw = len(groups), _draws(seed)
    want = []
    for _ in range(300):
        labels = list(groups)
        for i in range(n - 1, 0, -1):
            j = int(next(draw) / 2**32 * (i + 1))
            labels[i], labels[j] = labels[j], labels[i]
        want.append(_score(labels, ranks))
    assert trend.permuted(np.array(groups), np.array(ranks), 300, seed).tolist() == want
    draw, want = _draws(seed), []
    for _ in range(300):
        picked = []
        for g in sorted(set(groups)):
            own = [r for x, r in zip(groups, ranks) if x == g]
            picked += [own[int(next(draw) / 2**32 * len(own))] for _ in own]
        want.append(_score(groups, picked))
    assert trend.resampled(np.array(groups), np.array(ranks), 300, seed).tolist() == want


def test_sampled_interval_and_error(spark):
    groups, ranks = [1, 1, 1, 2, 2, 2, 3, 3, 3], [1, 2, 4, 3, 5, 6, 7, 8, 9]
    stats = spark.createDataFrame([("d", "cg1", groups, ranks, _score(groups, ranks), 54)], "dataset_id string, feature_id string, groups array<int>, ranks array<int>, doubled long, doubled_max long")
    r = trend.sampled(stats, 499, 199).first()
    effect = np.sort(2 * trend.resampled(np.array(groups), np.array(ranks), 199, trend.stream_seed(trend.SEED, "cg1", "bootstrap")) / 54 - 1)
    assert (r["effect_low"], r["effect_high"]) == (trend.percentile(effect, 0.025), trend.percentile(effect, 0.975))
    assert r["effect_low"] <= 2 * _score(groups, ranks) / 54 - 1 <= r["effect_high"] and abs(r["standard_error"] - (r["p_two"] * (1 - r["p_two"]) / 500) ** 0.5) < 1e-15
    assert r["p_up"] <= 0.01 and r["resolution"] == 1 / 500


@pytest.mark.parametrize("block, held, dense", [(1024, 1 << 25, 1 << 22), (4, 64, 16)])
def test_moments_equal_numpy(spark, monkeypatch, block, held, dense):
    for k, v in {"BLOCK": block, "HELD": held, "DENSE": dense}.items():
        monkeypatch.setattr(qc, k, v)
    rng = np.random.default_rng(7)
    x = 1e6 + rng.normal(size=(120, 11)) + rng.normal(size=(120, 1))
    x[:, 3] = 5.0
    there = rng.random(x.shape) < 0.7
    there[:, 10] = False
    there[0, 10] = True
    cells = [("d", f"f{i}", f"s{j:02}", float(x[i, j])) for i in range(120) for j in range(11) if there[i, j]]
    c = spark.createDataFrame(cells, "dataset_id string, feature_id string, sample_id string, value double")
    s = spark.createDataFrame([("d", f"s{j:02}", "g") for j in range(11)], "dataset_id string, sample_id string, dose_group_id string")
    got = {(r["s1"], r["s2"]): r for r in qc.sample_moments(c, s).collect()}
    for a in range(11):
        for b in range(a + 1, 11):
            both = there[:, a] & there[:, b]
            if not both.any():
                assert (a, b) not in got
                continue
            r, u, v = got[a, b], x[both, a], x[both, b]
            assert r["n"] == both.sum() and abs(r["mx"] - u.mean()) < 1e-6
            assert np.allclose([r["cxx"], r["cyy"], r["cxy"]], [((u - u.mean()) ** 2).sum(), ((v - v.mean()) ** 2).sum(), ((u - u.mean()) * (v - v.mean())).sum()], atol=1e-6)
    stability = qc.replicate_stability(c, s.withColumn("replicate_type", F.lit("biological"))).first()
    r = [np.corrcoef(x[b2, a], x[b2, b])[0, 1] for a in range(11) for b in range(a + 1, 11) for b2 in [there[:, a] & there[:, b]] if b2.sum() >= 2 and 3 not in (a, b)]
    assert stability["n_pairs"] == len(r) and abs(stability["mean_r"] - np.mean(r)) < 1e-8 and abs(stability["min_r"] - min(r)) < 1e-8


@pytest.mark.parametrize("dense", [3, 200_000])
def test_overlaps_of_all_lengths(spark, dense):
    rng = random.Random(3)
    span = lambda: (lambda a, n: (a, a + n))(rng.randrange(0, 200_000_000), rng.choice([0, 1, 100, 4096, 4097, 70_000, 2_000_000, 100_000_000]))
    near = lambda: (lambda a: (a, a + 120))(1_000_000 + rng.randrange(0, 9000))
    a = [(f"a{i}", f"chr{i % 2}", *(span() if i < 150 else near())) for i in range(220)]
    b = [(f"b{i}", f"chr{i % 2}", *(span() if i < 150 else near())) for i in range(220)]
    left, right = spark.createDataFrame(a, "feature_id string, chrom string, start long, end long"), spark.createDataFrame(b, "gene_id string, chrom string, o_start long, o_end long")
    got = [(r["feature_id"], r["gene_id"]) for r in genes.overlaps(left, right, dense).collect()]
    want = {(x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] < y[3] and y[2] < x[3]}
    assert len(got) == len(want) and set(got) == want
    assert genes.overlaps(left.limit(0), right).count() == 0 and genes.overlaps(left, right.limit(0)).count() == 0


def test_rows_of_a_long_interval_do_not_grow_with_its_length(spark):
    one = lambda n: spark.createDataFrame([("a", "chr1", 5, 5 + n)], "feature_id string, chrom string, start long, end long")
    assert all(genes._binned(one(n), "start", "end", True, list(genes.LEVELS)).count() <= 2 * len(genes.LEVELS) + 2 for n in (100, 10_000, 1_000_000, 100_000_000, 3_000_000_000))


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_line_numbers_over_splits_and_shapes(spark, tmp_path, small_splits):
    rng = random.Random(8)
    want = []
    for name, header in (("a.csv", "x,y,z"), ("b.csv", "x;y"), ("c.csv", "x\ty\tz\tw"), ("d.csv", "z,x,y")):
        sep = next(s for s in "\t;," if s in header)
        n, rows = header.count(sep) + 1, [header]
        for i in range(2, 400):
            kind = rng.random()
            if kind < 0.05:
                rows.append(rng.choice(["", "   "]))
                want.append((name, i, "blank", f"Skipped empty row at line {i}"))
            elif kind < 0.1:
                rows.append(sep.join("q" * (n + 1)))
                want.append((name, i, "malformed", f"Malformed row at line {i}: expected {n} columns, got {n + 1}"))
            else:
                rows.append(sep.join([f'"v{sep}{i}"', *map(str, range(n - 1))]))
        (tmp_path / name).write_text(("\r\n" if name == "b.csv" else "\n").join(rows) + ("" if name == "c.csv" else "\n"))
    read = tables.lines(spark, str(tmp_path))
    assert read.select("file_path", "block").distinct().count() > 12
    got = [(r["file_name"], r["line_no"], r["kind"], r["message"]) for r in tables.line_problems(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)
    rows, problems = tables.delimited_shapes(spark, str(tmp_path))
    assert set(rows.columns) == {"x", "y", "z", "w", "file_name"} and rows.select("x").collect().__len__() == 4 * 398 - len(want) and problems.count() == len(want)
    assert rows.where("file_name like '%d.csv'").where("z not like 'v,%'").isEmpty()


@pytest.mark.parametrize("whole", [1 << 28, 300])
def test_digests_of_files_in_pieces(spark, tmp_path, monkeypatch, small_splits, whole):
    monkeypatch.setattr(tables, "PIECE", 256)
    text = "".join(f"line {i} {'x' * (i % 50)}\n" for i in range(200)).encode()
    files = {
        "plain.txt": text, "open.txt": text[:-1], "empty.txt": b"", "short.txt": b"a", "crlf.txt": text.replace(b"\n", b"\r\n"), "bytes.bin": bytes(range(256)) * 9, "breaks.txt": b"\n" * 900, "mark.txt": b"\xef\xbb\xbf" + text, "marked.txt": b"\xef\xbb\xbf" + text[:-1],
        "one.gz": gzip.compress(text), "two.gz": gzip.compress(text[:500]) + gzip.compress(text[500:]), "none.gz": gzip.compress(b""),
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    if whole > 300:  # as one value, a damaged file and one without a last line break are told apart
        files |= {"damaged.gz": gzip.compress(text)[:40] + b"zz" * 30, "cut.gz": gzip.compress(text[:-1])}
        for name in ("damaged.gz", "cut.gz"):
            (tmp_path / name).write_bytes(files[name])
    got = {r["file_path"].rsplit("/", 1)[1]: r for r in tables.digests(spark, str(tmp_path), whole).collect()}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    for name, data in files.items():
        r = got[name]
        assert (r["n_bytes"], r["sha256"]) == (len(data), sha(data)), name
        inner = None if name == "damaged.gz" else gzip.decompress(data) if name.endswith(".gz") else data
        assert (r["content_bytes"], r["content_sha256"]) == ((None, None) if inner is None else (len(inner), sha(inner))), name
    assert len(got) == len(files)


def test_stream_counts_a_repeated_batch_once(spark, tmp_path):
    import shutil

    def put(name, rows):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text("dataset_id,feature_id,sample_id,raw\n" + "".join(",".join(r) + "\n" for r in rows))

    run = lambda state: live.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / state), 1)
    told = lambda: {tuple(r) for r in live.totals(spark, str(tmp_path / "out")).select("dataset_id", "n_rows", "n_bad", "n_files", "n_warnings").collect()}
    put("a.csv", [("d", "f", "s1", "1"), ("d", "f", "s2", "x"), ("e", "f", "s1", "y")])
    run("state")
    assert told() == {("d", 2, 1, 1, 1), ("e", 1, 1, 1, 1)}
    put("b.csv", [("d", "g", "s1", "x"), ("d", "g", "s2", "z")])
    run("state")
    want = {("d", 4, 3, 2, 2), ("e", 1, 1, 1, 1)}
    assert told() == want
    # the second batch fails after it wrote a part, and runs again
    shutil.copytree(tmp_path / "state", tmp_path / "again")
    for name in ("1", ".1.crc"):
        (tmp_path / "again" / "commits" / name).unlink(missing_ok=True)
    shutil.rmtree(tmp_path / "out" / "totals" / "batch=1")
    run("again")
    assert told() == want
    files = spark.read.parquet(str(tmp_path / "out/files")).collect()
    assert {(r["file_name"], r["sha256"]) for r in files} == {(p.name, hashlib.sha256(p.read_bytes()).hexdigest()) for p in (tmp_path / "in").iterdir()}
    warnings = spark.read.parquet(str(tmp_path / "out/warnings")).select("dataset_id", "value").collect()
    assert sorted(map(tuple, warnings)) == [("d", "x"), ("d", "z"), ("e", "y")]


def test_collapsed_counts_hash_numbers_and_equal_the_lists(spark):
    rows = [("d", "f", "g1", "direct_promoter_overlap", "high"), ("d", "f", "g1", "enhancer_target_from_database", "medium"), ("d", "f", "g2", "enhancer_target_from_database", "medium"), ("d", "h", None, "unknown_target_gene", "none"), ("e", "f", "g9", "nearest_gene", "low")]
    m = spark.createDataFrame(rows, "dataset_id string, feature_id string, gene_id string, method string, confidence string")
    counts = genes.collapsed_counts(m)
    assert "SortAggregate" not in counts._jdf.queryExecution().executedPlan().toString()
    names = ["dataset_id", "feature_id", "n_genes", "method", "ambiguous"]
    assert sorted(map(tuple, counts.select(names).collect())) == sorted(map(tuple, genes.collapse(m).select(names).collect()))


@pytest.mark.parametrize("crowd", [(50_000, 5_000), (6, 5_000), (50_000, 2), (0, 0)])
def test_collapse_by_lists_equals_the_collapse_of_pairs(spark, crowd):
    # several and long regions, doubled and null genes, empty regions, no places, no names, features with mappings or regions only
    rng, ids = random.Random(5), "dataset_id string, feature_id string, "
    place = lambda: (lambda a, n: (a, a + n))(rng.randrange(0, 40_000), rng.choice([0, 1, 300, 1024, 1025, 9000, 5_000_000]))
    r = [(f"d{i % 2}", f"f{i % 90}", rng.choice(["chr1", "chr2", "chr3", None]), *place()) for i in range(100)] + [("d0", "bare", "chr1", None, None), ("d0", "below", "chr1", -50, 20), ("d0", None, "chr1", 0, 900), ("d0", None, "chr2", 0, 900)]
    g = [(rng.choice([f"g{i}", f"g{i % 7}", None]), f"chr{i % 2 + 1}", a := rng.randrange(0, 45_000), a + rng.randrange(0, 3000), rng.choice("+-")) for i in range(120)]
    kinds = [("enhancer_target_from_database", "medium"), ("direct_promoter_overlap", "high"), ("unknown_target_gene", "none"), (None, None)]
    m = [(f"d{i % 2}", f"f{i % 130}", rng.choice([f"g{i % 9}", f"x{i}", None]), *rng.choice(kinds)) for i in range(160)] + [("d0", None, "g0", *kinds[0])]
    regions, sites = spark.createDataFrame(r, ids + "chrom string, start long, end long"), spark.createDataFrame(g, "gene_id string, chrom string, start long, end long, strand string")
    others = spark.createDataFrame(m, ids + "gene_id string, method string, confidence string")
    pairs = genes.promoter_overlaps(regions, sites).select("dataset_id", "feature_id", "gene_id", F.lit("direct_promoter_overlap").alias("method"), F.lit("high").alias("confidence"))
    key = lambda df: sorted(map(repr, map(tuple, df.collect())))
    want = key(genes.collapse(pairs.unionByName(others)))
    assert len(want) > 130 and key(genes.promoter_collapse(regions, sites, others, crowd=crowd)) == want
    assert key(genes.promoter_collapse(regions.limit(0), sites, others, crowd=crowd)) == key(genes.collapse(others))
    assert key(genes.promoter_collapse(regions, sites.limit(0), others.limit(0), crowd=crowd)) == []


@pytest.mark.parametrize("name", ["q9_handoff_audit", "q11_readiness_audit"])
def test_decisions_asked_several_times_are_worked_out_once(spark, name):
    assert not any("lineitem" in f for f in QUERIES[name](spark, DATA).inputFiles())


def test_sampled_rows_are_dealt_over_all_partitions(spark):
    # few bytes, much work: a shuffle without a number would be put together into one task
    rows = [("d", f"f{i}", [1, 1, 2, 2, 3, 3], [1, 2, 3, 4, 5, 6], 24, 24) for i in range(64)]
    stats = spark.createDataFrame(rows, "dataset_id string, feature_id string, groups array<int>, ranks array<int>, doubled long, doubled_max long").coalesce(1)
    assert trend.sampled(stats, 99, 99).select(F.spark_partition_id().alias("p")).distinct().count() > 1
