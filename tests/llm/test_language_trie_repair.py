"""Language identification, the prefix trie and structure repair against brute force, and their corner cases."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from compare import DATA
from methyra.llm import op11_language, op12_trie, op13_repair
from methyra.llm.queries import QUERIES

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _crc(x):
    return zlib.crc32(str(x).encode())


def _sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# language identification


def _brute_grams(text):
    """Grams as tuples: words with a border at each end, runs of 1 to 4 characters that are not borders alone."""
    out = []
    for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        s = f" {word} "
        out += [s[i : i + k] for k in range(1, op11_language.ORDER + 1) for i in range(len(s) - k + 1) if s[i : i + k].strip()]
    return out


@pytest.mark.parametrize("piece", [7, 20, 1 << 18])
def test_grams_of_pieces_are_those_of_whole_texts(monkeypatch, piece):
    rng = random.Random(5)
    texts = ["", "a", "!!", "Straße und Çédille, l'été 12 3", "日本語 text", "x" * 50, *("".join(rng.choice("abcé .9\n") for _ in range(rng.randrange(90))) for _ in range(60))]
    monkeypatch.setattr(op11_language, "PIECE", piece)
    got = defaultdict(list)
    for owner, found in op11_language.hashed(texts, 1 << 16):
        assert (np.diff(owner) >= 0).all()
        for i, b in zip(owner.tolist(), found.tolist()):
            got[i].append(b)
    name = {}  # a gram has one bucket wherever it stands
    for i, t in enumerate(texts):
        want = _brute_grams(t)
        assert len(got[i]) == len(want)
        single = [b for owner, found in op11_language.hashed([t], 1 << 16) for b in found.tolist()]
        assert sorted(single) == sorted(got[i])
        for g in set(want):
            alone = [b for _, found in op11_language.hashed([g], 1 << 16) for b in found.tolist()] if " " not in g and len(g) == 1 else None
            if alone:
                assert name.setdefault(g, alone[0]) == alone[0] and alone[0] in got[i]


def test_counts_and_posteriors_equal_brute_force(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("lang", "text").where("lang is not null").collect()
    odd = [("xx", ""), ("xx", "123 !"), ("", "abc"), (None, "zzz"), ("yy", None)]
    buckets = 1 << 16
    model = op11_language.fit(spark.createDataFrame([tuple(r) for r in rows] + odd, "lang string, text string"))
    counts, texts = {}, {}
    for lang, text in [*((r[0], r[1]) for r in rows), ("", "abc")]:
        for _, found in op11_language.hashed([text], buckets):
            counts.setdefault(lang, np.zeros(buckets))
            np.add.at(counts[lang], found, 1)
        texts[lang] = texts.get(lang, 0) + 1
    assert model.languages == sorted(counts) and "xx" not in model.languages
    for j, lang in enumerate(model.languages):
        total = counts[lang].sum() + op11_language.SMOOTH * buckets
        assert np.allclose(model.matrix[:, j], np.log((counts[lang] + op11_language.SMOOTH) / total))
        assert abs(model.prior[j] - np.log(texts[lang] / sum(texts.values()))) < 1e-12
    sample = [r[1] for r in rows[:20]] + ["Te es."]
    for t, name, sure in zip(sample, *model.predict(sample)):
        grams = np.concatenate([found for _, found in op11_language.hashed([t], buckets)])
        total = model.prior + model.matrix[grams].sum(0)
        p = np.exp(total - total.max())
        assert name == model.languages[int(total.argmax())] and abs(sure - p.max() / p.sum()) < 1e-6


def test_language_of_held_out_documents(spark):
    d = "/root/testdata/sf0.01" if DATA.endswith("sf0.001") else DATA
    got = QUERIES["op11_language_id"](spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {r["doc_id"] for r in got if _crc(r["doc_id"]) % 4 == 2}
    assert all(0 <= r["score"] <= 1 for r in got) and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.98 * len(held)


def test_language_corner_cases(spark, tmp_path):
    rows = [(1, "Der Hund und die Katze", "de"), (1, "Der Hund und die Katze", "de"), (2, None, "de"), (3, "", "fr"), (None, "le chat et la souris", "fr"), (4, "12 + 3", "fr"), (5, "le chien et la souris sont là", "fr"), (0, "die Katze und der Hund " * 30_000, None), *((i, "le chat noir et la souris grise sont là", "fr") for i in range(7, 15))]
    d = spark.createDataFrame([(*r, "c", "d") for r in rows], "doc_id long, text string, lang string, lang_pred string, score string")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op11_language_id"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"doc_id", "held_out", "lang_pred", "score"}
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and _crc(r["doc_id"]) % 4 == 2)
    by_id = {r["doc_id"]: r["lang_pred"] for r in got}
    assert [by_id[i] for i in (2, 3, 4)] == ["und"] * 3 and by_id[0] == "de" and by_id[None] == "fr"
    empty = op11_language.fit(d.limit(0))
    assert op11_language.identified(d, empty).where("lang_pred <> 'und' or score <> 0").isEmpty()
    assert op11_language.identified(d.limit(0), empty).count() == 0


def test_fewer_buckets_for_many_languages(spark, monkeypatch):
    monkeypatch.setattr(op11_language, "CELLS", 3 << 13)
    d = spark.createDataFrame([(x, f"{x} {x}words") for x in ("aa", "bb", "cc")], "lang string, text string")
    model = op11_language.fit(d)
    assert model.matrix.shape == (1 << 13, 3) and model.predict(["bbwords"])[0] == ["bb"]
    monkeypatch.setattr(op11_language, "CELLS", 2 * op11_language.LEAST)
    with pytest.raises(ValueError):
        op11_language.fit(d)


# prefix trie


def _rebuilt(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            r, t = role or "", text or ""
            convs[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(r)}:{r}{t}".encode()).hexdigest()[:32], r, t))
    own = {c: [x[3:] for x in sorted(v)] for c, v in convs.items()}
    return {c: own.get(c - int(math.fmod(c, 20)), [])[: _crc(c) % 4] + own[c][_crc(c) % 4 :] for c in own}


def _brute_trie(sequences):
    members, ends = defaultdict(list), defaultdict(list)
    for c, seq in sequences.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
        ends[tuple(seq)].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    below = {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * (len(_WORD.findall(node[-1][1])) if node else 0)
        subs = [below[x] for x in children[node]]
        below[node] = (sum(x[0] for x in subs) if subs else 1, own + sum(x[1] for x in subs))
    return sorted(
        (min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children[n]), *below[n], _sha(",".join(map(str, sorted(ends[n]))))) for n, m in members.items()
    )


_COLS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
_key = lambda r: tuple((x is not None, x) for x in r)


def _random_conversations(seed, n):
    rng = random.Random(seed)
    texts = ["", "a", "b c", "d e f", "g\nh"]
    rows = []
    for c in rng.sample(range(-60, 300), n):
        kind = rng.random()
        seq = [("user", "a")] * 3 if kind < 0.3 else [(rng.choice(["user", "system"]), rng.choice(texts)) for _ in range(rng.randrange(1, 7))]
        rows += [(c, t, r, x) for t, (r, x) in enumerate(seq)]
    rows += [(1000, t, "user", f"turn {t % 7}") for t in range(300)] + [(1020, t, "user", f"turn {t % 7}") for t in range(290)]
    return rows


@pytest.mark.parametrize("seed, ranges", [(1, 1), (2, 3), (3, 40), (4, 200)])
def test_trie_equals_brute_force(spark, monkeypatch, seed, ranges):
    monkeypatch.setattr(op12_trie, "IDS", 3)
    monkeypatch.setattr(op12_trie, "SEARCHED", 64)
    rows = _random_conversations(seed, 250)
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = [tuple(r) for r in op12_trie.trie(op12_trie.rebuilt(d), ranges).select(*_COLS).collect()]
    assert sorted(got, key=_key) == sorted(_brute_trie(_rebuilt(rows)), key=_key)


def test_trie_corner_cases(spark):
    schema = "conv_id long, turn long, role string, text string, key string, words string, base string"
    odd = [(0, None, None, None), (0, 1, "user", "x"), (0, 1, "user", "x"), (7, None, None, "y"), (7, None, "user", "z"), (None, 1, "user", "lost"), (21, 1, "user", "gone"), (8, 0, "user", "w " * 5000)]
    make = lambda rows: op12_trie.trie(op12_trie.rebuilt(spark.createDataFrame([(*r, "k", "w", "b") for r in rows], schema)), 4).select(*_COLS)
    assert sorted(map(tuple, make(odd).collect()), key=_key) == sorted(_brute_trie(_rebuilt(odd)), key=_key)
    assert make(odd[:0]).count() == 0
    turnless = [(c, 0, "user", "x") for c in range(21, 40) if _crc(c) % 4]
    assert make(turnless).collect() == [(turnless[0][0], 0, None, len(turnless), 0, 1, 0, _sha(",".join(str(r[0]) for r in turnless)))]


def test_hot_conversation_spans_ranges(spark):
    rows = [(20 * c, t, "user", f"same {t}") for c in range(400) for t in range(3)] + [(20 * c, t, "user", f"same {t if t < 2 else c}") for c in range(400, 600) for t in range(4)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = [tuple(r) for r in op12_trie.trie(op12_trie.rebuilt(d), 16).select(*_COLS).collect()]
    assert sorted(got, key=_key) == sorted(_brute_trie(_rebuilt(rows)), key=_key)


def test_range_minima():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 17, 64):
        v = rng.integers(0, 5, n)
        table = op12_trie.RangeMinimum(v)
        at, least = np.repeat(np.arange(n), 6), np.tile(np.arange(6), n)
        right, left = table.right(at, least), table.left(at, least)
        for i, d, r, l in zip(at, least, right, left):
            want_r, want_l = i, i
            while want_r + 1 < n and v[want_r + 1] >= d:
                want_r += 1
            while want_l > 0 and v[want_l] >= d:
                want_l -= 1
            assert (r, l) == (want_r, want_l)
        low, high = np.array([(i, j) for i in range(n) for j in range(i, n)]).T
        assert table(low, high).tolist() == [v[i : j + 1].min() for i, j in zip(low, high)]


# structure repair


def _brute_repair(turns):
    """Cheapest (cost, audit, repaired) by a search over all edits; turns are (role, text, fault)."""
    after = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
    name = {"u": "user", "a": "assistant"}
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if i == len(turns) and state in (0, 3):
            return cost, audit, "\n".join(f"{r}:{t}" for r, t in out)
        if (i, state) in done:
            continue
        done.add((i, state))
        for x in "ua":
            if (state, x) in after:
                heapq.heappush(heap, (cost + 5, audit + "I", i, after[state, x], (*out, (name[x], ""))))
        if i < len(turns):
            role, text, fault = turns[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, out))
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault == "truncated" else 0
                if (state, role[:1]) in after:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, after[state, role[:1]], (*out, (role, text))))
                for x in "ua":
                    if (state, x) in after:
                        heapq.heappush(heap, (cost + 1 + extra, audit + "R", i + 1, after[state, x], (*out, (name[x], text))))


def _brute_op13(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = _crc(f"{' ' if c is None else c}:{' ' if turn is None else turn}") % 20
        convs[c]
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            role = "user" if kind == 4 else role
            token = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            convs[c] += [(turn is not None, turn or 0, token, role, text)] * (2 if kind == 3 else 1)
    out = []
    for c, found in convs.items():
        turns, seen = [], set()
        for *_, role, text in (found := sorted(found)):
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            turns.append((role, text, "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""))
            seen.add((role, text))
        numbers = [x[1] for x in found if x[0]]
        faults = [t[2] for t in turns]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit, text = _brute_repair(turns)
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        out.append((c, gaps, *map(faults.count, ("blank", "duplicate", "truncated")), illegal, cost, audit, _sha(text)))
    return out


_REPAIR = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_repair_equals_brute_force(spark):
    rng = random.Random(9)
    texts, roles = ["Done.", "yes!", "half", "", " \n", "x?  ", "p", "q."], ["user", "assistant", "system", "tool", "u", "Assistant", "", "sys"]
    rows = [(c, t if rng.random() < 0.95 else t + 3, rng.choice(roles[: rng.choice([2, 3, 8])]), rng.choice(texts) + rng.choice(["", "", f" {t}."])) for c in range(500) for t in range(rng.randrange(1, 9))]
    rows += [(c, None if rng.random() < 0.3 else rng.randrange(3), rng.choice([None, *roles]), rng.choice([None, *texts])) for c in [*range(500, 560), None] for _ in range(5)]
    rows += [(900, t, "user" if t % 3 else "assistant", f"t{t}.") for t in range(400)]
    schema = "conv_id long, turn long, role string, text string, token string, audit string, late string"
    d = spark.createDataFrame([(*r, "t", "a", "l") for r in rows], schema)
    got = [tuple(r) for r in op13_repair.repaired(op13_repair.damaged(d)).select(*_REPAIR).collect()]
    assert sorted(got, key=_key) == sorted(_brute_op13(rows), key=_key)
    assert op13_repair.repaired(op13_repair.damaged(d.limit(0))).count() == 0


def test_cut_of_a_span_does_not_matter():
    rng = random.Random(4)
    for _ in range(200):
        cells = [op13_repair.turn_cell(rng.choice("suax"), rng.choice(["", "", "truncated", "blank", "duplicate"])) for _ in range(rng.randrange(1, 9))]
        n = len(cells)
        chart = {(i, i + 1): c for i, c in enumerate(cells)}
        for size in range(2, n + 1):  # every span, every cut
            for i in range(n - size + 1):
                ways = [op13_repair.combined(chart[i, k], chart[k, i + size]) for k in range(i + 1, i + size)]
                assert all(w == ways[0] for w in ways)
                chart[i, i + size] = ways[0]
        best = min(chart[0, n][0, q] for q in (0, 3) if (0, q) in chart[0, n])
        level = cells
        while len(level) > 1:
            level = [op13_repair.combined(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        assert min(level[0][0, q] for q in (0, 3) if (0, q) in level[0]) == best


def test_lost_conversation_has_zeros(spark):
    lost = next(c for c in range(1000) if _crc(f"{c}:0") % 20 == 0)
    d = spark.createDataFrame([(lost, 0, "user", "x.")], "conv_id long, turn long, role string, text string")
    assert op13_repair.repaired(op13_repair.damaged(d)).select(*_REPAIR).collect() == [(lost, 0, 0, 0, 0, 0, 0, "", _sha(""))]
