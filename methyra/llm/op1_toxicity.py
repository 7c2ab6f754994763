"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel counts, for two strings, the common subsequences of ``ORDER`` characters, each weighted by ``DECAY`` to the
power of the gaps it has in either string, so inserted characters and gaps lower a match and do not end it. It is
normalised and raised to ``POWER``. A text is the set of its windows: its distinct tokens, in lower case without
punctuation, and the runs of neighbouring tokens that are each a short piece of a landmark, joined ("i d i o t",
"id iot", "wor.th less"). The kernel of two texts is the sum over the pairs of their windows, divided by the roots of their
numbers; its Nyström features are a text's summed window kernels to the landmarks, whitened by the landmarks' own kernel
matrix. A linear support vector machine is trained on these features and the labels of whole texts (the tables label no
single sentences), balanced by class. Landmarks are windows of training texts of either class that tell most, no two
of them alike, and in a second round the windows that the first machine misjudges most often in texts without label.
Toxic texts are trained on once more with a character inserted into the windows that are landmarks.
A logistic curve turns the margin into a score, 0.5 at the cut that serves best in cross-validation.

Training takes the labelled rows outside the held-out fold, at most ``MAX_TOXIC`` and ``MAX_CLEAN`` of the classes by a
hash of the id, and of these texts of at most ``MAX_CHARS`` characters; this is the only bounded sample. Every text is scored
whole. A window longer than ``WINDOW`` characters is read in overlapping parts.

Empty and null texts get the score of a text without windows (the intercept). Without labels of both classes every
score is 0. Null ids have no fold and count as not held out. Repeated rows and labels, ties and extra columns change
nothing but the training weights of what is repeated. Columns in ``keep`` must not be named score or predicted.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, batch_of, col_of, spread, table, texts_of

ORDER, DECAY, POWER = 4, 0.6, 2
LANDMARKS, HARD = 40, 16
#: Weight of a toxic training text whose landmarks have a character inserted.
GAPPED = 1.0
MAX_TOXIC, MAX_CLEAN, MAX_CHARS = 1_200, 2_000, 10_000
WINDOW, STEP = 12, 6
#: Characters of a token that may be a piece of a landmark.
PIECE = 5
#: Windows that a worker remembers.
CAP = 300_000

_MARKS = re.compile(r"[\W_]+")


def window_of(token: str) -> str:
    """The token without punctuation, with a mark at its start ("i.d.i.o.t" and "idiot" are one window)."""
    return "^" + (token if token.isalnum() else _MARKS.sub("", token))


def parts_of(window: str) -> list[str]:
    """The window, or its overlapping parts if it is long."""
    return [window[at : at + WINDOW] for at in range(0, max(1, len(window) - STEP), STEP)]


def pieces_of(marks: Iterable[str]) -> set[str]:
    """All proper pieces of the landmarks of at most ``PIECE`` characters."""
    words = [m.lstrip("^") for m in marks]
    return {w[i:j] for w in words for i in range(len(w)) for j in range(i + 1, min(i + PIECE, len(w)) + 1) if j - i < len(w)}


def joined_pieces(tokens: list[str], pieces: set[str]) -> set[str]:
    """All runs of two or more neighbouring tokens that are pieces, joined, of a length that one window can hold."""
    out: set[str] = set()
    run: list[str] = []
    before = -1
    for i in [i for i, t in enumerate(tokens) if t in pieces]:
        run = [*run, tokens[i]] if i == before + 1 else [tokens[i]]
        before = i
        joined = tokens[i]
        for t in reversed(run[:-1]):
            joined = t + joined
            if len(joined) >= WINDOW:
                break
            if len(joined) >= ORDER:
                out.add(joined)
        run = run[-WINDOW:]
    return out


def _codes(words: list[str], width: int) -> np.ndarray:
    out = np.zeros((len(words), width), np.int32)
    for i, w in enumerate(words):
        out[i, : len(w)] = np.frombuffer(w.encode("utf-32-le", "surrogatepass"), np.int32)
    return out


def _sharing(a: np.ndarray, marks: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose longest common subsequence has ``order`` characters; all others have the kernel value 0.

    Bit-parallel: a zero bit of ``v`` for each character of the longest common subsequence.
    """
    letters = sorted({ord(c) for m in marks for c in m})
    masks = np.zeros((len(letters) + 1, len(marks)), np.uint32)
    for j, m in enumerate(marks):
        for k, c in enumerate(m):
            masks[letters.index(ord(c)), j] |= np.uint32(1 << k)
    at = np.searchsorted(letters, a)
    at[(at == len(letters)) | (np.r_[letters, -1][at] != a)] = len(letters)
    full = np.array([(1 << len(m)) - 1 for m in marks], np.uint32)
    v = np.broadcast_to(full, (len(a), len(marks))).copy()
    for i in range(a.shape[1]):
        u = v & masks[at[:, i]]
        v = ((v + u) | (v - u)) & full
    common = np.array([len(m) for m in marks], np.int8) - np.bitwise_count(v).astype(np.int8)
    return np.nonzero(common >= order)


def _paired(a: np.ndarray, b: np.ndarray, order: int, decay: float) -> np.ndarray:
    """Gap-weighted counts of common subsequences of string i of ``a`` and string i of ``b`` (codes by place, 0 fills).

    Only gaps cost: a run without gaps weighs 1. The usual recursion over (length, place in a, place in b), for all
    pairs at once.
    """
    b = np.where(b == 0, -1, b)
    m, pairs = b.shape
    lam, total = np.float32(decay), np.zeros(pairs, np.float32)
    # tail[p][j]: weight of common subsequences of p + 1 characters that end at or before the current place of a and
    # at or before place j of b, decayed by both distances.
    tail = np.zeros((order - 1, m, pairs), np.float32)
    for i in range(len(a)):
        same = (a[i][None, :] == b).astype(np.float32)
        fresh = [same]
        for p in range(1, order):
            x = np.zeros_like(same)
            x[1:] = tail[p - 1, :-1] * same[1:]
            fresh.append(x)
        total += fresh[-1].sum(0)
        tail *= lam
        for p in range(order - 1):
            carry = fresh[p]
            for j in range(1, m):
                carry[j] += lam * carry[j - 1]
            tail[p] += carry
    return total


def kernel(words: list[str], marks: list[str], order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """The normalised kernel, words by marks (of up to 30 characters): 1 for equal strings, 0 without a common
    subsequence. Values are worked out for the pairs only that share a subsequence at all."""
    out = np.zeros((len(words), len(marks)), np.float32)
    n, m = max(map(len, words), default=0), max(map(len, marks), default=0)
    if not n or not m:
        return out
    a, b = _codes(words, n), _codes(marks, m)
    wi, mi = _sharing(a, marks, order)
    if not len(wi):
        return out
    total = _paired(a[wi].T.copy(), b[mi].T.copy(), order, decay)
    some, back = np.unique(wi, return_inverse=True)
    mine = _paired(a[some].T.copy(), a[some].T.copy(), order, decay)
    own = _paired(b.T.copy(), b.T.copy(), order, decay)
    out[wi, mi] = total / np.sqrt(mine[back] * own[mi])
    return out


class Model:
    """Landmarks, the weight of each kernel value, intercept, and slope of the logistic curve."""

    def __init__(self, marks: list[str], weights: np.ndarray, intercept: float, slope: float):
        self.marks, self.weights, self.intercept, self.slope = marks, weights, intercept, slope
        self.pieces = pieces_of(m for m, w in zip(marks, weights) if w > 0)

    def values(self, windows: list[str]) -> np.ndarray:
        """What each window adds to a margin, before the division by the root of the windows' number."""
        out = np.zeros(len(windows))
        if not self.marks or not windows:
            return out
        parts, owner = [], []
        for i, w in enumerate(windows):
            for part in parts_of(w):
                parts.append(part)
                owner.append(i)
        order = sorted(range(len(parts)), key=lambda i: len(parts[i]))
        got = np.empty(len(parts))
        for at in range(0, len(order), 2048):
            some = order[at : at + 2048]
            got[some] = kernel([parts[i] for i in some], self.marks).astype(float) ** POWER @ self.weights
        np.add.at(out, owner, got)
        return out

    def windows(self, tokens: list[str]) -> set[str]:
        """Distinct tokens and joined pieces of a text."""
        return set(tokens) | joined_pieces(tokens, self.pieces)

    def margin(self, total: float, n: int) -> float:
        return self.intercept + total / max(n, 1) ** 0.5

    def score(self, margin: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin, -40, 40))))


def telling(texts: list[set[str]], labels: np.ndarray, most: int, taken: list[str], known: dict[str, float] | None = None) -> list[str]:
    """Windows whose share of texts differs most between the classes (or, where ``known`` has their values, that add most
    to margins of texts without label), no two alike and none like those ``taken``."""
    seen = [Counter(w for t, y in zip(texts, labels) if y == k for w in t) for k in (0, 1)]
    n, m = max(1, int((labels == 1).sum())), max(1, int((labels == 0).sum()))
    if known is None:
        worth = {w: abs(seen[1][w] / n - seen[0][w] / m) / np.sqrt((seen[1][w] + seen[0][w] + 1) / (n + m) * (1 / n + 1 / m)) for w in seen[0] | seen[1] if seen[0][w] + seen[1][w] >= 3}
    else:
        worth = {w: c * known[w] for w, c in seen[0].items() if known.get(w, 0) > 0}
    chosen: list[str] = []
    for w in sorted(worth, key=lambda w: (-round(worth[w], 6), w))[: 40 * most]:
        if len(chosen) == most:
            break
        if ORDER < len(w) <= WINDOW and (not (chosen or taken) or kernel([w], [*taken, *chosen]).max() < 0.5):
            chosen.append(w)
    return chosen


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float, rounds: int = 40) -> np.ndarray:
    """Linear support vector machine (squared hinge, intercept last) by Newton steps over the active rows."""
    z = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.diag(np.r_[np.ones(x.shape[1]), 1e-6])
    w, before = np.zeros(z.shape[1]), None
    for _ in range(rounds):
        on = y * (z @ w) < 1
        if before is not None and (on == before).all():
            break
        a = z[on] * weight[on, None]
        w, before = np.linalg.solve(ridge + 2 * c * z[on].T @ a, 2 * c * a.T @ y[on]), on
    return w


def train(rows: Iterable[tuple[str | None, int]]) -> Model:
    """A model from (text, label) rows."""
    rows = list(rows)
    held_: dict[str, str] = {}  # equal windows are one object
    once = lambda w: held_.setdefault(w, w)
    tokens = [[once(window_of(t)[1:]) for t in (text or "").lower().split()] for text, _ in rows]
    labels = np.array([int(y) for _, y in rows])
    none = Model([], np.zeros(0), -40.0, 1.0)
    if len(set(labels.tolist())) < 2:
        return none
    texts = [{once("^" + t) for t in ts} for ts in tokens]
    folds = np.arange(len(labels)) % 3
    marks = telling(texts, labels, LANDMARKS, [])
    model = none
    for extra in (0, HARD):
        if extra:
            every = sorted(set().union(*texts))
            known = {}
            for i in range(0, len(every), 8192):
                known.update(zip(every[i : i + 8192], model.values(every[i : i + 8192]).tolist()))
            marks = marks + telling(texts, labels, extra, marks, known)
        if not marks:
            return none
        pieces = pieces_of(marks)
        sets = [t | {once("^" + x) for x in joined_pieces(ts, pieces)} for t, ts in zip(texts, tokens)]
        # each toxic text once more, with a character that no text has inside the windows that are landmarks
        held = set(marks)
        again = [i for i in np.flatnonzero(labels == 1) if not held.isdisjoint(sets[i])]
        sets += [{w[: len(w) // 2 + 1] + "\x01" + w[len(w) // 2 + 1 :] if w in held else w for w in sets[i]} for i in again]
        owner = np.r_[np.arange(len(labels)), np.array(again, int)]
        y = np.where(labels[owner] == 1, 1.0, -1.0)
        weight = np.r_[np.ones(len(labels)), np.full(len(again), GAPPED)]
        balance = np.where(y > 0, 0.5 / weight[y > 0].sum(), 0.5 / weight[y < 0].sum()) * weight
        part = folds[owner]
        x = _features(sets, marks) / np.sqrt([max(len(texts[i]), 1) for i in owner])[:, None]
        scale, base = np.linalg.eigh(kernel(marks, marks).astype(float) ** POWER + 1e-3 * np.eye(len(marks)))
        white = base / np.sqrt(np.maximum(scale, 1e-9)) @ base.T
        z = x @ white
        best = (-1.0, 0.0, 0.0)
        for c in (3e1, 1e2, 3e2, 1e3, 3e3, 1e4):
            out = np.zeros(len(y))
            for k in range(3):
                w = _svm(z[part != k], y[part != k], balance[part != k], c)
                out[part == k] = z[part == k] @ w[:-1] + w[-1]
            cut, value = _cut(out[: len(labels)], labels)
            best = max(best, (value, -c, cut))
        _, c, cut = best
        w = _svm(z, y, balance, -c)
        margin = (z @ w[:-1] + w[-1] - cut)[: len(labels)]
        far = max(1e-3, float(np.median(margin[labels == 1]) - np.median(margin[labels == 0])))
        model = Model(marks, white @ w[:-1], float(w[-1] - cut), 8.0 / far)
    return model


def _features(sets: list[set[str]], marks: list[str]) -> np.ndarray:
    """Kernel values to the landmarks of each text's windows, summed over windows and their parts. The distinct windows of
    all texts are worked on by few thousands, so no table of all of them is held."""
    place: dict[str, int] = {}
    text = np.repeat(np.arange(len(sets)), [len(t) for t in sets])
    window = np.fromiter((place.setdefault(w, len(place)) for t in sets for w in sorted(t)), np.int64, len(text))
    order = np.argsort(window, kind="stable")
    text, window = text[order], window[order]
    every, out = list(place), np.zeros((len(sets), len(marks)))
    for i in range(0, len(every), 4096):
        a, b = np.searchsorted(window, [i, i + 4096])
        np.add.at(out, text[a:b], _summed(every[i : i + 4096], marks)[window[a:b] - i])
    return out


def _summed(windows: list[str], marks: list[str]) -> np.ndarray:
    """Kernel values of each window to the landmarks, summed over its parts."""
    parts = [parts_of(w) for w in windows]
    flat = sorted({p for ps in parts for p in ps})
    at = {p: i for i, p in enumerate(flat)}
    values = kernel(flat, marks).astype(float) ** POWER
    return np.stack([values[[at[p] for p in ps]].sum(0) for ps in parts])


def _cut(margin: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """The cut of the best F-measure, in the gap that gives it as near to the machine's own border as may be, and that
    measure."""
    order = np.argsort(-margin, kind="stable")
    hit = np.cumsum(labels[order])
    f = 2 * hit / (np.arange(1, len(order) + 1) + labels.sum())
    k = int(np.argmax(np.round(f, 9)))
    above = margin[order[k]]
    below = margin[order[k + 1]] if k + 1 < len(order) else above - 1
    edge = (above - below) / 10
    return float(np.clip(0.0, below + edge, above - edge)), float(f[k])


def fold(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def training_rows(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> DataFrame:
    """(text, toxic) of the bounded training sample; ids are chosen from the labels alone, then their texts fetched."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(fold() != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    by_hash = known.withColumn("h", F.xxhash64("doc_id"))
    chosen = by_hash.where("toxic = 1").orderBy("h", "doc_id").limit(max_toxic).unionByName(by_hash.where("toxic = 0").orderBy("h", "doc_id").limit(max_clean))
    texts = docs.select("doc_id", "text").where(F.length("text") <= MAX_CHARS)
    return texts.join(F.broadcast(chosen), "doc_id").select("text", "toxic")


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of all rows (text, toxic) of a task, pickled; the order of rows does not matter."""
    rows = [row for b in batches for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    yield batch_of(["model"], [pa.array([pickle.dumps(train(sorted(rows)))], pa.binary())])


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Model:
    """A model of the training sample, whose bound lets one task of an executor train it; only the model comes to the driver."""
    rows = training_rows(docs, labels, max_toxic, max_clean).repartition(1)
    made = rows.mapInArrow(_trained, "model binary").collect()
    return pickle.loads(made[0][0]) if made else train([])


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, score and predicted of every whole text."""
    names = [*keep, "score", "predicted"]

    def make():
        known: dict[str, float] = {}  # token -> what its window adds
        pieces: set[str] = set()  # raw tokens that are pieces of landmarks

        def learn(tokens: Iterable[str]) -> None:
            fresh = {t: window_of(t) for t in tokens}
            distinct = sorted(set(fresh.values()))
            values = dict(zip(distinct, model.values(distinct).tolist()))
            known.update((t, values[w]) for t, w in fresh.items())
            pieces.update(t for t, w in fresh.items() if w[1:] in model.pieces)

        def fn(b: pa.RecordBatch) -> pa.RecordBatch:
            if len(known) > CAP:
                known.clear()
            tokens = [t.lower().split() for t in texts_of(b)]
            distinct = [set(t) for t in tokens]
            learn(set().union(*distinct).difference(known))
            joined = [joined_pieces(t, pieces) for t in tokens]
            learn(set().union(*joined).difference(known))
            margins = [model.margin(sum(map(known.__getitem__, t)) + sum(map(known.__getitem__, j - t)), len(t)) for t, j in zip(distinct, joined)]
            scores = [model.score(m) for m in margins]
            return batch_of(names, [*(col_of(b, c) for c in keep), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())])

        return fn

    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "score double", "predicted int"])
    return arrow_map(docs.select(*dict.fromkeys([*keep, "text"])), make, schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = score(spread(docs), model)
    return scored.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", "predicted")
