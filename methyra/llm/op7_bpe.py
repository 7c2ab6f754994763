"""Byte-pair encoding and decoding by per-prefix dynamic programming.

For a piece of text, the encoding of every prefix ends in one unique last token. An automaton of the vocabulary (its
states are the prefixes of tokens, its failure links lead to the longest proper suffix that is a state) is walked over
the piece once; at every place it gives all tokens that are suffixes of the prefix, the longest first. The first whose
predecessor (the last token of the remaining prefix) is *compatible* with it is stored in the table. Two tokens are
compatible if merging the bytes of both by rank would give exactly these two again, which is decided by un-merging
along the seam. Following the stored back-pointers from the end gives the ids that merging by rank gives. Pieces of any
length go this way.

Nulls count as empty texts (no ids). Repeated rows and extra columns do no harm: each row is handled by itself
and only ``doc_id`` is carried, with any value or null. Pieces are remembered up to a fixed number per worker.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_map, batch_of, col_of, spread, table, texts_of

#: Fixed value: the pattern by which byte-level vocabularies of this kind cut texts into pieces.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries that a worker remembers; the tables are emptied beyond.
PIECE_CAP, PAIR_CAP = 400_000, 600_000
_LOADED: dict[str, "PrefixBpe"] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte: visible Latin-1 ones for themselves, others from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixBpe:
    """Encoder and decoder of one vocabulary file. ``load`` keeps one per worker process."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = _byte_alphabet()
        model = spec["model"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids: dict[bytes, int] = {}
        self.bytes: dict[int, bytes] = {i: s.encode() for s, i in self.special.items()}
        for tok, i in model["vocab"].items():
            if tok not in self.special:
                b = bytes(back[c] for c in tok)
                self.ids[b] = i
                self.bytes[i] = b
        #: (left, right) -> (rank, merged); each merged token keeps the pair that makes it.
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            a, b = (bytes(back[c] for c in x) for x in (a, b))
            pair, made = (self.ids[a], self.ids[b]), self.ids[a + b]
            self.merge.setdefault(pair, (rank, made))
            self.parts.setdefault(made, pair)
        self.rank = {made: self.merge[pair][0] for made, pair in self.parts.items()}
        self._pieces = regex.compile(PIECES)
        self._split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self._fits: dict[tuple[int, int], bool] = {}
        self._cache = _Pieces(self.piece_ids)
        every = [self.bytes.get(i, b"") for i in range(max(self.bytes) + 1)]
        self._table = np.frombuffer(b"".join(every), np.uint8)
        self._sizes = np.array([len(x) for x in every], np.int64)
        self._starts = np.cumsum(self._sizes) - self._sizes
        #: All tokens by their bytes as Latin-1 text, with their sizes.
        self._walk = ahocorasick.Automaton()
        for b, i in self.ids.items():
            self._walk.add_word(b.decode("latin-1"), (i, len(b)))
        self._walk.make_automaton()
        self._made: dict[int, bool] = {}

    # -- pair compatibility -------------------------------------------------------------------------------

    def fits(self, left: int, right: int) -> bool:
        """Would the bytes of ``left`` and ``right`` together be merged into exactly these two tokens?"""
        known = self._fits.get((left, right))
        if known is None:
            known = self._seam_holds(left, right)
            if len(self._fits) > PAIR_CAP:
                self._fits.clear()
            self._fits[left, right] = known
        return known

    def _seam_holds(self, left: int, right: int) -> bool:
        # Undo both tokens' merges from the latest rank on. At each point the two tokens beside the seam
        # must not have a merge that comes before the merges still to be applied on either side.
        limit = 1 << 62
        while True:
            found = self.merge.get((left, right))
            if found is not None and found[0] < limit:
                return False
            ra, rb = self.rank.get(left, -1), self.rank.get(right, -1)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                # left is the later merge; before it, its right part touched the seam
                limit, left = ra, self.parts[left][1]
            else:
                # a seam merge of the same rank stands further left and so would come first
                limit, right = rb + 1, self.parts[right][0]

    # -- per-prefix table ---------------------------------------------------------------------------------

    def piece_ids(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        n, pairs = len(piece), self._fits
        last: list[tuple[int, int] | None] = [None] * (n + 1)
        for at, found in self._walk.iter(piece.decode("latin-1")):
            if last[at + 1] is None:
                left = last[at + 1 - found[1]]
                if left is None:
                    good = found[1] == at + 1  # the token is the whole prefix
                elif (good := pairs.get((left[0], found[0]))) is None:
                    good = self.fits(left[0], found[0])
                if good and self._whole(found[0]):
                    last[at + 1] = found
        out, at = [], n
        while at > 0:
            tok, size = last[at]
            out.append(tok)
            at -= size
        return out[::-1]

    def _whole(self, tok: int) -> bool:
        """Does merging the token's own bytes by rank give the token?"""
        known = self._made.get(tok)
        if known is None:
            known = self._made[tok] = self._by_rank(self.bytes[tok]) == [tok]
        return known

    def _by_rank(self, piece: bytes) -> list[int]:
        """Plain merging by rank: for checking single tokens, and for tests."""
        out = [self.ids[bytes([b])] for b in piece]
        while len(out) > 1:
            best = min(range(len(out) - 1), key=lambda i: self.merge.get((out[i], out[i + 1]), (1 << 62, 0))[0])
            found = self.merge.get((out[best], out[best + 1]))
            if found is None:
                break
            out[best : best + 2] = [found[1]]
        return out

    # -- texts --------------------------------------------------------------------------------------------

    def sections(self, text: str) -> list[str]:
        """The text cut at special strings, which stay as sections of their own (odd places)."""
        if self._split is None or not any(s in text for s in self.special):
            return [text]
        return self._split.split(text)

    def encode_text(self, text: str) -> str:
        """Decimal ids joined by commas."""
        return ",".join(filter(None, (self._section(s) for s in self.sections(text))))

    def _section(self, s: str) -> str:
        if s in self.special:
            return str(self.special[s])
        if len(self._cache) > PIECE_CAP:
            self._cache.clear()
        return ",".join(map(self._cache.__getitem__, self._pieces.findall(s)))

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """Bytes of ids, special ones included: one gather from the table of all tokens' bytes."""
        if not len(ids):
            return b""
        sizes = self._sizes[ids]
        ends = np.cumsum(sizes)
        at = np.repeat(self._starts[ids] - (ends - sizes), sizes)
        at += np.arange(ends[-1], dtype=at.dtype)
        return self._table[at].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; broken UTF-8 becomes replacement characters."""
        return self.decode_bytes(np.asarray(ids, dtype=np.int64)).decode("utf-8", "replace")


class _Pieces(dict):
    """Piece -> decimal ids joined by commas, encoded when first asked for."""

    def __init__(self, encode):
        self._encode = encode

    def __missing__(self, piece: str) -> str:
        found = self[piece] = ",".join(map(str, self._encode(piece.encode("utf-8"))))
        return found


def parsed(ids: str) -> np.ndarray:
    return np.fromstring(ids, dtype=np.int32, sep=",") if ids else np.empty(0, np.int32)


def load(path: str) -> PrefixBpe:
    if path not in _LOADED:
        _LOADED[path] = PrefixBpe(path)
    return _LOADED[path]


def encode(docs: DataFrame, vocabulary: str, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``ids`` (array of int) of each text."""
    names = [*keep, "ids"]

    def make():
        bpe = load(vocabulary)

        def fn(b: pa.RecordBatch) -> pa.RecordBatch:
            ids = [parsed(bpe.encode_text(t)) for t in texts_of(b)]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
            return batch_of(names, [*(col_of(b, c) for c in keep), pa.ListArray.from_arrays(offsets, flat)])

        return fn

    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "ids array<int>"])
    return arrow_map(docs.select(*dict.fromkeys([*keep, "text"])), make, schema)


def decode(encoded: DataFrame, vocabulary: str, keep: list[str]) -> DataFrame:
    """``keep`` columns and the ``text`` of each array ``ids``."""
    names = [*keep, "text"]

    def make():
        bpe = load(vocabulary)

        def fn(b: pa.RecordBatch) -> pa.RecordBatch:
            return batch_of(names, [*(col_of(b, c) for c in keep), pa.array([bpe.decode(x or []) for x in col_of(b, "ids").to_pylist()], pa.string())])

        return fn

    kinds = dict(encoded.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "text string"])
    return arrow_map(encoded.select(*dict.fromkeys([*keep, "ids"])), make, schema)


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Each text encoded and decoded in one pass; only digests leave the task."""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def make():
        bpe = load(vocabulary)
        sha = lambda x: hashlib.sha256(x).hexdigest()

        def fn(b: pa.RecordBatch) -> pa.RecordBatch:
            n, ids_sha, text_sha = [], [], []
            for t in texts_of(b):
                s = bpe.encode_text(t)
                ids = parsed(s)
                n.append(len(ids))
                ids_sha.append(sha(s.encode()))
                text_sha.append(sha(bpe.decode(ids).encode("utf-8")))
            return batch_of(names, [col_of(b, "doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())])

        return fn

    return arrow_map(docs.select("doc_id", "text"), make, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded_intact(docs: DataFrame, vocabulary: str, keep: list[str]) -> DataFrame:
    """``keep`` columns, ids, their number, and whether decoding them gives the text back."""
    names = [*keep, "ids", "n_tokens", "intact"]

    def make():
        bpe = load(vocabulary)

        def fn(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = texts_of(b)
            ids = [parsed(bpe.encode_text(t)) for t in texts]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
            return batch_of(names, [*(col_of(b, c) for c in keep), pa.ListArray.from_arrays(offsets, flat), pa.array([len(x) for x in ids], pa.int64()), pa.array([bpe.decode(x) == t for x, t in zip(ids, texts)])])

        return fn

    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "ids array<int>, n_tokens long, intact boolean"])
    return arrow_map(docs.select(*dict.fromkeys([*keep, "text"])), make, schema)


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return round_trip(spread(docs), default_vocabulary())
