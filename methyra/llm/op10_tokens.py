"""Token counts of texts of any length by overlap resynchronisation.

A huge text is cut into chunks that overlap. Each chunk is cut into pieces by the vocabulary's pattern, with
offsets. The pattern reads from left to right and looks ahead one character at most, so two chunks that have one
piece boundary in common agree on every later boundary until the first chunk's end comes into view. Such a common
boundary, at least one whole piece before that end and after a character that is not white space, is a proven place
to splice; if an overlap has none, it is doubled until one is found or the text ends. After white space the span would
end where the pattern looks ahead, and its last pieces could run together; all other pieces are the same without what
follows them. No merge crosses a piece boundary, so the spliced counts are exact.

Pieces are encoded by a byte-pair encoder fed with the vocabulary file (``tokenizers`` and it give the same ids;
the tests hold them against each other). Special strings inside texts count as one token each, which is the
library's default.

Nulls and empty texts have no tokens. Rows are handled one by one: repeated rows, ties, null ids and extra
columns (which are dropped) change nothing.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, batch_of, col_of, spread, table, texts_of
from .op7_bpe import PIECES, _byte_alphabet, default_vocabulary

#: Characters of a chunk, and of the first overlap tried.
CHUNK, OVERLAP = 32_768, 512
_LOADED: dict[str, "Counter"] = {}


class Counter:
    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        import regex
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = _byte_alphabet()
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(back[c] for c in tok): i for tok, i in spec["model"]["vocab"].items() if tok not in special}
        self._encode = tiktoken.Encoding("vocabulary", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._pieces = regex.compile(PIECES)
        self._special = sorted(special)
        self._split = regex.compile("(" + "|".join(map(regex.escape, self._special)) + ")") if special else None
        self.chunk, self.overlap = chunk, overlap

    def count(self, text: str) -> int:
        if not text:
            return 0
        if self._split is None or not any(s in text for s in self._special):
            return self._count_plain(text)
        return sum(1 if i % 2 else self._count_plain(s) for i, s in enumerate(self._split.split(text)))

    def _count_plain(self, text: str) -> int:
        if len(text) <= self.chunk + self.overlap:
            return len(self._encode(text))
        return sum(len(self._encode(text[a:b])) for a, b in self.splices(text))

    def _ends(self, text: str, start: int, stop: int) -> list[int]:
        """Ends of the pieces of text[start:stop] read from start."""
        return [start + m.end() for m in self._pieces.finditer(text[start:stop])]

    def splices(self, text: str) -> list[tuple[int, int]]:
        """Spans between proven boundaries; together they are the text."""
        out, start, n = [], 0, len(text)
        while start < n:
            overlap = self.overlap
            while True:
                nominal = start + self.chunk
                stop = nominal + overlap
                if stop >= n:
                    out.append((start, n))
                    return out
                ours = self._ends(text, start, stop)[:-2]  # the last pieces may change when more text follows
                theirs = set(self._ends(text, nominal, min(n, stop + overlap))[:-2])
                common = next((p for p in ours if p > nominal and not text[p - 1].isspace() and p in theirs), None)
                if common is not None:
                    break
                overlap *= 2
            out.append((start, common))
            start = common
        return out


def load(path: str) -> Counter:
    if path not in _LOADED:
        _LOADED[path] = Counter(path)
    return _LOADED[path]


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether the tokens exceed ``limit``."""
    names = ["doc_id", "n_bytes", "n_tokens"]

    def make():
        counter = load(vocabulary)

        def fn(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = texts_of(b)
            return batch_of(names, [col_of(b, "doc_id"), pa.array([len(t.encode("utf-8")) for t in texts], pa.int64()), pa.array([counter.count(t) for t in texts], pa.int64())])

        return fn

    counted = arrow_map(docs.select("doc_id", "text"), make, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(spread(docs), default_vocabulary())
