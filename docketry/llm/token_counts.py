"""Token counts by a linear longest-match automaton.

The vocabulary is a trie. A failure link leads from a node to where matching goes
on after the longest pieces were popped off its string, and the number of those
pieces is kept with it, so a word is read once, byte by byte, and its count is a
sum: no piece is built. A word is matched with a space before it, as pieces that
begin words have one in the vocabulary file.

Counts of words are kept in each worker, up to a bound. Defined results: words
are runs without ASCII white space; null text counts as empty (0 tokens); a word
that the vocabulary cannot spell counts as one unknown token.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import common

KEEP = 200_000


class PieceCounter:
    """Numbers of greedy longest-match pieces of words."""

    def __init__(self, vocabulary: list[bytes]):
        self.children: list[dict[int, int]] = [{}]
        final = [False]
        for piece in vocabulary:
            at = 0
            for byte in piece:
                step = self.children[at].get(byte)
                if step is None:
                    step = self.children[at][byte] = len(self.children)
                    self.children.append({})
                    final.append(False)
                at = step
            final[at] = True
        self.fail, self.popped = [-1] * len(final), [0] * len(final)
        level = [0]
        while level:
            below = []
            for node in level:
                for byte, child in self.children[node].items():
                    below.append(child)
                    if final[child]:
                        self.fail[child], self.popped[child] = 0, 1
                        continue
                    at, count = self.fail[node], self.popped[node]
                    while at >= 0 and byte not in self.children[at]:
                        count += self.popped[at]
                        at = self.fail[at]
                    if at >= 0:
                        self.fail[child], self.popped[child] = self.children[at][byte], count
            level = below

    def count(self, word: bytes) -> int:
        children, fail, popped = self.children, self.fail, self.popped
        at, count = 0, 0
        for byte in word:
            step = children[at].get(byte)
            while step is None:
                count += popped[at]
                at = fail[at]
                if at < 0:
                    return 1
                step = children[at].get(byte)
            at = step
        while at > 0:
            count += popped[at]
            at = fail[at]
        return count if at == 0 else 1


_COUNTERS: dict[str, tuple[PieceCounter, dict[bytes, int]]] = {}


def counter_at(path: str) -> tuple[PieceCounter, dict[bytes, int]]:
    """The automaton and the kept counts of this worker process."""
    if path not in _COUNTERS:
        with open(path, "rb") as lines:
            _COUNTERS[path] = PieceCounter([base64.b64decode(x.split()[0]) for x in lines if x.strip()]), {}
    return _COUNTERS[path]


def token_counts(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text: str = "text", keep: int = KEEP) -> DataFrame:
    """(doc_id, n_words, n_tokens) of each whole text."""
    name = common.shipped(docs.sparkSession, vocabulary or common.tokenizer_file("byte_bpe_50k.tiktoken"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, known = counter_at(common.received(name))
        hasher = common.WordHasher(seed=10)
        for batch in batches:
            for part in common.slices(batch, "text"):
                data, offsets = common.text_buffer(part.column("text"))
                starts, ends, first = common.word_spans(data, offsets)
                _, places, number = np.unique(hasher.words(data, starts, ends), return_index=True, return_inverse=True)
                raw = data.tobytes()
                counts = np.empty(len(places), np.int64)
                for i, (a, b) in enumerate(zip(starts[places].tolist(), ends[places].tolist(), strict=True)):
                    word = raw[a:b]
                    found = known.get(word)
                    if found is None:
                        found = counter.count(b" " + word)
                        if len(known) < keep and len(word) <= 64:
                            known[word] = found
                    counts[i] = found
                total = np.r_[0, np.cumsum(counts[number])][first] if len(places) else np.zeros(len(first), np.int64)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.diff(first).astype(np.int64)), pa.array(np.diff(total).astype(np.int64))], ["doc_id", "n_words", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_words bigint, n_tokens bigint")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(common.load(spark, sf_dir, "documents"))
