"""Token counts with a unigram vocabulary, over a trie of pre-tokens.

The distinct pre-tokens of a task go into a trie. A node stands for a prefix and holds the best
score and the number of tokens of its best segmentation, worked out once from the nodes above it
and the vocabulary pieces that end there, so pre-tokens with a common prefix share that work.
Terminal nodes give the counts of whole pre-tokens.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from listweave.llm.common import bounded_batches, large_texts, lots, split_words

#: Bounds on what a task remembers; beyond either it starts anew.
MOST_NODES = 600_000
MOST_COUNTS = 400_000
#: Longer pre-tokens are segmented on their own and leave no nodes.
LONGEST_IN_TRIE = 256
TEXT_BYTES = 16 << 20


def zipf_vocabulary(path: str) -> dict[bytes, float]:
    """Pieces of a rank file with log probabilities by Zipf's law on the rank.

    Pieces with white space after their first byte are left out: no pre-token has any.
    """
    ranks: dict[bytes, int] = {}
    with open(path, "rb") as lines:
        for line in lines:
            piece, rank = line.split()
            ranks[base64.b64decode(piece)] = int(rank)
    total = math.log(sum(1 / (r + 1) for r in ranks.values()))
    return {
        piece: -math.log(rank + 1) - total
        for piece, rank in ranks.items()
        if len(piece) == 1 or not any(b in b" \t\n\x0b\x0c\r" for b in piece[1:])
    }


class Trie:
    """Prefixes of pre-tokens with the best score and token count of each."""

    def __init__(self, vocabulary: dict[bytes, float]) -> None:
        self.vocabulary = vocabulary
        self.longest = max(map(len, vocabulary))
        self.clear()

    def clear(self) -> None:
        self.children: dict[int, int] = {}
        self.scores = [0.0]
        self.counts = [0]

    def __len__(self) -> int:
        return len(self.scores)

    def _best(
        self, word: bytes, end: int, scores: list[float], counts: list[int]
    ) -> tuple[float, int]:
        """Best segmentation of the first ``end`` bytes; of equal scores, the fewest tokens."""
        best, fewest = -math.inf, 0
        for start in range(max(0, end - self.longest), end):
            piece = self.vocabulary.get(word[start:end])
            if piece is not None:
                score, count = scores[start] + piece, counts[start] + 1
                if score > best or (score == best and count < fewest):
                    best, fewest = score, count
        return best, fewest

    def segment(self, word: bytes) -> int:
        """Tokens of a word, without the trie."""
        scores, counts = [0.0], [0]
        for end in range(1, len(word) + 1):
            best, fewest = self._best(word, end, scores, counts)
            scores.append(best)
            counts.append(fewest)
        return counts[-1]

    def count(self, word: bytes) -> int:
        """Inserts a pre-token and returns its number of tokens."""
        if len(word) > LONGEST_IN_TRIE:
            return self.segment(word)
        node, path = 0, [0]
        scores: list[float] = []
        for end, byte in enumerate(word, 1):
            key = node << 8 | byte
            child = self.children.get(key)
            if child is None:
                if len(scores) < len(path):
                    scores = [self.scores[n] for n in path]
                    counts = [self.counts[n] for n in path]
                best, fewest = self._best(word, end, scores, counts)
                scores.append(best)
                counts.append(fewest)
                child = len(self.scores)
                self.children[key] = child
                self.scores.append(best)
                self.counts.append(fewest)
            node = child
            path.append(node)
        return self.counts[node]


def token_counts(docs: DataFrame, ranks_path: str) -> DataFrame:
    """``doc_id``, ``n_pretokens`` and ``n_tokens`` of every row of ``docs``.

    A pre-token is a run of signs other than x20 and x09-x0D with a space in front. Its tokens are
    the segmentation into pieces of the vocabulary with the highest sum of log probabilities
    (Zipf's law on the ranks in the file at ``ranks_path``, which is read on the executors); ties
    take the fewest tokens. Every byte is a piece, so any text can be segmented. Null and empty
    texts have no tokens. Repeated rows and null ids give a row each. Other columns are ignored
    whatever their names. There is no shuffle: a task remembers a bounded number of pre-tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = known = None
        for whole in batches:
            for batch in lots(whole, 1, TEXT_BYTES):
                if trie is None:
                    trie, known = Trie(zipf_vocabulary(ranks_path)), {}
                words, counts = split_words(large_texts(batch.column(1)))
                coded = words.dictionary_encode()
                tokens = []
                for word in coded.dictionary.cast(pa.large_binary()).to_pylist():
                    found = known.get(word)
                    if found is None:
                        if len(trie) > MOST_NODES or len(known) > MOST_COUNTS:
                            trie.clear()
                            known = {}
                        found = known[word] = trie.count(b" " + word)
                    tokens.append(found)
                each = np.array(tokens, np.int64)[coded.indices.to_numpy()] if tokens else []
                owner = np.repeat(np.arange(len(counts)), counts)
                sums = np.bincount(owner, each, minlength=len(counts)).astype(np.int64)
                yield pa.record_batch(
                    [batch.column(0), pa.array(counts.astype(np.int64)), pa.array(sums)],
                    names=["doc_id", "n_pretokens", "n_tokens"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return bounded_batches(docs).select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_pretokens bigint, n_tokens bigint"
    )
