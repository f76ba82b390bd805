"""Token counts under a unigram model, by dynamic programming over a trie of pre-tokens.

The best segmentation of a prefix depends on the prefix alone, so pre-tokens that begin alike share its score. Each task
inserts the distinct pre-tokens it meets in a trie: a node holds the forward score of its prefix, found once from the scores
on its path, and the number of tokens of the best segmentation; a pre-token's count is read off its last node. Nothing is
shuffled: a frequent pre-token is worked out once a worker, all others once where they occur.

Pieces are the byte strings of a public vocabulary; a piece of rank r scores -log(r + 1) - log(H), the log probability under
Zipf's law, H being the sum of 1 / (r + 1). Every single byte is a piece, so each text has a segmentation.
"""

from __future__ import annotations

import base64
import math
from collections import deque
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from corpusloom.llm import support

#: Nodes and pre-tokens a worker keeps; beyond it starts a new trie, which changes no count.
NODES, KEPT = 500_000, 300_000
#: Characters of a pre-token that gets no nodes: its scores are kept as far back as the longest piece reaches.
LONG = 4096

_tries: dict[str, Trie] = {}


def default_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def load_scores(path: str) -> dict[bytes, float]:
    """Pieces and their scores from a file of base64 pieces and ranks."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in lines if line.strip())}
    whole = math.log(math.fsum(1 / (rank + 1) for rank in ranks.values()))
    return {piece: -math.log(rank + 1) - whole for piece, rank in ranks.items()}


class Trie:
    """Forward scores and token counts of all prefixes seen. Ties go to fewer tokens, then to the longer last piece."""

    def __init__(self, scores: dict[bytes, float]) -> None:
        self.scores = scores
        self.longest = max(map(len, scores))
        # Suffixes of a prefix that no piece ends with need not be lengthened any further.
        self.endings = {piece[-n:] for piece in scores for n in range(1, len(piece) + 1)}
        self.clear()

    def clear(self) -> None:
        self.children: dict[int, int] = {}  # 256 * node + byte
        self.best, self.count = [0.0], [0]

    def insert(self, word: bytes) -> int:
        """Number of tokens of ``word``; scores the nodes that are new."""
        path, node, children = [0], 0, self.children
        for depth, byte in enumerate(word, 1):
            following = children.get(256 * node + byte)
            if following is None:
                following = children[256 * node + byte] = self._add(word, depth, path)
            node = following
            path.append(node)
        return self.count[node]

    def forward(self, word: bytes) -> int:
        """Number of tokens of a word that is too long to be kept: its scores, as far back as the longest piece reaches."""
        scores, endings, size = self.scores, self.endings, self.longest
        best, count = deque([0.0], size), deque([0], size)
        for depth in range(1, len(word) + 1):
            top, fewest = -math.inf, 0
            for n in range(1, min(depth, size) + 1):
                piece = word[depth - n : depth]
                if piece not in endings:
                    break
                score = scores.get(piece)
                if score is not None:
                    total, tokens = best[-n] + score, count[-n] + 1
                    if total > top or total == top and tokens <= fewest:
                        top, fewest = total, tokens
            best.append(top)
            count.append(fewest)
        return count[-1]

    def _add(self, word: bytes, depth: int, path: list[int]) -> int:
        scores, endings = self.scores, self.endings
        top, fewest = -math.inf, 0
        for start in range(depth - 1, max(-1, depth - 1 - self.longest), -1):
            piece = word[start:depth]
            if piece not in endings:
                break
            score = scores.get(piece)
            if score is not None:
                before = path[start]
                total, tokens = self.best[before] + score, self.count[before] + 1
                if total > top or total == top and tokens <= fewest:
                    top, fewest = total, tokens
        self.best.append(top)
        self.count.append(fewest)
        return len(self.best) - 1


class Counter(dict):
    """Terminal counts of the pre-tokens met so far, as a table from pre-token to count."""

    def __init__(self, path: str) -> None:
        self.trie = Trie(load_scores(path))
        self.pattern = regex.compile(public_tokenizers.PATTERN)

    def __missing__(self, word: str) -> int:
        if len(word) > LONG:
            return self.trie.forward(word.encode())
        if len(self) >= KEPT:
            self.clear()
        if len(self.trie.best) >= NODES:
            self.trie.clear()
        count = self[word] = self.trie.insert(word.encode())
        return count

    def measure(self, text: str) -> tuple[int, int]:
        words = self.pattern.findall(text)
        return len(words), sum(map(self.__getitem__, words))


def _counter(path: str) -> Counter:
    if path not in _tries:
        _tries[path] = Counter(path)
    return _tries[path]


def count_tokens(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id``, ``n_pretokens`` and ``n_tokens`` of every whole text.

    Null and empty texts have none. Rows are counted one by one, so repeated ids and texts keep their rows.
    """
    path = vocabulary or default_path()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in batches:
            found = np.array([counter.measure(text.as_py()) for text in batch.column("text")], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found[:, 0]), pa.array(found[:, 1])], ["doc_id", "n_pretokens", "n_tokens"])

    return support.whole_texts(docs).mapInArrow(counted, "doc_id long, n_pretokens long, n_tokens long")
