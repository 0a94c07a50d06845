"""Token counts by byte-pair merging with a heap and a linked list; no identifiers are emitted.

A text is cut at the vocabulary's special strings (one token each), then into pieces by the byte-level
pattern. Each piece starts as one symbol a byte. The adjacent pair of the lowest rank is merged again and
again (the leftmost first among equal ranks), and the count is the number of bytes minus the merges made.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breakweave.llm.common import bounded_batches

#: The byte-level pattern of the public vocabulary files.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words whose counts a Python worker remembers at most before it starts afresh.
MEMO_WORDS = 500_000
#: Longer words are counted but not remembered.
MEMO_LENGTH = 200


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class PairMerger:
    """Counts tokens of texts with the merges of a byte-level vocabulary file."""

    def __init__(self, vocabulary: str) -> None:
        with open(vocabulary, encoding="utf-8") as file:
            spec = json.load(file)
        ids = spec["model"]["vocab"]
        self.first = [ids[letter] for letter in byte_letters()]
        self.pair: dict[int, int] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.pair.setdefault(ids[left] << 20 | ids[right], rank << 20 | ids[left + right])
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pieces = regex.compile(PIECES)
        self.lone_space = regex.compile(r"(?<=\S) (?=\S)")
        self.double_space = regex.compile(r"\s\s")
        self.memo: dict[str, int] = {}

    def merged(self, data: bytes) -> int:
        """How many symbols are left of one piece."""
        symbols = [self.first[b] for b in data]
        n = len(symbols)
        if n < 2:
            return n
        pair = self.pair
        heap = []
        left = symbols[0]
        for at in range(1, n):
            right = symbols[at]
            if (found := pair.get(left << 20 | right)) is not None:
                heap.append(found << 40 | at - 1)
            left = right
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        left_over = n
        while heap:
            top = heapq.heappop(heap)
            at, found = top & (1 << 40) - 1, top >> 40
            follows = after[at]
            if symbols[at] < 0 or follows >= n or pair.get(symbols[at] << 20 | symbols[follows]) != found:
                continue  # one side was merged away meanwhile
            made = symbols[at] = found & (1 << 20) - 1
            symbols[follows] = -1
            then = after[at] = after[follows]
            left_over -= 1
            if then < n:
                before[then] = at
                if (new := pair.get(made << 20 | symbols[then])) is not None:
                    heapq.heappush(heap, new << 40 | at)
            ahead = before[at]
            if ahead >= 0 and (new := pair.get(symbols[ahead] << 20 | made)) is not None:
                heapq.heappush(heap, new << 40 | ahead)
        return left_over

    def of_words(self, text: str) -> int:
        """Count by the pattern, whatever the spaces are."""
        total = 0
        for piece in self.pieces.findall(text):
            count = self.memo.get(piece)
            if count is None:
                count = self.merged(piece.encode())
                if len(piece) <= MEMO_LENGTH:
                    self.memo[piece] = count
            total += count
        return total

    def plain(self, text: str) -> int:
        """Count a text without special strings.

        A single space between two other characters always starts a new piece, so the text is cut there and
        counts add up over the words.
        """
        memo = self.memo
        words = self.lone_space.split(text) if self.double_space.search(text) else text.split(" ")
        if len(memo) > MEMO_WORDS:
            memo.clear()
        total = self.of_words(words[0])
        for word in words[1:]:
            word = " " + word
            count = memo.get(word)
            if count is None:
                count = self.of_words(word)
                if len(word) <= MEMO_LENGTH:
                    memo[word] = count
            total += count
        return total

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None:
            return self.plain(text)
        if not self.special.search(text):
            return self.plain(text)
        plain = self.special.split(text)
        return len(plain) - 1 + sum(self.plain(part) for part in plain if part)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every document.

    Null and empty texts have no bytes and no tokens. Rows with the same or a null doc_id are counted row by
    row, an empty table gives an empty result, other columns are not read. One map over the input, no shuffle.
    """
    bounded_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = PairMerger(vocabulary)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            tokens = [merger.count(text) for text in texts]
            sizes = [len(text.encode()) if text else 0 for text in texts]
            yield pa.record_batch(
                {"doc_id": batch.column("doc_id"), "n_bytes": pa.array(sizes, pa.int64()), "n_tokens": pa.array(tokens, pa.int64())}
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    counted = rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
