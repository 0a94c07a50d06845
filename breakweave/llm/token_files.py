"""Token-ID files: flat unsigned integers plus 64-bit document offsets, memory-mapped.

Documents are dealt to ranges of doc_id that Spark samples. A task encodes its range in doc_id order and writes parts of
bounded size, three files each: `ids` (the narrowest unsigned type that holds the vocabulary), `offsets` (unsigned 64-bit, within the
part) and `docs` (doc_id, signed 64-bit). Prefix sums of the parts' sizes, in two steps, are the base of each part.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from breakweave.llm.common import bounded_batches, materialise, read_only, shared_dir, write_whole
from breakweave.llm.token_count import byte_letters

#: Words whose ids a Python worker remembers at most before it starts afresh.
MEMO_WORDS = 1_500_000
MEMO_LENGTH = 200
#: Words that are encoded in one call.
TOGETHER = 8192
#: Plain words that are encoded as one text.
ROW = 1000
#: Marks that may follow a word; a run of them is one piece of the pattern.
MARKS = ".,!%*&$#|:;?"
#: Input bytes that one range takes, about; a part is closed at twice as many, which bounds what a task holds.
PART_BYTES = 24 << 20
#: A part's number is that of its range, shifted by these bits, plus its place in the range.
SEQUENCE_BITS = 20
#: Prefix sums run within blocks of as many ranges (as a power of two), then over blocks.
BLOCK_BITS = 10
#: Tasks that read parts back at most.
MOST_READERS = 100_000
#: doc_id stored for a row whose doc_id is null.
NO_ID = -(1 << 63)


class Encoder:
    """Ids of texts by the tokenizers library, word by word.

    The vocabulary's normaliser and pattern drop white space and never look across it, so a text's ids are those
    of its words in turn. Within a word, a run of letters and the marks after it are pieces of their own. Words of
    letters alone are lower-cased here and go straight to the library's model, which gives the same ids as the
    whole chain; all other words take the whole chain.
    """

    def __init__(self, vocabulary: str, kind: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.library = Tokenizer.from_file(vocabulary)
        self.model = Tokenizer(self.library.model)
        self.model.pre_tokenizer = WhitespaceSplit()
        end = self.library.model.end_of_word_suffix
        self.last = np.zeros(self.library.get_vocab_size(), bool)
        if end:
            self.last[[n for token, n in self.library.get_vocab().items() if token.endswith(end)]] = True
        self.marks_ends = bool(end)
        self.letters = byte_letters()
        self.kind = kind
        self.memo: dict[str, bytes] = {"": b""}

    def plain(self, word: str) -> str | None:
        """The normal form of a word of letters; None if the word needs the whole chain."""
        if not self.marks_ends or not word.isalpha():
            return None
        if word.isascii():
            return word.lower()
        if not is_normalized("NFC", word):
            return None
        low = "".join([c.lower() for c in word])
        return low if low.isalpha() and is_normalized("NFC", low) else None

    def enter(self, words: list[str]) -> None:
        """Words that need the whole chain."""
        for at in range(0, len(words), TOGETHER):
            part = words[at : at + TOGETHER]
            for word, got in zip(part, self.library.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.memo[word] = np.array(got.ids, self.kind).tobytes()

    def enter_plain(self, words: list[str]) -> None:
        """Words in normal form, many in one text: the ids that end a word tell them apart."""
        width = np.dtype(self.kind).itemsize
        spelt = [w if w.isascii() else "".join([self.letters[b] for b in w.encode()]) for w in words]
        texts = [" ".join(spelt[at : at + ROW]) for at in range(0, len(words), ROW)]
        for k, got in enumerate(self.model.encode_batch_fast(texts, add_special_tokens=False)):
            part, ids = words[k * ROW : (k + 1) * ROW], np.array(got.ids, self.kind)
            cuts = ((np.flatnonzero(self.last[ids]) + 1) * width).tolist()
            if len(cuts) != len(part):
                raise ValueError("the vocabulary does not mark the ends of words")
            blob = ids.tobytes()
            self.memo.update(zip(part, [blob[a:b] for a, b in zip([0, *cuts], cuts, strict=False)], strict=True))

    def learn(self, words: set[str]) -> None:
        """Enter the ids of words that are not yet known."""
        memo, alias, letters, others = self.memo, [], set(), set()
        for word in words:
            stem = word.rstrip(MARKS)
            base = self.plain(stem)
            if base is None:
                others.add(word)
                continue
            if base != word:
                marks = word[len(stem) :]
                alias.append((word, base, marks))
                if marks not in memo:
                    others.add(marks)
            if base not in memo:
                letters.add(base)
        self.enter_plain(list(letters))
        self.enter(list(others))
        for word, base, marks in alias:
            memo[word] = memo[base] + memo[marks]

    def ids(self, texts: list[str | None], end: int) -> list[bytes]:
        """The little-endian ids of each text, with the end id."""
        if len(self.memo) > MEMO_WORDS:
            self.memo = {"": b""}
        split = [(text or "").replace("\n", " ").split(" ") for text in texts]
        fresh = {word for words in split for word in words}
        fresh = fresh.difference(self.memo)  # looks up the few, does not walk the many
        long = {word for word in fresh if len(word) > MEMO_LENGTH}
        self.learn(fresh - long)
        extra = {word: np.array(self.library.encode(word, add_special_tokens=False).ids, self.kind).tobytes() for word in long}
        memo, tail = self.memo, np.array([end], self.kind).tobytes()
        if extra:
            return [b"".join([memo[w] if w in memo else extra[w] for w in words]) + tail for words in split]
        get = memo.__getitem__
        return [b"".join(map(get, words)) + tail for words in split]


@lru_cache(1)
def encoder(vocabulary: str, kind: str) -> Encoder:
    """The worker's encoder, which keeps its words from task to task."""
    return Encoder(vocabulary, kind)


def id_type(vocabulary: str, end: int) -> str:
    """The narrowest of the unsigned types that holds every id."""
    from tokenizers import Tokenizer

    return "<u2" if max(Tokenizer.from_file(vocabulary).get_vocab_size() - 1, end) < 1 << 16 else "<u4"


def dealt_by_id(docs: DataFrame, ranges: int) -> DataFrame:
    """Rows in ranges that rise with doc_id, null first, sorted within.

    Spark samples the ranges. A number a row breaks ties, so that rows of one id, of equal text even, can part; their
    order is free.
    """
    order = [F.col("doc_id").asc_nulls_first(), F.col("_tie").asc()]
    tied = docs.withColumn("_tie", F.monotonically_increasing_id())
    dealt = tied.repartitionByRange(ranges, *order) if ranges > 1 else tied.repartition(1)
    return dealt.sortWithinPartitions(*order).drop("_tie")


def with_bases(made: DataFrame) -> DataFrame:
    """Adds base_docs and base: documents and ids in the parts before, by sums within blocks of parts and over blocks.

    No task sees more than a block's parts or the blocks' sums.
    """
    rows = made.withColumn("_block", F.shiftright("part", SEQUENCE_BITS + BLOCK_BITS))
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    whole = Window.orderBy("_block")
    blocks = rows.groupBy("_block").agg(F.sum("n_docs").alias("_docs"), F.sum("n_tokens").alias("_tokens"))
    blocks = blocks.select("_block", before("_docs", whole).alias("_docs"), before("_tokens", whole).alias("_tokens"))
    inside = Window.partitionBy("_block").orderBy("part")
    placed = rows.withColumns({"base_docs": before("n_docs", inside), "base": before("n_tokens", inside)}).join(blocks, "_block")
    return placed.select("part", (F.col("base_docs") + F.col("_docs")).alias("base_docs"), (F.col("base") + F.col("_tokens")).alias("base"), "n_docs", "n_tokens")


def write_token_files(docs: DataFrame, vocabulary: str, folder: str, end: int = 2, parts: int | None = None) -> DataFrame:
    """Write the files below `folder`; returns one row a part: part, base_docs, base, n_docs, n_tokens, kind.

    Rows are dealt to about `parts` ranges of ids; a range writes a new part whenever its texts pass twice PART_BYTES, so that
    a task holds no more than that, however ids and lengths are spread. Part numbers rise with doc_id. Null texts count as empty (the end id alone), rows without a doc_id come first, repeated rows are each
    written, other columns are not read. No documents: no files and no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    kind, part_bytes = id_type(vocabulary, end), PART_BYTES
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    if parts is None:
        size = rows.select(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
        parts = max(1, -(-size // PART_BYTES))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held = encoder(vocabulary, kind), []
        part, size = TaskContext.get().partitionId() << SEQUENCE_BITS, 0

        def close() -> pa.RecordBatch:
            ids = [x for _, blob in held for x in blob]
            sizes = np.array([len(x) for x in ids], np.uint64) // np.dtype(kind).itemsize
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype("<u8")
            keys = np.concatenate([k for k, _ in held]).astype("<i8")
            for name, data in (("ids", ids), ("offsets", [offsets.tobytes()]), ("docs", [keys.tobytes()])):
                write_whole(folder, f"{name}-{part:012d}.bin", data)
            one = {"part": [part], "n_docs": [len(keys)], "n_tokens": [int(offsets[-1])]}
            return pa.record_batch({k: pa.array(v, pa.int64()) for k, v in one.items()})

        for batch in batches:
            keys = batch.column("doc_id").fill_null(NO_ID).to_numpy()
            held.append((keys, known.ids(batch.column("text").to_pylist(), end)))
            size += batch.nbytes
            if size >= 2 * part_bytes:
                yield close()
                part, held, size = part + 1, [], 0
        if held:
            yield close()

    made = materialise(dealt_by_id(rows, parts).mapInArrow(encode, "part long, n_docs long, n_tokens long"), spark, "token-parts")
    return with_bases(made).withColumn("kind", F.lit(kind))


def read_token_files(listed: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the memory-mapped files; null ids stay null, no parts give no rows."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                names = [f"{folder}/{name}-{row['part']:012d}.bin" for name in ("ids", "offsets", "docs")]
                with read_only(names[0]) as a, read_only(names[1]) as b, read_only(names[2]) as c:
                    ids = np.frombuffer(a.read_buffer(), row["kind"])
                    offsets, keys = np.frombuffer(b.read_buffer(), "<u8").astype(np.int64), np.frombuffer(c.read_buffer(), "<i8")
                    crc = [zlib.crc32(ids[s:e].astype("<u4").tobytes()) for s, e in zip(offsets, offsets[1:], strict=False)]
                    yield pa.record_batch(
                        {
                            "doc_id": pa.array(keys, pa.int64(), mask=keys == NO_ID),
                            "start": pa.array(offsets[:-1] + row["base"], pa.int64()),
                            "n_tokens": pa.array(np.diff(offsets), pa.int64()),
                            "ids_crc32": pa.array(crc, pa.int64()),
                        }
                    )

    n = max(1, listed.count())
    dealt = listed.repartition(min(n, MOST_READERS), "part")
    return dealt.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, spark: SparkSession, vocabulary: str, end: int = 2, parts: int | None = None) -> DataFrame:
    """Write the files in the shared folder and return what they hold, a row a document.

    Null and empty texts have the end id alone; null ids come first; rows that repeat an id follow each other in any
    order; other columns are not read; an empty table gives no rows.
    """
    folder = shared_dir(spark, "token-files")
    return read_token_files(write_token_files(docs, vocabulary, folder, end, parts), folder)
