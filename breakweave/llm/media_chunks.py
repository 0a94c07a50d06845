"""Media columns by content-defined chunking.

Every text becomes a payload (UTF-8, padded with bytes 255 to a positive multiple of 576) stored as a mono 8-bit
PCM WAV. A rolling gear hash cuts the stored bytes into chunks, chunks go compressed into pack files, and the
chunk table keeps one place for each digest: Spark groups digests to find it and joins the ordered chunk lists
of the media with it. Media are read back through those lists, checked against their SHA-256 and described.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from breakweave.llm.common import bounded_batches, materialise, read_only, shared_dir, write_whole

#: Payloads are padded to a multiple of this; it is also the sample count of one block of the format.
BLOCK = 576
FILL = b"\xff"
#: A chunk ends where the gear hash has this many leading zero bits, but is neither shorter nor longer than these.
CUT_BITS = 11
SHORTEST, LONGEST = 512, 16384
#: Bytes before compression that one pack file holds, about.
PACK_BYTES = 32 << 20
#: The gear hash of 32 bits forgets a byte after 32 steps.
GEAR_REACH = 32

CHUNK = "struct<digest:binary,pack:string,start:long,size:int>"


def gear_table(seed: int = 576) -> np.ndarray:
    """256 random 32-bit numbers, one a byte value."""
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 32, 256, np.uint64).astype(np.uint32)


def gear(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The rolling hash h[i] = 2 h[i-1] + table[data[i]] (32 bits) at every position, by doubling."""
    h = table[data]
    step = 1
    while step < GEAR_REACH:
        later = h[step:] + (h[:-step] << np.uint32(step))
        h = np.concatenate([h[:step], later])
        step *= 2
    return h


def cuts(data: bytes, table: np.ndarray) -> list[int]:
    """Chunk ends, the last one len(data)."""
    n = len(data)
    if n <= SHORTEST:
        return [n]
    marks = np.flatnonzero(gear(np.frombuffer(data, np.uint8), table) >> np.uint32(32 - CUT_BITS) == 0) + 1
    ends, at = [], 0
    while n - at > SHORTEST:
        k = np.searchsorted(marks, at + SHORTEST)
        end = int(marks[k]) if k < len(marks) else n
        end = min(end, at + LONGEST, n)
        ends.append(end)
        at = end
    if at < n:
        ends.append(n)
    return ends


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Unpadded size and padded payload."""
    raw = (text or "").encode()
    return len(raw), raw + FILL * (max(1, -(-len(raw) // BLOCK)) * BLOCK - len(raw))


def wav(payload: bytes) -> bytes:
    """The payload as 8-bit mono samples; the format's header is fixed but for the sizes."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8, b"data", len(payload))
    return head + payload


def samples(media: bytes) -> bytes:
    """The payload of a stored WAV."""
    size = struct.unpack_from("<I", media, 40)[0]
    if media[:4] != b"RIFF" or media[36:40] != b"data" or len(media) != 44 + size:
        raise ValueError("not a stored payload")
    return media[44:]


def store_media(docs: DataFrame, folder: str) -> DataFrame:
    """Chunk every text's media into pack files; doc_id, n_bytes, media_sha256 and the ordered chunks of each row.

    A pack holds a chunk once for all its rows; a task begins a new pack at a bounded size, and other packs may hold the same
    chunk again: `chunk_table` keeps one place for each digest. Pack names are new for every attempt of a task, so a retried
    task never changes a file that other rows point to.
    """
    bounded_batches(docs.sparkSession)

    def ingest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, squeeze = gear_table(), zstandard.ZstdCompressor(level=3)
        places: dict[bytes, tuple[str, int, int]] = {}
        pack, blobs, size, raw, held = uuid.uuid4().hex, [], 0, 0, []
        shape = pa.list_(pa.struct([("digest", pa.binary()), ("pack", pa.string()), ("start", pa.int64()), ("size", pa.int32())]))

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal pack, blobs, size, raw, held, places
            if blobs:
                write_whole(folder, f"{pack}.pack", blobs)
            yield from held
            pack, blobs, size, raw, held, places = uuid.uuid4().hex, [], 0, 0, [], {}

        for batch in batches:
            sizes, names, lists = [], [], []
            for text in batch.column("text").to_pylist():
                n, payload = payload_of(text)
                media = wav(payload)
                chunks, at = [], 0
                for end in cuts(media, table):
                    chunk = media[at:end]
                    digest = hashlib.sha256(chunk).digest()
                    place = places.get(digest)
                    if place is None:
                        blob = squeeze.compress(chunk)
                        place = places[digest] = (pack, size, len(blob))
                        blobs.append(blob)
                        size += len(blob)
                        raw += len(chunk)
                    chunks.append({"digest": digest, "pack": place[0], "start": place[1], "size": place[2]})
                    at = end
                sizes.append(n)
                names.append(hashlib.sha256(media).hexdigest())
                lists.append(chunks)
            held.append(
                pa.record_batch(
                    {"doc_id": batch.column("doc_id"), "n_bytes": pa.array(sizes, pa.int64()), "media_sha256": pa.array(names), "chunks": pa.array(lists, shape)}
                )
            )
            if raw >= PACK_BYTES:
                yield from close()
        yield from close()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(ingest, f"doc_id long, n_bytes long, media_sha256 string, chunks array<{CHUNK}>")


def chunk_table(stored: DataFrame) -> DataFrame:
    """One place for every digest."""
    each = stored.select(F.explode("chunks").alias("c")).select("c.*")
    return each.groupBy("digest").agg(F.min(F.struct("pack", "start", "size")).alias("place"))


def chunk_lists(stored: DataFrame) -> DataFrame:
    """The ordered digests of every distinct media, one row a chunk."""
    one = stored.groupBy("media_sha256").agg(F.min("chunks.digest").alias("digests"))
    return one.select("media_sha256", F.posexplode("digests").alias("seq", "digest"))


def read_media(stored: DataFrame, folder: str) -> DataFrame:
    """Rebuild every distinct media from its chunk list and return what the stored bytes are.

    media_sha256, payload_bytes, payload_sha256, tail_crc32, media_bytes, feature. A media whose bytes do not
    have its digest is an error, never a row.
    """
    located = chunk_lists(stored).join(chunk_table(stored), "digest")
    # One bounded list a media: its own chunks.
    whole = located.groupBy("media_sha256").agg(F.sort_array(F.collect_list(F.struct("seq", "place"))).alias("parts"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand, files = zstandard.ZstdDecompressor(), {}

        def fetch(place: dict) -> bytes:
            name = place["pack"]
            if name not in files:
                if len(files) >= 64:
                    files.popitem()[1].close()
                files[name] = read_only(f"{folder}/{name}.pack")
            return expand.decompress(files[name].read_at(place["size"], place["start"]))

        for batch in batches:
            out = {k: [] for k in ("media_sha256", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "feature")}
            for name, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                chunks = [fetch(part["place"]) for part in parts]
                media = b"".join(chunks)
                digest = hashlib.sha256(media).hexdigest()
                if digest != name:
                    raise ValueError(f"media {name} was read back as {digest}")
                payload = samples(media)
                lengths = [len(c) for c in chunks]
                order = hashlib.sha256(b"".join(hashlib.sha256(c).digest() for c in chunks)).hexdigest()[:16]
                for key, value in (
                    ("media_sha256", digest),
                    ("payload_bytes", len(payload)),
                    ("payload_sha256", hashlib.sha256(payload).hexdigest()),
                    ("tail_crc32", zlib.crc32(payload[-32:])),
                    ("media_bytes", len(media)),
                    ("feature", f"chunks={len(lengths)};least={min(lengths)};most={max(lengths)};mean={float(np.frombuffer(payload, np.uint8).mean()):.6f};list={order}"),
                ):
                    out[key].append(value)
            yield pa.record_batch({k: pa.array(v, pa.int64() if k in ("payload_bytes", "tail_crc32", "media_bytes") else pa.string()) for k, v in out.items()})

    return whole.mapInArrow(
        read, "media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, feature string"
    )


def media_columns(docs: DataFrame, spark: SparkSession) -> DataFrame:
    """Store every text as media and read it back; one row a document.

    Null texts are empty: one block of filling. Equal texts share media and so all values; rows with repeated or
    null doc_id stay apart; an empty table gives an empty result; other columns are not read.
    """
    folder = shared_dir(spark, "packs")
    stored = materialise(store_media(docs, folder), spark, "chunk-lists")
    read = read_media(stored, folder)
    joined = stored.select("doc_id", "n_bytes", "media_sha256").join(read, "media_sha256")
    return joined.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
