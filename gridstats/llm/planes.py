"""Token ids in binary shard files, bit-plane shuffled.

A shard holds the ids of neighbouring documents, cut into blocks of BLOCK ids.
The bytes of a block are transposed into planes (all lowest bytes, all second
bytes, ...; or the same by bits), each plane is compressed by zstandard, and
the shard ends with an index of its chunks and of its documents:

    magic "BPLANE1\\n"
    planes of block 0, planes of block 1, ...
    documents: first the n_docs ids (int64; null as the smallest), then n_docs lengths (int64), zstandard
    chunk index: per block n_ids (u32), and per plane its length (u32)
    footer: n_blocks, planes per id, bits per plane, length of the documents' part, n_docs (5 x u64)

All numbers are little endian. Planes that no id of a block needs are empty.
Shards are written under a name of the attempt and then renamed, so a repeated
or lost attempt leaves whole files only; every attempt has the same content.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridstats.llm.encoders import word_ids
from gridstats.shipping import ship, small_batches
from gridstats.sources import keep, shared_folder

MAGIC = b"BPLANE1\n"
#: Ids in one block.
BLOCK = 1 << 16
#: Bytes of text of one shard, about.
SHARD = 1 << 25
#: Tasks that read shards, at most; each then takes several.
READERS = 20_000
_NO_ID = -(1 << 63)
_FOOTER = struct.Struct("<5Q")


def to_planes(ids: np.ndarray, bits: int = 8) -> list[bytes]:
    """The planes of a block, lowest first: ``bits`` is 8 (byte planes) or 1 (bit planes)."""
    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if bits == 8:
        planes = [np.ascontiguousarray(raw[:, k]) for k in range(4)]
    else:
        each = np.unpackbits(raw, axis=1, bitorder="little")
        planes = [np.packbits(each[:, k], bitorder="little") for k in range(32)]
    return [plane.tobytes() if plane.any() else b"" for plane in planes]


def from_planes(planes: list[bytes], n_ids: int, bits: int = 8) -> np.ndarray:
    """The block of ids again."""
    if bits == 8:
        raw = np.zeros((n_ids, 4), dtype=np.uint8)
        for k, plane in enumerate(planes):
            if plane:
                raw[:, k] = np.frombuffer(plane, dtype=np.uint8)
    else:
        each = np.zeros((n_ids, 32), dtype=np.uint8)
        for k, plane in enumerate(planes):
            if plane:
                bytes_ = np.frombuffer(plane, dtype=np.uint8)
                each[:, k] = np.unpackbits(bytes_, count=n_ids, bitorder="little")
        raw = np.packbits(each, axis=1, bitorder="little")
    return raw.view("<u4").reshape(-1)


class ShardWriter:
    """Writes one shard to an open stream; ``add`` takes documents in order."""

    def __init__(self, stream, bits: int = 8):
        import zstandard

        self.stream, self.bits = stream, bits
        self.pack = zstandard.ZstdCompressor(level=3)
        self.waiting: list[bytes] = []
        self.size = 0
        self.index: list[bytes] = []
        self.docs: list[int] = []
        self.lengths: list[int] = []
        stream.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append(_NO_ID if doc_id is None else doc_id)
        self.lengths.append(len(ids) // 4)
        self.waiting.append(ids)
        self.size += len(ids)
        while self.size >= 4 * BLOCK:
            joined = b"".join(self.waiting)
            self.waiting = [joined[4 * BLOCK :]]
            self.size -= 4 * BLOCK
            self._block(joined[: 4 * BLOCK])

    def _block(self, raw: bytes) -> None:
        planes = to_planes(np.frombuffer(raw, dtype="<u4"), self.bits)
        chunks = [self.pack.compress(plane) if plane else b"" for plane in planes]
        for chunk in chunks:
            self.stream.write(chunk)
        self.index.append(struct.pack(f"<{1 + len(chunks)}I", len(raw) // 4, *map(len, chunks)))

    def close(self) -> None:
        if self.size:
            self._block(b"".join(self.waiting))
        numbers = np.array([self.docs, self.lengths], dtype="<i8")
        documents = self.pack.compress(numbers.tobytes())
        self.stream.write(documents)
        self.stream.write(b"".join(self.index))
        planes = 32 // self.bits
        self.stream.write(
            _FOOTER.pack(len(self.index), planes, self.bits, len(documents), len(self.docs))
        )


class ShardReader:
    """Reads a shard from a random-access file; only the blocks asked for are unpacked."""

    def __init__(self, file, size: int):
        import zstandard

        self.file, self.unpack = file, zstandard.ZstdDecompressor()
        n_blocks, planes, self.bits, n_documents, n_docs = _FOOTER.unpack(
            self._at(size - _FOOTER.size, _FOOTER.size)
        )
        width = 4 * (1 + planes)
        index_at = size - _FOOTER.size - n_blocks * width
        index = np.frombuffer(self._at(index_at, n_blocks * width), dtype="<u4")
        index = index.reshape(n_blocks, 1 + planes).astype(np.int64)
        self.n_ids, self.lengths = index[:, 0], index[:, 1:]
        self.starts = len(MAGIC) + np.cumsum(self.lengths.sum(axis=1)) - self.lengths.sum(axis=1)
        raw = self.unpack.decompress(self._at(index_at - n_documents, n_documents))
        self.docs, self.doc_lengths = np.frombuffer(raw, dtype="<i8").reshape(2, n_docs)

    def _at(self, offset: int, length: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(length)

    def block(self, k: int) -> np.ndarray:
        raw, at, planes = self._at(int(self.starts[k]), int(self.lengths[k].sum())), 0, []
        for length in self.lengths[k]:
            chunk = raw[at : at + length]
            planes.append(self.unpack.decompress(chunk) if length else b"")
            at += length
        return from_planes(planes, int(self.n_ids[k]), self.bits)

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Per document in order: id, ids before it in the shard, its ids. Holds one block more."""
        buffer, ahead, start = np.empty(0, dtype="<u4"), 0, 0
        for doc_id, length in zip(self.docs.tolist(), self.doc_lengths.tolist(), strict=True):
            parts = [buffer]
            have = len(buffer)
            while have < length:
                parts.append(self.block(ahead))
                have += len(parts[-1])
                ahead += 1
            buffer = np.concatenate(parts) if len(parts) > 1 else buffer
            yield (None if doc_id == _NO_ID else doc_id), start, buffer[:length]
            buffer, start = buffer[length:], start + length


def filesystem(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (
        fs.LocalFileSystem(),
        path,
    )


def write_shards(
    docs: DataFrame, tokenizer: str, folder: str, end_id: int = 1, bits: int = 8
) -> DataFrame:
    """Encode every whole text, add ``end_id`` and write the ids in ascending ``doc_id`` order.

    Documents are dealt to shards by ranges of ``doc_id`` (null first; rows that
    share an id by a hash of the text, equal rows by their place, so that no id
    fills a shard), a shard per SHARD bytes of text; the text is encoded where
    its shard is written. Returns the manifest, which is written to ``folder``
    too: ``shard``, ``path``, ``n_docs``, ``n_ids`` and ``start``, the ids of all
    earlier shards. An empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    ship(spark)
    small_batches(spark)
    size = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint")).first()[0]
    shards = max(1, -(-(size or 0) // SHARD))
    order = ["doc_id", "draw", "place"]
    rows = docs.select(
        F.col("doc_id").cast("bigint"),
        "text",
        F.xxhash64("text").alias("draw"),
        F.monotonically_increasing_id().alias("place"),
    )
    ranges = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, writer = word_ids(tokenizer), end_id.to_bytes(4, "little"), None
        shard = TaskContext.get().partitionId()
        store, root = filesystem(folder)
        path, own = f"{root}/shard-{shard:06d}.bpl", f"{root}/_attempt-{uuid4().hex}"
        n_ids = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                store.create_dir(root, recursive=True)
                stream = store.open_output_stream(own)
                writer = ShardWriter(stream, bits)
            texts = encoder.encode(batch.column("text").to_pylist())
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                writer.add(doc_id, ids + end)
                n_ids += len(ids) // 4 + 1
        if writer is not None:
            writer.close()
            stream.close()
            store.move(own, path)
            row = {"shard": [shard], "file": [f"shard-{shard:06d}.bpl"]}
            yield pa.RecordBatch.from_pydict(row | {"n_docs": [len(writer.docs)], "n_ids": [n_ids]})

    written = ranges.mapInArrow(write, "shard bigint, file string, n_docs bigint, n_ids bigint")
    written = keep(written)
    # One row per shard: 3 million for 100 TB of text.
    before =Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    manifest = written.select(
        "shard",
        F.concat(F.lit(f"{folder}/"), "file").alias("path"),
        "n_docs",
        "n_ids",
        F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"),
    )
    manifest.write.mode("overwrite").parquet(f"{folder}/_manifest")
    return spark.read.schema(manifest.schema).parquet(f"{folder}/_manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """The documents of written shards, one task per few shards.

    Returns ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``
    and ``ids`` (little-endian unsigned 32-bit integers).
    """
    ship(manifest.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = filesystem(row["path"])
                with store.open_input_file(path) as file:
                    found = []
                    for doc_id, start, ids in ShardReader(file, file.size()).documents():
                        found.append((doc_id, row["start"] + start, len(ids), ids.tobytes()))
                        if len(found) >= 512:
                            yield _batch(found)
                            found = []
                    if found:
                        yield _batch(found)

    # A row here is a whole shard of work, so tasks are made by rows, not by bytes.
    shards = manifest.count()
    spread = manifest.select("path", "start").repartitionByRange(max(1, min(shards, READERS)), "path")
    return spread.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids"])


def checksums(documents: DataFrame) -> DataFrame:
    """``ids_crc32`` in place of ``ids``: Spark's own crc32 over the bytes that were read."""
    return documents.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/shards-{uuid4().hex}"
