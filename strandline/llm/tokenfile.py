"""Token files: ids packed at the fewest bits that the vocabulary needs, with block offsets for random access.

A file is: the magic, then blocks of `block` ids (the last may be shorter), each packed at `bits` bits an id, least
significant bit first, starting on a byte; then the index: the documents' ids, where each document starts, and the blocks'
byte offsets; then a fixed trailer with the bits, the block size, and the numbers of ids, documents and blocks. A reader
opens the trailer, then the index, then only the blocks that a range of ids touches, and unpacks a block with numpy.

Writing: documents are dealt out in ranges of doc_id (no partition count is fixed, so adaptive execution sizes the files), sorted,
encoded and written as a stream in one pass. Every attempt of a task writes a file of its own name, so nothing is renamed or replaced; the manifest (a row a file),
which Spark commits, says whose file counts, and only files that it lists are read.

Edge cases: a null or empty text is its end id alone; null doc_ids come first; repeated rows are written as often as they
occur; an empty table gives no files and an empty result.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import file_system, shared_dir, text_batches, written
from .tokens import encoder, tokenizer_path

MAGIC, TRAILER = b"TOKBITS1", struct.Struct("<BIQQQ8s")
BLOCK = 1 << 14
END = 2
MANIFEST = "part int, path string, n_docs long, n_ids long, n_bytes long"
NO_ID = np.iinfo(np.int64).min


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold every id of the vocabulary."""
    return max(1, int(vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    lanes = np.unpackbits(np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(lanes[:, :bits].ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype("<u4")
    lanes = np.zeros((n, 32), np.uint8)
    lanes[:, :bits] = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return np.packbits(lanes.ravel(), bitorder="little").view("<u4")


class Writer:
    """Streams documents into one file; close() gives (documents, ids, bytes)."""

    def __init__(self, sink, bits: int, block: int = BLOCK):
        self.sink, self.bits, self.block = sink, bits, block
        self.docs, self.starts, self.blocks = [], [], []
        self.n = self.at = self.n_held = 0
        self.held: list[np.ndarray] = []
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def _blocks(self, least: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, "<u4")
        done = 0
        while len(ids) - done >= least and done < len(ids):
            part = ids[done : done + self.block]
            self.blocks.append(self.at)
            self._put(pack_bits(part, self.bits))
            done += len(part)
        self.held = [ids[done:]]
        self.n_held = len(ids) - done

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.docs.append(NO_ID if doc is None else doc)
        self.starts.append(self.n)
        self.n += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= 16 * self.block:
            self._blocks(self.block)

    def close(self) -> tuple[int, int, int]:
        self._blocks(1)
        for column in (self.docs, self.starts, self.blocks):
            self._put(np.array(column, "<i8").tobytes())
        self._put(TRAILER.pack(self.bits, self.block, self.n, len(self.docs), len(self.blocks), MAGIC))
        return len(self.docs), self.n, self.at


class Reader:
    """ids(start, n) of any range; docs and starts are the index."""

    def __init__(self, source):
        self.source, size = source, source.size()
        self.bits, self.block, self.n, docs, blocks, magic = TRAILER.unpack(self._get(size - TRAILER.size, TRAILER.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = size - TRAILER.size - 8 * (2 * docs + blocks)
        index = np.frombuffer(self._get(at, 8 * (2 * docs + blocks)), "<i8")
        self.docs, self.starts, self.blocks = index[:docs], index[docs : 2 * docs], np.append(index[2 * docs :], at)

    def _get(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def ids(self, start: int, n: int) -> np.ndarray:
        if n <= 0:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (start + n - 1) // self.block
        base = self.blocks[first]
        data = self._get(int(base), int(self.blocks[last + 1] - base))
        out = [unpack_bits(data[self.blocks[k] - base : self.blocks[k + 1] - base], min(self.block, self.n - k * self.block), self.bits) for k in range(first, last + 1)]
        return np.concatenate(out)[start - first * self.block :][:n]


def write_tokens(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None, end: int = END, block: int = BLOCK) -> DataFrame:
    """Write every text's ids in ascending order of doc_id (null first), then of a hash of the text, so that a doc_id of many rows is many files; the manifest, with ids_before: the ids in the files before."""
    spark = docs.sparkSession
    folder = folder or shared_dir(spark, "tokens")
    text_batches(spark)

    def write(batches):
        import uuid

        part, out, path = TaskContext.get().partitionId(), None, None
        for batch in batches:
            if out is None:
                enc = encoder(tokenizer or tokenizer_path("byte_bpe_50k.json"))
                name = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.tok"
                fs, path = file_system(name)
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                sink = fs.open_output_stream(path)
                out, last = Writer(sink, bits_for(enc.size), block), int(end).to_bytes(4, "little")
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                out.add(doc, np.frombuffer(enc.encode(text.as_py()) + last, "<u4"))
        if out is not None:
            n_docs, n_ids, n_bytes = out.close()
            sink.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "path": name, "n_docs": n_docs, "n_ids": n_ids, "n_bytes": n_bytes}], schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())]))

    order = ["doc_id", "_hash"]
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_hash")).repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    manifest = written(ordered.mapInArrow(write, MANIFEST), "tokens-manifest")
    return manifest.withColumn("ids_before", F.sum("n_ids").over(Window.orderBy("part")) - F.col("n_ids"))


def read_tokens(manifest: DataFrame, at_once: int = 1 << 20) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files; a file is read in ranges of about at_once ids."""

    def read(batches):
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = file_system(row["path"])
                with fs.open_input_file(path) as source:
                    file = Reader(source)
                    ends = np.append(file.starts[1:], file.n)
                    i = 0
                    while i < len(file.docs):
                        j = max(i + 1, int(np.searchsorted(ends, file.starts[i] + at_once, "right")))
                        base = int(file.starts[i])
                        data = memoryview(file.ids(base, int(ends[j - 1]) - base).tobytes())
                        crcs = [zlib.crc32(data[4 * (s - base) : 4 * (e - base)]) for s, e in zip(file.starts[i:j].tolist(), ends[i:j].tolist())]
                        doc = file.docs[i:j]
                        yield pa.RecordBatch.from_arrays([pa.array(doc, mask=doc == NO_ID), pa.array(file.starts[i:j] + row["ids_before"]), pa.array(ends[i:j] - file.starts[i:j]), pa.array(crcs, pa.int64())], names=names)
                        i = j

    files = manifest.select("part", "path", "ids_before")
    return files.repartition(max(1, files.count()), "part").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
