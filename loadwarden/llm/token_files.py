"""Token ids in binary files of patched frame-of-reference blocks, in ascending document order.

A block holds up to BLOCK ids: its smallest id, a bit width that the WIDTH_PERCENTILE of the differences to it fits into, the differences
packed at that width, and an exception list (place, full difference) for those that do not fit. A file ends with an index of
where its blocks start and of its documents (id, number of ids), so both are found without reading what lies before.

    "PFR1" | blocks | index of blocks, documents | offset of the index (8 bytes) | "PFR1"

Documents are range-partitioned by id, one file per range and FILE_BYTES. Null ids come first; documents of equal ids follow the hash of their text;
null and empty texts hold the end id alone; texts of any length are written whole, over as many blocks as they need; an empty table
gives files without documents; other columns are not read. Ids of documents must be whole numbers.
"""
from __future__ import annotations

import struct
import zlib
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadwarden.llm.common import in_pieces
from loadwarden.llm.files import new_folder, reading, writing
from loadwarden.llm.tokens import WordEncoder, tokenizer_path
from loadwarden.session import write_through

MAGIC = b"PFR1"
BLOCK, WIDTH_PERCENTILE = 4096, 90
END_ID = 2
#: A file is closed after the piece of text that brings it to this size; documents are read back this many at a time.
FILE_BYTES, ROWS = 256 << 20, 1024
_HEAD = struct.Struct("<IHBH")  # smallest id, ids - 1, width, exceptions


@lru_cache(maxsize=64)
def _places(n: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For n numbers of `width` bits in 64-bit lanes: the lane each begins in, its shift there, and the first number of each lane."""
    at = np.arange(n, dtype=np.int64) * width
    lanes = at >> 6
    return lanes, (at & 63).astype(np.uint64), np.flatnonzero(np.diff(lanes, prepend=-1))


def pack_block(ids: np.ndarray) -> bytes:
    low = int(ids.min())
    rest = ids.astype(np.uint64) - np.uint64(low)
    at = -(-WIDTH_PERCENTILE * (len(ids) - 1) // 100)
    width = max(1, int(np.partition(rest, at)[at]).bit_length())
    large = np.flatnonzero(rest >> np.uint64(width))
    kept = rest.copy()
    kept[large] = 0
    lanes, shift, firsts = _places(len(ids), width)
    packed = np.zeros(int(lanes[-1]) + 2, dtype=np.uint64)
    packed[:-1] = np.bitwise_or.reduceat(kept << shift, firsts)
    # the upper bits of a number that crosses into the next lane; shifted in two steps, as 64 at once is undefined
    over = np.flatnonzero(shift + np.uint64(width) > 64)
    packed[lanes[over] + 1] |= (kept[over] >> np.uint64(1)) >> (np.uint64(63) - shift[over])
    return b"".join([_HEAD.pack(low, len(ids) - 1, width, len(large)), packed.astype("<u8").tobytes()[:(len(ids) * width + 7) // 8],
                     large.astype("<u2").tobytes(), rest[large].astype("<u4").tobytes()])


def unpack_block(data: bytes) -> np.ndarray:
    low, n, width, exceptions = _HEAD.unpack_from(data)
    n += 1
    at, size = _HEAD.size, (n * width + 7) // 8
    lanes, shift, _ = _places(n, width)
    packed = np.frombuffer(data[at:at + size].ljust(8 * (int(lanes[-1]) + 2), b"\0"), dtype="<u8").astype(np.uint64)
    rest = packed[lanes] >> shift | (packed[lanes + 1] << np.uint64(1)) << (np.uint64(63) - shift)
    rest &= np.uint64((1 << width) - 1)
    at += size
    places = np.frombuffer(data, "<u2", exceptions, at)
    rest[places] = np.frombuffer(data, "<u4", exceptions, at + 2 * exceptions)
    return (rest + np.uint64(low)).astype("<u4")


class TokenWriter:
    def __init__(self, out):
        self.out, self.at = out, 0
        self.held: list[np.ndarray] = []
        self.waiting, self.total = 0, 0
        self.blocks: list[int] = []
        self.docs: list[tuple[int | None, int]] = []
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.held.append(ids)
        self.waiting += len(ids)
        self.total += len(ids)
        if self.waiting >= 16 * BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, dtype="<u4")
        end = len(ids) if last else len(ids) // BLOCK * BLOCK
        for i in range(0, end, BLOCK):
            self.blocks.append(self.at)
            self._put(pack_block(ids[i:min(i + BLOCK, end)]))
        self.held, self.waiting = [ids[end:]], len(ids) - end

    def close(self) -> None:
        self._flush(True)
        index = self.at
        self._put(struct.pack("<QQ", len(self.blocks), len(self.docs)))
        self._put(np.array([*self.blocks, index], dtype="<u8").tobytes())
        self._put(np.array([d is None for d, _ in self.docs], dtype=np.uint8).tobytes())
        self._put(np.array([d or 0 for d, _ in self.docs], dtype="<i8").tobytes())
        self._put(np.array([n for _, n in self.docs], dtype="<u8").tobytes())
        self._put(struct.pack("<Q", index) + MAGIC)


class TokenReader:
    def __init__(self, source):
        self.source = source
        source.seek(source.size() - 12)
        index, magic = struct.unpack("<Q4s", source.read(12))
        if magic != MAGIC:
            raise ValueError("not a token file")
        source.seek(index)
        blocks, docs = struct.unpack("<QQ", source.read(16))
        self.blocks = np.frombuffer(source.read(8 * (blocks + 1)), dtype="<u8").astype(np.int64)
        missing = np.frombuffer(source.read(docs), dtype=np.uint8)
        ids = np.frombuffer(source.read(8 * docs), dtype="<i8")
        self.doc_ids = [None if m else int(i) for m, i in zip(missing, ids)]
        self.sizes = np.frombuffer(source.read(8 * docs), dtype="<u8").astype(np.int64)

    def block(self, k: int) -> np.ndarray:
        self.source.seek(int(self.blocks[k]))
        return unpack_block(self.source.read(int(self.blocks[k + 1] - self.blocks[k])))

    def documents(self):
        """(doc_id, ids) in order; holds one document and one block at a time."""
        k, held = 0, np.zeros(0, dtype="<u4")
        for doc_id, size in zip(self.doc_ids, self.sizes):
            parts, need = [], int(size)
            while True:
                parts.append(held[:need])
                need -= len(parts[-1])
                held = held[len(parts[-1]):]
                if not need:
                    break
                held, k = self.block(k), k + 1
            yield doc_id, np.concatenate(parts)


def write(docs: DataFrame, folder: str, end_id: int = END_ID, path: str | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encodes every text and writes the files, a new one once `file_bytes` are in the last; returns the written table of files:
    part, roll (place among the files of the part), file, n_docs, n_ids, base (ids in the files before)."""
    path = path or tokenizer_path()
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = (docs.select("doc_id", "text", F.xxhash64("text").alias("sig")).repartitionByRange(ranges, "doc_id", "sig")
               .sortWithinPartitions("doc_id", "sig").select("doc_id", "text"))

    def run(batches):
        part, encoder = TaskContext.get().partitionId(), WordEncoder.shared(path)
        end, pieces, k = np.array([end_id], dtype="<u4"), in_pieces(batches), 0
        piece = next(pieces, None)
        while piece is not None or not k:
            name = f"{folder}/ids-{part:06d}-{k:06d}.pfor"
            with writing(name) as out:
                writer = TokenWriter(out)
                while piece is not None and writer.at < file_bytes:
                    ids, ends = encoder.encode_column(piece.column(1))
                    for doc_id, own in zip(piece.column(0).to_pylist(), np.split(ids, ends[:-1])):
                        writer.add(doc_id, np.concatenate([own.astype("<u4"), end]))
                    piece = next(pieces, None)
                writer.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "roll": pa.array([k], pa.int32()), "file": [name],
                                              "n_docs": [len(writer.docs)], "n_ids": [writer.total]})
            k += 1

    files = write_through(ordered.mapInArrow(run, "part int, roll int, file string, n_docs long, n_ids long"), "token-files")
    before = Window.orderBy("part", "roll").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    return files.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read(files: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    ranges = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at = base
                with reading(name) as source:
                    documents = TokenReader(source).documents()
                    while rows := list(islice(documents, ROWS)):
                        sizes = np.array([len(ids) for _, ids in rows], dtype=np.int64)
                        starts = at + np.cumsum(sizes) - sizes
                        yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.int64()), pa.array(starts), pa.array(sizes),
                                                          pa.array([zlib.crc32(ids) for _, ids in rows], pa.int64())],
                                                         names=["doc_id", "start", "n_tokens", "ids_crc32"])
                        at = int(starts[-1] + sizes[-1])

    return files.select("file", "base").repartition(ranges).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """Writes token files to the shared folder and reads them back."""
    return read(write(docs, new_folder(docs.sparkSession, "tokens"), end_id, path))
