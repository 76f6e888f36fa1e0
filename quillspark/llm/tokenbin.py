r"""Operator 2: token ids in bit-packed files.

A part file holds, in ascending doc_id order, the ids of its documents, each in the fewest bits that hold the vocabulary:

    magic `QTB1` | blocks of BLOCK ids, bit-packed, least bit first | footer | footer length (8 bytes) | `QTB1`
    footer: JSON with width, counts and the byte places of: block offsets, document ids, document starts (int64 each)

Block offsets let a reader fetch and unpack any block alone; document starts (in ids, from the part's first id) give
random access to a document. `manifest.json` lists the parts with the number of ids before each.

Files are written and read through the file system of the path's scheme, so any store that pyarrow knows will do. A
part is written under a name of its own attempt and then moved, so a repeated task leaves one whole file.

Defined results: null or empty texts hold the end id alone; rows that repeat a doc_id stay side by side in order of their
text's hash; a null doc_id comes first; an empty table gives no parts; other columns are ignored.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import doc_slices, input_bytes

MAGIC = b"QTB1"
BLOCK = 1 << 16
NO_ID = -(1 << 63)


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    """`width` bits an id, least bit first."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :, None] >> np.arange(8, dtype=np.uint8)) & 1
    return np.packbits(bits.reshape(len(ids), 32)[:, :width].ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes, width: int, count: int) -> np.ndarray:
    """The first `count` ids, without a loop over ids."""
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", count).astype(np.uint32)
    words = np.frombuffer(data + bytes(16 - len(data) % 8), "<u8")
    at = np.arange(count, dtype=np.uint64) * np.uint64(width)
    word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
    low = words[word] >> shift
    high = np.where(shift == 0, np.uint64(0), words[word + 1] << (np.uint64(64) - np.maximum(shift, np.uint64(1))))
    return ((low | high) & np.uint64((1 << width) - 1)).astype(np.uint32)


def _open(path: str):
    return pafs.FileSystem.from_uri(path)


class PartWriter:
    """Streams one part; holds one block of ids and 16 bytes a document."""

    def __init__(self, stream, width: int):
        self.stream, self.width = stream, width
        self.stream.write(MAGIC)
        self.place, self.n_ids = len(MAGIC), 0
        self.buffer: list[np.ndarray] = []
        self.buffered = 0
        self.blocks: list[int] = []
        self.doc_ids: list[int] = []
        self.starts: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(NO_ID if doc_id is None else doc_id)
        self.starts.append(self.n_ids)
        self.n_ids += len(ids)
        self.buffer.append(ids)
        self.buffered += len(ids)
        if self.buffered >= 4 * BLOCK:
            self._flush(whole=False)

    def _flush(self, whole: bool) -> None:
        ids = np.concatenate(self.buffer) if self.buffer else np.empty(0, np.uint32)
        end = len(ids) if whole else len(ids) - len(ids) % BLOCK
        for at in range(0, end, BLOCK):
            data = pack_bits(ids[at : min(end, at + BLOCK)], self.width)
            self.blocks.append(self.place)
            self.stream.write(data)
            self.place += len(data)
        self.buffer, self.buffered = [ids[end:]], len(ids) - end

    def close(self) -> None:
        self._flush(whole=True)
        places = {}
        for name, values in (("blocks", [*self.blocks, self.place]), ("doc_ids", self.doc_ids), ("starts", [*self.starts, self.n_ids])):
            data = np.array(values, "<i8").tobytes()
            places[name] = [self.place, len(values)]
            self.stream.write(data)
            self.place += len(data)
        footer = json.dumps({"width": self.width, "block": BLOCK, "n_ids": self.n_ids, "n_docs": len(self.doc_ids), "places": places}).encode()
        self.stream.write(footer + struct.pack("<Q", len(footer)) + MAGIC)


class PartReader:
    """Random access to one part; reads its index once and then only the blocks that are asked for."""

    def __init__(self, path: str):
        files, name = _open(path)
        self.file = files.open_input_file(name)
        size = self.file.size()
        tail = self.file.read_at(12, size - 12)
        if tail[8:] != MAGIC:
            raise ValueError(f"not a token file: {path}")
        length = struct.unpack("<Q", tail[:8])[0]
        self.meta = json.loads(self.file.read_at(length, size - 12 - length))
        self.blocks, self.doc_ids, self.starts = (np.frombuffer(self.file.read_at(8 * n, at), "<i8") for at, n in (self.meta["places"][k] for k in ("blocks", "doc_ids", "starts")))

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids start to end of the part."""
        if end <= start:
            return np.empty(0, np.uint32)
        block, width, n_ids = self.meta["block"], self.meta["width"], self.meta["n_ids"]
        first, last = start // block, (end - 1) // block
        data = self.file.read_at(int(self.blocks[last + 1] - self.blocks[first]), int(self.blocks[first]))
        found = []
        for b in range(first, last + 1):
            at = int(self.blocks[b] - self.blocks[first])
            found.append(unpack_bits(data[at : at + int(self.blocks[b + 1] - self.blocks[b])], width, min(block, n_ids - b * block)))
        flat = np.concatenate(found)
        return flat[start - first * block : end - first * block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


def write_tokens(docs: DataFrame, path: str, tokenizer: str, vocabulary: int, end_id: int, part_bytes: int = 48 << 20) -> list[tuple[str, int, int, int]]:
    """Write all documents under `path`; returns (file, ids before it, ids, documents) of each part, also in the manifest.

    One shuffle of the texts, by ranges of doc_id; token ids are made after it and never shuffled."""
    width = max(1, (max(vocabulary - 1, end_id)).bit_length())
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-input_bytes(docs) // part_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quillspark.llm.encoding import encoder

        encode = encoder(tokenizer).encode
        number = TaskContext.get().partitionId()
        files, root = _open(path)
        name, draft = f"part-{number:07d}.qtb", f"{root}/.draft-{uuid.uuid4().hex}"
        with files.open_output_stream(draft) as stream:
            writer = PartWriter(stream, width)
            for ids, texts in doc_slices(batches):
                flat, at = encode(texts)
                for i, doc_id in enumerate(ids):
                    writer.add(doc_id, np.append(flat[at[i] : at[i + 1]], np.uint32(end_id)))
            writer.close()
        files.move(draft, f"{root}/{name}")
        encoder(tokenizer).rest()
        yield pa.RecordBatch.from_pydict({"number": pa.array([number], pa.int64()), "name": [name], "n_ids": pa.array([writer.n_ids], pa.int64()), "n_docs": pa.array([len(writer.doc_ids)], pa.int64())})

    files, root = _open(path)
    files.create_dir(root, recursive=True)
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange(parts, F.col("doc_id"), tie).sortWithinPartitions(F.col("doc_id"), tie)
    made = sorted(map(tuple, ordered.mapInArrow(run, "number bigint, name string, n_ids bigint, n_docs bigint").collect()))  # a row a part
    out, before = [], 0
    for _, name, n_ids, n_docs in made:
        if n_docs:
            out.append((f"{path}/{name}", before, n_ids, n_docs))
        before += n_ids
    with files.open_output_stream(f"{root}/manifest.json") as stream:
        stream.write(json.dumps({"width": width, "parts": out}).encode())
    return out


def read_tokens(spark: SparkSession, parts: list[tuple[str, int, int, int]], step: int = 1 << 20) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of each document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = PartReader(file)
                i, n = 0, len(part.doc_ids)
                while i < n:
                    j = max(i + 1, int(np.searchsorted(part.starts, part.starts[i] + step, "right")) - 1)
                    j = min(j, n)
                    base = int(part.starts[i])
                    flat = part.ids(base, int(part.starts[j])).astype("<u4")
                    sums = [zlib.crc32(flat[int(part.starts[k]) - base : int(part.starts[k + 1]) - base].tobytes()) for k in range(i, j)]
                    ids = part.doc_ids[i:j]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array(ids, pa.int64(), mask=ids == NO_ID),
                            "start": pa.array(part.starts[i:j] + before, pa.int64()),
                            "n_tokens": pa.array(np.diff(part.starts[i : j + 1]), pa.int64()),
                            "ids_crc32": pa.array(sums, pa.int64()),
                        }
                    )
                    i = j

    listed = spark.createDataFrame([(p[0], p[1]) for p in parts], "file string, before bigint").repartition(max(1, len(parts)))
    return listed.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
