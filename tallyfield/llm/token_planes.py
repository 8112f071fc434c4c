"""Token ids in binary files: fixed-size blocks of ids, shuffled into byte or bit planes, each plane compressed by itself.

Rows are dealt by range of their id (then text hash, then place in the input, so equal ids are cut as well), sorted within
each range, encoded as they stream by, and written block by block: a task holds one block of ids and one of document
entries, however long a text is. Each task writes one file under a name of its own and reports it in its result rows, which
Spark commits; a task that is lost or repeated leaves a file that no manifest names. The only thing that reaches the driver
is one row per task, with the number of ids, from which the files' first ids are added up.

File format, all numbers little-endian:

    magic | blocks | index | length of the index as unsigned 64-bit | magic

A block of ids holds `BLOCK` ids (the last of a file may hold fewer), ends of documents included, so documents run on
across blocks. Its ids are laid out as planes: with "byte" plane k is byte k of every id, with "bit" plane k is bit k of
every id, eight to a byte. A block is one unsigned 32-bit length per plane and the planes, each a zstandard frame; a plane
of zeros has length 0. A block of documents holds up to `DOCUMENTS` entries (flag for a missing id, id, number of ids) as
byte planes of three 64-bit columns. The index is a zstandard frame of one signed 64-bit row per block: kind (0 ids,
1 documents), place in the file, length in bytes, entries, ids before its first entry, CRC-32 of its bytes.

Defined cases: a missing or empty text is the end id alone; rows without an id come first; rows with equal ids stand in the
order of their text hashes; repeated rows are written one by one; an empty table gives no files and no rows; other columns
never take part.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.llm.word_bpe import byte_alphabet, tokenizer_path
from tallyfield.session import materialised, work_path

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
BLOCK = 65_536
DOCUMENTS = 65_536
LEVEL = 3
MAGIC = b"IDPLANE1"
IDS, ENTRIES = 0, 1
# Fixed value: how byte-level tokenizer files split a text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


# --- encoding ------------------------------------------------------------------------------------------------------


@lru_cache(maxsize=2)
def encoder(path: str):
    """Function from text to ids that equals the tokenizers library with the file at `path`.

    Where ids follow the order of merges, as in byte-level files, the same vocabulary runs in the faster of the two
    libraries; any other file runs in its own.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, special = spec["model"], {t["content"]: t["id"] for t in spec["added_tokens"]}
    byte_of = {c: b for b, c in enumerate(byte_alphabet())}
    made = [model["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
    split = spec.get("pre_tokenizer") or {}
    byte_level = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
    if byte_level and not spec.get("normalizer") and None not in made and made == sorted(set(made)):
        import tiktoken

        ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in model["vocab"].items() if t not in special}
        fast = tiktoken.Encoding(path, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)
        return lambda text: fast.encode_to_numpy(text, allowed_special="all")

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    return lambda text: np.array(library.encode(text, add_special_tokens=False).ids, np.uint32)


# --- planes --------------------------------------------------------------------------------------------------------


def shuffled(values: np.ndarray, planes: str) -> list[bytes]:
    """The planes of fixed-width values; those that hold only zeros are empty."""
    rows = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    if planes == "bit":
        bits = np.unpackbits(rows[:, :, None], axis=2, bitorder="little")  # byte, value, bit
        rows = np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little").reshape(8 * values.itemsize, -1)
    return [row.tobytes() if row.any() else b"" for row in rows]


def unshuffled(rows: list[bytes], count: int, kind: str, planes: str) -> np.ndarray:
    """The values that `shuffled` has laid out."""
    dtype = np.dtype(kind)
    out = np.zeros((dtype.itemsize, count), np.uint8)
    if planes == "bit":
        bits = np.zeros((dtype.itemsize, 8, count), np.uint8)
        for k, row in enumerate(rows):
            if row:
                bits[k // 8, k % 8] = np.unpackbits(np.frombuffer(row, np.uint8), count=count, bitorder="little")
        out = np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little")[:, :, 0]
    else:
        for k, row in enumerate(rows):
            if row:
                out[k] = np.frombuffer(row, np.uint8)
    return np.ascontiguousarray(out.T).reshape(-1).view(dtype)


def pressed(rows: list[bytes], level: int) -> bytes:
    packer = zstandard.ZstdCompressor(level=level)
    frames = [packer.compress(row) if row else b"" for row in rows]
    return struct.pack(f"<{len(frames)}I", *map(len, frames)) + b"".join(frames)


def opened(block: bytes, planes: int) -> list[bytes]:
    sizes = struct.unpack_from(f"<{planes}I", block)
    unpacker, at, out = zstandard.ZstdDecompressor(), 4 * planes, []
    for size in sizes:
        out.append(unpacker.decompress(block[at : at + size]) if size else b"")
        at += size
    return out


# --- files ---------------------------------------------------------------------------------------------------------


def place(folder: str) -> tuple[arrow_fs.FileSystem, str]:
    """File system and path of a folder, given as a path or as the URI that Spark takes."""
    uri = folder.replace("s3a://", "s3://", 1)
    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file:///" + uri[len("file:") :].lstrip("/")
    return arrow_fs.FileSystem.from_uri(uri)


class PlaneWriter:
    """Writes one file; `add` takes whole documents, `close` writes the index and gives the numbers of the manifest."""

    def __init__(self, out, planes: str, block: int = BLOCK, level: int = LEVEL):
        self.out, self.planes, self.block, self.level = out, planes, block, level
        self.waiting: list[np.ndarray] = []
        self.held = self.ids = self.documents = self.first_entry = 0
        self.entries: list[tuple[int, int, int]] = []
        self.index: list[tuple[int, ...]] = []
        out.write(MAGIC)
        self.at = len(MAGIC)

    def _put(self, kind: int, data: bytes, count: int, first: int) -> None:
        self.index.append((kind, self.at, len(data), count, first, zlib.crc32(data)))
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.entries.append((doc_id is None, doc_id or 0, len(ids)))
        self.documents += 1
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= self.block:
            self._flush(whole=True)
        if len(self.entries) >= DOCUMENTS:
            self._flush_entries()

    def _flush(self, whole: bool) -> None:
        flat = np.concatenate(self.waiting).astype("<u4")
        end = len(flat) - len(flat) % self.block if whole else len(flat)
        for at in range(0, end, self.block):
            part = flat[at : min(end, at + self.block)]
            self._put(IDS, pressed(shuffled(part, self.planes), self.level), len(part), self.ids)
            self.ids += len(part)
        self.waiting, self.held = [flat[end:]], len(flat) - end

    def _flush_entries(self) -> None:
        table = np.array(self.entries, "<i8")
        planes = [p for column in table.T for p in shuffled(np.ascontiguousarray(column), "byte")]
        self._put(ENTRIES, pressed(planes, self.level), len(table), self.first_entry)
        self.first_entry += int(table[:, 2].sum())
        self.entries = []

    def close(self) -> dict[str, int]:
        if self.held:
            self._flush(whole=False)
        if self.entries:
            self._flush_entries()
        index = zstandard.ZstdCompressor(level=self.level).compress(np.array(self.index, "<i8").tobytes())
        self.out.write(index + struct.pack("<Q", len(index)) + MAGIC)
        self.out.close()
        return {"documents": self.documents, "ids": self.ids, "bytes": self.at + len(index) + 16}


class PlaneReader:
    """Reads one file through its index; every block is checked against its CRC-32 before it is used."""

    def __init__(self, source, planes: str):
        self.source, self.planes = source, planes
        size = source.size()
        tail = source.read_at(16, size - 16)
        (length,) = struct.unpack("<Q", tail[:8])
        if tail[8:] != MAGIC or source.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError("not a file of id planes")
        index = zstandard.ZstdDecompressor().decompress(source.read_at(length, size - 16 - length))
        rows = np.frombuffer(index, "<i8").reshape(-1, 6)
        self.id_blocks, self.entry_blocks = rows[rows[:, 0] == IDS], rows[rows[:, 0] == ENTRIES]

    def _block(self, row: np.ndarray) -> bytes:
        _, at, length, _, _, crc = row.tolist()
        data = self.source.read_at(length, at)
        if zlib.crc32(data) != crc:
            raise ValueError(f"block at {at} is damaged")
        return data

    def entries(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Per block of documents: missing flags, ids, numbers of ids, and ids before each document in this file."""
        for row in self.entry_blocks:
            count = int(row[3])
            planes = opened(self._block(row), 24)
            missing, doc_id, size = (unshuffled(planes[8 * k : 8 * k + 8], count, "<i8", "byte") for k in range(3))
            yield missing.astype(bool), doc_id, size, int(row[4]) + np.cumsum(size) - size

    def ids(self, first: int = 0, count: int | None = None) -> Iterator[np.ndarray]:
        """The ids from `first` on, block by block; only blocks that hold some of them are read."""
        starts, sizes = self.id_blocks[:, 4], self.id_blocks[:, 3]
        last = int(sizes.sum()) if count is None else first + count
        width = 32 if self.planes == "bit" else 4
        for row in self.id_blocks[(starts < last) & (starts + sizes > first)]:
            part = unshuffled(opened(self._block(row), width), int(row[3]), "<u4", self.planes)
            start = int(row[4])
            yield part[max(0, first - start) : last - start]


MANIFEST = "file string, part int, documents long, ids long, bytes long"


def write_ids(
    docs: DataFrame,
    folder: str | None = None,
    path: str | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    end_id: int = END_ID,
    planes: str = "byte",
    block: int = BLOCK,
) -> DataFrame:
    """Write the ids of all documents in ascending order of their ids; one manifest row per file, in order.

    `folder` is a new folder that all executors reach; without it, one below the shared folder. `first_id` of the manifest
    is the number of ids in all files before.
    """
    if planes not in ("byte", "bit"):
        raise ValueError("planes are byte or bit")
    spark = docs.sparkSession
    path, folder = path or tokenizer_path(TOKENIZER), folder or work_path(spark, "id-planes")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, writer, end = encoder(path), None, np.array([end_id], np.uint32)
        system, root = place(folder)
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}.planes"
        for batch in batches:
            if writer is None and batch.num_rows:
                system.create_dir(root, recursive=True)
                writer = PlaneWriter(system.open_output_stream(f"{root}/{name}"), planes, block)
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                writer.add(key, np.concatenate([encode(body.as_py()), end]))
        if writer is not None:
            done = writer.close()
            row = {"file": [f"{folder}/{name}"], "part": pa.array([part], pa.int32()), **{k: [v] for k, v in done.items()}}
            yield pa.RecordBatch.from_pydict(row)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    rows = rows.withColumns({"hash": F.xxhash64("body"), "row": F.monotonically_increasing_id()})
    keys = ["doc_id", "hash", "row"]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "body")
    files = materialised(ordered.mapInArrow(write, MANIFEST), "id-manifest")
    done = sorted(files.select("part", "file", "documents", "ids", "bytes").collect())  # one row per task
    first, out = 0, []
    for part, file, documents, ids, size in done:
        out.append((file, part, documents, ids, size, first))
        first += ids
    return spark.createDataFrame(out, MANIFEST + ", first_id long")


def read_documents(manifest: DataFrame, planes: str = "byte", with_ids: bool = False) -> DataFrame:
    """One row per document of the files: ids before it in all files, number of ids, CRC-32 of its ids; on request the ids.

    Every file is one task, which holds a block of ids and one of entries; only `with_ids` holds whole documents.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    names = ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, name = place(file)
                with system.open_input_file(name) as source:
                    reader = PlaneReader(source, planes)
                    flow, rest = reader.ids(), np.zeros(0, np.uint32)
                    for missing, doc_id, size, start in reader.entries():
                        for lo in range(0, len(size), 4096):
                            crc, ids = [], []
                            for n in size[lo : lo + 4096].tolist():
                                value, parts = 0, []
                                while n:
                                    if not len(rest):
                                        rest = next(flow)
                                    piece, rest = rest[:n], rest[n:]
                                    value, n = zlib.crc32(piece.tobytes(), value), n - len(piece)
                                    if with_ids:
                                        parts.append(piece)
                                crc.append(value)
                                if with_ids:
                                    ids.append(np.concatenate(parts).astype(np.int32))
                            cut = slice(lo, lo + 4096)
                            columns = [pa.array(doc_id[cut], pa.int64(), mask=missing[cut]), pa.array(first + start[cut]), pa.array(size[cut]), pa.array(crc, pa.int64())]
                            columns += [pa.array(ids, pa.list_(pa.int32()))] if with_ids else []
                            yield pa.RecordBatch.from_arrays(columns, names=names)

    files = max(1, manifest.count())
    return manifest.select("file", "first_id").repartition(files, "file").mapInArrow(read, schema)


def read_window(file: str, first: int, count: int, planes: str = "byte") -> np.ndarray:
    """`count` ids of one file from place `first` on, reading only the blocks that hold them (for training readers)."""
    system, name = place(file)
    with system.open_input_file(name) as source:
        parts = list(PlaneReader(source, planes).ids(first, count))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def binary_ids(docs: DataFrame, **options) -> DataFrame:
    """Files written and read back: `doc_id`, `start`, `n_tokens`, `ids_crc32` per document."""
    planes = options.get("planes", "byte")
    return read_documents(write_ids(docs, **options), planes)
