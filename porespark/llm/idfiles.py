"""Token-id files: a Spark data source that writes and reads range-coded ids.

``df.write.format("token_ids").option("path", folder)`` takes rows ``(doc_id long, ids
binary)`` - ids as 32-bit little-endian integers - and writes one file per task, in the
order of its rows.  A file is a run of segments of whole documents:

    magic 4s | documents u32 | ids u64 | symbols u64 | blocks u32 | vocabulary u32 | index bytes u32 | index crc32 u32
    index: zlib of null marks u1, document ids i64, lengths u64, symbols of the vocabulary by falling frequency as u32
    pairs: an id, and 0 or the id that follows it plus 1
    per block: payload bytes u32, payload crc32 u32
    payloads (see idcoder)

A symbol is an id or a pair of ids that often stand side by side in the segment, so that
the coder, whose time goes by the number of symbols, takes both in one step.
Integers are little-endian.  A task writes under a name of its own and the job lists
the files of the tasks that count, with the number of ids before each, in one small
manifest when all are written; readers go by the manifest, so a lost or repeated task
leaves nothing that is read.  Files lie in any store that Arrow's file systems reach.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from porespark.llm import idcoder
from porespark.llm.vocab import JsonIds, as_bytes, kept

SEGMENT_IDS = 1 << 23      # ids of a segment, unless one document alone has more
PAIRS, PAIR_TIMES = 12_000, 32   # most pairs of a segment, fewest places of one
_DENSE = 1 << 22           # values below are counted in a table
_SLICE = 1 << 18
_PAIRED = 1 << 10          # pairs are of the segment's most frequent ids
_HEAD = "<4sIQQIIII"
_MAGIC = b"TID2"
_MANIFEST = "manifest.json"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def by_frequency(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, the most frequent first, and the place of each value of ``x`` among them."""
    if len(x) and int(x.max()) >= _DENSE:
        used, x = np.unique(x, return_inverse=True)
        values, x = by_frequency(x)
        return used[values], x
    times = np.zeros(int(x.max(initial=0)) + 1, "int64")
    for i in range(0, len(x), 8 * _SLICE):
        times += np.bincount(x[i:i + 8 * _SLICE], minlength=len(times))
    values = np.argsort(-times, kind="stable")[:np.count_nonzero(times)]
    place = np.zeros(len(times), "int32")
    place[values] = np.arange(len(values), dtype="int32")
    return values, place[x]


def _keys(x: np.ndarray, n: int, side: int) -> np.ndarray:
    """A number for each two neighbours, ``side * side`` if one is no frequent id."""
    key = x[:-1] * np.int32(side) + x[1:]
    if n > side:
        key[(x[:-1] >= side) | (x[1:] >= side)] = side * side
    return key


def _paired(x: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """``x`` with the symbols of pairs (-1: none); where pairs overlap, every other one of the run is taken."""
    at = np.flatnonzero(symbol >= 0)
    nth = np.arange(len(at))
    opens = np.ones(len(at), bool)
    opens[1:] = at[1:] - at[:-1] != 1
    at = at[(nth - np.maximum.accumulate(np.where(opens, nth, 0))) & 1 == 0]
    out, stays = x.copy(), np.ones(len(x), bool)
    out[at] = symbol[at]
    stays[at + 1] = False
    return out[stays]


def with_pairs(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols for numbers below ``n`` that are numbered by falling frequency, and the numbers of each pair.

    Symbol ``n + k`` stands for pair ``k``.  No pair is taken across slices of ``_SLICE`` numbers.
    """
    side = min(n, _PAIRED)
    times = np.zeros(side * side + 1, "int64")
    for i in range(0, len(x), 8 * _SLICE):
        times += np.bincount(_keys(x[i:i + 8 * _SLICE], n, side), minlength=len(times))
    often = np.flatnonzero(times[:-1] >= PAIR_TIMES)
    most = min(PAIRS, idcoder.MOST_IDS - n)
    if most < len(often):
        often = often[np.argsort(-times[often], kind="stable")[:max(0, most)]]
    of = np.full(len(times), -1, "int32")
    of[often] = np.arange(n, n + len(often), dtype="int32")
    slices = [x[i:i + _SLICE] for i in range(0, len(x), _SLICE)]
    symbols = [_paired(part, of[_keys(part, n, side)]) for part in slices]
    return np.concatenate(symbols or [x]), np.stack([often // side, often % side], axis=1)


def pack_segment(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A segment's bytes."""
    first, x = by_frequency(ids)
    first = first.astype("<u4")
    x, pairs = with_pairs(x, len(first))
    values, x = by_frequency(x)
    vocabulary = np.zeros((len(first) + len(pairs), 2), "<u4")
    vocabulary[:len(first), 0] = first
    vocabulary[len(first):, 0], vocabulary[len(first):, 1] = first[pairs[:, 0]], first[pairs[:, 1]] + 1
    vocabulary = vocabulary[values]
    payloads = idcoder.encode(x, max(1, len(vocabulary)))
    index = zlib.compress(np.array([d is None for d in doc_ids], "u1").tobytes() + np.array([d or 0 for d in doc_ids], "<i8").tobytes()
                          + lengths.astype("<u8").tobytes() + vocabulary.tobytes(), 1)
    head = struct.pack(_HEAD, _MAGIC, len(doc_ids), len(ids), len(x), len(payloads), len(vocabulary), len(index), zlib.crc32(index))
    table = b"".join(struct.pack("<II", len(p), idcoder.checksum(p)) for p in payloads)
    return b"".join([head, index, table, *payloads])


def read_segment(file) -> tuple[list[int | None], np.ndarray, np.ndarray] | None:
    """The next segment of a file: document ids, lengths and ids; None at its end."""
    head = file.read(struct.calcsize(_HEAD))
    if not head:
        return None
    magic, n_docs, n_ids, n_symbols, n_blocks, n_vocabulary, n_index, crc = struct.unpack(_HEAD, head)
    index = file.read(n_index)
    if magic != _MAGIC or zlib.crc32(index) != crc:
        raise ValueError("damaged token-id file: index")
    plain = zlib.decompress(index)
    null = np.frombuffer(plain, "u1", n_docs)
    doc_ids = [None if x else d for x, d in zip(null.tolist(), np.frombuffer(plain, "<i8", n_docs, n_docs).tolist())]
    lengths = np.frombuffer(plain, "<u8", n_docs, 9 * n_docs).astype("int64")
    vocabulary = np.frombuffer(plain, "<u4", 2 * n_vocabulary, 17 * n_docs)
    table = np.frombuffer(file.read(8 * n_blocks), "<u4").reshape(-1, 2)
    payloads = []
    for size, crc in table.tolist():
        payloads.append(file.read(size))
        if idcoder.checksum(payloads[-1]) != crc:
            raise ValueError("damaged token-id file: block")
    symbols = idcoder.decode(payloads, n_symbols, max(1, n_vocabulary))
    # both ids of a symbol side by side; what is no id goes
    both = vocabulary.reshape(-1, 2).take(symbols, axis=0)
    real = np.ones(both.shape, bool)
    np.not_equal(both[:, 1], 0, out=real[:, 1])
    both[:, 1] -= 1
    ids = both[real]
    if len(ids) != n_ids:
        raise ValueError("damaged token-id file: ids")
    return doc_ids, lengths, ids


@dataclass
class _Written(WriterCommitMessage):
    part: int
    file: str
    n_docs: int
    n_ids: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path, self.job = path, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, folder = _open(self.path)
        part = TaskContext.get().partitionId()
        name = f"{self.job}-{part:06d}-{TaskContext.get().taskAttemptId()}.ids"
        store.create_dir(folder, recursive=True)
        doc_ids, blobs, held, n_docs, n_ids = [], [], 0, 0, 0
        with store.open_output_stream(f"{folder}/{name}") as file:

            def flush() -> None:
                nonlocal doc_ids, blobs, held, n_docs, n_ids
                if doc_ids:
                    lengths = np.array([len(b) // 4 for b in blobs], "int64")
                    ids, blobs = np.frombuffer(b"".join(blobs), "<u4"), []
                    file.write(pack_segment(doc_ids, lengths, ids))
                    n_docs, n_ids = n_docs + len(doc_ids), n_ids + int(lengths.sum())
                doc_ids, blobs, held = [], [], 0

            for batch in iterator:
                for doc_id, ids in zip(batch.column(0), batch.column(1)):
                    doc_ids.append(doc_id.as_py())
                    blobs.append(ids.as_py() or b"")
                    held += len(blobs[-1]) // 4
                    if held >= SEGMENT_IDS:
                        flush()
            flush()
        return _Written(part, name, n_docs, n_ids)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, folder = _open(self.path)
        parts, before = [], 0
        for m in sorted((m for m in messages if m is not None), key=lambda m: m.part):
            if m.n_docs:
                parts.append({"file": m.file, "before": before})
            before += m.n_ids
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(f"{folder}/{_MANIFEST}") as file:
            file.write(json.dumps({"n_ids": before, "parts": parts}).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, folder = _open(self.path)
        for m in messages:
            if m is not None:
                store.delete_file(f"{folder}/{m.file}")


@dataclass
class _Part(InputPartition):
    file: str
    before: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, digest: bool):
        self.path, self.digest = path, digest

    def partitions(self) -> list[InputPartition]:
        store, folder = _open(self.path)
        with store.open_input_stream(f"{folder}/{_MANIFEST}") as file:
            return [_Part(**p) for p in json.loads(file.read())["parts"]] or [_Part("", 0)]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        store, folder = _open(self.path)
        before = partition.before
        with store.open_input_stream(f"{folder}/{partition.file}") as file:
            while (found := read_segment(file)) is not None:
                doc_ids, lengths, ids = found
                ends = np.cumsum(lengths)
                blob = memoryview(ids.astype("<u4").tobytes())
                cut = [blob[4 * (e - n):4 * e] for e, n in zip(ends.tolist(), lengths.tolist())]
                last = pa.array([zlib.crc32(b) for b in cut], pa.int64()) if self.digest else pa.array(cut, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(before + ends - lengths), pa.array(lengths), last],
                                                 names=["doc_id", "start", "n_tokens", "ids_crc32" if self.digest else "ids"])
                before += int(ends[-1])


class TokenIds(DataSource):
    """``token_ids``; with option ``digest`` it reads checksums in place of ids."""

    @classmethod
    def name(cls) -> str:
        return "token_ids"

    def _digest(self) -> bool:
        return str(self.options.get("digest", "false")).lower() == "true"

    def schema(self) -> str:
        return "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if self._digest() else "ids binary")

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self._digest())

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"])


def _encoded(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = kept(JsonIds, path), as_bytes([end_id])
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                ids = [own.ids(t.as_py() or "") + end for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return run


def write_ids(df: DataFrame, path: str, end_id: int, folder: str, partitions: int, text_col: str = "text", id_col: str = "doc_id") -> None:
    """Encodes whole texts and writes their ids, each document's followed by ``end_id``, in ascending id order.

    ``path`` is a ``tokenizers`` file; special strings inside texts are taken as the
    library's default takes them.  Null and empty texts are ``end_id`` alone.  Documents
    without an id come first, rows that repeat an id stand side by side in an order left
    open; an empty table gives a folder with a manifest and no documents.  Other columns
    are ignored.  ``folder`` must be a new one in a store that every executor reaches.
    """
    df.sparkSession.dataSource.register(TokenIds)
    slim = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    placed = slim.repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id")
    placed.mapInArrow(_encoded(path, end_id), "doc_id long, ids binary").write.format("token_ids").mode("append").save(folder)


def read_ids(spark, folder: str, digest: bool = False) -> DataFrame:
    """``doc_id, start`` (ids of all documents before), ``n_tokens`` and ``ids``, or ``ids_crc32`` with ``digest``."""
    spark.dataSource.register(TokenIds)
    return spark.read.format("token_ids").option("digest", str(digest).lower()).load(folder)
