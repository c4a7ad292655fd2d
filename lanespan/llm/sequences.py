"""Token ids in files of equal-length sequences.

A file is an Arrow IPC stream whose record batches all have the same number of sequences: one fixed-size list of ids and one of
mask bits each. All messages of a file have the same length, so batch ``i`` begins at a known byte and is read without a copy
where the file can be memory-mapped. Documents follow one another in the order of ``doc_id``; a sequence may hold the end of one and the
begin of the next. A second stream beside it lists the documents. What lies behind the last id is masked.

Files are named by the task attempt that writes them and count only once the manifest names them, so a repeated task leaves
nothing that is read twice.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanespan.llm.common import slices, stored, text_bytes
from lanespan.llm.pretokens import Words, WordTable
from lanespan.session import shared_folder

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 2
#: Ids of a sequence, sequences of a batch.
LENGTH, ROWS = 1024, 128
SLICE = 2 << 20


class LibraryCodec:
    """Ids by the tokenizers library, asked once for each distinct word."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        special = [(t.content, k) for k, t in self.tokenizer.get_added_tokens_decoder().items()]
        self.special, special_id = special[0] if special else ("", 0)
        self.table = WordTable(self.words, special_id)

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([k for own in ids for k in own], np.int64), np.array([len(own) for own in ids], np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some documents in one array, and where each document begins."""
        words = Words(data, offsets, self.special)
        slots = self.table.find(words)
        return self.table.ids(slots), np.r_[0, np.cumsum(self.table.lengths[slots])][words.of_doc]


_codecs: dict[str, LibraryCodec] = {}


def codec(path: str) -> LibraryCodec:
    if path not in _codecs:
        _codecs[path] = LibraryCodec(path)
    return _codecs[path]


def place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def schema(id_type: pa.DataType, length: int = LENGTH) -> pa.Schema:
    return pa.schema([("ids", pa.list_(id_type, length)), ("mask", pa.list_(pa.bool_(), length))])


class SequenceWriter:
    """Packs ids into sequences and writes full batches; ``close`` masks the rest of the last batch."""

    def __init__(self, sink: pa.NativeFile, id_type: pa.DataType, pad: int = END_ID):
        self.schema, self.id_type, self.pad = schema(id_type), id_type, pad
        self.out = pa.ipc.new_stream(sink, self.schema)
        self.held: list[np.ndarray] = []
        self.waiting = self.total = 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.id_type.to_pandas_dtype()))
        self.waiting += len(ids)
        self.total += len(ids)
        size = LENGTH * ROWS
        if self.waiting >= size:
            ready = np.concatenate(self.held)
            full = len(ready) // size * size
            for k in range(0, full, size):
                self._write(ready[k : k + size], size)
            self.held, self.waiting = [ready[full:]], len(ready) - full

    def _write(self, ids: np.ndarray, used: int) -> None:
        mask = np.arange(LENGTH * ROWS) < used
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(ids, self.id_type), LENGTH), pa.FixedSizeListArray.from_arrays(pa.array(mask), LENGTH)]
        self.out.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def close(self) -> None:
        if self.waiting:
            rest = np.concatenate(self.held)
            self._write(np.r_[rest, np.full(LENGTH * ROWS - len(rest), self.pad, rest.dtype)], len(rest))
        self.out.close()


class SequenceFile:
    """Random access to a file of sequences."""

    def __init__(self, uri: str):
        files, path = place(uri)
        self.source = pa.memory_map(path) if isinstance(files, fs.LocalFileSystem) else files.open_input_file(path)
        self.schema = pa.ipc.read_schema(pa.ipc.read_message(self.source))
        self.begin = self.source.tell()
        self.stride = 0
        if self.source.size() > self.begin + 8:
            pa.ipc.read_message(self.source)
            self.stride = self.source.tell() - self.begin

    def batches(self) -> int:
        return (self.source.size() - self.begin) // self.stride if self.stride else 0

    def batch(self, i: int) -> pa.RecordBatch:
        if not 0 <= i < self.batches():
            raise IndexError(i)
        self.source.seek(self.begin + i * self.stride)
        return pa.ipc.read_record_batch(pa.ipc.read_message(self.source), self.schema)

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence ``i``."""
        batch = self.batch(i // ROWS)
        return tuple(c[i % ROWS].values.to_numpy(zero_copy_only=False) for c in batch.columns)

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids at the positions from ``first`` to before ``last``; fails where one of them is masked."""
        size, parts = LENGTH * ROWS, []
        for i in range(first // size, -(-last // size)):
            a, b = max(first, i * size) - i * size, min(last, (i + 1) * size) - i * size
            ids, mask = (c.flatten().slice(a, b - a) for c in self.batch(i).columns)
            if mask.false_count:
                raise ValueError(f"masked ids among {first} to {last}")
            parts.append(ids.to_numpy())
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)


DOCS = pa.schema([("doc_id", pa.int64()), ("begin", pa.int64()), ("n_tokens", pa.int64())])
MANIFEST = "part int, file string, n_docs bigint, n_tokens bigint"


def write(docs: DataFrame, folder: str, path: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """Write all documents below ``folder``; return the stored manifest, one row per file, files in the order of ``part``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, out = codec(path), None
        part = TaskContext.get().partitionId()
        name = f"{folder}/{part:06d}-{uuid.uuid4().hex}.arrow"
        n_docs = 0
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column("text"), SLICE):
                if out is None:
                    files, at = place(name)
                    files.create_dir(os.path.dirname(at), recursive=True)
                    id_type = pa.uint16() if own.tokenizer.get_vocab_size() <= 1 << 16 else pa.uint32()
                    sink, index_sink = files.open_output_stream(at), files.open_output_stream(at + ".docs")
                    out, index = SequenceWriter(sink, id_type, end_id), pa.ipc.new_stream(index_sink, DOCS)
                ids, begins = own.encode(data, offsets)
                counts = np.diff(begins) + 1
                ends = out.total + np.cumsum(counts)
                out.add(np.insert(ids, begins[1:], end_id))
                columns = [batch.column("doc_id").slice(lo, hi - lo), pa.array(ends - counts), pa.array(counts)]
                index.write_batch(pa.RecordBatch.from_arrays(columns, schema=DOCS))
                n_docs += hi - lo
        if out is not None:
            out.close()
            index.close()
            sink.close()
            index_sink.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [name], "n_docs": [n_docs], "n_tokens": [out.total]})

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_bytes().alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return stored(ordered.mapInArrow(run, MANIFEST), "manifest")


def read(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files that the manifest names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = SequenceFile(row["file"])
                files, at = place(row["file"] + ".docs")
                with files.open_input_stream(at) as source:
                    for docs in pa.ipc.open_stream(source):
                        begins, counts = docs.column("begin").to_numpy(), docs.column("n_tokens").to_numpy()
                        first = int(begins[0])
                        ids = own.ids(first, int(begins[-1] + counts[-1])).astype("<u4")
                        sums = [zlib.crc32(ids[a : a + n]) for a, n in zip((begins - first).tolist(), counts.tolist(), strict=True)]
                        columns = [docs.column("doc_id"), pa.array(begins + row["start"]), docs.column("n_tokens"), pa.array(sums, pa.int64())]
                        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    placed = manifest.withColumn("start", F.coalesce(before, F.lit(0)))
    spread = placed.select("file", "start").repartition(max(1, manifest.count()))
    return spread.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def encode_and_read(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """Write all documents and read them back: ``doc_id, start, n_tokens, ids_crc32``.

    Null text counts as empty and has the end id alone. Null ids come first; rows that share an id are in the order of their texts.
    An empty table gives no file and no rows.
    """
    return read(write(docs, shared_folder(docs.sparkSession, "sequences"), path))
