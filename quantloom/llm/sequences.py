"""Token ids as Arrow files of equal-length sequences.

A file is in the Arrow IPC file format: record batches of ``ids`` and ``mask``, fixed-size lists of the sequence length,
uncompressed, so a memory-mapped reader reaches any sequence without a copy. All batches but the last have the same
number of sequences; only the last sequence is padded, and its mask says where. A second file beside it lists the
documents: their ids, where they start among the file's tokens, and how many tokens they have.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_name, filesystem, new_path, small_batches
from .encoding import encoder

SEQUENCE, BATCH = 2048, 128
#: Tokens, and documents, after which a file is closed and the next one begun.
FILE_TOKENS, FILE_DOCUMENTS = 64 << 20, 1 << 20
#: Ids stand as strings, in which numbers of any size and names are whole.
DOCUMENTS = pa.schema([("doc_id", pa.string()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class SequenceWriter:
    """Cuts a stream of ids into sequences. Holds one batch of them."""

    def __init__(self, fs, path: str, width: type, sequence: int = SEQUENCE, batch: int = BATCH):
        self.sequence, self.width, self.room = sequence, np.dtype(width), sequence * batch
        kind = pa.from_numpy_dtype(self.width)
        self.schema = pa.schema(
            [("ids", pa.list_(pa.field("item", kind, False), sequence)), ("mask", pa.list_(pa.field("item", pa.bool_(), False), sequence))],
            metadata={"sequence": str(sequence), "batch": str(batch)},
        )
        self.sink, self.index = fs.open_output_stream(path), fs.open_output_stream(f"{path}.docs")
        self.file, self.listing = pa.ipc.new_file(self.sink, self.schema), pa.ipc.new_file(self.index, DOCUMENTS)
        self.held, self.size, self.tokens, self.docs, self.n_docs = [], 0, 0, [], 0

    def add(self, doc_id: str | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, self.tokens, len(ids)))
        self.n_docs += 1
        self.tokens += len(ids)
        self.held.append(ids.astype(self.width))
        self.size += len(ids)
        if self.size >= self.room:
            self._write(self.size - self.size % self.room)
        if len(self.docs) >= 10_000:
            self._list()

    def _write(self, n: int, pad: int = 0) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, self.width)
        now, rest = np.concatenate([ids[:n], np.zeros(pad, self.width)]), ids[n:]
        mask = np.arange(len(now)) < n
        for at in range(0, len(now), self.room):
            arrays = [pa.FixedSizeListArray.from_arrays(pa.array(x[at : at + self.room]), type=t) for x, t in ((now, self.schema.types[0]), (mask, self.schema.types[1]))]
            self.file.write_batch(pa.record_batch(arrays, schema=self.schema))
        self.held, self.size = ([rest] if len(rest) else []), len(rest)

    def _list(self) -> None:
        columns = list(zip(*self.docs)) or [(), (), ()]
        self.listing.write_batch(pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, DOCUMENTS)], schema=DOCUMENTS))
        self.docs = []

    def close(self) -> None:
        if self.size:
            self._write(self.size, -self.size % self.sequence)
        self._list()
        for x in (self.file, self.listing, self.sink, self.index):
            x.close()


class SequenceFile:
    """Random access to the sequences of a file; views into its buffers, copied only where masks are unpacked."""

    def __init__(self, fs, path: str):
        self.source = pa.memory_map(path) if fs.type_name == "local" else fs.open_input_file(path)
        self.reader = pa.ipc.open_file(self.source)
        meta = self.reader.schema.metadata
        self.sequence, self.batch = int(meta[b"sequence"]), int(meta[b"batch"])
        self.fs, self.path = fs, path
        self._last = (-1, None)

    def _batch(self, number: int) -> pa.RecordBatch:
        if self._last[0] != number:
            self._last = (number, self.reader.get_batch(number))
        return self._last[1]

    def documents(self) -> Iterator[pa.RecordBatch]:
        """The list of the documents, a batch at a time."""
        with self.fs.open_input_file(f"{self.path}.docs") as f:
            listing = pa.ipc.open_file(f)
            for i in range(listing.num_record_batches):
                yield listing.get_batch(i)

    def __len__(self) -> int:
        n = self.reader.num_record_batches
        return (n - 1) * self.batch + self._batch(n - 1).num_rows if n else 0

    def _values(self, column: int, k: int):
        batch, row = divmod(k, self.batch)
        array = self._batch(batch).column(column)
        return array.flatten()[row * self.sequence : (row + 1) * self.sequence]

    def ids(self, k: int) -> np.ndarray:
        return self._values(0, k).to_numpy(zero_copy_only=True)

    def mask(self, k: int) -> np.ndarray:
        return self._values(1, k).to_numpy(zero_copy_only=False)

    def tokens(self, start: int, n: int) -> Iterator[np.ndarray]:
        """The ids of a span of the file's stream, in views of one batch each."""
        room = self.sequence * self.batch
        while n:
            batch, at = divmod(start, room)
            values = self._batch(batch).column(0).flatten().to_numpy(zero_copy_only=True)[at : at + n]
            yield values
            start, n = start + len(values), n - len(values)

    def close(self) -> None:
        self._last = (-1, None)
        self.source.close()


MANIFEST = "part int, file int, path string, docs bigint, tokens bigint"


def write_sequences(df: DataFrame, vocabulary: str, folder: str, text: str = "text", doc_id: str = "doc_id", end_id: int = 2, sequence: int = SEQUENCE) -> DataFrame:
    """``part, file, path, docs, tokens`` of the files written; by ``part`` and ``file``, they hold the rows in ascending ``doc_id`` order.

    A task closes a file at ``FILE_TOKENS`` tokens or ``FILE_DOCUMENTS`` documents and begins the next one.
    """
    small_batches(df.sparkSession)
    with open(vocabulary) as f:
        largest = max(end_id, *json.load(f)["model"]["vocab"].values())
    width = np.uint16 if largest < 1 << 15 or largest < (1 << 16) - 256 else np.uint32
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = df.select(F.col(f"`{doc_id}`").alias("doc_id"), body.alias("text"), F.xxhash64(body).alias("th"))
    rows = rows.repartitionByRange("doc_id", "th").sortWithinPartitions("doc_id", "th")

    def run(batches):
        encode, writer, number, name = encoder(vocabulary).encode, None, 0, ""
        fs, root = filesystem(folder)

        def closed():
            writer.close()
            return pd.DataFrame({"part": [TaskContext.get().partitionId()], "file": [number], "path": [f"{folder}/{name}"], "docs": [writer.n_docs], "tokens": [writer.tokens]})

        for batch in batches:
            for d, t in zip(batch["doc_id"], batch["text"]):
                if writer is None:
                    fs.create_dir(root, recursive=True)
                    name = f"{uuid.uuid4().hex}.arrow"
                    writer = SequenceWriter(fs, f"{root}/{name}", width, sequence)
                writer.add(d, np.append(np.frombuffer(encode(t), "<u4"), np.uint32(end_id)))
                if writer.tokens >= FILE_TOKENS or writer.n_docs >= FILE_DOCUMENTS:
                    yield closed()
                    writer, number = None, number + 1
        if writer:
            yield closed()

    return rows.select(as_name(rows, "doc_id").alias("doc_id"), "text").mapInPandas(run, MANIFEST)


def read_documents(files: DataFrame) -> DataFrame:
    """``doc_id`` (string), ``start, n_tokens, ids_crc32`` of each document in the files ``path``, whose tokens begin at ``base``."""

    def run(batches):
        for batch in batches:
            for path, base in zip(batch["path"], batch["base"]):
                fs, name = filesystem(path)
                file = SequenceFile(fs, name)
                for docs in file.documents():
                    starts, counts = docs.column(1).to_numpy(), docs.column(2).to_numpy()
                    sums = []
                    for s, n in zip(starts.tolist(), counts.tolist()):
                        crc = 0
                        for ids in file.tokens(s, n):
                            crc = zlib.crc32(ids.astype("<u4"), crc)
                        sums.append(crc)
                    yield pd.DataFrame({"doc_id": docs.column(0).to_pandas(), "start": starts + base, "n_tokens": counts, "ids_crc32": np.array(sums, dtype=np.int64)})
                file.close()

    return files.mapInPandas(run, "doc_id string, start bigint, n_tokens bigint, ids_crc32 bigint")


def tokenise(df: DataFrame, vocabulary: str, text: str = "text", doc_id: str = "doc_id", end_id: int = 2, sequence: int = SEQUENCE) -> DataFrame:
    """Writes the ids of every row of ``df`` (null text: empty, each row closed by ``end_id``) and reads them back.

    Rows with a null id come first; rows with equal ids are in the order of a hash of their texts, and each keeps its
    own entry. Ids may be of any ordered type that its string form casts back to. ``start`` counts the ids of all rows before. An empty table gives an empty result.
    """
    spark = df.sparkSession
    manifest = new_path(spark, "sequences")
    write_sequences(df, vocabulary, new_path(spark, "arrow"), text, doc_id, end_id, sequence).write.parquet(manifest)
    files = spark.read.schema(MANIFEST).parquet(manifest)
    # a row per file
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.select("path", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    return read_documents(placed.repartition(max(1, files.count()))).withColumn("doc_id", F.col("doc_id").cast(df.schema[doc_id].dataType))
