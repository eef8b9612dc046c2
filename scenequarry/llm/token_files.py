"""Token ids in Arrow files of equal-length sequences with masks.

A shard is two Arrow IPC files. ``*.tokens.arrow`` holds record batches with
the columns ``ids`` (fixed-size list of ``seq_len`` unsigned integers) and
``mask`` (fixed-size list of booleans): a reader maps the file and finds
sequence i in batch ``i // rows_per_batch`` without copying. ``*.docs.arrow``
holds where each document lies in the shard. Shards follow one another in
ascending document order, and a manifest gives each shard's first token.

Rows without a text count as empty and get the end id alone; rows that repeat
a ``doc_id`` each keep their place; a null ``doc_id`` sorts first. An empty
table gives no shards and no rows. Columns other than those used are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import filesystem, publish, slices
from .word_cache import cached_encoder

SEQ_LEN, ROWS_PER_BATCH = 2048, 64
MANIFEST = "shard int, tokens string, docs string, n_docs long, n_tokens long, n_sequences long"


class ShardWriter:
    """Writes a stream of ids as full sequences; the last one is padded and masked."""

    def __init__(self, sink, width: np.dtype, seq_len: int = SEQ_LEN, rows: int = ROWS_PER_BATCH):
        self.seq_len, self.rows, self.width = seq_len, rows, width
        self.schema = pa.schema([
            ("ids", pa.list_(pa.from_numpy_dtype(width), seq_len)),
            ("mask", pa.list_(pa.bool_(), seq_len)),
        ])
        self.out = pa.ipc.new_file(sink, self.schema)
        self.held: list[np.ndarray] = []
        self.n_held = self.n_tokens = self.n_sequences = 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_tokens += len(ids)
        if self.n_held >= self.seq_len * self.rows:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        flat = np.concatenate(self.held) if self.held else np.empty(0, self.width)
        step = self.seq_len * self.rows
        while len(flat) >= step or (last and len(flat)):
            block, flat = flat[:step], flat[step:]
            n = -(-len(block) // self.seq_len)
            ids = np.zeros(n * self.seq_len, self.width)
            ids[: len(block)] = block
            mask = np.arange(n * self.seq_len) < len(block)
            self.out.write_batch(pa.record_batch([
                pa.FixedSizeListArray.from_arrays(pa.array(ids), self.seq_len),
                pa.FixedSizeListArray.from_arrays(pa.array(mask), self.seq_len),
            ], schema=self.schema))
            self.n_sequences += n
        self.held, self.n_held = [flat], len(flat)

    def close(self) -> None:
        self._flush(True)
        self.out.close()


class TokenShard:
    """Random access to a shard; local files are mapped, so views copy nothing."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        local = fs.type_name == "local"
        self.source = pa.memory_map(path) if local else fs.open_input_file(path)
        self.reader = pa.ipc.open_file(self.source)
        self.seq_len = self.reader.schema.field("ids").type.list_size
        self.n_batches = self.reader.num_record_batches

    def block(self, b: int) -> tuple[np.ndarray, pa.Array]:
        """The ids of batch b, sequences by columns, and their mask."""
        batch = self.reader.get_batch(b)
        ids = batch.column(0)
        flat = ids.flatten().to_numpy(zero_copy_only=True)
        return flat.reshape(-1, self.seq_len), batch.column(1)

    def sequence(self, i: int, rows_per_batch: int = ROWS_PER_BATCH) -> tuple[np.ndarray, np.ndarray]:
        ids, mask = self.block(i // rows_per_batch)
        row = i % rows_per_batch
        return ids[row], mask[row].values.to_numpy(zero_copy_only=False)

    def spans(self, starts: np.ndarray, lengths: np.ndarray) -> Iterator[np.ndarray]:
        """The ids of ascending spans, one batch in hand at a time."""
        b, base, flat = -1, 0, np.empty(0, np.uint32)
        for start, n in zip(starts, lengths):
            parts, at, end = [], int(start), int(start + n)
            while at < end:
                while at >= base + len(flat):
                    base, b = base + len(flat), b + 1
                    flat = self.block(b)[0].reshape(-1)
                got = flat[at - base : end - base]
                parts.append(got)
                at += len(got)
            yield parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else flat[:0]


def write_tokens(docs: DataFrame, out: str, tokenizer: str, end_id: int, seq_len: int = SEQ_LEN, special_as_text: bool = False) -> DataFrame:
    """Write ``docs`` (doc_id, text) below ``out``; return the manifest with ``first_token``.

    One range shuffle puts documents in order; AQE sets the number of shards.
    The manifest has one row a shard, and only it comes to the driver.
    """
    spark = docs.sparkSession
    fs, root = filesystem(out)
    fs.create_dir(root, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        encoder = cached_encoder(tokenizer, special_as_text)
        width = np.dtype(np.uint16 if max(end_id + 1, encoder.tokenizer.get_vocab_size()) <= 1 << 16 else np.uint32)
        fs, root = filesystem(out)
        names = [f"part-{shard:07d}.{kind}.arrow" for kind in ("tokens", "docs")]
        staged = [f"{root}/.{n}-{uuid.uuid4().hex}" for n in names]
        tail = np.array([end_id], "<u4").tobytes()
        sinks, writer, index, n_docs, at = [], None, None, 0, 0
        for batch in slices(batches):
            if writer is None:
                sinks = [fs.open_output_stream(s) for s in staged]
                writer = ShardWriter(sinks[0], width, seq_len)
                index = pa.ipc.new_file(sinks[1], pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())]))
            texts = [t or "" for t in batch.column(1).to_pylist()]
            lengths = []
            for ids in encoder.encode(texts):
                ids = np.frombuffer(ids + tail, "<u4").astype(width)
                lengths.append(len(ids))
                writer.add(ids)
            lengths = np.asarray(lengths, np.int64)
            starts = at + np.cumsum(lengths) - lengths
            index.write_batch(pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(starts), pa.array(lengths)], names=["doc_id", "start", "n_tokens"]))
            at, n_docs = at + int(lengths.sum()), n_docs + len(lengths)
        if writer is None:
            return
        writer.close()
        index.close()
        for sink, temp, name in zip(sinks, staged, names):
            sink.close()
            publish(fs, temp, f"{root}/{name}")
        yield pa.RecordBatch.from_pydict({
            "shard": pa.array([shard], pa.int32()), "tokens": [f"{out}/{names[0]}"], "docs": [f"{out}/{names[1]}"],
            "n_docs": [n_docs], "n_tokens": [at], "n_sequences": [writer.n_sequences],
        })

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    shards = sorted(ordered.mapInArrow(write, MANIFEST).collect(), key=lambda r: r.shard)
    first, rows = 0, []
    for r in shards:
        rows.append((*r, first))
        first += r.n_tokens
    return spark.createDataFrame(rows, MANIFEST + ", first_token long")


def read_documents(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Per document, from the files: its place in the whole stream, its length and the crc32 of its ids."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = TokenShard(row["tokens"])
                fs, path = filesystem(row["docs"])
                with fs.open_input_file(path) as f, pa.ipc.open_file(f) as docs:
                    yield digest(shard, docs.read_all(), row)

    def digest(shard: TokenShard, table: pa.Table, row: dict) -> pa.RecordBatch:
        starts, lengths = table["start"].to_numpy(), table["n_tokens"].to_numpy()
        crcs = [zlib.crc32(ids.astype("<u4").tobytes()) for ids in shard.spans(starts, lengths)]
        columns = [table["doc_id"].combine_chunks(), pa.array(starts + row["first_token"]), pa.array(lengths), pa.array(crcs, pa.int64()), pa.array([row["shard"]] * len(crcs), pa.int32())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "shard"])

    spread = manifest.select("shard", "tokens", "docs", "first_token")
    n = max(1, spark.sparkContext.defaultParallelism)
    spread = spread.repartition(n)
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int")
