"""Media columns: lossless 8-bit audio, and features with time spans.

A media table keeps each row's bytes as a WAV file (unsigned 8-bit samples,
one channel). Reading it back, the signal is resampled by a polyphase filter,
overlapped frames become log-mel energies, and hysteresis on the frame energy
cuts the time line into segments. Each segment keeps its span in seconds and a
tensor of fixed shape: log-mel energies averaged over ``BINS`` equal parts.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .shared import filesystem, publish, scratch, slices

UNIT = 192
RATE, UP, DOWN, HALF_TAPS, ONE = 12_000, 2, 3, 12, 1 << 15
FRAME, HOP, MELS, BINS = 256, 128, 32, 4
#: Decibels above and below the median at which a segment begins and ends.
RISE, FALL = 1.0, 0.5
#: Frames, or outputs of a phase, that are computed at once.
BLOCKS = 4096
MEDIA = "doc_id long, n_bytes long, media binary"
DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_segments long"
MANIFEST = "segments string, docs string, n_segments long, n_docs long"
STORED = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256")


def payload(text: str | None) -> tuple[int, bytes]:
    """A text's UTF-8 length, and its bytes with spaces up to a positive multiple of ``UNIT``."""
    raw = (text or "").encode()
    return len(raw), raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, b" ")


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples


def from_wav(media: bytes) -> tuple[int, memoryview]:
    """Sample rate and samples; chunks other than the format's and the data's are passed over."""
    view, at, rate = memoryview(media), 12, 0
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    while at + 8 <= len(view):
        name, n = struct.unpack_from("<4sI", view, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", view, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("not 8-bit PCM of one channel")
        if name == b"data":
            return rate, view[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no samples")


@cache
def _phases() -> np.ndarray:
    """The polyphase filter: one row of whole-number taps for each of the ``UP`` output phases.

    Output j lies at input time j * DOWN / UP; its phase j % UP picks the taps
    of a windowed sinc that cuts off at the lower of the two Nyquist rates.
    Taps are scaled to ``ONE`` and rounded, so that sums are exact in any order.
    """
    at = np.arange(2 * HALF_TAPS + 1)[None, :] - HALF_TAPS - (np.arange(UP)[:, None] * DOWN / UP) % 1
    cut = min(1.0, UP / DOWN)
    window = np.where(np.abs(at) <= HALF_TAPS, 0.5 + 0.5 * np.cos(np.pi * at / HALF_TAPS), 0)
    taps = np.sinc(cut * at) * window
    return np.round(ONE * taps / taps.sum(axis=1, keepdims=True))


@cache
def _mel() -> np.ndarray:
    """Triangular filters evenly spaced in mel, by spectrum bin."""
    rate = RATE * UP / DOWN
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(20.0), mel(rate / 2), MELS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(FRAME, 1 / rate)[:, None]
    up, down = (f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down))


@cache
def _window() -> np.ndarray:
    return np.hanning(FRAME + 1)[:-1]


def resample(samples: np.ndarray) -> np.ndarray:
    """Unsigned 8-bit samples (a multiple of ``DOWN``) at UP / DOWN of their rate, as doubles around 0.

    Each phase filters the input at every DOWN-th sample, so only outputs that are kept are computed.
    """
    taps = _phases()
    starts = [p * DOWN // UP for p in range(UP)]
    span = 2 * HALF_TAPS + 1 + max(starts)
    padded = np.full(len(samples) + 2 * HALF_TAPS + DOWN, 128, np.uint8)
    padded[HALF_TAPS : HALF_TAPS + len(samples)] = samples
    n = len(samples) // DOWN
    out = np.empty((n, UP))
    for a in range(0, n, BLOCKS):
        m = min(BLOCKS, n - a)
        x = padded[a * DOWN : (a + m - 1) * DOWN + span].astype(float) - 128
        for p, start in enumerate(starts):
            frames = np.lib.stride_tricks.sliding_window_view(x[start:], taps.shape[1])[::DOWN][:m]
            out[a : a + m, p] = frames @ taps[p]
    return out.ravel() / (128 * ONE)


def log_mel(signal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel energies and energy in decibels of overlapped frames; the last frame is filled with silence."""
    n = max(1, -(-(len(signal) - FRAME) // HOP) + 1)
    signal = np.pad(signal, (0, max(0, (n - 1) * HOP + FRAME - len(signal))))
    frames = np.lib.stride_tricks.sliding_window_view(signal, FRAME)[::HOP]
    mels, energy = np.empty((n, MELS)), np.empty(n)
    for a in range(0, n, BLOCKS):
        x = frames[a : a + BLOCKS] * _window()
        spectrum = np.fft.rfft(x)
        power = spectrum.real**2 + spectrum.imag**2
        mels[a : a + BLOCKS] = np.log(power @ _mel() + 1e-6)
        energy[a : a + BLOCKS] = 10 * np.log10((x * x).mean(axis=1) + 1e-9)
    return mels, energy


def hysteresis(energy: np.ndarray, rise: float = RISE, fall: float = FALL) -> np.ndarray:
    """Start and end frames of segments: from a frame at ``rise`` above the median to the next at ``fall`` below it."""
    middle = np.median(energy)
    mark = np.where(energy >= middle + rise, 1, np.where(energy <= middle - fall, -1, 0))
    last = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    on = np.where(last >= 0, mark[last], -1) == 1
    edge = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(np.int8), [0]])))
    return edge.reshape(-1, 2)


def analyse(media: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans in seconds (n, 2), tensors (n, BINS, MELS) and the whole signal's tensor (BINS, MELS), in steps of 1/64."""
    rate, view = from_wav(media)
    mels, energy = log_mel(resample(np.frombuffer(view, np.uint8)))
    spans = hysteresis(energy)
    tensors = _pool(mels, np.concatenate([spans, [[0, len(mels)]]]))
    seconds = HOP / (rate * UP / DOWN)
    return np.round(spans * seconds, 6), tensors[:-1], tensors[-1]


def _pool(mels: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Means over BINS equal parts of each span; a part of a short span holds the frame at its place."""
    sums = np.concatenate([np.zeros((1, MELS)), np.cumsum(mels, axis=0, dtype=float)])
    width = (spans[:, 1] - spans[:, 0])[:, None]
    a = spans[:, :1] + np.arange(BINS) * width // BINS
    b = np.maximum(a + 1, spans[:, :1] + np.arange(1, BINS + 1) * width // BINS)
    return (np.round((sums[b] - sums[a]) / (b - a)[..., None] * 64) / 64).astype(np.float16)


def media_table(docs: DataFrame, out: str) -> DataFrame:
    """Write doc_id, n_bytes and the WAV of every row as a Parquet table at ``out`` and return it.

    A null text is an empty one; repeated rows repeat; an empty table stays
    empty; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = [payload(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in made], pa.int64()), pa.array([to_wav(p) for _, p in made], pa.binary())], names=["doc_id", "n_bytes", "media"])

    docs.select("doc_id", "text").mapInArrow(run, MEDIA).write.option("compression", "zstd").parquet(out)
    return docs.sparkSession.read.parquet(out)


def tensor_files(media: DataFrame, out: str) -> DataFrame:
    """Write the features of a media table below ``out``; return the manifest, one row a task that had rows.

    ``*.segments.arrow`` has a row a segment: doc_id, its number, its span in
    seconds and its tensor (fixed shape BINS x MELS, half floats in steps of
    1/64). ``*.docs.arrow`` has a row a media row: what was stored and read
    back, where its segments lie in the other file, and the whole signal's
    tensor. Rows without segments, repeated rows and null doc_ids keep their
    row; media of any length are analysed in blocks.
    """
    kind = pa.fixed_shape_tensor(pa.float16(), [BINS, MELS])
    of_segments = pa.schema([("doc_id", pa.int64()), ("segment", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("tensor", kind)])
    of_docs = pa.schema([*((n, pa.string() if n.endswith("sha256") else pa.int64()) for n in STORED), ("first", pa.int64()), ("n_segments", pa.int64()), ("tensor", kind)])
    fs, root = filesystem(out)
    fs.create_dir(root, recursive=True)

    def tensors(values: list[np.ndarray]) -> pa.Array:
        flat = np.concatenate([np.empty(0, np.float16), *(v.ravel() for v in values)])
        return pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(pa.array(flat), BINS * MELS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(out)
        names = [f"part-{TaskContext.get().partitionId():07d}.{k}.arrow" for k in ("segments", "docs")]
        staged = [f"{root}/.{n}-{uuid.uuid4().hex}" for n in names]
        sinks, writers, at, n_docs = [], [], 0, 0
        for batch in slices(batches):
            if not writers:
                sinks = [fs.open_output_stream(s) for s in staged]
                writers = [pa.ipc.new_file(sink, schema) for sink, schema in zip(sinks, (of_segments, of_docs))]
            docs, segments, whole, some = [], [], [], []
            for doc, n, wav in zip(*(batch.column(i).to_pylist() for i in range(3))):
                _, samples = from_wav(wav)
                spans, parts, all_ = analyse(wav)
                docs.append((doc, n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(wav), hashlib.sha256(wav).hexdigest(), at, len(spans)))
                segments += [(doc, i, a, b) for i, (a, b) in enumerate(spans.tolist())]
                whole.append(all_)
                some.append(parts)
                at += len(spans)
            for writer, schema, rows, values in ((writers[0], of_segments, segments, some), (writers[1], of_docs, docs, whole)):
                columns = zip(*rows) if rows else [()] * (len(schema) - 1)
                writer.write_batch(pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(columns, schema)), tensors(values)], schema=schema))
            n_docs += len(docs)
        if not writers:
            return
        for writer, sink, temp, name in zip(writers, sinks, staged, names):
            writer.close()
            sink.close()
            publish(fs, temp, f"{root}/{name}")
        yield pa.RecordBatch.from_pydict({"segments": [f"{out}/{names[0]}"], "docs": [f"{out}/{names[1]}"], "n_segments": [at], "n_docs": [n_docs]})

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, MANIFEST)


def read_features(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Per media row, from the files of ``tensor_files``: what was stored, and a digest of its spans and tensors.

    A file is read batch by batch, and each row's tensors are taken as views of the file's own buffers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with _opened(row["segments"]) as segments, _opened(row["docs"]) as docs:
                    for i in range(docs.num_record_batches):  # the two files were written batch by batch together
                        yield digest(docs.get_batch(i), segments.get_batch(i))

    def digest(docs: pa.RecordBatch, segments: pa.RecordBatch) -> pa.RecordBatch:
        spans = np.stack([segments.column("start_s").to_numpy(), segments.column("end_s").to_numpy()], axis=1)
        parts, whole = (b.column("tensor").to_numpy_ndarray() for b in (segments, docs))
        counts = docs.column("n_segments").to_numpy()
        ends = np.cumsum(counts)
        features = []
        for i, (a, b) in enumerate(zip(ends - counts, ends)):
            crc = zlib.crc32(whole[i].tobytes(), zlib.crc32(parts[a:b].tobytes(), zlib.crc32(spans[a:b].tobytes())))
            features.append(f"segments={b - a};seconds={(spans[a:b, 1] - spans[a:b, 0]).sum():.3f};mel={whole[i].mean(dtype=float):.2f};tensors={crc:08x}")
        return pa.RecordBatch.from_arrays([*docs.columns[: len(STORED)], pa.array(features, pa.string()), docs.column("n_segments")], names=[*STORED, "feature", "n_segments"])

    n = max(1, spark.sparkContext.defaultParallelism)
    return manifest.repartition(n).mapInArrow(run, DIGEST)


@contextmanager
def _opened(uri: str) -> Iterator[pa.ipc.RecordBatchFileReader]:
    fs, path = filesystem(uri)
    with fs.open_input_file(path) as f, pa.ipc.open_file(f) as reader:
        yield reader


def stored_and_read(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: the payload as stored and read back, and a digest of the features as stored and read back.

    The manifest, one row a task, comes to the driver; the rest stays in files.
    """
    media = media_table(docs, scratch(spark, "media"))
    made = tensor_files(media, scratch(spark, "tensors")).collect()
    return read_features(spark, spark.createDataFrame(made, MANIFEST))
