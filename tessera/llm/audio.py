"""Audio columns: payloads as 8-bit mono WAV, and features of what is read back.

Samples are resampled by a polyphase filter (a windowed sinc, one branch for each
phase), cut into overlapping Hann frames, and turned into log-mel bands. Bands
are stored as patches of one fixed shape (frames x bands, the last one padded with
the floor), an Arrow fixed-shape tensor column beside each patch's time span, as
an IPC stream. Segments of sound come from frame energies with hysteresis: one
opens above the high level and closes below the low one.

Media and features are tables in the shared folder: the first has each payload's file, the second is computed
from the files that are read back and has the tensors, and results come from the second, read back.

A null or empty payload becomes 64 zero bytes. Equal payloads give equal bytes
and features; each row is computed alone, whole, in slices of FRAMES_AT_ONCE frames, so beside a payload's own
bytes and its tensors a task holds a slice of samples. Repeated rows stay rows; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import written

RATE, UP, DOWN = 16_000, 1, 2
FRAME, HOP, BANDS, PATCH = 256, 128, 16, 32
HIGH_DB, LOW_DB, FLOOR_DB = -24.0, -30.0, -80.0
UNIT, FRAMES_AT_ONCE = 64, 4096


def wav(samples: bytes, rate: int = RATE) -> bytes:
    """A RIFF file of unsigned 8-bit mono samples."""
    pad = b"\0" * (len(samples) % 2)
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8)
    body = b"WAVE" + fmt + struct.pack("<4sI", b"data", len(samples)) + samples + pad
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def samples_of(media: bytes) -> tuple[int, np.ndarray]:
    """(rate, samples) of a file that wav() made."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        kind, size = struct.unpack_from("<4sI", media, at)
        if kind == b"fmt ":
            form, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (form, channels, bits) != (1, 1, 8):
                raise ValueError("only 8-bit mono PCM")
        elif kind == b"data":
            return rate, np.frombuffer(media, np.uint8, size, at + 8)
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


@lru_cache(8)
def phases(up: int, down: int, half: int = 8) -> tuple[np.ndarray, int]:
    """The filter's branches, up x taps, and its delay."""
    taps = 2 * half * max(up, down) + 1
    t = np.arange(taps) - taps // 2
    h = np.sinc(t / max(up, down)) * np.hamming(taps)
    h *= up / h.sum()
    return np.pad(h, (0, -taps % up)).reshape(-1, up).T.copy(), taps // 2


def resampled(x: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """x at up / down of its rate. Each of the up output phases has a branch of
    the filter, and this splits into down branches over the input's phases, so
    no sample is computed that isn't kept."""
    h, delay = phases(up, down)
    taps = h.shape[1]
    n = -(-len(x) * up // down)
    padded = np.concatenate([np.zeros(taps), x, np.zeros(2 * taps + down)])
    out = np.zeros(n)
    for first in range(min(up, n)):
        at = first * down + delay
        branch, start = h[at % up, ::-1], at // up + 1
        count = len(range(first, n, up))
        for q in range(min(down, taps)):
            w = branch[q::down]
            z = padded[start + q :: down][: count + len(w) - 1]
            out[first::up] += np.correlate(z, w, "valid")
    return out


@lru_cache(8)
def mel_filters(rate: int, frame: int, bands: int) -> np.ndarray:
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(20.0), mel(rate / 2), bands + 2) / 2595) - 1)
    f = np.fft.rfftfreq(frame, 1 / rate)[:, None]
    lo, mid, hi = edges[:-2], edges[1:-1], edges[2:]
    return np.maximum(0, np.minimum((f - lo) / (mid - lo), (hi - f) / (hi - mid)))


class Samples:
    """8-bit samples as numbers from -1 to 1 at up / down of their rate, by spans."""

    def __init__(self, raw: np.ndarray, up: int = UP, down: int = DOWN):
        self.raw, self.up, self.down, self.size = raw, up, down, -(-len(raw) * up // down)

    def span(self, first: int, last: int) -> np.ndarray:
        """Samples first..last-1; the filter sees as much before and behind them as it reaches."""
        reach = len(phases(self.up, self.down)[0][0]) + self.down
        block = max(first // self.up - -(-reach // self.down), 0)  # a block: down samples in, up samples out
        start = block * self.down
        end = min(-(-last // self.up) * self.down + reach, len(self.raw))
        x = (self.raw[start:end].astype(np.float64) - 128) / 128
        return resampled(x, self.up, self.down)[first - block * self.up : last - block * self.up]


def log_mel(x: np.ndarray | Samples, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """(log-mel bands in dB, frame energies in dB) of overlapping frames; a short tail is padded."""
    size = x.size if isinstance(x, Samples) else len(x)
    n = max(1, -(-(size - FRAME) // HOP) + 1)
    window, filters = np.hanning(FRAME), mel_filters(rate, FRAME, BANDS)
    bands, energy = np.empty((n, BANDS), np.float32), np.empty(n)
    for a in range(0, n, FRAMES_AT_ONCE):
        b = min(a + FRAMES_AT_ONCE, n)
        first, last = a * HOP, (b - 1) * HOP + FRAME
        own = x.span(first, min(last, size)) if isinstance(x, Samples) else x[first:last]
        own = np.pad(own, (0, last - first - len(own)))
        part = np.lib.stride_tricks.sliding_window_view(own, FRAME)[::HOP]
        power = np.abs(np.fft.rfft(part * window)) ** 2 / FRAME
        bands[a:b] = np.round(np.maximum(FLOOR_DB, 10 * np.log10(power @ filters + 1e-9)), 3)
        energy[a:b] = np.maximum(FLOOR_DB, 10 * np.log10((part**2).mean(axis=1) + 1e-9))
    return bands, energy


def segments(energy: np.ndarray, high: float = HIGH_DB, low: float = LOW_DB) -> list[tuple[int, int]]:
    """Frames first..last-1 of each sound: from a frame above high back to where
    it rose above low and on to where it falls below."""
    on = energy >= low
    edge = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(np.int8), [0]])))
    spans = edge.reshape(-1, 2)
    loud = np.concatenate([[0], np.cumsum(energy >= high)])
    return [(int(a), int(b)) for a, b in spans if loud[b] > loud[a]]


def tensors(bands: np.ndarray, rate: float) -> bytes:
    """An IPC stream (start_s, end_s, mel: fixed_shape_tensor[PATCH, BANDS])."""
    n = -(-len(bands) // PATCH)
    patches = np.full((n * PATCH, BANDS), FLOOR_DB, np.float32)
    patches[: len(bands)] = bands
    column = pa.FixedShapeTensorArray.from_numpy_ndarray(patches.reshape(n, PATCH, BANDS))
    start = np.arange(n) * PATCH * HOP / rate
    ends = np.minimum(np.arange(1, n + 1) * PATCH, len(bands))
    end = ((ends - 1) * HOP + FRAME) / rate
    table = pa.RecordBatch.from_arrays([pa.array(start), pa.array(end), column], names=["start_s", "end_s", "mel"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_batch(table)
    return sink.getvalue().to_pybytes()


def read_tensors(stream: bytes) -> pa.Table:
    return pa.ipc.open_stream(stream).read_all()


SPANS = "array<struct<start_s: double, end_s: double>>"
STORED = "doc_id long, n_bytes long, media binary"
COLUMNS = f"doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, frames long, spans {SPANS}, tensors binary"


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The file of each payload."""
    for batch in batches:
        contents = [x.as_py() or b"" for x in batch.column(1)]
        media = [wav(c + b"\0" * (-len(c) % UNIT or UNIT * (not c))) for c in contents]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(c) for c in contents], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def described(media: bytes) -> dict:
    """What a stored file gives: digests of its payload and of itself, features, spans of sound, and tensors."""
    rate, raw = samples_of(media)
    bands, energy = log_mel(Samples(raw), rate * UP // DOWN)
    spans = [(a * HOP * DOWN / (rate * UP), ((b - 1) * HOP + FRAME) * DOWN / (rate * UP)) for a, b in segments(energy)]
    feature = f"frames={len(bands)};segments={len(spans)};sound_s={sum(b - a for a, b in spans):.3f};mean_db={np.round(energy, 3).mean():.2f};mel={hashlib.sha256(bands.tobytes()).hexdigest()[:16]}"
    return {
        "payload_bytes": len(raw), "payload_sha256": hashlib.sha256(raw).hexdigest(), "tail_crc32": zlib.crc32(raw[-UNIT:].tobytes()), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(),
        "feature": feature, "frames": len(bands), "spans": [{"start_s": a, "end_s": b} for a, b in spans], "tensors": tensors(bands, rate * UP / DOWN),
    }


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    spans = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))
    kinds = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "frames": pa.int64(), "spans": spans, "tensors": pa.binary()}
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), *kinds.items()])
    for batch in batches:
        rows, size = [], 0
        for doc, n, media in zip(batch.column(0), batch.column(1), batch.column(2)):
            row = described(media.as_py())
            rows.append({"doc_id": doc.as_py(), "n_bytes": n.as_py()} | row)
            size += len(row["tensors"])
            if size > 8 << 20:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


def stored_media(docs: DataFrame, id_col: str = "doc_id", content_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media) of every row, as a table that is written and read back."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(content_col).cast("binary").alias("content"))
    return written(rows.mapInArrow(_stored, STORED), "media", "zstd")


def audio_features(media: DataFrame) -> DataFrame:
    """COLUMNS of every row of stored_media(), as a table that is written and read back."""
    return written(media.select("doc_id", "n_bytes", "media").mapInArrow(_described, COLUMNS), "audio", "zstd")


def op6_media_columns(spark, sf_dir: str) -> DataFrame:
    out = audio_features(stored_media(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    digests = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return out.select(*digests, "frames", "spans", F.sha2("tensors", 256).alias("tensors_sha256"))
