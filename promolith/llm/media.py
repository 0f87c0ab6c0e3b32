"""Media columns: audio stored losslessly, and features as fixed-shape tensors.

A payload of bytes is stored as the samples of an 8-bit mono WAV file.  From the
stored bytes, read back, come:

* polyphase resampling by UP / DOWN with a windowed-sinc low-pass, one short
  filter per phase;
* log-mel energies of overlapped Hann frames, cut into tiles of a fixed shape
  (TILE_FRAMES x MELS), the last one padded with the floor value;
* segments of activity by hysteresis on the frames' energy: one opens above the
  higher threshold and closes below the lower one.

The features of a document are stored as an Arrow IPC stream: a row a tile, the
log-mel energies and the frames' energies as fixed-shape tensors, with the tile's
time span and the active spans that meet it.  Digests are taken of what is read
back from there.  Audio is worked on in blocks of BLOCK frames, so memory beside
the payload and its tiles is bounded.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

RATE = 8000  # samples a second of the stored form
UP, DOWN, TAPS = 2, 3, 12  # taps of each phase
FRAME, HOP, MELS, TILE_FRAMES = 256, 128, 20, 64
FLOOR = 1e-6
OPEN_DB, CLOSE_DB = 3.0, 0.0  # against the median frame
PAYLOAD_UNIT = 64
BLOCK = 2048  # frames that are worked on at a time

RESULT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def payload_of(text: str) -> tuple[int, bytes]:
    """(bytes of the text, them and zeros up to a positive multiple of 64)."""
    raw = text.encode("utf-8")
    padded = max(PAYLOAD_UNIT, -(-len(raw) // PAYLOAD_UNIT) * PAYLOAD_UNIT)
    return len(raw), raw.ljust(padded, b"\0")


def write_wav(payload: bytes, rate: int = RATE) -> bytes:
    """An 8-bit mono PCM WAV file; an odd payload gets the format's pad byte."""
    pad = len(payload) & 1
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + pad, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * pad


def read_wav(media: bytes) -> tuple[int, bytes]:
    """(rate, samples) of an 8-bit mono PCM WAV file."""
    riff, size, wave = struct.unpack_from("<4sI4s", media)
    if riff != b"RIFF" or wave != b"WAVE" or size + 8 > len(media):
        raise ValueError("no WAV file")
    at, rate = 12, None
    while at + 8 <= size + 8:
        name, n = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("not 8-bit mono PCM")
        elif name == b"data":
            if rate is None:
                raise ValueError("data before format")
            return rate, media[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)
    raise ValueError("no data")


@functools.cache
def phases(up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """The low-pass of `up * taps` taps, one row per phase, each of unit gain."""
    n = up * taps
    t = np.arange(n) - (n - 1) / 2
    cutoff = 1 / max(up, down)
    h = np.sinc(t * cutoff) * np.hamming(n)
    rows = h.reshape(taps, up).T  # row p has taps p, p + up, ...
    return np.ascontiguousarray(rows / rows.sum(axis=1, keepdims=True))


def resample_part(x: np.ndarray, lo: int, hi: int, up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """Samples lo to hi (end exclusive) of the resampled `x`, edges held."""
    if hi <= lo:
        return np.zeros(0)
    rows, half = phases(up, down, taps), taps // 2
    k = np.arange(lo, hi) * down
    first = int(k[0]) // up
    near = np.clip(np.arange(first - half, int(k[-1]) // up - half + taps), 0, len(x) - 1)
    windows = np.lib.stride_tricks.sliding_window_view(x[near], taps)
    out = np.empty(hi - lo)
    for p in range(up):
        mine = np.flatnonzero(k % up == p)
        out[mine] = windows[k[mine] // up - first] @ rows[p][::-1]
    return out


def resampled_length(n: int, up: int = UP, down: int = DOWN) -> int:
    return -(-n * up // down)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """Polyphase resampling; ceil(len * up / down) samples, edges held."""
    return resample_part(x, 0, resampled_length(len(x), up, down), up, down, taps)


@functools.cache
def mel_filters(frame: int = FRAME, mels: int = MELS, rate: float = RATE * UP / DOWN) -> np.ndarray:
    """Triangles even on the mel scale, (frame / 2 + 1) x mels."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), mels + 2) / 2595) - 1)
    f = np.linspace(0, rate / 2, frame // 2 + 1)[:, None]
    lo, mid, hi = edges[:-2], edges[1:-1], edges[2:]
    return np.maximum(0, np.minimum((f - lo) / (mid - lo), (hi - f) / (hi - mid)))


@functools.cache
def _window(frame: int = FRAME) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(frame) / frame)


def frame_count(n: int, frame: int = FRAME, hop: int = HOP) -> int:
    """Overlapped frames over `n` samples; the last may reach past the end, so that none is lost."""
    return max(1, -(-max(0, n - frame) // hop) + 1)


def log_mel(frames: np.ndarray) -> np.ndarray:
    power = np.abs(np.fft.rfft(frames * _window(), axis=1)) ** 2
    return np.log10(power @ mel_filters() + FLOOR)


def segments(energy_db: np.ndarray, open_db: float = OPEN_DB, close_db: float = CLOSE_DB) -> list[tuple[int, int]]:
    """[first, last + 1) frames of activity by hysteresis.

    A frame is active if the last frame above `open_db` or below `close_db`,
    itself included, was above.
    """
    mark = np.where(energy_db > open_db, 1, np.where(energy_db < close_db, -1, 0))
    last = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    active = (last >= 0) & (mark[last] > 0)
    edge = np.diff(np.concatenate([[0], active.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))


def analysed(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(log-mel energies, frame by band; energy of each frame in dB) of 8-bit samples."""
    x = np.frombuffer(samples, np.uint8)
    n = resampled_length(len(x))
    count = frame_count(n)
    mel, energy = np.empty((count, MELS), np.float32), np.empty(count, np.float32)
    for a in range(0, count, BLOCK):
        b = min(count, a + BLOCK)
        lo, hi = a * HOP, (b - 1) * HOP + FRAME
        part = np.zeros(hi - lo)
        if len(x):
            turns = max(0, lo * DOWN // UP - TAPS) // DOWN  # whole turns of the phases before what is needed
            near = (x[turns * DOWN : hi * DOWN // UP + TAPS + DOWN].astype(float) - 128) / 128
            end = min(hi, n)
            part[: end - lo] = resample_part(near, lo - turns * UP, end - turns * UP)
        frames = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP]
        mel[a:b] = log_mel(frames)
        energy[a:b] = 10 * np.log10(np.einsum("ij,ij->i", frames, frames) / FRAME + FLOOR)
    return mel, energy


def tensor_type(*shape: int) -> pa.DataType:
    return pa.fixed_shape_tensor(pa.float32(), shape or (TILE_FRAMES, MELS))


SPANS = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))
TILES = pa.schema([("tile", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("log_mel", tensor_type()), ("energy_db", tensor_type(TILE_FRAMES)), ("segments", SPANS)])


def _tiled(rows: np.ndarray, floor: float) -> pa.Array:
    """Frames as tensors of TILE_FRAMES frames, the last one filled with `floor`."""
    n = -(-len(rows) // TILE_FRAMES)
    full = np.full((n * TILE_FRAMES, *rows.shape[1:]), floor, np.float32)
    full[: len(rows)] = rows
    width = full[:TILE_FRAMES].size
    return pa.ExtensionArray.from_storage(tensor_type(TILE_FRAMES, *rows.shape[1:]), pa.FixedSizeListArray.from_arrays(pa.array(full.reshape(-1)), width))


def frame_seconds(rate: int) -> float:
    return HOP * DOWN / (UP * rate)


def tensors_of(media: bytes) -> pa.RecordBatch:
    """The tiles (TILES) of a stored file."""
    rate, samples = read_wav(media)
    mel, energy = analysed(samples)
    step = frame_seconds(rate)
    active = [(a * step, b * step) for a, b in segments(energy - np.median(energy))]
    n = -(-len(mel) // TILE_FRAMES)
    starts = [k * TILE_FRAMES * step for k in range(n)]
    ends = [min((k + 1) * TILE_FRAMES, len(mel)) * step for k in range(n)]
    meets, at = [], 0
    for lo, hi in zip(starts, ends):
        while at < len(active) and active[at][1] <= lo:
            at += 1
        k = at
        while k < len(active) and active[k][0] < hi:
            k += 1
        meets.append([{"start_s": a, "end_s": b} for a, b in active[at:k]])
    return pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array(starts), pa.array(ends), _tiled(mel, np.log10(FLOOR)), _tiled(energy, 10 * np.log10(FLOOR)), pa.array(meets, SPANS)], schema=TILES)


def write_tensors(tiles: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, TILES) as out:
        out.write_batch(tiles)
    return sink.getvalue().to_pybytes()


def read_tensors(stored: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(stored) as got:
        return got.read_next_batch()


def feature_text(tiles: pa.RecordBatch, rate: int = RATE) -> str:
    """A digest of stored tiles: counts, mean energy and log-mel bands, a CRC of
    the tensors rounded to hundredths and one of the time spans."""
    mel = tiles["log_mel"].to_numpy_ndarray()
    frames = round(tiles["end_s"][-1].as_py() / frame_seconds(rate))
    bands = ",".join(f"{v:.2f}" for v in mel.reshape(-1, MELS)[:frames].mean(axis=0, dtype=float) + 0.0)
    energy = tiles["energy_db"].to_numpy_ndarray().reshape(-1)[:frames].mean(dtype=float)
    spans = sorted({(s["start_s"], s["end_s"]) for row in tiles["segments"].to_pylist() for s in row})
    times = ",".join(f"{a:.4f}-{b:.4f}" for a, b in [*zip(tiles["start_s"].to_pylist(), tiles["end_s"].to_pylist()), *spans])
    crc = zlib.crc32(np.rint(mel * 100).astype("<i4").tobytes())
    return f"frames={frames};tiles={len(mel)};segments={len(spans)};active={sum(b - a for a, b in spans):.3f};energy={energy:.2f};crc={crc:08x};times={zlib.crc32(times.encode()):08x};mel={bands}"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
    for batch in batches:
        rows = []
        for i, n, media, tensors in zip(*(batch.column(k) for k in range(4))):
            media = media.as_py()
            rate, back = read_wav(media)
            feature = feature_text(read_tensors(tensors.as_py()), rate)
            rows.append((i.as_py(), n.as_py(), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-PAYLOAD_UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in common.columns(batches, 256):
        got = [payload_of(t) for t in texts]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([n for n, _ in got], pa.int64()), pa.array([write_wav(p) for _, p in got], pa.binary())], names=["doc_id", "n_bytes", "media"])


def store_audio(df: DataFrame, id_col: str = common.ID, text_col: str = common.TEXT) -> DataFrame:
    """doc_id, n_bytes, media: each text as a WAV file; null and empty texts
    become 64 zero samples.  Other cases: see `common`."""
    common.ship(df.sparkSession)
    return common.id_text(df, id_col, text_col).mapInArrow(_store, "doc_id long, n_bytes long, media binary")


def _tensors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 64):
            part = batch.slice(k, 64)
            stored = [write_tensors(tensors_of(m.as_py())) for m in part["media"]]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(stored, pa.binary())], names=[*part.schema.names, "tensors"])


def with_tensors(stored: DataFrame) -> DataFrame:
    """The rows of `store_audio` with `tensors`: the features of each file as an
    Arrow IPC stream of TILES (a row a tile, at least one)."""
    common.ship(stored.sparkSession)
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(_tensors, "doc_id long, n_bytes long, media binary, tensors binary")


def _tile_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, tensors in zip(batch.column(0), batch.column(1)):
            t = read_tensors(tensors.as_py())
            plain = lambda c: t[c].storage.cast(pa.list_(pa.float32()))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([pa.array([i.as_py()] * len(t), pa.int64()), t["tile"], t["start_s"], t["end_s"], plain("log_mel"), plain("energy_db"), t["segments"]], names=["doc_id", *TILES.names])


def audio_tiles(featured: DataFrame) -> DataFrame:
    """doc_id, tile, start_s, end_s, log_mel, energy_db, segments: a row a tile.

    `featured` comes from `with_tensors`.  As Spark has no tensor type, log_mel
    and energy_db are the tensors' storage (TILE_FRAMES * MELS and TILE_FRAMES
    floats, row by row); `segments` are the active spans that meet the tile.
    """
    common.ship(featured.sparkSession)
    return featured.select("doc_id", "tensors").mapInArrow(_tile_rows, "doc_id long, tile int, start_s double, end_s double, log_mel array<float>, energy_db array<float>, segments array<struct<start_s:double,end_s:double>>")


def media_digests(df: DataFrame, id_col: str = common.ID, text_col: str = common.TEXT) -> DataFrame:
    """Digests of each row's stored form, of what is read back, and its features.

    Equal texts give equal values; cases as in `store_audio`.
    """
    return with_tensors(store_audio(df, id_col, text_col)).mapInArrow(_digest, RESULT)
