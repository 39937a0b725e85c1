"""Media columns: documents as 8-bit audio, and the audio's features as fixed-shape Arrow tensors.

`encode_wav` stores a payload losslessly as 8-bit mono PCM; `read_wav` walks the RIFF chunks and gives the
stored bytes back. Features come from the bytes read back: polyphase resampling with a windowed-sinc
filter, overlapped Hann frames, log-mel filterbanks, and energy segmentation with hysteresis. Frames are
packed into tensors of one shape (FRAMES x MELS) with the time span and the number of valid frames of
each; `tensors` holds them as an Arrow IPC stream with a fixed_shape_tensor column.

Each text is worked on alone and in blocks of fixed positions, so equal texts give equal values and a very
long text needs bounded memory beside its own bytes. Null counts as empty: an empty payload is one block
of padding.
"""

from __future__ import annotations

import functools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm._arrow import arrow_map, arrow_type, named, pick, slices, typed

#: Payloads are padded with this byte up to a positive multiple of the block.
BLOCK, PAD = 576, 255
RATE, UP, DOWN, TAPS = 16_000, 1, 2, 16
FRAME, HOP, MELS = 256, 128, 20
#: Frames of a tensor; frames that are worked on at once.
FRAMES, AT_ONCE = 32, 1024
#: Log-energy above the quietest tenth at which a segment starts, and below which it ends.
HIGH, LOW = 1.5, 0.7


def padded(raw: bytes) -> bytes:
    return raw + bytes([PAD]) * (max(1, -(-len(raw) // BLOCK)) * BLOCK - len(raw))


def encode_wav(payload: bytes, rate: int = RATE) -> bytes:
    """A RIFF file of 8-bit mono PCM whose data chunk is the payload."""
    odd = len(payload) & 1
    header = b"RIFF" + struct.pack("<I", 36 + len(payload) + odd) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8)
    return header + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * odd


def read_wav(media: bytes) -> tuple[int, int, int]:
    """(offset of the samples, their number, rate), found by walking the chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF WAVE file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            _, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (channels, bits) != (1, 8):
                raise ValueError("not 8-bit mono")
        elif name == b"data":
            return at + 8, size, rate
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


@functools.cache
def _phases(up: int, down: int, taps: int) -> np.ndarray:
    """Windowed-sinc low-pass filter, split into its `up` phases: one row of taps for each."""
    n = taps * up
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(up, down)) * np.hamming(n)
    h *= up / h.sum()
    return np.ascontiguousarray(h.reshape(taps, up).T[:, ::-1].astype(np.float32))


def resample(x: np.ndarray, start: int, stop: int, up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """Outputs [start, stop) of the polyphase resampler by up / down; zeros stand before and after the signal."""
    h = _phases(up, down, taps)
    at = np.arange(start, stop, dtype=np.int64) * down
    base, phase = at // up, at % up
    lo, hi = int(base[0]) - taps + 1, int(base[-1]) + 1
    part = np.zeros(hi - lo, np.float32)
    a, b = max(lo, 0), min(hi, len(x))
    if b > a:
        part[a - lo : b - lo] = x[a:b]
    windows = np.lib.stride_tricks.sliding_window_view(part, taps)
    if up == 1:
        return windows[::down][: stop - start] @ h[0]
    out = np.empty(stop - start, np.float32)
    for p in range(up):
        own = phase == p
        out[own] = windows[base[own] - int(base[0])] @ h[p]
    return out


@functools.cache
def mel_bank(rate: int, n_fft: int = FRAME, mels: int = MELS) -> np.ndarray:
    """Triangular filters, evenly spaced on the mel scale, as a (bins, mels) matrix."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, mels + 2) / 2595) - 1)
    bins = np.fft.rfftfreq(n_fft, 1 / rate)
    up = (bins[:, None] - edges[None, :-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[None, 2:] - bins[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


def log_mel(samples: np.ndarray, rate: int = RATE) -> tuple[np.ndarray, np.ndarray, int]:
    """(frames x MELS log-mel energies, log energy of each frame, rate after resampling) of 8-bit samples."""
    new_rate = rate * UP // DOWN
    n_out = -(-len(samples) * UP // DOWN)
    n_frames = 1 + max(0, -(-(n_out - FRAME) // HOP))  # zeros fill the last frame
    bank, window = mel_bank(new_rate), np.hanning(FRAME).astype(np.float32)
    x = samples.astype(np.float32) / 128 - 1
    mels, energy = np.empty((n_frames, MELS), np.float32), np.empty(n_frames, np.float32)
    for a in range(0, n_frames, AT_ONCE):
        b = min(n_frames, a + AT_ONCE)
        y = resample(x, a * HOP, (b - 1) * HOP + FRAME)
        frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP] * window
        power = np.abs(np.fft.rfft(frames, axis=1)) ** 2
        mels[a:b] = np.log(power @ bank + 1e-6)
        energy[a:b] = np.log((frames * frames).sum(axis=1) + 1e-6)
    return mels, energy, new_rate


def hysteresis(energy: np.ndarray, high: float = HIGH, low: float = LOW) -> list[tuple[int, int]]:
    """Frame spans [a, b): runs above the low mark that reach the high mark, measured from the quietest tenth."""
    if not len(energy):
        return []
    floor = np.quantile(energy, 0.1)
    above = np.concatenate([[False], energy > floor + low, [False]])
    edges = np.flatnonzero(above[1:] != above[:-1])
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True) if energy[a:b].max() > floor + high]


def pack_tensors(mels: np.ndarray, rate: int) -> bytes:
    """Arrow IPC stream: tensor fixed_shape_tensor[FRAMES, MELS], start_s, end_s, valid_frames."""
    n = -(-len(mels) // FRAMES)
    full = np.full((n * FRAMES, MELS), np.log(1e-6), np.float32)
    full[: len(mels)] = mels
    starts = np.arange(n) * FRAMES
    valid = np.minimum(FRAMES, len(mels) - starts)
    values = pa.FixedSizeListArray.from_arrays(pa.array(full.ravel()), FRAMES * MELS)
    tensors = pa.ExtensionArray.from_storage(pa.fixed_shape_tensor(pa.float32(), (FRAMES, MELS)), values)
    batch = pa.record_batch({"tensor": tensors, "start_s": starts * HOP / rate, "end_s": ((starts + valid - 1) * HOP + FRAME) / rate, "valid_frames": pa.array(valid, pa.int32())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack_tensors(stream: bytes) -> pa.Table:
    return pa.ipc.open_stream(stream).read_all()


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with the stored media, where its samples are, and the features read from them.

    id, n_bytes long, media binary, data_offset long, data_bytes long, n_frames int, segments
    array<struct<start_s, end_s>>, mel_mean array<float>, tensors binary (Arrow IPC stream).
    """
    schema = pa.schema(
        [("doc_id", arrow_type(docs, id_col)), ("n_bytes", pa.int64()), ("media", pa.binary()), ("data_offset", pa.int64()), ("data_bytes", pa.int64()), ("n_frames", pa.int32()), ("segments", pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))), ("mel_mean", pa.list_(pa.float32())), ("tensors", pa.binary())]
    )

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                rows: dict[str, list] = {name: [] for name in schema.names if name != "doc_id"}
                for text in part.column("text").to_pylist():
                    raw = (text or "").encode()
                    media = encode_wav(padded(raw))
                    offset, size, rate = read_wav(media)
                    mels, energy, new_rate = log_mel(np.frombuffer(media, np.uint8, size, offset), rate)
                    spans = [{"start_s": a * HOP / new_rate, "end_s": ((b - 1) * HOP + FRAME) / new_rate} for a, b in hysteresis(energy)]
                    for name, value in zip(rows, (len(raw), media, offset, size, len(mels), spans, mels.mean(axis=0, dtype=np.float64).astype(np.float32), pack_tensors(mels, new_rate)), strict=True):
                        rows[name].append(value)
                yield named(schema, doc_id=part.column("doc_id"), **rows)

    return arrow_map(
        pick(docs, doc_id=id_col, text=text_col),
        featurise,
        f"{typed(docs, id_col, id_col)}, n_bytes bigint, media binary, data_offset bigint, data_bytes bigint, n_frames int, segments array<struct<start_s: double, end_s: double>>, mel_mean array<float>, tensors binary",
    )
