"""Media columns: lossless 8-bit WAV blobs in a binary column, and landmark fingerprints of their spectra.

``encode_wav`` writes each text's bytes as a mono WAV with the wave module, ``store`` keeps the blobs as a table, and
``fingerprint`` reads them back, takes short-time Fourier transforms, and pairs spectral peaks into (time, hash) arrays. Rows are
independent, so nothing is shuffled, and a lost executor costs the recomputation of its own rows.

The transform uses a Hann window and cosine tables rounded to whole numbers. Samples and tables are small
enough for every sum to be exact in 32-bit floats, so results do not depend on batch, order or machine.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from normlens.llm.common import materialise, row_batches, text_bytes

UNIT = 192  # payloads are padded with spaces to a positive multiple of this
RATE = 8000
WINDOW, HOP = 192, 96
BANDS = 4
FAN = 3  # peaks that each peak is paired with
REACH = 63  # frames at most between the peaks of a pair
BLOCK_ROWS = 1 << 14

WAV_SCHEMA = "doc_id long, n_bytes long, media binary"
PRINT_SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, n_frames long, fp_time array<int>, fp_hash array<int>, feature string"
)


def wav_bytes(payload: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def read_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        if w.getsampwidth() != 1 or w.getnchannels() != 1:
            raise ValueError("only mono 8-bit WAV holds payloads")
        return w.readframes(w.getnframes())


def pad(raw: bytes, unit: int = UNIT) -> bytes:
    """``raw`` with spaces after it, up to the next multiple of ``unit`` that is not 0."""
    return raw.ljust(max(unit, -(-len(raw) // unit) * unit))


def encode_wav(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (UTF-8 bytes of the text; null as empty), media (the WAV blob). Extra columns are dropped.

    Repeated rows and null ids are kept, one row for one row; an empty table gives no rows. A text of any length
    becomes one blob, so it has to fit in a binary value (2 GB)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_batches(batches):
            raws = text_bytes(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array([len(r) for r in raws], pa.int64()), pa.array([wav_bytes(pad(r)) for r in raws], pa.binary())],
                names=["doc_id", "n_bytes", "media"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, WAV_SCHEMA)


def store(docs: DataFrame) -> DataFrame:
    """The blobs of ``encode_wav``, written to the shared folder as a table."""
    return materialise(encode_wav(docs), "media")


def transform_tables() -> np.ndarray:
    """WINDOW x 2 bins: rounded cosines, then sines, under a Hann window."""
    t = np.arange(WINDOW)
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * t / WINDOW)
    angle = 2 * np.pi * np.outer(t, np.arange(1, WINDOW // 2 + 1)) / WINDOW
    return np.rint(127 * hann[:, None] * np.hstack([np.cos(angle), np.sin(angle)])).astype(np.float32)


def band_peaks(samples: np.ndarray, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Power and bin of the strongest bin of each band, for each frame (frames are HOP apart)."""
    rows = samples.reshape(-1, HOP).astype(np.float32) - np.float32(128)
    bins = WINDOW // 2
    power, where = [], []
    for at in range(0, len(rows) - 1, BLOCK_ROWS):
        some = rows[at : at + BLOCK_ROWS + 1]
        wave_sums = some[:-1] @ tables[:HOP]
        wave_sums += some[1:] @ tables[HOP:]
        wave_sums *= wave_sums
        energy = (wave_sums[:, :bins] + wave_sums[:, bins:]).reshape(len(some) - 1, BANDS, -1)
        best = energy.argmax(axis=2)
        power.append(np.take_along_axis(energy, best[:, :, None], axis=2)[:, :, 0])
        where.append((best + np.arange(BANDS) * (bins // BANDS) + 1).astype(np.int32))
    return np.concatenate(power), np.concatenate(where)


def landmarks(payloads: list[bytes], tables: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For each payload: its number of frames, and the times and hashes of its peak pairs.

    A band's peak counts if no neighbouring frame has a stronger one there (of equal ones, the last).
    Each peak is paired with the next ``FAN`` peaks in order of time and bin, up to ``REACH`` frames on."""
    lengths = np.array([len(p) // HOP for p in payloads])
    ends = np.cumsum(lengths)
    power, where = band_peaks(np.frombuffer(b"".join(payloads), dtype=np.uint8), tables)
    inside = np.ones(len(power), dtype=bool)
    inside[ends[:-1] - 1] = False  # these frames lie across two payloads
    power[~inside] = -1
    edge = np.full((1, BANDS), -1, dtype=power.dtype)
    earlier, later = np.vstack([edge, power[:-1]]), np.vstack([power[1:], edge])
    frame, band = np.nonzero((power >= earlier) & (power > later) & inside[:, None])
    owner = np.searchsorted(ends, frame, side="right")
    first = np.concatenate([[0], ends[:-1]])
    time, freq = (frame - first[owner]).astype(np.int32), where[frame, band]
    times, hashes, owners = [], [], []
    for step in range(1, FAN + 1):
        gap = time[step:] - time[:-step]
        ok = (owner[step:] == owner[:-step]) & (gap <= REACH)
        times.append(time[:-step][ok])
        hashes.append((freq[:-step][ok] << 13 | freq[step:][ok] << 6 | gap[ok]).astype(np.int32))
        owners.append(owner[:-step][ok])
    time, code, owner = np.concatenate(times), np.concatenate(hashes), np.concatenate(owners)
    order = np.lexsort((code, time, owner))
    cuts = np.searchsorted(owner[order], np.arange(len(payloads) + 1))
    time, code = time[order], code[order]
    return [(int(n) - 1, time[a:b], code[a:b]) for n, a, b in zip(lengths, cuts[:-1], cuts[1:], strict=True)]


def fingerprint(media: DataFrame) -> DataFrame:
    """Reads the stored blobs back and computes their features; one row for each row of ``media``.

    A null or empty text is a blob of blanks; repeated rows and null ids are kept as they are; a text of any length is one
    blob; an empty table gives no rows; other columns are not looked at.

    payload_* describe the bytes read back, tail_crc32 their last 16; fp_time and fp_hash are parallel
    arrays, sorted by time; feature is the number of frames and of pairs and a digest of both arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = transform_tables()
        for batch in row_batches(batches, 4 << 20):
            blobs = batch.column(2).to_pylist()
            payloads = [read_wav(b) for b in blobs]
            marks = landmarks(payloads, tables)
            digests = [hashlib.sha256(t.astype("<i4").tobytes() + h.astype("<i4").tobytes()).hexdigest() for _, t, h in marks]
            offsets = pa.array(np.cumsum([0, *(len(t) for _, t, _ in marks)]), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([m[i] for m in marks]), pa.int32())) for i in (1, 2)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([len(p) for p in payloads], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in payloads]),
                    pa.array([zlib.crc32(p[-16:]) for p in payloads], pa.int64()),
                    pa.array([len(b) for b in blobs], pa.int64()),
                    pa.array([hashlib.sha256(b).hexdigest() for b in blobs]),
                    pa.array([n for n, _, _ in marks], pa.int64()),
                    *lists,
                    pa.array([f"{n}:{len(t)}:{d[:32]}" for (n, t, _), d in zip(marks, digests, strict=True)]),
                ],
                names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "n_frames", "fp_time", "fp_hash", "feature"],
            )

    return media.mapInArrow(run, PRINT_SCHEMA)
