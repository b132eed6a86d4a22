"""What the training-data operators share: tables kept in the cluster's shared folder, and Arrow helpers."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import threading
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normlens.session import remove_folder, shared_dir

SPACE = r"\x20\x09-\x0D"
WORD = f"[^{SPACE}]+"


def _quiet_remove(spark: SparkSession, path: str) -> None:
    try:
        remove_folder(spark, path)
    except Exception:  # noqa: BLE001 - the session has ended; the folder's owner clears it
        pass


#: Tables that this process wrote and still keeps, oldest first, with the thread that did.
_tables: dict[str, tuple[SparkSession, int]] = {}


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back.

    This cuts the lineage with files that outlive any executor. They go at the session's end, or
    earlier by ``forget``. The schema is passed on, so an empty table keeps its columns."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/normlens-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _tables:
        atexit.register(forget_all)
    _tables[path] = spark, threading.get_ident()
    out = spark.read.schema(df.schema).parquet(path)
    out._normlens_path = path
    return out


def forget(df: DataFrame) -> None:
    """Removes a table that ``materialise`` wrote, once nothing reads it any more."""
    path = df._normlens_path
    if path in _tables:
        _quiet_remove(_tables.pop(path)[0], path)


def clear_shuffles(spark: SparkSession) -> None:
    """Lets Spark remove the files of shuffles that nothing refers to any more: it does so once the driver has collected garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def forget_since(begun: set[str], *keep: DataFrame) -> None:
    """Removes the tables that this thread wrote since ``begun = tables_now()``, but not those of ``keep``."""
    kept = {df._normlens_path for df in keep}
    for path in [p for p, (_, thread) in _tables.items() if thread == threading.get_ident() and p not in begun and p not in kept]:
        _quiet_remove(_tables.pop(path)[0], path)


@contextmanager
def scratch_scope(*keep: DataFrame) -> Iterator[None]:
    """Tables that operators write in this block, in this thread, go at its end: results have to be read or written inside.

    Without it they go when the process ends; a driver that is killed leaves them in the shared folder."""
    begun = tables_now()
    try:
        yield
    finally:
        forget_since(begun, *keep)


def tables_now() -> set[str]:
    return set(_tables)


def forget_all() -> None:
    for path in list(_tables):
        _quiet_remove(_tables.pop(path)[0], path)


#: What operators keep in a Python worker between tasks: a name, and how to drop it.
_kept: dict[str, Callable[[], None]] = {}


def keep_between_tasks(owner: str, drop: Callable[[], None]) -> None:
    _kept[owner] = drop


def give_back(owner: str | None = None) -> None:
    """Drops what operators other than ``owner`` keep in this worker, and returns free memory to the system.

    Workers outlive tasks and serve one operator after the other; without this their caches add up."""
    for name in [n for n in _kept if n != owner]:
        _kept.pop(name)()
    pa.default_memory_pool().release_unused()
    try:
        trim = ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return
    trim(0)


def broadcast_if_small(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """Marks a table of few columns for broadcast if it is counted to hold at most ``rows`` rows; else joins shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def row_batches(it: Iterable[pa.RecordBatch], max_bytes: int = 16 << 20, owner: str | None = None) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``max_bytes`` at most (a longer single row stays whole).

    Before and after, memory that only other operators (not ``owner``) want is given back."""
    give_back(owner)
    for batch in it:
        if batch.num_rows == 0:
            continue
        step = max(1, int(batch.num_rows * max_bytes / max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
    give_back(owner)


def is_held_out(doc_id: int | None, modulus: int) -> int:
    """crc32 of the id as decimal text, modulo; a null id counts as the text ''."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus


def text_bytes(texts: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null as empty."""
    return [b"" if x is None else x for x in texts.cast(pa.binary()).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply), vectorised."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


#: Fixed values of the word hash: a seed for the value of each byte, and an odd base with its inverse mod 2**64.
_BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[32, *range(9, 14)]] = True
_SPACE_AT = re.compile(rb"[ \t-\r]")
SEGMENT = 2 << 20
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        _powers[:] = [np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, x, dtype=np.uint64)])) for x in (_BASE, _INVERSE)]
    return _powers[0], _powers[1]


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of ``buf``: sums of byte value times base ** place, shifted to place 0 and mixed.

    It depends on the bytes of the span alone. All of it is array arithmetic, with no loop over words."""
    up, down = _power_tables(len(buf))
    sums = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUES[buf] * up[: len(buf)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts])


def segments(raw: bytes, size: int = SEGMENT) -> Iterator[bytes]:
    """``raw`` in runs of about ``size``, cut only before white space."""
    at = 0
    while len(raw) - at > size:
        found = _SPACE_AT.search(raw, at + size)
        if not found:
            break
        yield raw[at : found.start()]
        at = found.start()
    yield raw[at:] if at else raw


def word_hashes(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words between ASCII white space, text after text; and the number of words of each text.

    Long texts are taken in segments, so the working arrays stay near ``SEGMENT`` bytes times a constant."""
    parts: list[np.ndarray] = []
    counts = np.zeros(len(raws), dtype=np.int64)
    group: list[bytes] = []
    owners: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if not group:
            return
        buf = np.frombuffer(b"\n" + b"\n".join(group) + b"\n", dtype=np.uint8)
        space = _IS_SPACE[buf]
        edges = np.flatnonzero(space[1:] != space[:-1]) + 1
        starts, ends = edges[0::2], edges[1::2]
        parts.append(hash_spans(buf, starts, ends))
        bounds = np.cumsum([0, *(len(g) + 1 for g in group)])
        np.add.at(counts, owners, np.diff(np.searchsorted(starts, bounds)))
        group.clear()
        owners.clear()
        size = 0

    for i, raw in enumerate(raws):
        for piece in segments(raw):
            group.append(piece)
            owners.append(i)
            size += len(piece)
            if size >= SEGMENT:
                flush()
    flush()
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64), counts
