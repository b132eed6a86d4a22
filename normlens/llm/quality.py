"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

Words are runs of one character class (letters, digits, signs), so that decoration and shouting are words
too. A text's features are its hashed words and word pairs, weighted by their share of the text. Whole texts of
a bounded sample of labelled rows become sparse features on the executors; training runs on the driver. Scoring
is a sparse dot product for each text, in Arrow batches, with nothing shuffled but the sample.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normlens.llm.common import SEGMENT, hash_spans, is_held_out, materialise, mix64, row_batches, segments, text_bytes

#: A model is fitted on about this many labelled rows at most, of which the driver holds at most so many features.
SAMPLE_ROWS = 6_000
SAMPLE_FEATURES = 10_000_000
BITS = 18
FOLDS = 5
THRESHOLD = 0.3
#: Learning rate, its offset, and the two penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-4
EPOCHS, UPDATES = 6, 30_000  # passes over the rows: EPOCHS, or as many more as small samples need for UPDATES
SCORE_SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
EXAMPLE_SCHEMA = "doc_id long, quality int, n long, index binary, value binary"


def _classes() -> np.ndarray:
    """Class of each byte: 0 white space, 1 capital, 2 other letter or byte above ASCII, 3 digit, 4 sign."""
    out = np.full(256, 4, dtype=np.uint8)
    out[[*range(9, 14), 32]] = 0
    out[65:91], out[97:123], out[48:58] = 1, 2, 3
    out[128:] = 2
    return out


CLASSES = _classes()
LETTERS = np.isin(CLASSES, (1, 2))


#: A word: a run of one class.
RUN = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^A-Za-z0-9\x80-\xff\t-\r ]+")
WHITE = b"\t\n\v\f\r "


def features(raws: list[bytes], words_too: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashed indices of the words and neighbouring word pairs of some texts (or of pairs alone), and the text that each is of."""
    buf = np.frombuffer(b"\n" + b"\n".join(raws) + b"\n", dtype=np.uint8)
    kind = CLASSES[buf]
    capital = np.concatenate([[0], np.cumsum(kind == 1, dtype=np.int32)])
    kind = np.where(kind == 1, 2, kind)
    edges = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    starts, ends = edges[:-1], edges[1:]
    words = kind[starts] != 0
    starts, ends = starts[words], ends[words]
    hashes = hash_spans(buf, starts, ends)
    owner = np.searchsorted(np.cumsum([len(r) + 1 for r in raws]), starts, side="right").astype(np.int64)
    near = np.flatnonzero(owner[1:] == owner[:-1])
    same = near[hashes[near] == hashes[near + 1]]
    # Two words stand for endless vocabularies: runs of capitals (shouting), and a word said twice in a row.
    shout = np.flatnonzero((capital[ends] - capital[starts] == ends - starts) & (ends - starts >= 2))
    pairs = mix64(hashes[near] * np.uint64(0x9E3779B97F4A7C15) + hashes[near + 1])
    marks = [np.full(len(x), m, dtype=np.uint64) for x, m in ((shout, 0xD1B54A32D192ED03), (same, 0x8CB92BA72F3D8DD7))]
    parts = [(hashes, owner), (pairs, owner[near]), (marks[0], owner[shout]), (marks[1], owner[same])]
    index, text = (np.concatenate(x) for x in zip(*(parts if words_too else parts[1::2]), strict=True))
    return (index >> np.uint64(64 - BITS)).astype(np.int64), text


def bridges(raw: bytes) -> Iterator[bytes]:
    """The last word before and the first word after each cut between segments of a long text."""
    if len(raw) <= SEGMENT:
        return
    last = b""
    for piece in segments(raw):
        body = piece.strip(WHITE)
        if body:
            if last:
                yield last + b" " + RUN.match(body)[0]
            last = RUN.match(body[::-1])[0][::-1]


def weighted(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, index and value, sorted by both: the value is the square root of the index's share of its text.

    Texts are taken in groups and long ones in segments; the pair across a segment's end is made from the words on either side."""
    keys: list[np.ndarray] = []
    group: list[bytes] = []
    owners: list[int] = []
    size = 0
    for i, raw in enumerate(raws):
        for piece in segments(raw):
            group.append(piece)
            owners.append(i)
            size += len(piece)
            if size >= SEGMENT:
                index, text = features(group)
                keys.append(np.array(owners)[text] << BITS | index)
                group, owners, size = [], [], 0
    if group:
        index, text = features(group)
        keys.append(np.array(owners)[text] << BITS | index)
    cut = [(i, pair) for i, raw in enumerate(raws) for pair in bridges(raw)]
    if cut:
        index, text = features([pair for _, pair in cut], words_too=False)
        keys.append(np.array([i for i, _ in cut])[text] << BITS | index)
    every = np.sort(np.concatenate(keys)) if keys else np.zeros(0, dtype=np.int64)
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else every
    count = np.diff(np.append(first, len(every)))
    text, index = every[first] >> BITS, every[first] & ((1 << BITS) - 1)
    total = np.bincount(text, weights=count, minlength=len(raws))
    return text, index, np.sqrt(count / total[text])


def examples(raws: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Indices and values of each text, with the bias, whose index is ``1 << BITS`` and value 1."""
    text, index, value = weighted(raws)
    cuts = np.searchsorted(text, np.arange(len(raws) + 1))
    bias = 1 << BITS
    return [(np.append(index[a:b], bias).astype(np.int32), np.append(value[a:b], 1.0).astype(np.float32)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def train(data: list[tuple[np.ndarray, np.ndarray, int]], epochs: int | None = None) -> tuple[np.ndarray, float]:
    """Weights and bias by FTRL-proximal over the (indices, values, label) rows in turn, again and again."""
    epochs = epochs or min(max(EPOCHS, -(-UPDATES // len(data))), 200)
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    bias = 1 << BITS

    def weight(i: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z[i]) * L1 - z[i]
        w = shrunk / ((BETA + np.sqrt(n[i])) / ALPHA + L2)
        return np.where((np.abs(z[i]) <= L1) & (i != bias), 0.0, w)

    for _ in range(epochs):
        for index, value, label in data:
            w = weight(index)
            p = 1 / (1 + np.exp(-np.clip(w @ value, -35, 35)))
            g = (p - label) * value
            sigma = (np.sqrt(n[index] + g * g) - np.sqrt(n[index])) / ALPHA
            z[index] += g - sigma * w
            n[index] += g * g
    w = weight(np.arange(bias + 1))
    return w[:bias].astype(np.float32), float(w[bias])


def score_texts(raws: list[bytes], weights: np.ndarray, bias: float) -> np.ndarray:
    """Probability of label 1 of each text. A text without words gets the bias alone."""
    text, index, value = weighted(raws)
    logit = np.bincount(text, weights=weights[index] * value, minlength=len(raws)) + bias
    return 1 / (1 + np.exp(-np.clip(logit, -35, 35)))


def held_out(doc_id: Column, folds: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def sampled_ids(ids: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` of the rows of ``ids`` (all, if fewer), which has each doc_id once: those with a hash below a bound."""
    total = ids.count()
    bound = int(-(2**63) + 2**64 * min(1.0, rows / max(1, total)))
    return ids if rows >= total else ids.where(F.xxhash64("doc_id", F.lit(17)) < F.lit(bound))


def within(sizes: list[tuple[int, int]], most: int) -> list[int]:
    """The ids of (id, size) pairs taken in an order that follows from the ids, as long as their sizes sum to ``most``."""
    total, out = 0, []
    for i, n in sorted(sizes, key=lambda s: (is_held_out(s[0], 1 << 32), s[0])):
        if total + n <= most:
            total += n
            out.append(i)
    return out


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_features: int = SAMPLE_FEATURES) -> tuple[np.ndarray, float]:
    """The model of the labels outside the held-out fold.

    Rows with a null id, label or text teach nothing; an id labelled twice has its larger label, and of its texts
    one is used. Whole texts are taken, of about ``sample_rows`` ids. If all their features are more than
    ``sample_features``, rows are left out until they fit. The driver holds these features, and no text."""
    marks = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (held_out(F.col("doc_id"), FOLDS) != 0))
    marks = materialise(marks.groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality")), "labels")
    kept = F.broadcast(sampled_ids(marks, sample_rows))
    own = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(kept, "doc_id")
    own = own.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_batches(batches, 4 << 20):
            found = examples(text_bytes(batch.column(2)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    batch.column(1),
                    pa.array([len(i) for i, _ in found], pa.int64()),
                    pa.array([i.tobytes() for i, _ in found], pa.binary()),
                    pa.array([v.tobytes() for _, v in found], pa.binary()),
                ],
                names=["doc_id", "quality", "n", "index", "value"],
            )

    table = materialise(own.mapInArrow(run, EXAMPLE_SCHEMA), "quality-sample")
    order = {i: k for k, i in enumerate(within([tuple(r) for r in table.select("doc_id", "n").collect()], sample_features))}
    if not order:
        return np.zeros(1 << BITS, dtype=np.float32), 0.0
    ids = F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in order], "doc_id long"))
    data: list = [None] * len(order)
    for row in table.join(ids, "doc_id").toLocalIterator():
        data[order[row["doc_id"]]] = (np.frombuffer(row["index"], dtype=np.int32), np.frombuffer(row["value"], dtype=np.float32), row["quality"])
    return train(data)


def score(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; null and empty texts get the bias's score.

    Repeated rows have equal results. A null id is passed on, and is not held out unless '' is. Extra columns are
    not looked at; an empty table gives no rows. Texts of any length are scored whole, in segments."""
    weights, bias = model
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in row_batches(batches, 4 << 20):
            ids = batch.column(0).to_pylist()
            got = score_texts(text_bytes(batch.column(1)), table, bias)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array([is_held_out(i, FOLDS) == 0 for i in ids]),
                    pa.array(got),
                    pa.array((got >= threshold).astype(np.int32)),
                ],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, SCORE_SCHEMA)


def filter_rows(docs: DataFrame, model: tuple[np.ndarray, float], least: float, columns: tuple[str, ...]) -> DataFrame:
    """``columns`` of the rows whose score is ``least`` or more; ``text`` is one of them."""
    weights, bias = model
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_batches(batches, 4 << 20):
            yield batch.filter(pa.array(score_texts(text_bytes(batch.column(at)), shared.value, bias) >= least))

    rows = docs.select(*columns)
    return rows.mapInArrow(run, rows.schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fits on the labelled rows outside the held-out fold and scores every document."""
    return score(docs, fit(docs, labels))
