"""Language identification: a byte convolutional network in numpy.

Bytes map to classes, classes to small vectors; filters of several widths run over fixed-length windows,
each filter keeps its maximum, and a softmax layer names the language. Training (Adam, on the driver) sees the
whole texts of a bounded sample of labelled rows. For scoring, vectors and filters fold into tables over pairs of byte
classes, so a window costs table look-ups and additions. A text's prediction is the mean over all its
windows; texts are independent, so nothing is shuffled but the sample.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normlens.llm.common import is_held_out, materialise, row_batches
from normlens.llm.quality import held_out, sampled_ids, within

FOLDS, HELD = 3, 1
#: A model is fitted on about this many labelled rows at most, of which the driver holds at most so many bytes.
SAMPLE_ROWS = 3_000
SAMPLE_BYTES = 32 << 20
WINDOW = 256
CLASSES = 64  # byte classes: padding, the commonest bytes of the sample, and one for all others
VECTOR = 8
WIDTHS = (2, 3, 4)
FILTERS = 16
STEPS, BATCH, RATE = 800, 64, 0.004  # updates, each by windows that come in a random order until all were used
UNKNOWN = "und"
BLOCK = 512  # windows scored at once
SCORE_SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


@dataclass
class Model:
    languages: list[str]
    classes: np.ndarray  # of each byte
    vectors: np.ndarray
    filters: list[np.ndarray]  # by width: (width * VECTOR, FILTERS)
    offsets: list[np.ndarray]
    out: np.ndarray
    out_offset: np.ndarray


def has_letter(text: str) -> bool:
    """Whether any character is a letter; digits of any kind (superscripts, fractions, circled ones) are none."""
    return text.isalpha() or any(map(str.isalpha, text))


def as_bytes(text: str) -> bytes:
    return text.lower().encode()


def windows(raw: bytes, classes: np.ndarray) -> np.ndarray:
    """The text's bytes, as classes, in rows of ``WINDOW``; the last row is padded with class 0."""
    n = max(1, -(-len(raw) // WINDOW))
    out = np.zeros(n * WINDOW, dtype=np.uint8)
    out[: len(raw)] = classes[np.frombuffer(raw, dtype=np.uint8)]
    return out.reshape(n, WINDOW)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def initial(languages: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """Random parameters: vectors v, filters f and offsets b of each width, output o and its offset ob."""
    p = {"v": rng.normal(0, 0.5, (CLASSES, VECTOR)), "o": rng.normal(0, 0.2, (len(WIDTHS) * FILTERS, languages)), "ob": np.zeros(languages)}
    for w in WIDTHS:
        p[f"f{w}"], p[f"b{w}"] = rng.normal(0, (2 / (w * VECTOR)) ** 0.5, (w * VECTOR, FILTERS)), np.zeros(FILTERS)
    return p


def gradients(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy of the windows ``x`` with languages ``y``, and its gradient by each parameter."""
    n, seen, pooled, best = len(x), p["v"][x], [], []
    for w in WIDTHS:
        patches = np.lib.stride_tricks.sliding_window_view(seen, w, axis=1).transpose(0, 1, 3, 2).reshape(n, WINDOW - w + 1, w * VECTOR)
        response = patches @ p[f"f{w}"] + p[f"b{w}"]
        where = response.argmax(axis=1)
        best.append((where, patches))
        pooled.append(np.take_along_axis(response, where[:, None, :], axis=1)[:, 0])
    hidden = np.hstack(pooled)
    active = np.maximum(hidden, 0)
    error = _softmax(active @ p["o"] + p["ob"])
    loss = -np.log(error[np.arange(n), y]).mean()
    error[np.arange(n), y] -= 1
    error /= n
    grad = {"o": active.T @ error, "ob": error.sum(0), "v": np.zeros_like(p["v"])}
    back = (error @ p["o"].T) * (hidden > 0)
    for k, w in enumerate(WIDTHS):
        g, (where, patches) = back[:, k * FILTERS : (k + 1) * FILTERS], best[k]
        at_best = patches[np.arange(n)[:, None], where]  # (n, FILTERS, w * VECTOR)
        grad[f"f{w}"], grad[f"b{w}"] = np.einsum("nf,nfk->kf", g, at_best), g.sum(0)
        to_vectors = (g[:, :, None] * p[f"f{w}"].T[None]).reshape(n, FILTERS, w, VECTOR)
        bytes_at = x[np.arange(n)[:, None, None], where[:, :, None] + np.arange(w)]
        np.add.at(grad["v"], bytes_at.ravel(), to_vectors.reshape(-1, VECTOR))
    return float(loss), grad


def train(rows: list[tuple[str, str]], steps: int = STEPS, seed: int = 5) -> Model:
    """The network of (text, language) rows. With one language only, that language is always predicted."""
    rng = np.random.default_rng(seed)
    languages = sorted({lang for _, lang in rows})
    raws = [as_bytes(t) for t, _ in rows]
    counts = sum(np.bincount(np.frombuffer(r, dtype=np.uint8), minlength=256) for r in raws)
    classes = np.full(256, CLASSES - 1, dtype=np.uint8)
    common = np.argsort(-counts, kind="stable")[: CLASSES - 2]
    classes[common] = np.arange(1, CLASSES - 1)
    cut = [windows(r, classes) for r in raws]
    y = np.repeat([languages.index(lang) for _, lang in rows], [len(c) for c in cut])
    x = np.concatenate(cut)
    p = initial(len(languages), rng)
    first, second = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}
    order, at = rng.permutation(len(x)), 0
    for step in range(1, steps + 1):
        if at >= len(order):
            order, at = rng.permutation(len(x)), 0
        pick = order[at : at + BATCH]
        at += BATCH
        for k, g in gradients(p, x[pick], y[pick])[1].items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            p[k] = p[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Model(languages, classes, p["v"], [p[f"f{w}"] for w in WIDTHS], [p[f"b{w}"] for w in WIDTHS], p["o"], p["ob"])


class Scorer:
    """A model folded into tables over pairs of classes: widths 2, 3 and 4 take one, two and two look-ups."""

    def __init__(self, model: Model):
        self.model = model
        taps = {w: [model.vectors @ f.reshape(w, VECTOR, FILTERS)[j] for j in range(w)] for w, f in zip(WIDTHS, model.filters, strict=True)}
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(-1, FILTERS).astype(np.float32)
        self.two = pair(*taps[2])
        self.three, self.third = pair(*taps[3][:2]), taps[3][2].astype(np.float32)
        self.four, self.last = pair(*taps[4][:2]), pair(*taps[4][2:])
        self.offset = np.concatenate(model.offsets).astype(np.float32)

    def windows(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of each language for each window."""
        n = len(x)
        codes = x[:, :-1].astype(np.intp) * CLASSES + x[:, 1:]
        take = lambda table, at: table.take(at.ravel(), axis=0).reshape(n, -1, FILTERS)
        three = take(self.three, codes[:, :-1])
        three += take(self.third, x[:, 2:].astype(np.intp))
        four = take(self.four, codes[:, :-2])
        four += take(self.last, codes[:, 2:])
        pooled = np.hstack([take(self.two, codes).max(axis=1), three.max(axis=1), four.max(axis=1)]) + self.offset
        return _softmax(np.maximum(pooled, 0) @ self.model.out + self.model.out_offset)

    def texts(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text: the mean over all its windows; ``und`` and 0 without a letter."""
        known = [i for i, t in enumerate(texts) if t is not None and has_letter(t)]
        lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not known or not self.model.languages:
            return lang, score
        cut = [windows(as_bytes(texts[i]), self.model.classes) for i in known]
        x = np.concatenate(cut)
        p = np.concatenate([self.windows(x[at : at + BLOCK]) for at in range(0, len(x), BLOCK)])
        ends = np.cumsum([len(c) for c in cut])
        mean = np.add.reduceat(p, np.concatenate([[0], ends[:-1]]), axis=0) / np.diff(np.concatenate([[0], ends]))[:, None]
        for i, row in zip(known, mean, strict=True):
            best = int(row.argmax())
            lang[i], score[i] = self.model.languages[best], min(1.0, float(row[best]))
        return lang, score


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """The model of the documents outside the held-out fold that have an id, a text with a letter and a language.

    Whole texts are taken, of about ``sample_rows`` ids, one row of each. If they are more than ``sample_bytes``
    together, rows are left out until they fit; the driver holds no more than that."""
    usable = F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull()
    learn = docs.where(usable & (held_out(F.col("doc_id"), FOLDS) != HELD)).select("doc_id", "text", "lang")
    kept = sampled_ids(learn.select("doc_id").distinct(), sample_rows)
    one = F.min(F.struct("text", "lang")).alias("row")
    table = materialise(learn.join(F.broadcast(kept), "doc_id").groupBy("doc_id").agg(one).select("doc_id", "row.*"), "language-sample")
    ids = within([tuple(r) for r in table.select("doc_id", F.octet_length("text")).collect()], sample_bytes)
    chosen = F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in ids], "doc_id long"))
    found = {r["doc_id"]: (r["text"], r["lang"]) for r in table.join(chosen, "doc_id").toLocalIterator()}
    rows = [found[i] for i in ids if has_letter(found[i][0])]
    if not rows:
        return Model([], np.zeros(256, dtype=np.uint8), np.zeros((CLASSES, VECTOR)), [np.zeros((w * VECTOR, FILTERS)) for w in WIDTHS], [np.zeros(FILTERS)] * 3, np.zeros((len(WIDTHS) * FILTERS, 1)), np.zeros(1))
    return train(rows)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; null and letterless texts are ``und`` with score 0.

    Repeated rows have equal results. A null id is passed on, and is in the held-out fold if '' is. Extra columns
    are not looked at; an empty table gives no rows. Texts of any length are scored whole, by all their windows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in row_batches(batches, 4 << 20):
            ids = batch.column(0).to_pylist()
            lang, score = scorer.texts(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([is_held_out(i, FOLDS) == HELD for i in ids]), pa.array(lang, pa.string()), pa.array(score)],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, SCORE_SCHEMA)


def filter_rows(docs: DataFrame, model: Model, least: float, columns: tuple[str, ...]) -> DataFrame:
    """``columns`` of the rows whose language is known with a score of ``least`` or more; ``text`` is one of them."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in row_batches(batches, 4 << 20):
            lang, score = scorer.texts(batch.column(at).to_pylist())
            yield batch.filter(pa.array([x != UNKNOWN and s >= least for x, s in zip(lang, score, strict=True)]))

    rows = docs.select(*columns)
    return rows.mapInArrow(run, rows.schema)


def identify(docs: DataFrame) -> DataFrame:
    """Fits on the documents outside the held-out fold and predicts every document."""
    return predict(docs, fit(docs))
