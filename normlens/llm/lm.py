"""Language-model scores by deleted interpolation of n-gram estimates.

The model is a word trigram: P(w | u v) mixes the maximum-likelihood trigram, bigram and unigram and the smoothed
unigram base. The weights go by the frequency bucket of the longest context that was seen. They come from
expectation-maximisation on a held-out part of the training documents, against counts of the other part.
A training document is scored with its own counts deleted, so by the model of all others: else each would find
itself in the counts, and only documents outside the training set would show how usual they are.

Counting and look-up are one exchange between text chunks and count buckets:

1. Documents are read in chunks of about ``CHUNK_BYTES``; a chunk is written as its distinct word hashes and
   its words as indices into them.
2. Each chunk asks for the counts of its distinct words, bigrams and trigrams: one packed row for each bucket of
   keys, with the chunk's own counts. A bucket adds up the counts of all chunks and answers each of them. A
   trigram is a bigram with a ``TAG_BITS`` hash of the word after it. The keys of bigrams have ``SPARE_BITS`` more
   than there are tokens, so about one in 65,000 shares its key with another.
3. A chunk and its answers meet again and are written as counts for each token.
4. The tokens that tune the weights are written as their distinct counts. Each round of expectation-maximisation
   is one pass over them, from which a few sums for each bucket return. Last, each chunk scores its texts.

No task holds more than a chunk or the distinct keys of a bucket. Messages are as many as chunks times buckets while both
are few, and never more than the chunks' distinct n-grams; a very common word sends a bucket one from each chunk. Messages
of more than ``HELD_BYTES`` go to a temporary file of the task, from which they are added up and answered in turn.
"""

from __future__ import annotations

import os
import pickle
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normlens.llm.common import clear_shuffles, forget, give_back, is_held_out, materialise, mix64, row_batches, text_bytes, word_hashes

FOLDS = 10  # remainder 0 is held out of all training; remainder DEV tunes the mixture weights
DEV = 1
ALPHA = 0.1
CHUNK_BYTES = 4 << 20
BUCKET_ENTRIES = 2_000_000
HELD_BYTES = 192 << 20  # of a bucket's messages, as they came, in memory
FOLDED = 2_000_000  # entries added to a bucket's sums at once, if its messages are in a file
TAG_BITS, SPARE_BITS, LEAST_BITS = 24, 16, 40
CONTEXT_BUCKETS = 40  # octaves of a context's frequency; first those of words, then those of bigrams
ROUNDS = 20
LEAST_WEIGHT = 1e-3  # of the base, so that no token has probability 0

END, START = np.uint64(0x1D8E4E27C47D124F), np.uint64(0xEB44ACCAB455D165)
_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

CHUNK_SCHEMA = "chunk long, n_docs long, n_words long, ids binary, counts binary, vocabulary binary, words binary, n_unique long"
ASK_SCHEMA = "bucket long, chunk long, n long, n_tri long, message binary"
ANSWER_SCHEMA = "chunk long, bucket long, n long, n_tri long, message binary, n_known long, n_known_fit long"
COUNTED_SCHEMA = "n_docs long, n_words long, n_unique long, ids binary, counts binary, words binary, word_counts binary, token_counts binary"
SUMS = ("s0", "s1", "s2", "s3", "n")


def squeeze(a: np.ndarray) -> bytes:
    """The array's bytes, plane by plane, compressed."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if len(a) else b""


def expand(raw: bytes, n: int, dtype: str) -> np.ndarray:
    if not n:
        return np.zeros(0, dtype=dtype)
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(pa.decompress(raw, decompressed_size=n * size, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).reshape(-1).view(dtype)


def pack(*arrays: np.ndarray) -> bytes:
    """Several arrays in one compressed value."""
    planes = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes() for a in arrays)
    return pa.compress(planes, codec="zstd", asbytes=True) if planes else b""


def unpack(raw: bytes, *shapes: tuple[int, str]) -> list[np.ndarray]:
    sizes = [n * np.dtype(kind).itemsize for n, kind in shapes]
    whole = np.frombuffer(pa.decompress(raw, decompressed_size=sum(sizes), codec="zstd", asbytes=True) if sum(sizes) else b"", dtype=np.uint8)
    out, at = [], 0
    for (n, kind), size in zip(shapes, sizes, strict=True):
        out.append(np.ascontiguousarray(whole[at : at + size].reshape(-1, n).T).reshape(-1).view(kind) if n else np.zeros(0, dtype=kind))
        at += size
    return out


def steps(keys: np.ndarray) -> np.ndarray:
    """Differences of sorted keys, which squeeze better; their running sums are the keys."""
    return np.diff(keys, prepend=np.zeros(1, dtype=np.uint64))


def parts_of(ids: list[int | None] | np.ndarray) -> np.ndarray:
    """0 held out, 1 tunes the weights, 2 counted only."""
    rest = np.array([is_held_out(i, FOLDS) for i in ids], dtype=np.int64)
    return np.where(rest == 0, 0, np.where(rest == DEV, 1, 2))


def chunks(docs: DataFrame) -> DataFrame:
    """The documents in chunks: ids (and whether null), words of each, distinct words, words as indices."""

    def build(ids: list, raws: list[bytes], number: int) -> pa.RecordBatch:
        hashes, counts = word_hashes([r.lower() for r in raws])
        vocabulary, index, often = np.unique(hashes, return_inverse=True, return_counts=True)
        order = np.argsort(-often, kind="stable")  # common words get small indices, which squeeze better
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        known = np.array([[0 if i is None else i, i is None] for i in ids], dtype="<i8").reshape(-1, 2)
        columns = [
            [TaskContext.get().partitionId() << 32 | number],
            [len(ids)],
            [len(hashes)],
            [squeeze(known.reshape(-1))],
            [squeeze(counts.astype("<i8"))],
            [squeeze(vocabulary[order].astype("<u8"))],
            [squeeze(rank[index].astype("<u4"))],
            [len(order)],
        ]
        kinds = [pa.int64()] * 3 + [pa.binary()] * 4 + [pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in CHUNK_SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        raws: list[bytes] = []
        size = number = 0
        for batch in row_batches(batches, CHUNK_BYTES):
            for i, raw in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                ids.append(i)
                raws.append(raw)
                size += len(raw) + 64
                if size >= CHUNK_BYTES:
                    yield build(ids, raws, number)
                    ids, raws, size, number = [], [], 0, number + 1
        if ids:
            yield build(ids, raws, number)

    return docs.select("doc_id", "text").mapInArrow(run, CHUNK_SCHEMA)


@dataclass
class Chunk:
    """A chunk laid out token by token: each document's words, then its end."""

    ids: list
    owner: np.ndarray  # document of each token
    token: np.ndarray  # index into keys of each token; the last key is the end
    before: np.ndarray  # the same of the token before; len(keys) at a document's start
    keys: np.ndarray | None  # hashes of the distinct tokens, if they are wanted

    @staticmethod
    def read(row: dict) -> Chunk:
        n, words, unique = row["n_docs"], row["n_words"], row["n_unique"]
        known = expand(row["ids"], 2 * n, "<i8").reshape(-1, 2)
        counts = expand(row["counts"], n, "<i8")
        keys = np.append(expand(row["vocabulary"], unique, "<u8"), END) if row["vocabulary"] is not None else None
        ends = np.cumsum(counts + 1) - 1
        token = np.full(words + n, unique, dtype=np.int64)
        inner = np.ones(words + n, dtype=bool)
        inner[ends] = False
        token[inner] = expand(row["words"], words, "<u4")
        before = np.empty_like(token)
        before[1:] = token[:-1]
        before[np.concatenate([[0], ends[:-1] + 1])] = unique + 1
        owner = np.repeat(np.arange(n), counts + 1)
        return Chunk([None if null else int(i) for i, null in known], owner, token, before, keys)

    def pairs(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of ``bits`` bits of the distinct bigrams, sorted; and which of them each token ends."""
        left = np.append(self.keys, START)[self.before]
        hashes = mix64(left * _LEFT + self.keys[self.token] * _RIGHT) >> np.uint64(64 - bits)
        return np.unique(hashes, return_inverse=True)

    def triples(self, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of the distinct trigrams (bigram before, tag of the word), sorted; which tokens end one; and which."""
        inner = np.flatnonzero(self.before <= len(self.keys) - 1)  # not the first of a document
        tag = (self.keys >> np.uint64(64 - TAG_BITS))[self.token[inner]]
        codes, index = np.unique(pair[inner - 1].astype(np.uint64) << np.uint64(TAG_BITS) | tag, return_inverse=True)
        return codes, inner, index


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]
    give_back()


def ask(table: DataFrame, key_bits: int, unigram_bits: int, bigram_bits: int) -> DataFrame:
    """Each chunk's requests: for each bucket, sorted keys and the chunk's own counts of both training parts.

    Buckets are the leading bits of a key; those of bigrams come after those of words. A bigram's bucket has its
    trigrams too: how many, their tags, and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            chunk = Chunk.read(row)
            part = parts_of(chunk.ids)[chunk.owner]

            def tally(index: np.ndarray, part: np.ndarray, n: int) -> list[np.ndarray]:
                return [np.bincount(index[part == k], minlength=n).astype("<u4") for k in (2, 1)]

            def cuts(keys: np.ndarray, width: int, bits: int) -> list[int]:
                edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(width - bits) if bits else np.zeros(0, dtype=np.uint64)
                return [0, *np.searchsorted(keys, edges).tolist(), len(keys)]

            found = []
            order = np.argsort(chunk.keys, kind="stable")
            rank = np.empty(len(order), dtype=np.int64)
            rank[order] = np.arange(len(order))
            keys, (fit, dev) = chunk.keys[order], tally(rank[chunk.token], part, len(order))
            at = cuts(keys, 64, unigram_bits)
            for k, (a, b) in enumerate(zip(at, at[1:], strict=False)):
                if b > a:
                    found.append((k, row["chunk"], b - a, 0, pack(steps(keys[a:b]), fit[a:b], dev[a:b])))
            keys, pair = chunk.pairs(key_bits)
            fit, dev = tally(pair, part, len(keys))
            codes, inner, index = chunk.triples(pair)
            tri_fit, tri_dev = tally(index, part[inner], len(codes))
            many = np.bincount((codes >> np.uint64(TAG_BITS)).astype(np.int64), minlength=len(keys)).astype("<u4")
            tags = (codes & np.uint64((1 << TAG_BITS) - 1)).astype("<u4")
            first = np.concatenate([[0], np.cumsum(many, dtype=np.int64)])
            at = cuts(keys, key_bits, bigram_bits)
            for k, (a, b) in enumerate(zip(at, at[1:], strict=False)):
                if b > a:
                    c, d = int(first[a]), int(first[b])
                    blob = pack(steps(keys[a:b]), fit[a:b], dev[a:b], many[a:b], tags[c:d], tri_fit[c:d], tri_dev[c:d])
                    found.append(((1 << unigram_bits) + k, row["chunk"], b - a, d - c, blob))
            for at in range(0, len(found), 1000):
                columns = zip(*found[at : at + 1000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 4 + [pa.binary()], strict=True)], names=["bucket", "chunk", "n", "n_tri", "message"])

    return table.mapInArrow(run, ASK_SCHEMA)


def read_message(r: dict, words: bool) -> list[np.ndarray]:
    """Sorted keys and the chunk's counts of both parts; of bigrams also their numbers of trigrams, the tags, and counts."""
    kinds = [(r["n"], "<u8"), (r["n"], "<u4"), (r["n"], "<u4")] + ([] if words else [(r["n"], "<u4")] + [(r["n_tri"], "<u4")] * 3)
    found = unpack(r["message"], *kinds)
    found[0] = np.cumsum(found[0], dtype=np.uint64)
    return found


class Spool:
    """A bucket's messages in a temporary file of the task, which goes with it. They can be read again and again.

    It lies where Spark spills, in the executor's own folders; a task that is run again elsewhere writes its own."""

    def __init__(self, rows: list[dict]):
        self.file = tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)
        for r in rows:
            self.add(r)

    def add(self, r: dict) -> None:
        pickle.dump((r["bucket"], r["chunk"], r["n"], r["n_tri"], r["message"]), self.file)

    def __iter__(self) -> Iterator[dict]:
        self.file.seek(0)
        while True:
            try:
                yield dict(zip(("bucket", "chunk", "n", "n_tri", "message"), pickle.load(self.file), strict=True))  # noqa: S301 - what this task wrote
            except EOFError:
                return


class Sums:
    """Sorted keys with two sums, to which entries are added many at once."""

    def __init__(self, folded: int):
        self.keys, self.fit, self.dev = np.zeros(0, "<u8"), np.zeros(0, "<u8"), np.zeros(0, "<u8")
        self.parts: list[tuple] = []
        self.waiting, self.folded = 0, folded

    def add(self, keys: np.ndarray, fit: np.ndarray, dev: np.ndarray) -> None:
        self.parts.append((keys, fit, dev))
        self.waiting += len(keys)
        if self.waiting >= max(self.folded, len(self.keys)):
            self.fold()

    def fold(self) -> None:
        keys, fit, dev = (np.concatenate([x.astype("<u8") for x in c]) for c in zip((self.keys, self.fit, self.dev), *self.parts, strict=True))
        self.keys, index = np.unique(keys, return_inverse=True)
        self.fit, self.dev = (np.zeros(len(self.keys), "<u8") for _ in range(2))
        np.add.at(self.fit, index, fit)
        np.add.at(self.dev, index, dev)
        self.parts, self.waiting = [], 0


def spooled_answers(spool: Spool, words: bool, folded: int = FOLDED) -> Iterator[tuple]:
    """The rows of a bucket's answers, with no more in memory than its distinct keys and a few messages."""
    pairs, triples = Sums(folded), Sums(folded)
    for r in spool:
        pairs.add(*read_message(r, words)[:3])
    pairs.fold()

    def codes(m: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray | None]:
        own = np.searchsorted(pairs.keys, m[0])
        return own, None if words else np.repeat(own.astype(np.uint64), m[3]) << np.uint64(TAG_BITS) | m[4]

    if not words:
        for r in spool:
            m = read_message(r, words)
            triples.add(codes(m)[1], m[5], m[6])
        triples.fold()
    known, known_fit = int(np.count_nonzero(pairs.fit + pairs.dev)), int(np.count_nonzero(pairs.fit))
    for r in spool:
        own, third = codes(read_message(r, words))
        back = [pairs.fit[own], pairs.dev[own]]
        if not words:
            at = np.searchsorted(triples.keys, third)
            back += [triples.fit[at], triples.dev[at]]
        yield r["chunk"], r["bucket"], r["n"], r["n_tri"], pack(*back), known, known_fit


def answerer(unigram_bits: int, held_bytes: int = HELD_BYTES) -> Callable:
    """Adds up a bucket's counts over all chunks and answers each chunk; rows come sorted by bucket.

    Each answer also tells how many keys the bucket has (of all training, and of its counted part)."""

    def table(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64()] * 4 + [pa.binary()] + [pa.int64()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)], names=[c.split()[0] for c in ANSWER_SCHEMA.split(", ")])

    def sums(index: np.ndarray, columns: list[list[np.ndarray]], n: int) -> list[np.ndarray]:
        return [np.bincount(index, weights=np.concatenate(c), minlength=n).astype("<u8") for c in columns]

    def reply(asked: list[dict]) -> pa.RecordBatch:
        words = asked[0]["bucket"] < 1 << unigram_bits
        read = [read_message(r, words) for r in asked]
        unique, index = np.unique(np.concatenate([m[0] for m in read]), return_inverse=True)
        fit, dev = sums(index, [[m[1] for m in read], [m[2] for m in read]], len(unique))
        known, known_fit = int(np.count_nonzero(fit + dev)), int(np.count_nonzero(fit))
        if not words:
            many, tags = np.concatenate([m[3] for m in read]), np.concatenate([m[4] for m in read])
            triples, of = np.unique(np.repeat(index.astype(np.uint64), many) << np.uint64(TAG_BITS) | tags, return_inverse=True)
            tri_fit, tri_dev = sums(of, [[m[5] for m in read], [m[6] for m in read]], len(triples))
        rows, at, to = [], 0, 0
        for r in asked:
            own = index[at : at + r["n"]]
            back = [fit[own], dev[own]]
            if not words:
                third = of[to : to + r["n_tri"]]
                back += [tri_fit[third], tri_dev[third]]
            rows.append((r["chunk"], r["bucket"], r["n"], r["n_tri"], pack(*back), known, known_fit))
            at, to = at + r["n"], to + r["n_tri"]
        return table(rows)

    def answer(held: list[dict], spool: Spool | None) -> Iterator[pa.RecordBatch]:
        if spool is None:
            yield reply(held)
            return
        words = next(iter(spool))["bucket"] < 1 << unigram_bits
        rows: list[tuple] = []
        for row in spooled_answers(spool, words):
            rows.append(row)
            if len(rows) >= 1_000 or len(row[4]) > 1 << 20:
                yield table(rows)
                rows = []
        if rows:
            yield table(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        spool, bucket, size = None, None, 0
        for row in rows_of(batches):
            if bucket is not None and row["bucket"] != bucket:
                yield from answer(held, spool)
                held, spool, size = [], None, 0
            bucket, size = row["bucket"], size + len(row["message"]) + 256
            if spool is not None:
                spool.add(row)
                continue
            held.append(row)
            if size > held_bytes:
                held, spool = [], Spool(held)
        if bucket is not None:
            yield from answer(held, spool)

    return run


def counter(key_bits: int, unigram_bits: int) -> Callable:
    """A chunk and its answers, as the counts of each distinct word and of the bigram and trigram that each token ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            chunk = Chunk.read(row)
            got = sorted(row["answers"], key=lambda a: a["bucket"])
            own = [a for a in got if a["bucket"] < 1 << unigram_bits]
            read = [unpack(a["message"], *[(a["n"], "<u8")] * 2) for a in own]
            words = np.zeros((2, len(chunk.keys)), dtype="<u8")
            words[:, np.argsort(chunk.keys, kind="stable")] = np.concatenate(read, axis=1)
            own = [a for a in got if a["bucket"] >= 1 << unigram_bits]
            read = [unpack(a["message"], *[(a["n"], "<u8")] * 2, *[(a["n_tri"], "<u8")] * 2) for a in own]
            _, pair = chunk.pairs(key_bits)
            _, inner, index = chunk.triples(pair)
            tokens = np.zeros((4, len(chunk.token)), dtype="<u8")
            for k in (0, 1):
                tokens[k] = np.concatenate([m[k] for m in read])[pair]
                tokens[2 + k, inner] = np.concatenate([m[2 + k] for m in read])[index]
            columns = [[row[c]] for c in ("n_docs", "n_words", "n_unique", "ids", "counts", "words")] + [[pack(*words)], [pack(*tokens)]]
            kinds = [pa.int64()] * 3 + [pa.binary()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in COUNTED_SCHEMA.split(", ")])

    return run


@dataclass
class Totals:
    tokens: int  # of all training documents, ends included
    types: int
    fit_tokens: int
    fit_types: int
    docs: int  # training documents, the contexts of first words
    fit_docs: int


@dataclass
class Counted:
    """A chunk's tokens with the counts of their words, contexts, bigrams and trigrams: counted part, tuning part."""

    ids: list
    owner: np.ndarray
    token: np.ndarray  # index of each token's word in the chunk
    words: np.ndarray  # these four: (2, tokens)
    before: np.ndarray
    pairs: np.ndarray
    triples: np.ndarray

    @staticmethod
    def read(row: dict, totals: Totals) -> Counted:
        n, words, unique = row["n_docs"], row["n_words"], row["n_unique"]
        chunk = Chunk.read({**row, "vocabulary": None})
        of_words = np.stack(unpack(row["word_counts"], *[(unique + 1, "<u8")] * 2)).astype(np.float64)
        of_words = np.hstack([of_words, [[totals.fit_docs], [totals.docs - totals.fit_docs]]])
        tokens = np.stack(unpack(row["token_counts"], *[(words + n, "<u8")] * 4)).astype(np.float64)
        return Counted(chunk.ids, chunk.owner, chunk.token, of_words[:, chunk.token], of_words[:, chunk.before], tokens[:2], tokens[2:])

    def counts(self, with_dev: bool) -> np.ndarray:
        """(5, tokens): the count of the word, of the word before, of the bigram, of the bigram before, of the trigram.

        The first token of a document has no bigram before it."""
        take = (lambda x: x.sum(axis=0)) if with_dev else (lambda x: x[0])
        pair = take(self.pairs)
        return np.stack([take(self.words), take(self.before), pair, self.one_before(pair, 0), take(self.triples)])

    def one_before(self, x: np.ndarray, first: float) -> np.ndarray:
        """``x`` of the token before, and ``first`` at the beginning of a document."""
        out = np.concatenate([[first], x[:-1]]).astype(x.dtype)
        out[1:][self.owner[1:] != self.owner[:-1]] = first
        return out

    def own_counts(self) -> tuple[np.ndarray, np.ndarray]:
        """The same counts within each token's own document; and which tokens are the first of their word there."""
        _, first, word, words = np.unique(self.owner * (int(self.token.max(initial=0)) + 1) + self.token, return_index=True, return_inverse=True, return_counts=True)
        n = len(first) + 1
        _, pair, pairs = np.unique(self.one_before(word, n - 1) * n + word, return_inverse=True, return_counts=True)
        inner = np.flatnonzero(self.one_before(np.ones(len(word)), 0))
        triples = np.zeros(len(word))
        _, triple, often = np.unique(pair[inner - 1] * n + word[inner], return_inverse=True, return_counts=True)
        triples[inner] = often[triple]
        own_word, own_pair = words[word].astype(np.float64), pairs[pair].astype(np.float64)
        return np.stack([own_word, self.one_before(own_word, 1), own_pair, self.one_before(own_pair, 0), triples]), first


def octave(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.ceil(np.log2(n + 1)).astype(np.int64), CONTEXT_BUCKETS - 1)


def estimates(counts: np.ndarray, tokens: int | np.ndarray, types: int | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each token's longest seen context, and (4, tokens) estimates: base, unigram, bigram, trigram.

    ``tokens`` and ``types`` are the corpus's totals, or those that hold for each token."""
    word, before, pair, context, triple = counts
    over = lambda a, b: np.divide(a, b, out=np.zeros(len(a)), where=b > 0)
    bucket = np.where(context > 0, CONTEXT_BUCKETS + octave(context), octave(before))
    base = (word + ALPHA) / (tokens + ALPHA * (types + 1))
    return bucket, np.stack([base, word / np.maximum(1, tokens), over(pair, before), over(triple, context)])


def tuning_tokens(counted: Counted) -> np.ndarray:
    """(6, distinct): the counts, without the tuning part, of the chunk's tuning tokens; and how many have them."""
    own = parts_of(counted.ids)[counted.owner] == DEV
    counts, often = np.unique(counted.counts(False)[:, own], axis=1, return_counts=True)
    return np.vstack([counts, often]).astype("<u8")


def bucket_sums(tokens: np.ndarray, weights: np.ndarray, totals: Totals) -> np.ndarray:
    """(buckets, 5): of each bucket's tokens the expected number that each estimate stands for, and their number.

    Two more buckets are all contexts of one word, and all of two."""
    often = tokens[5].astype(np.float64)
    bucket, found = estimates(tokens[:5].astype(np.float64), totals.fit_tokens, totals.fit_types)
    out = np.zeros((2 * CONTEXT_BUCKETS + 2, 5))
    for of in (bucket, 2 * CONTEXT_BUCKETS + (bucket >= CONTEXT_BUCKETS)):
        share = weights[of].T * found
        share *= often / share.sum(axis=0)
        for k in range(4):
            out[:, k] += np.bincount(of, weights=share[k], minlength=len(out))
        out[:, 4] += np.bincount(of, weights=often, minlength=len(out))
    return out


def first_weights() -> np.ndarray:
    """Even weights (base, unigram, bigram, trigram) for each bucket; without a bigram before there is no trigram."""
    out = np.full((2 * CONTEXT_BUCKETS + 2, 4), 1 / 4)
    out[[*range(CONTEXT_BUCKETS), 2 * CONTEXT_BUCKETS]] = [1 / 3, 1 / 3, 1 / 3, 0]
    return out


def next_weights(weights: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """The weights after a round. Buckets without tuning tokens keep theirs."""
    out = weights.copy()
    some = sums[:, 4] > 0
    new = np.maximum(sums[some, :4] / sums[some, 4:], [LEAST_WEIGHT, 0, 0, 0])
    out[some] = new / new.sum(axis=1, keepdims=True)
    return out


def last_weights(weights: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Of each bucket; those that no tuning token was in take the weights of all contexts of their length."""
    out = weights[:-2].copy()
    for level in (0, 1):
        own = slice(level * CONTEXT_BUCKETS, (level + 1) * CONTEXT_BUCKETS)
        out[own] = np.where(seen[own, None], weights[own], weights[2 * CONTEXT_BUCKETS + level])
    out[0] = [out[0, 0], out[0, 1] + 1e-12, 0, 0]  # an unseen word before has no bigrams
    out[0] /= out[0].sum()
    return out


def learn_weights(counted: DataFrame, totals: Totals, rounds: int = ROUNDS) -> np.ndarray:
    """Mixture weights of each bucket, by expectation-maximisation over all tuning tokens; one pass for each round."""

    def tune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            found = tuning_tokens(Counted.read(row, totals))
            yield pa.RecordBatch.from_arrays([pa.array([found.shape[1]]), pa.array([pack(*found)], pa.binary())], names=["n", "tokens"])

    table = materialise(counted.mapInArrow(tune, "n long, tokens binary").where("n > 0"), "lm-tuning")

    def summing(weights: np.ndarray) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(weights), 5))
            for row in rows_of(batches):
                total += bucket_sums(np.stack(unpack(row["tokens"], *[(row["n"], "<u8")] * 6)), weights, totals)
            some = np.flatnonzero(total[:, 4])
            yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(total[some, k]) for k in range(5))], names=["bucket", *SUMS])

        return run

    weights, sums = first_weights(), np.zeros((2 * CONTEXT_BUCKETS + 2, 5))
    for _ in range(rounds):
        found = table.mapInArrow(summing(weights), "bucket long, " + ", ".join(f"{c} double" for c in SUMS))
        for r in found.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in SUMS]).collect():
            sums[r["bucket"]] = [r[c] for c in SUMS]
        weights = next_weights(weights, sums)
    forget(table)
    return last_weights(weights, sums[:-2, 4] > 0)


def exchange(docs: DataFrame, held_bytes: int = HELD_BYTES) -> tuple[DataFrame, Totals]:
    """The chunks as counts of their tokens, and the corpus totals."""
    table = materialise(chunks(docs), "lm-chunks")
    sums = table.agg(F.sum("n_words").alias("words"), F.sum("n_docs").alias("docs"), F.sum("n_unique").alias("unique")).first()
    bits = lambda n: max(0, int(np.ceil(np.log2(max(1, n / BUCKET_ENTRIES)))))
    tokens = (sums["words"] or 0) + (sums["docs"] or 0)
    unigram_bits, bigram_bits = bits(sums["unique"] or 0), bits(2 * tokens)
    key_bits = min(64, max(LEAST_BITS, tokens.bit_length() + SPARE_BITS))
    asked = ask(table, key_bits, unigram_bits, bigram_bits).repartition("bucket").sortWithinPartitions("bucket")
    answers = materialise(asked.mapInArrow(answerer(unigram_bits, held_bytes), ANSWER_SCHEMA), "lm-answers")
    del asked
    known = answers.where(F.col("bucket") < 1 << unigram_bits).groupBy("bucket").agg(F.max("n_known").alias("all"), F.max("n_known_fit").alias("fit"))
    types = known.agg(F.sum("all").alias("all"), F.sum("fit").alias("fit")).first()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            known = expand(row["ids"], 2 * row["n_docs"], "<i8").reshape(-1, 2)
            part = parts_of([None if null else int(i) for i, null in known])
            sizes = expand(row["counts"], row["n_docs"], "<i8") + 1
            yield pa.RecordBatch.from_arrays([pa.array([int(x)]) for x in (sizes[part > 0].sum(), sizes[part == 2].sum(), (part > 0).sum(), (part == 2).sum())], names=["a", "b", "c", "d"])

    tallies = table.select("n_docs", "ids", "counts").mapInArrow(count, "a long, b long, c long, d long")
    sums = tallies.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in "abcd"]).first()
    totals = Totals(sums["a"], types["all"] or 0, sums["b"], types["fit"] or 0, sums["c"], sums["d"])
    clear_shuffles(docs.sparkSession)  # the requests, the largest of all, go before chunks are exchanged
    gathered = answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "n", "n_tri", "message")).alias("answers"))
    counted = materialise(table.join(gathered, "chunk").mapInArrow(counter(key_bits, unigram_bits), COUNTED_SCHEMA), "lm-counted")
    forget(answers)
    forget(table)
    return counted, totals


def score(docs: DataFrame, held_bytes: int = HELD_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, score_others for each row of ``docs``.

    The scores are log10 probabilities of the whole text with its end; a null text counts as empty (the end
    alone). base_score and score take all training tokens, a document's own too; score_others is by the same weights without
    the counts of the document itself, so that training documents and others compare. Documents whose id has remainder 0 teach nothing; a null id counts as ''. Without any training
    document every token is unknown and all estimates fall back to the base. Repeated rows count each time.
    Extra columns are not looked at; an empty table gives no rows. A text of any length is one chunk at most.
    """
    counted, totals = exchange(docs, held_bytes)
    return counted.mapInArrow(scorer(learn_weights(counted, totals), totals), SCORE_SCHEMA)


SCORE_SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, score_others double"


def scorer(weights: np.ndarray, totals: Totals) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            counted = Counted.read(row, totals)
            n, counts = len(counted.ids), counted.counts(True)
            add = lambda x, of=counted.owner: np.bincount(of, weights=x, minlength=n)
            own, first = counted.own_counts()
            teaches = parts_of(counted.ids) > 0
            own *= teaches[counted.owner]
            alone = add(counts[0, first] == own[0, first], counted.owner[first])  # words of this document alone
            tokens = totals.tokens - np.bincount(counted.owner, minlength=n) * teaches
            bucket, found = estimates(counts - own, tokens[counted.owner], (totals.types - alone * teaches)[counted.owner])
            others = np.log10((weights[bucket].T * found).sum(axis=0))
            bucket, found = estimates(counts, totals.tokens, totals.types)
            mixed = np.log10((weights[bucket].T * found).sum(axis=0))
            base = np.log10((counts[0] + ALPHA) / (totals.tokens + ALPHA * (totals.types + 1)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(counted.ids, pa.int64()),
                    pa.array(parts_of(counted.ids) == 0),
                    pa.array(np.bincount(counted.owner, minlength=n), pa.int64()),
                    pa.array(add(counts[0] > 0).astype(np.int64)),
                    pa.array([totals.tokens] * n, pa.int64()),
                    pa.array(add(base)),
                    pa.array(add(mixed)),
                    pa.array(add(others)),
                ],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "score_others"],
            )

    return run
