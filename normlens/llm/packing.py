"""Packing by concatenate and cut.

Pass 1 tokenises every document and writes its ids, its place in its partition and the tokens before
it there. The partition totals (one number for each input split) give each partition's global offset by
a prefix sum. Pass 2 adds that offset and cuts the one long stream of ids at multiples of the window;
a document that lies across a cut yields one boundary record for each window that it touches.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normlens.llm.common import keep_between_tasks, materialise, row_batches

TOKENS_SCHEMA = "doc_id long, part int, part_offset long, doc_tokens long, ids binary"
PIECES_SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long, ids binary"
)
#: Characters at which str.split() splits although the tokenizer does not see white space there.
NOT_SPACE = re.compile("[\x1c-\x1f]")
#: Words whose composition, case and classes are beyond doubt: visible Latin below the combining marks.
#: Characters of text whose words are looked up together.
LEARN_CHARS = 1 << 20
PLAIN = re.compile("[\n!-~\u00a1-\u012f\u0131-\u024f]+")


class WordTokenizer:
    """Ids of whole texts, as the tokenizer file gives them, by way of a cache from words to ids.

    The tokenizer drops white space and looks at nothing across it (composition, lower-casing and the
    split pattern stay inside a run of other characters), so the ids of a text are the ids of its words
    in turn. Words of plain Latin letters, digits and signs are cut further into the tokenizer's own
    pre-tokens, of which each ends with exactly one id that has the end-of-word mark; those that the cache
    lacks are encoded together in one call and parted at these ids. All other words, and texts that hold a
    special token or characters on whose class the two sides differ, are encoded as they are.
    """

    def __init__(self, path: str, cache_limit: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        self.specials = [t["content"] for t in spec["added_tokens"]]
        suffix = spec["model"].get("end_of_word_suffix")
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        parts = [x for x in (spec["normalizer"] or {}).get("normalizers", []) if x["type"] == "Lowercase"]
        self.by_words = bool(suffix and parts and steps and steps[0]["type"] == "Split" and steps[0]["behavior"] == "Removed")
        vocab = self.tokenizer.get_vocab()
        self.dtype = np.dtype("<u4" if max(vocab.values()) >= 1 << 16 else "<u2")
        if self.by_words:
            self.pattern = regex.compile(steps[0]["pattern"]["Regex"])
            self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
            self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.limit = cache_limit  # of words; parts get three quarters of it

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def part_ids(self, parts: list[str]) -> list[bytes]:
        """The ids of pre-tokens. They are kept while there is room; the commonest come first."""
        out = list(map(self.parts.get, parts))
        missing = list({p for p, x in zip(parts, out, strict=True) if x is None})
        if not missing:
            return out
        ids = np.array(self.tokenizer.encode(" ".join(missing), add_special_tokens=False).ids, dtype=self.dtype)
        cuts = ((np.flatnonzero(self.ends[ids]) + 1) * self.dtype.itemsize).tolist()
        if len(cuts) != len(missing):
            raise ValueError("pre-tokens and end-of-word ids differ in number")
        raw = ids.tobytes()
        new = dict(zip(missing, [raw[a:b] for a, b in zip([0, *cuts], cuts, strict=False)], strict=True))
        if len(self.parts) + len(new) <= self.limit * 3 // 4:
            self.parts.update(new)
        return [new[p] if x is None else x for p, x in zip(parts, out, strict=True)]

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """The ids of distinct words that the cache lacks; it takes them in while there is room."""
        out = {}
        joined = "\n".join(words)
        if not PLAIN.fullmatch(joined):
            out = {w: self.whole(w) for w in words if not PLAIN.fullmatch(w)}
            words = [w for w in words if w not in out]
            joined = "\n".join(words)
        found, owner = [], []
        for i, x in enumerate(joined.lower().split("\n") if words else []):
            if x.isalpha():
                found.append(x)
                owner.append(i)
            else:
                parts = self.pattern.findall(x)
                found += parts
                owner += [i] * len(parts)
        ids = self.part_ids(found)
        at = np.searchsorted(owner, np.arange(len(words) + 1)).tolist()
        out.update((w, ids[a] if b == a + 1 else b"".join(ids[a:b])) for w, a, b in zip(words, at, at[1:], strict=False))
        if len(self.words) + len(out) <= self.limit:
            self.words.update(out)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, little-endian, of ``dtype``."""
        out: list[bytes] = []
        words: list[str] = []
        ends: list[int | None] = []
        size = start = 0
        for i, text in enumerate(texts):
            if not self.by_words or NOT_SPACE.search(text) or any(x in text for x in self.specials):
                ends.append(None)
            else:
                words += text.split()
                ends.append(len(words))
            size += len(text)
            if size >= LEARN_CHARS or i == len(texts) - 1:
                ids = list(map(self.words.get, words))
                missing = [k for k, x in enumerate(ids) if x is None]
                new = self.learn(list({words[k] for k in missing}))
                for k in missing:
                    ids[k] = new[words[k]]
                last = 0
                for k, end in enumerate(ends):
                    if end is None:
                        out.append(self.whole(texts[start + k]))
                    else:
                        out.append(b"".join(ids[last:end]))
                        last = end
                size, start, words, ends = 0, i + 1, [], []
        return out


_CODERS: dict[str, WordTokenizer] = {}


def coder_for(path: str) -> WordTokenizer:
    """One for each Python worker, so that later tasks find the words of earlier ones."""
    if path not in _CODERS:
        _CODERS[path] = WordTokenizer(path)
        keep_between_tasks("packing", _CODERS.clear)
    return _CODERS[path]


def tokenise(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """doc_id, part, part_offset, doc_tokens, ids: each row's ids with ``end_id`` after them.

    A null text counts as empty and gives the end id alone. Rows are kept one for one, repeated ids too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_for(tokenizer_path)
        end = np.array([end_id], dtype=coder.dtype).tobytes()
        part, before = TaskContext.get().partitionId(), 0
        for batch in row_batches(batches, 4 << 20, owner="packing"):
            coded = [x + end for x in coder.encode([t or "" for t in batch.column(1).to_pylist()])]
            sizes = np.array([len(x) for x in coded], dtype=np.int64) // coder.dtype.itemsize
            ends = before + np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array([part] * len(coded), pa.int32()), pa.array(ends - sizes), pa.array(sizes), pa.array(coded, pa.binary())],
                names=["doc_id", "part", "part_offset", "doc_tokens", "ids"],
            )
            before = int(ends[-1])

    return docs.select("doc_id", "text").mapInArrow(run, TOKENS_SCHEMA)


def pack(docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 1) -> DataFrame:
    """One row for each piece: a run of one document's ids inside one sequence.

    Columns: doc_id; start (the document's ids before the piece); length; ids_crc32 (over little-endian
    unsigned 32-bit ids); doc_tokens; sequence_id; offset (in the sequence); ids (the piece's ids, binary,
    unsigned 32 bit). Pieces of a sequence leave no gap, and every sequence but the last is full, so only
    the last needs padding. A null or empty text is its end id alone; repeated rows and ids, and null ids, are documents
    like any other; a very long text is cut over as many sequences as it needs. An empty table gives no rows. Extra
    columns of ``docs`` are not looked at.
    The driver holds one total for each partition of the token table, not more.
    """
    width = WordTokenizer(tokenizer_path).dtype.itemsize
    tokens = materialise(tokenise(docs, tokenizer_path, end_id), "tokens")
    totals = tokens.groupBy("part").agg(F.sum("doc_tokens").alias("n")).orderBy("part").collect()
    bases, before = {}, 0
    for row in totals:
        bases[row["part"]] = before
        before += row["n"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_batches(batches, 4 << 20, owner="packing"):
            doc_id, part, at, n = (batch.column(i).to_pylist() for i in range(4))
            rows: list[tuple] = []
            for i, raw in enumerate(batch.column(4).to_pylist()):
                ids = np.frombuffer(raw, dtype=f"<u{width}").astype("<u4")
                place, done = bases[part[i]] + at[i], 0
                while done < n[i]:
                    sequence, offset = divmod(place + done, window)
                    length = min(window - offset, n[i] - done)
                    piece = ids[done : done + length].tobytes()
                    rows.append((doc_id[i], done, length, zlib.crc32(piece), n[i], sequence, offset, piece))
                    done += length
            kinds = [pa.int64()] * 7 + [pa.binary()]
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"],
            )

    return tokens.mapInArrow(cut, PIECES_SCHEMA)
