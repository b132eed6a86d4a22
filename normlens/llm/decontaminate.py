"""Benchmark decontamination: a prefix-filtered set join of windows of words.

Everything here is DataFrame expressions. An item's windows are runs of ``WINDOW`` words, or all words of a shorter item.
A window is the set of its shingles, with their places. A document that holds the window holds all of its shingles, so
by the prefix filter for full containment one of them is enough to find it: the rarest.

1. Rarity. Shingles of all documents are counted, but only those that stand in the benchmark: a broadcast join without
   an exchange, then partial counts.
2. Prefix. Each window keeps its rarest shingle and the place where it stands.
3. Join. Each place of each document meets the windows whose prefix shingle stands there: a broadcast join again, so
   texts are never exchanged. The window has to begin and end inside the document (position and length bounds).
4. Verification. The document's words at the window's place have to equal the window's, one by one.

Only hits (document, place, length, items) and one row a document are exchanged. Tables that are broadcast have a
counted size; beyond ``BROADCAST_ROWS`` the benchmark is taken in several parts, each with its own pass over the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normlens.llm.common import forget, materialise

WINDOW = 10
SHINGLE = 3
BROADCAST_ROWS = 500_000
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words: ASCII, and neither digit nor letter.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text, with A-Z lower-cased and no other letter; none for null.

    Texts and words of ASCII alone take the fast ``lower``, which would change other capitals too."""
    plain = lambda c: F.length(c) == F.octet_length(c)
    one = lambda w: F.when(plain(w), F.lower(w)).otherwise(F.translate(w, CAPITALS, SMALL))
    cut = F.when(plain(text), F.split(F.lower(text), BETWEEN)).otherwise(F.transform(F.split(text, BETWEEN), one))
    return F.coalesce(F.array_remove(cut, ""), F.array().cast("array<string>"))


def shingle_key(words: Column, at: Column, size: int) -> Column:
    """Hash of ``size`` words from place ``at`` (from 0); null where the words end before. Equal words have equal keys."""
    return F.when((at >= 0) & (at + size <= F.size(words)), F.xxhash64(F.lit(size), *[F.get(words, at + i) for i in range(size)]))


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """words (joined by one space, A-Z lower-cased), length, items (sorted ids): each different window once."""
    worded = items.select("item_id", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    length = F.least(F.lit(window), F.size("w"))
    placed = worded.select("item_id", "w", length.alias("length"), F.explode(F.sequence(F.lit(1), F.size("w") - length + 1)).alias("at"))
    cut = placed.select("item_id", "length", F.array_join(F.slice("w", F.col("at"), F.col("length")), " ").alias("words"))
    return cut.groupBy("words", "length").agg(F.array_sort(F.collect_set("item_id")).alias("items"))


def window_shingles(windows: DataFrame, shingle: int) -> DataFrame:
    """window columns, and each shingle's key and place; shingles are shorter only where the window is."""
    words = F.split("words", " ")
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("length") - shingle))).alias("place")
    key = F.coalesce(*[shingle_key(F.col("w"), F.col("place"), s) for s in range(shingle, 0, -1)])
    return windows.withColumn("w", words).select("*", at).select("words", "length", "items", "place", key.alias("key"))


def document_shingles(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """Each place of each document with the keys of the shingles that begin there, and place -1 without any key.

    The columns of a document ride along by reference."""
    placed = docs.select("*", F.explode(F.sequence(F.lit(-1), F.size("w") - 1)).alias("at"))
    keys = [shingle_key(F.col("w"), F.col("at"), s) for s in sizes]
    if len(keys) == 1:
        return placed.withColumn("key", keys[0])
    return placed.select("*", F.explode(F.when(F.col("at") >= 0, F.array(*keys)).otherwise(F.array(F.lit(None).cast("long")))).alias("key"))


def in_parts(table: DataFrame, rows: int, key: str) -> list[DataFrame]:
    """``table`` in parts of about ``rows`` rows by a hash of ``key``, each marked for broadcast."""
    parts = max(1, -(-table.count() // rows))
    if parts == 1:
        return [F.broadcast(table)]
    return [F.broadcast(table.where(F.pmod(F.xxhash64(key, F.lit(1)), F.lit(parts)) == p)) for p in range(parts)]


def union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def rarest(shingles: DataFrame, docs: DataFrame, sizes: list[int], shingle: int, rows: int) -> DataFrame:
    """Of each window the shingle that occurs least often in the documents, the first of equals.

    Windows with a shingle that occurs nowhere are left out."""
    own = materialise(shingles.select(F.col("key").alias("item_key")).distinct(), "keys")
    met = [document_shingles(docs.select("w"), sizes).join(part, F.col("key") == F.col("item_key")).select("key") for part in in_parts(own, rows, "item_key")]
    counts = materialise(union(met).groupBy("key").agg(F.count(F.lit(1)).alias("occurs")), "counts")
    joined = shingles.join(counts.withColumnRenamed("key", "counted"), F.col("key") == F.col("counted"))
    first = F.min(F.struct("occurs", "place", "key")).alias("first")
    chosen = joined.groupBy("words", "length").agg(first, F.first("items").alias("items"), F.count(F.lit(1)).alias("seen"))
    chosen = chosen.where(F.col("seen") == F.greatest(F.lit(1), F.col("length") - shingle + 1))
    found = materialise(chosen.select("words", "length", "items", "first.place", F.col("first.key").alias("prefix")), "prefixes")
    forget(own)
    forget(counts)
    return found


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: one row for each document.

    A word is hit if it lies in any occurrence of a window of any item. Null and empty texts have no words and are clean;
    items without words have no windows. Items with one id count once; an item without an id hits words, but is not
    counted. Repeated rows of documents each give a row, null ids too. Texts of any length are read whole. Without items
    all documents are clean; without documents there are no rows. Other columns are not read."""
    text = F.coalesce("text", F.lit(""))
    worded = docs.select("doc_id", "text", words_of(F.col("text")).alias("w"))
    windows = materialise(item_windows(items, window), "windows")
    lengths = [r[0] for r in windows.select(F.least("length", F.lit(shingle))).distinct().collect()]  # at most ``shingle`` of them
    sizes = sorted(lengths, reverse=True) or [shingle]
    prefixes = rarest(window_shingles(windows, shingle), worded, sizes, shingle, broadcast_rows)
    forget(windows)

    digest = F.unhex(F.sha2(text, 256))
    met = []
    for number, part in enumerate(in_parts(prefixes, broadcast_rows, "prefix")):
        begin = F.col("at") - F.col("place")
        inside = (begin >= 0) & (begin + F.col("length") <= F.size("w"))
        holds = F.when(inside, F.array_join(F.slice("w", begin + 1, F.col("length")), " ") == F.col("words"))
        first = (F.col("at") == -1) & F.lit(number == 0)  # one row for each document, hit or not
        rows = document_shingles(worded, sizes).join(part, (F.col("key") == F.col("prefix")) & inside, "left").where(first | holds)
        span = F.when(~first, F.struct(begin.alias("begin"), F.col("length")))
        met.append(rows.select("doc_id", digest.alias("digest"), F.size("w").cast("long").alias("n_words"), first.cast("int").alias("copies"), span.alias("span"), "items"))
    found = union(met).groupBy("doc_id", "digest").agg(
        F.max("n_words").alias("n_words"),
        F.sum("copies").alias("copies"),
        F.array_sort(F.collect_set("span")).alias("spans"),
        F.array_sort(F.transform(F.array_distinct(F.flatten(F.collect_set("items"))), lambda i: i.cast("string"))).alias("items"),
    )
    start = F.struct(F.lit(0).alias("hit"), F.lit(0).alias("reach"))

    def add(done: Column, span: Column) -> Column:
        end = span["begin"] + span["length"]
        new = F.greatest(F.lit(0), end - F.greatest(done["reach"], span["begin"]))
        return F.struct((done["hit"] + new).alias("hit"), F.greatest(done["reach"], end).alias("reach"))

    n_hit = F.aggregate("spans", start, add, lambda done: done["hit"]).cast("long")
    rows = found.select("doc_id", "n_words", n_hit.alias("n_hit"), "items", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return rows.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
