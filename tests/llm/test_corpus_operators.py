"""Top-k search, language model, mixing, near-duplicates and the pipeline against brute force."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from normlens.llm import lm, minhash, mixing, queries, topk

DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None) for i, t, s in rows], DOCS).withColumns({c: F.lit(1) for c in ("size", "score", "node", "region", "shard", "quota", "taken", "rank", "chunk", "found")})


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got = queries.queries()[name](spark, DIR)
    rel = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in rel.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(repr, (tuple(r) for r in got.select(columns).collect()))) == sorted(map(repr, rel.fetchall()))


def brute_top(rows, queries_, k):
    usable = {}
    for i, v in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            usable.setdefault(i, [math.floor(256 * x) for x in v])
    out = set()
    for q in queries_:
        if q in usable:
            scored = sorted((-sum(a * b for a, b in zip(usable[q], v, strict=True)), i) for i, v in usable.items() if i != q)
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])}
    return out


@pytest.mark.parametrize(("n", "dims"), [(0, 3), (1, 3), (4, 2), (300, 5)])
def test_topk(spark, n, dims):
    rng = np.random.default_rng(n)
    rows = [(i, rng.integers(-2, 3, dims).astype(float).tolist()) for i in range(n)]  # few values: ties abound
    if n > 4:
        rows += [(1000, None), (1050, [float("nan")] * dims), (1100, [float("inf")] * dims), (1150, [0.0] * dims), (1200, [None] * dims)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"rank": F.lit(1), "score": F.lit(2)})
    v = df.select("vec_id", topk.quantised(F.col("embedding")).alias("v"))
    for shard_rows, group in ((16384, 8192), (40, 2)):
        got = topk.search(v, topk.query_of(F.col("vec_id")), shard_rows=shard_rows, group_queries=group)
        assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()} == brute_top(rows, [i for i, _ in rows if i % 50 == 0], 5)


def test_scratch_scope(spark):
    from normlens.llm import common

    outer = common.materialise(spark.range(3).toDF("id"), "outer")
    with common.scratch_scope():
        got = mixing.mix(documents(spark, [(1, "a b", "s"), (2, "c", "t")])).count()
        assert got == 2 and len(common._tables) > 1
    assert outer._normlens_path in common._tables and outer.count() == 3
    common.forget(outer)


def test_topk_lengths(spark):
    def run(rows):
        return topk.search(spark.createDataFrame(rows, "vec_id long, v array<long>"), topk.query_of(F.col("vec_id"))).select("query_id", "rank", "vec_id", "score").collect()

    with pytest.raises(ValueError, match="dimensions"):
        run([(0, [1, 2]), (1, [3]), (2, [4]), (50, [1, 1])])
    assert sorted(map(tuple, run([(0, []), (1, []), (50, []), (2, None)]))) == [(0, 1, 1, 0), (0, 2, 50, 0), (50, 1, 0, 0), (50, 2, 1, 0)]


def test_threshold_stops_early():
    rng = np.random.default_rng(1)
    vectors = np.floor(256 * rng.exponential(size=(5000, 3)) ** 3).astype(np.int64)
    shard = topk.Shard(np.arange(5000), vectors)
    best, scores, depth = shard.top(np.array([3, 2, 1]), -1, 5)
    want = np.lexsort((np.arange(5000), -(vectors @ [3, 2, 1])))[:5]
    assert shard.ids[best].tolist() == want.tolist() and depth < 2000


def test_language_model_base_and_weights(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["The", "cat", "sat", "on", "a", f"w{rng.randint(0, 50)}"]) for _ in range(rng.randint(0, 40))), "s") for i in range(300)]
    rows += [(300, None, "s"), (301, "", None), (5, rows[5][1], "s"), (None, "the cat", "s"), (302, "x " * 300_000, "s")]
    got = lm.score(documents(spark, rows)).collect()
    tokens = lambda t: [*WORDS.findall((t or "").encode().lower()), None]
    part = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10
    counts = Counter(w for i, t, _ in rows if part(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((-1 if i is None else i, part(i) == 0, len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n) for i, t, _ in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in got) == want
    texts = {i: t for i, t, _ in rows}
    for r in got:
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(texts[r.doc_id]))
        assert r.base_score == pytest.approx(base) and r.score <= 0
    assert lm.score(documents(spark, rows[:1]).where("doc_id < 0")).count() == 0
    alone = lm.score(documents(spark, [(10**k, "a b", "s") for k in range(6) if part(10**k) == 0] or [(next(i for i in range(99) if part(i) == 0), "a b", "s")])).first()
    assert alone.train_tokens == 0 and alone.n_known == 0 and math.isfinite(alone.score)


def slow_model(rows):
    """Counts by dictionaries, weights by a token-by-token EM, and the score of each text."""
    part = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10
    tokens = lambda t: ["<s>", *WORDS.findall((t or "").encode().lower()), None]

    def counts(which):
        one, two, three = Counter(), Counter(), Counter()
        for i, t, _ in rows:
            if which(part(i)):
                w = tokens(t)
                one.update(w)
                two.update(zip(w, w[1:], strict=False))
                three.update(zip(w, w[1:], w[2:], strict=False))
        starts = one.pop("<s>", 0)
        return one, two, three, starts, sum(one.values()), len(one)

    def estimates(model, w, i):
        one, two, three, starts, n, v = model
        before = starts if i == 1 else one[w[i - 1]]
        context = two[w[i - 2], w[i - 1]] if i > 1 else 0
        base = (one[w[i]] + 0.1) / (n + 0.1 * (v + 1))
        bucket = 40 + math.ceil(math.log2(context + 1)) if context else math.ceil(math.log2(before + 1))
        return bucket, [base, one[w[i]] / n, two[w[i - 1], w[i]] / before if before else 0, three[w[i - 2], w[i - 1], w[i]] / context if context else 0]

    fit, dev = counts(lambda p: p > 1), []
    for i, t, _ in rows:
        if part(i) == 1:
            dev += [estimates(fit, tokens(t), k) for k in range(1, len(tokens(t)))]
    groups = defaultdict(list)
    for bucket, e in dev:
        groups[bucket].append(e)
        groups["two" if bucket >= 40 else "one"].append(e)
    weights = {}
    for bucket, own in groups.items():
        short = bucket == "one" or (bucket != "two" and bucket < 40)
        w = [1 / 3, 1 / 3, 1 / 3, 0] if short else [1 / 4] * 4
        for _ in range(lm.ROUNDS):
            total = [0.0] * 4
            for e in own:
                mixed = sum(a * b for a, b in zip(w, e, strict=True))
                total = [s + a * b / mixed for s, a, b in zip(total, w, e, strict=True)]
            w = [max(s / len(own), lm.LEAST_WEIGHT if k == 0 else 0) for k, s in enumerate(total)]
            w = [a / sum(w) for a in w]
        weights[bucket] = w
    full, scores = counts(lambda p: p > 0), {}
    for (i, t, _), whole in itertools.product(rows, (True, False)):
        w, model = tokens(t), full
        scores[i, whole] = 0.0
        if part(i) and not whole:  # without this document
            one, two, three = (c.copy() for c in full[:3])
            one.subtract(w[1:])
            two.subtract(zip(w, w[1:], strict=False))
            three.subtract(zip(w, w[1:], w[2:], strict=False))
            one = Counter({a: b for a, b in one.items() if b})
            model = (one, two, three, full[3] - 1, sum(one.values()), len(one))
        for k in range(1, len(w)):
            bucket, e = estimates(model, w, k)
            mix = weights.get(bucket, weights["two" if bucket >= 40 else "one"])
            if bucket == 0:
                mix = [mix[0] / (mix[0] + mix[1]), mix[1] / (mix[0] + mix[1]), 0, 0]
            scores[i, whole] += math.log10(sum(a * b for a, b in zip(mix, e, strict=True)))
    return weights, scores


def test_language_model_against_loops(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["the", "cat", "sat", "on", "a", f"w{rng.randint(0, 200)}"]) for _ in range(rng.randint(0, 30))), "s") for i in range(400)]
    rows += [(1000 + i, "A text that comes twice " + " ".join(f"t{i}x{k}" for k in range(12)), "s") for i in range(20) for _ in range(2)] + [(9000, None, "s"), (9001, "a\x1fb a\x1fb", "s")]
    want, scores = slow_model(rows)
    counted, totals = lm.exchange(documents(spark, rows))
    got = lm.learn_weights(counted, totals)
    assert all(np.allclose(got[b], w, atol=1e-6) for b, w in want.items() if isinstance(b, int) and b)
    assert np.allclose(got.sum(axis=1), 1) and (got[:, 0] > 0).all()
    for r in lm.score(documents(spark, rows)).collect():
        assert (r.score, r.score_others) == (pytest.approx(scores[r.doc_id, True], abs=1e-6), pytest.approx(scores[r.doc_id, False], abs=1e-6))


def test_messages_in_a_file_give_the_same_answers():
    """A bucket whose messages do not fit in memory is answered from a file, in any number of folds."""
    rng = np.random.default_rng(2)
    for words in (True, False):
        rows, bits = [], 1
        for chunk in range(40):
            keys = np.unique(rng.integers(0, 300, 60)).astype(np.uint64)
            n, many = len(keys), rng.integers(0, 3, len(keys)).astype("<u4")
            if chunk == 7:
                keys, n, many = keys[:0], 0, many[:0]
            tags = np.concatenate([np.sort(rng.choice(5, k, replace=False)) for k in many] + [np.zeros(0)]).astype("<u4")
            count = lambda k: rng.integers(0, 4, k).astype("<u4")
            parts = [lm.steps(keys), count(n), count(n)] + ([] if words else [many, tags, count(len(tags)), count(len(tags))])
            rows.append({"bucket": 0 if words else 5, "chunk": chunk, "n": n, "n_tri": 0 if words else len(tags), "message": lm.pack(*parts)})
        batch = pa.RecordBatch.from_pylist(rows, schema=pa.schema([(c, pa.int64()) for c in ("bucket", "chunk", "n", "n_tri")] + [("message", pa.binary())]))
        key = lambda batches: sorted((tuple(r.values()) for b in batches for r in b.to_pylist()))
        want = key(lm.answerer(bits)([batch]))
        assert len(want) == 40 and key(lm.answerer(bits, 0)([batch])) == key(lm.answerer(bits, 3_000)([batch])) == want
        names = [c.split()[0] for c in lm.ANSWER_SCHEMA.split(", ")]
        for folded in (1, 500):
            assert sorted(lm.spooled_answers(lm.Spool(rows), words, folded)) == want, names


def test_language_model_from_files(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["the", "cat", "sat", f"w{rng.randint(0, 30)}"]) for _ in range(rng.randint(0, 20))), "s") for i in range(60)]
    key = lambda df: sorted((r.doc_id, r.n_known, round(r.score, 9), round(r.score_others, 9)) for r in df.collect())
    assert key(lm.score(documents(spark, rows), 0)) == key(lm.score(documents(spark, rows)))


def test_mixture_sums_to_one(spark):
    """Over all known words and the one unknown, every context's probabilities sum to 1."""
    rows = [(i, " ".join("abcde"[(i * k) % 5] for k in range(1, 12)), "s") for i in range(60)]
    counted, totals = lm.exchange(documents(spark, rows))
    weights = lm.learn_weights(counted, totals)
    assert totals.types == 6 and np.allclose(weights.sum(axis=1), 1) and (weights >= 0).all() and (weights[:, 0] > 0).all()
    n, v = totals.tokens, totals.types
    words = {}
    contexts = defaultdict(dict)
    for row in counted.collect():
        c = lm.Counted.read(row.asDict(), totals)
        counts = c.counts(True)
        chunk = lm.Chunk.read({**row.asDict(), "vocabulary": None})
        words |= dict(zip(chunk.token.tolist(), counts[0].tolist(), strict=True))
        for k, (token, before) in enumerate(zip(chunk.token.tolist(), chunk.before.tolist(), strict=True)):
            contexts[(chunk.before[k - 1] if counts[3][k] else None, before)][token] = counts[:, k]
    assert len(contexts) > 5 and sum(words.values()) == n
    for (_, last), own in contexts.items():
        some = next(iter(own.values()))
        bucket, _ = lm.estimates(some[:, None], n, v)
        total = weights[bucket[0]][0] * 0.1 / (n + 0.1 * (v + 1))
        for token, count in words.items():
            c = own.get(token, np.array([count, some[1], 0, some[3], 0]))
            if some[3] and token not in own:  # the bigram may still be known
                c[2] = max((o[token][2] for (_, b), o in contexts.items() if b == last and token in o), default=0)
            _, e = lm.estimates(np.array(c, dtype=float)[:, None], n, v)
            total += float(weights[bucket[0]] @ e[:, 0])
        assert total == pytest.approx(1)


def test_packed_arrays():
    arrays = [np.zeros(0, "<u8"), np.array([5, 2**63], "<u8"), np.arange(1000, dtype="<u4")]
    for a in arrays:
        assert (lm.expand(lm.squeeze(a), len(a), a.dtype.str) == a).all()
    assert all((a == b).all() for a, b in zip(lm.unpack(lm.pack(*arrays), *[(len(a), a.dtype.str) for a in arrays]), arrays, strict=True))
    keys = np.sort(np.random.default_rng(1).integers(0, 2**64, 99, dtype=np.uint64))
    assert (np.cumsum(lm.steps(keys), dtype=np.uint64) == keys).all()


def waterfill(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        left = [s for s in names if s not in full]
        if not left:
            return {s: 2.0 * sizes[s] for s in names}
        level = (total - sum(2 * sizes[s] for s in full)) / sum(weight[s] for s in left)
        above = {s for s in left if level * weight[s] > 2 * sizes[s]}
        if not above:
            return {s: 2.0 * sizes[s] if s in full else level * weight[s] for s in names}
        full |= above


def test_mixing(spark):
    rng = random.Random(7)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 400))), rng.choice(["big"] * 6 + ["b", "ä", "", None])) for i in range(600)]
    rows += [(600, None, "none"), (601, "", "none"), (3, rows[3][1], rows[3][2]), (None, "x y", "b"), (602, "z " * 50_000, "b")]
    got = mixing.mix(documents(spark, rows), shard_docs=50).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    targets, taken = waterfill(sizes), defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source])
        taken[r.source] += r.taken
    assert all(abs(taken[s] - t) <= 64 * (3 + len(rows) // 50) for s, t in targets.items())
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    again = mixing.mix(documents(spark, rows).repartition(7), shard_docs=50).collect()
    assert sorted(map(key, again)) == sorted(map(key, got))
    assert mixing.mix(documents(spark, rows).where("doc_id < 0")).count() == 0
    assert {r.taken for r in mixing.mix(documents(spark, [(1, None, None), (2, " ", "a")])).collect()} == {0}


@pytest.mark.parametrize("seats", [0, 1, 2, 5, 17, 1000])
def test_sainte_lague(spark, seats):
    votes = {"a": 53.0, "b": 24.0, "c": 23.0, "d": 0.0, "e": 23.0}
    rows = spark.createDataFrame([(k, v, seats) for k, v in votes.items()], "key string, v double, m long")
    got = {r.key: r.n for r in mixing.sainte_lague(rows, [], "key", "v", "m", "n").collect()}
    quotients = sorted(((-v / (2 * s + 1), k) for k, v in votes.items() for s in range(seats) if v > 0))[:seats]
    assert got == {k: sum(x == k for _, x in quotients) for k in votes}


@pytest.mark.parametrize("words", [10, 30, 140])
def test_mixing_reaches_small_targets(spark, words):
    rows = [(i, "w " * 50, "a") for i in range(900)] + [(1000, "x " * (words // 2), "b"), (1001, "x " * (words - words // 2), "b")]
    got = mixing.mix(documents(spark, rows), shard_docs=100).collect()
    taken, target = sum(r.taken for r in got if r.doc_id >= 1000), {r.target for r in got if r.doc_id >= 1000}.pop()
    assert abs(taken - target) <= max(1, 0.05 * target)
    taken, target = sum(r.taken for r in got if r.doc_id < 1000), {r.target for r in got if r.doc_id < 1000}.pop()
    assert abs(taken - target) <= 0.005 * target


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = WORDS.findall((t or "").encode().lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                up[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_rows():
    rng = random.Random(11)
    word = lambda: f"w{rng.randint(0, 5000)}"
    passage = [word() for _ in range(60)]
    rows = []
    for group in range(12):
        base = [word() for _ in range(rng.randint(60, 200))] + (passage if group % 2 else [])
        for copy in range(rng.choice([1, 2, 3, 40])):
            text = [w if rng.random() > (copy % 7) * 0.006 else word() for w in base]
            rows.append((len(rows), " ".join(text).replace("w1", "W1")))
    n = len(rows)
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "a b"), (n + 4, "A  b\n"), (n + 5, rows[0][1]), (n + 6, rows[0][1] + " "), (n + 7, "b a"), (n + 8, "q " * 100_000)]


@pytest.mark.parametrize("limits", [{}, {"confirm_rows": 3, "slice_rows": 5, "region_rows": 4}, {"confirm_rows": 2, "slice_rows": 2, "region_rows": 2}])
def test_near_duplicates(spark, limits):
    rows = near_rows()
    want = brute_components(rows)
    docs = documents(spark, [(i, t, "s") for i, t in rows] + [(0, rows[0][1], None)])
    got = minhash.near_duplicates(docs, **limits).collect()
    assert len(got) == len(rows) + 1
    wrong = [r.doc_id for r in got if (r.n_shingles, r.component_id) != want[r.doc_id]]
    assert wrong == []
    assert all(r.kept == (r.doc_id == r.component_id) and r.component_id >= want[r.doc_id][1] for r in got)


@pytest.mark.parametrize("limits", [{"confirm_rows": 3, "slice_rows": 4, "region_rows": 4}])
def test_large_groups_lose_no_link(spark, limits):
    """Chains, in which each document has links to its neighbours only, and groups of copies: not one row differs."""
    rng = random.Random(12)
    rows = near_rows()[:-9]
    for _ in range(3):
        words = [f"c{rng.randint(0, 10**6)}" for _ in range(1000)]
        rows += [(len(rows) + k, " ".join(words[12 * k : 12 * k + 120])) for k in range(60)]
    want = brute_components(rows)
    got = minhash.near_duplicates(documents(spark, [(i, t, "s") for i, t in rows]), **limits).collect()
    assert len(got) == len(rows)
    assert [r.doc_id for r in got if (r.n_shingles, r.component_id, r.kept) != (*want[r.doc_id], want[r.doc_id][1] == r.doc_id)] == []


def test_near_duplicates_of_nothing(spark):
    assert minhash.near_duplicates(documents(spark, [(1, "a", "s")]).where("doc_id < 0")).count() == 0
    got = minhash.near_duplicates(documents(spark, [(None, "a b c d e f", "s"), (4, "a b c d e f", "s"), (None, None, "s")])).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == [("4", "4", True), ("None", "4", False), ("None", "None", False)]


def test_components_of_chains(spark):
    rng = random.Random(2)
    chain = list(range(200))
    rng.shuffle(chain)
    links = list(zip(chain, chain[1:], strict=False)) + [(500, 600), (600, 700), (700, 500), (900, 901)] + [(2000, 2000 + i) for i in range(1, 300)]
    rng.shuffle(links)
    got = {r.node: r.root for r in minhash.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(200)}, **{i: 500 for i in (500, 600, 700)}, 900: 900, 901: 900, **{2000 + i: 2000 for i in range(300)}}


def test_threshold_is_exact():
    a = np.arange(0, 7, dtype=np.uint64)
    assert minhash.linked(a, np.arange(1, 8, dtype=np.uint64)) and not minhash.linked(a, np.arange(2, 9, dtype=np.uint64))  # 6/8 and 5/9


def test_near_duplicates_go_by_row(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(40)) for c in "xyz")
    rows = [(1, one), (2, one + " more"), (2, two), (2, two), (3, None), (None, three), (None, three + " end"), (None, one), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], DOCS)
    left = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, DIR).collect()]
    third = [x for x in left if x[1] in (three, three + " end")]
    assert len(third) == 1 and sorted(map(repr, left)) == sorted(map(repr, [(1, one), (2, two), (3, None), (None, None), *third]))


def test_stages_with_nulls_and_repeated_ids(spark):
    """Every stage, on rows with null and repeated ids, null and empty texts, and extra columns of clashing names."""
    good = [r.asDict() for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in good]
    rows += [(None, rows[3][1] + " and more", "en", None, None), (5, rows[8][1] + " once more", None, "web", None), (5, None, None, None, None), (None, "", None, None, 0), (7, rows[7][1], rows[7][2], rows[7][3], None)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("row", "copies", "gone", "mixed", "score", "first", "quality")})
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, DIR)
        assert "row" not in got.columns and got.count() > 0, name
    mixed = Counter((r.doc_id, r.text) for r in corpus_pipeline.mix_sources(spark, spark.createDataFrame([(1, "a b", "x", "s", 1), (1, "c d", "x", "t", 1), (None, "e f", "x", None, 1), (2, None, "x", "s", 1)], DOCS), DIR).collect())
    assert set(mixed) <= {(1, "a b"), (1, "c d"), (None, "e f")} and 3 <= sum(mixed.values()) <= 6 and max(mixed.values()) <= 2


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "language id", "minhash near-dedup", "mixing sources", "packing"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    stages = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, minhash.materialise(stage(spark, docs, DIR), "test-stage")
        stages[name] = (before, docs)
        if name != "packing":
            assert docs.columns == before.columns
    before, kept = ({r.doc_id for r in df.collect()} for df in stages["quality classifier"])
    assert all(labels.get(i) == 0 or i not in labels for i in before - kept) and kept < before
    before, after = ([(r.doc_id, r.text) for r in df.collect()] for df in stages["minhash near-dedup"])
    comp = brute_components(before)
    assert sorted(i for i, _ in after) == sorted(i for i, (_, c) in comp.items() if i == c)
    before, after = stages["mixing sources"]
    texts = {r.doc_id: r.text for r in before.collect()}
    times = Counter(r.doc_id for r in after.collect())
    assert set(times) <= set(texts) and max(times.values()) <= 2 and all(r.text == texts[r.doc_id] for r in after.collect())
    assert corpus_pipeline.run(spark, DIR).count() == docs.count()
    empty = stages["quality classifier"][0].where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, DIR)
    assert empty.count() == 0
