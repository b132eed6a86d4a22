"""Filter audit, whitening and decontamination against brute force."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from normlens.llm import decontaminate, filter_audit, queries, topk, whitening

DOCS = "doc_id long, text string, source string"
CLASHES = ("n", "mask", "part", "digest", "quality", "toxic", "good", "key", "at", "w", "items", "length", "place", "words", "copies", "step", "first")


def clashing(df, *more):
    """``df`` with further columns whose names operators use themselves."""
    return df.withColumns({c: F.lit(1) for c in (*CLASHES, *more) if c not in df.columns})


SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def fails_of(rows):
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, t, s in rows:
        t = t or ""
        w = SPACED.findall(t)
        a, b = len(w) < 200, 100 * len(set(w)) < 50 * len(w)
        c, d = 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search(r"[#$%&*|]", t))
        yield i, s or "", [a, b, c, d, i is not None and i > least[t]]


def brute_audit(rows, labels):
    """Every order and step by walking through the documents."""
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    docs, out = list(fails_of(rows)), {}
    for order in map("".join, itertools.permutations("ABCDE")):
        for part in {p for _, p, _ in docs}:
            left = [(i, f) for i, p, f in docs if p == part]
            everything = left
            for step, letter in enumerate(order, 1):
                k = "ABCDE".index(letter)
                gone = [(i, f) for i, f in left if f[k]]
                left = [(i, f) for i, f in left if not f[k]]
                failing = [f for _, f in everything if f[k]]
                out[part, order, step] = [len(left), len(gone), len(failing) - len(gone), sum(sum(f) == 1 for f in failing), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
    shapley = {}
    for (part, order, step), x in out.items():
        shapley[part, order[step - 1]] = shapley.get((part, order[step - 1]), 0) + x[1]
    return {(p, o, s): (*x, shapley[p, o[s - 1]]) for (p, o, s), x in out.items()}


def audit_rows():
    rng = random.Random(3)
    rows = []
    for i in range(150):
        n = rng.choice([0, 3, 199, 200, 260])
        pool = rng.choice([["same"], [f"w{k}" for k in range(400)], ["Caps", "LOUD", "é"]])
        text = rng.choice([" ", "\t", "\x1f ", "  "]).join(rng.choice(pool) for _ in range(n)) + rng.choice(["", "", " # ", " 100%"])
        rows.append((i, rng.choice([text, text, None, "", "a common text " * 80]), rng.choice(["a", "b", None, ""])))
    rows += rows[:10] + [(3, "another text", "a"), (None, "a common text " * 80, "a"), (None, None, "b"), (None, None, "b"), (-5, "a common text " * 80, "b"), (900, "Ab " * 200_000, "b")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 200, 2)] + [(None, 1, 1), (4, 1, 1), (4, 0, 0)]
    return rows, labels


def test_filter_audit(spark):
    rows, labels = audit_rows()
    docs = clashing(spark.createDataFrame(rows, DOCS))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumns({"source": F.lit("x"), "n": F.lit(1), "text": F.lit("t")})
    got = filter_audit.audit(docs, marks).collect()
    assert {tuple(r[:3]): tuple(r[3:]) for r in got} == brute_audit(rows, labels) and len(got) == 600 * 3
    assert filter_audit.audit(docs.where("false"), marks).count() == 0
    bare = filter_audit.audit(docs, marks.where("false")).agg(F.sum("good_lost"), F.sum("toxic_lost"), F.sum("removed")).first()
    assert bare[0] == bare[1] == 0 and bare[2] > 0


def test_parity_sums_give_back_the_cells(spark):
    rng = random.Random(4)
    counts = {(p, m, g): rng.randint(0, 10**12) for p in "xy" for m in range(32) for g in (True, False)}
    df = spark.createDataFrame([(p, m, g, not g, n) for (p, m, g), n in counts.items()], "part string, mask int, good boolean, toxic boolean, n long")
    sums = filter_audit.parity_sums(df)
    for r in sums.select("part", *[filter_audit.cells(F.col(c)).alias(c) for c in ("all", "good")]).collect():
        assert r["all"] == [counts[r.part, m, True] + counts[r.part, m, False] for m in range(32)]
        assert r.good == [counts[r.part, m, True] for m in range(32)]
    assert sums.where("part = 'x'").first()["all"][5] == sum((-1) ** bin(m & 5).count("1") * n for (p, m, _), n in counts.items() if p == "x")


def brute_whitening(rows):
    x = {i: [int(np.floor(256 * np.float64(c))) for c in v] for i, v in enumerate(v for _, v in rows) if v is not None and all(c is not None and np.isfinite(c) for c in v)}
    fit = np.array(sorted(set(map(tuple, x.values()))), dtype=float)
    n, s = len(fit), [sum(map(int, c)) for c in fit.T]
    centred = fit - np.array(s) / n
    e, axes = np.linalg.eigh(centred.T @ centred / n)
    return x, n, s, e[::-1], axes[:, ::-1]


@pytest.mark.parametrize(("count", "dims"), [(400, 6), (50, 5), (30, 2), (20, 1)])
def test_whitening(spark, count, dims):
    rng = np.random.default_rng(dims)
    spread = rng.normal(size=(dims, dims))
    rows = [(i % 37 if i % 5 else None, (rng.normal(size=dims) @ spread).astype(np.float32).tolist()) for i in range(count)]
    rows += rows[:9] * 3 + [(1, None), (2, [float("nan")] * dims), (3, [float("inf")] * dims), (4, [None] * dims), (5, [-0.001] * dims)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("vec_id", whitening.integer_vector(F.col("embedding")).alias("x"), F.lit(1).alias("n"), F.lit(2).alias("fold"), F.lit(3).alias("y"))
    got = whitening.whiten(df).collect()
    x, n, s, e, axes = brute_whitening(rows)
    k = min(4, dims)
    assert len(got) == len(x) * k and {r.n for r in got} == {n}
    want = {}
    for i, v in x.items():
        deviation = sum((n * a - b) ** 2 for a, b in zip(v, s, strict=True))
        for c in range(k):
            w = (np.array(v) - np.array(s) / n) @ axes[:, c] / np.sqrt(e[c])
            want.setdefault((rows[i][0] is None, rows[i][0], c + 1, deviation), []).append(w)
    signs = {}
    for r in got:
        near = want[r.vec_id is None, r.vec_id, r.component, r.deviation]
        if abs(r.whitened) > 0.2:
            signs.setdefault(r.component, set()).add(min((-1, 1), key=lambda g: min(abs(g * r.whitened - w) for w in near)))
        assert min(abs(abs(r.whitened) - abs(w)) for w in near) < 1e-8
        assert r.explained == pytest.approx(e[r.component - 1] / e.sum(), rel=1e-9) and r.identity_error < 1e-10
    assert all(len(v) == 1 for v in signs.values())


def test_whitening_without_variance(spark):
    def run(rows, kind="array<long>"):
        return whitening.whiten(spark.createDataFrame(rows, f"vec_id long, x {kind}")).orderBy("vec_id", "component").collect()

    assert run([]) == [] and run([(1, None)]) == [] and run([(1, [])]) == []
    assert [tuple(r) for r in run([(1, [5, 7]), (2, [5, 7])])] == [(i, c, 1, 0, None, None, None) for i in (1, 2) for c in (1, 2)]
    line = run([(i, [i, 2 * i, 0]) for i in range(5)])
    assert [r.explained for r in line[:3]] == [pytest.approx(1), 0, 0] and all((r.whitened is None) == (r.component > 1) for r in line)
    assert line[0].identity_error < 1e-10
    far = run([(1, [2**40, 0]), (2, [-(2**40), 1])])
    assert far[0].deviation is None and far[0].whitened == pytest.approx(-far[2].whitened)
    assert [r.deviation for r in run([(1, [2**30 + 3]), (2, [3])])] == [2**60, 2**60]
    with pytest.raises(ValueError, match="dimensions"):
        run([(1, [1, 2]), (2, [3])])


@pytest.mark.parametrize("dims", [1, 2, 3, 7, 8])
def test_every_pair_of_dimensions_is_summed_once(spark, dims):
    rng = np.random.default_rng(dims)
    x = rng.integers(-300, 300, (60, dims))
    got = whitening.covariance(spark.createDataFrame([(r.tolist(),) for r in x], "x array<long>"), x.sum(axis=0).tolist(), len(x))
    assert np.allclose(got, np.cov(x.T, bias=True).reshape(dims, dims), atol=1e-9)
    assert len(whitening.pair_expressions(dims)) == dims + 1


def test_whitening_query(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got = queries.op12_whitening(spark, folder)
    x, n, s, e, axes = brute_whitening(rows)
    table = {(r.vec_id, r.component): r for r in got.collect()}
    assert len(table) == len(rows) * 4 and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    w = np.array([[table[i, c + 1].whitened for c in range(4)] for i, _ in rows])
    want = (np.array(list(x.values())) - np.array(s) / n) @ axes[:, :4] / np.sqrt(e[:4])
    assert np.allclose(np.abs(w), np.abs(want), atol=1e-7) and np.allclose(np.abs(np.sign(w) @ np.eye(4)), 1)
    assert [table[i, 1].deviation for i, _ in rows] == [sum((n * a - b) ** 2 for a, b in zip(v, s, strict=True)) for v in x.values()]


ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(decontaminate.CAPITALS, decontaminate.SMALL)


def brute_decontaminate(docs, items):
    words = lambda t: ITEM_WORD.findall((t or "").translate(LOWER))
    windows = {}
    for i, t in items:
        w = words(t)
        m = min(10, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            windows.setdefault(tuple(w[k : k + m]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for m in {len(x) for x in windows}:
            for k in range(len(w) - m + 1):
                own = windows.get(tuple(w[k : k + m]))
                if own is not None:
                    hit |= set(range(k, k + m))
                    found |= own
        ids = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def contaminated():
    rng = random.Random(8)
    pool = ["the", "of", "a", "Ünder", "ÉTÉ", "İstanbul", "Kelvin", "ΑΣ", "σς", "x1", "2024", "日本", *[f"w{k}" for k in range(40)]]
    text = lambda n: "".join(rng.choice(pool) + rng.choice([" ", ", ", "\n", "-", "\x00", " "]) for _ in range(n))
    items = [(i, text(rng.choice([9, 10, 11, 14, 30]))) for i in range(30)]
    items += [(50, "one, Two"), (51, "the of a"), (52, "THE"), (53, None), (54, "!?"), (55, ""), (56, items[3][1]), (3, "Some more words of an id that comes twice in all this"), (None, "nobody knows the id of this one at all my friend")]
    items += [(100 + k, "a template that all of these items begin with and then number " + str(k)) for k in range(20)]
    docs = []
    for i in range(120):
        pieces = [text(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            w = (rng.choice(items)[1] or "").split(" ")
            at = rng.randint(0, max(0, len(w) - 10))
            pieces += [" ".join(w[at : at + rng.randint(8, 14)]).upper() if rng.random() < 0.3 else " ".join(w[at:]), text(rng.randint(0, 5))]
        docs.append((i, " ".join(pieces)))
    docs += docs[:5] + [(7, "another text of id seven"), (None, items[0][1]), (None, items[0][1]), (None, None), (500, None), (501, ""), (502, "%%"), (503, "the " * 30_000 + items[12][1] * 50), (504, "one"), (505, "ONE two"), (506, "nobody knows the id of this one at all my friend")]
    return docs, items


@pytest.mark.parametrize("rows", [500_000, 40])
def test_decontamination(spark, rows):
    docs, items = contaminated()
    d = clashing(spark.createDataFrame(docs, "doc_id long, text string"), "item_id", "prefix", "span")
    b = clashing(spark.createDataFrame(items, "item_id long, text string"), "doc_id")
    got = [tuple(r) for r in decontaminate.decontaminate(d, b, broadcast_rows=rows).collect()]
    assert sorted(got, key=repr) == brute_decontaminate(docs, items)
    assert sum(r[-1] for r in got) > 40


@pytest.mark.parametrize("kept", ["true", "item_id < 30", "item_id = 52", "item_id = 55", "false"])
def test_decontamination_of_some_items(spark, kept):
    docs, items = contaminated()
    b = spark.createDataFrame(items, "item_id long, text string").where(kept)
    d = spark.createDataFrame(docs[-40:], "doc_id long, text string")
    got = [tuple(r) for r in decontaminate.decontaminate(d, b).collect()]
    assert sorted(got, key=repr) == brute_decontaminate(docs[-40:], [tuple(r) for r in b.collect()])
    assert decontaminate.decontaminate(d.where("false"), b).count() == 0


def test_decontamination_moves_no_text(spark):
    """Documents meet the benchmark by broadcast; what is exchanged has neither texts nor their words."""
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    plan = decontaminate.decontaminate(docs, items)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "CartesianProduct" not in plan and "Python" not in plan
    exchanges = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*?)\]\n", plan)
    assert exchanges and all(not re.search(r"\b(text|w|words)#", e) for e in exchanges)


def test_quantised_vectors_are_those_of_the_search():
    assert whitening.quantised is topk.quantised
