import json
import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from normlens.operators import files, hamming, nearest
from normlens.sources import catalog, pixels, tables
from normlens.streaming import scorer

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def netpbm(a):
    return f"P6\n{a.shape[1]} {a.shape[0]}\n255\n".encode() + a.astype(np.uint8).tobytes()


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("data")
    rng = np.random.default_rng(0)
    for i, where in enumerate(["cable/train/good/1.png", "cable/train/good/2.png", "cable/test/cut/3.PNG", "cable/ground_truth/cut/3_mask.png", "nut/test/good/4.jpg"]):
        path = root / where
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(netpbm(rng.integers(0, 255, (40 + i, 30, 3))) if i != 1 else b"P6 broken")
    (root / "cable/notes.txt").write_text("x")
    return str(root)


def test_catalog(spark, tree):
    rows = catalog.read_images(spark, tree)
    got = sorted((r.path, r.product, r.split, r.defect_type) for r in rows.drop("content").collect())
    assert got[0] == ("cable/ground_truth/cut/3_mask.png", "cable", "ground_truth", "cut") and len(got) == 5
    assert catalog.product_images(rows).count() == 4
    assert catalog.read_images(spark, tree, "*.png", content=False).count() == 3
    assert {r.stem: r.mask_path for r in catalog.masks(rows).collect()} == {"3": "cable/ground_truth/cut/3_mask.png"}
    assert {r.path: r.label for r in catalog.labelled(rows).collect()}["cable/test/cut/3.PNG"] == 1
    assert catalog.inventory(rows).where("product IS NULL").first().n == 5
    assert rows.select(files.sha256_hex(F.col("content"))).distinct().count() == 5


def test_pixels(spark, tree):
    rows = catalog.read_images(spark, tree)
    found = {r.path: (r.width, r.height, r.corrupt) for r in pixels.attributes(rows).collect()}
    assert found["cable/train/good/1.png"] == (30, 40, False) and found["cable/train/good/2.png"] == (None, None, True)
    prints = pixels.fingerprints(rows)
    assert prints.count() == 4
    assert hamming.theta_join(prints, prints, 0).where("left_id = right_id").count() == 4
    found = pixels.extract_patches(rows, pixels.cell_statistics, batch=2)
    assert {(r.path, r.error) for r in found.where("error IS NOT NULL").collect()} == {("cable/train/good/2.png", "undecodable")}
    patches = found.where("error IS NULL")
    one = patches.where("path = 'cable/train/good/1.png'").count()
    assert one == 32 * 24
    queries = patches.where("path = 'cable/train/good/1.png'").select(F.col("patch").cast("long").alias("id"), "v")
    assert nearest.nearest(queries, queries).count() == one


def test_resized_against_loops():
    """Each target pixel as the weighed mean of its source pixels, rows first, whole bytes after each pass."""
    rng = np.random.default_rng(3)
    for (h, w), (th, tw) in (((9, 13), (4, 5)), ((5, 4), (12, 9)), ((8, 8), (8, 3)), ((1, 50), (7, 7))):
        a = rng.integers(0, 256, (h, w)).astype(np.uint8)

        def one(line, size):
            n, out = len(line), []
            wide = max(1.0, n / size)
            for i in range(size):
                centre = (i + 0.5) * n / size
                pairs = [(max(0.0, 1 - abs((j + 0.5 - centre) / wide)), float(line[j])) for j in range(n) if int(centre - wide + 0.5) <= j < int(centre + wide + 0.5)]
                out.append(np.floor(sum(p * v for p, v in pairs) / sum(p for p, _ in pairs) + 0.5))
            return out

        rows = np.array([one(r, tw) for r in a]) if tw != w else a.astype(float)
        want = np.array([one(c, th) for c in rows.T]).T if th != h else rows
        assert np.abs(pixels.resized(a, th, tw).astype(int) - want).max() <= 1
    flat = np.full((10, 30, 3), 7, dtype=np.uint8)
    box = pixels.letterboxed_bytes(flat)
    assert (box[128] == 7).all() and (box[0] == [124, 116, 104]).all() and pixels.centre_cropped(flat).shape == (224, 224, 3)
    assert pixels.centre_cropped(np.full((300, 300), 255, dtype=np.uint8), mask=True).min() == 1


def test_masks(spark, tree):
    rows = catalog.read_images(spark, tree)
    manifest = spark.createDataFrame([("a", 1, "cable/ground_truth/cut/3_mask.png"), ("b", 1, "none.png"), ("c", 0, "")], "image_path string, label int, mask_path string")
    got = {r.image_path: (r.width, r.height, r.mask) for r in pixels.load_masks(manifest, rows).collect()}
    assert got["a"][:2] == (30, 43) and len(got["a"][2]) == 30 * 43 and set(got["a"][2]) <= {0, 1} and got["b"] == (None, None, None) and len(got) == 2
    assert [r.image_path for r in pixels.load_masks(manifest, rows, "skip").collect()] == ["a"]
    with pytest.raises(Exception, match="no mask for b"):
        pixels.load_masks(manifest, rows, "raise").collect()
    assert catalog.product_images(spark.createDataFrame([("p/test/x/ground_truth/1.png",), ("p/test/good/1.png",)], "path string")).count() == 1
    assert [r.path for r in catalog.listed(rows).collect()] == sorted(r.path for r in rows.collect())


def test_descriptors_against_plain_sums(spark):
    """Each image's statistics as loops would take them, and what grey images need: one channel resized for all three."""
    rng = np.random.default_rng(6)
    grey = np.repeat(rng.integers(0, 255, (70, 32, 1), dtype=np.uint8), 3, axis=2)
    image = pixels.letterboxed(grey)
    assert np.abs(pixels.normalised(grey) - (grey / 255 - pixels.MEAN) / pixels.DEVIATION).max() == 0
    got = pixels.cell_statistics(image[None], 4)[0]
    cell = image[64:128, 128:192]
    steps = np.abs(np.diff(image, axis=1, append=image[:, -1:]))[64:128, 128:192], np.abs(np.diff(image, axis=0, append=image[-1:]))[64:128, 128:192]
    want = np.concatenate([cell.mean(axis=(0, 1)), cell.std(axis=(0, 1)), *(x.mean(axis=(0, 1)) for x in steps)])
    assert np.abs(got[1, 2] - want).max() < 1e-12
    sized = []
    whole = pixels.resample_weights
    pixels.resample_weights = lambda *a: sized.append(a) or whole(*a)
    try:
        pixels.resized(grey, 100, 50)
        assert len(sized) == 2  # six for three channels
    finally:
        pixels.resample_weights = whole


def test_descriptors_from_whole_bytes():
    """The statistics of bytes are those of the letterboxed floats: grey and coloured, wide, tall, shrunk and as large as the box."""
    rng = np.random.default_rng(8)
    sizes = ((100, 32), (32, 100), (3, 32), (256, 256), (255, 256), (254, 254), (300, 500), (1, 1), (513, 40))
    images = [rng.integers(0, 256, (*size, 3), dtype=np.uint8) for size in sizes]
    images += [np.broadcast_to(x[:, :, :1], x.shape) for x in images] + [np.repeat(images[0][:, :, :1], 3, axis=2), np.full((90, 60, 3), 9, dtype=np.uint8)]
    for grid in (1, 4, 32):
        want = pixels.cell_statistics(np.stack([pixels.letterboxed(x) for x in images]), grid)
        assert np.abs(pixels.CellStatistics(grid).of_images(images) - want).max() < 1e-12
    for x in images:
        box = pixels.letterboxed_mask(np.full(x.shape[:2], 255, dtype=np.uint8))
        assert (pixels.valid_share(*x.shape[:2], 4) == box.reshape(4, 64, 4, 64).mean(axis=(1, 3))).all()


def test_only_images_with_a_valid_cell_are_described(spark):
    rng = np.random.default_rng(9)
    shapes = [(64, 64, 3), (1, 64, 3), (70, 32, 3), (400, 32, 3)] * 5
    rows = [(i, netpbm(rng.integers(0, 255, shape)) if i != 8 else b"P6 broken") for i, shape in enumerate(shapes)]
    images = spark.createDataFrame(rows, "path long, content binary").coalesce(1)

    def counted(batch):
        return np.full((len(batch), 4, 4, 1), float(len(batch)))

    found = pixels.extract_patches(images, counted, 4, batch=3).collect()
    assert {r.v[0] for r in found if r.error is None} == {3.0}  # nine described ones, in threes
    assert {r.path: r.error for r in found if r.error} == {i: "undecodable" if i == 8 else "failed: no valid patch" for i in range(20) if i % 2 or i == 8}
    by = [{(r.path, r.patch): r.v for r in pixels.extract_patches(images, f, 4, batch=3).collect() if r.error is None} for f in (pixels.CellStatistics(4), lambda x: pixels.cell_statistics(x, 4))]
    assert by[0].keys() == by[1].keys() and all(np.abs(np.subtract(v, by[1][k])).max() < 1e-12 for k, v in by[0].items())


def test_mask_contents_are_not_broadcast(spark):
    """Spark guesses a computed column at 100 bytes a row; a plan that broadcasts 40 KB a row ends a driver of 1.5 GB at 120,000 rows."""
    ids = spark.range(30)
    head = F.lit("P5\n200 200\n255\n").cast("binary")
    rows = ids.where("id <> 7").select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("path"), F.when(F.col("id") == 8, F.lit("P5").cast("binary")).otherwise(F.concat(head, F.unhex(F.repeat(F.lit("FF00"), 20_000)))).alias("content"))
    manifest = ids.select(F.col("id").cast("string").alias("image_path"), F.lit(1).alias("label"), F.concat(F.lit("m"), F.col("id").cast("string")).alias("mask_path"))
    masks, areas = pixels.load_masks(manifest, rows), pixels.file_areas(manifest, rows)
    for made in (masks, areas):
        assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()
    key = lambda df: sorted(map(tuple, df.collect()))
    whole = lambda df: key(df.where("original_pixels IS NOT NULL"))
    assert whole(areas) == whole(pixels.mask_areas(masks)) and len(whole(areas)) == 28 and areas.count() == 30
    assert {r.image_path for r in areas.where("original_pixels IS NULL").collect()} == {"7", "8"}


def test_predict(spark):
    image = netpbm(np.random.default_rng(1).integers(0, 255, (64, 64, 3)))
    rows = [(1, "image/png", image), (2, "text/plain", image), (3, None, image), (4, "image/png", b""), (5, "image/png", None), (6, "image/png", b"P6 broken"), (7, "image/png", netpbm(np.zeros((1, 64, 3))))]
    requests = spark.createDataFrame(rows, "request_id long, content_type string, content binary")
    patches = pixels.extract_patches(requests.where("request_id = 1"), pixels.cell_statistics, key="request_id")
    bank = patches.select(F.col("patch").cast("long").alias("id"), F.transform("v", lambda x: x / F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, y: s + y * y))).alias("v"))
    got = {r.request_id: (r.status, r.detail, r.prediction) for r in scorer.predict(requests, bank, 0.5, pixels.cell_statistics).collect()}
    assert got[1] == (200, "", "good") and {got[i][:2] for i in (2, 3)} == {(400, "not an image")} and {got[i][:2] for i in (4, 5)} == {(400, "empty")}
    assert got[6][:2] == (400, "undecodable") and got[7][:2] == (500, "failed: no valid patch")
    broken = scorer.predict(requests.where("request_id = 1"), bank, 0.5, lambda batch: batch / "x").collect()
    assert [r.status for r in broken] == [500]
    assert {r.status for r in scorer.predict(requests, bank, 0.5, pixels.cell_statistics, ready=False).collect()} == {503}


def test_predict_describes_from_bytes(spark, monkeypatch):
    """Uploads answered from whole bytes as from floats, also by a bank that is searched by cells; one without a valid patch is not described."""
    rng = np.random.default_rng(14)
    rows = [(i, "image/png", netpbm(rng.integers(0, 1 + i * 6, (20 + 5 * i, 32, 3)))) for i in range(40)]
    requests = spark.createDataFrame(rows, "request_id long, content_type string, content binary")
    some = pixels.extract_patches(requests.where("request_id % 2 = 0"), pixels.CellStatistics(4), 4, key="request_id").where("error IS NULL")
    bank = some.select((F.col("request_id") * 16 + F.col("patch")).alias("id"), F.transform("v", lambda x: x / F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, y: s + y * y))).alias("v"))
    key = lambda features: sorted((r.request_id, r.status, r.detail, r.prediction, round(r.anomaly_score or 0, 4)) for r in scorer.predict(requests, bank, 0.2, features, 4).collect())
    want = key(lambda x: pixels.cell_statistics(x, 4))
    assert key(pixels.CellStatistics(4)) == want and {s for _, s, *_ in want} == {200, 500}
    monkeypatch.setattr(nearest.nearest, "__defaults__", (0, ()))
    assert key(pixels.CellStatistics(4)) == want
    failed = {r.request_id: r.detail for r in scorer.predict(requests.where("request_id > 20"), bank, 0.2, lambda batch: batch / "x", 4).collect()}
    assert failed[39] == "failed: no valid patch" and failed[21] != failed[39]


BROKEN = [b"P5", b"P5 abc def 255\n", b"P5 2 2", b"P5 2 2 255", b"P5 2 2 255 \x01", b"P5 0 2 255 ", b"P5 2 2 0 abcd", b"P5 2 2 99999 abcd", b"P6 2 2 255 abcd", b"P5 -1 2 255 abcd", b"P5 999999999 999999999 255 a", b"P5\xff\xff"]


@pytest.mark.parametrize("content", [None, b"", *BROKEN])
def test_broken_images_are_rows(content):
    assert pixels.decode(content) is None


def test_netpbm_headers():
    plain = np.arange(6, dtype=np.uint8).reshape(2, 3)
    raw = plain.tobytes()
    for head in (b"P5 3 2 255\n", b"P5\n# a comment\n3 2\n# 9 9\n255\n", b"P5\t3\r\n2 255 ", b"P5 3 2 255#x\n"):
        assert (pixels.decode(head + raw + b"more", "L") == plain).all(), head
    assert (pixels.decode(b"P5 3 2 5\n" + raw, "L") == plain * 51).all()
    wide = (np.arange(6) * 13107).astype(">u2").tobytes()
    assert (pixels.decode(b"P5 3 2 65535\n" + wide, "L") == plain * 51).all()
    assert pixels.decode(b"P6 1 2 255\n" + raw).shape == (2, 1, 3)


def test_broken_files_do_not_end_jobs(spark):
    images = spark.createDataFrame([(f"f{i}", c) for i, c in enumerate([None, b"", *BROKEN, netpbm(np.ones((8, 8, 3)))])], "path string, content binary")
    assert [r.corrupt for r in pixels.attributes(images).orderBy("path").collect()].count(False) == 1
    assert pixels.fingerprints(images).count() == 1


def uploads(first, at, image, kind="image/png"):
    from datetime import datetime

    return [(i, datetime(2024, 1, 1, *at), kind, image) for i in first]


def test_stream_of_uploads(spark, tmp_path):
    """Replayed uploads: repeats are answered once, late ones not at all, and a new bank holds from the next batch on."""
    rng = np.random.default_rng(3)
    image, other = (netpbm(rng.integers(0, 255, (64, 64, 3))) for _ in range(2))
    schema = "request_id long, sent timestamp, content_type string, content binary"

    def bank(content):
        rows = spark.createDataFrame([("x", content)], "path string, content binary")
        patches = pixels.extract_patches(rows, pixels.cell_statistics)
        return patches.select(F.col("patch").cast("long").alias("id"), F.transform("v", lambda x: x / F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, y: s + y * y))).alias("v"))

    models = [scorer.Model("one", bank(image), 1e-5), scorer.Model("two", bank(other), 1e-5), scorer.Model("three", bank(other), 1e-5, ready=False)]
    batches = [
        uploads([1, 2, 1], (10, 0), image) + uploads([3], (10, 1), b"P5 abc def 255\n") + uploads([4], (10, 1), image, "text/plain"),
        uploads([2, 5], (10, 5), image) + uploads([6], (11, 0), other),
        uploads([7], (10, 1), image) + uploads([6], (11, 1), image) + uploads([8], (11, 2), image),
    ]
    folder = tmp_path / "in"
    for number, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        stream = spark.readStream.schema(schema).parquet(str(folder))
        scorer.predict_stream(stream, lambda now=models[number]: now, pixels.cell_statistics, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = sorted((r.request_id, r.status, r.prediction, r.version) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    status = {i: (s, p) for i, s, p, _ in got}
    assert sorted(status) == [1, 2, 3, 4, 5, 6, 8] and len(got) == 7
    assert status[1] == status[2] == (200, "good") and status[3] == (400, None) and status[4] == (400, None)
    assert status[5] == (200, "defect") and status[6] == (200, "good") and status[8] == (503, None)
    assert {v for i, _, _, v in got if i < 5} == {"one"} and {v for i, _, _, v in got if i in (5, 6)} == {"two"}


def test_predictions_have_two_values(spark):
    def run(*row):
        return scorer.checked(spark.createDataFrame([row], "status int, prediction string")).collect()

    assert run(200, "good") and run(200, "defect") and run(400, None)
    for bad in ((200, "bad"), (200, None), (400, "good"), (200, "GOOD")):
        with pytest.raises(Exception, match="no such prediction"):
            run(*bad)


def test_stored_by_key_needs_no_exchange(spark, tmp_path):
    from normlens.scratch import Scratch

    rows = spark.range(500).select("id", (F.col("id") % 37).alias("image_id"), F.rand(1).alias("distance"))
    with Scratch(spark) as scratch:
        scored = scratch.by_key(rows, "scored", "image_id", 4)
        known = scratch.by_key(rows.groupBy("image_id").agg(F.min("id").alias("id")), "known", "image_id", 4)
        names = list(scratch.names)
        best = scored.groupBy("image_id").agg(F.max("distance").alias("score"))
        joined = known.join(best.hint("merge"), "image_id").join(scored.select("image_id", F.col("id").alias("patch")).hint("merge"), "image_id")
        assert joined.count() == 500 and best.count() == 37
        for df in (best, joined):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan, plan
        assert tables.save_by_key(rows, names[0], "image_id", 2).count() == 500
    assert not any(spark.catalog.tableExists(n) for n in names)


def test_perceptual_hash_sees_structure():
    a = np.random.default_rng(2).uniform(0, 100, (64, 48))
    assert pixels.perceptual_hash(a) == pixels.perceptual_hash(a * 2 + 8)
    assert bin(pixels.perceptual_hash(a) ^ pixels.perceptual_hash(a[::-1])).count("1") > 4


def test_tables(spark, tmp_path):
    rows = spark.createDataFrame([("a.png", 0, "good", None, "h", "train"), ("b.png", 1, "cut", "m.png", "i", "test")], tables.MANIFEST)
    tables.write_csv(rows, f"{tmp_path}/m")
    got = tables.read_manifest(spark, f"{tmp_path}/m", "/root", limit=1).collect()
    assert [tuple(r) for r in got] == [("/root/a.png", 0, "good", "h")]
    audit = spark.createDataFrame([("cut", "1", 1, 1, 1, 0, 0.1234567, 0.8765433, " Yes "), ("cut", "2", 1, 1, 1, 1, 1.0, 0.0, "False")], tables.CROP_AUDIT)
    tables.write_csv(audit, f"{tmp_path}/a", {"retention_ratio": 6})
    assert sorted((r.retention_ratio, r.fully_lost) for r in tables.read_crop_audit(spark, f"{tmp_path}/a").collect()) == [(0.123457, True), (1.0, False)]


def test_threshold(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"threshold_selection": {"selected_threshold": 0.5}}, indent=1))
    assert tables.read_threshold(spark, f"{tmp_path}/r.json") == 0.5
    with pytest.raises(ValueError, match="no field"):
        tables.read_threshold(spark, f"{tmp_path}/r.json", "a.b")
    with pytest.raises(Exception, match="(?i)path"):
        tables.read_threshold(spark, f"{tmp_path}/none.json")


def test_vectors_and_cache(spark, tmp_path):
    rows = spark.createDataFrame([(1, [3.0, 4.0])], "id long, v array<double>")
    tables.save_vectors(rows, f"{tmp_path}/v", layer="both", dims=2)
    got, facts = tables.load_vectors(spark, f"{tmp_path}/v")
    assert got.first().v == pytest.approx([0.6, 0.8]) and facts == {"layer": "both", "dims": 2}
    made = []
    for _ in range(2):
        out = tables.cached(spark, f"{tmp_path}/c", lambda: made.append(1) or rows)
    assert out.count() == 1 and len(made) == 1


def test_responses(spark):
    bank = spark.createDataFrame([(1, [1.0, 0.0])], "id long, v array<double>")
    requests = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, None), (4, []), (5, [float("nan"), 1.0])], "request_id long, v array<double>")
    got = {r.request_id: (r.status, r.prediction) for r in scorer.responses(requests, bank, 0.5).collect()}
    assert got == {1: (200, "good"), 2: (200, "defect"), 3: (400, None), 4: (400, None), 5: (400, None)}
    assert tuple(scorer.health(bank, 0.5).first()) == ("ok", 200, "cpu", True, 1, 2, 0.5) and scorer.health(bank.where("id > 1"), 0.5).first().code == 503
    assert {r.status for r in scorer.responses(requests, bank, 0.5, ready=False).collect()} == {503}


def test_session_without_a_shared_folder(tmp_path):
    """A local session that names no folder works in a temporary one, which goes with the process."""
    code = (
        "from pyspark.sql import SparkSession\n"
        "from normlens.session import shared_dir\n"
        "from normlens.scratch import process_scratch\n"
        "spark = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "assert spark.conf.get('spark.checkpoint.dir', None) is None\n"
        "assert process_scratch(spark).table(spark.range(3), 't').count() == 3 and shared_dir(spark) == shared_dir(spark)\n"
        "print(shared_dir(spark))"
    )
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path)}
    folder = subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, env=env, stdout=subprocess.PIPE, text=True).stdout.strip().splitlines()[-1]
    assert folder.startswith("file://") and not os.path.exists(folder.removeprefix("file://"))


def test_library_stands_without_the_training_data_subpackage(tmp_path):
    import shutil

    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git"))
    others = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and os.path.abspath(p) != ROOT]
    env = os.environ | {"PYTHONPATH": os.pathsep.join([str(copy), *others])}
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and 'auroc' in q and 'op1_license_scan' not in q and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env=env)
    chosen = "nn_distance or test_same_rows[auroc] or valid_cells or ties"
    subprocess.run([sys.executable, "-m", "pytest", "-q", "-x", "tests/test_golden.py", "tests/test_oracle.py", "-k", chosen], cwd=copy, check=True, env=env)
