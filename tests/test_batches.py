import os

import pytest
from pyspark.sql import functions as F

from normlens.sources import batches, catalog, pixels


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("images")
    for i in range(203):
        path = root / f"cable/train/good/{i * 37 % 1000:04}.png"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(bytes([i % 256]) * (100 + i * i % 900))
    (root / "cable/train/good/empty.png").write_bytes(b"")
    return str(root)


def files_of(root):
    found = [os.path.relpath(os.path.join(d, f), root) for d, _, names in os.walk(root) for f in names]
    return sorted(found)


def test_order_bytes_and_contents(spark, folder):
    listing = catalog.read_images(spark, folder, content=False)
    got = batches.read_batches(listing, folder, size=4, split_bytes=10_000).withColumn("task", F.spark_partition_id()).collect()
    names = files_of(folder)
    assert [r.path for r in sorted(got, key=lambda r: r.place)] == names
    assert sorted(r.place for r in got) == list(range(len(names)))
    assert all(r.batch == r.place // 4 for r in got)
    assert all(bytes(r.content) == open(f"{folder}/{r.path}", "rb").read() for r in got)
    sizes, tasks = {}, {}
    for r in got:
        sizes[r.split] = sizes.get(r.split, 0) + len(r.content)
        tasks.setdefault(r.task, []).append((r.split, r.place))
    assert len(sizes) == round(sum(sizes.values()) / 10_000) > 5
    assert max(sizes.values()) <= 2 * min(sizes.values())
    assert all(len({s for s, _ in rows}) == 1 and rows == sorted(rows) for rows in tasks.values())
    assert all(len({r.split for r in got if r.batch == b}) == 1 for b in range(51))


def test_listing(spark, folder):
    names = files_of(folder)
    assert sorted(r.path for r in catalog.list_files(spark, folder).collect()) == names
    assert catalog.list_files(spark, folder, "00*.png").count() == sum(n.split("/")[-1].startswith("00") for n in names)
    assert catalog.list_files(spark, folder, recursive=False).count() == 0
    assert catalog.list_files(spark, folder + "/cable/train/good", recursive=False).count() == len(names)
    rows = {r.path: r for r in catalog.read_images(spark, folder).collect()}
    assert sorted(rows) == names and rows["cable/train/good/empty.png"].content == b""
    assert {r.path for r in pixels.attributes(catalog.read_images(spark, folder, "empty*")).where("corrupt").collect()} == {"cable/train/good/empty.png"}


def test_offsets_over_several_runs(spark, folder, monkeypatch):
    listing = catalog.read_images(spark, folder, content=False)
    plan = lambda: sorted((r.place, r.batch, r.split) for r in batches.planned(listing.select("path", "length"), 3, 20_000)[0].collect())
    whole = plan()
    monkeypatch.setattr(batches, "RUN", 5)
    assert plan() == whole


def test_gone_files_and_empty_listings(spark, folder):
    rows = spark.createDataFrame([("gone.png", 5), ("cable/train/good/0000.png", None)], "path string, length long")
    got = {r.path: r.content for r in batches.read_batches(rows, "file://" + folder).collect()}
    assert got["gone.png"] is None and len(got["cable/train/good/0000.png"]) == 100
    assert batches.read_batches(rows.limit(0), folder).collect() == []
