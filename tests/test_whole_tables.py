"""Queries over whole tables give rows for every id, not for the first few; their values are compared with SQL in test_oracle."""

import pytest

from normlens.plans import registry

DIR = "/root/testdata/sf0.001"
WHOLE = {
    "cell_ratios": ("image_id", "part", "p_partkey"),
    "bilinear_upsample": ("image_id", "embeddings", "vec_id"),
    "anomaly_map": ("image_id", "embeddings", "vec_id"),
    "patch_positions": ("vec_id", "embeddings", "vec_id"),
}


@pytest.mark.parametrize("name", sorted(WHOLE))
def test_every_id(spark, name):
    own, table, key = WHOLE[name]
    got = {r[0] for r in registry.queries()[name](spark, DIR).select(own).distinct().collect()}
    assert got == {r[0] for r in spark.read.parquet(f"{DIR}/{table}.parquet").select(key).collect()}


def test_every_pair_of_an_image(spark):
    sizes = [r["count"] for r in spark.read.parquet(f"{DIR}/embeddings.parquet").selectExpr("label", "vec_id div 50 AS o").groupBy("label", "o").count().collect()]
    assert registry.queries()["cosine_pairs"](spark, DIR).count() == sum(n * (n - 1) // 2 for n in sizes)


def test_no_sql_keeps_the_cut():
    sql = registry.oracle_sql()
    assert all(cut not in sql[name] for name in [*WHOLE, "cosine_pairs"] for cut in ("image_id <= 40", "image_id < 100", "vec_id < 50", "ordinal = 0"))


def test_maps_and_cells_do_not_grow_rows_before_they_need(spark):
    """An embedding's map is made where it lies; cells are dealt out before they become rows, and their 64ths are not rounded one by one."""
    plan = lambda name: registry.queries()[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan("anomaly_map") and "Generate" not in plan("anomaly_map")
    assert "round(valid_ratio" not in plan("cell_ratios") and "REPARTITION_BY_NUM" in plan("cell_ratios")
    ratios = {r[0] for r in registry.queries()["cell_ratios"](spark, DIR).select("valid_ratio").distinct().collect()}
    assert ratios and all(x * 64 == int(x * 64) and x == round(x, 6) for x in ratios)


def test_ends_of_a_map_are_not_sought_for_each_pixel(spark):
    plan = registry.queries()["patch_score_map"](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    hot = next(line for line in plan.splitlines() if "n_hot" in line)
    assert "array_min" in hot and "array_min" not in hot.split("filter(", 1)[1]
