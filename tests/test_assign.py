"""Matching over all masks of the view."""

from pyspark.sql import functions as F

from scenequarry import catalogue
from scenequarry.plans.views import Views


def test_hungarian_takes_masks_of_every_family(spark, sf):
    v = Views(spark, sf)
    rows = catalogue.queries()["hungarian"](spark, sf).collect()
    count = lambda df, c: {r.scene_id: r.n for r in df.groupBy("scene_id").agg(F.countDistinct(c).alias("n")).collect()}
    queries, targets = count(v.masks, "mask_id"), count(v.gt, "gt_id")
    assert {r.q // 1000 for r in rows} > {0}
    assert len(rows) == sum(min(queries[s], n) for s, n in targets.items() if s in queries)
    assert len({(r.scene_id, r.q) for r in rows}) == len({(r.scene_id, r.t) for r in rows}) == len(rows)
