"""Rows that are as many as pages never meet others by a broadcast, whatever sizes Spark guesses."""

from docprobe.operators import forge
from docprobe.plans import catalogue_order, views

SF = "/root/testdata/sf0.001"


def joins(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("SortMergeJoin"), plan.count("Broadcast")


def test_free_places_and_pages_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(views, "SHUFFLED", 0)
    pages = views.pages(spark, SF)
    assert joins(pages) == (3, 0)
    assert joins(forge.plan_copy_move(spark.createDataFrame(pages.collect(), pages.schema), crowded=0)) == (2, 0)
    got = {tuple(r) for r in catalogue_order.q_free_places(spark, SF).collect()}
    monkeypatch.undo()
    assert got == {tuple(r) for r in catalogue_order.q_free_places(spark, SF).collect()} and len(got) > 1000
