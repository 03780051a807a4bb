"""What the plans look like: no cross joins, pruned scans, limits before shuffles."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from symloom.plans import codegraph, general
from symloom.plans.scratch import Scratch
from symloom.plans.tables import spread, table

SF = "/root/testdata/sf0.001"


def plan(df):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


@pytest.mark.parametrize("name", [*codegraph.QUERIES, *general.QUERIES])
def test_no_cross_join(spark, name):
    shown = plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in shown and "BroadcastNestedLoopJoin" not in shown


def test_scans_are_pruned_and_filters_pushed(spark):
    shown = plan(general.p2_pair_stats(spark, SF))
    assert "seq" not in shown.split("ReadSchema")[1].split("\n")[0]
    assert "PushedFilters: [IsNotNull(id)]" in plan(codegraph.find_exact_ci(spark, SF)) or "IsNotNull(id)" in plan(codegraph.find_exact_ci(spark, SF))


def test_heavy_keys_combine_before_every_shuffle(spark):
    shown = plan(general.p2_pair_stats(spark, SF))
    tree = shown.split("\n\n")[0]
    assert tree.count("HashAggregate") == 4 and tree.count("Exchange") == 2


def test_top_k_needs_no_full_sort(spark):
    assert "TakeOrderedAndProject" in plan(codegraph.bm25_topk(spark, SF)) and "TakeOrderedAndProject" in plan(codegraph.vector_topk(spark, SF))


def test_scratch_and_spread(spark):
    scratch = Scratch(spark, "test")
    cut = scratch.cut(spark.range(10).withColumn("x", F.lit(None).cast("string")))
    assert cut.df.count() == 10 and cut.df.schema["x"].dataType.simpleString() == "string"
    cut.drop()
    one = table(spark, SF, "documents")
    assert spread(one, "doc_id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    grouped = one.groupBy("lang").count()
    assert spread(grouped, "lang") is grouped
