"""Plans and skew: what must hold when the tables are large."""

import re

import pytest
from pyspark.sql import functions as F

from twinledger import AggSpec, aggregate, compare_many, join_tables, key_analysis, reconcile
from twinledger.plans import durable


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return len(re.findall(r"Exchange hashpartitioning", plan_of(df)))


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """A fact table in which one key holds a third of the rows, and a table of keys."""
    folder = tmp_path_factory.mktemp("skew")
    fact = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"),
        F.repeat(F.lit("x"), 200).alias("pad"),
    )
    fact.write.parquet(str(folder / "fact"))
    spark.range(20_000).select(F.col("id").alias("k"), F.concat(F.lit("d"), "id").alias("name")).write.parquet(str(folder / "dim"))
    return spark.read.parquet(str(folder / "fact")), spark.read.parquet(str(folder / "dim"))


def test_key_analysis_has_one_exchange_per_side(files):
    plan = plan_of(key_analysis(*files, "k", "k"))
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 2
    assert "partial_count" in plan and "SortAggregate" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_reconcile_detail_has_one_exchange(files):
    fact, dim = files
    assert exchanges(reconcile(fact, dim, "k", "k")["detail"]) == 1


def test_scans_read_only_needed_columns(files):
    fact, dim = files
    plan = key_analysis(fact, dim, "k", "k")._jdf.queryExecution().executedPlan().toString()
    assert "pad" not in plan and "name" not in plan


def test_checks_do_not_shuffle(files):
    fact, _ = files
    checked = compare_many(fact, [dict(first_col="k", second_col="v", compare_type="numerical"),
                                  dict(first_col="pad", second_col="pad")])
    assert "Exchange" not in plan_of(checked.table)


def skewed_tables(spark, files, nullable):
    fact, dim = files
    if nullable:
        return fact.repartition(8), dim
    ids = spark.range(30_000, numPartitions=8)  # keys that cannot be NULL
    key = F.when(F.col("id") % 3 == 0, F.lit(7).cast("bigint")).otherwise(F.col("id")).alias("k")
    return ids.select(key, F.repeat(F.lit("x"), 200).alias("pad")), spark.range(20_000).select(F.col("id").alias("k"), F.lit("d").alias("name"))


@pytest.mark.parametrize("nullable", [True, False])
@pytest.mark.parametrize("table", ["joined", "duplicates in original"])
def test_hot_key_partition_is_split_in_joins(spark, files, nullable, table):
    """Adaptive execution can split the hot key because the streamed table is a plain shuffle side."""
    fact, dim = skewed_tables(spark, files, nullable)
    changes = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    }
    keep = {k: spark.conf.get(k, None) for k in changes}
    try:
        for k, v in changes.items():
            spark.conf.set(k, v)
        if table == "joined":
            result, rows = join_tables(fact, dim, "base", "k", "k")["joined"], 30_000
        else:
            result, rows = reconcile(fact, dim, "k", "k")[table], 10_001
        assert len(result.collect()) == rows
        assert "skew=true" in plan_of(result)
    finally:
        for k, v in keep.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_hot_key_results_are_whole(files):
    fact, dim = files
    joined = join_tables(fact, dim, "promiscuous", "k", "k")["joined"]
    hot = joined.where("Key = 7").groupBy("Key Code").count().collect()
    assert [tuple(r) for r in hot] == [("D", 10_001)]
    total = aggregate(fact, "k", [AggSpec("count_all", "v", "n"), AggSpec("sum", "v", "s")])
    assert total.where("k = 7").first()["n"] == fact.where("k = 7").count()


def test_category_cost_does_not_grow_with_categories(files):
    fact, _ = files
    table = fact.withColumn("cat", F.col("v") % 50)
    out = aggregate(table, "k", [AggSpec("category-sum", "v", "s", {"cat_key_col": "cat"})])
    plan = plan_of(out)
    assert "Expand" not in plan


def test_rows_of_a_limit_are_cut_in_every_task(files):
    from twinledger.sources.xml import limit_per_group

    fact, _ = files
    limited = limit_per_group(fact, ["k"], 2)
    assert "WindowGroupLimit" in plan_of(limited) and limited.where("k = 7").count() == 2


def test_distinct_counts_are_spread_by_value(files):
    fact, _ = files
    plan = plan_of(aggregate(fact, "k", [AggSpec("count_unique", "v", "u"), AggSpec("count_unique", "pad", "p"),
                                         AggSpec("sum", "v", "s")]))
    assert "Expand" not in plan and "hashpartitioning(__key" in plan and "value" in plan


def test_merged_keys_stay_unique_under_adaptive_coalescing(spark):
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "20KB")
        large = spark.range(100_000).select((F.col("id") % 30_000).alias("k"))
        small = spark.range(300).select((F.col("id") * 7).alias("k"))
        found = key_analysis(large, small, "k", "k").collect()
        assert len(found) == len({r["key"] for r in found}) == 30_000
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_row_numbers_without_one_task(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("o"))
    numbered = durable.with_row_number(df, ["o"], "n")
    got = [(r["o"], r["n"]) for r in numbered.orderBy("o").collect()]
    assert [n for _, n in got] == list(range(1, 5001))


def test_checkpoint_folder_comes_from_the_session(spark):
    durable.ensure_checkpoint_dir(spark)
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert configured.rstrip("/") in spark.sparkContext.getCheckpointDir()
