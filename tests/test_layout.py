"""Windows and joins within documents move no tokens."""
from pyspark.sql import functions as F

from glossa import fixtures



def _moves(df) -> list[str]:
    return [line for line in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in line and "REPARTITION_BY_COL" not in line]


def test_tokens_lie_by_document(spark, sf_dir):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        v = fixtures.Loader(spark, sf_dir)
        met = v("g_char").join(v("g_dep").withColumnRenamed("dep_tok", "tok_index_doc"), ["doc_id", "tok_index_doc"])
        assert _moves(v("g_char")) == []
        assert _moves(met) == []
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_parts_of_large_tables_stay_apart(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(fixtures, "_PART_BYTES", 16 << 10)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        v = fixtures.Loader(spark, sf_dir)
        n = fixtures.parts(v("documents"))
        assert n > 8
        assert v("g_token").select(F.spark_partition_id()).distinct().count() > n // 2
        met = v("g_char").join(v("g_dep").withColumnRenamed("dep_tok", "tok_index_doc"), ["doc_id", "tok_index_doc"])
        assert all("hashpartitioning(doc_id#" in line and f", {n}), REPARTITION_BY_NUM" in line for line in _moves(met))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_bounds_read_no_mention_twice(spark, sf_dir):
    from glossa import registry

    plan = registry.get("event_bounds").run(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate posexplode(split") <= 7


def test_tags_are_looked_up(spark, sf_dir):
    plan = fixtures.Loader(spark, sf_dir)("g_token").where("pos = 'CD'")._jdf.queryExecution().executedPlan().toString()
    assert "CASE WHEN" not in plan


def test_views_that_are_read_often_are_tables(spark, sf_dir):
    from glossa import registry

    for name, view in (("phase_assertions", "g_frame"), ("identity_class_links", "g_elink")):
        v = fixtures.Loader(spark, sf_dir)
        registry.get(name).build(v)
        assert "posexplode" not in v(view)._jdf.queryExecution().executedPlan().toString()
