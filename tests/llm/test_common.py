"""Row keys and skew-safe lookups."""

from pathlib import Path

import pandas as pd
from pyspark.sql import functions as F

from waymark.llm._common import ROW, discard, hash_sample, lookup, materialise, row_by_row, with_row_key


def test_row_keys_name_rows_for_good(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a = {tuple(r) for r in with_row_key(docs).select("doc_id", *ROW).collect()}
    b = {tuple(r) for r in with_row_key(docs.select("doc_id").where("doc_id >= 0")).select("doc_id", *ROW).collect()}
    assert a == b and len({r[1:] for r in a}) == len(a) == docs.count()
    twice = with_row_key(docs.select("doc_id", F.explode(F.array(F.lit(1), F.lit(2)))))
    assert twice.select(*ROW).distinct().count() == 2 * docs.count()
    clash = with_row_key(docs.withColumn("_metadata", F.lit("mine")))
    assert clash.select(*ROW).distinct().count() == docs.count() and clash.first()["_metadata"] == "mine"


def test_row_by_row_is_made_once_and_never_stale(spark, tmp_path):
    path, twice = str(tmp_path / "t"), lambda df: row_by_row(df, df.select((F.col("id") * 2).alias("run")), "t")
    for n in (3, 5):
        pd.DataFrame({"id": range(n)}).to_parquet(path)
        got = twice(spark.read.parquet(path))
        assert sorted(r.run for r in got.collect()) == [2 * i for i in range(n)] and got.columns == ["run"]
        assert "InMemoryRelation" in got._jdf.queryExecution().toString()
    for df in (spark.range(4), spark.read.parquet(path).where(F.rand() >= 0), spark.read.parquet(path).repartition(3)):
        got = twice(df)
        assert "InMemoryRelation" not in got._jdf.queryExecution().toString() and got.count() == df.count()


def test_lookup_with_hot_and_rare_keys(spark):
    rows = materialise(spark.range(2000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500).alias("k"), "id"), "t")
    table = materialise(rows.where("k < 400").groupBy("k").agg(F.count(F.lit(1)).alias("n")), "t")
    want = {r.k: r.n for r in table.collect()}
    got = lookup(rows, table, "k", "n", 2000, hot=10).collect()
    assert len(got) == 2000 and all(r.n == want.get(r.k) for r in got)


def test_samples_by_hash(spark):
    df = spark.range(5000).select("id", F.lit(1).alias("same"))
    got = [r.id for r in hash_sample(df, ["id"], 100).collect()]
    assert len(set(got)) == 100 and sorted(got) == sorted(r.id for r in hash_sample(df.repartition(7), ["id"], 100).collect())
    assert hash_sample(df, ["same"], 100).count() == 100 and hash_sample(df.limit(0), ["id"], 5).count() == 0


def test_discarded_tables_are_gone_and_inputs_are_not(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(9).write.parquet(path)
    df = spark.read.parquet(path)
    scratch, kept = materialise(df, "t"), row_by_row(df, df.select((F.col("id") + 1).alias("id")), "t")
    files = [f.replace("file://", "") for f in scratch.inputFiles()]
    assert kept.count() == 9 and files and all(Path(f).exists() for f in files)
    held = len(spark.sparkContext._jsc.getPersistentRDDs())
    discard(spark, scratch, kept, df)
    assert not any(Path(f).exists() for f in files) and spark.read.parquet(path).count() == 9
    assert kept.count() == 9 and len(spark.sparkContext._jsc.getPersistentRDDs()) == held - 1
