from collections import Counter

from pyspark.sql import functions as F

from spanloom.operators import sampling as H


def rows(spark):
    tier = F.when(F.col("id") < 60, "gold").otherwise("bronze")
    return spark.range(100).select(F.col("id").cast("string").alias("pmid"), tier.alias("annotator"))


def test_bootstrap_sizes(spark):
    got = H.bootstrap(rows(spark), "annotator", ["pmid"], {"gold": 2.3, "bronze": 0.25}, 3).collect()
    assert Counter(r.annotator for r in got) == {"gold": 138, "bronze": 10}
    assert sorted(r.draw for r in got if r.annotator == "gold") == list(range(138))
    assert max(Counter(r.pmid for r in got).values()) > 1
    again = H.bootstrap(rows(spark).repartition(1), "annotator", ["pmid"], {"gold": 2.3, "bronze": 0.25}, 3).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_holdout_keeps_documents_together(spark):
    docs = rows(spark).crossJoin(spark.createDataFrame([("title",), ("abstract",)], "location string"))
    split = {r.pmid: r.split for r in H.holdout_documents(docs, 1).collect()}
    assert Counter(split.values()) == {"dev": 10, "train": 90}
    single = H.holdout_documents(docs.filter("pmid = '5'"), 1).collect()
    assert [r.split for r in single] == ["dev"]


def test_split_rows(spark):
    got = H.split_rows(rows(spark).limit(95), ["pmid"], 42).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in got} == {"test": 10, "train": 85}
