"""Joins and ranks with one key holding a third of the rows or more."""

from collections import Counter

from pyspark.sql import functions as F

from spanloom.operators import skew as W
from spanloom.operators.kb import alias_pairs
from spanloom.operators.relations import derive_relations
from spanloom.vocab import schema_triples


def hot_rows(spark, n=900):
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id") % 40))
    return spark.range(n).select("id", key.alias("key"))


def test_few_keys_are_hot(spark):
    rows = hot_rows(spark, 5000)
    hot = {r.key: r.weight for r in W.hot_keys(rows, ["key"], share=20).collect()}
    assert hot["hot"] == 7 and len(hot) < 20


def test_lookup_join_is_exact(spark):
    rows = hot_rows(spark)
    lookup = rows.select("key").distinct().filter("key is not null and key <> 'k7'").withColumn("v", F.length("key"))
    for how in ("inner", "left"):
        want = Counter(tuple(r) for r in rows.join(lookup, "key", how).select("id", "key", "v").collect())
        got = Counter(tuple(r) for r in W.lookup_join(rows, lookup, ["key"], how, share=10).select("id", "key", "v").collect())
        assert got == want


def test_lookup_join_spreads_the_hot_key(spark):
    rows = hot_rows(spark, 5000)
    hot = W.hot_keys(rows, ["key"], share=50)
    weight = hot.filter("key = 'hot'").first().weight
    spread = W._weights(rows, hot, ["key"], "_w").withColumn("slot", W._slot(rows.columns, F.col("_w")))
    sizes = [r["count"] for r in spread.filter("key = 'hot'").groupBy("slot").count().collect()]
    assert weight == 17 and len(sizes) == 17 and max(sizes) < 5000 / 3 / 10


def test_pair_join_is_exact(spark):
    left = hot_rows(spark).withColumnRenamed("id", "a")
    right = hot_rows(spark, 300).withColumnRenamed("id", "b")
    want = Counter(tuple(r) for r in left.join(right, "key").select("key", "a", "b").collect())
    got = Counter(tuple(r) for r in W.pair_join(left, right, ["key"], share=10).select("key", "a", "b").collect())
    assert got == want


def test_tiles_bound_the_pairs_of_a_hot_key(spark):
    """One section of 3,000 rows among 30,000: shares of the table would not cut it, its pairs do."""
    rows = spark.range(30_000).select("id", F.when(F.col("id") < 3000, F.lit(-1)).otherwise(F.col("id") % 5000).alias("key"))
    rows = rows.unionByName(spark.createDataFrame([(30_001, None)], "id bigint, key bigint"))
    left, right = rows.withColumnRenamed("id", "a"), rows.withColumnRenamed("id", "b")
    one, two = W.tiles(left, right, ["key"], 100)
    place = ["key", "_tl", "_tr"]
    counts = one.groupBy(place).count().withColumnRenamed("count", "n").join(two.groupBy(place).count(), place)
    pairs = counts.agg(F.max(F.col("n") * F.col("count")), F.sum(F.col("n") * F.col("count"))).first()
    sizes = Counter(r.key for r in rows.collect() if r.key is not None)
    assert pairs[0] <= 4 * 100**2 and pairs[1] == sum(n * n for n in sizes.values())
    joined = W.tile_join(left, right, ["key"], 100)
    assert joined.columns == ["key", "a", "b"]
    assert joined.distinct().count() == joined.filter("a is not null").count() == pairs[1]


def test_rank_is_row_number(spark):
    rows = hot_rows(spark).withColumn("key", F.coalesce("key", F.lit("none")))
    key = F.md5(F.col("id").cast("string"))
    got = {r.id: r["rank"] for r in W.hashed_rank(rows, ["key"], key, digits=1).collect()}
    data = rows.withColumn("m", key).collect()
    for k in {r.key for r in data}:
        ordered = sorted((r.m, r.id) for r in data if r.key == k)
        assert [got[i] for _, i in ordered] == list(range(1, len(ordered) + 1))
    alone = {r.id: r["rank"] for r in W.hashed_rank(rows, [], key).collect()}
    assert sorted(alone.values()) == list(range(1, 901))


def test_prefixes_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(W, "PREFIX_ROWS", 2)
    rows = hot_rows(spark).withColumn("key", F.coalesce("key", F.lit("none")))
    key = F.md5(F.col("id").cast("string"))
    got = {r.id: (r["rank"], r.key) for r in W.hashed_rank(rows, ["key"], key).collect()}
    want = {r.id: (r["rank"], r.key) for r in W.hashed_rank(rows, ["key"], key, digits=3).collect()}
    assert got == want
    assert W.hashed_rank(rows.limit(0), ["key"], key).collect() == []


def test_lowest_by_histogram_is_row_number(spark, monkeypatch):
    monkeypatch.setattr(W, "DIGITS", 1)
    rows = spark.range(500)
    key = F.md5(F.col("id").cast("string"))
    order = [r.id for r in rows.orderBy(key).collect()]
    for n in (0, 1, 7, 250, 499, 500, 900):
        marked = W.mark_lowest(rows, key, lambda total: n, ["id"])
        assert {r.id for r in marked.collect() if r.lowest} == set(order[:n])
        assert "Window" not in marked._jdf.queryExecution().toString() and "Sort" not in marked._jdf.queryExecution().toString()
    assert W.mark_lowest(rows.limit(0), key, lambda total: 1, ["id"]).collect() == []


def test_lowest_among_equal_keys(spark):
    rows = spark.range(90)
    key = F.md5((F.col("id") % 3).cast("string"))
    order = [r.id for r in rows.orderBy(key, "id").collect()]
    for n in (10, 30, 45, 89):
        got = W.mark_lowest(rows, key, lambda total: n, ["id"]).collect()
        assert len(got) == 90 and {r.id for r in got if r.lowest} == set(order[:n])


def test_relations_of_one_long_article(spark):
    labels = ["drug", "DDF", "gene"]
    ents = [("1", "abstract", f"u:{i % 60}", labels[i % 3]) for i in range(600)]
    ents += [(str(p), "title", f"u:{i}", labels[i]) for p in range(2, 30) for i in range(3)]
    df = spark.createDataFrame(ents, "pmid string, location string, uri string, label string")
    default = {(s, o): p for s, p, o, d in schema_triples() if d}
    want = {
        (a[0], a[2], a[3], default[a[3], b[3]], b[2], b[3])
        for a in ents for b in ents
        if a[:2] == b[:2] and a[2] != b[2] and (a[3], b[3]) in default
    }
    got = [tuple(r) for r in derive_relations(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_alias_pairs_of_one_large_concept(spark):
    kb = spark.createDataFrame([("u", f"a{i}") for i in range(60)] + [("v", "x"), ("v", "x"), ("w", "y"), ("w", "z")], "uri string, surface string")
    assert alias_pairs(kb).count() == 60 * 59 // 2 + 1


def test_tile_join_is_dealt_by_pairs(spark, monkeypatch):
    monkeypatch.setattr(W, "TASK_PAIRS", 100)
    kb = spark.createDataFrame([(f"u{k}", f"a{i}") for k in range(5) for i in range(40)], "uri string, surface string")
    pairs = alias_pairs(kb)
    assert "REPARTITION_BY_NUM" in pairs._jdf.queryExecution().executedPlan().toString()
    assert pairs.count() == pairs.distinct().count() == 5 * 40 * 39 // 2
    assert alias_pairs(kb.limit(0)).count() == 0
