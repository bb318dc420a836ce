"""Exact joins and ranks that do not send a hot group to one task.

A key is hot when it holds more than 1/SHARE of all rows. Fewer than SHARE keys can be hot, whatever the data, so
the list of hot keys may always be broadcast.
"""

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from spanloom.staging import stage

SHARE = 500
# Rows of a prefix that are numbered in one sort, and hex digits a round of counting adds.
PREFIX_ROWS = 1 << 16
DIGITS = 3
# Rows of either side that meet in one tile.
TILE_ROWS = 2048
# Pairs that a task of a tile join forms, and the most tasks of one.
TASK_PAIRS, MOST_TASKS = 1 << 24, 1 << 14


def hot_keys(df: DataFrame, keys: list[str], share: int = SHARE) -> DataFrame:
    """Keys holding more than 1/share of the rows, with `weight`: how many such shares they hold, rounded up."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return (
        counts.join(F.broadcast(total), F.col("n") * share > F.col("total"))
        .select(*keys, F.ceil(F.col("n") * share / F.col("total")).cast("int").alias("weight"))
    )


def _weights(df: DataFrame, hot: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Left join the (bounded) hot key list; other keys get weight 1. Null keys stay."""
    hot = hot.withColumnRenamed("weight", name)
    return df.join(F.broadcast(hot), keys, "left").withColumn(name, F.coalesce(name, F.lit(1)))


def _slot(columns: list[str], slots: Column) -> Column:
    return F.pmod(F.xxhash64(*columns), slots.cast("bigint")).cast("int")


def lookup_join(
    rows: DataFrame, lookup: DataFrame, keys: list[str], how: str = "inner", share: int = SHARE,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Join many rows to a table that is unique on `keys`; `how` is inner or left.

    Rows of a hot key are spread over as many slots as it holds shares, and its lookup row is repeated per slot.
    `hot` may give the hot keys, as of hot_keys, where counting all rows costs too much: it decides only how rows are
    spread, never which are joined. The short list of hot keys is staged, so that rows are counted once.
    """
    hot = stage(hot_keys(rows.select(*keys), keys, share) if hot is None else hot)
    spread = _weights(rows, hot, keys, "_w").withColumn("_slot", _slot(rows.columns, F.col("_w"))).drop("_w")
    repeated = (
        _weights(lookup, hot, keys, "_w")
        .withColumn("_slot", F.explode(F.sequence(F.lit(0), F.col("_w") - 1)))
        .drop("_w")
    )
    return spread.join(repeated, [*keys, "_slot"], how).drop("_slot")


def pair_join(left: DataFrame, right: DataFrame, keys: list[str], share: int = SHARE) -> DataFrame:
    """Inner join of two many-sided tables. A hot key becomes a grid of tiles, each one join key.

    Each side of a hot key is cut in about sqrt(weight) slots and repeated for every slot of the other side, so a
    tile holds a fair share of the pairs and the rows sent grow with the square root of the weight only. The short
    lists of hot keys are staged, so that rows are counted once.
    """
    def cuts(df: DataFrame) -> DataFrame:
        hot = hot_keys(df.select(*keys), keys, share)
        return stage(hot.withColumn("weight", F.ceil(F.sqrt("weight")).cast("int")))

    hot_left, hot_right = cuts(left), cuts(right)

    def tiled(df: DataFrame, own: str, other: str) -> DataFrame:
        out = _weights(_weights(df, hot_left, keys, "_wl"), hot_right, keys, "_wr")
        return (
            out.withColumn(own, _slot(df.columns, F.col("_wl" if own == "_tl" else "_wr")))
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.col("_wr" if other == "_tr" else "_wl") - 1)))
            .drop("_wl", "_wr")
        )

    return tiled(left, "_tl", "_tr").join(tiled(right, "_tr", "_tl"), [*keys, "_tl", "_tr"]).drop("_tl", "_tr")


def tiles(left: DataFrame, right: DataFrame, keys: list[str], tile_rows: int = TILE_ROWS) -> tuple[DataFrame, DataFrame]:
    """Both tables with `_tl` and `_tr`: equal keys and tiles meet about tile_rows rows of either side.

    Only keys that make more than tile_rows ** 2 pairs are cut, each side in as many slots as it holds tile_rows, and its
    rows are repeated for every slot of the other side. There may be as many such keys as rows / tile_rows, so their list
    is staged and left to Spark's own size check, not broadcast. Slots are hashes of whole rows: rows should be distinct.
    """
    return _tiles(left, right, keys, tile_rows)[:2]


def _tiles(left: DataFrame, right: DataFrame, keys: list[str], tile_rows: int) -> tuple[DataFrame, DataFrame, int]:
    """As tiles, and the number of pairs of rows with equal keys, observed while the keys to cut are staged."""
    def sizes(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))

    pairs = F.col("_nl").cast("double") * F.col("_nr")
    seen = Observation()
    cuts = stage(
        sizes(left, "_nl").join(sizes(right, "_nr"), keys).observe(seen, F.sum(pairs).alias("pairs"))
        .filter(pairs > float(tile_rows) ** 2)
        .select(*keys, *[F.ceil(F.col(n) / tile_rows).cast("int").alias(w) for n, w in (("_nl", "_wl"), ("_nr", "_wr"))])
    )

    def tiled(df: DataFrame, own: str, other: str) -> DataFrame:
        weight = {"_tl": F.coalesce("_wl", F.lit(1)), "_tr": F.coalesce("_wr", F.lit(1))}
        return (
            df.join(cuts, keys, "left")
            .withColumn(own, _slot(df.columns, weight[own]))
            .withColumn(other, F.explode(F.sequence(F.lit(0), weight[other] - 1)))
            .drop("_wl", "_wr")
        )

    return tiled(left, "_tl", "_tr"), tiled(right, "_tr", "_tl"), int(seen.get.get("pairs") or 0)


def tile_join(left: DataFrame, right: DataFrame, keys: list[str], tile_rows: int = TILE_ROWS) -> DataFrame:
    """Inner join of two many-sided tables in which no task has to form much more than tile_rows ** 2 pairs of one key.

    Tiles are dealt to as many tasks as their pairs ask, TASK_PAIRS each: by the size of what is shuffled, which says
    little about the pairs it makes, adaptive execution would put them into few.
    """
    one, two, pairs = _tiles(left, right, keys, tile_rows)
    tile = [*keys, "_tl", "_tr"]
    tasks = min(math.ceil(pairs / TASK_PAIRS), MOST_TASKS)
    if tasks > left.sparkSession.sparkContext.defaultParallelism:
        one, two = one.repartition(tasks, *tile), two.repartition(tasks, *tile)
    return one.join(two, tile).drop("_tl", "_tr")


def hashed_rank(
    df: DataFrame, group: list[str], key: Column, name: str = "rank", tie: list[str] | None = None, digits: int | None = None
) -> DataFrame:
    """1-based position of each row in its group when ordered by the md5 hex string `key`, then by `tie`.

    The same number as row_number() over the group, but no task sees a whole group: md5 spreads the rows evenly
    over prefixes of `digits` hex digits, rows are numbered within a prefix, and the counts of lower prefixes
    (at most 16 ** digits per group) are added. An empty `group` ranks the whole table. Without `digits` a job counts the
    largest group, and a prefix of it holds one to sixteen times PREFIX_ROWS rows, or fewer where all are fewer.
    """
    if digits is None:
        counts = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
        largest = counts.agg(F.max("n")).first()[0] or 0
        digits = max(1, int(math.log(max(largest / PREFIX_ROWS, 1), 16)))
    keyed = df.withColumn("_key", key).withColumn("_prefix", F.substring("_key", 1, digits))
    sizes = keyed.groupBy(*group, "_prefix").agg(F.count(F.lit(1)).alias("_n"))
    below = Window.partitionBy(*group).orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*group, "_prefix", F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_below"))
    within = Window.partitionBy(*group, "_prefix").orderBy("_key", *(tie or []))
    return (
        keyed.withColumn("_within", F.row_number().over(within))
        .join(offsets, [*group, "_prefix"])
        .withColumn(name, (F.col("_below") + F.col("_within")).cast("bigint"))
        .drop("_key", "_prefix", "_within", "_below")
    )


def mark_lowest(df: DataFrame, key: Column, wanted: Callable[[int], int], tie: list[str], name: str = "lowest") -> DataFrame:
    """Rows with `name`: whether they are among the wanted(n) of n rows that come first by the md5 hex string `key`.

    The key at the cut is found by a histogram of prefixes, refined by DIGITS hex digits a round within the one prefix that
    holds the cut: a round is a count of at most 16 ** DIGITS groups, and a dozen digits tell any table apart. Nothing is
    sorted. Rows whose key equals the one at the cut are ordered by `tie`, which only matters where keys repeat. Runs a
    job a round; df gives the same rows each time.
    """
    keyed = df.withColumn("_key", key)
    prefix, left, total = "", None, None
    while True:
        head = F.substring("_key", 1, len(prefix) + DIGITS).alias("head")
        counted = keyed.filter(F.col("_key").startswith(prefix)).groupBy(head).agg(
            F.count(F.lit(1)).alias("n"), F.min("_key").alias("low"), F.max("_key").alias("high")
        )
        bins = sorted(counted.collect())
        if total is None:
            total = sum(b.n for b in bins)
            left = wanted(total)
            if left <= 0 or left >= total:
                return df.withColumn(name, F.lit(left > 0))
        at = 0
        while bins[at].n < left:
            left -= bins[at].n
            at += 1
        found = bins[at]
        if left == found.n:
            return keyed.withColumn(name, F.col("_key") <= found.high).drop("_key")
        if found.low == found.high:
            break
        prefix = found.head
    tied = keyed.filter(F.col("_key") == found.low).withColumn(name, F.row_number().over(Window.orderBy(*tie)) <= left)
    rest = keyed.filter(F.col("_key") != found.low).withColumn(name, F.col("_key") < found.low)
    return rest.unionByName(tied).drop("_key")
