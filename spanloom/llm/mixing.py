"""Mixing sources to target weights.

Each source's texts, laid end to end, are packed into blocks of `block` words. The output is cut into shards; for each a
multinomial draw says how many slots every source fills, among what the sources' targets leave. Slot j of a source is
mapped to a block by a keyed pseudorandom permutation of the source's block numbers, one for each pass over the source,
so a source is repeated evenly: a block is never used twice more often than another. Slots and blocks are joined by
source and block number.

The driver holds one number per source and shard. Offsets of texts in a source are running totals over range partitions,
so a source may hold any share of the rows. Texts are read once, for their number of words.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import mix, running_total
from spanloom.llm.sharding import with_source_number
from spanloom.staging import stage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK = 64
SHARDS = 64


def targets(sizes: list[int], weights: list[float], most: int = MOST) -> list[float]:
    """Shares of the total by weight; a share stops at `most` times its source, the excess is shared anew by weight."""
    total, out = float(sum(sizes)), [0.0] * len(sizes)
    free, left = [k for k, s in enumerate(sizes)], total
    while free:
        whole = sum(weights[k] for k in free)
        over = [k for k in free if left * weights[k] / whole > most * sizes[k]]
        if not over:
            for k in free:
                out[k] = left * weights[k] / whole
            break
        for k in over:
            out[k] = float(most * sizes[k])
        left -= sum(out[k] for k in over)
        free = [k for k in free if k not in over]
    return out


def draw_counts(slots: list[int], shards: int, seed: int) -> np.ndarray:
    """Slots of each shard (rows) and source (columns): multinomial draws of what is left; all is used in the end."""
    rng = np.random.default_rng(seed)
    left, out = np.array(slots, np.int64), np.zeros((shards, len(slots)), np.int64)
    for shard in range(shards):
        size = int(left.sum()) // (shards - shard)
        while size > 0:
            drawn = np.minimum(rng.multinomial(size, left / left.sum()), left)
            out[shard] += drawn
            left -= drawn
            size -= int(drawn.sum())
    return out


def permuted(index: np.ndarray, key: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A permutation of range(size) for each key, at each index: a Feistel network of four rounds on the next power of
    four, walked until it falls below size."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        x, h, m = out[todo], half[todo], mask[todo]
        a, b = x >> h, x & m
        for r in range(4):
            a, b = b, a ^ (mix(b + key[todo] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(r + 1)) & m)
        out[todo] = (a << h) | b
        todo = todo[out[todo] >= size[todo].astype(np.uint64)]
    return out.astype(np.int64)


def _slots_to_blocks(blocks: list[int], firsts: np.ndarray, sources: np.ndarray, places: np.ndarray, shards: np.ndarray, seed: int):
    """Slot numbers to (source, block, shard). `firsts` are the first slots of the runs of one shard and source, which
    are at `places` among their source's slots."""
    count = np.array(blocks, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch.column("id").to_numpy()
            at = np.searchsorted(firsts, slot, "right") - 1
            source, place = sources[at], places[at] + slot - firsts[at]
            lap, index = place // count[source], place % count[source]
            key = mix((np.uint64(seed) << np.uint64(40)) + (source.astype(np.uint64) << np.uint64(16)) + lap.astype(np.uint64))
            block = permuted(index, key, count[source])
            yield pa.RecordBatch.from_arrays([pa.array(source.astype(np.int32)), pa.array(block), pa.array(shards[at].astype(np.int32)), pa.array(slot)], ["_source", "block", "shard", "slot"])

    return run


def mix_sources(docs: DataFrame, block: int = BLOCK, shards: int = SHARDS, seed: int = 9) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mixture as three tables.

    rows: every row of docs as (_row, doc_id, _source, source, size, source_size, target); `_row` numbers them.
    pieces: (_row, _source, block, start, words), the parts of rows in blocks, start counted in words of the row.
    slots: (_source, block, shard, slot), the blocks the mixture takes, in its order.

    size is the number of words, 0 for a null text. Sources are taken by code point, null last, and weigh 5, 2, 1,
    repeating. A source without words has no block and target 0. The same input gives the same mixture. Runs jobs.
    """
    rows = stage(
        docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
                    F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), "text").alias("_mark"))
        .withColumn("_row", F.monotonically_increasing_id())
    )
    return _mixture(rows, block, shards, seed)


def _mixture(rows: DataFrame, block: int, shards: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    spark = rows.sparkSession
    numbered, names = with_source_number(rows)
    held = {r[0]: r[1] for r in numbered.groupBy("_source").agg(F.sum("size")).collect()}
    sizes = [held.get(k, 0) for k in range(len(names))]
    goal = targets(sizes, [WEIGHTS[k % len(WEIGHTS)] for k in range(len(names))])
    blocks = [-(-s // block) for s in sizes]
    # a slot takes a block of the source's mean length
    wanted = [min(MOST * b, round(g * b / s)) if s else 0 for g, b, s in zip(goal, blocks, sizes, strict=True)]
    drawn = draw_counts(wanted, shards, seed)
    shard, source = np.nonzero(drawn)
    run = drawn[shard, source]
    firsts = np.cumsum(run) - run
    places = (np.cumsum(drawn, 0) - drawn)[shard, source]
    slots = spark.range(int(run.sum())).mapInArrow(
        _slots_to_blocks(blocks, firsts, source, places, shard, seed), "_source int, block long, shard int, slot long"
    )
    table = spark.createDataFrame([(k, s, g) for k, (s, g) in enumerate(zip(sizes, goal, strict=True))], "_source int, source_size long, target double")
    laid = running_total(numbered, ["_mark", "doc_id", "_row"], "size", "_begin", group="_source")
    first, last = F.expr(f"_begin div {block}"), F.expr(f"(_begin + size - 1) div {block}")
    pieces = (
        laid.filter("size > 0").select("_row", "_source", "_begin", "size", F.explode(F.sequence(first, last)).alias("block"))
        .select(
            "_row", "_source", "block", F.greatest(F.lit(0), F.col("block") * block - F.col("_begin")).alias("start"),
            (F.least(F.col("_begin") + F.col("size"), (F.col("block") + 1) * block) - F.greatest(F.col("_begin"), F.col("block") * block)).alias("words"),
        )
    )
    return numbered.join(F.broadcast(table), "_source").drop("_mark"), pieces, slots


def pieces_taken(pieces: DataFrame, slots: DataFrame) -> DataFrame:
    """The pieces the mixture takes, each with its number of times."""
    uses = slots.groupBy("_source", "block").agg(F.count(F.lit(1)).alias("times"))
    return pieces.join(uses, ["_source", "block"])


def words_taken(rows: DataFrame, pieces: DataFrame, slots: DataFrame) -> DataFrame:
    """rows with `taken`: the words the mixture takes from the row, repeats counted."""
    taken = pieces_taken(pieces, slots).groupBy("_row").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    return rows.join(taken, "_row", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))


def mixed_documents(docs: DataFrame, block: int = BLOCK, shards: int = SHARDS, seed: int = 9) -> DataFrame:
    """The mixture as documents: for each pass, the parts of a row that the mixture takes in it, in the columns of docs.

    A row taken whole keeps its text as it is; of others the words taken are joined by a space. A row that the mixture
    takes nothing from gives no row, one taken n times gives n. Rows without words belong to no block and stay as they
    are. n_chars follows the text. Columns of docs may have any names. Runs jobs.
    """
    kept = stage(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("_row")))
    light = kept.select("doc.doc_id", "doc.source", F.coalesce(F.regexp_count("doc.text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
                        F.xxhash64(F.lit(seed), F.col("doc.doc_id").cast("string"), "doc.text").alias("_mark"), "_row")
    rows, pieces, slots = _mixture(stage(light), block, shards, seed)
    parts = pieces_taken(pieces, slots).groupBy("_row").agg(
        F.sort_array(F.collect_list(F.struct("start", "words", "times"))).alias("_parts"), F.max("times").alias("_most"), F.sum("words").alias("_reach"),
        F.min("times").alias("_least"),
    )
    sized = rows.select("_row", "size").join(parts, "_row", "left").filter("_parts is not null or size = 0")
    laps = sized.withColumn("_lap", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("_most", F.lit(1)))))
    whole = F.col("_parts").isNull() | ((F.col("_reach") == F.col("size")) & (F.col("_least") >= F.col("_lap")))
    words = F.filter(F.split("doc.text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    some = F.filter("_parts", lambda p: p["times"] >= F.col("_lap"))
    cut = F.array_join(F.flatten(F.transform(some, lambda p: F.slice("_words", (p["start"] + 1).cast("int"), p["words"].cast("int")))), " ")
    out = kept.join(laps, "_row").withColumn("_words", F.when(~whole, words)).withColumn("_text", F.when(whole, F.col("doc.text")).otherwise(cut))
    columns = {c: F.col("doc").getField(c) for c in docs.columns} | {"text": F.col("_text")}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("_parts").isNull(), columns["n_chars"]).otherwise(F.length("_text")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[columns[c].alias(c) for c in docs.columns])
