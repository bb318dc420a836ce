"""Distributed steps that several operators share."""

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.staging import stage

CHUNK_BYTES = 1 << 20


def give_back() -> None:
    """Return memory that is free but still held by this process to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """Wrap a function over batches so that its worker gives memory back before each batch it reads and at its end.

    Workers outlive their tasks and stand beside the executor's heap: what one stage freed but held would be missing in
    the next.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch
            del batch
            give_back()

    @wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(read(batches))
        finally:
            give_back()

    return tidied


def running_total(df: DataFrame, order: list[str], value: str, out: str, group: str | None = None) -> DataFrame:
    """Add `out`: the sum of `value` over the rows of the same group that come before in `order`.

    Rows are range-partitioned by group and order, so a group may span any number of tasks; what is added up across
    partitions is one sum per partition and group. `order` should be unique within a group, else equal rows come in
    any order. The group column holds no nulls. Runs a job.
    """
    by = [group] if group else []
    dealt = stage(df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = (
        dealt.groupBy("_part", *by)
        .agg(F.sum(value).alias("_sum"))
        .select("_part", *by, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    )
    within = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        dealt.withColumn("_within", F.coalesce(F.sum(value).over(within), F.lit(0)))
        .join(base, ["_part", *by])
        .withColumn(out, (F.col("_base") + F.col("_within")).cast("long"))
        .drop("_part", "_base", "_within")
    )


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a, b): one row (node, root) per node, root the least node.

    Alternates two steps that hang every node below the least neighbour it knows, once among greater and once among
    lesser neighbours, until nothing changes: a logarithmic number of rounds, each written to the shared folder. Work
    per round is in proportion to the edges and no neighbour list is collected.
    """
    hang = edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi <> lo").distinct()
    seen = None
    while True:
        both = hang.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            hang.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        top = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(top, "hi").filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        hang = stage(small.unionByName(top.select("hi", F.col("m").alias("lo"))).distinct())
        now = hang.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return hang.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(
        hang.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    )


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows. Null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` bytes; a longer row is a range of its own."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters their bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words [^\\x20\\x09-\\x0D]+ of each row, A-Z lower-cased; and the rows' offsets into them."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    space = _SPACE[data]
    before = np.empty(len(data), bool)
    before[0], before[1:] = True, space[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = True
    begins = ~space & before
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    at = np.flatnonzero(~space)
    word = np.cumsum(begins)[at] - 1
    place = at - starts[word]
    powers = np.multiply.accumulate(np.full(int(place.max()) + 1, _BASE, np.uint64))
    parts = _BYTE[_LOWER[data[at]]] * powers[place]
    return mix(np.add.reduceat(parts, np.searchsorted(at, starts))), np.searchsorted(starts, offsets)
