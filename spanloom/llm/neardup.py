"""Near-duplicate vectors: Euclidean p-stable hashing of normalised vectors, then exact cosines.

Each of `tables` hash tables has `width` random projections, shifted and cut into steps of length `step`; vectors whose
steps are all equal share a bucket. For a pair at cosine 0.93 (distance 0.374) one step of 2 agrees with probability
0.85, eight with 0.28, and in one of 24 tables with more than 0.999. Vectors in a common bucket are compared exactly.

Equal vectors are one node with a weight. A bucket with one vector is dropped before vectors move; a large one is cut
into slices whose pairs are units of work of bounded size. A pair is counted in the first table where it meets only, and
no pair is ever a row: a unit gives the number of links of each vector and edges that connect what its links connect.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.common import components
from spanloom.staging import stage

COSINE = 0.93
TABLES, WIDTH, STEP = 24, 8, 2.0
SLICE = 1024


def usable(vector: Column) -> Column:
    """Not null and neither empty, zero nor holding null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _hash(tables: int, width: int, step: float, seed: int):
    """Adds the unit vector (doubles as bytes) and its bucket in each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            vectors = batch.column("embedding").to_pylist()
            unit, keys = [None] * len(vectors), [None] * len(vectors)
            for dim in {len(v) for v in vectors}:
                if dim not in planes:
                    rng = np.random.default_rng([seed, dim])
                    planes[dim] = rng.standard_normal((dim, tables * width)), rng.random(tables * width) * step
                rows = [k for k, v in enumerate(vectors) if len(v) == dim]
                x = np.array([vectors[k] for k in rows], np.float64)
                x /= np.abs(x).max(1, keepdims=True)
                x /= np.sqrt((x * x).sum(1, keepdims=True))
                a, b = planes[dim]
                steps = np.floor((x @ a + b) / step).astype(np.int64).astype(np.uint64).reshape(len(rows), tables, width)
                h = np.full((len(rows), tables), dim, np.uint64)
                for k in range(width):
                    h = (h ^ steps[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
                    h ^= h >> np.uint64(29)
                h = h.view(np.int64)
                for k, row in enumerate(rows):
                    unit[row], keys[row] = x[k].tobytes(), h[k].tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("label"), batch.column("weight"), pa.array(unit, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["node", "label", "weight", "unit", "keys"],
            )

    return run


def _compare(least: float):
    """Rows sorted by unit of work: counts of links, and edges. A row is (node, links, peer): peer is null for counts."""

    def done(rows: list[tuple]) -> pa.RecordBatch | None:
        left = [r for r in rows if r[0] == 0]
        right = [r for r in rows if r[0] == 1] if rows[0][6] else left
        if not left or not right or (left is right and len(left) < 2):
            return None
        x, y = (np.stack([np.frombuffer(r[3]) for r in side]) for side in (left, right))
        kx, ky = (np.array([r[4] for r in side]) for side in (left, right))
        like = x @ y.T >= least
        for t in range(rows[0][5]):  # pairs that an earlier table has
            like &= kx[:, t][:, None] != ky[:, t][None, :]
        if left is right:
            np.fill_diagonal(like, False)
        wx, wy = (np.array([r[2] for r in side], np.int64) for side in (left, right))
        names = np.array([r[1] for r in left]), np.array([r[1] for r in right])
        count = [(names[0], like @ wy)] + ([] if left is right else [(names[1], like.T @ wx)])
        node, links, peer = [], [], []
        for name, n in count:
            at = np.flatnonzero(n)
            node.append(name[at]), links.append(n[at]), peer.append(np.full(len(at), -1))
        i, j = _forest(like, left is right)
        node.append(names[0][i]), links.append(np.zeros(len(i), np.int64)), peer.append(names[1][j])
        node, links, peer = (np.concatenate(c) for c in (node, links, peer))
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(links), pa.array(peer, mask=peer < 0)], ["node", "links", "peer"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, rows = None, []
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("work", "side", "node", "weight", "unit", "keys", "table", "cross")), strict=True):
                if r[0] != work:
                    if rows and (out := done(rows)):
                        yield out
                    work, rows = r[0], []
                rows.append(r[1:])
        if rows and (out := done(rows)):
            yield out

    return run


def _forest(like: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Fewest pairs that connect what `like` connects, found by spreading from row to row."""
    rows, columns = like.shape
    new_row, new_column = np.ones(rows, bool), np.ones(columns, bool)
    out = []
    for start in range(rows):
        if not new_row[start]:
            continue
        new_row[start] = False
        if same:
            new_column[start] = False
        todo = [start]
        while todo:
            r = todo.pop()
            for c in np.flatnonzero(like[r] & new_column):
                new_column[c] = False
                out.append((r, c))
                if same:
                    new_row[c] = False
                    todo.append(c)
                else:
                    for q in np.flatnonzero(like[:, c] & new_row):
                        new_row[q] = False
                        out.append((q, c))
                        todo.append(q)
    pairs = np.array(out, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def near_duplicates(
    vectors: DataFrame, least: float = COSINE, tables: int = TABLES, width: int = WIDTH, step: float = STEP, seed: int = 5
) -> DataFrame:
    """One row (vec_id, n_links, component_id, kept) per row of vectors: vec_id, embedding, label.

    Rows link when labels are equal and not null, vectors have the same length and their cosine, in double precision, is
    at least `least`. A vector that is null, empty, zero or holds null or non-finite components links with nothing, nor
    does one without a label: n_links 0, component_id its own vec_id, kept. Repeated rows are rows of their own and link
    with each other. Null vec_ids are skipped in component_id unless a component has no other. Runs jobs.
    """
    rows = vectors.select("vec_id", "embedding", "label")
    good = usable(F.col("embedding")) & F.col("label").isNotNull()
    nodes = stage(
        rows.filter(good).groupBy("label", "embedding").agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("least"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    label = nodes.schema["label"].dataType
    schema = T.StructType([
        T.StructField("node", T.LongType()), T.StructField("label", label), T.StructField("weight", T.LongType()),
        T.StructField("unit", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType())),
    ])
    hashed = stage(nodes.select("node", "label", "weight", "embedding").mapInArrow(_hash(tables, width, step, seed), schema))
    buckets = hashed.select("node", "label", F.posexplode("keys").alias("table", "bucket"))
    full = (
        buckets.groupBy("label", "table", "bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        .withColumn("slices", F.ceil(F.col("n") / SLICE).cast("int")).drop("n")
    )
    mine = F.pmod(F.xxhash64("node"), F.col("slices")).cast("int")
    met = buckets.join(full, ["label", "table", "bucket"]).withColumn("mine", mine).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))
    )
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    work = met.select(
        "node", "table", F.xxhash64("label", "table", "bucket", low, high).alias("work"),
        (F.col("mine") > F.col("other")).cast("int").alias("side"), (F.col("mine") != F.col("other")).alias("cross"),
    )
    found = stage(
        work.join(hashed.select("node", "weight", "unit", "keys"), "node").repartition("work").sortWithinPartitions("work")
        .mapInArrow(_compare(least), "node long, links long, peer long")
    )
    links = found.filter("peer is null").groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.filter("peer is not null").select(F.col("node").alias("a"), F.col("peer").alias("b")))
    named = (
        nodes.select("node", "weight", "least", "label", "embedding").join(links, "node", "left").join(roots, "node", "left")
        .withColumn("root", F.coalesce("root", "node"))
    )
    smallest = named.groupBy("root").agg(F.min("least").alias("component"))
    done = named.join(smallest, "root").select(
        F.col("label").alias("_label"), F.col("embedding").alias("_embedding"), "component",
        (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n"),
    )
    placed = rows.withColumn("good", good).join(
        done, F.col("good") & (F.col("label") == F.col("_label")) & (F.col("embedding") == F.col("_embedding")), "left"
    )
    component = F.when(F.col("good"), F.col("component")).otherwise(F.col("vec_id"))
    return placed.select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
