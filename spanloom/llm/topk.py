"""Exact top-k by inner product with a pivot table.

Every vector's distances to a fixed number of pivots are worked out once and travel with it. For a query q and a
candidate c, the greatest |d(q, p) - d(c, p)| over the pivots p is a lower bound of their distance and so gives an upper
bound of their inner product, (|q|^2 + |c|^2 - bound^2) / 2. Candidates are evaluated in the order of that bound until
the next bound is below the k-th score found; then the result is exact.

Queries and candidates are dealt into groups; each pair of groups is one task's work and keeps k rows a query, which are
merged by query. The pivots are the only thing broadcast: `pivots` vectors, whatever the data.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.staging import stage

PIVOTS = 48
#: Vectors in a group of queries and of candidates.
QUERIES, CANDIDATES = 1024, 8192
STEP = 256


def scaled(vector: Column) -> Column:
    """floor(1024 x) of each component."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 1024).cast("long"))


def finite(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def _table(pivots: dict[int, np.ndarray]):
    """Adds the distances to the pivots of the vector's length, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("v").to_pylist()
            held, far = [None] * len(vectors), [None] * len(vectors)
            for dim in {len(v) for v in vectors}:
                rows = [k for k, v in enumerate(vectors) if len(v) == dim]
                x = np.array([vectors[k] for k in rows], np.int64).reshape(len(rows), dim)
                p = pivots.get(dim, np.zeros((0, dim))).astype(np.float64)
                d = np.stack([np.sqrt(((x - q) ** 2).sum(1)) for q in p], 1) if len(p) else np.zeros((len(rows), 0))
                for k, row in enumerate(rows):
                    held[row], far[row] = x[k].tobytes(), d[k].tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("rid"), batch.column("vec_id"), batch.column("dim"), batch.column("asks"), pa.array(held, pa.binary()), pa.array(far, pa.binary())],
                ["rid", "vec_id", "dim", "asks", "v", "far"],
            )

    return run


def search(q: np.ndarray, q_far: np.ndarray, c: np.ndarray, c_far: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int):
    """For each query: places of the k best candidates, by score and then by the smaller id, and their scores.

    own: for each query the place of its own row among the candidates, or -1. The second number of the pair says how
    many inner products were worked out.
    """
    norm = (c.astype(np.float64) ** 2).sum(1)
    q_norm = (q.astype(np.float64) ** 2).sum(1)
    out, evaluated = [], 0
    for row in range(len(q)):
        low = np.zeros(len(c))
        for p in range(q_far.shape[1]):
            np.maximum(low, np.abs(c_far[:, p] - q_far[row, p]), out=low)
        low = np.maximum(0, low * (1 - 1e-9) - 1e-6)  # on the safe side of rounding
        bound = (q_norm[row] + norm - low * low) / 2
        bound += 1 + 1e-9 * (q_norm[row] + norm)
        if own[row] >= 0:
            bound[own[row]] = -np.inf
        left = len(c) - int(own[row] >= 0)
        order = np.argsort(-bound, kind="stable")[:left]
        best, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for at in range(0, left, STEP):
            some = order[at : at + STEP]
            if len(score) == k and bound[some[0]] < score[-1]:
                break
            evaluated += len(some)
            best, score = np.append(best, some), np.append(score, c[some] @ q[row])
            top = np.lexsort((ids[best], -score))[:k]
            best, score = best[top], score[top]
        out.append((best, score))
    return out, evaluated


def _cell(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []
        for batch in batches:
            for r in zip(*(batch.column(x).to_pylist() for x in ("cell", "role", "rid", "vec_id", "v", "far")), strict=True):
                if r[0] != cell:
                    yield from done(held)
                    cell, held = r[0], []
                held.append(r[1:])
        yield from done(held)

    def done(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        asks, has = [r for r in rows if r[0] == 0], [r for r in rows if r[0] == 1]
        if not asks or not has:
            return
        q, c = (np.stack([np.frombuffer(r[3], np.int64) for r in side]) for side in (asks, has))
        q_far, c_far = (np.stack([np.frombuffer(r[4]) for r in side]) for side in (asks, has))
        # no id: after all others
        ids = np.array([np.iinfo(np.int64).max if r[2] is None else r[2] for r in has], np.int64)
        places = {r[1]: n for n, r in enumerate(has)}
        own = np.array([places.get(r[1], -1) for r in asks])
        found, _ = search(q, q_far, c, c_far, ids, own, k)
        columns = [[], [], [], []]
        for r, (best, score) in zip(asks, found, strict=True):
            columns[0] += [r[1]] * len(best)
            columns[1] += [r[2]] * len(best)
            columns[2] += [has[n][2] for n in best]
            columns[3] += score.tolist()
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["rid", "query_id", "vec_id", "score"])

    return run


def top_inner_products(vectors: DataFrame, k: int = 10, pivots: int = PIVOTS) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each row whose vec_id is divisible by 100, the k rows with the greatest
    inner product of the vectors scaled to integers, ties to the smaller vec_id (null last); all rows if there are fewer.

    A query's own row is no candidate; another row of the same vec_id is. Vectors that are null or hold null or
    non-finite components take no part; vectors of different lengths are not compared. Components up to 2^20 in size
    give exact scores. Queries repeated as rows are answered each. Runs jobs.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(finite(F.col("embedding")))
    base = stage(
        rows.select(
            F.monotonically_increasing_id().alias("rid"), "vec_id", F.size("embedding").alias("dim"), scaled(F.col("embedding")).alias("v"),
            F.coalesce(F.col("vec_id") % 100 == 0, F.lit(False)).alias("asks"),
        )
    )
    chosen = base.select("dim", "v", F.xxhash64("v").alias("mark")).distinct()
    place = F.row_number().over(Window.partitionBy("dim").orderBy("mark"))
    table: dict[int, list] = {}
    for r in chosen.withColumn("place", place).filter(F.col("place") <= pivots).orderBy("dim", "place").limit(64 * pivots).collect():
        table.setdefault(r["dim"], []).append(r["v"])
    known = stage(
        base.mapInArrow(
            _table({d: np.array(v, np.int64).reshape(len(v), d) for d, v in table.items()}),
            "rid long, vec_id long, dim int, asks boolean, v binary, far binary",
        )
    )
    size = known.groupBy("dim").agg(
        F.ceil(F.sum(F.col("asks").cast("long")) / QUERIES).cast("int").alias("q_groups"), F.ceil(F.count(F.lit(1)) / CANDIDATES).cast("int").alias("c_groups")
    ).filter("q_groups > 0")
    dealt = known.join(F.broadcast(size), "dim")
    group = F.xxhash64("rid")
    asks = dealt.filter("asks").select(
        "dim", F.lit(0).alias("role"), "rid", "vec_id", "v", "far", F.pmod(group, F.col("q_groups")).alias("qg"),
        F.explode(F.sequence(F.lit(0), F.col("c_groups") - 1)).alias("cg"),
    )
    has = dealt.select(
        "dim", F.lit(1).alias("role"), "rid", "vec_id", "v", "far", F.explode(F.sequence(F.lit(0), F.col("q_groups") - 1)).alias("qg"),
        F.pmod(group, F.col("c_groups")).alias("cg"),
    )
    cells = asks.unionByName(has).select(F.xxhash64("dim", F.col("qg").cast("int"), F.col("cg").cast("int")).alias("cell"), "role", "rid", "vec_id", "v", "far")
    best = cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_cell(k), "rid long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("rid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
