"""Sampling and splitting. Order comes from md5 of a seed and the row's key, so results repeat anywhere."""

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators.reshape import allowed_entities
from spanloom.operators.skew import hashed_rank, mark_lowest
from spanloom.operators.spans import by_unit, unit_bounds
from spanloom.schemas import SECTION
from spanloom.staging import stage
from spanloom.vocab import NO_RELATION, PREDICATES

# Stands for null in arrays of numbers; below any offset.
NULL = -(1 << 31) - 1


def seeded(seed: int, *key: str | Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *key))


def bootstrap(df: DataFrame, stratum: str, key: list[str], fractions: dict[str, float], seed: int) -> DataFrame:
    """round(fraction * n) draws with replacement from each stratum; `draw` numbers them.

    `key` identifies a row. Row number r of n makes the draws r, r + n, r + 2n .. below the target, so drawing is
    spread like the rows; draw k takes the row whose rank is md5(seed|stratum|k) modulo n.
    """
    wanted = F.create_map(*[F.lit(x) for item in fractions.items() for x in item])
    ranked = hashed_rank(df.filter(F.col(stratum).isin(list(fractions))), [stratum], seeded(seed, *key), "rank", key)
    sizes = (
        ranked.groupBy(stratum)
        .agg(F.count(F.lit(1)).alias("size"))
        .withColumn("target", F.bround(F.element_at(wanted, F.col(stratum)) * F.col("size")).cast("bigint"))
    )
    # One row per stratum of `fractions`.
    numbered = ranked.select(stratum, "rank").join(F.broadcast(sizes), stratum)
    draws = numbered.filter(F.col("rank") <= F.col("target")).select(
        stratum, "size", F.explode(F.sequence(F.col("rank") - 1, F.col("target") - 1, F.col("size"))).alias("draw")
    )
    index = F.conv(F.substring(seeded(seed, stratum, F.col("draw").cast("string")), 1, 15), 16, 10).cast("bigint")
    picks = draws.select(stratum, "draw", (index % F.col("size") + 1).alias("rank"))
    return picks.join(ranked, [stratum, "rank"]).drop("rank").select(*df.columns, "draw")


def holdout_documents(documents: DataFrame, seed: int, fraction: float = 0.1, id_col: str = "pmid") -> DataFrame:
    """(id, split): max(1, int(fraction * n)) distinct documents are dev, the rest train. Stages the ids."""
    ids = stage(documents.select(id_col).distinct())
    marked = mark_lowest(ids, seeded(seed, id_col), lambda n: max(math.floor(n * fraction), 1), [id_col], "_dev")
    return marked.select(id_col, F.when(F.col("_dev"), "dev").otherwise("train").alias("split"))


def split_rows(df: DataFrame, key: list[str], seed: int, test_size: float = 0.1) -> DataFrame:
    """Rows with `split`: ceil(test_size * n) of them test, the rest train. `key` identifies a row."""
    marked = mark_lowest(df, seeded(seed, *key), lambda n: math.ceil(n * test_size), key, "_test")
    return marked.withColumn("split", F.when(F.col("_test"), "test").otherwise("train")).drop("_test")


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of so many items, laid end to end: the group of each item and its place in the group."""
    group = np.repeat(np.arange(len(counts)), counts)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(counts) - counts, counts)


def _draw(table: pa.Table, seed: int, ratio: float, without_positives: int) -> pa.RecordBatch:
    """Examples of whole sections, sorted by section: rows with kind 0 are entities, those with kind 1 relations."""
    bounds = unit_bounds(table, SECTION)
    sections = len(bounds) - 1
    section = np.repeat(np.arange(sections), np.diff(bounds))

    def numbers(name: str) -> tuple[np.ndarray, np.ndarray]:
        column = table.column(name).combine_chunks()
        return column.fill_null(NULL).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)

    (pos, has_pos), (start, has_start), (end, has_end), (other, _), (code, _) = map(
        numbers, ("pos", "start_idx", "end_idx", "other_start", "code")
    )
    is_relation = table.column("kind").to_numpy() == 1

    def differ(s: np.ndarray, o: np.ndarray) -> np.ndarray:
        starts = (start[s] != start[o]) & has_start[s] & has_start[o]
        return starts | ((end[s] != end[o]) & has_end[s] & has_end[o])

    # The last relation at a pair of starts decides.
    gold = np.flatnonzero(is_relation)
    gold = gold[np.lexsort((pos[gold], other[gold], start[gold], section[gold]))]
    last = np.ones(len(gold), bool)
    one, two = gold[:-1], gold[1:]
    last[:-1] = (section[one] != section[two]) | (start[one] != start[two]) | (other[one] != other[two])
    gold = gold[last & (code[gold] > 0)]

    # Entities at either start. A key holds the section above the start, an int.
    ents = np.flatnonzero(~is_relation & has_start)
    keys = (section[ents] << 32) + start[ents]
    order = np.argsort(keys, kind="stable")
    ents, keys = ents[order], keys[order]

    def at(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        wanted = (section[gold] << 32) + starts
        first = np.searchsorted(keys, wanted)
        return first, np.searchsorted(keys, wanted, "right") - first

    (s_first, s_n), (o_first, o_n) = at(start[gold]), at(other[gold])
    of, k = _spread(s_n * o_n)
    s, o = ents[s_first[of] + k // np.maximum(o_n[of], 1)], ents[o_first[of] + k % np.maximum(o_n[of], 1)]
    right = differ(s, o)
    s, o, labels = s[right], o[right], code[gold[of[right]]]
    n_positive = np.bincount(section[s], minlength=sections)

    # Entities in their random places, section by section.
    ents = np.flatnonzero(~is_relation)
    names = [table.column(c).take(pa.array(bounds[:-1])).to_pylist() for c in SECTION]
    heads = [f"{seed}|{pmid}|{location}" for pmid, location in zip(*names, strict=True)]
    digests = b"".join(
        hashlib.md5((f"{heads[i]}|{p}" if there else heads[i]).encode()).digest()
        for i, p, there in zip(section[ents].tolist(), pos[ents].tolist(), has_pos[ents].tolist(), strict=True)
    )
    high, low = np.frombuffer(digests, ">u8").reshape(-1, 2).T
    ents = ents[np.lexsort((pos[ents], low, high, section[ents]))]
    n = np.bincount(section[ents], minlength=sections)
    base = np.cumsum(n) - n

    # Pairs of entities at the same offsets, an entity with itself left out.
    spans = ents[np.lexsort((end[ents], start[ents], section[ents]))]
    new = np.ones(len(spans), bool)
    one, two = spans[:-1], spans[1:]
    new[1:] = (section[one] != section[two]) | (start[one] != start[two]) | (end[one] != end[two])
    size = np.diff(np.append(np.flatnonzero(new), len(spans)))
    same_span = np.bincount(section[spans[new]], weights=size * (size - 1.0), minlength=sections).astype(np.int64)

    keep = np.where(n_positive > 0, np.floor(n_positive * ratio), without_positives).astype(np.int64)
    n_look = np.where(n > 0, np.maximum(np.minimum(n * (n - 1), keep + n_positive + same_span), 0), 0)
    of, t = _spread(n_look)
    s_place = t % n[of]
    one, two = ents[base[of] + s_place], ents[base[of] + (s_place + 1 + t // n[of]) % n[of]]
    right = differ(one, two)

    # Pairs that are positive are told by their places in the list: entities that share a pos share the first one's.
    by_pos = np.lexsort((pos[ents], section[ents]))
    fresh = np.ones(len(ents), bool)
    a, b = ents[by_pos[:-1]], ents[by_pos[1:]]
    fresh[1:] = (section[a] != section[b]) | (pos[a] != pos[b])
    name = np.zeros(table.num_rows, np.int64)
    name[ents[by_pos]] = np.cumsum(fresh)
    named = has_pos[s] & has_pos[o]
    taken = name[s[named]] * (len(ents) + 1) + name[o[named]]
    right &= ~np.isin(name[one] * (len(ents) + 1) + name[two], taken)

    of, one, two = of[right], one[right], two[right]
    rank = np.arange(len(of)) - np.searchsorted(of, of)
    kept = rank < keep[of]
    s, o = np.concatenate([s, one[kept]]), np.concatenate([o, two[kept]])
    labels = np.concatenate([labels, np.zeros(int(kept.sum()), np.int64)])
    columns = {c: table.column(c).take(pa.array(s)) for c in SECTION}
    for short, rows in (("s", s), ("o", o)):
        columns |= {f"{short}_{c}": table.column(f"{c}{tail}").take(pa.array(rows)) for c, tail in (("pos", ""), ("start", "_idx"), ("end", "_idx"))}
    columns["label"] = pa.array([NO_RELATION, *PREDICATES]).take(pa.array(labels))
    return pa.table(columns)


def relation_examples(
    entities: DataFrame, relations: DataFrame, seed: int, ratio: float = 2.0, without_positives: int = 8
) -> DataFrame:
    """Labelled pairs for training: all positive ones and a sample of negative ones per section.

    (pmid, location, s_pos, s_start, s_end, o_pos, o_start, o_end, label). Positive pairs are as of positive_pairs. A
    section keeps int(ratio * positives) negatives, or up to `without_positives` when it has no positive pair.

    Negatives are drawn without forming all pairs. Entities get a random place 0..n-1; pair number t is entity
    t mod n with the one 1 + t div n places further on, which numbers the n(n-1) ordered pairs. Of the first
    keep + positives + same-span pairs at least `keep` are negative (or these are all pairs), so that many are
    looked at and the first `keep` negatives stay: linear in what is kept.

    Offsets of entities and relations meet once, by section; all else is done on sorted sections, many at a time.
    """
    entities = allowed_entities(entities)
    kinds = [entities.schema[c].dataType for c in ("pos", "start_idx", "end_idx")]
    big = {c: F.col(c).cast("bigint") for c in ("pos", "start_idx", "end_idx")}
    nothing = F.lit(None).cast("bigint")
    offsets = entities.select(
        *SECTION, F.lit(0).alias("kind"), *[column.alias(c) for c, column in big.items()],
        nothing.alias("other_start"), F.lit(0).cast("bigint").alias("code"),
    )
    listed = F.array_position(F.array(*[F.lit(p) for p in PREDICATES]), F.col("predicate"))
    gold = relations.filter("subject_start_idx is not null and object_start_idx is not null").select(
        "pmid", F.col("subject_location").alias("location"), F.lit(1).alias("kind"), big["pos"].alias("pos"),
        F.col("subject_start_idx").cast("bigint").alias("start_idx"), nothing.alias("end_idx"),
        F.col("object_start_idx").cast("bigint").alias("other_start"),
        F.when(F.col("pos").isNotNull(), F.coalesce(listed, F.lit(0))).otherwise(0).cast("bigint").alias("code"),
    )
    rows = offsets.unionByName(gold).filter("pmid is not null and location is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_unit(batches, SECTION):
            yield from _draw(table, seed, ratio, without_positives).to_batches()

    ends = [(f"{side}_{c}", kind) for side in ("s", "o") for c, kind in zip(("pos", "start", "end"), kinds, strict=True)]
    schema = ", ".join(["pmid string, location string", *[f"{name} bigint" for name, _ in ends], "label string"])
    drawn = rows.repartition(*SECTION).sortWithinPartitions(*SECTION).mapInArrow(run, schema)
    return drawn.select(*SECTION, *[F.col(name).cast(kind).alias(name) for name, kind in ends], "label")
