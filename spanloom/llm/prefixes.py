"""Prefix trie of conversations by collapsing whole sequences.

1. A turn is known by the SHA-256 of its role and text, a prefix by running sums over its turns' hashes (each turn's hash
   also covers its place, in six lanes of 32 bits, enough for 2 ** 31 turns). So prefixes of a conversation of any length
   come from running totals over range partitions; texts are read once and never move.
2. Conversations with equal last prefixes are one weighted sequence: its smallest conversation stands for it, and its end
   list is all of them. Sequences whose key is among the proper prefixes drop out by an anti-join; the rest are leaves.
3. The prefixes of the distinct sequences, weighted, add up to the nodes. Sums over subtrees are sums over the sequences
   through a node: of (members - 1) times words, the members' part is each sequence's remaining words times its weight.
   The part that counts a node once is given to its owner, the sequence with the smallest conversation through it. What a
   sequence owns is a suffix of its path, so one number a sequence says how much of it lies below any node it passes.

Rows are as many as turns, whatever the depth. A node that a third of all conversations pass is a partial sum in every task.
"""

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import running_total
from spanloom.operators.skew import hot_keys, lookup_join
from spanloom.staging import stage

WORD = r"[^\x20\x09-\x0D]+"
LANES = 6
FAMILY = 20
MOST_BORROWED = 3
#: Ids joined to one string before strings of a group meet.
IDS = 4096


def turn_digest() -> Column:
    """A turn's SHA-256; null role and text are empty. The role's length keeps role and text apart."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))


def _key(depth: Column, lanes: list[Column]) -> Column:
    return F.unhex(F.substring(F.sha2(F.concat_ws(",", depth.cast("string"), *(x.cast("string") for x in lanes)), 256), 1, 32))


def root_key() -> Column:
    return _key(F.lit(0), [F.lit(0)] * LANES)


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv, at, digest, words) per turn: its place in its conversation from 0, by turn (null first), then digest.

    Rows without conv_id belong to no conversation. Rows that repeat a turn are turns of their own. Runs jobs.
    """
    turns = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", turn_digest().alias("digest"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("words"), F.lit(1).alias("one"),
    )
    return running_total(turns, ["turn", "digest"], "one", "at", group="conv").drop("turn", "one")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv, n) and their turns (conv, n, at, digest, words), rebuilt with the head of their family's first.

    The first h turns of conversation c come from c - c % 20, where h is crc32(c) % 4, the rest are its own after its
    first h. A head holds three turns at most, and a family 20 conversations (39 around 0), so that join stays small.
    """
    turns = stage(turns)
    sizes = stage(turns.groupBy("conv").agg(F.count(F.lit(1)).alias("own")))
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % (MOST_BORROWED + 1)
    base = F.col("conv") - F.col("conv") % FAMILY
    heads = turns.filter(f"conv % {FAMILY} = 0 and at < {MOST_BORROWED}")
    lent = sizes.filter(f"conv % {FAMILY} = 0").select(F.col("conv").alias("base"), F.col("own").alias("lent"))
    convs = stage(
        sizes.withColumn("h", h).withColumn("base", base).join(lent, "base", "left")
        .withColumn("b", F.least("h", F.coalesce("lent", F.lit(0))))
        .withColumn("n", F.col("b") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
        .select("conv", "base", "h", "b", "n")
    )
    own = lookup_join(turns, convs.drop("base"), ["conv"]).filter("at >= h").withColumn("at", F.col("b") + F.col("at") - F.col("h"))
    borrowed = convs.join(heads.withColumnRenamed("conv", "base"), "base").filter("at < h")
    columns = ["conv", "n", "at", "digest", "words"]
    return convs.select("conv", "n"), own.select(*columns).unionByName(borrowed.select(*columns))


def _with_prefix_keys(turns: DataFrame) -> DataFrame:
    """Add depth, key and parent (key of the prefix one shorter) and `before`: words in the turns before. Runs a job."""
    lane = [f"lane{k}" for k in range(LANES)]
    own = F.sha2(F.concat(F.col("at").cast("string"), F.lit(":"), F.hex("digest")), 256)
    dealt = stage(
        turns.withColumn("own", own)
        .select("*", *(F.conv(F.substring("own", 8 * k + 1, 8), 16, 10).cast("long").alias(c) for k, c in enumerate(lane))).drop("own")
        .repartitionByRange("conv", "at").withColumn("part", F.spark_partition_id())
    )
    values = [*lane, "words"]
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy("part", "conv").agg(*(F.sum(v).alias(f"sum_{v}") for v in values)).select(
        "part", "conv", *(F.coalesce(F.sum(f"sum_{v}").over(earlier), F.lit(0)).alias(f"base_{v}") for v in values)
    )
    within = Window.partitionBy("part", "conv").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.select("*", *(F.coalesce(F.sum(v).over(within), F.lit(0)).alias(f"in_{v}") for v in values)).join(base, ["part", "conv"])
    before = {v: F.col(f"base_{v}") + F.col(f"in_{v}") for v in values}
    depth = F.col("at") + 1
    return sums.select(
        "conv", "n", depth.alias("depth"), "digest", "words", before["words"].alias("before"),
        _key(depth, [before[c] + F.col(c) for c in lane]).alias("key"), _key(F.col("at"), [before[c] for c in lane]).alias("parent"),
    )


def _joined_ids(most: int):
    """Sorted (key, conv) to (key, first, ids): up to `most` ids of a key in one string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []
        rows: list[tuple] = []
        for batch in batches:
            for k, conv in zip(batch.column("key").to_pylist(), batch.column("conv").to_pylist(), strict=True):
                if ids and (k != key or len(ids) == most):
                    rows.append((key, ids[0], ",".join(map(str, ids))))
                    ids = []
                key = k
                ids.append(conv)
            if rows:
                yield out(rows)
                rows = []
        if ids:
            yield out([(key, ids[0], ",".join(map(str, ids)))])

    def out(rows: list[tuple]) -> pa.RecordBatch:
        keys, firsts, texts = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(firsts, pa.int64()), pa.array(texts)], ["key", "first", "ids"])

    return run


def _hashed_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, first, ids) to (key, ends_sha256): a key's strings pass through one hash, none is kept."""
    key, state, done = None, None, []

    def out() -> pa.RecordBatch:
        names, hashes = zip(*done, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(hashes)], ["key", "ends_sha256"])

    for batch in batches:
        for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if k != key:
                if state:
                    done.append((key, state.hexdigest()))
                key, state = k, sha256(ids.encode())
            else:
                state.update(f",{ids}".encode())
        if done:
            yield out()
            done = []
    if state:
        done.append((key, state.hexdigest()))
        yield out()


def end_list_hashes(ends: DataFrame, most: int = IDS) -> DataFrame:
    """(key, ends_sha256) of the ascending, comma-joined conversations of each key. No list is ever whole in memory."""
    joined = ends.select("key", "conv").repartitionByRange("key", "conv").sortWithinPartitions("key", "conv")
    joined = joined.mapInArrow(_joined_ids(most), "key binary, first long, ids string")
    return joined.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_hashed_lists, "key binary, ends_sha256 string")


def weighted_sequences(convs: DataFrame, prefixes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Where each conversation ends (conv, key, n, total), and one row (key, first, weight, n, total) per distinct sequence."""
    ends = prefixes.filter("depth = n").select("conv", "key", "n", (F.col("before") + F.col("words")).alias("total"))
    ends = stage(ends.unionByName(convs.filter("n = 0").select("conv", root_key().alias("key"), "n", F.lit(0).cast("long").alias("total"))))
    return ends, stage(
        ends.groupBy("key", "n", "total").agg(F.min("conv").alias("first"), F.count(F.lit(1)).alias("weight"))
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations, the root included.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and digest:
    turn_digest() of the node's last turn (null at the root), by which texts can be looked up (node_texts). Equal turn
    numbers are ordered by digest; null conv_id rows are left out; without conversations there is no node, not even the
    root. Columns beyond conv_id, turn, role and text are not read. Runs jobs.
    """
    convs, turns = rebuilt(numbered_turns(conversations))
    prefixes = stage(_with_prefix_keys(turns))
    ends, sequences = weighted_sequences(convs, prefixes)

    proper = prefixes.filter("depth < n").select("key").union(convs.filter("n > 0").select(root_key().alias("key"))).distinct()
    leaves = sequences.join(proper, "key", "left_anti").select("first", F.lit(1).cast("long").alias("leaf"))
    known = stage(
        sequences.drop("key").join(leaves, "first", "left").withColumn("leaf", F.coalesce("leaf", F.lit(0))).withColumnRenamed("first", "conv")
    )
    paths = lookup_join(prefixes.drop("n"), known, ["conv"]).unionByName(
        known.select(
            "*", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("words"),
            F.lit(0).cast("long").alias("before"), root_key().alias("key"), F.lit(None).cast("binary").alias("parent"),
        )
    )
    paths = stage(paths)
    owners = paths.groupBy("key", "depth", "words").agg(F.min("conv").alias("conv"))
    owned = owners.groupBy("conv").agg(F.min("depth").alias("since"), F.sum("words").alias("owned"))
    rest = F.col("total") - F.col("before")
    nodes = stage(
        lookup_join(paths, owned, ["conv"], "left")
        .groupBy("key", "parent", "depth", "digest")
        .agg(
            F.min("conv").alias("conv_id"), F.sum("weight").alias("n_convs"), F.sum("leaf").alias("n_leaves"),
            F.sum(F.col("weight") * rest).alias("all"),
            F.sum(F.when(F.col("depth") >= F.col("since"), rest).otherwise(F.coalesce("owned", F.lit(0)))).alias("once"),
        )
    )
    children = nodes.filter("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    told = nodes.join(children, "key", "left").join(end_list_hashes(ends), "key", "left")
    return lookup_join(told, parents, ["parent"], "left", hot=hot_keys(nodes, ["parent"])).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves",
        (F.col("all") - F.col("once")).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        "digest",
    )


def node_texts(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """Nodes with role and text of their last turn (null role and text as empty; none at the root)."""
    turns = conversations.select(
        turn_digest().alias("digest"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).dropDuplicates(["digest"])
    return lookup_join(nodes, turns, ["digest"], "left")
