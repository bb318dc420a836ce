"""Phrase collocations by prefix-free parsing.

1. Texts are split in pieces of words, and pieces are cut where three words in a row hash to a trigger. A chunk's core runs
   from one cut to the next, and its words go on for three more (the trigger) as far as the piece does. Equal chunks of a
   language are one entry of the dictionary with their parse frequency: what texts share is cut alike and kept once.
2. Phrases of one to four words are counted in the entries, weighted by frequency. A phrase belongs to the chunk in whose
   core it begins, so overlaps count once and no phrase that crosses a cut is lost. A cut is also made where no trigger
   came for SEGMENT words and where a very long text is cut to windows; any cut gives the same counts.
3. A phrase is counted as a string only if its parts are frequent: pairs and triples of words are first counted by 64-bit
   hashes, and those that reach the least frequency are marked in a bit table of fixed size. What shares a bit or a hash by
   chance is counted in vain, nothing frequent is missed; the counts that are returned are of strings.

Counts are added up within a task before they move, and move as lists: a row holds what a task has of one part of the
hashes. The bit table is the only thing that reaches the driver.
"""

import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import chunks, give_back, mix, running_total, tidy, utf8
from spanloom.operators.skew import lookup_join
from spanloom.staging import stage

LONGEST = 4
OVERLAP = LONGEST - 1
LEAST = 30
FIRST = 2000
#: One in so many triples of words is a trigger.
TRIGGER = 16
SEGMENT = 256
WINDOW_BYTES = 1 << 20
#: 32 MB of bits for frequent words, pairs and triples.
TABLE_BITS = 1 << 28
#: Hashes that a task adds up before it sends their counts.
HELD = 1 << 22
#: Strings, which take more memory, that it adds up at a time.
HELD_STRINGS = 1 << 19
#: Bits of a hash that name the part it belongs to. A task sends what it has of a part as one row, and the parts are added up one by one.
PART_BITS = 12

_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[ord(c) for c in ".,;:!?"]] = 2
_KIND[0x0A:0x0E] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SOME = np.uint64(0xD6E8FEB86659FD93)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_KEPT = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]
_GAP = re.compile(rb"[\x20\x09.,;:!?\x0a-\x0d]")
_AHEAD = re.compile(rb"(?:[\x20\x09]*[^\x20\x09.,;:!?\x0a-\x0d]+){0,%d}" % OVERLAP)


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, row and piece (rising numbers) of each word of the rows."""
    kind = _KIND[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    word = kind == 0
    starts = np.flatnonzero(word & (edge[:-1] | np.concatenate(([True], ~word[:-1]))))
    ends = np.flatnonzero(word & (edge[1:] | np.concatenate((~word[1:], [True])))) + 1
    row = np.searchsorted(offsets, starts, "right") - 1
    piece = np.cumsum(kind == 2)[starts] + row if len(starts) else starts
    return starts, ends, row, piece


def _follow(values: np.ndarray, same: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The values k places on, and where those are in the same piece."""
    there = np.zeros(len(values), bool)
    out = np.zeros_like(values)
    if len(values) > k:
        out[:-k] = values[k:]
        there[:-k] = same[k:] == same[:-k]
    return out, there


def _cut(data: np.ndarray, offsets: np.ndarray, cores: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row, core (number of words) and words (joined by single spaces) of each chunk.

    cores: per row, the byte from which on words are only there for what begins before.
    """
    data = _LOWER[data]
    starts, ends, row, piece = _words(data, offsets)
    n = len(starts)
    core = starts < cores[row]
    if not core.any():
        return row[:0], row[:0], pa.array([], pa.string())
    hashes = _word_values(data, starts, ends)
    second, _ = _follow(hashes, piece, 1)
    third, full = _follow(hashes, piece, 2)
    trigger = full & (mix(mix(hashes * _SOME + second) * _SOME + third) % np.uint64(TRIGGER) == 0)
    begins = np.concatenate(([True], piece[1:] != piece[:-1]))
    cut = begins | trigger
    place = np.arange(n)
    since = place - np.maximum.accumulate(np.where(cut, place, 0))
    cut |= since % SEGMENT == 0
    cut[1:] |= ~core[1:] & core[:-1]
    first = np.flatnonzero(cut & core)
    after = np.append(np.flatnonzero(cut), n)
    stop = after[np.searchsorted(after, first, "right")]  # the next cut, at the core's end at the latest
    piece_end = np.append(np.flatnonzero(begins), n)
    until = np.minimum(stop + OVERLAP, piece_end[np.searchsorted(piece_end, first, "right")])
    # the bytes of all words of all chunks, each word followed by a space but the last
    count = until - first
    ahead = np.cumsum(count) - count
    of = np.repeat(first - ahead, count) + np.arange(int(count.sum()))
    length = ends[of] - starts[of] + 1
    length[ahead + count - 1] -= 1
    total = np.cumsum(length)
    at = np.repeat(starts[of] - (total - length), length) + np.arange(int(total[-1]))
    out = data[np.minimum(at, len(data) - 1)]
    spaces = np.delete(total - 1, ahead + count - 1)
    out[spaces] = 0x20
    bounds = np.concatenate(([0], total[ahead + count - 1])).astype(np.int32)
    return row[first], stop - first, pa.StringArray.from_buffers(len(first), pa.py_buffer(bounds), pa.py_buffer(out))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of an odd number and of its inverse modulo 2 ** 64; those for usual slices are kept."""
    if n > len(_KEPT[0]):
        size = max(n, 2 * WINDOW_BYTES)
        up, down = (np.multiply.accumulate(np.full(size, x, np.uint64)) for x in (_BASE, _INVERSE))
        if size > 2 * WINDOW_BYTES:
            return up, down
        _KEPT[:] = up, down
    return _KEPT[0], _KEPT[1]


def _word_values(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words, by their bytes alone: differences of one running polynomial, moved to a common place."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def _windows(text: bytes) -> Iterator[tuple[bytes, int]]:
    """Parts of a long text, each with the words that follow it, and where those begin."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + WINDOW_BYTES)
        end = gap.start() if gap else len(text)
        yield text[at : _AHEAD.match(text, end).end()], end - at
        at = end


def _parsed(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
    data, offsets = utf8(batch.column("text"))
    lang = batch.column("lang")
    for first, last in chunks(offsets, WINDOW_BYTES):
        part, bounds = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        if last - first > 1 or len(part) <= WINDOW_BYTES:
            row, core, words = _cut(part, bounds, bounds[1:])
            yield lang.take(pa.array(row + first)), words, core
            continue
        for window, end in _windows(part.tobytes()):
            row, core, words = _cut(np.frombuffer(window, np.uint8), np.array([0, len(window)]), np.array([end]))
            yield lang.take(pa.array(row + first)), words, core


@tidy
def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lang, words, core in _parsed(batch):
            if len(words):
                yield pa.RecordBatch.from_arrays([lang, words, pa.array(core.astype(np.int32))], ["lang", "words", "core"])


def parse_dictionary(docs: DataFrame) -> DataFrame:
    """(lang, words, core, times): each distinct chunk, how many words its core has and how often it was parsed."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    parsed = texts.mapInArrow(_parse, "lang string, words string, core int")
    return parsed.groupBy("lang", "words", "core").agg(F.count(F.lit(1)).alias("times"))


class _Phrases:
    """The phrases of some entries: values[n] are the hashes of n words from each word on, there[n] where they exist."""

    def __init__(self, langs: np.ndarray, data: np.ndarray, offsets: np.ndarray, core: np.ndarray, longest: int):
        self.starts, self.ends, self.row, _ = _words(data, offsets)
        first = np.searchsorted(self.row, np.arange(len(core)))
        self.core = np.arange(len(self.row)) - first[self.row] < core[self.row]
        words = _word_values(data, self.starts, self.ends)
        self.values, self.there = [words, mix(words ^ langs[self.row])], [None, np.ones(len(words), bool)]
        for n in range(2, longest + 1):
            last, there = _follow(words, self.row, n - 1)
            self.values.append(mix(self.values[-1] * _SOME + last))
            self.there.append(there)

    def made_of(self, n: int, table: np.ndarray) -> np.ndarray:
        """Where phrases of n words exist and both their parts of n - 1 words are marked."""
        bit = self.values[n - 1] & np.uint64(TABLE_BITS - 1)
        marked = (table[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)
        return self.there[n] & marked & _follow(marked, self.row, 1)[0]

    def marked(self, n: int, table: np.ndarray) -> np.ndarray:
        bit = self.values[n] & np.uint64(TABLE_BITS - 1)
        return self.there[n] & (table[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)

    def strings(self, at: np.ndarray, n: int, data: np.ndarray) -> pa.Array:
        begin, end = self.starts[at], self.ends[at + n - 1]
        bounds = np.concatenate(([0], np.cumsum(end - begin)))
        out = data[np.repeat(begin - bounds[:-1], end - begin) + np.arange(int(bounds[-1]))]
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(out))


def _entries(batch: pa.RecordBatch, longest: int = LONGEST) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, _Phrases]]:
    """Entries in slices with their phrases of up to `longest` words: languages, bytes, times, phrases."""
    data, offsets = utf8(batch.column("words"))
    core, times = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("core", "times"))
    lang = batch.column("lang").dictionary_encode()
    values = np.array([int.from_bytes(sha256(x.encode()).digest()[:8]) for x in lang.dictionary.to_pylist()], np.uint64)
    langs = values[lang.indices.to_numpy()]
    for first, last in chunks(offsets, WINDOW_BYTES):
        part, bounds = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        yield lang.slice(first, last - first), part, times[first:last], _Phrases(langs[first:last], part, bounds, core[first:last], longest)


def _sums(keys: list[np.ndarray], weights: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted keys and their summed weights: of weights of 1, which most are and whose keys need only be sorted, and of the others."""
    key, weight = np.concatenate(keys), np.concatenate(weights)
    once = weight == 1
    ones, rest, weight = np.sort(key[once]), key[~once], weight[~once]
    begin = np.flatnonzero(np.concatenate(([True], ones[1:] != ones[:-1]))) if len(ones) else np.zeros(0, np.int64)
    yield ones[begin], np.diff(np.append(begin, len(ones)))
    if len(rest):
        order = np.argsort(rest, kind="stable")
        rest, weight = rest[order], weight[order]
        begin = np.flatnonzero(np.concatenate(([True], rest[1:] != rest[:-1])))
        yield rest[begin], np.add.reduceat(weight, begin)


def _parts(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts that sorted hashes fall in, and where each begins and ends."""
    part = key >> np.uint64(64 - PART_BITS)
    begin = np.flatnonzero(np.concatenate((np.ones(min(len(part), 1), bool), part[1:] != part[:-1])))
    return part[begin].astype(np.int32), np.append(begin, len(key)).astype(np.int32)


def _sent(key: np.ndarray, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """A row for each part of sorted hashes, with lists of the columns beside them."""
    part, ends = _parts(key)
    return pa.RecordBatch.from_arrays([pa.array(part), *(pa.ListArray.from_arrays(ends, c) for c in columns.values())], ["part", *columns])


def _received(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of the columns of rows that come part by part; no part is in two tables."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        part = batch.column("part").to_numpy()
        lists = {name: batch.column(name) for name in batch.schema.names[1:]}
        size = np.diff(next(iter(lists.values())).offsets.to_numpy())
        flat = pa.table({"part": np.repeat(part, size), **{name: c.flatten() for name, c in lists.items()}})
        last = int(size[: np.searchsorted(part, part[-1])].sum())
        if held is not None and (last or held.column("part")[0].as_py() != part[-1]):
            yield pa.concat_tables([held, flat.slice(0, last)])
            held = None
        elif last:
            yield flat.slice(0, last)
        flat = flat.slice(last)
        held = flat if held is None else pa.concat_tables([held, flat])
    if held is not None:
        yield held


def _often_hashes(least: int):
    """The hashes whose counts add up to `least` or more."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _received(batches):
            key, weight = some.column("phrase").to_numpy(), some.column("times").to_numpy()
            order = np.argsort(key)
            key, weight = key[order], weight[order]
            begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            yield pa.RecordBatch.from_arrays([pa.array(key[begin][np.add.reduceat(weight, begin) >= least])], ["phrase"])

    return run


def _often_strings(least: int):
    """The phrases whose counts add up to `least` or more, with these."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _received(batches):
            one = _added(some)
            yield from one.filter(pc.greater_equal(one.column("times"), least)).to_batches()

    return run


def _added(some: pa.Table, *other: str) -> pa.Table:
    """Counts summed by phrase; other columns, which a phrase decides, stay."""
    one = some.group_by(["lang", "n", "phrase"]).aggregate([("times", "sum"), *((c, "min") for c in other)])
    return one.select(["lang", "n", "phrase", "times_sum", *(f"{c}_min" for c in other)]).rename_columns(["lang", "n", "phrase", "times", *other])


def _hash_counter(lengths: list[int], table: Broadcast | None):
    """Counts of hashed phrases of the given numbers of words, added up over HELD phrases at a time and sent by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(table.value, np.uint64) if table else None
        keys, weights, held = [], [], 0

        def out() -> Iterator[pa.RecordBatch]:
            for key, weight in _sums(keys, weights):
                if len(key):
                    yield _sent(key, {"phrase": pa.array(key.view(np.int64)), "times": pa.array(weight)})

        for batch in batches:
            for _, _, times, phrases in _entries(batch, max(lengths)):
                for n in lengths:
                    at = np.flatnonzero(phrases.core & (phrases.there[n] if bits is None else phrases.made_of(n, bits)))
                    keys.append(phrases.values[n][at])
                    weights.append(times[phrases.row[at]])
                    held += len(at)
                if held >= HELD:
                    yield from out()
                    keys, weights, held = [], [], 0
                    give_back()
        if held:
            yield from out()
        give_back()

    return run


def _string_counter(table: Broadcast):
    """Counts of phrases as strings, sent by part: those marked in the table, and of the longest those made of marked ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(table.value, np.uint64)
        tables, held = [], 0

        def out() -> pa.RecordBatch:
            one = _added(pa.concat_tables(tables), "hash")
            key = one.column("hash").to_numpy()
            order = np.argsort(key)
            one = one.drop_columns("hash").take(pa.array(order)).combine_chunks()
            return _sent(key[order], {name: one.column(name).combine_chunks() for name in one.column_names})

        for batch in batches:
            for lang, data, times, phrases in _entries(batch):
                for n in range(1, LONGEST + 1):
                    at = np.flatnonzero(phrases.core & (phrases.marked(n, bits) if n < LONGEST else phrases.made_of(n, bits)))
                    if not len(at):
                        continue
                    rows = pa.array(phrases.row[at])
                    some = [lang.take(rows).cast(pa.string()), pa.array(np.full(len(at), n, np.int32)), phrases.strings(at, n, data), pa.array(times[phrases.row[at]]), pa.array(phrases.values[n][at])]
                    # added up here at once: frequent words come again and again
                    tables.append(_added(pa.table(some, ["lang", "n", "phrase", "times", "hash"]), "hash"))
                    held += len(tables[-1])
                if held >= HELD_STRINGS:
                    yield out()
                    tables, held = [], 0
                    give_back()
        if held:
            yield out()
        give_back()

    return run


def _bit_table(counts: DataFrame) -> np.ndarray:
    """The marked hashes: at most TABLE_BITS / 64 rows reach the driver, whatever the corpus."""
    bit = F.col("phrase").bitwiseAND(TABLE_BITS - 1)
    rows = (
        counts.select(F.shiftright(bit, 6).alias("word"), F.expr("shiftleft(1L, cast(phrase & 63 as int))").alias("bit"))
        .groupBy("word").agg(F.expr("bit_or(bit)").alias("bits")).toArrow()
    )
    table = np.zeros(TABLE_BITS // 64, np.int64)
    table[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return table


def phrase_counts(dictionary: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, n, phrase, times) of every phrase of one to four words that occurs `least` times or more. Runs jobs."""
    context = dictionary.sparkSession.sparkContext

    def often_hashes(lengths: list[int], table: Broadcast | None) -> DataFrame:
        sent = dictionary.mapInArrow(_hash_counter(lengths, table), "part int, phrase array<long>, times array<long>")
        return _by_part(sent).mapInArrow(_often_hashes(least), "phrase long")

    table = _bit_table(often_hashes([1, 2], None))
    table |= _bit_table(often_hashes([3], context.broadcast(table.tobytes())))
    sent = dictionary.mapInArrow(
        _string_counter(context.broadcast(table.tobytes())), "part int, lang array<string>, n array<int>, phrase array<string>, times array<long>"
    )
    return stage(_by_part(sent).mapInArrow(_often_strings(least), "lang string, n int, phrase string, times long"))


def _by_part(sent: DataFrame) -> DataFrame:
    return sent.repartition("part").sortWithinPartitions("part")


def _part(first: str, length: str) -> Column:
    return F.expr(f"array_join(slice(split(phrase, ' '), {first}, {length}), ' ')")


def cut_scores(counts: DataFrame) -> DataFrame:
    """Per phrase of two words or more its lowest-scoring cut: lang, n, phrase, a, k, l, r, score.

    score is 2,000,000 a / (l + r), rounded down, in decimals of 38 digits.
    """
    cuts = (
        counts.filter("n > 1").select("lang", "n", "phrase", F.col("times").alias("a"), F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k"))
        .withColumn("head", _part("1", "k")).withColumn("rest", _part("k + 1", "n - k"))
    )
    for part, name in (("head", "l"), ("rest", "r")):
        known = counts.select("lang", F.col("phrase").alias(part), F.col("times").alias(name))
        cuts = lookup_join(cuts, known, ["lang", part])
    score = F.expr("cast(cast(2000000 as decimal(7, 0)) * cast(a as decimal(19, 0)) div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0))) as long)")
    lowest = cuts.withColumn("score", score).groupBy("lang", "n", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("low"))
    return lowest.select("lang", "n", "phrase", "a", "low.*")


def unshadowed(scored: DataFrame, counts: DataFrame) -> DataFrame:
    """Without phrases that lie inside a longer one which has four fifths of their count or more."""
    inside = counts.filter("n > 2").select(
        "lang", F.col("times").alias("longer"),
        F.explode(F.expr(
            "flatten(transform(sequence(2, n - 1), m -> transform(sequence(1, n - m + 1),"
            " s -> array_join(slice(split(phrase, ' '), s, m), ' '))))"
        )).alias("phrase"),
    )
    longest = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    covered = F.expr("100 * cast(longer as decimal(19, 0)) >= 80 * cast(a as decimal(19, 0))")
    return scored.join(longest, ["lang", "phrase"], "left").filter(~F.coalesce(covered, F.lit(False))).drop("longer")


def collocations(docs: DataFrame, least: int = LEAST, first: int = FIRST) -> DataFrame:
    """Each language's first phrases: lang, rank, phrase, a, l, r, n, score.

    By score, then a, both descending, then phrase by bytes. A null text is empty, a null lang `und`, together with texts
    whose lang is `und`. Repeated rows count again. A table without phrases that often gives no rows. Columns other than
    lang and text are not read. Ranks are running totals over range partitions: no language is sorted in one task. Runs jobs.
    """
    dictionary = stage(parse_dictionary(docs))
    words = dictionary.groupBy("lang").agg(F.sum(F.col("core") * F.col("times")).alias("n"))
    counts = phrase_counts(dictionary, least)
    told = unshadowed(cut_scores(counts), counts).drop("n", "k").withColumn("one", F.lit(1)).withColumn("down", -F.col("score")).withColumn("fewer", -F.col("a"))
    # Staged first, as dealing rows out by ranges reads them twice.
    ranked = running_total(stage(told), ["down", "fewer", "phrase"], "one", "before", group="lang").filter(F.col("before") < first)
    return ranked.join(words, "lang").select("lang", (F.col("before") + 1).alias("rank"), "phrase", "a", "l", "r", "n", "score")
