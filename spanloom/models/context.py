"""Relation classification of entity pairs within their text, without a row per pair that carries the text.

The entities of a section are dealt into blocks of about TILE; a unit is a pair of blocks, so a section of n entities has
some (n / TILE) ** 2 / 2 units, however many entities it holds. Units of a section are dealt into slots of about UNITS, and
its text is sent once to each slot. A task reads the text, then the units: it forms their pairs, marks them in the text and
scores them, a batch at a time. No pair is shuffled or stored before it is classified, and no slot holds more than about
2 * UNITS * TILE ** 2 ordered pairs.

An article whose sections are one block each is whole: one task gets all its rows. Where pairs are only counted in groups, a
task adds them up as codes, and what it returns of a whole article is final; only other articles' counts are added up over tasks.
"""

from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators.reshape import allowed_entities, pairable_sections
from spanloom.operators.skew import lookup_join
from spanloom.schemas import SECTION
from spanloom.staging import stage
from spanloom.vocab import CLASSES, NO_RELATION

TILE, UNITS = 1024, 1
# Pairs whose rows go out in one Arrow batch.
PAIRS_AT_ONCE = 4096
# Pairs that are counted at once, pairs held before they are added up, and groups that go out in one Arrow batch.
COUNTED_AT_ONCE, HELD, GROUPS_AT_ONCE = 1 << 15, 1 << 20, 1 << 14
ELLIPSIS = " … "

COLUMNS = ["pos", "start_idx", "end_idx", "text_span", "label", "uri"]
_ENTITY = "pos int, start_idx int, end_idx int, text_span string, label string, uri string"
_SIDES = ", ".join(f"{side}_{field.strip()}" for side in ("subject", "object") for field in _ENTITY.split(","))
PAIR = f"pmid string, location string, {_SIDES}, predicate string"

Scorer = Callable[[np.ndarray], np.ndarray]


def mark(text: str, subject: tuple[int, int], object_: tuple[int, int], window: int | None = None) -> str:
    """The text with [E1]..[/E1] round the subject and [E2]..[/E2] round the object.

    An overlapping later span is clipped to begin where the earlier one ends. With a window, only so many characters are
    kept on either side of each of the two; what is left out between them becomes ELLIPSIS.
    """
    (a, b), (c, d) = (subject, object_) if subject[0] <= object_[0] else (object_, subject)
    one, two = ("E1", "E2") if subject[0] <= object_[0] else ("E2", "E1")
    c = max(c, b)
    d = max(d, c)
    first, last, between = 0, len(text), text[b:c]
    if window is not None:
        first, last = max(0, a - window), d + window
        if c - b > 2 * window:
            between = f"{text[b : b + window]}{ELLIPSIS}{text[c - window : c]}"
    return f"{text[first:a]}[{one}]{text[a:b]}[/{one}]{between}[{two}]{text[c:d]}[/{two}]{text[d:last]}"


def _whole_and_cut(entities: DataFrame, sections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of entity_units, not dealt yet, of articles whose sections are one block each, and of the others. Stages the blocks."""
    inside = allowed_entities(entities).filter("start_idx is not null and end_idx is not null")
    texts = stage(
        pairable_sections(sections.select(*SECTION, "text"), inside)
        .withColumn("m", F.ceil(F.col("n_entities") / TILE).cast("long"))
        .withColumn("slots", F.ceil(F.col("m") * (F.col("m") + 1) / (2 * UNITS)).cast("long"))
    )
    sizes = texts.groupBy(*SECTION).agg(F.max("m").alias("m"), F.max("slots").alias("slots"))
    blocks = stage(
        lookup_join(inside.select(*SECTION, *COLUMNS), sizes, SECTION)
        .withColumn("block", F.pmod(F.xxhash64(*SECTION, "pos"), F.col("m")))
        .groupBy(*SECTION, "m", "slots", "block")
        .agg(F.collect_list(F.struct(*COLUMNS)).alias("items"))
    )
    large = stage(texts.filter("m > 1").select("pmid").distinct())

    def rows(texts: DataFrame, units: DataFrame, whole: bool) -> DataFrame:
        nothing = F.lit(None).cast(blocks.schema["items"].dataType)
        texts = texts.select(
            *SECTION, F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)).alias("slot"), F.lit(0).alias("kind"), "text",
            nothing.alias("left"), nothing.alias("right"),
        )
        units = units.select(*SECTION, "slot", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("text"), "left", "right")
        return texts.unionByName(units).withColumn("whole", F.lit(whole))

    alone = blocks.join(large, "pmid", "left_anti").withColumn("slot", F.lit(0).cast("long")).withColumn("left", F.col("items"))
    alone = alone.withColumn("right", F.lit(None).cast(blocks.schema["items"].dataType))
    blocks = blocks.join(large, "pmid", "left_semi")
    left = blocks.withColumnRenamed("items", "left").withColumn("other", F.explode(F.sequence("block", F.col("m") - 1)))
    right = blocks.select(*SECTION, F.col("block").alias("other"), F.col("items").alias("right"))
    units = left.join(right, [*SECTION, "other"]).select(
        *SECTION, F.pmod(F.xxhash64("block", "other"), F.col("slots")).alias("slot"), "left",
        F.when(F.col("block") != F.col("other"), F.col("right")).alias("right"),
    )
    return rows(texts.join(large, "pmid", "left_anti"), alone, True), rows(texts.join(large, "pmid", "left_semi"), units, False)


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows of a whole article in one task, of others a slot in one; texts first."""
    rows = rows.withColumn("deal", F.when(F.col("whole"), F.lit(0).cast("long")).otherwise(F.xxhash64("location", "slot")))
    return rows.repartition("pmid", "deal").sortWithinPartitions("pmid", "deal", *SECTION[1:], "slot", "kind", "text")


def entity_units(entities: DataFrame, sections: DataFrame) -> DataFrame:
    """(pmid, location, slot, kind, text, left, right, whole, deal): per slot a row of kind 0 with the text, then its units of kind 1.

    Sections without text, or with fewer than two allowed entities, have none. Entities lacking an offset, pmid or
    location are left out. Stages the blocks.
    """
    whole, cut = _whole_and_cut(entities, sections)
    return _dealt(whole.unionByName(cut))


def _ordered_pairs(spans: np.ndarray, n_left: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs whose offsets differ: within left, or, where more follows it, between left and the rest in both orders."""
    left = np.arange(n_left)
    right = left if n_left == len(spans) else np.arange(n_left, len(spans))
    differ = (spans[left][:, None] != spans[right][None]).any(axis=2)
    subject, object_ = (side[at] for side, at in zip((left, right), np.nonzero(differ), strict=True))
    if n_left == len(spans):
        return subject, object_
    return np.concatenate([subject, object_]), np.concatenate([object_, subject])


def marks(
    text: str, spans: list[tuple[int, int]], subject: np.ndarray, object_: np.ndarray, window: int | None = None
) -> Iterator[str]:
    """The marked text of each pair, by the places of its spans, as of mark.

    Of spans more than two windows apart the text keeps what is round either of them, which is cut once a span.
    """
    if window is None:
        for k in range(0, len(subject), PAIRS_AT_ONCE):
            for s, o in zip(subject[k : k + PAIRS_AT_ONCE].tolist(), object_[k : k + PAIRS_AT_ONCE].tolist(), strict=True):
                yield mark(text, spans[s], spans[o])
        return
    start, end = np.array(spans).T
    in_order = start[subject] <= start[object_]
    gap = np.where(in_order, start[object_] - end[subject], start[subject] - end[object_])
    heads, tails = {}, {}
    for name in ("E1", "E2"):
        heads[name] = [f"{text[max(0, a - window):a]}[{name}]{text[a:b]}[/{name}]{text[b : b + window]}{ELLIPSIS}" for a, b in spans]
        tails[name] = [
            f"{text[c - window : c]}[{name}]{text[c:d]}[/{name}]{text[d : d + window]}" for c, d in ((c, max(c, d)) for c, d in spans)
        ]
    (head_1, head_2), (tail_1, tail_2) = heads.values(), tails.values()
    for k in range(0, len(subject), PAIRS_AT_ONCE):
        some = (x[k : k + PAIRS_AT_ONCE].tolist() for x in (subject, object_, in_order, gap > 2 * window))
        for s, o, first, far in zip(*some, strict=True):
            if not far:
                yield mark(text, spans[s], spans[o], window)
            elif first:
                yield head_1[s] + tail_2[o]
            else:
                yield head_2[o] + tail_1[s]


class _Pairs:
    """Classified pairs as rows with the columns of `schema`."""

    def __init__(self, schema: pa.Schema):
        self.schema = schema

    def add(self, items: list[dict], subject: np.ndarray, object_: np.ndarray, code: np.ndarray) -> Iterator[pa.RecordBatch]:
        ends = {"subject": pa.array(subject), "object": pa.array(object_)}
        out = []
        for c in self.schema.names:
            side, _, field = c.partition("_")
            if c == "predicate":
                out.append(pa.array(CLASSES).take(pa.array(code)))
            else:
                at, name = (ends[side], field) if side in ends else (ends["subject"], c)
                out.append(pa.array([item[name] for item in items], self.schema.field(c).type).take(at))
        yield pa.RecordBatch.from_arrays(out, schema=self.schema)

    def full(self) -> bool:
        return False

    def rows(self) -> Iterator[pa.RecordBatch]:
        return iter(())


class _Counts:
    """Classified pairs counted by groups of columns; a pair is a number made of the codes of its ends and its class until rows go out."""

    def __init__(self, schema: pa.Schema, groups: list[list[str]], totals: list[str]):
        self.schema, self.groups, self.totals = schema, groups, totals
        self.left = [[c for c in by if not c.startswith("object_") and c != "predicate"] for by in groups]
        self.right = [[c for c in by if c.startswith("object_")] for by in groups]
        self.clear()

    def clear(self) -> None:
        self.names: list[tuple[dict, dict]] = [({}, {}) for _ in self.groups]
        self.held: list[list[tuple]] = [[] for _ in self.groups]
        self.pairs = self.loose = 0

    def add(self, items: list[dict], subject: np.ndarray, object_: np.ndarray, code: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = {"subject": subject, "object": object_}

        def codes(names: dict, columns: list[str]) -> np.ndarray:
            fields = [c.removeprefix("subject_").removeprefix("object_") for c in columns]
            return np.array([names.setdefault(tuple([item[f] for f in fields]), len(names)) for item in items], np.int64)

        ends = [(c.partition("_")[2], at[c.partition("_")[0]]) for c in self.totals]
        totals = [np.array([item[field] for item in items], np.int64)[place] for field, place in ends]
        for by, names, held, left, right in zip(self.groups, self.names, self.held, self.left, self.right, strict=True):
            key = codes(names[0], left)[subject] << 32 | codes(names[1], right)[object_] << 5
            held.append((key | code if "predicate" in by else key, np.ones(len(key), np.int64), *totals))
        self.pairs += len(code)
        self.loose += len(code)
        if self.loose >= HELD:
            self.held = [[self._added_up(held)] for held in self.held]
            self.loose = 0
        return iter(())

    @staticmethod
    def _added_up(held: list[tuple]) -> tuple:
        key, *numbers = (np.concatenate(x) for x in zip(*held, strict=True))
        if not len(key):
            return key, *numbers
        order = np.argsort(key, kind="stable")
        key = key[order]
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        return key[begin], *(np.add.reduceat(x[order], begin) for x in numbers)

    def full(self) -> bool:
        return self.pairs >= HELD

    def rows(self) -> Iterator[pa.RecordBatch]:
        for number, held in enumerate(self.held):
            if not held:
                continue
            keys, *numbers = self._added_up(held)
            ends = [
                {c: pa.array(values, self.schema.field(c).type) for c, values in zip(columns, zip(*names, strict=True))}
                for columns, names in zip((self.left[number], self.right[number]), self.names[number], strict=True)
            ]
            for at in range(0, len(keys), GROUPS_AT_ONCE):
                some = slice(at, at + GROUPS_AT_ONCE)
                left, right, code = (pa.array(x) for x in (keys[some] >> 32, keys[some] >> 5 & (1 << 27) - 1, keys[some] & 31))
                out = {c: values.take(place) for end, place in zip(ends, (left, right), strict=True) for c, values in end.items()}
                if "predicate" in self.groups[number]:
                    out["predicate"] = pa.array(CLASSES).take(code)
                out["number"] = pa.array(np.full(len(left), number, np.int32))
                out |= {c: pa.array(x[some]) for c, x in zip(_numbers(self.totals), numbers, strict=True)}
                yield pa.RecordBatch.from_arrays([out.get(f.name, pa.nulls(len(left), f.type)) for f in self.schema], schema=self.schema)
        self.clear()


def _numbers(totals: list[str]) -> list[str]:
    return ["n", *[f"sum_{c}" for c in totals]]


def _classifier(make_scorer: Callable[[], Scorer], batch_size: int, window: int | None, related_only: bool, at_once: int, make_use: Callable):
    """A function over the rows of entity_units that hands classified pairs, at_once at a time, to what make_use() returns.

    That takes the entities of the pairs at hand, the places of both ends among them and the classes. What it has added up
    goes out when it is full, between whole articles or between slots of others, and at the end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, use, place, text = make_scorer(), make_use(), None, None
        marked: list[str] = []
        items: list[dict] = []  # entities of the pairs at hand
        subjects: list[np.ndarray] = []
        objects: list[np.ndarray] = []
        codes: list[np.ndarray] = []

        def classify() -> None:
            codes.append(np.asarray(score(np.array(marked, object))).argmax(1))
            marked.clear()

        def classified() -> Iterator[pa.RecordBatch]:
            if not subjects:
                return
            if marked:
                classify()
            code = np.concatenate(codes)
            kept = np.arange(len(code)) if not related_only else np.flatnonzero(code != CLASSES.index(NO_RELATION))
            yield from use.add(items, np.concatenate(subjects)[kept], np.concatenate(objects)[kept], code[kept])
            for held in (items, subjects, objects, codes):
                held.clear()

        for batch in batches:
            for row in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                here = row["pmid"], row["location"], row["slot"]
                if row["kind"] == 0:
                    if place and here != place and (here[0] != place[0] or not row["whole"]) and use.full():
                        yield from classified()
                        yield from use.rows()
                    if here != place:
                        place, text = here, row["text"]
                    continue
                if here != place:
                    continue  # a section without text
                at = {"pmid": here[0], "location": here[1]}
                unit = [at | item for item in row["left"] + (row["right"] or [])]
                spans = [(item["start_idx"], item["end_idx"]) for item in unit]
                subject, object_ = _ordered_pairs(np.array(spans), len(row["left"]))
                if not len(subject):
                    continue
                texts = marks(text, spans, subject, object_, window)
                first, done, waiting = len(items), 0, sum(map(len, subjects))
                items += unit
                while done < len(subject):
                    some = slice(done, done + at_once - waiting)
                    subjects.append(first + subject[some])
                    objects.append(first + object_[some])
                    for one in islice(texts, len(subjects[-1])):
                        marked.append(one)
                        if len(marked) == batch_size:
                            classify()
                    done += len(subjects[-1])
                    if waiting + len(subjects[-1]) >= at_once:
                        yield from classified()
                        if done < len(subject):
                            first, waiting = 0, 0
                            items += unit
        yield from classified()
        yield from use.rows()

    return run


def classify_in_context(
    entities: DataFrame, sections: DataFrame, make_scorer: Callable[[], Scorer], batch_size: int = 32,
    window: int | None = None, related_only: bool = True, columns: list[str] | None = None, by: list[str] | None = None,
    totals: list[str] | None = None,
) -> DataFrame:
    """Ordered pairs of allowed entities of a section with the `predicate` of highest score.

    `make_scorer` is called once per task and returns a function from an array of marked texts to an array (batch, 18) of
    scores; the first highest decides. All label pairs are classified. With `related_only`, pairs of class no_relation are
    not returned. `window` as in mark; by default the scorer sees the whole section. Of sections that repeat a key, the
    text that comes first by its characters is used. `columns` names those of PAIR to return, all by default: entities are
    described once a unit, and a pair takes its columns from there. With `by` (and `totals`) the pairs are counted as by
    count_in_context, and `columns` is not used.
    """
    if by is not None:
        return count_in_context(entities, sections, make_scorer, [by], totals, batch_size, window, related_only)[0]
    kinds = dict(c.split() for c in PAIR.split(", "))
    columns = list(kinds) if columns is None else columns
    schema = pa.schema([(c, pa.int32() if kinds[c] == "int" else pa.string()) for c in columns])
    run = _classifier(make_scorer, batch_size, window, related_only, PAIRS_AT_ONCE, lambda: _Pairs(schema))
    return entity_units(entities, sections).mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in columns))


def count_in_context(
    entities: DataFrame, sections: DataFrame, make_scorer: Callable[[], Scorer], groups: list[list[str]], totals: list[str] | None = None,
    batch_size: int = 32, window: int | None = None, related_only: bool = True,
) -> list[DataFrame]:
    """The pairs of classify_in_context counted: for each list of columns in `groups`, its groups with their number `n`.

    Columns are those of PAIR and hold the pmid. `totals` are offsets, whose sums stand in `sum_` and their name. Each pair is
    classified once. Counts of whole articles come out of the tasks complete; those of articles cut into slots are added up.
    With several lists the counts are staged.
    """
    kinds = dict(c.split() for c in PAIR.split(", "))
    totals = totals or []
    if any("pmid" not in by for by in groups):
        raise ValueError("each list of columns must hold pmid")
    columns = list(dict.fromkeys(c for by in groups for c in by))
    numbers = _numbers(totals)
    schema = pa.schema([
        ("number", pa.int32()), *[(c, pa.int32() if kinds[c] == "int" else pa.string()) for c in columns], *[(c, pa.int64()) for c in numbers]
    ])
    fields = ", ".join(["number int", *[f"{c} {kinds[c]}" for c in columns], *[f"{c} long" for c in numbers]])
    run = _classifier(make_scorer, batch_size, window, related_only, COUNTED_AT_ONCE, lambda: _Counts(schema, groups, totals))
    whole, cut = (_dealt(rows).mapInArrow(run, fields) for rows in _whole_and_cut(entities, sections))
    if len(groups) > 1:
        both = stage(whole.withColumn("whole", F.lit(True)).unionByName(cut.withColumn("whole", F.lit(False))))
        whole, cut = both.filter("whole"), both.filter("not whole")
    out = []
    for number, by in enumerate(groups):
        final, parts = (rows.filter(F.col("number") == number).select(*by, *numbers) for rows in (whole, cut))
        out.append(final.unionByName(parts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in numbers])))
    return out
