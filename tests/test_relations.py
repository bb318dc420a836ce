from collections import Counter

from spanloom.operators import nest as N
from spanloom.operators import relations as R
from spanloom.operators import reshape as S
from spanloom.operators import sampling as H
from spanloom.vocab import NO_RELATION, schema_triples

ENTITY = "pmid string, location string, pos int, start_idx int, end_idx int, label string, uri string, text_span string"
REL = (
    "pmid string, pos int, subject_location string, subject_start_idx int, subject_end_idx int, predicate string,"
    " object_location string, object_start_idx int, object_end_idx int"
)


def entities(spark, spans, pmid="1", location="abstract"):
    rows = [(pmid, location, i, s, e, "drug", f"u:{i}", f"t{i}") for i, (s, e) in enumerate(spans)]
    return spark.createDataFrame(rows, ENTITY)


def relations(spark, triples, pmid="1", location="abstract"):
    rows = [(pmid, i, location, s, s + 2, p, location, o, o + 2) for i, (s, p, o) in enumerate(triples)]
    return spark.createDataFrame(rows, REL)


def test_schema_sizes():
    triples = schema_triples()
    assert len(triples) == len({t[:3] for t in triples}) == 59
    defaults = [t for t in triples if t[3]]
    assert len(defaults) == len({(t[0], t[2]) for t in defaults}) == 54


def test_endpoints(spark):
    ents = entities(spark, [(0, 2), (5, 7), (5, 7)])
    rels = relations(spark, [(0, "target", 5), (0, "target", 9)])
    got = R.resolve_endpoints(rels.drop("pos"), ents).select("subject_pos", "object_pos").collect()
    assert sorted(tuple(r) for r in got) == [(0, 1), (0, 2)]


def test_last_gold_label_wins(spark):
    ents = entities(spark, [(0, 2), (5, 7)])
    rels = relations(spark, [(0, "target", 5), (0, "affect", 5), (5, "unheard of", 0)])
    assert [r.label for r in R.positive_pairs(ents, rels).collect()] == ["affect"]


def brute_pairs(spans, positive):
    return [
        (i, j) for i, a in enumerate(spans) for j, b in enumerate(spans)
        if i != j and a != b and (a[0], b[0]) not in positive
    ]


def test_negative_sampling_sizes(spark):
    cases = [
        ([(0, 2), (5, 7), (9, 11), (20, 22)], [(0, "target", 5), (5, "affect", 9), (0, "affect", 9)]),
        ([(0, 2), (5, 7), (9, 11), (20, 22), (30, 32)], []),
        ([(0, 2), (5, 7)], []),
        ([(0, 2), (0, 2), (5, 7), (5, 8)], [(0, "target", 5)]),
        ([(0, 2)], []),
        ([(0, 2), (0, 2), (0, 2)], []),
    ]
    for spans, rels in cases:
        ents = entities(spark, spans)
        got = H.relation_examples(ents, relations(spark, rels), seed=5).collect()
        positive = {(s, o) for s, _, o in rels}
        negatives = [(r.s_pos, r.o_pos) for r in got if r.label == NO_RELATION]
        possible = brute_pairs(spans, positive)
        n_positive = sum(r.label != NO_RELATION for r in got)
        limit = 2 * n_positive if n_positive else 8
        assert len(negatives) == len(set(negatives)) == min(limit, len(possible))
        assert set(negatives) <= set(possible)


def test_examples_shuffle_once(spark):
    ents = entities(spark, [(0, 2), (0, 2), (5, 7), (5, 8), (9, 11)])
    rels = relations(spark, [(0, "target", 5), (5, "unheard of", 9), (0, "affect", 9), (0, "impact", 9)])
    examples = H.relation_examples(ents, rels, seed=5)
    positive = Counter((r.s_pos, r.o_pos, r.label) for r in examples.collect() if r.label != NO_RELATION)
    gold = R.positive_pairs(ents, rels).collect()
    assert positive == Counter((r.s_pos, r.o_pos, r.label) for r in gold) and len(gold) == 6
    plan = H.relation_examples(ents, rels, seed=5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_complete_relations(spark):
    fields = "pmid string, subject_uri string, subject_label string, predicate string, object_uri string, object_label string"
    good = ("1", "u", "drug", "impact", "v", "bacteria")
    rows = [good, ("1", None, *good[2:]), ("1", "", *good[2:]), (*good[:5], "finding"), ("1", "u", "drug", None, "v", "food")]
    assert S.complete_relations(spark.createDataFrame(rows, fields)).count() == 1


def test_matrix_keeps_all_predicates(spark):
    ents = entities(spark, [(0, 2), (5, 7), (9, 11)])
    snapped = ents.withColumn("raw_start", ents.start_idx)
    rels = spark.createDataFrame(
        [("1", "abstract", 0, "u:0", p, 5, "u:1") for p in ("target", "affect", "target")] + [("1", "abstract", 0, "u:0", "affect", 77, "u:9")],
        "pmid string, location string, subject_start_idx int, subject_uri string, predicate string, object_start_idx int, object_uri string",
    )
    cells = R.matrix_cells(rels, snapped, ents).collect()
    assert sorted((r.s_token, r.o_token, r.predicate) for r in cells) == [(0, 5, "affect"), (0, 5, "target")]
    uri = {(r.object_uri, r.predicate): r.score for r in R.matrix_uri_cells(rels, snapped, ents).collect()}
    assert uri == {("u:1", "target"): 1.0, ("u:1", "affect"): 1.0, ("u:9", "affect"): 0.0}
    assert R.matrix_shape(ents).first().n_cells == 6 * 17


def test_concept_relations_need_two_uris(spark):
    fields = "pmid string, subject_uri string, subject_label string, predicate string, object_uri string, object_label string"
    rows = [("1", "u", "drug", p, o, "food") for p, o in (("impact", "v"), ("impact", "v"), ("impact", ""), ("impact", None), ("impact", "u"), (NO_RELATION, "v"))]
    assert R.concept_relations(spark.createDataFrame(rows, fields)).count() == 1


def test_long_lists_come_in_parts(spark):
    articles = spark.createDataFrame([("1",), ("2",), ("3",)], "pmid string")
    rows = [("1", f"u:{i}", "drug", "impact", "v", "food") for i in range(250)] + [("1", "u:x", "drug", "impact", "v", "food")] * 250 + [("2", "u", "drug", "impact", "v", "food")]
    rels = spark.createDataFrame(rows, "pmid string, subject_uri string, subject_label string, predicate string, object_uri string, object_label string")
    columns = ["subject_uri", "subject_label", "predicate", "object_uri", "object_label"]
    nested = N.nest_lists(articles, {"concept_level_relations": (rels, columns)}, part_items=100).collect()
    sizes = Counter()
    for r in nested:
        assert len(r.concept_level_relations) <= 100
        sizes[r.pmid] += len(r.concept_level_relations)
    assert sizes == {"1": 500, "2": 1, "3": 0}
    assert [r.part for r in nested if r.pmid == "2"] == [0]
    parts = sorted((r.part, [tuple(x) for x in r.concept_level_relations]) for r in nested if r.pmid == "1")
    assert [len(p) for _, p in parts] == [100] * 5
    assert sum((p for _, p in parts), []) == sorted(r[1:] for r in rows if r[0] == "1")


def test_short_lists_are_gathered_at_once(spark, monkeypatch):
    """Only articles with a long list are numbered; several lists, nulls in items and pmids, articles without rows or missing."""
    articles = spark.createDataFrame([("1",), ("2",), ("3",), ("3",), (None,)], "pmid string")
    few = spark.createDataFrame([("1", 2, None), ("1", 1, "b"), ("1", 1, "b"), ("4", None, "a"), (None, 7, "x")], "pmid string, a int, b string")
    many = spark.createDataFrame([("1", k) for k in range(5, 0, -1)] + [("2", 9)], "pmid string, c int")
    numbered = []
    parts_of = N._parts_of
    monkeypatch.setattr(N, "_parts_of", lambda rows, *args: numbered.append({r.pmid for r in rows.collect()}) or parts_of(rows, *args))
    lists = {"few": (few, ["a", "b"]), "many": (many, ["c"])}

    def got(part_items):
        return {(r.pmid, r.part): ([tuple(x) for x in r.few], [x.c for x in r.many]) for r in N.nest_lists(articles, lists, part_items).collect()}

    rest = {("2", 0): ([], [9]), ("3", 0): ([], []), ("4", 0): ([(None, "a")], []), (None, 0): ([], [])}
    assert got(5) == rest | {("1", 0): ([(1, "b"), (1, "b"), (2, None)], [1, 2, 3, 4, 5])}
    assert numbered == []
    assert got(4) == rest | {("1", 0): ([(1, "b"), (1, "b"), (2, None)], [1, 2, 3, 4]), ("1", 1): ([], [5])}
    assert numbered == [{"1"}, {"1"}]


def test_matrix_looks_each_start_up_once(spark, monkeypatch):
    snapped = spark.createDataFrame(
        [("1", "title", 0, 3, 4, 9), ("1", "title", 1, 12, 12, 20), ("1", "title", 2, 30, None, None)],
        "pmid string, location string, pos int, raw_start int, start_idx int, end_idx int",
    )
    nodes = snapped.filter("start_idx is not null")
    relations = spark.createDataFrame(
        [("1", "title", 3, 12, "treat"), ("1", "title", 3, 30, "treat"), ("1", "title", 3, 3, "treat")],
        "pmid string, location string, subject_start_idx int, object_start_idx int, predicate string",
    )
    joins, join = [], type(nodes).join
    monkeypatch.setattr(type(nodes), "join", lambda *a: joins.append(1) or join(*a))
    cells = R.matrix_cells(relations, snapped, nodes)
    assert [tuple(r) for r in cells.collect()] == [("1", "title", 4, 12, "treat", 1.0)]
    assert len(joins) == 3  # nodes to starts, starts to either end


def test_ner_training_set_snaps_once(spark, monkeypatch):
    from checks import queries as Q

    calls = []
    plain = Q.J.snap_entities
    monkeypatch.setattr(Q.J, "snap_entities", lambda *a: calls.append(1) or plain(*a))
    monkeypatch.setattr(Q.E, "snap_entities", lambda *a: calls.append(1) or plain(*a))
    assert Q.registry()["ner_training_set"](spark, "/root/testdata/sf0.001").count() > 0
    assert len(calls) == 1


def test_endpoints_and_offsets_in_two_joins(spark, monkeypatch):
    ents = entities(spark, [(0, 2), (5, 7), (5, 7), (9, 11), (20, 22)])
    cleaned = ents.filter("pos <> 3").selectExpr("pmid", "location", "pos", "start_idx - pos as start_idx", "end_idx + 1 as end_idx")
    rels = relations(spark, [(0, "target", 5), (5, "affect", 0), (5, "affect", 9), (20, "impact", 0), (7, "impact", 0)]).drop("pos")
    slow = R.refresh_offsets(R.refresh_offsets(R.resolve_endpoints(rels, ents), cleaned, "subject"), cleaned, "object")
    want = Counter(tuple(r[c] for c in sorted(slow.columns)) for r in slow.collect())
    joins, join = [], type(rels).join
    monkeypatch.setattr(type(rels), "join", lambda *a: joins.append(1) or join(*a))
    fast = R.resolve_fresh(rels, ents, cleaned)
    assert len(joins) == 3 and sorted(fast.columns) == sorted(slow.columns)
    assert Counter(tuple(r[c] for c in sorted(fast.columns)) for r in fast.collect()) == want and len(want) == 5
