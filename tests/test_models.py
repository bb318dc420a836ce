import numpy as np
from pyspark.sql import functions as F

from spanloom.models import classifier as C
from spanloom.models.tagger import learn_gazetteer, tag_gazetteer, tag_with
from spanloom.operators.evaluate import argmax_class
from spanloom.plans import corpus as J
from spanloom.vocab import CLASSES

SECTIONS = "pmid string, location string, text string"
ENTITY = "pmid string, location string, pos int, start_idx int, end_idx int, text_span string, label string, uri string"


def test_gazetteer(spark):
    seen = [("gut flora", "microbiome"), ("gut flora", "microbiome"), ("gut flora", "food"), ("Gut", "food"),
            ("gut-brain axis", "DDF"), ("axis", "gene"), ("b", "drug"), ("b", "chemical")]
    train = spark.createDataFrame(seen, "text_span string, label string")
    gazetteer = learn_gazetteer(train)
    assert {r.surface: r.label for r in gazetteer.collect()} == {
        "gut flora": "microbiome", "gut": "food", "gut-brain axis": "DDF", "axis": "gene", "b": "chemical"}
    text = "Gut flora, the gut-brain axis; GUT  flora and axisb (b)."
    sections = spark.createDataFrame([("1", "title", text)], SECTIONS)
    got = sorted((r.start_idx, r.text_span, r.label) for r in tag_gazetteer(sections, gazetteer).collect())
    assert got == [(0, "Gut flora", "microbiome"), (15, "gut-brain axis", "DDF"), (31, "GUT", "food"), (53, "b", "chemical")]
    assert all(text[s:s + len(t)] == t for s, t, _ in got)


def test_tag_with_model(spark):
    def make():
        return lambda texts: [[(t.index("gut"), t.index("gut") + 3, "food")] if "gut" in t else [] for t in texts]

    sections = spark.createDataFrame([("1", "title", "the gut"), ("2", "title", "none")], SECTIONS)
    assert [tuple(r) for r in tag_with(sections, make).collect()] == [("1", "title", 4, 7, "gut", "food")]


def entities(spark):
    rows = []
    for p in range(30):
        rows += [(str(p), "title", 0, 0, 4, "drug", "drug", "u:1"), (str(p), "title", 1, 5, 8, "bug", "bacteria", "u:2"),
                 (str(p), "title", 2, 9, 12, "zzz", "statistical technique", "u:3")]
    return spark.createDataFrame(rows, ENTITY)


def test_candidates_follow_the_schema(spark):
    pairs = C.candidate_pairs(entities(spark)).select("subject_label", "object_label").distinct().collect()
    assert {tuple(r) for r in pairs} == {("drug", "bacteria"), ("bacteria", "drug")}


def test_classify_with_scores(spark):
    def make():
        def score(marked):
            out = np.zeros((len(marked), 18))
            for i, text in enumerate(marked):
                out[i, 6 if str(text).startswith("[E1]drug") else 0] = 1.0
            return out
        return score

    sections = spark.createDataFrame([(str(p), "title", "drug bug zzz") for p in range(30)], SECTIONS)
    marked = C.mark_pairs(C.candidate_pairs(entities(spark)), sections)
    got = C.classify_pairs(marked, make).groupBy("subject_label", "predicate").count().collect()
    assert {tuple(r) for r in got} == {("drug", "impact", 30), ("bacteria", "no_relation", 30)}


def test_argmax_takes_the_first(spark):
    rows = spark.createDataFrame([([0.0, 2.0, 2.0] + [0.0] * 15,)], "s array<double>")
    assert rows.select(argmax_class(rows.s)).first()[0] == CLASSES[1]


def test_default_learner(spark):
    ents = entities(spark)
    pairs = C.candidate_pairs(ents)
    labelled = pairs.selectExpr("*", "if(subject_label = 'drug', 'impact', 'no_relation') as label")
    model = C.train_classifier(labelled)
    got = C.apply_classifier(model, pairs).groupBy("subject_label", "predicate").count().collect()
    assert {tuple(r) for r in got} == {("drug", "impact", 30), ("bacteria", "no_relation", 30)}


def test_long_surfaces_are_tagged(spark):
    from spanloom.models.tagger import tag_gazetteer

    text = "see one two three four five six seven eight now"
    sections = spark.createDataFrame([("1", "title", text)], "pmid string, location string, text string")
    surfaces = spark.createDataFrame([("one two three four five six seven eight", "drug"), ("two", "gene")], "surface string, label string")
    assert [(r.start_idx, r.end_idx, r.label) for r in tag_gazetteer(sections, surfaces).collect()] == [(4, len(text) - 4, "drug")]


def test_gazetteer_of_any_length_equals_brute_force(spark):
    import random
    import re

    from spanloom.models import tagger

    rng = random.Random(5)
    words = ["gut", "the", "axis", "-", "b", "Flora"]

    def text(n):
        return "".join(rng.choice(words) + rng.choice([" ", "  ", "\n"]) for _ in range(n)).strip()

    texts = {str(k): text(400) for k in range(6)} | {"empty": "", "long": text(3000)}
    cut = [t[m.start():] for t in texts.values() for m in list(re.finditer(tagger.TOKEN, t))[::41]]
    surfaces = set()
    for t in cut:
        ends = [m.end() for m in re.finditer(tagger.TOKEN, t)]
        surfaces |= {t[:ends[n - 1]].lower() for n in (1, 3, 7, 8, 9, 12, 40, 2000) if n <= len(ends)}
    labels = {s: "drug" if len(s) % 2 else "food" for s in surfaces}
    found = []
    for key, t in texts.items():
        spans = [m.span() for m in re.finditer(tagger.TOKEN, t)]
        hits = [
            (s, spans[i + n - 1][1]) for i, (s, _) in enumerate(spans) for n in (1, 3, 7, 8, 9, 12, 40, 2000)
            if i + n <= len(spans) and t[s:spans[i + n - 1][1]].lower() in labels
        ]
        taken = []
        for s, e in sorted(hits, key=lambda h: (h[0] - h[1], h[0])):
            if all(e <= a or b <= s for a, b in taken):
                taken.append((s, e))
                found.append((key, s, e, t[s:e], labels[t[s:e].lower()]))
    assert any(len(f[3]) > 4000 for f in found)
    sections = spark.createDataFrame([(k, "title", t) for k, t in texts.items()], SECTIONS)
    gazetteer = spark.createDataFrame(list(labels.items()), "surface string, label string")
    got = tag_gazetteer(sections, gazetteer).drop("location")
    assert sorted(map(tuple, got.collect())) == sorted(found)


def test_frequent_tokens_are_dropped_or_spread(spark, monkeypatch):
    from spanloom.models import tagger as M

    sections = spark.createDataFrame([(str(i), "title", "Gut . . gut ! w%d gut flora ." % i) for i in range(40)], SECTIONS)
    gazetteer = spark.createDataFrame([("gut", "food"), ("gut flora", "microbiome"), ("w7", "gene")], "surface string, label string")
    joined = []
    monkeypatch.setattr(M, "SHARE_OF", 1)
    monkeypatch.setattr(M, "lookup_join", lambda rows, *a, real=M.lookup_join, **k: (joined.append((rows, k["hot"])), real(rows, *a, **k))[1])
    got = sorted((int(r.pmid), r.start_idx, r.text_span, r.label) for r in tag_gazetteer(sections, gazetteer).collect())
    want = [(i, 0, "Gut", "food") for i in range(40)] + [(i, 8, "gut", "food") for i in range(40)] + [(7, 14, "w7", "gene")]
    want += [(i, 15 + len(f"w{i}"), "gut flora", "microbiome") for i in range(40)]
    assert got == sorted(want)
    tokens, hot = joined[0]
    assert "gut" in {r.first for r in hot.collect()} <= {"gut", "w7"}
    assert tokens.filter("first in ('.', '!')").count() == 0


def test_only_related_pairs_are_stored(spark, monkeypatch):
    """Of classified pairs, those without a relation and columns that no relation reads are not staged."""
    kept = []
    monkeypatch.setattr(J, "apply_classifier", lambda model, pairs: pairs.withColumn(
        "predicate", F.when(F.col("subject_pos") < F.col("object_pos"), "target").otherwise("no_relation")))
    monkeypatch.setattr(J, "stage", lambda df: kept.append(df) or df)
    rows = [("1", "abstract", k, 5 * k, 5 * k + 4, f"word{k}", ["gene", "drug", "disease"][k % 3], f"u:{k}") for k in range(6)]
    ents = spark.createDataFrame(
        rows, "pmid string, location string, pos int, start_idx int, end_idx int, text_span string, label string, uri string")
    mentions, _ = J.predict_relations(ents, None)
    pairs = C.candidate_pairs(ents)
    assert 0 < mentions.count() == pairs.filter("subject_pos < object_pos").count() < pairs.count()
    assert kept[0].count() == mentions.count() and "subject_pos" not in kept[0].columns


def test_classifier_equals_its_own_transform(spark, monkeypatch):
    import random

    from pyspark.ml.feature import HashingTF

    rng = random.Random(4)
    rows = [
        ("1", "abstract", k, 3 * k + rng.randrange(3), 3 * k + 9, rng.choice(["Gut Flora", "É  ab", " aspirin", "x\ty z", "", "İß"]),
         rng.choice(["gene", "drug", "disease", "bacteria"]), "u") for k in range(60)
    ]
    ents = spark.createDataFrame(
        rows, "pmid string, location string, pos int, start_idx int, end_idx int, text_span string, label string, uri string")
    pairs = C.candidate_pairs(ents).localCheckpoint()
    model = C.train_classifier(pairs.selectExpr("*", "element_at(array('impact', 'no_relation', 'target'), int(subject_pos * object_pos % 3 + 1)) as label"))
    hashing, regression = model.stages[1:]
    terms = ["", "a", "ab", "abc", "abcd", "subject:É", "𝄞 gap:12", "object:zzzzzzz"]
    assert [C.term_index(t, 1000) for t in terms] == [HashingTF(numFeatures=1000).indexOf(t) for t in terms]
    want = regression.transform(hashing.transform(C.with_features(pairs))).groupBy("subject_pos", "object_pos", "guess").count()
    want = {(r.subject_pos, r.object_pos): CLASSES[int(r.guess)] for r in want.collect()}
    # No feature list is made per pair.
    monkeypatch.setattr(C, "with_features", None)
    got = C.apply_classifier(model, pairs)
    assert got.columns == [*pairs.columns, "predicate"]
    assert {(r.subject_pos, r.object_pos): r.predicate for r in got.collect()} == want and len(set(want.values())) > 1
