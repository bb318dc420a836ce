import random
from collections import defaultdict

import pytest

from spanloom.operators import evaluate as G


def brute(gold, pred):
    out = defaultdict(lambda: [0, 0, 0])
    for p in pred:
        out[p[1]][0 if p in gold else 1] += 1
    for g in gold:
        out[g[1]][2] += g not in pred
    return {c: tuple(v) for c, v in out.items()}


def tables(spark, gold, pred):
    g = spark.createDataFrame(gold, "k string, label string")
    p = spark.createDataFrame([("m", *x) for x in pred], "model string, k string, label string")
    return g, p


def counts(spark, gold, pred):
    rows = G.score_classes(*tables(spark, gold, pred), ["k", "label"], "label").collect()
    return {r["class"]: (r.tp, r.fp, r.fn) for r in rows}


@pytest.mark.parametrize("gold, pred", [
    ([], [("a", "x")]),
    ([("a", "x")], [("a", "y")]),
    ([("a", "x")], [("a", "x"), ("a", "x"), ("b", "x")]),
    ([("a", "x"), ("a", "x"), ("b", "x")], [("c", "x")]),
    ([(None, "x")], [(None, "x"), ("a", "x")]),
])
def test_counts(spark, gold, pred):
    assert counts(spark, gold, pred) == brute(gold, pred)


def test_random_counts_and_summary(spark):
    rng = random.Random(1)

    def draw(n):
        return [(rng.choice("abcdef") if rng.random() < 0.9 else None, rng.choice("xyz")) for _ in range(n)]

    gold, pred = draw(30), draw(40)
    assert counts(spark, gold, pred) == brute(gold, pred)
    classes = G.score_classes(*tables(spark, gold, pred), ["k", "label"], "label")
    s = G.score_summary(classes).first()
    b = brute(gold, pred)
    tp, fp, fn = (sum(v[i] for v in b.values()) for i in range(3))
    assert s.micro_precision == pytest.approx(tp / (tp + fp))
    assert s.micro_recall == pytest.approx(tp / (tp + fn))
    per = [(2 * t / (2 * t + f + n)) if t else 0.0 for t, f, n in ((v[0], v[1], v[2]) for v in b.values())]
    for v in (s.micro_f1, s.macro_precision, s.macro_recall, s.macro_f1):
        assert 0 <= v <= 1
    assert len(per) == classes.count()


def test_model_without_predictions_scores_zero(spark):
    assert counts(spark, [("a", "x")], []) == {}
    models = spark.createDataFrame([("m",), ("n",)], "model string")
    classes = G.score_classes(*tables(spark, [("a", "x"), ("b", "x")], [("a", "x")]), ["k", "label"], "label", models)
    assert {r.model: (r.tp, r.fp, r.fn) for r in classes.collect()} == {"m": (1, 0, 1), "n": (0, 0, 2)}
    assert {r.model: r.micro_f1 for r in G.score_summary(classes).collect()}["n"] == 0


def test_classifier_counts_absent_classes(spark):
    rows = [("target", "target"), ("target", "no_relation"), ("no_relation", "affect")]
    got = G.score_classifier(spark.createDataFrame(rows, "label string, prediction string")).first()
    assert got.macro_f1 == pytest.approx((2 / 3) / 17)
    assert got.micro_f1 == pytest.approx(2 / (2 + 1 + 1))


def test_many_models_are_counted_without_a_join(spark, monkeypatch):
    rng = random.Random(6)
    gold = [(rng.choice("abc"), rng.choice("xy")) for _ in range(9)]
    pred = [(rng.choice([None, *range(40)]), rng.choice(["a", "b", None]), rng.choice("xyz")) for _ in range(400)]
    g = spark.createDataFrame(gold, "k string, label string")
    p = spark.createDataFrame(pred, "model int, k string, label string")
    monkeypatch.setattr(type(g), "join", None)
    for named in (None, [], [3, 99], range(40)):  # none, too few, one too many, more than are counted at a time
        models = None if named is None else spark.createDataFrame([(m,) for m in named], "model int")
        got = defaultdict(dict)
        for r in G.score_classes(g, p, ["k", "label"], "label", models).collect():
            got[r.model][r["class"]] = (r.tp, r.fp, r.fn)
        want = {}
        for m in {m for m, _, _ in pred} | set(named or []):
            want[m] = {c: (0, 0, 0) for _, c in gold} | brute(gold, [x[1:] for x in pred if x[0] == m])
        assert got == want
