import random
import tracemalloc

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from spanloom.operators import kb as K
from spanloom.operators import linking as L

KB = [
    ("u:brain", 0, 0, "Brain"), ("u:axis", 1, 0, "gut-brain axis"), ("u:neuron", 2, 0, " neuron "), ("u:bus", 3, 0, "bu"),
    ("u:late", 4, 0, "brain"), ("u:abc", 5, 0, "abc"), ("u:xyz", 6, 0, "xyz"), ("u:empty", 7, 0, "  "),
]


def index(spark):
    return K.surface_index(spark.createDataFrame(KB, "uri string, ord int, pos int, surface string"))


def test_index_first_concept_wins(spark):
    rows = {r.key: r.uri for r in index(spark).collect()}
    assert rows["brain"] == "u:brain" and "" not in rows and len(rows) == 6


def test_three_stages(spark):
    mentions = {
        "BRAIN\t": "u:brain", "neurons": "u:neuron", "the gut-brain axis model": "u:axis", "bus": "u:bus",
        "nothing": None, "xyz-abc": "u:abc", "brains": "u:brain",
    }
    df = spark.createDataFrame([(i, m) for i, m in enumerate(mentions)], "id int, text_span string")
    got = {r.text_span: r.uri for r in L.link_mentions(df, index(spark)).collect()}
    assert got == mentions


def test_three_letter_key_is_not_cut(spark):
    keys = spark.createDataFrame([("bus",), ("abcs",)], "key string")
    assert [tuple(r) for r in L.link_plural(keys, index(spark)).collect()] == [("abcs", "u:abc")]


def test_hot_mention_is_linked_everywhere(spark):
    hot = spark.range(3000).select(F.col("id"), F.when(F.col("id") < 2000, "neurons").otherwise("brain").alias("text_span"))
    got = L.link_mentions(hot, index(spark)).groupBy("uri").count().collect()
    assert {r.uri: r["count"] for r in got} == {"u:neuron": 2000, "u:brain": 1000}


def test_cosine_over_blocks_like_brute_force(spark, monkeypatch):
    monkeypatch.setattr(L, "MENTION_BLOCK", 7)
    monkeypatch.setattr(L, "CONCEPT_BLOCK", 5)
    rng = np.random.default_rng(0)
    m, c = rng.normal(size=(40, 8)), rng.normal(size=(23, 8))
    c[7] = c[3]
    c[9] = 0
    mentions = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "mention_id int, vector array<double>")
    concepts = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "concept_id int, vector array<double>")
    got = {r.mention_id: (r.concept_id, r.score) for r in L.link_cosine(mentions, concepts).collect()}
    norms = np.linalg.norm(c, axis=1)
    cos = np.round(m @ c.T / np.linalg.norm(m, axis=1)[:, None] / np.where(norms == 0, 1, norms), 6)
    assert got == {i: (int(cos[i].argmax()), cos[i].max()) for i in range(40)}


def test_trigrams_find_the_same_text(spark):
    keys = spark.createDataFrame([("gut flora",), ("neurons",)], "key string")
    concepts = spark.createDataFrame([("u:1", "gut flora"), ("u:2", "neuron"), ("u:3", "axis")], "uri string, key string")
    got = {r.key: (r.uri, r.score) for r in L.link_trigrams(keys, concepts).collect()}
    assert got["gut flora"] == ("u:1", 1.0)
    assert got["neurons"][0] == "u:2"


def test_trigrams_of_one_bucket_are_told_apart(spark):
    """Sixty-four words over few letters: the nearest concepts are those of brute force over unhashed trigrams."""
    rng = np.random.default_rng(3)
    words = sorted({"".join(rng.choice(list("abcde"), rng.integers(1, 9))) for _ in range(160)})
    concepts, mentions = [(f"u:{k:02}", w) for k, w in enumerate(words[::3])], [*words, "zzz"]
    grams = {w: [f" {w} "[k : k + 3] for k in range(len(w))] for w in {*mentions}}
    places = {g: k for k, g in enumerate(sorted({g for x in grams.values() for g in x}))}
    tf = {w: np.bincount([places[g] for g in x], minlength=len(places)) for w, x in grams.items()}
    idf = np.log((1 + len(tf)) / (1 + sum(v > 0 for v in tf.values()))) + 1
    unit = {w: v * idf / np.linalg.norm(v * idf) for w, v in tf.items()}
    cos = {m: np.round([unit[m] @ unit[w] for _, w in concepts], 6) for m in mentions}
    keys = spark.createDataFrame([(m,) for m in mentions], "key string")
    got = {r.key: (r.uri, round(r.score, 6)) for r in L.link_trigrams(keys, spark.createDataFrame(concepts, "uri string, key string")).collect()}
    assert got == {m: (concepts[int(c.argmax())][0], c.max()) for m, c in cos.items()}
    assert got["zzz"] == ("u:00", 0.0)


def test_substring_over_blocks_like_brute_force(spark, monkeypatch):
    monkeypatch.setattr(L, "KEY_CHARS", 300)
    monkeypatch.setattr(L, "SURFACE_CHARS", 40)
    rng = random.Random(4)

    def word(n):
        return "".join(rng.choice("ab\u00e9\U0001f9e0") for _ in range(n))

    surfaces = sorted({word(rng.randint(1, 6)) for _ in range(60)} | {"a b", " ab "})
    vocabulary = [(f"u:{i}", rng.randrange(5), i, s, len(s)) for i, s in enumerate(surfaces)]
    keys = sorted({word(rng.randint(1, 30)) for _ in range(120)} | {"xyz", "", "x a b y"})
    index = spark.createDataFrame(vocabulary, "uri string, ord int, pos int, key string, len int")
    got = {r.key: r.uri for r in L.link_substring(spark.createDataFrame([*[(k,) for k in keys], (None,)], "key string"), index).collect()}
    want = {}
    for key in keys:
        inside = [(-n, o, p, uri) for uri, o, p, s, n in vocabulary if s in key]
        if inside:
            want[key] = min(inside)[3]
    assert got == want and len(want) > 100
    assert L.link_substring(spark.createDataFrame([("a",)], "key string"), index.limit(0)).collect() == []
    assert L.link_substring(spark.createDataFrame([], "key string"), index).collect() == []


def test_substring_of_a_key_of_a_hundred_thousand_characters(spark):
    """With surfaces of 2,000 lengths, each substring as a row would be 200 million rows of up to 2,000 characters."""
    long = "".join(random.Random(1).choices("abcdefgh ", k=100_000))
    vocabulary = [(f"u:{n}", n, 0, long[n : 2 * n], n) for n in range(1, 2001)]
    index = spark.createDataFrame(vocabulary, "uri string, ord int, pos int, key string, len int")
    keys = spark.createDataFrame([(long,), (long[:3999],), ("z" * 100_000,)], "key string")
    got = {r.key: r.uri for r in L.link_substring(keys, index).collect()}
    assert got == {long: "u:2000", long[:3999]: "u:1999"}


def test_cosines_of_a_block_are_never_all_in_memory():
    vectors = np.random.default_rng(1).normal(size=(6000, 8))
    mentions = pd.DataFrame({"mention_id": np.arange(4096), "mention_vector": list(vectors[:4096])})
    concepts = pd.DataFrame({"concept_id": np.arange(1904), "concept_vector": list(vectors[4096:])})
    tracemalloc.start()
    got = L._nearest(mentions, concepts, None)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4096 * 1904 * 8 / 2
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    want = np.round(units[:4096] @ units[4096:].T, L.SCORE_DIGITS)
    assert got["mention_id"].tolist() == list(range(4096))
    assert got["concept_id"].tolist() == want.argmax(1).tolist() and np.allclose(got["score"], want.max(1), atol=2e-6)


def test_trigrams_of_blocks_form_no_pairs_outside_them(spark, monkeypatch):
    """Keys and concepts over several blocks, all sharing trigrams, with ties; only a row per key leaves a block."""
    monkeypatch.setattr(L, "MENTION_BLOCK", 40)
    monkeypatch.setattr(L, "CONCEPT_BLOCK", 8)
    monkeypatch.setattr(L, "TRIGRAM_KEYS_AT_ONCE", 7)
    keys = [(f"common{'abc'[k % 3]}{k % 50:02}",) for k in range(150)]
    concepts = [(f"u:{k:02}", f"common{'ab'[k % 2]}{k // 2:02}") for k in range(40)]
    frames = spark.createDataFrame([*keys, ("zzz",), ("",), (None,)], "key string"), spark.createDataFrame(
        [*concepts, (None, "commona00"), ("a:0", ""), ("a:1", None)], "uri string, key string")
    linked = L.link_trigrams(*frames)
    assert linked.count() == len({k for k, in keys}) + 1
    got = {r.key: (r.uri, r.score) for r in linked.collect()}
    assert got["commona00"] == ("u:00", 1.0) and got["zzz"] == ("u:00", 0.0)
    blocks = L._nearest_by_trigrams(
        pd.DataFrame({"key": ["x"], "key_grams": [["a", "b"]], "key_ws": [np.array([0.6, 0.8])]}),
        pd.DataFrame({"uri": ["u:2", "u:1", "u:0"], "uri_grams": [["b"], ["b"], ["c"]], "uri_ws": [np.ones(1)] * 3}),
    )
    assert blocks.to_dict("records") == [{"key": "x", "uri": "u:1", "score": 0.8}]
    assert L.link_trigrams(frames[0], frames[1].limit(0)).collect() == []


def test_terms_stay_where_they_are_when_there_are_few_trigrams(spark, monkeypatch):
    keys = spark.createDataFrame([("aspirin",), ("aspirins",), ("banana",)], "key string")
    want = {(r.key, r.gram, round(r.w, 9)) for r in L.trigram_weights(keys).collect()}
    calls = []
    join = L.lookup_join
    monkeypatch.setattr(L, "lookup_join", lambda *args, **named: calls.append(1) or join(*args, **named))
    L.trigram_weights(keys)
    assert not calls
    monkeypatch.setattr(L, "FEW_GRAMS", 3)
    assert {(r.key, r.gram, round(r.w, 9)) for r in L.trigram_weights(keys).collect()} == want and calls
