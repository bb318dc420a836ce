"""Phrases beside brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from spanloom.llm import phrases
from spanloom.llm.phrases import _cut, _often_hashes, _received, _sent, _windows, collocations, parse_dictionary

DOCS = "doc_id long, text string, lang string, words string, n int, phrase string, times string"
PIECES = re.compile(r"[.,;:!?\x0a-\x0d]")


def table() -> list[tuple]:
    rng = random.Random(5)
    vocabulary = [f"{chr(97 + k % 26)}{k}" for k in range(30)] + ["É", "ß", "日本", "\xa0", "\x1c", "　x"]
    stock = [[rng.choice(vocabulary) for _ in range(n)] for n in (3, 4, 5, 30, 700)]
    out = []
    for k in range(140):
        parts = []
        for _ in range(rng.choice([1, 3, 8])):
            parts += rng.choice(stock[:4]) if rng.random() < 0.5 else [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 9, 40]))]
            parts.append(rng.choice([".", ",", " ", "\t\t", "\n", "!?", " : "]))
        text = " ".join(parts)
        out.append((k, text.upper() if k % 5 == 0 else text, [None, "en", "de", "en", "und"][k % 5]))
    out += [(k, " ".join(stock[4]), "fr") for k in range(40)]  # long repeated passage without stops
    out += [(500, None, "en"), (501, "", "en"), (502, " .\t, ", None), (503, "lone", "xx"), (504, "a b " * 20_000, "en"), (505, "z " * 9_000, "de"), (506, "q" * 70_000, "de")]
    out += out[:9]
    return [(*r, "w", 1, "p", "t") for r in out]


def counted(rows):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        text = (text or "").translate({k: k + 32 for k in range(65, 91)})
        for piece in PIECES.split(text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for m in range(1, 5):
                f[lang or "und"].update(tuple(w[s : s + m]) for s in range(len(w) - m + 1))
    return f, n


def expected(rows, least, first):
    f, n = counted(rows)
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if a >= least}
        longer = Counter()
        for p, a in often.items():
            for m in range(2, len(p)):
                for s in range(len(p) - m + 1):
                    longer[p[s : s + m]] = max(longer[p[s : s + m]], a)
        scored = []
        for p, a in often.items():
            if len(p) > 1 and not 100 * longer[p] >= 80 * a:
                score, k, l, r = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(scored)[:first], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return out


@pytest.mark.parametrize(("least", "first"), [(30, 2000), (4, 2000), (4, 7)])
def test_same_as_brute_force(spark, least, first):
    rows = table()
    got = collocations(spark.createDataFrame(rows, DOCS).repartition(5), least, first)
    assert sorted(tuple(r) for r in got.collect()) == sorted(expected(rows, least, first))
    assert got.schema["rank"].dataType.simpleString() == "bigint"


@pytest.mark.parametrize("settings", [{}, {"TRIGGER": 2}, {"TRIGGER": 1 << 40, "SEGMENT": 5}, {"WINDOW_BYTES": 40}, {"WINDOW_BYTES": 1, "TRIGGER": 3}])
def test_any_cut_counts_the_same(settings, monkeypatch):
    for name, value in settings.items():
        monkeypatch.setattr(phrases, name, value)
    for _, text, *_ in table()[:60:7] + table()[150:152] + table()[180:185]:
        data = (text or "").encode()[:30_000].decode(errors="ignore").encode()
        seen, want = Counter(), counted([(0, data.decode(), "x")])[0]["x"]
        for window, end in _windows(data):
            _, core, words = _cut(np.frombuffer(window, np.uint8), np.array([0, len(window)]), np.array([end]))
            for chunk, own in zip(words.to_pylist(), core.tolist(), strict=True):
                w = chunk.split(" ")
                assert 1 <= own <= len(w) <= own + 3
                for m in range(1, 5):
                    seen.update(tuple(w[s : s + m]) for s in range(min(own, len(w) - m + 1)))
        assert seen == want


def test_shared_passages_are_kept_once(spark):
    rows = table()
    entries = parse_dictionary(spark.createDataFrame(rows, DOCS)).collect()
    assert sum(e.core * e.times for e in entries) == sum(counted(rows)[1].values())
    french = [e for e in entries if e.lang == "fr"]
    assert sum(e.core for e in french) < 750 and max(e.times for e in french) >= 40


def test_empty_table(spark):
    assert collocations(spark.createDataFrame([], DOCS)).collect() == []


def test_counts_move_as_lists(spark, monkeypatch):
    made = []
    monkeypatch.setattr(phrases, "_by_part", lambda sent, f=phrases._by_part: made.append(sent) or f(sent))
    monkeypatch.setattr(phrases, "PART_BITS", 1)
    rows = table()
    got = collocations(spark.createDataFrame(rows, DOCS).repartition(5), 4)
    assert sorted(tuple(r) for r in got.collect()) == sorted(expected(rows, 4, 2000))
    assert len(made) == 3 and all("array<" in sent.schema.simpleString() for sent in made)


def test_parts_are_whole_however_rows_are_batched():
    rng = np.random.default_rng(3)
    keys = [np.sort(rng.choice(np.arange(1, 400, dtype=np.uint64) << np.uint64(55), n, replace=False)) for n in (1, 300, 250, 399, 7)]
    sent = pa.Table.from_batches([_sent(k, {"phrase": pa.array(k.view(np.int64)), "times": pa.array(np.arange(len(k)))}) for k in keys]).sort_by("part")
    want = Counter()
    for k in keys:
        want.update(dict(zip(k.view(np.int64).tolist(), range(len(k)))))
    for size in (1, 2, 5, 10_000):
        batches = sent.combine_chunks().to_batches(max_chunksize=size)
        parts = [set(t.column("part").to_pylist()) for t in _received(iter(batches))]
        assert sum(map(len, parts)) == len(set().union(*parts))
        got = [x for b in _often_hashes(100)(iter(batches)) for x in b.column("phrase").to_pylist()]
        assert sorted(got) == sorted(k for k, n in want.items() if n >= 100)
