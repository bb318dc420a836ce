"""Exact duplicates beside brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from spanloom.llm.exact import distinct_documents, exact_duplicates

DOCS = "doc_id long, text string, lang string, hash string, body string, best int, row string"
WHITE = re.compile(r"[\x20\x09-\x0D]")


def rows() -> list[tuple]:
    texts = [
        "one two", "onetwo", " one\ttwo ", "One two", "", None, " \n\x0b\x0c\r", "\x1c", " ", "　a", "a　", "é 1", "é1 ", "𝒳 y", "𝒳y  ",
        "x" * 200_000, "x " * 200_000, "=", "= ",
    ]
    out = [(k, t) for k, t in enumerate(texts)] + [(100 + k, "hot  copy" + " " * (k % 7)) for k in range(300)]
    out += [(3, "One two"), (3, "One two"), (3, "One  two"), (None, "One two"), (None, "alone"), (None, "alone"), (-5, "one two"), (2**63 - 1, "big"), (-(2**63), "big")]
    return [(i, t, None, "h", "b", k, "r") for k, (i, t) in enumerate(out)]


def expected(table: list[tuple]) -> Counter:
    groups = defaultdict(list)
    for r in table:
        groups[WHITE.sub("", r[1] or "")].append((-len(r[1] or ""), r[0] is None, r[0] or 0, r[0]))
    out = Counter()
    for body, members in groups.items():
        members.sort(key=lambda m: m[:3])
        for k, m in enumerate(members):
            out[(m[3], members[0][3], len(members), k == 0, hashlib.sha256(body.encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("colliding", [False, True])
def test_same_as_brute_force(spark, colliding):
    table = rows()
    docs = spark.createDataFrame(table, DOCS).repartition(5)
    settings = {"content_hash": lambda t: F.unhex(F.substring(F.md5(t), 1, 1))} if colliding else {}
    got = Counter(tuple(r) for r in exact_duplicates(docs, **settings).collect())
    assert got == expected(table)
    kept = distinct_documents(docs, **settings)
    assert kept.columns == docs.columns
    want = Counter((r[0], r[4]) for r in expected(table).elements() if r[3])
    assert Counter((r.doc_id, hashlib.sha256(WHITE.sub("", r.text or "").encode()).hexdigest()) for r in kept.collect()) == want


def test_empty_table_and_plan(spark):
    docs = spark.createDataFrame([], DOCS)
    assert exact_duplicates(docs).collect() == []
    assert distinct_documents(docs).collect() == []
    some = exact_duplicates(spark.createDataFrame(rows(), DOCS))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)
