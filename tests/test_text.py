import random
import re

import pytest
from pyspark.sql import functions as F

from spanloom.functions import text as X
from spanloom.functions import uris as U
from spanloom.operators import spans as E


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def stepwise_repair(text, start, end):
    """One character at a time, as the rule is worded."""
    def word(c):
        return c.isalnum() or c == "_"

    while True:
        before = (start, end)
        span = text[start:end]
        if span[:1] in (")", "]", "#") or span[:1].isspace():
            start += 1
        elif start > 0 and word(text[start - 1]):
            start -= 1
        if end < len(text) and text[end].isalnum() and not text[end].isnumeric() or (
            end < len(text) and text[end].isdigit()
        ):
            end += 1
        if (start, end) == before:
            return start, end
        if text[start:end].startswith("Background"):
            start += 10
            while end < len(text) and text[end].isalnum():
                end += 1
            return start, end


def clean(spark, cases):
    sections = spark.createDataFrame(
        [(str(i), "abstract", c[0]) for i, c in enumerate(cases)], "pmid string, location string, text string"
    )
    entities = spark.createDataFrame(
        [(str(i), "abstract", 0, c[1], c[2], "") for i, c in enumerate(cases)],
        "pmid string, location string, pos int, start_idx int, end_idx int, text_span string",
    )
    rows = E.clean_entities(entities, sections).collect()
    return {int(r.pmid): (r.start_idx, r.end_idx, r.text_span) for r in rows}


@pytest.mark.parametrize("text, start, end, expected", [
    ("the neuron fires", 6, 10, "neuron"),
    ("the neuron fires", 4, 8, "neuron"),
    ("(gut) flora", 4, 11, "flora"),
    ("see ])## axon now", 4, 10, "axon"),
    ("a \tcortex", 1, 6, "cortex"),
    ("BackgroundGut flora is", 10, 13, "Gut"),
    ("BackgroundGut flora is", 11, 13, "Gut"),
    ("caféine du thé", 2, 4, "caféine"),
    ("neuron", 1, 3, "neuron"),
    ("in x²y ok", 3, 4, "x²y"),
])
def test_repair(spark, text, start, end, expected):
    assert clean(spark, [(text, start, end)])[0][2] == expected


def test_repair_drops_empty_and_invalid(spark):
    assert clean(spark, [("a gene here", 2, 2), ("a gene here", 3, 5), ("x y", 0, 1)]) == {}


def test_repair_like_the_steps(spark):
    rng = random.Random(7)
    alphabet = "ab1_ )]#-.\n" + "é"
    cases = []
    for _ in range(400):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(2, 30)))
        if rng.random() < 0.2:
            cut = rng.randint(0, len(text))
            text = text[:cut] + "Background" + text[cut:]
        start = rng.randrange(len(text))
        cases.append((text, start, rng.randint(start + 1, len(text))))
    got = clean(spark, cases)
    for i, (text, start, end) in enumerate(cases):
        s, e = stepwise_repair(text, start, end)
        span = text[s:e]
        kept = len(span) != 1 and span.lower() not in X.CLASS_NAMES and span.lower() not in X.GENERIC_WORDS
        # A span of junk only strips past its end; such slices are empty and of no use to compare.
        if s < e:
            assert got.get(i) == ((s, e, span) if kept else None), (text, start, end)


def test_repair_of_long_words_and_texts(spark):
    word = "x" * 9000
    text = "intro " * 3000 + word + " end"
    at = text.index(word)
    long_span = text[:6000]
    got = clean(spark, [(text, at + 4500, at + 4600), (text, 0, 6000), (text, 12001, 12004), (text, 4094, 4099)])
    assert got[0] == (at, at + 9000, word)
    assert got[1][2] == long_span.rstrip() + " " or got[1][0] == 0
    assert got[2][2] == "intro"
    assert got[3][2] in text and got[3][2].strip() == got[3][2].strip()
    assert text[got[3][0]:got[3][1]] == got[3][2]


@pytest.mark.parametrize("span, loose, strict", [
    ("a", False, False), ("C", False, True), ("Gene", False, False), ("system", False, False),
    ("immune system", True, False), ("", True, False), ("gut flora", True, True), (".,-", True, False),
])
def test_validity(spark, span, loose, strict):
    assert one(spark, X.span_valid(F.lit(span))) is loose
    assert one(spark, X.span_valid(F.lit(span), strict=True)) is strict


@pytest.mark.parametrize("spans, marked", [
    ((0, 3, 4, 9), "[E1]gut[/E1] [E2]flora[/E2] x"),
    ((4, 9, 0, 3), "[E2]gut[/E2] [E1]flora[/E1] x"),
    ((0, 6, 4, 9), "[E1]gut fl[/E1][E2]ora[/E2] x"),
    ((0, 3, 3, 9), "[E1]gut[/E1][E2] flora[/E2] x"),
    ((0, 9, 0, 3), "[E1]gut flora[/E1][E2][/E2] x"),
])
def test_markers(spark, spans, marked):
    text = "gut flora x"
    got = one(spark, X.insert_markers(F.lit(text), *[F.lit(n) for n in spans]))
    assert got == marked
    assert re.sub(r"\[/?E[12]\]", "", got) == text


def test_mask_keeps_length(spark):
    text = "<p class=x>Hi <!-- no --> a < b</p> <BR> </i>"
    got = one(spark, X.mask_html(F.lit(text)))
    assert got == "#" * 11 + "Hi " + "#" * 11 + " a < b" + "####" + " <BR> " + "####"
    assert one(spark, X.mask_html(F.lit("plain"))) == "plain"


def test_snap(spark):
    def snap(text, start, end):
        cut = [F.lit(text[:start]), F.lit(text[start:end]), F.lit(text[end:])]
        r = one(spark, X.snap_to_tokens(*cut, F.lit(start)))
        return r and text[r["new_start"]:r["new_end"]]

    text = "The gut-brain axis."
    assert snap(text, 5, 6) == "gut"
    assert snap(text, 5, 10) == "gut-brain"
    assert snap(text, 3, 8) == "gut-"
    assert snap(text, 14, 19) == "axis."
    assert snap(text, 3, 4) is None


def test_normalise(spark):
    assert one(spark, X.normalise_surface(F.lit("\t  Gut  FLORA\n"))) == "gut  flora"


def test_uris(spark):
    ebi = F.lit("http://www.ebi.ac.uk/efo/EFO_1")
    assert one(spark, U.uri_domain(F.lit("https://a.b:80/c?d"))) == "a.b:80"
    assert one(spark, U.uri_domain(F.lit("nothing"))) == ""
    assert one(spark, U.rewrite_uri(ebi)) == "http://purl.obolibrary.org/obo/EFO_1"
    assert one(spark, U.ontology_prefix(ebi)) == "efo"
    assert one(spark, U.ontology_prefix(F.lit("http://purl.obolibrary.org/obo/NCBITaxon_9606"))) == "NCBITaxon"
    assert one(spark, U.mesh_iri(F.lit("https://id.nlm.nih.gov/mesh/D0012/"))) == "http://id.nlm.nih.gov/mesh/2026/D0012"
    assert one(spark, U.as_https(F.lit("https://x/http:"))) == "https://x/http:"


def test_markers_in_parts_as_in_the_whole_text(spark, monkeypatch):
    """Offsets at and across the seams of parts, overlapping, reversed, outside the text or missing."""
    monkeypatch.setattr(X, "PART", 4)
    text = "ab\n\u00e9\U0001f9e0 cdefgh\u00fc\nxyz 01"
    rng = random.Random(6)
    offsets = [tuple(rng.randint(-2, len(text) + 2) for _ in range(4)) for _ in range(300)]
    offsets += [(*sorted(rng.choices(range(len(text) + 1), k=2)), *sorted(rng.choices(range(len(text) + 1), k=2))) for _ in range(300)]
    offsets += [(0, 4, 4, 8), (8, 12, 0, 4), (0, 0, 0, 0), (None, 4, 5, 6), (1, 4, 5, None)]
    rows = [(t, *o) for o in offsets for t in (text, "")] + [(None, 0, 1, 2, 3)]
    frame = spark.createDataFrame(rows, "text string, a int, b int, c int, d int")
    ends = [frame[c] for c in "abcd"]
    parts = frame.withColumns({"parts": X.text_parts(frame.text), "size": F.length("text")})
    got = parts.select(
        X.insert_markers(F.col("text"), *ends).alias("want"), X.insert_markers_in_parts(F.col("parts"), F.col("size"), *ends).alias("got"),
    ).collect()
    assert len(got) == len(rows) and all(r.want == r.got for r in got)
