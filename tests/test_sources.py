import json

import pytest

from spanloom.operators import kb as K
from spanloom.operators import nest as N
from spanloom.operators import reshape as S
from spanloom.sinks import write_frequencies, write_owl, write_submission, write_table
from spanloom.sources import concepts as SC
from spanloom.sources import corpus as SD


def article(title, n=1):
    ends = {f"{s}_{k}": v for s in ("subject", "object") for k, v in (
        ("start_idx", 0), ("end_idx", 2), ("location", "title"), ("text_span", "gut"), ("label", "food"), ("uri", "u"))}
    entity = {"start_idx": 0, "end_idx": 2, "location": "title", "text_span": "gut", "label": "food", "uri": "u"}
    meta = {"title": title, "author": "a", "journal": "j", "year": 2020, "abstract": "b", "annotator": "expert_1"}
    return {"metadata": meta, "entities": [entity] * n, "relations": [{**ends, "predicate": "impact"}]}


def put(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content if isinstance(content, str) else json.dumps(content, indent=1), encoding="utf-8")


@pytest.fixture
def root(tmp_path):
    for tier, name in SD.TRAIN_FILES.items():
        put(tmp_path / name, {"1": article(f"{tier} one"), f"only {tier}": article("x", 0)})
    put(tmp_path / SD.DEV_FILE, {"9": article("dev", 2)})
    put(tmp_path / SD.TEST_FILE, {"7": {"title": "t", "abstract": "a"}})
    return tmp_path


def test_load_dataset(spark, root):
    assert SD.load_dataset(spark, "train", str(root)).count() == 8
    dev = SD.load_dataset(spark, "dev", str(root))
    assert S.flatten_metadata(dev).first().title == "dev"
    assert [r.end_idx for r in S.expand_nested(dev, "entities", end_inclusive=True).collect()] == [3, 3]
    with pytest.raises(ValueError):
        SD.load_dataset(spark, "test", str(root))


def test_tier_priority(spark, root):
    def title(**kw):
        docs = SD.load_documents(spark, "train", str(root), **kw)
        assert docs.count() == 5
        return docs.filter("pmid = '1'").first().metadata.title

    assert title() == "gold one"
    assert title(priority=list(reversed(SD.TRAIN_FILES))) == "bronze one"


def test_missing_tier_is_left_out(spark, tmp_path):
    put(tmp_path / SD.TRAIN_FILES["bronze"], {"1": article("x")})
    assert SD.load_documents(spark, "train", str(tmp_path)).count() == 1


def test_test_articles_have_text_at_top(spark, root):
    docs = S.article_text(SD.load_documents(spark, "test", str(root)))
    assert [(r.pmid, r.title, r.abstract) for r in docs.collect()] == [("7", "t", "a")]


def test_empty_lists(spark, root):
    docs = SD.load_documents(spark, "train", str(root))
    assert S.expand_nested(docs, "entities").count() == 1
    assert S.expand_nested(docs, "entities", keep_empty=True).count() == 5
    with pytest.raises(ValueError):
        S.expand_nested(docs, "nothing")


def test_articles_csv(spark, tmp_path):
    put(tmp_path / "a.csv", 'pmid|title|author|abstract\n1|"a ""b"""|x|"two\nlines"\n2|c|y|d\n')
    rows = SD.read_articles_csv(spark, str(tmp_path / "a.csv")).orderBy("pmid").collect()
    assert [tuple(r) for r in rows] == [("1", 'a "b"', "two\nlines"), ("2", "c", "d")]


def test_first_documents(spark, root):
    docs = SD.load_dataset(spark, "train", str(root))
    assert SD.first_documents(docs, 2).count() == 2 and SD.first_documents(docs, 0).count() == 8


def test_uri_list(spark, tmp_path):
    put(tmp_path / "u.csv", "uri\nhttp://a/b,c  \nhttp://c/\"d\"\n")
    assert sorted(r.uri for r in SC.read_uri_list(spark, str(tmp_path / "u.csv")).collect()) == ["http://a/b,c", 'http://c/"d"']


OWL = """<?xml version="1.0"?>
<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:owl="http://www.w3.org/2002/07/owl#"
  xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:obo="http://purl.obolibrary.org/obo/"
  xmlns:oboInOwl="http://www.geneontology.org/formats/oboInOwl#">
  <owl:Class rdf:about="http://purl.obolibrary.org/obo/X_1">
    <rdfs:label xml:lang="en">gut</rdfs:label>
    <obo:IAO_0000115>a tube</obo:IAO_0000115>
    <oboInOwl:hasExactSynonym>bowel</oboInOwl:hasExactSynonym>
    <oboInOwl:hasExactSynonym rdf:datatype="s">intestine</oboInOwl:hasExactSynonym>
    <oboInOwl:hasSynonym>hose</oboInOwl:hasSynonym>
  </owl:Class>
  <owl:Class rdf:about="http://purl.obolibrary.org/obo/X_2"><rdfs:label>brain</rdfs:label></owl:Class>
</rdf:RDF>
"""


def test_owl(spark, tmp_path):
    for name in ("UBERON", "FOODON", "omit"):
        put(tmp_path / f"{name}.owl", OWL.replace("X_", f"{name}_"))
    triples = SC.read_owl(spark, str(tmp_path))
    assert {r.ontology for r in triples.collect()} == {"uberon", "foodon"}
    uris = triples.select(triples.s.alias("uri")).distinct()
    synonyms = {(r.uri[31:], r.pos, r.surface) for r in K.query_synonyms(triples, uris).collect()}
    assert synonyms == {
        ("UBERON_1", 0, "gut"), ("UBERON_1", 1, "bowel"), ("UBERON_1", 1, "intestine"), ("UBERON_2", 0, "brain"),
        ("FOODON_1", 0, "gut"), ("FOODON_1", 1, "hose"), ("FOODON_2", 0, "brain"),
    }
    assert {r.uri[31:]: r.definition for r in K.query_definitions(triples, uris).collect()} == {"UBERON_1": "a tube", "FOODON_1": "a tube"}


def test_owl_round_trip(spark, tmp_path):
    rows = [(f"http://u/{k}", p, o) for k, (p, o) in enumerate([*((p, "a <b> & \"c\"") for p in SC.OWL_TAGS.values()), (K.LABEL, "é 𝒳")])]
    write_owl(spark.createDataFrame(rows, "s string, p string, o string"), str(tmp_path / "o"))
    assert sorted(map(tuple, SC.read_owl(spark, str(tmp_path / "o")).select("s", "p", "o").collect())) == sorted(rows)


def test_ntriples(spark, tmp_path):
    put(tmp_path / "m.nt", '# note\n<http://s> <http://p> "say \\"hi\\" \\u00e9"@en .\n_:b <http://p> <http://o> .\n'
        '<http://s> <http://p> "5"^^<http://int> . # end\n')
    rows = sorted(tuple(r) for r in SC.read_ntriples(spark, str(tmp_path / "m.nt")).collect())
    assert rows == [("_:b", "http://p", "http://o"), ("http://s", "http://p", "5"), ("http://s", "http://p", 'say "hi" é')]


def test_ntriples_escapes_and_rejects(spark):
    lines = spark.createDataFrame([
        (r'<s> <p> "\U0001F600 \uD83D\uDE00 \t\\u0041" .',), ('<s> <q> "raw\ttab" .',), ("<s> <r> .",), ("",), ("# note",),
        ('<s> <l> "' + r"a\n" * 20_000 + '" .',),
    ], "value string")
    rows = {r.p: r.o for r in SC.parse_ntriples(lines).collect()}
    assert rows == {"p": "\U0001F600 \U0001F600 \t\\u0041", "q": "raw\ttab", "l": "a\n" * 20_000}
    assert [r.value for r in SC.rejected_ntriples(lines).collect()] == ["<s> <r> ."]


def test_records(spark, tmp_path):
    put(tmp_path / "g" / "12.jsonl", {"description": "d", "synonyms": ["A", "B"], "symbol": "C"})
    put(tmp_path / "g" / "13.jsonl", {"description": "e", "symbol": "D"})
    genes = SC.parse_genes(SC.read_records(spark, str(tmp_path / "g"))).collect()
    assert sorted((r.id, r.surface) for r in genes) == [("12", "A"), ("12", "B"), ("12", "C"), ("13", "D")]
    put(tmp_path / "t" / "M1.txt", "M1\nAxon\nlong fibre\nof a cell\nend\n")
    mesh = SC.parse_mesh_texts(SC.read_records(spark, str(tmp_path / "t"))).first()
    assert (mesh.surface, mesh.definition) == ("Axon", "long fibre\nof a cell")
    put(tmp_path / "s" / "77.json", {"fsn": {"term": "Gut (body)"}})
    uris = spark.createDataFrame([("http://snomed.info/id/77",), ("http://snomed.info/id/78",)], "uri string")
    got = SC.concepts_of(uris, SC.parse_snomed(SC.read_records(spark, str(tmp_path / "s")))).collect()
    assert [(r.uri, r.definition, r.surface) for r in got] == [("http://snomed.info/id/77", "", "Gut (body)")]


def test_curated(spark, tmp_path):
    head = "used in document(s),uri,name,definition,labels\n"
    put(tmp_path / "start.csv", "uri,name,definition,labels\nhttp://a,A,da,l\n")
    for f in ("custom", "added"):
        put(tmp_path / f"{f}.csv", f"c1,c2,c3,c4,c5\n{head}1,http://{f},N {f},,l\n2,,no uri,x,l\n")
    rows = SC.read_curated(spark, *[str(tmp_path / f"{f}.csv") for f in ("start", "custom", "added")])
    assert set(rows.columns) == {"uri", "name", "definition", "source"}
    got = {(r.source, r.uri, r.name, r.definition) for r in rows.collect()}
    assert got == {("start", "http://a", "A", "da"), ("custom", "http://custom", "N custom", None),
                   ("added", "http://added", "N added", None), ("added", None, "no uri", "x")}


def test_curated_listed_and_upsert(spark):
    curated = spark.createDataFrame([("https://a", "A", "d"), (None, "B", "e"), ("http://c", None, None)], "uri string, name string, definition string")
    listed = spark.createDataFrame([("http://a",), ("https://c",)], "uri string")
    chosen = K.curated_listed(curated, listed)
    assert {r.uri for r in chosen.collect()} == {"https://a", "http://c"}
    old = spark.createDataFrame([("https://a", "old"), ("http://c", "stays")], "uri string, definition string")
    assert {r.uri: r.definition for r in K.upsert(old, chosen, "definition").collect()} == {"https://a": "d", "http://c": "stays"}


def test_submission_round_trip(spark, tmp_path):
    articles = spark.createDataFrame([("1",), ("2",)], "pmid string")
    fields = "pmid string, subject_uri string, subject_label string, predicate string, object_uri string, object_label string"
    rels = spark.createDataFrame([("1", "u", "drug", "impact", "v", "bacteria")], fields)
    write_submission(N.concept_submission(articles, rels), str(tmp_path / "out"))
    back = {r.pmid: r.concept_level_relations for r in SD.read_corpus(spark, str(tmp_path / "out"), lines=True).collect()}
    assert back["2"] == [] and back["1"][0].object_uri == "v"
    write_frequencies(rels, str(tmp_path / "csv"))
    lines = [line for f in sorted((tmp_path / "csv").glob("part*")) for line in f.read_text().splitlines()]
    assert lines == ["subjectConceptURI;subjectCategory;relationPredicate;objectConceptURI;objectCategory;frequency", "u;drug;impact;v;bacteria;1"]
    write_table(rels, str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).collect() == rels.collect()


def test_lines_lose_no_article(spark, tmp_path):
    from spanloom.sources.corpus import DEV_FILE, load_dataset, load_documents

    path = tmp_path / DEV_FILE
    path.parent.mkdir(parents=True)
    path.write_text('{"1": {"title": "a"}}\n{"2": {"title": "b"}, "3": {"title": "c"}}\n')
    for load in (load_dataset, load_documents):
        assert sorted(r.pmid for r in load(spark, "dev", str(tmp_path), lines=True).collect()) == ["1", "2", "3"]
