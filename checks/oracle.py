"""The queries of checks/queries.py in DuckDB SQL. VIEWS restates the rules of checks/views.py."""

import re

from spanloom.functions.text import CLASS_NAMES, GENERIC_WORDS
from spanloom.vocab import CLASSES, ENTITY_LABELS, PREDICATES, schema_triples


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _in(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


LABELS, PREDS, CLASS_LIST = _list(ENTITY_LABELS), _list(PREDICATES), _list(CLASSES)
SCHEMA_ROWS = ", ".join(f"('{s}', '{p}', '{o}', {str(d).lower()})" for s, p, o, d in schema_triples())
OBO = "http://purl.obolibrary.org/obo/"
RDFS_LABEL = "http://www.w3.org/2000/01/rdf-schema#label"
DEFINITION = "http://purl.obolibrary.org/obo/IAO_0000115"
ALTERNATIVE = "http://purl.obolibrary.org/obo/IAO_0000118"
EXACT = "http://www.geneontology.org/formats/oboInOwl#hasExactSynonym"
SYNONYM = "http://www.geneontology.org/formats/oboInOwl#hasSynonym"
NOTE = "http://id.nlm.nih.gov/mesh/vocab#note"
ENTITY_ITEM = "concat_ws(':', start_idx, end_idx, label, uri)"
CONCEPT_KEY = "subject_uri, subject_label, predicate, object_uri, object_label"
MENTION_KEY = "subject_text_span, subject_label, predicate, object_text_span, object_label"
# All ordered pairs of a section's entities, marked in the text and classed by the rule of checks/queries.py.
CLASSED_PAIRS = f"""with ends as (
            select s.pmid, s.location, s.start_idx as s_start, o.start_idx as o_start, s.text_span as s_text, o.text_span as o_text,
                s.label as s_label, o.label as o_label, s.uri as s_uri, o.uri as o_uri, text,
                least(s.start_idx, o.start_idx) as a, least(s.end_idx, o.end_idx) as b,
                greatest(s.start_idx, o.start_idx) as c, greatest(s.end_idx, o.end_idx) as d,
                case when s.start_idx < o.start_idx then 'E1' else 'E2' end as one, case when s.start_idx < o.start_idx then 'E2' else 'E1' end as two
            from fx_entities s join fx_entities o on s.pmid = o.pmid and s.location = o.location and s.start_idx <> o.start_idx
                join fx_sections t on t.pmid = s.pmid and t.location = s.location
        ), pairs as (
            select *, substr(text, greatest(a - 100, 0) + 1, least(a, 100)) || '[' || one || ']' || substr(text, a + 1, b - a) || '[/' || one || ']'
                || case when c - b > 200 then substr(text, b + 1, 100) || ' … ' || substr(text, c - 99, 100) else substr(text, b + 1, c - b) end
                || '[' || two || ']' || substr(text, c + 1, d - c) || '[/' || two || ']' || substr(text, d + 1, 100) as marked
            from ends
        ), classed as (
            select *, {CLASS_LIST}[1 + (strpos(marked, '[E1]') + 3 * strpos(marked, '[E2]') + 7 * length(marked)
                + case when strpos(marked, '[E2]') > 1 then unicode(substr(marked, strpos(marked, '[E2]') - 1, 1)) else 0 end) % 18] as predicate
            from pairs
        )"""
FIELDS = ("start_idx", "end_idx", "location", "text_span", "label", "uri")
# Word characters as in the Spark expressions.
W = r"[\p{L}\p{N}_]"

def _gram_vectors(keys: str) -> str:
    """Unit vectors of unhashed trigrams of keys and first surfaces."""
    return f"""
        with both_keys as (select key from {keys} union select min(surface) from fx_kb group by uri),
        terms as (
          select key, gram, count(*) as tf
          from (select key, unnest(list_transform(range(1, length(key) + 1), lambda i: substr(' ' || key || ' ', i, 3))) as gram
                from both_keys) group by all),
        idf as (select gram, ln((1 + (select count(*) from both_keys)) / (1 + count(*))::double) + 1 as idf from terms group by gram),
        weighted as (select key, gram, tf * idf as w from terms join idf using (gram))
        select key, gram, w / sqrt(sum(w * w) over (partition by key)) as w from weighted"""


def _gram_nearest(keys: str, vectors: str) -> str:
    """The nearest concept of each key; the lowest if none shares a trigram."""
    return f"""
        with concepts as (select uri, min(surface) as surface from fx_kb group by uri),
        scores as (
          select m.key, c.uri, round(sum(m.w * v.w), 6) as score
          from concepts c join {vectors} v on v.key = c.surface join {vectors} m on m.gram = v.gram
          where m.key in (select key from {keys}) group by all),
        best as (
          select * from (select *, row_number() over (partition by key order by score desc, uri) as r from scores) where r = 1)
        select key, coalesce(uri, (select min(uri) from concepts)) as uri, coalesce(score, 0) as score
        from {keys} left join best using (key)"""


VIEWS = {
    "fx_articles": """
        select cast(doc_id as varchar) as pmid, doc_id, split_part(text, chr(10), 1) as title,
               substr(text, length(split_part(text, chr(10), 1)) + 2) as abstract,
               case doc_id % 5 when 0 then 'expert_1' when 1 then 'student_A' when 2 then 'student_B' else 'distant' end
                 as annotator
        from documents""",
    "fx_sections": """
        select * from (
          select pmid, 'title' as location, title as text, annotator from fx_articles
          union all select pmid, 'abstract', abstract, annotator from fx_articles)
        where text <> ''""",
    "fx_entities": f"""
        select pmid, location, cast(row_number() over (partition by pmid, location order by i) - 1 as integer) as pos,
               tok as text_span, cast(start_idx as integer) as start_idx,
               cast(start_idx + length(tok) as integer) as end_idx,
               ({LABELS})[(ascii(tok) + length(tok)) % 13 + 1] as label,
               '{OBO}' || upper(substr(tok, 1, 3)) || '_' || length(tok) as uri
        from (select pmid, location, i, tok,
                     sum(length(tok) + 1) over (partition by pmid, location order by i) - length(tok) - 1 as start_idx
              from (select pmid, location, unnest(toks) as tok, generate_subscripts(toks, 1) as i
                    from (select pmid, location, string_split(text, ' ') as toks from fx_sections)))
        where regexp_full_match(tok, '[a-z]{{9,}}')""",
    "fx_noisy": """
        select pmid, location, pos, substr(text, s + 1, e - s) as text_span, s as start_idx, e as end_idx, label, uri
        from (select m.* exclude (text_span, start_idx, end_idx), text,
                     cast(greatest(start_idx + pos % 3 - 1, 0) as integer) as s,
                     cast(end_idx - case when pos % 2 = 0 then 1 else 0 end as integer) as e
              from fx_entities m join fx_sections using (pmid, location))
        where s < e""",
    "fx_relations": f"""
        select s.pmid, s.location, s.pos, {', '.join(f's.{c} as subject_{c}' for c in FIELDS)},
               ({PREDS})[(s.start_idx + o.start_idx) % 17 + 1] as predicate,
               {', '.join(f'o.{c} as object_{c}' for c in FIELDS)}
        from fx_entities s join fx_entities o on s.pmid = o.pmid and s.location = o.location and o.pos = s.pos + 1""",
    "fx_all_relations": f"""
        select * exclude (location, pos) from fx_relations
        union all
        select s.pmid, {', '.join(f's.{c} as subject_{c}' for c in FIELDS)},
               ({PREDS})[(s.start_idx + o.start_idx) % 17 + 1] as predicate,
               {', '.join(f'o.{c} as object_{c}' for c in FIELDS)}
        from fx_entities s join fx_entities o
          on s.pmid = o.pmid and s.location = 'title' and o.location = 'abstract' and s.pos = 0 and o.pos = 0""",
    "fx_partial": """
        select * replace (case when subject_start_idx % 7 = 0 then '' else subject_uri end as subject_uri,
                          case when object_start_idx % 11 = 0 then 'unknown' else object_label end as object_label)
        from fx_relations""",
    "fx_kb": """
        select distinct uri, text_span as surface from fx_entities where length(text_span) % 2 = 0""",
    "fx_definitions": """
        select uri, min(surface) || ' ' || max(surface) as definition from fx_kb
        where cast(split_part(uri, '_', 2) as integer) % 4 <> 0 group by uri""",
    "fx_listed": """
        select distinct uri from fx_entities join fx_articles using (pmid) where annotator = 'distant'""",
    "fx_mixed": """
        select case n % 6 when 1 then 'http://www.ebi.ac.uk/efo/' || tail
                          when 2 then 'http://edamontology.org/' || tail
                          when 3 then 'https://id.nlm.nih.gov/mesh/' || replace(tail, '_', '')
                          when 4 then 'https://www.ncbi.nlm.nih.gov/gene/' || replace(tail, '_', '')
                          when 5 then 'http://snomed.info/id/' || replace(tail, '_', '')
                          else uri end as uri
        from (select uri, split_part(uri, '/', -1) as tail, cast(split_part(uri, '_', 2) as integer) as n
              from (select distinct uri from fx_entities))""",
    "fx_triples": f"""
        with firsts as (
          select uri, min(surface) as first, max(surface) as last, split_part(split_part(uri, '/', -1), '_', 1) as prefix,
                 cast(split_part(uri, '_', 2) as integer) as n from fx_kb group by uri),
        named as (
          select *, case n when 10 then 'foodon' when 12 then 'stato' else lower(prefix) end as ontology from firsts)
        select ontology, uri as s, '{RDFS_LABEL}' as p, first as o from named where ascii(substr(prefix, 2, 1)) % 5 <> 0
        union all select ontology, uri, '{DEFINITION}', unnest([definition, 'z ' || last])
                  from named join fx_definitions using (uri)
        union all select ontology, uri,
                         case ascii(right(surface, 1)) % 3 when 0 then '{EXACT}' when 1 then '{SYNONYM}' else '{ALTERNATIVE}' end,
                         surface
                  from named join fx_kb using (uri) where surface <> first""",
    "fx_mesh": f"""
        with iris as (select 'http://id.nlm.nih.gov/mesh/2026/' || split_part(uri, '/', -1) as s from fx_mixed
                      where contains(uri, 'id.nlm.nih.gov'))
        select s, '{RDFS_LABEL}' as p, lower(split_part(s, '/', -1)) as o from iris
        union all select s, '{NOTE}', 'note ' || lower(split_part(s, '/', -1)) from iris
                  where ascii(lower(split_part(s, '/', -1))) % 2 = 0""",
    "fx_curated": """
        select replace(uri, 'http:', 'https:') as uri,
               case when ascii(last) % 3 <> 0 then 'curated ' || last end as name,
               case when ascii(last) % 3 <> 1 then 'about ' || last end as definition
        from (select uri, max(text_span) as last from fx_entities group by uri)""",
    "fx_models": "select unnest([0, 1, 2]) as model",
    "fx_pred_entities": """
        select * exclude (d, copies), unnest(range(copies)) as copy from (
          select e.* replace (case when d = 2 then 'drug' else label end as label), model, d,
                 case when d = 3 then 2 else 1 end as copies
          from (select e.*, model,
                       cast('0x' || substr(md5(concat_ws('|', model, pmid, location, pos)), 1, 1) as integer) as d
                from fx_entities e, fx_models) e
          where d > 1)""",
    "fx_pred_relations": """
        select * exclude (d, copies), unnest(range(copies)) as copy from (
          select e.* replace (case when d = 2 then 'interact' else predicate end as predicate), model, d,
                 case when d = 3 then 2 else 1 end as copies
          from (select r.*, model,
                       cast('0x' || substr(md5(concat_ws('|', model, pmid, location, subject_start_idx)), 1, 1) as integer)
                         as d
                from fx_relations r, fx_models) e
          where d > 1)""",
    "fx_scored": f"""
        select * exclude (key, scores), ({CLASS_LIST})[list_position(scores, list_max(scores))] as prediction from (
          select *, list_transform(range(18), lambda k:
                   cast('0x' || substr(md5(key || '|' || k), 1, 2) as integer) / 255.0::double
                   + case when cast('0x' || substr(md5(key), 1, 1) as integer) < 10
                          and k = list_position({CLASS_LIST}, predicate) - 1 then 1.0::double else 0.0::double end) as scores
          from (select *, concat_ws('|', pmid, location, subject_start_idx) as key from fx_relations))""",
    "fx_schema": f"""
        select * from (values {SCHEMA_ROWS}) t(subject_label, predicate, object_label, is_default)""",
    # Entity rows as read from the nested article, numbered by their place in its list.
    "fx_nested_entities": """
        select *, cast(row_number() over (partition by pmid order by location, start_idx) - 1 as integer) as nr
        from fx_entities""",
    "fx_index": """
        select key, uri, length(key) as len from (
          select lower(surface) as key, uri, row_number() over (partition by lower(surface) order by uri) as r from fx_kb)
        where r = 1""",
    "fx_keys": """
        select distinct unnest([text_span, text_span || 's', 'the ' || text_span || ' of it']) as key from fx_entities""",
    "fx_substring": """
        select key, uri from (
          select k.key, i.uri, row_number() over (partition by k.key order by i.len desc, i.uri, i.key) as r
          from fx_keys k join fx_index i on contains(k.key, i.key)) where r = 1""",
    # Repair restated from the rule of the noise: moved mentions grow back to whole words of the text.
    "fx_repaired": rf"""
        select pmid, location, pos, label, uri, s as start_idx, e as end_idx, substr(text, s + 1, e - s) as text_span
        from (
          select pmid, location, pos, label, uri, text,
                 cast(case when k > 0 then start_idx + k
                           else start_idx - length(regexp_extract(substr(text, 1, start_idx), '{W}*$')) end as integer) as s,
                 cast(end_idx + length(regexp_extract(substr(text, end_idx + 1),
                                                      '^[\p{{L}}\p{{Nd}}]*')) as integer) as e
          from (select m.* exclude (text_span), text,
                       length(regexp_extract(text_span, '^[)\]#\s\x{{85}}\p{{Z}}]*')) as k
                from fx_noisy m join fx_sections using (pmid, location)))""",
    "fx_snapped": rf"""
        select pmid, location, pos, label, uri, start_idx as raw_start,
               cast(case when lead = 0 and regexp_matches(text_span, '^{W}')
                         then start_idx - length(regexp_extract(substr(text, 1, start_idx), '{W}*$'))
                         else start_idx + lead end as integer) as start_idx,
               cast(case when trail = 0 and regexp_matches(text_span, '{W}$')
                         then end_idx + length(regexp_extract(substr(text, end_idx + 1), '^{W}*'))
                         else end_idx - trail end as integer) as end_idx
        from (select m.*, text, length(regexp_extract(text_span, '^[\s\x{{85}}\p{{Z}}]*')) as lead,
                     length(regexp_extract(text_span, '[\s\x{{85}}\p{{Z}}]*$')) as trail
              from fx_noisy m join fx_sections using (pmid, location))""",
    "fx_nodes": """
        select pmid, location, start_idx, end_idx from fx_snapped where pos % 7 <> 0 and end_idx > start_idx""",
    "fx_matrix_rels": """
        select r.pmid, r.location, s.start_idx as s_raw, s.uri as subject_uri, r.predicate, o.start_idx as o_raw,
               o.uri as object_uri
        from fx_relations r join fx_noisy s on s.pmid = r.pmid and s.location = r.location and s.pos = r.pos
             join fx_noisy o on o.pmid = r.pmid and o.location = r.location and o.pos = r.pos + 1""",
    "fx_matrix_found": """
        with starts as (select pmid, location, raw_start, arg_max(start_idx, pos) as token from fx_snapped group by all)
        select r.*, s.token as s_token, o.token as o_token,
               coalesce(s.token <> o.token
                 and exists (select 1 from fx_nodes n where n.pmid = r.pmid and n.location = r.location and n.start_idx = s.token)
                 and exists (select 1 from fx_nodes n where n.pmid = r.pmid and n.location = r.location and n.start_idx = o.token),
                 false) as found
        from fx_matrix_rels r
             left join starts s on s.pmid = r.pmid and s.location = r.location and s.raw_start = r.s_raw
             left join starts o on o.pmid = r.pmid and o.location = r.location and o.raw_start = r.o_raw""",
    # All ordered pairs of a section, with the gold label and the number the sampling gives the pair.
    "fx_pairs": """
        with placed as (
          select *, row_number() over (partition by pmid, location
                      order by md5(concat_ws('|', '1337', pmid, location, pos)), pos) - 1 as place,
                 count(*) over (partition by pmid, location) as n from fx_entities),
        gold as (select pmid, location, subject_start_idx as s_start, object_start_idx as o_start,
                        arg_max(predicate, pos) as label from gold_relations group by all)
        select s.pmid, s.location, s.pos as s_pos, s.start_idx as s_start, s.end_idx as s_end, o.pos as o_pos,
               o.start_idx as o_start, o.end_idx as o_end, coalesce(g.label, 'no_relation') as label,
               ((o.place - s.place - 1 + s.n) % s.n) * s.n + s.place as t
        from placed s join placed o on s.pmid = o.pmid and s.location = o.location and s.place <> o.place
                                    and (s.start_idx <> o.start_idx or s.end_idx <> o.end_idx)
             left join gold g on g.pmid = s.pmid and g.location = s.location and g.s_start = s.start_idx
                              and g.o_start = o.start_idx""",
    "gold_relations": "select * from fx_relations",
    "fx_examples": """
        select * exclude (t, n_positive, r) from (
          select *, count(*) filter (label <> 'no_relation') over (partition by pmid, location) as n_positive,
                 row_number() over (partition by pmid, location, label = 'no_relation' order by t) as r
          from fx_pairs)
        where label <> 'no_relation' or r <= case when n_positive > 0 then floor(n_positive * 2.0) else 8 end""",
    "fx_gazetteer": """
        select surface, label from (
          select surface, label, row_number() over (partition by surface order by n desc, label) as r
          from (select lower(text_span) as surface, label, count(*) as n from fx_entities
                where cast(pmid as bigint) % 10 <> 0 group by all)) where r = 1""",
    "fx_tagged": rf"""
        select pmid, location, cast(start_idx as integer) as start_idx,
               cast(start_idx + length(tok) as integer) as end_idx, tok as text_span, label
        from (select pmid, location, tok,
                     sum(length(tok) + length(gap)) over (partition by pmid, location order by i) - length(tok) as start_idx
              from (select pmid, location, unnest(toks) as tok, unnest(gaps[:len(toks)]) as gap,
                           generate_subscripts(toks, 1) as i
                    from (select pmid, location,
                                 regexp_extract_all(text, '{W}+|[^\p{{L}}\p{{N}}_\s\x{{85}}\p{{Z}}]') as toks,
                                 string_split_regex(text, '{W}+|[^\p{{L}}\p{{N}}_\s\x{{85}}\p{{Z}}]') as gaps
                          from fx_sections)))
             join fx_gazetteer g on g.surface = lower(tok)""",
    "fx_mention_keys": "select distinct lower(text_span) as key from fx_entities",
    "fx_vectors": """
        with both_keys as (select key from fx_mention_keys union select min(surface) from fx_kb group by uri),
        terms as (
          select key, cast('0x' || substr(md5(gram), 1, 4) as integer) % 256 as dim, count(*) as tf
          from (select key, unnest(list_transform(range(1, length(key) + 1), lambda i: substr(' ' || key || ' ', i, 3))) as gram
                from both_keys) group by all),
        idf as (select dim, ln((1 + (select count(*) from both_keys)) / (1 + count(*))::double) + 1 as idf from terms group by dim),
        weighted as (select key, dim, tf * idf as w from terms join idf using (dim))
        select key, dim, w / sqrt(sum(w * w) over (partition by key)) as w from weighted""",
    "fx_nearest": """
        with concepts as (select uri, min(surface) as surface from fx_kb group by uri),
        scores as (
          select m.key, c.uri, round(sum(m.w * v.w), 6) as score
          from concepts c join fx_vectors v on v.key = c.surface
               join fx_vectors m on m.dim = v.dim
          where m.key in (select key from fx_mention_keys) group by all)
        select key, uri, score from (
          select *, row_number() over (partition by key order by score desc, uri) as r from scores) where r = 1""",
    "fx_gram_vectors": _gram_vectors("fx_mention_keys"),
    "fx_gram_nearest": _gram_nearest("fx_mention_keys", "fx_gram_vectors"),
    "fx_tag_keys": "select distinct lower(text_span) as key from fx_tagged",
    "fx_tag_vectors": _gram_vectors("fx_tag_keys"),
    "fx_tag_nearest": _gram_nearest("fx_tag_keys", "fx_tag_vectors"),
    "fx_linked": """
        select e.* replace (coalesce(i.uri, j.uri, sub.uri) as uri)
        from fx_entities e
             left join fx_index i on i.key = lower(e.text_span)
             left join fx_index j on i.key is null and j.key || 's' = lower(e.text_span) and length(e.text_span) > 3
             left join fx_substring sub on sub.key = lower(e.text_span)""",
}


def _derived(entities: str) -> str:
    return f"""
        select distinct s.pmid, s.uri as subject_uri, s.label as subject_label, predicate, o.uri as object_uri,
               o.label as object_label
        from {entities} s join {entities} o on s.pmid = o.pmid and s.location = o.location and s.uri <> o.uri
             join fx_schema on subject_label = s.label and object_label = o.label and is_default"""


def _scores(gold: str, pred: str, key: list[str], cls: str, models: str = "fx_models") -> str:
    same = " and ".join(f"g.{c} is not distinct from p.{c}" for c in key)
    return f"""
        select model, class, tp, fp, fn, round(p, 6) as precision, round(r, 6) as recall,
               round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 6) as f1, p as p_, r as r_,
               case when p + r > 0 then 2 * p * r / (p + r) else 0 end as f_
        from (select *, case when tp + fp > 0 then tp / (tp + fp) else 0.0::double end as p,
                     case when tp + fn > 0 then tp / (tp + fn) else 0.0::double end as r
              from (select model, class, cast(sum(tp) as bigint) as tp, cast(sum(fp) as bigint) as fp,
                           cast(sum(fn) as bigint) as fn
                    from (select model, {cls} as class, hit as tp, 1 - hit as fp, 0 as fn
                          from (select p.*, case when exists (select 1 from {gold} g where {same}) then 1 else 0 end as hit
                                from {pred} p)
                          union all
                          select m.model, g.{cls}, 0, 0,
                                 case when exists (select 1 from {pred} p where p.model = m.model and {same}) then 0 else 1 end
                          from {gold} g, {models} m)
                    group by model, class))"""


def _summary(scores: str) -> str:
    return f"""
        select model, round(mp, 6) as micro_precision, round(mr, 6) as micro_recall,
               round(case when mp + mr > 0 then 2 * mp * mr / (mp + mr) else 0 end, 6) as micro_f1,
               round(ap, 6) as macro_precision, round(ar, 6) as macro_recall, round(af, 6) as macro_f1
        from (select model, case when sum(tp) + sum(fp) > 0 then sum(tp) / (sum(tp) + sum(fp)) else 0.0::double end as mp,
                     case when sum(tp) + sum(fn) > 0 then sum(tp) / (sum(tp) + sum(fn)) else 0.0::double end as mr,
                     avg(p_) as ap, avg(r_) as ar, avg(f_) as af from ({scores}) group by model)"""


NER = ["pmid", "location", "start_idx", "end_idx", "label"]
LINKING = ["pmid", "text_span", "label", "uri"]
MENTION_RE = ["pmid", *MENTION_KEY.split(", ")]
CONCEPT_RE = ["pmid", *CONCEPT_KEY.split(", ")]
CLASS_COLUMNS = "model, class, tp, fp, fn, precision, recall, f1"
REL_ITEM = "concat_ws(':', subject_start_idx, subject_uri, predicate, object_start_idx, object_uri)"


def _agg(item: str, order: str, where: str = "") -> str:
    return f"string_agg({item}, ';' order by {order}){where}"


def _group_entities(view: str) -> str:
    order = "start_idx, end_idx, label, uri, text_span"
    return f"""select pmid, location, {_agg(ENTITY_ITEM, order)} as entities, {_agg('text_span', order)} as text_span
               from {view} group by pmid, location"""


def _group_relations(view: str) -> str:
    order = "subject_start_idx, subject_uri, predicate, object_start_idx, object_uri"
    return f"select pmid, object_location as location, {_agg(REL_ITEM, order)} as relations from {view} group by pmid, object_location"


def _per_article(view: str, item: str, order: str, name: str) -> str:
    return f"select pmid, {_agg(item, order)} as {name} from ({view}) group by pmid"


CONCEPT_ITEM, MENTION_ITEM = f"concat_ws(':', {CONCEPT_KEY})", f"concat_ws(':', {MENTION_KEY})"
POSITIVE = f"select pmid, {MENTION_KEY} from (select * replace (prediction as predicate) from fx_scored) where predicate <> 'no_relation'"
POSITIVE_CONCEPTS = f"""select distinct pmid, {CONCEPT_KEY} from (select * replace (prediction as predicate) from fx_scored)
    where predicate <> 'no_relation' and subject_uri <> object_uri"""
SUBMITTED = "concat_ws(':', start_idx, end_idx, location, text_span, label, uri)"
LINES = f"select {', '.join(FIELDS)} from fx_entities"

ORACLES = {
    "src_annotated_json": "select pmid, nr as pos, location, start_idx, end_idx, text_span, label, uri from fx_nested_entities",
    "src_tier_override": """
        select pmid, 'gold' as tier, case when annotator like 'expert%' then title else 'copy ' || title end as title
        from fx_articles""",
    "src_articles_csv": "select pmid, title, md5(abstract) as abstract_md5 from fx_articles",
    "src_articles_file": "select pmid, title, md5(abstract) as abstract_md5 from fx_articles",
    "kb_uri_list": "select uri from fx_listed",
    "kb_owl_triples": "select s, p, o from fx_triples",
    "save_table": "select pmid, location, pos, start_idx, end_idx, text_span, label, uri from fx_entities",
    "frequency_file": """
        select subject_uri, subject_label, predicate, object_uri, object_label, count(*) as n from fx_relations group by all""",
    "src_first_n_docs": "select pmid, title from fx_articles order by pmid limit 100",
    "kb_ntriples": "select s, p, o from fx_triples",
    "kb_gene_json": """
        select split_part(uri, '/', -1) as id, 'gene ' || min(surface) as definition,
               unnest(list_distinct([min(surface), max(surface)])) as surface from fx_kb group by uri""",
    "kb_mesh_text": """
        select pmid as id, pmid || chr(10) || annotator as definition, trim(title, ' ') as surface from fx_articles""",
    "kb_snomed_json": """
        select uri, '' as definition, max(text_span) as surface from fx_entities
        where uri in (select uri from fx_listed) group by uri""",
    "sub_concept_json": f"""
        select pmid, 0 as part, coalesce(relations, '') as relations from fx_articles left join (
          {_per_article(f'select distinct pmid, {CONCEPT_KEY} from fx_relations', CONCEPT_ITEM, CONCEPT_KEY, 'relations')})
          using (pmid)""",
    "sub_re_json": f"""
        select pmid, 0 as part, coalesce(mentions, '') as mentions, coalesce(concepts, '') as concepts from fx_articles
        left join ({_per_article(POSITIVE, MENTION_ITEM, MENTION_KEY, 'mentions')}) using (pmid)
        left join ({_per_article(POSITIVE_CONCEPTS, CONCEPT_ITEM, CONCEPT_KEY, 'concepts')}) using (pmid)""",
    "sub_entities_json": f"""
        select pmid, 0 as part, coalesce(entities, '') as entities from fx_articles left join (
          {_per_article('select * from fx_entities', SUBMITTED, 'location desc, start_idx', 'entities')}) using (pmid)""",
    "sub_entities_lines": "select pmid, location, start_idx, end_idx, text_span, label from fx_entities",
    "flatten_metadata": "select pmid, title, abstract, annotator from fx_articles",
    "annotator_tier": """
        select ['gold', 'silver_a', 'silver_b', 'bronze', 'bronze'][doc_id % 5 + 1] as annotator, count(*) as n
        from documents group by 1""",
    "explode_entities": """
        select pmid, nr as pos, location, start_idx, end_idx, label, uri, text_span
        from fx_articles left join fx_nested_entities using (pmid)""",
    "explode_drop_empty": """
        select subject_location, subject_start_idx, predicate, object_location, object_start_idx from fx_all_relations""",
    "unpivot_sections": "select pmid, location, md5(text) as text from fx_sections",
    "docs_with_relations": "select pmid, count(*) as n_relations from fx_all_relations group by pmid",
    "same_section_relations": "select pmid, subject_start_idx, subject_uri, predicate, object_start_idx, object_uri from fx_relations",
    "allowed_label_filter": "select pmid, location, pos, label from fx_entities where start_idx % 5 <> 0",
    "complete_relations": f"""
        select pmid, subject_start_idx, subject_uri, predicate, object_start_idx, object_uri from fx_partial
        where subject_uri <> '' and object_label in {_in(ENTITY_LABELS)}""",
    "pairable_sections": """
        select pmid, location, length(text) as n_chars, n_entities from fx_sections
        join (select pmid, location, count(*) as n_entities from fx_entities group by all having count(*) > 1)
        using (pmid, location)""",
    "kb_curated_semi": "select * from fx_curated where uri in (select replace(uri, 'http:', 'https:') from fx_listed)",
    "ner_training_grouped": f"""
        select pmid, location, md5(text) as text, entities from fx_sections join (
          select pmid, location, {_agg("concat_ws(':', start_idx, end_idx, label)", 'start_idx, end_idx, label')} as entities
          from fx_entities group by all) using (pmid, location)""",
    "ner_training_flat": """
        select pmid, location, start_idx, end_idx, label, length(text) as text
        from fx_entities join fx_sections using (pmid, location)""",
    "mask_html": r"""
        with parts as (
          select page_id, regexp_extract_all(html, '</?[a-z][a-z0-9]*[^<>]*>|<!--.*?-->') as tags,
                 string_split_regex(html, '</?[a-z][a-z0-9]*[^<>]*>|<!--.*?-->') as texts from pages)
        select page_id, list_aggregate(list_transform(range(1, len(texts) + 1), lambda i:
                 texts[i] || coalesce(repeat('#', length(tags[i])), '')), 'string_agg', '') as masked from parts""",
    "span_valid": f"""
        with spans as (select doc_id, unnest(string_split_regex(text, '[ \\n]')) as span from documents)
        select doc_id, length(span) <> 1 and lower(span) not in {_in(CLASS_NAMES)}
               and lower(span) not in {_in(GENERIC_WORDS)} as valid, count(*) as n from spans group by all""",
    "span_repair": "select pmid, location, pos, start_idx, end_idx, text_span from fx_repaired",
    "span_orient": "select pmid, location, pos, start_idx, end_idx from fx_entities",
    "span_snap_tokens": "select pmid, location, pos, raw_start, start_idx, end_idx from fx_snapped",
    "span_resolve_overlap": """
        with recursive raw as (
          select pmid, location, pos, start_idx, end_idx, label from fx_entities
          union all
          select pmid, location, pos + 1000000, subject_start_idx, object_end_idx, predicate from fx_relations),
        ranked as (
          select *, row_number() over (partition by pmid, location order by end_idx - start_idx desc, start_idx) as r from raw),
        fold as (
          select pmid, location, 0::bigint as r, []::integer[] as starts, []::integer[] as ends, []::integer[] as kept
          from (select distinct pmid, location from raw)
          union all
          select f.pmid, f.location, x.r,
                 case when hit then starts else list_append(starts, x.start_idx) end,
                 case when hit then ends else list_append(ends, x.end_idx) end,
                 case when hit then kept else list_append(kept, x.pos) end
          from (select f.*, x.start_idx, x.end_idx, x.pos, x.r as xr,
                       len(list_filter(range(1, len(starts) + 1), lambda i:
                         starts[i] < x.end_idx and x.start_idx < ends[i])) > 0 as hit
                from fold f join ranked x on x.pmid = f.pmid and x.location = f.location and x.r = f.r + 1) f,
               lateral (select f.start_idx, f.end_idx, f.pos, f.xr as r) x),
        done as (select pmid, location, unnest(kept) as pos from
                 (select *, row_number() over (partition by pmid, location order by r desc) as k from fold) where k = 1)
        select raw.* from raw join done using (pmid, location, pos)""",
    "insert_markers": """
        select pmid, location, subject_start_idx, object_start_idx,
               md5(substr(text, 1, subject_start_idx) || '[E1]' || subject_text_span || '[/E1]'
                   || substr(text, subject_end_idx + 1, object_start_idx - subject_end_idx)
                   || '[E2]' || object_text_span || '[/E2]' || substr(text, object_end_idx + 1)) as marked
        from fx_relations join fx_sections using (pmid, location)""",
    "normalise_surface": r"""
        select lower(regexp_replace(title, '^[\s\x{85}\p{Z}]+|[\s\x{85}\p{Z}]+$', '', 'g')) as surface, count(*) as n
        from fx_articles group by 1""",
    "normalise_surface_all": r"""
        select lower(regexp_replace(s, '^[\s\x{85}\p{Z}]+|[\s\x{85}\p{Z}]+$', '', 'g')) as surface, count(*) as n
        from (select title as s from fx_articles union all select text_span from fx_entities) group by 1""",
    "kb_uri_domain": """
        select uri, split_part(split_part(uri, '://', 2), '/', 1) as domain
        from (select uri from fx_mixed union all select url from pages)""",
    "kb_uri_rewrite": f"""
        select uri as listed, split_part(split_part(uri, '://', 2), '/', 1) as domain,
               replace(uri, 'http://www.ebi.ac.uk/efo/', '{OBO}') as uri from fx_mixed""",
    "kb_ontology_prefix": f"""
        select uri as listed, case when starts_with(uri, '{OBO}') then split_part(replace(uri, '{OBO}', ''), '_', 1)
               when contains(uri, 'ebi.ac.uk') then 'efo' when contains(uri, 'edamontology') then 'edam' end as ontology
        from fx_mixed""",
    "kb_mesh_rewrite": """
        select uri, replace(uri, 'https://id.nlm.nih.gov/mesh/', 'http://id.nlm.nih.gov/mesh/2026/') as iri
        from fx_mixed where contains(uri, '/mesh/')""",
    "resolve_endpoints": """
        select r.pmid, s.nr as subject_pos, r.predicate, o.nr as object_pos from fx_relations r
        join fx_nested_entities s on s.pmid = r.pmid and s.location = r.location and s.pos = r.pos
        join fx_nested_entities o on o.pmid = r.pmid and o.location = r.location and o.pos = r.pos + 1""",
    "refresh_offsets": """
        select r.pmid, r.location as subject_location, r.pos as subject_pos, s.start_idx as subject_start_idx,
               s.end_idx as subject_end_idx, r.predicate, r.pos + 1 as object_pos, o.start_idx as object_start_idx,
               o.end_idx as object_end_idx from fx_relations r
        join fx_repaired s on s.pmid = r.pmid and s.location = r.location and s.pos = r.pos and s.pos % 5 <> 0
        join fx_repaired o on o.pmid = r.pmid and o.location = r.location and o.pos = r.pos + 1 and o.pos % 5 <> 0""",
    "entity_text": "select pmid, location, pos, text_span as slice from fx_entities",
    "training_records": f"""
        select pmid, location, md5(text) as text, entities, text_span, relations from fx_sections
        join ({_group_entities('fx_entities')}) using (pmid, location)
        join ({_group_relations('fx_relations')}) using (pmid, location)""",
    "link_exact": "select key, uri from fx_keys join fx_index using (key)",
    "link_plural": "select k.key, i.uri from fx_keys k join fx_index i on k.key = i.key || 's' and length(k.key) > 3",
    "link_substring": "select key, uri from fx_substring",
    "link_dictionary": "select pmid, location, pos, uri from fx_linked",
    "pairs_by_uri": """
        select s.pmid, s.location, count(*) filter (s.pos <> o.pos and s.uri <> o.uri) as n_pairs
        from fx_entities s join fx_entities o using (pmid, location) group by all""",
    "pairs_by_span": """
        select s.pmid, s.location,
               count(*) filter (s.pos <> o.pos and (s.start_idx <> o.start_idx or s.end_idx <> o.end_idx)) as n_pairs
        from fx_noisy s join fx_noisy o using (pmid, location) group by all""",
    "pair_predicate": """
        select pmid, pos, subject_label, object_label, s.predicate
        from fx_relations join fx_schema s using (subject_label, object_label) where is_default""",
    "schema_pairs": """
        select s.label as subject_label, o.label as object_label, count(*) as n
        from fx_entities s join fx_entities o using (pmid, location)
        where s.start_idx <> o.start_idx
          and (s.label, o.label) in (select (subject_label, object_label) from fx_schema) group by all""",
    "relation_matrix": """
        select pmid, location, count(distinct s.pos) as n_nodes, count(*) filter (s.pos <> o.pos) as n_pairs,
               17 * count(*) filter (s.pos <> o.pos) as n_cells
        from fx_entities s join fx_entities o using (pmid, location) group by all""",
    "relation_schema_valid": """
        select pmid, r.subject_label, r.predicate, r.object_label, s.predicate is not null as valid
        from fx_all_relations r left join fx_schema s
          on s.subject_label = r.subject_label and s.predicate = r.predicate and s.object_label = r.object_label""",
    "unseen_spans": """
        select text_span, count(*) as n from fx_entities where cast(pmid as bigint) % 10 = 0
        and text_span not in (select text_span from fx_entities where cast(pmid as bigint) % 10 <> 0) group by 1""",
    "unseen_predicates": """
        select predicate || 's' as predicate, count(*) as n from fx_relations
        where cast(pmid as bigint) % 10 = 0 and predicate in ('strike', 'target') group by 1""",
    "classify_pairs_in_context": f"""
        {CLASSED_PAIRS}
        select pmid, location, s_label as subject_label, o_label as object_label, predicate, count(*) as n,
            sum(s_start::bigint * 31 + o_start)::bigint as starts
        from classed group by all""",
    "predict_relations_in_context": f"""
        {CLASSED_PAIRS}
        select pmid, s_text as subject, s_label as subject_label, predicate, o_text as object, o_label as object_label, count(*) as n
        from classed where predicate <> 'no_relation' group by all
        union all
        select distinct pmid, s_uri, s_label, predicate, o_uri, o_label, null::bigint
        from classed where predicate <> 'no_relation' and s_uri <> o_uri""",
    "label_pairs": "select * exclude t from fx_pairs where label <> 'no_relation'",
    "kb_definitions": f"""
        select d.s as uri, min(d.o) as definition from fx_triples d join fx_triples l on l.s = d.s and l.p = '{RDFS_LABEL}'
        where d.p = '{DEFINITION}' and d.s in (select uri from fx_listed) group by 1""",
    "kb_synonyms": f"""
        with labels as (select s, ontology, o from fx_triples where p = '{RDFS_LABEL}' and s in (select uri from fx_listed))
        select s as uri, 0 as pos, o as surface from labels
        union all
        select t.s, 1, t.o from labels l join fx_triples t on t.s = l.s
          and t.p = case l.ontology when 'foodon' then '{SYNONYM}' when 'stato' then '{ALTERNATIVE}' else '{EXACT}' end""",
    "kb_mesh_optional": f"""
        select l.s as uri, l.o as label, n.o as definition from fx_mesh l left join fx_mesh n on n.s = l.s and n.p = '{NOTE}'
        where l.p = '{RDFS_LABEL}'""",
    "kb_upsert": """
        select uri, coalesce(c.definition, d.definition) as definition from fx_definitions d
        full join (select replace(uri, 'https:', 'http:') as uri, definition from fx_curated where definition is not null) c
        using (uri)""",
    "link_cosine_top1": """
        with scores as (
          select m.vec_id as mention_id, c.vec_id as concept_id,
                 round(list_cosine_similarity(m.embedding::double[], c.embedding::double[]), 6) as score
          from embeddings m, embeddings c where m.vec_id % 10 <> 0 and c.vec_id % 10 = 0)
        select mention_id, concept_id, score from (
          select *, row_number() over (partition by mention_id order by score desc, concept_id) as r from scores) where r = 1""",
    "group_entities": _group_entities("fx_entities"),
    "group_relations": _group_relations("fx_relations"),
    "kb_group_domain": f"""
        select domain, count(*) as n, min(uri) as first_uri from (
          select split_part(split_part(uri, '://', 2), '/', 1) as domain,
                 replace(uri, 'http://www.ebi.ac.uk/efo/', '{OBO}') as uri from fx_mixed) group by 1""",
    "kb_group_ontology": f"""
        select ontology, count(*) as n, min(uri) as first_uri from (
          select case when starts_with(uri, '{OBO}') then split_part(replace(uri, '{OBO}', ''), '_', 1)
                      when contains(uri, 'ebi.ac.uk') then 'efo' when contains(uri, 'edamontology') then 'edam' end as ontology,
                 replace(uri, 'http://www.ebi.ac.uk/efo/', '{OBO}') as uri from fx_mixed)
        where ontology is not null group by 1""",
    "kb_surface_index": "select substr(surface, 1, 8) as key, min(uri) as uri, 8::bigint as len from fx_kb group by 1",
    "kb_surface_index_whole": f"""
        select surface as key, min(least(uri, '{OBO}' || upper(right(surface, 3)) || '_' || length(surface))) as uri, length(surface)::bigint as len from fx_kb group by 1""",
    "concept_relations_pred": _derived("fx_entities"),
    "concept_relations_gold": f"""
        select distinct pmid, {CONCEPT_KEY} from fx_partial
        where subject_uri <> '' and object_label in {_in(ENTITY_LABELS)}""",
    "triple_frequency": f"select {CONCEPT_KEY}, count(distinct pmid) as frequency from fx_relations group by all",
    "entity_relation_counts": """
        select pmid, (select count(*) from fx_entities e where e.pmid = a.pmid) as n_entities,
               (select count(*) from fx_all_relations r where r.pmid = a.pmid) as n_relations from fx_articles a""",
    "top_patterns": f"""
        select subject_label, predicate, object_label, count(*) as n from (select distinct pmid, {CONCEPT_KEY} from fx_relations)
        group by all order by n desc, subject_label, predicate, object_label limit 10""",
    "relation_validity_counts": """
        select s.predicate is not null as valid, count(*) as n
        from fx_all_relations r left join fx_schema s
          on s.subject_label = r.subject_label and s.predicate = r.predicate and s.object_label = r.object_label group by 1""",
    "ambiguous_spans": """
        select substr(text_span, 1, 9) as text_span, count(distinct uri) as n_uris from fx_entities
        group by 1 having count(distinct uri) > 1""",
    "ambiguous_spans_whole": f"""
        select text_span, count(distinct uri) as n_uris from (
          select text_span, case when pos % 2 = 0 then uri else '{OBO}' || upper(right(text_span, 3)) || '_' || length(text_span) end as uri
          from fx_entities) group by 1 having count(distinct uri) > 1""",
    "unseen_rate": """
        select 'text_span' as "column", count(*) filter (text_span not in (
                 select text_span from fx_entities where cast(pmid as bigint) % 10 <> 0)) as n_unseen, count(*) as n_total
        from fx_entities where cast(pmid as bigint) % 10 = 0
        union all
        select 'predicate', count(*) filter (predicate not in (
                 select predicate from fx_relations where cast(pmid as bigint) % 10 <> 0)), count(*)
        from fx_relations where cast(pmid as bigint) % 10 = 0""",
    "label_distribution": "select label, count(*) as n from fx_examples group by 1 order by n desc, label limit 5",
    "class_weights": f"""
        select label, count(e.pmid) as n,
               round((select count(*) from fx_examples) / (18 * greatest(count(e.pmid), 1)), 6) as weight
        from (select unnest({CLASS_LIST}) as label) left join fx_examples e using (label) group by 1""",
    "distinct_locations": "select distinct location from fx_entities",
    "re_mention_relations": POSITIVE,
    "re_concept_relations": POSITIVE_CONCEPTS,
    "relation_matrix_filled": """
        select distinct pmid, location, s_token, o_token, predicate, 1.0::double as score from fx_matrix_found where found""",
    "relation_matrix_uri": """
        select pmid, location, subject_uri, object_uri, predicate, max(found::integer)::double as score
        from fx_matrix_found group by all""",
    "score_per_class": f"select {CLASS_COLUMNS} from ({_scores('fx_entities', 'fx_pred_entities', NER, 'label')})",
    "score_summary": _summary(_scores("fx_entities", "fx_pred_entities", NER, "label")),
    "score_ner": _summary(_scores(
        "(select * from fx_entities where cast(pmid as bigint) % 10 = 0)",
        "(select * from fx_pred_entities where cast(pmid as bigint) % 10 = 0)", NER, "label")),
    "score_linking": f"select {CLASS_COLUMNS} from ({_scores('fx_entities', 'fx_pred_entities', LINKING, 'label')})",
    "score_mention_re": f"select {CLASS_COLUMNS} from ({_scores('fx_relations', 'fx_pred_relations', MENTION_RE, 'predicate')})",
    "score_concept_re": f"select {CLASS_COLUMNS} from ({_scores('fx_relations', 'fx_pred_relations', CONCEPT_RE, 'predicate')})",
    "score_classifier": f"""
        with classes as (select unnest({PREDS}) as class),
        counts as (
          select class, (select count(*) from fx_scored where predicate = class and prediction = class)::double as tp,
                 (select count(*) from fx_scored where predicate <> class and prediction = class)::double as fp,
                 (select count(*) from fx_scored where predicate = class and prediction <> class)::double as fn from classes)
        select round(avg(case when tp > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end), 6) as macro_f1,
               round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) as micro_f1 from counts""",
    "score_models": " union all ".join(
        f"select '{task}' as task, * from ({_summary(_scores(gold, pred, key, cls, '(select model from fx_models union all select 3)'))})"
        for task, gold, pred, key, cls in (
            ("ner", "fx_entities", "fx_pred_entities", NER, "label"),
            ("linking", "fx_entities", "fx_pred_entities", LINKING, "label"),
            ("mention_re", "fx_relations", "fx_pred_relations", MENTION_RE, "predicate"),
            ("concept_re", "fx_relations", "fx_pred_relations", CONCEPT_RE, "predicate"),
        )
    ),
    "bootstrap_tiers": """
        with tiers as (
          select pmid, location, ['gold', 'silver_a', 'silver_b', 'bronze', 'bronze'][cast(pmid as bigint) % 5 + 1] as annotator
          from fx_sections),
        ranked as (select *, row_number() over (partition by annotator
                     order by md5(concat_ws('|', '1337', pmid, location)), pmid, location) as r from tiers),
        sizes as (select annotator, count(*) as n, cast(round_even(count(*) * case annotator when 'gold' then 1.5
                    when 'silver_a' then 1.0 when 'silver_b' then 0.75 else 0.25 end, 0) as bigint) as target
                  from tiers group by 1),
        draws as (select annotator, n, unnest(range(target)) as draw from sizes)
        select pmid, location, annotator, draw from (
          select annotator, draw,
                 cast('0x' || substr(md5('1337|' || annotator || '|' || draw), 1, 15) as bigint) % n + 1 as r from draws)
        join ranked using (annotator, r)""",
    "split_by_doc": """
        with ids as (select distinct pmid from fx_sections),
        ranked as (select pmid, row_number() over (order by md5('1337|' || pmid)) as r, count(*) over () as n from ids)
        select pmid, case when r <= greatest(1, n // 10) then 'dev' else 'train' end as split from ranked""",
    "split_rows": """
        select pmid, location, pos, case when r <= ceil(n * 0.1) then 'test' else 'train' end as split from (
          select *, row_number() over (order by md5(concat_ws('|', '1337', pmid, location, pos)), pmid, location, pos) as r,
                 count(*) over () as n from fx_entities)""",
    "negative_sampling": """
        select pmid, location, count(*) filter (label <> 'no_relation') as n_positive,
               count(*) filter (label = 'no_relation') as n_negative,
               min(s_pos || '-' || o_pos) filter (label = 'no_relation') as first_negative
        from fx_examples group by all""",
    "re_examples": "select * from fx_examples",
    "alias_pairs": """
        select a.uri, a.surface as alias_a, b.surface as alias_b from fx_kb a join fx_kb b
        on a.uri = b.uri and a.surface < b.surface""",
    "alias_definition_pairs": """
        select uri, surface as mention, coalesce(definition, '') as context, 1.0::double as label
        from fx_kb left join fx_definitions using (uri)""",
    "learn_gazetteer_labels": "select surface, label from fx_gazetteer",
    "tag_gazetteer_sections": "select * from fx_tagged",
    "link_trigram_top1": "select key, uri, score from fx_nearest",
    "link_trigram_exact": "select key, uri, score from fx_gram_nearest",
    "annotate_and_link_exact": f"""
        select pmid, 0 as part, coalesce(entities, '') as entities from fx_articles left join (
          {_per_article('select t.*, n.uri from fx_tagged t join fx_tag_nearest n on n.key = lower(t.text_span)',
                        SUBMITTED, 'location desc, start_idx', 'entities')}) using (pmid)""",
    "annotate_and_link": f"""
        select pmid, 0 as part, coalesce(entities, '') as entities from fx_articles left join (
          {_per_article('select t.*, n.uri from fx_tagged t join fx_nearest n on n.key = lower(t.text_span)',
                        SUBMITTED, 'location desc, start_idx', 'entities')}) using (pmid)""",
    "preprocess_corpus": f"""
        select pmid, location, ['gold', 'silver_a', 'silver_b', 'bronze', 'bronze'][cast(pmid as bigint) % 5 + 1] as annotator,
               md5(text) as text, entities, text_span, relations from fx_sections
        join ({_group_entities('fx_entities')}) using (pmid, location)
        join ({_group_relations('fx_relations')}) using (pmid, location)""",
    "concept_relation_report": f"""
        select {CONCEPT_KEY}, count(*) as frequency
        from ({_derived('(select * from fx_linked where uri is not null)')}) group by all""",
    "build_kb": f"""
        with domains as (select uri, split_part(split_part(uri, '://', 2), '/', 1) as domain,
                                replace(uri, 'http://www.ebi.ac.uk/efo/', '{OBO}') as obo from fx_mixed),
        onto as (select obo as uri from domains where domain in ('purl.obolibrary.org', 'www.ebi.ac.uk', 'edamontology.org')),
        labels as (select s, ontology, o from fx_triples where p = '{RDFS_LABEL}' and s in (select uri from onto)),
        names as (select replace(split_part(uri, '/', -1), '_', '') as id, max(text_span) as term from fx_entities group by uri),
        records as (
          select uri, 0 as pos, unnest([upper(term), term]) as surface, 'a gene' as definition from domains
          join names on id = split_part(uri, '/', -1) where domain = 'www.ncbi.nlm.nih.gov'
          union all select uri, 0, term, '' from domains join names on id = split_part(uri, '/', -1) where domain = 'snomed.info'
          union all select l.s, 0, l.o, n.o from fx_mesh l left join fx_mesh n on n.s = l.s and n.p = '{NOTE}'
                    where l.p = '{RDFS_LABEL}'
          union all select replace(uri, 'purl.obolibrary.org/obo', 'w3id.org'), 0, name, definition from fx_curated
                    where name is not null),
        ontology_rows as (
          select s as uri, 0 as pos, o as surface from labels
          union all
          select t.s, 1, t.o from labels l join fx_triples t on t.s = l.s
            and t.p = case l.ontology when 'foodon' then '{SYNONYM}' when 'stato' then '{ALTERNATIVE}' else '{EXACT}' end)
        select r.uri, pos, surface, d.definition from ontology_rows r
        left join (select s as uri, min(o) as definition from fx_triples where p = '{DEFINITION}' group by 1) d using (uri)
        union all select uri, pos, surface, definition from records""",
    "ner_training_set": """
        with nodes as (select pmid, location, start_idx from fx_snapped where end_idx > start_idx),
        shape as (select pmid, location, count(*) as n_nodes from nodes group by all),
        starts as (select pmid, location, raw_start, arg_max(start_idx, pos) as token from fx_snapped group by all),
        filled as (
          select pmid, location, count(distinct (s_token, o_token, predicate)) as n_filled from (
            select r.pmid, r.location, s.token as s_token, o.token as o_token, predicate from fx_matrix_rels r
            join starts s on s.pmid = r.pmid and s.location = r.location and s.raw_start = r.s_raw
            join starts o on o.pmid = r.pmid and o.location = r.location and o.raw_start = r.o_raw
            where s.token <> o.token) group by all)
        select pmid, location, n_nodes, n_nodes * (n_nodes - 1) as n_pairs, n_nodes * (n_nodes - 1) * 17 as n_cells,
               coalesce(n_filled, 0) as n_filled from shape left join filled using (pmid, location)""",
}
# Views some queries read differently.
OVERRIDES = {"negative_sampling": {"gold_relations": "select * from fx_relations where location = 'abstract'"}}
OVERRIDES["annotate_and_link"] = {"fx_mention_keys": "select distinct lower(text_span) as key from fx_tagged"}
for _name in ("concept_relation_report", "link_dictionary"):
    OVERRIDES[_name] = {"fx_keys": "select distinct text_span as key from fx_entities"}


def with_views(sql: str, overrides: dict[str, str] | None = None) -> str:
    """The query with the views it needs as common table expressions."""
    views = VIEWS | (overrides or {})
    needed: set[str] = set()

    def need(text: str) -> None:
        for name in views:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                need(views[name])

    need(sql)
    order: list[str] = []

    def place(name: str) -> None:
        for other in views:
            if other != name and other in needed and other not in order and re.search(rf"\b{other}\b", views[name]):
                place(other)
        if name not in order:
            order.append(name)

    for name in views:
        if name in needed:
            place(name)
    if not order:
        return sql
    ctes = ",\n".join(f"{name} as materialized ({views[name]})" for name in order)
    inner = sql.strip()
    # A query that starts its own WITH has its expressions appended to the views.
    recursive = ""
    match = re.match(r"(?i)with\s+(recursive\s+)?", inner)
    if match:
        recursive = "recursive " if match.group(1) else ""
        return f"with {recursive}{ctes},\n{inner[match.end():]}"
    return f"with {ctes}\n{inner}"


def oracles() -> dict[str, str]:
    return {name: with_views(sql, OVERRIDES.get(name)) for name, sql in ORACLES.items()}
