"""The queries of this package, each over the whole of its table."""

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm.credentials import secret_report
from spanloom.llm.exact import exact_duplicates
from spanloom.llm.jaccard import jaccard_components
from spanloom.llm.language import fit_language_model, held_out, identify_languages
from spanloom.llm.mixing import mix_sources, words_taken
from spanloom.llm.neardup import near_duplicates
from spanloom.llm.pages import main_texts
from spanloom.llm.phrases import collocations
from spanloom.llm.pieces import piece_ids
from spanloom.llm.prefixes import prefix_trie
from spanloom.llm.sharding import shard_rows
from spanloom.llm.topk import top_inner_products
from spanloom.llm.warc import archive_report
from spanloom.staging import staging_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(_table(spark, sf_dir, "pages"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_language_model(docs)
    marked = docs.select("doc_id", "text", held_out().alias("held_out"))
    return identify_languages(marked, model).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(_table(spark, sf_dir, "documents")).drop("source")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(_table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = words_taken(*mix_sources(_table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(_table(spark, sf_dir, "embeddings"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "embeddings"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{staging_folder(spark)}/spanloom-warc-{uuid4().hex}"
    return archive_report(spark, _table(spark, sf_dir, "pages"), folder)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return piece_ids(docs).select("doc_id", "n_tokens", "ids", "parity", "round_trip")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(_table(spark, sf_dir, "conversations")).drop("digest")


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_table(spark, sf_dir, "documents"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_html_extraction, op2_language_id, op3_sharding, op4_jaccard_join, op5_secret_scan, op6_mixing, op7_topk, op8_near_duplicates,
        op9_warc, op10_sentencepiece, op11_prefix_trie, op12_exact_dedup, op13_phrases,
    )
}

#: What SQL can express.
ORACLES = {
    "op7_topk": """
        with v as (
            select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings
            where embedding is not null and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))
        ), s as (
            select q.vec_id as query_id, c.vec_id as vec_id,
                list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::bigint as score
            from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id and len(q.v) = len(c.v)
        )
        select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::integer as rank, vec_id, score from s
        qualify rank <= 10""",
    "op9_warc": """
        with p as (
            select page_id, coalesce(html, '') as body, sha256(coalesce(html, '')) as digest, strlen(coalesce(html, ''))::bigint as n from pages
        ), f as (select digest as d, min(page_id) as first from p where n >= 100 group by digest)
        select page_id, n as payload_bytes, digest as payload_digest,
            case when first is null or first = page_id then 'response' else 'revisit' end as record_type,
            case when first <> page_id then first end as refers_to
        from p left join f on digest = d""",
    "op11_prefix_trie": r"""
        with crc_table as (
            select list(list_reduce([n::ubigint, 0, 0, 0, 0, 0, 0, 0, 0],
                lambda x, step: case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end) order by n) as crcs
            from range(256) r(n)
        ), own as (
            select conv_id as c, role, text, sha256(length(role) || ':' || role || text) as digest,
                row_number() over (partition by conv_id order by turn nulls first, sha256(length(role) || ':' || role || text)) - 1 as place
            from (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null)
        ), convs as (
            select c, c - c % 20 as base, xor(list_reduce(
                    list_concat([4294967295::ubigint], list_transform(range(1, length(c::varchar) + 1), lambda i: ascii(substr(c::varchar, i, 1))::ubigint)),
                    lambda x, b: xor(x // 256, crcs[(xor(x, b) % 256 + 1)::bigint])), 4294967295) % 4 as h
            from (select distinct c from own), crc_table
        ), turns as (
            select convs.c, place, text, digest from convs join own on own.c = base where place < h
            union all
            select convs.c, place + 1000000, text, digest from convs join own using (c) where place >= h
        ), prefixes as (
            select c, row_number() over w as depth, string_agg(digest, '') over w as prefix,
                len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as words
            from turns window w as (partition by c order by place)
            union all
            select c, 0, '', 0 from convs
        ), ends as (select c, max(depth) as n from prefixes group by c
        ), nodes as (
            select prefix, min(c) as conv_id, depth, count(*) as n_convs, any_value(words) as words,
                sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (where depth = n), '')) as ends_sha256
            from prefixes join ends using (c) group by prefix, depth
        ), children as (select left(prefix, -64) as parent, count(*) as n from nodes where depth > 0 group by 1)
        select v.conv_id, v.depth::bigint as depth, p.conv_id as parent_conv_id, v.n_convs, coalesce(k.n, 0) as n_children,
            count(*) filter (where l.parent is null) as n_leaves, sum((u.n_convs - 1) * u.words)::bigint as saved_tokens, v.ends_sha256
        from nodes v join nodes u on starts_with(u.prefix, v.prefix) left join children l on l.parent = u.prefix
            left join children k on k.parent = v.prefix left join nodes p on v.depth > 0 and p.prefix = left(v.prefix, -64)
        group by v.conv_id, v.depth, p.conv_id, v.n_convs, k.n, v.ends_sha256""",
    "op12_exact_dedup": r"""
        with t as (
            select doc_id, length(coalesce(text, '')) as points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as body
            from documents
        )
        select doc_id, first_value(doc_id) over g as keep_id, count(*) over (partition by body) as group_size,
            doc_id = first_value(doc_id) over g as kept, sha256(body) as text_sha256
        from t window g as (partition by body order by points desc, doc_id)""",
    "op13_phrases": r"""
        with pieces as materialized (
            select coalesce(lang, 'und') as lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as w
            from (
                select lang, unnest(regexp_split_to_array(
                    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
                from documents
            )
        ), f as materialized (
            select lang, m, phrase, count(*) as a from (
                select lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda s: array_to_string(w[s : s + m - 1], ' '))) as phrase
                from pieces, range(1, 5) r(m)
            ) group by all having count(*) >= 30
        ), halves as (
            select lang, phrase, a, k, array_to_string(string_split(phrase, ' ')[1 : k], ' ') as head,
                array_to_string(string_split(phrase, ' ')[k + 1 :], ' ') as rest
            from f, range(1, 4) t(k) where k < m
        ), cuts as (
            select h.lang, h.phrase, h.a, k, x.a as l, y.a as r, (2000000::hugeint * h.a // (x.a::hugeint + y.a))::bigint as score
            from halves h join f x on x.lang = h.lang and x.phrase = head join f y on y.lang = h.lang and y.phrase = rest
        ), low as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1
        ), inside as (
            select lang, array_to_string(string_split(phrase, ' ')[s : s + j - 1], ' ') as phrase, max(a) as longer
            from f, range(2, 4) t(j), range(1, 4) u(s) where j < m and s + j - 1 <= m group by 1, 2
        )
        select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
        from low left join inside using (lang, phrase) join (select lang, sum(len(w))::bigint as n from pieces group by lang) using (lang)
        where longer is null or 100::hugeint * longer < 80::hugeint * a
        qualify rank <= 2000""",
}
