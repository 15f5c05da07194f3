"""Registered queries of the operators, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from filecairn.llm.common import read


def op1_bm25_packing(spark, sf_dir):
    from filecairn.llm.bm25_packing import pack

    return pack(read(spark, sf_dir, "documents"))


def op2_factorization(spark, sf_dir):
    from filecairn.llm.factorization import score_quality

    return score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_mixing(spark, sf_dir):
    from filecairn.llm.mixing import mix

    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_impact_search(spark, sf_dir):
    from filecairn.llm.impact_search import top_by_inner_product

    return top_by_inner_product(read(spark, sf_dir, "embeddings"))


def op5_sanitize(spark, sf_dir):
    from filecairn.llm.sanitize import find_personal_data

    return find_personal_data(read(spark, sf_dir, "documents"))


def op6_fingerprints(spark, sf_dir):
    from filecairn.llm.fingerprints import fingerprint_documents

    return fingerprint_documents(read(spark, sf_dir, "documents"))


def op7_sharding(spark, sf_dir):
    from filecairn.llm.sharding import shard_documents

    return shard_documents(read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_gru_language(spark, sf_dir):
    from filecairn.llm.gru_language import predict

    return predict(read(spark, sf_dir, "documents"))


def op10_hyperminhash(spark, sf_dir):
    from filecairn.llm.hyperminhash import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"))


def op9_licenses(spark, sf_dir):
    from filecairn.llm.licenses import scan_licenses

    return scan_licenses(read(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark, sf_dir):
    from filecairn.llm.merkle_manifest import verify

    return verify(read(spark, sf_dir, "documents"))


def op12_prefix_bpe(spark, sf_dir):
    from filecairn.llm.prefix_bpe import round_trip

    return round_trip(read(spark, sf_dir, "documents"))


def op13_stratified_search(spark, sf_dir):
    from filecairn.llm.stratified_search import rank_documents

    return rank_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_bm25_packing, op2_factorization, op3_mixing, op4_impact_search, op5_sanitize,
    op6_fingerprints, op7_sharding, op8_gru_language, op9_licenses, op10_hyperminhash, op11_merkle_manifest,
    op12_prefix_bpe, op13_stratified_search)}
ORACLE: dict[str, str] = {
    "op4_impact_search": """
        with good as (
            select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
            from embeddings
            where vec_id is not null and embedding is not null
              and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ),
        scored as (
            select q.vec_id as query_id, c.vec_id,
                   cast(coalesce(list_sum(list_transform(
                       range(1, least(len(q.v), len(c.v)) + 1), lambda i: q.v[i] * c.v[i])), 0) as bigint) as score
            from good q join good c on q.vec_id <> c.vec_id
            where q.vec_id % 50 = 0
        )
        select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank,
               vec_id, score
        from scored
        qualify row_number() over (partition by query_id order by score desc, vec_id) <= 5
    """,
    "op11_merkle_manifest": """
        with recursive steps as (
            select doc_id, lang, coalesce('=' || lang, '') as tree,
                   coalesce(strlen(cast(doc_id as varchar)) || ':' || doc_id, '-')
                       || coalesce(strlen(source) || ':' || source, '-')
                       || coalesce(strlen(lang) || ':' || lang, '-') as head,
                   coalesce(strlen(text) || ':' || text, '-') as tail, n_chars,
                   list_reduce(
                       list_prepend(4294967295::ubigint, list_transform(
                           range(1, length(cast(doc_id as varchar)) + 1),
                           lambda k: unicode(substr(cast(doc_id as varchar), k, 1))::ubigint)),
                       lambda crc, byte: list_reduce(
                           list_prepend(xor(crc, byte), list_transform(range(8), lambda k: 0::ubigint)),
                           lambda s, z: xor(s >> 1, 3988292384::ubigint * (s & 1::ubigint)))) as unsealed
            from documents
        ),
        hashed as (
            select doc_id, tree,
                   sha256(head || coalesce(strlen(cast(n_chars as varchar)) || ':' || n_chars, '-') || tail) as leaf,
                   case when xor(unsealed, 4294967295::ubigint) % 7 = 0 and n_chars is not null
                        then sha256(head || strlen(cast(n_chars + 1 as varchar)) || ':' || (n_chars + 1) || tail)
                   end as forged
            from steps
        ),
        leaves as (
            select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as pos,
                   count(*) over (partition by tree) as n
            from hashed
        ),
        nodes as (
            select tree, 0 as level, pos, n as width, leaf as hash from leaves
            union all
            select tree, level + 1, pos // 2, (width + 1) // 2, sha256(string_agg(hash, '' order by pos))
            from nodes where width > 1 group by tree, level, pos // 2, width
        ),
        subroots as (
            select tree, hash as subroot, row_number() over (order by tree) - 1 as pos, count(*) over () as n
            from nodes where width = 1
        ),
        upper as (
            select 0 as level, pos, n as width, subroot as hash from subroots
            union all
            select level + 1, pos // 2, (width + 1) // 2, sha256(string_agg(hash, '' order by pos))
            from upper where width > 1 group by level, pos // 2, width
        ),
        folds as (
            select doc_id, tree, leaf, 0 as level, pos, n as width, coalesce(forged, leaf) as acc, '' as proof from leaves
            union all
            select f.doc_id, f.tree, f.leaf, f.level + 1, f.pos // 2, (f.width + 1) // 2,
                   sha256(if(f.pos % 2 = 0, f.acc || coalesce(s.hash, ''), s.hash || f.acc)),
                   f.proof || coalesce(s.hash, '')
            from folds f left join nodes s
              on s.tree = f.tree and s.level = f.level and s.pos = if(f.pos % 2 = 0, f.pos + 1, f.pos - 1)
            where f.width > 1
        ),
        tops as (
            select f.doc_id, f.leaf, r.subroot, 0 as level, r.pos, r.n as width, f.acc, f.proof
            from folds f join subroots r using (tree) where f.width = 1
            union all
            select f.doc_id, f.leaf, f.subroot, f.level + 1, f.pos // 2, (f.width + 1) // 2,
                   sha256(if(f.pos % 2 = 0, f.acc || coalesce(s.hash, ''), s.hash || f.acc)),
                   f.proof || coalesce(s.hash, '')
            from tops f left join upper s
              on s.level = f.level and s.pos = if(f.pos % 2 = 0, f.pos + 1, f.pos - 1)
            where f.width > 1
        )
        select doc_id, leaf, subroot, hash as root, sha256(proof) as proof_sha256, acc as folded_root,
               acc = hash as verified
        from tops, (select hash from upper where width = 1) where tops.width = 1
    """,
    "op13_stratified_search": r"""
        with doc_terms as (
            select row_number() over () as doc, doc_id, unnest(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
            from documents
        ),
        item_terms as (
            select distinct item_id, unnest(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
            from benchmark
        ),
        sizes as (select doc, any_value(doc_id) as doc_id, count(*) as n from doc_terms group by doc),
        whole as (select count(*) as big_n, cast(sum(n) as bigint) as big_l from sizes),
        tfs as (
            select doc, term, count(*) as tf from doc_terms
            where term in (select term from item_terms) group by doc, term
        ),
        weights as (
            select term, cast(floor(1000 * ln(cast(2 * (select big_n from whole) + 2 as double) / (2 * count(*) + 1))) as bigint) as w
            from tfs group by term
        ),
        scored as (
            select i.item_id, t.doc, cast(sum(w.w * ((1000000000 * t.tf) // (1000 * t.tf
                   + 8 * (10 + (90 * s.n * big_n) // big_l)))) as bigint) as score
            from item_terms i join weights w using (term) join tfs t using (term) join sizes s on s.doc = t.doc, whole
            group by i.item_id, t.doc
        ),
        ranked as (
            select item_id, row_number() over (partition by item_id order by score desc, doc_id nulls last) as rank,
                   doc_id, score
            from scored join sizes using (doc) where score > 0
        )
        select item_id, cast(rank as integer) as rank, doc_id, score from ranked where rank <= 10
    """,
}
