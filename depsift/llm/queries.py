"""Queries of the llm operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depsift.llm import embeddings, exact, hard_negatives, html_main, langid, license_scan, mixing, packing, prefix_trie, sharding, simhash, suffixes, token_counts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_sequences(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, distance=4)
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op4_count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op5_extract_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract_main(table(spark, sf_dir, "pages"))


def op6_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(table(spark, sf_dir, "documents"))


def op8_scan_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op10_identify_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.predict(docs, langid.train(docs))


def op11_mine_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine_hard_negatives(vectors.withColumn("label", shifted), F.col("vec_id") % 100 == 0)


def op12_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard_documents(table(spark, sf_dir, "documents"), shards=8)
    law, grown = F.lit("rows").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return found.select("doc_id", "size", "text_crc32", law, "shard", "slot", grown)


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.numbered_turns(table(spark, sf_dir, "conversations"))
    nodes = prefix_trie.prefix_trie(prefix_trie.with_shared_heads(turns))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


#: CRC-32 in SQL: the table of its 256 remainders, and an expression over it (`crc_table` must be in the from clause).
CRC_TABLE = """
        remainders as (
            select n, list_reduce(range(8), lambda a, i: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end, n) as v from range(256) r(n)
        ), crc_table as (select list(v order by n) as crc from remainders)"""
CRC = """xor(list_reduce(list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::bigint),
                lambda a, x: xor(a >> 8, crc[(xor(a & 255, x) + 1)::int]), 4294967295::bigint), 4294967295)"""

SQL = {
    "op11_mine_hard_negatives": """
        with v as (
            select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as q
            from embeddings
            where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), scored as (
            select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same, list_dot_product(a.q, b.q)::bigint as score
            from v a join v b on a.vec_id <> b.vec_id and len(a.q) = len(b.q) where a.vec_id % 100 = 0
        ), positives as (
            select anchor_id, other_id as positive_id, score as positive_score from scored where same
            qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5
        )
        select p.anchor_id, p.positive_id, row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.other_id)::int as rank,
               s.other_id as negative_id, p.positive_score, s.score as negative_score
        from positives p join scored s on s.anchor_id = p.anchor_id and not s.same
        where 80 * p.positive_score <= 100 * s.score and s.score <= p.positive_score
        qualify rank <= 5
    """,
    "op12_shard_documents": """
        with""" + CRC_TABLE + """, keyed as (
            select doc_id, strlen(coalesce(text, '')) + 1 as size, """ + CRC.format(text="coalesce(text, '')") + """ as text_crc32,
                   coalesce('=' || source, '-') as stratum, md5('11/' || coalesce('=' || doc_id::varchar, '-' || coalesce(text, ''))) as digest
            from documents, crc_table
        ), ranked as (
            select *, (2 * row_number() over (partition by stratum order by digest, doc_id, text_crc32) - 1) / (2 * count(*) over (partition by stratum))::double as fraction
            from keyed
        ), placed as (
            select *, row_number() over (order by fraction, stratum, digest, doc_id, text_crc32) - 1 as place, count(*) over () as total from ranked
        ), cut as (
            select *, place * 8 // total as shard from placed
        )
        select doc_id, size::bigint as size, text_crc32, 'rows' as law, shard::int as shard,
               row_number() over (partition by shard order by place) - 1 as slot, null::int as grown_shard
        from cut
    """,
    "op13_conversation_trie": """
        with""" + CRC_TABLE + """, own as (
            select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
                   row_number() over (partition by conv_id order by turn asc nulls first) as pos
            from conversations where conv_id is not null
        ), convs as (
            select conv_id as c, conv_id - conv_id % 5 as base, """ + CRC.format(text="conv_id::varchar") + """ % 9 as h
            from (select distinct conv_id from conversations where conv_id is not null), crc_table
        ), rebuilt as (
            select c, list({'role': role, 'text': text} order by part, pos) filter (where pos is not null) as turns from (
                select c, 0 as part, pos, role, text from convs left join own on own.conv_id = base and pos <= h
                union all select c, 1, pos, role, text from convs join own on own.conv_id = c and pos > h
            ) group by c
        ), paths as (
            select c, coalesce(turns, []) as turns, coalesce(len(turns), 0) as n from rebuilt
        ), members as (
            select c, d as depth, turns[1:d] as path, d = n as ended from paths, unnest(range(n + 1)) r(d)
        ), nodes as (
            select depth, path, min(c) as conv_id, count(*) as n_convs,
                   sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (where ended), '')) as ends_sha256,
                   case when depth > 0 then (count(*) - 1) * strlen(path[depth].text) else 0 end as saved
            from members group by depth, path
        ), linked as (
            select n.*, p.conv_id as parent_conv_id, (select count(*) from nodes k where k.depth = n.depth + 1 and k.path[1:n.depth] = n.path) as n_children
            from nodes n left join nodes p on p.depth = n.depth - 1 and p.path = n.path[1:n.depth - 1]
        )
        select a.conv_id, a.depth, a.parent_conv_id, a.n_convs, a.n_children, sum((b.n_children = 0)::int)::bigint as n_leaves,
               sum(b.saved)::bigint as saved_tokens, a.ends_sha256
        from linked a join linked b on b.depth >= a.depth and b.path[1:a.depth] = a.path
        group by a.conv_id, a.depth, a.parent_conv_id, a.n_convs, a.n_children, a.ends_sha256
    """,
    "op9_embedding_near_dedup": """
        with recursive v as (
            select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings
        ), ok as (
            select *, sqrt(list_sum(list_transform(e, lambda x: x * x))) as norm from v
            where label is not null and e is not null and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0
              and len(list_filter(e, lambda x: x <> 0)) > 0
        ), links as (
            select a.vec_id as a, b.vec_id as b from ok a join ok b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
            where list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98
        ), reach(node, other) as (
            select vec_id, vec_id from embeddings union select r.node, l.b from reach r join links l on r.other = l.a
        ), roots as (
            select node, min(other) as component_id from reach group by node
        ), counts as (
            select a, count(*) as n_links from links group by a
        )
        select e.vec_id, coalesce(c.n_links, 0) as n_links, r.component_id, e.vec_id = r.component_id as kept
        from embeddings e join roots r on r.node = e.vec_id left join counts c on c.a = e.vec_id
    """,
    "op7_exact_dedup": """
        select doc_id,
               max(doc_id) over (partition by coalesce(text, '')) as keep_id,
               count(*) over (partition by coalesce(text, '')) as group_size,
               doc_id = max(doc_id) over (partition by coalesce(text, '')) as kept,
               sha256(coalesce(text, '')) as text_sha256
        from documents
    """,
    "op3_mix_sources": r"""
        with sized as (
            select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents
        ), classed as (
            select *, length(bin(size)) * 16 + (size >> greatest(length(bin(size)) - 4, 0)) as cls, ('0x' || substr(md5(doc_id::varchar), 1, 8))::bigint % greatest(64, (select count(*) from documents) // 50000) as bucket from sized
        ), ranked as (
            select *, row_number() over (partition by source order by cls, bucket, size, doc_id) as r from classed
        ), sums as (
            select source, sum(size)::double as source_size from sized group by source
        ), weighed as (
            select *, [5.0, 2.0, 1.0][((row_number() over (order by source asc nulls last) - 1) % 3) + 1]::double as weight from sums
        ), ratios as (
            select *, source_size * 2.0::double as cap, source_size * 2.0::double / weight as ratio from weighed
        ), filled as (
            select *, sum(cap) over w as caps, sum(weight) over () - sum(weight) over w as rest, sum(source_size) over () * 1.5::double as total
            from ratios window w as (order by ratio, source asc nulls last range between unbounded preceding and current row)
        ), marked as (
            select *, caps + ratio * rest <= total as capped from filled
        ), levels as (
            select *, (total - coalesce(sum(case when capped then cap end) over (), 0.0)) / sum(case when not capped then weight end) over () as level from marked
        ), targets as (
            select source, source_size, case when capped then cap else weight * level end as target,
                   ('0x' || substr(md5('7/' || coalesce('=' || source, '-')), 1, 8))::bigint::double / 4294967296.0::double as u
            from levels
        ), placed as (
            select r.*, t.source_size, t.target, case when t.source_size > 0 then t.target / t.source_size else 0 end as rate, t.u
            from ranked r join targets t on r.source is not distinct from t.source
        )
        select doc_id, size, source_size::bigint as source_size, target,
               ((floor(r * rate + u) - floor((r - 1) * rate + u)) * size)::bigint as taken
        from placed
    """,
}


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in SQL.items() if v}
