"""The registered queries of the training-data operators, thin digests over the operators' own outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    ann_projection,
    chat_collapse,
    exact_topk,
    histogram_packing,
    merkle_manifest,
    ngram_join,
    rule_quality,
    simhash_trie,
    sp_dropout,
    spelling_variants,
    token_sst,
    toxicity_crf,
    warc_transactions,
)
from .common import table


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings")
    return exact_topk.search(embeddings, embeddings.where("vec_id % 100 = 0"))


OP8_SQL = """
with v as (
    select vec_id, [cast(floor(1024 * cast(x as double)) as bigint) for x in embedding] as vector
    from embeddings
    where embedding is not null and vec_id is not null
      and len([x for x in embedding if x is null or not isfinite(x)]) = 0
), scored as (
    select q.vec_id as query_id, v.vec_id, cast(list_dot_product(cast(q.vector as double[]), cast(v.vector as double[])) as bigint) as score
    from v as q, v where q.vec_id % 100 = 0 and q.vec_id <> v.vec_id
), ranked as (
    select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from scored
)
select query_id, rank, vec_id, score from ranked where rank <= 10
"""


def op9_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = warc_transactions.write_and_read(table(spark, sf_dir, "pages"))
    revisited = F.regexp_extract("response.refers_to", r"response:(-?\d+)[.>]", 1)
    return captures.select(
        F.col("metadata.capture_id").alias("page_id"),
        F.col("held_bytes").alias("payload_bytes"),
        F.col("held_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        F.when(F.col("response.refers_to").isNotNull(), revisited.try_cast("long")).alias("refers_to"),
    )


def op10_rule_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = rule_quality.fit(documents, table(spark, sf_dir, "labels"))
    scored = rule_quality.score(documents.select("doc_id", "text"), model, "score")
    return scored.select("doc_id", rule_quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op1_sp_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_dropout.encode(table(spark, sf_dir, "documents")).select("doc_id", "n_tokens", "ids_crc32", "lossless")


def op2_projection_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings")
    return ann_projection.search(embeddings, embeddings.where("vec_id % 20 = 0"))


def op3_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    field = toxicity_crf.fit(documents, table(spark, sf_dir, "labels"))
    scored = toxicity_crf.score(documents.select("doc_id", "text"), field, column="score")
    return scored.select("doc_id", rule_quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_chat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_collapse.collapse(table(spark, sf_dir, "conversations"))


OP4_SQL = """
with numbered as (
    select *, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as pos from conversations
), whole as (
    select conv_id, count(*) as n, list({'role': role, 'text': text} order by pos) as turns,
           string_agg('<|im_start|>' || replace(coalesce(role, ''), '<|im_', '<|_im_') || chr(10)
                      || replace(coalesce(text, ''), '<|im_', '<|_im_') || '<|im_end|>' || chr(10), '' order by pos) as rendered
    from numbered group by conv_id
), different as (
    select turns, n, rendered, min(conv_id) as conv_id, count(*) as copies from whole group by turns, n, rendered
)
select conv_id, n as n_turns, copies, rendered from different as d
where not exists (select 1 from whole as w where w.n > d.n and w.turns[1:d.n] = d.turns)
"""


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op6_token_sst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_sst.write_and_read(table(spark, sf_dir, "documents"))


def op7_histogram_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram_packing.pack_documents(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc_id, source, lang, n_chars, text = (F.col(c) for c in merkle_manifest.FIELDS)
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(F.crc32(doc_id.cast("string")) % 3 == 0, merkle_manifest.leaf(doc_id, source, lang, n_chars, lowered))
    made = merkle_manifest.manifest(table(spark, sf_dir, "documents"), carried={"tampered": tampered})
    found = made.select(
        "doc_id", "leaf", "subroot", "root", merkle_manifest.proof(F.col("path")).alias("proof_sha256"), merkle_manifest.folded(F.col("path"), F.coalesce("tampered", "leaf")).alias("folded_root")
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


#: crc32 of a list of bytes, by a table that `crc_table` holds.
CRC_TABLE = """
    select list(c order by b) as crc_table from (
        select b, list_reduce(list_prepend(b, range(8)), lambda x, i : case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end) as c
        from (select unnest(range(256)) as b)
    )
"""
CRC = "xor(list_reduce(list_prepend(4294967295, {bytes}), lambda c, b : xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])), 4294967295)"

OP11_FIELDS = " || ".join(f"coalesce(strlen(cast({{{c}}} as varchar)) || ':' || {{{c}}}, '-')" for c in ("doc_id", "source", "lang", "n_chars", "text"))
OP11_SQL = f"""
with recursive crcs as materialized ({CRC_TABLE}), docs as materialized (
    select row_number() over () as r, doc_id, coalesce('=' || lang, '') as tree,
           sha256({OP11_FIELDS.format(doc_id='doc_id', source='source', lang='lang', n_chars='n_chars', text='text')}) as leaf,
           sha256({OP11_FIELDS.format(doc_id='doc_id', source='source', lang='lang', n_chars='n_chars', text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) as lowered,
           {CRC.format(bytes="[cast(ord(x) as bigint) for x in string_split(cast(doc_id as varchar), '')]")} % 3 = 0 as tampers
    from documents, crcs
), leaves as materialized (
    select *, row_number() over (partition by tree order by doc_id nulls first, leaf, r) - 1 as pos, count(*) over (partition by tree) as n from docs
), nodes as (
    select tree, 0 as level, pos, n, leaf as hash from leaves
    union all
    select tree, level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(hash, '' order by pos)) from nodes where n > 1 group by tree, level, pos // 8, n
), low as materialized (select * from nodes), subroots as materialized (
    select tree, hash, row_number() over (order by tree) - 1 as pos, count(*) over () as n from low where n = 1
), tops as (
    select 0 as level, pos, n, hash from subroots
    union all
    select level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(hash, '' order by pos)) from tops where n > 1 group by level, pos // 8, n
), high as materialized (select * from tops), steps as materialized (
    select l.r, x.level, string_agg(y.hash, '' order by y.pos) filter (y.pos < x.pos) as before, string_agg(y.hash, '' order by y.pos) filter (y.pos > x.pos) as after
    from leaves as l join low as x on x.tree = l.tree and x.n > 1 and x.pos = l.pos // cast(pow(8, x.level) as bigint)
    join low as y on y.tree = x.tree and y.level = x.level and y.pos // 8 = x.pos // 8 group by all
    union all
    select l.r, 100 + x.level, string_agg(y.hash, '' order by y.pos) filter (y.pos < x.pos), string_agg(y.hash, '' order by y.pos) filter (y.pos > x.pos)
    from leaves as l join subroots as s on s.tree = l.tree join high as x on x.n > 1 and x.pos = s.pos // cast(pow(8, x.level) as bigint)
    join high as y on y.level = x.level and y.pos // 8 = x.pos // 8 group by all
), paths as (
    select r, list(struct_pack(b := coalesce(before, ''), a := coalesce(after, '')) order by level) as path from steps group by r
), folds as (
    select r, 0 as done, case when tampers then lowered else leaf end as own, coalesce(path, []) as path from leaves left join paths using (r)
    union all
    select r, done + 1, sha256(path[done + 1].b || own || path[done + 1].a), path from folds where done < len(path)
)
select doc_id, leaf, s.hash as subroot, t.hash as root, sha256(coalesce(list_reduce(list_prepend('', [p.b || p.a for p in path]), lambda x, y : x || y), '')) as proof_sha256,
       own as folded_root, own = t.hash as verified
from leaves join subroots as s using (tree) join folds using (r), high as t where done = len(path) and t.n = 1
"""


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


OP12_SQL = f"""
with recursive crcs as materialized ({CRC_TABLE}), runs as (
    select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) as run from documents
), different as materialized (
    select doc_id, run, count(*) as n from runs group by doc_id, run
), hashed as (
    select run, n, {CRC.format(bytes="list_concat([cast(ord(x) as bigint) for x in string_split(doc_id || ':', '')], flatten([case when ord(x) < 128 then [cast(ord(x) as bigint)] else [195, ord(x) - 64] end for x in string_split(run, '')]))")} as h
    from different, crcs where doc_id is not null
), counted as (
    select case when h % 97 = 0 then left(run, cast(h % length(run) as bigint)) || substring(run, cast(h % length(run) as bigint) + 2) else run end as word, n from hashed
    union all
    select run, n from different where doc_id is null
), words as materialized (
    select word, cast(sum(n) as bigint) as n from counted group by word having length(word) >= 5 and sum(n) >= 3
), shorter as materialized (
    select word, p, left(word, p - 1) || substring(word, p + 1) as rest from (select word, unnest(range(1, length(word) + 1)) as p from words)
), pairs as (
    select distinct a, b from (
        select x.word as a, y.word as b from shorter as x join shorter as y on x.rest = y.rest and x.p = y.p and x.word <> y.word
        union all
        select s.word, w.word from shorter as s join words as w on w.word = s.rest
        union all
        select w.word, s.word from shorter as s join words as w on w.word = s.rest
    )
), best as (
    select a as word, count(*) as n_near, first(struct_pack(b := b, n := w.n) order by w.n desc, b) as best from pairs join words as w on w.word = b group by a
), forms as materialized (
    select w.word, w.n, coalesce(n_near, 0) as n_near, case when best.n >= 2 * w.n then best.b end as form, case when best.n >= 2 * w.n then best.n end as form_n
    from words as w left join best using (word)
), chains as (
    select word, word as root, form as next from forms
    union all
    select c.word, f.word, f.form from chains as c join forms as f on f.word = c.next
)
select f.word, f.form, c.root, f.n, f.n_near, f.form_n from forms as f join chains as c on c.word = f.word and c.next is null
"""


def op13_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_trie.classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {
    "op1_sp_dropout": op1_sp_dropout,
    "op9_warc_transactions": op9_warc_transactions,
    "op2_projection_search": op2_projection_search,
    "op8_exact_topk": op8_exact_topk,
    "op3_toxicity_crf": op3_toxicity_crf,
    "op4_chat_collapse": op4_chat_collapse,
    "op5_ngram_join": op5_ngram_join,
    "op6_token_sst": op6_token_sst,
    "op7_histogram_packing": op7_histogram_packing,
    "op10_rule_quality": op10_rule_quality,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_simhash_trie": op13_simhash_trie,
}

ORACLE_SQL: dict[str, str] = {
    "op4_chat_collapse": OP4_SQL,
    "op8_exact_topk": OP8_SQL,
    "op11_merkle_manifest": OP11_SQL,
    "op12_spelling_variants": OP12_SQL,
}
