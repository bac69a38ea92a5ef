"""Registered queries of the numbered operators, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlemill.llm import chat, classlm, codebooks, contamination, embeddings, jaccard, language, licenses, negatives, pieces, sharding, substrings, tokencounts
from candlemill.llm.jobs import fold, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(licenses.scan(table(spark, sf_dir, "documents")))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op3_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = fold("doc_id", 10) == 0
    model, vocab = classlm.train(docs.filter(~held))
    return classlm.score(docs, model, vocab).withColumn("held_out", held)


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", mark), (-7, 1, "assistant", mark)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn", "role", "text")
    return chat.digests(chat.render(rows.unionByName(more)))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), shards=8)


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # beside the contract's strings of 400 bytes: passages of over 50 words
    return substrings.summary(table(spark, sf_dir, "documents"), passage=51)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.summary(table(spark, sf_dir, "documents"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.9)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = fold("doc_id", 3) == 1
    return language.identify(docs, docs.filter(~held)).withColumn("held_out", held)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("id") % 100 == 0)


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.count(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebooks.compress(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_license_scan": op1_license_scan,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_class_lm": op3_class_lm,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_sharding": op5_sharding,
    "op6_suffix_array_dedup": op6_suffix_array_dedup,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_embedding_near_dedup": op8_embedding_near_dedup,
    "op9_language_id": op9_language_id,
    "op10_decontamination": op10_decontamination,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_token_counts": op12_token_counts,
    "op13_vector_codes": op13_vector_codes,
}

_ASCII_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"regexp_extract_all(" + _ASCII_LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_FINITE = "embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"


def _codebook_rounds(rounds: int) -> str:
    """Common tables of ``op13``: assignments ``a0`` .. and codebooks ``c0`` .. , each from the one before."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
        a{r} as (
            select vec_id, part, min(k) as k, min(d) as d from (
                select p.vec_id, p.part, c.k, d, min(d) over (partition by p.vec_id, p.part) as least
                from p join c{r} c using (part), lateral (select list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as d)
            ) where d = least group by vec_id, part
        )""")
        if r < rounds:
            steps.append(f"""
        m{r} as (
            select part, k, list(f order by i) as x from (
                select a.part, a.k, i, cast(floor(sum(p.x[i]) / count(*)) as bigint) as f
                from a{r} a join p using (vec_id, part), unnest(range(1, len(p.x) + 1)) t(i) group by all
            ) group by part, k
        ), c{r + 1} as (select c.part, c.k, coalesce(m.x, c.x) as x from c{r} c left join m{r} m using (part, k))""")
    return ",".join(steps)


ORACLE: dict[str, str] = {
    "op2_ngram_jaccard_join": f"""
        with recursive w as (
            select doc_id, coalesce(regexp_extract_all({_ASCII_LOWER.format("text")}, '[^\\x20\\x09-\\x0D]+'), []) as w from documents
        ), s as (
            select distinct doc_id, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') as s
            from w, unnest(range(1, len(w) - least(5, len(w)) + 2)) t(i) where len(w) > 0
        ), n as (select doc_id, count(*) as n from s group by doc_id),
        x as (select a.doc_id as a, b.doc_id as b, count(*) as x from s a join s b on a.s = b.s and a.doc_id <> b.doc_id group by all),
        l as (select a, b from x join n p on p.doc_id = a join n q on q.doc_id = b where 100 * x >= 75 * (p.n + q.n - x)),
        r as (
            select doc_id as a, doc_id as b from documents
            union select r.a, l.b from r join l on r.b = l.a
        )
        select d.doc_id, coalesce(n, 0) as n_shingles, c as component_id
        from documents d left join n using (doc_id) join (select a as doc_id, min(b) as c from r group by a) using (doc_id)""",
    "op4_chat_formatting": r"""
        with c as (
            select conv_id, turn, coalesce(role, 'null') as role, coalesce(text, '') as text from conversations
            union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
        ), e as (
            select *, length(regexp_replace(text, '<s>|</s>|\[INST\]|\[/INST\]|\[SYS\]|\[/SYS\]|\[ROLE\]|\[/ROLE\]|\[OUT\]|\\', '\0+', 'g'))
                + case role when 'user' then 13 when 'assistant' then 9 when 'system' then 11 else 14 + length(role) end as chars from c
        )
        select conv_id, count(*) as n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
            cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
            sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '')) as loss_sha256,
            cast(3 + sum(chars) as bigint) as formatted_chars, false as rewrote
        from e group by conv_id""",
    "op8_embedding_near_dedup": """
        with recursive v as (
            select vec_id, cast(embedding as double[]) as e from embeddings
        ), u as (
            select vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as n from v
            where e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0
        ), l as (
            select a.vec_id as a, b.vec_id as b from u a join u b on a.vec_id <> b.vec_id and a.n > 0 and b.n > 0
            where list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.9
        ), r as (
            select vec_id as a, vec_id as b from embeddings
            union select r.a, l.b from r join l on r.b = l.a
        ), c as (select a as vec_id, min(b) as component_id from r group by a),
        k as (select a as vec_id, count(*) as n_links from l group by a)
        select c.vec_id, coalesce(n_links, 0) as n_links, component_id, c.vec_id = component_id as kept
        from c left join k using (vec_id)""",
    "op10_decontamination": f"""
        with d as (select doc_id, coalesce({_ALNUM.format("text")}, []) as w from documents),
        b as (select item_id, {_ALNUM.format("text")} as w from benchmark where text is not null),
        p as (
            select item_id, least(13, len(w)) as m, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') as p
            from b, unnest(range(1, len(w) - least(13, len(w)) + 2)) t(i) where len(w) > 0
        ),
        g as (
            select doc_id, i, m, array_to_string(w[i : i + m - 1], ' ') as p
            from d, (select distinct m from p) s, unnest(range(1, len(w) - m + 2)) t(i) where len(w) >= m
        ),
        h as (select g.doc_id, g.i, g.m, p.item_id from g join p using (m, p)),
        n as (select doc_id, count(distinct k) as n_hit from h, unnest(range(i, i + m)) t(k) group by doc_id),
        s as (select doc_id, count(*) as n_items, string_agg(x, ',' order by x) as x from (select distinct doc_id, cast(item_id as varchar) as x from h) group by doc_id)
        select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
            sha256(coalesce(s.x, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
        from d left join n using (doc_id) left join s using (doc_id)""",
    "op11_hard_negatives": f"""
        with v as (
            select vec_id, case when vec_id % 7 = 0 then (cast(label as bigint) + 1) % 10 else label end as label,
                list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as q
            from embeddings where label is not null and vec_id is not null and {_FINITE}
        ), s as (
            select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same,
                list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) as score
            from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0
        ), p as (
            select * from (select *, row_number() over (partition by anchor_id order by score desc, id) as place from s where same) where place <= 5
        ), n as (
            select p.anchor_id, p.id as positive_id, p.score as positive_score, s.id as negative_id, s.score as negative_score,
                row_number() over (partition by p.anchor_id, p.id order by s.score desc, s.id) as place
            from p join s on s.anchor_id = p.anchor_id and not s.same and 80 * p.score <= 100 * s.score and 100 * s.score <= 100 * p.score
        )
        select anchor_id, positive_id, cast(place as integer) as rank, negative_id,
            cast(positive_score as bigint) as positive_score, cast(negative_score as bigint) as negative_score from n where place <= 5""",
    "op13_vector_codes": f"""
        with q as (
            select vec_id, label, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as q from embeddings where {_FINITE}
        ), p as (
            select vec_id, part, q[part * (len(q) // 4) + 1 : (part + 1) * (len(q) // 4)] as x from q, unnest(range(4)) t(part)
        ), f as (select vec_id, row_number() over (order by vec_id) - 1 as k from q qualify k < 256),
        c0 as (select part, k, x from p join f using (vec_id)), {_codebook_rounds(4)},
        e as (select vec_id, string_agg(printf('%02x', k), '' order by part) as code, cast(sum(d) as bigint) as error from a4 group by vec_id),
        h as (select sha256(string_agg(array_to_string(x, ','), ',' order by part, k)) as codebooks_sha256 from c4)
        select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256
        from q join e using (vec_id), h""",
}
