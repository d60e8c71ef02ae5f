"""Queries and SQL of the training-text problems, over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verityloom.llm import leakage, mixing, near_duplicates, neighbours, splitting, stuffing
from verityloom.session import cut_lineage, table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    got = splitting.split_oversized(
        table(spark, d, "document_chunks"), ["document_id", "chunk_index"], "chunk_text", only_oversized=True
    )
    return got.where("piece_index = 0").select("document_id", "chunk_index", "boundary")


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(table(spark, d, "document_chunks"), ["document_id", "chunk_index"], "chunk_text")


def _p3(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return near_duplicates.links(
        table(spark, d, "document_chunks"), "chunk_id", "chunk_text", shingle=3, threshold=0.6, min_words=20
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.similar_pairs(*_p3(spark, d), expand=64).select(
        F.col("a").alias("chunk_id_a"), F.col("b").alias("chunk_id_b")
    )


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.groups(*_p3(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    near = neighbours.nearest(table(spark, d, "document_chunks"), "chunk_id", "embedding", min_similarity=0.9)
    return neighbours.mutual_pairs(near, 0.9).select(F.col("a").alias("chunk_id_a"), F.col("b").alias("chunk_id_b"))


def p5_nearest(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.nearest(table(spark, d, "document_chunks"), "chunk_id", "embedding")


def _p6(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(
        table(spark, d, "documents"), "doc_id", "text", table(spark, d, "evaluation_items"), "item_id",
        ["question", "expected_supporting_passage"]
    )


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _p6(spark, d).where("kind = 'verbatim'").select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


def p6_leaks(spark: SparkSession, d: str) -> DataFrame:
    return _p6(spark, d)


def _p7(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(token counts, demand of each source, drawn copies): each text is tokenised once."""
    counts = cut_lineage(mixing.token_counts(table(spark, d, "documents"), "doc_id", "source", "text"))
    targets = table(spark, d, "source_mix_targets")
    demand = mixing.demands(counts, targets)
    return counts, demand, mixing.curriculum(counts, targets, demand=demand)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources whose copies run out before their demand, by the rows that the curriculum draws."""
    return p7_shares(spark, d).where("falls_short").select("source")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    _, demand, drawn = _p7(spark, d)
    return mixing.shares(drawn, demand)


def p7_curriculum(spark: SparkSession, d: str) -> DataFrame:
    return _p7(spark, d)[2]


def _p8(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.stuffed_pages(table(spark, d, "documents"), "doc_id", "text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _p8(spark, d).where("stuffed").select(F.col("id").alias("doc_id"))


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    return _p8(spark, d)


QUERIES = {
    f.__name__: f for f in (
        p2_found, p2_pieces, p3_found, p3_groups, p5_found, p5_nearest, p6_found, p6_leaks, p7_found, p7_shares,
        p7_curriculum, p8_found, p8_scores
    )
}

_WORDS = "regexp_extract_all(lower({}), '[\\pL\\pN]+')"
ORACLES = {
    "p2_found": """
with c as (select document_id, chunk_index, max(chunk_text) t from document_chunks where length(chunk_text) > 1200 group by all),
longest as (
  select *,
    list_max(list_transform(string_split(regexp_replace(t, '\\n[ \\t\\r\\n]*\\n', chr(1), 'g'), chr(1)), lambda x: length(x))) p,
    list_max(list_transform(string_split(regexp_replace(regexp_replace(t, '([.!?])[ \\t\\r\\n]+', '\\1' || chr(1), 'g'), '\\n[ \\t\\r\\n]*\\n', chr(1), 'g'), chr(1)), lambda x: length(x))) s,
    list_max(list_transform(string_split_regex(t, '[ \\t\\r\\n]+'), lambda x: length(x))) w
  from c)
select document_id, chunk_index, case when p <= 1200 then 'paragraph' when s <= 1200 then 'sentence' when w <= 1200 then 'word' else 'none' end boundary from longest""",
    "p3_found": f"""
with c as (select distinct chunk_id, {_WORDS.format('chunk_text')} w from document_chunks where chunk_text is not null),
s as (select distinct chunk_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) g from c where len(w) >= 20),
n as (select chunk_id, count(*) n from s group by 1),
k as (select a.chunk_id a, b.chunk_id b, count(*) both_ from s a join s b on a.g = b.g and a.chunk_id < b.chunk_id group by 1, 2)
select a chunk_id_a, b chunk_id_b from k join n na on na.chunk_id = a join n nb on nb.chunk_id = b where both_ >= 0.6 * (na.n + nb.n - both_)""",
    "p3_groups": f"""
with recursive c as (select distinct chunk_id, {_WORDS.format('chunk_text')} w from document_chunks where chunk_text is not null),
s as materialized (select distinct chunk_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) g from c where len(w) >= 20),
t as (select chunk_id, count(*) n, sha256(string_agg(g, chr(1) order by g)) k from s group by 1),
cls as materialized (select k, min(chunk_id) rep, count(*) copies, any_value(n) n from t group by 1),
r as (select rep, n, g from cls join s on s.chunk_id = rep),
l as materialized (select a, b from (select x.rep a, y.rep b, x.n na, y.n nb, count(*) both_ from r x join r y on x.g = y.g and x.rep < y.rep group by all) where both_ >= 0.6 * (na + nb - both_)),
e as (select a, b from l union all select b, a from l),
walk(a, b) as (select rep, rep from cls union select w.a, e.b from walk w join e on e.a = w.b),
root as (select a rep, min(b) group_id from walk group by 1),
deg as (select a rep, count(*) links from e group by 1)
select chunk_id id, rep class_id, group_id, copies, coalesce(links, 0) links from t join cls using (k) join root using (rep) left join deg using (rep)""",
    "p5_found": """
with v as (
  select distinct chunk_id id, cast(embedding as double[64]) x from document_chunks
  where embedding is not null and len(embedding) = 64 and list_max(list_transform(embedding, lambda e: abs(e))) > 0),
s as (select a.id a, b.id b, array_cosine_similarity(a.x, b.x) c from v a join v b on a.id <> b.id),
r as (select *, row_number() over (partition by a order by c desc, b) k from s)
select distinct least(a, b) chunk_id_a, greatest(a, b) chunk_id_b from r where k <= 5 and c >= 0.9""",
    "p7_found": f"""
with n as (select source, sum(len({_WORDS.format('text')})) n from documents group by 1),
t as (select t.source, target_weight w, max_repeats r, coalesce(n.n, 0) n from source_mix_targets t left join n using (source))
select source from t where n * r < w * (select sum(n) from t)""",
    "p6_found": f"""
with q as (select item_id, unnest([question, expected_supporting_passage]) t from evaluation_items),
iw as (select item_id, {_WORDS.format('t')} w from q),
ig as (select distinct item_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) g from iw where len(w) >= 12),
dw as (select doc_id, {_WORDS.format('text')} w from documents),
dg as (select doc_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) g from dw where len(w) >= 12)
select distinct doc_id, item_id from dg join ig using (g)""",
}
