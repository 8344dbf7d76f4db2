"""One registered query per operator, with production parameters, and the corpus pipeline."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.llm import bpe, covertree, extract, fingerprints, licenses, mixing, packing, phrases, quality, simhash, spelling, suffix, superkmers
from creditloom.llm.common import crc_of_id, table

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), WORDS)


def op2_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


def op3_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Passages of 50 words or more at several places: at the one that keeps them and at those that do not."""
    return suffix.repeats(table(spark, folder, "documents"), within=True)


def op4_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op5_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.score(table(spark, folder, "documents"))


def op6_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(table(spark, folder, "documents"), RANKS, public_tokenizers.PATTERN)


def op7_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.compare_edits(table(spark, folder, "documents"), units=fingerprints.fine)


def op8_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return extract.extract(table(spark, folder, "pages"))


def op9_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return covertree.near_duplicates(table(spark, folder, "embeddings"))


def op10_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    net = quality.fit(docs, table(spark, folder, "labels"))
    return quality.scores(docs, net).select(
        "doc_id", (crc_of_id() % 5 == 0).alias("held_out"), "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


def op11_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents"))


def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(table(spark, folder, "documents"))


def op13_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = superkmers.deduplicated(table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_license_scan, op3_suffix_array_dedup, op4_simhash_near_dedup, op5_lm_scoring, op6_byte_bpe,
        op7_document_fingerprints, op8_html_extraction, op9_embedding_near_dedup, op10_quality_classifier,
        op11_phrase_collocations, op12_spelling_variants, op13_substring_dedup, pipeline,
    )
}

#: Every pair of valid vectors by their cosine in double precision, and what pairs reach.
OP9_SQL = """
with recursive v as (
  select vec_id, embedding::double[] as e from embeddings
  where embedding is not null and len(embedding) > 0 and len([x for x in embedding if x is null or not isfinite(x)]) = 0
    and len([x for x in embedding if x <> 0]) > 0
), links as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= 0.95
), reached as (
  select a as vec_id, a as other from links union select r.vec_id, l.b from reached r join links l on l.a = r.other
), found as (
  select e.vec_id, (select count(*) from links l where l.a = e.vec_id) as n_links,
         coalesce((select min(other) from reached r where r.vec_id = e.vec_id), e.vec_id) as component_id
  from embeddings e
)
select vec_id, n_links, component_id, vec_id = component_id as kept from found
"""

#: Phrases of one to four words counted one by one.
OP11_SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents
), words as (
  select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces
), sizes as (
  select lang, sum(len(w))::bigint as n from words group by lang
), places as (
  select lang, w, unnest(range(1, len(w) + 1)) as i from words
), runs as (
  select lang, w, i, unnest(range(1, least(4, len(w) - i + 1) + 1)) as size from places
), f as (
  select lang, size, array_to_string(w[i:i + size - 1], ' ') as phrase, count(*) as a from runs group by all having count(*) >= 30
), split as (
  select *, string_split(phrase, ' ') as w from f where size > 1
), cuts as (
  select *, unnest(range(1, size)) as k from split
), scored as (
  select c.lang, c.phrase, c.a, c.k, x.a as l, y.a as r, ((2000000::hugeint * c.a) // (x.a::hugeint + y.a))::bigint as score
  from cuts c
  join f x on x.lang = c.lang and x.phrase = array_to_string(c.w[1:c.k], ' ')
  join f y on y.lang = c.lang and y.phrase = array_to_string(c.w[c.k + 1:c.size], ' ')
), best as (
  select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1
), lengths as (
  select *, unnest(range(2, size)) as m from split where size > 2
), inner_phrases as (
  select lang, a, w, m, unnest(range(1, size - m + 2)) as i from lengths
), longer as (
  select lang, array_to_string(w[i:i + m - 1], ' ') as phrase, max(a) as longer from inner_phrases group by all
), ranked as (
  select b.lang, row_number() over (partition by b.lang order by b.score desc, b.a desc, encode(b.phrase)) as rank, b.phrase, b.a, b.l, b.r, b.score
  from best b left join longer g on g.lang = b.lang and g.phrase = b.phrase
  where g.longer is null or 100::hugeint * g.longer < 80::hugeint * b.a
)
select x.lang, x.rank, x.phrase, x.a, x.l, x.r, s.n, x.score from ranked x join sizes s on s.lang = x.lang where x.rank <= 2000
"""

#: Windows of 35 words counted one by one.
OP13_SQL = r"""
with texts as (
  select row_number() over () as row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), places as (
  select row, w, unnest(range(1, len(w) - 33)) as i from texts where len(w) >= 35
), windows as (
  select row, i, hash(array_to_string(w[i:i + 34], ' ')) as h, array_to_string(w[i:i + 34], ' ') as s from places
), repeated as (
  select row, i from windows qualify count(*) over (partition by h, s) > 1
), covered as (
  select distinct row, unnest(range(i, i + 35)) as j from repeated
), words as (
  select row, unnest(w) as word, unnest(range(1, len(w) + 1)) as j from texts
), kept as (
  select x.row, string_agg(x.word, ' ' order by x.j) as text, count(*) as n
  from words x left join covered c on c.row = x.row and c.j = x.j where c.j is null group by x.row
)
select t.doc_id, len(t.w)::bigint as n_words, len(t.w) - coalesce(k.n, 0) as n_removed, sha256(coalesce(k.text, '')) as kept_sha256
from texts t left join kept k on k.row = t.row
"""

#: For the other operators SQL lacks the tokenizers, the hash, the sketch, the parser or the trained model.
SQL: dict[str, str] = {
    "op9_embedding_near_dedup": OP9_SQL, "op11_phrase_collocations": OP11_SQL, "op13_substring_dedup": OP13_SQL,
}
