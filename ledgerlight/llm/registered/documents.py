"""Queries over documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.llm import decontaminate, langid, licenses, quality_crf, sentencepiece_scan, simhash, surrogates
from ledgerlight.llm.common import stored, table


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents that language identification may not learn from; a null id is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op9_license_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in every document."""
    out = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.array_join("licenses", ",").alias("licenses"), "license_use", F.size("license_spans").cast("long").alias("n_spans"), "license_spans")


def op10_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    counts = stored(langid.learn(docs.filter(~held_out())), "language-counts")
    found = langid.identify(docs.select("doc_id", "text"), counts)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", F.array_join("lang_set", ",").alias("lang_set"))


def op1_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every document and the verdict by its lines."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    field = quality_crf.fit(docs, table(spark, sf_dir, "labels"))
    out = quality_crf.assess(docs, field)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_words")


def op2_maxplus_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and whether decoding them gives back the text."""
    vocabulary = sentencepiece_scan.load(spark)
    coded = sentencepiece_scan.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary, checked="round_trip")
    return coded.select("doc_id", "n_tokens", "token_ids", "round_trip")


def surrogate_key(spark: SparkSession) -> str:
    """The secret behind the surrogates: a setting of the session; tests run with the default."""
    return spark.conf.get("ledgerlight.llm.surrogate.key", "a key for tests only")


def op5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced, and the number of mentions that were."""
    return surrogates.replaced(table(spark, sf_dir, "documents").select("doc_id", "text"), surrogate_key(spark), count="n_mentions")


def op6_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-copy component of every document."""
    out = simhash.grouped(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op7_benchmark_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    out = decontaminate.contaminated(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


QUERIES = {"op1_line_crf": op1_line_crf, "op2_maxplus_pieces": op2_maxplus_pieces, "op5_surrogates": op5_surrogates, "op6_simhash_bktree": op6_simhash_bktree, "op7_benchmark_windows": op7_benchmark_windows, "op9_license_windows": op9_license_windows, "op10_language_mixture": op10_language_mixture}
_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

# the others need hashes, training or paths that SQL does not have: tests compare them with brute force
ORACLES = {
    "op7_benchmark_windows": f"""
with b as (select cast(item_id as varchar) as item, {_WORDS} as w from benchmark),
bw as (select distinct item, size, array_to_string(w[i:i + size - 1], ' ') as win
  from (select item, w, least(10, len(w)) as size, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from b where len(w) > 0)),
d as (select doc_id, {_WORDS} as w from documents),
dw as (select doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') as win
  from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as i from d, (select distinct size from bw))),
hit as (select doc_id, i, size, item from dw join bw using (size, win)),
pos as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + size)) as p from hit) group by doc_id),
it as (select doc_id, count(distinct item) as n_items, sha256(string_agg(distinct item, ',' order by item)) as items_sha256 from hit group by doc_id)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, coalesce(items_sha256, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join pos using (doc_id) left join it using (doc_id)
""",
}
