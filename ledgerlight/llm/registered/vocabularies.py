"""Queries over tokens, addresses and words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlight.llm import token_spans, url_model, variants
from ledgerlight.llm.common import table

RULES = [url_model.Rule.parse(text, verdict) for text, verdict in (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))]


def op11_token_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document that cover the same bytes in both vocabularies."""
    return token_spans.alignments(table(spark, sf_dir, "documents"))


def op12_url_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's address, by rules, else by the models of what the rules judged."""
    return url_model.judged(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).drop("url")


def op13_gram_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words, form and root of every frequent word."""
    return variants.grouped(variants.vocabulary(table(spark, sf_dir, "documents")))


QUERIES = {"op11_token_spans": op11_token_spans, "op12_url_ratio": op12_url_ratio, "op13_gram_variants": op13_gram_variants}

ORACLES: dict[str, str] = {}
