"""Matching tracked metrics to reported tags.

Tags are made distinct first. The metric list is configuration, so each tag row is exploded
by it in place: no shuffle, and no product of two tables. Edit distances are computed only where
word lengths and shared words leave a score at the threshold possible.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight import config as C
from ledgerlight.functions import text as S
from ledgerlight.operators.ordered import top_rows

PREFILTER, BEST = 50, 5


def candidates(tags: DataFrame, metrics: Sequence[str] = C.KEY_METRICS, keys: Sequence[str] = (), similarity: Callable = S.edit_similarity) -> DataFrame:
    """Distinct (keys, metric, tag) with words and the quick score 0.6·overlap + 0.4·similarity."""
    listed = F.array(*[F.lit(m) for m in metrics])
    rows = tags.select(*keys, "tag").distinct().withColumn("tag_words", S.extract_words(F.col("tag")))
    rows = rows.withColumn("metric", F.explode(listed)).withColumn("metric_words", S.extract_words(F.col("metric")))
    known = F.array_distinct("metric_words")
    overlap = F.size(F.array_intersect("metric_words", "tag_words")) / F.greatest(F.size(known), F.lit(1))
    quick = overlap * 0.6 + similarity(F.lower("metric"), F.lower("tag")) * 0.4
    return rows.withColumn("quick_score", quick)


def prefilter(cands: DataFrame, k: int = PREFILTER, keys: Sequence[str] = ()) -> DataFrame:
    """The k best candidates per metric; ties by tag name."""
    return top_rows(cands, [*keys, "metric"], [F.desc("quick_score"), F.asc("tag")], k, "quick_rank")


def match_scores(cands: DataFrame, similarity: Callable = S.edit_similarity) -> DataFrame:
    """Add word_score, all_words and score (1 for equal word sets)."""
    wanted, found = F.array_distinct("metric_words"), F.array_distinct("tag_words")
    shared = F.size(F.array_intersect("metric_words", "tag_words"))
    all_words = (shared == F.size(wanted)) & (F.size(wanted) > 0)
    exact = all_words & (F.size(found) == F.size(wanted))
    out = cands.filter((F.size("tag_words") > 0) & (F.size("metric_words") > 0))
    out = out.withColumn("word_score", S.word_similarity(F.col("metric_words"), F.col("tag_words"), similarity)).withColumn("all_words", all_words)
    mixed = F.col("word_score") * 0.7 + similarity(F.col("metric"), F.col("tag")) * 0.3
    boosted = F.when(F.col("all_words") & (mixed >= 0.7), F.least(mixed + 0.1, F.lit(1.0))).otherwise(mixed)
    return out.withColumn("score", F.when(exact, F.lit(1.0)).otherwise(boosted))


def _within(a: Column, b: Column, least: int) -> Column:
    """The similarity that two texts can have at most: other lengths and other words take edits."""
    longest = F.greatest(F.length(a), F.length(b), F.lit(1))
    return 1.0 - F.greatest(F.abs(F.length(a) - F.length(b)), F.lit(least)) / longest


def best_possible(metric_words: Column, tag_words: Column, metric: Column, tag: Column) -> Column:
    """What `match_scores` can give at most, from shared words and lengths alone.

    Texts of other lengths differ by at least that many edits, and different words by at least one.
    All steps of the score grow with the similarities, so no score is above its bound.
    """

    words = S.word_similarity(metric_words, tag_words, lambda w, o: F.when(w == o, F.lit(1.0)).otherwise(_within(w, o, 1)))
    mixed = words * 0.7 + _within(metric, tag, 0) * 0.3
    wanted = F.array_distinct(metric_words)
    all_words = F.size(F.array_intersect(metric_words, tag_words)) == F.size(wanted)
    exact = all_words & (F.size(F.array_distinct(tag_words)) == F.size(wanted))
    boosted = F.when(all_words & (mixed >= 0.7), F.least(mixed + 0.1, F.lit(1.0))).otherwise(mixed)
    return F.when(exact, F.lit(1.0)).otherwise(boosted)


def reachable(cands: DataFrame, threshold: float) -> DataFrame:
    """Candidates whose score by edit similarity may reach the threshold; those left out cannot."""
    least = threshold - 1e-9  # far below any difference that edits can make
    known = (F.size("tag_words") > 0) & (F.size("metric_words") > 0)
    # the lengths of the names alone rule most pairs out at high thresholds, at no cost
    quick = 0.7 + 0.3 * _within(F.col("metric"), F.col("tag"), 0) >= least
    all_words = F.size(F.array_intersect("metric_words", "tag_words")) == F.size(F.array_distinct("metric_words"))
    bound = best_possible(F.col("metric_words"), F.col("tag_words"), F.col("metric"), F.col("tag"))
    return cands.filter(known & (quick | all_words) & (bound >= least))


def _scored(tags: DataFrame, metrics: Sequence[str], threshold: float, keys: Sequence[str], similarity: Callable) -> DataFrame:
    """Matches at the threshold: every distinct tag is scored once, whatever the number of keys that use it."""
    found = candidates(tags, metrics, (), similarity)
    found = reachable(found, threshold) if similarity is S.edit_similarity else found
    good = match_scores(found, similarity).filter(F.col("score") >= threshold).select("metric", "tag", "score", "all_words")
    return good if not keys else tags.select(*keys, "tag").distinct().join(good, "tag")


def tag_matches(
    tags: DataFrame, metrics: Sequence[str] = C.KEY_METRICS, threshold: float = 0.9, keys: Sequence[str] = (),
    similarity: Callable = S.edit_similarity, best: int = BEST, prefilter_to: int | None = None,
) -> DataFrame:
    """Best matches per metric: score, then complete word matches, then the shorter name.

    Every candidate that can reach the threshold is scored; `prefilter_to` keeps only that many by
    the quick score, which may lose matches.
    """
    if prefilter_to is None:
        scored = _scored(tags, metrics, threshold, keys, similarity)
    else:
        scored = match_scores(prefilter(candidates(tags, metrics, keys, similarity), prefilter_to, keys), similarity)
    order = [F.desc("score"), F.desc("all_words"), F.length("tag").asc(), F.asc("tag")]
    top = top_rows(scored.filter(F.col("score") >= threshold), [*keys, "metric"], order, best, "match_rank")
    return top.select(*keys, "metric", "tag", "score", "match_rank")


def vote_tags(matches: DataFrame, company: str = "cik") -> DataFrame:
    """Winner and runner-up tag per metric by the number of companies that match it."""
    votes = matches.groupBy("metric", "tag").agg(F.count_distinct(company).alias("companies"))
    return top_rows(votes, ["metric"], [F.desc("companies"), F.asc("tag")], 2, "place")


def agreement(matches: DataFrame, companies: int, metrics: Sequence[str] = C.KEY_METRICS, company: str = "cik") -> DataFrame:
    """Category per metric: 1 all companies one tag, 2 some missing, 3 different tags, 4 no match."""
    first = matches.filter(F.col("match_rank") == 1)
    per = first.groupBy("metric").agg(F.count_distinct("tag").alias("tags"), F.count_distinct(company).alias("companies"))
    listed = matches.sparkSession.createDataFrame([(m,) for m in metrics], "metric string")
    n = F.coalesce("companies", F.lit(0))
    kind = F.when(n == 0, 4).when(F.col("tags") > 1, 3).when(n == companies, 1).otherwise(2)
    return listed.join(per, "metric", "left").select("metric", F.coalesce("tags", F.lit(0)).alias("tags"), n.alias("companies"), kind.alias("category"))
