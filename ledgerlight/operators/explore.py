"""Exploration statistics on joined facts."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.functions import dates as D
from ledgerlight.functions import text as S
from ledgerlight.operators.ordered import global_row_number


def parse_feature_names(df: DataFrame, col: str = "feature") -> DataFrame:
    """Add tag, qtrs and change_type parsed from the feature name."""
    name = F.col(col)
    return df.withColumns({"tag": S.feature_tag(name), "qtrs": S.feature_qtrs(name), "change_type": S.feature_change(name)})


def feature_name_stats(ranking: DataFrame) -> DataFrame:
    """Count, mean and total completeness by tag, by qtrs and by change type in one pass."""
    parsed = parse_feature_names(ranking)
    sets = [[F.col("tag")], [F.col("qtrs")], [F.col("change_type")]]
    return parsed.groupingSets(sets, "tag", "qtrs", "change_type").agg(
        F.count("*").alias("features"),
        F.avg("non_null_percentage").alias("mean_pct"),
        F.sum("non_null_percentage").alias("sum_pct"),
        F.sum("non_null_count").alias("total_count"),
    )


def matching_feature_stats(ranking: DataFrame, text: str = "Revenue") -> DataFrame:
    """Mean, smallest and largest completeness of the features whose name contains `text`."""
    hit = ranking.filter(F.lower("feature").contains(text.lower()))
    pct = "non_null_percentage"
    return hit.agg(F.count("*").alias("features"), F.avg(pct).alias("mean_pct"), F.min(pct).alias("min_pct"), F.max(pct).alias("max_pct"))


def company_form_stats(facts: DataFrame, form: str) -> DataFrame:
    """Per company: filings, tags, unique tags, custom tags, and the same for standard tags, one pass."""
    standard = F.col("custom_tag") == 0
    return facts.filter(F.col("form") == form).groupBy("cik", "name").agg(
        F.count_distinct("adsh").alias("num_forms"),
        F.count("tag").alias("total_tags"),
        F.count_distinct("tag").alias("unique_tags"),
        F.sum("custom_tag").alias("custom_tags"),
        F.count(F.when(standard, F.col("tag"))).alias("total_standard_tags"),
        F.count_distinct(F.when(standard, F.col("tag"))).alias("unique_standard_tags"),
    )


def company_form_means(stats: DataFrame) -> DataFrame:
    """Means of the company statistics."""
    cols = [c for c in stats.columns if c not in ("cik", "name")]
    return stats.agg(F.count("*").alias("companies"), *[F.avg(c).alias(f"mean_{c}") for c in cols])


_SERIES = ["cik", "name", "tag", "segments", "qtrs"]


def date_history(facts: DataFrame, form: str) -> DataFrame:
    """Distinct dates of each reported series, with rounded distances to the newest and the horizon.

    Dates are made distinct before they are gathered, so an array holds at most a series' days.
    """
    kept = facts.filter((F.col("custom_tag") == 0) & (F.col("form") == form) & F.col("value").isNotNull())
    dated = kept.select(*_SERIES, D.parse_day(F.col("ddate")).alias("d")).filter(F.col("d").isNotNull()).distinct()
    g = dated.groupBy(*_SERIES).agg(F.sort_array(F.collect_list("d")).alias("historic_dates"))
    newest = F.element_at("historic_dates", -1)
    older = F.slice("historic_dates", 1, F.size("historic_dates") - 1)
    intervals = F.transform(older, lambda d: D.round_quarter_days_fine(F.datediff(F.col("max_ddate"), d)))
    out = g.withColumn("distinct_ddate", F.size("historic_dates")).withColumn("max_ddate", newest)
    out = out.withColumn("time_intervals", intervals)
    return out.withColumn("hist_horizon", F.coalesce(F.array_max("time_intervals"), F.lit(0)))


def date_history_stats(history: DataFrame) -> DataFrame:
    """Per tag: companies, mean and mode of distinct dates, and quantiles of the horizon.

    Day counts have a bounded domain, so the exact percentile keeps few counters.
    """
    many = history.filter(F.col("distinct_ddate") > 1)
    return many.groupBy("tag").agg(
        F.count_distinct("cik").alias("distinct_cik"),
        F.avg("distinct_ddate").alias("mean_distinct_ddates"),
        F.mode("distinct_ddate", True).alias("mode_distinct_ddates"),
        F.max("hist_horizon").alias("hist_horizon_max"),
        F.percentile("hist_horizon", F.lit(0.75)).alias("hist_horizon_75pct"),
        F.percentile("hist_horizon", F.lit(0.5)).alias("hist_horizon_median"),
    )


def summary_share(profile: DataFrame) -> DataFrame:
    """Share of fact groups with a summary record per tag."""
    return profile.groupBy("tag").agg(F.avg(F.col("has_summary_record").cast("double")).alias("summary_share"))


def tags_lacking_summary(profile: DataFrame, ranked: DataFrame, below: float = 0.9, top: int = 500) -> DataFrame:
    """Popular tags whose summary share is low; `ranked` holds (tag, rank)."""
    share = summary_share(profile).join(ranked.select("tag", "rank"), "tag")
    return share.filter((F.col("summary_share") < below) & (F.col("rank") < top))


def profile_totals(profile: DataFrame) -> DataFrame:
    """Totals of a segment profile: groups, with null row, single, with summary, and problematic ones."""
    odd = (F.col("distinct_segments_non_null") > 1) & ~F.col("has_summary_record")
    return profile.agg(
        F.count("*").alias("groups"),
        F.count_if("has_segment_null").alias("with_null"),
        F.count_if("only_1_segment").alias("single"),
        F.count_if("has_summary_record").alias("with_summary"),
        F.count_if(odd).alias("problematic"),
    )


def tag_population(facts: DataFrame, tags: Sequence[str], form: str = "10-Q") -> DataFrame:
    """Percentage of the form's companies that use each tag, 0 for unused ones.

    One distinct (cik, tag) pass; the company total is a scalar subquery.
    """
    rows = facts.filter(F.col("form") == form)
    total = rows.agg(F.count_distinct("cik").alias("n"))
    used = rows.filter(F.col("tag").isin(*tags)).groupBy("tag").agg(F.count_distinct("cik").alias("companies"))
    listed = facts.sparkSession.createDataFrame([(t,) for t in tags], "tag string")
    n = F.coalesce("companies", F.lit(0)).alias("companies")
    joined = listed.join(used, "tag", "left").select("tag", n)
    return joined.withColumn("pct", F.coalesce(F.try_divide(F.col("companies") * 100.0, total.scalar()), F.lit(0.0)))


def _uses(exact: str, part: str):
    a = F.col("tag") == exact
    b = F.lower("tag").contains(part.lower())
    return a, b


def tag_pair_companies(facts: DataFrame, exact: str, part: str) -> DataFrame:
    """Companies using the first tag, a tag containing the second text, and both."""
    a, b = _uses(exact, part)
    per = facts.filter(a | b).groupBy("cik").agg(F.max(a.cast("int")).alias("a"), F.max(b.cast("int")).alias("b"))
    both = (F.col("a") == 1) & (F.col("b") == 1)
    return per.agg(F.count_if(F.col("a") == 1).alias("using_first"), F.count_if(F.col("b") == 1).alias("using_second"), F.count_if(both).alias("using_both"))


def tag_pair_usage(facts: DataFrame, exact: str, part: str) -> DataFrame:
    """Usage counts per (cik, fy, fp, tag, version) of companies using both tags."""
    a, b = _uses(exact, part)
    rows = facts.filter(a | b)
    usage = rows.groupBy("cik", "fy", "fp", "tag", "version").agg(F.count("*").alias("count"))
    ua, ub = _uses(exact, part)
    both = usage.groupBy("cik").agg(F.max(ua.cast("int")).alias("a"), F.max(ub.cast("int")).alias("b")).filter("a = 1 and b = 1")
    return usage.join(both.select("cik"), "cik", "left_semi")


def rank_tags(stats: DataFrame, first: int = 0) -> DataFrame:
    """(tag, rank) of all tags by the number of companies, then by name, counted from `first`.

    Tags are numbered over range blocks: custom tags grow with the filings.
    """
    ranked = global_row_number(stats.select("tag", "distinct_companies"), [], [F.desc("distinct_companies"), F.asc("tag")], "_n")
    return ranked.select("tag", (F.col("_n") - 1 + first).cast("int").alias("rank"))


def popular_matches(facts: DataFrame, ranked: DataFrame, text: str = "percent") -> DataFrame:
    """Counts of standard tags containing `text`, with their popularity rank."""
    hit = facts.filter((F.col("custom_tag") == 0) & F.lower("tag").contains(text.lower()))
    return hit.groupBy("tag").agg(F.count("*").alias("count")).join(ranked, "tag")


def form_overlap(facts: DataFrame, first: str = "10-K", second: str = "10-Q") -> DataFrame:
    """Companies filing either form and both."""
    is_a, is_b = (F.col("form") == first).cast("int"), (F.col("form") == second).cast("int")
    per = facts.groupBy("cik").agg(F.max(is_a).alias("a"), F.max(is_b).alias("b"))
    a, b = F.col("a") == 1, F.col("b") == 1
    return per.agg(F.count_if(a).alias("with_first"), F.count_if(b).alias("with_second"), F.count_if(a & b).alias("with_both"))


def form_value_match(facts: DataFrame, first: str = "10-K", second: str = "10-Q", tolerance: float = 0.01) -> DataFrame:
    """Items reported in both forms and whether their values agree, per company and tag.

    Both forms meet in one aggregate on (tag, segments, ddate, version); no pairs are formed.
    The smallest value stands for each form; NULL segments and versions match each other.
    """
    keys = ["cik", "tag", "segments", "ddate", "version"]
    items = facts.groupBy(*keys).agg(
        F.min(F.when(F.col("form") == first, F.col("value"))).alias("v1"), F.min(F.when(F.col("form") == second, F.col("value"))).alias("v2")
    ).filter("v1 is not null and v2 is not null")
    same = F.abs(F.col("v1") - F.col("v2")) < tolerance
    return items.groupBy("cik", "tag").agg(F.count("*").alias("matching_keys"), F.count_if(same).alias("identical"), F.count_if(~same).alias("different"))


def latest_sic(sub: DataFrame) -> DataFrame:
    """Industry code of each company's newest filing that has one."""
    known = sub.filter(F.trim("sic") != "")
    return known.groupBy("cik").agg(F.max_by("sic", F.struct("filed", "adsh")).alias("sic"))


def filing_dates(sub: DataFrame, forms: Iterable[str]) -> DataFrame:
    """Latest file date per (cik, period, form); rows without key or date are dropped."""
    kept = sub.filter(F.col("form").isin(*forms)).dropna(subset=["cik", "period", "filed"])
    return kept.groupBy("cik", "period", F.col("form").alias("form_type")).agg(F.max("filed").alias("file_date"))


def dedupe_events(events: DataFrame) -> DataFrame:
    """Newest date per (cik, ticker)."""
    return events.groupBy("cik", "ticker").agg(F.max("date").alias("date"))


def tag_existence(flat: DataFrame, tag: str) -> DataFrame:
    """Facts, forms, accessions and periods of a tag per taxonomy."""
    return flat.filter(F.col("tag") == tag).groupBy("taxonomy").agg(
        F.count("*").alias("facts"), F.count_distinct(F.coalesce("form", F.lit("NO_FORM"))).alias("forms"),
        F.count_distinct(F.coalesce("accn", F.lit("NO_ACCN"))).alias("accessions"), F.count_distinct("period_end").alias("periods"),
    )


def similar_tags(flat: DataFrame, tag: str) -> DataFrame:
    """Tags containing the name, or sharing the words proceed or investment with it."""
    t = F.lower("tag")
    hit = t.contains(tag.lower())
    for word in ("proceed", "investment"):
        if word in tag.lower():
            hit = hit | t.contains(word)
    return flat.filter(hit).select("taxonomy", "tag").distinct()
