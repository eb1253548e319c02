"""Statistics kept for each data quarter: a new quarter is read alone, old ones are never read again.

Values of features lie sorted in blocks, cut into cells of at most `CELL` rows, with one summary row
for each cell. Exact quantiles and counts beyond limits follow from the summaries; only the cells that a
quantile or a limit cuts through are read. Companies of a quarter are kept as sets of company numbers
whose union is counted exactly. A quarter that is added again replaces its former rows.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlight import config as C
from ledgerlight.functions.numeric import safe_divide
from ledgerlight.operators.features import bounds_of, range_checks
from ledgerlight.operators.ordered import quantiles_of_counts
from ledgerlight.session import delete_paths, durable

#: Rows of a cell: the values read for one quantile are some cells of each quarter.
CELL = 4096
#: Companies of a number range kept as a list; beyond, a bitmap of 4 KB takes less room.
FEW = 1024

_VALUES = "feature string, cell long, value double, data_qtr string, block int"
_CELLS = "block int, feature string, cell long, n long, lo double, hi double, mean double, m2 double, data_qtr string"
_CELL_KEY = ["data_qtr", "block", "feature", "cell"]
QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def add_values(tall: DataFrame, path: str, quarters: Sequence[str], cell: int = CELL) -> None:
    """Store the values of some quarters; `tall` holds (data_qtr, feature, value).

    Only rows of `quarters` are read, once. Rows without a value or a feature name count nowhere. The
    summaries are made from the stored values and written last: until then the quarter counts as
    missing, so a run that ended early is repeated whole.
    """
    odd = [q for q in quarters if not re.fullmatch(r"\w+", q)]
    if odd:
        raise ValueError(f"quarters are named by letters and digits, not {odd}")
    spark = tall.sparkSession
    delete_paths(spark, *[f"{path}/{part}/data_qtr={q}" for part in ("cells", "values") for q in quarters])
    known = tall.filter(F.col("data_qtr").isin(*quarters) & F.col("value").isNotNull() & F.col("feature").isNotNull())
    # written first: the range borders are sampled, which would run what is before a second time
    known = durable(known.select("data_qtr", "feature", F.col("value").cast("double").alias("value")))
    order = ["data_qtr", "feature", "value"]
    blocks = known.repartitionByRange(*order).sortWithinPartitions(*order)
    # the lower 33 bits of the id count the rows of a task
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = blocks.withColumn("cell", F.floor(place / cell)).withColumn("block", F.spark_partition_id())
    rows.write.mode("append").partitionBy("data_qtr", "block").parquet(f"{path}/values")
    stored = _read(spark, path, "values").filter(F.col("data_qtr").isin(*quarters))
    cells = stored.groupBy(*_CELL_KEY).agg(
        F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.avg("value").alias("mean"),
        (F.var_pop("value") * F.count("*")).alias("m2"),
    )
    cells.write.mode("append").partitionBy("data_qtr").parquet(f"{path}/cells")


def _read(spark: SparkSession, path: str, part: str) -> DataFrame:
    return spark.read.schema(_VALUES if part == "values" else _CELLS).parquet(f"{path}/{part}")


def _open(spark: SparkSession, path: str, cells: DataFrame) -> DataFrame:
    """Values of the given cells next to the cells' columns; only their blocks' files are read."""
    cells = durable(cells)
    # a row for each block at most, fewer than the files that are listed anyway
    blocks = [f"{r['data_qtr']}/{r['block']}" for r in cells.select("data_qtr", "block").distinct().collect()]
    here = F.concat_ws("/", "data_qtr", F.col("block").cast("string")).isin(*blocks) if blocks else F.lit(False)
    return _read(spark, path, "values").filter(here).join(cells, _CELL_KEY)


def value_quarters(spark: SparkSession, path: str) -> list[str]:
    """Quarters whose values are stored."""
    return sorted(r["data_qtr"] for r in _read(spark, path, "cells").select("data_qtr").distinct().collect())


def stored_quantiles(spark: SparkSession, path: str, probs: Mapping[str, float] | None = None) -> DataFrame:
    """Exact linear-interpolated quantiles of each feature over all stored quarters: (feature, n, …).

    The summaries bracket each quantile: at most k values lie below the largest cell start with k
    values in the cells that start before it, and at least k up to the smallest cell end with k values
    in the cells that end by then. A cell of one value needs no reading, whatever its size.
    """
    probs = dict(QUARTILES if probs is None else probs)
    cells = _read(spark, path, "cells")
    of = Window.partitionBy("feature")
    by_lo, by_hi = of.orderBy("lo"), of.orderBy("hi")  # frames reach over equal values
    marked = cells.select(
        "feature", "lo", "hi", F.sum("n").over(of).alias("_all"), F.sum("n").over(by_hi).alias("_until"),
        (F.sum("n").over(by_lo) - F.sum("n").over(Window.partitionBy("feature", "lo"))).alias("_before"),
    )
    at = [(F.col("_all") - 1) * F.lit(float(p)) for p in probs.values()]
    low = [F.max(F.when(F.col("_before") <= F.floor(k), F.col("lo"))) for k in at]
    high = [F.min(F.when(F.col("_until") > F.ceil(k), F.col("hi"))) for k in at]
    brackets = marked.groupBy("feature").agg(
        F.first("_all").alias("_total"), F.array(*[F.struct(F.lit(i).alias("q"), a.alias("lo"), b.alias("hi")) for i, (a, b) in enumerate(zip(low, high))]).alias("_q")
    )
    near = cells.join(brackets, "feature").select("*", F.explode("_q").alias("_b")).filter(F.col("lo") <= F.col("_b.hi"))
    below = F.col("hi") < F.col("_b.lo")
    whole = near.filter(below | (F.col("lo") == F.col("hi"))).select("feature", "_total", "_b", F.when(~below, F.col("lo")).alias("_v"), "n")
    cut = near.filter(~below & (F.col("lo") < F.col("hi"))).select(*_CELL_KEY, "_total", "_b")
    read = _open(spark, path, cut).filter(F.col("value") <= F.col("_b.hi"))
    read = read.select("feature", "_total", "_b", F.when(F.col("value") >= F.col("_b.lo"), F.col("value")).alias("_v"), F.lit(1).cast("long").alias("n"))
    counts = whole.unionByName(read).groupBy(F.col("feature").alias("_g"), F.col("_total").alias("n"), F.col("_b.q").alias("q"), "_v").agg(F.sum("n").alias("_n"))
    return quantiles_of_counts(counts, probs).withColumnRenamed("_g", "feature")


def stored_moments(spark: SparkSession, path: str) -> DataFrame:
    """(feature, non_null, mean_value, std_value) over all stored quarters, from the summaries alone."""
    of = Window.partitionBy("feature")
    total = F.sum("n").over(of)
    centre = F.sum(F.col("mean") * F.col("n")).over(of) / total
    away = F.col("mean") - F.col("_mean")
    cells = _read(spark, path, "cells").withColumn("_mean", centre)
    return cells.groupBy("feature").agg(
        F.sum("n").alias("non_null"), F.first("_mean").alias("mean_value"),
        F.sqrt(F.try_divide(F.sum(F.col("m2") + F.col("n") * away * away), F.sum("n") - 1)).alias("std_value"),
    )


def stored_bounds(spark: SparkSession, path: str) -> dict[str, tuple[float, float]]:
    """Extreme bounds of the stored ratios, for `expected_range_flag` and `extreme_flag` of new rows."""
    return bounds_of(stored_quantiles(spark, path).withColumnRenamed("feature", "ratio").collect())


def _sides(v: Column, names: Mapping[str, str], bounds: Mapping[str, tuple[float, float]]) -> dict[str, Column]:
    """Checks of one value, each true on one side of one limit."""
    found: dict[str, Column] = {}
    for c, name in names.items():
        checks = range_checks(v, name)
        if c in bounds:
            checks |= {"extreme_low": v < bounds[c][0], "extreme_high": v > bounds[c][1]}
        for kind, check in checks.items():
            found[kind] = F.when(F.col("feature") == c, check).otherwise(found.get(kind, F.lit(False)))
    return found


def stored_outlier_report(spark: SparkSession, path: str, ratios: Sequence[C.Ratio] = C.RATIOS) -> DataFrame:
    """`features.outlier_report` of the stored ratios: cells on one side of every limit count as a whole."""
    names = {r.column: r.name for r in ratios}
    quarts = stored_quantiles(spark, path).filter(F.col("feature").isin(*names)).withColumnRenamed("feature", "ratio").collect()
    bounds = bounds_of(quarts)
    cells = _read(spark, path, "cells").filter(F.col("feature").isin(*names))
    at_lo, at_hi = _sides(F.col("lo"), names, bounds), _sides(F.col("hi"), names, bounds)
    mixed = F.lit(False)
    for kind in at_lo:
        mixed = mixed | (at_lo[kind] != at_hi[kind])
    whole = cells.filter(~mixed).select("feature", "n", "lo", "hi", (F.col("mean") * F.col("n")).alias("_sum"))
    read = _open(spark, path, cells.filter(mixed).select(*_CELL_KEY))
    one = read.select("feature", F.lit(1).cast("long").alias("n"), F.col("value").alias("lo"), F.col("value").alias("hi"), F.col("value").alias("_sum"))
    extreme = at_lo.get("extreme_low", F.lit(False)) | at_lo.get("extreme_high", F.lit(False))
    kinds = {k: at_lo.get(k, F.lit(False)) for k in ("below_typical_min", "above_typical_max", "exceeds_upper_bound", "below_lower_bound")}
    stats = whole.unionByName(one).groupBy(F.col("feature").alias("ratio")).agg(
        F.sum("n").alias("non_null"), (F.sum("_sum") / F.sum("n")).alias("mean_value"),
        *[F.sum(F.when(check, F.col("n")).otherwise(0)).alias(k) for k, check in (kinds | {"extreme_iqr": extreme}).items()],
        F.min(F.when(extreme, F.col("lo"))).alias("min_outlier"), F.max(F.when(extreme, F.col("hi"))).alias("max_outlier"),
    )
    med = spark.createDataFrame([(r["ratio"], r["median"]) for r in quarts], "ratio string, median_value double")
    skew = F.abs(safe_divide(F.col("mean_value"), F.col("median_value")))
    return stats.join(med, "ratio").withColumn("mean_median_flag", F.coalesce((skew > 10) | (skew < 0.1), F.lit(False)))


def company_sets(facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Companies of each (data_qtr, keys) as sets over number ranges, with the counted filings.

    Ranges hold 32,768 numbers: up to `FEW` companies stay a list, more become a bitmap. Company
    numbers are whole; rows without one count as occurrences only. Store the rows with
    `sinks.write_features`, which replaces the quarters at hand.
    """
    cik = F.col("cik").cast("long")
    # one row for each company of a key first: a list is made of at most 32,768 numbers
    each = facts.groupBy("data_qtr", *keys, cik.alias("_cik")).agg(F.count("adsh").alias("occurrences"))
    at = ["data_qtr", *keys, "bucket"]
    each = each.withColumns({"bucket": F.bitmap_bucket_number("_cik"), "_pos": F.bitmap_bit_position("_cik")})
    sets = durable(each.groupBy(*at).agg(F.sum("occurrences").alias("occurrences"), F.sort_array(F.collect_list("_pos")).alias("few")))
    small = F.size("few") <= FEW
    bits = sets.filter(~small).select(*at, "occurrences", F.explode("few").alias("_pos"))
    dense = bits.groupBy(*at, "occurrences").agg(F.bitmap_construct_agg("_pos").alias("bits"))
    return sets.filter(small).withColumn("bits", F.lit(None).cast("binary")).unionByName(dense.withColumn("few", F.lit(None).cast("array<bigint>")))


def count_companies(sets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, companies, occurrences) over all rows of `company_sets`: the union of their sets, counted."""
    listed = sets.select(*keys, "bucket", F.explode("few").alias("_pos")).groupBy(*keys, "bucket").agg(F.bitmap_construct_agg("_pos").alias("bits"))
    packed = sets.filter(F.col("bits").isNotNull()).select(*keys, "bucket", "bits")
    union = listed.unionByName(packed).groupBy(*keys, "bucket").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("companies"))
    none = F.lit(0).cast("long")
    both = union.select(*keys, "companies", none.alias("occurrences")).unionByName(sets.select(*keys, none.alias("companies"), "occurrences"))
    return both.groupBy(*keys).agg(F.sum("companies").alias("companies"), F.sum("occurrences").alias("occurrences"))


def tag_stats(sets: DataFrame) -> DataFrame:
    """`facts.tag_stats` of stored sets by tag."""
    return count_companies(sets, ["tag"]).select("tag", "occurrences", F.col("companies").alias("distinct_companies"))


def tag_population(sets: DataFrame, tags: Sequence[str], form: str = "10-Q") -> DataFrame:
    """`explore.tag_population` of stored sets by form and tag."""
    one = F.when(F.col("tag").isin(*tags), F.col("tag"))
    every = F.filter(F.array(F.lit(""), one), lambda t: t.isNotNull())  # the set without a name is that of all tags
    counted = count_companies(sets.filter(F.col("form") == form).withColumn("_set", F.explode(every)), ["_set"])
    listed = sets.sparkSession.createDataFrame([(t,) for t in tags], "tag string")
    total = counted.filter("_set = ''").agg(F.max("companies").alias("n"))
    n = F.coalesce("companies", F.lit(0)).alias("companies")
    joined = listed.join(counted.filter("_set <> ''").withColumnRenamed("_set", "tag"), "tag", "left").select("tag", n)
    return joined.withColumn("pct", F.coalesce(F.try_divide(F.col("companies") * 100.0, total.scalar()), F.lit(0.0)))


def form_overlap(sets: DataFrame, first: str = "10-K", second: str = "10-Q") -> DataFrame:
    """`explore.form_overlap` of stored sets by form: both are what the two sets hold beyond their union."""
    mine = F.array(F.when(F.col("form") == first, "a"), F.when(F.col("form") == second, "b"), F.when(F.col("form").isin(first, second), "any"))
    marked = sets.withColumn("_set", F.explode(F.filter(mine, lambda s: s.isNotNull())))
    counted = count_companies(marked, ["_set"])

    def of(name: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("_set") == name, F.col("companies"))), F.lit(0).cast("long"))

    return counted.agg(of("a").alias("with_first"), of("b").alias("with_second"), (of("a") + of("b") - of("any")).alias("with_both"))
