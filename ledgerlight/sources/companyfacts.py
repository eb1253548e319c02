"""Nested company JSON: facts by taxonomy, tag and unit; submissions as parallel arrays."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight import config as C
from ledgerlight.functions import dates as D
from ledgerlight.schema import BULK_COLUMNS, COMPANY_FACTS, SUBMISSIONS


def flatten_facts(docs: DataFrame, json: str = "json", keys: Iterable[str] = ("cik",), taxonomies: Iterable[str] | None = C.TAXONOMIES) -> DataFrame:
    """One row per fact: (keys, taxonomy, tag, unit, value, form, dates, frame, accn).

    Only the maps are exploded; unparsable dates become NULL.
    """
    ids = list(keys)
    d = docs.select(*ids, F.explode(F.from_json(json, COMPANY_FACTS)["facts"]).alias("taxonomy", "tags"))
    if taxonomies is not None:
        d = d.filter(F.col("taxonomy").isin(*taxonomies))
    d = d.select(*ids, "taxonomy", F.explode("tags").alias("tag", "concept"))
    d = d.select(*ids, "taxonomy", "tag", F.explode("concept.units").alias("unit", "facts"))
    d = d.select(*ids, "taxonomy", "tag", "unit", F.explode("facts").alias("f"))
    end = D.parse_iso(F.col("f.end"))
    return d.select(
        *ids, "taxonomy", "tag", "unit", F.col("f.val").alias("value"), F.col("f.form").alias("form"),
        D.parse_iso(F.col("f.filed")).alias("filing_date"), D.parse_iso(F.col("f.start")).alias("period_start"),
        end.alias("period_end"), end.alias("report_date"), F.col("f.frame").alias("frame"), F.col("f.accn").alias("accn"),
    )


def facts_of_filing(flat: DataFrame, adsh: str) -> DataFrame:
    """Facts of one accession number."""
    return flat.filter(F.col("accn") == adsh)


def pick_filing(flat: DataFrame, form: str, target: str | None = None, keys: Iterable[str] = ("cik",)) -> DataFrame:
    """All facts of the filing(s) holding the chosen report date, for every company at once.

    The date is the latest one, or the one nearest to `target` (the earlier on ties). All
    rows of the accessions with that date stay, also their comparative periods; where no such
    row has an accession, rows filed on the same dates stay instead.
    """
    ids = list(keys)
    rows = flat.filter(F.col("form") == form)
    goal = F.lit(target).try_cast("date") if target else F.lit(None).cast("date")
    # without a usable target the distance to the far future ranks the latest date first
    away = F.coalesce(F.abs(F.datediff("report_date", goal)), F.datediff(F.lit("9999-12-31").cast("date"), F.col("report_date")))
    spot = F.when(F.col("report_date").isNotNull(), F.struct(away.alias("away"), F.col("report_date").alias("day")))
    # a company's facts come out of one document, so they meet in one task again
    company, filing = Window.partitionBy(*ids), Window.partitionBy(*ids, "accn", "filing_date")
    # a filing holds the chosen date when its best date is the company's
    hit = F.coalesce(F.min("_spot").over(filing) == F.min("_spot").over(company), F.lit(False))
    rows = rows.withColumn("_spot", spot).withColumn("_hit", hit)
    named = F.col("_hit") & F.col("accn").isNotNull()
    by_accn = F.max(named).over(Window.partitionBy(*ids, "accn"))
    by_day = F.max("_hit").over(Window.partitionBy(*ids, "filing_date"))
    keep = F.when(F.max(named).over(company), by_accn).otherwise(by_day)
    return rows.withColumn("_keep", keep).filter("_keep").drop("_spot", "_hit", "_keep")


def sorted_filing(filing: DataFrame) -> DataFrame:
    """Display order: tag, then newest period first."""
    return filing.orderBy("tag", F.desc("period_end"))


def to_bulk(flat: DataFrame, keys: Iterable[str] = ()) -> DataFrame:
    """Facts in the bulk shape: segments, coreg and footnote are not in the JSON."""
    none = F.lit(None).cast("string")
    return flat.select(
        *keys,
        F.coalesce("accn", F.lit("")).alias("adsh"), F.coalesce("tag", F.lit("")).alias("tag"), F.col("taxonomy").alias("version"),
        D.to_int(F.col("period_end")).alias("ddate"), D.frame_to_qtrs(F.col("frame"), F.col("period_start"), F.col("period_end")).alias("qtrs"),
        F.coalesce("unit", F.lit("")).alias("uom"), none.alias("segments"), none.alias("coreg"), "value", none.alias("footnote"),
    )


def flatten_submissions(docs: DataFrame, json: str = "json", keys: Iterable[str] = ("cik",), forms: Iterable[str] = C.FORMS, as_of: str | None = None) -> DataFrame:
    """Filings from the parallel arrays; up to `as_of`, a missing date stays, an unparsable one goes."""
    ids = list(keys)
    r = F.from_json(json, SUBMISSIONS)["filings"]["recent"]
    names = {"accessionNumber": "adsh", "form": "form", "filingDate": "filed", "reportDate": "period", "acceptanceDateTime": "accepted", "primaryDocument": "primary_document", "isXBRL": "is_xbrl"}
    # an absent array counts as empty: zipping pads it with NULL
    types = {f.name: f.dataType for f in SUBMISSIONS["filings"].dataType["recent"].dataType.fields}
    zipped = F.arrays_zip(*[F.coalesce(F.col("r")[k], F.array().cast(types[k])).alias(v) for k, v in names.items()])
    rows = docs.select(*ids, r.alias("r")).select(*ids, F.inline(zipped)).filter(F.col("form").isin(*forms))
    if as_of is None:
        return rows
    day = D.parse_iso(F.col("filed"))
    return rows.filter(F.col("filed").isNull() | (F.col("filed") == "") | (day <= F.lit(as_of).cast("date")))


def company_info(docs: DataFrame, json: str = "json", keys: Iterable[str] = ("cik",)) -> DataFrame:
    """(keys, name, first ticker, numeric industry code)."""
    s = F.from_json(json, SUBMISSIONS)
    return docs.select(*keys, s.alias("s")).select(
        *keys, F.coalesce("s.name", F.lit("")).alias("name"), F.coalesce(F.try_element_at("s.tickers", F.lit(1)), F.lit("")).alias("ticker"),
        F.col("s.sic").try_cast("int").alias("sic"),
    )


def header_rows(filings: DataFrame, info: DataFrame) -> DataFrame:
    """Header-shaped rows of filings: dashes leave the dates, unknown fields are NULL."""

    def plain(c):
        return F.replace(F.coalesce(c, F.lit("")), F.lit("-"), F.lit(""))

    none = F.lit(None).cast("string")
    return filings.join(info.select("cik", "name", F.col("sic").cast("string").alias("sic")), "cik", "left").select(
        "adsh", "cik", "name", "sic", none.alias("fye"), none.alias("fy"), none.alias("fp"), "form", plain(F.col("period")).alias("period"), plain(F.col("filed")).alias("filed"), "accepted"
    )


__all__ = ["BULK_COLUMNS", "company_info", "facts_of_filing", "flatten_facts", "flatten_submissions", "header_rows", "pick_filing", "sorted_filing", "to_bulk"]
