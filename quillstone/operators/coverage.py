"""Page coverage, totals of requests, and warnings rolled up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Omissions of these reasons leave the adjusted count of pages; others don't.
MATERIAL = ("scan_noise", "date_page_stamp", "page_furniture", "no_substantive_content")


def at_least(part: Column, whole: Column, numerator: int, denominator: int) -> Column:
    """part / whole is at least numerator / denominator, in whole numbers; nothing is of an empty whole."""
    return (whole > 0) & (part <= whole) & (part * denominator >= whole * numerator)


def retention_target(pages: Column) -> Column:
    """min(n, ceil(3 n / 5) + 16, 512)."""
    return F.least(pages, F.floor((3 * pages + 4) / 5) + 16, F.lit(512)).cast("long")


def coverage(rows: DataFrame, document: str, page: str, cited: str, reason: str) -> DataFrame:
    """Per document: its pages, those cited, those left out for a material reason, the raw (half) and adjusted (three fifths)
    gates, and how many are to be kept. Rows of a page are joined first, so no row is expanded for a distinct count."""
    pages = rows.groupBy(document, page).agg(F.bool_or(cited).alias("c"), F.bool_or(F.coalesce(F.col(reason).isin(*MATERIAL), F.lit(False))).alias("o"))
    g = pages.groupBy(document).agg(F.count("*").alias("total"), F.count_if("c").alias("cited"), F.count_if(F.col("o") & ~F.col("c")).alias("omitted"))
    left = F.col("total") - F.col("omitted")
    return g.select(document, "total", "cited", "omitted", at_least(F.col("cited"), F.col("total"), 1, 2).alias("raw_ok"), at_least(F.col("cited"), left, 3, 5).alias("adjusted_ok"), retention_target(F.col("total")).alias("retained"))


def attempt_totals(calls: DataFrame, stage: str, tokens: str, elapsed: str) -> DataFrame:
    """Requests, tokens and time for each stage and overall; a null stage is a stage of its own."""
    g = calls.rollup(stage).agg(F.grouping(stage).alias("g"), F.count("*").alias("requests"), F.sum(tokens).cast("long").alias("tokens"), F.sum(elapsed).cast("long").alias("elapsed"))
    return g.select(F.col(stage).alias("stage"), (F.col("g") == 1).alias("overall"), "requests", "tokens", "elapsed")


def rolled_up(documents: DataFrame, pages: DataFrame, document: str, page: str) -> DataFrame:
    """The document's warnings, then those of its pages in order, each with its page. Both tables hold arrays, `warnings`."""
    marked = pages.select(document, F.struct(page, F.transform("warnings", lambda w: F.concat(w, F.lit(":"), F.col(page).cast("string"))).alias("w")).alias("x"))
    of_pages = marked.groupBy(document).agg(F.flatten(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["w"])).alias("of_pages"))
    return documents.join(of_pages, document, "left").select(document, F.concat("warnings", F.coalesce("of_pages", F.array().cast("array<string>"))).alias("warnings"))
