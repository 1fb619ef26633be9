"""Lines, running metadata and what is left of pages without it: conversations with headers and footers put around their turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators import furniture
from quillstone.plans.registry import query, table

_TOP = "CASE conv_id % 4 WHEN 0 THEN 'MASTER SERVICE AGREEMENT' WHEN 1 THEN concat('Page ', turn + 1, ' of 40') WHEN 2 THEN concat('Acme Report | ', turn + 1) ELSE concat('Note ', turn * 7) END"
_BOTTOM = "CASE conv_id % 5 WHEN 0 THEN 'Confidential' WHEN 1 THEN concat(turn + 1, ' March 3, 2020') WHEN 2 THEN concat('', turn + 1) WHEN 3 THEN 'Payment shall be made.' ELSE concat('Service Agreement page ', turn + 1, ' of 40 June 5, 2021') END"
_BODY = "CASE WHEN conv_id % 5 = 0 AND turn = 1 THEN ' ' ELSE text END"
_PAGE = f"concat({_TOP}, chr(10), {_BODY}, chr(10), {_BOTTOM})"


def _blocks(spark, d):
    return table(spark, d, "conversations").selectExpr("concat('', conv_id) AS document_id", "turn + 1 AS page_number", "0 AS block_index", f"{_PAGE} AS text")


@query(f"""SELECT document_id, page_number, CAST(i - 1 AS INTEGER) AS line_no, CAST(coalesce(list_sum(list_transform(ls[1:i - 1], lambda x: strlen(x) + 1)), 0) AS BIGINT) AS "start", CAST(least(list_sum(list_transform(ls[1:i], lambda x: strlen(x) + 1)), bytes) AS BIGINT) AS "end"
 FROM (SELECT document_id, page_number, ls, bytes, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT concat('', conv_id) AS document_id, turn + 1 AS page_number, string_split({_PAGE}, chr(10)) AS ls, strlen({_PAGE}) AS bytes FROM conversations))""")
def page_lines(spark, d):
    return furniture.lines(_blocks(spark, d)).select("document_id", "page_number", "line_no", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


_METADATA = {
    "Exhibit 10.4": ("exhibit 10.4", False), "12 March 3, 2020": ("# march 3, 2020", True), "Monday, March 3, 2020": ("monday, march 3, 2020", True), "Acme | Page 3 of 9": ("acme | page #  of 9".replace("#  ", "# "), True), "Page 7": ("page #", False),
    "Page 9 of 3": None, "page": None, "You shall pay page 3": None, "1. Scope page 3": None, "Ends. page 2": ("ends. page #", True), "INTERNAL USE ONLY": ("internal use only", False), "Annual Report": ("annual report", False),
    "Annual Report | 12": ("annual report | #", True), "Annual Report 0": None, "v1.2": None, "Just text": None, "Fees: $ 5 page 2": None, "Page 3 June 5, 2021": ("page # june 5, 2021", True), "Page 3 May 5, 2021": None, "0 March 3, 2020": None,
}
_LINES, _KEYS = list(_METADATA), list(_METADATA.values())


def _quoted(values) -> str:
    return "[" + ", ".join("NULL" if v is None else str(v).upper() if isinstance(v, bool) else "'" + v + "'" for v in values) + "]"


@query(f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN {_quoted([k and k[0] for k in _KEYS])}[doc_id % {len(_LINES)} + 1] END AS key, CASE WHEN doc_id % 2 = 0 THEN {_quoted([k and k[1] for k in _KEYS])}[doc_id % {len(_LINES)} + 1] END AS strong FROM documents")
def metadata_keys(spark, d):
    line = F.when(F.col("doc_id") % 2 == 0, F.element_at(F.array(*map(F.lit, _LINES)), (F.col("doc_id") % len(_LINES) + 1).cast("int"))).otherwise(F.substring_index("text", "\n", 1))
    return table(spark, d, "documents").select("doc_id", T.metadata_key(line).alias("m")).select("doc_id", "m.key", "m.strong")


_CUT = f"""(SELECT *, n >= 2 AS repeated FROM (SELECT concat('', conv_id) AS document_id, conv_id, turn + 1 AS page_number, {_TOP} AS top, {_BOTTOM} AS bottom, {_BODY} AS body, strlen({_PAGE}) AS bytes, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations))"""
_TOP_GOES, _BOTTOM_GOES = "(conv_id % 4 = 1 OR (conv_id % 4 IN (0, 2) AND repeated))", "(conv_id % 5 = 2 OR (conv_id % 5 IN (0, 1, 4) AND repeated))"


@query(f"""SELECT document_id, page_number, CAST(CASE WHEN {_TOP_GOES} THEN strlen(top) + 1 ELSE 0 END AS BIGINT) AS "start", CAST(CASE WHEN {_BOTTOM_GOES} THEN bytes - strlen(bottom) ELSE bytes END AS BIGINT) AS "end" FROM {_CUT}""")
def retained_ranges(spark, d):
    blocks = _blocks(spark, d)
    return furniture.retained(blocks, furniture.furniture(blocks)).select("document_id", "page_number", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query(f"SELECT document_id, page_number FROM {_CUT} WHERE trim(body) = '' AND {_TOP_GOES} AND {_BOTTOM_GOES}")
def furniture_pages(spark, d):
    blocks = _blocks(spark, d)
    return furniture.excluded_pages(blocks, furniture.retained(blocks, furniture.furniture(blocks)))


_NOTICE = "concat('Copyright 2020 Acme.', chr(10), 'All rights', chr(10), 'reserved. Acme is a trademark.', chr(10), chr(10), turn + 1, chr(10))"


@query(f"""SELECT concat('', conv_id) AS document_id, turn + 1 AS page_number, CAST(CASE WHEN count(*) OVER (PARTITION BY conv_id) >= 2 AND conv_id % 3 <> 1 THEN strlen({_NOTICE}) ELSE 0 END AS BIGINT) AS "start" FROM conversations WHERE conv_id % 3 <> 2""")
def notice_ranges(spark, d):
    text = f"concat(CASE WHEN conv_id % 3 = 0 THEN {_NOTICE} ELSE replace({_NOTICE}, 'trademark', 'firm') END, text)"
    blocks = table(spark, d, "conversations").where("conv_id % 3 <> 2").selectExpr("concat('', conv_id) AS document_id", "turn + 1 AS page_number", "0 AS block_index", f"{text} AS text")
    kept = furniture.retained(blocks, furniture.furniture(blocks))
    return kept.groupBy("document_id", "page_number").agg(F.min("start").cast("long").alias("start"))
