"""Scalar rules of their own: headings that may go, quotes, profiles, usage, units, acronyms, ordinals and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.plans.registry import query, table

_HEADINGS = ("Scope of the Work", "Payment is Due", "Terms", "General Terms And Conditions For a Sale", "Article 5 Terms", "The supplier", "Notices and Copies", "a b", "Überblick der Lage", "No Liability", "One Two Three Four Five Six Seven Eight Nine Ten Eleven Twelve Thirteen")


def _listed(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


@query(rf"""SELECT doc_id, length(trim(h)) <= 120 AND len(w) BETWEEN 2 AND 12 AND NOT regexp_matches(trim(h), '[^\p{{L}}\s]') AND len(list_filter(w, lambda x: lower(x) IN {T.PROHIBITED} OR NOT (regexp_matches(x, '^\p{{Lu}}') OR lower(x) IN {T.SMALL}))) = 0 AS admitted
 FROM (SELECT doc_id, h, regexp_extract_all(h, '\S+') AS w FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN {_listed(_HEADINGS)}[doc_id % {len(_HEADINGS)} + 1] ELSE left(text, 40) END AS h FROM documents))""")
def admitted_headings(spark, d):
    fixed = F.element_at(F.array(*map(F.lit, _HEADINGS)), (F.col("doc_id") % len(_HEADINGS) + 1).cast("int"))
    h = F.when(F.col("doc_id") % 2 == 0, fixed).otherwise(F.left("text", F.lit(40)))
    return table(spark, d, "documents").select("doc_id", T.heading_admitted(h).alias("admitted"))


_QUOTE = "CASE conv_id % 4 WHEN 0 THEN concat(' ', replace(text, ' ', '  '), chr(10)) WHEN 1 THEN left(text, 20) WHEN 2 THEN concat(text, ' Approved 5/19/08.') ELSE text END"
_PAGE = "CASE conv_id % 4 WHEN 2 THEN concat(text, ' Approved 5/19/08.') ELSE text END"


@query(rf"""SELECT conv_id, turn, trim(page) <> '' AND regexp_extract_all(quote, '\S+') = regexp_extract_all(page, '\S+') AS whole, trim(page) <> '' AND regexp_extract_all(quote, '\S+') = regexp_extract_all(page, '\S+') AND NOT contains(quote, '5/19/08') AS admitted FROM (SELECT conv_id, turn, {_QUOTE} AS quote, {_PAGE} AS page FROM conversations)""")
def page_omissions(spark, d):
    rows = table(spark, d, "conversations").selectExpr("conv_id", "turn", f"{_QUOTE} AS quote", f"{_PAGE} AS page")
    return rows.select("conv_id", "turn", T.whole_page(F.col("quote"), F.col("page")).alias("whole"), T.omission_admitted(F.col("quote"), F.col("page")).alias("admitted"))


_PURPOSE = "CASE o_orderkey % 5 WHEN 0 THEN 'narrative' WHEN 1 THEN 'contract' WHEN 2 THEN 'report' WHEN 3 THEN 'agreement' END"
_PARAMETERS = """CASE o_orderkey % 4 WHEN 0 THEN '{}' WHEN 1 THEN '{"mode":"story"}' WHEN 2 THEN '{"mode":"poem"}' ELSE '{"mode":"contract","x":1}' END"""


@query(f"""SELECT o_orderkey, CASE WHEN purpose IN ('narrative', 'story') THEN 'story' WHEN purpose IN ('contract', 'agreement') THEN 'contract' WHEN purpose IS NOT NULL THEN 'general' END AS profile,
 CASE WHEN mode IS NULL THEN 'general' WHEN mode IN ('general', 'story', 'contract') THEN mode END AS requested FROM (SELECT o_orderkey, {_PURPOSE} AS purpose, json_extract_string({_PARAMETERS}, '$.mode') AS mode FROM orders)""")
def profiles(spark, d):
    rows = table(spark, d, "orders").selectExpr("o_orderkey", f"{_PURPOSE} AS purpose", f"{_PARAMETERS} AS parameters")
    return rows.select("o_orderkey", T.profile_of(F.col("purpose")).alias("profile"), T.requested_profile(F.col("parameters")).alias("requested"))


_USAGE = """CASE event_id % 4 WHEN 0 THEN concat('{"prompt_eval_count":', event_id, ',"eval_count":', event_id % 9, '}') WHEN 1 THEN concat('{"eval_count":', event_id, '}') WHEN 2 THEN '{"prompt_eval_count":"x","eval_count":3}' ELSE '{}' END"""


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN event_id + event_id % 9 END AS tokens FROM events")
def provider_usage(spark, d):
    return table(spark, d, "events").selectExpr("event_id", f"{_USAGE} AS body").select("event_id", T.total_usage(F.col("body")).alias("tokens"))


@query("""SELECT c_custkey, sha256('{"claim_id":"c' || c_custkey || '","text":"' || c_mktsegment || '","pages":[' || c_nationkey || ',' || (c_nationkey + 1) || ']}') AS integrity FROM customer""")
def integrity_hashes(spark, d):
    rows = table(spark, d, "customer").selectExpr("c_custkey", "concat('c', c_custkey) AS claim_id", "c_mktsegment AS text", "array(c_nationkey, c_nationkey + 1) AS pages")
    return rows.select("c_custkey", T.fingerprint(F.struct("claim_id", "text", "pages")).alias("integrity"))


@query("""SELECT conv_id, turn, sha256('[{"page_number":' || (turn + 1) || ',"text_sha256":"' || sha256(text) || '"}]') AS source_fingerprint, 'page_furniture' AS reason, 'bare_heading' AS origin FROM conversations WHERE turn = 0""")
def omission_records(spark, d):
    page = F.array(F.struct((F.col("turn") + 1).alias("page_number"), F.sha2("text", 256).alias("text_sha256")))
    return table(spark, d, "conversations").where("turn = 0").select("conv_id", "turn", T.fingerprint(page).alias("source_fingerprint"), F.lit("page_furniture").alias("reason"), F.lit("bare_heading").alias("origin"))


_UNITS = ("dollars", "kg", "metres", "m", "reports", "usd", "gas", "days", "feet", "widgets", "percent", "bus")
_SIGNS = ("$", "€", "£", "¥", "₹", "x")


@query(f"""SELECT p_partkey, coalesce({_listed([next((n for n, s in T.UNIT_NAMES.items() if u in s.split()), u.removesuffix('s')) for u in _UNITS])}[p_partkey % {len(_UNITS)} + 1], '') AS unit, nullif({_listed([T.CURRENCIES.get(s, '') for s in _SIGNS])}[p_partkey % {len(_SIGNS)} + 1], '') AS currency FROM part""")
def unit_names(spark, d):
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("p_partkey") % len(values) + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", T.unit_word(pick(_UNITS)).alias("unit"), T.currency(pick(_SIGNS)).alias("currency"))


_SHORT = "CASE c_custkey % 6 WHEN 0 THEN concat('AB', upper(left(c_mktsegment, 2))) WHEN 1 THEN 'A' WHEN 2 THEN 'DOLs' WHEN 3 THEN 'Dol' WHEN 4 THEN 'ABCDEFGHIJK' ELSE concat('A', c_custkey) END"


@query(f"SELECT c_custkey, nullif(regexp_extract(x, '^([A-Z]{{2,10}})s?$', 1), '') AS acronym FROM (SELECT c_custkey, {_SHORT} AS x FROM customer)")
def acronyms(spark, d):
    return table(spark, d, "customer").selectExpr("c_custkey", f"{_SHORT} AS x").select("c_custkey", T.acronym(F.col("x")).alias("acronym"))


def _roman(n: int) -> str:
    out = ""
    for one, five, ten, unit in (("M", "", "", 1000), ("C", "D", "M", 100), ("X", "L", "C", 10), ("I", "V", "X", 1)):
        d, n = divmod(n, unit)
        out += one + ten if d == 9 else one + five if d == 4 else five * (d > 4) + one * (d % 5 if unit < 1000 else d)
    return out


_ROMANS = [_roman(n) for n in range(1, 90)] + ["IIII", "VX", "IC", "MMMCMXCIX", "MMMM", "007", "0", "12", "3999", "4000", ""]


@query(f"SELECT p_partkey, CASE WHEN i < 90 THEN i WHEN i = 93 THEN 3999 WHEN i = 97 THEN 12 WHEN i = 98 THEN 3999 END AS ordinal FROM (SELECT p_partkey, p_partkey % {len(_ROMANS)} + 1 AS i FROM part)")
def ordinals(spark, d):
    pick = F.element_at(F.array(*map(F.lit, _ROMANS)), (F.col("p_partkey") % len(_ROMANS) + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", T.roman_ordinal(pick).cast("long").alias("ordinal"))


_DECIMAL = "concat(CASE WHEN {0} % 3 = 0 THEN '-' ELSE '' END, {0} % 17, CASE WHEN {0} % 4 = 0 THEN concat('.', {0} % 9 + 1) WHEN {0} % 4 = 1 THEN concat('.', {0} % 5, 5) ELSE '' END)"


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(sign(CAST({_DECIMAL.format('l_partkey')} AS DECIMAL(18, 4)) - CAST({_DECIMAL.format('l_suppkey')} AS DECIMAL(18, 4))) AS INTEGER) AS ordering FROM lineitem")
def decimal_orders(spark, d):
    rows = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", f"{_DECIMAL.format('l_partkey')} AS a", f"{_DECIMAL.format('l_suppkey')} AS b")
    # The rule takes canonical decimals: -0 is 0.
    a, b = T.canonical_decimal(F.col("a")), T.canonical_decimal(F.col("b"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", T.decimal_order(a, b).alias("ordering"))


@query(r"""SELECT doc_id, CASE WHEN plain = '' THEN NULL ELSE CASE WHEN (neg AND plain <> '0') THEN '-' || plain ELSE plain END END AS canonical FROM (SELECT doc_id, starts_with(s, '-') AS neg, CASE WHEN regexp_matches(s, '^[+-]?[0-9]+(\.[0-9]+)?$') THEN
 regexp_replace(regexp_replace(CASE WHEN contains(s, '.') THEN regexp_replace(s, '0+$', '') ELSE s END, '\.$', ''), '^[+-]?0*([0-9])', '\1') ELSE '' END AS plain FROM (SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN '007.50' WHEN 1 THEN '-0.0' WHEN 2 THEN '+3' WHEN 3 THEN '1,000' WHEN 4 THEN '.5' WHEN 5 THEN '5.' WHEN 6 THEN concat('-', doc_id, '.', doc_id % 7, '0') WHEN 7 THEN '1.2.3' ELSE concat(doc_id, '00') END AS s FROM documents))""")
def numeric_values(spark, d):
    s = F.expr("CASE doc_id % 9 WHEN 0 THEN '007.50' WHEN 1 THEN '-0.0' WHEN 2 THEN '+3' WHEN 3 THEN '1,000' WHEN 4 THEN '.5' WHEN 5 THEN '5.' WHEN 6 THEN concat('-', doc_id, '.', doc_id % 7, '0') WHEN 7 THEN '1.2.3' ELSE concat(doc_id, '00') END")
    return table(spark, d, "documents").select("doc_id", T.canonical_decimal(s).alias("canonical"))


@query("""SELECT doc_id, len(list_filter(range(0, len(w) - 1), lambda i: w[i + 1] = n[1] AND w[i + 2] = n[2])) > 0 AS held FROM (SELECT doc_id, regexp_extract_all(text, '\\S+') AS w, CASE WHEN doc_id % 2 = 0 THEN regexp_extract_all(text, '\\S+')[3:4] ELSE ['the', 'of'] END AS n FROM documents) WHERE len(n) = 2""".replace("\\\\", "\\"))
def contained_sequences(spark, d):
    w = T.words(F.col("text"))
    rows = table(spark, d, "documents").select("doc_id", w.alias("w"), F.when(F.col("doc_id") % 2 == 0, F.slice(w, 3, 2)).otherwise(F.array(F.lit("the"), F.lit("of"))).alias("n"))
    return rows.where("size(n) = 2").select("doc_id", T.contains_sequence(F.col("w"), F.col("n")).alias("held"))


_NUMBERED = "CASE o_orderkey % 7 WHEN 0 THEN '§ 1.2) Title' WHEN 1 THEN '§§ 3 Scope' WHEN 2 THEN '1.2 scope' WHEN 3 THEN '1.2' WHEN 4 THEN '4.) Fees' WHEN 5 THEN 'Title 4' ELSE '2..1 Fees' END"


@query("SELECT o_orderkey, o_orderkey % 7 IN (0, 1, 4) AS numbered FROM orders")
def numbered_lines(spark, d):
    return table(spark, d, "orders").selectExpr("o_orderkey", f"{_NUMBERED} AS line").select("o_orderkey", T.numbered_line(F.col("line")).alias("numbered"))
