"""Pages, blocks, headings and chunks: conversations stand for documents, their turns for pages, with headings put before the text."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.operators import structure
from quillstone.plans.registry import query, table

#: Headings of every shape, by the same SQL in both engines: new, repeated, without their parent, too deep a number, no heading.
_HEAD = """CASE (conv_id + turn * 3) % 8 WHEN 0 THEN concat(turn + 1, '. Payment Terms') WHEN 1 THEN concat('1.', turn + 1, ' Delivery') WHEN 2 THEN concat('1.1.', turn, '. Notices')
 WHEN 3 THEN '2) Term' WHEN 4 THEN '' WHEN 5 THEN '1. payment in lower case' WHEN 6 THEN concat(turn, '.1 Fees') ELSE '1.1 Fees and Costs.' END"""
_TEXT = f"concat({_HEAD}, chr(10), text)"
_BLANKED = "CASE WHEN conv_id % 9 = 4 AND turn = 1 THEN ' ' ELSE text END"


def _pages(spark, d):
    """document_id, page_number, text, visual, warnings."""
    rows = table(spark, d, "conversations").selectExpr("concat('', conv_id) AS document_id", "turn + 1 AS page_number", f"{_TEXT} AS text")
    return rows.withColumns({"visual": F.lit(False), "warnings": F.array().cast("array<string>")})


def _outlined(spark, d):
    return structure.outline(structure.blocks_of(structure.normalize(_pages(spark, d))))


_HASH = "sha256(encode({tag}) || '\\x00'::blob || encode(document_id) || '\\x00'::blob || encode('1.0.0') || '\\x00'::blob || {rest})"
_NB = "'nb-' || " + _HASH.format(tag="'normalized-block'", rest="unhex(lpad(hex(page_number), 8, '0')) || unhex('00000000')")
_BLOCKS = f"SELECT concat('', conv_id) AS document_id, turn + 1 AS page_number, {_TEXT} AS text FROM conversations"
_SIGNALS = rf"""b AS (SELECT *, {_NB} AS block_id, row_number() OVER (PARTITION BY document_id ORDER BY page_number) AS n, trim(regexp_extract(text, '^\s*([^\n]*)', 1)) AS line FROM ({_BLOCKS})),
 s0 AS (SELECT *, regexp_extract(line, '^([0-9]+(?:\.[0-9]+)*)', 1) AS num FROM b), s1 AS (SELECT *, substr(line, length(num) + 1) AS rest FROM s0),
 s2 AS (SELECT *, trim(regexp_replace(rest, '^[.)]', '')) AS ttl, list_transform(string_split(num, '.'), lambda x: TRY_CAST(x AS BIGINT)) AS nums FROM s1),
 s AS (SELECT *, CASE WHEN num <> '' AND length(line) <= 120 AND (rest = '' OR regexp_matches(rest, '^[.\t\f ]') OR (starts_with(rest, ')') AND NOT contains(num, '.'))) AND len(nums) <= 6
 AND len(list_filter(nums, lambda x: NOT coalesce(x BETWEEN 1 AND 999, false))) = 0 AND (ttl = '' OR (regexp_matches(ttl, '^\p{{Lu}}') AND len(regexp_extract_all(ttl, '\S+')) <= 12 AND NOT regexp_matches(ttl, '[.!?;]$'))) THEN nums END AS parts FROM s2),
 f AS (SELECT document_id, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS last, CAST([] AS VARCHAR[]) AS seen, false AS heads, 0 AS node, false AS opens FROM s GROUP BY 1 UNION ALL
 SELECT document_id, n, CASE WHEN heads THEN parts ELSE last END, CASE WHEN heads THEN list_append(seen, array_to_string(parts, '.')) ELSE seen END, heads, CASE WHEN heads OR node = 0 THEN node + 1 ELSE node END, heads OR node = 0 FROM
 (SELECT s.document_id, s.n, f.last, f.seen, f.node, s.parts, s.parts IS NOT NULL AND NOT list_contains(f.seen, array_to_string(s.parts, '.')) AND f.last[1:len(s.parts) - 1] = s.parts[1:len(s.parts) - 1] AS heads FROM f JOIN s ON s.document_id = f.document_id AND s.n = f.n + 1)),
 o AS (SELECT s.*, f.node, f.opens, f.heads, CASE WHEN f.heads THEN array_to_string(s.parts, '.') END AS numbering, CASE WHEN f.heads THEN len(s.parts) WHEN f.opens THEN 1 END AS level,
 CASE WHEN f.heads THEN CASE len(s.parts) WHEN 1 THEN 'section' ELSE 'subsection' END WHEN f.opens THEN 'unstructured' END AS kind, CASE WHEN f.heads AND ttl <> '' THEN ttl END AS title FROM f JOIN s USING (document_id, n))"""
_TREE = _SIGNALS + rf""",
 h AS (SELECT o.document_id, o.node, o.kind, o.level, o.title, coalesce(p.node, 0) AS parent FROM o LEFT JOIN o p ON p.document_id = o.document_id AND p.numbering = array_to_string(o.parts[1:len(o.parts) - 1], '.') AND o.heads AND len(o.parts) > 1 WHERE o.opens),
 c AS (SELECT *, row_number() OVER (PARTITION BY document_id, parent ORDER BY node) - 1 AS child FROM h),
 w AS (SELECT document_id, node, '0000000000' AS unused, '00000000' || lpad(hex(child), 8, '0') AS steps, CAST(child AS VARCHAR) AS path, child AS top FROM c WHERE parent = 0 UNION ALL
 SELECT c.document_id, c.node, '', w.steps || lpad(hex(c.child), 8, '0'), w.path || '.' || c.child, w.top FROM w JOIN c ON c.document_id = w.document_id AND c.parent = w.node),
 g AS (SELECT document_id, node, string_agg('00' || hex(encode(block_id)), '' ORDER BY n) AS held FROM o GROUP BY 1, 2),
 t AS (SELECT document_id, node, kind, level, title, path, top, 'sn-' || {_HASH.format(tag="'structure-node'", rest="encode(kind) || unhex(lpad(hex(level), 8, '0')) || unhex(steps) || '\\x00'::blob || encode(coalesce(title, '')) || unhex(held)")} AS node_id
 FROM c JOIN w USING (document_id, node) JOIN g USING (document_id, node))"""


@query(f"""SELECT document_id, page_number, 'nb-' || {_HASH.format(tag="'normalized-block'", rest="unhex(lpad(hex(page_number), 8, '0')) || unhex('00000000')")} AS block_id, sha256(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS text_sha256, contains(text, chr(13)) AS cleaned
 FROM (SELECT concat('', conv_id) AS document_id, turn + 1 AS page_number, concat(text, CASE turn % 3 WHEN 0 THEN concat(chr(13), chr(10), 'x') WHEN 1 THEN concat(chr(13), 'y') ELSE '' END) AS text FROM conversations)""")
def normalized_pages(spark, d):
    tail = "CASE turn % 3 WHEN 0 THEN concat(chr(13), chr(10), 'x') WHEN 1 THEN concat(chr(13), 'y') ELSE '' END"
    pages = table(spark, d, "conversations").selectExpr("concat('', conv_id) AS document_id", "turn + 1 AS page_number", f"concat(text, {tail}) AS text").withColumns({"visual": F.lit(False), "warnings": F.array().cast("array<string>")})
    return structure.normalize(pages).select("document_id", "page_number", "block_id", F.sha2("text", 256).alias("text_sha256"), F.array_contains("warnings", "REPRESENTATION_CLEANUP_APPLIED").alias("cleaned"))


@query(f"WITH RECURSIVE {_SIGNALS} SELECT document_id, page_number, node, opens, kind, CAST(level AS INTEGER) AS level, title FROM o")
def structure_outline(spark, d):
    return _outlined(spark, d).select("document_id", "page_number", "node", "opens", "kind", "level", "title")


@query(f"WITH RECURSIVE {_TREE} SELECT document_id, node, kind, title, path, node_id FROM t")
def structure_nodes(spark, d):
    found = structure.nodes(_outlined(spark, d)).where("node > 0")
    return found.select("document_id", "node", "kind", "title", F.array_join(F.slice("path", 2, 10), ".").alias("path"), "node_id")


_CHUNKED = _TREE + """,
 u AS (SELECT o.document_id, o.n, o.block_id, o.text, length(o.text) AS len, w.top, row_number() OVER (PARTITION BY o.document_id, w.top ORDER BY o.n) AS i FROM o JOIN w USING (document_id, node)),
 p AS (SELECT document_id, top, i, len AS pending, 0 AS chunk FROM u WHERE i = 1 UNION ALL
 SELECT u.document_id, u.top, u.i, CASE WHEN p.pending + 2 + u.len > 1200 THEN u.len ELSE p.pending + 2 + u.len END, CASE WHEN p.pending + 2 + u.len > 1200 THEN p.chunk + 1 ELSE p.chunk END FROM p JOIN u ON u.document_id = p.document_id AND u.top = p.top AND u.i = p.i + 1),
 k AS (SELECT document_id, top, chunk, min(n) AS page_start, max(n) AS page_end, string_agg('00' || hex(encode(block_id)), '' ORDER BY n) AS held, string_agg(text, chr(10) || chr(10) ORDER BY n) AS text FROM p JOIN u USING (document_id, top, i) GROUP BY 1, 2, 3),
 m AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY top, chunk) AS ordinal FROM k)"""


@query(f"""WITH RECURSIVE {_CHUNKED} SELECT document_id, ordinal, page_start, page_end, length(text) > 1200 AS exceeds_target, 'ch-' || {_HASH.format(tag="'document-chunk'", rest="unhex(lpad(hex(ordinal), 8, '0')) || encode(node_id) || unhex(held) || '\\x00'::blob || encode(text)")} AS chunk_id
 FROM m JOIN (SELECT document_id, top, node_id FROM t WHERE path = CAST(top AS VARCHAR)) USING (document_id, top)""")
def structure_chunks(spark, d):
    outlined = _outlined(spark, d)
    made = structure.chunks(outlined, structure.nodes(outlined), limit=1200)
    return made.select("document_id", F.col("ordinal").cast("long").alias("ordinal"), "page_start", "page_end", "exceeds_target", "chunk_id")


@query(f"WITH RECURSIVE {_TREE} SELECT document_id, title AS hint, CAST(row_number() OVER (PARTITION BY document_id ORDER BY min(node)) AS BIGINT) AS place FROM t WHERE title IS NOT NULL GROUP BY 1, 2 QUALIFY place <= 16")
def heading_hints(spark, d):
    return structure.heading_hints(structure.nodes(_outlined(spark, d))).select("document_id", "hint", F.col("place").cast("long").alias("place"))


@query(r"""SELECT 'parse' AS stage, document_id, 'PAGES_OUT_OF_ORDER' AS code FROM p GROUP BY document_id HAVING min(page_number) <> 1 OR max(page_number) <> count(*) OR count(DISTINCT page_number) <> count(*)
 UNION ALL SELECT DISTINCT 'parse', document_id, 'BLANK_PAGE_UNMARKED' FROM p WHERE trim(text) = '' AND NOT visual""".replace("FROM p ", f"FROM (SELECT concat('', conv_id) AS document_id, CASE WHEN conv_id % 11 = 3 AND turn > 0 THEN turn + 2 ELSE turn + 1 END AS page_number, {_BLANKED} AS text, conv_id % 2 = 0 AS visual FROM conversations) "))
def parsed_violations(spark, d):
    pages = table(spark, d, "conversations").selectExpr("concat('', conv_id) AS document_id", "CASE WHEN conv_id % 11 = 3 AND turn > 0 THEN turn + 2 ELSE turn + 1 END AS page_number", f"{_BLANKED} AS text", "conv_id % 2 = 0 AS visual")
    return structure.parsed_violations(pages.withColumn("warnings", F.when(F.col("visual"), F.array(F.lit("NO_NATIVE_TEXT"))).otherwise(F.array().cast("array<string>"))))


@query("""SELECT DISTINCT 'normalize' AS stage, concat('', conv_id) AS document_id, CASE conv_id % 7 WHEN 0 THEN 'TEXT_CHANGED' WHEN 1 THEN 'PAGE_COUNT_CHANGED' WHEN 2 THEN 'VISUAL_ROUTING_CHANGED' WHEN 3 THEN 'BLOCK_IDENTITY' ELSE 'WARNINGS_CHANGED' END AS code
 FROM conversations WHERE conv_id % 7 < 5 AND turn = 1""")
def normalized_violations(spark, d):
    parsed = _pages(spark, d)
    kind, second = F.col("document_id").cast("long") % 7, F.col("page_number") == 2
    stored = structure.normalize(parsed).where(~((kind == 1) & second))
    changed = {
        "text": F.when((kind == 0) & second, F.concat("text", F.lit("!"))).otherwise(F.col("text")), "visual": F.when((kind == 2) & second, True).otherwise(F.col("visual")),
        "block_id": F.when((kind == 3) & second, F.lit("nb-0")).otherwise(F.col("block_id")), "warnings": F.when((kind == 4) & second, F.array(F.lit("OTHER"))).otherwise(F.col("warnings")),
    }
    return structure.normalized_violations(stored.withColumns(changed), parsed)


@query(f"""SELECT DISTINCT 'structure_input' AS stage, document_id, code FROM (SELECT concat('', conv_id) AS document_id, CASE conv_id % 5 WHEN 0 THEN 'BLOCK_IDENTITY' WHEN 1 THEN 'BLANK_BLOCK' WHEN 2 THEN 'PAGES_OUT_OF_ORDER' END AS code, turn FROM conversations) WHERE code IS NOT NULL AND turn = 1""")
def structure_input_violations(spark, d):
    kind, second = F.col("document_id").cast("long") % 5, F.col("page_number") == 2
    normalized = structure.normalize(_pages(spark, d))
    blocks = structure.blocks_of(normalized)
    blocks = blocks.union(blocks.where((kind == 0) & second)).withColumn("text", F.when((kind == 1) & second, " ").otherwise(F.col("text")))
    return structure.block_violations(blocks, normalized.where(~((kind == 2) & (F.col("page_number") == 1)) | (kind != 2)).join(normalized.where("page_number = 2").select("document_id"), "document_id", "left_semi"))


@query(f"""WITH RECURSIVE {_TREE} SELECT 'structure' AS stage, document_id, code FROM (SELECT document_id, CAST(document_id AS BIGINT) % 5 AS kind, max(node) AS nodes FROM t GROUP BY 1), (SELECT unnest([0, 1, 1, 2]) AS kind_of, unnest(['NODE_IDENTITY', 'BLOCK_COVERAGE', 'NODE_IDENTITY', 'NODE_SHAPE']) AS code) WHERE kind = kind_of
 UNION ALL SELECT 'structure', document_id, 'NODE_IDENTITY' FROM (SELECT DISTINCT document_id FROM t WHERE CAST(document_id AS BIGINT) % 5 = 2)""")
def node_violations(spark, d):
    outlined = _outlined(spark, d)
    kind, first = F.col("document_id").cast("long") % 5, F.col("node") == 1
    tree = structure.nodes(outlined)
    broken = tree.withColumns({
        "node_id": F.when((kind == 0) & first, "sn-0").otherwise(F.col("node_id")),
        "block_ids": F.when((kind == 1) & first, F.array().cast("array<string>")).otherwise(F.col("block_ids")),
        "level": F.when((kind == 2) & first, F.lit(3)).otherwise(F.col("level")),
    })
    return structure.node_violations(broken, outlined, structure.blocks_of(structure.normalize(_pages(spark, d))))


@query(f"""WITH RECURSIVE {_CHUNKED} SELECT DISTINCT 'chunk' AS stage, document_id, code FROM m, (SELECT unnest([0, 1, 2, 2, 3, 3, 3]) AS kind, unnest(['CHUNK_TEXT', 'CHUNK_IDENTITY', 'ORDINALS', 'CHUNK_IDENTITY', 'CHUNK_TEXT', 'CHUNK_IDENTITY', 'BLOCK_COVERAGE']) AS code) WHERE CAST(document_id AS BIGINT) % 6 = kind""")
def chunk_violations(spark, d):
    outlined = _outlined(spark, d)
    tree = structure.nodes(outlined)
    made = structure.chunks(outlined, tree, limit=1200)
    kind, first = F.col("document_id").cast("long") % 6, F.col("ordinal") == 1
    broken = made.withColumns({
        "text": F.when((kind == 0) & first, F.concat("text", F.lit("!"))).otherwise(F.col("text")), "chunk_id": F.when((kind == 1) & first, "ch-0").otherwise(F.col("chunk_id")),
        "block_ids": F.when((kind == 3) & first, F.concat("block_ids", F.slice("block_ids", 1, 1))).otherwise(F.col("block_ids")),
    }).withColumn("ordinal", F.when((kind == 2) & first, F.lit(0)).otherwise(F.col("ordinal")))
    return structure.chunk_violations(broken, tree, outlined)


@query("SELECT concat('', conv_id) AS document_id, bool_or(conv_id % 9 = 4 AND turn = 1 AND conv_id % 2 = 0) AS requires_ocr, CASE WHEN bool_or(conv_id % 9 = 4 AND turn = 1 AND conv_id % 2 = 0) THEN 'ocr' ELSE 'native' END AS reader FROM conversations GROUP BY conv_id")
def ocr_routing(spark, d):
    from quillstone.sources import documents

    pages = table(spark, d, "conversations").selectExpr("concat('', conv_id) AS document_id", "'native' AS source_type", "conv_id % 9 = 4 AND turn = 1 AND conv_id % 2 = 0 AS visual")
    return documents.requires_ocr(pages).select("document_id", "requires_ocr", F.when(F.col("requires_ocr"), "ocr").otherwise("native").alias("reader"))


