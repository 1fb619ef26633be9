"""Pages to blocks, blocks to a tree of headings, and the tree to chunks: flat tables with explicit ordinals.

blocks: document_id, page_number, block_index, block_id, text. Each block belongs to one node, and the nodes of a document
are numbered in the order in which they open, which is the tree's pre-order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators import ordered

NORMALIZATION = STRUCTURE = CHUNKING = "1.0.0"
TARGET = 12_000
LEVELS = 6


def normalize(pages: DataFrame, version: str = NORMALIZATION) -> DataFrame:
    """pages: document_id, page_number, text, visual (needs visual processing), warnings. Adds cleaned, text as it may be kept,
    block_id (null for a blank page) and the warning that cleanup was needed."""
    clean = pages.withColumn("cleaned", T.cleanup(F.col("text")))
    blank = T.trimmed(F.col("cleaned")) == ""
    applied = F.when(F.col("cleaned") != F.col("text"), F.array(F.lit("REPRESENTATION_CLEANUP_APPLIED"))).otherwise(F.array().cast("array<string>"))
    return clean.select(
        "document_id", "page_number", F.col("cleaned").alias("text"), "visual", F.concat("warnings", applied).alias("warnings"),
        F.when(~blank, T.block_id(F.col("document_id"), version, F.col("page_number"), F.lit(0))).alias("block_id"),
    )


def blocks_of(normalized: DataFrame) -> DataFrame:
    """The one block of each page that isn't blank."""
    return normalized.where("block_id is not null").select("document_id", "page_number", F.lit(0).alias("block_index"), "block_id", "text")


def _outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The node of each heading or block, with what opens there. A heading opens a node if its number is new and its parent's
    number is that of the last open heading or a prefix of it: the open headings are just these prefixes."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            out = []
            for numbers in part.column("numbers").to_pylist():
                seen, last, at, children, rows, loose, opened = set(), (), {}, {0: 0}, [], None, 0
                for number in numbers:
                    number = tuple(number or ())
                    opens = bool(number) and number not in seen and last[: len(number) - 1] == number[:-1]
                    if opens or not last and loose is None:
                        opened += 1
                        parent = at[number[:-1]] if len(number) > 1 and opens else (0, (0,))
                        path = (*parent[1], children[parent[0]])
                        children[parent[0]] += 1
                        children[opened] = 0
                        node, kind = (opened, path), "unstructured"
                        if opens:
                            seen.add(number)
                            last, kind, loose = number, "section" if len(number) == 1 else "subsection", None
                            at[number] = node
                        else:
                            loose = node
                        rows.append({"node": opened, "opens": True, "kind": kind, "level": max(1, len(number) if opens else 1), "parent": parent[0], "path": list(path)})
                    else:
                        node = at[last] if last else loose
                        rows.append({"node": node[0], "opens": False, "kind": None, "level": None, "parent": None, "path": list(node[1])})
                out.append(rows)
            kind = pa.list_(pa.struct([("node", pa.int32()), ("opens", pa.bool_()), ("kind", pa.string()), ("level", pa.int32()), ("parent", pa.int32()), ("path", pa.list_(pa.int32()))]))
            yield pa.RecordBatch.from_arrays([part.column("document_id"), part.column("places"), pa.array(out, kind)], ["document_id", "places", "rows"])


def outline(blocks: DataFrame) -> DataFrame:
    """Adds to each block its node, path and, where it opens the node, kind, level, parent and title.

    Headings are found by built-in expressions; only their numbers meet, once for each document, never the texts.
    """
    signals = blocks.select("document_id", F.struct("page_number", "block_index").alias("place"), T.heading_signal(F.col("text")).alias("number"))
    grouped = signals.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("place", "number"))).alias("x"))
    folded = grouped.select("document_id", F.col("x.place").alias("places"), F.col("x.number").alias("numbers")).mapInArrow(
        _outline, "document_id string, places array<struct<page_number:long,block_index:int>>, rows array<struct<node:int,opens:boolean,kind:string,level:int,parent:int,path:array<int>>>"
    )
    placed = folded.select("document_id", F.explode(F.arrays_zip("places", "rows")).alias("z")).select("document_id", "z.places.*", "z.rows.*")
    title = F.nullif(T.heading_title(F.col("text")), F.lit(""))
    return blocks.join(placed, ["document_id", "page_number", "block_index"]).withColumn("title", F.when(F.col("opens") & (F.col("kind") != "unstructured"), title))


def nodes(outlined: DataFrame, version: str = STRUCTURE) -> DataFrame:
    """A row for each node, the document's root (0) included, with its id, blocks in order and place in the tree."""
    first = F.struct("page_number", "block_index")
    found = outlined.groupBy("document_id", "node").agg(
        F.sort_array(F.collect_list(F.struct("page_number", "block_index", "block_id"))).alias("x"), F.min_by("kind", first).alias("kind"), F.min_by("level", first).alias("level"),
        F.min_by("parent", first).alias("parent"), F.min_by("path", first).alias("path"), F.min_by("title", first).alias("title"),
    )
    found = found.select("document_id", "node", "kind", "level", "parent", "path", "title", F.col("x.block_id").alias("block_ids"))
    root = outlined.select("document_id").distinct().select("document_id", F.lit(0).alias("node"), F.lit("document").alias("kind"), F.lit(0).alias("level"), F.lit(None).cast("int").alias("parent"), F.array(F.lit(0)).alias("path"), F.lit(None).cast("string").alias("title"), F.array().cast("array<string>").alias("block_ids"))
    return found.unionByName(root).withColumn("node_id", T.node_id(F.col("document_id"), version, F.col("kind"), F.col("level"), F.col("path"), F.col("title"), F.col("block_ids")))


def chunks(outlined: DataFrame, tree: DataFrame, limit: int = TARGET, version: str = CHUNKING) -> DataFrame:
    """Blocks packed in order within each top-level node, whole, with two characters between; numbered from 1 in a document."""
    top = F.get("path", F.lit(1))
    sized = outlined.select("document_id", top.alias("top"), "page_number", "block_index", F.length("text").alias("len"))
    packed = ordered.pack(sized, ["document_id", "top"], ["page_number", "block_index"], "len", limit).drop("len")
    joined = outlined.select("document_id", "page_number", "block_index", "block_id", "text").join(packed, ["document_id", "page_number", "block_index"])
    grouped = joined.groupBy("document_id", "top", "chunk").agg(F.sort_array(F.collect_list(F.struct("page_number", "block_index", "block_id", "text"))).alias("x"))
    made = ordered.number(grouped, ["document_id"], ["top", "chunk"], "ordinal").select(
        "document_id", "top", "ordinal", F.col("x.block_id").alias("block_ids"), F.array_join("x.text", "\n\n").alias("text"),
        F.get("x", F.lit(0))["page_number"].alias("page_start"), F.element_at("x", -1)["page_number"].alias("page_end"),
    )
    tops = tree.where("size(path) = 2").select("document_id", F.get("path", F.lit(1)).alias("top"), F.col("node_id").alias("structure_node_id"))
    made = made.join(tops, ["document_id", "top"])
    return made.select(
        "document_id", "ordinal", "structure_node_id", "block_ids", "text", "page_start", "page_end", (F.length("text") > limit).alias("exceeds_target"),
        T.chunk_id(F.col("document_id"), version, F.col("ordinal"), F.col("structure_node_id"), F.col("block_ids"), F.col("text")).alias("chunk_id"),
    )


def _violation(rows: DataFrame, stage: str, code: str) -> DataFrame:
    return rows.select(F.lit(stage).alias("stage"), "document_id", F.lit(code).alias("code")).distinct()


def _out_of_order(pages: DataFrame) -> DataFrame:
    """Documents whose pages aren't 1, 2, ... n. Counts and bounds alone: no sort."""
    g = pages.groupBy("document_id").agg(F.count("*").alias("n"), F.countDistinct("page_number").alias("d"), F.min("page_number").alias("lo"), F.max("page_number").alias("hi"))
    return g.where("lo <> 1 or hi <> n or d <> n")


def parsed_violations(pages: DataFrame) -> DataFrame:
    """(stage, document_id, code) for each rule that parsed pages break."""
    stage = "parse"
    unmarked = ~F.col("visual") | ~F.array_contains("warnings", "NO_NATIVE_TEXT")
    return (
        _violation(pages.where(T.trimmed(F.col("document_id")) == ""), stage, "MISSING_IDENTITY")
        .union(_violation(_out_of_order(pages), stage, "PAGES_OUT_OF_ORDER"))
        .union(_violation(pages.where((T.trimmed(F.col("text")) == "") & unmarked), stage, "BLANK_PAGE_UNMARKED"))
    )


def normalized_violations(normalized: DataFrame, parsed: DataFrame, version: str = NORMALIZATION) -> DataFrame:
    """What in a stored normalisation differs from the permitted cleanup of its pages: recomputed, then compared."""
    stage = "normalize"
    want = normalize(parsed, version).select("document_id", "page_number", F.struct("text", "visual", "warnings", "block_id").alias("want"))
    both = normalized.select("document_id", "page_number", F.struct("text", "visual", "warnings", "block_id").alias("got")).join(want, ["document_id", "page_number"], "full")
    part = lambda c: ~F.col(f"got.{c}").eqNullSafe(F.col(f"want.{c}"))
    met = both.where("got is not null and want is not null")
    return (
        _violation(both.where("got is null or want is null"), stage, "PAGE_COUNT_CHANGED")
        .union(_violation(met.where(part("text")), stage, "TEXT_CHANGED"))
        .union(_violation(met.where(part("visual")), stage, "VISUAL_ROUTING_CHANGED"))
        .union(_violation(met.where(part("warnings")), stage, "WARNINGS_CHANGED"))
        .union(_violation(met.where(part("block_id")), stage, "BLOCK_IDENTITY"))
    )


def block_violations(blocks: DataFrame, normalized: DataFrame) -> DataFrame:
    """What keeps normalised blocks from being structured."""
    stage = "structure_input"
    twice = blocks.groupBy("document_id", "block_id").agg(F.count("*").alias("n")).where("n > 1")
    bad = blocks.where((T.trimmed(F.coalesce("block_id", F.lit(""))) == "") | (T.trimmed(F.col("text")) == ""))
    empty = normalized.where("block_id is null").where(~F.col("visual") | ~F.array_contains("warnings", "NO_NATIVE_TEXT"))
    return _violation(_out_of_order(normalized), stage, "PAGES_OUT_OF_ORDER").union(_violation(twice, stage, "BLOCK_IDENTITY")).union(_violation(bad, stage, "BLANK_BLOCK")).union(_violation(empty, stage, "BLANK_PAGE_UNMARKED"))


def node_violations(tree: DataFrame, outlined: DataFrame, blocks: DataFrame, version: str = STRUCTURE) -> DataFrame:
    """Shape, identity, headings and coverage of a tree, held against its blocks."""
    stage = "structure"
    parent = tree.select("document_id", F.col("node").alias("parent"), F.col("level").alias("above"), F.col("path").alias("above_path"))
    child = tree.where("node > 0").join(parent, ["document_id", "parent"], "left")
    level = F.when(F.col("kind") == "subsection", F.col("level") == F.col("above") + 1).otherwise((F.col("level") == 1) & (F.col("parent") == 0))
    misplaced = child.where(~F.coalesce(level & (F.slice("path", 1, F.size("path") - 1) == F.col("above_path")), F.lit(False)))
    identity = tree.where(F.col("node_id") != T.node_id(F.col("document_id"), version, F.col("kind"), F.col("level"), F.col("path"), F.col("title"), F.col("block_ids")))
    again = tree.groupBy("document_id", "node_id").agg(F.count("*").alias("n")).where("n > 1")
    heads = outlined.where("opens and kind <> 'unstructured'")
    number, title = T.heading_signal(F.col("text")), F.nullif(T.heading_title(F.col("text")), F.lit(""))
    wrong = heads.where(~F.coalesce((F.size(number) == F.col("level")) & title.eqNullSafe(F.col("title")), F.lit(False)))
    numbered = heads.select("document_id", F.array_join(number, ".").alias("number")).groupBy("document_id", "number").agg(F.count("*").alias("n")).where("n > 1")
    return (
        _violation(misplaced, stage, "NODE_SHAPE").union(_violation(identity, stage, "NODE_IDENTITY")).union(_violation(again, stage, "NODE_IDENTITY"))
        .union(_violation(wrong, stage, "HEADING_SOURCE")).union(_violation(numbered, stage, "HEADING_NUMBER_TWICE")).union(_violation(coverage(_listed(tree, "path"), blocks), stage, "BLOCK_COVERAGE")).distinct()
    )


def _listed(holders: DataFrame, order: str) -> DataFrame:
    """The blocks that nodes or chunks list, one after the other."""
    return holders.select("document_id", order, F.posexplode("block_ids").alias("i", "block_id")).select("document_id", F.struct(order, "i").alias("at"), "block_id")


def coverage(listed: DataFrame, blocks: DataFrame) -> DataFrame:
    """Documents whose listed blocks aren't just their blocks, each once and in order. listed: document_id, at (its place), block_id."""
    got = ordered.number(listed, ["document_id"], ["at"], "rank").select("document_id", "rank", "block_id")
    want = ordered.number(blocks, ["document_id"], ["page_number", "block_index"], "rank").select("document_id", "rank", F.col("block_id").alias("want"))
    return got.join(want, ["document_id", "rank"], "full").where(~F.col("block_id").eqNullSafe(F.col("want"))).select("document_id").distinct()


def chunk_violations(made: DataFrame, tree: DataFrame, outlined: DataFrame, version: str = CHUNKING) -> DataFrame:
    """Identity, text, bounds and coverage of chunks: each block once, in source order, none across a top-level node."""
    stage = "chunk"
    blocks = outlined.select("document_id", "page_number", "block_index", "block_id", "text", F.get("path", F.lit(1)).alias("top"))
    held = made.select("document_id", "ordinal", "structure_node_id", F.posexplode("block_ids").alias("i", "block_id")).join(blocks.drop("page_number", "block_index"), ["document_id", "block_id"], "left")
    tops = tree.where("size(path) = 2").select("document_id", F.get("path", F.lit(1)).alias("top"), "node_id")
    strayed = held.join(tops, ["document_id", "top"], "left").where(~F.col("node_id").eqNullSafe(F.col("structure_node_id")))
    told = held.groupBy("document_id", "ordinal").agg(F.sort_array(F.collect_list(F.struct("i", "text"))).alias("x")).select("document_id", "ordinal", F.array_join("x.text", "\n\n").alias("told"))
    both = made.join(told, ["document_id", "ordinal"], "left")
    identity = F.col("chunk_id") == T.chunk_id(F.col("document_id"), version, F.col("ordinal"), F.col("structure_node_id"), F.col("block_ids"), F.col("told"))
    gaps = made.groupBy("document_id").agg(F.count("*").alias("n"), F.countDistinct("ordinal").alias("d"), F.min("ordinal").alias("lo"), F.max("ordinal").alias("hi")).where("lo <> 1 or hi <> n or d <> n")
    return (
        _violation(strayed, stage, "CROSSES_STRUCTURE").union(_violation(both.where(~F.col("text").eqNullSafe(F.col("told"))), stage, "CHUNK_TEXT"))
        .union(_violation(both.where(~F.coalesce(identity, F.lit(False))), stage, "CHUNK_IDENTITY")).union(_violation(gaps, stage, "ORDINALS")).union(_violation(coverage(_listed(made, "ordinal"), blocks), stage, "BLOCK_COVERAGE"))
    )


def heading_hints(tree: DataFrame, limit: int = 16, length: int = 120) -> DataFrame:
    """The first `limit` distinct titles of each document in pre-order, of at most `length` characters."""
    first = tree.where(F.col("title").isNotNull()).withColumn("hint", F.left("title", F.lit(length))).groupBy("document_id", "hint").agg(F.min("node").alias("node"))
    return ordered.number(first, ["document_id"], ["node"], "place").where(F.col("place") <= limit)
