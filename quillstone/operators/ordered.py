"""Ordered operators: packing, thresholds, quotas and prefixes, each over an explicit order."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _greedy(limit: int, separator: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, offsets = batch.column(batch.num_columns - 1), []
            out = []
            for row in lengths.to_pylist():
                chunk, used = 0, None
                for n in row:
                    if used is None:
                        used = n
                    elif used + separator + n > limit:
                        chunk, used = chunk + 1, n
                    else:
                        used += separator + n
                    out.append(chunk)
                offsets.append(len(out))
            chunks = pa.ListArray.from_arrays(pa.array([0, *offsets], pa.int32()), pa.array(out, pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], chunks], [*batch.schema.names[:-1], "chunks"])

    return run


def pack(blocks: DataFrame, key: str | list[str], order: list[str], length: str, limit: int, separator: int = 2) -> DataFrame:
    """Greedy packing: blocks stay whole and in order; one that would pass the limit starts a new group. Adds `chunk`, from 0.

    One shuffle by key; a key's blocks form one row while they are folded, with their lengths alone, in time linear in them.
    """
    keys = [key] if isinstance(key, str) else key
    rows = blocks.select(*keys, F.struct(*order).alias("place"), F.col(length).cast("long").alias("n"))
    grouped = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("place", "n"))).alias("x")).select(*keys, F.col("x.place").alias("places"), F.col("x.n").alias("ns"))
    kinds = dict(grouped.dtypes)
    folded = grouped.mapInArrow(_greedy(limit, separator), ", ".join(f"{c} {kinds[c]}" for c in [*keys, "places"]) + ", chunks array<long>")
    out = folded.select(*keys, F.explode(F.arrays_zip("places", "chunks")).alias("z"))
    return out.select(*keys, "z.places.*", F.col("z.chunks").alias("chunk"))


def number(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Numbers rows from 1 within keys."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def repeated_lines(lines: DataFrame, document: str, page: str, line_key: str) -> DataFrame:
    """Keys of lines on a majority of a document's pages: at least max(2, pages div 2 + 1)."""
    pages = lines.groupBy(document).agg(F.countDistinct(page).alias("pages"))
    counts = lines.groupBy(document, line_key).agg(F.countDistinct(page).alias("on_pages"))
    return counts.join(pages, document).where("on_pages >= greatest(2, pages div 2 + 1)")


def balanced(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """First, lower-middle and last row of each key."""
    w = Window.partitionBy(key)
    ranked = rows.withColumn("rn", F.row_number().over(w.orderBy(*order))).withColumn("n_rows", F.count("*").over(w))
    return ranked.where("rn in (1, (n_rows + 1) div 2, n_rows)").drop("n_rows")


def evenly_spaced(rows: DataFrame, key: str, order: list[str], requested: int) -> DataFrame:
    """Rows at places slot * (n - 1) div (count - 1) for count = least(n, requested)."""
    w = Window.partitionBy(key)
    ranked = rows.withColumn("i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("n_rows", F.count("*").over(w)).withColumn("count", F.least("n_rows", F.lit(requested)))
    # i is one of these places if the first slot that reaches it lands on it.
    slot = F.expr("case when count <= 1 then 0 else ((i * (count - 1) + n_rows - 2) div greatest(n_rows - 1, 1)) end")
    place = F.expr("case when count <= 1 then 0 else (slot * (n_rows - 1)) div (count - 1) end")
    return ranked.withColumn("slot", slot).where(place == F.col("i")).drop("n_rows", "count", "slot")


def prefix_within(rows: DataFrame, key: str, order: list[str], size, limit: int, separator: int = 2) -> DataFrame:
    """The longest prefix of each key whose sizes, with separators between, stay within the limit."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(size + separator).over(w) - separator
    # Sizes aren't negative, so the running total never falls and a filter is a prefix.
    return rows.withColumn("used", total).where(F.col("used") <= limit)


def quotas(batches: DataFrame, key: str, batch: str, size: str, total: int) -> DataFrame:
    """Highest averages: one for each batch, then always to the largest size / (quota + 1), the earlier batch on a tie, up to its size."""
    w = Window.partitionBy(key)
    base = batches.where(F.col(size) > 0).withColumn("left", F.lit(total) - F.count("*").over(w))
    more = base.where(f"{size} > 1").select(key, batch, size, "left", F.explode(F.sequence(F.lit(2), F.least(F.col(size), F.lit(total)).cast("int"))).alias("d"))
    won = more.withColumn("r", F.row_number().over(w.orderBy(F.desc(F.col(size) / F.col("d")), batch))).where("r <= left").groupBy(key, batch).agg(F.count("*").alias("extra"))
    return base.join(won, [key, batch], "left").select(key, batch, size, (F.coalesce("extra", F.lit(0)) + 1).cast("long").alias("quota"))
