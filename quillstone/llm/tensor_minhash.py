"""MinHash near-duplicates with tensored banding.

A document computes GROUPS small groups of WIDTH minhashes. Each pair of groups is a table, keyed by both groups' values, so
the square root of the usual number of minhashes gives all tables. Documents that meet in a table are candidates, and every
link is confirmed on the full shingle sets. At a similarity of 0.8 a pair fails to meet in any of the 276 tables about once
in 14,000; at 0.85, once in 2,000,000.

Candidates of a table aren't paired with each other: a centre is compared with the rest, and what links becomes one component.
Members that are still apart are compared where they share one of their rarest shingles early enough, as all that link do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import GOLDEN, Stages, docs_of, gram_hashes, hash_words, lean, mix, signed, utf8
from quillstone.llm.components import components

GROUPS = 24
WIDTH = 4
KEY = ("doc_id", "ka", "kb")


def shingles(text: bytes | None, size: int) -> np.ndarray:
    """The sorted distinct hashes of the shingles of a text, A-Z lowered; a shorter text is one shingle, without words none."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = hash_words(words)
    u = np.sort(gram_hashes(h, min(size, len(words))))
    return u[np.concatenate([[True], u[1:] != u[:-1]])]


class Signer:
    """The values of a set's groups. Shingle hashes are well mixed, so an odd multiple of half of their bits orders them as
    a random permutation would; 32-bit values go through numpy's vector instructions."""

    def __init__(self, groups: int, width: int, seed: int = 1):
        n = groups * width
        self.groups, self.width = groups, width
        keys = mix(np.arange(1, n + 1, dtype=np.uint64) * GOLDEN + np.uint64(seed))
        self.flip = (keys >> np.uint64(32)).astype(np.uint32)[:, None]
        self.times = (mix(keys + np.uint64(7)) >> np.uint64(32)).astype(np.uint32)[:, None] | np.uint32(1)
        self.tag = mix(np.arange(1, groups + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        self.room = np.empty((n, 1024), dtype=np.uint32)

    def __call__(self, u: np.ndarray) -> np.ndarray:
        least = np.full(len(self.flip), np.iinfo(np.uint32).max, dtype=np.uint32)
        half = u.astype(np.uint32)  # the low 32 bits
        for lo in range(0, len(half), 1024):
            part = half[None, lo : lo + 1024]
            x = self.room[:, : part.shape[1]]
            np.bitwise_xor(part, self.flip, out=x)
            np.multiply(x, self.times, out=x)
            np.minimum(least, x.min(axis=1), out=least)
        least = least.astype(np.uint64).reshape(self.groups, self.width)
        out = self.tag.copy()
        for j in range(self.width):
            out = mix(out * GOLDEN + least[:, j])
        return out


def _signatures(docs: DataFrame, size: int, groups: int, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = Signer(groups, width)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                n, high, low, rows = [], [], [], []
                for text in utf8(part.column("text")):
                    u = shingles(text, size)
                    n.append(len(u))
                    whole = xxhash.xxh3_128_intdigest(u.tobytes())
                    high.append((whole >> 64) - (1 << 63))
                    low.append((whole & ((1 << 64) - 1)) - (1 << 63))
                    rows.append(sign(u) if len(u) else np.empty(0, dtype=np.uint64))
                offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in KEY], pa.array(n, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), signed(np.concatenate(rows)))],
                    [*KEY, "n_shingles", "set_a", "set_b", "groups"],
                )

    return docs.mapInArrow(lean(run), "doc_id long, ka long, kb long, n_shingles long, set_a long, set_b long, groups array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """The full set of each representative (rep, ka, kb), read from the text again. Rows of one key are equal throughout."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                rows = [shingles(t, size) for t in utf8(part.column(1))]
                offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), signed(np.concatenate(rows)))], ["rep", "set"])

    # A merge join at every size: the texts are shuffled once however many representatives there are.
    texts = docs.select("ka", "kb", "text").join(wanted.hint("merge"), ["ka", "kb"]).dropDuplicates(["rep"])
    return texts.select("rep", "text").mapInArrow(lean(run), "rep long, set array<long>")


def _agree(percent: int):
    """Keeps the pairs whose sets share `percent` of their union; sets are sorted and distinct."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (x, xs), (y, ys) = ((c.flatten().to_numpy(), (c.offsets.to_numpy() - c.offsets[0].as_py()).tolist()) for c in (batch.column(2), batch.column(3)))
            keep = []
            for i in range(batch.num_rows):
                u, v = x[xs[i] : xs[i + 1]], y[ys[i] : ys[i + 1]]
                both = np.concatenate((u, v))
                both.sort()
                n = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * n >= percent * (len(both) - n))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _linked(pairs: DataFrame, docs: DataFrame, reps: DataFrame, size: int, percent: int, stages: Stages) -> DataFrame:
    """Those of pairs (a, b) whose full sets share percent of their union."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    sets = stages.put(_sets(docs, reps.select("rep", "ka", "kb").join(wanted, "rep"), size), "sets")
    stages.tidy()
    with_b = pairs.join(sets.select(F.col("rep").alias("b"), F.col("set").alias("set_b")), "b")
    both = with_b.join(sets.select(F.col("rep").alias("a"), F.col("set").alias("set_a")), "a")
    found = stages.put(both.select("a", "b", "set_a", "set_b").mapInArrow(lean(_agree(percent)), "a long, b long"), "links")
    stages.drop(sets)
    stages.tidy()
    return found


def _still_apart(rest: DataFrame, docs: DataFrame, reps: DataFrame, size: int, percent: int, stages: Stages) -> DataFrame:
    """Pairs (a, b) that may link, of documents (key, rep, size, component) that met in a table but are in different components.

    With shingles in one order, the rarest first, a pair that links shares one among the first of both, so early that what
    follows can still make up the overlap it needs. No pair that links is left out, and documents that are merely alike
    don't come up: what sets them apart is rare and stands first. One side holds only documents outside the largest
    component of a table they are in, so a large group isn't paired with itself.
    """
    sizes = rest.groupBy("key", "component").agg(F.count("*").alias("n"))
    largest = stages.put(sizes.groupBy("key").agg(F.max(F.struct("n", "component")).alias("x")).select("key", F.col("x.component").alias("largest")), "largest")
    members = rest.join(largest, "key").groupBy("rep", "component", "size").agg(F.max((F.col("component") != F.col("largest")).cast("int")).alias("outside"))
    members = stages.put(members, "members")
    sets = _sets(docs, reps.select("rep", "ka", "kb").join(members.select("rep").distinct(), "rep"), size)
    rows = stages.put(sets.select("rep", F.explode("set").alias("x")), "shingles")
    stages.tidy()
    often = stages.put(rows.groupBy("x").agg(F.count("*").alias("n")).where("n > 1"), "often")
    # A shingle that one document alone holds can't be shared; it takes a place before the others all the same.
    held = rows.join(often, "x").join(members, "rep")
    alone = rows.groupBy("rep").agg(F.count("*").alias("all")).join(held.groupBy("rep").agg(F.count("*").alias("shared")), "rep").select("rep", (F.col("all") - F.col("shared")).alias("alone"))
    order = Window.partitionBy("rep").orderBy("n", "x")
    placed = held.withColumn("r", F.row_number().over(order)).join(alone, "rep").withColumn("place", F.col("r") + F.col("alone") - 1)
    first = stages.put(placed.where(f"place < size - ({percent} * size + 99) div 100 + 1").select("x", "rep", "component", "size", "place", "outside"), "prefixes")
    other = first.toDF("x", "b", "component_b", "size_b", "place_b", "outside_b")
    one = first.where("outside = 1").toDF("x", "a", "component_a", "size_a", "place_a", "outside_a")
    met = one.join(other, "x").where("component_a <> component_b and (outside_b = 0 or a < b)")
    met = met.where(f"100 * least(size_a, size_b) >= {percent} * greatest(size_a, size_b)")
    met = met.where(f"{100 + percent} * (1 + least(size_a - place_a, size_b - place_b) - 1) >= {percent} * (size_a + size_b)")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _shared_keys(rows: DataFrame, key: str, stages: Stages) -> DataFrame:
    """The rows whose key stands in others too. The keys are written first: then Spark can split a key that many rows share."""
    often = stages.put(rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key), "often")
    return rows.join(often, key, "left_semi")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, groups: int = GROUPS, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (doc_id = component_id) for every row.

    size: words in a shingle; percent: the least similarity of linked documents. component_id is the least doc_id among the
    documents that can be reached, null where all of these are null. Texts without words (null, empty) have no shingles,
    link with nothing and keep their own doc_id; equal sets link as one. Rows are judged by their texts: rows that share a
    doc_id, or have none, are linked like any others, and each gives its row. An empty table gives no rows; other columns
    are ignored.
    """
    spark = docs.sparkSession
    docs = docs_of(docs).withColumns({"ka": F.xxhash64("doc_id", "text"), "kb": F.xxhash64(F.lit(1), "doc_id", "text")})
    stages = Stages(spark, "near")
    signed_docs = stages.put(_signatures(docs.select(*KEY, "text"), size, groups, width), "signatures")
    reps = signed_docs.where("n_shingles > 0").groupBy("set_a", "set_b").agg(F.min(F.struct("ka", "kb")).alias("k"), F.min("doc_id").alias("least"), F.first("groups").alias("groups"), F.first("n_shingles").alias("size"))
    reps = stages.put(reps.select("set_a", "set_b", "k.ka", "k.kb", "least", "groups", "size").withColumn("rep", F.monotonically_increasing_id()), "representatives")

    alive = _shared_keys(reps.select("rep", F.explode("groups").alias("g")), "g", stages)
    mine = alive.groupBy("rep").agg(F.sort_array(F.collect_set("g")).alias("g")).where("size(g) > 1")
    mine = stages.put(mine, "groups")
    stages.tidy()
    # Two groups make a table's key; a group's values carry its number, so equal keys mean equal tables.
    pairs = F.flatten(F.transform("g", lambda x, i: F.transform(F.slice("g", i + 2, F.size("g")), lambda y: F.xxhash64(x, y))))
    tables, left = stages.count(_shared_keys(mine.select("rep", F.explode(pairs).alias("key")), "key", stages), "tables")
    stages.drop(mine)
    stages.tidy()
    links = label = None
    if left:
        held = stages.put(tables.groupBy("key").agg(F.count("*").alias("n")), "held")
        weight = stages.put(tables.join(held, "key").groupBy("rep").agg(F.sum("n").alias("weight")), "weight")
        stages.drop(held)
        centres = tables.join(weight, "rep").groupBy("key").agg(F.max(F.struct("weight", F.negative("rep").alias("rep"))).alias("x")).select("key", F.negative("x.rep").alias("a"))
        centres = stages.put(centres, "centres")
        stages.drop(weight)
        met = tables.join(centres, "key").where("rep <> a")
        tested = stages.put(met.select(F.least("a", "rep").alias("a"), F.greatest("a", "rep").alias("b")).distinct(), "pairs")
        stages.tidy()
        links = _linked(tested, docs, reps, size, percent, stages)
        label = components(links, stages)
        stages.tidy()
        rest = tables.join(centres.withColumnRenamed("a", "rep"), ["key", "rep"], "left_anti")
        rest = rest.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
        rest = stages.put(rest, "rest")
        stages.drop(centres)
        stages.drop(tables)
        stages.tidy()
        apart = stages.put(rest.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key"), "apart")
        before, (rest, left) = rest, stages.count(rest.join(apart, "key", "left_semi").join(reps.select("rep", "size"), "rep"), "active")
        stages.drop(before)
        stages.tidy()
    if left:
        more = _still_apart(rest, docs, reps, size, percent, stages).join(tested, ["a", "b"], "left_anti")
        more = stages.put(more, "pairs")
        stages.tidy()
        links = stages.put(links.union(_linked(more, docs, reps, size, percent, stages)), "links")
        label = components(links, stages)
    classes = reps.select("set_a", "set_b", "least", "rep")
    if label is not None:
        classes = stages.put(classes.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("set_a", "set_b", "least", F.coalesce("component", "rep").alias("class")), "classes")
        # The nodes' own numbers are in no order of doc_id.
        classes = classes.drop("least").join(classes.groupBy("class").agg(F.min("least").alias("least")), "class")
    stages.tidy()
    out = signed_docs.drop("groups").join(classes.select("set_a", "set_b", "least"), ["set_a", "set_b"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
