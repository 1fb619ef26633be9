"""Substring dedup by recompression.

Words become symbols; each round names runs of one symbol, then pairs, and replaces them, so that equal stretches of text
come to hold equal symbols inside. A name is a hash of what it stands for and of the round, hence the same in every
document without a table of names. Each symbol also carries the stretch of words that its coming into being depended on:
where that stretch stands again, so does the symbol.

Every window of `window` words picks one symbol whose stretch lies inside it: of the highest round, then the least hash, then
the leftmost. With some words beside it, the pick names the window. Equal windows pick equal symbols at equal places, so only windows that pick a shared symbol can be equal.
Consecutive windows with one pick form a span. Spans with the same pick and the same words prove all their windows
repeated at once; where picks are shared by spans of different words, the windows of these are compared one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import GOLDEN, TOP, Stages, docs_of, hash_words, lean, mix, signed, utf8

ROUNDS = 3
#: Words that a symbol may stand for; longer ones would seldom lie inside a window with all that they depend on.
LONGEST = 12
#: Words beside a pick that its name takes in: before it where the window has so many there, else behind it, where it has them then.
BESIDE = 8
#: Words that are parsed together, so that short documents share the cost of numpy calls. A longer document is parsed alone.
TOGETHER = 200_000
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
FAR = np.int64(1 << 40)


class Prefix:
    """Hashes of stretches of a sequence in constant time each: the same for equal stretches, wherever they stand."""

    def __init__(self, h: np.ndarray):
        n = len(h)
        powers = np.full(n + 1, BASE, dtype=np.uint64)
        powers[0] = 1
        inverses = np.full(n + 1, INVERSE, dtype=np.uint64)
        inverses[0] = 1
        np.multiply.accumulate(powers, out=powers)
        np.multiply.accumulate(inverses, out=inverses)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(mix(h) * powers[:n], out=self.sums[1:])
        self.inverses = inverses

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverses[start] + (end - start).astype(np.uint64) * GOLDEN)


def _round(name, size, lo, hi, doc, r):
    """One round: runs, then pairs. Symbols have a name, a size in words, the stretch lo to hi that they depend on, and a document."""
    # Runs.
    n = len(name)
    new = np.ones(n, dtype=bool)
    new[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, n))
    last = first + count - 1
    total = np.add.reduceat(size, first)
    before = np.where((first > 0) & (doc[first - 1] == doc[first]), lo[first - 1], -FAR)
    after_at = np.minimum(last + 1, n - 1)
    after = np.where((last + 1 < n) & (doc[after_at] == doc[last]), hi[after_at], FAR)
    run_lo, run_hi = np.minimum(lo[first], before), np.maximum(hi[last], after)
    joined = (count > 1) & (total <= LONGEST)
    run = np.cumsum(new) - 1
    keep = new | ~joined[run]
    tag = np.uint64(2 * r + 1)
    named = np.where(joined, mix((name[first] + tag) * GOLDEN + count.astype(np.uint64)), name[first])
    run = run[keep]
    size = np.where(joined[run], total[run], size[keep])
    name, lo, hi, doc = named[run], run_lo[run], run_hi[run], doc[keep]
    # Pairs: a symbol with coin 0 and one with coin 1 behind it.
    n = len(name)
    coin = (mix(name ^ np.uint64((r + 1) * int(GOLDEN) % 2**64)) & np.uint64(1)).astype(bool)
    same = doc[1:] == doc[:-1]
    pair = np.zeros(n, dtype=bool)
    pair[:-1] = same & ~coin[:-1] & coin[1:] & (size[:-1] + size[1:] <= LONGEST)
    second = np.zeros(n, dtype=bool)
    second[1:] = pair[:-1]
    left_lo = np.full(n, -FAR)
    left_lo[1:] = np.where(same, lo[:-1], -FAR)
    right_hi = np.full(n, FAR)
    right_hi[:-1] = np.where(same, hi[1:], FAR)
    # A pair depends on its two symbols alone; a symbol left over on the neighbour that might have taken it.
    next_hi = np.append(hi[1:], FAR)
    next_lo = np.append(lo[1:], FAR)
    next_name = np.append(name[1:], name[:1])
    next_size = np.append(size[1:], 0)
    out_lo = np.where(pair, np.minimum(lo, next_lo), np.where(coin, np.minimum(lo, left_lo), lo))
    out_hi = np.where(pair, np.maximum(hi, next_hi), np.where(coin, hi, np.maximum(hi, right_hi)))
    out_name = np.where(pair, mix(mix((name + tag + np.uint64(1)) * GOLDEN) + next_name), name)
    keep = ~second
    return out_name[keep], (size + np.where(pair, next_size, 0))[keep], out_lo[keep], out_hi[keep], doc[keep]


def spans(h: np.ndarray, doc: np.ndarray, ends: np.ndarray, window: int):
    """(first start, last start, pick's name, hash of the words) of each span of windows, over documents that stand one after the other.

    doc: of each word; ends: where each document ends.
    """
    n = len(h)
    at = np.arange(n, dtype=np.int64)
    name, size, lo, hi, of = h, np.ones(n, dtype=np.int64), at, at + 1, doc
    beside = max(0, min(BESIDE, (window - LONGEST) // 2))
    names, los, his, ranks, places, sizes = [], [], [], [], [], []
    for r in range(ROUNDS):
        name, size, lo, hi, of = _round(name, size, lo, hi, of, r)
        fits = hi - lo <= window
        names.append(name[fits])
        los.append(lo[fits])
        his.append(hi[fits])
        places.append((np.cumsum(size) - size)[fits])
        sizes.append(size[fits])
        ranks.append(np.full(int(fits.sum()), ROUNDS - 1 - r, dtype=np.uint64))
    name, lo, hi, rank, place, size = map(np.concatenate, (names, los, his, ranks, places, sizes))
    # Least pick over all windows that hold a symbol's stretch: two overlapping powers of two for each symbol, then halves.
    pick = rank << np.uint64(61) | (mix(name) >> np.uint64(31)) << np.uint64(28) | np.arange(len(name), dtype=np.uint64)
    start, stop = np.maximum(hi - window, 0), np.minimum(lo, n - 1)
    length = stop - start + 1
    ok = length > 0
    pick, start, stop, length = pick[ok], start[ok], stop[ok], length[ok]
    level = np.int64(np.log2(length))
    tops = int(level.max()) if len(level) else 0
    layers = [np.full(n, TOP) for _ in range(tops + 1)]
    for j in range(tops + 1):
        here = level == j
        np.minimum.at(layers[j], start[here], pick[here])
        np.minimum.at(layers[j], stop[here] - (1 << j) + 1, pick[here])
    for j in range(tops, 0, -1):
        half = 1 << (j - 1)
        np.minimum(layers[j - 1], layers[j], out=layers[j - 1])
        np.minimum(layers[j - 1][half:], layers[j][:-half], out=layers[j - 1][half:])
    won = layers[0]
    starts = np.flatnonzero(at + window <= ends[doc])
    if not len(starts):
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),) * 2
    won = won[starts]
    symbol = np.where(won == TOP, 0, won & np.uint64((1 << 28) - 1)).astype(np.int64)
    before = (place[symbol] if len(name) else starts) - starts >= beside
    fresh = np.ones(len(starts), dtype=bool)
    fresh[1:] = (won[1:] != won[:-1]) | (starts[1:] != starts[:-1] + 1) | (won[1:] == TOP) | (before[1:] != before[:-1])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(starts)) - 1
    s0, s1, won, symbol, before = starts[first], starts[last], won[first], symbol[first], before[first]
    prefix = Prefix(h)
    words = prefix.of(s0, s1 + window)
    # A window without any symbol (it lies in a long run, say) is its own name.
    chosen = words
    if len(name):
        none = won == TOP
        edge = np.where(none, s0, np.where(before, place[symbol] - beside, place[symbol] + size[symbol]))
        near = prefix.of(edge, np.minimum(edge + beside, n))
        chosen = mix(mix(name[symbol] + (won >> np.uint64(61)) * np.uint64(2) + before) * GOLDEN + near)
    return s0, s1, np.where(won == TOP, words, chosen), words


def _parse(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(rows, texts):
            sizes = np.array([len(w) for w in texts], dtype=np.int64)
            ends = np.cumsum(sizes)
            begins = ends - sizes
            digests = [hashlib.sha256(b" ".join(w)).hexdigest() for w in texts]
            if ends[-1]:
                h = hash_words([x for w in texts for x in w])
                doc = np.repeat(np.arange(len(texts)), sizes)
                s0, s1, name, words = spans(h, doc, ends, window)
                of = doc[s0]
            else:
                s0 = s1 = of = np.empty(0, np.int64)
                name = words = np.empty(0, np.uint64)
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(texts)))]).astype(np.int32))
            part = lambda values: pa.ListArray.from_arrays(offsets, values)
            return pa.RecordBatch.from_arrays(
                [*[pa.array(c, pa.int64()) for c in zip(*rows)], pa.array(sizes), pa.array(digests, pa.string()), part(pa.array((s0 - begins[of]).astype(np.int32))), part(pa.array((s1 - s0).astype(np.int32))), part(signed(name)), part(signed(words))],
                ["doc_id", "ka", "kb", "n_words", "all_sha256", "s", "more", "name", "words"],
            )

        for batch in batches:
            rows, texts, total = [], [], 0
            for row, text in zip(zip(*[batch.column(c).to_pylist() for c in ("doc_id", "ka", "kb")]), utf8(batch.column("text"))):
                rows.append(row)
                texts.append((text or b"").split())
                total += len(texts[-1])
                if total >= TOGETHER:
                    yield emit(rows, texts)
                    rows, texts, total = [], [], 0
            if rows:
                yield emit(rows, texts)

    return run


def _windows(window: int):
    """The windows of the spans that a document is asked for, one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, text, wanted in zip(batch.column("k").to_pylist(), utf8(batch.column("text")), batch.column("wanted").to_pylist()):
                prefix = Prefix(hash_words(text.split()))
                name = np.repeat(np.array([x["name"] for x in wanted]), [x["more"] + 1 for x in wanted])
                single = np.repeat(np.array([x["single"] for x in wanted]), [x["more"] + 1 for x in wanted])
                s = np.concatenate([np.arange(x["s"], x["s"] + x["more"] + 1) for x in wanted])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), k)), pa.array(s.astype(np.int32)), pa.array(name), signed(prefix.of(s, s + window)), pa.array(single)], ["k", "s", "name", "w", "single"])

    return run


def _remove(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, digests, texts = [], [], []
            for text, covered in zip(utf8(batch.column("text")), batch.column("covered").to_pylist()):
                words = text.split()
                gone = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(gone, [x["s"] for x in covered], 1)
                np.add.at(gone, [x["e"] for x in covered], -1)
                kept = [w for w, g in zip(words, np.cumsum(gone[:-1]).tolist()) if not g]
                left = b" ".join(kept)
                removed.append(len(words) - len(kept))
                digests.append(hashlib.sha256(left).hexdigest())
                texts.append(left if with_text else None)
            yield pa.RecordBatch.from_arrays([batch.column("ka"), batch.column("kb"), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.binary()).cast(pa.string())], ["ka", "kb", "n_removed", "left_sha256", "left_text"])

    return run


def substring_dedup(docs: DataFrame, window: int = 35, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, with with_text, kept_text (kept words with one space between; null where none was removed).

    A word goes if a window of `window` words over it also starts anywhere else. Null and empty texts have no words.
    Rows that repeat, doc_id and all, are places of their own, so their windows are repeated; each gives its row. A null
    doc_id stays null; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    stages = Stages(spark, "substrings")
    # A text's own key, of 128 bits. What is covered depends on the text alone, so equal texts are looked up once.
    docs = docs_of(docs).withColumns({"ka": F.xxhash64("text"), "kb": F.xxhash64(F.lit(1), "text")})
    parsed = docs.select("doc_id", "ka", "kb", "text").mapInArrow(lean(_parse(window)), "doc_id long, ka long, kb long, n_words long, all_sha256 string, s array<int>, more array<int>, name array<long>, words array<long>")
    parsed = stages.put(parsed.withColumn("k", F.monotonically_increasing_id()), "parsed")
    rows = parsed.select("k", F.explode(F.arrays_zip("s", "more", "name", "words")).alias("x")).select("k", "x.s", "x.more", "x.name", "x.words")
    often = rows.groupBy("name").agg(F.count("*").alias("n"), F.min("words").alias("least"), F.max("words").alias("most")).where("n > 1")
    # Written first, so that the join below has a plain exchange on either side and Spark can split a name that many rows share.
    often = stages.put(often.select("name", (F.col("least") == F.col("most")).alias("alike")), "often")
    stages.tidy()
    shared = stages.put(rows.join(often, "name"), "shared")
    stages.drop(often)
    stages.tidy()

    # Every kind of span, by name and words; one that stands twice is proven, of the others the windows are compared.
    kinds = stages.put(shared.groupBy("name", "words").agg(F.count("*").alias("n"), F.min(F.struct("k", "s", "more")).alias("x"), F.first("alike").alias("alike")), "kinds")
    proven = shared.join(kinds.select("name", "words", (F.col("n") > 1).alias("twice")), ["name", "words"]).where("twice").select("k", "s", (F.col("s") + F.col("more") + F.lit(window)).alias("e"))
    wanted = kinds.where("not alike").select("x.k", F.struct("x.s", "x.more", "name", (F.col("n") == 1).alias("single")).alias("x")).groupBy("k").agg(F.collect_list("x").alias("wanted"))
    reps = stages.put(parsed.where(f"n_words >= {window}").groupBy("ka", "kb").agg(F.min("k").alias("k")), "texts")
    texts = docs.select("ka", "kb", "text")
    asked = reps.join(wanted, "k").hint("merge")
    single = texts.join(asked, ["ka", "kb"]).groupBy("ka", "kb").agg(F.first("k").alias("k"), F.first("text").alias("text"), F.first("wanted").alias("wanted"))
    looked = stages.put(single.select("k", "text", "wanted").mapInArrow(lean(_windows(window)), "k long, s int, name long, w long, single boolean"), "windows")
    stages.tidy()
    twice = stages.put(looked.groupBy("name", "w").agg(F.count("*").alias("n")).where("n > 1").select("name", "w"), "twice")
    proven = proven.union(looked.where("single").join(twice, ["name", "w"], "left_semi").select("k", "s", (F.col("s") + F.lit(window)).alias("e")))
    covered = reps.join(proven, "k").groupBy("ka", "kb").agg(F.collect_set(F.struct("s", "e")).alias("covered"))
    covered = stages.put(covered, "covered")
    stages.drop(shared)
    stages.drop(looked)
    stages.tidy()
    left = texts.join(covered.hint("merge"), ["ka", "kb"]).select("ka", "kb", "text", "covered").mapInArrow(lean(_remove(with_text)), "ka long, kb long, n_removed long, left_sha256 string, left_text string")
    left = stages.put(left.dropDuplicates(["ka", "kb"]), "left")
    stages.tidy()
    out = parsed.select("doc_id", "ka", "kb", "n_words", "all_sha256").join(left, ["ka", "kb"], "left")
    out = out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("left_sha256", "all_sha256").alias("kept_sha256"), F.col("left_text").alias("kept_text"))
    return out if with_text else out.drop("kept_text")
