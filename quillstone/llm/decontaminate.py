"""Benchmark decontamination by winnowing.

Of every sliding window of w k-grams the smallest hash is kept, on both sides; spans of k + w - 1 equal words share one for
certain. k and w follow from the length of the windows that the benchmark asks for, one index for each length, so no window is missed. Where a
fingerprint is shared, the hit is extended to whole windows and these are compared word by word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import Stages, gram_hashes, hash_words, keyed, lean, mix, signed, utf8

#: Benchmark windows up to which they go to every worker (about 60 MB there); beyond, both sides are shuffled and joined.
LOCAL_WINDOWS = 200_000
#: Fixed: digits, letters and all bytes from 0x80 on are word characters after A-Z are lowered; the rest separates words.
WORD_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORD_TABLE).split()


def winnow(h: np.ndarray, k: int, w: int) -> np.ndarray:
    """Positions of the k-grams kept: the smallest of each w in a row (the last of equals), or of all if there are fewer."""
    g = gram_hashes(h, k)
    if not len(g):
        return np.empty(0, dtype=np.int64)
    w = min(w, len(g))
    best = np.arange(len(g) - w + 1)
    for i in range(1, w):
        other = np.arange(i, len(g) - w + 1 + i)
        best = np.where(g[other] <= g[best], other, best)
    return np.unique(best)


def _windows(words: list[bytes], window: int) -> list[bytes]:
    n = min(window, len(words))
    return [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] if n else []


def _digest(items: set) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


OUT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _covered(spans: list[tuple[int, int]]) -> int:
    total, at = 0, 0
    for s, e in sorted(spans):
        total += max(0, e - max(s, at))
        at = max(at, e)
    return total


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, local_windows: int = LOCAL_WINDOWS, spans: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated and, with spans, hits (start and end words of each item's windows);
    the columns named in carry come along, so that nothing has to be joined back by doc_id.

    A null or empty text has no words and no hits; items without words match nothing, null item_ids none either; items
    with the same words count each; repeated item rows count once; repeated documents give a row each; an empty benchmark
    hits nothing. Other columns are ignored.
    """
    own = docs.select(*carry)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(c).alias(f"own{i}") for i, c in enumerate(carry)])
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null")
    n_words = items.select(F.octet_length("text").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0] // 2
    out = OUT + ", hits array<struct<item_id:string,start:int,end:int>>" * spans + "".join(f", `{c}` {t}" for c, t in own.dtypes)
    if n_words <= 4 * local_windows:  # a window at most for each two bytes: a bound before anything is fetched
        rows = [(i, words_of(None if t is None else t.encode("utf-8", "surrogatepass"))) for i, t in items.distinct().toLocalIterator()]
        windows: dict[bytes, set] = {}
        lengths: dict[int, None] = {}
        for item, words in rows:
            for x in _windows(words, window):
                windows.setdefault(x, set()).add(item)
            if words:
                lengths[min(window, len(words))] = None
        if len(windows) <= local_windows:
            return _local(docs, [w for _, w in rows if w], windows, sorted(lengths), window, out, spans, carry)
    return _shuffled(docs, items, window, out, spans, carry)


def _choose(length: int, window: int) -> tuple[int, int]:
    """k and w for windows of one length: an index for each length, so that a short item costs the longer ones nothing."""
    k = min(5, length) if length == window else length
    return k, length - k + 1


def _marks(words: list[bytes], lengths: list[int], window: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, fingerprints) of the k-grams that winnowing keeps for each length of windows."""
    h, out = hash_words(words), []
    for length in lengths:
        k, w = _choose(length, window)
        if len(h) >= length:
            at = winnow(h, k, w)
            out.append((length, at, mix(gram_hashes(h, k)[at] + np.uint64(length))))
    return out


def _starts(places: np.ndarray, length: int, window: int, n: int) -> list[int]:
    """Where the windows begin that hold one of the k-grams at these places."""
    k, _ = _choose(length, window)
    if not len(places):
        return []
    lo, hi = np.maximum(0, places + k - length), np.minimum(places, n - length)
    return np.unique(np.concatenate([np.arange(a, b + 1) for a, b in zip(lo, hi)])).tolist()


def _local(docs, item_words, windows, lengths, window, out, spans, carry):
    marks = [f for words in item_words for _, _, f in _marks(words, [min(window, len(words))], window)]
    prints = np.unique(np.concatenate([np.empty(0, np.uint64), *marks]))
    known = docs.sparkSession.sparkContext.broadcast((windows, prints))

    def scan(words: list[bytes], windows, prints) -> list[tuple[str, int, int]]:
        found = set()
        for length, at, fp in _marks(words, lengths, window):
            for s in _starts(at[np.isin(fp, prints)], length, window, len(words)):
                for item in windows.get(b" ".join(words[s : s + length]), ()):
                    found.add((item, s, s + length))
        return sorted(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, prints = known.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                b = batch.slice(lo, 512)
                words = [words_of(t) for t in utf8(b.column(1))]
                yield _rows(b.column(0), [len(x) for x in words], [scan(x, windows, prints) if windows else [] for x in words], spans, b, carry)

    return docs.mapInArrow(lean(run), out)


def _rows(ids, n_words, found, spans, batch, carry) -> pa.RecordBatch:
    n_hit = [_covered([(s, e) for _, s, e in f]) for f in found]
    items = [{i for i, _, _ in f} for f in found]
    columns = [ids, pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(i) for i in items], pa.int64()), pa.array([_digest(i) for i in items], pa.string()), pa.array([n > 0 for n in n_hit], pa.bool_())]
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    if spans:
        kind = pa.list_(pa.struct([("item_id", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        columns.append(pa.array([[{"item_id": i, "start": s, "end": e} for i, s, e in f] for f in found], kind))
        names.append("hits")
    columns += [batch.column(f"own{i}") for i in range(len(carry))]
    names += carry
    return pa.RecordBatch.from_arrays(columns, names)


def _shuffled(docs, items, window, out, spans, carry):
    """For a benchmark of any size: fingerprints are joined, then the whole windows of the documents that share one.

    Rows have keys of their own here, so those with a null or repeated doc_id keep their own hits.
    """
    docs = keyed(docs, Stages(docs.sparkSession, "decontamination"))

    def lengths_of(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([min(window, len(words_of(t))) for t in utf8(b.column(1))], pa.int32())], ["n"])

    lengths = sorted(r[0] for r in items.mapInArrow(lengths_of, "n int").where("n > 0").distinct().collect())  # window values at most

    def prints(batches):
        for b in batches:
            for t in utf8(b.column(1)):
                words = words_of(t)
                fps = [f for _, _, f in _marks(words, [min(window, len(words))], window)] if words else []
                yield pa.RecordBatch.from_arrays([signed(np.unique(np.concatenate([np.empty(0, np.uint64), *fps])))], ["fp"])

    def doc_prints(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                fps = [np.unique(np.concatenate([np.empty(0, np.uint64), *[f for _, _, f in _marks(words_of(t), lengths, window)]])) for t in utf8(part.column("text"))]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column("row").to_numpy(), [len(f) for f in fps])), signed(np.concatenate(fps))], ["row", "fp"])

    def item_windows(batches):
        for b in batches:
            for key, t in zip(b.column(0).to_pylist(), utf8(b.column(1))):
                x = list(dict.fromkeys(_windows(words_of(t), window)))
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(x), pa.string()), pa.array(x, pa.binary())], ["item_id", "words"])

    def doc_windows(batches):
        """The windows around the shared fingerprints of a document, and no others."""
        for b in batches:
            for key, t, shared in zip(b.column("row").to_pylist(), utf8(b.column("text")), b.column("fps")):
                words, shared = words_of(t), shared.values.to_numpy().view(np.uint64)
                x = [(s, n) for n, at, fp in _marks(words, lengths, window) for s in _starts(at[np.isin(fp, shared)], n, window, len(words))]
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(x), pa.int64()), pa.array([s for s, _ in x], pa.int32()), pa.array([n for _, n in x], pa.int32()), pa.array([b" ".join(words[s : s + n]) for s, n in x], pa.binary())], ["row", "start", "n", "words"])

    fingerprints = items.mapInArrow(prints, "fp long").distinct()
    shared = docs.mapInArrow(lean(doc_prints), "row long, fp long").join(fingerprints, "fp", "left_semi").groupBy("row").agg(F.collect_set("fp").alias("fps"))  # a document's own
    near = docs.join(shared, "row").select("row", "text", "fps")
    found = near.mapInArrow(lean(doc_windows), "row long, start int, n int, words binary").join(items.mapInArrow(item_windows, "item_id string, words binary").distinct(), "words")
    per_doc = found.groupBy("row").agg(F.collect_set(F.struct("item_id", "start", (F.col("start") + F.col("n")).alias("end"))).alias("hits"))

    def run(batches):
        for b in batches:
            hits = [sorted((x["item_id"], x["start"], x["end"]) for x in h or ()) for h in b.column("hits").to_pylist()]
            yield _rows(b.column(0), [len(words_of(t)) for t in utf8(b.column(1))], hits, spans, b, carry)

    return docs.join(per_doc, "row", "left").select("doc_id", "text", *[f"own{i}" for i in range(len(carry))], "hits").mapInArrow(lean(run), out)
