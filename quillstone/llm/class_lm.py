"""LM scoring by a class-based bigram model.

Exchange clustering puts every training word into a class. The most frequent words are exchanged one by one until none
moves; then executors move each other word, listed or not, once: out of no class into the one that makes the training
text most likely, by its neighbours among the words classed before. The probability of a word is that of its class after
the class before, times that of the word in its class, mixed with the smoothed share of the word in all tokens. Word
counts are exact over all training texts.

The count of a word is a factor of both parts, so a text's score is a sum over its words of log10(count + 0.1) and a term
of classes alone. Counts and classes of frequent words go to every worker in a list bounded in words and in bytes; those
of all others are joined.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import Stages, docs_of, lean, utf8

#: Words whose counts and classes every worker holds, and the bytes that one of them may have: 40 MB there; all others are joined.
LISTED, LISTED_BYTES = 200_000, 40
#: Words that are exchanged one by one, and classes. Their pair counts reach the driver: a million cells.
OWN, CLASSES = 1000, 48
SMOOTH = 0.1
MIXED = 0.8
FLUSH = 300_000


def _tokens(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()

    def out() -> Iterator[pa.RecordBatch]:
        words = list(seen)
        for lo in range(0, len(words), 50_000):
            part = words[lo : lo + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([seen[w] for w in part], pa.int64())], ["word", "c"])
        seen.clear()

    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            for text in utf8(batch.column(0).slice(lo, 512)):
                seen.update(_tokens(text))
            if len(seen) > FLUSH:
                yield from out()
    yield from out()


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(pairs: np.ndarray, classes: int, rounds: int = 12) -> np.ndarray:
    """Classes of items from their pair counts. All items but the last two (the most frequent first) move, one at a time, to the
    class that makes the training text most likely; the last two, the end and all other words, stay in classes of their own,
    `classes` and `classes` + 1. Ties go to the lowest class."""
    n = len(pairs)
    at = np.arange(n) % classes
    at[n - 2 :] = classes, classes + 1
    c = classes + 2
    onto = np.eye(c)[at]
    big = onto.T @ pairs @ onto
    for _ in range(rounds):
        moved = 0
        for w in range(n - 2):
            a = at[w]
            own = pairs[w, w]
            right = np.bincount(at, weights=pairs[w], minlength=c)
            left = np.bincount(at, weights=pairs[:, w], minlength=c)
            right[a] -= own
            left[a] -= own
            if not right.sum() + left.sum():
                continue
            big[a] -= right
            big[:, a] -= left
            big[a, a] -= own
            rows, columns, diagonal = _f(big), big.sum(axis=1), np.diag(big)
            gain = (_f(big + right) - rows).sum(axis=1) + (_f(big.T + left) - rows.T).sum(axis=1)
            gain += _f(diagonal + right + left + own) - _f(diagonal + right) - _f(diagonal + left) + _f(diagonal)
            # What precedes the word counts among its own class's pairs again, wherever the word goes; so does what follows.
            outs, ins = columns + left, big.sum(axis=0) + right
            gain -= _f(outs + right.sum() + own) - _f(outs) + _f(ins + left.sum() + own) - _f(ins)
            gain[classes:] = -np.inf
            best = int(np.argmax(gain))
            if gain[best] <= gain[a] + 1e-9:
                best = a
            moved += best != a
            at[w] = best
            big[best] += right
            big[:, best] += left
            big[best, best] += own
        if not moved:
            break
    return at


class Exchange:
    """Moves words that have no class yet into one of `classes`, given the pair counts of classes so far (with the end's, the last).

    A word's contexts are codes: a class that precedes it, or `classes` + 1 and a class that follows."""

    def __init__(self, big: np.ndarray):
        self.classes = c = len(big) - 1
        self.to = np.concatenate([big[:, :c], big.T[:, :c]])
        self.ins, self.outs, self.own = big.sum(axis=0)[:c], big.sum(axis=1)[:c], np.diag(big)[:c]

    def __call__(self, codes: np.ndarray, n: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The best class of each word; starts: where its codes begin. Each word has a code at least."""
        have, more = self.to[codes], n[:, None].astype(np.float64)
        gain = np.add.reduceat(_f(have + more) - _f(have), starts, axis=0)
        side = self.classes + 1
        of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(codes))))
        counts = np.bincount(of * (2 * side) + codes, weights=n, minlength=len(starts) * 2 * side).reshape(-1, 2, side)
        left, right = counts[:, 0], counts[:, 1]
        before, after = left[:, : self.classes], right[:, : self.classes]
        gain += _f(self.own + before + after) - _f(self.own + before) - _f(self.own + after) + _f(self.own)
        outs, ins = self.outs + before, self.ins + after
        gain -= _f(outs + right.sum(axis=1, keepdims=True)) - _f(outs) + _f(ins + left.sum(axis=1, keepdims=True)) - _f(ins)
        return np.argmax(gain, axis=1)


def _sequence(place: pa.ListArray, end: int) -> np.ndarray:
    """The words of documents one after the other, with the end before each and behind the last."""
    flat = place.flatten().to_numpy(zero_copy_only=False)
    offsets = place.offsets.to_numpy() - place.offsets[0].as_py()
    return np.append(np.insert(flat, offsets[:-1], end), end)


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def lm_scores(docs: DataFrame, listed: int = LISTED, own: int = OWN, classes: int = CLASSES, mixed: float = MIXED) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity for each row.

    Learns from the rows whose crc32(doc_id as text) mod 10 isn't 0 (a null doc_id counts as an empty string). A null or
    empty text is the end token alone. Without training rows every token is unknown, and the base gives it probability 1.
    Rows that repeat give a row each and count each; ties in frequency are broken by the word's bytes; a word without a
    neighbour that has a class gets one by its hash; words that aren't in the training texts share a class of their own.
    Other columns are ignored. listed: words that are joined by broadcast; the base doesn't depend on it.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    stages = Stages(spark, "lm")
    docs = docs_of(docs).withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0)
    train = docs.where(~F.col("held_out"))
    counts = stages.put(train.select("text").mapInArrow(lean(_count), "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "counts")
    stages.tidy()
    ends = train.count()
    # Counts in eighths of a doubling: a few hundred rows at most, from which the least listed count follows.
    level, short = F.floor(F.log2("c") * 8), F.octet_length("word") <= LISTED_BYTES
    sizes = sorted(((r["k"], r["s"], r["n"], r["c"]) for r in counts.groupBy(level.alias("k"), short.alias("s")).agg(F.count("*").alias("n"), F.sum("c").alias("c")).collect()), reverse=True)
    distinct, total = sum(x[2] for x in sizes) + (ends > 0), sum(x[3] for x in sizes) + ends
    least, taken = float("inf"), 0
    for k, is_short, n, _ in sizes:
        if is_short:
            if taken + n > listed:
                break
            least, taken = k, taken + n
    often = short & (level >= F.lit(float(least)))
    top = [(bytes(r["word"]), r["c"]) for r in counts.where(often).toLocalIterator()] if taken else []
    top.sort(key=lambda x: (-x[1], x[0]))
    own = min(own, len(top))
    lexicon = sc.broadcast([w for w, _ in top])
    log_counts = np.log10(np.array([c for _, c in top], dtype=np.float64) + SMOOTH)
    del top

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {w: i for i, w in enumerate(lexicon.value)}.get
        for b in _parts(batches, 512):
            words = [_tokens(t) for t in utf8(b.column(2))]
            offsets = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int32)
            found = [place(x, -1) for w in words for x in w]
            flat = np.array(found, dtype=np.int32)
            tail = [x for w in words for x in w] if -1 in found else []
            tail = [tail[i] for i in np.flatnonzero(flat < 0).tolist()] if tail else []
            ends_at = np.concatenate([[0], np.cumsum(flat < 0)])[offsets].astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.ListArray.from_arrays(pa.array(ends_at), pa.array(tail, pa.binary()))], ["doc_id", "held_out", "place", "tail"])

    rows = docs.select("doc_id", "held_out", "text").mapInArrow(lean(places), "doc_id long, held_out boolean, place array<int>, tail array<binary>")
    rows = stages.put(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    read = rows.where("not held_out").select("place", "tail")

    def item_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((own + 2) ** 2, dtype=np.int64)
        for b in _parts(batches, 4000):
            seq = _sequence(b.column(0), -2).astype(np.int64)
            seq = np.where(seq == -2, own, np.where((seq < 0) | (seq >= own), own + 1, seq))
            found += np.bincount(seq[:-1] * (own + 2) + seq[1:], minlength=len(found))
        keys = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(found[keys])], ["k", "c"])

    met = read.select("place").mapInArrow(lean(item_pairs), "k long, c long").groupBy("k").agg(F.sum("c").alias("c")).toArrow()  # (own + 2) squared at most
    pairs = np.zeros((own + 2) ** 2)
    pairs[met["k"].to_numpy()] = met["c"].to_numpy()
    pairs = pairs.reshape(own + 2, own + 2)
    first = exchange(pairs, classes)[:own]
    onto = np.eye(classes + 2)[np.concatenate([first, [classes, classes + 1]]).astype(int)]
    start = sc.broadcast((first.astype(np.int64), (onto.T @ pairs @ onto)[: classes + 1, : classes + 1]))
    side = classes + 1

    def classed(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Places in a row, and the classes of the words exchanged first, the end's, and -1 of all others."""
        seq = _sequence(b.column(0), -2).astype(np.int64)
        known = np.append(start.value[0], 0)
        return seq, np.where(seq == -2, classes, np.where((seq >= 0) & (seq < own), known[np.clip(seq, 0, own)], -1))

    def listed_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0

        def out():
            k, n = np.unique(np.concatenate(kept), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array((k // (2 * side)).astype(np.int32)), pa.array((k % (2 * side)).astype(np.int32)), pa.array(n)], ["w", "code", "n"])

        for b in _parts(batches, 4000):
            seq, at = classed(b)
            here = np.flatnonzero(seq >= own)
            for step, base in ((-1, 0), (1, side)):
                near = at[here + step]
                kept.append(seq[here[near >= 0]] * (2 * side) + base + near[near >= 0])
                size += len(kept[-1])
            if size > 6_000_000:
                yield out()
                kept, size = [], 0
        if size:
            yield out()

    def tail_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches, 4000):
            seq, at = classed(b)
            here = np.flatnonzero(seq == -1)
            words = b.column(1).flatten()
            for step, base in ((-1, 0), (1, side)):
                near = at[here + step]
                ok = near >= 0
                yield pa.RecordBatch.from_arrays([words.filter(pa.array(ok)), pa.array((base + near[ok]).astype(np.int32)), pa.array(np.ones(int(ok.sum()), dtype=np.int64))], ["w", "code", "n"])

    def move(kind: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            into = Exchange(start.value[1])
            for b in _parts(batches):
                x = b.column(1)
                starts = x.offsets.to_numpy()[:-1] - x.offsets[0].as_py()
                x = x.flatten()
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(into(x.field(0).to_numpy(), x.field(1).to_numpy(), starts).astype(np.int32))], ["w", "class"])

        return lambda found: found.groupBy("w", "code").agg(F.sum("n").alias("n")).groupBy("w").agg(F.collect_list(F.struct("code", "n")).alias("x")).mapInArrow(lean(run), f"w {kind}, class int")

    at = np.arange(len(log_counts)) % classes
    at[:own] = first
    if own < len(log_counts):
        moved = move("int")(read.select("place").mapInArrow(lean(listed_contexts), "w int, code int, n long")).toArrow()  # listed words at most
        at[moved["w"].to_numpy()] = moved["class"].to_numpy()
    stages.tidy()
    moved = move("binary")(read.select("place", "tail").mapInArrow(lean(tail_contexts), "w binary, code int, n long")).withColumnRenamed("w", "word")
    rare = counts.where(~often).join(moved.hint("merge"), "word", "left").select("word", "c", F.coalesce("class", F.pmod(F.xxhash64("word"), F.lit(classes))).cast("int").alias("class"))
    rare = stages.put(rare, "rare")
    stages.tidy()
    kinds = np.bincount(at, minlength=classes + 2).astype(np.float64)
    for r in rare.groupBy("class").count().collect():
        kinds[r["class"]] += r["count"]
    shared = sc.broadcast((np.append(at, classes + 1).astype(np.uint8), np.append(log_counts, 0.0)))

    tail = rows.select("row", F.posexplode("tail").alias("i", "word"))
    tail = tail.join(rare.hint("merge"), "word").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("i", "class", "c"))).alias("found"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, logs = shared.value
        for b in _parts(batches, 512):
            seqs, known, sums = [], [], []
            for place, found in zip(b.column("place"), b.column("found")):
                place = place.values.to_numpy() if len(place) else np.empty(0, dtype=np.int32)
                seq = at[place]  # place -1 reads what stands last
                known.append(int((place >= 0).sum()))
                log_sum = float(logs[place].sum())
                if found.is_valid:
                    i, c, n = (found.values.field(k).to_numpy() for k in range(3))
                    seq[np.flatnonzero(place < 0)[i]] = c
                    known[-1] += len(i)
                    log_sum += float(np.log10(n + SMOOTH).sum()) + (len(seq) - known[-1]) * float(np.log10(SMOOTH))
                else:
                    log_sum += (len(seq) - known[-1]) * float(np.log10(SMOOTH))
                seqs.append(seq.tobytes())
                sums.append(log_sum)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(seqs, pa.binary()), pa.array(known, pa.int64()), pa.array(sums, pa.float64())], ["doc_id", "held_out", "classes", "known", "log_sum"])

    filled = rows.select("row", "doc_id", "held_out", "place").join(tail, "row", "left").mapInArrow(lean(fill), "doc_id long, held_out boolean, classes binary, known long, log_sum double")
    filled = stages.put(filled, "classes")
    stages.drop(rows)
    stages.tidy()

    def class_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = classes + 2
        found = np.zeros(c * c, dtype=np.int64)
        end = bytes([classes])
        for b in _parts(batches):
            seq = np.frombuffer(end + end.join(b.column(0).to_pylist()) + end, dtype=np.uint8).astype(np.int64)
            found += np.bincount(seq[:-1] * c + seq[1:], minlength=c * c)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(c * c)), pa.array(found)], ["k", "c"])

    moves = np.zeros((classes + 2) ** 2)
    for r in filled.where("not held_out").select("classes").mapInArrow(lean(class_pairs), "k long, c long").groupBy("k").agg(F.sum("c").alias("c")).collect():
        moves[r["k"]] = r["c"]
    moves = moves.reshape(classes + 2, classes + 2)
    share = (moves.sum(axis=0) + 0.5) / (moves.sum() + 0.5 * (classes + 2))
    after = (moves + 20 * share) / (moves.sum(axis=1, keepdims=True) + 20)
    room = moves.sum(axis=0) + SMOOTH * (kinds + 1)
    z = total + SMOOTH * (distinct + 1)
    term = np.log10(mixed * after / room + (1 - mixed) / z)  # of a word; its count is the other factor
    at_end = np.log10(mixed * after[:, classes] + (1 - mixed) * (ends + SMOOTH) / z)
    base_end = float(np.log10((ends + SMOOTH) / z))
    model = sc.broadcast((term, at_end))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        term, at_end = model.value
        for b in _parts(batches):
            n, sums = [], []
            for seq in b.column("classes").to_pylist():
                c = np.frombuffer(bytes([classes]) + seq, dtype=np.uint8)
                n.append(len(c))
                sums.append(float(term[c[:-1], c[1:]].sum() + at_end[c[-1]]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(n, pa.int64()), b.column("known"), b.column("log_sum"), pa.array(sums, pa.float64())], ["doc_id", "held_out", "n_tokens", "known", "log_sum", "class_sum"])

    out = filled.mapInArrow(lean(score), "doc_id long, held_out boolean, n_tokens long, known long, log_sum double, class_sum double")
    out = out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + int(ends > 0)).cast("long").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("log_sum") - (F.col("n_tokens") - 1) * F.lit(float(np.log10(z))) + F.lit(base_end)).alias("base_score"),
        (F.col("log_sum") + F.col("class_sum")).alias("score"),
    )
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
