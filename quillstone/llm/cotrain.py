"""Quality classifier by co-training.

One classifier sees the words and shapes of a text, the other its metadata. Over some rounds each labels the unlabelled
documents that it is sure of for the other; executors label all of them and sum the gradients. Both are calibrated on a fold that trained neither, combined there, and the
combination scores every document. Two targets are trained in this way: poor quality, and toxicity.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import Stages, lean, utf8

#: Labelled rows that are fetched for training: those with the least hash of doc_id. The unlabelled ones stay with the executors.
LABELLED = 12_000
#: Steps that a round takes over labelled and given rows together; each reads the features of all unlabelled documents.
STEPS = 12
#: Gradients are summed in these fractions of one, so that sums are the same however rows are dealt.
GRAIN = float(1 << 24)
WIDTH = 1 << 18
META_WIDTH = 1 << 12
SHAPES = b"!#$%&*|<>@/0123456789"
_SPLIT = bytes(0x20 if chr(b) in ".,;:!?()[]\"" else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_UPPER = bytes(range(0x41, 0x5B))


class TextFeatures:
    """Places of a text's distinct words and shapes, by hash. Words are kept with their places up to a bound, for speed alone."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def place(self, word: bytes) -> int:
        if len(self.known) > 100_000:
            self.known.clear()
        p = self.known[word] = xxhash.xxh3_64_intdigest(word) % WIDTH
        return p

    def __call__(self, text: bytes | None) -> list[int]:
        text = text or b""
        words = text.translate(_SPLIT).split()
        distinct = set(words)
        known, place = self.known.get, self.place
        out = [p if (p := known(w)) is not None else place(w) for w in distinct]
        n = len(words) + 1
        shapes = [b"\0n%d" % int(math.log2(n)), b"\0d%d" % (10 * len(distinct) // n)]
        shapes += [b"\0%c%d" % (c, min(6, int(2 + math.log2(k / n))) if 4 * k > n else 1) for c in SHAPES if (k := text.count(c))]
        shapes.append(b"\0u%d" % (10 * (len(text) - len(text.translate(None, _UPPER))) // (len(text) + 1)))
        lines = text.split(b"\n")
        shapes.append(b"\0l%d" % (10 * len(set(lines)) // len(lines)))
        return np.unique(np.array(out + [known(s) if known(s) is not None else place(s) for s in shapes], dtype=np.int32))


def meta_features(source, lang, n_chars) -> list[int]:
    size = -1 if n_chars is None or n_chars < 0 else int(math.log2(n_chars + 1))
    return [xxhash.xxh3_64_intdigest(s.encode("utf-8", "surrogatepass")) % META_WIDTH for s in (f"s{source}", f"l{lang}", f"n{size}", f"sl{source}\0{lang}", f"ln{lang}\0{size}")]


@dataclass
class Rows:
    """Sparse rows of ones."""

    places: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, rows: list) -> "Rows":
        return cls(np.concatenate([np.empty(0, np.int64), *[np.asarray(r, dtype=np.int64) for r in rows]]), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64))

    def take(self, at: np.ndarray) -> "Rows":
        return Rows.of([self.places[self.starts[i] : self.starts[i + 1]] for i in at])

    def within(self, chosen: np.ndarray) -> "Rows":
        """The rows with the chosen features alone, numbered among these."""
        hit = chosen[self.places]
        return Rows((np.cumsum(chosen) - 1)[self.places[hit]], np.concatenate([[0], np.cumsum(hit)])[self.starts])

    def dot(self, w: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(w[self.places])])
        return sums[self.starts[1:]] - sums[self.starts[:-1]]

    def back(self, g: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.places, weights=np.repeat(g, np.diff(self.starts)), minlength=width)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Fit:
    """Logistic regression with a ridge penalty by AdaGrad. Features stay at 0 that stand in fewer than `least` rows, or
    whose shares in the two classes differ by less than `tells` standard errors: among many words most differ by chance."""

    def __init__(self, rows: Rows, y: np.ndarray, width: int, penalty: float = 1.0, least: int = 4, tells: float = 3.5):
        self.rows, self.y, self.width, self.penalty, self.least, self.tells = rows, y, width, penalty, least, tells
        self.w, self.b = np.zeros(width), math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
        self.seen, self.seen_b, self.n = np.full(width, 1e-3), 1e-3, len(y)
        self.telling(np.zeros(width), np.zeros(width), 0, 0)

    def telling(self, held: np.ndarray, ones: np.ndarray, n: float, n1: float) -> None:
        """Chooses features by the rows here and others: how many hold each feature, how many of those are 1, and both in all."""
        held, ones = held + np.bincount(self.rows.places, minlength=self.width), ones + self.rows.back(self.y, self.width)
        n, n1 = n + len(self.y), n1 + self.y.sum()
        self.seen, self.seen_b, self.n = self.seen * (n / self.n) ** 2, self.seen_b * (n / self.n) ** 2, n  # gradients grow with the rows
        n1 = max(1.0, min(n - 1.0, n1))
        share = held / max(1, n)
        error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n1 + 1 / max(1.0, n - n1)))
        self.often = (held >= self.least) & (np.abs(ones / n1 - (held - ones) / max(1.0, n - n1)) >= self.tells * error)
        self.w = np.where(self.often, self.w, 0)
        self.at, self.near = np.flatnonzero(self.often), self.rows.within(self.often)

    def step(self, more: np.ndarray | float = 0.0, more_b: float = 0.0) -> None:
        """One step by the rows here and the gradient of others, over the features chosen."""
        at = self.at
        g = sigmoid(self.near.dot(self.w[at]) + self.b) - self.y
        step = self.near.back(g, len(at)) + (more[at] if isinstance(more, np.ndarray) else more) + self.penalty * self.w[at]
        self.seen[at] += step * step
        self.w[at] -= 0.3 * step / np.sqrt(self.seen[at])
        s = g.sum() + more_b
        self.seen_b += s * s
        self.b -= 0.3 * s / math.sqrt(self.seen_b)


def calibrate(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Logistic regression of y on the columns of x and a constant, by Newton's method with a small ridge."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    ridge = np.diag([1.0] * (x.shape[1] - 1) + [1e-3])
    for _ in range(rounds):
        p = sigmoid(x @ w)
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
    return w


@dataclass
class Model:
    text: tuple[np.ndarray, float]
    meta: tuple[np.ndarray, float]
    mix: np.ndarray  # of the text's log odds, the metadata's, and a constant

    def log_odds(self, text: Rows, meta: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = text.dot(self.text[0]) + self.text[1], meta.dot(self.meta[0]) + self.meta[1]
        return a, b, np.column_stack([a, b, np.ones(len(a))]) @ self.mix


def start(views: tuple[Rows, Rows], y: np.ndarray, steps: int = 150) -> tuple[list[Fit], np.ndarray] | None:
    """Both views' fits to three in four of the labelled rows, and the places of the others. y: 1, 0, or NaN where unlabelled.
    None where a class has fewer than 5 labelled rows."""
    labelled = np.flatnonzero(~np.isnan(y))
    if min((y[labelled] == 1).sum(), (y[labelled] == 0).sum()) < 5:
        return None
    held = labelled[np.arange(len(labelled)) % 4 == 3]
    base = np.setdiff1d(labelled, held)
    fits = [Fit(rows.take(base), y[base], width) for rows, width in zip(views, (WIDTH, META_WIDTH))]
    for fit in fits:
        for _ in range(steps):
            fit.step()
    return fits, held


def _lists(column: pa.Array) -> Rows:
    return Rows(column.flatten().to_numpy().astype(np.int64), (column.offsets.to_numpy() - column.offsets[0].as_py()).astype(np.int64))


def _given(views: list[Rows], rounds: list, sure: float, n: int) -> np.ndarray:
    """A label for each row, target and view (-1: none): that of the first round's fits of the other view which were sure of it."""
    given = np.full((n, 4), -1, dtype=np.int8)
    for fits in rounds:
        before = given.copy()
        for target, pair in fits:
            for v, (w, bias) in enumerate(pair):
                p = sigmoid(views[v].dot(w) + bias)
                to, free = given[:, 2 * target + 1 - v], before[:, 2 * target + 1 - v] < 0
                to[free & (p >= sure)] = 1
                to[free & (1 - p >= sure)] = 0
    return given


#: Sums come in parts of so many features, each as one row; so many tasks add up what the others hand on.
PART, ADDERS = 1 << 12, 6


def _summed(rows: DataFrame, run, lengths: list[int]) -> list[np.ndarray]:
    """Sums over all rows of the vectors that run gives for each batch, which have these lengths. What reaches the driver is as long
    as they are, whatever the number of rows; a task hands on its sums in parts."""
    starts = np.concatenate([[0], np.cumsum(lengths)])

    def parts(found: dict[int, np.ndarray]) -> pa.RecordBatch:
        found = {k: x for k, x in sorted(found.items()) if x.any()}
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([x.tobytes() for x in found.values()], pa.binary())], ["part", "sums"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(starts[-1] + PART)
        for b in batches:
            for i, x in run(b):
                out[starts[i] : starts[i + 1]] += x
        yield parts({k: out[k * PART : (k + 1) * PART] for k in range(-(-starts[-1] // PART))})

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = np.frombuffer(x)
                out[k] = out[k] + x if k in out else x
        yield parts(out)

    schema = "part int, sums binary"
    total = np.zeros(starts[-1] + PART)
    for r in rows.mapInArrow(lean(each), schema).repartition(ADDERS).mapInArrow(merged, schema).collect():  # ADDERS times the sums at most
        total[r["part"] * PART : (r["part"] + 1) * PART] += np.frombuffer(bytes(r["sums"]))
    return [total[lo:hi] for lo, hi in zip(starts[:-1], starts[1:])]


def cotrain(fits: dict[int, list[Fit]], rows: DataFrame, stages: Stages, rounds: int = 3, sure: float = 0.98, steps: int = STEPS) -> None:
    """Goes on with both views' fits of each target over unlabelled rows (t, m).

    Each round after the first a view gives the other all rows whose class it believes in with at least `sure`, and both
    take steps over the labelled rows and all rows given so far. A round reads the rows twice: to choose the features that
    tell, and to write down those of each row given. Its steps read these.
    """
    context = rows.sparkSession.sparkContext
    known: list = []
    each = [(k, v) for k in fits for v in (0, 1)]
    for _ in range(rounds - 1):
        known.append([(k, [(f.w, f.b) for f in x]) for k, x in fits.items()])
        shared = context.broadcast(list(known))

        def labels(b: pa.RecordBatch, shared=shared) -> tuple[list[Rows], np.ndarray]:
            views = [_lists(b.column(c)) for c in ("t", "m")]
            return views, _given(views, shared.value, sure, b.num_rows)

        def counts(b: pa.RecordBatch):
            views, given = labels(b)
            for i, (k, v) in enumerate(each):
                y = given[:, 2 * k + v]
                for half, g in enumerate(((y >= 0).astype(np.float64), (y == 1).astype(np.float64))):
                    yield 2 * i + half, np.append(views[v].back(g, (WIDTH, META_WIDTH)[v]), g.sum())

        sums = _summed(rows, counts, [(WIDTH, META_WIDTH)[v] + 1 for _, v in each for _ in (0, 1)])
        for i, (k, v) in enumerate(each):
            held, ones = sums[2 * i], sums[2 * i + 1]
            fits[k][v].telling(held[:-1], ones[:-1], held[-1], ones[-1])
        tells = context.broadcast([np.flatnonzero(np.any([x[v].often for x in fits.values()], axis=0)) for v in (0, 1)])

        def chosen(batches: Iterator[pa.RecordBatch], labels=labels, tells=tells) -> Iterator[pa.RecordBatch]:
            for b in batches:
                views, given = labels(b)
                take = np.flatnonzero((given >= 0).any(axis=1))
                columns = []
                for x, places, width in zip(views, tells.value, (WIDTH, META_WIDTH)):
                    near = x.within(np.bincount(places, minlength=width).astype(bool))
                    columns.append(pa.ListArray.from_arrays(pa.array(near.starts.astype(np.int32)), pa.array(near.places.astype(np.int32))))
                columns.append(pa.FixedSizeListArray.from_arrays(pa.array(given.ravel()), 4).cast(pa.list_(pa.int8())))
                yield pa.RecordBatch.from_arrays(columns, ["t", "m", "given"]).take(pa.array(take))

        small = stages.put(rows.mapInArrow(lean(chosen), "t array<int>, m array<int>, given array<byte>"), "given")
        widths = [len(x) for x in tells.value]
        for _ in range(steps):
            now = context.broadcast([[(x[v].w[tells.value[v]], x[v].b) for v in (0, 1)] for x in fits.values()])

            def gradients(b: pa.RecordBatch, now=now, order=tuple(fits), widths=widths):
                views = [_lists(b.column(c)) for c in ("t", "m")]
                given = np.array(b.column("given").flatten()).reshape(b.num_rows, 4)
                for j, k in enumerate(order):
                    for v, (w, bias) in enumerate(now.value[j]):
                        y = given[:, 2 * k + v]
                        g = np.where(y >= 0, np.rint(GRAIN * (sigmoid(views[v].dot(w) + bias) - y)), 0)
                        yield 2 * j + v, np.append(views[v].back(g, widths[v]), g.sum())

            sums = _summed(small, gradients, [widths[v] + 1 for _, v in each])
            for i, (k, v) in enumerate(each):
                more = np.zeros(fits[k][v].width)
                more[tells.value[v]] = sums[i][:-1] / GRAIN
                fits[k][v].step(more, sums[i][-1] / GRAIN)
        stages.drop(small)
        stages.tidy()
    stages.drop(rows)


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> dict[str, Model | None]:
    """Models for "poor" (quality 0) and "toxic" (toxic 1) from a bounded sample of labelled rows and all others, as unlabelled ones."""
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("double").alias("quality"), F.max("toxic").cast("double").alias("toxic"))
    known = known.where("quality is not null or toxic is not null")
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null")
    chosen = known.join(ids, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    chosen = F.broadcast(chosen)  # `labelled` rows at most
    # One row for each labelled id, however many share it: what is fetched stays bounded.
    sample = _columns(docs).join(chosen, "doc_id").groupBy("doc_id", "quality", "toxic").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("x")).select("doc_id", "quality", "toxic", "x.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        see = TextFeatures()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                b = batch.slice(lo, 256)
                text = [see(t) for t in utf8(b.column("text"))]
                meta = [meta_features(*x) for x in zip(*[b.column(c).to_pylist() for c in ("source", "lang", "n_chars")])]
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(t) for t in text])]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), b.column("toxic"), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(text))), pa.array(meta, pa.list_(pa.int32()))], ["doc_id", "quality", "toxic", "t", "m"])

    features = "doc_id long, quality double, toxic double, t array<int>, m array<int>"
    rows = sample.mapInArrow(lean(run), features).toArrow().sort_by("doc_id")
    views = tuple(Rows.of(rows.column(c).combine_chunks().to_numpy(zero_copy_only=False)) if len(rows) else Rows.of([]) for c in ("t", "m"))
    quality, toxic = (np.array(rows.column(c).to_numpy(), dtype=np.float64) for c in ("quality", "toxic"))
    targets = (1 - quality, toxic)
    started = {k: s for k, y in enumerate(targets) if (s := start(views, y))}
    if started:
        stages = Stages(docs.sparkSession, "cotrain")
        nothing = F.lit(None).cast("double")
        others = _columns(docs).join(chosen.select("doc_id"), "doc_id", "left_anti").withColumns({"quality": nothing, "toxic": nothing})
        others = others.mapInArrow(lean(run), features).select("t", "m")
        cotrain({k: fits for k, (fits, _) in started.items()}, stages.put(others, "unlabelled"), stages)
    models: dict[str, Model | None] = {"poor": None, "toxic": None}
    for k, (fits, held) in started.items():
        m = models[("poor", "toxic")[k]] = Model((fits[0].w, fits[0].b), (fits[1].w, fits[1].b), np.zeros(3))
        a, b, _ = m.log_odds(views[0].take(held), views[1].take(held))
        m.mix = calibrate(np.column_stack([a, b]), targets[k][held])
    return models


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars"))


def classify(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, most: float = 0.5, with_docs: bool = False) -> DataFrame:
    """doc_id, p_poor, p_toxic, poor_text, poor_meta, toxic_text, toxic_meta (log odds of each view), kept for every row;
    with with_docs, its text, lang, source and n_chars too, so that nothing has to be joined back by doc_id.

    kept: neither probability reaches `most`. Null and empty texts have no words but a shape; null metadata is a value of
    its own. Labels with nulls train only the target they name; of several labels for a document the worst counts. A
    target with too few labels has probability 0 everywhere. Repeated rows give a row each; an empty table none.
    """
    models = fit(docs, labels, labelled)
    own = ("text", "lang", "source", "n_chars") if with_docs else ()
    small = {k: m and Model((m.text[0].astype(np.float32), m.text[1]), (m.meta[0].astype(np.float32), m.meta[1]), m.mix) for k, m in models.items()}
    shared = docs.sparkSession.sparkContext.broadcast(small)  # weights of two hashed vocabularies: 2 MB whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        see = TextFeatures()
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                b = batch.slice(lo, 512)
                text = Rows.of([see(t) for t in utf8(b.column("text"))])
                meta = Rows.of([meta_features(*x) for x in zip(*[b.column(c).to_pylist() for c in ("source", "lang", "n_chars")])])
                out, probabilities = [], []
                for name in ("poor", "toxic"):
                    m = shared.value[name]
                    if m is None:
                        out += [np.zeros(b.num_rows)] * 2
                        probabilities.append(np.zeros(b.num_rows))
                    else:
                        x, y, both = m.log_odds(text, meta)
                        out += [x, y]
                        probabilities.append(sigmoid(both))
                kept = (probabilities[0] < most) & (probabilities[1] < most)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, probabilities), *[pa.array(np.asarray(x, dtype=np.float64)) for x in out], pa.array(kept), *[b.column(c) for c in own]], ["doc_id", "p_poor", "p_toxic", "poor_text", "poor_meta", "toxic_text", "toxic_meta", "kept", *own])

    return _columns(docs).mapInArrow(lean(run), "doc_id long, p_poor double, p_toxic double, poor_text double, poor_meta double, toxic_text double, toxic_meta double, kept boolean" + ", text string, lang string, source string, n_chars long" * with_docs)
