"""Token counts: each distinct pre-token of the corpus is counted once, and joined to the pre-token frequencies of each document.

The corpus's distinct pre-tokens are one table with their piece counts. Frequent ones are joined by broadcast, a list
bounded in entries and in bytes; the others by their own text, so that a pre-token which a third of all documents hold
never meets in one task. No list of ids is made for any document.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import Stages, docs_of, lean

#: Pre-tokens whose piece count every worker holds, and the bytes that one of them may have: 30 MB there at most.
LISTED, LISTED_BYTES = 200_000, 40
#: Distinct pre-tokens that a task gathers before it hands them on; a bound on memory alone.
FLUSH = 200_000
BLOCK = 256


class PreTokens:
    """Cuts texts into pre-tokens and special strings, and counts the pieces of a pre-token."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special_in = regex.compile("(" + "|".join(regex.escape(s) for s in special) + ")") if special else None
        self.pieces = regex.compile(public_tokenizers.PATTERN)

    def of(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens, and the number of special strings, which the library finds in texts first."""
        if self.special_in is None or not self.special_in.search(text):
            return self.pieces.findall(text), 0
        parts = self.special_in.split(text)
        return [p for part in parts[::2] for p in self.pieces.findall(part)], len(parts) // 2

    def count(self, pieces: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch(pieces, add_special_tokens=False)]


@lru_cache(maxsize=2)
def _worker(path: str) -> PreTokens:
    return PreTokens(path)


def _distinct(vocabulary: str):
    """Pre-tokens with their frequencies, once for each task or more where a task meets very many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, seen = _worker(vocabulary), Counter()

        def out() -> Iterator[pa.RecordBatch]:
            words = list(seen)
            for lo in range(0, len(words), 20_000):
                part = words[lo : lo + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([seen[w] for w in part], pa.int64())], ["piece", "f"])
            seen.clear()

        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                for text in batch.column(0).slice(lo, BLOCK).to_pylist():
                    if text:
                        seen.update(cut.of(text)[0])
                if len(seen) > FLUSH:
                    yield from out()
        yield from out()

    return run


def _counted(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                b = batch.slice(lo, 2000)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(_worker(vocabulary).count(b.column(0).to_pylist()), pa.int64())], ["piece", "f", "n"])

    return run


def _documents(vocabulary: str, listed):
    """What the list gives for a document, and its other pre-tokens with their frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, known = _worker(vocabulary), listed.value
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                size, sums, others, often = [], [], [], []
                for text in part.column(1).to_pylist():
                    text = text or ""
                    pieces, special = cut.of(text)
                    found = list(map(known.get, pieces))
                    rest = Counter([p for p, n in zip(pieces, found) if n is None]) if None in found else {}
                    size.append(len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass")))
                    sums.append(special + sum(filter(None, found)))
                    others += rest
                    often.append(list(rest.values()))
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in often])]).astype(np.int32))
                columns = [pa.ListArray.from_arrays(offsets, pa.array(others, pa.string())), pa.ListArray.from_arrays(offsets, pa.array([x for y in often for x in y], pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), pa.array(sums, pa.int64()), *columns], ["doc_id", "n_bytes", "listed", "piece", "f"])

    return run


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512, listed: int = LISTED) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) for every whole text.

    Null and empty texts have no bytes and no tokens; a null doc_id stays null; repeated rows give a row each; an empty
    table gives none; other columns are ignored. Special strings in texts count as the library's default has them: one
    token. listed: distinct pre-tokens that are joined by broadcast; results don't depend on it.
    """
    stages = Stages(docs.sparkSession, "token-counts")
    docs = docs_of(docs)
    seen = docs.select("text").mapInArrow(lean(_distinct(vocabulary)), "piece string, f long").groupBy("piece").agg(F.sum("f").alias("f"))
    counts = stages.put(seen.mapInArrow(lean(_counted(vocabulary)), "piece string, f long, n long"), "distinct")
    stages.tidy()
    # Frequencies in eighths of a doubling: a few hundred rows, from which the least listed one follows.
    level, short = F.floor(F.log2("f") * 8), F.octet_length("piece") <= LISTED_BYTES
    least, taken = float("inf"), 0
    for k, n in sorted(((r["k"], r["n"]) for r in counts.where(short).groupBy(level.alias("k")).agg(F.count("*").alias("n")).collect()), reverse=True):
        if taken + n > listed:
            break
        least, taken = k, taken + n
    often = short & (level >= F.lit(float(least)))
    known = docs.sparkSession.sparkContext.broadcast({r["piece"]: r["n"] for r in counts.where(often).select("piece", "n").toLocalIterator()} if taken else {})
    rows = docs.mapInArrow(lean(_documents(vocabulary, known)), "doc_id long, n_bytes long, listed long, piece array<string>, f array<long>")
    rows = stages.put(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    rest = rows.select("row", F.explode(F.arrays_zip("piece", "f")).alias("x")).select("row", "x.piece", "x.f")
    rest = rest.join(counts.where(~often).select("piece", "n").hint("merge"), "piece").groupBy("row").agg(F.sum(F.col("f") * F.col("n")).alias("rest"))
    out = rows.select("row", "doc_id", "n_bytes", "listed").join(rest, "row", "left").withColumn("n_tokens", F.col("listed") + F.coalesce("rest", F.lit(0)))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
