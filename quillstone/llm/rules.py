"""Quality rules by weak supervision: rules vote or abstain, expectation-maximisation finds how far each can be trusted.

DataFrame functions only. What leaves the executors is the number of documents for each pattern of votes, of which there
are at most 3 to the number of rules, whatever the size of the corpus.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import Stages, docs_of

SPACE = "[\\x20\\x09-\\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def features(docs: DataFrame) -> DataFrame:
    """Exact counts for every whole text; null counts as no text.

    Repeated 3-word windows are found by sorting each text's window hashes with their positions, so a text costs
    n log n whatever it repeats.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs_of(docs).select(
        "doc_id",
        text.alias("text"),
        F.filter(F.split(text, SPACE), lambda w: w != "").alias("w"),
        F.filter(F.split(text, "\n"), lambda s: F.translate(s, BLANKS, "") != "").alias("lines"),
    )
    hashes = F.transform(F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.size("w")).alias("b"), F.slice("w", 3, F.size("w")).alias("c")), lambda z, i: F.struct(F.xxhash64(z["a"], z["b"], z["c"]).alias("h"), i.alias("p")))
    base = base.withColumn("s", F.when(F.size("w") >= 3, F.array_sort(F.slice(hashes, 1, F.greatest(F.size("w") - 2, F.lit(0))))).otherwise(F.slice(hashes, 1, 0)))
    again = F.filter(F.transform("s", lambda x, i: F.when((x["h"] == F.get("s", i - 1)["h"]) | (x["h"] == F.get("s", i + 1)["h"]), x["p"])), lambda p: p.isNotNull())
    base = base.withColumn("p", F.array_sort(again))
    covered = F.aggregate(F.transform("p", lambda x, i: F.coalesce(F.least(F.lit(3), F.get("p", i + 1) - x), F.lit(3))), F.lit(0), lambda a, x: a + x)
    n_chars = F.length("text")
    return base.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.translate("text", BLANKS, "")).cast("long").alias("word_chars"),
        (n_chars - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (n_chars - F.length(F.translate("text", "!", ""))).cast("long").alias("n_bangs"),
        (F.length("text") - F.length(F.regexp_replace("text", "\\p{Lu}", ""))).cast("long").alias("n_upper"),
        (n_chars - F.length(F.translate("text", "|", ""))).cast("long").alias("n_bars"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
    )


@dataclass(frozen=True)
class Rule:
    """Votes +1 (fine) where good holds, else -1 (poor) where bad holds, else abstains. Both are SQL over the features."""

    name: str
    good: str
    bad: str


RULES = (
    Rule("symbols", "n_symbols * 200 <= n_words", "n_symbols * 10 > n_words"),
    Rule("symbol_share", "n_symbols * 1000 <= word_chars", "n_symbols * 20 > word_chars"),
    Rule("repeats", "n_repeat_words * 20 <= n_words", "n_repeat_words * 4 > n_words"),
    Rule("lines", "n_lines >= 2 and n_dup_lines = 0", "n_dup_lines >= 3 and n_dup_lines * 4 > n_lines"),
    Rule("bangs", "n_bangs * 200 <= n_words", "n_bangs * 5 > n_words"),
    Rule("capitals", "n_upper * 6 <= word_chars", "n_upper * 3 > word_chars"),
    Rule("bars", "n_bars = 0 and n_words >= 20", "n_bars * 8 > n_words"),
    Rule("word_length", "word_chars between 3 * n_words and 8 * n_words", "word_chars < 2 * n_words or word_chars > 12 * n_words"),
    Rule("variety", "n_distinct * 5 >= n_words and n_words >= 20", "n_words >= 100 and n_distinct * 10 < n_words"),
)


def votes(rules=RULES) -> list[Column]:
    return [F.expr(f"case when {r.bad} then -1 when {r.good} then 1 else 0 end").cast("byte").alias(f"vote_{r.name}") for r in rules]


#: What is believed of a rule before the data speak: the share of fine and of poor documents on which it votes -1, 0 and 1, and
#: how many documents, as a share of the corpus, that belief is worth. Poor documents come in kinds, so most rules pass most of them.
FINE = {-1: 0.003, 0: 0.35, 1: 0.647}
POOR = {-1: 0.25, 0: 0.2, 1: 0.55}
TRUST = 0.5


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50, prior: float = 0.85) -> tuple[float, list[dict[int, float]]]:
    """Two-class EM over vote patterns with their counts, at the maximum posterior under FINE, POOR and TRUST.

    Returns log prior odds and for each rule the log odds that each vote (-1, 0, 1) adds. The beliefs are worth a share of
    the corpus, so the result doesn't change when every count is doubled, and the classes can't change places.
    """
    k = len(patterns[0][0]) if patterns else 0
    weight = TRUST * max(1, sum(n for _, n in patterns))
    fine, poor, p = [dict(FINE) for _ in range(k)], [dict(POOR) for _ in range(k)], prior
    for _ in range(rounds):
        up = [{v: weight * x for v, x in FINE.items()} for _ in range(k)]
        down = [{v: weight * x for v, x in POOR.items()} for _ in range(k)]
        mass, total = weight * prior, weight
        for votes_, n in patterns:
            odds = math.log(p / (1 - p)) + sum(math.log(fine[j][v] / poor[j][v]) for j, v in enumerate(votes_))
            q = 1 / (1 + math.exp(-max(-60.0, min(60.0, odds))))
            mass += n * q
            total += n
            for j, v in enumerate(votes_):
                up[j][v] += n * q
                down[j][v] += n * (1 - q)
        p = mass / total
        fine = [{v: x / sum(u.values()) for v, x in u.items()} for u in up]
        poor = [{v: x / sum(u.values()) for v, x in u.items()} for u in down]
    return math.log(p / (1 - p)), [{v: math.log(f[v] / q[v]) for v in (-1, 0, 1)} for f, q in zip(fine, poor)]


def quality_rules(docs: DataFrame, rules=RULES, threshold: float = 0.5) -> DataFrame:
    """One row for each row of docs: the counts, votes, posterior and verdict.

    kept = not base_failed and posterior >= threshold. base_failed: n_words < 50 or 100 * n_repeat_words > 50 * n_words.
    Null and empty texts have no words and
    fail the base; a null doc_id stays null; repeated rows give a row each; an empty table gives no rows; other columns
    are ignored. The counts are written once; EM reads the vote patterns.
    """
    known = Stages(docs.sparkSession, "rules").put(features(docs), "features")
    voted = known.select("*", *votes(rules))
    names = [f"vote_{r.name}" for r in rules]
    counted = voted.where("n_words > 0").groupBy(*names).count().collect()  # at most 3 ** len(rules) rows
    prior, weights = fit([(tuple(int(r[c]) for c in names), r["count"]) for r in counted])
    odds = F.lit(prior)
    for c, w in zip(names, weights):
        odds = odds + F.when(F.col(c) == 1, F.lit(w[1])).when(F.col(c) == -1, F.lit(w[-1])).otherwise(F.lit(w[0]))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        voted.withColumn("posterior", 1 / (1 + F.exp(-odds)))
        .withColumn("base_failed", failed)
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("posterior") >= threshold)).alias("kept"), "posterior", *names)
    )
