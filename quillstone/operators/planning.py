"""Budgets of requests, and plans over ordered rows: batches, samples, page orders, allotments and pairs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators import coverage, ordered

#: Fixed values of the budgets.
RESERVE, CHARACTERS, FORMATTING, PLAN_REQUESTS, TARGET_POINTS = 512, 16_000, 256, 256, 8
FULL_SAMPLE, PRIMARY, EXPANDED = 6000, (5, 600), (9, 800)


def character_limit(context: Column, output: Column) -> Column:
    """min(16000, 3 * (context - output - 512)), 0 where nothing is left."""
    return F.least(F.lit(CHARACTERS), 3 * F.greatest(F.lit(0), context - output - RESERVE))


def request_fits(context: Column, output: Column, system: Column, user: Column) -> Column:
    return system + user <= character_limit(context, output)


def response_tokens(overhead: Column, characters: Column, units: Column, floor: int = 0) -> Column:
    """overhead + ceil(0.23 * characters * units) + 256, at least floor."""
    return F.greatest(F.lit(floor), overhead + F.floor((23 * characters * units + 99) / 100) + FORMATTING).cast("long")


def plan_fits(batches: Column, reductions: Column) -> Column:
    return 2 * (batches + reductions) <= PLAN_REQUESTS


def largest_allowance(room: Column, per_unit: Column, most: Column) -> Column:
    """The largest n of 0 to most for which n * per_unit fits in room: what a search over a cost that never falls would find."""
    return F.greatest(F.lit(0), F.least(most, F.floor(room / per_unit))).cast("long")


def admitted_ceiling(room: Column, units: Column, ceiling: Column, least: int) -> Column:
    """A text ceiling for each of units, shrunk until all fit in room (characters at 0.23 tokens); null where less than least is left."""
    fits = largest_allowance(room * 100, 23 * units, ceiling)
    return F.when(fits >= least, fits)


def _batches(most: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, ends = [], [0]
            for sizes in b.column("sizes").to_pylist():
                batch = held = used = 0
                for n in sizes:
                    if held and (held == most or used + n > limit):
                        batch, held, used = batch + 1, 0, 0
                    held, used = held + 1, used + n
                    out.append(batch if n <= limit else None)
                ends.append(len(out))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out, pa.int64()))], ["key", "places", "batches"])

    return run


def batches(rows: DataFrame, key: str, order: str, size: str, most: int, limit: int) -> DataFrame:
    """Ordered rows in batches of at most `most` rows and `limit` characters; `batch` is null for a row that fits in none."""
    g = rows.groupBy(F.col(key).alias("key")).agg(F.sort_array(F.collect_list(F.struct(F.col(order).cast("long").alias("p"), F.col(size).cast("long").alias("n")))).alias("x"))
    kind = dict(g.dtypes)["key"]
    done = g.select("key", F.col("x.p").alias("places"), F.col("x.n").alias("sizes")).mapInArrow(_batches(most, limit), f"key {kind}, places array<long>, batches array<long>")
    return done.select(F.col("key").alias(key), F.explode(F.arrays_zip("places", "batches")).alias("z")).select(key, F.col("z.places").alias(order), F.col("z.batches").alias("batch"))


def sample(pages: DataFrame, document: str, page: str, text: str, expanded: bool = False) -> DataFrame:
    """What of each document a classifier is shown: all pages with text if they are short together, else evenly spaced ones, cut in the middle."""
    count, room = EXPANDED if expanded else PRIMARY
    solid = pages.withColumn("told", T.trimmed(F.col(text))).where("told <> ''")
    total = solid.groupBy(document).agg(F.sum(F.length("told")).alias("characters"))
    whole = solid.join(total.where(F.col("characters") <= FULL_SAMPLE).select(document), document, "left_semi")
    long = ordered.evenly_spaced(solid.join(total.where(F.col("characters") > FULL_SAMPLE).select(document), document, "left_semi"), document, [page], count)
    columns = [document, page]
    cut = long.select(*columns, F.lit("expanded" if expanded else "distributed").alias("sampling"), T.middle_excerpt(F.col("told"), room).alias("excerpt"))
    return whole.select(*columns, F.lit("full_text").alias("sampling"), F.col("told").alias("excerpt")).union(cut)


def suggestion(votes: DataFrame, document: str, purpose: str, weight: str, mapping: dict[str, str]) -> DataFrame:
    """The dominant purpose of each document and its profile; a tie, or a purpose without one, asks for the expanded sample."""
    sums = votes.groupBy(document, purpose).agg(F.sum(weight).alias("w"))
    g = sums.groupBy(document).agg(F.max(F.struct("w", purpose)).alias("x"), F.sum("w").alias("all"))
    profile = F.lit(None).cast("string")
    for k, v in mapping.items():
        profile = F.when(F.col(f"x.{purpose}") == k, F.lit(v)).otherwise(profile)
    sure = (F.col("x.w") * 2 > F.col("all")) & profile.isNotNull()
    return g.select(document, F.col(f"x.{purpose}").alias("purpose"), F.when(sure, profile).alias("profile"), (~sure).alias("expand"))


def page_order(pages: DataFrame, document: str, page: str, kept: str) -> DataFrame:
    """The order in which pages are looked at, and whether a page is reached: evenly spaced ones first, then the others, until
    as many as the retention target were kept. pages: one row for each page with text; kept: whether looking at it keeps it."""
    w = Window.partitionBy(document)
    known = pages.withColumns({"n_pages": F.count("*").over(w), "i": F.row_number().over(w.orderBy(page)) - 1})
    target = coverage.retention_target(F.col("n_pages"))
    slot = F.expr("case when target <= 1 then 0 else (i * (target - 1) + n_pages - 2) div greatest(n_pages - 1, 1) end")
    known = known.withColumn("target", target).withColumn("slot", slot)
    known = known.withColumn("chosen", F.expr("case when target <= 1 then i = 0 else (slot * (n_pages - 1)) div (target - 1) = i end"))
    turn = w.orderBy(F.desc("chosen"), page)
    run = known.withColumns({"turn": F.row_number().over(turn), "before": F.coalesce(F.sum(F.col(kept).cast("int")).over(turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    return run.select(document, page, "chosen", "turn", (F.col("before") < F.col("target")).alias("reached"), F.col("target"))


def replay_violations(recorded: DataFrame, planned: DataFrame, document: str, page: str) -> DataFrame:
    """Documents whose recorded looks (document, page, turn) aren't those that the plan reaches, in its order."""
    want = planned.where("reached").select(document, page, "turn")
    return recorded.select(document, page, "turn").exceptAll(want).union(want.exceptAll(recorded.select(document, page, "turn"))).select(document).distinct()


def round_robin(batches_: DataFrame, key: str, batch: str, capacity: str, target: Column) -> DataFrame:
    """target dealt over the batches one by one, in order, round after round, up to each one's capacity."""
    rounds = batches_.withColumn("target", target).select(key, batch, "target", F.explode(F.sequence(F.lit(1), F.col(capacity).cast("int"))).alias("round"))
    dealt = rounds.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("round", batch)))
    return dealt.where("n <= target").groupBy(key, batch).agg(F.count("*").alias("allotted"))


def _pairs(most: int, evidence: int):
    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_:
            keys, left, right = [], [], []
            for key, rows in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                free, made = [(x["p"], frozenset(x["ids"])) for x in rows], 0
                while free and made < most:
                    place, ids = free.pop(0)
                    other = next((i for i, (_, more) in enumerate(free) if len(ids | more) <= evidence), None)
                    if other is not None:
                        keys.append(key)
                        left.append(place)
                        right.append(free.pop(other)[0])
                        made += 1
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.column(0).type), pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["key", "a", "b"])

    return run


def pairs(candidates: DataFrame, key: str, order: str, ids: str, most: int, evidence: int) -> DataFrame:
    """Candidates paired one after the other, each with the first later one that is free and with which it has few enough ids in all."""
    g = candidates.groupBy(F.col(key).alias("key")).agg(F.sort_array(F.collect_list(F.struct(F.col(order).cast("long").alias("p"), F.col(ids).alias("ids")))).alias("x"))
    return g.mapInArrow(_pairs(most, evidence), f"key {dict(g.dtypes)['key']}, a long, b long").withColumnRenamed("key", key)


def local_ids(rows: DataFrame, request: str, order: str, durable: str, prefix: str = "k") -> DataFrame:
    """Short ids k1 to kn within a request, beside the durable ones."""
    return rows.withColumn("local_id", F.concat(F.lit(prefix), F.row_number().over(Window.partitionBy(request).orderBy(order)).cast("string"))).select(request, "local_id", durable)


def answered(responses: DataFrame, request: str, body: str, ids: DataFrame, durable: str, wanted: Column) -> DataFrame:
    """The durable ids of each response's claim_ids, in order; null, with a code, unless it has as many as wanted, each once and each known."""
    parsed = responses.withColumn("claim_ids", F.from_json(body, "claim_ids array<string>")["claim_ids"]).withColumn("wanted", wanted)
    rows = parsed.select(request, F.posexplode("claim_ids").alias("i", "local_id")).join(ids, [request, "local_id"], "left")
    back = rows.groupBy(request).agg(F.sort_array(F.collect_list(F.struct("i", durable))).alias("x"), F.count_if(F.col(durable).isNull()).alias("unknown"))
    met = parsed.join(back, request, "left")
    n = F.size("claim_ids")
    code = F.when(F.col("claim_ids").isNull(), "INVALID_JSON").when((n != F.col("wanted")) | (F.size(F.array_distinct("claim_ids")) != n), "INVALID_COUNT").when(F.col("unknown") > 0, "UNKNOWN_ID")
    return met.select(request, code.alias("code"), F.when(code.isNull(), F.transform("x", lambda r: r[durable])).alias(durable))


def key_points_valid(claims: DataFrame, chosen: DataFrame, document: str, target: int = TARGET_POINTS) -> DataFrame:
    """Whether each document's chosen claims may stand: all of them in order if they are few, else `target` different known ones, or none with a warning.

    claims: document, place, claim_id; chosen: document, claim_ids, warned.
    """
    g = claims.groupBy(document).agg(F.sort_array(F.collect_list(F.struct("place", "claim_id"))).alias("x")).select(document, F.col("x.claim_id").alias("all_ids"))
    met = g.join(chosen, document, "left")
    ids, few = F.coalesce("claim_ids", F.array().cast("array<string>")), F.size("all_ids") <= target
    several = (F.size(ids) == target) & (F.size(F.array_distinct(ids)) == target) & (F.size(F.array_except(ids, F.col("all_ids"))) == 0) & ~F.col("warned")
    return met.select(document, F.coalesce(F.when(few, (ids == F.col("all_ids")) & ~F.col("warned")).otherwise(several | ((F.size(ids) == 0) & F.col("warned"))), F.lit(False)).alias("valid"))


def assignments_valid(responses: DataFrame, key: str, body: str, n_evidence: Column, least: int, most: int, each: int) -> DataFrame:
    """Whether claims and integer assignments fit: as many claims as allowed, one assignment for each piece of evidence, each to a claim, and no claim without or with too many."""
    parsed = responses.withColumn("r", F.from_json(body, "claims array<struct<text:string>>, assignments array<int>")).withColumn("n", n_evidence)
    n = F.size("r.claims")
    held = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.size(F.filter("r.assignments", lambda a: a == i)))
    fits = n.between(least, most) & (F.size("r.assignments") == F.col("n")) & F.forall("r.assignments", lambda a: a.between(0, n - 1)) & F.forall(held, lambda x: x.between(1, each))
    return parsed.select(key, F.coalesce(fits, F.lit(False)).alias("valid"))


def reductions_valid(responses: DataFrame, key: str, body: str, n_candidates: Column) -> DataFrame:
    """Whether a reduction has two inputs and one output."""
    return responses.select(key, F.coalesce((F.size(F.from_json(body, "claims array<struct<text:string>>")["claims"]) == 1) & (n_candidates == 2), F.lit(False)).alias("valid"))


def lengths_valid(responses: DataFrame, key: str, body: str, most: Column) -> DataFrame:
    """Whether no unit of a response is longer than admitted."""
    units = F.from_json(body, "units array<struct<text:string>>")["units"]
    return responses.select(key, F.coalesce(~F.exists(units, lambda u: F.length(u["text"]) > most), F.lit(False)).alias("valid"))
