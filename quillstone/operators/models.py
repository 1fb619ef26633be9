"""Steps that ask a model: pages to claims, key points by rounds, claims merged pair by pair, one repair, and checks of what was cut.

A model is anything with these methods over DataFrames, so that a batch of requests is one distributed pass. FirstModel answers
from the requests themselves: it makes plans, budgets and warnings testable, and infers nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators import contracts, ordered, planning
from quillstone.operators.rounds import settle

CHUNK, CLAIM, CANDIDATES, TARGET, REQUESTS = 12_000, 384, 16, 8, 256
MAX_DECODER_STRING = 512


class Model(Protocol):
    """select: of the rows (document_id, batch, place, claim_id, quota) those chosen, `quota` for each batch.
    paraphrase: rows with claim, a text for `quote`, or null where the page should be left out.
    merge: rows with claim, one text for `left` and `right`."""

    def select(self, rows: DataFrame) -> DataFrame: ...

    def paraphrase(self, rows: DataFrame) -> DataFrame: ...

    def merge(self, rows: DataFrame) -> DataFrame: ...


class FirstModel:
    """The first candidates, the first sentence of a quote, the left one of two claims."""

    def select(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("i", F.row_number().over(Window.partitionBy("document_id", "batch").orderBy("place"))).where("i <= quota").drop("i")

    def paraphrase(self, rows: DataFrame) -> DataFrame:
        first = F.regexp_extract("quote", "(?s)^(.*?[\\p{L}\\p{N}][.!?])(?:\\s|$)", 1)
        return rows.withColumn("claim", F.when(~T.heading_admitted(F.col("quote")), F.when(first != "", first).otherwise(F.col("quote"))))

    def merge(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("claim", F.col("left"))


def page_scopes(pages: DataFrame, chunks: DataFrame, most: int = CHUNK) -> DataFrame:
    """document_id, page_number, ordinal (the chunk that holds all of the page's blocks) and code: NO_CHUNK, CHUNK_TOO_LARGE or null.
    pages: document_id, page_number, block_id; chunks as made by structure.chunks()."""
    held = chunks.select("document_id", "ordinal", F.length("text").alias("n"), F.explode("block_ids").alias("block_id"))
    met = pages.join(held, ["document_id", "block_id"], "left")
    g = met.groupBy("document_id", "page_number").agg(F.count("*").alias("blocks"), F.countDistinct("ordinal").alias("chunks"), F.count("ordinal").alias("found"), F.min("ordinal").alias("ordinal"), F.max("n").alias("n"))
    whole = (F.col("chunks") == 1) & (F.col("found") == F.col("blocks"))
    return g.select("document_id", "page_number", F.when(whole, F.col("ordinal")).alias("ordinal"), F.when(~whole, "NO_CHUNK").when(F.col("n") > most, "CHUNK_TOO_LARGE").alias("code"))


def page_outcomes(pages: DataFrame, model: Model) -> DataFrame:
    """document_id, page_number, outcome, origin, quote, claim and omitted for pages (document_id, page_number, text).

    omitted: a stamp, noise, a heading that the model would leave out, or a page without a quotable unit (technical). retained:
    a quote with its claim. rejected: a claim that is no complete sentence, or too long. Only retained pages count for coverage.
    """
    quoted = contracts.quotes(pages.select(F.struct("document_id", "page_number").alias("page"), "text"), "page", "text")
    rows = quoted.select("page.*", "segments", "omitted").join(pages, ["document_id", "page_number"])
    rows = rows.withColumns({"origin": T.page_class(F.col("text")), "quote": F.get("segments", F.lit(0))})
    told = model.paraphrase(rows)
    may_go = T.heading_admitted(F.col("text")) & ~T.material_marker(F.col("text"))
    outcome = (
        F.when(F.col("origin").isNotNull(), "omitted").when(F.col("quote").isNull(), "technical").when(F.col("claim").isNull() & may_go, "omitted").when(F.col("claim").isNull(), "rejected")
        .when(F.size(T.paraphrase_violations(F.col("claim"))) > 0, "rejected").otherwise("retained")
    )
    told = told.withColumn("outcome", outcome)
    origin = F.when(F.col("outcome") == "omitted", F.coalesce("origin", F.lit("bare_heading")))
    return told.select("document_id", "page_number", "outcome", origin.alias("origin"), F.when(F.col("outcome") == "retained", F.col("quote")).alias("quote"), F.when(F.col("outcome") == "retained", F.col("claim")).alias("claim"), "omitted")


def key_points(claims: DataFrame, model: Model, limit: int, target: int = TARGET, most: int = CANDIDATES) -> DataFrame:
    """Each document's key points (document_id, place, claim_id): all claims if they are few, else those left after rounds in
    which the model chooses from batches. claims: document_id, place, claim_id, size (characters). Every round handles all
    documents at once; a round's batches are at most a sixteenth of its candidates, so there are few rounds."""
    # A claim larger than a request has one of its own.
    left, done = claims.select("document_id", "place", "claim_id", F.least("size", F.lit(limit)).alias("size")), None
    while True:
        left = settle(left.withColumn("n", F.count("*").over(Window.partitionBy("document_id"))))
        few = left.where(F.col("n") <= target).select("document_id", "place", "claim_id")
        done = few if done is None else done.union(few)
        left = left.where(F.col("n") > target).drop("n")
        if left.isEmpty():
            return done
        planned = left.join(planning.batches(left, "document_id", "place", "size", most, limit), ["document_id", "place"])
        sizes = planned.groupBy("document_id", "batch").agg(F.count("*").alias("n"))
        quotas = ordered.quotas(sizes, "document_id", "batch", "n", target)
        left = model.select(planned.join(quotas.select("document_id", "batch", "quota"), ["document_id", "batch"])).select("document_id", "place", "claim_id", "size")


def merged(claims: DataFrame, model: Model, maximum: int, evidence: int) -> DataFrame:
    """Claims (document_id, place, text, ids) merged pair by pair, the first that fit, until a document has `maximum`; a document
    with nothing left to pair keeps more. Each round merges at most half of the claims."""
    while True:
        claims = settle(claims)
        n = claims.groupBy("document_id").agg(F.count("*").alias("n")).where(F.col("n") > maximum)
        over = claims.join(n, "document_id")
        found = planning.pairs(over, "document_id", "place", "ids", 1 << 30, evidence)
        w = Window.partitionBy("document_id").orderBy("a")
        pairs = found.withColumn("i", F.row_number().over(w)).join(n, "document_id").where(F.col("i") <= F.col("n") - maximum)
        side = lambda c: claims.select("document_id", F.col("place").alias(c), F.col("text").alias("left" if c == "a" else "right"), F.col("ids").alias(f"{c}_ids"))
        both = settle(model.merge(pairs.join(side("a"), ["document_id", "a"]).join(side("b"), ["document_id", "b"])))
        if both.isEmpty():
            return claims
        made = both.select("document_id", F.col("a").alias("place"), F.col("claim").alias("text"), F.array_union("a_ids", "b_ids").alias("ids"))
        used = both.select("document_id", F.explode(F.array("a", "b")).alias("place"))
        claims = claims.join(used, ["document_id", "place"], "left_anti").unionByName(made)


def repaired(first: DataFrame, second: DataFrame, key: str, required: Column, used: Column) -> DataFrame:
    """The answer that counts of at most two: the second one only where the first left out required ids. first, second: key, ids.
    required: the ids asked for; used: requests made before. code: PLAN_TOO_LARGE, MISSING_REFERENCES or null."""
    met = first.withColumn("missing", F.array_except(required, F.coalesce("ids", F.array().cast("array<string>")))).withColumn("wanted", required).withColumn("room", used + 2 <= REQUESTS)
    met = met.join(second.select(key, F.col("ids").alias("again")), key, "left")
    retried = F.size("missing") > 0
    left = F.when(retried, F.array_except("wanted", F.coalesce("again", F.array().cast("array<string>")))).otherwise(F.col("missing"))
    code = F.when(~F.col("room"), "PLAN_TOO_LARGE").when(F.size(left) > 0, "MISSING_REFERENCES")
    return met.select(key, F.when(retried, 2).otherwise(1).alias("attempts"), code.alias("code"), F.when(code.isNull(), F.when(retried, F.col("again")).otherwise(F.col("ids"))).alias("ids"))


def contributions(claims: DataFrame, evidence: DataFrame, contributes: Column) -> DataFrame:
    """Verdicts of claims that were trimmed: supported only if each piece of their evidence still contributes to what is left.
    claims: document_id, claim_id, text, trimmed, evidence_ids, verdict; contributes: a judgement over text and quote."""
    rows = claims.where("trimmed").select("document_id", "claim_id", "text", F.explode("evidence_ids").alias("evidence_id")).join(evidence.select("document_id", "evidence_id", "quote"), ["document_id", "evidence_id"], "left")
    idle = rows.groupBy("document_id", "claim_id").agg(F.bool_and(F.coalesce(contributes, F.lit(False))).alias("all")).where("not all").select("document_id", "claim_id", F.lit(True).alias("idle"))
    met = claims.join(idle, ["document_id", "claim_id"], "left")
    return met.select("document_id", "claim_id", F.when(F.col("idle") & (F.col("verdict") == "supported"), "unsupported").otherwise(F.col("verdict")).alias("verdict"))


def stream_answers(frames: DataFrame, key: str, order: str, frame: str, model_id: str) -> DataFrame:
    """Answers that came as lines of JSON: their content in order, tokens and code. A stream of another model, without a frame
    before its last, or whose last frame isn't the only one that is done, is no answer."""
    schema = "model string, message struct<content:string>, done boolean, prompt_eval_count long, eval_count long"
    rows = frames.select(key, F.struct(F.col(order).alias("at"), F.from_json(frame, schema).alias("f")).alias("x"))
    g = rows.groupBy(key).agg(F.sort_array(F.collect_list("x")).alias("x"))
    last = F.element_at("x", -1)["f"]
    told = F.filter("x", lambda r: F.coalesce(r["f"]["done"], F.lit(False)))
    whole = F.forall("x", lambda r: F.coalesce(r["f"]["message"]["content"].isNotNull() & r["f"]["done"].isNotNull(), F.lit(False)))
    same = F.forall("x", lambda r: F.coalesce(r["f"]["model"] == model_id, F.lit(False)))
    code = F.when(~whole, "INVALID_FRAME").when(~same, "MODEL_CHANGED").when((F.size(told) != 1) | ~last["done"], "NOT_DONE").when(F.size("x") < 2, "UNVERIFIED")
    return g.select(key, code.alias("code"), F.when(code.isNull(), F.array_join(F.transform("x", lambda r: r["f"]["message"]["content"]), "")).alias("content"), F.when(code.isNull(), last["prompt_eval_count"] + last["eval_count"]).alias("tokens"))


def decoder_schema(schema):
    """A JSON schema without what decoders can't keep: uniqueItems, and string limits that grammars can't hold. A copy."""
    if not isinstance(schema, dict):
        return schema
    named, single, listed = ("properties", "patternProperties", "$defs", "definitions"), ("items", "contains", "additionalProperties", "propertyNames", "not", "if", "then", "else"), ("prefixItems", "allOf", "anyOf", "oneOf")
    out = {}
    for k, v in schema.items():
        if k == "uniqueItems" or k == "maxLength" and isinstance(v, int) and v > MAX_DECODER_STRING:
            continue
        if k in named and isinstance(v, dict):
            out[k] = {name: decoder_schema(child) for name, child in v.items()}
        elif k in single:
            out[k] = decoder_schema(v)
        elif k in listed and isinstance(v, list):
            out[k] = [decoder_schema(child) for child in v]
        else:
            out[k] = v
    return out


def token_counts(texts: DataFrame, key: str, text: str, vocabulary: str) -> DataFrame:
    """key and n_tokens by a pinned vocabulary: a tokenizers file that every executor can open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(e.ids) for e in tokenizer.encode_batch([t or "" for t in part.column(1).to_pylist()], add_special_tokens=False)], pa.int64())], ["key", "n_tokens"])

    kind = dict(texts.dtypes)[key]
    return texts.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {kind}, n_tokens long").withColumnRenamed("key", key)


def conservative_tokens(text: Column) -> Column:
    """A bound that needs no vocabulary: a token for each byte."""
    return F.octet_length(text).cast("long")


def job_code(most_bytes: int, media: tuple[str, ...], versions: tuple[str, ...] = ("2",), capabilities: tuple[str, ...] = ("summarize",), empty: bool = False) -> Column:
    """The first rule that a job breaks at the boundary, or null. Columns: job_id, protocol, capability, inputs (array of
    artifact_id, media_type, byte_size, sha256, name, app)."""
    one = F.get("inputs", F.lit(0))
    name, size = one["name"], one["byte_size"]
    fits = T.uuid4(one["artifact_id"]) & one["media_type"].isin(*media) & (size <= most_bytes) & (F.lit(empty) | (size > 0)) & T.digest(one["sha256"]) & T.valid_filename(name) & F.lower(name).endswith(".pdf") & one["app"].rlike("^[a-z0-9][a-z0-9._-]{0,63}$")
    broken = lambda ok: ~F.coalesce(ok, F.lit(False))
    return (
        F.when(broken(F.col("protocol").isin(*versions)), "PROTOCOL_UNSUPPORTED").when(broken(T.uuid4(F.col("job_id"))), "JOB_ID_INVALID").when(broken(F.col("capability").isin(*capabilities)), "CAPABILITY_UNSUPPORTED")
        .when(F.size("inputs") != 1, "INPUT_COUNT_INVALID").when(broken(fits), "INPUT_INVALID")
    )
