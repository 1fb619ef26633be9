"""Steps that ask a model, against plain loops; commits and parsers on files."""

import pytest
from pyspark.sql import functions as F

from quillstone.operators import contracts, furniture, models, planning
from quillstone.sources import documents, store


def test_page_outcomes(spark):
    texts = ["03/10/03 A-4", "... --- ***", "Scope of the Work", "It rains today. It may not tomorrow.", "x" * 700, "", "no end here", "Call (703) 696-4959 Now"]
    pages = spark.createDataFrame([("d", i, t) for i, t in enumerate(texts)], "document_id string, page_number long, text string")
    got = {r["page_number"]: (r["outcome"], r["origin"], r["claim"]) for r in models.page_outcomes(pages, models.FirstModel()).collect()}
    assert got == {
        0: ("omitted", "date_page_stamp", None), 1: ("omitted", "scan_noise", None), 2: ("omitted", "bare_heading", None), 3: ("retained", None, "It rains today."), 4: ("technical", None, None), 5: ("technical", None, None),
        6: ("rejected", None, None), 7: ("rejected", None, None),
    }


def plain_points(sizes, limit, target=8, most=16):
    left = list(enumerate(sizes))
    while len(left) > target:
        batches = [[]]
        for c in left:
            if batches[-1] and (len(batches[-1]) == most or sum(n for _, n in batches[-1]) + c[1] > limit):
                batches.append([])
            batches[-1].append(c)
        if len(batches) == 1:
            return [i for i, _ in left[:target]]
        quota = [1] * len(batches)
        while sum(quota) < target:
            best = max((k for k in range(len(batches)) if quota[k] < len(batches[k])), key=lambda k: (len(batches[k]) / (quota[k] + 1), -k))
            quota[best] += 1
        left = [c for b, q in zip(batches, quota) for c in b[:q]]
        if len(left) == target:
            return [i for i, _ in left]
    return [i for i, _ in left]


def test_key_points(spark):
    sizes = {"few": [10] * 5, "one": [10] * 12, "many": [(i * 37) % 90 + 10 for i in range(150)], "wide": [100] * 40}
    rows = [(d, i, f"{d}{i}", n) for d, ns in sizes.items() for i, n in enumerate(ns)]
    got = models.key_points(spark.createDataFrame(rows, "document_id string, place long, claim_id string, size long"), models.FirstModel(), 400).collect()
    for d, ns in sizes.items():
        assert sorted(r["place"] for r in got if r["document_id"] == d) == plain_points(ns, 400), d


def plain_pairs(claims, most, evidence):
    free, out = list(claims), []
    while free and len(out) < most:
        a = free.pop(0)
        b = next((x for x in free if len(a[1] | x[1]) <= evidence), None)
        if b:
            free.remove(b)
            out.append((a[0], b[0]))
    return out


def test_pairs_and_merging(spark):
    ids = {i: {f"e{i % 5}", f"e{(i * 3) % 7}"} for i in range(20)}
    rows = spark.createDataFrame([("d", i, f"t{i}", sorted(s)) for i, s in ids.items()], "document_id string, place long, text string, ids array<string>")
    got = [(r["a"], r["b"]) for r in planning.pairs(rows, "document_id", "place", "ids", 4, 3).orderBy("a").collect()]
    assert got == plain_pairs(list(ids.items()), 4, 3)
    claims = dict(ids)
    while len(claims) > 6:
        pairs = plain_pairs(sorted(claims.items()), 99, 3)[: len(claims) - 6]
        if not pairs:
            break
        for a, b in pairs:
            claims[a] = claims[a] | claims.pop(b)
    left = {r["place"]: set(r["ids"]) for r in models.merged(rows, models.FirstModel(), 6, 3).collect()}
    assert left == claims


def test_decoder_schema():
    schema = {"type": "object", "properties": {"a": {"type": "array", "uniqueItems": True, "items": {"type": "string", "maxLength": 513}}, "b": {"type": "string", "maxLength": 512}}, "anyOf": [{"uniqueItems": True}], "maxLength": "x"}
    want = {"type": "object", "properties": {"a": {"type": "array", "items": {"type": "string"}}, "b": {"type": "string", "maxLength": 512}}, "anyOf": [{}], "maxLength": "x"}
    before = repr(schema)
    assert models.decoder_schema(schema) == want and repr(schema) == before


def test_pinned_token_counts(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    texts = ["one two", "", None, "é日本"]
    got = {r["i"]: r["n_tokens"] for r in models.token_counts(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "i", "t", path).collect()}
    assert got == {i: len(Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_commits_are_whole(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "store"))
    a, b = spark.range(3), spark.createDataFrame([("x",)], "event string")
    assert s.read("runs") is None and s.commit({"runs": a, "events": b}) == 1 and s.commit({"runs": a}, expected=1) == 2
    assert s.read("runs").count() == 6 and s.read("events").count() == 1 and s.read("runs", version=1).count() == 3
    with pytest.raises(store.CommitConflict):
        s.commit({"runs": a}, expected=1)
    with pytest.raises(Exception):
        s.commit({"runs": a, "events": b.select(F.assert_true(F.lit(False)).alias("x"))})  # a failed table leaves nothing to see
    assert s.version() == 2 and s.read("runs").count() == 6


def test_files_from_disk(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "b.pdf").write_bytes(b"nothing")
    (tmp_path / "c.txt").write_bytes(b"%PDF-")
    got = {r["original_filename"]: (r["byte_size"], r["rejected"]) for r in documents.ingest(documents.read_files(spark, str(tmp_path))).collect()}
    assert got == {"a.pdf": (10, None), "b.pdf": (7, "INVALID_PDF_SIGNATURE"), "c.txt": (5, "UNSUPPORTED_EXTENSION")}


def test_footers_of_initials(spark):
    page = "Text of page.\nMore text.\nAcme Agreement page {n} of 3\nInitials ____\nACME BOLT"
    rows = [("d", n, 0, page.format(n=n) if n < 4 else "Only text here.\nACME BOLT") for n in (1, 2, 3, 4)]
    blocks = spark.createDataFrame(rows, "document_id string, page_number long, block_index int, text string")
    kept = {r["page_number"]: (r["start"], r["end"]) for r in furniture.retained(blocks, furniture.furniture(blocks)).collect()}
    assert kept == {1: (0, 25), 2: (0, 25), 3: (0, 25), 4: (0, 25)} and rows[3][3][:25].endswith("ACME BOLT")


def test_source_lines_leave_furniture_out(spark):
    rows = [("d", n, 0, f"Service Agreement page {n} of 9\n  1. Scope of work\nBody {n}.\n") for n in (1, 2, 3)]
    blocks = spark.createDataFrame(rows, "document_id string, page_number long, block_index int, text string").withColumn("block_id", F.concat(F.lit("b"), "page_number"))
    kept = furniture.retained(blocks, furniture.furniture(blocks))
    lines = contracts.source_lines(blocks, kept)
    assert [(r["page_number"], r["line"]) for r in lines.orderBy("place").collect()] == [(n, t) for n in (1, 2, 3) for t in ("1. Scope of work", f"Body {n}.")]
    told, evidence = contracts.records(contracts.clauses(lines), lines, blocks)
    assert [r["text"] for r in told.orderBy("ordinal").collect()] == [f"1. Scope of work\nBody {n}." for n in (1, 2, 3)] and evidence.count() == 3
