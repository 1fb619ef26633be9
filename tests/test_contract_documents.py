"""Contracts read document by document: one shuffle, and the same clauses, terms and texts as by the tables of lines and records."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstone.functions import clauses as C
from quillstone.operators import contracts
from quillstone.plans import catalog

WORDS = "the of Section SECTION ARTICLE Article article Exhibit § 1 2 1.1 1.2. IV. X. I 12) a. B) - : . ... ; Term and Termination INSURANCE Fees & Payment parties between buyer agrees shall È ß 2024 TABLE OF CONTENTS contents (a)".split()
BLANKS = [" ", " ", " ", "  ", "\t", " ", " ", "\x1c"]


def some_line(r):
    made = "".join(r.choice(WORDS) + r.choice(BLANKS) for _ in range(r.randint(1, 7)))
    return made if r.random() < 0.7 else made.strip() + r.choice([".", ":", ";", ""])


def some_documents(n=120):
    r = random.Random(7)
    fixed = ["This agreement is made between A and B.", "ARTICLE 1 - MAIN TERMS", "1. Term and Termination", "1.1 Insurance", "1.1.1 Fees & Payment", "2. Parties", "The buyer agrees to pay.", "", " ", "1.2 Insurance. It is kept.", "Scope of Work"]
    begin = lambda *at: fixed[:2] if at == (0, 1, 0) else []
    return [(f"d{k}", page, block, "\n".join(begin(k % 2, page, block) + [r.choice(fixed) if r.random() < 0.7 else some_line(r) for _ in range(r.randint(0, 9))])) for k in range(n) for page in range(1, r.randint(2, 4)) for block in range(r.randint(1, 2))]


def blocks_of(spark, rows):
    return spark.createDataFrame(rows, "document_id string, page_number int, block_index int, text string").withColumn("block_id", F.concat_ws("-", *["document_id", "page_number", "block_index"]))


def shuffles(spark, name):
    df = catalog.queries()[name](spark, "/root/testdata/sf0.001")
    rows, plan = df.collect(), df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return rows and (plan.count("Exchange hashpartitioning"), plan.count("Join"), plan.count("MapInArrow"))


def test_key_terms_shuffle_once(spark):
    assert shuffles(spark, "contract_key_terms") == (1, 0, 1)


def test_renderings_shuffle_once(spark):
    assert shuffles(spark, "contract_renderings") == (1, 0, 1)


def test_documents_run_through_batches():
    """A document whose blocks lie in several batches is one, and a slice's last document isn't lost."""
    rows = [("a", 1, "1. Insurance"), ("a", 1, "It is kept."), ("b", 1, "1. Parties"), ("b", 2, "A and B."), ("b", 3, "2. Scope"), ("c", 1, "")]
    schema = pa.schema([("document_id", pa.string()), ("page_number", pa.int32()), ("text", pa.string())])
    for cuts in ([6], [1, 5], [3, 3], [4, 1, 1], [1] * 6):
        for most in (1, 2, 100):
            left = iter(rows)
            batches = [pa.RecordBatch.from_pylist([dict(zip(schema.names, next(left))) for _ in range(n)], schema) for n in cuts]
            found = [x for group in contracts._by_document(iter([batches[0].slice(0, 0), *batches]), most) for x in group]
            assert found == [("a", [(1, "1. Insurance", None), (1, "It is kept.", None)]), ("b", [(1, "1. Parties", None), (2, "A and B.", None), (3, "2. Scope", None)]), ("c", [(1, "", None)])]


def test_shapes_told_at_once_are_the_full_ones():
    r = random.Random(3)
    for text in [*(some_line(r) for _ in range(20000)), *(f"{a} {b} {c} {d}" for a in WORDS for b in ("of", "agrees", "The", "5") for c in ("to", "made", "X") for d in ("part 5.", "Scope", "...", "x 7"))]:
        assert C.shape(text, 3) == C.shape(text, 3) == C.full_shape(text, 3), text


def test_heading_terms_of_both_kinds_agree(spark):
    r = random.Random(5)
    parts = [*(a for names in C.TERMS.values() for a in names), "Bonds", "performance bonds", "", " ", "TERM", "Kind", " fees"]
    headings = ["".join(r.choice(parts) + r.choice([", ", " and ", " & ", ";", " or ", "  ", "\t", ""]) for _ in range(r.randint(1, 3))) for _ in range(1500)]
    got = spark.createDataFrame([(h,) for h in headings], "h string").select("h", contracts.heading_terms(F.col("h")).alias("t")).collect()
    assert [tuple(x["t"]) for x in got] == [C.heading_terms(x["h"]) for x in got] and sum(map(bool, (x["t"] for x in got))) > 300


def plain_terms(found, texts):
    """Term by term over all sections at once."""
    above = []
    for c in found:
        above.append(set() if c.parent is None else above[c.parent] | {c.parent})
    section = {}
    for root in range(len(found)):
        below = [k for k in range(len(found)) if k == root or root in above[k]]
        section[root] = [k for i, k in enumerate(below) if k == root + i]
    got = []
    for term in C.TERMS:
        named = [k for k, c in enumerate(found) if any(term in C.heading_terms(h) for h in c.headings)]
        doubt = any(found[m].uncertain for k in named for m in section[k])
        whole = [k for k in named if not any(found[m].uncertain for m in section[k]) and not (found[k].heading_only and len(section[k]) == 1)]
        outer = [k for k in whole if not any(j < k <= section[j][-1] for j in whole)]
        rows = [(term, "heading", k, section[k]) for k in outer]
        others = [c for c in found if not c.opening]
        if term == "Parties" and not rows and found and found[0].opening and not found[0].uncertain and others and (others[0].article == 1 or others[0].number == ("1",)):
            rows = [(term, "opening_between", 0, [0])] if "between" in texts[0].lower().replace(".", " ").split() else []
        got += [] if doubt else rows
    return got


@pytest.mark.parametrize("cut", [False, True])
def test_documents_equal_the_records(spark, cut):
    rows = some_documents()
    blocks = blocks_of(spark, [*rows, (None, 1, 0, "1. Insurance\nx"), ("empty", 1, 0, " \n"), ("null", 1, 0, None)])
    kept = blocks.where("page_number < 3 or block_index = 0").select(*contracts.BLOCK, F.explode(F.expr("array(named_struct('start', 0, 'end', 60), named_struct('start', 90, 'end', 100000))")).alias("r")).select(*contracts.BLOCK, "r.*") if cut else None
    lines = contracts.source_lines(blocks, kept)
    told = contracts.records(contracts.clauses(lines), lines, blocks)[0].collect()
    by = {}
    for x in sorted(told, key=lambda x: x["ordinal"]):
        by.setdefault(x["document_id"], []).append(x)
    read = {d: C.contract([(x["page_number"], x["text"], None if kept is None else x["kept"]) for x in sorted(group, key=lambda x: (x["page_number"], x["block_index"]))]) for d, group in _groups(blocks, kept).items() if d in by}
    assert {d: [x["text"] for x in rows] for d, rows in by.items()} == {d: texts for d, (_, texts) in read.items()} and len(by) > 100
    want = sorted((d, *x) for d, r in read.items() for x in plain_terms(*r))
    assert sorted(map(tuple, contracts.key_terms(blocks, kept).collect())) == want and {x[2] for x in want} == {"heading", "opening_between"}
    shown = {r["document_id"]: r["text"] for r in contracts.render(blocks, kept).collect()}
    assert shown.keys() == by.keys()
    for d, records in by.items():
        line = [f"{x['clause_id']}\n{x['text']}" for x in records]
        held = {t: [line[k] for x in want if x[:2] == (d, t) for k in x[4]] for t in C.TERMS}
        said = [f"{t}\n\n" + "\n\n".join(held[t]) if held[t] else f"{t}: not identified" for t in C.TERMS]
        assert shown[d] == "\n\n".join(["Key terms", *said, "Full clause list", *line])


def _groups(blocks, kept):
    rows, ranges = blocks.where("document_id is not null").collect(), {}
    for r in kept.collect() if kept is not None else ():
        ranges.setdefault((r["document_id"], r["page_number"], r["block_index"]), []).append((r["start"], r["end"]))
    found = {}
    for x in rows:
        at = x["document_id"], x["page_number"], x["block_index"]
        if kept is None or at in ranges:
            found.setdefault(x["document_id"], []).append({**x.asDict(), "kept": ranges.get(at)})
    return found
