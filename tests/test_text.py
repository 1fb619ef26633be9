"""Predicates on lines whose outcome is known."""

import pytest
from pyspark.sql import functions as F

from quillstone.functions import text as T

CASES = [
    (lambda: T.phone_marker(F.col("s")), "(703) 696-4959?", True),
    (lambda: T.phone_marker(F.col("s"), question=False), "(703) 696-4959?", False),
    (lambda: T.phone_marker(F.col("s")), "", False),
    (lambda: T.page_class(F.col("s")), "03/10/03  A-4", "date_page_stamp"),
    (lambda: T.page_class(F.col("s")), "... 5l ...", None),
    (lambda: T.page_class(F.col("s")), "... < 5 ...", None),
    (lambda: T.page_class(F.col("s")), "*** 5 ***", "scan_noise"),
    (lambda: T.page_class(F.col("s")), "... 5 ...", None),  # digits and number marks alone are kept
    (lambda: T.page_class(F.col("s")), "  ", None),
    (lambda: T.complete(F.col("s")), "Costs rose 5 %.", True),
    (lambda: T.complete(F.col("s")), "Costs rose.\\n", False),
    (lambda: T.complete(F.col("s")), "and then…", False),
    (lambda: T.page_number(F.col("s"), F.lit(3)), "Page 3 of 2", False),
    (lambda: T.page_number(F.col("s"), F.lit(3)), "3 / 3", True),
    (lambda: T.running_label(F.col("s"), F.lit(1)), "SUBSTANTIAL COMPLETION", False),
    (lambda: T.running_label(F.col("s"), F.lit(1)), "SERVICE AGREEMENT", True),
    (lambda: T.date_label(F.col("s")), "monday, may 31, 2021", True),
    (lambda: T.date_label(F.col("s")), "may 32 2021", False),
    (lambda: T.label_value(F.col("s")), "(2) Name: x", None),
    (lambda: T.label_value(F.col("s")), "Unit 2: x", " x"),
    (lambda: T.clause_title(F.col("s")), "Term and Termination.", True),
    (lambda: T.clause_title(F.col("s")), "Term and termination", False),
    (lambda: T.negation(F.col("s")), "not only", False),
    (lambda: T.negation(F.col("s")), "They don't", True),
    (lambda: T.clipped(F.col("s"), 3), "abc", True),
    (lambda: T.clipped(F.col("s"), 3), "ab.", False),
]


@pytest.mark.parametrize("i", range(len(CASES)))
def test_known(spark, i):
    found, line, want = CASES[i]
    got = spark.createDataFrame([(line,), (None,)], "s string").select(found().alias("x")).collect()
    assert got[0].x == want
    assert got[1].x in (None, False)  # a null line satisfies nothing


#: What identifiers look like, on both sides of each limit.
MARKERS = [
    (T.email_marker, ["a.b_c%d+e-f@x-y.co", "(x@y.z)", "Luz.Ortiz@WHS.MIL."], ["a$b=c@x.com", "née@x.com", "x@y.c-d", "x@y", "@y.com", "x@y@z.com", "not-an-email@"]),
    (T.reference_marker, ["A-123", "A-" + "1" * 62, "NC1-330-78-7?", "ab/12."], ["A-12", "A-" + "1" * 63, "a1:2/(x", "ab1$2/é", "1A-234", "ABC-1", "02/25/20Q8"]),
    (T.numeric_date_marker, ["1-2-03", "5/19/08.", "(1/2/2003)"], ["1/2-03", "5/19", "1.2.2003", "12345/1/1", "1/2/3/4"]),
    (T.named_date_marker, ["May 28, 2008", "MAY 1 08.", "in (June) 3. 1999!"], ["May 2008", "Mayo 28 2008", "May 281 2008", "May 28 200"]),
    (T.phone_marker, ["123-4567", "+123456789012345", "Call 703-696-4959.", "(703) 696-4959?"], ["12-3456", "+1234567890123456", "Call (70) 69-49.", "1234567", "Question?"]),
]


@pytest.mark.parametrize("i", range(len(MARKERS)))
def test_markers(spark, i):
    found, yes, no = MARKERS[i]
    rows = [(s, True) for s in yes] + [(s, False) for s in no] + [(f"before {s} after", True) for s in yes]
    got = spark.createDataFrame(rows, "s string, want boolean").select("s", "want", found(F.col("s")).alias("x")).collect()
    assert [r.s for r in got if r.x != r.want] == []
