"""The pipeline's stages on rows that repeat and share doc_ids: verdicts belong to rows."""

import hashlib
import random
import re

import public_tokenizers
import pytest

import corpus_pipeline
from quillstone.llm import decontaminate

R = random.Random(11)
VOCABULARY = [a + b for a in "bdfgklmnprst" for b in ("a", "e", "in", "or", "um")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
COMMON = [f"c{i}" for i in range(38)]
ITEM = [f"q{i}" for i in range(14)]


def some(n):
    return [R.choice(VOCABULARY) + str(R.randint(0, 9)) for _ in range(n)]


def row(i, words, source="s"):
    text = words if words is None else " ".join(words)
    return i, text, "en", source, None if text is None else len(text)


def repeated():
    a, b, c, d, e = some(60), some(60), some(70), some(50), some(40)
    near = [*a[:30], "x", *a[31:]]
    return [
        row(5, a), row(5, a), row(5, a, "t"), row(3, near), row(9, near),  # repeated rows and near copies of them
        row(7, b), row(7, c), row(7, [*some(20), *ITEM, *some(20)]),  # one doc_id, different texts, one contaminated
        row(8, [*some(25), *COMMON, *some(12)]), row(8, d), row(10, [*some(30), *COMMON, *some(9)]),  # one doc_id, one with a repeated passage
        row(2, e), row(2, e),  # repeated rows alone
        row(11, COMMON[:36]), row(12, None), row(13, []), row(13, []), row(14, ["one"]),
    ]


def write(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))


def stage(spark, tmp_path, number, rows):
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    return [tuple(r) for r in corpus_pipeline.STAGES[number][1](spark, docs, str(tmp_path)).collect()]


def ordered(rows):
    return sorted(rows, key=repr)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def near_duplicates(rows):
    sets = []
    for r in rows:
        w = words((r[1] or "").lower())
        sets.append({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))
    for _ in rows:
        for i, x in enumerate(sets):
            for j, y in enumerate(sets):
                n = len(x & y)
                if n and 100 * n >= 80 * (len(x) + len(y) - n):
                    group[i] = group[j] = min(group[i], group[j])
    best = {}
    for i, r in enumerate(rows):
        best.setdefault(group[i], []).append((r[0] is None, r[0] or 0, i))
    return [rows[min(x)[2]] for x in best.values()]


def substrings(rows, window=35):
    split, seen = [words(r[1]) for r in rows], {}
    for w in split:
        for j in range(len(w) - window + 1):
            seen[tuple(w[j : j + window])] = seen.get(tuple(w[j : j + window]), 0) + 1
    out = []
    for r, w in zip(rows, split):
        gone = {j + d for j in range(len(w) - window + 1) if seen[tuple(w[j : j + window])] > 1 for d in range(window)}
        text = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((r[0], text, r[2], r[3], len(text)) if gone else r)
    return out


def clean(rows):
    item = " ".join(ITEM)
    windows = [" ".join(item.split()[j : j + 10]) for j in range(len(ITEM) - 9)]
    return [r for r in rows if not any(f" {x} " in f" {r[1] or ''} " for x in windows)]


def encoded(rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = [library.encode(r[1] or "", add_special_tokens=False).ids for r in rows]
    return [(r[0], len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(library.decode(x, skip_special_tokens=False).encode()).hexdigest(), x) for r, x in zip(rows, ids)]


BRUTE = [None, near_duplicates, substrings, clean, encoded]


def check(spark, tmp_path, rows):
    write(spark, tmp_path, "benchmark", [("1", " ".join(ITEM))], "item_id string, text string")
    for k in (1, 2, 3, 4):
        want = BRUTE[k](rows)
        assert ordered(stage(spark, tmp_path, k, rows)) == ordered(want), corpus_pipeline.STAGES[k][0]
        rows = want
    return rows


def test_repeated_rows_and_doc_ids(spark, tmp_path):
    left = check(spark, tmp_path, repeated())
    assert sorted(r[0] for r in left) == [2, 3, 7, 7, 8, 8, 10, 11, 12, 13, 13, 14]
    assert all(r[1] > 0 for r in left if r[0] in (2, 3))  # a whole copy of each repeated text stays


@pytest.fixture(scope="module")
def labelled():
    """Rows (doc_id, poor, row) of plain and poor texts."""
    found = []
    for i in range(600):
        poor = i % 5 == 0
        found.append((i, poor, row(i, [w + "%%%" * poor for w in some(60)], f"s{i % 3}")))
    return found


def test_a_rejected_row_goes_whatever_others_share_its_doc_id(spark, tmp_path, labelled):
    write(spark, tmp_path, "labels", [(i, int(not poor), 0) for i, poor, _ in labelled if i < 500], "doc_id long, quality int, toxic int")
    good, bad = row(1000, some(60), "s1"), row(1000, [w + "%%%" for w in some(60)], "s1")
    got = stage(spark, tmp_path, 0, [*[r for *_, r in labelled], good, bad, good])
    assert got.count(good) == 2 and bad not in got


def test_a_null_doc_id_goes_by_its_verdict_in_each_stage(spark, tmp_path):
    a, b = some(60), some(50)
    rows = [row(None, a), row(None, a), row(4, a), row(None, b), row(None, b), row(None, some(45)), row(None, None), row(None, None)]
    rows += [row(None, [*some(20), *ITEM]), row(None, [*some(25), *COMMON]), row(6, [*some(30), *COMMON])]
    left = check(spark, tmp_path, rows)
    assert ordered([r[0] for r in left]) == ordered([4, 6, None, None, None, None, None])


def test_a_null_doc_id_is_classified_like_any_other(spark, tmp_path, labelled):
    write(spark, tmp_path, "labels", [(i, int(not poor), 0) for i, poor, _ in labelled if i < 500], "doc_id long, quality int, toxic int")
    good, bad = row(None, some(60), "s1"), row(None, [w + "%%%" for w in some(60)], "s1")
    got = stage(spark, tmp_path, 0, [*[r for *_, r in labelled], good, bad])
    assert good in got and bad not in got


def test_both_paths_of_decontamination_judge_each_row_by_itself(spark):
    held, other = [*some(9), *ITEM], some(30)
    rows = [row(None, held), row(None, other), row(None, held), row(1, held), row(1, other), row(1, other), row(2, [*held, *ITEM]), row(2, None), row(None, None)]
    docs, bench = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([("1", " ".join(ITEM))], "item_id string, text string")
    one, two = (ordered(map(tuple, decontaminate.decontaminate(docs, bench, local_windows=n, spans=True, carry=("text", "source")).collect())) for n in (decontaminate.LOCAL_WINDOWS, 0))
    assert one == two and len(one) == len(rows)
    hit = [(r[0], r[2]) for r in one if r[5]]
    assert ordered(hit) == ordered([(None, 14), (None, 14), (1, 14), (2, 28)])


def test_every_stage_takes_empty_tables_and_clashing_columns(spark, tmp_path, labelled):
    write(spark, tmp_path, "labels", [(i, int(not poor), 0) for i, poor, _ in labelled if i < 500], "doc_id long, quality int, toxic int")
    write(spark, tmp_path, "benchmark", [("1", " ".join(ITEM))], "item_id string, text string")
    wide = SCHEMA + ", row string, rep string, quality string, t string, hits string, own0 string, kept_text string, component_id string"
    extra = ("x",) * 8
    for name, run in corpus_pipeline.STAGES:
        empty = run(spark, spark.createDataFrame([], wide), str(tmp_path))
        assert empty.count() == 0, name
        full = run(spark, spark.createDataFrame([row(1, some(60)) + extra, row(None, None) + extra, (None,) * 13], wide), str(tmp_path))
        assert full.count() >= 1 and (name == "bpe" or full.columns == list(corpus_pipeline.COLUMNS)), name


def test_without_labels_every_row_stays(spark, tmp_path):
    write(spark, tmp_path, "labels", [], "doc_id long, quality int, toxic int")
    rows = [row(1, some(60)), row(None, None), row(2, ["moron"])]
    assert ordered(stage(spark, tmp_path, 0, rows)) == ordered(rows)
