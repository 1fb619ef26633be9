"""Rows without ids or with repeated ones, long and odd texts, clashing columns, and the models against plain versions."""

import math
import random
import re
import unicodedata
import zlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quillstone.llm import bpe, chat, class_lm, cotrain, decontaminate, recompress, rules, tagpath, tensor_minhash, token_counts

R = random.Random(17)
WORDS = [a + b for a in "bdfgklmnprst" for b in ("a", "e", "in", "or", "um")]


def some(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


LONG = some(30_000)
A, B = some(60), some(60)
ROWS = [(1, A), (1, B), (None, A), (None, B + " end"), (2, None), (None, None), (3, ""), (1, A), (4, LONG), (5, "x" * 200_000), (6, "é" * 1000 + " ΑΣ 日本")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, rep string, ka string, h string, k string, piece string, hits string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", "s", 1, "r", "r", "k", "h", "k", "p", "h") for i, t in ROWS], SCHEMA).repartition(3)


def counted(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_bpe_and_counts_go_by_row(odd):
    from tokenizers import Tokenizer

    for name, run in (("word_bpe_49k.json", bpe.encode_documents), ("byte_bpe_50k.json", token_counts.count_tokens)):
        path = public_tokenizers.path(name)
        library = Tokenizer.from_file(path)
        want = Counter((i, len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in ROWS)
        assert counted(run(odd, path), "doc_id", "n_tokens") == want


@pytest.mark.parametrize("listed", [0, 7])
def test_counts_dont_depend_on_the_list(odd, listed):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert counted(token_counts.count_tokens(odd, path, listed=listed), "doc_id", "n_tokens") == counted(token_counts.count_tokens(odd, path), "doc_id", "n_tokens")


def test_bpe_over_all_code_points():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    own, library = bpe.PrefixBpe(path), Tokenizer.from_file(path)
    texts = [f"ab{chr(c)}cd" for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    wrong = []
    for lo in range(0, len(texts), 50_000):
        part = texts[lo : lo + 50_000]
        wrong += [t for t, e in zip(part, library.encode_batch(part, add_special_tokens=False)) if own.encode(t) != e.ids]
    assert wrong == []


def test_near_duplicates_link_rows(odd):
    got = counted(tensor_minhash.near_duplicates(odd, size=4), "doc_id", "component_id", "kept")
    # Three rows hold A, two of them under 1; of those with B one has no id. Rows without words keep their own id.
    assert got[1, 1, True] == 3 and got[None, 1, False] == 2 and got[2, 2, True] == 1 and got[None, None, True] == 1 and got[3, 3, True] == 1 and sum(got.values()) == len(ROWS)


def test_near_duplicates_without_any_id(spark):
    rows = tensor_minhash.near_duplicates(spark.createDataFrame([(None, A), (None, A), (None, B)], "doc_id long, text string")).collect()
    assert [(r["component_id"], r["kept"]) for r in rows] == [(None, True)] * 3


def test_substrings_go_by_row(odd):
    texts = [words(t) for _, t in ROWS]
    seen = Counter(tuple(w[j : j + 35]) for w in texts for j in range(len(w) - 34))
    want = Counter()
    for (i, _), w in zip(ROWS, texts):
        gone = {j + d for j in range(len(w) - 34) if seen[tuple(w[j : j + 35])] > 1 for d in range(35)}
        want[i, len(w), len(gone)] += 1
    assert counted(recompress.substring_dedup(odd), "doc_id", "n_words", "n_removed") == want


def test_rules_go_by_row(odd):
    got = counted(rules.quality_rules(odd), "doc_id", "n_words", "base_failed")
    assert sum(got.values()) == len(ROWS) and got[None, 0, True] == 1 and got[5, 1, True] == 1


def test_decontamination_of_long_texts(spark, odd):
    bench = spark.createDataFrame([("a", " ".join(LONG.split()[20_000:20_014])), ("b", "x" * 200_000), ("c", "end")], "item_id string, text string")
    one, two = (counted(decontaminate.decontaminate(odd, bench, local_windows=n), "doc_id", "n_words", "n_hit", "n_items") for n in (decontaminate.LOCAL_WINDOWS, 0))
    assert one == two and one[5, 1, 1, 1] == 1 and one[None, 61, 1, 1] == 1 and sum(v for k, v in one.items() if k[0] == 4 and k[2] >= 14) == 1


def test_classifier_with_clashing_columns_and_repeated_labelled_rows(spark):
    rows = [(i % 150, some(40) + ("%%%" * 20 if i % 150 < 40 else ""), "en", "s", 100, "t", "m", 1.0) for i in range(450)]
    docs = spark.createDataFrame(rows + [(None, None, None, None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long, t string, m string, quality double")
    labels = spark.createDataFrame([(i, int(i >= 40), 0, "x") for i in range(120)], "doc_id long, quality int, toxic int, text string")
    assert cotrain.classify(docs, labels).count() == 451
    spark.sparkContext.setJobGroup("fetch", "fetch")
    models = cotrain.fit(docs, labels, labelled=50)  # one row for each of the 50 labelled ids, though each stands three times
    assert models["poor"] is not None and models["toxic"] is None


def test_html_without_ids(spark):
    rows = spark.createDataFrame([(None, None, "<p>One, two. Three.</p>", 1), (7, "u", "<p>One, two. Three.</p>", 1), (7, "u", "<p>One, two. Three.</p>", 1), (8, "u", "&amp;" * 50_000, 1)], "page_id long, url string, html string, n_chars int")
    got = counted(tagpath.extract_pages(rows), "page_id", "url", "text")
    assert got[None, None, "One, two. Three."] == 1 and got[7, "u", "One, two. Three."] == 2 and got[8, "u", "&" * 50_000] == 1


def test_chat_with_a_long_turn(spark):
    text = "</s>~ " * 20_000
    row = chat.chat_digests(spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")).collect()[0]
    assert row["loss_chars"] == len(text) and row["n_turns"] == 2


# ---- models against plain versions


def lowered(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def f(x):
    return x * math.log(x) if x > 1 else 0.0


def likelihood(pairs, at):
    both, ins, outs = Counter(), Counter(), Counter()
    for (a, b), n in pairs.items():
        both[at[a], at[b]] += n
        outs[at[a]] += n
        ins[at[b]] += n
    return sum(map(f, both.values())) - sum(map(f, ins.values())) - sum(map(f, outs.values()))


def plain_scores(spark, rows, listed, own, classes, mixed=class_lm.MIXED, smooth=class_lm.SMOOTH):
    """The class model with every number counted from the texts, and every move judged by the whole likelihood."""
    end, other = object(), object()
    train = [words(lowered(t)) for i, t in rows if zlib.crc32(str(i).encode()) % 10]
    c = Counter(w for t in train for w in t)
    levels = sorted({math.floor(math.log2(n) * 8) for n in c.values()}, reverse=True)
    taken: list = []
    for k in levels:
        more = [w for w, n in c.items() if math.floor(math.log2(n) * 8) == k]
        if len(taken) + len(more) > listed:
            break
        taken += more
    top = sorted(taken, key=lambda w: (-c[w], w.encode()))
    first = top[:own]
    pairs = Counter()
    for t in train:
        seq = [end, *t, end]
        pairs.update(zip(seq, seq[1:]))
    small = Counter()
    known = set(first)
    for (a, b), n in pairs.items():
        small[a if a is end or a in known else other, b if b is end or b in known else other] += n
    at = {w: i % classes for i, w in enumerate(first)} | {end: classes, other: classes + 1}
    for _ in range(12):
        moved = False
        for w in first:
            if not any(n for (a, b), n in small.items() if w in (a, b) and a != b):
                continue
            value = [likelihood(small, at | {w: k}) for k in range(classes)]
            best = max(range(classes), key=lambda k: (value[k], -k))
            if value[best] > value[at[w]] + 1e-9 and best != at[w]:
                at[w], moved = best, True
        if not moved:
            break
    full = dict(at)
    hashed = {bytes(r.w): r.k for r in spark.createDataFrame([(bytearray(w.encode()),) for w in c], "w binary").select("w", F.pmod(F.xxhash64("w"), F.lit(classes)).alias("k")).collect()} if c else {}
    for w in c:
        if w in at:
            continue
        left, right = Counter(), Counter()
        for (a, b), n in pairs.items():
            if b == w and a in at and a is not other:
                left[at[a]] += n
            if a == w and b in at and b is not other:
                right[at[b]] += n
        if not left and not right:
            full[w] = top.index(w) % classes if w in top else hashed[w.encode()]
            continue
        near = {(a, b): n for (a, b), n in pairs.items() if a is not other and b is not other and (a, b) != (w, w) and (a in at or a == w) and (b in at or b == w)}
        value = [round(likelihood(near, at | {w: k}), 6) for k in range(classes)]
        full[w] = max(range(classes), key=lambda k: (value[k], -k))
    moves = Counter()
    for (a, b), n in pairs.items():
        moves[full[a], full[b]] += n
    size = classes + 2
    into = [sum(moves[a, b] for a in range(size)) for b in range(size)]
    outof = [sum(moves[a, b] for b in range(size)) for a in range(size)]
    share = [(n + 0.5) / (sum(into) + 0.5 * size) for n in into]
    kinds = Counter(full[w] for w in c)
    total = sum(c.values()) + len(train)
    z = total + smooth * (len(c) + (len(train) > 0) + 1)
    out = {}
    for i, t in rows:
        score, last = 0.0, classes
        for w in words(lowered(t)):
            k = full.get(w, classes + 1)
            step = (moves[last, k] + 20 * share[k]) / (outof[last] + 20)
            score += math.log10((c[w] + smooth) * (mixed * step / (into[k] + smooth * (kinds[k] + 1)) + (1 - mixed) / z))
            last = k
        step = (moves[last, classes] + 20 * share[classes]) / (outof[last] + 20)
        out[i] = score + math.log10(mixed * step + (1 - mixed) * (len(train) + smooth) / z)
    return out


@pytest.mark.parametrize("listed, own, classes", [(20, 8, 4), (0, 8, 4), (200, 12, 3)])
def test_class_model_against_a_plain_one(spark, listed, own, classes):
    r = random.Random(3)
    nouns, verbs = ["cat", "dog", "hen", "cow", "pig"], ["eats", "sees", "likes"]
    rows = [(i, " ".join(x for _ in range(r.randint(1, 6)) for x in ("The", r.choice(nouns), r.choice(verbs), f"w{r.randint(0, 40)}"))) for i in range(60)] + [(60, None), (61, "unseen words only")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = plain_scores(spark, rows, listed, own, classes)
    got = {x["doc_id"]: x["score"] for x in class_lm.lm_scores(docs, listed=listed, own=own, classes=classes).collect()}
    assert got == pytest.approx(want)


def test_rules_and_posterior_against_a_plain_version(spark):
    r = random.Random(8)
    texts = []
    for i in range(80):
        w = [r.choice(WORDS) for _ in range(r.randint(30, 120))]
        if i % 7 == 0:
            w = [x + "%|#" for x in w]
        if i % 9 == 0:
            w = [x.upper() + "!" for x in w]
        lines = [" ".join(w[j : j + 10]) for j in range(0, len(w), 10)]
        texts.append("\n".join(lines * (4 if i % 11 == 0 else 1)))
    texts += [None, "", "one"]
    got = {x["doc_id"]: x for x in rules.quality_rules(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    votes = {}
    for i, t in enumerate(texts):
        t = t or ""
        w, lines = words(t), [x for x in t.split("\n") if words(x)]
        n, chars = len(w), sum(map(len, w))
        grams = Counter(zip(w, w[1:], w[2:]))
        again = len({j + d for j, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for d in range(3)})
        symbols, bangs, bars = len(re.findall(r"[#*$%&|<>]", t)), t.count("!"), t.count("|")
        upper, dup = sum(unicodedata.category(x) == "Lu" for x in t), len(lines) - len(set(lines))
        pairs = [  # (poor, fine)
            (symbols * 10 > n, symbols * 200 <= n), (symbols * 20 > chars, symbols * 1000 <= chars), (again * 4 > n, again * 20 <= n), (dup >= 3 and dup * 4 > len(lines), len(lines) >= 2 and dup == 0),
            (bangs * 5 > n, bangs * 200 <= n), (upper * 3 > chars, upper * 6 <= chars), (bars * 8 > n, bars == 0 and n >= 20), (chars < 2 * n or chars > 12 * n, 3 * n <= chars <= 8 * n), (n >= 100 and len(set(w)) * 10 < n, len(set(w)) * 5 >= n and n >= 20),
        ]
        votes[i] = (n, again, [-1 if bad else 1 if good else 0 for bad, good in pairs])
    use = [v for n, _, v in votes.values() if n]
    fine, poor, p = [dict(rules.FINE) for _ in range(9)], [dict(rules.POOR) for _ in range(9)], 0.85
    weight = rules.TRUST * len(use)
    for _ in range(50):
        q = []
        for v in use:
            odds = p / (1 - p) * math.prod(fine[j][x] / poor[j][x] for j, x in enumerate(v))
            q.append(odds / (1 + odds))
        p = (weight * 0.85 + sum(q)) / (weight + len(use))
        for j in range(9):
            up = {x: weight * rules.FINE[x] + sum(b for b, v in zip(q, use) if v[j] == x) for x in (-1, 0, 1)}
            down = {x: weight * rules.POOR[x] + sum(1 - b for b, v in zip(q, use) if v[j] == x) for x in (-1, 0, 1)}
            fine[j], poor[j] = ({x: n / sum(d.values()) for x, n in d.items()} for d in (up, down))
    for i, (n, again, v) in votes.items():
        odds = p / (1 - p) * math.prod(fine[j][x] / poor[j][x] for j, x in enumerate(v))
        assert got[i]["posterior"] == pytest.approx(odds / (1 + odds), abs=1e-6)
        assert got[i]["kept"] == (n >= 50 and 2 * again <= n and got[i]["posterior"] >= 0.5)
    assert {got[i]["kept"] for i in range(80)} == {True, False}
