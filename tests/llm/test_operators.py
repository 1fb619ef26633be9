"""Operators against brute force on small tables with nulls, empty texts, ties, repeats and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest

from quillstone.llm import bpe, chat, class_lm, cotrain, decontaminate, recompress, rules, tagpath, tensor_minhash, token_counts

R = random.Random(5)
VOCABULARY = [c + v for c in "bdfgklmnprst" for v in "aeiou"] + ["Zoë", "naïve", "the", "THE", "x|y", "a%%%", "ß!"]


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def make():
    texts = [None, "", " \n\t", "one", "Two words"]
    base = [" ".join(R.choice(VOCABULARY) for _ in range(R.randint(30, 120))) for _ in range(6)]
    for i in range(40):
        words = (R.choice(base) + " " + " ".join(R.choice(VOCABULARY) for _ in range(R.randint(0, 30)))).split()
        for _ in range(R.randint(0, 3)):
            words[R.randrange(len(words))] = R.choice(VOCABULARY)
        texts.append("\n".join(" ".join(words[j : j + 11]) for j in range(0, len(words), 11)))
    texts += [base[0], base[0], "rewh " * 300, "a b " * 100, "<|endoftext|> hi <|startoftext|>", "ΑΣ é́ 日本 <|endoftext|>"]
    return list(enumerate(texts))


ROWS = make()


@pytest.fixture(scope="module")
def docs(spark):
    # Columns that clash with names inside the operators.
    rows = [(i, t, "x", "n", 1, "k", "h") for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, rep string, n string, g int, k string, words string").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def lowered(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def test_chat(spark):
    rows = [(1, 1, "assistant", "</s> <~s>[INST]", 0), (1, 0, "user", "<s>~<~~/s>[~/SYS] ok", 0), (2, 0, "assistant", None, 0), (2, 0, "assistant", None, 0), (3, 0, "to[ROLE]ol", "x", 0), (None, 0, None, "y", 0), (4, 0, "system", "s", 1), (4, 1, "user", "", 1), (4, 2, "assistant", "é\n", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns int")
    got = {r["conv_id"]: r for r in chat.chat_digests(df).collect()}
    for c in {r[0] for r in rows}:
        turns = sorted(((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == c))
        learned = "".join(t for _, role, t in turns if role == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == sha("".join(f"{r}\n{t}\n" for _, r, t in turns))
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(learned), sha(learned))
    assert [got[c]["valid"] for c in (1, 2, 3, 4)] == [True, False, False, True]
    assert chat.chat_digests(df.limit(0)).count() == 0


def test_classifier_on_held_out_rows(spark):
    rows, labels = [], []
    for i in range(900):
        poor, toxic = i % 5 == 0, i % 7 == 0
        w = [R.choice(VOCABULARY[:60]) + ("%%%" if poor else "") for _ in range(R.randint(60, 90))]
        if toxic:
            w[3] = R.choice(["moron", "scum"])
        rows.append((i, " ".join(w), "en", f"s{i % 3}", 400))
        if i % 3:
            labels.append((i, int(not poor), int(toxic)))
    docs = spark.createDataFrame([*rows, (900, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    known = spark.createDataFrame([*labels, (None, 1, 1), (5000, None, None)], "doc_id long, quality int, toxic int")
    got = by_id(cotrain.classify(docs, known))
    held = [i for i in range(900) if i % 3 == 0]
    right = sum(got[i]["kept"] == (i % 5 != 0 and i % 7 != 0) for i in held)
    assert len(got) == 901 and right >= 0.95 * len(held)
    assert cotrain.classify(docs.limit(0), known).count() == 0
    assert all(r["kept"] for r in cotrain.classify(docs, known.limit(0)).collect())


def test_bpe(docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = by_id(bpe.encode_documents(docs, path, with_ids=True))
    for i, t in ROWS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i]["ids"] == ids and got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == sha(" ".join(map(str, ids))) and got[i]["decoded_sha256"] == sha(library.decode(ids, skip_special_tokens=False))
    assert bpe.encode_documents(empty, path).count() == 0


def test_bpe_pieces_against_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    own, library = bpe.PrefixBpe(path), Tokenizer.from_file(path)
    for _ in range(2000):
        t = "".join(R.choice("aaabbeehtnoi'sre ld ZÀé日Σ\x00\x85123") for _ in range(R.randint(0, 25)))
        assert own.encode(t) == library.encode(t, add_special_tokens=False).ids


def test_lm(docs, empty):
    got = by_id(class_lm.lm_scores(docs, listed=20, own=8, classes=4))
    train = [t for i, t in ROWS if zlib.crc32(str(i).encode()) % 10]
    c = Counter(w for t in train for w in words(lowered(t)))
    n = sum(c.values()) + len(train)
    z = n + 0.1 * (len(c) + 2)
    for i, t in ROWS:
        w = words(lowered(t))
        base = sum(math.log10((c[x] + 0.1) / z) for x in w) + math.log10((len(train) + 0.1) / z)
        assert got[i]["base_score"] == pytest.approx(base)
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(w) + 1, sum(x in c for x in w) + 1, n)
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 10 == 0) and got[i]["score"] < 0
    assert class_lm.lm_scores(empty).count() == 0


def test_token_counts(docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = by_id(token_counts.count_tokens(docs, path))
    for i, t in ROWS:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((t or "").encode()), n > 512)
    assert token_counts.count_tokens(empty, path).count() == 0


@pytest.mark.parametrize("local", [decontaminate.LOCAL_WINDOWS, 0])
def test_decontamination(spark, docs, empty, local):
    items = [(1, " ".join(ROWS[8][1].split()[5:25]), 0), (2, "bo", 0), (2, "bo", 0), (10, "Two; WORDS!", 0), (11, None, 0), (12, "...", 0), (None, "one", 0)]
    bench = spark.createDataFrame(items, "item_id long, text string, start int")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    windows = {}
    for i, t, _ in items:
        w = split(t)
        n = min(10, len(w))
        for j in range(len(w) - n + 1 if n and i is not None else 0):
            windows.setdefault(tuple(w[j : j + n]), set()).add(i)
    got = by_id(decontaminate.decontaminate(docs, bench, local_windows=local))
    for i, t in ROWS:
        w, hit, found = split(t), set(), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                if x := windows.get(tuple(w[j : j + n])):
                    hit |= set(range(j, j + n))
                    found |= x
        want = (len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit))
        assert tuple(got[i])[1:] == want
    assert decontaminate.decontaminate(empty, bench, local_windows=local).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.decontaminate(docs, bench.limit(0), local_windows=local).collect())


def test_rules(docs, empty):
    got = by_id(rules.quality_rules(docs))
    for i, t in ROWS:
        w = words(t)
        grams = Counter(zip(w, w[1:], w[2:]))
        covered = {j + d for j, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for d in range(3)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")))
        assert (r["n_dup_lines"], r["n_repeat_words"]) == (len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(w) < 50 or 2 * len(covered) > len(w)) and not (r["base_failed"] and r["kept"])
    assert rules.quality_rules(empty).count() == 0


def test_em_finds_the_rule_that_lies():
    patterns = [((1, 1), 800), ((-1, 1), 90), ((-1, -1), 60), ((1, -1), 50)]
    prior, weights = rules.fit(patterns)
    assert weights[0][-1] < 0 < weights[0][1]
    again = rules.fit([(v, 2 * n) for v, n in patterns])
    assert prior == pytest.approx(again[0])


@pytest.mark.parametrize("window", [4, 35])
def test_substrings(docs, empty, window):
    got = by_id(recompress.substring_dedup(docs, window, with_text=True))
    split = {i: words(t) for i, t in ROWS}
    seen = Counter(tuple(w[j : j + window]) for w in split.values() for j in range(len(w) - window + 1))
    for i, w in split.items():
        gone = {j + d for j in range(len(w) - window + 1) if seen[tuple(w[j : j + window])] > 1 for d in range(window)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        assert tuple(got[i])[:4] == (i, len(w), len(gone), sha(kept))
        assert got[i]["kept_text"] == (kept if gone else None)
    assert recompress.substring_dedup(empty).count() == 0


def test_substrings_of_repeated_rows(spark):
    text = " ".join(str(i) for i in range(40))
    rows = recompress.substring_dedup(spark.createDataFrame([(1, text), (1, text), (2, "z " + text[:50])], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in rows) == [(1, 40), (1, 40), (2, 0)]


def test_html(spark):
    page = """<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href="/a">Home, really. Yes.</a></li></ul></nav><div class="ad">Buy, now. Please.</div>
    <article><h1>The  title</h1><p>First &amp; foremost,\n some <b>bold</b> text. It goes on.<br><p>Second paragraph, longer than the first. &eacute;t&eacute;</p><script>var x="</p>";</script>
    <div class="comments"><p>I think, therefore. Nice article, this.</p></div></article><aside>More, here.</aside><footer>&copy; us.</footer></body></html>"""
    bare = "<div id=main><p>Long text of the page, with commas, and stops. It goes on.</p><p>And on, for a while.</p></div><div class=sidebar>Links</div>"
    rows = [(1, "u", page, "z"), (2, None, None, "z"), (3, "u", "", "z"), (4, "u", bare, "z"), (5, "u", "<p>a <b", "z"), (6, "u", "plain", "z")]
    got = {r["page_id"]: r for r in tagpath.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert got[1]["text"] == "The title\nFirst & foremost, some bold text. It goes on.\nSecond paragraph, longer than the first. été"
    assert got[1]["n_chars"] == len(got[1]["text"]) and got[2]["text"] == got[3]["text"] == ""
    assert got[4]["text"] == "Long text of the page, with commas, and stops. It goes on.\nAnd on, for a while."
    assert got[6]["text"] == "plain"


def test_near_duplicates(docs, empty):
    got = by_id(tensor_minhash.near_duplicates(docs, size=4, percent=80))
    sets = {}
    for i, t in ROWS:
        w = words(lowered(t))
        sets[i] = {tuple(w[j : j + 4]) for j in range(max(1, len(w) - 3))} if w else set()
    least = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in sets:
                n = len(sets[i] & sets[j])
                if n and 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                    least[i] = least[j] = min(least[i], least[j])
        if all(least[least[i]] == least[i] for i in sets):
            break
    for i in sets:
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(sets[i]), least[i], least[i] == i)
    assert tensor_minhash.near_duplicates(empty).count() == 0
