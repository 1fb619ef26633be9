"""BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a pre-token one token alone can come last in its encoding. A token is that one if it is a suffix of
the prefix and if the last token of what stands before it may be followed by it. The suffixes come from a suffix
automaton over the vocabulary, the second test from the merge ranks; back-pointers give the ids. No merge is replayed.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from quillstone.llm.common import docs_of, lean

#: Pre-tokens whose encoding a worker keeps, in each of two generations. A bound on memory; results don't depend on it.
CACHE = 250_000
NEVER = 1 << 60
#: Beyond these letters and punctuation marks, Unicode tables of different versions differ: there the library cuts the text.
RARE = regex.compile("[^\u0000-\u024F\u0391-\u03A1\u03A4-\u03A9\u03B1-\u03C9\u0410-\u044F\u2010-\u2027\u2030-\u205E\u20AC]")


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class SuffixAutomaton:
    """All substrings of the vocabulary; each state knows the longest token that ends where it ends, and the next shorter."""

    def __init__(self, tokens: dict[int, tuple[int, ...]]):
        self.step: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        ends = {}
        for t, symbols in tokens.items():
            at = 0
            for c in symbols:
                at = self._extend(at, c)
            ends[at] = t
        n = len(self.size)
        #: (token, its length, state to go on from) for the longest token at or above a state, or None.
        self.best: list[tuple[int, int, int] | None] = [None] * n
        for s in sorted(range(1, n), key=self.size.__getitem__):
            up = self.link[s]
            self.best[s] = (ends[s], self.size[s], up) if s in ends else (self.best[up] if up > 0 else None)

    def _state(self, size: int, link: int, step: dict[int, int]) -> int:
        self.size.append(size)
        self.link.append(link)
        self.step.append(step)
        return len(self.size) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        twin = self._state(self.size[p] + 1, self.link[q], dict(self.step[q]))
        self.link[q] = twin
        while p >= 0 and self.step[p].get(c) == q:
            self.step[p][c] = twin
            p = self.link[p]
        return twin

    def _extend(self, last: int, c: int) -> int:
        q = self.step[last].get(c)
        if q is not None:
            return q if self.size[q] == self.size[last] + 1 else self._split(last, c, q)
        new, p = self._state(self.size[last] + 1, 0, {}), last
        while p >= 0 and c not in self.step[p]:
            self.step[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.step[p][c]
            self.link[new] = q if self.size[q] == self.size[p] + 1 else self._split(p, c, q)
        return new


class PrefixBpe:
    """A byte-level BPE vocabulary with word ends, from a tokenizers file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        self.names = {i: s for s, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.names |= {i: s for s, i in self.special.items()}
        letters = byte_letters()
        symbols: dict[int, tuple[int, ...]] = {}
        for letter, b in letters.items():
            for name, symbol in ((letter, b), (letter + self.end, 256 + b)):
                if name in vocab:
                    symbols.setdefault(vocab[name], (symbol,))
        self.base = {s[0]: t for t, s in symbols.items()}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            left, right = vocab[a], vocab[b]
            whole = vocab[a + (b if not self.end or not a.endswith(self.end) else b)]
            self.rank[left, right] = (r, whole)
            symbols.setdefault(whole, symbols[left] + symbols[right])
        #: For a token that encodes as itself: (left part, right part, rank of the merge that makes it).
        self.parts: dict[int, tuple[int, int, int]] = {}
        whole_tokens = {t: s for t, s in symbols.items() if len(s) == 1 or self._derive(t, s)}
        self.automaton = SuffixAutomaton(whole_tokens)
        self._left: dict[int, list[tuple[int, int, int]]] = {}
        self._right: dict[int, list[tuple[int, int, int]]] = {}
        self._fits: dict[int, bool] = {}
        names = "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))
        self.special_in = regex.compile(f"({names})") if names else None
        found = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.pieces = regex.compile(found[0])
        library = Tokenizer.from_file(path)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.byte = {ord(letter): b for letter, b in letters.items()}

    def _derive(self, token: int, symbols: tuple[int, ...]) -> bool:
        """Merges a token's own symbols once, when the vocabulary is read, to learn its parts and whether it comes out."""
        at = [self.base[s] for s in symbols]
        while len(at) > 1:
            merges = [self.rank.get(p, (NEVER, 0)) for p in zip(at, at[1:])]
            r, whole = min(merges)
            if r == NEVER:
                return False
            i = merges.index((r, whole))
            if len(at) == 2:
                if whole != token:
                    return False
                self.parts[token] = (at[0], at[1], r)
            at[i : i + 2] = [whole]
        return True

    def _edge(self, token: int, side: int) -> list[tuple[int, int, int]]:
        """The pieces that touch one edge of a token while it is built: (piece, rank that makes it, rank that uses it up)."""
        out, used = [], NEVER
        while token in self.parts:
            made = self.parts[token][2]
            out.append((token, made, used))
            token, used = self.parts[token][side], made
        return [*out, (token, -1, used)]

    def fits(self, first: int, second: int) -> bool:
        """May second follow first in an encoding? Not if a merge across their border would come before those that use up its two pieces."""
        key = first << 20 | second
        if (known := self._fits.get(key)) is not None:
            return known
        if (right := self._right.get(first)) is None:
            right = self._right[first] = self._edge(first, 1)
        if (left := self._left.get(second)) is None:
            left = self._left[second] = self._edge(second, 0)
        ok = True
        for a, a_made, a_used in right:
            for b, b_made, b_used in left:
                r = self.rank.get((a, b), (NEVER, 0))[0]
                # At equal ranks merges go from left to right: the first token's inner one precedes the border, the second's follows.
                if a_made < r < a_used and b_made < r <= b_used and r != NEVER:
                    ok = False
        if len(self._fits) > 4 * CACHE:
            self._fits.clear()
        self._fits[key] = ok
        return ok

    def encode_piece(self, piece: str) -> list[int]:
        data = list(piece.encode("utf-8", "surrogatepass"))
        if not data:
            return []
        if self.end:
            data[-1] += 256
        step, link, size, best, fits = self.automaton.step, self.automaton.link, self.automaton.size, self.automaton.best, self._fits
        last, before = [0] * (len(data) + 1), [0] * (len(data) + 1)
        state = matched = 0
        for i, c in enumerate(data, 1):
            while state > 0 and c not in step[state]:
                state = link[state]
                matched = size[state]
            state = step[state][c]
            matched += 1
            found = best[state if size[state] == matched else link[state]]  # a state's longest string may reach before what was read
            while True:
                token, n, up = found
                if n == i:
                    break
                ok = fits.get(last[i - n] << 20 | token)
                if ok or ok is None and self.fits(last[i - n], token):
                    break
                found = best[up]
            last[i], before[i] = token, i - n
        ids, i = [], len(data)
        while i:
            ids.append(last[i])
            i = before[i]
        return ids[::-1]

    def cut(self, text: str) -> list[str]:
        """Pre-tokens of a text without special tokens: NFC, the lower case of each character by itself, then the file's pattern."""
        if text.isascii():
            return self.pieces.findall(text.lower())
        if RARE.search(text):
            return [bytes(map(self.byte.__getitem__, map(ord, p))).decode("utf-8", "surrogatepass") for p, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text))]
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # str.lower() looks at the neighbours of a capital sigma.
        return self.pieces.findall("".join(map(str.lower, text)) if "\u03A3" in text else text.lower())

    def runs(self, text: str) -> Iterator[tuple[bool, list[str]]]:
        """(False, pre-tokens) and (True, [special token]) in order."""
        for i, part in enumerate(self.special_in.split(text) if self.special_in else [text]):
            if i % 2:
                yield True, [part]
            elif part:
                yield False, self.cut(part)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for special, pieces in self.runs(text):
            for p in pieces:
                out += [self.special[p]] if special else self.encode_piece(p)
        return out

    def decode(self, ids: list[int]) -> str:
        """The tokens' names with a space between; the file names no decoder. Ids outside the vocabulary are passed over."""
        return " ".join(self.names[i] for i in ids if i in self.names)


class PieceCache:
    """What each pre-token encodes to: (count, ids as text, decoded text, ids as bytes)."""

    def __init__(self, bpe: PrefixBpe):
        self.bpe, self.new, self.old = bpe, {}, {}

    def miss(self, piece: str) -> tuple[int, str, str, bytes]:
        got = self.old.get(piece)
        if got is None:
            got = self.entry(self.bpe.encode_piece(piece))
        if len(self.new) >= CACHE:
            self.old, self.new = self.new, {}
        self.new[piece] = got
        return got

    def entry(self, ids: list[int]) -> tuple[int, str, str, bytes]:
        return len(ids), " ".join(map(str, ids)), self.bpe.decode(ids), np.array(ids, dtype=np.int32).tobytes()

    def document(self, text: str) -> list[tuple[int, str, str, bytes]]:
        out = []
        for special, pieces in self.bpe.runs(text):
            if special:
                out.append(self.entry([self.bpe.special[pieces[0]]]))
            else:
                for p in pieces:
                    out.append(self.new.get(p) or self.miss(p))
        return out


@lru_cache(maxsize=2)
def _worker(path: str) -> PieceCache:
    return PieceCache(PrefixBpe(path))


def encode_documents(docs: DataFrame, vocabulary: str, with_ids: bool = False) -> DataFrame:
    """Encodes every whole text and decodes its ids.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256 and, with with_ids, ids. Null and empty texts have no tokens and
    the digests of the empty text; a null doc_id stays null; repeated rows give a row each; other columns of docs are
    ignored. One scan, no shuffle; a worker holds the vocabulary and a bounded cache. vocabulary: a path that every
    executor can open.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _worker(vocabulary)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                counts, ids_hex, text_hex, flat, offsets = [], [], [], [], [0]
                for text in part.column(1).to_pylist():
                    found = cache.document(text or "")
                    n = sum([x[0] for x in found])
                    counts.append(n)
                    ids_hex.append(hashlib.sha256(" ".join([x[1] for x in found]).encode()).hexdigest())
                    text_hex.append(hashlib.sha256(" ".join([x[2] for x in found]).encode("utf-8", "surrogatepass")).hexdigest())
                    if with_ids:
                        flat += [x[3] for x in found]
                        offsets.append(offsets[-1] + n)
                columns = [part.column(0), pa.array(counts, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(flat), dtype=np.int32))))
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    return docs_of(docs).mapInArrow(lean(run), schema)
