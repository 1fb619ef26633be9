"""Cutting long passages into quotable units: whole paragraphs, whole forms, whole sentences; what can't be kept whole is counted.

The rules for the ends of sentences are our own: they follow Unicode's sentence marks and defend abbreviations, initials,
decimal numbers and ellipses.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

LIMIT = 600
#: Abbreviations behind which a sentence seldom ends, and how a qualifying clause opens.
ABBREVIATIONS = frozenset("mr mrs ms dr prof sr jr st no nos vs etc inc ltd co corp dept est fig art sec approx cf al e.g i.e u.s u.k a.m p.m jan feb mar apr jun jul aug sep sept oct nov dec".split())
QUALIFIERS = ("unless ", "except ", "provided ", "subject to ", "however,", "only if ", "on condition ", "notwithstanding ")
_END = re.compile(r"""[.!?。！？]["'”’)\]}]*(?=\s|$)""")
_LABEL = re.compile(r"[^\w]*[^\W\d_](?:[\w\s/()'’&#-])*")


def qualifies(text: str) -> bool:
    return text.lstrip(" \t\r\n\f\v ([").lower().startswith(QUALIFIERS)


_NEXT = re.compile(r"\s*(\S?)")


def sentence_ends(text: str) -> list[int]:
    """Where the sentences of a text end, behind their marks. A text that stops without one has its tail left over."""
    out = []
    first = re.search(r"\w", text)
    for m in _END.finditer(text) if first else ():
        at = m.start()
        if at <= first.start():
            continue
        before = text[max(0, at - 60) : at]  # no abbreviation is longer
        raw = re.search(r"\S*$", before)[0]
        word, after = raw.lstrip("(['\"“‘").lower(), _NEXT.match(text, m.end())[1]
        if text[at] == ".":
            if before.endswith(".") or word in ABBREVIATIONS or re.fullmatch(r"[^\W\d_]", word) or re.fullmatch(r"(?:[^\W\d_]\.)+[^\W\d_]", word):
                if after:
                    continue
            if after.islower() or re.fullmatch(r"[0-9]{1,3}", word) and at - len(word) <= first.start():
                continue
        out.append(m.end())
    return out


@dataclass
class Unit:
    start: int
    end: int
    whole: bool = True


def trimmed(source: str, start: int, end: int, whole: bool = True) -> Unit:
    text = source[start:end]
    return Unit(start + len(text) - len(text.lstrip()), start + len(text.rstrip()), whole)


def paragraphs(source: str) -> list[tuple[int, int]]:
    """Stretches between blank lines, without the white space around them."""
    cuts = [m.span() for m in re.finditer(r"(?:(?<=\n)|\A)[^\S\n]*\n", source)]
    bounds = zip([0, *[e for _, e in cuts]], [*[s for s, _ in cuts], len(source)])
    units = [trimmed(source, s, e) for s, e in bounds]
    return [(u.start, u.end) for u in units if u.start < u.end]


def label_value(line: str) -> str | None:
    """The value of a "label: value" row: a label of one to eight words that doesn't open with a number."""
    label, colon, value = line.strip().partition(":")
    return value if colon and value.strip() and 1 <= len(label.split()) <= 8 and _LABEL.fullmatch(label) else None


def form_fields(text: str) -> int:
    """How many fields a form has; 0 for prose, also where its labels only introduce whole sentences."""
    rows, at = [], 0
    for line in text.splitlines(keepends=True):
        value = label_value(line)
        if value is not None:
            rows.append((at, at + len(line.rstrip()) - len(value)))
        elif not rows and line.strip() and not line.rstrip().endswith(":"):
            return 0
        at += len(line)
    if len(text) <= LIMIT or not rows:
        return len(rows)
    values = [text[start:following] for (_, start), following in zip(rows, [*[s for s, _ in rows[1:]], len(text)])]
    ends = [sentence_ends(v) for v in values]
    if any(e and v[e[0] :].strip() for v, e in zip(values, ends)):
        return 0
    return 0 if all(e and not v[e[-1] :].strip() for v, e in zip(values, ends)) else len(rows)


def ends_sentence(text: str) -> bool:
    ends = sentence_ends(text)
    return bool(ends) and not text[ends[-1] :].strip()


def leads_in(text: str) -> bool:
    """What follows belongs to it: an open mark at the end, or prose without the end of a sentence."""
    return text.endswith((":", ";", ",", "-")) or form_fields(text) == 0 and not ends_sentence(text)


def _groups(source: str) -> list[Unit]:
    out: list[Unit] = []
    for start, end in paragraphs(source):
        text = source[start:end]
        if out:
            before = source[out[-1].start : out[-1].end]
            form = form_fields(text) > 0 and len(text) <= LIMIT and not before.endswith((":", ";", ",", "-"))
            if leads_in(before) and not form or qualifies(text):
                out[-1].end = end
                continue
        out.append(Unit(start, end))
    return out


def _sentences(source: str, group: Unit) -> list[Unit]:
    """A group's sentences, each with the qualifications that follow it; a tail without an end isn't whole."""
    out, at = [], group.start
    stops = [group.start + e for e in sentence_ends(source[group.start : group.end])]
    if source[(stops or [at])[-1] : group.end].strip():
        stops.append(group.end)
        open_tail = True
    else:
        open_tail = False
    for i, stop in enumerate(stops):
        unit = trimmed(source, at, stop, not (open_tail and i == len(stops) - 1))
        at = stop
        if out and qualifies(source[unit.start : unit.end]):
            out[-1].end, out[-1].whole = unit.end, out[-1].whole and unit.whole
        else:
            out.append(unit)
    return out


def segments(source: str) -> tuple[list[str], int]:
    """Quotable stretches of the source, of at most LIMIT characters, in order; and how many units could not be kept whole."""
    text = source.strip()
    if len(text) <= LIMIT:
        return [text] if text else [], 0
    units: list[Unit] = []
    for group in _groups(source):
        told = source[group.start : group.end]
        fields = form_fields(told)
        if fields > 1 or len(told) <= LIMIT and (fields or ends_sentence(told)):
            units.append(group)
        else:
            units += _sentences(source, group)
    out: list[str] = []
    packed: Unit | None = None
    lost = 0
    for unit in units:
        keeps = unit.whole and unit.end - unit.start <= LIMIT
        if packed and keeps and unit.end - packed.start <= LIMIT:
            packed.end = unit.end
            continue
        if packed:
            out.append(source[packed.start : packed.end])
        packed = unit if keeps else None
        lost += not keeps
    if packed:
        out.append(source[packed.start : packed.end])
    return out, lost


def complete(text: str) -> bool:
    """Ends in one terminal mark behind a letter or digit, or behind a value's sign after a digit."""
    return bool(re.search(r"""(?:[^\W_]|\d\s*[%‰‱°$€£¥₹])["'”’)\]}]*[.!?。！？]["'”’)\]}]*\Z""", text))


def safe_prefix(text: str) -> str | None:
    """The whole sentences of a clipped text; null where there are none, or where what was cut off began to qualify them."""
    ends = sentence_ends(text)
    if not ends:
        return None
    tail = text[ends[-1] :].lstrip()
    words = re.findall(r"[^\W\d_]+", tail.lower())[:2]
    cut_short = [["subject"], ["only"], ["on"], ["subject", "to"], ["only", "if"], ["on", "condition"]]
    if qualifies(tail) or words[:1] and words[0] in ("unless", "except", "provided", "notwithstanding", "however", "but") or words in cut_short:
        return None
    kept = text[: ends[-1]]
    return kept if complete(kept) and kept.strip() == kept else None


def recover(units: list[str], ceiling: int) -> tuple[list[str], list[str], int]:
    """Units of a generated answer without those cut off at the ceiling: what is kept, which of it was trimmed, how many were withheld."""
    kept, cut, withheld = [], [], 0
    for text in units:
        clipped = ceiling > 0 and len(text) == ceiling and text.lstrip() == text and bool(text.rstrip()) and not complete(text)
        whole = safe_prefix(text) if clipped else text
        if whole is None:
            withheld += 1
        else:
            kept.append(whole)
            if clipped:
                cut.append(whole)
    return kept, cut, withheld
