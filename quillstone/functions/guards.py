"""Guards on claims: what a claim says in numbers, lists, directions, conditions, judgements and obligations must stand in its evidence.

Each guard only takes a claim back, it never vouches for one. All work on lower-case tokens; pure functions over strings.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from decimal import Decimal

from quillstone.functions.text import BEFORE_T, CURRENCIES, NEGATIONS, UNIT_NAMES

# ---- tokens

_TOKEN = re.compile(r"(?:(?<![^\W_])[+\-−])?(?:\.?\d[^\W_]*(?:[.,]\d[^\W_]*)*)|[^\W_]+|[$€£¥₹%]|[<>]=?|[≤≥]|[.?!;\n\r]")
_BREAKS = frozenset(".?!;\n\r")
_SIGNS = {"≤": "<=", "≥": ">=", "%": "percent"}


def clauses(text: str) -> list[list[str]]:
    """The clauses of a text as tokens: words, canonical numbers, currency signs and comparison signs."""
    out: list[list[str]] = [[]]
    for m in _TOKEN.finditer(text):
        t = m[0]
        if t in _BREAKS:
            out.append([])
        elif re.fullmatch(r"[+\-−]?[\d.,]+", t) and any(c.isdigit() for c in t):
            t = t.replace("−", "-").replace(",", "")
            out[-1].append(re.sub(r"^([+-]?)\.", r"\g<1>0.", t))
        else:
            out[-1].append(_SIGNS.get(t, t.lower()))
    return [c for c in out if c]


def words(text: str) -> list[str]:
    return [w.lower() for w in re.findall(r"[^\W_]+", text)]


def sentences(text: str) -> list[str]:
    return [s.strip() for s in re.split(r"[.?!;\n\r]", text) if s.strip()]


def negated(tokens: list[str]) -> bool:
    """A negating word, "not only" aside, or a verb with n't."""
    for i, w in enumerate(tokens):
        after = tokens[i + 1] if i + 1 < len(tokens) else ""
        if w in NEGATIONS and not (w == "not" and after == "only") or w in BEFORE_T and after == "t":
            return True
    return False


def holds(haystack: list[str], needle: list[str]) -> bool:
    """needle stands in haystack without a gap."""
    return bool(needle) and any(haystack[i : i + len(needle)] == needle for i in range(len(haystack) - len(needle) + 1))


# ---- numbers

#: Spelled numbers.
SMALL = dict(zip("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split(), range(20)))
TENS = dict(zip("twenty thirty forty fifty sixty seventy eighty ninety".split(), range(20, 100, 10)))
SCALES = {"thousand": ("K", 1000), "million": ("M", 10**6), "billion": ("B", 10**9)}
_BELOW = "(?:uH(?:A?(?:TA?u|T|t|u))?|TA?u|T|t|u|z)"
_SPELLED = re.compile(f"N?(?:{_BELOW}BA?(?={_BELOW})|{_BELOW}B)?(?:{_BELOW}MA?(?={_BELOW})|{_BELOW}M)?(?:{_BELOW}KA?(?={_BELOW})|{_BELOW}K)?(?:{_BELOW})?")


def _kind(word: str) -> str:
    if word in SMALL:
        return "z" if word == "zero" else "u" if SMALL[word] < 10 else "t"
    return "T" if word in TENS else "H" if word == "hundred" else "A" if word == "and" else "N" if word in ("minus", "negative") else SCALES.get(word, ".")[0]


def canonical(token: str) -> str | None:
    """A decimal number without needless zeros or sign; null for any other token."""
    if not re.fullmatch(r"[+-]?[0-9]+(?:\.[0-9]+)?", token):
        return None
    d = Decimal(token)
    plain = format(d.copy_abs(), "f")
    plain = plain.rstrip("0").rstrip(".") if "." in plain else plain
    return ("-" if d < 0 else "") + plain


@dataclass(frozen=True)
class Mention:
    value: str
    start: int
    end: int


def spelled(tokens: list[str], at: int) -> Mention | None:
    """The longest spelled number that starts here."""
    m = _SPELLED.match("".join(map(_kind, tokens[at : at + 40])))
    if not m or not m[0].strip("N"):
        return None
    total = group = 0
    for w in tokens[at : at + m.end()]:
        if w in SCALES:
            total, group = total + group * SCALES[w][1], 0
        elif w == "hundred":
            group *= 100
        else:
            group += SMALL.get(w, TENS.get(w, 0))
    value = total + group
    return Mention(str(-value if m[0].startswith("N") else value), at, at + m.end())


def mentions(tokens: list[str]) -> list[Mention]:
    """Numbers in digits or words, with a currency's sign before them."""
    out, i = [], 0
    while i < len(tokens):
        at = i + (tokens[i] in CURRENCIES)
        found = None
        if at < len(tokens):
            value = canonical(tokens[at])
            found = Mention(value, at, at + 1) if value is not None else spelled(tokens, at)
        if found:
            out.append(Mention(found.value, i, found.end))
            i = found.end
        else:
            i += 1
    return out


#: Phrases before a number, the longest first, with their relation and whether a negation in the four tokens before turns it.
RELATIONS = [(tuple(p.split()), r, turns) for r, turns, phrases in (
    ("<=", False, "no more than|not more than|up to|maximum of|maximum"), (">=", False, "no less than|not less than|minimum of|minimum"), ("<=", True, "at most|<="), (">=", True, "at least|>="),
    (">", True, "more than|greater than|over|above|>"), ("<", True, "less than|fewer than|under|below|<"), ("=", True, "exactly"),
) for p in phrases.split("|")]
RELATIONS.sort(key=lambda x: -len(x[0]))
_TURNED = {"<": ">=", "<=": ">", ">": "<=", ">=": "<", "=": "!="}
_AFTER = {("or", "fewer"): "<=", ("or", "less"): "<=", ("or", "more"): ">=", ("or", "greater"): ">="}
COPULAS = frozenset("is are was were equals".split())


def relation(tokens: list[str], start: int, end: int) -> str | None:
    """What a clause says of a number: <, <=, >, >=, =, != or nothing."""
    before = tokens[:start]
    if (r := _AFTER.get(tuple(tokens[end : end + 2]))) and before[-2:] not in (["at", "most"], ["at", "least"]):
        return r
    for phrase, r, turns in RELATIONS:
        if tuple(before[-len(phrase) :]) == phrase:
            return _TURNED[r] if turns and negated(before[: -len(phrase)][-4:]) else r
    at = len(before) - 1 - (before[-1:] == ["not"])
    if at >= 0 and before[at] in COPULAS:
        return "!=" if at < len(before) - 1 or negated(before[:at][-4:]) else "="
    return None


def entails(source: str, s: Decimal, claim: str, c: Decimal) -> bool:
    """Every number that the source allows is one that the claim allows."""
    if claim == "!=":
        return {"=": s != c, "!=": s == c, "<": s <= c, "<=": s < c, ">": s >= c, ">=": s > c}[source]
    if source == "!=":
        return False
    below, above = source in ("<", "<=", "="), source in (">", ">=", "=")
    if claim in ("<", "<="):
        return below and (s < c or s == c and (source == "<" or claim == "<="))
    if claim in (">", ">="):
        return above and (s > c or s == c and (source == ">" or claim == ">="))
    return source == "=" and s == c


#: Words that end a unit, verbs that help, and names of units.
UNIT_STOPS = frozenset("a an the and or but if when unless that which who where from to by of in on at for with without as than is are was were be been being has have had do does did can could may might must shall should will would".split())
HELPERS = frozenset("is are was were be been being has have had can cannot could may might must shall should will would".split())
COMPARING = frozenset("no not more less fewer greater than at most least up to maximum minimum of exactly under below over above a an the < <= > >=".split())
_UNITS = {s: n for n, spellings in UNIT_NAMES.items() for s in spellings.split()}


def unit_word(word: str) -> str:
    return _UNITS.get(word, word.removesuffix("s"))


def unit(tokens: list[str], start: int, end: int) -> str | None:
    """The unit of a number: its currency, or the words behind it, with square, cubic, a scale of degrees and per."""
    for i in (start, end):
        if i < len(tokens) and tokens[i] in CURRENCIES:
            return CURRENCIES[tokens[i]]
    rest = tokens[end:]
    rest = rest[2:] if tuple(rest[:2]) in _AFTER else rest

    def part(at: int) -> tuple[str, int] | None:
        n = 2 if rest[at : at + 1] in (["square"], ["cubic"]) else 1
        found = rest[at : at + n]
        if len(found) < n or any(w == "per" or w in UNIT_STOPS for w in found):
            return None
        return " ".join([*found[:-1], unit_word(found[-1])]), at + n

    first = part(0)
    if first is None:
        return None
    name, at = first
    if name == "degree" and rest[at : at + 1] and rest[at] in ("celsius", "centigrade", "fahrenheit", "kelvin"):
        name, at = f"{name} {rest[at]}", at + 1
    if rest[at : at + 1] == ["per"] and (more := part(at + 1)):
        name = f"{name} per {more[0]}"
    return name


def without_article(tokens: list[str]) -> list[str]:
    return tokens[1:] if tokens[:1] and tokens[0] in ("a", "an", "the") else tokens


@dataclass(frozen=True)
class Constraint:
    value: str
    relation: str | None
    unit: str | None
    context: tuple[str, ...]
    agent: tuple[str, ...]


def constraints(text: str) -> list[Constraint]:
    """Each number of a text with its relation, its unit, the eight words before and the agent behind "by"."""
    out = []
    for tokens in clauses(text):
        for m in mentions(tokens):
            end = m.start
            while end and tokens[end - 1] in COMPARING:
                end -= 1
            rest = tokens[m.end :]
            agent = rest[rest.index("by") + 1 :] if "by" in rest else []
            stop = next((i for i, w in enumerate(agent) if w in ("and", "or", "when", "if", "unless", "under", "because", "while")), len(agent))
            out.append(Constraint(m.value, relation(tokens, m.start, m.end), unit(tokens, m.start, m.end), tuple(tokens[max(0, end - 8) : end]), tuple(agent[: min(4, stop)])))
    return out


def same_context(source: Constraint, claim: Constraint) -> bool:
    """Both speak of the same thing: the same words before, a shared subject with the same predicate, or the same agent."""
    a, b = without_article(list(source.context)), without_article(list(claim.context))
    if a and a == b:
        return True
    shared = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    predicate = lambda rest: next((w.removesuffix("s") for w in rest if w not in HELPERS), None)
    if shared and predicate(a[shared:]) == predicate(b[shared:]):
        return True
    if source.agent and (source.agent == claim.agent or holds(list(claim.context), list(source.agent))):
        return True
    return bool(claim.agent) and holds(list(source.context), list(claim.agent))


_PREDICATES = HELPERS | frozenset(BEFORE_T) | frozenset("do does did require requires required use uses used remain remains remained < <= > >=".split())
_DROPPED = HELPERS | frozenset("a an the do does did not no never when if unless provided".split())


def subject(context: tuple[str, ...]) -> list[str] | None:
    """The stems of the words before the first predicate of the last condition."""
    local = list(context)
    for i in range(len(local) - 1, -1, -1):
        if local[i] in ("when", "if", "unless", "provided"):
            local = local[i + 1 :]
            break
    local = without_article(local)
    at = next((i for i, w in enumerate(local) if w in _PREDICATES), None)
    stem = lambda w: re.sub(r"ies$", "y", w) if w.endswith("ies") else re.sub(r"(?<=e)d$|ed$|ing$|s$", "", w)
    found = [stem(w) for w in local[: at or 0] if w not in _DROPPED]
    return found or None


def numbers_supported(claim: str, evidence: list[str]) -> bool:
    """Every bound that a claim states follows from one in the evidence on the same thing; numbers on things that the evidence doesn't speak of pass."""
    known = [c for e in evidence for c in constraints(e)]
    bounds = [c for c in known if c.relation]

    def follows(s: Constraint, c: Constraint) -> bool:
        return entails(s.relation, Decimal(s.value), c.relation, Decimal(c.value)) and (s.unit is None or c.unit is None or s.unit == c.unit)

    for c in (c for c in constraints(claim) if c.relation):
        if any(follows(s, c) and same_context(s, c) for s in bounds):
            continue
        silent = not c.context and not c.agent
        alike = [s for s in bounds if s.value == c.value and (silent and not s.context and not s.agent or same_context(s, c) or subject(s.context) is not None and subject(s.context) == subject(c.context))]
        if alike and not any(follows(s, c) for s in alike):
            return False
        if not silent and any(same_context(s, c) for s in known if s.context or s.agent):
            return False
    return True


# ---- lists


def enumeration_supported(claim: str, evidence: list[str]) -> bool:
    """Family members and relatives of a claim stand in the evidence, and immediate ones stay immediate."""

    def families(text: str) -> list[bool]:
        w = words(text)
        return [i > 0 and w[i - 1] == "immediate" for i in range(len(w) - 1) if w[i] == "family" and w[i + 1] in ("member", "members")]

    def relatives(text: str) -> bool:
        return re.search(r"\b(?:his|her|their|our|your|\w+['’]s) relatives?\b|\brelatives? of\b", text.lower()) is not None

    told, cited = families(claim), [f for e in evidence for f in families(e)]
    if told and (not cited or all(cited) and not any(told)):
        return False
    return not relatives(claim) or any(map(relatives, evidence))


# ---- directions

_ROUTE = frozenset("transport transports transported transporting carry carries carried carrying provide provides provided providing".split())
_MODALS = frozenset("can could may might must shall should will would".split())
_POINTERS = frozenset("a an the their his her its any".split())
_SAME_PLACE = ((("living", "quarters"), "housing"), (("work", "site"), "worksite"), (("place", "of", "employment"), "worksite"), (("workplace",), "worksite"), (("home",), "housing"))
_OFTEN = frozenset("each every daily weekly monthly annually".split())


@dataclass(frozen=True)
class Route:
    origin: tuple[str, ...]
    destination: tuple[str, ...]
    scope: tuple[str, ...]
    actor: tuple[str, ...]


def place(tokens: list[str]) -> tuple[str, ...]:
    """An endpoint under one name, without how often it is served."""
    tokens = tokens[: next((i for i, w in enumerate(tokens) if w in _OFTEN), len(tokens))]
    tokens = [w for w in tokens if w not in _POINTERS]
    out, i = [], 0
    while i < len(tokens):
        spelled_, name = next(((p, n) for p, n in _SAME_PLACE if tuple(tokens[i : i + len(p)]) == p), ((tokens[i],), tokens[i]))
        out.append(name)
        i += len(spelled_)
    return tuple(out)


def _actor(before: list[str]) -> tuple[str, ...]:
    if "by" in before and (agent := without_article(before[len(before) - before[::-1].index("by") :])):
        return tuple(agent[:4])
    at = next((i for i in range(len(before) - 1, -1, -1) if before[i] in _ROUTE), None)
    if at is None:
        return ()
    start = next((i + 1 for i in range(at - 1, -1, -1) if before[i] in ("but", "while", "whereas") or before[i] == "and" and any(w in _ROUTE or w in ("from", "to") for w in before[:i])), 0)
    found = without_article(before[start:at])
    while found and found[-1] in _MODALS:
        found = found[:-1]
    return tuple(found)


def routes(text: str) -> list[Route]:
    """from A to B, and to B from A, with at most twelve tokens to the second word."""
    out = []
    for clause in sentences(text):
        w = words(clause)
        for first, second in (("from", "to"), ("to", "from")):
            for i, t in enumerate(w):
                j = next((k for k in range(i + 1, min(i + 13, len(w))) if w[k] == second), None) if t == first else None
                if j is None:
                    continue
                rest = w[j + 1 :]
                rest = rest[: next((k for k, x in enumerate(rest) if x in ("and", "or", "by", "from", "to", "unless", "absent", "if", "when")), len(rest))]
                cut = next((k for k, x in enumerate(rest) if x in ("during", "until", "throughout")), len(rest))
                a, b = place(w[i + 1 : j]), place(rest[:cut][:8])
                if a and b:
                    out.append(Route(*((a, b) if first == "from" else (b, a)), tuple(rest[cut:]), _actor(w[:i])))
    return out


def _parts(actor: tuple[str, ...], by: str) -> list[tuple[str, ...]]:
    return [tuple(p.split()) for p in re.split(rf"\b{by}\b", " ".join(actor)) if p.split()]


def directions_supported(claim: str, evidence: list[str]) -> bool:
    """A route isn't turned round, joined from others' ends, or given to another actor than the evidence names."""
    known = [r for e in evidence for r in routes(e)]
    for r in routes(claim):
        same = [s for s in known if (s.origin, s.destination) == (r.origin, r.destination) and s.scope in ((), r.scope)]
        if same:
            served = lambda s: s.actor == r.actor or r.actor in _parts(s.actor, "and") or r.actor in _parts(s.actor, "or")
            if not r.actor or any(map(served, same)):
                continue
            cited = any(r.actor in [s.actor, *_parts(s.actor, "and")] for s in known) or any(tuple(without_article(words(c))[: len(r.actor)]) == r.actor for e in evidence for c in sentences(e))
            if cited and any(s.actor for s in same):
                return False
            continue
        starts, stops = {s.origin for s in known}, {s.destination for s in known}
        if r.origin in stops - starts or r.destination in starts - stops or r.origin in starts | stops and r.destination in starts | stops:
            return False
    return True


# ---- conditions of named actors

QUALIFIERS = (frozenset("compensation compensated consideration money paid payment fee".split()), frozenset("only solely exclusively".split()), frozenset("unless except excluding absent without".split()))
CONDITIONS = frozenset("if when provided".split()) | QUALIFIERS[2]
_SUBJECT_ENDS = frozenset("subject is are was were must shall may can will required requires".split())


def actors(text: str) -> dict[str, list[str]]:
    """Names that a text defines: up to six words before an acronym in brackets, laws and programs aside."""
    out = {}
    for m in re.finditer(r"([^.;:,\n\r()]*)\(\s*([A-Z]{2,10})s?\s*\)", text):
        label = words(re.split(r"(?i)\sand\s", m[1])[-1])[-6:]
        if label and not set(label) & {"act", "law", "program", "standard", "regulation"}:
            out[m[2].lower()] = label
    return out


def names(tokens: list[str], key: str, label: list[str]) -> bool:
    return any(t in (key, key + "s") for t in tokens) or holds(tokens, label)


def polarities(tokens: list[str], concept: frozenset[str]) -> set[bool]:
    """Whether each word of a concept is denied in the six tokens before it."""
    return {negated(tokens[max(0, i - 6) : i]) or bool(set(tokens[max(0, i - 6) : i]) & QUALIFIERS[2]) for i, w in enumerate(tokens) if w in concept}


def statements(tokens: list[str], known: dict[str, list[str]], concept: frozenset[str]) -> list[list[str]]:
    """A clause's statements: cut at contrasts, and at and/or where a named actor follows and something was said before."""
    out, start = [], 0
    for i, w in enumerate(tokens):
        left = tokens[start:i]
        follows = any(names(tokens[i + 1 :], k, v) for k, v in known.items())
        said = bool(set(left) & concept) or any(names(left[:-1], k, v) for k, v in known.items())
        if left and (w in ("while", "whereas", "but", "although") or w in ("and", "or") and follows and said):
            out.append(left)
            start = i + 1
    return [*out, tokens[start:]] if start < len(tokens) else out


def conditions_supported(claim: str, evidence: list[str]) -> bool:
    """A condition that a claim puts on a named actor stands in the evidence for that actor, in the same sense."""
    known = {k: v for e in evidence for k, v in actors(e).items()}
    if not known:
        return True
    every = frozenset().union(*QUALIFIERS)
    for sentence in sentences(claim):
        w = words(sentence)
        for part in [w] if w[:1] and w[0] in CONDITIONS else statements(w, known, every):
            at = next((i for i, t in enumerate(part) if t in CONDITIONS), None)
            if at is None:
                continue
            if at == 0:
                if "," in sentence:
                    condition, about = (words(x) for x in sentence.split(",", 1))
                elif "then" in part:
                    condition, about = part[: part.index("then")], part[part.index("then") + 1 :]
                else:
                    continue
            else:
                cut = at - (part[at - 1] in QUALIFIERS[1])
                condition, about = part[cut:], part[:cut]
            about = about[: next((i for i, t in enumerate(about) if t in _SUBJECT_ENDS), len(about))]
            claimed = {k: v for k, v in known.items() if names(about, k, v)}
            if claimed and not all(_concept_supported(c, condition, claimed, known, evidence) for c in QUALIFIERS):
                return False
    return True


def _concept_supported(concept: frozenset[str], condition: list[str], claimed: dict, known: dict, evidence: list[str]) -> bool:
    told = [s for e in evidence for c in sentences(e) for s in statements(words(c), known, concept)]
    with_concept = [s for s in told if set(s) & concept]
    paid = concept is QUALIFIERS[1] and bool(set(condition) & QUALIFIERS[0])
    asked = polarities(condition, concept)
    if not asked:  # the claim drops "only" where the evidence pays under it
        return not (paid and any(set(s) & QUALIFIERS[0] and any(names(s, k, v) for k, v in claimed.items()) for s in with_concept))
    met = all(any(names(s, k, v) and polarities(s, concept) & asked for s in with_concept) for k, v in claimed.items())
    qualified = any(names(s, k, v) for s in with_concept for k, v in known.items())
    return met or not (paid or qualified)


# ---- judgements

JUDGEMENTS = [frozenset(x.split()) for x in (
    "essential critical vital necessary nonessential unnecessary", "ensure ensures ensuring guarantee guarantees", "important importance unimportant", "effective effectiveness ineffective ineffectiveness",
    "safe safety unsafe", "healthy health unhealthy",
)]
DENYING = frozenset("nonessential unnecessary unimportant ineffective ineffectiveness unsafe unhealthy".split())
LINKS = frozenset("is are was were be been being seems seemed remains remained isn aren wasn weren".split())
_JUDGING = frozenset().union(*JUDGEMENTS)
_ACTIVE = JUDGEMENTS[1]


@dataclass(frozen=True)
class Judgement:
    subject: tuple[str, ...]
    denied: bool


def judgements(clause: str, concept: frozenset[str]) -> list[Judgement]:
    """What a clause judges by a concept, and whether it denies it: the words before the last link, behind an earlier judgement's and."""
    w = words(clause)
    out = []
    for i, t in enumerate(w):
        if t not in concept:
            continue
        end = i if t in _ACTIVE else next((k for k in range(i - 1, -1, -1) if w[k] in LINKS), None)
        if end is None:
            continue
        earlier = [k for k in range(end) if w[k] in _JUDGING]
        start = 0
        if earlier:
            joint = next((k for k in range(end - 1, earlier[-1], -1) if w[k] in ("and", "or", "but", "while", "whereas")), None)
            if joint is not None and joint + 1 < end:
                start = joint + 1
        about = w[start:end]
        if t in _ACTIVE:
            while about and (about[-1] in _MODALS or about[-1] in ("do", "does", "did", "not", "never")):
                about = about[:-1]
        elif any(x in _JUDGING for x in about):
            first = next(k for k, x in enumerate(about) if x in _JUDGING)
            link = next((k for k in range(first - 1, -1, -1) if about[k] in LINKS), None)
            about = about if link is None else about[:link]
        about = about[1:] if about[:1] and about[0] in ("a", "an", "the", "this", "these", "that", "those") else about
        if about and about not in (["it"], ["they"], ["he"], ["she"]):
            out.append(Judgement(tuple(about), negated(w[max(0, end - 3) : i + 1]) ^ (t in DENYING)))
    return out


def judgements_supported(claim: str, evidence: list[str]) -> bool:
    """A judgement on something that the evidence cites, by a concept that it judges by, is one of its own."""
    quoted = [words(e) for e in evidence]
    for concept in JUDGEMENTS:
        known = [j for e in evidence for c in sentences(e) if set(words(c)) & concept for j in judgements(c, concept)]
        if not known:
            continue
        backed = lambda s, denied: any(denied == j.denied and (j.subject == s or s in _parts(j.subject, "and")) for j in known)
        for c in sentences(claim):
            for j in judgements(c, concept):
                several = _parts(j.subject, "and")
                if any(holds(q, list(j.subject)) for q in quoted):
                    if not backed(j.subject, j.denied):
                        return False
                elif len(several) > 1 and all(any(holds(q, list(s)) for q in quoted) for s in several) and not all(backed(s, j.denied) for s in several):
                    return False
    return True


# ---- obligations

STRONG, WEAK = frozenset("must shall will require requires required".split()), frozenset("may can could might should".split())
_EXPANDED = {"cannot": "can not", "couldn t": "could not", "mayn t": "may not", "mightn t": "might not", "mustn t": "must not", "shalln t": "shall not", "shouldn t": "should not", "won t": "will not", "wouldn t": "would not", "can t": "can not"}
_FILL = frozenset("be to the a an also always only then have has".split())


def obligations(text: str, modals: frozenset[str]) -> list[tuple[tuple[str, ...], str, bool]]:
    """(subject, what is done, denied) for each modal of a text. The subject is the last two words before it, articles aside."""
    out = []
    for clause in re.split(r"[.?!;,\n\r]", text):
        told = f" {' '.join(words(clause))} "
        for short, long in _EXPANDED.items():
            told = told.replace(f" {short} ", f" {long} ")
        w = told.split()
        for i, t in enumerate(w):
            if t in modals:
                rest = [x for x in w[i + 1 :] if x not in _FILL]
                denied = rest[:1] in (["not"], ["never"])
                done = next((x for x in rest if x not in ("not", "never")), None)
                if done:
                    out.append((tuple(x for x in w[:i] if x not in _POINTERS)[-2:], re.sub(r"(?:ed|ing|s)$", "", done), denied))
    return out


def obligations_supported(claim: str, evidence: list[str]) -> bool:
    """What a claim makes an obligation isn't a mere permission in the evidence, nor one in the other sense."""
    weak, strong = ([o for e in evidence for o in obligations(e, m)] for m in (WEAK, STRONG))
    for who, done, denied in obligations(claim, STRONG):
        about = lambda o: o[1] == done and (not o[0] or not who or o[0][-1] == who[-1])
        if any(map(about, [*weak, *strong])) and not any(about(o) and o[2] == denied for o in strong):
            return False
    return True


GUARDS = {
    "numbers": numbers_supported, "enumeration": enumeration_supported, "directions": directions_supported, "conditions": conditions_supported, "judgements": judgements_supported, "obligations": obligations_supported,
}


def broken(claim: str, evidence: list[str]) -> list[str]:
    """The guards that a claim doesn't pass, in order."""
    return [name for name, supported in GUARDS.items() if not supported(claim, evidence)]
