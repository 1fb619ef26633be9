"""Text expressions: cleanup, keys, excerpts, labels and predicates. All are built-in column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values, all down to CLAIM_LIMIT: white space of Unicode; words that give a sentence legal force; names; markings; verbs.
BLANK = "[\\t-\\r \\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"
OPERATIVE = ("shall", "must", "may", "unless", "except", "provided", "if", "when", "requires", "required")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
LABELS = ("confidential", "internal use only", "draft")
TITLE_KINDS = ("agreement", "contract", "report", "manual", "guide")
CONNECTORS = ("and", "or", "of", "the", "to", "for", "in", "with", "a", "an")
NEGATIONS = ("not", "no", "never", "without", "cannot")
BEFORE_T = ("isn", "aren", "wasn", "weren", "don", "doesn", "didn", "won", "wouldn", "shouldn", "couldn", "mustn", "hasn", "haven", "hadn", "can")
CLAIM_LIMIT = 384


def cleanup(s: Column) -> Column:
    """Line ends become \\n and NUL goes; nothing else changes."""
    return F.translate(F.regexp_replace(s, "\r\n?", "\n"), "\0", "")


def trimmed(s: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(s, f"^{BLANK}|{BLANK}$", "")


def collapsed(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, BLANK, " "))


def key(s: Column) -> Column:
    """Lower case with white space collapsed."""
    return F.lower(collapsed(s))


def repeated_key(s: Column) -> Column:
    """The key without ASCII digits: lines that differ by a number alone share it."""
    return key(F.regexp_replace(s, "[0-9]", ""))


def middle_excerpt(s: Column, limit: int) -> Column:
    mark = "\n[…]\n"
    room = limit - len(mark)
    head = (room + 1) // 2
    return F.when(F.length(s) <= limit, s).otherwise(F.concat(F.left(s, F.lit(head)), F.lit(mark), F.right(s, F.lit(room - head))))


def ranking_excerpt(s: Column) -> Column:
    """480 code points at most: whole, or the first 239 and the last 238."""
    return F.when(F.length(s) <= 480, s).otherwise(F.concat(F.left(s, F.lit(239)), F.lit(" … "), F.right(s, F.lit(238))))


def source_label(start: Column, end: Column) -> Column:
    return F.when(start == end, F.concat(F.lit("p. "), start.cast("string"))).otherwise(F.concat(F.lit("pp. "), start.cast("string"), F.lit("–"), end.cast("string")))


def words(s: Column) -> Column:
    return F.filter(F.split(s, BLANK), lambda w: w != "")


def canonical_decimal(s: Column) -> Column:
    """007.50 becomes 7.5 and -0 becomes 0; null for what is no decimal."""
    plain = F.regexp_replace(s, "^\\+", "")
    whole = F.regexp_replace(plain, "^(-?)0+(?=[0-9])", "$1")
    short = F.when(whole.contains("."), F.regexp_replace(F.regexp_replace(whole, "0+$", ""), "\\.$", "")).otherwise(whole)
    return F.when(plain.rlike("^-?[0-9]+(\\.[0-9]+)?$"), F.when(short == "-0", F.lit("0")).otherwise(short))


def valid_filename(s: Column) -> Column:
    return (trimmed(s) != "") & (F.octet_length(s) <= 255) & ~s.rlike("[/\\\\\\x00]") & ~s.isin(".", "..")


def uuid4(s: Column) -> Column:
    return s.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")


def digest(s: Column) -> Column:
    """A SHA-256 in lower-case hexadecimal."""
    return s.rlike("^[0-9a-f]{64}$")


def wire_version(s: Column) -> Column:
    return F.regexp_extract(s, "^([^.]*(\\.[^.]*)?)", 1)


#: Marks around a token, and those around the tokens of a telephone number. Neither set is part of any marker.
AROUND = ",;:!?.\"'“”‘’\\[\\]{}()"
AROUND_PHONE = ",;:!\"'“”‘’"
_SPACES = BLANK[1:-2]
_FIRST, _LAST = f"(?:^|[{_SPACES}])[{AROUND}]*", f"[{AROUND}]*(?![^{_SPACES}])"


def tokens(s: Column) -> Column:
    """White-space tokens without the marks around them."""
    return F.transform(words(s), lambda w: F.regexp_replace(w, f"^[{AROUND}]+|[{AROUND}]+$", ""))


def email_marker(s: Column) -> Column:
    """One regular expression over the whole text, as for the other markers: no array of tokens is made. A character that every
    match holds is looked for first, as most texts have none."""
    return s.contains("@") & s.rlike(f"{_FIRST}[A-Za-z0-9_%+-][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\\.)+[A-Za-z0-9]+{_LAST}")


def numeric_date_marker(s: Column) -> Column:
    """Three fields of one to four digits with / or - between."""
    return s.rlike("[0-9][/-][0-9]") & s.rlike(f"{_FIRST}[0-9]{{1,4}}(?:/[0-9]{{1,4}}/|-[0-9]{{1,4}}-)[0-9]{{1,4}}{_LAST}")


def reference_marker(s: Column) -> Column:
    """5 to 64 ASCII letters, digits and _ / ? . - that start with a letter, with two digits and one of / and -."""
    solid = f"[^{_SPACES}]*"
    return s.rlike("[0-9]") & s.rlike(f"{_FIRST}(?={solid}[0-9]{solid}[0-9])(?={solid}[/-])[A-Za-z][A-Za-z0-9_/?.-]{{4,63}}(?<![.?]){_LAST}")


def material_marker(s: Column) -> Column:
    return email_marker(s) | phone_marker(s) | numeric_date_marker(s) | named_date_marker(s) | reference_marker(s)


def operative(s: Column) -> Column:
    """Holds a word, between characters that aren't letters or digits, that gives a sentence legal force."""
    return key(s).rlike(f"(?<![\\p{{L}}\\p{{N}}])({'|'.join(OPERATIVE)})(?![\\p{{L}}\\p{{N}}])")


#: How a clause opens that qualifies the one before it, and what may close a sentence behind its mark.
QUALIFIERS = ("unless ", "except ", "provided ", "subject to ", "however,", "only if ", "on condition ", "notwithstanding ")
CLOSERS = "\"'”’)\\]}"


def qualification(s: Column) -> Column:
    """Opens with a qualifier, white space and opening brackets aside."""
    return F.lower(s).rlike(f"^[{_SPACES}(\\[]*(?:{'|'.join(QUALIFIERS)})")


def complete(s: Column, value_suffixes: bool = True) -> Column:
    """Ends in one terminal mark behind a letter or digit, closing marks aside; after a digit a value's sign may stand between.
    White space at the end isn't passed over."""
    tail = "[\\p{L}\\p{N}]" + ("|\\p{N}\\s*[%‰‱°\\p{Sc}]" if value_suffixes else "")
    return s.rlike(f"(?:{tail})[{CLOSERS}]*[.!?。！？][{CLOSERS}]*$(?!\n)")


def first_line(s: Column) -> Column:
    """The first line that isn't blank, trimmed."""
    return trimmed(F.regexp_extract(s, f"^(?:{BLANK})?([^\\n]*)", 1))


def _numbered(s: Column) -> tuple[Column, Column, Column]:
    """A line's leading number, what follows it, and whether a heading's title may follow so."""
    line = first_line(s)
    number = F.regexp_extract(line, "^([0-9]+(?:\\.[0-9]+)*)", 1)
    rest = line.substr(F.length(number) + 1, F.length(line))
    marked = (rest == "") | rest.rlike("^[.\\t\\f ]") | (rest.startswith(")") & ~number.contains("."))
    return number, rest, marked & (number != "") & (F.length(line) <= 120)


def heading_title(s: Column) -> Column:
    """What follows a heading's number; empty where nothing does."""
    return trimmed(F.regexp_replace(_numbered(s)[1], "^[.)]", ""))


def conservative_title(title: Column) -> Column:
    """Starts with a capital, has 12 words at most and no final mark of a sentence."""
    return title.rlike("^\\p{Lu}") & (F.size(words(title)) <= 12) & ~title.rlike("[.!?;]$")


def heading_signal(s: Column) -> Column:
    """Numbering of a heading in the first line that isn't blank, as an array of numbers; null where there is none.

    At most 120 code points and 6 levels of 1 to 999; "1)" at the first level alone; a number may stand without a title.
    """
    number, _, marked = _numbered(s)
    parts = F.transform(F.split(number, "\\."), lambda x: x.try_cast("long"))
    fits = marked & (F.size(parts) <= 6) & F.forall(parts, lambda n: F.coalesce(n.between(1, 999), F.lit(False)))
    title = heading_title(s)
    return F.when(fits & ((title == "") | conservative_title(title)), parts)


def page_number(s: Column, page: Column) -> Column:
    """A line that is the number of its page: n, page n, n of m or n/m with m at least n."""
    line, shape = key(s), "^(?:page )?([0-9]+)(?:(?: of | / |/)\\+?([0-9]+))?$"
    total = F.regexp_extract(line, shape, 2)
    return (F.regexp_extract(line, shape, 1) == page.cast("string")) & ((total == "") | F.coalesce(total.try_cast("long") >= page, F.lit(False)))


def numbered_line(s: Column) -> Column:
    """A line that opens with a heading's number, section signs before it or not, and goes on with a capital."""
    return trimmed(s).rlike("^§*\\s*[0-9]+(\\.[0-9]+)*[.)]*\\s+\\p{Lu}")


def running_label(s: Column, page: Column) -> Column:
    """A short unpunctuated line of no legal force: a marking, a label before its page number, or a document's title in capitals."""
    line = trimmed(s)
    plain = (F.octet_length(line) <= 120) & (F.size(words(line)) <= 12) & ~numbered_line(line) & ~operative(line) & ~line.rlike("[.;!?$€]")
    parts = F.regexp_extract(key(line), "^.* \\| (.*)$", 1)
    title = ~line.rlike("\\p{L}(?<!\\p{Lu})") & key(line).rlike(f"({'|'.join(TITLE_KINDS)})$")
    return plain & (key(line).isin(*LABELS) | ((parts != "") & page_number(parts, page)) | title)


def filing_label(s: Column) -> Column:
    """exhibit and an identifier of dotted ASCII letters and digits, with a digit."""
    return key(s).rlike("^exhibit (?=[^ ]*[0-9])[a-z0-9]+(\\.[a-z0-9]+)*$")


#: An optional weekday, a month, a day from 1 to 31 and a year of four digits, in a key.
DATE = f"(?:(?:{'|'.join(WEEKDAYS)}),* )?(?:{'|'.join(MONTHS)}) \\+?0*(?:[1-9]|[12][0-9]|3[01]),* [0-9]{{4}}"


def date_label(s: Column) -> Column:
    return key(s).rlike(f"^{DATE}$")


def metadata_key(s: Column) -> Column:
    """What a line of running metadata has in common with that of other pages, and whether it marks a footer for certain:
    struct(key, strong), null for any other line. A page's own numbers become #; filing numbers, dates and numbers in text stay."""
    k = key(s)
    page = "^((?:(?!page )[^ ]+ )*)page \\+?([0-9]+)((?: (?:of|/) [0-9]+)?)((?: DATE)?)$".replace("DATE", DATE)
    before, n, of, date = (F.regexp_extract(k, page, i) for i in (1, 2, 3, 4))
    total = F.regexp_extract(of, "([0-9]+)$", 1).try_cast("long")
    counted = k.rlike(page) & (n.try_cast("long") > 0) & F.coalesce(total >= n.try_cast("long"), of == "")
    title = f"(?:{'|'.join(TITLE_KINDS)})$"
    prefix = F.regexp_extract(k, "^(.*) \\+?0*[1-9][0-9]*$", 1)
    found = lambda key_, strong: F.struct(key_.alias("key"), (strong if isinstance(strong, Column) else F.lit(strong)).alias("strong"))
    return (
        F.when((k == "") | (F.octet_length(trimmed(s)) > 180) | (F.size(words(s)) > 20), None)
        .when(filing_label(s), found(k, False))
        .when(k.rlike(f"^\\+?0*[1-9][0-9]* {DATE}$"), found(F.concat(F.lit("# "), F.regexp_replace(k, "^[^ ]+ ", "")), True))
        .when(k.rlike(f"^{DATE}$"), found(k, True))
        .when(operative(s) | numbered_line(s) | s.rlike("[;!?$€]"), None)
        .when(k.rlike("(^| )page( |$)"), F.when(counted, found(F.concat(before, F.lit("page #"), of, date), (before != "") | (date != ""))))
        .when(s.contains("."), None)
        .when(k.isin(*LABELS) | k.rlike(title), found(k, False))
        .when((prefix != "") & F.regexp_replace(prefix, "[ |]+$", "").rlike(title), found(F.concat(prefix, F.lit(" #")), True))
    )


def named_date_marker(s: Column) -> Column:
    """Month, day and year in three tokens that follow each other, marks around them aside."""
    between = f"[{AROUND}]*[{_SPACES}]+[{AROUND}]*"
    return s.rlike("[0-9]") & s.rlike(f"{_FIRST}(?i:{'|'.join(MONTHS)}){between}[0-9]{{1,2}}{between}(?:[0-9]{{2}}|[0-9]{{4}}){_LAST}")


def date_stamp(s: Column) -> Column:
    """A whole page that is a date and a stamp: 03/10/03 A-4."""
    return (F.length(s) <= 32) & trimmed(s).rlike("^[0-9]{1,2}/[0-9]{1,2}/([0-9]{2}|[0-9]{4})\\s+[A-Za-z]{1,2}-[0-9]{1,3}$")


def multi_letter_word(s: Column) -> Column:
    """Two letters together; combining marks may stand between."""
    return s.rlike("\\p{L}\\p{M}*\\p{L}")


def filing_header(s: Column) -> Column:
    """The line above a filed exhibit: EX- and a dotted number, a number, a file name."""
    n = F.size(words(s))
    return n.between(3, 30) & ~operative(s) & trimmed(s).rlike("^EX-[0-9]+(\\.[0-9]+)*\\s+[0-9]+\\s+[A-Za-z0-9._-]*\\.(?i:html?|txt)(\\s|$)")


#: A decimal number, and the units of one letter that make it a value.
NUMBER = "[+-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
UNITS = "lLmgsAVWJKCF"
MARKED_NUMBER = f"[|;,]*{NUMBER}[|;,]*"


def numeric_content(s: Column) -> Column:
    """Numbers that say something: with a currency, a percentage, a comparison or a unit, two digits in a row, two numbers in a line, or nothing else."""
    compared = f"(?:^|\\s)[|;,]*(?:<=|>=|!=|[<>=≤≥≠])(?:[|;,]*\\s+[|;,]*)?{NUMBER}[|;,]*(?:\\s|$)"
    valued = f"(?:^|\\s){NUMBER}\\s*[{UNITS}](?:\\s|$)"
    two = f"(?m)(?:^|[ \\t]){MARKED_NUMBER}[ \\t](?:.*[ \\t])?{MARKED_NUMBER}[ \\t]*$|(?:^|[ \\t]){MARKED_NUMBER}[ \\t](?:.*[ \\t])?{MARKED_NUMBER}[ \\t]"
    alone = s.rlike("\\p{N}") & (s.rlike("[\\p{Sc}%‰‱°]") | s.rlike("^[\\p{N}\\s+.,/:()-]*$"))
    return alone | s.rlike(compared) | s.rlike(valued) | s.rlike("\\p{N}{2}") | s.rlike("(?m)^\\s*\\p{N}+\\s*$") | s.rlike(two)


def page_class(s: Column) -> Column:
    """date_page_stamp; scan_noise, a page of which four fifths are punctuation, symbols or controls; null for pages that are kept."""
    line = trimmed(s)
    solid = F.regexp_replace(line, "\\s", "")
    noise = F.length(F.regexp_replace(solid, "[^\\p{P}\\p{S}\\p{Cc}]", ""))
    kept = multi_letter_word(line) | numeric_content(line) | solid.rlike("[\\p{Cn}\\p{Co}\\p{Cf}]")
    return F.when(solid == "", None).when(date_stamp(line), "date_page_stamp").when(~kept & (noise * 5 >= F.length(solid) * 4), "scan_noise")


def phone_marker(s: Column, question: bool = True) -> Column:
    """One to three tokens of digits and + - ( ) . together, with 7 to 15 digits and one of + - ( ). question: ? around a token goes too."""
    around = f"[{AROUND_PHONE}{'?' if question else ''}]*"
    token = f"{around}[0-9+().-]+{around}"
    # Stretches of such tokens are rare and short; only they are taken apart.
    found = F.regexp_extract_all(s, F.lit(f"(?:^|[{_SPACES}])({token}(?:[{_SPACES}]+{token})*)(?![^{_SPACES}])"), F.lit(1))

    def dials(stretch: Column) -> Column:
        w = F.transform(words(stretch), lambda x: F.regexp_replace(x, "[^0-9+().-]", ""))
        groups = F.flatten(F.transform(w, lambda _, i: F.transform(F.sequence(F.lit(1), F.least(F.lit(3), F.size(w) - i)), lambda k: F.array_join(F.slice(w, i + 1, k), ""))))
        return F.exists(groups, lambda x: F.length(F.regexp_replace(x, "[^0-9]", "")).between(7, 15) & x.rlike("[+()-]"))

    return F.when(s.rlike("[0-9]"), F.exists(found, dials)).otherwise(F.lit(False))


def label_value(s: Column) -> Column:
    """The value of a "label: value" line; null where the label isn't 1 to 8 words, or opens with a number."""
    label, value = F.regexp_extract(trimmed(s), "^([^:]*):", 1), F.regexp_extract(trimmed(s), "(?s)^[^:]*:(.*)$", 1)
    fits = F.size(words(label)).between(1, 8) & label.rlike("^[^\\p{L}\\p{N}]*\\p{L}") & label.rlike("^[\\p{L}\\p{N}\\s/()'’&#-]+$")
    return F.when(fits & (trimmed(value) != ""), value)


def clause_title(s: Column) -> Column:
    """Words in title case or capitals, connectors aside; a final full stop or colon doesn't count."""
    line = F.regexp_replace(trimmed(s), "[.:]$", "")
    parts = F.filter(F.split(line, "[^\\p{L}]+"), lambda w: w != "")
    each = F.forall(parts, lambda w: w.isin(*CONNECTORS) | w.rlike("^(\\p{Lu}+|\\p{Lu}\\p{Ll}*)$"))
    return line.rlike("^[\\p{L}\\s&/'-]+$") & F.exists(parts, lambda w: w.rlike("^\\p{Lu}")) & each


def negation(s: Column) -> Column:
    """A negating word, "not only" aside, or a verb with n't."""
    w = F.filter(F.split(F.lower(s), "[^\\p{L}\\p{N}]+"), lambda x: x != "")
    after = lambda i: F.coalesce(F.get(w, i + 1), F.lit(""))
    return F.exists(F.transform(w, lambda x, i: (x.isin(*NEGATIONS) & ~((x == "not") & (after(i) == "only"))) | (x.isin(*BEFORE_T) & (after(i) == "t"))), lambda x: x)


def clipped(s: Column, ceiling: int) -> Column:
    """Ends at the ceiling exactly, before its sentence does."""
    return (F.length(s) == ceiling) & ~s.rlike("^\\s") & (trimmed(s) != "") & ~complete(s)


def paraphrase_violations(s: Column) -> Column:
    """What a paraphrase breaks, in this order: not trimmed or empty, too long, no complete sentence."""
    rules = (("nonempty_already_trimmed_text", (s == "") | (trimmed(s) != s)), ("maximum_claim_characters", F.length(s) > CLAIM_LIMIT), ("complete_sentence_terminal_punctuation_no_cutoff", ~complete(s)))
    return F.filter(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules]), lambda x: x.isNotNull())


NUL = "\0"


def number32(n: Column) -> Column:
    """Four bytes, the highest first."""
    return F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0"))


def tagged_hash(prefix: str, *parts: Column | str) -> Column:
    """prefix and the SHA-256 of the parts' bytes one after the other."""
    as_bytes = lambda p: F.encode(F.lit(p), "UTF-8") if isinstance(p, str) else p
    return F.concat(F.lit(prefix), F.sha2(F.concat(*map(as_bytes, parts)), 256))


def block_id(document_id: Column, version: str, page: Column, index: Column) -> Column:
    """SHA-256 over a tag, NUL separators and big-endian 32-bit numbers."""
    return tagged_hash("nb-", "normalized-block\0", F.encode(document_id, "UTF-8"), f"\0{version}\0", number32(page), number32(index))


def node_id(document_id: Column, version: str, kind: Column, level: Column, path: Column, title: Column, block_ids: Column) -> Column:
    """The same over a node's kind, level, path, title and blocks."""
    steps = F.unhex(F.array_join(F.transform(path, lambda n: F.lpad(F.hex(n.cast("long")), 8, "0")), ""))
    return tagged_hash("sn-", "structure-node\0", F.encode(document_id, "UTF-8"), f"\0{version}\0", F.encode(kind, "UTF-8"), number32(level), steps, NUL, F.encode(F.concat(F.coalesce(title, F.lit("")), joined_after(block_ids)), "UTF-8"))


def chunk_id(document_id: Column, version: str, ordinal: Column, node: Column, block_ids: Column, text: Column) -> Column:
    """The same over a chunk's place, node, blocks and text."""
    return tagged_hash("ch-", "document-chunk\0", F.encode(document_id, "UTF-8"), f"\0{version}\0", number32(ordinal), F.encode(F.concat(node, joined_after(block_ids), F.lit(NUL), text), "UTF-8"))


def joined_after(values: Column) -> Column:
    """A NUL before each of the strings."""
    return F.array_join(F.transform(values, lambda v: F.concat(F.lit(NUL), v)), "")


#: Words that say or demand something, and small words of a title.
PROHIBITED = (
    "must", "shall", "may", "should", "not", "no", "except", "unless", "only", "required", "prohibited", "mandatory", "is", "are", "was", "were", "be", "has", "have", "will",
    "can", "cannot", "pay", "file", "submit", "retain", "keep", "wear", "apply", "applies", "do", "does", "never", "always", "due", "exempt", "excludes", "includes",
)
SMALL = ("of", "in", "and", "the", "for", "to", "on", "a", "an")


def heading_admitted(s: Column) -> Column:
    """Short text shaped like a title: 2 to 12 words in title case, letters alone, none of which says or demands anything."""
    line, w = trimmed(s), words(s)
    each = F.forall(w, lambda x: ~F.lower(x).isin(*PROHIBITED) & (x.rlike("^\\p{Lu}") | F.lower(x).isin(*SMALL)))
    return (F.length(line) <= 120) & F.size(w).between(2, 12) & ~line.rlike(f"[^\\p{{IsAlphabetic}}{_SPACES}]") & each


def whole_page(quote: Column, page: Column) -> Column:
    """The quote is the whole page, white space aside."""
    return (trimmed(page) != "") & (words(quote) == words(page))


def omission_admitted(quote: Column, page: Column) -> Column:
    """A page may be left out whole if nothing in it looks like an identifier."""
    return whole_page(quote, page) & ~material_marker(quote)


def profile_of(purpose: Column) -> Column:
    """The profile of summaries that a document's purpose asks for."""
    return F.when(purpose.isin("narrative", "story"), "story").when(purpose.isin("contract", "agreement"), "contract").when(purpose.isNotNull(), "general")


def requested_profile(parameters: Column) -> Column:
    """The profile that a job's parameters name: general where they name none, null for any other value."""
    mode = F.get_json_object(parameters, "$.mode")
    return F.when(mode.isNull(), "general").when(mode.isin("general", "story", "contract"), mode)


def total_usage(body: Column) -> Column:
    """Input and output tokens of a provider's answer together, where it has both."""
    return F.get_json_object(body, "$.prompt_eval_count").try_cast("long") + F.get_json_object(body, "$.eval_count").try_cast("long")


def fingerprint(value: Column) -> Column:
    """SHA-256 over a value as JSON."""
    return F.sha2(F.to_json(value), 256)


#: Names of units.
UNIT_NAMES = {
    "dollar": "dollar dollars usd", "euro": "euro euros eur", "percent": "percent percentage percentages", "application": "application applications", "report": "report reports", "degree": "degree degrees", "unit": "unit units",
    "year": "year years", "day": "day days", "case": "case cases", "worker": "worker workers", "kilogram": "kilogram kilograms kg kgs", "pound": "pound pounds lb lbs", "foot": "foot feet ft", "meter": "meter meters metre metres m",
    "yen": "yen jpy", "rupee": "rupee rupees inr",
}
CURRENCIES = {"$": "dollar", "€": "euro", "£": "pound sterling", "¥": "yen", "₹": "rupee"}


def unit_word(s: Column) -> Column:
    """One name for each unit; other words lose a final s."""
    out = F.regexp_replace(s, "s$", "")
    for name, spelled in UNIT_NAMES.items():
        out = F.when(s.isin(*spelled.split()), F.lit(name)).otherwise(out)
    return out


def currency(s: Column) -> Column:
    out = F.lit(None).cast("string")
    for sign, name in CURRENCIES.items():
        out = F.when(s == sign, F.lit(name)).otherwise(out)
    return out


def acronym(s: Column) -> Column:
    """2 to 10 ASCII capitals, without a plural s."""
    return F.nullif(F.regexp_extract(s, "^([A-Z]{2,10})s?$", 1), F.lit(""))


def decimal_order(a: Column, b: Column) -> Column:
    """-1, 0 or 1 for canonical decimals of any length; null for anything else."""
    shape = "^(-?)([0-9]+)(?:\\.([0-9]+))?$"
    part = lambda s, i: F.regexp_extract(s, shape, i)
    size = lambda s: F.struct(F.length(part(s, 2)).alias("n"), part(s, 2).alias("whole"), part(s, 3).alias("rest"))
    order = lambda x, y: F.when(x < y, -1).when(x > y, 1).otherwise(0)
    # A canonical fraction has no zero at its end, so a longer one that starts alike is the greater, as strings are compared.
    plain = order(size(a), size(b))
    minus = lambda s: part(s, 1) == "-"
    return F.when(a.rlike(shape) & b.rlike(shape), F.when(minus(a) & ~minus(b), -1).when(~minus(a) & minus(b), 1).when(minus(a), -plain).otherwise(plain))


def roman_ordinal(s: Column) -> Column:
    """The number that a canonical Roman or decimal ordinal of 1 to 3999 stands for; null for any other spelling."""
    digits = (("M", 3, 1000), ("C", 2, 100), ("X", 1, 10), ("I", 0, 1))
    shape = "^(M{0,3})(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$"
    five = {"C": ("D", "M"), "X": ("L", "C"), "I": ("V", "X")}
    total = F.lit(0)
    for i, (one, _, unit) in enumerate(digits, 1):
        part = F.regexp_extract(s, shape, i)
        if one == "M":
            total = total + unit * F.length(part)
            continue
        half, ten = five[one]
        total = total + unit * F.when(part == one + ten, 9).when(part == one + half, 4).otherwise(F.length(part) + F.when(part.startswith(half), 4).otherwise(0))
    plain = F.when(s.rlike("^[1-9][0-9]{0,3}$"), s.try_cast("int"))
    return F.when((s != "") & s.rlike(shape), total).when(plain <= 3999, plain)


def contains_sequence(haystack: Column, needle: Column) -> Column:
    """needle, not empty, stands in haystack without a gap."""
    n = F.size(needle)
    return (n > 0) & (F.size(haystack) >= n) & F.exists(F.sequence(F.lit(1), F.greatest(F.size(haystack) - n + 1, F.lit(1))), lambda i: F.slice(haystack, i, n) == needle)
