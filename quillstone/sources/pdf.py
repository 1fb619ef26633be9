"""A small reader of PDF files, pure Python over bytes, for two parsers: native text page by page, and tagged scans.

It reads plain and compressed object streams, Flate-coded content, simple fonts and ToUnicode maps; anything else gives a
page without text, which is sent to visual processing. Encrypted files aren't read. Each file is one Arrow row.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGES, DECODED, TEXT = 100, 2 << 20, 256 << 10
_SPACE = b"\x00\t\n\x0c\r "
_TOKEN = re.compile(rb"%[^\r\n]*|<<|>>|[\[\]{}]|/[^\x00\t\n\x0c\r ()<>\[\]{}/%]*|<[0-9A-Fa-f\x00\t\n\x0c\r ]*>|\(|[^\x00\t\n\x0c\r ()<>\[\]{}/%]+")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Name(str):
    """A name, apart from strings of text."""


class Ref(tuple):
    """(number, generation) of another object."""


class Operator(str):
    """A word that is no value."""


class BadPdf(Exception):
    """The bytes aren't what the reader takes."""


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    out, depth, i = bytearray(), 1, at
    while i < len(data):
        c = data[i : i + 1]
        if c == b"\\":
            if m := re.compile(rb"[0-7]{1,3}").match(data, i + 1):
                out.append(int(m[0], 8) & 255)
                i = m.end()
                continue
            after = data[i + 1 : i + 2]
            if after in (b"\r", b"\n"):
                i += 3 if data[i + 1 : i + 3] == b"\r\n" else 2
                continue
            out += _ESCAPES.get(after, after)
            i += 2
            continue
        depth += (c == b"(") - (c == b")")
        if not depth:
            return bytes(out), i + 1
        out += c
        i += 1
    raise BadPdf("a string without its end")


def values(data: bytes, at: int = 0) -> Iterator[tuple[object, int]]:
    """The values and operators that stand in bytes one after the other, each with where it ends."""
    stack: list[list] = []
    kinds: list[bytes] = []

    def number(t: bytes):
        try:
            return int(t)
        except ValueError:
            try:
                return float(t)
            except ValueError:
                return {b"true": True, b"false": False, b"null": None}.get(t, Operator(t.decode("latin-1")))

    while m := _TOKEN.search(data, at):
        t, at = m[0], m.end()
        if t.startswith(b"%"):
            continue
        if t in (b"<<", b"[", b"{"):
            stack.append([])
            kinds.append(t)
            continue
        if t in (b">>", b"]", b"}"):
            if not stack:
                continue
            held = stack.pop()
            value = {str(k): v for k, v in zip(held[::2], held[1::2])} if kinds.pop() == b"<<" else held
        elif t == b"(":
            value, at = _string(data, at)
        elif t.startswith(b"<"):
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", t)
            value = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        elif t.startswith(b"/"):
            value = Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes.fromhex(x[1].decode()), t[1:]).decode("latin-1"))
        else:
            value = number(t)
        if stack:
            if value == "R" and isinstance(value, Operator) and len(stack[-1]) >= 2:
                value = Ref((stack[-1][-2], stack[-1][-1]))
                del stack[-1][-2:]
            stack[-1].append(value)
        else:
            yield value, at


class Pdf:
    """The objects of a file by their numbers. The last one of a number counts."""

    def __init__(self, data: bytes):
        if not data.startswith(b"%PDF-"):
            raise BadPdf("no signature")
        self.objects: dict[int, object] = {}
        self.streams: dict[int, bytes] = {}
        self.trailer: dict = {}
        self.decoded = 0
        for m in re.finditer(rb"(\d+)[\x00\t\n\x0c\r ]+\d+[\x00\t\n\x0c\r ]+obj\b", data):
            value, end = next(values(data, m.end()), (None, m.end()))
            self.objects[int(m[1])] = value
            if isinstance(value, dict) and (s := re.compile(rb"[\x00\t\n\x0c\r ]*stream\r?\n").match(data, end)):
                length = value.get("Length")
                stop = s.end() + length if isinstance(length, int) and data[s.end() + length :].lstrip(_SPACE).startswith(b"endstream") else data.find(b"endstream", s.end())
                self.streams[int(m[1])] = data[s.end() : stop]
                if value.get("Type") == "XRef":
                    self.trailer |= value
        for m in re.finditer(rb"\btrailer\b", data):
            value = next(values(data, m.end()), ({}, 0))[0]
            self.trailer |= value if isinstance(value, dict) else {}
        if "Encrypt" in self.trailer:
            raise BadPdf("encrypted")
        for n in [n for n, v in self.objects.items() if isinstance(v, dict) and v.get("Type") == "ObjStm"]:
            body, v = self.stream(n), self.objects[n]
            first = [x for x, _ in values(body[: v["First"]])]
            for number, offset in zip(first[::2], first[1::2]):
                self.objects.setdefault(number, next(values(body, v["First"] + offset), (None, 0))[0])

    def get(self, value):
        for _ in range(20):
            if not isinstance(value, Ref):
                return value
            value = self.objects.get(value[0])
        raise BadPdf("references in a ring")

    def stream(self, n: int) -> bytes:
        v, raw = self.objects.get(n), self.streams.get(n)
        if raw is None:
            raise BadPdf("no stream")
        filters = self.get(v.get("Filter")) or []
        for f in [filters] if isinstance(filters, str) else filters:
            if self.get(f) != "FlateDecode":
                raise BadPdf(f"a {f} stream")
            try:
                raw = zlib.decompressobj().decompress(raw, 64 << 20)
            except zlib.error as e:
                raise BadPdf("a damaged stream") from e
        self.decoded += len(raw)
        return raw

    def pages(self) -> list[tuple[int | None, dict]]:
        """(number, dictionary with what is inherited) of every page in order."""
        out: list = []

        def walk(ref, above: dict, depth: int) -> None:
            node = self.get(ref)
            if not isinstance(node, dict) or depth > 50 or len(out) > 100_000:
                raise BadPdf("no page tree")
            node = {k: v for k, v in above.items() if k in ("Resources", "MediaBox")} | node
            if node.get("Type") == "Pages" or "Kids" in node:
                for kid in self.get(node.get("Kids")) or []:
                    walk(kid, node, depth + 1)
            else:
                out.append((ref[0] if isinstance(ref, Ref) else None, node))

        root = self.get(self.trailer.get("Root")) or next((v for v in self.objects.values() if isinstance(v, dict) and v.get("Type") == "Catalog"), None)
        if not isinstance(root, dict):
            raise BadPdf("no catalog")
        walk(root.get("Pages"), {}, 0)
        return out

    def contents(self, page: dict) -> list[bytes]:
        held = page.get("Contents")
        refs = held if isinstance(held, list) else self.get(held) if isinstance(self.get(held), list) else [held]
        return [self.stream(r[0]) for r in refs if isinstance(r, Ref)]


def _unicode_map(pdf: Pdf, font: dict) -> tuple[dict[bytes, str], int]:
    ref = font.get("ToUnicode")
    if not isinstance(ref, Ref):
        return {}, 1
    told, held, out = pdf.stream(ref[0]), [], {}
    wide = lambda b: b.decode("utf-16-be", "replace")
    for v, _ in values(told):
        if v == "endbfchar" and isinstance(v, Operator):
            out |= {a: wide(b) for a, b in zip(held[::2], held[1::2])}
        elif v == "endbfrange" and isinstance(v, Operator):
            for lo, hi, to in zip(held[::3], held[1::3], held[2::3]):
                for i in range(min(int.from_bytes(hi) - int.from_bytes(lo) + 1, 65_536)):
                    code = (int.from_bytes(lo) + i).to_bytes(len(lo))
                    out[code] = wide(to[i]) if isinstance(to, list) else wide((int.from_bytes(to) + i).to_bytes(len(to)))
        if isinstance(v, Operator):
            held = []
        elif isinstance(v, (bytes, list)):
            held.append(v)
    return out, max(map(len, out), default=1)


def page_text(pdf: Pdf, page: dict) -> str:
    """The strings that a page shows, in the order of its content; a move to another line is a line end, a wide gap a space."""
    resources = pdf.get(page.get("Resources")) or {}
    fonts = {k: _unicode_map(pdf, pdf.get(v) or {}) for k, v in (pdf.get(resources.get("Font")) or {}).items()}
    out: list[str] = []
    table: tuple[dict[bytes, str], int] = ({}, 1)
    line = 0.0

    def show(b) -> None:
        if isinstance(b, bytes):
            known, width = table
            out.append("".join(known.get(b[i : i + width], b[i : i + width].decode("cp1252", "ignore") if width == 1 else "") for i in range(0, len(b), width)))

    def feed() -> None:
        if out and not out[-1].endswith("\n"):
            out.append("\n")

    args: list = []
    for v, _ in values(b"\n".join(pdf.contents(page))):
        if not isinstance(v, Operator):
            args.append(v)
            continue
        if v == "Tf" and args:
            table = fonts.get(str(args[0]), ({}, 1))
        elif v in ("Td", "TD") and len(args) >= 2 and args[1] or v in ("T*", "'", '"', "ET"):
            feed()
        elif v == "Tm" and len(args) >= 6:
            if args[5] != line:
                feed()
            line = args[5]
        if v in ("Tj", "'", '"') and args:
            show(args[-1])
        elif v == "TJ" and args and isinstance(args[-1], list):
            for x in args[-1]:
                if isinstance(x, (int, float)) and x < -200:
                    out.append(" ")
                else:
                    show(x)
        args = []
    return re.sub(r"[ \t]+\n", "\n", "".join(out)).strip("\n")


def native_pages(data: bytes) -> list[str]:
    """The text of every page; a page that can't be read has none."""
    pdf = Pdf(data)
    out = []
    for _, page in pdf.pages():
        try:
            out.append(page_text(pdf, page))
        except BadPdf:
            out.append("")
    return out


def classic_table(data: bytes) -> bool:
    """The file ends with startxref, the place of one plain cross-reference table, and its end mark, and with nothing else."""
    m = re.search(rb"startxref[\x00\t\n\x0c\r ]*(\d+)[\x00\t\n\x0c\r ]*%%EOF[\x00\t\n\x0c\r ]*\Z", data[-2048:])
    if not m:
        return False
    begin, end = int(m[1]), len(data) - len(data[-2048:]) + m.start()
    held = data[begin:end]
    return begin < end and re.match(rb"xref[\x00\t\n\x0c\r ]", held) is not None and not any(x in held for x in (b"/Prev", b"/XRefStm", b"#"))


def tagged_pages(data: bytes) -> list[str]:
    """The text of a scan's pages, as its tags have it: Document, a Sect for each page, paragraphs and tables of spans with their
    actual text, without separators. Every span marks content of its page, and every mark has its span. BadPdf for anything else."""
    if not classic_table(data):
        raise BadPdf("no classic cross-reference table")
    pdf = Pdf(data)
    pages, get = pdf.pages(), pdf.get
    root = get(pdf.trailer.get("Root")) or {}
    if not 0 < len(pages) <= PAGES or (get(root.get("MarkInfo")) or {}).get("Marked") is not True:
        raise BadPdf("not a tagged scan")

    def need(ok) -> None:
        if not ok:
            raise BadPdf("tags out of their order")

    def kids(node: dict) -> list[Ref]:
        held = get(node.get("K"))
        held = [node["K"]] if isinstance(node.get("K"), Ref) and not isinstance(held, list) else held
        need(isinstance(held, list) and held and all(isinstance(x, Ref) for x in held))
        return held

    def node(ref: Ref, role: tuple[str, ...], parent: Ref, page: int | None) -> dict:
        found = get(ref)
        need(isinstance(found, dict) and found.get("S") in role and found.get("P") == parent and (page is None or found.get("Pg") is not None and found["Pg"][0] == page))
        return found

    tree_ref = root.get("StructTreeRoot")
    need(isinstance(tree_ref, Ref))
    tree = get(tree_ref)
    top = kids(tree)
    need(len(top) == 1)
    sections = kids(node(top[0], ("Document",), tree_ref, None))
    need(len(sections) == len(pages))
    numbers = get((get(tree.get("ParentTree")) or {}).get("Nums")) or []
    owners = dict(zip(numbers[::2], map(get, numbers[1::2])))
    out = []
    for i, ((number, page), section) in enumerate(zip(pages, sections)):
        need(page.get("StructParents") == i)
        owner, text, seen = owners.get(i) or [], [], set()

        def span(ref: Ref, parent: Ref, number=number, owner=owner, text=text, seen=seen) -> None:
            found = node(ref, ("Span",), parent, number)
            mark, told = get(found.get("K")), get(found.get("ActualText"))
            need(isinstance(mark, int) and 0 <= mark < len(owner) and owner[mark] == ref and mark not in seen and isinstance(told, bytes))
            seen.add(mark)
            text.append(told[2:].decode("utf-16-be") if told.startswith(b"\xfe\xff") else told.decode("latin-1"))

        for block in kids(node(section, ("Sect",), top[0], number)):
            found = node(block, ("P", "Table"), section, number)
            if found["S"] == "P":
                for s in kids(found):
                    span(s, block)
                continue
            for row in kids(found):
                for cell in kids(node(row, ("TR",), block, number)):
                    spans = kids(node(cell, ("TH", "TD"), row, number))
                    need(len(spans) == 1)
                    span(spans[0], cell)
        marks = {args[1]["MCID"] for args in _marked(b"\n".join(pdf.contents(page))) if isinstance(args[1], dict) and "MCID" in args[1]}
        need(seen == set(range(len(owner))) == marks and "".join(text).strip() and pdf.decoded <= DECODED)
        out.append("".join(text))
    if sum(len(t.encode()) for t in out) > TEXT:
        raise BadPdf("too much text")
    return out


def _marked(content: bytes) -> Iterator[list]:
    args: list = []
    for v, _ in values(content):
        if isinstance(v, Operator):
            if v == "BDC" and len(args) >= 2:
                yield args[-2:]
            args = []
        else:
            args.append(v)


class _Reader:
    """A parser over documents (document_id, content)."""

    version = "1.0.0"

    def __init__(self, id_: str, read):
        self.id, self.read = id_, read

    def transform(self, documents: DataFrame) -> DataFrame:
        """A row for each page; a document that can't be read has one blank page with a warning."""
        read = self.read

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lo in range(b.num_rows):
                    one = b.slice(lo, 1)
                    try:
                        texts, why = read(one.column(1)[0].as_py() or b""), None
                    except (BadPdf, KeyError, TypeError, ValueError, IndexError, RecursionError) as e:
                        texts, why = [""], f"UNREADABLE: {e}"[:200]
                    key = one.column(0)[0].as_py()
                    warnings = [[why] if why else ["NO_NATIVE_TEXT"] if not t.strip() else [] for t in texts]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key] * len(texts), pa.string()), pa.array(range(1, len(texts) + 1), pa.int64()), pa.array([t.replace("\0", "") for t in texts], pa.string()), pa.array([not t.strip() for t in texts], pa.bool_()), pa.array(warnings, pa.list_(pa.string()))],
                        ["document_id", "page_number", "text", "visual", "warnings"],
                    )

        schema = "document_id string, page_number long, text string, visual boolean, warnings array<string>"
        return documents.select(F.col("document_id").cast("string").alias("document_id"), "content").mapInArrow(run, schema)


def native_parser() -> _Reader:
    return _Reader("native-text", native_pages)


def tagged_parser() -> _Reader:
    return _Reader("tagged-scan", tagged_pages)
