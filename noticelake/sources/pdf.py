"""Text of PDF files by page, with the standard library: for files whose fonts tell their characters.

Read are plain and deflated streams, object streams, page trees, simple fonts and fonts with a ToUnicode map. Other filters, encrypted
files and scanned pages give no text, so `needs_ocr` flags them.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

REF = rb"(\d+)\s+\d+\s+R"
TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s()<>\[\]{}/%]*|[-+]?\d*\.?\d+|[A-Za-z'\"*]+", re.S)
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
#: A gap in a TJ array, in thousandths of the font's size, that stands for a space.
GAP = -200


@dataclass
class Font:
    """How a string's bytes become characters: by a map of codes of one or two bytes, or by Windows-1252."""

    wide: int = 1
    codes: dict[int, str] = field(default_factory=dict)

    def text(self, raw: bytes) -> str:
        if not self.codes:
            return raw.decode("cp1252", "replace")
        codes = (int.from_bytes(raw[k : k + self.wide]) for k in range(0, len(raw), self.wide))
        return "".join(self.codes.get(c, "") for c in codes)


class Pdf:
    def __init__(self, data: bytes):
        if not data.lstrip()[:5] == b"%PDF-":
            raise ValueError("not a PDF")
        if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", data):
            raise ValueError("encrypted")
        self.objects = {int(m[1]): m[2] for m in re.finditer(rb"(?<!\d)(\d+)\s+\d+\s+obj\b(.*?)\bendobj", data, re.S)}
        for body in list(self.objects.values()):
            if re.search(rb"/Type\s*/ObjStm", body[:400]):
                self.unpack(body)
        self.fonts: dict[int, Font] = {}

    def head(self, number: int) -> bytes:
        """An object without its stream."""
        return re.split(rb"\bstream\r?\n", self.objects.get(number, b""), maxsplit=1)[0]

    def stream(self, body: bytes) -> bytes:
        head, _, raw = (re.split(rb"(\bstream\r?\n)", body, maxsplit=1) + [b"", b""])[:3]
        raw = raw[: raw.rfind(b"endstream")] if b"endstream" in raw else raw
        if b"/FlateDecode" in head or re.search(rb"/Filter\s*\[?\s*/Fl\b", head):
            return zlib.decompressobj().decompress(raw)
        return b"" if b"/Filter" in head else raw

    def unpack(self, body: bytes) -> None:
        first, data = int(re.search(rb"/First\s+(\d+)", body)[1]), self.stream(body)
        numbers = list(map(int, data[:first].split()))
        places = list(zip(numbers[::2], numbers[1::2]))
        for (number, at), (_, end) in zip(places, [*places[1:], (0, len(data) - first)]):
            self.objects.setdefault(number, data[first + at : first + end])

    def refs(self, head: bytes, name: bytes) -> list[int]:
        """The objects that an entry names, one or an array of them."""
        found = re.search(rb"/" + name + rb"\s*(\[[^\]]*\]|" + REF + rb")", head)
        return [int(n) for n in re.findall(REF, found[1])] if found else []

    def pages(self) -> list[int]:
        """Page objects in order: down the tree, or by number if there is none."""
        every = [n for n in self.objects if re.search(rb"/Type\s*/Page\b", self.head(n))]
        root = next((r for n in self.objects if re.search(rb"/Type\s*/Catalog\b", self.head(n)) for r in self.refs(self.head(n), b"Pages")), None)
        found, todo, seen = [], [root] if root is not None else [], set()
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                kids = self.refs(self.head(n), b"Kids")
                todo += reversed(kids)
                if not kids and n in set(every):
                    found.append(n)
        return found or sorted(every)

    def resources(self, page: int) -> bytes:
        """A page's resources, its own or those of a node above."""
        seen = set()
        while page not in seen:
            seen.add(page)
            head = self.head(page)
            if named := self.refs(head, b"Resources"):
                return self.head(named[0])
            if b"/Resources" in head:
                return head[head.index(b"/Resources") :]
            above = self.refs(head, b"Parent")
            if not above:
                break
            page = above[0]
        return b""

    def page_fonts(self, page: int) -> dict[bytes, Font]:
        told = self.resources(page)
        if named := self.refs(told, b"Font"):
            told = b"/Font " + self.head(named[0])
        found = re.search(rb"/Font\s*<<(.*?)>>", told, re.S)
        return {m[1]: self.font(int(m[2])) for m in re.finditer(rb"/([^\s/<>\[\]()]+)\s+" + REF, found[1])} if found else {}

    def font(self, number: int) -> Font:
        if number not in self.fonts:
            maps = self.refs(self.head(number), b"ToUnicode")
            self.fonts[number] = font_of(self.stream(self.objects.get(maps[0], b""))) if maps else Font()
        return self.fonts[number]

    def text(self, page: int) -> str:
        content = b"\n".join(self.stream(self.objects.get(n, b"")) for n in self.refs(self.head(page), b"Contents"))
        return shown(content, self.page_fonts(page))


def font_of(cmap: bytes) -> Font:
    """The characters of a ToUnicode map's codes."""
    char = lambda x: bytes.fromhex(x.decode()).decode("utf-16-be", "replace")
    made = Font()
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        for code, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            made.wide, made.codes[int(code, 16)] = len(code) // 2, char(to)
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for low, high, to, each in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]+)>|\[([^\]]*)\])", block):
            made.wide, first, last = len(low) // 2, int(low, 16), min(int(high, 16), int(low, 16) + 0xFFFF)
            given = re.findall(rb"<([0-9A-Fa-f]+)>", each)
            for k, code in enumerate(range(first, last + 1)):
                if to:
                    made.codes[code] = char(to)[:-1] + chr(ord(char(to)[-1]) + k)
                elif k < len(given):
                    made.codes[code] = char(given[k])
    return made


def string(token: bytes) -> bytes:
    if token.startswith(b"<"):
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    return re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else b"" if m[1][-1:] == b"\n" else ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.S)


def shown(content: bytes, fonts: dict[bytes, Font]) -> str:
    """The text that a page's content shows, a line for each move to another one."""
    out, held, font, height = [], [], Font(), None
    for token in TOKEN.findall(content):
        if token[:1] in b"(<[]/" or re.fullmatch(rb"[-+]?\d*\.?\d+", token):
            held.append(token)
            continue
        if token == b"Tf":
            font = next((fonts[t[1:]] for t in held if t[:1] == b"/" and t[1:] in fonts), Font())
        elif token in (b"T*", b"'", b'"', b"BT"):
            out.append("\n")
        elif token in (b"Td", b"TD", b"Tm"):
            at = held[-1] if held else b"0"
            if token == b"Tm" and at == height:
                out.append(" ")
            elif token == b"Tm" or float(at):
                out.append("\n")
            height = at if token == b"Tm" else height
        if token in (b"Tj", b"'", b'"', b"TJ"):
            for t in held:
                if t[:1] in b"(<":
                    out.append(font.text(string(t)))
                elif token == b"TJ" and t not in (b"[", b"]") and t[:1] != b"/" and float(t) <= GAP:
                    out.append(" ")
        held.clear()
    lines = (re.sub(r"[ \t]+", " ", x).strip() for x in "".join(out).split("\n"))
    return "\n".join(x for x in lines if x)


def page_texts(data: bytes) -> list[str]:
    """The text of each page."""
    pdf = Pdf(data)
    return [pdf.text(page) for page in pdf.pages()]
