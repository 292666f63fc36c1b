"""What a code in a font stands for and how far it advances."""

from __future__ import annotations

import re
import struct
import unicodedata
from functools import lru_cache
from typing import Any

from .document import Document
from .lexer import END, parse
from .objects import FolioError, Keyword, Name, Stream
from .programs import CFF, TrueType, sfnt_tables, type1_encoding

# Advance widths of the printable ASCII characters, space to tilde, in the standard fonts. Fixed values.
WIDTHS = {
    "Helvetica": "278 278 355 556 556 889 667 191 333 333 389 584 278 333 278 278 556 556 556 556 556 556 556 556 556 556 278 278 584 584 584 556 1015 667 667 722 722 667 611 778 722 278 500 667 556 833 722 778 667 778 722 667 611 722 667 944 667 667 611 278 278 278 469 556 333 556 556 500 556 556 278 556 556 222 222 500 222 833 556 556 556 556 333 500 278 556 500 722 500 500 500 334 260 334 584",
    "Helvetica-Bold": "278 333 474 556 556 889 722 238 333 333 389 584 278 333 278 278 556 556 556 556 556 556 556 556 556 556 333 333 584 584 584 611 975 722 722 722 722 667 611 778 722 278 556 722 611 833 722 778 667 778 722 667 611 722 667 944 667 667 611 333 278 333 584 556 333 556 611 556 611 556 333 611 611 278 278 556 278 889 611 611 611 611 389 556 333 611 556 778 556 556 500 389 280 389 584",
    "Times-Roman": "250 333 408 500 500 833 778 180 333 333 500 564 250 333 250 278 500 500 500 500 500 500 500 500 500 500 278 278 564 564 564 444 921 722 667 667 722 611 556 722 722 333 389 722 611 889 722 722 556 722 667 556 611 722 722 944 722 722 611 333 278 333 469 500 333 444 500 444 500 444 333 500 500 278 278 500 278 778 500 500 500 500 333 389 278 500 500 722 500 500 444 480 200 480 541",
    "Times-Bold": "250 333 555 500 500 1000 833 278 333 333 500 570 250 333 250 278 500 500 500 500 500 500 500 500 500 500 333 333 570 570 570 500 930 722 667 722 722 667 611 778 778 389 500 778 667 944 722 778 611 778 722 556 667 722 722 1000 722 722 667 333 278 333 581 500 333 500 556 444 556 444 333 500 556 278 333 556 278 833 556 500 556 556 444 389 333 556 500 722 500 500 444 394 220 394 520",
}
ALIAS = {"Arial": "Helvetica", "ArialMT": "Helvetica", "Helvetica-Oblique": "Helvetica", "Helvetica-BoldOblique": "Helvetica-Bold", "Arial-Bold": "Helvetica-Bold", "TimesNewRoman": "Times-Roman", "Times-Italic": "Times-Roman", "Times-BoldItalic": "Times-Bold", "TimesNewRomanPSMT": "Times-Roman"}
# Glyph names that do not follow from a letter and its accent. Fixed values.
GLYPHS = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'",
    "parenleft": "(", "parenright": ")", "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-", "minus": "−", "period": ".", "slash": "/",
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "colon": ":", "semicolon": ";", "less": "<", "equal": "=", "greater": ">", "question": "?", "at": "@", "bracketleft": "[", "backslash": "\\",
    "bracketright": "]", "asciicircum": "^", "underscore": "_", "grave": "`", "braceleft": "{", "bar": "|", "braceright": "}", "asciitilde": "~",
    "quoteleft": "‘", "quoteright": "’", "quotedblleft": "“", "quotedblright": "”", "quotesinglbase": "‚", "quotedblbase": "„",
    "endash": "–", "emdash": "—", "bullet": "•", "ellipsis": "…", "dagger": "†", "daggerdbl": "‡", "perthousand": "‰", "guilsinglleft": "‹",
    "guilsinglright": "›", "guillemotleft": "«", "guillemotright": "»", "fi": "fi", "fl": "fl", "ff": "ff", "ffi": "ffi", "ffl": "ffl", "germandbls": "ß",
    "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "oslash": "ø", "Oslash": "Ø", "dotlessi": "ı", "Euro": "€", "sterling": "£", "yen": "¥",
    "cent": "¢", "section": "§", "paragraph": "¶", "copyright": "©", "registered": "®", "trademark": "™", "degree": "°", "exclamdown": "¡",
    "questiondown": "¿", "multiply": "×", "divide": "÷", "plusminus": "±", "mu": "µ", "periodcentered": "·", "ordfeminine": "ª", "ordmasculine": "º",
    "nbspace": "\xa0", "eth": "ð", "Eth": "Ð", "thorn": "þ", "Thorn": "Þ", "onehalf": "½", "onequarter": "¼", "threequarters": "¾", "currency": "¤",
    "brokenbar": "¦", "logicalnot": "¬", "acute": "´", "dieresis": "¨", "macron": "¯", "cedilla": "¸", "florin": "ƒ", "circumflex": "ˆ", "tilde": "˜",
}
_ACCENT = {"acute": "́", "grave": "̀", "circumflex": "̂", "dieresis": "̈", "tilde": "̃", "cedilla": "̧", "ring": "̊", "caron": "̌", "macron": "̄", "breve": "̆", "ogonek": "̨", "dotaccent": "̇", "hungarumlaut": "̋"}


def glyph_text(n: str) -> str | None:
    """The text a glyph name stands for: variant endings dropped, ligatures taken apart."""
    out = ""
    for part in n.split(".", 1)[0].split("_"):
        if part in GLYPHS:
            out += GLYPHS[part]
        elif len(part) == 1:
            out += part
        elif m := re.fullmatch(r"uni((?:[0-9A-F]{4})+)", part):
            out += "".join(chr(int(m[1][i : i + 4], 16)) for i in range(0, len(m[1]), 4))
        elif (m := re.fullmatch(r"u([0-9A-F]{4,6})", part)) and int(m[1], 16) < 0x110000:
            out += chr(int(m[1], 16))
        elif part[1:] in _ACCENT and part[0].isalpha():
            out += unicodedata.normalize("NFC", part[0] + _ACCENT[part[1:]])
        else:
            return None
    return out or None


@lru_cache(maxsize=None)
def encoding(n: str) -> tuple[str | None, ...]:
    """The characters of a named encoding's 256 codes."""
    codec = {"WinAnsiEncoding": "cp1252", "MacRomanEncoding": "mac_roman"}.get(n)
    if codec:
        t = [bytes([i]).decode(codec, "ignore") or None for i in range(256)]
        if codec == "cp1252":
            t = [c or ("•" if i > 0x7E else None) for i, c in enumerate(t)]
    else:
        t = [chr(i) if 32 <= i < 127 else None for i in range(256)]
        t[0x27], t[0x60] = "’", "‘"
        high = {0xA1: "¡¢£⁄¥ƒ§¤'“«‹›", 0xAE: "ﬁﬂ", 0xB1: "–†‡·", 0xB6: "¶•‚„”»…‰", 0xBF: "¿"}
        for at, s in high.items():
            for k, c in enumerate(s):
                t[at + k] = {"ﬁ": "fi", "ﬂ": "fl"}.get(c, c)
        for at, c in ((0xD0, "—"), (0xE1, "Æ"), (0xE3, "ª"), (0xE8, "Ł"), (0xE9, "Ø"), (0xEA, "Œ"), (0xEB, "º"), (0xF1, "æ"), (0xF5, "ı"), (0xF8, "ł"), (0xF9, "ø"), (0xFA, "œ"), (0xFB, "ß")):
            t[at] = c
    return tuple(None if c is not None and ord(c[0]) < 32 else c for c in t)


def standard_width(base: str, ch: str | None) -> float | None:
    if base.startswith("Courier"):
        return 600.0
    table = WIDTHS.get(ALIAS.get(base, base))
    if table is None or not ch:
        return None
    c = {"’": "'", "‘": "`", "•": "o", "–": "_", "—": "@", "…": "@", "“": '"', "”": '"'}.get(ch, ch[0])
    if len(ch) > 1:
        return sum(standard_width(base, x) or 0 for x in ch)
    c = unicodedata.normalize("NFD", c)[0]
    return float(table.split()[ord(c) - 32]) if 32 <= ord(c) < 127 else 556.0


def to_unicode(data: bytes) -> tuple[dict[int, str], int]:
    """Code -> text of a ToUnicode map, and the bytes of a code."""
    out: dict[int, str] = {}
    width, pos, args = 0, 0, []
    text = lambda b: b.decode("utf-16-be", "replace") if len(b) > 1 else b.decode("latin-1")
    num = lambda b: int.from_bytes(b, "big")
    while True:
        try:
            v, pos = parse(data, pos, refs=False)
        except FolioError:
            break
        if v is END:
            break
        if not isinstance(v, Keyword):
            args.append(v)
            continue
        if v == b"endcodespacerange":
            width = max([width, *(len(x) for x in args if isinstance(x, bytes))])
        elif v == b"endbfchar":
            for a, b in zip(args[::2], args[1::2]):
                if isinstance(a, bytes) and isinstance(b, bytes):
                    out[num(a)] = text(b)
        elif v == b"endbfrange":
            for a, b, c in zip(args[::3], args[1::3], args[2::3]):
                if not isinstance(a, bytes) or not isinstance(b, bytes):
                    continue
                for k in range(min(num(b) - num(a) + 1, 65536)):
                    if isinstance(c, list):
                        if k < len(c) and isinstance(c[k], bytes):
                            out[num(a) + k] = text(c[k])
                    elif isinstance(c, bytes) and c:
                        out[num(a) + k] = text((num(c) + k).to_bytes(len(c), "big"))
        args = []
    return out, width or 1


def code_map(data: bytes) -> tuple[list[tuple[int, int, int]], dict[int, dict[int, int]]]:
    """Of an embedded map of codes: its code spaces (bytes, lowest, highest) and, by number of bytes, code -> CID."""
    spaces: list[tuple[int, int, int]] = []
    cids: dict[int, dict[int, int]] = {}
    pos, args = 0, []
    num = lambda b: int.from_bytes(b, "big")
    while True:
        try:
            v, pos = parse(data, pos, refs=False)
        except FolioError:
            break
        if v is END:
            break
        if not isinstance(v, Keyword):
            args.append(v)
            continue
        codes = [x for x in args if isinstance(x, bytes)]
        if v == b"endcodespacerange":
            spaces += [(len(a), num(a), num(b)) for a, b in zip(codes[::2], codes[1::2])]
        elif v == b"endcidchar":
            for a, c in zip(args[::2], args[1::2]):
                if isinstance(a, bytes) and isinstance(c, int):
                    cids.setdefault(len(a), {})[num(a)] = c
        elif v == b"endcidrange":
            for a, b, c in zip(args[::3], args[1::3], args[2::3]):
                if isinstance(a, bytes) and isinstance(b, bytes) and isinstance(c, int):
                    cids.setdefault(len(a), {}).update((k, c + k - num(a)) for k in range(num(a), min(num(b), num(a) + 0xFFFF) + 1))
        args = []
    return spaces, cids


def cff_standard() -> list[str]:
    """The characters of the first 149 standard names: the standard encoding's in the order of its codes, accents included."""
    have = [c for c in encoding("StandardEncoding") if c]
    upto = have.index("¿") + 1
    return have[:upto] + list("`´ˆ˜¯˘˙¨˚¸˝˛ˇ") + have[upto:]


class Font:
    """Decodes strings: (bytes of the code, text or None, advance in thousandths or None, is it a space)."""

    def __init__(self, d: Document, spec: Any):
        spec = spec if isinstance(spec, dict) else {}
        get = lambda k, x=spec: d.resolve(x.get(k))
        self.kind = str(get("Subtype") or "Type1")
        self.base = re.sub(r"^[A-Z]{6}\+", "", str(get("BaseFont") or "")).replace(",", "-")
        self.supported = self.kind in ("Type1", "MMType1", "TrueType", "Type0", "Type3")
        self.map: dict[int, str] = {}
        tu = get("ToUnicode")
        if isinstance(tu, Stream):
            try:
                self.map = to_unicode(d.decoded(tu))[0]
            except FolioError:
                pass
        self.width = 1
        self.widths: dict[int, float] = {}
        self.missing: float | None = None
        self.table: list[str | None] = [None] * 256
        self.vertical = False
        self.spaces: list[tuple[int, int, int]] = []
        self.cids: dict[int, dict[int, int]] = {}
        self.glyph_texts: dict[int, str] = {}
        self.program: TrueType | CFF | dict | None = None
        self.gids: list[int] | None = None
        self.symbolic = False
        self.procs: dict[int, Any] = {}
        self.resources = get("Resources")
        self._outlines: dict[int, list] = {}
        self.matrix = [0.001, 0, 0, 0.001, 0, 0]
        if self.kind == "Type0":
            self.width = 2
            enc = get("Encoding")
            self.vertical = isinstance(enc, Name) and enc.endswith("-V")
            if isinstance(enc, Stream):
                self.vertical = d.resolve(enc.dict.get("WMode")) == 1
                try:
                    self.spaces, self.cids = code_map(d.decoded(enc))
                except FolioError:
                    pass
            kids = get("DescendantFonts")
            kid = d.resolve(kids[0]) if isinstance(kids, list) and kids else None
            kid = kid if isinstance(kid, dict) else {}
            self.missing = float(d.resolve(kid.get("DW")) or 1000)
            w = d.resolve(kid.get("W")) or []
            i = 0
            while i + 1 < len(w):
                a, b = d.resolve(w[i]), d.resolve(w[i + 1])
                if isinstance(b, list):
                    self.widths |= {a + k: float(d.resolve(x)) for k, x in enumerate(b)}
                    i += 2
                elif i + 2 < len(w):
                    c = float(d.resolve(w[i + 2]))
                    self.widths |= {k: c for k in range(a, min(b, a + 65535) + 1)}
                    i += 3
                else:
                    break
            program = self.program = self._program(d, kid)
            if isinstance(program, TrueType):
                to = d.resolve(kid.get("CIDToGIDMap"))
                gids = None
                if isinstance(to, Stream):
                    raw = d.decoded(to)
                    gids = self.gids = [int.from_bytes(raw[i : i + 2], "big") for i in range(0, len(raw) - 1, 2)]
                self.glyph_texts = program.chars if gids is None else {c: program.chars[g] for c, g in enumerate(gids) if g in program.chars}
            return
        enc = get("Encoding")
        name, diffs = (str(enc), []) if isinstance(enc, Name) else (str(d.resolve(enc.get("BaseEncoding")) or ""), d.resolve(enc.get("Differences")) or []) if isinstance(enc, dict) else ("", [])
        if self.kind != "Type3":
            self.program = self._program(d, spec)
            own = None if name else self._own_encoding(self.program)
            self.symbolic = own is not None
            if own is not None:
                self.table = own
            elif not name:
                name = "WinAnsiEncoding" if self.kind == "TrueType" else "StandardEncoding"
            if own is None:
                self.table = list(encoding(name))
        code = 0
        for x in diffs:
            x = d.resolve(x)
            if isinstance(x, Name):
                if code < 256 and self.kind == "Type3":
                    self.procs[code] = d.resolve((get("CharProcs") or {}).get(x))
                if code < 256:
                    self.table[code] = None if self.kind == "Type3" else glyph_text(x)
                code += 1
            elif isinstance(x, (int, float)):
                code = int(x)
        first, ws = get("FirstChar"), get("Widths")
        if isinstance(ws, list) and isinstance(first, int):
            self.widths = {first + k: float(v) for k, x in enumerate(ws) if isinstance(v := d.resolve(x), (int, float))}
            desc = get("FontDescriptor")
            self.missing = float(d.resolve(desc.get("MissingWidth")) or 0) if isinstance(desc, dict) else 0.0
        if self.kind == "Type3" and isinstance(m := get("FontMatrix"), list) and len(m) == 6:
            self.matrix = [float(d.resolve(x)) for x in m]

    @staticmethod
    def _program(d: Document, spec: dict) -> TrueType | CFF | dict | None:
        """The embedded program of a font; a Type 1 program is told by its encoding alone."""
        desc = d.resolve(spec.get("FontDescriptor"))
        if not isinstance(desc, dict):
            return None
        try:
            for key in ("FontFile", "FontFile2", "FontFile3"):
                s = d.resolve(desc.get(key))
                if not isinstance(s, Stream):
                    continue
                data = d.decoded(s)
                if key == "FontFile":
                    return type1_encoding(data)
                if data[:4] == b"OTTO":
                    data = sfnt_tables(data)["CFF "]
                elif data[:4] in (b"\0\1\0\0", b"true"):
                    return TrueType(data)
                return CFF(data, cff_standard())
        except (FolioError, IndexError, KeyError, ValueError, struct.error):
            pass
        return None

    def _own_encoding(self, program: TrueType | CFF | dict | None) -> list[str | None] | None:
        """The characters of the 256 codes as an embedded program has them; None if it does not say."""
        if isinstance(program, dict):
            return [glyph_text(program[c]) if c in program else None for c in range(256)]
        if isinstance(program, TrueType):
            glyphs = [program.glyph(c) for c in range(256)]
            name = lambda g: program.chars.get(g) or (glyph_text(program.names[g]) if g in program.names else None)
            return [name(g) if g else None for g in glyphs] if any(glyphs) else None
        if isinstance(program, CFF) and program.codes is not None:
            name = lambda g: program.chars.get(g) or (glyph_text(program.names[g]) if g in program.names else None)
            return [name(program.codes[c]) if c in program.codes else None for c in range(256)]
        return None

    def outline(self, code: int, text: str | None) -> list:
        """The contours of what a code shows, in ems; none where no TrueType program is embedded."""
        if not isinstance(self.program, TrueType):
            return []
        if self.kind == "Type0":
            g = next((m[code] for m in self.cids.values() if code in m), 0) if self.spaces else code
            if self.gids is not None:
                g = self.gids[g] if g < len(self.gids) else 0
        else:
            g = self.program.glyph(code) if self.symbolic else self.program.by_char().get(text) or self.program.glyph(code)
        if g not in self._outlines:
            try:
                self._outlines[g] = self.program.outline(g)
            except (IndexError, ValueError, struct.error):
                self._outlines[g] = []
        return self._outlines[g]

    def _split(self, s: bytes):
        """(bytes of a code, code) by the code spaces; where none fits, by as many bytes as the shortest has."""
        at, sizes = 0, sorted({n for n, _, _ in self.spaces})
        while at < len(s):
            for n in sizes:
                c = s[at : at + n]
                if len(c) == n and any(m == n and all(x <= y <= z for x, y, z in zip(lo.to_bytes(n, "big"), c, hi.to_bytes(n, "big"))) for m, lo, hi in self.spaces):
                    break
            else:
                n = sizes[0]
            yield n, int.from_bytes(s[at : at + n], "big")
            at += n

    def codes(self, s: bytes):
        if self.spaces:
            for n, c in self._split(s):
                cid = self.cids.get(n, {}).get(c, 0)
                yield c, self.map.get(c, self.glyph_texts.get(cid)), self.widths.get(cid, self.missing), n == 1 and c == 32
            return
        for i in range(0, len(s) - self.width + 1, self.width):
            c = int.from_bytes(s[i : i + self.width], "big")
            t = self.map.get(c)
            if t is None:
                t = self.table[c] if self.width == 1 else self.glyph_texts.get(c)
            w = self.widths.get(c, self.missing)
            if w is None:
                w = standard_width(self.base, t)
            yield c, t, w, self.width == 1 and c == 32
