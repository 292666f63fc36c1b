"""Stream filters: ASCIIHex, ASCII85, RunLength, LZW and Flate with predictors."""

from __future__ import annotations

import re
import zlib
from typing import Any

import numpy as np

from .objects import FolioError, Name, broken

#: Abbreviated filter names. Fixed values.
SHORT = {
    "Fl": "FlateDecode",
    "AHx": "ASCIIHexDecode",
    "A85": "ASCII85Decode",
    "LZW": "LZWDecode",
    "RL": "RunLengthDecode",
    "CCF": "CCITTFaxDecode",
    "DCT": "DCTDecode",
}
IMAGES = {"DCTDecode", "CCITTFaxDecode", "JBIG2Decode", "JPXDecode"}


def full_name(n: str) -> str:
    return SHORT.get(n, n)


def normalise(d: dict) -> dict:
    """``d`` with full filter names under ``Filter`` (also inside arrays)."""
    f = d.get("Filter", d.get("F") if isinstance(d.get("F"), (Name, list)) else None)
    if f is None:
        return d

    def fix(x: Any) -> Any:
        return Name(full_name(x)) if isinstance(x, Name) else [fix(y) for y in x] if isinstance(x, list) else x

    return d | {Name("Filter"): fix(f)}


def ascii_hex(raw: bytes) -> bytes:
    body = re.sub(rb"[\x00\t\n\x0c\r ]+", b"", raw.split(b">", 1)[0])
    if re.search(rb"[^0-9A-Fa-f]", body):
        raise broken("ASCIIHexDecode: bad byte")
    return bytes.fromhex((body + b"0" * (len(body) % 2)).decode())


def ascii85(raw: bytes) -> bytes:
    body = re.sub(rb"[\x00\t\n\x0c\r ]+", b"", raw)
    body = body.removeprefix(b"<~").split(b"~", 1)[0]
    out, group = bytearray(), []
    for c in body:
        if c == 0x7A and not group:
            out += b"\0\0\0\0"
            continue
        if not 0x21 <= c <= 0x75:
            raise broken("ASCII85Decode: bad byte")
        group.append(c - 0x21)
        if len(group) == 5:
            n = 0
            for g in group:
                n = n * 85 + g
            if n >> 32:
                raise broken("ASCII85Decode: group out of range")
            out += n.to_bytes(4, "big")
            group = []
    if len(group) == 1:
        raise broken("ASCII85Decode: a single last digit")
    if group:
        n = 0
        for g in group + [84] * (5 - len(group)):
            n = n * 85 + g
        out += (n & 0xFFFFFFFF).to_bytes(4, "big")[: len(group) - 1]
    return bytes(out)


def run_length(raw: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(raw):
        n = raw[i]
        i += 1
        if n == 128:
            break
        need = n + 1 if n < 128 else 1
        part = raw[i : i + need]
        if len(part) < need:
            raise broken("RunLengthDecode: truncated run")
        out += part if n < 128 else part * (257 - n)
        i += need
    return bytes(out)


def lzw(raw: bytes, early: int = 1) -> bytes:
    out, table, width, prev = [], [bytes([i]) for i in range(256)] + [b"", b""], 9, None
    acc = bits = 0
    for byte in raw:
        acc, bits = acc << 8 | byte, bits + 8
        while bits >= width:
            code = acc >> (bits - width) & ((1 << width) - 1)
            bits -= width
            acc &= (1 << bits) - 1
            if code == 256:
                table, width, prev = table[:258], 9, None
                continue
            if code == 257:
                return b"".join(out)
            if prev is None:
                if code > 255:
                    raise broken("LZWDecode: bad code")
                entry = table[code]
            else:
                if code < len(table):
                    entry = table[code]
                elif code == len(table):
                    entry = prev + prev[:1]
                else:
                    raise broken("LZWDecode: bad code")
                table.append(prev + entry[:1])
            out.append(entry)
            prev = entry
            if len(table) + early >= 1 << width and width < 12:
                width += 1
    return b"".join(out)


def flate(raw: bytes) -> bytes:
    d = zlib.decompressobj()
    try:
        return d.decompress(raw) + d.flush()
    except zlib.error:
        pass
    # keep what a damaged stream still gives
    for wbits in (15, -15):
        d, out = zlib.decompressobj(wbits), bytearray()
        try:
            for i in range(0, len(raw), 256):
                out += d.decompress(raw[i : i + 256])
        except zlib.error:
            pass
        if out:
            return bytes(out)
    raise broken("FlateDecode: corrupt data")


def _tiff(data: bytes, row: int, colors: int, bits: int, columns: int) -> bytes:
    """Each sample is the difference from the one of its colour before it in the row; samples have 1 to 16 bits."""
    if bits not in (1, 2, 4, 8, 16):
        raise broken("bad number of bits in a TIFF predictor")
    lines = np.frombuffer(data, dtype=np.uint8).reshape(-1, row)
    if bits == 16:
        a = lines.view(">u2").reshape(-1, columns, colors)
        return np.cumsum(a, axis=1, dtype=np.uint16).astype(">u2").tobytes()
    if bits == 8:
        return np.cumsum(lines.reshape(-1, columns, colors), axis=1, dtype=np.uint8).tobytes()
    flat = np.unpackbits(lines, axis=1)[:, : columns * colors * bits]
    a = np.packbits(flat.reshape(-1, bits), axis=1) >> (8 - bits)
    a = np.cumsum(a.reshape(-1, columns, colors), axis=1, dtype=np.uint8) & ((1 << bits) - 1)
    flat = np.unpackbits(a.reshape(-1, 1), axis=1)[:, 8 - bits :]
    return np.packbits(flat.reshape(len(lines), -1), axis=1).tobytes()


def unpredict(data: bytes, parms: dict) -> bytes:
    p = parms.get("Predictor", 1)
    if p in (None, 1):
        return data
    colors, bpc, columns = (parms.get(k, v) for k, v in (("Colors", 1), ("BitsPerComponent", 8), ("Columns", 1)))
    bpp, row = max(1, colors * bpc // 8), (colors * bpc * columns + 7) // 8
    if p == 2:
        return _tiff(data[: len(data) // row * row], row, colors, bpc, columns)
    out, prev = [], np.zeros(row, dtype=np.uint8)
    for at in range(0, len(data), row + 1):
        tag = data[at]
        line = np.frombuffer(data[at + 1 : at + 1 + row], dtype=np.uint8)
        if len(line) < row:
            line = np.concatenate([line, np.zeros(row - len(line), dtype=np.uint8)])
        if tag == 0:
            cur = line.copy()
        elif tag == 2:
            cur = line + prev
        elif tag == 1:
            full = np.zeros(-(-row // bpp) * bpp, dtype=np.uint8)
            full[:row] = line
            cur = np.cumsum(full.reshape(-1, bpp), axis=0, dtype=np.uint8).ravel()[:row]
        elif tag in (3, 4):
            c, up = [0] * (row + bpp), prev.tolist()
            upl = [0] * bpp + up
            for i, x in enumerate(line.tolist()):
                a, b = c[i], up[i]
                if tag == 3:
                    guess = (a + b) >> 1
                else:
                    q = upl[i]
                    e = a + b - q
                    da, db, dq = abs(e - a), abs(e - b), abs(e - q)
                    guess = a if da <= db and da <= dq else b if db <= dq else q
                c[i + bpp] = (x + guess) & 255
            cur = np.array(c[bpp:], dtype=np.uint8)
        else:
            raise broken("unknown PNG predictor")
        out.append(cur.tobytes())
        prev = cur
    return b"".join(out)


def decode(raw: bytes, filters: list[str], parms: list[dict | None]) -> bytes:
    """``raw`` through all ``filters``; an image codec or unknown filter is unsupported."""
    for k, f in enumerate(filters):
        p = (parms[k] if k < len(parms) else None) or {}
        f = full_name(f)
        if f == "FlateDecode":
            raw = unpredict(flate(raw), p)
        elif f == "LZWDecode":
            raw = unpredict(lzw(raw, p.get("EarlyChange", 1)), p)
        elif f == "ASCIIHexDecode":
            raw = ascii_hex(raw)
        elif f == "ASCII85Decode":
            raw = ascii85(raw)
        elif f == "RunLengthDecode":
            raw = run_length(raw)
        elif f == "Crypt" and p.get("Name", "Identity") == "Identity":
            continue
        else:
            raise FolioError("unsupported", f"filter {f} is not supported")
    return raw


def chain(d: dict, get=lambda x: x) -> tuple[list[str], list[dict | None]]:
    """Filter names and parameters of a stream dictionary; ``get`` follows references."""
    f, p = get(d.get("Filter")), get(d.get("DecodeParms", d.get("DP")))
    names = [get(x) for x in f] if isinstance(f, list) else [] if f is None else [f]
    parms = [get(x) for x in p] if isinstance(p, list) else [p]
    return [full_name(str(n)) for n in names], [{k: get(v) for k, v in x.items()} if isinstance(x, dict) else None for x in parms]
