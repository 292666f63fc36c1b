"""PDF files for the tests, made from scratch."""

from __future__ import annotations

import zlib

from folio.cos import crypt, write
from folio.cos.objects import Name as N
from folio.cos.objects import Ref, Stream
from folio.operators.synth import build

HELV = {N("Type"): N("Font"), N("Subtype"): N("Type1"), N("BaseFont"): N("Helvetica")}


def pages(n: int, **more) -> bytes:
    return build([{"text": f"page {k}"} for k in range(1, n + 1)], **more)


def one_page(content: bytes, font: dict | None = None, resources: dict | None = None, extra: dict | None = None, objects: dict | None = None) -> bytes:
    o = {
        1: {N("Type"): N("Catalog"), N("Pages"): Ref(2, 0)},
        2: {N("Type"): N("Pages"), N("Kids"): [Ref(3, 0)], N("Count"): 1},
        3: {N("Type"): N("Page"), N("Parent"): Ref(2, 0), N("MediaBox"): [0, 0, 612, 792], N("Contents"): Ref(5, 0), N("Resources"): {N("Font"): {N("F1"): Ref(4, 0)}} | (resources or {})} | (extra or {}),
        4: font or HELV,
        5: Stream({}, content),
    }
    return write.file(o | (objects or {}), Ref(1, 0))


def object_streams(n: int = 11) -> bytes:
    """Pages in an object stream, found by a cross-reference stream with a predictor."""
    inner = {1: {N("Type"): N("Catalog"), N("Pages"): Ref(2, 0)}, 2: {N("Type"): N("Pages"), N("Kids"): [Ref(k, 0) for k in range(3, 3 + n)], N("Count"): n, N("MediaBox"): [0, 0, 612, 792]}}
    inner |= {k: {N("Type"): N("Page"), N("Parent"): Ref(2, 0)} for k in range(3, 3 + n)}
    bodies = [write.value(v) for v in inner.values()]
    head, at = [], 0
    for k, b in zip(inner, bodies):
        head.append(b"%d %d" % (k, at))
        at += len(b) + 1
    first = b" ".join(head) + b" "
    container, table = 3 + n, 4 + n
    out = bytearray(b"%PDF-1.5\n")
    where = {container: len(out)}
    out += b"%d 0 obj\n" % container + write.value(Stream({N("Type"): N("ObjStm"), N("N"): len(inner), N("First"): len(first), N("Filter"): N("Fl")}, zlib.compress(first + b" ".join(bodies)))) + b"\nendobj\n"
    where[table] = len(out)
    rows = b"".join(bytes([0, 0, 0, 0, 0, 0]) if k == 0 else bytes([2]) + container.to_bytes(3, "big") + (k - 1).to_bytes(2, "big") if k in inner else bytes([1]) + where[k].to_bytes(3, "big") + b"\0\0" for k in range(table + 1))
    up, prev = b"", bytes(6)
    for i in range(0, len(rows), 6):
        up += b"\x02" + bytes((a - b) & 255 for a, b in zip(rows[i : i + 6], prev))
        prev = rows[i : i + 6]
    d = {N("Type"): N("XRef"), N("Size"): table + 1, N("W"): [1, 3, 2], N("Root"): Ref(1, 0), N("Filter"): N("FlateDecode"), N("DecodeParms"): {N("Predictor"): 12, N("Columns"): 6}}
    out += b"%d 0 obj\n" % table + write.value(Stream(d, zlib.compress(up))) + b"\nendobj\nstartxref\n%d\n%%%%EOF\n" % where[table]
    return bytes(out)


def updated(base: bytes, changed: dict) -> bytes:
    """An incremental update of ``base``."""
    prev = base[base.rfind(b"startxref") + 10 :].split()[0]
    out = bytearray(base)
    rows = []
    for n, v in changed.items():
        rows.append(b"%d 1\n%010d 00000 n \n" % (n, len(out)))
        out += b"%d 0 obj\n" % n + write.value(v) + b"\nendobj\n"
    at = len(out)
    out += b"xref\n" + b"".join(rows) + b"trailer\n" + write.value({N("Size"): 100, N("Root"): Ref(1, 0), N("Prev"): int(prev)}) + b"\nstartxref\n%d\n%%%%EOF\n" % at
    return bytes(out)


def encrypted(kind: str, user: bytes, n: int = 3) -> bytes:
    """``rc4``, ``aes128`` or ``aes256``."""
    import hashlib

    fid = bytes(range(16))
    text = b"secret words"
    o = {
        1: {N("Type"): N("Catalog"), N("Pages"): Ref(2, 0)},
        2: {N("Type"): N("Pages"), N("Kids"): [Ref(k, 0) for k in range(3, 3 + n)], N("Count"): n, N("MediaBox"): [0, 0, 612, 792], N("Resources"): {N("Font"): {N("F1"): HELV}}},
    }
    o |= {k: {N("Type"): N("Page"), N("Parent"): Ref(2, 0), N("Contents"): Ref(50, 0)} for k in range(3, 3 + n)}
    content = b"BT /F1 12 Tf 72 700 Td (" + text + b") Tj ET"
    iv = bytes(range(100, 116))
    pad = lambda b: b + bytes([16 - len(b) % 16]) * (16 - len(b) % 16)
    if kind == "aes256":
        key = bytes(range(32))
        salt = lambda k: bytes(range(k, k + 8))
        u = crypt.hash_r6(user, salt(1), b"") + salt(1) + salt(9)
        ue = crypt.aes_cbc(crypt.hash_r6(user, salt(9), b""), bytes(16), key, True)
        own = crypt.hash_r6(b"owner", salt(2), u) + salt(2) + salt(10)
        enc = {N("Filter"): N("Standard"), N("V"): 5, N("R"): 6, N("Length"): 256, N("U"): u, N("UE"): ue, N("O"): own, N("OE"): crypt.aes_cbc(crypt.hash_r6(b"owner", salt(10), u), bytes(16), key, True), N("P"): -4, N("Perms"): bytes(16), N("CF"): {N("StdCF"): {N("CFM"): N("AESV3")}}, N("StmF"): N("StdCF"), N("StrF"): N("StdCF")}
        data = iv + crypt.aes_cbc(key, iv, pad(content), True)
    else:
        owner = hashlib.md5((b"owner" + crypt.PAD)[:32]).digest()
        for _ in range(50):
            owner = hashlib.md5(owner).digest()
        v = (user + crypt.PAD)[:32]
        for i in range(20):
            v = crypt.rc4(bytes(x ^ i for x in owner), v)
        k = hashlib.md5((user + crypt.PAD)[:32] + v + (-4 & 0xFFFFFFFF).to_bytes(4, "little") + fid).digest()
        for _ in range(50):
            k = hashlib.md5(k).digest()
        u = hashlib.md5(crypt.PAD + fid).digest()
        for i in range(20):
            u = crypt.rc4(bytes(x ^ i for x in k), u)
        enc = {N("Filter"): N("Standard"), N("V"): 4 if kind == "aes128" else 2, N("R"): 4 if kind == "aes128" else 3, N("Length"): 128, N("O"): v, N("U"): u + bytes(16), N("P"): -4}
        if kind == "aes128":
            enc |= {N("CF"): {N("StdCF"): {N("CFM"): N("AESV2")}}, N("StmF"): N("StdCF"), N("StrF"): N("StdCF")}
        ok = hashlib.md5(k + (50).to_bytes(3, "little") + bytes(2) + (b"sAlT" if kind == "aes128" else b"")).digest()
        data = iv + crypt.aes_cbc(ok, iv, pad(content), True) if kind == "aes128" else crypt.rc4(ok, content)
    o[50], o[51] = Stream({}, data), enc
    raw = write.file(o, Ref(1, 0))
    return raw.replace(b"trailer\n<<", b"trailer\n<</Encrypt 51 0 R/ID[<" + fid.hex().encode() + b"><" + fid.hex().encode() + b">]")


def shared_resources() -> bytes:
    """Three pages share a dictionary of seven forms and a font; the second page also sets text."""
    o = {1: {N("Type"): N("Catalog"), N("Pages"): Ref(2, 0)}, 2: {N("Type"): N("Pages"), N("Kids"): [Ref(3, 0), Ref(4, 0), Ref(5, 0)], N("Count"): 3, N("MediaBox"): [0, 0, 100, 100]}, 6: {N("XObject"): {N(f"X{k}"): Ref(20 + k, 0) for k in range(7)}, N("Font"): {N("F1"): Ref(7, 0)}}, 7: HELV}
    for k in range(3):
        o[3 + k] = {N("Type"): N("Page"), N("Parent"): Ref(2, 0), N("Resources"): Ref(6, 0), N("Contents"): Ref(10 + k, 0)}
        o[10 + k] = Stream({}, b"/X%d Do %%comment /X5 Do\n" % k + (b"BT /F1 9 Tf (t) Tj ET" if k == 1 else b""))
    for k in range(7):
        o[20 + k] = Stream({N("Type"): N("XObject"), N("Subtype"): N("Form"), N("BBox"): [0, 0, 9, 9]}, b"0 0 9 9 re f" + b" " * 400)
    return write.file(o, Ref(1, 0))
