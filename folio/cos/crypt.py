"""The standard security handler: RC4 and AES, revisions 2 to 6.

Revision 6 takes some 30,000 blocks of AES for one hash of a password, seconds in Python. So the ciphers are those of the
library under Python's own modules or of the system's, each where it is there and agrees with the plain version here; else
this does the work.
"""

from __future__ import annotations

import ctypes
import ctypes.util
import hashlib
import importlib
from collections.abc import Iterator
from typing import Any

from .objects import FolioError, Hex, Name, Stream

#: Padding of short passwords. Fixed value.
PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def plain_rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(len(data)), 0, 0
    for k, x in enumerate(data):
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out[k] = x ^ s[(s[i] + s[j]) & 255]
    return bytes(out)


# --- AES, its tables computed from the field's definition


def _double(x: int) -> int:
    return (x << 1 ^ 0x1B) & 255 if x & 128 else x << 1


def _times(x: int, y: int) -> int:
    r = 0
    while y:
        if y & 1:
            r ^= x
        x, y = _double(x), y >> 1
    return r


def _tables() -> tuple[list[int], list[int]]:
    box = [0] * 256
    p = q = 1
    while True:
        p = p ^ _double(p)
        q ^= q << 1
        q ^= q << 2
        q ^= q << 4
        q &= 255
        if q & 128:
            q ^= 9
        turn = lambda n: (q << n | q >> (8 - n)) & 255  # noqa: E731, B023
        box[p] = q ^ turn(1) ^ turn(2) ^ turn(3) ^ turn(4) ^ 0x63
        if p == 1:
            break
    box[0] = 0x63
    inv = [0] * 256
    for i, v in enumerate(box):
        inv[v] = i
    return box, inv


SBOX, INVERSE = _tables()
_MUL = {k: [_times(x, k) for x in range(256)] for k in (2, 3, 9, 11, 13, 14)}
_SHIFT = [(i + 4 * (i % 4)) % 16 for i in range(16)]
_UNSHIFT = [(i - 4 * (i % 4)) % 16 for i in range(16)]


def _schedule(key: bytes) -> list[list[int]]:
    n = len(key) // 4
    w, r = [list(key[4 * i : 4 * i + 4]) for i in range(n)], 1
    for i in range(n, 4 * (n + 7)):
        t = w[-1]
        if i % n == 0:
            t = [SBOX[x] for x in t[1:] + t[:1]]
            t[0] ^= r
            r = _double(r)
        elif n > 6 and i % n == 4:
            t = [SBOX[x] for x in t]
        w.append([a ^ b for a, b in zip(w[i - n], t)])
    return [sum(w[4 * k : 4 * k + 4], []) for k in range(n + 7)]


def _encrypt_block(ks: list[list[int]], b: bytes) -> bytes:
    s = [x ^ k for x, k in zip(b, ks[0])]
    m2, m3 = _MUL[2], _MUL[3]
    for k in ks[1:-1]:
        s = [SBOX[s[i]] for i in _SHIFT]
        t = []
        for c in range(0, 16, 4):
            a, b_, d, e = s[c : c + 4]
            t += [m2[a] ^ m3[b_] ^ d ^ e, a ^ m2[b_] ^ m3[d] ^ e, a ^ b_ ^ m2[d] ^ m3[e], m3[a] ^ b_ ^ d ^ m2[e]]
        s = [x ^ y for x, y in zip(t, k)]
    return bytes(SBOX[s[i]] ^ k for i, k in zip(_SHIFT, ks[-1]))


def _decrypt_block(ks: list[list[int]], b: bytes) -> bytes:
    s = [x ^ k for x, k in zip(b, ks[-1])]
    s = [INVERSE[s[i]] for i in _UNSHIFT]
    m9, m11, m13, m14 = (_MUL[k] for k in (9, 11, 13, 14))
    for k in reversed(ks[1:-1]):
        s = [x ^ y for x, y in zip(s, k)]
        t = []
        for c in range(0, 16, 4):
            a, d, e, f = s[c : c + 4]
            t += [m14[a] ^ m11[d] ^ m13[e] ^ m9[f], m9[a] ^ m14[d] ^ m11[e] ^ m13[f], m13[a] ^ m9[d] ^ m14[e] ^ m11[f], m11[a] ^ m13[d] ^ m9[e] ^ m14[f]]
        s = [INVERSE[t[i]] for i in _UNSHIFT]
    return bytes(x ^ k for x, k in zip(s, ks[0]))


def plain_aes_cbc(key: bytes, iv: bytes, data: bytes, encrypt: bool) -> bytes:
    ks, out = _schedule(key), []
    for i in range(0, len(data) // 16 * 16, 16):
        b = data[i : i + 16]
        if encrypt:
            iv = _encrypt_block(ks, bytes(x ^ y for x, y in zip(b, iv)))
            out.append(iv)
        else:
            out.append(bytes(x ^ y for x, y in zip(_decrypt_block(ks, b), iv)))
            iv = b
    return b"".join(out)


# --- both by the library


class _Library:
    """The ciphers of the OpenSSL that ``place`` is or links to: AES, and RC4 where that is built in."""

    PIECE = 1 << 30  #: lengths are 32 bits there

    def __init__(self, place: str | None):
        lib = ctypes.CDLL(place)
        p, i = ctypes.c_void_p, ctypes.c_int

        def take(name: str, result: Any, *args: Any) -> Any:
            f = getattr(lib, name)
            f.restype, f.argtypes = result, args
            return f

        self.new, self.free = take("EVP_CIPHER_CTX_new", p), take("EVP_CIPHER_CTX_free", None, p)
        self.init = take("EVP_CipherInit_ex", i, p, p, p, ctypes.c_char_p, ctypes.c_char_p, i)
        self.unpadded = take("EVP_CIPHER_CTX_set_padding", i, p, i)
        self.update = take("EVP_CipherUpdate", i, p, p, ctypes.POINTER(i), ctypes.c_char_p, i)
        self.kinds = {16: take("EVP_aes_128_cbc", p)(), 32: take("EVP_aes_256_cbc", p)()}
        self.has_rc4 = hasattr(lib, "RC4_set_key") and hasattr(lib, "RC4")
        if self.has_rc4:
            self.rc4_key, self.rc4_run = take("RC4_set_key", None, p, i, ctypes.c_char_p), take("RC4", None, p, ctypes.c_size_t, ctypes.c_char_p, p)

    def aes_cbc(self, key: bytes, iv: bytes, data: bytes, encrypt: bool) -> bytes:
        ctx = self.new()
        try:
            if not ctx or self.init(ctx, self.kinds[len(key)], None, key, iv, int(encrypt)) != 1 or self.unpadded(ctx, 0) != 1:
                raise FolioError("io", "AES cannot be set up")
            out, n = [], ctypes.c_int()
            for at in range(0, len(data) // 16 * 16, self.PIECE):
                piece = data[at : min(at + self.PIECE, len(data) // 16 * 16)]
                buf = ctypes.create_string_buffer(len(piece) + 16)
                if self.update(ctx, buf, ctypes.byref(n), piece, len(piece)) != 1 or n.value != len(piece):
                    raise FolioError("io", "AES failed")
                out.append(ctypes.string_at(buf, len(piece)))
            return b"".join(out)
        finally:
            self.free(ctx)

    def rc4(self, key: bytes, data: bytes) -> bytes:
        state, buf = ctypes.create_string_buffer(4096), ctypes.create_string_buffer(len(data) + 1)
        self.rc4_key(state, len(key), key)
        self.rc4_run(state, len(data), data, buf)
        return ctypes.string_at(buf, len(data))


def _places() -> Iterator[str | None]:
    """Modules of Python that link to OpenSSL, the process itself, the system's library."""
    for name in ("_hashlib", "_ssl"):
        try:
            yield getattr(importlib.import_module(name), "__file__", None)
        except ImportError:
            pass
    yield None
    if found := ctypes.util.find_library("crypto"):
        yield found


def _library() -> _Library | None:
    data = bytes(range(80))
    for place in _places():
        try:
            lib = _Library(place)
            if any(lib.aes_cbc(data[:n], data[40:56], data, way) != plain_aes_cbc(data[:n], data[40:56], data, way) for n in (16, 32) for way in (True, False)):
                continue
        except (OSError, AttributeError, TypeError, FolioError):
            continue
        lib.has_rc4 = lib.has_rc4 and all(lib.rc4(data[:n], data) == plain_rc4(data[:n], data) for n in (5, 16))
        return lib
    return None


LIBRARY = _library()


def rc4(key: bytes, data: bytes) -> bytes:
    return plain_rc4(key, data) if LIBRARY is None or not LIBRARY.has_rc4 or not 1 <= len(key) <= 256 else LIBRARY.rc4(key, bytes(data))


def aes_cbc(key: bytes, iv: bytes, data: bytes, encrypt: bool) -> bytes:
    """CBC without padding."""
    if LIBRARY is None or len(key) not in LIBRARY.kinds or len(iv) != 16:
        return plain_aes_cbc(key, iv, data, encrypt)
    return LIBRARY.aes_cbc(bytes(key), bytes(iv), bytes(data), encrypt)


def aes_open(key: bytes, data: bytes) -> bytes:
    """Data with its initial vector in front and padding at its end."""
    if len(data) < 32:
        return b""
    out = aes_cbc(key, data[:16], data[16:], False)
    n = out[-1] if out else 0
    return out[:-n] if 1 <= n <= 16 else out


def hash_r6(password: bytes, salt: bytes, user: bytes) -> bytes:
    k = hashlib.sha256(password + salt + user).digest()
    i = 0
    while True:
        e = aes_cbc(k[:16], k[16:32], (password + k + user) * 64, True)
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(e[:16]) % 3](e).digest()
        i += 1
        if i >= 64 and e[-1] <= i - 32:
            return k[:32]


class Handler:
    """Decrypts the strings and streams of a document."""

    def __init__(self, enc: dict, file_id: bytes, password: str | None, source: str = "input"):
        if enc.get("Filter", "Standard") != "Standard":
            raise FolioError("unsupported", "unknown security handler")
        self.v, self.r = enc.get("V", 0), enc.get("R", 0)
        self.meta = enc.get("EncryptMetadata", True) is not False
        n = enc.get("Length", 40) // 8 if self.v in (2, 3, 4) else 5
        self.method = self.strings = "RC4"
        if self.v >= 4:
            cf = enc.get("CF") or {}

            def method(which: str) -> str:
                name = enc.get(which, "Identity")
                m = (cf.get(name) or {}).get("CFM", "None") if name != "Identity" else "None"
                return {"V2": "RC4", "AESV2": "AES", "AESV3": "AES"}.get(m, "none")

            self.method, self.strings = method("StmF"), method("StrF")
            n = 16 if self.v == 4 else 32
        elif self.v not in (1, 2, 3):
            raise FolioError("unsupported", f"encryption version {self.v}")
        self.key = None
        for p in [b"", *([password.encode("utf-8" if self.r >= 5 else "latin-1", "replace")] if password is not None else [])]:
            self.key = self._key_r5(enc, p[:127]) if self.r >= 5 else self._key_r4(enc, p, file_id, n)
            if self.key is not None:
                break
        else:
            raise FolioError("password", f"invalid password for {source}" if password is not None else f"{source} requires a password; retry with --password")

    def _key_r4(self, enc: dict, password: bytes, file_id: bytes, n: int) -> bytes | None:
        def user_key(pw: bytes) -> bytes | None:
            h = hashlib.md5((pw + PAD)[:32] + enc["O"][:32] + (enc["P"] & 0xFFFFFFFF).to_bytes(4, "little") + file_id)
            if self.r >= 4 and not self.meta:
                h.update(b"\xff\xff\xff\xff")
            k = h.digest()
            for _ in range(50 if self.r >= 3 else 0):
                k = hashlib.md5(k[:n]).digest()
            k = k[:n]
            if self.r == 2:
                return k if rc4(k, PAD) == enc["U"] else None
            u = rc4(k, hashlib.md5(PAD + file_id).digest())
            for i in range(1, 20):
                u = rc4(bytes(x ^ i for x in k), u)
            return k if u == enc["U"][:16] else None

        if (k := user_key(password)) is not None:
            return k
        o = hashlib.md5((password + PAD)[:32]).digest()
        for _ in range(50 if self.r >= 3 else 0):
            o = hashlib.md5(o).digest()
        o, user = o[:n], enc["O"][:32]
        for i in reversed(range(20 if self.r >= 3 else 1)):
            user = rc4(bytes(x ^ i for x in o), user)
        return user_key(user)

    def _key_r5(self, enc: dict, password: bytes) -> bytes | None:
        for who, wrapped, udata in (("U", "UE", b""), ("O", "OE", enc["U"][:48])):
            h = enc[who]
            make = (lambda salt: hash_r6(password, salt, udata)) if self.r >= 6 else (lambda salt: hashlib.sha256(password + salt + udata).digest())  # noqa: B023
            if make(h[32:40]) == h[:32]:
                return aes_cbc(make(h[40:48]), bytes(16), enc[wrapped][:32], False)
        return None

    def data(self, raw: bytes, num: int, gen: int, method: str) -> bytes:
        if method == "none":
            return raw
        key = self.key
        if self.v < 5:
            salt = num.to_bytes(4, "little")[:3] + gen.to_bytes(4, "little")[:2] + (b"sAlT" if method == "AES" else b"")
            key = hashlib.md5(key + salt).digest()[: min(16, len(key) + 5)]
        return aes_open(key, raw) if method == "AES" else rc4(key, raw)

    def value(self, v: Any, num: int, gen: int) -> Any:
        """``v`` with its strings (and stream data) in the clear."""
        if isinstance(v, Stream):
            d = self.value(v.dict, num, gen)
            if d.get("Type") == "XRef" or d.get("Type") == "Metadata" and not self.meta:
                return Stream(d, v.raw)
            f = d.get("Filter")
            if f == "Crypt" or isinstance(f, list) and "Crypt" in f:
                return Stream(d, v.raw)
            return Stream(d, self.data(v.raw, num, gen, self.method))
        if isinstance(v, dict):
            return {k: self.value(x, num, gen) for k, x in v.items()}
        if isinstance(v, list):
            return [self.value(x, num, gen) for x in v]
        if isinstance(v, bytes):
            return type(v)(self.data(v, num, gen, self.strings)) if isinstance(v, Hex) else self.data(v, num, gen, self.strings)
        return v


class Sealer:
    """Encrypts for a new file: ``rc4`` (128 bits), ``aes128`` or ``aes256`` (revision 6). Keys and salts follow from ``seed``."""

    def __init__(self, kind: str, user: bytes, owner: bytes, seed: bytes):
        self.kind, self.seed = kind, seed
        draw = lambda what, n: hashlib.shake_256(what + seed).digest(n)
        self.file_id = draw(b"id", 16)
        name = lambda x: Name(x)
        base = {name("Filter"): name("Standard"), name("P"): -4}
        filters = lambda m: {name("CF"): {name("StdCF"): {name("CFM"): name(m)}}, name("StmF"): name("StdCF"), name("StrF"): name("StdCF")}
        if kind == "aes256":
            self.key = draw(b"key", 32)

            def wrap(password: bytes, which: bytes, user_entry: bytes) -> tuple[bytes, bytes]:
                check, salt = draw(which + b"check", 8), draw(which + b"salt", 8)
                return hash_r6(password, check, user_entry) + check + salt, aes_cbc(hash_r6(password, salt, user_entry), bytes(16), self.key, True)

            u, ue = wrap(user, b"user", b"")
            o, oe = wrap(owner, b"owner", u)
            perms = (-4 & 0xFFFFFFFF).to_bytes(4, "little") + b"\xff\xff\xff\xffTadb" + draw(b"perms", 4)
            more = {"V": 5, "R": 6, "Length": 256, "U": u, "UE": ue, "O": o, "OE": oe, "Perms": aes_cbc(self.key, bytes(16), perms, True)}
            self.dict = base | {name(k): v for k, v in more.items()} | filters("AESV3")
            return
        k = hashlib.md5((owner + PAD)[:32]).digest()
        for _ in range(50):
            k = hashlib.md5(k).digest()
        o = (user + PAD)[:32]
        for i in range(20):
            o = rc4(bytes(x ^ i for x in k), o)
        k = hashlib.md5((user + PAD)[:32] + o + (-4 & 0xFFFFFFFF).to_bytes(4, "little") + self.file_id).digest()
        for _ in range(50):
            k = hashlib.md5(k).digest()
        self.key = k
        u = hashlib.md5(PAD + self.file_id).digest()
        for i in range(20):
            u = rc4(bytes(x ^ i for x in k), u)
        aes = kind == "aes128"
        more = {"V": 4 if aes else 2, "R": 4 if aes else 3, "Length": 128, "O": o, "U": u + bytes(16)}
        self.dict = base | {name(x): v for x, v in more.items()} | (filters("AESV2") if aes else {})

    def data(self, raw: bytes, num: int, nth: int) -> bytes:
        key = self.key
        if self.kind != "aes256":
            key = hashlib.md5(key + num.to_bytes(3, "little") + bytes(2) + (b"sAlT" if self.kind == "aes128" else b"")).digest()
        if self.kind == "rc4":
            return rc4(key, raw)
        iv, fill = hashlib.shake_256(self.seed + b"%d %d" % (num, nth)).digest(16), 16 - len(raw) % 16
        return iv + aes_cbc(key, iv, raw + bytes([fill]) * fill, True)

    def value(self, v: Any, num: int) -> Any:
        """``v`` with its strings and stream data encrypted as those of object ``num``."""
        nth = iter(range(1 << 30))

        def walk(x: Any) -> Any:
            if isinstance(x, Stream):
                return Stream(walk(x.dict), self.data(x.raw, num, next(nth)))
            if isinstance(x, dict):
                return {k: walk(y) for k, y in x.items()}
            if isinstance(x, list):
                return [walk(y) for y in x]
            return Hex(self.data(x, num, next(nth))) if isinstance(x, bytes) else x

        return walk(v)
