"""Reading, repairing, selecting, copying and drawing single files."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folio import api, cli
from folio.cos import assemble as A
from folio.cos import content, filters, geometry, lexer, raster, text, write
from folio.cos.document import open_document, with_repair
from folio.cos.objects import FolioError, Hex, Name, Ref, Stream
from folio.functions import ranges as R
from tests import fixtures as X

N = Name


def count(b: bytes, strict=True, **k) -> int:
    return with_repair(b, lambda d: d.count(strict), **k)


def runs(b: bytes, **k) -> text.PageText:
    d = open_document(b, **{x: k.pop(x) for x in list(k) if x == "password"})
    return text.page_text(d, d.pages()[0], 1, **k)


# --- values

atoms = st.one_of(st.none(), st.booleans(), st.integers(-(2**40), 2**40), st.integers(-9999, 9999).map(lambda n: n / 8), st.binary(max_size=12), st.binary(max_size=8).map(Hex), st.text(st.characters(max_codepoint=255), max_size=8).map(N), st.builds(Ref, st.integers(1, 99), st.just(0)))
values = st.recursive(atoms, lambda v: st.one_of(st.lists(v, max_size=4), st.dictionaries(st.text(st.characters(min_codepoint=1, max_codepoint=255), min_size=1, max_size=6).map(N), v, max_size=4)), max_leaves=20)


@settings(max_examples=300, deadline=None)
@given(values)
def test_written_values_read_back(v):
    assert lexer.parse(write.value(v) + b" ", 0)[0] == v


def test_lexer():
    p = lambda b: lexer.parse(b, 0)[0]
    assert p(b"<</A 1/A 2/B[1 2 Q 3 0 R]>>") == {"A": 2, "B": [1, 2, None, Ref(3, 0)]}
    assert p(b"(a\\(b\\051\\\r\nc\\101\\n)") == b"a(b)cA\n"
    assert p(b"<4 1 5>") == b"AP" and isinstance(p(b"<41>"), Hex)
    assert p(b"/A#20B") == "A B" and p(b"%x\n-.5") == -0.5
    deep = b"[" * 100_000 + b"]" * 100_000
    assert lexer.parse(deep, 0)[1] == 200_000
    with pytest.raises(FolioError):
        lexer.parse(b"[" * 300_000, 0)


def test_filters():
    data = bytes(range(256)) * 5
    assert filters.ascii_hex(b"4 1 4>zz") == b"A@"
    assert filters.ascii85(b"<~87cURD]i,\"Ebo80~>") == b"Hello World!"
    assert filters.run_length(b"\x02abc\xfed\x80zz") == b"abcddd"
    assert filters.lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])
    rng = np.random.default_rng(1)
    img = rng.integers(0, 256, (9, 12), dtype=np.uint8)
    for tag in range(5):
        rows, prev = b"", np.zeros(12, dtype=int)
        for line in img.astype(int):
            left, upl = np.r_[[0] * 3, line[:-3]], np.r_[[0] * 3, prev[:-3]]
            e = left + prev - upl
            paeth = np.where((abs(e - left) <= abs(e - prev)) & (abs(e - left) <= abs(e - upl)), left, np.where(abs(e - prev) <= abs(e - upl), prev, upl))
            guess = [0, left, prev, (left + prev) // 2, paeth][tag]
            rows += bytes([tag]) + ((line - guess) & 255).astype(np.uint8).tobytes()
            prev = line
        assert filters.unpredict(rows, {"Predictor": 15, "Colors": 3, "Columns": 4}) == img.tobytes()
    assert filters.decode(__import__("zlib").compress(data).hex().encode() + b">", ["AHx", "Fl"], []) == data
    for bad in ([b"4g>", ["AHx"]], [b"\x05ab", ["RL"]], [b"x", ["DCT"]], [b"x", ["Nope"]]):
        with pytest.raises(FolioError):
            filters.decode(*bad, [])
    assert filters.normalise({N("Filter"): [N("Fl"), N("DCT")]})["Filter"] == ["FlateDecode", "DCTDecode"]


# --- opening


def test_counts():
    assert count(X.pages(11)) == count(X.pages(11), False) == 11
    for declared, fast in ((-3, 3), (1_000_000, 3), (2, 2), (3, 3)):
        b = X.pages(3, count=declared)
        assert (count(b, False), count(b)) == (fast, 3)
    b = X.pages(3)
    for other in (b"", b"/Count /x"):
        b2 = b.replace(b"/Count 3", other.ljust(8))
        assert (count(b2, False), count(b2)) == (3, 3)


def test_object_and_xref_streams():
    b = X.object_streams()
    d = open_document(b)
    assert len(d.pages()) == 11 and not d.repaired and d.version == "1.5"
    assert geometry.dimensions(d)[0] == (612.0, 792.0, 0)


def test_updates_newest_wins():
    base = X.pages(3)
    d = open_document(base)
    kids = d.get(2)["Kids"]
    b = X.updated(base, {2: d.get(2) | {N("Kids"): kids[:2], N("Count"): 2}})
    assert count(b) == 2 and len(open_document(b).sections) == 2


@pytest.mark.parametrize("cut", [b"xref\n", b"startxref", b"trailer"])
def test_damage(cut):
    b = X.pages(11)
    d = open_document(b[: b.rfind(cut)])
    assert len(d.pages()) == 11 and d.repaired and d.warnings


def test_more_damage():
    b = X.pages(5)
    assert count(b"junk in front\n" * 3 + b) == 5
    first, second = b.find(b"1 0 obj"), b.find(b"2 0 obj")
    swapped = b.replace(b"%010d 00000 n" % first, b"#" * 18, 1).replace(b"%010d 00000 n" % second, b"%010d 00000 n" % first, 1).replace(b"#" * 18, b"%010d 00000 n" % second, 1)
    assert count(swapped) == 5
    with pytest.raises(FolioError, match="damaged"):
        open_document(b"%PDF-1.4 nothing here")
    e = X.encrypted("rc4", b"")
    with pytest.raises(FolioError, match="damaged"):
        open_document(e[: e.rfind(b"startxref")].replace(b"xref\n0", b"xxxx\n0"))
    osb = X.object_streams()
    assert count(osb[: osb.rfind(b"startxref")]) == 11


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2000))
def test_truncation_gives_pages_or_an_error(n):
    b = X.pages(4)
    try:
        assert 0 <= count(b[: max(0, len(b) - n)]) <= 4
    except FolioError:
        pass


def test_encryption():
    for kind in ("rc4", "aes128", "aes256"):
        b = X.encrypted(kind, b"")
        assert count(b) == 3 and runs(b).runs[0].text == "secret words"
        b = X.encrypted(kind, b"user")
        assert runs(b, password="user").runs[0].text == "secret words"
        assert count(b, password="owner") == 3
        with pytest.raises(FolioError, match="--password"):
            open_document(b)
        with pytest.raises(FolioError, match="invalid password"):
            open_document(b, "wrong")


def test_ciphers_of_the_library(monkeypatch):
    """They give what the plain versions give, published examples too, and passwords of revision 6 are hashed with them."""
    from folio.cos import crypt

    assert crypt.rc4(b"Key", b"Plaintext").hex() == crypt.plain_rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"
    block, key = bytes.fromhex("00112233445566778899aabbccddeeff"), bytes(range(32))
    for f in (crypt.aes_cbc, crypt.plain_aes_cbc):
        assert f(key[:16], bytes(16), block, True).hex() == "69c4e0d86a7b0430d8cdb78070b4c55a"
        assert f(key, bytes(16), block, True).hex() == "8ea2b7ca516745bfeafc49904b496089"
    for n in (0, 1, 15, 16, 17, 333):
        data = bytes(i * i % 251 for i in range(n))
        for k in (key[:1], key[:5], key[:16], key):
            assert crypt.rc4(k, data) == crypt.plain_rc4(k, data)
        for k in (key[:16], key):
            for way in (True, False):
                assert crypt.aes_cbc(k, block, data, way) == crypt.plain_aes_cbc(k, block, data, way)
    if crypt.LIBRARY is None:
        pytest.skip("hashlib has no OpenSSL here")
    monkeypatch.setattr(crypt.LIBRARY, "PIECE", 32)
    assert crypt.aes_cbc(key, block, data, True) == crypt.plain_aes_cbc(key, block, data, True)
    quick = crypt.hash_r6(b"owner", key[:8], b"")
    with monkeypatch.context() as m:
        m.setattr(crypt, "LIBRARY", None)
        assert crypt.hash_r6(b"owner", key[:8], b"") == quick
        m.setattr(crypt, "_encrypt_block", None)
        with pytest.raises(TypeError):
            crypt.hash_r6(b"owner", key[:8], b"")
    monkeypatch.setattr(crypt, "_encrypt_block", None)  # of 30,000 blocks for a hash none is worked out in Python
    assert crypt.hash_r6(b"owner", key[:8], b"") == quick


def test_aes_of_the_library_wherever_it_is(monkeypatch):
    """A library without RC4, or one that hashlib doesn't lead to, still hashes the passwords of revision 6."""
    import _hashlib
    import ctypes

    from folio.cos import crypt

    if crypt.LIBRARY is None:
        pytest.skip("no OpenSSL here")
    hashed, real = crypt.hash_r6(b"owner", bytes(8), b""), ctypes.CDLL

    class NoRC4:
        def __init__(self, place):
            self.lib = real(place)

        def __getattr__(self, name):
            if name.startswith("RC4"):
                raise AttributeError(name)
            return getattr(self.lib, name)

    def elsewhere(place):
        if place == getattr(_hashlib, "__file__", None):
            raise OSError(place)
        return real(place)

    for load, rc4 in ((NoRC4, False), (elsewhere, True)):
        with monkeypatch.context() as m:
            m.setattr(ctypes, "CDLL", load)
            lib = crypt._library()
        assert lib is not None and lib.has_rc4 == rc4
        with monkeypatch.context() as m:
            m.setattr(crypt, "LIBRARY", lib)
            m.setattr(crypt, "_encrypt_block", None)
            assert crypt.hash_r6(b"owner", bytes(8), b"") == hashed
            assert crypt.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"
    monkeypatch.setattr(ctypes, "CDLL", lambda place: (_ for _ in ()).throw(OSError(place)))
    assert crypt._library() is None


def test_page_tree_errors():
    b = X.pages(3)
    d = open_document(b)
    kids = d.get(2)["Kids"]
    for change, why in (({N("Kids"): [*kids, kids[0]]}, "cycle"), ({N("Kids"): [{N("Type"): N("Page")}]}, "direct"), ({N("Kids"): 5}, "array"), ({N("Kids"): [Ref(2, 0)]}, "cycle"), ({N("Kids"): [Ref(3, 0)]}, None)):
        bad = X.updated(b, {2: d.get(2) | change})
        if why:
            with pytest.raises(FolioError, match=why):
                count(bad)
        else:
            assert count(bad) == 0  # a font is no page
    assert count(X.updated(b, {2: d.get(2) | {N("Kids"): [None, kids[0], 7]}})) == 1


# --- ranges


def test_ranges():
    assert R.pages_of("1-3", 5) == [1, 2, 3] and R.pages_of("z-1", 3) == [3, 2, 1]
    assert R.pages_of(" r2 , z,1,1 ", 5) == [4, 5, 1, 1] and R.pages_of("+2-r+1", 3) == [2, 3]
    for bad in ("", " ", "1;2", "1,,2", ",1", "1-", "-1", "0", "r0", "a", "Z", "R1", "r 3", "1-2-3", "1.5", "r"):
        with pytest.raises(FolioError):
            R.check(bad)
    for spec, n in (("6", 5), ("r6", 5), ("1-6", 5), ("1", 0)):
        with pytest.raises(FolioError):
            R.pages_of(spec, n)
    assert R.highest("3,1-7") == 7 and R.highest("1-z") is None


# --- geometry


def size(media=None, crop=None, rotate=None):
    b = X.build([{"text": "x", "media": media, "crop": crop, "rotate": rotate}])
    return geometry.dimensions(open_document(b))[0]


def test_geometry():
    assert size([0, 0, 612, 792]) == size([612, 792, 0, 0]) == size() == (612.0, 792.0, 0)
    assert size([0, 0, 600, 800], [100, 50, 700, 750]) == (500.0, 700.0, 0)
    for turn, want in ((90, 90), (180, 180), (270, 270), (-90, 270), (450, 90), (45, 0)):
        w, h, r = size([0, 0, 100, 200], rotate=turn)
        assert r == want and (w, h) == ((200.0, 100.0) if want in (90, 270) else (100.0, 200.0))
    a4 = tuple(float(x) for x in geometry.A4)
    assert size([0, 0, 0, 10])[:2] == a4 and size([0, 0, 600, 800], [700, 0, 900, 10])[:2] == a4
    assert raster.pixels(612, 150) == 1275 and raster.pixels(792, 150) == 1649


# --- copying


def used(b: bytes) -> list[set]:
    d = open_document(b)
    out = []
    for n in d.pages():
        r = d.resolve(d.get(n).get("Resources")) or {}
        out.append({str(k) for c in ("Font", "XObject") for k in (d.resolve(r.get(c)) or {})})
    return out


def test_split_prunes_shared_resources(tmp_path):
    src = tmp_path / "in.pdf"
    src.write_bytes(X.shared_resources())
    assert api.split_pages(str(src), str(tmp_path / "p%d.pdf")) == 3
    got = [used((tmp_path / f"p{k}.pdf").read_bytes())[0] for k in (1, 2, 3)]
    assert got == [{"X0"}, {"X1", "F1"}, {"X2"}]
    assert max((tmp_path / f"p{k}.pdf").stat().st_size for k in (1, 2, 3)) < src.stat().st_size / 3
    api.merge([api.MergeInput(str(src))], str(tmp_path / "m.pdf"))
    assert used((tmp_path / "m.pdf").read_bytes())[0] == {f"X{k}" for k in range(7)} | {"F1"}
    d = open_document(X.shared_resources())
    broken = X.updated(X.shared_resources(), {10: Stream({}, b"/X0 Do ]] (")})
    del d
    d = open_document(broken)
    assert used(A.assemble([A.Part(d, d.pages()[:1], True)]))[0] == {f"X{k}" for k in range(7)} | {"F1"}


def test_split_merge_files(tmp_path):
    src = tmp_path / "in.pdf"
    src.write_bytes(X.pages(12, title="Title"))
    p = lambda n: str(tmp_path / n)
    api.split(str(src), [api.SplitOutput("z,1,1", p("a.pdf")), api.SplitOutput("2-4", p("b.pdf"))])
    words = lambda f: [" ".join(r.text for r in t.runs) for t in api.extract_text(f)]
    assert words(p("a.pdf")) == ["page 12", "page 1", "page 1"] and words(p("b.pdf")) == ["page 2", "page 3", "page 4"]
    assert len(set(open_document((tmp_path / "a.pdf").read_bytes()).pages())) == 3
    info = open_document((tmp_path / "a.pdf").read_bytes())
    assert info.resolve(info.trailer["Info"])["Title"] == b"Title"
    api.split_pages(str(src), p("c%d.pdf"), 5)
    assert [api.page_count(p(f"c{k}.pdf")) for k in (1, 2, 3)] == [5, 5, 2]
    api.split_pages(str(src), p("d%d.pdf"))
    assert (tmp_path / "d01.pdf").exists() and (tmp_path / "d12.pdf").exists()
    api.merge([api.MergeInput(p("b.pdf"), ["r1", "1"]), api.MergeInput(str(src))], p("m.pdf"))
    assert words(p("m.pdf")) == ["page 4", "page 2", *(f"page {k}" for k in range(1, 13))]
    api.merge([api.MergeInput(str(src))], p("copy.pdf"), byte_copy=True)
    assert (tmp_path / "copy.pdf").read_bytes() == src.read_bytes()
    for bad in ([api.SplitOutput("1", p("x.pdf")), api.SplitOutput("99", p("y.pdf"))], [api.SplitOutput("1", p("x.pdf")), api.SplitOutput("2", p("x.pdf"))]):
        with pytest.raises(FolioError):
            api.split(str(src), bad)
    assert not (tmp_path / "x.pdf").exists()
    with pytest.raises(FolioError):
        api.split_pages(str(src), p("x.pdf"))


def test_annotations_do_not_drag_pages_along():
    o = {
        1: {N("Type"): N("Catalog"), N("Pages"): Ref(2, 0)}, 2: {N("Type"): N("Pages"), N("Kids"): [Ref(3, 0), Ref(4, 0)], N("Count"): 2, N("MediaBox"): [0, 0, 9, 9]},
        3: {N("Type"): N("Page"), N("Parent"): Ref(2, 0), N("Annots"): [Ref(5, 0), Ref(6, 0)]}, 4: {N("Type"): N("Page"), N("Parent"): Ref(2, 0), N("Big"): b"x" * 500},
        5: {N("Type"): N("Annot"), N("Subtype"): N("Link"), N("Dest"): [Ref(4, 0), N("Fit")], N("P"): Ref(3, 0), N("Gone"): Ref(99, 0)},
        6: {N("Type"): N("Annot"), N("Subtype"): N("Widget"), N("Parent"): Ref(7, 0), N("P"): Ref(3, 0)}, 7: {N("T"): b"f", N("V"): b"v", N("Kids"): [Ref(6, 0)]},
    }
    d = open_document(write.file(o, Ref(1, 0)))
    got = open_document(A.assemble([A.Part(d, d.pages()[:1], False)]))
    page = got.get(got.pages()[0])
    link, widget = (got.resolve(a) for a in page["Annots"])
    assert link["Dest"][0] is None and link["P"].num == got.pages()[0] and got.resolve(link["Gone"]) is None
    field = got.resolve(widget["Parent"])
    assert field["V"] == b"v" and "Kids" not in field
    both = open_document(A.assemble([A.Part(d, d.pages(), False)]))
    first, second = both.pages()
    assert both.resolve(both.get(first)["Annots"][0])["Dest"][0].num == second
    none = open_document(A.assemble([A.Part(d, d.pages()[:1], False)], copy_annotations=False))
    assert "Annots" not in none.get(none.pages()[0])


def test_content():
    assert content.used_names(b"/F1 9 Tf /G gs /X Do /P scn BI /W 1 ID abc EI /Y Do") == {("Font", "F1"), ("ExtGState", "G"), ("XObject", "X"), ("Pattern", "P"), ("XObject", "Y")}
    assert content.strip_comments(b"(a%b) %x\n1") == b"(a%b)   \n1"


# --- text


def test_positions():
    t = runs(X.one_page(b"BT /F1 18 Tf 72 720 Td (Invoice) Tj ET\nBT /F1 12 Tf 72 700 Td [(Hello) -2000 (World)] TJ ET"))
    assert [r.text for r in t.runs] == ["Invoice", "Hello", "World"] and not t.degraded
    a, b, c = t.runs
    assert (round(a.x, 3), round(a.y, 3), a.font_size) == (72, 57.6, 18) and abs(a.width - 3.168 * 18) < 1e-3
    assert abs(b.y - 82.4) < 1e-3 and abs(c.x - (72 + 2.278 * 12 + 24)) < 1e-3


def test_rotated_and_spaced():
    t = runs(X.one_page(b"BT /F1 24 Tf 100 200 Td (Rotated) Tj ET", extra={N("Rotate"): 90}))
    assert (t.page_width if hasattr(t, "page_width") else t.width, t.height) == (792.0, 612.0)
    assert t.runs[0].height > t.runs[0].width and abs(t.runs[0].width - 24) < 1e-3
    t = runs(X.one_page(b"BT /F1 10 Tf 50 700 Td [(Scaled) -250 (Dot-Pr) 20 (oduct)] TJ 0 -20 Td [(Hello) -150 (world)] TJ 0 -20 Td [(Kern) -300 (g) 40 (ap)] TJ ET"))
    assert [r.text for r in t.runs] == ["Scaled Dot-Product", "Hello world", "Kern gap"]
    t = runs(X.one_page(b"BT /F1 10 Tf 2 Tr 50 700 Td (Both) Tj ET"))
    assert [r.text for r in t.runs] == ["Both"]


def test_fonts():
    t3 = {N("Type"): N("Font"), N("Subtype"): N("Type3"), N("FontMatrix"): [0.001, 0, 0, 0.001, 0, 0], N("Encoding"): {N("Differences"): [65, N("square")]}, N("FirstChar"): 65, N("Widths"): [750]}
    t = runs(X.one_page(b"BT /F1 12 Tf 72 720 Td (AAA) Tj ET", t3))
    assert [r.text for r in t.runs] == ["���"] and t.degraded
    names = X.HELV | {N("Encoding"): {N("Differences"): [65, N("f_i"), N("hyphen.case"), N("f_f_l")]}}
    t = runs(X.one_page(b"BT /F1 12 Tf 72 720 Td (ABC) Tj ET", names))
    assert t.runs[0].text == "fi-ffl" and not t.degraded
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0003> <0041> endbfchar 1 beginbfrange <0004> <0006> <0061> endbfrange"
    t0 = {N("Type"): N("Font"), N("Subtype"): N("Type0"), N("Encoding"): N("Identity-H"), N("DescendantFonts"): [{N("W"): [3, [500, 600]], N("DW"): 1000}], N("ToUnicode"): Ref(9, 0)}
    t = runs(X.one_page(b"BT /F1 10 Tf 72 720 Td <000300040006> Tj ET", t0, objects={9: Stream({}, cmap)}))
    assert t.runs[0].text == "Aac" and abs(t.runs[0].width - 21) < 1e-3


def note_page(n: int, flags=(4,)) -> bytes:
    form = Stream({N("Subtype"): N("Form"), N("BBox"): [0, 0, 100, 20], N("Resources"): {N("Font"): {N("F1"): Ref(4, 0)}}}, b"BT /F1 12 Tf 2 4 Td (Note) Tj ET")
    annots = [{N("Subtype"): N("Widget"), N("Rect"): [200, 600, 300, 620], N("F"): flags[k % len(flags)], N("AP"): {N("N"): Ref(9, 0)}} for k in range(n)]
    return X.one_page(b"BT /F1 18 Tf 72 720 Td (Body) Tj ET", extra={N("Annots"): annots}, objects={9: form})


def test_annotation_text():
    assert [r.text for r in runs(note_page(3, (4, 2, 32))).runs] == ["Body", "Note", "Note"]
    assert [r.text for r in runs(note_page(1), with_annotations=False).runs] == ["Body"]
    t = runs(note_page(4096))
    assert "Note" in {r.text for r in t.runs} and not t.degraded
    t = runs(note_page(4097))
    assert [r.text for r in t.runs] == ["Body"] and t.degraded


def test_text_json():
    assert [text.json_number(x) for x in (612.0, 1.0005, -0.0004999, 2.5, math.nan, math.inf)] == ["612", "1.001", "0", "2.5", "0", "0"]
    assert text.json_string('a"\\\n\x01é') == '"a\\"\\\\\\n\\u0001é"'
    import json

    page = json.loads(text.pages_json([runs(X.one_page(b"BT /F1 18 Tf 72 720 Td (Hi) Tj ET"))]))[0]
    assert page["page_width"] == 612 and page["runs"][0]["text"] == "Hi"


# --- drawing


def tiling(step: float) -> np.ndarray:
    pat = Stream({N("PatternType"): 1, N("PaintType"): 1, N("TilingType"): 1, N("BBox"): [0, 0, 20, 20], N("XStep"): step, N("YStep"): step, N("Resources"): {}}, b"1 0 0 rg 0 0 20 20 re f")
    b = X.one_page(b"/Pattern cs /P1 scn 0 0 200 200 re f", resources={N("Pattern"): {N("P1"): Ref(9, 0)}}, extra={N("MediaBox"): [0, 0, 200, 200]}, objects={9: pat})
    d = open_document(b)
    c = raster.Canvas(d, 400, 400)
    m, _, _ = text.page_transform(d, d.pages()[0])
    c.run(content.page_content(d, d.get(3)["Contents"]), d.get(3)["Resources"], text.mul(m, (2, 0, 0, 2, 0, 0)), None, 0)
    return c.img


def test_tilings():
    red, white = [255, 0, 0], [255, 255, 255]
    img = tiling(99999)
    assert img[390, 10].tolist() == red and img[10, 390].tolist() == white and img[340, 10].tolist() == white
    a, b = tiling(25), None
    raster.MAX_CELLS, most = 10, raster.MAX_CELLS
    try:
        b = tiling(25)
    finally:
        raster.MAX_CELLS = most
    assert np.abs(a.astype(int) - b).max() <= 1
    tiny = tiling(0.25)  # 640,000 cells, each larger than the step
    assert tiny[200, 200].tolist() == red and tiny[390, 10].tolist() == red
    img = tiling(50)
    assert img[390, 110].tolist() == red and img[390, 60].tolist() == white and img[290, 10].tolist() == red


def test_images_and_sizes(tmp_path):
    b = X.one_page(b"0 0 1 rg 10 10 100 50 re f 1 0 0 RG 4 w 200 200 m 300 200 l S q 100 0 0 100 300 300 cm /I Do Q", resources={N("XObject"): {N("I"): Ref(9, 0)}}, objects={9: Stream({N("Subtype"): N("Image"), N("Width"): 2, N("Height"): 1, N("ColorSpace"): N("DeviceGray"), N("BitsPerComponent"): 8}, b"\x00\x80")})
    (tmp_path / "a.pdf").write_bytes(b)
    out = api.render_pages(str(tmp_path / "a.pdf"), str(tmp_path / "p%d.png"), 72)
    png = (tmp_path / "p1.png").read_bytes()
    assert out == [str(tmp_path / "p1.png")] and png[:8] == b"\x89PNG\r\n\x1a\n" and int.from_bytes(png[16:20], "big") == 612
    import struct
    import zlib

    n = struct.unpack(">I", png[33:37])[0]
    img = np.frombuffer(zlib.decompress(png[41 : 41 + n]), dtype=np.uint8).reshape(792, 1 + 612 * 3)[:, 1:].reshape(792, 612, 3)
    assert img[792 - 30, 50].tolist() == [0, 0, 255] and img[792 - 200, 250].tolist() == [255, 0, 0]
    assert img[792 - 350, 320].tolist() == [0, 0, 0] and img[792 - 350, 380].tolist() == [128, 128, 128] and img[5, 5].tolist() == [255] * 3
    for bad in (0, -1, math.nan, math.inf):
        with pytest.raises(FolioError):
            api.render_pages(str(tmp_path / "a.pdf"), str(tmp_path / "q%d.png"), bad)
    (tmp_path / "e.pdf").write_bytes(X.encrypted("aes128", b"user"))
    with pytest.raises(FolioError) as e:
        api.render_pages(str(tmp_path / "e.pdf"), str(tmp_path / "q%d.png"))
    assert e.value.code == "unsupported"


# --- command line


def test_cli(tmp_path, capsys):
    f = tmp_path / "in.pdf"
    f.write_bytes(X.pages(3))
    run = lambda *a: cli.main([str(x) for x in a])
    assert run("page-count", f) == 0 and capsys.readouterr().out == "3\n"
    assert run("dimensions", f) == 0 and capsys.readouterr().out.startswith('{"pages":3,"page_sizes":[{"width":612,"height":792,"rotation":0},')
    assert run("split", f, "--out", "1", tmp_path / "a.pdf", "--out", "2-z", tmp_path / "b.pdf") == 0 and api.page_count(str(tmp_path / "b.pdf")) == 2
    assert run("merge", "-o", tmp_path / "m.pdf", tmp_path / "a.pdf", tmp_path / "b.pdf") == 0 and api.page_count(str(tmp_path / "m.pdf")) == 3
    assert run("split-pages", f, "-o", tmp_path / "s%d.pdf", "--pages-per-file", 2) == 0
    assert run("text", f, "--pages", "r1") == 0 and '"page":3' in capsys.readouterr().out
    assert run("render", f, "-o", tmp_path / "r%d.png", "--dpi", 36, "--pages", 1) == 0 and (tmp_path / "r1.png").exists()
    for bad in (("text", f, "--pages", "1;2"), ("page-count", tmp_path / "none.pdf"), ("split", f, "--out", "9", tmp_path / "z.pdf")):
        assert run(*bad) != 0 and capsys.readouterr().err.startswith("error: ")
    assert not (tmp_path / "z.pdf").exists()


# --- depth, predictors, what many outputs share


def test_deep_values():
    deep: list = []
    for _ in range(50_000):
        deep = [deep]
    b = X.one_page(b"", extra={N("Deep"): deep, N("Pair"): {N("A"): [1, Ref(4, 0), (b"x")]}})
    d = open_document(b)
    one = A.assemble([A.Part(d, d.pages(), False)])
    assert one.count(b"[") >= 50_000 and count(one) == 1
    assert write.value([[1, [b"a"], {N("K"): [N("x"), 2, 3.5]}], None, True]) == b"[[1[(a)]<</K[/x 2 3.5]>>] null true]"


def test_tiff_predictors():
    rng = np.random.default_rng(2)
    for bits, colors, columns in ((1, 1, 13), (2, 3, 5), (4, 3, 7), (8, 4, 5), (16, 3, 4)):
        plain = rng.integers(0, 1 << bits, (6, columns, colors))
        diff = np.diff(plain, axis=1, prepend=0) % (1 << bits)

        def packed(a, bits=bits):
            rows = []
            for line in a.reshape(6, -1):
                s = "".join(f"{int(x):0{bits}b}" for x in line)
                s += "0" * (-len(s) % 8)
                rows.append(bytes(int(s[i : i + 8], 2) for i in range(0, len(s), 8)))
            return b"".join(rows)

        assert filters.unpredict(packed(diff), {"Predictor": 2, "BitsPerComponent": bits, "Colors": colors, "Columns": columns}) == packed(plain)


def test_parts_share_what_all_pages_need():
    d = open_document(X.pages(12))
    base = A.template(d, d.pages())
    assert len(base.bodies) == 1  # the font
    for per_file in (1, 5):
        for k, b in enumerate(A.chunks(d, d.pages(), per_file)):
            part = open_document(b)
            want = A.assemble([A.Part(d, d.pages()[k * per_file : (k + 1) * per_file], True)])
            assert not part.repaired and len(part.xref) == len(open_document(want).xref)
            assert [text.page_text(part, n, 1).runs[0].text for n in part.pages()] == [f"page {i}" for i in range(k * per_file + 1, min(12, (k + 1) * per_file) + 1)]
    # a page that needs none of it is made without it
    odd = X.updated(X.pages(5), {d2.pages()[1]: {N("Type"): N("Page"), N("Parent"): Ref(2, 0)} for d2 in [open_document(X.pages(5))]})
    parts = [open_document(b) for b in A.chunks(open_document(odd), open_document(odd).pages(), 1)]
    assert [len(p.xref) for p in parts] == [5, 3, 5, 5, 5]


def test_what_follows_a_header():
    b = X.pages(2)
    swept = open_document(b[: b.rfind(b"xref\n0")] + b"\n4 0 obj ! prose about 5 0 obj of old\n")
    assert swept.repaired and len(swept.pages()) == 2


def test_forms_below_the_limit_are_told():
    n = text.MAX_FORM_DEPTH + 3
    forms = {20 + k: Stream({N("Type"): N("XObject"), N("Subtype"): N("Form"), N("BBox"): [0, 0, 9, 9], N("Resources"): {N("XObject"): {N("X"): Ref(21 + k, 0)}}}, b"/X Do") for k in range(n)}
    assert runs(X.one_page(b"/X Do", resources={N("XObject"): {N("X"): Ref(20, 0)}}, objects=forms)).degraded


# --- embedded fonts


def sfnt(chars: str, code_of=lambda k: 0xF000 + 65 + k, unicode: bool = True, names: list[str] = ()) -> bytes:
    """A TrueType program whose glyph k + 1 is ``chars[k]``, with a symbol map, and a Unicode map or names."""
    import struct

    def segments(pairs: list[tuple[int, int]]) -> bytes:
        pairs = sorted(pairs)
        ends, deltas = [c for c, _ in pairs] + [0xFFFF], [(g - c) & 0xFFFF for c, g in pairs] + [1]
        n = len(ends)
        body = struct.pack(f">HHHH{n}HH{n}H{n}H{n}H", 2 * n, 0, 0, 0, *ends, 0, *ends, *deltas, *[0] * n)
        return struct.pack(">HHH", 4, 6 + len(body), 0) + body

    maps = [(3, 0, segments([(code_of(k), k + 1) for k in range(len(chars))]))]
    if unicode:
        maps.append((3, 1, segments([(ord(c), k + 1) for k, c in enumerate(chars)])))
    at, head, bodies = 4 + 8 * len(maps), b"", b""
    for platform, way, b in maps:
        head += struct.pack(">HHI", platform, way, at + len(bodies))
        bodies += b
    tables = {b"cmap": struct.pack(">HH", 0, len(maps)) + head + bodies}
    if names:
        index = [0, *range(258, 258 + len(names))]
        tables[b"post"] = struct.pack(">I", 0x20000) + bytes(28) + struct.pack(f">H{len(index)}H", len(index), *index) + b"".join(bytes([len(n)]) + n.encode() for n in names)
    out, at = struct.pack(">IHHHH", 0x10000, len(tables), 0, 0, 0), 12 + 16 * len(tables)
    for tag, t in tables.items():
        out += struct.pack(">4sIII", tag, 0, at, len(t))
        at += len(t)
    return out + b"".join(tables.values())


def read_with(font: dict, shown: bytes, **objects) -> str:
    p = runs(X.one_page(b"BT /F1 10 Tf 72 700 Td " + shown + b" Tj ET", font, objects={int(k[1:]): v for k, v in objects.items()}))
    return "".join(r.text for r in p.runs)


def test_embedded_programs_give_text():
    simple = {N("Type"): N("Font"), N("Subtype"): N("TrueType"), N("BaseFont"): N("ABCDEF+X"), N("FontDescriptor"): Ref(10, 0), N("FirstChar"): 65, N("Widths"): [500] * 6}
    desc = lambda key, **k: {N("Type"): N("FontDescriptor"), N(key): Ref(11, 0)}
    assert read_with(simple, b"(ABC)", o10=desc("FontFile2"), o11=Stream({}, sfnt("wör"))) == "wör"
    assert read_with(simple, b"(AB)", o10=desc("FontFile2"), o11=Stream({}, sfnt("xy", unicode=False, names=["fi", "eacute"]))) == "fié"
    t1 = simple | {N("Subtype"): N("Type1")}
    clear = b"%!PS-AdobeFont\n/Encoding 256 array\n0 1 255 {1 index exch /.notdef put} for\ndup 65 /germandbls put\ndup 66/uni00E9 put\nreadonly def\ncurrentfile eexec \x80\x90"
    assert read_with(t1, b"(AB)", o10=desc("FontFile"), o11=Stream({}, clear)) == "ßé"
    # what the font dictionary says goes before what the program says
    assert read_with(simple | {N("Encoding"): N("WinAnsiEncoding")}, b"(ABC)", o10=desc("FontFile2"), o11=Stream({}, sfnt("wör"))) == "ABC"
    assert read_with(simple, b"(ABC)", o10=desc("FontFile2"), o11=Stream({}, b"\0\1\0\0\0\x09junk")) == "ABC"


def test_cff_programs_give_text():
    def index(items: list[bytes]) -> bytes:
        off = np.cumsum([1, *map(len, items)]).tolist()
        return len(items).to_bytes(2, "big") + (b"\x02" + b"".join(x.to_bytes(2, "big") for x in off) + b"".join(items) if items else b"")

    def program(top_of) -> bytes:
        num = lambda n: b"\x1d" + n.to_bytes(4, "big")
        strings = index([b"adieresis", b"f_i"])
        top = lambda at: num(at) + b"\x0f" + num(at + 20) + b"\x10" + num(at + 40) + b"\x11"
        size = len(index([top(0)]))
        at = 4 + len(index([b"X"])) + size + len(strings) + len(index([]))
        charset = b"\0" + b"".join(s.to_bytes(2, "big") for s in (34, 391, 392, 149))
        codes = b"\x01\x02" + bytes([65, 1, 97, 1])
        body = charset.ljust(20, b"\0") + codes.ljust(20, b"\0") + index([b"\x0e"] * 5)
        return b"\1\0\4\2" + index([b"X"]) + index([top(at)]) + strings + index([]) + body

    font = {N("Type"): N("Font"), N("Subtype"): N("Type1"), N("BaseFont"): N("X"), N("FontDescriptor"): Ref(10, 0), N("FirstChar"): 65, N("Widths"): [500] * 40}
    assert read_with(font, b"(ABab)", o10={N("FontFile3"): Ref(11, 0)}, o11=Stream({N("Subtype"): N("Type1C")}, program(None))) == "Aäfiß"


def test_embedded_code_maps():
    cmap = b"""begincmap 2 begincodespacerange <00> <7f> <8000> <ffff> endcodespacerange
    1 begincidrange <20> <7e> 1 endcidrange 2 begincidchar <8001> 300 <8002> 301 endcidchar endcmap"""
    kid = {N("Type"): N("Font"), N("Subtype"): N("CIDFontType2"), N("BaseFont"): N("X"), N("DW"): 600, N("W"): [300, [250, 750]], N("FontDescriptor"): Ref(12, 0), N("CIDToGIDMap"): Ref(14, 0)}
    gids = bytearray(2 * 302)
    gids[2 * 34 : 2 * 34 + 2], gids[600:602], gids[602:604] = b"\0\1", b"\0\2", b"\0\3"
    font = {N("Type"): N("Font"), N("Subtype"): N("Type0"), N("BaseFont"): N("X"), N("Encoding"): Ref(10, 0), N("DescendantFonts"): [Ref(11, 0)]}
    more = {"o10": Stream({N("Type"): N("CMap")}, cmap), "o11": kid, "o12": {N("FontFile2"): Ref(13, 0)}, "o13": Stream({}, sfnt("Aß字")), "o14": Stream({}, bytes(gids))}
    assert read_with(font, b"<41 8001 8002 41>", **more) == "Aß字A"
    p = runs(X.one_page(b"BT /F1 10 Tf 72 700 Td <8001800241> Tj ET", font, objects={int(k[1:]): v for k, v in more.items()}))
    assert abs(p.runs[0].width - 16) < 1e-3 and not p.degraded  # 250 + 750 + 600


def outlined() -> bytes:
    """A program with a square glyph, a ring drawn by curves, and one made of the square twice."""
    import struct

    def glyph(contours: list[list[tuple[int, int, int]]]) -> bytes:
        pts = [p for c in contours for p in c]
        ends = np.cumsum([len(c) for c in contours]) - 1
        dx, dy = np.diff([0, *[p[0] for p in pts]]), np.diff([0, *[p[1] for p in pts]])
        return struct.pack(f">h4h{len(ends)}HH", len(ends), 0, 0, 0, 0, *ends.tolist(), 0) + bytes(p[2] for p in pts) + struct.pack(f">{len(pts)}h", *dx.tolist()) + struct.pack(f">{len(pts)}h", *dy.tolist())

    square = glyph([[(0, 0, 1), (500, 0, 1), (500, 500, 1), (0, 500, 1)]])
    disc = glyph([[(0, 500, 0), (500, 500, 0), (500, 0, 0), (0, 0, 0)]])
    twice = struct.pack(">h4h", -1, 0, 0, 0, 0) + struct.pack(">HHhh", 1 | 2 | 32, 1, 0, 0) + struct.pack(">HHhhh", 1 | 2 | 8, 1, 600, 0, 8192)
    bodies = [b"", square, disc, twice]
    loca = np.cumsum([0, *map(len, bodies)])
    head = bytearray(54)
    head[18:20], head[50:52] = (1000).to_bytes(2, "big"), b"\0\1"
    base = sfnt("SDT")
    n, at = 3, 12
    cmap = base[int.from_bytes(base[20:24], "big") :]
    tables = {b"cmap": cmap, b"head": bytes(head), b"loca": b"".join(int(x).to_bytes(4, "big") for x in loca), b"glyf": b"".join(bodies)}
    out, at = struct.pack(">IHHHH", 0x10000, len(tables), 0, 0, 0), 12 + 16 * len(tables)
    for tag, t in tables.items():
        out += struct.pack(">4sIII", tag, 0, at, len(t))
        at += len(t)
    return out + b"".join(tables.values())


def drawn(b: bytes, scale: float = 1.0) -> np.ndarray:
    d = open_document(b)
    m, w, h = text.page_transform(d, d.pages()[0])
    c = raster.Canvas(d, int(w * scale), int(h * scale))
    c.run(content.page_content(d, d.get(3)["Contents"]), d.get(3)["Resources"], text.mul(m, (scale, 0, 0, scale, 0, 0)), None, 0)
    return c.img


def test_glyphs_are_drawn():
    font = {N("Type"): N("Font"), N("Subtype"): N("TrueType"), N("BaseFont"): N("X"), N("FontDescriptor"): Ref(10, 0), N("FirstChar"): 65, N("Widths"): [1000] * 3}
    objects = {10: {N("FontFile2"): Ref(11, 0)}, 11: Stream({}, outlined())}
    media = {N("MediaBox"): [0, 0, 200, 60]}
    img = drawn(X.one_page(b"1 0 0 rg BT /F1 40 Tf 10 10 Td (ABC) Tj ET", font, extra=media, objects=objects))
    red = (img == [255, 0, 0]).all(axis=2)
    assert red[60 - 30 : 60 - 10, 10:30].all() and red[:, 10:40].sum() == 400  # half an em square
    disc = red[:, 50:80].sum()
    assert 250 < disc < 340 and red[60 - 20, 60] and not red[60 - 29, 51]
    assert red[60 - 30 : 60 - 10, 90:110].all() and red[60 - 20 : 60 - 10, 114:124].all() and red[:, 90:150].sum() == 400 + 100
    type3 = {N("Type"): N("Font"), N("Subtype"): N("Type3"), N("FontMatrix"): [0.01, 0, 0, 0.01, 0, 0], N("FontBBox"): [0, 0, 100, 100], N("FirstChar"): 65, N("Widths"): [100], N("Encoding"): {N("Differences"): [65, N("box")]}, N("CharProcs"): {N("box"): Ref(12, 0)}}
    img = drawn(X.one_page(b"0 0 1 rg BT /F1 20 Tf 10 10 Td (AA) Tj ET", type3, extra=media, objects={12: Stream({}, b"0 0 50 50 re f")}))
    blue = (img == [0, 0, 255]).all(axis=2)
    assert blue.sum() == 200 and blue[60 - 20 : 60 - 10, 10:20].all() and blue[60 - 20 : 60 - 10, 30:40].all()
