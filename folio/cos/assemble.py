"""Building a new file from pages of others."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

from . import content, write
from .document import Document, classify
from .objects import FolioError, Name, Ref, Stream, invalid

#: What a page takes from its ancestors. Fixed values.
INHERITED = ("Resources", "MediaBox", "CropBox", "Rotate")
STRUCTURE = {"Page", "Pages", "Catalog", "StructTreeRoot"}
PRUNED = ("Font", "XObject")
#: Fonts and forms a dictionary must name before pruning it is worth a look.
PRUNE_ABOVE = 6
MAX_DEPTH = 256


class Part(NamedTuple):
    """Pages of one document, by object number, in the order wanted; a number may come twice."""

    doc: Document
    pages: list[int]
    prune: bool


class Output:
    """The file to be, written object by object as they are finished; numbers are given in the order objects are first reached.

    ``base`` holds what many outputs share: its objects come first, with the same numbers in each.
    """

    def __init__(self, sink: Callable[[bytes], Any], copy_annotations: bool = True, base: Template | None = None):
        self.writer = write.Writer(sink)
        self._last = 2
        self.kids: list[Ref] = []
        self.info: Ref | None = None
        self.metadata: Ref | None = None
        self.copy_annotations = copy_annotations
        if base is not None:
            self._last = base.last
            for num, body in base.bodies:
                self.writer.raw(num, body)

    def new(self) -> int:
        self._last += 1
        return self._last

    def put(self, num: int, v: Any) -> None:
        self.writer.object(num, v)

    def finish(self) -> None:
        catalog = {Name("Type"): Name("Catalog"), Name("Pages"): Ref(2, 0)}
        if self.metadata:
            catalog[Name("Metadata")] = self.metadata
        self.put(1, catalog)
        self.put(2, {Name("Type"): Name("Pages"), Name("Kids"): self.kids, Name("Count"): len(self.kids)})
        self.writer.finish(Ref(1, 0), self.info)


class Template:
    """Objects that many outputs of one document share, in the bytes and with the numbers they have in each."""

    def __init__(self, numbers: dict[int, int], bodies: list[tuple[int, bytes]], links: dict[int, set[int]]):
        self.numbers, self.bodies, self.links = numbers, bodies, links
        self.last = max(numbers.values(), default=2)
        self._known: dict[frozenset, bool] = {}

    def all_reached(self, touched: frozenset) -> bool:
        """Whether the shared objects are just those that ``touched`` lead to: else an output would hold what it has no use for."""
        if touched not in self._known:
            seen, todo = set(touched), list(touched)
            while todo:
                new = self.links[todo.pop()] - seen
                seen |= new
                todo += new
            self._known[touched] = len(seen) == len(self.numbers)
        return self._known[touched]


class Copier:
    """Copies from one document into an output; what pages share is copied once."""

    def __init__(self, doc: Document, out: Output):
        self.doc, self.out = doc, out
        self.map: dict[int, int] = {}
        self.touched: set[int] = set()
        self.todo: list[tuple[int, bool]] = []
        self.later: list[tuple[int, dict, Any]] = []  # pages that wait for their annotations
        self.prune_forms = False

    def inherited(self, num: int, key: str) -> Any:
        """The nearest value of ``key`` on the page or above it; a broken chain is an error."""
        seen = set()
        while True:
            if num in seen or len(seen) > MAX_DEPTH:
                raise invalid(f"parents of page {num} form a cycle")
            seen.add(num)
            v = self.doc.get(num)
            if not isinstance(v, dict):
                return None
            if v.get(key) is not None:
                return v[key]
            p = v.get("Parent")
            if p is None:
                return None
            if not isinstance(p, Ref):
                raise invalid(f"parent of object {num} is not a reference")
            num = p.num

    def page(self, num: int, prune: bool) -> None:
        v = self.doc.get(num)
        if classify(v, num)[0] != "Page":
            raise invalid(f"object {num} is not a page")
        attrs = {k: self.inherited(num, k) for k in INHERITED}
        p = {k: x for k, x in v.items() if k != "Parent" and (k != "Annots" or self.out.copy_annotations)}
        p |= {Name(k): x for k, x in attrs.items() if x is not None}
        if prune:
            p[Name("Resources")] = self.pruned(p.get("Contents"), p.get("Resources"))
        own = self.out.new()
        self.map.setdefault(num, own)
        self.out.kids.append(Ref(own, 0))
        done = {}
        for k, x in p.items():
            if k == "Annots":
                continue
            done[k] = self.value(x, False)
        done[Name("Parent")] = Ref(2, 0)
        if "Annots" in p:
            self.later.append((own, done, p["Annots"]))
        else:
            self.out.put(own, done)
        self.drain()

    def annots(self) -> None:
        """Annotations come last: only then is it known which pages came along."""
        for own, page, x in self.later:
            self.out.put(own, page | {Name("Annots"): self.value(x, True)})
            self.drain()
        self.later.clear()

    def value(self, v: Any, guarded: bool) -> Any:
        """``v`` with references renumbered; ``guarded`` cuts those that lead back into the document's structure.

        Nesting costs no recursion: containers are made empty and filled from a list of what is left to do.
        """
        if isinstance(v, Stream):
            return Stream(self.value({k: x for k, x in v.dict.items() if k != "Length"}, guarded), v.raw)
        top: list = [None]
        todo: list[tuple[Any, Any, Any]] = [(top, 0, v)]
        while todo:
            into, key, x = todo.pop()
            if isinstance(x, Ref):
                x = self.reference(x, guarded)
            elif isinstance(x, list):
                x, old = [None] * len(x), x
                todo += [(x, i, y) for i, y in reversed(list(enumerate(old)))]
            elif isinstance(x, dict):
                x, old = dict.fromkeys(k for k in x if not (guarded and k == "Kids")), x
                todo += [(x, k, old[k]) for k in reversed(x)]
            into[key] = x
        return top[0]

    def reference(self, r: Ref, guarded: bool) -> Any:
        if r.num in self.map:
            self.touched.add(r.num)
            return Ref(self.map[r.num], 0)
        if guarded:
            v = self.doc.get(r.num)
            d = v.dict if isinstance(v, Stream) else v
            if isinstance(d, dict) and (str(d.get("Type")) in STRUCTURE):
                return None
        n = self.map[r.num] = self.out.new()
        self.todo.append((r.num, guarded))
        return Ref(n, 0)

    def drain(self) -> None:
        while self.todo:
            num, guarded = self.todo.pop()
            v = self.doc.get(num)  # null if missing
            if isinstance(v, Stream) and self.prune_forms:
                v = self.pruned_form(v)
            if isinstance(v, dict) and v.get("Type") == "Page":
                v = {k: x for k, x in v.items() if k != "Parent"}
            self.out.put(self.map[num], self.value(v, guarded))

    # -- pruning

    def _large(self, res: dict) -> bool:
        return sum(len(t) for k in PRUNED if isinstance(t := self.doc.resolve(res.get(k)), dict)) > PRUNE_ABOVE

    def _keep(self, res: dict, data: bytes) -> dict | None:
        """``res`` with only the fonts and forms that are used; None if that cannot be told."""
        try:
            names = content.names_with_forms(self.doc, data, res)
        except (FolioError, TypeError, AttributeError):
            return None
        out = {}
        for k, v in res.items():
            t = self.doc.resolve(v)
            out[k] = {n: x for n, x in t.items() if (str(k), str(n)) in names} if k in PRUNED and isinstance(t, dict) else v
        return out

    def pruned(self, contents: Any, resources: Any) -> Any:
        res = self.doc.resolve(resources)
        if not isinstance(res, dict):
            return resources
        self.prune_forms = True
        if not self._large(res):
            return resources
        try:
            data = content.strip_comments(content.page_content(self.doc, contents))
        except FolioError:
            return resources
        kept = self._keep(res, data)
        return resources if kept is None else kept

    def pruned_form(self, s: Stream) -> Stream:
        res = self.doc.resolve(s.dict.get("Resources"))
        if s.dict.get("Subtype") != "Form" or not isinstance(res, dict) or not self._large(res):
            return s
        try:
            data = content.strip_comments(self.doc.decoded(s))
        except FolioError:
            return s
        kept = self._keep(res, data)
        return s if kept is None else Stream(s.dict | {Name("Resources"): kept}, s.raw)

    # -- metadata

    def donate(self) -> None:
        """Document information and XMP; whatever is wrong with them, they never fail the copy."""
        try:
            info = self.doc.trailer.get("Info")
            if isinstance(info, Ref) and isinstance(self.doc.resolve(info), dict):
                self.out.info = self.reference(info, True)
            elif isinstance(info, dict):
                v = self.value(info, True)
                self.out.info = Ref(self.out.new(), 0)
                self.out.put(self.out.info.num, v)
            xmp = self.doc.catalog().get("Metadata")
            if isinstance(xmp, Ref) and isinstance(self.doc.resolve(xmp), Stream):
                self.out.metadata = self.reference(xmp, True)
            self.drain()
        except FolioError:
            pass


def assemble_to(sink: Callable[[bytes], Any], parts: list[Part], copy_annotations: bool = True) -> None:
    """One file of all ``parts`` in order, into ``sink``; the first gives the metadata. What is copied is not kept."""
    out = Output(sink, copy_annotations)
    for k, part in enumerate(parts):
        c = Copier(part.doc, out)
        if k == 0:
            first = c
        for n in part.pages:
            c.page(n, part.prune)
        c.annots()
    if parts:
        first.donate()
    out.finish()


def assemble(parts: list[Part], copy_annotations: bool = True) -> bytes:
    out = io.BytesIO()
    assemble_to(out.write, parts, copy_annotations)
    return out.getvalue()


def template(doc: Document, pages: list[int]) -> Template | None:
    """What the first, the middle and the last of ``pages`` all need; None if that is nothing, or takes in a page."""
    shared: set[int] | None = None
    for n in {pages[0], pages[len(pages) // 2], pages[-1]}:
        c = Copier(doc, Output(lambda b: None, False))
        c.page(n, True)
        shared = set(c.map) if shared is None else shared & set(c.map)
    if len(pages) < 3 or not shared or any(isinstance(v := doc.get(n), dict) and v.get("Type") == "Page" for n in shared):
        return None
    got: list[bytes] = []
    out = Output(got.append, False)
    c = Copier(doc, out)
    c.prune_forms = True
    links: dict[int, set[int]] = {}
    bodies = []
    for n in sorted(shared):
        c.reference(Ref(n, 0), False)
    while c.todo:
        num, _ = c.todo.pop()
        got.clear()
        c.touched = set()
        before = set(c.map)
        v = doc.get(num)
        out.put(c.map[num], c.value(c.pruned_form(v) if isinstance(v, Stream) else v, False))
        if set(c.map) != before:  # what three pages share leads to nothing else, or it is no template
            return None
        links[num] = set(c.touched)
        bodies.append((c.map[num], b"".join(got)))
    return Template(dict(c.map), sorted(bodies), links)


def chunks(doc: Document, pages: list[int], per_file: int, copy_annotations: bool = True) -> Iterator[bytes]:
    """Files of ``per_file`` of ``pages`` each. What all share is copied once; a file that needs less is made without that."""
    base = template(doc, pages) if len(pages) > per_file else None
    for at in range(0, len(pages), per_file):
        part = pages[at : at + per_file]
        if base is not None:
            buf = io.BytesIO()
            out = Output(buf.write, copy_annotations, base)
            c = Copier(doc, out)
            c.map = dict(base.numbers)
            for n in part:
                c.page(n, True)
            c.annots()
            if base.all_reached(frozenset(c.touched & set(base.numbers))):
                c.donate()
                out.finish()
                yield buf.getvalue()
                continue
        yield assemble([Part(doc, part, True)], copy_annotations)


# --- a file's own pages, selected and cut


def select(doc: Document, order: list[int], pages: list[int] | None = None) -> list[int]:
    """Object numbers of 1-based page numbers."""
    have = doc.pages() if pages is None else pages
    if any(n > len(have) for n in order):
        raise FolioError("range", f"page {max(order)} is out of range (document has {len(have)} pages)")
    return [have[n - 1] for n in order]


def whole(doc: Document) -> list[int]:
    p = doc.pages()
    if not p:
        raise FolioError("range", "document has no pages")
    return p
