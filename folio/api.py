"""One file at a time, without Spark: the operations of the command line.

The same code does the work inside the operators of ``folio.operators.files``.
"""

from __future__ import annotations

import os
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from pathlib import Path

from .cos import assemble as A
from .cos import geometry, raster
from .cos import text as T
from .cos.document import Document, nesting, with_repair
from .cos.lexer import MAX_DEPTH
from .cos.objects import FolioError
from .functions import ranges as R


@dataclass
class SplitOutput:
    pages: str
    path: str


@dataclass
class MergeInput:
    path: str
    groups: list[str] = field(default_factory=list)


@dataclass
class PageDimensions:
    width: float
    height: float
    rotation: int


def _read(path: str) -> bytes:
    try:
        return Path(path).read_bytes()
    except OSError as x:
        raise FolioError("io", f"{path}: {x.strerror}") from None


def _write(path: str, data: bytes) -> None:
    """Beside the target, then renamed onto it."""
    temp = f"{path}.{os.getpid()}.part"
    try:
        Path(temp).write_bytes(data)
        os.replace(temp, path)
    except OSError as x:
        Path(temp).unlink(missing_ok=True)
        raise FolioError("io", f"{path}: {x.strerror}") from None


def _writers() -> int:
    """How many files are written at once; ``FOLIO_WRITERS`` overrides 4."""
    try:
        return max(1, int(os.environ.get("FOLIO_WRITERS", "4")))
    except ValueError:
        return 4


def _write_all(files: list[tuple[str, bytes]]) -> None:
    with ThreadPoolExecutor(_writers()) as pool:
        list(pool.map(lambda f: _write(*f), files))


def _distinct(paths: list[str]) -> None:
    if len({os.path.abspath(p) for p in paths}) < len(paths):
        raise FolioError("io", "two outputs have the same path")


def page_count(path: str, strict: bool = True, password: str | None = None) -> int:
    return with_repair(_read(path), lambda d: d.count(strict), password, path)


def page_dimensions(path: str, password: str | None = None) -> list[PageDimensions]:
    return [PageDimensions(*x) for x in with_repair(_read(path), geometry.dimensions, password, path)]


def dimensions_json(sizes: list[PageDimensions]) -> str:
    def short(v: float) -> str:
        import numpy as np

        s = str(np.float32(v))
        return s.removesuffix(".0")

    return f'{{"pages":{len(sizes)},"page_sizes":[' + ",".join(f'{{"width":{short(p.width)},"height":{short(p.height)},"rotation":{p.rotation}}}' for p in sizes) + "]}"


def split(path: str, outputs: list[SplitOutput], password: str | None = None, copy_annotations: bool = True) -> None:
    """Every range is resolved before the first file is written."""
    _distinct([o.path for o in outputs])
    for o in outputs:
        R.check(o.pages)

    def run(d: Document) -> list[tuple[str, bytes]]:
        highest = [R.highest(o.pages) for o in outputs]
        pages = d.pages(None if None in highest else max(highest))
        if None not in highest and len(pages) < max(highest):
            pages = d.pages()
        chosen = [R.pages_of(o.pages, len(pages)) for o in outputs]
        return [(o.path, A.assemble([A.Part(d, [pages[n - 1] for n in c], h is not None or len(set(c)) < len(pages))], copy_annotations)) for o, c, h in zip(outputs, chosen, highest)]

    _write_all(with_repair(_read(path), run, password, path))


def split_pages(path: str, pattern: str, pages_per_file: int = 1, password: str | None = None, copy_annotations: bool = True) -> int:
    """The number of files written."""
    if pages_per_file < 1:
        raise FolioError("range", "pages per file must be at least 1")
    if pattern.count("%d") != 1:
        raise FolioError("io", "output pattern must contain exactly one %d")

    def run(d: Document) -> list[tuple[str, bytes]]:
        pages = A.whole(d)
        n = -(-len(pages) // pages_per_file)
        return [(pattern.replace("%d", str(k).zfill(len(str(n)))), b) for k, b in enumerate(A.chunks(d, pages, pages_per_file, copy_annotations), 1)]

    files = with_repair(_read(path), run, password, path)
    _write_all(files)
    return len(files)


def merge(inputs: list[MergeInput], output: str, password: str | None = None, byte_copy: bool = False, copy_annotations: bool = True) -> None:
    if not inputs:
        raise FolioError("range", "nothing to merge")
    from .operators.files import merge_to

    for i in inputs:
        for g in i.groups:
            R.check(g)
    if byte_copy and len(inputs) == 1 and not inputs[0].groups:
        data = _read(inputs[0].path)
        plain = with_repair(data, lambda d: not d.repaired and d.handler is None and bool(A.whole(d)), password, inputs[0].path)
        if plain and os.path.abspath(inputs[0].path) != os.path.abspath(output):
            _write(output, data)
            return
    parts = [(k, i.path, ";".join(i.groups) or None, _read(i.path)) for k, i in enumerate(inputs)]
    temp = Path(f"{output}.{os.getpid()}.part")
    try:
        with temp.open("wb") as f:
            merge_to(lambda: (f.seek(0), f.truncate()) and f.write, parts, password, copy_annotations)
        os.replace(temp, output)
    except OSError as x:
        raise FolioError("io", f"{output}: {x.strerror}") from None
    finally:
        temp.unlink(missing_ok=True)


def _selected(d: Document, pages: str | None) -> tuple[list[int], list[int]]:
    have = d.pages()
    return have, list(range(1, len(have) + 1)) if pages is None else list(dict.fromkeys(R.pages_of(pages, len(have))))


def extract_text(path: str, pages: str | None = None, annotations: bool = True, password: str | None = None) -> list[T.PageText]:
    buf = _read(path)
    if nesting(buf) > MAX_DEPTH:
        raise FolioError("pdf", f"{path}: nesting depth exceeds the limit")

    def run(d: Document) -> list[T.PageText]:
        have, order = _selected(d, pages)
        return [T.page_text(d, have[n - 1], n, annotations) for n in order]

    return with_repair(buf, run, password, path)


def render_pages(path: str, pattern: str, dpi: float = 150.0, pages: str | None = None) -> list[str]:
    """Paths of the images written."""
    if not 0 < dpi < float("inf"):
        raise FolioError("range", "dpi must be a positive number")
    if pattern.count("%d") != 1:
        raise FolioError("io", "output pattern must contain exactly one %d")

    def run(d: Document) -> list[tuple[str, bytes]]:
        have, order = _selected(d, pages)
        return [(pattern.replace("%d", str(n).zfill(len(str(len(have))))), raster.page_png(d, have[n - 1], dpi)[2]) for n in order]

    try:
        files = with_repair(_read(path), run, None, path)
    except FolioError as x:
        raise FolioError("unsupported", f"{path}: encrypted files cannot be rendered") if x.code == "password" else x
    _write_all(files)
    return [p for p, _ in files]
