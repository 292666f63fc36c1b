"""``python -m folio.cli``: split, split-pages, merge, page-count, dimensions, render, text."""

from __future__ import annotations

import argparse
import sys

from . import api
from .cos.objects import FolioError
from .cos.text import pages_json
from .functions.ranges import check


def _positive(s: str) -> int:
    n = int(s)
    if n < 1:
        raise argparse.ArgumentTypeError("must be at least 1")
    return n


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="folio")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("split")
    a.add_argument("input")
    a.add_argument("--out", nargs=2, action="append", required=True, metavar=("RANGE", "PATH"))
    a.add_argument("--password")
    a = sub.add_parser("split-pages")
    a.add_argument("input")
    a.add_argument("-o", "--output", required=True)
    a.add_argument("--pages-per-file", type=_positive, default=1)
    a.add_argument("--password")
    a = sub.add_parser("merge")
    a.add_argument("-o", "--output", required=True)
    a.add_argument("inputs", nargs="+")
    a.add_argument("--password")
    a = sub.add_parser("page-count")
    a.add_argument("input")
    a.add_argument("--strict", action="store_true")
    a.add_argument("--password")
    a = sub.add_parser("dimensions")
    a.add_argument("input")
    a.add_argument("--password")
    a = sub.add_parser("render")
    a.add_argument("input")
    a.add_argument("-o", "--output", required=True)
    a.add_argument("--dpi", type=float, default=150.0)
    a.add_argument("--pages")
    a = sub.add_parser("text")
    a.add_argument("input")
    a.add_argument("--pages")
    a.add_argument("--password")
    a.add_argument("--no-annotations", action="store_true")
    return p


def run(a: argparse.Namespace) -> None:
    if getattr(a, "pages", None) is not None:
        check(a.pages)
    if a.command == "split":
        api.split(a.input, [api.SplitOutput(*o) for o in a.out], a.password)
    elif a.command == "split-pages":
        api.split_pages(a.input, a.output, a.pages_per_file, a.password)
    elif a.command == "merge":
        api.merge([api.MergeInput(i) for i in a.inputs], a.output, a.password, byte_copy=True)
    elif a.command == "page-count":
        print(api.page_count(a.input, a.strict, a.password))
    elif a.command == "dimensions":
        print(api.dimensions_json(api.page_dimensions(a.input, a.password)))
    elif a.command == "render":
        api.render_pages(a.input, a.output, a.dpi, a.pages)
    else:
        print(pages_json(api.extract_text(a.input, a.pages, not a.no_annotations, a.password)))


def main(argv: list[str] | None = None) -> int:
    try:
        run(parser().parse_args(argv))
    except FolioError as x:
        print("error: " + x.message.replace("\n", " "), file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
