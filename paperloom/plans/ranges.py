"""The page-range language: ``1-3, 6, 9-``, labels before numbers, a narrowing and an order."""

from __future__ import annotations


class RangeError(ValueError):
    """A range that names no page."""


def _page(token: str, count: int, labels: list[str]) -> int:
    token = token.strip()
    if token in labels:
        return labels.index(token)
    if not token.isascii() or not token.removeprefix("+").isdigit():
        raise RangeError(f"{token!r} is neither a page number nor a label")
    if not 1 <= int(token) <= count:
        raise RangeError(f"page {token} is not within 1 to {count}")
    return int(token) - 1


def select_pages(count: int, text: str | None = None, labels: list[str] | None = None, subset: str = "all", reverse: bool = False) -> list[int]:
    """0-based pages in order.  ``subset`` odd or even goes by the place in the selection; none left raises."""
    labels = labels or []
    pages: list[int] = []
    parts = [p.strip() for p in (text or "").replace(";", ",").split(",") if p.strip()]
    for part in parts:
        first, dash, last = part.partition("-")
        if not dash or part in labels:
            pages.append(_page(part, count, labels))
            continue
        a = _page(first, count, labels) if first.strip() else 0
        b = _page(last, count, labels) if last.strip() else count - 1
        pages.extend(range(a, b + 1) if a <= b else range(a, b - 1, -1))
    if not (text or "").strip():
        pages = list(range(count))
    pages = pages[{"all": 0, "odd": 0, "even": 1}[subset] :: 1 if subset == "all" else 2]
    if reverse:
        pages.reverse()
    if not pages:
        raise RangeError("no pages are selected")
    return pages
