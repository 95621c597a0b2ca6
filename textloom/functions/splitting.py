"""Cutting a text into chunks at its own borders: paragraphs, then lines, then words, then characters."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

#: Borders, from the coarsest on; the last one lies between any two characters.
BORDERS = ("\n\n", "\n", " ", "")


def _at_border(text: str, border: str) -> list[str]:
    """Pieces of a text; each but the first begins with its border."""
    if not border:
        return list(text)
    first, *rest = text.split(border)
    return [x for x in (first, *(border + r for r in rest)) if x]


def _joined(pieces: list[str], size: int, overlap: int) -> Iterator[str]:
    """Neighbouring pieces as chunks of up to ``size`` characters. The next chunk begins with the last pieces of the one before, as many as ``overlap`` and the new piece leave room for."""
    held: deque[str] = deque()
    total = 0
    for p in pieces:
        if held and total + len(p) > size:
            yield "".join(held)
            while total > overlap or (held and total + len(p) > size):
                total -= len(held.popleft())
        held.append(p)
        total += len(p)
    if held:
        yield "".join(held)


def chunks(text: str, size: int, overlap: int, borders: tuple[str, ...] = BORDERS) -> list[str]:
    """Chunks of up to ``size`` characters without outer white space. Only what is too long between two borders is cut at finer ones."""
    at = next(i for i, b in enumerate(borders) if not b or b in text)
    finer, out, fitting = borders[at + 1 :], [], []
    for piece in [*_at_border(text, borders[at]), None]:
        if piece is not None and len(piece) < size:
            fitting.append(piece)
            continue
        out += _joined(fitting, size, overlap)
        fitting = []
        if piece is not None:
            out += chunks(piece, size, overlap, finer) if finer else [piece]
    return [c for c in (x.strip() for x in out) if c]
