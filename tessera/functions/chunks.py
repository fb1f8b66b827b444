"""Splitting one text into overlapping chunks."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.core import let

# Where to cut, from paragraphs down to single characters.
SEPARATORS = ("\n\n", "\n", " ", "")


def word_windows(text: Column, size: int, overlap: int) -> Column:
    """Array of chunks: chunk i holds the words from ``i * (size - overlap)`` on, ``size`` of them."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size")
    step = size - overlap
    def windows(words: Column) -> Column:
        last = F.greatest(F.ceil((F.size(words) - overlap) / step).cast("int") - 1, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last),
                           lambda i: F.array_join(F.slice(words, i * step + 1, F.lit(size)), " "))

    return let(F.regexp_extract_all(text, F.lit(r"[^ \t\n\r\f]+"), F.lit(0)), windows)


def _pack(pieces: list[str], size: int, overlap: int, measure: Callable[[str], int]) -> Iterator[str]:
    """Neighbouring pieces joined while they fit; each new chunk starts with up to ``overlap`` of the last."""
    window: deque[tuple[str, int]] = deque()
    total = 0
    for piece in pieces:
        n = measure(piece)
        if window and total + n > size:
            yield "".join(p for p, _ in window)
            while window and (total > overlap or total + n > size):
                total -= window.popleft()[1]
        window.append((piece, n))
        total += n
    if window:
        yield "".join(p for p, _ in window)


def _cut(text: str, separators: tuple[str, ...], size: int, overlap: int, measure: Callable[[str], int]) -> Iterator[str]:
    at = next(i for i, s in enumerate(separators) if s == "" or s in text or i == len(separators) - 1)
    separator, finer = separators[at], separators[at + 1:]
    if separator:
        head, *tail = text.split(separator)
        pieces = [head, *(separator + t for t in tail)]
    else:
        pieces = list(text)
    fitting: list[str] = []
    for piece in filter(None, pieces):
        if measure(piece) < size:
            fitting.append(piece)
            continue
        yield from _pack(fitting, size, overlap, measure)
        fitting = []
        if finer:
            yield from _cut(piece, finer, size, overlap, measure)
        else:
            yield piece
    yield from _pack(fitting, size, overlap, measure)


def recursive_split(text: str, size: int, overlap: int, measure: Callable[[str], int] = len,
                    separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most ``size`` by ``measure``, cut at the coarsest separator that fits."""
    return [c for c in (chunk.strip() for chunk in _cut(text, separators, size, overlap, measure)) if c]
