"""Brute-force twins of what the operators compute, in plain Python."""

from __future__ import annotations

import re
from fractions import Fraction


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words_of(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))


def shingle_set(text: str | None, k: int) -> set[tuple[str, ...]]:
    w = words_of(text)
    if not w:
        return set()
    return {tuple(w[i: i + k]) for i in range(max(1, len(w) - k + 1))}


def components(n: int, linked) -> list[int]:
    """Root (smallest number) of each of n items under the symmetric relation ``linked(i, j)``."""
    root = list(range(n))

    def top(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [top(i) for i in range(n)]


def jaccard(a: set, b: set) -> Fraction:
    return Fraction(len(a & b), len(a | b)) if a and b else Fraction(0)
