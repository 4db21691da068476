"""Syllabification of phone sequences."""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

Phones = tuple[str, ...]


def split_at_longest_onset(consonants: Sequence[str], onsets: set[Phones]) -> int | None:
    """Where the coda ends in consonants between two nuclei, so that the rest is the longest legal onset; None without consonants or legal onset."""
    run = tuple(consonants)
    return next((i for i in range(len(run) + 1) if run[i:] in onsets), None) if run else None


def split_at_longest_prefix(consonants: Sequence[str], onsets: set[Phones]) -> int | None:
    """For words without a nucleus: the end of the longest prefix that is a legal onset."""
    run = tuple(consonants)
    return next((i for i in range(len(run), -1, -1) if run[:i] in onsets), None) if run else None


# The share of what was counted that unseen onsets (codas) get, and what the empty sequence gets of that again.
UNSEEN_ONSETS, UNSEEN_CODAS, EMPTY = 0.05, 0.025, 0.5


def log_shares(counts: dict[Phones, int], unseen: float = UNSEEN_ONSETS) -> dict[Phones | None, float]:
    """Log relative frequencies; None stands for sequences not seen. The empty sequence has a fixed share, whatever its count."""
    seen = sum(counts.values())
    rest = seen * unseen
    shares = {**counts, None: rest, (): (seen + rest) * unseen * EMPTY}
    total = sum(shares.values())
    return {k: math.log(v / total) for k, v in shares.items()}


def _best(run: Phones, points: range, left: dict, right: dict) -> int:
    value = lambda i: left.get(run[:i], left[None]) + right.get(run[i:], right[None])
    return max(points, key=lambda i: (value(i), -i))


def split_by_probability(consonants: Sequence[str], onsets: dict, codas: dict) -> int | None:
    """The likeliest split into coda and onset, the first of equals; None without consonants. Both tables are log_shares."""
    run = tuple(consonants)
    return _best(run, range(len(run) + 1), codas, onsets) if run else None


def split_prefix_by_probability(consonants: Sequence[str], onsets: dict, codas: dict) -> int | None:
    """For words without a nucleus: the likeliest split into onset and coda."""
    run = tuple(consonants)
    return _best(run, range(len(run) + 1), onsets, codas) if run else None


class Syllable(NamedTuple):
    """Places (from 0) of a syllable's first phone, nucleus (-1: none) and last phone + 1."""

    first: int
    nucleus: int
    stop: int


def syllabify(phones: Sequence[str], nuclei: set[str], onsets, codas=None, method: str = "maxonset") -> list[Syllable]:
    """One syllable for each nucleus; a word without one is one syllable.

    Consonants before the first nucleus and after the last belong to theirs; those in between are
    split by the method (maxonset with a set of onsets, or probabilistic with two log_shares).
    Where no legal onset is among them, the whole run belongs to no syllable.
    """
    if not phones:
        return []
    at = [i for i, p in enumerate(phones) if p in nuclei]
    if not at:
        return [Syllable(0, -1, len(phones))]
    out, begin = [], 0
    for k, nucleus in enumerate(at):
        if k + 1 == len(at):
            out.append(Syllable(begin, nucleus, len(phones)))
            break
        run = phones[nucleus + 1 : at[k + 1]]
        cut = (split_at_longest_onset(run, onsets) if method == "maxonset" else split_by_probability(run, onsets, codas)) if run else 0
        if cut is None:
            out.append(Syllable(begin, nucleus, nucleus + 1))
            begin = at[k + 1]
        else:
            out.append(Syllable(begin, nucleus, nucleus + 1 + cut))
            begin = nucleus + 1 + cut
    return out
