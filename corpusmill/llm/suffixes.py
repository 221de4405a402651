"""Suffix order of many short strings by two-stage sorting, and their adjacent common prefixes.

Strings count as followed by zero bytes without end. A position is *rising* if its suffix
is smaller than the next one. Rising suffixes are sorted directly; the others follow by
one scan over the buckets of first bytes, since each comes right behind its successor's
place among those that start with the same byte.
"""

from __future__ import annotations

import numpy as np


def words_at(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as a big-endian number, zero behind the string's end."""
    n = len(text)
    wide = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(8):
        out |= wide[i : i + n] << np.uint64(56 - 8 * i)
    cut = np.maximum(8 - (ends - np.arange(n)), 0).astype(np.uint64) * np.uint64(8)
    return (out >> cut) << cut


def rising(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor; a last one never is."""
    n = len(text)
    after = np.append(text[1:], 0).astype(np.int16)
    after[ends - 1 == np.arange(n)] = 0
    step = after - text
    step[(ends - 1 == np.arange(n)) & (step == 0)] = -1
    decided = np.where(step != 0, np.arange(n), n)
    decided = np.minimum.accumulate(decided[::-1])[::-1]
    return step[decided] > 0


def _sorted_directly(at: np.ndarray, words: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """Positions by their suffixes, eight bytes at a time among those still equal."""
    order = np.argsort(words[at], kind="stable")
    at = at[order]
    value = words[at]
    tied = np.zeros(len(at), np.int64)  # place at which each group of equal ones begins
    begin = np.zeros(len(at), bool)
    begin[:1] = True
    for offset in range(8, depth + 8, 8):
        begin[1:] |= value[1:] != value[:-1]
        tied = np.maximum.accumulate(np.where(begin, np.arange(len(at)), 0))
        alone = begin & np.append(begin[1:], True)
        open_at = np.flatnonzero(~alone)
        if offset > depth or not len(open_at):
            break
        next_at = at[open_at] + offset
        inside = next_at < ends[at[open_at]]
        key = np.where(inside, words[np.minimum(next_at, len(words) - 1)], 0)
        order = np.lexsort((key, tied[open_at]))
        at[open_at] = at[open_at][order]
        value = value.copy()
        value[open_at] = key[order]
    return at


def suffix_order(text: np.ndarray, ends: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The wanted positions by the first ``depth`` bytes of their suffixes.

    ``ends`` is, for each position, where its string ends; ``wanted`` marks positions. Those
    that a wanted one leads to up to the next rising one are ordered with them.
    """
    n = len(text)
    up = rising(text, ends)
    number = np.arange(n)
    last = ends - 1 == number
    stop = np.minimum.accumulate(np.where(up | last, number, n)[::-1])[::-1]  # next rising or last one
    marks = np.zeros(n + 1, np.int64)
    first = np.flatnonzero(wanted)
    np.add.at(marks, first, 1)
    np.add.at(marks, stop[first] + 1, -1)
    member = np.cumsum(marks)[:-1] > 0
    words = words_at(text, ends)
    direct = _sorted_directly(np.flatnonzero(member & up), words, ends, depth)
    # last positions of their strings have no successor: they come first in their bucket
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    tails = np.flatnonzero(member & last & ~up)
    for byte in np.unique(text[tails]):
        waiting[byte].append(tails[text[tails] == byte])
    limits = np.searchsorted(text[direct], np.arange(257))
    out = []

    def induce(found: np.ndarray, byte: int) -> np.ndarray:
        """Puts what precedes the found suffixes into its buckets; returns those of the same bucket."""
        before = found[(found > 0)] - 1
        before = before[member[before] & ~up[before] & ~last[before]]
        first_bytes = text[before]
        for own in np.unique(first_bytes):
            if own > byte:
                waiting[own].append(before[first_bytes == own])
        return before[first_bytes == byte]

    for byte in range(256):
        wave = np.concatenate(waiting[byte]) if waiting[byte] else np.zeros(0, np.int64)
        while len(wave):
            out.append(wave)
            wave = induce(wave, byte)
        tail = direct[limits[byte] : limits[byte + 1]]
        if len(tail):
            out.append(tail)
            induce(tail, byte)
    order = np.concatenate(out) if out else np.zeros(0, np.int64)
    return order[wanted[order]]


def shared(order: np.ndarray, text: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """For each neighbouring pair in the order, whether the common prefix has ``length`` bytes."""
    words = words_at(text, ends)
    a, b = order[:-1], order[1:]
    equal = (ends[a] - a >= length) & (ends[b] - b >= length)
    for offset in range(0, length, 8):
        left = np.flatnonzero(equal)
        shift = np.uint64(8 * max(0, 8 - (length - offset)))
        equal[left] = words[a[left] + offset] >> shift == words[b[left] + offset] >> shift
    return equal
