"""Word shingles of many texts at once, as sorted sets of 64-bit hashes."""

from __future__ import annotations

import numpy as np

from reportmill.llm.batches import BLANKS, LOWER
from reportmill.llm.suffixes import Hashed, mix, spread

WORDS = 5
_LOWER = np.frombuffer(LOWER, np.uint8)
_IN_WORD = np.ones(256, bool)
_IN_WORD[list(BLANKS)] = False
# One odd multiplier for each place in a shingle, and one for the length of short ones.
_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
_SHORT = np.uint64(0xD6E8FEB86659FD93)


def word_hashes(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words with A-Z lowered, words of each text)."""
    texts = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(texts, np.int64)
    data = _LOWER[data]
    inside = _IN_WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[offsets] = True  # words end with their text
    bounds = np.flatnonzero(edge)
    words = inside[bounds[:-1]]
    starts, sizes = bounds[:-1][words], np.diff(bounds)[words]
    counts = np.bincount(np.searchsorted(offsets, starts, "right") - 1, minlength=texts)
    return mix(Hashed(data).of(starts, sizes)), counts


def shingle_sets(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sizes): the distinct shingles of each text, ascending within it, one text after another.

    A text of fewer than WORDS words has all of them as one shingle; a text without words has none.
    """
    words, counts = word_hashes(offsets, data)
    first = np.cumsum(counts) - counts
    full = np.maximum(counts - (WORDS - 1), 0)
    place = spread(first, full)
    made = np.zeros(len(place), np.uint64)
    for k in range(WORDS):
        made += words[place + k] * _PLACES[k]
    short = np.flatnonzero((counts > 0) & (counts < WORDS))
    few = counts[short].astype(np.uint64) * _SHORT
    for k in range(WORDS - 1):
        has = counts[short] > k
        few[has] += words[first[short[has]] + k] * _PLACES[k]
    owner = np.concatenate([np.repeat(np.arange(len(counts)), full), short])
    hashes = mix(np.concatenate([made, few]))
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], np.bincount(owner[new], minlength=len(counts))
