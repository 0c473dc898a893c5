"""Words of many texts at once as 64-bit hashes, from the bytes that Arrow holds.

A-Z are lower-cased. Two different words, or sequences of words, have equal hashes with a
chance of 2^-64. A text of null is an empty one. Memory is about a hundred bytes for each
byte of the texts that are hashed at once: AT_ONCE of them, or one longer text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .text_features import _LOWERED, _mixed, _runs

AT_ONCE = 4_000_000


def byte_class(characters: bytes) -> np.ndarray:
    """Of each byte whether it is one of characters."""
    return np.isin(np.arange(256), list(characters))


SPACE = byte_class(b" \t\n\x0b\x0c\r")


def parts(texts: pa.Array, at_once: int = AT_ONCE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, bytes, offsets) of consecutive texts that together have at_once bytes at most, or of one longer text."""
    binary = texts.cast(pa.large_binary()).fill_null(b"")
    data = np.frombuffer(binary.buffers()[2] or b"", np.uint8)
    offsets = np.frombuffer(binary.buffers()[1], np.int64)[binary.offset : binary.offset + len(binary) + 1]
    at = 0
    while at < len(binary):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + at_once, "right")) - 1)
        own = offsets[at : end + 1]
        yield at, data[own[0] : own[-1]], own - own[0]
        at = end


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and first byte of each word, a run of bytes that are not space."""
    solid = ~space[data]
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    starts = solid & (begins[:-1] | np.append(True, ~solid[:-1])[: len(data)])
    at = np.flatnonzero(starts)
    hashes = _runs(_LOWERED[data[solid]], np.flatnonzero(starts[solid]))
    return hashes, np.searchsorted(offsets, at, "right") - 1, at


def longer(windows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Hashes of windows that are a word longer; windows are those of one length from each place on."""
    n = len(windows) - 1
    return _mixed(windows[:-1] + hashes[len(hashes) - n :] * np.uint64(3)) if n > 0 else windows[:0]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct windows of width words of each text, ascending, and where each text's begin. Fewer words make one window, none make none."""
    n = len(offsets) - 1
    hashes, owner, _ = words(data, offsets)
    many = np.bincount(owner, minlength=n)
    window = hashes
    for _ in range(width - 1):
        window = longer(window, hashes)
    whole = owner[: len(window)] == owner[len(hashes) - len(window) :] if len(window) else np.zeros(0, bool)
    window, whose = window[whole], owner[: len(window)][whole]
    short = np.flatnonzero((many > 0) & (many < width))
    if len(short):
        first, extra = np.searchsorted(owner, short), []
        for i, t in zip(first, short, strict=True):
            x = hashes[i : i + 1]
            for k in range(1, many[t]):
                x = _mixed(x + hashes[i + k : i + k + 1] * np.uint64(3))
            extra.append(int(_mixed(x + np.uint64(width))[0]))
        window, whose = np.append(window, np.array(extra, np.uint64)), np.append(whose, short)
    order = np.lexsort((window, whose))
    window, whose = window[order], whose[order]
    new = np.append(True, (window[1:] != window[:-1]) | (whose[1:] != whose[:-1]))[: len(window)]
    return window[new], np.concatenate(([0], np.cumsum(np.bincount(whose[new], minlength=n))))
