"""Inputs of a text classifier: measurements, and counts of hashed words and of three-byte sequences.

A batch of texts is measured at once on the bytes that Arrow holds: words are runs of
bytes that are not white space, and words, lines and windows of three words are told
apart by 64-bit hashes. A text without a word has zeros throughout. A very long text is
measured whole, in about a hundred bytes of memory for each of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Buckets of three-byte sequences within a word and of whole words, A-Z lower-cased.
SEQUENCES, WORDS = 256, 256
#: Bytes of text measured at once, one text at least.
AT_ONCE = 2_000_000
MEASURED = (
    "ln_words", "word_bytes", "symbols", "marks", "capitals", "digits", "exclamations",
    "other_bytes", "lines", "repeated_lines", "repeated_words", "repeated_windows", "short_words",
)

_BYTES = np.arange(256)
_SPACE = np.isin(_BYTES, [32, 9, 10, 11, 12, 13])
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_LOWERED = np.where(_UPPER, _BYTES + 32, _BYTES).astype(np.uint8)
#: Kinds of bytes that are counted in a text.
_KINDS = np.stack([
    ~_SPACE, np.isin(_BYTES, list(b"#$%&*+/<=>@[\\]^_`{|}~")), np.isin(_BYTES, list(b".,;:!?'\"-()")),
    _UPPER, (_BYTES >= 48) & (_BYTES <= 57), _BYTES == 33, _BYTES >= 128,
], axis=1).astype(float)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


#: Odd factors of the first places of a run.
_PLACES = _mixed(np.arange(1, 4097)) | np.uint64(1)


def _runs(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash of each run of values; starts are the runs' first places."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = np.diff(np.append(starts, len(values)))
    place = np.arange(len(values)) - np.repeat(starts, lengths)
    factor = _PLACES[place] if lengths.max() <= len(_PLACES) else _mixed(place + 1) | np.uint64(1)
    return _mixed(np.add.reduceat((values.astype(np.uint64) + np.uint64(1)) * factor, starts))


def _recurring(owner: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each owner: how many of its hashes are new to it, and how many occur in it twice or more."""
    key = np.sort(_mixed(hashes + _mixed(owner + 1)) & ~np.uint64((1 << 20) - 1) | (owner.astype(np.uint64) & np.uint64((1 << 20) - 1)))
    if not len(key):
        return np.zeros(n), np.zeros(n)
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    times = np.diff(np.append(first, len(key)))
    whose = (key[first] & np.uint64((1 << 20) - 1)).astype(np.int64)
    return np.bincount(whose, minlength=n), np.bincount(whose, np.where(times > 1, times, 0), n)


def measure(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Measurements (a row a text, in the order of MEASURED) and counts of hashed sequences and words as shares' roots, 0 to 255."""
    n = len(offsets) - 1
    data = data[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    owner = np.repeat(np.arange(n), np.diff(offsets))
    seen = np.bincount(owner * 256 + data, minlength=n * 256).reshape(n, 256)
    n_solid, n_symbols, n_marks, n_upper, n_digits, n_exclamations, n_other = (seen @ _KINDS).T
    solid = ~_SPACE[data]
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    starts = solid & (begins[:-1] | np.append(True, ~solid[:-1])[: len(data)])
    at = np.flatnonzero(starts)
    word_owner = owner[at]
    low, first = _LOWERED[data[solid]], starts[solid]
    word_starts = np.flatnonzero(first)
    hashes = _runs(low, word_starts)
    n_words = np.bincount(word_owner, minlength=n).astype(float)
    words, solids = np.maximum(n_words, 1), np.maximum(n_solid, 1)

    # a line is the sequence of its words; one without a word does not count
    line = np.cumsum(data == 10)[at] + word_owner
    line_starts = np.flatnonzero(np.append(True, line[1:] != line[:-1])[: len(line)])
    line_owner = word_owner[line_starts]
    n_lines = np.bincount(line_owner, minlength=n)
    new_lines, _ = _recurring(line_owner, _runs(hashes, line_starts), n)
    new_words, _ = _recurring(word_owner, hashes, n)
    inside = word_owner[2:] == word_owner[:-2]
    windows = _mixed(hashes[:-2] + _mixed(hashes[1:-1] + _mixed(hashes[2:])))[inside] if len(hashes) > 2 else np.zeros(0, np.uint64)
    window_owner = word_owner[2:][inside]
    _, again = _recurring(window_owner, windows, n)
    lengths = np.diff(np.append(word_starts, len(low)))
    measured = np.stack([
        np.log1p(n_words), n_solid / words, n_symbols / words, n_marks / words, n_upper / solids, n_digits / solids,
        n_exclamations / words, n_other / solids, n_lines / words, 1 - new_lines / np.maximum(n_lines, 1), 1 - new_words / words,
        again / np.maximum(n_words - 2, 1), np.bincount(word_owner, lengths == 1, n) / words,
    ], axis=1)
    measured[n_words == 0] = 0
    counts = np.zeros((n, SEQUENCES + WORDS))
    if len(low) > 2:
        within = np.flatnonzero(~(first[1:-1] | first[2:]))
        code = low[within].astype(np.uint32) | low[within + 1].astype(np.uint32) << np.uint32(8) | low[within + 2].astype(np.uint32) << np.uint32(16)
        bucket = ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64) % SEQUENCES
        bucket += np.repeat(word_owner, lengths)[within] * SEQUENCES
        counts[:, :SEQUENCES] = np.bincount(bucket, minlength=n * SEQUENCES).reshape(n, SEQUENCES)
    bucket = (hashes >> np.uint64(40)).astype(np.int64) % WORDS + word_owner * WORDS
    counts[:, SEQUENCES:] = np.bincount(bucket, minlength=n * WORDS).reshape(n, WORDS)
    for part in (slice(0, SEQUENCES), slice(SEQUENCES, None)):
        counts[:, part] /= np.maximum(counts[:, part].sum(axis=1, keepdims=True), 1)
    return measured, np.rint(255 * np.sqrt(counts)).astype(np.uint8)


def measure_array(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """measure() of an Arrow array of strings; a null is an empty text."""
    binary = texts.cast(pa.large_binary()).fill_null(b"")
    buffer = binary.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer else np.zeros(0, np.uint8)
    offsets = np.frombuffer(binary.buffers()[1], np.int64)[binary.offset : binary.offset + len(binary) + 1]
    return measure(data, offsets)
