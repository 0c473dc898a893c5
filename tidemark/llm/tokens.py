"""Exact byte-level BPE ids of whole texts through the tokenizers library, each distinct piece encoded once.

The byte-level split never lets a piece run from a character that is not white
space into white space, so a text can be cut there without changing an id. A
batch of texts is cut at such spaces, its distinct chunks are encoded (most are
words that the worker has met before), and the ids of each text are gathered
from them. Nothing is trained and no id is guessed: texts with runs of white
space, and chunks that are not plain words, go to the tokenizer as they are.

This holds for byte-level BPE with its usual splitting pattern and no normalizer,
which the tokenizer's own settings tell. With any other setting, and for texts that
hold the string of an added token (``<|endoftext|>``, say, which the library gives
the token's id), the whole text goes to ``encode`` as it is.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# White space as the splitting pattern takes it: Python's less the four separators.
_CHUNK = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+")
# A line end or none, then a word, then marks: each of the three is one piece of the splitting pattern.
_WORD = re.compile(r"(\n?)((?<!\n) [A-Za-zÀ-ÖØ-öø-ÿ]+|[A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
_SPACED = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)\Z")
# Before such a space a text must not be cut.
_SPACE_AFTER_SPACE = r"[\t-\r\x20\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "
#: Pieces and chunks that a worker remembers; beyond it forgets all and starts anew, with the same ids.
REMEMBERED = {"pieces": 300_000, "chunks": 100_000}
#: Longer chunks are encoded each time.
LONGEST = 64
#: Bytes of text worked on at a time, one text at least.
AT_ONCE = 12_000_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Pieces(dict):
    """Piece of the splitting pattern to its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, model):
        self.model = model
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level vocabularies show as themselves
        hidden = [b for b in range(256) if b not in shown]
        self.alphabet = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def __missing__(self, piece: str) -> bytes:
        found = self.model.tokenize(piece.encode().decode("latin-1").translate(self.alphabet))
        packed = b"".join([token.id.to_bytes(4, "little") for token in found])
        if len(self) >= REMEMBERED["pieces"]:
            self.clear()
        self[piece] = packed
        return packed


def splits_at_spaces(settings: dict) -> bool:
    """Whether a tokenizer with these settings encodes the pieces of the splitting pattern one by one, as they are."""
    split, model = settings["pre_tokenizer"] or {}, settings["model"]
    return (
        settings["normalizer"] is None
        and settings["truncation"] is None
        and settings["padding"] is None
        and (split.get("type"), split.get("add_prefix_space"), split.get("use_regex")) == ("ByteLevel", False, True)
        and (model["type"], model.get("dropout") or 0) == ("BPE", 0)
        and not any(model.get(name) for name in ("unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
    )


def _quoted(text: str) -> str:
    """A pattern that matches the text alone."""
    return "".join(f"\\x{{{ord(c):x}}}" for c in text)


class Encoder(dict):
    """Chunk after a space, without that space, to its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pieces = Pieces(self.tokenizer.model)
        self.splits = splits_at_spaces(json.loads(self.tokenizer.to_str()))
        added = sorted({token.content for token in self.tokenizer.get_added_tokens_decoder().values()})
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.whole = "|".join([_SPACE_AFTER_SPACE, *map(_quoted, added)])

    def __missing__(self, chunk: str) -> bytes:
        if len(chunk) > LONGEST:
            return self.text(" " + chunk)
        if word := _SPACED.match(chunk):
            packed = self.pieces[" " + word[1]]
            if word[2]:
                packed += self.pieces[word[2]]
        else:
            packed = self.text(" " + chunk)
        if len(self) >= REMEMBERED["chunks"]:
            self.clear()
        self[chunk] = packed
        return packed

    def plain(self, text: str) -> bytes:
        """The ids of a text as the tokenizer gives them."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def text(self, text: str) -> bytes:
        """The ids of a text by itself, without added tokens in it."""
        out = []
        for chunk in _CHUNK.findall(text):
            if len(chunk) <= LONGEST and (word := _WORD.fullmatch(chunk)):
                line_end, letters, marks = word.groups()
                if line_end:
                    out.append(self.pieces[line_end])
                out.append(self.pieces[letters])
                if marks:
                    out.append(self.pieces[marks])
            else:
                out.append(self.plain(chunk))
        return b"".join(out)

    def odd(self, text: str) -> bytes:
        """The ids of a text that holds runs of spaces or an added token."""
        return self.plain(text) if self.added and self.added.search(text) else self.text(text)

    def texts(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text; a null text has none."""
        texts = pc.fill_null(texts, "")
        if not self.splits:
            return [self.plain(text.as_py()) for text in texts]
        odd = pc.match_substring_regex(texts, self.whole).to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(pc.if_else(pa.array(odd), "", texts), " ")
        starts = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        known = coded.dictionary.to_pylist()
        first = starts[:-1]
        packed = [self[chunk] for chunk in known] + [self.text(known[code]) for code in codes[first]]
        codes[first] = len(known) + np.arange(len(first))
        size = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        begin = np.concatenate(([0], np.cumsum(size)))[:-1]
        pool = np.frombuffer(b"".join(packed), "<u4")
        sizes = size[codes]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        ids = pool[np.repeat(begin[codes] - ends[:-1], sizes) + np.arange(ends[-1])]
        cuts = ends[starts]
        return [self.odd(texts[i].as_py()) if odd[i] else ids[cuts[i] : cuts[i + 1]].tobytes() for i in range(len(texts))]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder of a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces_of(texts: pa.Array, most: int = AT_ONCE) -> Iterator[pa.Array]:
    """The array in slices of about most bytes of text."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, side="right")))
        yield texts.slice(at, end - at)
        at = end
