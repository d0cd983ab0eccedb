"""Token ids of whole texts, encoded part by part with a bounded memory of parts.

Public tokenizers never merge across a single space before a visible
character, so such parts can be encoded once and looked up afterwards. Other
white space stays inside its part. Tokenizers that split words from signs
before they merge also never merge a letter with a stop or comma behind it.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterable, Sequence
from functools import cache
from itertools import chain

import numpy as np

CACHED_PARTS = 1 << 19  # of an encoder; about 120 bytes each
LONG_PART = 64  # characters; longer parts are not remembered
# a space not followed by a character that is visible everywhere
_ODD = re.compile(" (?![!-~¡-ᙿ])")
_EVEN = re.compile(" [!-~¡-ᙿ]")
# a stop or comma that does not stand right behind a letter or digit
_LOOSE = re.compile("(?<![^\\W_])[.,]")
_WIDE = re.compile("[^\\0-ÿ]")
RAW = "\0"  # before a part without a leading space


class PartEncoder:
    """Ids of texts from the ids of their parts.

    ``encode`` takes a list of parts. New parts of Latin-1 letters only are
    encoded side by side as one text, parted again where the tokens of ``starts``
    begin. ``table`` has the bytes of each id and ``bytes_of`` those of a
    part; texts with parts that their ids do not spell are told by ``changed``.
    """

    TOGETHER = 1_000

    def __init__(
        self, encode: Callable[[list[str]], Sequence[Sequence[int]]], split: Callable[[str], list[str]], starts: np.ndarray,
        table: list[bytes] | None = None, bytes_of: Callable[[str], bytes] | None = None,
    ):
        self.encode, self.split, self.starts, self.table, self.bytes_of = encode, split, starts, table, bytes_of
        self.known: dict[str, bytes] = {}
        self.odd: set[str] = set()
        self.changed: list[bool] = []

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > CACHED_PARTS:
            self.known.clear()
            self.odd.clear()
        parts = [self.split(text) for text in texts]
        known = self.known
        new = set().union(*parts).difference(known)
        self._learn(sorted(new))
        joined = [b"".join(map(known.__getitem__, x)) for x in parts]
        self.changed = [bool(self.odd) and not self.odd.isdisjoint(x) for x in parts]
        for part in new:
            if len(part) > LONG_PART:
                del known[part]
                self.odd.discard(part)
        return [np.frombuffer(x, np.uint32) for x in joined]

    def _learn(self, parts: list[str]) -> None:
        letters = [x for x in parts if x.isalpha() and (x.isascii() or not _WIDE.search(x))]
        for low in range(0, len(letters), self.TOGETHER):
            here = letters[low : low + self.TOGETHER]
            ids = np.array(self.encode([" ".join(here)])[0], np.uint32)
            at = self._starts(ids)
            raw, ends = ids.tobytes(), [*at[1:].tolist(), len(ids)]
            self.known.update((part, raw[4 * start : 4 * end]) for part, start, end in zip(here, at.tolist(), ends))
            if self.table and b"".join([self.table[i] for i in ids.tolist()]) != b" " + " ".join(here).encode():
                self.odd.update(part for part in here if not self._spells(part, np.frombuffer(self.known[part], np.uint32).tolist()))
        taken = set(letters)
        rest = [x for x in parts if x not in taken]
        for part, ids in zip(rest, self.encode(rest)):
            self.known[part] = array("I", ids).tobytes()
            if self.table and not self._spells(part, ids):
                self.odd.add(part)

    def _starts(self, ids: np.ndarray) -> np.ndarray:
        return np.flatnonzero(self.starts[ids])

    def _spells(self, part: str, ids: Sequence[int]) -> bool:
        return b"".join([self.table[i] for i in ids]) == self.bytes_of(part)


class _EndedParts(PartEncoder):
    """Where the marked tokens end a part."""

    def _starts(self, ids: np.ndarray) -> np.ndarray:
        return np.r_[0, np.flatnonzero(self.starts[ids])[:-1] + 1]


def _marks(size: int, tokens: Iterable[tuple[str, int]], marked: Callable[[str], bool]) -> np.ndarray:
    out = np.zeros(size, bool)
    out[[number for token, number in tokens if marked(token)]] = True
    return out


def _tokenizer(path: str, plain_specials: bool):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = plain_specials
    return found


# Encoders stay with the Python worker, which serves one task at a time.


@cache
def word_bpe(path: str) -> PartEncoder:
    """A tokenizer that drops white space: parts are what stands between spaces,
    line ends and, behind a letter or digit, stops and commas."""
    found = _tokenizer(path, False)

    def split(text: str) -> list[str]:
        if not _WIDE.search(text) and "<|" not in text:
            text = text.lower()  # as the tokenizer does; a special token is none before
        if not _LOOSE.search(text):
            text = text.replace(".", " .").replace(",", " ,")
        return text.replace("\n", " ").split(" ")

    # a token that ends a word stands before the start of the next
    vocabulary = found.get_vocab()
    ends = _marks(max(vocabulary.values()) + 1, vocabulary.items(), lambda token: token.endswith("</w>"))
    return _EndedParts(lambda parts: [x.ids for x in found.encode_batch_fast(parts, add_special_tokens=False)], split, ends)


@cache
def byte_bpe(path: str) -> PartEncoder:
    """Space + text by a byte-level tokenizer; a part is kept without its
    leading space, or behind RAW if it has none: a stop or comma behind a letter or digit."""
    found = _tokenizer(path, True)

    def whole(part: str) -> str:
        return part[1:] if part[:1] == RAW else part if part[:1] == " " else " " + part

    cut = re.compile("(?= [!-~¡-ᙿ])")

    def split(text: str) -> list[str]:
        if not _ODD.search(" " + text) and RAW not in text:
            if not _LOOSE.search(text):
                text = text.replace(".", " \0.").replace(",", " \0,")
            return text.split(" ")
        # only the first part may start with an odd space, which it keeps
        return [_head(x) for x in cut.split(" " + text) if x]

    def _head(part: str) -> str:
        return part[1:] if _EVEN.match(part) else part

    vocabulary = found.get_vocab()
    starts = _marks(max(vocabulary.values()) + 1, vocabulary.items(), lambda token: token.startswith("Ġ"))
    return PartEncoder(lambda parts: [x.ids for x in found.encode_batch_fast([whole(x) for x in parts], add_special_tokens=False)], split, starts, byte_bpe_bytes(path), lambda part: whole(part).encode())


@cache
def piece_bpe(path: str) -> PartEncoder:
    """Text by a tokenizer of pieces that puts a space before it."""
    import sentencepiece

    found = sentencepiece.SentencePieceProcessor(model_file=path)
    cut = re.compile("(?<=[^ ])(?= +[^ ])")

    def split(text: str) -> list[str]:
        if "▁" in text:  # merges with the spaces beside it
            return [text]
        return [x[1:] for x in cut.split(" " + text)] if _ODD.search(" " + text) else text.split(" ")

    size = found.get_piece_size()
    starts = _marks(size, ((found.id_to_piece(i), i) for i in range(size)), lambda piece: piece.startswith("▁"))
    return PartEncoder(lambda parts: found.encode(parts, num_threads=1), split, starts, piece_bpe_bytes(path), lambda part: b" " + part.encode())


def byte_bpe_bytes(path: str) -> list[bytes]:
    """The bytes of each token: its characters stand for bytes, the visible
    ones of Latin-1 for themselves and the others in order from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    vocabulary = _tokenizer(path, True).get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocabulary.values()) + 1)
    for token, number in vocabulary.items():
        out[number] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
    return out


def piece_bpe_bytes(path: str) -> list[bytes]:
    """The bytes of each piece: U+2581 is a space, ``<0xHH>`` one byte."""
    import sentencepiece

    found = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = ((found.id_to_piece(i), found.is_byte(i)) for i in range(found.get_piece_size()))
    return [bytes([int(piece[3:5], 16)]) if byte else piece.replace("▁", " ").encode() for piece, byte in pieces]
