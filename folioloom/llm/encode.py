"""Fast exact encoding with the files of public tokenizers.

The tokenizers library spends most of its time on rules around the BPE model.
Both kinds of file used here look only at neighbouring characters, so a text
may be cut at *safe boundaries* and every piece encoded on its own, once per
worker: repeated pieces come from a bounded memo.  In a plain text (printable
ASCII, Latin-1 letters, line ends) pieces go straight to the library's BPE
model; pieces of any other text go through the whole library pipeline.

Safe boundaries
* word files (white space dropped): every space or 0x09-0x0D;
* byte-level files: a single space, or a single line end in plain texts,
  between two characters of ``!-~`` or Latin-1 letters.  A space belongs to
  the piece that it opens.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from folioloom.llm.text import Memo

_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
#: What keeps a text from being plain: any character but these, or a special string's opening.
_NOT_PLAIN = re.compile(rf"[^ -~\n{_LETTER}]|<\|")
#: White space that is not one space or one line end between two other characters.
_WIDE = re.compile(r"[ \n][ \n]|\A[ \n]|[ \n]\Z")
#: The split rules of the two kinds of file, for plain texts.  Fixed values.
_WORD_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^\s{_LETTER}0-9]+")
_BYTE_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^\s{_LETTER}0-9]+|\s+")
_SPACES = re.compile(r"[ \t-\r]+")
_BYTE_BOUNDARY = re.compile(rf"(?<=[!-~{_LETTER}]) (?=[!-~{_LETTER}])")


class Encoder:
    """Encodes whole texts; equal to the library's ``encode(text, add_special_tokens=False).ids``."""

    def __init__(self, path: str, memo: int = 200_000):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.words = self.tok.normalizer is not None  # word file: lower case, white space dropped
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        # how the library writes each byte, asked of the library itself
        self.table: dict[int, str] = {}
        for c in map(chr, range(256)):
            self.table.update(zip(c.encode(), level.pre_tokenize_str(c)[0][0], strict=True))
        self.code = "H" if self.tok.get_vocab_size() <= 1 << 16 else "I"
        self.dtype = np.dtype("<u2" if self.code == "H" else "<u4")
        self.plain = Memo(self._plain, memo)  # words of plain texts, as they stand
        self.spaced = Memo(lambda w: self._plain(" " + w, self.spaced), memo)  # byte-level: words after a space
        size = self.dtype.itemsize
        self.plain_size = Memo(lambda w: len(self._plain(w)) // size, memo // 2)  # the same, lengths only
        self.spaced_size = Memo(lambda w: len(self._plain(" " + w, self.spaced)) // size, memo // 2)
        self.other = Memo(lambda x: self._pack(self.tok.encode(x, add_special_tokens=False).ids), memo // 10)

    def _pack(self, ids: list[int]) -> bytes:
        packed = array(self.code, ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def _run(self, run: str) -> bytes:
        if not run.isascii() or run[0] in " \n":
            run = run.encode().decode("latin-1").translate(self.table)
        return self._pack([t.id for t in self.model.tokenize(run)])

    def _plain(self, word: str, stems: Memo | None = None) -> bytes:
        """A word of a plain text; ``stems`` are the words with what precedes them here."""
        bare = word.lstrip(" ")
        if bare.isalpha():
            return self._run(word)
        if bare[-1] in ".," and bare[:-1].isalpha():  # the letters end where the mark begins
            return (self.plain if stems is None else stems)[bare[:-1]] + self.plain[bare[-1]]
        return b"".join(map(self._run, (_WORD_SPLIT if self.words else _BYTE_SPLIT).findall(word)))

    def pieces(self, text: str) -> Iterator[bytes]:
        """The ids of each piece, in order."""
        if self._is_plain(text):
            return map(self.plain.__getitem__, text.lower().split()) if self.words else self._lines(text, self.plain, self.spaced)
        if self.words:
            return map(self.other.__getitem__, filter(None, _SPACES.split(text)))
        first, *rest = _BYTE_BOUNDARY.split(text)
        return map(self.other.__getitem__, [first, *[" " + x for x in rest]])

    def _is_plain(self, text: str) -> bool:
        return not _NOT_PLAIN.search(text) and (self.words or not _WIDE.search(text))

    @staticmethod
    def _lines(text: str, plain: Memo, spaced: Memo) -> Iterator:
        """What the memos know of each piece of a plain text."""
        for k, line in enumerate(text.split("\n")):
            if k:
                yield plain["\n"]
            first, *rest = line.split(" ")
            yield plain[first]
            yield from map(spaced.__getitem__, rest)

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned integers of ``dtype``."""
        return b"".join(self.pieces(text)) if text else b""

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self._is_plain(text):
            return sum(map(len, self.pieces(text))) // self.dtype.itemsize
        return sum(map(self.plain_size.__getitem__, text.lower().split()) if self.words else self._lines(text, self.plain_size, self.spaced_size))

    def trim(self) -> None:
        for memo in (self.plain, self.spaced, self.plain_size, self.spaced_size, self.other):
            memo.trim()


@lru_cache(maxsize=4)
def encoder(name_or_path: str) -> Encoder:
    """One encoder per worker process.  A bare file name is looked up among the public tokenizers."""
    if "/" not in name_or_path:
        import public_tokenizers

        name_or_path = public_tokenizers.path(name_or_path)
    return Encoder(name_or_path)
