"""Byte-level BPE encoding in tasks, with the tokenizers library.

The pre-tokenizer's pieces never cross from a non-space to a following space,
so a text is cut there first and every distinct word is encoded once per worker
and kept (bounded) as little-endian 32-bit ids.  Texts that hold an added token
of the tokenizer are cut at it first, as the library does.
"""

from __future__ import annotations

import re
from array import array

MAX_KEPT = 600_000  # words kept per worker; beyond it the cache starts anew
MAX_CUT = 64  # longer words are encoded each time

# White space of Python or of the tokenizer's pattern other than a space and a line feed.
_OTHER_SPACE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_RUNS = ("  ", " \n", "\n ", "\n\n")
_TAIL = ".,;:!?\"')"
_CUTS = re.compile(r"[ \n]*[^ \n]+|[ \n]+")


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, others for letters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder(dict):
    """``encode(text)`` gives the ids as bytes; the mapping itself is the cache: from a word to the ids of a space and the word."""

    def __init__(self, path: str):
        super().__init__()
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # The tokenizer's own pattern; letters first is the same and faster, as no letter piece starts with an apostrophe.
        self.pieces = regex.compile(r" ?\p{L}+|" + public_tokenizers.PATTERN).findall
        self.letters = _byte_letters()
        self.space = self.letters[32]
        self.kept: dict[str, bytes] = {}  # pieces without a space before them
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = {t.content: i for i, t in added.items()}
        # Tokens that take their surroundings into account are left to the library.
        self.plain = not any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values())
        self.at_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None

    def _ids(self, letters: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def piece(self, piece: str) -> bytes:
        if len(piece) > 1 and piece[0] == " ":
            return self[piece[1:]]
        out = self.kept.get(piece)
        if out is None:
            out = self._ids(piece.encode().decode("latin-1").translate(self.letters))
            if len(piece) <= MAX_CUT:
                if len(self.kept) >= MAX_KEPT:
                    self.kept.clear()
                self.kept[piece] = out
        return out

    def __missing__(self, word: str) -> bytes:
        if word.isalpha():  # a space and letters is one piece
            out = self._ids(self.space + (word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)))
        elif (letters := word.rstrip(_TAIL)).isalpha():  # and what follows them another
            out = self[letters] + self.piece(word[len(letters):])
        elif len(pieces := self.pieces(" " + word)) == 1:
            out = self._ids(pieces[0].encode().decode("latin-1").translate(self.letters))
        else:
            out = b"".join(map(self.piece, pieces))
        if len(word) <= MAX_CUT:
            if len(self) >= MAX_KEPT:
                self.clear()
            self[word] = out
        return out

    def _line(self, line: str) -> bytes:
        """Ids of a text whose only white space is single spaces between words."""
        first, _, words = line.partition(" ")
        ids = (self.piece(first) if first.isalpha() else b"".join(map(self.piece, self.pieces(first)))) if first else b""
        return ids + b"".join(map(self.__getitem__, words.split(" "))) if words else ids

    def _plain(self, text: str) -> bytes:
        if any(c in text for c in _OTHER_SPACE):  # its runs of spaces may cross the cuts
            return b"".join(map(self.piece, self.pieces(text)))
        if text[-1] in " \n" or any(x in text for x in _RUNS):
            return b"".join([self[cut[1:]] if cut[0] == " " and cut[1:2] > " " else b"".join(map(self.piece, self.pieces(cut))) for cut in _CUTS.findall(text)])
        if "\n" not in text:
            return self._line(text)
        return self.piece("\n").join(map(self._line, text.split("\n")))  # a single line end before other text is a piece

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.at_added is None or not any(t in text for t in self.added):
            return self._plain(text)
        if not self.plain:
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        parts = self.at_added.split(text)
        return b"".join([(array("I", [self.added[x]]).tobytes() if x in self.added else self._plain(x)) for x in parts if x])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file; it outlives the task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
