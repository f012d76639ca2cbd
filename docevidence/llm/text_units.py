"""Encodes text by units that a byte-level tokenizer never merges across, with a bounded memo of units.

The split pattern of byte-level tokenizers attaches one space to the word behind it, and never continues a match from
a non-space into a space. So a text may be cut before each space that a non-space follows, and around each line feed
between non-spaces; the ids of the pieces, in order, are the ids of the text. Any other white space stays inside its unit.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

_MARKS = (",", ".", "!", "?")
_CUT = re.compile(r"(?= \S)")


class _Memo(dict):
    """unit -> encoded bytes, for ``limit`` units at most, in two generations: a full one becomes the old one, whose units come back as
    they are met again, so the frequent ones stay."""

    def __init__(self, prefix: str, encode: Callable[[str], bytes], limit: int):
        self.prefix, self.encode, self.half = prefix, encode, max(1, limit // 2)
        self.mark = functools.lru_cache(maxsize=len(_MARKS))(encode)
        self.old: dict[str, bytes] = {}

    def __missing__(self, unit: str) -> bytes:
        out = self.old.get(unit) if self.old else None
        if out is None:
            if not unit.isalpha() and unit[-1:] in _MARKS and unit[-2:-1].isalpha():  # a mark behind a letter is a match of its own
                out = self[unit[:-1]] + self.mark(unit[-1])
            else:
                out = self.encode(self.prefix + unit)
        if len(unit) <= 64:
            if len(self) >= self.half:
                self.old = dict(self)
                self.clear()
            self[unit] = out
        return out


class UnitEncoder:
    """``encode`` gives the packed ids of one unit; calling the object gives those of a whole text."""

    def __init__(self, encode: Callable[[str], bytes], limit: int = 400_000):
        self._first = _Memo("", encode, limit // 4)
        self._later = _Memo(" ", encode, limit)
        self._feed = encode("\n")

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        out: list[bytes] = []
        words, gaps = text.split(), text.count(" ") + text.count("\n")
        # All white space is single spaces and line feeds: as many gaps as words between, and no other character missing.
        if len(words) == gaps + 1 and len("".join(words)) + gaps == len(text):
            later, first, at = self._later.__getitem__, self._first, 0
            for line in text.split("\n"):
                if at:
                    out.append(self._feed)
                end = at + line.count(" ") + 1
                out.append(first[words[at]])
                out.extend(map(later, words[at + 1 : end]))
                at = end
        else:
            for unit in _CUT.split(text):
                out.append(self._later[unit[1:]] if unit[:1] == " " else self._first[unit])
        return b"".join(out)
