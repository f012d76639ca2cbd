"""The tokenizers library on word units, for tokenizers with a byte-level split and no normaliser."""

from __future__ import annotations

import hashlib
import os
import struct

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

from docevidence.llm.common import worker_state  # noqa: E402
from docevidence.llm.text_units import UnitEncoder  # noqa: E402


class LibraryEncoder:
    """Packed ids of whole texts as the library gives them without added special tokens.

    Texts go through the library unit by unit (see text_units); a text that holds one of the tokenizer's special
    strings goes through it whole, so that the library's own handling of those strings applies.
    """

    def __init__(self, path: str, units: int):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        alphabet = self.library.pre_tokenizer.pre_tokenize_str  # how the split writes each byte
        self.bytes_as = {b: alphabet(chr(b))[0][0] for b in range(33, 127)} | {32: alphabet(" ")[0][0]}
        for c in map(chr, range(0xA1, 0x250)):
            for b, as_char in zip(c.encode(), alphabet(c)[0][0], strict=True):
                self.bytes_as[b] = as_char
        self.space = self.bytes_as[32]
        self.tokenize = self.library.model.tokenize
        self.packed = [struct.pack("<I", k) for k in range(1 + max(self.library.get_vocab().values()))]
        self.units = UnitEncoder(self.pack, units)

    def pack(self, text: str) -> bytes:
        """One unit. Letters alone are one piece of the split, so they may go straight to the model."""
        word = text[1:] if text[:1] == " " else text
        if word.isalpha():
            if word.isascii():  # the split writes these bytes as they are
                ids = self.tokenize(word if word is text else self.space + word)
                return self.packed[ids[0].id] if len(ids) == 1 else b"".join([self.packed[t.id] for t in ids])
            if max(word) < "\u0250":
                return self.model(text.encode().decode("latin-1").translate(self.bytes_as))
        return b"".join([self.model(p) for p, _ in self.library.pre_tokenizer.pre_tokenize_str(text)])

    def model(self, piece: str) -> bytes:
        return b"".join([self.packed[t.id] for t in self.tokenize(piece)])

    def whole(self, text: str) -> bytes:
        ids = self.library.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self.whole(text)
        return self.units(text)


def library_encoder(path: str, units: int = 1_000_000) -> LibraryEncoder:
    return worker_state(("library", path, units), lambda: LibraryEncoder(path, units))


def tokenizer_digest(path: str) -> str:
    """Names a tokenizer version by its file's content."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()
