"""Byte-level BPE encoding and decoding by longest matches with backtracking.

Bytes are mapped to Latin-1 characters, so that one Aho-Corasick automaton over the vocabulary gives the longest token
from each position in one pass. A token sequence is the result of the merges exactly if each adjacent pair is the
encoding of its own bytes; so the encoder extends with the longest match that is compatible with the token before,
falls back to shorter prefixes, and steps back when none fits. Positions that failed once are never tried again,
hence linear time. Compatibility of pairs is memoised.
"""

from __future__ import annotations

import base64
import struct

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docevidence.llm.common import fields, map_batches, worker_state
from docevidence.llm.text_units import UnitEncoder

PAIR_MEMO, SPINE_MEMO, UNIT_MEMO = 200_000, 60_000, 800_000


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 token and its rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_ranks(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The definition: merge the adjacent parts of lowest rank until none is in the vocabulary."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if rank == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class BacktrackEncoder:
    """Encodes one match of the split pattern at a time."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.tokens = {i: t for t, i in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        # Some vocabularies hold tokens that their own merges never reach; those only stand as a whole piece.
        self.reached = {t: i for t, i in ranks.items() if len(t) == 1 or merge_ranks(t, ranks) == [i]}
        self.size = {i: len(t) for t, i in ranks.items()}
        for token, i in self.reached.items():
            self.automaton.add_word(token.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.shorter: dict[int, int] = {}
        self.ends: dict[int, tuple[list[bytes], list[bytes]]] = {}

    def _spines(self, a: int) -> tuple[list[bytes], list[bytes]]:
        """The parts of token ``a`` that in turn stand at its right and at its left end while it is merged, smallest first."""
        got = self.ends.get(a)
        if got is None:
            parts = [self.tokens[a][i : i + 1] for i in range(len(self.tokens[a]))]
            right, left = [parts[-1]], [parts[0]]
            while len(parts) > 1:
                _, at = min((self.ranks.get(x + y, 1 << 60), i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)))
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                if at == 0:
                    left.append(parts[0])
                if at == len(parts) - 1:
                    right.append(parts[-1])
            if len(self.ends) >= SPINE_MEMO:
                self.ends.clear()
            got = self.ends[a] = (right, left)
        return got

    def _compatible(self, a: int, b: int) -> bool:
        """Whether no merge crosses the border of ``a`` and ``b`` before both are complete."""
        got = self.pairs.get((a, b))
        if got is not None:
            return got
        if len(self.pairs) >= PAIR_MEMO:
            self.pairs.clear()
        xs, ys, ranks, top = self._spines(a)[0], self._spines(b)[1], self.ranks, 1 << 60
        i = j = 0
        got = True
        while True:
            across = ranks.get(xs[i] + ys[j], top)
            x_next = ranks[xs[i + 1]] if i + 1 < len(xs) else top
            y_next = ranks[ys[j + 1]] if j + 1 < len(ys) else top
            if across < x_next and across <= y_next and across < top:  # of equal ranks the leftmost merges first
                got = False
                break
            if x_next == y_next == top:
                break
            if x_next <= y_next:
                i += 1
            else:
                j += 1
        self.pairs[a, b] = got
        return got

    def _prefix(self, a: int) -> int:
        """The longest token that is a proper prefix of token ``a``, or -1."""
        got = self.shorter.get(a)
        if got is None:
            t = self.tokens[a]
            got = self.shorter[a] = next((self.reached[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.reached), -1)
        return got

    def encode_piece(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        n, size, pairs = len(piece), self.size, self.pairs
        longest = [-1] * n
        for end, i in self.automaton.iter(piece.decode("latin-1")):
            longest[end - size[i] + 1] = i  # a later end is a longer match
        out: list[int] = []
        at, dead, token, last = 0, set(), longest[0], -1
        while at < n:
            while token >= 0:
                if at + size[token] not in dead:
                    if last < 0:
                        break
                    fits = pairs.get((last, token))
                    if fits or fits is None and self._compatible(last, token):
                        break
                token = self._prefix(token)
            if token >= 0:
                out.append(token)
                at += size[token]
                last, token = token, longest[at] if at < n else -1
            else:
                dead.add(at)
                if not out:
                    return merge_ranks(piece, self.ranks)  # no vocabulary with all single bytes gets here
                token = out.pop()
                at -= size[token]
                last, token = out[-1] if out else -1, self._prefix(token)
        return out

    def encode(self, text: str) -> list[int]:
        return [i for m in self.pattern.findall(text) for i in self.encode_piece(m.encode())]

    def pack(self, text: str) -> bytes:
        ids = self.encode(text)
        return struct.pack(f"<{len(ids)}I", *ids)


class Decoder:
    """All token bytes end to end, each token's start and length."""

    def __init__(self, ranks: dict[bytes, int]):
        tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for t, i in ranks.items():
            tokens[i] = t
        self.length = np.array([len(t) for t in tokens], dtype=np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def __call__(self, packed: bytes) -> bytes:
        ids = np.frombuffer(packed, dtype="<u4").astype(np.int64)
        n = self.length[ids]
        ends = np.cumsum(n)
        where = np.repeat(self.start[ids] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)
        return self.flat[where].tobytes()


def _coder(path: str, pattern: str, units: int) -> tuple[UnitEncoder, Decoder]:
    def build():
        ranks = read_ranks(path)
        return UnitEncoder(BacktrackEncoder(ranks, pattern).pack, units), Decoder(ranks)

    return worker_state(("bpe", path, pattern, units), build)


def encode_column(df: DataFrame, text_col: str, ranks_path: str, pattern: str, keep: list[str], out_col: str = "ids", decoded_col: str | None = None, unit_memo: int = UNIT_MEMO) -> DataFrame:
    """The columns ``keep`` and ``out_col``: the token ids of the whole text as little-endian unsigned 32-bit integers. With
    ``decoded_col`` the ids are decoded again at once, for control.

    ``keep`` must not hold the new columns' names (ValueError). A null or empty text gives empty bytes; rows are kept one by one,
    repeated rows included; an empty table gives none. No shuffle; memory is one Arrow batch and the bounded memos.
    """
    new = [out_col, *([decoded_col] if decoded_col else [])]
    if set(new) & set(keep):
        raise ValueError(f"{new} would be there twice")
    rows = df.select(*(F.col(f"`{c}`") for c in keep), F.coalesce(F.col(text_col), F.lit("")).alias("text of it"))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        encode, decode = _coder(ranks_path, pattern, unit_memo)
        ids = [encode(t) for t in b.column(len(keep)).to_pylist()]
        out = [pa.array(ids, pa.binary()), *([pa.array(map(decode, ids), pa.binary())] if decoded_col else [])]
        return pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(keep))), *out], [*keep, *new])

    return map_batches(rows, run, ", ".join([*([fields(df, keep)] if keep else []), *(f"`{c}` binary" for c in new)]))


def decode_column(df: DataFrame, ids_col: str, ranks_path: str, out_col: str = "decoded") -> DataFrame:
    """All columns of ``df`` and ``out_col`` (in place of one of that name): the bytes of the tokens. Null ids give null, empty ids
    empty bytes."""

    @F.pandas_udf("binary")
    def decode(ids: pd.Series) -> pd.Series:
        one = worker_state(("decoder", ranks_path), lambda: Decoder(read_ranks(ranks_path)))
        return pd.Series([None if p is None else one(p) for p in ids], dtype=object)

    return df.withColumn(out_col, decode(F.col(ids_col)))
