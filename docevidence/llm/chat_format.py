"""Conversations as one training text each, with loss masks aligned by offsets.

Each turn is ``<|im_start|>role\\n text <|im_end|>\\n``. Inside roles and texts a backslash is doubled and ``<|`` becomes
``<\\|``, so no control string can appear there, and removing the escapes gives the text back. A whole conversation is
encoded once; a token is under the loss mask where its span meets the span of a trained turn, found by binary search in
the sorted token starts and ends.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docevidence.llm.common import worker_state

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

START, END = "<|im_start|>", "<|im_end|>"
_ESCAPED = re.compile(r"\\(.)", re.S)

OUTPUT = "formatted string, token_ids array<int>, loss_tokens array<int>, loss_from array<int>, loss_to array<int>"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def render(turns: list[tuple[str, str]], trained: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The conversation's text and the sorted spans of the trained turns' texts."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        at += len(head)
        if role == trained:
            spans.append((at, at + len(body)))
        at += len(body) + len(END) + 1
        parts += [head, body, END, "\n"]
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns, read back from the text alone."""
    turns = []
    for part in formatted.split(START)[1:]:
        head, _, body = part.partition("\n")
        turns.append((unescape(head), unescape(body[: body.index(END)])))
    return turns


def mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(token, from, to): what each token holds of the trained spans. Tokens that share a character share its offsets; the
    first of them then carries it."""
    out = []
    for a, b in spans:
        first, stop = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(starts, b, "left"))
        done = a
        for t in range(first, stop):
            e = min(int(ends[t]), b)
            if e > done:
                out.append((t, done, e))
                done = e
            elif int(starts[t]) >= a and int(ends[t]) <= b:
                out.append((t, done, done))  # a later part of a character that is already there
    return out


def _library(path: str):
    from tokenizers import Tokenizer

    return worker_state(("chat", path), lambda: Tokenizer.from_file(path))


def format_conversations(turns: DataFrame, tokenizer_path: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained: str = "assistant") -> DataFrame:
    """One row per conversation: its id, the formatted text, token ids and the loss mask (token number, from, to in characters).

    Turns come in the order of ``turn_col``; equal turn numbers in the order of role, then text; repeated rows stay. Null
    roles and texts count as empty; rows of a null conversation id form one conversation. A conversation is one output row, so
    its turns do meet in a task; they are sorted on the way there, and rows of different conversations share no state.
    """
    rows = turns.select(F.col(conv_col).alias("c"), F.struct(F.col(turn_col).alias("t"), F.coalesce(F.col(role_col), F.lit("")).alias("r"), F.coalesce(F.col(text_col), F.lit("")).alias("x")).alias("s"))
    convs = rows.groupBy("c").agg(F.array_sort(F.collect_list("s")).alias("s")).select("c", F.transform("s", lambda s: s["r"]).alias("roles"), F.transform("s", lambda s: s["x"]).alias("texts"))
    kind = turns.schema[conv_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            done, size = [], 0
            roles, texts = b.column("roles"), b.column("texts")
            for i in range(b.num_rows):
                done.append(render(list(zip(roles[i].as_py(), texts[i].as_py(), strict=True)), trained))
                size += len(done[-1][0])
                if size > 1_000_000 or i == b.num_rows - 1:  # offsets of many texts at once would need much memory
                    yield emit(b.column("c").slice(i + 1 - len(done), len(done)), done)
                    done, size = [], 0

    def emit(ids, done):
        library = _library(tokenizer_path)
        rows = []
        for (text, spans), e in zip(done, library.encode_batch([t for t, _ in done], add_special_tokens=False), strict=True):
            offsets = np.array(e.offsets, dtype=np.int64).reshape(-1, 2)
            rows.append((text, e.ids, *zip(*mask(offsets[:, 0], offsets[:, 1], spans), strict=True)) if spans else (text, e.ids))
        col = lambda j: [list(r[j]) if len(r) > j else [] for r in rows]
        lists = pa.list_(pa.int32())
        return pa.RecordBatch.from_arrays([ids, pa.array([r[0] for r in rows], pa.string()), *(pa.array(col(j), lists) for j in (1, 2, 3, 4))], [conv_col, "formatted", "token_ids", "loss_tokens", "loss_from", "loss_to"])

    return convs.mapInArrow(run, f"`{conv_col}` {kind}, {OUTPUT}")


def read_back(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Per conversation, from the output alone: all turns, and the unescaped text under the loss mask, span by span. ``formatted`` is what
    format_conversations gave: a null id is a conversation like any other, and no other column has nulls; no rows give none."""
    kind = formatted.schema[conv_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            turns, loss = [], []
            for text, starts, ends in zip(*(b.column(c).to_pylist() for c in ("formatted", "loss_from", "loss_to")), strict=True):
                turns.append(parse(text))
                pieces, last = [], None
                for a, e in zip(starts, ends, strict=True):
                    if a != last:
                        pieces.append([])
                    pieces[-1].append(text[a:e])
                    last = e
                loss.append("".join(unescape("".join(p)) for p in pieces))
            yield pa.RecordBatch.from_arrays(
                [b.column(conv_col), pa.array([len(t) for t in turns], pa.int64()), pa.array(["".join(f"{r}\n{x}\n" for r, x in t) for t in turns], pa.string()), pa.array(loss, pa.string()), pa.array([len(t) for t in b.column("formatted").to_pylist()], pa.int64())],
                [conv_col, "n_turns", "turns_text", "loss_text", "formatted_chars"],
            )

    return formatted.mapInArrow(run, f"`{conv_col}` {kind}, n_turns bigint, turns_text string, loss_text string, formatted_chars bigint")
