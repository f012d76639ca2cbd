"""Toxicity scores from a learned lexicon, matched with spelling errors, in context.

The lexicon (words, and stems that stand for all words they begin) is learned from labelled documents. A Levenshtein automaton
runs over the lexicon's trie: its states are sets of (trie node, errors left), made into a deterministic automaton as words need
them, so a word is read once whatever the lexicon's size. Each hit is weighed in a window of words around it: hits in quotation
marks or near reporting words count apart from abuse. A logistic model over the counts gives the score.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docevidence.llm.common import Scratch, fields, map_batches, worker_state

TRAIN_TOXIC, TRAIN_CLEAN = 4_000, 16_000  # the labelled rows that are learned from, at most
STEMS = (4, 5, 6)
LEAST_CONTEXTS, LEAST_LOG_ODDS, LEAST_G = 5, 2.0, 30.0
FUZZY_LETTERS = 5
CONTEXT = 6
MEMO_WORDS, MEMO_NODES = 60_000, 200_000  # the words and the trie nodes in state sets that the automaton keeps
EXACT, STEM, FUZZY = 3, 2, 1
WORDS = re.compile(r"[^\W\d_]+")
# Marks and words that report speech.
QUOTES = '"“”„«»‘’'
REPORTING = frozenset("said says wrote called quote quoted quotes reported sagte schrieb zitat nannte dit écrit cité dijo escribió llamó cita".split())


class Lexicon:
    """Terms in a trie, and the automaton that reads words with at most one error (insertion, deletion, substitution)."""

    def __init__(self, terms: dict[str, float], spared: frozenset[str] = frozenset()):
        self.spared = spared
        self.children: list[dict[str, int]] = [{}]
        self.word: dict[int, float] = {}
        self.stem: dict[int, float] = {}
        self.long: set[int] = set()
        for term, weight in terms.items():
            node = 0
            for c in term.removesuffix("*"):
                node = self.children[node].setdefault(c, len(self.children))
                if node == len(self.children):
                    self.children.append({})
            if term.endswith("*"):
                self.stem[node] = weight
            else:
                self.word[node] = weight
                if len(term) >= FUZZY_LETTERS:
                    self.long.add(node)
        self._reset()

    def _reset(self) -> None:
        self.sets: list[frozenset[int]] = []
        self.nodes = 0
        self.number: dict[frozenset[int], int] = {}
        self.steps: list[dict[str, int]] = []
        self.accepts: list[tuple[int, float]] = []
        self.begins: list[tuple[int, float]] = []
        self.known: dict[str, tuple[int, float]] = {}
        self.start = self._state({1})

    def _state(self, places: set[int]) -> int:
        """The number of a state set, -1 if it is empty. A place is twice the trie node, plus 1 while no error is made; a missing
        letter moves on without reading."""
        places |= {2 * c for x in places if x & 1 for c in self.children[x >> 1].values()}
        key = frozenset(places)
        if not key:
            return -1
        if key not in self.number:
            self.number[key] = len(self.sets)
            self.sets.append(key)
            self.nodes += len(key)
            self.steps.append({})
            exact = [self.word[x >> 1] for x in key if x & 1 and x >> 1 in self.word]
            near = [self.word[x >> 1] for x in key if not x & 1 and x >> 1 in self.long]
            self.accepts.append((EXACT, max(exact)) if exact else (FUZZY, max(near)) if near else (0, 0.0))
            stems = [self.stem[x >> 1] for x in key if x & 1 and x >> 1 in self.stem]
            self.begins.append((STEM, max(stems)) if stems else (0, 0.0))
        return self.number[key]

    def _step(self, state: int, c: str) -> int:
        out = set()
        for x in self.sets[state]:
            after = self.children[x >> 1]
            if c in after:
                out.add(2 * after[c] + (x & 1))
            if x & 1:
                out.add(x - 1)
                out.update(2 * y for y in after.values())
        got = self.steps[state][c] = self._state(out)
        return got

    def find(self, word: str) -> tuple[int, float]:
        """(kind, weight) of the best match of a lower-case word; (0, 0.0) if none."""
        got = self.known.get(word)
        if got is not None:
            return got
        if len(self.known) >= MEMO_WORDS or self.nodes >= MEMO_NODES:
            self._reset()
        state, best = self.start, (0, 0.0)
        for c in word:
            nxt = self.steps[state].get(c)
            state = self._step(state, c) if nxt is None else nxt
            if state < 0:
                break
            best = max(best, self.begins[state])
        if state >= 0:
            end = self.accepts[state]
            if end[0] != FUZZY or word not in self.spared:
                best = max(best, end)
        self.known[word] = best
        return best


@dataclass
class Model:
    terms: dict[str, float] = field(default_factory=dict)
    spared: frozenset[str] = frozenset()
    weights: list[float] = field(default_factory=lambda: [0.0] * 6)


def _lexicon(terms: tuple, spared: frozenset) -> Lexicon:
    return worker_state(("lexicon", terms, spared), lambda: Lexicon(dict(terms), spared))


def hits(lexicon: Lexicon, text: str) -> list[tuple[int, float, str, bool]]:
    """(kind, weight, word, quoted) of each hit."""
    low = text.lower()
    words = WORDS.findall(low)
    find, known = lexicon.find, lexicon.known
    if not any((known.get(w) or find(w))[0] for w in words):
        return []
    out = []
    spans = [(m.start(), m.end()) for m in WORDS.finditer(low)]
    for i, w in enumerate(words):
        kind, weight = find(w)
        if kind:
            near = words[max(0, i - CONTEXT) : i] + words[i + 1 : i + 1 + CONTEXT]
            before = low[spans[max(0, i - CONTEXT)][0] : spans[i][0]]
            after = low[spans[i][1] : spans[min(len(words) - 1, i + CONTEXT)][1] + 1]
            inside = sum(before.count(q) for q in QUOTES) % 2 == 1 and any(q in after for q in QUOTES)
            out.append((kind, weight, w, inside or any(x in REPORTING for x in near)))
    return out


def features(lexicon: Lexicon, text: str) -> list[float]:
    found = hits(lexicon, text)
    sure = [h for h in found if h[0] > FUZZY and not h[3]]
    fuzzy = sum(1 for h in found if h[0] == FUZZY and not h[3])
    quoted = sum(1 for h in found if h[3])
    return [1.0, float(bool(sure)), float(np.log1p(len(sure))), float(np.log1p(fuzzy)), float(np.log1p(quoted)), max((h[1] for h in sure), default=0.0) / 10]


def held_out(id_col: Column) -> Column:
    """The documents that are never learned from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _terms_of(sample: DataFrame) -> DataFrame:
    """(toxic, term, around) of each word of three letters or more: itself and its stems, and a hash of the words beside it."""
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{M}]+"), lambda w: w != "")
    rows = sample.select("toxic", words.alias("w"))
    before, after = F.concat(F.array(F.lit("")), F.col("w")), F.slice(F.concat(F.col("w"), F.array(F.lit(""))), 2, 1 << 30)
    rows = rows.select("toxic", F.explode(F.arrays_zip(F.col("w").alias("w"), before.alias("b"), after.alias("a"))).alias("z")).filter(F.length("z.w") >= 3)
    w = F.col("z.w")
    kinds = [F.when(F.length(w) > k, F.concat(F.left(w, F.lit(k)), F.lit("*"))) for k in STEMS]
    rows = rows.select("toxic", F.xxhash64("z.b", "z.a", F.length(w)).alias("around"), F.explode(F.array(w, *kinds)).alias("term"))
    return rows.filter("term is not null")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learns lexicon and weights from at most TRAIN_TOXIC + TRAIN_CLEAN labelled documents, chosen by hash of their id.

    Rows without id or label, and those held out, are not used; of several labels of an id the largest counts. A term's support is
    the number of different contexts (words around it), so copies of a document count once. Without labels the score is 0.5.
    """
    spark = docs.sparkSession
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.filter("toxic in (0, 1)").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("toxic") == 1, F.lit(min(1.0, TRAIN_TOXIC / max(1, counts.get(1, 0))))).otherwise(F.lit(min(1.0, TRAIN_CLEAN / max(1, counts.get(0, 0)))))
    chosen = known.filter("toxic in (0, 1)").filter(F.pmod(F.xxhash64("__id", F.lit(11)), F.lit(1 << 20)) < share * (1 << 20))
    # The sample is bounded, so sending it to all tasks is too.
    sample = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "__id").select("toxic", "text")
    sample = Scratch(spark, "toxicity").save(sample, "sample")

    terms = _terms_of(sample)
    seen = terms.groupBy("term", "around").agg(F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("p"), F.max(F.when(F.col("toxic") == 0, 1).otherwise(0)).alias("n"))
    seen = seen.groupBy("term").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    total = {"p": counts.get(1, 0) * min(1.0, TRAIN_TOXIC / max(1, counts.get(1, 0))), "n": counts.get(0, 0) * min(1.0, TRAIN_CLEAN / max(1, counts.get(0, 0)))}
    rate = (total["p"] + 1) / (total["p"] + total["n"] + 2)
    p, n = F.col("p"), F.col("n")
    both = p + n
    g = 2 * (p * F.log(p / (both * rate)) + F.when(n > 0, n * F.log(n / (both * (1 - rate)))).otherwise(0.0))
    odds = F.log((p + 0.5) / (total["p"] + 1)) - F.log((n + 0.5) / (total["n"] + 1))
    strong = seen.filter((p >= LEAST_CONTEXTS)).withColumn("odds", odds).withColumn("g", g).filter((F.col("odds") >= LEAST_LOG_ODDS) & (F.col("g") >= LEAST_G))
    rows = strong.orderBy(F.desc("g"), "term").collect()  # words of a bounded sample with enough contexts
    found = {r["term"]: float(r["odds"]) for r in rows}
    # A word or longer stem says nothing that a stem before it does not say as surely.
    stems = {t[:-1]: w for t, w in found.items() if t.endswith("*")}
    found = {t: w for t, w in found.items() if not any((s := t.removesuffix("*")[:k]) != t.removesuffix("*") and s in stems and stems[s] >= w - 2.0 for k in STEMS)}
    if not rows:
        positive = counts.get(1, 0)
        base = np.log((positive + 1) / (counts.get(0, 0) + 1)) if counts else 0.0
        return Model(weights=[float(base)] + [0.0] * 5)

    first = Model(found)
    near = _observe(sample, first)
    # Words that a spelling error turns into a term, yet are at home in clean documents.
    fuzzy = near.select("toxic", F.explode(F.array_distinct("fuzzy_words")).alias("w")).groupBy("w").agg(F.sum((F.col("toxic") == 1).cast("int")).alias("p"), F.sum((F.col("toxic") == 0).cast("int")).alias("n"))
    spared = frozenset(r["w"] for r in fuzzy.filter("n > p").collect())
    model = Model(found, spared)
    got = _observe(sample, model).select("toxic", "x").toPandas()
    x, y = np.array(got["x"].tolist(), dtype=float).reshape(-1, 6), got["toxic"].to_numpy(dtype=float)
    model.weights = _logistic(x, y).tolist()
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 30) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        s = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (s - y) + ridge * w
        hessian = (x * (s * (1 - s))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _observe(sample: DataFrame, model: Model) -> DataFrame:
    terms, spared = tuple(model.terms.items()), model.spared

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        lexicon = _lexicon(terms, spared)
        texts = b.column("text").to_pylist()
        words = [[h[2] for h in hits(lexicon, t) if h[0] == FUZZY] for t in texts]
        return pa.RecordBatch.from_arrays([b.column("toxic"), pa.array([features(lexicon, t) for t in texts], pa.list_(pa.float64())), pa.array(words, pa.list_(pa.string()))], ["toxic", "x", "fuzzy_words"])

    return map_batches(sample, run, f"toxic {sample.schema['toxic'].dataType.simpleString()}, x array<double>, fuzzy_words array<string>")


def score(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text", out_col: str = "score") -> DataFrame:
    """The columns ``keep`` and ``out_col``, 0 to 1, from the whole text alone. A null text scores as an empty one; repeated rows stay;
    an empty table gives no rows. ``keep`` must not hold ``out_col`` (ValueError)."""
    if out_col in keep:
        raise ValueError(f"{out_col} would be there twice")
    rows = docs.select(*(F.col(f"`{c}`") for c in keep), F.coalesce(F.col(text_col), F.lit("")).alias("text of it"))
    terms, spared, weights = tuple(model.terms.items()), model.spared, np.array(model.weights)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        lexicon = _lexicon(terms, spared)
        x = np.array([features(lexicon, t) for t in b.column(len(keep)).to_pylist()], dtype=float).reshape(-1, len(weights))
        s = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        return pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(keep))), pa.array(s)], [*keep, out_col])

    return map_batches(rows, run, f"{fields(docs, keep)}, `{out_col}` double")
