"""Toxicity by a weighted finite-state grammar over clauses.

Five transducers read the words of a clause in order. Insult and threat mark attacks, an
insult with a learned strength. Target holds a word of address for a few words, before an attack
or behind it; negation holds for a few words behind it and ends at a comma; reported speech holds
to the end of the sentence. Their composition is one automaton whose arcs carry weights: an attack
counts its strength, more if aimed at someone, less if denied or reported. A clause weighs the
sum of its arcs, and documents are scored by the weights of their matched clauses alone.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.hashing import word_hashes
from corpusmill.llm.labelled import held_out, labelled_sample

THREATS = frozenset("kill hurt destroy punch burn shoot töten verletzen zerstören tuer frapper détruire matar golpear destruir".split())
TARGETS = frozenset("you your yours they them he she him her these those du dich dir euch sie ihr tu te toi vous ils elles tú vosotros usted ustedes ellos ellas".split())
NEGATIONS = frozenset("not no never nobody isn't aren't don't nicht kein keine nie ne pas jamais nunca ningún".split())
REPORTS = frozenset("said says say claimed claims wrote quoted quote reported allegedly sagte sagt schrieb behauptet dit écrit affirme dijo escribió según".split())
STEM, CACHED_WORDS = 5, 200_000
EDGE = re.compile(r"^\W+|\W+$")
TOKEN = re.compile(r"\S+|\n")
SENTENCE_END, COMMA = re.compile(r"[.!?;]\W*$"), re.compile(r"[,:]\W*$")
# A word's symbol holds all its readings, and what ends behind it.
INSULT, THREAT, TARGET, NEGATION, REPORT, PAUSE, END = (1 << k for k in range(7))
# Words a target or negation holds for, and arc weights.
REACH = 3
THREAT_STRENGTH, AIMED, DENIED, REPORTED, LATE = 1.0, 1.5, 0.2, 0.4, 0.5


def keys(word: str) -> tuple[str, ...]:
    """What the insult transducer may accept for a word: itself and its stem."""
    return (word,) if len(word) <= STEM else (word, word[:STEM] + "*")


class State(NamedTuple):
    """Words that each transducer still holds; ``attack`` waits for a target behind it."""

    target: int = 0
    negation: int = 0
    report: int = 0
    attack: int = 0


START = State()


@lru_cache(None)
def step(state: State, symbol: int) -> tuple[State, float, bool]:
    """The composed automaton: next state, weight of an attack here (0 for none), and whether
    the word aims the attack before it.
    """
    target = REACH if symbol & TARGET else max(0, state.target - 1)
    negation = REACH if symbol & NEGATION else max(0, state.negation - 1)
    report = 1 if symbol & REPORT else state.report
    late = bool(symbol & TARGET and state.attack)
    weight = 0.0
    if symbol & (INSULT | THREAT):
        aimed = state.target > 0 or symbol & TARGET
        weight = (AIMED if aimed else 1.0) * (DENIED if state.negation else 1.0) * (REPORTED if state.report else 1.0)
        attack = 0 if aimed else REACH
    else:
        attack = 0 if late else max(0, state.attack - 1)
    if symbol & END:
        return START, weight, late
    if symbol & PAUSE:
        return State(0, 0, report, 0), weight, late
    return State(target, negation, report, attack), weight, late


class Lexicon:
    """Symbols of words; insult words and stems with their learned strengths."""

    def __init__(self, insults: dict[str, float]) -> None:
        self.insults, self.symbols, self.strength = insults, {}, {}

    def _learn(self, raw: str) -> None:
        if raw == "\n":
            self.symbols[raw] = END
            return
        word = EDGE.sub("", raw)
        found = [self.insults[k] for k in keys(word) if k in self.insults]
        kinds = ((INSULT, found), (THREAT, word in THREATS), (TARGET, word in TARGETS), (NEGATION, word in NEGATIONS), (REPORT, word in REPORTS),
                 (END, SENTENCE_END.search(raw)), (PAUSE, COMMA.search(raw)))
        self.symbols[raw] = sum(symbol for symbol, yes in kinds if yes)
        if found or word in THREATS:
            self.strength[raw] = max([*found, THREAT_STRENGTH * (word in THREATS)])

    def clauses(self, text: str) -> tuple[list[float], int]:
        """(weights of the clauses with an attack, number of words) of a text."""
        if len(self.symbols) > CACHED_WORDS:
            self.symbols.clear()
            self.strength.clear()
        words = TOKEN.findall(text.lower())
        known, strength = self.symbols, self.strength
        for raw in set(words).difference(known):
            self._learn(raw)
        out, done = [], 0
        for at, word in enumerate(words):
            if at < done or word not in strength:
                continue
            start = at
            while start > done and not known[words[start - 1]] & END:
                start -= 1
            total, state, last, done = 0.0, START, 0.0, start
            while done < len(words):
                raw = words[done]
                state, weight, late = step(state, known[raw])
                total += LATE * last if late else 0.0
                if weight:
                    last = weight * strength[raw]
                    total += last
                done += 1
                if known[raw] & END:
                    break
            out.append(total)
        return out, len(words)


N_FEATURES = 5


def features(text: str | None, lexicon: Lexicon) -> np.ndarray:
    """Of the weights of the matched clauses: the log of their sum, of the largest, their sum
    per word, and the log of their number as the last but the constant.
    """
    out = np.zeros(N_FEATURES)
    out[-1] = 1
    weights, n = lexicon.clauses(text or "")
    if weights:
        total = sum(weights)
        out[:-1] = math.log1p(total), math.log1p(max(weights)), min(2.0, 50 * total / n), math.log1p(len(weights))
    return out


def fit(rows: np.ndarray, labels: np.ndarray, l2: float = 0.02, steps: int = 30) -> np.ndarray:
    """Logistic weights by Newton steps; both labels weigh the same in total.

    The number of clauses has no weight of its own, and no weight of a clause's weight is
    negative, or a stronger attack could lower a score: such a feature is left out.
    """
    found = np.zeros(N_FEATURES)
    if len(set(labels.tolist())) < 2:
        return found
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    used = [*range(N_FEATURES - 2), N_FEATURES - 1]
    while True:
        x, w = rows[:, used], np.zeros(len(used))
        keep = l2 * len(rows) / 100 * np.eye(len(used))
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            gradient = x.T @ (weight * (p - labels)) + keep @ w
            w = w - np.linalg.solve((x * (weight * np.maximum(p * (1 - p), 1e-3))[:, None]).T @ x + keep, gradient)
        if len(used) == 1 or w[:-1].min() >= 0:
            found[used] = w
            return found
        used.pop(int(w[:-1].argmin()))


def group_of(text: str) -> int:
    """Smallest hash of the text's runs of five words: near copies mostly agree in it."""
    h = word_hashes(text.encode("utf-8", "replace"))
    for _ in range(4):
        h = h[1:] * np.uint64(0x9E3779B97F4A7C15) + h[:-1] if len(h) > 1 else h
    return int((h.view(np.int64)).min()) if len(h) else 0


def learned_insults(sample: DataFrame, *, min_groups: int = 6, min_ratio: float = 12.0) -> dict[str, float]:
    """Words and stems that toxic documents hold far oftener than others, with log ratios.

    Groups of near copies count once, or a copied document's rare words would pass as
    insults. The sample is bounded, and so are the entries that leave the executors.
    """
    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: set[tuple[str, int, int]] = set()
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                group = group_of(text.lower())
                out.update((k, group, label) for w in set(text.lower().split()) for k in keys(EDGE.sub("", w)) if len(w) > 2)
            columns = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32())], names=["key", "group", "label"])

    marked = sample.mapInArrow(seen, "key string, group long, label int").groupBy("key", "group").agg(F.max("label").alias("label"))
    counts = marked.groupBy("key").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))
    sizes = sample.agg(F.sum("label"), F.sum(1 - F.col("label"))).first()
    share = (sizes[0] or 0) / max(sizes[1] or 0, 1)
    ratio = (F.col("toxic") / (F.col("clean") + 0.5)) / max(share, 1e-6)
    kept = counts.where((F.col("toxic") >= min_groups) & (ratio >= min_ratio)).select("key", F.log(ratio).alias("strength"))
    return {r["key"]: r["strength"] for r in kept.collect()}


def train(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", rows: int = 8000) -> tuple[dict[str, float], np.ndarray]:
    """Insult strengths and class weights from at most ``rows`` labelled documents that
    are not held out. Without rows of both labels, or without any, there are no weights: all
    scores are 1/2.
    """
    sample = labelled_sample(docs, labels, label, rows)
    insults = learned_insults(sample)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(insults)
        for batch in batches:
            found = [features(x, lexicon).tobytes() for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column("label"), batch.column("id").cast(pa.string())], names=["x", "label", "id"])

    def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = [(np.frombuffer(r["x"]), r["label"]) for b in batches for r in b.to_pylist()]
        w = fit(np.array([x for x, _ in both]), np.array([y for _, y in both], float)) if both else np.zeros(N_FEATURES)
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary())], names=["w"])

    small = sample.mapInArrow(vectors, "x binary, label int, id string").repartition(1).sortWithinPartitions("id", "x")
    found = small.mapInArrow(weigh, "w binary").collect()
    return insults, np.frombuffer(found[0][0]) if found else np.zeros(N_FEATURES)


def score(docs: DataFrame, insults: dict[str, float], weights: np.ndarray, *, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted and n_clauses, the number of matched clauses, per row.

    Null and empty texts have no clause and get the score of no match; rows of null or
    repeated id are scored one by one.
    """
    kind = docs.schema[id_col].dataType

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(insults)
        for batch in batches:
            rows = [features(x.as_py(), lexicon) for x in batch.column("text")]
            x = np.array(rows).reshape(-1, N_FEATURES)
            p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            n = np.rint(np.expm1(x[:, -2])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(p), pa.array(n)], names=["id", "held_out", "score", "n_clauses"])

    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    found = rows.mapInArrow(scored, f"id {kind.simpleString()}, held_out boolean, score double, n_clauses long")
    return found.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_clauses")
