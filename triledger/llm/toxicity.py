"""Toxic documents: a lexicon trie searched by Levenshtein automata, and scores of the windows around the finds.

The lexicon is learned from labelled documents: beginnings of words that occur in toxic documents and hardly elsewhere.  Words
are matched with it up to a misspelling: the automaton of all words within the edit distance of a term runs over the trie of all
terms at once.  Each find counts by its distance, and less between quotation marks; a misspelled one also by how much oftener
its term's misspellings occur in toxic rows than in clean ones.  A document's finds, its densest window and their share of the
words give its score.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triledger.llm.tables import packed, partitions, saved

# Labelled rows that a model is fitted on; the smallest hashes of the ids are taken.
LABELLED = 12_000
SHORTEST, LONGEST, TERMS = 4, 12, 2_000
# A term of fewer letters must be spelled right.
MISSPELLED_FROM = 5
MISSPELLED, QUOTED = 0.6, 0.25
# The share of rows below which misspellings of a term say little about it.
UNSURE = 0.01
WINDOW, NEAR = 25, 8
THRESHOLD = 0.3
QUOTES = "\"“”„«»‹›「」"
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
# Runs of letters, as the terms are learned from, with the quotation marks at them; other quotation marks stand alone.
_TOKEN = re.compile(rf"[{QUOTES}]*[^\W\d_]+[{QUOTES}]*|[{QUOTES}]+")


class Lexicon:
    """Terms as a trie; `find` tells how a word begins with one of them, up to one edit behind the first letter."""

    def __init__(self, terms: list[str], spelled: frozenset[str] = frozenset(), remembered: int = 500_000,
                 misspelled: dict[str, float] | None = None):
        """`spelled` are terms that must be spelled right, like those of fewer than MISSPELLED_FROM letters.

        `misspelled` has the weights of misspelled finds by term, MISSPELLED where it has none.
        """
        self.terms: dict[int, str] = {}
        self.children: list[dict[str, int]] = [{}]
        self.allowed: list[int] = [-1]  # edits allowed at the end of a term
        for term in terms:
            node = 0
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.allowed.append(-1)
                node = self.children[node][c]
            self.allowed[node] = 1 if len(term) >= MISSPELLED_FROM and term not in spelled else 0
            self.terms[node] = term
        # States of the automaton run over the trie: trie nodes with the edits used so far.
        self.states: dict[frozenset, int] = {}
        self.members: list[frozenset] = []
        self.found: list[int] = []
        self.moves: list[dict[str, int]] = []
        self.begin = self._state({(0, 0)})
        self.words: dict[str, float] = {}
        self.remembered = remembered
        self.misspelled = misspelled or {}

    def _state(self, nodes: set) -> int:
        # A letter of the term may be missing in the word.
        nodes |= {(child, 1) for node, edits in nodes if edits == 0 and node for child in self.children[node].values()}
        key = frozenset(nodes)
        if key not in self.states:
            self.states[key] = len(self.members)
            self.members.append(key)
            self.moves.append({})
            self.found.append(min((e for node, e in key if e <= self.allowed[node]), default=2))
        return self.states[key]

    def _move(self, state: int, c: str) -> int:
        nodes = set()
        for node, edits in self.members[state]:
            child = self.children[node].get(c)
            if child is not None:
                nodes.add((child, edits))
            if edits == 0 and node:
                nodes.add((node, 1))
                nodes.update((other, 1) for other in self.children[node].values())
        to = self._state(nodes)
        self.moves[state][c] = to
        return to

    def edits(self, word: str) -> int:
        """Fewest edits (0 or 1) with which the word begins with a term, else 2."""
        state, best = self.begin, 2
        for c in word:
            to = self.moves[state].get(c)
            state = self._move(state, c) if to is None else to
            if not self.members[state]:
                break
            if self.found[state] < best:
                best = self.found[state]
                if best == 0:
                    break
        return best

    def near(self, word: str) -> set[str]:
        """Terms that the word begins with, misspelled."""
        state, out = self.begin, set()
        for c in word:
            to = self.moves[state].get(c)
            state = self._move(state, c) if to is None else to
            out |= {self.terms[node] for node, e in self.members[state] if node in self.terms and e == 1 and self.allowed[node] == 1}
        return out

    def weight(self, token: str) -> float:
        """Weight of a token of a text, 0 if it begins with no term; the last ones seen are remembered."""
        best = self.words.get(token)
        if best is None:
            if len(self.words) >= self.remembered:
                self.words.clear()
            word = _EDGE.sub("", token)
            edits = self.edits(word)
            best = 1.0 if edits == 0 else 0.0
            if edits == 1:
                best = max(self.misspelled.get(t, MISSPELLED) for t in self.near(word))
            self.words[token] = best
        return best


def finds(tokens: list[str], lexicon: Lexicon) -> list[tuple[int, float]]:
    """Place and weight of every term: less if misspelled, less if a quotation opens before it and closes behind it."""
    hits = {t: w for t in set(tokens) if (w := lexicon.weight(t)) > 0}
    out = []
    for i, token in enumerate(tokens) if hits else ():
        if token in hits:
            before = sum(w.count(q) for w in tokens[max(0, i - NEAR):i] for q in QUOTES)
            before += sum(token[:len(token) - len(token.lstrip(QUOTES))].count(q) for q in QUOTES)
            behind = any(q in w for w in [token.lstrip(QUOTES), *tokens[i + 1:i + 1 + NEAR]] for q in QUOTES)
            out.append((i, hits[token] * QUOTED if before % 2 and behind else hits[token]))
    return out


def evidence(text: str | None, lexicon: Lexicon) -> tuple[float, float, float]:
    """Logarithms of the sum of the finds, of the densest window and of their share of the words."""
    tokens = _TOKEN.findall((text or "").lower())
    found = finds(tokens, lexicon)
    if not found:
        return 0.0, 0.0, 0.0
    places, weights = (np.array(x, dtype=float) for x in zip(*found, strict=True))
    sums = np.concatenate([[0.0], np.cumsum(weights)])
    densest = (sums[np.searchsorted(places, places + WINDOW)] - sums[:-1]).max()
    return float(np.log1p(sums[-1])), float(np.log1p(densest)), float(np.log1p(1000 * sums[-1] / len(tokens)))


def evidence_of(text: str, terms: list[str], misspelled: dict[str, float]) -> Column:
    def run(columns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon(terms, misspelled=misspelled)
        for series in columns:
            yield pd.DataFrame([evidence(t, lexicon) for t in series], columns=["total", "densest", "share"])

    return F.pandas_udf(run, "total double, densest double, share double")(F.col(text))


@dataclass(frozen=True)
class Model:
    terms: list[str]
    misspelled: dict[str, float]
    weights: list[float]

    def lexicon(self) -> Lexicon:
        return Lexicon(self.terms, misspelled=self.misspelled)

    def score(self, text: str) -> Column:
        """The probability of label 1 for a text column; a null or empty text has no finds."""
        found = evidence_of(text, self.terms, self.misspelled)
        return F.get(F.transform(F.array(found), self._probability), F.lit(0))

    def _probability(self, e: Column) -> Column:
        bias, *slopes = self.weights
        logit = F.lit(bias) + sum((F.lit(w) * e[n] for w, n in zip(slopes, ("total", "densest", "share"), strict=True)), F.lit(0.0))
        return 1 / (1 + F.exp(-logit))


def held_out(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _terms(sample: DataFrame) -> list[str]:
    """Beginnings of words that mark toxic documents."""
    words = F.array_distinct(F.filter(F.split(F.lower("_text"), r"[^\p{L}]+"), lambda w: F.char_length(w) >= SHORTEST))
    starts = F.array_distinct(F.flatten(F.transform(words, lambda w: F.transform(
        F.sequence(F.lit(SHORTEST), F.least(F.char_length(w), F.lit(LONGEST))), lambda n: F.left(w, n)))))
    # Copies and near copies of one document, told by the smallest hash of three words in a row, are one witness.
    sample = sample.withColumn("_sketch", F.get(F.transform(F.array(F.split("_text", r"\s+")), lambda a: F.array_min(F.transform(
        a, lambda w, i: F.xxhash64(w, F.get(a, i + 1), F.get(a, i + 2))))), F.lit(0))).dropDuplicates(["_sketch", "_toxic"])
    totals = sample.agg(F.sum("_toxic").alias("bad"), F.count("*").alias("all")).first()
    bad, share = totals["bad"] or 0, (totals["bad"] or 0) / max(1, totals["all"])
    if not 0 < bad < totals["all"]:
        return []
    counts = sample.select("_toxic", F.explode(starts).alias("start")).groupBy("start").agg(
        F.sum("_toxic").alias("bad"), F.count("*").alias("all"))
    # So rare among clean documents that chance explains none of a hundred thousand beginnings.
    least = int(np.ceil(log(1e7) / log(1 / share)))
    marking = counts.filter((F.col("bad") >= least) & (F.col("bad") >= 0.98 * F.col("all")))
    found = {r["start"]: r["bad"] for r in marking.orderBy(F.desc("bad"), "start").limit(TERMS).collect()}
    out = set()
    for start in found:
        if any(start[:n] in found for n in range(SHORTEST, len(start))):
            continue
        # The longest continuation that nearly all of these documents have.
        out.add(max((s for s in found if s.startswith(start) and found[s] >= 0.9 * found[start]), key=lambda s: (len(s), found[s], s)))
    return sorted(out)


def _misspelled(sample: DataFrame, terms: list[str]) -> dict[str, float]:
    """Weights of misspelled finds by term: the part of them in toxic rows that their rate in clean rows does not explain.

    Only rates of the two kinds of rows count, so the weights do not depend on the size of the sample.
    """
    def run(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lexicon, seen = Lexicon(terms), {}
        for series in columns:
            out = []
            for text in series:
                found = set()
                for token in set(_TOKEN.findall((text or "").lower())):
                    if token not in seen:
                        word = _EDGE.sub("", token)
                        seen[token] = lexicon.near(word) if lexicon.edits(word) == 1 else ()
                    found.update(seen[token])
                # Every row counts once under no term.
                out.append(["", *sorted(found)])
            yield pd.Series(out)

    near = sample.select("_toxic", F.explode(F.pandas_udf(run, "array<string>")("_text")).alias("term"))
    # At most two rows for each term.
    counts = {(r["term"], r["_toxic"]): r["count"] for r in near.groupBy("term", "_toxic").count().collect()}
    out = {}
    for term in terms:
        clean, toxic = (counts.get((term, kind), 0) / max(1, counts.get(("", kind), 0)) for kind in (0, 1))
        out[term] = MISSPELLED * (UNSURE + max(0.0, toxic - clean)) / (UNSURE + max(toxic, clean))
    return out


def _fitted(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3) -> list[float]:
    """Logistic regression by Newton's method, with a small penalty on the slopes."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    ridge = penalty * len(x) * np.diag([1e-3, *[1.0] * (x.shape[1] - 1)]) / 10
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return [float(v) for v in w]


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", *, labelled: int = LABELLED) -> Model:
    """A model from at most `labelled` labelled rows outside the held-out quarter; repeated or null labels do not matter.

    Without both kinds of labels there are no terms, and all scores are the share of toxic labels.
    """
    known = (
        labels.select(F.col(doc_id).alias("_id"), F.col("toxic").cast("int").alias("_toxic")).filter("_id is not null and _toxic is not null")
        .groupBy("_id").agg(F.max("_toxic").alias("_toxic")).filter(~held_out("_id"))
        .orderBy(F.xxhash64("_id"), "_id").limit(labelled))
    # At most `labelled` ids.
    sample = saved(docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(known), "_id"))
    sample = sample.repartition(partitions(docs.sparkSession, 0, 1))
    terms = _terms(sample)
    misspelled = _misspelled(sample, terms) if terms else {}
    # At most `labelled` rows of four numbers, but for repeated ids.
    rows = sample.select("_toxic", evidence_of("_text", terms, misspelled).alias("e")).select("_toxic", "e.*").collect()
    if not rows:
        return Model(terms, misspelled, [0.0, 0.0, 0.0, 0.0])
    data = np.array(rows, dtype=float)
    y = data[:, 0]
    if not terms:
        share = min(max(y.mean(), 1e-3), 1 - 1e-3)
        return Model(terms, misspelled, [log(share / (1 - share)), 0.0, 0.0, 0.0])
    return Model(terms, misspelled, _fitted(data[:, 1:], y))


def scored(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; other columns are not read."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), model.score(text).alias("score"))
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that are not predicted toxic, with all their columns."""
    return docs.select(model.score(text).alias("score"), packed(docs)).filter(F.col("score") < threshold).select("_doc.*")
