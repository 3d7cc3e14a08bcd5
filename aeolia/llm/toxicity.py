"""Toxicity by a weighted finite-state grammar over clauses.

Two transducers are composed. The first maps characters to symbols: an automaton over word
forms and word stems writes INSULT with a weight, and fixed lists write THREAT, TARGET,
NEGATION and REPORT. The second reads the symbols of one clause: its state holds whether a
target was named, how many words a negation still reaches and whether speech is reported,
and each insult or threat adds its weight to the output named by that state. A document's
score is the logistic of a weighted sum over its clauses, not of single words.

Insult forms and output weights are learned from a bounded sample of labelled rows
(``MOST_TOXIC`` and ``MOST_CLEAN``, chosen by a hash of the id); every text is then scored
whole. Only the text is an input of the score.

Null and empty texts get the score of a text without matches. Repeated rows get equal
scores. Without labels of both kinds no insult form is learned and every score is 0.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aeolia.llm.tables import table
from aeolia.llm.words import slices, windows

MOST_TOXIC, MOST_CLEAN, MOST_FORMS = 2_500, 7_500, 4_000
#: A form counts as an insult if at least this share of toxic texts and so many have it, and
#: it is this many times as common there as in the others.
LEAST_SHARE, LEAST_TEXTS, LEAST_RATIO = 0.006, 6, 25.0
MOST_OF_STEM = 0.8
STEMS = (4, 5, 6, 7)
#: Words that a negation reaches.
REACH = 3

# Function words of the four languages of the corpus.
THREATS = "kill hurt destroy beat burn shoot die töten umbringen schlagen verbrennen sterben tuer frapper brûler mourir crever matar golpear quemar morir".split()
TARGETS = "you your yours he she they du dich dir euch ihr tu te toi vous ton usted ustedes vosotros ti tú".split()
NEGATIONS = "not no never isn't aren't nicht kein keine nie ne pas jamais aucun nunca ni tampoco".split()
REPORTS = "said says wrote claimed called quoted sagte schrieb nannte dit écrit dijo escribió llamó".split()

PLAIN, THREAT, TARGET, NEGATION, REPORT = range(5)
_SYMBOL = {w: k for k, ws in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in ws}
_CLAUSE = re.compile(r"[.!?;:\n]")
_TRIM = "\"'“”«»()[]{}<>,.!?;:*#$%&|_-"
#: Outputs of the clause transducer.
OUTPUTS = ("plain", "targeted", "negated", "reported", "threat", "clauses")


@dataclass
class Grammar:
    forms: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    weights: tuple[float, ...] = (0.0,) * len(OUTPUTS)
    bias: float = -math.inf


class Transducer:
    """The composed machine for one task."""

    def __init__(self, grammar: Grammar):
        self.g = grammar
        self.automaton = ahocorasick.Automaton()
        for w in {*grammar.forms, *grammar.stems, *THREATS}:
            self.automaton.add_word(w, len(w))
        self.automaton.make_automaton()

    def insult(self, word: str) -> float:
        """The first transducer's weight of a word."""
        found = self.g.forms.get(word, 0.0)
        return max([found, *(self.g.stems.get(word[:n], 0.0) for n in STEMS)])

    def clause(self, words: list[str]) -> np.ndarray:
        """The second transducer over one clause."""
        out, targets, reach, told, any_hit = np.zeros(len(OUTPUTS)), 0, 0, False, False
        pending: list[tuple[int, float]] = []
        for raw in words:
            w = raw.strip(_TRIM)
            weight, symbol = self.insult(w), _SYMBOL.get(w, PLAIN)
            told |= symbol == REPORT or raw[:1] in "\"“«"
            targets += symbol == TARGET
            if weight or symbol == THREAT:
                k = 4 if symbol == THREAT else 2 if reach else 3 if told else 0
                pending.append((k, weight or 1.0))
            reach = REACH if symbol == NEGATION else max(0, reach - 1)
            told &= raw[-1:] not in "\"”»"
        for k, weight in pending:
            # A threat without a target in its clause is no threat.
            if k == 4 and not targets:
                continue
            out[1 if k == 0 and targets else k] += weight
            any_hit = True
        out[5] = any_hit
        return out

    def outputs(self, text: str) -> np.ndarray:
        low = text.lower()
        done, total = -1, np.zeros(len(OUTPUTS))
        for end, n in self.automaton.iter(low):
            begin = end - n + 1
            if begin <= done or (begin and low[begin - 1].isalnum()):
                continue
            a = max(m.end() for m in _CLAUSE.finditer(low, max(0, done), begin)) if _CLAUSE.search(low, max(0, done), begin) else max(0, done)
            stop = _CLAUSE.search(low, end)
            b = stop.start() if stop else len(low)
            total += self.clause(low[a:b].split())
            done = b
        return total


def _score(x: np.ndarray, grammar: Grammar) -> np.ndarray:
    z = np.log1p(x) @ np.array(grammar.weights) + grammar.bias
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def sample(docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN) -> DataFrame:
    """(text, toxic): a bounded choice of labelled texts by a hash of the id, each text once."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    pick = lambda kind, most: known.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    few = F.broadcast(pick(1, most_toxic).unionByName(pick(0, most_clean)))  # at most most_toxic + most_clean rows
    return docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(few, "doc_id").select("text", "toxic")


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        counts = {0: Counter(), 1: Counter()}
        for text, toxic in zip(pdf["text"], pdf["toxic"], strict=True):
            words = {w for x in text.lower().split() if (w := x.strip(_TRIM))}
            counts[toxic].update(words)
            counts[toxic].update({f"{w[:n]}*" for w in words for n in STEMS if len(w) >= n})
            counts[toxic][""] += 1
        names = counts[0].keys() | counts[1].keys()
        yield pd.DataFrame({"form": list(names), "n_clean": [counts[0][w] for w in names], "n_toxic": [counts[1][w] for w in names]})


def fit(docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN) -> Grammar:
    """Learns insult forms from the sample, then the output weights on the same rows."""
    rows = sample(docs, labels, most_toxic, most_clean)
    rows = rows.select("text", "toxic", F.pandas_udf(_least_hash, "long")("text").alias("key")).groupBy("key", "toxic").agg(F.min("text").alias("text")).drop("key")
    counted = rows.mapInPandas(_counted, "form string, n_clean long, n_toxic long").groupBy("form").agg(F.sum("n_clean").alias("n_clean"), F.sum("n_toxic").alias("n_toxic"))
    counted = counted.where((F.col("n_toxic") >= LEAST_TEXTS) | (F.col("form") == ""))
    top = counted.orderBy(F.col("form") != "", F.desc(F.col("n_toxic") / (F.col("n_clean") + 0.5)), "form").limit(MOST_FORMS).collect()
    total = next(((r.n_clean, r.n_toxic) for r in top if r.form == ""), (0, 0))
    if not all(total):
        return Grammar()
    g = Grammar()
    forms = {r.form: r.n_toxic for r in top}
    for r in top:
        # A stem of which one form makes up nearly all says no more than that form.
        if r.form.endswith("*") and max((n for f, n in forms.items() if f[-1:] != "*" and f.startswith(r.form[:-1])), default=0) > MOST_OF_STEM * r.n_toxic:
            continue
        ratio = (r.n_toxic + 0.5) / (total[1] + 1) / ((r.n_clean + 0.5) / (total[0] + 1))
        if r.form and ratio >= LEAST_RATIO and r.n_toxic >= LEAST_SHARE * total[1]:
            (g.stems if r.form.endswith("*") else g.forms)[r.form.rstrip("*")] = math.log(ratio) / 4

    def traits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = Transducer(g)
        for pdf in batches:
            yield pd.DataFrame([machine.outputs(t) for t in pdf["text"]], columns=list(OUTPUTS)).assign(toxic=pdf["toxic"].to_numpy())

    schema = ", ".join(f"{c} double" for c in OUTPUTS) + ", toxic int"
    seen = rows.mapInPandas(traits, schema).groupBy(*OUTPUTS, "toxic").count().toPandas()  # of at most the sample's rows
    x, y, n = np.log1p(seen[list(OUTPUTS)].to_numpy(float)), seen["toxic"].to_numpy(float), seen["count"].to_numpy(float)
    # Newton's method with a small ridge; both kinds weigh the same.
    n = n * np.where(y == 1, 0.5 / max(1, n[y == 1].sum()), 0.5 / max(1, n[y == 0].sum())) * n.sum()
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    ridge = np.diag([0.5] * x.shape[1] + [0.01])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w += np.linalg.solve((a * (n * p * (1 - p))[:, None]).T @ a + ridge, a.T @ (n * (y - p)) - ridge @ w)
    g.weights, g.bias = tuple(w[:-1].tolist()), float(w[-1])
    return g


def _least_hash(text: pd.Series) -> pd.Series:
    """The least hash of four words in a row: near copies mostly share it and then count once."""
    out = np.zeros(len(text), np.int64)
    for at, _, w in slices(pa.array(text, pa.string())):
        h, ok = windows(w.hashes(), w.row, [0, 1, 2, 3])
        row, least = w.row[ok], np.full(len(w.offsets) - 1, -1, np.int64)
        if len(h):
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            least[row[first]] = np.minimum.reduceat((h >> np.uint64(1)).astype(np.int64), first)
        out[at : at + len(least)] = least
    return pd.Series(out)


def score(docs: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of every text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = Transducer(grammar)
        for pdf in batches:
            s = _score(np.array([machine.outputs(t or "") for t in pdf["t"]]).reshape(-1, len(OUTPUTS)), grammar)
            yield pd.DataFrame({"d": pdf["d"], "score": s, "predicted": (s >= 0.5).astype("int32")})

    out = docs.select(F.col(id_col).alias("d"), F.col(text_col).alias("t")).mapInPandas(run, f"d {kind}, score double, predicted int")
    return out.withColumnRenamed("d", id_col)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    grammar = fit(docs, labels.where(~held_out))
    return score(docs, grammar).select("doc_id", held_out.alias("held_out"), "score", "predicted")
