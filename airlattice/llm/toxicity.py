"""Toxicity by multiple-instance learning.

Only documents have labels, but sentences offend. A sentence's score is logistic in the evidence of
its words; a document's score is the noisy-or of its sentences. Training fits both from document
labels alone, so afterwards sentence scores say where the offence is.

Evidence is a word or a word's beginning. The vocabulary is what occurs in toxic documents of the
sample clearly more often than in others; a sentence without evidence cannot offend, so length
alone never adds up to a verdict.

Cases: a null or empty text has score 0; labels that are null or belong to no document are not
used, and among several labels of a document or of equal texts toxic wins; repeated rows are scored
each, and equal texts are trained on once; rows without an id are scored and never trained on; without any labels, or of one kind only, every score
is 0; an empty table gives no rows.
"""

import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airlattice.llm.common import fold, return_memory, stage

# The model is fitted on at most so many distinct labelled texts of either kind, chosen by a hash of
# an id: a bounded sample, of whole texts.
SAMPLE_TOXIC, SAMPLE_OTHER = 3_000, 6_000
# Bag-level test for evidence: documents, ratio of shares, and standard errors of the difference.
MIN_DOCS, MIN_RATIO, MIN_Z = 6, 8.0, 4.5
MAX_WORDS = 20_000
STEPS, RATE, PENALTY, START = 300, 0.1, 2e-4, -4.0
THRESHOLD = 0.7

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]+")
BEGINNINGS = (4, 5)
KEPT_WORDS = 100_000
SLICE = 250


def evidence(word: str) -> list[str]:
    """The word, and its beginnings (marked, so that no word is taken for one)."""
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) > n)]


def sentences(text: str) -> list[tuple[int, int]]:
    """(from, to) of the sentences of a text."""
    return [m.span() for m in _SENTENCE.finditer(text)]


# --- training -------------------------------------------------------------------------------


def sample(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """text, toxic of the labelled texts that the model is fitted on. Copies of a text are one, and toxic
    if any of them is."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where((fold("doc_id", folds) != held) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # A text's key is 128 bits; of its rows the first by hash of the id stands for it.
    key = F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), F.col("text")).alias("b"))
    keyed = texts.select("doc_id", key.alias("key")).join(known, "doc_id")
    one = keyed.groupBy("key").agg(F.max("toxic").alias("toxic"), F.min(F.struct(F.xxhash64("doc_id").alias("place"), "doc_id")).alias("first"))
    one = stage(one.select("key", "toxic", "first.*"), "labelled")
    order = ["place", "doc_id", "key"]
    chosen = one.where("toxic = 1").orderBy(*order).limit(SAMPLE_TOXIC)
    chosen = chosen.unionByName(one.where("toxic = 0").orderBy(*order).limit(SAMPLE_OTHER))
    # At most the sample's size in ids, whatever the tables. A row that is there more than once counts once.
    chosen = chosen.select("doc_id", F.col("key").alias("chosen"), "toxic")
    found = texts.join(F.broadcast(chosen), "doc_id").where(key == F.col("chosen"))
    return found.groupBy("chosen").agg(F.first("text").alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic")


def bags(text: str, shared: dict | None = None) -> list[list[str]]:
    """The distinct words of each sentence of a text. ``shared``: words of other texts, to be held once."""
    lowered = (text or "").lower()
    shared = {} if shared is None else shared
    found = [sorted(set(_WORD.findall(lowered[a:b]))) for a, b in sentences(lowered)]
    return [[shared.setdefault(w, w) for w in words] for words in found if words]


def select_evidence(toxic: list, other: list) -> list[str]:
    """Evidence that is clearly more frequent among the bags of toxic documents."""
    seen: Counter = Counter()
    for doc in toxic:
        seen.update({e for words in doc for word in words for e in evidence(word)})
    often = {e: c for e, c in seen.items() if c >= MIN_DOCS}
    elsewhere: Counter = Counter()
    for doc in other:
        elsewhere.update({e for words in doc for word in words for e in evidence(word) if e in often})
    n1, n0 = len(toxic), len(other)
    found = []
    for e, c1 in often.items():
        c0 = elsewhere[e]
        share1, share0, both = c1 / n1, (c0 + 0.5) / (n0 + 1), (c1 + c0) / (n1 + n0)
        z = (share1 - c0 / n0) / np.sqrt(both * (1 - both) * (1 / n1 + 1 / n0) + 1e-12)
        if share1 >= MIN_RATIO * share0 and z >= MIN_Z:
            found.append((-z, e))
    return [e for _, e in sorted(found)[:MAX_WORDS]]


def train(docs: list, labels: list[int]) -> dict[str, float]:
    """Weights of the evidence, and under "" the bias, from bags of sentences and document labels."""
    toxic = [d for d, y in zip(docs, labels) if y]
    other = [d for d, y in zip(docs, labels) if not y]
    words = select_evidence(toxic, other) if toxic and other else []
    if not words:
        return {}
    place = {e: i for i, e in enumerate(words)}
    # Sentences with evidence as sparse rows; documents as runs of such sentences.
    rows, columns, owner = [], [], []
    for d, doc in enumerate(docs):
        for sentence in doc:
            own = [place[e] for word in sentence for e in evidence(word) if e in place]
            if own:
                rows += [len(owner)] * len(own)
                columns += own
                owner.append(d)
    rows, columns, owner = np.array(rows), np.array(columns), np.array(owner)
    y = np.array(labels, float)
    weights, bias = np.ones(len(words)), START
    state = np.zeros((2, len(words) + 1))
    for step in range(1, STEPS + 1):
        z = np.bincount(rows, weights[columns], minlength=len(owner)) + bias
        mass = np.bincount(owner, np.logaddexp(0, z), minlength=len(docs))
        # Of -log P(label): toxic documents want mass, others none. Toxic ones without evidence cannot change.
        slope = np.where(y > 0, -1 / np.expm1(np.clip(mass, 1e-6, 50)), 1.0)
        by_sentence = slope[owner] / (1 + np.exp(-z))
        gradient = np.append(np.bincount(columns, by_sentence[rows], minlength=len(words)), by_sentence.sum())
        gradient[:-1] += PENALTY * weights * len(docs) / 100
        state[0] = 0.9 * state[0] + 0.1 * gradient
        state[1] = 0.99 * state[1] + 0.01 * gradient**2
        move = RATE * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-8)
        weights, bias = weights - move[:-1], bias - move[-1]
    return {"": float(bias)} | {e: float(w) for e, w in zip(words, weights)}


def fit(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1) -> dict[str, float]:
    """The model. It is trained in one task on the bounded sample; its size is bounded by MAX_WORDS."""

    def run(batches):
        return_memory()
        texts, known, shared = [], [], {}
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                texts += [bags(t, shared) for t in part.column("text").to_pylist()]
                known += part.column("toxic").to_pylist()
        model = train(texts, known)
        yield pa.RecordBatch.from_pydict({"e": pa.array(list(model), pa.string()), "w": pa.array(list(model.values()), pa.float64())})

    # In one fixed order, so that the same tables give the same model.
    found = sample(docs, labels, folds, held).repartition(1).sortWithinPartitions("toxic", "text").mapInArrow(run, "e string, w double")
    return {row["e"]: row["w"] for row in found.collect()}


# --- scoring --------------------------------------------------------------------------------


class Scorer:
    def __init__(self, model: dict[str, float]):
        self.model, self.bias = model, model.get("", 0.0)
        self.known: dict = {}

    def weight(self, word: str) -> float | None:
        """Sum of a word's evidence, None if it has none."""
        own = [self.model[e] for e in evidence(word) if e in self.model]
        return sum(own) if own else None

    def hits(self, lowered: str) -> set:
        words = set(_WORD.findall(lowered))
        known = self.known
        fresh = words.difference(known)
        if fresh:
            if len(known) + len(fresh) > KEPT_WORDS:
                known.clear()
                fresh = words
            known.update((w, self.weight(w)) for w in fresh)
        return {w for w in words if known[w] is not None}

    def located(self, text: str) -> list[tuple[int, int, float]]:
        """(from, to, score) of the sentences with evidence; places are in the lower-cased text."""
        lowered = text.lower()
        hits = self.hits(lowered)
        if not hits:
            return []
        found = []
        for a, b in sentences(lowered):
            own = hits.intersection(_WORD.findall(lowered[a:b]))
            if own:
                z = self.bias + sum(self.known[w] for w in sorted(own))
                found.append((a, b, float(1 / (1 + np.exp(-z)))))
        return found

    def score(self, text: str | None) -> float:
        """Noisy-or of the sentences."""
        miss = 1.0
        for _, _, p in self.located(text or ""):
            miss *= 1.0 - p
        return 1.0 - miss


def score_column(model, text: Column) -> Column:
    """``model``: broadcast."""

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return_memory()
        own = _scorer(model)
        return pd.Series([own.score(t) for t in texts], dtype="float64")

    return run(text)


_scorers: dict = {}


def _scorer(model) -> Scorer:
    if _scorers.get("id") != id(model.value):
        _scorers.update(id=id(model.value), scorer=Scorer(model.value))
    return _scorers["scorer"]


def scored(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, folds, held))
    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score_column(model, F.col("text").cast("string")).alias("score"))
    return wanted.select(
        "doc_id", (fold("doc_id", folds) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def offending(docs: DataFrame, model, threshold: float = 0.5) -> DataFrame:
    """doc_id, start, end (characters of the lower-cased text), sentence_score: sentences that offend."""

    @F.pandas_udf("array<struct<start:long,end:long,score:double>>")
    def run(texts: pd.Series) -> pd.Series:
        own = _scorer(model)
        return pd.Series([[{"start": a, "end": b, "score": p} for a, b, p in own.located(t or "") if p >= threshold] for t in texts])

    found = docs.select("doc_id", F.explode(run(F.col("text").cast("string"))).alias("s"))
    return found.select("doc_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.score").alias("sentence_score"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score stays below the threshold."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    return docs.where(score_column(model, F.col("text").cast("string")) < threshold)
