"""Language identification with language-bitmask n-gram filters.

Letter trigrams of all labelled training texts are counted per language, and a trigram belongs to
every language where it is at home: not rare there against the language where it is most frequent.
One Bloom filter holds all languages at once: a slot is a mask with a bit per language, so the AND
of a trigram's slots gives every language that contains it. A text's trigrams vote by the counts of
their bits; each language's count is corrected for the false positives of its own bits before the
largest decides.

Cases: a null text, or one without a letter, is ``und`` with score 0; letters but no trigram of any
language give the language of most training texts with score 0, or ``und`` if nothing was learned;
null languages teach nothing; ties go to the language with more training texts, then by name; rows
without an id are predicted and learned from; repeated rows count each; an empty table gives no rows.
"""

import functools
import math
import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airlattice.llm.common import arrow_rows, fold

UNKNOWN = "und"
# A trigram is at home where it was seen that often, has that share of the language's trigrams, and
# at least that part of its largest share anywhere. The share bounds a language's trigrams, and with
# them the filter that is broadcast, whatever the corpus.
MIN_COUNT, MIN_SHARE, MIN_PART = 3, 1e-6, 0.3
HASHES, SLOTS_PER_GRAM = 4, 16
WORD_BITS = 64
# Texts are joined and worked on together up to about this many characters.
STEP = 1 << 20


@functools.cache
def _letter_table() -> np.ndarray:
    """True for the code points that are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def trigrams(texts: list[str]):
    """keys, owner, letters: the trigrams of lower-cased texts over letters and single spaces, the number
    of the text each comes from, and whether a text has a letter."""
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer(" ".join(["", *lowered, ""]).encode("utf-32-le", "replace"), np.uint32)
    sizes = np.array([len(t) for t in lowered], np.int64) + 1
    owner = np.repeat(np.arange(len(texts)), sizes)  # a text and the space before it
    owner = np.append(owner, len(texts) - 1 if texts else 0)
    is_letter = _letter_table()[codes]
    codes = np.where(is_letter, codes, np.uint32(32))
    keep = np.ones(len(codes), bool)
    keep[1:] = is_letter[1:] | is_letter[:-1]  # of a run of spaces the first stays
    codes, owner = codes[keep].astype(np.uint64), owner[keep]
    letters = np.bincount(owner, is_letter[keep], minlength=len(texts)) > 0
    keys = codes[:-2] | codes[1:-1] << np.uint64(21) | codes[2:] << np.uint64(42)
    # A trigram belongs to its middle character's text; around a space both letters must be of one.
    inside = (codes[1:-1] != 32) | (owner[:-2] == owner[2:])
    return keys[inside], owner[1:-1][inside], letters


def _steps(texts: list[str]):
    """Slices of texts of about STEP characters; a longer text is one."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= STEP:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


# --- learning -------------------------------------------------------------------------------


def gram_counts(docs: DataFrame) -> DataFrame:
    """lang, gram, n over all rows of ``docs`` (lang, text); each task sums before anything moves."""

    def run(batches):
        held: dict = {}
        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            groups: dict = {}
            for lang, text in zip(langs, texts):
                groups.setdefault(lang, []).append(text or "")
            for lang, own in groups.items():
                for a, b in _steps(own):
                    found = np.unique(trigrams(own[a:b])[0], return_counts=True)
                    held[lang] = _merged(held[lang], found) if lang in held else found
        for lang, (grams, n) in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(n, pa.int64())],
                ["lang", "gram", "n"],
            )

    part = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return part.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _merged(a, b):
    grams, place = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
    return grams, np.bincount(place, np.concatenate([a[1], b[1]])).astype(np.int64)


def at_home(counts: DataFrame) -> DataFrame:
    """lang, gram: the trigrams of each language."""
    totals = counts.groupBy(F.col("lang").alias("t_lang")).agg(F.sum("n").alias("total"))
    shares = counts.join(totals, F.col("lang") == F.col("t_lang")).withColumn("share", F.col("n") / F.col("total"))
    own = shares.where((F.col("n") >= MIN_COUNT) & (F.col("share") >= MIN_SHARE))
    best = own.groupBy(F.col("gram").alias("b_gram")).agg(F.max("share").alias("best"))
    return own.join(best, F.col("gram") == F.col("b_gram")).where(F.col("share") >= MIN_PART * F.col("best")).select("lang", "gram")


class LanguageFilter:
    """Slots with a bit per language; several words of 64 bits where there are more languages."""

    def __init__(self, langs: list[str], grams_of: dict[str, np.ndarray]):
        self.langs = langs
        distinct = sum(map(len, grams_of.values()))
        self.bits = max(10, math.ceil(math.log2(SLOTS_PER_GRAM * max(1, distinct))))
        self.words = max(1, math.ceil(len(langs) / WORD_BITS))
        self.slots = np.zeros((self.words, 1 << self.bits), np.uint64)
        for i, lang in enumerate(langs):
            for place in self._places(grams_of.get(lang, np.zeros(0, np.uint64))):
                self.slots[i // WORD_BITS, place] |= np.uint64(1 << (i % WORD_BITS))
        fill = [np.mean(self._bit(self.slots[i // WORD_BITS], i)) for i in range(len(langs))]
        # A trigram of no language has all its slots' bits set by chance.
        self.false_rate = np.array(fill) ** HASHES

    @staticmethod
    def _bit(masks: np.ndarray, i: int) -> np.ndarray:
        return (masks >> np.uint64(i % WORD_BITS)) & np.uint64(1)

    def _places(self, keys: np.ndarray):
        """The slots of each key: two mixes of it, and their sums."""
        x = (keys ^ (keys >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        step = (x >> np.uint64(32)) | np.uint64(1)
        mask = np.uint64((1 << self.bits) - 1)
        for i in range(HASHES):
            yield ((x + np.uint64(i) * step) & mask).astype(np.int64)

    def languages(self, keys: np.ndarray) -> list[np.ndarray]:
        """Masks of all languages that contain each trigram, one array per 64 languages."""
        masks = None
        for place in self._places(keys):
            found = [slots[place] for slots in self.slots]
            masks = found if masks is None else [m & f for m, f in zip(masks, found)]
        return masks

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        preds, scores = [], []
        filled = [t or "" for t in texts]
        for a, b in _steps(filled):
            p, s = self._predict(filled[a:b])
            preds += p
            scores += s
        return preds, scores

    def _predict(self, texts):
        keys, owner, letters = trigrams(texts)
        total = np.bincount(owner, minlength=len(texts))
        if not self.langs:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        masks = self.languages(keys)
        votes = np.stack([np.bincount(owner, self._bit(masks[i // WORD_BITS], i), minlength=len(texts)) for i in range(len(self.langs))])
        rate = self.false_rate[:, None]
        votes = np.maximum(votes - total[None, :] * rate, 0) / (1 - np.minimum(rate, 0.999))
        best = votes.argmax(axis=0)  # the first of the largest: languages are in order of their training texts
        sums = votes.sum(axis=0)
        score = np.where(sums > 0, votes.max(axis=0) / np.where(sums > 0, sums, 1), 0.0)
        preds = [self.langs[i] if ok else UNKNOWN for i, ok in zip(best.tolist(), letters.tolist())]
        return preds, np.where(letters, score, 0.0).tolist()


def fit(docs: DataFrame, folds: int = 3, held: int = 1) -> LanguageFilter:
    """Learn from all rows outside the held fold that name a language.

    The driver gets the languages and their trigrams: at most 1 / MIN_SHARE for each.
    """
    training = docs.where(F.col("lang").isNotNull() & (fold("doc_id", folds) != held)).select("lang", "text")
    sizes = training.groupBy(F.col("lang").cast("string").alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()
    langs = [r["lang"] for r in sorted(sizes, key=lambda r: (-r["n"], r["lang"]))]
    found = at_home(gram_counts(training)).toArrow()
    grams = pd.Series(found["gram"].to_numpy()).groupby(np.array(found["lang"].to_pylist(), object)) if len(found) else {}
    return LanguageFilter(langs, {lang: own.to_numpy().view(np.uint64) for lang, own in grams})


# --- prediction -----------------------------------------------------------------------------


def predicted(docs: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, folds, held))

    def make():
        own = model.value

        def step(batch):
            langs, scores = own.predict(batch.column("text").to_pylist())
            return {"doc_id": batch.column("doc_id"), "lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64())}

        return step

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = arrow_rows(columns, "doc_id long, lang_pred string, score double", make)
    return found.select("doc_id", _held(folds, held).alias("held_out"), "lang_pred", "score")


def _held(folds: int, held: int) -> Column:
    return fold("doc_id", folds) == held
