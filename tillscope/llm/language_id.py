"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  An n-gram of letters is bound
into one vector by multiplying its letters' vectors, each rotated by its place;
a text's vector is the sum of its n-grams' vectors, and a language's prototype
is the sum over its training texts.  A text gets the language whose prototype
has the largest cosine with its vector.

Sums are of integers, so a model does not depend on the order of the rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.llm.common import pick
from tillscope.llm.worker import kept

#: Dimensions of a vector, letters of an n-gram, seed of the letters' vectors.
DIMENSIONS = 512
NGRAM = 3
SEED = 20_240
#: Characters worked on at once; longer texts are taken in parts of this size.
BLOCK = 200_000
#: Texts worked on together: with a block of n-grams, this bounds the table of their counts.
MOST_TEXTS = 64
#: n-gram vectors that a worker keeps.
KEPT_NGRAMS = 40_000
GAP = 32
UNKNOWN = "und"

def _codes() -> np.ndarray:
    """For each code point: itself if it is a letter, else the gap."""
    own = kept("language")
    if "codes" not in own:
        own["codes"] = np.array([c if chr(c).isalpha() else GAP for c in range(0x110000)], dtype=np.int32)
    return own["codes"]


def letters(text: str) -> np.ndarray:
    """Lower-case letters of the text with one gap for each run of other characters, and at both ends."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    codes = np.concatenate([[GAP], _codes()[points], [GAP]]).astype(np.int64)
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = (codes[1:] != GAP) | (codes[:-1] != GAP)
    codes = codes[keep]
    return codes if len(codes) > 1 else codes[:0]


def ngrams(codes: np.ndarray) -> np.ndarray:
    """Each run of ``NGRAM`` codes as one integer."""
    if len(codes) < NGRAM:
        return np.zeros(0, np.int64)
    out = np.zeros(len(codes) - NGRAM + 1, np.int64)
    for k in range(NGRAM):
        out = (out << 21) | codes[k:len(codes) - NGRAM + 1 + k]
    return out


class Vectors:
    """Vectors of n-grams; letters' vectors follow from their code points."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        self.dimensions, self.seed = dimensions, seed
        self._letters: dict[int, np.ndarray] = {}
        self._known = np.zeros(0, np.int64)
        self._rows = np.zeros((0, dimensions), np.int8)

    def letter(self, code: int) -> np.ndarray:
        if code not in self._letters:
            if len(self._letters) > 20_000:
                self._letters.clear()
            bits = np.random.default_rng([self.seed, code]).integers(0, 2, self.dimensions, dtype=np.int8)
            self._letters[code] = bits * 2 - 1
        return self._letters[code]

    def _bound(self, grams: np.ndarray) -> np.ndarray:
        out = np.ones((len(grams), self.dimensions), np.int8)
        for place in range(NGRAM):
            codes, where = np.unique((grams >> (21 * place)) & 0x1FFFFF, return_inverse=True)
            out *= np.stack([np.roll(self.letter(int(c)), place) for c in codes])[where]
        return out

    def of(self, grams: np.ndarray) -> np.ndarray:
        """Vectors of sorted, distinct n-grams."""
        new = np.setdiff1d(grams, self._known, assume_unique=True)
        if len(new):
            if len(self._known) + len(new) > KEPT_NGRAMS:
                if len(grams) > KEPT_NGRAMS:
                    return self._bound(grams)
                self._known, self._rows, new = np.zeros(0, np.int64), self._rows[:0], grams
            known, rows = np.concatenate([self._known, new]), np.concatenate([self._rows, self._bound(new)])
            order = np.argsort(known)
            self._known, self._rows = known[order], rows[order]
        return self._rows[np.searchsorted(self._known, grams)]

    def weighted_sum(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Sum of the n-grams' vectors times their counts, exact in 64-bit integers."""
        out = np.zeros(self.dimensions, np.int64)
        for at in range(0, len(grams), 4096):
            part = self.of(grams[at:at + 4096]).astype(np.float64)
            out += np.rint(counts[at:at + 4096].astype(np.float64) @ part).astype(np.int64)
        return out


def _worker_vectors(dimensions: int, seed: int) -> Vectors:
    own = kept("language")
    if (dimensions, seed) not in own:
        own[dimensions, seed] = Vectors(dimensions, seed)
    return own[dimensions, seed]


def text_ngrams(text: str) -> Iterator[np.ndarray]:
    """The n-grams of ``letters(text)``, in parts: each part goes on with the last codes of the one before."""
    lower, before = text.lower(), np.array([GAP])
    for at in range(0, max(len(lower), 1), BLOCK):
        points = np.frombuffer(lower[at:at + BLOCK].encode("utf-32-le", "surrogatepass"), "<u4")
        after = [GAP] if at + BLOCK >= len(lower) else []
        codes = np.concatenate([before, _codes()[points], after]).astype(np.int64)
        codes = codes[np.concatenate([[True], (codes[1:] != GAP) | (codes[:-1] != GAP)])]
        yield ngrams(codes)
        before = codes[1 - NGRAM:]


def text_vectors(texts: list[str], vectors: Vectors) -> np.ndarray:
    """Vectors of the texts (zero for a text without letters)."""
    out = np.zeros((len(texts), vectors.dimensions), np.float64)
    group, rows, size = [], [], 0

    def flush():
        nonlocal group, rows, size
        if group:
            grams, where = np.unique(np.concatenate(group), return_inverse=True)
            doc = np.repeat(np.arange(len(group)), [len(g) for g in group])
            counts = np.bincount(doc * len(grams) + where, minlength=len(group) * len(grams))
            np.add.at(out, rows, counts.reshape(len(group), -1).astype(np.float32) @ vectors.of(grams).astype(np.float32))
        group, rows, size = [], [], 0

    for n, text in enumerate(texts):
        for grams in text_ngrams(text):
            if len(grams):
                group.append(grams)
                rows.append(n)
                size += len(grams)
            if size >= BLOCK or len(group) >= MOST_TEXTS:
                flush()
    flush()
    return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          dimensions: int = DIMENSIONS, seed: int = SEED) -> dict[str, np.ndarray]:
    """Prototypes by language, learned from the rows with text and a non-null language.

    Each task sums its texts by language; the sums meet in an aggregation on
    (language, dimension).  Only the prototypes reach the driver: one vector
    per language value.
    """
    rows = pick(docs, text=text_col, lang=lang_col).select(
        F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where("text is not null and lang is not null")

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, total = _worker_vectors(dimensions, seed), {}
        for batch in batches:
            held: dict[str, list] = {}
            for text, lang in zip(batch.column("text"), batch.column("lang").to_pylist()):
                for grams in text_ngrams(text.as_py()):
                    own = held.setdefault(lang, [])
                    own.append(grams)
                    if sum(map(len, own[-64:])) > 4 * BLOCK or len(own) >= 64:
                        _add(total, lang, held.pop(lang), vectors)
            for lang, own in held.items():
                _add(total, lang, own, vectors)
        for lang, vector in total.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang] * dimensions, "k": np.arange(dimensions), "v": vector})

    summed = rows.mapInArrow(sums, "lang string, k long, v long").groupBy("lang", "k").agg(F.sum("v").alias("v"))
    by_lang = summed.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("k", "v"))).alias("kv"))
    found = {r["lang"]: np.array([x["v"] for x in r["kv"]], np.float64) for r in by_lang.collect()}
    return {lang: v / np.linalg.norm(v) for lang, v in sorted(found.items()) if v.any()}


def _add(total: dict, lang: str, grams: list[np.ndarray], vectors: Vectors) -> None:
    distinct, counts = np.unique(np.concatenate(grams), return_counts=True)
    if len(distinct):
        own = vectors.weighted_sum(distinct, counts)
        total[lang] = total[lang] + own if lang in total else own


def language_of(text: Column, prototypes: dict[str, np.ndarray], dimensions: int = DIMENSIONS,
                seed: int = SEED) -> Column:
    """``struct(lang_pred, score)`` of a text column, by the rules of ``predict``."""
    names = np.array([*prototypes, UNKNOWN], dtype=object)
    matrix = np.stack([*prototypes.values()]) if prototypes else np.zeros((0, dimensions))

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        vectors = _worker_vectors(dimensions, seed)
        for part in parts:
            own = text_vectors([t if isinstance(t, str) else "" for t in part], vectors)
            norm = np.linalg.norm(own, axis=1)
            best, score = np.full(len(own), len(matrix)), np.zeros(len(own))
            if len(matrix) and len(own):
                cosine = (own @ matrix.T) / np.where(norm > 0, norm, 1)[:, None]
                best = np.where(norm > 0, cosine.argmax(axis=1), len(matrix))
                score = np.where(norm > 0, cosine.max(axis=1).clip(0, 1), 0.0)
            yield pd.DataFrame({"lang_pred": names[best], "score": score})

    return F.pandas_udf(run, "lang_pred string, score double")(text)


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text",
            dimensions: int = DIMENSIONS, seed: int = SEED) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row, from its whole text alone.

    ``score`` is the cosine with the winning prototype, at least 0 and at most 1.

    * a null text, one without a letter, or a model without languages gives
      ``und`` and score 0;
    * equal cosines go to the language first in alphabetical order;
    * null and repeated ids are carried as they are, one row out per row in;
    * texts of any length are taken whole, in parts that lose no n-gram;
    * an empty table gives an empty result; other columns are ignored.
    """
    rows = pick(docs, doc_id=id_col, text=text_col).select("doc_id", F.col("text").cast("string").alias("text"))
    found = rows.select("doc_id", language_of(F.col("text"), prototypes, dimensions, seed).alias("found"))
    return found.select("doc_id", "found.lang_pred", "found.score")


def held_out(id_col: str = "doc_id") -> Column:
    """True for the fifth of the ids that is never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))
