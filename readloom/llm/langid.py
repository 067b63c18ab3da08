"""Language identification by nearest centroids.

A text is a normalised TF-IDF vector of hashed byte 1- to 4-grams of its lower-case letters. Each language has several
centroids, found by spherical k-means over a bounded sample of labelled texts; a text gets the language of the centroid
with the greatest cosine. Each centroid knows how far its own training texts lie from it: a text beyond the distance of
nearly all of them is marked as rejected (its nearest language is still named).

Defined cases: null texts and texts without a letter are ``und`` with score 0; very long texts are counted whole; ties
go to the first language in code-point order; without any labelled text every text is ``und``; equal texts get equal
predictions; a null doc_id is never learned from and not held out; lang, source and doc_id are no inputs of a
prediction; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import prepare

#: Dimensions of a vector, and labelled texts per language that a model is fitted on (about; drawn by hash of doc_id).
DIMENSIONS = 1 << 13
SAMPLE = 600
CENTROIDS = 4
GRAMS = (1, 2, 3, 4)
LETTER = regex.compile(r"\p{L}")
#: ASCII but a-z becomes a space; longer UTF-8 sequences stay.
FOLD = bytes(c if c >= 0x80 or 97 <= c <= 122 else 32 for c in range(256))


def counts(text: str) -> np.ndarray:
    """Hashed n-gram counts; runs of other characters than letters count as one space."""
    data = b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(FOLD).split()) + b" "
    x = np.frombuffer(data, np.uint8)
    out = np.zeros(DIMENSIONS, np.float32)
    code = np.zeros(len(x), np.uint32)
    for n in range(1, max(GRAMS) + 1):
        code = (code[: len(x) - n + 1] << np.uint32(8)) | x[n - 1 :]
        if n in GRAMS and len(code):
            h = (code * np.uint32(2654435761) ^ (code >> np.uint32(15)) * np.uint32(2246822519)) + np.uint32(n)
            out += np.bincount(h >> np.uint32(32 - DIMENSIONS.bit_length() + 1), minlength=DIMENSIONS)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


@dataclass
class Model:
    languages: list[str]
    owner: np.ndarray
    centroids: np.ndarray
    idf: np.ndarray
    reach: np.ndarray

    def vector(self, text: str) -> np.ndarray:
        return unit(np.log1p(counts(text)) * self.idf)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score (how much nearer than the next language, from 0 to 1), rejected."""
        if not text or not self.languages or not LETTER.search(text):
            return "und", 0.0, True
        cosine = self.centroids @ self.vector(text)
        best = np.array([cosine[self.owner == i].max() for i in range(len(self.languages))])
        first = int(best.argmax())
        weights = np.exp(20 * (best - best[first]))
        near = int(np.where(self.owner == first, cosine, -2).argmax())
        return self.languages[first], float(min(1.0, max(0.0, 1 / weights.sum()))), bool(cosine[near] < self.reach[near])


def fit(samples: list[tuple[str, np.ndarray]], centroids: int = CENTROIDS, rounds: int = 25) -> Model:
    """samples: (language, n-gram counts). Deterministic: samples are sorted, seeds are far from one another."""
    languages = sorted({x[0] for x in samples})
    if not samples:
        empty = np.zeros((0, DIMENSIONS), np.float32)
        return Model([], np.zeros(0, int), empty, np.ones(DIMENSIONS, np.float32), np.zeros(0))
    raw = np.stack([x[1] for x in samples])
    idf = np.log((1 + len(raw)) / (1 + (raw > 0).sum(0))).astype(np.float32) + 1
    x = unit(np.log1p(raw) * idf)
    owner, found, reach = [], [], []
    for i, language in enumerate(languages):
        own = x[[j for j, s in enumerate(samples) if s[0] == language]]
        seeds = [unit(own.mean(0))]
        while len(seeds) < min(centroids, len(own)):
            seeds.append(own[(own @ np.stack(seeds).T).max(1).argmin()])
        c = np.stack(seeds)
        for _ in range(rounds):
            near = (own @ c.T).argmax(1)
            now = np.stack([unit(own[near == k].mean(0)) if (near == k).any() else c[k] for k in range(len(c))])
            if np.allclose(now, c):
                break
            c = now
        cosine = own @ c.T
        near = cosine.argmax(1)
        for k in range(len(c)):
            if (near == k).any():
                owner.append(i)
                found.append(c[k])
                reach.append(float(np.quantile(cosine[near == k, k], 0.01)) * 0.8)
    return Model(languages, np.array(owner), np.stack(found).astype(np.float32), idf, np.array(reach))


def held_out() -> Column:
    """Rows that a model never learns from: crc32 of the decimal doc_id leaves 2 modulo 4."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def training_sample(docs: DataFrame, per_language: int = SAMPLE) -> list[tuple[str, np.ndarray]]:
    """n-gram counts of about per_language labelled texts of each language, drawn by the hash of doc_id."""
    prepare(docs.sparkSession)
    labelled = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    sizes = {r[0]: r[1] for r in labelled.groupBy("lang").count().collect()}  # one row per language
    if not sizes:
        return []
    scale = 1 << 30
    share = F.element_at(F.create_map(*[F.lit(x) for k in sorted(sizes) for x in (k, min(scale, round(scale * per_language / sizes[k])))]), F.col("lang"))
    drawn = labelled.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(scale)) < share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, keys, indexes, values = [], [], [], []
            for doc_id, text, lang in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "text", "lang")), strict=True):
                if not LETTER.search(text):
                    continue
                c = counts(text)
                at = np.flatnonzero(c)
                langs.append(lang)
                keys.append(doc_id)
                indexes.append(at.astype(np.int16).tobytes())
                values.append(c[at].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(keys, pa.int64()), pa.array(indexes, pa.binary()), pa.array(values, pa.binary())], ["lang", "doc_id", "at", "n"])

    rows = drawn.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").mapInArrow(run, "lang string, doc_id bigint, at binary, n binary").collect()
    out = []
    for lang, _, at, n in sorted(rows, key=lambda r: (r[0], r[1], bytes(r[2]), bytes(r[3]))):
        c = np.zeros(DIMENSIONS, np.float32)
        c[np.frombuffer(at, np.int16).astype(int)] = np.frombuffer(n, np.float32)
        out.append((lang, c))
    return out


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every document."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t) for t in batch.column(2).to_pylist()]
            langs, scores, rejected = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    return ready.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double, rejected boolean")


def learn_and_identify(docs: DataFrame, per_language: int = SAMPLE) -> DataFrame:
    return identify(docs, fit(training_sample(docs, per_language)))
