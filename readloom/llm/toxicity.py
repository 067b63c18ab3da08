"""Toxicity by two Kneser-Ney models of letters within words, one of toxic texts and one of ordinary ones.

An expression is a word (a run of letters, lower case, with a mark at both ends). Both models predict each letter from
up to five before it, with counts of its own class, and back off in the end to the same counts, those of both classes
taken together: where neither class knows an expression it is alike in both and cancels out. All counts but those of the
longest grams, and of grams at the start of a word, are Kneser-Ney's: how many letters a gram follows. As only the ratio
of the two likelihoods counts, the model that is shipped has one number for each gram, the logarithm of the ratio, and
one for each context, what the ratio changes by when it backs off. A text's evidence is the difference of its two
log-likelihoods divided by its number of words; a logistic regression on other labelled texts turns evidence and number
of distinct words into a score.

The counts are Spark aggregates over the drawn labelled texts; the driver gets the grams of at most about ``CHARS``
characters a class. Both classes are drawn to the same size: the larger one would know more rare words, and every
rare word would look ordinary.

Defined cases: null and empty texts have no evidence and get the score of an ordinary text without words; very long
texts are read whole; texts without letters score as empty ones; repeated rows and equal texts score alike; a doc_id
that is labelled both ways counts as toxic; a null doc_id is never learned from and not held out; with labels of one
class only or none every score is the share of toxic labels (0 without labels); extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import prepare

#: Letters of a gram.
ORDER = 6
#: Taken off each count; what it takes off is the mass that backs off.
DISCOUNT = 0.75
#: Labelled texts drawn from a class (about): characters to count grams in, texts to fit the regression on.
CHARS = 8_000_000
TEXTS = 6000
REMEMBERED = 300_000
WORD = re.compile(r"[^\W\d_]+")
START, END = "^", "$"


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are never learned from: crc32 of the decimal doc_id leaves 0 modulo 5."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


@dataclass
class Model:
    """ratios: log P(letter | context, toxic) - log P(letter | context, ordinary) of the grams that occur; backoffs: the
    same of the mass that each context leaves to shorter ones."""

    ratios: dict[str, float]
    backoffs: dict[str, float]
    prior: float
    weights: tuple[float, ...] | None = None
    _known: dict[str, float] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_known": {}}

    def word(self, word: str) -> float:
        """log P(word | toxic) - log P(word | ordinary)."""
        s, out = f"{START}{word}{END}", 0.0
        ratios, backoffs = self.ratios, self.backoffs
        for i in range(2, len(s) + 1):
            for begin in range(max(0, i - ORDER), i - 1):
                value = ratios.get(s[begin:i])
                if value is not None:
                    out += value
                    break
                out += backoffs.get(s[begin : i - 1], 0.0)
        return out

    def evidence(self, text: str | None) -> tuple[float, int]:
        """Log-likelihood ratio a word, and number of distinct words."""
        counts = Counter(WORD.findall((text or "").lower()))
        total = 0.0
        for word, n in counts.items():
            value = self._known.get(word)
            if value is None:
                value = self.word(word)
                if len(self._known) >= REMEMBERED:
                    self._known.clear()
                if len(word) < 64:
                    self._known[word] = value
            total += n * value
        return (total / counts.total() if counts else 0.0), len(counts)

    def score(self, ratio: float, words: int) -> float:
        if self.weights is None:
            return self.prior
        z = float(np.dot(features(np.array([ratio]), np.array([words]))[0], self.weights))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def features(ratio: np.ndarray, words: np.ndarray) -> np.ndarray:
    size = np.log1p(words)
    return np.stack([np.ones(len(ratio)), ratio, size, ratio * size], 1)


def regression(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 40) -> tuple[float, ...]:
    """Weighted logistic regression by Newton's method, lightly held to 0."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(curve, x.T @ (weight * (y - p)) - 1e-2 * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def labelled_sizes(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, toxic, size (characters) of the labelled rows that may be learned from."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    return docs.select("doc_id", F.length("text").alias("size")).filter("size > 0").join(known, "doc_id")


def draw(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, float], dict[int, int]]:
    """text, toxic, fitted (false: for the regression) of about CHARS characters and at most about TEXTS texts a class,
    drawn by hash of doc_id; the drawn share and the rows of each class."""
    sizes = labelled_sizes(docs, labels)
    totals = {r[0]: (r[1], r[2]) for r in sizes.groupBy("toxic").agg(F.count(F.lit(1)), F.sum("size")).collect()}  # two rows
    most = min([CHARS, *[chars for _, chars in totals.values()]])  # both classes are drawn to the smaller one's size
    share = {c: min(1.0, TEXTS / n, most / chars) for c, (n, chars) in totals.items()}
    scale = 1 << 30
    limit = F.lit(0)
    for c, s in share.items():
        limit = F.when(F.col("toxic") == c, int(s * scale)).otherwise(limit)
    drawn = sizes.filter(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(scale)) < limit).select("doc_id", "toxic").distinct()
    # Two times TEXTS ids at most (about): small enough to go to every task, so no text is exchanged.
    picked = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    return picked.select("text", "toxic", (F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(4)) > 0).alias("fitted")), share, {c: n for c, (n, _) in totals.items()}


def words_of(texts: DataFrame) -> DataFrame:
    """toxic, word, n over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = (Counter(), Counter())
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found[toxic].update(WORD.findall(text.lower()))
            for toxic, counts in enumerate(found):
                yield pa.RecordBatch.from_arrays([pa.array([toxic] * len(counts), pa.int32()), pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["toxic", "word", "n"])

    return texts.select("text", "toxic").mapInArrow(run, "toxic int, word string, n bigint").groupBy("toxic", "word").agg(F.sum("n").alias("n"))


def gram_counts(words: DataFrame) -> DataFrame:
    """gram, toxic, ordinary, shared: Kneser-Ney counts of the grams of both classes and of both together.

    A gram of full length, or at the start of a word, counts as often as it occurs; any other as often as there are
    letters before it.
    """
    marked = words.select("toxic", "n", F.concat(F.lit(START), "word", F.lit(END)).alias("s"))
    ends = marked.select("toxic", "n", "s", F.explode(F.sequence(F.lit(2), F.length("s"))).alias("i"))
    grams = ends.select("toxic", "n", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.col("i"), F.lit(ORDER))), lambda k: F.substring(F.col("s"), F.col("i") - k + 1, k))).alias("gram"))
    toxic = F.col("toxic") == 1
    raw = grams.groupBy("gram").agg(F.sum(F.when(toxic, F.col("n")).otherwise(0)).alias("toxic"), F.sum(F.when(toxic, 0).otherwise(F.col("n"))).alias("ordinary")).withColumn("shared", F.col("toxic") + F.col("ordinary"))
    whole = (F.length("gram") == ORDER) | F.col("gram").startswith(START)
    kept = raw.filter(whole)
    behind = raw.filter(F.length("gram") > 1).select(F.expr("substring(gram, 2)").alias("gram"), *[(F.col(c) > 0).cast("bigint").alias(c) for c in ("toxic", "ordinary", "shared")])
    return kept.unionByName(behind.groupBy("gram").agg(*[F.sum(c).alias(c) for c in ("toxic", "ordinary", "shared")]))


def assemble(rows: list[tuple[str, int, int, int]], prior: float, discount: float = DISCOUNT) -> Model:
    """The model of gram counts. What the discount takes from the grams of a context is the mass that backs off."""
    totals, probability = {}, {}
    for gram, toxic, ordinary, _ in rows:
        if len(gram) > 1:
            entry = totals.setdefault(gram[:-1], [0.0] * 4)
            for c, n in enumerate((toxic, ordinary)):
                entry[2 * c] += n
                entry[2 * c + 1] += min(n, discount)
    left = {h: tuple(t[2 * c + 1] / t[2 * c] if t[2 * c] else 1.0 for c in (0, 1)) for h, t in totals.items()}
    bottom = sum(r[3] for r in rows if len(r[0]) == 1)
    for gram, toxic, ordinary, shared in sorted(rows, key=lambda r: len(r[0])):
        if len(gram) == 1:
            probability[gram] = (shared / bottom,) * 2
            continue
        below, total, mass = probability[gram[1:]], totals[gram[:-1]], left[gram[:-1]]
        probability[gram] = tuple((max(0.0, n - discount) / total[2 * c] if total[2 * c] else 0.0) + mass[c] * below[c] for c, n in enumerate((toxic, ordinary)))
    return Model({g: math.log(t / o) for g, (t, o) in probability.items() if len(g) > 1}, {h: math.log(t / o) for h, (t, o) in left.items()}, prior)


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    prepare(docs.sparkSession)
    texts, share, rows = draw(docs, labels)
    prior = rows.get(1, 0) / max(1, sum(rows.values()))
    if len(rows) < 2:
        return Model({}, {}, prior)
    counts = gram_counts(words_of(texts.filter("fitted"))).toPandas()  # bounded by CHARS
    model = assemble(sorted(counts.itertuples(index=False, name=None)), prior)
    seen = evidence(texts.filter("not fitted").select(F.col("toxic").alias("key"), "text"), model).toPandas().sort_values(["key", "ratio", "words"])
    if seen["key"].nunique() == 2:
        weight = seen["key"].map({c: 1 / s for c, s in share.items()}).to_numpy()
        x = features(seen["ratio"].to_numpy(), seen["words"].to_numpy())
        model.weights = regression(x, seen["key"].to_numpy().astype(float), weight / weight.mean())
    return model


def evidence(keyed: DataFrame, model: Model) -> DataFrame:
    """key, ratio, words, score of the rows of key and text."""
    shipped = keyed.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shipped.value
        for batch in batches:
            found = [known.evidence(t) for t in batch.column(1).to_pylist()]
            ratio, words = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ratio, pa.float64()), pa.array(words, pa.int64()), pa.array([known.score(*f) for f in found], pa.float64())], ["key", "ratio", "words", "score"])

    return keyed.mapInArrow(run, f"key {keyed.dtypes[0][1]}, ratio double, words bigint, score double")


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    prepare(docs.sparkSession)
    found = evidence(docs.select(F.col("doc_id").cast("long").alias("key"), "text"), model)
    out = F.coalesce(held_out("key"), F.lit(False))
    return found.select(F.col("key").alias("doc_id"), out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.col("ratio").alias("evidence"), F.col("words").alias("n_distinct_words"))


def learn_and_score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_documents(docs, learn(docs, labels))
