"""Quality rules under weak supervision: rules vote or abstain, and a label model weighs them.

Each rule looks at one figure of a text and votes good (1), bad (0) or abstains (None). The votes of all documents are
counted by pattern (a bounded number: 3 ** number of rules), expectation-maximisation over these counts estimates how
often each rule votes what on good and on bad documents, and the posterior probability of "good" decides.

Defined cases: a null or empty text has no words and fails the base rules; very long texts are measured whole; an
empty table gives an empty result; equal texts get equal verdicts; rows may repeat; ``filter_quality`` keeps all columns,
which travel as one nested value, so they may have any names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from .runtime import Scratch, prepare

#: Counted as symbols.
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_caps_words", "n_digits", "n_marked_words")
#: With which words of running text end, letters and digits aside.
USUAL = b".,;:!?\"')]}"


def measure(text: bytes | None) -> tuple[int, ...]:
    """The figures named in COUNTS for one text (UTF-8)."""
    if not text:
        return (0,) * len(COUNTS)
    words = text.split()  # bytes.split() splits at ASCII white space only
    if not words:
        return (0,) * len(COUNTS)
    points = len(text) - len(text.translate(None, bytes(set(range(256)) - set(range(0x80, 0xC0)))))
    spaces = len(text) - len(text.translate(None, SPACES))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [line for line in text.split(b"\n") if line.strip()]
    caps = sum(map(bytes.isupper, words))
    digits = len(text) - len(text.translate(None, b"0123456789"))
    marked = sum(w[-1] < 0x80 and not w[-1:].isalnum() and w[-1] not in USUAL for w in words)
    return (len(words), points - spaces, symbols, len(lines) - len(set(lines)), _repeated(words), len(lines), caps, digits, marked)


def _repeated(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found at least twice in the text."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    often = Counter(windows)
    covered, end = 0, 0
    for i, window in enumerate(windows):
        if often[window] > 1:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


@dataclass(frozen=True)
class Rule:
    """Votes bad from ``bad`` on, good up to ``good``, and abstains between, on one figure (lower is better).

    A detector of one kind of junk has no ``good``: that it finds nothing is no vote for a text.
    """

    name: str
    figure: Callable[[dict[str, int]], float]
    good: float | None
    bad: float

    def vote(self, x: dict[str, int]) -> int | None:
        v = self.figure(x)
        return 0 if v >= self.bad else 1 if self.good is not None and v <= self.good else None


def _share(a: str, b: str) -> Callable[[dict[str, int]], float]:
    return lambda x: x[a] / max(1, x[b])


#: The default rules: detectors of one kind of junk each, then rules on what running text looks like.
RULES = (
    Rule("symbols", _share("n_symbols", "n_words"), None, 0.15),
    Rule("duplicate_lines", _share("n_dup_lines", "n_lines"), None, 0.4),
    Rule("capitals", _share("n_caps_words", "n_words"), None, 0.4),
    Rule("digits", _share("n_digits", "word_chars"), None, 0.3),
    Rule("repeated_words", _share("n_repeat_words", "n_words"), 0.1, 0.35),
    Rule("marked_words", _share("n_marked_words", "n_words"), 0.05, 0.3),
    Rule("word_length", lambda x: abs(math.log(max(1, x["word_chars"]) / max(1, x["n_words"]) / 5.5)), 0.5, 1.0),
)


def pattern(rules: tuple[Rule, ...], counts: tuple[int, ...]) -> str:
    x = dict(zip(COUNTS, counts, strict=True))
    return "".join("-" if (v := r.vote(x)) is None else str(v) for r in rules)


#: A pattern's letters: votes bad, votes good, abstains.
VOTES = "01-"


@dataclass(frozen=True)
class LabelModel:
    """Class prior and, for each rule and class, the chances of voting bad, good or abstaining."""

    prior: float
    chances: tuple[tuple[tuple[float, float, float], tuple[float, float, float]], ...]

    def posterior(self, votes: str) -> float:
        odds = math.log(self.prior) - math.log(1 - self.prior)
        for v, (bad, good) in zip(votes, self.chances, strict=True):
            i = VOTES.index(v)
            odds += math.log(good[i] / bad[i])
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))

    def accuracies(self) -> list[tuple[float, float]]:
        """Of each rule: the chance of voting bad on bad and good on good, when it votes."""
        return [(bad[0] / (bad[0] + bad[1]), good[1] / (good[0] + good[1])) for bad, good in self.chances]


#: Where estimation starts: the chances of a vote for bad, for good and of none, on bad and on good documents.
START = ((0.5, 0.2, 0.3), (0.02, 0.58, 0.4))


def fit(patterns: dict[str, int], n_rules: int, prior: float = 0.85, strength: float = 0.02, most: int = 200, tolerance: float = 1e-9) -> LabelModel:
    """Expectation-maximisation over counted vote patterns.

    Pseudo-counts worth ``strength`` of all rows hold the chances near START, so that a corpus of one kind only can't
    turn a rule's meaning round. The sums run in the order of the patterns: reruns agree.
    """
    keys = sorted(patterns)
    total = sum(patterns.values())
    table = np.tile(np.array(START), (n_rules, 1, 1))
    p, before = prior, -np.inf
    if total:
        n = np.array([patterns[k] for k in keys], float)
        hot = np.stack([np.array([[c == v for c in k] for k in keys]) for v in VOTES], -1).astype(float)
        hold = max(1.0, strength * total)
        for _ in range(most):
            scores = np.einsum("prv,rcv->pc", hot, np.log(table)) + np.log([1 - p, p])
            like = np.logaddexp(scores[:, 0], scores[:, 1])
            good = np.exp(scores[:, 1] - like)
            weight = np.stack([n * (1 - good), n * good], 1)
            table = np.einsum("pc,prv->rcv", weight, hot) + hold * np.array(START)
            table /= table.sum(-1, keepdims=True)
            p = float(np.clip((weight[:, 1].sum() + hold * prior) / (total + hold), 0.01, 0.99))
            now = float((n * like).sum())
            if abs(now - before) <= tolerance * max(1.0, abs(now)):
                break
            before = now
    return LabelModel(p, tuple((tuple(map(float, t[0])), tuple(map(float, t[1]))) for t in table))


def with_figures(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """row (the columns of docs, or those to keep, nested), the figures and the vote pattern of each row."""
    prepare(docs.sparkSession)
    row = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)])
    ready = docs.select(row.alias("row"), F.col(text).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            figures = [measure(t) for t in batch.column(1).to_pylist()]
            counts = [pa.array([x[i] for x in figures], pa.int64()) for i in range(len(COUNTS))]
            votes = pa.array([pattern(rules, x) for x in figures], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, votes], ["row", *COUNTS, "votes"])

    schema = StructType([ready.schema["row"]])
    for name in COUNTS:
        schema = schema.add(name, LongType())
    return ready.mapInArrow(run, schema.add("votes", StringType()))


def judge(figures: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5, min_words: int = 50, max_repeat_percent: int = 50) -> tuple[DataFrame, LabelModel]:
    """Fit the label model on all rows of a figures table; add posterior, base_failed and kept."""
    counts = {r[0]: r[1] for r in figures.groupBy("votes").count().collect()}  # at most 3 ** rules rows
    model = fit(counts, len(rules))
    values = sorted((k, model.posterior(k)) for k in counts)
    if values:
        table = figures.sparkSession.createDataFrame(values, "votes string, posterior double")
        figures = figures.join(F.broadcast(table), "votes", "left")
    else:
        figures = figures.withColumn("posterior", F.lit(0.0))
    words, repeated = F.col("n_words"), F.col("n_repeat_words")
    failed = (words < min_words) | (repeated * 100 > words * max_repeat_percent)
    out = figures.withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold)), model


def assess_quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """doc_id, the figures, base_failed, posterior and kept of every document."""
    figures = Scratch.table(with_figures(docs, rules, keep=["doc_id"]), "quality")
    out, _ = judge(figures, rules, threshold)
    return out.select("row.doc_id", *COUNTS, "base_failed", "posterior", "kept")


def filter_quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """The documents that the rules keep, with the columns of docs."""
    out, _ = judge(Scratch.table(with_figures(docs, rules), "quality-docs"), rules, threshold)
    return out.filter("kept").select("row.*")
