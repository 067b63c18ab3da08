"""Secret scans with a random forest that removes false positives (DataFrame functions and the JVM's forest only).

A candidate is a run of 16 or more letters, digits and ``+ / _ ~ -`` inside a word, with any dotted parts of eight or
more that follow (as in signed tokens); beside or behind a word that points to a secret also a run of eight or more of
these and ``! @ # $ % ^ & * ?`` (less than 16 letters that hold such a word are a name, no value). Its features are its
length, the transitions between classes of its characters, how much of it words of the dictionary cover, path marks
around it and the neighbouring words. A random forest, trained on labelled findings, says how probable a secret is.

The dictionary holds every word of 4 to 20 letters (accents off) that makes up at least WORD_SHARE of all words of the
corpus and occurs LEAST_COUNT times, so it has at most 1 / WORD_SHARE words whatever the corpus; coverage counts the
letters of a candidate that lie in any of its substrings that are such words.

Labelled findings are any table with the columns of ``findings`` and ``label``. ``silver_labels`` makes one from marks
that are no features: the bits per character under a model of the letter pairs of the dictionary, headers of signed
tokens that decode, forms of published keys, UUIDs, and words for digests before a value. What these leave open has no
label. Training takes a bounded sample of them, drawn by hash; counts of words and the scan itself cover all documents.

Defined cases: null texts have no findings, nor have texts without long words; very long texts and words are scanned
whole; equal findings in several places are rows of their own; repeated rows give repeated findings; without labelled
findings of both kinds the share of secrets among them (or 0) is everybody's probability; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import Scratch

SPACES = r"[\x20\x09-\x0D]+"
#: A candidate, and one beside a hint; the least length of a word that can hold them.
CANDIDATE = r"[A-Za-z0-9+/_~-]{16,}(?:\.[A-Za-z0-9+/_~-]{8,})*={0,2}"
HINTED = CANDIDATE + r"|[A-Za-z0-9+/_~!@#$%^&*?-]{8,}"
LEAST, LEAST_HINTED = 16, 8
#: Words that point to a secret beside them.
HINTS = r"(?i)(pass(word|wd|phrase)?|secret|token|api[_-]?key|access[_-]?key|auth|credential|bearer|private)"
#: Words whose values are digests and not secrets.
DIGESTS = r"(?i)(sha-?[0-9]+|md5|checksum|digest|commit|revision|etag|integrity)"
#: Dictionary: least share of all words and least count of a word, and its letters.
WORD_SHARE = 1e-5
LEAST_COUNT = 5
SHORTEST, LONGEST = 4, 20
#: Characters of a candidate in one row where its substrings are looked up.
PIECE = 64
#: Accented letters and the plain ones that stand for them.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
#: Bits per character under the word model: words stay below, random values above.
WORDLIKE, RANDOM = 4.5, 6.0
#: Findings of each label in a training sample.
SAMPLE = 4000
FEATURES = (
    "length", "digit_share", "upper_share", "lower_share", "transitions", "case_changes", "distinct_share", "vowel_share",
    "hex_share", "longest_letters", "dictionary_share", "slashes", "path_marks", "hint_before", "hint_inside", "assigned", "quoted", "plain_neighbours",
)


def dictionary(docs: DataFrame, share: float = WORD_SHARE, least: int = LEAST_COUNT) -> DataFrame:
    """w, count: the words that make up at least this share of all words of all texts, 1 / share of them at most."""
    split = F.split(F.lower("text"), r"[^\p{L}]+")
    words = docs.select(F.explode(split).alias("w")).filter("w <> ''").groupBy("w").count()
    with Scratch.scope(keep=1):
        words = Scratch.table(words, "secret-words")
        total = words.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
        plain = words.groupBy(F.translate("w", ACCENTED, PLAIN).alias("w")).agg(F.sum("count").alias("count"))
        wanted = plain.filter((F.col("count") >= max(least, share * total)) & F.col("w").rlike(f"^[a-z]{{{SHORTEST},{LONGEST}}}$"))
        return Scratch.table(wanted, "secret-dictionary")


def coverage(candidates: DataFrame, words: DataFrame) -> DataFrame:
    """candidate, covered: how many letters of each candidate lie in a word of the dictionary (1 at least; others go).

    Substrings are cut from pieces of PIECE characters (each with the letters that a word may go on with).
    """
    each = candidates.select("candidate").distinct().withColumn("key", F.md5("candidate"))
    low = F.lower("candidate")
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length("candidate") - 1) / PIECE).cast("int")), lambda i: F.substring(low, i * PIECE + 1, F.lit(PIECE + LONGEST - 1)))
    cut = each.select("key", F.posexplode(pieces).alias("piece", "s"))
    starts = cut.select("key", "piece", "s", F.explode(F.sequence(F.lit(1), F.least(F.length("s"), F.lit(PIECE)))).alias("at"))
    run = F.regexp_extract(F.substring("s", F.col("at"), F.lit(LONGEST)), "^[a-z]+", 0)
    runs = starts.select("key", (F.col("piece") * PIECE + F.col("at")).alias("at"), run.alias("run")).filter(F.length("run") >= SHORTEST)
    parts = runs.select("key", "at", F.explode(F.transform(F.sequence(F.lit(SHORTEST), F.length("run")), lambda n: F.substring(F.col("run"), F.lit(1), n))).alias("w"))
    # The longest word from a place covers what shorter ones do. The dictionary's size is bounded by 1 / WORD_SHARE.
    hits = parts.join(F.broadcast(words.select("w")), "w").groupBy("key", "at").agg(F.max(F.length("w")).alias("n"))
    covered = hits.select("key", F.explode(F.sequence("at", F.col("at") + F.col("n") - 1)).alias("place")).distinct().groupBy("key").agg(F.count(F.lit(1)).alias("covered"))
    return each.join(covered, "key").select("candidate", "covered")


def _share(column: Column, pattern: str, of: Column) -> Column:
    return F.length(F.regexp_replace(column, pattern, "")) / of


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, word_no, part, candidate, word, before, after."""
    hinted = F.col("hinted")
    at = lambda i: F.coalesce(F.get(F.col("words"), i), F.lit(""))
    before = lambda i: F.concat_ws(" ", at(i - 2), at(i - 1))
    short = lambda w, i: hinted & (F.length(w) >= LEAST_HINTED) & (w.rlike(HINTS) | before(i).rlike(HINTS)) & w.rlike(HINTED)
    long = lambda w: (F.length(w) >= LEAST) & w.rlike(CANDIDATE)
    hit = lambda w, i: F.when(long(w) | short(w, i), F.struct(i.alias("word_no"), w.alias("word"), before(i).alias("before"), at(i + 1).alias("after"), short(w, i).alias("near")))
    split = docs.select("doc_id", F.col("text").rlike(HINTS).alias("hinted"), F.split("text", SPACES).alias("words"))
    found = split.select("doc_id", F.explode(F.filter(F.transform("words", hit), lambda x: x.isNotNull())).alias("h")).select("doc_id", "h.*")
    every = lambda pattern: F.regexp_extract_all("word", F.lit(pattern), F.lit(0))
    found = found.select("*", F.posexplode(F.when(F.col("near"), every(HINTED)).otherwise(every(CANDIDATE))).alias("part", "candidate"))
    # Short letters that hold a hint are the value's name.
    name = F.col("candidate").rlike(HINTS) & F.col("candidate").rlike("^[A-Za-z_-]+$")
    return found.drop("near").filter(~((F.length("candidate") < LEAST) & name))


def findings(docs: DataFrame, words: DataFrame) -> DataFrame:
    """doc_id, word_no, part, candidate, before, inside, after and the features of every candidate. words: column w."""
    found = Scratch.table(candidates(docs), "secret-candidates")
    known = coverage(found, words)
    found = found.join(known, "candidate", "left")
    c, n = F.col("candidate"), F.length("candidate").cast("double")
    lower = F.lower(c)
    # One letter per class, then the number of places where it changes.
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[0-9]", "9"), "[A-Z]", "A"), "[a-z]", "a"), "[^9Aa]", "-")
    inside = F.replace("word", c, F.lit(""))
    longest = F.array_max(F.transform(F.split(c, "[^A-Za-z]+"), lambda x: F.length(x)))
    plain = r"^[A-Za-zÀ-ɏ]+[.,;:!?]*$"
    return found.select(
        "doc_id", "word_no", "part", "candidate", "word", "before", "after",
        n.alias("length"),
        _share(c, "[^0-9]", n).alias("digit_share"),
        _share(c, "[^A-Z]", n).alias("upper_share"),
        _share(c, "[^a-z]", n).alias("lower_share"),
        ((F.length(F.regexp_replace(classes, r"(.)\1*", "x")) - 1) / n).alias("transitions"),
        (F.regexp_count(c, F.lit("[a-z][A-Z]|[A-Z][a-z]")) / n).alias("case_changes"),
        (F.size(F.array_distinct(F.split(c, ""))) / F.least(n, F.lit(36.0))).alias("distinct_share"),
        _share(lower, "[^aeiou]", n).alias("vowel_share"),
        _share(lower, "[^0-9a-f]", n).alias("hex_share"),
        F.coalesce(longest, F.lit(0)).cast("double").alias("longest_letters"),
        (F.coalesce("covered", F.lit(0)) / n).alias("dictionary_share"),
        F.regexp_count("word", F.lit("[/\\\\]")).cast("double").alias("slashes"),
        (F.col("word").rlike(r"(://|^[./~]|\.[A-Za-z]{2,5}($|[/?#]))")).cast("double").alias("path_marks"),
        F.col("before").rlike(HINTS).cast("double").alias("hint_before"),
        inside.rlike(HINTS).cast("double").alias("hint_inside"),
        (inside.rlike("[=:]") | F.col("before").rlike("[=:]$")).cast("double").alias("assigned"),
        inside.rlike("[\"'`]").cast("double").alias("quoted"),
        (F.element_at(F.split("before", " "), -1).rlike(plain).cast("double") + F.col("after").rlike(plain).cast("double")).alias("plain_neighbours"),
    )


def word_model(words: DataFrame) -> list[float]:
    """Bits of each pair of characters (27 by 27: no letter, a to z) in words of the dictionary, with one pair more of each."""
    code = F.transform(F.split(F.concat(F.lit(" "), F.col("w"), F.lit(" ")), ""), lambda x: F.greatest(F.ascii(x) - 96, F.lit(0)))
    pairs = words.select("count", code.alias("k")).select("count", F.explode(F.transform(F.slice("k", F.lit(2), F.size("k") - 1), lambda y, i: F.get(F.col("k"), i) * 27 + y)).alias("pair"))
    counts = {r[0]: r[1] for r in pairs.groupBy("pair").agg(F.sum("count")).collect()}  # 729 rows at most
    totals = [sum(counts.get(a * 27 + b, 0) + 1 for b in range(27)) for a in range(27)]
    return [math.log2(totals[i // 27] / (counts.get(i, 0) + 1)) for i in range(27 * 27)]


def word_bits(column: Column, model: list[float]) -> Column:
    """Mean bits of the pairs of characters of a text, its two ends included."""
    table = F.split(F.lit(",".join(f"{x:.4f}" for x in model)), ",").cast("array<double>")
    letters = F.regexp_replace(F.lower(column), "[^a-z]", "`")  # the character before a
    code = F.transform(F.split(F.concat(F.lit("`"), letters, F.lit("`")), ""), lambda x: F.ascii(x) - 96)
    pairs = F.zip_with(F.slice(code, F.lit(1), F.size(code) - 1), F.slice(code, F.lit(2), F.size(code) - 1), lambda x, y: F.get(table, x * 27 + y))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x) / F.size(pairs)


def silver_labels(found: DataFrame, words: DataFrame) -> DataFrame:
    """found with label: 1 for keys of known form, signed tokens whose header decodes, and random values that are given to
    a name; 0 for what looks like words, numbers, UUIDs and digests; others go. words: ``dictionary``."""
    c = F.col("candidate")
    bits = word_bits(c, word_model(words))
    head = F.translate(F.substring_index(c, ".", 1), "-_", "+/")
    header = F.try_to_binary(F.rpad(head, F.ceil(F.length(head) / 4).cast("int") * 4, "="), F.lit("base64")).cast("string")
    signed = c.contains(".") & F.coalesce(F.get_json_object(header, "$.alg").isNotNull(), F.lit(False))
    form = c.rlike("^(AKIA|ASIA)[0-9A-Z]{16}$") | c.rlike("^gh[pousr]_[A-Za-z0-9]{36}$")
    digest = F.col("before").rlike(DIGESTS) | F.replace("word", c, F.lit("")).rlike(DIGESTS)
    given = (F.col("hint_before") + F.col("hint_inside") > 0) & (F.col("assigned") > 0) & ~digest
    random = (bits >= RANDOM) & c.rlike("[0-9]") & c.rlike("[A-Za-z]")
    uuid = c.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")
    harmless = (bits <= WORDLIKE) | c.rlike("^[^A-Za-z]+$") | uuid | digest
    return found.withColumn("label", F.when(form | signed | (random & given & ~uuid), 1.0).when(harmless, 0.0)).filter("label is not null")


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def training_sample(labelled: DataFrame, per_label: int = SAMPLE) -> DataFrame:
    """Up to per_label findings of each label, those of least hash; never of held-out documents."""
    ready = labelled.filter(~held_out()).select("label", *FEATURES, F.xxhash64("doc_id", "word_no", "part", "candidate").alias("h"))
    parts = [ready.filter(F.col("label") == k).orderBy("h", *FEATURES).limit(per_label) for k in (0.0, 1.0)]
    return parts[0].unionByName(parts[1]).coalesce(1).sortWithinPartitions("label", "h", *FEATURES)


class Forest:
    """Random forest over FEATURES, or a constant where only one label (or none) is known."""

    def __init__(self, sample: DataFrame, trees: int = 20, depth: int = 6, seed: int = 7):
        from pyspark.ml.classification import RandomForestClassifier
        from pyspark.ml.feature import VectorAssembler

        sample = Scratch.table(sample, "secret-sample")
        counts = {r[0]: r[1] for r in sample.groupBy("label").count().collect()}
        self.constant = None if len(counts) == 2 else float(bool(counts.get(1.0)))
        self.assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features", handleInvalid="keep")
        if self.constant is None:
            forest = RandomForestClassifier(featuresCol="features", labelCol="label", probabilityCol="p", rawPredictionCol="raw", predictionCol="y", numTrees=trees, maxDepth=depth, seed=seed)
            self.model = forest.fit(self.assembler.transform(sample.coalesce(1)))

    def score(self, found: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        if self.constant is not None:
            return found.withColumn("probability", F.lit(self.constant))
        scored = self.model.transform(self.assembler.transform(found))
        return scored.withColumn("probability", F.round(vector_to_array("p")[1], 6)).drop("features", "raw", "p", "y")


def scan(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """doc_id, word_no, part, candidate, features, probability, is_secret of every candidate.

    labelled: findings with label; None takes silver labels of the documents' own findings.
    """
    docs = docs.select("doc_id", "text")
    words = dictionary(docs)
    found = Scratch.table(findings(docs, words), "secret-findings")
    forest = Forest(training_sample(silver_labels(found, words) if labelled is None else labelled))
    return forest.score(found).withColumn("is_secret", F.col("probability") >= threshold)
