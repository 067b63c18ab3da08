"""Near-duplicate lines by an exact set-similarity join (DataFrame functions only).

A line is the set of its words; lines with equal sets count as one, placed where the first of them stands. Words are
ordered by rarity in the corpus; two lines with Jaccard similarity of at least t share a word within the first
n - ceil(t n) + 1 words of each, so only these prefixes are joined. Length, positional and bitmap filters are part of
the join's condition, so what comes out are nearly only like lines, and the words themselves decide. Of a pair the
later line goes (order: doc_id, then hash of the text, then line number).

A line needs one earlier like line to go, not all of them. So each line is first compared with the earliest line under
some of its prefix words (those of least hash, which like lines mostly agree in). That settles nearly all lines of
large groups of variants; in the join proper only pairs with an unsettled later line are candidates.

Rarity comes from a table of word counts by hash bucket, of fixed size whatever the vocabulary: any order of the words
gives right results, a rare word that shares a bucket with a frequent one only makes a prefix less selective.

Defined cases: null texts have no lines and stay as they are; lines without a word stay and count as no line; very
long lines and texts are handled whole; a null doc_id comes first; rows with equal doc_id and text get one verdict; an
empty table gives an empty result; input columns may have any names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import Scratch, free_prefix

#: Of the table of word counts.
BUCKETS = 1 << 18
#: Prefix words of a line under which it is compared with the earliest line first.
HEADS = 3
#: From this many words on a line's bitmap has 128 bits in place of 64: each part is carried by every entry of the
#: join, and takes a pass over the keys of its own.
WIDE = 96
#: Small tables of line numbers and places are broadcast up to this number of rows, and shuffled beyond.
BROADCAST_ROWS = 1_000_000
SPACES = r"[\x20\x09-\x0D]+"
PLACE = ("doc_id", "th", "line_no")
BITS = ("b0", "b1")


def _bucket(hashed: Column) -> Column:
    return hashed.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def word_classes(docs: DataFrame, text: str = "text") -> Column:
    """Array literal: for each hash bucket of words, a logarithmic class of how often they occur in all texts.

    Texts are cut at blanks only, which is quick; words beside another kind of white space count as one with it.
    """
    words = docs.select(F.explode(F.split(F.col(text), " ")).alias("w")).groupBy(_bucket(F.xxhash64("w")).alias("b")).count()
    classes = words.select("b", F.floor(2 * F.log2(F.col("count") + 1)).cast("int").alias("c"))
    rows = {r[0]: r[1] for r in classes.collect()}  # at most BUCKETS rows
    return F.split(F.lit(",".join(str(rows.get(b, 0)) for b in range(BUCKETS))), ",").cast("array<int>")


def _lines(docs: DataFrame, text: str) -> DataFrame:
    """doc_id, th (hash of the text), line_no, line."""
    # The hash is made before the lines are: beside the generator it would be made for each line.
    cut = docs.select(F.col("doc_id"), F.xxhash64(text).alias("th"), F.split(F.col(text), "\n").alias("lines"))
    return cut.select("doc_id", "th", F.posexplode("lines").alias("line_no", "line"))


def _words(line: Column) -> Column:
    return F.array_distinct(F.filter(F.split(line, SPACES), lambda w: w != F.lit("")))


def _has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def _small(df: DataFrame) -> DataFrame:
    """df (read from written tables) with a broadcast hint if it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _parity(keys: Column) -> Column:
    """64 bits: for each value of the lowest six bits, whether an odd number of keys has it."""
    one = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k.bitwiseAND(F.lit(63)).cast("int"))
    return F.aggregate(keys, F.lit(0).cast("long"), lambda acc, k: acc.bitwiseXOR(one(k)))


def line_signatures(docs: DataFrame, percent: int, text: str = "text") -> DataFrame:
    """One row per distinct set of words: its first place, number of words n, bitmap b0 and b1, rarest words as hashes.

    The 128 bits of long lines fold (by exclusive or of the two) into the 64 bits that short lines have in b0.
    """
    classes = word_classes(docs, text)
    # Lines without a word are left out before the keys are made: a filter on the keys would make them twice.
    lines = _lines(docs, text).filter(_has_word(F.col("line")))
    words = F.when(F.col("line").rlike(r"[\x09-\x0D]"), F.split("line", SPACES)).otherwise(F.split("line", " "))
    # Each word is hashed once. A key begins with the word's class and goes on with 56 bits of its hash. None is null, so
    # they sort as plain numbers.
    hashes = F.array_remove(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))
    keys = F.transform(hashes, lambda h: F.shiftleft(F.get(classes, _bucket(h)).cast("long"), 56).bitwiseOR(F.shiftrightunsigned(h, 8)))
    lines = lines.select(*PLACE, F.sort_array(keys).alias("keys"))
    n = F.size("keys")
    # hash() of the key is an even 32-bit name for the word; a shared name of unlike words only adds a candidate.
    prefix = F.transform(F.slice("keys", F.lit(1), n - F.floor((n * percent + 99) / 100).cast("int") + 1), lambda k: F.hash(k))
    half = lambda j: _parity(F.filter("keys", lambda k: k.bitwiseAND(F.lit(64)) == j))
    bits = [F.when(n >= WIDE, half(0)).otherwise(_parity(F.col("keys"))).alias("b0"), F.when(n >= WIDE, half(64)).otherwise(F.lit(0).cast("long")).alias("b1")]
    signed = lines.select(F.xxhash64("keys").alias("h1"), F.xxhash64(F.lit(1), "keys").alias("h2"), F.struct(*PLACE).alias("place"), n.alias("n"), *bits, prefix.alias("prefix"))
    # Both hashes go over the keys, from unlike beginnings: sets that agree in one of them still differ in the other.
    # Equal sets agree in all but the place, so partial aggregation leaves one row for each of them in a task.
    firsts = signed.groupBy("h1", "h2").agg(F.min("place").alias("place"), *[F.first(c).alias(c) for c in ("n", *BITS, "prefix")])
    return firsts.select(F.monotonically_increasing_id().alias("lid"), "place.*", "n", *BITS, "prefix")


def _close(n1: Column, n2: Column, a, b, percent: int) -> Column:
    """Length and bitmap filters for two lines of n1 and n2 words; a and b give the columns b0 and b1 of each.

    Sets of similarity t differ in at most (n1 + n2)(1 - t)/(1 + t) words, and bitmaps in no more bits than words.
    """
    differ = (n1 + n2) * (100 - percent)
    d = [a(c).bitwiseXOR(b(c)) for c in BITS]
    return (
        (n1 * 100 >= n2 * percent)
        & (n2 * 100 >= n1 * percent)
        & (F.bit_count(reduce(Column.bitwiseXOR, d)) * (100 + percent) <= differ)
        & ((F.least(n1, n2) < WIDE) | (sum((F.bit_count(x) for x in d[1:]), F.bit_count(d[0])) * (100 + percent) <= differ))
    )


def head_pairs(signatures: DataFrame, percent: int) -> DataFrame:
    """lid1, lid2: each line and the earliest line under some of its prefix words, if the filters let them pass."""
    words = F.explode(F.slice(F.sort_array(F.array_distinct("prefix")), 1, HEADS)).alias("w")
    entries = signatures.select(words, "lid", "n", *BITS, "doc_id", "line_no")
    heads = entries.groupBy("w").agg(F.min(F.struct("doc_id", "line_no", "lid", "n", *BITS)).alias("head"), F.max("lid").alias("l1"), F.min("lid").alias("l2")).filter("l1 <> l2").select("w", "head")
    close = _close(F.col("e.n"), F.col("h.head.n"), lambda c: F.col(f"e.{c}"), lambda c: F.col(f"h.head.{c}"), percent)
    met = entries.alias("e").join(heads.alias("h"), (F.col("e.w") == F.col("h.w")) & (F.col("e.lid") != F.col("h.head.lid")) & close)
    return met.select(F.col("e.lid").alias("lid1"), F.col("h.head.lid").alias("lid2")).distinct()


def candidate_pairs(signatures: DataFrame, settled: DataFrame, percent: int) -> DataFrame:
    """lid1, lid2: pairs of lines, the later one not settled, that share a prefix word and pass all filters.

    Open lines meet open ones and settled ones; settled lines never meet one another, so a large group of variants costs
    its size for each line of it that is still open. Lines of one doc_id stay in either order here; the full place
    orders them.
    """
    whole = F.posexplode("prefix").alias("pos", "w")

    def entries(lines: DataFrame) -> DataFrame:
        each = lines.select("lid", "doc_id", *BITS, F.col("n").cast("long").alias("n"), whole)
        # Of the smaller set a shorter prefix is enough, as the larger one's need is at least its own size's.
        inner = F.col("pos") <= F.col("n") - F.ceil(F.col("n") * 2 * percent / (100 + percent) - F.lit(1e-9))
        return each.select("w", "lid", "doc_id", *BITS, (F.shiftleft("n", 32) + F.col("pos") * 2 + inner.cast("long")).alias("meta"))

    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    n = lambda x: F.shiftright(x("meta"), 32)
    pos = lambda x: F.shiftright(x("meta"), 1).bitwiseAND(F.lit((1 << 31) - 1))
    inner = lambda x: x("meta").bitwiseAND(F.lit(1)) != 0
    n1, n2 = n(a), n(b)
    shared = (
        _close(n1, n2, a, b, percent)
        & (((n1 <= n2) & inner(a)) | ((n2 <= n1) & inner(b)))
        # what may be shared before this word, and from it on
        & ((F.least(pos(a), pos(b)) + F.least(n1 - pos(a), n2 - pos(b))) * (100 + percent) >= (n1 + n2) * percent)
    )
    # Both joins use the same exchange of the open lines' entries.
    some = entries(signatures.join(settled, "lid", "left_anti"))
    rest = entries(signatures.join(settled, "lid", "left_semi"))
    # The cheapest and the most selective conditions come first.
    # Each pair once; both joins ask for doc_id, or their exchanges would have unlike columns and not be shared.
    once = F.when(F.coalesce(a("doc_id") == b("doc_id"), F.lit(True)), a("lid") < b("lid")).otherwise(a("doc_id") < b("doc_id"))
    both = some.alias("a").join(some.alias("b"), (a("w") == b("w")) & once & shared)
    one = some.alias("a").join(rest.alias("b"), (a("w") == b("w")) & F.coalesce(b("doc_id") <= a("doc_id"), F.lit(True)) & shared)
    ids = [F.least(a("lid"), b("lid")).alias("lid1"), F.greatest(a("lid"), b("lid")).alias("lid2")]
    return both.select(*ids).unionByName(one.select(*ids)).distinct()


def _settled(docs: DataFrame, signatures: DataFrame, pairs: DataFrame, percent: int, text: str, known: DataFrame | None = None) -> DataFrame:
    """lid of the later line of each pair (a written table) whose lines are alike by the words themselves.

    Pairs whose later line is in known (a written table) are passed over.
    """
    # Few lines are in pairs, so the shuffles here move line numbers, and the texts of these lines only.
    ids = Scratch.table(pairs.select(F.explode(F.array("lid1", "lid2")).alias("lid")).distinct(), "line-ids")
    places = Scratch.table(signatures.join(_small(ids), "lid", "left_semi").select("lid", F.struct(*PLACE).alias("p")), "line-places")
    one = places.select(F.col("lid").alias("lid1"), F.col("p").alias("p1"))
    two = places.select(F.col("lid").alias("lid2"), F.col("p").alias("p2"))
    before = F.col("p1") < F.col("p2")
    ordered = pairs.join(one, "lid1").join(two, "lid2").select(F.when(before, F.col("lid2")).otherwise(F.col("lid1")).alias("later"), F.when(before, F.col("lid1")).otherwise(F.col("lid2")).alias("earlier"))
    if known is not None:
        ordered = Scratch.table(ordered.join(known.select(F.col("lid").alias("later")), "later", "left_anti"), "line-open-pairs")
        places = places.join(ordered.select(F.explode(F.array("later", "earlier")).alias("lid")).distinct(), "lid", "left_semi")
    # Only documents with such a line are cut into lines again.
    places = Scratch.table(places.select("lid", *[F.col(f"p.{c}").alias(f"p_{c}") for c in PLACE]), "line-sought")
    hint = F.broadcast if places.count() <= BROADCAST_ROWS else (lambda df: df)
    of_doc = hint(places.select("p_doc_id", "p_th").distinct())
    some = docs.select("doc_id", F.col(text).alias("text")).join(of_doc, F.col("doc_id").eqNullSafe(F.col("p_doc_id")) & (F.xxhash64("text") == F.col("p_th")), "left_semi")
    lines = _lines(some, "text").join(hint(places), F.col("doc_id").eqNullSafe(F.col("p_doc_id")) & (F.col("th") == F.col("p_th")) & (F.col("line_no") == F.col("p_line_no")))
    texts = Scratch.table(lines.select("lid", "line").dropDuplicates(["lid"]), "line-texts")
    both = ordered.join(texts.select(F.col("lid").alias("later"), F.col("line").alias("l1")), "later").join(texts.select(F.col("lid").alias("earlier"), F.col("line").alias("l2")), "earlier")
    sets = both.select("later", _words(F.col("l1")).alias("w1"), _words(F.col("l2")).alias("w2"))
    counted = sets.select("later", (F.size("w1") + F.size("w2")).alias("n"), F.size(F.array_intersect("w1", "w2")).alias("shared"))
    alike = counted.filter(F.col("shared") * 100 >= (F.col("n") - F.col("shared")) * percent)
    return Scratch.table(alike.select(F.col("later").alias("lid")).distinct(), "line-settled")


def later_lines(docs: DataFrame, signatures: DataFrame, percent: int, text: str = "text") -> DataFrame:
    """lid of every line that is like an earlier one. signatures: a written table."""
    with Scratch.scope(keep=1):
        heads = Scratch.table(head_pairs(signatures, percent), "line-heads")
        first = _settled(docs, signatures, heads, percent, text)
    with Scratch.scope(keep=1):
        pairs = Scratch.table(candidate_pairs(signatures, _small(first), percent), "line-pairs")
        more = _settled(docs, signatures, pairs, percent, text, first)
    return first.unionByName(more)


def kept_lines(docs: DataFrame, percent: int = 80, text: str = "text") -> DataFrame:
    """doc_id, th, lines: the numbers (from 0) of the lines with a word that stay; documents without any are missing."""
    signatures = Scratch.table(line_signatures(docs, percent, text), "line-signatures")
    later = later_lines(docs, signatures, percent, text)
    stay = signatures.select(*PLACE, "lid").join(_small(later), "lid", "left_anti")
    # All lines of one document: bounded by its own length.
    return stay.groupBy("doc_id", "th").agg(F.array_sort(F.collect_list("line_no")).alias("lines"))


def line_verdicts(docs: DataFrame, percent: int = 80) -> DataFrame:
    """Per document: doc_id, n_lines (with a word), n_removed, kept_lines_sha256 (of the kept lines' numbers, by commas)."""
    small = docs.select("doc_id", "text")
    kept = kept_lines(small, percent).select(F.col("doc_id").alias("k_id"), F.col("th").alias("k_th"), F.size("lines").alias("n_kept"), F.sha2(F.array_join(F.col("lines").cast("array<string>"), ","), 256).alias("sha"))
    # From a line's first word to its end: one match a line with a word.
    with_word = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D][^\n]*"))
    rows = small.select("doc_id", F.xxhash64("text").alias("th"), F.greatest(F.coalesce(with_word, F.lit(0)), F.lit(0)).alias("n_lines"))
    out = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("th") == F.col("k_th")), "left")
    n_kept = F.coalesce("n_kept", F.lit(0))
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), (F.col("n_lines") - n_kept).cast("long").alias("n_removed"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("kept_lines_sha256"))


def dedup_documents(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs without the later ones of like lines; a document that had lines with words and loses them all goes."""
    kept = kept_lines(docs.select("doc_id", "text"), percent)
    own = free_prefix(docs.columns)
    kept = kept.select(F.col("doc_id").alias(f"{own}id"), F.col("th").alias(f"{own}th"), F.col("lines").alias(f"{own}kept"))
    joined = docs.withColumn(f"{own}hash", F.xxhash64("text")).join(kept, F.col("doc_id").eqNullSafe(F.col(f"{own}id")) & (F.col(f"{own}hash") == F.col(f"{own}th")), "left")
    lines = F.split("text", "\n")
    numbered = F.transform(lines, lambda line, i: F.when(~_has_word(line), i))
    blank = F.filter(numbered, lambda i: i.isNotNull())
    joined = joined.withColumn(f"{own}all", lines).withColumn(f"{own}blank", blank)
    wordless = F.size(f"{own}all") == F.size(f"{own}blank")
    order = F.array_sort(F.concat(F.coalesce(f"{own}kept", F.array().cast("array<int>")), f"{own}blank"))
    text = F.array_join(F.transform(order, lambda i: F.get(F.col(f"{own}all"), i)), "\n")
    stays = joined.filter(F.col("text").isNull() | wordless | F.col(f"{own}kept").isNotNull())
    return stays.withColumn("text", F.when(F.col("text").isNull() | (F.size(order) == F.size(f"{own}all")), F.col("text")).otherwise(text)).select(*[F.col(f"`{c}`") for c in docs.columns])
