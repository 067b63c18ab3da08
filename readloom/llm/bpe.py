"""Byte-level BPE by longest matches with backtracking.

Bytes are mapped to Latin-1 so that an Aho-Corasick automaton over the vocabulary finds the longest token at a place.
A sequence of tokens is the result of the merges exactly if every two neighbours are what the merges make of their
own bytes; that compatibility is memoised by pair. Encoding walks forward with the longest token that is compatible
with the last one, tries shorter ones (each token knows the next shorter token it starts with), and steps back where
none fits; places found to be dead ends are never tried again, so the work is linear in the piece.

Defined cases: null and empty texts have no tokens; a text without matches of the pattern too; very long texts and
pieces are encoded whole; equal texts get equal ids; extra columns are kept out of the result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from pathlib import Path

import ahocorasick
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import prepare

#: Entries of the caches of one worker; a full cache is emptied, which costs time and changes no result.
CACHE = 400_000
#: Fixed value: the public pattern of which every alternative but white space takes a space before it.
SPACED = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NEAR_SPACE = re.compile(r"^ | $|\s | \s")
LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def vocabulary(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[str, str]:
    """Path of a rank file of the public tokenizers and the pattern that goes with it."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


class _Pieces(dict):
    def __init__(self, make):
        self._make = make

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= CACHE:
            self.clear()
        ids = self._make(piece)
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class BytePairEncoder:
    """Encoder and decoder for one rank file (lines of base64 bytes and rank)."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.names = {rank: str(rank) for rank in self.tokens}
        self.pattern = regex.compile(pattern)
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.shorter: dict[int, int | None] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.sound: dict[int, bool] = {}
        self.pieces = _Pieces(lambda piece: self.encode_piece(piece.encode("utf-8", "surrogatepass")))
        self.after = _Pieces(lambda chunk: self._chunk(" " + chunk))
        self.spaced = pattern == SPACED

    def merged(self, piece: bytes) -> list[int]:
        """The merges as defined: join the neighbours of lowest rank, leftmost first, until none can be joined."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        none = len(self.ranks) + 1_000_000
        while len(parts) > 1:
            joint = [self.ranks.get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
            best = min(joint)
            if best == none:
                break
            i = joint.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def _sound(self, token: int) -> bool:
        """Do the merges make this token of its own bytes?"""
        known = self.sound.get(token)
        if known is None:
            known = self.sound[token] = self.merged(self.tokens[token]) == [token]
        return known

    def _fits(self, left: int, right: int) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= CACHE:
                self.pairs.clear()
            known = self.pairs[left, right] = self.merged(self.tokens[left] + self.tokens[right]) == [left, right]
        return known

    def _next_shorter(self, token: int) -> int | None:
        """The longest proper prefix of a token that is a token too."""
        if token not in self.shorter:
            word = self.tokens[token]
            self.shorter[token] = next((self.ranks[word[:i]] for i in range(len(word) - 1, 0, -1) if word[:i] in self.ranks), None)
        return self.shorter[token]

    def _longest(self, text: str, at: int) -> int:
        return next(self.automaton.iter_long(text, at))[1]

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        text, end = piece.decode("latin-1"), len(piece)
        dead = bytearray(end + 1)
        out: list[int] = []
        at = 0
        token: int | None = self._longest(text, 0)
        while at < end:
            while token is not None:
                stop = at + len(self.tokens[token])
                if not dead[stop] and (self._fits(out[-1], token) if out else self._sound(token)):
                    break
                token = self._next_shorter(token)
            if token is None:
                # Nothing fits here after the last token: what came before must end elsewhere.
                dead[at] = 1
                if not out:
                    raise ValueError("the vocabulary lacks single bytes")
                token = out.pop()
                at -= len(self.tokens[token])
                token = self._next_shorter(token)
                continue
            out.append(token)
            at = stop
            token = self._longest(text, at) if at < end else None
        return tuple(out)

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        return tuple([i for piece in self.pattern.findall(chunk) for i in self.pieces[piece]])

    def encode(self, text: str) -> list[int]:
        if not self.spaced:
            return list(self._chunk(text))
        # A single space between two other characters starts a match: what lies between such spaces is matched, and
        # remembered, by itself.
        chunks = text.split(" ") if not NEAR_SPACE.search(text) else LONE_SPACE.split(text)
        after = self.after
        return [*self._chunk(chunks[0]), *(i for chunk in chunks[1:] for i in after[chunk])]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_encoders: dict[tuple[str, str], BytePairEncoder] = {}


def encoder(path: str, pattern: str) -> BytePairEncoder:
    """The encoder of this worker process, built once."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = BytePairEncoder(path, pattern)
    return _encoders[path, pattern]


def _encoded(batches: Iterator[pa.RecordBatch], name: str, pattern: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    bpe = encoder(SparkFiles.get(name), pattern)
    names = bpe.names
    for batch in batches:
        counts, id_digests, byte_digests, ids_out = [], [], [], []
        for text in batch.column(1).to_pylist():
            ids = bpe.encode(text or "")
            counts.append(len(ids))
            id_digests.append(hashlib.sha256(",".join([names[i] for i in ids]).encode()).hexdigest())
            byte_digests.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            if with_ids:
                ids_out.append(ids)
        columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(id_digests, pa.string()), pa.array(byte_digests, pa.string())]
        fields = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if with_ids:
            columns.append(pa.array(ids_out, pa.list_(pa.int32())))
            fields.append("ids")
        yield pa.RecordBatch.from_arrays(columns, fields)


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids) of every document; the ids are decoded again for the last.

    The rank file lies on the driver and is shipped to the executors.
    """
    prepare(docs.sparkSession)
    if path is None or pattern is None:
        known = vocabulary()
        path, pattern = path or known[0], pattern or known[1]
    docs.sparkSession.sparkContext.addFile(path)
    name = Path(path).name
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda b: _encoded(b, name, pattern, with_ids), schema)
