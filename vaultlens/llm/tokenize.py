"""Encoding of the whole corpus with a public tokenizer (problem 7).

Texts of ordinary length go to the tokenizer as they are. A long text is a
tree: it is halved, where possible at places that always part the pattern's
matches, the leaves are encoded in parallel and neighbours are joined. Where a
single match of the pattern is long, its halves' ids are joined by encoding a
window around the join again, which grows until its first and last id agree
with both sides. Byte pair merges make the ids of a piece the one sequence in
which every two neighbours, encoded together, remain as they are; with both
ends agreeing, all neighbours in the joined sequence have that property.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultlens.plans.runtime import read_table

#: Folder of the public tokenizers' files; a parameter of every function here.
TOKENIZERS = os.environ.get("VAULTLENS_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the pattern that splits a text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters from which a text is halved, and bytes from which one match of the pattern is.
LONG_TEXT, LONG_PIECE = 16_000, 1_000
#: A single blank between two others: no match of the pattern reaches across its left side.
_SEAM = regex.compile(r"(?<=\S)(?= \S)")
_SEAM_BEFORE = regex.compile(r"(?r)(?<=\S)(?= \S)")
_loaded: dict = {}


class Encoder:
    """byte_bpe_50k: ids of texts without special tokens."""

    def __init__(self, folder: str = TOKENIZERS, name: str = "byte_bpe_50k", *, long_text: int = LONG_TEXT, long_piece: int = LONG_PIECE, threads: int = 2):
        import tiktoken

        with open(os.path.join(folder, name + ".tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = {i: len(b) for b, i in ranks.items()}
        self.pattern = regex.compile(PATTERN)
        self.long_text, self.long_piece, self.threads = long_text, long_piece, threads

    def __call__(self, text: str | None) -> list[int]:
        """The ids of a text; none for null and empty text."""
        if not text:
            return []
        if len(text) <= self.long_text and not self._unsplit(text):
            return self.bpe.encode_ordinary(text)
        leaves: list[str | bytes] = []
        for part in self._parts(text):
            leaves += self._leaves(part)
        with ThreadPoolExecutor(self.threads) as pool:  # the tokenizer releases the interpreter
            return [i for ids in pool.map(self._leaf, leaves, chunksize=8) for i in ids]

    def _unsplit(self, text: str) -> bool:
        """Whether some match of the pattern may be long: no blank for long. A run without blanks is met by looking back from its end."""
        long = self.long_piece // 4
        at = long
        while at < len(text):
            blank = text.rfind(" ", at - long, at + 1)
            if blank < 0:
                return True
            at = blank + long + 1
        return False

    def _parts(self, text: str) -> list[str]:
        """Halves of halves up to the limit, cut at seams."""
        if len(text) <= self.long_text:
            return [text]
        half = len(text) // 2
        seam = _SEAM.search(text, half) or _SEAM_BEFORE.search(text, 0, half)
        if not seam:
            return [text]
        return self._parts(text[: seam.start()]) + self._parts(text[seam.start() :])

    def _leaves(self, part: str) -> list[str | bytes]:
        """A part, or its matches with the long ones as bytes, if it has long ones."""
        if not self._unsplit(part) and len(part) <= self.long_text:
            return [part]
        out: list[str | bytes] = []
        for piece in self.pattern.findall(part):
            out.append(b if len(b := piece.encode()) > self.long_piece else piece)
        return out

    def _leaf(self, leaf: str | bytes) -> list[int]:
        return self.piece(leaf) if isinstance(leaf, bytes) else self.bpe.encode_ordinary(leaf)

    def piece(self, data: bytes) -> list[int]:
        """Ids of one match of the pattern, by tree concatenation."""
        if len(data) <= self.long_piece:
            return self.bpe._encode_single_piece(data)
        half = len(data) // 2
        return self.join(data, self.piece(data[:half]), self.piece(data[half:]), half)

    def join(self, data: bytes, left: list[int], right: list[int], at: int) -> list[int]:
        """Ids of data from those of data[:at] and data[at:]."""
        n = 4
        while True:
            a, b = left[-n:], right[:n]
            start, end = at - sum(self.size[i] for i in a), at + sum(self.size[i] for i in b)
            both = self.bpe._encode_single_piece(data[start:end])
            first = len(a) == len(left) or both[0] == a[0]
            last = len(b) == len(right) or both[-1] == b[-1]
            if first and last:
                return left[: len(left) - len(a)] + both + right[len(b) :]
            n *= 2


def encoder(folder: str, name: str) -> Encoder:
    """One encoder of a kind in each Python worker."""
    if (folder, name) not in _loaded:
        _loaded[folder, name] = Encoder(folder, name)
    return _loaded[folder, name]


def encode(docs: DataFrame, *, folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """doc_id and ids of each row of docs (doc_id, text); other columns are ignored.

    Null and empty texts have the empty list; repeated rows come out repeated.
    Whole texts are encoded, of any length, without a shuffle.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder, name)
        kind = pa.list_(pa.int32())
        for b in it:
            ids = pa.array([enc(t) for t in b.column("text").to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), ids], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(batches, "doc_id bigint, ids array<int>")


def token_counts(docs: DataFrame, *, folder: str = TOKENIZERS, name: str = "byte_bpe_50k", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_tokens and the columns to keep of each row of docs, by the same encoder; 0 for null and empty text."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder, name)
        for b in it:
            n = pa.array([len(enc(t)) for t in b.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), n, *(b.column(c) for c in keep)], names=["doc_id", "n_tokens", *keep])

    kept = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(F.col("doc_id").cast("bigint"), "text", *keep).mapInArrow(batches, f"doc_id bigint, n_tokens bigint{kept}")


def decode(ids: DataFrame, *, folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """doc_id and text of each row of ids (doc_id, ids): the bytes of its tokens put together; no ids are the empty text."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(folder, name).bpe
        for b in it:
            texts = pa.array([bpe.decode_bytes(i or []).decode("utf-8", "replace") for i in b.column("ids").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), texts], names=["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(batches, "doc_id bigint, text string")


def p7_ids(spark, sf_dir: str) -> DataFrame:
    return encode(read_table(spark, sf_dir, "documents"))


def p7_roundtrip(spark, sf_dir: str) -> DataFrame:
    """doc_id and digest of the text that the ids of each document make up again."""
    return decode(p7_ids(spark, sf_dir)).select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


def p7_tokens(spark, sf_dir: str) -> DataFrame:
    """Texts, tokens and characters per source, the corpus' size for planning."""
    n = token_counts(read_table(spark, sf_dir, "documents"), keep=("source", "n_chars"))
    return n.groupBy("source").agg(F.count("*").alias("texts"), F.sum("n_tokens").alias("tokens"), F.sum("n_chars").alias("chars"))
