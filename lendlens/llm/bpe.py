"""Byte-pair encoding by a public vocabulary, in batched numpy merge rounds, and decoding.

The symbols of many distinct words stand in one flat array. In each round every pair of
neighbours is looked up by binary search among the sorted pair keys, each word merges its
pair of lowest rank, and words without a pair leave. White space never enters a token, so
texts are cut there, distinct pieces are encoded once per block, and a text is the
concatenation of its pieces.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession, functions as F, types as T

from lendlens.llm.common import by_block, struct_of

NONE = np.iinfo(np.int64).max
# Fixed values of the vocabulary's format: its white space, its word pattern, its word end.
SPACE = regex.compile(r"\s+")
ODD_SPACE = regex.compile(r"[\x1c-\x1f]")
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
WORD_END = "</w>"
BLOCK = 2 << 20  # bytes of text whose pieces are in memory


def byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordBpe:
    """A vocabulary file of the `tokenizers` library with lower case and word ends."""

    def __init__(self, text: str) -> None:
        file = json.loads(text)
        vocab, merges = file["model"]["vocab"], file["model"]["merges"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.tokens = {i: t for t, i in vocab.items()}
        self.specials = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.tokens.update({i: t for t, i in self.specials.items()})
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")") if self.specials else None
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters])
        self.last = np.array([vocab[c + WORD_END] for c in letters])
        self.size = max(self.tokens) + 1
        left, right = (np.array([vocab[m[k]] for m in merges], np.int64) for k in (0, 1))
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys = left * self.size + right
        keys, first = np.unique(keys, return_index=True)  # of repeated pairs the first rank holds
        self.keys, self.rank, self.made = keys, first.astype(np.int64), made
        lowest = np.full(self.size, NONE)
        np.minimum.at(lowest, left, np.arange(len(merges)))
        np.minimum.at(lowest, right, np.arange(len(merges)))
        # A merge whose symbol has an earlier pair is done one place at a time.
        self.early = lowest[made] < np.arange(len(merges))

    def pairs(self, symbols: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Rank of each symbol with its right neighbour in the same word."""
        key = symbols[:-1] * self.size + symbols[1:]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (owner[:-1] == owner[1:]), self.rank[at], NONE)

    def merge(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word's tokens."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbols, owner = self.inner[data], np.repeat(np.arange(len(raw)), sizes)
        symbols[np.cumsum(sizes)[sizes > 0] - 1] = self.last[data[np.cumsum(sizes)[sizes > 0] - 1]]
        done_symbols, done_owner = [], []
        while len(symbols):
            rank = np.append(self.pairs(symbols, owner), NONE)
            start = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            best = np.minimum.reduceat(rank, start)
            length = np.diff(np.append(start, len(symbols)))
            over = np.repeat(best == NONE, length)
            if over.any():
                done_symbols.append(symbols[over]), done_owner.append(owner[over])
                symbols, owner, rank = symbols[~over], owner[~over], rank[~over]
                length, best = length[best != NONE], best[best != NONE]
                if not len(symbols):
                    break
            hit = rank == np.repeat(best, length)
            at = np.flatnonzero(hit)
            # Of touching places ("aaa") every second one merges; early merges take the first only.
            run = np.flatnonzero(np.append(True, np.diff(at) != 1))
            odd = (np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 1
            first = np.append(True, owner[at[1:]] != owner[at[:-1]])
            at = at[np.where(self.early[rank[at]], first, ~odd)]
            symbols[at] = self.made[rank[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        if not done_symbols:
            return [np.zeros(0, np.int64) for _ in words]
        symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return np.split(symbols[order], np.searchsorted(owner[order], np.arange(1, len(words))))

    def pieces(self, text: str) -> list[str]:
        """The text between white space; special tokens stand alone, marked by a leading blank."""
        if self.special is not None and "<|" in text:
            cut = self.special.split(text)
            return [p for k, part in enumerate(cut) for p in ([" " + part] if k % 2 else self.pieces_between(part))]
        return self.pieces_between(text)

    @staticmethod
    def pieces_between(text: str) -> list[str]:
        return text.split() if not ODD_SPACE.search(text) else [p for p in SPACE.split(text) if p]

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        """Ids of distinct pieces: normalised, cut into words, merged."""
        spelled = [PIECE.findall(lower(unicodedata.normalize("NFC", p))) if p[0] != " " else [p] for p in pieces]
        words = {w: None for s in spelled for w in s if w[0] != " "}
        ids = dict(zip(words, (x.tolist() for x in self.merge(list(words)))))
        ids.update({" " + t: [i] for t, i in self.specials.items()})
        return [[i for w in s for i in ids[w]] for s in spelled]

    def encode(self, text: str) -> list[int]:
        return [i for ids in self.encode_pieces(self.pieces(text)) for i in ids]

    def decode(self, ids: list[int]) -> str:
        """As the library without a decoder does: tokens joined by blanks, special ones included."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


def lower(text: str) -> str:
    """Lower case letter by letter, so a final sigma is like any other."""
    return text.replace("Σ", "σ").lower()


FIELDS = T.StructType([
    T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
    T.StructField("decoded_sha256", T.StringType())])


def read_vocabulary(path: str) -> str:
    """The file's text, which is shipped to the executors (a few MB, fixed)."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def token_ids(spark: SparkSession, text: Column, path: str) -> Column:
    """The ids of the whole text as an array; a null or empty text has none."""
    shared = spark.sparkContext.broadcast(read_vocabulary(path))

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = WordBpe(shared.value)

        def work(block: pa.Array) -> pa.Array:
            rows, known = coded_pieces(bpe, block)
            return pa.array([[i for c in r for i in known[c]] for r in rows], pa.list_(pa.int32()))
        for texts in batches:
            yield by_block(texts, work, BLOCK)
    return ids(text)


def decoded(spark: SparkSession, ids: Column, path: str) -> Column:
    """The text of an array of ids, special tokens included; null for null."""
    shared = spark.sparkContext.broadcast(read_vocabulary(path))

    @F.arrow_udf(T.StringType())
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = WordBpe(shared.value)
        for values in batches:
            yield pa.array([None if v is None else bpe.decode(v) for v in values.to_pylist()], pa.string())
    return texts(ids)


def coded_pieces(bpe: WordBpe, block: pa.Array) -> tuple[list[list[int]], list[list[int]]]:
    """Each text as codes of pieces, and the ids of each distinct piece."""
    codes: dict[str, int] = {}
    rows = []
    for text in block:
        rows.append([codes.setdefault(p, len(codes)) for p in bpe.pieces(text.as_py())])
    return rows, bpe.encode_pieces(list(codes))


def encoded_digest(spark: SparkSession, text: Column, path: str) -> Column:
    """Struct of the number of tokens, and the hashes of the ids and of the text decoded from them.

    Null and empty texts, and texts of white space only, have no tokens and decode to an empty text.
    """
    shared = spark.sparkContext.broadcast(read_vocabulary(path))

    @F.arrow_udf(FIELDS)
    def digest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = WordBpe(shared.value)
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()

        def work(block: pa.Array) -> pa.Array:
            rows, known = coded_pieces(bpe, block)
            sizes = np.fromiter(map(len, known), np.int64, len(known))
            spelled = [" ".join(map(str, ids)) for ids in known]
            back = [bpe.decode(ids) for ids in known]
            return struct_of({
                "n_tokens": ([int(sizes[r].sum()) if r else 0 for r in rows], pa.int64()),
                "ids_sha256": ([sha(" ".join([spelled[c] for c in r])) for r in rows], pa.string()),
                "decoded_sha256": ([sha(" ".join([back[c] for c in r])) for r in rows], pa.string())})
        for texts in batches:
            yield by_block(texts, work, BLOCK)
    return digest(text)
