"""Shared helpers: blocks of texts, words as codes, hashed character n-grams, samples, groups."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# Bytes of text that are worked on at a time; a longer text is a block of its own.
BLOCK_BYTES = 4 << 20
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
START, END = "\x02", "\x03"
PRIME = 0x9E3779B97F4A7C15


def text_blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[pa.Array]:
    """The array in slices of at most `limit` bytes (or one row), nulls as empty texts."""
    texts = texts.fill_null("")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at, before = 0, 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield texts.slice(at, stop - at)
        at, before = stop, int(ends[stop - 1])


def release_memory() -> None:
    """Gives freed memory back, as a worker or the driver goes on to other work afterwards."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # no glibc
        pass


def by_block(texts: pa.Array, work: Callable[[pa.Array], pa.Array], limit: int = BLOCK_BYTES) -> pa.Array:
    """Applies a function to bounded slices and joins what it returns."""
    parts = [work(block) for block in text_blocks(texts, limit)]
    release_memory()
    return pa.concat_arrays(parts) if parts else work(pa.array([], pa.string()))


def struct_of(fields: dict[str, tuple[object, pa.DataType]]) -> pa.StructArray:
    return pa.StructArray.from_arrays(
        [pa.array(v, kind) for v, kind in fields.values()], names=list(fields))


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words between ASCII white space as codes.

    Returns the code of each word, the position of each text's first word (one more than
    there are texts), and the distinct words in the order of their codes.
    """
    parts = pc.ascii_split_whitespace(texts)
    flat = parts.flatten()
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
    keep = pc.greater(pc.binary_length(flat), 0)
    owner = owner[keep.to_numpy(zero_copy_only=False)]
    coded = flat.filter(keep).dictionary_encode()
    starts = np.searchsorted(owner, np.arange(len(texts) + 1))
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), starts, coded.dictionary


def split_many(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """`split_words` of many texts, a block at a time, with 32-bit codes."""
    codes, sizes, words = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], pa.array([], pa.string())
    for block in text_blocks(texts, 1 << 20):
        some, starts, spelled = split_words(block)
        both = pa.chunked_array([words, spelled]).dictionary_encode().combine_chunks()  # known words keep their codes
        codes.append(both.indices.to_numpy(zero_copy_only=False)[len(words):].astype(np.int32)[some])
        sizes.append(np.diff(starts))
        words = both.dictionary
    return np.concatenate(codes), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64), words


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def word_ngrams(words: list[str], low: int, high: int, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(index of the word, 64-bit hash) of its character n-grams, marked at both ends.

    With `whole`, the marked word itself counts as one more n-gram. Ordered by word.
    """
    marked = [START + w + END for w in words]
    points = code_points("".join(marked)).astype(np.uint64) + np.uint64(1)
    sizes = np.fromiter((len(m) for m in marked), np.int64, len(marked))
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    left = ends[owner] - np.arange(len(points)) if len(words) else np.zeros(0, np.int64)
    prime = np.uint64(PRIME)
    owners, hashes = [], []
    with np.errstate(over="ignore"):
        value = np.zeros(len(points), np.uint64)
        for n in range(1, high + 1):
            value = value[:len(points) - n + 1] * prime + points[n - 1:] if n <= len(points) else value[:0]
            if n >= low:
                inside = left[:len(value)] >= n
                owners.append(owner[:len(value)][inside])
                hashes.append(value[inside] * np.uint64(2 * n + 1))
        if whole and len(words):
            weight = prime ** (np.arange(len(points), dtype=np.uint64) - (ends - sizes).astype(np.uint64)[owner])
            owners.append(np.arange(len(words), dtype=np.int32))
            hashes.append(np.add.reduceat(points * weight, ends - sizes) * np.uint64(1_000_003))
        index, key = np.concatenate(owners or [owner]), np.concatenate(hashes or [value])
        key = (key ^ (key >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(32)
    order = np.argsort(index, kind="stable").astype(np.int32)
    return index[order], key[order]


def sums_by_start(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the slices between neighbouring starts; empty slices give 0."""
    total = np.concatenate([np.zeros((1,) + values.shape[1:]), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[starts[1:]] - total[starts[:-1]]


def local_table(spark: SparkSession, rows: list[tuple], schema: pa.Schema) -> DataFrame:
    """A local table whose size the planner knows, so it joins by broadcast only while it is small."""
    columns = list(zip(*rows)) or [()] * len(schema)
    arrays = [pa.array(c, f.type) for c, f in zip(columns, schema)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=schema))


def free_name(name: str, df: DataFrame) -> str:
    """The name, lengthened until no column has it."""
    while name in df.columns:
        name += "_"
    return name


def crc_bucket(key: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; null ids fall into no part."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(parts))


def sample_by_hash(df: DataFrame, key: str, rows: int, seed: int = 17) -> DataFrame:
    """At most `rows` rows, the first in a seeded hash order of the key (null keys left out).

    A threshold thins the table before the sort, so tasks return few rows at any size.
    """
    total = df.count()
    rank = F.xxhash64(F.col(key), F.lit(seed))
    df = df.where(F.col(key).isNotNull())
    if total > 4 * rows:
        df = df.where(F.pmod(F.shiftright(rank, 20), F.lit(1 << 30)) < int((1 << 30) * 3 * rows / total))
    return df.orderBy(rank, key).limit(rows)


class Sample(NamedTuple):
    """Labelled texts on the driver."""

    texts: pa.Array
    labels: list


def as_sample(sample: Sample | list[tuple[str, object]]) -> Sample:
    if isinstance(sample, Sample):
        return sample
    return Sample(pa.array([t for t, _ in sample], pa.string()), [label for _, label in sample])


def labelled_texts(docs: DataFrame, labels: DataFrame | None, label: str, rows: int, size: int,
                   key: str = "doc_id", text: str = "text") -> Sample:
    """A bounded sample of labelled whole texts on the driver: at most `rows` rows and `size` bytes.

    Rows come in a seeded hash order of their ids, whole texts of at most a sixteenth of `size` as
    long as their running sum stays within `size`; only these are fetched. Of several texts of one id
    the shortest counts (ties: by hash), of several labels the greatest; without `labels`, the label is
    that of the text's own row. Null ids are left out.
    """
    spark = docs.sparkSession
    own = labels is None
    source = docs.where(F.col(label).isNotNull()) if own else labels.where(F.col(label).isNotNull())
    wanted = source.groupBy(F.col(key).alias("_id")).agg(*[F.max(F.lit(0) if own else F.col(label)).alias("_given")])
    wanted = spark.createDataFrame(sample_by_hash(wanted, "_id", rows).toArrow())  # at most `rows` rows
    whole = F.coalesce(F.col(text), F.lit(""))
    texts = (source if own else docs).select(
        F.col(key).alias("_id"), whole.alias("_text"), F.octet_length(whole).cast("long").alias("_bytes"), F.xxhash64(whole).alias("_hash"),
        *([F.col(label).alias("_label")] if own else [])).where(F.col("_bytes") <= size // 16).join(F.broadcast(wanted), "_id")
    if not own:
        texts = texts.withColumnRenamed("_given", "_label")
    one = texts.groupBy("_id").agg(F.min(F.struct("_bytes", "_hash", "_label")).alias("_one")).select("_id", "_one.*")
    order = [F.xxhash64("_id", F.lit(17)), F.col("_id")]
    running = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    chosen = one.withColumns({"_used": F.sum("_bytes").over(running), "_rank": F.row_number().over(Window.orderBy(*order))}).where(F.col("_used") <= size)
    same = ["_id", "_bytes", "_hash", "_label"]
    found = texts.select("_text", *same).join(F.broadcast(chosen.select(*same, "_rank")), same).groupBy("_rank", "_label").agg(F.min("_text").alias("_text"))
    table = found.toArrow().sort_by("_rank")
    return Sample(table["_text"].combine_chunks(), table["_label"].to_pylist())


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Rebatches sorted rows so that no group of equal keys is cut."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and any(held[-1].column(k)[-1] != batch.column(k)[0] for k in keys):
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            v = batch.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
        cut = np.flatnonzero(change)
        if len(cut):
            held.append(batch.slice(0, cut[-1]))
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = [batch.slice(cut[-1])]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
