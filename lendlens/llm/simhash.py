"""SimHash near-duplicates: fingerprints, links by Hamming distance, components.

Fingerprints within `distance` bits are linked. Cut into `distance + 2` blocks, two linked
fingerprints agree on at least two whole blocks, so each pair of blocks deals distinct
fingerprints into buckets without losing a link. Within a bucket a table of Hamming distances
to reference fingerprints (pivots) decides: as |d(x, p) - d(y, p)| <= d(x, y), a pair whose
greatest coordinate difference exceeds the distance is discarded, and only survivors are
compared bit by bit. Sorted by the first pivot, a fingerprint meets only rows of near
coordinate. A bucket returns a spanning forest of its links, never all pairs. Buckets of many
fingerprints are dealt again by blocks of the bits that are left, which bounds them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lendlens.llm.common import whole_groups
from lendlens.session import materialize

SHINGLE, DISTANCE, PIVOTS = 3, 2, 16
# Rows from which a bucket is dealt again, and how many of its further blocks must agree.
LARGE_BUCKET, FURTHER = 1 << 14, 4
# Bytes of joined words whose shingles are hashed and counted at a time.
STEP = 1 << 17


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Majority bits of the XXH64 (seed 42) of all word shingles, repeats included; no words: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = min(size, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    stops = np.cumsum(lengths + 1) - 1
    begins = (stops - lengths)[:len(words) - size + 1].tolist()
    stops = stops[size - 1:].tolist()
    hash64, counts = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, len(begins), STEP):
        values = b"".join([hash64(joined[a:b], 42) for a, b in zip(begins[at:at + STEP], stops[at:at + STEP])])
        bits = np.unpackbits(np.frombuffer(values, np.uint8)).reshape(-1, 64)
        even = len(bits) // 255 * 255  # so many bits add up within a byte
        counts += np.add.reduce(bits[:even].reshape(-1, 255, 64), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        counts += bits[even:].sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(begins)).tobytes(), "big")


def simhash(text: Column, size: int = SHINGLE) -> Column:
    """The fingerprint as a signed long."""
    @F.arrow_udf(T.LongType())
    def values(texts: pa.Array) -> pa.Array:
        found = np.fromiter((fingerprint(t.as_py(), size) for t in texts), np.uint64, len(texts))
        return pa.array(found.view(np.int64))
    return values(text)


def components_of(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Smallest node reachable over the links, for nodes 0..n-1."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], least)
        np.minimum.at(new, label[v], least)
        new = new[new]
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return label
        label = new


def bucket_links(bucket: np.ndarray, values: np.ndarray, pivots: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within buckets; rows are sorted by bucket, then first pivot."""
    table = np.stack([np.bitwise_count(values ^ p) for p in pivots]).astype(np.int8)
    n, live, step = len(values), np.arange(len(values)), 1
    forest = np.arange(n)
    us, vs, held = [], [], 0

    def fold() -> None:
        nonlocal forest, us, vs, held
        if held:
            u, v = np.concatenate(us), np.concatenate(vs)
            forest = components_of(np.concatenate([u, np.arange(n)]), np.concatenate([v, forest]), n)
        us, vs, held = [], [], 0

    while len(live):
        live = live[live + step < n]
        near = bucket[live] == bucket[live + step]
        near &= table[0, live + step] - table[0, live] <= distance
        live = live[near]  # a row that has left its range stays out at larger steps
        pair = live
        for row in table[1:]:
            if not len(pair):
                break
            pair = pair[np.abs(row[pair + step] - row[pair]) <= distance]
        pair = pair[np.bitwise_count(values[pair] ^ values[pair + step]) <= distance]
        if len(pair):
            us.append(pair), vs.append(pair + step)
            held += len(pair)
            if held > 1 << 20:
                fold()
        step += 1
    fold()
    own = np.flatnonzero(forest != np.arange(n))
    return values[own], values[forest[own]]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def split_buckets(rows: DataFrame, large: DataFrame, column: str, masks: list[int], distance: int) -> DataFrame:
    """Deals the rows of large buckets again, by blocks of the bits that may still differ.

    Those bits are cut into `FURTHER` + `distance` blocks, of which linked rows share at least
    `FURTHER`; a row goes to a bucket for each such choice. No link is lost, and what is left to
    differ in one bucket is a few bits, so its distinct fingerprints are bounded.
    """
    choices = list(combinations(range(len(masks)), 2))
    deals = []
    for number, (a, b) in enumerate(choices):
        held = masks[a] | masks[b]
        free = [1 << i for i in range(64) if not held >> i & 1]
        size = FURTHER + distance
        blocks = [sum(free[len(free) * i // size:len(free) * (i + 1) // size]) for i in range(size)]
        deals.append(F.array(*[
            F.struct(F.lit(len(choices) * (i + 1) + number).alias("part"), F.col(column).bitwiseAND(F.lit(signed(held | sum(blocks[x] for x in chosen)))).alias("bucket"))
            for i, chosen in enumerate(combinations(range(size), FURTHER))]))
    known = rows.join(large, ["part", "bucket"], "left")
    own = F.array(F.struct("part", "bucket"))
    again = F.when(F.col("n").isNull(), own)
    for number, deal in enumerate(deals):
        again = again.when(F.col("part") == number, deal)
    return known.select("d0", column, F.explode(again).alias("k")).select("k.*", "d0", column)


def hamming_links(prints: DataFrame, column: str = "fp", distance: int = DISTANCE, pivots: int = PIVOTS,
                  large_bucket: int = LARGE_BUCKET) -> DataFrame:
    """Links (u, v) between distinct fingerprints that connect all within the distance.

    Buckets of more than `large_bucket` rows are dealt again by further blocks.
    """
    blocks = distance + 2
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    parts = [F.struct(F.lit(i).alias("part"), F.col(column).bitwiseAND(F.lit(signed(masks[a] | masks[b]))).alias("bucket"))
             for i, (a, b) in enumerate(combinations(range(blocks), 2))]
    marks = np.random.default_rng(64).integers(0, 1 << 64, pivots, dtype=np.uint64)
    first = F.bit_count(F.col(column).bitwiseXOR(F.lit(int(marks.view(np.int64)[0]))))
    rows = prints.select(column, F.explode(F.array(*parts)).alias("k")).select("k.*", first.alias("d0"), column)
    large = materialize(rows.groupBy("part", "bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > large_bucket), "large")
    if large.first():
        rows = split_buckets(rows, large, column, masks, distance)
    dealt = rows.repartition("part", "bucket").sortWithinPartitions("part", "bucket", "d0", column)

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, ["part", "bucket"]):
            part, bucket = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("part", "bucket"))
            change = np.ones(len(part), np.int64)
            change[1:] = (part[1:] != part[:-1]) | (bucket[1:] != bucket[:-1])
            values = batch.column(column).to_numpy(zero_copy_only=False).view(np.uint64)
            u, v = bucket_links(np.cumsum(change), values, marks, distance)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    return dealt.mapInArrow(links, "u long, v long").distinct()


def connected_roots(links: DataFrame) -> DataFrame:
    """(node, root) for every linked node, by alternating large and small stars.

    A hub is reduced by a grouped minimum and a join, so no list of neighbours is built.
    """
    state = materialize(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "links")
    mark = None
    while True:
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .unionByName(small.select("u", F.col("m").alias("v"))).distinct()
        state = materialize(small, "small")
        now = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == mark:
            return state.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    distance: int = DISTANCE, pivots: int = PIVOTS) -> DataFrame:
    """(key, fp, component): the smallest key in reach of each row's fingerprint.

    Null and empty texts have fingerprint 0 and are linked like any other. Rows that repeat
    return once each. Null keys are never the smallest; a component of null keys only has
    component null. An empty table returns no rows.
    """
    prints = materialize(docs.select(F.col(key).alias("id"), simhash(F.col(text), shingle).alias("fp")), "prints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    roots = connected_roots(hamming_links(distinct, "fp", distance, pivots))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left") \
        .select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component")), "root").select("fp", "component")
    return prints.join(named, "fp").select(F.col("id").alias(key), "fp", "component")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One document of each group: the one with the smallest key; all columns are kept.

    Rows with the same key are one document, of which the smallest text stays (of equal texts, any
    row). Rows without a key cannot be told apart and stay.
    """
    found = near_duplicates(docs, key, text, **how)
    chosen = materialize(found.groupBy(F.col(key).alias("_keep")).agg(
        F.count(F.lit(1)).alias("_rows"), F.max((F.col(key) == F.col("component")).cast("int")).alias("_least")).where("_least = 1"), "chosen")
    # The document travels as one struct: none of its columns can clash. Only keys of several rows are
    # grouped; tasks bring such a key down to one row before the shuffle.
    rows = docs.select(docs[key].alias("_key"), F.struct(docs[text]).alias("_order"), F.struct(*[docs[c] for c in docs.columns]).alias("_document"))
    kept = rows.join(chosen, F.col("_key") == F.col("_keep"))
    several = kept.where("_rows > 1").groupBy("_key").agg(F.min_by("_document", "_order").alias("_document"))
    return kept.where("_rows = 1").select("_document").unionByName(several.select("_document")).select("_document.*") \
        .unionByName(docs.where(docs[key].isNull()))
