"""Document fingerprints: a Merkle tree over sections, paragraphs and short runs of words.

A paragraph is a line; a section begins after a blank line or at a heading. A leaf is a sentence,
cut after eight words, with the blanks around it, so the leaves of a paragraph join to the
paragraph. Every node is hashed from the hashes below it: equal roots mean equal texts, and
where roots differ, the branches that differ locate the edit. The likeness of two trees is the
share of their characters in leaves of equal hash (Dice), counted with repeats.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

LEAF = re.compile(r"[^\S\n]*(?:\S*[^\s.!?][^\S\n]+){0,7}\S+|[^\S\n]+")
HASH_BYTES = 16
# Bytes of text that one task sorts when documents are ordered to find the next one.
TASK_BYTES = 32 << 20
LEAST = -(1 << 63)


def digest(level: bytes, content: bytes) -> bytes:
    return hashlib.blake2b(content, digest_size=HASH_BYTES, person=level).digest()


class Tree:
    """Root, sections [(hash, first paragraph)], paragraphs [(hash, start, stop)], leaves {hash: characters}."""

    __slots__ = ("root", "sections", "paragraphs", "leaves", "size")

    def __init__(self, text: str | None) -> None:
        text = text or ""
        self.size, self.leaves = 0, {}
        self.paragraphs, self.sections = [], []
        at, held, blank, leaves = 0, [], False, self.leaves
        for line in text.split("\n"):
            stop = at + len(line)
            parts = []
            for piece in LEAF.findall(line):
                h = digest(b"leaf", piece.encode("utf-8", "surrogatepass"))
                parts.append(h)
                leaves[h] = leaves.get(h, 0) + len(piece)
                self.size += len(piece)
            if held and (line.startswith("#") or blank and parts):
                self.close(held)
                held = []
            blank = not parts
            held.append(digest(b"paragraph", b"".join(parts)))
            self.paragraphs.append((held[-1], at, stop))
            at = stop + 1
        self.close(held)
        self.root = digest(b"root", b"".join(h for h, _ in self.sections))

    def close(self, held: list[bytes]) -> None:
        self.sections.append((digest(b"section", b"".join(held)), len(self.paragraphs) - len(held)))

    def likeness(self, other: Tree) -> float:
        if self.root == other.root:
            return 1.0
        if not self.size + other.size:
            return 0.0
        few, many = (self.leaves, other.leaves) if len(self.leaves) < len(other.leaves) else (other.leaves, self.leaves)
        return 2 * sum(min(n, many[h]) for h, n in few.items() if h in many) / (self.size + other.size)

    def edits(self, other: Tree) -> list[tuple[int, int]]:
        """Places (start, stop) of this text's paragraphs that the other lacks, from the root down."""
        if self.root == other.root:
            return []
        there = Counter(h for h, _ in other.sections)
        lines = Counter(h for h, _, _ in other.paragraphs)
        found, ends = [], [f for _, f in self.sections[1:]] + [len(self.paragraphs)]
        for (h, first), last in zip(self.sections, ends):
            if there[h] > 0:
                there[h] -= 1
                lines.subtract(p for p, _, _ in self.paragraphs[first:last])
                continue
            for p, start, stop in self.paragraphs[first:last]:
                if lines[p] > 0:
                    lines[p] -= 1
                else:
                    found.append((start, stop))
        return found


NODE = "struct<hash:string,start:int,stop:int>"


def merkle(text: Column) -> Column:
    """Struct of root, section hashes and paragraphs with their places; a null text is an empty one."""
    @F.arrow_udf(f"struct<root:string,sections:array<string>,paragraphs:array<{NODE}>>")
    def trees(texts: pa.Array) -> pa.Array:
        kind = pa.struct([("root", pa.string()), ("sections", pa.list_(pa.string())), ("paragraphs", pa.list_(
            pa.struct([("hash", pa.string()), ("start", pa.int32()), ("stop", pa.int32())])))])
        built = (Tree(t.as_py()) for t in texts)
        return pa.array([{"root": t.root.hex(), "sections": [h.hex() for h, _ in t.sections], "paragraphs": [
            {"hash": h.hex(), "start": a, "stop": b} for h, a, b in t.paragraphs]} for t in built], kind)
    return trees(text)


def likeness(left: Column, right: Column) -> Column:
    @F.arrow_udf("double")
    def values(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([Tree(x.as_py()).likeness(Tree(y.as_py())) for x, y in zip(a, b)], pa.float64())
    return values(left, right)


def edits(left: Column, right: Column) -> Column:
    """Places of the left text's paragraphs that the right text lacks."""
    @F.arrow_udf("array<struct<start:int,stop:int>>")
    def places(a: pa.Array, b: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        return pa.array([[{"start": s, "stop": e} for s, e in Tree(x.as_py()).edits(Tree(y.as_py()))]
                         for x, y in zip(a, b)], kind)
    return places(left, right)


RESULT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()),
    T.StructField("edited_sha256", T.StringType()), T.StructField("fingerprint", T.StringType()),
    T.StructField("edited_fingerprint", T.StringType()), T.StructField("near_edited", T.DoubleType()),
    T.StructField("near_next", T.DoubleType()), T.StructField("edit_start", T.LongType())])


def edit_report(docs: DataFrame, key: str = "doc_id", text: str = "text", task_bytes: int = TASK_BYTES) -> DataFrame:
    """Fingerprints of each text and of the text with its last third replaced from the next document.

    The next document is the one of the next smaller key, after the smallest the greatest one;
    rows of equal keys follow by text, null keys come last, and null texts are empty. A single
    document is its own next. `edit_start` is where the first differing paragraph begins (null:
    none differs). Whole texts move once: into ranges of keys, sorted there. The first document
    of a range is also sent to the range before, as that one's next.
    """
    spark = docs.sparkSession
    k = F.coalesce(docs[key].cast("long"), F.lit(LEAST))
    volume, rows = docs.agg(F.sum(F.octet_length(text)), F.count(F.lit(1))).first()
    ranges = max(1, min(rows, -(-((volume or 0) + 64 * rows) // task_bytes)))
    ids = docs.select(k.alias("k"))
    bounds = [] if ranges == 1 else ids.agg(F.percentile_approx(
        "k", [i / ranges for i in range(1, ranges)], F.lit(100 * ranges))).first()[0]
    bounds = np.unique(np.array(bounds or [], np.int64))
    shared = spark.sparkContext.broadcast(bounds)

    @F.arrow_udf("int")
    def range_of(keys: pa.Array) -> pa.Array:  # great keys first
        limits = shared.value
        return pa.array(len(limits) - np.searchsorted(limits, keys.to_numpy(zero_copy_only=False)), pa.int32())

    tops = {r["p"]: r["k"] for r in ids.select(range_of(F.col("k")).alias("p"), "k")
            .groupBy("p").agg(F.max("k").alias("k")).collect()}
    order = sorted(tops)  # a range may be empty
    before = {tops[p]: order[i - 1] for i, p in enumerate(order)}
    heads = spark.sparkContext.broadcast(before)

    @F.arrow_udf("array<int>")
    def places(keys: pa.Array) -> pa.Array:
        limits, first = shared.value, heads.value
        values = keys.to_numpy(zero_copy_only=False)
        own = len(limits) - np.searchsorted(limits, values)
        return pa.array([[p, first[v]] if v in first else [p] for p, v in zip(own.tolist(), values.tolist())],
                        pa.list_(pa.int32()))

    dealt = docs.select(k.alias("k"), F.col(text).alias("t")).select("k", "t", F.posexplode(places(F.col("k"))).alias("copy", "p")) \
        .repartition(len(order) or 1, "p").sortWithinPartitions("p", "copy", F.desc("k"), "t")

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in RESULT]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
        last = None  # (range, is a copy, key, text, tree)
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                value = lambda name: batch.column(name)[i].as_py()  # noqa: E731, B023
                place, copy, own, body = value("p"), value("copy"), value("k"), value("t") or ""
                if last and last[1] and place == last[0]:
                    continue  # a repeated row of the next range's first document
                here = (place, copy, own, body, Tree(body))
                if last and place == last[0]:
                    _, _, last_key, last_text, tree = last
                    n = len(last_text)
                    edited = last_text[:n - n // 3] + body[:n // 3]
                    other = Tree(edited)
                    moved = tree.edits(other)
                    out.append((None if last_key == LEAST else last_key, n,
                                hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
                                tree.root.hex(), other.root.hex(), tree.likeness(other), tree.likeness(here[4]),
                                moved[0][0] if moved else None))
                last = here
            yield pa.RecordBatch.from_arrays(
                [pa.array([row[c] for row in out], kind) for c, kind in enumerate(kinds)], names=names)

    return dealt.mapInArrow(report, RESULT)
