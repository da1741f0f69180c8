"""Conversation prefix trie by van Emde Boas recursion over depths.

Sequences are cut at half depth. The first half of each gets a name, made from the name of what
stands before it and the turns in it; the upper trie (first halves) and the lower forests (second
halves, rooted at those names) are then independent problems of half the depth. All problems of
one size are solved by the same joins, so a trie of depth T takes log2(T) rounds, not T. On the
way back, the totals of each lower forest are grafted onto the ancestors of its root.

Nothing is held per conversation: turns are rows, and the rows of a long conversation are dealt
over chunks of positions. A node that many conversations share is dealt over salts.

Names are 128 bits of hashes; two different prefixes share one with probability 2^-128.

Defined cases: rows without an id belong to no conversation; null role or text is empty; null turns
come first; turns of one number are ordered by a hash of role and text, so repeated rows are turns of
their own; no rows give no nodes; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from lendlens.session import materialize

# Positions of a conversation that may meet in one task: a power of two.
CHUNK = 1 << 16
# A node with more than a share of all turns is hot; so there are at most as many as this.
HOT_NODES, HOT_SALTS = 4096, 64
ROWS_PER_PART = 1 << 20
NODE = ["p", "r1", "r2", "k1", "k2"]


def hashed(*columns: object, seed: int) -> Column:
    return F.xxhash64(*[c if isinstance(c, Column) else F.col(c) for c in columns], F.lit(seed))


def parts_for(df: DataFrame) -> int:
    session = df.sparkSession
    return max(int(session.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // ROWS_PER_PART))


def place_in_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the rows of each conversation in a sorted part, from 1."""
    last, so_far = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column("conv_id").to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.append(True, conv[1:] != conv[:-1]))
        begin = np.repeat(starts, np.diff(np.append(starts, len(conv))))
        place = np.arange(len(conv)) - begin + 1
        if conv[0] == last:
            place[begin == 0] += so_far
        last, so_far = conv[-1], int(place[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place, pa.int64())], names=[*batch.schema.names, "place"])


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, p (1 for the first turn), k1, k2 (name of role and text), chars (code points of the text).

    Rows are ordered by ranges of (id, turn), so a conversation of any length is dealt over tasks;
    only where it crosses a border of ranges do earlier counts shift its places.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    content = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", content.alias("content"), F.char_length(text).cast("long").alias("chars"))
    rows = materialize(rows.select("conv_id", "turn", hashed("content", seed=1).alias("k1"), hashed("content", seed=2).alias("k2"),
                                   "chars", F.rand(5).alias("spread")), "turns")
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("k1"), F.col("k2"), F.col("spread")]
    dealt = rows.repartitionByRange(parts_for(rows), *order).sortWithinPartitions(*order).select(
        "conv_id", "k1", "k2", "chars", F.spark_partition_id().alias("part"))
    placed = materialize(dealt.mapInArrow(place_in_part, "conv_id long, k1 long, k2 long, chars long, part int, place long"), "placed")
    # At most one conversation crosses each border, so this table has at most two rows per part.
    ends = placed.groupBy("part").agg(F.min("conv_id").alias("low"), F.max("conv_id").alias("high"))
    border = ends.select(F.explode(F.array("low", "high")).alias("conv_id")).distinct()
    counts = placed.join(F.broadcast(border), "conv_id").groupBy("conv_id", "part").agg(F.max("place").alias("held"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("conv_id", "part", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("shift"))
    return placed.join(F.broadcast(shifts), ["conv_id", "part"], "left").select(
        "conv_id", (F.col("place") + F.coalesce("shift", F.lit(0))).alias("p"), "k1", "k2", "chars")


def chunk_of(position: Column) -> Column:
    return F.shiftright((position - 1).cast("long"), CHUNK.bit_length() - 1)


def lengths(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conv_id").agg(F.max("p").alias("n"))


def with_length(turns: DataFrame, sizes: DataFrame, columns: list[str]) -> DataFrame:
    """Adds columns of the conversation to its turns; a long conversation is joined chunk by chunk."""
    chunks = F.explode(F.sequence(F.lit(0).cast("long"), chunk_of(F.greatest("own", F.lit(1).cast("long")))))
    spread = sizes.select("conv_id", *columns, chunks.alias("chunk"))
    return turns.withColumn("chunk", chunk_of(F.col("p"))).join(spread, ["conv_id", "chunk"]).drop("chunk")


def rebuilt(turns: DataFrame, h: Column, base: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Each conversation's first `h` turns replaced by the first `h` of conversation `base`.

    `h` (at most `most`) and `base` are expressions of conv_id. Returns turns (conv_id, p, n, k1, k2,
    chars) and sizes (conv_id, n), the latter with conversations that lost all turns.
    """
    turns = materialize(turns, "numbered")
    own = lengths(turns).withColumnRenamed("n", "own").withColumns({"h": h.cast("long"), "base": base})
    heads = turns.where(F.col("p") <= most).groupBy(
        F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("p", "k1", "k2", "chars"))).alias("head"))
    sizes = own.join(heads, "base", "left").withColumn("head", F.filter(
        F.coalesce("head", F.array().cast("array<struct<p:bigint,k1:bigint,k2:bigint,chars:bigint>>")), lambda t: t["p"] <= F.col("h")))
    sizes = sizes.withColumn("taken", F.size("head").cast("long")).withColumn(
        "n", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    sizes = materialize(sizes, "sizes")
    first = sizes.select("conv_id", "n", F.explode("head").alias("t")).select("conv_id", "t.p", "n", "t.k1", "t.k2", "t.chars")
    rest = with_length(turns, sizes, ["n", "h", "taken"]).where(F.col("p") > F.col("h")).select(
        "conv_id", (F.col("p") - F.col("h") + F.col("taken")).alias("p"), "n", "k1", "k2", "chars")
    return first.unionByName(rest), sizes.select("conv_id", "n")


def halves(length: int) -> tuple[Column, Column]:
    """Number of the segment of a position, and its offset in there."""
    segment = F.shiftright((F.col("p") - 1).cast("long"), length.bit_length() - 1)
    return segment, F.col("p") - 1 - segment * length


def named(turns: DataFrame, depth: int) -> DataFrame:
    """Adds r1, r2: the name of all that stands before a turn, equal for equal prefixes of that length."""
    rows = turns.withColumns({"r1": F.lit(0).cast("long"), "r2": F.lit(0).cast("long")})
    length = depth
    while length > 1:
        half = length // 2
        segment, offset = halves(length)
        rows = rows.withColumns({"segment": segment, "offset": offset})
        cut = F.col("segment") * length + half
        names = rows.where((F.col("offset") < half) & (F.col("n") > cut)).groupBy("conv_id", "segment", "n", "r1", "r2").agg(
            F.bit_xor(hashed("offset", "k1", "k2", seed=3)).alias("x1"), F.bit_xor(hashed("offset", "k1", "k2", seed=4)).alias("x2"))
        last = F.least(F.col("segment") * length + length, F.col("n"))
        names = names.select(
            "conv_id", "segment", hashed("r1", "r2", "x1", "x2", seed=5).alias("m1"), hashed("r1", "r2", "x1", "x2", seed=6).alias("m2"),
            F.explode(F.sequence(chunk_of(cut + 1), chunk_of(last))).alias("chunk"))
        lower = F.col("offset") >= half
        joined = rows.where(lower).withColumn("chunk", chunk_of(F.col("p"))).join(names, ["conv_id", "segment", "chunk"])
        rows = materialize(rows.where(~lower).select(*turns.columns, "r1", "r2").unionByName(
            joined.select(*turns.columns, F.col("m1").alias("r1"), F.col("m2").alias("r2"))), "names")
        length = half
    return rows


def owned(rows: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """Nodes (p, owner, n_convs, chars) and paths (conv_id, p, n, owner).

    A node's owner is its smallest member; depth and owner identify it.
    """
    found = materialize(rows.groupBy(*NODE).agg(
        F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n_convs"), F.min("chars").alias("chars")), "nodes")
    hot = found.where(F.col("n_convs") > total / HOT_NODES).select(*NODE, F.lit(HOT_SALTS).alias("salts"))
    salt = F.pmod(hashed("conv_id", seed=7), F.coalesce("salts", F.lit(1))).cast("int")
    salted = rows.join(F.broadcast(hot), NODE, "left").select(*NODE, "conv_id", "n", salt.alias("salt"))
    copies = F.when(F.col("n_convs") > total / HOT_NODES, HOT_SALTS).otherwise(1)
    spread = found.select(*NODE, "owner", F.explode(F.sequence(F.lit(0), copies - 1)).alias("salt"))
    paths = salted.join(spread, [*NODE, "salt"]).select("conv_id", "p", "n", "owner")
    return found.select("p", "owner", "n_convs", "chars"), materialize(paths, "paths")


def grafted(nodes: DataFrame, paths: DataFrame, depth: int, totals: list[str]) -> DataFrame:
    """Sums `totals` of `nodes` (p, owner, parent, totals) over each node's subtree.

    Before the round of a length, sums reach over half of it; the round adds the sum of each lower
    forest to the nodes above its root in the upper half of the segment.
    """
    length = 2
    while length <= depth:
        half = length // 2
        segment, offset = halves(length)
        roots = nodes.where(offset == half).groupBy((F.col("p") - 1).alias("p"), "parent").agg(*[F.sum(c).alias(c) for c in totals])
        upper = roots.select(F.col("parent").alias("conv_id"), segment.alias("segment"), *totals,
                             F.explode(F.sequence(chunk_of(segment * length + 1), chunk_of(F.col("p")))).alias("chunk"))
        above = paths.where(offset < half).select("conv_id", "p", "owner", segment.alias("segment"), chunk_of(F.col("p")).alias("chunk"))
        more = above.join(upper, ["conv_id", "segment", "chunk"]).select("p", "owner", F.lit(None).cast("long").alias("parent"), *totals)
        nodes = materialize(nodes.select(*more.columns).unionByName(more).groupBy("p", "owner").agg(
            F.max("parent").alias("parent"), *[F.sum(c).alias(c) for c in totals]), "totals")
        length *= 2
    return nodes


def joined_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (depth, owner, conv_id) rows as pieces: the ids of one node in a batch, joined by commas."""
    for batch in batches:
        if not batch.num_rows:
            continue
        depth, owner, conv = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("depth", "owner", "conv_id"))
        starts = np.flatnonzero(np.append(True, (depth[1:] != depth[:-1]) | (owner[1:] != owner[:-1])))
        offsets = np.append(starts, len(conv)).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(offsets), pc.cast(batch.column("conv_id"), pa.string()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(depth[starts]), pa.array(owner[starts]), pa.array(conv[starts]), pc.binary_join(ids, ",")],
            names=["depth", "owner", "first", "piece"])


def hashed_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces, which come in order; one piece is held at a time."""
    at, state, done = None, None, []

    def made() -> pa.RecordBatch:
        depth, owner, value = zip(*done)
        return pa.RecordBatch.from_arrays([pa.array(depth, pa.int64()), pa.array(owner, pa.int64()), pa.array(value)],
                                          names=["depth", "owner", "ends_sha256"])
    for batch in batches:
        for depth, owner, piece in zip(*(batch.column(c).to_pylist() for c in ("depth", "owner", "piece"))):
            if (depth, owner) == at:
                state.update(b"," + piece.encode())
                continue
            if at is not None:
                done.append((*at, state.hexdigest()))
            at, state = (depth, owner), hashlib.sha256(piece.encode())
        if done:
            yield made()
            done = []
    if at is not None:
        done.append((*at, state.hexdigest()))
        yield made()


def end_digests(ends: DataFrame) -> DataFrame:
    """depth, owner, ends_sha256 of rows (depth, owner, conv_id).

    Ids are sorted and joined over ranges that split large nodes; one task then hashes the pieces
    of a node, which a single digest of all its ids asks for.
    """
    ends = materialize(ends, "ends")
    order = ["depth", "owner", "conv_id"]
    pieces = ends.repartitionByRange(parts_for(ends), *order).sortWithinPartitions(*order).mapInArrow(
        joined_pieces, "depth long, owner long, first long, piece string")
    return pieces.repartition("depth", "owner").sortWithinPartitions("depth", "owner", "first").mapInArrow(
        hashed_pieces, "depth long, owner long, ends_sha256 string")


def prefix_trie(turns: DataFrame, sizes: DataFrame) -> DataFrame:
    """All nodes of the trie of turns (conv_id, p, n, k1, k2, chars) of the conversations in sizes (conv_id, n).

    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 per node.
    """
    turns = materialize(turns, "rebuilt")
    sizes = materialize(sizes, "members")
    facts = sizes.agg(F.count(F.lit(1)).alias("convs"), F.min("conv_id").alias("first"), F.max("n").alias("deepest"),
                      F.sum("n").alias("turns")).first()
    depth = 1
    while depth < (facts["deepest"] or 0):
        depth *= 2
    nodes, paths = owned(named(turns, depth), facts["turns"] or 0)
    step = paths.select(F.col("conv_id").alias("owner"), (F.col("p") + 1).alias("p"), F.col("owner").alias("parent"))
    nodes = nodes.join(step, ["p", "owner"], "left").withColumn(
        "parent", F.when(F.col("p") == 1, F.lit(facts["first"]).cast("long")).otherwise(F.col("parent")))
    nodes = materialize(nodes, "linked")
    children = nodes.groupBy((F.col("p") - 1).alias("p"), F.col("parent").alias("owner")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = materialize(nodes.join(children, ["p", "owner"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")), "family")
    own = nodes.select("p", "owner", "parent", (F.col("n_children") == 0).cast("long").alias("n_leaves"),
                       ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))
    totals = grafted(own, paths, depth, ["n_leaves", "saved_tokens"])
    below = nodes.drop("chars").join(totals.drop("parent"), ["p", "owner"])
    top = totals.where(F.col("p") == 1).agg(
        F.count(F.lit(1)).alias("n_children"), F.coalesce(F.sum("n_leaves"), F.lit(1)).alias("n_leaves"),
        F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens"))
    root = top.where(F.lit(facts["convs"] > 0)).select(
        F.lit(0).cast("long").alias("p"), F.lit(facts["first"]).cast("long").alias("owner"), F.lit(facts["convs"]).cast("long").alias("n_convs"),
        F.lit(None).cast("long").alias("parent"), "n_children", "n_leaves", "saved_tokens")
    ends = paths.where(F.col("p") == F.col("n")).select(F.col("p").alias("depth"), "owner", "conv_id").unionByName(
        sizes.where(F.col("n") == 0).select(F.lit(0).cast("long").alias("depth"), F.lit(facts["first"]).cast("long").alias("owner"), "conv_id"))
    digests = end_digests(ends).withColumnRenamed("depth", "p")
    return below.unionByName(root).join(digests, ["p", "owner"], "left").select(
        F.col("owner").alias("conv_id"), F.col("p").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", "n_children",
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
