"""Quality rules: counts of words, symbols and repeats, and bands of n-gram perplexity.

The language model is over the characters of texts, one per language: a word follows the mark of
its start, before which stand the last signs of the word before, so n-grams reach over the border
of words and their order counts. Spark counts the n-grams of all documents, and modified
Kneser-Ney turns counts into probabilities, level by level. An n-gram that begins a text keeps
its count on lower levels, the others count the signs seen before them. Probabilities and
back-off weights are stored as sorted arrays of 64-bit hashes and found by binary search. Arrays
of at most MODEL_ROWS entries are broadcast; beyond that words and their borders are scored once
each by joins, with the same result.

Bands are set per language around the quartiles of the log perplexity of all its documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lendlens.llm.common import END, PRIME, SPACES, START, WORD, code_points, split_words, struct_of, sums_by_start, text_blocks
from lendlens.session import materialize

ORDER = 4
MODEL_ROWS = 4_000_000  # 16 bytes each
SPREAD = 4.0  # quartile ranges beyond the quartiles
SYMBOLS = "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 50, 50
GRAMS_HELD = 400_000
BLOCK = 8 << 20  # bytes of text at a time: large blocks repeat fewer words


def gram_keys(tokens: list[str], lang: str, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, str]:
    """For every sign of the tokens: hashes of the n-grams inside its token that end there.

    Returns (order, signs) hashes, 0 where the token is too short; the token of each sign; the
    length of the longest n-gram; and the joined text, whose signs they are in order.
    """
    text = "".join(tokens)
    points = code_points(text).astype(np.uint64) + np.uint64(1)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    owner = np.repeat(np.arange(len(tokens)), sizes)
    place = np.arange(len(points)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    seed = np.uint64(xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass")))
    keys = np.zeros((order + 1, len(points)), np.uint64)
    with np.errstate(over="ignore"):
        value, power = np.zeros(len(points), np.uint64), np.uint64(1)
        for n in range(1, order + 1):
            value[n - 1:] += points[:max(len(points) - n + 1, 0)] * power
            power *= np.uint64(PRIME)
            keys[n] = np.where(place >= n - 1, mixed(value, n, seed), np.uint64(0))
        keys[0] = mixed(np.zeros(1, np.uint64), 0, seed)
    return keys, owner, np.minimum(place + 1, order), text


def marked_words(words: list[str]) -> list[str]:
    return [START + w + END for w in words]


def border_grams(codes: np.ndarray, starts: np.ndarray, words: pa.Array, mine: np.ndarray,
                 order: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[str]]]:
    """The n-grams of each word's first signs, which reach into the word before it in its text.

    For the first, second ... sign (the end mark counts): the places in `codes` that have it, the
    number of each place's n-gram, and the distinct n-grams. They hold the last signs of the word
    before, or that whole word with its start mark; a text's first word has nothing before it.
    """
    first = np.zeros(len(codes) + 1, bool)
    first[starts[:-1]] = True
    sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    before = pc.binary_join_element_wise(pa.scalar(START), words, pa.scalar(""))
    after = pc.binary_join_element_wise(words, pa.scalar(END), pa.scalar(""))
    for sign in range(order - 2):
        at = mine[sizes[codes[mine]] >= sign]
        tails = pc.utf8_slice_codeunits(before, start=sign - (order - 2)).dictionary_encode()
        heads = pc.utf8_slice_codeunits(after, start=0, stop=sign + 1).dictionary_encode()
        some, many = len(tails.dictionary), max(len(heads.dictionary), 1)
        tail = tails.indices.to_numpy(zero_copy_only=False).astype(np.int64)[codes[at - 1]]
        pair = np.where(first[at], some, tail) * many + heads.indices.to_numpy(zero_copy_only=False).astype(np.int64)[codes[at]]
        if (some + 1) * many <= 8 * len(pair):
            distinct = np.flatnonzero(np.bincount(pair, minlength=(some + 1) * many))
            number = np.zeros((some + 1) * many, np.int64)
            number[distinct] = np.arange(len(distinct))
            which = number[pair]
        else:
            distinct, which = np.unique(pair, return_inverse=True)
        left, right = tails.dictionary.to_pylist() + [""], heads.dictionary.to_pylist()
        yield at, which, [left[t] + START + right[h] for t, h in zip((distinct // many).tolist(), (distinct % many).tolist())]


def mixed(value: np.ndarray, n: int, seed: np.uint64) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = value + seed + np.uint64(n) * np.uint64(0xC2B2AE3D27D4EB4F)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def hash_of(grams: list[str], langs: list[str]) -> np.ndarray:
    """The hash of whole n-grams, as `gram_keys` has them."""
    found = np.zeros(len(grams), np.uint64)
    by_kind: dict[tuple[str, int], list[int]] = {}
    for i, (g, lang) in enumerate(zip(grams, langs)):
        by_kind.setdefault((lang, len(g)), []).append(i)
    for (lang, n), at in by_kind.items():
        points = code_points("".join(grams[i] for i in at)).astype(np.uint64).reshape(len(at), n) + np.uint64(1)
        with np.errstate(over="ignore"):
            power = np.uint64(PRIME) ** np.arange(n - 1, -1, -1, dtype=np.uint64)
            value = (points * power).sum(1, dtype=np.uint64) if n else np.zeros(len(at), np.uint64)
        found[at] = mixed(value, n, np.uint64(xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"))))
    return found


def no_null(lang: Column) -> Column:
    return F.coalesce(lang, F.lit(""))


def count_grams(docs: DataFrame, text: str = "text", lang: str = "lang", order: int = ORDER) -> DataFrame:
    """(lang, gram, n): for every sign of every word the longest n-gram that ends there, over all documents.

    It has `order` signs, or begins with a start mark. `order` is 3 or more.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([
                pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.string()),
                pa.array(list(held.values()), pa.int64())], names=["lang", "gram", "n"])
            held.clear()
            return batch

        for batch in batches:
            langs, at = np.array(batch.column(0).to_pylist(), object), 0
            for block in text_blocks(batch.column(1), BLOCK):
                codes, starts, words = split_words(pc.utf8_lower(block))
                own = np.repeat(langs[at:at + len(block)], np.diff(starts))
                at += len(block)
                for name in dict.fromkeys(own.tolist()):
                    mine = np.flatnonzero(own == name)
                    times = np.bincount(codes[mine], minlength=len(words))
                    seen = np.flatnonzero(times)
                    keys, owner, longest, joined = gram_keys(marked_words(words.take(pa.array(seen)).to_pylist()), name, order)
                    ends = np.flatnonzero(longest == order)
                    _, first, place = np.unique(keys[order, ends], return_index=True, return_inverse=True)
                    sums = np.bincount(place, times[seen][owner[ends]]).astype(np.int64)
                    for end, total in zip(ends[first].tolist(), sums.tolist()):
                        held[name, joined[end - order + 1:end + 1]] += total
                    for _, which, grams in border_grams(codes, starts, words, mine, order):
                        for gram, total in zip(grams, np.bincount(which, minlength=len(grams)).tolist()):
                            held[name, gram] += total
                if len(held) > GRAMS_HELD:
                    yield flush()
        yield flush()

    counted = docs.select(no_null(F.col(lang)).alias("lang"), F.col(text).alias("text")) \
        .mapInArrow(count, "lang string, gram string, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def local(per_language: DataFrame) -> DataFrame:
    """A few numbers per language as a table whose size Spark knows when it plans the join."""
    return per_language.sparkSession.createDataFrame(per_language.toArrow())


def kneser_ney(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, value, kind): log probability of each n-gram (kind `p`), log weight of each context (kind `w`)."""
    top = materialize(grams, "grams")
    levels = {order: top.where(F.length("gram") == order).select("lang", "gram", F.col("n").alias("a"))}
    for k in range(order - 1, 0, -1):
        # A word's first n-grams follow other words and, in shorter form, begin texts.
        before = levels[k + 1].select("lang", F.expr("substring(gram, 2)").alias("gram"), F.lit(1).cast("long").alias("a"))
        opening = top.where((F.length("gram") == k) & F.col("gram").startswith(START)).select("lang", "gram", F.col("n").alias("a"))
        levels[k] = materialize(before.unionByName(opening).groupBy("lang", "gram").agg(F.sum("a").alias("a")), "level")
    tables, lower = [], None
    for k in range(1, order + 1):
        level = levels[k].withColumn("ctx", F.expr(f"substring(gram, 1, {k - 1})"))
        n1, n2, n3, n4 = (F.sum((F.col("a") == i).cast("double")) for i in (1, 2, 3, 4))
        y = F.coalesce(F.try_divide("n1", F.col("n1") + 2 * F.col("n2")), F.lit(0.5))
        gain = lambda i, up, down: F.coalesce(i - (i + 1) * F.col("y") * F.try_divide(up, down), F.lit(0.5 * i))
        discounts = level.groupBy("lang").agg(n1.alias("n1"), n2.alias("n2"), n3.alias("n3"), n4.alias("n4")) \
            .withColumn("y", y).select("lang", *[
                F.least(F.greatest(gain(i, a, b), F.lit(0.05)), F.lit(i - 0.05)).alias(f"d{i}")
                for i, a, b in ((1, "n2", "n1"), (2, "n3", "n2"), (3, "n4", "n3"))])
        discounts = local(discounts)
        d = F.when(F.col("a") == 1, F.col("d1")).when(F.col("a") == 2, F.col("d2")).otherwise(F.col("d3"))
        level = level.join(discounts, "lang").withColumn("d", d)
        contexts = level.groupBy("lang", "ctx").agg(F.sum("a").cast("double").alias("total"), F.sum("d").alias("kept"))
        contexts = contexts.withColumn("weight", F.col("kept") / F.col("total"))
        level = level.join(contexts, ["lang", "ctx"])
        if k == 1:
            base = level.groupBy("lang").agg((1 / (F.count(F.lit(1)) + 1)).alias("p0"))
            base = local(base)
            level = level.join(base, "lang")
            tables.append(base.select("lang", F.lit("").alias("gram"), F.log("p0").alias("value"), F.lit("p").alias("kind")))
        else:
            level = level.join(lower, (level["lang"] == lower["lang0"]) & (F.expr("substring(gram, 2)") == F.col("gram0")), "left") \
                .drop("lang0", "gram0")
        level = level.withColumn("p", (F.col("a") - F.col("d")) / F.col("total") + F.col("weight") * F.col("p0"))
        level = materialize(level.select("lang", "gram", "ctx", "p", "weight"), "probable")
        tables.append(level.select("lang", "gram", F.log("p").alias("value"), F.lit("p").alias("kind")))
        tables.append(level.groupBy("lang", F.col("ctx").alias("gram")).agg(F.log(F.max("weight")).alias("value")).withColumn("kind", F.lit("w")))
        lower = level.select(F.col("lang").alias("lang0"), F.col("gram").alias("gram0"), F.col("p").alias("p0"))
    model = tables[0]
    for table in tables[1:]:
        model = model.unionByName(table)
    return materialize(model, "kneser-ney")


@dataclass
class HashArrays:
    """Sorted hashes with their values: log probabilities and log back-off weights."""

    p_keys: np.ndarray
    p: np.ndarray
    w_keys: np.ndarray
    w: np.ndarray
    order: int

    @staticmethod
    def find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
        if not len(keys):
            return np.zeros(len(wanted), bool), np.zeros(len(wanted))
        return keys[at] == wanted, values[at]

    def sign_scores(self, keys: np.ndarray, ends: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Log probability of the signs at `ends` after as many signs as their longest n-grams hold."""
        score, size, open_ = np.zeros(len(ends)), size.copy(), np.arange(len(ends))
        while len(open_):  # back off from the longest n-gram to the empty one
            at, n = ends[open_], size[open_]
            hit, value = self.find(self.p_keys, self.p, keys[n, at])
            score[open_[hit]] += value[hit]
            open_, at, n = open_[~hit & (n > 0)], at[~hit & (n > 0)], n[~hit & (n > 0)]
            known, weight = self.find(self.w_keys, self.w, keys[n - 1, at - 1])
            score[open_[known]] += weight[known]
            size[open_] -= 1
        return score

    def word_scores(self, words: list[str], lang: str) -> np.ndarray:
        """Log probability of each word's signs, with its end mark, whose n-grams lie inside the word."""
        keys, owner, longest, _ = gram_keys(marked_words(words), lang, self.order)
        ends = np.flatnonzero(longest == self.order)
        return np.bincount(owner[ends], self.sign_scores(keys, ends, longest[ends]), minlength=len(words))

    def gram_scores(self, grams: list[str], lang: str) -> np.ndarray:
        """Log probability of the last sign of each n-gram after its other signs."""
        keys, _, longest, _ = gram_keys(grams, lang, self.order)
        ends = np.cumsum(np.fromiter(map(len, grams), np.int64, len(grams))) - 1
        return self.sign_scores(keys, ends, longest[ends])

    def scores(self, codes: np.ndarray, starts: np.ndarray, words: pa.Array, langs: np.ndarray) -> np.ndarray:
        """Log probability of every word of the texts, after the word before it."""
        score = np.zeros(len(codes))
        own = np.repeat(langs, np.diff(starts))
        for name in dict.fromkeys(own.tolist()):
            mine = np.flatnonzero(own == name)
            seen, place = np.unique(codes[mine], return_inverse=True)
            score[mine] = self.word_scores(words.take(pa.array(seen)).to_pylist(), name)[place]
            for at, which, grams in border_grams(codes, starts, words, mine, self.order):
                score[at] += self.gram_scores(grams, name)[which]
        return score


def hash_arrays(model: DataFrame, order: int = ORDER) -> HashArrays:
    """The model on the driver as sorted arrays; the caller has checked its size."""
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = hash_of(batch.column("gram").to_pylist(), batch.column("lang").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column("value"),
                                              pc.equal(batch.column("kind"), "p")], names=["key", "value", "is_p"])

    table = model.mapInArrow(hashed, "key long, value double, is_p boolean").toArrow()
    key = table.column("key").to_numpy().view(np.uint64)
    value, is_p = table.column("value").to_numpy(), table.column("is_p").to_numpy()
    parts = []
    for chosen in (is_p, ~is_p):
        order_ = np.argsort(key[chosen])
        parts += [key[chosen][order_], value[chosen][order_]]
    return HashArrays(*parts, order)


FIELDS = {"n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(),
          "n_repeat_words": pa.int64(), "n_signs": pa.int64(), "log_p": pa.float64()}
KIND = T.StructType([T.StructField(n, T.DoubleType() if n == "log_p" else T.LongType()) for n in FIELDS])


def repeated_words(codes: np.ndarray, starts: np.ndarray, distinct: int) -> np.ndarray:
    """Per text the words in windows of three that occur more than once in it."""
    texts = len(starts) - 1
    hit = np.zeros(len(codes), bool)
    if len(codes) >= 3:
        owner = np.repeat(np.arange(texts), np.diff(starts))
        at = np.flatnonzero(owner[2:] == owner[:-2])
        pair = codes[:-1] * np.int64(distinct) + codes[1:]
        _, pair = np.unique(pair, return_inverse=True)
        _, window = np.unique(pair[at] * np.int64(distinct) + codes[at + 2], return_inverse=True)
        _, place, times = np.unique(window * np.int64(texts) + owner[at], return_inverse=True, return_counts=True)
        again = at[times[place] > 1]
        for step in range(3):
            hit[again + step] = True
    return sums_by_start(hit, starts).astype(np.int64)


def base_counts(block: pa.Array, codes: np.ndarray, starts: np.ndarray, distinct: int) -> dict[str, np.ndarray]:
    texts = block.to_pylist()
    lines = [[line for line in t.split("\n") if line.strip(SPACES)] for t in texts]
    return {
        "n_words": np.diff(starts),
        "word_chars": np.array([len(t) - sum(map(t.count, SPACES)) for t in texts], np.int64),
        "n_symbols": np.array([sum(map(t.count, SYMBOLS)) for t in texts], np.int64),
        "n_dup_lines": np.array([len(x) - len(set(x)) for x in lines], np.int64),
        "n_repeat_words": repeated_words(codes, starts, distinct)}


def text_counts(docs: DataFrame, model: HashArrays | None, text: str, lang: str, extra: list[str]) -> DataFrame:
    """Base counts of each text, with its log probability where a model is given; `extra` columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(
        (model.p_keys, model.p, model.w_keys, model.w, model.order) if model else None)

    @F.arrow_udf(KIND)
    def count(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        arrays = HashArrays(*shared.value) if shared.value else None
        for texts, names in batches:
            names, at, parts = np.array(names.to_pylist(), object), 0, []
            for block in text_blocks(texts, BLOCK):
                codes, starts, words = split_words(block)
                found = base_counts(block, codes, starts, len(words))
                score = np.zeros(len(codes))
                if arrays:
                    score = arrays.scores(codes, starts, pc.utf8_lower(words), names[at:at + len(block)])
                at += len(block)
                signs = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 1
                found["n_signs"] = sums_by_start(signs[codes] if len(codes) else codes, starts).astype(np.int64)
                found["log_p"] = sums_by_start(score, starts)
                parts.append(struct_of({n: (found[n], kind) for n, kind in FIELDS.items()}))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct(list(FIELDS.items())))

    return docs.select(*extra, count(F.col(text), no_null(F.col(lang))).alias("c")).select(*extra, "c.*")


def joined_scores(tokens: DataFrame, model: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, token, begin, log_p) of distinct tokens by joins on the n-grams: for models too large to broadcast.

    The signs from place `begin` on (from 1) are scored, each after the signs before it in the token.
    """
    same = ["lang", "token", "begin"]
    ends = tokens.where(F.col("begin") <= F.length("token")).select(*same, F.explode(F.sequence(F.col("begin"), F.length("token"))).alias("at"))
    wanted = ends.select(*same, "at", F.explode(F.transform(
        F.sequence(F.lit(0), F.least(F.lit(order), F.col("at"))), lambda n: F.struct(
            n.alias("size"), F.col("token").substr(F.col("at") - n + 1, n).alias("gram"),
            F.col("token").substr(F.col("at") - n, n).alias("ctx")))).alias("g")).select(*same, "at", "g.*")
    p = model.where("kind = 'p'").select("lang", "gram", F.col("value").alias("p"))
    w = model.where("kind = 'w'").select("lang", F.col("gram").alias("ctx"), F.col("value").alias("w"))
    found = wanted.join(p, ["lang", "gram"], "left").join(w, ["lang", "ctx"], "left")
    best = found.groupBy(*same, "at").agg(
        F.max(F.when(F.col("p").isNotNull(), F.struct("size", "p"))).alias("best"),
        F.collect_list(F.struct("size", "w")).alias("weights"))  # at most order + 1 of them
    top = F.least(F.lit(order), F.col("at"))
    passed = F.filter("weights", lambda x: (x["size"] >= F.col("best.size")) & (x["size"] < top) & x["w"].isNotNull())
    value = F.col("best.p") + F.aggregate(passed, F.lit(0.0), lambda total, x: total + x["w"])
    return best.select(*same, value.alias("v")).groupBy(*same).agg(F.sum("v").alias("log_p"))


def tokens_of(lowered: Column, order: int) -> Column:
    """Two tokens a word, with the place of the first sign to score: the word, and its first signs after the word before."""
    kind = pa.list_(pa.struct([("token", pa.string()), ("begin", pa.int32())]))

    @F.arrow_udf("array<struct<token string, begin int>>")
    def tokens(texts: pa.Array) -> pa.Array:
        found = []
        for text in texts.to_pylist():
            words = re.findall(WORD, text or "")
            tails = [""] + [(START + w)[2 - order:] for w in words[:-1]]
            found.append([(START + w + END, order) for w in words]
                         + [(t + START + (w + END)[:order - 2], len(t) + 2) for t, w in zip(tails, words)])
        return pa.array(found, kind)
    return tokens(lowered)


def lower_case(text: Column) -> Column:
    """Lower case as the counts have it; the JVM's differs for a final sigma or a dotted capital I."""
    @F.arrow_udf("string")
    def lowered(texts: pa.Array) -> pa.Array:
        return pc.utf8_lower(texts)
    return lowered(text)


def text_key(lowered: Column) -> Column:
    return F.struct(F.xxhash64(lowered).alias("a"), F.hash(lowered).alias("b"))


def joined_text_scores(docs: DataFrame, model: DataFrame, text: str, lang: str, order: int = ORDER) -> DataFrame:
    """(_lang, _key, log_p) per distinct text; the key is a pair of its hashes."""
    docs = docs.select(no_null(F.col(lang)).alias("lang"), lower_case(F.col(text)).alias("text")).withColumn("key", text_key(F.col("text")))
    rows = docs.select("lang", "key", F.explode(tokens_of(F.col("text"), order)).alias("t")).select("lang", "key", "t.*")
    texts = docs.groupBy("lang", "key").agg(F.count(F.lit(1)).alias("copies"))
    counted = rows.groupBy("lang", "key", "token", "begin").agg(F.count(F.lit(1)).alias("times"))
    scores = joined_scores(counted.select("lang", "token", "begin").distinct(), model, order)
    total = counted.join(scores, ["lang", "token", "begin"]).groupBy("lang", "key").agg(F.sum(F.col("times") * F.col("log_p")).alias("log_p"))
    return total.join(texts, ["lang", "key"]).select(
        F.col("lang").alias("_lang"), F.col("key").alias("_key"), (F.col("log_p") / F.col("copies")).alias("log_p"))


def judge_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", order: int = ORDER,
                spread: float = SPREAD, model_rows: int = MODEL_ROWS) -> DataFrame:
    """Counts, perplexity, the language's band and the verdict for each row.

    A null or empty text has counts 0, no perplexity and fails the base rule; a null language
    is one of its own. Rows that repeat are judged each, and count each in the model.
    """
    model = kneser_ney(count_grams(docs, text, lang, order), order)
    if model.count() <= model_rows:
        rows = text_counts(docs, hash_arrays(model, order), text, lang, [key, lang])
    else:
        marks = docs.withColumn("_key", text_key(lower_case(F.col(text))))
        rows = text_counts(marks, None, text, lang, [key, lang, "_key"]).drop("log_p")
        found = joined_text_scores(docs, model, text, lang, order)
        rows = rows.join(found, (no_null(F.col(lang)) == F.col("_lang")) & (rows["_key"] == found["_key"]), "left").drop("_key", "_lang")
    rows = materialize(rows.withColumn("log_perplexity", F.when(F.col("n_signs") > 0, -F.col("log_p") / F.col("n_signs"))), "counts")
    quartiles = rows.where("log_perplexity is not null").groupBy(no_null(F.col(lang)).alias("_lang")).agg(
        F.percentile_approx("log_perplexity", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.lit(10000)).alias("q"))
    # Nearly equal documents must not shrink the band to nothing.
    width = spread * F.greatest(F.col("q")[2] - F.col("q")[0], F.lit(0.02) * F.col("q")[1])
    bands = quartiles.select("_lang", (F.col("q")[0] - width).alias("lower"), (F.col("q")[2] + width).alias("upper"))
    # Written, so that the join is chosen by its real size: the documents are not dealt by language.
    bands = materialize(bands, "bands")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return rows.join(bands, no_null(rows[lang]) == F.col("_lang"), "left").withColumn("base_failed", failed).select(
        key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.col("log_perplexity").between(F.col("lower"), F.col("upper"))).alias("kept"),
        F.exp("log_perplexity").alias("perplexity"), F.exp("lower").alias("lower"), F.exp("upper").alias("upper"))
