"""Each operator against brute force or an exact round trip, and on odd input."""

import collections
import hashlib
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lendlens.llm import (
    bpe, common, language, licences, merkle, mixing, neighbours, perplexity, queries, simhash, toxicity, url_rules,
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, rank int"
FOLDER = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977} the of" for i in range(20_000))
ROWS = [
    (1, "The cat sat on the mat.\nIt was a good day, they said.", "en", "a", 5, "x", 1),
    (2, None, None, None, None, None, None), (3, "", "en", "b", 0, "y", 2), (4, " \n\t ", "de", "b", 4, None, 3),
    (5, LONG, "en", "a", len(LONG), "z", 4), (5, LONG, "en", "a", len(LONG), "z", 4),
    (None, "no id here, but a text", "en", None, 3, "w", 5), (6, "é́ 日本語 Σας İx 12ab's <|endoftext|>", "el", "c", 9, "v", 6),
    (7, "The cat sat on the mat.\nIt was a good day, they said.", "en", "a", 5, "x", 1), (8, "!!! ### 123", None, "c", 1, "u", 7)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def texts(spark):
    return {r[0]: r[1] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}


def shown(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def edited(text, following):
    n = len(text)
    return text[:n - n // 3] + following[:n // 3]


def test_fingerprints(spark, docs, empty, texts):
    found = {r["doc_id"]: r for r in merkle.edit_report(spark.read.parquet(f"{FOLDER}/documents.parquet"), task_bytes=50_000).collect()}
    order = sorted(texts, reverse=True)
    assert set(found) == set(order)
    for own, following in zip(order, order[1:] + order[:1]):
        r, wanted = found[own], edited(texts[own], texts[following])
        assert r["edited_sha256"] == hashlib.sha256(wanted.encode()).hexdigest()
        assert r["n_chars"] == len(texts[own]) and r["fingerprint"] == merkle.Tree(texts[own]).root.hex()
        assert (r["fingerprint"] == r["edited_fingerprint"]) == (texts[own] == wanted)
        assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1
    assert np.mean([r["near_edited"] for r in found.values()]) > 0.5
    odd = merkle.edit_report(docs)
    assert odd.count() == len(ROWS) and merkle.edit_report(empty).count() == 0
    single = merkle.edit_report(docs.where("doc_id = 1")).first()
    assert single["near_next"] == 1.0


def test_tree_joins_to_its_text_and_locates_edits():
    text = "# Head\nOne two three. Four five six seven eight nine ten eleven twelve!\n\n# Next\n  last  line  "
    for line in text.split("\n") + [" ", "", "x" * 500, LONG[:5000]]:
        assert "".join(merkle.LEAF.findall(line)) == line
    tree, other = merkle.Tree(text), merkle.Tree(text.replace("last", "lost"))
    assert [text[a:b] for a, b in tree.edits(other)] == ["  last  line  "]
    assert tree.edits(merkle.Tree(text)) == [] and len(tree.sections) == 2
    assert tree.root != merkle.Tree(text + " ").root


def test_mix_reaches_targets(spark, docs, empty):
    rows = [(i, " ".join(["w"] * (1 + i % 7)), f"s{min(i % 9, 4)}") for i in range(900)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = mixing.plan_mix(frame, F.array("source"))
    taken = {}
    for r in mixing.with_copies(frame, mix, F.array("source")).collect():
        size = len(r["text"].split())
        assert 0 <= r["copies"] <= 3
        taken[r["source"]] = taken.get(r["source"], 0) + size * r["copies"]
    for source, _, target in mix.sources:
        assert abs(taken[source] - target) <= 7
    again = mixing.plan_mix(frame.repartition(5), F.array("source"))
    assert again == mix
    assert mixing.mixed(docs, F.array("source")).columns == docs.columns
    assert mixing.mixed(empty, F.array("source")).count() == 0


def test_mix_fills_around_long_documents(spark):
    # One text of 40 % of its source's words; another whose copies share one rank.
    rows = [(i, "a " * (1 + i % 7), "small") for i in range(300)] + [(1000, "b " * 800, "small")]
    rows += [(2000 + i, "c " * (1 + i % 3), "big") for i in range(700)] + [(3000, "c c c c c", "big")] * 5
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").cache()
    for seed in range(6):
        for weights in ((1, 4), (3, 1)):
            mix, taken = mixing.plan_mix(frame, F.array("source"), weights=weights, seed=seed), {}
            for r in mixing.with_copies(frame, mix, F.array("source")).collect():
                taken[r["source"]] = taken.get(r["source"], 0) + r["copies"] * len(r["text"].split())
            assert all(abs(taken[s] - target) <= 7 for s, _, target in mix.sources)


def test_overlapping_sources_and_flow():
    # Of two sources, one shares its documents: the shared ones go where they are needed.
    found = mixing.route({'["a"]': 10, '["a","b"]': 10, '["b"]': 2}, {"a": 10.0, "b": 12.0})
    assert sum(f.get("b", 0) for f in found.values()) == 12 and found['["a","b"]']["b"] == 10
    assert mixing.quotas({"a": 1, "b": 100, None: 100}) == {"a": 3.0, "b": 2 / 5 * 198, None: 3 / 5 * 198}
    # Second passes come only when the first are used up.
    found = mixing.route({'["a"]': 10, '["a","c"]': 10}, {"a": 15.0, "c": 0.0})
    assert sum(f["a"] for f in found.values()) == 15 and max(f["a"] for f in found.values()) <= 10


def test_bpe_as_the_library(spark, docs, empty, texts):
    tokenizers = pytest.importorskip("tokenizers")
    path = queries.vocabulary()
    library = tokenizers.Tokenizer.from_file(path)
    library.no_truncation(), library.no_padding()
    frame = spark.createDataFrame([(i, t) for i, t in texts.items()][:80] + [(1000 + i, r[1]) for i, r in enumerate(ROWS)], "doc_id long, text string")
    for r in frame.select("text", bpe.encoded_digest(spark, F.col("text"), path).alias("r")).select("text", "r.*").collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    ids = bpe.token_ids(spark, F.col("text"), path)
    for r in docs.select("text", ids.alias("ids")).select("text", "ids", bpe.decoded(spark, F.col("ids"), path).alias("back")).collect():
        assert r["ids"] == library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["back"] == library.decode(r["ids"], skip_special_tokens=False)
    assert empty.select(bpe.encoded_digest(spark, F.col("text"), path)).count() == 0


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://A.Example.com/en/x?q#f", "http://www.example.com/en/", "https://b.net/es/1", "https://b.net",
            "ftp://casino.example.org/x", "https://occasino.org/", "http://x.org://y.net/fr/", "https://b.net/fr/?a://c"] * 2
    pages = spark.createDataFrame([(i % 5, u, "old") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    found = [(r["url"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.judge_urls(pages).collect()]
    assert len(found) == len(urls)
    by = {f[0]: f[1:] for f in found}
    assert by[None] == by["no scheme"] == ("", "", None, "allow")
    assert by[urls[3]] == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert by[urls[4]][2:] == ("www.example.com/en/", "allow") and by[urls[5]][2:] == ("net/es/", "block")
    assert by[urls[6]] == ("b.net", "", None, "allow") and by[urls[7]][3] == "block" and by[urls[8]][3] == "allow"
    # The index loses no rule: every rule against every URL.
    rules = url_rules.HOST_RULES + url_rules.PATTERNS
    for _, host, path, rule, verdict in found:
        fits = [r for r in rules if re.search(r.regex, host + path)]
        ranked = max((r for r in fits if r.ranked), key=lambda r: (len(r.label), r.label), default=None)
        assert rule == (ranked.label if ranked else None)
        assert verdict == (ranked.action if ranked else "block" if fits else "allow")
    assert url_rules.judge_urls(pages.limit(0)).count() == 0


def test_licences_by_brute_force(spark, docs, empty, texts):
    import textwrap

    mit, apache = (licences.TEMPLATES[n] for n in ("MIT-body", "Apache-2.0-full-header"))
    comment = "\n".join(" * " + line for line in textwrap.wrap(" ".join(apache.split()), 60))
    bodies = list(texts.values())[:60] + [
        "Released  under the MIT-License\nx", "licensed under\nCC BY NC 4.0", None, "", "cc by nc 4 0 nc",
        "some words before " * 30 + mit + "\nand after " * 40, "int main()\n/*\n" + comment + "\n */\nreturn 0;",
        mit[:300], "Here it says: released under the MIT license. Then more.", mit.replace("Software", "Work").replace("hereby", ""),
        "license software " * 300, mit + mit]
    frame = spark.createDataFrame(list(enumerate(bodies)), "doc_id long, text string")
    known, wanted = licences.template_bigrams(licences.TEMPLATES), []
    bigrams = lambda words: {f"{a} {b}" for a, b in zip(words, words[1:])}
    dice = lambda pairs, t: 2 * len(pairs & set(t)) / (len(pairs) + len(t))
    for i, body in enumerate(bodies):
        lines = (body or "").split("\n")
        for unit, line in [(0, " ".join(lines))] * (len(lines) > 1) + list(enumerate(lines, 1)):
            pairs = bigrams(licences.words_of(line))
            best = max(((dice(pairs, t), n) for n, t in reversed(known.items())), key=lambda x: x[0])
            if best[0] >= 0.8:
                wanted.append((i, unit, 0, best[1], best[0]))
        words = licences.words_of(body or "")
        for name, t in known.items():
            template = licences.words_of(licences.TEMPLATES[name])
            starts = {max(at - template.index(w), 0) for at, w in enumerate(words) if len(w) >= 4 and template.count(w) == 1}
            best = max(((dice(bigrams(words[s:s + len(template)]), t), -s) for s in starts), default=(0, 0))
            if best[0] >= 0.8:
                wanted.append((i, -1, 1 - best[1], name, best[0]))
    assert shown(licences.scan_licences(frame), "doc_id", "unit", "first_word", "licence", "dice") == sorted(wanted, key=repr)
    whole = {(w[0], w[3]) for w in wanted if w[1] == -1}
    assert {(65, "MIT-body"), (66, "Apache-2.0-full-header"), (68, "MIT"), (69, "MIT-body"), (71, "MIT-body")} <= whole
    assert licences.scan_licences(empty).count() == 0 and licences.scan_licences(docs).count() == 0
    assert licences.scan_licences(docs, {}).count() == 0 and licences.scan_licences(docs, {"none": "word"}).count() == 0


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    hit = {k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(i, i + 3)} if len(windows) < 3000 else None
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), hit and len(hit) or 0


def test_base_counts(spark, texts, docs):
    frame = spark.createDataFrame([(i, t, "en") for i, t in texts.items() if len(t) < 3000] + [(r[0], r[1], r[2]) for r in ROWS if r[1] != LONG],
                                  "doc_id long, text string, lang string")
    found = perplexity.judge_texts(frame).join(frame.withColumnRenamed("doc_id", "k"), F.col("doc_id").eqNullSafe(F.col("k")))
    for r in found.collect():
        if r["k"] is not None and r["k"] < 9:
            continue  # these ids occur twice
        counts = brute_counts(r["text"])
        assert tuple(r[n] for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == counts
        assert r["base_failed"] == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0]) and not (r["kept"] and r["base_failed"])
    odd = perplexity.judge_texts(docs)
    assert odd.count() == len(ROWS) and odd.where("kept is null").count() == 0


def test_kneser_ney_sums_to_one_and_paths_agree(spark, empty, texts):
    frame = spark.createDataFrame([(i, t, "en" if i % 2 else None) for i, t in list(texts.items())[:40]], "doc_id long, text string, lang string")
    model = perplexity.kneser_ney(perplexity.count_grams(frame))
    arrays = perplexity.hash_arrays(model)
    signs = [r[0] for r in model.where("kind = 'p' and lang = 'en' and length(gram) = 1").select("gram").collect()]
    table = {r["gram"]: np.exp(r["value"]) for r in model.where("kind = 'p' and lang = 'en'").collect()}
    weight = {r["gram"]: np.exp(r["value"]) for r in model.where("kind = 'w' and lang = 'en'").collect()}

    def p(gram):
        return table[gram] if gram in table else weight.get(gram[:-1], 1.0) * p(gram[1:])

    for context in ("", "t", "th", "\x02th", "the", "e\x02t", "\x02a\x02", "the\x02"):
        total = sum(p(context + s) for s in signs) + (weight[""] * table[""] if not context else 0)
        assert total <= 1 + 1e-6 and total > 0.97
    words = ["the", "tion", "zzqx", "日本", ""]
    brute = [sum(np.log(p(("\x02" + w + "\x03")[i - 3:i + 1])) for i in range(3, len(w) + 2)) for w in words]
    assert np.allclose(arrays.word_scores(words, "en"), brute, atol=1e-4)
    grams = ["\x02t", "e\x02to", "\x02a\x02t", "zz\x02q", "本"]
    assert np.allclose(arrays.gram_scores(grams, "en"), [np.log(p(g)) for g in grams], atol=1e-4)
    small, large = (shown(perplexity.judge_texts(frame, model_rows=n).select("doc_id", "kept", F.round("perplexity", 3).alias("p")), "doc_id", "kept", "p")
                    for n in (10**7, 0))
    assert [x[:2] for x in small] == [x[:2] for x in large] and np.allclose([x[2] for x in small], [x[2] for x in large], atol=2e-3)
    assert perplexity.judge_texts(empty).count() == 0


def gram_events(text, order):
    """The longest n-gram of every sign of a text, in order."""
    before = ""
    for w in re.findall(r"[^\x20\x09-\x0D]+", text.lower()):
        for i, sign in enumerate(w + "\x03"):
            inside = "\x02" + (w + "\x03")[:i + 1]
            yield (before[-(order - len(inside)):] if len(inside) < order else "") + inside[-order:]
        before = "\x02" + w


def brute_model(texts, order):
    """Modified Kneser-Ney from raw texts: the probability of an n-gram's last sign."""
    seen = collections.Counter(g for t in texts for g in gram_events(t, order))
    levels = {order: {g: n for g, n in seen.items() if len(g) == order}}
    for k in range(order - 1, 0, -1):
        level = collections.Counter(g[1:] for g in levels[k + 1])
        level.update({g: n for g, n in seen.items() if len(g) == k})
        levels[k] = level
    cut, total, kept = {}, collections.Counter(), collections.Counter()
    for k, level in levels.items():
        n = [sum(a == i for a in level.values()) for i in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else (0.0 if n[2] else 0.5)
        d = [min(max(i - (i + 1) * y * n[i + 1] / n[i] if n[i] else 0.5 * i, 0.05), i - 0.05) for i in (1, 2, 3)]
        for g, a in level.items():
            cut[g] = d[min(a, 3) - 1]
            total[g[:-1], k] += a
            kept[g[:-1], k] += cut[g]

    def p(gram):
        if not gram:
            return 1 / (len(levels[1]) + 1)
        k, context = len(gram), gram[:-1]
        if (context, k) not in total:
            return p(gram[1:])
        a = levels[k].get(gram, 0)
        return ((a - cut[gram]) if a else 0) / total[context, k] + kept[context, k] / total[context, k] * p(gram[1:])
    return p


def test_perplexity_and_bands_from_raw_text(spark, texts):
    bodies = [t for t in texts.values() if 40 < len(t) < 3000][:60] + ["a b a b, I a b", "x", "Über die Straße\tgeht\nes"]
    frame = spark.createDataFrame([(i, t, "en") for i, t in enumerate(bodies)], "doc_id long, text string, lang string")
    p, found = brute_model(bodies, perplexity.ORDER), {r["doc_id"]: r for r in perplexity.judge_texts(frame).collect()}
    wanted = {i: -np.mean([np.log(p(g)) for g in gram_events(t, perplexity.ORDER)]) for i, t in enumerate(bodies)}
    for i, value in wanted.items():
        assert np.log(found[i]["perplexity"]) == pytest.approx(value, abs=1e-6)
    low, middle, high = np.quantile(list(wanted.values()), [0.25, 0.5, 0.75], method="inverted_cdf")
    width = perplexity.SPREAD * max(high - low, 0.02 * middle)
    for i, value in wanted.items():
        assert np.log(found[i]["lower"]) == pytest.approx(low - width, abs=1e-6) and np.log(found[i]["upper"]) == pytest.approx(high + width, abs=1e-6)
        assert found[i]["kept"] == (not found[i]["base_failed"] and low - width <= value <= high + width)


def test_order_of_words_counts(spark):
    rng = np.random.default_rng(5)
    names, verbs, places = (["the old man", "a young girl", "our neighbour", "the two brothers"],
                            ["walked slowly to", "never came back from", "often spoke about", "looked for"],
                            ["the quiet village", "a house by the river", "the market square", "their garden"])
    def sentence():
        return " ".join(rng.choice(part) for part in (names, verbs, places)) + "."
    bodies = [" ".join(sentence() for _ in range(12)) for _ in range(120)]
    salad = [" ".join(rng.permutation(b.split())) for b in bodies[:20]]
    frame = spark.createDataFrame([(i, t, "en") for i, t in enumerate(bodies + salad)], "doc_id long, text string, lang string")
    found = {r["doc_id"]: r for r in perplexity.judge_texts(frame).collect()}
    for i in range(20):
        assert found[120 + i]["perplexity"] > 1.2 * found[i]["perplexity"]
        assert found[i]["perplexity"] <= found[i]["upper"] < found[120 + i]["perplexity"]


def brute_components(prints, distance=2):
    ids = list(range(len(prints)))
    near = [(i, j) for i, j in itertools.combinations(ids, 2) if bin(prints[i] ^ prints[j]).count("1") <= distance]
    while True:
        new = ids[:]
        for i, j in near:
            new[i] = new[j] = min(new[i], new[j])
        if new == ids:
            return ids
        ids = new


def test_simhash_links_by_brute_force(spark):
    rng = np.random.default_rng(1)
    prints = [int(x) for x in rng.integers(0, 1 << 64, 60, dtype=np.uint64)] + [0, (1 << 64) - 1]
    for _ in range(400):  # chains and clusters around earlier fingerprints
        flip = rng.choice(64, rng.integers(0, 4), replace=False)
        prints.append(prints[rng.integers(len(prints))] ^ sum(1 << int(b) for b in flip))
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    frame = spark.createDataFrame([(x,) for x in set(signed)], "fp long")
    roots = {r["node"]: r["root"] for r in simhash.connected_roots(simhash.hamming_links(frame)).collect()}
    wanted = brute_components(prints)
    groups = {}
    for s, g in zip(signed, wanted):
        groups.setdefault(g, set()).add(roots.get(s, s))
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_simhash_of_texts(spark, docs, empty, texts):
    def brute(text):
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
        values = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << k for k in range(64) if 2 * sum(v >> k & 1 for v in values) > len(values))

    assert all(simhash.fingerprint(t) == brute(t) for t in list(texts.values())[:40] + [None, "", "A b", "A B c D"])
    found = {(r["doc_id"], r["component"]) for r in simhash.near_duplicates(docs).collect()}
    assert {(1, 1), (7, 1), (2, 2), (3, 2), (4, 2), (5, 5), (None, None)} <= found
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert shown(kept.select("doc_id"), "doc_id") == sorted([(1,), (2,), (5,), (6,), (8,), (None,)], key=repr)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_toxicity(spark, docs, empty):
    rng = np.random.default_rng(2)
    plain = [f"{a}{b}" for a in "ba co di lu me no ta ri".split() for b in "ver lam tis gor pen".split()]
    sample = []
    for i in range(400):
        words = rng.choice(plain, 60).tolist()
        if i % 4 == 0:
            for at in rng.choice(60, 4):
                words[at] = str(rng.choice(["idiotic", "worthless", "pathetic"]))
        sample.append((" ".join(words), int(i % 4 == 0)))
    model = toxicity.fit(sample)
    clean, vile, spelled, none = model.scores(pa.array(["coverlam tisgor bapen", "you are pathetic and worthless", "you are patthetic and worthles", ""]))
    assert clean < 0.3 and none < 0.3 and vile > 0.3 and spelled > clean
    scored = docs.select(toxicity.toxicity(spark, F.col("text"), model).alias("s"))
    assert scored.where("s between 0 and 1").count() == len(ROWS)
    labels = spark.createDataFrame([(1, None, 1), (1, 1, 1), (5, 0, 0), (None, 1, 1)], "doc_id long, toxic int, quality int")
    for frame in (docs, empty):
        assert toxicity.fit_toxicity(frame, labels).scores(pa.array(["x"]))[0] <= 1


def test_all_words_of_long_texts_train():
    rng = np.random.default_rng(4)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    words = ["".join(rng.choice(letters, 7)) for _ in range(400)]
    long = [" ".join(rng.permutation(np.tile(words[i::4], 12))) for i in range(4)]
    model = toxicity.fit([(t, i % 2) for i, t in enumerate(long)])
    assert (model.word_scores(pa.array(words)) != 0).all()
    found = language.fit([(t, "ab"[i % 2]) for i, t in enumerate(long)])
    assert found.lexicon == {w: i % 2 for i, w in enumerate(words)}


def accuracy(spark, name, truth, parts, part):
    rows = queries.QUERIES[name](spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").join(
        spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    found = rows.join(labels.withColumnsRenamed({"doc_id": "k"}), F.col("doc_id") == F.col("k")).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["k"]).encode()) % parts == part) for r in found)
    held = [r for r in found if r["held_out"]]
    return np.mean([r["predicted" if truth != "lang" else "lang_pred"] == r[truth] for r in held])


def test_held_out_accuracy(spark):
    assert accuracy(spark, "op3_quality", "quality", 3, 1) > 0.95
    assert accuracy(spark, "op6_toxicity", "toxic", 4, 2) > 0.85
    assert accuracy(spark, "op10_language", "lang", 4, 2) > 0.98


def test_quality_votes(spark, docs, empty):
    sample = [("good plain words in a calm line " * 5, 1)] * 20 + [("BUY!! NOW!! $$$ " * 20, 0)] * 20
    model = neighbours.fit(sample)
    good, bad = model.scores(pa.array(["plain words in a line, calm and good", "SELL!! NOW!! $$$ BUY!!"]))
    assert good > 0.5 > bad
    vectors = model.project(pa.array([t for t, _ in sample]))
    assert np.allclose(vectors, model.vectors, atol=1e-5)
    assert docs.select(neighbours.quality(spark, F.col("text"), model).alias("s")).where("s between 0 and 1").count() == len(ROWS)
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert neighbours.fit_quality(empty, labels).scores(pa.array(["x"]))[0] == pytest.approx(0.5)


def test_forward_backward_by_enumeration(spark, docs, empty):
    rng = np.random.default_rng(3)
    chains, labels = np.array([1, 4, 3]), 3
    emission, move, first = rng.normal(size=(8, labels)), rng.normal(size=(labels, labels)), rng.normal(size=labels)
    found, partition, moves, firsts = language.marginals(emission, chains, move, first, pairs=True)
    total, at = 0.0, 0
    for size in chains:
        weights, share = {}, np.zeros((size, labels))
        for path in itertools.product(range(labels), repeat=int(size)):
            score = first[path[0]] + sum(emission[at + t, y] for t, y in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:]))
            weights[path] = np.exp(score)
        z = sum(weights.values())
        for path, w in weights.items():
            for t, y in enumerate(path):
                share[t, y] += w / z
        assert np.allclose(found[at:at + size], share)
        total, at = total + np.log(z), at + size
    assert partition == pytest.approx(total) and moves.sum() == pytest.approx(5) and firsts.sum() == pytest.approx(3)
    sample = [("der die und nicht ein haus", "de"), ("the and of not a house", "en")] * 30
    model = language.fit(sample)
    rows = docs.select("doc_id", "text", language.language(spark, F.col("text"), model).alias("r")).select("doc_id", "text", "r.*").collect()
    assert all((r["lang_pred"] == "und") == (not re.search(r"[^\W\d_]", r["text"] or "")) for r in rows) and len(rows) == len(ROWS)
    mixed = spark.createDataFrame([("the house of and der haus und nicht",)], "text string")
    words = mixed.select(language.word_languages(spark, F.col("text"), model).alias("w")).first()["w"]
    assert [w["lang"] for w in words] == ["en"] * 4 + ["de"] * 4
    assert language.fit_language(empty).predict(pa.array(["abc"])) [0] == ["und"]


def test_blocks_hold_whole_texts():
    texts = pa.array(["a" * 10, None, "b" * 50, "", "c"] * 3)
    blocks = list(common.text_blocks(texts, 20))
    assert [t for b in blocks for t in b.to_pylist()] == [t or "" for t in texts.to_pylist()]
    assert max(len(b) for b in blocks) < len(texts)
