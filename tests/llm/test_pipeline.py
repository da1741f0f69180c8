"""The pipeline's stages by brute force on the smallest tables, and on an empty one."""



import pyarrow as pa

import corpus_pipeline as pipeline
from lendlens.llm import bpe, mixing, queries, simhash, toxicity

FOLDER = "/root/testdata/sf0.001"


def test_stages_on_all_that_is_kept(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").cache()
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["toxicity", "language", "near_duplicates", "mixing", "encoding"]
    kept = {}
    for name, stage in pipeline.STAGES:
        before, docs = docs, stage(spark, docs, FOLDER).cache()
        kept[name] = docs.collect()
        if name != "encoding":
            assert docs.columns == before.columns
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    first = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = toxicity.fit_toxicity(first, labels)

    rows = first.collect()
    scores = model.scores(pa.array([r["text"] for r in rows]))
    assert {r["doc_id"] for r in kept["toxicity"]} == {r["doc_id"] for r, s in zip(rows, scores) if s < toxicity.THRESHOLD}
    assert {r["doc_id"] for r in kept["language"]} <= {r["doc_id"] for r in kept["toxicity"]}
    assert len(kept["language"]) >= 0.98 * len(kept["toxicity"])
    prints = [simhash.fingerprint(r["text"]) for r in kept["language"]]
    root = list(range(len(prints)))
    ids = [r["doc_id"] for r in kept["language"]]
    changed = True
    while changed:
        changed = False
        for i in range(len(prints)):
            for j in range(i):
                if bin(prints[i] ^ prints[j]).count("1") <= 2 and root[i] != root[j]:
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    smallest = {}
    for r, i in zip(root, ids):
        smallest[r] = min(smallest.get(r, i), i)
    assert sorted(r["doc_id"] for r in kept["near_duplicates"]) == sorted(smallest.values())
    sizes, taken = {}, {}
    for r in kept["near_duplicates"]:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(r["text"].split())
    for r in kept["mixing"]:
        taken[r["source"]] = taken.get(r["source"], 0) + len(r["text"].split())
    longest = max(len(r["text"].split()) for r in kept["near_duplicates"])
    for source, target in mixing.quotas(sizes).items():
        assert abs(taken.get(source, 0) - target) <= longest
    vocabulary = bpe.WordBpe(bpe.read_vocabulary(queries.vocabulary()))
    by = {r["doc_id"]: r["text"] for r in kept["mixing"]}
    assert len(kept["encoding"]) == len(kept["mixing"])
    assert all(r["ids"] == vocabulary.encode(by[r["doc_id"]]) for r in kept["encoding"][:50])


def test_empty_table(spark, tmp_path):
    source = spark.read.parquet(f"{FOLDER}/documents.parquet")
    source.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{FOLDER}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
