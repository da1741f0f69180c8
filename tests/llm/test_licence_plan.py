"""The licence scan works out its texts once, not once for each word or template."""

from lendlens.llm import licences


def test_texts_are_made_once_for_all_words_and_templates(spark):
    docs = spark.createDataFrame([(1, "x\n" + licences.TEMPLATES["MIT-body"]), (None, None), (2, "under a tree")], "doc_id long, text string")
    found = licences.scan_licences(docs)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") <= 2 and plan.count("regexp_replace(") <= 5
    whole = [line for line in plan.splitlines() if "array_intersect(pairs" in line and "Generate" in line]
    assert len(whole) == 1 and plan.count("array_intersect(pairs") <= 1 + len(licences.TEMPLATES)
    rows = {(r["unit"], r["licence"]) for r in found.collect()}
    assert (0, "MIT-body") in rows and (-1, "MIT-body") in rows and {r["doc_id"] for r in found.collect()} == {1}
