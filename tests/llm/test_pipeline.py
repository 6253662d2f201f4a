"""Each stage on its own input, on a small corpus with planted cases."""
import cases
import corpus_pipeline as p
from test_decontaminate import brute as contamination
from test_jaccard_join import brute as grouped


def test_stages(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    stages = dict(p.STAGES)
    assert [n for n, _ in p.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "tokens"]
    good = stages["quality"](spark, docs, folder).cache()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    kept = {r.doc_id for r in good.collect()}
    right = [labels[i] == (i in kept) for i in labels]
    assert good.columns == names and sum(right) / len(right) > 0.95
    rows = [(r.doc_id, r.text) for r in good.collect()]
    once = stages["near_duplicates"](spark, good, folder).cache()
    assert once.columns == names and sorted(r.doc_id for r in once.collect()) == sorted(i for i, _, c in grouped(rows) if i == c)
    clean = stages["decontamination"](spark, once, folder).cache()
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    before = once.collect()
    judged = contamination([r.text for r in before], items)
    stay = {r.doc_id: (r.text, n) for r, (w, n, _) in zip(before, judged) if not (n > 0 and 20 * n >= w)}
    after = clean.collect()
    assert clean.columns == names and {r.doc_id for r in after} == set(stay) and len(stay) < len(before)
    assert all(r.text == stay[r.doc_id][0] for r in after if not stay[r.doc_id][1])
    assert not any(n for _, n, _ in contamination([r.text for r in after if stay[r.doc_id][1]], items)) and all(r.n_chars == len(r.text) for r in after)
    private = stages["personal_data"](spark, clean, folder).cache()
    from test_pii import brute as spans
    texts = {r.doc_id: r.text for r in private.collect()}
    assert private.columns == names and len(texts) == len(after)
    assert all(texts[r.doc_id] == r.text or "[" in texts[r.doc_id] for r in after)
    assert not any(spans(t) for t in texts.values())
    tokens = stages["tokens"](spark, private, folder).collect()
    assert {r.doc_id for r in tokens} == set(texts) and all(r.n_tokens == len(r.ids) for r in tokens)


def test_awkward_rows(spark):
    folder = "/root/testdata/sf0.001"
    docs = cases.docs(spark, cases.awkward())
    for name, stage in p.STAGES[:-1]:
        got = stage(spark, docs, folder)
        assert got.columns == docs.columns, name
        rows = got.select("doc_id", "text").collect()
        if name == "near_duplicates":
            assert sorted(r.doc_id for r in rows if r.doc_id) == [1, 2, 3, 4, 5, 6, 8, 9, 10] and len(rows) == 11
        elif name != "quality":
            assert len(rows) == len(cases.awkward())
        assert stage(spark, docs.limit(0), folder).count() == 0
