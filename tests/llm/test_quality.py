"""The classifier against its definition in NumPy, and held-out accuracy on the test tables."""
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import cases
from scanloom.llm import quality
from scanloom.llm.queries import op4_quality


def test_statistics_of_a_text():
    names = quality.FEATURES
    row = dict(zip(names, quality.statistics(pa.array(["Ab ab 12 x!\nAb ab 12 x!\nend"]))[0]))
    size = 27
    assert np.isclose(row["log_bytes"], np.log1p(size)) and np.isclose(row["log_words"], np.log1p(9))
    assert np.isclose(row["upper"], np.sqrt(2 / size)) and np.isclose(row["digits"], np.sqrt(4 / size))
    assert np.isclose(row["symbols"], np.sqrt(2 / size)) and np.isclose(row["distinct_words"], 4 / 9)
    assert np.isclose(row["commonest_word"], np.sqrt(4 / 9)) and np.isclose(row["repeated_lines"], 1 / 3)
    assert np.isclose(row["repeated_next"], np.sqrt(2 / 9)) and np.isclose(row["symbol_ends"], np.sqrt(2 / 9))
    assert not quality.statistics(pa.array(["", None])).any()
    assert len(quality.statistics(pa.array([], pa.string()))) == 0


def test_scores_are_posteriors():
    rng = np.random.default_rng(1)
    x = [rng.normal(0, 1, (300, 3)) @ rng.normal(0, 1, (3, 3)), rng.normal(2, 2, (200, 3))]
    model = quality.model_of([300, 200], [v.sum(axis=0) for v in x], [v.T @ v for v in x], 0.2, 0.01)
    points = rng.normal(0, 3, (50, 3))
    pooled = sum(len(v) * np.cov(v.T, bias=True) for v in x) / 500
    logs = []
    for v in x:
        c = 0.8 * np.cov(v.T, bias=True) + 0.2 * np.diag(np.diag(pooled)) + 0.01 * np.eye(3)
        d = points - v.mean(axis=0)
        logs.append(np.log(len(v) / 500) - 0.5 * np.log(np.linalg.det(c)) - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d))
    assert np.allclose(quality.scores(model, points), 1 / (1 + np.exp(logs[0] - logs[1])))


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    got = op4_quality(spark, folder).where("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    rows = got.select("predicted", "quality").collect()
    assert len(rows) > 50 and sum(r.predicted == r.quality for r in rows) / len(rows) > 0.97


def test_awkward_rows_and_labels(spark):
    table = cases.docs(spark, cases.awkward())
    vectors = quality.vectors(table)
    labels = spark.createDataFrame([(4, 1), (4, 1), (5, 0), (6, 1), (6, 0), (7, None), (8, 7), (None, 1), (99, 0)], "doc_id long, quality int")
    model = quality.fit(vectors, labels)
    assert model.share is None and len(model.means) == 2
    assert np.allclose(model.means[1], quality.statistics(pa.array(["one"]))[0])
    scored = quality.score(vectors, model).collect()
    assert len(scored) == table.count() and all(0 <= r.score <= 1 for r in scored)
    alone = quality.fit(vectors, labels.where("quality = 1"))
    assert quality.scores(alone, np.zeros((1, 13)))[0] == 1.0
    nothing = quality.fit(vectors.limit(0), labels)
    assert quality.score(vectors, nothing).select(F.min("score"), F.max("score")).first()[:] == (0.5, 0.5)
    both = quality.with_score(table, model, name="free")
    assert both.columns == [*table.columns, "free"]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert np.allclose([r[1] for r in sorted(((r.doc_id, r.free) for r in both.collect()), key=key)],
                       [r[1] for r in sorted(((r.key, r.score) for r in scored), key=key)])
