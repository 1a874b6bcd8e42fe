"""The wide principal components against a dense decomposition, and a saved model against its original."""

import numpy as np
from pyspark.ml.linalg import Vectors
from pyspark.ml.functions import vector_to_array

from tablewright.operators import infer as I
from tablewright.operators.type_model import TextPca, TextPcaModel


def rows(n=120, width=900, seed=0):
    rng = np.random.default_rng(seed)
    out = np.zeros((n, width))
    for i in range(n):
        out[i, rng.integers(0, 40, 6)] += rng.integers(1, 5)
        out[i, rng.integers(0, width, 3)] += 1
    return out


def test_components_of_wide_vectors(spark, tmp_path):
    dense = rows()
    data = [(i, Vectors.sparse(dense.shape[1], np.nonzero(r)[0].tolist(), r[np.nonzero(r)[0]].tolist())) for i, r in enumerate(dense)]
    df = spark.createDataFrame(data, ["i", "v"]).repartition(3)
    model = TextPca(5, "v", "p").fit(df)
    centred = dense - dense.mean(axis=0)
    want = np.linalg.svd(centred, compute_uv=False)[:5] ** 2 / (len(dense) - 1)
    assert np.allclose(model.variance, want, rtol=0.02)
    assert np.allclose(model.parts.T @ model.parts, np.eye(5), atol=1e-8)
    got = {r.i: r.p for r in model.transform(df).select("i", vector_to_array("p").alias("p")).collect()}
    assert np.allclose([got[i] for i in range(len(dense))], dense @ model.parts)
    model.save(f"{tmp_path}/m")
    again = TextPcaModel.load(f"{tmp_path}/m")
    assert np.allclose(again.parts, model.parts) and np.allclose(again.variance, model.variance)


def test_a_column_without_a_likely_class_keeps_its_place(spark):
    likely = spark.createDataFrame([(0, 0, 1, 0.9), (0, 2, 3, 0.8)], "table_id int, column_id int, class int, probability double")
    every = spark.createDataFrame([(0, 0, 1), (0, 1, 7), (0, 2, 3)], "table_id int, column_id int, class int")
    got = I.type_candidates(likely, 5, filtered=True, fallback=every).collect()
    assert [r["types"] for r in got] == [[1, 7, 3]]
