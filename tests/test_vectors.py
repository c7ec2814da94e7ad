"""Exact and inverted-file search over a small table of vectors."""

import numpy as np
from pyspark.sql import functions as F

from kronoweft.operators import vectors


def test_search(spark, rows):
    x = np.random.default_rng(2).normal(0, 1, (600, 8)).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<float>")
    queries = df.where("id % 50 = 0")
    got = {}
    for r in vectors.knn(df, queries, 5).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append(r["id"])
    want = {i: sorted(range(600), key=lambda j: (float(((x[i] - x[j]) ** 2).sum()), j))[:5] for i in range(0, 600, 50)}
    assert got == want
    ivf = vectors.Ivf.train(df)
    indexed = vectors.index(df, ivf)
    probes = vectors.calibrated_probes(indexed, ivf, k=5)
    near = vectors.search(indexed, ivf, queries, 5, probes, 128)
    hit = sum(r["id"] in want[r["query"]] for r in near.collect())
    assert hit >= 0.9 * 60
    full, told = vectors.search_complete(indexed, ivf, queries, 5, 2, budget=10**6)
    got = {}
    for r in full.orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append(r["id"])
    assert got == want and rows(told.select("left_out").distinct()) == [(False,)] and told.agg(F.min("tail")).first()[0] > 0
    # a budget that bites: cells that do not fit are left out whole, and no query scores more than its budget
    _, told = vectors.search_complete(indexed, ivf, queries, 5, 2, budget=40)
    assert rows(told.select("left_out").distinct()) == [(True,)] and 0 < told.agg(F.max("tail")).first()[0] <= 40
    assert abs(vectors.fit(indexed, ivf)[2] - 1) < 0.2 and vectors.keep_quantizers(1.2, 600, 700) and not vectors.keep_quantizers(1.6, 600, 700)
    assert vectors.refresh(df.limit(500), ivf)[2] is False and vectors.refresh(df.withColumn("x", F.transform("x", lambda v: v * 9)), ivf)[2] is True
    assert vectors.knn(df, queries.limit(0)).count() == 0 and vectors.knn(df.where(F.lit(False)), queries).count() == 0
    assert vectors.search(indexed, ivf, queries.limit(0)).count() == 0
