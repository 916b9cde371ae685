import numpy as np

from tallyforge.llm import ann


def test_nearest_recall_among_thousands_of_near_but_unequal_vectors(spark):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=64)
    x = centre / np.linalg.norm(centre) + rng.normal(size=(3000, 64)) * 3e-4
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 100 = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for i, found in got.items():
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        hits += len(found & set(np.argsort(d)[:10].tolist()))
    recall = hits / (10 * len(got))
    print("recall", recall)
    assert len(got) == 30 and recall >= 0.9
