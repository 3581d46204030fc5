"""Co-training uses every unlabelled document, and fits as if all were in one place."""

import numpy as np

from kinfabric.llm import quality


def test_every_unlabelled_row_counts(spark):
    rng = np.random.default_rng(2)
    n = 30_000
    y = (rng.random(n) < 0.5).astype(float)
    views = [(rng.normal(0, 1, (n, w)) + y[:, None] * 3).astype(np.float32) for w in (3, 4)]
    known, held = np.arange(400), np.arange(400) % 4 == 3
    rows = [(views[0][i].tolist(), views[1][i].tolist()) for i in range(400, n)]
    pool = spark.createDataFrame(rows, "text_view array<float>, page_view array<float>").repartition(3)
    sets = [(v[known][~held].astype(float), y[known][~held]) for v in views]
    first = [quality.Logistic.fit(*s) for s in sets]
    for m, v in zip(first, views, strict=True):
        m.calibrate(v[known][held].astype(float), y[known][held])
    wide = [v[400:].astype(float) for v in views]
    labels = quality._taught([first], wide)
    assert min(np.sum(~np.isnan(x)) for x in labels) > 8_000  # more than the former bound of the pool
    got = quality._fit_all(pool, [first], sets)
    for m, (x, t), w, taught in zip(got, sets, wide, labels, strict=True):
        sure = ~np.isnan(taught)
        want = quality.Logistic.fit(np.vstack([x, w[sure]]), np.concatenate([t, taught[sure]]))
        assert np.allclose(m.mean, want.mean) and np.allclose(m.scale, want.scale)
        assert np.allclose(m.weights, want.weights, atol=1e-5)
