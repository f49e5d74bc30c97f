"""Nearest vectors against all products, in rings and blocks of any size."""

import numpy as np
import pytest

from tidewright.operators import mapping


def brute(q, rows, k):
    out = []
    for a, v in q:
        found = []
        for b, w in rows:
            if a != b:
                score = 0.0
                if v is not None and w is not None and len(v) == len(w) and any(v) and any(w):
                    score = round(max(0.0, float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w))), 6)
                found.append((-score, b))
        out += [(a, b, -s) for s, b in sorted(found)[:k]]
    return sorted(out)


@pytest.mark.parametrize("chunk,block,pivots,few", [(2000, 20_000, 32, 0), (7, 20, 4, 0), (1, 1000, 1, 0), (1, 1, 1, 1000)])
def test_equals_all_products(spark, chunk, block, pivots, few):
    rng = np.random.default_rng(chunk)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + 0.1 * rng.normal(size=8)).tolist()) for i in range(240)]
    rows += [(300 + i, rows[0][1]) for i in range(8)] + [(400, None), (401, [0.0] * 8), (402, [1.0, 2.0]), (403, [2.0, 1.0]), (404, [-x for x in rows[1][1]])]
    q = [r for r in rows if r[0] % 10 in (0, 1, 2)]
    make = lambda v: spark.createDataFrame(v, "id long, vector array<double>")
    got = sorted(tuple(r) for r in mapping.nearest_vectors(make(q), make(rows), 4, chunk, block, pivots, 1, few).select("query_id", "id", "score").collect())
    want = brute(q, rows, 4)
    assert [g[0] for g in got] == [w[0] for w in want]
    by_score = lambda v: sorted((a, s) for a, _, s in v)
    assert [s for _, s in by_score(got)] == pytest.approx([s for _, s in by_score(want)], abs=2e-6)
    assert sum(g == w for g, w in zip(got, want, strict=True)) >= len(want) - 4  # sixth digits may tie otherwise


def test_bounds_leave_out_most_rings_of_clustered_vectors(spark):
    rng = np.random.default_rng(5)
    centres = np.eye(16)
    vectors = [(i, (centres[i % 16] + 0.02 * rng.normal(size=16)).tolist()) for i in range(800)]
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in vectors}
    pivots = {16: np.stack([unit[i] for i in range(16)])}
    score = {i: pivots[16] @ u for i, u in unit.items()}
    import pandas as pd

    frame = pd.DataFrame({"id": list(unit), "unit": list(unit.values()), "width": 16})
    placed = next(mapping._placed_by(pivots)(iter([frame])))
    assert all(placed["cell"][i] == score[i].argmax() for i in range(800))
    rings = {16: [(c, r, p["angle"].min(), p["angle"].max()) for (c, r), p in placed.groupby(["cell", "ring"])]}
    open_ = next(mapping._rings_for(pivots, rings)(iter([placed.assign(least=0.98)])))
    assert (open_["cell"].to_numpy() == placed.set_index("id").loc[open_["id"], "cell"].to_numpy()).all() and len(open_) < 0.1 * 800 * len(rings[16])
