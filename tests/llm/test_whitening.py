import numpy as np
import pytest

from partloom.llm import whitening
from tests.llm.frames import clash

VECTORS = "vec_id bigint, embedding array<float>, label int"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 0) for i, v in vectors], VECTORS)


def brute(vectors, k=8):
    """Plain eigenvectors in numpy; sums and deviations in Python's whole numbers."""
    usable = [(i, v) for i, v in vectors if v is not None and all(c is not None and np.isfinite(np.float32(c)) for c in v)]
    x = [[int(np.floor(1024 * float(np.float32(c)))) + 100_000 for c in v] for _, v in usable]
    n, s = len(x), [sum(col) for col in zip(*x, strict=True)]
    centred = np.array([[(n * a - b) / n for a, b in zip(row, s, strict=True)] for row in x])
    e, axes = np.linalg.eigh(centred.T @ centred / n)
    e, axes = e[::-1][:k], axes[:, ::-1][:, :k]
    return [i for i, _ in usable], [sum((n * a - b) ** 2 for a, b in zip(row, s, strict=True)) for row in x], centred @ axes / np.sqrt(e), e / np.trace(centred.T @ centred / n)


@pytest.mark.parametrize("n, d", [(300, 12), (2500, 20), (40, 5)])
def test_against_numpy(spark, n, d):
    rng = np.random.default_rng(n)
    x = (rng.normal(size=(n, d)) * np.linspace(2, 0.3, d)) @ np.linalg.qr(rng.normal(size=(d, d)))[0] + rng.normal(size=d)
    vectors = list(enumerate(x.astype(np.float32).tolist()))
    vectors[3:3] = [(9001, None), (9002, [None] * d), (9003, [float("nan")] * d), (9004, [float("inf")] * d)]
    ids, deviation, white, explained = brute(vectors)
    got = sorted((r["vec_id"], r["component"], r["deviation"], r["whitened"], r["explained"], r["n"], r["identity_error"]) for r in whitening.whitened(frame(spark, vectors)).collect())
    k = min(8, d)
    assert [(r[0], r[1]) for r in got] == sorted((i, c) for i in ids for c in range(1, k + 1))
    assert {r[5] for r in got} == {n} and max(r[6] for r in got) < 1e-9
    assert {r[0]: r[2] for r in got} == dict(zip(ids, deviation, strict=True))
    own = {(r[0], r[1]): r for r in got}
    for c in range(k):
        mine = np.array([own[i, c + 1][3] for i in ids])
        sign = np.sign(mine @ white[:, c])
        assert np.allclose(mine * sign, white[:, c], atol=1e-8) and np.isclose(own[ids[0], c + 1][4], explained[c], rtol=1e-9)


def test_middle_dimension_in_parts(spark):
    """The scatter of many blocks is the same, however many parts add it up."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(5000, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "index bigint, values array<double>")
    blocks = whitening.to_blocks(df, 5000, 6)
    assert blocks.numRowBlocks == 5 and np.allclose(whitening.scatter(blocks), x.T @ x, atol=1e-8)


def test_odd_rows(spark):
    rng = np.random.default_rng(6)
    vectors = [(i % 40, v) for i, v in enumerate(rng.normal(size=(60, 4)).astype(np.float32).tolist())]
    vectors += [(None, [1.0, 2.0, 3.0, 4.0]), (None, [1.0, 2.0, 3.0, 4.0]), (77, [1.0, 2.0]), (78, []), (79, [1.0] * 9)]
    got = whitening.whitened(clash(frame(spark, vectors), "index", "values", "n", "deviation", "component", "x", "size")).collect()
    assert len(got) == 62 * 4 and {r["n"] for r in got} == {62} and got[0]["identity_error"] < 1e-9
    assert sum(r["vec_id"] is None for r in got) == 8
    assert whitening.whitened(frame(spark, [])).collect() == []
    assert whitening.whitened(frame(spark, [(1, None)])).collect() == []
    assert whitening.whitened(frame(spark, [(1, []), (2, [])])).collect() == []
    flat = whitening.whitened(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [(r["whitened"], r["identity_error"], r["deviation"]) for r in flat] == [(None, None, 0)] * 4
    line = whitening.whitened(frame(spark, [(1, [1.0, 2.0]), (2, [3.0, 4.0])])).collect()
    assert sorted((r["component"], r["whitened"] is None) for r in line) == [(1, False), (1, False), (2, True), (2, True)]
    large = whitening.whitened(frame(spark, [(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [5.0, 1.0])])).collect()
    assert len(large) == 6
