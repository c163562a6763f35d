"""Pansharpening of pixels as rows, against the kernel for whole scenes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import kernels
from strandline.operators import sharpening


def test_sharpened_like_the_kernel(spark):
    rnd = np.random.default_rng(2)
    rows, want = [], {}
    for name, n, share in (("many", 400, 0.1), ("few", 30, 0.5), ("cloudy", 200, 0.97), ("all", 20, 1.0), ("flat", 30, 0.0), ("one", 1, 0.0)):
        base = rnd.random((n, 1)) if name != "flat" else np.zeros((n, 1))
        x = base * [[0.2, 0.5, 0.3]] + (rnd.random((n, 3)) * 0.05 if name != "flat" else 0)
        pan, mask = np.round(base[:, 0] * 3 + rnd.random(n) * 0.2, 2), rnd.random(n) < share
        mask[: round(n * 0.96) if name == "cloudy" else 0] = True
        want[name] = kernels.pansharpened(x, pan, mask) if name in ("many", "few") else x
        rows += [(name, k // 20, k % 20, *map(float, v), float(p), bool(m), "x") for k, (v, p, m) in enumerate(zip(x, pan, mask, strict=True))]
    df = spark.createDataFrame(rows, "s string, r int, c int, b double, g double, d double, pan double, cloud boolean, _score string")
    got = {(r.s, r.r * 20 + r.c): (r.b, r.g, r.d) for r in sharpening.pansharpened(df, ["s"], ["b", "g", "d"], "pan", F.col("cloud")).collect()}
    assert len(got) == len(rows)
    for name, x in want.items():
        assert np.allclose([got[name, k] for k in range(len(x))], x, atol=1e-9), name
    assert not np.allclose(want["many"], [r[3:6] for r in rows if r[0] == "many"], atol=1e-3)


def test_unknown_and_repeated_pixels(spark):
    rnd = np.random.default_rng(4)
    x = rnd.random((60, 3)).cumsum(1)
    rows = [("s", k // 10, k % 10, *map(float, v), float(v.sum()), False) for k, v in enumerate(x)]
    nan = [("s", 9, 0, float("nan"), 1.0, 1.0, 1.0, False), ("s", 9, 1, None, 1.0, 1.0, 1.0, False), ("s", 9, 2, 1.0, 1.0, 1.0, None, False), ("s", 9, 3, 1.0, 1.0, 1.0, 1.0, None)]
    schema = "s string, r int, c int, b double, g double, d double, pan double, cloud boolean"
    out = lambda own: sorted(((r.r, r.c, r.b, r.g, r.d) for r in sharpening.pansharpened(spark.createDataFrame(own, schema), ["s"], ["b", "g", "d"], "pan", F.col("cloud")).collect()), key=str)
    plain = out(rows)
    got = out(rows + nan)
    assert len(got) == 64 and [g for g in got if g[0] != 9] == [pytest.approx(p, abs=1e-12) for p in plain]
    assert {g[1]: g[3:] for g in got if g[0] == 9} == dict.fromkeys(range(4), (1.0, 1.0))
    assert len(out(rows + rows[:1])) == 61
    assert sharpening.pansharpened(spark.createDataFrame([], schema), ["s"], ["b", "g", "d"], "pan", F.col("cloud")).count() == 0


def test_directions(spark):
    rnd = np.random.default_rng(6)
    made = [np.cov(rnd.normal(size=(3, 9)) * rnd.random((3, 1))) for _ in range(40)] + [np.diag([1.0, 3.0, 2.0]), np.eye(3) * 2, np.zeros((3, 3)), np.ones((3, 3)), np.diag([5.0, 0, 0])]
    df = spark.createDataFrame([(k, *(float(m[i, j]) for i, j in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)))) for k, m in enumerate(made)] + [(99, None, *[1.0] * 5)], "k int, a double, b double, c double, d double, e double, f double")
    got = {r.k: r.v for r in df.select("k", sharpening.principal([F.col(c) for c in "abcdef"]).alias("v")).collect()}
    assert got[99] is None and got[41] is None and got[42] is None
    for k, m in enumerate(made):
        if k not in (41, 42):
            v = np.linalg.eigh(m)[1][:, -1]
            assert np.allclose(got[k], v * np.sign(v[np.abs(v).argmax()]), atol=1e-7), k
