"""Whitening, nearest neighbours and hard negatives against plain numpy on small odd tables."""

import math

import duckdb
import numpy as np
import pytest

from quernal.llm import annforest, hardneg, registry, whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def rows():
    """Clusters of near and exact copies, a third of all rows in one; ties, repeated rows, nulls, odd entries, short vectors."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(30, 12))
    points = [base[0] + 0.02 * rng.normal(size=12) for _ in range(200)] + [base[i % 30] * 0.5 + rng.normal(size=12) for i in range(280)]
    points += [points[300]] * 40 + [2 * points[300]] * 10
    out = [(i, [float(np.float32(x)) for x in p], i % 4 if i % 9 else None) for i, p in enumerate(points)]
    odd = [None, [], [0.0] * 12, [1.0, None] + [0.5] * 10, [math.nan] + [0.5] * 11, [math.inf] + [0.5] * 11, [0.25, -0.5, 1.0]]
    out += [(1000 + i, v, i % 3) for i, v in enumerate(odd)]
    return [*out, out[50], out[50], out[301], (None, out[7][1], 1)]


@pytest.fixture(scope="module")
def frame(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.selectExpr("*", "1 as id", "'x' as v", "2 as cell", "3 as score", "4 as rank", "5 as g", "6 as copy", "7 as part").repartition(3)


def _fine(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def _matrix(rows, size=12):
    return np.array([list(v) + [0.0] * (size - len(v)) for _, v, _ in rows])


def test_whitening_is_that_of_the_covariance(frame, rows):
    kept = [r for r in rows if _fine(r[1])]
    x = np.floor(64 * _matrix(kept)).astype(np.int64) + 1_000_000
    n, s = len(kept), x.sum(axis=0)
    centred = (n * x - s) / n
    e, axes = np.linalg.eigh(centred.T @ centred / n)
    e, axes = e[::-1], axes[:, ::-1]
    got = whitening.whiten(frame).collect()
    assert len(got) == n * 12
    want = {}
    for (i, _, _), c, d in zip(kept, centred @ axes / np.sqrt(e), ((n * x - s) ** 2).sum(axis=1), strict=True):
        want.setdefault(i, []).append((c, int(d)))
    sign = {}
    for row in got:
        options = want[row.vec_id]
        assert row.n == n and int(row.deviation) in [d for _, d in options]
        c = options[0][0][row.component - 1]
        if len({tuple(c) for c, _ in options}) == 1 and abs(c) > 1e-3:
            assert sign.setdefault(row.component, np.sign(c * row.whitened)) * row.whitened == pytest.approx(c, abs=1e-9)
        assert row.explained == pytest.approx(e[row.component - 1] / e.sum(), rel=1e-9)
        assert row.identity_error < 1e-9


def test_whitening_of_few_dimensions_rows_and_none(spark, frame):
    assert whitening.whiten(frame.limit(0)).count() == 0
    assert whitening.whiten(frame.where("embedding is null")).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0], 0) for i in range(5)], SCHEMA)
    assert whitening.whiten(same).count() == 0  # no variance, no component
    flat = spark.createDataFrame([(i, [float(i), 2.0, 2.0 * i], 0) for i in range(6)], SCHEMA)
    found = whitening.whiten(flat).collect()  # one dimension is constant, one depends on another
    assert {r.component for r in found} == {1} and found[0].identity_error < 1e-9
    few = spark.createDataFrame([(i, np.random.default_rng(i).normal(size=40).tolist(), 0) for i in range(9)], SCHEMA)
    assert {r.component for r in whitening.whiten(few).collect()} == set(range(1, 9))
    huge = spark.createDataFrame([(i, [1e30 * (i % 2), float(i)], 0) for i in range(4)], SCHEMA)
    assert all(float(r.deviation) > 2**63 for r in whitening.whiten(huge).collect())


def test_whitening_keeps_precision_with_uneven_variances(spark):
    rng = np.random.default_rng(2)
    points = rng.normal(size=(400, 6)) * [1e5, 1e3, 10, 1, 0.5, 0.3]
    got = whitening.whiten(spark.createDataFrame([(i, p.tolist(), 0) for i, p in enumerate(points)], "vec_id long, embedding array<double>, label int")).collect()
    white = np.zeros((400, 6))
    for r in got:
        white[r.vec_id, r.component - 1] = r.whitened
    assert np.abs(np.cov(white.T, bias=True) - np.eye(6)).max() < 1e-9


def _nearest(rows, queries, k):
    """{query: [(score, id)]} by comparing everything."""
    kept = [(i, np.array(list(v) + [0.0] * (12 - len(v)))) for i, v, _ in rows if i is not None and _fine(v) and any(v)]
    out = {}
    for q, v in kept:
        if q in queries:
            best = {}
            for i, w in kept:
                if i != q:
                    score = (v * w).sum() / (math.sqrt((v * v).sum()) * math.sqrt((w * w).sum()))
                    best[i] = max(best.get(i, -9), score)
            out[q] = sorted(((s, i) for i, s in best.items()), key=lambda x: (-round(x[0], 12), x[1]))[:k]
    return out


def test_forest_finds_the_nearest(frame, rows, monkeypatch):
    monkeypatch.setattr(annforest, "CELL", 32)  # several cells, cells in parts, queries in blocks
    monkeypatch.setattr(annforest, "BLOCK", 20)
    monkeypatch.setattr(annforest, "BROADCAST_CELLS", 0)
    queries = {i for i, _, _ in rows if i is not None and i % 11 == 0}
    asked = frame.where("vec_id % 11 = 0").selectExpr("vec_id as query_id", "embedding")
    got = {}
    for r in annforest.nearest(frame, asked, 5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = _nearest(rows, queries, 5)
    assert got.keys() == want.keys()
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5] and q not in {i for _, i, _ in found}
        assert len({i for _, i, _ in found}) == 5
        hits += sum(round(s, 9) >= round(want[q][-1][0], 9) for _, _, s in found)
    assert hits >= 0.9 * 5 * len(want)
    copies = [q for q in want if 480 <= q < 530]  # equal vectors tie: the least ids come first, with one score
    for q in copies:
        assert [i for _, i, _ in sorted(got[q])] == [i for _, i in want[q]]
        assert len({s for _, _, s in got[q][:3]}) == 1


def test_forest_of_few_rows_and_none(spark, frame):
    asked = frame.selectExpr("vec_id as query_id", "embedding")
    assert annforest.nearest(frame.limit(0), asked.limit(0)).count() == 0
    assert annforest.nearest(frame, asked.limit(0)).count() == 0
    three = spark.createDataFrame([(50, [1.0, 0.0], 0), (1, [-1.0, 0.0], 0), (2, [0.0, 0.0], 0), (3, [1.0, 1.0], 0)], SCHEMA)
    got = annforest.nearest(three, three.where("vec_id = 50").selectExpr("vec_id as query_id", "embedding")).orderBy("rank").collect()
    assert [(r.rank, r.vec_id) for r in got] == [(1, 3), (2, 1)]
    assert [r.score for r in got] == pytest.approx([math.sqrt(0.5), -1.0])
    with pytest.raises(ValueError):
        annforest.nearest(three, three, 0)


def test_forest_recall_without_structure(spark):
    rng = np.random.default_rng(1)
    points = rng.normal(size=(3000, 32)).astype(np.float32)
    df = spark.createDataFrame([(i, p.tolist(), 0) for i, p in enumerate(points)], SCHEMA)
    got = {}
    for r in annforest.nearest(df, df.where("vec_id % 50 = 0").selectExpr("vec_id as query_id", "embedding")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    hits = 0
    for q, found in got.items():
        score = unit @ unit[q]
        score[q] = -9
        hits += len(found & set(np.argsort(-score)[:5].tolist()))
    assert len(got) == 60 and hits >= 0.9 * 300


def test_levels_go_up_until_a_miss_is_unlikely():
    cosine = np.array([0.99, 0.9, 0.5, 0.1, 1.0, -1.0])
    x, j = annforest._levels(cosine, np.full(6, 5), 5)
    assert (np.diff(x[:4]) < 0).all() and x[4] == annforest.BITS and x[5] == 0
    p = 1 - np.arccos(cosine[:4]) / np.pi
    missed = (1 - p ** x[:4]) ** j[:4] * (1 - p ** (x[:4] + 1)) ** (annforest.TREES - j[:4])
    assert (missed <= annforest.MISS + 1e-9).all() and (missed > annforest.MISS / 2).all()
    assert annforest._levels(np.array([0.99]), np.array([4]), 5)[0][0] == 0  # too few found: all the way


def _mined(rows):
    con = duckdb.connect()
    con.execute("create table embeddings (vec_id bigint, embedding float[], label int)")
    con.executemany("insert into embeddings values (?, ?, ?)", [list(r) for r in rows if r[1] is None or len(r[1]) == 12])
    return con.sql(registry.ORACLES["op13_hardneg"]).fetchall()


@pytest.mark.parametrize("dense", [0.0, 0.1, 2.0])
def test_hard_negatives_are_those_of_brute_force(spark, rows, monkeypatch, dense):
    monkeypatch.setattr(hardneg, "DENSE", dense)
    monkeypatch.setattr(hardneg, "BLOCK", 3)
    monkeypatch.setattr(hardneg, "ROWS", 16)
    monkeypatch.setattr(hardneg, "ANCHORS", 2)
    whole = [r for r in rows if r[1] is None or len(r[1]) == 12]
    df = spark.createDataFrame(whole, SCHEMA).selectExpr("*", "1 as id", "'x' as v", "3 as score", "4 as rank").repartition(4)
    kept = hardneg.usable(df)
    got = hardneg.mine(kept, kept.where("id % 100 = 0")).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()
    assert sorted(map(tuple, got)) == sorted(_mined(whole)) and got


def test_hard_negatives_of_short_vectors_and_none(spark, frame):
    kept = hardneg.usable(frame)
    assert hardneg.mine(kept.limit(0), kept.limit(0)).count() == 0
    assert hardneg.mine(kept, kept.limit(0)).count() == 0
    few = spark.createDataFrame([(100, [1.0, 1.0], 0), (1, [1.0], 0), (2, [0.5], 1), (3, [0.25, 0.5], 2), (4, [1.0, 0.0], 1)], SCHEMA)
    got = hardneg.mine(hardneg.usable(few), hardneg.usable(few).where("id = 100")).collect()
    assert [(r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in got] == [(1, 1, 3, 65536, 49152), (1, 2, 2, 65536, 32768)]


def test_scores_beyond_doubles_stay_exact():
    a = np.array([[float(1 << 30), 1.0]])
    assert hardneg.exact(a, np.array([[float(1 << 30), 3.0]]), rowwise=True)[0] == (1 << 60) + 3


def test_bounds_hold():
    rng = np.random.default_rng(3)
    a, b = hardneg.Summary(np.floor(rng.normal(size=(20, 37)) * 90)), hardneg.Summary(np.floor(rng.normal(size=(30, 37)) * 90))
    true = a.rows @ b.rows.T
    widths = []
    for (m, s), (n, t) in zip(a.levels, b.levels, strict=True):
        assert (m @ n.T + s @ t.T >= true - 1e-6).all() and (m @ n.T - s @ t.T <= true + 1e-6).all()
        widths.append((s @ t.T).mean())
    assert widths == sorted(widths, reverse=True)  # finer segments bound more tightly
