import numpy as np
import pytest

from tessera.llm import collision, voronoi

SCHEMA = "vec_id long, embedding array<float>, score string, cell int, rank int"


def frame(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, v, "x", 1, 2) for i, v in zip(ids, vectors, strict=True)], SCHEMA)


def brute(vectors, scale, k, every=20):
    out = {}
    x = np.array(vectors, np.float32).astype(float)
    x = np.floor(scale * x) if scale else x
    for q in range(0, len(x), every):
        s = x @ x[q]
        out[q] = [(int(i), s[i]) for i in sorted((i for i in range(len(x)) if i != q), key=lambda i: (-s[i], i))[:k]]
    return out


def got(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_voronoi_equals_brute_force_with_clusters_and_ties(spark):
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((5, 8)) * 6
    v = [(centres[i % 5] + rng.standard_normal(8) * 0.1).tolist() for i in range(300)] + [[1.0] * 8] * 100
    want = brute(v, 64, 20)
    assert {q: [(i, int(s)) for i, s in r] for q, r in want.items()} == got(voronoi.top_k(frame(spark, v)))


def test_voronoi_prunes_far_cells(spark):
    cells = np.array([[100.0, 0], [0, 100.0]])
    import pandas as pd

    table = pd.DataFrame({"cell": [0, 0, 1, 1], "is_query": [False, True, False, True], "n": [500, 5, 500, 5], "ids": [500, 5, 500, 5], "radius": [1.0] * 4, "norm": [101.0] * 4})
    b = voronoi.Bounds(table, cells, 20)
    routed = {g: rows.tolist() for g, rows in b.needed(np.array([0, 1]), np.array([1.0, 1.0]), np.array([101.0, 101.0]))}
    assert sorted(i for rows in routed.values() for i in rows) == [0, 1]
    b.starts = {0: np.array([0]), 1: np.array([1])}
    assert {g: rows.tolist() for g, rows in b.needed(np.array([0, 1]), np.array([1.0, 1.0]), np.array([101.0, 101.0]))} == {0: [0], 1: [1]}


def test_voronoi_exact_for_huge_components(spark):
    v = [[3e9, 1.0], [3e9, -1.0], [2e9, 5.0], [-3e9, 2.0]]
    r = got(voronoi.top_k(frame(spark, v), every=4, scale=1.0))
    x = [[int(a) for a in row] for row in v]
    want = sorted(((sum(a * b for a, b in zip(x[0], x[i], strict=True)), -i) for i in (1, 2, 3)), reverse=True)
    assert r[0] == [(-i, max(-(2**63), min(s, 2**63 - 1))) for s, i in want]


@pytest.mark.parametrize("search", [voronoi.top_k, collision.nearest])
def test_bad_vectors_take_no_part(spark, search):
    v = [[1.0, 2.0], None, [float("nan"), 1.0], [float("inf"), 0.0], [1.0, None], [], [3.0, 1.0], [0.5, 0.5]]
    r = got(search(frame(spark, v), every=20))
    assert [i for i, _ in r[0]] == [6, 7]
    assert list(r) == [0]


@pytest.mark.parametrize("search", [voronoi.top_k, collision.nearest])
def test_empty_table(spark, search):
    assert search(frame(spark, [])).collect() == []


@pytest.mark.parametrize("search", [voronoi.top_k, collision.nearest])
def test_repeated_rows_are_one_candidate(spark, search):
    v, ids = [[1.0, 0.0], [0.9, 0.1], [0.9, 0.1], [0.1, 0.9], [1.0, 0.0]], [0, 1, 1, 2, 0]
    assert [i for i, _ in got(search(frame(spark, v, ids)))[0]] == [1, 2]


def test_collision_recall_and_scores(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((2000, 32))
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32).tolist()
    r, want = got(collision.nearest(frame(spark, v))), brute(v, None, 20)
    hits = sum(len({i for i, _ in r[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / (20 * len(want)) >= 0.9
    exact = {(q, i): s for q in want for i, s in want[q]}
    assert all(abs(s - exact[q, i]) < 1e-12 for q in r for i, s in r[q] if (q, i) in exact)


def test_collision_ties_by_id_in_a_large_group_of_copies(spark):
    v = [[1.0, 0.0, 0.0]] * 300 + [[0.0, 1.0, 0.0]] * 40
    r = got(collision.nearest(frame(spark, v)))
    assert [i for i, _ in r[40]] == list(range(20))
    assert [i for i, _ in r[0]] == list(range(1, 21))


def test_all_candidates_if_fewer(spark):
    assert len(got(voronoi.top_k(frame(spark, [[1.0], [2.0], [3.0]])))[0]) == 2


@pytest.fixture
def small_blocks(monkeypatch):
    """Several blocks of rows and groups of queries."""
    for module in (voronoi, collision):
        monkeypatch.setattr(module, "BLOCK_ROWS", 150)
        monkeypatch.setattr(module, "GROUP_QUERIES", 8)


def clustered(n, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, 8)) * 5
    return [(centres[i % 12] + rng.standard_normal(8) * 0.2).astype(np.float32).tolist() for i in range(n)]


def test_voronoi_over_several_blocks_and_groups(spark, small_blocks):
    rng = np.random.default_rng(6)
    v = clustered(900) + [[1.0] * 8] * 300 + rng.standard_normal((300, 8)).astype(np.float32).tolist()
    want = brute(v, 64, 20)
    assert {q: [(i, int(s)) for i, s in r] for q, r in want.items()} == got(voronoi.top_k(frame(spark, v)))


def test_voronoi_sends_queries_only_to_blocks_that_reach_them(spark, small_blocks):
    import pandas as pd

    far = np.array([[100.0, 0], [0, 100.0], [-100.0, 0]])
    cells = pd.DataFrame({"cell": [0, 0, 1, 1, 2, 2], "is_query": [False, True] * 3, "n": [500, 5] * 3, "ids": [500, 5] * 3, "radius": [1.0] * 6, "norm": [101.0] * 6})
    b = voronoi.Bounds(cells, far, 20)
    assert b.n_blocks.tolist() == [4, 4, 4] and sorted(b.first_block.tolist()) == [0, 4, 8]
    assert sum(len(x) for x in b.blocks.values()) < 12 * len(b.blocks)


def test_collision_recall_over_several_blocks_and_groups(spark, small_blocks):
    rng = np.random.default_rng(7)
    v = clustered(900) + rng.standard_normal((600, 8)).astype(np.float32).tolist()
    r, want = got(collision.nearest(frame(spark, v))), brute(v, None, 20)
    hits = sum(len({i for i, _ in r[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / (20 * len(want)) >= 0.9


@pytest.mark.parametrize("sparse", [0.0, 2.0])
def test_collisions_are_counted_alike_both_ways(monkeypatch, sparse):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((500, 6))
    norm = np.linalg.norm(x, axis=1).max()
    want = [sorted(r.tolist()) for r, _ in collision.Index(x, norm).search(x[:9], 20, [np.array([i]) for i in range(9)])]
    monkeypatch.setattr(collision, "SPARSE", sparse)
    assert want == [sorted(r.tolist()) for r, _ in collision.Index(x, norm).search(x[:9], 20, [np.array([i]) for i in range(9)])]


def test_voronoi_many_rows_of_one_id(spark):
    rng = np.random.default_rng(9)
    v = rng.standard_normal((100, 4)).astype(np.float32).tolist()
    best = [[50.0] * 4] * 40
    r = got(voronoi.top_k(frame(spark, v + best + [v[0]] * 30, [*range(100), *[1000] * 40, *[0] * 30])))
    want = brute([*v, best[0]], 64, 20)
    assert [i if i != 100 else 1000 for i, _ in want[0]] == [i for i, _ in r[0]]


def test_collision_of_tiny_and_huge_components(spark):
    rng = np.random.default_rng(3)
    for scale in (1e-200, 1e-310, 1e150):
        x = rng.standard_normal((60, 8)) * scale
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        got = collision.nearest(df).collect()
        assert {(r.query_id, r["rank"]) for r in got} == {(q, k) for q in (0, 20, 40) for k in range(1, 21)}
        assert all(r.score == pytest.approx(float(x[r.query_id] @ x[r.vec_id]), rel=1e-9) for r in got)
    mixed = spark.createDataFrame([(i, [1e-200 if i % 2 else 1.0, 0.0]) for i in range(50)], "vec_id long, embedding array<double>")
    assert collision.nearest(mixed).count() == 60
