"""op4 and op5 against brute force."""
import numpy as np
import pytest

from jobledger.llm import maxscore, rabitq

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet")


def brute(ids, data, chosen, k, score):
    out = {}
    for i in np.flatnonzero(chosen):
        s = score(data, data[i])
        mine = np.flatnonzero(ids != ids[i])
        best = mine[np.lexsort((ids[mine], -s[mine]))][:k]
        out[int(ids[i])] = [(int(ids[j]), s[j]) for j in best]
    return out


def grouped(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def arrays(df):
    p = df.toPandas()
    return p.vec_id.to_numpy(), np.stack(p.embedding).astype(float)


def test_maxscore_equals_brute_force(vectors):
    ids, data = arrays(vectors)
    got = maxscore.top_k(vectors, vectors.filter("vec_id % 50 = 0"), shard_rows=128, query_rows=4).collect()
    whole = np.floor(data * 256).astype(np.int64)
    assert grouped(got) == brute(ids, whole, ids % 50 == 0, 5, lambda d, q: d @ q)


@pytest.mark.parametrize("seed", range(3))
def test_maxscore_shard_with_ties_and_sparse_rows(seed):
    rng = np.random.default_rng(seed)
    data = rng.integers(-3, 4, (700, 12)) * (rng.random((700, 12)) < 0.4)
    ids = rng.permutation(700)
    shard = maxscore.Shard(ids, data)
    for i in range(0, 700, 31):
        found, score = shard.top(data[i], ids[i], 5)
        want = brute(ids, data, np.arange(700) == i, 5, lambda d, q: d @ q)[ids[i]]
        assert list(zip(found.tolist(), score.tolist())) == [(a, b) for a, b in want]


def test_rabitq_recall_and_scores(vectors):
    ids, data = arrays(vectors)
    got = grouped(rabitq.search(vectors, vectors.filter("vec_id % 20 = 0"), block_rows=200, query_rows=7).collect())

    def score(d, q):
        out = np.zeros(len(d))
        for k in range(len(q)):
            out += d[:, k] * q[k]
        return out

    want = brute(ids, data, ids % 20 == 0, 20, score)
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]
    assert np.mean(hits) >= 0.98
    for q, rows in got.items():
        exact = dict(zip(ids.tolist(), score(data, data[ids == q][0])))
        assert all(exact[i] == s for i, s in rows) and len(rows) == 20


def test_rabitq_error_bound_holds():
    rng = np.random.default_rng(3)
    data, queries = rng.standard_normal((500, 64)), rng.standard_normal((20, 64))
    turn = rabitq.rotation(128)
    codes, norm, c = rabitq.encode(data, turn)
    est, err = rabitq.estimate(codes, norm, c, queries, turn)
    assert (np.abs(est - queries @ data.T) <= err).mean() > 0.99


@pytest.fixture(scope="module")
def odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], "a"), (20, None, "a"), (40, [0.0, 0.0], None), (60, [nan, 1.0], "a"), (80, [inf], "a"),
            (100, [1.0, None], "a"), (None, [1.0, 1.0], "a"), (200, [1.0, 2.0], "a"), (300, [1.0, 2.0], "a"),
            (300, [1.0, 2.0], "a"), (400, [3.0], "a"), (500, [], "a")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")


def test_odd_vectors(odd_vectors):
    got = grouped(maxscore.top_k(odd_vectors, odd_vectors.filter("vec_id % 50 = 0")).collect())
    assert set(got) == {0, 200, 300, 400, 500}
    assert [i for i, _ in got[200]] == [0, 300, 300, 400, 40]  # ties to the smaller id, own id left out
    assert [i for i, _ in got[500]] == [0, 40, 200, 300, 300]
    got = grouped(rabitq.search(odd_vectors, odd_vectors.filter("vec_id % 20 = 0")).collect())
    assert set(got) == {0, 200, 300, 400}
    assert got[0] == [(200, 5.0), (300, 5.0), (300, 5.0), (400, 3.0)]


def test_empty_vectors(odd_vectors):
    none = odd_vectors.filter("false")
    assert maxscore.top_k(none, none).count() == 0 == rabitq.search(none, none).count()
    assert maxscore.top_k(odd_vectors, none).count() == 0


def run_plan(df):
    """The plan of ``df`` as it ran, and its rows."""
    rows = df.collect()
    return df._jdf.queryExecution().executedPlan().toString(), rows


@pytest.fixture(scope="module")
def drawn(spark):
    data = np.random.default_rng(11).standard_normal((400, 16)).round(3)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
    return np.arange(400), data, rows


def test_maxscore_queries_are_not_broadcast(drawn):
    """Their blocks are small, but not the copies for all lanes."""
    ids, data, rows = drawn
    plan, got = run_plan(maxscore.top_k(rows, rows.filter("vec_id % 20 = 0"), shard_rows=64, query_rows=4))
    assert "Broadcast" not in plan and "Generate" not in plan
    assert grouped(got) == brute(ids, np.floor(data * 256).astype(np.int64), ids % 20 == 0, 5, lambda d, q: d @ q)


def test_rabitq_queries_are_not_broadcast(drawn):
    """Their blocks are small, but not the copies for all lanes."""
    ids, data, rows = drawn
    plan, got = run_plan(rabitq.search(rows, rows.filter("vec_id % 20 = 0"), epsilon=1e9, block_rows=64, query_rows=4))
    assert "Broadcast" not in plan and "Generate" not in plan
    # with an endless error bound every row is scored
    want = brute(ids, data, ids % 20 == 0, 20, lambda d, q: rabitq.dots(d, q))
    assert grouped(got) == want
