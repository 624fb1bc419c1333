import numpy as np
import pytest

from understory.operators import message, tree

EDGE = "parent string, child string, length double"


def random_tree(n, rng, chain=False):
    """Edges of a tree of n nodes; a chain hangs one tip on every node of a long path."""
    if chain:
        edges = [(f"c{i}", f"c{i + 1}", float(rng.uniform(0.1, 1))) for i in range(n)]
        edges += [(f"c{i}", f"t{i}", float(rng.uniform(0.1, 1))) for i in range(1, n + 1)]
        return [*edges, (f"c{n}", "last", 0.5)]
    return [(f"x{int(rng.integers(0, i))}", f"x{i}", float(rng.uniform(0.1, 1))) for i in range(1, n)]


def covariance(edges):
    """Tips and the dense matrix of shared lengths from the root."""
    up = {c: (p, t) for p, c, t in edges}
    ends = sorted(set(up) - {p for p, _, _ in edges})
    paths = {}
    for tip in ends:
        at, path = tip, {}
        while at in up:
            path[at] = up[at][1]
            at = up[at][0]
        paths[tip] = path
    return ends, np.array([[sum(t for n, t in paths[a].items() if n in paths[b]) for b in ends] for a in ends])


@pytest.mark.parametrize("chain,small", [(False, 0), (True, 40), (True, message.SMALL)])
def test_tip_effects_equal_the_dense_solution(spark, chain, small, monkeypatch):
    monkeypatch.setattr(message, "SMALL", small)
    rng = np.random.default_rng(6)
    edges = random_tree(84 if chain else 170, rng, chain)
    ends, v = covariance(edges)
    assert len(ends) >= 80
    n = rng.integers(0, 6, len(ends)).astype(float)
    s = rng.normal(0, 2, len(ends)) * (n > 0)
    within, between = 0.7, 1.3
    precision = np.diag(n / within) + np.linalg.inv(between * v)
    want, error = np.linalg.solve(precision, s / within), np.sqrt(np.diag(np.linalg.inv(precision)))
    sums = spark.createDataFrame([(t, float(a), float(b)) for t, a, b in zip(ends, n, s) if a > 0], "tip string, n double, s double")
    got = {r["tip"]: r for r in message.tip_effects(sums, spark.createDataFrame(edges, EDGE), within, between).collect()}
    assert sorted(got) == ends
    for tip, a, b in zip(ends, want, error):
        assert got[tip]["estimate"] == pytest.approx(a, abs=1e-9) and got[tip]["est_error"] == pytest.approx(b, rel=1e-8)


def test_log_determinant_of_a_random_tree(spark):
    rng = np.random.default_rng(3)
    edges = random_tree(120, rng)
    ends, v = covariance(edges)
    row = message.log_determinant(spark.createDataFrame(edges, EDGE)).first()
    assert row["n_tips"] == len(ends) and row["log_det"] == pytest.approx(np.linalg.slogdet(v)[1], abs=1e-8)


def test_a_comb_of_a_thousand_forks_takes_few_rounds(spark, monkeypatch):
    monkeypatch.setattr(message, "SMALL", 300)
    rng = np.random.default_rng(4)
    edges = random_tree(1000, rng, chain=True)
    table = spark.createDataFrame(edges, EDGE)
    nodes = message.rooted(table).selectExpr("node", "parent", "v", "1.0D as c", "0.0D as h", "0.0D as ld", "1L as n")
    root, _, rounds = message.contract(nodes, keep=False)
    assert 3 <= rounds <= 10 and root["n"] == len(edges) + 1
    # The same fold by a plain loop from the bottom up.
    below, p, ld = {}, {}, {}
    for a, c, t in edges:
        below.setdefault(a, []).append((c, t))
    for node in [*(f"t{i}" for i in range(1, 1001)), "last", *(f"c{i}" for i in range(1000, -1, -1))]:
        p[node], ld[node] = 1.0, 0.0
        for c, t in below.get(node, []):
            p[node] += p[c] / (1 + t * p[c])
            ld[node] += ld[c] + np.log1p(t * p[c])
    assert root["c"] == pytest.approx(p["c0"], rel=1e-9) and root["ld"] == pytest.approx(ld["c0"], rel=1e-9)


@pytest.mark.parametrize("chain,small", [(False, 0), (True, 60)])
def test_product_with_the_covariance(spark, chain, small, monkeypatch):
    monkeypatch.setattr(message, "SMALL", small)
    rng = np.random.default_rng(9)
    edges = random_tree(84 if chain else 60, rng, chain)
    ends, v = covariance(edges)
    x = rng.normal(size=len(ends))
    x[:3] = 0
    vector = spark.createDataFrame([(t, float(a)) for t, a in list(zip(ends, x))[3:]], "tip string, x double")
    got = {r["tip"]: r["y"] for r in message.product(spark.createDataFrame(edges, EDGE), vector).collect()}
    assert sorted(got) == ends and [got[t] for t in ends] == pytest.approx(list(v @ x))


def test_strange_labels_and_broken_trees(spark):
    edges = spark.createDataFrame([("r", "a", 1.0), ("r", "b", 2.0)], EDGE)
    sums = spark.createDataFrame([("zzz", 1.0, 1.0)], "tip string, n double, s double")
    with pytest.raises(ValueError, match="no tips"):
        message.tip_effects(sums, edges, 1.0, 1.0)
    cycle = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0)], EDGE)
    with pytest.raises(ValueError):
        message.contract(message.rooted(cycle).selectExpr("node", "parent", "v", "0.0D as c", "0.0D as h", "0.0D as ld", "0L as n"))


def test_effects_of_one_level_deep_tree_are_plain_shrinkage(spark):
    edges = spark.createDataFrame([("r", "a", 1.0), ("r", "b", 1.0)], EDGE)
    sums = spark.createDataFrame([("a", 4.0, 8.0)], "tip string, n double, s double")
    got = {r["tip"]: r for r in message.tip_effects(sums, edges, 2.0, 0.5).collect()}
    assert got["a"]["estimate"] == pytest.approx(0.5 * 8 / (4 * 0.5 + 2)) and got["b"]["estimate"] == 0.0
    assert got["b"]["est_error"] == pytest.approx(0.5**0.5)
    assert tree.tips(edges).count() == 2
