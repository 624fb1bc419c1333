"""Ranks, intervals, tests and distances against direct computation."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from understory.functions import noise
from understory.functions.links import log_gamma
from understory.functions.student import critical_value, holm, two_sided_p
from understory.operators import accuracy, collinear, draws, message, rank, spatial, tree


# Published two-sided 95 % critical values.
@pytest.mark.parametrize(
    "df,value", [(1, 12.706205), (2, 4.302653), (5, 2.570582), (30, 2.042272), (120, 1.979930), (10**6, 1.959966)]
)
def test_critical_values(df, value):
    assert critical_value(df) == pytest.approx(value, abs=2e-6)


def test_tails():
    assert two_sided_p(2.0, 10) == pytest.approx(0.07338803, abs=1e-8)
    assert two_sided_p(1.0, 1) == pytest.approx(0.5, rel=1e-12) and two_sided_p(0.0, 7) == pytest.approx(1.0)
    assert two_sided_p(3.0, 1e12) == pytest.approx(math.erfc(3 / math.sqrt(2)), rel=1e-9)
    assert two_sided_p(40.0, 10) == pytest.approx(2.28085774e-12, rel=1e-6)


def test_holm():
    assert list(holm(np.array([0.01, 0.04, 0.03]))) == pytest.approx([0.03, 0.06, 0.06])


def test_log_gamma(spark):
    values = [0.001, 0.5, 1.0, 3.7, 40.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r[0] for r in df.select(log_gamma(F.col("x"))).collect()]
    assert got == pytest.approx([math.lgamma(v) for v in values], abs=1e-9)


def shortest(x, width):
    x = np.sort(x)
    k = math.floor(len(x) * width)
    spans = x[k:] - x[: len(x) - k]
    i = int(np.argmin(spans))
    return x[i], x[i + k]


def test_ranks_with_a_hot_key_and_a_hot_value(spark, monkeypatch):
    monkeypatch.setattr(rank, "RANKS_PER_BLOCK", 16)
    rng = np.random.default_rng(5)
    groups = {
        "hot": np.concatenate([rng.gamma(2.0, size=700), np.full(500, 1.25)]),
        "ties": rng.integers(0, 4, 90).astype(float),
        "one": np.array([3.0]),
    }
    rows = [(k, float(v)) for k, values in groups.items() for v in values] + [("hot", None), ("hot", float("nan"))]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    six = {r["k"]: r for r in rank.six_numbers(df, ["k"], "v").collect()}
    intervals = {(r["k"], r["width"]): r for r in rank.shortest_intervals(df, ["k"], "v", (0.5, 0.95)).collect()}
    for key, values in groups.items():
        want = [values.min(), *np.quantile(values, [0.25, 0.5]), values.mean(), np.quantile(values, 0.75), values.max()]
        assert list(six[key])[1:] == pytest.approx(want)
        for width in (0.5, 0.95):
            if len(values) > 1:
                row = intervals[key, width]
                assert (row["lower"], row["upper"]) == pytest.approx(shortest(values, width))
                assert row["median"] == pytest.approx(np.median(values))


def test_ranks_of_a_whole_column_and_of_null_keys(spark):
    df = spark.createDataFrame([(None, float(v)) for v in range(11)], "k string, v double")
    assert rank.six_numbers(df, [], "v").first()["q1"] == 2.5
    assert rank.quantiles(df, ["k"], "v", {"q": 0.9}).first()["q"] == 9.0


def test_rhat_of_equal_and_of_shifted_chains(spark):
    rng = np.random.default_rng(1)
    rows = []
    for chain in range(1, 5):
        for i, v in enumerate(rng.normal(size=101)):
            rows += [(chain, i + 1, "same", float(v)), (chain, i + 1, "shifted", float(v) + 3.0 * chain)]
    got = {
        r["terms"]: r["rhat"]
        for r in draws.split_rhat(spark.createDataFrame(rows, "chain int, iteration int, terms string, value double")).collect()
    }
    assert abs(got["same"] - 1.0) < 0.05 and got["shifted"] > 2.0


def test_waic_of_tiny_densities_does_not_vanish(spark):
    df = spark.createDataFrame([(1, -2000.0), (1, -2001.0), (2, -1.0), (2, -1.0)], "row_id int, ll double")
    got = {r["row_id"]: r for r in draws.waic_points(df).collect()}
    assert got[1]["lppd"] == pytest.approx(-2000.0 + math.log((1 + math.exp(-1)) / 2))
    loo = {r["row_id"]: r["elpd_loo"] for r in draws.loo_points(df).collect()}
    assert loo[2] == pytest.approx(-1.0)


def test_correlation_is_pairwise_complete_and_flags_high_values(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3)) + 1e6
    x[:, 1] = x[:, 0] + 0.1 * rng.normal(size=400)
    rows = [tuple(None if i % 7 == j else float(v) for j, v in enumerate(row)) for i, row in enumerate(x)]
    table = collinear.corr_pairs(spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"])
    got = {(r["term_a"], r["term_b"]): r for r in table.collect()}
    keep = np.array([i % 7 not in (0, 1) for i in range(400)])
    assert got["a", "b"]["n"] == keep.sum()
    assert got["a", "b"]["r"] == pytest.approx(np.corrcoef(x[keep, 0], x[keep, 1])[0, 1], abs=1e-7)
    assert got["a", "b"]["high"] and not got["a", "c"]["high"]


def test_variance_inflation(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 3))
    x[:, 2] += x[:, 0]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, `a:b` double")
    got = {r["term"]: r["vif"] for r in collinear.vif(df, ["a", "b", "a:b"]).collect()}
    want = np.diag(np.linalg.inv(np.corrcoef(x.T)))
    assert [got["a"], got["b"], got["a:b"]] == pytest.approx(list(want))


def test_t_interval_needs_two_rows(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "k string, x double")
    got = {r["k"]: r for r in accuracy.mean_interval(df, "k", "x").select("k", "ci.*").collect()}
    assert got["a"]["accuracy_upr"] == pytest.approx(2.0 + 12.706205)
    assert got["b"]["accuracy_xbar"] == 5.0 and got["b"]["accuracy_lwr"] is None


def kilometres(a, b):
    (lon1, lat1), (lon2, lat2) = np.radians(a), np.radians(b)
    h = np.sin((lat2 - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin((lon2 - lon1) / 2) ** 2
    return 2 * 6371.0088 * math.asin(min(1.0, math.sqrt(h)))


@pytest.mark.parametrize("block", [4, 512])
def test_neighbours_equal_brute_force(spark, monkeypatch, block):
    """A crowded spot, the date line, both poles, and plots on one position."""
    monkeypatch.setattr(spatial, "BLOCK_SIZE", block)
    rng = np.random.default_rng(8)
    points = np.vstack(
        [
            np.column_stack([rng.normal(-156, 0.3, 80), rng.normal(20, 0.3, 80)]),
            np.column_stack([rng.choice([179.95, -179.95], 20) + rng.normal(0, 0.04, 20), rng.normal(0, 0.2, 20)]),
            np.column_stack([rng.uniform(-180, 180, 25), rng.uniform(89.7, 90, 25)]),
            np.column_stack([rng.uniform(-180, 180, 15), rng.uniform(-90, -89.7, 15)]),
            np.column_stack([rng.uniform(-180, 180, 25), rng.uniform(66, 66.5, 25)]),
        ]
    )
    points[:, 0] = (points[:, 0] + 180) % 360 - 180
    points = np.vstack([points, points[:6], points[:3], [[0.0, 45.0]]])
    z = rng.normal(size=len(points))
    rows = [(i, float(lon), float(lat), float(v)) for i, ((lon, lat), v) in enumerate(zip(points, z))]
    df = spark.createDataFrame(rows, "id int, lon double, lat double, z double")
    stats = {r["id"]: r for r in spatial.neighbour_stats(df, "lon", "lat").collect()}
    rac = {r["id"]: r["rac"] for r in spatial.autocovariate(df, "z", lon="lon", lat="lat").collect()}
    assert len(stats) == len(rac) == len(points)
    for i, a in enumerate(points):
        near = [(kilometres(a, b), z[j]) for j, b in enumerate(points) if tuple(a) != tuple(b)]
        near = [(d, v) for d, v in near if 0 < d <= 25.0]
        assert stats[i]["neighbours"] == len(near)
        if near:
            weights = np.array([1 / d for d, _ in near])
            assert stats[i]["nearest_km"] == pytest.approx(min(d for d, _ in near), rel=1e-6)
            assert rac[i] == pytest.approx(float(weights @ [v for _, v in near] / weights.sum()), rel=1e-6, abs=1e-9)
        else:
            assert rac[i] == 0.0


def test_autocovariate_of_a_constant_is_that_constant(spark):
    df = spark.createDataFrame([(float(i) / 100, 20.0, 3.5) for i in range(10)], "lon double, lat double, z double")
    got = spatial.autocovariate(df, "z", lon="lon", lat="lat").select("rac").collect()
    assert [r[0] for r in got] == pytest.approx([3.5] * 10)


def random_tree(rng, n):
    edges, open_nodes, count = [], ["root"], 0
    while len(open_nodes) < n:
        node = open_nodes.pop(int(rng.integers(len(open_nodes))))
        for _ in range(int(rng.integers(2, 4))):
            count += 1
            edges.append((node, f"v{count}", float(rng.uniform(0.1, 2.0))))
            open_nodes.append(f"v{count}")
    return edges, open_nodes


def caterpillar(n):
    """Deepest shape: every inner node carries one tip."""
    edges = []
    for i in range(n):
        edges += [(f"i{i}", f"t{i}", 0.5 + i), (f"i{i}", f"i{i + 1}", 1.0)]
    return edges, [*(f"t{i}" for i in range(n)), f"i{n}"]


def dense_covariance(edges, leaves):
    up = {c: (p, t) for p, c, t in edges}

    def path(node):
        branches = {}
        while node in up:
            branches[node] = up[node][1]
            node = up[node][0]
        return branches

    paths = {leaf: path(leaf) for leaf in leaves}
    return np.array(
        [[sum(t for e, t in paths[a].items() if e in paths[b]) for b in leaves] for a in leaves]
    )


@pytest.mark.parametrize("shape", ["random", "caterpillar"])
def test_tree_covariance_and_determinant(spark, shape):
    edges, leaves = random_tree(np.random.default_rng(2), 14) if shape == "random" else caterpillar(11)
    table = spark.createDataFrame(edges, "parent string, child string, length double")
    want = dense_covariance(edges, leaves)
    place = {leaf: i for i, leaf in enumerate(leaves)}

    def dense(df):
        matrix = np.zeros((len(leaves), len(leaves)))
        rows = df.collect()
        for r in rows:
            matrix[place[r["tip_i"]], place[r["tip_j"]]] = r["shared"]
        assert len(rows) == (want != 0).sum()
        return matrix

    assert np.allclose(dense(tree.vcv(table)), want)
    row = message.log_determinant(table).first()
    assert row["n_tips"] == len(leaves)
    assert row["log_det"] == pytest.approx(np.linalg.slogdet(want)[1])
    assert np.linalg.det(dense(message.scaled_vcv(table))) == pytest.approx(1.0)
    vector = spark.createDataFrame([(leaf, float(i) - 3.0) for leaf, i in place.items()], "tip string, x double")
    product = {r["tip"]: r["y"] for r in tree.times(tree.tip_factor(table), vector).collect()}
    x = np.array([place[leaf] - 3.0 for leaf in leaves])
    assert [product[leaf] for leaf in leaves] == pytest.approx(list(want @ x))


def test_long_chain_is_one_branch_and_a_cycle_is_refused(spark):
    chain = [(f"n{i}", f"n{i + 1}", 0.5) for i in range(59)] + [("n0", "other", 2.0)]
    table = spark.createDataFrame(chain, "parent string, child string, length double")
    row = message.log_determinant(table).first()
    assert (row["n_tips"], row["log_det"]) == (2, pytest.approx(math.log(59 * 0.5) + math.log(2.0)))
    loop = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "a", 1.0)], "parent string, child string, length double")
    with pytest.raises(ValueError, match="cycle"):
        tree.root_paths(loop)


def test_blocks_too_far_apart_never_meet(spark, monkeypatch):
    rng = np.random.default_rng(8)
    points = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(-156.6, -155.4, 900), rng.uniform(19.5, 20.5, 900)))]
    df = spark.createDataFrame(points, "id int, lon double, lat double")
    whole = sorted(tuple(r) for r in spatial.neighbour_stats(df, "lon", "lat").select("id", "neighbours", F.round("nearest_km", 9)).collect())
    pairs = []
    kept = spatial.block_pairs
    monkeypatch.setattr(spatial, "block_pairs", lambda g, b: pairs.append((b.count(), kept(g, b).count())) or kept(g, b))
    monkeypatch.setattr(spatial, "BLOCK_SIZE", 10)
    cut = sorted(tuple(r) for r in spatial.neighbour_stats(df, "lon", "lat").select("id", "neighbours", F.round("nearest_km", 9)).collect())
    assert cut == whole
    blocks, met = pairs[0]
    assert blocks > 90 and met < 0.5 * blocks * blocks


def test_rows_without_a_position_have_no_neighbour(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 1.0), (2, 0.1, 0.0, 3.0), (3, None, 0.0, 2.0), (4, 0.0, None, 2.0)], "id int, lon double, lat double, z double")
    got = {r["id"]: (r["neighbours"], r["nearest_km"] is None) for r in spatial.neighbour_stats(df, "lon", "lat").collect()}
    assert got == {1: (1, False), 2: (1, False), 3: (0, True), 4: (0, True)}
    assert {r["id"]: r["rac"] for r in spatial.autocovariate(df, "z", lon="lon", lat="lat").collect()} == {1: 3.0, 2: 1.0, 3: 0.0, 4: 0.0}


def test_noise_of_terms_is_the_same_in_spark_and_sql(spark, duck):
    keys = [(r, d) for r in (1, 5, 77) for d in range(1, 5)]
    got = [x[0] for x in spark.createDataFrame(keys, "r long, d long").select(noise.normal_column(F.col("r"), F.col("d"), 3)).collect()]
    sql = [duck.execute(f"SELECT {noise.normal_sql(f'{r}::BIGINT', f'{d}::BIGINT', 3)}").fetchone()[0] for r, d in keys]
    assert sql == pytest.approx(got, abs=1e-12)


def test_noise_of_rows_is_the_same_in_sql_and_normal(spark, duck):
    rows, numbers = np.array([5, -77, 2**62]), np.arange(1, 5)
    want = noise.normals(rows, numbers, 3, noise.LEVEL)
    parts = lambda r: [noise.salted_sql(f"({r}::HUGEINT & {noise.FULL}::HUGEINT)::UBIGINT", noise.LEVEL + k, 3) for k in (0, 1)]
    sql = [duck.execute(f"SELECT {noise.deviate_sql(*parts(r), noise.mix64_sql(f'{d}::UBIGINT'))}").fetchone()[0] for r in rows for d in numbers]
    assert sql == pytest.approx(list(want.ravel()), abs=1e-12)
    z = noise.normals(np.arange(400) * 31, np.arange(4000), 1)
    assert abs(z.mean()) < 0.005 and abs(z.std() - 1) < 0.005 and abs((z**4).mean() - 3) < 0.05
    assert abs(np.corrcoef(z[:30])[np.triu_indices(30, 1)]).max() < 0.09


def test_row_keys_have_64_bits(spark, duck):
    key = spark.createDataFrame([("a", 1)], "x string, y int").select(noise.row_key("x", "y")).first()[0]
    assert key & noise.FULL == duck.execute(f"""SELECT {noise.row_key_sql("'a|1'")}""").fetchone()[0]
    many = spark.range(300_000).select(noise.row_key("id").alias("k"))
    assert many.distinct().count() == 300_000 and many.where("k < 0").count() > 140_000


def test_rhat_goes_by_position_in_the_chain(spark):
    rng = np.random.default_rng(4)
    values = rng.normal(size=(2, 200)) + np.linspace(0, 2, 200)
    rows = [(c, i, "b", float(values[c, i])) for c in range(2) for i in range(200)]
    late = [(c, 2501 + 3 * i, t, v) for c, i, t, v in rows]
    schema = "chain int, iteration int, terms string, value double"
    a, b = (draws.split_rhat(spark.createDataFrame(x, schema)).first()["rhat"] for x in (rows, late))
    halves = values.reshape(4, 100)
    within, between = halves.var(1, ddof=1).mean(), halves.mean(1).var(ddof=1)
    assert a == b == pytest.approx(math.sqrt((0.99 * within + between) / within))
