"""Work that is dealt by what it makes: pairs of tips, selected plot rows."""

import itertools

from pyspark.sql import functions as F

from understory.operators import prepare, tree


def plain_pairs(edges):
    """(tip, tip): shared length, by walking up."""
    up = {c: (p, length) for p, c, length in edges}
    tips = [c for c in up if c not in {p for p, _, _ in edges}]

    def path(node):
        found = {}
        while node in up:
            found[node] = up[node][1]
            node = up[node][0]
        return found

    paths = {t: path(t) for t in tips}
    shared = {(a, b): sum(v for k, v in paths[a].items() if k in paths[b]) for a, b in itertools.product(tips, tips)}
    return {k: v for k, v in shared.items() if v > 0}


def test_pairs_of_a_bushy_and_a_combed_tree(spark, monkeypatch):
    """Blocks of three tips, branches of up to two share them: every kind of pair of blocks occurs."""
    monkeypatch.setattr(tree, "BLOCK_TIPS", 3)
    monkeypatch.setattr(tree, "SHARED_TIPS", 2)
    bushy = [("root", "a", 1.0), ("root", "b", 0.5), ("root", "", 0.25)] + [("a", f"a{i}", 1.0 + i) for i in range(8)] + [("b", "b0", 0.1), ("b", "b1", 0.2)]
    bushy += [("a", "ab", 0.3), *[("ab", f"ab{i}", 0.5 * i + 0.5) for i in range(7)], ("", "e0", 1.0), ("", "e1", 1.0)]
    combed = [x for i in range(12) for x in ((f"c{i}", f"c{i + 1}", 0.5), (f"c{i}", f"t{i}", 0.25))]
    for edges in (bushy, combed):
        found = tree.vcv(spark.createDataFrame(edges, "parent string, child string, length double")).collect()
        want = plain_pairs(edges)
        assert len(found) == len(want)
        assert all(abs(want[r["tip_i"], r["tip_j"]] - r["shared"]) < 1e-12 for r in found)


def test_pairs_of_one_fork_are_spread(spark):
    """Two branches below one fork are no two tasks."""
    edges = [("root", "f", 1.0), ("f", "x", 1.0), ("f", "y", 1.0), *[(b, f"{b}{i}", 1.0) for b in "xy" for i in range(3000)]]
    found = tree.vcv(spark.createDataFrame(edges, "parent string, child string, length double"))
    held = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(held) == 6000 * 6000
    assert max(held) < 6000 * 6000 / 3


def test_selected_rows_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = [("0", str(p), "alien" if s < 2 else "native", f"s{s}", float(s + p % 3), 100.0) for p in range(50) for s in range(4)]
    plots = spark.createDataFrame(rows, "Island string, PlotID string, Native_Status string, SPP_CODE3A string, Abundance_ha double, Plot_Area double")
    names = ["PlotIDn", "Long_Dec", "Lat_Dec", "newMAT", "newMAP", "newElev", "newVPD", "newPET", "newAridInd", "HFP", "HII", "SubstrateAge_range"]
    env = spark.createDataFrame([(str(p), *[float(p + k) for k in range(11)], "c") for p in range(50)], ", ".join(f"{n} {'string' if n == 'PlotIDn' else 'double'}" for n in names) + ", SubstrateAge_code string")
    found = prepare.alien_native_stepwise(plots.mapInArrow(count, plots.schema), env)
    before = made.value
    assert found.count() == 50
    assert made.value == before
