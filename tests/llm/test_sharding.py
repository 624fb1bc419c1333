"""Lookup table and placement."""

import pytest

from understory.llm import sharding

SHARDS = [f"s{i}" for i in range(10)]


def claimed(shards, slots):
    """The table by writing out every permutation and letting shards claim in turns."""
    orders = []
    for s in shards:
        offset, step = sharding.preference(s, slots)
        orders.append(iter([(offset + j * step) % slots for j in range(slots)]))
    table = {}
    while len(table) < slots:
        for i, order in enumerate(orders):
            slot = next((x for x in order if x not in table), None)
            if slot is not None:
                table[slot] = i
    return [table[k] for k in range(slots)]


@pytest.mark.parametrize("slots", [11, 101, 1009])
def test_table(slots):
    table = sharding.fill(SHARDS, slots)
    assert table == claimed(SHARDS, slots)
    shares = [table.count(i) for i in range(10)]
    assert max(shares) - min(shares) <= 1


def test_few_keys_move_when_a_shard_goes(spark):
    keys = spark.range(20_000).selectExpr("id AS k")
    moves = {(r["old"], r["new"]): r["n_rows"] for r in sharding.moved(keys, "k", SHARDS, SHARDS[:-1], 1009).collect()}
    assert sum(moves.values()) == 20_000
    assert sum(n for (a, b), n in moves.items() if a != b and a != "s9") < 0.1 * 20_000


def test_edge_rows(spark):
    rows = [(1, None, "x"), (1, "b", "x"), (None, "c", None), (2, "d" * 1_000_000, "x"), (1, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string").selectExpr("*", "7 AS _slot", "8 AS slot")
    got = sharding.place(df, "doc_id", SHARDS, 101).collect()
    assert len(got) == 5 and set(got[0].asDict()) == {"doc_id", "text", "_slot", "slot", "shard"}
    assert len({(r["slot"], r["shard"]) for r in got if r["doc_id"] == 1}) == 1
    by_text = sharding.place(df, "text", SHARDS, 101, ("at", "on")).collect()
    assert len({r["on"] for r in by_text if r["text"] is None}) == 1
    assert sharding.place(df.limit(0), "doc_id", SHARDS, 101).collect() == []


def test_bad_parameters(spark):
    for shards, slots in ((SHARDS, 100), (SHARDS, 7), (["a", "a"], 101), ([], 101)):
        with pytest.raises(ValueError):
            sharding.fill(shards, slots)
