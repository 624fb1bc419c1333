"""Line windows against plain Python, and their edge cases."""

import random

from understory.llm import line_dedup

BLANK = " \t\n\x0b\x0c\r"


def plain(rows):
    """Cut texts of (id, text) rows by the rule, in the order of ids, missing ones last, and lines."""
    first, windows = {}, []
    order = sorted((n for n, (_, t) in enumerate(rows) if t is not None), key=lambda n: (rows[n][0] is None, rows[n][0] or 0, n))
    for n in order:
        ls = rows[n][1].split("\n")
        solid = [k for k, x in enumerate(ls) if x.strip(BLANK)]
        for p in range(len(solid) - 2):
            key = tuple(ls[solid[p + j]].strip(BLANK) for j in range(3))
            if first.setdefault(key, (n, p)) != (n, p):
                windows.append((n, {solid[p + j] for j in range(3)}))
    out = []
    for n, (i, t) in enumerate(rows):
        if t is None:
            out.append((i, None, 0, 0))
            continue
        ls = t.split("\n")
        gone = set().union(*(w for j, w in windows if j == n))
        out.append((i, "\n".join(x for k, x in enumerate(ls) if k not in gone), sum(bool(x.strip(BLANK)) for x in ls), len(gone)))
    return out


def cut(df):
    return [tuple(r) for r in line_dedup.dedup(df).selectExpr("_row.doc_id", "clean", "n_lines", "n_removed").collect()]


def test_random_documents(docs_of):
    draw = random.Random(2)
    rows = []
    for i in range(60):
        ls = [draw.choice(["", " ", " a", "a ", "b", "c", "d", "e", f"own {i} {draw.random()}"]) for _ in range(draw.randint(0, 14))]
        rows.append((i * 3, "\n".join(ls), "s"))
    assert sorted(cut(docs_of(rows))) == sorted(plain([r[:2] for r in rows]))


def test_documents_as_plain_python(documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    assert sorted(cut(documents)) == sorted(plain(rows))


def test_edge_rows(spark, docs_of):
    passage = "one\ntwo\nthree\nfour"
    rows = [(1, f"start\n{passage}\nend", "a"), (2, f"{passage}", "b"), (2, f"{passage}", "b"), (3, None, None), (4, "", "c"), (5, "two\nthree", "c"), (None, f"x\n{passage}", "d"), (7, "long line\n" * 100_000 + passage, "e")]
    df = docs_of(rows).selectExpr("*", "'mine' AS _at", "'mine' AS clean", "0 AS n_lines")
    found = cut(df)
    got = {r[0]: r for r in found}
    assert sorted(found, key=str) == sorted(plain([r[:2] for r in rows]), key=str)
    assert got[None][1] == "x" and got[1][1] == f"start\n{passage}\nend" and got[2][1] == "" and got[3][1:] == (None, 0, 0)
    assert got[4][1:] == ("", 0, 0) and got[5][1] == "two\nthree" and got[7][1] == "long line" and got[7][3] == 100_003
    kept = line_dedup.keep_first(df)
    assert kept.columns == df.columns
    rows = {r["doc_id"]: r for r in kept.collect()}
    assert set(rows) == {None, 1, 3, 4, 5, 7} and rows[None]["n_chars"] == 1 and rows[1]["clean"] == "mine"


def test_of_repeated_rows_and_rows_without_id_one_keeps_the_lines(docs_of):
    passage = "one\ntwo\nthree"
    got = cut(docs_of([(1, passage, "a"), (1, passage, "a"), (2, passage, "a"), (None, passage, "a"), (None, passage + "\nx", "a")]))
    assert sorted(r[1:] for r in got if r[0] == 1) == [("", 3, 3), (passage, 3, 0)]
    assert sorted(r[1:] for r in got if r[0] != 1) == [("", 3, 3), ("", 3, 3), ("x", 4, 3)]


def test_a_table_read_twice_loses_its_copies(documents):
    once = {r["doc_id"] for r in line_dedup.keep_first(documents).select("doc_id").collect()}
    twice = line_dedup.keep_first(documents.unionByName(documents))
    long = twice.selectExpr("doc_id", f"size(filter(split(text, '\n'), x -> trim(x) <> '')) >= {line_dedup.WINDOW} AS long").where("long").collect()
    assert len(long) == len({r["doc_id"] for r in long}) and {r["doc_id"] for r in long} <= once


def test_a_window_that_overlaps_its_first_occurrence(docs_of):
    assert cut(docs_of([(1, "a\na\na\na\na", "s")])) == [(1, "a", 5, 4)]


def test_empty_table(docs_of):
    assert line_dedup.dedup(docs_of([])).collect() == [] and line_dedup.keep_first(docs_of([])).collect() == []
