"""Quality rules against plain Python, and their edge cases."""

import re
from collections import Counter, defaultdict

from understory.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, limits=quality.Limits()):
    """Measures and verdicts of (id, text, host) rows."""
    documents, seen = defaultdict(set), defaultdict(set)
    norm = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", x).strip(" ").lower()
    for _, t, h in rows:
        own = {n for n in map(norm, (t or "").split("\n")) if n}
        if own:
            main = max(own, key=lambda n: (len(n), n.encode()))
            documents[h].add(main)
            for n in own:
                seen[h, n].add((main, t))
    effective = lambda found: sum(found.values()) ** 2 / sum(c * c for c in found.values())
    numbers = {k: effective(Counter(main for main, _ in v)) for k, v in seen.items()}
    counts = {k: n for k, n in numbers.items() if n >= limits.line_texts and (n > limits.line_share * len(documents[k[0]]) or n >= limits.line_many)}
    out = []
    for i, t, h in rows:
        body = t or ""
        ws, ls = WORD.findall(body), [x for x in body.split("\n") if WORD.search(x)]
        grams = [tuple(ws[k : k + 8]) for k in range(len(ws) - 7)]
        often = Counter(grams)
        covered = {k + j for k, g in enumerate(grams) if often[g] > 1 for j in range(8)}
        lost = sum(len(norm(x).split(" ")) for x in body.split("\n") if (h, norm(x)) in counts)
        failed = len(ws) < 20 or 100 * len(covered) > 30 * len(ws)
        out.append((i, len(ws), sum(map(len, ws)), sum(body.count(c) for c in "#*$%&|<>"), len(ls) - len(set(ls)), len(covered), failed, lost, not failed and lost <= limits.max_lost * len(ws)))
    return out


def spark_rows(df, limits=quality.Limits()):
    found = quality.assess(df, limits).selectExpr("_row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lost", "kept")
    return [tuple(r) for r in found.collect()]


def many():
    rows = []
    for i in range(40):
        own = " ".join(f"w{i}x{k}" for k in range(25))
        rows.append((i, f"Shared  LINE of all\n{own}\n\nshared line of all", "a"))
    rows += [(100 + k, "Copy of one text that many have " + " ".join(f"c{j}" for j in range(20)), "b") for k in range(30)]
    rows += [(200, "Shared line of all\nshared line of all\none word", "a"), (201, "Shared line of all\n" * 6 + " ".join(f"z{k}" for k in range(9)), "a")]
    rows += [(300, None, "a"), (301, "", None), (302, " \t\x0b\n\n", None), (None, "# $ x%y <b>|*&", "c"), (303, None, None)]
    rows += [(400, "one two three four five six seven eight " * 3, "d"), (401, " ".join(f"u{k}" for k in range(200)) + " u0 u1 u2 u3 u4 u5 u6 u7", "d"), (400, "one two three four five six seven eight " * 3, "d")]
    rows += [(500, "é\xa0ü x " * 30 + "\x1c", "e"), (501, "long " + " ".join(f"t{k % 9000}" for k in range(40_000)), "e")]
    return rows


def test_measures_and_verdicts(docs_of):
    rows = many()
    assert sorted(spark_rows(docs_of(rows)), key=str) == sorted(plain(rows), key=str)


def test_documents_as_plain_python(documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text", "source").collect()]
    assert sorted(spark_rows(documents)) == sorted(plain(rows))


def test_only_good_documents_stay_without_shared_lines(spark, docs_of):
    df = docs_of(many()).selectExpr("*", "'own' AS kept", "1 AS _host", "2 AS clean")
    got = quality.keep_good(df)
    assert got.columns == df.columns
    rows = {r["doc_id"]: r for r in got.collect()}
    assert 0 in rows and rows[0]["text"] == " ".join(f"w0x{k}" for k in range(25)) + "\n"
    assert rows[0]["n_chars"] == len(rows[0]["text"]) and rows[0]["kept"] == "own"
    assert {100 + k for k in range(30)} <= set(rows), "copies of a text don't make its lines frequent"
    assert not {200, 201, 300, 301, 302, 303, 400} & set(rows)


def test_the_limit_does_not_loosen_with_the_host_and_near_copies_count_once(docs_of):
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(25))
    line = "only a line of boilerplate with some more words in it"
    rows = [(i, f"{line}\n{own(i)}", "a") for i in range(20)]
    rows += [(100 + i, own(100 + i), "a") for i in range(300)]
    # Near copies share their longest line and differ in another, or in a third of them in the longest.
    rows += [(1000 + i, f"changed {i}\nkept by all\n{own(5000) if i % 3 else own(6000 + i)}", "a") for i in range(90)]
    rows += [(2000, line + "\n" + " ".join(f"v{k}" for k in range(9)), "a")]
    got = {r[0]: r for r in spark_rows(docs_of(rows))}
    assert sorted(got.values()) == sorted(plain(rows))
    assert got[0][7] == 11 and got[0][8], "twenty documents are under the share but enough"
    assert got[1000][7] == 0 and got[1000][8]
    assert not got[2000][6] and not got[2000][8], "depleted"


def test_empty_table(docs_of):
    assert quality.assess(docs_of([])).collect() == [] and quality.keep_good(docs_of([])).collect() == []
