"""The pipeline against plain versions of its stages, and its edge cases."""

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from understory.llm import decontaminate
from test_jaccard import plain as classes
from test_line_dedup import plain as cut
from test_quality import plain as judged


def clean_lines(rows):
    """Stage one in plain Python: good documents without frequent lines."""
    good = {r[0] for r in judged(rows) if r[8]}
    lost = {r[0] for r in judged(rows) if r[7]}
    return good, lost


def test_run_equals_plain_stages(spark, folder, documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text", "source").collect()]
    good, lost = clean_lines(rows)
    first = corpus_pipeline.STAGES[0][1](spark, documents, folder)
    texts = {r["doc_id"]: r["text"] for r in first.collect()}
    assert set(texts) == good and all(texts[i] == t for i, t, _ in rows if i in good and i not in lost)
    second = [(i, t) for i, t, n, gone in cut(list(texts.items())) if gone == 0 or gone < n]
    third = {r[0] for r in classes(second) if r[0] == r[1]}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    matcher = decontaminate.Matcher(items, decontaminate.RATE)
    fourth = {i: t for i, t in second if i in third and not matcher.find(t)}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(got) == set(fourth) and len(fourth) < len(rows)
    for i, r in got.items():
        ids = library.encode(fourth[i], add_special_tokens=False).ids
        assert (r["ids"], r["n_tokens"], r["decoded"]) == (ids, len(ids), library.decode(ids, skip_special_tokens=False))


def test_stages_take_odd_tables(spark, folder, docs_of):
    body = " ".join(f"word{k}" for k in range(40))
    rows = [(1, body, "a"), (1, body, "a"), (2, None, None), (3, "", "a"), (None, body + " x", None), (5, " ".join(f"v{k}" for k in range(60_000)), "b")]
    extra = docs_of(rows).selectExpr("*", "'e' AS _row", "1 AS ids", "2 AS kept", "3 AS item_id", "4 AS class_id")
    for table in (extra, extra.limit(0), docs_of([])):
        docs = table
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, folder)
            if k < 4:
                assert docs.columns == table.columns
        assert docs.count() == (2 if table is extra else 0)
