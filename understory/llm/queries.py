"""Registered queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from understory.llm import alignment, bpe, decontaminate, html_text, jaccard, language, line_dedup, packing, quality, resampling, sharding, token_counts, warc
from understory.session import pin

SHARDS = [f"shard-{i:02d}" for i in range(64)]
SLOTS = 16381


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every whole text with the word-end vocabulary."""
    coded = bpe.tokenize(_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return coded.select(
        "doc_id", bpe.n_tokens(F.col("ids")).alias("n_tokens"), F.sha2("packed", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op2_wrapper_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = html_text.main_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_edit_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document holds within the edit budget, with its place."""
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages to seekable bundles and states what the records read back say."""
    records = warc.read_archive(warc.archive_pages(_table(spark, sf_dir, "pages")))
    number = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1).try_cast("long")
    # Kept, so that the archives are read once.
    said = pin(records.select("record_id", "record_type", "payload_digest", "refers_to", F.octet_length("payload").cast("long").alias("n")))
    responses = said.where("record_type = 'response'")
    whole = responses.groupBy(F.col("record_id").alias("refers_to"), "payload_digest").agg(F.max("n").alias("payload_bytes"))
    whole = whole.hint("merge")  # as many as there are pages: never broadcast
    own = responses.select("record_id", "record_type", "payload_digest", "refers_to", F.col("n").alias("payload_bytes"))
    other = said.where("record_type = 'revisit'").join(whole, ["refers_to", "payload_digest"])
    both = own.unionByName(other.select(own.columns))
    return both.select(
        number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        number(F.col("refers_to")).alias("refers_to"),
    )


def op5_line_frequency_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.assess(_table(spark, sf_dir, "documents"))
    return found.select(
        F.col("_row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "n_lost",
    )


def op6_edited_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every whole text before and after three edits that its own row decides:
    a line that names the source comes first, two dozen letters in the middle are masked,
    and the last sentence's end goes."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    path = public_tokenizers.path("byte_bpe_50k.json")
    size, source = F.coalesce(F.length("_row.text"), F.lit(0)).cast("long"), F.coalesce(F.col("_row.source"), F.lit(""))
    step = lambda at, n, new: F.struct(at.cast("long").alias("start"), F.lit(n).cast("long").alias("delete"), new.alias("insert"))
    edits = F.array(
        step(F.lit(0), 0, F.concat(F.lit("source: "), source, F.lit("\n"))),
        step(F.floor(size / 2), 24, F.lit("[masked]")),
        step(size - 10, 12, F.lit("")),
    )
    done = token_counts.follow(token_counts.plant(docs, path), path, edits)
    return done.select(
        F.col("_row.doc_id").alias("doc_id"), token_counts.total(F.col("tree")).alias("n_tokens"),
        token_counts.total(F.col("new_tree")).alias("n_tokens_edited"), F.length("new_text").cast("long").alias("n_chars_edited"), "n_encoded",
    )


def op7_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup(_table(spark, sf_dir, "documents"))
    return found.select(F.col("_row.doc_id").alias("doc_id"), "n_lines", "n_removed", F.col("clean").alias("text"))


def op8_lookup_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id")
    return sharding.place(docs, "doc_id", SHARDS, SLOTS)


def op9_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all texts by trees fitted on the documents that aren't held out."""
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = language.fit(docs.where(~held_out).select("lang", "text"))
    texts = docs.select("doc_id", held_out.alias("held_out"), "text")
    return language.identify(texts, model).select("doc_id", "held_out", "lang_pred", "score")


def op10_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document on five-word shingles at 0.8."""
    return jaccard.join(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of 1024 tokens."""
    pieces = packing.pack(_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents, drawn by their likeness to the benchmark."""
    return resampling.resample(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))


def op13_shared_cut_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned tokens of the byte-level and the piece vocabulary for every document, with corpus-wide counts of id pairs."""
    b = public_tokenizers.path("piece_bpe_32k.model")
    found = alignment.align(_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), b)
    digest = F.when(F.col("n_groups") == 0, "").otherwise(F.sha2(F.col("groups").cast("binary"), 256)).alias("groups_sha256")
    kept = found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "pairs", "times")
    return alignment.weigh(kept, alignment.size_of(b)).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


OP4_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS b, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT b, min(page_id) AS first FROM p GROUP BY b),
x AS (SELECT p.*, f.first, [strpos('0123456789ABCDEF', c) - 1 FOR c IN string_split(upper(h), '')] AS d FROM p JOIN f USING (b))
SELECT page_id, octet_length(encode(b))::BIGINT AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + (((d[(5 * i) // 4 + 1] * 16 + coalesce(d[(5 * i) // 4 + 2], 0)) >> (3 - (5 * i) % 4)::INTEGER) & 31)::INTEGER, 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM x
"""

OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce('=' || source, '') AS host, coalesce(text, '') AS t, text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d WHERE len(ws) >= 8)),
dup AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM dup, (SELECT unnest(range(0, 8)) AS k) GROUP BY doc_id),
ln AS (
  SELECT doc_id, host, text, l, lower(trim(regexp_replace(l, '[\x20\x09-\x0D]+', ' ', 'g'))) AS norm
  FROM (SELECT doc_id, host, text, unnest(string_split(t, chr(10))) AS l FROM d)),
own AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM ln WHERE norm <> '' GROUP BY doc_id),
main AS (SELECT doc_id, arg_max(norm, struct_pack(a := length(norm), b := norm)) AS main FROM ln WHERE norm <> '' GROUP BY doc_id),
hosts AS (SELECT host, count(DISTINCT main) AS texts FROM d JOIN main USING (doc_id) GROUP BY host),
often AS (
  SELECT host, norm FROM (
    SELECT host, norm, sum(c) * sum(c) / sum(c * c) AS n FROM (
      SELECT host, norm, main, count(DISTINCT text)::DOUBLE AS c FROM ln JOIN main USING (doc_id) WHERE norm <> '' GROUP BY host, norm, main)
    GROUP BY host, norm) JOIN hosts USING (host)
  WHERE n >= 10 AND (n > texts * 0.10 OR n >= 20)),
lost AS (SELECT doc_id, sum(length(norm) - length(replace(norm, ' ', '')) + 1)::BIGINT AS n FROM ln JOIN often USING (host, norm) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, coalesce(own.n, 0)::BIGINT AS n_dup_lines,
    coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(lost.n, 0) AS n_lost
  FROM d LEFT JOIN own USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_lost <= n_words * 0.5 AS kept, n_lost
FROM m
"""

OP7_SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id NULLS LAST, text) AS rid, doc_id, text FROM documents),
raw AS (
  SELECT rid, i, ls[i] AS l, trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS b
  FROM (SELECT rid, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT rid, string_split(text, chr(10)) AS ls FROM d))),
ln AS (SELECT rid, i, b, row_number() OVER (PARTITION BY rid ORDER BY i) AS p FROM raw WHERE b <> ''),
win AS (
  SELECT rid, p, b, lead(b) OVER w AS b2, lead(b, 2) OVER w AS b3 FROM ln WINDOW w AS (PARTITION BY rid ORDER BY p)),
later AS (
  SELECT rid, p FROM (
    SELECT rid, p, row_number() OVER (PARTITION BY b, b2, b3 ORDER BY rid, p) AS nth FROM win WHERE b3 IS NOT NULL) WHERE nth > 1),
gone AS (SELECT DISTINCT rid, p + k AS p FROM later, (SELECT unnest(range(0, 3)) AS k)),
marked AS (SELECT ln.rid, ln.i, gone.p IS NOT NULL AS cut FROM ln LEFT JOIN gone ON gone.rid = ln.rid AND gone.p = ln.p)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_lines, coalesce(cut, 0)::BIGINT AS n_removed,
  CASE WHEN d.text IS NOT NULL THEN coalesce(k.t, '') END AS text
FROM d
LEFT JOIN (SELECT rid, count(*) AS n, sum(cut::INT) AS cut FROM marked GROUP BY rid) c USING (rid)
LEFT JOIN (
  SELECT raw.rid, string_agg(raw.l, chr(10) ORDER BY raw.i) AS t FROM raw LEFT JOIN marked USING (rid, i)
  WHERE NOT coalesce(marked.cut, false) GROUP BY raw.rid) k USING (rid)
"""

#: The CRC goes over a string's bytes, bit by bit through a table of 256 words that the first part makes.
OP12_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT i AS b, i::BIGINT AS c, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws, 0 AS aim
  FROM documents
  UNION ALL
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), 1
  FROM benchmark),
features AS (
  SELECT aim, doc_id, unnest(ws) AS f FROM words
  UNION ALL
  SELECT aim, doc_id, ws[i] || ' ' || ws[i + 1] FROM (SELECT aim, doc_id, ws, unnest(range(1, len(ws))) AS i FROM words)),
distinct_features AS (
  SELECT f, hex(encode(f)) AS h, (octet_length(encode(f)))::BIGINT AS n FROM (SELECT DISTINCT f FROM features)),
hashes AS (
  SELECT f, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(n), lambda i: ('0x' || substr(h, (2 * i + 1)::BIGINT, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % 10000 AS bucket
  FROM distinct_features, crc),
placed AS (SELECT aim, doc_id, bucket FROM features JOIN hashes USING (f)),
sums AS (SELECT bucket, count(*) FILTER (aim = 0) AS s, count(*) FILTER (aim = 1) AS t FROM placed GROUP BY bucket),
totals AS (SELECT sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t FROM sums),
gains AS (
  SELECT bucket, floor(1000 * ln(((sums.t + 1)::DOUBLE * (totals.s + 10000)) / ((sums.s + 1)::DOUBLE * (totals.t + 10000))))::BIGINT AS gain
  FROM sums, totals),
weights AS (SELECT doc_id, count(*) AS n, sum(gain) AS g FROM placed JOIN gains USING (bucket) WHERE aim = 0 GROUP BY doc_id),
scored AS (
  SELECT words.doc_id, coalesce(n, 0)::BIGINT AS n_features, len(ws) AS n_words,
    CASE WHEN n IS NULL THEN 0 ELSE (g - ((g % n) + n) % n) // n END::BIGINT AS weight,
    floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || words.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS noise
  FROM words LEFT JOIN weights USING (doc_id) WHERE aim = 0),
able AS (
  SELECT doc_id, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT scored.doc_id, n_features, weight, weight + noise AS score, r AS rank
FROM scored LEFT JOIN able ON able.doc_id = scored.doc_id AND r <= 25 * n // 100
"""


def op8_sql() -> str:
    """The filled table as a list; the key's slot and its lookup are SQL's own."""
    table = ", ".join(str(i) for i in sharding.fill(SHARDS, SLOTS))
    return f"""
    WITH t AS (SELECT [{table}] AS owner),
    s AS (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {SLOTS} AS slot FROM documents)
    SELECT doc_id, slot, printf('shard-%02d', owner[slot + 1]) AS shard FROM s, t
    """


def queries() -> dict:
    registered = [op1_bpe_round_trip, op2_wrapper_text, op3_edit_decontamination, op4_warc_bundles, op5_line_frequency_rules, op6_edited_token_counts, op7_line_windows, op8_lookup_sharding, op9_ppm_language, op10_chosen_path_join, op11_cost_balanced_packing, op12_importance_resampling, op13_shared_cut_alignment]
    return {f.__name__: f for f in registered}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_warc_bundles": OP4_SQL,
        "op5_line_frequency_rules": OP5_SQL,
        "op7_line_windows": OP7_SQL,
        "op8_lookup_sharding": op8_sql(),
        "op12_importance_resampling": OP12_SQL,
    }
