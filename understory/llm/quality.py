"""Quality rules: rules on one document, and lines that too many documents of a host share.

Lines are normalised (lower case, outer blanks off, inner blanks to one space) and
hashed. A line's frequency at a host is the number of distinct documents with it. Documents
with one text count once, and near copies, which mostly share their longest line, don't make
each other's lines frequent: the number is the effective one, (sum c)^2 / sum c^2 over the c
texts of each longest line. Lines above the limits are removed; a document that loses more than the allowed share of its words is rejected.
Built-in functions only. Texts stay where they are as long as the documents with frequent
lines, a few numbers each, measure under the broadcast limit; beyond it they are shuffled once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from understory.llm.common import aside, let, once, small_side
from understory.session import pin

#: Blanks that separate words: space and the controls 9 to 13.
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Limits:
    """Production limits. A line is above them if at least ``line_texts`` distinct documents of a
    host have it, and these are more than ``line_share`` of the host's or at least ``line_many``.
    The last doesn't grow with the host: so many different documents don't share a line by chance."""

    min_words: int = 20
    window: int = 8
    repeat_percent: int = 30
    line_share: float = 0.10
    line_texts: int = 10
    line_many: int = 20
    max_lost: float = 0.5


def words(text: Column) -> Column:
    """Maximal runs without a blank. Null text has none."""
    spaced = F.translate(F.coalesce(text, F.lit("")), BLANKS, " " * len(BLANKS))
    return F.filter(F.split(spaced, " ", -1), lambda w: w != "")


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def normal_line(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, "[\\x20\\x09-\\x0D]+", " ")))


def repeated_words(tokens: Column, window: int) -> Column:
    """Words covered by windows that occur twice or more in ``tokens``, the first occurrence included."""

    def covered(hashes: Column) -> Column:
        def spread(pairs: Column) -> Column:
            same = lambda x, i, k: (i + k >= 0) & (i + k < F.size(pairs)) & (F.get(pairs, i + k)["h"] == x["h"])
            twice = F.filter(pairs, lambda x, i: F.coalesce(same(x, i, -1), F.lit(False)) | F.coalesce(same(x, i, 1), F.lit(False)))
            at = F.array_sort(F.transform(twice, lambda x: x["p"]))
            return let(
                at,
                lambda ps: F.aggregate(
                    F.transform(ps, lambda p, i: F.least(F.lit(window), F.coalesce(F.get(ps, i + 1) - p, F.lit(window)))),
                    F.lit(0), lambda a, x: a + x,
                ),
            )

        # Most texts repeat no window, which the hash-based distinct count tells without sorting.
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(pairs, spread))

    def windows(hs: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(hs) - (window - 1))
        return F.transform(starts, lambda i: F.xxhash64(F.slice(hs, i, window)))

    many = lambda hs: F.when(F.size(hs) < window + 1, 0).otherwise(let(windows(hs), covered))
    return let(F.transform(tokens, lambda w: F.xxhash64(w)), many).cast("long")


def base_rules(text: Column, limits: Limits) -> Column:
    """Struct of the measures on one text alone and ``base_failed``."""
    body = F.coalesce(text, F.lit(""))

    def measured(ws: Column) -> Column:
        with_word = lambda ls: F.filter(ls, lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
        repeated = repeated_words(ws, limits.window)
        return F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.length(F.translate(body, BLANKS, "")).cast("long").alias("word_chars"),
            (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            let(with_word(lines(text)), lambda ls: F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
            repeated.alias("n_repeat_words"),
        )

    return let(words(text), measured)


def _line_words(line: Column) -> Column:
    """Words of a normalised line."""
    return F.when(line == "", 0).otherwise(F.length(line) - F.length(F.translate(line, " ", "")) + 1)


def _text_key(text: Column) -> list[Column]:
    """128 bits of a text."""
    return [F.xxhash64(text).alias("_t1"), F.xxhash64(F.lit(1), text).alias("_t2")]


def _line_key(line: Column) -> Column:
    return F.xxhash64(line)


def line_rows(docs: DataFrame) -> DataFrame:
    """``_host``, ``_t1``, ``_t2``, ``_main``, ``_line``: one row of numbers per distinct line of a text at a host.

    ``docs`` has ``_host``, ``_text``. ``_main`` stands for the document: its longest
    line, of several the last in the order of bytes.
    """
    norms = F.filter(F.transform(lines(F.col("_text")), normal_line), lambda x: x != "")

    def keys(ls: Column) -> Column:
        longest = F.array_max(F.transform(ls, lambda x: F.struct(F.length(x).alias("n"), x.alias("line"))))["line"]
        return F.struct(_line_key(longest).alias("main"), F.array_distinct(F.transform(ls, _line_key)).alias("hashes"))

    found = docs.where("_text is not null").select("_host", *_text_key(F.col("_text")), let(norms, keys).alias("_keys"))
    return found.select("_host", "_t1", "_t2", F.col("_keys.main").alias("_main"), F.explode("_keys.hashes").alias("_line"))


def frequent_lines(rows: DataFrame, limits: Limits) -> DataFrame:
    """``_host``, ``_line`` above the limits. A line's texts are spread over tasks by text, so no line is too frequent."""
    texts = rows.groupBy("_host", "_line", "_main", "_t1", "_t2").agg(F.lit(1).alias("one")).groupBy("_host", "_line", "_main").agg(F.count("*").cast("double").alias("c"))
    counted = texts.groupBy("_host", "_line").agg((F.sum("c") * F.sum("c") / F.sum(F.col("c") * F.col("c"))).alias("n"))
    hosts = rows.groupBy("_host", "_main").agg(F.lit(1).alias("one")).groupBy("_host").agg(F.count("*").alias("all"))
    above = counted.where(F.col("n") >= limits.line_texts).join(hosts, "_host")
    return above.where((F.col("n") > F.col("all") * F.lit(limits.line_share)) | (F.col("n") >= limits.line_many)).select("_host", "_line")


def frequent_by_text(docs: DataFrame, limits: Limits) -> DataFrame:
    """``_host``, ``_t1``, ``_t2``, ``_often``: the lines of each text that are above the limits at its host."""
    rows = pin(line_rows(docs))
    hits = rows.join(small_side(frequent_lines(rows, limits)), ["_host", "_line"])
    return hits.groupBy("_host", "_t1", "_t2").agg(F.collect_set("_line").alias("_often"))


def assess(docs: DataFrame, limits: Limits = Limits(), text: str = "text", host: str = "source") -> DataFrame:
    """``_row`` (the row as it came), the base measures, ``base_failed``, ``n_lost`` (words of
    removed lines), ``clean`` (the text without them) and ``kept``.

    A null text has no words and fails the base rules; its clean text is null. Null
    hosts are one host of their own. Repeated rows get equal verdicts and count as one
    document. Empty tables give no rows. Extra columns stay inside ``_row``.
    """
    body, at = F.col(f"`{text}`"), F.coalesce(F.concat(F.lit("="), F.col(f"`{host}`").cast("string")), F.lit(""))
    kept = aside(docs, _text=body, _host=at)
    often = small_side(frequent_by_text(docs.select(at.alias("_host"), body.alias("_text")), limits))
    joined = kept.select("*", *_text_key(F.col("_text"))).join(often, ["_host", "_t1", "_t2"], "left")
    marked = F.transform(lines(F.col("_text")), lambda x: F.struct(x.alias("raw"), normal_line(x).alias("norm")))
    hit = lambda x: F.coalesce(F.array_contains(F.col("_often"), _line_key(x["norm"])), F.lit(False)) & (x["norm"] != "")
    stays = let(
        marked,
        lambda ls: F.struct(
            F.aggregate(F.filter(ls, hit), F.lit(0).cast("long"), lambda a, x: a + _line_words(x["norm"])).alias("lost"),
            F.array_join(F.transform(F.filter(ls, lambda x: ~hit(x)), lambda x: x["raw"]), "\n").alias("clean"),
        ),
    )
    plain = F.struct(F.lit(0).cast("long").alias("lost"), F.col("_text").alias("clean"))
    cross = F.when(F.col("_often").isNull() | F.col("_text").isNull(), plain).otherwise(stays)
    found = once(joined, ["_row"], _base=base_rules(F.col("_text"), limits), _cross=cross)
    base, lost = F.col("_base"), F.col("_cross.lost")
    failed = (base["n_words"] < limits.min_words) | (100 * base["n_repeat_words"] > limits.repeat_percent * base["n_words"])
    return found.select(
        "_row", "_base.*", failed.alias("base_failed"), lost.alias("n_lost"), F.col("_cross.clean").alias("clean"),
        (~failed & (lost <= base["n_words"] * F.lit(limits.max_lost))).alias("kept"),
    )


def keep_good(docs: DataFrame, limits: Limits = Limits(), text: str = "text", host: str = "source", length: str = "n_chars") -> DataFrame:
    """The documents that stay, without the lines above the limits, in the columns of ``docs``.

    ``length`` is set to the code points of the clean text if ``docs`` has that column.
    """
    good = assess(docs, limits, text, host).where("kept")
    new = {text: F.col("clean"), length: F.length("clean").cast("long")}
    return good.select(*[new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
