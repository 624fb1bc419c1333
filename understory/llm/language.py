"""Language identification by prediction by partial matching.

For each language a context tree holds the bytes that followed each context of up to
``ORDER`` bytes in a sample of its texts. Escapes are weighted by the number of
distinct followers: a follower seen c times among t sightings of u kinds costs
log2((t + u) / c) bits, an escape to the next shorter context log2((t + u) / u), an
unseen context nothing, and a byte no context knows eight bits. Statistics are frozen
after fitting and nothing is excluded after an escape, so the cost of a byte depends
on the ``ORDER`` bytes before it alone, and arrays give it for a whole batch at once.
The language with the shortest code wins.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from understory.llm.common import small_side

#: Longest context, in bytes.
ORDER = 3
#: Labelled texts that a language is fitted on, in expectation.
SAMPLE_TEXTS = 1500
#: Bytes scored at a time.
PIECE = 1 << 20

_letters = re.compile(r"[^\W\d_]+")


def plain(text: str | None) -> bytes:
    """The words of a text in lower case, a blank before each; empty if it has no letter."""
    found = _letters.findall(text or "")
    if not all(map(str.isalpha, found)):  # numerals that are no digits
        found = [w for w in ("".join(filter(str.isalpha, w)) for w in found) if w]
    return (" " + " ".join(found)).lower().encode("utf-8", "replace") if found else b""


@dataclass
class Model:
    """Frozen statistics as arrays. Index 0 stands for an unseen context or gram everywhere."""

    languages: list[str]
    letter: np.ndarray  # byte to its number, 1 and up; bytes that weren't seen share the last
    size: int  # numbers in use, with 0
    step: list[np.ndarray]  # step[k][gram of k+1 bytes * size + letter]: the gram of k+2 bytes
    cost: list[np.ndarray]  # cost[k][gram of k+1 bytes]: bits in each language
    escape: list[np.ndarray]  # escape[k][context of k+1 bytes]: bits in each language

    def bits(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Bits of every byte in every language; ``starts`` are the positions where a text begins."""
        one = self.letter[data]
        grams, before = [one], []
        for k in range(len(self.cost)):
            shifted = np.empty_like(grams[k])
            shifted[1:] = grams[k][:-1]
            shifted[starts] = 0
            before.append(shifted)
            if k + 1 < len(self.cost):
                grams.append(self.step[k][shifted * self.size + one])
        top = len(self.cost) - 1
        out = self.cost[top][grams[top]]
        rest = np.flatnonzero(grams[top] == 0)
        for k in range(top - 1, -1, -1):
            out[rest] += self.escape[k][before[k][rest]]
            known = grams[k][rest] > 0
            out[rest[known]] += self.cost[k][grams[k][rest[known]]]
            rest = rest[~known]
        return out

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text in each language, in pieces of bounded size."""
        total = np.zeros((len(texts), len(self.languages)))
        group: list[int] = []
        filled = 0
        for i, t in enumerate(texts):
            if len(t) > PIECE:
                for a in range(0, len(t), PIECE):
                    back = min(a, ORDER)
                    part = np.frombuffer(t, np.uint8, min(len(t) - a, PIECE) + back, a - back)
                    total[i] += self.bits(part, np.zeros(1, int))[back:].sum(0, dtype=float)
            elif t:
                if filled + len(t) > PIECE:
                    self._sum(texts, group, total)
                    group, filled = [], 0
                group.append(i)
                filled += len(t)
        self._sum(texts, group, total)
        return total

    def _sum(self, texts: list[bytes], group: list[int], total: np.ndarray) -> None:
        if group:
            ends = np.cumsum([len(texts[i]) for i in group])
            starts = np.concatenate([[0], ends[:-1]])
            found = self.bits(np.frombuffer(b"".join([texts[i] for i in group]), np.uint8), starts)
            total[group] = np.add.reduceat(found, starts, axis=0, dtype=float)


def count_grams(texts: DataFrame, language: str = "lang", text: str = "text") -> DataFrame:
    """``lang``, ``gram`` (bytes as a number), ``length``, ``n`` over all rows, summed before they are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), object)
            packed = [plain(t.as_py()) for t in batch.column(1)]
            for name in sorted(set(names)):
                own = [p for p, n in zip(packed, names) if n == name and p]
                if not own:
                    continue
                ends = np.cumsum([len(p) for p in own])
                left = np.arange(ends[-1]) - np.repeat(np.concatenate([[0], ends[:-1]]), [len(p) for p in own])
                data = np.frombuffer(b"".join(own), np.uint8).astype(np.int64)
                code = np.zeros_like(data)
                for k in range(ORDER + 1):
                    code[k:] = code[k:] | (data[: len(data) - k] << (8 * k))
                    grams, n = np.unique(code[left >= k], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(grams), pa.string()), pa.array(grams), pa.array(np.full(len(grams), k + 1, np.int32)), pa.array(n.astype(np.int64))],
                        ["lang", "gram", "length", "n"],
                    )

    rows = texts.select(F.col(f"`{language}`").cast("string"), F.col(f"`{text}`"))
    return rows.mapInArrow(count, "lang string, gram long, length int, n long").groupBy("lang", "gram", "length").agg(F.sum("n").alias("n"))


def sample(rows: DataFrame, per_language: int, language: str = "lang", text: str = "text") -> DataFrame:
    """About ``per_language`` labelled texts of each language by the hash of the text, copies once."""
    labelled = rows.select(F.col(f"`{language}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text")).where("lang is not null and text is not null")
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n"))
    wide = 1 << 30
    lot = F.pmod(F.xxhash64("text", F.lit(9)), F.lit(wide))
    drawn = labelled.join(small_side(counts), "lang").where(lot < F.lit(float(per_language * wide)) / F.col("n"))
    return drawn.select("lang", "text").dropDuplicates()


def fit(rows: DataFrame, language: str = "lang", text: str = "text", per_language: int = SAMPLE_TEXTS) -> Model:
    """Learns from the labelled texts of ``rows``; rows without a language or text are passed over.

    All grams of the sample reach the driver, as rows of four numbers: the texts a
    language and ``ORDER`` bound them, not the rows of the corpus.
    """
    found = count_grams(sample(rows, per_language, language, text)).toArrow()
    names = pc.dictionary_encode(found.column("lang")).combine_chunks()
    known = np.array(names.dictionary.to_pylist(), object)
    columns = (found.column(c).to_numpy() for c in ("gram", "length", "n"))
    return build(known[names.indices.to_numpy()], *columns)


def build(names: np.ndarray, grams: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> Model:
    """The model of counted grams."""
    languages = sorted(set(names))
    number = {name: i for i, name in enumerate(languages)}
    which = np.array([number[name] for name in names], np.int64)
    width = max(len(languages), 1)
    seen = np.unique(grams[lengths == 1])
    letter = np.full(256, len(seen) + 1, np.int64)
    letter[seen] = np.arange(1, len(seen) + 1)
    size = len(seen) + 2
    # Counts and, for each gram, its row; the row of its context is that of the gram one byte shorter.
    keys, tables = [np.zeros(1, np.int64)], [np.zeros((1, width))]
    cost, escape, step = [], [], []
    for k in range(ORDER + 1):
        at = lengths == k + 1
        context = np.searchsorted(keys[k], grams[at] >> 8)
        context = np.minimum(context, len(keys[k]) - 1)
        whole = (keys[k][context] == grams[at] >> 8) & ((k == 0) | (context > 0))
        own, name, n = grams[at][whole], which[at][whole], counts[at][whole]
        unique = np.unique(own)
        # Row 0 stays for the unseen; no gram of any length is negative.
        rows = np.concatenate([[-1], unique])
        table = np.zeros((len(rows), width))
        np.add.at(table, (np.searchsorted(unique, own) + 1, name), n)
        parent = np.searchsorted(keys[k], rows >> 8) if k else np.zeros(len(rows), np.int64)
        parent[0] = 0
        total, kinds = np.zeros((len(keys[k]), width)), np.zeros((len(keys[k]), width))
        np.add.at(total, parent[1:], table[1:])
        np.add.at(kinds, parent[1:], table[1:] > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            out = np.where(kinds > 0, np.log2((total + kinds) / kinds), 0.0)
            bits = np.log2((total + kinds)[parent] / table)
        if k == 0:
            shorter = np.full((len(rows), width), 8.0)
        else:
            mask = (1 << (8 * k)) - 1
            tail = np.searchsorted(keys[k], rows & mask)
            tail = np.minimum(tail, len(keys[k]) - 1)
            shorter = np.where((keys[k][tail] == rows & mask)[:, None], cost[k - 1][tail], 0.0)
        full = np.where(table > 0, bits, out[parent] + shorter)
        if k == 0:
            # Letters by their number; the last is that of all bytes that weren't seen.
            full = np.concatenate([full, out[:1] + 8.0])
        full[0] = 0.0
        cost.append(full)
        if k:
            escape.append(out)
            move = np.zeros(len(cost[k - 1]) * size, np.int32)
            move[parent[1:] * size + letter[unique & 255]] = np.arange(1, len(rows))
            step.append(move)
        keys.append(rows)
    for k, e in enumerate(escape):
        e[0] = 0.0
        if k == 0:
            escape[0] = np.concatenate([e, np.zeros((1, width))])
    return Model(languages, letter, size, step, [c.astype(np.float32) for c in cost], [e.astype(np.float32) for e in escape])


_models: dict[str, Model] = {}


def predictor(rows: DataFrame, model: Model):
    """Function of a text column that gives ``lang`` and ``score``."""
    key, content = uuid.uuid4().hex, rows.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(T.StructType().add("lang", T.StringType()).add("score", T.DoubleType()))
    def predict(texts: pa.Array) -> pa.Array:
        if key not in _models:
            _models.clear()
            _models[key] = content.value
        model = _models[key]
        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        if model.languages:
            packed = [plain(t.as_py()) for t in texts]
            bits = model.code_lengths(packed)
            best = bits.argmin(1)
            share = 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
            for i, p in enumerate(packed):
                if p:
                    names[i], scores[i] = model.languages[best[i]], share[i]
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    return predict


def identify(rows: DataFrame, model: Model, text: str = "text", out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``rows`` with the predicted language of the whole text and its share of the probability of all languages.

    A text that is null, empty or without a letter is ``und`` with score 0, as is every
    text if nothing was learned. Of equal code lengths the first language by name wins.
    Repeated rows get equal results; an empty table stays empty. Columns named as the
    outputs are replaced, other columns stay as they are and aren't looked at.
    """
    if text in out or out[0] == out[1]:
        raise ValueError("the outputs need two names other than the text's")
    row: Column = F.struct(*[F.col(f"`{c}`") for c in rows.columns if c not in out])
    found = rows.select(row.alias("_row"), predictor(rows, model)(F.col(f"`{text}`")).alias("_said"))
    return found.select("_row.*", F.col("_said.lang").alias(out[0]), F.col("_said.score").alias(out[1]))
