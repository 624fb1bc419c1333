"""Uniform numbers as a function of what they are for: a row, a draw, a purpose and a seed.

Rows and levels have keys of 64 bits and numbers of 53, by 64-bit mixing that numpy and
SQL compute alike. Draws of terms, whose keys are small numbers, use plain integer
arithmetic below 2^62, which Spark's functions compute too. Partitions, batches and the
order of rows change nothing.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, functions as F

# Two linear congruential steps with a shift after each.
STEPS = ((1103515245, 12345, 15), (22695477, 1, 13))
MASK = (1 << 31) - 1


def mix(h: np.ndarray) -> np.ndarray:
    """Scrambled 31-bit integers."""
    for factor, add, shift in STEPS:
        h = (h * factor + add) & MASK
        h = h ^ (h >> shift)
    return h


def mix_column(h: Column) -> Column:
    for factor, add, shift in STEPS:
        h = (h * F.lit(factor) + F.lit(add)).bitwiseAND(F.lit(MASK))
        h = h.bitwiseXOR(F.shiftright(h, shift))
    return h


def mix_sql(h: str) -> str:
    for factor, add, shift in STEPS:
        h = f"((({h}) * {factor} + {add}) & {MASK})"
        h = f"xor({h}, {h} >> {shift})"
    return h


# Two rounds of a 64-bit multiplication, each after a shift.
FACTORS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
FULL = (1 << 64) - 1
#: Purposes of the two numbers of a level's deviate.
LEVEL = 16


def mix64(h: np.ndarray) -> np.ndarray:
    """Scrambled 64-bit integers."""
    for factor in FACTORS:
        h = (h ^ (h >> np.uint64(32))) * np.uint64(factor)
    return h ^ (h >> np.uint64(32))


def mix64_sql(h: str) -> str:
    for factor in FACTORS:
        h = f"(((xor({h}, {h} >> 32))::UHUGEINT * {factor}::UHUGEINT) & {FULL}::UHUGEINT)::UBIGINT"
    return f"xor({h}, {h} >> 32)"


def salt64(purpose: int, seed: int) -> int:
    return int(mix64(np.array([(seed << 32) + purpose + 1], np.uint64))[0])


def row_key(*ids: str) -> Column:
    """64 bits of the identity of a row, as a signed number."""
    text = F.concat_ws("|", *[F.col(f"`{c}`").cast("string") for c in ids])
    return text_key(text)


def text_key(text: Column) -> Column:
    digest = F.md5(text.cast("binary"))
    half = [F.conv(F.substring(digest, start, 8), 16, 10).cast("long") for start in (1, 9)]
    return F.shiftleft(half[0], 32).bitwiseOR(half[1])


def row_key_sql(identity: str) -> str:
    return f"('0x' || substr(md5(({identity})::VARCHAR), 1, 16))::UBIGINT"


def salt(purpose: int, seed: int) -> int:
    """What is mixed in for one purpose; even and odd purposes are the two numbers of a normal deviate."""
    return (seed * 2654435 + purpose * 40503) & MASK


def uniforms(rows: np.ndarray, draws: np.ndarray, purpose: int, seed: int) -> np.ndarray:
    """Matrix of numbers strictly between 0 and 1 for every row key and draw."""
    left = mix64(np.asarray(rows).astype(np.int64).view(np.uint64) ^ np.uint64(salt64(purpose, seed)))
    right = mix64(np.asarray(draws).astype(np.int64).view(np.uint64))
    # ``mix64`` in place, as the matrix is large.
    h = left[:, None] ^ right[None, :]
    high = np.empty_like(h)
    for factor in FACTORS:
        np.right_shift(h, np.uint64(32), out=high)
        np.bitwise_xor(h, high, out=h)
        np.multiply(h, np.uint64(factor), out=h)
    np.right_shift(h, np.uint64(32), out=high)
    np.bitwise_xor(h, high, out=h)
    np.right_shift(h, np.uint64(11), out=h)
    u = high.view(np.float64)
    u[...] = h
    u += 0.5
    u *= 2.0**-53
    return u


#: Sine of a quarter turn at most, as a series in the square of the angle: exact to the last digits of a double.
SINE = tuple((-1.0) ** k / math.factorial(2 * k + 1) for k in range(10))


def cosine_of_turn(u: np.ndarray) -> np.ndarray:
    """cos(2 pi u) of numbers from 0 to 1, in place: sin of the angle that is left to a quarter turn."""
    u -= 0.5
    np.abs(u, out=u)
    u -= 0.25  # cos(2 pi u) = sin(2 pi (|u - 1/2| - 1/4))
    u *= 2.0 * math.pi
    square = u * u
    series = np.full_like(u, SINE[-1])
    for c in SINE[-2::-1]:
        series *= square
        series += c
    u *= series
    return u


#: Numbers of a matrix that are made at a time: few enough to stay in a core's cache, and so many that calls of numpy cost little beside them.
BLOCK_VALUES = 1 << 15


def normals(rows: np.ndarray, draws: np.ndarray, seed: int, purpose: int = 0) -> np.ndarray:
    """Matrix of standard normal deviates."""
    out = np.empty((len(rows), len(draws)))
    step = max(1, BLOCK_VALUES // max(1, len(draws)))
    for lo in range(0, len(rows), step):
        part = rows[lo : lo + step]
        radius = uniforms(part, draws, purpose, seed)
        np.log(radius, out=radius)
        radius *= -2.0
        np.sqrt(radius, out=radius)
        np.multiply(radius, cosine_of_turn(uniforms(part, draws, purpose + 1, seed)), out=out[lo : lo + step])
    return out


def salted_sql(key: str, purpose: int, seed: int) -> str:
    """A key's part of its numbers of one purpose; a draw's part is ``mix64_sql`` of its number."""
    return mix64_sql(f"xor({key}, {salt64(purpose, seed)}::UBIGINT)")


def deviate_sql(first: str, second: str, draw: str) -> str:
    """Normal deviate of a key's two parts and a draw's part."""
    u = [f"((({mix64_sql(f'xor({x}, {draw})')}) >> 11)::DOUBLE + 0.5) / {2.0**53!r}" for x in (first, second)]
    return f"(sqrt(-2.0 * ln({u[0]})) * cos({2.0 * math.pi!r} * {u[1]}))"


def uniform_column(row: Column, draw: Column, purpose: int, seed: int) -> Column:
    left = mix_column(row.cast("long").bitwiseXOR(F.lit(salt(purpose, seed)).cast("long")))
    return (mix_column(left.bitwiseXOR(mix_column(draw.cast("long")))) + F.lit(0.5)) / F.lit(MASK + 1.0)


def uniform_sql(row: str, draw: str, purpose: int, seed: int) -> str:
    left = mix_sql(f"xor({row}, {salt(purpose, seed)}::BIGINT)")
    return f"(({mix_sql(f'xor({left}, {mix_sql(draw)})')}) + 0.5) / {MASK + 1}.0"


def normal_column(row: Column, draw: Column, seed: int) -> Column:
    radius = F.sqrt(F.lit(-2.0) * F.ln(uniform_column(row, draw, 0, seed)))
    return radius * F.cos(F.lit(2.0 * math.pi) * uniform_column(row, draw, 1, seed))


def normal_sql(row: str, draw: str, seed: int) -> str:
    return f"sqrt(-2.0 * ln({uniform_sql(row, draw, 0, seed)})) * cos({2.0 * math.pi!r} * {uniform_sql(row, draw, 1, seed)})"
