"""Error rates of a text against a reference."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trimmed


def millionths(value: Column) -> Column:
    """value in whole millionths: their sum is the same in any order."""
    return F.round(value * 1_000_000).cast("long")


def mean_to_thousandths(total: Column, n: Column) -> Column:
    """total millionths / n, rounded once to 3 decimals, ties to even; null where n is 0. All in whole numbers."""
    unit = n * 1000
    rest = F.pmod(total, unit)
    whole = ((total - rest) / unit).cast("long")
    up = (2 * rest > unit) | ((2 * rest == unit) & (F.pmod(whole, F.lit(2)) == 1))
    return F.when(n > 0, (whole + F.when(up, 1).otherwise(0)) / 1000)


def mean_sql(total: str, n: str) -> str:
    """mean_to_thousandths() as DuckDB SQL, for totals of at least 0."""
    unit = f"({n} * 1000)"
    return f"CASE WHEN {n} > 0 THEN ({total} // {unit} + CASE WHEN 2 * ({total} % {unit}) > {unit} OR (2 * ({total} % {unit}) = {unit} AND {total} // {unit} % 2 = 1) THEN 1 ELSE 0 END) / 1000e0 END"


def edits(a: Sequence, b: Sequence) -> int:
    """Levenshtein distance of two sequences."""
    a, b = _without_common_ends(a, b)
    if not a or not b:
        return len(a) + len(b)
    known = _by_foreign(a, b) if len(a) * len(b) > 4096 else None
    return _whole(a, b) if known is None else known


def _without_common_ends(a: Sequence, b: Sequence) -> tuple[Sequence, Sequence]:
    """Whole chunks are compared at once."""
    first, most = 0, min(len(a), len(b))
    width = 4096
    while width:
        while first + width <= most and a[first : first + width] == b[first : first + width]:
            first += width
        width //= 4
    last, most = 0, most - first
    width = 4096
    while width:
        while last + width <= most and a[len(a) - last - width : len(a) - last] == b[len(b) - last - width : len(b) - last]:
            last += width
        width //= 4
    return a[first : len(a) - last], b[first : len(b) - last]


def _by_foreign(a: Sequence, b: Sequence) -> int | None:
    """The distance, where it is known without a table; else None.

    Marks of one sequence that the other never has must each be edited, and one edit serves one of each at most: the larger of
    the two numbers is the least that the distance can be. If the sequences agree once these marks are left out, the runs of them
    between two others can be turned into each other, which gives the most that it can be. Where the two meet, that is it.
    """
    own, others = set(a), set(b)
    gone, come = own - others, others - own
    if not gone and not come:
        return None
    at, bt = _gaps(a, gone), _gaps(b, come)
    if at[0] != bt[0]:
        return None
    left, right = at[1], bt[1]
    most = int(np.maximum(left, right).sum())
    return most if most == max(int(left.sum()), int(right.sum())) else None


def _gaps(x: Sequence, foreign: set) -> tuple[Sequence, np.ndarray]:
    """x without foreign marks, and how many of them stand before, between and after the others."""
    if isinstance(x, str):
        if "\0" in x and "\0" not in foreign:
            return _gaps(list(x), foreign)
        marked = x
        for y in foreign:
            marked = marked.replace(y, "\0")
        flags = np.frombuffer(marked.encode("utf-32-le"), np.uint32) == 0
        rest: Sequence = marked.replace("\0", "")
    else:
        flags = np.fromiter((y in foreign for y in x), bool, len(x))
        rest = [y for y in x if y not in foreign]
    counts = np.diff(np.concatenate([[-1], np.flatnonzero(~flags), [len(x)]])) - 1
    return rest, counts


def _whole(a: Sequence, b: Sequence) -> int:
    """The distance by the whole table, a column at a time as bits of one number (Myers, 1999; Hyyrö, 2001)."""
    where: dict = {}
    for i, x in enumerate(a):
        where.setdefault(x, []).append(i)
    at = {}
    for x, places in where.items():
        raw = bytearray((len(a) + 7) // 8)
        for i in places:
            raw[i >> 3] |= 1 << (i & 7)
        at[x] = int.from_bytes(raw, "little")
    whole, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    more, less, distance = whole, 0, len(a)
    for y in b:
        same = at.get(y, 0)
        vertical = same | less
        diagonal = (((same & more) + more) ^ more) | same
        up, down = less | (whole & ~(diagonal | more)), more & diagonal
        if up & top:
            distance += 1
        elif down & top:
            distance -= 1
        up, down = (up << 1) | 1, down << 1
        more, less = (down | ~(vertical | up)) & whole, up & vertical & whole
    return distance


def _distance(a: Column, b: Column) -> Column:
    """edits() of two strings, or of two arrays of words."""

    @F.arrow_udf("int")
    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array([None if x is None or y is None else edits(x, y) for x, y in zip(left.to_pylist(), right.to_pylist())], pa.int32())

    return run(a, b)


def char_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Edits per character of the reference; for an empty reference 0 if the hypothesis is empty too, else 1."""
    rate = _distance(reference, hypothesis) / F.length(reference)
    return F.when(reference == "", F.when(hypothesis == "", F.lit(0.0)).otherwise(F.lit(1.0))).otherwise(rate)


def words(text: Column) -> Column:
    t = trimmed(text)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"(?U)\s+"))


def word_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Word edits per word of the reference; for an empty reference 0 if the hypothesis has no word either, else 1."""
    a, b = words(reference), words(hypothesis)
    none = F.when(F.size(b) == 0, F.lit(0.0)).otherwise(F.lit(1.0))
    return F.when(F.size(a) == 0, none).otherwise(_distance(a, b) / F.size(a))
