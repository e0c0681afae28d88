"""Several values packed in one field, segmented with the help of a dictionary.

A multi-pattern automaton finds the known whole values in a cell; dynamic
programming then chooses, among known values, quoted spans, bare words and
delimiters, the cover of the cell with the least cost. Delimiters inside a
quoted value are thereby protected.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A dictionary is collected and sent to every task, so its size is checked.
MAX_KNOWN = 200_000

_WORD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.-")
_LETTER = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_PAIRS = {"[": "]", "(": ")", "{": "}", "<": ">"}


def _bare(value: str) -> bool:
    return value[:1] in _LETTER and all(c in _WORD for c in value)


def _stripped(value: str) -> str:
    """Without the blanks, quotes and paired brackets around it."""
    while True:
        shorter = value.strip().strip("\"'").strip()
        if len(shorter) > 1 and _PAIRS.get(shorter[0]) == shorter[-1]:
            shorter = shorter[1:-1]
        if shorter == value:
            return value
        value = shorter


def segment(cell: str, automaton) -> list[str]:
    """The values of one cell in order. Cost of a cover: known value 1, other quoted span 2, bare word 3, any other character 4."""
    n = len(cell)
    spans: dict[int, list[tuple[int, int]]] = {}
    for end, size in automaton.iter(cell) if len(automaton) else ():
        start, stop = end - size + 1, end + 1
        if start and stop < n and cell[start - 1] in "\"'" and cell[stop] == cell[start - 1]:
            spans.setdefault(start - 1, []).append((stop + 1, 1))
        elif _bare(cell[start:stop]) and not (start and cell[start - 1] in _WORD) and not (stop < n and cell[stop] in _WORD):
            spans.setdefault(start, []).append((stop, 1))
    i = 0
    closing = {q: _positions(cell, q) for q in "\"'"}
    while i < n:
        c = cell[i]
        if c in "\"'":
            close = next((p for p in closing[c] if p > i), -1) if len(closing[c]) < 64 else cell.find(c, i + 1)
            if close > 0:
                spans.setdefault(i, []).append((close + 1, 2))
        elif c in _LETTER and not (i and cell[i - 1] in _WORD):
            j = i + 1
            while j < n and cell[j] in _WORD:
                j += 1
            spans.setdefault(i, []).append((j, 3))
            i = j
            continue
        i += 1
    cost, step = [0.0] * (n + 1), [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        cost[i], step[i] = cost[i + 1] + (0.0 if cell[i].isspace() else 4.0), i + 1
        for stop, price in spans.get(i, ()):
            if price + cost[stop] < cost[i] or (price + cost[stop] == cost[i] and stop > step[i]):
                cost[i], step[i] = price + cost[stop], stop
    values, i = [], 0
    chosen = {(a, b) for a, ends in spans.items() for b, _ in ends}
    while i < n:
        if (i, step[i]) in chosen and (value := _stripped(cell[i : step[i]])):
            values.append(value)
        i = step[i]
    return values


def _positions(text: str, char: str) -> list[int]:
    return [i for i, c in enumerate(text) if c == char]


def known_values(dictionary: DataFrame, column: str, at_most: int = MAX_KNOWN) -> list[str]:
    """The dictionary's distinct values; an error if they are more than at_most, as every task gets them."""
    rows = dictionary.select(F.trim(F.col(column)).alias("v")).filter("v <> ''").distinct().limit(at_most + 1).collect()
    if len(rows) > at_most:
        raise ValueError(f"the dictionary holds more than {at_most} values")
    return sorted(r.v for r in rows)


def packed_values(cell: Column, known: list[str]) -> Column:
    """The cell's values as an array, in order.

    Null gives null, a cell without values an empty array. A bare value starts
    with a letter and holds letters, digits, _ . and -; a quoted one may hold
    anything. Known values with other characters count only where quoted.
    An unclosed quote is an ordinary character.
    """

    @F.pandas_udf("array<string>")
    def split_cells(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for value in known:
            automaton.add_word(value, len(value))
        if known:
            automaton.make_automaton()
        for cells in batches:
            yield pd.Series([None if c is None else segment(c, automaton) for c in cells], index=cells.index, dtype=object)

    return split_cells(cell)


def unpack(df: DataFrame, row_key: str, cell: str, known: list[str], table_name: str) -> DataFrame:
    """One row per value: table_name, row_key, value_position (from 1; empty pieces don't count), value_text."""
    return (
        df.select(F.col(f"`{row_key}`").cast("bigint").alias("row_key"), F.col(f"`{cell}`").cast("string").alias("_cell"))
        .filter("_cell is not null and _cell <> ''")
        .select("row_key", F.posexplode(packed_values(F.col("_cell"), known)).alias("_at", "value_text"))
        .select(F.lit(table_name).alias("table_name"), "row_key", (F.col("_at") + 1).cast("bigint").alias("value_position"), "value_text")
    )
