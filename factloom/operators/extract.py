"""Facts from table-like text: labels with their numbers on one line or on the lines below, years from headers."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NUMBER = re.compile(r"\(?\$?\s*-?\d[\d,]*(?:\.\d+)?\)?")
YEARS = re.compile(r"\b(?:19[89]\d|20[0-3]\d)\b")
LABEL = re.compile(r"[A-Za-z][A-Za-z _&'-]*")
#: Lines below a label that may hold its numbers; a header's years count up to this many.
AHEAD, MOST_YEARS = 4, 4


def value_of(token: str) -> float | None:
    t = token.strip()
    minus = t.startswith("(") and t.endswith(")")
    try:
        v = float(re.sub(r"[()$,\s]", "", t))
    except ValueError:
        return None
    return -abs(v) if minus else v


def facts_in(text: str) -> list[tuple[str, int, float]]:
    """(label, year, value) of a text: a line's numbers are paired with the years of the last header, in order.

    A line of years alone, or years after words without other numbers, is a header. A label without numbers takes the
    lines of numbers right below it. The first value of a label and year stays.
    """
    years: list[int] = []
    out: dict[tuple[str, int], float] = {}
    label, pending = "", 0

    def add(values: list[float]) -> None:
        for y, v in zip(years, values):
            out.setdefault((label, y), v)

    for line in text.split("\n"):
        rest = YEARS.sub(" ", line)
        if YEARS.search(line) and not NUMBER.search(rest):
            years = [int(y) for y in dict.fromkeys(YEARS.findall(line))][:MOST_YEARS]
            pending = 0
            continue
        m = LABEL.match(line.strip())
        values = [v for v in map(value_of, NUMBER.findall(line[len(m.group(0)) :] if m else line)) if v is not None]
        if m:
            label, pending = m.group(0).strip(), 0 if values else AHEAD
            add(values)
        elif values and pending:
            got = sum(1 for k in out if k[0] == label)
            for y, v in zip(years[got:], values):
                out.setdefault((label, y), v)
            pending -= 1
    return [(k, y, v) for (k, y), v in out.items()]


def extract(df: DataFrame, key: str = "ticker", text: str = "evidence") -> DataFrame:
    """(key, label, year, value) of every row's text; rows are dealt evenly, whatever the length of their texts."""

    def run(frames):
        for f in frames:
            rows = [(k, *r) for k, t in zip(f[key], f[text]) for r in facts_in(t or "")]
            yield pd.DataFrame(rows, columns=[key, "label", "year", "value"])

    return df.select(key, text).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, label string, year int, value double")


def fallback(found: DataFrame, existing: DataFrame) -> DataFrame:
    """Extracted facts whose (ticker, label, year) is not there yet."""
    return found.join(existing.select("ticker", F.col("metric").alias("label"), "year"), ["ticker", "label", "year"], "left_anti")
