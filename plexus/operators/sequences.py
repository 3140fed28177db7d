"""Sequence dynamic programs and entropy coding.

Knapsack and longest common subsequence are expressions of ``plexus.functions``; Huffman trees are built
per group from its symbol counts, which are aggregated first, so a group costs its alphabet only.
"""

from __future__ import annotations

import heapq
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexus.functions import knapsack, lcs_length  # noqa: F401  part of this module's interface


def symbol_counts(texts: DataFrame, group: str, text: str) -> DataFrame:
    """``(group, symbol, n)``: frequency of every character."""
    symbols = texts.select(group, F.explode(F.split(F.coalesce(F.col(text), F.lit("")), "")).alias("symbol"))
    return symbols.filter("symbol <> ''").groupBy(group, "symbol").agg(F.count("*").alias("n"))


def codes(counts: dict[str, int]) -> dict[str, str]:
    """A Huffman code: left 0, right 1, equal weights by smallest symbol; a lone symbol gets 0."""
    heap = [(n, s, (s,)) for s, n in counts.items()]
    heapq.heapify(heap)
    made = dict.fromkeys(counts, "")
    if len(heap) == 1:
        return dict.fromkeys(counts, "0")
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for bit, (_, _, held) in (("0", a), ("1", b)):
            for s in held:
                made[s] = bit + made[s]
        heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
    return made


def huffman(counts: DataFrame, group: str) -> DataFrame:
    """``(group, symbol, n, code)`` from symbol counts."""

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        made = codes(dict(zip(frame.symbol, frame.n.tolist(), strict=True)))
        return frame.assign(code=frame.symbol.map(made))

    kind = counts.schema[group].dataType.simpleString()
    return counts.groupBy(group).applyInPandas(build, f"{group} {kind}, symbol string, n long, code string")


def encode(texts: DataFrame, table: DataFrame, group: str, text: str) -> DataFrame:
    """``texts`` with ``bits``, encoded by the group's code."""
    book = table.groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct("symbol", "code"))).alias("book"))
    symbols = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), ""), lambda c: c != "")
    coded = texts.join(book, group, "left").withColumn("bits", F.array_join(F.transform(symbols, lambda c: F.element_at("book", c)), ""))
    return coded.drop("book")


def decode(coded: DataFrame, table: DataFrame, group: str) -> DataFrame:
    """``coded`` with ``decoded``: the text that the bits stand for, by walking them once.

    Rows are decoded where they stand, with their group's code joined to them; no group comes together.
    """
    book = table.groupBy(group).agg(F.collect_list(F.struct("code", "symbol")).alias("book"))
    joined = coded.join(book, group, "left")

    def walk(lines: pd.Series, books: pd.Series) -> pd.Series:
        held: dict = {}
        out = []
        for line, entries in zip(lines, books, strict=True):
            if line is None:
                out.append(None)
                continue
            key = tuple((e["code"], e["symbol"]) for e in entries) if entries is not None else ()
            if key not in held:
                held[key] = re.compile("|".join(c for c, _ in key)), dict(key)
            cut, symbol = held[key]
            # codes are free of prefixes, so the first that fits is the only one
            out.append("".join([symbol[c] for c in cut.findall(line)]) if key else "")
        return pd.Series(out, dtype="object")

    return joined.withColumn("decoded", F.pandas_udf(walk, "string")(F.col("bits"), F.col("book"))).drop("book")


def sizes(table: DataFrame, group: str) -> DataFrame:
    """``(group, symbols, plain_bits, coded_bits, ratio, kraft)`` of a code table."""
    length = F.length("code")
    return table.groupBy(group).agg(
        F.count("*").alias("symbols"), (F.sum("n") * 8).alias("plain_bits"), F.sum(F.col("n") * length).alias("coded_bits"),
        F.round(F.sum(F.col("n") * length) / (F.sum("n") * 8), 6).alias("ratio"), F.round(F.sum(F.pow(F.lit(2.0), -length)), 6).alias("kraft"),
    )
