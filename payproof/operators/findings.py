"""The one shape every check returns.

A finding's supporting lines are rows of a second table, not an array in the finding: a split order or a steered limit
can lean on any number of lines, and rows spread over the cluster where an array could not.
"""
from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["dataset_id", "clause", "source_file", "line_number", "anchor"]


@dataclass
class Found:
    """What a check found: findings, and the lines that support them (None when a check cites no other line)."""
    findings: DataFrame
    links: DataFrame | None = None


def finding(df: DataFrame, area: str, clause: str, severity: str | Column, amount: Column, title: Column, file: str,
            line: str | Column = "line_number", anchor: Column | int = 0) -> DataFrame:
    """`anchor` tells apart findings of one clause on one line (two pairs that share a payment, say)."""
    sev = severity if isinstance(severity, Column) else F.lit(severity)
    at = line if isinstance(line, Column) else F.col(line)
    return df.select("dataset_id", F.lit(area).alias("area"), F.lit(clause).alias("clause"), sev.alias("severity"),
                     amount.cast("decimal(18,4)").alias("amount"), title.alias("title"),
                     F.lit(file).alias("source_file"), at.cast("bigint").alias("line_number"),
                     (anchor if isinstance(anchor, Column) else F.lit(anchor)).cast("bigint").alias("anchor"))


def link(df: DataFrame, clause: str, file: str, line: str | Column, related_line: str | Column,
         anchor: Column | int = 0) -> DataFrame:
    """Supporting lines; in every check they belong to the finding's own file."""
    def col(x: str | Column) -> Column:
        return x if isinstance(x, Column) else F.col(x)
    return df.select("dataset_id", F.lit(clause).alias("clause"), F.lit(file).alias("source_file"),
                     col(line).cast("bigint").alias("line_number"),
                     (anchor if isinstance(anchor, Column) else F.lit(anchor)).cast("bigint").alias("anchor"),
                     F.lit(file).alias("related_file"), col(related_line).cast("bigint").alias("related_line"))


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def all_of(parts: list[Found]) -> Found:
    """All findings, and all links, of several checks (flat: one branch per check)."""
    links = [p.links for p in parts if p.links is not None]
    return Found(union([p.findings for p in parts]), union(links) if links else None)
