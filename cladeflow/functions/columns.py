"""Scalar functions as column expressions: sequences, strings, seeded hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Confidence words of annotation records and their weights.
CONFIDENCE = {"Reviewed": 1.0, "HighConfidence": 0.9, "MediumConfidence": 0.75, "LowConfidence": 0.5, "LowestConfidence": 0.25}


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), "ACGTacgt", "TGCAtgca")


def sequence_of(text: Column) -> Column:
    """A text's letters as bases, each letter standing for a fixed one."""
    return F.translate(F.lower(F.regexp_replace(text, "[^A-Za-z]", "")), "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC")


def collapse_runs(s: Column, symbols: str) -> Column:
    """Runs of the symbols (a character class) as one: the first of each run."""
    return F.regexp_replace(s, f"([{symbols}])[{symbols}]+", "$1")


def file_safe(s: Column) -> Column:
    return F.regexp_replace(s, "[^A-Za-z0-9_.-]", "_")


def percent(x: Column, digits: int = 2) -> Column:
    """A share as text in percent."""
    return F.format_string(f"%.{digits}f%%", x * 100)


def bits(x: Column, width: int = 8) -> Column:
    return F.lpad(F.bin(x), width, "0")


def seeded(key: Column | str, seed: int | str) -> Column:
    """A hexadecimal hash by which rows are put in an order that is random and repeatable."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def hash01(key: Column | str, seed: int | str) -> Column:
    """A number from 0 to below 1 that follows from a key and a seed."""
    return F.conv(F.substring(seeded(key, seed), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def probabilistic_round(x: Column, key: Column | str, seed: int | str) -> Column:
    """Up with the probability of the part behind the point, down else."""
    whole = F.floor(x)
    return (whole + F.when(x - whole > hash01(key, seed), 1).otherwise(0)).cast("long")


def all_of(masks: list[Column]) -> Column:
    out = masks[0]
    for m in masks[1:]:
        out = out & m
    return out


def confidence(word: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in CONFIDENCE.items() for x in pair]), word)


def flatten_struct(df, column: str, prefix: str = ""):
    """A struct column as columns of its own, behind the others."""
    fields = df.schema[column].dataType.fieldNames()
    return df.select(*[c for c in df.columns if c != column], *[F.col(f"{column}.{f}").alias(prefix + f) for f in fields])


def nonspecific_share(seq: Column) -> Column:
    """Share of A, C, G and T after runs of N have been made one."""
    s = F.regexp_replace(seq, "[Nn]+", "N")
    return F.length(F.regexp_replace(s, "[^ACGTacgt]", "")) / F.length(s)


def clip_runs(seq: Column, longest: int = 20) -> Column:
    """Runs of N longer than ``longest`` cut to that length."""
    return F.regexp_replace(seq, f"([Nn]{{{longest}}})[Nn]+", "$1")


def wrap_lines(seq: Column, width: int = 80) -> Column:
    return F.rtrim(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), F.lit("\n"))
