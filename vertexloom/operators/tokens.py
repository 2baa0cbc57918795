"""Whitespace tokens to whole numbers in the order of first appearance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import dense_ids, stored

DELIMITERS = " \f\n\r\t\v"


def _classes(delimiters: str) -> tuple[str, str]:
    body = "".join(f"\\x{ord(c):02x}" if ord(c) < 256 else c for c in delimiters)
    return f"[^{body}]+", f"[{body}]+"


def token_ids(lines: DataFrame, first: int = 0, skip_lines: int = 0, skip_prefix: str = "#%", delimiters: str = DELIMITERS) -> DataFrame:
    """token, id: each distinct token's number, ``first`` for the one that appears first.

    ``lines``: line (number), value.  Skipped lines give no tokens.  Places are reduced to one per
    token before anything is ordered (runs jobs)."""
    word, _ = _classes(delimiters)
    seen = _used(lines, skip_lines, skip_prefix).select("line", F.posexplode(F.regexp_extract_all("value", F.lit(word), F.lit(0))).alias("pos", "token"))
    places = seen.groupBy("token").agg(F.min(F.struct("line", "pos")).alias("at"))
    return dense_ids(places, [F.col("at.line"), F.col("at.pos")], "id", first).select("token", "id")


def _used(lines: DataFrame, skip_lines: int, skip_prefix: str) -> DataFrame:
    keep = F.col("line") >= skip_lines
    if skip_prefix:
        keep = keep & ~F.substring("value", 1, 1).isin(*skip_prefix)
    return lines.where(keep)


def replace_tokens(lines: DataFrame, ids: DataFrame, skip_lines: int = 0, skip_prefix: str = "#%", delimiters: str = DELIMITERS) -> DataFrame:
    """line, value with every token replaced by its number, delimiters and skipped lines unchanged."""
    word, gap = _classes(delimiters)
    used = _used(lines, skip_lines, skip_prefix)
    parts = used.select("line", F.posexplode(F.regexp_extract_all("value", F.lit(f"{word}|{gap}"), F.lit(0))).alias("pos", "token"))
    named = parts.join(ids, "token", "left").select("line", "pos", F.coalesce(F.col("id").cast("string"), "token").alias("t"))
    made = named.groupBy("line").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "t"))), lambda x: x["t"]), "").alias("made"))
    done = used.select("line").withColumn("u", F.lit(True))
    return lines.join(made, "line", "left").join(done, "line", "left").select("line", F.when(F.col("u").isNotNull(), F.coalesce("made", "value")).otherwise(F.col("value")).alias("value"))


def strtoidx(lines: DataFrame, first: int = 0, skip_lines: int = 0, skip_prefix: str = "#%", delimiters: str = DELIMITERS) -> DataFrame:
    ids = stored(token_ids(lines, first, skip_lines, skip_prefix, delimiters), "tokens")
    return replace_tokens(lines, ids, skip_lines, skip_prefix, delimiters)
