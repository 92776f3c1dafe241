"""PR-05: encoding repair at ingest, by a bounded round trip."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package

#: Bytes cp1252 has no character for; wrong decoders leave them as control characters.
_HOLES = (0x81, 0x8D, 0x8F, 0x90, 0x9D)


def _bytes(text: str) -> bytes:
    return b"".join(bytes([ord(c)]) if ord(c) in _HOLES else c.encode("cp1252") if ord(c) > 0xFF or not 0x80 <= ord(c) < 0xA0 else bytes([ord(c)]) for c in text)


def repair(text: str | None, rounds: int = 2) -> tuple[str | None, bool]:
    """Text whose characters, written as cp1252, are valid UTF-8 was decoded wrongly; anything else stays."""
    if not text or text.isascii():
        return text, False
    now = text
    for _ in range(rounds):
        try:
            then = _bytes(now).decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            break
        if then == now:
            break
        now = then
    return now, now != text


def with_repair(df: DataFrame, column: str) -> DataFrame:
    """``column`` repaired, with ``was_repaired``; plain ASCII never leaves the JVM's fast path as a changed value."""
    ship_package(df.sparkSession)

    @F.pandas_udf("text string, was_repaired boolean")
    def fix(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([repair(t) for t in s], columns=["text", "was_repaired"])

    odd = F.col(column).rlike(r"[^\x00-\x7F]")
    fixed = F.when(odd, fix(F.col(column)))
    out = df.withColumn("_fixed", fixed)
    return out.withColumn(column, F.coalesce("_fixed.text", column)).withColumn("was_repaired", F.coalesce("_fixed.was_repaired", F.lit(False))).drop("_fixed")
