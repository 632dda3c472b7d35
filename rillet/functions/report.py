"""Produce-result text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rillet.model import PASSED_THROUGH_TEXT


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def result_text(topic="topic", partition="partition", offset="offset", value="value") -> Column:
    """``topic/partition offset: value``."""
    return F.concat(
        _c(topic),
        F.lit("/"),
        _c(partition).cast("string"),
        F.lit(" "),
        _c(offset).cast("string"),
        F.lit(": "),
        _c(value).cast("string"),
    )


def multi_result_text(parts: Column | str) -> Column:
    """Each part as P6, joined by ``, ``, in part order."""
    return F.array_join(
        F.transform(
            _c(parts),
            lambda p: result_text(p["topic"], p["partition"], p["offset"], p["value"]),
        ),
        ", ",
    )


def envelope_result_text(parts: Column | str) -> Column:
    """P6-P8 for any result kind: no parts -> ``passed through``, else the joined parts."""
    return F.when(F.size(_c(parts)) == 0, F.lit(PASSED_THROUGH_TEXT)).otherwise(
        multi_result_text(parts)
    )
