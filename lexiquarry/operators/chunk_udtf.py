"""The chunking chain as a table function for SQL.

    SELECT doc_id, c.* FROM docs, LATERAL chunk_text(text, 'article,fallback') c

The second argument names strategies of the chain in the order in which they are tried
(the whole chain if left out), a third the least length of a chunk. Names are checked when
the query is analysed, before any row is read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from lexiquarry.operators.chunking import ARTICLE, FIELD, LEAST_NOISE, NUMBERED, SECTION

#: How parts of a strategy start, and how many starts a text needs; None: by lines.
STRATEGIES: dict[str, tuple[str, int] | None] = {"article": (ARTICLE, 1), "numbered": (NUMBERED, 2), "section": (SECTION, 1), "form": (FIELD, 3), "fallback": None}


def parts(text: str, strategy: str) -> list[str]:
    """A text cut by one strategy; nothing where it does not apply."""
    rule = STRATEGIES[strategy]
    if rule is None:
        cut = text.split("\n")
    else:
        marker, least = rule
        starts = [m.start(2) for m in re.finditer(marker, text)]
        if len(starts) < least:
            return []
        # The line feed before a start goes with its mark.
        cut = [text[a:b] for a, b in zip([0, *starts], [*[s - (text[s - 1 : s] == "\n") for s in starts], len(text)], strict=True)]
    return [p for p in (c.strip(" ") for c in cut) if p]


class ChunkText:
    @staticmethod
    def analyze(text: AnalyzeArgument, strategies: AnalyzeArgument | None = None, least: AnalyzeArgument | None = None) -> AnalyzeResult:
        if strategies is not None:
            if not strategies.isConstantExpression or not isinstance(strategies.value, str):
                raise ValueError("strategies must be a constant string")
            if unknown := [s for s in strategies.value.split(",") if s.strip() not in STRATEGIES]:
                raise ValueError(f"no such strategy: {', '.join(unknown)}")
        return AnalyzeResult(StructType().add("strategy", StringType()).add("n", IntegerType()).add("chunk", StringType()))

    def eval(self, text: str, strategies: str | None = None, least: int = LEAST_NOISE) -> Iterator[tuple]:
        for name in [s.strip() for s in strategies.split(",")] if strategies else STRATEGIES:
            found = parts(text or "", name)
            if found:
                long = [c for c in found if len(c) >= least]
                for n, chunk in enumerate(long or found):
                    yield name, n, chunk
                return


def register(spark: SparkSession) -> None:
    """Makes ``chunk_text`` known to the session's SQL."""
    spark.udtf.register("chunk_text", udtf(ChunkText))
