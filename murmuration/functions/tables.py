"""Table functions for SQL: a text's words and n-grams beside its row, and windows of words over an ordered, partitioned table.

Their columns follow from their arguments, so a query names what it wants and Spark knows the schema before it runs. In DataFrame code
the built-in `posexplode`, `ngrams` and `lead` are faster; these are for SQL users, in lateral joins and over TABLE arguments.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

WORD = re.compile(r"[^\s]+")


def _number(argument: AnalyzeArgument | None, otherwise: int, name: str) -> int:
    value = otherwise if argument is None else argument.value
    if not isinstance(value, int) or isinstance(value, bool) or value < 1:
        raise ValueError(f"{name} has to be a whole number from 1 on, known before the query runs")
    return value


@udtf
class WordGrams:
    """word_grams(text, longest): (pos, n, gram) of every run of 1 to `longest` words, by place and length; a column for each word, w1, w2 ..., null beyond n. A null text gives no rows."""

    @staticmethod
    def analyze(text: AnalyzeArgument, longest: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not isinstance(text.dataType, StringType):
            raise ValueError("text has to be a string")
        schema = StructType().add("pos", IntegerType()).add("n", IntegerType()).add("gram", StringType())
        for i in range(_number(longest, 1, "longest")):
            schema = schema.add(f"w{i + 1}", StringType())
        return AnalyzeResult(schema=schema)

    def eval(self, text: str, longest: int = 1) -> Iterator[tuple]:
        words = WORD.findall(text or "")
        for at in range(len(words)):
            for n in range(1, min(longest, len(words) - at) + 1):
                own = words[at : at + n]
                yield (at, n, " ".join(own), *own, *[None] * (longest - n))


@udtf
class WordWindows:
    """word_windows(TABLE(words), size, key, pos, text): (the key's column, first, last, words) of every `size` words in a row of a key, ordered by pos; the function asks for that
    partitioning itself. A key with fewer words gives none, and no more than `size` words are held at a time."""

    def __init__(self):
        self._held: deque = deque()
        self._key = None

    @staticmethod
    def analyze(words: AnalyzeArgument, size: AnalyzeArgument, key: AnalyzeArgument | None = None, pos: AnalyzeArgument | None = None, text: AnalyzeArgument | None = None) -> AnalyzeResult:
        _number(size, 1, "size")
        if not words.isTable:
            raise ValueError("words has to be a table")
        names = [a.value if a else d for a, d in ((key, "file_id"), (pos, "pos"), (text, "text"))]
        kinds = {f.name: f.dataType for f in words.dataType.fields}
        if missing := [n for n in names if n not in kinds]:
            raise ValueError(f"the table has no column {', '.join(missing)}")
        schema = StructType().add(names[0], kinds[names[0]]).add("first", LongType()).add("last", LongType()).add("words", StringType())
        return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn(names[0])], orderBy=[OrderingColumn(names[1])])

    def eval(self, words: Row, size: int, key: str = "file_id", pos: str = "pos", text: str = "text") -> Iterator[tuple]:
        self._held.append((words[pos], words[text] or ""))
        if len(self._held) > size:
            self._held.popleft()
        if len(self._held) == size:
            yield words[key], int(self._held[0][0]), int(self._held[-1][0]), " ".join(t for _, t in self._held)

    def terminate(self) -> Iterator[tuple]:
        yield from ()


def register(spark: SparkSession) -> None:
    """Makes word_grams and word_windows known to the session's SQL."""
    spark.udtf.register("word_grams", WordGrams)
    spark.udtf.register("word_windows", WordWindows)
