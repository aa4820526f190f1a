"""One object for building, keeping and querying an index of documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmine.operators import match, search
from glyphmine.operators.index import build_index
from glyphmine.sources import store


@dataclass
class TextIndex:
    """Documents' index rows and how they are oriented; ``rows`` is lazy, so building costs nothing until it is asked."""

    rows: DataFrame
    orientation: str = "forward"

    @classmethod
    def build(cls, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", orientation: str = "forward") -> TextIndex:
        return cls(build_index(df, id_col, text_col, orientation), orientation)

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> TextIndex:
        s = store.Store(spark, folder)
        return cls(s.index(), s.orientation)

    def _bytes(self, pattern: str) -> bytes:
        raw = pattern.encode()
        return raw[::-1] if self.orientation == "reversed" else raw

    def count(self, pattern: str) -> DataFrame:
        """(doc_id, cnt): overlapping occurrences in the documents that have any."""
        return search.interval(self.rows, self._bytes(pattern)).select("doc_id", "cnt")

    def locate(self, pattern: str) -> DataFrame:
        """(doc_id, start, stop): every occurrence, in bytes of the text as it reads."""
        n = len(pattern.encode())
        at = search.interval_places(self.rows, self._bytes(pattern))
        start = F.col("n") - F.col("place") - n if self.orientation == "reversed" else F.col("place")
        return at.select("doc_id", start.alias("start"), (start + n).alias("stop"))

    def extract(self, rank: int, length: int) -> DataFrame:
        """(doc_id, next, prev) of a rank."""
        return search.extract(self.rows, rank, length)

    def regex(self, pattern: str, max_length: int = 0, max_iterations: int = 0, max_branching: int = 0, core: bool = False, **how) -> DataFrame:
        """Distinct matches by a search of the index, which must be of orientation 'reversed'."""
        if self.orientation != "reversed":
            raise ValueError("patterns are read forwards on an index of orientation 'reversed'")
        return match.index_matches(self.rows, pattern, max_length, max_iterations, max_branching, core, **how)
