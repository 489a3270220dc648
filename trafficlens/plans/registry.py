"""A small registry: query name -> Spark function, checking SQL, what it covers."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Registry:
    def __init__(self):
        self.queries = {}
        self.oracles = {}
        self.covers = {}

    def query(self, name, oracle=None, covers=""):
        def register(function):
            if name in self.queries:
                raise ValueError(f"query {name!r} registered twice")
            self.queries[name] = function
            if oracle is not None:
                self.oracles[name] = oracle
            self.covers[name] = covers
            return function

        return register


def rounded(df: DataFrame, *columns: str, digits=6) -> DataFrame:
    """Round for comparison; adding zero turns -0.0 into 0.0."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})
