"""Scripts by text or by digest: SQL over tables, as a server would run stored scripts over keys."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession


class Scripts:
    """EVAL, SCRIPT LOAD, EVALSHA, SCRIPT EXISTS and FLUSH. A script is one SQL query; ``{name}`` stands for a table given to the call, ``:name`` for a value."""

    def __init__(self, spark: SparkSession):
        self.spark, self.known = spark, {}

    def load(self, source: str) -> str:
        digest = hashlib.sha1(source.encode()).hexdigest()
        self.known[digest] = source
        return digest

    def exists(self, *digests: str) -> list[bool]:
        return [d.lower() in self.known for d in digests]

    def flush(self) -> None:
        self.known.clear()

    def eval(self, source: str, args: dict | None = None, **tables: DataFrame) -> DataFrame:
        """Runs a script and remembers it."""
        self.load(source)
        return self.spark.sql(source, args=args or {}, **tables)

    def evalsha(self, digest: str, args: dict | None = None, **tables: DataFrame) -> DataFrame:
        source = self.known.get(digest.lower())
        if source is None:
            raise KeyError(f"no script with digest {digest}")
        return self.eval(source, args, **tables)
