"""Effect closure kept up to date over a stream of new edges.

Adding edges only ever adds effects, so each micro-batch starts the semi-naive loop from what its edges bring to known
symbols.  Removing edges isn't monotone and needs a new closure from scratch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom.operators.fixpoint import carries_effects, semi_naive
from factloom.storage import shared_table


class EffectStream:
    """(symbol, effect) closure of roots and all edges seen so far."""

    def __init__(self, roots: DataFrame):
        self.spark = roots.sparkSession
        self.known = shared_table(roots.select("symbol", "effect").distinct(), "effects")
        self.edges: DataFrame | None = None

    def add(self, edges: DataFrame) -> None:
        fresh = carries_effects(edges).select("caller", "callee").distinct()
        self.edges = shared_table(fresh if self.edges is None else self.edges.unionByName(fresh).distinct(), "stream-edges")
        every, known = self.edges, self.known

        def step(new: DataFrame, uses: DataFrame) -> DataFrame:
            return uses.join(new.select(F.col("symbol").alias("callee"), "effect"), "callee").select(F.col("caller").alias("symbol"), "effect").distinct()

        first = step(known, fresh).join(known, ["symbol", "effect"], "left_anti")
        found = semi_naive(first, lambda new: step(new, every).join(known, ["symbol", "effect"], "left_anti"), ["symbol", "effect"])
        self.known = shared_table(known.unionByName(found).distinct(), "effects")

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Feeds micro-batches of an edge stream; each batch is applied once it is complete."""
        return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: self.add(batch)).start()
