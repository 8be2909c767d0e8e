"""Classes of similar documents: one row per document instead of all pairs.

A join on pairs names a group of equal contents by a key, finds links between keys, and sums them up for each key as it
finds them.  Here those sums come back to the documents: a class is a connected component of the links, and the links of
a document are its copies and all documents of the linked keys.  So a group of n copies costs n rows, not n * n, and no
link between different contents is lost or sampled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.components import connected_components
from factloom.storage import shared_table


def _labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node connected to each) of edges."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def forest(edges: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the same keys within every partition: one a key at most, however many links it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            a, b = _labels(np.concatenate((a, batch.column(0).to_numpy())), np.concatenate((b, batch.column(1).to_numpy())))
            a, b = a[a != b], b[a != b]
        for k in range(0, len(a), 1 << 20):
            yield pa.RecordBatch.from_arrays([pa.array(a[k : k + (1 << 20)]), pa.array(b[k : k + (1 << 20)])], names=["a", "b"])

    return edges.select("a", "b").mapInArrow(run, "a bigint, b bigint")


def key_classes(members: DataFrame, links: DataFrame, edges: DataFrame, apart: str = "false") -> DataFrame:
    """(key, n, links, best, class_id, keeper): per key its documents, the documents that other keys link it to, the best
    of those links, the smallest id of the class, and the key that has it.

    members(id, key): one row per document.  links(key, links, best): partial sums.  edges(a, b): keys that together
    connect all that is linked.  apart: condition on a key for contents of which copies aren't links.
    """
    per = members.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    summed = links.groupBy("key").agg(F.sum("links").alias("links"), F.max("best").alias("best"))
    part = connected_components(forest(edges)).withColumnRenamed("node", "key")
    per = per.join(summed, "key", "left").join(part, "key", "left").withColumn("component", F.coalesce("component", "key"))
    per = shared_table(per, "class-keys")
    top = per.groupBy("component").agg(F.min(F.struct("first", "key")).alias("top"))
    per = per.join(top, "component").withColumn("links", F.coalesce("links", F.lit(0)) + F.when(F.expr(apart), 0).otherwise(F.col("n") - 1))
    best = F.when((F.col("n") > 1) & ~F.expr(apart), F.lit(1.0)).otherwise(F.col("best"))
    return per.select("key", "n", "links", best.alias("best"), F.when(F.expr(apart), F.col("first")).otherwise(F.col("top.first")).alias("class_id"), F.col("top.key").alias("keeper"))
