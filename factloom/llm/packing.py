"""Packing documents into fixed token windows with the sum-of-squares online rule.

The rule (Csirik, Johnson, Kenyon, Orlin, Shor and Weber, "On the sum-of-squares algorithm for bin packing"): with
N(h) open windows filled to level h, put the next document of s tokens where the sum of N(h)**2 over the partially
filled levels grows least.  Moving a window from level h to h+s changes the sum by 2*(N(h+s)-N(h))+2, completing a
window (h+s = size) by 1-2*N(h), opening one by 2*N(s)+1.  N is one level array, so a step costs one vector operation
over the levels, whatever the number of open windows.

Distribution: documents are hashed into shards of about `shard_tokens` tokens, each an independent online packer, so
the work is embarrassingly parallel, a shard's memory is bounded, and the waste is at most the open windows of a shard
(a fixed number of windows against `shard_tokens`/`window` closed ones).

Defined cases: tokens are white-space separated words; null, empty and blank texts have none and give no row; a
document longer than the window fills whole windows by itself first and only its remainder is placed by the rule;
rows with a null id are packed like others, in the shard that their text is hashed to; repeated rows are packed as often as they occur; equal documents arrive in
the order of (id, tokens), so results don't depend on the partitioning; among levels with the same sum the fullest
wins and an open window wins over a new one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import partitions_for, word_count
from factloom.storage import shared_table

WINDOW = 2048
SHARD_TOKENS = 4_000_000
SCHEMA = "doc_id bigint, piece int, window_id bigint, window_start int, doc_start bigint, n_tokens int"


class SumOfSquares:
    """Online packer for one shard. place(s) gives (window, level at which s starts)."""

    def __init__(self, window: int):
        self.window, self.opened = window, 0
        self.count = np.zeros(window + 1, dtype=np.int64)  # count[0] and count[window] stay 0
        self.stacks: dict[int, list[int]] = {}

    def place(self, s: int) -> tuple[int, int]:
        w, n = self.window, self.count
        if s == w:
            self.opened += 1
            return self.opened - 1, 0
        best, level = 2 * int(n[s]) + 1, 0
        here = n[1 : w - s + 1]
        used = np.flatnonzero(here)
        if len(used):
            change = 2 * (n[s + 1 :][used] - here[used]) + 2
            if used[-1] == w - s - 1:
                change[-1] -= 1
            k = len(used) - 1 - int(np.argmin(change[::-1]))
            if change[k] <= best:
                level = int(used[k]) + 1
        if level:
            n[level] -= 1
            at = self.stacks[level].pop()
        else:
            at = self.opened
            self.opened += 1
        if level + s < w:
            n[level + s] += 1
            self.stacks.setdefault(level + s, []).append(at)
        return at, level


def pack_shard(shard: int, ids: list, sizes: np.ndarray, window: int) -> pd.DataFrame:
    """Rows of one shard whose documents arrive in the given order."""
    packer, out = SumOfSquares(window), []
    base = int(shard) << 32
    for doc, size in zip(ids, sizes.tolist()):
        whole, rest = divmod(size, window)
        for piece in range(whole):
            at, level = packer.place(window)
            out.append((doc, piece, base + at, level, piece * window, window))
        if rest:
            at, level = packer.place(rest)
            out.append((doc, whole, base + at, level, whole * window, rest))
    frame = pd.DataFrame(out, columns=["doc_id", "piece", "window_id", "window_start", "doc_start", "n_tokens"])
    return frame.astype({"doc_id": "Int64"})


def pack(docs: DataFrame, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS, id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None) -> DataFrame:
    """One row per document piece: the window it is in, where it starts there, and where it starts in the document.

    tokens: a column of token counts instead of words.
    """
    text = F.col(text_col).cast("string")
    size = word_count(text) if tokens is None else tokens.cast("long")
    spread = F.when(F.col(id_col).isNull(), F.xxhash64(text)).otherwise(F.lit(0))  # rows without an id go to all shards
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), size.alias("n"), spread.alias("spread")).filter("n > 0")
    sized = shared_table(sized, "packing-sizes")  # the text is read once; ids and sizes are 16 bytes a document
    shards = partitions_for(sized.agg(F.sum("n")).first()[0], shard_tokens)
    keyed = sized.withColumn("shard", F.pmod(F.xxhash64("doc_id", "spread"), F.lit(shards)))

    def one(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.astype({"doc_id": "Int64"}).sort_values(["doc_id", "n"], kind="stable", na_position="first")
        ids = [None if x is pd.NA else int(x) for x in frame["doc_id"]]
        return pack_shard(key[0], ids, frame["n"].to_numpy(), window)

    return keyed.repartition(max(1, min(shards, 100_000)), "shard").groupBy("shard").applyInPandas(one, SCHEMA)
