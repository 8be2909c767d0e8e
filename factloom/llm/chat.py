"""Multi-party perspective rotation for conversations.

For every participant the dialogue is rendered once with that speaker as the assistant and everyone else as a named
user; the loss mask is the list of character spans that the chosen speaker says.  Narrators (system turns) are not
participants: they keep their own header and never carry loss.

    <|im_start|>system\\n...<|im_end|>\\n<|im_start|>user name=ann\\n...<|im_end|>\\n<|im_start|>assistant\\n...<|im_end|>\\n

One shuffle by conversation does it all: the position of a span depends on the perspective only through the headers of
the speaker's own earlier turns, so running sums over the turns give every perspective's spans, and the rendered texts
are joined from one array per conversation.  Only built-in functions; nothing leaves the JVM.

Defined cases: a null speaker is 'unknown', a null text is empty (its turn stays), turns are ordered by (turn, speaker,
text) with null turns first, so repeated turn numbers and repeated rows keep a fixed order and all appear; rows with a
null conversation id form one conversation with a null id; control marks inside texts and names are defused ('<|'
becomes '< |'), line breaks in names become spaces; a conversation of narrators only has no perspective and gives no
row; an empty table gives an empty result; other columns are ignored.  Spans are 0-based, end exclusive, in Unicode
code points, and cover the text with its closing mark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

NARRATORS = ("system",)
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _defused(text: Column) -> Column:
    return F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("<|"), F.lit("< |"))


def rotate_perspectives(messages: DataFrame, narrators: tuple[str, ...] = NARRATORS) -> DataFrame:
    """(conv_id, speaker, n_turns, rendered, spans, n_loss_chars), one row per conversation and participant."""
    name = F.regexp_replace(_defused(F.coalesce(F.col("role").cast("string"), F.lit("unknown"))), "[\r\n]", " ")
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), name.alias("who"), _defused(F.col("text")).alias("said"))
    rows = rows.withColumn("narrates", F.col("who").isin(*narrators))
    rows = rows.withColumn("head", F.when(F.col("narrates"), F.col("who")).otherwise(F.concat(F.lit("user name="), F.col("who"))))
    size = F.length("head") + F.length("said") + F.lit(len(OPEN) + 1 + len(CLOSE))
    conv = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "who", "said")
    # Position of the text when all speakers are users, and how many own turns came before.
    rows = rows.withColumn("no", F.row_number().over(conv))
    rows = rows.withColumn("own", F.row_number().over(W.partitionBy("conv_id", "who").orderBy("no")))
    rows = rows.withColumn("before", F.sum(size.cast("long")).over(W.partitionBy("conv_id").orderBy("no")) - size)
    # As the assistant, a speaker's header is shorter (or longer) by a constant in each own turn up to this one.
    shift = F.length("head") - F.lit(len("assistant"))
    start = F.col("before") + F.lit(len(OPEN) + 1) + F.length("head") - shift * F.col("own")
    rows = rows.withColumn("start", start.cast("long")).withColumn("end", (start + F.length("said") + len(CLOSE)).cast("long"))
    talk = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("no", "who", "narrates", "head", "said", "start", "end"))).alias("turns"))
    speakers = F.array_sort(F.array_distinct(F.transform(F.filter("turns", lambda t: ~t["narrates"]), lambda t: t["who"])))
    each = talk.select("conv_id", F.explode(speakers).alias("speaker"), "turns")
    turn = lambda t: F.concat(F.lit(OPEN), F.when((t["who"] == F.col("speaker")) & ~t["narrates"], F.lit("assistant")).otherwise(t["head"]), F.lit("\n"), t["said"], F.lit(CLOSE))
    spans = F.transform(F.filter("turns", lambda t: (t["who"] == F.col("speaker")) & ~t["narrates"]), lambda t: F.array(t["start"], t["end"]))
    out = each.select("conv_id", "speaker", F.size("turns").alias("n_turns"), F.array_join(F.transform("turns", turn), "").alias("rendered"), spans.alias("spans"))
    loss = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + F.get(s, F.lit(1)) - F.get(s, F.lit(0)))
    return out.select("conv_id", "speaker", "n_turns", "rendered", F.to_json("spans").alias("spans"), loss.alias("n_loss_chars"))


ROTATE_SQL = """
WITH m AS (SELECT conv_id, turn, regexp_replace(replace(coalesce(role, 'unknown'), '<|', '< |'), '[\\r\\n]', ' ', 'g') AS who, replace(coalesce(text, ''), '<|', '< |') AS said FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, who, said) AS no FROM m),
p AS (SELECT DISTINCT conv_id, who AS speaker FROM m WHERE who <> 'system'),
r AS (SELECT p.conv_id, speaker, no, who, said, '<|im_start|>' || CASE WHEN who = speaker THEN 'assistant' WHEN who = 'system' THEN who ELSE 'user name=' || who END || chr(10) AS head,
        said || '<|im_end|>' || chr(10) AS body FROM p JOIN n ON p.conv_id IS NOT DISTINCT FROM n.conv_id),
s AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, speaker ORDER BY no) AS stop FROM r)
SELECT conv_id, speaker, CAST(count(*) AS INTEGER) AS n_turns, string_agg(head || body, '' ORDER BY no) AS rendered,
    '[' || string_agg('[' || CAST(stop - length(body) AS BIGINT) || ',' || CAST(stop AS BIGINT) || ']', ',' ORDER BY no) FILTER (WHERE who = speaker) || ']' AS spans,
    CAST(sum(length(body)) FILTER (WHERE who = speaker) AS BIGINT) AS n_loss_chars
FROM s GROUP BY conv_id, speaker"""
