"""Chat formatting of logged conversations, with cumulative snapshots collapsed.

A log often holds a conversation after every exchange. Each turn gets the
rolling hash of the turns up to it; a conversation whose last hash is an
earlier hash of another one is a prefix of it and goes, by an anti-join on
hashes alone. Equal conversations become one. What remains is rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rolling_hashes(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``at`` (from 1), ``h1``, ``h2`` of the turns up to there, ``role``, ``text``, ``last``.

    The hash is a sum of hashes of place, role and text, twice with different
    seeds, exact in decimals, so that the running sum of a window makes it.
    """
    said = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    # Repeated turns combine before the shuffle, so that a turn logged a million times is one row of a window.
    once = turns.dropDuplicates(["conv_id", "turn", "role", "text"])
    numbered = once.withColumn("at", F.row_number().over(said)).withColumn(
        "last", F.lead("at").over(Window.partitionBy("conv_id").orderBy("at")).isNull())
    upto = Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)

    def rolling(seed: int) -> Column:
        return F.sum(F.xxhash64(F.lit(seed), "at", "role", "text").cast("decimal(20,0)")).over(upto)

    return numbered.select("conv_id", "at", rolling(1).alias("h1"), rolling(2).alias("h2"), "role", "text", "last")


def _turns(log: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    return log.select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def maximal_conversations(log: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                          text_col: str = "text") -> DataFrame:
    """``conv_id``, ``n_turns``, ``n_copies``: conversations that are no prefix of a longer one.

    Equal conversations are one, under the smallest id; ``n_copies`` counts them.
    Turns follow by number (a null first), then by role and text; a turn logged
    twice counts once; null roles and texts are empty. Rows without a conversation
    id are one conversation with a null id; other columns are not read; an empty
    table gives an empty table.
    """
    key = ["at", "h1", "h2"]
    rolled = rolling_hashes(_turns(log, id_col, turn_col, role_col, text_col)).drop("role", "text")
    # Copies meet as counts, so a conversation logged a million times is one row a task.
    whole = rolled.filter("last").groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    begun = rolled.filter("not last").select(*key).distinct()
    return whole.join(begun, key, "left_anti").select("conv_id", F.col("at").cast("long").alias("n_turns"), "n_copies")


def render(log: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """One row for each maximal conversation: the id, ``n_turns``, ``n_copies``, ``rendered``.

    A turn is rendered as ``<|im_start|>role``, a line feed, its text,
    ``<|im_end|>`` and a line feed. Turns follow by number (a null first), then
    by role and text; a turn logged twice counts once; null roles and texts are
    empty. Rows without a conversation id are one conversation with a null id.
    A conversation has to fit in one value, as its rendering does; an empty
    table gives an empty table; other columns are not read.
    """
    turns = _turns(log, id_col, turn_col, role_col, text_col)
    kept = maximal_conversations(turns)
    one = F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "text", F.lit("<|im_end|>\n"))
    said = F.sort_array(F.collect_list(F.struct("at", one.alias("said"))))
    texts = (
        turns.join(kept.select(F.col("conv_id").alias("kept_id")), F.col("conv_id").eqNullSafe(F.col("kept_id")), "left_semi")
        .transform(_numbered).groupBy("conv_id")
        .agg(F.array_join(F.transform(said, lambda x: x["said"]), "").alias("rendered"))
        .withColumnRenamed("conv_id", "text_id")
    )
    return kept.join(texts, F.col("conv_id").eqNullSafe(F.col("text_id"))).select(
        F.col("conv_id").alias(id_col), "n_turns", "n_copies", "rendered")


def _numbered(turns: DataFrame) -> DataFrame:
    once = turns.dropDuplicates(["conv_id", "turn", "role", "text"])
    return once.withColumn("at", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")))


SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
c AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, text) AS turns FROM t GROUP BY conv_id),
w AS (SELECT min(conv_id) AS conv_id, count(*) AS n_copies, turns FROM c GROUP BY turns)
SELECT conv_id, len(turns)::BIGINT AS n_turns, n_copies,
  list_aggregate(list_transform(turns, lambda x: '<|im_start|>' || x.role || chr(10) || x.text || '<|im_end|>' || chr(10)),
                 'string_agg', '') AS rendered
FROM w WHERE NOT EXISTS (
  SELECT 1 FROM w b WHERE len(b.turns) > len(w.turns) AND b.turns[1:len(w.turns)] = w.turns)
"""
