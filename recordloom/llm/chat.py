"""Chat logs: collapse cumulative snapshots, then render what is left.

A conversation logged after every turn leaves snapshots that prefix the last
one. Each turn adds a position-dependent hash to its conversation's rolling
hash, so the hash after turn n names the first n turns. Additions commute, so
the rolling hash is a prefix sum that blocks of turns compute side by side. A
conversation whose last hash is an inner hash of another one is its prefix and
leaves in an anti-join; of equal conversations the smallest id stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table

#: Turns whose hashes are summed in one task at a time.
BLOCK = 1024
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def _turns(log: DataFrame) -> DataFrame:
    """(conv_id, block, turn, role, text, own) with null roles and texts as empty strings."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = log.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    turns = turns.where("conv_id is not null and turn is not null")
    return turns.withColumn("block", F.floor(F.col("turn") / F.lit(BLOCK))).withColumn("own", F.xxhash64("role", F.lit("\x1f"), "text"))


def rolling(log: DataFrame) -> DataFrame:
    """(conv_id, n, h1, h2): for each turn its number in the conversation and the hash up to it.

    Turns are ordered by turn, equal ones by role and hash. A window covers
    one block of turns; the sums before a block come from block totals.
    """
    turns = _turns(log).select("conv_id", "block", "turn", "role", "own")
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "own")
    blocks = turns.groupBy("conv_id", "block").agg(F.count("*").alias("size"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv_id", "block", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("skip"))
    placed = turns.withColumn("i", F.row_number().over(inside)).join(blocks, ["conv_id", "block"])
    placed = placed.withColumn("n", F.col("skip") + F.col("i"))
    # 40 bits each, so that sums over a conversation stay within a long
    for name, seed in (("h1", 1), ("h2", 2)):
        placed = placed.withColumn(name, F.xxhash64("own", "n", F.lit(seed)).bitwiseAND(F.lit((1 << 40) - 1)))
    sums = placed.groupBy("conv_id", "block").agg(F.sum("h1").alias("s1"), F.sum("h2").alias("s2"))
    sums = sums.select("conv_id", "block", *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(s) for s in ("s1", "s2")])
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("h1", F.sum("h1").over(upto)).withColumn("h2", F.sum("h2").over(upto))
    placed = placed.join(sums, ["conv_id", "block"])
    return placed.select("conv_id", F.col("n").cast("long").alias("n"), (F.col("h1") + F.col("s1")).alias("h1"), (F.col("h2") + F.col("s2")).alias("h2"))


def maximal(log: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_collapsed) of conversations that no other one continues.

    n_collapsed counts the conversations that are equal to or prefixes of it
    and have no longer one of smaller id to belong to; each of those that go is
    counted once, at the longest conversation it prefixes (ties: smallest id).
    """
    steps = staged(rolling(log), "chat-steps")
    last = steps.groupBy("conv_id").agg(F.max_by(F.struct("n", "h1", "h2"), "n").alias("e")).select("conv_id", "e.*")
    # of equal conversations one stays
    first = staged(last.groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("same")), "chat-ends")
    inner = steps.join(first.select("conv_id", F.col("n").alias("size")), "conv_id").where("n < size")
    longest = inner.groupBy("n", "h1", "h2").agg(F.max_by("conv_id", F.struct("size", -F.col("conv_id"))).alias("into"))
    ends = first.join(longest, ["n", "h1", "h2"], "left")
    gone = ends.where("into is not null").groupBy(F.col("into").alias("conv_id")).agg(F.sum("same").alias("gone"))
    kept = first.join(longest, ["n", "h1", "h2"], "left_anti").select("conv_id", "n", "same")
    return kept.join(gone, "conv_id", "left").select("conv_id", F.col("n").alias("n_turns"), (F.col("same") - 1 + F.coalesce("gone", F.lit(0))).cast("long").alias("n_collapsed"))


def render(log: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_collapsed, rendered): maximal conversations in ChatML.

    Turns go in order of turn, equal ones by role and hash; the text of one
    conversation is one string, as training rows are. Null roles and texts are
    empty strings; rows without conv_id or turn belong to no conversation and
    are left out. Repeated rows are repeated turns. Further columns are
    ignored. An empty table gives no rows.
    """
    kept = staged(maximal(log), "chat-kept")
    turns = _turns(log).join(kept.select("conv_id"), "conv_id", "left_semi")
    piece = F.concat(F.lit(OPEN), "role", F.lit(MIDDLE), "text", F.lit(CLOSE))
    # pieces join inside blocks first, then blocks inside conversations
    parts = turns.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "own", piece.alias("p")))).alias("x"))
    parts = parts.select("conv_id", "block", F.array_join(F.col("x.p"), "").alias("p"))
    whole = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "p"))).alias("x"))
    return whole.select("conv_id", F.array_join(F.col("x.p"), "").alias("rendered")).join(kept, "conv_id")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(table(spark, sf_dir, "conversations")).select("conv_id", "n_turns", "n_collapsed", "rendered")


#: The same by comparing whole prefixes as strings.
OP8_SQL = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
    '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS p
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
s AS (SELECT conv_id, row_number() OVER w AS n, string_agg(p, '') OVER w AS h FROM t
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)),
e AS (SELECT conv_id, max(n) AS n, arg_max(h, n) AS h FROM s GROUP BY conv_id),
f AS (SELECT n, h, min(conv_id) AS conv_id, count(*) AS same FROM e GROUP BY n, h),
i AS (SELECT s.n, s.h, first(f.conv_id ORDER BY f.n DESC, f.conv_id) AS target
  FROM s JOIN f USING (conv_id) WHERE s.n < f.n GROUP BY s.n, s.h),
g AS (SELECT i.target AS conv_id, sum(same) AS gone FROM f JOIN i USING (n, h) GROUP BY i.target)
SELECT f.conv_id, cast(f.n AS BIGINT) AS n_turns, cast(same - 1 + coalesce(gone, 0) AS BIGINT) AS n_collapsed, f.h AS rendered
FROM f LEFT JOIN g USING (conv_id) WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.n = f.n AND i.h = f.h)
"""
