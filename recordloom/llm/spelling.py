"""Spelling variants: words one edit apart, each led to the form that is far more frequent.

Every word emits itself and its distinct single deletions as keys. Words that
share a key are at most two edits apart: an inserted letter makes one word a
deletion of the other, and a replaced one gives both the same deletion. Pairs
that meet are held against the exact distance, and no pair meets twice: only
the place where two words differ can be deleted from both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table

MIN_LETTERS, MIN_COUNT = 7, 2
#: A form is at least so many times as frequent as its variant.
RATIO = 10
#: Of the words, as many as one in DROPPED lose a letter, by a checksum.
DROPPED = 31
#: From form to form counts grow RATIO times, so no chain is longer.
CHAIN = 24

# The letters of a run.
LETTERS = r"A-Za-zÀ-ÿ"


def word_counts(docs: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(word, n) of the runs of letters of all texts, in lower case (A-Z only), with the dropped letters."""
    runs = F.regexp_extract_all(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit(f"[{LETTERS}]{{{min_letters},}}"), 0)
    rows = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).alias("d"), F.explode(runs).alias("run"))
    rows = rows.select("d", F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("run"))
    h = F.crc32(F.concat("d", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    short = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    words = rows.withColumn("h", h).select(F.when(F.col("h") % DROPPED == 0, short).otherwise(F.col("run")).alias("word"))
    counted = words.where(F.length("word") >= min_letters).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= min_count)


def deletions(word: Column) -> Column:
    """A word and its distinct single deletions."""
    cut = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1)))
    return F.array_distinct(F.concat(F.array(word), cut))


def near(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n) of all pairs of ``words`` (word, n) exactly one edit apart, in both directions."""
    keys = words.select(F.explode(deletions(F.col("word"))).alias("key"), "word", "n")
    other = keys.select("key", F.col("word").alias("other"), F.col("n").alias("other_n"))
    pairs = keys.join(other, "key").where("word < other").where(F.levenshtein("word", "other", 1) == 1)
    both = F.array(F.struct("word", "n", "other", "other_n"), F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    return pairs.select(F.inline(both))


def roots(forms: DataFrame, word: str = "word", form: str = "form") -> DataFrame:
    """(word, root) for the words of ``forms`` (word, form): follow forms until a word has none."""
    step = staged(forms.select(F.col(form).alias("root"), F.col(word).alias("word")), "spelling-roots")
    ahead = forms.select(F.col(word).alias("root"), F.col(form).alias("next"))
    done = None
    for _ in range(CHAIN):
        moved = staged(step.join(ahead, "root", "left").select("word", "root", "next"), "spelling-step")
        still = moved.where("next is null").select("word", "root")
        done = still if done is None else done.unionByName(still)
        step = moved.where("next is not null").select("word", F.col("next").alias("root"))
        if step.isEmpty():
            return done
    raise RuntimeError(f"forms go on after {CHAIN} steps")


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of ``words`` (word, n), which are distinct and not null.

    ``form`` is the near word (one letter inserted, deleted or replaced) of the
    largest count, ties to the first in code points, if that is ``ratio`` times
    the word's; else null, as is form_n. ``root`` follows forms to the last and
    is the word where there is none. An empty table gives no rows.

    How many words share a key is bounded by their letters, so no key is hot
    whatever the texts hold; joins on roots, where many variants may share one,
    are of the kind that Spark splits.
    """
    words = staged(words, "spelling-words")
    found = near(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("x"))
    much = -F.col("x.less") >= ratio * F.col("n")
    out = words.join(found, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(much, F.col("x.form")).alias("form"), F.when(much, -F.col("x.less")).alias("form_n"))
    out = staged(out, "spelling-forms")
    tips = roots(out.where("form is not null"))
    return out.join(tips, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants among the words of all documents.

    A null text has no words; a null id counts as empty in the checksum. Texts
    without runs of letters give nothing; repeated rows count each time, and
    long texts and long runs are taken whole. Other columns play no part.
    """
    return variants(word_counts(table(spark, sf_dir, "documents")))


def _op12_sql() -> str:
    from .sharding import crc_sql

    return f"""
WITH RECURSIVE r AS (SELECT coalesce(cast(doc_id AS VARCHAR), '') AS d, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
u AS (SELECT d, run, count(*) AS c FROM r WHERE length(run) >= {MIN_LETTERS} GROUP BY ALL),
h AS (SELECT run, c, {crc_sql("(d || ':' || run)")} AS h FROM u),
t AS (SELECT c, CASE WHEN h % {DROPPED} = 0 THEN substr(run, 1, cast(h % length(run) AS INTEGER)) || substr(run, cast(h % length(run) AS INTEGER) + 2) ELSE run END AS word FROM h),
w AS (SELECT word, cast(sum(c) AS BIGINT) AS n FROM t WHERE length(word) >= {MIN_LETTERS} GROUP BY word HAVING sum(c) >= {MIN_COUNT}),
k AS (SELECT DISTINCT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS key FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM w)),
p AS (SELECT a.word, b.word AS other, b.n AS m FROM k a JOIN k b ON a.key = b.key AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM k a JOIN w b ON a.key = b.word
  UNION SELECT b.word, a.word, a.n FROM k a JOIN w b ON a.key = b.word),
s AS (SELECT word, count(*) AS n_near FROM p GROUP BY word),
b AS (SELECT word, other, m FROM p QUALIFY row_number() OVER (PARTITION BY word ORDER BY m DESC, other) = 1),
f AS (SELECT w.word, w.n, coalesce(s.n_near, 0) AS n_near, CASE WHEN b.m >= {RATIO} * w.n THEN b.other END AS form, CASE WHEN b.m >= {RATIO} * w.n THEN b.m END AS form_n
  FROM w LEFT JOIN s USING (word) LEFT JOIN b USING (word)),
x AS (SELECT word, word AS tip FROM f UNION ALL SELECT x.word, f.form FROM x JOIN f ON x.tip = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, x.tip AS root, f.n, f.n_near, f.form_n FROM f JOIN x ON x.word = f.word JOIN f e ON e.word = x.tip AND e.form IS NULL
"""


#: The same by places of replaced letters and by inserted ones.
OP12_SQL = _op12_sql()
