"""Lines of text out of nested engine output, whatever its shape."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import staged

# The fields that hold recognised text, in the order in which an object's own are taken.
TEXT_FIELDS = ("rec_texts", "texts", "text")
#: Levels of nesting that are walked before output counts as broken.
DEPTH = 64


def _texts(nodes: DataFrame) -> DataFrame:
    """(_key, path, line) of the texts that a level's nodes hold themselves."""
    said = []
    for i, field in enumerate(TEXT_FIELDS):
        v = F.expr(f"try_variant_get(v, '$.{field}', 'variant')")
        many = F.expr(f"try_variant_get(v, '$.{field}', 'array<string>')")
        one = F.when(v.isNotNull(), F.array(F.expr(f"try_variant_get(v, '$.{field}', 'string')")))
        said.append(F.when(F.schema_of_variant(v).startswith("ARRAY"), many).otherwise(one))
    fields = F.transform(F.array(*said), lambda t, i: F.transform(F.coalesce(t, F.array().cast("array<string>")), lambda x, j: F.struct(F.array(i, j).alias("own"), x.alias("line"))))
    # a pair of anything and [text, ...] is a box and what was read in it
    second = F.expr("try_variant_get(v, '$[1]', 'variant')")
    pair = F.when(F.schema_of_variant(second).startswith("ARRAY") & (F.expr("schema_of_variant(try_variant_get(v, '$[1][0]', 'variant'))") == "STRING"), F.expr("try_variant_get(v, '$[1][0]', 'string')"))
    own = F.when(F.col("kind") == "OBJECT", F.flatten(fields)).when((F.col("kind") == "ARRAY") & pair.isNotNull(), F.array(F.struct(F.array(F.lit(0), F.lit(0)).alias("own"), pair.alias("line"))))
    # a node's own texts come before those of its children, whose paths have a 1 here
    rows = nodes.select("_key", "path", F.explode(own).alias("t")).select("_key", F.concat("path", F.array(F.lit(0)), "t.own").alias("path"), F.trim("t.line").alias("line"))
    return rows.where("line <> ''")


def _children(nodes: DataFrame) -> DataFrame:
    below = nodes.where("kind in ('OBJECT', 'ARRAY')").lateralJoin(nodes.sparkSession.tvf.variant_explode(F.col("v").outer()))
    return below.select("_key", F.concat("path", F.array(F.lit(1), F.col("pos"))).alias("path"), F.col("value").alias("v"))


def _kinds(nodes: DataFrame) -> DataFrame:
    kind = F.schema_of_variant("v")
    return nodes.withColumn("kind", F.when(kind.startswith("OBJECT"), "OBJECT").when(kind.startswith("ARRAY"), "ARRAY").otherwise("LEAF")).where("kind <> 'LEAF'")


def text_lines(outputs: DataFrame, key: str, raw: str) -> DataFrame:
    """(key, place, line): the distinct lines in the JSON text ``raw`` of each row, in the order in which a walk meets them first.

    An object gives the texts of TEXT_FIELDS, a list or a single one, then
    those of all it holds; a list [anything, [text, ...]] gives that text, then
    those of its members. Members of objects are walked in the order of their
    names, which is how VARIANT keeps them. Blank texts are left out. What isn't
    JSON, or null, gives no lines. Each level of nesting is one step over all
    rows, and a level's nodes are staged, so depth costs steps and not memory.
    """
    nodes = outputs.select(F.col(key).alias("_key"), F.array().cast("array<int>").alias("path"), F.try_parse_json(raw).alias("v"))
    nodes = _kinds(nodes.where("v is not null"))
    found = []
    for level in range(DEPTH):
        nodes = staged(nodes, f"nested-{level}")
        found.append(_texts(nodes))
        if nodes.isEmpty():
            break
        nodes = _kinds(_children(nodes))
    else:
        raise ValueError(f"output is nested deeper than {DEPTH} levels")
    lines = reduce(DataFrame.unionByName, found).groupBy("_key", "line").agg(F.min("path").alias("path"))
    per = lines.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("path", "line"))).alias("lines"))
    return per.select(F.col("_key").alias(key), F.posexplode("lines").alias("place", "x")).select(key, "place", "x.line")
