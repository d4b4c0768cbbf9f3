"""Lists of records at any depth of a JSON document, found round by round with VARIANT (S-12, N-03 to N-05).

A document is parsed once into a VARIANT. Each round looks at one level of all documents: a list whose elements are all
objects with the wanted keys is found, and isn't looked into; any other object or list gives its members to the next
level. A list is judged by its own row, so a round is one narrow stage. A level is a table, and there are as many rounds as
the deepest document has levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.rounds import stored


def is_object(node: Column) -> Column:
    """Whether a VARIANT is an object, told without a look at its members."""
    return F.try_variant_get(node, "$", "struct<any:variant>").isNotNull()


def elements(node: Column) -> Column:
    """array<variant> of a list; null for any other VARIANT."""
    return F.try_variant_get(node, "$", "array<variant>")


def has_keys(node: Column, keys: tuple[str, ...]) -> Column:
    """Whether a VARIANT is an object with all the keys; their values may be null."""
    out = is_object(node)
    for k in keys:
        out = out & F.try_variant_get(node, f"$.{k}", "variant").isNotNull()
    return out


def members(nodes: DataFrame) -> DataFrame:
    """(doc, path, place, name, node): the members of nodes (doc, path, node) that are objects or lists; name is theirs or their number."""
    nodes.createOrReplaceTempView("__nodes")
    return nodes.sparkSession.sql("SELECT doc, path, e.pos AS place, coalesce(e.key, CAST(e.pos AS STRING)) AS name, e.value AS node FROM __nodes, LATERAL variant_explode(node) AS e")


def record_lists(docs: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(doc, path, place, record): the records of every list of records in docs (doc, json), as JSON text.

    path names the members that lead to the list, `$.a.0.b`; place counts the list's records from 0. Malformed JSON, null
    and documents without such a list give no rows; an empty list is none.
    """
    now = docs.select("doc", F.lit("$").alias("path"), F.try_parse_json("json").alias("node"))
    found = None
    while True:
        now = now.where(is_object(F.col("node")) | elements(F.col("node")).isNotNull())
        held = elements(F.col("node"))
        full = F.coalesce((F.size(held) > 0) & F.forall(held, lambda x: has_keys(x, keys)), F.lit(False))
        now = stored(now.withColumn("full", full))
        if now.isEmpty():
            break
        here = now.where("full").select("doc", "path", F.posexplode(elements(F.col("node"))).alias("place", "node"))
        here = here.select("doc", "path", "place", F.to_json("node").alias("record"))
        found = here if found is None else found.union(here)
        now = members(now.where("not full")).select("doc", F.concat_ws(".", "path", "name").alias("path"), "node")
    return found if found is not None else docs.limit(0).select("doc", F.lit("").alias("path"), F.lit(0).alias("place"), F.lit("").alias("record"))
