"""Award lists of several editions, pages of which were made from one another's templates (S-13).

A copied page may keep another page's blocks. Two signs give them away: a category that names another sector, and cells
that stand on other pages already. Blocks of which half or more are such cells go; of what stays, a company that won
an edition isn't its finalist as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The part of a block's cells that must be on earlier pages for the block to be left over.
LEFT_OVER = 0.5


def letters(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def own_category(category: Column, name: Column, sector: Column) -> Column:
    """struct<category, foreign>: a category without its sector's name before a dash; foreign if that is another sector's.

    A category that repeats the company's name is none.
    """
    # a long dash cuts wherever it stands, a hyphen between blanks
    parts = F.split(F.regexp_replace(F.replace(F.trim(category), F.lit("–"), F.lit(" - ")), r"\s+", " "), " - ", 2)
    prefix, rest = F.get(parts, F.lit(0)), F.trim(F.get(parts, F.lit(1)))
    repeats = (letters(category) == letters(name)) | F.contains(F.lower(category), F.lower(name))
    dashed = (F.size(parts) == 2) & (rest != "")
    mine = (letters(prefix) != "") & F.contains(letters(sector), F.substring(letters(prefix), 1, 5))
    nothing = F.lit(None).cast("string")
    kept = F.when(repeats | (F.trim(category) == ""), nothing).when(F.size(parts) < 2, F.trim(category)).when(dashed & mine, rest)
    return F.struct(kept.alias("category"), F.coalesce(~repeats & dashed & ~mine, F.lit(False)).alias("foreign"))


def left_over(cells: DataFrame) -> DataFrame:
    """(page, block): blocks half of whose cells, or more, stand in a block of an earlier page as well.

    cells: page, block, edition, key. Pages are ordered by edition, then by name. A cell is met by the first page that has
    it, so a cell of very many pages is no join of all with all.
    """
    own = cells.where("key <> ''").groupBy("page", "block", "key").agg(F.min("edition").alias("edition"))
    first = own.groupBy("key").agg(F.min(F.struct("edition", "page")).alias("first"))
    seen = own.join(first, "key").withColumn("again", F.struct("edition", "page") > F.col("first"))
    shares = seen.groupBy("page", "block").agg(F.count("*").alias("n"), F.count_if("again").alias("again"))
    return shares.where((F.col("n") > 1) & (F.col("again") >= LEFT_OVER * F.col("n"))).select("page", "block")


def awards(rows: DataFrame) -> DataFrame:
    """(edition, key, name, sector, status, category, city, page): one row for each company of an edition.

    rows: page, block, edition, sector, status (winner or finalist), name, category, city, place (in its block). Winners come
    before finalists, then pages in order. A block counts as left over by its companies and categories together, so a
    company that is on the lists of two editions stays on both. The city is the first that any of its rows gives.
    """
    named = rows.withColumn("key", letters(F.col("name"))).where("key <> ''")
    named = named.withColumn("own", own_category(F.col("category"), F.col("name"), F.col("sector"))).where("not own.foreign").withColumn("category", F.col("own.category")).drop("own")
    cells = named.select("page", "block", "edition", F.concat_ws("|", "key", F.coalesce(letters(F.col("category")), F.lit(""))).alias("key"))
    kept = named.join(left_over(cells), ["page", "block"], "left_anti")
    company = Window.partitionBy("edition", "key").orderBy(F.when(F.col("status") == "winner", 0).otherwise(1), "page", "block", "place")
    whole = company.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = kept.withColumns({"__k": F.row_number().over(company), "city": F.first("city", ignorenulls=True).over(whole)})
    return found.where("__k = 1").select("edition", "key", "name", "sector", "status", "category", "city", "page")
