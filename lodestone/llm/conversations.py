"""Conversation structure repair as a fold in Spark SQL.

Windows flag the faults of each turn. Turns are collected, sorted, as structs in blocks of BLOCK turn numbers, and
aggregate() folds a block: it carries the best (cost, audit) of the four states that the role initials `(s?(ua)+)?` can be
in, and native least() takes the cheaper edit, of equals the one with the smaller audit. A state is

0: nothing yet; 1: after s; 2: after u, an a must follow; 3: after a. A conversation may end in 0 or 3.

A block is folded once for each state that it can be entered in, so blocks of a very long conversation are folded apart; a
second fold strings them together, and the edits of each block are then applied in it. An audit tells which states it
passes, and audits that lead to one state at one cost aren't prefixes of each other, so the best of a state is enough.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turn numbers that a block has.
BLOCK = 256
#: White space, as characters to trim.
BLANKS = " \t\n\x0b\x0c\r"
#: What the edits cost; an undeleted truncated turn costs as much as an inserted one.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
STATES = range(4)
#: The states a user's turn may follow. An assistant's follows state 2 only.
BEFORE_USER = (0, 1, 3)


def damaged(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) with planted faults, by crc32 of `conv_id:turn` mod 20; a null counts as one space.

    0 drops the row, 1 empties its text, 2 removes its full stops, exclamation and question marks, 3 repeats it, 4 makes
    its role user.
    """
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = rows.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")], (F.crc32(key.cast("binary")) % 20).alias("h"))
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("h") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("h") == 3, 2).otherwise(1)
    return rows.where("h <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("copy")).drop("copy")


def keyed(rows: DataFrame) -> DataFrame:
    """rows with columns that stand for conv_id and for the block of turn, none of them null; a null turn comes first."""
    block = F.coalesce(F.floor(F.col("turn") / BLOCK).cast("bigint"), F.lit(-(1 << 62)).cast("bigint"))
    return rows.withColumns({"ck": F.coalesce("conv_id", F.lit(0).cast("bigint")), "nk": F.col("conv_id").isNull(), "bk": block})


def seen_before(rows: DataFrame) -> DataFrame:
    """(ck, nk, bk, seen): what each block repeats from the blocks before it, as (role, hashes of the text)."""
    said = rows.select("ck", "nk", "bk", "role", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")).distinct()
    first = said.groupBy("ck", "nk", "role", "h1", "h2").agg(F.min("bk").alias("lo"), F.max("bk").alias("hi")).where("lo < hi").drop("hi")
    late = said.join(first, ["ck", "nk", "role", "h1", "h2"]).where("bk > lo")
    return late.groupBy("ck", "nk", "bk").agg(F.collect_set(F.struct("role", "h1", "h2")).alias("seen"))


def flagged(rows: DataFrame) -> DataFrame:
    """keyed rows with their place in the block, their role's initial, and their first fault: blank, duplicate, truncated or none."""
    block = Window.partitionBy("ck", "nk", "bk")
    order = [F.asc_nulls_first("turn"), "role", "text"]
    again = F.row_number().over(Window.partitionBy("ck", "nk", "bk", "role", "text").orderBy("place")) > 1
    rows = rows.withColumns({"place": F.row_number().over(block.orderBy(*order)), "initial": F.substring("role", 1, 1)})
    rows = rows.withColumns({"before": F.lag("initial").over(block.orderBy("place")), "again": again})
    rows = rows.join(seen_before(rows), ["ck", "nk", "bk"], "left")
    own = F.struct("role", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
    ended = F.rtrim("text", F.lit(BLANKS))
    fault = (
        F.when(ended == "", "blank")
        .when(F.col("again") | F.coalesce(F.array_contains("seen", own), F.lit(False)), "duplicate")
        .when(~F.right(ended, F.lit(1)).isin(".", "!", "?"), "truncated")
        .otherwise("none")
    )
    return rows.withColumns({"fault": fault, "illegal": F.coalesce(illegal(F.col("before"), F.col("initial")), F.lit(False))}).drop("seen", "again", "before")


def illegal(a: Column, b: Column) -> Column:
    """Whether turns with these initials may not follow each other."""
    return ~F.concat(a, b).isin("su", "ua", "au")


def after(best: Column, cost: Column | int, letter: str, allowed: Column | None = None) -> Column:
    """The (cost, audit) one edit later; null where there is none or the edit isn't allowed."""
    there = best.isNotNull() if allowed is None else best.isNotNull() & allowed
    return F.when(there, F.struct((best["cost"] + cost).alias("cost"), F.concat(best["audit"], F.lit(letter)).alias("audit")))


def least(*options: Column) -> Column:
    return F.least(*options) if len(options) > 1 else options[0]


def with_inserts(s: list[Column]) -> list[Column]:
    """The best of each state when turns may be inserted at this place."""
    two = least(s[2], *[after(s[e], INSERT, "I") for e in BEFORE_USER])
    return [s[0], s[1], two, least(s[3], after(two, INSERT, "I"))]


def packed(s: list[Column]) -> Column:
    return F.struct(*[x.alias(f"s{i}") for i, x in enumerate(s)])


def entered(e: Column) -> Column:
    """The four bests at the beginning of a block that is entered in state e."""
    start = F.struct(F.lit(0).cast("bigint").alias("cost"), F.lit("").alias("audit"))
    return packed(with_inserts([F.when(e == i, start) for i in STATES]))


def step(acc: Column, turn: Column) -> Column:
    """The bests after one turn: it is kept or given the role that may stand here, or deleted."""
    s = [acc[f"s{i}"] for i in STATES]
    stays, more = ~turn["fault"].isin("blank", "duplicate"), F.when(turn["fault"] == "truncated", TRUNCATED).otherwise(0)

    def taken(e: int, initial: str) -> list[Column]:
        kept = after(s[e], more, "K", stays & (turn["initial"] == initial))
        return [kept] if initial == "s" else [kept, after(s[e], more + REROLE, "R", stays)]

    came = {1: [(0, "s")], 2: [(e, "u") for e in BEFORE_USER], 3: [(2, "a")]}
    return packed(with_inserts([least(after(s[i], DELETE, "D"), *[x for e, initial in came.get(i, []) for x in taken(e, initial)]) for i in STATES]))


def folded(turns: Column) -> Column:
    """By the state that the block is entered in, the best of each state that it can be left in."""
    return F.transform(F.array(*map(F.lit, STATES)), lambda e: F.aggregate(turns, entered(e), step))


def strung(blocks: Column) -> Column:
    """(cost, audit, path) of the cheapest edits of all blocks; path has the state at the end of each block."""
    empty = F.struct(F.lit(0).cast("bigint").alias("cost"), F.lit("").alias("audit"), F.lit("").alias("path"))

    def through(acc: Column, block: Column) -> Column:
        def one(e: int, x: int) -> Column:
            a, b = acc[f"s{e}"], block["best"][e][f"s{x}"]
            whole = F.struct((a["cost"] + b["cost"]).alias("cost"), F.concat(a["audit"], b["audit"]).alias("audit"), F.concat(a["path"], F.lit(str(x))).alias("path"))
            return F.when(a.isNotNull() & b.isNotNull(), whole)

        return packed([F.least(*[one(e, x) for e in STATES]) for x in STATES])

    nothing = F.when(F.lit(False), empty)
    return F.aggregate(blocks, packed([empty, nothing, nothing, nothing]), through, lambda acc: F.least(acc["s0"], acc["s3"]))


def applied(turns: Column, audit: Column, state: Column) -> Column:
    """The lines `role:text` that a block's audit leaves, each behind a line feed."""

    def edit(acc: Column, letter: Column) -> Column:
        turn = F.try_element_at(turns, acc["at"])
        new = F.when(acc["state"] == 2, "assistant").otherwise("user")
        role = F.when(letter == "K", turn["role"]).otherwise(new)
        initial = F.substring(role, 1, 1)
        line = F.concat(F.lit("\n"), role, F.lit(":"), F.when(letter == "I", "").otherwise(turn["text"]))
        state = F.when(initial == "s", 1).when(initial == "u", 2).otherwise(3)
        gone = letter == "D"
        return F.struct(
            (acc["at"] + F.when(letter == "I", 0).otherwise(1)).alias("at"),
            F.when(gone, acc["state"]).otherwise(state).alias("state"),
            F.when(gone, acc["lines"]).otherwise(F.concat(acc["lines"], line)).alias("lines"),
        )

    # split("") of an empty string has one empty part
    letters = F.filter(F.split(audit, ""), lambda x: x != "")
    return F.aggregate(letters, F.struct(F.lit(1).alias("at"), state.alias("state"), F.lit("").alias("lines")), edit, lambda acc: acc["lines"])


def repair(rows: DataFrame) -> DataFrame:
    """What repairs each conversation: (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired).

    rows: conv_id, turn, role, text, of which only conv_id and turn may be null; turns are taken by number, null first, and
    turns of one number by role and text. Conversations with a null id are one conversation. Each turn's first fault
    counts. The edits are those of least cost whose role initials are `(s?(ua)+)?`, of equals the ones with the least
    audit: Keep, Rerole to user or assistant, Delete, Insert an empty turn. Blank and duplicate turns must be deleted.
    repaired has a line `role:text` a turn. gaps beyond a long count as the largest long.

    Blocks of BLOCK turn numbers are flagged and folded in tasks of their own; a conversation's repaired text is one value
    in the end, so it must fit into one (2 GB).
    """
    turns = flagged(keyed(rows))
    counts = [F.count_if(F.col("fault") == x).alias(x) for x in ("blank", "duplicate", "truncated")]
    turn = F.struct("place", "initial", "fault", "role", "text")
    blocks = turns.groupBy("ck", "nk", "bk").agg(
        F.sort_array(F.collect_list(turn)).alias("turns"), *counts, F.count_if("illegal").alias("illegal"), F.min("turn").alias("least"), F.max("turn").alias("most"), F.count_distinct("turn").alias("turned")
    )
    # one pass builds the structs, so that the fold's result isn't computed anew wherever it is read
    blocks = blocks.select("ck", "nk", "bk", "blank", "duplicate", "truncated", "illegal", "least", "most", "turned", "turns", folded(F.col("turns")).alias("best"))
    edges = [F.element_at("turns", i)["initial"].alias(n) for i, n in ((1, "head"), (-1, "tail"))]
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")]
    wide = F.max("most").cast("decimal(38,0)") - F.min("least").cast("decimal(38,0)") + 1 - F.sum("turned")
    whole = blocks.groupBy("ck", "nk").agg(
        *sums, F.least(F.coalesce(wide, F.lit(0)), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("bigint").alias("gaps"), F.sort_array(F.collect_list(F.struct("bk", *edges, "best", "turns"))).alias("blocks")
    )
    whole = whole.withColumn("done", strung(F.col("blocks")))
    path = F.concat(F.lit("0"), F.col("done.path"))

    def state(i: Column) -> Column:
        return F.substring(path, i + 1, F.lit(1)).cast("int")

    def chosen(block: Column, i: Column) -> Column:
        best = block["best"][state(i)]
        end = state(i + 1)
        audit = reduce(lambda other, x: F.when(end == x, best[f"s{x}"]["audit"]).otherwise(other), STATES, F.lit(""))
        return applied(block["turns"], audit, state(i))

    between = F.when(F.size("blocks") > 1, F.size(F.filter(F.zip_with(F.slice("blocks", 1, F.size("blocks") - 1), F.slice("blocks", 2, F.size("blocks") - 1), lambda a, b: illegal(a["tail"], b["head"])), lambda x: x))).otherwise(0)
    lines = F.array_join(F.transform("blocks", chosen), "")
    return whole.select(
        F.when(~F.col("nk"), F.col("ck")).alias("conv_id"),
        "gaps",
        *[F.col(c).cast("bigint").alias(c) for c in ("blank", "duplicate", "truncated")],
        (F.col("illegal") + between).cast("bigint").alias("illegal"),
        F.col("done.cost").alias("cost"),
        F.col("done.audit").alias("audit"),
        F.substring(lines, 2, (1 << 31) - 1).alias("repaired"),
    )


def repair_damaged(rows: DataFrame) -> DataFrame:
    """`repair` of all conversations of rows after `damaged`; one that has no row left has zeros and empty strings.

    Further columns of rows are left behind; an empty table gives no rows.
    """
    rows = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    found = repair(damaged(rows)).withColumnRenamed("conv_id", "id")
    ids = rows.select("conv_id").distinct()
    both = ids.join(found, F.col("conv_id").eqNullSafe(F.col("id")), "left").drop("id")
    return both.na.fill(0, ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]).na.fill("", ["audit", "repaired"])
