r"""Conversation structure repair: window-derived fault flags, then one fold over the sorted turns.

A row's faults come from two expressions and one window (is there an equal row before it?). The rows of
a conversation are then collected as structs, sorted by turn, and folded by ``aggregate``: the
accumulator holds, for each of four states (nothing yet, after system, after user, after assistant), the
cheapest edits that lead there as a (cost, edits) struct, and every step is a ``least`` of such structs.
Equal costs go to the edits that come first in ASCII order. All of it is native: no Python.

Edits are written D(elete), I(nsert), K(eep), R(erole). In the fold J and S stand for an inserted and a
rerolled assistant: from one state only one of I, J and only one of R, S can follow, so the order of
the strings is that of their initials, and the repaired turns can be read off the edits in linear time.

One insert before a row is enough: two would lead from a state to itself, or cost more than deleting
the row that made them necessary. Two edits of one cost that lead to one state are never prefixes of
each other (the rest would be inserts, which cost), so the least prefix has the least continuation.

One exchange, by conversation. A conversation is one row of the result, whose digest is over its whole
text, so it is collected in one task; its size is that of the longest conversation, not of the table.

Defined cases: a null role or text is one space, a null turn comes first; turns that tie are ordered by
role, then text; rows that repeat are duplicates; a null conv_id is a conversation of its own; an empty
role has no initial (it can only be rerolled or deleted, and is illegal beside any other); a conversation
without rows after damage has zeros and an empty audit; an empty table gives no rows; other columns of
the input are left out, so their names don't matter. Long conversations: each step copies strings as
long as the edits so far.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tributary.llm.shared import bounded

WHITE = " \t\n\x0b\x0c\r"
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
STATE = "struct<cost: bigint, edits: string>"
LEGAL = ("su", "ua", "au")


def damaged(turns: DataFrame) -> DataFrame:
    """turns with the faults of the contract, by crc32 of ``conv_id:turn`` modulo 20; ``gone`` marks dropped rows."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    act = F.crc32(F.encode(key, "utf-8")) % 20
    text = F.coalesce(F.col("text"), space)
    return turns.select(
        "conv_id", "turn",
        F.when(act == 4, F.lit("user")).otherwise(F.coalesce(F.col("role"), space)).alias("role"),
        F.when(act == 1, F.lit("")).when(act == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (act == 0).alias("gone"),
        F.explode(F.when(act == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_copy"),
    ).drop("_copy")


def flagged(rows: DataFrame) -> DataFrame:
    """rows with ``fault``: null, or the first of blank, duplicate, truncated that holds."""
    end = F.rtrim(F.col("text"), F.lit(WHITE))
    again = F.row_number().over(Window.partitionBy("conv_id", "gone", "role", "text").orderBy(F.col("turn").asc_nulls_first())) > 1
    fault = F.when(end == "", "blank").when(again, "duplicate").when(~F.right(end, F.lit(1)).isin(".", "!", "?"), "truncated")
    # dealt by conversation at once: the window and the collecting need no other exchange
    return rows.repartition("conv_id").withColumn("fault", fault)


def then(state: Column, cost: int | Column, edit: str | Column) -> Column:
    """The state, one edit on; null (which ``least`` passes over) where the state can't be reached."""
    edit = F.lit(edit) if isinstance(edit, str) else edit
    return F.when(state.isNotNull(), F.struct((state["cost"] + cost).alias("cost"), F.concat(state["edits"], edit).alias("edits")))


def inserted(s: list[Column]) -> list[Column]:
    """The four states, each perhaps after one insert."""
    return [s[0], s[1], F.least(s[2], *(then(s[k], INSERT, "I") for k in (0, 1, 3))), F.least(s[3], then(s[2], INSERT, "J"))]


def step(acc: Column, x: Column) -> Column:
    """The four states after the row x was kept, rerolled or deleted."""
    s = inserted([acc[f"s{k}"] for k in range(4)])
    left, extra = x["left"], x["extra"]

    def onto(states: list[Column], initial: str, rerole: str) -> list[Column]:
        own = x["initial"] == initial
        cost = F.when(own, extra).otherwise(extra + REROLE)
        return [F.when(left, then(q, cost, F.when(own, F.lit("K")).otherwise(F.lit(rerole)))) for q in states]

    system = F.when(left & (x["initial"] == "s"), then(s[0], extra, "K"))
    gone = [then(q, DELETE, "D") for q in s]
    return F.struct(
        gone[0].alias("s0"),
        F.least(gone[1], system).alias("s1"),
        F.least(gone[2], *onto([s[0], s[1], s[3]], "u", "R")).alias("s2"),
        F.least(gone[3], *onto([s[2]], "a", "S")).alias("s3"),
    )


def cheapest(rows: Column) -> Column:
    """The (cost, edits) of an array of structs (initial, left, extra) in order."""
    none = F.lit(None).cast(STATE)
    start = F.struct(F.lit(0).cast("bigint").alias("cost"), F.lit("").alias("edits"))
    begin = F.struct(start.alias("s0"), none.alias("s1"), none.alias("s2"), none.alias("s3"))

    def end(acc: Column) -> Column:
        s = inserted([acc[f"s{k}"] for k in range(4)])
        return F.least(s[0], s[3])

    return F.aggregate(rows, begin, step, end)


def repaired_turns(rows: Column, edits: Column) -> Column:
    """The turns (role, text) that the edits leave, in order."""
    per_row = F.translate(edits, "IJ", "")
    before = F.split(edits, "[DKRS]", -1)
    turn = lambda role, text: F.struct(role.alias("role"), text.alias("text"))
    new = lambda code: F.when(code == "I", turn(F.lit("user"), F.lit(""))).when(code == "J", turn(F.lit("assistant"), F.lit("")))

    def one(x: Column, i: Column) -> Column:
        edit = F.substring(per_row, i + 1, F.lit(1))
        own = F.when(edit == "K", turn(x["role"], x["text"])).when(edit == "R", turn(F.lit("user"), x["text"])).when(edit == "S", turn(F.lit("assistant"), x["text"]))
        return F.array(new(F.get(before, i)), own)

    made = F.concat(F.flatten(F.transform(rows, one)), F.array(new(F.get(before, F.size(rows)))))
    return F.filter(made, lambda x: x.isNotNull())


def repaired(turns: DataFrame, faults_of=flagged) -> DataFrame:
    """Per conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit and ``turns``, the repaired (role, text).

    turns: conv_id, turn, role, text, and perhaps ``gone``, which marks rows that count for nothing but
    their conversation's existence.
    """
    rows = turns if "gone" in turns.columns else turns.withColumn("gone", F.lit(False))
    space = F.lit(" ")
    rows = rows.withColumns({"role": F.coalesce("role", space), "text": F.coalesce("text", space)})
    # flags after the text: of equal rows the first is no duplicate
    each = F.struct("turn", "role", "text", F.coalesce("fault", F.lit("")).alias("fault"))
    met = faults_of(rows).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.when(~F.col("gone"), each))).alias("rows"))
    fault = lambda name: F.size(F.filter("rows", lambda x: x["fault"] == name)).cast("long").alias(name)
    numbers = F.filter(F.transform("rows", lambda x: x["turn"]), lambda x: x.isNotNull())
    initials = F.transform("rows", lambda x: F.left(x["role"], F.lit(1)))
    pairs = F.zip_with(initials, F.slice(initials, F.lit(2), F.greatest(F.size("rows"), F.lit(1))), lambda a, b: F.concat(a, b))
    narrow = F.transform(
        "rows",
        lambda x: F.struct(
            F.left(x["role"], F.lit(1)).alias("initial"),
            (~x["fault"].isin("blank", "duplicate")).alias("left"),
            F.when(x["fault"] == "truncated", TRUNCATED).otherwise(0).cast("long").alias("extra"),
        ),
    )
    found = met.select(
        "conv_id", "rows",
        F.coalesce(F.array_max(numbers) - F.array_min(numbers) + 1 - F.size(F.array_distinct(numbers)), F.lit(0)).cast("long").alias("gaps"),
        fault("blank"), fault("duplicate"), fault("truncated"),
        # the last row's pair is null
        F.size(F.filter(pairs, lambda x: x.isNotNull() & ~x.isin(*LEGAL))).cast("long").alias("illegal"),
        cheapest(narrow).alias("best"),
    )
    return found.select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal",
        F.col("best.cost").alias("cost"),
        F.translate("best.edits", "JS", "IR").alias("audit"),
        repaired_turns(F.col("rows"), F.col("best.edits")).alias("turns"),
    )


def op12(turns: DataFrame) -> DataFrame:
    bounded(turns.sparkSession)
    lines = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
    return repaired(damaged(turns)).withColumn("repaired_sha256", F.sha2(lines, 256)).drop("turns")
