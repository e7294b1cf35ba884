"""Conversation structure repair: the cheapest edits that make the roles of a conversation alternate.

A repaired conversation has the role initials (s?(ua)+)? : nothing, or an optional system turn and then pairs of user
and assistant. Edits are Keep (0), Rerole to user or assistant (2), Delete (3) and Insert an empty user or assistant turn
(2); a truncated turn that stays adds 1, blank and duplicate turns must go. Of the cheapest edits the audit, their
initials in order, is the least by ASCII.

Everything is Spark SQL. Windows over a conversation give each turn its fault, role initial and neighbour; its turns
are collected as sorted structs; aggregate() folds them with one (cost, audit) struct for each of the four states of the
wanted pattern: nothing yet, after the system turn, after a user turn, after an assistant turn. A step takes the least()
struct of the moves that lead to a state, which orders by cost and then by audit. Two audits of equal cost that lead to the
same state after the same turns differ at some place before either ends (the longer one would have paid for
its inserts), so that the lesser stays the lesser whatever follows, and the fold is exact.

Inside the fold an audit has two more letters: J for an inserted assistant turn and S for a turn made the assistant's (I and R
are the user's). They stand next to I and R in ASCII, and what a letter can mean follows from those before it, so
the order is that of the audit; each turn's part of the audit then says by itself what becomes of it.

One shuffle, by conversation; sorts spill. A conversation is gathered as one row, as its audit and the digest of its
repaired text need; the fold copies audits, so its work grows with the square of a conversation's turns (a few bytes each).

Nulls and edges: a null conv_id is a conversation of its own. A null role, text, or part of the key `conv_id:turn` counts as one space,
so a null text is blank and a null role must be changed or go, as must a role of no characters. Null turns come first;
turns of one number go by role, then text. An empty table gives an empty one. Repeated rows are duplicates. Other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: More than any conversation's edits cost: a state that no edits reach.
NEVER = 1 << 50
SPACES = "\\x20\\x09-\\x0D"


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults put in by crc32(`conv_id:turn`) mod 20, and place 0 (1 for a repeated row's second)."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.where("kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("place"))


def flagged(turns: DataFrame) -> DataFrame:
    """Turns with initial, fault (blank, duplicate, truncated or null) and whether the pair with the turn before is illegal."""
    order = [F.col("turn").asc_nulls_first(), "role", "text", "place"]
    talk = Window.partitionBy("conv_id")
    initial = F.substring("role", 1, 1)
    pair = F.concat(F.lag(initial).over(talk.orderBy(*order)), initial)
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first(), "place")) > 1
    last = F.regexp_extract("text", f"([^{SPACES}])[{SPACES}]*\\z", 1)
    fault = F.when(last == "", "blank").when(again, "duplicate").when(~last.isin(".", "!", "?"), "truncated")
    return turns.select("*", initial.alias("initial"), fault.alias("fault"), (~pair.isin("su", "ua", "au")).alias("illegal"))


def _state(cost: Column, audit: Column) -> Column:
    return F.struct(cost.cast("long").alias("cost"), audit.alias("audit"))


def _then(state: Column, cost: Column | int, letter: str) -> Column:
    return _state(state["cost"] + cost, F.concat(state["audit"], F.lit(letter)))


def _closed(none: Column, system: Column, user: Column, assistant: Column) -> Column:
    """The four states after the inserts that can pay: at most two from a state reach every other one."""
    user = F.least(user, *[_then(x, 2, "I") for x in (none, system, assistant)])
    return F.struct(none.alias("none"), system.alias("system"), user.alias("user"), F.least(assistant, _then(user, 2, "J")).alias("assistant"))


def _step(at: Column, turn: Column) -> Column:
    """One turn deleted, kept or made another role's."""
    stays = turn["fault"].isNull() | (turn["fault"] == "truncated")
    extra = F.when(turn["fault"] == "truncated", 1).otherwise(0)

    def moved(source: Column, role: str, changed: str) -> Column:
        other = _then(source, extra + 2, changed) if changed else F.lit(None)
        return F.when(stays & (turn["initial"] == role), _then(source, extra, "K")).when(stays, other)  # null if neither: least() passes it over

    gone = {x: _then(at[x], 3, "D") for x in ("none", "system", "user", "assistant")}
    before_user = F.least(at["none"], at["system"], at["assistant"])
    return _closed(gone["none"], F.least(gone["system"], moved(at["none"], "s", "")), F.least(gone["user"], moved(before_user, "u", "R")), F.least(gone["assistant"], moved(at["user"], "a", "S")))


def cheapest(turns: Column) -> Column:
    """(cost, audit) of an array of structs (initial, fault), with the letters of the fold."""
    never = _state(F.lit(NEVER), F.lit(""))
    start = _closed(_state(F.lit(0), F.lit("")), never, never, never)
    return F.aggregate(turns, start, _step, lambda at: F.least(at["none"], at["assistant"]))


def _lines(turn: Column, part: Column) -> Column:
    """What a turn's part of the audit leaves: lines of the inserted turns, then the turn's own."""
    inserted = F.transform(F.filter(F.split(part, ""), lambda c: c.isin("I", "J")), lambda c: F.when(c == "I", "user:").otherwise("assistant:"))
    role = {"K": turn["role"], "R": F.lit("user"), "S": F.lit("assistant")}
    own = F.coalesce(*[F.when(F.right(part, F.lit(1)) == x, F.array(F.concat(r, F.lit(":"), turn["text"]))) for x, r in role.items()], F.array().cast("array<string>"))
    return F.concat(inserted, own)


def repaired(turns: DataFrame) -> DataFrame:
    """Conversations as they are, after repair: conv_id, turns (as they came), cost, audit, text (`role:text` lines)."""
    row = F.struct("turn", "role", "text", "place", "initial", "fault", "illegal")
    talks = flagged(turns).groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("turns"))
    talks = talks.withColumn("best", cheapest(F.transform("turns", lambda t: F.struct(t["initial"].alias("initial"), t["fault"].alias("fault")))))
    # one part of the audit a turn: what is inserted before it and its own letter; what is inserted behind all comes last
    parts = F.regexp_extract_all("best.audit", F.lit("([IJ]*[KRSD])"), 1)
    tail = F.array(F.regexp_extract("best.audit", "([IJ]*)\\z", 1))
    lines = F.flatten(F.zip_with(F.concat("turns", F.array(F.lit(None))), F.concat(parts, tail), _lines))
    return talks.select("conv_id", "turns", F.col("best.cost").alias("cost"), F.translate("best.audit", "JS", "IR").alias("audit"), F.array_join(lines, "\n").alias("text"))


def _has(fault: str):
    return lambda turn: turn["fault"] == fault


def repair(turns: DataFrame) -> DataFrame:
    """One row for each conv_id of turns (conv_id, turn, role, text), which are damaged first: gaps, blank, duplicate,
    truncated, illegal, cost, audit, repaired_sha256."""
    turns = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    number = F.array_compact(F.transform("turns", lambda t: t["turn"]))
    gaps = F.coalesce(F.array_max(number) - F.array_min(number) + 1 - F.size(F.array_distinct(number)), F.lit(0))
    illegal = F.size(F.filter("turns", lambda t: t["illegal"])).cast("long")
    faults = [F.size(F.filter("turns", _has(x))).cast("long").alias(x) for x in ("blank", "duplicate", "truncated")]
    whole = repaired(damaged(turns)).select("conv_id", gaps.cast("long").alias("gaps"), *faults, illegal.alias("illegal"), "cost", "audit", F.sha2("text", 256).alias("repaired_sha256"))
    zero = {**dict.fromkeys(["gaps", "blank", "duplicate", "truncated", "illegal", "cost"], F.lit(0).cast("long")), "audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)}
    # conversations that the damage has emptied: joined by a key without nulls
    known = turns.select("conv_id").distinct().withColumnRenamed("conv_id", "known")
    joined = known.join(whole, F.col("known").eqNullSafe(F.col("conv_id")), "left")
    return joined.select(F.col("known").alias("conv_id"), *[F.coalesce(c, v).alias(c) for c, v in zero.items()])
