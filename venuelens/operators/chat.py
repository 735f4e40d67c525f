"""Message-table jobs: authorisation, routing, history, pipe tables and paging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from venuelens.functions.text import each, strip
from venuelens.operators.skew import numbered, top_k

# Whole-message phrases, case ignored, closing marks allowed.
GREETINGS = ("hello", "hi", "howdy", "hey")
FAQ = {
    "how_are_you": ("how are you", "how's it going"),
    "help": ("help", "how can you help", "how can you help me", "what can you do", "what can you do for me"),
    "thanks": ("thank you", "thanks"),
}
DOWN, UP = "👎", "👍"
HISTORY = 7
BLOCK = 10_000  # turns per block of one user


def chat_authorised(msgs: DataFrame, users: DataFrame) -> DataFrame:
    return msgs.join(users.select("user"), "user", "left_semi")


def chat_refused(msgs: DataFrame, users: DataFrame, reply: str = "You have no access to this data.") -> DataFrame:
    """Messages of unknown users, with the reply they get."""
    return (msgs.filter(F.col("role") == "user").join(users.select("user"), "user", "left_anti")
            .withColumn("reply", F.lit(reply)))


def _phrase(text: Column, phrases: Sequence[str]) -> Column:
    return text.rlike(r"(?iu)^(" + "|".join(phrases) + r")[!?.,]*$")


def faq_intent(text: Column, assistant_names: Sequence[str] = ()) -> Column:
    greetings = [*GREETINGS, *[f"{g} {n}" for n in assistant_names for g in ("hello", "hey")]]
    out = F.when(_phrase(text, greetings), "greeting")
    for name, phrases in FAQ.items():
        out = out.when(_phrase(text, phrases), name)
    return out


# what a message is worth for the history, as far as its block knows; the last two wait for earlier blocks
_NO, _YES, _UNLESS_DOWN, _IF_ASKED = 0, 1, 2, 3


def conversation(msgs: DataFrame, n: int = 0, block: int = BLOCK, assistant_names: Sequence[str] = ()) -> DataFrame:
    """Every message with its state: user, turn, role, text (a user's without white space at its ends), faq, was_down
    (the user's last message before it that is no small talk is a thumbs-down), kept (a history may hold it) and,
    for ``n`` above 0, lines (the last ``n`` kept messages up to a kept one).

    A segmented scan. A block of ``block`` turns is read by itself first; what it cannot know without the blocks before
    it are the feedback flag and the question flag it starts with, so each message gets a code, and each block one
    state: the flags it ends with and the last lines of every code. Running the states of a user's blocks in order
    gives every block its two flags and the lines before it; one join hands them to the messages. No task holds
    more than a block, or one row per block of a user.

    Kept are users' questions and the answers to them, not small talk, thumbs, their details, and answers to these or
    to nothing. Where ``msgs`` has a column ``asked``, its values say whether a user message was a question; where it
    has ``held``, true says that a message is kept. Null text of a user changes no state."""
    known = lambda name: F.col(name) if name in msgs.columns else F.lit(None).cast("boolean")
    own = F.col("role") == "user"
    text = F.when(own, strip(F.col("text"))).otherwise(F.col("text"))
    rows = (msgs.select("user", "turn", "role", text.alias("text"), known("asked").alias("asked"), known("held").alias("held"),
                        F.floor(F.col("turn") / F.lit(block)).alias("_block"))
            .withColumn("faq", F.when(own, faq_intent(F.col("text"), assistant_names))))
    inside = Window.partitionBy("user", "_block").orderBy("turn", F.col("role").desc())
    down = F.when(own & F.col("faq").isNull(), F.col("text") == DOWN)
    rows = rows.withColumn("_down", down).withColumn(
        "_before", F.last("_down", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    plain = F.col("faq").isNull() & ~F.coalesce(F.col("text").isin(DOWN, UP), F.lit(False))
    asks = (F.when(F.col("asked").isNotNull(), F.when(F.col("asked"), _YES).otherwise(_NO))
            .when(~plain, _NO).when(F.col("_before").isNull(), _UNLESS_DOWN).when(F.col("_before"), _NO).otherwise(_YES))
    rows = rows.withColumn("_asks", F.when(own, asks))
    so_far = F.last("_asks", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    worth = F.when(F.coalesce("held", F.lit(False)), _YES).otherwise(F.coalesce(so_far, F.lit(_IF_ASKED)))
    rows = rows.withColumn("_worth", worth).drop("asked", "held")
    line = F.concat(F.when(own, "User: ").otherwise("AI: "), F.coalesce("text", F.lit("")))
    if n:
        rows = rows.withColumn("_line", F.struct("turn", (~own).alias("late"), line.alias("line")))

    states = _block_states(rows, n)
    same = rows["user"].eqNullSafe(states["_user"]) & rows["_block"].eqNullSafe(states["_of"])
    out = rows.join(states, same).drop("_user", "_of")
    out = (out.withColumn("was_down", F.coalesce("_before", "_starts_down"))
           .withColumn("kept", _is_kept(F.col("_worth"))))
    columns = ["user", "turn", "role", "text", "faq", "was_down", "kept"]
    if n:
        frame = (Window.partitionBy("user", "_block", "kept").orderBy("turn", F.col("role").desc()).rowsBetween(-(n - 1), Window.currentRow))
        lines = F.concat(F.transform("_earlier", lambda x: x["line"]), F.collect_list("_line.line").over(frame))
        out = out.withColumn("lines", F.when(F.col("kept"), _last(lines, n)))
        columns.append("lines")
    return out.select(*columns)


def _is_kept(worth: Column) -> Column:
    return ((worth == _YES) | ((worth == _UNLESS_DOWN) & ~F.col("_starts_down")) | ((worth == _IF_ASKED) & F.col("_starts_asked")))


def _last(array: Column, n: int) -> Column:
    return F.when(F.size(array) > n, F.slice(array, -n, n)).otherwise(array) if n else F.slice(array, 1, 0)


def _block_states(rows: DataFrame, n: int) -> DataFrame:
    """One row per block: _user, _of (the block), _starts_down, _starts_asked and, for ``n``, _earlier (the ``n - 1`` kept
    lines before it)."""
    latest = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("turn", F.col(c).alias("v"))))["v"]
    ends = [latest("_down").alias("_down"), latest("_asks").alias("_asks")]
    if n > 1:
        back = Window.partitionBy("user", "_block", "_worth").orderBy(F.col("turn").desc(), "role")
        rows = rows.withColumn("_rank", F.row_number().over(back))
        near = F.when((F.col("_rank") < n) & (F.col("_worth") != _NO), F.struct("_line", "_worth"))
        ends.append(F.collect_list(near).alias("_tail"))
    blocks = rows.groupBy("user", "_block").agg(*ends)
    order = Window.partitionBy("user").orderBy("_block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    running = lambda c: F.coalesce(F.last(c, ignorenulls=True).over(before), F.lit(False))
    blocks = blocks.withColumn("_starts_down", running(F.col("_down")))
    asked = F.when(F.col("_asks") == _UNLESS_DOWN, ~F.col("_starts_down")).otherwise(F.col("_asks") == _YES)
    blocks = blocks.withColumn("_ends_asked", asked).withColumn("_starts_asked", running(F.col("_ends_asked")))
    out = [F.col("user").alias("_user"), F.col("_block").alias("_of"), "_starts_down", "_starts_asked"]
    if n > 1:
        kept = F.transform(F.filter("_tail", lambda x: _is_kept(x["_worth"])), lambda x: x["_line"])
        blocks = blocks.withColumn("_tail", _last(F.array_sort(kept), n - 1))
        blocks = blocks.withColumn("_no", F.coalesce(F.sum(F.size("_tail")).over(before), F.lit(0)))
        # the blocks that can hold the n - 1 lines before this one: by the running number of lines, empty ones left out
        reach = Window.partitionBy("user").orderBy("_no").rangeBetween(-2 * (n - 1), Window.currentRow)
        held = F.when(F.size("_tail") > 0, F.struct("_block", "_tail"))
        blocks = blocks.withColumn("_near", F.collect_list(held).over(reach))
        earlier = F.array_sort(F.filter("_near", lambda x: x["_block"] < F.col("_block")))
        out.append(_last(F.flatten(F.transform(earlier, lambda x: x["_tail"])), n - 1).alias("_earlier"))
    elif n:
        out.append(F.array().cast("array<struct<turn:long,late:boolean,line:string>>").alias("_earlier"))
    return blocks.select(*out)


def intent() -> Column:
    """Of a user message of ``conversation``."""
    return (F.when(F.col("faq").isNotNull(), F.col("faq")).when(F.col("text") == DOWN, "feedback_down")
            .when(F.col("was_down"), "feedback_detail").when(F.col("text") == UP, "feedback_up").otherwise("question"))


def chat_routing(msgs: DataFrame, assistant_names: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """Intent of each user message. Small talk leaves the feedback state alone; over the other
    messages, the one right after a thumbs-down is its detail, unless it is a thumbs-down again."""
    said = conversation(msgs.filter(F.col("role") == "user"), 0, block, assistant_names)
    return said.select("user", "turn", "text", intent().alias("intent"))


def chat_intent_counts(routed: DataFrame, by: Sequence[str] = ("user",)) -> DataFrame:
    """Counts per intent; ``by`` may name a day column where messages carry one."""
    return routed.groupBy(*by, "intent").agg(F.count(F.lit(1)).alias("message_count"))


def _talk(msgs: DataFrame) -> DataFrame:
    return msgs.filter(F.col("role").isin("user", "assistant"))


def retained(msgs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The messages that a history may hold: the users' questions and the answers to them (``conversation``)."""
    return conversation(_talk(msgs), 0, block).filter("kept").select("user", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))


def chat_history(msgs: DataFrame, n: int = HISTORY, block: int = BLOCK) -> DataFrame:
    """Per retained message, the last ``n`` of them up to and with it as one text."""
    return conversation(_talk(msgs), n, block).filter("kept").select(
        "user", "turn", F.size("lines").alias("messages"), F.array_join("lines", "\n").alias("history"))


def chat_latest_user(msgs: DataFrame, n: int = HISTORY, block: int = BLOCK) -> DataFrame:
    """Each user's newest question among the last ``n`` retained messages, empty when there is none."""
    last = top_k(retained(msgs, block), ["user"], [F.col("turn").desc()], n)
    newest = last.filter(F.col("role") == "user").groupBy("user").agg(F.max(F.struct("turn", "text"))["text"].alias("latest_message"))
    return msgs.select("user").distinct().join(newest, "user", "left").select(
        "user", F.coalesce("latest_message", F.lit("")).alias("latest_message"))


def message_descriptions(msgs: DataFrame) -> DataFrame:
    """The text before the first table mark."""
    return msgs.select("user", "turn", strip(F.split("text", "##", -1)[0]).alias("description"))


def message_tables(msgs: DataFrame, strict: bool = True) -> DataFrame:
    """Cells of the pipe tables between ``##`` marks: every second part of a message is a table when it
    has a line of dashes and pipes; the line above it is the heading. ``strict`` keeps blank
    cells, so that values stay under their headings. Otherwise blank cells are left out, values move
    left, and a table is used only when its longest row is as long as its heading."""
    def cells(row: Column) -> Column:
        if strict:
            inner = F.regexp_replace(strip(row), r"^\||\|$", "")
            return F.transform(F.split(inner, r"\|", -1), strip)
        return F.filter(F.transform(F.split(row, r"\|", -1), strip), lambda c: c != "")

    parts = each(msgs.filter(F.col("text").contains("##")), F.split("text", "##", -1), "body", "part")
    lines = parts.filter(F.col("part") % 2 == 1).select(
        "user", "turn", F.floor(F.col("part") / 2).cast("int").alias("table_no"),
        F.split(strip(F.col("body")), "\n", -1).alias("lines"))
    is_rule = lambda x: strip(x).rlike(r"^[-|]*(-\||\|-)[-|]*$")
    ruled = lines.withColumn("rule", F.array_position(F.transform("lines", is_rule), True)).filter(F.col("rule") > 0)
    # a table that opens with its rule takes its last line as the heading
    head = F.element_at("lines", F.when(F.col("rule") == 1, -1).otherwise((F.col("rule") - 1).cast("int")))
    data = F.filter(F.slice("lines", (F.col("rule") + 1).cast("int"), F.size("lines")), lambda x: strip(x) != "")
    tables = ruled.select("user", "turn", "table_no", cells(head).alias("headings"),
                          F.transform(data, cells).alias("rows")).filter(F.size("rows") > 0)
    if not strict:
        tables = tables.filter(F.array_max(F.transform("rows", F.size)) == F.size("headings"))
    rows = each(tables, F.col("rows"), "cells", "row_no")
    return each(rows, F.col("cells"), "value", "column_no").select(
        "user", "turn", "table_no", "row_no", "column_no",
        F.get("headings", F.col("column_no")).alias("column_name"), "value")


def result_pages(df: DataFrame, order: Sequence[str], size: int = 30) -> DataFrame:
    """All rows with a page number, ``size`` rows to a page in a unique ``order``."""
    rows = numbered(df, order)
    return rows.withColumn("page", F.floor((F.col("row_no") - 1) / size))
