"""Operator 7: chat formatting by quotation linking, in DataFrame functions alone.

Lines that start with `>` marks (spaces between them allowed) are quotes of as many levels as marks. Consecutive lines of one level
form a passage. Normalised (lower case, runs of anything but letters and digits as one space) passages and their lines are hashed.
The first message that says a hashed passage or line itself, outside quotes, is its original; a quote is linked to the original in
its own conversation if there is one that is earlier, else to an earlier conversation's. A message replies to the original of the
most quoted characters at level 1 (ties: the latest, then by conversation), or else to the message before it. Conversations whose
first message quotes another one join it. In a thread, messages are ordered by conversation and turn, so replies follow originals.

Results: null texts count as empty; messages without quotes keep their text as it is; repeated rows are messages of their own, in the
order of the table; passages without letters or digits link nothing. Messages without a turn come first in their conversation and
follow each other; they are nobody's original, and their quotes are linked to earlier conversations only. Messages without a
conversation are together in one, without a thread's id, and neither link nor are linked. Each message comes behind the one it
replies to in its thread. Other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.shared import shared_folder, written

#: Turns of one conversation that are numbered together, so that a long conversation has many tasks.
STRETCH = 512
_MARKS = r"^\s*(>(?:\s?>)*)"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", " "))


def quote_level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 1), "\\s", ""))


def passages(messages: DataFrame) -> DataFrame:
    """_row, conv_id, turn, level, first (line number), passage, lines (array) of messages that have quotes somewhere.

    Only lines of one message meet, by its row number."""
    lines = messages.select("_row", "conv_id", "turn", F.posexplode(F.split("text", "\r?\n")).alias("at", "line"))
    lines = lines.withColumn("level", quote_level(F.col("line"))).withColumn("line", F.regexp_replace("line", r"^\s*>(?:\s?>)*\s?", ""))
    order = Window.partitionBy("_row").orderBy("at")
    starts = F.coalesce((F.col("level") != F.lag("level").over(order)).cast("int"), F.lit(1))
    runs = lines.withColumn("starts", starts).withColumn("run", F.sum("starts").over(order))
    kept = runs.groupBy("_row", "conv_id", "turn", "level", "run").agg(F.min("at").alias("first"), F.array_sort(F.collect_list(F.struct("at", "line"))).alias("own"))
    texts = F.transform("own", lambda x: x["line"])
    return kept.select("_row", "conv_id", "turn", "level", "first", F.array_join(texts, "\n").alias("passage"), texts.alias("lines"))


def _hashes(df: DataFrame, *more: Column) -> DataFrame:
    """A row for each hashed unit: the passage (whole) and each of its lines."""
    units = F.concat(F.array(F.col("passage")), F.when(F.size("lines") > 1, F.col("lines")).otherwise(F.expr("cast(array() as array<string>)")))
    out = df.select("_row", "conv_id", "turn", *more, F.posexplode(units).alias("unit", "said")).withColumn("said", normalised(F.col("said"))).where("said <> ''")
    return out.select("_row", "conv_id", "turn", *[c for c in out.columns if c in ("level",)], F.length("said").alias("size"), F.xxhash64("said", F.length("said")).alias("hash"))


def _numbered(df: DataFrame, group: str, name: str) -> DataFrame:
    """Numbers from 0 within a group by (conv_id, turn, _row); stretches of turns are numbered apart and then put together."""
    stretched = df.withColumn("_stretch", F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / STRETCH))
    sizes = stretched.groupBy(group, "conv_id", "_stretch").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("conv_id", "_stretch").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select(F.col(group).alias("_g"), F.col("conv_id").alias("_c"), F.col("_stretch").alias("_s"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    place = F.row_number().over(Window.partitionBy(group, "conv_id", "_stretch").orderBy(F.col("turn").asc_nulls_first(), "_row")) - 1
    own = stretched.withColumn("_place", place)
    joined = own.join(firsts, own[group].eqNullSafe(F.col("_g")) & own["conv_id"].eqNullSafe(F.col("_c")) & (F.col("_stretch") == F.col("_s")))
    return joined.withColumn(name, (F.col("_first") + F.col("_place")).cast("long")).drop("_g", "_c", "_s", "_stretch", "_first", "_place")


def conversations_without_quotes(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, thread_id, reply_pos (from 0), parent_conv, parent_turn, linked (by a quote), quote_levels, text."""
    folder = shared_folder(conversations.sparkSession)
    rows = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).withColumn("_row", F.monotonically_increasing_id())
    rows = written(rows.withColumn("_quotes", F.col("text").rlike("(?m)^\\s*>")), folder, "messages")
    parted = written(passages(rows.where("_quotes")), folder, "passages")
    quotes = written(_hashes(parted.where("level > 0"), F.col("level")), folder, "quotes")
    plain = rows.where("not _quotes").select("_row", "conv_id", "turn", F.col("text").alias("passage"), F.split("text", "\r?\n").alias("lines"))
    said = _hashes(plain.unionByName(parted.where("level = 0").select("_row", "conv_id", "turn", "passage", "lines")))
    # only hashes that somebody quotes; the first to say it is the original, so each hash has one row a conversation
    asked = quotes.select("hash").distinct()
    place = F.struct("conv_id", "turn", "_row")
    said = said.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    said = written(said.join(asked, "hash", "left_semi").groupBy("hash", "conv_id").agg(F.min(F.struct("turn", "_row")).alias("first")), folder, "said")
    everywhere = said.groupBy("hash").agg(F.min(F.struct("conv_id", "first.turn", "first._row")).alias("any"))
    here = said.select("hash", "conv_id", F.col("first.turn").alias("own_turn"))
    found = quotes.join(here, ["hash", "conv_id"], "left").join(everywhere, "hash", "left")
    own = F.col("own_turn") < F.col("turn")
    away = F.col("any.conv_id") < F.col("conv_id")
    found = found.select(
        "_row", "level", "size",
        F.when(own, F.col("conv_id")).when(away, F.col("any.conv_id")).alias("parent_conv"),
        F.when(own, F.col("own_turn")).when(away, F.col("any.turn")).alias("parent_turn"),
    ).where("parent_turn is not null")
    votes = found.where("level = 1").groupBy("_row", "parent_conv", "parent_turn").agg(F.sum("size").alias("size"))
    best = votes.groupBy("_row").agg(F.max(F.struct("size", "parent_turn", "parent_conv")).alias("best")).select("_row", F.col("best.parent_conv").alias("quoted_conv"), F.col("best.parent_turn").alias("quoted_turn"))
    best = written(best, folder, "best")
    bare = parted.where("level = 0").groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("first", "passage"))).alias("own"))
    levels = parted.groupBy("_row").agg(F.max("level").alias("levels"))
    clean = levels.join(bare, "_row", "left").select("_row", "levels", F.regexp_replace(F.array_join(F.transform("own", lambda x: x["passage"]), "\n"), "^\\s+|\\s+$", "").alias("clean"))
    out = _with_previous(rows).join(best, "_row", "left").join(clean, "_row", "left")
    linked = F.col("quoted_turn").isNotNull()
    out = out.select(
        "_row", "conv_id", "turn", "role", F.when(linked, F.col("quoted_conv")).when(F.col("before").isNotNull(), F.col("conv_id")).alias("parent_conv"),
        F.when(linked, F.col("quoted_turn")).otherwise(F.col("before.turn")).alias("parent_turn"), linked.alias("linked"), F.coalesce("levels", F.lit(0)).cast("int").alias("quote_levels"),
        F.when(F.col("_quotes"), F.coalesce("clean", F.lit(""))).otherwise(F.col("text")).alias("text"), F.col("before").isNull().alias("opens"),
    )
    out = written(out, folder, "replies")
    joins = out.where("opens and parent_conv <> conv_id").groupBy("conv_id").agg(F.min("parent_conv").alias("into"))
    threads = _roots(joins, folder)
    named = out.join(threads, "conv_id", "left").withColumn("thread_id", F.coalesce("root", "conv_id")).drop("root", "opens")
    return _numbered(named, "thread_id", "reply_pos").select("conv_id", "turn", "role", "thread_id", "reply_pos", "parent_conv", "parent_turn", "linked", "quote_levels", "text")


def _with_previous(rows: DataFrame) -> DataFrame:
    """`before` (turn, _row): the message before in the conversation, NULL for the first one; stretches of turns look to the last message
    of the one before."""
    place = F.struct("turn", "_row")
    own = rows.withColumn("_stretch", F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / STRETCH))
    lasts = own.groupBy("conv_id", "_stretch").agg(F.max(place).alias("_last"))
    lasts = lasts.select(F.col("conv_id").alias("_c"), F.col("_stretch").alias("_s"), F.lag("_last").over(Window.partitionBy("conv_id").orderBy("_stretch")).alias("_earlier"))
    own = own.withColumn("_lag", F.lag(place).over(Window.partitionBy("conv_id", "_stretch").orderBy(F.col("turn").asc_nulls_first(), "_row")))
    joined = own.join(lasts, own["conv_id"].eqNullSafe(F.col("_c")) & (F.col("_stretch") == F.col("_s")), "left")
    return joined.withColumn("before", F.coalesce("_lag", "_earlier")).drop("_stretch", "_c", "_s", "_lag", "_earlier")


def _roots(joins: DataFrame, folder: str) -> DataFrame:
    """conv_id, root: where chains of (conv_id, into) end; into is always smaller, so pointer jumping ends."""
    links = written(joins.select("conv_id", F.col("into").alias("root")), folder, "threads-0")
    for k in range(1, 64):
        further = links.select(F.col("conv_id").alias("root"), F.col("root").alias("next"))
        jumped = written(links.join(further, "root", "left").select("conv_id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), folder, f"threads-{k}")
        links = jumped.select("conv_id", "root")
        if jumped.where("moved").isEmpty():
            break
    return links
