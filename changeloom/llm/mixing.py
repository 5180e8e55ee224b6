"""Mixing sources to target weights, in DataFrame functions only.

Targets.  Sources in code point order (null last) take the weights in turn and
share all words of the corpus.  A target stops at ``most`` times its source's
words and the excess is shared again by weight until no target is above: with
sources sorted by limit over weight, a running sum finds the stopped ones.

Quotas.  Documents are dealt by a seeded hash to shards of about ``shard_rows``
documents (larger ones where there would be more than ``MOST_SHARDS``, as the cells
of one source are ranked together).  A source's shards are joined to as many cells as its words fill with
``CELL_BLOCKS`` blocks, one at least: a hot source is a cell for each shard, a small
one a single cell.  Equal blocks of ``block_words`` words are apportioned to sources
by Sainte-Lague (highest quotients target / (2 k + 1)), and each source's blocks to
its cells in the same way, which gives every cell an integer quota.  A cell's own
blocks are of about ``block_words`` words, and it misses its share by a few of them
at most, which is little of ``CELL_BLOCKS``.  Documents without words stay in cells
of their own, one for each shard.  Seats are not enumerated: all but a few of a unit's seats
are certain from its share, and only the quotients for the rest are ranked.

Selection.  In a cell the documents stand in seeded order as one stream of
words, cut into equal blocks.  A quota of whole rounds repeats the cell, the
remainder is a run of consecutive blocks from a seeded start, so at most two
documents of a cell are cut.  No block is taken more than ``most`` times, hence
no document more than ``most`` times its size.

A hot source is many cells; running sums stay inside a cell.  Sums for sources
and cells are aggregated map-side.  Everything follows from column values and
the seed, so reruns agree.

Defined results: a null text has no words; documents without words are taken 0
times; a null source is a source of its own; repeated rows are documents of
their own; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, free_name, quoted, whole_text

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK_WORDS = 16
SHARD_ROWS = 2048
MOST_SHARDS = 1 << 16
CELL_BLOCKS = 1024
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(src, words) with rank, total and target for each source.

    One row for each source; the running sums are over this table only.
    """
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("src").asc_nulls_last())))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight.cast("long")).withColumn("most", F.col("words") * most)
    by_level = Window.orderBy(F.col("most") / F.col("weight"), "rank")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy(F.lit(1))
    ranked = (
        ranked.withColumn("total", F.sum("words").over(all_rows))
        .withColumn("room", F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0)))
        .withColumn("rest", F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("stopped", F.col("most") * F.col("rest") <= F.col("room") * F.col("weight"))
    )
    free = ~F.col("stopped")
    level_room = F.col("total") - F.sum(F.when(F.col("stopped"), F.col("most")).otherwise(0)).over(all_rows)
    level_rest = F.sum(F.when(free, F.col("weight")).otherwise(0)).over(all_rows)
    target = F.when(F.col("stopped"), F.col("most").cast("double")).otherwise(
        level_room.cast("double") * F.col("weight") / F.greatest(level_rest, F.lit(1))
    )
    return ranked.withColumn("target", F.round(target, 6)).select("src", "words", "rank", "total", "target")


def apportioned(units: DataFrame, group: list, votes: str, seats: str, order: list, quota: str) -> DataFrame:
    """``units`` with integer quotas by Sainte-Lague, ``seats`` in each group.

    With U units and a divisor D, rounding moves the sum of votes / D from the
    seats by U / 2 at most, so a unit of share s gets between s (n - U / 2) - 0.5
    and s (n + U / 2) + 0.5 of n seats.  The lower bound is given at once; the
    seats left are won by the highest of the quotients next in line.
    """
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(1))
    v, n = F.col(votes).cast("double"), F.col(seats)
    share = F.when(F.sum(v).over(whole) > 0, v / F.sum(v).over(whole)).otherwise(0.0)
    step = units.withColumn("_share", share).withColumn("_units", F.count("*").over(whole))
    sure = F.floor(F.col("_share") * (n - F.col("_units") / 2) - 0.75).cast("long")
    step = step.withColumn("_sure", F.greatest(sure, F.lit(0).cast("long")))
    step = step.withColumn("_left", n - F.sum("_sure").over(whole))
    width = F.ceil(F.col("_share") * F.col("_units")).cast("long") + 3
    step = step.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), width)))
    step = step.withColumn("_next", v / (2 * (F.col("_sure") + F.col("_k")) + 1))
    place = F.row_number().over(whole.orderBy(F.desc("_next"), *order, "_k"))
    step = step.withColumn("_won", (place <= F.col("_left")).cast("long"))
    return step.groupBy(*units.columns).agg((F.max("_sure") + F.sum("_won")).alias(quota))


def _number(text: Column, below: Column) -> Column:
    """A seeded number from 0 to below - 1."""
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), below)


def planned(
    df: DataFrame,
    size: str,
    id_col: str = "doc_id",
    source_col: str = "source",
    weights=WEIGHTS,
    most: int = MOST,
    block_words: int = BLOCK_WORDS,
    shard_rows: int = SHARD_ROWS,
    cell_blocks: int = CELL_BLOCKS,
    seed: str = SEED,
) -> tuple[DataFrame, str]:
    """``df`` (which has the word counts in ``size``) with a struct column, and that column's name.

    The struct: source_size, target, taken, rounds (whole copies), and the word
    spans [a1, b1), [a2, b2) of the document that are taken once more.
    """
    scratch = Scratch(df.sparkSession, "mixing")
    src, shard, order, plan, end, cell_name = (free_name(df, x) for x in ("_src", "_shard", "_order", "_plan", "_end", "_cell"))
    words = F.col(quoted(size))
    name = F.col(quoted(source_col))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col(quoted(id_col)).cast("string"), words.cast("string")).cast("binary"))
    rows = df.count()
    shards = max(1, min(MOST_SHARDS, -(-rows // shard_rows)))
    keyed = df.withColumn(src, F.when(name.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), name)))
    dealt = F.pmod(F.conv(F.substring(order, 1, 8), 16, 10).cast("long"), F.lit(shards))
    keyed = keyed.withColumn(order, key).withColumn(shard, F.when(words > 0, dealt).otherwise(-1 - dealt))

    sums = scratch.keep(
        keyed.groupBy(F.col(src).alias("key"), F.col(shard).alias("shard"), name.alias("src")).agg(F.sum(words).alias("shard_words")), "sums"
    )
    goal = targets(sums.groupBy("key", "src").agg(F.sum("shard_words").alias("words")).select("src", "words"), weights, most)
    goal = goal.withColumn("seats", F.floor(F.col("total") / block_words + 0.5).cast("long"))
    goal = apportioned(goal, [], "target", "seats", ["rank"], "blocks")
    goal = goal.withColumn("key", F.when(F.col("src").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("src"))))
    parts = F.least(F.lit(shards), F.greatest(F.lit(1), F.floor(F.col("words") / (block_words * cell_blocks)))).cast("long")
    joined = F.when(F.col("shard") >= 0, F.floor(F.col("shard") * parts / shards)).otherwise(F.col("shard")).cast("long")
    members = sums.select("key", "shard", "shard_words").join(goal.drop("src"), "key").withColumn("cell", joined)
    cells = members.groupBy(*goal.drop("src").columns, "cell").agg(F.sum("shard_words").alias("cell_words"))
    cells = apportioned(cells, ["key"], "cell_words", "blocks", ["cell"], "quota")
    n = F.greatest(F.lit(1), F.floor(F.col("cell_words") / block_words + 0.5).cast("long"))
    cells = cells.withColumn("cuts", n).withColumn("rounds", F.least(F.lit(most), F.floor(F.col("quota") / F.col("cuts"))).cast("long"))
    cells = cells.withColumn("run", F.when(F.col("rounds") < most, F.col("quota") - F.col("rounds") * F.col("cuts")).otherwise(0).cast("long"))
    cells = cells.withColumn("from", _number(F.concat_ws(":", F.lit(seed), "key", F.col("cell").cast("string")).cast("binary"), F.col("cuts")))

    def word(block: Column) -> Column:
        """The first word of a block."""
        return F.floor(block * F.col("cell_words") / F.col("cuts")).cast("long")

    stop = F.col("from") + F.col("run")
    cells = cells.select(
        "key",
        "cell",
        F.struct(
            F.col("words").alias("source_size"),
            "target",
            "rounds",
            word(F.col("from")).alias("x1"),
            word(F.least(stop, F.col("cuts"))).alias("y1"),
            word(F.greatest(stop - F.col("cuts"), F.lit(0))).alias("y2"),
        ).alias(plan),
    )
    cells = members.join(cells, ["key", "cell"]).select(F.col("key").alias(src), F.col("shard").alias(shard), F.col("cell").alias(cell_name), plan)
    cells = scratch.keep(cells, "cells")
    stream = Window.partitionBy(src, cell_name).orderBy(order, F.col(quoted(id_col)), words)
    placed = keyed.join(cells, [src, shard], "left").withColumn(end, F.sum(words).over(stream.rowsBetween(Window.unboundedPreceding, 0)))
    first, cell = F.col(end) - words, F.col(plan)

    def within(x: Column) -> Column:
        return F.least(F.greatest(x - first, F.lit(0)), words).cast("long")

    a1, b1, b2 = within(cell["x1"]), within(cell["y1"]), within(cell["y2"])
    zero = F.lit(0).cast("long")
    again = F.greatest(b1 - a1, zero) + b2
    out = F.struct(
        cell["source_size"].alias("source_size"),
        cell["target"].alias("target"),
        (cell["rounds"] * words + again).cast("long").alias("taken"),
        cell["rounds"].alias("rounds"),
        a1.alias("a1"),
        F.greatest(b1, a1).alias("b1"),
        zero.alias("a2"),
        b2.alias("b2"),
    )
    return placed.withColumn(plan, out).select(*[quoted(c) for c in df.columns], plan), plan


def mixed(df: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The mix itself: rows of ``df``, repeated and cut as planned, with their columns.

    A whole copy keeps its text as it is; a cut copy keeps the white space
    between its words.
    """
    size, span, part = (free_name(df, x) for x in ("_size", "_span", "_part"))
    out, plan = planned(df.withColumn(size, word_count(whole_text(text_col))), size, **options)
    p = F.col(plan)
    whole = F.struct(F.lit(0).cast("long").alias("a"), F.col(size).alias("b"))
    spans = F.concat(
        F.array_repeat(whole, p["rounds"].cast("int")),
        F.filter(F.array(F.struct(p["a1"].alias("a"), p["b1"].alias("b")), F.struct(p["a2"].alias("a"), p["b2"].alias("b"))), lambda x: x["b"] > x["a"]),
    )
    out = out.where(F.col(size) > 0).withColumn(span, F.explode(spans))
    s = F.col(span)
    pieces = F.regexp_extract_all(F.col(quoted(text_col)), F.lit(r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]*)"), F.lit(1))
    cut = F.array_join(F.slice(pieces, s["a"].cast("int") + 1, (s["b"] - s["a"]).cast("int")), "")
    is_whole = (s["a"] == 0) & (s["b"] == F.col(size))
    out = out.withColumn(part, F.when(is_whole, F.col(quoted(text_col))).otherwise(cut)).withColumn(text_col, F.col(part))
    return out.select(*[quoted(c) for c in df.columns])
