"""Mixing sources to target weights by a low-discrepancy schedule; DataFrame operations only.

Slot ``i`` of the schedule lies at the golden-ratio point ``frac(i * phi)``; the cumulative target shares map
that point to a source, and the slot's rank within its source names the equal-sized block of words it takes.
Blocks are cut from the source's documents in a shuffled order (by MD5 of the id), repeated end to end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_side, stash, word_count

#: Weights by the sources' order, repeating; epochs a source may give; slots of a schedule, whatever its size;
#: documents of a shuffle bucket.
WEIGHTS, MAX_EPOCHS, SLOTS, BUCKET_DOCS = (5, 2, 1), 3, 1 << 20, 50_000
GOLDEN = 0.6180339887498949
#: Cells of the unit interval by which points meet shares; rows up to which the table of sources is broadcast.
GRID, SMALL_ROWS = 1024, 20_000
#: Blocks below which a source's target is taken to the word, as slots alone would miss it or overshoot.
NEAR_BLOCKS = 256
#: Blocks of a piece, by which slots meet documents.
PIECE_BLOCKS = 4
#: Shuffle buckets of a source at least, so that a source with a third of all rows is spread.
MIN_BUCKETS = 256


def sizes(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, source, size)``: words per document, 0 for null text; with ``keep``, a number ``__row`` and those columns too."""
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *([F.monotonically_increasing_id().alias("__row"), *keep] if keep else []))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Per source: ``source, source_size, weight, target, cap`` and the share interval ``[lo, hi)`` of the targets.

    Sources in code point order, null last, weigh ``weights`` in turn and share the sum of all sizes.  A target
    stops at ``max_epochs`` times its source's size and the excess is shared anew by weight: the fixed point is
    ``min(cap, level * weight)``, where the level follows from the sources sorted by ``cap / weight``.
    Only this table, a row per source, is sorted in one task.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("long")
    per = per.withColumn("place", F.row_number().over(order)).withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_epochs)
    rising = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before, total = rising.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    per = (
        per.withColumn("total", F.sum("source_size").over(total))
        .withColumn("rest", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("rest_weight", F.sum("weight").over(total) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", F.col("rest") / F.col("rest_weight"))
        .withColumn("free", F.col("level") * F.col("weight") <= F.col("cap"))
    )
    level = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("weight"), "place", "level"))).over(total)["level"]
    per = per.withColumn("line", level)
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("line") * F.col("weight"), F.col("cap").cast("double")))
    per = per.withColumn("target", target)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    per = per.withColumn("run_to", F.sum("target").over(upto)).withColumn("run_all", F.max("run_to").over(total))
    share = F.when(F.col("run_to") < F.col("run_all"), F.col("run_to") / F.col("run_all")).otherwise(F.lit(1.0))
    per = per.withColumn("hi", share).withColumn("lo", F.coalesce(F.lag("hi").over(order), F.lit(0.0)))
    return per.select("source", "source_size", "weight", "target", "cap", "lo", "hi", "place", "total")


def block_size(goals: DataFrame, slots: int = SLOTS) -> tuple[int, int]:
    """Words of a block, and how many blocks cover the total: about ``slots``, fewer if there are fewer words."""
    total = goals.agg(F.max("total")).first()[0] or 0
    block = max(1, -(-total // slots))
    return block, -(-total // block)


def _slots(spark, goals: DataFrame, count: int) -> DataFrame:
    """``slot, place``: the source that each golden-ratio point falls to, met through a grid of cells."""
    point = F.col("slot") * F.lit(GOLDEN)
    points = spark.range(count).select(F.col("id").alias("slot")).withColumn("point", point - F.floor(point))
    cells = F.explode(F.sequence(F.floor(F.col("lo") * GRID), F.least(F.floor(F.col("hi") * GRID), F.lit(GRID - 1))))
    shares = small_side(goals.filter("hi > lo").select("place", "lo", "hi", cells.alias("cell")), SMALL_ROWS)
    placed = points.withColumn("cell", F.floor(F.col("point") * GRID)).join(shares, "cell")
    return placed.filter("point >= lo and point < hi").select("slot", "place")


def schedule(spark, goals: DataFrame, count: int) -> DataFrame:
    """``slot, place, rank``: which block (``rank``, from 0) of which source each of ``count`` slots takes.

    The ranks of a source follow the slots.  They are counted in two steps, runs of slots first, so that no
    source gathers in a task.
    """
    placed = _slots(spark, goals, count).withColumn("run", F.expr("slot div 4096"))
    runs = placed.groupBy("place", "run").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("place").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("place", "run", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("place", "run").orderBy("slot")) - 1
    return placed.withColumn("within", within).join(runs, ["place", "run"]).select("slot", "place", (F.col("base") + F.col("within")).alias("rank"))


def slot_counts(spark, goals: DataFrame, count: int) -> DataFrame:
    """``place, slots``: how many slots each source has in the schedule."""
    return _slots(spark, goals, count).groupBy("place").agg(F.count("*").alias("slots"))


def spans(sized: DataFrame, goals: DataFrame, bucket_docs: int = BUCKET_DOCS) -> DataFrame:
    """Where each document lies in its source's shuffled stream: ``doc_id, size, place, start`` (words), and ``__row`` if given.

    The shuffle orders by MD5 of the id.  Offsets are prefix sums in two steps, over buckets of leading hash
    digits and within a bucket, so a source with a third of all rows is spread over many tasks.
    """
    count = sized.count()
    buckets = max(MIN_BUCKETS, -(-count // bucket_docs))
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    names = ["doc_id", "size", *(["__row"] if "__row" in sized.columns else [])]
    rows = sized.select(*names, "source", key.alias("key"))
    lead = F.conv(F.substring("key", 1, 7), 16, 10).cast("long")
    rows = rows.withColumn("bucket", F.floor(lead * buckets / F.lit(1 << 28)))
    places = small_side(goals.select(F.col("source").alias("__source"), "place"), SMALL_ROWS)
    rows = rows.join(places, F.col("source").eqNullSafe(F.col("__source")))
    sums = rows.groupBy("place", "bucket").agg(F.sum("size").alias("n"))
    ahead = Window.partitionBy("place").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("place", "bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    inside = Window.partitionBy("place", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return rows.join(sums, ["place", "bucket"]).select(*names, "place", (F.col("base") + F.col("within")).alias("start"))


def _plan(spark, goals: DataFrame, slots: int | None) -> tuple[DataFrame, int, int]:
    """``goals`` with ``slots`` (drawn), ``words`` (of all its slots) and ``exact``, the words of a block and the number of slots.

    ``slots`` None takes ``SLOTS`` and, where a block has several words, gives a source of under ``NEAR_BLOCKS``
    blocks exactly its rounded target; a number takes equal blocks only.
    """
    block, count = block_size(goals, SLOTS if slots is None else slots)
    exact = F.col("target") < F.lit(NEAR_BLOCKS * block if slots is None and block > 1 else 0)
    drawn = goals.join(slot_counts(spark, goals, count), "place", "left").withColumns({"slots": F.coalesce("slots", F.lit(0)), "exact": exact})
    words = F.when(F.col("exact"), F.round("target").cast("long")).otherwise(F.col("slots") * block)
    return drawn.withColumn("words", F.least("cap", words)), block, count


def _mixed(spark, sized: DataFrame, weights: tuple[int, ...], max_epochs: int, slots: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sources' plan, where documents lie, and the schedule joined with them: ``slot, lap, place, source, start, doc_id, first, words``.

    A slot's block ``[rank * block, (rank + 1) * block)`` of the repeated stream meets documents through the
    pieces that both are cut into (an equi-join on source and piece), never through a range join.
    """
    goals = stash(targets(sized, weights, max_epochs), "mix-targets")
    plan, block, count = _plan(spark, goals, slots)
    plan, where = stash(plan, "mix-plan"), stash(spans(sized, goals), "mix-spans")
    piece = PIECE_BLOCKS * block
    # an exact source that no slot fell to has one of its own, where its share lies
    missed = plan.filter("exact and slots = 0").select(F.floor(F.col("lo") * count).alias("slot"), "place", F.lit(0).cast("long").alias("rank"))
    given = small_side(plan.select("place", "source", "source_size", "words", "exact", F.greatest("slots", F.lit(1)).alias("slots")), SMALL_ROWS)
    drawn = schedule(spark, goals, count).select("slot", "place", "rank").union(missed).join(given, "place")
    share = lambda rank: F.when(F.col("exact"), F.floor(rank * F.col("words") / F.col("slots"))).otherwise(F.least("words", rank * block))
    drawn = drawn.withColumn("at", share(F.col("rank"))).withColumn("length", share(F.col("rank") + 1) - F.col("at")).filter("length > 0 and source_size > 0")
    # a block may wrap around the end of its source, several times if the source is tiny
    laps = F.explode(F.sequence(F.expr("at div source_size"), F.expr("(at + length - 1) div source_size")))
    drawn = drawn.withColumn("lap", laps)
    lo = F.greatest(F.lit(0), F.col("at") - F.col("lap") * F.col("source_size"))
    hi = F.least(F.col("source_size"), F.col("at") + F.col("length") - F.col("lap") * F.col("source_size"))
    drawn = drawn.withColumn("lo", lo).withColumn("hi", hi)
    drawn = drawn.withColumn("piece", F.explode(F.sequence(F.expr(f"lo div {piece}"), F.expr(f"(hi - 1) div {piece}")))).select("slot", "lap", "source", "place", "piece", "lo", "hi")
    cut = where.filter("size > 0").select("doc_id", "size", "place", "start")
    cut = cut.withColumn("piece", F.explode(F.sequence(F.expr(f"start div {piece}"), F.expr(f"(start + size - 1) div {piece}"))))
    met = drawn.join(cut, ["place", "piece"])
    edge_lo = F.greatest("lo", "start", F.col("piece") * piece)
    edge_hi = F.least(F.col("hi"), F.col("start") + F.col("size"), (F.col("piece") + 1) * piece)
    met = met.withColumn("from", edge_lo).withColumn("upto", edge_hi).filter("upto > from")
    return plan, where, met.select("slot", "lap", "place", "source", "start", "doc_id", (F.col("from") - F.col("start")).alias("first"), (F.col("upto") - F.col("from")).alias("words"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, slots: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, taken``, and the columns ``keep`` of ``docs``.

    ``taken`` counts the words that the schedule's slots, joined with the shuffled documents, read of the document, repeats
    included; a source's last block is cut at its cap, and small sources take their rounded target (see :func:`_plan`), so no
    document exceeds ``max_epochs`` times its size.  Null text has size 0; whole texts count, of any length; a null source is a source
    of its own, last; repeated rows are documents of their own; empty sources have target 0; no rows give no rows.  Reruns
    agree: the order depends on ids alone, ties between equal ids go to the smaller size, and equal rows share what they take.
    """
    spark = docs.sparkSession
    sized = stash(sizes(docs, keep), "mix-sizes")
    plan, where, met = _mixed(spark, sized, weights, max_epochs, slots)
    per = met.groupBy("place", "start").agg(F.sum("words").alias("read")).select(F.col("place").alias("__place"), F.col("start").alias("__start"), "read")
    read = where.join(per, (F.col("place") == F.col("__place")) & (F.col("start") == F.col("__start")) & (F.col("size") > 0), "left")
    placed = read.join(small_side(plan.select("place", "source", "source_size", "target"), SMALL_ROWS), "place")
    if keep:
        placed = placed.join(sized.select("__row", *(F.col(c).alias(f"__keep_{c}") for c in keep)), "__row")
    kept = [F.col(f"__keep_{c}").alias(c) for c in keep]
    return placed.select("doc_id", "source", "size", "source_size", "target", F.coalesce("read", F.lit(0)).cast("long").alias("taken"), *kept)


def stream(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, slots: int | None = None) -> DataFrame:
    """The mix itself: ``slot, lap, source, doc_id, first, words`` rows, in slot order the words to read."""
    met = _mixed(docs.sparkSession, stash(sizes(docs), "mix-sizes"), weights, max_epochs, slots)[2]
    return met.select("slot", "lap", "source", "doc_id", "first", "words")
