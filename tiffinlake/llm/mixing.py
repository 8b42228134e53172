"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Sources in order of code point, null last, weigh 1, 2, 3, repeating. They share all words by weight;
no target exceeds ``MAX_REPEATS`` times its source's words, and what a source can't take is shared
again by weight. Each source's documents are laid end to end in hash order and cut into blocks of
equally many words. Slot t of the schedule has the point t * G mod 1, G near the golden ratio, and
goes to the source in whose interval of cumulative weights the point falls; a source's slots, ranked,
take its blocks in turn, from the first again after the last, until its target is met. So any stretch
of the schedule holds all sources in nearly the right shares, with no random draw.

Sizes of hot sources never meet in one task: offsets and ranks are running sums over chunks plus
sums within a chunk. The table of sources itself (a row each) is ranked in one task.

Defined cases: a null text has no words; documents without words and sources without words take
nothing; repeated rows are documents of their own; equal hashes are ordered by doc_id and row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WORD, stored, text_of

WEIGHTS, MAX_REPEATS = 3, 3
#: Words of a block at most; a source has ``LEAST_BLOCKS`` or more, if it has so many words.
BLOCK_WORDS, LEAST_BLOCKS = 4096, 1024
#: Golden-ratio steps over 2 ** 31 points, in whole numbers so that every engine agrees.
PERIOD, STEP = 2**31, 1327217885
#: Documents and slots that one task orders.
CHUNK_DOCS, CHUNK_SLOTS = 50_000, 1 << 16
CELLS = 1024


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def order_hash() -> Column:
    """What orders the documents of a source, before doc_id and row."""
    return F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))


def with_row(docs: DataFrame) -> DataFrame:
    """``docs`` with a number per row, which depends on how its files are cut for tasks.

    Who joins on the number later keeps the result as a table; ``mix`` itself reads ``docs`` once.
    """
    return docs.withColumn("row", F.monotonically_increasing_id())


def source_targets(sized: DataFrame) -> DataFrame:
    """Per source: rank, source_size, target, words of a block, blocks, slots and its schedule interval."""
    ranked = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = ranked.withColumn("rank", F.row_number().over(by_name)).withColumn(
        "weight", (F.col("rank") - 1) % WEIGHTS + 1
    )
    # With sources by how soon they are full, all before the first that isn't full are full.
    cap = F.col("source_size") * MAX_REPEATS
    order = Window.orderBy(F.col("fills_at"), F.col("rank"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("fills_at", cap / F.col("weight"))
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    s = s.withColumn("level", left / F.sum("weight").over(after))
    s = s.withColumn(
        "level", F.first(F.when(F.col("level") <= F.col("fills_at"), F.col("level")), True).over(everything)
    )
    s = s.withColumn("target", F.least(cap.cast("double"), F.col("level") * F.col("weight")))
    words = F.greatest(F.lit(1), F.least(F.lit(BLOCK_WORDS), F.expr(f"source_size div {LEAST_BLOCKS}")))
    s = s.withColumn("block_words", words.cast("long")).withColumn(
        "blocks", F.expr("(source_size + block_words - 1) div block_words")
    )
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    part = F.round((F.col("target") - full * F.col("source_size")) / F.col("block_words"))
    s = s.withColumn("slots", (full * F.col("blocks") + F.least(part, F.col("blocks"))).cast("long"))
    upto = F.sum("slots").over(by_name.rowsBetween(Window.unboundedPreceding, 0))
    total = F.greatest(F.sum("slots").over(everything), F.lit(1))
    return s.withColumn("high", upto / total).withColumn("low", (upto - F.col("slots")) / total)


def running(df: DataFrame, group: str, chunk: str, value: Column, order: list[Column], name: str) -> DataFrame:
    """``name``: the sum of ``value`` over the earlier rows of the group; no task orders a whole group."""
    sums = df.groupBy(group, chunk).agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(group).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(group, chunk, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    within = Window.partitionBy(group, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = df.withColumn("_own", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return own.join(starts, [group, chunk]).withColumn(name, F.col("_start") + F.col("_own")).drop("_start", "_own")


def hits(sources: DataFrame, first: int, end: int) -> DataFrame:
    """rank, slots, slot: the slots from ``first`` to before ``end`` whose points fall into the sources' intervals."""
    points = sources.sparkSession.range(first, end).withColumnRenamed("id", "slot")
    points = points.withColumn("point", (F.col("slot") % PERIOD * STEP % PERIOD) / F.lit(float(PERIOD)))
    points = points.withColumn("cell", F.floor(F.col("point") * CELLS))
    wide = sources.where("slots > 0").select(
        "rank", "slots", "low", "high",
        F.explode(F.sequence(F.floor(F.col("low") * CELLS), F.floor(F.col("high") * CELLS))).alias("cell"),
    )
    return points.join(wide, "cell").where("low <= point and point < high").select("rank", "slots", "slot")


def schedule(sources: DataFrame) -> DataFrame:
    """rank, slot, turn: which source each slot goes to, and the how-manieth of its slots that is.

    An interval may lack a few points whatever its width, so points go on for the sources that are short.
    """
    slots = sources.agg(F.sum("slots")).first()[0] or 0
    end = slots + slots // 64 + 64 if slots else 0
    hit = hits(sources, 0, end)
    short = sources.where("slots > 0").select("rank", "slots", "low", "high", F.lit(0).cast("long").alias("had"))
    more = hit
    while slots:
        new = more.groupBy("rank").agg(F.count("*").alias("new"))
        had = F.col("had") + F.coalesce("new", F.lit(0))
        short = stored(short.join(new, "rank", "left").withColumn("had", had).drop("new").where("had < slots"), "short")
        if short.isEmpty():
            break
        more = hits(short, end, 2 * end)
        hit, end = hit.unionByName(more), 2 * end
    hit = hit.withColumn("chunk", F.expr(f"slot div {CHUNK_SLOTS}"))
    return running(hit, "rank", "chunk", F.lit(1), [F.col("slot")], "turn").where("turn < slots").select(
        "rank", "slot", "turn"
    )


def mix(docs: DataFrame) -> DataFrame:
    """row, doc_id, source, size, source_size, target, taken for rows of row, doc_id, source, text.

    The text is read once; what follows moves numbers only.
    """
    sized = docs.select("row", "doc_id", "source", word_count(text_of()).alias("size"))
    sized = stored(sized.withColumn("hash", order_hash()), "sizes")
    sources = stored(source_targets(sized), "sources")
    digits = 1
    while sized.count() > CHUNK_DOCS * 16**digits // 16:
        digits += 1

    placed = sized.join(sources, sized["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    placed = placed.withColumn("chunk", F.substring("hash", 1, digits))
    placed = running(placed, "rank", "chunk", F.col("size"), [F.col(c) for c in ("hash", "doc_id", "row")], "start")
    last = F.expr("(start + size - 1) div block_words")
    blocks = F.when(F.col("size") > 0, F.sequence(F.expr("start div block_words"), last))
    pieces = placed.withColumn("block", F.explode_outer(blocks)).withColumn(
        "words",
        F.least(F.expr("start + size"), F.expr("(block + 1) * block_words"))
        - F.greatest(F.col("start"), F.expr("block * block_words")),
    )
    turns = schedule(sources).join(sources.select("rank", "blocks"), "rank")
    takes = turns.groupBy("rank", (F.col("turn") % F.col("blocks")).alias("block")).agg(F.count("*").alias("takes"))
    return (
        pieces.join(takes, ["rank", "block"], "left")
        .groupBy("row")
        .agg(
            *[F.any_value(c).alias(c) for c in ("doc_id", "source", "size", "source_size", "target")],
            F.coalesce(F.sum(F.col("words") * F.col("takes")), F.lit(0)).alias("taken"),
        )
    )


def passes(mixed: DataFrame) -> DataFrame:
    """What ``mix`` takes, told so shortly that texts needn't be shuffled to learn it.

    Blocks are taken in turn, so the documents of a source are taken ``passes`` times, those up to the hash
    ``upto`` once more. That is a row per source (``row`` null). A row each (``row``, ``size``, ``taken``) have
    the documents with words for which it doesn't hold: the one in which the last pass ends, and some of
    equal hashes, if it ends among these.
    """
    some = mixed.where("size > 0").withColumn("times", F.expr("taken div size")).withColumn("hash", order_hash())
    last = some.groupBy("source", "times").agg(F.max("hash").alias("hash"))
    rules = last.groupBy("source").agg(F.min("times").alias("passes"), F.max(F.struct("times", "hash")).alias("most"))
    upto = F.when(F.col("most.times") > F.col("passes"), F.col("most.hash"))
    rules = stored(rules.select(F.col("source").alias("of"), "passes", upto.alias("upto")), "rules")
    odd = some.join(rules, F.col("source").eqNullSafe(F.col("of"))).where(F.col("taken") != whole_passes() * F.col("size"))
    none = F.lit(None).cast("long")
    rules = rules.select(*[none.alias(c) for c in ("row", "size", "taken")], F.col("of").alias("source"), "passes", "upto")
    return rules.unionByName(odd.select("row", "size", "taken"), allowMissingColumns=True)


def whole_passes() -> Column:
    """How often a document is taken whole by the rule of its source."""
    return F.col("passes") + F.coalesce(F.col("hash") <= F.col("upto"), F.lit(False)).cast("long")
