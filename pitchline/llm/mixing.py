"""Mixing sources to target weights by a low-discrepancy schedule.

Targets: sources weigh 1, 2, 3, repeating; together they share all words; a source
stops at ``MAX_REPEATS`` times its words and the excess is shared by weight again.
Schedule: slot i of the mix gets the point frac(i * golden ratio) (32-bit integers),
which falls into one source's part of the cumulative targets; a source's slots are
ranked, and its k-th slot takes the k-th block of ``block`` words of the source's
shuffled stream of documents, epoch after epoch; the last block is cut so that the
source ends at its target exactly. A document's ``taken`` is the sum over the blocks
that it overlaps.

All of it is DataFrame operations on a narrow staged table: positions in streams and
ranks of slots are two-level prefix sums, so no task holds a source; points meet
sources by an equi-join on cells of the unit interval. Points have 32 bits: after 2^32
slots they come again, as evenly as before.

Hits, ranks, takes and the places of parts are narrow tables staged in turn: each is
worked out once, and the driver never plans the mix as one query, whose plan it would
describe anew for each finished stage.

Defined cases: a null text has no words; null sources are one source, the last; null
ids are kept; documents without words take 0; rows that repeat are separate rows;
empty tables give an empty result. The order of streams is a hash of id and text, so
reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, joined, prefix_sums, release, staged, table, whole_rows

MAX_REPEATS = 3
#: Words of a slot.
BLOCK = 256
BLANKS = r"[\x20\x09-\x0D]*"
CELLS = 1 << 12
CHUNK = 512
PART_ROWS = 128
MAX_PARTS = 1 << 20
#: 2^32 / golden ratio, rounded to an odd number.
GOLDEN = 2654435769


def source_targets(sizes: DataFrame) -> DataFrame:
    """From (skey, source, size): skey, source_size, n_docs, weight, target, words
    (the target as whole words), total. One row for each source."""
    per = sizes.groupBy("skey").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    per = per.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("double")).withColumn("cap", (F.lit(MAX_REPEATS) * F.col("source_size")).cast("double"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "skey").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    per = per.withColumn("total", F.sum("source_size").over(every))
    left = F.col("total") - F.coalesce(F.sum("cap").over(fill), F.lit(0.0))
    weights = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(fill), F.lit(0.0))
    per = per.withColumn("level", left / weights).withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
    level = F.max(F.when(~F.col("capped"), F.col("level"))).over(every)
    target = F.when(F.col("capped"), F.col("cap")).otherwise(level * F.col("weight"))
    return per.select("skey", "source_size", "n_docs", "weight", "total", target.alias("target")).withColumn("words", F.least(F.round("target").cast("long"), F.lit(MAX_REPEATS) * F.col("source_size")))


def golden_point(i: Column) -> Column:
    """frac(i / golden ratio) in units of 2^-32, in 64-bit arithmetic without overflow."""
    low, high = i.bitwiseAND(0xFFFF), F.shiftright(i, 16).bitwiseAND(0xFFFF)
    return (low * F.lit(GOLDEN) + F.shiftleft((high * F.lit(GOLDEN)).bitwiseAND(0xFFFF), 16)).bitwiseAND(0xFFFFFFFF)


def schedule(spark: SparkSession, targets: DataFrame, n_slots: int) -> DataFrame:
    """(skey, rank, slot), staged: which source each slot takes from, ranked by source;
    without the slots that round-off leaves out."""
    order = Window.orderBy("skey").rowsBetween(Window.unboundedPreceding, 0)
    bounds = targets.where("words > 0").withColumn("to", F.sum("words").over(order)).withColumn("all", F.sum("words").over(Window.partitionBy()))
    unit = F.lit(float(1 << 32))
    bounds = bounds.select("skey", F.floor((F.col("to") - F.col("words")) / F.col("all") * unit).alias("from_x"), F.floor(F.col("to") / F.col("all") * unit).alias("to_x"))
    width = (1 << 32) // CELLS
    bounds = bounds.where("from_x < to_x").select("*", F.explode(F.sequence(F.expr(f"from_x div {width}"), F.expr(f"(to_x - 1) div {width}"))).alias("cell"))
    slots = spark.range(n_slots).select(F.col("id").alias("slot"), golden_point(F.col("id")).alias("x")).withColumn("cell", F.expr(f"x div {width}"))
    hit = staged(slots.join(bounds, "cell").where("x >= from_x AND x < to_x").select("skey", "slot", F.expr(f"slot div {CHUNK}").alias("chunk")), "mix-hits")
    chunks = hit.groupBy("skey", "chunk").agg(F.count("*").alias("n")).withColumn("coarse", F.expr("chunk div 1024"))
    chunks = staged(prefix_sums(chunks, ["skey"], "coarse", "chunk", ["n"]).select("skey", "chunk", "before_n"), "mix-chunks")
    inside = Window.partitionBy("skey", "chunk").orderBy("slot")
    ranked = staged(hit.join(chunks, ["skey", "chunk"]).select("skey", "slot", (F.col("before_n") + F.row_number().over(inside) - 1).alias("rank")), "mix-slots")
    release(hit)
    release(chunks)
    return ranked


def streams(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Adds to each row its place in its source's shuffled stream: ``start`` (words
    before it) and ``seq`` (documents before it)."""
    all_rows = F.sum("n_docs").over(Window.partitionBy())
    per_part = F.greatest(F.lit(PART_ROWS), F.ceil(all_rows / F.lit(MAX_PARTS)))
    parts_of = targets.select("skey", F.ceil(F.col("n_docs") / per_part).cast("long").alias("parts"))
    rows = sizes.join(F.broadcast(parts_of), "skey").withColumn("part", F.pmod("order", "parts")).drop("parts")
    parts = rows.groupBy("skey", "part").agg(F.sum("size").alias("words"), F.count("*").alias("docs")).withColumn("coarse", F.expr("part div 1024"))
    parts = staged(prefix_sums(parts, ["skey"], "coarse", "part", ["words", "docs"]).select("skey", "part", "before_words", "before_docs"), "mix-parts")
    inside = Window.partitionBy("skey", "part").orderBy("order", "doc_id", "size", "h")
    return rows.join(parts, ["skey", "part"]).select(
        "skey", "doc_id", "size", "h",
        (F.col("before_words") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("start"),
        (F.col("before_docs") + F.row_number().over(inside) - 1).alias("seq"),
    )


def mix(docs: DataFrame, seed: int = 7) -> DataFrame:
    """(doc_id, size, source_size, target, taken, h, slot) for each row of ``docs``
    (doc_id, text, source); h is a hash of the text, slot the first one of the schedule
    that takes of the document: the order of the mix. Null if none does, or only the
    rest that round-off leaves to a source. Sources are few (a name each), so tables of
    them are broadcast."""
    spark = docs.sparkSession
    skey = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    sizes = docs.select("doc_id", "source", skey.alias("skey"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("h"))
    sizes = staged(sizes.withColumn("order", F.xxhash64("doc_id", "h", F.lit(seed))), "mix-sizes")
    targets = staged(source_targets(sizes), "mix-targets")
    total = (targets.agg(F.max("total")).first()[0]) or 0  # one number
    block = BLOCK
    # a source's slots: whole epochs of ceil(size / block) blocks, then some blocks, the last cut
    per_epoch = F.expr(f"(source_size + {block - 1}) div {block}")
    plan = targets.where("words > 0").select(
        "skey", per_epoch.alias("per_epoch"),
        (F.expr("words div source_size") * per_epoch + F.expr(f"(words % source_size + {block - 1}) div {block}")).alias("quota"),
        F.expr("words % source_size").alias("rest"), F.expr("words div source_size").alias("epochs"),
    )
    slots = schedule(spark, targets, -(-total // block))
    have = slots.groupBy("skey").agg(F.count("*").alias("n"))
    missing = plan.join(have, "skey", "left").where("coalesce(n, 0) < quota").select("skey", F.explode(F.sequence(F.coalesce("n", F.lit(0)), F.col("quota") - 1)).alias("rank"))
    ranked = slots.select("skey", "rank", "slot").unionByName(missing.withColumn("slot", F.lit(None).cast("long")))
    taken = ranked.join(F.broadcast(plan), "skey").where("rank < quota")  # a row for each source
    in_epoch = F.expr("rank % per_epoch")
    cut = F.when(F.expr("rank div per_epoch") == F.col("epochs"), F.least(F.lit(block), F.col("rest") - in_epoch * block)).otherwise(F.lit(block))
    # whole takes, and the words of a last, cut take
    takes = taken.select("skey", "slot", in_epoch.alias("block"), cut.alias("words")).groupBy("skey", "block").agg(F.min("slot").alias("slot"), F.count_if(F.col("words") == block).alias("whole"), F.coalesce(F.sum(F.when(F.col("words") < block, F.col("words"))), F.lit(0)).alias("part"))
    takes = staged(takes, "mix-blocks")
    release(slots)
    pieces = streams(sizes.drop("source"), targets).select("*", F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}")))).alias("block"))
    begin = F.col("block") * block
    overlap = F.least(F.col("start") + F.col("size"), begin + block) - F.greatest("start", begin)
    cut_overlap = F.greatest(F.lit(0), F.least(F.col("start") + F.col("size"), begin + F.col("part")) - F.greatest("start", begin))
    words = F.coalesce(F.col("whole") * overlap + cut_overlap, F.lit(0))
    per_doc = pieces.join(takes, ["skey", "block"], "left").groupBy("skey", "seq").agg(F.first("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("h").alias("h"), F.sum(words).alias("taken"), F.min(F.when(words > 0, F.col("slot"))).alias("slot"))
    return per_doc.join(F.broadcast(targets.select("skey", "source_size", "target")), "skey").select("doc_id", "size", "source_size", "target", "taken", "h", "slot")


def mixed_documents(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The mix as rows with the columns of ``docs``: a document comes once for each
    time that all its words are taken, and once more with its first words (and the
    blanks before them) if some are taken once more, at most one document of a source;
    others go. Of rows that agree in id and text one stands for all, with the words that
    the mix takes of them together."""
    takes = mix(docs, seed).groupBy("doc_id", "h").agg(F.max("size").alias("size"), F.sum("taken").alias("taken"), F.count("*").alias("n")).where("taken > 0")
    takes = staged(takes.select(F.col("doc_id").alias("id"), "h", "size", "taken", "n"), "mix-takes")
    rows = whole_rows(docs, F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"))
    both = joined(rows, takes, ["id", "h"], "inner")
    out = both.where("n = 1").select("row", "size", "taken")
    if not takes.where("n > 1").isEmpty():
        again = both.where("n > 1").groupBy("id", "h").agg(F.min_by("row", F.xxhash64("row")).alias("row"), F.first("size").alias("size"), F.first("taken").alias("taken"))
        out = out.unionByName(again.select("row", "size", "taken"))
    copies = out.select("row", "size", "taken", F.explode(F.sequence(F.lit(1), F.expr("taken div size + if(taken % size > 0, 1, 0)"))).alias("copy"))
    words = F.regexp_extract_all("row.text", F.lit(f"({BLANKS}{WORD})"))
    head = F.array_join(F.slice(words, F.lit(1), F.expr("int(taken % size)")), "")
    text = F.when(F.col("copy") * F.col("size") > F.col("taken"), head).otherwise(F.col("row.text"))
    return copies.withColumn("row", F.col("row").withField("text", text)).select("row.*")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "slot")
