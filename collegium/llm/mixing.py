"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from collegium.llm.common import WORD, in_order, materialise, running_total

#: Words of a block, the unit of the schedule.
BLOCK = 1024
#: Sources by code point, null last, weigh these, repeating.
WEIGHTS = (5, 2, 1)
#: What all sources take together, and what one may take at most, as multiples of sizes.
SHARE, EPOCHS = 1.5, 2
#: Rows that a bucket of a group holds, about.
BUCKET_ROWS = 2_000
#: Slots that a chunk of the schedule holds when slots are ranked.
CHUNK = 1 << 16


def word_count(text):
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(WORD))).cast("long")


def copy_hash(text_col: str, source_col: str):
    """Tells rows apart that repeat an id with different texts or sources."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")), F.col(source_col))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """doc_id, source, size, copy and the hash `shuffled` that orders the documents of a source; reads each text once."""
    shuffled = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), shuffled.alias("shuffled"), copy_hash(text_col, source_col).alias("copy"))


def source_targets(sizes: DataFrame) -> DataFrame:
    """One row per source: source, no, docs, source_size, weight, target, words (target, rounded), _part.

    Targets are weight times a level, stopped at EPOCHS times the source's size. The level rises while the excess
    of stopped sources is reshared; each round is one aggregate over the sources, of which two numbers reach the
    driver. Without any word all targets are 0.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    ordered = in_order(sources, [F.col("source").asc_nulls_last()], "sources").withColumn("_absent", F.col("source").isNull().cast("int"))
    ordered = running_total(ordered.withColumn("_all", F.lit(0)), ["_all"], "_part", ["_absent", "source"], F.lit(1), "no").drop("_all", "_absent")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("no") % len(WEIGHTS) + 1).cast("int"))
    ordered = materialise(ordered.withColumn("weight", weight), "weights")
    most = F.col("source_size") * float(EPOCHS)
    total, free = ordered.agg(F.sum("source_size"), F.sum("weight")).first()
    wanted, level, stopped = SHARE * (total or 0), 0.0, -1
    while free:
        level_now = (wanted - max(stopped, 0)) / free
        over = most <= F.col("weight") * level_now
        taken, left = ordered.agg(F.sum(F.when(over, most)), F.sum(F.when(~over, F.col("weight")))).first()
        level = level_now
        if (taken or 0) == stopped or not left:
            break
        stopped, free = taken or 0, left
    target = F.least(most, F.col("weight") * level)
    return ordered.withColumn("target", target).withColumn("words", F.floor(target + 0.5).cast("long"))


def schedule(targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """The slots of the mix: no, rank (which of its source's blocks), at (place in the mix, 0 to 1).

    Slot k is the base-2 van der Corput point of k, looked up in the cumulative targets through a grid of cells,
    an equi-join. A source that the sequence gives less than its blocks, by its discrepancy at most, gets the rest
    spread evenly; what it gives beyond is dropped, so that every source has exactly its blocks.
    """
    spark = targets.sparkSession
    needs = targets.withColumn("_all", F.lit(0)).withColumn("blocks", F.ceil(F.col("words") / block).cast("long"))
    needs = materialise(running_total(needs, ["_all"], "_part", ["no"], F.col("words"), "below").select("no", "words", "blocks", "below"), "needs")
    slots, words, sources = needs.agg(F.sum("blocks"), F.sum("words"), F.count(F.lit(1))).first()
    slots, words = slots or 0, words or 1
    cells = 1 << max(6, (4 * sources).bit_length())
    low, high = F.col("below") / words, (F.col("below") + F.col("words")) / words
    within = needs.where("words > 0").select("no", low.alias("low"), high.alias("high"))
    within = within.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * cells), F.least(F.floor(F.col("high") * cells), F.lit(cells - 1)))))
    point = F.conv(F.reverse(F.lpad(F.bin("id"), 52, "0")), 2, 10).cast("double") / float(1 << 52)
    drawn = spark.range(slots).select(F.col("id").alias("slot"), point.alias("u"))
    drawn = drawn.withColumn("cell", F.floor(F.col("u") * cells)).join(within, "cell").where("u >= low and u < high").select("no", "slot")
    drawn = materialise(drawn.withColumn("chunk", F.floor(F.col("slot") / CHUNK)), "drawn")
    ranked = running_total(drawn, ["no"], "chunk", ["slot"], F.lit(1), "rank").join(needs.select("no", "blocks"), "no")
    ranked = ranked.where("rank < blocks").select("no", "rank", (F.col("slot") / float(max(slots, 1))).alias("at"))
    short = needs.join(drawn.groupBy("no").agg(F.count(F.lit(1)).alias("got")), "no", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    short = short.where("got < blocks").select("no", "blocks", F.explode(F.sequence(F.col("got"), F.col("blocks") - 1)).alias("rank"))
    return ranked.unionByName(short.select("no", F.col("rank").cast("long"), ((F.col("rank") + 0.5) / F.col("blocks")).alias("at")))


def placed(sizes: DataFrame, targets: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Documents with their source's target and `start`, the words of their source before them in shuffled order.

    The shuffling hash is uniform, so its leading part cuts a source of any size into buckets of bucket_rows.
    """
    known = sizes.join(targets.drop("_part"), sizes["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    draw = F.conv(F.substring("shuffled", 1, 8), 16, 10).cast("double") / float(1 << 32)
    known = known.withColumn("bucket", F.floor(draw * F.ceil(F.col("docs") / bucket_rows)))
    return running_total(known, ["no"], "bucket", ["shuffled", "doc_id", "size", "copy"], F.col("size"), "start")


def pieces(documents: DataFrame, slots: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix: a row for each stretch of a document in a scheduled block.

    A source's words, in shuffled order and repeated, are cut into blocks; block r goes where slot r of the source
    is. Adds epoch, skip (words of the document before the stretch), taken (its words), rank and at.
    """
    begun = F.col("start") + F.col("epoch") * F.col("source_size")
    ended = F.least(begun + F.col("size"), F.col("words"))
    cut = (
        documents.where("size > 0 and words > 0")
        .withColumn("epoch", F.explode(F.array(*[F.lit(e) for e in range(EPOCHS)])))
        .withColumn("_from", begun)
        .withColumn("_to", ended)
        .where("_to > _from")
        .withColumn("rank", F.explode(F.sequence(F.floor(F.col("_from") / block), F.floor((F.col("_to") - 1) / block))))
        .withColumn("_first", F.greatest("_from", F.col("rank") * block))
        .withColumn("taken", F.least("_to", (F.col("rank") + 1) * block) - F.col("_first"))
        .withColumn("skip", F.col("_first") - F.col("_from"))
        .drop("_from", "_to", "_first")
    )
    return cut.join(slots, ["no", "rank"])


def mix(docs: DataFrame, block: int = BLOCK, seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """(documents, pieces) of the mix of a table with doc_id, text and source.

    documents has a row for each row of docs: doc_id, source, size, source_size, target, start and more. Texts
    that are null or without a word have size 0 and no piece; null is a source of its own, the last. Rows that
    share a doc_id are documents of their own. The order comes from doc_id and seed alone, so reruns agree.
    """
    sizes = materialise(sized(docs, seed=seed), "sizes")
    targets = materialise(source_targets(sizes), "targets")
    documents = materialise(placed(sizes, targets), "placed")
    return documents, pieces(documents, schedule(targets, block), block)


def mix_report(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (the words that the mix takes of it) and at, the
    place of its first block in the mix (0 to 1, null if none is taken). An empty table gives no rows."""
    documents, parts = mix(docs, block)
    # A document is known by its source and start, which no other document with a word shares.
    took = parts.groupBy("doc_id", "no", "start", "size", "source_size", "target").agg(F.sum("taken").alias("taken"), F.min("at").alias("at"))
    rest = documents.where("size = 0 or words <= start").withColumns({"taken": F.lit(0), "at": F.lit(None).cast("double")})
    columns = ["doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), "at"]
    return took.select(*columns).unionByName(rest.select(*columns))


def mixed_documents(docs: DataFrame, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs as the mix takes them and in its order: a row for each time that a document is taken, with docs' columns.

    Rows are range-partitioned and sorted by the place of their first block, so that the files, read in turn, hold the
    sources in their shares throughout. What a source's target cuts in the middle keeps its first words, joined by
    spaces; all other texts are whole. Documents that the mix does not take go. Rows that repeat an id are documents
    of their own, known by text and source; those that repeat these too are numbered.
    """
    documents, parts = mix(docs, block)
    keys = ["_id", "_none", "_copy"]
    identity = lambda rows, doc_id, copy: rows.withColumns({"_id": F.coalesce(F.col(doc_id).cast("long"), F.lit(0)), "_none": F.col(doc_id).cast("long").isNull(), "_copy": copy})
    took = identity(parts, "doc_id", F.col("copy")).groupBy(*keys, "start", "size", "epoch").agg(F.sum("taken").alias("_taken"), F.min("at").alias("_at"))
    took = materialise(took.select(*keys, "start", "_at", F.when(F.col("_taken") < F.col("size"), F.col("_taken").cast("int")).alias("_cut")), "took")
    rows = identity(docs, id_col, copy_hash(text_col, source_col))
    if identity(documents, "doc_id", F.col("copy")).groupBy(*keys).count().where("count > 1").limit(1).count():
        took = materialise(took.withColumn("_no", F.dense_rank().over(W.partitionBy(*keys).orderBy("start"))), "took")
        rows = rows.withColumn("_no", F.row_number().over(W.partitionBy(*keys).orderBy(F.xxhash64(*docs.columns))))
        keys = [*keys, "_no"]
    # Texts move twice: to a narrow list whose size follows the table's, and into their order.
    met = rows.join(took.hint("shuffle_hash"), keys).repartitionByRange("_at").sortWithinPartitions("_at", *keys)
    first = F.array_join(F.slice(F.regexp_extract_all(text_col, F.lit(WORD), F.lit(0)), F.lit(1), F.col("_cut")), " ")
    return met.select(*[F.when(F.col("_cut").isNull(), F.col(c)).otherwise(first).alias(c) if c == text_col else F.col(c) for c in docs.columns])
