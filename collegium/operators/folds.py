"""Results that later batches add to: stored partial counts, cuts of histograms, and the bookkeeping of synchronisation.

Where a fold takes steps in order and the last one wins, the greatest step of each key is the whole fold; so each is an
aggregate that is combined before its shuffle, whatever the number of rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from collegium.sources.scratch import exists

# The share of pixels that is cut at either end, the greatest level, and the least span worth a stretch.
CUT, TOP_LEVEL, LEAST_SPAN = 0.02, 255, 32


def store_partials(rows: DataFrame, path: str, batch: str, keys: list[str], counts: dict[str, Column]) -> None:
    """Counts a batch by its keys and stores that as the batch's part. A batch that is stored again replaces its part, so
    a late row costs one batch and not the whole."""
    rows.groupBy(*keys).agg(*[F.count_if(hit).alias(name) for name, hit in counts.items()]).write.mode("overwrite").parquet(f"{path}/batch={batch}")


def store_batches(rows: DataFrame, path: str, batch: str, keys: list[str], counts: dict[str, Column]) -> None:
    """store_partials for every batch that a column of the rows names, in one pass over them. A batch that is stored again
    replaces its part; one that has no rows here keeps it."""
    parts = rows.withColumnRenamed(batch, "batch").groupBy("batch", *keys).agg(*[F.count_if(hit).alias(name) for name, hit in counts.items()])
    parts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def merged_partials(spark: SparkSession, path: str, keys: list[str], counts: list[str]) -> DataFrame:
    """The sums of all stored parts: what one count over all batches' rows would give."""
    rows = spark.read.option("basePath", path).parquet(path)
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counts])


def histogram_cuts(bins: DataFrame, by: list[str]) -> DataFrame:
    """by, low, high, worth_it: where a share of the values ends at either side of a histogram of levels 0 to 255.

    bins has by, level and n; several rows may give parts of one level. low is the first level up to which more values
    lie than the share, high the last from which more lie; levels without values are passed over. No value is sorted:
    256 sums a group at most meet in its running totals. A span under 32 levels is not worth a stretch.
    """
    levels = bins.groupBy(*by, "level").agg(F.sum("n").alias("n"))
    up = W.partitionBy(*by).orderBy("level")
    total, so_far = F.sum("n").over(W.partitionBy(*by)), F.sum("n").over(up)
    rows = levels.select(*by, "level", "n", total.alias("total"), so_far.alias("so_far"))
    share = F.floor(F.col("total") * CUT)
    low, high = F.min(F.when(F.col("so_far") > share, F.col("level"))), F.max(F.when(F.col("total") - F.col("so_far") + F.col("n") > share, F.col("level")))
    cuts = rows.groupBy(*by).agg(low.alias("low"), high.alias("high"))
    return cuts.select(*by, F.coalesce("low", F.lit(TOP_LEVEL)).alias("low"), F.coalesce("high", F.lit(0)).alias("high")).withColumn("worth_it", F.col("high") - F.col("low") >= LEAST_SPAN)


def after_pushes(known: DataFrame, outcomes: DataFrame) -> DataFrame:
    """client, id, revision, fingerprint: a client's bookkeeping after the outcomes of any number of pushes.

    known has these columns; outcomes has client, id, round, status, revision, fingerprint and gone (the server holds no
    record any more). An applied outcome replaces what is known of its record, one that is gone takes it off the books;
    conflicts and refusals change nothing. Of several applied ones the one of the last round holds.
    """
    said = outcomes.where("status = 'applied'").select("client", "id", "revision", "fingerprint", F.coalesce("gone", F.lit(False)).alias("gone"), F.col("round").cast("long").alias("round"))
    rows = known.select("client", "id", "revision", "fingerprint", F.lit(False).alias("gone"), F.lit(-1).cast("long").alias("round")).unionByName(said)
    last = rows.groupBy("client", "id").agg(F.max_by(F.struct("revision", "fingerprint", "gone"), "round").alias("m"))
    return last.where("NOT m.gone").select("client", "id", "m.revision", "m.fingerprint")


def push_conflicts(outcomes: DataFrame, local: DataFrame) -> DataFrame:
    """client, id, round, reason, local, server: what somebody must decide, with both versions, where there are any."""
    open_ = outcomes.where("status <> 'applied'").select("client", "id", "round", F.coalesce("reason", F.lit("This record changed somewhere else.")).alias("reason"), F.col("fingerprint").alias("server"))
    return open_.join(local.select("client", "id", F.col("fingerprint").alias("local")), ["client", "id"], "left")


def pull_rounds(remote: DataFrame, size: int) -> DataFrame:
    """remote(client, id, updated, ...) with round (from 0): pages of `size` records in the order of updated, then id.

    Records of one time may fall into two rounds; the cursor that a round ends with names both, so none is skipped and
    none comes twice. The records of one client are ordered together.
    """
    turn = F.row_number().over(W.partitionBy("client").orderBy("updated", "id")) - 1
    return remote.withColumn("round", F.floor(turn / size))


def cursors(rounds: DataFrame) -> DataFrame:
    """client, round, updated, id: where each round of pull_rounds ends, and the next one begins behind."""
    last = rounds.groupBy("client", "round").agg(F.max(F.struct("updated", "id")).alias("m"), F.count(F.lit(1)).alias("records"))
    return last.select("client", "round", "m.updated", "m.id", "records")


def after_pulls(known: DataFrame, taken: DataFrame) -> DataFrame:
    """client, id, revision, fingerprint: the bookkeeping after pulls; taken has these columns with round and step (upsert,
    delete; others change nothing). The last round holds; a deleted record is off the books."""
    outcomes = taken.where(F.col("step").isin("upsert", "delete")).select("client", "id", "round", F.lit("applied").alias("status"), "revision", "fingerprint", (F.col("step") == "delete").alias("gone"))
    return after_pushes(known, outcomes)


def cached_pages(spark: SparkSession, path: str, wanted: DataFrame, version: str) -> DataFrame:
    """wanted(sha256) with pages: the text that was extracted of each, null where the cache has none by this version, holds
    no readable JSON, or says that there is no text."""
    schema = "status string, pages array<struct<page:int,text:string>>"
    found = spark.read.text(path, wholetext=True) if exists(spark, path) else spark.createDataFrame([], "value string")
    name = F.regexp_extract(F.col("_metadata.file_name"), rf"^([0-9a-f]+)\.{version}\.json$", 1) if exists(spark, path) else F.lit("")
    read = found.select(name.alias("sha256"), F.from_json("value", schema).alias("c")).where("sha256 <> ''")
    return wanted.join(read.where("c.status = 'text'").select("sha256", "c.pages"), "sha256", "left")
