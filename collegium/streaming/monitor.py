"""Monitoring as a stream: captures arrive as files, each is compared with what is known of its family, and the changes
come out once.

The state is a map of items for each part of a family, so that a family of any size is spread over many keys; a capture
sends every part of its family an end row, by which a part tells what it no longer has.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from collegium.functions.text import category_of, content_hash, importance_of
from collegium.sources.scratch import exists

CAPTURES = "family string, item string, title string, body string, supersedes string, captured timestamp"
CHANGES = "family string, item string, hash string, change string, captured timestamp"
#: Parts of a family, each a key of the state.
PARTS = 32
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_captures(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Captures, each in any number of files, as a stream; a batch takes all files that are there.

    With a number, a batch takes so many, which is for captures of one file each only: a capture that is cut by batches
    would be missing items in each, and files of nearly one time come in no certain order.
    """
    rows = spark.readStream.schema(CAPTURES)
    return (rows if files_per_batch is None else rows.option("maxFilesPerTrigger", files_per_batch)).json(path)


def with_ends(captures: DataFrame, parts: int = PARTS) -> DataFrame:
    """Captures as rows for the parts of their families: family, part, kind, item, hash, supersedes, captured.

    kind is item, ask (for the part of what an item supersedes: is that known?) or end. Every task that sees a capture
    sends each part one end row of it, however many items it has seen.
    """
    part = lambda c: F.pmod(F.xxhash64("family", c), F.lit(parts)).cast("int")
    rows = captures.where("captured IS NOT NULL").withColumn("hash", content_hash(F.col("title"), F.col("body")))
    rows = rows.select("family", part("item").alias("part"), F.when(F.col("supersedes").isNotNull(), part("supersedes")).alias("other"), "item", "hash", "supersedes", "captured")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = set()
        for batch in batches:
            yield batch.drop(columns="other").assign(kind="item")
            asked = batch[batch["other"].notna()]
            yield asked.drop(columns="part").rename(columns={"other": "part"}).assign(kind="ask")
            fresh = [k for k in dict.fromkeys(zip(batch["family"], batch["captured"])) if k not in seen]
            seen.update(fresh)
            if fresh:
                yield pd.DataFrame([(family, part, "end", captured) for family, captured in fresh for part in range(parts)], columns=["family", "part", "kind", "captured"]).assign(item=None, hash=None, supersedes=None)

    return rows.mapInPandas(run, "family string, part int, kind string, item string, hash string, supersedes string, captured timestamp")


def known_changes(rows: Iterator[pd.DataFrame], known: dict[str, tuple[str, bool]]) -> list[tuple]:
    """(item, hash, change, captured) of one part's rows, and `known` (item: hash, whether it is there) after them.

    Captures are taken in the order of their times: an item not known (or known and removed) is new, one with another
    hash updated, else unchanged; what the capture no longer has is removed, once. A question is answered by what was
    known before its capture: revised, on top of the item's own row. Rows of one item in a capture count once, the one
    with the greatest hash.
    """
    out = []
    every = pd.concat(rows)
    for captured, capture in every.groupby("captured", sort=True):
        items = capture[capture["kind"] == "item"].sort_values(["item", "hash"]).drop_duplicates("item", keep="last")
        asked = capture[capture["kind"] == "ask"].drop_duplicates(["item", "supersedes"])
        out += [(a.item, a.hash, "revised", captured) for a in asked.itertuples() if known.get(a.supersedes, ("", False))[1]]
        here = dict(zip(items["item"], items["hash"]))
        for item, hash_ in here.items():
            before, there = known.get(item, (None, False))
            change = "new" if not there else "unchanged" if before == hash_ else "updated"
            out.append((item, hash_, change, captured))
        gone = [item for item, (_, there) in known.items() if there and item not in here]
        out += [(item, known[item][0], "removed", captured) for item in gone]
        known |= {item: (hash_, True) for item, hash_ in here.items()} | {item: (known[item][0], False) for item in gone}
    return out


class KnownItems(StatefulProcessor):
    """What a part of a family holds: each item's hash and whether the last capture had it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.items = handle.getMapState("items", "item string", "hash string, there boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = {k[0]: (v[0], v[1]) for k, v in self.items.iterator()}
        before = dict(known)
        out = known_changes(rows, known)
        for item, value in known.items():
            if before.get(item) != value:
                self.items.updateValue((item,), value)
        if out:
            yield pd.DataFrame([(key[0], *o) for o in out], columns=["family", "item", "hash", "change", "captured"])

    def close(self) -> None:
        pass


def changes(captures: DataFrame, parts: int = PARTS) -> DataFrame:
    """A stream of captures as a stream of changes: new, unchanged, updated, removed, and a further row revised for an item
    that supersedes one that was known. A capture without items of a family says nothing of it, nor do rows without a
    time."""
    return with_ends(captures, parts).groupBy("family", "part").transformWithStateInPandas(KnownItems(), CHANGES, outputMode="Append", timeMode="None")


def store_changes(ledger: str):
    """A foreachBatch function that writes a batch's changes as a folder of its own; a batch run again replaces it.

    Of an item that supersedes a known one, revised takes the place of new, and of nothing else.
    """

    def run(batch: DataFrame, number: int) -> None:
        revised = F.col("change") == "revised"
        one = batch.groupBy("family", "item", "hash", "captured").agg(F.max(F.when(~revised, F.col("change"))).alias("own"), F.max(revised).alias("revised"))
        change = F.when((F.col("own") == "new") & F.col("revised"), "revised").otherwise(F.col("own"))
        one.select("family", "item", "hash", change.alias("change"), "captured").write.mode("overwrite").parquet(f"{ledger}/batch={number}")

    return run


def start_monitor(captures: DataFrame, ledger: str, checkpoint: str, minutes: int | None = None, parts: int = PARTS) -> StreamingQuery:
    """Runs the monitor; every `minutes` (5 at least), or over all that is there and then ends."""
    if minutes is not None and (minutes < 5 or int(minutes) != minutes):
        raise ValueError("a schedule takes five whole minutes or more")
    spark, name = captures.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, PROVIDER)  # a query keeps what holds as it starts
    try:
        writer = changes(captures, parts).writeStream.foreachBatch(store_changes(ledger)).option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=f"{minutes} minutes") if minutes else writer.trigger(availableNow=True)).start()
    finally:
        spark.conf.set(name, before)


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """All changes that the monitor has written, with the batch; none where it has written none."""
    schema = f"{CHANGES}, batch long"
    return spark.read.schema(schema).parquet(ledger) if exists(spark, ledger) else spark.createDataFrame([], schema)


def latest_versions(ledger: DataFrame) -> DataFrame:
    """family, item, hash, first_seen, last_change, there: each item as the last change of it left it."""
    order = F.struct("captured", (F.col("change") != "removed").alias("kept"))
    seen = ledger.groupBy("family", "item").agg(F.max_by(F.struct("hash", "change", "captured"), order).alias("m"), F.min("captured").alias("first_seen"))
    return seen.select("family", "item", "m.hash", "first_seen", F.col("m.captured").alias("last_change"), (F.col("m.change") != "removed").alias("there"))


def classified(captures: DataFrame) -> DataFrame:
    """Captured items with their content hash, category and importance."""
    rows = captures.withColumn("hash", content_hash(F.col("title"), F.col("body")))
    rows = rows.withColumn("category", category_of(F.col("title")))
    return rows.withColumn("importance", importance_of(F.col("category"), F.col("title")))


def daily_counts(captures: DataFrame, late: str = "2 days") -> DataFrame:
    """Captures per family and day, with a watermark that bounds the state."""
    return captures.withWatermark("captured", late).groupBy("family", F.window("captured", "1 day").alias("day")).agg(F.count(F.lit(1)).alias("captures"))
