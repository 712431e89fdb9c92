"""Sharding over fixed virtual slots with a versioned slot-to-shard map. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetspectra.llm.common import in_few_parts, settled

#: Number of virtual slots; it never changes, so a record's slot never does.
SLOTS = 8192
#: Bytes that a record takes besides its text.
RECORD_BYTES = 16


def virtual_slot(id_col: str, text_col: str, slots: int = SLOTS) -> Column:
    """The slot of a record, by a hash of its id and text."""
    return F.pmod(F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))), F.lit(slots)).cast("int")


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, carry: bool = False) -> DataFrame:
    """``doc_id, size, text_crc32, vslot`` of each row; the text goes no further unless the whole row is to be carried."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        *([F.col(id_col).alias("_id"), F.struct(*docs.columns).alias("_row")] if carry else [F.col(id_col).alias("doc_id")]),
        (F.octet_length(text) + RECORD_BYTES).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        virtual_slot(id_col, text_col, slots).alias("vslot"),
    )


def slot_sizes(spark: SparkSession, rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``vslot, bytes, n`` of every slot, empty ones too: at most ``slots`` rows, whatever the input."""
    found = rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    every = spark.range(slots, numPartitions=1).select(F.col("id").cast("int").alias("vslot"))
    return every.join(found, "vslot", "left").fillna(0, ["bytes", "n"])


def first_map(spark: SparkSession, n_shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 1 of the map: slots dealt in turn, before any size is known. ``version, vslot, shard``."""
    return spark.range(slots, numPartitions=1).select(
        F.lit(1).alias("version"), F.col("id").cast("int").alias("vslot"), (F.col("id") % n_shards).cast("int").alias("shard")
    )


def edited(current: DataFrame, sizes: DataFrame, n_shards: int) -> DataFrame:
    """The next version of a map: shards above the mean give slots up, which go to the emptiest shards.

    Each shard keeps its largest slots as far as they fit into the mean; the others, largest first, go one by
    one to the shard with the fewest bytes. Slots of shards that no longer exist go too, so growing and
    shrinking are the same edit. All of this is over one row per slot, a fixed number.
    """
    rows = current.join(sizes, "vslot")
    mean = F.sum("bytes").over(Window.partitionBy()) / F.lit(n_shards)
    by_size = Window.partitionBy("shard").orderBy(F.desc("bytes"), "vslot").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("version", "vslot", "shard", "bytes", F.sum("bytes").over(by_size).alias("upto"), mean.alias("mean"))
    stays = (F.col("shard") < n_shards) & (F.col("upto") <= F.col("mean"))
    whole = rows.agg(
        (F.max("version") + 1).alias("version"),
        F.collect_list(F.when(stays, F.struct("shard", "bytes", "vslot"))).alias("stay"),
        F.sort_array(F.collect_list(F.when(~stays, F.struct((-F.col("bytes")).alias("less"), "vslot"))), True).alias("go"),
    )
    loads = F.transform(
        F.sequence(F.lit(0), F.lit(n_shards - 1)),
        lambda k: F.struct(
            F.aggregate(F.filter("stay", lambda s: s["shard"] == k), F.lit(0).cast("bigint"), lambda t, s: t + s["bytes"]).alias("load"),
            k.alias("shard"),
        ),
    )

    def place(state: Column, slot: Column) -> Column:
        to = F.array_min(state["loads"])
        return F.struct(
            F.transform(
                state["loads"],
                lambda x: F.when(
                    x["shard"] == to["shard"], F.struct((x["load"] - slot["less"]).alias("load"), x["shard"].alias("shard"))
                ).otherwise(x),
            ).alias("loads"),
            F.concat(state["made"], F.array(F.struct(to["shard"].alias("shard"), slot["vslot"].alias("vslot")))).alias("made"),
        )

    start = F.struct(F.col("loads"), F.array().cast("array<struct<shard:int,vslot:int>>").alias("made"))
    dealt = whole.withColumn("loads", loads).withColumn("made", F.aggregate("go", start, place, lambda s: s["made"]))
    kept = F.transform("stay", lambda s: F.struct(s["shard"].alias("shard"), s["vslot"].alias("vslot")))
    return dealt.select("version", F.explode(F.concat(kept, "made")).alias("m")).select("version", "m.vslot", "m.shard")


def store_map(slot_map: DataFrame, folder: str) -> None:
    """Add one version to the stored maps; each version is its own partition and never changes."""
    slot_map.coalesce(1).write.mode("append").partitionBy("version").parquet(folder)


def load_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """A stored version of the map, the newest by default."""
    stored = spark.read.schema("version int, vslot int, shard int").parquet(folder)
    if version is None:
        version = stored.agg(F.max("version")).head()[0]
    return stored.where(F.col("version") == version)


def shard_records(
    docs: DataFrame, n_shards: int, folder: str, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, carry: bool = False
) -> DataFrame:
    """``doc_id, size, text_crc32, vslot, shard, slot, map_version``: the shard of each row and its place there.

    With ``carry``, the columns of ``docs`` come along (in place of ``doc_id``); one that is named like a result
    gives way to it. Else texts aren't shuffled.

    Records hash into fixed slots, bytes are added up per slot, and the slot-to-shard map in ``folder``
    (made there when missing) is edited until the shards' bytes are near equal: law ``bytes``. A row's place
    counts from 0 without gaps: rows of the shard's earlier slots, then its place among its slot's rows, so
    a task orders one slot, not one shard. A null id or text hashes as such; rows that are equal in id and
    text share a slot; no documents: no rows.
    """
    spark = docs.sparkSession
    rows = records(docs, id_col, text_col, slots, carry)
    rows = rows if carry else settled(rows)
    sizes = settled(in_few_parts(slot_sizes(spark, rows, slots), slots))
    store_map(first_map(spark, n_shards, slots), folder)
    store_map(edited(load_map(spark, folder), sizes, n_shards), folder)
    earlier = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    places = load_map(spark, folder).join(sizes, "vslot").select(
        "vslot", "shard", F.col("version").alias("map_version"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")
    )
    within = Window.partitionBy("vslot").orderBy("_id" if carry else "doc_id", "text_crc32", "size")
    placed = rows.withColumn("nth", F.row_number().over(within)).join(F.broadcast(places), "vslot")  # a row per slot: SLOTS at most
    results = {"size", "text_crc32", "vslot", "shard", "slot", "map_version"}
    own = [F.col("_row")[c].alias(c) for c in docs.columns if c.lower() not in results] if carry else ["doc_id"]
    return placed.select(
        *own, "size", "text_crc32", "vslot", "shard", (F.col("before") + F.col("nth") - 1).alias("slot"), "map_version"
    )
