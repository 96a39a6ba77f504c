"""Sharding by fixed virtual slots: records hash into 4096 slots, and a versioned map says which shard owns each slot.

The number of slots never changes, so a record keeps its slot for ever; only the map is edited. A version of the map
is a table of one row per slot with the bytes and rows last counted in it. Two edits exist. ``grow`` adds one shard,
which takes slots from every other shard and gives none, so rows move into it only; it depends on the number of shards
alone, so an id and the shard count decide where a row lies (law ``key``). ``rebalance`` keeps the number of shards and
moves the slots by which a shard lies over the mean of the counted bytes to the shards below it.

The map has as many rows as there are slots, whatever the data, so it is broadcast. Rows are placed without a
shuffle. Only the numbering inside the shards groups rows: equal (id, size, checksum) rows are counted before the
shuffle, and a slot is numbered in blocks of about a million different rows.

Defined results: a null text has no bytes, so size 1 and checksum 0. Rows without an id go by their text's checksum.
Repeated rows share the shard and have places of their own. Texts of any length only give their size and checksum.
An empty table gives no rows, and a map without bytes. Further columns of the input, whatever their names, take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import settle

C = F.col
SLOTS = 4096
BLOCK_ROWS = 1 << 20
#: copies of one row that a task writes out; a row with more is dealt over several tasks
COPIES = 1 << 16


def virtual_slot(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The slot of a record: the first three hexadecimal digits of the md5 of its id."""
    name = F.coalesce(C(doc_id).cast("string"), F.concat(F.lit("text "), checksum(text).cast("string")))
    return F.conv(F.substring(F.md5(name), 1, 3), 16, 10).cast("int")


def checksum(text: str = "text") -> Column:
    return F.crc32(F.coalesce(C(text), F.lit("")).cast("binary"))


def size(text: str = "text") -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def _owner(shard: Column, place: Column, n: Column) -> Column:
    """Owner and place in it once there are ``n`` shards, not ``n`` - 1: each hands over its last slots beyond an even share."""
    def even(k):
        return F.floor(F.lit(SLOTS) / k).cast("int"), F.lit(SLOTS) % k

    (was, more), (share, extra) = even(n - 1), even(n)
    keeps = share + (shard < extra).cast("int")
    given_before = shard * (was - share) + F.least(shard, more) - F.least(shard, extra)
    stays = place < keeps
    return F.struct(F.when(stays, shard).otherwise(n - 1).alias("shard"),
                    F.when(stays, place).otherwise(given_before + place - keeps).alias("place"))


def map_of(spark: SparkSession, shards: int) -> DataFrame:
    """The map for law ``key``: one shard owns every slot, then ``shards`` - 1 times ``grow``; not yet counted.

    Columns virtual_slot, version, shards, shard, place (of the slot in its shard), bytes, rows.
    """
    start = F.struct(F.lit(0).alias("shard"), C("id").cast("int").alias("place"))
    owner = start if shards < 2 else F.aggregate(F.sequence(F.lit(2), F.lit(shards)), start, lambda at, n: _owner(at["shard"], at["place"], n))
    none = F.lit(0).cast("long")
    return spark.range(0, SLOTS, 1, 1).select(
        C("id").cast("int").alias("virtual_slot"), F.lit(shards).alias("version"), F.lit(shards).alias("shards"), owner.alias("_o"),
        none.alias("bytes"), none.alias("rows")).select("virtual_slot", "version", "shards", "_o.shard", "_o.place", "bytes", "rows")


def grow(slot_map: DataFrame) -> DataFrame:
    """The next version of a map of law ``key``, with one shard more, to which the others hand over slots."""
    moved = slot_map.withColumn("_o", _owner(C("shard"), C("place"), C("shards") + 1))
    return moved.select("virtual_slot", (C("version") + 1).alias("version"), (C("shards") + 1).alias("shards"), "_o.shard", "_o.place",
                        "bytes", "rows")


def count_slots(slot_map: DataFrame, loads: DataFrame) -> DataFrame:
    """The same version with fresh ``bytes`` and ``rows`` from ``loads`` (virtual_slot, bytes, rows)."""
    return (slot_map.drop("bytes", "rows").join(loads, "virtual_slot", "left")
            .withColumns({c: F.coalesce(C(c), F.lit(0)).cast("long") for c in ("bytes", "rows")})
            .select("virtual_slot", "version", "shards", "shard", "place", "bytes", "rows"))


def slot_loads(docs: DataFrame) -> DataFrame:
    """(virtual_slot, bytes, rows), summed before the shuffle."""
    return docs.groupBy(virtual_slot().alias("virtual_slot")).agg(F.sum(size()).alias("bytes"), F.count(F.lit(1)).alias("rows"))


def rebalance(slot_map: DataFrame, shards: int | None = None) -> DataFrame:
    """The next version by law ``bytes``: counted bytes nearly even over ``shards`` (as many as before), few slots moved.

    A shard keeps its largest slots up to the mean. The slots beyond it are laid end to end along a line, as are the
    gaps of the shards below the mean; a slot goes to the gap that holds its middle. Every table here has at most as
    many rows as there are slots. The new map is not one of law ``key`` any more.
    """
    whole = Window.partitionBy()
    n = C("shards") if shards is None else F.lit(shards)
    laid = slot_map.withColumn("shards", n).withColumns({
        "_mean": F.sum("bytes").over(whole) / C("shards"),
        "_end": F.sum("bytes").over(Window.partitionBy("shard").orderBy(C("bytes").desc(), "virtual_slot"))})
    laid = laid.withColumn("_spare", (C("_end") > C("_mean")) | (C("shard") >= C("shards")))
    line = F.sum("bytes").over(whole.orderBy(C("bytes").desc(), "virtual_slot"))
    spare = laid.filter("_spare").withColumn("_middle", line - C("bytes") / 2)
    kept = laid.filter(~C("_spare")).groupBy("shard").agg(F.sum("bytes").alias("_has"))
    every = laid.agg(F.max("shards").alias("_n"), F.max("_mean").alias("_mean"))
    every = every.select(F.explode(F.sequence(F.lit(0), C("_n") - 1)).alias("shard"), "_mean")
    gaps = every.join(kept, "shard", "left").withColumn("_gap", C("_mean") - F.coalesce("_has", F.lit(0)))
    gaps = gaps.withColumn("_to", F.sum("_gap").over(whole.orderBy("shard")))
    end = F.when(C("_to") == F.max("_to").over(whole), F.lit(float("inf"))).otherwise(C("_to"))
    gaps = gaps.filter("_gap > 0").select(C("shard").alias("_new"), (C("_to") - C("_gap")).alias("_from"), end.alias("_to"))
    moved = spare.join(F.broadcast(gaps), (C("_middle") >= C("_from")) & (C("_middle") < C("_to")))
    out = laid.join(moved.select("virtual_slot", "_new"), "virtual_slot", "left").withColumn("shard", F.coalesce("_new", "shard").cast("int"))
    place = (F.row_number().over(Window.partitionBy("shard").orderBy("virtual_slot")) - 1).alias("place")
    return out.select("virtual_slot", (C("version") + 1).alias("version"), "shards", "shard", place, "bytes", "rows")


def place(docs: DataFrame, slot_map: DataFrame, name: str = "shard") -> DataFrame:
    """``docs`` with the shard of every row, in place; a column called ``name`` is replaced."""
    owner = slot_map.select(C("virtual_slot").alias("_slot"), C("shard").alias("_shard"))
    placed = docs.withColumn("_slot", virtual_slot()).join(F.broadcast(owner), "_slot", "left")
    return placed.drop("_slot", name).withColumnRenamed("_shard", name)


def write_shards(docs: DataFrame, slot_map: DataFrame, path: str) -> None:
    """Write ``docs`` under ``path``, one folder a shard."""
    place(docs, slot_map).write.partitionBy("shard").parquet(path)


def shards(docs: DataFrame, n: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (place in the shard), grown_shard; also virtual_slot and slot_bytes.

    ``grown_shard`` is the shard under the next version of the map, with ``n`` + 1 shards.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", size().alias("size"), checksum().alias("text_crc32"), virtual_slot().alias("virtual_slot"))
    rows = settle(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("copies")), "slot-rows")
    loads = settle(rows.groupBy("virtual_slot").agg(F.sum(C("size") * C("copies")).alias("bytes"), F.sum("copies").alias("rows"),
                                                    F.count(F.lit(1)).alias("different")), "slot-loads")
    now = count_slots(map_of(spark, n), loads.drop("different"))
    versions = settle(now.unionByName(grow(now)), "slot-map")
    old, new = (versions.filter(C("version") == v) for v in (n, n + 1))
    before = F.sum("rows").over(Window.partitionBy("shard").orderBy("place")) - C("rows")
    owners = (old.select("virtual_slot", "shard", C("bytes").alias("slot_bytes"), before.alias("_slot_at"))
              .join(new.select("virtual_slot", C("shard").alias("grown_shard")), "virtual_slot"))

    blocks = (loads.agg(F.coalesce(F.sum("different"), F.lit(0))).first()[0] >> 20) + 1
    key = ["virtual_slot", "_block"]
    rows = rows.withColumn("_block", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(blocks)))
    sums = rows.groupBy(*key).agg(F.sum("copies").alias("_n"))
    sums = sums.select(*key, (F.sum("_n").over(Window.partitionBy("virtual_slot").orderBy("_block")) - C("_n")).alias("_block_at"))
    inside = Window.partitionBy(*key).orderBy(C("doc_id").asc_nulls_last(), "size", "text_crc32")
    numbered = rows.withColumn("_at", F.sum("copies").over(inside) - C("copies"))
    numbered = numbered.join(sums, key).join(F.broadcast(owners), "virtual_slot")
    numbered = numbered.withColumn("_at", C("_slot_at") + C("_block_at") + C("_at"))

    few = numbered.filter(C("copies") <= COPIES).select("*", F.explode(F.sequence(F.lit(0).cast("long"), C("copies") - 1)).alias("_k"))
    many = numbered.filter(C("copies") > COPIES).select("*", F.explode(F.sequence(F.lit(0).cast("long"), C("copies") - 1, F.lit(COPIES).cast("long"))).alias("_part"))
    many = many.repartition("virtual_slot", "_part").select(
        *numbered.columns, F.explode(F.sequence(C("_part"), F.least(C("_part") + COPIES, C("copies")) - 1)).alias("_k"))
    return few.unionByName(many).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (C("_at") + C("_k")).alias("slot"), "grown_shard",
        "virtual_slot", "slot_bytes")
