"""Sharding by sampled splitters, all in Spark expressions.

Groups are rows of equal text. The law is ``bytes``: shards are near equal in
bytes, and a group stays in one shard if that shard can hold it.

Groups of over ``LARGE`` of a shard's bytes, of which there are few, are placed
first, the largest first, each on the shard with the least bytes so far. One that
no longer fits there, as any group over a shard's size, is left loose: its rows
are dealt like others, so that the shards stay near equal.

The rest is ordered by a hash of the text, so that groups are neighbours. A
sample drawn with a chance in proportion to size gives quantiles of that order,
the splitters, which cut it into ranges of about equal bytes. A group with more
rows than a range should have gets ranges of its own, dealt by row; any other
overfull range is cut again into equal spans of the hash. Inside the ranges,
which stay small whatever the data, running sums of bytes and rows are taken;
with the totals of the ranges before, each row knows how many bytes stand before
it, and so which shard's remaining room it falls into. A group goes where it
begins, so shards differ by at most two groups of ``LARGE`` of a shard's bytes.

Size is the UTF-8 bytes of the text plus 1; null text has no bytes and counts as
equal to empty text. Very long texts count with all their bytes; one that is over
a shard's size makes the shards unequal. Null keys sort first. Rows equal in text
and key are interchangeable and get different slots. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chronoloom.llm.shared import stored

SHARDS = 8
#: Rows that a range should have, ranges at least, sampled keys per range.
ROWS_PER_RANGE, LEAST_RANGES, SAMPLES_PER_RANGE = 250_000, 64, 64
#: Share of a shard's bytes above which a group is placed by itself; there are at most ``shards / LARGE`` such groups.
LARGE = 1 / 64
#: The splitters are looked up by the leading bits of the hash.
_PREFIX_BITS = 12


def _prefix(h: Column) -> Column:
    """Leading bits of the order, which is that of the signed hash."""
    return (F.shiftright(h, 64 - _PREFIX_BITS) + (1 << (_PREFIX_BITS - 1))).cast("int")


def _ranges(rows: DataFrame, n_ranges: int, total: int) -> DataFrame:
    """Splitters as a table by prefix: base (splitters below the prefix) and cuts (those inside). One row a prefix."""
    wanted = n_ranges * SAMPLES_PER_RANGE
    chance = F.pmod(F.xxhash64(F.lit("sample"), "h", "row"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    # a row counts as often as a unit of total / wanted fits into its size, the rest by chance
    copies = F.floor(F.col("size") * wanted / F.lit(total) + chance)
    sample = rows.select("h", copies.alias("copies")).where("copies > 0").groupBy("h").agg(F.sum("copies").alias("w"))
    ordered = sample.select("h", (F.sum("w").over(W.orderBy("h")) / SAMPLES_PER_RANGE).cast("long").alias("q"))
    cuts = ordered.groupBy("q").agg(F.min("h").alias("cut")).where("q > 0")
    prefixes = rows.sparkSession.range(1 << _PREFIX_BITS).select(F.col("id").cast("int").alias("prefix"))
    held = cuts.groupBy(_prefix(F.col("cut")).alias("prefix")).agg(F.sort_array(F.collect_list("cut")).alias("cuts"))
    joined = prefixes.join(held, "prefix", "left").select("prefix", F.coalesce("cuts", F.array().cast("array<bigint>")).alias("cuts"))
    below = F.sum(F.size("cuts")).over(W.orderBy("prefix").rowsBetween(W.unboundedPreceding, -1))
    return joined.select("prefix", "cuts", F.coalesce(below, F.lit(0)).cast("int").alias("base"))


def homes(groups: list[tuple[tuple, int]], shards: int, total: int) -> tuple[dict[tuple, int], list[int]]:
    """Shards of the large groups (name, bytes) that fit, and the bytes placed on each shard."""
    placed, load = {}, [0] * shards
    for name, size in sorted(groups, key=lambda g: (-g[1], g[0])):
        least = min(range(shards), key=lambda k: (load[k], k))
        if load[least] + size <= total / shards:
            placed[name] = least
            load[least] += size
    return placed, load


def shard(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, rows_per_range: int = ROWS_PER_RANGE, least_ranges: int = LEAST_RANGES) -> DataFrame:
    """One row per text: key, size, text_crc32, law, shard, slot (from 0 in each shard), grown_shard (null under this law)."""
    spark = docs.sparkSession
    full = F.coalesce(F.col(text), F.lit(""))
    rows = stored(docs.select(F.col(key).alias("key"), F.xxhash64(full).alias("h"), F.crc32(full.cast("binary")).alias("crc"), (F.octet_length(full) + 1).cast("long").alias("size"), F.monotonically_increasing_id().alias("row")), "shard-keys")
    totals = rows.agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).first()
    n, total = totals["n"], totals["bytes"] or 1
    n_ranges = max(least_ranges, -(-n // rows_per_range))
    fair = max(1, n // n_ranges)

    # groups that weigh or count much; at most shards / LARGE and n_ranges of them
    group = ["h", "crc", "size"]
    much = rows.groupBy(*group).agg(F.count("*").alias("n")).select(*group, "n", (F.col("n") * F.col("size")).alias("bytes")).where((F.col("bytes") > total / shards * LARGE) | (F.col("n") > fair))
    much = stored(much, "shard-groups")
    heavy = much.where((F.col("bytes") > total / shards * LARGE) & (F.col("bytes") <= total / shards))
    placed, load = homes([((r["h"], r["crc"], r["size"]), r["bytes"]) for r in heavy.collect()], shards, total)
    at = spark.createDataFrame([(*name, home) for name, home in placed.items()], "h bigint, crc bigint, size bigint, home int")
    known = much.join(F.broadcast(at), group, "left").select(*group, F.when(F.col("n") > fair, F.col("n")).alias("hot_rows"), "home", (F.col("home").isNull() & (F.col("bytes") > total / shards * LARGE)).alias("loose"))
    # the room that the others find in each shard, and where it ends on the line of their bytes
    rest = total - sum(load)
    room, ends = [max(0.0, total / shards - x) for x in load], []
    for x in room[:-1]:
        ends.append((ends[-1] if ends else 0.0) + x * rest / (sum(room) or 1))

    ranged = rows.join(known, group, "left").withColumn("prefix", _prefix(F.col("h"))).join(F.broadcast(_ranges(rows, n_ranges, total)), "prefix")
    ranged = ranged.withColumn("range", F.col("base") + F.size(F.filter("cuts", lambda c: c <= F.col("h")))).drop("prefix", "cuts", "base")
    # rows of hot groups: parts of about ``fair`` rows
    own = F.pmod(F.xxhash64(F.lit("part"), "row"), F.ceil(F.col("hot_rows") / fair).cast("long"))
    spans = ranged.where("hot_rows is null").groupBy("range").agg(F.count("*").alias("range_rows"), F.min("h").alias("low"), F.max("h").alias("high")).where(F.col("range_rows") > 2 * fair)
    cut = ranged.join(spans, "range", "left")
    width = F.col("high").cast("double") - F.col("low").cast("double") + 1
    again = F.floor((F.col("h").cast("double") - F.col("low").cast("double")) / width * F.ceil(F.col("range_rows") / fair))
    hot = F.when(F.col("hot_rows").isNotNull(), F.struct(*group))
    parted = cut.select("key", *group, "row", F.coalesce("home", F.lit(-1)).alias("home"), F.coalesce("loose", F.lit(False)).alias("loose"), "range", hot.alias("hot"), F.when(F.col("hot_rows").isNotNull(), own).otherwise(F.coalesce(again, F.lit(0))).alias("part"))

    name = ["home", "range", "hot", "part"]
    in_order = W.partitionBy(*name).orderBy(*group, F.col("key").asc_nulls_first(), "row")
    running = parted.select("*", F.row_number().over(in_order).alias("rank"), (F.sum("size").over(in_order.rowsBetween(W.unboundedPreceding, 0)) - F.col("size")).alias("bytes_before"))
    grouped = stored(running.select("*", F.min("bytes_before").over(W.partitionBy(*name, *group)).alias("group_begin")), "shard-ranks")
    # one row a part: rows that have no home first, then those of each home
    parts = grouped.groupBy(*name).agg(F.count("*").alias("part_rows"), F.sum("size").alias("part_bytes"))
    before = W.orderBy("home", "range", F.col("hot").asc_nulls_first(), "part").rowsBetween(W.unboundedPreceding, -1)
    offsets = parts.select("*", F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("rows0"), F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("bytes0"))
    # the parts of a hot group follow one another, so it begins with the first of them
    offsets = offsets.select(*[F.col(c).alias(f"{c}_") for c in name], "rows0", "bytes0", F.min("bytes0").over(W.partitionBy("home", "range", "hot")).alias("hot0"))
    begin = F.when(F.col("loose"), F.col("bytes0") + F.col("bytes_before")).when(F.col("hot").isNotNull(), F.col("hot0")).otherwise(F.col("bytes0") + F.col("group_begin"))
    chosen = F.when(F.col("home") >= 0, F.col("home")).otherwise(sum([(begin >= x).cast("int") for x in ends], F.lit(0)))
    on = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in name]
    ranked = stored(grouped.join(offsets, on).select("key", "size", "crc", (F.col("rows0") + F.col("rank") - 1).alias("place"), (F.col("home") >= 0).alias("at_home"), chosen.cast("int").alias("shard")), "shard-places")
    # two rows a shard
    first = ranked.groupBy("shard", "at_home").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    first = first.select("shard", "at_home", (F.col("first") - F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("at_home").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).alias("first"))
    return ranked.join(F.broadcast(first), ["shard", "at_home"]).select(
        F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
