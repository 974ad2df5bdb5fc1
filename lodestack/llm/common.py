"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.session import cut_lineage

#: Tables with at most this many rows may be broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus


def row_key(id_col: str, text_col: str) -> Column:
    """64-bit key of a row. Rows that agree in id and text share it, and then also every result that depends on both."""
    return F.xxhash64(F.col(id_col).cast("string"), F.col(text_col))


def small_or_shuffled(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (staged, so that counting is cheap) with a broadcast hint if it has at most ``limit`` rows, else as it is."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


#: Bits of the map of ``only_known``: 2**MAP_BITS at most (16 MB), which go to every executor.
MAP_BITS = 27


def only_known(rows: DataFrame, keys: DataFrame, key: str, limit: int = BROADCAST_ROWS, bits: int = MAP_BITS, exact: bool = True) -> DataFrame:
    """The rows of ``rows`` whose long ``key`` is one of ``keys`` (staged, distinct). More than ``limit`` keys are looked up by a
    shuffle, to which only rows go whose key has its bit in a map of some eight places for each key. Without ``exact`` the map
    alone decides while it is sparse, so that some rows of other keys stay and nothing is shuffled."""
    n = keys.count()
    if n <= limit:
        return rows.join(F.broadcast(keys), key, "left_semi")
    places = 1 << max(15, min(bits, (8 * n).bit_length()))
    place = F.pmod(F.xxhash64(key), F.lit(places))
    part, at = F.shiftright(place, 15), place.bitwiseAND(F.lit(32767))
    maps = keys.groupBy(part.alias("_own")).agg(F.bitmap_construct_agg(at).alias("_map"))
    byte = F.conv(F.hex(F.substring("_map", (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    joined = rows.withColumn("_part", part).join(F.broadcast(maps), F.col("_part") == F.col("_own"))
    marked = joined.filter(F.getbit(byte, at.bitwiseAND(F.lit(7)).cast("int")) == 1).select(*rows.columns, "_own")
    if not exact and 4 * n <= places:
        return marked.select(*rows.columns)
    # The part that the map names is a key as well: else the semi join, and its shuffle, would be done before the map is asked.
    return marked.join(keys.select(key, part.alias("_own")), [key, "_own"], "left_semi").select(*rows.columns)


def pieces(spark: SparkSession) -> int:
    """Number of pieces for work that Spark does not size by itself: the shuffle parallelism of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a, b) of longs as (id, root), root being the smallest id.

    Alternating large-star and small-star steps; every step is an aggregate and an equi-join, and each round ends in a
    reliable checkpoint. Nodes without an edge, and edges from a node to itself, are left out. No edges: no rows.
    """
    state = None
    edges = cut_lineage(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut_lineage(large)
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut_lineage(small.unionAll(floor.select("u", F.col("m").alias("v"))).distinct())
        seen = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if seen == state:
            break
        state = seen
    stars = edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return stars.unionAll(stars.select(F.col("root").alias("id"), "root").distinct())
