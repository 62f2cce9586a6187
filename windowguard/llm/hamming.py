"""Links between 64-bit fingerprints a few bits apart, in DataFrame functions only."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windowguard.session import stage

#: Buckets up to this size are compared pair by pair; larger ones are linked in another way.
SMALL_BUCKET = 64
#: Times a crowded bucket is split before its members meet in midpoints.
LEVELS = 2


def bit(i: int) -> int:
    """Bit i as a signed 64-bit number."""
    return 1 << i if i < 63 else -(1 << 63)


def apart(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def sized_buckets(keyed: DataFrame) -> DataFrame:
    """The rows of keys that more than one row has, with the size ``n`` of the bucket."""
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    return stage(keyed.join(stage(sizes, "sizes"), "key"), "buckets")


def bucket_pairs(buckets: DataFrame, node: str, size: int = SMALL_BUCKET) -> DataFrame:
    """Distinct pairs a < b that meet in a bucket of at most ``size`` rows."""
    small = buckets.where(F.col("n") <= size)
    left = small.select("key", F.col(node).alias("a"))
    right = small.select("key", F.col(node).alias("b"))
    return left.join(right, "key").where("a < b").select("a", "b").distinct()


def midpoint_links(prints: DataFrame) -> DataFrame:
    """Links between fingerprints at most two bits apart, without comparing pairs.

    Two of them share a value within one bit of both, and all that share such a value are within
    two bits of each other, so linking each to the least of them loses nothing. 65 rows each.
    """
    flips = F.array(*[F.lit(v).cast("long") for v in (0, *(bit(i) for i in range(64)))])
    near = prints.select("fp", F.explode(F.transform(flips, lambda f: F.col("fp").bitwiseXOR(f))).alias("middle"))
    least = near.groupBy("middle").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    return near.join(least, "middle").where("fp != b").select(F.col("fp").alias("a"), "b").distinct()


def links_within_two(keyed: DataFrame) -> DataFrame:
    """Links (a, b) that connect all fingerprints at most two bits apart.

    ``keyed`` has (key, fp), each distinct fingerprint once per key, such that fingerprints two bits
    apart or less share a key. A crowded bucket is split further: of the bits dealt into three parts,
    two errors leave one part exact. What is crowded after LEVELS such splits meets in midpoints.
    """
    links = None
    for level in range(LEVELS + 1):
        buckets = sized_buckets(keyed)
        close = bucket_pairs(buckets, "fp").where(apart("a", "b") <= 2)
        links = close if links is None else links.unionByName(close)
        crowded = stage(buckets.where(F.col("n") > SMALL_BUCKET).select("key", "fp"), "crowded")
        if crowded.isEmpty():
            return links
        keyed = crowded.select(F.explode(F.array(*_part_keys(level))).alias("key"), "fp")
    return links.unionByName(midpoint_links(stage(crowded.select("fp").distinct(), "crowded-prints")))


def _part_keys(level: int) -> list[Column]:
    """Keys of the three parts of a fingerprint: bits dealt out by a digit of their number in base three."""
    digit = [i // 3**level % 3 for i in range(64)]
    masks = [sum(bit(i) for i in range(64) if digit[i] == part) for part in range(3)]
    return [F.xxhash64("key", F.lit(part), F.col("fp").bitwiseAND(mask)) for part, mask in enumerate(masks)]


def block_keys(prints: DataFrame, blocks: int = 4, exact: int = 2) -> DataFrame:
    """(key, fp): each choice of ``exact`` out of ``blocks`` equal blocks of the bits.

    Fingerprints that differ in at most ``blocks - exact`` bits agree in one choice.
    """
    width = 64 // blocks
    one = (1 << width) - 1
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), exact)):
        parts = [F.shiftleft(F.shiftrightunsigned("fp", width * b).bitwiseAND(one), width * i) for i, b in enumerate(chosen)]
        keys.append(reduce(Column.bitwiseOR, parts).bitwiseOR(F.lit(number << (width * exact))))
    return prints.select(F.explode(F.array(*keys)).alias("key"), "fp")


#: Counters of nine bits, seven to a long; nine longs count the 63 low bits of up to 255 hashes.
LANE, LANES, SLICE = 9, 7, 255
_ONES = sum(1 << (LANE * j) for j in range(LANES))


def majority(hashed: DataFrame, keys: list[str], more: dict[str, tuple] | None = None) -> DataFrame:
    """63-bit SimHash ``fp`` and size ``n`` of the groups of ``keys``: bits set in over half of their hashes.

    ``hashed`` has the hashes ``h``, numbered by ``pos`` from 0 in their group, and the size ``n`` of
    the group. Hashes are counted in slices that the counters hold. In a group of one slice all
    counters are compared at once: adding 255 less half the size carries into the top bit of a
    counter exactly if it is more than half. In a larger one each counter is summed over the slices.
    ``more`` names further aggregates: one over the rows, and the function that merges its results.
    """
    more = more or {}
    ones, zero = F.lit(_ONES), F.lit(0).cast("long")
    sums = [F.sum(F.shiftrightunsigned("h", k).bitwiseAND(ones)).alias(f"p{k}") for k in range(LANE)]
    sums += [one.alias(name) for name, (one, _) in more.items()]
    slices = hashed.withColumn("slice", F.floor(F.col("pos") / SLICE)).groupBy(*keys, "slice").agg(F.max("n").alias("n"), *sums)
    half = F.floor(F.col("n") / 2)
    fill = (SLICE - half) * ones
    tops = [F.shiftrightunsigned(F.col(f"p{k}") + fill, LANE - 1).bitwiseAND(ones) for k in range(LANE)]
    at_once = reduce(Column.bitwiseOR, [F.shiftleft(t, k) for k, t in enumerate(tops)])
    one = (1 << LANE) - 1
    counts = [
        F.sum(F.shiftrightunsigned(f"p{k}", LANE * j).bitwiseAND(one)).alias(f"c{LANE * j + k}")
        for k in range(LANE)
        for j in range(LANES)
    ]
    counts += [merge(name).alias(name) for name, (_, merge) in more.items()]
    bits = [F.when(F.col(f"c{i}") > half, F.lit(1 << i)).otherwise(zero) for i in range(LANE * LANES)]
    # The size is an aggregate so that both branches filter one and the same result.
    small = slices.where(F.col("n") <= SLICE).select(*keys, "n", at_once.alias("fp"), *more)
    large = slices.where(F.col("n") > SLICE).groupBy(*keys, "n").agg(*counts)
    return small.unionByName(large.select(*keys, "n", reduce(Column.bitwiseOR, bits).alias("fp"), *more))
