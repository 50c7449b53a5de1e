"""Neighbours by tiles against brute force."""

import hashlib
import random

from pyspark.sql import functions as F
from textgate import plans
from textgate.operators import tiles


def signed(x):
    return (x ^ 1 << 63) - (1 << 63)


def near_signatures(n, seed=5):
    """Groups of near signatures, some of them equal."""
    r = random.Random(seed)
    found = []
    for _ in range(n // 12):
        base = r.getrandbits(64)
        for _ in range(12):
            x = base
            for bit in r.choices(range(64), k=r.randrange(6)):
                x ^= 1 << bit
            found.append(x)
    return found


def test_pairs_of_rows_whatever_the_blocks_and_tiles(spark):
    sig = near_signatures(240)
    sig += sig[:5]
    rows = [(k, signed(x)) for k, x in enumerate(sig)]
    df = spark.createDataFrame([*rows, (None, 5), (7000, None)], "k long, sig long")
    want = [(i, j) for i in range(len(sig)) for j in range(i + 1, len(sig)) if (sig[i] ^ sig[j]).bit_count() <= 6]
    for blocks, tile in ((None, None), (7, None), (8, 5), (10, 40)):
        assert sorted(map(tuple, tiles.pairs(df, "k", 6, blocks, tile).collect())) == want
    assert not tiles.pairs(df.where("k < 0"), "k", 6).count()


def test_frequent_blocks_are_cut(spark):
    """No tile has more than two parts of about 20 rows, although blocks have more than 100."""
    df = spark.range(300).select(F.col("id").alias("k"), F.col("id").alias("sig"))
    cut = tiles.Tiles(df, 6, 8, 20)
    assert max(n.max() for _, n in cut.large.values()) == 6
    sizes = cut._keyed(tiles.StructType([*tiles.WIDTH.fields, *df.schema.fields]), True).groupBy(*tiles.KEY).count()
    assert sizes.agg(F.max("count")).first()[0] < 70


def test_planted_leaks_of_equal_signatures(spark, tmp_path):
    """Different keys whose signatures are equal each have their links, as in the statement."""
    seen = {}
    for g in range(400_000):
        h = hashlib.sha256(str(g).encode()).hexdigest()[:8]
        if h in seen:
            break
        seen[h] = g
    keys = [4 * x + i for x in (seen[h], g, 7) for i in range(4)]
    number = {k: int(hashlib.sha256(str(k // 4).encode()).hexdigest()[:8], 16) * 2**20 + k % 4 for k in keys}
    assert len(set(number.values())) == 8
    want = sorted((a, b) for a in keys for b in keys if a < b and a % 3 != b % 3 and (number[a] ^ number[b]).bit_count() <= 6)
    spark.createDataFrame([(k,) for k in keys], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    assert sorted(map(tuple, plans.QUERIES["j14_split_leaks"](spark, str(tmp_path)).collect())) == want
