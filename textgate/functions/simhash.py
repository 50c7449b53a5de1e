"""64-bit SimHash over character 4-grams, and complete indexes for a Hamming radius."""

from __future__ import annotations

import hashlib
import math
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Skeletons have these characters only; four of them are one of 2 ** 20 numbers.
ALPHABET = " <>abcdefghijklmnopqrstuvwxyz"
_CODES = np.full(128, 255, np.uint8)
_CODES[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))
_HASHES = np.zeros(1 << 20, ">u8")
_KNOWN = np.zeros(1 << 20, bool)


def _gram(gram: str) -> int:
    return int.from_bytes(hashlib.blake2b(gram.encode(), digest_size=8).digest(), "big")


def _numbers(padded: str) -> np.ndarray | None:
    """The numbers of a text's 4-grams; nothing for a text with other characters."""
    if not padded.isascii():
        return None
    codes = _CODES[np.frombuffer(padded.encode(), np.uint8)].astype(np.int32)
    if (codes == 255).any():
        return None
    return codes[:-3] << 15 | codes[1:-2] << 10 | codes[2:-1] << 5 | codes[3:]


def signature(value: str) -> int:
    """Unsigned signature: a bit is 1 where at least half of the grams have it."""
    padded = f"  {value}  "
    numbers = _numbers(padded)
    if numbers is None:
        hashes = np.array([_gram(padded[i : i + 4]) for i in range(len(padded) - 3)], ">u8")
    else:
        for n in np.unique(numbers[~_KNOWN[numbers]]).tolist():
            _HASHES[n] = _gram("".join(ALPHABET[n >> s & 31] for s in (15, 10, 5, 0)))
            _KNOWN[n] = True
        hashes = _HASHES[numbers]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # long texts in pieces
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones >= len(hashes)).tobytes(), "big")


def simhash64(skeleton: Column) -> Column:
    """The signature as a signed long."""

    @F.pandas_udf("long")
    def convert(values: pd.Series) -> pd.Series:
        return values.map(lambda v: (signature(v or "") ^ 1 << 63) - (1 << 63)).astype("int64")

    return convert(skeleton)


def _cuts(blocks: int) -> list[tuple[int, int]]:
    """(offset, width) of the blocks; the first ones are a bit wider."""
    base, wider = divmod(64, blocks)
    out, at = [], 0
    for i in range(blocks):
        out.append((at, base + (i < wider)))
        at += out[-1][1]
    return out


def _block(sig: Column, offset: int, width: int) -> Column:
    return F.shiftrightunsigned(sig, offset).bitwiseAND(F.lit((1 << width) - 1))


def bands(sig: Column, radius: int = 6) -> Column:
    """radius + 1 disjoint blocks: signatures within the radius share one of them."""
    if not 0 <= radius < 64:
        raise ValueError("radius must be in [0, 63]")
    return F.array(*[F.struct(F.lit(i).alias("band"), _block(sig, o, w).alias("value")) for i, (o, w) in enumerate(_cuts(radius + 1))])


def block_keys(sig: Column, radius: int = 6, blocks: int = 8) -> Column:
    """Keys for larger tables: every choice of ``blocks - radius`` blocks, of which pairs within the
    radius share one at least. More blocks make wider keys, hence smaller buckets, and more keys."""
    cuts = _cuts(blocks)
    return F.array(*[
        F.xxhash64(F.lit(n), *[_block(sig, *cuts[i]) for i in chosen]) for n, chosen in enumerate(combinations(range(blocks), blocks - radius))
    ])


#: A key is made, shuffled and sorted in about the time of so many comparisons.
KEY_COST = 60


def best_blocks(distinct: int, informative: int = 64, radius: int = 6, key_cost: int = KEY_COST) -> int:
    """How many blocks make the fewest comparisons among so many signatures: more blocks are more keys
    of more bits each. ``informative`` bits tell signatures apart."""

    def cost(blocks: int) -> float:
        keys, bits = math.comb(blocks, radius), informative * (blocks - radius) / blocks
        return keys * (key_cost + distinct / 2**bits)

    return min(range(radius + 1, radius + 6), key=cost)


def _targets(shares: list[float], blocks: int) -> list[int]:
    """Where each bit goes, so that each block has as many that tell signatures apart."""
    by_news = sorted(range(64), key=lambda i: (-shares[i] * (1 - shares[i]), i))
    free = [[o + k for k in range(w)] for o, w in _cuts(blocks)]
    target = [0] * 64
    turn = 0
    for bit in by_news:
        while not free[turn % blocks]:
            turn += 1
        target[bit] = free[turn % blocks].pop(0)
        turn += 1
    return target


def spread_bits(sig: Column, shares: list[float], blocks: int) -> Column:
    """The signature with its bits dealt anew, so that each block has as many that tell signatures apart.

    ``shares`` has of each bit (from the lowest) how often it is 1. Distances stay as they are.
    """
    return reduce(Column.bitwiseOR, [F.shiftleft(_block(sig, i, 1), to) for i, to in enumerate(_targets(shares, blocks))])


def block_masks(shares: list[float], blocks: int) -> list[int]:
    """The bits of each block of ``spread_bits``, where they are in the signature."""
    target = _targets(shares, blocks)
    return [sum(1 << i for i in range(64) if o <= target[i] < o + w) for o, w in _cuts(blocks)]


def first_key(differing: Column, radius: int = 6, blocks: int = 8) -> Column:
    """The place in ``block_keys`` of the first key that two signatures share, from the bits in which they differ."""
    same = [_block(differing, o, w) == 0 for o, w in _cuts(blocks)]
    chosen = enumerate(combinations(range(blocks), blocks - radius))
    return F.coalesce(*[F.when(reduce(Column.__and__, [same[i] for i in c]), F.lit(n)) for n, c in chosen])


def is_first_key(differing: Column, place: Column, radius: int = 6, blocks: int = 8) -> Column:
    """Whether the key at ``place``, which two signatures share, is their ``first_key``: that one has the first blocks in
    which they are equal, so that before its last block they are equal in its own blocks only. A few operations,
    where ``first_key`` is code too long for the JVM to compile."""
    last = F.element_at(F.array(*[F.lit(c[-1]) for c in combinations(range(blocks), blocks - radius)]), place + 1)
    equal = [F.when((_block(differing, o, w) == 0) & (F.lit(i) < last), 1).otherwise(0) for i, (o, w) in enumerate(_cuts(blocks)[:-1])]
    return reduce(Column.__add__, equal, F.lit(0)) == blocks - radius - 1


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
