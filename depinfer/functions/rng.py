"""Counter-based randomness: a draw is a hash of its seed and counters, so it does not depend on partitioning."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F


def bits52(seed: int | str, *counters) -> Column:
    """52 random bits as a long."""
    key = F.concat_ws(":", F.lit(str(seed)), *(c.cast("string") if isinstance(c, Column) else F.lit(str(c)) for c in counters))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long")


def uniform(seed: int | str, *counters) -> Column:
    """Uniform on [0, 1)."""
    return bits52(seed, *counters) / F.lit(float(1 << 52))


def normal(seed: int | str, *counters) -> Column:
    """Standard normal, by the Box-Muller transform."""
    u, v = uniform(f"{seed}/u", *counters), uniform(f"{seed}/v", *counters)
    return F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u)) * F.cos(F.lit(2.0) * F.pi() * v)


def below(n, seed: int | str, *counters) -> Column:
    """Uniform on 0 .. n - 1."""
    return F.floor(uniform(seed, *counters) * n).cast("long")


def bits52_of(seed: int | str, counters):
    """:func:`bits52` of an array of counters from 0 on, without Spark: the same MD5 on arrays of words."""
    import numpy as np

    head = f"{seed}:".encode()
    table = (np.abs(np.sin(np.arange(1, 65))) * 2.0**32).astype(np.uint32)
    turns = [x for row in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for x in row * 4]
    out = np.empty(len(counters), np.int64)
    digits = np.ones(len(counters), np.int64)
    for power in range(1, 19):
        digits += counters >= 10**power
    for width in np.unique(digits):
        which = np.flatnonzero(digits == width)
        rest, size = counters[which], len(head) + int(width)
        if size > 55:
            raise ValueError("a seed is too long for one block")
        block = np.zeros((64, len(which)), np.uint8)
        block[: len(head)] = np.frombuffer(head, np.uint8)[:, None]
        for at in range(size - 1, len(head) - 1, -1):
            rest, digit = np.divmod(rest, 10)
            block[at] = digit + 48
        block[size] = 128
        block[56], block[57] = (8 * size) & 255, (8 * size) >> 8
        words = np.zeros((16, len(which)), np.uint32)
        for at in range(64):
            if at <= size or at in (56, 57):
                words[at // 4] |= block[at].astype(np.uint32) << np.uint32(8 * (at % 4))
        start = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
        a, b, c, d = (np.full(len(which), x) for x in start)
        for i in range(64):
            if i < 16:
                f, g = d ^ (b & (c ^ d)), i
            elif i < 32:
                f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
            elif i < 48:
                f, g = b ^ c ^ d, (3 * i + 5) % 16
            else:
                f, g = c ^ (b | ~d), 7 * i % 16
            f = f + a
            f += table[i]
            f += words[g]
            a, d, c, turn = d, c, b, turns[i]
            b = b + ((f << np.uint32(turn)) | (f >> np.uint32(32 - turn)))
        a, b = (a + start[0]).byteswap().astype(np.int64), (b + start[1]).byteswap().astype(np.int64)
        out[which] = (a << 20) | (b >> 12)
    return out


def below_of(n: int, seed: int | str, counters):
    """:func:`below` of an array of counters."""
    import numpy as np

    return np.floor(bits52_of(seed, counters) / float(1 << 52) * n).astype(np.int64)


# Executors need no copy of the package for the functions that they run.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
