"""Keyed permutations as expressions: a shuffle of any size without a sort, a table or state.

A place below ``size`` is a pair of digits of radix a = ceil(sqrt(size)) and
b = ceil(size / a).  A Feistel network adds, in turn, a digest of the key and one
digit to the other, which is a bijection of the a * b pairs; what falls on one of
the fewer than ``a`` pairs past ``size`` goes through the network again until it
doesn't (cycle walking), at most as often as there are such pairs.  One place in
sqrt(size) has to, so the steps are few on the whole.

Sizes are below 2^53.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 6


def radices(size: int) -> tuple[int, int]:
    a = math.isqrt(max(size, 1) - 1) + 1
    return a, -(-size // a)


def _digit(x: Column, radix: int) -> Column:
    return ((x - x % radix) / radix).cast("long")


def permuted(place: Column, size: int, key: Column) -> Column:
    """Where ``place`` (0 to ``size`` - 1) goes under the permutation of ``key``, a string."""
    a, b = radices(size)
    mixed = lambda i, digit: F.conv(F.substring(F.md5(F.concat_ws(":", key, i.cast("string"), digit.cast("string"))), 1, 8), 16, 10).cast("long")

    def round(x: Column, i: Column) -> Column:
        high, low = _digit(x, b), x % b
        return F.when(i % 2 == 0, (high + mixed(i, low)) % a * b + low).otherwise(high * b + (low + mixed(i, high)) % b)

    through = lambda x: F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), x, round)
    spare = a * b - size
    if not spare:
        return through(place.cast("long"))
    # evaluated once for each row; walking is left out where it isn't needed
    walk = lambda x: F.when(x < size, x).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(spare)), x, lambda y, _: F.when(y < size, y).otherwise(through(y))))
    return F.transform(F.array(through(place.cast("long"))), walk)[0]


def permuted_index(place: int, size: int, key: str) -> int:
    """The same for one place."""
    a, b = radices(size)
    mixed = lambda i, digit: int(hashlib.md5(f"{key}:{i}:{digit}".encode()).hexdigest()[:8], 16)
    x = place
    while True:
        for i in range(ROUNDS):
            high, low = divmod(x, b)
            x = (high + mixed(i, low)) % a * b + low if i % 2 == 0 else high * b + (low + mixed(i, high)) % b
        if x < size:
            return x


def sql(place: str, size: str, key: str) -> str:
    """The same in DuckDB's SQL, for expressions over columns; ``size`` may be one, too."""
    a, b = f"ceil(sqrt({size}))::bigint", f"ceil({size} / ceil(sqrt({size})))::bigint"
    mixed = lambda i, digit: f"('0x' || substr(md5({key} || ':' || {i} || ':' || {digit}), 1, 8))::bigint"
    high, low = f"(at_ // ({b}))", f"(at_ % ({b}))"  # names that no column has
    step = f"case when nth_ % 2 = 0 then ({high} + {mixed('nth_', low)}) % ({a}) * ({b}) + {low} else {high} * ({b}) + ({low} + {mixed('nth_', high)}) % ({b}) end"
    through = lambda x: f"list_reduce(list_prepend(({x})::bigint, range({ROUNDS})), lambda at_, nth_: {step})"
    return f"list_reduce(list_prepend({through(place)}, range((({a}) * ({b}) - {size})::bigint)), lambda to_, walk_: case when to_ < {size} then to_ else {through('to_')} end)"
