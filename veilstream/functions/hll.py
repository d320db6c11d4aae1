"""Mergeable HyperLogLog: parity registers in relational form, and Spark's own sketches.

The parity form hashes with 64-bit FNV-1a and a Murmur finaliser and keeps a register per row (cell, idx, rho), so a merge
is a maximum and runs map-side first; estimates agree with the published ones bit for bit. The native form is
``hll_sketch_agg``; its bytes are another format.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilstream.plans.model import HLL_PRECISION

# FNV-1a offset and prime, the finaliser's factors, and the small-range alphas by number of registers.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
MIX_1, MIX_2 = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53
ALPHA = {16: 0.673, 32: 0.697, 64: 0.709}


def alpha(registers: int) -> float:
    return ALPHA.get(registers, 0.7213 / (1 + 1.079 / registers))


def _hash(users: pd.Series) -> np.ndarray:
    """Hashes of many texts: by classes of length, so that one long text doesn't pad all others."""
    raw = [str(u).encode() for u in users]
    lengths = np.fromiter((len(r) for r in raw), np.int64, len(raw))
    out = np.zeros(len(raw), np.uint64)
    classes = np.ceil(np.log2(np.maximum(lengths, 64))).astype(np.int64)
    for c in np.unique(classes):
        some = np.flatnonzero(classes == c)
        out[some] = _hash_padded([raw[i] for i in some], lengths[some])
    return out


def _hash_padded(raw: list[bytes], lengths: np.ndarray) -> np.ndarray:
    """Byte by byte over a padded matrix, in order of length."""
    out = np.full(len(raw), FNV_OFFSET, np.uint64)
    order = np.argsort(-lengths, kind="stable")
    widest = int(lengths.max(initial=0))
    table = np.frombuffer(b"".join(raw[i].ljust(widest, b"\0") for i in order), np.uint8).reshape(len(raw), widest) if widest else np.zeros((len(raw), 0), np.uint8)
    state = out[order]
    for k in range(widest):
        live = int(np.searchsorted(-lengths[order], -k, "left"))
        state[:live] = (state[:live] ^ table[:live, k]) * np.uint64(FNV_PRIME)
    for factor in (MIX_1, MIX_2):
        state = (state ^ (state >> np.uint64(33))) * np.uint64(factor)
    out[order] = state ^ (state >> np.uint64(33))
    return out


def hash64(user: Column) -> Column:
    """Signed 64-bit hash of the UTF-8 bytes."""

    @F.pandas_udf("long")
    def run(users: pd.Series) -> pd.Series:
        return pd.Series(_hash(users.fillna("")).view(np.int64)).where(users.notna().to_numpy(), None)

    return run(user)


def register(hashed: Column, precision: int = HLL_PRECISION) -> tuple[Column, Column]:
    """(idx, rho) of a hash: the top bits, and the place of the first set bit among the rest."""
    if not 4 <= precision <= 16:
        raise ValueError("precision must be between 4 and 16")
    idx = F.shiftrightunsigned(hashed, 64 - precision).cast("int")
    rest = F.shiftleft(hashed, precision)
    most = 64 - precision
    rho = F.when(rest == 0, F.lit(most)).otherwise(F.least(F.lit(65) - F.length(F.bin(rest)), F.lit(most)))
    return idx, rho.cast("int")


def registers(rows: DataFrame, keys: list[str], user: str = "user", precision: int = HLL_PRECISION) -> DataFrame:
    """(keys, idx, rho): the filled registers of each group's sketch."""
    idx, rho = register(F.col("__hash"), precision)
    distinct = rows.select(*keys, user).filter(F.col(user).isNotNull()).distinct()
    return distinct.withColumn("__hash", hash64(F.col(user))).select(*keys, idx.alias("idx"), rho.alias("rho")).groupBy(*keys, "idx").agg(F.max("rho").alias("rho"))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Registers of coarser groups: the largest of each."""
    return sketches.groupBy(*keys, "idx").agg(F.max("rho").alias("rho"))


def estimate(sketches: DataFrame, keys: list[str], precision: int = HLL_PRECISION) -> DataFrame:
    """(keys, estimate): raw estimate, or linear counting where registers are empty and the raw one is small."""
    m = 1 << precision
    sums = sketches.groupBy(*keys).agg(F.sum(F.pow(F.lit(2.0), -F.col("rho"))).alias("filled"), F.count("*").alias("used"))
    zeros = F.lit(m) - F.col("used")
    raw = F.lit(alpha(m) * m * m) / (F.col("filled") + zeros)
    linear = F.lit(float(m)) * F.log(F.lit(float(m)) / F.when(zeros > 0, zeros).otherwise(F.lit(1)))
    return sums.select(*keys, F.when((raw <= 2.5 * m) & (zeros > 0), linear).otherwise(raw).alias("estimate"))


def sketch_bytes(filled: Column, precision: int = HLL_PRECISION) -> Column:
    """A byte of precision, then a byte for each register, from an array of (idx, rho) of the filled ones."""

    @F.pandas_udf("binary")
    def run(rows: pd.Series) -> pd.Series:
        def one(pairs) -> bytes:
            values = np.zeros(1 << precision, np.uint8)
            for pair in pairs:
                values[pair["idx"]] = pair["rho"]
            return pack(values, precision)

        return rows.map(one)

    return run(filled)


def to_bytes(sketches: DataFrame, keys: list[str], precision: int = HLL_PRECISION) -> DataFrame:
    """(keys, users_hll). A sketch has at most 2**precision rows, so none is large."""
    return sketches.groupBy(*keys).agg(F.collect_list(F.struct("idx", "rho")).alias("__filled")).select(*keys, sketch_bytes(F.col("__filled"), precision).alias("users_hll"))


def from_bytes(rows: DataFrame, keys: list[str], sketch: str = "users_hll") -> DataFrame:
    """(keys, idx, rho) of stored sketches; nulls and sketches of a wrong length are left out."""
    hexed = F.hex(F.col(sketch))
    precision = F.conv(F.substring(hexed, 1, 2), 16, 10).cast("int")
    fine = F.col(sketch).isNotNull() & precision.between(4, 16) & (F.octet_length(F.col(sketch)) == F.lit(1) + F.shiftleft(F.lit(1), 12) * F.pow(F.lit(2.0), precision - 12))
    each = F.posexplode(F.transform(F.sequence(F.lit(0), (F.octet_length(F.col(sketch)) - 2).cast("int")), lambda i: F.conv(F.substring(hexed, i * 2 + 3, F.lit(2)), 16, 10).cast("int"))).alias("idx", "rho")
    return rows.filter(fine).select(*keys, each).filter("rho > 0")


def pack(values: np.ndarray, precision: int = HLL_PRECISION) -> bytes:
    """A sketch's bytes from a full array of registers."""
    return struct.pack("B", precision) + values.astype(np.uint8).tobytes()


def memory_bytes(precision: int = HLL_PRECISION) -> int:
    """Bytes of a sketch's registers, whatever it has counted."""
    return 1 << precision


def native_sketch(user: Column, precision: int = HLL_PRECISION) -> Column:
    """Aggregate: Spark's own sketch."""
    return F.hll_sketch_agg(user, F.lit(precision))


def native_merge(sketch: Column) -> Column:
    """Aggregate: union of Spark's sketches, which must agree in precision."""
    return F.hll_union_agg(sketch, F.lit(False))


def native_estimate(sketch: Column) -> Column:
    return F.hll_sketch_estimate(sketch)
