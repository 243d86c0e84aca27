"""Random numbers as functions of keys.

A draw is a hash of (key columns, draw number, seed, salt), never of a partition, so it is
the same after a retry, on any cluster size, and in any engine with md5.  ``fast=True``
swaps md5 for xxhash64 (same distribution, several times cheaper, Spark only).
"""

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

LANES = 4            # Poisson weights taken from one hash value
_LANE_HEX = 8        # hex digits (32 bits) per weight
_TWO48 = float(2 ** 48)


def poisson_thresholds(bits: int = 32, rate: int = 1) -> list[int]:
    """Poisson distribution function in units of 2**-bits, up to full precision."""
    out, term, total, k = [], math.exp(-rate), math.exp(-rate), 0
    while total < 1 - 2.0 ** -bits:
        out.append(int(total * 2 ** bits))
        k += 1
        term *= rate / k
        total += term
    return out


def hex_threshold(t: int) -> str:
    return format(t, f"0{_LANE_HEX}x")


def _text(keys) -> list[Column]:
    return [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]


def hash_hex(keys, seed: int, salt: str) -> Column:
    return F.md5(F.concat_ws("|", *_text(keys), F.lit(str(seed)), F.lit(salt)))


def hash48(keys, seed: int, salt: str, fast: bool = False) -> Column:
    """A uniform integer in [0, 2**48)."""
    if fast:
        return F.shiftrightunsigned(
            F.xxhash64(*_text(keys), F.lit(seed), F.lit(salt)), 16)
    return F.conv(F.substring(hash_hex(keys, seed, salt), 1, 12), 16, 10).cast("bigint")


def uniform(keys, seed: int, salt: str, fast: bool = False) -> Column:
    """Uniform on the open interval (0, 1)."""
    return (hash48(keys, seed, salt, fast).cast("double") + F.lit(0.5)) / F.lit(_TWO48)


def normal(keys, seed: int, salt: str, fast: bool = False) -> Column:
    """Standard normal by Box-Muller from two salts."""
    u1 = uniform(keys, seed, salt + "-r", fast)
    u2 = uniform(keys, seed, salt + "-a", fast)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0) * F.pi() * u2)


def with_draws(df: DataFrame, draws: int, name: str = "draw") -> DataFrame:
    """One copy of every row per draw number 0..draws-1."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))


def _weight_of(lane: Column, thresholds: list) -> Column:
    out = F.when(lane < thresholds[0], 0)
    for k, t in enumerate(thresholds[1:], 1):
        out = out.when(lane < t, k)
    return out.otherwise(len(thresholds))


def _hashes(keys, seed: int, salt: str, fast: bool) -> Column:
    """What LANES uniform values are taken from: two numbers, or the hex text of md5."""
    if not fast:
        return hash_hex(keys, seed, salt)
    return F.array(F.xxhash64(*_text(keys), F.lit(seed), F.lit(salt)),
                   F.xxhash64(*_text(keys), F.lit(seed), F.lit(salt + "+")))


def _lanes(h: str, fast: bool) -> list[Column]:
    """LANES uniform 32-bit values of _hashes(): numbers, or hex texts."""
    if not fast:
        return [F.substring(h, 1 + _LANE_HEX * i, _LANE_HEX) for i in range(LANES)]
    return [F.shiftrightunsigned(F.col(h)[i // 2], 32) if i % 2 == 0
            else F.col(h)[i // 2].bitwiseAND(F.lit(2 ** 32 - 1)) for i in range(LANES)]


def with_poisson_weights(df: DataFrame, draws: int, keys, seed: int, salt: str,
                         fast: bool = False, draw: str = "draw", weight: str = "weight",
                         first: int = 0) -> DataFrame:
    """Every row once per draw (first..draws-1) in which its Poisson(1) weight is positive.

    One hash value serves LANES draws, so hashing costs a quarter of the row copies.
    """
    blocks = F.sequence(F.lit(first // LANES), F.lit((draws + LANES - 1) // LANES - 1))
    out = df.withColumn("_block", F.explode(blocks))
    cuts = [F.lit(t if fast else hex_threshold(t)) for t in poisson_thresholds()]
    out = out.withColumn("_h", _hashes([*keys, "_block"], seed, salt, fast))
    pairs = F.array(*[F.struct((F.col("_block") * LANES + i).alias(draw),
                               _weight_of(lane, cuts).alias(weight))
                      for i, lane in enumerate(_lanes("_h", fast))])
    return (out.select(*df.columns, F.explode(pairs).alias("_p"))
            .where((F.col(f"_p.{draw}") >= first) & (F.col(f"_p.{draw}") < draws)
                   & (F.col(f"_p.{weight}") > 0))
            .select(*df.columns, f"_p.{draw}", f"_p.{weight}"))


#: The largest rate with a table of its own: no Poisson(1) weight above is larger.
MAX_RATE = len(poisson_thresholds())


def with_rate_weights(df: DataFrame, rate: str, draws: int, keys, seed: int, salt: str,
                      fast: bool = False, draw: str = "draw",
                      weight: str = "weight") -> DataFrame:
    """Every row once per draw in which its Poisson(rate) weight is positive; rate 1, 2, ...

    The sum of w independent Poisson(1) weights is Poisson(w): a row that counts w times needs one
    hash, not w copies.  A rate above MAX_RATE is cut into parts with weights of their own, which
    may give a row several times in a draw; sums are right.
    """
    last = F.floor((F.col(rate) - 1) / MAX_RATE)
    tables = [poisson_thresholds(rate=r) for r in range(1, MAX_RATE + 1)]
    blocks = F.sequence(F.lit(0), F.lit((draws + LANES - 1) // LANES - 1))
    # a chain of conditions for all rates is long and was slow, so a
    # table is an array: few of its values decide nearly all lanes, the others count the rest
    table = F.array(*[F.array(*[F.lit(c if fast else hex_threshold(c)) for c in t]) for t in tables])
    own = F.least(F.lit(MAX_RATE), F.col(rate) - F.col("_part") * MAX_RATE).cast("int")
    out = (df.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
           .withColumn("_block", F.explode(blocks)))
    out = out.select(*df.columns, "_block", F.get(table, own - 1).alias("_t"),
                     _hashes([*keys, "_part", "_block"], seed, salt, fast).alias("_h"))

    def weight_of(lane):
        found = F.when(lane < F.col("_t")[0], 0)
        for k in range(1, 4):
            found = found.when(lane < F.col("_t")[k], k)
        return found.otherwise(F.size(F.filter("_t", lambda c: c <= lane)))
    pairs = F.array(*[F.struct((F.col("_block") * LANES + i).alias(draw),
                               weight_of(lane).alias(weight))
                      for i, lane in enumerate(_lanes("_h", fast))])
    return (out.select(*df.columns, F.explode(pairs).alias("_p"))
            .where((F.col(f"_p.{draw}") < draws) & (F.col(f"_p.{weight}") > 0))
            .select(*df.columns, f"_p.{draw}", f"_p.{weight}"))


def poisson_rate_weight(u: Column, rate: Column, terms: int = 12) -> Column:
    """Poisson(rate) weight, rate <= 1, by inverting its distribution function at u."""
    total = term = F.exp(-rate)
    out = F.when(u < total, 0)
    for k in range(1, terms):
        term = term * rate / k
        total = total + term
        out = out.when(u < total, k)
    return out.otherwise(terms)


def row_seed(keys, seed: int, salt: int) -> Column:
    """64-bit seed of a row, for numpy generators inside pandas UDFs."""
    return F.xxhash64(*_text(keys), F.lit(seed), F.lit(salt))


def _generator(seed: int) -> np.random.Generator:
    return np.random.default_rng(seed & 0xFFFFFFFFFFFFFFFF)


def binomial_array(size, prob, seed, draws: int) -> Column:
    """ARRAY of `draws` Binomial(size, prob) variates, seeded by the row."""
    @F.pandas_udf("array<bigint>")
    def variates(n: pd.Series, p: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([_generator(k).binomial(int(a), float(b), draws)
                          for a, b, k in zip(n, p, s)])
    return variates(size, prob, seed)


_EXACT = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 4_096)))])     # log of k!


def _log_factorial_ratio(b: np.ndarray, d: np.ndarray) -> np.ndarray:
    """log((b + d)! / b!): differences of a table of small factorials and of Stirling's series;
    where both are large, the series' difference, which loses no digits."""
    a = b + d
    with np.errstate(divide="ignore", invalid="ignore"):
        large = ((b + 0.5) * np.log1p(d / b) + d * np.log(a) - d + (1 / a - 1 / b) / 12
                 - (1 / a ** 3 - 1 / b ** 3) / 360)
        ends = [np.where(x < len(_EXACT), _EXACT[np.minimum(x, len(_EXACT) - 1).astype(np.int64)],
                         (x + 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x))
                for x in (a, b)]
    return np.where(np.minimum(a, b) < len(_EXACT), ends[0] - ends[1], large)


def _uniforms(seeds: np.ndarray, counter: np.ndarray) -> np.ndarray:
    """Uniform on (0, 1] from a seed and a counter each (a one-to-one scrambling of 64 bits)."""
    with np.errstate(over="ignore"):
        z = seeds + (counter.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return ((z >> np.uint64(11)) + np.uint64(1)).astype(np.float64) * 2.0 ** -53


def hypergeometric(seeds, good, total, sample, draws: int) -> np.ndarray:
    """[rows, draws] exact hypergeometric variates for populations of any size, all rows of a
    batch at once: ratio of uniforms, seeded per row.

    The distribution is log-concave, so Stadlober's hat around its mean covers it; a candidate
    is accepted by its probability relative to the mode's.
    """
    seeds = np.asarray(seeds).astype(np.int64).view(np.uint64)
    good, total, sample = (np.asarray(x, dtype=np.int64) for x in (good, total, sample))
    low, high = np.maximum(0, sample - (total - good)), np.minimum(good, sample)
    # (in whole numbers: products of two counts do not fit 64 bits)
    mode = np.array([min(max((int(s) + 1) * (int(g) + 1) // (int(n) + 2), int(lo)), int(hi))
                     for s, g, n, lo, hi in zip(sample, good, total, low, high, strict=True)],
                    dtype=np.int64)
    n = np.maximum(total, 2)
    p = good / np.maximum(total, 1)
    mean = sample * p
    var = mean * (1 - p) * ((total - sample) / (n - 1))
    width = 2 * math.sqrt(2 / math.e) * np.sqrt(var + 0.5) + 3 - 2 * math.sqrt(3 / math.e)
    out = np.repeat(low[:, None], draws, axis=1)
    row = np.repeat(np.arange(len(good)), draws)
    left = np.flatnonzero((low < high)[row])
    attempt = 0
    while len(left):
        r = row[left]
        at = (attempt * draws + left % draws) * 2
        u, v = _uniforms(seeds[r], at), _uniforms(seeds[r], at + 1)
        step = np.floor((mean - mode)[r] + 0.5 + width[r] * (v - 0.5) / u)
        fits = (step >= (low - mode)[r]) & (step <= (high - mode)[r])
        k = np.where(fits, step, 0.0)
        g, m, s, t = (x[r] for x in (good, mode, sample, total))
        relative = -(_log_factorial_ratio(m.astype(float), k)
                     + _log_factorial_ratio((g - m).astype(float), -k)
                     + _log_factorial_ratio((s - m).astype(float), -k)
                     + _log_factorial_ratio((t - g - s + m).astype(float), k))
        fine = fits & (2 * np.log(u) <= relative)
        out[r[fine], left[fine] % draws] = m[fine] + k[fine].astype(np.int64)
        left = left[~fine]
        attempt += 1
    return out


def hypergeometric_array(good, total, sample, seed, draws: int) -> Column:
    """ARRAY of `draws` hypergeometric variates: good items in a sample without replacement."""
    @F.pandas_udf("array<bigint>")
    def variates(g: pd.Series, n: pd.Series, m: pd.Series, s: pd.Series) -> pd.Series:
        # some million numbers at a time
        size = max(1, 1_000_000 // draws)
        return pd.Series([row for i in range(0, len(g), size) for row in hypergeometric(
            s[i:i + size], g[i:i + size], n[i:i + size], m[i:i + size], draws)])
    return variates(good, total, sample, seed)
