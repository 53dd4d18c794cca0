"""Statistics as Column expressions: ranks, normal scores, robust spread, transforms, false discovery.

Missing is NULL throughout; ``to_null`` turns NaN into NULL where data come in.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import value_ranks

#: Scales a median absolute deviation to a normal standard deviation.
MAD_SCALE = 1.4826

#: Rational approximation of the normal quantile (Wichura 1988, AS 241), lowest power first.
AS241_CENTRE = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
AS241_NEAR = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
AS241_FAR = (
    (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)


def to_null(df: DataFrame) -> DataFrame:
    """NaN to NULL in every floating-point column."""
    floating = [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floating}) if floating else df


def avg_rank(value: str, *keys: str) -> Column:
    """Average rank of ``value`` within ``keys``; rows with a NULL value must be filtered out before.

    Ties are counted by a frame of the same window, so one shuffle and one sort serve both.
    """
    order = Window.partitionBy(*keys).orderBy(value)
    ties = order.rangeBetween(Window.currentRow, Window.currentRow)
    return F.rank().over(order) + (F.count("*").over(ties) - 1) / 2.0


def _horner(coefficients: tuple[float, ...], r: Column) -> Column:
    return reduce(lambda acc, c: acc * r + F.lit(c), reversed(coefficients[:-1]), F.lit(coefficients[-1]))


def _tail_root(p: Column) -> Column:
    return F.sqrt(-F.log(F.least(p, 1.0 - p)))


def normal_ppf(p: Column, t: Column | None = None) -> Column:
    """Quantile of the standard normal distribution, in the JVM; ``t``: sqrt(-log(min(p, 1 - p))) where it is at hand."""
    q = p - 0.5
    r = F.lit(0.180625) - q * q
    centre = q * _horner(AS241_CENTRE[0], r) / _horner(AS241_CENTRE[1], r)
    t = _tail_root(p) if t is None else t
    near = _horner(AS241_NEAR[0], t - 1.6) / _horner(AS241_NEAR[1], t - 1.6)
    far = _horner(AS241_FAR[0], t - 5.0) / _horner(AS241_FAR[1], t - 5.0)
    tail = F.when(t <= 5.0, near).otherwise(far) * F.when(q < 0, -1.0).otherwise(1.0)
    return F.when(F.abs(q) <= 0.425, centre).when((p > 0) & (p < 1), tail)


def normal_ppf_sql(p: str) -> str:
    """The same expression as SQL text, for oracles."""

    def horner(c: tuple[float, ...], r: str) -> str:
        return reduce(lambda acc, x: f"({acc} * {r} + CAST({x!r} AS DOUBLE))", reversed(c[:-1]), f"CAST({c[-1]!r} AS DOUBLE)")

    q, r = f"({p} - 0.5)", f"(CAST(0.180625 AS DOUBLE) - ({p} - 0.5) * ({p} - 0.5))"
    t = f"sqrt(-ln(least({p}, 1.0 - {p})))"
    near, far = f"({t} - CAST(1.6 AS DOUBLE))", f"({t} - CAST(5.0 AS DOUBLE))"
    tail = f"CASE WHEN {t} <= 5 THEN {horner(AS241_NEAR[0], near)} / {horner(AS241_NEAR[1], near)} ELSE {horner(AS241_FAR[0], far)} / {horner(AS241_FAR[1], far)} END * CASE WHEN {q} < 0 THEN -1 ELSE 1 END"
    return f"CASE WHEN abs({q}) <= 0.425 THEN {q} * {horner(AS241_CENTRE[0], r)} / {horner(AS241_CENTRE[1], r)} WHEN {p} > 0 AND {p} < 1 THEN {tail} END"


def normal_scores(df: DataFrame, value: str, *keys: str, out: str = "score") -> DataFrame:
    """Rank-based inverse-normal scores of non-missing values within ``keys``; missing rows are dropped.

    A score is found once for each value of a group and then joined to the rows, so no group is one task's.
    The values of a part are what a task holds; its rows pass by unsorted.
    """
    names = [*keys, value]
    ranked = value_ranks(df, value, keys).select(*[F.col(c).alias(f"__{c}") for c in names], ((F.col("rank") - 0.5) / F.col("n")).alias("__p"))
    # the root becomes a column first: within the quantile each mention would be computed again
    ranked = ranked.withColumn("__t", _tail_root(F.col("__p"))).withColumn(out, normal_ppf(F.col("__p"), F.col("__t"))).drop("__p", "__t")
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in names])
    return df.where(F.col(value).isNotNull()).join(ranked.hint("shuffle_hash"), same).drop(*[f"__{c}" for c in names])


def with_mad(df: DataFrame, value: str, *keys: str, out: str = "spread") -> DataFrame:
    """Adds MAD_SCALE times the median absolute deviation from the median of ``value`` within ``keys``."""
    w = Window.partitionBy(*keys)
    df = df.withColumn("__median", F.median(value).over(w))
    return df.withColumn(out, MAD_SCALE * F.median(F.abs(F.col(value) - F.col("__median"))).over(w)).drop("__median")


def robust_z(df: DataFrame, value: str, *keys: str, out: str = "z") -> DataFrame:
    """(value - median) / scaled MAD within ``keys``; NULL where the spread is zero."""
    w = Window.partitionBy(*keys)
    df = df.withColumn("__centre", F.median(value).over(w))
    df = df.withColumn("__spread", MAD_SCALE * F.median(F.abs(F.col(value) - F.col("__centre"))).over(w))
    z = F.when(F.col("__spread") > 0, (F.col(value) - F.col("__centre")) / F.col("__spread"))
    return df.withColumn(out, z).drop("__centre", "__spread")


def skewness(value: Column, min_count: int) -> Column:
    """Population skewness as an aggregate; NULL for few or constant values."""
    return F.when(F.count(value) >= min_count, F.skewness(value))


def yeo_johnson(x: Column, lam: Column) -> Column:
    """Yeo-Johnson power transform."""
    positive = F.when(F.abs(lam) < 1e-8, F.log1p(x)).otherwise((F.pow(x + 1.0, lam) - 1.0) / lam)
    other = 2.0 - lam
    negative = F.when(F.abs(other) < 1e-8, -F.log1p(-x)).otherwise(-(F.pow(1.0 - x, other) - 1.0) / other)
    return F.when(x >= 0, positive).when(x < 0, negative)


def log1p_clipped(x: Column) -> Column:
    return F.log1p(F.greatest(x, F.lit(0.0)))


def bh_fdr(df: DataFrame, p: str, *keys: str, out: str = "fdr") -> DataFrame:
    """Benjamini-Hochberg adjusted p-values within ``keys`` (NULL p stays NULL)."""
    has = F.col(p).isNotNull()
    group = Window.partitionBy(*keys, "__has")
    rank, n = F.row_number().over(group.orderBy(p)), F.count("*").over(group)
    df = df.withColumn("__has", has).withColumn("__q", F.col(p) * n / rank)
    run = group.orderBy(F.desc(p), F.desc("__q")).rowsBetween(Window.unboundedPreceding, 0)
    # equal p-values take the smallest of their quotients
    low = F.least(F.lit(1.0), F.min("__q").over(run))
    df = df.withColumn("__low", low)
    same = Window.partitionBy(*keys, "__has", p)
    return df.withColumn(out, F.when(F.col("__has"), F.min("__low").over(same))).drop("__has", "__q", "__low")


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + top * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + top / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0 or x >= 1.0:
        return float(x >= 1.0)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def t_two_sided(t: float | None, df: float | None) -> float | None:
    """Two-sided p-value of Student's t."""
    if t is None or df is None or not df > 0 or math.isnan(t):
        return None
    return 0.0 if math.isinf(t) else incomplete_beta(df / 2.0, 0.5, df / (df + t * t))


def t_ppf(p: float, df: float) -> float:
    """Upper quantile of Student's t for p above one half, by bisection."""
    lo, hi = 0.0, 1.0
    while t_two_sided(hi, df) > 2 * (1 - p):
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_two_sided(mid, df) > 2 * (1 - p) else (lo, mid)
    return (lo + hi) / 2


def let(fn, **values: Column) -> Column:
    """``fn`` of named columns that are computed once: they are bound as a struct."""
    return F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), lambda s: fn(*[s[k] for k in values])).getItem(0)


def log_gamma(z: Column) -> Column:
    """Logarithm of the gamma function of positive numbers: Stirling's series, ten steps up."""
    up = [z + float(i) for i in range(10)]
    product = up[0]
    for u in up[1:]:
        product = product * u
    y = z + 10.0
    # Stirling's series
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3.0))) + 1 / (1260 * F.pow(y, F.lit(5.0))) - 1 / (1680 * F.pow(y, F.lit(7.0))) + 1 / (1188 * F.pow(y, F.lit(9.0)))
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - F.log(product)


def beta_share(a: Column, b: Column, x: Column, steps: int = 400) -> Column:
    """Regularised incomplete beta function by ``steps`` steps of its continued fraction, within the plan."""
    safe = lambda v: F.when(F.abs(v) > 1e-300, v).otherwise(1e-300)

    def fraction(a, b, x):
        def step(s, m):
            for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                s = let(lambda d, c, h: F.struct(c.alias("c"), d.alias("d"), (h * d * c).alias("h")), d=1.0 / safe(1.0 + top * s["d"]), c=safe(1.0 + top / s["c"]), h=s["h"])
            return s

        d = 1.0 / safe(1.0 - (a + b) * x / (a + 1.0))
        begin = F.struct(F.lit(1.0).alias("c"), d.alias("d"), d.alias("h"))
        return F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(steps)), lambda m: m.cast("double")), begin, step, lambda s: s["h"])

    def whole(a, b, x):
        far = x >= (a + 1.0) / (a + b + 2.0)
        front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log1p(-x))
        return let(lambda p, q, y, f, far: F.when(far, 1.0 - f * fraction(p, q, y) / p).otherwise(f * fraction(p, q, y) / p), p=F.when(far, b).otherwise(a), q=F.when(far, a).otherwise(b), y=F.when(far, 1.0 - x).otherwise(x), f=front, far=far)

    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(let(whole, a=a.cast("double"), b=b.cast("double"), x=x.cast("double")))


def t_p_value(t: Column, df: Column) -> Column:
    """Two-sided p-value of Student's t; NULL without degrees of freedom, 0 for an infinite t."""
    t, df = t.cast("double"), df.cast("double")
    fine = t.isNotNull() & ~F.isnan(t) & (df > 0)
    return F.when(fine & (F.abs(t) == float("inf")), 0.0).when(fine, beta_share(df / 2.0, F.lit(0.5), df / (df + t * t)))


def t_quantile(tail: float, df: Column, steps: int = 60) -> Column:
    """The t that two-sided p-value ``tail`` belongs to, by bisection of t / (1 + t)."""

    def halve(s, _):
        mid = (s["lo"] + s["hi"]) / 2
        over = t_p_value(mid / (1.0 - mid), df) > tail
        return let(lambda m, o, lo, hi: F.struct(F.when(o, m).otherwise(lo).alias("lo"), F.when(o, hi).otherwise(m).alias("hi")), m=mid, o=over, lo=s["lo"], hi=s["hi"])

    begin = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
    at = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), begin, halve, lambda s: (s["lo"] + s["hi"]) / 2)
    return F.when(df > 0, at / (1.0 - at))
