r"""Quality rules: robust multivariate outliers by minimum-covariance-determinant estimates per language and source.

All of it is DataFrame and SQL expressions. Five statistics of each text (words, mean word length, symbols, repeated lines,
repeated eight-word windows) are transformed to a vector. Per group of (lang, source) concentration steps look for the half of
the vectors (``core``) whose covariance has the least determinant: distances under the present mean and covariance, a
threshold at the core's quantile, then mean and covariance of the vectors below it. Steps start from two robust guesses and go on
until its group's determinant falls no more; each keeps its lowest, and the lower of the two wins; the estimate is made consistent at the median, reweighted once and made consistent again, and vectors
beyond the chi-squared law's 97.5 % bound are rejected. ``FLOORS`` widen covariances, so the last factor of consistency is 1 at
least: less would take the floors back.

A group's moments and quantile sketches are summed in every task first, so a group with a third of all rows costs no more than
any other; groups too small to fit are pooled by language, then over all. Means and factors are sent to the tasks if their number
is small, else joined with salted keys.

Null and empty texts have no words and fail the base rule. A null lang or source is a value like any other. Where no group could
be fitted the base rule decides alone. Equal rows get equal results, one each. Columns that docs may have besides are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_LIMIT, discard, materialize, table

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Spread below which a coordinate is not told apart, by coordinate; it keeps covariances regular where most values are nought.
FLOORS = (0.35, 0.08, 0.05, 0.10, 0.10)
P = len(FLOORS)
#: Half a log-determinant that falls by less has stopped falling.
FALL = 1e-6
#: Quantiles of chi-squared with five degrees of freedom; fixed values.
CHI2_50, CHI2_975 = 4.3515, 12.8325


def base_columns(text: Column) -> Column:
    """struct(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines) of a text."""
    t = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(t, r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]"))
    return F.transform(
        F.array(F.struct(words.alias("w"), lines.alias("l"))),
        lambda b: F.struct(
            F.size(b.w).cast("long").alias("n_words"),
            F.length(F.translate(t, WHITE, "")).cast("long").alias("word_chars"),
            (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            (F.size(b.l) - F.size(F.array_distinct(b.l))).cast("long").alias("n_dup_lines"),
            repeated_words(b.w).cast("long").alias("n_repeat_words"),
            F.size(b.l).cast("long").alias("n_lines"),
        ),
    )[0]


def repeated_words(words: Column) -> Column:
    """Words covered by windows that are found twice or more. Windows are told apart by 64-bit hashes."""

    def covered(starts: Column) -> Column:
        gaps = F.transform(starts, lambda p, k: F.coalesce(F.least(F.lit(WINDOW), F.get(starts, k + 1) - p), F.lit(WINDOW)))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    def of_sorted(s: Column) -> Column:
        twice = F.filter(s, lambda x, k: (x.h == F.get(s, k - 1).h) | (x.h == F.get(s, k + 1).h))
        return F.transform(F.array(F.sort_array(F.transform(twice, lambda x: x.i))), covered)[0]

    def of_hashes(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, k: F.struct(x.alias("h"), k.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(F.transform(F.array(pairs), of_sorted)[0])

    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(F.transform(F.array(hashes), of_hashes)[0])


def vector() -> Column:
    """The transformed statistics: logs of sizes, square roots of shares."""
    share = lambda a, b: F.sqrt(F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0)))
    return F.array(
        F.log(F.col("n_words") + 1.0),
        F.log(F.coalesce(F.try_divide(F.col("word_chars").cast("double"), F.col("n_words").cast("double")), F.lit(0.0)) + 1.0),
        share("n_symbols", "word_chars"),
        share("n_dup_lines", "n_lines"),
        share("n_repeat_words", "n_words"),
    )


_TRI = [(i, j) for i in range(P) for j in range(i + 1)]


def _at(i: Column, j: Column) -> Column:
    return (i * (i + 1) / 2).cast("int") + j


def cholesky(cov: Column) -> Column:
    """Packed lower factor (row by row) of a packed covariance."""

    def step(acc: Column, ij: Column) -> Column:
        i, j = ij.i, ij.j
        done = F.aggregate(F.filter(F.array(*map(F.lit, range(P))), lambda k: k < j), F.lit(0.0), lambda s, k: s + F.get(acc, _at(i, k)) * F.get(acc, _at(j, k)))
        rest = F.get(cov, _at(i, j)) - done
        return F.concat(acc, F.array(F.when(i == j, F.sqrt(F.greatest(rest, F.lit(1e-12)))).otherwise(rest / F.get(acc, _at(j, j)))))

    order = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in _TRI])
    return F.aggregate(order, F.expr("cast(array() as array<double>)"), step)


def inverse_factor(low: Column) -> Column:
    """Packed inverse of a packed lower factor."""

    def step(acc: Column, ij: Column) -> Column:
        i, j = ij.i, ij.j
        done = F.aggregate(F.filter(F.array(*map(F.lit, range(P))), lambda k: (k >= j) & (k < i)), F.lit(0.0), lambda s, k: s + F.get(low, _at(i, k)) * F.get(acc, _at(k, j)))
        return F.concat(acc, F.array(F.when(i == j, 1.0 / F.get(low, _at(i, i))).otherwise(-done / F.get(low, _at(i, i)))))

    order = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in _TRI])
    return F.aggregate(order, F.expr("cast(array() as array<double>)"), step)


def distance(x: str, mean: str, factor: str) -> Column:
    """Squared Mahalanobis distance, as plain arithmetic."""
    x, m, w = F.col(x), F.col(mean), F.col(factor)
    total = None
    for i in range(P):
        y = None
        for j in range(i + 1):
            term = w[i * (i + 1) // 2 + j] * (x[j] - m[j])
            y = term if y is None else y + term
        total = y * y if total is None else total + y * y
    return total


def _fit(df: DataFrame, keys: list[str], scale: Column | None = None) -> DataFrame:
    """Mean, inverse factor and log-determinant of the vectors x of each group."""
    x = F.col("x")
    moments = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.avg(x[i]) for i in range(P)]).alias("mean"),
        F.array(*[F.covar_pop(x[i], x[j]) for i, j in _TRI]).alias("cov"),
    )
    floor = F.array(*[F.lit(FLOORS[i] ** 2 if i == j else 0.0) for i, j in _TRI])
    low = cholesky(F.zip_with("cov", floor, lambda a, b: a + b))
    out = moments.withColumn("low", low)
    logdet = F.aggregate(F.array(*[F.log(F.col("low")[i * (i + 3) // 2]) for i in range(P)]), F.lit(0.0), lambda a, b: a + b)
    return out.select(*keys, "n", "mean", inverse_factor(F.col("low")).alias("factor"), logdet.alias("logdet"))


SALTS = 16


def _with_params(df: DataFrame, params: DataFrame, keys: list[str], groups: int, bytes_each: int = 400) -> DataFrame:
    """Left join of a few values per group: sent to the tasks if small, else on salted keys so that no group meets in one task."""
    if groups * bytes_each <= BROADCAST_LIMIT:
        return df.join(F.broadcast(params), keys, "left")
    salted = params.withColumn("_salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    return df.withColumn("_salt", (F.monotonically_increasing_id() % SALTS).cast("int")).join(salted, [*keys, "_salt"], "left").drop("_salt")


def robust_outliers(df: DataFrame, core: float = 0.5, min_group: int = 200) -> DataFrame:
    """df (with lang, source, x, fit) and the column d2: squared robust distances; null where nothing could be fitted.

    ``fit`` tells which rows the estimates may rest on."""
    lang, source = F.coalesce("lang", F.lit("\0")), F.coalesce("source", F.lit("\0"))
    df = df.withColumns({"_l": lang, "_s": source})
    sizes = materialize(df.where("fit").groupBy("_l", "_s").agg(F.count(F.lit(1)).alias("n")), "mcd-sizes")
    groups = sizes.count()
    small = sizes.where(F.col("n") < min_group).groupBy("_l").agg(F.sum("n").alias("pooled"))
    names = sizes.join(small, "_l", "left").select(
        "_l", "_s", F.when(F.col("n") >= min_group, F.concat_ws("\x1f", "_l", "_s")).when(F.col("pooled") >= min_group, F.concat_ws("\x1f", "_l", F.lit("\1"))).otherwise("\1").alias("gid")
    )
    df = _with_params(df, names, ["_l", "_s"], groups).withColumn("gid", F.coalesce("gid", F.lit("\1"))).drop("_l", "_s")

    fit = materialize(df.where("fit").select("gid", "x"), "mcd-vectors")
    robust = fit.groupBy("gid").agg(*[F.percentile_approx(F.col("x")[i], [0.25, 0.5, 0.75], 10_000).alias(f"q{i}") for i in range(P)])
    spread = [F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, F.lit(FLOORS[i])) for i in range(P)]
    start = materialize(robust.select("gid", F.array(*[F.col(f"q{i}")[1] for i in range(P)]).alias("mid"), F.array(*spread).alias("spread")), "mcd-start")
    scored = _with_params(fit, start, ["gid"], groups)
    z = [(F.col("x")[i] - F.col("mid")[i]) / F.col("spread")[i] for i in range(P)]
    two = F.array(sum((a * a for a in z[1:]), z[0] * z[0]), F.greatest(*[F.abs(a) for a in z]))
    scored = scored.select("gid", "x", F.posexplode(two).alias("start", "d2"))
    keys = ["gid", "start"]
    kept, k = None, 0
    while True:
        limit = scored.groupBy(*keys).agg(F.percentile_approx("d2", core, 10_000).alias("limit"))
        near = _with_params(scored, limit, keys, groups, 40).where("d2 <= limit")
        params = _fit(near, keys).withColumn("falls", F.lit(True))
        if kept is not None:  # a group's lowest so far stays if the step did not lower it; one whose lowest has stopped falling takes no more steps
            both = kept.withColumn("falls", F.lit(False)).unionByName(params).groupBy(*keys).agg(
                F.min_by(F.struct("n", "mean", "factor", "logdet"), "logdet").alias("b"),
                F.coalesce(F.min(F.expr("if(falls, logdet, null)")) < F.min(F.expr("if(falls, null, logdet)")) - FALL, F.lit(False)).alias("falls"),
            )
            params = both.select(*keys, "b.*", "falls")
        before, kept = kept, materialize(params, f"mcd-step{k}")
        params = kept
        if before is not None:
            discard(before)
        k += 1
        falling = params.where("falls")
        if falling.isEmpty():
            break
        scored = _with_params(fit, falling, ["gid"], 2 * groups).where("start IS NOT NULL").select("gid", "start", "x", distance("x", "mean", "factor").alias("d2"))
    best = params.groupBy("gid").agg(F.min(F.struct("logdet", "start", "mean", "factor")).alias("b")).select("gid", "b.mean", "b.factor")
    best = materialize(best, "mcd-best")
    raw = _with_params(fit, best, ["gid"], groups).select("gid", "x", distance("x", "mean", "factor").alias("d2"))
    middle = raw.groupBy("gid").agg((F.percentile_approx("d2", 0.5, 10_000) / CHI2_50).alias("c"))
    inner = _with_params(raw, middle, ["gid"], groups, 40).where(F.col("d2") <= CHI2_975 * F.greatest("c", F.lit(1e-9)))
    final = materialize(_fit(inner, ["gid"]), "mcd-final").select("gid", "mean", "factor")
    last = _with_params(fit, final, ["gid"], groups).select("gid", distance("x", "mean", "factor").alias("d2"))
    scale = last.groupBy("gid").agg(F.greatest(F.percentile_approx("d2", 0.5, 10_000) / CHI2_50, F.lit(1.0)).alias("scale"))
    final = materialize(final.join(scale, "gid"), "mcd-scaled")
    discard(fit)
    out = _with_params(df, final, ["gid"], groups)
    return out.withColumn("d2", distance("x", "mean", "factor") / F.col("scale")).drop("mean", "factor", "scale", "gid")


def quality_rules(docs: DataFrame, min_words: int = 20, max_repeat: int = 30, cutoff: float = CHI2_975) -> DataFrame:
    """One row per document: doc_id, the five counts, base_failed, kept, and d2 (the robust distance)."""
    have = set(docs.columns)
    own = [F.col(c).cast("string").alias(c) if c in have else F.lit(None).cast("string").alias(c) for c in ("lang", "source")]
    base = docs.select("doc_id", *own, base_columns(F.col("text")).alias("b")).select("doc_id", "lang", "source", "b.*")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    base = materialize(base.withColumn("base_failed", failed), "quality-base")
    scored = robust_outliers(base.withColumns({"x": vector(), "fit": ~F.col("base_failed")}))
    verdict = ~F.col("base_failed") & F.coalesce(F.col("d2") <= cutoff, F.lit(True))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", verdict.alias("kept"), "d2")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))
