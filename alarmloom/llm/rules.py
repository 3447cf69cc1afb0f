"""Quality rules: text statistics and robust multivariate outliers, in DataFrame functions only.

Every text gives a vector of transformed statistics. For every language and source the minimum covariance
determinant is estimated: starting from the rows next to the median, location and scatter are taken from the
``CORE`` share of rows that are nearest by Mahalanobis distance, again and again, until no determinant falls
any more. Rows beyond a chi-square quantile of their group's robust distance are rejected.

Groups with fewer than ``LEAST_ROWS`` rows use the estimate of their language, then that of all rows. The
nearest rows are found by counting distances in fixed logarithmic bins, so that no group is ever sorted in one
task. Null languages and sources are groups of their own; null and wordless texts fail the base rule and take
no part in the estimate; repeated rows count as often as they occur; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import BROADCAST_LIMIT, durable
from .common import col, fresh, tune

LEAST_WORDS = 50
CORE = 0.75
LEAST_ROWS = 200
MAX_STEPS = 30
BINS = 16  # per doubling of the squared distance
SPACES = "[\\x20\\x09-\\x0D]+"
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
DIMS = 5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more: repeated windows are neighbours when windows are
    sorted by hash; each one covers three words, or as many as lie before the next repeated window."""
    def covered(at: Column) -> Column:
        n = F.size(at)
        steps = F.zip_with(F.slice(at, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(at, F.lit(1), F.greatest(n - 1, F.lit(0))),
                           lambda b, a: F.least(b - a, F.lit(3)))
        return F.when(n == 0, F.lit(0)).otherwise(F.aggregate(steps, F.lit(3), lambda s, x: s + x))

    def found(p: Column) -> Column:
        same = lambda x, i, d: F.get(p, i + F.lit(d))["h"] == x["h"]
        keep = F.filter(p, lambda x, i: F.coalesce(same(x, i, -1), F.lit(False)) | F.coalesce(same(x, i, 1), F.lit(False)))
        return let(F.sort_array(F.transform(keep, lambda x: x["i"])), covered)

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(
            F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(
        let(F.sort_array(windows(words)), found)).cast("long")


def dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def text_stats(text: Column) -> Column:
    """Struct of ``STATS`` of a text."""
    t = F.coalesce(text, F.lit(""))
    return let(words_of(t), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.char_length(F.regexp_replace(t, SPACES, "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace(t, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        dup_lines(t).alias("n_dup_lines"),
        repeat_words(w).alias("n_repeat_words"),
    ))


# --- minimum covariance determinant -----------------------------------------------------------

# Least scatter of every transformed statistic: the spread below which texts do not differ in quality.
FLOORS = [0.6, 0.06, 0.03, 0.12, 0.12]
# Makes the scatter of the nearest 75 % consistent at normal data in five dimensions.
CONSISTENCY = 1.41
# Chi-square quantile of five degrees of freedom at a tail of 1e-9.
CUT = 50.8
_X = [f"x{i}" for i in range(DIMS)]
_M = [f"m{i}" for i in range(DIMS)]
_PAIRS = [(i, j) for i in range(DIMS) for j in range(i + 1)]
_W = [f"w{i}{j}" for i, j in _PAIRS]


def transformed(n_words: Column, word_chars: Column, n_symbols: Column, n_dup_lines: Column, n_repeat: Column) -> list[Column]:
    """Length and word length on a log scale, square roots of the rates of symbols, repeated lines, repeated words."""
    n = F.greatest(n_words, F.lit(1)).cast("double")
    return [F.log(n), F.log(F.greatest(word_chars, F.lit(1)) / n), F.sqrt(n_symbols / F.greatest(word_chars, F.lit(1))),
            F.sqrt(n_dup_lines / n), n_repeat / n]


def _sum(terms: list[Column]) -> Column:
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def distance(x: list[Column]) -> Column:
    """Squared Mahalanobis distance from centre ``m`` with the inverse ``w`` of the scatter's Cholesky factor."""
    z = [_sum([F.col(f"w{i}{j}") * (x[j] - F.col(_M[j])) for j in range(i + 1)]) for i in range(DIMS)]
    return _sum([t * t for t in z])


def whitened(moments: DataFrame) -> DataFrame:
    """(g, n, logdet, m*, w*) of (g, n, m*, c*): Cholesky factor of the scatter and its inverse, unrolled."""
    df = moments
    for i, j in _PAIRS:
        c = F.greatest(F.col(f"c{i}{j}") * CONSISTENCY, F.lit(0.0)) + F.lit(FLOORS[i] ** 2) if i == j else F.col(f"c{i}{j}") * CONSISTENCY
        rest = c - _sum([F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)]) if j else c
        df = df.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}{j}"))
    for i in range(DIMS):
        for j in range(i, -1, -1):
            w = F.lit(1.0) if i == j else -_sum([F.col(f"l{i}{k}") * F.col(f"w{k}{j}") for k in range(j, i)])
            df = df.withColumn(f"w{i}{j}", w / F.col(f"l{i}{i}"))
    logdet = _sum([F.log(F.col(f"l{i}{i}")) for i in range(DIMS)]) * 2
    return df.select("g", "n", logdet.alias("logdet"), *_M, *_W)


def join_groups(rows: DataFrame, groups: DataFrame, key: str, spread: Column) -> DataFrame:
    """Rows with the row of their group: broadcast while the table of groups is small, else with the rows of
    a group dealt to as many salts as keep every share below 1/64 of all rows."""
    from ..runtime import planned_bytes

    if planned_bytes(groups) <= BROADCAST_LIMIT:
        return rows.join(F.broadcast(groups), key)
    (salt,) = fresh([*rows.columns, *groups.columns], "salt")
    salted = groups.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(63))))
    return rows.withColumn(salt, F.pmod(F.xxhash64(spread), F.lit(64)).cast("int")).join(salted, [key, salt]).drop(salt)


def core_limits(near: DataFrame, share: float) -> DataFrame:
    """(g, top): the bin of ``d`` that holds the given share of a group's rows, from counts of bins."""
    bins = near.groupBy("g", "b").agg(F.count(F.lit(1)).alias("k"))
    upto = W.partitionBy("g").orderBy("b")
    ranked = bins.select("g", "b", F.sum("k").over(upto).alias("upto"), F.sum("k").over(W.partitionBy("g")).alias("all"))
    return ranked.filter(F.col("upto") >= F.ceil(F.col("all") * share)).groupBy("g").agg(F.min("b").alias("top"))


def log_bin(d: Column) -> Column:
    return F.floor(F.log2(F.greatest(d, F.lit(2.0**-40))) * BINS).cast("int")


def robust_scatter(rows: DataFrame) -> DataFrame:
    """(g, n, logdet, m*, w*) per group of ``rows`` (g, id, x*), by concentration steps.

    The start is deterministic: coordinate-wise medians and median deviations (of values in hundredths). Every
    step takes the rows up to the bin that completes the core share, and their mean and scatter."""
    spread = F.col("id")
    med = rows.groupBy("g").agg(*[F.median(F.round(x, 2)).alias(m) for x, m in zip(_X, _M)])
    off = join_groups(rows, durable(med, "mcd"), "g", spread)
    mads = off.groupBy("g").agg(*[F.first(m).alias(m) for m in _M], *[
        F.median(F.round(F.abs(F.col(x) - F.col(m)), 2)).alias(f"s{i}") for i, (x, m) in enumerate(zip(_X, _M))])
    start = durable(mads.select("g", *_M, *[
        (F.lit(1.0) / (F.col(f"s{i}") * 1.4826 + FLOORS[i]) if i == j else F.lit(0.0)).alias(f"w{i}{j}") for i, j in _PAIRS]), "mcd")
    est, last = start, None
    for _ in range(MAX_STEPS):
        near = join_groups(rows, est, "g", spread).select("g", "id", *_X, log_bin(distance([F.col(x) for x in _X])).alias("b"))
        core = join_groups(near, durable(core_limits(near, CORE), "mcd"), "g", spread).filter(F.col("b") <= F.col("top"))
        # sums around the last centre, so that no digits are lost
        y = [F.col(x) for x in _X]
        sums = core.groupBy("g").agg(
            F.count(F.lit(1)).alias("n"), *[F.avg(a).alias(m) for a, m in zip(y, _M)],
            *[F.covar_pop(_X[i], _X[j]).alias(f"c{i}{j}") for i, j in _PAIRS])
        est = durable(whitened(sums), "mcd")
        now = est.agg(F.sum("logdet").alias("d"), F.count(F.lit(1)).alias("n")).head()
        if not now["n"] or (last is not None and last - now["d"] <= 1e-4 * now["n"]):
            break
        last = now["d"]
    return est


def group_keys(lang: Column, source: Column) -> list[Column]:
    """Names of a row's groups, finest first: language and source, language, all rows. A null is a value."""
    name = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-"))
    return [F.concat(F.lit("s"), F.char_length(name(lang)).cast("string"), name(lang), name(source)),
            F.concat(F.lit("l"), name(lang)), F.lit("all")]


def quality_rules(
    docs: DataFrame, carry: list[str] | None = None, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
    out: str = "",
) -> DataFrame:
    """Columns ``carry`` (all by default) plus ``STATS``, base_failed, distance and kept, each after prefix ``out``, which gets
    underscores until none of these names is one of ``carry``.

    ``distance`` is null where the base rule failed."""
    tune(docs.sparkSession)
    carry = docs.columns if carry is None else carry
    taken = {c.lower() for c in carry}
    while any(f"{out}{s}".lower() in taken for s in (*STATS, "base_failed", "distance", "kept")):
        out = "_" + out
    names = fresh([*carry, *[f"{out}{s}" for s in STATS]], "stats", "rowid", "g0", "g1", "g2")
    stats, rowid, keys = names[0], names[1], names[2:]
    st = [col(f"{out}{s}") for s in STATS]
    read = docs.select(*map(col, carry), text_stats(col(text_col)).alias(stats), *[
        k.alias(n) for k, n in zip(group_keys(col(lang_col), col(source_col)), keys)], F.monotonically_increasing_id().alias(rowid))
    table = durable(read.select(*map(col, carry), *keys, rowid, *[col(stats)[s].alias(f"{out}{s}") for s in STATS]), "rules")
    failed = (st[0] < LEAST_WORDS) | (100 * st[4] > 50 * st[0])
    x = transformed(*st)
    levels = F.explode(F.array(*map(F.col, keys))).alias("g")
    rows = durable(table.filter(~failed).select(
        levels, F.col(rowid).alias("id"), *[c.alias(n) for c, n in zip(x, _X)]), "rules")
    sizes = rows.groupBy("g").agg(F.count(F.lit(1)).alias("size"))
    est = durable(robust_scatter(rows).join(sizes, "g").filter((F.col("size") >= LEAST_ROWS) | (F.col("g") == "all")), "mcd")
    for_row = est.select("g", F.struct(*_M, *_W).alias("e"))
    # the estimate of a source's group, or else of the next wider one, looked up once per group
    groups = table.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    for k in keys:
        groups = groups.join(for_row.select(F.col("g").alias(k), F.col("e").alias(f"e_{k}")), k, "left")
    (g,) = fresh(carry, "g")
    chosen = groups.select(F.col(keys[0]).alias(g), F.coalesce(*[F.col(f"e_{k}") for k in keys]).alias("e")).select(g, "e.*")
    chosen = durable(chosen, "mcd")
    joined = join_groups(table.withColumnRenamed(keys[0], g), chosen, g, F.col(rowid))
    d = F.when(~failed, distance(x))
    return joined.select(*map(col, carry), *[col(f"{out}{s}") for s in STATS], failed.alias(f"{out}base_failed"),
                         d.alias(f"{out}distance"), (~failed & F.coalesce(d <= CUT, F.lit(True))).alias(f"{out}kept"))
