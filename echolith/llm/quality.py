"""Quality rules: base rules of each text, then robust multivariate outliers of its language and source.

The statistics of a text (length, length of its words, of its lines, share of punctuation and of symbols, on scales on which they
are about normal) form a vector. For every language and source the minimum covariance determinant is sought: from four
starts, concentration steps take the given share of the vectors that lie nearest and estimate centre and covariance from these
alone, so outliers (up to the rest) have no say in what counts as usual; the estimate of the least determinant goes on until it falls no more. The same is sought, in the same passes, for every language and for all rows; a group's centre and covariance are
drawn towards those of its language, and these towards those of all rows, the more the fewer texts there are, so groups of every size are judged. A text is rejected if its Mahalanobis distance
to that estimate is beyond a chi-squared quantile.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, saved, table, words

SYMBOLS = "#*$%&|<>"
MARKS = ".,;:!?'\"()-"
#: The vector's parts, and for each the least standard deviation that an estimate may have: below it, differences don't make a text odd.
FLOORS = {"v_length": 0.25, "v_word": 0.05, "v_line": 0.25, "v_marks": 0.10, "v_symbols": 0.10}
#: The chi-squared quantile for five parts beyond which about one of a hundred million usual texts would lie, and the factor that makes the covariance of the nearest three quarters consistent with the whole.
CUTOFF = 45.0
HALF = 0.75
CONSISTENT = 1.0 / 0.66
#: An estimate of so many texts (besides as many as there are parts) counts as much as that of the level above it.
PRIOR_ROWS = 40
#: Up to so many groups' estimates (some 200 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 500_000
#: Steps that every start makes, and those that the best one makes beyond them at most.
FIRST_STEPS = 2
STEPS = 12


def _let(value: Column, f) -> Column:
    """f(value), with value computed once although f's lambdas use it for every element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _repeat_words(ws: Column) -> Column:
    """How many words lie in windows of eight words that occur twice or more."""

    def of_hashes(hashes: Column) -> Column:
        by_hash = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_let(by_hash, _covered))

    def of_words(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - 7), lambda i: F.xxhash64(F.slice(w, i, 8)))
        return F.when(F.size(w) < 9, F.lit(0)).otherwise(_let(hashes, of_hashes))

    return _let(ws, of_words)


def _covered(by_hash: Column) -> Column:
    """Words under those of the windows, sorted by hash and place, whose neighbour has the same hash."""
    same = lambda k: F.coalesce(F.try_element_at(by_hash, k)["h"] == F.try_element_at(by_hash, k + 1)["h"], F.lit(False))
    twice = F.filter(by_hash, lambda x, k: F.when(k > 0, same(k)).otherwise(False) | same(k + 1))
    start = F.struct(F.lit(0).alias("n"), F.lit(-8).alias("last"))
    step = lambda s, i: F.struct((s["n"] + F.least(F.lit(8), i - s["last"])).alias("n"), i.alias("last"))
    return F.aggregate(F.sort_array(F.transform(twice, lambda x: x["i"])), start, step, lambda s: s["n"])


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the base statistics and rules, and the vector's parts of every row of docs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    one = docs.select(F.col("doc_id"), "lang", "source", text.alias("t"), words(F.col("text")).alias("w"))
    lines = F.filter(F.split("t", "\n", -1), lambda x: F.trim(x, F.lit(SPACES)) != "")
    left = lambda chars: F.length(F.translate("t", chars, ""))
    one = one.withColumns({"n_words": F.size("w").cast("long"), "word_chars": left(SPACES).cast("long"), "n_symbols": (F.length("t") - left(SYMBOLS)).cast("long"), "marks": F.length("t") - left(MARKS), "lines": lines})
    one = one.withColumns({"n_lines": F.size("lines"), "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"), "n_repeat_words": _repeat_words(F.col("w")).cast("long")})
    some = F.greatest(F.col("n_words"), F.lit(1))
    return one.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"),
        F.log1p("n_words").alias("v_length"), F.log1p(F.col("word_chars") / some).alias("v_word"),
        F.log1p(F.col("n_words") / F.greatest("n_lines", F.lit(1))).alias("v_line"), F.sqrt(F.col("marks") / some).alias("v_marks"),
        F.sqrt(F.col("n_symbols") / some).alias("v_symbols"),
    )


#: Levels of estimates: all rows, a language, a language and source.
ALL, LANG, GROUP = 0, 1, 2
OF = ["level", "key"]


def _small(df: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(df) if few else df


def _columns(parts: list[str]) -> list[str]:
    """The names of a centre's parts and of a covariance's."""
    return [f"m_{i}" for i in range(len(parts))] + [f"c_{i}_{j}" for i in range(len(parts)) for j in range(i + 1)]


def _factored(estimate: DataFrame, parts: list[str]) -> DataFrame:
    """estimate with the Cholesky factor l_i_j of its covariance and the logarithm of its determinant."""
    for i, x in enumerate(parts):
        for j in range(i + 1):
            done = reduce(lambda a, k: a - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}"), range(j), F.col(f"c_{i}_{j}"))  # noqa: B023
            least = F.lit(FLOORS[x] ** 2 / 4)
            estimate = estimate.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(done, least)) if i == j else done / F.col(f"l_{j}_{j}"))
    return estimate.withColumn("log_det", reduce(lambda a, b: a + b, [2 * F.log(F.col(f"l_{i}_{i}")) for i in range(len(parts))]))


def _covariance(product, parts: list[str], factor: float = CONSISTENT) -> list[Column]:
    """c_i_j from product(i, j), never narrower than the floors."""
    return [(F.coalesce(product(i, j), F.lit(0.0)) * factor + (FLOORS[x] ** 2 if i == j else 0.0)).alias(f"c_{i}_{j}") for i, x in enumerate(parts) for j in range(i + 1)]


def _sums(parts: list[str]) -> list[Column]:
    """Sums of the parts and of their products: a third of the buffers that averages and covariances would need. The parts are distances from a centre, so no digits are lost."""
    products = [F.sum(F.col(parts[i]) * F.col(parts[j])).alias(f"sum_{i}_{j}") for i in range(len(parts)) for j in range(i + 1)]
    return [F.sum(x).alias(f"sum_{i}") for i, x in enumerate(parts)] + products


def _starts(rows: DataFrame, parts: list[str], few: bool) -> DataFrame:
    """level, key, n, start and four estimates of every group: medians with median deviations, mean and covariance, and medians with the covariance of signs in space and of hyperbolic tangents, on the scale of the deviations."""
    p = range(len(parts))
    middle = _small(saved(rows.groupBy(*OF).agg(F.count("*").alias("n"), *[F.percentile_approx(x, 0.5, 1000).alias(f"m_{i}") for i, x in enumerate(parts)])), few)
    spread = rows.join(middle, OF).groupBy(*OF).agg(F.first("n").alias("n"), *[F.first(f"m_{i}").alias(f"m_{i}") for i in p], *[F.greatest(1.4826 * F.percentile_approx(F.abs(F.col(x) - F.col(f"m_{i}")), 0.5, 1000), F.lit(FLOORS[x])).alias(f"s_{i}") for i, x in enumerate(parts)])
    spread = saved(spread)
    scaled = rows.join(_small(spread, few), OF).withColumns({f"u_{i}": (F.col(x) - F.col(f"m_{i}")) / F.col(f"s_{i}") for i, x in enumerate(parts)})
    norm = F.sqrt(reduce(lambda a, b: a + b, [F.col(f"u_{i}") * F.col(f"u_{i}") for i in p]))
    scaled = scaled.withColumn("norm", F.when(norm > 0, norm).otherwise(F.lit(1.0))).select(*OF, *[F.col(f"u_{i}").alias(x) for i, x in enumerate(parts)], *[(F.col(f"u_{i}") / F.col("norm")).alias(f"sign_{i}") for i in p], *[F.tanh(f"u_{i}").alias(f"tanh_{i}") for i in p])
    both = lambda kind, i, j: F.sum(F.col(f"{kind}_{i}") * F.col(f"{kind}_{j}")).alias(f"{kind}_{i}_{j}")
    two = [(i, j) for i in p for j in range(i + 1)]
    sums = scaled.groupBy(*OF).agg(*_sums(parts), *[both(kind, i, j) for kind in ("sign", "tanh") for i, j in two])
    scale = lambda i, j: F.col(f"s_{i}") * F.col(f"s_{j}")
    share = lambda name: F.col(name) / F.col("n")
    mean = lambda i: F.col(f"m_{i}") + F.col(f"s_{i}") * share(f"sum_{i}")
    products = [
        lambda i, j: scale(i, j) if i == j else F.lit(0.0),
        lambda i, j: scale(i, j) * (share(f"sum_{i}_{j}") - share(f"sum_{i}") * share(f"sum_{j}")),
        lambda i, j: scale(i, j) * share(f"sign_{i}_{j}"),
        lambda i, j: scale(i, j) * share(f"tanh_{i}_{j}"),
    ]
    kinds = [F.struct(F.lit(k).alias("start"), *[(mean(i) if k == 1 else F.col(f"m_{i}")).alias(f"m_{i}") for i in p], *_covariance(f, parts, 1.0)) for k, f in enumerate(products)]
    return saved(_factored(spread.join(_small(sums, few), OF).select(*OF, "n", F.inline(F.array(*kinds))), parts))


def _concentrated(rows: DataFrame, estimate: DataFrame, parts: list[str], half: float, few: bool) -> DataFrame:
    """One step: every estimate anew from the share half of its group that lies nearest to it."""
    of = [*OF, "start"]
    lower = [c for c in estimate.columns if c.startswith(("m_", "l_")) and c != "log_det"]
    away = [(F.col(x) - F.col(f"m_{i}")).alias(x) for i, x in enumerate(parts)]
    far = rows.join(_small(estimate.select(*of, *lower), few), OF).withColumn("d", _distance(parts)).select(*of, *away, "d")
    edge = saved(far.groupBy(*of).agg(F.percentile_approx("d", half, 1000).alias("edge")))
    near = far.join(_small(edge, few), of).filter("d <= edge")
    sums = near.groupBy(*of).agg(F.count("*").alias("taken"), *_sums(parts))
    known = sums.join(_small(estimate.select(*of, "n", *[F.col(f"m_{i}").alias(f"old_{i}") for i in range(len(parts))]), few), of)
    share = lambda name: F.col(name) / F.col("taken")
    moved = [(F.col(f"old_{i}") + share(f"sum_{i}")).alias(f"m_{i}") for i in range(len(parts))]
    cov = _covariance(lambda i, j: share(f"sum_{i}_{j}") - share(f"sum_{i}") * share(f"sum_{j}"), parts)
    return saved(_factored(known.select(*of, "n", *moved, *cov), parts))


def estimates(rows: DataFrame, parts: list[str], half: float = HALF, steps: int = STEPS, few: bool = True) -> DataFrame:
    """level, key, n, centre m_i, covariance c_i_j, l_i_j and log_det of every group of rows (level, key and parts): minimum covariance determinant.

    Four starts make FIRST_STEPS steps each; of a group's estimates that of the least determinant (the earliest start, if equal) goes on, until no group's determinant falls by more than a hundredth, or for the given number of steps.
    """
    found = _starts(rows, parts, few)
    for _ in range(FIRST_STEPS):
        found = _concentrated(rows, found, parts, half, few)
    names = [c for c in found.columns if c not in OF]
    least = lambda df: df.groupBy(*OF).agg(F.min_by(F.struct(*names), F.struct("log_det", "start")).alias("x")).select(*OF, "x.*")
    found = saved(least(found))
    for _ in range(steps):
        new = _concentrated(rows, found, parts, half, few)
        gain = found.select(*OF, F.col("log_det").alias("before")).join(new, OF).agg(F.max(F.col("before") - F.col("log_det"))).first()[0]
        found = saved(least(found.unionByName(new)))
        if gain is None or gain <= 0.01:
            break
    return found


def _drawn(estimate: DataFrame, above: DataFrame, key: str, parts: list[str], prior_rows: int, few: bool) -> DataFrame:
    """estimate with centre and covariance drawn towards those of the level above (by its key)."""
    names = _columns(parts)
    more = F.greatest(F.col("n") - len(parts), F.lit(0))  # so many texts as parts, or fewer, have no covariance of their own
    own = more / (more + prior_rows)
    joined = estimate.join(_small(above.select(key, *[F.col(x).alias(f"a_{x}") for x in names]), few), key)
    return saved(joined.select(*[c for c in estimate.columns if c not in names], *[(own * F.col(x) + (1 - own) * F.col(f"a_{x}")).alias(x) for x in names]))


def _distance(parts: list[str]) -> Column:
    """The squared Mahalanobis distance, by forward substitution."""
    solved: list[Column] = []
    for i, x in enumerate(parts):
        rest = reduce(lambda a, k: a - F.col(f"l_{i}_{k}") * solved[k], range(i), F.col(x) - F.col(f"m_{i}"))  # noqa: B023
        solved.append(rest / F.col(f"l_{i}_{i}"))
    return reduce(lambda a, b: a + b, [y * y for y in solved])


def judge(docs: DataFrame, cutoff: float = CUTOFF, half: float = HALF, steps: int = STEPS, prior_rows: int = PRIOR_ROWS) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance and kept of every row of docs (doc_id, text, lang, source).

    A null text is an empty one, and fails the base rules. Only texts that pass these enter the estimate of their language and source (null is one of
    each). The estimate of a group of prior_rows texts counts as much as that of its language, a smaller one less; so every text that passes the base rules has a distance (null only where no text of the group passes them). The share half of a
    group is taken by approximate percentile, in the given number of steps at most once the best start is known. Equal distances go in together. Other columns are ignored; repeated rows count as often as they occur; an
    empty table gives an empty result.
    """
    parts = list(FLOORS)
    stats = statistics(docs).withColumns({"g": F.xxhash64(F.struct("lang", "source"), F.col("lang").isNull(), F.col("source").isNull()), "l": F.xxhash64("lang", F.col("lang").isNull()), "a": F.lit(0).cast("long")})
    stats = saved(stats)
    fit = stats.filter(~F.col("base_failed")).select("g", "l", "a", *parts)
    levels = saved(fit.select("g", "l", "a").distinct())
    few = 3 * 4 * levels.count() <= BROADCAST_ROWS  # a row for each level and start at most
    level = lambda k, name: F.struct(F.lit(k).alias("level"), F.col(name).cast("long").alias("key"))
    rows = fit.select(F.inline(F.array(level(ALL, "a"), level(LANG, "l"), level(GROUP, "g"))), *parts)
    found = estimates(rows, parts, half, steps, few).select(*OF, "n", *_columns(parts))
    of_all, of_lang, of_group = (found.filter(F.col("level") == k).drop("level").withColumnRenamed("key", name) for k, name in ((ALL, "a"), (LANG, "l"), (GROUP, "g")))
    of_lang = _drawn(of_lang.join(_small(levels.select("l", "a").distinct(), few), "l"), of_all, "a", parts, prior_rows, few)
    of_group = _drawn(of_group.join(_small(levels.select("g", "l"), few), "g"), of_lang, "l", parts, prior_rows, few)
    judged = stats.join(_small(_factored(of_group, parts).drop("l", "n", "log_det"), few), "g", "left").withColumn("distance", _distance(parts))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance",
        (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff)).alias("kept"),
    )


def op7_quality_rules(spark, sf_dir):
    """Every document with its base statistics and the verdict."""
    return judge(table(spark, sf_dir, "documents"))
