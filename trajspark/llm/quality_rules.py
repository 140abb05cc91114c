"""Quality rules: robust multivariate outliers of text statistics, in DataFrame functions only.

Base statistics are taken from every whole text. Their transformed vectors are
then judged per language and source by a minimum-covariance-determinant
estimate. It has four deterministic starts: coordinate medians and absolute
deviations alone, and with the covariance of the coordinates so standardised, of
their hyperbolic tangents, and of their directions. From each, concentration steps
refit location and covariance on the nearest ``SUPPORT`` share of rows until no
start's determinant falls by more than ``TOLERANCE`` (its logarithm; ``STEPS`` at most).
The fit of least determinant counts; rows whose Mahalanobis distance is beyond
``CUTOFF`` are rejected.

The nearest share is found from a histogram of log distances, so every step is a
sum that combines before the shuffle: a group may hold any share of all rows. The
starts of a step share its aggregations.
Groups of under ``LEAST_GROUP`` judged rows are pooled by language, then overall.

Defined results: null text has no words and fails; a null language or source is a
group of its own; repeated rows and ids are judged row by row; columns other than
``keep``, ``by`` and the text are dropped, those may have any name, and names of outputs
are replaced. An empty table gives no rows; a very long text is described whole, in the
memory of its row. Windows of three words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajspark.llm import scratch

SUPPORT = 0.75
#: Concentration steps at most, and the fall of the log determinant that calls for another.
STEPS, TOLERANCE = 12, 0.01
#: Square root of the 0.9999 quantile of chi-square with five degrees of freedom.
CUTOFF = 5.07
#: Makes the covariance of the nearest three quarters of five normal variables that of all.
CONSISTENCY = 1.41
#: Standard deviations that a coordinate is given at least: differences below don't matter.
FLOORS = (0.5, 0.08, 0.3, 0.3, 0.12)
LEAST_GROUP = 50
#: Groups whose estimates are broadcast at most (under 300 bytes each); more are joined by shuffle.
BROADCAST_GROUPS = 20_000
#: Resolution of the histograms: bins per unit of a coordinate or of the log distance.
BINS = 64

P = len(FLOORS)
_PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
_STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_WHITE = " \t\n\u000b\f\r"


def _let(value: Column, use) -> Column:
    """``use`` applied to ``value``, which is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _covered(places: Column) -> Column:
    """Words in the three-word windows that start at ``places``."""
    return F.size(F.array_distinct(F.flatten(F.transform(places, lambda p: F.array(p, p + 1, p + 2)))))


def repeat_words(grams: Column) -> Column:
    """Words in windows whose hash occurs twice or more."""
    few = lambda repeated: _covered(F.filter(F.sequence(F.lit(0), F.size(grams) - 1), lambda i: F.array_contains(repeated, F.get(grams, i))))
    paired = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    many = _let(
        paired,
        lambda p: _covered(F.transform(F.filter(p, lambda x, k: ((k > 0) & (F.get(p, k - 1)["g"] == x["g"])) | F.coalesce(F.get(p, k + 1)["g"] == x["g"], F.lit(False))), lambda x: x["i"])),
    )
    found = _let(
        F.sort_array(grams),
        lambda s: _let(F.array_distinct(F.filter(s, lambda x, i: (i > 0) & (x == F.get(s, i - 1)))), lambda repeated: F.when(F.size(repeated) <= 16, few(repeated)).otherwise(many)),
    )
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), 0).otherwise(found)


def statistics(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (all long) of every whole text."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    out = df.select(_packed(keep), body.alias("_t"))
    out = out.select("_kept", "_t", F.array_remove(F.split("_t", r"[\x20\x09-\x0D]+", -1), "").alias("_w"), F.filter(F.split("_t", "\n", -1), lambda x: F.translate(x, _WHITE, "") != "").alias("_l"))
    grams = F.when(F.size("_w") > 2, F.slice(F.transform("_w", lambda x, i: F.xxhash64(x, F.get("_w", i + 1), F.get("_w", i + 2))), 1, F.size("_w") - 2)).otherwise(F.array().cast("array<bigint>"))
    out = out.select(
        "_kept",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate("_t", _WHITE, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        grams.alias("_g"),
    )
    return out.select(*_unpacked(keep), *_STATISTICS[:-1], repeat_words(F.col("_g")).cast("long").alias("n_repeat_words"))


def _packed(columns: Sequence[str]) -> Column:
    """Columns of any name as one struct, so that none clashes with those made here."""
    return F.struct(*(F.col(f"`{c}`") for c in columns)).alias("_kept")


def _unpacked(columns: Sequence[str]) -> list[Column]:
    return [F.col("_kept")[c].alias(c) for c in columns]


def _vector() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [F.log(n), F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n), F.log1p(10 * F.col("n_symbols") / n), F.log1p(100 * F.col("n_dup_lines") / n), F.asin(F.sqrt(F.least(F.col("n_repeat_words") / n, F.lit(1.0))))]


def _attach(rows: DataFrame, small: DataFrame, keys: list[str], few: bool) -> DataFrame:
    """Left join with a table of some rows a group; broadcast if groups are ``few``, which has been counted."""
    return rows.join(F.broadcast(small) if few else small, keys, "left")


def _quantile(counts: DataFrame, keys: list[str], share: float) -> DataFrame:
    """Per ``keys``, the first bin that at least ``share`` of the rows reach; from (keys, bin, n)."""
    total = counts.groupBy(*keys).agg(F.sum("n").alias("all"), F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("bins"))
    upto = F.aggregate(
        "bins",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("int").alias("bin")),
        lambda s, b: F.struct((s["n"] + b["n"]).alias("n"), F.when(s["bin"].isNull() & (s["n"] + b["n"] >= F.ceil(share * F.col("all"))), b["bin"]).otherwise(s["bin"]).alias("bin")),
    )["bin"]
    return total.select(*keys, upto.alias("bin"))


def _cholesky(cov: dict[tuple[int, int], Column]) -> list[tuple[str, Column]]:
    """Steps that add the lower factor l_i_j of cov (plus floors); later ones use earlier ones."""
    steps = []
    for i, j in _PAIRS:
        rest = cov[i, j] + (FLOORS[i] ** 2 if i == j else 0.0)
        for k in range(j):
            rest = rest - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
        steps.append((f"l_{i}_{j}", F.sqrt(F.greatest(rest, F.lit(FLOORS[i] ** 2 / 4))) if i == j else rest / F.col(f"l_{j}_{j}")))
    return steps


def _factored(df: DataFrame, cov: dict[tuple[int, int], Column], *more: str) -> DataFrame:
    """(pool, start, m_i, l_i_j, logdet, more) from locations m_i and covariances."""
    for name, step in _cholesky(cov):
        df = df.withColumn(name, step)
    logdet = sum((2 * F.log(f"l_{i}_{i}") for i in range(P)), F.lit(0.0))
    return df.select("pool", "start", *(f"m_{i}" for i in range(P)), *(f"l_{i}_{j}" for i, j in _PAIRS), logdet.alias("logdet"), *more)


def _distances(rows: DataFrame, fit: DataFrame, few: bool, keep: Sequence[str] = ("pool", "start")) -> DataFrame:
    """Rows with every fit of their pool: start and distance, or what else of the fit to ``keep``."""
    out, squares = _attach(rows, fit, ["pool"], few), F.lit(0.0)
    for i in range(P):
        rest = F.col(f"x_{i}") - F.col(f"m_{i}")
        for k in range(i):
            rest = rest - F.col(f"l_{i}_{k}") * F.col(f"y_{k}")
        out = out.withColumn(f"y_{i}", rest / F.col(f"l_{i}_{i}"))
        squares = squares + F.col(f"y_{i}") * F.col(f"y_{i}")
    return out.withColumn("distance", F.sqrt(squares)).drop(*(c for c in fit.columns if c not in keep), *(f"y_{i}" for i in range(P)))


def _starts(rows: DataFrame, few: bool) -> DataFrame:
    """The fits that concentration begins with, four a pool."""
    long = rows.select("pool", F.posexplode(F.array(*(F.col(f"x_{i}") for i in range(P)))).alias("i", "x"))
    middle = scratch.write_out(_quantile(long.groupBy("pool", "i", F.floor(F.col("x") * BINS).cast("int").alias("bin")).agg(F.count("*").alias("n")), ["pool", "i"], 0.5), "mcd-median")
    near = _attach(long, middle, ["pool", "i"], few).select("pool", "i", F.floor(F.abs(F.col("x") * BINS - 0.5 - F.col("bin"))).cast("int").alias("off"))
    spread = _quantile(near.groupBy("pool", "i", F.col("off").alias("bin")).agg(F.count("*").alias("n")), ["pool", "i"], 0.5)
    both = middle.join(spread.withColumnRenamed("bin", "off"), ["pool", "i"]).groupBy("pool")
    at = lambda i, c: F.max(F.when(F.col("i") == i, (F.col(c) + 0.5) / BINS))
    scales = both.agg(*(at(i, "bin").alias(f"c_{i}") for i in range(P)), *(F.sqrt(F.pow(1.4826 * at(i, "off"), F.lit(2.0)) + FLOORS[i] ** 2).alias(f"s_{i}") for i in range(P)))
    scales = scratch.write_out(scales, "mcd-scale")
    z = _attach(rows, scales, ["pool"], few).select("pool", *((F.col(f"x_{i}") - F.col(f"c_{i}")) / F.col(f"s_{i}") for i in range(P))).toDF("pool", *(f"z_{i}" for i in range(P)))
    size = F.sqrt(sum((F.col(f"z_{i}") * F.col(f"z_{i}") for i in range(P)), F.lit(0.0)))
    forms = {"plain": lambda c: F.col(c), "tanh": lambda c: F.tanh(c), "sign": lambda c: F.col(c) / F.greatest("_size", F.lit(1e-9))}
    sums = z.withColumn("_size", size).groupBy("pool").agg(*(F.covar_pop(f(f"z_{i}"), f(f"z_{j}")).alias(f"{n}_{i}_{j}") for n, f in forms.items() for i, j in _PAIRS))

    def scatter(name: str) -> Column:
        """Of the standardised coordinates; correlations only, as the shapes have other sizes."""
        one = lambda i: F.greatest(F.col(f"{name}_{i}_{i}"), F.lit(1e-9))
        return F.struct(F.lit(name).alias("start"), *((F.col(f"{name}_{i}_{j}") / F.sqrt(one(i) * one(j)) if i != j else F.lit(1.0)).alias(f"r_{i}_{j}") for i, j in _PAIRS))

    alone = F.struct(F.lit("alone").alias("start"), *((F.lit(1.0) if i == j else F.lit(0.0)).alias(f"r_{i}_{j}") for i, j in _PAIRS))
    fits = sums.select("pool", F.explode(F.array(alone, *(scatter(n) for n in forms))).alias("f")).select("pool", "f.*").join(scales, "pool").withColumnsRenamed({f"c_{i}": f"m_{i}" for i in range(P)})
    return scratch.write_out(_factored(fits, {(i, j): F.col(f"r_{i}_{j}") * F.col(f"s_{i}") * F.col(f"s_{j}") for i, j in _PAIRS}), "mcd-start")


def _step(rows: DataFrame, fit: DataFrame, few: bool) -> DataFrame:
    """A concentration step of all starts: refit on the nearest rows. was: the log determinant before."""
    keys = ["pool", "start"]
    scored = _distances(rows, fit, few, (*keys, "logdet")).withColumn("bin", F.floor(F.log(F.greatest("distance", F.lit(1e-6))) * BINS).cast("int"))
    limit = _quantile(scored.groupBy(*keys, "bin").agg(F.count("*").alias("n")), keys, SUPPORT).withColumnRenamed("bin", "upto")
    near = _attach(scored, limit, keys, few).where("bin <= upto")
    x = [F.col(f"x_{i}") for i in range(P)]
    sums = near.groupBy(*keys).agg(F.max("logdet").alias("was"), *(F.avg(x[i]).alias(f"m_{i}") for i in range(P)), *(F.covar_pop(x[i], x[j]).alias(f"c_{i}_{j}") for i, j in _PAIRS))
    return scratch.write_out(_factored(sums, {p: CONSISTENCY * F.col(f"c_{p[0]}_{p[1]}") for p in _PAIRS}, "was"), "mcd-fit")


def least_determinant(rows: DataFrame, few: bool) -> DataFrame:
    """(pool, start, m_i, l_i_j, logdet): of each pool the converged fit whose determinant is least."""
    fit = _starts(rows, few)
    for step in range(STEPS):
        fit = _step(rows, fit, few)
        if step:
            fell = fit.agg(F.max(F.col("was") - F.col("logdet"))).first()[0]
            if fell is None or fell <= TOLERANCE:
                break
    best = fit.groupBy("pool").agg(F.min_by("start", F.struct("logdet", "start")).alias("start"))
    return fit.drop("was").join(best, ["pool", "start"])


def rate(df: DataFrame, text: str = "text", by: tuple[str, str] = ("lang", "source"), keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep``, ``by``, the statistics, base_failed, distance (null if base_failed) and kept of every row."""
    made = ("base_failed", "distance", "kept", *_STATISTICS)
    own = [c for c in dict.fromkeys([*keep, *by]) if c not in made]
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    lang, source = (F.col(f"`{c}`") for c in by)
    fine, coarse = F.to_json(F.struct(lang.alias("a"), source.alias("b"))).alias("_fine"), F.to_json(F.struct(lang.alias("a"))).alias("_coarse")
    base = df.select(_packed(own), fine, coarse, F.col(f"`{text}`").alias("_text"))
    table = scratch.write_out(statistics(base, "_text", ["_kept", "_fine", "_coarse"]).withColumn("base_failed", failed), "quality-stats")
    sizes = table.where("not base_failed").groupBy("_fine", "_coarse").agg(F.count("*").alias("n"))
    small = F.col("n") < LEAST_GROUP
    rest = sizes.where(small).groupBy("_coarse").agg(F.sum("n").alias("m"))
    pools = scratch.write_out(sizes.join(rest, "_coarse", "left").select("_fine", F.when(~small, F.col("_fine")).when(F.col("m") >= LEAST_GROUP, F.col("_coarse")).otherwise("*").alias("pool")), "quality-pools")
    vectors = [v.alias(f"x_{i}") for i, v in enumerate(_vector())]
    few = pools.count() <= BROADCAST_GROUPS
    rows = _attach(table, pools, ["_fine"], few).select(*table.columns, F.when(~F.col("base_failed"), F.col("pool")).alias("pool"), *vectors)
    with scratch.temporary(df.sparkSession) as kept:
        best = scratch.write_out(least_determinant(rows.where("not base_failed"), few), "mcd-best")
        kept.append(best)
    out = _distances(rows, best, few).select(*table.columns, F.when(~F.col("base_failed"), F.col("distance")).alias("distance"))
    return out.select(*_unpacked(own), *_STATISTICS, "base_failed", "distance", (~F.col("base_failed") & F.coalesce(F.col("distance") <= CUTOFF, F.lit(True))).alias("kept"))
