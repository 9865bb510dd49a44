"""Quality rules: robust multivariate outliers by minimum covariance determinant, per language and source.

DataFrame functions only. The statistics of a text are expressions over its words; from them comes a
vector of variance-stabilised rates (arcsine of the square root of the symbol, repeated-line and
repeated-word rates, and the log of the mean word length). For every language and source, concentration
steps look for the half of the rows whose covariance has the smallest determinant: distances, their
median, moments of the rows below it, again. They begin at several
``starts`` (all axes scaled by their median deviation, each axis alone, seeded directions); after
``STEPS`` steps the two smallest determinants of a group go on until they no longer fall, and the
smallest is the estimate. A rate of a short text says little: its own sampling variance is added to the
estimate before the squared Mahalanobis distance is held against ``CUT``.

Few rows say little as well. In every group, whatever its size, the rows below the median count against
``PRIOR_ROWS`` rows in the middle of the corpus, of the ``PRIOR`` spread: in large groups that is nothing,
in a group of two rows nearly all.

All group figures come from grouped aggregation that combines before the shuffle: moments and quantile
summaries of bounded size, so a source with a third of all rows costs a few rows per task.

Defined cases: null or empty text has no words and fails the base rule; null lang or source is a value
of its own; repeated rows and null or repeated ids count as often as they occur and get equal verdicts;
an empty table gives no rows; columns of the input that clash with the added ones are replaced, others
of any name pass through.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.llm.shared import release, saved

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Concentration steps from all starts, before the best go on.
STEPS = 2
#: Steps after that, at most; the determinant converges long before.
MOST_STEPS = 30
#: A determinant that falls by less than this share has converged.
FALL = 1e-3
#: Squared distance beyond which a vector is rejected; chi-square of 4 degrees exceeds it with 1e-4.
CUT = 23.513
CHI2_MEDIAN = 3.357
#: Least standard deviation of each part of the vector, against division by nothing.
FLOORS = (0.01, 0.01, 0.01, 0.01)
#: What is known of a group before its rows are: standard deviations, and how many rows that counts for.
PRIOR = (0.1, 0.2, 0.2, 0.25)
PRIOR_ROWS = 5
#: No covariance of the floors above has a smaller determinant.
LEAST_DET = 1e-20
#: Seeded directions among the starts.
DIRECTIONS = ((0.8, 0.3, -0.4, 0.3), (0.2, -0.7, 0.3, 0.6))
#: Entries of a quantile summary: ranks are exact to a thousandth of a group's rows.
ACCURACY = 1000
#: Words that are counted as repeated come in two windows of five at least.
REPEAT_BLOCK = 10
DIMS = range(len(FLOORS))
LOWER = [(i, j) for i in DIMS for j in range(i + 1)]
WHITE = " \t\n\x0b\x0c\r"

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
ADDED = [*STATS, "base_failed", "distance", "kept"]


def windows_of(words: Column) -> Column:
    """64-bit hashes of the five-word windows, by their start."""
    return F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - 4, F.lit(0))), lambda x, i: F.xxhash64(x, *(F.get(words, i + k) for k in range(1, 5))))


def repeat_words(windows: Column) -> Column:
    """Words in windows that the text has twice or more. windows: ``windows_of`` its words.

    Only a text that repeats a window at all has them sorted, with their places: n log n.
    """
    placed = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def starts_of(order: Column) -> Column:
        again = lambda x, k: F.coalesce(F.get(order, k)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(order, lambda x, k: again(x, k - 1) | again(x, k + 1)), lambda x: x["i"]))

    def covered(at: Column) -> Column:
        new = F.zip_with(F.slice(at, 2, F.size(at)), F.slice(at, 1, F.size(at) - 1), lambda b, a: F.least(b - a, F.lit(5)))
        return F.aggregate(new, F.lit(5), lambda x, y: x + y)

    # one-element arrays hold what is used more than once
    held = F.transform(F.transform(F.array(placed), starts_of), covered)
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), F.get(held, F.lit(0))).otherwise(0)


def with_statistics(docs: DataFrame, text: str = "text", carried: list[str] | None = None) -> DataFrame:
    """``_doc`` (the carried columns), ``_lang``, ``_source``, the base statistics and ``_n_lines``, lines that have a word."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    # white space at the ends goes first, so that no word is empty
    bare = F.btrim(t, F.lit(WHITE))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))
    rows = docs.select(
        F.struct(*(c for c in (docs.columns if carried is None else carried) if c not in ADDED)).alias("_doc"),
        F.col("lang").cast("string").alias("_lang"),
        F.col("source").cast("string").alias("_source"),
        F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
        words.alias("_words"),
    )
    rows = rows.select(
        "_doc", "_lang", "_source",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        windows_of(F.col("_words")).alias("_windows"),
        F.size("_lines").cast("long").alias("_n_lines"),
    )
    return rows.withColumn("n_repeat_words", repeat_words(F.col("_windows")).cast("long")).drop("_windows")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def vector() -> list[Column]:
    def rate(part: str, whole: str) -> Column:
        return F.asin(F.sqrt(F.least(F.lit(1.0), F.col(part) / F.greatest(F.col(whole), F.lit(1)))))

    return [rate("n_symbols", "word_chars"), rate("n_dup_lines", "_n_lines"), rate("n_repeat_words", "n_words"), F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1)))]


def sampling() -> list[Column]:
    """Sampling variance of each part of the vector: 1 / (4 n) for the arcsine of the root of a rate of n."""
    return [1 / (4.0 * F.greatest(n, F.lit(1))) for n in (F.col("word_chars"), F.col("_n_lines"), F.col("n_words") / REPEAT_BLOCK, F.col("n_words"))]


def median(x: Column) -> Column:
    return F.percentile_approx(x, 0.5, ACCURACY)


def total(parts: list[Column]) -> Column:
    return reduce(add, parts)


def starts() -> list[Column]:
    """What orders the rows of a group at first. Columns: o0, ... off the group's medians, and their median deviations s0, ..."""
    u = [F.col(f"o{i}") / F.col(f"s{i}") for i in DIMS]
    directions = [F.pow(total([F.lit(d[i]) * u[i] for i in DIMS]), F.lit(2)) for d in DIRECTIONS]
    return [total([x * x for x in u]), *(x * x for x in u), *directions]


def adjugate(c: dict[tuple[int, int], Column]) -> tuple[dict[tuple[int, int], Column], Column]:
    """Cofactors and determinant of a symmetric 4 x 4 matrix, from its 2 x 2 minors: one expression each."""
    at = lambda i, j: c[max(i, j), min(i, j)]
    upper = {(i, j): at(0, i) * at(1, j) - at(0, j) * at(1, i) for i in DIMS for j in DIMS if i < j}
    lower = {(i, j): at(2, i) * at(3, j) - at(2, j) * at(3, i) for i in DIMS for j in DIMS if i < j}
    rows = {0: (1, lower), 1: (0, lower), 2: (3, upper), 3: (2, upper)}

    def cofactor(i: int, j: int) -> Column:
        r, minors = rows[i]
        a, b, d = (k for k in DIMS if k != j)
        x = at(r, a) * minors[b, d] - at(r, b) * minors[a, d] + at(r, d) * minors[a, b]
        return x if (i + j) % 2 == 0 else -x

    det = total([sign * upper[p] * lower[q] for sign, p, q in ((1, (0, 1), (2, 3)), (-1, (0, 2), (1, 3)), (1, (0, 3), (1, 2)), (1, (1, 2), (0, 3)), (-1, (1, 3), (0, 2)), (1, (2, 3), (0, 1)))])
    return {(i, j): cofactor(i, j) for i, j in LOWER}, F.greatest(det, F.lit(LEAST_DET))


def quadratic(p: dict[tuple[int, int], Column], y: list[Column]) -> Column:
    return total([p[i, j] * y[i] * y[j] * (1.0 if i == j else 2.0) for i, j in LOWER])


def moments(near: DataFrame) -> DataFrame:
    """Per group and start: mean and covariance of the rows, with what is known before, its inverse and determinant."""
    z = [F.col(f"z{i}") for i in DIMS]
    own = near.groupBy("g", "start").agg(
        F.count("*").alias("h"),
        *(F.avg(z[i]).alias(f"m{i}") for i in DIMS),
        *((F.covar_pop(z[i], z[j]) if i != j else F.var_pop(z[i])).alias(f"c{i}{j}") for i, j in LOWER),
    )
    share = F.col("h") / (F.col("h") + PRIOR_ROWS)
    own = own.withColumns({f"c{i}{j}": share * F.col(f"c{i}{j}") + ((1 - share) * PRIOR[i] ** 2 + FLOORS[i] ** 2 if i == j else 0.0) for i, j in LOWER})
    cofactors, det = adjugate({(i, j): F.col(f"c{i}{j}") for i, j in LOWER})
    return own.withColumns({"det": det} | {f"a{i}{j}": cofactors[i, j] for i, j in LOWER})


def concentrated(rows: DataFrame) -> DataFrame:
    """Moments of the rows (g, start, d2, z0, ...) up to the median of d2."""
    # a table of its own: its size is known, so the rows of a large group aren't dealt by its key
    cuts = saved(rows.groupBy("g", "start").agg(median(F.col("d2")).alias("cut")), "cuts")
    models = saved(moments(rows.join(cuts, ["g", "start"]).where("d2 <= cut")), "moments")
    release(cuts)
    return models


def step(vectors: DataFrame, models: DataFrame) -> DataFrame:
    """One concentration step from each model."""
    y = [F.col(f"z{i}") - F.col(f"m{i}") for i in DIMS]
    d2 = quadratic({(i, j): F.col(f"a{i}{j}") for i, j in LOWER}, y) / F.col("det")
    return concentrated(vectors.join(models, "g").select("g", "start", *(f"z{i}" for i in DIMS), d2.alias("d2")))


def estimates(vectors: DataFrame) -> DataFrame:
    """Per group g: the mean m0, ... and covariance c00, ... of the half with the smallest determinant det.

    vectors: g, z0, ...
    """
    z = [f"z{i}" for i in DIMS]
    medians = saved(vectors.groupBy("g").agg(*(median(F.col(f"z{i}")).alias(f"q{i}") for i in DIMS)), "medians")
    off = {f"o{i}": F.col(f"z{i}") - F.col(f"q{i}") for i in DIMS}
    begun = vectors.join(medians, "g").withColumns(off).select("g", *z, *off)
    spread = saved(begun.groupBy("g").agg(*((1.4826 * median(F.abs(f"o{i}")) + FLOORS[i]).alias(f"s{i}") for i in DIMS)), "deviations")
    tables = [concentrated(begun.join(spread, "g").select("g", *z, F.posexplode(F.array(*starts())).alias("start", "d2")))]
    release(medians, spread)
    for _ in range(STEPS):
        tables.append(step(vectors, tables[-1]))
        release(tables.pop(0))
    best = Window.partitionBy("g").orderBy("det", "start")  # over one row per start
    falling = tables[0].withColumn("_place", F.row_number().over(best)).where("_place <= 2").drop("_place")
    for _ in range(MOST_STEPS):
        new = step(vectors, falling)
        was = falling.select("g", "start", F.col("det").alias("was"))
        tables.append(new)
        falling = new.join(was, ["g", "start"]).where(F.col("det") < (1 - FALL) * F.col("was")).drop("was")
        if falling.isEmpty():
            break
    # a start's determinant never rises, so the least of all steps is the last that fell
    models = reduce(DataFrame.unionByName, tables).withColumn("_place", F.row_number().over(best)).where("_place = 1").drop("_place", *(f"a{i}{j}" for i, j in LOWER))
    found = saved(models, "models")
    release(*tables)
    return found


def judged(rows: DataFrame) -> DataFrame:
    """rows (from ``with_statistics``) with base_failed, distance (squared, scaled; null where the base rule fails) and kept."""
    group = F.to_json(F.struct(F.col("_lang").alias("lang"), F.col("_source").alias("source")))
    x, v = vector(), sampling()
    rows = rows.withColumns({"base_failed": base_failed(), "g": group} | {f"x{i}": x[i] for i in DIMS} | {f"v{i}": v[i] for i in DIMS})
    some = rows.where(~F.col("base_failed"))
    middle = some.agg(*(median(F.col(f"x{i}")) for i in DIMS)).first()
    centred = {f"z{i}": F.col(f"x{i}") - F.lit(middle[i] or 0.0) for i in DIMS}
    vectors = saved(some.withColumns(centred).select("g", *centred, *(f"v{i}" for i in DIMS)), "vectors")
    # the mean too is that of the rows and of PRIOR_ROWS rows in the middle of the corpus
    found = estimates(vectors)
    model = found.withColumns({f"m{i}": F.col("h") / (F.col("h") + PRIOR_ROWS) * F.col(f"m{i}") for i in DIMS})
    # rows in the middle of the distances lie where chi-square has its median, or nearer
    halves = vectors.join(model, "g").select("g", final_distance().alias("d2")).groupBy("g").agg(median(F.col("d2")).alias("half"))
    # (one row says nothing of that)
    known = (F.col("h") - 1) / (F.col("h") - 1 + PRIOR_ROWS)
    scale = F.pow(F.greatest(F.lit(1.0), F.col("half") / CHI2_MEDIAN), known)
    model = saved(model.join(halves, "g").withColumn("scale", scale).drop("half", "start", "det", "h"), "estimates")
    release(found, vectors)
    met = rows.withColumns(centred).join(model, "g", "left")
    distance = F.when(~F.col("base_failed"), final_distance() / F.col("scale"))
    return met.withColumn("distance", distance).withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= CUT, F.lit(False)))


def final_distance() -> Column:
    """Squared Mahalanobis distance, the covariance being the model's c00, ... and the row's sampling variance v0, ..."""
    cofactors, det = adjugate({(i, j): F.col(f"c{i}{j}") + F.col(f"v{i}") if i == j else F.col(f"c{i}{j}") for i, j in LOWER})
    return quadratic(cofactors, [F.col(f"z{i}") - F.col(f"m{i}") for i in DIMS]) / det


def quality(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the base statistics, base_failed, distance (squared, scaled) and kept."""
    return judged(saved(with_statistics(docs, text), "statistics")).select("_doc.*", *ADDED)


def op6(docs: DataFrame) -> DataFrame:
    rows = saved(with_statistics(docs.select("doc_id", "text", "lang", "source"), carried=["doc_id"]), "statistics")
    return judged(rows).select("_doc.doc_id", *STATS, "base_failed", "kept", "distance")


def stage(docs: DataFrame) -> DataFrame:
    """Documents that pass; rejected ones go. Columns and rows stay as they are, null and repeated ids too."""
    rows = saved(with_statistics(docs.select(F.struct(*docs.columns).alias("_whole"), "text", "lang", "source"), carried=["_whole"]), "statistics")
    return judged(rows).where("kept").select("_doc._whole.*")
