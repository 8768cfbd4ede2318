"""Quality rules with robust outlier rejection, in DataFrame functions only.

Statistics of every text become a short vector. Per language and source a minimum-covariance-
determinant estimate is sought from four starts around the medians: each concentration step keeps the rows nearest
by Mahalanobis distance and fits mean and covariance to them, until the determinant falls no more, and
the fit of least determinant counts. Distances are ranked in fine fixed bins, so a step is two
combinable aggregates however many rows share a group; nothing is collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import without_columns, written

SPACE = " \t\n\x0b\f\r"
GAP = "[ \\t\\n\\x0B\\f\\r]+"
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5

VECTOR = ["v0", "v1", "v2", "v3"]
SCALE = [0.5, 0.05, 0.25, 0.1]  # the least standard deviation of each statistic that counts as spread
MEAN = ["m0", "m1", "m2", "m3"]
PAIRS = [(i, j) for i in range(4) for j in range(i + 1)]
ROOT = [f"l{i}{j}" for i, j in PAIRS]
FIT = ["k1", "k2", "start"]
KEPT_SHARE = 0.75
LEAST_FALL = 1e-4  # of the logarithm of the determinant
NORMAL_QUARTILES = 1.349  # between the quartiles of a normal distribution of unit spread
CUT = 30.0
MIN_GROUP = 20  # five rows for each statistic
MIN_LANGUAGE = 5  # the fewest rows that span four dimensions
MOST_SENT = 50_000  # groups whose fits go to every task; more are joined by a shuffle
BINS_PER_UNIT = 64.0  # of the logarithm of a distance, and of a scaled statistic


def base_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words, base_failed.

    A null text counts as empty. Windows of five words are compared by a 64-bit hash; only a text in
    which one occurs twice sorts its windows.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "base_failed"]
    held = without_columns(docs, *names, "__body", "__words", "__lines", "__windows", "__ranked", "__at")
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    lines = F.filter(F.split("__body", "\n"), lambda x: F.length(F.trim(x, F.lit(SPACE))) > 0)
    words = F.split(F.trim("__body", F.lit(SPACE)), GAP)
    df = held.withColumn("__body", body).withColumns({"__words": F.filter(words, lambda w: w != ""), "__lines": lines})
    df = df.withColumns(
        {
            "n_words": F.size("__words").cast("bigint"),
            "word_chars": F.length(F.array_join("__words", "")).cast("bigint"),
            "n_symbols": (F.length("__body") - F.length(F.regexp_replace("__body", SYMBOLS, ""))).cast("bigint"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint"),
            "n_lines": F.size("__lines").cast("bigint"),
            "__windows": F.when(
                F.size("__words") > WINDOW,
                F.transform(
                    F.sequence(F.lit(1), F.size("__words") - (WINDOW - 1)),
                    lambda i: F.xxhash64(F.slice("__words", i, WINDOW)),
                ),
            ),
        }
    )
    twice = F.size(F.array_distinct("__windows")) < F.size("__windows")
    ranked = F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("__ranked", F.when(twice, ranked))

    def hash_at(j):
        return F.get(F.col("__ranked"), j)["h"]

    def repeats(x, j):
        return F.coalesce(hash_at(j - 1) == x["h"], F.lit(False)) | F.coalesce(hash_at(j + 1) == x["h"], F.lit(False))

    starts = F.transform(F.filter("__ranked", repeats), lambda x: x["i"])
    df = df.withColumn("__at", F.sort_array(starts))
    covered = F.transform("__at", lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("__at"), j + 1) - x, F.lit(WINDOW))))
    df = df.withColumn("n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("bigint"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return df.withColumn("base_failed", failed).select(*[F.col(f"`{c}`") for c in held.columns], *[F.col(f"`{n}`") for n in names])


def statistic_vector() -> list[Column]:
    """The transformed statistics: word length (steadier the more words), and three shares under a root."""
    n, chars = F.greatest(F.col("n_words"), F.lit(1)).cast("double"), F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    return [
        F.log(chars / n) * F.sqrt(F.least(n, F.lit(400.0))),
        F.sqrt(F.col("n_symbols") / chars),
        F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        F.sqrt(F.col("n_repeat_words") / n),
    ]


def distance(means: list[str] = ("m0", "m1", "m2", "m3"), root: str = "l") -> Column:
    """Squared Mahalanobis distance of the vector by forward substitution in the Cholesky root."""
    solved: list[Column] = []
    for i, (v, m) in enumerate(zip(VECTOR, means, strict=True)):
        rest = reduce(lambda a, k: a - F.col(f"{root}{i}{k}") * solved[k], range(i), F.col(v) - F.col(m))
        solved.append(rest / F.col(f"{root}{i}{i}"))
    return reduce(lambda a, b: a + b, [y * y for y in solved])


def with_root(fits: DataFrame) -> DataFrame:
    """Add the Cholesky root l{i}{j} of the covariance s{i}{j}, which the scale floor keeps positive."""
    for i in range(len(VECTOR)):
        for j in range(i + 1):
            rest = reduce(lambda a, k: a - F.col(f"l{i}{k}") * F.col(f"l{j}{k}"), range(j), F.col(f"s{i}{j}"))
            if i == j:
                fits = fits.withColumn(f"l{i}{i}", F.sqrt(F.greatest(rest, F.lit(SCALE[i] ** 2))))
            else:
                fits = fits.withColumn(f"l{i}{j}", rest / F.col(f"l{j}{j}"))
    return fits


def sent(df: DataFrame) -> DataFrame:
    """``df``, a row per fit, for a join with rows: up to ``MOST_SENT`` fits go to every task, so no group of rows is gathered in one."""
    return F.broadcast(df) if df.count() <= MOST_SENT else df


def nearest_share(counts: DataFrame, share: float) -> DataFrame:
    """The lowest bin of each fit below or at which ``share`` of its rows lie, from (k1, k2, start, bin, n)."""
    whole = Window.partitionBy(*FIT)
    ranked = counts.withColumn("below", F.sum("n").over(whole.orderBy("bin"))).withColumn("total", F.sum("n").over(whole))
    enough = F.col("below") >= F.ceil(F.col("total") * share)
    return ranked.where(enough).groupBy(*FIT).agg(F.min("bin").alias("limit"))


def centres(rows: DataFrame) -> DataFrame:
    """Per group its rows, and of each statistic the median m and a spread w from the quartiles, to a bin."""
    bins = F.array(*[F.floor(F.col(v) / s * BINS_PER_UNIT) for v, s in zip(VECTOR, SCALE, strict=True)])
    counts = rows.select("k1", "k2", F.posexplode(bins).alias("dim", "bin")).groupBy("k1", "k2", "dim", "bin").agg(F.count("*").alias("n"))
    part = Window.partitionBy("k1", "k2", "dim")
    ranked = counts.withColumn("below", F.sum("n").over(part.orderBy("bin"))).withColumn("total", F.sum("n").over(part))
    quartiles = [F.min(F.when(4 * F.col("below") >= q * F.col("total"), F.col("bin"))).alias(f"q{q}") for q in (1, 2, 3)]
    ranks = ranked.groupBy("k1", "k2", "dim").agg(F.min("total").alias("total"), *quartiles)
    found = []
    for i, s in enumerate(SCALE):
        own = F.col("dim") == i
        spread = F.greatest((F.col("q3") - F.col("q1")) / (NORMAL_QUARTILES * BINS_PER_UNIT), F.lit(1.0)) * s
        found += [F.max(F.when(own, (F.col("q2") + 0.5) / BINS_PER_UNIT * s)).alias(f"m{i}"), F.max(F.when(own, spread)).alias(f"w{i}")]
    return ranks.groupBy("k1", "k2").agg(F.min("total").alias("total"), *found)


def starting_fits(rows: DataFrame, centre: DataFrame) -> DataFrame:
    """Four fits of each group in ``centre``, all around its medians.

    Their spreads are the scale floor, the quartiles, the covariance of the hyperbolic tangents of the
    standardised statistics, and that of their spatial signs. None of them follows far rows.
    """
    near = rows.join(sent(centre), ["k1", "k2"])
    z = [(F.col(v) - F.col(f"m{i}")) / F.col(f"w{i}") for i, v in enumerate(VECTOR)]
    length = F.greatest(reduce(lambda a, b: a + b, [x * x for x in z]), F.lit(1e-12))
    near = near.select("k1", "k2", *[x.alias(f"z{i}") for i, x in enumerate(z)], length.alias("length"))
    sums = []
    for i, j in PAIRS:
        sums.append(F.covar_pop(F.tanh(f"z{i}"), F.tanh(f"z{j}")).alias(f"t{i}{j}"))
        sums.append(F.avg(F.col(f"z{i}") * F.col(f"z{j}") / F.col("length")).alias(f"u{i}{j}"))
    shapes = centre.join(near.groupBy("k1", "k2").agg(*sums), ["k1", "k2"])

    def shape(start: int, i: int, j: int) -> Column:
        floor = F.lit(SCALE[i] ** 2 if i == j else 0.0)
        sides = F.col(f"w{i}") * F.col(f"w{j}")
        return [floor, sides if i == j else F.lit(0.0), F.col(f"t{i}{j}") * sides + floor, F.col(f"u{i}{j}") * sides + floor][start]

    def fit(start: int) -> Column:
        return F.struct(F.lit(start).alias("start"), *[shape(start, i, j).alias(f"s{i}{j}") for i, j in PAIRS])

    each = shapes.withColumn("fit", F.explode(F.array(*[fit(start) for start in range(4)])))
    return with_root(each.select("k1", "k2", "total", *MEAN, "fit.*")).select(*FIT, "total", *MEAN, *ROOT)


def concentrate(rows: DataFrame, fits: DataFrame) -> DataFrame:
    """One concentration step: every fit again, from the share of its group's rows nearest to it.

    ``volume`` is the logarithm of the determinant of the new covariance.
    """
    near = rows.join(sent(fits), ["k1", "k2"]).withColumn("bin", F.floor(F.log(distance() + 1e-6) * BINS_PER_UNIT).cast("int"))
    near = near.select(*FIT, "bin", "total", *VECTOR)
    limits = nearest_share(near.groupBy(*FIT, "bin").agg(F.count("*").alias("n")), KEPT_SHARE)
    inside = near.join(sent(limits), FIT).where("bin <= limit")
    sums = [F.avg(v).alias(m) for v, m in zip(VECTOR, MEAN, strict=True)]
    sums += [(F.covar_pop(VECTOR[i], VECTOR[j]) + (SCALE[i] ** 2 if i == j else 0.0)).alias(f"s{i}{j}") for i, j in PAIRS]
    refit = with_root(inside.groupBy(*FIT).agg(F.min("total").alias("total"), *sums))
    volume = reduce(lambda a, b: a + b, [2 * F.log(f"l{i}{i}") for i in range(len(VECTOR))])
    return refit.select(*FIT, "total", *MEAN, *ROOT, volume.alias("volume"))


def least_determinants(rows: DataFrame, centre: DataFrame) -> DataFrame:
    """(k1, k2, total, mean, root, volume): of each group in ``centre`` the fit of least determinant.

    Every start is concentrated until a step lowers its determinant no more; of starts that have met,
    one goes on. Each step but a fit's last lowers the determinant by ``LEAST_FALL`` at least, and the
    scale floor bounds it from below, so the steps end.
    """
    columns = [*FIT, "total", *MEAN, *ROOT, "volume"]
    fits = written(concentrate(rows, written(starting_fits(rows, centre), "quality-starts")), "quality-fits")
    settled = fits.limit(0)
    while not fits.isEmpty():
        same = Window.partitionBy("k1", "k2", *[F.round(c, 9) for c in (*MEAN, "volume")]).orderBy("start")
        going = written(fits.withColumn("place", F.row_number().over(same)).where("place = 1").select(*columns), "quality-going")
        lower = concentrate(rows, going).withColumnRenamed("volume", "now")
        old = going.select(*FIT, "volume")
        step = written(lower.join(old, FIT), "quality-step")
        falls = F.col("now") < F.col("volume") - LEAST_FALL
        settled = settled.unionByName(going.join(step.where(~falls).select(*FIT), FIT, "left_semi"))
        fits = step.where(falls).drop("volume").withColumnRenamed("now", "volume").select(*columns)
    best = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("volume", "start"))
    return written(settled.withColumn("place", best).where("place = 1").drop("place", "start"), "quality-least")


def read_groups(centre: DataFrame) -> DataFrame:
    """The rows of ``centre`` by whose fits some row is judged.

    These are groups of ``MIN_GROUP`` rows, languages of ``MIN_LANGUAGE`` rows with a smaller group, and
    all rows together if a smaller group has no such language.
    """
    own = (F.col("k1") != "*") & (F.col("k2") != "*")
    few = centre.where(own & (F.col("total") < MIN_GROUP)).select("k1").distinct()
    spoken = centre.where((F.col("k1") != "*") & (F.col("k2") == "*") & (F.col("total") >= MIN_LANGUAGE)).join(few, "k1", "left_semi")
    found = centre.where(own & (F.col("total") >= MIN_GROUP)).unionByName(spoken.select(*centre.columns))
    if few.join(spoken, "k1", "left_anti").isEmpty():
        return found
    return found.unionByName(centre.where(F.col("k1") == "*"))


def quality_rules(
    docs: DataFrame,
    text: str = "text",
    language: str = "lang",
    source: str = "source",
    cut: float = CUT,
    carry_text: bool = True,
    by_language: bool = False,
) -> DataFrame:
    """``docs`` with its statistics, ``base_failed``, ``outlier_distance`` and ``kept``.

    ``kept`` is false for rows that fail the base rules and for rows whose squared Mahalanobis
    distance from their language's and source's estimate exceeds ``cut``. Estimates learn from all
    rows that pass the base rules. A null language or source is a group of its own. A group of fewer
    than ``MIN_GROUP`` such rows is judged by the estimate over all rows; with ``by_language`` by that
    of its language over all sources, if this has ``MIN_LANGUAGE`` rows. Null and empty texts fail
    the base rules. Columns of ``docs`` with the names of new ones give way. Repeated rows count as
    often as they stand there; an empty table gives an empty result. Without ``carry_text`` the text
    column is left out, so that only statistics are written on the way.
    """
    docs = without_columns(docs, "kept", "outlier_distance", *VECTOR, "k1", "k2")
    stats = base_statistics(docs, text)
    if not carry_text:
        stats = without_columns(stats, text)
    keys = {"k1": F.coalesce(F.concat(F.lit("="), F.col(f"`{language}`")), F.lit("")), "k2": F.coalesce(F.concat(F.lit("="), F.col(f"`{source}`")), F.lit(""))}
    table = written(stats.withColumns({**dict(zip(VECTOR, statistic_vector(), strict=True)), **keys}), "quality-statistics")
    passed = table.where(~F.col("base_failed"))
    every = F.lit("*").alias("k2")
    levels = [F.struct("k1", "k2"), *([F.struct("k1", every)] if by_language else []), F.struct(F.lit("*").alias("k1"), every)]
    rows = passed.select(F.explode(F.array(*levels)).alias("k"), *VECTOR).select("k.k1", "k.k2", *VECTOR)
    centre = written(centres(rows), "quality-centres")
    fits = least_determinants(rows, written(read_groups(centre), "quality-groups")).drop("volume")
    pooled = fits.where(F.col("k1") == "*")
    shared = {c: f"all_{c}" for c in fits.columns if c not in ("k1", "k2", "total")}
    own = fits.where(F.col("k2") != "*")
    if by_language:
        # Settled per group, so that the rows meet one fit by language and source and never by language alone.
        spoken = fits.where((F.col("k2") == "*") & (F.col("k1") != "*")).drop("k2", "total")
        few = centre.where((F.col("k2") != "*") & (F.col("total") < MIN_GROUP)).select("k1", "k2", "total")
        own = own.unionByName(few.join(spoken, "k1"))
    pooled = pooled.select(F.lit(False).alias("base_failed"), *[F.col(c).alias(a) for c, a in shared.items()])
    judged = table.join(own.drop("total"), ["k1", "k2"], "left").join(F.broadcast(pooled), "base_failed", "left")
    judged = judged.withColumns({c: F.coalesce(F.col(c), F.col(a)) for c, a in shared.items()})
    far = F.when(~F.col("base_failed"), distance())
    judged = judged.withColumn("outlier_distance", far).withColumn("kept", F.coalesce(F.col("outlier_distance") <= cut, F.lit(False)))
    return judged.select(*[F.col(f"`{c}`") for c in stats.columns], "outlier_distance", "kept")
