"""Quality rules: robust multivariate outliers by a minimum-covariance-determinant estimate per language and source.

Every document gets counts over its whole text. A base rule rejects very short and very repetitive texts. The
other documents are turned into a vector of transformed statistics, and for each group (language and source) the
location and scatter of the tightest ``coverage`` share of the vectors are estimated by concentration steps: distances
under the current estimate, the smallest distances that hold the share, mean and covariance of those, and so on, from
two starts (medians with quartile ranges, and the moments of all vectors) until no group's determinant falls any more.
A step that does not lower a group's determinant is not taken, and of the two ends the lesser determinant is the group's
estimate. The same is first done for each language as a whole; in the steps of a group of n vectors its mean and covariance
are mixed with its language's by the weights n and ``shrinkage``: a large source is judged by itself, a small one
(whose tightest share may be all of it, outliers included) mostly by its language, and nothing changes abruptly.

For the verdict only the harmful side of a statistic counts (``SIDES``): a text longer than its group's, or with fewer symbols or
repetitions, is none the worse for it. A document whose squared Mahalanobis distance on these sides exceeds ``cutoff``, a
quantile of the chi-squared distribution, is rejected.

The floors are far below what the cutoff allows each statistic, so that every one of them can reject a text alone.

All of it is DataFrame expressions. A step makes one pass over the (narrow) statistics table: moments are summed per
group, start and distance bin, so a hot group is pre-aggregated in every task and only groups x bins rows are shuffled.
The driver reads one flag a step: whether some group's determinant fell.

Cases: null text counts as empty (base rule fails); null language or source is a value of its own; a
source's only document is judged by its language's estimate almost alone; repeated rows each count and each get the same
verdict; extra columns pass through ``filter_documents`` untouched and are ignored by ``judge``; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from starweave.llm.common import let, materialize, small, words

# The characters counted as symbols.
SYMBOLS = "#*$%&|<>"

FEATURES = ("log_words", "word_length", "symbol_rate", "dup_line_rate", "repeat_rate")

# The harmful side of each feature (-1 below the group's mean, 1 above it, 0 both).
SIDES = (-1, 0, 1, 1, 1)


def _chi2_cdf(x: float, dof: int) -> float:
    """Chi-squared distribution function for odd ``dof``."""
    total, term = 0.0, math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
    for k in range(1, dof, 2):
        total += term
        term *= x / (k + 2)
    return math.erf(math.sqrt(x / 2)) - total


def chi2_quantile(share: float, dof: int) -> float:
    """The value that holds ``share`` of the chi-squared distribution below it."""
    lo, hi = 0.0, 200.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _chi2_cdf(mid, dof) < share else (lo, mid)
    return lo


@dataclass(frozen=True)
class Settings:
    """Parameters of the rules. ``floors``: least standard deviation of each feature, in the features' units.

    ``shrinkage``: the language's weight beside a group's n vectors. A determinant falls if its logarithm falls by more
    than ``tolerance``; ``max_steps`` only bounds a run whose sums differ by rounding from step to step.
    """

    min_words: int = 50
    max_repeat_percent: int = 50
    coverage: float = 0.75
    shrinkage: float = 50.0
    tolerance: float = 1e-6
    max_steps: int = 30
    cutoff: float = chi2_quantile(0.999, len(FEATURES))
    floors: tuple[float, ...] = (0.1, 0.2, 0.05, 0.12, 0.14)


def _repeat_words(grams: Column) -> Column:
    """Words covered by those 3-word windows (hashes in text order) that occur at least twice in the array.

    Only texts in which some window repeats are sorted; in sorted order equal windows are neighbours.
    """
    placed = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))

    def starts(ordered: Column) -> Column:
        def repeated(g: Column, i: Column) -> Column:
            return (F.coalesce(F.get(ordered, i - 1)["h"] == g["h"], F.lit(False))
                    | F.coalesce(F.get(ordered, i + 1)["h"] == g["h"], F.lit(False)))

        return F.transform(F.filter(ordered, repeated), lambda g: g["p"])

    covered = F.size(F.array_distinct(F.flatten(F.transform(let(placed, starts), lambda p: F.array(p, p + 1, p + 2)))))
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(covered).cast("long")


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, plus n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (longs)."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    split = docs.select(
        *rest,
        (F.size(F.split(text, f"[{SYMBOLS}]", -1)) - 1).cast("long").alias("n_symbols"),
        words(text).alias("__words"),
        F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__lines"))
    ws, lines = F.col("__words"), F.col("__lines")
    counted = split.select(
        *rest,
        F.size(ws).cast("long").alias("n_words"),
        F.char_length(F.array_join(ws, "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.transform(ws, lambda w: F.xxhash64(w)).alias("__hashes"))
    h, n = F.col("__hashes"), F.col("n_words").cast("int")
    chained = lambda a, b: F.xxhash64(a, b)
    pairs = F.zip_with(F.slice(h, F.lit(1), F.greatest(n - 2, F.lit(0))), F.slice(h, F.lit(2), F.greatest(n - 2, F.lit(0))), chained)
    grams = F.zip_with(pairs, F.slice(h, F.lit(3), F.greatest(n - 2, F.lit(0))), chained)
    out = counted.withColumn("__grams", grams)
    return out.withColumn("n_repeat_words", _repeat_words(F.col("__grams"))).drop("__hashes", "__grams")


def _vector() -> list[Column]:
    """The transformed statistics, in the order of FEATURES (only asked for where there are words)."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [F.log(n), F.col("word_chars") / n, F.sqrt(F.col("n_symbols") / n),
            F.sqrt(F.col("n_dup_lines") / (n / 8 + F.col("n_dup_lines"))), F.sqrt(F.col("n_repeat_words") / n)]


def consistency_factor(coverage: float, dof: int) -> float:
    """What the covariance of the tightest ``coverage`` share is multiplied by to be that of a normal sample."""
    return coverage / _chi2_cdf(chi2_quantile(coverage, dof), dof + 2)


def _distance(p: int, sides: tuple[int, ...] | None = None) -> Column:
    """Squared Mahalanobis distance of x0.. under the joined m0.., l00.. (forward substitution).

    With ``sides`` a feature on its harmless side counts as equal to the mean. The expressions of this module's steps are
    SQL text: a step has some hundred of them, and one call each to build them takes the driver longer than the step.
    """
    text = " + ".join(f"y{i} * y{i}" for i in range(p))
    for i in reversed(range(p)):
        rest = f"x{i} - m{i}"
        if sides and sides[i]:
            rest = f"{'greatest' if sides[i] > 0 else 'least'}({rest}, 0D)"
        rest = " - ".join([f"({rest})", *[f"l{i}{k} * y{k}" for k in range(i)]])
        text = f"element_at(transform(array(({rest}) / l{i}{i}), y{i} -> {text}), 1)"
    return F.expr(text)


def _with_cholesky(out: DataFrame, p: int) -> DataFrame:
    """``out`` with the lower factor l00.. of the covariance c00.., column by column: each diagonal, then what is below it."""
    def left(i: int, j: int) -> str:
        return " - ".join([f"c{i}{j}", *[f"l{i}{k} * l{j}{k}" for k in range(j)]])

    for j in range(p):
        out = out.selectExpr("*", f"sqrt(greatest({left(j, j)}, 1e-12D)) AS l{j}{j}")
        if j + 1 < p:
            out = out.selectExpr("*", *[f"({left(i, j)}) / l{j}{j} AS l{i}{j}" for i in range(j + 1, p)])
    return out


def _from_moments(sums: DataFrame, keys: list[str], p: int, factor: float, floors: tuple[float, ...],
                  target: DataFrame | None = None, shrinkage: float = 0.0) -> DataFrame:
    """Per group the mean m0.. and the Cholesky factor l00.. of the scaled covariance with its diagonal floored.

    With a ``target`` (estimates by language, ``g.lang``) they are those of a mixture of the group, by weight n, and its
    target, by weight ``shrinkage``.
    """
    pairs = [(i, j) for i in range(p) for j in range(i + 1)]
    out = sums.selectExpr(*keys, "n", *[f"s{i} / n AS m{i}" for i in range(p)], *[f"q{i}{j} / n AS e{i}{j}" for i, j in pairs])
    floor = lambda i, j: floors[i] ** 2 if i == j else 0.0
    out = out.selectExpr(*keys, "n", *[f"m{i}" for i in range(p)],
                         *[f"{float(factor)!r}D * (e{i}{j} - m{i} * m{j}) + {floor(i, j)!r}D AS c{i}{j}" for i, j in pairs])
    if target is not None:
        aim = target.selectExpr("g.lang AS t_lang", *[f"m{i} AS t{i}" for i in range(p)],
                                *[" + ".join(f"l{i}{k} * l{j}{k}" for k in range(j + 1)) + f" AS t{i}{j}" for i, j in pairs])
        out = out.join(small(aim, 400), F.col("g.lang").eqNullSafe(F.col("t_lang")))
        own = f"(n / (n + {float(shrinkage)!r}D))"
        out = out.selectExpr(*keys, *[f"{own} * m{i} + (1 - {own}) * t{i} AS m{i}" for i in range(p)],
                             *[f"{own} * c{i}{j} + (1 - {own}) * t{i}{j} + {own} * (1 - {own}) * ((m{i} - t{i}) * (m{j} - t{j}))"
                               f" AS c{i}{j}" for i, j in pairs])
    out = _with_cholesky(out, p)
    return out.select(*keys, *[f"m{i}" for i in range(p)], *[f"l{i}{j}" for i, j in pairs])


def _start(vectors: DataFrame, keys: list[str], p: int, floors: tuple[float, ...]) -> DataFrame:
    """Medians and quartile ranges per group and feature, read from counts on a fixed grid of 1/64."""
    cells = (vectors.select(*keys, F.posexplode(F.array(*[F.floor(F.col(f"x{i}") * 64) for i in range(p)])).alias("f", "cell"))
             .groupBy(*keys, "f", "cell").agg(F.count(F.lit(1)).alias("n")))
    w = Window.partitionBy(*keys, "f")
    run = cells.select("*", F.sum("n").over(w.orderBy("cell")).alias("upto"), F.sum("n").over(w).alias("all"))
    at = lambda share: (F.min(F.when(F.col("upto") >= share * F.col("all"), F.col("cell"))) + 0.5) / 64
    quart = run.groupBy(*keys, "f").agg(at(0.25).alias("lo"), at(0.5).alias("mid"), at(0.75).alias("hi"))
    scale = lambda i: f"greatest((hi - lo) / 1.349D, {float(floors[i])!r}D)"
    return quart.groupBy(*keys).agg(
        *[F.expr(f"max(CASE WHEN f = {i} THEN mid END) AS m{i}") for i in range(p)],
        *[F.expr((f"max(CASE WHEN f = {i} THEN {scale(i)} END)" if i == j else "max(0D)") + f" AS l{i}{j}")
          for i in range(p) for j in range(i + 1)])


def _moments(vectors: DataFrame, keys: list[str], p: int) -> DataFrame:
    """n, sums s0.. and sums of products q00.. per key."""
    return vectors.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *[F.expr(f"sum(x{i}) AS s{i}") for i in range(p)],
        *[F.expr(f"sum(x{i} * x{j}) AS q{i}{j}") for i in range(p) for j in range(i + 1)])


def _estimate(vectors: DataFrame, p: int, s: Settings, target: DataFrame | None = None) -> DataFrame:
    """Per group ``g`` the location m0.. and Cholesky factor l00.. of least determinant (see the module's docstring)."""
    factor = consistency_factor(s.coverage, p)
    shape = [f"m{i}" for i in range(p)] + [f"l{i}{j}" for i in range(p) for j in range(i + 1)]
    everything = _moments(vectors, ["g"], p).withColumn("start", F.lit(1))
    classical = _from_moments(everything, ["g", "start"], p, 1.0, s.floors, target, s.shrinkage)
    starts = _start(vectors, ["g"], p, s.floors).withColumn("start", F.lit(0)).unionByName(classical)
    model = materialize(starts.select("g", "start", *shape, F.lit(float("inf")).alias("logdet")), "mcd-starts")
    for step in range(s.max_steps):
        near = _with_distance(vectors, model, p, keep=("start",))
        sums = _moments(near.withColumn("bin", F.floor(F.log(1 + F.col("distance")) * 32)), ["g", "start", "bin"], p)
        w = Window.partitionBy("g", "start")
        inside = sums.select("*", (F.sum("n").over(w.orderBy("bin")) - F.col("n")).alias("before"),
                             F.sum("n").over(w).alias("all")).filter(F.col("before") < s.coverage * F.col("all"))
        cols = ["n", *[f"s{i}" for i in range(p)], *[f"q{i}{j}" for i in range(p) for j in range(i + 1)]]
        subset = inside.groupBy("g", "start").agg(*[F.expr(f"sum({c}) AS {c}") for c in cols])
        new = _from_moments(subset, ["g", "start"], p, factor, s.floors, target, s.shrinkage)
        new = new.withColumn("logdet", F.expr(" + ".join(f"2 * ln(l{i}{i})" for i in range(p))))
        new = new.select(F.col("g").alias("n_g"), F.col("start").alias("n_start"), F.struct("logdet", *shape).alias("new"))
        both = model.join(new, F.col("g").eqNullSafe(F.col("n_g")) & (F.col("start") == F.col("n_start")))
        both = both.withColumn("fell", F.col("new.logdet") < F.col("logdet") - s.tolerance)
        model = materialize(both.selectExpr("g", "start", "fell", *[
            f"if(fell, new.{c}, {c}) AS {c}" for c in (*shape, "logdet")]), f"mcd-{step}")
        if not model.filter("fell").limit(1).count():
            break
    best = model.groupBy("g").agg(F.min(F.struct("logdet", "start", *shape)).alias("best"))
    return materialize(best.selectExpr("g", *[f"best.{c} AS {c}" for c in shape]), "mcd")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          source_col: str = "source", settings: Settings = Settings(), keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: its id, the counts, ``base_failed``, the squared ``distance`` (of both sides of every
    feature; null where the base rule already failed) and ``kept`` (by the harmful sides). ``keep`` names further input
    columns to carry along."""
    p, s = len(FEATURES), settings
    narrow = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text"),
                         F.col(f"`{lang_col}`").cast("string").alias("g_lang"),
                         F.col(f"`{source_col}`").cast("string").alias("g_source"),
                         *[F.col(f"`{c}`").alias(f"__keep{i}") for i, c in enumerate(keep)])
    counted = with_counts(narrow, "__text").withColumn(
        "base_failed", (F.col("n_words") < s.min_words)
        | (100 * F.col("n_repeat_words") > s.max_repeat_percent * F.col("n_words")))
    counted = materialize(counted.select("*", *[c.alias(f"x{i}") for i, c in enumerate(_vector())]), "quality-stats")

    group = lambda source: F.struct(F.col("g_lang").alias("lang"), source.cast("string").alias("source"))
    grouped = counted.withColumn("g", group(F.col("g_source")))
    vectors = grouped.filter(~F.col("base_failed"))
    languages = _estimate(vectors.withColumn("g", group(F.lit(None))), p, s)
    model = _estimate(vectors, p, s, languages)

    judged = _with_distance(grouped, model, p, SIDES)
    distance = F.when(~F.col("base_failed"), F.col("distance"))
    harm = F.when(~F.col("base_failed"), F.col("harm"))
    return judged.select(
        F.col("__id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        distance.alias("distance"),
        (~F.col("base_failed") & F.coalesce(harm <= s.cutoff, F.lit(True))).alias("kept"),
        *[F.col(f"__keep{i}").alias(c) for i, c in enumerate(keep)])


def _with_distance(vectors: DataFrame, model: DataFrame, p: int, sides: tuple[int, ...] | None = None,
                   keep: tuple[str, ...] = ()) -> DataFrame:
    """``vectors`` with ``distance`` under its group's estimate (null for a group without one), and ``harm``, the distance
    on the given sides; ``keep`` names further columns of the model."""
    m = model.withColumnRenamed("g", "m_g")
    out = vectors.join(small(m, 400), F.col("g").eqNullSafe(F.col("m_g")), "left")
    harm = [_distance(p, sides).alias("harm")] if sides else []
    return out.select(*vectors.columns, *keep, _distance(p).alias("distance"), *harm)


def filter_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                     source_col: str = "source", settings: Settings = Settings()) -> DataFrame:
    """The documents that ``judge`` keeps, with all their columns.

    Rejected rows are found by (id, hash of language, source and text): rows that agree in these get one verdict, so
    repeated ids and rows are told apart rightly. The rejected keys are broadcast only within the size limit.
    """
    def key(d: DataFrame) -> Column:
        c = lambda name: F.col(f"`{name}`")
        marks = F.concat(*[c(x).isNull().cast("string") for x in (text_col, lang_col, source_col)])
        return F.struct(c(id_col).alias("id"), F.xxhash64(c(text_col), c(lang_col), c(source_col), marks).alias("h"))

    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key(docs).alias("__key"))
    flat = keyed.select("__key", F.col("row")[id_col].alias("id"), F.col("row")[text_col].alias("text"),
                        F.col("row")[lang_col].alias("lang"), F.col("row")[source_col].alias("source"))
    verdict = judge(flat, "id", "text", "lang", "source", settings, keep=("__key",))
    rejected = materialize(verdict.filter(~F.col("kept")).select(F.col("__key").alias("r_key")).distinct(), "rejected")
    out = keyed.join(small(rejected, 64), F.col("__key").eqNullSafe(F.col("r_key")), "left_anti")
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns])
