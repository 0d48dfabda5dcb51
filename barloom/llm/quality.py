"""Quality rules: robust multivariate outliers by minimum-covariance-determinant estimates, native expressions only.

Every text gives a vector of four transformed statistics. For each language and source, concentration steps look for the
share of documents whose covariance has the least determinant: distances from the current centre and scatter, the rows
within the share's quantile, their mean and covariance, and again, until no determinant changes. They run from two starts
side by side, and of each group the end with the lesser determinant counts. A document is rejected when its Mahalanobis
distance from the group's estimate is beyond a chi-square quantile.

All sums are over whole numbers and all quantiles over counted bins, so results don't depend on the order of rows, and
nothing larger than a table of groups and bins leaves the map side.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, documents, materialize

SPLIT = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
UNIT = 10_000  # whole numbers in one unit of a transformed statistic
SHARE, STEPS, TAIL, LEAST_ROWS = 0.75, 6, 1e-5, 64
#: Words of the shortest text that passes the base rules, words of its least repeat (two windows of three), and lines and
#: words of five characters that stand in for what a short text doesn't tell.
SHORTEST, REPEAT, LINES, WORDS = 50, 6, 20, 50
P = 4
X = [f"x{i}" for i in range(P)]


def chi2_cdf(x: float, dof: int) -> float:
    """For even degrees of freedom."""
    term, total = 1.0, 0.0
    for i in range(dof // 2):
        total += term
        term *= x / 2 / (i + 1)
    return 1 - math.exp(-x / 2) * total


def chi2_quantile(q: float, dof: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, dof) < q else (low, mid)
    return high


CUT = chi2_quantile(1 - TAIL, P)
#: What the covariance of the nearest SHARE of a normal sample lacks.
CONSISTENCY = SHARE / chi2_cdf(chi2_quantile(SHARE, P), P + 2)


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once, whatever the optimiser does with projections."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeat_words(words: Column) -> Column:
    """Words in three-word windows that occur twice or more, from hashed windows in sorted order."""

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda x, k: F.when(k == 0, 3).otherwise(F.least(F.lit(3), x - F.get(at, k - 1))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, s: a + s)

    def repeated(s: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        again = F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1))
        return let(F.array_sort(F.transform(again, lambda x: x["at"])), covered)

    def of(windows: Column) -> Column:
        pairs = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("at")))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(let(F.array_sort(pairs), repeated))

    def hashed(w: Column) -> Column:
        three = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
        return F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(let(F.transform(F.sequence(F.lit(0), F.size(w) - 3), three), of))

    return let(words, hashed)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, lang, source and the counts of each text; a null text has no words and no lines. No shuffle."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(text, SPLIT), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike(WORD))
    counts = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words")))
    by_line = let(lines, lambda s: F.struct(F.size(s).cast("long").alias("n_lines"), (F.size(s) - F.size(F.array_distinct(s))).cast("long").alias("n_dup_lines")))
    return docs.select(
        F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"),
        counts.alias("c"), by_line.alias("l"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    ).select("doc_id", "lang", "source", "c.n_words", "word_chars", "n_symbols", "l.n_lines", "l.n_dup_lines", "c.n_repeat_words")


def with_vector(stats: DataFrame) -> DataFrame:
    """base_failed, and the transformed statistics as whole numbers of 1/UNIT."""
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    raw = (
        F.ln((F.col("word_chars") + 5.0 * WORDS) / (F.col("n_words") + float(WORDS))),
        F.ln(ratio("n_symbols", "n_words") + 1.0),
        F.asin(F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + float(LINES)))),
        F.asin(F.sqrt(F.least(ratio("n_repeat_words", "n_words"), F.lit(1.0)))),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stats.withColumns({x: F.round(v * UNIT).cast("long") for x, v in zip(X, raw, strict=True)} | {"base_failed": failed})


def groups(rows: DataFrame, least: int = LEAST_ROWS) -> DataFrame:
    """lang, source and group of each pair: its own, or that of the language's small sources, or that of all the rest."""
    pairs = rows.groupBy("lang", "source").agg(F.count("*").alias("n"))
    pairs = pairs.withColumn("small", F.col("n") < least)
    by_lang = Window.partitionBy("lang", "small")
    pairs = pairs.withColumn("of_lang", F.sum("n").over(by_lang))
    name = lambda *c: F.to_json(F.struct(*c), {"ignoreNullFields": "false"})
    group = F.when(~F.col("small"), name("lang", "source")).when(F.col("of_lang") >= least, name("lang")).otherwise("rest")
    return pairs.select("lang", "source", group.alias("g"))


def by_group(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Join estimates to rows. One row per group: small or not, the adaptive planner looks at its true size, and splits
    the partition of a hot group when it has to shuffle."""
    return rows.join(table, "g")


def floors(passing: DataFrame) -> tuple[float, ...]:
    """Standard deviations that are added to each estimate, since statistics that are zero for most documents have none:
    what one character or symbol makes in the shortest text that passes, and what one repeated line or window makes in a
    text of the median number of lines or words. Two whole numbers come to the driver."""
    half = {r.g: r.cut for r in bin_at(passing.select(F.explode(F.array(*(F.struct(F.lit(c).alias("g"), F.col(c).alias("bin")) for c in ("n_lines", "n_words")))).alias("r")).select("r.*"), 0.5, ["g"]).collect()}
    lines, words = max(half.get("n_lines", 1), 1), max(half.get("n_words", SHORTEST), SHORTEST)
    size = 5.0 * (SHORTEST + WORDS)
    return math.log((size + 1) / size), math.log(1 / SHORTEST + 1), math.asin(math.sqrt(1 / (lines + LINES))), math.asin(math.sqrt(REPEAT / words))


def bin_at(binned: DataFrame, share: float, by: list[str]) -> DataFrame:
    """`by` and the least bin `cut` that holds at least `share` of the group's rows with all before it."""
    counts = binned.groupBy(*by, "bin").agg(F.count("*").alias("n"))
    up = Window.partitionBy(*by).orderBy("bin")
    counts = counts.withColumns({"upto": F.sum("n").over(up), "all": F.sum("n").over(Window.partitionBy(*by))})
    return counts.where(F.col("upto") >= F.col("all") * share).groupBy(*by).agg(F.min("bin").alias("cut"))


def distance(rows: DataFrame) -> DataFrame:
    """d2 of each row from m0.. and the Cholesky factor l00, l10, l11, ..: forward substitution."""
    made = {}
    for i in range(P):
        v = F.col(X[i]).cast("double") / UNIT - F.col(f"m{i}")
        for j in range(i):
            v = v - F.col(f"l{i}{j}") * F.col(f"y{j}")
        rows = rows.withColumn(f"y{i}", v / F.col(f"l{i}{i}"))
        made[i] = F.col(f"y{i}") * F.col(f"y{i}")
    return rows.withColumn("d2", sum(made.values(), F.lit(0.0)))


ENDS = ["g", "start"]
FACTOR = [f"l{i}{j}" for i in range(P) for j in range(i + 1)]
ESTIMATE = [f"m{i}" for i in range(P)] + FACTOR


def log_det() -> Column:
    """Of the scatter, to nine places."""
    return F.round(sum((2 * F.ln(F.col(f"l{i}{i}")) for i in range(1, P)), 2 * F.ln(F.col("l00"))), 9).alias("log_det")


def moments(kept: DataFrame, scale: float, floor: tuple[float, ...]) -> DataFrame:
    """Mean and Cholesky factor of `scale` times the covariance plus the squared floors, by group and start."""
    dec = lambda c: c.cast("decimal(20,0)")
    sums = {f"s{i}": F.sum(dec(F.col(X[i]))) for i in range(P)}
    sums |= {f"q{i}{j}": F.sum(dec(F.col(X[i]) * F.col(X[j]))) for i in range(P) for j in range(i + 1)}
    out = kept.groupBy(*ENDS).agg(F.count("*").alias("n"), *(v.alias(k) for k, v in sums.items()))
    out = out.withColumns({f"m{i}": F.col(f"s{i}").cast("double") / F.col("n") / UNIT for i in range(P)})
    out = out.withColumns({
        f"c{i}{j}": F.lit(scale) * (F.col(f"q{i}{j}").cast("double") / F.col("n") / (UNIT * UNIT) - F.col(f"m{i}") * F.col(f"m{j}"))
        + (floor[i] ** 2 if i == j else 0.0)
        for i in range(P) for j in range(i + 1)
    })
    for i in range(P):
        for j in range(i + 1):
            v = F.col(f"c{i}{j}")
            for k in range(j):
                v = v - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(v, F.lit(1e-12))) if i == j else v / F.col(f"l{j}{j}"))
    return out.select(*ENDS, *ESTIMATE)


def starts(rows: DataFrame, floor: tuple[float, ...]) -> DataFrame:
    """Coordinate medians with the floors as scales (start 0), and with the spread of the middle half added (start 1)."""
    long = rows.select("g", F.posexplode(F.array(*(F.floor(F.col(x) / 20).cast("long") for x in X))).alias("i", "bin"))
    cuts = [bin_at(long, q, ["g", "i"]).withColumnRenamed("cut", name) for q, name in ((0.25, "low"), (0.5, "mid"), (0.75, "high"))]
    table = cuts[0].join(cuts[1], ["g", "i"]).join(cuts[2], ["g", "i"])
    pick = lambda c, i: F.max(F.when(F.col("i") == i, c))
    wide = table.groupBy("g").agg(
        *(pick((F.col("mid") * 20 + 10) / F.lit(float(UNIT)), i).alias(f"m{i}") for i in range(P)), *(pick((F.col("high") - F.col("low")) * 20 / F.lit(1.349 * UNIT), i).alias(f"w{i}") for i in range(P)),
    )
    wide = wide.withColumn("start", F.explode(F.array(F.lit(0), F.lit(1))))
    scale = {f"l{i}{j}": F.sqrt(F.lit(floor[i] ** 2) + F.col("start") * F.col(f"w{i}") * F.col(f"w{i}")) if i == j else F.lit(0.0) for i in range(P) for j in range(i + 1)}
    return wide.withColumns(scale).select(*ENDS, *ESTIMATE)


def estimates(rows: DataFrame, floor: tuple[float, ...], steps: int = STEPS) -> DataFrame:
    """The minimum-covariance-determinant estimate of each group of `rows` (g, x0..): of both starts the one whose last
    determinant is less, the first of equals. After `steps` steps it stops unsettled."""
    current = materialize(starts(rows, floor))
    for _ in range(steps):
        near = distance(by_group(rows, current)).withColumn("bin", F.floor(F.ln(F.col("d2") + 1) * 64).cast("long"))
        cuts = materialize(bin_at(near, SHARE, ENDS))
        inside = near.join(cuts, ENDS).where(F.col("bin") <= F.col("cut"))
        after = materialize(moments(inside, CONSISTENCY, floor))
        before = current.select(*ENDS, log_det().alias("was"))
        changed = after.select(*ENDS, log_det()).join(before, ENDS).where("log_det <> was").limit(1).count()
        current = after
        if not changed:
            break
    best = Window.partitionBy("g").orderBy(log_det(), "start")
    return materialize(current.withColumn("_rn", F.row_number().over(best)).where("_rn = 1").drop("_rn", "start"))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, the counts, base_failed, d2 and kept for every row of `docs`.

    Null and empty texts have no words and fail the base rules. A null language or source is a value of its own. Sources
    with fewer than LEAST_ROWS rows of a language are estimated together. Estimates come from the rows that pass the base
    rules, and a row that fails them is never kept. Repeated rows count each time. d2 is null for a row that fails.
    """
    rows = materialize(with_vector(statistics(docs, id_col, text_col, lang_col, source_col)))
    wanted = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    failing = rows.where("base_failed").select(*wanted, F.lit(None).cast("double").alias("d2"), F.lit(False).alias("kept"))
    return judge(rows, fit(rows)).select(*wanted, F.round("d2", 9).alias("d2"), "kept").unionByName(failing)


def fit(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The group of each (lang, source), and the estimates of each group."""
    passing = rows.where(~F.col("base_failed"))
    named = materialize(groups(passing))
    return named, estimates(materialize(grouped(passing, named).select("g", *X)), floors(passing))


def grouped(passing: DataFrame, named: DataFrame) -> DataFrame:
    named = named.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), "g")
    return passing.join(named, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")))


def judge(rows: DataFrame, model: tuple[DataFrame, DataFrame]) -> DataFrame:
    """d2 and kept of the rows that pass the base rules."""
    named, found = model
    return distance(by_group(grouped(rows.where(~F.col("base_failed")), named), found)).withColumn("kept", F.col("d2") <= CUT)


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of `docs` that quality() keeps, with all their columns, whatever their names. Rows are written beside
    their counts once, so that texts are parsed once and aren't shuffled; ids play no part."""
    whole = docs.select(F.struct(*docs.columns).alias("whole"))
    rows = materialize(with_vector(statistics(whole, "whole", f"whole.{text_col}", f"whole.{lang_col}", f"whole.{source_col}")))
    return judge(rows, fit(rows.drop("doc_id"))).where("kept").select("doc_id.*")


def op2(spark, sf_dir):
    """Counts and verdict of every row of `documents`; nulls, empty texts and repeated rows as quality() says."""
    return quality(documents(spark, sf_dir, "doc_id", "text", "lang", "source"))
