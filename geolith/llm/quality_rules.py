"""Quality rules: counts of words, symbols and repeats, then robust multivariate outliers.

The statistics of each text become a vector of transformed, quantised values. For each language and source a
minimum-covariance-determinant estimate is concentrated: from medians and median deviations,
each step takes the rows nearest by Mahalanobis distance, `SHARE` of them at least, and computes
their mean and scatter anew. A text is rejected if its distance from its group's estimate is over the
cutoff. All of it is DataFrame expressions; the sums run over integers, so they don't depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geolith.llm.common import WORD, cut, session, written

#: Part of a group that an estimate rests on, concentration steps, and rows below which groups are pooled.
SHARE, STEPS, LEAST = 0.75, 3, 100
#: A statistic counts in steps of 1 / SCALE. Deviations below FLOOR are no evidence, however uniform a group is. The last two floors leave
#: room for a rejection by repeated lines alone (over 92 % of them) and by repeated words alone (over 48 %; the base rule takes 50 %).
SCALE, FLOOR = 256, (0.30, 0.05, 0.30, 0.16, 0.115)
#: Chi-square with 5 degrees of freedom, quantile 0.999999, and the consistency factor of a share of 0.75.
CUTOFF, CONSISTENCY = 35.89, 1.413
DIM = len(FLOOR)


def base_counts(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumn("words", F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    out = out.withColumn("lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)))
    out = out.withColumns(
        {
            "n_words": F.size("words").cast("long"),
            "word_chars": F.length(F.array_join("words", "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long"),
            "n_lines": F.size("lines").cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            "hashes": F.transform("words", lambda x: F.xxhash64(x)),
        }
    ).drop("words", "lines")
    # Windows of three words as (part of a hash, position) in one number: the position takes as many bits as n_words needs.
    # What agrees in that part is a candidate; candidates are sorted again by two whole hashes, whatever the length of the text.
    bits = F.length(F.bin("n_words"))
    at = F.when(F.col("n_words") >= 3, F.sequence(F.lit(0), F.col("n_words").cast("int") - 3)).otherwise(F.array().cast("array<int>"))
    out = out.withColumn("bits", bits)
    window = lambda i: F.xxhash64(F.get("hashes", i), F.get("hashes", i + 1), F.get("hashes", i + 2))
    other = lambda i: F.hash(F.get("hashes", i + 2), F.get("hashes", i), F.get("hashes", i + 1))
    out = out.withColumn("sorted", F.sort_array(F.transform(at, lambda i: F.call_function("shiftleft", window(i), F.col("bits")).bitwiseOR(i.cast("long")))))
    high = lambda x: F.call_function("shiftright", x, F.col("bits"))
    like = lambda x, i: F.coalesce(high(x) == high(F.get("sorted", i)), F.lit(False))
    twice = F.filter("sorted", lambda x, i: like(x, i - 1) | like(x, i + 1))
    low = lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bits")) - 1)
    whole = lambda x: F.struct(window(low(x)).alias("h"), other(low(x)).alias("g"), low(x).alias("i"))
    out = out.withColumn("found", F.sort_array(F.transform(twice, whole))).drop("sorted", "bits", "hashes")
    same = lambda x, i: F.coalesce((x["h"] == F.get("found", i)["h"]) & (x["g"] == F.get("found", i)["g"]), F.lit(False))
    out = out.withColumn("twice", F.sort_array(F.transform(F.filter("found", lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"]))).drop("found")
    covers = F.transform("twice", lambda p, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get("twice", i + 1) - p, F.lit(3).cast("long"))))
    out = out.withColumn("n_repeat_words", F.aggregate(covers, F.lit(0).cast("long"), lambda a, x: a + x)).drop("twice")
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def statistics() -> list[Column]:
    """The transformed statistics, in steps of 1 / SCALE: length, word length, symbols, repeated lines, repeated words."""
    n, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    values = [F.log(1.0 + F.col("n_words")), F.log((1.0 + F.col("word_chars")) / n), F.log(1.0 + 100.0 * F.col("n_symbols") / chars), F.sqrt(F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))), F.sqrt(F.col("n_repeat_words") / n)]
    return [F.floor(v * SCALE + 0.5).cast("long") for v in values]


def _distance() -> Column:
    """Squared Mahalanobis distance of x0.. from the estimate m0.., l00.. (the scatter's Cholesky factor)."""
    z: list[Column] = []
    for i in range(DIM):
        rest = F.col(f"x{i}") - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * z[j]
        z.append(rest / F.col(f"l{i}{i}"))
    return sum((v * v for v in z[1:]), z[0] * z[0])


def _estimate(rows: DataFrame) -> DataFrame:
    """Mean, Cholesky factor and determinant of each group's rows, from integer sums."""
    sums = [F.sum(f"x{i}").alias(f"s{i}") for i in range(DIM)] + [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}{j}") for i in range(DIM) for j in range(i + 1)]
    e = rows.groupBy("grp").agg(F.count("*").alias("n"), *sums).withColumns({f"m{i}": F.col(f"s{i}") / F.col("n") for i in range(DIM)})
    for i in range(DIM):  # one column at a time: each entry rests on those before it
        for j in range(i + 1):
            c = F.col(f"s{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")
            c = c * CONSISTENCY + (FLOOR[i] * SCALE) ** 2 if i == j else c * CONSISTENCY
            for k in range(j):
                c = c - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            e = e.withColumn(f"l{i}{j}", F.sqrt(F.greatest(c, F.lit(1.0))) if i == j else c / F.col(f"l{j}{j}"))
    det = F.col("l00")
    for i in range(1, DIM):
        det = det * F.col(f"l{i}{i}")
    return e.select("grp", *[f"m{i}" for i in range(DIM)], *[f"l{i}{j}" for i in range(DIM) for j in range(i + 1)], (det * det).alias("determinant"))


def _start(rows: DataFrame) -> DataFrame:
    """Medians and median deviations; the values are integers of a small range, so a median keeps few counts."""
    mid = rows.groupBy("grp").agg(*[F.median(f"x{i}").alias(f"m{i}") for i in range(DIM)])
    spread = rows.join(_small(cut(mid)), "grp").groupBy("grp").agg(*[F.first(f"m{i}").alias(f"m{i}") for i in range(DIM)], *[F.median(F.abs(F.col(f"x{i}") - F.col(f"m{i}"))).alias(f"d{i}") for i in range(DIM)])
    factor = {(i, j): F.lit(0.0) if i != j else F.sqrt(F.pow(1.4826 * F.col(f"d{i}"), 2) + (FLOOR[i] * SCALE) ** 2) for i in range(DIM) for j in range(i + 1)}
    return spread.select("grp", *[f"m{i}" for i in range(DIM)], *[c.alias(f"l{i}{j}") for (i, j), c in factor.items()])


def _small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """A written table of one row for each group: broadcast if it has at most `most` rows."""
    return F.broadcast(df) if df.count() <= most else df


def mcd(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """rows (grp, x0..) -> for each group the estimate m0.., l00.. after `steps` concentration steps."""
    estimate = cut(_start(rows))
    for _ in range(steps):
        estimate = _small(estimate)
        # The rows nearest by distance, in steps of 1/64: all up to the first step that holds SHARE of the group.
        near = rows.join(estimate, "grp").withColumn("bin", F.least(F.floor(F.sqrt(_distance()) * 64), F.lit(1 << 20)).cast("long"))
        bins = near.groupBy("grp", "bin").agg(F.count("*").alias("n"))
        w = Window.partitionBy("grp")
        bins = bins.withColumns({"upto": F.sum("n").over(w.orderBy("bin")), "all": F.sum("n").over(w)})
        edge = bins.where(F.col("upto") >= SHARE * F.col("all")).groupBy("grp").agg(F.min("bin").alias("edge"))
        estimate = cut(_estimate(near.join(_small(cut(edge)), "grp").where("bin <= edge")))
    return _small(estimate)


def _names(docs: DataFrame) -> tuple[Column, Column]:
    """Language and source as keys that are never null."""
    lang = F.concat(F.lit("l"), F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")))
    return lang, F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))


def judged(docs: DataFrame, carry: bool = False) -> DataFrame:
    """docs (doc_id, text, lang, source, ...) -> base counts, base_failed, distance (squared; null without an
    estimate) and kept, one row per row of docs; with carry, `row` is a struct of all columns.

    Null texts have no words and fail. Null languages and sources are groups like others. A group with fewer than
    LEAST rows that pass the base rules is pooled with the small groups of its language, then with all that are
    small; below LEAST even then, the base rules alone decide. Texts of any length are counted exactly. Repeated rows count each and
    get the same verdict; rows at equal distance are taken together, so ties decide nothing. Other columns are ignored, whatever
    their names. An empty table gives no rows.
    """
    session(docs.sparkSession)
    lang, source = _names(docs)
    row = [F.struct(*docs.columns).alias("row")] if carry else []
    stats = base_counts(docs.select(F.col("doc_id").alias("doc_id"), "text", lang.alias("lang"), source.alias("source"), *row)).drop("text")
    stats = stats.withColumns({f"x{i}": x for i, x in enumerate(statistics())})
    stats = written(stats) if carry else cut(stats)
    usable = stats.where("not base_failed")
    size = usable.groupBy("lang", "source").agg(F.count("*").alias("n"))
    w, every = Window.partitionBy("lang", F.col("n") >= LEAST), Window.partitionBy("pooled")
    size = size.withColumn("of_lang", F.sum("n").over(w)).withColumn("pooled", (F.col("n") < LEAST) & (F.col("of_lang") < LEAST)).withColumn("of_all", F.sum("n").over(every))
    name = F.when(F.col("n") >= LEAST, F.concat("lang", F.lit("\x01"), "source")).when(F.col("of_lang") >= LEAST, F.concat("lang", F.lit("\x02"))).when(F.col("of_all") >= LEAST, F.lit("\x03"))
    groups = cut(size.select("lang", "source", name.alias("grp")))
    stats = stats.join(_small(groups), ["lang", "source"], "left")
    estimate = mcd(stats.where("not base_failed and grp is not null").select("grp", *[f"x{i}" for i in range(DIM)]))
    out = stats.join(estimate, "grp", "left").withColumn("distance", _distance())
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= CUTOFF, F.lit(True)))


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def passing(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with the columns of docs, as `judged` decides in every case it names. The rows are written
    once with their counts, and met by their verdict where they are: no text is shuffled."""
    return judged(docs, carry=True).where("kept").select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
