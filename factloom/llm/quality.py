"""Quality rules: robust multivariate outliers within each language and source.

A text is summarised by four transformed statistics: mean word length (shrunk to
a common value for short texts), symbols a word, the share of repeated lines and
the share of words in repeated five-word windows. For each (language, source),
each language and all documents together a minimum-covariance-determinant
estimate of their location and scatter is fitted over all documents that pass
the base rules. It has several starts: the coordinate-wise medians and quartiles,
and `DRAWS` small subsets drawn by a hash. From each, concentration steps keep the
`CORE` share of documents at the least distance and estimate again; after `EARLY`
steps the `BEST` starts of least determinant go on until it stops falling, and
the least determinant of all counts. A last step reweights.

A concentration step is one aggregation: rows are grouped by key, start and a
fine logarithmic bin of their distance, with the sums and products of each bin,
so a group of any size is a few hundred partial sums, combined before they move;
the nearest bins that make up the core share give the next estimate.

A document is judged by its (language, source), whose estimate is drawn towards
that of the language, and this towards that of all documents, with the weight
`SHRINK` / (n + `SHRINK`). Documents whose Mahalanobis distance is above `CUTOFF`
are rejected.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.common import lean, saved, slices, table

CORE = 0.75
#: Drawn starts, documents of each; steps before the best starts are chosen; how many go on; steps at most.
DRAWS, DRAWN, EARLY, BEST, STEPS = 4, 24, 2, 2, 30
#: Documents that the coarser estimate counts for.
SHRINK = 50.0
#: Squared distance: the 1 - 1e-6 quantile of chi-squared with four degrees of freedom.
CUTOFF = 33.38
#: Its 0.975 quantile: what the last step uses.
REWEIGHT_CUT = 11.143
#: Factors that make the covariance of a normal cut at its 0.75 and 0.975 quantiles consistent.
CORE_SCALE, REWEIGHT_SCALE = 1.486, 1.064
#: Least standard deviations: what differs by less is never an outlier.
FLOOR = np.array([0.15, 0.02, 0.10, 0.05])
#: Keys with parameters that may be broadcast, about 400 bytes each.
BROADCAST_KEYS = 20_000
BLANK = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
D = 4


def repeated_words(words: list, width: int = 5) -> int:
    """Words inside windows of `width` words that occur twice or more in the list."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    if n > 100_000:  # arrays instead of tuples: exact ranks of ever longer windows
        codes: dict = {}
        rank = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words))
        one = rank
        for _ in range(width - 1):
            rank = np.unique(rank[:-1] * len(codes) + one[len(one) - len(rank) + 1 :], return_inverse=True)[1]
        repeated = np.bincount(rank)[rank] > 1
        marks = np.zeros(len(words) + 1, np.int64)
        marks[:n] += repeated
        marks[width : width + n] -= repeated
        return int((np.cumsum(marks) > 0).sum())
    windows = list(zip(*(words[i:] for i in range(width)), strict=False))
    if len(set(windows)) == n:
        return 0
    times, end, total = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if times[w] > 1:
            total += i + width - max(i, end)
            end = i + width
    return total


def statistics(text: str | None) -> tuple[int, ...]:
    """The counts named in STATISTICS; zeros for null."""
    if not text:
        return (0,) * len(STATISTICS)
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(BLANK)]
    dup = len(lines) - len(set(lines))
    return (len(words), len(text) - sum(map(text.count, BLANK)), sum(map(text.count, SYMBOLS)), dup, repeated_words(words), len(lines))


def with_statistics(docs: DataFrame, prefix: str = "") -> DataFrame:
    """Every row with the STATISTICS of its text added, each name after `prefix`."""
    import pyarrow as pa

    at = docs.columns.index("text")

    def run(batches):
        for part in slices(batches):
            counts = np.array([statistics(t) for t in part.column(at).to_pylist()], np.int64).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c) for c in counts.T)], [*part.schema.names, *(prefix + s for s in STATISTICS)])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), *(f"`{prefix}{s}` long" for s in STATISTICS)])
    return docs.mapInArrow(lean(run), schema)


def base_failed(prefix: str = ""):
    n = F.col(f"{prefix}n_words")
    return (n < 10) | (100 * F.col(f"{prefix}n_repeat_words") > 20 * n)


def vector(prefix: str = ""):
    """The transformed statistics, as an array of doubles."""
    n = F.col(f"{prefix}n_words")
    some = F.greatest(n, F.lit(1))
    return F.array(
        (F.col(f"{prefix}word_chars") + 150.0) / (n + 30.0),
        F.log1p(F.col(f"{prefix}n_symbols") / some),
        F.col(f"{prefix}n_dup_lines") / (F.col(f"{prefix}n_lines") + 3.0),
        F.col(f"{prefix}n_repeat_words") / some,
    )


def keys(lang: str = "lang", source: str = "source"):
    """Keys of a row from fine to coarse, then a blank; null languages and sources are values of their own."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    return F.array(F.concat(F.lit("1"), part(lang), F.lit("\x01"), part(source)), F.concat(F.lit("2"), part(lang)), F.lit("3"), F.lit(""))


def with_parameters(rows: DataFrame, params: DataFrame, levels: dict[int, int]) -> DataFrame:
    """Rows (level, key, ...) with the parameters of their key.

    levels: the counted number of keys of each level; few are broadcast, so that
    no key of many rows is in one task, and many are joined in a shuffle, where
    each holds a small share or is split as a skewed one.
    """
    out = None
    for level, n in levels.items():
        own = params.where(F.col("level") == level).drop("level", "parent")
        met = rows.where(F.col("level") == level).join(F.broadcast(own) if n <= BROADCAST_KEYS else own, "key")
        out = met if out is None else out.unionByName(met)
    return out


def distance(prefix: str = ""):
    """Squared Mahalanobis distance of the array x from (mean, inv), row by row of the inverse."""
    diff = [F.col(f"{prefix}x")[i] - F.col(f"{prefix}mean")[i] for i in range(D)]
    return sum((diff[i] * diff[j] * F.col(f"{prefix}inv")[i * D + j] for i in range(D) for j in range(D)), F.lit(0.0))


MOMENTS = [f"s{i}" for i in range(D)] + [f"p{i}{j}" for i in range(D) for j in range(i, D)]
PARAMETERS = "level int, key string, parent string, start int, n double, mean array<double>, cov array<double>, inv array<double>, logdet double, falling boolean"


def moments():
    """Sums and products of the array x, named as MOMENTS."""
    return [F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(D)] + [F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"p{i}{j}") for i in range(D) for j in range(i, D)]


def location_and_scatter(sums: np.ndarray, m: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance from the sums named MOMENTS of m rows."""
    mean, cov, at = sums[:D] / m, np.empty((D, D)), D
    for i in range(D):
        for j in range(i, D):
            cov[i, j] = cov[j, i] = sums[at] / m - mean[i] * mean[j]
            at += 1
    return mean, cov


def parameters(level, key, parent, start, n, mean, cov, before=None):
    """A row of PARAMETERS; falling if the determinant is less than the one before, which no start has."""
    cov = cov + np.diag(np.maximum(FLOOR**2 - np.diag(cov), 0) + 1e-9)
    logdet = np.inf if before is None else float(np.linalg.slogdet(cov)[1])
    return (level, key, parent, start, float(n), list(mean), list(cov.ravel()), list(np.linalg.inv(cov).ravel()), logdet, before is None or bool(logdet < before - 1e-6))


def frame(rows):
    import pandas as pd

    return pd.DataFrame(rows, columns=[x.split()[0] for x in PARAMETERS.split(", ")])


def concentrated(rows: DataFrame, params: DataFrame, levels: dict[int, int], core: float | None, scale: float) -> DataFrame:
    """The next parameters of each key and start: of the nearest `core` share, or of all within REWEIGHT_CUT.

    A step that does not lessen the determinant keeps the parameters it came from.
    """
    near = with_parameters(rows, params.select("level", "key", "start", "mean", "inv"), levels).withColumn("d2", distance())
    binned = near.groupBy("level", "key", "start", F.floor(16 * F.log2(F.col("d2") + 1e-3)).alias("bin")).agg(F.count(F.lit(1)).alias("m"), *moments())

    def fit(was, pdf):
        if not len(was) or not len(pdf):
            return frame([])
        old, pdf = was.iloc[0], pdf.sort_values("bin")
        m = pdf["m"].to_numpy(float)
        if core is None:
            used = 2.0 ** (pdf["bin"].to_numpy(float) / 16) <= REWEIGHT_CUT
        else:
            used = np.concatenate([[0.0], np.cumsum(m)[:-1]]) < core * m.sum()
        used[0] = True
        mean, cov = location_and_scatter(pdf[MOMENTS].to_numpy(float)[used].sum(axis=0), m[used].sum())
        new = parameters(old["level"], old["key"], old["parent"], old["start"], m.sum(), mean, scale * cov, old["logdet"])
        return frame([new if new[-1] or core is None else (*old.to_list()[:-1], False)])

    by = ["level", "key", "start"]
    binned = binned.select(*(F.col(c).alias(f"of_{c}") for c in by), "bin", "m", *MOMENTS)
    return params.groupBy(by).cogroup(binned.groupBy([f"of_{c}" for c in by])).applyInPandas(fit, PARAMETERS)


def starts(rows: DataFrame, levels: dict[int, int]) -> DataFrame:
    """PARAMETERS of the starts of every key: 0 from medians and quartiles, the others from drawn rows."""
    quantiles = [F.percentile_approx(F.col("x")[i], [0.25, 0.5, 0.75]).alias(f"q{i}") for i in range(D)]
    known = saved(rows.groupBy("level", "key", "parent").agg(F.count(F.lit(1)).alias("n"), *quantiles))

    def middle(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                q = np.array([r[f"q{i}"] for i in range(D)])
                out.append(parameters(r["level"], r["key"], r["parent"], 0, r["n"], q[:, 1], np.diag(((q[:, 2] - q[:, 0]) / 1.349) ** 2)))
            yield frame(out)

    sized = with_parameters(rows, known.select("level", "key", "n"), levels)
    draw = F.explode(F.array(*(F.lit(k) for k in range(1, DRAWS + 1))))
    unit = (F.xxhash64("h", "start").bitwiseAND(F.lit((1 << 52) - 1))) / float(1 << 52)
    drawn = sized.withColumn("start", draw).where(unit * F.col("n") < DRAWN)
    drawn = drawn.groupBy("level", "key", "parent", "start").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("m"), *moments())

    def small(batches):
        for pdf in batches:
            sums = pdf[MOMENTS].to_numpy(float)
            yield frame([parameters(r["level"], r["key"], r["parent"], r["start"], r["n"], *location_and_scatter(x, r["m"])) for r, x in zip(pdf[["level", "key", "parent", "start", "n", "m"]].to_dict("records"), sums, strict=True)])

    return known.mapInPandas(middle, PARAMETERS).unionByName(drawn.mapInPandas(small, PARAMETERS))


def fit_outliers(stats: DataFrame) -> DataFrame:
    """(key, mean, inv) of every (language, source), from rows with doc_id, lang, source and the STATISTICS.

    Rows that fail the base rules take no part. With no row left there are no parameters.
    """
    own = F.posexplode(F.slice(keys(), 1, 3)).alias("level", "key")
    rows = stats.where(~base_failed()).select(own, keys().alias("keys"), vector().alias("x"), F.xxhash64("doc_id", *STATISTICS).alias("h"))
    rows = saved(rows.select("level", "key", F.col("keys")[F.col("level") + 1].alias("parent"), "x", "h"))
    levels = {r["level"]: r["n"] for r in rows.groupBy("level").agg(F.countDistinct("key").alias("n")).collect()}  # at most three
    if not levels:
        return stats.sparkSession.createDataFrame([], "key string, mean array<double>, inv array<double>")
    params = saved(starts(rows, levels))
    rank = Window.partitionBy("level", "key").orderBy("logdet", "start")
    for step in range(STEPS):
        params = saved(concentrated(rows, params.where("falling"), levels, CORE, CORE_SCALE).unionByName(params.where("not falling")))
        if step + 1 >= EARLY:
            if step + 1 == EARLY:
                params = saved(params.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= BEST).drop("rank"))
            if params.where("falling").isEmpty():
                break
    best = params.withColumn("rank", F.row_number().over(rank)).where("rank = 1").drop("rank")
    return shrunk(saved(concentrated(rows, saved(best), levels, None, REWEIGHT_SCALE)))


def shrunk(params: DataFrame) -> DataFrame:
    """(key, mean, inv) of the finest level, drawn towards its parents' estimates in proportion to how few rows it has."""
    fit = lambda level: params.where(F.col("level") == level).select(F.col("key").alias(f"key{level}"), F.col("parent").alias(f"parent{level}"), *(F.col(c).alias(f"{c}{level}") for c in ("n", "mean", "cov")))
    chain = fit(0).join(fit(1), F.col("parent0") == F.col("key1")).join(fit(2), F.col("parent1") == F.col("key2"))

    def draw(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                mean, cov = np.array(r["mean2"]), np.array(r["cov2"]).reshape(D, D)
                for level in (1, 0):
                    own, share = np.array(r[f"mean{level}"]), r[f"n{level}"] / (r[f"n{level}"] + SHRINK)
                    cov = share * np.array(r[f"cov{level}"]).reshape(D, D) + (1 - share) * cov
                    mean = share * own + (1 - share) * mean
                out.append((r["key0"], list(mean), list(np.linalg.inv(cov).ravel())))
            yield pd.DataFrame(out, columns=["key", "mean", "inv"])

    return chain.mapInPandas(draw, "key string, mean array<double>, inv array<double>")


def judged(rows: DataFrame, params: DataFrame, prefix: str = "") -> DataFrame:
    """Rows with base_failed, distance (null where no estimate exists) and kept added, each after `prefix`.

    Rows carry lang, source and the STATISTICS after `prefix`.
    """
    params = saved(params.select(F.col("key").alias(f"{prefix}of"), F.col("mean").alias(f"{prefix}mean"), F.col("inv").alias(f"{prefix}inv")))
    few = params.count() <= BROADCAST_KEYS
    out = rows.withColumn(f"{prefix}key", keys()[0]).withColumn(f"{prefix}x", vector(prefix))
    out = out.join(F.broadcast(params) if few else params, F.col(f"{prefix}key") == F.col(f"{prefix}of"), "left")
    out = out.withColumn(f"{prefix}base_failed", base_failed(prefix)).withColumn(f"{prefix}distance", F.sqrt(distance(prefix)))
    out = out.withColumn(f"{prefix}kept", ~F.col(f"{prefix}base_failed") & (F.coalesce(F.col(f"{prefix}distance"), F.lit(0.0)) <= CUTOFF**0.5))
    return out.drop(*(f"{prefix}{c}" for c in ("of", "mean", "inv", "key", "x")))


def quality_rules(docs: DataFrame) -> DataFrame:
    """A verdict for every row of (doc_id, text, lang, source), with its counts.

    A null or empty text has no words and so fails the base rules. Null
    languages and sources form groups of their own. Repeated rows and null ids
    get a row each; other columns are ignored; an empty table gives no rows.
    """
    stats = saved(with_statistics(docs.select("doc_id", "lang", "source", "text")).drop("text"))
    return judged(stats, fit_outliers(stats)).select("doc_id", *STATISTICS[:5], "base_failed", "kept", "distance")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of documents that pass, with exactly their columns; counts are made twice rather than texts moved.

    Rows are judged as by `quality_rules`: null and empty texts go, repeated rows
    stay or go together, an empty table gives no rows.
    """
    stats = with_statistics(docs.select("doc_id", "lang", "source", "text")).drop("text")
    params = fit_outliers(stats)
    return judged(with_statistics(docs, "quality_"), params, "quality_").where("quality_kept").select(*docs.columns)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))
