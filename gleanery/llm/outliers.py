"""Quality rules and robust multivariate outliers by minimum covariance determinant."""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.common import kept, lean, stash, to_all

#: Of the transformed statistics, in their order: the least standard deviation that counts as spread. Statistics that are the same in most documents would else have none.
FLOORS = {"log_words": 0.5, "log_word_length": 0.08, "symbols": 0.5, "dup_lines": 1.0, "repeat_words": 1.0}
DIM = len(FLOORS)
#: Share of a group that the estimate rests on, least rows of a group, and how rarely a row of a normal group may lie beyond the limit.
CORE, LEAST, RARE = 0.75, 100, 1e-6
#: Bins per power of two of the squared distance: the border of a share of the rows is known to 0.07 %, and the bin on it counts in part.
FINE = 1024
#: A determinant falls if it does so by more than this part.
LESS = 1e-6
#: Estimates from which concentration starts.
STARTS = ("spread", "half", "sign", "tanh")


def chi_square(p: float, dim: int) -> float:
    """Quantile by the cube-root (Wilson-Hilferty) approximation."""
    return dim * (1 - 2 / (9 * dim) + NormalDist().inv_cdf(p) * (2 / (9 * dim)) ** 0.5) ** 3


def text_statistics(data: bytes) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (lines with a word)."""
    words = data.split()
    n = len(words)
    chars = len(data.translate(None, b"\x20\x09\x0a\x0b\x0c\x0d").decode())
    symbols = n and len(data) - len(data.translate(None, b"#*$%&|<>"))
    full = [x for x in data.split(b"\n") if x.strip()]
    repeated = 0
    if n >= 3:
        codes: dict[bytes, int] = {}
        ids = np.fromiter((codes.setdefault(w, len(codes)) for w in words), dtype=np.int64, count=n)
        pairs = ids[:-1] * len(codes) + ids[1:]
        if len(codes) >= 1 << 20:  # three codes would not fit in 63 bits
            pairs = np.unique(pairs, return_inverse=True)[1]
        _, at, counts = np.unique(pairs[:-1] * len(codes) + ids[2:], return_inverse=True, return_counts=True)
        often = np.zeros(n, dtype=bool)
        where = np.flatnonzero(counts[at] > 1)
        for k in range(3):
            often[where + k] = True
        repeated = int(often.sum())
    return n, chars, symbols, len(full) - len(set(full)), repeated, len(full)


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines) of each document."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [text_statistics(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in batch.column(3).cast(pa.binary())]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "lang", "source", *names])

    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text)
    return wanted.mapInArrow(lean(run), "doc_id long, lang string, source string, " + ", ".join(f"{x} long" for x in names))


def _transformed(stats: DataFrame) -> DataFrame:
    words = F.greatest(F.col("n_words"), F.lit(1))
    rate = lambda c, of: F.log1p(100.0 * F.col(c) / of)
    return stats.withColumns({"x0": F.log1p("n_words"), "x1": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words), "x2": rate("n_symbols", words), "x3": rate("n_dup_lines", F.greatest(F.col("n_lines"), F.lit(1))), "x4": rate("n_repeat_words", words)})


X = [f"x{i}" for i in range(DIM)]
PAIRS = [(i, j) for i in range(DIM) for j in range(i, DIM)]
MODEL = "g long, start int, mu array<double>, p array<double>, det double, before double"


def _grouped(stats: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """stats with a group key `g`: language and source, the language alone if that has under `least` rows, else all; and the
    distinct vectors (g, x0, ..., w rows) that each group's estimate rests on: all rows of the group, the language or the
    table, so that a row may be in three. A group of copies is one vector."""
    sizes = stats.groupBy(F.col("lang").alias("l"), F.col("source").alias("s")).agg(F.count("*").alias("n"))
    langs = sizes.groupBy(F.col("l").alias("k")).agg(F.sum("n").alias("m"))
    own, of_lang, of_all = F.xxhash64(F.lit(2), "l", F.col("l").isNull(), "s", F.col("s").isNull()), F.xxhash64(F.lit(1), "l", F.col("l").isNull()), F.lit(0).cast("long")
    key = F.when(F.col("n") >= least, own).when(F.col("m") >= least, of_lang).otherwise(of_all)
    keys = sizes.join(langs, F.col("l").eqNullSafe(F.col("k"))).select("l", "s", key.alias("g"), F.array(own, of_lang, of_all).alias("may"))
    keys, path = kept(keys, "outliers-groups")
    small = to_all(keys, path)
    keyed = stats.join(small, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s"))).drop("l", "s", "may")
    used, used_path = kept(keys.select(F.col("g").alias("used")).distinct(), "outliers-used")
    vectors = stats.groupBy("lang", "source", *X).agg(F.count("*").alias("w")).join(small, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")))
    rest = vectors.select(F.explode("may").alias("g"), *X, "w").join(to_all(used, used_path), F.col("g") == F.col("used"), "left_semi")
    return keyed, stash(rest.groupBy("g", *X).agg(F.sum("w").alias("w")), "outliers-vectors")


def _estimated(moments: DataFrame) -> DataFrame:
    """Models (centre, inverse scatter, its determinant, the determinant before) from the weighted sums of each (g, start), one row each."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        floor = np.diag(np.square(list(FLOORS.values())))
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                mu = np.array([getattr(r, f"s{i}") for i in range(DIM)]) / r.n
                cross = np.array([[getattr(r, f"s{min(i, j)}_{max(i, j)}") for j in range(DIM)] for i in range(DIM)]) / r.n
                scatter = cross - np.outer(mu, mu)
                scatter = (scatter + scatter.T) / 2 + floor
                out.append((r.g, r.start, mu.tolist(), np.linalg.inv(scatter).ravel().tolist(), float(np.linalg.det(scatter)), r.before))
            yield pd.DataFrame(out, columns=["g", "start", "mu", "p", "det", "before"])

    return moments.mapInPandas(run, MODEL)


def _sums(weight: Column) -> list[Column]:
    return [F.sum(weight).alias("n"), *(F.sum(weight * F.col(x)).alias(f"s{i}") for i, x in enumerate(X)), *(F.sum(weight * F.col(X[i]) * F.col(X[j])).alias(f"s{i}_{j}") for i, j in PAIRS)]


def _with_distance(rows: DataFrame, model: DataFrame) -> DataFrame:
    """rows with the columns of the models of their group, and `d2`, the squared Mahalanobis distance, and its bin."""
    joined = rows.join(model.withColumnRenamed("g", "of"), F.col("g") == F.col("of")).drop("of")
    dev = [F.col(f"x{i}") - F.get("mu", F.lit(i)) for i in range(DIM)]
    d2 = sum((dev[i] * dev[j] * F.get("p", F.lit(DIM * i + j)) * (1 if i == j else 2) for i, j in PAIRS), F.lit(0.0))
    return joined.withColumn("d2", d2).withColumn("bin", F.floor(F.log2(F.greatest("d2", F.lit(0.0)) + 1e-9) * FINE))


def _border(rows: DataFrame, share: Column) -> DataFrame:
    """(g, start, border, part): the bin in which the cumulated rows of a model reach `share` of all, and how much of that bin
    makes up the share. Counts per bin are pre-aggregated; a group has some ten thousand bins at most."""
    counts = rows.groupBy("g", "start", "bin").agg(F.sum("w").alias("w"), F.first(share).alias("share"))
    along, whole = Window.partitionBy("g", "start").orderBy("bin"), Window.partitionBy("g", "start")
    cum = counts.withColumn("cum", F.sum("w").over(along)).withColumn("wanted", F.col("share") * F.sum("w").over(whole))
    reached = cum.where((F.col("cum") >= F.col("wanted")) & (F.col("cum") - F.col("w") < F.col("wanted")))
    return reached.select("g", "start", F.col("bin").alias("border"), ((F.col("wanted") - F.col("cum") + F.col("w")) / F.col("w")).alias("part"))


def _concentrated(rows: DataFrame, model: DataFrame, share: Column) -> DataFrame:
    """The next models: from the `share` of rows with the least distances. Equal distances count alike, in part if they are on the border."""
    near = _with_distance(rows, model)
    border = to_all(*kept(_border(near, share), "outliers-border")).select(F.col("g").alias("bg"), F.col("start").alias("bs"), "border", "part")
    inside = near.join(border, (F.col("g") == F.col("bg")) & (F.col("start") == F.col("bs"))).where("bin <= border")
    weight = F.col("w") * F.when(F.col("bin") < F.col("border"), 1.0).otherwise(F.col("part"))
    return _estimated(inside.groupBy("g", "start").agg(*_sums(weight), F.first("det").alias("before")))


def _medians(rows: DataFrame, values: list[Column], name: str) -> DataFrame:
    """(g, name0, ...): the weighted median of each value, to three decimals. The values are logarithms, so a group has some ten thousand of them at most."""
    each = rows.select("g", "w", F.posexplode(F.array(*(F.round(v, 3) for v in values))).alias("i", "v")).groupBy("g", "i", "v").agg(F.sum("w").alias("w"))
    along, whole = Window.partitionBy("g", "i").orderBy("v"), Window.partitionBy("g", "i")
    middle = each.withColumn("cum", F.sum("w").over(along)).withColumn("all", F.sum("w").over(whole)).where(2 * F.col("cum") >= F.col("all"))
    return middle.groupBy("g").agg(*(F.min(F.when(F.col("i") == i, F.col("v"))).alias(f"{name}{i}") for i in range(len(values))))


def _starts(rows: DataFrame) -> DataFrame:
    """Models to start from, for each group: medians with median absolute deviations, out of which half of the rows are taken
    by distance in a second; and covariances of spatial signs and of hyperbolic tangents around the medians. Outliers cannot move any of them much."""
    many = F.col("w").cast("long")
    middle, path = kept(_medians(rows, [F.col(x) for x in X], "m").withColumnRenamed("g", "of"), "outliers-middle")
    centred = rows.join(to_all(middle, path), F.col("g") == F.col("of"))
    mad = _medians(centred, [F.abs(F.col(x) - F.col(f"m{i}")) for i, x in enumerate(X)], "a").join(middle, F.col("g") == F.col("of"))
    scales = [F.sqrt(F.pow(1.4826 * F.col(f"a{i}"), F.lit(2.0)) + f * f) for i, f in enumerate(FLOORS.values())]
    mad, path = kept(mad.select("of", *(f"m{i}" for i in range(DIM)), *(x.alias(f"a{i}") for i, x in enumerate(scales))), "outliers-spread")
    z = rows.join(to_all(mad, path), F.col("g") == F.col("of")).withColumns({f"z{i}": (F.col(x) - F.col(f"m{i}")) / F.col(f"a{i}") for i, x in enumerate(X)})
    length = F.sqrt(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(DIM)), F.lit(0.0)))
    z = z.withColumn("length", F.greatest(length, F.lit(1e-9)))
    mixed = {"sign": lambda i: F.col(f"z{i}") / F.col("length"), "tanh": lambda i: F.tanh(f"z{i}")}
    sums = [F.sum(many * f(i) * f(j)).alias(f"{name}{i}_{j}") for name, f in mixed.items() for i, j in PAIRS]
    both = z.groupBy("g", *(f"{c}{i}" for c in "ma" for i in range(DIM))).agg(F.sum(many).alias("n"), *sums)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                mu, scale = (np.array([getattr(r, f"{c}{i}") for i in range(DIM)]) for c in "ma")
                for k, name in enumerate(STARTS):
                    scatter = np.eye(DIM)
                    if name in ("sign", "tanh"):
                        scatter = np.array([[getattr(r, f"{name}{min(i, j)}_{max(i, j)}") for j in range(DIM)] for i in range(DIM)]) / r.n
                        scatter *= DIM / max(np.trace(scatter), 1e-9)
                        scatter += 0.05 * np.eye(DIM)
                    scatter = scatter * np.outer(scale, scale)
                    out.append((r.g, k, mu.tolist(), np.linalg.inv(scatter).ravel().tolist(), float("inf"), float("inf")))
            yield pd.DataFrame(out, columns=["g", "start", "mu", "p", "det", "before"])

    return both.mapInPandas(run, MODEL)


def minimum_covariance(rows: DataFrame, core: float = CORE) -> DataFrame:
    """(g, mu, p, scale) per group of rows (g, x0, ..., w): location, inverse scatter and spread of its central rows.

    Of subsets of the `core` share of a group's rows the one whose scatter has the least determinant is sought, by concentration
    from several starts: take the rows with the least distances, estimate again from their sums, and go on as long as the
    determinant falls. (With FLOORS added to the scatter a step cannot raise it, as for the plain estimator, but for the
    width of a bin of distances.) Of the starts the one with the least determinant counts. All rows of a group count in each step,
    through partial sums and histograms of distances; no group is gathered anywhere, and no number of steps is set. `scale`
    corrects for the cut by the median distance.
    """
    rows = rows if "w" in rows.columns else rows.withColumn("w", F.lit(1))
    model, path = kept(_starts(rows), "outliers-starts")
    ended, share = [], F.when((F.col("det") == float("inf")) & (F.col("start") == STARTS.index("half")), 0.5).otherwise(core)
    while True:
        model, path = kept(_concentrated(rows, to_all(model, path), share), "outliers-model")
        falls = F.col("det") < F.col("before") * (1 - LESS)
        ended.append(model.where(~falls))
        model, path = kept(model.where(falls), "outliers-open")
        if model.isEmpty():
            break
    every = ended[0]
    for x in ended[1:]:
        every = every.unionAll(x)
    best, best_path = kept(every.groupBy("g").agg(F.min(F.struct("det", "start", "mu", "p")).alias("least")).select("g", "least.start", "least.mu", "least.p", "least.det"), "outliers-least")
    middle = _border(_with_distance(rows, to_all(best, best_path)), F.lit(0.5))
    spread = F.greatest(F.lit(1.0), F.pow(F.lit(2.0), (F.col("border") + 0.5) / FINE) / chi_square(0.5, DIM))
    return best.drop("start").join(middle.drop("start"), "g").select("g", "mu", "p", "det", spread.alias("scale"))


def judge(docs: DataFrame, text: str = "text", core: float = CORE, least: int = LEAST, rare: float = RARE) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance.

    base_failed: under 50 words, or over half the words in repeated 3-word windows. Others are kept unless their transformed
    statistics lie further from the centre of their language and source than the chi-square limit (distance > 1: squared
    Mahalanobis distance over limit). Estimates rest on documents that pass the base rules; groups with under `least` of them
    use the estimate of all rows of their language, or of the table. Null texts count as empty (failed), null languages and sources are groups of their own,
    repeated rows count one by one, null doc_ids keep their rows, extra columns are ignored, very long texts are read whole
    one at a time, and an empty table gives an empty result.
    """
    words = F.col("n_words")
    failed = (words < 50) | (100 * F.col("n_repeat_words") > 50 * words)
    stats = stash(_transformed(statistics(docs, text)).withColumn("base_failed", failed), "outliers-statistics")
    good, rows = _grouped(stats.where("not base_failed"), least)
    model = to_all(*kept(minimum_covariance(rows, core), "outliers-models"))
    limit = chi_square(1 - rare, DIM)
    far = _with_distance(good, model).withColumn("distance", F.col("d2") / (F.col("scale") * limit))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    passed = far.select(*columns, (F.col("distance") <= 1).alias("kept"), "distance")
    return passed.unionByName(stats.where("base_failed").select(*columns, F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance")))
