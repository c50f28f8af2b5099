"""Quality rules: text statistics, fixed rules, and robust multivariate outliers per language and source.

Location and scatter of the transformed statistics are minimum-covariance-determinant estimates. Three deterministic starts
(medians and quartiles, mean and covariance, spatial signs) are each improved by concentration steps: the SUPPORT share of a
group's rows that is nearest by Mahalanobis distance gives the next mean and covariance, until the determinant stands
still; of the three ends the one of least determinant is taken. Many statistics are constant in most clean groups, so
every scatter is regularised by a fixed target (FLOORS), in the steps and in the determinants alike.

A step is one aggregation over all rows: moments are summed per model and distance class, the nearest classes are added up,
and the last one counts in part, so that the share is met exactly. Features are whole numbers (fixed point), so sums are
exact and neither the partitioning nor a lost executor changes an estimate.

Models are made for every language and source, for every language and for all rows. A group's model is its own estimate
and PRIOR_ROWS rows' worth of its language's, which is drawn towards that of all rows in the same way; so groups of any
size are judged, and the fewer rows a group has, the more by its neighbours.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import written

#: Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: The share of a group that a concentration step keeps, most steps, and the change of a log-determinant that stands still.
SUPPORT = 0.75
STEPS = 8
STILL = 1e-3
#: Rows that a wider model counts for in a narrower one; the model of all rows is drawn towards the spread PRIOR.
PRIOR_ROWS = 30
PRIOR = 0.5
#: Upper tail of the chi-squared law beyond which a vector is an outlier.
TAIL = 1e-6
SCALE = 256
FEATURES = ("f_chars", "f_symbols", "f_dup", "f_repeat")
#: Spread, in the features' units, under which a coordinate does not count as varying; the base rule leaves f_repeat under 0.45.
FLOORS = (0.15, 0.15, 0.15, 0.07)
K = len(FEATURES)
STARTS = ("quartiles", "covariance", "signs")
#: Rows of models that are broadcast at most (under 1 KB each); more models meet rows in a shuffle, their keys split SALTS ways.
MODELS_BROADCAST = 20_000
SALTS = 64


def text_stats(batch: pa.RecordBatch, column: str) -> dict[str, np.ndarray]:
    """The STATS of every row's whole text as int64 arrays."""
    offsets, raw = tk.buffers(batch.column(column))
    n = batch.num_rows
    per = lambda at: np.bincount(at, minlength=n).astype(np.int64)
    row, starts, ends = tk.words(offsets, raw)
    out = {"n_words": per(row)}
    upto = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
    points = (raw & 0xC0) != 0x80
    out["word_chars"] = upto(points & ~tk._SPACE[raw])
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    out["n_symbols"] = upto(symbol[raw])

    values = tk.byte_values(raw)
    hashes = tk.span_hashes(values, starts, ends)
    # lines: cut at \n and at the ends of texts
    new = np.zeros(len(raw) + 1, bool)
    new[offsets[:-1][np.diff(offsets) > 0]] = True
    breaks = np.flatnonzero(raw == 10)
    last = np.zeros(len(raw) + 1, bool)
    last[offsets] = True
    new[breaks[~last[breaks + 1]] + 1] = True
    line_start = np.flatnonzero(new)
    line_row = np.searchsorted(offsets, line_start, "right") - 1
    line_end = np.minimum(np.append(line_start[1:], len(raw)), offsets[line_row + 1])
    line_end -= (raw[line_end - 1] == 10) & (line_end > line_start)
    has_word = np.zeros(len(line_start), bool)
    has_word[np.searchsorted(line_start, starts, "right") - 1] = True
    line_hash = tk.span_hashes(values, line_start, line_end)[has_word]
    line_row = line_row[has_word]
    out["n_dup_lines"] = per(line_row) - per(_first(line_row, line_hash)[0])

    at, window = tk.windows(hashes, row, WINDOW)
    again = at[_repeated(row[at], window)]
    cover = np.zeros(len(row) + 1, np.int32)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + WINDOW, -1)
    out["n_repeat_words"] = per(row[np.cumsum(cover[:-1]) > 0])
    return out


def _first(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs (row, hash)."""
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    keep = np.ones(len(row), bool)
    keep[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[keep], h[keep]


def _repeated(row: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the pair (row, hash) occurs more than once."""
    order = np.lexsort((h, row))
    same = (row[order][1:] == row[order][:-1]) & (h[order][1:] == h[order][:-1])
    out = np.zeros(len(row), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def statistics(documents: DataFrame, text_col: str = "text", groups: tuple[str, ...] = ("lang", "source"), carry: tuple[str, ...] = ()) -> DataFrame:
    """(g0, g1, ... the groups as strings, c0, c1, ... the columns carry, STATS) of every row; whole texts, null as empty."""
    carried = {f"c{i}": c for i, c in enumerate(carry)}
    columns = [F.col(text_col).alias("text"), *(F.col(g).cast("string").alias(f"g{i}") for i, g in enumerate(groups)), *(F.col(c).alias(k) for k, c in carried.items() if c != text_col)]
    types = {f"g{i}": "string" for i in range(len(groups))} | {k: documents.schema[c].dataType.simpleString() for k, c in carried.items()}
    schema = ", ".join(f"{k} {t}" for k, t in (types | dict.fromkeys(STATS, "long")).items())
    sent = ["text" if carried.get(k) == text_col else k for k in types]

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in tk.slices(batch, "text"):
                stats = text_stats(part, "text")
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in sent), *(pa.array(stats[s]) for s in STATS)], names=[*types, *STATS])

    return documents.select(*columns).mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))


def features() -> list[Column]:
    """Transformed statistics in fixed point: shares with a pseudocount of ten words, so short texts vary less; log and root scales."""
    n = F.col("n_words").cast("double")
    share = lambda x: F.col(x) / (n + 10)
    values = (F.log((F.col("word_chars") + 50) / (n + 10)) * 4, F.sqrt(share("n_symbols")) * 4, F.sqrt(share("n_dup_lines")) * 2, F.sqrt(share("n_repeat_words")))
    return [F.round(v * SCALE).cast("long").alias(f) for v, f in zip(values, FEATURES, strict=True)]


def chi2_quantile(p: float, k: int) -> float:
    """Upper quantile by bisection on chi2_cdf."""
    low, high = 0.0, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return high


def chi2_cdf(x: float, k: int) -> float:
    """The regularised lower incomplete gamma function by its series."""
    if x <= 0:
        return 0.0
    a, z = k / 2, x / 2
    if z > a + 60 + 10 * math.sqrt(a):
        return 1.0
    term = total = 1 / a
    i = 0
    while term > total * 1e-16:
        i += 1
        term *= z / (a + i)
        total += term
    return min(1.0, total * math.exp(-z + a * math.log(z) - math.lgamma(a)))


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(K) for j in range(i, K)]


def _distance(centre: str = "centre", inverse: str = "inverse") -> Column:
    """Squared Mahalanobis distance to the joined model."""
    x = [F.col(f) / SCALE - F.col(centre)[i] for i, f in enumerate(FEATURES)]
    return sum((F.col(inverse)[K * i + j] * x[i] * x[j] * (1 if i == j else 2) for i, j in _pairs()), F.lit(0.0))


def _class() -> Column:
    """Distances in classes of a thirty-second of an octave, so that the nearest share is found from counts."""
    return F.floor(F.log2(F.greatest(F.col("d2"), F.lit(1e-4))) * 32).cast("int")


MODEL = "key string, start int, rows long, centre array<double>, scatter array<double>, inverse array<double>, logdet double, done boolean"


def _regular(scatter: np.ndarray) -> np.ndarray:
    return scatter + np.diag(np.square(FLOORS))


def _model_row(key: str, start: int, rows: int, centre: np.ndarray, scatter: np.ndarray, logdet: float | None = None, done: bool = False) -> dict:
    spread = _regular(scatter)
    logdet = float(np.linalg.slogdet(spread)[1]) if logdet is None else logdet
    return {"key": key, "start": start, "rows": rows, "centre": centre.tolist(), "scatter": scatter.ravel().tolist(), "inverse": np.linalg.inv(spread).ravel().tolist(), "logdet": logdet, "done": done}


def concentrated(n: np.ndarray, first: list[list[int]], second: list[list[int]], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and consistent covariance of the nearest SUPPORT share, from counts and exact sums per distance class, nearest first."""
    wanted = SUPPORT * rows
    before = np.cumsum(n) - n
    inside = int((before < wanted).sum())
    # whole classes are added up exactly; what the last one holds too much leaves in proportion
    total, sums, products = int(n[:inside].sum()), [sum(c[:inside]) for c in first], [sum(c[:inside]) for c in second]
    off = 1 - (wanted - before[inside - 1]) / n[inside - 1]
    size = total - off * n[inside - 1]
    mean = np.array([(s - off * c[inside - 1]) / size for s, c in zip(sums, first, strict=True)])
    scatter = np.zeros((K, K))
    for (i, j), s, c in zip(_pairs(), products, second, strict=True):
        # about the whole classes' mean, in whole numbers, before anything becomes floating point
        a, b = sums[i] / total, sums[j] / total
        whole = (s * total - sums[i] * sums[j]) / total
        last = c[inside - 1] - a * first[j][inside - 1] - b * first[i][inside - 1] + n[inside - 1] * a * b
        scatter[i, j] = scatter[j, i] = (whole - off * last) / size - (mean[i] - a) * (mean[j] - b)
    factor = SUPPORT / chi2_cdf(chi2_quantile(SUPPORT, K), K + 2)
    return mean / SCALE, scatter / SCALE**2 * factor


def _with_models(rows: DataFrame, models: DataFrame, how: str = "inner") -> DataFrame:
    """rows joined with models, which are written and have key and columns that rows lack; a key may have any share of rows."""
    if models.count() <= MODELS_BROADCAST:
        return rows.join(F.broadcast(models), "key", how)
    salt = F.pmod(F.xxhash64(*FEATURES), F.lit(SALTS)).cast("int")
    spread = models.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", salt).join(spread, ["key", "salt"], how).drop("salt")


def _starts(stats: DataFrame) -> DataFrame:
    """The three starting models of every key of stats (key, FEATURES)."""
    quartiles = [F.percentile(f, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"q{i}") for i, f in enumerate(FEATURES)]
    sums = [F.sum(f).alias(f"s{i}") for i, f in enumerate(FEATURES)] + [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).cast("decimal(38,0)").alias(f"s{i}_{j}") for i, j in _pairs()]
    shape = written(stats.groupBy("key").agg(F.count("*").alias("rows"), *quartiles, *sums), "shapes")
    # signs: directions from the medians, in units of the quartile spread
    spread = lambda i: (F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349 + FLOORS[i] * SCALE
    at = _with_models(stats, shape.select("key", *(F.col(f"q{i}")[1].alias(f"m{i}") for i in range(K)), *(spread(i).alias(f"d{i}") for i in range(K))))
    z = [(F.col(f) - F.col(f"m{i}")) / F.col(f"d{i}") for i, f in enumerate(FEATURES)]
    at = at.select("key", *(x.alias(f"z{i}") for i, x in enumerate(z))).withColumn("norm", F.sqrt(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(K)), F.lit(1e-9))))
    signs = at.groupBy("key").agg(*(F.sum(F.round(F.col(f"z{i}") * F.col(f"z{j}") / F.col("norm") / F.col("norm") * (1 << 20)).cast("long")).alias(f"g{i}_{j}") for i, j in _pairs()))

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                rows, q = int(r["rows"]), np.array([r[f"q{i}"] for i in range(K)], float) / SCALE
                wide = np.diag((q[:, 2] - q[:, 0]) / 1.349 + np.array(FLOORS))
                mean, cov, sign = np.array([int(r[f"s{i}"]) / rows for i in range(K)]), np.zeros((K, K)), np.zeros((K, K))
                for i, j in _pairs():
                    cov[i, j] = cov[j, i] = (int(r[f"s{i}_{j}"]) * rows - int(r[f"s{i}"]) * int(r[f"s{j}"])) / rows / rows / SCALE**2
                    sign[i, j] = sign[j, i] = int(r[f"g{i}_{j}"]) / rows / (1 << 20) * K
                for start, (centre, scatter) in enumerate(((q[:, 1], wide**2), (mean / SCALE, cov), (q[:, 1], wide @ sign @ wide))):
                    out.append(_model_row(r["key"], start, rows, centre, scatter, math.inf))
            if out:
                yield pd.DataFrame(out)

    return shape.join(signs, "key").mapInPandas(make, MODEL)


def models(stats: DataFrame) -> DataFrame:
    """(key, rows, centre, scatter): the MCD estimate of every key of stats (key, FEATURES)."""
    model = written(_starts(stats), "mcd")
    sums = [F.sum(f).alias(f"s{i}") for i, f in enumerate(FEATURES)] + [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).cast("decimal(38,0)").alias(f"s{i}_{j}") for i, j in _pairs()]

    def step(moments: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        """A model's next one, or itself, done, where the determinant no longer falls; a few thousand classes at most."""
        last = old.to_dict("records")[0]
        at = moments.sort_values("d_class")
        whole = lambda c: [int(x) for x in at[c]]
        centre, scatter = concentrated(at["n"].to_numpy(), [whole(f"s{i}") for i in range(K)], [whole(f"s{i}_{j}") for i, j in _pairs()], int(last["rows"]))
        new = _model_row(last["key"], int(last["start"]), int(last["rows"]), centre, scatter)
        if new["logdet"] >= last["logdet"] - STILL:
            new = last | {"done": True}
        return pd.DataFrame([new])[[c.split()[0] for c in MODEL.split(", ")]]

    for _ in range(STEPS):
        going = model.where("not done")
        if not going.take(1):
            break
        classed = _with_models(stats, going.select("key", "start", "centre", "inverse")).withColumn("d2", _distance()).withColumn("d_class", _class())
        moments = classed.groupBy("key", "start", "d_class").agg(F.count("*").alias("n"), *sums)
        old = going.select(*(F.col(c).alias(c) for c in going.columns))
        new = moments.groupBy("key", "start").cogroup(old.groupBy("key", "start")).applyInPandas(step, MODEL)
        model = written(model.where("done").unionByName(new), "mcd")
    least = F.min_by(F.struct("rows", "centre", "scatter"), F.struct("logdet", "start")).alias("m")
    return model.groupBy("key").agg(least).select("key", "m.*")


def drawn(own: tuple | None, wider: tuple) -> tuple:
    """(rows, centre, scatter) of own rows and PRIOR_ROWS of the wider model's, as one mixture."""
    if own is None:
        return (0, *wider[1:])
    (n, c, s), (_, d, t) = own, wider
    share, gap = n / (n + PRIOR_ROWS), c - d
    return n, share * c + (1 - share) * d, share * s + (1 - share) * t + share * (1 - share) * np.outer(gap, gap)


def _keys() -> list[Column]:
    """The names of a row's three models: its g0 and g1, its g0, all."""
    name = lambda c: F.coalesce(F.concat(F.length(c), F.lit(":"), F.col(c)), F.lit("-"))
    return [F.concat(F.lit("2"), name("g0"), name("g1")).alias("k2"), F.concat(F.lit("1"), name("g0")).alias("k1"), F.lit("0").alias("k0")]


def _models_of_all(stats: DataFrame) -> DataFrame:
    """(k2, centre, inverse) of every group of stats; none if no row passes the base rules."""
    passed = stats.where(~base_failed()).select(F.explode(F.array(*_keys())).alias("key"), *FEATURES)
    found = written(models(written(passed, "features")).select("key", F.struct("rows", "centre", "scatter").alias("m")), "mcd")
    groups = stats.select(*_keys()).distinct()
    for k in ("k2", "k1", "k0"):
        groups = groups.join(found.select(F.col("key").alias(k), F.col("m").alias(f"m_{k}")), k, "inner" if k == "k0" else "left")

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = lambda m: None if m is None else (m["rows"], np.array(m["centre"]), np.array(m["scatter"]).reshape(K, K))
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                rows, centre, scatter = model(r["m_k0"])
                share = rows / (rows + PRIOR_ROWS)
                at = (rows, centre, share * scatter + (1 - share) * np.diag(np.full(K, PRIOR**2)))
                for k in ("k1", "k2"):
                    at = drawn(model(r[f"m_{k}"]), at)
                out.append({"k2": r["k2"], "centre": at[1].tolist(), "inverse": np.linalg.inv(_regular(at[2])).ravel().tolist()})
            if out:
                yield pd.DataFrame(out)

    return written(groups.mapInPandas(draw, "k2 string, centre array<double>, inverse array<double>"), "mcd")


def _verdicts(documents: DataFrame, text_col: str, groups: tuple[str, str], carry: tuple[str, ...]) -> DataFrame:
    """(c0, c1, ... the columns carry, STATS, base_failed, d2, kept) of every row; the models' join reads a row per group."""
    stats = statistics(documents, text_col, groups, carry)
    stats = written(stats.select("*", *features()), "stats")
    judged = _with_models(stats.withColumn("key", _keys()[0]), _models_of_all(stats).withColumnRenamed("k2", "key"), "left")
    clipped = [F.greatest(F.col(f), F.round(F.coalesce(F.col("centre")[i], F.lit(0.0)) * SCALE).cast("long")).alias(f) if i else F.col(f) for i, f in enumerate(FEATURES)]
    rest = [c for c in judged.columns if c not in FEATURES]
    judged = judged.select(*rest, *clipped).withColumn("d2", _distance())
    outlier = F.coalesce(F.col("d2") > chi2_quantile(1 - TAIL, K), F.lit(False))
    return judged.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~outlier)


def judge(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """(id_col, STATS, base_failed, kept, distance2) of every row of documents.

    kept is false if a base rule fails or the row is an outlier of its group. Null text is empty (and fails the rules);
    null groups are groups of their own; a group of any size is judged, a small one mostly by its language's model and by
    that of all rows; repeated rows are judged alike. Other columns do not matter, whatever their names.
    An empty table gives an empty result. Only the worse side counts: a row with fewer symbols and repeats than its
    group's centre is no outlier for that.
    """
    return _verdicts(documents, text_col, groups, (id_col,)).select(F.col("c0").alias(id_col), *STATS, "base_failed", "kept", F.round("d2", 6).alias("distance2"))


def passing(documents: DataFrame, columns: tuple[str, ...], text_col: str = "text", groups: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """columns of the rows that judge keeps, each row by itself whatever its id.

    The columns travel beside the statistics into the written table that the models are fitted on, so texts are neither
    read twice by the statistics nor shuffled.
    """
    return _verdicts(documents, text_col, groups, columns).where("kept").select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(columns)))
