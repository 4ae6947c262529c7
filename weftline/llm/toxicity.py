"""Severity of toxic texts by cumulative-link ordinal regression on sparse word features."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, saved, schema_of
from .decontaminate import tokens

#: Labelled rows that the model is fitted on, at most, words that it may weigh, and deviations by which a word's share must differ between classes.
SAMPLE, WORDS, SURE = 12000, 1500, 5.0
#: A document is toxic if the chance of grade 1 or more reaches this.
REJECT = 0.5
_SPACED = bytes(c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 97 + c - 65 if 65 <= c <= 90 else 32 for c in range(256))


#: Word beginnings of these lengths are features as well, as compounds and endings hide a stem.
STEMS = (4, 5, 6, 7)


def words_of(text: bytes | None) -> set:
    """Distinct runs of letters and digits, lower-cased (all beyond ASCII count as letters), and their beginnings, marked ^."""
    out = set((text or b"").translate(_SPACED).decode("utf-8", "replace").lower().split())
    return out | {"^" + w[:n] for w in out for n in STEMS if len(w) >= n}


def features_of():
    """The same as a column of distinct features, from an array of tokens."""
    stems = F.transform(F.array_distinct("all"), lambda w: F.concat(F.array(w), *[F.when(F.length(w) >= n, F.array(F.concat(F.lit("^"), F.substring(w, 1, n)))).otherwise(F.array().cast("array<string>")) for n in STEMS]))
    return F.array_distinct(F.flatten(stems))


class Sparse:
    """A matrix of zeros and ones by the places of its ones."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, shape: tuple[int, int]):
        self.rows, self.cols, self.shape = rows, cols, shape

    def __matmul__(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, v[self.cols], self.shape[0]) if len(self.rows) else np.zeros(self.shape[0])

    @property
    def T(self) -> Sparse:
        return Sparse(self.cols, self.rows, self.shape[::-1])


def fit_ordinal(x: np.ndarray | Sparse, y: np.ndarray, grades: int, rounds: int = 800, rate: float = 0.5, decay: float = 1e-4):
    """(weights, thresholds) of P(y <= j) = s(threshold_j - x w): one set of weights for all thresholds, which stay in order.

    Full-batch Adam on the mean log-likelihood; thresholds are a first value and positive steps."""
    w, first, steps = np.zeros(x.shape[1]), 1.0, np.zeros(max(0, grades - 2))
    params = [w, np.array([first]), steps]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    n = len(y)

    def s(z):
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    for t in range(1, rounds + 1):
        w, first, steps = params
        cut = np.concatenate([first, first + np.cumsum(np.exp(steps))])
        z = x @ w
        edge = np.concatenate([[-np.inf], cut, [np.inf]])
        up, low = s(np.minimum(edge[y + 1] - z, 50)), s(np.maximum(edge[y] - z, -50))
        p = np.maximum(up - low, 1e-12)
        du, dl = up * (1 - up) / p * np.isfinite(edge[y + 1]), low * (1 - low) / p * np.isfinite(edge[y])
        gw = -(x.T @ (dl - du)) / n + decay * w
        gc = np.array([-(du[y == j].sum() - dl[y == j + 1].sum()) / n for j in range(len(cut))])
        gs = np.array([gc[j + 1 :].sum() * math.exp(steps[j]) for j in range(len(steps))])
        for k, g in enumerate((gw, np.array([gc.sum()]), gs)):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            params[k] = params[k] - rate * 0.1 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    w, first, steps = params
    return w, np.concatenate([first, first + np.cumsum(np.exp(steps))])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, words: int = WORDS) -> dict:
    """{"words": {word: weight}, "cuts": [thresholds]} from at most `sample` labelled rows (those with the smallest hash of the id).

    Grades: 0 not toxic; the toxic rows are 1, or 2 where the words that tell toxic rows apart weigh more than in the median toxic row,
    as labels give no degree. The rows are in two halves, and a row's words are weighed by what the other half's labels say, so no
    row's grade is made from its own label. Features are the words whose document shares differ most
    between both classes, by SURE deviations, of those in 5 rows at least; near copies count once (of the rows with
    one smallest or largest shingle hash one is used), else a copied text would lend its words its class. Null labels or ids don't count; an id labelled twice is toxic if any of its
    labels is. Without rows of both classes: no words, and nothing is toxic."""
    rows = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).withColumnRenamed("doc_id", "of")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("of")).select((F.col("toxic") > 0).cast("int").alias("y"), tokens(F.col("text")).alias("all"))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("all") - 4, F.lit(1))), lambda i: F.xxhash64(F.slice("all", i, 5)))
    rows = rows.select("y", features_of().alias("words"), F.array_min(runs).alias("low"), F.array_max(runs).alias("high"))
    for key, other in (("low", "high"), ("high", "low")):  # the smallest row of each, so that reruns agree
        rows = rows.groupBy(key).agg(F.min(F.struct(other, "y", "words")).alias("row")).select(key, "row.*")
    seen = saved(rows.select("y", F.pmod(F.xxhash64("low", "high"), F.lit(2)).cast("int").alias("half"), F.xxhash64("low", "high").alias("row"), "words"), "labelled")
    n = np.zeros((2, 2))
    for r in seen.groupBy("half", "y").agg(F.count("*").alias("n")).collect():
        n[r["half"], r["y"]] = r["n"]
    n0, n1 = (float(v) for v in n.sum(axis=0))
    if not n0 or not n1:
        return {"words": {}, "cuts": [30.0, 31.0]}
    each = seen.select("y", "half", "row", F.explode("words").alias("word"))
    counts = [F.count_if((F.col("half") == h) & (F.col("y") == y)).alias(f"c{h}{y}") for h in (0, 1) for y in (0, 1)]
    share = each.groupBy("word").agg(*counts).withColumn("c0", F.col("c00") + F.col("c10")).withColumn("c1", F.col("c01") + F.col("c11"))
    gap, pooled = F.col("c1") / n1 - F.col("c0") / n0, (F.col("c1") + F.col("c0")) / (n0 + n1)
    sure = F.abs(gap) / F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(1e-9)) * (1 / n0 + 1 / n1))
    top = share.filter(F.col("c1") + F.col("c0") >= 5).withColumn("sure", sure).filter(F.col("sure") >= SURE).orderBy(F.desc("sure"), "word").limit(words).toPandas()
    if not len(top):
        return {"words": {}, "cuts": [30.0, 31.0]}
    place = top[["word"]].assign(place=range(len(top)))
    met = each.join(F.broadcast(docs.sparkSession.createDataFrame(place)), "word").groupBy("row").agg(F.sort_array(F.collect_list("place")).alias("places"))
    kept = seen.select("row", "half", "y").join(met, "row", "left").toPandas().sort_values("row", kind="stable")
    sizes = np.array([0 if p is None else len(p) for p in kept["places"]])
    x = Sparse(np.repeat(np.arange(len(kept)), sizes), np.concatenate([np.asarray(p, np.int64) for p in kept["places"] if p is not None] or [np.zeros(0, np.int64)]), (len(kept), len(top)))
    y, half = kept["y"].to_numpy().astype(int), kept["half"].to_numpy()
    for h in (0, 1):
        other = np.maximum(n[1 - h], 1)
        told = x @ np.maximum(0.0, (top[f"c{1 - h}1"] / other[1] - top[f"c{1 - h}0"] / other[0]).to_numpy())
        mine = (half == h) & (y > 0)
        if mine.any():
            y = np.where(mine & (told > np.median(told[mine])), 2, y)
    w, cuts = fit_ordinal(x, y, 3)
    return {"words": {word: float(v) for word, v in zip(top["word"], w)}, "cuts": [float(c) for c in cuts]}


def grade(docs: DataFrame, model: dict) -> DataFrame:
    """docs with __at_least (array: chance of grade 1 or more, 2 or more, ...) and __severity, their sum: the expected grade. Columns of docs with these two names are replaced.

    Whole texts; each row by itself, so keys and skew don't matter. Null or empty text: no word speaks for any grade."""
    weights, cuts = model["words"], model["cuts"]
    known = set(weights)

    def scored(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()
            z = np.array([sum(weights[w] for w in words_of(t) & known) for t in texts]).reshape(-1, 1)
            p = 1 / (1 + np.exp(np.clip(np.array(cuts) - z, -30, 30)))
            rest = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(list(p), pa.list_(pa.float64())), pa.array(p.sum(axis=1))], [*batch.schema.names[:-1], "__at_least", "__severity"])

    docs = docs.drop("__at_least", "__severity")
    (last,) = fresh(docs, "__text")
    return docs.withColumn(last, F.col("text")).mapInArrow(scored, schema_of(docs) + ", __at_least array<double>, __severity double")


def clean(docs: DataFrame, labels: DataFrame, reject: float = REJECT) -> DataFrame:
    """docs without the toxic ones; rows without a text stay."""
    return grade(docs, train(docs, labels)).filter(F.col("__at_least")[0] < reject).drop("__at_least", "__severity")
