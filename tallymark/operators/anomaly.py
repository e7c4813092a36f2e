"""Invoice features and two learned anomaly scores: an isolation forest and the error of a reconstructing network."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallymark.functions.expressions import day_difference
from tallymark.sources.handoff import hand_over

FEATURES = ("total", "tax", "subtotal", "tax_ratio", "amount_per_item", "weekday", "day", "month", "days_until_due", "confidence", "text_length", "vendor_frequency", "vendor_deviation")


def features(inv: DataFrame) -> DataFrame:
    """invoice_id and the 13 features, missing values at their defaults."""
    z = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    has = lambda c, default: z(c) if c in inv.columns else F.lit(float(default))
    d = F.col("invoice_date")
    conf = F.when(z("ocr_confidence") > 0, z("ocr_confidence")).otherwise(50.0)
    dev = F.when(F.col("vendor_std") > 0, (z("total_amount") - F.col("vendor_avg")) / F.col("vendor_std")).otherwise(0.0) if "vendor_std" in inv.columns else F.lit(0.0)
    length = F.coalesce(F.length("raw_text"), F.lit(0)).cast("double") if "raw_text" in inv.columns else F.lit(0.0)
    part = lambda f: F.coalesce(f(d), F.lit(0)).cast("double")
    values = (
        z("total_amount"), z("tax_amount"), z("subtotal"), F.when(z("total_amount") > 0, z("tax_amount") / z("total_amount")).otherwise(0.0), z("total_amount") / F.greatest(F.lit(1.0), has("n_items", 1)),
        part(F.weekday), part(F.dayofmonth), part(F.month), F.coalesce(day_difference("due_date", "invoice_date"), F.lit(30)).cast("double"), conf, length, F.greatest(F.lit(1.0), has("vendor_frequency", 1)), F.coalesce(dev, F.lit(0.0)),
    )
    return inv.select("invoice_id", *[v.alias(n) for n, v in zip(FEATURES, values, strict=True)])


def moments(f: DataFrame, columns: tuple[str, ...] = FEATURES) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each column: one aggregate."""
    stats = f.agg(*[x for c in columns for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]).first()
    return {c: (stats[f"m_{c}"] or 0.0, stats[f"s_{c}"] or 0.0) for c in columns}


def standardise(f: DataFrame, columns: tuple[str, ...] = FEATURES, by: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Zero mean and unit population deviation, by the given moments or its own; constant columns become 0."""
    by = by or moments(f, columns)
    value = lambda c: (F.col(c) - F.lit(by[c][0])) / F.lit(by[c][1]) if by[c][1] > 0 else F.lit(0.0)
    return f.select("invoice_id", *[value(c).alias(c) for c in columns])


def anomaly_points(isolation: np.ndarray) -> np.ndarray:
    """Isolation from 0 to 1 as 0 to 100 points; 0.5 and less give none."""
    return np.clip(50 * (2 * isolation - 1), 0, 100)


TREES, SAMPLE = 200, 256
#: Share of the forest's rows that it labels as outliers.
CONTAMINATION = 0.1
LEAST_ROWS = 50
NODES = "tree int, node int, feature int, threshold double, low int, high int, depth double"


def expected_depth(n: np.ndarray | float) -> np.ndarray:
    """Expected depth of an unsuccessful search among n rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def samples(std: DataFrame, n: int, trees: int = TREES, size: int = SAMPLE) -> DataFrame:
    """The rows of ``std`` (``n`` of them) that each tree holds, with ``tree`` and ``place``, drawn by hash.

    A row draws tickets, each for one tree; a tree takes the ``size`` best of some four times as many.  So who is in which
    tree follows from the ids alone, and no task sees more than a tree's tickets.
    """
    if n <= 4 * size:
        drawn = std.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    else:
        wanted = 4 * trees * size
        tickets = -(-wanted // n)
        drawn = std.withColumn("_t", F.explode(F.sequence(F.lit(1), F.lit(tickets)))).withColumn("_h", F.xxhash64("invoice_id", "_t"))
        lucky = F.pmod(F.col("_h"), F.lit(1 << 40)) < F.lit(int((1 << 40) * min(1.0, wanted / (n * tickets))))
        drawn = drawn.where(lucky).withColumn("tree", F.pmod(F.shiftrightunsigned("_h", 40), F.lit(trees)).cast("int")).drop("_t", "_h").dropDuplicates(["invoice_id", "tree"])
    order = Window.partitionBy("tree").orderBy(F.xxhash64("invoice_id", "tree", F.lit("place")), "invoice_id")
    return drawn.withColumn("place", F.row_number().over(order)).where(F.col("place") <= size)


def _grow(x: np.ndarray, rng: np.random.Generator) -> list[tuple]:
    """Nodes (number, feature, threshold, low, high, depth); a leaf has no feature, and the depth that its rows stand for."""
    high, nodes, todo = int(np.ceil(np.log2(max(2, len(x))))), [], [(0, np.arange(len(x)), 0)]
    free = 1
    while todo:
        node, rows, level = todo.pop()
        part = x[rows]
        span = part.max(0) - part.min(0)
        if level >= high or len(rows) <= 1 or not span.any():
            nodes.append((node, -1, 0.0, -1, -1, level + float(expected_depth(len(rows)))))
            continue
        f = int(rng.choice(np.flatnonzero(span)))
        at = float(rng.uniform(part[:, f].min(), part[:, f].max()))
        left = part[:, f] < at
        nodes.append((node, f, at, free, free + 1, 0.0))
        todo += [(free + 1, rows[~left], level + 1), (free, rows[left], level + 1)]
        free += 2
    return nodes


def grow_forest(std: DataFrame, n: int, seed: int = 42, trees: int = TREES, size: int = SAMPLE) -> DataFrame:
    """Isolation trees as a table of nodes; each tree is grown where its rows have met."""

    def tree(rows: pd.DataFrame) -> pd.DataFrame:
        k = int(rows.tree.iloc[0])
        x = rows.sort_values("place")[list(FEATURES)].to_numpy(float)
        return pd.DataFrame([(k, *node) for node in _grow(x, np.random.default_rng([seed, k]))], columns=["tree", "node", "feature", "threshold", "low", "high", "depth"])

    return samples(std, n, trees, size).groupBy("tree").applyInPandas(tree, NODES)


class Forest:
    """Nodes of all trees as arrays; at most TREES * 511 of them."""

    def __init__(self, nodes: list[tuple], size: int):
        self.nodes, self.size = sorted(map(tuple, nodes)), size
        trees = sorted({x[0] for x in self.nodes})
        first = dict.fromkeys(trees, 0)
        for x in self.nodes:
            first[x[0]] += 1
        starts = np.concatenate([[0], np.cumsum(list(first.values()))])[:-1]
        base = dict(zip(trees, starts.tolist(), strict=True))
        self.roots = np.array(list(base.values()), np.int64)
        self.feature = np.array([x[2] for x in self.nodes], np.int64)
        self.threshold = np.array([x[3] for x in self.nodes], float)
        self.low, self.high = (np.array([base[x[0]] + x[k] if x[2] >= 0 else base[x[0]] + x[1] for x in self.nodes], np.int64) for k in (4, 5))
        self.depth = np.array([x[6] for x in self.nodes], float)
        self.levels = int(np.ceil(np.log2(max(2, size))))

    def isolation(self, x: np.ndarray) -> np.ndarray:
        """From 0 to 1; usual rows are near 0.5."""
        out = np.empty(len(x))
        for at in range(0, len(x), 4096):
            part = x[at : at + 4096]
            where = np.broadcast_to(self.roots, (len(part), len(self.roots))).copy()
            for _ in range(self.levels):
                f = self.feature[where]
                left = np.take_along_axis(part, np.maximum(f, 0), 1) < self.threshold[where]
                where = np.where(left, self.low[where], self.high[where])
            out[at : at + 4096] = 2 ** (-self.depth[where].mean(1) / max(1e-9, float(expected_depth(self.size))))
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly from 0 to 100, usual rows at 0."""
        return anomaly_points(self.isolation(x))


#: Widths of the network's layers: down to eight numbers and up again.
LAYERS = (len(FEATURES), 32, 16, 8, 16, 32, len(FEATURES))
#: Layers that end in a ramp: all but the last of the way up.
RAMPS = (True, True, True, True, True, False)


class Network:
    """Reconstruction by a small network of ramps; the weights are one flat vector."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    @classmethod
    def fresh(cls, seed: int = 42) -> Network:
        rng = np.random.default_rng(seed)
        return cls(np.concatenate([y for a, b in zip(LAYERS, LAYERS[1:]) for y in (rng.uniform(-1, 1, a * b) * np.sqrt(6 / a), np.zeros(b))]))

    def _parts(self, flat: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out, at = [], 0
        for a, b in zip(LAYERS, LAYERS[1:]):
            out.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]))
            at += a * b + b
        return out

    def _forward(self, x: np.ndarray) -> list[np.ndarray]:
        seen = [x]
        for (w, bias), ramp in zip(self._parts(self.weights), RAMPS, strict=True):
            y = seen[-1] @ w + bias
            seen.append(np.maximum(y, 0) if ramp else y)
        return seen

    def error(self, x: np.ndarray) -> np.ndarray:
        """Mean squared error of each row."""
        return np.square(self._forward(x)[-1] - x).mean(1)

    def gradient(self, x: np.ndarray) -> tuple[float, np.ndarray]:
        """Sum over the rows of the error, and of its slope in every weight."""
        seen, slopes = self._forward(x), []
        back = 2 * (seen[-1] - x) / x.shape[1]
        for k in range(len(RAMPS) - 1, -1, -1):
            if RAMPS[k]:
                back = back * (seen[k + 1] > 0)
            slopes += [back.sum(0), (seen[k].T @ back).reshape(-1)]
            back = back @ self._parts(self.weights)[k][0].T
        return float(np.square(seen[-1] - x).mean(1).sum()), np.concatenate(slopes[::-1])

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.minimum(100, 100 * self.error(x))


def fit_network(std: DataFrame, n: int, epochs: int = 60, rate: float = 0.01, seed: int = 42) -> Network:
    """Adam on the whole of ``std`` (a stored table of ``n`` rows): each step is one pass, whose partial sums Spark adds up.

    A partition hands on one row of sums, and a step brings one number a weight to the driver, whatever the rows.
    """
    net = Network.fresh(seed)
    mean, square = np.zeros_like(net.weights), np.zeros_like(net.weights)
    for step in range(1, epochs + 1):

        def sums(frames: Iterator[pd.DataFrame], net: Network = net) -> Iterator[pd.DataFrame]:
            total = np.zeros_like(net.weights)
            for f in frames:
                x = f.to_numpy(float)
                for at in range(0, len(x), 8192):
                    total += net.gradient(x[at : at + 8192])[1]
            yield pd.DataFrame({"slope": [total.tolist()]})

        added = std.select(*FEATURES).mapInPandas(sums, "slope array<double>").select(F.posexplode("slope").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).collect()
        slope = np.zeros_like(net.weights)
        for r in added:
            slope[r.k] = r.v / n
        mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope**2
        net = Network(net.weights - rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8))
    return net


@dataclass
class Model:
    forest: Forest
    network: Network
    cut: float  # isolation above which a row is labelled an outlier
    moments: dict[str, tuple[float, float]] | None = None  # of the rows it was trained on, if these were raw features


def train(std: DataFrame, epochs: int = 60, by: dict[str, tuple[float, float]] | None = None) -> Model | None:
    """Both models from all rows of ``std``; None with fewer than LEAST_ROWS.

    An isolation forest is a method of small samples: TREES trees of SAMPLE rows (see ``samples``).  What comes to the driver
    are the forest's nodes and the network's weights, whose numbers are fixed by the constants above.
    """
    std = hand_over(std, "standardised")
    n = std.count()
    if n < LEAST_ROWS:
        return None
    size = min(SAMPLE, n)
    forest = Forest([tuple(r) for r in grow_forest(std, n).collect()], size)
    shared = std.sparkSession.sparkContext.broadcast(forest)
    held = samples(std, n).dropDuplicates(["invoice_id"]).select(*FEATURES)

    def isolation(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"v": shared.value.isolation(f[list(FEATURES)].to_numpy(float))})

    cut = held.mapInPandas(isolation, "v double").agg(F.percentile("v", 1 - CONTAMINATION)).first()[0]
    return Model(forest, fit_network(std, n, epochs), float(cut), by)


def retrain(inv: DataFrame, path: str, epochs: int = 60) -> dict:
    """Train on the reviewed invoices of ``inv`` (status approved or rejected) and save the model to ``path``.

    Returns trained (whether there were LEAST_ROWS of them), rows, and the path; nothing is saved otherwise.
    """
    raw = hand_over(features(inv.where(F.col("status").isin("approved", "rejected"))), "labelled")
    n = raw.count()
    if n < LEAST_ROWS:
        return {"trained": False, "rows": n, "path": None}
    by = moments(raw)
    save(train(standardise(raw, by=by), epochs, by), inv.sparkSession, path)
    return {"trained": True, "rows": n, "path": path}


def save(model: Model, spark: SparkSession, path: str) -> None:
    """Write the model as tables: forest (nodes), network (weights), facts (cut, size, moments); older ones are replaced."""
    spark.createDataFrame(model.forest.nodes, NODES).coalesce(1).write.mode("overwrite").parquet(f"{path}/forest")
    spark.createDataFrame(list(enumerate(model.network.weights.tolist())), "k int, weight double").coalesce(1).write.mode("overwrite").parquet(f"{path}/network")
    facts = json.dumps({"cut": model.cut, "size": model.forest.size, "moments": model.moments})
    spark.createDataFrame([(facts,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/facts")


def load(spark: SparkSession, path: str) -> Model:
    facts = json.loads(spark.read.text(f"{path}/facts").first()[0])
    weights = np.array([r.weight for r in spark.read.parquet(f"{path}/network").orderBy("k").collect()])
    by = {c: tuple(v) for c, v in facts["moments"].items()} if facts["moments"] else None
    return Model(Forest([tuple(r) for r in spark.read.parquet(f"{path}/forest").collect()], facts["size"]), Network(weights), facts["cut"], by)


def learned(std: DataFrame, allowed: DataFrame | None = None, model: Model | None = None) -> DataFrame:
    """invoice_id, isolation_score, isolated (above the model's cut), reconstruction_score, anomaly_score (mean of those there are), anomalous (> 50).

    Scored by ``model``, or by one trained on ``allowed`` (default: all rows); with fewer than LEAST_ROWS, scores are null.
    A score that is no number (of a row with features that are none) is null and doesn't count in the mean.
    """
    model = model or train(allowed if allowed is not None else std)
    shared = std.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for f in frames:
            x = f[list(FEATURES)].to_numpy(float)
            s = m.forest.isolation(x) if m else np.full(len(x), np.nan)
            yield pd.DataFrame({"invoice_id": f.invoice_id, "isolation_score": anomaly_points(s), "isolated": s > (m.cut if m else 1), "reconstruction_score": m.network.score(x) if m else s})

    raw = std.mapInPandas(run, "invoice_id long, isolation_score double, isolated boolean, reconstruction_score double")
    a, b = (F.when(~F.isnan(c), F.col(c)) for c in ("isolation_score", "reconstruction_score"))
    rows = raw.withColumns({"isolation_score": a, "reconstruction_score": b})
    mean = (F.coalesce("isolation_score", "reconstruction_score") + F.coalesce("reconstruction_score", "isolation_score")) / 2
    return rows.withColumn("anomaly_score", mean).withColumn("anomalous", F.col("anomaly_score") > 50)


def quartiles(counts: DataFrame, group: str, value: str) -> DataFrame:
    """(group, n, q1, q3) of ``counts`` (group, value, n: rows with that value): quartiles by interpolation.

    The window runs over one row a value, so a group of any size is as large as its distinct values.
    """
    w = Window.partitionBy(group)
    run = counts.withColumns({"upto": F.sum("n").over(w.orderBy(value)), "total": F.sum("n").over(w)})
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col(value)))

    def quantile(q: float) -> Column:
        place = q * (F.col("total") - 1)
        lo = F.floor(place)
        below, above = at(lo), at(F.least(lo + 1, F.col("total") - 1))
        return below + (above - below) * F.max(place - lo)

    return run.groupBy(group).agg(F.max("total").alias("n"), quantile(0.25).alias("q1"), quantile(0.75).alias("q3"))


def fence(df: DataFrame, group: str, value: str) -> DataFrame:
    """Interquartile fence of each group: reach 1.5 times the range, the range at least 1; null values don't count."""
    counts = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    reach = 1.5 * F.greatest(F.lit(1.0), F.col("q3") - F.col("q1"))
    return quartiles(counts, group, value).select(group, "n", (F.col("q1") - reach).alias("lower"), (F.col("q3") + reach).alias("upper"))


def histogram(df: DataFrame, value: str, bins: int = 64) -> DataFrame:
    """Share of rows in each of ``bins`` bins over [0, 1]; the last bin is closed; empty bins are absent."""
    b = F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).cast("int")
    h = df.where(F.col(value).between(0, 1)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
    total = df.where(F.col(value).between(0, 1)).count()
    return h.withColumn("share", F.col("n") / F.lit(float(max(1, total))))
