"""Quality classifier by co-training over two views of a document.

The text view describes what is said (classes of characters, words, repetition, also of the worst eighth);
the page view describes how and where it stands (language, source, length, lines). Each view has a logistic
classifier. In each round all confident labels of one view on unlabelled documents join the other's
training set, where the first label stays. Both are calibrated on labels held out of the fit, combined on others held out
of both, and score all documents.

Features are computed once for all documents. The driver holds at most ``MOST_LABELLED`` labelled documents,
drawn by a hash of the id. The unlabelled ones are all used: executors find their labels from the classifiers
of the rounds before, and send sums (moments, gradients, Hessians) for the fit; scoring covers every row.

Defined cases: null and empty texts score by their (zero) features; a null language or source is a value of
its own; labels that contradict each other count as their majority, ties as good; null labels are left out; a label
counts for each row that shares its doc_id, and each row is judged by its own text, those with a null doc_id too;
a very long text is one row, its features read in one pass; columns of the input beyond the four that are read don't
clash; an empty table gives an empty result; with fewer than two classes among the labels of a part every document
has score 1 and is kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfabric.llm.hashing import word_hashes
from kinfabric.llm.shared import discard, documents, free_name, materialize

MOST_LABELLED, ROUNDS, CONFIDENT, THRESHOLD = 8_000, 4, 0.97, 0.5
_CLASS = np.full(256, 6, np.uint8)
_CLASS[ord("A") : ord("Z") + 1] = 0
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[9, 11, 12, 13, 32]] = 3
_CLASS[10] = 4
_CLASS[[ord(c) for c in "!#$%&*|"]] = 5
_CLASS[128:] = 7
PLACES = 32


def text_view(data: bytes) -> list[float]:
    kinds = _CLASS[np.frombuffer(data, np.uint8)]
    n = max(1, len(kinds))
    share = np.bincount(kinds, minlength=8) / n
    worst_noise = worst_upper = 0.0
    step = max(64, -(-len(kinds) // 8))
    for at in range(0, len(kinds), step):
        part = kinds[at : at + step]
        if len(part) >= 32:
            worst_noise = max(worst_noise, float(np.mean(part == 5)))
            worst_upper = max(worst_upper, float(np.mean(part == 0)))
    words = word_hashes(data)
    m = max(1, len(words))
    again = words[1:] == words[:-1]
    worst_again = 0.0
    step = max(16, -(-len(again) // 8))
    for at in range(0, len(again), step):
        worst_again = max(worst_again, float(np.mean(again[at : at + step])))
    distinct = len(np.unique(words)) / m
    return [*share.tolist(), worst_noise, worst_upper, worst_again, float(again.mean()) if len(again) else 0.0, distinct, min(64, n / m) / 16, np.log1p(m)]


def page_view(data: bytes, lang: str | None, source: str | None) -> list[float]:
    lines = data.split(b"\n")
    lengths = np.array([len(x) for x in lines], np.float64)
    out = [np.log1p(len(data)), np.log1p(len(lines)), np.log1p(lengths.mean()), np.log1p(lengths.max()), float(np.mean(lengths == 0)), len(set(lines)) / len(lines)]
    places = np.zeros(2 * PLACES)
    for i, value in enumerate((lang, source)):
        name = f"{i}:{'~' if value is None else value}".encode()
        places[i * PLACES + int(word_hashes(name.replace(b" ", b"_"))[0] % np.uint64(PLACES))] = 1
    return [*out, *places.tolist()]


def _row(docs: DataFrame):
    """16 bytes that name what a row is judged by, and its doc_id."""
    said = [F.coalesce(F.concat(F.lit("="), docs[c].cast("string")), F.lit("~")) for c in ("doc_id", "lang", "source", "text")]
    return F.unhex(F.md5(F.concat_ws("\x1f", *said).cast("binary")))


def views(docs: DataFrame) -> DataFrame:
    """(doc_id, rk, text_view, page_view) of every row."""

    def lists(rows):
        ends = pa.array(np.arange(0, len(rows) + 1) * (len(rows[0]) if rows else 0), pa.int32())
        return pa.ListArray.from_arrays(ends, pa.array(np.array(rows, np.float32).reshape(-1)))

    def run(batches):
        for batch in batches:
            texts = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in batch.column(1)]
            page = [page_view(t, g.as_py(), s.as_py()) for t, g, s in zip(texts, batch.column(2), batch.column(3), strict=True)]
            columns = [batch.column(0), batch.column(4), lists([text_view(t) for t in texts]), lists(page)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "rk", "text_view", "page_view"])

    said = [F.col(c).cast("string").alias(c) for c in ("text", "lang", "source")]
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *said, _row(docs).alias("rk"))
    return picked.mapInArrow(run, "doc_id long, rk binary, text_view array<float>, page_view array<float>")


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


class _Descent:
    """Newton steps on a convex loss; a step that doesn't lower it enough is cut to a quarter, as labels that features part cleanly lead to steps far too long."""

    def __init__(self, start: np.ndarray):
        self.weights = self.trial = start
        self.loss, self.share, self.done = None, 1.0, False

    def told(self, loss: float, slope: np.ndarray, bend: np.ndarray) -> None:
        """The loss at ``trial`` with its gradient and Hessian."""
        if self.loss is None or loss <= self.loss - 1e-4 * self.share * self.gain + 1e-10 * abs(self.loss):
            self.weights, self.loss, self.share = self.trial, loss, 1.0
            self.step = np.linalg.solve(bend, slope)
            self.gain = float(slope @ self.step)
            if self.gain < 2e-8:  # twice what is left to be lowered
                self.weights, self.done = self.weights - self.step, True
        else:
            self.share /= 4
            self.done = self.share < 1e-8
        self.trial = self.weights - self.share * self.step


def _ridge(n: int, penalty: float) -> np.ndarray:
    ridge = np.eye(n) * penalty
    ridge[-1, -1] = 1e-6
    return ridge


@dataclass
class Logistic:
    """L2-regularised logistic regression on standardised features, by Newton steps."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    a: float = 1.0
    b: float = 0.0

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> Logistic:
        model = cls(x.mean(0), x.std(0) + 1e-6, np.zeros(x.shape[1] + 1))
        ridge, down = _ridge(x.shape[1] + 1, penalty), _Descent(model.weights)
        while not down.done:
            model.weights = w = down.trial
            loss, slope, bend = _slopes(model, x, y)
            down.told(float(loss[0]) + w @ ridge @ w / 2, slope + ridge @ w, bend + ridge)
        model.weights = down.weights
        return model

    def raw(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return z @ self.weights[:-1] + self.weights[-1]

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Platt scaling on held-out labels."""
        fitted = Logistic.fit(self.raw(x)[:, None], y)
        self.a = float(fitted.weights[0] / fitted.scale[0])
        self.b = float(fitted.weights[1] - fitted.weights[0] * fitted.mean[0] / fitted.scale[0])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.a * self.raw(x) + self.b


def _lists(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(rows, -1).astype(np.float64)


def _taught(past: list[list[Logistic]], views: list[np.ndarray]) -> list[np.ndarray]:
    """For each view, the labels that the other view's classifiers of past rounds gave, the first confident one each; else NaN."""
    out = [np.full(len(x), np.nan) for x in views]
    for models in past:
        for view, model in enumerate(models):
            p = _sigmoid(model.logit(views[view]))
            labels = out[1 - view]
            fresh = np.isnan(labels) & (np.maximum(p, 1 - p) >= CONFIDENT)
            labels[fresh] = p[fresh] > 0.5
    return out


def _summed(pool: DataFrame, of, sizes: list[int]) -> list[np.ndarray]:
    """The sum over the pool of the arrays, of the given sizes, that ``of`` makes of a batch's views; added up on the executors."""

    def add(parts):
        total = np.zeros(sum(sizes))
        for part in parts:
            total += part
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    def run(batches):
        views = ([_lists(batch.column(i), batch.num_rows) for i in (0, 1)] for batch in batches if batch.num_rows)
        yield from add(np.concatenate([x.ravel() for x in of(v)]) for v in views)

    def join(batches):
        yield from add(np.frombuffer(x.as_py()) for batch in batches for x in batch.column(0))

    rows = pool.select("text_view", "page_view").mapInArrow(run, "sums binary").repartition(8).mapInArrow(join, "sums binary").collect()
    total = sum((np.frombuffer(r.sums) for r in rows), np.zeros(sum(sizes)))
    return np.split(total, np.cumsum(sizes)[:-1])


def _moments(x: np.ndarray) -> list[np.ndarray]:
    return [np.array([float(len(x))]), x.sum(0), (x * x).sum(0)]


def _slopes(model: Logistic, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """The log loss, its gradient and Hessian."""
    z = np.hstack([np.clip((x - model.mean) / model.scale, -8, 8), np.ones((len(x), 1))])
    raw = z @ model.weights
    p = _sigmoid(raw)
    return [np.array([float((np.logaddexp(0, raw) - y * raw).sum())]), z.T @ (p - y), (z * (p * (1 - p) + 1e-9)[:, None]).T @ z]


def _fit_all(pool: DataFrame, past: list[list[Logistic]], sets: list[tuple[np.ndarray, np.ndarray]], penalty: float = 1.0) -> list[Logistic]:
    """:meth:`Logistic.fit` of both views on the labelled rows and all that the past rounds teach of the pool."""
    widths = [x.shape[1] for x, _ in sets]

    def moments(views):
        return [m for x, y in zip(views, _taught(past, views), strict=True) for m in _moments(x[~np.isnan(y)])]

    sums = _summed(pool, moments, [n for w in widths for n in (1, w, w)])
    models = []
    for view, (x, _) in enumerate(sets):
        n, one, two = (a + b for a, b in zip(_moments(x), sums[3 * view : 3 * view + 3], strict=True))
        mean = one / n
        scale = np.sqrt(np.maximum(two / n - mean * mean, 0)) + 1e-6
        old = past[-1][view]
        start = old.weights[:-1] / old.scale
        models.append(Logistic(mean, scale, np.append(start * scale, old.weights[-1] + start @ (mean - old.mean))))
    ways = [_Descent(m.weights) for m in models]
    while not all(w.done for w in ways):
        for m, way in zip(models, ways, strict=True):
            m.weights = way.trial

        def slopes(views, models=models):
            return [s for m, x, y in zip(models, views, _taught(past, views), strict=True) for s in _slopes(m, x[~np.isnan(y)], y[~np.isnan(y)])]

        sums = _summed(pool, slopes, [n for w in widths for n in (1, w + 1, (w + 1) ** 2)])
        for view, (m, way, (x, y)) in enumerate(zip(models, ways, sets, strict=True)):
            if way.done:
                continue
            loss, slope, bend = (a + b.reshape(a.shape) for a, b in zip(_slopes(m, x, y), sums[3 * view : 3 * view + 3], strict=True))
            w, ridge = way.trial, _ridge(len(slope), penalty)
            way.told(float(loss[0]) + w @ ridge @ w / 2, slope + ridge @ w, bend + ridge)
    for m, way in zip(models, ways, strict=True):
        m.weights = way.weights
    return models


def cotrain(text: np.ndarray, page: np.ndarray, y: np.ndarray, part: np.ndarray, pool: DataFrame, rounds: int = ROUNDS):
    """(text classifier, page classifier, weights of their calibrated logits and a constant).

    ``part`` says what a labelled row is for: 0 the fit of the views, 1 their calibration, 2 the weights. ``pool``
    has text_view and page_view of all unlabelled documents; only sums over it come to the driver.
    """
    mine, past, held, last = [text, page], [], part == 1, part == 2
    sets = [(x[part == 0], y[part == 0]) for x in mine]
    models = [Logistic.fit(*s) for s in sets]
    for step in range(rounds + 1):
        for model, x in zip(models, mine, strict=True):
            model.calibrate(x[held], y[held])
        if step == rounds:
            break
        past.append(models)
        models = _fit_all(pool, past, sets)
    both = np.stack([m.logit(x[last]) for m, x in zip(models, mine, strict=True)], 1)
    joint = Logistic.fit(both, y[last])
    w = joint.weights[:2] / joint.scale
    return models[0], models[1], (float(w[0]), float(w[1]), float(joint.weights[2] - w @ joint.mean))


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, most_labelled: int = MOST_LABELLED, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, rk, text_score, page_score, score, keep), one row per row of ``docs``; rk names the row (see :func:`_row`)."""
    table = materialize(views(docs), "quality-views")
    marks = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = marks.agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    known = table.join(marks, "doc_id").orderBy(*order, "rk").limit(most_labelled).toArrow()
    schema = "doc_id long, rk binary, text_score double, page_score double, score double, keep boolean"
    stack = lambda c: c.combine_chunks().flatten().to_numpy().reshape(len(c), -1).astype(np.float64) if len(c) else np.zeros((0, 1))
    y = known["y"].to_numpy().astype(np.float64)
    part = np.array([0, 0, 0, 1, 0, 0, 0, 2])[np.arange(len(y)) % 8]
    if any(len(set(y[part == p])) < 2 for p in range(3)):
        return table.select("doc_id", "rk", *[F.lit(1.0).alias(c) for c in ("text_score", "page_score", "score")], F.lit(True).alias("keep"))
    text, page = stack(known["text_view"]), stack(known["page_view"])
    pool = table.join(marks, "doc_id", "left_anti").where("doc_id IS NOT NULL").select("text_view", "page_view")
    pool = materialize(pool, "quality-pool")
    of_text, of_page, (a, b, c) = cotrain(text, page, y, part, pool, rounds)
    discard(pool)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1)
            z = batch.column(3).flatten().to_numpy().reshape(batch.num_rows, -1)
            one, two = of_text.logit(x), of_page.logit(z)
            whole = _sigmoid(a * one + b * two + c)
            columns = [batch.column(0), batch.column(1), *map(pa.array, (_sigmoid(one), _sigmoid(two), whole, whole >= threshold))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "rk", "text_score", "page_score", "score", "keep"])

    return table.mapInArrow(run, schema)


def drop_rejected(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that the classifier rejects, each by its own text, language and source."""
    name = free_name(docs, "_rk")
    gone = score(docs, labels, **options).where("NOT keep").select(F.col("rk").alias(name)).distinct()
    return docs.withColumn(name, _row(docs)).join(gone, name, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("rk")
