"""Toxicity by a character n-gram linear classifier with naive Bayes scaling (operator 4).

Features are the 3-, 5- and 7-grams of the characters of a lower-cased text, present or absent, by 64-bit hashes of
their code points. Each is scaled by its naive Bayes log-count ratio on the training rows, and a logistic regression is
fitted on the scaled features: the sum of the rows' log-losses, where a class counts by the square root of how much
rarer it is than half, plus ``PENALTY`` / 2 times the weights' squares.

Training takes the rows of smallest seeded hash, at most ``max_train_rows`` of them. Their n-grams are counted in tasks
and summed by key; those that enough rows hold and whose rates differ enough between the classes become features. The
rows then travel as lists of feature numbers to the task that fits, whose memory is bounded by the parameters, however
long texts are. The check that scoring a document needs is one look-up for each place of its text in a bitmap, then an
exact search of the few that pass.

Results for special input: null and empty texts and those shorter than an n-gram have no features, so their score is the
intercept's; labels that are null, or whose document or doc_id is missing, are not trained on; of several labels for a
doc_id the largest counts; rows that tie at the bound of ``max_train_rows`` (equal doc_id and text) all stay; with no
training rows every score is 0, and where all labels agree the score follows the smoothed base rate; a null doc_id counts
as held out; repeated rows score alike; texts are scored whole at any length; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlark.llm.packing import pack, partition_keys, unpack
from meshlark.llm.scratch import Scratch, pick, released
from meshlark.llm.words import mix

ORDERS = (3, 5, 7)
#: Labelled rows to train on; ``None`` takes all.
MAX_TRAIN_ROWS = 6000
#: Features of a model; ``None`` takes all that pass.
MAX_FEATURES = 30_000
LEAST_DOCUMENTS, LEAST_Z = 4, 4.0
PENALTY = 0.3
#: Steps of the fit at most, the slope for each row at which it ends, and steps that it remembers.
ROUNDS, TOLERANCE, MEMORY = 200, 1e-6, 10
BITS = 20
#: Characters hashed at once, and partitions of the sums of training n-grams.
PIECE, PARTS = 1 << 20, 16
_POINT = 0x9E3779B97F4A7C15 | 1


def codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, one after the other, and where each begins and ends."""
    lower = [(t or "").lower() for t in texts]
    data = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return data, np.concatenate([[0], np.cumsum(list(map(len, lower)))]).astype(np.int64)


def grams(data: np.ndarray) -> list[np.ndarray]:
    """For each order the key of the n-gram that begins at each character."""
    out, total, power = [], np.zeros(len(data), np.uint64), 1
    for k in range(ORDERS[-1]):
        n = max(0, len(data) - k)
        total = total[:n] + data[k:] * np.uint64(power)
        power = power * _POINT & 0xFFFFFFFFFFFFFFFF
        if k + 1 in ORDERS:
            out.append(mix(total, k + 1))
    return out


def distinct_grams(data: np.ndarray) -> np.ndarray:
    """The keys of one text, each once, ascending; some characters at a time."""
    found = np.zeros(0, np.uint64)
    for i in range(0, len(data), PIECE):
        found = np.unique(np.concatenate([found, *grams(data[i : i + PIECE + ORDERS[-1] - 1])]))
    return found


def _slots(keys: np.ndarray) -> np.ndarray:
    return keys >> np.uint64(64 - BITS)


class Model:
    """Ascending keys, their weights and the intercept."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, intercept: float):
        self.keys, self.weights, self.intercept = keys, weights, intercept
        self.seen = np.zeros(1 << BITS, bool)
        self.seen[_slots(keys)] = True

    def features(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, feature) for each feature present in each text, once, ascending."""
        most = max(1, len(self.keys))
        found = [np.zeros(0, np.int64)]
        for i in range(0, len(data) if len(self.keys) else 0, PIECE):
            for order, keys in zip(ORDERS, grams(data[i : i + PIECE + ORDERS[-1] - 1]), strict=True):
                at = np.flatnonzero(self.seen[_slots(keys[:PIECE])])
                feature = np.minimum(np.searchsorted(self.keys, keys[at]), most - 1)
                hit = self.keys[feature] == keys[at]
                at, feature = at[hit] + i, feature[hit]
                text = np.searchsorted(offsets, at, "right") - 1
                inside = at + order <= offsets[text + 1]
                found.append(np.unique(text[inside] * most + feature[inside]))
        pairs = np.unique(np.concatenate(found))
        return pairs // most, pairs % most

    def score(self, texts: list[str | None]) -> np.ndarray:
        out, low = [np.zeros(0)], 0
        while low < len(texts):  # some megabytes of text, or one text if it is longer
            high, n = low, 0
            while high < len(texts) and n < PIECE:
                n += len(texts[high] or "")
                high += 1
            text, feature = self.features(*codes(texts[low:high]))
            out.append(np.bincount(text, self.weights[feature], high - low) + self.intercept)
            low = high
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(-np.concatenate(out)))


def count(texts: list[str | None], toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending keys, and how many toxic and other texts hold each."""
    keys, counts = np.zeros(0, np.uint64), np.zeros((2, 0), np.int64)
    held, of, n = [], [], 0

    def flush():
        nonlocal keys, counts, n
        together, back = np.unique(np.concatenate([keys, *held]), return_inverse=True)
        new = np.zeros((2, len(together)), np.int64)
        new[:, back[: len(keys)]] = counts
        own, kind = back[len(keys) :], np.repeat(np.array(of, np.int64), [len(x) for x in held])
        for k in (0, 1):
            new[k] += np.bincount(own[kind == k], minlength=len(together))
        keys, counts, n = together, new, 0
        held.clear(), of.clear()

    for text, label in zip(texts, toxic, strict=True):
        held.append(distinct_grams(codes([text])[0]))
        of.append(0 if label > 0 else 1)
        n += len(held[-1])
        if n > 4 * PIECE:
            flush()
    flush()
    return keys, counts[0], counts[1]


def chosen(ones: np.ndarray, zeros: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """How far the rates of each n-gram differ between the classes, in standard errors; 0 where too few rows hold it."""
    p1, p0, p = ones / n1, zeros / n0, (ones + zeros) / (n1 + n0)
    z = np.abs(p1 - p0) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n1 + 1 / n0))
    return np.where((ones + zeros >= LEAST_DOCUMENTS) & (z >= LEAST_Z), z, 0)


def ratios(ones: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """Naive Bayes log-count ratios, smoothed by one."""
    return np.log((ones + 1) / (ones + 1).sum()) - np.log((zeros + 1) / (zeros + 1).sum()) if len(ones) else np.zeros(0)


def base_rate(n1: int, n0: int) -> float:
    return float(np.log((n1 + 0.5) / (n0 + 0.5))) if n1 + n0 else -np.inf


def regression(rows: np.ndarray, columns: np.ndarray, ratio: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of the scaled features and the intercept, by limited-memory BFGS steps that halve until the loss falls enough."""
    n, n1, m = len(toxic), int(toxic.sum()), len(ratio)
    scaled = ratio[columns]
    # each class weighs half as far as the square root goes: rare toxic rows count for more, the base rate still shows
    weight = np.where(toxic, np.sqrt(n / (2 * n1)), np.sqrt(n / (2 * (n - n1))))
    sign = np.where(toxic, 1.0, -1.0)

    def loss(x):
        margin = sign * (np.bincount(rows, scaled * x[columns], n) + x[m])
        value = float((weight * np.logaddexp(0, -margin)).sum() + PENALTY / 2 * (x[:m] @ x[:m]))
        error = -sign * weight * np.exp(-np.logaddexp(0, margin))
        return value, np.append(np.bincount(columns, scaled * error[rows], m) + PENALTY * x[:m], error.sum())

    x = np.append(np.zeros(m), base_rate(n1, n - n1))
    value, slope = loss(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(ROUNDS):
        if np.abs(slope).max() < TOLERANCE * n:
            break
        move, rest = slope.copy(), []
        for step, turn in reversed(past):
            rest.append((step @ move) / (step @ turn))
            move -= rest[-1] * turn
        move *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, np.linalg.norm(slope))
        for (step, turn), r in zip(past, reversed(rest), strict=True):
            move += (r - (turn @ move) / (step @ turn)) * step
        size = 1.0
        while True:
            new = x - size * move
            new_value, new_slope = loss(new)
            if new_value <= value - 1e-4 * size * (slope @ move) or size < 1e-12:
                break
            size /= 2
        if (new - x) @ (new_slope - slope) > 0:
            past = [*past[1 - MEMORY :], (new - x, new_slope - slope)]
        x, value, slope = new, new_value, new_slope
    return x[:m], float(x[m])


def fit(texts: list[str | None], toxic: np.ndarray, max_features: int | None = MAX_FEATURES) -> Model:
    """The same fit of texts at hand."""
    toxic = np.asarray(toxic) > 0
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    if not n1 or not n0:
        return Model(np.zeros(0, np.uint64), np.zeros(0), base_rate(n1, n0))
    keys, ones, zeros = count(texts, toxic)
    z = chosen(ones, zeros, n1, n0)
    on = np.flatnonzero(z)
    on = np.sort(on[np.lexsort((keys[on].view(np.int64), -z[on]))[:max_features]])
    ratio = ratios(ones[on], zeros[on])
    w, b = regression(*Model(keys[on], ratio, 0.0).features(*codes(texts)), ratio, toxic) if len(on) else (ratio, base_rate(n1, n0))
    return Model(keys[on], w * ratio, b)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _training(documents: DataFrame, labels: DataFrame, max_train_rows: int | None, scratch: Scratch, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(row, text, toxic): the labelled rows that are not held out, of smallest hash if there are more than the bound."""
    known = pick(labels, doc_id=id_col, toxic=label_col).filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    known = known.filter(~held_out()).withColumn("order", F.xxhash64("doc_id", F.lit(17)))
    if max_train_rows is not None:
        known = F.broadcast(known.orderBy("order", "doc_id").limit(max_train_rows))  # max_train_rows ids and labels
    texts = pick(documents, doc_id=id_col, text=text_col).join(known, "doc_id")
    texts = scratch.write(texts.select(F.xxhash64("order", "doc_id", "text").alias("row"), "order", "doc_id", "text", "toxic"), "train")
    if max_train_rows is not None and texts.count() > max_train_rows:  # repeated doc_ids exceed the bound
        last = texts.select("order", "doc_id", "row").orderBy("order", "doc_id", "row").limit(max_train_rows).agg(F.max(F.struct("order", "doc_id", "row"))).first()[0]
        texts = texts.filter(F.struct("order", "doc_id", "row") <= F.struct(*[F.lit(x).cast(texts.schema[c].dataType).alias(c) for c, x in last.asDict().items()]))
    return texts.select("row", "text", "toxic")


def _features(texts: DataFrame, n1: int, n0: int, max_features: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Ascending keys of the features, and their log-count ratios."""
    keys = partition_keys(PARTS)

    def tally(batches):
        held, toxic = [], []
        for batch in batches:
            held += batch.column("text").to_pylist()
            toxic += batch.column("toxic").to_pylist()
            if sum(len(t or "") for t in held) > 8 * PIECE:
                yield blobs(held, toxic)
                held, toxic = [], []
        yield blobs(held, toxic)

    def blobs(texts, toxic):
        found, ones, zeros = count(texts, np.array(toxic, float))
        part = (found % np.uint64(PARTS)).astype(np.int64)
        own = [np.flatnonzero(part == p) for p in range(PARTS)]
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array([pack(found[i], ones[i], zeros[i]) for i in own], pa.binary())], ["part", "grams"])

    def add(batches):
        total = [np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        for batch in batches:
            for blob in batch.column("grams").to_pylist():
                found, ones, zeros = unpack(blob)
                together, back = np.unique(np.concatenate([total[0], found]), return_inverse=True)
                total = [together, *(np.bincount(back, np.concatenate([x, y.astype(np.int64)]), len(together)).astype(np.int64) for x, y in zip(total[1:], (ones, zeros), strict=True))]
        z = chosen(total[1], total[2], n1, n0)
        on = np.flatnonzero(z)
        yield pa.RecordBatch.from_arrays([pa.array(total[0][on].view(np.int64)), pa.array(total[1][on]), pa.array(total[2][on]), pa.array(z[on])], ["key", "ones", "zeros", "z"])

    sums = texts.mapInArrow(released(tally), "part int, grams binary").repartition(PARTS, "part").mapInArrow(released(add), "key long, ones long, zeros long, z double")
    if max_features is not None:
        sums = sums.orderBy(F.col("z").desc(), "key").limit(max_features)
    found = sorted((r.key & 0xFFFFFFFFFFFFFFFF, r.ones, r.zeros) for r in sums.collect())  # the model's features
    ones, zeros = (np.array([r[k] for r in found], np.int64) for k in (1, 2))
    return np.array([r[0] for r in found], np.uint64), ratios(ones, zeros)


def train(documents: DataFrame, labels: DataFrame, max_train_rows: int | None = MAX_TRAIN_ROWS, max_features: int | None = MAX_FEATURES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fits on at most ``max_train_rows`` rows that are not held out; the model comes to the driver."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "toxicity")
    texts = _training(documents, labels, max_train_rows, scratch, id_col, text_col, label_col)
    of = {r.toxic: r["count"] for r in texts.groupBy("toxic").count().collect()}
    n1, n0 = of.get(True, 0), of.get(False, 0)
    nothing = Model(np.zeros(0, np.uint64), np.zeros(0), base_rate(n1, n0))
    if not n1 or not n0:
        scratch.close()
        return nothing
    keys, ratio = _features(texts, n1, n0, max_features)
    if not len(keys):
        scratch.close()
        return nothing
    shared = spark.sparkContext.broadcast(keys)  # max_features numbers

    def describe(batches):
        model = Model(shared.value, np.zeros(len(shared.value)), 0.0)
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                text, feature = model.features(*codes(part.column("text").to_pylist()))
                cut = pa.array(np.searchsorted(text, np.arange(part.num_rows + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("toxic"), pa.ListArray.from_arrays(cut, pa.array(feature.astype(np.int32)))], ["row", "toxic", "features"])

    def solve(batches):
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        lists, toxic = table.column("features").chunk(0), table.column("toxic").to_numpy()
        size = np.diff(lists.offsets.to_numpy())
        w, b = regression(np.repeat(np.arange(len(toxic)), size), lists.flatten().to_numpy().astype(np.int64), ratio, toxic)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(w) + 1)), pa.array(np.append(w, b))], ["feature", "weight"])

    # in one task: a list of feature numbers for each of max_train_rows rows, in an order that no layout changes
    rows = scratch.write(texts.mapInArrow(released(describe), "row long, toxic boolean, features array<int>"), "rows")
    found = rows.repartition(1).sortWithinPartitions("row", "features").mapInArrow(released(solve), "feature long, weight double").orderBy("feature").collect()
    scratch.close()
    weights = np.array([r.weight for r in found])
    return Model(keys, weights[:-1] * ratio, float(weights[-1]))


def scorer(spark: SparkSession, model: Model):
    """A column function from text to score; the model (``max_features`` weights) is broadcast."""
    shared = spark.sparkContext.broadcast((model.keys, model.weights, model.intercept))
    made: list[Model] = []

    def score(texts: pa.Array) -> pa.Array:
        if not made:
            made.append(Model(*shared.value))
        return pa.array(np.concatenate([np.zeros(0), *(made[0].score(texts.slice(i, 512).to_pylist()) for i in range(0, len(texts), 512))]))

    return F.arrow_udf(score, "double")


def score(documents: DataFrame, labels: DataFrame, max_train_rows: int | None = MAX_TRAIN_ROWS, max_features: int | None = MAX_FEATURES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``documents``."""
    model = train(documents, labels, max_train_rows, max_features, id_col, text_col)
    rows = pick(documents, doc_id=id_col, text=text_col)
    out = rows.select("doc_id", held_out().alias("held_out"), scorer(documents.sparkSession, model)("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
