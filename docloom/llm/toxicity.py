"""Toxicity scores by FTRL-proximal logistic regression.

Features are hashed words, word pairs and skip-grams (pairs one or two words
apart), each counted once a document.  Every coordinate has its own rate, and L1
keeps most weights at zero, so the model is a short list of weights that is
broadcast.  It is fitted on about ``MOST_ROWS`` labelled rows outside the held-out
fold, chosen by a threshold on a hash of doc_id, and on fewer if they have more than
``MOST_FEATURES`` features.  Features are hashed where texts are read; one bounded
task fits the weights; scoring reads every row's whole text without a shuffle.

Null and empty texts get the score of a document without features.  Without usable
labels (none, or one class only) every score is 0.0.  Of several labels of one
doc_id the largest counts; rows that repeat a doc_id with other texts all learn it.
Labels, lang, source and doc_id are never inputs of a score.  Repeated rows are
scored alike; the order of rows does not matter, as training rows are sorted by
doc_id and features.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import common

#: Bounds of the training sample: expected labelled rows, and features (4 bytes each) of all of them.
MOST_ROWS, MOST_FEATURES = 20_000, 50_000_000
BITS = 20
BETA, L2, BIAS_RATE = 1.0, 0.0, 0.03
#: A feature is learned from if so many training rows have it.
LEAST_ROWS = 2
REJECT_AT = 0.7
MARKS = ".,;:!?\"'()[]{}*%$&#|-_<>"


@dataclass(frozen=True)
class Setting:
    """What ``compare_settings`` chooses by: passes over the rows, rate, L1, and the weight of a toxic row."""

    epochs: int = 4
    alpha: float = 3.0
    l1: float = 6.0
    positive: float = 1.0


DEFAULT = Setting()
SETTINGS = (DEFAULT, Setting(l1=3.0), Setting(l1=2.0), Setting(positive=4.0), Setting(l1=4.0, positive=4.0),
            Setting(positive=8.0), Setting(6, 1.0, 3.0, 4.0), Setting(6, 1.0, 2.0, 2.0))


class Features:
    """Distinct feature indices of texts; words are hashed once and remembered."""

    def __init__(self):
        import xxhash

        self.words = common.Remembered(lambda w: xxhash.xxh64_intdigest(w.lower().strip(MARKS)), 100_000)

    def all(self, text: str):
        """Indices of all features, repeats included."""
        import numpy as np

        words = text.split()
        h = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        a, b, c = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
        parts = [h * a]
        for gap in (1, 2, 3):
            if len(h) > gap:
                parts.append((h[:-gap] * b + h[gap:] * c + np.uint64(gap)) * a)
        return (np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.int64)

    def distinct(self, text: str):
        import numpy as np

        return np.unique(self.all(text)).astype(np.int32)


class Ftrl:
    """FTRL-proximal with per-coordinate rates over 0/1 features."""

    def __init__(self, setting: Setting = DEFAULT):
        import numpy as np

        self.setting = setting
        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)
        self.bias = 0.0

    def weights(self, at):
        import numpy as np

        z = self.z[at]
        rate = (BETA + np.sqrt(self.n[at])) / self.setting.alpha + L2
        return np.where(np.abs(z) <= self.setting.l1, 0.0, (np.sign(z) * self.setting.l1 - z) / rate)

    def learn(self, at, label: int) -> None:
        import numpy as np

        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum() + self.bias, -35, 35))) - label
        g *= self.setting.positive if label else 1.0
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.setting.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g
        self.bias -= BIAS_RATE * g


def fit(rows: list, setting: Setting = DEFAULT) -> list[tuple[int, float]]:
    """(index, weight) of the non-zero weights of (label, feature indices) rows, in their
    order; the bias has index -1.  [] without two classes."""
    import numpy as np

    if len({label for label, _ in rows}) < 2:
        return []
    having = np.zeros(1 << BITS, np.int64)
    for _, at in rows:
        having[at] += 1
    often, model = having >= LEAST_ROWS, Ftrl(setting)
    for epoch in range(setting.epochs):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            label, at = rows[i]
            model.learn(at[often[at]], label)
    held = np.flatnonzero(np.abs(model.z) > setting.l1)
    return [(-1, float(model.bias)), *zip(held.tolist(), model.weights(held).tolist())]


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """(doc_id, toxic, features) of about ``most`` labelled rows outside the held-out fold, in the shared folder.

    Ids are chosen before texts are read; texts do not leave the tasks that read them.
    """
    known = labels.where(labels["toxic"].isNotNull() & labels["doc_id"].isNotNull() & ~common.fold_is_held_out(labels["doc_id"]))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    picked = _thinned(known, most / max(1, known.count()), "doc_id")
    texts = docs.select("doc_id", common.text_of(docs).alias("text")).join(F.broadcast(picked), "doc_id")

    def start():
        made = common.per_process("toxicity", Features)
        return lambda keys, texts: [keys[0], keys[1], [made.distinct(t).tolist() for t in texts]]

    found = common.settled(common.map_texts(texts, ["doc_id", "toxic"], "doc_id long, toxic int, features array<int>", start))
    total = found.agg(F.sum(F.size("features").cast("long"))).first()[0] or 0
    return _thinned(found, MOST_FEATURES / max(1, total), "doc_id")


def _thinned(rows: DataFrame, share: float, key: str) -> DataFrame:
    """The rows whose key's hash is in the first ``share`` of the range: all from a share of 1 on."""
    scale = 1 << 30
    return rows if share >= 1 else rows.where(F.pmod(F.xxhash64(key, F.lit(17)), F.lit(scale)) < int(scale * share))


def _rows(batches: Iterable) -> list:
    """(label, feature indices) in the order of ids and features, whatever the order of arrival."""
    from collections import Counter

    found = []
    for batch in batches:
        ids, toxic, column = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
        flat, ends = column.flatten().to_numpy().copy(), column.offsets.to_numpy()
        ends = ends - ends[0]
        found += [(i, y, flat[a:b]) for i, y, a, b in zip(ids, toxic, ends, ends[1:])]
    rows = Counter(i for i, _, _ in found)
    # Bytes of features are held only to order the rows of a repeated id.
    found.sort(key=lambda x: (x[0], len(x[2]), x[2].tobytes() if rows[x[0]] > 1 else b""))
    return [(y, at) for _, y, at in found]


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> list[tuple[int, float]]:
    """The fitted weights.  The one training task reads at most MOST_FEATURES features; at most 2^BITS weights leave it."""

    def run(batches):
        common.per_process("training", list)  # no operator's tables beside the rows
        found = fit(_rows(batches))
        yield pa.RecordBatch.from_pydict({"at": pa.array([i for i, _ in found], pa.int64()), "weight": pa.array([w for _, w in found], pa.float64())})

    fitted = training_rows(docs, labels, most).repartition(1).mapInArrow(run, "at long, weight double")
    return [(r["at"], r["weight"]) for r in fitted.collect()]


def compare_settings(docs: DataFrame, labels: DataFrame, settings: tuple = SETTINGS, most: int = MOST_ROWS) -> DataFrame:
    """(setting, found, toxic, false_alarms, clean): each setting learned on one of the two training folds
    and judged at REJECT_AT on the other.  The held-out fold has no part in it.
    """
    rows = training_rows(docs, labels, most).where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    rows = rows.select("doc_id", "toxic", "features", (F.crc32(F.col("doc_id").cast("string")) % 3 == 2).alias("judged"))
    kind = "setting int, found long, toxic long, false_alarms long, clean long"

    def run(batches):
        import pyarrow.compute as pc

        batches = list(batches)
        folds = [_rows(b.filter(pc.equal(b.column(3), judged)) for b in batches) for judged in (False, True)]
        for k, setting in enumerate(settings):
            scorer = Scorer(fit(folds[0], setting))
            scored = [(scorer.score_of(at) >= REJECT_AT, y) for y, at in folds[1]]
            sums = [sum(1 for p, y in scored if p and y), sum(y for _, y in scored), sum(1 for p, y in scored if p and not y), sum(1 - y for _, y in scored)]
            yield pa.RecordBatch.from_pydict(dict(zip(("setting", "found", "toxic", "false_alarms", "clean"), ([x] for x in (k, *sums)))), schema=pa.schema([("setting", pa.int32()), *((n, pa.int64()) for n in ("found", "toxic", "false_alarms", "clean"))]))

    return rows.repartition(1).mapInArrow(run, kind)


class Scorer:
    def __init__(self, weights: list[tuple[int, float]]):
        import numpy as np

        self.features, self.fitted = common.per_process("toxicity", Features), bool(weights)
        self.table, self.bias = np.zeros(1 << BITS), 0.0
        for at, w in weights:
            if at < 0:
                self.bias = w
            else:
                self.table[at] = w

    def score(self, text: str) -> float:
        import numpy as np

        if not self.fitted:
            return 0.0
        at = self.features.all(text)
        return self.score_of(np.unique(at[self.table[at] != 0]))

    def score_of(self, hit) -> float:
        """The score of distinct feature indices."""
        import numpy as np

        if not self.fitted:
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(self.table[hit].sum() + self.bias, -35, 35))))


def score(docs: DataFrame, weights: list[tuple[int, float]]) -> DataFrame:
    """(doc_id, score) for every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def start():
        scorer = Scorer(sent.value)
        return lambda keys, texts: [keys[0], [scorer.score(t) for t in texts]]

    return common.map_texts(docs, ["doc_id"], "doc_id long, score double", start)


def with_score(docs: DataFrame, weights: list[tuple[int, float]], name: str = "score") -> DataFrame:
    """docs with a score column; only texts go to Python and only scores come back."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(sent.value)
        for texts in arrays:
            parts = (texts.slice(at, 256).to_pylist() for at in range(0, len(texts), 256))
            yield pa.array([scorer.score(t or "") for part in parts for t in part], pa.float64())

    return docs.withColumn(name, F.arrow_udf(run, "double")("text"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs."""
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", common.fold_is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= REJECT_AT).cast("int").alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
