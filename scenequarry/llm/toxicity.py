"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other. Each category's logistic
regression sees the text's features and the probabilities of the categories
before it; in training those probabilities come from models that did not see
the row (out of fold), so a later model learns how far to trust them.

Features are which words and word beginnings occur, whether they repeat and
make up a notable share of the words, and a few proportions of the whole text.
The classifier is fitted on at most ``SAMPLE`` labelled rows, taken by seeded
hash; it then scores every document, and whole texts, however long.
"""

from __future__ import annotations

import pickle
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import held, slices

CATEGORIES = ("quality", "toxic")
#: Labelled rows that the fit sees at most; features kept a category; folds.
SAMPLE, KEPT, FOLDS = 5_000, 1_024, 4
BUCKETS, STARTS = 1 << 20, (3, 4, 5, 6, 7)
#: Least |z| of a feature's association with a category, and least documents that hold it.
LEAST_Z, LEAST_DOCS = 4.0, 5
N_DENSE, SHARES = 4, (0.005, 0.015)
#: Words that a worker remembers with their features; those beyond are computed again.
REMEMBERED = 300_000
_EDGES = re.compile(r"^[\W\d_]+|[\W\d_]+$")


def word_features(word: str) -> tuple[int, ...]:
    """Hashed features of a lower-cased word: itself and its beginnings, without signs around it."""
    word = _EDGES.sub("", word)
    if not word:
        return ()
    names = [f"={word}", *(f"^{word[:n]}" for n in STARTS if len(word) >= n)]
    return tuple(zlib.crc32(n.encode()) % BUCKETS for n in names)


def dense_features(text: str, words: list[str]) -> tuple[float, ...]:
    """Log word count and the shares of distinct words, of letters and of distinct lines."""
    n = max(1, len(words))
    lines = text.split("\n")
    letters = sum(map(str.isalpha, words))
    return float(np.log1p(len(words))), len(set(words)) / n, letters / n, len(set(lines)) / len(lines)


@dataclass
class Linear:
    """Logistic regression over kept features, dense proportions and earlier probabilities."""

    kept: np.ndarray
    weights: np.ndarray
    dense: np.ndarray
    bias: float
    mean: np.ndarray
    scale: np.ndarray

    def logits(self, rows: list[np.ndarray], dense: np.ndarray) -> np.ndarray:
        out = ((dense - self.mean) / self.scale) @ self.dense + self.bias
        if len(self.kept):
            for i, row in enumerate(rows):
                at = np.minimum(np.searchsorted(self.kept, row), len(self.kept) - 1)
                out[i] += self.weights[at[self.kept[at] == row]].sum()
        return out

    def probability(self, rows: list[np.ndarray], dense: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(rows, dense))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_linear(rows: list[np.ndarray], dense: np.ndarray, y: np.ndarray, kept: int = KEPT, ridge: float = 1e-4, steps: int = 200) -> Linear:
    """Features by the z of their log odds ratio, then accelerated gradient descent."""
    n, positive = len(y), y.sum()
    mean, scale = (dense.mean(axis=0), dense.std(axis=0) + 1e-6) if n else (np.zeros(dense.shape[1]), np.ones(dense.shape[1]))
    if not 0 < positive < n:
        sure = 40.0 if positive else -40.0
        return Linear(np.empty(0, np.int64), np.empty(0), np.zeros(dense.shape[1]), sure, mean, scale)
    where = np.repeat(np.arange(n, dtype=np.int32), [len(r) for r in rows])
    flat = np.concatenate(rows)
    space = int(flat.max(initial=0)) + 1
    with_, pos = np.bincount(flat, minlength=space), np.bincount(np.concatenate([rows[i] for i in np.flatnonzero(y)]), minlength=space)
    names = np.flatnonzero(with_ >= LEAST_DOCS)
    with_, pos = with_[names], pos[names]
    a, b, c, d = pos + 0.5, with_ - pos + 0.5, positive - pos + 0.5, n - positive - with_ + pos + 0.5
    z = np.abs(np.log(a * d / (b * c)) / np.sqrt(1 / a + 1 / b + 1 / c + 1 / d))
    best = np.argsort(-z, kind="stable")[:kept]
    chosen = np.sort(names[best[z[best] >= LEAST_Z]])
    x = np.zeros((n, len(chosen) + dense.shape[1] + 1), np.float32)
    column = np.full(space, -1, np.int32)
    column[chosen] = np.arange(len(chosen))
    hit = column[flat] >= 0
    x[where[hit], column[flat[hit]]] = 1
    x[:, len(chosen) : -1] = (dense - mean) / scale
    x[:, -1] = 1
    size = np.sqrt((x * x).mean(axis=0)) + 1e-6  # rare features learn as fast as common ones
    x /= size
    penalty = np.full(x.shape[1], ridge, np.float32)
    penalty[-1] = 0
    v = np.ones(x.shape[1], np.float32)
    for _ in range(15):
        v = x.T @ (x @ v)
        top = float(np.linalg.norm(v))
        v /= top
    rate = 1 / (0.25 * top / n * 1.05 + ridge)
    w = ahead = np.zeros(x.shape[1], np.float32)
    for i in range(steps):
        grad = x.T @ (_sigmoid(x @ ahead) - y.astype(np.float32)) / n + penalty * ahead
        new = ahead - rate * grad
        ahead = new + i / (i + 3) * (new - w)
        w = new
    w, k = w / size, len(chosen)
    return Linear(chosen.astype(np.int64), w[:k].astype(float), w[k:-1].astype(float), float(w[-1]), mean, scale)


@dataclass
class Chain:
    categories: tuple[str, ...]
    models: list[Linear]
    thresholds: list[float]

    def probabilities(self, rows: list[np.ndarray], dense: np.ndarray) -> np.ndarray:
        out = np.empty((len(rows), 0))
        for model in self.models:
            out = np.column_stack([out, model.probability(rows, np.column_stack([dense, out]))])
        return out


def fit_chain(rows: list[np.ndarray], dense: np.ndarray, labels: np.ndarray, categories: tuple[str, ...] = CATEGORIES, folds: int = FOLDS) -> Chain:
    """``labels``: one 0/1 column a category, in chain order. A category's threshold is the
    one of best F1 among its out-of-fold probabilities."""
    n = len(rows)
    fold = np.arange(n) % folds
    earlier, models, thresholds = np.empty((n, 0)), [], []
    for j in range(len(categories)):
        seen, y = np.column_stack([dense, earlier]), labels[:, j].astype(float)
        unseen = np.zeros(n)
        for f in range(folds):
            train, test = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            if len(test):
                model = fit_linear([rows[i] for i in train], seen[train], y[train])
                unseen[test] = model.probability([rows[i] for i in test], seen[test])
        models.append(fit_linear(rows, seen, y))
        thresholds.append(best_threshold(unseen, y))
        earlier = np.column_stack([earlier, unseen])
    return Chain(categories, models, thresholds)


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The midpoint below the least accepted probability where F1 is best; above 1 if nothing is positive."""
    if not y.sum():
        return 2.0
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][p[order][:-1] == p[order][1:]] = -1
    i = int(np.argmax(f1))
    below = p[order[i + 1]] if i + 1 < len(p) else 0.0
    return float((p[order[i]] + below) / 2)


def featurise(text: str | None, words_known: dict[str, tuple[int, ...]], of=word_features) -> tuple[np.ndarray, tuple[float, ...]]:
    """Sorted distinct features of a whole text and its dense features.

    A feature comes with marks for occurring at least twice, and for making up
    at least the shares ``SHARES`` of the words.
    """
    text = (text or "").lower()
    words = text.split()
    counts = Counter(words)
    for w in counts:
        if w not in words_known:
            words_known[w] = of(w)
    found: dict[int, int] = {}
    for w, n in counts.items():
        for f in words_known[w]:
            found[f] = found.get(f, 0) + n
    out = list(found)
    for f, n in found.items():
        if n > 1:
            out.append(f + BUCKETS)
        for i, share in enumerate(SHARES, 2):
            if n >= share * len(words):
                out.append(f + i * BUCKETS)
    return np.array(sorted(out), np.int64), dense_features(text, words)


def common(rows: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The features that at least ``LEAST_DOCS`` rows hold, and the rows as indexes into them."""
    seen = np.zeros((2 + len(SHARES)) * BUCKETS, np.int32)
    for r in rows:
        seen[r] += 1
    often = seen >= LEAST_DOCS
    index = np.cumsum(often, dtype=np.int32) - 1
    return np.flatnonzero(often), [index[r[often[r]]] for r in rows]


def train(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = CATEGORIES, sample: int = SAMPLE, seed: int = 5) -> Chain:
    """Fit on at most ``sample`` labelled rows; the executors make features and one task fits, the driver gets the chain alone.

    Of documents that share a labelled doc_id one takes part, the one of least
    features, so no more than ``sample`` rows reach that task however often
    an id occurs. Labels with a null, and rows with a null doc_id, take no
    part; a repeated label row counts once.
    """
    known = F.lit(True)
    for c in categories:
        known &= F.col(c).isNotNull()
    rows = labels.where(known).select("doc_id", *categories)
    rows = rows.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id", *categories).limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}
        for batch in slices(batches):
            if len(known) > REMEMBERED // 4:
                known.clear()
            made = [featurise(t, known) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f.astype("<i4").tobytes() for f, _ in made], pa.binary()), pa.array([list(d) for _, d in made], pa.list_(pa.float64())), *batch.columns[2:]],
                names=["doc_id", "features", "dense", *categories],
            )

    schema = "doc_id long, features binary, dense array<double>, " + ", ".join(f"{c} int" for c in categories)
    joined = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id")
    made = joined.select("doc_id", "text", *(F.col(c).cast("int") for c in categories)).mapInArrow(run, schema)
    one = made.groupBy("doc_id", *categories).agg(F.min(F.struct("features", "dense")).alias("least"))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("toxicity fit", dict)
        table = pa.Table.from_batches(batches, pa.schema([("doc_id", pa.int64()), ("features", pa.binary()), ("dense", pa.list_(pa.float64())), *((c, pa.int32()) for c in categories)]))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(_fitted(table, categories, seed))])], names=["chain"])

    got = one.select("doc_id", "least.*", *categories).repartition(1).mapInArrow(fit, "chain binary").first()
    return pickle.loads(got["chain"]) if got else fit_chain([], np.empty((0, N_DENSE)), np.empty((0, len(categories)), np.int32), categories)


def _fitted(table: pa.Table, categories: tuple[str, ...], seed: int) -> Chain:
    """The chain for all rows of ``table`` (doc_id, features, dense, categories), whatever their order."""
    got = table.to_pandas().sort_values(["doc_id", *categories, "features"], ignore_index=True)
    names, features = common([np.frombuffer(b, "<i4") for b in got["features"]])
    dense = np.array(got["dense"].tolist()).reshape(-1, N_DENSE)
    marks = got[list(categories)].to_numpy()
    del got
    mixed = np.random.default_rng(seed).permutation(len(marks))
    chain = fit_chain([features[i] for i in mixed], dense[mixed], marks[mixed], categories)
    for model in chain.models:
        model.kept = names[model.kept]
    return chain


def _probabilities(sent, texts: list[str | None]) -> np.ndarray:
    """One column a category; this worker remembers words with the features the chain uses."""
    name, chain = sent.value
    useful, known = held(("toxicity", name), lambda: ({f % BUCKETS for m in chain.models for f in m.kept.tolist()}, {}))
    if len(known) > REMEMBERED:
        known.clear()
    of = lambda w: tuple(f for f in word_features(w) if f in useful)
    made = [featurise(t, known, of) for t in texts]
    return chain.probabilities([f for f, _ in made], np.array([d for _, d in made]).reshape(-1, N_DENSE))


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """Per row: doc_id, and ``p_`` and 0/1 flag of every category.

    Whole texts count; a null text is an empty one. Repeated rows repeat, an
    empty table gives no rows, other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, chain))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            p = _probabilities(sent, batch.column(1).to_pylist())
            columns, names = [batch.column(0)], ["doc_id"]
            for j, (c, limit) in enumerate(zip(chain_names, sent.value[1].thresholds)):
                columns += [pa.array(p[:, j]), pa.array((p[:, j] >= limit).astype(np.int32))]
                names += [f"p_{c}", c]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    chain_names = chain.categories
    schema = "doc_id long, " + ", ".join(f"p_{c} double, {c} int" for c in chain_names)
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, category: str = "toxic") -> DataFrame:
    """The rows of ``docs``, with all their columns, that the chain does not flag in ``category``."""
    chain = train(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, chain))
    j, text = chain.categories.index(category), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            p = _probabilities(sent, batch.column(text).to_pylist())
            yield batch.filter(pa.array(p[:, j] < sent.value[1].thresholds[j]))

    return docs.mapInArrow(run, docs.schema)
