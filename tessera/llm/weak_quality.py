"""Quality classifier from weak labels.

Heuristic labellers vote good (1), bad (-1) or abstain (0) on every document.  Only the
counts of vote patterns (at most ``3 ** len(LABELLERS)``, whatever the corpus) leave the
executors; expectation-maximisation on them estimates the class prior and each labeller's
vote rates given the class, without any true label.  The patterns' posteriors are the
labels of a hashed linear scorer (logistic regression), which is fitted on a bounded
sample (``max_train`` documents of smallest id hash) and then scores every document.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import mix, prepare, text_slices, words, written

LABELLERS = ("repeats", "capitals", "symbols", "separators", "shouting", "endings", "vocabulary", "sentences", "word_length")
#: shares of words (capitals: of letters) beyond which these labellers vote bad; else they abstain
BOUNDS = {"repeats": 0.10, "capitals": 0.25, "symbols": 0.03, "separators": 0.04, "shouting": 0.03, "endings": 0.04}
MIN_WORDS = 8  # labellers that need a running text abstain on fewer words
DIMS = 1 << 15
MAX_TRAIN = 4_000

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_ALPHA = np.zeros(256, bool)
_ALPHA[65:91] = _ALPHA[97:123] = _ALPHA[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "*#%$&@^~<>{}[]\\=+_|"]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".?!"]] = True


def _sums(flag: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])


def votes(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Votes of the labellers (rows: texts) in the order of ``LABELLERS``."""
    rows = len(off) - 1
    start, end, row, h = words(data, off)
    first = np.searchsorted(row, np.arange(rows + 1))
    n = np.diff(first)
    per = lambda flag: np.diff(_sums(flag)[first])  # noqa: E731  words with the flag, by text
    inside = lambda mask: (lambda c: c[end] - c[start])(_sums(mask[data]) if len(data) else np.zeros(1, np.int64))
    letters, upper, symbols = inside(_ALPHA), inside(_UPPER), inside(_SYMBOL)
    stops = inside(_STOP)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    share = lambda x: x / np.maximum(n, 1)
    chars = np.diff(_sums(letters)[first])
    odd = _SYMBOL[data[end - 1]] if len(end) else np.zeros(0, bool)
    order = np.lexsort((h, row))
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
    distinct = np.diff(_sums(fresh)[first])
    stat = {"repeats": share(per(same)), "capitals": np.diff(_sums(upper)[first]) / np.maximum(chars, 1),
            "symbols": share(per((symbols > 0) & (letters > 0))), "separators": share(per((letters == 0) & (symbols > 0))),
            "shouting": share(per(stops > 1)), "endings": share(per(odd))}
    out = np.zeros((rows, len(LABELLERS)), np.int8)
    for j, name in enumerate(LABELLERS):
        if name in BOUNDS:
            out[:, j] = np.where(stat[name] > BOUNDS[name], -1, 0)
        elif name == "vocabulary":
            ratio = distinct / np.maximum(n, 1) ** 0.85
            out[:, j] = np.where(ratio < 0.45, -1, np.where(ratio > 0.6, 1, 0))
        elif name == "sentences":
            ratio = share(per((_STOP[data[end - 1]] if len(end) else np.zeros(0, bool)) & (stops == 1)))
            out[:, j] = np.where((ratio > 0.02) & (ratio < 0.5), 1, 0)
        else:
            mean = chars / np.maximum(n, 1)
            out[:, j] = np.where((mean < 2) | (mean > 14), -1, np.where((mean > 3) & (mean < 10), 1, 0))
    out[n < MIN_WORDS, :] = 0
    out[n == 0, :] = -1  # nothing to read
    return out


def fit_votes(patterns: np.ndarray, weight: np.ndarray, rounds: int = 200, smooth: float = 1.0):
    """EM of the label model: (prior of good, rates[class, labeller, vote + 1], posterior by pattern).
    Votes are independent given the class.  Most labellers know one kind of junk only, so at the start
    one bad vote outweighs three good ones."""
    p = 1 / (1 + np.exp(-((patterns > 0).sum(1) - 3.0 * (patterns < 0).sum(1) + 0.5)))
    seen = np.stack([patterns == v for v in (-1, 0, 1)], -1).astype(float)
    for _ in range(rounds):
        side = np.stack([(1 - p) * weight, p * weight])
        prior = (side[1].sum() + smooth) / (weight.sum() + 2 * smooth)
        rate = np.einsum("cn,njv->cjv", side, seen) + smooth
        rate /= rate.sum(-1, keepdims=True)
        like = np.einsum("njv,cjv->nc", seen, np.log(rate))
        odds = np.clip(like[:, 1] - like[:, 0] + np.log(prior / (1 - prior)), -30, 30)
        q = 1 / (1 + np.exp(-odds))
        if np.abs(q - p).max(initial=0) < 1e-9:
            break
        p = q
    return prior, rate, p


def features(data: np.ndarray, off: np.ndarray, dims: int = DIMS):
    """Hashed features of each text: (text, index, value), sorted by text and index.  Families:
    lowered words, word shapes, pairs of neighbouring shapes, echoes of the words before; a family's
    values are square roots of shares, so each text has norm 1 in each family."""
    start, end, row, h = words(data, off)
    if not len(h):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0)
    inside = lambda mask: (lambda c: c[end] - c[start])(_sums(mask[data]))
    upper, letters, digits, symbols, stops = (inside(m) for m in (_UPPER, _ALPHA, _DIGIT, _SYMBOL, _STOP))
    last = data[end - 1].astype(np.int64)
    tail = np.where(_ALPHA[data[end - 1]], 0, last)
    shape = (np.minimum(upper, 2) + 3 * ((upper > 1) & (2 * upper >= letters)) + 6 * np.minimum(digits, 1) + 12 * np.minimum(symbols, 3)
             + 48 * np.minimum(stops, 2) + 144 * (letters == 0) + 288 * np.minimum((end - start) // 6, 3)) * 256 + tail
    echo = np.zeros(len(h), np.int64)
    for gap in (2, 1):
        echo[gap:] = np.where((h[gap:] == h[:-gap]) & (row[gap:] == row[:-gap]), gap, echo[gap:])
    pair = np.zeros(len(h), np.int64)
    pair[1:] = np.where(row[1:] == row[:-1], shape[:-1] * 1_000_003, 0)
    parts = [h, mix(shape.astype(np.uint64) + np.uint64(1 << 40)), mix((pair + shape).astype(np.uint64) + np.uint64(1 << 50)),
             mix(echo.astype(np.uint64) + np.uint64(1 << 60))]
    rows, index, value = [], [], []
    n = np.bincount(row, minlength=len(off) - 1)
    for f, x in enumerate(parts):
        key = row * dims + (mix(x + np.uint64(f)) % np.uint64(dims)).astype(np.int64)
        key, count = np.unique(key, return_counts=True)
        rows.append(key // dims)
        index.append(key % dims)
        value.append(np.sqrt(count / n[key // dims]))
    return np.concatenate(rows), np.concatenate(index), np.concatenate(value)


def fit_scorer(row, index, value, target, dims: int = DIMS, rounds: int = 80, ridge: float = 1e-3, rate: float = 0.3):
    """Logistic regression on soft targets by full-batch AdaGrad; the last weight is the bias."""
    w, g2 = np.zeros(dims + 1), np.full(dims + 1, 1e-8)
    n = len(target)
    for _ in range(rounds):
        z = np.bincount(row, weights=value * w[index], minlength=n) + w[dims]
        d = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        grad = np.bincount(index, weights=value * d[row], minlength=dims + 1)
        grad[dims] = d.sum()
        grad = grad / n + ridge * w
        g2 += grad * grad
        w -= rate * grad / np.sqrt(g2)
    return w


def _vote_rows(batches):
    for batch in batches:
        for sub, data, off in text_slices(batch):
            code = (votes(data, off).astype(np.int64) + 1) @ (3 ** np.arange(len(LABELLERS)))
            yield pa.RecordBatch.from_arrays([sub.column(0), pa.array(code)], ["doc_id", "pattern"])


def _feature_rows(batches):
    for batch in batches:
        for sub, data, off in text_slices(batch):
            row, index, value = features(data, off)
            order = np.argsort(row, kind="stable")
            at = np.searchsorted(row[order], np.arange(len(off)))
            pack = lambda x, kind: pa.array([x[order][a:b].astype(kind).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([sub.column(2), pack(index, np.int32), pack(value, np.float32)],
                                             ["target", "index", "value"])


def _train(frames):
    frames = [f for f in frames if len(f)]
    if not frames:
        yield pd.DataFrame({"weights": [np.zeros(DIMS + 1).tobytes()]})
        return
    rows = pd.concat(frames, ignore_index=True)
    index = [np.frombuffer(x, np.int32) for x in rows["index"]]
    value = [np.frombuffer(x, np.float32) for x in rows["value"]]
    row = np.repeat(np.arange(len(rows)), [len(x) for x in index])
    w = fit_scorer(row, np.concatenate(index), np.concatenate(value).astype(float), rows["target"].to_numpy())
    yield pd.DataFrame({"weights": [w.tobytes()]})


def _score_rows(weights, posterior, keep_from):
    def run(batches):
        w, post = weights.value, posterior.value
        for batch in batches:
            for sub, data, off in text_slices(batch):
                row, index, value = features(data, off)
                z = np.bincount(row, weights=value * w[index], minlength=len(off) - 1) + w[DIMS]
                empty = np.diff(np.searchsorted(np.unique(row), np.arange(len(off)))) == 0
                score = np.where(empty, 0.0, 1 / (1 + np.exp(-np.clip(z, -30, 30))))
                code = (votes(data, off).astype(np.int64) + 1) @ (3 ** np.arange(len(LABELLERS)))
                p = post[code]
                yield pa.RecordBatch.from_arrays([*sub.columns[2:], pa.array(score), pa.array(p), pa.array(score >= keep_from)],
                                                 [*sub.schema.names[2:], "_score", "_posterior", "_keep"])
    return run


class LabelModel:
    """Fitted parts: ``prior``, ``rates`` (class, labeller, vote), ``posterior`` by pattern code, ``weights``."""

    def __init__(self, prior, rates, posterior, weights):
        self.prior, self.rates, self.posterior, self.weights = prior, rates, posterior, weights

    def accuracies(self) -> dict[str, float]:
        """Estimated share of right votes among the votes each labeller casts."""
        right = self.prior * self.rates[1, :, 2] + (1 - self.prior) * self.rates[0, :, 0]
        cast = self.prior * (1 - self.rates[1, :, 1]) + (1 - self.prior) * (1 - self.rates[0, :, 1])
        return dict(zip(LABELLERS, (right / np.maximum(cast, 1e-12)).tolist(), strict=True))


def fit(docs: DataFrame, max_train: int = MAX_TRAIN) -> LabelModel:
    """Fit the label model on all documents and the scorer on ``max_train`` of them."""
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    voted = written(docs.mapInArrow(_vote_rows, "doc_id bigint, pattern bigint"))
    counts = voted.groupBy("pattern").count().toPandas()  # at most 3^9 rows
    code = counts["pattern"].to_numpy(np.int64)
    patterns = (code[:, None] // 3 ** np.arange(len(LABELLERS))) % 3 - 1
    prior, rates, p = fit_votes(patterns, counts["count"].to_numpy(float))
    posterior = np.full(3 ** len(LABELLERS), prior)
    posterior[code] = p
    by_pattern = spark.createDataFrame(pd.DataFrame({"pattern": code, "target": p}), "pattern bigint, target double")
    sample = (voted.where("doc_id is not null").join(F.broadcast(by_pattern), "pattern")
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train).select(F.col("doc_id").alias("_id"), "target"))
    sample = written(sample.dropDuplicates(["_id"]))
    chosen = docs.join(F.broadcast(sample), docs.doc_id == sample._id).select("doc_id", "text", "target")  # <= max_train ids
    rows = chosen.mapInArrow(_feature_rows, "target double, index binary, value binary")
    raw = rows.repartition(1).mapInPandas(_train, "weights binary").first()
    return LabelModel(prior, rates, posterior, np.frombuffer(raw[0], np.float64))


def score(docs: DataFrame, model: LabelModel, keep_from: float = 0.5) -> DataFrame:
    """``docs`` with ``_score`` (probability of good quality by the scorer), ``_posterior`` (of the
    label model) and ``_keep``.  All columns of ``docs`` stay, whatever their names."""
    spark = docs.sparkSession
    prepare(spark)
    sc = spark.sparkContext
    weights, posterior = sc.broadcast(model.weights), sc.broadcast(model.posterior)  # fixed sizes
    cols = docs.columns
    names = [f"c{i}" for i in range(len(cols))]
    plain = docs.toDF(*names)
    inner = plain.select(F.lit(0).alias("_"), F.col(names[cols.index("text")]).alias("text"), *names)
    schema = ", ".join(f"{n} {t}" for n, t in plain.dtypes) + ", _score double, _posterior double, _keep boolean"
    return inner.mapInArrow(_score_rows(weights, posterior, keep_from), schema).toDF(*cols, "_score", "_posterior", "_keep")


def quality(docs: DataFrame, max_train: int = MAX_TRAIN, keep_from: float = 0.5) -> DataFrame:
    """(doc_id, score, posterior, keep) of every document.

    Null, empty or blank texts score 0 and are not kept; repeated rows give a row each; a null
    doc_id is scored like any other; an empty table gives an empty result; other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    scored = score(docs, fit(docs, max_train), keep_from)
    return scored.select("doc_id", F.col("_score").alias("score"), F.col("_posterior").alias("posterior"), F.col("_keep").alias("keep"))
