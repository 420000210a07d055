"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into passages of ``PASSAGE`` words (step ``PASSAGE // 2``) and
weighted by TF-IDF over hashed words, the inverse document frequencies counted over all
documents.  Passages are searched in groups of at most ``RANK``.  A randomised SVD of a
group's matrix (Gaussian range finder, one power step; sums over passages are made where
the passages lie) gives its latent basis, of as many directions as the group has, so that
no passage loses a part of itself however large the benchmark is.  Every window of ``PASSAGE`` words (step ``STEP``) of every document is projected on it and
compared with all passages: the product of the window's TF-IDF vector and a passage's image
in the latent space, divided by the shorter of the window and the passage (by the window
it is their cosine; by the passage, the share of it that the window holds, which the
window's other words do not lessen).  Of two neighbouring windows that hold a verbatim copy
of a passage of any length, one holds half its weight and is a candidate.  A candidate's surroundings are then compared with
the whole item by longest common subsequence of words; between ``PARAPHRASE`` and
``COPY`` of the item's length, the item's answer (its last sentence) must be there too.

A product is a sum over the window's words, so each word's largest part in any passage
bounds it; windows that cannot reach ``COSINE`` by that bound are not projected.  Documents are read twice (frequencies,
search) and never shuffled.  Items are read in blocks of ``block`` items and searched in
broadcasts of at most ``AT_ONCE`` passages (more only for a single longer item).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import hash_runs, prepare, text_slices

BUCKETS = 1 << 18
CHUNK = 1 << 12
PASSAGE, STEP = 32, 16
RANK, OVERSAMPLE = 256, 16
AT_ONCE = 16 * RANK
COSINE = 0.42
COPY, PARAPHRASE, ANSWER = 0.8, 0.55, 0.8
MIN_WORDS = 6
SLACK = 12

_CUT = np.ones(256, bool)  # ASCII other than letters and digits separates words
_CUT[48:58] = _CUT[65:91] = _CUT[97:123] = _CUT[128:] = False
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?\n"]] = True


def terms(data: np.ndarray, off: np.ndarray):
    """Words of letters and digits (already lowered text): (starts, ends, row, hash)."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64)
    word = ~_CUT[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before, after = edge[:-1].copy(), edge[1:].copy()
    before[1:] |= ~word[:-1]
    after[:-1] |= ~word[1:]
    starts, ends = np.flatnonzero(word & before), np.flatnonzero(word & after) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1, hash_runs(data, starts, ends)


def _lowered(batch):
    i = batch.schema.get_field_index("text")
    return batch.set_column(i, "text", pc.utf8_lower(batch.column(i).cast(pa.large_string())))


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(46)).astype(np.int64)


def _frequencies(batches):
    """Document frequencies of the word buckets, as one row for each chunk of buckets."""
    total, n = np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        for _, data, off in text_slices(_lowered(batch)):
            _, _, row, h = terms(data, off)
            cell = np.unique(row * BUCKETS + _bucket(h))
            total += np.bincount(cell % BUCKETS, minlength=BUCKETS)
            n += len(off) - 1
    parts = total.reshape(-1, CHUNK)
    used = parts.any(1)
    used[0] = True
    yield pd.DataFrame({"chunk": np.flatnonzero(used), "n": np.where(np.flatnonzero(used) == 0, n, 0),
                        "counts": [x.tobytes() for x in parts[used]]})


def _sum_chunks(key, rows):
    total = np.sum([np.frombuffer(x, np.int64) for x in rows["counts"]], axis=0)
    return pd.DataFrame({"chunk": [key[0]], "n": [rows["n"].sum()], "counts": [total.tobytes()]})


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """log((n + 1) / (df + 1)) + 0.1 by word bucket, over all documents (an array of fixed size)."""
    schema = "chunk bigint, n bigint, counts binary"
    parts = docs.select("text").mapInArrow(_arrow(_frequencies), schema).groupBy("chunk").applyInPandas(_sum_chunks, schema)
    df, n = np.zeros(BUCKETS, np.int64), 0
    for r in parts.toLocalIterator():
        df[r["chunk"] * CHUNK:(r["chunk"] + 1) * CHUNK] = np.frombuffer(r["counts"], np.int64)
        n += r["n"]
    return (np.log((n + 1) / (df + 1)) + 0.1).astype(np.float32)


def _arrow(f):
    def run(batches):
        for frame in f(batches):
            yield pa.RecordBatch.from_pandas(frame, preserve_index=False)
    return run


def cut_items(items: pd.DataFrame):
    """Words, answers and passages of benchmark items: ([hashes], [answer hashes], [(item, offset)])."""
    text = pa.RecordBatch.from_arrays([pa.array(items["text"], pa.string())], ["text"])
    lists, answers, passages = [], [], []
    for _, data, off in text_slices(_lowered(text)):
        starts, ends, row, h = terms(data, off)
        first = np.searchsorted(row, np.arange(len(off)))
        stops = np.concatenate([[0], np.cumsum(_STOP[data])]) if len(data) else np.zeros(1, np.int64)
        for a, b in zip(first[:-1], first[1:], strict=True):
            tail = b
            while tail > a and stops[starts[tail - 1]] == stops[starts[b - 1]] and b - tail < 8:
                tail -= 1  # the last sentence, of eight words at most
            i = len(lists)
            lists.append(h[a:b])
            answers.append(h[tail:b])
            if b - a >= MIN_WORDS:
                passages += [(i, o) for o in range(0, max(1, b - a - PASSAGE // 2), PASSAGE // 2)]
    return lists, answers, passages


def _entries(lists, passages, idf):
    """TF-IDF rows of unit length, one (bucket, weight) pair of arrays for each passage, and their lengths before."""
    out, norms = [], []
    for i, o in passages:
        bucket, tf = np.unique(_bucket(lists[i][o:o + PASSAGE]), return_counts=True)
        w = tf * idf[bucket]
        norms.append(np.linalg.norm(w))
        out.append((bucket, w / norms[-1]))
    return out, np.array(norms, np.float32)


def _project(basis_of, basis, frames):
    """Of each partition's passages X: its part of X^T X B, as (bucket, vector) rows."""
    part: dict[int, np.ndarray] = {}
    for rows in frames:
        for bucket, weight in zip(rows["bucket"], rows["weight"], strict=True):
            y = np.asarray(weight) @ basis[basis_of[np.asarray(bucket)]]
            for b, w in zip(bucket, weight, strict=True):
                part[b] = part.get(b, 0) + w * y
    if part:
        yield pd.DataFrame({"bucket": list(part), "vec": [v.astype(float).tobytes() for v in part.values()]})


def _sum_vectors(rows: pd.DataFrame) -> pd.DataFrame:
    total: dict[int, np.ndarray] = {}
    for bucket, raw in zip(rows["bucket"], rows["vec"], strict=True):
        total[bucket] = total.get(bucket, 0) + np.frombuffer(raw)
    return pd.DataFrame({"bucket": list(total), "vec": [v.tobytes() for v in total.values()]})


def latent_basis(spark, entries, rank: int = RANK, power: int = 1):
    """Right singular vectors of the passage rows by a randomised SVD: (bucket -> row, matrix).

    Range finder B = (X^T X)^(power + 1) Omega with orthonormalisation between steps; the sums
    X^T (X B) are made by Spark over the passages.  The basis has at most BUCKETS rows.
    """
    vocab = np.unique(np.concatenate([b for b, _ in entries]))
    basis_of = np.full(BUCKETS, -1, np.int32)
    basis_of[vocab] = np.arange(len(vocab))
    width = min(rank + OVERSAMPLE, len(vocab), len(entries))
    basis = np.random.default_rng(20).standard_normal((len(vocab), width))
    rows = spark.createDataFrame(pd.DataFrame({"bucket": [b.tolist() for b, _ in entries], "weight": [w.tolist() for _, w in entries]}),
                                 "bucket array<bigint>, weight array<double>").repartition(min(64, 1 + len(entries) // 256))

    def step(basis):
        sent = spark.sparkContext.broadcast((basis_of, basis))
        part = rows.mapInPandas(lambda frames: _project(*sent.value, frames), "bucket bigint, vec binary")
        sums = part.groupBy(F.pmod("bucket", F.lit(64))).applyInPandas(_sum_vectors, "bucket bigint, vec binary").toArrow()  # a row a basis row
        out = np.zeros_like(basis)
        for bucket, raw in zip(sums.column(0).to_pylist(), sums.column(1).to_pylist(), strict=True):
            out[basis_of[bucket]] = np.frombuffer(raw)
        return out

    for _ in range(power + 1):
        basis, _ = np.linalg.qr(step(basis))
    gram = basis.T @ step(basis)  # (X Q)^T (X Q): its eigenvectors turn Q into singular vectors
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    best = np.argsort(values)[::-1][:rank]
    return basis_of, (basis @ vectors[:, best[values[best] > 1e-12]]).astype(np.float32)


class Group:
    """At most ``RANK`` passages, as (item, offset), and their basis."""

    def __init__(self, passages, basis_of, basis, entries, norms):
        self.passages, self.basis_of, self.basis, self.norms = passages, basis_of, basis, norms
        p = np.stack([w.astype(np.float32) @ basis[basis_of[b]] for b, w in entries])
        self.latent = p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-9)
        parts = [np.abs(basis[a:a + 4096] @ self.latent.T) for a in range(0, len(basis), 4096)]
        # a word's largest part in any passage, and of any passage's length; both end with the 0 of words that no item has
        self.most, self.most_share = (np.concatenate([x.max(1) for x in y] + [[0.0]]) for y in (parts, [x / norms for x in parts]))


class Index:
    """What a search task needs of one block of items."""

    def __init__(self, spark, ids, lists, answers, passages, idf):
        self.ids, self.lists, self.answers, self.idf = ids, lists, answers, idf
        self.sets = [frozenset(x.tolist()) for x in lists]
        self.groups = []
        for part in np.array_split(np.array(passages), -(-len(passages) // RANK)):
            entries, norms = _entries(lists, part.tolist(), idf)
            self.groups.append(Group(part.tolist(), *latent_basis(spark, entries), entries, norms))


def common_length(a, b) -> int:
    """Length of the longest common subsequence, with one bit for each element of ``a``."""
    place: dict = {}
    for i, x in enumerate(a):
        place[x] = place.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    free = full
    for y in b:
        hit = free & place.get(y, 0)
        free = ((free + hit) | (free - hit)) & full
    return len(a) - free.bit_count()


def judge(item, answer, words) -> tuple[float, bool, bool]:
    """(share of the item's words in common order, answer found in a paraphrase, leaked)."""
    ratio = common_length(item, words) / len(item)
    found = ratio >= PARAPHRASE and len(answer) > 0 and common_length(answer, words) >= ANSWER * len(answer)
    return ratio, found, ratio >= COPY or found


def search(data: np.ndarray, off: np.ndarray, index: Index):
    """Leaks in the texts: (text, item, cosine, common share, answer found), at most one for each text and item."""
    _, _, row, h = terms(data, off)
    if not len(h):
        return []
    bucket = _bucket(h)
    weight = index.idf[bucket]
    total = np.concatenate([[0], np.cumsum(weight.astype(np.float64) ** 2)])
    first = np.searchsorted(row, np.arange(len(off)))
    n = np.diff(first)
    count = np.where(n >= MIN_WORDS, np.maximum(1, -(-(n - PASSAGE) // STEP) + 1), 0)
    text = np.repeat(np.arange(len(n)), count)
    begin = first[text] + STEP * (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count))
    end = np.minimum(begin + PASSAGE, first[text + 1])
    begin = np.maximum(np.minimum(begin, end - PASSAGE), first[text])
    best: dict[tuple[int, int], tuple] = {}
    for group in index.groups:
        _search_group(h, bucket, weight, total, first, text, begin, end, index, group, best)
    return [(t, i, *x) for (t, i), x in sorted(best.items())]


def _search_group(h, bucket, weight, total, first, text, begin, end, index: Index, group: Group, best: dict):
    """Adds to ``best``, by (text, item), what the windows have of a group's items."""
    at = group.basis_of[bucket]
    bound, share = (np.concatenate([[0], np.cumsum(weight * x[at])]) for x in (group.most, group.most_share))
    near = (bound[end] - bound[begin] >= COSINE * np.sqrt(total[end] - total[begin])) | (share[end] - share[begin] >= COSINE)
    text, begin, end = text[near], begin[near], end[near]
    for a in range(0, len(begin), 2048):
        lo, hi, t = begin[a:a + 2048], end[a:a + 2048], text[a:a + 2048]
        grid = np.minimum(lo[:, None] + np.arange(PASSAGE)[None, :], len(h) - 1)
        inside = (lo[:, None] + np.arange(PASSAGE)[None, :] < hi[:, None]) & (at[grid] >= 0)
        flat, who = grid[inside], np.nonzero(inside)[0]
        z = np.zeros((len(lo), group.basis.shape[1]), np.float32)
        starts = np.searchsorted(who, np.arange(len(lo)))
        some = np.flatnonzero(np.diff(np.append(starts, len(who))))
        z[some] = np.add.reduceat(group.basis[at[flat]] * weight[flat, None], starts[some], axis=0) if len(some) else 0
        product, norm = z @ group.latent.T, np.sqrt(total[hi] - total[lo])
        for w, p in zip(*np.nonzero(product >= COSINE * np.minimum(norm[:, None], group.norms)), strict=True):
            item, o = group.passages[p]
            key = (int(t[w]), item)
            words, answer = index.lists[item], index.answers[item]
            known_leak = best.get(key)
            if known_leak and known_leak[1] >= COPY:
                continue
            a0 = max(int(lo[w]) - o - SLACK, int(first[t[w]]))
            b0 = min(int(lo[w]) - o + len(words) + PASSAGE + SLACK, int(first[t[w] + 1]))
            own = index.sets[item]
            around = [x for x in h[a0:b0].tolist() if x in own]
            if len(around) < PARAPHRASE * len(words):
                continue
            ratio, found, leak = judge(words.tolist(), answer.tolist(), around)
            if leak and (not known_leak or ratio > known_leak[1]):
                best[key] = (float(product[w, p] / norm[w]), ratio, found)


def indexes(benchmark: DataFrame, docs: DataFrame, block: int = 5_000):
    """The search indexes of the benchmark: of each ``block`` items by id, one for each ``AT_ONCE`` passages."""
    spark = docs.sparkSession
    idf = inverse_frequencies(docs)
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    blocks = max(1, -(-items.count() // block))
    for i in range(blocks):
        part = (items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i) if blocks > 1 else items).toPandas()
        part = part.sort_values(["item_id", "text"]).drop_duplicates()
        lists, answers, passages = cut_items(part)
        count = np.bincount([i for i, _ in passages], minlength=len(lists))
        a = 0
        while a < len(lists):  # an item's passages stay together
            b = max(a + 1, a + int(np.searchsorted(np.cumsum(count[a:]), AT_ONCE, "right")))
            own = [(i - a, o) for i, o in passages if a <= i < b]
            if own:
                yield Index(spark, part["item_id"].tolist()[a:b], lists[a:b], answers[a:b], own, idf)
            a = b


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows (doc_id, item_id, cosine, common, answer_found), one for each document row and item that it leaks.

    Null and short texts (under ``MIN_WORDS`` words, in documents or items) leak nothing; items of null id
    are ignored; repeated document rows give repeated rows; other columns are ignored; an empty
    table on either side gives an empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    schema = "doc_id bigint, item_id bigint, cosine double, common double, answer_found boolean"
    out = spark.createDataFrame([], schema)
    for index in indexes(benchmark, docs):
        sent = spark.sparkContext.broadcast(index)

        def run(batches, sent=sent):
            for batch in batches:
                for sub, data, off in text_slices(_lowered(batch)):
                    found = search(data, off, sent.value)
                    if found:
                        t, i, c, r, f = zip(*found, strict=True)
                        yield pa.RecordBatch.from_arrays([sub.column(0).take(pa.array(t)), pa.array([sent.value.ids[x] for x in i], pa.int64()),
                                                          pa.array(c), pa.array(r), pa.array(f)],
                                                         ["doc_id", "item_id", "cosine", "common", "answer_found"])
        out = out.unionByName(docs.mapInArrow(run, schema))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that leak an item; all columns stay, in place, without a shuffle."""
    spark = docs.sparkSession
    prepare(spark)
    cols = docs.columns
    names = [f"c{i}" for i in range(len(cols))]
    kinds = [t for _, t in docs.dtypes]
    text = names[cols.index("text")]
    for index in indexes(benchmark, docs):
        sent = spark.sparkContext.broadcast(index)

        def run(batches, sent=sent):
            for batch in batches:
                for sub, data, off in text_slices(_lowered(batch)):
                    clean = np.ones(len(off) - 1, bool)
                    clean[[x[0] for x in search(data, off, sent.value)]] = False
                    kept = pa.RecordBatch.from_arrays(sub.columns[1:], sub.schema.names[1:])
                    yield kept.filter(pa.array(clean))
        plain = docs.toDF(*names).select(F.col(text).alias("text"), *names)
        docs = plain.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in zip(names, kinds, strict=True))).toDF(*cols)
    return docs
