"""Removal of repeated byte strings by a distributed difference cover of the suffixes.

A byte is removed if a string of ``LENGTH`` bytes covers it that also starts earlier in the
corpus.  As in difference-cover suffix sorting, a sample of positions is treated first and
the remaining suffixes are reduced to it: the sample has a position inside every string of
``LENGTH`` bytes, and the same one wherever the string occurs.  Here the sample is chosen
by content (in each string the ``GRAM``-byte gram of smallest hash, the leftmost of equal
ones), not by position modulo 3, so it holds one position in about 35 and two occurrences
always share it without a shift.

1. Sampled grams are named by their hashes; those that occur once in the corpus drop out,
   with all strings whose sample they are.
2. All strings with the same sampled position form one run of text.  Runs are named by gram
   and whole content; a run that occurs earlier is removed whole.
3. What remains is the first occurrence of each run whose gram occurs in other runs too.
   Only there are the single suffixes named (by their first ``LENGTH`` bytes).  They meet by
   gram, as equal ones share it, or, of grams with more than ``KINDS`` different runs, by
   their own names; of equal names the later positions are removed.

Names are 64-bit hashes (equality is all that is asked of them), so no ranks are
redistributed and no recursion is needed.  Sorted names are read as streams: a name that
holds a third of all rows takes no memory.  Of the candidates of steps 2 and 3 the tasks
learn by bit filters of fixed size, whose false hits only add rows to compare.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bit_filter, free_shuffles, hash_runs, in_filter, mix, prepare, rolling, text_slices, written

LENGTH, GRAM = 100, 32
KINDS = 2_000
LATER, FIRST, FREQUENT = 0, 1, 2
NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every window of ``w`` values (block prefix and suffix minima)."""
    n = len(x)
    a = np.full(-(-n // w) * w, NEVER)
    a[:n] = x
    a = a.reshape(-1, w)
    before = np.minimum.accumulate(a, axis=1).ravel()
    after = np.minimum.accumulate(a[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n - w + 1], before[w - 1:n])


def runs(data: np.ndarray, off: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Runs of string starts with one sampled position: (text, first start, last start, sample, gram name)."""
    n = len(data)
    z = np.zeros(0, np.int64)
    if n < length:
        return z, z, z, z, z
    x = rolling(data, gram)
    key = x & np.uint64(0xFFFFFFFF00000000)
    key |= np.arange(len(x), dtype=np.uint64)  # the leftmost of equal ones
    least = sliding_min(key, length - gram + 1)
    new = np.ones(len(least), bool)
    np.not_equal(least[1:], least[:-1], out=new[1:])
    new[off[off < len(new)]] = True
    first = np.flatnonzero(new)
    text = np.searchsorted(off, first, "right") - 1
    last = np.minimum(np.append(first[1:], len(least)) - 1, off[text + 1] - length)  # strings never cross texts
    whole = last >= first
    first, last, text = first[whole], last[whole], text[whole]
    sample = (least[first] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return text, first, last, sample, mix(x[sample]).view(np.int64)


def _run_id(doc: np.ndarray, mark: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Name of a run as an occurrence: its document (id and content mark) and place."""
    return mix(mix(doc.view(np.uint64) + np.uint64(1)) ^ mark.view(np.uint64) ^ mix(place.astype(np.uint64))).view(np.int64)


def _slices(batch):
    """(document ids, marks, bytes, offsets) of the rows of a batch (doc_id, mark, text)."""
    for sub, data, off in text_slices(batch):
        yield sub.column(0).to_numpy(), sub.column(1).to_numpy(), data, off


def _grams(length, gram):
    def run(batches):
        for batch in batches:
            for _, _, data, off in _slices(batch):
                name = runs(data, off, length, gram)[4]
                name, n = np.unique(name, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(n)], ["gram", "n"])
    return run


def _candidates(length, gram, repeated):
    def run(batches):
        for batch in batches:
            for doc, mark, data, off in _slices(batch):
                text, first, last, sample, name = runs(data, off, length, gram)
                hit = in_filter(repeated.value, name)
                text, first, last, sample, name = text[hit], first[hit], last[hit], sample[hit], name[hit]
                whole = mix(hash_runs(data, first, last + length) ^ mix((sample - first).astype(np.uint64))).view(np.int64)
                d, a = doc[text], first - off[text]
                sure = _surely_later(name, whole, d, a)
                # those need no meeting by gram, so they are dealt out evenly
                key = np.where(sure, _run_id(d, mark[text], a), name)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, whole, d, mark[text], a, last + length - off[text], sure)],
                                                 ["gram", "whole", "doc_id", "mark", "a", "b", "sure"])
    return run


def _surely_later(name, whole, doc, a) -> np.ndarray:
    """Runs that an earlier position among these has in whole: of equal runs that a task meets together (copies,
    periodic texts) only the earliest has to be compared with other tasks'."""
    order = np.lexsort((a, doc, whole, name))
    head = np.ones(len(order), bool)
    head[1:] = (name[order][1:] != name[order][:-1]) | (whole[order][1:] != whole[order][:-1])
    first = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    sure = np.zeros(len(order), bool)
    sure[order] = (doc[order] != doc[first]) | (a[order] != a[first])
    return sure


def _suffixes(length, gram, mixed, frequent):
    """Names of the suffixes of the runs in the filter ``mixed``: a row (key, doc_id, mark, a, names) for each run,
    its key the gram; of frequent grams a row for each suffix, its key the name."""
    def run(batches):
        for batch in batches:
            for doc, mark, data, off in _slices(batch):
                text, first, last, _, name = runs(data, off, length, gram)
                hit = in_filter(mixed.value, _run_id(doc[text], mark[text], first - off[text]))
                text, first, last, name = text[hit], first[hit], last[hit], name[hit]
                if not len(first):
                    continue
                n = last - first + 1
                at = np.concatenate([[0], np.cumsum(n)])
                start = np.repeat(first - at[:-1], n) + np.arange(at[-1])
                suffix = hash_runs(data, start, start + length).view(np.int64)
                apart = in_filter(frequent.value, name)
                whole = np.flatnonzero(~apart)
                raw = [suffix[at[i]:at[i + 1]].tobytes() for i in whole]
                yield _suffix_rows(name[whole], doc[text[whole]], mark[text[whole]], (first - off[text])[whole], raw)
                single = np.flatnonzero(np.repeat(apart, n))
                if len(single):
                    t = np.repeat(text, n)[single]
                    yield _suffix_rows(suffix[single], doc[t], mark[t], start[single] - off[t], [x.tobytes() for x in suffix[single]])
    return run


def _suffix_rows(key, doc, mark, a, names):
    return pa.RecordBatch.from_arrays([*(pa.array(x) for x in (key, doc, mark, a)), pa.array(names, pa.binary())], ["key", "doc_id", "mark", "a", "names"])


def _later(length):
    """Of rows (key, doc_id, mark, a, names) sorted by (key, doc_id, a): intervals of the suffixes whose name an
    earlier position of the key has.  Holds the names of one key: at most those of ``KINDS`` runs, or one."""
    def run(frames):
        key, first = None, {}
        for f in frames:
            out = []
            for k, d, m, a, raw in f.itertuples(index=False):
                if k != key:
                    key, first = k, {}
                end = None
                for i, x in enumerate(np.frombuffer(raw, np.int64).tolist(), a):
                    if first.setdefault(x, (d, i)) != (d, i):
                        if end != i - 1 + length:
                            out.append([d, m, i, i])
                        out[-1][3] = end = i + length
            yield pd.DataFrame(out, columns=["doc_id", "mark", "a", "b"], dtype=np.int64)
    return run


def _compared(frames):
    """Of candidate runs sorted by (gram, whole, doc_id, a), as a stream: rows (what, gram, doc_id, mark, a, b).
    LATER: a run that an earlier position has in whole.  FIRST: the first of each kind of run, of grams with several
    kinds.  FREQUENT: a gram with more than ``KINDS`` kinds."""
    gram = whole = None
    at, kinds, held = (0, 0), 0, None
    for f in frames:
        out = []
        for g, w, d, m, a, b, sure in f.itertuples(index=False):
            if sure:
                out.append((LATER, None, d, m, a, b))
                continue
            if g != gram:
                gram, whole, kinds = g, None, 0
            if w != whole:
                whole, at, kinds = w, (d, a), kinds + 1
                if kinds == 1:
                    held = (FIRST, g, d, m, a, b)
                    continue
                if kinds == 2:
                    out.append(held)
                out.append((FIRST, g, d, m, a, b))
                if kinds == KINDS + 1:
                    out.append((FREQUENT, g, 0, 0, 0, 0))
            elif (d, a) != at:
                out.append((LATER, None, d, m, a, b))
        yield pd.DataFrame(out, columns=["what", "gram", "doc_id", "mark", "a", "b"]).astype({"gram": "Int64"})


def _merged(frames):
    """Of intervals sorted by (doc_id, mark, a): one row of merged intervals for each document, as a stream."""
    doc, out = None, []

    def row():
        return pd.DataFrame({"_doc": [doc[0]], "_mark": [doc[1]], "spans": [np.array(out, np.int64).tobytes()]})

    for f in frames:
        for d, m, a, b in f[["doc_id", "mark", "a", "b"]].itertuples(index=False):
            if (d, m) != doc:
                if doc is not None:
                    yield row()
                doc, out = (d, m), []
            if out and a <= out[-1]:
                out[-1] = max(out[-1], b)
            else:
                out += [a, b]
    if doc is not None:
        yield row()


def _kept(batches):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) from (doc_id, text, spans)."""
    for batch in batches:
        out = []
        for doc, text, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            text = (text or "").encode()
            spans = np.frombuffer(raw or b"", np.int64).reshape(-1, 2).tolist()
            sha, at = hashlib.sha256(), 0
            for a, b in spans:
                sha.update(text[at:a])
                at = b
            sha.update(text[at:])
            out.append((doc, len(text), sum(b - a for a, b in spans), len(spans), sha.hexdigest()))
        cols = zip(*out, strict=True) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)],
                                         ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, mark, a, b): byte intervals of the strings that start earlier too, as found (they may overlap).
    ``docs`` has doc_id, mark (a hash of the text, to tell rows of one id apart) and text."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.where("doc_id is not null")
    repeated = docs.mapInArrow(_grams(length, gram), "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1")
    grams = spark.sparkContext.broadcast(bit_filter(repeated, "gram"))
    found = docs.mapInArrow(_candidates(length, gram, grams), "gram bigint, whole bigint, doc_id bigint, mark bigint, a bigint, b bigint, sure boolean")
    found = written(found.repartition(n, "gram").sortWithinPartitions("gram", "whole", "doc_id", "a")
                    .mapInPandas(_compared, "what int, gram bigint, doc_id bigint, mark bigint, a bigint, b bigint"))
    free_shuffles(spark)
    later = found.where(F.col("what") == LATER).select("doc_id", "mark", "a", "b")
    mixed = found.where(F.col("what") == FIRST).select(_run_column().alias("id"))
    runs_left = spark.sparkContext.broadcast(bit_filter(mixed, "id"))
    frequent = spark.sparkContext.broadcast(bit_filter(found.where(F.col("what") == FREQUENT), "gram"))
    single = docs.mapInArrow(_suffixes(length, gram, runs_left, frequent), "key bigint, doc_id bigint, mark bigint, a bigint, names binary")
    single = (single.repartition(n, "key").sortWithinPartitions("key", "doc_id", "a")
              .mapInPandas(_later(length), "doc_id bigint, mark bigint, a bigint, b bigint"))
    return later.unionByName(single)


def _run_column():
    @F.pandas_udf("bigint")
    def name(doc: pd.Series, mark: pd.Series, place: pd.Series) -> pd.Series:
        return pd.Series(_run_id(doc.to_numpy(np.int64), mark.to_numpy(np.int64), place.to_numpy(np.int64)))
    return name(F.col("doc_id"), F.col("mark"), F.col("a"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document row.

    Texts are UTF-8 bytes, null as empty; texts under ``length`` bytes lose nothing.  Repeated rows of one id
    start at equal positions, so none is earlier than the other; rows of null id are left whole and are no
    earlier occurrence; other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    again = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    # the mark tells rows of one id apart; without such rows it would only be moved about
    docs = docs.withColumn("mark", F.lit(0).cast("bigint") if again.isEmpty() else F.xxhash64("text")).select("doc_id", "mark", "text")
    spans = written(repeated_spans(docs, length, gram).repartition(n, "doc_id", "mark").sortWithinPartitions("doc_id", "mark", "a")
                    .mapInPandas(_merged, "_doc bigint, _mark bigint, spans binary"))
    free_shuffles(spark)
    both = docs.join(spans, (docs.doc_id == spans._doc) & (docs.mark == spans._mark), "left")
    return both.select("doc_id", "text", "spans").mapInArrow(_kept, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
