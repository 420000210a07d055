"""Spelling variants: words at one edit from each other, found by FM-index search schemes.

The vocabulary is cut into blocks of at most ``BLOCK_LETTERS`` letters.  A block is indexed as one
text in which a delimiter stands before and after every word.  An edit leaves either the first
half of the searched word untouched or the second, so each word is searched twice: its second half
is matched exactly, from the closing delimiter leftwards, and the match is extended over the first
half allowing one insertion, deletion or replacement up to the opening delimiter; then the same on
the index of the reversed words for the other half.  States are intervals of suffix ranks; a step
to the left is the rank count of the FM-index, here one binary search in the list of (symbol, rank).
The two directions together are the bidirectional index; as every search starts at a delimiter it
never has to turn round, so a block holds the index of one direction only.

Blocks are ranges of the words in the direction of the search, so that a search visits only the
blocks whose range can hold its exact half.  What passes the driver is the first and last word of
each block.  A block that many words search is searched by several tasks.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import prepare, written

MIN_LETTERS, MIN_COUNT = 5, 3
DROP_EVERY = 97  # a run whose crc32 with its document's id is a multiple of it loses one letter
BLOCK_LETTERS = 1 << 18  # letters of a block (one longer word is a block of its own)
QUERIES_A_TASK = 1 << 16  # searches of a block handled by one task
STEP = 1 << 13  # searches advanced together
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "[a-zÀ-ÿ]+"
ABOVE = "Ā"  # after every letter of a run


class Index:
    """FM-index of distinct words, each between delimiters, for searches that grow to the left."""

    def __init__(self, words: list[str]):
        self.words = sorted(words)
        n = len(self.words)
        text = np.frombuffer(("\0" + "\0".join(self.words) + "\0").encode("utf-32-le"), np.uint32).astype(np.int64)
        size = len(text)
        self.n, self.size = n, size
        self.letters, sym = np.unique(text, return_inverse=True)  # the delimiter is symbol 0
        # ranks of the suffixes by doubling; delimiters differ, in the order of the words after them
        rank = sym + n
        rank[text == 0] = np.arange(n + 1)
        h = 1
        while True:
            key = rank * (size + n + len(self.letters) + 1)
            key[:-h] += rank[h:] + 1
            order = np.argsort(key, kind="stable")
            new = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
            rank = np.empty(size, np.int64)
            rank[order] = new
            if new[-1] == size - 1:
                break
            h *= 2
        self.before = np.where(order > 0, sym[order - 1], len(self.letters))  # nothing stands before the first delimiter
        by = np.argsort(self.before, kind="stable")
        self.places = self.before[by] * (size + 1) + by

    def step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """First rank of the suffixes that have ``symbol`` before a suffix of rank ``at`` or more.  The
        last delimiter stands before no word, so letters start one rank later."""
        return np.searchsorted(self.places, symbol * (self.size + 1) + at) + (symbol > 0)

    def _children(self, lo: np.ndarray, hi: np.ndarray):
        """(first child of each state, number, symbols, lo, hi) of the letters before the states' intervals;
        intervals of one depth are equal or apart, so each is looked up once."""
        at, first, back = np.unique(lo, return_index=True, return_inverse=True)
        end = hi[first]
        width = end - at
        node = np.repeat(np.arange(len(at)), width)
        row = np.arange(len(node)) - np.repeat(np.cumsum(width) - width, width) + at[node]
        sym = self.before[row]
        many = len(self.letters) + 1
        key = np.unique((node * many + sym)[(sym > 0) & (sym < many - 1)])
        node, sym = key // many, key % many
        start = np.searchsorted(node, np.arange(len(at) + 1))
        return start[back], np.diff(start)[back], sym, self.step(sym, at[node]), self.step(sym, end[node])

    def search(self, words: list[str], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the searched word, place of the found one): all indexed words at one edit of a searched
        word whose last ``exact`` letters (one at least) they end with.  A pair may come more than once."""
        length = np.array([len(w) for w in words], np.int64)
        code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        sym = np.searchsorted(self.letters, code)
        sym = np.where(self.letters[np.minimum(sym, len(self.letters) - 1)] == code, sym, len(self.letters) + 1)
        last = np.cumsum(length) - 1
        got_q, got_w = [], []
        q, lo, hi = np.arange(len(words)), np.zeros(len(words), np.int64), np.full(len(words), self.n + 1, np.int64)
        err = [np.zeros(0, np.int64)] * 4  # states with the edit behind them: search, letters matched, interval
        depth = 0
        while len(q) or len(err[0]):
            # states with the edit behind them go one letter on, or to the opening delimiter
            eq, at, elo, ehi = err
            c = np.where(at < length[eq], sym[np.minimum(last[eq] - at, len(sym) - 1)], 0)
            elo, ehi = self.step(c, elo), self.step(c, ehi)
            live = elo < ehi
            done = live & (at >= length[eq])
            got_q.append(eq[done])
            got_w.append(elo[done])
            go = live & ~done
            err = [eq[go], at[go] + 1, elo[go], ehi[go]]
            if not len(q):
                continue
            may = exact[q] <= depth
            if may.any():
                bq, blo, bhi = q[may], lo[may], hi[may]
                start, many, csym, clo, chi = self._children(blo, bhi)
                parent = np.repeat(np.arange(len(bq)), many)
                child = np.arange(len(parent)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(start, many)
                more = depth < length[bq]
                own = sym[np.minimum(last[bq] - depth, len(sym) - 1)]
                other = more[parent] & (csym[child] != own[parent])
                inserted, replaced = [bq[parent], clo[child], chi[child]], [bq[parent][other], clo[child][other], chi[child][other]]
                dropped = [bq[more], blo[more], bhi[more]]
                err = [np.concatenate([err[0], inserted[0], replaced[0], dropped[0]]),
                       np.concatenate([err[1], np.full(len(parent), depth), np.full(int(other.sum()) + int(more.sum()), depth + 1)]),
                       np.concatenate([err[2], inserted[1], replaced[1], dropped[1]]),
                       np.concatenate([err[3], inserted[2], replaced[2], dropped[2]])]
            more = depth < length[q]
            q, lo, hi = q[more], lo[more], hi[more]
            c = sym[last[q] - depth]
            lo, hi = self.step(c, lo), self.step(c, hi)
            live = lo < hi
            q, lo, hi = q[live], lo[live], hi[live]
            depth += 1
        return np.concatenate(got_q), np.concatenate(got_w)


def count_words(docs: DataFrame, drop_every: int = DROP_EVERY, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): runs of letters of all texts, A-Z lowered, less one letter where the crc32 of
    ``<doc_id>:<run>`` is a multiple of ``drop_every``; those of enough letters and occurrences.
    Null texts have no words; a null doc_id counts as empty."""
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.char_length("run") >= min_letters).withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    words = runs.select(F.when(F.col("h") % drop_every == 0, cut).otherwise(F.col("run")).alias("word")).where(F.char_length("word") >= min_letters)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def _blocks(words: DataFrame, letters: int) -> DataFrame:
    """(key, n, block): ranges of the keys in blocks of at most ``letters`` letters."""
    def cut(batches):
        block, held = (TaskContext.get().partitionId() << 32) - 1, letters
        for b in batches:
            out = []
            for k in b.column(0).to_pylist():
                if held + len(k) + 1 > letters:
                    block, held = block + 1, 0
                held += len(k) + 1
                out.append(block)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], ["key", "n", "block"])
    ranged = words.repartitionByRange("key").sortWithinPartitions("key")
    return written(ranged.mapInArrow(cut, "key string, n bigint, block bigint"))


def _half(words: DataFrame, mirrored: bool, letters: int, queries: int) -> DataFrame:
    """(word, near, near_n): near words that share the second half of ``word`` (``mirrored``: not the second, but the first)."""
    spark = words.sparkSession
    key = F.col("word") if mirrored else F.reverse("word")
    index = _blocks(words.select(key.alias("key"), "n"), letters)
    ranges = sorted((r["lo"], r["hi"], r["block"]) for r in index.groupBy("block").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).collect())
    known = spark.sparkContext.broadcast(tuple(list(x) for x in zip(*ranges, strict=True)) or ([], [], []))

    def route(frames):
        first, last, block = known.value
        for f in frames:
            out = []
            for k in f["key"]:
                x = k[:len(k) // 2] if mirrored else k[:len(k) - len(k) // 2]
                out.append(block[bisect_left(last, x):bisect_right(first, x + ABOVE)])
            yield pd.DataFrame({"key": f["key"], "blocks": out})
    routed = index.select("key").mapInPandas(route, "key string, blocks array<bigint>").select("key", F.explode("blocks").alias("block"))
    routed = written(routed)
    # a row for each block: how many tasks search it
    tasks = F.broadcast(routed.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / queries).cast("int").alias("tasks")))
    searches = routed.join(tasks, "block").select("block", F.pmod(F.xxhash64("key"), F.col("tasks")).cast("int").alias("part"), "key")
    held = index.join(tasks, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("part"), "key", "n")

    def find(block: pa.Table, search: pa.Table) -> pa.Table:
        forth = (lambda w: w[::-1])  # keys of the unmirrored half are reversed words, those of the mirrored one are words
        n_of = dict(zip(map(forth, block.column("key").to_pylist()), block.column("n").to_pylist(), strict=True))
        index = Index(list(n_of))
        keys = [forth(k) for k in search.column("key").to_pylist()]
        left, right, count = [], [], []
        for a in range(0, len(keys), STEP):
            part = keys[a:a + STEP]
            length = np.array([len(w) for w in part], np.int64)
            q, w = index.search(part, length // 2 if mirrored else length - length // 2)
            pairs = np.unique(q * np.int64(index.n) + w)
            for i, j in zip((pairs // index.n).tolist(), (pairs % index.n).tolist(), strict=True):
                word, near = part[i], index.words[j]
                if mirrored:
                    word, near = word[::-1], near[::-1]
                    if near.endswith(word[len(word) // 2:]):
                        continue  # found by the other half
                left.append(word)
                right.append(near)
                count.append(n_of[index.words[j]])
        return pa.table({"word": pa.array(left, pa.string()), "near": pa.array(right, pa.string()), "near_n": pa.array(count, pa.int64())})

    pairs = held.groupBy("block", "part").cogroup(searches.groupBy("block", "part"))
    return pairs.applyInArrow(find, "word string, near string, near_n bigint")


def near_words(words: DataFrame, letters: int = BLOCK_LETTERS, queries: int = QUERIES_A_TASK) -> DataFrame:
    """(word, near, near_n): every ordered pair of distinct words at exactly one inserted, deleted or replaced
    code point, once.  ``words``: (word, n), words distinct and of two letters or more, below U+0100."""
    prepare(words.sparkSession)
    return _half(words, False, letters, queries).unionByName(_half(words, True, letters, queries))


def variants(docs: DataFrame, drop_every: int = DROP_EVERY, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT,
             letters: int = BLOCK_LETTERS, queries: int = QUERIES_A_TASK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``docs`` (doc_id, text); see ``count_words``.

    A word's form is its near word of largest n (ties: smallest by code points) where that is at least twice
    the word's n; the root is where the forms end, the word itself if it has none.  Empty tables, and texts
    that are null, empty or without a long enough run, give no words; repeated rows count as often as they
    stand there; other columns are not read.
    """
    prepare(docs.sparkSession)
    words = written(count_words(docs.select("doc_id", "text"), drop_every, min_letters, min_count))
    best = (near_words(words, letters, queries).groupBy("word")
            .agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best")))
    taken = -F.col("best.m") >= 2 * F.col("n")
    table = written(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(taken, F.col("best.near")).alias("form"),
        F.when(taken, -F.col("best.m")).alias("form_n")))
    # pointers are doubled; counts double along a chain of forms, so a chain of all words has at most 63 links
    up = table.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        step = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        up = written(up.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        moved = up.where("moved").limit(1).count()
        up = up.drop("moved")
        if not moved:
            break
    return (table.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), F.col("n").cast("bigint").alias("n"),
                                                  F.col("n_near").cast("bigint").alias("n_near"), F.col("form_n").cast("bigint").alias("form_n")))
