"""Byte-level BPE on arrays: training by verified batches of merges (E2), encoding of piece
lists (E3) and decoding by offsets (E4).

Training.  The corpus is reduced to distinct pieces with counts, kept as blocks of token arrays.
The driver holds exact counts of the most frequent pairs only (``HEAD``); every other pair has at
most ``bound`` occurrences.  A round guesses the next merges on a bounded sample of the pieces (the
most frequent ones, and some of the others for all of them), as many as the last rounds got right, lets every block carry them out in that order and report by how much each merge changes which
counts, and replays the merges against these exact changes: what is accepted are the merges that
one pair at a time would choose, in that order.  A wrong guess costs a round, never the result.
"""

from __future__ import annotations

import heapq
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import cut_lineage, ensure_shipped

HEAD = 1 << 16  # pairs whose counts the driver holds
SAMPLE = 1 << 19  # pieces on which the driver guesses the next merges
GUESS, GUESS_LEAST = 256, 32  # merges guessed a round
REWRITE = 192  # merges after which the blocks are written anew
BLOCK_TOKENS = 1 << 21  # a merge costs a block some calls on arrays, however few its places are
MEMO_BYTES = 32 << 20  # pieces and ids that a worker remembers while it encodes
_BITS = 32


def pair_key(a, b):
    return (a << _BITS) | b


def _grouped(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their values."""
    if not len(keys):
        return keys, values
    by = np.argsort(keys, kind="stable")
    keys = keys[by]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(values[by], first)


class Pieces:
    """Weighted pieces as one linked list of tokens, changed in place by merges.

    A pair holds a token that is no older than the pair itself, so the places of a pair are
    those recorded when the newer of its tokens was made, or at the start.
    """

    def __init__(self, tokens: np.ndarray, weights: np.ndarray, first_new: int, merges: list[tuple[int, int]] | None = None):
        """``tokens``: all pieces, each followed by -1.  ``first_new``: id of the next token to be made.  ``merges``: those that
        will be carried out, if known, so that only their places are recorded."""
        self.x = np.concatenate([[-1], tokens]).astype(np.int32)
        ends = np.flatnonzero(self.x == -1)
        self.w = np.concatenate([[0], np.repeat(weights, np.diff(ends))]).astype(np.int64)
        self.next = np.minimum(np.arange(1, len(self.x) + 1), len(self.x) - 1).astype(np.int32)
        self.prev = np.maximum(np.arange(-1, len(self.x) - 1), 0).astype(np.int32)
        self.first_new = first_new
        self.records: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        places = np.arange(len(self.x))
        if merges is not None:
            left, right = np.zeros((2, first_new + 1), bool)  # the last is for -1
            for a, b in merges:
                if max(a, b) < first_new:
                    left[a] = right[b] = True
            places = np.flatnonzero(left[self.x[:-1]] & right[self.x[1:]])
        self.records[-1] = self._record(places)

    def copy(self) -> Pieces:
        other = object.__new__(Pieces)
        other.x, other.w, other.next, other.prev = self.x.copy(), self.w, self.next.copy(), self.prev.copy()
        other.first_new, other.records = self.first_new, dict(self.records)
        return other

    def _pairs(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = at[self.x[at] >= 0]
        b = self.x[self.next[at]]
        at, b = at[b >= 0], b[b >= 0]
        return pair_key(self.x[at].astype(np.int64), b.astype(np.int64)), at.astype(np.int32)

    def _record(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, at = self._pairs(at)
        by = np.argsort(keys, kind="stable")
        return keys[by], at[by]

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        keys, at = self._pairs(np.arange(len(self.x)))
        return _grouped(keys, self.w[at])

    def merge(self, a: int, b: int, new: int) -> tuple[np.ndarray, np.ndarray]:
        """Replace (a, b) by ``new``, left to right; the pairs whose counts change, and by how much."""
        newer = max(a, b)
        keys, places = self.records[newer if newer >= self.first_new else -1]
        lo, hi = np.searchsorted(keys, [pair_key(a, b), pair_key(a, b) + 1])
        at = places[lo:hi]
        at = np.sort(at[(self.x[at] == a) & (self.x[self.next[at]] == b)])
        if a == b and len(at):  # of places that touch every other one
            n = np.arange(len(at))
            touches = np.concatenate([[False], self.next[at[:-1]] == at[1:]])
            at = at[(n - np.maximum.accumulate(np.where(touches, 0, n))) % 2 == 0]
        second = self.next[at]
        gone, gone_at = self._pairs(np.unique(np.concatenate([self.prev[at], at, second])))
        after = self.next[second]
        self.x[at], self.x[second] = new, -2
        self.next[at], self.prev[after] = after, at
        self.records[new] = made, made_at = self._record(np.unique(np.concatenate([self.prev[at], at])))
        return _grouped(np.concatenate([gone, made]), np.concatenate([-self.w[gone_at], self.w[made_at]]))

    def left(self, weights: np.ndarray) -> tuple[bytes, bytes]:
        """Tokens and weights, as they were given to the constructor, of the pieces that still hold a pair."""
        flat = self.x[1:][self.x[1:] != -2]
        size = np.diff(np.flatnonzero(flat == -1), prepend=-1)
        keep = size > 2  # with the -1 behind it
        return flat[np.repeat(keep, size)].astype(np.int32).tobytes(), weights[keep].tobytes()


# ---------------------------------------------------------------- blocks of pieces

_BLOCK = "tokens binary, weights binary"


def _to_blocks(batches):
    """(piece, count) batches as blocks; pieces of one byte hold no pair."""
    tokens, weights, size = [], [], 0

    def block():
        return pa.RecordBatch.from_arrays([pa.array([np.concatenate(tokens).astype(np.int32).tobytes()], pa.binary()),
                                           pa.array([np.concatenate(weights).astype(np.int64).tobytes()], pa.binary())], ["tokens", "weights"])
    for b in batches:
        piece = b.column(0).cast(pa.large_binary())
        off = np.frombuffer(piece.buffers()[1], np.int64)[piece.offset:piece.offset + len(piece) + 1]
        data = np.frombuffer(piece.buffers()[2], np.uint8)[off[0]:off[-1]] if piece.buffers()[2] is not None else np.zeros(0, np.uint8)
        length = np.diff(off)
        keep = length > 1
        flat = np.insert(data.astype(np.int32), off[1:] - off[0], -1)
        tokens.append(flat[np.repeat(keep, length + 1)])
        weights.append(b.column(1).to_numpy(zero_copy_only=False)[keep])
        size += len(tokens[-1])
        if size >= BLOCK_TOKENS:
            yield block()
            tokens, weights, size = [], [], 0
    if size:
        yield block()


def _blocks_of(batches, first_new: int, merges: list[tuple[int, int]]):
    for b in batches:
        for tokens, weights in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            yield Pieces(np.frombuffer(tokens, np.int32), np.frombuffer(weights, np.int64), first_new, merges), weights


class Corpus:
    """The blocks of distinct pieces, the merges they carry, and those still to be carried out in them."""

    def __init__(self, pieces: DataFrame):
        ensure_shipped(pieces.sparkSession)
        self.blocks = cut_lineage(pieces.select("piece", "count").mapInArrow(_to_blocks, _BLOCK))
        self.done, self.pending = 256, []

    def carry_out(self, merges: list[tuple[int, int]]) -> None:
        """Note accepted merges; write the blocks anew when many wait."""
        self.pending += merges
        if len(self.pending) < REWRITE:
            return
        first, pending = self.done, self.pending

        def run(batches):
            for block, weights in _blocks_of(batches, first, pending):
                for i, (a, b) in enumerate(pending):
                    block.merge(a, b, first + i)
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in block.left(np.frombuffer(weights, np.int64))], ["tokens", "weights"])
        self.blocks = cut_lineage(self.blocks.mapInArrow(run, _BLOCK))
        self.done, self.pending = first + len(pending), []

    def head(self, size: int) -> tuple[dict[int, int], int]:
        """Counts of the ``size`` most frequent pairs (ties: lowest first), and the most that any other has."""
        first, pending = self.done, self.pending

        def run(batches):
            for block, _ in _blocks_of(batches, first, pending):
                for i, (a, b) in enumerate(pending):
                    block.merge(a, b, first + i)
                keys, n = block.counts()
                for s in range(0, len(keys), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[s:s + (1 << 16)]), pa.array(n[s:s + (1 << 16)])], ["k", "n"])
        pairs = self.blocks.mapInArrow(run, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n"))
        top = pairs.orderBy(F.desc("n"), "k").limit(size + 1).toArrow()  # at most ``size`` + 1 rows
        keys, n = top.column("k").to_pylist(), top.column("n").to_pylist()
        return dict(zip(keys[:size], n[:size], strict=True)), n[size] if len(n) > size else 0

    def changes(self, guess: list[tuple[int, int]], known: np.ndarray, bound: int) -> list[dict[int, int]]:
        """By how much each guessed merge, after those before it, changes the counts of the ``known`` pairs (sorted keys) and
        of pairs with a token made in the round, except such as never have more than ``bound`` occurrences."""
        first, pending = self.done, self.pending
        start = first + len(pending)

        def run(batches):
            for block, _ in _blocks_of(batches, first, pending + guess):
                for i, (a, b) in enumerate(pending):
                    block.merge(a, b, first + i)
                parts = []
                for i, (a, b) in enumerate(guess):
                    keys, n = block.merge(a, b, start + i)
                    at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
                    made = (keys >> _BITS >= start) | (keys & 0xFFFFFFFF >= start)
                    use = (made | (known[at] == keys if len(known) else False)) & (n != 0)
                    parts.append((keys[use], np.full(int(use.sum()), i), n[use]))
                cols = [np.concatenate(c) for c in zip(*parts, strict=True)]
                for s in range(0, len(cols[0]), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(c[s:s + (1 << 16)]) for c in cols], ["k", "step", "n"])
        rows = self.blocks.mapInArrow(run, "k bigint, step bigint, n bigint").repartition("k").groupBy("k", "step").agg(F.sum("n").alias("n"))
        made = (F.shiftright("k", _BITS) >= start) | (F.col("k").bitwiseAND(0xFFFFFFFF) >= start)
        pairs = rows.groupBy("k").agg(F.sum(F.greatest("n", F.lit(0))).alias("up"), F.collect_list(F.struct("step", "n")).alias("s"))  # a step once
        table = pairs.where(~made | (F.col("up") > bound)).select("k", F.explode("s").alias("s")).select("k", "s.step", "s.n").toArrow()
        out: list[dict[int, int]] = [{} for _ in guess]
        for k, step, n in zip(*(table.column(c).to_pylist() for c in ("k", "step", "n")), strict=True):
            out[step][k] = n
        return out


# ---------------------------------------------------------------- guessing and replaying


class Guesser:
    """Guesses the next merges on the sampled pieces, scaled to the exact counts of the pairs."""

    def __init__(self, pieces: list[str], counts: list[int]):
        b = [p.encode("utf-8") for p in pieces]
        flat = np.frombuffer(b"".join(x + b"\0" for x in b), np.uint8).astype(np.int64)
        flat[np.cumsum([len(x) + 1 for x in b], dtype=np.int64) - 1] = -1
        self.pieces = Pieces(flat, np.array(counts, np.int64), 256)
        self.counts = dict(zip(*(c.tolist() for c in self.pieces.counts()), strict=True))
        self.scale: dict[int, float] = {}

    def accept(self, merges: list[tuple[int, int]], first: int, exact: list[int]) -> None:
        for i, (a, b) in enumerate(merges):
            self.scale[first + i] = exact[i] / max(self.counts.get(pair_key(a, b), 0), 1)
            for k, n in zip(*(c.tolist() for c in self.pieces.merge(a, b, first + i)), strict=True):
                self.counts[k] = self.counts.get(k, 0) + n

    def guess(self, head: dict[int, int], first: int, many: int) -> list[tuple[int, int]]:
        """At most ``many`` merges; the first is the best pair of ``head``."""
        pieces, now, scale = self.pieces.copy(), {}, {}

        def expected(k):
            if k in head:
                own = self.counts.get(k, 0)
                return head[k] * now.get(k, own) / own if own > 0 else float(head[k])
            newer = max(k >> _BITS, k & 0xFFFFFFFF)
            return now.get(k, 0) * scale.get(newer, 1.0)
        top = heapq.nsmallest(8 * many, ((-n, k) for k, n in head.items()))
        heap = [(float(n), k) for n, k in top]
        heapq.heapify(heap)
        out: list[tuple[int, int]] = []
        while heap and len(out) < many:
            n, k = heapq.heappop(heap)
            real = expected(k)
            if real <= 0:
                continue
            if -real > n:
                heapq.heappush(heap, (-real, k))
                continue
            a, b, new = k >> _BITS, k & 0xFFFFFFFF, first + len(out)
            out.append((a, b))
            scale[new] = real / max(now.get(k, self.counts.get(k, 0)), 1)
            for key, d in zip(*(c.tolist() for c in pieces.merge(a, b, new)), strict=True):
                now[key] = now.get(key, self.counts.get(key, 0)) + d
                if key not in head and now[key] > 0 and max(key >> _BITS, key & 0xFFFFFFFF) == new:
                    heapq.heappush(heap, (-expected(key), key))
        return out


def replay(head: dict[int, int], bound: int, fresh: bool, guess: list[tuple[int, int]], changes: list[dict[int, int]], first: int,
           ) -> tuple[list[tuple[int, int]], list[int], dict[int, int]]:
    """The merges that one pair at a time chooses, as far as the guess reaches: (merges in order, their counts, counts after).

    ``changes`` are exact for the guessed order.  A merge may be taken before guessed ones that it shares no
    token with: they act on different places, so its own count and, together, their changes are the same in either order.
    Until the passed-over merge (a, b) is taken, only pairs at a place where it touches the taken one (c, d) -> y are uncertain:
    (b, c), which is counted too high, and (b, y), which has at most what (b, c) is counted too high more; likewise (d, a) and
    (y, a).  The replay stops before a choice that depends on them, and goes back to the last point at which
    the taken merges are the first of the guess.
    """
    count, real = dict(head), {}  # pairs are keyed by the guess's token ids
    where = {pair_key(a, b): i for i, (a, b) in enumerate(guess)}
    name = lambda t: real.get(t) if t >= first else t
    waiting: dict[int, list[int]] = {}
    heap = [(-n, k >> _BITS, k & 0xFFFFFFFF, k) for k, n in head.items()]
    heapq.heapify(heap)
    taken: list[int] = []
    exact: list[int] = []
    passed: set[int] = set()
    unsure: list[tuple[int, int, int]] = []  # (passed merge, pair counted too high, pair counted too low)
    reach = closed = 0

    def push(k):
        a, b = name(k >> _BITS), name(k & 0xFFFFFFFF)
        if a is None or b is None:
            for t in (k >> _BITS, k & 0xFFFFFFFF):
                if t >= first and t not in real:
                    waiting.setdefault(t, []).append(k)
        elif count[k] > 0:
            heapq.heappush(heap, (-count[k], a, b, k))
    while heap:
        n, _, _, k = heap[0]
        if count.get(k, 0) != -n:  # its count has changed since; the new one is in the heap
            heapq.heappop(heap)
            continue
        n = -n
        i = where.get(k)
        if i is None or not (n > bound or (fresh and not taken)):
            break
        if any(k == high or n <= count.get(high, bound) + count.get(low, bound) for _, high, low in unsure):
            break
        before = [j for j in range(reach, i)] + [j for j in passed if j < i]
        a, b = guess[i]
        if any({a, b} & {*guess[j], first + j} for j in before):
            break
        heapq.heappop(heap)
        for j in before:
            y, (c, d) = first + i, guess[j]
            unsure += [(j, pair_key(d, a), pair_key(d, y)), (j, pair_key(b, c), pair_key(y, c))]
        passed |= {j for j in range(reach, i)}
        passed.discard(i)
        reach = max(reach, i + 1)
        unsure = [u for u in unsure if u[0] != i]
        real[first + i] = first + len(taken)
        taken.append(i)
        exact.append(n)
        for key, d in changes[i].items():
            count[key] = count.get(key, 0) + d
            push(key)
        for key in waiting.pop(first + i, ()):
            push(key)
        if not passed and reach == len(taken):
            closed = len(taken)
    taken, exact = taken[:closed], exact[:closed]
    names = {first + i: first + at for at, i in enumerate(taken)}
    after = dict(head)
    for i in taken:
        for key, d in changes[i].items():
            a, b = key >> _BITS, key & 0xFFFFFFFF
            key = pair_key(names.get(a, a), names.get(b, b))
            after[key] = after.get(key, 0) + d
    # a pair with no more than ``bound`` occurrences counts as unknown again
    after = {k: n for k, n in after.items() if n > max(bound, 0)}
    return [(names.get(guess[i][0], guess[i][0]), names.get(guess[i][1], guess[i][1])) for i in taken], exact, after


def sampled(pieces: DataFrame, most: int) -> tuple[list[str], list[int]]:
    """At most ``most`` pieces with weights: half of them the most frequent ones, the others every k-th (by hash) of the
    remaining ones with k times their count, so that the sums of the weights stand for those of all pieces."""
    frequent = [F.desc("count"), "piece"]
    n = pieces.count()
    top = pieces.orderBy(*frequent).limit(most if n <= most else most // 2).toArrow()
    piece, count = top.column("piece").to_pylist(), top.column("count").to_pylist()
    if n > most and piece:
        k = -(-(n - len(piece)) // (most - len(piece)))
        rest = pieces.where((F.col("count") < count[-1]) | ((F.col("count") == count[-1]) & (F.col("piece") > piece[-1])))
        some = rest.where(F.pmod(F.xxhash64("piece"), F.lit(k)) == 0).limit(most - len(piece)).toArrow()
        piece += some.column("piece").to_pylist()
        count += [k * c for c in some.column("count").to_pylist()]
    return piece, count


def train(pieces: DataFrame, many: int, head: int = HEAD, sample: int = SAMPLE, guess: int = GUESS, rounds: list | None = None) -> list[tuple[int, int]]:
    """The first ``many`` merges over ``pieces`` (piece, count): always the pair of most occurrences, ties by the lowest pair.
    ``rounds``, if given, gets (guessed, accepted) of each round."""
    corpus = Corpus(pieces)
    guesser = Guesser(*sampled(pieces, sample))
    merges: list[tuple[int, int]] = []
    counts, bound = corpus.head(head)
    fresh, now = True, guess
    while len(merges) < many and counts:
        first = 256 + len(merges)
        guessed = guesser.guess(counts, first, min(now, many - len(merges)))
        found = corpus.changes(guessed, np.array(sorted(counts), np.int64), bound)
        taken, exact, counts = replay(counts, bound, fresh, guessed, found, first)
        if rounds is not None:
            rounds.append((len(guessed), len(taken)))
        now = min(guess, max(GUESS_LEAST, 2 * len(taken)))  # merges guessed in vain cost as much as others
        fresh = False
        merges += taken
        corpus.carry_out(taken)
        guesser.accept(taken, first, exact)
        if bound and (not taken or not counts):
            counts, bound = corpus.head(head)  # the best pair known is no better than one that is not
            fresh = True
    return merges


# ---------------------------------------------------------------- encoding and decoding


def token_table(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All token bytes, and their offsets."""
    return np.frombuffer(b"".join(tokens), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in tokens], dtype=np.int64)])


def spread(data: np.ndarray, off: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``which`` of ``data`` one after the other: (data, ends)."""
    length = off[which + 1] - off[which]
    ends = np.cumsum(length)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(off[which] - (ends - length), length)
    return data[at], ends


class PieceEncoder:
    """Ids of pieces: the pair of lowest rank is merged everywhere in a piece until none is left, for all pieces
    of a call together.  Pieces seen before come from a memo of at most ``MEMO_BYTES``, the oldest going first."""

    def __init__(self, merges: list[tuple[int, int]], memo_bytes: int = MEMO_BYTES):
        keys = np.array([pair_key(a, b) for a, b in merges], np.int64)
        by = np.argsort(keys)
        self.keys, self.ids = keys[by], by + 256
        self.memo: OrderedDict[bytes, np.ndarray] = OrderedDict()
        self.held, self.memo_bytes = 0, memo_bytes

    def __reduce__(self):  # travels without its memo
        return _encoder, (self.keys, self.ids, self.memo_bytes)

    def _merged(self, pieces: list[bytes]) -> list[np.ndarray]:
        length = np.array([len(p) for p in pieces], np.int64)
        x = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
        piece = np.repeat(np.arange(len(pieces)), length)
        done: list[np.ndarray] = []
        none = np.int64(1 << 62)
        while len(x) and len(self.keys):
            pair = np.full(len(x), none)
            inside = piece[1:] == piece[:-1]
            keys = pair_key(x[:-1], x[1:])
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = inside & (self.keys[at] == keys)
            pair[:-1][hit] = self.ids[at[hit]]
            starts = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))
            least = np.minimum.reduceat(pair, starts)
            size = np.diff(np.append(starts, len(x)))
            live = least < none
            if not live.all():  # pieces without a pair to merge are finished
                stay = np.repeat(live, size)
                done.append(np.stack([piece[~stay], x[~stay]]))
                x, piece, pair = x[stay], piece[stay], pair[stay]
                least, size = least[live], size[live]
            if not len(x):
                break
            here = np.flatnonzero(pair == np.repeat(least, size))
            n = np.arange(len(here))
            touches = np.concatenate([[False], (here[1:] == here[:-1] + 1) & (piece[here[1:]] == piece[here[:-1]])])
            here = here[(n - np.maximum.accumulate(np.where(touches, 0, n))) % 2 == 0]
            x[here] = pair[here]
            stay = np.ones(len(x), bool)
            stay[here + 1] = False
            x, piece = x[stay], piece[stay]
        done.append(np.stack([piece, x]))
        piece, x = np.concatenate(done, axis=1)
        by = np.argsort(piece, kind="stable")
        return np.split(x[by].astype(np.int32), np.cumsum(np.bincount(piece, minlength=len(pieces)))[:-1])

    def encode(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of distinct pieces."""
        out: list = [None] * len(pieces)
        new = []
        for i, p in enumerate(pieces):
            ids = self.memo.get(p)
            if ids is None:
                new.append(i)
            else:
                self.memo.move_to_end(p)
                out[i] = ids
        for i, ids in zip(new, self._merged([pieces[i] for i in new]) if new else (), strict=True):
            out[i] = ids
            size = len(pieces[i]) + 4 * len(ids) + 250  # with what the objects take
            if size <= self.memo_bytes >> 4:
                self.memo[pieces[i]] = ids.copy()
                self.held += size
        while self.held > self.memo_bytes:
            p, ids = self.memo.popitem(last=False)
            self.held -= len(p) + 4 * len(ids) + 250
        return out

    def encode_lists(self, texts: pa.Array, before: list[int], after: list[int]) -> pa.Array:
        """list<int32> of each list of pieces (null counts as empty), between ``before`` and ``after``."""
        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        lengths = texts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat = texts.flatten().dictionary_encode()
        ids = self.encode([p.encode("utf-8") for p in flat.dictionary.to_pylist()])
        size = np.array([len(i) for i in ids], np.int64)
        data, ends = spread(np.concatenate([*ids, np.zeros(0, np.int32)]), np.concatenate([[0], np.cumsum(size)]),
                            flat.indices.to_numpy(zero_copy_only=False).astype(np.int64))
        ends = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(lengths)])]
        if before or after:
            extra = len(before) + len(after)
            at = np.concatenate([np.repeat(ends[:-1, None], len(before), 1), np.repeat(ends[1:, None], len(after), 1)], 1)
            data = np.insert(data, at.ravel(), np.tile(np.array(before + after, np.int32), len(lengths)))
            ends = ends + extra * np.arange(len(ends))
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(data.astype(np.int32)))


def _encoder(keys: np.ndarray, ids: np.ndarray, memo_bytes: int) -> PieceEncoder:
    out = PieceEncoder([], memo_bytes)
    out.keys, out.ids = keys, ids
    return out


def decoded(ids: pa.Array, data: np.ndarray, off: np.ndarray) -> pa.Array:
    """Bytes of each list of ids (null counts as empty), gathered from the token table."""
    ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
    lengths = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    out, ends = spread(data, off, ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
    ends = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(lengths)])]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(out.tobytes())])
