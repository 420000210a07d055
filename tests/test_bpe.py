"""Training by verified batches of merges, encoding and decoding on arrays, against plain Python."""

import collections
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import bpe
from tessera.operators import ext as X
from tessera.operators import tok as TK


def merged(ids, pair, new):
    out, i = [], 0
    while i < len(ids):
        if tuple(ids[i:i + 2]) == pair:
            out.append(new)
            i += 2
        else:
            out.append(ids[i])
            i += 1
    return out


def trained(pieces, many):
    """One pair at a time: most occurrences, then the lowest pair."""
    words = [(list(p.encode()), n) for p, n in pieces.items()]
    out = []
    while len(out) < many:
        count = collections.Counter()
        for ids, n in words:
            for pair in zip(ids, ids[1:]):
                count[pair] += n
        if not count:
            break
        pair = min(count, key=lambda p: (-count[p], p))
        words = [(merged(ids, pair, 256 + len(out)), n) for ids, n in words]
        out.append(pair)
    return out


def encoded(piece, merges):
    ids, rank = list(piece.encode()), {p: i for i, p in enumerate(merges)}
    while True:
        best = min(zip(ids, ids[1:]), key=lambda p: rank.get(p, 1 << 30), default=None)
        if best not in rank:
            return ids
        ids = merged(ids, best, 256 + rank[best])


def pieces_of(seed):
    r = random.Random(seed)
    syllables = ["ab", "ba", "abc", "cab", "dd", "ddd", "é", "zz", "a"]
    words = {"".join(r.choice(syllables) for _ in range(r.randint(1, 6))): r.choice([1, 2, 3, 50, 900]) for _ in range(300)}
    words |= {"a" * n: r.randint(1, 40) for n in range(1, 40)} | {"=" * n: r.randint(1, 9) for n in (3, 8, 79)} | {"-=" * 9: 4, "\0\0\0": 3}
    return words


def test_runs_of_one_character(spark):
    """A merge of a token with itself makes pairs that outrank the next ones."""
    rows = [("aaaaaaaa",)] * 10 + [("cd",)] * 15 + [("-- ======== ef",)] * 6
    df = spark.createDataFrame(rows, "text string")
    assert TK.train_bpe(df, 256 + 9 + 6) == [(97, 97), (61, 61), (256, 256), (257, 257), (99, 100), (258, 258)]


@pytest.mark.parametrize(("seed", "options"), [(1, {}), (2, {"head": 40, "sample": 8, "guess": 30}), (3, {"head": 15, "sample": 300, "guess": 9}), (4, {"sample": 0}),
                                               (5, {"head": 1 << 16, "sample": 25, "guess": 64})])
def test_training_equals_one_merge_at_a_time(spark, seed, options):
    words, rounds = pieces_of(seed), []
    df = spark.createDataFrame(list(words.items()), "piece string, count bigint").repartition(5)
    assert bpe.train(df, 150, rounds=rounds, **options) == trained(words, 150)
    assert sum(n for _, n in rounds) == 150


def test_training_ends_without_pairs(spark):
    df = spark.createDataFrame([("abc", 2), ("x", 9)], "piece string, count bigint")
    assert bpe.train(df, 50) == [(97, 98), (256, 99)]
    assert bpe.train(df.limit(0), 50) == []


def test_blocks_are_written_anew(spark, monkeypatch):
    words = pieces_of(7)
    df = spark.createDataFrame(list(words.items()), "piece string, count bigint").repartition(3)
    monkeypatch.setattr(bpe, "REWRITE", 20)
    assert bpe.train(df, 120, guess=25) == trained(words, 120)


def test_the_sample_stands_for_all_pieces(spark):
    """Half of it the most frequent pieces; the others carry the weight of the remaining ones."""
    words = {f"w{i}": 1000 if i < 10 else 1 + i % 3 for i in range(4000)}
    df = spark.createDataFrame(list(words.items()), "piece string, count bigint").repartition(3)
    piece, weight = bpe.sampled(df, 400)
    assert len(piece) <= 400 and piece[:10] == sorted(piece[:10]) and weight[:200] == [words[p] for p in piece[:200]]
    assert 0.7 < sum(weight) / sum(words.values()) < 1.3
    assert sorted(zip(*bpe.sampled(df, 4000), strict=True)) == sorted(words.items()) and bpe.sampled(df, 0) == ([], [])


def test_few_merges_are_guessed_after_wrong_guesses(spark):
    rounds = []
    df = spark.createDataFrame(list(pieces_of(2).items()), "piece string, count bigint").repartition(5)
    bpe.train(df, 150, sample=30, guess=100, rounds=rounds)
    assert all(n <= max(bpe.GUESS_LEAST, 2 * took) for (_, took), (n, _) in zip(rounds, rounds[1:]))


def test_places_of_known_merges_are_enough():
    words = pieces_of(9)
    merges, flat = trained(words, 60), np.concatenate([np.append(np.frombuffer(w.encode(), np.uint8).astype(np.int64), -1) for w in words])
    weights = np.array(list(words.values()), np.int64)
    full, some = bpe.Pieces(flat, weights, 256), bpe.Pieces(flat, weights, 256, merges)
    for i, (a, b) in enumerate(merges):
        assert all(x.tolist() == y.tolist() for x, y in zip(full.merge(a, b, 256 + i), some.merge(a, b, 256 + i), strict=True))
    assert len(some.records[-1][1]) < len(full.records[-1][1])
    tokens, left = (np.frombuffer(x, t) for x, t in zip(some.left(weights), (np.int32, np.int64), strict=True))
    pairs = lambda p: {k: n for k, n in zip(*(c.tolist() for c in p.counts()), strict=True) if n}
    assert len(left) < len(weights) and pairs(bpe.Pieces(tokens, left, 316)) == pairs(full)


@pytest.mark.parametrize("seed", range(60))
def test_replay_takes_what_one_at_a_time_takes(seed):
    """Guesses in a wrong order: the replay takes a prefix of the right merges, and its counts are exact."""
    r = random.Random(seed)
    words = pieces_of(seed)
    right = trained(words, 40)
    start = r.choice([0, 5, 20])
    flat = np.concatenate([np.append(np.frombuffer(w.encode(), np.uint8).astype(np.int64), -1) for w in words])

    def state(merges):
        p = bpe.Pieces(flat, np.array(list(words.values()), np.int64), 256)
        for i, (a, b) in enumerate(merges):
            p.merge(a, b, 256 + i)
        return p
    p = state(right[:start])
    first = 256 + start
    head = dict(zip(*(c.tolist() for c in p.counts()), strict=True))
    order = list(range(12))
    for _ in range(r.choice([1, 2, 6])):  # swap neighbours where the later does not need the earlier
        i = r.randrange(1, 11)
        a, b = right[start + order[i]], right[start + order[i + 1]]
        if 256 + start + order[i] not in b:
            order[i], order[i + 1] = order[i + 1], order[i]
    name = {256 + start + o: first + i for i, o in enumerate(order)}
    guess = [tuple(name.get(t, t) for t in right[start + o]) for o in order]
    changes = [dict(zip(*(c.tolist() for c in p.merge(a, b, first + i)), strict=True)) for i, (a, b) in enumerate(guess)]
    taken, exact, after = bpe.replay(head, 0, True, guess, changes, first)
    assert taken and taken == right[start:start + len(taken)]
    assert len(taken) > 1 or order[:2] != [0, 1]
    want = dict(zip(*(c.tolist() for c in state(right[:start + len(taken)]).counts()), strict=True))
    assert after == {k: n for k, n in want.items() if n > 0} and exact[0] == max(head.values())


@pytest.mark.parametrize("memo", [0, 3_000, 1 << 20])
def test_pieces_are_encoded_by_rank(memo):
    words = pieces_of(11)
    merges = trained(words, 80)
    enc = bpe.PieceEncoder(merges, memo)
    for _ in range(2):  # the second time from the memo, as far as it holds
        got = enc.encode(list(map(str.encode, words)))
        assert [g.tolist() for g in got] == [encoded(w, merges) for w in words]
        assert enc.held <= memo and enc.held == sum(len(p) + 4 * len(i) + 250 for p, i in enc.memo.items())
    assert [g.tolist() for g in bpe.PieceEncoder([]).encode([b"ab", b"\xc3\xa9"])] == [[97, 98], [195, 169]]


def test_lists_nulls_and_slices():
    merges = [(97, 98), (256, 99)]
    enc = bpe.PieceEncoder(merges)
    texts = pa.array([["zz"], ["abc", "ab", "abc"], None, [], ["d", "ab"]], pa.list_(pa.string()))
    assert enc.encode_lists(texts, [7], [8, 9]).to_pylist() == [[7, 122, 122, 8, 9], [7, 257, 256, 257, 8, 9], [7, 8, 9], [7, 8, 9], [7, 100, 256, 8, 9]]
    assert enc.encode_lists(texts.slice(1, 2), [], []).to_pylist() == [[257, 256, 257], []]
    assert enc.encode_lists(texts.slice(0, 0), [1], []).to_pylist() == []
    table = bpe.token_table(TK.token_bytes_list(merges))
    assert bpe.decoded(pa.array([[257, 100], None, [], [255]], pa.list_(pa.int32())).slice(0, 4), *table).to_pylist() == [b"abcd", b"", b"", b"\xff"]
    assert bpe.decoded(pa.array([[257, 100], None, [256]], pa.list_(pa.int32())).slice(2, 1), *table).to_pylist() == [b"ab"]


def test_encode_and_decode_do_not_shuffle(spark):
    merges = trained(pieces_of(1), 30)
    df = spark.createDataFrame([(1, "abab dd"), (2, None), (3, "a" * 300_000 + " é")], "id long, text string")
    ids = TK.encode_table(df, merges, "id", prepend="<|bos|>")
    text = TK.decode_table(ids.select("id", F.slice("ids", 2, 1 << 30).alias("ids")), TK.vocab_table(spark, merges), "id")
    assert "Exchange" not in text._jdf.queryExecution().executedPlan().toString()
    assert {r.id: r.text for r in text.collect()} == {1: "abab dd", 2: "", 3: "a" * 300_000 + " é"}
    assert X.bpe_tokenizer(merges).encode_batch(["abab dd"])[0] == ids.where("id = 1").first().ids[1:]
    with pytest.raises(ValueError):
        TK.decode_table(ids, TK.vocab_table(spark, merges).where("token_id <> 3"), "id")
