"""Rows-only operators against independent brute-force Python on the sf0.001 fixture."""

import random
from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F

from tessera.operators import pack as PK
from tessera.operators import tok as TK

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").where(F.col("lang") == "en").select("doc_id", "text")


def py_pieces(texts):
    c = Counter()
    for t in texts:
        c.update(regex.findall(TK.SPLIT_PATTERN, t))
    return c


def py_train(counts, n_merges):
    words = {tuple(p.encode()): n for p, n in counts.items()}
    merges = []
    for r in range(n_merges):
        pairs = Counter()
        for w, n in words.items():
            for a, b in zip(w, w[1:]):
                pairs[(a, b)] += n
        if not pairs:
            break
        best = min(pairs, key=lambda p: (-pairs[p], p))
        new = 256 + r
        merges.append(best)
        nw = {}
        for w, n in words.items():
            out, i = [], 0
            while i < len(w):
                if i + 1 < len(w) and (w[i], w[i + 1]) == best:
                    out.append(new)
                    i += 2
                else:
                    out.append(w[i])
                    i += 1
            nw[tuple(out)] = nw.get(tuple(out), 0) + n
        words = nw
    return merges


def py_encode(text, merges):
    ranks = {p: 256 + i for i, p in enumerate(merges)}
    ids = []
    for piece in regex.findall(TK.SPLIT_PATTERN, text):
        w = list(piece.encode())
        while len(w) > 1:
            cands = [(ranks[(a, b)], i) for i, (a, b) in enumerate(zip(w, w[1:])) if (a, b) in ranks]
            if not cands:
                break
            rank, _ = min(cands)
            a, b = merges[rank - 256]
            out, i = [], 0
            while i < len(w):
                if i + 1 < len(w) and w[i] == a and w[i + 1] == b:
                    out.append(rank)
                    i += 2
                else:
                    out.append(w[i])
                    i += 1
            w = out
        ids += w
    return ids


def test_piece_counts_and_bpe_training(spark, docs):
    texts = [r.text for r in docs.collect()]
    want = py_pieces(texts)
    got = {r.piece: r["count"] for r in TK.piece_counts(docs).collect()}
    assert got == dict(want)
    merges = TK.train_bpe(docs, 256 + 9 + 12)
    assert merges == py_train(want, 12)
    enc = {r.doc_id: r.ids for r in docs.select("doc_id", TK.encode("text", merges).alias("ids")).collect()}
    for r in docs.collect():
        assert enc[r.doc_id] == py_encode(r.text, merges)


def py_pack(docs, cap, buffer_size, refill):
    """Best-fit packing written from the rules: before every pick the buffer is refilled in batches while
    documents are left; the longest that fits, else the shortest, cropped (the first of equal lengths)."""
    waiting, buf, rows, row = list(docs), [], [], []
    while True:
        while len(buf) < buffer_size and waiting:
            buf += waiting[:refill]
            del waiting[:refill]
        if not buf:
            return rows, row
        room = cap - len(row)
        fit = [d for d in buf if len(d) <= room]
        pick = max(fit, key=len) if fit else min(buf, key=len)  # the first of equal lengths
        del buf[next(i for i, d in enumerate(buf) if d is pick)]
        row = row + pick[:room]
        if len(row) == cap:
            rows.append(row)
            row = []


@pytest.mark.parametrize("seed", range(40))
def test_lane_packer_follows_the_rules(seed):
    r = random.Random(seed)
    cap, buffer_size, refill = r.choice([5, 9, 65]), r.choice([1, 3, 16]), r.choice([1, 4, 7])
    longest = r.choice([3, 12, 90])  # all short, mixed, mostly longer than a row
    docs = [[i * 100 + j for j in range(r.randint(1, longest))] for i in range(r.randint(0, 120))]
    p, out = PK.LanePacker("x", cap - 1, buffer_size, refill), []
    for i, d in enumerate(docs):
        p = PK.LanePacker("x", cap - 1, buffer_size, refill).restore(p.state()) if i % 5 == 0 else p
        out += p.add(i, d)
    out += p.finish()
    rows, left = py_pack(docs, cap, buffer_size, refill)
    assert [o[2] for o in out if o[6]] == rows and [o[2] for o in out if not o[6]] == ([left] if left else [])
    assert sum(map(len, docs)) == sum(len(o[2]) + o[5] for o in out)


def test_pack_matches_brute_force(spark, docs):
    merges = TK.train_bpe(docs, 256 + 9 + 4)
    bos = TK.special_id(merges, "<|bos|>")
    enc = (docs.select("doc_id", TK.encode("text", merges, prepend=bos).alias("tokens"))
           .withColumn("lane", F.col("doc_id") % 3))
    got = PK.pack_bestfit(enc, 127, buffer_size=10, refill=3, order="doc_id").collect()
    rows = sorted(enc.collect(), key=lambda r: r.doc_id)
    for lane in range(3):
        seq = [[int(x) for x in r.tokens] for r in rows if r.lane == lane]
        want, _ = py_pack(seq, 128, 10, 3)
        mine = [r.tokens for r in sorted((r for r in got if r.lane == str(lane)), key=lambda r: r.row_no)]
        assert mine == want
        assert all(len(x) == 128 and x[0] == bos for x in mine)
