import hashlib
import zlib

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from tessera.llm import chunk_bpe, ftrl_toxicity, weak_quality
from tests.llm.helpers import documents, empty, vocabulary

PATH = public_tokenizers.path("word_bpe_49k.json")
SPECIAL = [(950, "<|startoftext|>a <|endoftext|> b<|startoftext|>" * 3), (951, "naïve café  x y 'll I'LL 12345 İß Σας"),
           (952, "z" * 5000), (953, "日本語のテキスト" * 300), (954, ("word" * 3 + "\n\n  \t") * 4000)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_and_text_equal_the_library(spark, name):
    path = public_tokenizers.path(name)
    df, rows = documents(spark, 5, SPECIAL)
    tok = Tokenizer.from_file(path)
    tok.no_truncation(), tok.no_padding()

    def want(text):
        ids = tok.encode(text or "", add_special_tokens=False).ids
        return (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in chunk_bpe.encode(df, path).collect()}
    assert got == {i: want(t) for i, t in rows}


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("texts", [[], [""], ["..."], [" "], ["1 2 3", "!?"], ["a"], ["<|endoftext|>"], ["Ärger, x's <|x", "ßẞ ǅ."], ["été." * 3, "\n"]])
def test_codec_on_few_words(name, texts):
    codec = chunk_bpe.Codec(public_tokenizers.path(name))
    want = [codec.tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in codec.encode([t.encode() for t in texts])] == want
    assert [x.tolist() for x in codec.encode([t.encode() for t in texts])] == want  # from the memo


def test_join_test_sees_a_token_over_a_word_start():
    class Joining(chunk_bpe.Codec):
        def _encode(self, texts):
            return [x[:-self.kind.itemsize] if b"two three" in t else x for t, x in zip(texts, super()._encode(texts), strict=True)]
    raw = b"zero one two three four five six"
    cuts = np.array([i for i, c in enumerate(raw) if c == 32])
    codec = Joining(PATH)
    assert chunk_bpe._joins_agree(codec, raw, cuts, [(4, 23, 0, len(raw))]).tolist() == [True] and codec.by_word
    assert chunk_bpe._joins_agree(codec, raw, cuts, [(12, 23, 0, len(raw)), (4, 18, 0, len(raw))]).tolist() == [False, True]
    assert not codec.by_word


def test_bpe_repeats_nulls_and_empty_table(spark):
    df, _ = documents(spark, 6, [(None, "a b"), (3, "c d")])
    got = chunk_bpe.encode(df, PATH)
    assert got.where("doc_id is null").count() == 1 and got.where("doc_id = 3").count() == 2
    assert chunk_bpe.encode(empty(spark), PATH).count() == 0


def _quality_rows():
    words = vocabulary(9)
    rng = np.random.default_rng(5)
    out = []
    for i in range(600):
        w = rng.choice(words, rng.integers(20, 150)).tolist()
        w = [x + ("." if rng.random() < 0.1 else "") for x in w]
        kind = i % 12
        if kind == 0:
            w = [f"{x.upper()}!!" for x in w]
        elif kind == 1:
            w = [x for x in w for _ in range(9)]
        elif kind == 2:
            w = [x + "*$#&"[j % 4] * 3 for j, x in enumerate(w)]
        out.append((i, " ".join(w), kind > 2))
    return out


def test_weak_labels_separate_junk(spark):
    rows = _quality_rows()
    df = spark.createDataFrame([(i, t, "x", "y") for i, t, _ in rows], "doc_id bigint, text string, _score string, _keep string")
    good = {i: g for i, _, g in rows}
    model = weak_quality.fit(df)
    got = weak_quality.quality(df).collect()
    assert np.mean([r["keep"] == good[r["doc_id"]] for r in got]) > 0.97
    assert 0.6 < model.prior < 0.9 and min(model.accuracies().values()) > 0.5
    kept = weak_quality.score(df.select("doc_id", "text", "_score"), model)
    assert kept.columns == ["doc_id", "text", "_score", "_score", "_posterior", "_keep"]


def test_quality_of_empty_inputs(spark):
    df, _ = documents(spark, 7, [(None, "plain words here")])
    got = {r["doc_id"]: r for r in weak_quality.quality(df).collect()}
    assert [got[i]["score"] for i in (900, 901, 902)] == [0, 0, 0] and not got[900]["keep"] and None in got
    assert weak_quality.quality(empty(spark)).count() == 0


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(1)
    truth = rng.random(20000) < 0.7
    acc, cast = np.array([0.9, 0.8, 0.85, 0.7]), 0.6
    votes = np.where(rng.random((20000, 4)) < cast, np.where((rng.random((20000, 4)) < acc) == truth[:, None], 1, -1), 0)
    patterns, count = np.unique(votes, axis=0, return_counts=True)
    prior, rates, _ = weak_quality.fit_votes(patterns, count.astype(float))
    right = (prior * rates[1, :, 2] + (1 - prior) * rates[0, :, 0]) / cast
    assert abs(prior - 0.7) < 0.05 and np.abs(right - acc).max() < 0.05


def _toxic_rows():
    words, bad = vocabulary(11), ["vilok", "gruntop"]
    rng = np.random.default_rng(6)
    out = []
    for i in range(800):
        w = rng.choice(words, rng.integers(5, 120)).tolist()
        toxic = i % 5 == 0
        if toxic:
            w.insert(int(rng.integers(len(w))), bad[i % 2])
        out.append((i, " ".join(w), int(toxic)))
    return out


def test_toxicity_on_held_out_rows(spark):
    rows = _toxic_rows()
    docs = spark.createDataFrame([(i, t, "en") for i, t, _ in rows], "doc_id bigint, text string, label string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5000, None)], "doc_id bigint, toxic int")
    got = {r["doc_id"]: r for r in ftrl_toxicity.toxicity(docs, labels).collect()}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i, r in got.items() if r["held_out"]} == set(held)
    assert np.mean([got[i]["predicted"] == rows[i][2] for i in held]) > 0.97
    assert all((r["score"] >= 0.3) == (r["predicted"] == 1) and 0 <= r["score"] <= 1 for r in got.values())
    # held-out labels are not inputs
    lies = spark.createDataFrame([(i, 1 - y if i in held else y) for i, _, y in rows], "doc_id bigint, toxic int")
    again = {r["doc_id"]: r["score"] for r in ftrl_toxicity.toxicity(docs, lies).collect()}
    assert again == {i: r["score"] for i, r in got.items()}


def test_toxicity_of_odd_inputs(spark):
    df, rows = documents(spark, 8, [(None, "a b"), (3, "c")])
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    got = ftrl_toxicity.toxicity(df, none)
    assert got.count() == len(rows) and got.where("doc_id = 900").first()["score"] == 0.5
    assert ftrl_toxicity.toxicity(empty(spark), none).count() == 0


def test_ftrl_weights_are_sparse():
    model = ftrl_toxicity.Ftrl(1000)
    rng = np.random.default_rng(2)
    for i in range(500):
        x = np.unique(rng.integers(10, 1000, 20))
        model.learn(np.append(x, i % 2), float(i % 2))
    w = model.weights()
    assert w[1] > 1 > -1 > w[0] and np.count_nonzero(w) < 300
