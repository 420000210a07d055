import hashlib
import random
import re

import numpy as np
import pytest

from tessera.llm import lsa_decontam, markov_secrets, suffix_cover
from tests.llm.helpers import documents, empty, vocabulary


def brute_repeats(rows, length):
    """Rows (doc_id, text) by doc_id; strings that start earlier are removed, as the contract states."""
    seen, out = {}, {}
    for i, text in sorted(rows):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - length + 1):
            if seen.setdefault(raw[s:s + length], (i, s)) != (i, s):
                gone[s:s + length] = True
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        out[i] = (len(raw), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("seed,length,gram", [(1, 100, 32), (2, 100, 32), (3, 40, 16)])
def test_removed_bytes_equal_brute_force(spark, seed, length, gram):
    r = random.Random(seed)
    extra = [(950, "a" * 700), (951, "ab" * 400), (952, "b" + "ab" * 300), (953, "x" * 99), (954, "x" * 100), (955, "é" * 300),
             (956, "".join(r.choice("ab") for _ in range(3000)))]
    df, rows = documents(spark, seed, extra)
    got = suffix_cover.remove_repeats(df, length, gram).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == brute_repeats(rows, length)


def test_repeats_of_odd_rows(spark):
    text = " ".join(vocabulary(2)[:60])
    df, _ = documents(spark, 4, [(None, text), (2000, text), (2000, text), (2001, text), (2000, text + "!")])
    got = suffix_cover.remove_repeats(df)
    assert got.where("doc_id is null").first()["n_removed"] == 0
    assert [r["n_removed"] for r in got.where("doc_id = 2000").collect()] == [0, 0, 0]
    assert got.where("doc_id = 2001").first()["n_removed"] == len(text.encode())
    assert suffix_cover.remove_repeats(empty(spark)).count() == 0


ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def _secret_rows():
    r = random.Random(5)
    key = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    rows = [(i, f"héllo password = '{key(r.randint(3, 20))}' and {' '.join(vocabulary(i)[:30])} {key(40)} end") for i in range(60)]
    return [*rows, (100, "secret=token: abcdefgh"), (101, "secret=token=abcdef token : 'x'"), (102, "AKIA" + "A1" * 8 + " AKIAAKIA" + "B" * 14),
            (103, "0123456789abcdef01234567g" + "deadbeef" * 3), (104, "PassWord:AKIA" + "Z" * 20 + "𝒳é token=\n123456"), (105, "Api_Key=" + "a" * 30),
            (106, ""), (107, None), (108, "secret" * 3000), (109, "-" * 60 + " token= " + "=" * 9)]


def test_base_spans_equal_python(spark):
    rows = _secret_rows()
    df = spark.createDataFrame([(i, t, "b", "s") for i, t in rows], "doc_id bigint, text string, _base string, _spans string")
    got = {r["doc_id"]: r for r in markov_secrets.report(df).collect()}
    for i, t in rows:
        spans, r = base_spans(t), got[i]
        joined = ",".join(f"{markov_secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), (i, joined, r["spans"])
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == j for _, k, _ in spans) for j in range(3)]
        assert set(joined.split(",")) - {""} <= set(r["spans"].split(","))


def test_markov_adds_random_tokens_only(spark):
    rows = _secret_rows()
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = markov_secrets.train(df)
    tests = ["x9Qz7LmP2vR8kT4wY6sB1nD3 ok", "theordinaryidentifierhasnothingrandom", " ".join(vocabulary(3)), "lomikasho" * 3 + " waruBenlo" * 4]
    got = markov_secrets.report(spark.createDataFrame(list(enumerate(tests)), "doc_id bigint, text string"), model).orderBy("doc_id").collect()
    assert [r["spans"] for r in got][0] == "markov:0:24" and not any(r["spans"] for r in got[2:])


def test_mask_keeps_columns_and_clean_rows(spark):
    df = spark.createDataFrame([(1, "a password: abcdef12 b", 22, "z"), (2, "plain", 5, "z"), (3, None, None, None)],
                               "doc_id bigint, text string, n_chars bigint, _base string")
    got = {r["doc_id"]: tuple(r) for r in markov_secrets.mask(df).collect()}
    assert got == {1: (1, "a [SECRET] b", 12, "z"), 2: (2, "plain", 5, "z"), 3: (3, None, None, None)}
    assert markov_secrets.report(empty(spark)).count() == 0 and markov_secrets.mask(empty(spark)).columns == empty(spark).columns


def _leak_tables(spark):
    r, words = random.Random(7), vocabulary(7, 3000)
    items = [(i, " ".join(r.choice(words) for _ in range(r.choice([8, 20, 35, 80]))) + ". " + " ".join(r.choice(words) for _ in range(6)) + ".") for i in range(30)]
    docs, leaks = [], set()
    for d in range(200):
        w = [r.choice(words) for _ in range(r.randint(30, 300))]
        if d % 4 == 0:
            i, text = r.choice(items)
            x = text.split()
            if d % 8 == 0:  # a paraphrase: some words of the question replaced or left out
                for _ in range(max(1, len(x) // 8)):
                    x[r.randrange(max(1, len(x) - 7))] = r.choice(words)
            at = r.randrange(len(w))
            w[at:at] = [v.upper() if d % 12 == 0 else v for v in x]
            leaks.add((d, i))
        docs.append((d, " ".join(w), 1))
    docs += [(900, None, 1), (901, "", 1), (902, "one two", 1), (None, items[3][1], 1)]
    items += [(None, "null id"), (77, None), (78, "too short"), (79, "")]
    return spark.createDataFrame(docs, "doc_id bigint, text string, item_id int").repartition(4), spark.createDataFrame(items, "item_id bigint, text string"), leaks


def test_leaks_are_found_and_clean_documents_left(spark):
    docs, items, leaks = _leak_tables(spark)
    got = {(r["doc_id"], r["item_id"]) for r in lsa_decontam.find_leaks(docs, items).collect()}
    assert got - {(None, 3)} <= leaks and len(got & leaks) >= 0.98 * len(leaks) and (None, 3) in got
    kept = lsa_decontam.decontaminate(docs, items)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {*range(200), 900, 901, 902} - {d for d, _ in got}


def test_blocks_of_items_find_the_same(spark):
    docs, items, _ = _leak_tables(spark)
    parts = list(lsa_decontam.indexes(items, docs, block=10))
    assert len(parts) > 1 and sum(len(p.ids) for p in parts) == items.where("item_id is not null and text is not null").count()


def test_exact_copies_of_many_items_equal_brute_force(spark):
    r, words = random.Random(11), vocabulary(11, 3000)
    texts = [[r.choice(words) for _ in range(r.randint(20, 59))] for _ in range(2100)]
    items = [(i, " ".join(x)) for i, x in enumerate(texts)]
    docs = []
    for d in range(700):
        w = [r.choice(words) for _ in range(r.randint(60, 200))]
        for _ in range(3):
            at = r.randrange(len(w))
            w[at:at] = r.choice(texts)
        docs.append((d, " ".join(w)))
    copies = {(d, i) for i, x in items for d, t in docs if f" {x} " in f" {t} "}
    got = lsa_decontam.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4),
                                  spark.createDataFrame(items, "item_id bigint, text string")).collect()
    lost = copies - {(r["doc_id"], r["item_id"]) for r in got}
    assert len(copies) > 1400 and not lost, (len(copies), len(lost))
    assert len(got) == len({(r["doc_id"], r["item_id"]) for r in got})


def test_copies_of_short_items_equal_brute_force(spark):
    r, rare, often = random.Random(12), vocabulary(12, 6000), vocabulary(13, 80)
    texts = [[r.choice(often) for _ in range(n)] for n in range(6, 32) for _ in range(4)]
    docs = []
    for d in range(300):
        w = [r.choice(rare if r.random() < 0.7 else often) for _ in range(r.randint(60, 200))]
        w[(at := r.randrange(len(w))):at] = texts[d % len(texts)]
        docs.append((d, " ".join(w)))
    items = [(i, " ".join(x)) for i, x in enumerate(texts)]
    copies = {(d, i) for i, x in items for d, t in docs if f" {x} " in f" {t} "}
    got = lsa_decontam.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4),
                                  spark.createDataFrame(items, "item_id bigint, text string")).collect()
    found = {(r["doc_id"], r["item_id"]) for r in got}
    assert len(copies) >= 300 and not copies - found, (len(copies), len(copies - found))


def test_no_items_or_documents(spark):
    docs, items, _ = _leak_tables(spark)
    assert lsa_decontam.find_leaks(docs, items.limit(0)).count() == 0
    assert lsa_decontam.find_leaks(empty(spark), items).count() == 0


def test_common_length():
    r = random.Random(1)
    for _ in range(200):
        a, b = ([r.randrange(4) for _ in range(r.randint(0, 12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert lsa_decontam.common_length(a, b) == best[-1][-1]


def test_basis_is_that_of_the_full_svd(spark):
    rng = np.random.default_rng(4)
    entries = []
    for _ in range(40):
        b = np.unique(rng.integers(0, 300, 25))
        w = rng.random(len(b))
        entries.append((b, w / np.linalg.norm(w)))
    basis_of, basis = lsa_decontam.latent_basis(spark, entries, rank=40)
    dense = np.zeros((40, lsa_decontam.BUCKETS))
    for i, (b, w) in enumerate(entries):
        dense[i, b] = w
    x = dense[:, basis_of >= 0]
    assert np.allclose(np.linalg.norm(x @ basis, axis=1), 1, atol=1e-4) and np.allclose(basis.T @ basis, np.eye(basis.shape[1]), atol=1e-4)
