"""Operators 11 to 13 against brute force, with nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import hard_negatives as H
from tessera.llm import oracles
from tessera.llm import quality_rules as Q
from tessera.llm import spelling_index as S
from tests.llm.helpers import documents, empty

# ---------------------------------------------------------------- 11


def near_of(words):
    """Near words by brute force."""
    out, at, known = {w: set() for w in words}, collections.defaultdict(list), set(words)
    for w in known:
        for i in range(len(w)):
            at[i, w[:i] + w[i + 1:]].append(w)
            if w[:i] + w[i + 1:] in known:
                out[w].add(w[:i] + w[i + 1:])
                out[w[:i] + w[i + 1:]].add(w)
    for group in at.values():
        for w in group:
            out[w].update(x for x in group if x != w)
    return out


def variants_of(rows):
    counts = collections.Counter()
    for i, t in rows:
        for run in re.findall("[a-zÀ-ÿ]+", (t or "").translate(str.maketrans(S.UPPER, S.LOWER))):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[:h % len(run)] + run[h % len(run) + 1:] if h % S.DROP_EVERY == 0 else run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}
    near, form = near_of(n), {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])
    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


@pytest.mark.parametrize(("letters", "queries"), [(1 << 18, 1 << 16), (60, 7)])
def test_near_words(spark, letters, queries):
    r = random.Random(4)
    words = {"".join(r.choice("abÿé") for _ in range(r.choice([2, 3, 4, 5, 6, 9]))) for _ in range(400)}
    words |= {"z" * 5_000, "z" * 4_999, "z" * 2_000 + "é" + "z" * 2_999, "abab" * 500, "abab" * 500 + "a"}
    df = spark.createDataFrame([(w, len(w)) for w in sorted(words)], "word string, n bigint").repartition(3)
    got = S.near_words(df, letters, queries).collect()
    assert len(got) == len({(r.word, r.near) for r in got}) and all(r.near_n == len(r.near) for r in got)
    assert {(r.word, r.near) for r in got} == {(w, x) for w, near in near_of(words).items() for x in near}


def test_index_steps_over_words_that_extend_each_other():
    words = ["a", "aa", "aaa", "aab", "ab", "b", "ba"]
    index = S.Index(words)
    q, w = index.search(["aab", "zab", "aaaa"], np.array([2, 2, 3]))
    assert {(int(i), index.words[j]) for i, j in zip(q, w)} == {(0, "ab"), (1, "ab"), (1, "aab"), (2, "aaa")}


def test_variants(spark):
    r = random.Random(9)
    stems = ["colour", "Behaviour", "straßen", "naïveté", "printing", "prints"]
    forms = [s for s in stems for _ in range(40)] + [s[:i] + s[i + 1:] for s in stems for i in range(len(s)) for _ in range(r.choice([2, 3, 9]))]
    rows = [(i, " ".join(r.choice(forms) for _ in range(r.choice([0, 3, 60])))) for i in range(80)]
    rows += [(None, "Colour colour COLOUR"), (200, None), (201, ""), (202, "1 2 3"), (203, "x" * 1_200_000 + " colour"), (5, rows[5][1]), (5, rows[5][1])]
    rows += [(300 + i, "chainlet " * 3 + "chainletz " + "chainletzz " * (i % 2) + "chainletzzz" * (i % 4 == 0)) for i in range(24)]
    docs = spark.createDataFrame([(i, t, 1, "w") for i, t in rows], "doc_id bigint, text string, n int, word string").repartition(4)
    got = {tuple(r) for r in S.variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == variants_of(rows) and any(f and x != f for _, f, x, *_ in got)
    assert {tuple(r) for r in S.variants(docs, letters=40, queries=5).select("word", "form", "root", "n", "n_near", "form_n").collect()} == got
    assert S.variants(empty(spark)).count() == 0


# ---------------------------------------------------------------- 12


def measures_of(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at, covered = collections.defaultdict(list), set()
    for i in range(len(words) - 7):
        at[tuple(words[i:i + 8])].append(i)
    for places in at.values():
        if len(places) > 1:
            covered.update(j for i in places for j in range(i, i + 8))
    n = len(words)
    base = n < 20 or 100 * len(covered) > 30 * n
    sym, chars, upper = sum(c in "#*$%&|<>" for c in text), sum(map(len, words)), sum(c.isupper() for c in text)
    dup, letters = len(lines) - len(set(lines)), sum(any(c.isalpha() for c in w) for w in words)
    bad = (100 * sym > 10 * n or chars < 3 * n or chars > 10 * n or 100 * dup > 50 * len(lines) or 100 * upper > 50 * chars or 100 * letters < 80 * n
           or 100 * sum(c in "0123456789" for c in text) > 30 * chars or 100 * sum(a == b for a, b in zip(words, words[1:])) > 30 * n
           or 100 * sum(bool(re.search(r"(\.\.\.|…)[\x20\x09-\x0D]*$", x)) for x in lines) > 30 * len(lines))
    return n, chars, sym, dup, len(covered), base, not base and not bad


def rule_texts():
    r = random.Random(2)
    w = ["".join(r.choice("abcdeéou") for _ in range(r.randint(2, 8))) for _ in range(300)]
    say = lambda n: " ".join(r.choice(w) for _ in range(n))
    run = say(8)
    return [say(400), say(19), say(20), f"{say(30)} {run} {say(9)} {run}", f"{run} {run} {run} {say(60)}", "a " * 40, say(60).upper(), "# " + say(25).replace(" ", " ## "),
            "\n".join([say(6)] * 9 + [say(9)]), "\n".join([say(9)] * 3 + [say(9) for _ in range(7)]), "\n \n\n".join(say(9) for _ in range(6)),
            "12345 77 " * 10 + say(6), " ".join(x for x in say(30).split() for _ in range(3)), "\n".join(say(9) + "..." for _ in range(6)),
            "\n".join(say(9) + "… " for _ in range(6)), "x" * 400 + " " + say(30), "\x0b\x0c\r" + say(25) + "\r\n", f"{run} " * 200, "  " * 30,
            say(9_000) + "\n" + run + "\n" + run, say(250_000)]


def test_measures_and_verdicts(spark):
    rows = [*enumerate(rule_texts()), (900, None), (901, ""), (902, " \n\n "), (None, rule_texts()[0]), (3, rule_texts()[3]), (3, rule_texts()[3])]
    docs = spark.createDataFrame([(i, t, "k", 5) for i, t in rows], "doc_id bigint, text string, kept string, n_words int").repartition(3)
    got = sorted((tuple(r) for r in Q.judge(docs).collect()), key=str)
    assert got == sorted(((i, *measures_of(t)) for i, t in rows), key=str)
    assert 3 < sum(r[-1] for r in got) < len(got) - 8
    left = Q.keep(docs)
    assert left.columns == docs.columns
    assert sorted(map(tuple, left.select("doc_id", "text").collect()), key=str) == sorted(((i, t) for i, t in rows if measures_of(t)[-1]), key=str)
    assert Q.judge(empty(spark)).count() == 0 and Q.keep(empty(spark)).count() == 0


def test_order_of_the_cascade(spark):
    df = spark.range(0, 200, numPartitions=1).withColumn("text", F.repeat(F.concat(F.col("id").cast("string"), F.lit(" ")), 2_000))
    rules = {"slow": F.col("id") < 100, "none": F.lit(False), "quick": F.col("id") < 99, "covered": F.col("id") < 50, "null": F.lit(None).cast("boolean")}
    order = [(name, n) for name, _, n in Q.plan(df, rules, {"slow": 0.9, "none": 0.2, "quick": 0.1, "covered": 0.1, "null": 0.5})]
    assert order == [("quick", 99), ("covered", 0), ("none", 0), ("slow", 1), ("null", 0)]
    heavy = F.char_length(F.regexp_replace(F.repeat("text", 20), "([0-4]|[5-9])+ ", "")) < 0
    cost = Q.costs(df, {"light": F.col("id") < 9, "heavy": heavy})
    assert cost["heavy"] > cost["light"] > 0
    assert {name for name, _, _ in Q.plan(df, rules)} == set(rules)
    first = df.select(Q.cascade(rules, [n for n, _ in order]).alias("r")).groupBy("r").count().collect()
    assert {r["r"]: r["count"] for r in first} == {"quick": 99, "slow": 1, None: 100}
    # a rule after one that rejects is not evaluated
    fail = {"first": F.col("id") >= 0, "broken": F.raise_error(F.lit("evaluated")).cast("boolean")}
    assert df.where(Q.cascade(fail, ["first", "broken"]).isNull()).count() == 0
    assert Q.plan(df.limit(0), rules) == [(n, 0.0, 0) for n in rules]


# ---------------------------------------------------------------- 13


def negatives_of(rows, positives=5, negatives=10, every=100):
    best = {}
    for v, label, x in rows:
        if v is None or label is None or x is None or any(c is None or not np.isfinite(c) for c in x):
            continue
        best[v] = min(best.get(v, (label, x)), (label, x))
    dims = max((len(x) for _, x in best.values()), default=0)
    ids = np.array(sorted(best))
    label = np.array([(best[v][0] + 1) % 10 if v % 7 == 0 else best[v][0] for v in ids.tolist()])
    x = np.array([[np.floor(256 * np.float64(c)) for c in best[v][1]] + [0.0] * (dims - len(best[v][1])) for v in ids.tolist()])
    out = []
    for a in np.flatnonzero(ids % every == 0):
        score = x @ x[a]
        order = np.lexsort((ids, -score))
        for p in [i for i in order if label[i] == label[a] and i != a][:positives]:
            fits = [i for i in order if label[i] != label[a] and 30 * score[p] <= 100 * score[i] <= 90 * score[p]]
            out += [(int(ids[a]), int(ids[p]), k, int(ids[i]), int(score[p]), int(score[i])) for k, i in enumerate(fits[:negatives], 1)]
    return sorted(out)


def vectors():
    r = np.random.default_rng(3)
    rows = [(i, int(r.integers(0, 4)), r.normal(0, 0.3, 12).round(2).tolist()) for i in range(900)]
    hot = r.normal(0, 0.3, 12).round(2).tolist()
    rows += [(1_000 + i, i % 3, hot) for i in range(400)]  # ties in every window
    rows += [(2_000, 77, hot), (2_100, None, hot), (2_101, 1, None), (2_102, 1, [None, *hot[1:]]), (2_103, 1, [float("nan"), *hot[1:]]),
             (2_104, 1, [float("inf"), *hot[1:]]), (2_200, 1, []), (2_201, 2, hot[:3]), (2_300, 2, [0.0] * 12), (None, 1, hot),
             (300, 3, [-x for x in hot]), (300, 3, [-x for x in hot]), (301, 1, hot)]
    return rows


@pytest.mark.parametrize("sizes", [{}, {"block_rows": 90, "block_anchors": 3}])
def test_hard_negatives(spark, sizes):
    df = spark.createDataFrame([(v, x, label, 1, "w") for v, label, x in vectors()],
                               "vec_id bigint, embedding array<double>, label int, score int, win string").repartition(5)
    got = sorted(tuple(r) for r in H.mine(df, **sizes).collect())
    assert got == negatives_of(vectors()) and len(got) > 300
    assert H.mine(df, 3, 4, 50, **sizes).count() == len(negatives_of(vectors(), 3, 4, 50))
    assert H.mine(df.limit(0)).collect() == [] and H.mine(df.where("vec_id = 200")).collect() == []


def test_joined_prunes_and_loses_nothing():
    r = np.random.default_rng(1)
    x = np.floor(r.normal(0, 40, (700, 32)) * np.geomspace(4, 0.02, 32))  # most of the norm in the first dimensions
    q = x[::70]
    score = q @ x.T
    for share in (0.5, 0.9, 0.999):
        low = np.quantile(score, share, axis=1)
        high = np.quantile(score, share + (1 - share) * 0.9, axis=1)
        got = {(int(a), int(b), float(s)) for i, j, s in H.joined(x, q, low, high) for a, b, s in zip(i, j, s, strict=True)}
        assert got == {(int(a), int(b), float(score[a, b])) for a, b in zip(*np.nonzero((score >= low[:, None]) & (score <= high[:, None])), strict=True)}


def test_queries_equal_their_sql(spark):
    docs, rows = documents(spark, 5)
    con = duckdb.connect()
    con.register("documents", docs.where("doc_id is not null").select("doc_id", "text").toPandas())
    for name, df in (("op11_spelling_index", S.variants(docs)), ("op12_quality_rules", Q.judge(docs))):
        sql = con.sql(oracles.ORACLE[name])
        assert sorted(map(tuple, df.select(*sql.columns).collect()), key=str) == sorted(sql.fetchall(), key=str)
