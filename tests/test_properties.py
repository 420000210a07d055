"""Property tests with small example counts: each example runs Spark jobs."""

import unicodedata

import regex
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import order as O
from tessera.operators import tok as TK

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def _old_and_stable(c: str) -> bool:
    """Assigned in Unicode 3.2 with the same category today: the JVM's Unicode
    tables (older than Python's) classify it the same way."""
    old = unicodedata.ucd_3_2_0.category(c)
    return old != "Cn" and old == unicodedata.category(c)


OLD_CHARS = st.characters(blacklist_categories=("Cs",)).filter(_old_and_stable)


@SETTINGS
@given(st.lists(st.text(alphabet=OLD_CHARS, max_size=60), min_size=1, max_size=6))
def test_pretokenize_is_lossless_and_matches_python(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.p for r in df.select(TK.pretokenize("t").alias("p")).collect()]
    assert ["".join(p) for p in got] == texts
    assert got == [regex.findall(TK.SPLIT_PATTERN, t) for t in texts]


@SETTINGS
@given(st.integers(2, 60), st.integers(0, 5), st.integers(0, 10**6))
def test_fewshot_distinct_non_self(spark, n, k, seed):
    k = min(k, n - 1)
    df = spark.range(n).withColumnRenamed("id", "idx")
    rows = O.fewshot_indices(df, k, seed, n).collect()
    for r in rows:
        assert len(r.shot_idx) == k
        assert len(set(r.shot_idx)) == k
        assert r.idx not in r.shot_idx
        assert all(0 <= x < n for x in r.shot_idx)


@SETTINGS
@given(st.integers(1, 7), st.integers(1, 40))
def test_rank_strides_partition_the_data(spark, world, n):
    df = spark.range(n).withColumnRenamed("id", "idx")
    seen = []
    for rank in range(world):
        seen += [r.idx for r in O.rank_stride(df, rank, world).collect()]
    assert sorted(seen) == list(range(n))


@SETTINGS
@given(st.lists(st.integers(1, 30), min_size=1, max_size=4), st.integers(0, 1000))
def test_mixture_is_a_permutation(spark, sizes, seed):
    dfs = [spark.range(s).withColumnRenamed("id", "idx") for s in sizes]
    m = O.mix_tasks(dfs, seed=seed).collect()
    assert sorted(r.idx for r in m) == list(range(sum(sizes)))
    assert sorted((r.task_idx, r.local_idx) for r in m) == sorted((t, i) for t, s in enumerate(sizes) for i in range(s))


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 10**6)), min_size=1, max_size=40, unique=True))
def test_dense_index_is_dense_and_ordered(spark, keys):
    df = spark.createDataFrame(keys, "a int, b long")
    got = sorted((r.a, r.b, r.idx) for r in O.dense_index(df, ["a", "b"]).collect())
    assert [x[2] for x in got] == list(range(len(keys)))


@SETTINGS
@given(st.lists(st.tuples(st.text(alphabet="abcrstz", min_size=1, max_size=12), st.sampled_from("abcrxz")),
                min_size=1, max_size=8))
def test_spelling_functions_match_python(spark, pairs):
    from tessera.functions import text as T
    df = spark.createDataFrame(pairs, "w string, l string")
    rows = df.select("w", "l", T.count_letter("w", "l").alias("n"), T.spell("w").alias("s"),
                     T.counting_walkthrough("w", "l").alias("k")).collect()
    for r in rows:
        assert r.n == r.w.count(r.l)
        assert r.s == f"{r.w}:{','.join(r.w)}"
        running, lines = 0, []
        for i, ch in enumerate(r.w, 1):
            running += ch == r.l
            lines.append(f"{i}:{ch}" + (f" hit! count={running}" if ch == r.l else ""))
        assert r.k == "".join(x + "\n" for x in lines)
