"""Chunked per-key scans equal the single-window result; streak golden."""

from pyspark.sql import functions as F

from tessera.operators import score as S
from tessera.plans.views import v_log

SF = "/root/testdata/sf0.001"


def test_chunked_streaks_match_unchunked(spark):
    log = v_log(spark, SF)
    a = S.error_streaks(log, ["user_id"], ["ts", "event_id"], chunk_rows=3)
    b = S.error_streaks(log, ["user_id"], ["ts", "event_id"], chunk_rows=10**9)
    cols = ["user_id", "event_id", "streak", "halvings", "budget"]
    assert sorted(map(tuple, a.select(cols).collect())) == sorted(map(tuple, b.select(cols).collect()))


def test_chunked_running_accuracy(spark):
    g = v_log(spark, SF).withColumn("correct", F.col("status") == 200)
    a = S.running_accuracy(g, ["user_id"], ["ts", "event_id"], chunk_rows=2)
    b = S.running_accuracy(g, ["user_id"], ["ts", "event_id"], chunk_rows=10**9)
    cols = ["user_id", "event_id", "n_so_far", "correct_so_far"]
    assert sorted(map(tuple, a.select(cols).collect())) == sorted(map(tuple, b.select(cols).collect()))


def test_streak_golden(spark):
    rows = [(1, i, 400) for i in range(11)] + [(1, 11, 400), (1, 12, 500), (1, 13, 200), (1, 14, 400)]
    df = spark.createDataFrame(rows, "k int, t int, status int")
    r = {x.t: x for x in S.error_streaks(df, ["k"], ["t"], chunk_rows=4).collect()}
    assert (r[9].streak, r[9].halvings, r[9].budget) == (10, 0, 65536)
    assert (r[10].streak, r[10].halvings, r[10].budget) == (0, 1, 32768)
    assert (r[11].streak, r[12].streak) == (1, 1)  # another 400, then a 500 leaves the counter
    assert (r[13].streak, r[14].streak, r[14].budget) == (0, 1, 32768)  # success resets, budget stays


def test_checkpoints_go_to_the_sessions_folder(spark):
    from tessera.session import checkpoint_dir, cut_lineage
    configured = spark.conf.get("spark.checkpoint.dir", None)
    d = checkpoint_dir(spark)
    if configured:
        assert configured.rstrip("/").split("/")[-1] in d  # the cluster's setting, not a folder of our own
    df = cut_lineage(spark.range(5))
    assert df.count() == 5
