"""Corpus supply: resume semantics against a simulation of the reader, and edge cases."""

from pyspark.sql import functions as F

from tessera.operators import order as O
from tessera.sources import corpus as C


def simulate(shard_groups, pq, rg, epoch, rank, world, epochs):
    """Row groups a rank reads after the saved position, in the reader's own order:
    in the saved shard restart at the block after the saved group; later shards
    and epochs start at the rank; only groups of this rank are read."""
    out = []
    for e in range(epoch, epoch + epochs):
        first_pass = e == epoch
        for s in range(pq if first_pass else 0, len(shard_groups)):
            if first_pass and s == pq:
                start = (rg // world + 1) * world + rank
            else:
                start = rank
            out += [(e, s, g) for g in range(start, shard_groups[s], world)]
    return out


def test_resume_after_matches_reader_simulation(spark):
    groups = [5, 3, 8, 1, 6]
    rows = [(s, g) for s, n in enumerate(groups) for g in range(n)]
    df = spark.createDataFrame(rows, "shard_idx int, row_group int")
    for (pq, rg, ep, rank, world) in [(0, 0, 1, 0, 2), (2, 3, 1, 1, 2), (1, 2, 2, 0, 3), (4, 5, 1, 1, 2), (3, 0, 1, 0, 1)]:
        e = C.repeat_epochs(df, ep + 1)  # epochs 1..ep+1; the simulation covers ep .. ep+1
        got = sorted((r.epoch, r.shard_idx, r.row_group) for r in C.resume_after(e, pq, rg, ep, rank, world).collect())
        want = sorted(x for x in simulate(groups, pq, rg, ep, rank, world, 2))
        assert got == want, (pq, rg, ep, rank, world)


def test_split_with_one_shard_has_empty_train(spark):
    df = spark.createDataFrame([("shard_00000.parquet", "a"), ("shard_00000.parquet", "b")], "shard string, text string")
    assert C.split_corpus(df, "train").count() == 0
    assert C.split_corpus(df, "val").count() == 2


def test_shard_manifest_all_and_present(spark):
    m = C.shard_manifest(spark, -1, 4)
    assert sorted(r.shard_id for r in m.collect()) == [0, 1, 2, 3, 4]
    present = spark.createDataFrame([("shard_00001.parquet",), ("shard_00009.parquet",)], "shard string")
    got = sorted(r.shard for r in C.shard_manifest(spark, 2, 9, present).collect())
    assert got == ["shard_00000.parquet"]  # first 2 train shards + the val shard, minus present ones


def test_limit_problems_null_or_nonpositive_keeps_all(spark):
    df = spark.range(10).withColumnRenamed("id", "idx")
    assert O.limit_problems(df, None).count() == 10
    assert O.limit_problems(df, 0).count() == 10
    assert O.limit_problems(df, -3).count() == 10
    assert O.limit_problems(df, 4).count() == 4


def test_scan_corpus_skips_partial_files(spark, tmp_path):
    d = tmp_path / "corpus"
    spark.createDataFrame([("x",), ("y",)], "text string").coalesce(1).write.parquet(str(d / "a"))
    (d / "a" / "junk.parquet.tmp").write_bytes(b"not parquet")
    s = C.scan_corpus(spark, str(d / "a"), rows_per_group=1)
    assert sorted(r.text for r in s.collect()) == ["x", "y"]
    assert set(s.columns) == {"shard", "pos", "text", "row_group"}
    assert s.agg(F.max("pos")).first()[0] == 1
