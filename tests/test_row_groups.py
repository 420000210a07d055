"""Footers, row groups and the corpus feed on shards with uneven row groups."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tessera.sources import corpus as C
from tessera.sources import rowgroups as R
from tessera.streaming import feed

SHARDS = {"b.parquet": [3, 1, 4], "a.parquet": [2, 5], "c.parquet": [], "d.parquet": [1, 1, 1, 1]}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("shards")
    for name, sizes in SHARDS.items():
        at = 0
        with pq.ParquetWriter(path / name, pa.schema([("other", pa.int64()), ("text", pa.string())])) as w:
            for n in sizes:
                w.write_table(pa.table({"other": pa.array(range(n)), "text": [f"{name}:{i}" for i in range(at, at + n)]}))
                at += n
    (path / "e.parquet.tmp").write_bytes(b"partial")
    return str(path)


def groups(names, epochs=(1,), world=1, rank=0):
    return [(e, names.index(n), g) for e in epochs for n in names for g in range(len(SHARDS[n])) if g % world == rank]


def test_footers(spark, folder):
    got = {r.shard: (r.starts, r.n_rows) for r in R.footers(spark, folder).collect()}
    assert got == {n: ([sum(s[:i]) for i in range(len(s))], sum(s)) for n, s in SHARDS.items()}
    assert [f.rpartition("/")[2] for f in R.shard_files("file://" + folder)] == sorted(SHARDS)


def test_scan_with_row_groups(spark, folder):
    rows = C.scan_corpus(spark, folder, row_groups=True).collect()
    want = {(n, g, i, f"{n}:{sum(s[:g]) + i}") for n, s in SHARDS.items() for g, k in enumerate(s) for i in range(k)}
    assert {(r.shard, r.row_group, r.group_pos, r.text) for r in rows} == want and len(rows) == len(want)


def run(spark, folder, progress, **options):
    """(batch, epoch, pq_idx, rg_idx, texts) of everything that a feed gives until it has nothing left."""
    out = []

    def keep(df, batch):
        by = {}
        for r in df.collect():
            by.setdefault((r.epoch, r.pq_idx, r.rg_idx), []).append((r.pos, r.text))
        out.extend((batch, *k, sorted(v)) for k, v in sorted(by.items()))
    stream = feed.corpus_feed(spark, folder, **options)
    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", str(progress)).start()
    query.processAllAvailable()
    query.stop()
    return out


def test_feed_keeps_the_order_and_resumes(spark, folder, tmp_path):
    names = sorted(SHARDS)
    first = run(spark, folder, tmp_path / "p", groups_per_batch=2, epochs=1)
    assert [x[1:4] for x in first] == groups(names)
    assert [len({x[1:4] for x in first if x[0] == b}) for b in range(max(x[0] for x in first) + 1)] == [2, 2, 2, 2, 1]
    rest = run(spark, folder, tmp_path / "p", groups_per_batch=4, epochs=3)  # resumed from the checkpoint
    assert [x[1:4] for x in rest] == groups(names, (2, 3)) and min(x[0] for x in rest) > max(x[0] for x in first)
    once = run(spark, folder, tmp_path / "q", groups_per_batch=100, epochs=3, groups_per_task=4)
    assert [x[1:] for x in once] == [x[1:] for x in first + rest]
    for _, _, shard, group, texts in once:
        start = sum(SHARDS[names[shard]][:group])
        assert texts == [(i, f"{names[shard]}:{i}") for i in range(start, start + SHARDS[names[shard]][group])]
    assert run(spark, folder, tmp_path / "q", groups_per_batch=100, epochs=3) == []


def test_feed_splits_and_ranks(spark, folder, tmp_path):
    assert [x[1:4] for x in run(spark, folder, tmp_path / "t", split="train", epochs=2)] == groups(["a.parquet", "b.parquet", "c.parquet"], (1, 2))
    assert [x[1:4] for x in run(spark, folder, tmp_path / "v", split="val", epochs=1)] == groups(["d.parquet"])
    parts = [run(spark, folder, tmp_path / f"r{r}", epochs=1, rank=r, world=3, groups_per_batch=3) for r in range(3)]
    assert [[x[1:4] for x in p] for p in parts] == [groups(sorted(SHARDS), world=3, rank=r) for r in range(3)]


def test_feed_goes_on_without_end(folder):
    reader = feed.CorpusReader({"path": folder, "groups_per_batch": "7"})
    offsets = [reader.latestOffset() for _ in range(5)]
    at = [(o["epoch"], o["pq_idx"], o["rg_idx"]) for o in offsets]
    assert at == sorted(at) and at[-1][0] == 4
    again = feed.CorpusReader({"path": folder, "groups_per_batch": "7"})
    assert again.partitions(offsets[1], offsets[2]) and again.latestOffset() == offsets[3]  # a restart plans its last batch
    empty = feed.CorpusReader({"path": folder, "split": "val", "groups_per_batch": "1"})
    empty.files = [f for f in reader.files if f.endswith("c.parquet")]
    assert empty.latestOffset() == empty.latestOffset()  # shards without row groups: nothing, rather than no end
    with pytest.raises(ValueError):
        feed.CorpusReader({"path": folder, "rank": "3", "world": "3"})
