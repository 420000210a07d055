import random

import pytest

import corpus_pipeline
from tessera.llm import chunk_bpe, queries
from tests.llm.helpers import vocabulary

KINDS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A documents table with junk, copies, near copies, leaks and secrets, and its benchmark."""
    r, words = random.Random(8), vocabulary(8, 3000)
    text = lambda n: " ".join(r.choice(words) + ("." if r.random() < 0.1 else "") for _ in range(n))
    items = [(i, text(30)) for i in range(8)]
    docs = [(i, text(r.randint(30, 120))) for i in range(150)]
    clean = {i for i, _ in docs}
    docs += [(200 + i, " ".join(f"{w.upper()}!!" for w in text(60).split())) for i in range(20)]
    docs += [(300 + i, " ".join(w for w in text(10).split() for _ in range(12))) for i in range(20)]
    docs += [(400 + i, docs[i][1]) for i in range(10)]
    docs += [(500 + i, docs[20 + i][1] + " " + words[i]) for i in range(10) if len(docs[20 + i][1].split()) > 40]
    docs += [(600 + i, text(40) + " " + items[i][1] + " " + text(40)) for i in range(8)]
    docs += [(700, text(30) + " password = 'Xk82hdQ01lLq' " + text(10)), (800, None), (801, ""), (None, text(50)), (4, docs[4][1])]
    path = tmp_path_factory.mktemp("pipeline")
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, KINDS).repartition(3).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path), docs, clean


def test_stages_in_order(spark, folder):
    path, docs, clean = folder
    now = spark.read.parquet(f"{path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, path)
        assert name == "bpe" or out.dtypes == now.dtypes
        rows = out.collect()
        seen[name] = rows
        if name != "bpe":
            now = spark.createDataFrame(rows, now.schema).repartition(3)
    ids = {n: [r["doc_id"] for r in rows] for n, rows in seen.items()}
    good = set(ids["quality_classifier"])
    assert clean <= good and not good & {*range(200, 220), *range(300, 320), 800, 801} and None in good
    left = ids["near_duplicates"]
    assert clean <= set(left) and len(left) == len(set(left)) and not set(left) & {*range(400, 410), *range(500, 510)}
    assert set(left) - set(ids["decontamination"]) == set(range(600, 608))
    texts = {r["doc_id"]: r["text"] for r in seen["secret_scan"]}
    assert "[SECRET]" in texts[700] and "Xk82" not in texts[700] and set(texts) == set(ids["decontamination"])
    codec = chunk_bpe.Codec.of(queries.TOKENIZER)
    assert {r["doc_id"]: r["n_tokens"] for r in seen["bpe"]} == {i: len(codec.tok.encode(t, add_special_tokens=False).ids) for i, t in texts.items()}


def test_run_gives_the_last_stage(spark, folder):
    path, _, clean = folder
    out = corpus_pipeline.run(spark, path)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert clean <= {r["doc_id"] for r in out.collect()}


def test_empty_documents(spark, folder, tmp_path):
    path, _, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, path).count() == 0


def test_columns_that_clash(spark, folder):
    """Columns named like the operators' own pass through every stage unchanged."""
    path, docs, _ = folder
    names = ["_keep", "_gone", "_score", "_posterior", "_again", "node", "component_id", "c0", "doc", "column_2"]
    rows = [(i, t, *[f"{n}{k}" for n in names]) for k, (i, t) in enumerate(docs)]
    now = spark.createDataFrame(rows, "doc_id bigint, text string, " + ", ".join(f"{n} string" for n in names)).repartition(3)
    of = {(r[0], r[1]): set() for r in rows}
    for r in rows:
        of[r[0], r[1]].add(r[2:])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, path)
        assert out.dtypes == now.dtypes, name
        kept = out.collect()
        assert kept and all(tuple(r)[2:] in of.get((r["doc_id"], r["text"]), ()) or name == "secret_scan" for r in kept)
        now = spark.createDataFrame(kept, now.schema).repartition(3)
