"""Tokenizer and packing: Python cross-checks and the packing golden."""

import regex
from pyspark.sql import functions as F

from tessera.operators import ext as X
from tessera.operators import pack as PK
from tessera.operators import tok as TK
from tessera.streaming import flows as FL

TEXTS = ["Hello world, it's 2024!\n\n  Numbers 12345 and   spaces\t\r\n end",
         "Ünïcödé text — with 'quotes' and you'll we've 3.14159", "", "   ", "a\r\nb"]


def test_pretokenize_matches_python_regex(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    got = [r.p for r in df.select(TK.pretokenize("text").alias("p")).collect()]
    want = [regex.findall(TK.SPLIT_PATTERN, t) for t in TEXTS]
    assert got == want
    assert all("".join(p) == t for p, t in zip(got, TEXTS))


def test_train_encode_decode(spark):
    df = spark.createDataFrame([("the cat the hat the bat " * 20,), ("that thing there",)], "text string")
    merges = TK.train_bpe(df, 256 + 9 + 5)
    assert len(merges) == 5
    toks = TK.token_bytes_list(merges)
    assert toks[256] in (b"th", b"he", b"at", b" t")
    r = df.select(TK.encode("text", merges).alias("ids")).select(TK.decode("ids", merges).alias("t")).collect()
    assert [x.t for x in r] == ["the cat the hat the bat " * 20, "that thing there"]
    v = TK.vocab_table(spark, merges)
    assert v.count() == 256 + 5 + 9
    assert v.where("is_special").agg(F.max("n_bytes")).first()[0] == 0


def test_pack_golden(spark):
    docs = [(0, 0, [1] * 5), (0, 1, [2] * 3), (0, 2, [3] * 6), (0, 3, [4] * 4)]
    df = spark.createDataFrame(docs, "lane long, idx long, tokens array<int>")
    rows = PK.pack_bestfit(df, 7, buffer_size=4, refill=1).orderBy("row_no").collect()
    assert rows[0].tokens == [3] * 6 + [2] * 2
    assert rows[1].tokens == [1] * 5 + [4] * 3
    assert all(len(r.tokens) == 8 for r in rows)


def test_render_mask_golden(spark):
    merges = []
    msgs = [("user", "hi", None),
            ("assistant", None, [("text", "ok"), ("python", "1+1"), ("python_output", "2"), ("text", "!")])]
    df = spark.createDataFrame([(1, [(r, t, p) for r, t, p in msgs])],
                               "conv_id int, messages array<struct<role:string,text:string,"
                               "parts:array<struct<type:string,text:string>>>>")
    r = TK.render_conversation(df, merges).first()
    sid = lambda n: TK.special_id(merges, n)
    b = lambda s: list(s.encode())
    want_ids = ([sid("<|bos|>"), sid("<|user_start|>")] + b("hi") + [sid("<|user_end|>"), sid("<|assistant_start|>")]
                + b("ok") + [sid("<|python_start|>")] + b("1+1") + [sid("<|python_end|>"), sid("<|output_start|>")]
                + b("2") + [sid("<|output_end|>")] + b("!") + [sid("<|assistant_end|>")])
    want_mask = [0, 0, 0, 0, 0, 0, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 1, 1]
    assert r.ids == want_ids
    assert r.mask == want_mask
    c = TK.render_for_completion(df, merges).first()
    assert c.ids == [sid("<|bos|>"), sid("<|user_start|>")] + b("hi") + [sid("<|user_end|>"), sid("<|assistant_start|>")]


def test_stream_pack_equals_batch(spark):
    """Several files a micro-batch, tiny Arrow batches: the stream's rows are the batch form's complete rows,
    up to what still stands in the buffers at the end."""
    import tempfile
    rows = [(i % 2, i, [i % 7 + 1] * (3 + (i * 5) % 11), i // 10, 1) for i in range(200)]
    df = spark.createDataFrame(rows, "lane long, idx long, tokens array<int>, rg_idx long, epoch long")
    src = tempfile.mkdtemp(prefix="tessera-pack-")
    df.where("idx < 90").repartition(5).write.parquet(f"{src}/a")
    df.where("idx >= 90").repartition(5).write.parquet(f"{src}/b")
    every = PK.pack_bestfit(df, 15, buffer_size=6, refill=2, incomplete=True).collect()
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 5).parquet(f"{src}/*")
        got = FL.run_available(spark, PK.stream_pack(stream, 15, buffer_size=6, refill=2)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for lane in ("0", "1"):
        want = [(r.row_no, r.tokens, r.last_idx, r.rg_idx, r.epoch) for r in sorted(every, key=lambda r: r.row_no) if r.lane == lane and r.complete]
        mine = [(r.row_no, r.tokens, r.last_idx, r.rg_idx, r.epoch) for r in sorted(got, key=lambda r: r.row_no) if r.lane == lane]
        assert mine == want[:len(mine)] and len(want) - 4 <= len(mine) > 0
        docs = [r for r in rows if r[0] == int(lane)]
        assert sum(len(r[2]) for r in docs) == sum(len(r.tokens) + r.n_cropped for r in every if r.lane == lane)


def test_stream_pack_writes_what_is_new(spark, tmp_path):
    """State writes follow the new documents, not the size of the buffer."""
    schema = "lane long, idx long, tokens array<int>"
    for name, ids in (("a", range(600)), ("b", range(600, 612)), ("c", range(612, 624))):
        spark.createDataFrame([(i % 2, i, [i] * (1 + i % 50)) for i in ids], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "src"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "src"))
    query = (PK.stream_pack(stream, 99, buffer_size=250, refill=3).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "p"))
             .trigger(availableNow=True).start())
    query.awaitTermination()
    state = [p["stateOperators"][0] for p in query.recentProgress if p["numInputRows"]]
    assert state[0]["numRowsTotal"] > 900
    for s in state[1:]:
        assert s["numRowsUpdated"] + s["numRowsRemoved"] < 120, s


def test_short_documents_do_not_stop_the_packer(spark):
    df = spark.createDataFrame([("a", i, [1, 2, 3]) for i in range(64)], "lane string, idx long, tokens array<int>")
    rows = PK.pack_bestfit(df, 64, buffer_size=16, refill=4, incomplete=True).orderBy("row_no").collect()
    assert [len(r.tokens) for r in rows] == [65, 65, 60] and [r.complete for r in rows] == [True, True, False]
    assert sum(r.n_cropped for r in rows) == 2


def test_table_forms_equal_the_column_forms(spark):
    rows = list(enumerate([*TEXTS, None]))
    df = spark.createDataFrame(rows, "id long, text string")
    merges = TK.train_bpe(df.where("text is not null"), 256 + 9 + 12)
    ids = TK.encode_table(df, merges, "id", prepend="<|bos|>", append=7)
    want = {r.id: r.ids for r in df.select("id", TK.encode("text", merges, "<|bos|>", 7).alias("ids")).collect()}
    assert {r.id: r.ids for r in ids.collect()} == want
    plain = TK.encode_table(df, merges, "id")
    back = {r.id: r.text for r in TK.decode_table(plain, TK.vocab_table(spark, merges), "id").collect()}
    assert back == {i: t or "" for i, t in rows}
    broken = spark.createDataFrame([(1, [104, 255, 105])], "id long, ids array<int>")
    assert TK.decode_table(broken, TK.vocab_table(spark, merges), "id").first().text == "h\ufffdi"
    tok = X.bpe_tokenizer(merges)
    assert tok.encode_batch([TEXTS[1]])[0] == want[1][1:-1] and tok.decode(want[1][1:-1]) == TEXTS[1]


def test_byte_tokens_need_no_split(spark):
    df = spark.createDataFrame([(1, "It's 1234  é\n"), (2, None), (3, "")], "id int, text string")
    ids = TK.encode_table(df, [], "id", prepend="<|bos|>")
    assert "regexp" not in ids._jdf.queryExecution().analyzed().toString().lower()
    assert {r.id: r.ids for r in ids.collect()} == {1: [256, *"It's 1234  é\n".encode()], 2: [256], 3: [256]}
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= 8 << 20


def test_a_registered_tokenizer_gets_bounded_runs(spark, monkeypatch):
    from tessera.operators import ext as X
    assert list(X.runs_of(["ab", "c", "defg", "", "h"], 3)) == [["ab", "c"], ["defg"], ["", "h"]] and list(X.runs_of([], 3)) == []
    spec = X.bpe_tokenizer([(97, 98)])
    df = spark.createDataFrame([(1, "abé"), (2, None), (3, "")], "id int, text string").coalesce(1)
    got = df.select("id", X.encode_with("text", spec, prepend=7).alias("ids"))
    assert {r.id: r.ids for r in got.collect()} == {1: [7, 256, 195, 169], 2: [7], 3: [7]}


def test_a_feed_of_many_files_keeps_lanes_in_order(spark, tmp_path, monkeypatch):
    from tessera.plans import q_tok3 as Q
    docs = spark.createDataFrame([(i, f"text {i} " * (i % 90)) for i in range(700)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    key = lambda df: sorted((r.lane, r.row_no, r.tokens_md5, r.last_idx) for r in df.collect())
    few = key(Q.stream_pack_rows(spark, str(tmp_path)))
    monkeypatch.setattr(Q, "FILE_ROWS", 60)
    monkeypatch.setattr(Q, "TRIGGER_FILES", 2)
    assert few and key(Q.stream_pack_rows(spark, str(tmp_path))) == few
