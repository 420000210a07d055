"""Fixture views over the driver tables (FIXTURES.md part 2), in Spark.

Each view is a deterministic projection; random draws are
``md5(concat(seed, ':', key))`` so DuckDB reproduces them exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.tables import table


def md5_draw(seed, key: Column, hex_digits: int = 8) -> Column:
    """Deterministic non-negative integer from md5(seed:key)."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return F.conv(F.substring(h, 1, hex_digits), 16, 10).cast("bigint")


def v_letter_scores(spark: SparkSession, sf: str) -> DataFrame:
    """embeddings: letter A..J scores the largest of the dimensions d with d % 10 its index; gold = label."""
    e = table(spark, sf, "embeddings")

    def score(k):
        return F.array_max(F.filter("embedding", lambda x, d: d % 10 == k))
    scores = F.array(*[score(k) for k in range(10)])
    return (e.select(F.col("vec_id").alias("item_id"), F.col("label").alias("gold"),
                     F.posexplode(scores).alias("letter_idx", "score"))
            .select("item_id", "gold", "letter_idx",
                    F.expr("char(65 + letter_idx)").alias("letter"),
                    F.col("score").cast("double").alias("score")))


def v_corpus(spark: SparkSession, sf: str, rows_per_group: int = 8) -> DataFrame:
    """documents as a sharded corpus: shard = source, pos = rank of doc_id in the
    shard, row_group = pos div 8, idx = dense index by (shard, doc_id)."""
    from tessera.operators.order import dense_index
    from tessera.plans.guards import broadcast_small
    from tessera.session import cut_lineage
    d = table(spark, sf, "documents").select(F.col("source").alias("shard"), "doc_id", "text", "lang")
    g = dense_index(d.select("shard", "doc_id"), ["shard", "doc_id"])  # texts are not sorted, and written once below
    starts = g.groupBy("shard").agg(F.min("idx").alias("_s"))  # partial aggregate per shard
    v = (g.join(broadcast_small(starts, "shards"), "shard").withColumn("pos", F.col("idx") - F.col("_s")).drop("_s")
         .withColumn("row_group", (F.col("pos") / rows_per_group).cast("bigint")))
    return cut_lineage(v.join(d.select("doc_id", "text", "lang"), "doc_id"))  # read by several branches of most queries


def v_part_idx(spark: SparkSession, sf: str) -> DataFrame:
    """part with a dense idx by p_partkey."""
    from tessera.operators.order import dense_index
    return dense_index(table(spark, sf, "part"), "p_partkey")


def v_supplier_idx(spark: SparkSession, sf: str) -> DataFrame:
    from tessera.operators.order import dense_index
    return dense_index(table(spark, sf, "supplier"), "s_suppkey")


def v_gsm(spark: SparkSession, sf: str, keys=("l_orderkey", "l_linenumber")) -> DataFrame:
    """lineitem as GSM8K-style problems: two ``<<a*b=c>>`` calls and ``#### n``;
    the completion is right (0), wrong (1) or missing (2) by ``l_orderkey % 3``;
    right answers on line 1 end with ``.`` (kept, so they grade wrong)."""
    return table(spark, sf, "lineitem").select(*keys, *gsm_columns())


def gsm_columns():
    q = F.col("l_quantity").cast("bigint").cast("string")
    ln = F.col("l_linenumber").cast("string")
    a = (F.col("l_quantity").cast("bigint") * F.col("l_linenumber"))
    b = a * 2
    answer = F.concat(F.lit("We have "), q, F.lit(" x "), ln, F.lit(" = <<"), q, F.lit("*"), ln, F.lit("="),
                      a.cast("string"), F.lit(">>"), a.cast("string"), F.lit(" units.\nDoubled: <<"),
                      a.cast("string"), F.lit("*2="), b.cast("string"), F.lit(">>"), b.cast("string"),
                      F.lit(".\n#### "), b.cast("string"))
    m = F.col("l_orderkey") % 3
    completion = (F.when(m == 0, F.concat(F.lit("So the answer is\n#### "), F.format_number(b, 0),
                                          F.when(F.col("l_linenumber") == 1, F.lit(".")).otherwise(F.lit(""))))
                  .when(m == 1, F.concat(F.lit("#### "), (b + 1).cast("string")))
                  .otherwise(F.lit("I am not sure.")))
    return [F.concat(F.lit("Order "), F.col("l_orderkey").cast("string"), F.lit(" line "), ln,
                     F.lit(": how many units?")).alias("question"),
            answer.alias("answer"), completion.alias("completion")]


def v_mc(spark: SparkSession, sf: str) -> DataFrame:
    """part as four-choice questions; answer = md5 draw mod 4; subject = p_type."""
    p = table(spark, sf, "part")
    choices = F.array(F.col("p_brand"), F.col("p_type"), F.concat(F.lit("size "), F.col("p_size").cast("string")),
                      F.col("p_name"))
    return p.select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("question"),
                    choices.alias("choices"), F.array(*[F.lit(x) for x in "ABCD"]).alias("letters"),
                    (md5_draw(42, F.col("p_partkey")) % 4).cast("int").alias("answer"),
                    F.col("p_type").alias("subject"), "p_size")


def v_letters(spark: SparkSession, sf: str) -> DataFrame:
    """v_mc completions by ``item_id % 4``: 'The best answer is (X)', '(A) or (X)',
    lower case, and none; X is right when ``p_size`` is even."""
    m = v_mc(spark, sf)
    gold = F.expr("char(65 + answer)")
    said = F.expr("char(65 + (answer + p_size % 2) % 4)")
    k = F.col("item_id") % 4
    completion = (F.when(k == 0, F.concat(F.lit("The best answer is ("), said, F.lit(")")))
                  .when(k == 1, F.concat(F.lit("It is (A) or ("), said, F.lit(")")))
                  .when(k == 2, F.concat(F.lit("the best answer is "), F.lower(said)))
                  .otherwise(F.lit("No idea.")))
    return m.select("item_id", "subject", gold.alias("gold"), completion.alias("completion"))


def v_math(spark: SparkSession, sf: str) -> DataFrame:
    """orders as MATH problems: answer = total price as '1,234'; five completion
    forms by ``o_orderkey % 5`` (boxed sentence, late \\boxed, bare $X$, no box, empty box)."""
    o = table(spark, sf, "orders")
    v = F.round("o_totalprice").cast("bigint")
    vs = v.cast("string")
    k = F.col("o_orderkey") % 5
    answer = F.format_number(v, 0)
    completion = (F.when(k == 0, F.concat(F.lit("Final Answer: The final answer is $\\boxed{"), answer,
                                          F.lit("}$. I hope it is correct.")))
                  .when(k == 1, F.concat(F.lit("so x = "), vs, F.lit(" and \\boxed{"), vs, F.lit(" dollars}")))
                  .when(k == 2, F.concat(F.lit("Final Answer: The final answer is $"), vs, F.lit("$. I hope")))
                  .when(k == 3, F.concat(F.lit("The total is \\text{"), (v + 1).cast("string"), F.lit("}")))
                  .otherwise(F.lit("Final Answer: The final answer is $\\boxed{}$. I hope")))
    return o.select(F.col("o_orderkey").alias("item_id"),
                    F.concat(F.lit("What is the total of order "), F.col("o_orderkey").cast("string"), F.lit("?")).alias("problem"),
                    answer.alias("answer"), completion.alias("completion"),
                    F.col("o_orderpriority").alias("subject"), ((F.col("o_orderkey") % 5) + 1).cast("int").alias("level"))


def v_code(spark: SparkSession, sf: str) -> DataFrame:
    """part as code problems with six completion forms by ``p_partkey % 6``."""
    p = table(spark, sf, "part")
    fn = F.concat(F.lit("f_"), F.col("p_partkey").cast("string"))
    sz = F.col("p_size").cast("string")
    prompt = F.concat(F.when(F.col("p_partkey") % 2 == 1, F.lit("# header\n\nimport os\n")).otherwise(F.lit("")),
                      F.lit("import math\nfrom typing import List\n\n# helper\ndef "), fn, F.lit("(x):\n    \"\"\""),
                      F.col("p_name"), F.lit("\"\"\"\n"))
    k = F.col("p_partkey") % 6
    completion = (F.when(k == 0, F.concat(F.lit("Here:\n```python\ndef "), fn, F.lit("(x):\n    return x * "), sz,
                                          F.lit("\n```\nDone.")))
                  .when(k == 1, F.concat(F.lit("```\ndef "), fn, F.lit("(x):\n    return x\n```")))
                  .when(k == 2, F.concat(F.lit("```python\ndef "), fn, F.lit("(x):\n    return 1\n")))
                  .when(k == 3, F.concat(F.lit("def "), fn, F.lit("(x):\n    return 2")))
                  .when(k == 4, F.lit("```python\n```"))
                  .otherwise(F.lit("   ")))
    t1 = F.concat(F.lit("assert "), fn, F.lit("(1) == 1"))
    t2 = F.concat(F.lit("assert "), fn, F.lit("(2) == 2"))
    imports = F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("import math"))).otherwise(F.array().cast("array<string>"))
    return p.select(F.col("p_partkey").alias("item_id"), prompt.alias("prompt"), completion.alias("completion"),
                    fn.alias("entry_point"), F.lit("def check(c):\n    assert c(1) is not None").alias("test"),
                    F.array(t1, t2).alias("test_list"), imports.alias("test_imports"))


def v_words(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct lower-case words (runs of Unicode letters) of all documents, dense idx by word."""
    from tessera.operators.order import dense_index
    d = table(spark, sf, "documents")
    w = d.select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+", -1)).alias("word")).where(F.col("word") != "").distinct()
    return dense_index(w, "word")


def v_conv_rows(spark: SparkSession, sf: str) -> DataFrame:
    """conversations with data-derived defects: for conv % 7 == 3 turn 1 is a user's, for conv % 13 == 4 the
    turns after 1 are one too high (a gap), conv % 11 == 5 starts with an assistant, and for conv % 5 == 0
    multi-line assistant texts play list (parts) content.  No turn is left out."""
    c = table(spark, sf, "conversations")
    turn, k = F.col("turn"), F.col("conv_id")
    c = c.withColumn("role", F.when((k % 11 == 5) & (turn == 0), F.lit("assistant")).when((k % 7 == 3) & (turn == 1), F.lit("user"))
                     .otherwise(F.col("role")))
    c = c.withColumn("turn", F.when((k % 13 == 4) & (turn > 1), turn + 1).otherwise(turn))
    return c.withColumn("is_parts", (F.col("conv_id") % 5 == 0) & (F.col("role") == "assistant")
                        & F.col("text").contains("\n"))


def v_icl_base(spark: SparkSession, sf: str) -> DataFrame:
    """benchmark split at the first '. ': query/context before, continuation after."""
    from tessera.operators.order import dense_index
    b = table(spark, sf, "benchmark")
    q = F.substring_index("text", ". ", 1)
    cont = F.when(F.instr("text", ". ") > 0, F.col("text").substr(F.length(q) + 3, F.lit(1 << 30))).otherwise(F.lit(""))
    return dense_index(b.select("item_id", q.alias("query"), cont.alias("continuation")), "item_id")


def v_icl_mc(spark, sf):
    b = v_icl_base(spark, sf)
    return b.select("idx", "item_id", "query", F.array(F.col("continuation"), F.concat(F.lit("not "), F.col("continuation")),
                                                          F.col("query"), F.concat(F.col("query"), F.lit("?"))).alias("choices"),
                    (F.col("item_id") % 4).cast("int").alias("gold"))


def v_icl_schema(spark, sf):
    b = v_icl_base(spark, sf)
    return b.select("idx", "item_id", F.array(F.col("query"), F.concat(F.col("query"), F.lit(" too")),
                                              F.concat(F.lit("Maybe "), F.col("query"))).alias("context_options"),
                    "continuation", (F.col("item_id") % 3).cast("int").alias("gold"))


def v_icl_lm(spark, sf):
    b = v_icl_base(spark, sf)
    return b.select("idx", "item_id", F.concat(F.col("query"), F.lit(" \n")).alias("context"), "continuation")


def v_gpqa(spark: SparkSession, sf: str) -> DataFrame:
    """supplier names as GPQA answers; domain = region, subdomain = nation."""
    s, n, r = table(spark, sf, "supplier"), table(spark, sf, "nation"), table(spark, sf, "region")
    j = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    return j.select(F.col("s_suppkey").alias("item_id"),
                    F.concat(F.lit("Which supplier ships from "), "n_name", F.lit(" as "), "s_name", F.lit("?")).alias("Question"),
                    F.col("s_name").alias("correct"), F.concat("s_name", F.lit(" Ltd")).alias("incorrect1"),
                    F.concat(F.lit(" "), "n_name", F.lit(" ")).alias("incorrect2"), F.col("r_name").alias("incorrect3"),
                    F.col("r_name").alias("domain"), F.col("n_name").alias("subdomain"))


def v_losses(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem as a long loss table: item = orderkey div 4, option = orderkey % 4,
    pos = linenumber, loss = (partkey % 64) / 16 (exact binary fractions, so sums
    do not depend on order); line 7 targets play ignore (-1)."""
    li = table(spark, sf, "lineitem")
    item = (F.col("l_orderkey") / 4).cast("bigint")
    return li.select(item.alias("item_id"), (F.col("l_orderkey") % 4).cast("int").alias("option_idx"),
                     F.col("l_linenumber").alias("pos"), ((F.col("l_partkey") % 64) / 16.0).alias("loss"),
                     (F.col("l_partkey") % 5).alias("token"), (F.col("l_suppkey") % 5).alias("pred_token"),
                     F.when(F.col("l_linenumber") == 7, F.lit(-1)).otherwise(F.col("l_partkey")).alias("target"))


def v_spans(spark: SparkSession, sf: str) -> DataFrame:
    """A span per (item, option): start = 2 + option % 2, end = start + 2 + item % 3; gold = item % 4."""
    lo = v_losses(spark, sf).select("item_id", "option_idx").distinct()
    start = F.lit(2) + F.col("option_idx") % 2
    return lo.select("item_id", "option_idx", start.alias("start"), (start + 2 + F.col("item_id") % 3).alias("end"),
                     (F.col("item_id") % 4).cast("int").alias("gold"))


def v_token_bytes(spark: SparkSession, sf: str) -> DataFrame:
    """part as a vocabulary: token = p_partkey, bytes = p_size % 5 (0 plays a special token)."""
    return table(spark, sf, "part").select(F.col("p_partkey").alias("token"), (F.col("p_size") % 5).alias("n_bytes"))


def v_log(spark: SparkSession, sf: str) -> DataFrame:
    """events as an API call log: error -> 400, signup -> 500, the rest 200."""
    e = table(spark, sf, "events")
    st = F.when(F.col("event_type") == "error", 400).when(F.col("event_type") == "signup", 500).otherwise(200)
    return e.select("event_id", "ts", "user_id", "event_type", st.alias("status"))


def v_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """events as recorded executions; problem = user_id."""
    e = table(spark, sf, "events")
    t = F.col("event_type")
    return e.select("event_id", "ts", F.col("user_id").alias("problem"), (t == "purchase").alias("success"),
                    (t == "view").alias("timeout"), (t == "signup").alias("memory_exceeded"),
                    (t != "click").alias("has_code"))


def v_sections(spark: SparkSession, sf: str) -> DataFrame:
    """nation x stage (base, sft, rl) report sections as markdown text.

    The timestamp is the latest order date of the nation's customers (by
    ``o_custkey % 25``) in that stage's third of the orders; for nations
    ``% 7 == 0`` the sft timestamp is unparsable.  Metric values derive from keys.
    """
    n, o = table(spark, sf, "nation"), table(spark, sf, "orders")
    ts = (o.groupBy((F.col("o_custkey") % 25).alias("n_nationkey"), (F.col("o_orderkey") % 3).cast("int").alias("stage_no"))
          .agg(F.max("o_orderdate").alias("t")))
    stages = F.explode(F.array(*[F.struct(F.lit(i).alias("stage_no"), F.lit(s).alias("stage"))
                                 for i, s in enumerate(["base", "sft", "rl"])]))
    grid = n.select("n_nationkey", "n_name", stages.alias("_s")).select("n_nationkey", "n_name", "_s.*")
    g = grid.join(ts, ["n_nationkey", "stage_no"], "left")
    def val(m):
        return F.format_string("%.4f", ((F.col("n_nationkey") * 37 + F.col("stage_no") * 11 + m) % 100) / 100.0)
    tstr = F.when((F.col("n_nationkey") % 7 == 0) & (F.col("stage") == "sft"), F.lit("unknown")).otherwise(
        F.date_format("t", "yyyy-MM-dd HH:mm:ss"))
    text = F.concat(F.lit("## "), F.col("stage"), F.lit(" evaluation\ntimestamp: "), tstr,
                    F.lit("\n- CORE: "), val(1), F.lit("\n- ChatCORE: "), val(2), F.lit("\n- GSM8K: "), val(3),
                    F.lit("\n- MMLU: "), val(4), F.lit("\n- MMLU: "), val(5), F.lit("\n"))
    return g.select("n_nationkey", "n_name", "stage", "stage_no", text.alias("text"))


def v_devices(spark: SparkSession, sf: str) -> DataFrame:
    """supplier runs on literal device names chosen by md5 draw; hours from the balance."""
    s = table(spark, sf, "supplier")
    names = F.array(*[F.lit(x) for x in ["NVIDIA H100 80GB HBM3", "NVIDIA A100-SXM4-40GB", "Tesla V100-SXM2-16GB",
                                         "NVIDIA GeForce RTX 4090", "NVIDIA H100 PCIe"]])
    dev = F.element_at(names, (md5_draw(3, F.col("s_suppkey")) % 5 + 1).cast("int"))
    return s.select("s_suppkey", dev.alias("device"), (F.col("s_suppkey") % 8 + 1).cast("int").alias("n_devices"),
                    F.round(F.abs(F.col("s_acctbal")) / 1000.0, 3).alias("hours"))


def v_runs(spark: SparkSession, sf: str) -> DataFrame:
    """events as run summaries: model = user_id % 5, task from the event type
    (every 7th event is SpellingBee), accuracy = value scaled to [0, 1]."""
    e = table(spark, sf, "events")
    task = (F.when(F.col("event_id") % 7 == 0, "SpellingBee").when(F.col("event_type") == "click", "ARC-Easy")
            .when(F.col("event_type") == "view", "ARC-Challenge").when(F.col("event_type") == "purchase", "MMLU")
            .when(F.col("event_type") == "signup", "GSM8K").otherwise("HumanEval"))
    return e.select("event_id", F.concat(F.lit("model-"), (F.col("user_id") % 5).cast("string")).alias("model"),
                    task.alias("task"), F.round((F.col("value") % 100) / 100.0, 4).alias("accuracy"),
                    F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"))
