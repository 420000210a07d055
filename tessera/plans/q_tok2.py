"""Queries for BOS resolution, generation trimming, tool spans and the calculator audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import audit as AU
from tessera.operators import tok as TK
from tessera.plans import duck as D
from tessera.plans.registry import register
from tessera.plans.tables import table
from tessera.plans.views import md5_draw, v_gsm

MODEL_NAMES = ["meta-llama/Meta-Llama-3-8B", "meta-llama/Llama-2-7b-hf", "google/gemma-2b", "openai-community/gpt2",
               "mistralai/Mistral-7B-v0.1", "TinyLlama/TinyLlama-1.1B", "my-org/llama3-tuned"]
VOCAB = [("<s>", 1), ("<|endoftext|>", 50256), ("<bos>", 2)]


def _models(spark, sf):
    s = table(spark, sf, "supplier")
    names = F.array(*[F.lit(x) for x in MODEL_NAMES])
    base = F.element_at(names, (md5_draw(5, F.col("s_suppkey")) % len(MODEL_NAMES) + 1).cast("int"))
    return s.select("s_suppkey", F.concat(base, F.lit("-"), F.col("s_name")).alias("model"))


_MODELS_SQL = f"""m AS (SELECT s_suppkey, [{", ".join(D.q(x) for x in MODEL_NAMES)}][CAST(('0x' || substr(md5('5:' || CAST(s_suppkey AS VARCHAR)), 1, 8))::BIGINT % {len(MODEL_NAMES)} + 1 AS INT)]
                  || '-' || s_name AS model FROM supplier)"""
_RULES_SQL = "CASE " + " ".join(f"WHEN regexp_matches(lower(model), {D.q(p)}) THEN {D.q(t)}" for p, t in TK.BOS_RULES) + " END"


@register("resolve_bos", f"""WITH {_MODELS_SQL},
v AS (SELECT * FROM (VALUES {", ".join(f"({D.q(t)}, {i})" for t, i in VOCAB)}) v(token, token_id)),
c AS (SELECT * FROM (VALUES {", ".join(f"({r}, {D.q(t)})" for r, t in enumerate(TK.BOS_CANDIDATES))}) c(rank, token)),
fb AS (SELECT token_id FROM v JOIN c USING (token) ORDER BY rank LIMIT 1),
r AS (SELECT s_suppkey, model, {_RULES_SQL} AS rule_token FROM m)
SELECT s_suppkey, model, rule_token, coalesce(v.token_id, (SELECT token_id FROM fb)) AS bos_id FROM r LEFT JOIN v ON v.token = r.rule_token""")
def resolve_bos_q(spark, sf):
    """Bos id per model name against a tokenizer vocabulary lacking <|begin_of_text|> and <|bos|>."""
    vocab = spark.createDataFrame(VOCAB, "token string, token_id int")
    r = TK.resolve_bos(_models(spark, sf), vocab, ["s_suppkey"])
    return r.select("s_suppkey", "model", F.col("_rule_token").alias("rule_token"), F.col("bos_id").cast("int"))


def _gen(spark, sf):
    li = table(spark, sf, "lineitem")
    g = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("r"))
    return g.select("l_orderkey", F.transform("r", lambda x: (x.l_partkey % 20).cast("int")).alias("ids"))


_GEN_SQL = """WITH g AS (SELECT l_orderkey, list(CAST(l_partkey % 20 AS INT) ORDER BY l_linenumber, l_partkey, l_suppkey) AS ids
                FROM lineitem GROUP BY l_orderkey)"""


def _arr(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


@register("trim_generation", _GEN_SQL + """,
h AS (SELECT *, list_filter(list_transform(ids, lambda x, i: CASE WHEN i - 1 >= 2 AND list_contains([17, 18], x) THEN i - 1 END),
                            lambda x: x IS NOT NULL) AS hits FROM g),
o AS (SELECT l_orderkey, ids[1:CASE WHEN len(hits) > 0 THEN list_min(hits) ELSE len(ids) END] AS out FROM h)
SELECT l_orderkey, array_to_string(out, ',') AS ids,
       array_to_string(list_transform(out, lambda x, i: CASE WHEN i - 1 < 2 THEN 0 ELSE 1 END), ',') AS mask FROM o""")
def trim_generation_q(spark, sf):
    """Generations cut at the first assistant_end (17) or bos (18) after a two-token prompt."""
    g = _gen(spark, sf)
    ids, mask = TK.trim_generation("ids", F.lit(2), [17, 18])
    return g.select("l_orderkey", _arr(ids).alias("ids"), _arr(mask).alias("mask"))


@register("tool_spans", _GEN_SQL + """,
p AS (SELECT l_orderkey, ids,
             list_filter(list_transform(ids, lambda x, i: CASE WHEN x = 15 THEN i - 1 END), lambda x: x IS NOT NULL) AS starts,
             list_filter(list_transform(ids, lambda x, i: CASE WHEN x = 16 THEN i - 1 END), lambda x: x IS NOT NULL) AS ends FROM g),
e AS (SELECT l_orderkey, ids, starts, ends, unnest(ends) AS e FROM p),
s AS (SELECT l_orderkey, e, ids, list_max(list_filter(starts, lambda x: x < e)) AS s,
             coalesce(list_max(list_filter(ends, lambda x: x < e)), -1) AS prev FROM e),
sp AS (SELECT l_orderkey, e, array_to_string(ids[s + 2:e], ',') AS span FROM s WHERE s IS NOT NULL AND s > prev AND e - s > 1)
SELECT g.l_orderkey, CAST(count(sp.span) AS INT) AS n_spans, coalesce(string_agg(sp.span, '|' ORDER BY sp.e), '') AS spans
FROM g LEFT JOIN sp USING (l_orderkey) GROUP BY g.l_orderkey""")
def tool_spans_q(spark, sf):
    """python_start (15) .. python_end (16) spans of every generated sequence."""
    g = _gen(spark, sf).withColumn("sp", TK.tool_spans("ids", 15, 16))
    return g.select("l_orderkey", F.size("sp").cast("int").alias("n_spans"),
                    F.array_join(F.transform("sp", lambda s: _arr(s)), "|").alias("spans"))


@register("audit_tool_calls", """WITH l AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q FROM lineitem),
c AS (SELECT l_orderkey, l_linenumber, 0 AS call_no, q || '*' || l_linenumber AS expr, CAST(q * l_linenumber AS VARCHAR) AS v FROM l
      UNION ALL SELECT l_orderkey, l_linenumber, 1, (q * l_linenumber) || '*2', CAST(q * l_linenumber * 2 AS VARCHAR) FROM l)
SELECT l_orderkey, l_linenumber, call_no, expr, v AS recorded, 'arith' AS kind, v AS recomputed, true AS agrees FROM c""")
def audit_tool_calls_q(spark, sf):
    """Recompute every recorded calculator call of the GSM solutions."""
    g = v_gsm(spark, sf).select("l_orderkey", "l_linenumber", T.split_tool_calls("answer").alias("parts"))
    a = AU.audit_tool_calls(g)
    return a.select("l_orderkey", "l_linenumber", "call_no", "expr", "recorded", "kind", "recomputed", "agrees")
