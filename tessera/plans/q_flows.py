"""End-to-end chains of operators, rows-checked."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import ext as X
from tessera.operators import order as O
from tessera.operators import prompts as P
from tessera.operators import score as S
from tessera.operators import seq as Q
from tessera.operators import tok as TK
from tessera.plans.q_tok import merges_for
from tessera.plans.registry import register
from tessera.plans.views import v_icl_mc
from tessera.session import cut_lineage


def _toy_lm(seqs):
    """Deterministic stand-in for a model forward: loss = (token mod 13) / 4."""
    return [([(t % 13) / 4.0 for t in s], [t % 7 for t in s]) for s in seqs]


@register("core_eval_chain")
def core_eval_chain_q(spark, sf):
    """A9-shaped items -> G4 (seed 1337) -> J2 -> F9 (2 shots) -> C2 -> E3 (bos) -> F2 (mc spans)
    -> F3 (max 48 tokens) -> M3 (toy scorer) -> I6 -> I1 -> I11 (baseline 25%, a literal here)."""
    merges = merges_for(spark, sf)
    items = O.seeded_shuffle(v_icl_mc(spark, sf).drop("idx"), 1337, "item_id")
    shots = O.sample_fewshot(items, 2, seed=1234, fields=["query", "choices", "gold"])
    prompts = P.render_icl_mc(shots).select("item_id", "option_idx", "gold", "prompt")
    enc = prompts.withColumn("tokens", TK.encode("prompt", merges, prepend="<|bos|>"))
    spans = Q.answer_spans(enc, "multiple_choice")
    spans = cut_lineage(Q.truncate_left(spans, 48))  # read by the scorer and by the scoring join
    losses = X.score_with(spans, _toy_lm, ["item_id", "option_idx"])
    scored = S.score_options(losses, spans.select("item_id", "option_idx", "start", "end", "gold"))
    acc = S.accuracy(scored).withColumn("task", F.lit("icl_mc"))
    return acc.select("task", "n", "n_correct", F.round("accuracy", 6).alias("accuracy"),
                      F.round(S.centered(F.col("accuracy"), F.lit(25.0)), 6).alias("centered"))


@register("chat_eval_chain")
def chat_eval_chain_q(spark, sf):
    """A11-shaped MMLU items -> C1 -> conversation (user prompt, assistant letter) -> E8 completion ids
    -> M4 (toy callback, 2 samples) -> H4 -> D2 -> I5 -> I3 -> I2 accuracy per subject."""
    from tessera.functions import text as T
    from tessera.plans.views import v_mc
    merges = merges_for(spark, sf)
    m = v_mc(spark, sf)
    gold = F.expr("char(65 + answer)")
    conv = m.select("item_id", "subject", gold.alias("gold"), F.array(
        F.struct(F.lit("user").alias("role"), P.render_mc("question", "letters", "choices").alias("text"),
                 F.lit(None).cast("array<struct<type:string,text:string>>").alias("parts")),
        F.struct(F.lit("assistant").alias("role"), gold.alias("text"),
                 F.lit(None).cast("array<struct<type:string,text:string>>").alias("parts"))).alias("messages"))
    ids = TK.render_for_completion(conv.withColumnRenamed("item_id", "conv_id"), merges)
    problems = ids.select(F.col("conv_id").alias("item_id"),
                          F.concat_ws(",", F.transform("ids", lambda x: x.cast("string"))).alias("prompt"))

    def answer(prompt):  # toy model: letter from the prompt length; fails on every 9th length
        n = prompt.count(",")
        if n % 9 == 0:
            raise RuntimeError("timeout")
        return f"The best answer is ({'ABCD'[n % 4]})"
    done = X.complete_with(problems, answer, num_samples=2).select("item_id", "sample", "completion", "error")
    graded = S.join_predictions(conv.select("item_id", "subject", "gold"), done, ["item_id"])
    graded = S.grade_exact(graded.withColumn("pred", T.extract_letter("completion")), "pred", "gold")
    passed = S.pass_any(graded, ["item_id", "subject"])
    acc = S.accuracy_by(passed, ["subject"])
    return acc.select("subject", "n", "n_correct", F.round("accuracy", 6).alias("accuracy"))
