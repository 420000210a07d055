"""Literal goldens from FIXTURES part 3 not covered elsewhere."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.operators import conv as CV
from tessera.operators import order as O
from tessera.operators import prompts as P
from tessera.operators import score as S
from tessera.operators import seq as Q


def _rows(spark, convs):
    rows = []
    for cid, msgs in enumerate(convs):
        for t, (role, parts) in enumerate(msgs):
            rows.append((cid, t, role, "x", parts))
    return spark.createDataFrame(rows, "conv_id int, turn int, role string, text string, is_parts boolean")


def test_bad_conversations_each_rejected(spark):
    convs = [
        [("user", False), ("user", False)],                      # user, user
        [("assistant", False), ("user", False)],                 # assistant first
        [("system", False)],                                     # system only
        [("system", False), ("assistant", False), ("user", False)],  # system, assistant
        [("user", True), ("assistant", False)],                  # list content from user
        [("user", False), ("assistant", False)],                 # fine
    ]
    got = {r.conv_id: (r.reason, r.bad_index) for r in CV.validate_conversation(
        _rows(spark, convs), "smoltalk", is_parts="is_parts").collect()}
    assert got == {0: ("bad_role", 1), 1: ("bad_role", 0), 2: ("too_short", None), 3: ("bad_role", 1),
                   4: ("non_string_content", 0), 5: (None, None)}
    render = {r.conv_id: r.reason for r in CV.validate_conversation(_rows(spark, convs), "render",
                                                                      is_parts="is_parts").collect()}
    assert render[4] == "non_string_content"
    jsonl = {r.conv_id: r.reason for r in CV.validate_conversation(_rows(spark, convs), "jsonl").collect()}
    assert jsonl[3] == "bad_role"  # system is not allowed in JSONL


def test_slice_view(spark):
    full = spark.range(20).select((F.col("id") * 7).alias("v"), F.col("id").alias("idx"))
    sl = O.slice_task(full, 5, 10).orderBy("idx").collect()
    assert len(sl) == 5 and sl[0].v == 35 and sl[0].idx == 0
    clamped = O.slice_task(full, 15, 100, 2).count()
    assert clamped == 3


def test_option_tie_and_empty_span(spark):
    losses = spark.createDataFrame([(0, 0, 1, 2.0), (0, 1, 1, 1.0), (0, 2, 1, 1.0), (0, 3, 1, 0.1)],
                                   "item_id int, option_idx int, pos int, loss double")
    spans = spark.createDataFrame([(0, o, 2, 3 if o < 3 else 2, 1) for o in range(4)],
                                  "item_id int, option_idx int, start int, end int, gold int")
    r = S.score_options(losses, spans).first()
    assert r.pred == 1 and r.correct  # first of the tied least means; the empty span (option 3) never wins


def test_bits_per_byte_golden(spark):
    ln2 = math.log(2)
    losses = spark.createDataFrame([(ln2, 1), (ln2, 2), (5.0, 3)], "loss double, target int")
    tb = spark.createDataFrame([(1, 1), (2, 1), (3, 0)], "token int, n_bytes int")
    assert S.bits_per_byte(losses, tb).first().bpb == pytest.approx(1.0)
    zero = spark.createDataFrame([(1, 0), (2, 0), (3, 0)], "token int, n_bytes int")
    assert S.bits_per_byte(losses, zero).first().bpb == float("inf")


def test_common_prefix_suffix(spark):
    df = spark.createDataFrame([([[1, 2, 3], [1, 2, 4, 5]], [[9, 5, 6], [8, 7, 5, 6]])],
                               "a array<array<int>>, b array<array<int>>")
    r = df.select(Q.common_length_expr(F.col("a"), "left").alias("p"),
                  Q.common_length_expr(F.col("b"), "right").alias("s")).first()
    assert (r.p, r.s) == (2, 2)


def test_render_mc_and_arc(spark):
    df = spark.createDataFrame([("Q?", ["A", "B"], ["x", "y"])], "q string, l array<string>, c array<string>")
    assert df.select(P.render_mc("q", "l", "c").alias("p")).first().p == (
        "Multiple Choice question: Q?\n- x=A\n- y=B\n\nRespond only with the letter of the correct answer.")
    m = spark.createDataFrame([("Why?", ["a", "b", "c"])], "q string, t array<string>").select(
        P.arc_messages("q", "t").alias("m")).first().m
    assert m[1].content.startswith("Given the following question and three candidate answers (A, B and C)")
    assert m[1].content.endswith("is one of A, B or C.")


def test_centered_and_chatcore(spark):
    acc = spark.createDataFrame([("m", t, 0.5) for t in ["ARC-Easy", "ARC-Challenge", "MMLU", "GSM8K", "HumanEval",
                                                        "SpellingBee"]], "model string, task string, accuracy double")
    r = S.chatcore(acc, group=["model"]).first()
    assert r.n_tasks == 6 and r.chatcore == pytest.approx((3 * (0.25 / 0.75) + 3 * 0.5) / 6)
    assert S.chatcore(acc.where("task <> 'MMLU'"), group=["model"]).count() == 0


def test_slice_argument_checks(spark):
    df = spark.range(3).withColumnRenamed("id", "idx")
    for bad in [(-1, None, 1), (0, None, 0), (5, 2, 1)]:
        with pytest.raises(ValueError):
            O.slice_task(df, *bad)
    assert O.slice_task(df, 2, 2).count() == 0
