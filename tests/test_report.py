"""First-match rules: inline CASE path equals the broadcast theta-join path."""

from tessera.operators import report as RP


def test_first_match_paths_agree(spark):
    texts = spark.createDataFrame([(i, f"device-{i % 97}-x{i % 5}") for i in range(300)], "k int, t string")
    rules = [(j, f"-{j}-", f"r{j}") for j in range(70)]
    big = spark.createDataFrame(rules, "rule_no int, pattern string, value string")
    small = spark.createDataFrame(rules[:40], "rule_no int, pattern string, value string")
    via_join = {r.k: r.value for r in RP.first_match(texts, big, "t", ["k"], default="none").collect()}
    assert via_join[5] == "r5" and via_join[96] == "none"
    inline = {r.k: r.value for r in RP.first_match(texts, small, "t", ["k"], default="none").collect()}
    want = {k: (v if v in {f"r{j}" for j in range(40)} else "none") for k, v in via_join.items()}
    assert inline == want


def test_first_match_regex_and_all_of(spark):
    df = spark.createDataFrame([(1, "meta-llama-3-8b"), (2, "gemma-7b"), (3, "other")], "k int, m string")
    rules = spark.createDataFrame([(0, "llama-?3", "A"), (1, "gemma", "B")], "rule_no int, pattern string, value string")
    got = {r.k: r.value for r in RP.first_match(df, rules, "m", ["k"], kind="regex", default="Z").collect()}
    assert got == {1: "A", 2: "B", 3: "Z"}
    rules2 = spark.createDataFrame([(0, ["gem", "7b"], "G")], "rule_no int, pattern array<string>, value string")
    got2 = {r.k: r.value for r in RP.first_match(df, rules2, "m", ["k"], kind="all_of", default="-").collect()}
    assert got2 == {1: "-", 2: "G", 3: "-"}


def test_broadcast_guard_checks_rows_and_bytes(spark):
    from tessera.plans.guards import broadcast_small
    small = spark.createDataFrame([(i, "x") for i in range(10)], "k int, v string")
    wide = spark.createDataFrame([(i, "x" * 1000) for i in range(10)], "k int, v string")
    r = spark.range(5)

    def plan(d):
        return r.join(d, r.id == d.k)._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" in plan(broadcast_small(small, "t"))
        assert "BroadcastHashJoin" not in plan(broadcast_small(wide, "t", max_bytes=5000))
        assert "BroadcastHashJoin" not in plan(broadcast_small(small, "t", max_rows=5))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
