"""Literal goldens for the grading functions (FIXTURES part 3)."""

from pyspark.sql import functions as F

from tessera.functions import text as T


def one(spark, col, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("r")).first()["r"]


def test_hash_number(spark):
    assert one(spark, T.extract_hash_number("x"), "#### -1,234.5") == "-1234.5"
    assert one(spark, T.extract_hash_number("x"), "so #### 42.") == "42."
    assert one(spark, T.extract_hash_number("x"), "no answer") is None


def test_letters(spark):
    assert one(spark, T.extract_letter("x"), "The best answer is (b)") == "B"
    assert one(spark, T.extract_letter("x"), "so (A) or (D)") == "D"
    assert one(spark, T.extract_letter("x"), "best answer is Carbon") == "C"
    assert one(spark, T.extract_letter("x"), "nothing here") is None
    assert one(spark, T.extract_paren_letter("x"), "The best answer is D") == "(D)"


def test_math(spark):
    s = "Final Answer: The final answer is $\\boxed{\\frac{1}{2}}$. I hope it is correct."
    assert one(spark, T.extract_math_answer("x"), s) == "\\frac{1}{2}"
    assert one(spark, T.extract_math_answer("x"), "Final Answer: The final answer is $\\boxed{}$. I hope") is None
    assert one(spark, T.normalize_math("x"), "x = 100,000") == "100000"
    assert one(spark, T.normalize_math("x"), "5\\text{ cm}") == "5"


def test_python_strip_is_unicode(spark):
    assert one(spark, T.py_strip("x"), "   hi \n\x1c") == "hi"


def test_spelling(spark):
    df = spark.createDataFrame([("strawberry", "r")], "w string, l string")
    r = df.select(T.count_letter("w", "l").alias("n"), T.spell("w").alias("s"),
                  T.counting_walkthrough("w", "l").alias("k")).first()
    assert r.n == 3
    assert r.s == "strawberry:s,t,r,a,w,b,e,r,r,y"
    assert r.k.splitlines()[2] == "3:r hit! count=1"
    assert r.k.splitlines()[8] == "9:r hit! count=3"


def test_tool_calls(spark):
    ans = ("Weng earns 12/60 = $<<12/60=0.2>>0.2 per minute.\n"
           "Working 50 minutes, she earned 0.2 x 50 = $<<0.2*50=10>>10.\n#### 10")
    r = spark.createDataFrame([(ans,)], "x string").select(T.split_tool_calls("x").alias("p")).first().p
    assert [p.type for p in r] == ["text", "python", "python_output", "text", "python", "python_output", "text"]
    assert (r[1].text, r[2].text, r[4].text, r[5].text) == ("12/60", "0.2", "0.2*50", "10")
    ref = spark.createDataFrame([(ans,)], "x string").select(
        T.reference_answer(T.split_tool_calls("x")).alias("r")).first().r
    assert ref == "10"


def test_code_extraction(spark):
    assert one(spark, T.extract_program("x"), "x\n```python\nprint(1)\n```\ny") == "print(1)"
    assert one(spark, T.extract_program("x"), "  plain  ") == "plain"
    assert one(spark, T.extract_code("x"), "```python\ndef f():\n  return 1") == "def f():\n  return 1"
    assert one(spark, T.extract_code("x"), "   ") is None
    src = "# c\n\nimport os\nfrom a import b\nx = 1\nimport late"
    assert one(spark, T.extract_imports("x"), src) == "import os\nfrom a import b"


def test_calculator_gate_and_eval(spark):
    from tessera.operators import audit as AU
    exprs = ["12/60", "0.2*50", "2**10", "1,000+5", "'strawberry'.count('r')", "__import__('os')", "abc",
             "7//2", "1/0", "\"hello\".count(\"l\")"]
    df = spark.createDataFrame([(e,) for e in exprs], "e string")
    got = [r.r for r in df.select(AU.use_calculator("e").alias("r")).collect()]
    assert got == ["0.2", "10.0", None, "1005", "3", None, None, "3", None, "2"]


def test_reference_answer_fast_path_equals_parts(spark):
    answers = ["a <<1+1=2>>2\n#### 2", "<<3*3=9>>", "no calls #### 5", "x<<a>>y<<b=c>>#### 7,000"]
    df = spark.createDataFrame([(a,) for a in answers], "x string")
    r = df.select(T.reference_answer(T.split_tool_calls("x")).alias("a"), T.gsm_reference_answer("x").alias("b")).collect()
    assert [x.a for x in r] == [x.b for x in r] == ["2", None, "5", "7000"]


def test_audit_agrees_with_python(spark):
    from tessera.operators import audit as AU
    exprs = ["12*3", "7-10", "007+1", "3 * 4", "99999*99999", "12/60", "(2+3)*4", "'banana'.count('an')",
             "1,000*2", "2**3", "5//2"]
    parts = [[("python", x), ("python_output", "0")] for x in exprs]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(parts)],
                               "k int, parts array<struct<type:string,text:string>>")
    got = {r.k: r.recomputed for r in AU.audit_tool_calls(df).collect()}
    # leading zeros are a syntax error, powers are not allowed
    assert got == {i: None if x in ("007+1", "2**3") else str(eval(x.replace(",", ""))) for i, x in enumerate(exprs)}
