"""The fixture views of ``views.py`` as DuckDB CTE text (oracle side)."""

from __future__ import annotations


def md5_draw(seed, key: str, hex_digits: int = 8) -> str:
    return f"('0x' || substr(md5('{seed}:' || CAST({key} AS VARCHAR)), 1, {hex_digits}))::BIGINT"


V_LETTER_SCORES = """v_letter_scores AS (
  SELECT vec_id AS item_id, label AS gold, CAST((i - 1) % 10 AS INT) AS letter_idx, chr(CAST(65 + (i - 1) % 10 AS INT)) AS letter,
         CAST(max(embedding[i]) AS DOUBLE) AS score
  FROM embeddings, generate_series(1, (SELECT max(len(embedding)) FROM embeddings)) t(i) WHERE i <= len(embedding)
  GROUP BY vec_id, label, (i - 1) % 10)"""


V_CORPUS = """v_corpus AS (
  SELECT source AS shard, doc_id, text, lang,
         row_number() OVER (ORDER BY source, doc_id) - 1 AS idx,
         row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos,
         (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 8 AS row_group
  FROM documents)"""

V_PART_IDX = """v_part_idx AS (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS idx FROM part)"""
V_SUPPLIER_IDX = """v_supplier_idx AS (SELECT *, row_number() OVER (ORDER BY s_suppkey) - 1 AS idx FROM supplier)"""


V_GSM = """v_gsm AS (
  SELECT l_orderkey, l_linenumber,
         'Order ' || l_orderkey || ' line ' || l_linenumber || ': how many units?' AS question,
         'We have ' || q || ' x ' || l_linenumber || ' = <<' || q || '*' || l_linenumber || '=' || a || '>>' || a
           || ' units.' || chr(10) || 'Doubled: <<' || a || '*2=' || b || '>>' || b || '.' || chr(10) || '#### ' || b AS answer,
         CASE l_orderkey % 3 WHEN 0 THEN 'So the answer is' || chr(10) || '#### ' || format('{:,}', b)
                                           || CASE WHEN l_linenumber = 1 THEN '.' ELSE '' END
                             WHEN 1 THEN '#### ' || (b + 1) ELSE 'I am not sure.' END AS completion
  FROM (SELECT *, CAST(l_quantity AS BIGINT) AS q, CAST(l_quantity AS BIGINT) * l_linenumber AS a,
               CAST(l_quantity AS BIGINT) * l_linenumber * 2 AS b FROM lineitem))"""

V_MC = f"""v_mc AS (
  SELECT p_partkey AS item_id, p_name AS question, [p_brand, p_type, 'size ' || p_size, p_name] AS choices,
         ['A', 'B', 'C', 'D'] AS letters, CAST({md5_draw(42, 'p_partkey')} % 4 AS INT) AS answer,
         p_type AS subject, p_size
  FROM part)"""

V_LETTERS = """v_letters AS (
  SELECT item_id, subject, chr(CAST(65 + answer AS INT)) AS gold,
         CASE item_id % 4 WHEN 0 THEN 'The best answer is (' || said || ')'
                          WHEN 1 THEN 'It is (A) or (' || said || ')'
                          WHEN 2 THEN 'the best answer is ' || lower(said)
                          ELSE 'No idea.' END AS completion
  FROM (SELECT *, chr(CAST(65 + (answer + p_size % 2) % 4 AS INT)) AS said FROM v_mc))"""

V_MATH = r"""v_math AS (
  SELECT o_orderkey AS item_id, 'What is the total of order ' || o_orderkey || '?' AS problem,
         format('{:,}', v) AS answer,
         CASE o_orderkey % 5
           WHEN 0 THEN 'Final Answer: The final answer is $\boxed{' || format('{:,}', v) || '}$. I hope it is correct.'
           WHEN 1 THEN 'so x = ' || v || ' and \boxed{' || v || ' dollars}'
           WHEN 2 THEN 'Final Answer: The final answer is $' || v || '$. I hope'
           WHEN 3 THEN 'The total is \text{' || (v + 1) || '}'
           ELSE 'Final Answer: The final answer is $\boxed{}$. I hope' END AS completion,
         o_orderpriority AS subject, CAST(o_orderkey % 5 + 1 AS INT) AS level
  FROM (SELECT *, CAST(round(o_totalprice) AS BIGINT) AS v FROM orders))"""

V_CODE = """v_code AS (
  SELECT p_partkey AS item_id,
         CASE WHEN p_partkey % 2 = 1 THEN '# header' || chr(10) || chr(10) || 'import os' || chr(10) ELSE '' END
           || 'import math' || chr(10) || 'from typing import List' || chr(10) || chr(10) || '# helper' || chr(10)
           || 'def ' || fn || '(x):' || chr(10) || '    \"\"\"' || p_name || '\"\"\"' || chr(10) AS prompt,
         CASE p_partkey % 6
           WHEN 0 THEN 'Here:' || chr(10) || '```python' || chr(10) || 'def ' || fn || '(x):' || chr(10) || '    return x * ' || p_size || chr(10) || '```' || chr(10) || 'Done.'
           WHEN 1 THEN '```' || chr(10) || 'def ' || fn || '(x):' || chr(10) || '    return x' || chr(10) || '```'
           WHEN 2 THEN '```python' || chr(10) || 'def ' || fn || '(x):' || chr(10) || '    return 1' || chr(10)
           WHEN 3 THEN 'def ' || fn || '(x):' || chr(10) || '    return 2'
           WHEN 4 THEN '```python' || chr(10) || '```'
           ELSE '   ' END AS completion,
         fn AS entry_point, 'def check(c):' || chr(10) || '    assert c(1) is not None' AS test,
         ['assert ' || fn || '(1) == 1', 'assert ' || fn || '(2) == 2'] AS test_list,
         CASE WHEN p_partkey % 2 = 0 THEN ['import math'] ELSE CAST([] AS VARCHAR[]) END AS test_imports
  FROM (SELECT *, 'f_' || p_partkey AS fn FROM part))"""

V_WORDS = r"""v_words AS (
  SELECT word, row_number() OVER (ORDER BY word) - 1 AS idx FROM (
    SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^\p{L}]+')) AS word FROM documents)
  WHERE word <> '')"""


V_CONV_ROWS = """v_conv_rows AS (
  SELECT conv_id, turn, role, text,
         conv_id % 5 = 0 AND role = 'assistant' AND contains(text, chr(10)) AS is_parts
  FROM (SELECT conv_id, CASE WHEN conv_id % 13 = 4 AND turn > 1 THEN turn + 1 ELSE turn END AS turn, text,
               CASE WHEN conv_id % 11 = 5 AND turn = 0 THEN 'assistant' WHEN conv_id % 7 = 3 AND turn = 1 THEN 'user' ELSE role END AS role
        FROM conversations))"""


V_ICL_BASE = """v_icl_base AS (
  SELECT item_id, q AS query, CASE WHEN contains(text, '. ') THEN substr(text, length(q) + 3) ELSE '' END AS continuation,
         row_number() OVER (ORDER BY item_id) - 1 AS idx
  FROM (SELECT *, split_part(text, '. ', 1) AS q FROM benchmark))"""
V_ICL_MC = """v_icl_mc AS (SELECT idx, item_id, query, [continuation, 'not ' || continuation, query, query || '?'] AS choices,
                     CAST(item_id % 4 AS INT) AS gold FROM v_icl_base)"""
V_ICL_SCHEMA = """v_icl_schema AS (SELECT idx, item_id, [query, query || ' too', 'Maybe ' || query] AS context_options,
                     continuation, CAST(item_id % 3 AS INT) AS gold FROM v_icl_base)"""
V_ICL_LM = """v_icl_lm AS (SELECT idx, item_id, query || ' ' || chr(10) AS context, continuation FROM v_icl_base)"""
V_GPQA = """v_gpqa AS (
  SELECT s_suppkey AS item_id, 'Which supplier ships from ' || n_name || ' as ' || s_name || '?' AS Question,
         s_name AS correct, s_name || ' Ltd' AS incorrect1, ' ' || n_name || ' ' AS incorrect2, r_name AS incorrect3,
         r_name AS domain, n_name AS subdomain
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def fewshot_sql(view: str, k: int, seed: int) -> str:
    """CTE ``shots(idx, j, shot_idx)``: the prime-walk few-shot draw of order.fewshot_indices."""
    return f"""nn AS (SELECT count(*) AS n FROM {view}),
pr AS (SELECT min(p) AS P FROM nn, range(nn.n, 2 * nn.n + 3) t(p)
       WHERE p >= 2 AND NOT EXISTS (SELECT 1 FROM range(2, CAST(floor(sqrt(p)) AS BIGINT) + 1) d(x) WHERE p % x = 0)),
wk AS (SELECT v.idx, list_filter(list_transform(range(0, {k} + (pr.P - nn.n) + 1),
          lambda j: ((('0x' || substr(md5('{seed}:b:' || CAST(v.idx AS VARCHAR)), 1, 8))::BIGINT % pr.P)
                     + j * (1 + ('0x' || substr(md5('{seed}:a:' || CAST(v.idx AS VARCHAR)), 1, 8))::BIGINT % (pr.P - 1))) % pr.P),
          lambda x: x < nn.n AND x <> v.idx)[1:{k}] AS shot_list
       FROM {view} v, nn, pr),
shots AS (SELECT idx, unnest(generate_series(1, len(shot_list))) AS j, unnest(shot_list) AS shot_idx FROM wk)"""


V_LOSSES = """v_losses AS (
  SELECT l_orderkey // 4 AS item_id, CAST(l_orderkey % 4 AS INT) AS option_idx, l_linenumber AS pos,
         (l_partkey % 64) / 16.0 AS loss, l_partkey % 5 AS token, l_suppkey % 5 AS pred_token,
         CASE WHEN l_linenumber = 7 THEN -1 ELSE l_partkey END AS target FROM lineitem)"""
V_SPANS = """v_spans AS (
  SELECT item_id, option_idx, 2 + option_idx % 2 AS start, 2 + option_idx % 2 + 2 + item_id % 3 AS "end",
         CAST(item_id % 4 AS INT) AS gold FROM (SELECT DISTINCT item_id, option_idx FROM v_losses))"""
V_TOKEN_BYTES = """v_token_bytes AS (SELECT p_partkey AS token, p_size % 5 AS n_bytes FROM part)"""
V_LOG = """v_log AS (SELECT event_id, ts, user_id, event_type,
  CASE event_type WHEN 'error' THEN 400 WHEN 'signup' THEN 500 ELSE 200 END AS status FROM events)"""
V_OUTCOMES = """v_outcomes AS (SELECT event_id, ts, user_id AS problem, event_type = 'purchase' AS success,
  event_type = 'view' AS timeout, event_type = 'signup' AS memory_exceeded, event_type <> 'click' AS has_code FROM events)"""


V_SECTIONS = """v_sections AS (
  SELECT n_nationkey, n_name, stage, stage_no,
    '## ' || stage || ' evaluation' || chr(10) || 'timestamp: ' ||
    CASE WHEN n_nationkey % 7 = 0 AND stage = 'sft' THEN 'unknown' ELSE strftime(t, '%Y-%m-%d %H:%M:%S') END ||
    chr(10) || '- CORE: ' || printf('%.4f', ((n_nationkey * 37 + stage_no * 11 + 1) % 100) / 100.0) ||
    chr(10) || '- ChatCORE: ' || printf('%.4f', ((n_nationkey * 37 + stage_no * 11 + 2) % 100) / 100.0) ||
    chr(10) || '- GSM8K: ' || printf('%.4f', ((n_nationkey * 37 + stage_no * 11 + 3) % 100) / 100.0) ||
    chr(10) || '- MMLU: ' || printf('%.4f', ((n_nationkey * 37 + stage_no * 11 + 4) % 100) / 100.0) ||
    chr(10) || '- MMLU: ' || printf('%.4f', ((n_nationkey * 37 + stage_no * 11 + 5) % 100) / 100.0) || chr(10) AS text
  FROM (SELECT n_nationkey, n_name, s.stage_no, s.stage FROM nation,
          (VALUES (0, 'base'), (1, 'sft'), (2, 'rl')) s(stage_no, stage)) g
  LEFT JOIN (SELECT o_custkey % 25 AS nk, CAST(o_orderkey % 3 AS INT) AS sn, max(o_orderdate) AS t FROM orders GROUP BY 1, 2) x
    ON x.nk = g.n_nationkey AND x.sn = g.stage_no)"""

V_DEVICES = f"""v_devices AS (
  SELECT s_suppkey, ['NVIDIA H100 80GB HBM3', 'NVIDIA A100-SXM4-40GB', 'Tesla V100-SXM2-16GB', 'NVIDIA GeForce RTX 4090',
                     'NVIDIA H100 PCIe'][CAST({md5_draw(3, 's_suppkey')} % 5 + 1 AS INT)] AS device,
         CAST(s_suppkey % 8 + 1 AS INT) AS n_devices, round(abs(s_acctbal) / 1000.0, 3) AS hours FROM supplier)"""

V_RUNS = """v_runs AS (
  SELECT event_id, 'model-' || CAST(user_id % 5 AS VARCHAR) AS model,
         CASE WHEN event_id % 7 = 0 THEN 'SpellingBee' WHEN event_type = 'click' THEN 'ARC-Easy'
              WHEN event_type = 'view' THEN 'ARC-Challenge' WHEN event_type = 'purchase' THEN 'MMLU'
              WHEN event_type = 'signup' THEN 'GSM8K' ELSE 'HumanEval' END AS task,
         round((value % 100) / 100.0, 4) AS accuracy, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp FROM events)"""
