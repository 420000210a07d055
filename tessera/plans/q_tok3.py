"""Packing and rendering over byte tokens (no merges: ids are the bytes), where SQL can follow every row.

The oracle of the packer walks each lane by a recursive query whose state is the buffer: a list of (length, turn),
the documents loaded, and how full the open row is.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.operators import pack as PK
from tessera.operators import tok as TK
from tessera.plans.q_tok import _conv_messages, _md5
from tessera.plans.registry import register
from tessera.plans.tables import table
from tessera.plans.views import v_corpus
from tessera.session import checkpoint_dir
from tessera.streaming import flows as FL

T, BUFFER, REFILL, GROUPS = 700, 12, 5, 8
BYTES = "list_transform(range(0, strlen({0})), lambda i: CAST('0x' || substr(hex(encode({0})), CAST(2 * i + 1 AS BIGINT), 2) AS INT))"

def _pack_sql(docs: str, enough: str) -> str:
    """``docs``: the relation d (lane, idx, text, n tokens, turn); ``enough``: when a document may be picked."""
    return f"""WITH RECURSIVE
{docs},
lanes AS (SELECT lane, list({{'n': n, 'turn': turn}} ORDER BY turn) AS docs FROM d GROUP BY lane),
walk(lane, docs, loaded, buf, fill, row_no, step, turn, taken, cropped) AS (
  SELECT lane, docs, 0::BIGINT, docs[1:0], 0::BIGINT, 0::BIGINT, 0, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT FROM lanes
  UNION ALL
  SELECT lane, docs, loaded, list_filter(buf, lambda b: b.turn <> p.turn), CASE WHEN full_ THEN 0 ELSE fill + least(p.n, rest) END,
         row_no + CAST(full_ AS INT), step + 1, p.turn, least(p.n, rest), greatest(p.n - rest, 0)
  FROM (SELECT *, fill + least(p.n, rest) = {T + 1} AS full_ FROM (
    SELECT *, CASE WHEN len(list_filter(buf, lambda b: b.n <= rest)) > 0
                   THEN list_sort(list_transform(list_filter(buf, lambda b: b.n <= rest), lambda b: {{'n': -b.n, 'turn': b.turn}}))[1]
                   ELSE list_sort(list_transform(buf, lambda b: {{'n': b.n, 'turn': b.turn}}))[1] END AS q,
           {{'n': abs(struct_extract(q, 'n')), 'turn': struct_extract(q, 'turn')}} AS p
    FROM (SELECT lane, docs, more AS loaded, list_concat(buf, docs[loaded + 1:more]) AS buf, fill, row_no, step, {T + 1} - fill AS rest
          FROM (SELECT *, CAST(least(len(docs), loaded + {REFILL} * greatest(0, ceil(({BUFFER} - len(buf)) / {REFILL}))) AS BIGINT) AS more FROM walk))
    WHERE {enough}))),
picks AS (SELECT w.lane, w.step, d.idx, w.taken, w.cropped, CASE WHEN w.fill = 0 THEN w.row_no - 1 ELSE w.row_no END AS row_no,
                 list_concat([256], {BYTES.format("d.text")})[1:w.taken] AS ids
          FROM walk w JOIN d ON d.lane = w.lane AND d.turn = w.turn),
packed AS (SELECT lane, row_no, flatten(list(ids ORDER BY step)) AS tokens, max(idx) AS last_idx, CAST(count(*) AS INT) AS n_docs,
                  CAST(sum(cropped) AS INT) AS n_cropped FROM picks GROUP BY 1, 2)"""


_BATCH_DOCS = f"""c AS (SELECT row_number() OVER (ORDER BY source, doc_id) - 1 AS idx, source, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos FROM documents),
d AS (SELECT source || '/' || CAST(pos // {8 * GROUPS} AS VARCHAR) AS lane, idx, text, strlen(text) + 1 AS n,
             row_number() OVER (PARTITION BY source, pos // {8 * GROUPS} ORDER BY idx) AS turn FROM c)"""
_PACK_SQL = _pack_sql(_BATCH_DOCS, "len(buf) > 0")
# a feed does not end: documents wait for a whole refill, and are picked while the buffer is full
_FEED_DOCS = f"""a AS (SELECT CAST(doc_id // 64 AS VARCHAR) AS lane, doc_id AS idx, text, strlen(text) + 1 AS n,
                        row_number() OVER (PARTITION BY doc_id // 64 ORDER BY doc_id) AS turn, count(*) OVER (PARTITION BY doc_id // 64) AS many FROM documents),
d AS (SELECT * FROM a WHERE turn <= many - many % {REFILL})"""


def _packed(spark, sf):
    c = v_corpus(spark, sf)
    lane = F.concat_ws("/", "shard", F.expr(f"row_group div {GROUPS}").cast("string"))
    docs = c.select("idx", lane.alias("lane"), TK.encode("text", [], prepend="<|bos|>").alias("tokens"))
    return docs, PK.pack_bestfit(docs, T, buffer_size=BUFFER, refill=REFILL, incomplete=True)


@register("pack_rows", _PACK_SQL + f"""
SELECT lane, row_no, CAST(len(tokens) AS INT) AS n_tokens, md5(array_to_string(tokens, ',')) AS tokens_md5, last_idx, n_docs, n_cropped,
       len(tokens) = {T + 1} AS complete FROM packed""")
def pack_rows(spark, sf):
    """F6 over byte tokens: every packed row, with a hash of its tokens."""
    _, rows = _packed(spark, sf)
    return rows.select("lane", "row_no", F.size("tokens").alias("n_tokens"), _md5("tokens").alias("tokens_md5"), "last_idx", "n_docs", "n_cropped", "complete")


@register("packing_totals", _PACK_SQL + f""",
t AS (SELECT (SELECT CAST(sum(n) AS BIGINT) FROM d) AS tokens_in, count(*) FILTER (len(tokens) = {T + 1}) AS rows,
             CAST(coalesce(sum(len(tokens)) FILTER (len(tokens) = {T + 1}), 0) AS BIGINT) AS tokens_kept, CAST(sum(n_cropped) AS BIGINT) AS tokens_cropped,
             CAST(coalesce(sum(len(tokens)) FILTER (len(tokens) < {T + 1}), 0) AS BIGINT) AS tokens_left FROM packed)
SELECT *, tokens_in - tokens_kept AS tokens_lost, (tokens_in - tokens_kept) / tokens_in AS lost_share, tokens_kept / (rows * {T + 1}) AS utilisation FROM t""")
def packing_totals(spark, sf):
    """F7 over the packing above: tokens in, kept, cropped and left, and utilisation."""
    docs, rows = _packed(spark, sf)
    return PK.packing_stats(docs, rows, T)


@register("stream_pack_rows", _pack_sql(_FEED_DOCS, f"len(buf) >= {BUFFER}") + f"""
SELECT lane, row_no, CAST(len(tokens) AS INT) AS n_tokens, md5(array_to_string(tokens, ',')) AS tokens_md5, last_idx, n_docs, n_cropped
FROM packed WHERE len(tokens) = {T + 1}""")
def stream_pack_rows(spark, sf):
    """L1 over byte tokens: the rows that a feed of the documents completes, in lanes of 64 ids, in several micro-batches."""
    docs = order_feed(spark, sf).select(F.col("doc_id").alias("idx"), F.expr("doc_id div 64").alias("lane"),
                                        TK.encode("text", [], prepend="<|bos|>").alias("tokens"))
    rows = FL.run_available(spark, PK.stream_pack(docs, T, buffer_size=BUFFER, refill=REFILL))
    return rows.select("lane", "row_no", F.size("tokens").alias("n_tokens"), _md5("tokens").alias("tokens_md5"), "last_idx", "n_docs", "n_cropped")


FILE_ROWS, TRIGGER_FILES = 8192, 32


def order_feed(spark, sf, batches=3, lane="doc_id div 64"):
    """The documents as a file stream, written in ``batches`` runs of doc_id.  A run is dealt to files of about ``FILE_ROWS`` rows by
    lane: a lane's rows of one run are in one file, and files of later runs come later, so a lane arrives in order of
    doc_id however many files a micro-batch takes."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/feeds/{uuid.uuid4().hex}"
    top = docs.select(F.max("doc_id")).scalar()
    files = max(1, -(-docs.count() // (batches * FILE_ROWS)))
    for i in range(batches):  # files are taken in the order in which they were written
        docs.where(F.expr(f"doc_id * {batches}") >= i * (top + 1)).where(F.expr(f"doc_id * {batches}") < (i + 1) * (top + 1)) \
            .repartition(files, F.expr(lane)).write.mode("append").parquet(folder)
    return spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", min(files, TRIGGER_FILES)).parquet(folder)


_RENDER_SQL = f"""
c AS (SELECT conv_id, list({{'role': role, 'text': text, 'p': role = 'assistant' AND length(text) % 3 = 0}} ORDER BY turn) AS ms FROM conversations GROUP BY conv_id),
"""
_MERGED_SQL = """
s AS (SELECT conv_id, ms, coalesce(ms[1].role = 'system', false) AS sys FROM {0}),
m AS (SELECT conv_id, CASE WHEN sys THEN list_concat([{{'role': ms[2].role, 'text': ms[1].text || chr(10) || chr(10) || ms[2].text, 'p': ms[2].p}}], ms[3:]) ELSE ms END AS ms,
             CASE WHEN len(ms) = 0 THEN 'empty' WHEN sys AND NOT coalesce(ms[2].role = 'user', false) THEN 'bad_system' END AS early FROM s),
r AS (SELECT conv_id, ms, coalesce(early, CASE WHEN len(list_filter(range(1, len(ms) + 1), lambda i: coalesce(
               ms[i].role <> CASE WHEN i % 2 = 1 THEN 'user' ELSE 'assistant' END, true))) > 0 THEN 'bad_role' END) AS reason FROM m),
t AS (SELECT conv_id, i, ms[i].role AS role, ms[i].text AS text, ms[i].p AS p FROM (SELECT conv_id, ms, unnest(range(1, len(ms) + 1)) AS i FROM r WHERE reason IS NULL)),
seg AS (
  SELECT conv_id, i, 1 AS j, [257] AS a, text, [258] AS z, 0 AS k FROM t WHERE role = 'user'
  UNION ALL SELECT conv_id, i, 0, [259], '', [], 0 FROM t WHERE role = 'assistant'
  UNION ALL SELECT conv_id, i, 1, [], text, [], 1 FROM t WHERE role = 'assistant' AND NOT p
  UNION ALL SELECT conv_id, i, 1, [], text[1:20], [], 1 FROM t WHERE role = 'assistant' AND p
  UNION ALL SELECT conv_id, i, 2, [261], CAST(length(text) AS VARCHAR) || '*2', [262], 1 FROM t WHERE role = 'assistant' AND p
  UNION ALL SELECT conv_id, i, 3, [263], CAST(2 * length(text) AS VARCHAR), [264], 0 FROM t WHERE role = 'assistant' AND p
  UNION ALL SELECT conv_id, i, 4, [], text[21:], [], 1 FROM t WHERE role = 'assistant' AND p
  UNION ALL SELECT conv_id, i, 5, [260], '', [], 1 FROM t WHERE role = 'assistant'),
ids AS (SELECT conv_id, i, j, k, list_concat(a, list_concat({1}, z)) AS x FROM seg),
o AS (SELECT conv_id, list_concat([256], flatten(list(x ORDER BY i, j)))[1:2048] AS ids,
             list_concat([0], flatten(list(list_transform(x, lambda v: k) ORDER BY i, j)))[1:2048] AS mask FROM ids GROUP BY conv_id)"""


@register("render_parts", "WITH " + _RENDER_SQL + _MERGED_SQL.format("c", BYTES.format("text")) + """
SELECT r.conv_id, r.reason, CAST(len(o.ids) AS INT) AS n_ids, md5(array_to_string(o.ids, ',')) AS ids_md5, md5(array_to_string(o.mask, ',')) AS mask_md5
FROM r LEFT JOIN o USING (conv_id)""")
def render_parts(spark, sf):
    """E7 over byte tokens: conversations with tool calls and outputs among the assistants' texts, ids and mask."""
    r = TK.render_conversation(_conv_messages(spark, sf), [])
    return r.select("conv_id", "reason", F.when(F.col("ids").isNotNull(), F.size("ids")).alias("n_ids"), F.when(F.col("ids").isNotNull(), _md5("ids")).alias("ids_md5"),
                    F.when(F.col("mask").isNotNull(), _md5("mask")).alias("mask_md5"))


@register("completion_parts", "WITH " + _RENDER_SQL + "e AS (SELECT conv_id, ms[1:len(ms) - 1] AS ms FROM c WHERE ms[-1].role = 'assistant'),"
          + _MERGED_SQL.format("e", BYTES.format("text")) + """
SELECT c.conv_id, CASE WHEN c.ms[-1].role <> 'assistant' THEN 'no_last_assistant' ELSE r.reason END AS reason, CAST(len(o.ids) + 1 AS INT) AS n_ids,
       CASE WHEN o.ids IS NOT NULL THEN md5(array_to_string(list_concat(o.ids, [259]), ',')) END AS ids_md5
FROM c LEFT JOIN r USING (conv_id) LEFT JOIN o USING (conv_id)""")
def completion_parts(spark, sf):
    """E8 over byte tokens: prompts of the same conversations, without their last assistant message."""
    r = TK.render_for_completion(_conv_messages(spark, sf), [])
    there = F.col("ids").isNotNull()
    return r.select("conv_id", "reason", F.when(there, F.size("ids")).alias("n_ids"), F.when(there, _md5("ids")).alias("ids_md5"))
