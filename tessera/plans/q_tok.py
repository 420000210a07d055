"""Queries for tokenization and packing.

The split has a SQL oracle: DuckDB's regex engine has no possessive quantifiers or
look-ahead, so the oracle marks the last blank of each run of white space first.  What
depends on trained merges is rows-checked, with hashes of the values; pytest checks it
against Python references.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import pack as PK
from tessera.operators import tok as TK
from tessera.plans.registry import register
from tessera.plans.tables import table
from tessera.plans.views import v_corpus

VOCAB = 256 + 9 + 4096
_MERGES: dict = {}


def merges_for(spark, sf, anew=False):
    """BPE merges trained on the corpus of ``sf``, kept for other queries while the corpus' content is the same."""
    docs = table(spark, sf, "documents")
    content = docs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("text").cast("decimal(38,0)"))).first()
    key = (*content, VOCAB)
    if anew or key not in _MERGES:
        _MERGES[key] = TK.train_bpe(docs, VOCAB)
    return _MERGES[key]


_PIECES_SQL = (r"regexp_extract_all(regexp_replace(text, '(\s)([^\S\r\n]\S)', '\1' || chr(1) || '\2', 'g'), "
               r"'''(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}\x01]?\p{L}+|\p{N}{1,2}| ?[^\s\p{L}\p{N}\x01]+[\r\n]*|\s*[\r\n]|\s+')")


@register("pretokenize", f"""WITH d AS (SELECT doc_id, text, {_PIECES_SQL} AS p FROM documents)
SELECT doc_id, CAST(len(p) AS INT) AS n_pieces, array_to_string(p, '') = text AS lossless, md5(array_to_string(p, chr(2))) AS pieces_md5 FROM d""")
def pretokenize_q(spark, sf):
    """Pieces per document, whether they concatenate back to the text, and a hash of them in order."""
    d = table(spark, sf, "documents").select("doc_id", "text", TK.pretokenize("text").alias("p"))
    return d.select("doc_id", F.size("p").alias("n_pieces"), (F.array_join("p", "") == F.col("text")).alias("lossless"),
                    F.md5(F.array_join("p", "\x02")).alias("pieces_md5"))


@register("piece_counts", f"SELECT piece, count(*) AS count FROM (SELECT unnest({_PIECES_SQL}) AS piece FROM documents) GROUP BY piece")
def piece_counts_q(spark, sf):
    """Pre-token frequency table of the corpus."""
    return TK.piece_counts(table(spark, sf, "documents"))


@register("train_bpe")
def train_bpe_q(spark, sf):
    """E2 + E5 + E6: vocabulary trained on the corpus (256 bytes + 4096 merges + 9 specials)."""
    v = TK.vocab_table(spark, merges_for(spark, sf, anew=True))
    return v.select("token_id", F.hex("token").alias("token_hex"), "is_special", "n_bytes")


def _md5(ids):
    return F.md5(F.concat_ws(",", F.transform(ids, lambda x: x.cast("string"))))


@register("encode")
def encode_q(spark, sf):
    """Documents encoded with bos prepended; their length and a hash of the ids."""
    e = TK.encode_table(table(spark, sf, "documents"), merges_for(spark, sf), "doc_id", prepend="<|bos|>")
    return e.select("doc_id", F.size("ids").alias("n_tokens"), _md5("ids").alias("ids_md5"))


@register("decode_roundtrip", "SELECT doc_id, md5(text) AS text_md5 FROM documents")
def decode_roundtrip_q(spark, sf):
    """decode(encode(text)), which is the text."""
    m = merges_for(spark, sf)
    e = TK.encode_table(table(spark, sf, "documents"), m, "doc_id")
    d = TK.decode_table(e, TK.vocab_table(spark, m), "doc_id")
    return d.select("doc_id", F.md5("text").alias("text_md5"))


def _packed(spark, sf, T=2048, buffer_size=64, refill=16, groups_per_lane=32):
    """The corpus packed in lanes of 32 row groups of a shard, so lanes grow in number with the corpus."""
    m = merges_for(spark, sf)
    c = v_corpus(spark, sf)
    lane = F.concat_ws("/", "shard", F.expr(f"row_group div {groups_per_lane}").cast("string"))
    ids = TK.encode_table(c, m, "idx", prepend="<|bos|>", out="tokens")
    docs = c.select("idx", lane.alias("lane"), F.col("row_group").alias("rg_idx")).join(ids, "idx")
    return docs, PK.pack_bestfit(docs, T, buffer_size=buffer_size, refill=refill, incomplete=True)


@register("pack_bestfit")
def pack_bestfit_q(spark, sf):
    """best-fit packing of the encoded corpus into rows of 2049 tokens, with a hash of each row."""
    _, rows = _packed(spark, sf)
    return rows.where("complete").select("lane", "row_no", F.size("tokens").alias("n_tokens"), _md5("tokens").alias("tokens_md5"), "last_idx",
                                         "n_docs", "n_cropped", "rg_idx")


@register("packing_stats")
def packing_stats_q(spark, sf):
    """kept, cropped and left tokens, and utilisation of the packing above."""
    docs, rows = _packed(spark, sf)
    return PK.packing_stats(docs, rows, 2048)


@register("packing_balance", """WITH c AS (SELECT source, doc_id, strlen(text) + 1 AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos FROM documents)
SELECT source || '/' || CAST(pos // 256 AS VARCHAR) AS lane, CAST(sum(n) AS BIGINT) AS tokens_in, CAST(sum(n) AS BIGINT) AS tokens_out,
       count(*) AS docs_in, count(*) AS docs_out FROM c GROUP BY 1""")
def packing_balance_q(spark, sf):
    """F6/F7 over byte tokens (no merges): of every lane, tokens in = kept + cropped + left, and no document is lost."""
    c = v_corpus(spark, sf)
    lane = F.concat_ws("/", "shard", F.expr("row_group div 32").cast("string"))
    docs = c.select("idx", lane.alias("lane"), TK.encode("text", [], prepend="<|bos|>").alias("tokens"))
    rows = PK.pack_bestfit(docs, 2048, buffer_size=64, refill=16, incomplete=True)
    out = rows.groupBy("lane").agg(F.sum(F.size("tokens") + F.col("n_cropped")).cast("bigint").alias("tokens_out"),
                                   F.sum("n_docs").cast("bigint").alias("docs_out"))
    into = c.groupBy(lane.alias("lane")).agg(F.sum(F.octet_length("text") + 1).cast("bigint").alias("tokens_in"), F.count(F.lit(1)).alias("docs_in"))
    return into.join(out, "lane")


def _conv_messages(spark, sf):
    """Conversations as the renderer takes them.  Assistant texts whose length is a multiple of 3 come in parts: their first
    20 characters, a tool call, its output, and the rest."""
    from tessera.operators.conv import assemble_messages
    a = assemble_messages(table(spark, sf, "conversations"))

    def message(x):
        n = F.char_length(x.text)
        part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
        parts = F.array(part("text", F.substring(x.text, 1, 20)), part("python", F.concat(n.cast("string"), F.lit("*2"))),
                        part("python_output", (n * 2).cast("string")), part("text", F.substring(x.text, F.lit(21), n)))
        split = (x.role == "assistant") & (n % 3 == 0)
        return F.struct(x.role.alias("role"), F.when(~split, x.text).alias("text"), F.when(split, parts).alias("parts"))
    return a.select("conv_id", F.transform("messages", message).alias("messages"))


@register("render_conversation")
def render_conversation_q(spark, sf):
    """Every conversation rendered to ids + mask, cut at 2048 tokens, or the reason why it cannot be."""
    r = TK.render_conversation(_conv_messages(spark, sf), merges_for(spark, sf))
    return r.select("conv_id", "reason", F.size("ids").alias("n_ids"), _md5("ids").alias("ids_md5"), _md5("mask").alias("mask_md5"),
                    F.aggregate("mask", F.lit(0), lambda a, x: a + x).alias("n_supervised"))


@register("render_for_completion")
def render_for_completion_q(spark, sf):
    """Completion prompts (last assistant message dropped, assistant_start appended), or the reason for none."""
    r = TK.render_for_completion(_conv_messages(spark, sf), merges_for(spark, sf))
    return r.select("conv_id", "reason", F.size("ids").alias("n_ids"), _md5("ids").alias("ids_md5"), F.element_at("ids", -1).alias("last_id"))
