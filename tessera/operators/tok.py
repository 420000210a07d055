"""Tokenization (E1-E11, I19): texts are split natively; training works on the distinct
pieces, encoding and decoding are narrow passes over Arrow batches (``bpe``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import bpe
from tessera.session import bound_batches, cut_lineage, ensure_shipped

# ---------------------------------------------------------------- fixed values
SPECIAL_TOKENS = [
    "<|bos|>",
    "<|user_start|>",
    "<|user_end|>",
    "<|assistant_start|>",
    "<|assistant_end|>",
    "<|python_start|>",
    "<|python_end|>",
    "<|output_start|>",
    "<|output_end|>",
]
SPLIT_PATTERN = (r"""'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}+|\p{N}{1,2}| ?[^\s\p{L}\p{N}]++[\r\n]*"""
                 r"""|\s*[\r\n]|\s+(?!\S)|\s+""")


def pretokenize(text) -> Column:
    """GPT-4 style split (numbers in groups of at most two); native, no UDF.
    The pieces concatenate back to the input."""
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(t, F.lit("(?U)" + SPLIT_PATTERN), F.lit(0))


def piece_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Pre-token frequencies (partial + final aggregate, so a very common
    piece costs one row per map task)."""
    return (df.select(F.explode(pretokenize(text)).alias("piece")).groupBy("piece")
            .agg(F.count(F.lit(1)).alias("count")))


def train_bpe(df: DataFrame, vocab_size: int, text: str = "text", **options) -> list[tuple[int, int]]:
    """Byte-level BPE merges, ``vocab_size - 9`` base and merged tokens; at each step the pair of most occurrences, ties by
    the lowest pair.

    The corpus is reduced once to distinct pieces with counts (the shuffle).  The driver holds the merge list, the counts of
    a bounded number of pairs and a bounded sample of pieces; see ``bpe.train`` and its options.
    """
    n_merges = vocab_size - len(SPECIAL_TOKENS) - 256
    if n_merges < 0:
        raise ValueError("vocab_size - 9 must be at least 256")
    return bpe.train(cut_lineage(piece_counts(df, text)), n_merges, **options)


def token_bytes_list(merges: list[tuple[int, int]]) -> list[bytes]:
    out = [bytes([i]) for i in range(256)]
    for a, b in merges:
        out.append(out[a] + out[b])
    return out


def vocab_table(spark: SparkSession, merges: list[tuple[int, int]]) -> DataFrame:
    """E5 + E6: ``(token_id, token, is_special, n_bytes)``; specials follow the merges
    and count 0 bytes.  Size is the vocabulary size (broadcastable)."""
    toks = token_bytes_list(merges)
    rows = [(i, bytearray(t), False) for i, t in enumerate(toks)]
    rows += [(len(toks) + i, bytearray(s.encode()), True) for i, s in enumerate(SPECIAL_TOKENS)]
    v = spark.createDataFrame(rows, "token_id int, token binary, is_special boolean")
    return v.withColumn("n_bytes", F.when(F.col("is_special"), 0).otherwise(F.octet_length("token")))


def _id(merges, token: int | str | None) -> list[int]:
    return [] if token is None else [special_id(merges, token) if isinstance(token, str) else token]


def encode_table(df: DataFrame, merges: list[tuple[int, int]], key: str, text: str = "text",
                 prepend: int | str | None = None, append: int | str | None = None, out: str = "ids") -> DataFrame:
    """E3 over a table: (key, ids), a narrow pass.  Null and empty texts have no pieces."""
    return df.select(key, encode(text, merges, prepend, append).alias(out))


MAX_VOCABULARY = 1 << 20


def decode_table(df: DataFrame, vocab: DataFrame, key: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """E4 over a table: (key, text) by a ``vocab`` (token_id from 0 on, token) of at most ``MAX_VOCABULARY`` tokens; bytes that
    are no UTF-8 are replaced, null ids give an empty text."""
    rows = vocab.select("token_id", "token").limit(MAX_VOCABULARY + 1).toArrow().sort_by("token_id")
    if rows.num_rows > MAX_VOCABULARY or rows.column("token_id").to_pylist() != list(range(rows.num_rows)):
        raise ValueError(f"token ids must be 0, 1, 2, ... and at most {MAX_VOCABULARY}")
    return df.select(key, _decoded(F.col(ids), rows.column("token").to_pylist()).alias(out))


def special_id(merges: list[tuple[int, int]], name: str) -> int:
    return 256 + len(merges) + SPECIAL_TOKENS.index(name)


def encode(text, merges: list[tuple[int, int]], prepend: int | str | None = None,
           append: int | str | None = None) -> Column:
    """E3 as a column: pieces split natively, distinct pieces of a batch merged together (special-token text is not
    parsed).  ``prepend`` / ``append`` take a token id or a special-token name."""
    ensure_shipped()
    bound_batches(SparkSession.getActiveSession())
    encoder = SparkSession.getActiveSession().sparkContext.broadcast(bpe.PieceEncoder(merges))  # vocabulary-sized
    before, after = _id(merges, prepend), _id(merges, append)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def _enc(pieces: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in pieces:
            yield encoder.value.encode_lists(batch, before, after)
    whole = F.col(text) if isinstance(text, str) else text
    return _enc(pretokenize(text) if merges else F.array(F.coalesce(whole, F.lit(""))))  # without merges a text's ids are its bytes, however it is split


def _decoded(ids: Column, tokens: list[bytes]) -> Column:
    ensure_shipped()
    bound_batches(SparkSession.getActiveSession())
    table = SparkSession.getActiveSession().sparkContext.broadcast(bpe.token_table(tokens))  # vocabulary-sized

    @F.arrow_udf(T.BinaryType())
    def _dec(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield bpe.decoded(batch, *table.value)
    text = _dec(ids).cast("string")
    return F.coalesce(F.try_validate_utf8(text), F.make_valid_utf8(text))


def decode(ids, merges: list[tuple[int, int]]) -> Column:
    """E4 as a column: ids -> text (invalid UTF-8 replaced)."""
    return _decoded(F.col(ids) if isinstance(ids, str) else ids, token_bytes_list(merges) + [s.encode() for s in SPECIAL_TOKENS])


# ---------------------------------------------------------------- E9
# ---------------------------------------------------------------- fixed values
BOS_RULES = [
    (r"llama-?3|meta-llama-3", "<|begin_of_text|>"),
    (r"llama-?2|llama-?1", "<s>"),
    (r"gemma", "<bos>"),
    (r"gpt2|gpt-2", "<|endoftext|>"),
]
BOS_CANDIDATES = ["<|bos|>", "<bos>", "<|endoftext|>", "<|begin_of_text|>", "<s>"]


def resolve_bos(models: DataFrame, vocab: DataFrame, key: list[str], name: str = "model") -> DataFrame:
    """The first rule whose regex matches the lower-case model name gives the
    bos token; when that token is absent (or nothing matches) the first present
    candidate is used.  ``vocab``: (token string, token_id)."""
    from tessera.operators.report import first_match
    from tessera.plans.guards import broadcast_small
    spark = models.sparkSession
    rules = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(BOS_RULES)], "rule_no int, pattern string, value string")
    m = models.withColumn("_lname", F.lower(F.col(name)))
    hit = first_match(m, rules, "_lname", key, kind="regex", out="_rule_token")
    v = broadcast_small(vocab.select(F.col("token").alias("_rule_token"), F.col("token_id").alias("_rule_id")), "vocab")
    cands = spark.createDataFrame(list(enumerate(BOS_CANDIDATES)), "rank int, token string")
    fallback = (cands.join(vocab.select("token", "token_id"), "token")
                .agg(F.min(F.struct("rank", "token_id")).getField("token_id")).scalar())
    return hit.join(v, "_rule_token", "left").withColumn("bos_id", F.coalesce(F.col("_rule_id"), fallback)) \
        .drop("_lname", "_rule_id")


# ---------------------------------------------------------------- E10 / E11
def trim_generation(ids, prompt_len, terminals: list[int], mask=None) -> tuple[Column, Column]:
    """Cut at the first terminal token at or after the prompt end (terminal
    not kept); mask 0 over the prompt, the generation mask (or 1) after."""
    t, p = (F.col(ids) if isinstance(ids, str) else ids), (F.col(prompt_len) if isinstance(prompt_len, str) else prompt_len)
    term = F.array(*[F.lit(x) for x in terminals])
    hits = F.filter(F.transform(t, lambda x, i: F.when((i >= p) & F.array_contains(term, x), i)), lambda x: x.isNotNull())
    cut = F.when(F.size(hits) > 0, F.array_min(hits)).otherwise(F.size(t))
    out = F.slice(t, 1, cut)
    gm = (F.col(mask) if isinstance(mask, str) else mask) if mask is not None else None
    m = F.transform(out, lambda x, i: F.when(i < p, F.lit(0)).otherwise(
        F.element_at(gm, i + 1) if gm is not None else F.lit(1)))
    return out, m


def tool_spans(ids, python_start: int, python_end: int) -> Column:
    """Token spans between python_start and python_end; a new start resets
    the span, an end outside a block is ignored, empty spans give no call."""
    t = F.col(ids) if isinstance(ids, str) else ids
    pos_of = lambda tok: F.filter(F.transform(t, lambda x, i: F.when(x == tok, i)), lambda x: x.isNotNull())
    starts, ends = pos_of(python_start), pos_of(python_end)

    def span(e):
        s = F.array_max(F.filter(starts, lambda x: x < e))
        prev = F.coalesce(F.array_max(F.filter(ends, lambda x: x < e)), F.lit(-1))
        ok = s.isNotNull() & (s > prev) & (e - s > 1)
        return F.when(ok, F.slice(t, s + 2, e - s - 1))
    return F.filter(F.transform(ends, span), lambda x: x.isNotNull())


# ---------------------------------------------------------------- E7 / E8
def render_conversation(convs: DataFrame, merges: list[tuple[int, int]], max_tokens: int = 2048,
                        conv: str = "conv_id", messages: str = "messages") -> DataFrame:
    """Token ids and supervision mask per conversation.

    ``messages``: ``array<struct<role, text, parts array<struct<type, text>>>>``
    (``parts`` null for plain string content).  A leading system message is
    merged into the first user message (B3).  bos, then per message its
    start/end markers: mask 1 for assistant text, python calls (with their
    markers) and assistant_end; 0 for bos, user turns, assistant_start and
    python outputs (with markers).  Both arrays are cut at ``max_tokens``.
    A conversation that does not alternate user and assistant (after the
    merge) is a row without ids and a ``reason``: ``empty``, ``bad_system``
    (a system message before another than the user's) or ``bad_role``.

    Texts are exploded to one row per part, encoded in one Arrow UDF, and the
    per-part id arrays regrouped per conversation (a bounded group) in order.
    """
    sid = lambda n: special_id(merges, n)
    m = F.col(messages)
    first, second = F.element_at(m, 1), F.try_element_at(m, F.lit(2))
    is_sys = F.coalesce(first.getField("role") == "system", F.lit(False))
    merged = F.when(is_sys, F.concat(
        F.array(second.withField("text", F.concat(first.getField("text"), F.lit("\n\n"), second.getField("text")))),
        F.slice(m, 3, F.greatest(F.size(m) - 2, F.lit(0))))).otherwise(m)
    bad_role = F.exists(F.transform(merged, lambda x, i: F.coalesce(
        x.getField("role") != F.when(i % 2 == 0, "user").otherwise("assistant"), F.lit(True))), lambda x: x)
    reason = (F.when(m.isNull() | (F.size(m) == 0), "empty")
              .when(is_sys & ~F.coalesce(second.getField("role") == "user", F.lit(False)), "bad_system").when(bad_role, "bad_role"))
    checked = convs.select(conv, m.alias(messages), reason.alias("reason"))
    convs = checked.where("reason is null")
    msgs = convs.select(conv, F.posexplode(merged).alias("turn", "msg"))
    parts = F.coalesce(F.col("msg.parts"), F.array(F.struct(F.lit("text").alias("type"), F.col("msg.text").alias("text"))))
    rows = msgs.select(conv, "turn", F.col("msg.role").alias("role"), F.posexplode(parts).alias("part", "p"))
    rows = rows.select(conv, "turn", "role", "part", F.col("p.type").alias("type"),
                       encode(F.col("p.text"), merges).alias("ids"))
    role, typ, ids = F.col("role"), F.col("type"), F.col("ids")
    is_user, is_asst = role == "user", role == "assistant"
    one = lambda n: F.array(F.lit(sid(n)))
    seg_ids = (F.when(is_user, F.concat(one("<|user_start|>"), ids, one("<|user_end|>")))
               .when(typ == "python", F.concat(one("<|python_start|>"), ids, one("<|python_end|>")))
               .when(typ == "python_output", F.concat(one("<|output_start|>"), ids, one("<|output_end|>")))
               .otherwise(ids))
    seg_mask = F.when(is_user | (typ == "python_output"), F.lit(0)).otherwise(F.lit(1))
    segs = rows.select(conv, "turn", "part", role.alias("role"), seg_ids.alias("sids"),
                       F.array_repeat(seg_mask, F.size(seg_ids)).alias("smask"))
    # assistant start / end markers as extra segments around the parts
    turns = segs.groupBy(conv, "turn", "role").agg(
        F.sort_array(F.collect_list(F.struct("part", "sids", "smask"))).alias("ps"))
    body_ids = F.flatten(F.transform("ps", lambda x: x.sids))
    body_mask = F.flatten(F.transform("ps", lambda x: x.smask))
    a = F.col("role") == "assistant"
    t_ids = F.when(a, F.concat(one("<|assistant_start|>"), body_ids, one("<|assistant_end|>"))).otherwise(body_ids)
    t_mask = F.when(a, F.concat(F.array(F.lit(0)), body_mask, F.array(F.lit(1)))).otherwise(body_mask)
    per_turn = turns.select(conv, "turn", t_ids.alias("tids"), t_mask.alias("tmask"))
    conv_rows = per_turn.groupBy(conv).agg(F.sort_array(F.collect_list(F.struct("turn", "tids", "tmask"))).alias("ts"))
    all_ids = F.concat(one("<|bos|>"), F.flatten(F.transform("ts", lambda x: x.tids)))
    all_mask = F.concat(F.array(F.lit(0)), F.flatten(F.transform("ts", lambda x: x.tmask)))
    rendered = conv_rows.select(conv, F.slice(all_ids, 1, max_tokens).alias("ids"),
                                F.slice(all_mask, 1, max_tokens).alias("mask"), F.lit(None).cast("string").alias("reason"))
    none = F.lit(None).cast("array<int>")
    return rendered.unionByName(checked.where("reason is not null").select(conv, none.alias("ids"), none.alias("mask"), "reason"))


def render_for_completion(convs: DataFrame, merges: list[tuple[int, int]], max_tokens: int = 2048,
                          conv: str = "conv_id", messages: str = "messages") -> DataFrame:
    """Drop the final assistant message (B4), render (E7), then append
    assistant_start after the truncation.  Conversations that do not end with
    an assistant message, or that E7 rejects, are rows without ids and a
    ``reason`` (``no_last_assistant`` or E7's)."""
    m = F.col(messages)
    ends = F.coalesce(F.try_element_at(m, F.lit(-1)).getField("role") == "assistant", F.lit(False))
    popped = convs.where(ends).withColumn(messages, F.slice(m, 1, F.size(m) - 1))
    r = render_conversation(popped, merges, max_tokens, conv, messages)
    start = F.array(F.lit(special_id(merges, "<|assistant_start|>")))
    done = r.select(conv, F.concat("ids", start).alias("ids"), "reason")
    return done.unionByName(convs.where(~ends).select(conv, F.lit(None).cast("array<int>").alias("ids"), F.lit("no_last_assistant").alias("reason")))
