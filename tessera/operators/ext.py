"""Extension surface (M1, M4): task registry and user completion callbacks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVAL_TYPES = ("generative", "categorical")


@dataclass(frozen=True)
class Task:
    name: str
    prepare: Callable[[DataFrame], DataFrame]  # raw rows -> conversations / problems
    grade: Callable[[DataFrame], DataFrame]  # problems joined with responses -> ``correct``
    eval_type: str
    baseline: float = 0.0


TASKS: dict[str, Task] = {}


def register_task(name: str, prepare, grade, eval_type: str, baseline: float = 0.0) -> Task:
    """M1: plug a task in; ``eval_type`` must be generative or categorical."""
    if eval_type not in EVAL_TYPES:
        raise ValueError(f"eval_type must be one of {EVAL_TYPES}, got {eval_type!r}")
    t = Task(name, prepare, grade, eval_type, baseline)
    TASKS[name] = t
    return t


def run_task(name: str, raw: DataFrame, responses: DataFrame, keys: list[str],
             completion: str = "completion") -> DataFrame:
    """M1: prepare the raw rows of a registered task, attach responses (a missing
    one is '' and wrong, H4), grade, and report accuracy with the task baseline."""
    from tessera.operators import score as S
    task = TASKS[name]
    problems = task.prepare(raw)
    joined = S.join_predictions(problems, responses.select(*keys, completion), keys, completion)
    graded = task.grade(joined)
    acc = S.accuracy(graded)
    return (acc.withColumn("task", F.lit(name)).withColumn("eval_type", F.lit(task.eval_type))
            .withColumn("baseline", F.lit(task.baseline)))


def complete_with(df: DataFrame, fn: Callable[[str], str], prompt: str = "prompt", num_samples: int = 1) -> DataFrame:
    """M4: call a user completion function on every prompt (``num_samples`` times).

    Runs inside ``mapInPandas`` batches on the executors; an exception gives an
    empty completion and an ``error`` text, never a failed job.  Output keeps
    all input columns plus ``sample``, ``completion`` and ``error``.
    """
    from tessera.session import ensure_shipped
    ensure_shipped(df.sparkSession)
    base = df.drop("completion", "error").withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(num_samples - 1))))
    schema = T.StructType(list(base.schema.fields) + [T.StructField("completion", T.StringType()),
                                                      T.StructField("error", T.StringType())])

    def run(batches):
        for pdf in batches:
            comp, err = [], []
            for p in pdf[prompt]:
                try:
                    comp.append(fn(p))
                    err.append(None)
                except Exception as e:  # noqa: BLE001 - a failed call is a wrong answer, not a failed job
                    comp.append("")
                    err.append(f"{type(e).__name__}: {e}")
            yield pdf.assign(completion=pd.Series(comp, dtype=object), error=pd.Series(err, dtype=object))
    return base.mapInPandas(run, schema)


# ---------------------------------------------------------------- M2
@dataclass(frozen=True)
class TokenizerSpec:
    """Tokenizer protocol used by the encode/render operators: batch encode,
    decode and the special-token ids (all picklable, shipped to executors)."""
    encode_batch: Callable[[list[str]], list[list[int]]]
    decode: Callable[[list[int]], str]
    specials: dict


TOKENIZERS: dict[str, TokenizerSpec] = {}


def register_tokenizer(name: str, encode_batch, decode, specials: dict) -> TokenizerSpec:
    """M2: register a tokenizer; specials must include ``<|bos|>`` or another bos candidate."""
    from tessera.operators.tok import BOS_CANDIDATES
    if not any(c in specials for c in BOS_CANDIDATES):
        raise ValueError("tokenizer needs a bos special token")
    spec = TokenizerSpec(encode_batch, decode, dict(specials))
    TOKENIZERS[name] = spec
    return spec


def bpe_tokenizer(merges) -> TokenizerSpec:
    """The package's own byte-level BPE as a TokenizerSpec."""
    import regex

    from tessera.operators import tok as TK
    from tessera.operators.bpe import PieceEncoder
    encoder = PieceEncoder(list(merges))
    tokens = TK.token_bytes_list(list(merges)) + [s.encode() for s in TK.SPECIAL_TOKENS]

    def encode_batch(texts):
        split = regex.compile(TK.SPLIT_PATTERN)  # the pieces that E1's native split gives
        return encoder.encode_lists(pa.array([split.findall(t) for t in texts], pa.list_(pa.string())), [], []).to_pylist()
    return TokenizerSpec(encode_batch, lambda ids: b"".join(tokens[i] for i in ids).decode("utf-8", errors="replace"),
                         {s: TK.special_id(list(merges), s) for s in TK.SPECIAL_TOKENS})


ENCODE_CHARS = 1 << 20


def runs_of(texts: list[str], size: int):
    """``texts`` in runs of at most ``size`` characters; a longer text is a run of its own."""
    run, held = [], 0
    for t in texts:
        if run and held + len(t) > size:
            yield run
            run, held = [], 0
        run.append(t)
        held += len(t)
    if run:
        yield run


def encode_with(col, spec: TokenizerSpec, prepend: int | None = None):
    """Encode a text column with a registered tokenizer, texts of about ``ENCODE_CHARS`` characters at a time."""
    from pyspark.sql import types as T_

    from tessera.session import bound_batches, ensure_shipped
    ensure_shipped()
    bound_batches(SparkSession.getActiveSession())

    @F.pandas_udf(T_.ArrayType(T_.IntegerType()))
    def _enc(s: pd.Series) -> pd.Series:
        pre = [prepend] if prepend is not None else []
        return pd.Series([np.array(pre + list(x), np.int32) for some in runs_of(s.fillna("").tolist(), ENCODE_CHARS) for x in spec.encode_batch(some)],
                         dtype=object)
    return _enc(F.col(col) if isinstance(col, str) else col)


def decode_with(col, spec: TokenizerSpec):
    """Decode an id column with a registered tokenizer (Arrow batches)."""
    from tessera.session import bound_batches, ensure_shipped
    ensure_shipped()
    bound_batches(SparkSession.getActiveSession())

    @F.pandas_udf(T.StringType())
    def _dec(s: pd.Series) -> pd.Series:
        return pd.Series([spec.decode(list(x)) for x in s])
    return _dec(F.col(col) if isinstance(col, str) else col)


# ---------------------------------------------------------------- M3
def score_with(df: DataFrame, fn: Callable, keys: list[str], tokens: str = "tokens") -> DataFrame:
    """M3: a user scorer over batches of token sequences -> the long loss table
    ``(keys, pos, token, loss, pred_token)``; the last position has no target,
    so its loss and prediction are null.

    ``fn(list_of_token_lists) -> list of (losses, preds)`` runs once per Arrow
    batch inside ``mapInPandas`` (one model load per Python worker if the
    caller caches it).
    """
    from tessera.session import ensure_shipped
    ensure_shipped(df.sparkSession)
    key_fields = [f for f in df.schema.fields if f.name in keys]
    schema = T.StructType(key_fields + [T.StructField("_token", T.ArrayType(T.IntegerType())), T.StructField("_loss", T.ArrayType(T.DoubleType())),
                                        T.StructField("_pred", T.ArrayType(T.IntegerType()))])

    def run(batches):
        for pdf in batches:
            seqs = [list(map(int, t)) for t in pdf[tokens]]
            scored = fn(seqs)
            yield pdf[keys].assign(_token=seqs, _loss=[list(map(float, x)) for x, _ in scored], _pred=[list(map(int, p)) for _, p in scored])
    arrays = df.select(*keys, tokens).mapInPandas(run, schema)
    rows = arrays.select(*keys, F.size("_token").alias("_n"), F.posexplode(F.arrays_zip("_token", "_loss", "_pred")).alias("pos", "_z"))
    inner = F.col("pos") < F.col("_n") - 1  # the last position has no target
    return rows.where("pos < _n").select(*keys, "pos", F.col("_z._token").alias("token"), F.when(inner, F.col("_z._loss")).alias("loss"),
                                         F.when(inner, F.col("_z._pred")).alias("pred_token"))
