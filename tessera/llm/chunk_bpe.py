"""BPE encoding with content-defined chunk reuse, and decoding.

A rolling hash of the last ``WINDOW`` bytes cuts texts into chunks of about ``2 ** BITS``
bytes wherever they lie, so copies and shared passages fall into equal chunks.  The body
of a chunk runs from its first to its last word start; a body that occurs twice or more
is encoded once.  What lies between shared bodies (chunk joins, and chunks of their own)
is encoded where it stands, as text from word start to word start.  Each join is tested:
the words at its two sides, encoded together, must give the ids they give apart.  Where
they don't, the join is widened over the whole body, which is then encoded in place with
its neighbours, until all joins agree.  So the ids equal those of one call on the whole
text for any tokenizer whose ids depend on neighbouring words only.

Texts without a shared body are finished where they are read.  Of the others, parts of
ids meet by document and are hashed in order as a stream; no text is shuffled but one
copy of each shared body from each task.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import string

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import _BYTE, _SPACE, bit_filter, hash_runs, in_filter, mix, prepare, release_memory, rolling, text_slices, written

WINDOW, BITS = 32, 10
CALL_BYTES = 1 << 16
_OTHER = mix(_BYTE + np.uint64(99))


_UNIT = re.compile(rb"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")  # a word with the white space before it
_PUNCTUATION, _ALNUM = string.punctuation.encode(), frozenset((string.ascii_letters + string.digits).encode())
#: bytes of the memo of a worker, with what Python takes for an entry
MEMO_BYTES, ENTRY_BYTES = 96 << 20, 320


class Codec:
    """A tokenizer file, opened once in each worker.

    Where no token can reach over a word start (``by_word``), texts are encoded word by word with a
    bounded memo, as most words come again and again; other tokenizers get each text as a whole.
    """

    open_files: dict = {}

    def __init__(self, path: str):
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        size = self.tok.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.by_word, self.memo = self._by_word(path), {}
        suffix = getattr(self.tok.model, "end_of_word_suffix", None)
        self.word_ends = np.array([(self.tok.id_to_token(i) or "").endswith(suffix) for i in range(size)]) if suffix else None
        if self.tok.decoder is None:  # decode() joins the tokens by one blank
            pieces = [(self.tok.id_to_token(i) or "").encode() + b" " for i in range(size)]
            self.length = np.array([len(p) for p in pieces])
            self.at = np.cumsum(self.length) - self.length
            self.bytes = np.frombuffer(b"".join(pieces), np.uint8)

    @classmethod
    def of(cls, path: str) -> Codec:
        if path not in cls.open_files:
            cls.open_files[path] = cls(path)
        return cls.open_files[path]

    def _by_word(self, path: str) -> bool:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = spec["pre_tokenizer"] or {}
        steps = steps.get("pretokenizers", [steps])
        splits = [x for x in steps if x.get("type") == "Split" and x["pattern"].get("Regex", "").endswith("[^\\s\\p{L}\\p{N}]+") and x["invert"]]
        byte_level = [x for x in steps if x.get("type") == "ByteLevel" and x.get("use_regex", True) and not x["add_prefix_space"]]
        marks = [t for t in spec["added_tokens"] if t["special"] and not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"])]
        self.mark, self.mark_id = (marks[0]["content"].encode(), marks[0]["id"]) if marks and len(marks[0]["content"]) > 2 else (None, None)
        normal = spec["normalizer"] or {}
        self.folds = bool(splits) and any(x.get("type") == "Lowercase" for x in normal.get("normalizers", [normal]))
        plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"])) for t in spec["added_tokens"])
        return plain and bool(splits or byte_level)

    def _encode(self, texts: list[bytes]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tok.encode_batch([t.decode("utf-8") for t in texts], add_special_tokens=False)]

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def _cut(self, ids: np.ndarray, starts: list[int], ends: list[int]) -> list[bytes]:
        raw, size = ids.tobytes(), self.kind.itemsize
        return [raw[a * size:b * size] for a, b in zip(starts, ends, strict=True)]

    def _encode_units(self, units: list[bytes]) -> list[bytes]:
        """Ids of short units.  Words of letters go into one text, parted by blanks, where each ends with a token
        that marks the word's end; others are parted by a special token, as that parts texts exactly."""
        texts = [u.decode("utf-8") for u in units]
        known: dict[bytes, bytes] = {}
        if self.folds and self.word_ends is not None:
            words = [i for i, t in enumerate(texts) if t.isalpha() and max(t) < "\u0250"]
            ids = self._ids(" ".join([texts[i] for i in words]))
            ends = (np.flatnonzero(self.word_ends[ids]) + 1).tolist()
            if words and len(ends) == len(words):
                known = dict(zip([units[i] for i in words], self._cut(ids, [0, *ends[:-1]], ends), strict=True))
        rest = [u for u in units if u not in known]
        plain = [u for u in rest if self.mark is not None and self.mark[:2] not in u]
        if plain:
            ids = self._ids(self.mark.join(plain).decode("utf-8"))
            ends = [*np.flatnonzero(ids == self.mark_id).tolist(), len(ids)]
            known.update(zip(plain, self._cut(ids, [0, *(e + 1 for e in ends[:-1])], ends), strict=True))
        odd = [u for u in rest if u not in known]
        known.update(zip(odd, self._encode(odd) if odd else [], strict=True))
        return [known[u] for u in units]

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of UTF-8 texts."""
        if not self.by_word:
            return [np.frombuffer(x, self.kind) for x in self._encode(texts)]
        # a tokenizer that drops white space needs none before its words
        units = [t.split() for t in texts] if self.folds else [_UNIT.findall(t) for t in texts]
        if len(self.memo) * ENTRY_BYTES > MEMO_BYTES:
            self.memo.clear()
        memo = self.memo
        memo[b""] = b""
        new = list(set().union(*units).difference(memo))
        parts = [self._stem(u) for u in new]
        missing = list({x for pair in parts for x in pair}.difference(memo))
        for a in range(0, len(missing), 5_000):
            part = missing[a:a + 5_000]
            memo.update(zip(part, self._encode_units(part), strict=True))
        memo.update((u, memo[stem] + memo[tail] if tail else memo[stem]) for u, (stem, tail) in zip(new, parts, strict=True))
        return [np.frombuffer(b"".join(map(memo.__getitem__, words)), self.kind) for words in units]

    def _stem(self, unit: bytes) -> tuple[bytes, bytes]:
        """A unit as two texts whose ids follow each other: without ASCII punctuation after its last ASCII letter
        or digit, where a token always ends, and the rest; in lower case where the tokenizer lowers itself."""
        if self.mark and self.mark[:2] in unit:
            return unit, b""
        if self.folds:
            unit = unit.lower()
        stem = unit.rstrip(_PUNCTUATION)
        return (stem, unit[len(stem):]) if stem and stem[-1] in _ALNUM else (unit, b"")

    def decoded(self, ids: np.ndarray) -> bytes:
        """The ids' pieces, each followed by a blank (tokenizers without a decoder)."""
        n = self.length[ids]
        place = np.arange(n.sum()) + np.repeat(self.at[ids] - (np.cumsum(n) - n), n)
        return self.bytes[place].tobytes()


class Digest:
    """Running hashes of one document's ids and decoded text."""

    def __init__(self, codec: Codec):
        self.codec, self.n, self.ids, self.text, self.all = codec, 0, hashlib.sha256(), hashlib.sha256(), []

    def add(self, ids: np.ndarray) -> None:
        if not len(ids):
            return
        self.ids.update(ids.astype("<u4").tobytes())
        if self.codec.tok.decoder is not None:
            self.all.append(ids)
        else:
            text = self.codec.decoded(ids)
            self.text.update((b" " if self.n else b"") + text[:-1])
        self.n += len(ids)

    def row(self) -> tuple[int, str, str]:
        if self.all:
            whole = self.codec.tok.decode(np.concatenate(self.all).tolist(), skip_special_tokens=False)
            self.text.update(whole.encode())
        return self.n, self.ids.hexdigest(), self.text.hexdigest()


def bodies(data: np.ndarray, off: np.ndarray):
    """Chunk bodies of the texts: (text, start, end, key 1, key 2), and the word starts."""
    n = len(data)
    z = np.zeros(0, np.int64)
    if not n:
        return z, z, z, z, z, z
    space = _SPACE[data]
    cuts = np.flatnonzero(space[1:] & ~space[:-1]) + 1  # white space leads the word after it
    if n > WINDOW:
        ends = np.flatnonzero(rolling(data, WINDOW) < np.uint64(1 << (64 - BITS))) + WINDOW
    else:
        ends = z
    edge = np.unique(np.concatenate([ends, off]))
    s, e = edge[:-1], edge[1:]
    lo, hi = np.searchsorted(cuts, s + 1), np.searchsorted(cuts, e)
    whole = hi - lo >= 2
    s, e, lo, hi = s[whole], e[whole], lo[whole], hi[whole]
    a, b = cuts[lo], cuts[hi - 1]
    text = np.searchsorted(off, a, "right") - 1
    return text, a, b, hash_runs(data, a, b).view(np.int64), hash_runs(data, a, b, _OTHER).view(np.int64), cuts


def _keys(batches):
    for batch in batches:
        for _, data, off in text_slices(batch):
            _, _, _, k1, k2, _ = bodies(data, off)
            yield pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2)], ["k1", "k2"])


def _segments(a: int, b: int, cuts: np.ndarray):
    """[a, b) in pieces of about CALL_BYTES, cut at word starts."""
    while b - a > CALL_BYTES:
        i = np.searchsorted(cuts, a + CALL_BYTES)
        if i == len(cuts) or cuts[i] >= b:
            break
        yield a, int(cuts[i])
        a = int(cuts[i])
    yield a, b


def _joins_agree(codec: Codec, raw: bytes, cuts: np.ndarray, spans: list[tuple[int, int, int, int]]) -> np.ndarray:
    """For each body (start, end, text start, text end): whether the words at both its ends encode
    together, in one plain call of the tokenizer, as they do apart.  Where they do not, the codec no longer
    encodes by words."""
    joined, texts, place = [], [], []
    for i, (a, b, lo, hi) in enumerate(spans):
        for cut, left, right in ((a, lo, b), (b, a, hi)):
            j = int(np.searchsorted(cuts, cut))
            p = max(left, int(cuts[j - 1]) if j else 0)
            q = min(right, int(cuts[j + 1]) if j + 1 < len(cuts) else right)
            joined.append(raw[p:q])
            texts += [raw[p:cut], raw[cut:q]]
            place.append(i)
    once = list(dict.fromkeys(joined))
    whole = dict(zip(once, codec._encode(once) if once else [], strict=True))
    ids = codec.encode(texts)
    agree = np.ones(len(spans), bool)
    for k, i in enumerate(place):
        agree[i] &= whole[joined[k]] == np.concatenate(ids[2 * k:2 * k + 2]).astype(codec.kind).tobytes()
    codec.by_word &= bool(agree.all())
    return agree


def _leaving(run):
    """A task that leaves no memo behind: idle workers would hold it while other operators run."""
    def task(batches):
        try:
            yield from run(batches)
        finally:
            for codec in Codec.open_files.values():
                codec.memo = {}
            release_memory()
    return task


def _parts(path: str, shared):
    """Rows of three kinds: 0, a finished document; 1, a part of an open one (ids, or the key of a
    shared body); 2, a shared body's text, once in each run of rows."""
    def run(batches):
        codec, words = Codec.of(path), shared.value
        pack = zstandard.ZstdCompressor(level=1).compress
        uid = TaskContext.get().partitionId() << 40
        sent: set = set()
        for batch in batches:
            for sub, data, off in text_slices(batch):
                raw = data.tobytes()
                text, a, b, k1, k2, cuts = bodies(data, off)
                hit = in_filter(words, k1)
                text, a, b, k1, k2 = text[hit], a[hit], b[hit], k1[hit], k2[hit]
                agree = _joins_agree(codec, raw, cuts, list(zip(a.tolist(), b.tolist(), off[text].tolist(), off[text + 1].tolist(), strict=True)))
                text, a, b, k1, k2 = text[agree], a[agree], b[agree], k1[agree], k2[agree]
                first = np.searchsorted(text, np.arange(len(off)))
                calls, layout = [], []
                for t in range(len(off) - 1):
                    at, here = int(off[t]), []
                    ends = [(int(a[i]), int(b[i]), i) for i in range(first[t], first[t + 1])]
                    for x, y, i in [*ends, (int(off[t + 1]), 0, None)]:
                        for piece in _segments(at, x, cuts) if x > at else ():
                            here.append((len(calls), None))
                            calls.append(piece)
                        if i is not None:
                            here.append((None, i))
                            at = y
                    layout.append(here)
                ids = codec.encode([raw[x:y] for x, y in calls])
                out = []
                for t, (doc, here) in enumerate(zip(sub.column(0).to_pylist(), layout, strict=True)):
                    uid += 1
                    if first[t] == first[t + 1]:
                        d = Digest(codec)
                        for c, _ in here:
                            d.add(ids[c])
                        out.append((0, doc, uid, 0, None, None, None, *d.row()))
                        continue
                    for o, (c, i) in enumerate(here):
                        if c is not None:
                            out.append((1, doc, uid, o, None, None, pack(ids[c].tobytes()), None, None, None))
                            continue
                        key = (int(k1[i]), int(k2[i]))
                        out.append((1, doc, uid, o, *key, None, None, None, None))
                        if key not in sent:
                            sent.add(key)
                            out.append((2, None, None, None, *key, pack(raw[a[i]:b[i]]), None, None, None))
                    if len(sent) > 200_000:
                        sent.clear()
                cols = list(zip(*out, strict=True)) if out else [[] for _ in FIELDS]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, FIELDS, strict=True)], [n for n, _ in FIELDS])
    return run


FIELDS = [("kind", pa.int32()), ("doc_id", pa.int64()), ("uid", pa.int64()), ("ordinal", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()),
          ("payload", pa.binary()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
DDL = "kind int, doc_id bigint, uid bigint, ordinal bigint, k1 bigint, k2 bigint, payload binary, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def _encode_bodies(path: str):
    def run(batches):
        codec, pack, unpack = Codec.of(path), zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress
        for batch in batches:
            ids = codec.encode([unpack(x) for x in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([pack(x.tobytes()) for x in ids], pa.binary())],
                                             ["k1", "k2", "ids"])
    return run


def _assemble(path: str):
    """Rows (doc_id, uid, ordinal, ids) sorted by (uid, ordinal), whole documents: a row for each."""
    def run(frames):
        codec, unpack = Codec.of(path), zstandard.ZstdDecompressor().decompress
        uid = doc = digest = None
        for f in frames:
            out = []
            for d, u, ids in zip(f["doc_id"], f["uid"], f["ids"], strict=True):
                if u != uid:
                    if digest:
                        out.append((doc, *digest.row()))
                    uid, doc, digest = u, None if pd.isna(d) else int(d), Digest(codec)
                digest.add(np.frombuffer(unpack(ids), codec.kind))
            if out:
                yield _rows(out)
        if digest:
            yield _rows([(doc, *digest.row())])
    return run


def _rows(out):
    frame = pd.DataFrame(out, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return frame.astype({"doc_id": "Int64"})


def encode(docs: DataFrame, path: str, min_uses: int = 2) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document row.

    ``path`` is the tokenizer file on every machine.  A null text counts as empty: no ids, and the
    hashes of no bytes.  Repeated rows and null ids give a row each; other columns are ignored; an
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared = docs.mapInArrow(_keys, "k1 bigint, k2 bigint").groupBy("k1", "k2").count().where(F.col("count") >= min_uses)
    words = bit_filter(shared, "k1")
    sent = spark.sparkContext.broadcast(words)
    parts = written(docs.mapInArrow(_leaving(_parts(path, sent)), DDL))
    sent.destroy()
    done = parts.where("kind = 0").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    texts = parts.where("kind = 2").groupBy("k1", "k2").agg(F.first("payload").alias("payload"))
    ids = texts.mapInArrow(_leaving(_encode_bodies(path)), "k1 bigint, k2 bigint, ids binary")
    open_ = parts.where("kind = 1")
    reused = open_.where("k1 is not null").select("doc_id", "uid", "ordinal", "k1", "k2").join(ids, ["k1", "k2"])
    pieces = (open_.where("k1 is null").select("doc_id", "uid", "ordinal", F.col("payload").alias("ids"))
              .unionByName(reused.select("doc_id", "uid", "ordinal", "ids")))
    joined = (pieces.repartition(n, "uid").sortWithinPartitions("uid", "ordinal")
              .mapInPandas(_leaving(_assemble(path)), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"))
    return done.unionByName(joined)
