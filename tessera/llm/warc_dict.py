"""WARC archives of pages, compressed record by record with a Zstandard dictionary.

Every task writes its pages to archive files (``*.warc.zst``) in a shared folder.  A file
starts with a skippable frame that holds the dictionary (so a file can be read alone), then
has one Zstandard frame for each record, compressed with that dictionary.  The dictionary
is built from the records of at most ``SAMPLE`` pages (those of smallest id hash).

Of pages with equal payloads the one with the smallest id is a ``response``, the others are
``revisit`` records without payload, which name the response by its record id.  Files are
written under a name of the attempt's own and then renamed, so a task that is run again
leaves no half-written archive.

The folder is any that pyarrow's file systems reach from the executors (shared mount, HDFS,
S3): the folder the cluster names in spark.checkpoint.dir.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid

import pandas as pd
import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import prepare, written
from tessera.session import checkpoint_dir

SKIPPABLE = 0x184D2A5D  # magic number of a frame that holds a WARC dictionary
SAMPLE = 1_000
SAMPLE_BYTES = 16 << 20
DICTIONARY_BYTES = 112_640
FILE_BYTES = 256 << 20  # compressed size from which the next record starts a new file
LEVEL = 3
DATE = "2000-01-01T00:00:00Z"  # the tables carry no capture time
RECORD_ID = "<urn:x-page:{}>"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def header_value(value: str | None) -> str:
    """A header value on one line: control characters and line ends as percent escapes."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value or "")


def record(page_id: int | None, url: str | None, payload: bytes, sha: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP header, which states the payload's length, and drops the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {RECORD_ID.format('null' if page_id is None else page_id)}",
            f"WARC-Date: {DATE}", f"WARC-Target-URI: {header_value(url)}", f"WARC-Payload-Digest: sha1:{sha}", f"WARC-Block-Digest: sha1:{digest(block)}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {RECORD_ID.format(refers_to)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def train(samples: list[bytes]) -> bytes:
    """A Zstandard dictionary of the sample records; none (empty) if they are too few or too alike."""
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(512, sum(map(len, samples)) // 8)), samples).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def leading_frame(dictionary: bytes) -> bytes:
    return SKIPPABLE.to_bytes(4, "little") + len(dictionary).to_bytes(4, "little") + dictionary


def read_records(stream):
    """(headers, block) of each record of an archive: the dictionary first, then frame by frame."""
    head = stream.read(8)
    if not head:
        return
    if int.from_bytes(head[:4], "little") != SKIPPABLE:
        raise ValueError("the archive does not start with a dictionary frame")
    dictionary = stream.read(int.from_bytes(head[4:], "little"))
    opened = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()
    rest = b""
    while True:
        one, out = opened.decompressobj(), []
        while not one.eof:
            data = rest or stream.read(1 << 20)
            if not data:
                if out:
                    raise ValueError("the archive ends inside a record")
                return
            out.append(one.decompress(data))
            rest = one.unused_data if one.eof else b""
        raw = b"".join(out)
        if not raw:
            continue
        cut = raw.index(b"\r\n\r\n")
        lines = raw[:cut].decode("utf-8").split("\r\n")
        headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        if lines[0] != "WARC/1.1" or raw[cut + 4 + int(headers["Content-Length"]):] != b"\r\n\r\n":
            raise ValueError("malformed record")
        yield headers, raw[cut + 4:len(raw) - 4]


def _samples(frames):
    taken, size = [], 0
    for f in frames:
        for page_id, url, page in f[["page_id", "url", "html"]].itertuples(index=False):
            payload = (page or "").encode("utf-8")
            if size + len(payload) <= SAMPLE_BYTES:  # a very long page is left to others of the sample
                taken.append(record(None if pd.isna(page_id) else int(page_id), url, payload, digest(payload), None, False))
                size += len(payload)
    yield pd.DataFrame({"dictionary": [train(taken)]})


class _Files:
    """The archive files of one task attempt."""

    def __init__(self, root: str, dictionary: bytes):
        self.fs, self.root = pafs.FileSystem.from_uri(root)
        self.fs.create_dir(self.root, recursive=True)
        self.frame = leading_frame(dictionary)
        self.pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        self.stream, self.done, self.n = None, [], 0

    def add(self, raw: bytes) -> None:
        if self.stream is None:
            context = TaskContext.get()
            self.name = f"part-{context.partitionId():05d}-{len(self.done):03d}"
            self.temp = f"{self.root}/.{self.name}-{context.taskAttemptId()}-{uuid.uuid4().hex}"
            self.stream = self.fs.open_output_stream(self.temp, compression=None)
            self.stream.write(self.frame)
            self.size = self.n = 0
        frame = self.pack.compress(raw)
        self.stream.write(frame)
        self.size, self.n = self.size + len(frame), self.n + 1
        if self.size >= FILE_BYTES:
            self.close()

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.fs.move(self.temp, f"{self.root}/{self.name}.warc.zst")
            self.done.append((f"{self.root}/{self.name}.warc.zst", self.n))
            self.stream = None


def _write(root, dictionary):
    def run(frames):
        files = _Files(root, dictionary.value)
        for f in frames:
            for page_id, url, page, winner, again in f[["page_id", "url", "html", "winner", "again"]].itertuples(index=False):
                payload = (page or "").encode("utf-8")
                page_id, winner = (None if pd.isna(x) else int(x) for x in (page_id, winner))
                files.add(record(page_id, url, payload, digest(payload), winner, bool(again)))
        files.close()
        yield pd.DataFrame(files.done, columns=["path", "records"])
    return run


def _read(root):
    def run(frames):
        store, _ = pafs.FileSystem.from_uri(root)
        for f in frames:
            for path in f["path"]:
                out = []
                with store.open_input_stream(path, compression=None) as stream:
                    for h, block in read_records(stream):
                        out.append(_row(h, block))
                        if len(out) == 1000:
                            yield _frame(out)
                            out = []
                yield _frame(out)
    return run


_COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri"]


def _row(headers: dict, block: bytes):
    cut = block.index(b"\r\n\r\n")
    size = int(re.search(rb"\r\nContent-Length: (\d+)", block[:cut])[1])
    sha = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    if headers["WARC-Type"] == "response" and (len(block) - cut - 4 != size or digest(block[cut + 4:]) != sha):
        raise ValueError(f"payload of {headers['WARC-Record-ID']} differs from its digest")
    number = lambda x: None if x in (None, RECORD_ID.format("null")) else int(x[len("<urn:x-page:"):-1])
    return (number(headers["WARC-Record-ID"]), size, sha, headers["WARC-Type"], number(headers.get("WARC-Refers-To")), headers.get("WARC-Target-URI", ""))


def _frame(rows):
    return pd.DataFrame(rows, columns=_COLUMNS).astype({"page_id": "Int64", "refers_to": "Int64"})


def write_archives(pages: DataFrame, folder: str, min_revisit: int = 0) -> DataFrame:
    """Write a record for each page row; returns (path, records) of the files.

    ``pages`` has page_id, url and html.  Payloads under ``min_revisit`` bytes are always responses.  A null html is
    the empty payload; a null url an empty target; rows of null page_id are responses and never referred to
    (all of them, whatever their payload); of repeated rows of the winning id and payload every one is a response; other
    columns are ignored; an empty table writes no file.
    """
    spark = pages.sparkSession
    prepare(spark)
    pages = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    payload = F.coalesce(F.col("html"), F.lit(""))
    pages = pages.withColumn("sha", F.sha1(payload))
    digests = written(pages.select("page_id", "sha", F.octet_length(payload).alias("n")))
    known = digests.where("page_id is not null")
    first = known.groupBy("sha", "n").agg(F.min("page_id").alias("winner"), F.count(F.lit(1)).alias("uses")).where("uses > 1")
    again = (known.join(first, ["sha", "n"]).where((F.col("page_id") > F.col("winner")) & (F.col("n") >= min_revisit))
             .select(F.col("page_id").alias("_page"), F.col("sha").alias("_sha"), "winner").distinct())
    ids = written(digests.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(SAMPLE))
    chosen = pages.join(F.broadcast(ids.select(F.col("page_id").alias("_id"))), F.col("page_id") == F.col("_id"), "left_semi")  # at most SAMPLE ids
    built = chosen.repartition(1).mapInPandas(_samples, "dictionary binary").first()
    dictionary = spark.sparkContext.broadcast(bytes(built[0]) if built else b"")
    rows = pages.join(again, (F.col("page_id") == F.col("_page")) & (F.col("sha") == F.col("_sha")), "left").select("page_id", "url", "html", "winner", F.col("winner").isNotNull().alias("again"))
    return written(rows.mapInPandas(_write(folder, dictionary), "path string, records bigint"))


def read_archives(spark: SparkSession, files: DataFrame, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri) of the archives named in
    ``files``; payloads are checked against their digests."""
    prepare(spark)
    paths = files.select("path").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return paths.mapInPandas(_read(folder), "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, "
                             "target_uri string")


def archive(pages: DataFrame, min_revisit: int = 0) -> DataFrame:
    """Write the pages to archives in a new folder beside the checkpoints, and read them back."""
    spark = pages.sparkSession
    base = checkpoint_dir(spark).rstrip("/")
    folder = f"{base if '://' in base or base.startswith('file:') else 'file://' + base}/tessera-warc/{uuid.uuid4().hex}"
    folder = re.sub(r"^file:/(?!/)", "file:///", folder)
    return read_archives(spark, write_archives(pages, folder, min_revisit), folder)
