"""WARC archives of web pages with a two-level capture index.

Writing: every page becomes a WARC/1.1 record in a gzip member of its own.  Of
pages with equal payloads (SHA-1 and a second hash) of ``min_bytes`` or more,
that with the largest id is a ``response``, the others are ``revisit`` records
without payload that refer to it; all smaller ones are responses.  Spark's text
writer writes and commits the files: a row is a member, the line separator an
empty member, so a file is a plain multi-member gzip file that starts with a
``warcinfo`` record.

Index: the archives are scanned once.  Every record gives a line whose key is its
URL with the host reversed (``com,example,www)/path``).  Lines are sorted over
all partitions and cut into compressed blocks of ``BLOCK_LINES``; each index file
ends in a sparse directory (first key and place of each block) and a footer of
fixed length that tells where the directory is.

Reading: sorted keys are searched in the first keys of the index files (one a
range partition, so their number is a parameter), then in the file's directory,
then in the block, which is read as a byte range; so are the records found, in
the order of their places.  Tasks read ranges through ``pyarrow.fs`` from the
folder of the archives, which every executor must reach; the pages themselves
are read by Spark only.  Memory: a directory, a block and a record a task.

Defined results: a null payload counts as empty; a null id is the least and stays
null; a null URL becomes ``urn:page:`` with the id.  Rows that repeat id, URL and
payload are records of their own, one of them the response.  Ties between equal
ids of different URLs go to the greater URL.  Empty tables give archives without
records, an empty index and no row.
"""

from __future__ import annotations

import base64
import bisect
import dataclasses
import gzip
import hashlib
import json
import re
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termlens.llm.common import cut_lineage, scratch_table_path

BLOCK_LINES = 3000             # lines of an index block
LEVEL = 5                      # of compression
DATE = "1970-01-01T00:00:00Z"  # of pages without a date of capture
READ_BYTES = 1 << 20           # window of range reads
FEED_BYTES = 1 << 14           # compressed bytes given to the decompressor at once
MAX_BROADCAST_GROUPS = 500_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def member(data: bytes, level: int = LEVEL) -> bytes:
    """A gzip member without time stamp."""
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


SEPARATOR = member(b"", 9)
FOOTER = 32                    # digits of the directory's offset and length
FOOTER_BYTES = len(member(b"0" * FOOTER, 0)) + len(SEPARATOR)


def write_members(rows: DataFrame, path: str) -> None:
    """Writes the binary column ``member`` of ``rows``, a file a partition, in order."""
    rows.select(F.col("member").cast("string")).write.option("lineSep", SEPARATOR.decode("latin-1")).option(
        "encoding", "ISO-8859-1").text(path)


# ---- records -----------------------------------------------------------------

def record_id(page_id: str | None, url: str, sha1: str, copy: int) -> str:
    said = json.dumps([page_id, url, sha1, copy]).encode()
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.blake2b(said, digest_size=16).digest())}>"


def header_text(value: str) -> str:
    """A header value: control characters and spaces as %XX."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """(header fields, block) of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    size = int(fields["Content-Length"])
    if len(rest) != size + 4:
        raise ValueError(f"a record of {size} bytes has {len(rest) - 4}")
    return fields, rest[:size]


def base32(sha1: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1)).decode()


def resolved(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html",
             min_bytes: int = 0) -> DataFrame:
    """(pid, uri, sha1, copy, data, rpid, ruri): the records to write; of a revisit, without data, id and URL of its response."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(
        F.col(page_id).alias("id"), F.col(page_id).cast("string").alias("pid"),
        F.coalesce(F.col(url), F.concat(F.lit("urn:page:"), F.coalesce(F.col(page_id).cast("string"), F.lit("null")))).alias("uri"),
        body.alias("data")).select("*", F.sha1("data").alias("sha1"), F.xxhash64("data").alias("h"))
    # first the repeated rows, then the groups: no task gets a whole group of copies
    each = rows.where(F.octet_length("data") >= min_bytes).groupBy("sha1", "h", "id", "pid", "uri").agg(F.count("*").alias("n"))
    groups = each.groupBy("sha1", "h").agg(F.max(F.struct("id", "uri", "pid", "n")).alias("w"), F.sum("n").alias("c")).where("c > 1")
    groups = cut_lineage(groups.select("sha1", "h", F.col("w.pid").alias("rpid"), F.col("w.uri").alias("ruri"), F.col("w.n").alias("n")))
    small = groups.count() <= MAX_BROADCAST_GROUPS
    both = rows.drop("id").join(F.broadcast(groups) if small else groups, ["sha1", "h"], "left")
    first = F.col("ruri").isNull() | (F.col("pid").eqNullSafe(F.col("rpid")) & (F.col("uri") == F.col("ruri")))
    out = both.select("pid", "uri", "sha1", F.lit(0).alias("copy"), F.when(first, F.col("data")).alias("data"),
                      F.when(~first, F.col("rpid")).alias("rpid"), F.when(~first, F.col("ruri")).alias("ruri"),
                      (first & F.coalesce(F.col("n") > 1, F.lit(False))).alias("tied"), "n")
    if not groups.where("n > 1").limit(1).count():
        return out.drop("tied", "n")
    # rows that repeat the response itself: one stays, the others are copies that refer to it
    tied = out.where("tied").groupBy("pid", "uri", "sha1").agg(F.any_value("data").alias("data"), F.max("n").alias("n"))
    tied = tied.select("pid", "uri", "sha1", "data", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("copy"))
    tied = tied.select("pid", "uri", "sha1", "copy", F.when(F.col("copy") == 0, F.col("data")).alias("data"),
                       F.when(F.col("copy") > 0, F.col("pid")).alias("rpid"), F.when(F.col("copy") > 0, F.col("uri")).alias("ruri"))
    return out.where("NOT tied").drop("tied", "n").unionByName(tied)


def page_record(pid: str | None, uri: str, sha1: str, copy: int, data: bytes | None, rpid: str | None, ruri: str | None,
                date: str = DATE) -> bytes:
    fields = [("WARC-Type", "revisit" if data is None else "response"), ("WARC-Record-ID", record_id(pid, uri, sha1, copy)),
              ("WARC-Date", date), ("WARC-Target-URI", header_text(uri)), ("WARC-Payload-Digest", f"sha1:{base32(sha1)}"),
              ("Content-Type", "application/http; msgtype=response")]
    if pid is not None:
        fields.append(("Page-ID", header_text(pid)))
    if data is None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(rpid, ruri, sha1, 0)),
                   ("WARC-Refers-To-Target-URI", header_text(ruri)), ("WARC-Refers-To-Date", date)]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if data is not None:
        http += f"Content-Length: {len(data)}\r\n".encode()
    return record(fields, http + b"\r\n" + (data or b""))


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    info = b"software: termlens\r\nformat: WARC File Format 1.1\r\n"
    started = False
    for b in batches:
        out = []
        if not started and len(b):
            started = True
            own = record_id(b["pid"].iloc[0], b["uri"].iloc[0], "warcinfo", 0)
            out.append(member(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", own), ("WARC-Date", DATE),
                                      ("Content-Type", "application/warc-fields")], info)))
        for row in zip(*(b[c] for c in ("pid", "uri", "sha1", "copy", "data", "rpid", "ruri")), strict=True):
            out.append(member(page_record(*row)))
        yield pd.DataFrame({"member": out})


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, **columns: str) -> None:
    """Writes the archives of ``pages`` to the new folder ``path``."""
    write_members(resolved(pages, min_bytes=min_bytes, **columns).mapInPandas(_members, "member binary"), path)


# ---- files -------------------------------------------------------------------

def open_file(path: str):
    """A random-access file on any store that pyarrow knows."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem().open_input_file(urllib.parse.unquote(re.sub("^file:/*", "/", path)))
    fs, name = pafs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", path))
    return fs.open_input_file(name)


class Ranges:
    """Byte ranges of files; ascending reads of a file share a window."""

    def __init__(self) -> None:
        self.path, self.file, self.at, self.window = None, None, 0, b""

    def read(self, path: str, offset: int, length: int) -> bytes:
        if path != self.path:
            if self.file is not None:
                self.file.close()
            self.path, self.file, self.window = path, open_file(path), b""
        if not self.at <= offset <= offset + length <= self.at + len(self.window):
            self.at, self.window = offset, self.file.read_at(max(length, READ_BYTES), offset)
        got = self.window[offset - self.at:offset - self.at + length]
        if len(got) != length:
            raise EOFError(f"{path} ends before {offset + length}")
        return got


def members(path: str) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of a file's members, separators left out; one in memory at a time."""
    with open_file(path) as f:
        at, rest = 0, b""
        while True:
            d, out, size = zlib.decompressobj(31), [], 0
            while not d.eof:
                piece = rest or f.read(FEED_BYTES)
                if not piece:
                    if size:
                        raise EOFError(f"{path} ends in a member")
                    return
                out.append(d.decompress(piece))
                rest = d.unused_data
                size += len(piece) - len(rest)
            data = b"".join(out)
            if data:
                yield at, size, data
            at += size


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the files of a folder; nothing is read."""
    return spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")


# ---- index -------------------------------------------------------------------

URL_PARTS = r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/:?#]*)(?::([0-9]*))?([^#]*)"


def url_key(uri: Column) -> Column:
    """Sort key of a URL: reversed host, port unless it is the usual one, path and query; no fragment.
    Control characters and spaces count alike, escaped or not."""
    host, port, rest = (F.regexp_extract(uri, URL_PARTS, i) for i in (1, 2, 3))
    key = F.concat(F.array_join(F.reverse(F.split(F.lower(host), r"\.")), ","),
                   F.when(port.isin("", "80", "443"), F.lit("")).otherwise(F.concat(F.lit(":"), port)), F.lit(")"),
                   F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest)))
    return F.regexp_replace(key, r"[\x00-\x20\x7f]|%[01][0-9A-Fa-f]|%20|%7[Ff]", "_")


RECORD = "path string, offset long, length long, type string, uri string, record_id string"


def records(spark: SparkSession, path: str) -> DataFrame:
    """(path, offset, length, type, uri, record_id) of all page records, by a scan of the archives."""
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p in b["path"]:
                out = []
                for offset, length, data in members(p):
                    f = parsed(data)[0]
                    if f["WARC-Type"] != "warcinfo":
                        out.append((p, offset, length, f["WARC-Type"], f["WARC-Target-URI"], f["WARC-Record-ID"]))
                    if len(out) == BLOCK_LINES:
                        yield pd.DataFrame(out, columns=[c.split()[0] for c in RECORD.split(", ")])
                        out = []
                yield pd.DataFrame(out, columns=[c.split()[0] for c in RECORD.split(", ")])

    found = files(spark, path)
    n = max(found.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism)
    return found.repartition(n).mapInPandas(scan, RECORD)          # a file is one row: dealt evenly


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted (key, line) rows to the members of an index file."""
    keys, lines, directory, at = [], [], [], 0

    def block() -> bytes:
        nonlocal keys, lines, at
        data = member("".join(f"{k} {x}\n" for k, x in zip(keys, lines, strict=True)).encode())
        directory.append((keys[0], at, len(data)))
        keys, lines, at = [], [], at + len(data) + len(SEPARATOR)
        return data

    for b in batches:
        out = []
        for key, line in zip(b["key"], b["line"], strict=True):
            keys.append(key)
            lines.append(line)
            if len(keys) == BLOCK_LINES:
                out.append(block())
        yield pd.DataFrame({"member": out})
    out = [block()] if keys else []
    if directory:
        data = member("".join(f"{k} {o} {n}\n" for k, o, n in directory).encode())
        out += [data, member(f"{at:016d}{len(data):016d}".encode(), 0)]
    yield pd.DataFrame({"member": out})


def write_index(found: DataFrame, path: str, shards: int | None = None) -> None:
    """Writes the index of ``records`` to the new folder ``path``, a file for each of ``shards`` ranges of keys."""
    spark = found.sparkSession
    lines = cut_lineage(found.select(url_key(F.col("uri")).alias("key"), "path", "offset", F.to_json(F.struct(
        "path", "offset", "length", "type", "uri", "record_id")).alias("line")))
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "path", "offset"]              # a key of very many records is spread over files
    write_members(lines.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInPandas(_blocks, "member binary"), path)


@dataclasses.dataclass(frozen=True)
class Index:
    """First level: per index file its first key, path and directory's place, by key."""
    shards: list[tuple[str, str, int, int]]

    @staticmethod
    def load(spark: SparkSession, path: str) -> Index:
        def first_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ranges = Ranges()
            for b in batches:
                out = []
                for p, size in zip(b["path"], b["length"], strict=True):
                    digits = gzip.decompress(ranges.read(p, size - FOOTER_BYTES, FOOTER_BYTES))
                    offset, length = int(digits[:16]), int(digits[16:])
                    out.append((directory_of(ranges, p, offset, length)[0][0], p, offset, length))
                yield pd.DataFrame(out, columns=["key", "path", "offset", "length"])

        rows = files(spark, path).mapInPandas(first_keys, "key string, path string, offset long, length long").collect()
        return Index(sorted((tuple(r) for r in rows), key=lambda r: (r[0].encode(), r[1])))


def directory_of(ranges: Ranges, path: str, offset: int, length: int) -> list[tuple[str, int, int]]:
    rows = gzip.decompress(ranges.read(path, offset, length)).decode().split("\n")[:-1]
    return [(k, int(o), int(n)) for k, o, n in (r.rsplit(" ", 2) for r in rows)]


def holding(firsts: list[bytes], key: bytes) -> range:
    """Places of the sorted pieces, known by their first keys, that may hold ``key``."""
    return range(max(bisect.bisect_left(firsts, key) - 1, 0), bisect.bisect_right(firsts, key))


class Search:
    """Finds the lines of ascending keys; keeps one directory and one block."""

    def __init__(self, index: Index) -> None:
        self.shards, self.firsts = index.shards, [s[0].encode() for s in index.shards]
        self.ranges, self.shard, self.place = Ranges(), None, None

    def lines(self, key: str) -> Iterator[str]:
        sought = key.encode()
        for s in holding(self.firsts, sought):
            if s != self.shard:
                self.shard, (_, self.path, offset, length) = s, self.shards[s]
                self.directory = directory_of(self.ranges, self.path, offset, length)
                self.starts, self.place = [k.encode() for k, _, _ in self.directory], None
            for b in holding(self.starts, sought):
                if b != self.place:
                    self.place, (_, offset, length) = b, self.directory[b]
                    rows = gzip.decompress(self.ranges.read(self.path, offset, length)).decode().split("\n")[:-1]
                    self.keys, self.found = zip(*(r.split(" ", 1) for r in rows), strict=True)
                    self.keys = [k.encode() for k in self.keys]
                for i in range(bisect.bisect_left(self.keys, sought), bisect.bisect_right(self.keys, sought)):
                    yield self.found[i]


def lookup(keys: DataFrame, index: Index) -> DataFrame:
    """The records (as of :func:`records`, with their key) of every different key of ``keys`` (its column ``key``)."""
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = Search(index)
        for b in batches:
            out = []
            for key in b["key"]:
                for line in found.lines(key):
                    out.append((key, *json.loads(line).values()))
                    if len(out) == BLOCK_LINES:        # a key may have very many
                        yield pd.DataFrame(out, columns=["key", *(c.split()[0] for c in RECORD.split(", "))])
                        out = []
            yield pd.DataFrame(out, columns=["key", *(c.split()[0] for c in RECORD.split(", "))])

    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = keys.select("key").where("key IS NOT NULL").distinct()
    return keys.repartitionByRange(n, "key").sortWithinPartitions("key").mapInPandas(search, f"key string, {RECORD}")


FETCHED = "page_id string, type string, record_id string, refers_to string, payload_bytes long, payload_digest string"


def fetch(found: DataFrame, payload: bool = False) -> DataFrame:
    """Page id, type, record id, reference, and bytes and digest of the payload (of a revisit: null and the noted digest)
    of looked-up records, read by ranges; with ``payload`` its bytes too.  A payload that isn't its digest's is an error."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranges = Ranges()
        for b in batches:
            out, held = [], 0
            for path, offset, length in zip(b["path"], b["offset"], b["length"], strict=True):
                f, block = parsed(gzip.decompress(ranges.read(path, offset, length)))
                body = None if f["WARC-Type"] == "revisit" else block.partition(b"\r\n\r\n")[2]
                digest = f["WARC-Payload-Digest"].removeprefix("sha1:")
                if body is not None and base32(hashlib.sha1(body).hexdigest()) != digest:
                    raise ValueError(f"{path}: the payload at {offset} is not that of its digest")
                row = (f.get("Page-ID"), f["WARC-Type"], f["WARC-Record-ID"], f.get("WARC-Refers-To"),
                       None if body is None else len(body), digest)
                out.append((*row, body) if payload else row)
                held += len(body or b"") * payload
                if held > READ_BYTES * 16:
                    yield _fetched(out, payload)
                    out, held = [], 0
            yield _fetched(out, payload)

    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = found.select("path", "offset", "length").repartitionByRange(n, "path", "offset").sortWithinPartitions("path", "offset")
    return rows.mapInPandas(read, FETCHED + (", payload binary" if payload else ""))


def _fetched(rows: list[tuple], payload: bool) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in FETCHED.split(", ")] + ["payload"] * payload)
    return out.astype({"payload_bytes": "Int64"})


def with_references(fetched: DataFrame) -> DataFrame:
    """``fetched`` records, those of revisits with payload size and page id (``response_id``) of the response they name."""
    answers = fetched.where("type = 'response'").select(
        F.col("record_id").alias("refers_to"), F.col("page_id").alias("response_id"), F.col("payload_bytes").alias("full"))
    again = fetched.where("type = 'revisit'").join(answers, "refers_to")
    first = fetched.where("type = 'response'").withColumn("response_id", F.lit(None).cast("string"))
    return first.unionByName(again.withColumn("payload_bytes", F.col("full")).select(*first.columns))


def round_trip(pages: DataFrame, min_bytes: int = 0, page_id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Archives of ``pages`` written, indexed, every page's URL looked up and its records read back."""
    spark = pages.sparkSession
    archive, index = scratch_table_path(spark, "archive"), scratch_table_path(spark, "captures")
    write_archives(pages, archive, min_bytes, page_id=page_id, url=url, payload=payload)
    write_index(records(spark, archive), index)
    asked = F.coalesce(F.col(url), F.concat(F.lit("urn:page:"), F.coalesce(F.col(page_id).cast("string"), F.lit("null"))))
    found = cut_lineage(lookup(pages.select(url_key(asked).alias("key")), Index.load(spark, index)))
    return with_references(cut_lineage(fetch(found)))
