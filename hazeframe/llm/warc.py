"""WARC archives: writing capture runs, reading them back, and the external index merge.

``write_runs`` turns captures into WARC/1.1 response and revisit records. Every task sorts its own
rows by (URL key, time, id) and writes them as gzip archives through Spark's text sink (a record is
one value, the blank lines between records are the line separator), so an archive is a locally
sorted capture run; nothing but the small table of repeated digests is shuffled.

``read_runs`` parses archives by Content-Length in bounded memory (one record at a time) and gives
an index entry per record, with its run and position. ``merge_runs`` is the external merge: entries
are dealt to ranges of (URL key, time, id); every range task merges the segments of all runs with a
loser tree; positions become global by adding the sizes of the ranges before. A URL with a third
of all captures is split over ranges by time and id.

Equal payloads (by SHA-1 and size) of at least ``min_bytes`` are stored once: the capture with the
largest id is the response, all others revisit it and carry its payload digest, size (the HTTP
Content-Length) and record id.

Defined cases: null html = empty payload; null url = no target URI, URL key ``""``; null id = record
``<urn:x-page:null>``, always a response; repeated ids of the response id are responses all; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazeframe.llm.store import pin, scratch

RECORDS_PER_FILE = 2000
ROWS_PER_RANGE = 50_000
# The digits of base 32 as Spark's conv writes them and as RFC 4648 does.
_CONV32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_RFC32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CRLF = "\r\n"


def url_key(url: Column) -> Column:
    """Sort-friendly key: reversed host labels, ``)``, path and query; lower case, no fragment."""
    rest = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.\-]*://(www\d*\.)?|#.*$", "")
    host = F.regexp_extract(rest, r"^[^/?:]*", 0)
    tail = F.regexp_replace(rest, r"^[^/?:]*(:\d+)?", "")
    return F.when(rest == "", F.lit("")).otherwise(
        F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), tail))


def sha1_base32(c: Column) -> Column:
    """Bare upper-case base32 SHA-1: every five hex digits are four base-32 digits."""
    h = F.sha1(c.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(h, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*parts), _CONV32, _RFC32)


def captures(pages: DataFrame, epoch: int = 1_704_067_200) -> DataFrame:
    """page_id, url, payload, digest, size, time and URL key of every page.

    Pages carry no capture time; it is ``epoch`` plus the id in seconds.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("payload"))
    return p.select(
        "*", sha1_base32(F.col("payload")).alias("digest"), F.octet_length("payload").cast("long").alias("size"),
        F.date_format(F.timestamp_seconds(F.lit(epoch) + F.coalesce("page_id", F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time"),
        url_key(F.col("url")).alias("urlkey"))


def write_runs(pages: DataFrame, path: str, min_bytes: int = 0, records_per_file: int = RECORDS_PER_FILE) -> None:
    c = captures(pages)
    again = (c.where(F.col("size") >= min_bytes).groupBy("digest", "size")
             .agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    c = c.join(again, ["digest", "size"], "left")
    revisit = F.coalesce(F.col("response") != F.col("page_id"), F.lit(False))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(_CRLF))
    rid = lambda x: F.concat(F.lit("<urn:x-page:"), F.coalesce(x.cast("string"), F.lit("null")), F.lit(">"))
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}"),
                    line("Content-Length", F.col("size").cast("string")), F.lit(_CRLF))
    body = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    record = F.concat(
        F.lit(f"WARC/1.1{_CRLF}"), line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", rid(F.col("page_id"))), line("WARC-Date", F.col("time")),
        F.coalesce(line("WARC-Target-URI", uri), F.lit("")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.when(revisit, F.concat(line("WARC-Refers-To", rid(F.col("response"))), line("WARC-Profile", F.lit(_REVISIT)))).otherwise(F.lit("")),
        F.lit(f"Content-Type: application/http; msgtype=response{_CRLF}"),
        line("Content-Length", F.octet_length(body).cast("string")), F.lit(_CRLF), body)
    (c.sortWithinPartitions("urlkey", "time", "page_id").select(record.alias("value"))
     .write.option("compression", "gzip").option("lineSep", _CRLF * 2)
     .option("maxRecordsPerFile", records_per_file).text(path))


class _Stream:
    """Bytes of a gzip archive (any number of members), decompressed as they are asked for."""

    def __init__(self, data: bytes, step: int = 1 << 18):
        self.data, self.step, self.at, self.buf, self.pos = memoryview(data), step, 0, bytearray(), 0
        self.z = zlib.decompressobj(31) if data[:2] == b"\x1f\x8b" else None

    def _more(self) -> bool:
        if self.at >= len(self.data):
            return False
        part = bytes(self.data[self.at:self.at + self.step])
        self.at += len(part)
        while part:
            if self.z is None:
                self.buf += part
                break
            self.buf += self.z.decompress(part)
            part = self.z.unused_data if self.z.eof else b""
            if self.z.eof:
                self.z = zlib.decompressobj(31)
        return True

    def until(self, mark: bytes) -> bytes | None:
        seen = self.pos
        while (i := self.buf.find(mark, seen)) < 0:
            seen = max(self.pos, len(self.buf) - len(mark) + 1)
            if not self._more():
                return None
        out = bytes(self.buf[self.pos:i])
        self.pos = i + len(mark)
        return out

    def take(self, n: int) -> bytes:
        while len(self.buf) - self.pos < n:
            if not self._more():
                raise ValueError("archive ends inside a record")
        out = bytes(self.buf[self.pos:self.pos + n])
        self.pos += n
        if self.pos > 1 << 20:
            del self.buf[:self.pos]
            self.pos = 0
        return out


def _headers(head: bytes) -> dict[str, str]:
    pairs = (x.split(": ", 1) for x in head.decode("utf-8", "surrogateescape").split(_CRLF)[1:])
    return {p[0].lower(): p[1] for p in pairs if len(p) == 2}


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of an archive."""
    s = _Stream(data)
    while (head := s.until(b"\r\n\r\n")) is not None:
        if not head.startswith(b"WARC/1."):
            raise ValueError("no WARC record where one is due")
        h = _headers(head)
        block = s.take(int(h["content-length"]))
        s.take(4)
        yield h, block


_ENTRY = ("run string, nth long, urlkey string, time string, page_id long, record_type string, "
          "payload_bytes long, payload_digest string, refers_to long, uri string")


def read_runs(spark, path: str) -> DataFrame:
    """An index entry per record; ``nth`` is its place in the run. Digests are of the payload read."""
    def run(batches):
        for rb in batches:
            for name, body in zip(rb.column(0).to_pylist(), rb.column(1), strict=True):
                rows: list[tuple] = []
                for nth, (h, block) in enumerate(records(body.as_py())):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    rid = lambda k, h=h: None if h.get(k, "<urn:x-page:null>")[12:-1] == "null" else int(h[k][12:-1])
                    revisit = h["warc-type"] == "revisit"
                    said = h["warc-payload-digest"].removeprefix("sha1:")
                    digest = said if revisit else base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    if digest != said:
                        raise ValueError(f"payload digest of {h['warc-record-id']} differs from its header")
                    size = int(_headers(head)["content-length"]) if revisit else len(payload)
                    rows.append((name.rsplit("/", 1)[-1], nth, None, h["warc-date"], rid("warc-record-id"), h["warc-type"],
                                 size, digest, rid("warc-refers-to") if revisit else None, h.get("warc-target-uri")))
                for at in range(0, len(rows), 10_000):
                    cols = list(zip(*rows[at:at + 10_000], strict=True))
                    s, i = pa.string(), pa.int64()
                    kinds = [s, i, s, s, i, s, i, s, i, s]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)],
                                                     names=[x.split()[0] for x in _ENTRY.split(", ")])
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, _ENTRY).withColumn("urlkey", url_key(F.col("uri"))).drop("uri")


class LoserTree:
    """k-way merge of sorted sequences: inner nodes keep the losers, the root's winner is next."""

    def __init__(self, runs: Sequence[Sequence]):
        self.runs, self.k = runs, len(runs)
        self.at = [0] * self.k
        self.loser = [-1] * max(1, self.k)
        for i in range(self.k):
            self._play(i)

    def _less(self, a: int, b: int) -> bool:
        if self.at[a] >= len(self.runs[a]):
            return False
        if self.at[b] >= len(self.runs[b]):
            return True
        x, y = self.runs[a][self.at[a]], self.runs[b][self.at[b]]
        return (x, a) < (y, b)

    def _play(self, i: int) -> None:
        node = (i + self.k) >> 1
        while node > 0:
            if self.loser[node] < 0:
                self.loser[node] = i
                return
            if self._less(self.loser[node], i):
                self.loser[node], i = i, self.loser[node]
            node >>= 1
        self.loser[0] = i

    def __iter__(self):
        while self.k:
            i = self.loser[0]
            if self.at[i] >= len(self.runs[i]):
                return
            yield i, self.at[i]
            self.at[i] += 1
            self._play(i)


def merge_runs(index: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Globally ordered capture histories: adds ``seq`` (0-based, by URL key, time, id, run)."""
    n = index.count()
    parts = max(1, n // rows_per_range)
    key = [F.col("urlkey"), F.col("time"), F.col("page_id").asc_nulls_first()]
    dealt = (index.repartitionByRange(parts, *key, "run", "nth").sortWithinPartitions("run", "nth"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in index.schema.fields)

    def run(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).combine_chunks()
        names = t.column("run").to_pylist()
        ids = t.column("page_id").to_pylist()
        keys = list(zip(t.column("urlkey").to_pylist(), t.column("time").to_pylist(),
                        [(x is not None, x or 0) for x in ids], strict=True))
        edges = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
        tree = LoserTree([keys[a:b] for a, b in zip(edges, edges[1:], strict=False)])
        order = pa.array([edges[r] + i for r, i in tree], pa.int64())
        out = t.take(order).append_column("local", pa.array(range(len(names)), pa.int64()))
        yield from out.to_batches(max_chunksize=10_000)

    merged = pin(dealt.mapInArrow(run, f"{kinds}, local long").withColumn("part", F.spark_partition_id()), "merged")
    sizes = merged.groupBy("part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    sizes = sizes.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_b"))
    return merged.join(sizes, "part").withColumn("seq", F.col("_b") + F.col("local")).drop("part", "_b", "local")


def archive_histories(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write the pages as archives, read the archives back, merge their indexes."""
    path = scratch(pages.sparkSession, "warc")
    write_runs(pages, path, min_bytes)
    index = pin(read_runs(pages.sparkSession, path), "index")
    return merge_runs(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to",
                                    "urlkey", "time", "seq")
