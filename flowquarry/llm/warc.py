"""WARC archives and their merged capture index.

Writing. Every page is a WARC/1.1 record whose block is an HTTP response with the page as payload. Of
records with equal payloads the one with the largest page id is the response; the others are revisit
records that refer to it and carry no payload. Payloads smaller than `least` bytes are always responses.
Archives are written by Spark as gzip files (a record ends with the two line ends that separate them), so
a lost executor's files are written again. The records of an archive are sorted by URL key and timestamp.
Archives are rolled by bytes: one holds at most `CHUNKS` chunks, and a chunk about `CHUNK_BYTES` or a single longer
record. A page is held in memory once in a task, however long.

Reading. Each archive gives its index lines in file order, a locally sorted run. The runs are dealt out by
ranges of (URL key, timestamp, page id, archive, place), so that one URL with many captures and even equal lines are
spread over tasks; the number of ranges follows the number of lines, so that a task holds about `RANGE_ROWS` of them.
It merges its parts of all runs with a loser tree. The tasks' outputs follow each other in the global order, which
makes every URL's captures one history.

Nulls: a null page is an empty payload, a null URL the empty one. Records without a page id are always
responses, and nothing refers to them. Rows with equal ids and payloads are all responses. An empty table
gives no archive and an empty index.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowquarry.llm.stage import settled

EOL = "\r\n"
EPOCH = datetime.datetime(2024, 1, 1)
CHUNK_BYTES, CHUNKS = 4 << 20, 64
RANGE_ROWS = 200_000
INDEX = "url_key string, captured string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, place long"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str) -> str:
    """Host labels reversed, then the path and query, lower-case: captures of a site sort together."""
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").split(".")
    except ValueError:
        return url.lower()
    if host[:1] == ["www"]:
        host = host[1:]
    port = f":{parts.netloc.rsplit(':', 1)[1]}" if ":" in parts.netloc.rsplit("@", 1)[-1] else ""
    return f"{','.join(reversed(host))}{port}){parts.path or '/'}{'?' + parts.query if parts.query else ''}".lower()


def capture_time(page_id: int | None) -> str:
    """Pages carry no time of capture, so theirs is counted from their id, in seconds after a fixed day."""
    at = EPOCH + datetime.timedelta(seconds=(page_id or 0) % (10 * 365 * 86400))
    return at.strftime("%Y-%m-%dT%H:%M:%SZ")


def target_uri(url: str | None) -> str:
    """The URL as a record's header holds it: one line of ASCII."""
    return quote(url or "", safe="%:/?#[]@!$&'()*+,;=~")


def _urn(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.UUID(int=(page_id % (1 << 64)) if page_id is not None else 1 << 64)}>"


def _page_of(urn: str) -> int | None:
    n = uuid.UUID(urn[len("<urn:uuid:") : -1]).int
    return None if n >> 64 else n - (1 << 64) if n >> 63 else n


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A WARC record without the two line ends after it."""
    http = f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: {len(payload)}{EOL}{EOL}".encode()
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {capture_time(page_id)}"]
    head += [f"WARC-Target-URI: {target_uri(url)}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
        payload = b""
    head.append(f"Content-Length: {len(http) + len(payload)}")
    return EOL.join(head).encode() + b"\r\n\r\n" + http + payload


def write(pages: DataFrame, path: str, least: int = 0) -> None:
    """Write archives of pages (page_id, url, html) into the folder `path`."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [(x or "").encode() for x in batch.column(2).to_pylist()]
            keys, times = [url_key(target_uri(u)) for u in batch.column(1).to_pylist()], [capture_time(p) for p in batch.column(0).to_pylist()]
            out = [pa.array([len(x) for x in raw], pa.int64()), *(pa.array(x, pa.string()) for x in ([payload_digest(x) for x in raw], keys, times))]
            yield pa.record_batch([*batch.columns, *out], names=["page_id", "url", "html", "size", "digest", "key", "captured"])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        chunk = lambda: pa.record_batch([pa.array([b"\r\n\r\n".join(held)], pa.binary())], names=["value"])
        for batch in batches:
            for p, u, x, d, r in zip(*(batch.column(c) for c in ("page_id", "url", "html", "digest", "refers_to"))):
                made = record(p.as_py(), u.as_py() or "", (x.as_py() or "").encode(), d.as_py(), r.as_py())
                if held and size + len(made) > CHUNK_BYTES:
                    yield chunk()
                    held, size = [], 0
                held.append(made)
                size += len(made)
        if held:
            yield chunk()

    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html"))
    rows = rows.mapInArrow(digests, "page_id long, url string, html string, size long, digest string, key string, captured string")
    # sums of digests only: a payload that most pages share is one row of each task
    best = rows.where("page_id is not null").groupBy("digest", "size").agg(F.max("page_id").alias("response")).toDF("_digest", "_size", "response")
    same = (F.col("digest") == F.col("_digest")) & (F.col("size") == F.col("_size"))
    again = (F.col("size") >= least) & (F.col("response") != F.col("page_id"))
    joined = rows.join(best, same, "left").withColumn("refers_to", F.when(again, F.col("response")))
    runs = joined.sortWithinPartitions("key", "captured", "page_id").select("page_id", "url", "html", "digest", "refers_to")
    out = runs.mapInArrow(records, "value binary").select(F.col("value").cast("string").alias("value"))
    out.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", CHUNKS).text(path)


def parse(chunks: Iterator[bytes]) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(place, headers, block) of each record of an uncompressed archive, by the lengths its headers give."""
    held, place = bytearray(), 0
    chunks = iter(chunks)

    def need(n: int) -> bool:
        while len(held) < n:
            more = next(chunks, None)
            if more is None:
                return False
            held.extend(more)
        return True

    while True:
        end = -1
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not need(len(held) + 1):
                if held.strip():
                    raise ValueError(f"archive ends within a record's headers at {place}")
                return
        first, *rest = held[:end].decode().split(EOL)
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at {place}")
        headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in rest)
        total = end + 4 + int(headers["Content-Length"]) + 4
        if not need(total) or held[total - 4 : total] != b"\r\n\r\n":
            raise ValueError(f"record at {place} is cut short")
        yield place, headers, bytes(held[end + 4 : total - 4])
        del held[:total]
        place += total


def index_line(headers: dict[str, str], block: bytes) -> dict:
    """The index line of a record; a response's digest is computed anew and compared."""
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(dict(x.split(": ", 1) for x in http.decode().split(EOL)[1:])["Content-Length"])
    if headers["WARC-Type"] == "response" and (payload_digest(payload) != digest or len(payload) != size):
        raise ValueError(f"payload of {headers['WARC-Record-ID']} does not match its digest")
    url = headers["WARC-Target-URI"]
    refers = headers.get("WARC-Refers-To")
    return {
        "url_key": url_key(url), "captured": headers["WARC-Date"], "page_id": _page_of(headers["WARC-Record-ID"]), "url": url, "payload_bytes": size,
        "payload_digest": digest, "record_type": headers["WARC-Type"], "refers_to": _page_of(refers) if refers else None,
    }


def _inflate(data: bytes) -> Iterator[bytes]:
    while data:
        member = zlib.decompressobj(31)
        for i in range(0, len(data), 1 << 18):
            yield member.decompress(data[i : i + (1 << 18)])
            if member.eof:
                data = member.unused_data + data[i + (1 << 18) :]
                break
        else:
            return


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Index lines of all archives in `path`; those of one archive are a run in its own order."""
    names = [x.split()[0] for x in INDEX.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(*(batch.column(i) for i in (0, 1))):
                rows = [index_line(h, block) | {"archive": name.as_py(), "place": place} for place, h, block in parse(_inflate(content.as_py()))]
                yield pa.RecordBatch.from_pylist(rows, pa.schema([(n, pa.int64() if n in ("page_id", "payload_bytes", "refers_to", "place") else pa.string()) for n in names]))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt.gz").load(path).select("path", "content")
    return files.mapInArrow(run, INDEX)


class LoserTree:
    """K-way merging of sorted runs: inner nodes hold the losers of their matches, so each step replays one path."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs, self.k = runs, len(runs)
        self.heads = [next(r, None) for r in runs]
        self.losers = [-1] * self.k
        self.winner = -1
        for i in range(self.k):
            self._enter(i)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x[0], a) < (y[0], b)

    def _enter(self, i: int) -> None:
        node = (i + self.k) // 2
        while node:
            if self.losers[node] < 0:
                self.losers[node] = i
                return
            if self._before(self.losers[node], i):
                self.losers[node], i = i, self.losers[node]
            node //= 2
        self.winner = i

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.heads[self.winner] is not None:
            i = self.winner
            yield self.heads[i]
            self.heads[i] = next(self.runs[i], None)
            node = (i + self.k) // 2
            while node:
                if self._before(self.losers[node], i):
                    self.losers[node], i = i, self.losers[node]
                node //= 2
            self.winner = i


def merge(runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The globally ordered capture index: partitions follow each other, each merged from its parts of the runs."""
    names = runs.columns
    runs = settled(runs)  # index lines alone: ranges are drawn from them and then filled
    ranges = max(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // range_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)  # a range of index lines
        keys = list(zip(*(table.column(c).to_pylist() for c in ("url_key", "captured", "page_id"))))
        keys = [(k, t, p is not None, p or 0) for k, t, p in keys]
        parts: dict[str, list[int]] = {}
        order = list(zip(table.column("archive").to_pylist(), table.column("place").to_pylist()))
        for i, (archive, _) in enumerate(order):
            parts.setdefault(archive, []).append(i)
        for own in parts.values():  # what a shuffle delivers of a run comes back into the run's own order
            own.sort(key=lambda i: order[i][1])
        found = LoserTree([((keys[i], i) for i in own) for _, own in sorted(parts.items())])
        taken = pa.array([i for _, i in found], pa.int64())
        yield from table.take(taken).select(names).to_batches(max_chunksize=10_000)

    return runs.repartitionByRange(ranges, "url_key", "captured", "page_id", "archive", "place").mapInArrow(run, runs.schema)
