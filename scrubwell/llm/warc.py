"""Operator 4: WARC archives with an index made by external merge.

Records with equal payloads of at least ``min_bytes`` are told apart by digest: the one with the largest
key is the response, the others revisit it; smaller payloads are all responses. Every task writes one archive
of gzip members, and its captures as runs, files sorted by URL key, timestamp and key, of at most ``RUN_ROWS`` rows. The
key space is cut into ranges of some ``RANGE_ROWS`` captures; a task opens of each run the batches that reach into its
range and merges them by a loser tree, holding one batch of each run. So the index is ordered within and across its
partitions, one URL with very many captures spreads over several, and no task holds a run or a range. More than ``FAN``
runs are merged to fewer, longer ones before. The merged order gives each capture its place in the history of its URL key.
Archives are read back by the index, file by file in ascending offsets.

Payloads are only shuffled where their digest may repeat. What reaches the driver is the first key of each range.

Files go to the shared folder under names that no other attempt of a task uses, and only names in the
index are read, so lost executors and repeated tasks leave at worst unused files.

Null payloads are empty ones. Null URLs have an empty URL key and read back as empty; line breaks in URLs are written as
``%0D`` and ``%0A``. Captures without a date are dated by their key, modulo 2**32, in seconds from 2020. Rows that repeat a
key and its payload are all responses, or all revisits, alike; null keys count as least. An empty table has no archive and gives
an empty index. Further columns aren't read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.window import Window

from scrubwell.llm.common import checkpoint_root, cut, map_rows, maybe_in, open_folder, read_table, remove

EPOCH = datetime(2020, 1, 1, tzinfo=UTC)
#: Captures of a run at most, and of a batch, which is what a merge holds of each run.
RUN_ROWS = 100_000
BATCH_ROWS = 512
#: Runs that one merge takes, and captures of a range of the last merge.
FAN = 256
RANGE_ROWS = 1_000_000
_ROW = [("urlkey", pa.string()), ("ts", pa.string()), ("key", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("size", pa.int64())]
ROW_SCHEMA = pa.schema(_ROW)
#: A row per batch of a run: its first and last key.
SPARSE_SCHEMA = pa.schema(
    [("run", pa.string()), ("batch", pa.int32()), ("n", pa.int64())]
    + [(f"{x}_{n}", t) for x in ("first", "last") for n, t in _ROW[:3]]
)
SPARSE_NAMES = "run string, batch int, n long, " + ", ".join(f"{x}_urlkey string, {x}_ts string, {x}_key long" for x in ("first", "last"))
INDEX_SCHEMA = pa.schema([*_ROW, ("range", pa.int32()), ("place", pa.int64())])
INDEX_NAMES = "urlkey string, ts string, key long, file string, offset long, size long, range int, place long"
_NO_KEY = 0xFFFF_FFFF
_MARK = 0x5743


_URL = r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?(?:www[0-9]*\.)?([^/?#:]*)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?"
_MATCH = re.compile(_URL).match


def urlkey(url: str | None) -> str:
    """Sort-friendly form of a URL: reversed host, then path and query, all in small letters; what is no URL stays whole."""
    url = (url or "").strip(" \t\r\n").lower()
    if not (m := _MATCH(url)):
        return url
    host, port, path, query = m.groups()
    shown = "" if port in (None, "", "80", "443") else f":{port}"
    asked = "?" + "&".join(sorted(query.split("&"))) if query else ""
    return ",".join(reversed(host.split("."))) + shown + ")" + (path.rstrip("/") or "/") + asked


def record_id(key: int | None) -> str:
    high = _MARK << 48 | (_NO_KEY if key is None else 0)
    return f"<urn:uuid:{uuid.UUID(int=high << 64 | (key or 0) & ((1 << 64) - 1))}>"


def key_of(record: str) -> int | None:
    n = uuid.UUID(record.strip("<>").removeprefix("urn:uuid:")).int
    if n >> 64 & _NO_KEY:
        return None
    low = n & ((1 << 64) - 1)
    return low - (1 << 64) if low >> 63 else low


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value: str | None) -> str:
    return (value or "").replace("\r", "%0D").replace("\n", "%0A")


def record(key: int | None, url: str | None, ts: str, payload: bytes, sha: str, leader: int | None, revisit: bool) -> bytes:
    """One record; a revisit has the HTTP headers but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(key)}",
        f"WARC-Date: {ts}", f"WARC-Target-URI: {_line(url)}", f"WARC-Payload-Digest: sha1:{sha}",
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(leader)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], int, bytes]:
    """Headers, length of the full payload, and the payload as stored."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    return headers, size, payload


class LoserTree:
    """Merge of sorted iterators: inner nodes hold losers, so a step replays one path to the root."""

    def __init__(self, runs: list[Iterator], order):
        self.runs, self.order = runs, order
        self.k = len(runs)
        self.heads = [next(r, None) for r in runs]
        self.losers = [-1] * self.k
        self.winner = self._build(1) if self.k else -1

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (self.order(x), a) < (self.order(y), b)

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        if not self._beats(a, b):
            a, b = b, a
        self.losers[node] = b
        return a

    def __iter__(self) -> Iterator:
        while self.winner >= 0 and (head := self.heads[self.winner]) is not None:
            yield head
            w = self.winner
            self.heads[w] = next(self.runs[w], None)
            node = (w + self.k) // 2
            while node:
                if self._beats(self.losers[node], w):
                    self.losers[node], w = w, self.losers[node]
                node //= 2
            self.winner = w


def order(row: tuple) -> tuple:
    """URL key, timestamp, key; null keys first."""
    return row[0], row[1], row[2] is not None, row[2] or 0


def roles(pages: DataFrame, *, key: str, url: str, payload: str, min_bytes: int, date: Column | None) -> DataFrame:
    """``key``, ``url``, ``payload``, ``date`` and the group's ``leader``, null where no other row has the payload or it is too small."""
    body = F.encode(F.coalesce(pages[payload].cast("string"), F.lit("")), "UTF-8")
    when = date.cast("timestamp_ntz") if date is not None else F.lit(None).cast("timestamp_ntz")
    rows = pages.select(pages[key].cast("long").alias("key"), pages[url].cast("string").alias("url"), body.alias("payload"), when.alias("date"))
    rows = rows.withColumn("sha", F.sha1("payload")).withColumn("hash", F.xxhash64("sha"))
    groups = rows.filter(F.octet_length("payload") >= min_bytes).groupBy("sha").agg(F.max("key").alias("leader"), F.count("*").alias("n"))
    leaders = cut(groups.filter("n > 1").select("sha", "leader"))
    maybe, rest = maybe_in(rows, "hash", leaders.select(F.xxhash64("sha")))
    names = ["key", "url", "payload", "date", "leader"]
    return maybe.join(leaders, "sha", "left").select(*names).unionAll(rest.withColumn("leader", F.lit(None).cast("long")).select(*names))


def _write_run(folder: str, rows: Iterator[tuple]) -> Iterator[tuple]:
    """Write sorted captures as a run, batch by batch; a row of the sparse index for each batch."""
    system, base = open_folder(folder)
    name = f"{uuid.uuid4().hex}.run"
    with system.open_output_stream(f"{base}/{name}", compression=None) as out, pa.ipc.new_file(out, ROW_SCHEMA) as writer:
        for number, batch in enumerate(_chunks(rows, BATCH_ROWS)):
            writer.write_batch(pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*batch), _ROW)], schema=ROW_SCHEMA))
            yield name, number, len(batch), *batch[0][:3], *batch[-1][:3]


def _chunks(rows: Iterator[tuple], size: int) -> Iterator[list[tuple]]:
    rows = iter(rows)
    while batch := list(islice(rows, size)):
        yield batch


def _read_run(folder: str, name: str, batches: list[int] | None = None) -> Iterator[tuple]:
    """The captures of a run, or of some of its batches, one batch at a time."""
    system, base = open_folder(folder)
    with system.open_input_file(f"{base}/{name}") as source:
        run = pa.ipc.open_file(source)
        for i in range(run.num_record_batches) if batches is None else batches:
            yield from zip(*[c.to_pylist() for c in run.get_batch(i).columns])


def write(
    pages: DataFrame, folder: str, *, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0,
    date: Column | None = None, level: int = 4, run_rows: int = RUN_ROWS,
) -> DataFrame:
    """Write archives and runs to ``folder``; the sparse index of the runs."""

    def run(it: Iterator[tuple]) -> Iterator[tuple]:
        name, out, at, captures = "", None, 0, []
        try:
            for key, url, body, when, leader in it:
                if out is None:
                    system, base = open_folder(folder)
                    system.create_dir(base, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out = system.open_output_stream(f"{base}/{name}", compression=None)
                when = when or EPOCH.replace(tzinfo=None) + timedelta(seconds=(key or 0) % (1 << 32))
                ts = when.strftime("%Y-%m-%dT%H:%M:%SZ")
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                revisit = leader is not None and leader != key
                member = packer.compress(record(key, url, ts, body, digest(body), leader, revisit)) + packer.flush()
                out.write(member)
                captures.append((urlkey(url), ts, key, name, at, len(member)))
                at += len(member)
                if len(captures) >= run_rows:
                    yield from _write_run(folder, sorted(captures, key=order))
                    captures = []
        finally:
            if out is not None:
                out.close()
        if captures:
            yield from _write_run(folder, sorted(captures, key=order))

    rows = roles(pages, key=key, url=url, payload=payload, min_bytes=min_bytes, date=date)
    return cut(map_rows(rows, run, SPARSE_NAMES, SPARSE_SCHEMA))


def _fewer(runs: DataFrame, folder: str, groups: int) -> DataFrame:
    """One pass of the merge: each group of runs becomes one."""

    def run(it: Iterator[tuple]) -> Iterator[tuple]:
        for _, members in groupby(it, lambda r: r[0]):
            yield from _write_run(folder, iter(LoserTree([_read_run(folder, name) for _, name in members], order)))

    names = runs.select(F.pmod(F.xxhash64("run"), F.lit(groups)).alias("group"), "run").distinct()
    placed = names.repartition(groups, "group").sortWithinPartitions("group", "run")
    return cut(map_rows(placed, run, SPARSE_NAMES, SPARSE_SCHEMA))


def merge(runs: DataFrame, folder: str, *, fan: int = FAN, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The index: all captures by URL key, timestamp and key, over the partitions in their order too.

    ``place`` counts the captures of a URL key from 1. Groups of runs are by hash and half of ``fan`` on average.
    """
    while (n := runs.select("run").distinct().count()) > fan:
        runs = _fewer(runs, folder, max(1, -(-2 * n // fan)))
    total = runs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    ranges = max(1, -(-total // range_rows))
    first = [F.col(f"first_{x}").alias(x) for x in ("urlkey", "ts", "key")]
    spread = runs.select(*first).repartitionByRange(ranges, "urlkey", "ts", "key")
    # one key a range: a few MB where the index has billions of rows
    starts = [r.first for r in spread.groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("urlkey", "ts", "key")).alias("first")).collect()]
    bounds = sorted(order(tuple(r)) for r in starts)[1:]

    def place(it: Iterator[tuple]) -> Iterator[tuple]:
        for name, number, _, *keys in it:
            for r in range(bisect_right(bounds, order(tuple(keys[:3]))), bisect_right(bounds, order(tuple(keys[3:]))) + 1):
                yield r, name, number

    def run(it: Iterator[tuple]) -> Iterator[tuple]:
        for r, slices in groupby(it, lambda x: x[0]):
            low, high = bounds[r - 1] if r else None, bounds[r] if r < len(bounds) else None
            inside = lambda x: (low is None or order(x) >= low) and (high is None or order(x) < high)
            parts = [
                filter(inside, _read_run(folder, name, [x[2] for x in members])) for name, members in groupby(slices, lambda x: x[1])
            ]
            last, k = None, 0
            for row in LoserTree(parts, order):
                k = k + 1 if row[0] == last else 1
                last = row[0]
                yield *row, r, k

    schema = pa.schema([("range", pa.int32()), ("run", pa.string()), ("batch", pa.int32())])
    slices = map_rows(runs, place, "range int, run string, batch int", schema)
    placed = slices.repartitionByRange(ranges, "range").sortWithinPartitions("range", "run", "batch")
    index = map_rows(placed, run, INDEX_NAMES, INDEX_SCHEMA)
    if not bounds:
        return index
    index = cut(index)
    edges = runs.sparkSession.createDataFrame([(u,) for u in {b[0] for b in bounds}], "urlkey string")
    counts = index.join(F.broadcast(edges), "urlkey", "left_semi").groupBy("urlkey", "range").agg(F.count("*").alias("n"))
    so_far = F.sum("n").over(Window.partitionBy("urlkey").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    carried = counts.select("urlkey", "range", so_far.alias("before")).filter("before > 0")  # two rows a range at most
    whole = index.join(F.broadcast(carried), ["urlkey", "range"], "left")
    return whole.select(*INDEX_SCHEMA.names[:-1], (F.col("place") + F.coalesce("before", F.lit(0))).alias("place"))


def read(index: DataFrame, folder: str, *, key: str = "page_id") -> DataFrame:
    """The records that an index names; the digest of each stored payload is checked."""

    def run(it: Iterator[tuple]) -> Iterator[tuple]:
        system, base = open_folder(folder)
        name, source = None, None
        for file, offset, size, surt, place in it:
            if file != name:
                if source is not None:
                    source.close()
                name, source = file, system.open_input_file(f"{base}/{file}")
            source.seek(offset)
            headers, length, payload = parse(zlib.decompress(source.read(size), 31))
            sha = headers["WARC-Payload-Digest"].removeprefix("sha1:")
            if headers["WARC-Type"] == "response" and digest(payload) != sha:
                raise ValueError(f"{file} at {offset}: payload doesn't match its digest")
            of = headers.get("WARC-Refers-To")
            yield (
                key_of(headers["WARC-Record-ID"]), length, sha, headers["WARC-Type"], key_of(of) if of else None,
                headers["WARC-Target-URI"], headers["WARC-Date"], payload if headers["WARC-Type"] == "response" else None,
                surt, place,
            )
        if source is not None:
            source.close()

    # A number of its own, as index rows are small beside what is read for them: sized by bytes, one task would read it all.
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = index.select("file", "offset", "size", "urlkey", "place").repartition(parts, "file").sortWithinPartitions("file", "offset")
    schema = pa.schema(
        [("key", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
         ("refers_to", pa.int64()), ("url", pa.string()), ("date", pa.string()), ("payload", pa.binary()), ("urlkey", pa.string()), ("place", pa.int64())]
    )
    names = "key long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, date string, payload binary, urlkey string, place long"
    return map_rows(placed, run, names, schema).withColumnRenamed("key", key)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{checkpoint_root(spark)}/warc-{uuid.uuid4().hex}"
    try:
        index = merge(write(read_table(spark, sf_dir, "pages"), folder), folder)
        return cut(read(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "place"))
    finally:
        remove(folder)


QUERIES = {"op4_warc": op4_warc}
_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, lower(trim(coalesce(url, ''), ' ' || chr(9) || chr(10) || chr(13))) AS u FROM pages),
x AS (SELECT page_id, u, regexp_extract(u, '{_URL}', ['host', 'port', 'path', 'query']) AS m, regexp_matches(u, '{_URL}') AS known FROM p),
k AS (
  SELECT page_id, CASE WHEN NOT known THEN u ELSE array_to_string(list_reverse(string_split(m.host, '.')), ',')
    || CASE WHEN m.port IN ('', '80', '443') THEN '' ELSE ':' || m.port END || ')'
    || CASE WHEN rtrim(m.path, '/') = '' THEN '/' ELSE rtrim(m.path, '/') END
    || CASE WHEN m.query = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(m.query, '&')), '&') END END AS urlkey FROM x),
h AS (SELECT page_id, urlkey, row_number() OVER (PARTITION BY urlkey ORDER BY (page_id % 4294967296 + 4294967296) % 4294967296, page_id) AS place FROM k),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS h,
             max(page_id) OVER (PARTITION BY sha1(b)) AS top FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(8), lambda g:
         array_to_string(list_transform(range(4), lambda i:
           substr('{_B32}', 1 + ((('0x' || substr(h, 1 + 5 * g, 5))::BIGINT >> (15 - 5 * i)) & 31)::INT, 1)), '')), '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to, urlkey, place
FROM d JOIN h USING (page_id)"""
ORACLE_SQL = {"op4_warc": _SQL}
