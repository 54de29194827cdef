"""WARC archives of pages, and the merged index of their captures.

A record is a gzip member of its own, so it can be read by the place and length in the
index alone.  Archives are written by Spark's text writer: a member ends with a zero byte
(the high byte of its size), and that byte is the line separator.  Each archive read back
is a run of captures, sorted where it is read.  The runs are cut into blocks at the bounds
of key ranges; Spark brings a range's blocks in the order of their first captures, and a
loser tree merges the runs, opening a block when its first capture is due.  What is held
is the blocks that overlap the place reached, as bytes, and one capture of each run.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import pickle
import re
import zlib
from bisect import bisect_right
from collections import deque
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotwise.llm import packed
from lotwise.llm.columns import lean_batches
from lotwise.operators.durable import store

#: Bytes of an archive, but for a longer record; one is read by one task.
ARCHIVE_BYTES = 64 << 20
#: Bytes of a record that one gzip member holds; below 16 MB, so that a member's last byte is zero.
MEMBER_BYTES = 8 << 20
#: Captures of a range that are merged by one task, about, and of a block; keys sampled for a range's bounds.
RANGE_ROWS, BLOCK_ROWS, SAMPLED = 200_000, 2_000, 30
END = "\r\n\r\n"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

CAPTURE = "url_key string, stamp string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, place long, length long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str | None) -> str:
    """Host names turned round, lower case, without a leading www; then path and query."""
    if not url:
        return ")"
    try:
        parts = urlsplit(url if "://" in url else f"//{url}")
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return f"){url.lower()}"
    query = "&".join(sorted(parts.query.split("&"))) if parts.query else ""
    return ",".join(reversed(host.split("."))) + ")" + (parts.path or "/").lower() + (f"?{query.lower()}" if query else "")


class LoserTree:
    """Merges sorted runs: each inner node keeps the loser of its match, the winner is at the top.

    A run is an iterator of captures with their keys, and may get more later: :meth:`restart` plays
    all matches again.
    """

    def __init__(self, runs: list[Iterator]):
        self.runs = list(runs)
        self.heads: list = [next(r, None) for r in self.runs]
        self.restart()

    def restart(self) -> None:
        self.k = max(1, len(self.runs))
        self.losers = [-1] * self.k
        for i in range(len(self.runs)):
            self._play(i)

    def _before(self, a: int, b: int) -> bool:
        """Whether run a's head comes first; an ended run comes last, and equal heads keep the runs' order."""
        if a == -1 or b == -1:
            return a == -1
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return x[0] < y[0] or (x[0] == y[0] and a < b)

    def _play(self, winner: int) -> None:
        at = (winner + self.k) // 2
        while at > 0:
            if self._before(self.losers[at], winner):
                self.losers[at], winner = winner, self.losers[at]
            at //= 2
        self.losers[0] = winner

    def first(self):
        """The least head of all runs, or None."""
        return self.heads[self.losers[0]] if self.losers[0] >= 0 else None

    def advance(self) -> None:
        winner = self.losers[0]
        self.heads[winner] = next(self.runs[winner], None)
        self._play(winner)

    def __iter__(self) -> Iterator:
        while (head := self.first()) is not None:
            yield head
            self.advance()


def merge_blocks(blocks: Iterable[tuple[str, tuple, bytes]]) -> Iterator[tuple]:
    """Captures of (run, first key, pickled captures) blocks in order; blocks come by their first key.

    A run's blocks follow one another.  A block is opened when no open capture is before its first.
    """
    waiting: dict[str, deque] = {}
    place: dict[str, int] = {}
    tree = LoserTree([])

    def run(name: str) -> Iterator:
        while waiting[name]:
            for row in pickle.loads(waiting[name].popleft()):
                yield order(row), row

    for name, first, data in blocks:
        while (head := tree.first()) is not None and head[0] < first:
            yield head[1]
            tree.advance()
        if name not in waiting:
            waiting[name], place[name] = deque(), len(place)
            tree.runs.append(iter(()))
            tree.heads.append(None)
        waiting[name].append(data)
        at = place[name]
        if tree.heads[at] is None:  # the run has nothing open
            tree.runs[at] = run(name)
            tree.heads[at] = next(tree.runs[at])
            tree.restart()
    for _, row in tree:
        yield row


def records(pages: DataFrame, smallest: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id`` and the text of its WARC ``record``.

    Of equal payloads of at least ``smallest`` bytes the page with the smallest id is the
    response, the others revisit it.  Who that is is found by a minimum per digest, which combines
    on the map side, so a payload of a third of all pages is one row per task.  A null html is an
    empty payload.  Rows that repeat the smallest id all are responses.  The capture's time
    follows from the page's id.
    """
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    page = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    page = page.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("sha", F.sha1(F.col("html").cast("binary")))
    first = page.select("sha", "payload_bytes", "page_id").filter(F.col("payload_bytes") >= smallest).groupBy("sha").agg(F.min("page_id").alias("first_id"))
    known = page.join(first.withColumnRenamed("sha", "s"), (F.col("sha") == F.col("s")) & (F.col("payload_bytes") >= smallest), "left").drop("s")
    revisit = F.col("first_id").isNotNull() & ~F.col("first_id").eqNullSafe(F.col("page_id"))

    def work(batches):
        for batch in batches:
            out = []
            for page_id, url, text, size, sha, first_id, again in zip(*(c.to_pylist() for c in batch.columns)):
                name = base64.b32encode(bytes.fromhex(sha)).decode()
                block = "" if again else _HTTP + text
                lines = ["WARC/1.0", f"WARC-Type: {'revisit' if again else 'response'}", f"WARC-Date: {stamp(page_id)}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>"]
                if url:
                    lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
                lines += [f"WARC-Payload-Digest: sha1:{name}", f"X-Payload-Length: {size}"]
                if again:
                    lines += [f"WARC-Refers-To: <urn:page:{first_id}>", "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"]
                else:
                    lines.append("Content-Type: application/http; msgtype=response")
                lines.append(f"Content-Length: {len(block.encode())}")
                out.append("\r\n".join(lines) + END + block)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["page_id", "record"])

    return known.select("page_id", "url", "html", "payload_bytes", "sha", "first_id", revisit.alias("again")).mapInArrow(work, "page_id long, record string")


def stamp(page_id: int | None) -> str:
    """A second for each page id, from 2020 on; it starts again after about 30 years."""
    second = (page_id or 0) % 1_000_000_000
    return (datetime.datetime(2020, 1, 1) + datetime.timedelta(seconds=second)).strftime("%Y-%m-%dT%H:%M:%SZ")


def members(record: bytes) -> bytes:
    """The record as gzip; a member for each ``MEMBER_BYTES``, one for nearly all records."""
    parts = []
    for a in range(0, max(1, len(record)), MEMBER_BYTES):
        zipper = zlib.compressobj(6, zlib.DEFLATED, 31)
        parts.append(zipper.compress(record[a : a + MEMBER_BYTES]) + zipper.flush())
    return b"".join(parts)


def write_archives(rows: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """The records as WARC files under ``path``, each of about ``archive_bytes`` zipped bytes at most."""

    def work(batches):
        part, number, size = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            for record in batch.column("record"):
                data = members((record.as_py() + END).encode())
                if size and size + len(data) > archive_bytes:
                    number, size = number + 1, 0
                size += len(data)
                # The writer puts the last byte, which is zero, behind every line.
                yield pa.RecordBatch.from_arrays([pa.array([f"{part:07d}-{number:07d}"]), pa.array([data[:-1]], pa.binary())], ["archive", "member"])

    zipped = rows.select("record").mapInArrow(lean_batches(work), "archive string, member binary")
    zipped.select("archive", F.col("member").cast("string").alias("member")).write.option("lineSep", "\0").partitionBy("archive").text(path)


def unzipped(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """Place, length and content of every gzip member."""
    view, at = memoryview(data), 0
    while at < len(data):
        unzip, parts, upto = zlib.decompressobj(31), [], at
        while not unzip.eof:
            if upto >= len(data):
                raise ValueError(f"the member at byte {at} is broken off")
            some = view[upto : upto + (1 << 16)]
            parts.append(unzip.decompress(some))
            upto += len(some)
        upto -= len(unzip.unused_data)
        yield at, upto - at, b"".join(parts)
        at = upto


def parse(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Place and length in the archive, headers and block of every record."""
    place = length = 0
    kept = b""
    for at, size, content in unzipped(data):
        place, length, kept = (place, length + size, kept + content) if kept else (at, size, content)
        if not kept.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {place}")
        end = kept.find(b"\r\n\r\n")
        if end < 0:
            continue  # its headers go on in the next member
        fields = dict(line.split(": ", 1) for line in kept[:end].decode().split("\r\n")[1:])
        body, n = end + 4, int(fields["Content-Length"])
        if len(kept) < body + n + 4:
            continue  # the record goes on in the next member
        if len(kept) > body + n + 4 or kept[-4:] != b"\r\n\r\n":
            raise ValueError(f"record at byte {place} is longer or shorter than it says")
        yield place, length, fields, kept[body : body + n]
        kept = b""
    if kept:
        raise ValueError(f"record at byte {place} is broken off")


_TYPES = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[k]) for c, k in zip(zip(*rows), kinds)], list(names))


def captures(archives: DataFrame) -> DataFrame:
    """A row per record of archive files (as ``binaryFile`` reads them); each archive is a sorted run."""

    def work(batches):
        for batch in batches:
            for archive, data in zip(batch.column("archive"), batch.column("content")):
                rows, archive = [], archive.as_py()
                for at, length, fields, block in parse(data.as_py()):
                    again = fields["WARC-Type"] == "revisit"
                    number = lambda f: int(v) if (v := f.removeprefix("<urn:page:").removesuffix(">")) else None
                    payload = block.partition(b"\r\n\r\n")[2]
                    size = int(fields["X-Payload-Length"]) if again else len(payload)
                    name = fields["WARC-Payload-Digest"].removeprefix("sha1:") if again else digest(payload)
                    if f"sha1:{name}" != fields["WARC-Payload-Digest"]:
                        raise ValueError(f"payload at byte {at} of {archive} is damaged")
                    url = fields.get("WARC-Target-URI")
                    refers = number(fields["WARC-Refers-To"]) if again else None
                    rows.append((url_key(url), fields["WARC-Date"], number(fields["WARC-Record-ID"]), url, size, name, fields["WARC-Type"], refers, archive, at, length))
                rows.sort(key=order)
                for a in range(0, len(rows), 5000):
                    yield _batch(rows[a : a + 5000], CAPTURE)

    return archives.select("archive", "content").mapInArrow(lean_batches(work), CAPTURE)


def order(row: tuple) -> tuple:
    """URL key, timestamp, page (null first), and where the record lies."""
    return (row[0], row[1], row[2] is not None, row[2] or 0, row[8], row[9])


_KEY = "url_key string, stamp string, page_id long, archive string, place long"
BLOCKS = f"range int, {_KEY}, data binary"


def _bounds(runs: DataFrame, n: int, total: int) -> list[tuple]:
    """Keys that part the captures into ``n`` ranges, from about ``SAMPLED`` of them a range."""
    share = min(1.0, SAMPLED * n / max(1, total))
    some = runs.filter(F.pmod(F.xxhash64("archive", "place"), F.lit(1 << 32)) < int(share * (1 << 32)))
    names = [c.split()[0] for c in _KEY.split(", ")]
    keys = sorted((r[0], r[1], r[2] is not None, r[2] or 0, r[3], r[4]) for r in some.select(*names).collect())
    return [keys[i * len(keys) // n] for i in range(1, n)] if keys else []


def _cut(bounds: list[tuple]):
    """Sorted captures, run after run, as blocks that each lie in one range."""

    def block(at: int, rows: list[tuple]) -> tuple:
        first = rows[0]
        return (at, first[0], first[1], first[2], first[8], first[9], pickle.dumps(rows, 5))

    def work(batches):
        rows, at, out = [], 0, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                here = bisect_right(bounds, order(row))
                if rows and (here != at or row[8] != rows[0][8] or len(rows) == BLOCK_ROWS):
                    out.append(block(at, rows))
                    rows = []
                    if len(out) == 64:
                        yield _batch(out, BLOCKS)
                        out = []
                at = here
                rows.append(row)
        if rows:
            out.append(block(at, rows))
        if out:
            yield _batch(out, BLOCKS)

    return work


def merged(runs: DataFrame) -> DataFrame:
    """All captures in the order of URL key, timestamp and page; ``rank`` is a capture's place in the
    index, ``nth`` that among the captures of its key (both from 0).

    ``runs`` is stored.  Ranges are of the whole order, so a URL or host with a third of all
    captures is spread by time and page; a key's count goes on from range to range.
    """
    total = runs.count()
    n = max(packed.buckets(runs), -(-total // RANGE_ROWS))
    cut = runs.mapInArrow(_cut(_bounds(runs, n, total)), BLOCKS)
    placed = cut.repartitionByRange(n, "range").sortWithinPartitions("range", "url_key", "stamp", F.col("page_id").asc_nulls_first(), "archive", "place")

    def work(batches):
        def blocks():
            for batch in batches:
                for at, key, when, page, archive, place, data in zip(*(c.to_pylist() for c in batch.columns)):
                    yield at, archive, (key, when, page is not None, page or 0, archive, place), data

        stream = blocks()
        head = next(stream, None)
        while head is not None:
            here, out, key, nth, k = head[0], [], None, 0, 0

            def own():
                nonlocal head
                while head is not None and head[0] == here:
                    yield head[1:]
                    head = next(stream, None)

            for row in merge_blocks(own()):
                nth, key = (nth + 1 if row[0] == key else 0), row[0]
                out.append((*row, here, k, nth))
                k += 1
                if len(out) == 5000:
                    yield _batch(out, f"{CAPTURE}, range int, rank long, nth long")
                    out = []
            if out:
                yield _batch(out, f"{CAPTURE}, range int, rank long, nth long")

    index = store(placed.mapInArrow(lean_batches(work), f"{CAPTURE}, range int, rank long, nth long"))
    # A key goes on in a later range only as that range's first one.
    sizes = index.groupBy("range").agg(F.count("*").alias("n"), F.min("url_key").alias("low"), F.max("url_key").alias("high"))
    edges = sizes.select("range", F.explode(F.array_distinct(F.array("low", "high"))).alias("url_key")).join(
        index.select("range", "url_key"), ["range", "url_key"]
    ).groupBy("range", "url_key").agg(F.count("*").alias("n"))
    before = lambda w: w.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.withColumn("carry", F.coalesce(F.sum("n").over(before(Window.partitionBy("url_key"))), F.lit(0)))
    starts = sizes.withColumn("start", F.coalesce(F.sum("n").over(before(Window.partitionBy(F.lit(0)))), F.lit(0)))  # a row per range
    ranges = starts.select("range", "start", F.col("low").alias("url_key")).join(carried.drop("n"), ["range", "url_key"]).select(
        "range", "start", "carry", F.col("url_key").alias("low")
    )
    found = index.join(ranges, "range").withColumn("rank", F.col("start") + F.col("rank"))
    return found.withColumn("nth", F.col("nth") + F.when(F.col("url_key") == F.col("low"), F.col("carry")).otherwise(0)).select(
        *[c.split()[0] for c in CAPTURE.split(", ")], "rank", "nth"
    )


def archived(pages: DataFrame, path: str, smallest: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes the pages' archives under ``path``, reads them back, and returns the merged index.

    An empty table gives an empty index.  Other columns are ignored.
    """
    write_archives(records(pages, smallest, id_col, url_col, html_col), path)
    spark = pages.sparkSession
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    if "archive" not in files.columns:  # no page, no archive
        files = files.withColumn("archive", F.lit(None).cast("string"))
    return merged(store(captures(files.filter(F.col("length") > 0))))
