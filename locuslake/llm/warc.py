"""WARC archives of web pages, and their capture index by an external merge.

Pages are written as WARC 1.1 records through Spark's text writer, whose line separator is the blank line that
ends a record; pages with equal payloads are stored once and revisited by the others. Reading parses each
archive file in one task into a run of captures sorted by URL key and timestamp. The runs are stored, cut at
common key ranges, and each range's pieces of runs are merged by a loser tree, which gives capture histories
in global order: a capture's position is its place in its range's merge after all captures of the ranges before.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locuslake.llm.shared import park, partitions, shared_folder

#: Bytes that an archive file aims at, about those of a record beside its payload, and captures that a merging task aims at.
FILE_BYTES = 32 << 20
HEADER_BYTES = 500
MERGE_ROWS = 50_000
#: Payloads of fewer bytes are always stored.
MIN_REVISIT_BYTES = 0
EPOCH = 1577836800
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"  # fixed values: RFC 4648
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CAPTURE = "urlkey string, timestamp string, url string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean, file string, offset long, length long"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 SHA-1 of a binary or string column; the 160 bits are taken five hex digits, four letters, at a time."""
    alphabet = F.lit(_BASE32)

    def letters(hexed: Column) -> Column:
        group = F.conv(hexed, 16, 10).cast("int")
        return F.concat(*[F.substr(alphabet, F.shiftright(group, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)])

    pieces = F.transform(F.array(F.sha1(payload)), lambda h: F.concat(*[letters(F.substr(h, F.lit(5 * k + 1), F.lit(5))) for k in range(8)]))
    return F.get(pieces, F.lit(0))


def responses(pages: DataFrame, least_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(digest, keeper) of the payloads that more than one row holds; keeper is the largest page_id. pages: page_id, html."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    own = pages.select("page_id", base32_sha1(payload).alias("digest"), F.octet_length(payload).alias("bytes")).filter(F.col("bytes") >= least_bytes)
    return own.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).filter("n > 1").drop("n")


def write(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", captured: Column | None = None, least_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Writes a record per row of pages to files under folder.

    Of rows with equal payloads (of least_bytes or more) those with the largest page_id are responses and the
    others revisit it. A null html is an empty payload, a null url 'about:blank', a null page_id is written as
    null. `captured` is the capture time; without it the id counts seconds from 2020. No rows give no records.
    """
    when = captured if captured is not None else F.timestamp_seconds(F.lit(EPOCH) + F.pmod(F.coalesce(F.col(page_id), F.lit(0)), F.lit(10**9)))
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.coalesce(F.col(url), F.lit("about:blank")).alias("url"),
        F.coalesce(F.col(html), F.lit("")).alias("html"), F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"),
    ).withColumns({"digest": base32_sha1(F.col("html")), "bytes": F.octet_length("html")})
    shared = park(responses(rows.select("page_id", "html"), least_bytes))
    size = pages.select(F.avg(F.octet_length(html))).first()[0] or 0.0
    revisit = F.col("keeper").isNotNull() & ~F.col("keeper").eqNullSafe(F.col("page_id")) & (F.col("bytes") >= least_bytes)
    address = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.format_string("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n", F.col("bytes"))
    name = lambda x: F.concat(F.lit("<urn:page:"), F.coalesce(x.cast("string"), F.lit("null")), F.lit(">"))
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Target-URI: "), address, F.lit("\r\nWARC-Date: "), F.col("date"), F.lit("\r\nWARC-Record-ID: "), name(F.col("page_id")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {_REVISIT}\r\nWARC-Refers-To: "), name(F.col("keeper")))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        (F.octet_length("http") + F.when(revisit, 0).otherwise(F.col("bytes"))).cast("string"), F.lit("\r\n\r\n"),
        F.col("http"), F.when(revisit, F.lit("")).otherwise(F.col("html")),
    )
    records = rows.join(shared, "digest", "left").withColumn("http", http).select(record.alias("value"))
    records.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", max(1, int(FILE_BYTES / (size + HEADER_BYTES)))).text(folder)


def url_key(url: str) -> str:
    """Sort-friendly URL: host labels reversed, then path and query; scheme, 'www.' and case are dropped."""
    try:
        parts = urlsplit(url.strip().lower())
    except ValueError:
        return url.lower()
    if not parts.hostname:
        return url.lower()
    host = parts.hostname.removeprefix("www.")
    port = f":{parts.netloc.rpartition(':')[2]}" if parts.netloc.rpartition(":")[2].isdigit() and ":" in parts.netloc else ""
    return f"{','.join(reversed(host.split('.')))}{port}){parts.path or '/'}{'?' + parts.query if parts.query else ''}"


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """(headers, block, offset, length) of each record of an archive."""
    at = 0
    while at < len(data):
        split = data.index(b"\r\n\r\n", at)
        lines = data[at:split].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        end = split + 4 + int(headers["content-length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} is cut short")
        yield headers, data[split + 4 : end], at, end + 4 - at
        at = end + 4


def _page(urn: str | None) -> int | None:
    name = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(name) if name not in ("", "null") else None


def captures(data: bytes, file: str) -> list[tuple]:
    """The captures of an archive as a run sorted by URL key, timestamp and page; payloads are checked against their digests."""
    out = []
    for headers, block, offset, length in records(data):
        http, _, payload = block.partition(b"\r\n\r\n")
        size = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
        kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
        intact = kind == "revisit" or (len(payload) == size and base64.b32encode(hashlib.sha1(payload).digest()).decode() == digest)
        url = headers["warc-target-uri"]
        stamp = "".join(c for c in headers["warc-date"] if c.isdigit())
        out.append((url_key(url), stamp, url, _page(headers["warc-record-id"]), size, digest, kind, _page(headers.get("warc-refers-to")), intact, file, offset, length))
    return sorted(out, key=lambda r: (r[0], r[1], r[3] is not None, r[3] or 0))


class LoserTree:
    """Merges sorted lists: a tree of matches keeps each match's loser, so that the next least costs one path."""

    def __init__(self, runs: list[list[tuple]], key):
        self.runs, self.key, self.at, self.k = runs, key, [0] * len(runs), len(runs)
        self.heads = [key(r[0]) if r else None for r in runs]
        self.losers = [-1] * max(self.k, 1)
        for run in range(self.k):
            self._play(run)

    def _beats(self, a: int, b: int) -> bool:
        if self.heads[a] is None or self.heads[b] is None:
            return self.heads[b] is None and (self.heads[a] is not None or a < b)
        return (self.heads[a], a) < (self.heads[b], b)

    def _play(self, run: int) -> None:
        node = (run + self.k) // 2
        while node > 0:
            if self.losers[node] < 0:
                self.losers[node] = run
                return
            if self._beats(self.losers[node], run):
                self.losers[node], run = run, self.losers[node]
            node //= 2
        self.losers[0] = run

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.heads[best := self.losers[0]] is not None:
            run = self.runs[best]
            yield run[self.at[best]]
            self.at[best] += 1
            self.heads[best] = self.key(run[self.at[best]]) if self.at[best] < len(run) else None
            self._play(best)


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Merges a partition's pieces of runs; page ids travel as text, since pandas has no exact numbers beside nulls."""
    runs: dict[str, list[tuple]] = {}
    columns: list[str] = []
    for batch in batches:
        columns = list(batch.columns)
        file = columns.index("file")
        for row in batch.itertuples(index=False, name=None):
            runs.setdefault(row[file], []).append(row)
    part = TaskContext.get().partitionId()
    tree = LoserTree([runs[f] for f in sorted(runs)], lambda r: (r[0], r[1], r[3] is not None, int(r[3] or 0)))
    held: list[tuple] = []
    place = 0

    def merged() -> pd.DataFrame:
        out = pd.DataFrame(held, columns=columns).drop(columns="seq")
        return out.assign(part=part, place=range(place - len(held), place))

    for row in tree:
        held.append(row)
        place += 1
        if len(held) == 10_000:
            yield merged()
            held = []
    if held:
        yield merged()


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The runs: all captures of the archives under folder, each file's in order, numbered by seq."""
    names = [x.split(" ")[0] for x in CAPTURE.split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                run = pd.DataFrame(captures(bytes(content), path.rpartition("/")[2]), columns=names)
                run = run.astype({"page_id": "Int64", "refers_to": "Int64"})
                run.insert(0, "seq", range(len(run)))
                yield run[[*names, "seq"]]

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content")
    return files.mapInPandas(parse, f"{CAPTURE}, seq long")


def merge(runs: DataFrame, rows_per_task: int = MERGE_ROWS) -> DataFrame:
    """All captures with their position, from 0, in the order of (urlkey, timestamp, page_id, null ids first), merged
    from the sorted runs. Captures equal in these stand in the order of their files and offsets."""
    runs = park(runs)
    tasks = max(partitions(runs.sparkSession), -(-runs.count() // rows_per_task))
    pieces = runs.repartitionByRange(tasks, "urlkey", "timestamp", "page_id", "file").sortWithinPartitions("file", "seq")
    ids = {c: F.col(c).cast("string") for c in ("page_id", "refers_to")}
    form = CAPTURE.replace("page_id long", "page_id string").replace("refers_to long", "refers_to string")
    merged = park(pieces.withColumns(ids).mapInPandas(_merge, f"{form}, part int, place long"))
    # a row for each range
    sizes = merged.groupBy("part").agg(F.count("*").alias("n"))
    starts = park(sizes.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start")))
    placed = merged.join(starts, "part").withColumn("position", F.col("start") + F.col("place")).drop("part", "place", "start")
    return placed.withColumns({c: F.col(c).cast("long") for c in ids})


def archive(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes pages as WARC files into a new folder of the shared one, reads them back and returns the capture index.

    A row for each row of pages; columns as in CAPTURE, and the position in the merged index. intact is false where
    a stored payload does not match its digest. Null and empty texts are empty payloads; other columns of pages are
    ignored; repeated rows are captures of their own; an empty table gives none. An archive file is read whole by
    one task: it holds FILE_BYTES on the average of all pages, and one record at least, whatever its length.
    """
    spark = pages.sparkSession
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, folder, page_id, url, html)
    return merge(read(spark, folder))
