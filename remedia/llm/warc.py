"""WARC archives with a two-level capture index.

Pages are written as records, a gzip member each, to one archive per task below the shared
folder. Of the pages with equal payloads the one with the largest id is the response, the
others are revisits that name it and repeat its headers, not its payload. The index sorts
the captures by URL key (host labels reversed, then path and query) over the cluster; each
task cuts its sorted lines into compressed blocks in a shard file and gives a directory row
per block: its first key, place and length. A look-up sorts its keys too, finds the shard
and the block by binary search in the directory, reads that block's range, finds the line
by binary search and reads the record's range.

A task names its files by chance and its rows name the files, so the rows of a task that
was lost or repeated never mix with another's; what nobody names is never read. Only the
first keys of the shards (one row per task) go to the driver; a shard's directory stands at
the end of its file and is read where it is searched.

Defined results: a NULL html is an empty payload; a NULL url is the empty key; NULL ids
rank below all others and rows that tie for the largest id of a payload are all responses;
an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remedia.llm.common import stored
from remedia.session import scratch_path

BLOCK_LINES = 1000
OPEN_FILES = 64
#: Fixed: names of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"


def url_key(url: str | None) -> str:
    """Reversed host, then port, path and query, in lower case: ``com,example,www)/path?q``."""
    rest = (url or "").strip().split("#")[0].lower()
    rest = rest.split("://", 1)[-1]
    host, slash, path = rest.partition("/")
    if "?" in host:
        host, _, query = host.partition("?")
        slash, path = "/", "?" + query
    name, _, port = host.partition(":")
    labels = [x for x in name.split(".") if x]
    return ",".join(reversed(labels)) + (f":{port}" if port and port != "80" else "") + ")/" + path if rest else ""


class Files:
    """Files of any file system that Arrow knows, by URI; a few stay open for range reads."""

    def __init__(self, root: str):
        from pyarrow import fs

        self.fs, self.base = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (
            fs.LocalFileSystem(), root)
        self.open: OrderedDict = OrderedDict()

    def create(self, name: str):
        self.fs.create_dir(self.base, recursive=True)
        return self.fs.open_output_stream(f"{self.base}/{name}", compression=None)

    def read(self, name: str, offset: int, length: int) -> bytes:
        handle = self.open.get(name)
        if handle is None:
            if len(self.open) >= OPEN_FILES:
                self.open.popitem(last=False)[1].close()
            handle = self.open[name] = self.fs.open_input_file(f"{self.base}/{name}")
        self.open.move_to_end(name)
        handle.seek(offset)
        return handle.read(length)

    def size(self, name: str) -> int:
        return self.fs.get_file_info(f"{self.base}/{name}").size


def _gz(data: bytes) -> bytes:
    coder = zlib.compressobj(4, zlib.DEFLATED, 31)
    return coder.compress(data) + coder.flush()


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A record in bytes. A revisit keeps the payload's length and digest in its headers."""
    uri = quote(url or "", safe=":/?#[]@!$&'()*+,;=%-._~")
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = http if revisit else http + payload
    lines = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Target-URI: {uri}", f"WARC-Date: {DATE}",
             f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Payload-Digest: sha1:{digest(payload)}",
             "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version.encode() != VERSION:
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines)
    block = rest[:int(headers["Content-Length"])]
    if len(block) != int(headers["Content-Length"]) or rest[len(block):] != b"\r\n\r\n":
        raise ValueError("a WARC record of another length than its header says")
    return headers, block


def _id(urn: str | None) -> int | None:
    found = urn[len("<urn:page:"):-1] if urn else "None"
    return None if found == "None" else int(found)


def facts(headers: dict[str, str], block: bytes) -> tuple:
    """payload_bytes, payload_digest, record_type, refers_to as the archive has them."""
    http, _, payload = block.partition(b"\r\n\r\n")
    if headers["WARC-Type"] == "response":
        return len(payload), digest(payload), "response", None
    length = next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))
    return (int(length.split(": ")[1]), headers["WARC-Payload-Digest"].removeprefix("sha1:"), "revisit",
            _id(headers["WARC-Refers-To"]))


def write_archives(pages: DataFrame, root: str, least: int = 0) -> DataFrame:
    """Captures: key, page_id, file, offset, length. Payloads under ``least`` bytes are all responses."""
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).withColumn(
        "same", F.sha2("html", 256))
    # Partial maxima first, so a payload that a third of all pages share is no task of its own.
    largest = rows.groupBy("same").agg(F.max("page_id").alias("first_id"))
    chosen = rows.join(largest, "same").select(  # ids as text: their digits survive pandas
        F.col("page_id").cast("string").alias("page_id"), "url", "html", F.col("first_id").cast("string").alias("first_id"))

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, name, out, at = Files(root), f"pages-{uuid.uuid4().hex}.warc.gz", None, 0
        for frame in frames:
            captures = []
            for page_id, url, html, first in zip(*(frame[c] for c in ("page_id", "url", "html", "first_id")), strict=True):
                own = None if pd.isna(page_id) else int(page_id)
                first = None if pd.isna(first) else int(first)
                payload = html.encode("utf-8")
                revisit = own != first and len(payload) >= least
                if out is None:
                    out = files.create(name)
                data = _gz(record(own, url, payload, first, revisit))
                out.write(data)
                captures.append((url_key(url), page_id, name, at, len(data)))
                at += len(data)
            yield pd.DataFrame(captures, columns=["key", "page_id", "file", "offset", "length"])
        if out is not None:
            out.close()

    return stored(chosen.mapInPandas(
        write, "key string, page_id string, file string, offset long, length long"), "captures")


def _line(key: str, page_id, file: str, offset: int, length: int) -> tuple[str, str]:
    own = -1 if pd.isna(page_id) else int(page_id)
    return _sort_key(key, None if pd.isna(page_id) else own), json.dumps([file, int(offset), int(length)])


def _sort_key(key: str, page_id: int | None) -> str:
    """Orders like (key, page_id): ids as digits of fixed width, shifted to be positive."""
    number = 0 if page_id is None else int(page_id) + 2**63 + 1
    return f"{key}\x00{number:021d}"


def build_index(captures: DataFrame, root: str, block_lines: int = BLOCK_LINES) -> list[tuple[str, str]]:
    """Shards of sorted, compressed blocks. The result is (first key, file) of each shard, in order."""

    def line(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [_line(*row) for row in zip(*(frame[c] for c in ("key", "page_id", "file", "offset", "length")), strict=True)]
            yield pd.DataFrame(made, columns=["k", "place"])

    def shard(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, name = Files(root), f"index-{uuid.uuid4().hex}.idx"
        out, at, directory, waiting = None, 0, [], []

        def flush(rows: list) -> None:
            nonlocal at
            data = zlib.compress(json.dumps(rows).encode())
            out.write(data)
            directory.append((rows[0][0], at, len(data)))
            at += len(data)

        for frame in frames:
            if len(frame) and out is None:
                out = files.create(name)
            waiting += list(zip(frame["k"], frame["place"], strict=True))
            while len(waiting) >= block_lines:
                flush(waiting[:block_lines])
                waiting = waiting[block_lines:]
        if waiting:
            flush(waiting)
        if out is not None:
            tail = zlib.compress(json.dumps(directory).encode())
            out.write(tail + len(tail).to_bytes(8, "big"))
            out.close()
            yield pd.DataFrame({"first": [directory[0][0]], "file": [name]})

    lines = captures.mapInPandas(line, "k string, place string")
    shards = stored(lines.repartitionByRange("k", "place").sortWithinPartitions("k", "place").mapInPandas(
        shard, "first string, file string"), "shards")
    # One row per task of the sort.
    return sorted((r["first"], r["file"]) for r in shards.toLocalIterator())


class Index:
    """Look-ups in the shards; the directory of a shard and the last blocks stay in memory."""

    def __init__(self, root: str, shards: list[tuple[str, str]]):
        self.files, self.shards = Files(root), shards
        self.firsts = [s[0] for s in shards]
        self.directories: OrderedDict = OrderedDict()
        self.blocks: OrderedDict = OrderedDict()

    @staticmethod
    def _kept(memory: OrderedDict, key, most: int, make):
        if key not in memory:
            if len(memory) >= most:
                memory.popitem(last=False)
            memory[key] = make()
        memory.move_to_end(key)
        return memory[key]

    def _directory(self, file: str) -> list:
        def read():
            size = self.files.size(file)
            n = int.from_bytes(self.files.read(file, size - 8, 8), "big")
            return json.loads(zlib.decompress(self.files.read(file, size - 8 - n, n)))

        return self._kept(self.directories, file, 8, read)

    def _block(self, file: str, offset: int, length: int) -> list:
        return self._kept(self.blocks, (file, offset), 8, lambda: json.loads(
            zlib.decompress(self.files.read(file, offset, length))))

    def places(self, key: str, page_id: int | None) -> list[tuple[str, int, int]]:
        """Where the captures of a key and id are: all of them, over the borders of blocks and shards."""
        wanted, found = _sort_key(key, page_id), []
        s = max(0, bisect.bisect_left(self.firsts, wanted) - 1)
        while s < len(self.shards) and self.firsts[s] <= wanted:
            file = self.shards[s][1]
            directory = self._directory(file)
            heads = [d[0] for d in directory]
            b = max(0, bisect.bisect_left(heads, wanted) - 1)
            while b < len(directory) and heads[b] <= wanted:
                rows = self._block(file, directory[b][1], directory[b][2])
                at = bisect.bisect_left(rows, [wanted, ""])
                while at < len(rows) and rows[at][0] == wanted:
                    found.append(tuple(json.loads(rows[at][1])))
                    at += 1
                b += 1
            s += 1
        return found

    def record(self, place: tuple[str, int, int]) -> tuple[dict[str, str], bytes]:
        return parse(zlib.decompress(self.files.read(*place), 31))


def look_up(wanted: DataFrame, root: str, shards: list[tuple[str, str]]) -> DataFrame:
    """page_id and what the archives say of each capture of the wanted (url, page_id), one row per capture."""
    kind = wanted.schema["page_id"].dataType.simpleString()

    def key(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"key": [url_key(None if pd.isna(u) else u) for u in frame["url"]], "page_id": frame["page_id"]})

    rows = wanted.select(F.col("url").cast("string").alias("url"), F.col("page_id").cast("string").alias("page_id")).mapInPandas(
        key, "key string, page_id string").distinct()

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Index(root, shards)
        for frame in frames:
            out = []
            for wanted_key, page_id in zip(frame["key"], frame["page_id"], strict=True):
                own = None if pd.isna(page_id) else int(page_id)
                for place in index.places(wanted_key, own):
                    *found, refers_to = facts(*index.record(place))
                    out.append((page_id, *found, None if refers_to is None else str(refers_to)))
            yield pd.DataFrame(out, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    # Sorted like the index, so the requests of a task meet the same blocks one after another.
    order = [F.col("key"), F.col("page_id").cast(kind)]
    parts = int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    found = ordered.mapInPandas(
        read, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string")
    return found.withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})


def archive(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write, index and read back every page."""
    root = scratch_path(pages.sparkSession, "warc")
    captures = write_archives(pages, root, least)
    return look_up(pages, root, build_index(captures, root))
