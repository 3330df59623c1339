"""WARC archives with a two-level capture index.

Records are written one gzip member each, so a record can be read alone. Equal payloads of at least `least` bytes are stored once: the page
with the largest id is the response, the others are revisits that name it. Captures are sorted by (reversed-host URL key, page id) over the
whole corpus, and cut into compressed blocks. Each index file ends with a sparse directory, one key per block; the list of index files
with their first keys is the upper level. A lookup searches the upper level, one directory and one block by bisection, and then reads
exactly one range of one archive.

Archives and index files get fresh names and count only through the stored list of the attempt that finished, so lost tasks leave orphans
but no wrong offsets. Defined results: a null page has an empty payload; a null URL has the empty key; rows equal in id, URL and payload
give one record each; an empty table gives no archives and no rows. Only the named columns are read."""

from __future__ import annotations

import base64
import bisect
import hashlib
import io
import json
import struct
import uuid
import zlib
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import words as W
from tessera.llm.folders import filesystem, new_folder, put_bytes, stored

LEAST = 1000  # bytes from which equal payloads are revisits
ARCHIVE_BYTES = 32 << 20
BLOCK_LINES = 500
BROADCAST_ROWS = 200_000
SALTS = 16
CAPTURES = "surt string, page_id long, uri string, offset long, size long"


def surt(url: str | None) -> str:
    """The sort key of a URL: reversed host, then the rest; scheme, `www`, default port and fragment are dropped."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return url
    if not host:
        return url
    port = "" if port in (None, 80, 443) else f":{port}"
    return f"{','.join(reversed(host.split('.')))}{port}){parts.path or '/'}{'?' + parts.query if parts.query else ''}"


def classify(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, url, payload, refers_to): refers_to names the response of an equal payload, or is null."""
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload"))
    key = F.when(F.length("payload") >= least, F.unhex(F.sha1("payload")))
    groups = (base.select(key.alias("sha"), "page_id").filter("sha is not null").groupBy("sha")
              .agg(F.max("page_id").alias("newest"), F.count("*").alias("n")).filter("n > 1").select("sha", "newest"))
    groups = stored(groups, "warc-groups")
    named = base.withColumn("sha", key)
    if groups.count() <= BROADCAST_ROWS:
        joined = named.join(F.broadcast(groups), "sha", "left")
    else:  # copies of one payload may be a large part of all pages: they are spread over salts
        spread = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = named.withColumn("salt", F.expr(f"cast(pmod(xxhash64(page_id), {SALTS}) as int)")).join(spread, ["sha", "salt"], "left")
    return joined.select("page_id", "url", "payload", F.when(F.col("newest") != F.col("page_id"), F.col("newest")).alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record as a gzip member. The HTTP header of a revisit keeps the length of the payload that it leaves out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    uri = "".join(c if 32 < ord(c) else f"%{ord(c):02X}" for c in url or "")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{base64.b32encode(hashlib.sha1(payload).digest()).decode()}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if refers_to is not None:
        head[3:3] = [f"WARC-Refers-To: <urn:x-page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + press.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(fields, HTTP header, body) of one gzip member."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    http, _, body = rest[:int(fields["Content-Length"])].partition(b"\r\n\r\n")
    return fields, http, body


def write(pages: DataFrame, folder: str, least: int = LEAST, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the archives and returns their captures."""
    def save(batches):
        body, rows = io.BytesIO(), []

        def close():
            uri = f"{folder}/{uuid.uuid4().hex}.warc.gz"
            put_bytes(uri, body.getvalue())
            keys, ids, offsets, sizes = zip(*rows)
            return pa.record_batch([pa.array(keys, pa.string()), pa.array(ids, pa.int64()), pa.array([uri] * len(rows), pa.string()), pa.array(offsets, pa.int64()),
                                    pa.array(sizes, pa.int64())], ["surt", "page_id", "uri", "offset", "size"])

        for whole in batches:
            for batch in W.slices(whole, "payload"):
                for page, url, payload, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to"))):
                    member = record(page, url, payload, refers, date)
                    rows.append((surt(url), page, body.tell(), len(member)))
                    body.write(member)
                    if body.tell() >= archive_bytes:
                        yield close()
                        body, rows = io.BytesIO(), []
        if rows:
            yield close()

    return stored(classify(pages, least).mapInArrow(save, CAPTURES), "warc-captures")


def _key(line: str) -> tuple[str, int]:
    surt_key, page, _ = line.split("\t", 2)
    return surt_key, int(page)


def build_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Sorts the captures into index files; returns the upper level (surt, page_id, uri), the first key of each file."""
    parts = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = captures.withColumn("page_id", F.coalesce("page_id", F.lit(-(1 << 63)))).repartitionByRange(parts, "surt", "page_id").sortWithinPartitions("surt", "page_id", "offset")

    def save(batches):
        body, directory, lines = io.BytesIO(), [], []

        def close_block():
            data = zlib.compress("\n".join(lines).encode(), 6)
            directory.append([*_key(lines[0]), body.tell(), len(data)])
            body.write(data)
            lines.clear()

        for batch in batches:
            for key, page, uri, offset, size in zip(*(batch.column(c).to_pylist() for c in ("surt", "page_id", "uri", "offset", "size"))):
                clear = key.replace("\t", "%09").replace("\n", "%0A")
                lines.append(f"{clear}\t{page}\t{uri.rpartition('/')[2]}\t{offset}\t{size}")
                if len(lines) >= block_lines:
                    close_block()
        if lines:
            close_block()
        if directory:
            tail = zlib.compress(json.dumps(directory).encode(), 6)
            at = body.tell()
            body.write(tail + struct.pack("<qq", at, len(tail)))
            uri = f"{folder}/{uuid.uuid4().hex}.idx"
            put_bytes(uri, body.getvalue())
            yield pa.record_batch([pa.array([directory[0][0]]), pa.array([directory[0][1]], pa.int64()), pa.array([uri])], ["surt", "page_id", "uri"])

    return stored(ordered.mapInArrow(save, "surt string, page_id long, uri string"), "warc-index")


class Lookup:
    """Finds captures by bisection. It keeps one directory and one block, so ascending keys read each of them once."""

    def __init__(self, upper: list[tuple[str, int, str]], folder: str):
        self.upper, self.folder = sorted(upper), folder
        self.file = self.block = None
        self.archives: dict[str, object] = {}

    def _open(self, uri: str):
        store, path = filesystem(uri)
        return store.open_input_file(path)

    def _directory(self, uri: str):
        if self.file != uri:
            self.file, self.block = uri, None
            self.source = self._open(uri)
            size = self.source.size()
            at, n = struct.unpack("<qq", self.source.read_at(16, size - 16))
            self.directory = json.loads(zlib.decompress(self.source.read_at(n, at)))
            self.keys = [(r[0], r[1]) for r in self.directory]

    def _lines(self, k: int):
        if self.block != k:
            self.block = k
            self.lines = zlib.decompress(self.source.read_at(self.directory[k][3], self.directory[k][2])).decode().split("\n")
            self.line_keys = [_key(x) for x in self.lines]

    def captures(self, key: tuple[str, int], prefix: bool = False):
        """(archive, offset, size) of the captures of a key, or with `prefix` of all pages of that URL key."""
        key = (key[0].replace("\t", "%09").replace("\n", "%0A"), key[1])
        low = (key[0], -(1 << 63)) if prefix else key
        first = [x[:2] for x in self.upper]
        f = max(0, bisect.bisect_left(first, low) - 1)
        while f < len(self.upper) and (first[f] <= key if not prefix else first[f][0] <= key[0]):
            self._directory(self.upper[f][2])
            k = max(0, bisect.bisect_left(self.keys, low) - 1)
            while k < len(self.keys) and (self.keys[k] <= key if not prefix else self.keys[k][0] <= key[0]):
                self._lines(k)
                i = bisect.bisect_left(self.line_keys, low)
                while i < len(self.lines) and (self.line_keys[i] == key if not prefix else self.line_keys[i][0] == key[0]):
                    name, offset, size = self.lines[i].split("\t")[2:]
                    yield name, int(offset), int(size)
                    i += 1
                if i < len(self.lines):
                    return
                k += 1
            f += 1

    def read(self, name: str, offset: int, size: int) -> bytes:
        """One range read."""
        if name not in self.archives:
            if len(self.archives) > 32:
                self.archives.clear()
            self.archives[name] = self._open(f"{self.folder}/{name}")
        return self.archives[name].read_at(size, offset)


def fetch(keys: DataFrame, index: DataFrame, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the records of (surt, page_id) keys.

    The upper level goes to every task: one short row per index file, of which there are no more than shuffle partitions."""
    spark = keys.sparkSession
    upper = spark.sparkContext.broadcast([tuple(r) for r in index.select("surt", "page_id", "uri").collect()])
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = keys.select("surt", F.coalesce("page_id", F.lit(-(1 << 63))).alias("page_id")).distinct().repartitionByRange(parts, "surt", "page_id").sortWithinPartitions("surt", "page_id")

    def scan(batches):
        look = Lookup(upper.value, folder)
        for batch in batches:
            rows = []
            for key in zip(*(c.to_pylist() for c in batch.columns)):
                for place in look.captures(key):
                    fields, http, body = parse(look.read(*place))
                    digest = base64.b32decode(fields["WARC-Payload-Digest"][5:])
                    size = int(http.rpartition(b"Content-Length: ")[2])
                    revisit = fields["WARC-Type"] == "revisit"
                    if not revisit and (len(body) != size or hashlib.sha1(body).digest() != digest):
                        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
                    page, refers = (fields.get(f, "<urn:x-page:>")[12:-1] for f in ("WARC-Record-ID", "WARC-Refers-To"))
                    rows.append((int(page) if page else None, size, digest.hex(), "revisit" if revisit else "response", int(refers) if refers else None))
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))],
                                  ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return ordered.mapInArrow(scan, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes all pages, indexes them, and reads every record back through the index."""
    folder = new_folder(pages.sparkSession, "warc")
    captures = write(pages, folder)
    return fetch(captures.select("surt", "page_id"), build_index(captures, folder), folder)


def search(spark: SparkSession, urls: list[str], index: DataFrame, folder: str) -> list[tuple[dict, bytes]]:
    """Records of a few URLs, read from the driver."""
    look = Lookup([tuple(r) for r in index.select("surt", "page_id", "uri").collect()], folder)
    return [(fields, body) for u in urls for place in look.captures((surt(u), 0), prefix=True) for fields, _, body in [parse(look.read(*place))]]
