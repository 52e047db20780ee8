"""WARC archives with a two-level capture index.

Pages are dealt to tasks by range of their reversed-host key (``com,example,www)/path``) and
page id, so that a host of any size is spread. Each task writes, sorted by key:

* ``<name>.warc.gz``: one gzip member per record. Of pages with equal payloads of at least
  MIN_REVISIT bytes the one with the least page_id is a response, the others are revisits
  that refer to it and hold no payload.
* ``<name>.cdx.gz``: index lines (key, page id, offset, length) in blocks of BLOCK lines, a
  gzip member each.
* ``<name>.idx``: the sparse directory, a line for each block: its first key, offset, length.

A row for each task (its files, first and last key) makes the manifest, a written table. A
task that is run again writes under a new name; the manifest has the finished ones. A look-up
finds the task by key range, the block by binary search in the directory, the line by binary
search in the block, and reads just that range of the archive. Reading everything back goes
block by block, one range read of the index and one of the archive, and looks each block's first
and last key up by the directory: an index that would not find its captures raises.

Cases: a null html is an empty payload; a null url has an empty key; a null page_id stays
null, and counts as greater than any other. Of pages with equal payloads of MIN_REVISIT bytes
or more exactly one record is the response: of rows that repeat the least page_id the one with
the least url (null first), of rows that are equal in all the first written; the others revisit
it. Record ids hold the page_id, hashes of url and payload, and a number where all these are
equal, so that no two records have one id. Empty tables give empty archives and results; other columns, whatever their names,
are not looked at.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import uuid
import zlib
from collections import OrderedDict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import open_store, shared_path, shuffle_partitions, slices, written

MIN_REVISIT, BLOCK, LEVEL = 100, 256, 3
DATE = "1970-01-01T00:00:00Z"
CRLF = b"\r\n"
URN = "urn:sparrowhawk:page:"
A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def surt(url: Column) -> Column:
    """Reversed-host key of a url: host's labels from the last, then path and query; empty for null. Control characters are ``%``."""
    rest = F.regexp_replace(url, r"^[^:/?#]*://", "")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    tail = F.regexp_extract(rest, r"^[^/?#]*([^#]*)", 1)
    labels = F.reverse(F.split(F.translate(host, A_TO_Z, A_TO_Z.lower()), r"\."))
    return F.regexp_replace(F.coalesce(F.concat(F.array_join(labels, ","), F.lit(")"), tail), F.lit("")), r"[\x00-\x1f\x7f]", "%")


def surt_key(url: str | None) -> str:
    """The same of a Python string."""
    if url is None:
        return ""
    scheme, mark, rest = url.partition("://")
    if not mark or any(c in scheme for c in ":/?#"):
        rest = url
    ends = [i for i in (rest.find(c) for c in "/?#") if i >= 0]
    host, tail = (rest[: min(ends)], rest[min(ends) :]) if ends else (rest, "")
    host = "".join(c.lower() if c in A_TO_Z else c for c in host)
    key = ",".join(reversed(host.split("."))) + ")" + tail.partition("#")[0]
    return "".join("%" if ord(c) < 32 or ord(c) == 127 else c for c in key)


def _clean(text: str) -> str:
    """A header's value: control characters are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in text)


def record_id(page_id, url: str | None, digest: str, nth: int = 0) -> str:
    """A record's name: page id, the first digits of the url's and the payload's hash, and a number if all else is equal."""
    at = "null" if url is None else hashlib.sha256(url.encode("utf-8", "replace")).hexdigest()[:12]
    return f"{URN}{'null' if page_id is None else page_id}:{at}:{digest[:16]}" + (f":{nth}" if nth else "")


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to: str | None = None, nth: int = 0) -> bytes:
    """A WARC record, not compressed; refers_to: the name of the response that a revisit refers to."""
    http = CRLF.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload)]) + CRLF * 2
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{record_id(page_id, url, digest, nth)}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_clean(url or '')}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers_to}>"]
    return "\r\n".join(head).encode("utf-8", "replace") + CRLF * 2 + block + CRLF * 2


def parse(raw: bytes) -> dict:
    """A record's headers and, of a response, its payload. Raises ValueError where lengths or digest don't hold."""
    head, _, rest = raw.partition(CRLF * 2)
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != CRLF * 2:
        raise ValueError("a record's length is wrong")
    http, _, payload = block.partition(CRLF * 2)
    size = int(http.rpartition(b"Content-Length: ")[2])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    number = lambda x: None if (v := x.strip("<>").removeprefix(URN).partition(":")[0]) == "null" else int(v)
    found = {"id": fields["WARC-Record-ID"], "page_id": number(fields["WARC-Record-ID"]), "type": fields["WARC-Type"], "digest": digest, "bytes": size, "refers_to": None, "payload": None, "url": fields["WARC-Target-URI"]}
    if fields["WARC-Type"] == "revisit":
        found["refers_to"] = number(fields["WARC-Refers-To"])
    else:
        if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError("a payload isn't what its record says")
        found["payload"] = payload
    return found


MANIFEST = "path string, first_key string, last_key string, records long, blocks long"


def _writer(folder: str, block: int):
    def run(batches):
        fs, base, archive = None, f"{folder}/{uuid.uuid4().hex}", None
        at, first, last, n = 0, None, None, 0
        before, nth = None, 0
        lines: list[str] = []
        directory: list[str] = []
        index_at = 0

        def seal():
            nonlocal index_at
            packed = gzip.compress("\n".join(lines).encode(), LEVEL, mtime=0)
            index.write(packed)
            directory.append(f"{lines[0].split('\t')[0]}\t{index_at}\t{len(packed)}\t{len(lines)}")
            index_at += len(packed)
            lines.clear()

        for batch in slices(batches):
            for page, url, html, key, digest, origin in zip(*(c.to_pylist() for c in batch.columns)):
                if fs is None:
                    fs, path = open_store(base)
                    fs.create_dir(path.rpartition("/")[0], recursive=True)
                    archive, index = fs.open_output_stream(f"{path}.warc.gz", compression=None), fs.open_output_stream(f"{path}.cdx.gz", compression=None)
                nth = nth + 1 if (page, url, digest) == before else 0  # rows that are equal in all follow one another
                before = page, url, digest
                own = origin is None or not nth and (origin["page_id"], origin["url"]) == (page, url)
                packed = gzip.compress(record(page, url, html, digest, None if own else record_id(origin["page_id"], origin["url"], digest), nth), LEVEL, mtime=0)
                archive.write(packed)
                lines.append(f"{key}\t{'' if page is None else page}\t{at}\t{len(packed)}")
                at += len(packed)
                n += 1
                first, last = key if first is None else first, key
                if len(lines) == block:
                    seal()
        if fs is None:
            return
        if lines:
            seal()
        archive.close()
        index.close()
        with fs.open_output_stream(f"{path}.idx", compression=None) as out:
            out.write("\n".join(directory).encode())
        yield pa.RecordBatch.from_pydict({"path": [base], "first_key": [first], "last_key": [last], "records": [n], "blocks": [len(directory)]})

    return run


def write_archives(pages: DataFrame, folder: str | None = None, block: int = BLOCK) -> DataFrame:
    """Writes the archives and their index below folder (else the shared one); returns the manifest."""
    spark = pages.sparkSession
    folder = folder or shared_path(spark, "warc")
    html = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.select("*", surt(F.col("url")).alias("key"), F.sha2("html", 256).alias("digest"))
    # Digests that more than one page has, as a table: Spark knows its size, and broadcasts it only if it is small.
    least = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url"))
    copies = written(
        rows.where(F.octet_length("html") >= MIN_REVISIT).groupBy(F.col("digest").alias("d")).agg(least.alias("origin"), F.count("*").alias("n")).where("n > 1").select("d", "origin"),
        "warc-copies",
    )
    records = rows.join(copies, rows["digest"] == copies["d"], "left").select("page_id", "url", "html", "key", "digest", "origin")
    dealt = records.repartitionByRange(shuffle_partitions(spark), "key", "page_id").sortWithinPartitions("key", "page_id", "url", "digest")
    return written(dealt.mapInArrow(_writer(folder, block), MANIFEST), "warc-manifest")


Line = tuple[str, str, int, int]  # key, page id, offset, length


class Archive:
    """A task's files: the directory is read at once, blocks of the index and records by range."""

    def __init__(self, path: str):
        fs, at = open_store(path)
        with fs.open_input_file(f"{at}.idx") as file:
            self.entries = [(k, int(o), int(n), int(c)) for k, o, n, c in (x.split("\t") for x in file.read().decode().split("\n") if x)]
        self.keys = [e[0] for e in self.entries]
        self.index, self.records = fs.open_input_file(f"{at}.cdx.gz"), fs.open_input_file(f"{at}.warc.gz")
        self.cache: OrderedDict[int, list[Line]] = OrderedDict()

    def __enter__(self):
        return self

    def __exit__(self, *error):
        self.index.close()
        self.records.close()

    def lines(self, block: int) -> list[Line]:
        found = self.cache.get(block)
        if found is None:
            raw = gzip.decompress(self.index.read_at(self.entries[block][2], self.entries[block][1])).decode()
            found = self.cache[block] = [(k, p, int(o), int(n)) for k, p, o, n in (x.split("\t") for x in raw.split("\n"))]
            if len(self.cache) > 4:
                self.cache.popitem(last=False)
        return found

    def find(self, key: str):
        """The lines of a key: binary search in the directory, then in the block."""
        for block in range(max(0, bisect.bisect_left(self.keys, key) - 1), len(self.entries)):
            if self.keys[block] > key:
                return
            lines = self.lines(block)
            for i in range(bisect.bisect_left(lines, key, key=lambda x: x[0]), len(lines)):
                if lines[i][0] != key:
                    return
                yield lines[i]

    def read(self, lines: list[Line]) -> list[dict]:
        """The records of lines that follow one another, by one range read."""
        start = lines[0][2]
        raw = memoryview(self.records.read_at(lines[-1][2] + lines[-1][3] - start, start))
        return [parse(zlib.decompress(raw[o - start : o - start + n], 31)) for _, _, o, n in lines]


RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _reader(batches):
    for batch in batches:
        for path in batch.column(0).to_pylist():
            with Archive(path) as archive:
                for block in range(len(archive.entries)):
                    lines = archive.lines(block)
                    if any(next(archive.find(x[0]), (None,))[0] != x[0] for x in (lines[0], lines[-1])):
                        raise ValueError(f"{path}: the directory doesn't lead to block {block}")
                    found = archive.read(lines)
                    columns = [[f[k] for f in found] for k in ("page_id", "bytes", "digest", "type", "refers_to")]
                    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def read_archives(manifest: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record of the archives."""
    dealt = manifest.select("path").repartition(shuffle_partitions(manifest.sparkSession))
    return dealt.mapInArrow(_reader, RESULT)


class CaptureIndex:
    """Look-ups of single captures. The manifest has a row for each writing task, not for each page."""

    def __init__(self, manifest: DataFrame):
        rows = sorted((r["first_key"], r["last_key"], r["path"]) for r in manifest.collect())
        self.first, self.rows = [r[0] for r in rows], rows

    def lookup(self, url: str | None) -> list[dict]:
        """All captures of a url: records as parse gives them, by range reads."""
        key, found = surt_key(url), []
        for first, last, path in reversed(self.rows[: bisect.bisect_right(self.first, key)]):
            if last < key:
                break
            with Archive(path) as archive:
                found += [r for line in archive.find(key) for r in archive.read([line])]
        return found


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages to archives and reads these back; one row per page."""
    return read_archives(write_archives(pages))
