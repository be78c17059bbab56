"""WARC archives: an index of byte ranges is written with the records and read first.

Tasks write records, each a gzip member of its own, to shards in the shared folder,
and return (file, offset, length, URL, digest) of each. A shard's name is unique to
the attempt that wrote it, so a retried or lost task leaves at most a file that no
index names. Reading sorts the selected index rows by place and joins neighbouring
ranges into one read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialise, shared_dir

#: Payloads below this size are always written whole.
REVISIT_FROM = 100
#: Ranges up to GAP bytes apart are read at once, up to READ bytes; a shard is closed at SHARD bytes.
GAP, READ, SHARD = 64 << 10, 8 << 20, 1 << 30
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_INDEX = "file string, offset long, length long, url string, digest string, page_id long"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def _urn(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record as a gzip member. A URL keeps printable ASCII; all else is percent-encoded."""
    again = refers_to is not None
    block = _HTTP + (b"" if again else payload)
    fields = {
        "WARC-Type": "revisit" if again else "response",
        "WARC-Record-ID": _urn(page_id, digest),
        "WARC-Date": date,
        "WARC-Target-URI": None if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~"),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Profile": _PROFILE if again else None,
        "WARC-Refers-To": _urn(refers_to, digest) if again else None,
        "X-Page-Id": page_id,
        "X-Payload-Length": len(payload),
        "X-Refers-To-Page": refers_to,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(block),
    }
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    packed = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packed.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + packed.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """(header fields, payload) of one gzip member."""
    head, _, rest = zlib.decompress(member, 31).partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]


def originals(pages: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to) of the pages that revisit another: payloads equal, and the smallest page_id is the other's."""
    seen = pages.select("page_id", F.sha2("payload", 256).alias("digest")).filter(F.octet_length("payload") >= REVISIT_FROM)
    first = seen.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).filter("last > refers_to").drop("last")
    return seen.join(first, "digest").filter("page_id > refers_to").select("page_id", "digest", "refers_to").distinct()


def write(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record for each row of ``df`` and return the index, itself a table in ``folder``."""
    pages = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    of = materialise(originals(pages)).select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "refers_to")
    pages = pages.withColumn("digest", F.sha2("payload", 256))
    pages = pages.join(of, (pages.page_id == of.p) & (pages.digest == of.d), "left").select("page_id", "url", "payload", "digest", "refers_to")

    def run(batches):
        store, top = opened(folder)
        store.create_dir(top, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                rows = {c: [] for c in ("file", "offset", "length")}
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None:
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{top}/{name}", compression=None)
                    member = record(*row, date)
                    out.write(member)
                    for c, v in (("file", name), ("offset", at), ("length", len(member))):
                        rows[c].append(v)
                    at += len(member)
                    if at >= SHARD:
                        out.close()
                        out = None
                yield pa.RecordBatch.from_arrays([pa.array(rows["file"], pa.string()), pa.array(rows["offset"], pa.int64()), pa.array(rows["length"], pa.int64()), batch.column(1), batch.column(3), batch.column(0)], names=["file", "offset", "length", "url", "digest", "page_id"])
        finally:
            if out is not None:
                out.close()

    index = f"{folder}/index"
    map_batches(pages, run, _INDEX).write.parquet(index)
    return df.sparkSession.read.schema(_INDEX).parquet(index)


def read(index: DataFrame, folder: str) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to) of the index rows given.

    A revisit's payload is null; its figures are those of the full payload. A
    response whose payload does not have its digest raises an error.
    """
    rows = index.select("file", "offset", "length", "url", "page_id")
    rows = rows.repartition("file", F.floor(F.col("offset") / READ)).sortWithinPartitions("file", "offset")

    def one(url, page_id, member):
        fields, payload = parse(member)
        digest, again = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"] == "revisit"
        if not again and hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"page {page_id}: the payload does not have its digest")
        refers = fields.get("X-Refers-To-Page")
        return page_id, url, None if again else payload, int(fields["X-Payload-Length"]), digest, fields["WARC-Type"], None if refers is None else int(refers)

    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def run(batches):
        store, top = opened(folder)

        def fetched(group):
            low, high = group[0][1], group[-1][1] + group[-1][2]
            with store.open_input_file(f"{top}/{group[0][0]}") as f:
                data = f.read_at(high - low, low)
            cells = [one(url, page, data[at - low : at - low + n]) for _, at, n, url, page in group]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*cells, strict=True), kinds, strict=True)], names=names)

        group: list = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and (row[0] != group[0][0] or row[1] - group[-1][1] - group[-1][2] > GAP or row[1] + row[2] - group[0][1] > READ):
                    yield fetched(group)
                    group = []
                group.append(row)
        if group:
            yield fetched(group)

    return map_batches(rows, run, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write ``df`` to a new archive in the shared folder and read all of it back, as ``read`` returns it.

    Of records with equal payloads of ``REVISIT_FROM`` bytes or more, that with
    the smallest page_id is a response and the others revisit it. Defined cases:
    a null payload is empty; a null URL has no URI field; records without a
    page_id are responses; rows that repeat the first record's page_id are
    responses too; an empty table gives an empty archive.
    """
    folder = f"{shared_dir(df.sparkSession)}/warc-{uuid.uuid4().hex}"
    return read(write(df, folder, id_col, url_col, payload_col), folder)
