"""WARC archives compressed with a Zstandard dictionary.

An archive is a file of Zstandard frames. The first is a skippable frame (magic
0x184D2A5D) that holds the dictionary, built from a bounded, hash-chosen sample of
the records; then each record is one frame of its own, so a record can be read by
its offset with nothing but the dictionary.

Records with equal payloads of ``min_revisit`` bytes or more are stored once: the
one with the smallest page_id is a response, the others are revisits that name it.
Equal payloads are found by their SHA-256: a minimum per digest, aggregated before
the shuffle, joined back to the pages.

Each task writes archives of about ``archive_bytes`` into the shared folder under
names of its own and returns one manifest row for each finished one. A task that is
repeated writes other names; only archives in the manifest are read, so nothing is
read twice.

Defined cases: NULL html is the empty payload and NULL url an empty one; payloads
under the limit are always responses; repeated rows of the smallest page_id are each
a response; a NULL page_id is kept, and refers to the smallest other one; an empty
table gives no archives; columns other than page_id, url, html are not read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from . import common as C

MIN_REVISIT = 100
ARCHIVE_BYTES = 16_000_000
DICT_BYTES = 65_536
SAMPLE_RECORDS = 1_500
SAMPLE_BYTES = 16_384  # of one record, for the dictionary alone
LEVEL = 3
BROADCAST_ARCHIVES = 100_000  # names of 41 bytes
DATE = "2020-01-01T00:00:00Z"
# Fixed values of the WARC and Zstandard formats.
DICT_MAGIC = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SUFFIX = ".warc.zst"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page_id(uri: str) -> int | None:
    n = uri[len("<urn:page:"):-1]
    return int(n) if n else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str,
           refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC record; a revisit (``refers_to`` given) holds no payload."""
    revisit = refers_to is not None
    block = _HTTP if revisit else _HTTP + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", date),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Payload-Length", str(len(payload))),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return b"WARC/1.1\r\n" + head.encode("utf-8") + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The fields of a record and its payload (None for a revisit)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "")
                  for line in lines[1:])
    block = rest[:int(fields["Content-Length"])]
    if len(block) != int(fields["Content-Length"]) or rest[len(block):] != b"\r\n\r\n":
        raise ValueError("WARC record of the wrong length")
    payload = None
    if fields["WARC-Type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if f"sha256:{hashlib.sha256(payload).hexdigest()}" != fields["WARC-Payload-Digest"]:
            raise ValueError("WARC payload does not match its digest")
    return {"fields": fields, "payload": payload}


# --------------------------------------------------------------------- frames

def build_dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A trained dictionary; of too few samples, their ends as raw content."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _dictionary(data: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(data)


def frames(data: bytes) -> Iterator[bytes]:
    """The records of an archive, frame by frame."""
    import zstandard

    magic, size = struct.unpack_from("<II", data)
    if magic != DICT_MAGIC:
        raise ValueError("archive does not begin with a dictionary frame")
    decompressor = zstandard.ZstdDecompressor(dict_data=_dictionary(data[8:8 + size]))
    at = 8 + size
    while at < len(data):
        one = decompressor.decompressobj()
        out = []
        step = 8_192
        while not one.eof:
            part = data[at:at + step]
            if not part:
                raise ValueError("archive ends within a frame")
            out.append(one.decompress(part))
            at += len(part) - len(one.unused_data)
            step = 131_072
        yield b"".join(out)


def _filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _write(folder: str, dictionary: bytes, archive_bytes: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        store, path = _filesystem(folder)
        compressor = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(dictionary))
        out, name, size, n = None, "", 0, 0

        def finished() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([n], pa.int64()), pa.array([size], pa.int64())],
                names=["archive", "records", "bytes"])

        for b in C.slices(batches, "html"):
            cols = [b.column(c).to_pylist() for c in
                    ("page_id", "url", "html", "digest", "refers_to")]
            for page_id, url, html, digest, refers_to in zip(*cols):
                if out is None:
                    name = f"{uuid.uuid4().hex}{SUFFIX}"
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                    out.write(struct.pack("<II", DICT_MAGIC, len(dictionary)) + dictionary)
                    size, n = 8 + len(dictionary), 0
                frame = compressor.compress(
                    record(page_id, url, html.encode("utf-8"), digest, refers_to))
                out.write(frame)
                size += len(frame)
                n += 1
                if size >= archive_bytes:
                    out.close()
                    out = None
                    yield finished()
        if out is not None:
            out.close()
            yield finished()
    return run


def with_revisits(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, html, digest, refers_to."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"),
                     F.col("url").cast("string").alias("url"),
                     F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    p = p.withColumn("digest", F.sha2("html", 256)).withColumn(
        "large", F.octet_length("html") >= min_revisit)
    # The second grouping key makes the result be dealt out again for the join, so
    # that adaptive execution can split a digest that many pages share.
    first = (p.filter("large").groupBy("digest", F.crc32("digest").alias("again"))
             .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
             .filter("n > 1").select("digest", "first_id"))
    return (p.join(first, "digest", "left")
            .withColumn("refers_to", F.when(
                F.col("large") & ~F.col("page_id").eqNullSafe(F.col("first_id")),
                F.col("first_id")))
            .select("page_id", "url", "html", "digest", "refers_to"))


def sample_dictionary(records: DataFrame, sample: int, size: int) -> bytes:
    n = records.count()
    if not n:
        return b""
    rows = (records.select("page_id", "url", "digest", F.expr(
                f"left(html, {SAMPLE_BYTES})").alias("html"))
            .filter(C.in_fraction(F.col("digest"), C.bounded_fraction(n, sample)))
            .limit(2 * sample).collect())
    return build_dictionary([record(r.page_id, r.url, r.html.encode("utf-8"), r.digest, None)
                             for r in sorted(rows, key=lambda r: (r.digest, str(r.page_id)))],
                            size)


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES,
                   level: int = LEVEL, min_revisit: int = MIN_REVISIT,
                   sample: int = SAMPLE_RECORDS, dict_bytes: int = DICT_BYTES) -> DataFrame:
    """Write the pages to ``folder``, a URI or path that all executors share, and
    return the manifest: archive (file name), records, bytes."""
    C.text_session(pages.sparkSession)
    store, path = _filesystem(folder)
    store.create_dir(path, recursive=True)
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(
        F.col("html").cast("string"), F.lit("")).alias("html")).withColumn(
        "digest", F.sha2("html", 256))
    dictionary = sample_dictionary(plain, sample, dict_bytes)
    return with_revisits(pages, min_revisit).mapInArrow(
        _write(folder, dictionary, archive_bytes, level),
        "archive string, records long, bytes long").checkpoint()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for content in b.column("content"):
            ids, urls, htmls, sizes, digests, kinds, refers = [], [], [], [], [], [], []

            def batch() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(urls, pa.string()),
                     pa.array(htmls, pa.string()), pa.array(sizes, pa.int64()),
                     pa.array(digests, pa.string()), pa.array(kinds, pa.string()),
                     pa.array(refers, pa.int64())],
                    names=["page_id", "url", "html", "payload_bytes", "payload_digest",
                           "record_type", "refers_to"])

            held = 0
            for data in frames(content.as_py()):
                r = parse(data)
                f, payload = r["fields"], r["payload"]
                ids.append(_page_id(f["WARC-Record-ID"]))
                urls.append(f["WARC-Target-URI"])
                htmls.append(None if payload is None else payload.decode("utf-8"))
                sizes.append(int(f["WARC-Payload-Length"]) if payload is None else len(payload))
                digests.append(f["WARC-Payload-Digest"].removeprefix("sha256:"))
                kinds.append(f["WARC-Type"])
                refers.append(_page_id(f["WARC-Refers-To"]) if "WARC-Refers-To" in f else None)
                held += len(data)
                if held > C.SLICE_BYTES:
                    yield batch()
                    ids, urls, htmls, sizes, digests, kinds, refers = [], [], [], [], [], [], []
                    held = 0
            yield batch()


def read_archives(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """The records of the archives in the manifest: page_id, url, html (NULL for a
    revisit), payload_bytes, payload_digest, record_type, refers_to."""
    C.text_session(spark)
    schema = ("page_id long, url string, html string, payload_bytes long, "
              "payload_digest string, record_type string, refers_to long")
    archives = manifest.count()
    if not archives:
        return spark.createDataFrame([], schema)
    names = manifest.select("archive")
    if archives <= BROADCAST_ARCHIVES:  # else the join deals out the archives anew
        names = F.broadcast(names)
    # Listed by Spark; archives that no manifest row names are left out by name
    # before their content is read.
    files = (spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}").load(folder)
             .withColumn("archive", F.regexp_extract("path", "[^/]+$", 0)))
    return (files.join(names, "archive", "left_semi")
            .select("content").mapInArrow(_read, schema))


def op9(spark, sf_dir: str) -> DataFrame:
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    manifest = write_archives(C.table(spark, sf_dir, "pages"), folder)
    return read_archives(spark, folder, manifest).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT payload_digest AS dg, min(page_id) AS first_id FROM d
      WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d LEFT JOIN f ON payload_digest = dg
"""
