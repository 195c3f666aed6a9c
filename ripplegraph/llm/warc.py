"""WARC archives in seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each of about FRAME_BYTES of whole records, followed by the seek table
of the public seekable format (a skippable frame with the packed and plain size of every frame, the number of frames and
a closing magic). One frame can thus be read by its place in the seek table without unpacking what stands before it. The
index maps each record identifier to (frame, offset in the unpacked frame, length).

Bundles are rows (bundle_id, bundle, entries) of a table that Spark writes, so they land in any store that Spark can write
and a lost executor only repeats its own bundles. export_bundles() writes them as .warc.zst files where a file system is
at hand.

Records whose payload is repeated become revisits: of rows with equal payloads of at least MIN_REVISIT bytes the one with
the largest page_id is the response. Digests are counted with map-side partial sums and only digests that occur twice or
more are joined back, so one payload that holds a third of all rows meets no single task with its texts (the join's skewed
side is split by Spark, or the small side is broadcast below Spark's own size limit).

Defined cases: null html is an empty payload; a null url is an empty target; a null page_id is the smallest and never a
revisit's target, and a row with it becomes a revisit only of a row that has one; repeated rows with the largest page_id
all stay responses; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.runtime import materialize, ship

MIN_REVISIT = 1000
FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 22
SKIPPABLE, SEEK_MAGIC = 0x184D2A5E, 0x8F92EAB1
ENTRIES = "array<struct<record_id:string,frame:int,offset:long,length:long>>"
DATE = "1970-01-01T00:00:00Z"


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    head.append(f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%-._~', errors='replace')}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and the payload that the record holds."""

    def fields(lines: bytes) -> dict[str, str]:
        return dict(x.split(": ", 1) for x in lines.decode().split("\r\n")[1:])

    head, _, rest = data.partition(b"\r\n\r\n")
    warc = fields(head)
    block = rest[: int(warc["Content-Length"])]
    if not head.startswith(b"WARC/1.1") or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("damaged WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, fields(http), payload


class BundleWriter:
    """Collects records; finish() gives (bundle, entries)."""

    def __init__(self) -> None:
        self.packer = zstandard.ZstdCompressor(level=3, write_checksum=True)
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.entries: list[dict] = []
        self.open: list[bytes] = []
        self.open_bytes = self.packed = 0

    def add(self, name: str, record: bytes) -> None:
        self.entries.append({"record_id": name, "frame": len(self.frames), "offset": self.open_bytes, "length": len(record)})
        self.open.append(record)
        self.open_bytes += len(record)
        if self.open_bytes >= FRAME_BYTES:
            self._close()

    def _close(self) -> None:
        if self.open:
            frame = self.packer.compress(b"".join(self.open))
            self.frames.append(frame)
            self.sizes.append((len(frame), self.open_bytes))
            self.packed += len(frame)
            self.open, self.open_bytes = [], 0

    def finish(self) -> tuple[bytes, list[dict]]:
        self._close()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes)
        foot = struct.pack("<IBI", len(self.sizes), 0, SEEK_MAGIC)
        return b"".join([*self.frames, struct.pack("<II", SKIPPABLE, len(table) + len(foot)), table, foot]), self.entries


class BundleReader:
    """Reads single frames by the seek table at the bundle's end."""

    def __init__(self, bundle: bytes):
        n, _, magic = struct.unpack_from("<IBI", bundle, len(bundle) - 9)
        if magic != SEEK_MAGIC:
            raise ValueError("no seek table")
        at = len(bundle) - 9 - 8 * n
        self.bundle, self.sizes, self.starts = bundle, [struct.unpack_from("<II", bundle, at + 8 * i) for i in range(n)], [0]
        for packed, _ in self.sizes:
            self.starts.append(self.starts[-1] + packed)
        self.cached: tuple[int, bytes] = (-1, b"")

    def frame(self, i: int) -> bytes:
        if self.cached[0] != i:
            packed = self.bundle[self.starts[i] : self.starts[i + 1]]
            self.cached = (i, zstandard.ZstdDecompressor().decompress(packed, max_output_size=self.sizes[i][1]))
        return self.cached[1]

    def record(self, frame: int, offset: int, length: int) -> bytes:
        return self.frame(frame)[offset : offset + length]


def write_bundles(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) to the stored table (bundle_id, bundle, entries)."""
    ship(pages.sparkSession)
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    pages = pages.withColumn("digest", F.when(F.octet_length("html") >= MIN_REVISIT, F.sha1(F.encode("html", "utf-8"))))
    seen = pages.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.max("page_id").alias("original"), F.count("*").alias("n"))
    seen = materialize(seen.where("n > 1").drop("n"), "warc-repeats")
    marked = pages.join(seen, "digest", "left")
    marked = marked.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("original")), F.col("original"))).select("page_id", "url", "html", "refers_to")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = BundleWriter()

        def done() -> pa.RecordBatch:
            bundle, entries = writer.finish()
            kind = pa.list_(pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]))
            return pa.RecordBatch.from_arrays([pa.array([hashlib.sha1(bundle).hexdigest()]), pa.array([bundle], pa.binary()), pa.array([entries], kind)], ["bundle_id", "bundle", "entries"])

        for b in batches:
            for page_id, url, html, refers_to in zip(*(b[c].to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                writer.add(record_id(page_id), make_record(page_id, url, html.encode("utf-8", "surrogatepass"), refers_to))
                if writer.packed >= BUNDLE_BYTES:
                    yield done()
                    writer = BundleWriter()
        if writer.entries:
            yield done()

    return materialize(marked.mapInArrow(written, f"bundle_id string, bundle binary, entries {ENTRIES}"), "warc-bundles", codec="none")


def read_bundles(bundles: DataFrame) -> DataFrame:
    """All records of the bundles, each read at its index entry: (page_id, payload_bytes, payload_digest, record_type, refers_to)."""
    ship(bundles.sparkSession)

    def number(name: str) -> int | None:
        return None if name == record_id(None) else int(name[len("<urn:page:") : -1])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for b in batches:
            for k in range(b.num_rows):
                reader, rows = BundleReader(b["bundle"][k].as_py()), []
                for e in b["entries"][k].as_py():
                    warc, http, payload = parse_record(reader.record(e["frame"], e["offset"], e["length"]))
                    digest = base64.b32decode(warc["WARC-Payload-Digest"][len("sha1:") :]).hex()
                    kind = warc["WARC-Type"]
                    if warc["WARC-Record-ID"] != e["record_id"] or kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"{e['record_id']}: the archive doesn't hold what its index says")
                    rows.append((number(warc["WARC-Record-ID"]), int(http["Content-Length"]), digest, kind, number(warc["WARC-Refers-To"]) if kind == "revisit" else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return bundles.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def export_bundles(bundles: DataFrame, folder: str) -> int:
    """Write each bundle as folder/<bundle_id>.warc.zst, from the executors, to a file system that they all see."""

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b["bundle_id"].to_pylist(), b["bundle"].to_pylist(), strict=True):
                with open(f"{folder}/{name}.warc.zst", "wb") as f:
                    f.write(data)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    return bundles.select("bundle_id", "bundle").mapInArrow(save, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_bundles(write_bundles(spark.read.parquet(f"{sf_dir}/pages.parquet")))


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes >= 1000) END AS original FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN original <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN original <> page_id THEN original END AS refers_to FROM m
"""
