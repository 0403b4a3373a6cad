"""WARC archives: a writer with revisit records, and a splittable reader.

Records with equal payloads of at least LEAST bytes are written once, as the response with the largest page_id; the others
are revisit records that name it and hold the HTTP header alone. Every record is a gzip member of its own.

Archives are read in byte ranges. A task looks for gzip magic from the start of its range, takes a candidate if its member
decodes, passes its checksum and starts with a WARC header whose length fits, and from there on reads member by member.
It owns the records that start inside its range and reads on past its end to finish the last one.

Defined cases: a null page counts as empty; a null page_id is smaller than any other; pages that repeat with their id are
responses each; an empty table writes no archive; extra columns are not written.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from brickfield.llm.common import materialize
from brickfield.llm.tokens import filesystem

#: Bytes of a payload below which it is never replaced by a revisit record.
LEAST = 1000
#: Bytes of a range, and bytes read at once.
RANGE, CHUNK = 16 << 20, 1 << 18
#: Bytes of a member that are fed first, and records and payload bytes that leave a reader together.
STEP, TOGETHER, PAYLOADS = 1 << 12, 1000, 8 << 20
LEVEL = 3
MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "path string, offset long, record_type string, target_uri string, record_id string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit if it refers to another."""
    revisit = refers_to is not None
    body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + (b"" if revisit else payload)
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>"]
    lines += [f"WARC-Target-URI: {url}"] * bool(url)
    lines += ["WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def mark_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, html (as bytes), digest and refers_to."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("html"))
    rows = rows.withColumn("digest", F.sha1("html"))
    shared = rows.where(F.octet_length("html") >= LEAST).groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("keeper"))
    shared = materialize(shared.where("n > 1").select("digest", "keeper"), "warc-shared")
    marked = rows.join(shared, "digest", "left")
    return marked.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper"))).drop("keeper")


def write_warc(pages: DataFrame, folder: str) -> int:
    """Writes pages (page_id, url, html) as .warc.gz files under folder, one for each task; the number of records."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, local = filesystem(folder)
        name, written, out = f"{local}/part-{TaskContext.get().partitionId():06d}.warc.gz", 0, None
        own = f"{name}.{uuid.uuid4().hex}"
        for b in batches:
            for r in b.to_pylist():
                if out is None:
                    fs.create_dir(local, recursive=True)
                    out = fs.open_output_stream(own)
                url = (r["url"] or "").replace("\r", "%0D").replace("\n", "%0A")
                pack = zlib.compressobj(LEVEL, wbits=31)
                out.write(pack.compress(record(r["page_id"], url, r["html"], r["digest"], r["refers_to"])) + pack.flush())
                written += 1
        if out is not None:
            out.close()
            fs.move(own, name)
        yield pa.record_batch({"n": pa.array([written])})

    marked = mark_revisits(pages).select("page_id", "url", "html", "digest", "refers_to")
    return sum(r["n"] for r in marked.mapInArrow(kernel, "n long").collect())  # a number for each task


def headers(block: bytes) -> dict[str, str]:
    """Header fields by lower-case name."""
    pairs = (line.split(":", 1) for line in block.decode("utf-8", "replace").split("\r\n")[1:] if ":" in line)
    return {name.strip().lower(): value.strip() for name, value in pairs}


class Members:
    """A file's gzip members from an offset on. Bytes are read a chunk at a time and fed in steps that grow, so none is copied often."""

    def __init__(self, source, at: int):
        self.source, self.base, self.place, self.data = source, at, 0, bytearray()
        source.seek(at)

    @property
    def at(self) -> int:
        """The offset in the file of what comes next."""
        return self.base + self.place

    @property
    def left(self) -> int:
        """Bytes at hand."""
        return len(self.data) - self.place

    def more(self) -> bool:
        if self.place > CHUNK:
            del self.data[: self.place]
            self.base, self.place = self.base + self.place, 0
        new = self.source.read(CHUNK)
        self.data += new
        return bool(new)

    def member(self) -> tuple[bytes, int] | None:
        """The member that starts here and its size, or None if none does."""
        unpack, parts, fed, step = zlib.decompressobj(wbits=31), [], 0, STEP
        while True:
            if fed == self.left and not self.more():
                return None
            piece = bytes(self.data[self.place + fed : self.place + fed + step])
            try:
                parts.append(unpack.decompress(piece))
            except zlib.error:
                return None
            fed, step = fed + len(piece), min(2 * step, CHUNK)
            if not self.valid_so_far(b"".join(parts[:2])):
                return None
            if unpack.eof:
                return b"".join(parts), fed - len(unpack.unused_data)

    @staticmethod
    def valid_so_far(first: bytes) -> bool:
        return first[:5] == b"WARC/"[: len(first)]

    def record(self) -> tuple[dict[str, str], bytes, int] | None:
        """The header, block and size of the record that starts here."""
        if not (found := self.member()):
            return None
        text, size = found
        head, _, rest = text.partition(b"\r\n\r\n")
        fields = headers(head)
        length = fields.get("content-length", "")
        if not length.isdigit() or len(rest) < int(length):
            return None
        return fields, rest[: int(length)], size

    def skip(self, n: int) -> None:
        self.place += n

    def to_magic(self, end: int) -> bool:
        """Moves to the next candidate that starts before end."""
        while True:
            found = self.data.find(MAGIC, self.place)
            if found >= 0:
                self.place = found
                return self.at < end
            self.skip(max(0, self.left - len(MAGIC) + 1))
            if self.at >= end or not self.more():
                return False


def records_in(source, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header, block) of the records that start in a range of bytes."""
    members = Members(source, start)
    while members.at < end:
        if found := members.record():
            fields, block, size = found
            yield members.at, fields, block
            members.skip(size)
            continue
        if members.left:
            members.skip(1)
        if not members.to_magic(end):
            return


def read_warc(spark: SparkSession, folder: str, range_bytes: int = RANGE) -> DataFrame:
    """The records of the archives under folder. Files are listed by Spark's reader and cut into ranges of bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path", "length")
    starts = F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))
    ranges = files.where("length > 0").select("path", F.explode(starts).alias("start")).withColumn("end", F.col("start") + range_bytes)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for b in batches:
            for r in b.to_pylist():
                fs, local = filesystem(r["path"])
                with fs.open_input_file(local) as source:
                    for offset, fields, block in records_in(source, r["start"], r["end"]):
                        head, _, payload = block.partition(b"\r\n\r\n")
                        size = headers(head).get("content-length", "")
                        rows.append((
                            r["path"], offset, fields.get("warc-type"), fields.get("warc-target-uri"), fields.get("warc-record-id"), fields.get("warc-refers-to"),
                            fields.get("warc-payload-digest"), int(size) if size.isdigit() else len(payload), payload,
                        ))
                        held += len(payload)
                        if len(rows) == TOGETHER or held > PAYLOADS:
                            yield batch(rows)
                            rows, held = [], 0
        if rows:
            yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[k]) for n, k in (x.split(" ") for x in RECORD.split(", "))])
    # Ranges are few bytes each, so their number is stated: a plan that goes by bytes would put them all in one task.
    ranges = materialize(ranges, "warc-ranges")
    return ranges.repartitionByRange(max(1, ranges.count()), "path", "start").mapInArrow(kernel, RECORD)


def warc_digest(spark: SparkSession, pages: DataFrame, folder: str) -> DataFrame:
    """Writes the archives and reads them back; a response's digest is that of the payload read."""
    if not write_warc(pages, folder):
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    found = read_warc(spark, folder)
    page = lambda c: F.nullif(F.regexp_extract(F.coalesce(F.col(c), F.lit("")), r"<urn:page:(-?[0-9]*)>", 1), F.lit("")).cast("long")
    response = F.col("record_type") == "response"
    return found.select(
        page("record_id").alias("page_id"), F.when(response, F.octet_length("payload")).otherwise(F.col("payload_bytes")).cast("long").alias("payload_bytes"),
        F.when(response, F.sha1("payload")).otherwise(F.regexp_replace("payload_digest", "^sha1:", "")).alias("payload_digest"),
        "record_type", page("refers_to").alias("refers_to"),
    )
