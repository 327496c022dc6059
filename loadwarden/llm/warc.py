"""WARC archives with revisit resolution.

The headers of the pages (id, url, digest and size of the payload, never the payload) are shuffled by payload digest; rows that agree in all
of them travel as one row with a count. The page with the largest id of a digest becomes the response, every other page of that digest
a revisit that is joined to it. Payloads are reduced to one per digest before they are shuffled, so the archives hold each once. Every record
gets fresh headers. Archives are gzip members, one per record, one file per task; reading parses them record by record and joins
revisits to the records they refer to.

Null payloads are empty ones. Payloads of fewer than `min_bytes` bytes are all responses. A null id ranks below every other; pages that
agree in id and payload give one response and revisits to it (the largest url wins); an empty table gives no record. Payloads are held one
at a time. Columns other than the id, the url and the html are not read.
"""
from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadwarden.llm.files import new_folder, reading, writing
from loadwarden.session import write_through

# The alphabets of base 32 digits as Spark's conv() writes them and as digests are written; field names and values.
CONV_DIGITS, BASE32_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# end of fixed values
PAGE_FIELD = "X-Page-Id"
LEVEL = 4
#: Bytes of a compressed archive that are read at once.
CHUNK = 1 << 20


def payload_digest(payload):
    """Upper-case base 32 SHA-1 of a binary column: 20 bits are five hexadecimal and four base 32 digits."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*parts), CONV_DIGITS, BASE32_DIGITS)


def _page_rows(pages: DataFrame) -> DataFrame:
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    return rows.withColumns({"digest": payload_digest(F.col("payload")), "size": F.length("payload").cast("long")})


def records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """One row per page: page_id, url, digest, size, type, `copy` (its number among pages equal in all of these), the response's id and url for
    revisits, and the payload of responses."""
    rows = _page_rows(pages)
    shared = rows.filter(F.col("size") >= min_bytes) if min_bytes > 0 else rows
    headers = shared.groupBy("page_id", "url", "digest", "size").agg(F.count("*").alias("n"))
    chosen = headers.groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("first"), F.max("size").alias("size"))
    mine = F.struct("page_id", "url") == F.col("first")
    revisits = (headers.join(chosen.drop("size"), "digest").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)))
                .filter(~mine | (F.col("copy") > 0))
                .select("page_id", "url", "digest", "size", F.lit("revisit").alias("type"), "copy", F.col("first.page_id").alias("to_page"),
                        F.col("first.url").alias("to_url"), F.lit(None).cast("binary").alias("payload")))
    payloads = shared.groupBy("digest").agg(F.first("payload").alias("payload"))
    kind = rows.schema["page_id"].dataType
    responses = chosen.join(payloads, "digest").select(
        F.col("first.page_id").alias("page_id"), F.col("first.url").alias("url"), "digest", "size", F.lit("response").alias("type"), F.lit(0).alias("copy"),
        F.lit(None).cast(kind).alias("to_page"), F.lit(None).cast("string").alias("to_url"), "payload")
    out = revisits.unionByName(responses)
    if min_bytes > 0:
        small = rows.filter(F.col("size") < min_bytes).select(
            "page_id", "url", "digest", "size", F.lit("response").alias("type"), F.lit(0).alias("copy"), F.lit(None).cast(kind).alias("to_page"),
            F.lit(None).cast("string").alias("to_url"), "payload")
        out = out.unionByName(small)
    return out


def record_id(page_id, url: str | None, digest: str, copy: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{url}|{digest}|{copy}')}>"


def _one_line(text: str) -> str:
    return "".join(c if c.isprintable() else "%" + c.encode("utf-8", "surrogatepass").hex("%").upper() for c in text)


def record_bytes(page_id, url: str | None, digest: str, size: int, kind: str, copy: int, to_page, to_url: str | None, payload: bytes | None,
                 date: str) -> bytes:
    """A WARC/1.1 record; a revisit keeps the HTTP headers of its page without the body."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    fields = {"WARC-Type": kind, "WARC-Record-ID": record_id(page_id, url, digest, copy), "WARC-Date": date, "WARC-Target-URI": _one_line(url or ""),
              "WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http; msgtype=response"}
    if page_id is not None:
        fields[PAGE_FIELD] = str(page_id)
    if kind == "revisit":
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(to_page, to_url, digest), "WARC-Refers-To-Target-URI": _one_line(to_url or "")}
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def write(pages: DataFrame, folder: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes the archives; returns the written table of files: file, n_records. `date` is the capture date of the records."""
    names = ["page_id", "url", "digest", "size", "type", "copy", "to_page", "to_url", "payload"]

    def run(batches):
        name = f"{folder}/part-{TaskContext.get().partitionId():06d}.warc.gz"
        n = 0
        with writing(name) as out:
            for batch in batches:
                columns = [batch.column(c) for c in names]
                for i in range(batch.num_rows):
                    out.write(gzip.compress(record_bytes(*(c[i].as_py() for c in columns), date), LEVEL, mtime=0))
                    n += 1
        yield pa.RecordBatch.from_pydict({"file": [name], "n_records": [n]})

    return write_through(records(pages, min_bytes).select(*names).mapInArrow(run, "file string, n_records long"), "warc-files")


class _Members:
    """The content of consecutive gzip members, read in chunks."""

    def __init__(self, source):
        self.source, self.unfold, self.held, self.fed = source, zlib.decompressobj(31), b"", b""

    def _more(self) -> bool:
        data = self.fed or self.source.read(CHUNK)
        if not data:
            return False
        self.held += self.unfold.decompress(data)
        self.fed = self.unfold.unused_data
        if self.unfold.eof:
            self.unfold = zlib.decompressobj(31)
        return True

    def line(self) -> bytes | None:
        while (at := self.held.find(b"\r\n")) < 0:
            if not self._more():
                return None
        out, self.held = self.held[:at], self.held[at + 2:]
        return out

    def take(self, n: int) -> bytes:
        parts, have = [self.held], len(self.held)
        while have < n:
            self.held = b""
            if not self._more():
                raise ValueError("an archive ends within a record")
            parts.append(self.held)
            have += len(self.held)
        whole = b"".join(parts)
        self.held = whole[n:]
        return whole[:n]

    def fields(self) -> dict[str, str] | None:
        """The named fields up to an empty line, with the first line under ''; None at the end."""
        first = self.line()
        if first is None:
            return None
        out = {"": first.decode()}
        while (line := self.line()):
            key, _, value = line.decode().partition(":")
            out[key.lower()] = value.strip()
        return out


def parse(source):
    """(fields of the record, HTTP fields, body) of every record of an archive."""
    members = _Members(source)
    while (fields := members.fields()) is not None:
        block = members.take(int(fields["content-length"]))
        if members.take(4) != b"\r\n\r\n":
            raise ValueError("a record is not closed")
        head, _, body = block.partition(b"\r\n\r\n")
        http = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}
        yield fields, http, body


def read(files: DataFrame) -> DataFrame:
    """Per record of the archives: page_id, payload_bytes, payload_digest, record_type, refers_to. The payload of every response is held
    against its digest; revisits are joined to the responses they refer to."""
    def run(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with reading(name) as source:
                    for fields, http, body in parse(source):
                        digest = fields["warc-payload-digest"].removeprefix("sha1:")
                        if fields["warc-type"] == "response" and _digest(body) != digest:
                            raise ValueError(f"{fields['warc-record-id']} does not match its digest")
                        rows.append((int(fields[PAGE_FIELD.lower()]) if PAGE_FIELD.lower() in fields else None, int(http["content-length"]), digest,
                                     fields["warc-type"], fields["warc-record-id"], fields.get("warc-refers-to")))
                kinds = [pa.int64(), pa.int64(), *[pa.string()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, kinds)],
                                                 names=["page_id", "payload_bytes", "payload_digest", "record_type", "record_id", "to_record"])

    many = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = write_through(files.select("file").repartition(many).mapInArrow(
        run, "page_id long, payload_bytes long, payload_digest string, record_type string, record_id string, to_record string"), "warc-records")
    responses = found.filter("record_type = 'response'").groupBy(F.col("record_id").alias("to_record")).agg(F.first("page_id").alias("refers_to"))
    revisits = found.filter("record_type = 'revisit'").join(responses, "to_record", "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    return found.filter("record_type = 'response'").select(*columns, F.lit(None).cast("long").alias("refers_to")).union(revisits.select(*columns, "refers_to"))


def _digest(body: bytes) -> str:
    return base64.b32encode(hashlib.sha1(body).digest()).decode()


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes the archives to the shared folder and reads them back."""
    return read(write(pages, new_folder(pages.sparkSession, "warc"), min_bytes))


#: The same rows in DuckDB: 20 bits of the digest are five hexadecimal and four base 32 digits.
SQL = f"""
WITH hashed AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, upper(sha1(coalesce(html, ''))) AS h FROM pages),
coded AS (
  SELECT page_id, payload_bytes, list_aggregate(list_transform(range(32), lambda k:
    substr('{BASE32_DIGITS}', ((('0x' || substr(h, CAST(k // 4 AS INTEGER) * 5 + 1, 5))::BIGINT >> CAST(15 - 5 * (k % 4) AS INTEGER)) & 31) + 1, 1)), 'string_agg', '') AS payload_digest
  FROM hashed),
firsts AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM coded)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM firsts
"""
