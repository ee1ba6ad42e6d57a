"""WARC archives: records written a capture at a time, read back, and put together through their concurrent-to identifiers."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import file_system, materialise, new_path, small, tune

#: Compressed bytes in an archive; a task begins another one beyond them.
FILE_BYTES = 256 << 20
#: WARC needs a date; captures without one have this.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the fixed namespace of URLs


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(kind: str, page: str) -> str:
    """A record's identifier follows from its kind and its capture's serial, which no other capture of a write has."""
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{kind}:{page}')}>"


def _clean(value: str) -> str:
    return "".join(c if c >= " " and c != "\x7f" else "%%%02X" % ord(c) for c in value)


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def capture(serial: str, page: int | None, url: str | None, payload: bytes | None, size: int, sha: str, refers: str | None, refers_page: int | None) -> bytes:
    """The three records of a page: request, response or revisit, metadata. A revisit needs its payload's size and digest alone."""
    uri = _clean(url or "about:blank")
    main = record_id("main", serial)
    common = [("WARC-Target-URI", uri), ("WARC-Date", DATE)]
    request = record("request", [("WARC-Record-ID", record_id("request", serial)), ("WARC-Concurrent-To", main), *common, ("Content-Type", "application/http; msgtype=request")], f"GET {uri} HTTP/1.1\r\n\r\n".encode())
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    headers = [("WARC-Record-ID", main), *common, ("WARC-Payload-Digest", f"sha1:{sha}"), ("Content-Type", "application/http; msgtype=response")]
    if refers is None:
        answer = record("response", headers, http + payload)
    else:
        answer = record("revisit", [*headers, ("WARC-Profile", PROFILE), ("WARC-Refers-To", refers)], http)
    fields = {"page-id": page, "payload-bytes": size, "has-url": int(url is not None), "refers-to-page-id": refers_page}
    notes = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None).encode()
    meta = record("metadata", [("WARC-Record-ID", record_id("metadata", serial)), ("WARC-Concurrent-To", main), *common, ("Content-Type", "application/warc-fields")], notes)
    return _member(request) + _member(answer) + _member(meta)


def records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record of an uncompressed stream; repeated concurrent-to headers are joined by blanks."""
    while line := stream.readline():
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not the start of a record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            name, value = name.strip().lower(), value.strip()
            headers[name] = f"{headers[name]} {value}" if name == "warc-concurrent-to" and name in headers else value
        size = int(headers.get("content-length", 0))
        block = stream.read(size)
        if len(block) < size:
            raise ValueError("a record is cut short")
        yield headers, block


def write_archives(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> str:
    """Write every row's records into gzipped archives (a member a record) in the shared folder; returns the folder.

    Of rows with equal payloads of at least `min_bytes` bytes the one with the largest id is the response, the others revisit it; of
    rows that share this id the one with the largest hash of its url, and of rows that share that too, any one. Smaller payloads are
    all responses. Null html is empty; null ids are the smallest; a null url is about:blank. Every record has an identifier of its own.
    Archives get a name of their own in each attempt; the table `manifest` names those that count.

    Only digests, ids and hashes of urls are grouped. Verdicts are broadcast if there are few; if not, pages are shuffled once by digest,
    where AQE splits a digest that has many. Of rows that are alike in id, url and payload only one keeps its payload on its way.
    """
    spark = pages.sparkSession
    tune(spark)
    path = path or new_path(spark, "warc")
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    keyed = rows.withColumn("sha", F.sha1("html")).withColumn("bytes", F.octet_length("html").cast("long"))
    place, link = F.coalesce("page", F.lit(-(1 << 63))).alias("p"), F.xxhash64("url").alias("u")
    alike = keyed.where(f"bytes >= {int(min_bytes)}").groupBy("sha", "bytes", place, link).agg(F.count("*").alias("alike"))
    most = alike.groupBy("sha", "bytes").agg(F.max(F.struct("p", "u", "alike")).alias("top"), F.sum("alike").alias("copies")).where("copies > 1")
    most = materialise(most.select("sha", "bytes", "top"), "copied")
    is_top = (place == F.col("top.p")) & (link == F.col("top.u"))
    judged = keyed.join(small(most), ["sha", "bytes"], "left").withColumn("response", F.coalesce(is_top, F.lit(True)))
    columns = ["page", "url", "sha", "bytes", "top.p", "response", (F.col("top").isNotNull()).alias("copied")]
    tied = F.col("response") & F.coalesce(F.col("top.alike") > 1, F.lit(False))
    dealt = judged.where(~tied).select(*columns, F.when(F.col("response"), F.col("html")).alias("html"))
    if not most.where("top.alike > 1").isEmpty():
        # alike in all: counted, and written as one response and revisits
        one = judged.where(tied).groupBy("page", "url", "sha", "bytes", "top").agg(F.first("html").alias("html"), F.count("*").alias("n"))
        one = one.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).withColumn("response", F.col("k") == 1)
        one = one.repartition("sha", "k").select(*columns, F.when(F.col("response"), F.col("html")).alias("html"))
        dealt = dealt.unionByName(one)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, fs_folder, stream, name, size, number, seen = TaskContext.get().partitionId(), None, None, "", 0, 0, 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64())], names=["file", "bytes"])

        for b in batches:
            for page, url, sha, length, top, response, copied, html in zip(*[b.column(k).to_pylist() for k in range(8)], strict=True):
                if stream is None:
                    fs_folder = file_system(path)
                    fs_folder[0].create_dir(f"{fs_folder[1]}/archives", recursive=True)
                    name, size = f"{part:08d}-{number:04d}-{uuid.uuid4().hex}.warc.gz", 0
                    stream = fs_folder[0].open_output_stream(f"{fs_folder[1]}/archives/{name}", compression=None)
                seen += 1
                serial = f"{sha}:{length}:top" if copied and response else f"{sha}:{length}:{part}:{seen}"
                top_page = None if not copied or top == -(1 << 63) else top
                refers = None if response else record_id("main", f"{sha}:{length}:top")
                data = capture(serial, page, url, html.encode() if response else None, length, base64.b32encode(bytes.fromhex(sha)).decode(), refers, None if response else top_page)
                stream.write(data)
                size += len(data)
                if size >= FILE_BYTES:
                    stream.close()
                    yield row()
                    stream, number = None, number + 1
        if stream is not None:
            stream.close()
            yield row()

    dealt.mapInArrow(run, "file string, bytes long").write.parquet(f"{path}/manifest")
    return path


_RECORD = "file string, record_id string, kind string, concurrent_to array<string>, refers_to string, uri string, digest string, block_bytes long, payload_bytes long, payload binary, fields map<string,string>"


def read_records(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """A row for each record of the archives. Digest and size of a response are those of the payload as read."""
    tune(spark)
    manifest = spark.read.schema("file string, bytes long").parquet(f"{path}/manifest")
    files = max(1, min(manifest.count(), 100_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = file_system(path)
        names = [x.split(" ")[0] for x in _RECORD.split(", ")]
        types = [pa.string()] * 3 + [pa.list_(pa.string())] + [pa.string()] * 3 + [pa.int64(), pa.int64(), pa.binary(), pa.map_(pa.string(), pa.string())]
        out, held = [], 0

        def emit() -> pa.RecordBatch:
            nonlocal out, held
            batch = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
            out, held = [], 0
            return batch

        for b in batches:
            for name in b.column(0).to_pylist():
                with fs.open_input_file(f"{folder}/archives/{name}") as f, gzip.GzipFile(fileobj=f) as plain:
                    for h, block in records(io.BufferedReader(plain, 1 << 16)):
                        kind = h.get("warc-type")
                        payload, fields, told, size = None, {}, h.get("warc-payload-digest", "").removeprefix("sha1:") or None, None
                        if kind == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            told, size = digest(payload), len(payload)
                        elif kind == "metadata":
                            fields = dict(x.split(": ", 1) for x in block.decode().split("\r\n") if ": " in x)
                        out.append((name, h.get("warc-record-id"), kind, h.get("warc-concurrent-to", "").split(), h.get("warc-refers-to"), h.get("warc-target-uri"), told, len(block), size, payload if with_payload else None, list(fields.items())))
                        held += len(block) * with_payload + 500
                        if held > 8 << 20:
                            yield emit()
        if out:
            yield emit()

    return manifest.select("file").repartition(files).mapInArrow(run, _RECORD)


def captures(found: DataFrame) -> DataFrame:
    """Transactions: one nested row a capture: capture, request, answer, metadata, joined through concurrent-to identifiers.

    The answer is a response or revisit record. request and metadata are arrays of all such records that name its identifier, in
    whatever archive, in the order of archive and identifier; empty where there is none. A record that names several answers is in
    the capture of each; one that names none makes a capture of its own identifier; records whose answer is missing have null as the
    answer. Records that repeat an answer's identifier (an archive read twice) are captures of their own, with the same requests
    and metadata. A capture is one row, so its records must fit one.
    """
    whole = F.struct("file", "record_id", "kind", "refers_to", "uri", "digest", "block_bytes", "payload_bytes", "payload", "fields")
    is_answer = F.col("kind").isin("response", "revisit")
    named = F.when(~is_answer & (F.size("concurrent_to") > 0), F.array_distinct("concurrent_to")).otherwise(F.array("record_id"))
    keyed = found.where(F.col("kind").isin("request", "response", "revisit", "metadata")).select(F.explode(named).alias("capture"), "kind", whole.alias("r"))
    order = lambda a, b: F.when(a["file"] < b["file"], -1).when(a["file"] > b["file"], 1).when(a["record_id"] < b["record_id"], -1).when(a["record_id"] > b["record_id"], 1).otherwise(0)
    all_of = lambda *kinds: F.array_sort(F.collect_list(F.when(F.col("kind").isin(*kinds), F.col("r"))), order)
    grouped = keyed.groupBy("capture").agg(all_of("request").alias("request"), all_of("response", "revisit").alias("answers"), all_of("metadata").alias("metadata"))
    return grouped.select("capture", "request", F.explode_outer("answers").alias("answer"), "metadata")


def pages_read(assembled: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of every capture that has an answer and metadata.

    Of several metadata records the first that has a field counts.
    """
    of = lambda k: F.get(F.filter(F.transform("metadata", lambda m: m["fields"][k]), lambda v: v.isNotNull()), F.lit(0))
    return assembled.where(F.col("answer").isNotNull() & (F.size("metadata") > 0)).select(
        of("page-id").cast("long").alias("page_id"),
        F.when(of("has-url") == "1", F.col("answer.uri")).alias("url"),
        F.coalesce("answer.payload_bytes", of("payload-bytes").cast("long")).alias("payload_bytes"),
        F.col("answer.digest").alias("payload_digest"),
        F.col("answer.kind").alias("record_type"),
        F.when(F.col("answer.kind") == "revisit", of("refers-to-page-id").cast("long")).alias("refers_to"),
    )
