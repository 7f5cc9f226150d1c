"""WARC archives as a chunked record table.

Payloads travel as rows (record number, chunk number, data) of at most ``CHUNK`` bytes, in order. They are cut before anything else is done with
them; a digest is carried from chunk to chunk and stands, with the length, on a record's last row, so neither writer nor reader holds a whole
record, and only those last rows are compared to find equal payloads. An archive is
a sequence of gzip members, one a record. Archives are written to the shared folder under a temporary name and
renamed when complete, so a task that runs again replaces its own file and nothing else.

Records with equal payloads of at least ``MIN_DUPLICATE`` bytes: the one with the smallest page_id is a
response, the others are revisits that refer to it and carry no payload. Smaller ones are all responses.

Defined results: null html is an empty payload; a null url is an empty target. A row with a null page_id has a record whose identifier is empty and
comes back with a null page_id; among copies it counts as the largest, and what revisits it refers to null. Rows that share a page_id and payload become
records of their own; of these the first written (smallest url, then the first read) is the response. An empty table
gives an empty result. Other input columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.store import filesystem, materialise, scratch

CHUNK = 1 << 20
MIN_DUPLICATE = 100
DATE = "2024-01-01T00:00:00Z"


def decisions(ends: DataFrame, minimum: int = MIN_DUPLICATE) -> DataFrame:
    """(rec, digest, n, record_type, refers_to) of each row of a table with rec, page_id, url, digest, n.

    The first row of each digest comes from partial aggregates, which are dealt out by digest and salt before they meet, so
    copies in any number shuffle as a row for each task.
    """
    big = ends.where(F.col("n") >= minimum)
    first = big.groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url", "rec")).alias("f"), F.count("*").alias("copies"))
    repeated = first.where("copies > 1").select("digest", "f", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("salt"))
    salted = ends.withColumn("salt", F.pmod(F.xxhash64("rec"), F.lit(16)).cast("int"))
    revisit = F.coalesce((F.col("n") >= minimum) & (F.col("rec") != F.col("f.rec")), F.lit(False))
    return salted.join(repeated, ["digest", "salt"], "left").select(
        "rec", "digest", "n", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("f.page_id")).alias("refers_to")
    )


def chunks(pages: DataFrame, size: int = CHUNK) -> DataFrame:
    """The chunk rows of a table of page_id, url and html: rec (a number of the record), page_id, url, chunk_no, last, data and, on the last row, digest and n
    of the whole payload. A record's rows lie together, in order."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    held = pages.select(F.monotonically_increasing_id().alias("rec"), F.col("page_id").cast("long"), F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"))
    n = F.greatest(F.ceil(F.octet_length("payload") / F.lit(size)), F.lit(1)).cast("int")
    cut = held.select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_no"))
    piece = F.substring(F.col("payload"), F.col("chunk_no") * size + 1, F.lit(size))
    cut = cut.withColumns({"last": F.col("chunk_no") == n - 1, "data": piece}).drop("payload")

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha, so_far = hashlib.sha256(), 0
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                ends: list[tuple] = []
                for no, last, data in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), b.column(5), strict=True):
                    if no == 0:
                        sha, so_far = hashlib.sha256(), 0
                    raw = data.as_buffer()
                    sha.update(raw)
                    so_far += raw.size
                    ends.append((sha.hexdigest(), so_far) if last else (None, None))
                made = [pa.array([e[0] for e in ends], pa.string()), pa.array([e[1] for e in ends], pa.int64())]
                yield pa.RecordBatch.from_arrays([*b.columns, *made], names=[*b.schema.names, "digest", "n"])

    return cut.mapInArrow(carry, "rec long, page_id long, url string, chunk_no int, last boolean, data binary, digest string, n long")


class Member:
    """One gzip member, fed in pieces; hands on compressed bytes as they come."""

    def __init__(self, sink, level: int = 4):
        self.sink, self.z = sink, zlib.compressobj(level, zlib.DEFLATED, 31)

    def write(self, data) -> None:
        if out := self.z.compress(data):
            self.sink.write(out)

    def close(self) -> None:
        self.sink.write(self.z.flush())


def header(page_id: int | None, url: str, kind: str, digest: str, length: int, refers_to: int | None) -> bytes:
    """A record's headers; a revisit, which has no block, keeps the length of the full payload in a field of our own."""
    name = lambda i: "<urn:page:>" if i is None else f"<urn:page:{i}>"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}"]
    if url:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        lines += [f"WARC-Refers-To: {name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Payload-Length: {length}"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {0 if kind == 'revisit' else length}", "", ""]
    return "\r\n".join(lines).encode()


WRITTEN = ["page_id", "url", "digest", "n", "record_type", "refers_to", "chunk_no", "last", "data"]


def write(rows: DataFrame, folder: str) -> DataFrame:
    """Writes chunk rows (WRITTEN), a record's together and in order; returns (path, records), a row an archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, path = filesystem(folder)
        name, n, out, member = f"part-{task.partitionId():06d}.warc.gz", 0, None, None
        temporary = f"{path}/.{name}.{task.taskAttemptId()}"
        for b in batches:
            ids, urls, digests, sizes, kinds, refers, nos, lasts, data = (b.column(i) for i in range(9))
            for i in range(b.num_rows):
                if out is None:
                    fs.create_dir(path, recursive=True)
                    out = fs.open_output_stream(temporary)
                if nos[i].as_py() == 0:
                    member = Member(out)
                    member.write(header(ids[i].as_py(), urls[i].as_py(), kinds[i].as_py(), digests[i].as_py(), sizes[i].as_py(), refers[i].as_py()))
                member.write(data[i].as_buffer())
                if lasts[i].as_py():
                    member.write(b"\r\n\r\n")
                    member.close()
                    n += 1
        if out:
            out.close()
            fs.move(temporary, f"{path}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n], pa.int64())], names=["path", "records"])

    return rows.select(*WRITTEN).mapInArrow(run, "path string, records long")


def parts(stream, size: int = CHUNK) -> Iterator[tuple[dict[str, str], Iterator[bytes]]]:
    """(headers, payload pieces) of each record of an archive, holding at most a piece of it at a time.

    The pieces of a record must be read before the next record is asked for.
    """
    z, raw, held, ended = zlib.decompressobj(31), b"", b"", False

    def more() -> bool:
        """Appends up to ``size`` bytes of the record at hand; False at the end of its gzip member."""
        nonlocal raw, held
        while not z.eof:
            raw = z.unconsumed_tail or raw or stream.read(1 << 18)
            if not raw:
                raise ValueError("the archive ends inside a record")
            out = z.decompress(raw, size)
            raw = b"" if not z.eof else z.unused_data
            if out:
                held += out
                return True
        return False

    while not ended:
        if not raw:
            raw = stream.read(1 << 18)
        if not raw:
            return
        z, held = zlib.decompressobj(31), b""
        while b"\r\n\r\n" not in held:
            if not more():
                raise ValueError("a record has no end of its headers")
        head, _, held = held.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        left = int(fields["Content-Length"])

        def pieces() -> Iterator[bytes]:
            nonlocal left, held
            while left:
                if not held and not more():
                    raise ValueError("a record is shorter than its Content-Length")
                piece, held = held[: min(left, size)], held[min(left, size) :]
                left -= len(piece)
                yield piece

        yield fields, pieces()
        if left:
            raise ValueError("a record's payload was not read")
        while more():
            pass
        if held != b"\r\n\r\n":
            raise ValueError("a record does not end in two line ends")


def read_chunks(archives: DataFrame, size: int = CHUNK) -> DataFrame:
    """The record table of archives (a ``path`` column): record_id, record_type, refers_to, digest and length (of the full payload,
    as stored), chunk_no, data, so_far (bytes up to here) and, on a record's last row, payload_digest of the bytes read."""
    names = ["record_id", "record_type", "refers_to", "digest", "length", "chunk_no", "data", "so_far", "payload_digest"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

        for b in batches:
            for path in b.column(0).to_pylist():
                fs, where = filesystem(path)
                with fs.open_input_stream(where, compression=None) as stream:
                    for fields, pieces in parts(stream, size):
                        record, refers = (int(i) if (i := fields.get(f, "")[10:-1]) else None for f in ("WARC-Record-ID", "WARC-Refers-To"))
                        full = int(fields.get("X-Payload-Length", fields["Content-Length"]))
                        own = (record, fields["WARC-Type"], refers, fields["WARC-Payload-Digest"][7:], full)
                        sha, so_far, no, before = hashlib.sha256(), 0, 0, b""
                        for piece in pieces:  # a row waits until it is known whether it is the last
                            if no:
                                rows.append((*own, no - 1, before, so_far, None))
                                held += len(before)
                            sha.update(piece)
                            so_far, no, before = so_far + len(piece), no + 1, piece
                            if held > 4 * size:
                                yield batch()
                                rows, held = [], 0
                        rows.append((*own, max(no - 1, 0), before, so_far, sha.hexdigest()))
                        held += len(before)
                        if held > 4 * size or len(rows) > 4000:
                            yield batch()
                            rows, held = [], 0
        if rows:
            yield batch()

    schema = "record_id long, record_type string, refers_to long, digest string, length long, chunk_no int, data binary, so_far long, payload_digest string"
    return archives.select("path").mapInArrow(run, schema)


def archive(pages: DataFrame, folder: str | None = None, minimum: int = MIN_DUPLICATE) -> DataFrame:
    """Writes the pages to WARC archives in ``folder`` (default: a new one in the shared folder); returns the table of archives."""
    table = materialise(chunks(pages), "chunks")
    kinds = decisions(table.where("last").select("rec", "page_id", "url", "digest", "n"), minimum)
    # dealt out by record, so that its chunks stay together however the join with the decisions is done
    records = table.drop("digest", "n").repartition("rec").join(kinds, "rec").where("record_type = 'response' or chunk_no = 0")
    full = F.col("record_type") == "response"
    records = records.withColumns({"data": F.when(full, F.col("data")).otherwise(F.lit(b"")), "last": F.col("last") | ~full})
    return materialise(write(records.sortWithinPartitions("rec", "chunk_no"), folder or scratch(pages.sparkSession, "warc")), "archives")


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every page, as read back from the archives.

    A revisit has no payload of its own; its length and digest are those its record keeps of the full payload.
    """
    archives = archive(pages)
    ends = read_chunks(archives.repartition(max(1, archives.count()))).where("payload_digest is not null")
    return ends.select(
        F.col("record_id").alias("page_id"), F.col("length").alias("payload_bytes"),
        F.when(F.col("record_type") == "response", F.col("payload_digest")).otherwise(F.col("digest")).alias("payload_digest"), "record_type", "refers_to",
    )


ORACLE = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha256(coalesce(html, '')) as h from pages),
     f as (select h, min(page_id) as first from p where n >= 100 group by h)
select p.page_id, p.n::bigint as payload_bytes, p.h as payload_digest,
       case when f.first < p.page_id then 'revisit' else 'response' end as record_type,
       case when f.first < p.page_id then f.first end as refers_to
from p left join f on p.h = f.h
"""
