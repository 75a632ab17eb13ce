"""WARC: writing archives of pages and reading them back with segment reassembly.

Writing: each page is one record in a gzip member of its own, with its payload in chunked transfer
framing.  Of equal payloads of at least REVISIT bytes only the page with the smallest page_id is a
response; the others are revisits that refer to it.  A block longer than SEGMENT is split: its
first part is segment 1, the others are continuation records in another file.

Reading: tasks get paths, open the files as streams, and inflate and parse them record by record,
so a task holds one record at a time, whatever the size of an archive or of a gzip member.  A file
is one task's: a payload may hold an archive itself, stored as it is, so a place in the middle of
a file can't tell whether a member begins there.  Where pyarrow has no file system for the path,
Spark reads the files whole instead.  What was found is written once.  Whole records are decoded where they are read; segments are grouped by the identifier of their origin,
ordered by segment number, checked for gaps and against the total length, and joined.  Then the
HTTP head is cut off and the chunked framing decoded.

Defined cases: a null html is an empty payload; a null page_id is larger than all others and is
written as such; rows that repeat a page_id and html are records each, and none refers to the
other; a record whose segments are not whole has its problem named and no payload, and so has what
is no record at all (no head, no length, a length or segment number that is no number, a cut
record, a cut or broken gzip member): it is a row with a problem, and reading goes on with the next
gzip member (after a broken one, the next that starts with a record); a head of more than HEAD_LIMIT
bytes counts as cut short; broken UTF-8 is read as U+FFFD; no rows give no rows; other columns
are not used.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspend.llm.common import clean_text, scratch, written
from docspend.shipping import ship

REVISIT, SEGMENT, CHUNK, ROTATE, LEVEL = 100, 32_768, 4096, 32_000_000, 3
#: Bytes of a step of reading and of inflating, and of the longest head of a record.
WINDOW, STEP, HEAD_LIMIT = 1_000_000, 16_384, 1_000_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"

RECORDS = "record_id string, warc_type string, segment int, origin string, total long, refers_to string, digest string, block binary, problem string"
READ = f"{RECORDS}, payload binary, n long, sha string"
WHOLE = "record_id string, warc_type string, refers_to string, digest string, payload binary, problem string"


#: Parts in which the rows of one payload are joined.
SALT = 16


def _part(column: str):
    return F.pmod(F.xxhash64(column), F.lit(SALT)).cast("int")


def _parts():
    return F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("part")


def chunk_framed(payload: bytes, size: int = CHUNK) -> bytes:
    out = [b"%x\r\n%b\r\n" % (len(part), part) for part in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join(out) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; extensions and trailers are allowed, anything cut short is an error."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if len(body) < at + size + 2 or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is cut short")
        out.append(body[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response block."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("no end of the HTTP head")
    framed = any(x.split(b":", 1)[0].strip().lower() == b"transfer-encoding" and b"chunked" in x.lower() for x in head.split(b"\r\n")[1:])
    return unchunked(body) if framed else body


def record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def _number(text: str | None) -> int | None:
    """A field that is a number; anything else is an error."""
    if text is None:
        return None
    if not (text.isascii() and text.isdigit()):
        raise ValueError(f"no number: {text[:40]}")
    return int(text)


class _Bytes:
    """The bytes of an iterator of chunks, taken from the front."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.data = chunks, bytearray()

    def fill(self, n: int) -> bool:
        """Hold n bytes, if there are as many."""
        while len(self.data) < n:
            chunk = next(self.chunks, None)
            if chunk is None:
                return False
            self.data += chunk
        return True

    def find(self, mark: bytes, limit: int) -> int:
        at = 0
        while (found := self.data.find(mark, at)) < 0:
            at = max(0, len(self.data) - len(mark) + 1)
            if len(self.data) > limit or not self.fill(len(self.data) + 1):
                return -1
        return found

    def take(self, n: int) -> bytes:
        self.fill(n)
        out = bytes(self.data[:n])
        del self.data[:n]
        return out

    def drain(self) -> None:
        for _ in self.chunks:
            pass


def parsed(source: _Bytes) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """Header fields (names in lower case), block and problem of each record of plain WARC bytes.

    After a record whose length is not known nothing more can be read.
    """
    while source.fill(1):
        source.fill(5)
        if not source.data.startswith(b"WARC/"):
            yield {}, b"", "not a record"
            return
        end = source.find(b"\r\n\r\n", HEAD_LIMIT)
        lines = source.take(end if end >= 0 else 4096).decode("utf-8", "replace").split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        if end < 0:
            yield fields, b"", "the head is cut short"
            return
        try:
            size = _number(fields.get("content-length"))
        except ValueError:
            size = None
        if size is None:
            yield fields, b"", "no length"
            return
        source.take(4)
        block = source.take(size)
        yield fields, block, "the record is cut short" if len(block) < size else None
        source.take(4)


class _File:
    """Reads at any place of an open file, WINDOW bytes at a time."""

    def __init__(self, f, size: int):
        self.f, self.size, self.at, self.held = f, size, 0, b""

    def read(self, at: int, n: int) -> bytes:
        """Up to n bytes from a place on; none at the end only."""
        if not self.at <= at < self.at + len(self.held):
            self.f.seek(at)
            self.at, self.held = at, self.f.read(WINDOW)
        return self.held[at - self.at : at - self.at + n]

    def plain(self) -> Iterator[bytes]:
        at = 0
        while part := self.read(at, WINDOW):
            yield part
            at += len(part)


class _Member:
    """A gzip member of a file: its plain bytes, then where it ended or what is wrong with it."""

    def __init__(self, file: _File, begin: int):
        self.file, self.end, self.problem = file, begin, None

    def chunks(self) -> Iterator[bytes]:
        one = zlib.decompressobj(31)
        try:
            while not one.eof:
                # small steps: what is left over after a member's end is copied
                step = self.file.read(self.end, STEP)
                if not step:
                    self.problem = "a gzip member is cut short"
                    return
                self.end += len(step)
                if part := one.decompress(step):
                    yield part
            self.end -= len(one.unused_data)
        except zlib.error:
            self.problem = "a gzip member is broken"


def record_start(file: _File, at: int) -> int:
    """The first place from `at` on where a gzip member starts with a record, or the end of the file."""
    while at < file.size:
        part = file.read(at, WINDOW)
        if not part:
            break
        here = part.find(b"\x1f\x8b")
        if here < 0:
            at += max(1, len(part) - 1)
            continue
        at += here
        start = _Bytes(_Member(file, at).chunks())
        if start.fill(5) and start.data.startswith(b"WARC/"):
            return at
        at += 1
    return file.size


def identifier(page_id: int | None, digest: str) -> str:
    return f"<urn:docspend:page:{'' if page_id is None else page_id}:{digest[:32]}>"


class _Archive:
    """Files of one task, begun anew after ROTATE bytes."""

    def __init__(self, stem: str):
        self.stem, self.n, self.parts, self.size = stem, 0, [], 0

    def add(self, data: bytes) -> None:
        self.parts.append(gzip.compress(data, LEVEL, mtime=0))
        self.size += len(self.parts[-1])
        if self.size > ROTATE:
            self.close()

    def close(self) -> None:
        from docspend.llm.files import atomic

        if self.parts:
            with atomic(f"{self.stem}-{self.n:04d}.warc.gz") as out:
                out.write(
                    gzip.compress(
                        record(
                            "warcinfo", [("WARC-Record-ID", f"<urn:docspend:file:{self.stem.rpartition('/')[2]}-{self.n}>")],
                            b"software: docspend\r\n"
                        ),
                        LEVEL, mtime=0
                    )
                )
                for x in self.parts:
                    out.write(x)
        self.n, self.parts, self.size = self.n + 1, [], 0


def write_archives(pages: DataFrame, path: str, segment: int = SEGMENT) -> int:
    """Write a record for each page below path; gives the number of records."""
    ship(pages.sparkSession)
    html = clean_text("html")
    keyed = pages.select(F.col("page_id").cast("long"), F.coalesce("url", F.lit("")).alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"))
    small = keyed.select("page_id", "digest", F.octet_length("html").alias("n")).where(F.col("n") >= REVISIT)
    first = small.groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count("*").alias("copies")
    ).where("copies > 1 AND first IS NOT NULL").select("digest", "first")
    # a payload that very many pages have is joined in SALT parts
    small, first = small.withColumn("part", _part("page_id")), first.select("*", _parts())
    again = small.join(first, ["digest", "part"]).where("NOT page_id <=> first").select(
        F.col("page_id").alias("p"), F.col("digest").alias("d"), "first"
    ).distinct()
    rows = keyed.join(again, keyed.page_id.eqNullSafe(again.p) & (keyed.digest == again.d), "left").select("page_id", "url", "html", "digest", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        k, n = TaskContext.get().partitionId(), 0
        main, more = _Archive(f"{path}/part-{k:06d}-a"), _Archive(f"{path}/part-{k:06d}-b")
        for batch in batches:
            for page, url, html, digest, first in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "first"))):
                name = identifier(page, digest)
                uri = "".join(c if c > " " else f"%{ord(c):02X}" for c in url)
                fields = [
                    ("WARC-Record-ID", name), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha256:{digest}"),
                    ("Content-Type", "application/http;msgtype=response")
                ]
                n += 1
                if first is not None:
                    main.add(record("revisit", [*fields, ("WARC-Refers-To", identifier(first, digest)), ("WARC-Profile", PROFILE)], HEAD))
                    continue
                block = HEAD + chunk_framed(html.encode())
                cuts = [block[i : i + segment] for i in range(0, len(block), segment)]
                if len(cuts) == 1:
                    main.add(record("response", fields, block))
                    continue
                main.add(record("response", [*fields, ("WARC-Segment-Number", "1")], cuts[0]))
                for i, cut in enumerate(cuts[1:], 2):
                    last = [("WARC-Segment-Total-Length", str(len(block)))] * (i == len(cuts))
                    more.add(
                        record(
                            "continuation",
                            [("WARC-Record-ID", f"{name[:-1]}:{i}>"), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", str(i)), *last], cut
                        )
                    )
        main.close(), more.close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return written(rows.mapInArrow(run, "n long"), "manifest").agg(F.sum("n")).first()[0] or 0


def _rows(source: _Bytes) -> Iterator[tuple]:
    """The columns of RECORDS of the records that matter here, and rows of what can't be read."""
    for f, block, problem in parsed(source):
        kind, name = f.get("warc-type"), f.get("warc-record-id")
        digest = f.get("warc-payload-digest", "").removeprefix("sha256:") or None
        numbers = []
        try:
            numbers = [_number(f.get("warc-segment-number")), _number(f.get("warc-segment-total-length"))]
        except ValueError as e:
            problem = problem or str(e)
        if problem:
            yield name, kind, None, None, None, None, digest, None, problem
        elif kind in ("response", "revisit", "continuation"):
            yield name, kind, numbers[0], f.get("warc-segment-origin-id"), numbers[1], f.get("warc-refers-to"), digest, block, None


def _records(file: _File) -> Iterator[tuple]:
    """The rows of the records of one file."""
    if file.read(0, 2) != b"\x1f\x8b":
        yield from _rows(_Bytes(file.plain()))
        return
    at = 0
    while at < file.size:
        member = _Member(file, at)
        source = _Bytes(member.chunks())
        yield from _rows(source)
        source.drain()
        if member.problem:
            yield None, None, None, None, None, None, None, None, member.problem
        at = record_start(file, at + 1) if member.problem else member.end


KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def _emitted(rows: Iterator[tuple], schema: str, size_of) -> Iterator[pa.RecordBatch]:
    """Rows as batches of some megabytes."""
    names, kinds = zip(*(x.split() for x in schema.split(", ")))
    held, size = [], 0

    def out():
        return pa.RecordBatch.from_arrays([pa.array(c, KINDS[k]) for c, k in zip(zip(*held), kinds)], list(names))

    for row in rows:
        held.append(row)
        size += size_of(row)
        if size > 8_000_000:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def _known(spark: SparkSession, path: str) -> bool:
    """Whether pyarrow has a file system for a path."""
    from docspend.llm.files import filesystem

    system = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        filesystem(_uri(system.getUri().toString().rstrip("/") + "/"))
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


def _uri(path: str) -> str:
    """A path as Spark names it, as a URI."""
    scheme, _, rest = path.partition(":")
    return f"{scheme}:{'//' * (not rest.startswith('//'))}{quote(rest, safe='/:@[]')}"


def _files(spark: SparkSession, path: str) -> DataFrame:
    """path and length of all archives below path, and their content where tasks can't open them.

    Spark deals files to tasks by their lengths; unless asked for the content it does not read it.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(path)
    return files.select("path", "length", (F.lit(None).cast("binary") if _known(spark, path) else F.col("content")).alias("content"))


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of the records of files."""
    from docspend.llm.files import filesystem

    for batch in batches:
        for path, size, content in zip(*(batch.column(c) for c in ("path", "length", "content"))):
            if content.is_valid:
                yield from _records(_File(io.BytesIO(content.as_py()), size.as_py()))
                continue
            system, name = filesystem(_uri(path.as_py()))
            with system.open_input_file(name) as f:
                yield from _records(_File(f, size.as_py()))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives below path, as they stand in the files."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _emitted(_found(batches), RECORDS, lambda r: len(r[7] or b""))

    return _files(spark, path).mapInArrow(run, RECORDS)


def _answer(kind: str, problem: str | None, block: bytes) -> tuple[bytes | None, str | None]:
    if problem is None and kind == "response":
        try:
            return payload_of(block), None
        except ValueError as e:
            problem = str(e)
    return None, problem


def _measured(payload: bytes | None) -> tuple[int | None, str | None]:
    return (None, None) if payload is None else (len(payload), hashlib.sha256(payload).hexdigest())


def read_once(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """What all archives below path hold, parsed once and written: segments as they are, whole records with
    the length and digest of their payload and, if wanted, the payload."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for r in _found(batches):
                if r[8] is None and r[2] is None and r[1] != "continuation":
                    payload, problem = _answer(r[1], None, r[7])
                    yield *r[:7], None, problem, payload if payloads else None, *_measured(payload)
                else:
                    yield *r, None, None, None

        yield from _emitted(rows(), READ, lambda r: len(r[7] or b"") + len(r[9] or b""))

    return written(_files(spark, path).mapInArrow(run, READ), "archive")


def read_pages(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """record_id, warc_type, refers_to, digest, payload, problem, n, sha of every response and revisit of the
    archives, and of what can't be read: n and sha are the payload's length and SHA-256."""
    read = read_once(spark, path, payloads)
    segment = "problem IS NULL AND (segment IS NOT NULL OR warc_type = 'continuation')"
    whole = read.where(f"NOT ({segment})").select(*(x.split()[0] for x in WHOLE.split(", ")), "n", "sha")
    joined = reassembled(read.where(segment).select(*(x.split()[0] for x in RECORDS.split(", "))))
    joined = joined.withColumns({"n": F.octet_length("payload").cast("long"), "sha": F.sha2("payload", 256)})
    return whole.unionByName(joined)


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        joined = zip(*(batch.column(c).to_pylist() for c in ("warc_type", "problem", "blocks")))
        found = [_answer(kind, problem, b"".join(blocks)) for kind, problem, blocks in joined]
        payloads, problems = zip(*found) if found else ((), ())
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(c) for c in ("record_id", "warc_type", "refers_to", "digest")), pa.array(payloads, pa.binary()),
                pa.array(problems, pa.string())
            ],
            ["record_id", "warc_type", "refers_to", "digest", "payload", "problem"]
        )


def reassembled(records: DataFrame) -> DataFrame:
    """record_id, warc_type, refers_to, digest, payload, problem: one row for each response or revisit."""
    ship(records.sparkSession)
    alone = "problem IS NOT NULL OR segment IS NULL AND warc_type <> 'continuation'"
    whole = records.where(alone).select("record_id", "warc_type", "refers_to", "digest", F.array(F.coalesce("block", F.lit(b""))).alias("blocks"), "problem")
    parts = records.where(f"NOT coalesce({alone}, true)").withColumn(
        "origin", F.when(F.col("warc_type") == "continuation", F.col("origin")).otherwise(F.col("record_id"))
    )
    first = F.col("segment") == 1
    # a record is bounded by its page; a segment read twice is the same segment
    grouped = parts.groupBy("origin").agg(
        F.array_sort(F.collect_set(F.struct("segment", "block"))).alias("parts"),
        F.max("total").alias("total"),
        F.sum(F.when(first, 1).otherwise(0)).alias("copies"),
        *(F.max(F.when(first, F.col(c))).alias(c) for c in ("warc_type", "refers_to", "digest")),
    )
    joined = grouped.withColumn("blocks", F.expr("transform(parts, x -> x.block)"))
    problem = (
        F.when(F.col("copies") == 0, "no first segment")
        .when(F.col("total").isNull(), "no last segment")
        .when(F.expr("exists(parts, x -> x.segment < 1) OR size(parts) <> element_at(parts, -1).segment OR size(parts) <> size(array_distinct(parts.segment))"), "segments missing or in conflict")
        .when(F.expr("aggregate(parts, 0L, (n, x) -> n + octet_length(x.block))") != F.col("total"), "total length differs")
    )
    many = joined.select(
        F.col("origin").alias("record_id"), F.coalesce("warc_type", F.lit("response")).alias("warc_type"), "refers_to", "digest", "blocks",
        problem.alias("problem"), F.greatest("copies", F.lit(1)).alias("copies")
    )
    # the same record stored several times is several rows
    many = many.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies").cast("long")))).drop("copies")
    return whole.unionByName(many).mapInArrow(_decoded, WHOLE)


def round_trip(pages: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, read back from archives of pages."""
    from docspend.llm.files import make_dir

    spark = pages.sparkSession
    path = scratch(spark, "warc")
    make_dir(path)
    write_archives(pages, path, segment)
    page = lambda c: F.expr(f"try_cast(split_part({c}, ':', 4) AS BIGINT)")
    read = written(read_pages(spark, path, payloads=False).select("record_id", "warc_type", "refers_to", "n", "sha"), "records")
    answers = read.where("warc_type = 'response'")
    visits = read.where("warc_type = 'revisit'").select("record_id", "warc_type", "refers_to", _part("record_id").alias("part"))
    found = answers.join(visits.select(F.col("refers_to").alias("record_id")).distinct(), "record_id", "left_semi")
    found = found.groupBy(F.col("record_id").alias("refers_to")).agg(F.first("n").alias("n"), F.first("sha").alias("sha")).select("*", _parts())
    visits = visits.join(found, ["refers_to", "part"], "left")
    names = ["record_id", "warc_type", "refers_to", "n", "sha"]
    rows = answers.select(*names).unionByName(visits.select(*names))
    return rows.select(
        page("record_id").alias("page_id"), F.col("n").alias("payload_bytes"), F.col("sha").alias("payload_digest"),
        F.col("warc_type").alias("record_type"), page("refers_to").alias("refers_to")
    )


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE octet_length(b) >= 100 GROUP BY d)
SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, d AS payload_digest,
       CASE WHEN f.first IS NULL OR f.first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f.first <> page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f USING (d)
"""
