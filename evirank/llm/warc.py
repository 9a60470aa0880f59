"""WARC archives: a writer with revisit records and a reader that salvages damaged files."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, bytes_of, materialize

# Fixed values of the WARC 1.1 format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP_MAGIC = b"\x1f\x8b\x08"

#: An archive file is closed once it holds so many compressed bytes, so a reader's task holds little.
FILE_BYTES = 16 << 20


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """One record.  A revisit keeps the HTTP headers of the response, Content-Length included, not its body."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    head = {
        "WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>",
        "WARC-Target-URI": quote(url or "", safe=":/?#[]@!$&'()*+,;=%-._~"), "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Payload-Digest": f"sha1:{payload_digest(payload)}", "WARC-Block-Digest": f"sha1:{payload_digest(block)}",
        "X-Page-ID": "" if page_id is None else str(page_id), "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if kind == "revisit":
        head |= {"WARC-Profile": REVISIT_PROFILE, "X-Refers-To-Page-ID": "" if refers_to is None else str(refers_to)}
    lines = b"".join(f"{k}: {v}\r\n".encode() for k, v in head.items())
    return VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 3) -> bytes:
    packer = zlib.compressobj(level, wbits=31)
    return packer.compress(data) + packer.flush()


@dataclass
class Record:
    offset: int
    length: int
    headers: dict[str, str]
    block: bytes

    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2]


@dataclass
class Gap:
    """Bytes of the file, from offset, that no valid record holds, and the check that failed there."""

    offset: int
    length: int
    reason: str


VERSION_LINE = re.compile(rb"WARC/[0-9]{1,3}\.[0-9]{1,3}\r\n")
#: Bytes of a record's headers, digits of its length, and bytes of a name in a gzip header, at most.
MOST_HEADERS, MOST_DIGITS, MOST_NAME = 1 << 20, 18, 4096


class _Marks:
    """Finds marks at or after places that only grow, so that each byte is searched once a mark."""

    def __init__(self, data: bytes):
        self.data, self.next = data, {GZIP_MAGIC: -1, b"WARC/": -1}

    def after(self, at: int) -> int:
        """The next place from ``at`` on that may start a member or record, or the end."""
        for mark, known in self.next.items():
            if known < at:
                found = self.data.find(mark, at)
                self.next[mark] = len(self.data) if found < 0 else found
        return min(self.next.values())


def _headers(data: bytes, at: int) -> tuple[dict[str, str], int] | str:
    """The headers of the record at ``at`` and where its block starts.  A version line is no header, so the headers of a
    broken record are read as far as the next version line at most."""
    first = VERSION_LINE.match(data, at)
    if not first:
        return "no version line"
    headers, pos = {}, first.end()
    while True:
        end = data.find(b"\r\n", pos, at + MOST_HEADERS)
        if end < 0:
            return "headers do not end"
        if end == pos:
            return headers, pos + 2
        name, colon, value = data[pos:end].partition(b":")
        if not colon or not name.strip():
            return "malformed header"
        headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
        pos = end + 2


def _parse(data: bytes, at: int, whole: bool = False) -> tuple[Record, int] | str:
    """The record that starts at ``at`` and where it ends, or which check fails."""
    head = _headers(data, at)
    if isinstance(head, str):
        return head
    headers, start = head
    size = headers.get("content-length", "")
    if not (size.isascii() and size.isdigit()):
        return "no content length"
    if len(size) > MOST_DIGITS:
        return "content length out of range"
    end = start + int(size)
    if end + 4 > len(data):
        return "truncated block"
    if data[end : end + 4] != b"\r\n\r\n":
        return "block does not end where its length says"
    if whole and end + 4 != len(data):
        return "member goes on after its record"
    block = data[start:end]
    for name, part in (("warc-block-digest", block), ("warc-payload-digest", None)):
        want = headers.get(name, "")
        if part is None:
            if headers.get("warc-type") != "response":
                continue
            part = block.partition(b"\r\n\r\n")[2]
        if want.lower().startswith("sha1:") and want[5:].upper() != payload_digest(part):
            return name.removeprefix("warc-").replace("-", " ") + " differs"
    return Record(at, end + 4 - at, headers, block), end + 4


def _gzip_header(data: bytes, at: int) -> bool:
    """Whether a gzip header of sane size stands at ``at``: reserved flags unset, name and comment of ``MOST_NAME`` bytes at
    most.  Without this, unpacking would look for the end of a name in the rest of the file."""
    if len(data) < at + 10 or data[at + 3] & 0xE0:
        return False
    flags, pos = data[at + 3], at + 10
    if flags & 4:
        pos += 2 + int.from_bytes(data[pos : pos + 2], "little")
    for flag in (8, 16):
        if flags & flag:
            pos = data.find(b"\0", pos, pos + MOST_NAME) + 1
            if not pos:
                return False
    return pos < len(data)


def _member(data: bytes, at: int) -> tuple[bytes, int] | str:
    """The gzip member at ``at``, its checksum and length verified, and where it ends.  Most places that only look like
    one fail in their first bytes, so it is read in growing steps."""
    if not _gzip_header(data, at):
        return "gzip: no header"
    unpack, view = zlib.decompressobj(wbits=31), memoryview(data)
    out, pos, step = [], at, 256
    try:
        while not unpack.eof and pos < len(data):
            out.append(unpack.decompress(view[pos : pos + step]))
            pos, step = pos + step, min(4 * step, 1 << 20)
    except zlib.error as e:
        return f"gzip: {str(e).rpartition(': ')[2]}"
    if not unpack.eof:
        return "gzip: truncated member"
    return b"".join(out), min(pos, len(data)) - len(unpack.unused_data)


def salvage(data: bytes) -> tuple[list[Record], list[Gap]]:
    """All valid records of a plain or gzipped archive, and the gaps between them.

    Where a check fails (version line, headers, length, end marks, gzip checksum, block or payload
    digest), the reader searches for the next place that starts a valid member or record and
    goes on there; what lies between is one quarantined gap.  Offsets are those of the file.  A member
    whose bytes are sound but hold broken records is searched inside: its valid records are kept with the
    member's offset.  Empty data: no records, no gaps.  The time is in proportion to the bytes, but for blocks of
    broken records that lie inside each other, which are hashed each.
    """
    records: list[Record] = []
    gaps: list[Gap] = []
    marks, at, bad, why = _Marks(data), 0, None, ""

    def resume(to: int) -> None:
        nonlocal bad
        if bad is not None and to > bad:
            gaps.append(Gap(bad, to - bad, why))
        bad = None

    while at < len(data):
        got: tuple[list[Record], int] | str
        if data[at : at + 3] == GZIP_MAGIC:
            member = _member(data, at)
            if isinstance(member, str):
                got = member
            else:
                inner, end = member
                one = _parse(inner, 0, whole=True)
                if not isinstance(one, str):
                    found, broken = [one[0]], []
                else:
                    found, broken = _plain(inner)
                for r in found:
                    r.offset, r.length = at, end - at
                got = (found, end) if found else (broken[0].reason if broken else "empty member")
                if found and broken:
                    resume(at)
                    gaps.append(Gap(at, end - at, broken[0].reason))
        elif data[at : at + 5] == b"WARC/":
            one = _parse(data, at)
            got = one if isinstance(one, str) else ([one[0]], one[1])
        else:
            got = "no member or version line"
        if not isinstance(got, str):
            resume(at)
            records += got[0]
            at = got[1]
            continue
        if bad is None:
            bad, why = at, got
        at = marks.after(at + 1)
    resume(len(data))
    return records, gaps


def _plain(data: bytes) -> tuple[list[Record], list[Gap]]:
    records, gaps, at, bad, why = [], [], 0, None, ""
    while at < len(data):
        one = _parse(data, at)
        if isinstance(one, str):
            if bad is None:
                bad, why = at, one
            at = data.find(b"WARC/", at + 1)
            at = len(data) if at < 0 else at
            continue
        if bad is not None:
            gaps.append(Gap(bad, at - bad, why))
            bad = None
        records.append(one[0])
        at = one[1]
    if bad is not None:
        gaps.append(Gap(bad, len(data) - bad, why))
    return records, gaps


def plan_records(pages: DataFrame, min_bytes: int = 0) -> tuple[DataFrame, bool]:
    """page_id, url, html, sha, first, many: first is the smallest page_id of the rows with that payload, many
    tells that there are several; and whether some row repeats the page_id of a response.

    Of records with equal payloads of at least ``min_bytes`` bytes the smallest page_id is the response.
    Only ids and digests are grouped; the payloads go through one join.
    """
    html = F.coalesce("html", F.lit("")).cast("binary")
    sha = F.when(F.octet_length(html) >= min_bytes, F.sha1(html))
    keyed = materialize(pages.select("page_id", sha.alias("sha")).where("sha is not null"), "payloads")
    groups = materialize(keyed.groupBy("sha").agg(F.count("*").alias("n"), F.min("page_id").alias("first")).where("n > 1").select(F.col("sha").alias("g_sha"), "first"), "payload-groups")
    same = keyed.join(groups, (F.col("sha") == F.col("g_sha")) & F.col("page_id").eqNullSafe(F.col("first"))).groupBy("sha").count().where("count > 1")
    planned = pages.select("page_id", "url", "html", sha.alias("sha")).join(groups, F.col("sha") == F.col("g_sha"), "left")
    return planned.select("page_id", "url", "html", "sha", "first", F.col("g_sha").isNotNull().alias("many")), not same.isEmpty()


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, file_bytes: int = FILE_BYTES, level: int = 3) -> DataFrame:
    """Write one record per row of ``pages`` (page_id, url, html) to gzipped archives in ``folder`` and
    return the list of them: path, n_records, n_bytes.

    Payload: the html in UTF-8, null as empty.  Each task writes files of its own under a temporary name and
    renames them when they are whole; only the files that the returned list names, those of the task
    attempts that Spark committed, count.  An empty table writes none.
    """
    planned, repeats = plan_records(pages, min_bytes)
    planned = planned.withColumn("extra", F.lit(False))
    if repeats:
        # rows with a response's payload and page_id differ in their url at most: the first of the smallest
        # url is the response, the others revisit it
        tie = F.col("many") & F.col("page_id").eqNullSafe(F.col("first"))
        per = planned.where(tie).groupBy("page_id", "url", "html", "sha", "first", "many").agg(F.count("*").alias("k"))
        least = per.groupBy(F.col("sha").alias("t_sha")).agg(F.min("url").alias("least_url"), F.max(F.col("url").isNull()).alias("no_url"))
        spread = per.join(least, F.col("sha") == F.col("t_sha")).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("k").cast("int"))))
        head = (F.col("i") == 1) & F.when(F.col("no_url"), F.col("url").isNull()).otherwise(F.col("url") == F.col("least_url"))
        columns = ["page_id", "url", "html", "sha", "first", "many"]
        planned = planned.where(~tie).union(spread.select(*columns, (~head).alias("extra")))
    revisit = F.coalesce(F.col("many") & (~F.col("page_id").eqNullSafe(F.col("first")) | F.col("extra")), F.lit(False))
    rows = planned.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), revisit.alias("revisit"), "first")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        name, out, count, size = "", None, 0, 0

        def close() -> pa.RecordBatch:
            out.close()
            fs.move(f"{root}/.{name}.tmp", f"{root}/{name}")
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "n_records": [count], "n_bytes": [size]})

        for b in batches(parts):
            ids, urls, again, first = (b.column(i).to_pylist() for i in (0, 1, 3, 4))
            for page_id, url, html, r, f in zip(ids, urls, bytes_of(b.column(2)), again, first, strict=True):
                member = gzip_member(record("revisit" if r else "response", page_id, url, html, f if r else None), level)
                if out is None:
                    name, count, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{root}/.{name}.tmp")
                out.write(member)
                count, size = count + 1, size + len(member)
                if size >= file_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return materialize(rows.mapInArrow(run, "path string, n_records long, n_bytes long"), "archives")


def read_archives(spark: SparkSession, paths: DataFrame) -> DataFrame:
    """Salvage the archives that column ``path`` names: a row per record, or per quarantined gap.

    path, offset, length, kind ('record' or 'gap'), reason (of a gap), page_id, url, record_type,
    payload_digest, payload_bytes, refers_to, payload (of a response).

    Paths may lie in any number of folders and may repeat; null paths are ignored; an archive of the same name in
    another folder is not read.  Header values that are no numbers of up to 18 digits are null.  Empty files
    and an empty table give no rows; other columns are ignored.
    """
    paths = paths.where("path is not null")
    folders = [r.f for r in paths.select(F.regexp_replace("path", "/[^/]*$", "").alias("f")).distinct().collect()]
    spec = (
        "path string, offset long, length long, kind string, reason string, page_id long, url string, record_type string, "
        "payload_digest string, payload_bytes long, refers_to long, payload binary"
    )
    if not folders:
        return spark.createDataFrame([], spec)
    files = spark.read.format("binaryFile").load(folders)
    # one archive may be named with or without scheme and authority
    place = F.regexp_replace("path", "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "").alias("place")
    wanted = paths.select(place).distinct()
    files = files.withColumn("place", place).join(wanted, "place", "left_semi").select("path", "content")
    schema = pa.schema([
        ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("kind", pa.string()), ("reason", pa.string()), ("page_id", pa.int64()), ("url", pa.string()),
        ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary()),
    ])
    number = lambda x: int(x) if re.fullmatch("-?[0-9]{1,18}", x or "") else None

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(parts):
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                records, gaps = salvage(content.as_buffer().to_pybytes())
                rows = []
                for r in records:
                    h = r.headers
                    http, _, body = r.block.partition(b"\r\n\r\n")
                    size = next((x.partition(b":")[2].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), b"")
                    rows.append((
                        path, r.offset, r.length, "record", None, number(h.get("x-page-id")), h.get("warc-target-uri"), h.get("warc-type"),
                        h.get("warc-payload-digest", "").rpartition(":")[2], number(size.decode("ascii", "replace")), number(h.get("x-refers-to-page-id")), body if h.get("warc-type") == "response" else None,
                    ))
                rows += [(path, g.offset, g.length, "gap", g.reason, *[None] * 7) for g in gaps]
                for at in range(0, len(rows), 1000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[at : at + 1000], strict=True), schema, strict=True)], schema=schema)

    return files.mapInArrow(run, spec)
