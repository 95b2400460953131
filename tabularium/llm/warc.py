"""Zstandard web archives: one frame a record, the dictionary in a leading skippable frame.

The archive stream is: a skippable frame (magic 0x184D2A5D) that holds the
dictionary, then one Zstandard frame for every WARC record. The reader loads the
dictionary, decodes frame by frame, and checks version line, required headers,
Content-Length and payload digest; a record that fails raises, naming its offset.
Archives of other writers are read too: header names in any case, records that
are not HTTP (the block is the payload), SHA-1 digests or none; their ids are null.

Archives are rows ``(archive string, content binary)``: the same columns as
Spark's ``binaryFile`` source gives under other names, so that the committer of
any Spark sink makes retries safe. :func:`read_archives` takes either.

Defined cases: a null payload is empty; payloads below ``least`` bytes are never
deduplicated; of equal payloads the smallest id is the response and every row of
that id is one; a row without id is a response with no id; control characters
and blanks in a url are percent-encoded, a null url writes no target header.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabularium.llm.common import bounded_sample, materialise, salted_firsts

DICT_MAGIC = 0x184D2A5D
LEAST = 100
SAMPLE_ROWS, SAMPLE_BYTES, DICT_BYTES = 256, 65_536, 65_536
ARCHIVE_BYTES = 16_000_000
DATE = "2024-01-01T00:00:00Z"
_NEEDED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
_NAMES = {n.lower(): n for n in (*_NEEDED, "WARC-Target-URI", "WARC-Payload-Digest", "WARC-Refers-To", "WARC-Truncated", "Content-Type")}
#: Compressed bytes that the reader feeds first to a frame's decoder; the next portions double.
PORTION = 4096


def train_dictionary(payloads: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A Zstandard dictionary, or none where the sample is too small to train one."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, payloads).as_bytes() if len(payloads) >= 16 else b""
    except zstandard.ZstdError:
        return b""


def _clean(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record. A revisit holds the HTTP head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    name = "" if page_id is None else str(page_id)
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class ArchiveWriter:
    """Frames of one archive."""

    def __init__(self, dictionary: bytes, level: int = 3):
        import zstandard

        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self._zstd = zstandard.ZstdCompressor(level=level, dict_data=known, write_content_size=True)
        self._lead = struct.pack("<II", DICT_MAGIC, len(dictionary)) + dictionary if dictionary else b""
        self.restart()

    def restart(self) -> None:
        self._frames, self.size = [self._lead], len(self._lead)

    def add(self, rec: bytes) -> None:
        frame = self._zstd.compress(rec)
        self._frames.append(frame)
        self.size += len(frame)

    def __len__(self) -> int:
        return len(self._frames) - 1

    def content(self) -> bytes:
        return b"".join(self._frames)


def _spelling(name: str) -> str:
    """Header names in the standard's spelling, whatever case an archive writes."""
    return _NAMES.get(name.lower(), name)


def parse_record(rec: bytes, at: int = 0) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record, validated."""
    head, sep, rest = rec.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not sep or not lines[0].startswith("WARC/1."):
        raise ValueError(f"frame at {at}: no WARC record")
    headers = {}
    for line in lines[1:]:
        k, colon, v = line.partition(":")
        if not colon:
            raise ValueError(f"frame at {at}: malformed header {line!r}")
        headers[_spelling(k.strip())] = v.strip()
    missing = [k for k in _NEEDED if k not in headers]
    if missing:
        raise ValueError(f"frame at {at}: no header {missing[0]}")
    n = int(headers["Content-Length"])
    if n < 0 or len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"frame at {at}: Content-Length {n}, block of {len(rest) - 4}")
    return headers, rest[:n]


def read_stream(content: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, headers and block of every record of an archive."""
    import zstandard

    at, known = 0, None
    if len(content) >= 8 and struct.unpack_from("<I", content)[0] == DICT_MAGIC:
        n = struct.unpack_from("<I", content, 4)[0]
        if 8 + n > len(content):
            raise ValueError("truncated dictionary frame")
        data = content[8 : 8 + n]
        if data[:4] == b"\x28\xb5\x2f\xfd":  # the dictionary may itself be compressed
            data = zstandard.ZstdDecompressor().decompress(data)
        known, at = zstandard.ZstdCompressionDict(data), 8 + n
    opener = zstandard.ZstdDecompressor(dict_data=known) if known else zstandard.ZstdDecompressor()
    view = memoryview(content)
    while at < len(content):
        magic = struct.unpack_from("<I", content, at)[0] if at + 4 <= len(content) else 0
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            at += 8 + struct.unpack_from("<I", content, at + 4)[0]
            continue
        rec, size = _frame(opener, view, at)
        yield (at, *parse_record(rec, at))
        at += size


def _frame(opener, view: memoryview, at: int) -> tuple[bytes, int]:
    """One frame's content and compressed size. It is fed in portions, as a decoder copies all that it is given beyond the frame."""
    one, out, to, portion = opener.decompressobj(), [], at, PORTION
    while not one.eof:
        if to >= len(view):
            raise ValueError(f"frame at {at}: truncated")
        part = view[to : to + portion]
        out.append(one.decompress(part))
        to += len(part)
        portion *= 2
    return b"".join(out), to - len(one.unused_data) - at


def _number(urn: str | None) -> int | None:
    """The id in a name of this writer's; null for others."""
    name = (urn or "").strip("<>").removeprefix("urn:page:")
    return int(name) if name.removeprefix("-").isdigit() else None


def payload_of(headers: dict[str, str], block: bytes) -> tuple[bytes, int]:
    """Payload, and its full length: of a revisit as its HTTP head says, of records that are not HTTP the whole block."""
    if not headers.get("Content-Type", "").replace(" ", "").startswith("application/http"):
        return block, len(block)
    head, _, body = block.partition(b"\r\n\r\n")
    told = [v.strip() for k, c, v in (line.partition(b":") for line in head.split(b"\r\n")) if c and k.strip().lower() == b"content-length"]
    return body, int(told[0]) if told and told[0].isdigit() else len(body)


def checked_digest(headers: dict[str, str], payload: bytes) -> bool:
    """Whether the payload is what its digest says; SHA-256 and SHA-1, in hexadecimal or base 32. Other or no digests are not judged."""
    kind, _, told = headers.get("WARC-Payload-Digest", "").partition(":")
    if kind.lower() not in ("sha256", "sha1"):
        return True
    own = hashlib.new(kind.lower(), payload)
    return told.lower() == own.hexdigest() or told.upper().rstrip("=") == base64.b32encode(own.digest()).decode().rstrip("=")


def plan_revisits(pages: DataFrame, id_col: str, payload_col: str, least: int = LEAST) -> DataFrame:
    """Adds ``payload`` (binary), ``digest`` and ``refers_to``. Only digests that repeat are joined, salted."""
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    firsts = rows.filter(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = firsts.filter("n > 1").select("digest", "first")
    out = salted_firsts(rows, firsts, "digest")
    return out.withColumn("refers_to", F.when(F.col("page_id") > F.col("first"), F.col("first"))).drop("first")


def write_archives(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", least: int = LEAST, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives ``(archive, content)`` of about ``archive_bytes`` each, with every row of ``pages`` a record.

    The dictionary is trained on the ``SAMPLE_ROWS`` pages of least hash among those of at most ``SAMPLE_BYTES``.
    """
    sample = bounded_sample(pages.select(F.col(payload_col).cast("binary").alias("p")).filter(F.octet_length("p").between(1, SAMPLE_BYTES)), SAMPLE_ROWS, "p")
    dictionary = train_dictionary([bytes(r["p"]) for r in sample.collect()])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, k, writer = TaskContext.get().partitionId(), 0, ArchiveWriter(dictionary)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"part-{task:05d}-{k:05d}.warc.zst"]), pa.array([writer.content()], pa.binary())], names=["archive", "content"])

        for b in batches:
            for row in zip(*(b.column(n).to_pylist() for n in ("page_id", "url", "payload", "digest", "refers_to"))):
                writer.add(record(*row))
                if writer.size >= archive_bytes:
                    yield done()
                    k += 1
                    writer.restart()
        if len(writer):
            yield done()

    return plan_revisits(pages, id_col, payload_col, least).select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(packed, "archive string, content binary")


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """Every record of archives: id, full payload's length and digest, type, target, reference; on request the payload."""
    schema = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + ", payload binary" * payloads
    name = "archive" if "archive" in archives.columns else "path"

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(1):
                rows = []
                for at, h, block in read_stream(content.as_py()):
                    kind, told = h["WARC-Type"], h.get("WARC-Payload-Digest", "")
                    body, length = payload_of(h, block)
                    if kind == "revisit":
                        digest, back = told.removeprefix("sha256:") or None, _number(h.get("WARC-Refers-To"))
                    else:
                        if "WARC-Truncated" not in h and (len(body) != length or not checked_digest(h, body)):
                            raise ValueError(f"frame at {at}: payload does not match its length or digest")
                        digest, back = told.removeprefix("sha256:") if told.startswith("sha256:") else hashlib.sha256(body).hexdigest(), None
                    rows.append((_number(h["WARC-Record-ID"]), h.get("WARC-Target-URI"), length, digest, kind, back) + (body,) * payloads)
                    if len(rows) >= 1000:
                        yield _batch(rows, payloads)
                        rows = []
                if rows:
                    yield _batch(rows, payloads)

    return archives.select(name, "content").mapInArrow(opened, schema)


def _batch(rows: list[tuple], payloads: bool) -> pa.RecordBatch:
    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * payloads
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows), kinds)], names=[n for n, _ in kinds])


def round_trip(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", least: int = LEAST) -> DataFrame:
    """Write all archives as a table in the shared folder, then read every record back."""
    archives = materialise(write_archives(pages, id_col, payload_col, least), "warc")
    return read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
     d as (select page_id, octet_length(encode(html)) as n, sha256(html) as digest from p),
     f as (select digest, min(page_id) as first from d where n >= 100 group by digest)
select page_id, cast(n as bigint) as payload_bytes, d.digest as payload_digest,
       case when page_id > first then 'revisit' else 'response' end as record_type,
       case when page_id > first then first end as refers_to
from d left join f on d.digest = f.digest"""
