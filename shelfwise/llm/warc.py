"""WARC archives: a writer that dedups payloads, and a splittable reader.

Every record is a gzip member of its own. Reading tasks take byte ranges: they
look for the gzip magic, check a candidate by decoding its header (it must open
a WARC record) and the whole member (its checksum), and own the records that
start inside their range.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.session import materialize, scratch_path

MAGIC = b"\x1f\x8b\x08"
REVISIT_BYTES = 1000
SPLIT_BYTES = 8 << 20
MAX_TASKS = 100_000
WINDOW = 1 << 20
HEAD = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
LEVEL = 5


def _name(page_id) -> str:
    return f"<urn:x-page:{'null' if page_id is None else int(page_id)}>"


def _page(name: str) -> int | None:
    """The page id in a name that :func:`_name` gives; null for any other name."""
    scheme, _, tail = name.strip("<>").rpartition(":")
    return int(tail) if scheme == "urn:x-page" and tail.lstrip("-").isdigit() else None


def record(page_id, url: str | None, payload: bytes, sha1_hex: str, refers_to=None, revisit: bool = False) -> bytes:
    """One gzip member with a response, or a revisit (HTTP header, no payload)."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if revisit else http + payload
    digest = base64.b32encode(bytes.fromhex(sha1_hex)).decode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_name(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or '', safe=chr(37) + '!#$&()*+,/:;=?@[]~' + chr(39))}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    z = zlib.compressobj(LEVEL, wbits=31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def revisits(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(page_id, digest, refers_to) of the rows that repeat a payload of 1,000
    bytes or more of a row with a larger id. Only ids, sizes and digests move."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.sha1(html).alias("digest"), F.octet_length(html).alias("n"))
    rows = materialize(rows.where(F.col("n") >= REVISIT_BYTES).select("page_id", "digest"), "warc-digests")
    last = rows.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("c"))
    last = last.where("c > 1 and refers_to is not null").drop("c")
    found = rows.join(last, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).distinct()
    return materialize(found.select("page_id", "digest", "refers_to"), "warc-revisits")


def write_archives(
    pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """Writes one archive per task below ``folder``; returns (path, length, records).

    A task that runs again writes a file of another name; only the files that
    this table names belong to the result.

    Defined cases: a null html is an empty payload, a null url an empty URI; a
    null id is written as such and never the response of others; rows that
    repeat an id with an equal payload are all responses; an empty table gives
    no archives; other columns are ignored.
    """
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    again = revisits(pages, id_col, html_col).toDF("_page", "_digest", "refers_to")
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), F.sha1(html).alias("digest")
    )
    rows = rows.join(
        again, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")), "left"
    ).select("page_id", "url", "html", "digest", F.col("refers_to").cast("string").alias("refers_to"))
    rows = rows.withColumn("page_id", F.col("page_id").cast("string"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = arrow_fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        part = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
        n = size = 0
        out = None
        for b in batches:
            for r in b.itertuples(index=False):
                out = out or store.open_output_stream(f"{root}/{part}", compression=None)
                blob = record(
                    None if r.page_id is None else int(r.page_id), r.url, r.html.encode("utf-8", "surrogatepass"),
                    r.digest, r.refers_to, r.refers_to is not None,
                )
                out.write(blob)
                n, size = n + 1, size + len(blob)
        if out:
            out.close()
            yield pd.DataFrame({"path": [f"{folder.rstrip('/')}/{part}"], "length": [size], "records": [n]})

    return materialize(rows.mapInPandas(run, "path string, length long, records long"), "warc-manifest")


def parse(member: bytes) -> dict:
    """A record's fields from its decoded member, whoever wrote it.

    The raw id, type and target are always kept; page ids are read from the names
    that :func:`record` gives, and are null in other archives. The payload is
    the HTTP body with chunks joined, or the block of a record without HTTP; its
    digest is the one stated as SHA-1, else it is taken here. A revisit has no
    payload, and a size only if its HTTP head states one.
    """
    head, _, rest = member.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    field = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(field["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("length and record differ")
    kind, own = field["warc-type"], _page(field["warc-record-id"])
    payload, stated = block, None
    if field.get("content-type", "").replace(" ", "").lower().startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        sent = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")[1:])}
        stated = int(sent[b"content-length"]) if sent.get(b"content-length", b"").isdigit() else None
        if b"chunked" in sent.get(b"transfer-encoding", b"").lower():
            payload, stated = joined_chunks(payload), None
    digest = stated_digest(field.get("warc-payload-digest", ""))
    if kind != "revisit":
        taken = hashlib.sha1(payload).hexdigest()
        if own is not None and (stated not in (None, len(payload)) or digest not in (None, taken)):
            raise ValueError("payload and digest differ")
        stated, digest = len(payload), digest or taken
    return {
        "page_id": own,
        "record_type": kind,
        "payload_bytes": stated,
        "payload_digest": digest,
        "refers_to": _page(field.get("warc-refers-to", "")) if kind == "revisit" else None,
        "target_uri": field.get("warc-target-uri"),
        "record_id": field["warc-record-id"],
        "payload": None if kind == "revisit" else payload,
    }


def stated_digest(text: str) -> str | None:
    """Lower-case hex of a stated SHA-1, in base 32 or hex; null for others."""
    name, _, value = text.partition(":")
    if name.lower() != "sha1":
        return None
    try:
        raw = bytes.fromhex(value) if len(value) == 40 else base64.b32decode(value.upper())
    except ValueError:
        return None
    return raw.hex() if len(raw) == 20 else None


def joined_chunks(body: bytes) -> bytes:
    """The body of a chunked message; one that breaks off gives what it has, one without chunks itself."""
    out, at = [], 0
    while at < len(body):
        line, _, _ = body[at:].partition(b"\r\n") if len(body) - at < 64 else body[at : at + 64].partition(b"\r\n")
        try:
            n = int(line.partition(b";")[0], 16)
        except ValueError:
            return b"".join(out) if out else body
        begin = at + len(line) + 2
        out.append(body[begin : begin + n])
        if n == 0:
            break
        at = begin + n + 2
    return b"".join(out)


def member_at(file, at: int, length: int) -> tuple[bytes, int] | None:
    """The decoded gzip member at ``at`` and where it ends, if it is a whole
    member that opens a WARC record."""
    z, parts, pos = zlib.decompressobj(31), [], at
    seen = 0
    try:
        while not z.eof:
            if pos >= length:
                return None
            file.seek(pos)
            chunk = file.read(min(HEAD, length - pos))
            pos += len(chunk)
            parts.append(z.decompress(chunk))
            seen += len(parts[-1])
            if seen >= 7 and not b"".join(parts[:2])[:7] == b"WARC/1.":
                return None
    except zlib.error:
        return None
    text = b"".join(parts)
    return (text, pos - len(z.unused_data)) if text[:7] == b"WARC/1." else None


def scan_range(file, start: int, stop: int, length: int) -> Iterator[tuple[int, dict]]:
    """(offset, record) of the records that start in [start, stop)."""
    at = start
    while at < stop:
        file.seek(at)
        window = file.read(min(WINDOW, stop + len(MAGIC) - 1 - at, length - at))
        hit = window.find(MAGIC)
        if hit < 0:
            at += max(1, len(window) - len(MAGIC) + 1)
            continue
        at += hit
        if at >= stop:
            return
        found = member_at(file, at, length)
        if found is None:
            at += 1
            continue
        yield at, parse(found[0])
        at = found[1]


def read_archives(files: DataFrame, split_bytes: int = SPLIT_BYTES, payload: bool = True) -> DataFrame:
    """One row per record of ``files`` (path, length): its fields and place.

    Files are read in ranges of ``split_bytes``, each by a task of its own (up to
    ``MAX_TASKS``, then several ranges a task); the paths must be in a store that
    all executors reach (local, shared, HDFS or S3). Archives of other writers are
    read with what they state; see :func:`parse`.
    """
    n = files.where("length > 0").agg(F.sum(F.ceil(F.col("length") / split_bytes))).first()[0] or 1
    starts = F.sequence(F.lit(0), F.col("length") - 1, F.lit(split_bytes).cast("long"))
    ranges = files.where("length > 0").select("path", "length", F.explode(starts).alias("start"))
    # a stated number, or the few rows of the list would be merged into one task
    ranges = ranges.repartition(min(int(n), MAX_TASKS), "path", "start")
    fields = (
        "path string, offset long, page_id long, record_type string, payload_bytes long, payload_digest string,"
        " refers_to long, target_uri string, record_id string" + ", payload binary" * payload
    )
    names = [x.split()[0] for x in fields.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                store, where = arrow_fs.FileSystem.from_uri(r.path)
                rows, held = [], 0
                with store.open_input_file(where) as file:
                    for at, x in scan_range(file, r.start, min(r.start + split_bytes, r.length), r.length):
                        rows.append(x | {"path": r.path, "offset": at})
                        held += 200 + len(x["payload"] or b"") * payload
                        if held > 8 << 20:
                            yield frame(rows)
                            rows, held = [], 0
                if rows:
                    yield frame(rows)

    def frame(rows: list[dict]) -> pd.DataFrame:
        whole = {"page_id", "refers_to", "payload_bytes"}  # may be null, and must not pass through floats
        return pd.DataFrame(
            {k: pd.array([r[k] for r in rows], dtype="Int64" if k in whole else object) for k in names}
        )

    return ranges.mapInPandas(run, fields)
