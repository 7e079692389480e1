"""WARC archives: write records, index them, and read selected records back by byte ranges."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import discard, fine, materialize, skewed_join, table_path

END = "\r\n\r\n"
#: Ranges closer than this are read as one, and one read has at most READ_BYTES (a longer record is read alone).
GAP_BYTES, READ_BYTES = 1 << 16, 4 << 20
_DATE = "2024-01-01T00:00:00Z"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(text: Column) -> Column:
    """Upper-case base32 SHA-1 of a string's UTF-8 bytes, from five hexadecimal digits to four base32 ones at a time."""
    digits = F.sha1(F.encode(text, "UTF-8"))
    four = [F.lpad(F.conv(F.substring(digits, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*four), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _records(pages: DataFrame, key: str, url: str, html: str, revisit_bytes: int) -> tuple[DataFrame, DataFrame]:
    """The rows to write, and the table of revisits that they were joined with."""
    payload = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(key).alias("k"), F.col(url).alias("u"), payload.alias("p"), F.octet_length(payload).cast("long").alias("n"), sha1_base32(payload).alias("d"))
    small = rows.select("k", "d", "n")
    first = small.filter(F.col("n") >= revisit_bytes).groupBy("d", "n").agg(F.min("k").alias("refers"), F.count("*").alias("c")).filter("c > 1").drop("c")
    # Only the payloads that repeat: written first, so that the planner sees the size and broadcasts it only if it is small.
    first = materialize(first, "warc-first")
    return rows.join(first, ["d", "n"], "left"), first


def write_archive(pages: DataFrame, path: str | None = None, *, key: str = "page_id", url: str = "url", html: str = "html", revisit_bytes: int = 0) -> str:
    """Write a WARC record for each row of ``pages`` under ``path`` (by default in the shared folder), and return the path.

    The payload is the html in UTF-8 (null: empty). Among equal payloads of at least
    ``revisit_bytes`` the one with the least key is a response, the others are revisit records
    that name it; all else are responses. Archives are written by Spark's own writer, whose commit
    protocol keeps one whole copy of each part when tasks are retried.

    A null key is written as such and never is the one that others refer to; rows with a repeated
    key and payload beyond the first are written as responses, since a record can't refer to itself. Keys of any type are
    written percent-encoded, and of URLs all that a header can't hold, so that no value ends a header or is taken for another.
    """
    path = path or table_path(pages.sparkSession, "warc")
    rows, first = _records(pages, key, url, html, revisit_bytes)
    revisit = F.col("refers").isNotNull() & ~F.col("k").eqNullSafe(F.col("refers"))
    uri = F.coalesce("u", F.lit(""))
    for mark in ("%", "\r", "\n", "\x0b", "\x0c", "\x85", "\u2028", "\u2029"):  # the escape first; then what ends a line for some reader
        uri = F.replace(uri, F.lit(mark), F.lit("".join(f"%{b:02X}" for b in mark.encode()))) if mark != "%" else F.when(uri.rlike(r"[\r\n\x0b\x0c\x85\u2028\u2029]"), F.replace(uri, F.lit("%"), F.lit("%25"))).otherwise(uri)
    # An empty name stands for a null key: an empty key is written as a pair of quotes, which no encoded key holds.
    name = lambda k: F.when(k.isNull(), "").when(k.cast("string") == "", '""').otherwise(F.url_encode(k.cast("string")))
    named = lambda what, k: F.concat(F.lit(f"{what}: <urn:page:"), name(k), F.lit(">\r\n"))
    body = F.when(revisit, "").otherwise(F.col("p"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit("\r\n"),
        named("WARC-Record-ID", F.col("k")), F.lit(f"WARC-Date: {_DATE}\r\nWARC-Target-URI: "), uri, F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("d"), F.lit("\r\n"),
        F.when(revisit, F.concat(named("WARC-Refers-To", F.col("refers")), F.lit(f"WARC-Profile: {_REVISIT}\r\nX-Payload-Length: "), F.col("n").cast("string"), F.lit("\r\n"))).otherwise(""),
        F.lit("Content-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit(END),
    )
    rows.select(F.concat(head, body).alias("value")).write.option("lineSep", END).text(path)
    discard(first)
    return path


def _open(path: str):
    """A pyarrow file system and the path in it, for any URI that pyarrow knows."""
    from pyarrow import fs

    if re.match(r"file:/", path):
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


_FIELD = re.compile(rb"^([A-Za-z-]+): ?(.*)$")


def _header(raw: bytes) -> dict[str, str]:
    return {m[1].decode(): m[2].decode() for m in map(_FIELD.match, raw.split(b"\r\n")) if m}


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, length) of the parts under ``path``, listed by Spark."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length"))


def build_index(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, length, url, digest) for each record under ``path``: one sequential pass over the headers, in which payload bytes are skipped, not kept."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                system, where = _open(name)
                offsets, lengths, urls, digests = [], [], [], []
                with system.open_input_file(where) as file:
                    size, at, held, base = file.size(), 0, b"", 0
                    while at < size:
                        if at < base or at - base > len(held):
                            held, base = b"", at
                        stop = held.find(END.encode(), at - base)
                        while stop < 0:
                            more = file.read_at(min(1 << 20, size - base - len(held)), base + len(held))
                            if not more:
                                raise ValueError(f"a record of {name} has no end of header")
                            held, base = held[at - base :] + more, at
                            stop = held.find(END.encode())
                        fields = _header(held[at - base : stop])
                        length = stop - (at - base) + len(END) + int(fields["Content-Length"]) + len(END)
                        offsets.append(at)
                        lengths.append(length)
                        urls.append(fields.get("WARC-Target-URI", ""))
                        digests.append(fields.get("WARC-Payload-Digest", "").removeprefix("sha1:"))
                        at += length
                        if len(offsets) >= 5000:
                            yield pa.RecordBatch.from_arrays([pa.array([name] * len(offsets)), pa.array(offsets), pa.array(lengths), pa.array(urls), pa.array(digests)], ["file", "offset", "length", "url", "digest"])
                            offsets, lengths, urls, digests = [], [], [], []
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(offsets), pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64()), pa.array(urls, pa.string()), pa.array(digests, pa.string())], ["file", "offset", "length", "url", "digest"])

    files = archive_files(spark, path).select("file")
    return files.repartition(fine(spark), "file").mapInArrow(scan, "file string, offset long, length long, url string, digest string")


def read_ranges(system, where: str, offsets: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(position, bytes) of each range, with sorted ranges coalesced in reads of bounded size."""
    order = np.argsort(offsets, kind="stable")
    with system.open_input_file(where) as file:
        k = 0
        while k < len(order):
            start, stop, run = int(offsets[order[k]]), int(offsets[order[k]] + lengths[order[k]]), [order[k]]
            while k + len(run) < len(order):
                i = order[k + len(run)]
                end = max(stop, int(offsets[i] + lengths[i]))
                if offsets[i] - stop > GAP_BYTES or end - start > READ_BYTES:
                    break
                stop = end
                run.append(i)
            held = file.read_at(stop - start, start)
            for i in run:
                yield int(i), held[int(offsets[i]) - start : int(offsets[i] + lengths[i]) - start]
            k += len(run)


def read_records(index: DataFrame, *, with_payload: bool = True) -> DataFrame:
    """The records that ``index`` (file, offset, length) names: record_id, record_type, url, payload_digest, payload_bytes, refers_to, content_sha1 and, if asked for, payload.

    Index rows are sorted by file and offset, in runs that end with a task, and each run's ranges
    are coalesced. ``content_sha1`` is of the bytes read (the header's for a revisit, which has none; :func:`resolve_revisits` reads the payload it refers to).
    """
    import base64
    import hashlib
    from urllib.parse import unquote_plus

    names = ["record_id", "record_type", "url", "payload_digest", "payload_bytes", "refers_to", "content_sha1", "payload"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = np.array(batch.column(0).to_pylist(), object)
            offsets, lengths = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            for name in dict.fromkeys(files.tolist()):
                mine = np.flatnonzero(files == name)
                out, held = [[] for _ in names], 0
                for _, raw in read_ranges(*_open(name), offsets[mine], lengths[mine]):
                    stop = raw.index(END.encode())
                    fields = _header(raw[:stop])
                    body = raw[stop + 4 : stop + 4 + int(fields["Content-Length"])]
                    kind = fields["WARC-Type"]
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    plain = lambda x: None if x is None or x == "<urn:page:>" else unquote_plus(x.removeprefix("<urn:page:").removesuffix(">").replace('""', ""))
                    own = digest if kind == "revisit" else base64.b32encode(hashlib.sha1(body).digest()).decode()
                    size = int(fields["X-Payload-Length"]) if kind == "revisit" else len(body)
                    for column, value in zip(out, (plain(fields["WARC-Record-ID"]), kind, fields.get("WARC-Target-URI", ""), digest, size, plain(fields.get("WARC-Refers-To")), own, body if with_payload else None), strict=True):
                        column.append(value)
                    held += len(body) if with_payload else 0
                    if held > (8 << 20) or len(out[0]) >= 5000:
                        yield _batch(out, names)
                        out, held = [[] for _ in names], 0
                yield _batch(out, names)

    rows = index.select("file", "offset", "length").repartitionByRange(fine(index.sparkSession), "file", "offset").sortWithinPartitions("file", "offset")
    return rows.mapInArrow(read, "record_id string, record_type string, url string, payload_digest string, payload_bytes long, refers_to string, content_sha1 string, payload binary")


def _batch(out: list[list], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64() if n == "payload_bytes" else pa.binary() if n == "payload" else pa.string() for n in names]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """``records`` (of :func:`read_records`) with the size, digest and, if there, payload of each revisit taken from the response that it refers to.

    ``resolved`` is whether that response is among the records and its bytes have the digest that the revisit names; true for responses. Responses that many
    revisits refer to are joined in salted parts.
    """
    records = materialize(records, "warc-records")
    payload = ["payload"] if "payload" in records.columns else []
    revisit = F.col("record_type") == "revisit"
    # Repeated keys: a response is told by its key and digest.
    source = records.filter("record_type = 'response'").join(records.filter(revisit).select(F.col("refers_to").alias("record_id"), F.col("payload_digest").alias("content_sha1")).distinct(), ["record_id", "content_sha1"], "left_semi")
    source = source.groupBy(F.col("record_id").alias("refers_to"), F.col("content_sha1").alias("payload_digest")).agg(F.first("payload_bytes").alias("__bytes"), F.lit(True).alias("__found"), *(F.first(c).alias("__payload") for c in payload))
    joined = skewed_join(records.filter(revisit), materialize(source, "warc-sources"), ["refers_to", "payload_digest"], "left")
    found = F.coalesce("__found", F.lit(False))
    own = {"payload_bytes": F.coalesce("__bytes", F.lit(None).cast("long")), "content_sha1": F.when(found, F.col("payload_digest")), "payload": F.col("__payload") if payload else None}
    back = joined.select(*(own[c].alias(c) if c in own else F.col(c) for c in records.columns), found.alias("resolved"))
    return records.filter(~revisit).withColumn("resolved", F.lit(True)).union(back)


def archive_round_trip(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html", revisit_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as WARC, index the archives, read all records back: (key, payload_bytes, payload_digest, record_type, refers_to) for each row.

    A response's size and digest are those of the bytes read back, a revisit's those of the response that it refers to. Null html is an empty payload;
    null URLs are written as empty ones; an empty table gives an empty result; other columns are
    ignored. See :func:`write_archive` for ties and repeated rows.
    """
    spark = pages.sparkSession
    path = write_archive(pages, key=key, url=url, html=html, revisit_bytes=revisit_bytes)
    back = resolve_revisits(read_records(build_index(spark, path), with_payload=False).drop("payload"))
    kind = pages.schema[key].dataType
    return back.select(F.col("record_id").cast(kind).alias(key), "payload_bytes", F.col("content_sha1").alias("payload_digest"), "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
