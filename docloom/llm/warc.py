"""WARC archives whose records are compressed one by one with a Zstandard dictionary."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import new_path, opened, put_file, stored, text_of

#: Fixed value of the format: magic number of the skippable frame that holds the dictionary.
DICTIONARY_MAGIC = 0x184D2A5D
#: Payloads of fewer bytes are archived in full even where they repeat.
REVISIT_BYTES = 1000
PAGES = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string"


def trained(samples: list[bytes], size: int):
    """A dictionary built from records, or raw content where the trainer finds too little in them."""
    import zstandard as zstd

    try:
        return zstd.train_dictionary(size, samples, k=512, d=8)
    except zstd.ZstdError:
        return zstd.ZstdCompressionDict(b"".join(samples)[-size:], dict_type=zstd.DICT_TYPE_RAWCONTENT)


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP header of the whole payload and no body."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    name = "null" if page_id is None else str(page_id)
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{name}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url:
        lines.append("WARC-Target-URI: " + "".join(url.split()))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archive(out, records: Iterator[bytes], *, dictionary_bytes: int, sample_bytes: int) -> None:
    """Leading skippable frame with the dictionary, then a frame for each record.

    The dictionary is built from the first ``sample_bytes`` of the stream; the
    callers deal records in hashed order, so these are a random sample.
    """
    import zstandard as zstd

    first: list[bytes] = []
    size = 0
    for rec in records:
        first.append(rec)
        size += len(rec)
        if size >= sample_bytes:
            break
    dictionary = trained(first, dictionary_bytes)
    raw = dictionary.as_bytes()
    out.write(struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw)
    squeeze = zstd.ZstdCompressor(level=3, dict_data=dictionary)
    for rec in first:
        out.write(squeeze.compress(rec))
    first.clear()
    for rec in records:
        out.write(squeeze.compress(rec))


def read_archive(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive."""
    import zstandard as zstd

    magic, size = struct.unpack("<II", stream.read(8))
    if magic != DICTIONARY_MAGIC:
        raise ValueError("no dictionary frame")
    raw = stream.read(size)
    kind = zstd.DICT_TYPE_FULLDICT if raw[:4] == b"\x37\xa4\x30\xec" else zstd.DICT_TYPE_RAWCONTENT
    plain = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(raw, dict_type=kind)).stream_reader(stream, read_across_frames=True)
    held = b""

    def more() -> bool:
        nonlocal held
        got = plain.read(1 << 20)
        held += got
        return bool(got)

    while held or more():
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                raise ValueError("cut header")
        lines = held[:end].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError("not a WARC record")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        stop = end + 4 + int(headers["Content-Length"]) + 4
        while len(held) < stop:
            if not more():
                raise ValueError("cut block")
        yield headers, held[end + 4 : stop - 4]
        held = held[stop:]


def parsed(headers: dict[str, str], block: bytes) -> tuple:
    """page_id, payload bytes, digest, type and refers_to, from what the record says of its whole payload; a response's own payload is held against it."""

    def page(urn: str) -> int | None:
        name = urn.removeprefix("<urn:page:").removesuffix(">")
        return None if name == "null" else int(name)

    head, _, payload = block.partition(b"\r\n\r\n")
    http = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    size, digest, kind = int(http["Content-Length"]), headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged payload of {headers['WARC-Record-ID']}")
    return page(headers["WARC-Record-ID"]), size, digest, kind, page(headers["WARC-Refers-To"]) if kind == "revisit" else None


def revisits(pages: DataFrame, *, salts: int = 16) -> DataFrame:
    """(page_id, digest, refers_to) of the pages that repeat the payload of a page with a larger id.

    Only ids and digests move. Payload groups are counted with map-side sums, and
    the join back to a group's response is salted, for one group may hold a third
    of the rows.
    """
    keys = pages.select("page_id", F.sha1(F.encode(text_of("html"), "utf-8")).alias("digest"), F.octet_length(text_of("html")).alias("size")).where(F.col("size") >= REVISIT_BYTES)
    groups = keys.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 and refers_to is not null")
    dealt = groups.select("digest", "refers_to", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    salted = keys.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int"))
    return salted.join(dealt, ["digest", "salt"]).where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "digest", "refers_to").dropDuplicates(["page_id", "digest"])


def archive(pages: DataFrame, *, dictionary_bytes: int = 65536, sample_bytes: int = 4 << 20, files: int | None = None) -> DataFrame:
    """Writes a record for every row of ``pages`` (page_id, url, html) and returns the archives' paths.

    Among equal payloads of at least ``REVISIT_BYTES`` bytes the row with the
    largest page_id is the response and the rest revisit it; smaller ones are all
    responses. Null html is an empty payload. Rows that share that largest
    page_id are all responses; a null page_id revisits where the group has an id.
    An empty table gives no archive. Other columns are not read. Paths are
    returned through a stored table, so only whole archives of finished tasks count.
    """
    spark = pages.sparkSession
    kept = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_of("html").alias("html"))
    found = revisits(kept).select(F.col("page_id").alias("r_id"), F.col("digest").alias("r_digest"), "refers_to")
    keyed = kept.withColumn("digest", F.sha1(F.encode("html", "utf-8")))
    rows = keyed.join(found, F.col("page_id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest")), "left").select("page_id", "url", "html", "digest", "refers_to")
    spread = F.xxhash64("page_id", "digest")
    rows = (rows.repartition(files, spread) if files else rows).sortWithinPartitions(spread)
    target = new_path(spark, "warc")

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        context = TaskContext.get()
        count = 0

        def records():
            nonlocal count
            for batch in batches:
                columns = [batch.column(k) for k in range(5)]
                for i in range(batch.num_rows):
                    page_id, url, html, digest, refers_to = (c[i].as_py() for c in columns)
                    count += 1
                    yield record("response" if refers_to is None else "revisit", page_id, url, html.encode("utf-8"), digest, refers_to)

        stream = records()
        head = next(stream, None)
        if head is None:
            return

        def all_records():
            yield head
            yield from stream

        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}.warc.zst"
        path = put_file(target, name, lambda out: write_archive(out, all_records(), dictionary_bytes=dictionary_bytes, sample_bytes=sample_bytes))
        yield pa.RecordBatch.from_pydict({"archive": [path], "records": [count]}, schema=pa.schema([("archive", pa.string()), ("records", pa.int64())]))

    return stored(rows.mapInArrow(write, "archive string, records long"), "warc-list")


def read_back(archives: DataFrame) -> DataFrame:
    """A row per record of the listed archives."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path in frame["archive"]:
                system, name = opened(path)
                rows = []
                with system.open_input_stream(name, compression=None) as stream:
                    for headers, block in read_archive(stream):
                        rows.append((*parsed(headers, block), path))
                        if len(rows) == 10_000:
                            yield out(rows)
                            rows = []
                if rows:
                    yield out(rows)

    def out(rows: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=[x.split()[0] for x in PAGES.split(", ")])
        return frame.astype({"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64"})

    return archives.select("archive").repartition(max(1, archives.count())).mapInPandas(read, PAGES)
