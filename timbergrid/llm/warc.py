"""WARC archives in seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each holding whole records up to ``FRAME_BYTES`` of raw text, and a
footer: the seek table of the seekable format, a skippable frame with every frame's two sizes. ``index`` maps a record
to its bundle, frame and offset within the frame's raw text, so one record costs one frame.

Records with equal payloads (same SHA-1 and length) of at least ``MIN_REVISIT`` bytes are stored once, in the record
of the largest page_id; the others are revisit records that name it and keep its HTTP head alone. Groups are counted
with partial aggregation over digests, never over payloads, and pages are not shuffled to be archived: the table of
repeated payloads is broadcast while its row count is within ``BROADCAST_ROWS`` and joined by shuffle beyond.

Bundles are rows of a Parquet table in the shared folder, a container that every store of Spark's can hold; ``image``
is the file, and any Zstandard reader can read it.

Defined results: null html is an empty payload; null urls have no target line; a page without page_id is a record
without number, and never the one that others refer to; repeated rows with the largest page_id are all responses;
payloads of any length are stored whole; an empty table has no bundles.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .workers import prepare

MIN_REVISIT, FRAME_BYTES, BUNDLE_BYTES = 1000, 1 << 18, 1 << 24
BROADCAST_ROWS = 500_000
#: Fixed values of the Zstandard and seekable formats.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_URN = "<urn:timbergrid:page:%s>"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def plan(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, html (not null), digest, refers_to: the page whose payload this one repeats, else null."""
    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html")).withColumns({"digest": F.sha1(F.encode("html", "UTF-8")), "n": F.octet_length("html")})
    repeated = rows.where(F.col("n") >= min_bytes).groupBy("digest", "n").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("rows")).where("rows > 1 AND keeper IS NOT NULL").drop("rows")
    repeated = scratch.materialize(repeated, "repeated")
    if repeated.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        repeated = F.broadcast(repeated)
    return rows.join(repeated, ["digest", "n"], "left").select("page_id", "url", "html", "digest", F.when(~F.col("keeper").eqNullSafe(F.col("page_id")), F.col("keeper")).alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_URN % ('' if page_id is None else page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_URN % refers_to}"]
        block = http
    else:
        block = http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Bundle:
    def __init__(self, level: int = 3) -> None:
        import zstandard

        self.compress = zstandard.ZstdCompressor(level=level, write_content_size=True).compress
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.open: list[bytes] = []
        self.open_bytes = self.raw_bytes = 0
        self.where: list[tuple[int | None, int, int]] = []

    def add(self, page_id: int | None, raw: bytes) -> None:
        self.where.append((page_id, len(self.frames), self.open_bytes))
        self.open.append(raw)
        self.open_bytes += len(raw)
        self.raw_bytes += len(raw)
        if self.open_bytes >= FRAME_BYTES:
            self.close_frame()

    def close_frame(self) -> None:
        if self.open:
            self.frames.append(self.compress(b"".join(self.open)))
            self.sizes.append((len(self.frames[-1]), self.open_bytes))
            self.open, self.open_bytes = [], 0

    def image(self) -> bytes:
        self.close_frame()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE, len(table)) + table


def seek_table(image: bytes) -> np.ndarray:
    """Begin, compressed size and raw size of each frame, from the footer."""
    n, flags, magic = struct.unpack("<IBI", image[-9:])
    if magic != SEEKABLE or flags & 0x80:
        raise ValueError("not a seekable bundle")
    sizes = np.frombuffer(image[len(image) - 9 - 8 * n : -9], dtype="<u4").reshape(n, 2).astype(np.int64)
    return np.column_stack([np.cumsum(sizes[:, 0]) - sizes[:, 0], sizes])


def read_frame(image: bytes, begin: int, size: int, raw: int) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(image[begin : begin + size], max_output_size=raw)


def parse_record(raw: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and the end of the record that begins at ``at``."""
    end = raw.index(b"\r\n\r\n", at)
    head = dict(x.split(": ", 1) for x in raw[at:end].decode().split("\r\n")[1:])
    begin, n = end + 4, int(head["Content-Length"])
    return head, raw[begin : begin + n], begin + n + 4


def describe(head: dict[str, str], block: bytes) -> tuple:
    """page_id, payload bytes, payload digest, type, refers_to of a record."""
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda urn: int(x) if (x := urn.rpartition(":")[2].rstrip(">")) else None
    if head["WARC-Type"] == "response":
        return number(head["WARC-Record-ID"]), len(payload), hashlib.sha1(payload).hexdigest(), "response", None
    length = int(dict(x.split(b": ", 1) for x in http.split(b"\r\n")[1:])[b"Content-Length"])
    return number(head["WARC-Record-ID"]), length, head["WARC-Payload-Digest"].removeprefix("sha1:"), "revisit", number(head["WARC-Refers-To"])


def write_bundles(pages: DataFrame) -> DataFrame:
    """The table of bundles: bundle, image, index: array of struct(page_id, frame, offset)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, n, bundle = TaskContext.get().partitionId(), 0, Bundle()

        def done() -> pd.DataFrame:
            image = bundle.image()
            index = [{"page_id": p, "frame": f, "offset": o} for p, f, o in bundle.where]
            return pd.DataFrame({"bundle": [f"{part:06d}-{n:06d}"], "image": [image], "index": [index]})

        for batch in batches:
            whole = lambda c: [None if x is pd.NA else x for x in batch[c].astype("Int64").tolist()]  # noqa: B023, E731
            for page_id, url, html, digest, refers in zip(whole("page_id"), batch["url"], batch["html"], batch["digest"], whole("refers_to"), strict=True):
                bundle.add(page_id, record(page_id, url, html.encode("utf-8"), digest, refers))
                if bundle.raw_bytes >= BUNDLE_BYTES:
                    yield done()
                    n, bundle = n + 1, Bundle()
        if bundle.where:
            yield done()

    prepare(pages.sparkSession, 500)
    return scratch.materialize(plan(pages).mapInPandas(run, "bundle string, image binary, index array<struct<page_id: long, frame: int, offset: int>>"), "bundles")


_FOUND = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _described(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
    frame["page_id"], frame["refers_to"] = frame["page_id"].astype("Int64"), frame["refers_to"].astype("Int64")
    return frame


def read_bundles(bundles: DataFrame) -> DataFrame:
    """Every record of every bundle, from the images alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for image in batch["image"]:
                for begin, size, n in seek_table(image).tolist():
                    raw, at, rows = read_frame(image, begin, size, n), 0, []
                    while at < len(raw):
                        head, block, at = parse_record(raw, at)
                        rows.append(describe(head, block))
                    yield _described(rows)

    prepare(bundles.sparkSession, 8)
    return bundles.select("image").mapInPandas(run, _FOUND)


def lookup(bundles: DataFrame, wanted: DataFrame) -> DataFrame:
    """The records of ``wanted`` (page_id): each read from its one frame."""
    at = bundles.select("bundle", F.explode("index").alias("i")).select("bundle", "i.*").join(wanted.select("page_id").distinct(), "page_id", "left_semi")
    by_bundle = at.groupBy("bundle").agg(F.sort_array(F.collect_list(F.struct("frame", "offset"))).alias("at"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for image, places in zip(batch["image"], batch["at"], strict=True):
                table, known, raw, rows = seek_table(image), -1, b"", []
                for place in places:
                    if place["frame"] != known:
                        known = place["frame"]
                        raw = read_frame(image, *table[known].tolist())
                    rows.append(describe(*parse_record(raw, place["offset"])[:2]))
                yield _described(rows)

    prepare(bundles.sparkSession, 8)
    return bundles.join(by_bundle, "bundle").select("image", "at").mapInPandas(run, _FOUND)


def report(pages: DataFrame) -> DataFrame:
    return read_bundles(write_bundles(pages))
