"""WARC archives of web pages: a writer of gzip members, and a splittable reader.

Writing: one gzip member per record, through Spark's text writer. A member ends with the
high byte of its length, which is 0 below 16 MiB; the writer's line separator is that
byte. A longer record gets an empty closing member. Each part file is a WARC file.

Reading: Spark's text reader splits the files into byte ranges; its line separator is the
gzip magic, so a task gets the pieces that start inside its range, and nobody else does.
The magic also occurs inside compressed data. A piece is a record only if its bytes decode
to a WARC header and a complete member (its checksum holds); a member cut by a chance
magic is joined with the pieces after it. A member still open at the end of a range is
handed, with the pieces at the start of the following ranges that belong to no member, to
a second step that joins them by file and place.

File names must not end in `.gz`: Hadoop would then decode a whole file in one task.

Duplicates: of records with equal payloads of at least 1000 bytes the one with the largest
page_id is a response and the others revisit it; rows that share that page_id are all
responses, as are smaller payloads. Null html is empty, null urls too. A null page_id is
smaller than any other. An empty table gives an empty archive. Other columns are not read.
"""

import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quiltframe.functions.cells import col
from quiltframe.operators.scratch import new_folder, store
from quiltframe.operators.skew import join_by_key

MAGIC = b"\x1f\x8b\x08"
LEAST_REVISIT = 1000
HEADER_BYTES = 1 << 16
DATE = "2020-01-01T00:00:00Z"
RECORD = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, " \
         "refers_to bigint, payload binary"


def records(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html",
            least: int = LEAST_REVISIT) -> DataFrame:
    """(page_id, url, payload, payload_digest, refers_to): refers_to is null for responses."""
    rows = pages.select(col(id).cast("bigint").alias("page_id"), F.coalesce(col(url), F.lit("")).alias("url"),
                        F.coalesce(col(html), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha1("payload"))
    same = rows.where(F.octet_length("payload") >= least).groupBy("payload_digest").agg(
        F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first_id IS NOT NULL")
    # Only ids and digests meet the copies' groups; the payloads stay where they are.
    copies = join_by_key(rows.where(F.octet_length("payload") >= least).select("page_id", "payload_digest"),
                         same, ["payload_digest"], "n")
    copies = copies.where(~F.col("page_id").eqNullSafe(F.col("first_id"))).distinct().select(
        F.col("page_id").alias("copy_id"), F.col("payload_digest").alias("copy_digest"), "first_id")
    met = F.col("page_id").eqNullSafe(F.col("copy_id")) & (F.col("payload_digest") == F.col("copy_digest"))
    return rows.join(copies, met, "left").select(
        "page_id", "url", F.when(F.col("first_id").isNull(), F.col("payload")).alias("payload"),
        F.octet_length("payload").cast("bigint").alias("payload_bytes"), "payload_digest",
        F.col("first_id").alias("refers_to"))


def _name(page_id) -> str:
    return "<urn:page:" + ("" if page_id is None or pd.isna(page_id) else str(int(page_id))) + ">"


def member(page_id, url: str, payload, payload_bytes: int, digest: str, refers_to) -> bytes:
    """The gzip member of one record."""
    revisit = refers_to is not None and not pd.isna(refers_to)
    body = b"" if revisit else bytes(payload)
    lines = ["WARC/1.0", f"WARC-Type: {'revisit' if revisit else 'response'}",
             f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {DATE}",
             "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"),
             f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {payload_bytes}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest",
                  f"WARC-Refers-To: {_name(refers_to)}"]
    lines += ["Content-Type: text/html", f"Content-Length: {len(body)}", "", ""]
    data = "\r\n".join(lines).encode() + body + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = packer.compress(data) + packer.flush()
    if out[-1]:
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        out += packer.compress(b"") + packer.flush()
    return out


def write_warc(found: DataFrame, path: str) -> None:
    """Write the table made by `records` as WARC part files."""
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # The last byte, 0, is the line separator.
            yield pd.DataFrame({"value": [member(*row)[:-1] for row in batch.itertuples(index=False)]})

    columns = found.select("page_id", "url", "payload", "payload_bytes", "payload_digest", "refers_to")
    columns.mapInPandas(pack, "value binary").select(F.col("value").cast("string")).write.option(
        "lineSep", "\0").text(path)


def _unpacked(data: bytes) -> tuple[str, bytes]:
    """("whole", content); without content: "open", a WARC record that goes on, "unsure", too short to tell, or "none"."""
    reader = zlib.decompressobj(31)
    try:
        head = reader.decompress(data, HEADER_BYTES)
        if head and not head.startswith(b"WARC/"[:len(head)]):
            return "none", b""
        content = head + reader.decompress(reader.unconsumed_tail)
    except zlib.error:
        return "none", b""
    if reader.eof:
        return "whole", content
    return ("open" if len(head) >= 5 else "unsure"), b""


def _number(name: str | None) -> int | None:
    digits = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def _record(content: bytes, payload: bool = True) -> tuple | None:
    """One row of RECORD; None for an empty closing member. Raises if the payload was damaged."""
    if not content:
        return None
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[:int(fields["Content-Length"])]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and hashlib.sha1(body).hexdigest() != digest:
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} does not match its digest")
    return (_number(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI", ""), int(fields["X-Payload-Length"]),
            digest, kind, _number(fields.get("WARC-Refers-To")), body if payload and kind == "response" else None)


class _Joiner:
    """Turns pieces in file order into records; keeps what it cannot place."""

    def __init__(self, payload: bool, begun: bool = False):
        self.payload, self.begun = payload, begun
        self.pending, self.sure, self.loose = b"", False, []

    def add(self, piece: bytes) -> tuple | None:
        if self.pending:
            state, content = _unpacked(self.pending + piece)
            if state == "whole":
                self.pending = b""
                return _record(content, self.payload)
            if state != "none":
                self.pending, self.sure = self.pending + piece, state == "open"
                return None
        state, content = _unpacked(piece)
        if not self.begun and state in ("none", "unsure"):
            self.loose.append(piece)  # may belong to a member of an earlier range
            return None
        self.begun = True
        self.pending, self.sure = (piece, state == "open") if state in ("open", "unsure") else (b"", False)
        return _record(content, self.payload) if state == "whole" else None


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of all WARC files under a path, one row each (see RECORD).

    Payloads are always decoded and held against their digests; without `payload` they
    are not kept.
    """
    # The separator's bytes are given in a one-byte encoding; values are not decoded.
    pieces = spark.read.option("encoding", "ISO-8859-1").option("lineSep", MAGIC.decode("latin-1")).text(path)
    pieces = pieces.select(
        F.col("value").cast("binary").alias("piece"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"))
    # Pieces of one range come in order; a task may read several ranges.
    schema = RECORD + ", file string, start bigint, loose array<binary>, pending binary"

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, joiner = None, _Joiner(payload)

        def rest() -> list[tuple]:
            if now is None or not joiner.pending and not joiner.loose:
                return []
            return [(None,) * 7 + (*now, joiner.loose, joiner.pending)]

        for batch in batches:
            out = []
            for piece, file, start in zip(batch["piece"], batch["file"], batch["start"]):
                if (file, start) != now:
                    out += rest()
                    now, joiner = (file, start), _Joiner(payload)
                if (row := joiner.add(MAGIC + bytes(piece))) is not None:
                    out.append((*row, None, None, None, None))
            yield _frame(out)
        yield _frame(rest())

    decoded = pieces.mapInPandas(decode, schema)
    # Both outcomes are read from one written pass.
    decoded = store(decoded, "warc")
    names = [c.split()[0] for c in RECORD.split(", ")]

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        joiner, out = _Joiner(payload, begun=True), []
        for _, row in group.sort_values("start").iterrows():
            for piece in row["loose"] if row["loose"] is not None else []:
                if (found := joiner.add(bytes(piece))) is not None:
                    out.append((*found, None, None, None, None))
            if row["pending"]:
                if joiner.pending and joiner.sure:
                    raise ValueError(f"a record of {row['file']} is cut off")
                joiner.pending = b""
                joiner.add(bytes(row["pending"]))
        if joiner.pending and joiner.sure:
            raise ValueError(f"the last record of {group['file'].iloc[0]} is cut off")
        return _frame(out)

    # Only members that a chance magic cuts at the end of a range come here.
    cut = decoded.where("file IS NOT NULL").groupBy("file").applyInPandas(joined, schema)
    return decoded.where("file IS NULL").select(*names).unionByName(cut.select(*names))


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type",
                                        "refers_to", "payload", "file", "start", "loose", "pending"])
    whole = {c: "Int64" for c in ("page_id", "payload_bytes", "refers_to", "start")}
    return frame.astype(whole)


def archive(pages: DataFrame, folder: str | None = None, payload: bool = True) -> DataFrame:
    """Write the pages to a WARC folder (a new one in the scratch folder) and read it back."""
    spark = pages.sparkSession
    path = folder or new_folder(spark, "warc")
    write_warc(records(pages), path)
    return read_warc(spark, path, payload)


def digest_columns() -> list[Column]:
    return [F.col(c) for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")]
