"""Deterministic sharded WARC archives, written and read on the executors.

Records are in the order of page_id, then of hashes of payload and url. Running sums of
bytes over groups of equal rows part that order into shards of about ``SHARD_BYTES`` of
payload, so the bounds depend on the rows alone, and rows that share an id, or miss one,
are spread over as many shards as they fill. Groups of equal rows that alone fill a shard
travel as one row and a count, and are cut at copies of known number. One task sorts
and writes a shard: each record is a gzip member of its own, with headers and
SHA-1 digests made anew, and a file is closed once it has ``FILE_BYTES`` of
compressed bytes, less than a shard's. Both are parameters; larger archives want larger
shards, since each is a task and a row of 40 bytes among the bounds. Files are written under a temporary name that carries the attempt;
only the manifest of the attempt that Spark accepted is used to rename them, so
a task that ran twice leaves nothing behind that a reader sees. Running the same
rows again gives the same bytes in the same files.

Of records with equal payloads of at least ``least`` bytes the one with the smallest
page_id is a response; the others are revisits that point to it and carry no
payload. The reader takes segments of files from the manifest, checks every
digest, and returns what the records say.

Defined results: null html is an empty payload, a null url an empty one; a null
page_id comes after all others; of rows with equal payloads and the smallest id that
with the smallest url is the response, of equal rows the first; a very long page is a
shard of its own; an empty table gives an archive without files and an empty
result. Other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import running_sums
from ..session import scratch_path, shuffle_width
from .common import prepare, written

SHARD_BYTES = 64 << 20
FILE_BYTES = 8 << 20
SEGMENT_BYTES = 4 << 20
#: About what the headers of a record take.
RECORD_BYTES = 400
#: A fixed date keeps archives of the same rows equal.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str, number: int = 0, url: str = "") -> str:
    """A URN from the page's id and payload; number 0 is the response that others revisit.

    Other records add their url and their number among equal rows.
    """
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page/{page_id}/{digest}/{number}/{url}')}>"


def _header(lines: list[tuple[str, str]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n").encode()


def encode_record(page_id, number: int, url: str, payload: bytes, refers: tuple | None,
                  revisited: tuple[int, str] | None = None) -> bytes:
    """One gzip member. ``refers`` holds the page_id of the response a revisit points to.

    A revisit that travels without its payload has the payload's length and digest in
    ``revisited``.
    """
    length, digest = revisited or (len(payload), sha1_base32(payload))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n"
    block = http.encode() + (b"" if refers else payload)
    lines = [
        ("WARC-Type", "revisit" if refers else "response"),
        ("WARC-Record-ID", record_id(page_id, digest, number, url if number else "")),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _one_line(url)),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"),
        ("WARC-Page-ID", "" if page_id is None else str(page_id)),
    ]
    if refers:
        lines += [
            ("WARC-Profile", PROFILE),
            ("WARC-Refers-To", record_id(refers[0], digest)),
            ("WARC-Refers-To-Page-ID", "" if refers[0] is None else str(refers[0])),
        ]
    lines.append(("Content-Length", str(len(block))))
    return gzip.compress(_header(lines) + block + b"\r\n\r\n", 6, mtime=0)


def _one_line(url: str) -> str:
    return "".join(c if c.isprintable() else "%" + c.encode().hex().upper() for c in url)


def decode_record(raw: bytes) -> dict:
    """Headers, and what they say of the payload; wrong digests raise."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {version[:40]!r}")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record does not end where its length says")
    if f"sha1:{sha1_base32(block)}" != fields["WARC-Block-Digest"]:
        raise ValueError(f"block digest of {fields['WARC-Record-ID']} is wrong")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(http.decode().rpartition("Content-Length: ")[2])
    kind = fields["WARC-Type"]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != length or sha1_base32(payload) != digest):
        raise ValueError(f"payload digest of {fields['WARC-Record-ID']} is wrong")
    return {
        "page_id": _number(fields["WARC-Page-ID"]),
        "payload_bytes": length,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": _number(fields.get("WARC-Refers-To-Page-ID", "")),
        "url": fields["WARC-Target-URI"],
        "payload": payload if kind == "response" else None,
    }


def _number(text: str) -> int | None:
    return int(text) if text else None


#: The order of records: ids, those without one last, then payloads and urls by hashes.
ORDER = ["absent", "place", "d", "u"]
#: What rows must share to be equal in all that is written.
SAME = ["absent", "place", "digest", "url"]


def _keyed(pages: DataFrame) -> DataFrame:
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col("page_id").isNull().cast("int").alias("absent"),
        F.coalesce(F.col("page_id").cast("long"), F.lit(0)).alias("place"),
        F.sha1(body).alias("digest"),
        F.coalesce(F.col("url"), F.lit("")).alias("url"),
        body.alias("body"),
    )
    leading = F.conv(F.substring("digest", 1, 15), 16, 10).cast("long")
    return rows.withColumns({"d": leading, "u": F.xxhash64("url")})


def shard_groups(facts: DataFrame, least: int, shard_bytes: int) -> DataFrame:
    """One row per group of equal rows: where it lies among all bytes and what it points to.

    ``facts`` has ORDER, digest, url and bytes. ``hot`` groups of equal rows hold more than
    a shard, so there are at most as many as shards; a copy after the first takes ``step``
    bytes of them. ``lead`` is true for the group that holds the response of its payload,
    false for others with that payload, null if the payload is met once.
    """
    groups = facts.groupBy(*ORDER, "digest", "url").agg(F.first("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"))
    whole = F.col("n") * (F.col("bytes") + RECORD_BYTES)
    groups = groups.withColumns(
        {
            "hot": (F.col("n") > 1) & (whole > shard_bytes),
            "step": F.lit(RECORD_BYTES) + F.when(F.col("bytes") < least, F.col("bytes")).otherwise(0),
        }
    )
    held = F.when(F.col("hot"), F.col("bytes") + F.col("n") * F.col("step")).otherwise(whole)
    groups = groups.withColumns({"held": held, "one": F.lit(1), "order": F.struct(*ORDER, "digest", "url")})
    placed = running_sums(groups, ["one"], "order", ["held"]).withColumn("before", F.col("cum_held") - F.col("held"))
    placed = written(placed.drop("one", "order", "cum_held", "total_held"), "groups")
    payloads = placed.where(F.col("bytes") >= least).groupBy("digest").agg(
        F.min(F.struct("absent", "place", "url")).alias("first"), F.sum("n").alias("met")
    )
    marked = placed.join(payloads.where("met > 1").drop("met"), "digest", "left")
    lead = F.struct("absent", "place", "url") == F.col("first")
    return written(marked.withColumns({"lead": lead, "to": F.struct("first.absent", "first.place")}).drop("first"), "marked")


def hot_pieces(groups: DataFrame, shard_bytes: int) -> DataFrame:
    """Hot groups cut at shard bounds: copies ``low`` to ``high`` (excluded) lie in ``shard``."""
    hot = groups.where("hot")
    last = F.col("before") + F.col("held") - 1
    cut = hot.withColumn("shard", F.explode(F.sequence(_shard(F.col("before"), shard_bytes), _shard(last, shard_bytes))))

    def copies(shard: Column) -> Column:
        ahead = shard * shard_bytes - F.col("before") - F.col("bytes")
        return F.least(F.greatest(F.ceil(ahead / F.col("step")), F.lit(0)), F.col("n"))

    shard = F.col("shard")
    low = F.when(shard == _shard(F.col("before"), shard_bytes), 0).otherwise(copies(shard))
    high = F.when(shard == _shard(last, shard_bytes), F.col("n")).otherwise(copies(shard + 1))
    return cut.withColumns({"low": low, "high": high}).where("low < high")


def _shard(byte: Column, shard_bytes: int) -> Column:
    return F.floor(byte / shard_bytes).cast("long")


def shard_bounds(groups: DataFrame, shard_bytes: int) -> DataFrame:
    """shard and its first key (ORDER, number of the copy), one row per shard in use."""
    plain = groups.where("NOT hot").select(
        _shard(F.col("before"), shard_bytes).alias("shard"), F.struct(*ORDER, F.lit(0).cast("long").alias("number")).alias("key")
    )
    cut = hot_pieces(groups, shard_bytes).select("shard", F.struct(*ORDER, F.col("low").cast("long").alias("number")).alias("key"))
    return plain.unionByName(cut).groupBy("shard").agg(F.min("key").alias("key"))


def write_archive(pages: DataFrame, path: str, least: int = 0, shard_bytes: int = SHARD_BYTES,
                  file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the archive under ``path`` and return its committed manifest.

    ``pages`` has page_id, url and html. The manifest has a row per segment: file,
    offset, length and records; a reader needs nothing else.
    """
    spark = pages.sparkSession
    prepare(spark)
    keyed = _keyed(pages)
    facts = keyed.select(*ORDER, "digest", "url", F.octet_length("body").cast("long").alias("bytes"))
    groups = shard_groups(written(facts, "payloads"), least, shard_bytes)
    bounds = written(shard_bounds(groups, shard_bytes), "bounds")
    n_shards = bounds.count()
    if n_shards == 0:
        spark.createDataFrame([], _COMMITTED).write.parquet(f"{path}/manifest")
        return spark.read.schema(_COMMITTED).parquet(f"{path}/manifest")
    first, none = F.lit(0).cast("long"), F.lit(None)
    about = [F.col("lead"), F.col("to.absent").alias("to_absent"), F.col("to.place").alias("to_place")]
    nothing = [none.cast("boolean").alias("lead"), none.cast("int").alias("to_absent"), none.cast("long").alias("to_place")]
    # What a payload points to goes ahead of its page: one sort brings the two together.
    notes = groups.where("NOT hot AND lead IS NOT NULL").select(
        *ORDER, first.alias("number"), F.lit(0).alias("kind"), "digest", "url", "bytes", none.cast("binary").alias("body"), *about
    )
    rows = keyed.select(
        *ORDER, first.alias("number"), F.lit(1).alias("kind"), "digest", "url",
        F.octet_length("body").cast("long").alias("bytes"), "body", *nothing,
    )
    hot = hot_pieces(groups, shard_bytes)
    if not groups.where("hot").isEmpty():
        # At most as many groups as shards. Their rows are equal: one body stands for all.
        some = F.broadcast(groups.where("hot").select(*SAME))
        bodies = keyed.join(some, SAME, "left_semi").groupBy(*SAME).agg(F.first("body").alias("body"))
        rows = rows.join(some, SAME, "left_anti").select(*rows.columns)
        carries = (F.col("low") == 0) | (F.col("bytes") < least)
        spread = (
            hot.join(bodies, SAME)
            .withColumn("body", F.when(carries, F.col("body")))
            .repartition(shuffle_width(spark), "shard", "digest")
            .withColumn("number", F.explode(F.sequence(F.col("low"), F.col("high") - 1)))
        )
        kept = F.when((F.col("number") == 0) | (F.col("bytes") < least), F.col("body"))
        notes = notes.unionByName(
            spread.select(*ORDER, "number", F.lit(2).alias("kind"), "digest", "url", "bytes", kept.alias("body"), *about)
        )
    both = _with_shard(rows.unionByName(notes), bounds, n_shards)
    ordered = both.repartitionById(n_shards, F.col("shard")).sortWithinPartitions(
        "shard", *ORDER, "digest", "url", "kind", "number"
    )
    manifest = written(ordered.mapInArrow(_writer(path, least, file_bytes), _MANIFEST), "manifest")
    # The accepted attempts' files get their names; renaming again changes nothing.
    renamed = manifest.select("temporary", "file").distinct().mapInArrow(_renamer(path), "file string")
    committed = manifest.join(renamed, "file").drop("temporary")
    committed.write.parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def _with_shard(rows: DataFrame, bounds: DataFrame, n_shards: int) -> DataFrame:
    """The place of the last bound that a row's key reaches, by halving.

    The bounds, one short row per shard, travel as the value of a scalar subquery.
    """
    ordered = F.sort_array(F.collect_list(F.struct("shard", "key")))
    table = bounds.agg(F.transform(ordered, lambda b: b["key"]).alias("keys")).scalar()
    key = F.struct(*ORDER, "number")
    rows = rows.withColumn("shard", F.lit(0))
    step = 1 << n_shards.bit_length()
    while step:
        ahead = F.col("shard") + F.lit(step)
        reached = F.coalesce(F.get(table, ahead) <= key, F.lit(False))
        rows = rows.withColumn("shard", F.when(reached, ahead).otherwise(F.col("shard")))
        step //= 2
    return rows


_COMMITTED = "file string, offset long, length long, records long"
_MANIFEST = "file string, temporary string, offset long, length long, records long"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _writer(path: str, least: int, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(path)
        context = TaskContext.get()
        attempt = f"{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        shard = out = None
        part = offset = start = records = 0
        done: list[tuple] = []
        group = note = None

        def name() -> str:
            return f"shard-{shard:06d}-{part:05d}.warc.gz"

        def temporary() -> str:
            return f"_temporary/{attempt}/{name()}"

        def end_segment() -> None:
            nonlocal start, records
            if records:
                done.append((name(), temporary(), start, offset - start, records))
            start, records = offset, 0

        def close() -> None:
            nonlocal out
            if out is not None:
                end_segment()
                out.close()
                out = None

        for batch in batches:
            for row in batch.to_pylist():
                if row["shard"] != shard:
                    close()
                    shard, part = row["shard"], 0
                now = (row["absent"], row["place"], row["digest"], row["url"])
                if now != group:
                    group, note, copy = now, None, 0
                if row["kind"] == 0:
                    note = row
                    continue
                if row["kind"] == 2:
                    note, copy = row if row["lead"] is not None else None, row["number"]
                page_id = None if row["absent"] else row["place"]
                refers = revisited = None
                if note is not None and (copy or not note["lead"]):
                    refers = (None if note["to_absent"] else note["to_place"],)
                if row["body"] is None:
                    revisited = row["bytes"], base64.b32encode(bytes.fromhex(row["digest"])).decode()
                # Payloads under ``least`` are all responses, which nothing points to.
                number = 1 + copy if refers or row["bytes"] < least else 0
                member = encode_record(page_id, number, row["url"], row["body"] or b"", refers, revisited)
                copy += 1
                if out is None:
                    store.create_dir(f"{root}/_temporary/{attempt}", recursive=True)
                    out = store.open_output_stream(f"{root}/{temporary()}", compression=None)
                    offset = start = 0
                out.write(member)
                offset += len(member)
                records += 1
                if offset - start >= SEGMENT_BYTES:
                    end_segment()
                if offset >= file_bytes:
                    close()
                    part += 1
        close()
        columns = list(zip(*done, strict=True)) or [[]] * 5
        types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
            ["file", "temporary", "offset", "length", "records"],
        )

    return run


def _renamer(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(path)
        for batch in batches:
            for row in batch.to_pylist():
                source, target = f"{root}/{row['temporary']}", f"{root}/{row['file']}"
                if store.get_file_info(source).type != fs.FileType.NotFound:
                    store.move(source, target)
                elif store.get_file_info(target).type == fs.FileType.NotFound:
                    raise FileNotFoundError(f"neither {source} nor {target}")
            yield batch.select(["file"])

    return run


_RECORD = (
    "page_id long, payload_bytes long, payload_digest string, record_type string, "
    "refers_to long, url string, payload binary"
)


def read_archive(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the files in the manifest, segment by segment."""
    prepare(spark)
    manifest = spark.read.parquet(f"{path}/manifest")
    names = [f.split()[0] for f in _RECORD.split(", ")]
    names = names if with_payload else names[:-1]
    schema = ", ".join(f for f in _RECORD.split(", ") if f.split()[0] in names)
    fields = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    kinds = [fields[f.split()[1]] for f in schema.split(", ")]

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(path)
        for batch in batches:
            for part in batch.to_pylist():
                with store.open_input_file(f"{root}/{part['file']}") as f:
                    data = f.read_at(part["length"], part["offset"])
                rows, found = [], 0
                while data:
                    member = zlib.decompressobj(31)
                    raw = member.decompress(data)
                    if not member.eof:
                        raise ValueError(f"{part['file']}: a record is cut off")
                    data = member.unused_data
                    rows.append(decode_record(raw))
                    found += 1
                    if len(rows) == 1000:
                        yield batch_of(rows)
                        rows = []
                if found != part["records"]:
                    raise ValueError(f"{part['file']}: {found} records, not {part['records']}")
                yield batch_of(rows)

    # A segment is a unit of work: deal them out evenly.
    segments = manifest.select("file", "offset", "length", "records")
    segments = segments.repartition(shuffle_width(spark), "file", "offset")
    return segments.mapInArrow(run, schema)


def archive_path(spark: SparkSession) -> str:
    return scratch_path(spark, "warc")
