import base64
import gzip
import hashlib
import pathlib
import uuid

import pytest
from llm_rows import table

from seqloom.llm import warc
from seqloom.llm.queries import QUERIES


def digest(body):
    return base64.b32encode(hashlib.sha1(body).digest()).decode()


def expected(rows, least=0):
    first = {}
    for i, _, html in rows:
        body = (html or "").encode()
        if len(body) >= least:
            order = (i is None, i or 0)
            first[body] = min(first.get(body, order), order)
    out, used = [], set()
    for i, _, html in rows:
        body = (html or "").encode()
        own = (i is None, i or 0)
        response = body not in first or first[body] == own and body not in used
        if body in first and first[body] == own:
            used.add(body)
        target = None if response or first[body][0] else first[body][1]
        out.append((i, len(body), digest(body), "response" if response else "revisit", target))
    return sorted(out, key=str)


def archived(spark, tmp_path, rows, **options):
    frame = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, record_type string")
    path = f"file://{tmp_path}/{uuid.uuid4().hex}"
    warc.write_archive(frame.repartition(3), path, **options)
    return path, warc.read_archive(spark, path)


COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


@pytest.mark.parametrize("least", [0, 3])
def test_odd_pages_round_trip(spark, tmp_path, least):
    rows = [(1, "http://a/é?q=1\r\nX: y", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""),
            (2, "again", "<p>é</p>"), (5, "u", "x\r\n\r\nWARC/1.1\r\n"), (None, "n", "<p>é</p>"), (None, "n", "only"),
            (7, "u", "ab"), (8, "u", "ab"), (-9, "neg", "ab"), (6, "long", "y" * 300_000), (1 << 60, "far", "z")]
    _, got = archived(spark, tmp_path, rows, least=least, shard_bytes=1000, file_bytes=500)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got.collect()), key=str) == expected(rows, least)
    bodies = {(r[2] or "").encode() for r in rows}
    for r in got.where("record_type = 'response'").collect():
        assert bytes(r["payload"]) in bodies and digest(bytes(r["payload"])) == r["payload_digest"]


def test_files_are_equal_and_gzip_reads_them(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<html>{i % 40}{'pq' * 30}</html>") for i in range(200)]
    seen = []
    for _ in range(2):
        path, got = archived(spark, tmp_path, rows, shard_bytes=20_000, file_bytes=4_000)
        assert got.count() == 200
        folder = path.removeprefix("file://")
        names = sorted(r["file"] for r in spark.read.parquet(f"{path}/manifest").select("file").distinct().collect())
        assert len(names) > 3
        seen.append([(n, hashlib.sha1(open(f"{folder}/{n}", "rb").read()).hexdigest()) for n in names])
        text = b"".join(gzip.decompress(open(f"{folder}/{n}", "rb").read()) for n in names)
        assert text.count(b"WARC/1.1\r\n") == 200
        ids = [x.split(b"\r\n")[0] for x in text.split(b"WARC-Page-ID: ")[1:]]
        assert ids == [str(i).encode() for i in range(200)]
        urns = {x.split(b"\r\n")[0] for x in text.split(b"WARC-Record-ID: ")[1:]}
        assert {x.split(b"\r\n")[0] for x in text.split(b"WARC-Refers-To: ")[1:]} <= urns
    assert seen[0] == seen[1]


def test_a_changed_archive_is_refused(spark, tmp_path):
    raw = gzip.decompress(warc.encode_record(1, 0, "u", b"body", None))
    assert warc.decode_record(raw)["payload"] == b"body"
    with pytest.raises(ValueError):
        warc.decode_record(raw.replace(b"body", b"bodY"))


def test_no_pages(spark, tmp_path):
    assert archived(spark, tmp_path, [])[1].count() == 0


def folder_files(path):
    folder = path.removeprefix("file://")
    return {p.name: gzip.decompress(p.read_bytes()) for p in sorted(pathlib.Path(folder).glob("*.warc.gz"))}


def shards_of(files):
    return {name.split("-")[1] for name in files}


@pytest.mark.parametrize("page_id", [None, 7])
def test_one_id_fills_several_shards(spark, tmp_path, page_id):
    rows = [(page_id, f"u{i}", f"<p>{i % 90}</p>") for i in range(300)] + [(i, "u", "<p>5</p>") for i in range(9)]
    path, got = archived(spark, tmp_path, rows, shard_bytes=10_000)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got.collect()), key=str) == expected(rows)
    files = folder_files(path)
    assert len(shards_of(files)) > 10 and max(len(x) for x in files.values()) < 30_000


@pytest.mark.parametrize("least", [0, 30])
def test_equal_rows_fill_several_shards(spark, tmp_path, least):
    rows = [(7, "u", "<p>same</p>")] * 400 + [(None, "n", "<p>none</p>")] * 300 + [(3, "u", "<p>same</p>"), (9, "v", None)]
    seen = []
    for spread in (1, 5):
        frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(spread)
        path = f"file://{tmp_path}/{uuid.uuid4().hex}"
        warc.write_archive(frame, path, least=least, shard_bytes=20_000, file_bytes=2_000)
        got = warc.read_archive(spark, path)
        assert sorted((tuple(r[c] for c in COLUMNS) for r in got.collect()), key=str) == expected(rows, least)
        files = folder_files(path)
        assert len(shards_of(files)) > 10
        seen.append(files)
        text = b"".join(files.values())
        ids = [x.split(b"\r\n")[0] for x in text.split(b"WARC-Record-ID: ")[1:]]
        assert len(set(ids)) == len(ids) == len(rows)
        assert {x.split(b"\r\n")[0] for x in text.split(b"WARC-Refers-To: ")[1:]} <= set(ids)
    assert seen[0] == seen[1]


def test_files_roll_inside_a_shard(spark, tmp_path):
    rows = [(i, "u", uuid.uuid5(uuid.NAMESPACE_URL, str(i)).hex * 40) for i in range(200)]
    path, got = archived(spark, tmp_path, rows, shard_bytes=1 << 20, file_bytes=8_000)
    files = folder_files(path)
    assert len(shards_of(files)) == 1 and len(files) > 4 and got.count() == 200


def test_groups_of_equal_rows_are_cut_where_shards_end(spark):
    rows = [(0, i, f"{i:040x}", "u", 100) for i in range(50)] + [(0, 1 << 62, "f" * 40, "u", 900)] * 40
    facts = spark.createDataFrame(rows, "absent int, place long, digest string, url string, bytes long")
    facts = facts.selectExpr("*", "cast(conv(substring(digest, 1, 15), 16, 10) as long) d", "xxhash64(url) u")
    groups = warc.shard_groups(facts, 0, 5000)
    pieces = sorted((r["shard"], r["low"], r["high"]) for r in warc.hot_pieces(groups, 5000).collect())
    assert pieces[0][1] == 0 and pieces[-1][2] == 40 and len(pieces) > 2
    assert all(a[2] == b[1] for a, b in zip(pieces, pieces[1:], strict=False))
    bounds = [r["key"] for r in warc.shard_bounds(groups, 5000).orderBy("shard").collect()]
    assert bounds == sorted(bounds) and len(set(bounds)) == len(bounds)


def test_query_covers_all_pages(spark):
    pages = table(spark, "pages").toPandas()
    got = QUERIES["op10_warc"](spark, "/root/testdata/sf0.001").toPandas()
    assert sorted(got.page_id) == sorted(pages.page_id)
