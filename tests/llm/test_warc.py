import hashlib
import io

import zstandard
from llm_helpers import rows

from ripplegraph.llm import warc as R

SCHEMA = "page_id long, url string, html string, digest string, original long"
BIG = "é" * 600  # 1200 bytes


def frame(spark, data):
    return spark.createDataFrame([(*r, "d", 1) for r in data], SCHEMA)


DATA = [(1, "http://a/b?c d\r\nX: y", BIG), (2, None, BIG), (3, "http://x", BIG), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""), (8, "u", "y" * 999), (9, "u", "y" * 999), (10, "u", "z" * 1000), (11, "u", "z" * 1000), (12, "u", "long " * 200_000), (13, "u", "WARC/1.1\r\n\r\n" * 100)]


def test_query_equals_sql(spark, write, sql):
    path = write(pages=frame(spark, DATA))
    got = R.op6_warc(spark, path)
    assert rows(got) == sql(R.ORACLE)
    by = {r["page_id"]: r for r in got.collect()}
    assert (by[1]["record_type"], by[1]["refers_to"], by[3]["record_type"]) == ("revisit", 3, "response")
    assert by[10]["refers_to"] == 11 and by[8]["record_type"] == by[4]["record_type"] == "response"
    assert by[1]["payload_digest"] == hashlib.sha1(BIG.encode()).hexdigest() and by[1]["payload_bytes"] == 1200


def test_nulls_and_repeats(spark, write):
    data = [(None, "u", BIG), (5, "u", BIG), (5, "u", BIG), (None, "u", "q" * 2000), (None, None, "q" * 2000)]
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in R.op6_warc(spark, write(pages=frame(spark, data))).collect()), key=str)
    assert got == sorted([(None, "revisit", 5), (5, "response", None), (5, "response", None), (None, "response", None), (None, "response", None)], key=str)
    assert R.op6_warc(spark, write(pages=frame(spark, []))).count() == 0


def test_frames_stand_alone_and_the_whole_is_plain_zstandard(spark, monkeypatch, tmp_path):
    w = R.BundleWriter()
    monkeypatch.setattr(R, "FRAME_BYTES", 5000)
    records = [R.make_record(i, f"http://h/{i}", bytes([65 + i]) * 1500, None) for i in range(20)]
    for i, r in enumerate(records):
        w.add(R.record_id(i), r)
    bundle, entries = w.finish()
    assert len({e["frame"] for e in entries}) > 3
    reader = R.BundleReader(bundle)
    for i in (19, 0, 7):
        e = entries[i]
        assert reader.record(e["frame"], e["offset"], e["length"]) == records[i]
        alone = zstandard.ZstdDecompressor().decompress(bundle[reader.starts[e["frame"]] : reader.starts[e["frame"] + 1]], max_output_size=1 << 20)
        assert alone[e["offset"] : e["offset"] + e["length"]] == records[i]
    with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(bundle), read_across_frames=True) as f:
        assert f.read() == b"".join(records)


def test_export(spark, tmp_path):
    bundles = R.write_bundles(frame(spark, DATA))
    (tmp_path / "out").mkdir()
    assert R.export_bundles(bundles, str(tmp_path / "out")) == bundles.count() == len(list((tmp_path / "out").glob("*.warc.zst")))
