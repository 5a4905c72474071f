"""zstandard archives: round trips, several partitions of one file, foreign files without a seek table."""

import pyarrow.fs as pafs
import pytest
import zstandard
from pyspark.sql import functions as F

from evalloom.sources import readers as rd
from evalloom.sources import writers as wr
from evalloom.sources import zstd_lines as zl

FOLDER = "/root/testdata/sf0.01"


def lines_of(spark, path, **options):
    zl.register(spark)
    return spark.read.format("zstd_lines").options(**options).load(str(path))


def test_round_trip(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").repartition(3)
    folder = wr.write_zstd_archive(docs, "text", ["doc_id"], str(tmp_path / "a"), frame_bytes=1 << 16)
    assert len(list((tmp_path / "a").glob("*.zst"))) == 3 and not [f for f in (tmp_path / "a").iterdir() if f.suffix != ".zst"]
    back = rd.read_zstd_archive(spark, folder, split_bytes=1 << 16)
    assert back.rdd.getNumPartitions() > 6
    want = {r.doc_id: r.text for r in docs.collect()}
    assert {int(r.meta["doc_id"]): r.text for r in back.collect()} == want
    wr.write_zstd_archive(docs.limit(1), "text", ["doc_id"], folder)
    assert rd.read_zstd_archive(spark, folder).count() == len(want) + 1


def test_every_frame_in_one_partition(tmp_path, spark):
    rows = spark.range(20_000).select(F.concat(F.lit("line "), "id").alias("value")).coalesce(1)
    zl.register(spark)
    rows.write.format("zstd_lines").mode("append").option("frame_bytes", 5000).save(str(tmp_path / "b"))
    file = next((tmp_path / "b").glob("*.zst"))
    with pafs.LocalFileSystem().open_input_file(str(file)) as source:
        size = file.stat().st_size
        listed, walked = zl.seek_table(source, size), zl.walked_frames(source, size)
        parts = list(zl.stretches(str(file), source, size, 1500))
    assert listed == walked and len(listed) > 20 and len(parts) > 5
    assert [p.start for p in parts[1:]] == [p.stop for p in parts[:-1]] and parts[-1].stop == listed[-1][1]
    assert zstandard.ZstdDecompressor().stream_reader(file.read_bytes(), read_across_frames=True).read().count(b"\n") == 20_000


@pytest.mark.parametrize("split", [10, 3000, 1 << 20])
def test_foreign_files(spark, tmp_path, split):
    """Frames that end inside lines, a single frame, an empty file, a skippable frame, no line feed at the end."""
    text = "".join(f"row {i} é\r\n" if i % 7 else f"row {i}\n" for i in range(3000))[:-1].encode()
    squeeze = zstandard.ZstdCompressor(level=1)
    cut = [text[i : i + 1777] for i in range(0, len(text), 1777)]
    skip = (0x184D2A53).to_bytes(4, "little") + (5).to_bytes(4, "little") + b"12345"
    (tmp_path / "frames.zst").write_bytes(skip.join(squeeze.compress(c) for c in cut))
    (tmp_path / "one.zst").write_bytes(squeeze.compress(text))
    (tmp_path / "lines.zst").write_bytes(b"".join(squeeze.compress(b"own frame\n") for _ in range(50)))
    (tmp_path / "empty.zst").write_bytes(b"")
    (tmp_path / "note.txt").write_bytes(b"not read")
    got = sorted(r.value for r in lines_of(spark, tmp_path, split_bytes=split).collect())
    want = [x.removesuffix("\r") for x in text.decode().split("\n")]
    assert got == sorted(want * 2 + ["own frame"] * 50)


def test_odd_inputs(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert lines_of(spark, tmp_path / "none").count() == 0
    (tmp_path / "bad.zst").write_bytes(b"no frame here, but long enough")
    with pytest.raises(Exception, match="zstandard frame"):
        lines_of(spark, tmp_path / "bad.zst", split_bytes=4).collect()
    long = spark.createDataFrame([("x" * 3_000_000,), (None,), ("",)], "value string")
    long.write.format("zstd_lines").mode("append").save(str(tmp_path / "long"))
    assert sorted(len(r.value) for r in lines_of(spark, tmp_path / "long").collect()) == [0, 3_000_000]


def test_archive_lines_parse_once(spark):
    line = [
        '{"text":"a","meta":{"x":1,"n":{"y":[1,2]}}}', '{"text":["a","b"],"meta":null}', '"bare"', '{"text":5}', "bad",
        '{"text":"[not a list]"}', '{"text":[1,null,"x"]}', '  {"text":"lead"}', None, '{"meta":{}}',
    ]
    df = spark.createDataFrame([(x,) for x in line], "value string")
    parsed = df.select(rd.parse_archive_line(F.col("value")).alias("d"))
    assert parsed._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1
    got = [(r.d.text, r.d.meta) for r in parsed.collect()]
    assert got == [
        ("a", {"x": "1", "n": '{"y":[1,2]}'}), ("a\n\nb", {}), ("bare", {}), ("5", {}), (None, {}), ("[not a list]", {}), ("1\n\nx", {}),
        ("lead", {}), (None, {}), (None, {}),
    ]
