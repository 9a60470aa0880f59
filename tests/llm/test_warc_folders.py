"""Archives in more than a thousand folders are all read."""

from __future__ import annotations

from evirank.llm import warc


def test_more_than_a_thousand_folders(spark, tmp_path):
    member = warc.gzip_member(warc.record("response", 1, "http://x/", b"body", None), 6)
    paths = []
    for i in range(1003):
        (tmp_path / str(i)).mkdir()
        (tmp_path / str(i) / f"a{i}.warc.gz").write_bytes(member)
        paths.append((f"file:{tmp_path}/{i}/a{i}.warc.gz",))
    got = warc.read_archives(spark, spark.createDataFrame(paths, "path string"))
    assert got.where("kind = 'record'").count() == 1003


def test_hostile_headers_and_equal_names(spark, tmp_path):
    plain = warc.gzip_member(warc.record("response", 1, "http://x/", b"body", None), 6)
    raw = warc.record("response", 12, "http://x/", b"body", None)
    odd = [raw.replace(b"X-Page-ID: 12", b"X-Page-ID: " + x) for x in (b"--5", "\u00b2".encode(), b"9" * 40)]
    assert all(x != raw for x in odd)
    for name, data in (("a", plain), ("b", plain), ("c", b"".join(warc.gzip_member(x, 6) for x in odd))):
        (tmp_path / name).mkdir()
        (tmp_path / name / "same.warc.gz").write_bytes(data)
    (tmp_path / "b" / "other.warc.gz").write_bytes(plain)
    asked = [(f"file:{tmp_path}/a/same.warc.gz",), (f"{tmp_path}/b/other.warc.gz",), (f"file://{tmp_path}/c/same.warc.gz",), (None,)]
    got = warc.read_archives(spark, spark.createDataFrame(asked, "path string")).collect()
    assert [r.path.rsplit("/", 2)[1:] for r in got if r.page_id == 1] in ([["a", "same.warc.gz"], ["b", "other.warc.gz"]], [["b", "other.warc.gz"], ["a", "same.warc.gz"]])
    assert len(got) == 5 and sum(r.kind == "record" and r.page_id is None for r in got) == 3
