"""Archives as streams: files cut at a size, records across reads, damage of every kind."""

import io

from siftmill.llm import warc
from siftmill.llm.shared import filesystem, new_path, read_file, write_file


def test_files_are_cut_and_read_back_whole(spark, monkeypatch):
    monkeypatch.setattr(warc, "INDEX_ROWS", 7)
    pages = spark.createDataFrame([(k, f"http://h/{k}", f"<p>{k}</p>" * (k % 5)) for k in range(100)], "page_id long, url string, html string").coalesce(1)
    folder = new_path(spark, "cut")
    index = warc.write_archive(pages, [folder], file_bytes=2_000).collect()
    files = sorted({r["file"] for r in index})
    assert len(files) > 5 and len(index) == 100
    for name in files:
        mine = sorted((r for r in index if r["file"] == name), key=lambda r: r["ordinal"])
        assert [r["ordinal"] for r in mine] == list(range(len(mine)))
        data = read_file(f"{folder}/{name}")
        assert len(data) < 4_000 and sum(r["length"] for r in mine) == len(data)
        for r in mine:
            (one,) = warc.parse(io.BytesIO(data[r["offset"] : r["offset"] + r["length"]]))
            assert one["Page-ID"] == str(r["page_id"]) and one["intact"]
    back = warc.read_archive(spark, folder, files).collect()
    assert {(r["page_id"], r["html"]) for r in back} == {(k, f"<p>{k}</p>" * (k % 5)) for k in range(100)}


def test_records_across_reads_and_very_long_ones(monkeypatch):
    data = [warc.record(1, "u", "x" * 5), warc.record(2, "v", "long " * 400_000), warc.record(None, None, None)]
    for chunk in (1, 13, 1 << 20):
        monkeypatch.setattr(warc, "CHUNK", chunk)
        got = list(warc.parse(io.BytesIO(b"".join(data))))
        assert [len(r["body"]) for r in got] == [5, 2_000_000, 0] and all(r["intact"] for r in got)


def test_missing_and_cut_off_files_are_found(spark):
    pages = spark.createDataFrame([(k, f"u{k}", f"<p>{k}</p>") for k in range(60)], "page_id long, url string, html string").coalesce(1)
    base = new_path(spark, "lost")
    folders = [f"{base}/a", f"{base}/b"]
    index = warc.write_archive(pages, folders, file_bytes=4_000)
    files = sorted(r["file"] for r in index.select("file").distinct().collect())
    fs, path = filesystem(f"{folders[1]}/{files[0]}")
    fs.delete_file(path)
    fs, path = filesystem(f"{folders[1]}/{files[1]}")
    half = read_file(f"{folders[1]}/{files[1]}")[:1_500]
    fs.delete_file(path)
    write_file(f"{folders[1]}/{files[1]}", half)
    bad = {(r["file"], r["ordinal"]) for r in warc.damaged(*(warc.trees(index, f) for f in folders)).collect()}
    want = {(r["file"], r["ordinal"]) for r in index.collect() if r["file"] == files[0] or r["file"] == files[1] and r["offset"] + r["length"] > 1_500}
    assert bad == want


def test_a_block_that_fails_leaves_no_file(spark):
    from siftmill.llm.shared import writing

    folder = new_path(spark, "fails")
    try:
        with writing(f"{folder}/x") as out:
            out.write(b"half")
            raise KeyError
    except KeyError:
        pass
    fs, path = filesystem(folder)
    import pyarrow.fs as pafs

    assert fs.get_file_info(pafs.FileSelector(path)) == []
