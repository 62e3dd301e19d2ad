"""The command-line flows end to end on a small page table."""

import json

from pressgrid import cli


def test_process_flow_with_slice(spark, tmp_path, capsys):
    pages = spark.createDataFrame(
        [(1, "https://p.com/a", "<html><body><h1>Alpha story</h1><p>x</p></body></html>"),
         (2, "https://p.com/b", "<html><body><h1>Beta story</h1></body></html>")],
        "page_id long, url string, html string")
    pages.write.parquet(str(tmp_path / "pages"))
    (tmp_path / "urls.txt").write_text("https://p.com/a\n\nhttps://q.com/2025/01/02/some-blocked-story\n"
                                       "https://p.com/b\nbad\nhttps://p.com/zzz\n")
    (tmp_path / "blocked.txt").write_text("https://q.com/x\n")
    args = ["process", "--urls", str(tmp_path / "urls.txt"), "--pages", str(tmp_path / "pages"),
            "--blocked", str(tmp_path / "blocked.txt"), "--out", str(tmp_path / "out"), "--csv",
            "--begin", "0", "--end", "4"]
    cli.main(args)
    st = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert st == {"total": 4, "successful": 2, "failed": 2, "with_text": 3, "with_record": 3}
    rows = {r.url: r.status for r in spark.read.parquet(str(tmp_path / "out" / "parquet")).collect()}
    assert rows == {"https://p.com/a": "success", "https://q.com/2025/01/02/some-blocked-story": "success_url_parser",
                    "https://p.com/b": "success", "bad": "error_invalid_url"}
    assert (tmp_path / "out" / "csv").exists()


def test_intake_flow_caps_each_file_and_says_so(spark, tmp_path, capsys):
    spark.createDataFrame([(1, "https://p.com/0", "<h1>Zero</h1>")], "page_id long, url string, html string") \
        .write.parquet(str(tmp_path / "pages"))
    up = tmp_path / "up"
    up.mkdir()
    (up / "a.txt").write_text("\n".join(f"https://p.com/{i}" for i in range(15)))
    (up / "b.txt").write_text("\n".join(f"https://q.com/{i}" for i in range(15)))
    (up / "c.txt").write_text("\n".join(f"https://r.com/{i}" for i in range(25)))
    cli.main(["intake", "--uploads", str(up), "--pages", str(tmp_path / "pages"), "--out", str(tmp_path / "out")])
    st = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert (st["total"], st["successful"]) == (30, 1)
    told = {r.path.rsplit("/", 1)[1]: r.error for r in spark.read.parquet(str(tmp_path / "out" / "intake")).collect()}
    assert told == {"a.txt": None, "b.txt": None, "c.txt": "Too many URLs (25). Maximum allowed: 20"}


def test_enrich_flow_keeps_cells_as_they_were(spark, tmp_path, capsys):
    (tmp_path / "t.csv").write_text('url,source,published_date,modified_date,x\nhttps://a.com,AFP,,," padded "\n')
    cli.main(["enrich-afp", "--table", str(tmp_path / "t.csv"), "--out", str(tmp_path / "out")])
    text = "".join(p.read_text() for p in (tmp_path / "out").iterdir() if p.name.endswith(".csv"))
    assert " padded " in text and '""' not in text
