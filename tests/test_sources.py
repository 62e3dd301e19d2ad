"""SRC1, SRC3-SRC9, SRC12-SRC13, SNK1, J5 with files in a pytest temp folder."""

import hashlib

from pyspark.sql import functions as F

from pressgrid.sources import files


def test_read_url_lines_and_missing(spark, tmp_path):
    p = tmp_path / "links.txt"
    p.write_text("  https://a.com/1 \n\n\thttps://b.com/2\n   \n")
    got = [r.url for r in files.read_url_lines(spark, str(p)).orderBy("pos").collect()]
    assert got == ["https://a.com/1", "https://b.com/2"]
    assert files.read_url_lines(spark, str(tmp_path / "nope.txt")).count() == 0


def test_uploads_intake(spark, tmp_path):
    d = tmp_path / "up"
    d.mkdir()
    (d / "a.txt").write_text("https://a.com/1, https://a.com/2\nnot a url\n")
    (d / "b.txt").write_bytes("https://b.com/caf\xe9\n".encode("latin-1"))
    (d / "a0.csv").write_text("only\n")
    (d / "c.csv").write_text("name,link\nx, https://c.com/1\ny,https://c.com/2\n")
    (d / "w.csv").write_text("a,b,c,d,https://w.com/5\n")
    (d / "d.csv").write_text("")
    (d / "e.txt").write_text("nothing here")
    (d / "f.txt").write_text("https://a.com/1, https://a.com/2\nnot a url\n")  # same bytes as a.txt
    (d / "big.txt").write_text("https://x.com/" + "y" * 2000)
    (d / "skip.md").write_text("https://ignored.com/")
    ledger = spark.createDataFrame([(hashlib.md5((d / "f.txt").read_bytes()).hexdigest(),)], "md5 string")
    urls, outcome = files.read_uploads(spark, str(d), max_bytes=1024, ledger=ledger)
    res = {r.path.rsplit("/", 1)[1]: (r.n_urls, r.error) for r in outcome.collect()}
    assert res["b.txt"] == (1, None)
    assert res["c.csv"] == (2, None)
    assert res["w.csv"] == (1, None) and res["a0.csv"] == (0, files.ERR_NO_URLS)
    assert "d.csv" not in res  # zero-byte files yield no split, so no row (documented)
    assert res["e.txt"] == (0, files.ERR_NO_URLS)
    assert res["a.txt"][1] == files.ERR_SEEN and res["f.txt"][1] == files.ERR_SEEN
    assert res["big.txt"][1] == "File too large. Maximum size: 0MB"
    assert "skip.md" not in res
    got = sorted(r.url for r in urls.collect())
    assert got == [" https://c.com/1", "https://b.com/café", "https://c.com/2", "https://w.com/5"]


def test_result_csv_roundtrip_with_bom_and_newlines(spark, tmp_path):
    cols = [f.name for f in files.RESULT_SCHEMA.fields]
    rows = [("https://a.com", "T, \"q\"", "", "S", "2025-01-01", "2025-01-01", "page-rules", "success", "",
             "line1\nline2\n" * 50), ("https://b.com", "", "", "", "", "", "N/A", "error_scraping", "boom", "")]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols))
    out = str(tmp_path / "csv")
    files.write_result_csv(df.coalesce(1), out)
    part = [p for p in (tmp_path / "csv").iterdir() if p.name.endswith(".csv")][0]
    raw = part.read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfurl,title,")
    back = files.read_result_csv(spark, out)
    assert back.columns == cols
    got = sorted((r.url, r.title, r.article_text or "") for r in back.collect())
    assert got == [("https://a.com", "T, \"q\"", "line1\nline2\n" * 50), ("https://b.com", None, "")]
    again = files.read_result_csv(spark, out, replace_header=True)
    assert again.count() == 2


def test_scan_corpus_rules(spark, tmp_path):
    root = tmp_path / "proj"
    (root / "src").mkdir(parents=True)
    (root / "node_modules" / "x").mkdir(parents=True)
    (root / "src" / "main.py").write_text("print(1)\r\nprint(2)\n")
    (root / "src" / "Links.csv").write_text("a\nb\nc\nd\ne\n")
    (root / "temp.txt").write_text("only\ntwo")
    (root / "node_modules" / "x" / "y.js").write_text("no")
    (root / "bin.dat").write_bytes(b"ok\xff\xfeok")
    got = {r.path: r.content for r in files.scan_corpus(spark, str(root)).collect()}
    assert got == {"src/main.py": "print(1)\nprint(2)\n", "src/Links.csv": "a\nb\nc\n",
                   "temp.txt": "only\ntwo", "bin.dat": "okok"}


def test_path_filter_and_head_lines(spark):
    df = spark.createDataFrame([("a/.hidden/x",), ("__pycache__/m.pyc",), ("src/ok.py",), (".env",)], "p string")
    got = [r[0] for r in df.select(files.path_is_ignored("p")).collect()]
    assert got == [True, True, False, True]
    t = spark.createDataFrame([("1\n2\n3\n4",), ("1\n2",), ("",)], "t string")
    assert [r[0] for r in t.select(files.head_lines("t")).collect()] == ["1\n2\n3\n", "1\n2", ""]


def test_decode_and_page_text(spark):
    rows = [(bytearray("café".encode("utf-8")),), (bytearray("café".encode("latin-1")),),
            (bytearray(b"\xef\xbb\xbf" + "é".encode("utf-8")),),
            (bytearray('<meta charset="iso-8859-1">é'.encode("latin-1")),)]
    df = spark.createDataFrame(rows, "b binary")
    assert [r[0] for r in df.select(files.decode_text("b")).collect()][:2] == ["café", "café"]
    assert [r[0] for r in df.select(files.page_text("b")).collect()] == \
        ["café", "café", "é", '<meta charset="iso-8859-1">é']


def test_bucketed_page_store_avoids_page_shuffle(spark, tmp_path):
    from pressgrid.plans import pipeline
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pages = spark.createDataFrame([(i, f"https://p.com/{i}", f"<p>page {i}</p>") for i in range(40)],
                                      "page_id long, url string, html string")
        files.write_page_store(pages, "page_store_test", 4)
        store = spark.table("page_store_test")
        wanted = spark.createDataFrame([(f"https://p.com/{i}",) for i in range(0, 40, 3)], "url string")
        plan = store.join(wanted, "url", "left_semi")._jdf.queryExecution().executedPlan().toString()
        # Only the URL list is shuffled to the store's buckets.
        assert plan.count("Exchange hashpartitioning") == 1, plan
        assert store.join(wanted, "url", "left_semi").count() == 14
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS page_store_test")


def test_append_lines(spark, tmp_path):
    out = str(tmp_path / "endpoints")
    df = spark.createDataFrame([("1.2.3.4:80",), ("5.6.7.8:3128",)], "e string")
    files.append_lines(df, "e", out)
    files.append_lines(df.limit(1), "e", out)
    assert sorted(r.value for r in spark.read.text(out).collect()) == ["1.2.3.4:80", "1.2.3.4:80", "5.6.7.8:3128"]


def test_progress_metrics(spark):
    from pressgrid.operators.enrich import with_progress
    df = spark.createDataFrame([("success",), ("success_url_parser",), ("error_scraping",), ("success",)],
                               "status string")
    observed, obs = with_progress(df)
    observed.write.format("noop").mode("overwrite").save()
    assert obs.get == {"completed": 4, "successful": 2, "failed": 1}


def test_upload_csv_as_people_write_them(spark, tmp_path):
    d = tmp_path / "up loads"
    d.mkdir()
    (d / "a b.csv").write_text('note,"line one\nsays ""hi"" https://fake.com/in-note",https://real.com/1\n')
    (d / "wide+1.csv").write_text(",".join(["x"] * 70 + ["https://far.com/71"]) + "\n")
    urls, outcome = files.read_uploads(spark, str(d))
    assert sorted(r.url for r in urls.collect()) == ["https://far.com/71", "https://real.com/1"]
    assert {r.path.rsplit("/", 1)[1]: r.error for r in outcome.collect()} == {"a b.csv": None, "wide+1.csv": None}


def test_replaced_header_keeps_further_cells(spark, tmp_path):
    p = tmp_path / "old.csv"
    p.write_text(",".join(f"h{i}" for i in range(12)) + "\n" + ",".join(["https://a.com"] + [""] * 9 + ["kept", "too"]) + "\n")
    row = files.read_result_csv(spark, str(p), replace_header=True).first()
    assert (row.url, row.title, row["_c10"], row["_c11"]) == ("https://a.com", None, "kept", "too")


def test_page_charsets(spark):
    rows = [(bytearray(b"\x93quoted\x94 \x80"),), (bytearray("Größe — 日本".encode("utf-16")),),
            (bytearray(b" " * 5000 + b"<meta charset=windows-1252>" + b"\x96\xe9"),)]
    got = [r[0] for r in spark.createDataFrame(rows, "b binary").select(files.page_text("b")).collect()]
    assert got[:2] == ["“quoted” €", "Größe — 日本"] and got[2].endswith("–é")


def test_declared_charsets_round_trip(spark):
    texts = {"windows-1251": "Привет, мир — «да»", "koi8-r": "Привет", "iso-8859-2": "Zażółć gęślą jaźń", "iso-8859-15": "10 € Œuvre",
             "ISO-8859-7": "Γειά σου", "macintosh": "café “x”", "windows-1256": "مرحبا", "cp866": "Привет",
             "Shift_JIS": "日本語テスト①", "EUC-JP": "日本語", "iso-2022-jp": "日本語", "gbk": "中文编码€", "gb2312": "中文", "big5": "中文編碼",
             "euc-kr": "한국어", "iso-8859-9": "ğüşıöç", "utf-8": "naïve 日本", "made-up": "plain é"}
    codecs = {"windows-1251": "cp1251", "Shift_JIS": "cp932", "gbk": "gb18030", "euc-kr": "cp949", "made-up": "utf-8",
              "macintosh": "mac_roman", "windows-1256": "cp1256"}
    rows = [(f'<html><meta charset="{k}"><p>{t}', k, (f'<html><meta charset="{k}"><p>{t}').encode(codecs.get(k, k))) for k, t in texts.items()]
    rows += [("<html>Größe 日本", "le", "<html>Größe 日本".encode("utf-16-le")), ("<html>Größe 日本", "be", "<html>Größe 日本".encode("utf-16-be")),
             ('<?xml version="1.0" encoding="koi8-r"?>мир', "xml", '<?xml version="1.0" encoding="koi8-r"?>мир'.encode("koi8-r")),
             ("\x81 <meta charset=windows-1252>\x8d", "undefined", b"\x81 <meta charset=windows-1252>\x8d"), (None, "null", None)]
    df = spark.createDataFrame([(a, b, None if c is None else bytearray(c)) for a, b, c in rows], "want string, k string, b binary")
    got = {r.k: (r.t, r.want) for r in df.select("k", "want", files.page_text("b").alias("t")).collect()}
    assert {k: v for k, v in got.items() if v[0] != v[1]} == {}
