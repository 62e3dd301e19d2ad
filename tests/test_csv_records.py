"""CSV uploads against an own record parser, and files that used to break the intake."""

import random

import pytest

from pressgrid.sources import csv_records, files


def parse(text):
    """(records, None) or (None, fault): one character at a time."""
    records, record, cell, state = [], [], [], "start"
    quoted_first = False
    for ch in text + "\n":
        if state == "quoted":
            if ch == '"':
                state = "closing"
            else:
                cell.append(ch)
        elif state == "closing" and ch == '"':
            cell.append(ch)
            state = "quoted"
        elif ch in "\r\n":
            if record or state != "start" and (quoted_first or "".join(cell).strip(" \t")):
                records.append([*record, "".join(cell)])
            record, cell, state, quoted_first = [], [], "start", False
        elif ch == ",":
            record.append("".join(cell))
            cell, state = [], "start"
        elif state == "start" and ch == '"':
            state = "quoted"
            quoted_first |= not record
        else:
            cell.append(ch)
            state = "plain"
    if state == "quoted":
        return None, csv_records.OPEN_QUOTE
    return records, None


def expected(text):
    records, fault = parse(text)
    if fault:
        return set(), fault
    if not records:
        return set(), files.ERR_EMPTY_CSV
    widest = max(map(len, records))
    if widest > len(records[0]):
        return set(), f"{csv_records.ERR_CSV}expected {len(records[0])} cells in a record, saw {widest}"
    for column in range(widest):
        urls = {r[column] for r in records if column < len(r)}
        urls = {u for u in urls if u.strip().startswith(("http://", "https://")) and len(u.strip()) >= 10}
        if urls:
            return urls, None
    return set(), files.ERR_NO_URLS


def taken(spark, texts):
    rows = [(f"f{i}.csv", len(t.encode()), bytearray(t.encode())) for i, t in enumerate(texts)]
    urls, outcome = files.intake(spark.createDataFrame(rows, "path string, length long, content binary"))
    by = {f"f{i}.csv": set() for i in range(len(texts))}
    for r in urls.collect():
        by[r.path].add(r.url)
    errors = {r.path: r.error for r in outcome.collect()}
    return [(by[f"f{i}.csv"], errors[f"f{i}.csv"]) for i in range(len(texts))]


def test_random_files_equal_own_parser(spark):
    r = random.Random(11)
    parts = ['"', '""', ",", ",,", "\n", "\r\n", "\n\n", "a", " ", "\t", "https://a.com/1", "http://b.org/2",
             '"https://c.net/3,x"', '"say ""hi"""', "x y", "https://", 'q"u', "é"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(0, 14))) for _ in range(700)]
    # Records of one width, so that more than refusals are compared.
    cells = ["https://a.com/1", '"http://b.org/\n2"', "x", "", '"q""https://n.com/9"', '"https://d.io/""4"""', "NA"]
    for _ in range(200):
        width = r.randrange(1, 5)
        texts.append("\n".join(",".join(r.choice(cells) for _ in range(width)) for _ in range(r.randrange(1, 6))))
    texts = [t for t in texts if t]
    got = taken(spark, texts)
    for t, g in zip(texts, got):
        # Blanks before the first cell of a record are dropped.
        want = expected(t)
        g, want = [({u.lstrip(" \t") for u in x[0]}, x[1]) for x in (g, want)]
        assert g == want, repr(t)


def test_blanks_before_the_first_cell(spark):
    assert taken(spark, [" \thttps://a.com/1, https://b.com/2\n", "x, https://b.com/2\n", '" https://c.com/3"\n']) == [
        ({"https://a.com/1"}, None), ({" https://b.com/2"}, None), ({" https://c.com/3"}, None)]


def test_four_outcomes_in_one_folder(spark, tmp_path):
    d = tmp_path / "up"
    d.mkdir()
    limit = files.MAX_UPLOAD_BYTES
    (d / "commas.csv").write_text("," * limit)
    (d / "open.csv").write_text('a,"https://never.com/closed\nb,c\n' + "x" * 1000)
    (d / "bytes.csv").write_bytes(b"a,https://x.com/\xff\xfe\n")
    (d / "wide.csv").write_text("a\nb,https://x.com/1\n")
    (d / "line.csv").write_text(",".join(["x"] * 2000 + ["https://far.com/1"]) + "\n")
    (d / "quotes.csv").write_text('"' + '""' * 1_000_000 + '",https://q.com/1\n')
    (d / "good.csv").write_text('﻿https://bom.com/1,"two\nlines"\nhttps://good.com/2,x\n')
    (d / "blank.csv").write_text("\n \n\t\n")
    (d / "huge.csv").write_text("x" * (limit + 1))
    urls, outcome = files.read_uploads(spark, str(d))
    got = {r.path.rsplit("/", 1)[1]: r.error for r in outcome.collect()}
    assert got == {
        "commas.csv": files.ERR_NO_URLS, "open.csv": csv_records.OPEN_QUOTE, "bytes.csv": csv_records.NOT_UTF8,
        "wide.csv": "Error reading CSV: expected 1 cells in a record, saw 2", "line.csv": None, "quotes.csv": None,
        "good.csv": None, "blank.csv": files.ERR_EMPTY_CSV, "huge.csv": files.ERR_TOO_LARGE.format(mb=10)}
    assert {r.url for r in urls.collect()} == {"https://far.com/1", "https://q.com/1", "https://bom.com/1",
                                               "https://good.com/2"}


@pytest.mark.parametrize("text", ["a," * 300_000, "\n" * 3_000_000, ",\n" * 300_000, 'a\n"' * 100_001])
def test_dense_files_end(spark, text):
    assert taken(spark, [text]) == [expected(text)]


def test_one_scan_of_the_folder(spark, tmp_path):
    (tmp_path / "a.csv").write_text("https://a.com/1\n")
    urls, outcome = files.read_uploads(spark, str(tmp_path))
    for df, most in ((outcome, 3), (urls, 4)):
        plan = df._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("FileScan") <= most and "binaryFile" not in plan
