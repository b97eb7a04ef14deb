"""Round trips of the sources and sinks, joins that must raise, and incremental runs."""

from __future__ import annotations

import hashlib
import json
import os
import re
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from mentionweave import settings
from mentionweave.operators import joins, sets
from mentionweave.sources import html, model, release, runlog, tables, workbook
from mentionweave.streaming import incremental


def test_csv(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "2834.csv").write_text('name,cik\nNA,12.0\n"x, ""y""",\n')
    df = tables.with_stem(spark.read.option("header", True).csv(str(tmp_path / "a")))
    assert {r.sic_file for r in df.collect()} == {"2834"}
    raw = tables.read_csv(spark, str(tmp_path / "a"), ["name", "CIK", "extra"])
    assert [tuple(r) for r in raw.orderBy("name").collect()] == [("NA", "12.0", ""), ('x, "y"', "", "")]
    assert tables.read_csv(spark, str(tmp_path / "a"), ["name"], na=True).where("name is null").count() == 1


def test_csv_files_with_drifting_headers(spark, tmp_path):
    (tmp_path / "1.csv").write_text("name,cik\nA,1\n")
    (tmp_path / "2.csv").write_text("cik,name,extra\n2,B,x\n")
    (tmp_path / "3.csv").write_text("Name\nC\n")
    (tmp_path / "4.csv").write_text("")
    got = tables.read_csv(spark, str(tmp_path), ["name", "cik", "extra"], stem="sic_file")
    assert sorted(tuple(r) for r in got.collect()) == [("A", "1", "", "1"), ("B", "2", "x", "2"), ("C", "", "", "3")]
    with pytest.raises(Exception, match="(?i)header"):
        tables.read_csv(spark, [str(tmp_path / "1.csv"), str(tmp_path / "2.csv")], ["name", "cik"], one_header=True).collect()
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "5.csv").write_text('name,cik\n"a\nb",7\n')
    assert [tuple(r) for r in tables.read_csv(spark, str(tmp_path / "lines"), ["name", "cik"], multiline=True).collect()] == [("a\nb", "7")]


def test_headers_take_a_constant_number_of_jobs(spark, tmp_path):
    """One scan however many files there are, and only the first lines of long ones."""
    names = ["name,cik", "cik,name", '"a, b",name']
    long = "x,y\n" * 400_000
    for k in range(120):
        (tmp_path / f"{k}.csv").write_text(names[k % 3] + "\n" + (long if k == 0 else f"p{k},q{k}\n"))

    def jobs(files):
        group = f"headers-{files}"
        spark.sparkContext.setJobGroup(group, group)
        found = tables.headers(spark, [str(tmp_path / f"{k}.csv") for k in range(files)]).collect()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return found, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    few, many = jobs(3), jobs(120)
    assert few[1] <= 3 and many[1] <= 3  # the listing of many paths, the scan, and the grouping
    assert {tuple(r.header): len(r.paths) for r in many[0]} == {("name", "cik"): 40, ("cik", "name"): 40, ("a, b", "name"): 40}
    got = tables.read_csv(spark, str(tmp_path), ["name", "cik"])
    assert got.where("name = 'p1' and cik = 'q1' or name = 'q1' and cik = 'p1'").count() == 1 and got.count() == 400_119
    (tmp_path / "odd").mkdir()
    (tmp_path / "odd" / "a.csv").write_text("name,,NAME\r\n1,2,3\r\n")
    spark_names = spark.read.option("header", True).csv(str(tmp_path / "odd")).columns
    assert list(tables._distinct(["name", "", "NAME"])) == spark_names


class Busy(Exception):
    def __init__(self, code):
        super().__init__(f"status {code}")
        self.code = code


@pytest.mark.parametrize("tasks", [1, 8])
def test_fetch_keeps_the_rate_of_all_tasks(spark, tmp_path, tasks):
    folder = str(tmp_path)

    def client(u):
        with open(f"{folder}/{u}", "a") as calls:  # every call, when it began
            calls.write(f"{time.time()}\n")
        times = len(open(f"{folder}/{u}").readlines())
        if u in ("busy", "down"):
            if u == "down" or times == 1:
                raise Busy(503)
        if u == "gone":
            raise Busy(404)
        if u == "broken":
            raise ValueError("no status")
        return u.encode()

    links = spark.createDataFrame([(f"u{k}",) for k in range(26)] + [("busy",), ("down",), ("gone",), ("broken",), ("u0",)], "url string")
    got = {r.url: r for r in model.fetch(links, "url", client, tasks=tasks, again=0.2).collect()}
    calls = {p.name: [float(x) for x in p.read_text().split()] for p in tmp_path.iterdir()}
    began = sorted(x for v in calls.values() for x in v)
    assert len(began) == 32 and max(sum(a <= b < a + 1 for b in began) for a in began) <= 10
    assert {u: len(v) for u, v in calls.items() if len(v) > 1} == {"busy": 2, "down": 2}  # only what was busy is tried again, and once
    assert bytes(got["busy"].content) == b"busy" and got["down"].status == 503 and got["gone"].status == 404 and got["broken"].error == "ValueError: no status" and got["broken"].status is None
    assert len(got) == 30 and all(got[f"u{k}"].error is None for k in range(26))


def test_slots_of_all_tasks_never_meet():
    for late in (0.0, 0.01, 0.3):
        begun = []
        for task in range(5):
            now, slept = [100.0 + task / 7], []

            def sleep(x, now=now, late=late, slept=slept):
                slept.append(x)
                now[0] += x + late * (len(slept) % 3 == 0)

            slots = model.Slots(10, task, 5, clock=lambda now=now: now[0], sleep=sleep)
            for _ in range(40):
                slots.wait()
                begun.append((int(now[0] // slots.length), now[0]))
                now[0] += 0.02
        assert len({s for s, _ in begun}) == len(begun) and all(s % 5 == k // 40 for k, (s, _) in enumerate(begun))


def test_append_cap_and_settings(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    for _ in range(2):
        tables.append(df, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    tables.write_parts(df, str(tmp_path / "parts"), "v", writers=4)
    tables.write_parts(df, str(tmp_path / "parts"), "v", append=True)
    assert spark.read.parquet(str(tmp_path / "parts")).count() == 4
    assert [r.k for r in tables.capped(df, 1, "k").collect()] == [1] and tables.capped(df, 0, "k").count() == 2
    (tmp_path / "c.yaml").write_text("llm:\n  model: 'small' # which\n  batch-size: 50\n# max_records: 3\nother: x\n")
    got = settings.settings(spark, str(tmp_path / "c.yaml"), ["--max-records", "7", "--overwrite"])
    assert (got.model, got.batch_size, got.max_records, got.overwrite) == ("small", 50, 7, True)
    (tmp_path / "w.txt").write_text("rival\n\n# no\ncompete\nrival\n")
    assert settings.words(spark, str(tmp_path / "w.txt"), ["x"]) == ("rival", "compete") and settings.words(spark, "", ["x"]) == ("x",)


def test_documents_and_manifest(spark, tmp_path):
    (tmp_path / "2834").mkdir()
    (tmp_path / "2834" / "CIK1_10-K_20011231.txt").write_text("line 1\nline 2")
    got = tables.read_documents(spark, str(tmp_path / "*")).collect()
    assert [tuple(r) for r in got] == [("CIK1_10-K_20011231.txt", "2834", "line 1\nline 2")]
    assert [r["bytes"] for r in tables.manifest(spark, str(tmp_path)).collect()] == [13]


def test_filings_pads_short_arrays(spark):
    doc = json.dumps({"filings": {"recent": {"form": ["10-K", "8-K", "20-F"], "filingDate": ["a", "b", "c"], "reportDate": ["r"], "accessionNumber": ["1", "2", "3"], "primaryDocument": ["x", "y", "z"]}, "files": []}})
    got = tables.filings(spark.createDataFrame([(7, doc)], "cik int, value string"))
    assert [tuple(r) for r in got.orderBy("form").collect()] == [(7, "10-K", "a", "r", "1", "x"), (7, "20-F", "c", None, "3", "z")]


def test_filings_of_further_files(spark):
    arrays = {"form": ["10-K"], "filingDate": ["d"], "reportDate": ["r"], "accessionNumber": ["0-1-2"], "primaryDocument": ["x.htm"]}
    docs = spark.createDataFrame([(7, json.dumps({"filings": {"recent": arrays, "files": [{"name": "more.json"}]}})), (8, "no json")], "cik int, value string")
    assert [tuple(r) for r in tables.older_files(docs).collect()] == [(7, "more.json")]
    older = spark.createDataFrame([(7, json.dumps(arrays | {"form": ["20-F"]}))], "cik int, value string")
    got = tables.links(tables.filings(docs, older=older), "https://host/data")
    assert sorted((r.form, r.href) for r in got.collect()) == [("10-K", "https://host/data/7/012/x.htm"), ("20-F", "https://host/data/7/012/x.htm")]


def test_workbooks(spark, tmp_path):
    odd = ["a", "", None, " two\nlines\t", "<&>\"'", "_x0041_", "\u0001\u000b", "=1+1", "é日😀", "x" * 32_767, "1.50", "nan"]
    df = spark.createDataFrame([(k, v, k / 4, k % 2 == 0, None) for k, v in enumerate(odd)], "k long, v string, x double, flag boolean, none string").repartition(3, "k")
    path = str(tmp_path / "b.xlsx")
    wide = spark.createDataFrame([(1 << 60, "y")], "k long, `Ünï name` string")
    workbook.write_excel({"one": df.orderBy("k"), "two & <3>": wide}, path, review=("manual_decision", "reviewer_notes"))
    got = workbook.read_excel(spark, path, ["one"])
    assert got.columns == ["k", "v", "x", "flag", "none", "manual_decision", "reviewer_notes", "sheet"]
    shown = [(str(k), v or "", str(k // 4) if k % 4 == 0 else repr(k / 4), str(k % 2 == 0), "", "", "", "one") for k, v in enumerate(odd)]
    assert [tuple(r) for r in got.collect()] == shown  # in the order in which they were written
    both = workbook.read_excel(spark, path)
    assert both.columns == ["k", "v", "x", "flag", "none", "manual_decision", "reviewer_notes", "Ünï name", "sheet"] and both.count() == 13
    assert both.where("sheet = 'two & <3>'").first()["k"] == str(1 << 60)
    with zipfile.ZipFile(path) as book:
        sheet = book.read("xl/worksheets/sheet1.xml").decode()
    assert 'state="frozen"' in sheet and '<autoFilter ref="A1:G13"/>' in sheet
    assert re.findall(r'width="(\d+)"', sheet) == ["10", "60", "10", "10", "10", "17", "16"]  # at least 8 and at most 58, and 2
    assert [p.name for p in tmp_path.iterdir()] == ["b.xlsx"]
    with pytest.raises(Exception, match="over 1 rows"):
        workbook.write_excel({"one": df}, str(tmp_path / "c.xlsx"), 1)
    with pytest.raises(Exception, match="32768 characters"):
        workbook.write_excel({"one": df.select(F.lit("x" * 32_768).alias("v"))}, str(tmp_path / "c.xlsx"))
    with pytest.raises(Exception, match="no sheet 'three'"):
        workbook.read_excel(spark, path, ["three"])
    with pytest.raises(Exception, match="already"):
        wide.write.format("workbook").mode("append").option("sheet", "one").save(path)
    assert [p.name for p in tmp_path.iterdir()] == ["b.xlsx"]  # a failed write leaves nothing


def test_workbook_of_many_rows_in_ranges(spark, tmp_path):
    path = str(tmp_path / "m.xlsx")
    workbook.write_excel({"rows": spark.range(25_000, numPartitions=7).selectExpr("id", "concat('name ', id) as name")}, path)
    reader = spark.read.format("workbook").option("rowsPerPartition", 4000)
    got = reader.load(path)
    assert got.rdd.getNumPartitions() == 7
    assert got.agg(F.count("*"), F.count_distinct("id"), F.sum(F.col("id").cast("long"))).first()[:] == (25_000, 25_000, 25_000 * 24_999 // 2)
    assert got.where("name <> concat('name ', id)").count() == 0


def test_workbook_of_another_program(spark, tmp_path):
    """Shared strings with runs, references with gaps, booleans, errors and formulas, as other programs write them."""
    main, office = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    sheet = (
        '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c><c r="D1" t="s"><v>0</v></c></row><row r="2"/><row r="4"><c r="A4"><v>12</v></c><c r="C4" t="b"><v>1</v></c><c r="D4" t="e"><v>#N/A</v></c></row>'
        '<row r="9"><c r="B9"><v>0.1</v></c><c r="C9" t="str"><f>A1</f><v>said</v></c><c r="AB9"><v>7</v></c></row>'
    )
    parts = workbook._frame(["S"]) | {
        "xl/sharedStrings.xml": f'<sst xmlns="{main}"><si><t>id</t></si><si><r><t>no</t></r><r><t>te</t></r><rPh sb="0" eb="1"><t>x</t></rPh></si></sst>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}" xmlns:r="{office}"><sheetData>{sheet}</sheetData></worksheet>',
    }
    with zipfile.ZipFile(tmp_path / "o.xlsx", "w") as book:
        for name, text in parts.items():
            book.writestr(name, text)
    got = workbook.read_excel(spark, f"file:{tmp_path}/o.xlsx")
    assert got.columns == ["id0", "_c1", "note", "id3", "sheet"]
    assert [tuple(r) for r in got.collect()] == [("12", "", "True", "", "S"), ("", "0.1", "said", "", "S")]
    with pytest.raises(Exception, match="another program"):
        got.write.format("workbook").mode("append").option("sheet", "T").save(str(tmp_path / "o.xlsx"))


def test_parts_todo_errors(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, "b", "bad"), (3, "a", None)], "k int, sic string, error string")
    good, bad = tables.split_errors(df)
    tables.write_parts(good, str(tmp_path / "out"), "sic")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2 and bad.count() == 1
    assert [r.k for r in tables.todo(df, good, "k").collect()] == [2]
    assert {(r.sic, r.n_rows) for r in tables.part_index(df, "sic").collect()} == {("a", 2), ("b", 1)}


def test_html():
    page = "<html><head><title>t</title><style>p{}</style><script>var t='</p>';</script></head><body><p>A &amp; <b>B</b><br>C<!-- no --></p><a href='/x'>link</a><table><tr><td>1</td></tr></table>"
    assert html.to_text(page) == "A & B\nC\nlink\n1"
    assert html.to_text(page, markdown=True) == "A & **B**\nC\n[link](/x)\n| 1 |\n| --- |"
    assert html.to_text(None) is None and html.to_text("") == ""


MARKDOWN = {
    "<table><thead><tr><th>a<th colspan=2>b|c</thead><tr><td rowspan=2>x<td>1<td><b>2</b><tr><td>3</table>": "| a | b\\|c |  |\n| --- | --- | --- |\n| x | 1 | **2** |\n|  | 3 |  |",
    "<table><caption>C</caption><tr><td>1<br>2</td><td><table><tr><td>in</td></tr></table></td></tr></table>": "C\n| 1 2 | in |\n| --- | --- |",
    "<table><tr><td> </td></tr></table><table></table>x": "x",
    "<table><tr><td colspan='0' rowspan='x'>a</td><td colspan='99999999999'>b</td></tr></table>": "| a | b |" + "  |" * 998 + "\n|" + " --- |" * 1000,
    "<ul><li>a<ul><li>b<ol start=3><li>c<li>d</ol></ul><li>e</ul>": "* a\n  * b\n    3. c\n    4. d\n* e",
    "<p>x <img src=a alt=b>y <a href='/u'><i>z</i></a> <a>w</a><p>v": "x y [_z_](/u) w\nv",
    "<h2> H <b>i</b></h2><blockquote><p>q</p><ul><li>r</ul></blockquote><hr><pre>\n a\n  b</pre>": "## H **i**\n> q\n> * r\n* * *\n```\n a\n  b\n```",
    "</p></table>a</b><script>no</script><!-- no -->&lt;b": "a<b",
    "<div>" * 5000 + "deep" + "</div>" * 5000: "deep",
    "": "", " \n ": "",
}


@pytest.mark.parametrize("page", MARKDOWN)
def test_markdown(page):
    assert html.to_text(page, markdown=True) == MARKDOWN[page]


def test_run_record_of_a_batch_run(spark, tmp_path):
    log = runlog.RunLog(spark, str(tmp_path / "log"), "first")
    rows = spark.createDataFrame([(k, "bad" if k % 5 == 0 else None) for k in range(100)], "k long, error string")

    def work(part, stage):
        if part == "c":
            raise ValueError("no such part")
        stage.watch(rows.where(F.col("k") < ord(part) - 90), "error").write.parquet(str(tmp_path / part))

    assert log.each("extract", ["a", "b", "c", "d"], work, go_on=True) == ["c"]
    with pytest.raises(ValueError, match="no such"):
        log.each("strict", ["c", "a"], work)
    with runlog.RunLog(spark, str(tmp_path / "log"), "second").stage("two tables") as stage:
        for _ in range(2):
            stage.watch(rows).write.format("noop").mode("overwrite").save()
    with log.stage("nothing watched"):
        pass
    got = {(r.run, r.stage, r.part): r for r in log.read().collect()}
    seen = [got["first", "extract", p] for p in "abcd"]
    assert [(r.rows, r.errors, r.done, r.total) for r in seen] == [(7, 2, 1, 4), (8, 2, 2, 4), (None, None, 3, 4), (10, 2, 4, 4)]
    assert seen[2].failure == "ValueError: no such part" and seen[3].failure is None and all(r.seconds >= 0 for r in seen)
    assert seen[3].remaining_seconds == 0 and 0 < seen[0].remaining_seconds and seen[0].remaining_seconds >= 2.9 * seen[0].seconds
    assert ("first", "strict", "c") in got and ("first", "strict", "a") not in got
    assert got["second", "two tables", ""].rows == 200 and got["second", "two tables", ""].errors == 0 and got["first", "nothing watched", ""].rows is None


def test_run_record_of_an_incremental_run(spark, tmp_path):
    source, target, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    log = runlog.RunLog(spark, str(tmp_path / "log"))
    for part in range(3):
        spark.createDataFrame([(part, k, "bad" if k == 0 else None) for k in range(4)], "p long, k long, error string").coalesce(1).write.mode("append").parquet(source)
    with log.follow("merge"):
        stream = log.observed(incremental.watch(spark, source, "p long, k long, error string", files_per_batch=1), "error")
        incremental.upserts(stream, target, mark, ["p", "k"], [F.col("error")]).awaitTermination()
    got = sorted((r.part, r.rows, r.errors) for r in log.read().collect())
    assert got == [(f"batch {k}", 4, 1) for k in range(3)] and incremental.read(spark, target).count() == 12

    def fails(batch):
        raise RuntimeError("this batch fails")

    spark.createDataFrame([(9, 9, None)], "p long, k long, error string").coalesce(1).write.mode("append").parquet(source)
    with log.follow("failing"), pytest.raises(Exception, match="this batch fails"):
        incremental.upserts(incremental.watch(spark, source, "p long, k long, error string"), target, mark, ["p", "k"], [F.col("error")], fails).awaitTermination()
    assert "this batch fails" in log.read().where("stage = 'failing' and part = 'end'").first().failure


def test_release(spark, tmp_path):
    source, target = tmp_path / "results", str(tmp_path / "release")
    for name, body in {"a.csv": b"x,y\n1,2\n", "deep/b c.bin": bytes(range(256)) * 9000, "empty": b"", "\u00fcn.txt": b"u"}.items():
        (source / name).parent.mkdir(parents=True, exist_ok=True)
        (source / name).write_bytes(body)
    files = release.sections({"03_outcomes": str(source), "04_by_sic": str(source / "deep")})
    got = {r.release_path: r for r in release.publish(spark, files, target).collect()}
    assert set(got) == {"03_outcomes/a.csv", "03_outcomes/deep/b c.bin", "03_outcomes/empty", "03_outcomes/\u00fcn.txt", "04_by_sic/b c.bin"}
    assert all(r.sha256 == hashlib.sha256(open(files[p], "rb").read()).hexdigest() and r.bytes == os.path.getsize(files[p]) and r.section == p.split("/")[0] for p, r in got.items())
    assert release.broken(spark, target).count() == 0
    assert release.archive(spark, target, str(tmp_path / "r.zip")) == 5
    with zipfile.ZipFile(tmp_path / "r.zip") as book:
        assert book.testzip() is None and {n: book.read(n) for n in book.namelist()} == {p: open(s, "rb").read() for p, s in files.items()}
        assert book.namelist() == sorted(book.namelist())

    # a broken copy is found, keeps the archive from being made, and is mended by the next run, which leaves the other copies alone
    untouched = os.stat(f"{target}/03_outcomes/a.csv").st_ino
    with open(f"{target}/04_by_sic/b c.bin", "r+b") as out:
        out.write(b"?")
    os.remove(f"{target}/03_outcomes/empty")
    assert {tuple(r) for r in release.broken(spark, target).collect()} == {("04_by_sic/b c.bin", "different"), ("03_outcomes/empty", "missing")}
    before = (tmp_path / "r.zip").read_bytes()
    with pytest.raises(Exception, match="empty|manifest says"):
        release.archive(spark, target, str(tmp_path / "r.zip"))
    assert (tmp_path / "r.zip").read_bytes() == before and not list(tmp_path.glob("r.zip.parts*"))
    (source / "a2.csv").write_bytes(b"new")
    os.remove(source / "\u00fcn.txt")
    release.publish(spark, release.sections({"03_outcomes": str(source), "04_by_sic": str(source / "deep")}), target)
    assert release.broken(spark, target).count() == 0 and release.manifest(spark, target).count() == 5
    assert os.stat(f"{target}/03_outcomes/a.csv").st_ino == untouched and not os.path.exists(f"{target}/03_outcomes/\u00fcn.txt")

    # a run that fails leaves the release as its manifest says
    with pytest.raises(Exception, match="absent"):
        release.publish(spark, {"03_outcomes/x": str(source / "absent")}, target)
    assert release.manifest(spark, target).count() == 5
    with pytest.raises(ValueError, match="no path"):
        release.publish(spark, {"../x": str(source / "a.csv")}, target)
    assert release.archive(spark, str(tmp_path / "nothing"), str(tmp_path / "none.zip")) == 0 and zipfile.ZipFile(tmp_path / "none.zip").namelist() == []


def test_model_steps(spark):
    def client(x):
        if "boom" in x:
            raise ValueError("boom")
        return ["B Inc", "A Co"]

    df = spark.createDataFrame([(1, "x"), (1, "y"), (2, "boom")], "k int, body string")
    got = {r.k: (r.competitors, r.error) for r in model.extract_names(df, "k", "body", client).collect()}
    assert got == {1: ("A Co|B Inc", None), 2: ("", "ValueError: boom")}
    first = spark.createDataFrame([(1, "unclear"), (2, "drop")], "k int, d string")
    second = spark.createDataFrame([(1, "accept")], "k int, d string")
    assert {(r.k, r.d) for r in model.overlay(first, second, "k", ["d"]).collect()} == {(1, "accept"), (2, "drop")}
    links = spark.createDataFrame([("u1",), ("u2",)], "url string")
    got = model.fetch(links, "url", lambda u: u.encode(), done=links.where("url = 'u1'"), tasks=1)
    assert [(r.url, bytes(r.content)) for r in got.collect()] == [("u2", b"u2")]


def test_many_to_one_raises(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    right = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    assert joins.many_to_one(left, right.where("v = 'a'"), ["k"]).count() == 2
    with pytest.raises(Exception, match="twice"):
        joins.many_to_one(left, right, ["k"]).collect()


def test_schema_helpers(spark):
    df = spark.createDataFrame([(1,)], "Conm int")
    assert sets.resolve(df, ["name", "CONM"]) == "Conm" and sets.resolve(df, ["x"], required=False) is None
    with pytest.raises(ValueError, match="none of"):
        sets.resolve(df, ["x"])
    assert sets.ensure_columns(df, ["Conm", "y"]).columns == ["Conm", "y"]


def test_incremental_upserts(spark, tmp_path):
    source, target, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").coalesce(1).write.parquet(source)
    run = lambda: incremental.upserts(incremental.watch(spark, source, "k int, v string"), target, mark, ["k"], [F.col("v")]).awaitTermination()
    run()
    spark.createDataFrame([(2, "new"), (3, "c")], "k int, v string").coalesce(1).write.mode("append").parquet(source)
    run()
    assert {(r.k, r.v) for r in incremental.read(spark, target).collect()} == {(1, "a"), (2, "new"), (3, "c")}
    spark.createDataFrame([(3, "newer"), (3, "newest")], "k int, v string").coalesce(1).write.mode("append").parquet(source)
    run()
    assert {(r.k, r.v) for r in incremental.read(spark, target).collect()} == {(1, "a"), (2, "new"), (3, "newer")}
    assert {(r.k, r.v) for r in incremental.read(spark, target, before=2).collect()} == {(1, "a"), (2, "new"), (3, "c")}
    assert incremental.read(spark, str(tmp_path / "nothing")) is None


def test_running_counts(spark, tmp_path):
    schema = "at timestamp, key string"
    spark.createDataFrame([(1, "a"), (2, "a"), (4000, "b")], "s long, key string").select(F.timestamp_seconds("s").alias("at"), "key").write.parquet(str(tmp_path / "in"))
    stream = incremental.running_counts(incremental.watch(spark, str(tmp_path / "in"), schema), "at", "key")
    stream.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert {(r.key, r.n) for r in spark.table("counts").collect()} == {("a", 2), ("b", 1)}
