"""Sources and sinks: dictionary files, upload gate, CSV/JSON export, audit append, catalog."""

import csv
import glob
import json
import os
import tempfile

from pyspark.sql import functions as F

from core_helpers import SF_SMALL
from jobledger.operators import contacts
from jobledger.plans.fixtures import Views
from jobledger.sources import dictionary, export, uploads
from jobledger.operators.integrity import ensure_table, existing_tables


def test_skill_lines(spark):
    d = tempfile.mkdtemp(prefix="jl-dict-")
    p = os.path.join(d, "skills.txt")
    with open(p, "w") as f:
        f.write("# comment\nNodeJS\n\n  Python  \nNode.js\nC\n   \nC++\n")
    got = {r.norm: r.name for r in dictionary.read_skill_lines(spark, p).collect()}
    assert got == {"nodejs": "Node.js", "python": "Python", "c": "C++"}


def test_skill_json(spark):
    d = tempfile.mkdtemp(prefix="jl-dictj-")
    p = os.path.join(d, "skills.json")
    with open(p, "w") as f:
        json.dump({"web": ["NodeJS", "React"], "lang": ["C", "Node.js", "C++"]}, f)
    got = {r.norm: r.name for r in dictionary.read_skill_json(spark, p).collect()}
    assert got == {"nodejs": "Node.js", "react": "React", "c": "C++"}


def test_upload_gate(spark):
    d = tempfile.mkdtemp(prefix="jl-up-")
    with open(os.path.join(d, "ok.pdf"), "wb") as f:
        f.write(b"%PDF-1.4 small")
    with open(os.path.join(d, "big.pdf"), "wb") as f:
        f.write(b"%PDF-" + b"0" * (5 * 1024 * 1024))
    with open(os.path.join(d, "fake.pdf"), "wb") as f:
        f.write(b"hello")
    with open(os.path.join(d, "notes.txt"), "wb") as f:
        f.write(b"%PDF-1.4")
    got = {os.path.basename(r.path): r.reject_code for r in uploads.upload_gate(spark, d).collect()}
    assert got == {"ok.pdf": None, "big.pdf": "FILE_TOO_LARGE", "fake.pdf": "INVALID_FILE_TYPE",
                   "notes.txt": "INVALID_FILE_TYPE"}


def test_contacts_export(spark):
    h = Views(spark, SF_SMALL).search_hits
    wide = contacts.contacts_wide(contacts.contact_links(h), h)
    out = tempfile.mkdtemp(prefix="jl-csv-") + "/out"
    export.export_contacts(wide, out, "csv")
    n = wide.count()
    export.export_contacts(wide, out + "-json", "json")
    back = spark.read.json(out + "-json")
    assert back.count() == n and dict(back.dtypes)[contacts.CSV_HEADERS[4]] == "array<string>"
    assert all(set(r) == set(contacts.CSV_HEADERS) for r in map(json.loads, open(glob.glob(f"{out}-json/*.json")[0])))
    rows = []
    for p in glob.glob(f"{out}/*.csv"):
        with open(p, newline="") as f:
            r = list(csv.reader(f))
            assert r[0] == list(contacts.CSV_HEADERS)
            rows += r[1:]
    assert len(rows) == n
    expected = {r.company: r.csv_line for r in wide.select("company", contacts.csv_line(wide).alias("csv_line")).collect()}
    for r in rows:
        line = expected[r[0]]
        assert next(csv.reader([line])) == r


def test_append_audit_and_catalog(spark):
    v = Views(spark, SF_SMALL)
    out = tempfile.mkdtemp(prefix="jl-audit-") + "/audit"
    rec = v.audit_log.withColumn("user_email", F.lit("x@y"))
    export.append_audit(rec, out, "b1")
    export.append_audit(rec, out, "b1")  # a retry
    back = spark.read.parquet(out)
    assert back.count() == v.audit_log.count() and "user_email" not in back.columns and "day" in back.columns
    loc = tempfile.mkdtemp(prefix="jl-tbl-") + "/jl_probe"
    ensure_table(spark, "jl_probe", "id BIGINT, name STRING", loc)
    ensure_table(spark, "jl_probe", "id BIGINT, name STRING", loc)
    assert existing_tables(spark, ["jl_probe", "nope"]) == ["jl_probe"]


def test_last_line_counts_in_path_order(spark, tmp_path):
    """The second file is larger, so it is planned first; its lines still count last."""
    from jobledger.sources.dictionary import read_skill_json, read_skill_lines
    lines = tmp_path / "lines"
    lines.mkdir()
    (lines / "a.txt").write_text("node.js\n# note\n\nC++\n")
    (lines / "b.txt").write_text("".join(f"filler {i}\n" for i in range(5000)) + "NodeJS\nNODE-JS\n")
    got = {r["norm"]: r["name"] for r in read_skill_lines(spark, str(lines)).collect()}
    assert got["nodejs"] == "NODE-JS" and got["c"] == "C++" and len(got) == 5002
    (lines / "c.txt").write_text("node js\n")
    assert {r["norm"]: r["name"] for r in read_skill_lines(spark, str(lines)).collect()}["nodejs"] == "node js"
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "1.json").write_text('{"x": ["Go", "go "],\n "y": ["GO!"]}')
    (docs / "0.json").write_text('{"z": ["g-o", "Rust"]}')
    assert {r["norm"]: r["name"] for r in read_skill_json(spark, str(docs)).collect()} == {"go": "GO!", "rust": "Rust"}


def test_upload_gate_lists_once_and_joins_nothing(spark, tmp_path):
    from jobledger.sources.uploads import MAX_UPLOAD_BYTES, upload_gate
    (tmp_path / "ok.PDF").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "named.pdf").write_bytes(b"text")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "big.pdf").write_bytes(b"%PDF-" + b"x" * MAX_UPLOAD_BYTES)
    (tmp_path / "edge.pdf").write_bytes(b"%PDF-" + b"x" * (MAX_UPLOAD_BYTES - 5))
    (tmp_path / "other.bin").write_bytes(b"%PDF-")
    df = upload_gate(spark, str(tmp_path))
    assert {r["path"].split("/")[-1]: r["reject_code"] for r in df.collect()} == {
        "ok.PDF": None, "named.pdf": "INVALID_FILE_TYPE", "big.pdf": "FILE_TOO_LARGE",
        "edge.pdf": None, "other.bin": "INVALID_FILE_TYPE"}
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()


def test_upload_files_need_no_folder_each(spark, tmp_path):
    """Files are written in a bounded number of folders; both writers make the same sizes and the gate judges them alike."""
    from jobledger.sources.uploads import MAX_UPLOAD_BYTES as most, WRITE_SHARDS, _write_by_spark, upload_gate, write_uploads
    rows = [(k, "txt" if k % 5 == 0 else "pdf", ("" if k % 3 == 0 else "%PDF-") + f"é{k}", 0) for k in range(-3, 300)]
    rows += [(1000, "pdf", "%PDF-", most), (1001, "pdf", "%PDF-", most - 1), (1002, "pdf", None, 0), (None, "pdf", "%PDF-", 0),
             (1003, "pdf", "%PDF-a\r\nb", 0), (1004, "pdf", "%PDF-1", 0), (1004, "pdf", "%PDF-1", 0)]
    files = spark.createDataFrame(rows, "page_id long, extension string, body string, size int")
    local, other = str(tmp_path / "a%20 b"), str(tmp_path / "other")
    write_uploads(files, "page_id", f"file:{local}")
    known = files.where("page_id is not null and page_id >= 290").fillna("", "body")
    _write_by_spark(known.withColumn("shard", F.lit(0)), "page_id", other)
    page = F.regexp_extract("path", r"/page_id=(-?\d+)[./]", 1).cast("long")
    expected = {}
    for k, extension, body, size in rows:
        if k is not None and (body or size):
            n = expected.get(k, (0,))[0] + max(size, len(body.encode())) + 1
            wrong = extension == "txt" or not body.startswith("%PDF-")
            expected[k] = (n, "FILE_TOO_LARGE" if n > most else "INVALID_FILE_TYPE" if wrong else None)
    gate = {f: upload_gate(spark, f"file:{f}").select(page.alias("k"), "length", "reject_code") for f in (local, other)}
    got = {f: [(r.k, (r.length, r.reject_code)) for r in df.collect()] for f, df in gate.items()}
    assert dict(got[local]) == expected and len(got[local]) == len(expected)
    assert dict(got[other]) == {k: v for k, v in expected.items() if k >= 290}
    assert expected[1000][1] == "FILE_TOO_LARGE" and expected[1001] == (most, None) and expected[1004] == (14, None)
    names = [n for _, _, names in os.walk(local) for n in names]
    assert len(names) == len(expected) + 1 and not [n for n in names if n.startswith(".")]
    assert sum(1 for _ in os.walk(local)) <= WRITE_SHARDS + 1


def test_upload_gate_query_writes_no_folder_per_page(spark, tmp_path):
    from jobledger.plans.catalog import QUERIES
    from jobledger.session import ensure_checkpoint_dir
    rows = [(k, "u", None if k % 7 == 0 else f"<p>{k}</p>") for k in range(1, 500)] + [(None, "u", "x")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    top = ensure_checkpoint_dir(spark).replace("file:", "")
    before = set(os.listdir(top))
    # an empty page is a file of no bytes, which gives no row
    got = {r.page_id: (r.length, r.reject_code) for r in QUERIES["upload_gate"][0](spark, str(tmp_path)).collect()}
    new = [x for x in set(os.listdir(top)) - before if x.startswith("uploads")]
    folders = sum(1 for x in new for _ in os.walk(os.path.join(top, x)))
    assert len(new) == 1 and len(got) == 499 - len(range(21, 500, 21)) and folders < 100
    assert got[1] == (14, None) and got[7] == (6, None) and got[3] == (9, "INVALID_FILE_TYPE")
    assert got[250] == (5 * 1024 * 1024, "INVALID_FILE_TYPE") and got[10] == (15, "INVALID_FILE_TYPE")


def test_upload_gate_lists_each_file_for_one_scan(spark, tmp_path):
    """A file is planned for the scan its size calls for only."""
    for i in range(96):
        (tmp_path / f"{i}.pdf").write_bytes(b"%PDF-")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert uploads.upload_gate(spark, str(tmp_path)).rdd.getNumPartitions() == files.rdd.getNumPartitions()
