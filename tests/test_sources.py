"""Parsers on odd texts, and files read back."""

import gzip
import json

from depsift.sources import documents as D
from depsift.sources import feeds

BAD = [None, "", "{", "[]", "null", "not json"]


def docs(spark, *values):
    return spark.createDataFrame([(v,) for v in [*values, *BAD]], "value string")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_malformed_documents_give_no_rows(spark):
    for parse in feeds.WHOLE.values():
        assert parse(docs(spark)).count() == 0, parse.__name__
    assert feeds.audit_log(docs(spark)).where("action is not null").count() == 0
    for kind in ("apk", "dpkg"):
        assert feeds.os_packages(docs(spark), kind).count() == 0


def test_epss_files(spark, tmp_path):
    with gzip.open(tmp_path / "a.csv.gz", "wt") as f:
        f.write("#model:v1\ncve,epss,percentile\nCVE-1,0.1,0.2\nCVE-2,x,0.2\nCVE-3,0.5\nCVE-1,0.3,0.4\n\n")
    assert rows(feeds.read(spark, "epss", str(tmp_path))) == [("CVE-1", 0.3, 0.4)]


def test_requirements(spark):
    lines = ["a==1.0", "b >= 2 ; x", "# c", "-e .", "-r f", "--hash", "d", "e===1", "f!=3", "g~=1.1 # h", None, "  "]
    found = feeds.requirements(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert {tuple(r) for r in found.collect()} == {("a", "==", "1.0"), ("b", ">=", "2"), ("d", None, None), ("e", "===", "1"), ("f", "!=", "3"), ("g", "~=", "1.1")}


def test_go_mod(spark):
    text = "module m\r\nrequire github.com/lib/pq v1.10.0 // indirect\nrequire (\n\ta.b/c v1\n\td.e/f v2\n)\nreplace a.b/c v1 => g.h/i v3\nreplace (\n d.e/f => ../local\n)\n"
    found = feeds.go_mod(spark.createDataFrame([(text,)], "value string"))
    assert ("github.com/lib", "pq", "1.10.0") in rows(found.where("namespace is not null"))
    assert ("g.h", "i", "3") in rows(found)


def test_workflow_actions(spark):
    text = "- uses: actions/checkout@v4\n- uses: 'o/r/sub@main'\n- uses: ./x\n- uses: docker://a/b@1\n- uses: plain@1\n- uses: a/b@1@2\n"
    assert rows(feeds.workflow_actions(docs(spark, text))) == [("actions", "checkout", "v4"), ("o", "r/sub", "main")]


def test_os_packages(spark):
    apk = "P:musl\nV:1.2\nA:x86\n\nP:zlib\nV:1\n"
    assert {tuple(r) for r in feeds.os_packages(docs(spark, apk), "apk").collect()} == {("musl", "1.2", "x86", None), ("zlib", "1", None, None)}
    dpkg = "Package: a\nStatus: install ok installed\nVersion: 1:2-3\nSource: src (9)\n\nPackage: b\nStatus: purge ok not-installed\nVersion: 1\n"
    assert [tuple(r) for r in feeds.os_packages(docs(spark, dpkg), "dpkg").collect()] == [("a", "1:2-3", None, "src")]


def test_vex_without_products_is_global(spark):
    text = json.dumps({"timestamp": "t", "statements": [{"vulnerability": {"@id": "C"}, "status": "fixed"}, {"vulnerability": {"@id": "D"}, "products": [{"@id": "p"}, {"@id": "q"}], "status": "affected"}]})
    assert {(r.cve, r.product) for r in feeds.vex(docs(spark, text)).collect()} == {("C", None), ("D", "p"), ("D", "q")}


def test_spdx_without_purl_and_licence(spark):
    text = json.dumps({"spdxVersion": "x", "packages": [{"name": "a", "versionInfo": "1", "licenseConcluded": "NOASSERTION", "licenseDeclared": "MIT"}]})
    assert rows(feeds.spdx(docs(spark, text))) == [("a", "1", "pkg:maven/a@1", "maven", "MIT")]


def test_graph_lines_are_escaped(spark):
    edges = spark.createDataFrame([('a"<', "b&\\")], "src string, dst string")
    assert D.graph_lines(edges, "graphml").first().value == '<edge source="a&quot;&lt;" target="b&amp;\\"/>'
    assert D.graph_lines(edges, "dot").first().value == '"a\\"<" -> "b&\\\\";'


def test_whole_files_carry_their_name(spark, tmp_path):
    (tmp_path / "k.json").write_text(json.dumps({"vulnerabilities": [{"cveID": "CVE-1", "dueDate": "d"}]}, indent=1))
    found = feeds.read(spark, "kev", str(tmp_path)).first()
    assert found.file.endswith("k.json") and (found.cve, found.due_date) == ("CVE-1", "d")


def test_audit_csv_reads_back(spark, tmp_path):
    rows_ = spark.createDataFrame([("t", "u", "a", 'x,"y"')], "timestamp string, user string, action string, details string")
    D.audit_csv(rows_, str(tmp_path / "out"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "out")).count() == 1
