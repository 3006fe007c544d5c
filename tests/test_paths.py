import os.path
import unicodedata

from pyspark.sql import functions as F

from sparkdocs.functions import paths as P

NAMES = [
    "b.tar.gz", ".bashrc", "x.", "noext", "c", ".x.md", "..y", "a.md", "a.b", "..a.b", "a..b", "...", ".",
    "a b.TXT", "文档.md", "..", "x.PDF",
]


def test_extension_as_splitext(spark):
    df = spark.createDataFrame([("/d.d/" + n,) for n in NAMES], "p string")
    for row in df.select("p", P.extension(F.col("p")).alias("e"), P.stem(F.col("p")).alias("s")).collect():
        stem, ext = os.path.splitext(row.p)
        assert row.e == ext.lstrip("."), row.p
        assert row.s == stem, row.p


def test_normalize(spark):
    raw = ["/a/b/../c//d/./e", "rel/x.md", "/café/x", "/a\\b", "/", "/../..", "/a/..", "/한글"]
    df = spark.createDataFrame([(r,) for r in raw], "p string")
    rows = df.select("p", P.normalize_path(F.col("p"), base="/base").alias("n")).collect()
    for row in rows:
        want = os.path.normpath(os.path.join("/base", row.p))
        assert row.n == unicodedata.normalize("NFC", want).replace("\\", "/"), row.p


def test_scope_and_source(spark):
    df = spark.createDataFrame([("/a/b/x",), ("/a/bc/x",), ("/dl/acc/x.html",), ("/dl/x.html",)], "p string")
    rows = df.select(
        P.under(F.col("p"), "/a/b").alias("u"), P.derive_source(F.col("p"), "/dl").alias("s")
    ).collect()
    assert [r.u for r in rows] == [True, False, False, False]
    assert [r.s for r in rows] == ["local_fs", "local_fs", "公众号_acc", "local_fs"]


def test_excluded(spark):
    inside = {
        "/r/a.md": False, "/r/.git/a.md": True, "/r/x/note.Assets/a.png": True, "/r/a.LOG": True, "/r/build/a.md": True,
        "/r/mybuild/a.md": False, "/r/build": False, "/r/.gitignore": False,
    }
    df = spark.createDataFrame([(p,) for p in inside], "p string")
    rows = df.select("p", P.excluded(P.relative(F.col("p"), "/r")).alias("x")).collect()
    assert {r.p: r.x for r in rows} == inside
    # A root that lies in a folder of such a name is scanned.
    under_build = spark.createDataFrame([("/build/r/a.md",)], "p string")
    assert under_build.select(P.excluded(P.relative(F.col("p"), "/build/r"))).first()[0] is False


def test_store_of_a_path_is_kept(spark):
    cases = {
        "hdfs://nn:8020/in/../in/a.md": "hdfs://nn:8020/in/a.md", "s3a://b/in//a.md": "s3a://b/in/a.md", "hdfs:///in/a.md": "hdfs:///in/a.md",
        "file:///t/./a.md": "/t/a.md", "file:/t/a.md": "/t/a.md", "/plain/a:b/c.md": "/plain/a:b/c.md", "x:/y.md": "/x:/y.md",
        "abfss://c@acc.host/é/a.md": "abfss://c@acc.host/é/a.md",
    }
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    got = {r.p: r.n for r in df.select("p", P.normalize_path(F.col("p")).alias("n")).collect()}
    assert got == cases
    for root, want in [("hdfs:///in/", "hdfs:///in"), ("file:///t//x/", "/t/x"), ("s3a://b/a/../c", "s3a://b/c"), ("/a/./b/", "/a/b"), ("/", "/")]:
        assert P.normalize_root(root) == want
    listed = spark.createDataFrame([("hdfs://nn:8020/in/a.md",)], "p string")
    for root, want in [("/in", "/in/a.md"), ("hdfs:///in", "hdfs:///in/a.md"), ("hdfs://nn:8020/in", "hdfs://nn:8020/in/a.md")]:
        assert listed.select(P.named_below(F.col("p"), root)).first()[0] == want
