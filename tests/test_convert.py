import base64
import hashlib
import io
import json
import zipfile
import zlib
from datetime import datetime, timezone
from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

from sparkdocs import schemas as S
from sparkdocs.convert.default import default_registry
from sparkdocs.convert.html import html_to_markdown
from sparkdocs.convert.registry import ConverterRegistry
from sparkdocs.functions import text as X
from sparkdocs.operators.fallback import first_success, provider_chain


def convert(spark, files, registry=None):
    rows = [(f"/in/{name}", name, kind, data if isinstance(data, bytes) else data.encode()) for name, kind, data in files]
    df = spark.createDataFrame(rows, "file_path string, file_name string, file_type string, content binary")
    return {r.file_name: r for r in (registry or default_registry()).convert(df).collect()}


def zipped(**entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in entries.items():
            z.writestr(name.replace("_", "."), data)
    return out.getvalue()


def topic(title, *children, **extra):
    t = {"id": title, "title": title, **extra}
    if children:
        t["children"] = {"attached": list(children)}
    return t


def test_text_types_and_unknown(spark):
    got = convert(spark, [
        ("t.txt", "TXT", "hello world"), ("n.md", "md", b"# T\x00\xff\nC"), ("c.py", "PY", 'print("hi")'), ("raw.xyz", "XYZ", "u"),
        ("none", None, "u"), ("p.PNG", "PNG", b"\x89"), ("d.pdf", "pdf", b"%PDF"),
    ])
    assert (got["t.txt"].success, got["t.txt"].conversion_type) == (True, 1)
    assert got["t.txt"].markdown_content == "# t.txt\n\nhello world"
    assert (got["n.md"].markdown_content, got["n.md"].conversion_type) == ("# T\nC", 0)
    assert got["c.py"].markdown_content == '# c.py\n\n```py\nprint("hi")\n```'
    assert (got["p.PNG"].markdown_content, got["p.PNG"].conversion_type) == ("# p.PNG\n", S.IMAGE)
    assert not got["raw.xyz"].success and got["raw.xyz"].error_message == "Unsupported file type: XYZ"
    assert not got["none"].success and got["none"].error_message == "Unsupported file type: None"
    assert got["d.pdf"].error_message == "Unsupported file type: pdf"


def test_registry():
    r = ConverterRegistry()
    r.register(["B", "a"], 1, column=lambda: F.lit("x"))
    r.register(["b"], 2, frame=lambda rows: rows)
    assert r.registered() == ["a", "b"]


def test_own_converter(spark):
    r = default_registry()
    r.register(["pdf"], S.STRUCTURED, column=lambda: F.nullif(F.col("text"), F.lit("")), empty_error="empty pdf")
    got = convert(spark, [("a.pdf", "PDF", "body"), ("b.pdf", "pdf", "")], r)
    assert (got["a.pdf"].markdown_content, got["a.pdf"].conversion_type) == ("body", 3)
    assert (got["b.pdf"].success, got["b.pdf"].error_message) == (False, "empty pdf")


def test_html_file(spark):
    page = "<html><head><title>Test</title></head><body><h1>Hello</h1><p>World</p></body></html>"
    got = convert(spark, [("x.html", "html", page), ("e.htm", "HTM", "<html><head><title>x</title></head></html>")])
    assert got["x.html"].markdown_content == "# Hello\n\nWorld" and got["x.html"].conversion_type == 8
    assert not got["e.htm"].success and got["e.htm"].conversion_type is None


@pytest.mark.parametrize("html,want", [
    ("<p>a<p>b", "a\n\nb"),
    ("<p>x <b>bold<i> both</i></b> y</p>", "x **bold *both*** y"),
    ("<b>open<p>next", "**open**\n\nnext"),
    ("<ul><li>a<ul><li>b</ul><li>c</ul>", "* a\n  * b\n* c"),
    ("<ol><li>a</li><li>b</li></ol>", "1. a\n2. b"),
    ("a<br>b", "a  \nb"),
    ("<pre>x\n  y</pre>", "```\nx\n  y\n```"),
    ("<a href='u'>t</a> <a>n</a> <img src=s alt=q>", "[t](u) n ![q](s)"),
    ("<script>x</script><style>y</style><!-- z -->k &amp; l", "k & l"),
    ("<table><tr><th>a<th>b</tr><tr><td>1</td><td>2|3</td></tr></table>", "| a | b |\n| --- | --- |\n| 1 | 2\\|3 |"),
    ("<blockquote>q</blockquote>r", "> q\n\nr"),
    ("<h2> A  b </h2><hr>", "## A b\n\n---"),
    ("plain\n text", "plain text"),
    ("", ""),
])
def test_html_forms(html, want):
    assert html_to_markdown(html) == want


def test_outlines(spark):
    sheet = {"rootTopic": topic("Root Topic", topic("Child A", topic("deep\r\nline")), topic("Child B", children={}))}
    xml = ('<xmap-content xmlns="urn:x"><sheet><topic><title>R</title><children><topics type="attached"><topic><title>K</title></topic>'
           '</topics><topics type="detached"><topic><title>no</title></topic></topics></children></topic></sheet></xmap-content>')
    got = convert(spark, [
        ("a.xmind", "xmind", zipped(content_json=json.dumps([sheet, {"rootTopic": topic("Two")}]))),
        ("b.xmind", "XMIND", zipped(content_xml=xml)),
        ("bad.xmind", "xmind", b"no zip"),
        ("none.xmind", "xmind", zipped(other_txt="x")),
    ])
    assert got["a.xmind"].markdown_content == "# Root Topic\n\n- Child A\n  - deep line\n- Child B\n\n# Two"
    assert got["a.xmind"].conversion_type == 4
    assert got["b.xmind"].markdown_content == "# R\n\n- K"
    for bad in ("bad.xmind", "none.xmind"):
        assert not got[bad].success and got[bad].error_message.startswith("XMind conversion failed: ")


def test_diagrams(spark):
    def page(name, *values):
        cells = "".join(f'<mxCell id="c{i}" value="{v}"/>' for i, v in enumerate(values))
        return f'<diagram name="{name}"><mxGraphModel><root><mxCell id="0"/><mxCell id="1" value="x"/>{cells}</root></mxGraphModel></diagram>'

    model = '<mxGraphModel><root><UserObject id="9" value="&lt;b&gt;Enc&lt;/b&gt;&amp;nbsp; 1"/></root></mxGraphModel>'
    squeeze = zlib.compressobj(wbits=-15)
    raw = squeeze.compress(quote(model).encode()) + squeeze.flush()
    payloads = [base64.b64encode(raw), base64.b64encode(zlib.compress(quote(model).encode())), base64.b64encode(model.encode())]
    encoded = "".join(f"<diagram name='E{i}'>{p.decode()}</diagram>" for i, p in enumerate(payloads))
    got = convert(spark, [
        ("one.drawio", "drawio", f"<mxfile>{page('Page-1', '开始', '处理步骤', '结束')}</mxfile>"),
        ("two.drawio", "drawio", f"<mxfile>{page('PageA', 'NodeA')}{page('PageB')}</mxfile>"),
        ("enc.drawio", "drawio", f"<mxfile>{encoded}<diagram>???</diagram></mxfile>"),
        ("none.drawio", "drawio", "<mxfile/>"),
        ("bad.drawio", "drawio", "<mxfile>"),
    ])
    one = got["one.drawio"].markdown_content
    assert one == "# one.drawio\n\n总共 1 个页面，3 个文本项目\n\n---\n\n## Page-1\n\n- 开始\n\n- 处理步骤\n\n- 结束\n"
    assert got["one.drawio"].conversion_type == 7
    two = got["two.drawio"].markdown_content
    for part in ("总共 2 个页面，1 个文本项目", "## PageA", "- NodeA", "## PageB", "*此页面没有找到文本内容*"):
        assert part in two
    assert got["enc.drawio"].markdown_content.count("- Enc 1\n") == 3 and "## 未命名图表" in got["enc.drawio"].markdown_content
    assert got["none.drawio"].error_message == "# none.drawio\n\n未找到 diagram 元素\n"
    assert got["bad.drawio"].error_message.startswith("Draw.io XML 解析失败: ")


def test_fallback(spark):
    schema = "path string, provider string, attempt_no int, ok boolean, content string, error string"
    rows = [
        ("a", "openai", 1, False, None, "dummy failure"), ("a", "google-genai", 2, True, "DUMMY OK", None),
        ("b", "openai", 1, False, None, "x"), ("b", "google-genai", 2, False, None, "y"),
    ]
    got = {r.path: r for r in first_success(spark.createDataFrame(rows, schema), "openai", ["openai", "google-genai"]).collect()}
    assert got["a"].content == "DUMMY OK" and got["a"].provider == "google-genai"
    assert got["b"].error_message == (
        "Image OCR/caption extraction failed: provider=openai error=x; provider=google-genai error=y"
    )
    assert provider_chain("google-genai", ["openai"]) == ["google-genai", "openai"]
    assert provider_chain("X", []) == ["x"]


def test_human_formats(spark):
    sizes = {None: "N/A", 0: "0.00 B", 1023: "1023.00 B", 1024: "1.00 KB", 1152: "1.12 KB", 5 * 1024**2: "5.00 MB", 1024**4 * 3000: "3000.00 TB"}
    df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "n long, want string")
    assert all(r.want == r.got for r in df.select("want", X.human_bytes(F.col("n")).alias("got")).collect())
    times = {None: "N/A", 0.0: "00:00.000", 61.5: "01:01.500", 3661.25: "01:01:01.250"}
    df = spark.createDataFrame([(k, v) for k, v in times.items()], "n double, want string")
    assert all(r.want == r.got for r in df.select("want", X.human_duration(F.col("n")).alias("got")).collect())


def test_clean_label_order(spark):
    df = spark.createDataFrame([("&amp;nbsp;a &lt;b&gt;x&lt;/b&gt;\n&#39;q&quot; <br/>",)], "t string")
    assert df.select(X.clean_label(F.col("t"))).first()[0] == "a x 'q\""


def test_media_files(spark):
    t = datetime(2025, 1, 2, 3, 4, 5, tzinfo=timezone.utc)
    probe = '{"format": {"duration": "61.5"}, "streams": []}'
    df = spark.createDataFrame(
        [("/m/a.mp4", "a.mp4", "MP4", b"abc", 3, t, probe), ("/m/b.mp3", "b.mp3", "mp3", b"", 0, t, None)],
        "file_path string, file_name string, file_type string, content binary, file_size long, file_modified_time timestamp, probe_json string",
    )
    got = {r.file_name: r for r in default_registry(with_probes=True).convert(df).collect()}
    text = got["a.mp4"].markdown_content
    assert got["a.mp4"].conversion_type == S.MEDIA and not got["b.mp3"].success
    for line in ("source_file: a.mp4", f"hash_sha256: {hashlib.sha256(b'abc').hexdigest()}", "modified_time: 2025-01-02T03:04:05",
                 "  duration_seconds: 61.5", "  duration_human: 01:01.500", "  width: None", "file_size_human: 3.00 B"):
        assert f"\n{line}\n" in text
    assert text.endswith("---\n\n# a.mp4\n\n(音视频转录功能未启用)\n")
