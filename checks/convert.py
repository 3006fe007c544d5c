"""Converters and the scalar functions behind them."""

from pyspark.sql import functions as F

from checks.tables import query
from sparkdocs.convert import diagram, html, media
from sparkdocs.convert.default import default_registry
from sparkdocs.functions import text as X
from sparkdocs.operators.fallback import first_success


@query(
    "convert_text",
    """
    SELECT file_path, true AS success,
           CASE file_type WHEN 'md' THEN c WHEN 'txt' THEN '# ' || file_name || chr(10) || chr(10) || c
                ELSE '# ' || file_name || chr(10) || chr(10) || '```py' || chr(10) || c || chr(10) || '```' END AS markdown_content,
           CASE file_type WHEN 'md' THEN 0 WHEN 'txt' THEN 1 ELSE 2 END AS conversion_type
    FROM (SELECT file_path, file_name, file_type, markdown_content AS c FROM {docs}) d
    WHERE file_type IN ('md', 'txt', 'py')
    """,
)
def _(t):
    rows = t.docs.filter(F.col("file_type").isin("md", "txt", "py")).select(
        "file_path", "file_name", F.upper("file_type").alias("file_type"),
        F.concat("markdown_content", F.lit("\x00")).alias("text"),
    )
    made = default_registry().convert(rows)
    return made.select("file_path", "success", "markdown_content", "conversion_type")


@query(
    "convert_dispatch",
    """
    SELECT file_path, file_type IN ('md', 'txt', 'py', 'html') AS success,
           CASE file_type WHEN 'md' THEN 0 WHEN 'txt' THEN 1 WHEN 'py' THEN 2 WHEN 'html' THEN 8 END AS conversion_type,
           CASE WHEN lower(file_type) = 'pdf' THEN 'Unsupported file type: ' || file_type END AS error_message
    FROM {docs}
    """,
)
def _(t):
    rows = t.docs.select("file_path", "file_name", "file_type", F.col("markdown_content").alias("text"))
    return default_registry().convert(rows).select("file_path", "success", "conversion_type", "error_message")


@query(
    "text_decode",
    "SELECT doc_id, text AS decoded FROM {documents}",
)
def _(t):
    # A byte that is never part of UTF-8 before and after the text.
    broken = F.concat(F.unhex(F.lit("FF")), F.encode("text", "UTF-8"), F.unhex(F.lit("C3")))
    return t.documents.select("doc_id", X.decode_utf8(broken).alias("decoded"))


_BLANK = "'[ \\t\\n\\x0B\\f\\r]+'"


@query(
    "convert_html",
    f"""
    WITH a AS (SELECT page_id, regexp_replace(html, '(?s)<head>.*?</head>|<script.*?</script>|<!--.*?-->|<!DOCTYPE[^>]*>', '', 'g') AS h FROM {{pages}}),
    b AS (SELECT page_id, regexp_replace(h, {_BLANK}, ' ', 'g') AS h FROM a),
    c AS (SELECT page_id, regexp_replace(h, '<a href="([^"]*)">(.*?)</a>', '[\\2](\\1)', 'g') AS h FROM b),
    d AS (SELECT page_id, regexp_replace(h, '<b>(.*?)(?:<br>)?(</?p>|</article>)', '**\\1**\\2', 'g') AS h FROM c),
    e AS (SELECT page_id, regexp_replace(regexp_replace(h, '</li><li>', chr(10) || '* ', 'g'), '<li>', '* ', 'g') AS h FROM d),
    f AS (SELECT page_id, regexp_replace(h, '<h1>', chr(10) || chr(10) || '# ', 'g') AS h FROM e),
    g AS (SELECT page_id, regexp_replace(h, '<[^>]+>', chr(10) || chr(10), 'g') AS h FROM f),
    i AS (SELECT page_id, regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(h, '&quot;?', '"', 'g'), '&copy;?', '©', 'g'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&nbsp;', chr(160)), '&amp;?', '&', 'g') AS h FROM g),
    j AS (SELECT page_id, regexp_replace(h, ' *\\n *', chr(10), 'g') AS h FROM i)
    SELECT page_id, trim(regexp_replace(h, '\\n\\n+', chr(10) || chr(10), 'g'), chr(10) || ' ') AS markdown_content FROM j
    """,
)
def _(t):
    return html.convert_html(t.pages, "html").select("page_id", "markdown_content")


@query("html_title", "SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title FROM {pages}")
def _(t):
    return t.pages.select("page_id", html.html_title(F.col("html")).alias("title"))


@query(
    "clean_labels",
    "SELECT page_id, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), "
    "'&amp;', '&'), '&nbsp;', ' '), '&quot;', '\"'), '&#39;', ''''), '<[^>]+>', '', 'g'), "
    "'[\\s\\x{{0B}}\\x{{1C}}-\\x{{1F}}\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+', ' ', 'g')) AS label FROM {pages}",
)
def _(t):
    return t.pages.select("page_id", X.clean_label(F.col("html")).alias("label"))


# Diagrams of fifty events each: a page per type of event, and an empty page.
def _diagrams(t):
    cells = t.events.select(
        F.floor(F.col("event_id") / 50).alias("no"), "event_type", "event_id",
        F.concat(
            F.lit('<mxCell id="c'), "event_id", F.lit('" value="&lt;b&gt;'), "event_type", F.lit("&lt;/b&gt;&amp;nbsp;"),
            "event_id", F.lit('" vertex="1"/>'),
        ).alias("cell"),
    )
    pages = cells.groupBy("no", "event_type").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "cell"))), lambda c: c["cell"]), "").alias("x")
    )
    shown = pages.select(
        "no", "event_type",
        F.concat(
            F.lit('<diagram name="'), "event_type",
            F.lit('"><mxGraphModel><root><mxCell id="0"/><mxCell id="1" value="base"/>'), "x",
            F.lit("</root></mxGraphModel></diagram>"),
        ).alias("page"),
    )
    files = shown.groupBy("no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_type", "page"))), lambda p: p["page"]), "").alias("x")
    )
    xml = F.concat(F.lit("<mxfile>"), "x", F.lit('<diagram name="empty"/></mxfile>'))
    return files.select(
        F.concat(F.lit("/d/u"), "no", F.lit(".drawio")).alias("file_path"), F.encode(xml, "UTF-8").alias("content")
    )


@query(
    "diagram_labels",
    "SELECT '/d/u' || event_id // 50 || '.drawio' AS file, event_type AS page_name, event_type || ' ' || event_id AS label "
    "FROM {events}",
)
def _(t):
    found = diagram.diagram_labels(_diagrams(t)).filter(F.col("item").isNotNull())
    return found.select("file", "page_name", X.clean_label(F.col("value")).alias("label"))


@query(
    "diagram_markdown",
    """
    WITH p AS (
        SELECT event_id // 50 AS no, event_type, count(*) AS n,
               '## ' || event_type || chr(10) || chr(10)
               || string_agg('- ' || event_type || ' ' || event_id, chr(10) || chr(10) ORDER BY event_id) AS block
        FROM {events} GROUP BY event_id // 50, event_type
    )
    SELECT '/d/u' || no || '.drawio' AS file, count(*) + 1 AS pages, sum(n)::BIGINT AS items,
           '# u' || no || '.drawio' || chr(10) || chr(10) || '总共 ' || (count(*) + 1) || ' 个页面，' || sum(n)::BIGINT || ' 个文本项目'
           || chr(10) || chr(10) || '---' || chr(10) || chr(10) || string_agg(block, repeat(chr(10), 4) ORDER BY event_type)
           || repeat(chr(10), 4) || '## empty' || chr(10) || chr(10) || '*此页面没有找到文本内容*' || chr(10) AS markdown_content
    FROM p GROUP BY no
    """,
)
def _(t):
    return diagram.diagram_markdown(diagram.diagram_labels(_diagrams(t)))


# Probe records and image metadata built from events.
def _probes(t):
    video = (F.col("event_type") != "error").cast("int")
    probe = F.concat(
        F.lit('{"format": {"format_name": "mov", "duration": "'),
        F.when(F.col("event_type") == "view", "n/a").otherwise(F.col("value").cast("string")),
        F.lit('", "bit_rate": "'), "user_id", F.lit('", "nb_streams": 2}, "streams": [{"codec_type": "audio", "codec_name": "aac"}'),
        F.when(video == 1, F.concat(
            F.lit(', {"codec_type": "video", "codec_name": "'), "event_type", F.lit('", "width": "'), "user_id",
            F.lit('", "height": 720, "avg_frame_rate": "25/1"}, {"codec_type": "video", "codec_name": "second"}'),
        )).otherwise(""),
        F.lit("]}"),
    )
    return t.events.select("event_id", "ts", probe.alias("probe_json"))


@query(
    "media_flatten",
    """
    SELECT event_id, 'mov' AS format_name, CASE WHEN event_type <> 'view' THEN value END AS duration_seconds,
           CAST(user_id AS VARCHAR) AS bit_rate, CASE WHEN event_type <> 'error' THEN event_type END AS video_codec,
           'aac' AS audio_codec, CASE WHEN event_type <> 'error' THEN CAST(user_id AS VARCHAR) END AS width,
           CASE WHEN event_type <> 'error' THEN '720' END AS height,
           CASE WHEN event_type <> 'error' THEN '25/1' END AS avg_frame_rate, '2' AS nb_streams
    FROM {events}
    """,
)
def _(t):
    return media.flatten_probe(_probes(t)).drop("ts", "probe_json")


def _sql_duration(seconds: str) -> str:
    ms = f"CAST(trunc({seconds} * 1000) AS BIGINT)"
    return (
        f"CASE WHEN {seconds} IS NULL THEN 'N/A' WHEN {ms} >= 3600000 THEN "
        f"printf('%02d:%02d:%02d.%03d', {ms} // 3600000, {ms} // 60000 % 60, {ms} // 1000 % 60, {ms} % 1000) "
        f"ELSE printf('%02d:%02d.%03d', {ms} // 60000 % 60, {ms} // 1000 % 60, {ms} % 1000) END"
    )


@query(
    "human_duration",
    f"SELECT event_id, {_sql_duration('nullif(value * 37, 0)')} AS shown FROM {{events}}",
)
def _(t):
    return t.events.select("event_id", X.human_duration(F.nullif(F.col("value") * 37, F.lit(0))).alias("shown"))


def _sql_bytes(size: str) -> str:
    steps = "".join(
        f"WHEN {size} < 1024.0 ** {p + 1} THEN printf('%.2f {unit}', {size} / 1024.0 ** {p}) "
        for p, unit in enumerate(["B", "KB", "MB", "GB"])
    )
    return f"CASE WHEN {size} IS NULL THEN 'N/A' {steps} ELSE printf('%.2f TB', {size} / 1024.0 ** 4) END"


_SIZE = "CASE WHEN n_chars < 100 THEN NULL ELSE n_chars * n_chars * n_chars * (doc_id % 3 + 1) END"


@query(
    "human_bytes",
    f"SELECT doc_id, {_sql_bytes('CAST(size AS DOUBLE)')} AS shown, CASE WHEN size > 1048576 THEN printf('%.2f MB', size / 1048576.0) "
    f"ELSE printf('%.2f KB', size / 1024.0) END AS listed FROM (SELECT doc_id, {_SIZE} AS size FROM {{documents}}) d",
)
def _(t):
    sized = t.documents.select("doc_id", F.expr(_SIZE).alias("size"))
    return sized.select(
        "doc_id", X.human_bytes(F.col("size")).alias("shown"), X.human_bytes(F.col("size"), "list").alias("listed")
    )


@query("content_hash", "SELECT doc_id, sha256(text) AS hash FROM {documents}")
def _(t):
    return t.documents.select("doc_id", X.content_hash(F.col("text")).alias("hash"))


@query(
    "media_markdown",
    f"""
    SELECT '/v/' || event_id || '.mp4' AS file_path,
           '---' || e || e || 'source_file: ' || event_id || '.mp4' || e || 'provider: video-processor' || e
           || 'hash_sha256: ' || sha256(CAST(event_id AS VARCHAR)) || e || 'file_size_bytes: ' || event_id * 1000 || e
           || 'modified_time: ' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || e || 'video:' || e
           || '  format_name: mov' || e || '  duration_seconds: ' || coalesce(CAST(CASE WHEN event_type <> 'view' THEN value END AS VARCHAR), 'None') || e
           || '  bit_rate: ' || user_id || e || '  video_codec: ' || CASE WHEN event_type <> 'error' THEN event_type ELSE 'None' END || e
           || '  audio_codec: aac' || e || '  width: ' || CASE WHEN event_type <> 'error' THEN CAST(user_id AS VARCHAR) ELSE 'None' END || e
           || '  height: ' || CASE WHEN event_type <> 'error' THEN '720' ELSE 'None' END || e
           || '  avg_frame_rate: ' || CASE WHEN event_type <> 'error' THEN '25/1' ELSE 'None' END || e || '  nb_streams: 2' || e
           || '  duration_human: ' || {_sql_duration("CASE WHEN event_type <> 'view' THEN value END")} || e
           || 'transcription_details:' || e || '  enabled: False' || e || '  model: N/A' || e
           || 'file_size_human: ' || {_sql_bytes("CAST(event_id * 1000 AS DOUBLE)")} || e || e || '---' || e || e
           || '# ' || event_id || '.mp4' || e || e || '(音视频转录功能未启用)' || e AS markdown_content
    FROM (SELECT *, chr(10) AS e FROM {{events}}) v
    """,
)
def _(t):
    flat = media.flatten_probe(_probes(t)).select(
        "*",
        F.concat(F.lit("/v/"), "event_id", F.lit(".mp4")).alias("file_path"),
        F.concat("event_id", F.lit(".mp4")).alias("file_name"),
        (F.col("event_id") * 1000).alias("file_size"),
        F.col("ts").cast("timestamp").alias("file_modified_time"),
        X.content_hash(F.col("event_id").cast("string")).alias("sha256"),
    )
    return flat.select("file_path", media.media_text(flat).alias("markdown_content"))


# EXIF maps from orders: wanted and unwanted keys, short and long bytes, a long list.
def _images(t):
    order = F.col("o_orderkey").cast("string")
    return t.orders.select(
        "o_orderkey", "o_totalprice",
        media.exif_keep(
            F.create_map(F.lit("Model"), F.col("o_orderpriority"), F.lit("MakerNote"), order, F.lit("DateTime"), F.lit("2024")),
            F.create_map(F.lit("Make"), F.encode(F.repeat(order, 6), "UTF-8"), F.lit("Padding"), F.encode(order, "UTF-8")),
            F.create_map(F.lit("GPSInfo"), F.array_repeat(F.col("o_orderstatus"), 25)),
        ).alias("exif"),
    )


_MAKE = "CASE WHEN length(repeat(o, 6)) <= 32 THEN repeat(o, 6) ELSE 'bytes[' || length(repeat(o, 6)) || ']' END"
_GPS = "'[' || array_to_string(list_transform(range(20), lambda i: '''' || o_orderstatus || ''''), ', ') || ']'"


@query(
    "exif_keep",
    f"SELECT o_orderkey, 3 + 1 AS n, o_orderpriority AS model, {_MAKE} AS make, {_GPS} AS gps "
    "FROM (SELECT *, CAST(o_orderkey AS VARCHAR) AS o FROM {orders}) x",
)
def _(t):
    made = _images(t)
    return made.select(
        "o_orderkey", F.size("exif").alias("n"), F.col("exif")["Model"].alias("model"), F.col("exif")["Make"].alias("make"),
        F.col("exif")["GPSInfo"].alias("gps"),
    )


@query(
    "front_matter",
    f"""
    SELECT o_orderkey, '---' || e || e || 'source_file: ' || o || '.png' || e || 'provider: local-ocr' || e || 'hash_sha256: None' || e
           || 'file_size: ' || o || e || 'exif:' || e || '  DateTime: 2024' || e || '  Model: ' || o_orderpriority || e || '  Make: ' || {_MAKE}
           || e || '  GPSInfo: ' || {_GPS} || e || 'ocr_lang: eng' || e || e || '---' AS head
    FROM (SELECT *, CAST(o_orderkey AS VARCHAR) AS o, chr(10) AS e FROM {{orders}}) x
    """,
)
def _(t):
    head = X.front_matter([
        ("source_file", F.concat("o_orderkey", F.lit(".png"))),
        ("provider", F.lit("local-ocr")),
        ("hash_sha256", F.lit(None)),
        ("file_size", F.col("o_orderkey")),
        ("exif", X.MapField(F.col("exif"))),
        ("ocr_lang", F.lit("eng")),
    ])
    return _images(t).select("o_orderkey", head.alias("head"))


_CHAIN = "CASE provider WHEN 'purchase' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 WHEN 'error' THEN 4 END"


@query(
    "provider_fallback",
    f"""
    WITH a AS (SELECT *, {_CHAIN} AS pos FROM {{attempts}}),
         f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path, provider ORDER BY attempt_no) AS r FROM a) x
               WHERE r = 1 AND pos IS NOT NULL),
         g AS (SELECT path, min(pos) FILTER (WHERE ok) AS won,
                      string_agg('provider=' || provider || ' error=' || coalesce(error, 'None'), '; ' ORDER BY pos) AS tried
               FROM f GROUP BY path)
    SELECT g.path, won IS NOT NULL AS success, f.provider, f.content,
           CASE WHEN won IS NULL THEN 'Image OCR/caption extraction failed: ' || tried END AS error_message
    FROM g LEFT JOIN f ON f.path = g.path AND f.pos = g.won
    """,
)
def _(t):
    return first_success(t.attempts, primary="purchase", chain=["view", "click", "error"])
