"""Table schemas and the fixed code values stored in them."""

from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values: stored codes and names that existing corpora carry. ---
DIRECT, TEXT, CODE, STRUCTURED, OUTLINE, IMAGE, MEDIA, DIAGRAM, HTML = range(9)

CONVERSION_LABELS = {
    DIRECT: "Markdown",
    TEXT: "文本",
    CODE: "代码",
    STRUCTURED: "Office/PDF",
    OUTLINE: "思维导图",
    IMAGE: "图片",
    MEDIA: "音视频",
    DIAGRAM: "draw.io",
    HTML: "HTML",
}

# extension, category, description
FILE_TYPES = [
    ("md", "native", "Markdown"),
    ("txt", "plain_text", "Plain Text"),
    ("srt", "plain_text", "Subtitle File"),
    ("sql", "code", "SQL Script"),
    ("py", "code", "Python Script"),
    ("sh", "code", "Shell Script"),
    ("html", "html", "HTML File"),
    ("htm", "html", "HTML File"),
    ("pdf", "structured", "PDF Document"),
    ("docx", "structured", "Word Document"),
    ("xlsx", "structured", "Excel Spreadsheet"),
    ("pptx", "structured", "PowerPoint Presentation"),
    ("doc", "structured", "Legacy Word Document"),
    ("xls", "structured", "Legacy Excel Spreadsheet"),
    ("ppt", "structured", "Legacy PowerPoint Presentation"),
    ("xmind", "xmind", "Xmind"),
    ("png", "image", "PNG Image"),
    ("jpg", "image", "JPEG Image"),
    ("jpeg", "image", "JPEG Image"),
    ("bmp", "image", "Bitmap Image"),
    ("gif", "image", "GIF Image"),
    ("webp", "image", "WebP Image"),
    ("mp4", "video", "MP4 Video"),
    ("mkv", "video", "Matroska Video"),
    ("mov", "video", "QuickTime Video"),
    ("webm", "video", "WebM Video"),
    ("flv", "video", "Flash Video"),
    ("wma", "video", "WMA Audio"),
    ("mp3", "video", "MP3 Audio"),
    ("m4a", "video", "M4A Audio"),
    ("drawio", "diagram", "Draw.io Diagram"),
]

CATEGORY_CONVERSION = {
    "native": DIRECT,
    "plain_text": TEXT,
    "code": CODE,
    "structured": STRUCTURED,
    "xmind": OUTLINE,
    "image": IMAGE,
    "video": MEDIA,
    "diagram": DIAGRAM,
    "html": HTML,
}

CATEGORY_ORDER = [
    "structured", "native", "xmind", "diagram", "image", "video", "html", "plain_text", "code",
]

EXTENSION_ORDER = {
    "code": ["py", "sql", "sh"],
    "structured": ["pdf", "docx", "xlsx", "pptx", "doc", "xls", "ppt"],
    "image": ["png", "jpg", "jpeg", "gif", "bmp", "webp"],
    "html": ["html", "htm"],
}

EXCLUDED_DIRS = [
    ".git", ".vscode", "__pycache__", "node_modules", ".assets", "dist", "build", "venv",
]
EXCLUDED_DIR_SUFFIXES = [".assets"]
EXCLUDED_EXTENSIONS = ["log", "tmp", "bak", "swo", "swp", "pyc"]

SOURCE_FILES = "local_fs"
SOURCE_NOTES = "Joplin"
NOTE_PATH_SCHEME = "joplin://"
DOWNLOAD_SOURCE_PREFIX = "公众号_"
SIDECAR_SUFFIX = ".meta.json"

EXIF_KEYS = [
    "DateTimeOriginal", "DateTime", "Model", "Make", "LensModel", "FNumber", "ExposureTime",
    "ISOSpeedRatings", "FocalLength", "Orientation", "Software", "GPSInfo",
]

HIDDEN_STAGE = "debug_state"
EVENTS_KEPT_PER_SESSION = 1000
DEFAULT_PER_PAGE = 20
# --- end of fixed values ---

EXTENSIONS = [ext for ext, _, _ in FILE_TYPES]


def extensions_of(category: str) -> list[str]:
    return [ext for ext, cat, _ in FILE_TYPES if cat == category]


DOCUMENTS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("file_name", T.StringType()),
    T.StructField("file_type", T.StringType()),
    T.StructField("file_size", T.LongType()),
    T.StructField("file_created_at", T.TimestampType()),
    T.StructField("file_modified_time", T.TimestampType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("markdown_content", T.StringType()),
    T.StructField("conversion_type", T.IntegerType()),
    T.StructField("status", T.StringType()),
    T.StructField("error_message", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("source_url", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
])

INGEST_STATE = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("scope_key", T.StringType()),
    T.StructField("last_started_at", T.TimestampType()),
    T.StructField("last_ended_at", T.TimestampType()),
    T.StructField("last_error_message", T.StringType()),
    T.StructField("cursor_updated_at", T.TimestampType()),
    T.StructField("total_files", T.LongType()),
    T.StructField("processed", T.LongType()),
    T.StructField("skipped", T.LongType()),
    T.StructField("errors", T.LongType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
])


NOTES = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("parent_id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("created_time", T.LongType()),
    T.StructField("updated_time", T.LongType()),
    T.StructField("source_url", T.StringType()),
    T.StructField("markup_language", T.IntegerType()),
])

FOLDERS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("parent_id", T.StringType()),
    T.StructField("title", T.StringType()),
])
