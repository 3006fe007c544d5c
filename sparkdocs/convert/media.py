"""Media probes and image metadata as columns and front matter.

Probing, text recognition and transcription run outside; their results come as table columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdocs.functions.text import MapField, content_hash, front_matter, human_bytes, human_duration
from sparkdocs.schemas import EXIF_KEYS

# Fixed value: text of a media document without transcription.
NO_TRANSCRIPT = "(音视频转录功能未启用)"

PROBE = (
    "struct<format: struct<format_name: string, duration: string, bit_rate: string, nb_streams: string>, "
    "streams: array<struct<codec_type: string, codec_name: string, width: string, height: string, "
    "avg_frame_rate: string>>>"
)


def flatten_probe(probes: DataFrame, json: str = "probe_json") -> DataFrame:
    """Format fields and those of the first video and first audio stream; a bad duration is null."""
    out = probes.withColumn("_p", F.from_json(F.col(json), PROBE))

    def first(kind: str, field: str) -> Column:
        found = F.filter("_p.streams", lambda s: s["codec_type"] == kind)
        return F.get(found, F.lit(0))[field]

    return out.select(
        *probes.columns,
        F.col("_p.format.format_name").alias("format_name"),
        F.expr("try_cast(_p.format.duration AS double)").alias("duration_seconds"),
        F.col("_p.format.bit_rate").alias("bit_rate"),
        first("video", "codec_name").alias("video_codec"),
        first("audio", "codec_name").alias("audio_codec"),
        first("video", "width").alias("width"),
        first("video", "height").alias("height"),
        first("video", "avg_frame_rate").alias("avg_frame_rate"),
        F.col("_p.format.nb_streams").alias("nb_streams"),
    )


def _iso(ts: Column) -> Column:
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micro = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.when(F.date_format(ts, "SSSSSS") == "000000", whole).otherwise(micro)


def media_text(flat: DataFrame, model: str | None = None) -> Column:
    """Markdown of flattened probes with file_name, file_size, file_modified_time, sha256 and, where
    transcription ran, `transcript`."""
    fields = [
        "format_name", "duration_seconds", "bit_rate", "video_codec", "audio_codec", "width", "height",
        "avg_frame_rate", "nb_streams",
    ]
    pairs = [x for f in fields for x in (F.lit(f), F.col(f).cast("string"))]
    video = F.create_map(*pairs, F.lit("duration_human"), human_duration(F.col("duration_seconds")))
    details = F.create_map(
        F.lit("enabled"), F.lit("True" if model else "False"), F.lit("model"), F.lit(model or "N/A")
    )
    header = front_matter([
        ("source_file", F.col("file_name")),
        ("provider", F.lit("video-processor")),
        ("hash_sha256", F.col("sha256")),
        ("file_size_bytes", F.col("file_size")),
        ("modified_time", _iso(F.col("file_modified_time"))),
        ("video", MapField(video)),
        ("transcription_details", MapField(details)),
        ("file_size_human", human_bytes(F.col("file_size"))),
    ])
    transcript = F.lit(NO_TRANSCRIPT)
    if "transcript" in flat.columns:
        transcript = F.coalesce("transcript", transcript)
    return F.concat(header, F.lit("\n\n# "), "file_name", F.lit("\n\n"), transcript, F.lit("\n"))


def media_frame(rows: DataFrame) -> DataFrame:
    """Frame converter for media rows that carry `probe_json` and `content`; no probe is a failure."""
    flat = flatten_probe(rows.withColumn("sha256", content_hash(F.col("content"))))
    text = F.when(F.col("probe_json").isNotNull(), media_text(flat))
    return flat.select(*rows.columns, text.alias("markdown_content"), F.lit("no media probe").alias("error_message"))


def exif_keep(
    texts: Column, binaries: Column | None = None, lists: Column | None = None
) -> Column:
    """The wanted EXIF entries as map<string,string>, in the order of EXIF_KEYS.

    Up to 32 bytes are read as text, longer values are named by size; lists keep 20 entries. A key in
    several of the maps is read from the last one.
    """

    def wanted(entries: Column) -> Column:
        return F.map_filter(entries, lambda k, v: k.isin(EXIF_KEYS))

    maps = [wanted(texts)]
    if binaries is not None:
        short = F.transform_values(
            wanted(binaries),
            lambda k, v: F.when(
                F.octet_length(v) <= 32, F.replace(F.make_valid_utf8(v.cast("string")), F.lit("�"), F.lit(""))
            ).otherwise(F.concat(F.lit("bytes["), F.octet_length(v).cast("string"), F.lit("]"))),
        )
        maps.append(short)
    if lists is not None:
        shown = F.transform_values(
            wanted(lists),
            lambda k, v: F.concat(
                F.lit("["),
                F.array_join(
                    F.transform(F.slice(v, 1, 20), lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "
                ),
                F.lit("]"),
            ),
        )
        maps.append(shown)
    # Maps keep the order of their entries; a null value stands for a key that no map has.
    entries = [F.struct(F.lit(k).alias("key"), F.coalesce(*[F.try_element_at(m, F.lit(k)) for m in reversed(maps)]).alias("value")) for k in EXIF_KEYS]
    known = F.flatten(F.array(*[F.coalesce(F.map_keys(m), F.array().cast("array<string>")) for m in maps]))
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: F.array_contains(known, e["key"])))


def image_text(ocr_lang: str, with_front_matter: bool = True) -> Column:
    """Markdown of an image row with file_name, sha256, file_size, file_modified_time, `exif` (map) and
    recognized `text`."""
    header = front_matter([
        ("source_file", F.col("file_name")),
        ("provider", F.lit("local-ocr")),
        ("hash_sha256", F.col("sha256")),
        ("file_size", F.col("file_size")),
        ("modified_time", _iso(F.col("file_modified_time"))),
        ("exif", MapField(F.col("exif"))),
        ("ocr_lang", F.lit(ocr_lang)),
    ])
    body = F.nullif(F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", ""), F.lit(""))
    parts = [header] if with_front_matter else []
    return F.concat(F.concat_ws("\n\n", *parts, F.concat(F.lit("# "), "file_name"), body), F.lit("\n"))


def image_markdown(images: DataFrame, ocr_lang: str, with_front_matter: bool = True) -> DataFrame:
    """(file_path, markdown_content) of images with the columns of `image_text`."""
    return images.select("file_path", image_text(ocr_lang, with_front_matter).alias("markdown_content"))
