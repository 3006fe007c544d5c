"""Images through a chain of providers whose attempts come as a table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkdocs.convert.media import image_text
from sparkdocs.functions.text import content_hash
from sparkdocs.operators.fallback import ALL_FAILED, first_success

# The provider that reads text itself, and what is stored if none was asked.
LOCAL = "local"
NONE_TRIED = "no providers attempted"


@dataclass(frozen=True)
class ImageSources:
    """Side tables of images and how they are used.

    `attempts` has (path, provider, attempt_no, ok, content, error), the path being that of the file;
    `exif` has (file_path, exif: map<string,string>), see `media.exif_keep`.
    """

    attempts: DataFrame
    primary: str
    chain: list[str]
    exif: DataFrame | None = None
    ocr_lang: str = "eng"
    with_front_matter: bool = True


def image_frame(sources: ImageSources):
    """Frame converter for image rows: the first provider that succeeds gives the content.

    Text of the local provider gets the front matter of the image; a caption of another one is taken as it
    is, a blank one leaves the title. Attempts of other files and the EXIF maps of rows that no local
    provider won are not moved.
    """

    def convert(rows: DataFrame) -> DataFrame:
        named = rows.select("file_path")
        attempts = sources.attempts.join(named, F.col("path") == F.col("file_path"), "left_semi")
        won = first_success(attempts, sources.primary, sources.chain).select(
            F.col("path").alias("_path"), F.col("success").alias("_won"), F.lower("provider").alias("_provider"),
            F.col("content").alias("_content"), F.col("error_message").alias("_error"),
        )
        joined = rows.join(won, F.col("file_path") == F.col("_path"), "left")
        if sources.exif is None:
            joined = joined.withColumn("exif", F.lit(None).cast("map<string,string>"))
        else:
            maps = sources.exif.select(F.col("file_path").alias("_exif_path"), "exif")
            joined = joined.join(maps, (F.col("file_path") == F.col("_exif_path")) & (F.col("_provider") == LOCAL), "left")
        text = image_text(sources.ocr_lang, sources.with_front_matter)
        blank = F.trim(F.coalesce("_content", F.lit(""))) == ""
        caption = F.when(blank, F.concat(F.lit("# "), "file_name", F.lit("\n\n"))).otherwise(F.col("_content"))
        made = joined.withColumn("sha256", F.when(F.col("_provider") == LOCAL, content_hash(F.col("content")))).withColumn("text", F.col("_content"))
        return made.select(
            *[F.col(c) for c in rows.columns if c not in ("text", "content")],
            F.when(F.col("_won"), F.when(F.col("_provider") == LOCAL, text).otherwise(caption)).alias("markdown_content"),
            F.coalesce("_error", F.lit(ALL_FAILED + NONE_TRIED)).alias("error_message"),
        )

    return convert
