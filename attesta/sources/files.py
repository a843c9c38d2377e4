"""Arriving files: routing, limits, de-duplication and storage keys."""

from __future__ import annotations

import mimetypes

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


# Which extension goes which way.
EXTENSIONS = {
    "pdf": ["pdf"],
    "hwp": ["hwp", "hwpx"],
    "office": ["docx", "doc", "xlsx", "xls", "pptx", "ppt", "odt", "ods", "odp", "rtf"],
    "text": ["txt", "md", "markdown", "csv", "tsv", "log", "json"],
    "image": ["png", "jpg", "jpeg", "webp", "tif", "tiff", "bmp", "gif"],
    "audio": ["mp3", "wav", "m4a", "flac", "ogg", "aac", "wma", "opus"],
    "video": ["mp4", "mkv", "mov", "avi", "webm", "wmv", "flv", "m4v"],
}
MEDIA_KINDS = ["audio", "video"]
MAX_UPLOAD_MB = 512


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Raw files as (filename, size_bytes, content, arrival)."""
    found = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
             .option("recursiveFileLookup", "true").load(path))
    return found.select(F.regexp_extract("path", "[^/]+$", 0).alias("filename"),
                        F.col("length").alias("size_bytes"), "content",
                        F.col("modificationTime").alias("arrival"))


def guessed_mime(ext: Column) -> Column:
    """Media family the standard registry gives an extension, as ``family/*``."""
    families: dict[str, list[str]] = {}
    for suffix, mime in mimetypes.MimeTypes().types_map[True].items():
        family = mime if mime == "application/pdf" else mime.split("/")[0] + "/*"
        families.setdefault(family, []).append(suffix.lstrip("."))
    guess = F.lit(None).cast("string")
    for family in ("application/pdf", "image/*", "audio/*", "video/*", "text/*"):
        guess = F.when(ext.isin(families.get(family, [])), family).otherwise(guess)
    return guess


def classify_source(files: DataFrame) -> DataFrame:
    """Add ``source_kind``: by extension, then by MIME type; null marks a reject."""
    ext, mime = F.col("__ext"), F.col("__mime")
    kind = F.lit(None).cast("string")
    for family in ("text", "video", "audio", "image"):
        kind = F.when(F.startswith(mime, F.lit(family + "/")), family).otherwise(kind)
    kind = F.when(mime == "application/pdf", "pdf").otherwise(kind)
    for name, extensions in EXTENSIONS.items():
        kind = F.when(ext.isin(extensions), name).otherwise(kind)
    return (files.withColumn("__ext", F.lower(F.regexp_extract("filename", r"[^/]\.([^/.]+)$", 1)))
            .withColumn("__mime", F.coalesce(F.nullif("mime", F.lit("")), guessed_mime(ext)))
            .withColumn("source_kind", kind).drop("__ext", "__mime"))


def split_rejected(classified: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with a reason)."""
    ok = classified.filter("source_kind IS NOT NULL")
    bad = classified.filter("source_kind IS NULL").withColumn("reason", F.lit("unsupported file type"))
    return ok, bad


def is_media(kind: Column | str) -> Column:
    """Transcript route (true) or page route."""
    return (F.col(kind) if isinstance(kind, str) else kind).isin(MEDIA_KINDS)


def size_filter(files: DataFrame, max_mb: float = MAX_UPLOAD_MB) -> tuple[DataFrame, DataFrame]:
    """(within the limit, too large with a reason)."""
    limit = int(max_mb * 1024 * 1024)
    fits = files.filter(F.col("size_bytes") <= limit)
    large = files.filter(F.col("size_bytes") > limit).withColumn("reason", F.lit("too large"))
    return fits, large


def with_hash(files: DataFrame, content: str = "content") -> DataFrame:
    return files.withColumn("sha256", F.sha2(F.col(content).cast("binary"), 256))


def dedupe_by_hash(files: DataFrame, existing: DataFrame) -> DataFrame:
    """Map every upload to the one document with its bytes.

    ``files``: file_id, sha256, arrival; ``existing``: document_id, sha256. Adds
    ``document_id`` (the existing document or the first upload) and ``is_new``. Only
    ids and hashes are compared, and the first upload of each hash comes from a
    map-side combined minimum, so many copies of one file are no hot spot.
    """
    slim = files.select("file_id", "sha256", "arrival")
    first = slim.groupBy("sha256").agg(
        F.min_by("file_id", F.struct("arrival", "file_id")).alias("first_id"))
    known = existing.select("sha256", F.col("document_id").alias("known_id"))
    owner = first.join(known, "sha256", "left")
    return (files.join(owner, "sha256")
            .withColumn("document_id", F.coalesce("known_id", "first_id"))
            .withColumn("is_new", F.col("known_id").isNull() & (F.col("file_id") == F.col("first_id")))
            .drop("known_id", "first_id"))


def shard_key(prefix: str | Column, sha: Column | str, suffix: str | Column) -> Column:
    """``prefix/aa/bb/<sha><suffix>``."""
    lit = lambda v: F.lit(v) if isinstance(v, str) else v
    sha = F.col(sha) if isinstance(sha, str) else sha
    return F.concat_ws("/", lit(prefix), sha.substr(1, 2), sha.substr(3, 2), F.concat(sha, lit(suffix)))


def latest_by_name(documents: DataFrame) -> DataFrame:
    """Newest ready document per filename; the larger id on equal times."""
    ready = documents.filter("status = 'ready'")
    newest = ready.groupBy("filename").agg(
        F.max(F.struct("created_at", "document_id")).alias("__top"))
    return newest.select("filename", F.col("__top.document_id").alias("document_id"),
                         F.col("__top.created_at").alias("created_at"))


def relabel_scanned(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """A PDF none of whose pages has a text layer is ``scanned``."""
    no_text = (pages.groupBy("document_id").agg(F.bool_and(~F.col("has_text_layer")).alias("__scan"))
               .filter("__scan"))
    return (documents.join(no_text, "document_id", "left")
            .withColumn("source_kind", F.when((F.col("source_kind") == "pdf") & F.coalesce("__scan", F.lit(False)),
                                              "scanned").otherwise(F.col("source_kind")))
            .drop("__scan"))


