"""Uploaded files: reading, names, types and content checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Aliases of types, and each type's extensions and first bytes (position from 1, hexadecimal).
ALIASES = {"image/jpg": "image/jpeg", "image/pjpeg": "image/jpeg", "audio/x-wav": "audio/wav", "audio/wave": "audio/wav", "audio/vnd.wave": "audio/wav", "audio/mp3": "audio/mpeg", "audio/x-m4a": "audio/mp4"}
EXTENSIONS = {
    "application/pdf": [".pdf"], "image/jpeg": [".jpg", ".jpeg"], "image/png": [".png"], "image/webp": [".webp"], "text/plain": [".txt"],
    "audio/mpeg": [".mp3"], "audio/wav": [".wav"], "audio/webm": [".webm", ".weba"], "audio/mp4": [".m4a", ".mp4"],
}
MAGIC = {"application/pdf": [(1, "255044462D")], "image/jpeg": [(1, "FFD8FF")], "image/png": [(1, "89504E470D0A1A0A")], "image/webp": [(1, "52494646"), (9, "57454250")], "audio/wav": [(1, "52494646"), (9, "57415645")], "audio/webm": [(1, "1A45DFA3")], "audio/mp4": [(5, "66747970")]}
REPORT_TYPES = ["application/pdf", "image/jpeg", "image/png", "image/webp", "text/plain", "audio/mpeg", "audio/wav"]


def load_files(spark: SparkSession, path: str, most_files: int = 5, most_bytes: int = 15 * 1024 * 1024) -> DataFrame:
    """Files of batches (the parent folder), with what is over the limits marked in ``rejected``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).withColumn("batch", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1))
    rank = F.row_number().over(Window.partitionBy("batch").orderBy("path"))
    return files.withColumn("rejected", F.when(F.col("length") > most_bytes, "too_large").when(rank > most_files, "too_many_files"))


def normalize_mime(mime: Column) -> Column:
    """S3: without parameters, lower case, aliases resolved."""
    base = F.lower(F.trim(F.split(mime, ";")[0]))
    known = F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, base), base)


def safe_filename(name: Column) -> Column:
    """The last part of a path with odd characters as underscores, no leading dots, its last 100 characters; ``upload`` if nothing is
    left. Null stays null."""
    base = F.element_at(F.split(F.regexp_replace(F.replace(name, F.lit("\\"), F.lit("/")), "/+$", ""), "/"), -1)
    cleaned = F.right(F.regexp_replace(F.regexp_replace(base, r"[^\w.\- ]+", "_"), r"^\.+", ""), F.lit(100))
    return F.when(cleaned == "", "upload").otherwise(cleaned)


def sniff(mime: Column, content: Column) -> Column:
    """Whether the first bytes are those of the type; a text must be UTF-8 without NUL."""
    at = lambda p, h: F.hex(F.substring(content, p, len(h) // 2)) == h
    out = F.lit(False)
    for kind, marks in MAGIC.items():
        fine = F.lit(True)
        for p, h in marks:
            fine = fine & at(p, h)
        out = F.when(mime == kind, fine).otherwise(out)
    two = F.conv(F.hex(F.substring(content, 1, 2)), 16, 10).cast("int")
    out = F.when(mime == "audio/mpeg", at(1, "494433") | ((F.octet_length(content) > 1) & (two.bitwiseAND(0xFFE0) == 0xFFE0))).otherwise(out)
    text = content.cast("string")
    return F.when(mime == "text/plain", F.is_valid_utf8(text) & (F.instr(text, "\x00") == 0)).otherwise(out)


def audit(files: DataFrame, name: str, mime: str, content: str, allowed: list[str] = REPORT_TYPES) -> DataFrame:
    """Adds ``mime_type``, ``safe_name``, ``status`` (415, 400 or null) and ``reason``; the first failed rule counts."""
    kind = normalize_mime(F.col(mime))
    ends = F.lower(F.regexp_extract(F.col(name), r"(\.[^./\\]*)$", 1))
    own = F.create_map(*(x for k, v in EXTENSIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    reason = (
        F.when(kind.isNull() | ~kind.isin(allowed), "unsupported_type")
        .when(~F.array_contains(F.try_element_at(own, kind), ends), "extension_mismatch")
        .when(F.col(content).isNull() | (F.octet_length(content) == 0), "empty")
        .when(~sniff(kind, F.col(content)), "content_mismatch")
    )
    out = files.withColumn("mime_type", kind).withColumn("safe_name", safe_filename(F.col(name))).withColumn("reason", reason)
    return out.withColumn("status", F.when(F.col("reason") == "empty", 400).when(F.col("reason").isNotNull(), 415))
