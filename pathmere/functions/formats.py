"""File-format lookup by extension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Common extensions by category, capability and binary flag. Callers with
# other formats pass their own table to ``with_format_info``.
KNOWN_FORMATS = [
    ("image", "rendered", True, "apng bmp cur dib emf gif ico jfif jpeg jpg png tif tiff wmf "
                                "avif dds heic heif jp2 tga webp"),
    ("image", "thumbnail", True, "arw cr2 cr3 dng nef orf pef psb psd raf raw"),
    ("vector", "extracted", False, "svg"),
    ("vector", "extracted", True, "svgz ai eps ps"),
    ("font", "rendered", True, "otf ttc ttf"),
    ("font", "metadata", True, "woff woff2 eot"),
    ("document", "extracted", True, "xls xlt msg oft docm docx dotm dotx odg odp ods odt potx ppsx "
                                    "pptm pptx rtf vsdx xlsm xlsx xltx xps oxps ost pst chm djvu"),
    ("document", "metadata", True, "doc dot pot pps ppt pdf"),
    ("document", "extracted", False, "eml emlx mbox mht mhtml"),
    ("ebook", "extracted", True, "epub azw azw3 mobi prc fbz"),
    ("ebook", "extracted", False, "fb2"),
    ("archive", "extracted", True, "apk jar nupkg war zip tar tgz gz 7z cab iso rar bz2 xz zst lz4 "
                                   "wim lha lzh zipx"),
    ("audio", "metadata", True, "aac aiff amr ape flac m4a mid midi mka mp3 oga ogg opus wav wma"),
    ("video", "thumbnail", True, "3gp avi flv m2ts m4v mkv mov mp4 mpeg mpg mts ts vob webm wmv"),
    ("cad", "extracted", True, "glb gltf obj ply stl"),
    ("cad", "extracted", False, "dxf"),
    ("cad", "metadata", True, "dwg"),
    ("binary", "metadata", True, "dll exe msi sys lnk db avro arrow feather orc vhd vhdx"),
    ("binary", "extracted", True, "evtx dbf sqlite sqlite3 class wasm dmp parquet pcap torrent mdb accdb"),
    ("text", "metadata", False, "url"),
    ("text", "extracted", False, "contact ics ldif vcard vcf vcs htm html m3u markdown md srt vtt xhtml"),
]
MULTIPART = r"(?i)(\.(7z|zip)\.[0-9]{3}|\.part[0-9]+\.rar|\.[rz][0-9]{2})$"

# Extension lists of the type presets.
TYPE_PRESETS = {
    "documents": ["doc", "docx", "odt", "pdf", "ppt", "pptx", "rtf", "txt", "xls", "xlsx"],
    "images": ["bmp", "gif", "jpeg", "jpg", "png", "svg", "tif", "tiff", "webp"],
    "videos": ["avi", "m4v", "mkv", "mov", "mp4", "mpeg", "mpg", "webm", "wmv"],
}


def known_format_rows() -> list[tuple[str, str, str, bool]]:
    return [
        (ext, category, capability, binary)
        for category, capability, binary, exts in KNOWN_FORMATS
        for ext in exts.split()
    ]


def format_table(spark: SparkSession) -> DataFrame:
    """The bundled formats as a dimension table (fixed size, under 200 rows)."""
    return spark.createDataFrame(
        known_format_rows(),
        "ext string, category string, capability string, is_binary boolean",
    )


def is_multipart(name: Column) -> Column:
    return name.rlike(MULTIPART)


def with_format_info(df: DataFrame, formats: DataFrame | None = None) -> DataFrame:
    """Add category, capability and is_binary to rows with ``name`` and ``ext``.

    Compound names win over the last extension: ``.fb2.zip`` is an e-book, numbered parts
    are archives. The join is left to the optimizer, which broadcasts small tables only.
    """
    formats = format_table(df.sparkSession) if formats is None else formats
    fb2_zip = F.lower("name").endswith(".fb2.zip")
    key = F.when(fb2_zip, "fbz").otherwise(F.col("ext"))
    part = is_multipart(F.col("name"))
    found = formats.select(
        F.col("ext").alias("_format"),
        F.col("category").alias("_category"),
        F.col("capability").alias("_capability"),
        F.col("is_binary").alias("_binary"),
    )
    joined = df.withColumn("_key", key).join(found, F.col("_key") == F.col("_format"), "left")
    return joined.withColumns(
        {
            "category": F.when(part, "archive").otherwise(F.coalesce("_category", F.lit("unknown"))),
            "capability": F.when(part, "extracted").otherwise(F.coalesce("_capability", F.lit("none"))),
            "is_binary": F.when(part, True).otherwise(F.coalesce("_binary", F.lit(False))),
        }
    ).drop("_key", "_format", "_category", "_capability", "_binary")
