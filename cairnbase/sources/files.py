"""Files as tables: hashes, formats, page links, image headers."""

from __future__ import annotations

import mimetypes
import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType


def scan_folder(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """content_hash, path, filename, format, mime, byte_size of the files of a folder, dot files left out, by path."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return describe_files(raw).orderBy("path")


def describe_files(raw: DataFrame) -> DataFrame:
    """The columns of scan_folder() from binary files (path, content, length)."""
    name = F.element_at(F.split("path", "/"), -1)
    fmt = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    known = sorted({e[1:]: m for e, m in mimetypes.types_map.items()}.items())
    mime = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in known for x in pair]), fmt), F.lit("application/octet-stream"))
    return raw.where(~name.startswith(".")).select(F.sha2("content", 256).alias("content_hash"), "path", name.alias("filename"), fmt.alias("format"), mime.alias("mime"), F.length("content").cast("long").alias("byte_size"))


def upsert_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """Files by content hash: equal bytes are one file, whose path and name are the newest."""
    from ..operators.mutate import upsert

    return upsert(old, new, "content_hash")


def image_size(data: bytes) -> tuple[int, int] | None:
    """Width and height from a PNG, GIF, BMP or JPEG header."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return struct.unpack(">II", data[16:24])
    if data[:3] == b"GIF":
        return struct.unpack("<HH", data[6:10])
    if data[:2] == b"BM":
        w, h = struct.unpack("<ii", data[18:26])
        return w, abs(h)
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data) and data[at] == 0xFF:
            marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                return int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
            at += 2 + size
    return None


@F.pandas_udf(StructType([StructField("width", IntegerType()), StructField("height", IntegerType())]))
def image_dims(content: pd.Series) -> pd.DataFrame:
    """Sizes of images; null where the header is not known."""
    return pd.DataFrame([image_size(c) or (None, None) for c in content], columns=["width", "height"]).astype("Int32")


def exif_fields(data: bytes) -> dict[str, object]:
    """datetime text and GPS parts of a JPEG's EXIF block, as far as they are there."""
    at = data.find(b"Exif\0\0")
    if at < 0:
        return {}
    tiff = data[at + 6 :]
    order = "<" if tiff[:2] == b"II" else ">"
    sizes = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}

    def entries(where: int) -> dict[int, object]:
        out = {}
        (n,) = struct.unpack_from(order + "H", tiff, where)
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", tiff, where + 2 + 12 * i)
            size = sizes.get(kind, 0) * count
            place = where + 10 + 12 * i if size <= 4 else struct.unpack_from(order + "I", tiff, where + 10 + 12 * i)[0]
            if kind == 2:
                out[tag] = tiff[place : place + count].split(b"\0")[0].decode("ascii", "replace")
            elif kind in (3, 4):
                out[tag] = struct.unpack_from(order + ("H" if kind == 3 else "I"), tiff, place)[0]
            elif kind == 5:
                parts = struct.unpack_from(order + "II" * count, tiff, place)
                out[tag] = [a / b if b else 0.0 for a, b in zip(parts[::2], parts[1::2], strict=True)]
        return out

    try:
        top = entries(struct.unpack_from(order + "I", tiff, 4)[0])
        inner = entries(top[0x8769]) if isinstance(top.get(0x8769), int) else {}
        gps = entries(top[0x8825]) if isinstance(top.get(0x8825), int) else {}
    except struct.error:
        return {}
    return {"taken": inner.get(0x9003) or top.get(0x0132), "lat": gps.get(2), "lat_ref": gps.get(1), "lon": gps.get(4), "lon_ref": gps.get(3)}


_EXIF = StructType([
    StructField("taken", StringType()), StructField("lat", ArrayType(DoubleType())), StructField("lat_ref", StringType()),
    StructField("lon", ArrayType(DoubleType())), StructField("lon_ref", StringType()),
])


@F.pandas_udf(_EXIF)
def exif(content: pd.Series) -> pd.DataFrame:
    rows = [exif_fields(c) for c in content]
    return pd.DataFrame({k: pd.Series([r.get(k) for r in rows], dtype=object) for k in ("taken", "lat", "lat_ref", "lon", "lon_ref")})


def with_exif(images: DataFrame, content: str = "content") -> DataFrame:
    """Adds exif_datetime, gps_lat, gps_lon; null where there are none or they cannot be read."""
    from ..functions.text import dms_to_degrees

    e = images.withColumn("_e", exif(F.col(content)))
    deg = lambda c, r: F.when(F.size(c) == 3, dms_to_degrees(F.get(c, F.lit(0)), F.get(c, F.lit(1)), F.get(c, F.lit(2)), r))
    return e.withColumns({
        "exif_datetime": F.try_to_timestamp(F.col("_e.taken"), F.lit("yyyy:MM:dd HH:mm:ss")),
        "gps_lat": deg(F.col("_e.lat"), F.col("_e.lat_ref")), "gps_lon": deg(F.col("_e.lon"), F.col("_e.lon_ref")),
    }).drop("_e")


def nearest_place(images: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Adds geo_country, geo_place of the nearest point of a gazetteer (lat, lon, country, place) in the same or a
    neighbouring degree cell; null without a position or a point that near."""
    cell = lambda lat, lon: (F.floor(lat).alias("cy"), F.floor(lon).alias("cx"))
    g = gazetteer.select(F.col("lat").alias("g_lat"), F.col("lon").alias("g_lon"), "country", "place", *cell(F.col("lat"), F.col("lon")))
    near = F.array(*[F.struct((F.floor("gps_lat") + dy).alias("cy"), (F.floor("gps_lon") + dx).alias("cx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    asked = images.select("file_id", "gps_lat", "gps_lon").where("gps_lat is not null and gps_lon is not null").withColumn("c", F.explode(near)).select("file_id", "gps_lat", "gps_lon", "c.*")
    far = F.pow(F.col("g_lat") - F.col("gps_lat"), 2) + F.pow((F.col("g_lon") - F.col("gps_lon")) * F.cos(F.radians("gps_lat")), 2)
    best = asked.join(g, ["cy", "cx"]).groupBy("file_id").agg(F.min_by(F.struct(F.col("country").alias("geo_country"), F.col("place").alias("geo_place")), F.struct(far, F.col("place"))).alias("b")).select("file_id", "b.*")
    return images.drop("geo_country", "geo_place").join(best, "file_id", "left")


def html_links(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, ord, href of the links of each page."""
    return pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))).alias("ord", "href"))


def html_headings(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, ord, level, title of the headings of each page."""
    found = F.regexp_extract_all(html, F.lit(r"(?s)<h([1-6])[^>]*>.*?</h[1-6]>"), F.lit(0))
    h = pages.select(key, F.posexplode(found).alias("ord", "h"))
    title = F.trim(F.regexp_replace("h", "(?s)<[^>]*>", ""))
    return h.select(key, "ord", F.regexp_extract("h", "^<h([1-6])", 1).cast("int").alias("level"), title.alias("title"))


def best_figures(figures: DataFrame, least: int = 64) -> DataFrame:
    """Rasters of a file once each (first page wins), both sides at least ``least`` pixels."""
    from pyspark.sql import Window

    rn = F.row_number().over(Window.partitionBy("file_id", "xref").orderBy("page"))
    return figures.where((F.col("width") >= least) & (F.col("height") >= least)).withColumn("rn", rn).where("rn = 1").drop("rn")
