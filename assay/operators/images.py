"""Image jobs: one row per image, partitioned by Spark; numpy only inside the tasks.

Encoded files come as (path, content) rows; decoded ones as (width, height, pixels) with 8-bit
gray pixels in row order. Each batch is handled image by image and nothing is gathered.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from assay.functions.hashing import md5_uniform
from assay.session import staged

# Color types of the PNG header and JPEG frame markers without the three tables.
PNG_MODES = {0: "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}
PNG_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
JPEG_FRAMES = set(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}
IMAGE = "image struct<origin: string, height: int, width: int, nChannels: int, mode: int, data: binary>"
#: The object whose ``decode`` Spark's image source calls with the bytes of every file.
DECODER = "org.apache.spark.ml.image.ImageSchema$"
#: Files that one task of decode_check reads, one after another.
FILES_PER_TASK = 2_000
#: Bytes of staged images that a task collects before it writes them, and the least that one task reads.
ROW_GROUP = 16 << 20
#: Images that a task holds as Python objects at once.
IMAGES_AT_ONCE = 256
JPEG_MODES = {1: "L", 3: "RGB", 4: "CMYK"}


def header(content: bytes) -> tuple[int, int, str] | None:
    """(width, height, mode) from a PNG or JPEG header, None when there is none."""
    if content[:8] == b"\x89PNG\r\n\x1a\n" and len(content) >= 26:
        w, h, _, color = struct.unpack(">IIBB", content[16:26])
        return (w, h, PNG_MODES[color]) if color in PNG_MODES else None
    if content[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 9 <= len(content) and content[at] == 0xFF:
        marker, size = content[at + 1], int.from_bytes(content[at + 2:at + 4], "big")
        if marker in JPEG_FRAMES:
            h, w = struct.unpack(">HH", content[at + 5:at + 9])
            return w, h, JPEG_MODES.get(content[at + 9], "?") if at + 9 < len(content) else "?"
        at += 2 + size
    return None


def png_is_whole(content: bytes) -> bool:
    """Chunks complete with right checksums, and as many pixel bytes as the header promises."""
    head = header(content)
    if head is None or content[:4] != b"\x89PNG":
        return False
    at, data = 8, []
    while at + 12 <= len(content):
        size = int.from_bytes(content[at:at + 4], "big")
        kind, body = content[at + 4:at + 8], content[at + 8:at + 8 + size]
        if len(body) < size or zlib.crc32(kind + body) != int.from_bytes(content[at + 8 + size:at + 12 + size], "big"):
            return False
        if kind == b"IDAT":
            data.append(body)
        if kind == b"IEND":
            depth, color = content[24], content[25]
            row = (head[0] * PNG_CHANNELS[color] * depth + 7) // 8 + 1
            try:
                return len(zlib.decompress(b"".join(data))) == row * head[1]
            except zlib.error:
                return False
        at += 12 + size
    return False


def is_whole(content: bytes) -> bool:
    """Is a PNG complete and unharmed, or a JPEG complete from its header to its end marker?"""
    if content[:2] == b"\xff\xd8":
        return header(content) is not None and content.rstrip(b"\0")[-2:] == b"\xff\xd9"
    return png_is_whole(content)


def header_profile(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """Width, height, mode, size in KiB and readability per file, from the header alone."""
    kind = dict(files.dtypes)[key]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            heads = [header(bytes(c)) for c in pdf[content]]
            yield pd.DataFrame({
                key: pdf[key],
                "width": pd.array([h[0] if h else None for h in heads], dtype="Int32"),
                "height": pd.array([h[1] if h else None for h in heads], dtype="Int32"),
                "mode": [h[2] if h else None for h in heads],
                "kib": [len(c) // 1024 for c in pdf[content]],
                "readable": [h is not None for h in heads],
            })

    return files.select(key, content).mapInPandas(read, f"{key} {kind}, width int, height int, mode string, kib bigint, readable boolean")


def decode_folder(spark: SparkSession, path: str) -> DataFrame:
    """Decode with Spark's image source; a corrupt file keeps its row with ``ok`` false."""
    images = spark.read.format("image").option("dropInvalid", "false").schema(IMAGE).load(path)
    return images.select("image.origin", "image.width", "image.height", "image.nChannels", "image.data", (F.col("image.width") > 0).alias("ok"))


def decodes(spark: SparkSession, content: str) -> Column:
    """Does the decoder of Spark's image source make pixels of the bytes in this column? NULL bytes give false.

    The source takes only paths, and a file for every image costs milliseconds and a place in the driver's list. What it calls with
    the bytes of a file is called here with those of a row. ImageIO would copy them to a file of its own to read them from, which is
    switched off in the JVM of the task before the first call; a full disk can then not pass for a corrupt image either.
    """
    jvm = spark._jvm
    objects, functions = jvm.org.apache.spark.sql.catalyst.expressions, jvm.org.apache.spark.sql.classic.ExpressionUtils
    load = jvm.java.lang.Thread.currentThread().getContextClassLoader().loadClass

    def kind(name: str):
        return jvm.org.apache.spark.sql.types.ObjectType(load(name))

    def fixed(value, name: str):
        return objects.Literal(value, kind(name))

    def call(on, method: str, gives, *given):
        """NULL arguments are passed on; the result may be NULL and depends on the arguments alone."""
        return objects.objects.Invoke(on, method, gives, jvm.PythonUtils.toSeq(list(given)), jvm.PythonUtils.toSeq([]), False, True, True)

    uncached = F.reflect(F.lit("javax.imageio.ImageIO"), F.lit("setUseCache"), F.lit(False))
    origin = call(functions.expression(uncached._jc), "toString", kind("java.lang.String"))  # evaluated first; goes into the decoded row only
    decoder = call(fixed(load(DECODER), "java.lang.Class"), "getField", kind("java.lang.reflect.Field"), fixed("MODULE$", "java.lang.String"))
    decoder = call(decoder, "get", kind(DECODER), fixed(None, "java.lang.Object"))
    image = call(decoder, "decode", kind("scala.Option"), origin, functions.expression(F.col(content)._jc))
    return Column(functions.column(call(image, "isDefined", jvm.org.apache.spark.sql.types.DataType.fromDDL("boolean"))))


def decode_check(files: DataFrame, key: str, fraction: float, seed, content: str = "content") -> DataFrame:
    """Decode a seeded fraction of files with the decoder of Spark's image source and flag the corrupt ones.

    The picked rows are staged and decoded where they lie, so no file is written for an image and the driver lists none. The decoder
    fills what a cut JPEG lacks and reads PNG chunks with wrong checksums, so a file must decode and be whole. Keys stay out of Python.
    """
    spark = files.sparkSession
    picked = files.filter(md5_uniform(seed, key) < fraction).select(F.monotonically_increasing_id().alias("number"), F.col(key), F.col(content).alias("content"))
    picked = staged(picked, "picked", **{"parquet.block.size": ROW_GROUP})
    # However many small parts were staged, few tasks read them: each task reports kilobytes to the driver.
    picked = picked.coalesce(max(spark.sparkContext.defaultParallelism, -(-picked.count() // FILES_PER_TASK)))

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"number": pdf["number"], "sound": [ok and is_whole(bytes(c)) for ok, c in zip(pdf["ok"], pdf["content"])]})

    sound = picked.select("number", "content", decodes(spark, "content").alias("ok")).mapInPandas(check, "number bigint, sound boolean")
    return picked.select("number", key).join(sound, "number", "left").select(key, (~F.coalesce("sound", F.lit(False))).alias("corrupt"))


def fit_geometry(w: Column, h: Column, width: int, height: int) -> dict[str, Column]:
    """Size and offset of an image scaled into width x height and centred."""
    scale = F.least(F.lit(width) / w, F.lit(height) / h)
    new_w = F.greatest(F.lit(1), F.bround(w * scale)).cast("int")
    new_h = F.greatest(F.lit(1), F.bround(h * scale)).cast("int")
    return {"new_w": new_w, "new_h": new_h, "left": F.floor((F.lit(width) - new_w) / 2).cast("int"), "top": F.floor((F.lit(height) - new_h) / 2).cast("int")}


def to_channels(img: np.ndarray, mean: tuple, std: tuple) -> np.ndarray:
    """Gray 0..255 to three normalized float channels."""
    unit = img.astype(np.float32) / 255
    return np.stack([(unit - m) / s for m, s in zip(mean, std)]).astype(np.float32)


def map_pixels(images: DataFrame, fn: Callable[[np.ndarray], list[dict]], schema: str, key: str = "image_id", extra: tuple[str, ...] = ()) -> DataFrame:
    """Apply ``fn`` to the gray pixels of every image; it returns any number of rows.

    With ``extra`` columns, ``fn`` also gets the image's row. Batches are cut where they lie in Arrow: a task holds
    IMAGES_AT_ONCE images as Python objects.
    """
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, IMAGES_AT_ONCE):
                rows = []
                for r in batch.slice(at, IMAGES_AT_ONCE).to_pylist():
                    img = np.frombuffer(r["pixels"], np.uint8).reshape(r["h"], r["w"])
                    rows += [{key: r[key], **row} for row in (fn(img, r) if extra else fn(img))]
                if rows:
                    yield pa.RecordBatch.from_pandas(pd.DataFrame(rows), schema=arrow, preserve_index=False)

    return images.select(key, "w", "h", "pixels", *extra).mapInArrow(run, schema)


def in_pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """IMAGES_AT_ONCE rows at a time, so that a task holds few images whatever the batches are."""
    for pdf in batches:
        for at in range(0, len(pdf), IMAGES_AT_ONCE):
            yield pdf.iloc[at : at + IMAGES_AT_ONCE]


def intensity_row(img: np.ndarray, bins: int = 50) -> dict:
    hist = np.bincount(np.minimum(img.ravel().astype(np.int64) * bins // 256, bins - 1), minlength=bins)
    return {"low": int(img.min()), "high": int(img.max()), "mean": float(img.mean()), "hist": hist.tolist()}


def drawn_parameters(df: DataFrame, key: str, seed, epoch: int, ops: dict[str, tuple[float, float, float]]) -> DataFrame:
    """Augmentation parameters per image: op -> (probability, low, high), each rolled on its own.

    NULL means that the op is not applied.
    """
    out = df
    for op, (p, low, high) in ops.items():
        roll = md5_uniform(f"{seed}:{epoch}:{op}:roll", key)
        value = md5_uniform(f"{seed}:{epoch}:{op}:value", key)
        out = out.withColumn(op, F.when(roll < p, low + value * (high - low)))
    return out


def score_columns(df: DataFrame, keep: list[str], outputs: dict[str, Column]) -> DataFrame:
    """Deterministic batch scoring: every output is a column expression over the row."""
    return df.select(*keep, *[c.alias(n) for n, c in outputs.items()])


def closest(df: DataFrame, key: str, value: str, target: float) -> DataFrame:
    """The row whose value is nearest the target, the lowest key among equals."""
    pick = F.min(F.struct(F.abs(F.col(value) - target).alias("gap"), F.col(key), F.col(value)))
    return df.agg(pick.alias("_p")).select(f"_p.{key}", f"_p.{value}", "_p.gap")
