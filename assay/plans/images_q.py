"""IMG queries and LAB-12, on images that Spark derives from the rows of ``part``."""

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from assay.functions.hashing import md5_uniform_sql
from assay.operators import images as I
from assay.operators import labels as L
from assay.operators import profile as P
from assay.plans.profile_q import rounded
from assay.plans.registry import query
from assay.plans.views import TASKS, image_sizes, table, wide_labels

# A tenth of the file sizes; the gray value at (row, column) is a plain function of the key.
PIXELS_SQL = """px as (select p_partkey as image_id, 24 + (p_partkey * 37) % 5 * 6 as w, 32 + (p_size % 3) * 8 as h from part),
cells as (select image_id, w, h, (image_id * 31 + r * 7 + c * 13) % 256 as v from (select *, unnest(range(h)) as r from px), (select unnest(range(48)) as c) where c < w)"""


def pixels(spark, sf):
    """Gray images of about 40 x 40, one per part."""
    base = table(spark, sf, "part").selectExpr("p_partkey as image_id", "cast(24 + (p_partkey * 37) % 5 * 6 as int) as w", "cast(32 + (p_size % 3) * 8 as int) as h")
    base = base.repartition(spark.sparkContext.defaultParallelism, "image_id")  # few bytes per row, much work

    def draw(batches):
        for pdf in I.in_pieces(batches):
            shots = [((i * 31 + np.arange(h)[:, None] * 7 + np.arange(w) * 13) % 256).astype(np.uint8).tobytes() for i, w, h in zip(pdf["image_id"], pdf["w"], pdf["h"])]
            yield pdf.assign(pixels=shots)

    return base.mapInPandas(draw, "image_id bigint, w int, h int, pixels binary")


def encode_png(img: np.ndarray) -> bytes:
    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    h, w = img.shape
    rows = np.hstack([np.zeros((h, 1), np.uint8), img]).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def files(spark, sf):
    """The same images as PNG files: every 50th is cut in half, every 101st has no header."""
    def encode(batches):
        for pdf in I.in_pieces(batches):
            out = []
            for r in pdf.to_dict("records"):
                data = encode_png(np.frombuffer(r["pixels"], np.uint8).reshape(r["h"], r["w"]))
                out.append(b"no image" if r["image_id"] % 101 == 0 else data[: len(data) // 2] if r["image_id"] % 50 == 0 else data)
            yield pd.DataFrame({"image_id": pdf["image_id"], "content": out})

    return pixels(spark, sf).mapInPandas(encode, "image_id bigint, content binary")


@query("img_1_header_profile", f"with {PIXELS_SQL} select image_id, case when image_id % 101 <> 0 then w::int end as width, case when image_id % 101 <> 0 then h::int end as height, case when image_id % 101 <> 0 then 'L' end as mode, image_id % 101 <> 0 as readable from px")
def img_1(spark, sf):
    return I.header_profile(files(spark, sf), "image_id").drop("kib")


MEASURES = "select 'width' as measure, w::double as value from image_sizes union all select 'height', h::double from image_sizes union all select 'aspect', w::double / h from image_sizes union all select 'megapixels', w * h / 1e6::double from image_sizes union all select 'kib', kib::double from image_sizes"


@query("img_2_resolution_profile", f"select measure, count(*) as n, " + ", ".join(f"round(quantile_disc(value, {p / 100}), 9) as p{p}" for p in (0, 5, 25, 50, 75, 95, 100)) + f" from ({MEASURES}) group by measure")
def img_2(spark, sf):
    w, h = F.col("w").cast("double"), F.col("h").cast("double")
    each = {"width": w, "height": h, "aspect": w / h, "megapixels": w * h / 1e6, "kib": F.col("kib").cast("double")}
    long = image_sizes(spark, sf).select(F.inline(F.array(*[F.struct(F.lit(k).alias("measure"), v.alias("value")) for k, v in each.items()])))
    counts = long.groupBy("measure").agg(F.count(F.lit(1)).alias("n"))
    return rounded(P.weighted_percentiles(long, ["measure"], "value", [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]).join(counts, "measure"))


GEOMETRY = """select image_id, new_w, new_h, ((384 - new_w) // 2)::int as "left", ((320 - new_h) // 2)::int as top from
 (select image_id, greatest(1, round_even(w * s, 0))::int as new_w, greatest(1, round_even(h * s, 0))::int as new_h from (select *, least(384.0::double / w, 320.0::double / h) as s from image_sizes))"""


@query("img_3_fit_geometry", GEOMETRY)
def img_3(spark, sf):
    g = I.fit_geometry(F.col("w"), F.col("h"), 384, 320)
    return image_sizes(spark, sf).select("image_id", *[c.alias(n) for n, c in g.items()])


# Channel means and deviations of the usual image normalization.
MEAN, STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


@query("img_4_normalize", f"with {PIXELS_SQL} select image_id, count(*) as n, " + ", ".join(f"round((avg(v) / 255 - {m}::double) / {s}::double, 3) as c{i}" for i, (m, s) in enumerate(zip(MEAN, STD))) + " from cells group by image_id")
def img_4(spark, sf):
    def stats(img):
        t = I.to_channels(img, MEAN, STD).astype(float)
        return [{"n": int(img.size), "c0": t[0].mean(), "c1": t[1].mean(), "c2": t[2].mean()}]

    out = I.map_pixels(pixels(spark, sf), stats, "image_id bigint, n bigint, c0 double, c1 double, c2 double")
    return out.select("image_id", "n", *[F.round(c, 3).alias(c) for c in ("c0", "c1", "c2")])


INTENSITY = "image_id bigint, kind string, low int, high int, mean double, hist array<bigint>"


@query("img_6_intensity", f"with {PIXELS_SQL} select image_id, min(v)::int as low, max(v)::int as high, round(avg(v), 6) as mean, count(*) filter (where v * 50 // 256 = 0) as n_first_bin from cells group by image_id")
def img_6(spark, sf):
    rows = I.map_pixels(pixels(spark, sf), lambda img: [{"kind": "original", **I.intensity_row(img)}], INTENSITY)
    return rows.select("image_id", "low", "high", F.round("mean", 6).alias("mean"), F.get("hist", F.lit(0)).alias("n_first_bin"))


OPS = {"rotate": (0.5, -5.0, 5.0), "shift_x": (0.5, -0.05, 0.05), "shift_y": (0.5, -0.05, 0.05), "scale": (0.5, 0.95, 1.05), "brightness": (0.3, 0.9, 1.1), "contrast": (0.3, 0.9, 1.1)}
OPS_SQL = ", ".join(f"round(case when {md5_uniform_sql(f'42:3:{op}:roll', 'image_id')} < {p}::double then {lo}::double + {md5_uniform_sql(f'42:3:{op}:value', 'image_id')} * ({hi}::double - {lo}::double) end, 9) as {op}" for op, (p, lo, hi) in OPS.items())


@query("img_7_drawn_parameters", f"select image_id, {OPS_SQL} from image_sizes")
def img_7(spark, sf):
    return rounded(I.drawn_parameters(image_sizes(spark, sf).select("image_id"), "image_id", 42, 3, OPS))


@query("img_8_batch_scorer", "select vec_id, round(1 / (1 + exp(-z)), 6) as p_first, round(z, 6) as margin from (select vec_id, list_sum(list_transform(embedding, lambda e, i: e::double * ((i * 7) % 5 - 2)))::double as z from embeddings)")
def img_8(spark, sf):
    """A linear scorer as a column expression."""
    z = F.aggregate(F.transform("embedding", lambda e, i: e.cast("double") * (F.pmod((i + 1) * 7, F.lit(5)) - 2)), F.lit(0.0), lambda s, x: s + x)
    out = I.score_columns(table(spark, sf, "embeddings"), ["vec_id"], {"p_first": 1 / (1 + F.exp(-z)), "margin": z})
    return out.select("vec_id", F.round("p_first", 6).alias("p_first"), F.round("margin", 6).alias("margin"))


@query("img_9_decode_check", f"select p_partkey as image_id, p_partkey % 50 = 0 or p_partkey % 101 = 0 as corrupt from part where {md5_uniform_sql(7, 'p_partkey')} < 0.4::double")
def img_9(spark, sf):
    return I.decode_check(files(spark, sf), "image_id", 0.4, 7)


@query("img_10_closest", "select image_id, w, abs(w - 384)::double as gap from image_sizes order by abs(w - 384), image_id limit 1")
def img_10(spark, sf):
    return I.closest(image_sizes(spark, sf), "image_id", "w", 384.0)


@query("lab_12_soft_generation", "select item_id, path, " + ", ".join(f"((item_id * 5011 + {t} * 37) % 1000)::double / 1000 as p_t{t}" for t in range(5)) + " from wide_labels where t0 = -1 or t1 = -1 or t2 = -1 or t3 = -1 or t4 = -1")
def lab_12(spark, sf):
    """Score the rows with an uncertain cell and emit every task's probability."""
    rows = wide_labels(spark, sf).filter(L.any_uncertain(TASKS)).select("item_id", "path")
    return I.score_columns(rows, ["item_id", "path"], {f"p_{t}": F.pmod(F.col("item_id") * 5011 + i * 37, F.lit(1000)).cast("double") / 1000 for i, t in enumerate(TASKS)})
