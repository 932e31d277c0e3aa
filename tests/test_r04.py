"""Faults that showed on larger tables: what grew faster than the input stays bounded."""

import os
import random

import numpy as np

from assay.operators import images as I
from assay.plans.images_q import encode_png
from assay.session import shared_folder


def test_images_are_decoded_without_a_file_each(spark):
    """Every image was a file, which costs milliseconds to write, list and open; the image source lists them all on the driver."""
    n = 300
    img = (np.arange(20 * 30).reshape(20, 30) % 256).astype(np.uint8)
    whole = encode_png(img)
    files = spark.createDataFrame([(i if i % 9 else None, whole if i % 3 else whole[:-30] if i % 2 else None) for i in range(n)], "image_id long, content binary").repartition(4)

    def stored():
        return {os.path.join(d, f) for d, _, names in os.walk(shared_folder(spark).removeprefix("file://")) for f in names}

    before = stored()
    out = I.decode_check(files, "image_id", 1.0, 7)
    got = sorted(map(tuple, out.collect()), key=str)
    assert got == sorted(((i if i % 9 else None, i % 3 == 0) for i in range(n)), key=str)
    assert len(stored() - before) < 40 and len(out.inputFiles()) < 40


def test_rows_are_decoded_as_the_image_source_does(spark, tmp_path):
    """Whole and damaged images of several kinds, in rows and as files: the same ones become pixels."""
    java, rng = spark._jvm.java, random.Random(4)
    cases = [b"", b"text", encode_png((np.arange(20 * 30).reshape(20, 30) % 256).astype(np.uint8))]
    for kind, form in ((1, "png"), (2, "png"), (10, "png"), (5, "jpg"), (10, "jpg"), (5, "gif"), (5, "bmp")):  # RGB, with alpha, gray, BGR
        img, out = java.awt.image.BufferedImage(24, 16, kind), java.io.ByteArrayOutputStream()
        for x in range(24):
            img.setRGB(x, x % 16, x * 70_000)
        assert spark._jvm.javax.imageio.ImageIO.write(img, form, out)
        cases.append(bytes(out.toByteArray()))
    for whole in cases[2:]:
        cases += [whole[: rng.randrange(len(whole))] for _ in range(5)]
        for _ in range(5):
            at = rng.randrange(len(whole) - 4)
            cases.append(whole[:at] + rng.randbytes(4) + whole[at + 4:])
    for i, content in enumerate(cases):
        (tmp_path / f"{i}.img").write_bytes(content)
    want = {int(r["origin"].rsplit("/", 1)[1].split(".")[0]): r["ok"] for r in I.decode_folder(spark, str(tmp_path)).select("origin", "ok").collect()}
    rows = spark.createDataFrame([*enumerate(cases), (-1, None)], "i long, content binary").repartition(3)
    got = {r["i"]: r["ok"] for r in rows.select("i", I.decodes(spark, "content").alias("ok")).collect()}
    assert got == want | {0: False, -1: False} and {True, False} == set(want.values())  # the source leaves out an empty file
