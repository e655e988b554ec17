from pyspark.sql import functions as F

from pulseframe.sources import tables


def test_sheet_images(spark, tmp_path):
    """A gray and a colour file written by the JVM come back as gray bytes; a file that is no image gives nulls."""
    jvm = spark.sparkContext._jvm
    for name, kind in (("gray.png", 10), ("colour.png", 5)):
        img = jvm.java.awt.image.BufferedImage(8, 4, kind)
        for x in range(8):
            for y in range(4):
                img.setRGB(x, y, (x * 30 << 16) | (x * 30 << 8) | x * 30 if kind == 10 else (200 << 16) | (100 << 8) | 50)
        jvm.javax.imageio.ImageIO.write(img, "png", jvm.java.io.File(f"{tmp_path}/{name}"))
    (tmp_path / "broken.png").write_bytes(b"no image")
    rows = {r.file.rsplit("/", 1)[1]: r for r in tables.sheet_images(spark, str(tmp_path)).collect()}
    assert (rows["gray.png"].width, rows["gray.png"].height, len(rows["gray.png"].gray)) == (8, 4, 32)
    assert set(rows["colour.png"].gray) == {(77 * 200 + 150 * 100 + 29 * 50 + 128) >> 8}
    assert rows["broken.png"].width is None and rows["broken.png"].gray is None


def test_file_kind(spark):
    png, jpeg = bytes.fromhex("89504e470d0a"), bytes.fromhex("ffd8ffe0")
    data = [("a.JPG", None, None), ("b.bin", None, png), ("c.PDF", None, jpeg), ("d", None, b"%PDF-1.7"), ("e", "application/pdf", png), ("f.png", None, b"text"), (None, None, jpeg), (None, None, None)]
    df = spark.createDataFrame(data, "name string, mime string, head binary")
    got = [r.kind for r in df.select(tables.file_kind(F.col("name"), F.col("mime"), F.col("head")).alias("kind")).collect()]
    assert got == ["unknown", "png", "pdf", "pdf", "pdf", "unknown", "jpeg", "unknown"]


def test_files_keep_a_row_each(spark, tmp_path):
    jvm = spark.sparkContext._jvm
    for name, width in (("wide.png", 900), ("narrow.png", 300)):
        jvm.javax.imageio.ImageIO.write(jvm.java.awt.image.BufferedImage(width, 4, 10), "png", jvm.java.io.File(f"{tmp_path}/{name}"))
    (tmp_path / "broken.png").write_bytes(bytes.fromhex("89504e470d0a") + b"no image")
    (tmp_path / "paper.pdf").write_bytes(b"%PDF-1.7")
    (tmp_path / "notes.txt").write_bytes(b"text")
    rows = {r.file.rsplit("/", 1)[1]: r for r in tables.files(spark, str(tmp_path)).collect()}
    assert {k: r.problem for k, r in rows.items()} == {"wide.png": None, "narrow.png": "too_narrow", "broken.png": "corrupt", "paper.pdf": "pdf", "notes.txt": "not_image"}
    assert rows["narrow.png"].message == "The image is 300 px wide; 800 px are needed" and len(rows["wide.png"].gray) == 3600 and len({r.key for r in rows.values()}) == 5
