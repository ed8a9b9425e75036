"""Notes and images in folders."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_notes(spark: SparkSession, path: str, separator: str = "\x1e") -> DataFrame:
    """folder, title, kind and text of notes below a path, in files by folder whose notes are parted by `separator` and begin with a line
    with their name. A title is the name without its ending, with spaces for dashes and underscores."""
    rows = spark.read.option("lineSep", separator).option("basePath", path).text(f"{path}/folder=*")
    name = F.split_part("value", F.lit("\n"), F.lit(1))
    ending = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    kind = F.when(ending.isin("md", "txt", "rst"), "text").when(ending.isin("png", "jpg", "jpeg"), "image").otherwise("other")
    title = F.trim(F.regexp_replace(F.regexp_replace(name, r"\.[A-Za-z0-9]+$", ""), "[-_]+", " "))
    return rows.select("folder", title.alias("title"), kind.alias("kind"), F.expr("substring(value, instr(value, '\\n') + 1)").alias("text"))


def write_files(rows: DataFrame, path: str, ending: str) -> DataFrame:
    """Writes a file for each row (name, content) below a shared path, by the tasks; returns (name, n_bytes). Run it once, by `stored`."""
    place = path.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(place) if "://" in place or place.startswith("file:") else (pafs.LocalFileSystem(), place)
        fs.create_dir(root, recursive=True)
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with fs.open_output_stream(f"{root}/{name}{ending}") as f:
                    f.write(content or b"")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(c or b"") for c in b.column(1).to_pylist()], pa.int64())], names=["name", "n_bytes"])

    return rows.mapInArrow(run, "name string, n_bytes bigint")


def ocr_text(images: DataFrame) -> DataFrame:
    """name, n_bytes and text of image files (as `binaryFile` reads them); the text is empty without a recognition library, or where it fails."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            import io

            import pytesseract
            from PIL import Image

            def read(data: bytes) -> str:
                try:
                    return pytesseract.image_to_string(Image.open(io.BytesIO(data))).strip()
                except Exception:
                    return ""
        except ImportError:

            def read(data: bytes) -> str:
                return ""

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([read(x or b"") for x in b.column(2).to_pylist()], pa.string())], names=["name", "n_bytes", "text"])

    name = F.regexp_extract("path", r"([^/]+)\.[A-Za-z0-9]+$", 1)
    return images.select(name.alias("name"), F.col("length").alias("n_bytes"), "content").mapInArrow(run, "name string, n_bytes bigint, text string")
