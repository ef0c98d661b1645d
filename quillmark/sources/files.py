"""Sources and sinks: JSON lines, nested cases, binary uploads, DOCX text; bad rows are kept with a tag."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BYTES = 5 << 20
MAGIC = {"pdf": b"%PDF", "docx": b"PK"}
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows by schema; broken ones keep their text in ``_corrupt_record``."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def cases(spark: SparkSession, path: str) -> DataFrame:
    """One row for each candidate of a nested JSON document of cases."""
    c = spark.read.option("multiLine", True).json(path).select(F.explode("cases").alias("c"))
    return c.select("c.vacancy_id", "c.job_description", F.explode("c.candidates").alias("k")).select("vacancy_id", "job_description", "k.candidate_id", "k.relevance", "k.text")


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """Files with ext and ``problem``: null, too_large, unsupported_type or wrong_signature.

    Spark's binary reader lists no files of zero bytes.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    ok = F.lit(False)
    for name, magic in MAGIC.items():
        ok = ok | ((ext == name) & (F.substring("content", 1, len(magic)) == F.lit(magic)))
    problem = F.when(F.col("length") > MOST_BYTES, "too_large").when(~ext.isin(*MAGIC), "unsupported_type").when(~ok, "wrong_signature")
    return f.select("path", "length", ext.alias("ext"), problem.alias("problem"), "content")


def best_file_per_folder(files: DataFrame) -> DataFrame:
    """The largest file of each folder that isn't a cover letter by name."""
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    f = files.where(~name.rlike(r"cover|letter|cl_|_cl\.")).withColumn("folder", F.regexp_replace("path", "/[^/]*$", ""))
    return f.groupBy("folder").agg(F.max_by("path", F.struct("length", "path")).alias("path"))


def docx_text(content: bytes) -> tuple[str, list[str]]:
    """Text of non-empty paragraphs, then table cells, and tags; never raises."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            body = ElementTree.fromstring(z.read("word/document.xml"))
            names = z.namelist()
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, RuntimeError) as e:
        return "", [f"DOCX_READ_ERROR: {type(e).__name__}"]
    text = lambda p: "".join(t.text or "" for t in p.iter(f"{_W}t"))
    cells = list(body.iter(f"{_W}tc"))
    inside = {id(p) for c in cells for p in c.iter(f"{_W}p")}
    parts = [text(p) for p in body.iter(f"{_W}p") if id(p) not in inside] + [text(c) for c in cells]
    tags = ["TABLES_DETECTED"] * bool(cells) + ["IMAGES_OR_GRAPHICS_DETECTED"] * any(n.startswith("word/media/") for n in names)
    tags += ["CONTENT_IN_HEADER"] * any(re.match(r"word/header\d*\.xml", n) for n in names) + ["CONTENT_IN_FOOTER"] * any(re.match(r"word/footer\d*\.xml", n) for n in names)
    return "\n".join(p for p in parts if p.strip()), tags


def extracted(files: DataFrame, pdf_text=None) -> DataFrame:
    """(path, raw_text, structural_issues, is_ocr) of uploads; ``pdf_text`` is a pluggable bytes -> (text, tags)."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for path, ext, problem, content in zip(pdf["path"], pdf["ext"], pdf["problem"], pdf["content"]):
                if problem is not None:
                    text, tags = "", [problem.upper()]
                elif ext == "docx":
                    text, tags = docx_text(content)
                else:
                    text, tags = pdf_text(content) if pdf_text else ("", ["PDF_READER_NOT_INSTALLED"])
                if ext == "pdf" and problem is None and pdf_text and len(text.strip()) < 100:
                    tags = [*tags, "SCANNED_PDF_DETECTED_OCR_NEEDED"]
                out.append((path, text, tags, False))
            yield pd.DataFrame(out, columns=["path", "raw_text", "structural_issues", "is_ocr"])

    return files.mapInPandas(run, "path string, raw_text string, structural_issues array<string>, is_ocr boolean")


def widened(df: DataFrame, stored: DataFrame) -> DataFrame:
    """Additive schema drift: columns missing on either side become null."""
    return stored.unionByName(df, allowMissingColumns=True)


def write_results(df: DataFrame, path: str, form: str = "json") -> None:
    (df.write.mode("overwrite").option("header", True) if form == "csv" else df.write.mode("overwrite")).format(form).save(path)
