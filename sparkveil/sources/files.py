"""Files as rows: discovery, decoding, format dispatch and the text format."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import ordered

#: Formats by suffix, in lower case.
FORMATS = {".txt": "text", ".md": "text", ".csv": "text", ".json": "text", ".docx": "docx", ".pdf": "pdf", ".eml": "eml"}
REPORT = ".report.json"
LEGACY = ("cp1250", "iso-8859-2")


class BackendUnavailable(RuntimeError):
    """A format needs a library that is not installed. Its text is not taken to hold no personal data."""


def suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^./\\]+)$", 1))


def format_of(name: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv]), suffix(name))


def collect(spark: SparkSession, inputs: list[str]) -> DataFrame:
    """doc_seq, path, name, content of files and folders, folders recursively. Files come in the order of the arguments and, within a folder, of their paths; in a
    folder only supported formats count and reports do not. A missing input raises FileNotFoundError."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    parts = []
    for n, where in enumerate(inputs):
        path = jvm.org.apache.hadoop.fs.Path(where)
        fs = path.getFileSystem(conf)
        if not fs.exists(path):
            raise FileNotFoundError(where)
        folder = fs.getFileStatus(path).isDirectory()
        df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(where).select("path", "content")
        if folder:
            df = df.where(format_of(F.col("path")).isNotNull() & ~F.lower("path").endswith(REPORT))
        parts.append(df.withColumn("arg", F.lit(n)))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    # paths are numbered without contents and joined back
    order = ordered(out.select("arg", "path"), ["arg", "path"], "doc_seq")
    return out.join(order, ["arg", "path"]).select("doc_seq", "path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "content")


def _first_that_fits(content: bytes | None) -> str | None:
    if content is None:
        return None
    for encoding in LEGACY:
        try:
            return bytes(content).decode(encoding)
        except UnicodeDecodeError:
            continue
    return bytes(content).decode("utf-8", "replace")


def _legacy(content: pd.Series) -> pd.Series:
    return content.map(_first_that_fits)


def decoded(content: Column) -> Column:
    """UTF-8 with or without a byte order mark, else cp1250, else ISO 8859-2. Spark decodes UTF-8; the others go to Python."""
    return F.when(F.is_valid_utf8(content.cast("string")), F.regexp_replace(content.cast("string"), "^\ufeff", "")).otherwise(F.pandas_udf(_legacy, "string")(F.when(~F.is_valid_utf8(content.cast("string")), content)))


def text_units(files: DataFrame) -> DataFrame:
    """doc_seq, unit_seq, where, text of text files: lines are the segments of one unit; a span is never cut by a line end but by what apply keeps."""
    return files.where(format_of(F.col("name")) == "text").select("doc_seq", F.lit(0).alias("unit_seq"), F.lit("riadok").alias("where"), "name", decoded(F.col("content")).alias("text"))


def segments(units: DataFrame) -> DataFrame:
    """doc_seq, unit_seq, seg_idx, offset, text: the lines of each unit with their positions in it."""
    lines = F.expr("transform(split(text, '\\n', -1), (x, i) -> struct(i AS seg_idx, x AS text))")
    rows = units.select("doc_seq", "unit_seq", lines.alias("segs"))
    ends = "aggregate(slice(segs, 1, s.seg_idx), 0, (a, x) -> a + length(x.text) + 1)"
    return rows.select("doc_seq", "unit_seq", "segs", F.explode("segs").alias("s")).select("doc_seq", "unit_seq", "s.seg_idx", F.expr(ends).alias("offset"), "s.text")


def output_name(name: Column, kind: str) -> Column:
    """stem_anonym.ext, stem_anonym.report.json, or, restored, stem_obnovene.ext without _anonym."""
    stem, ext = F.regexp_extract(name, r"^(.*?)(\.[^.]+)?$", 1), F.regexp_extract(name, r"(\.[^.]+)$", 1)
    if kind == "anonymized":
        return F.concat(stem, F.lit("_anonym"), ext)
    if kind == "report":
        return F.concat(stem, F.lit("_anonym.report.json"))
    return F.concat(F.regexp_replace(stem, "_anonym$", ""), F.lit("_obnovene"), ext)


def unique_names(files: DataFrame) -> DataFrame:
    """Names as uploads get them: the base name, and for the k-th of equal ones `stem (k).ext`."""
    base = F.regexp_extract("name", r"([^/\\]+)$", 1)
    rows = files.withColumn("name", base).withColumn("k_", F.expr("row_number() OVER (PARTITION BY name ORDER BY doc_seq)"))
    name = F.when(F.col("k_") == 1, F.col("name")).otherwise(F.concat(F.regexp_extract("name", r"^(.*?)(\.[^.]+)?$", 1), F.format_string(" (%d)", "k_"), F.regexp_extract("name", r"(\.[^.]+)$", 1)))
    return rows.withColumn("name", name).drop("k_")


#: Largest file that an upload takes, in bytes.
UPLOAD_LIMIT = 200 << 20


def intake(uploads: DataFrame) -> DataFrame:
    """uploads (doc_seq, name, content) with unique base names, `kind` (file or vault) and `error`: of unsupported formats and of files beyond the limit."""
    named = unique_names(uploads)
    vault = F.lower("name").endswith(".vault")
    error = F.when(F.octet_length("content") > UPLOAD_LIMIT, "larger than 200 MB").when(~vault & format_of(F.col("name")).isNull(), "unsupported format")
    return named.withColumn("kind", F.when(vault, "vault").otherwise("file")).withColumn("error", error)
