"""Readers of annotation and manifest files, and writers. Whole directories become one table; a missing document is a row, not an error."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tarn.operators.relational import in_order

#: selected_person and keypoints_2d documents; unknown fields are ignored, missing ones are NULL
PERSON = "image_id string, capture_id string, has_target boolean, has_pose boolean, selected_cand_idx int, composite_score double, bbox array<double>, keypoints array<array<double>>, confidences array<double>"
SPACE = "capture_id string, calibration_id string, valid_core_joints int, keypoints_3d_m array<array<double>>"
RIG = (
    "calibration_id string, extrinsics struct<rotation_matrix_R array<array<double>>, translation_vector_T array<array<double>>, translation_vector_T_m array<array<double>>>, "
    "intrinsics_refined struct<K1 array<array<double>>, D1 array<array<double>>, K2 array<array<double>>, D2 array<array<double>>>, "
    "rectification struct<R1 array<array<double>>, R2 array<array<double>>, P1 array<array<double>>, P2 array<array<double>>>, stereo_quality struct<mean_reprojection_error_px double, qc_status string>"
)


def read_csv(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    """SRC-01, SRC-02: with header, a byte-order mark is ignored; without a schema all columns are text. Empty cells are NULL, NaN numbers become NULL."""
    reader = spark.read.option("header", True).option("encoding", "UTF-8").option("multiLine", True).option("escape", '"')
    df = (reader.schema(schema) if schema else reader).csv(path)
    number = [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in number}) if number else df


def read_documents(spark: SparkSession, path: str, schema: str, suffix: str = "", glob: str | None = None) -> DataFrame:
    """SRC-03, SRC-05: one row a JSON document with ``key``: the value of its folder ``key=...`` where it lies in one (as ``write_texts`` puts it), else its file name without ``suffix`` and .json. Literal NaN is accepted and a broken document is a row of NULLs."""
    text = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob or f"*{suffix}.json")
    # folders are escaped once by their writer and once more in the path
    folder = F.nullif(F.url_decode(F.url_decode(F.replace(F.regexp_extract("_metadata.file_path", r"/key=([^/]+)/[^/]+$", 1), F.lit("+"), F.lit("%252B")))), F.lit(""))
    key = F.coalesce(folder, F.regexp_extract(F.url_decode(F.col("_metadata.file_name")), r"^(.*?)" + suffix + r"\.json$", 1))
    return text.select(key.alias("key"), F.from_json("value", schema, {"allowNonNumericNumbers": "true", "mode": "PERMISSIVE"}).alias("doc"))


def annotated(images: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """SRC-04, JSN-02: each image with its selected person, else its plain keypoints (the whole document, not field by field), and a ``status``:
    INVALID_ANNOTATION without a document, NO_TARGET where it says so, INVALID_SHAPE without 17 joints, else OK."""
    j = images.join(first.select(F.col("key").alias("image_id"), F.col("doc").alias("_a")), "image_id", "left").join(second.select(F.col("key").alias("image_id"), F.col("doc").alias("_b")), "image_id", "left")
    doc = F.coalesce("_a", "_b")
    has = F.coalesce(doc["has_target"], doc["has_pose"], F.lit(False))
    shape = (F.size(doc["keypoints"]) == 17) & (F.size(doc["confidences"]) == 17) & F.forall(doc["keypoints"], lambda p: F.size(p) >= 2)
    status = F.when(doc.isNull(), "INVALID_ANNOTATION").when(~has, "NO_TARGET").when(~F.coalesce(shape, F.lit(False)), "INVALID_SHAPE").otherwise("OK")
    return j.select(*images.columns, F.when(status == "OK", doc).alias("doc"), status.alias("status"))


def read_rigs(spark: SparkSession, path: str, allowed: list[str] | None = None, glob: str | None = None) -> DataFrame:
    """SRC-12: stereo calibrations by id; a small table that plans may broadcast."""
    rigs = read_documents(spark, path, RIG, "_stereo", glob).select(F.coalesce("doc.calibration_id", "key").alias("calibration_id"), "doc")
    return rigs.filter(F.col("calibration_id").isin(allowed)) if allowed is not None else rigs


def read_coco(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """SRC-06, JOI-10, ARR-06: one row an annotation with its image, category and triples (x, y, visibility); an image without any has annotation_id -1 and class no_annotation.
    The split is the name of the file's folder. Spark hides files whose names begin with an underscore: such exports must be renamed."""
    schema = "images array<struct<id long, file_name string, width int, height int>>, annotations array<struct<id long, image_id long, category_id long, bbox array<double>, keypoints array<double>>>, categories array<struct<id long, name string>>"
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    doc = raw.select(F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1).alias("split"), F.from_json("value", schema).alias("d"))
    part = lambda c, p: doc.select("split", F.explode(f"d.{c}").alias("r")).select("split", *(F.col(f"r.{k}").alias(n) for k, n in p.items()))
    images = part("images", {"id": "image_id", "file_name": "file_name", "width": "width", "height": "height"})
    boxes = part("annotations", {"id": "annotation_id", "image_id": "image_id", "category_id": "category_id", "bbox": "bbox", "keypoints": "flat"})
    names = part("categories", {"id": "category_id", "name": "class_name"})
    triples = F.transform(F.sequence(F.lit(0), F.floor(F.size("flat") / 3) - 1), lambda i: F.slice("flat", (i * 3 + 1).cast("int"), 3))
    boxes = boxes.join(names, ["split", "category_id"], "left").select("split", "image_id", "annotation_id", F.coalesce("class_name", F.lit("unknown")).alias("class_name"), "bbox", F.when(F.size("flat") >= 3, triples).alias("points"))
    return images.join(boxes, ["split", "image_id"], "left").withColumns({"annotation_id": F.coalesce("annotation_id", F.lit(-1)), "class_name": F.coalesce("class_name", F.lit("no_annotation"))})


def read_config(text: str) -> dict:
    """SRC-08: the part of YAML that dataset files use: scalars, [flow, lists], block lists and one level of maps."""

    def value(s: str):
        s = s.strip()
        if s.startswith("[") and s.endswith("]"):
            return [value(p) for p in s[1:-1].split(",") if p.strip()]
        for kind in (int, float):
            try:
                return kind(s)
            except ValueError:
                pass
        return s.strip("'\"")

    out: dict = {}
    last = None
    for line in text.splitlines():
        line = line.split(" #")[0].rstrip()
        if not line or line.lstrip().startswith("#"):
            continue
        body = line.strip()
        if body.startswith("- "):
            out[last] = [*(out[last] if isinstance(out[last], list) else []), value(body[2:])]
        elif line[0] == " ":
            k, _, v = body.partition(":")
            out[last] = {**(out[last] if isinstance(out[last], dict) else {}), value(k): value(v)}
        else:
            last, _, v = body.partition(":")
            out[last] = value(v) if v.strip() else None
    return out


def read_configs(spark: SparkSession, path: str, glob: str = "*.yaml") -> DataFrame:
    """SRC-08 for many files: a row a file and entry, ``path``, ``entry`` and ``value`` as Python writes it. A small helper reads each text; files stay where they are."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [[(str(k), str(v)) for k, v in read_config(t or "").items()] for t in batch.to_pylist()]
            yield pa.array(found, pa.map_(pa.string(), pa.string()))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    text = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    return text.select(F.col("_metadata.file_path").alias("path"), F.arrow_udf(run, "map<string,string>")("value").alias("m")).select("path", F.explode("m").alias("entry", "value"))


def list_files(spark: SparkSession, path: str, glob: str = "*", labels: bool = True) -> DataFrame:
    """SRC-09, BIT-01: path, size, SHA-256, split and label taken from the last folders (``split/label/file``)."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    parts = F.split("path", "/")
    back = lambda k: F.try_element_at(parts, F.lit(-k))
    return f.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), back(3 if labels else 2).alias("split"), (back(2) if labels else F.lit(None).cast("string")).alias("label"), "content")


def difference_hash(gray: str = "gray") -> Column:
    """BIT-02, BIT-03: 16 hexadecimal digits from 8 rows of 9 grey values (72, row by row): a bit is set where a value exceeds its left neighbour, first bit highest."""
    bit = lambda i: (F.get(F.col(gray), F.lit(i + 1)) > F.get(F.col(gray), F.lit(i))).cast("bigint")
    digit = lambda k: sum((bit(9 * ((4 * k + b) // 8) + (4 * k + b) % 8) * (8 >> b) for b in range(1, 4)), bit(9 * (4 * k // 8) + 4 * k % 8) * 8)
    return F.when(F.size(gray) == 72, F.lower(F.concat(*(F.hex(digit(k)) for k in range(16)))))


def pending(keys: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """SRC-15: rows whose key has no result yet."""
    return keys.join(done.select(key), key, "left_anti")


# --- writers --------------------------------------------------------------------------------------------------------


def written(spark: SparkSession, path: str) -> bool:
    """Whether there is something at a path, on whatever file system it is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small document of the driver's (a calibration, a summary) at a path of any file system; SNK-05."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        stream.write(text.encode())
    finally:
        stream.close()


def write_csv(df: DataFrame, path: str, fields: list[str] | None = None, append: bool = False) -> None:
    """SNK-01..03: a fixed order of columns; a header also where no row is left. Appended rows must have the columns of those before them; the first append makes the table."""
    df = df.select(*(fields or df.columns))
    spark = df.sparkSession
    if append and written(spark, path):
        seen = spark.read.option("header", True).csv(path).columns
        if seen != df.columns:
            raise ValueError(f"columns {df.columns} don't match {seen}")
    df.write.mode("append" if append else "overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_texts(df: DataFrame, path: str, key: str, text: str) -> None:
    """A file of ``text`` a row, each in a folder ``key=value`` of its own; written by the tasks that hold the rows."""
    df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("value")).repartition("key").write.mode("overwrite").partitionBy("key").text(path)


def write_documents(df: DataFrame, path: str, key: str, each: bool = False) -> None:
    """SNK-04: a JSON document a row, NULLs kept. Lines, many to a file; with ``each`` a folder ``key=value`` a document, for readers that want files, which suits small tables."""
    doc = df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    if each:
        write_texts(doc, path, "key", "value")
    else:
        doc.select("value").write.mode("overwrite").text(path)


def markdown(df: DataFrame, most: int = 1000) -> str:
    """SNK-05: a small report as a table; refuses more than ``most`` rows instead of cutting them."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|")
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)])


def _cells(df: DataFrame) -> Column:
    cell = lambda c: F.coalesce(F.replace(F.col(f"`{c}`").cast("string"), F.lit("|"), F.lit("\\|")), F.lit(""))
    return F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, df.columns)), F.lit(" |"))


def report_lines(df: DataFrame, *order: str) -> DataFrame:
    """SNK-05 for reports of any length: (nth, line) of a table with its two head lines, rows in ``order``, which must leave no ties. No task holds the report, and nothing of it comes to the driver."""
    head = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    lines = in_order(df, *order).select((F.col("_at") + 2).cast("bigint").alias("nth"), _cells(df).alias("line"))
    return df.sparkSession.createDataFrame(list(enumerate(head)), "nth bigint, line string").unionByName(lines)


def write_report(df: DataFrame, path: str, *order: str) -> None:
    """``report_lines`` as text files whose names are in the order of the lines."""
    report_lines(df, *order).repartitionByRange("nth").sortWithinPartitions("nth").select("line").write.mode("overwrite").text(path)


def reset(spark: SparkSession, source: str, target: str) -> None:
    """SNK-07: a new version of a Parquet table with its columns and no rows, never in place."""
    spark.read.parquet(source).limit(0).write.mode("errorifexists").parquet(target)


def delete_keys(spark: SparkSession, source: str, target: str, key: str, gone: DataFrame) -> None:
    """SNK-06: a new version of a Parquet table without some keys, never in place; rows whose key is NULL stay."""
    spark.read.parquet(source).join(gone.select(key).distinct(), key, "left_anti").write.mode("errorifexists").parquet(target)
