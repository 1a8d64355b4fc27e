"""Queries that read what they wrote (files of every kind, in the shared folder), and small surfaces: rounding, stamps, texts, summaries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarn.functions.geometry import exact_round
from tarn.operators import audit, evaluate, relational, reports
from tarn.plans import runner
from tarn.plans.catalog import _SQL_NEAR, _SQL_PRED, _SQL_CLASS, _hashes, _models
from tarn.plans.registry import query, rounded
from tarn.session import workspace
from tarn.sources import files
from tarn.sources import tables as T

# --- files ----------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_files(spark, d):
    """SNK-01, SNK-02, SRC-01, SRC-02: written in a fixed order of columns, read by a schema."""
    path, c = workspace(spark, "csv"), T.read(spark, d, "customer")
    files.write_csv(c, path, ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"])
    return files.read_csv(spark, path, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")


@query("SELECT c_mktsegment AS segment, count(*) AS n, sum(c_custkey)::BIGINT AS keys FROM customer GROUP BY 1")
def csv_appended(spark, d):
    """SNK-03: the first append makes the table, the second adds to it; columns are text without a schema."""
    path, c = workspace(spark, "log"), T.read(spark, d, "customer").select("c_custkey", "c_mktsegment")
    for part in (0, 1):
        files.write_csv(c.filter(F.col("c_custkey") % 2 == part), path, append=True)
    back = files.read_csv(spark, path)
    return back.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"), F.sum(F.col("c_custkey").cast("bigint")).alias("keys"))


@query("SELECT n_nationkey AS id, n_name AS name, n_regionkey AS region FROM nation")
def json_documents(spark, d):
    """SNK-04: a document a key, in a folder of its own, and read again with its key."""
    path = workspace(spark, "documents")
    n = T.read(spark, d, "nation").withColumnRenamed("n_nationkey", "id")
    files.write_documents(n, path, "id", each=True)
    back = spark.read.option("basePath", path).text(path, wholetext=True)
    doc = F.from_json("value", "id int, n_name string, n_regionkey int")
    return back.select("key", doc.alias("doc")).filter(F.col("key").cast("int") == F.col("doc.id")).select("doc.id", F.col("doc.n_name").alias("name"), F.col("doc.n_regionkey").alias("region"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_name < 'AN')")
def deleted_keys(spark, d):
    """SNK-06, SNK-07: a version without some keys; and one without rows, which still has its columns."""
    at, less, none = (workspace(spark, n) for n in ("all", "less", "none"))
    T.read(spark, d, "nation").coalesce(1).write.parquet(at)
    files.delete_keys(spark, at, less, "n_regionkey", T.read(spark, d, "region").filter("r_name < 'AN'").select(F.col("r_regionkey").alias("n_regionkey")))
    files.reset(spark, at, none)
    return spark.read.parquet(less).unionByName(spark.read.parquet(none))


@query("SELECT 'r_regionkey=' || r_regionkey AS label, (length(r_name) + 1)::BIGINT AS bytes, sha256(r_name || chr(10)) AS sha256 FROM region")
def listed_files(spark, d):
    """SRC-09, BIT-01: a folder a key, listed with sizes and SHA-256."""
    path = workspace(spark, "listing")
    T.read(spark, d, "region").select("r_regionkey", "r_name").repartition("r_regionkey").write.partitionBy("r_regionkey").text(path)
    return files.list_files(spark, path, "*.txt").select("label", "bytes", "sha256")


@query("""SELECT vec_id AS image_id, 'v' || vec_id || '.jpg' AS file_name, 'split=' || (label % 3) AS split, CASE WHEN vec_id % 5 = 0 THEN -1 ELSE vec_id * 10 END AS annotation_id,
CASE WHEN vec_id % 5 = 0 THEN 'no_annotation' WHEN label % 4 = 3 THEN 'unknown' ELSE 'c' || (label % 4) END AS class_name, CASE WHEN vec_id % 5 > 0 THEN 5 END AS points,
CASE WHEN vec_id % 5 > 0 THEN round(list_sum(list_transform(range(5), lambda i: round(abs(embedding[3 * i + 1]::DOUBLE), 3))), 6) END AS x_sum, CASE WHEN vec_id % 5 > 0 THEN 4::DOUBLE END AS seen FROM embeddings""")
def coco_annotations(spark, d):
    """SRC-06, JOI-10, ARR-06: a document a split is written, and read as one row an annotation with its image, class and triples."""
    path = workspace(spark, "coco")
    e = T.read(spark, d, "embeddings").withColumn("split", F.col("label") % 3)
    at = lambda i: F.round(F.abs(F.get("embedding", F.lit(i)).cast("double")), 3)
    flat = F.flatten(F.array(*(F.array(at(3 * i), at(3 * i + 1), F.lit(float(i % 3))) for i in range(5))))
    image = F.struct(F.col("vec_id").alias("id"), F.concat(F.lit("v"), F.col("vec_id"), F.lit(".jpg")).alias("file_name"), F.lit(64).alias("width"), F.lit(48).alias("height"))
    box = F.when(F.col("vec_id") % 5 > 0, F.struct((F.col("vec_id") * 10).alias("id"), F.col("vec_id").alias("image_id"), (F.col("label") % 4).alias("category_id"), F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0), F.lit(4.0)).alias("bbox"), flat.alias("keypoints")))
    names = F.array(*(F.struct(F.lit(i).alias("id"), F.lit(f"c{i}").alias("name")) for i in range(3)))
    doc = e.groupBy("split").agg(F.collect_list(image).alias("images"), F.collect_list(box).alias("annotations")).select("split", F.to_json(F.struct("images", "annotations", names.alias("categories"))).alias("value"))
    doc.repartition("split").write.partitionBy("split").text(path)
    c = files.read_coco(spark, path, "*.txt")
    total = F.aggregate(F.transform("points", lambda p: F.get(p, F.lit(0))), F.lit(0.0), lambda a, x: a + x)
    return rounded(c.select("image_id", "file_name", "split", "annotation_id", "class_name", F.when(F.col("points").isNotNull(), F.size("points")).alias("points"), total.alias("x_sum"), F.aggregate(F.transform("points", lambda p: F.get(p, F.lit(2))), F.lit(0.0), lambda a, x: a + x).alias("seen")))


@query("""SELECT vec_id::VARCHAR AS image_id, CASE WHEN vec_id % 7 = 0 THEN 'INVALID_ANNOTATION' WHEN vec_id % 3 = 0 AND vec_id % 2 = 0 THEN 'NO_TARGET' WHEN vec_id % 3 > 0 AND vec_id % 5 = 0 THEN 'NO_TARGET' WHEN label = 4 THEN 'INVALID_SHAPE' ELSE 'OK' END AS status,
CASE WHEN vec_id % 7 > 0 AND NOT (vec_id % 3 = 0 AND vec_id % 2 = 0) AND NOT (vec_id % 3 > 0 AND vec_id % 5 = 0) AND label <> 4 THEN round(embedding[1]::DOUBLE, 6) END AS nose FROM embeddings""")
def annotated_images(spark, d):
    """SRC-03..05, JSN-02: selected-person documents, else plain keypoints, whole documents with their own key for whether there is a target."""
    e = T.read(spark, d, "embeddings").withColumn("image_id", F.col("vec_id").cast("string"))
    points = F.transform(F.sequence(F.lit(0), F.when(F.col("label") == 4, 15).otherwise(16)), lambda j: F.array(F.get("embedding", 2 * j).cast("double"), F.get("embedding", 2 * j + 1).cast("double")))
    sure = F.array_repeat(F.lit(0.9), 17)
    text = lambda name, has: F.to_json(F.struct("image_id", has.alias(name), points.alias("keypoints"), sure.alias("confidences")))
    parsed = lambda df, value: df.select(F.col("image_id").alias("key"), F.from_json(value, files.PERSON).alias("doc"))
    first = parsed(e.filter("vec_id % 3 = 0 and vec_id % 7 > 0"), text("has_target", F.col("vec_id") % 2 > 0))
    second = parsed(e.filter("vec_id % 7 > 0"), text("has_pose", F.col("vec_id") % 5 > 0))
    return rounded(files.annotated(e.select("image_id"), first, second).select("image_id", "status", F.get(F.get("doc.keypoints", F.lit(0)), F.lit(0)).alias("nose")))


@query("""WITH g AS (SELECT vec_id, list_transform(range(72), lambda i: floor(100 * abs(embedding[i % 64 + 1]::DOUBLE))::INT) AS g FROM embeddings),
b AS (SELECT vec_id, list_transform(range(64), lambda i: (g[9 * (i // 8) + i % 8 + 2] > g[9 * (i // 8) + i % 8 + 1])::INT) AS b FROM g)
SELECT vec_id, array_to_string(list_transform(range(16), lambda k: '0123456789abcdef'[8 * b[4 * k + 1] + 4 * b[4 * k + 2] + 2 * b[4 * k + 3] + b[4 * k + 4] + 1]), '') AS dhash FROM b""")
def difference_hashes(spark, d):
    """BIT-02."""
    gray = F.transform(F.sequence(F.lit(0), F.lit(71)), lambda i: F.floor(100 * F.abs(F.get("embedding", i % 64).cast("double"))).cast("int"))
    return T.read(spark, d, "embeddings").select("vec_id", gray.alias("gray")).select("vec_id", files.difference_hash().alias("dhash"))


@query("""SELECT vec_id::VARCHAR AS key, CASE WHEN vec_id % 13 > 0 THEN 'IMG_' || vec_id END AS image_id, CASE WHEN vec_id % 13 > 0 AND vec_id % 5 > 0 THEN round(embedding[1]::DOUBLE, 6) END AS score, vec_id % 13 > 0 AND vec_id % 5 = 0 AS not_a_number,
CASE WHEN vec_id % 13 > 0 AND vec_id % 3 > 0 THEN round(embedding[2]::DOUBLE, 6) END AS y FROM embeddings""")
def document_files(spark, d):
    """SRC-03, SRC-05: a file a view, read by key: literal NaN, missing and unknown fields, and every thirteenth document broken off in the middle."""
    path = workspace(spark, "views")
    e = lambda i: F.get("embedding", F.lit(i)).cast("double").cast("string")
    score = F.when(F.col("vec_id") % 5 == 0, "NaN").otherwise(e(0))
    points = F.when(F.col("vec_id") % 3 > 0, F.concat(F.lit(', "keypoints": [['), e(0), F.lit(", "), e(1), F.lit("]]"))).otherwise(F.lit(""))
    whole = F.concat(F.lit('{"image_id": "IMG_'), F.col("vec_id").cast("string"), F.lit('", "other": [1, {}], "composite_score": '), score, points, F.lit("}"))
    text = F.when(F.col("vec_id") % 13 == 0, F.substring(whole, 1, 12)).otherwise(whole)
    files.write_texts(T.read(spark, d, "embeddings").withColumn("text", text), path, "vec_id", "text")
    v = files.read_documents(spark, path, files.PERSON, glob="*.txt")
    score = F.col("doc.composite_score")
    return rounded(v.select("key", "doc.image_id", F.nanvl(score, F.lit(None).cast("double")).alias("score"), F.coalesce(F.isnan(score), F.lit(False)).alias("not_a_number"), F.get(F.get("doc.keypoints", F.lit(0)), F.lit(1)).alias("y")))


@query("""SELECT 'CAL_' || s_suppkey AS calibration_id, round(sqrt(pow(s_acctbal::DOUBLE / 10000, 2) + 0.25), 6) AS baseline, round(510 + s_nationkey::DOUBLE, 6) AS focal FROM supplier WHERE s_suppkey % 4 > 0""")
def rig_documents(spark, d):
    """SRC-12: calibration documents, a file a rig, with an allow-list and the shift in either spelling."""
    path = workspace(spark, "rigs")
    s = T.read(spark, d, "supplier").withColumn("id", F.concat(F.lit("CAL_"), F.col("s_suppkey").cast("string")))
    shift = F.array(F.array(F.col("s_acctbal").cast("double") / 10000), F.array(F.lit(0.3)), F.array(F.lit(0.4)))
    camera = F.struct(F.array(F.array(510.0 + F.col("s_nationkey"), F.lit(0.0), F.lit(320.0))).alias("K1"))
    own, other = (F.to_json(F.struct(F.col("id").alias("calibration_id"), F.struct(shift.alias(n)).alias("extrinsics"), camera.alias("intrinsics_refined"))) for n in ("translation_vector_T", "translation_vector_T_m"))
    files.write_texts(s.withColumn("text", F.when(F.col("s_suppkey") % 2 == 0, own).otherwise(other)), path, "id", "text")
    allowed = s.filter("s_suppkey % 4 > 0").select(F.col("id").alias("calibration_id"))
    rigs = files.read_rigs(spark, path, glob="*.txt").join(allowed, "calibration_id", "left_semi")
    moved = F.flatten(F.coalesce("doc.extrinsics.translation_vector_T", "doc.extrinsics.translation_vector_T_m"))
    size = F.sqrt(F.aggregate(moved, F.lit(0.0), lambda a, x: a + x * x))
    return rounded(rigs.select("calibration_id", size.alias("baseline"), F.get(F.get("doc.intrinsics_refined.K1", F.lit(0)), F.lit(0)).alias("focal")))


_ENTRIES = (
    ("path", "'/data/' || n_name"), ("nc", "n_nationkey::VARCHAR"), ("rate", "n_regionkey || '.5'"), ("names", "'[' || chr(39) || lower(n_name) || chr(39) || ', ' || n_nationkey || ']'"),
    ("kpt_shape", "'[' || n_nationkey || ', 3]'"), ("flip", "'{' || chr(39) || 'left' || chr(39) || ': ' || n_regionkey || ', ' || chr(39) || 'right' || chr(39) || ': ' || chr(39) || 'r' || chr(39) || '}'"),
)


@query(" UNION ALL ".join(f"SELECT n_name AS config, '{k}' AS entry, {v} AS value FROM nation" for k, v in _ENTRIES))
def config_values(spark, d):
    """SRC-08: a configuration file a nation: scalars, comments, both kinds of lists and a map."""
    path = workspace(spark, "configs")
    text = F.format_string("path: /data/%s\nnc: %d # classes\nrate: %d.5\n# names\nnames: [%s, %d]\nkpt_shape:\n  - %d\n  - 3\nflip:\n  left: %d\n  right: 'r'\n", "n_name", "n_nationkey", "n_regionkey", F.lower("n_name"), "n_nationkey", "n_nationkey", "n_regionkey")
    files.write_texts(T.read(spark, d, "nation").withColumn("text", text), path, "n_name", "text")
    found = files.read_configs(spark, path, "*.txt")
    return found.select(F.url_decode(F.regexp_extract("path", "/key=([^/]+)/", 1)).alias("config"), "entry", "value")


@query("""SELECT '| r_regionkey | r_name |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || r_regionkey || ' | ' || r_name || ' |', chr(10) ORDER BY r_regionkey) AS report FROM region""")
def report_text(spark, d):
    """SNK-05."""
    return spark.createDataFrame([(files.markdown(T.read(spark, d, "region").select("r_regionkey", "r_name").orderBy("r_regionkey")),)], "report string")


@query("""SELECT 0::BIGINT AS nth, '| c_custkey | c_name | c_acctbal |' AS line UNION ALL SELECT 1, '|---|---|---|' UNION ALL SELECT 1 + row_number() OVER (ORDER BY c_custkey), '| ' || c_custkey || ' | ' || c_name || ' | ' || c_acctbal || ' |' FROM customer""")
def report_lines(spark, d):
    """SNK-05: a report of a whole table, line by line, made by many tasks."""
    return files.report_lines(T.read(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), "c_custkey")


# --- columns and texts ----------------------------------------------------------------------------------------------


@query("SELECT n_nationkey, n_name, 'none' AS subset, 3 AS version FROM nation")
def defaults_added(spark, d):
    """PRJ-03: columns that are missing get a default, others stay."""
    return audit.with_defaults(T.read(spark, d, "nation"), subset="none", N_NAME="x", version=3).select("n_nationkey", "n_name", "subset", "version")


@query("SELECT event_id, round_even(value, 0) AS whole, format('{:.2f}', value * 1.37::DOUBLE)::DOUBLE AS two, format('{:.1f}', value / 3.0::DOUBLE)::DOUBLE AS one FROM events")
def exact_rounding(spark, d):
    """GEO-16: the binary value, ties to even."""
    v = F.col("value").cast("double")
    return T.read(spark, d, "events").select("event_id", exact_round(v, 0).alias("whole"), exact_round(v * 1.37, 2).alias("two"), exact_round(v / 3.0, 1).alias("one"))


@query("SELECT vec_id, round(list_avg(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS mean, round(embedding[label % 6 + 1]::DOUBLE, 6) AS own FROM embeddings")
def array_means(spark, d):
    """ARR-04, MAP-02: mean of an array; a map from class to value, read by class."""
    mean = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size("embedding")
    probs = F.map_from_arrays(F.array(*map(F.lit, T.CLASSES)), F.transform(F.slice("embedding", 1, len(T.CLASSES)), lambda x: x.cast("double")))
    return rounded(T.read(spark, d, "embeddings").select("vec_id", mean.alias("mean"), F.element_at(probs, T.label("label")).alias("own")))


@query("SELECT l_orderkey, l_linenumber, '[' || l_partkey || ',' || l_suppkey || ']' AS keys FROM lineitem")
def lists_as_text(spark, d):
    """JSN-03: a flat list as a text column."""
    return T.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.to_json(F.array("l_partkey", "l_suppkey")).alias("keys"))


@query("""WITH g AS (SELECT event_id, ts, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1000000.0::DOUBLE AS gap FROM events)
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad((epoch_us(ts) // 1000 % 1000)::VARCHAR, 3, '0') || 'Z' AS stamp, CASE WHEN gap IS NOT NULL THEN round(1 / greatest(0.0001::DOUBLE, gap), 6) END AS fps FROM g""")
def stamps_and_rates(spark, d):
    """DT-03, DT-04: a time in UTC with milliseconds, and frames a second from the time since the last frame."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = (at - F.lag(at).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))) / 1e6
    e = T.read(spark, d, "events")
    return rounded(e.select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("stamp"), (1 / F.when(gap.isNotNull(), F.greatest(F.lit(1e-4), gap))).alias("fps")))


@query("SELECT source, min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang, arg_min(n_chars, doc_id) AS n_chars FROM documents GROUP BY source")
def first_per_key(spark, d):
    """FLT-10: the first row of each key in a stated order, combined before the shuffle."""
    return relational.first_row(T.read(spark, d, "documents"), ["source"], ["doc_id"], ["doc_id", "lang", "n_chars"])


@query("SELECT event_type, median(value) AS middle FROM events GROUP BY event_type")
def exact_medians(spark, d):
    """AGG-14, ML-01: by quantile brackets and exact counts."""
    return relational.exact_median(T.read(spark, d, "events"), "value", "event_type").withColumnRenamed("median", "middle")


@query(_SQL_PRED + _SQL_CLASS.replace("fold, ", "") + """, x AS (SELECT cls, round(max(CASE WHEN model = 'a' THEN f1 END) - max(CASE WHEN model = 'b' THEN f1 END), 9) AS delta FROM c GROUP BY cls)
SELECT (SELECT min(cls) FROM x WHERE delta = (SELECT max(delta) FROM x)) AS best, round(max(delta), 6) AS best_value, (SELECT min(cls) FROM x WHERE delta = (SELECT min(delta) FROM x)) AS worst, round(min(delta), 6) AS worst_value FROM x""")
def best_and_worst(spark, d):
    """ORD-08."""
    c = evaluate.per_class(_models(spark, d), "model").groupBy("cls").agg(*(F.max(F.when(F.col("model") == m, F.col("f1"))).alias(m) for m in "ab"))
    return rounded(evaluate.extremes(c.select("cls", F.round(F.col("a") - F.col("b"), 9).alias("delta")), "cls", "delta"))


# --- reports --------------------------------------------------------------------------------------------------------


@query(_SQL_PRED + _SQL_CLASS + """, m AS (SELECT model, fold, round(sum(tp) / sum(s), 6) AS accuracy, round(avg(f1), 6) AS f1_macro FROM c GROUP BY model, fold)
SELECT CASE model WHEN 'a' THEN 'EXP-01 (CNN Baseline)' ELSE 'EXP-03 (YOLO Pose + Clf)' END AS experiment, CASE WHEN model = 'a' THEN 'fold_' || fold ELSE 'project_design' END AS dataset, CASE WHEN model = 'a' AND fold = 0 THEN 'EfficientNet-B0' ELSE model || fold END AS model, accuracy, f1_macro FROM m""")
def experiment_summary(spark, d):
    """JSN-04, ORC-02: JSON lists of results, one with its data set named outside, in one table."""
    m = evaluate.summary(_models(spark, d), "model", "fold")
    r = F.struct(F.concat(F.lit("fold_"), "fold").alias("dataset"), F.when((F.col("model") != "a") | (F.col("fold") != 0), F.concat("model", F.col("fold").cast("string"))).alias("model"), F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1", 6).alias("f1_macro"))
    docs = m.groupBy("model").agg(F.to_json(F.collect_list(r)).alias("value"))
    named = docs.select(F.when(F.col("model") == "a", "EXP-01 (CNN Baseline)").otherwise("EXP-03 (YOLO Pose + Clf)").alias("experiment"), F.when(F.col("model") != "a", "project_design").alias("dataset"), "value")
    return reports.experiments(named)


_SPLIT = "CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 < 9 THEN 'valid' ELSE 'test' END"
_GOOD = "doc_id % 13 > 0"


@query(_SQL_NEAR.replace("FROM documents", f"FROM documents WHERE {_GOOD}") + f""", i AS (SELECT doc_id, source AS label, {_SPLIT} AS split, sha256(text) AS sha, {_GOOD} AS good, doc_id % 250 AS bright, n_chars % 500 AS edge FROM documents),
e AS (SELECT sha, count(*) AS n, count(DISTINCT split) AS s FROM i WHERE good GROUP BY sha HAVING count(*) > 1), c AS (SELECT label, count(*) AS n FROM i WHERE good GROUP BY label),
l AS (SELECT count(*) AS n FROM pr JOIN i a ON a_key = a.doc_id JOIN i b ON b_key = b.doc_id WHERE a.split <> b.split)
SELECT count(*) AS files, count(*) FILTER (WHERE good) AS valid, count(*) FILTER (WHERE NOT good) AS corrupt, count(*) FILTER (WHERE good AND bright < 40) AS dark, count(*) FILTER (WHERE good AND edge < 100) AS blurry, 0::BIGINT AS small,
(SELECT count(*) FROM c) AS classes, (SELECT round(max(n) / min(n), 4) FROM c) AS imbalance, (SELECT count(*) FROM e) AS exact_groups, (SELECT coalesce(sum(n), 0)::BIGINT FROM e) AS exact_files, (SELECT count(*) FROM pr) AS near_pairs,
(SELECT n FROM l) + (SELECT count(*) FROM e WHERE s > 1) AS leaks FROM i""")
def dataset_audit(spark, d):
    """ORC-05: documents stand in for images; keys sort as text, so they are padded."""
    h = _hashes(spark, d).withColumn("dhash64", F.concat(F.lpad(F.lower(F.hex("hi")), 8, "0"), F.lpad(F.lower(F.hex("lo")), 8, "0"))).select("key", "dhash64")
    i = T.read(spark, d, "documents").select(
        "doc_id", F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), F.expr(_SPLIT).alias("split"), F.col("source").alias("label"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"),
        (F.col("doc_id") % 13 == 0).alias("is_corrupt"), (F.col("doc_id") % 250).cast("double").alias("brightness_mean"), (F.col("n_chars") % 500).cast("double").alias("edge_variance"), F.lit(300).alias("width"), F.lit(300).alias("height"),
    )
    return reports.audit(i.join(h, F.col("doc_id") == F.col("key")))["summary"]


@query("SELECT unnest([1, 2, 3, 4, 5]) AS nth, unnest(['write', 'sum', 'broken', 'again', 'last']) AS step, unnest(['done', 'done', 'failed', 'skipped', 'done']) AS status, unnest([count(*), count(DISTINCT c_nationkey), NULL, NULL, count(*) FILTER (WHERE c_acctbal < 0)]) AS rows FROM customer")
def step_report(spark, d):
    """ORC-01, ORC-02: steps in order, each on what an earlier one wrote; one fails without stopping the rest, one finds its output written. ``rows``: what a step that ran left behind."""
    a, b, c = (workspace(spark, n) for n in ("customers", "nations", "debts"))
    steps = [
        runner.Step("write", lambda s: T.read(s, d, "customer").write.parquet(a), (a,)), runner.Step("sum", lambda s: s.read.parquet(a).groupBy("c_nationkey").agg(F.sum("c_acctbal").alias("sum")).write.parquet(b), (b,)),
        runner.Step("broken", lambda s: None, (f"{a}-none",)), runner.Step("again", lambda s: None, (a,)), runner.Step("last", lambda s: s.read.parquet(a).filter("c_acctbal < 0").write.parquet(c), (c,)),
    ]
    report = runner.run(spark, steps[:3], go_on=True) + runner.run(spark, steps[3:], skip_written=True)
    left = {"write": a, "sum": b, "last": c}
    rows = [(i, r["step"], r["status"], spark.read.parquet(left[r["step"]]).count() if r["status"] == "done" else None) for i, r in enumerate(report, 1)]
    return spark.createDataFrame(rows, "nth int, step string, status string, rows bigint")
