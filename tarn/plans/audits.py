"""Queries of dataset audits, manifests, curation and splits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarn.operators import annotations, audit, dedup, folds
from tarn.operators.stereo import calibration_verdict
from tarn.plans.catalog import _SPLIT, _SQL_NEAR
from tarn.plans.registry import query, rounded
from tarn.sources import tables as T

# --- images, boxes, keypoints ---------------------------------------------------------------------------------------

_SQL_IMG = f"""WITH i AS (SELECT doc_id AS image_id, {_SPLIT} AS split, n_chars % 7 = 0 AS corrupt, (n_chars % 256)::DOUBLE AS brightness, (n_chars % 1000)::DOUBLE AS edge, 200 + n_chars % 800 AS width, 210 + n_chars % 500 AS height FROM documents)"""


def _images(spark, d):
    n = F.col("n_chars")
    return T.read(spark, d, "documents").select(F.col("doc_id").alias("image_id"), F.expr(_SPLIT).alias("split"), (n % 7 == 0).alias("corrupt"), (n % 256).cast("double").alias("brightness"), (n % 1000).cast("double").alias("edge_variance"), (200 + n % 800).alias("width"), (210 + n % 500).alias("height"))


@query(_SQL_IMG + """, c AS (SELECT split, count(*) AS images, count(*) FILTER (WHERE NOT corrupt) AS valid, count(*) FILTER (WHERE corrupt) AS corrupt, count(*) FILTER (WHERE NOT corrupt AND brightness < 45) AS dark, count(*) FILTER (WHERE NOT corrupt AND edge < 120) AS blurred, count(*) FILTER (WHERE NOT corrupt AND least(width, height) < 224) AS small FROM i GROUP BY split)
SELECT *, concat_ws('; ', CASE WHEN corrupt > 0 THEN 'corrupt' END, CASE WHEN dark > 0 THEN 'dark' END, CASE WHEN blurred > 0 THEN 'blurred' END, CASE WHEN small > 0 THEN 'small' END) AS warnings FROM c""")
def image_quality_counts(spark, d):
    """QC-12, AGG-26."""
    return annotations.image_quality(_images(spark, d))


_SQL_BOX = """WITH b AS (SELECT l_orderkey AS image_id, l_returnflag AS cls, l_linenumber AS n, l_discount * 100 - 1 AS x, l_tax * 100 AS y, l_quantity - 2 AS w, CASE WHEN l_linenumber = 6 THEN NULL ELSE l_quantity END AS h, CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE l_suppkey % 5 END AS seen FROM lineitem),
k AS (SELECT *, CASE WHEN h IS NULL THEN 'box_incomplete' WHEN w <= 0 OR h <= 0 THEN 'box_without_area' WHEN x < 0 OR y < 0 THEN 'box_outside' END AS issue FROM b)"""


def _boxes(spark, d):
    li, q = T.read(spark, d, "lineitem"), F.col("l_quantity")
    b = li.select(F.col("l_orderkey").alias("image_id"), F.col("l_returnflag").alias("cls"), (F.col("l_discount") * 100 - 1).alias("x"), (F.col("l_tax") * 100).alias("y"), (q - 2).alias("w"), F.when(F.col("l_linenumber") != 6, q).alias("h"), F.when(F.col("l_linenumber") % 3 == 0, 0).otherwise(F.col("l_suppkey") % 5).alias("seen"))
    return b.withColumn("issue", annotations.box_issue(*map(F.col, "xywh")))


@query(_SQL_BOX + ", a AS (SELECT CASE WHEN issue IS NOT NULL THEN 'bbox_invalid' WHEN seen = 0 THEN 'all_keypoints_invisible' END AS kind, issue FROM k) SELECT kind, coalesce(issue, '') AS issue, count(*) AS n FROM a WHERE kind IS NOT NULL GROUP BY ALL")
def annotation_issues(spark, d):
    """QC-14, QC-21."""
    b = _boxes(spark, d).select(annotations.annotation_issue(F.col("issue"), F.col("seen")).alias("kind"), F.coalesce("issue", F.lit("")).alias("issue"))
    return b.filter("kind IS NOT NULL").groupBy("kind", "issue").agg(F.count("*").alias("n"))


@query(_SQL_BOX + """, i AS (SELECT o_orderkey AS image_id, o_orderpriority AS split FROM orders), v AS (SELECT * FROM k WHERE issue IS NULL)
SELECT split, coalesce(cls, 'no_annotation') AS cls, count(DISTINCT i.image_id) AS images, count(v.image_id) AS boxes FROM i LEFT JOIN v USING (image_id) GROUP BY 1, 2""")
def class_counts_valid_boxes(spark, d):
    """AGG-26, JOI-10: images without a valid box stand as one class."""
    i = T.read(spark, d, "orders").select(F.col("o_orderkey").alias("image_id"), F.col("o_orderpriority").alias("split"))
    return annotations.audit_rollup(i, _boxes(spark, d), only_valid=True)


@query("""WITH v AS (SELECT CASE WHEN vec_id % 2 = 0 THEN 'CAM01' ELSE 'CAM02' END AS camera, j, embedding[3*j+3]::DOUBLE + 0.5 >= 0.4 AS seen FROM embeddings, range(17) r(j)), e AS (SELECT camera, j, avg(seen::INT) AS rate, count(*) FILTER (WHERE seen) AS n FROM v GROUP BY 1, 2)
SELECT camera, CASE WHEN j <= 4 THEN 'head' WHEN j <= 10 THEN 'torso' ELSE 'lower' END AS part, round(avg(rate), 6) AS rate, sum(n)::BIGINT AS seen FROM e GROUP BY 1, 2""")
def joint_group_rates(spark, d):
    """AGG-21, AGG-22, ARR-09."""
    e = T.read(spark, d, "embeddings").select(F.when(F.col("vec_id") % 2 == 0, "CAM01").otherwise("CAM02").alias("camera"), F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(16)), lambda j: F.get("embedding", 3 * j + 2).cast("double") + 0.5)).alias("j", "c"))
    return rounded(annotations.group_rates(e, 0.4))


_SQL_LINES = """WITH l AS (SELECT vec_id, CASE WHEN vec_id % 13 = 0 THEN '' ELSE concat_ws(' ', CASE WHEN vec_id % 17 = 0 THEN '2.5' ELSE (label - 1)::VARCHAR END, 0.5, 0.25, CASE WHEN vec_id % 5 = 0 THEN '0' ELSE '0.5' END, CASE WHEN vec_id % 7 = 0 THEN '1.5' ELSE '1' END, CASE WHEN vec_id % 3 = 0 THEN '0 0' ELSE '-0.25 0.5' END, CASE WHEN vec_id % 11 = 0 THEN '3' ELSE '2' END, CASE WHEN vec_id % 19 = 0 THEN 'x' END) END AS line FROM embeddings)"""


def _label_files(spark, d):
    k = F.col("vec_id")
    pick = lambda m, a, b: F.when(k % m == 0, a).otherwise(b)
    line = F.concat_ws(" ", F.when(k % 17 == 0, "2.5").otherwise((F.col("label") - 1).cast("string")), F.lit("0.5 0.25"), pick(5, "0", "0.5"), pick(7, "1.5", "1"), pick(3, "0 0", "-0.25 0.5"), pick(11, "3", "2"), F.when(k % 19 == 0, "x"))
    return T.read(spark, d, "embeddings").select(k.alias("path"), F.when(k % 13 == 0, "").otherwise(line).alias("value"))


@query(_SQL_LINES + """, t AS (SELECT vec_id, line, string_split(line, ' ') AS k, CASE WHEN vec_id % 17 = 0 THEN 2.5 ELSE (SELECT label - 1 FROM embeddings e WHERE e.vec_id = l.vec_id) END AS c FROM l),
i AS (SELECT vec_id, CASE WHEN line = '' THEN ['empty_label'] WHEN vec_id % 19 = 0 THEN ['token_count', 'not_a_finite_number'] ELSE list_filter([CASE WHEN c <> trunc(c) THEN 'class_not_integer' END, CASE WHEN c < 0 THEN 'class_negative' END, CASE WHEN c >= 6 THEN 'class_out_of_range' END, CASE WHEN vec_id % 7 = 0 THEN 'box_h_outside' END, CASE WHEN vec_id % 5 = 0 THEN 'box_without_area' END, CASE WHEN vec_id % 3 <> 0 THEN 'point0_x_outside' END, CASE WHEN vec_id % 11 = 0 THEN 'point0_visibility_outside' END], lambda x: x IS NOT NULL) END AS s FROM t)
SELECT issue, count(*) AS n FROM (SELECT unnest(s) AS issue FROM i) GROUP BY issue""")
def label_line_issues(spark, d):
    """SRC-07, QC-15."""
    lines = annotations.label_issues(annotations.label_lines(_label_files(spark, d)), 6, 1)
    return lines.select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


@query("SELECT s_suppkey AS rig, CASE WHEN abs(s_acctbal) / 3000 < 1 THEN 'GOOD' WHEN abs(s_acctbal) / 3000 <= 2 THEN 'ACCEPTABLE' ELSE 'REPEAT' END AS verdict FROM supplier")
def calibration_verdicts(spark, d):
    """QC-09."""
    return T.read(spark, d, "supplier").select(F.col("s_suppkey").alias("rig"), calibration_verdict(F.abs("s_acctbal") / 3000).alias("verdict"))


# --- curation -------------------------------------------------------------------------------------------------------


@query("""WITH x AS (SELECT event_id, event_type AS kind, CASE event_id % 5 WHEN 0 THEN ' keep ' WHEN 1 THEN '' WHEN 2 THEN 'Remove' WHEN 4 THEN 'maybe' END AS manual, CASE WHEN value > 50 THEN 'Exclude' ELSE 'review' END AS automatic FROM events),
y AS (SELECT kind, coalesce(nullif(upper(trim(manual)), ''), upper(trim(automatic))) AS d FROM x) SELECT kind, CASE WHEN d IN ('KEEP', 'RELABEL', 'REVIEW') THEN d WHEN d IN ('EXCLUDE', 'REMOVE') THEN 'EXCLUDE' ELSE 'UNKNOWN' END AS final, count(*) AS n FROM y GROUP BY 1, 2""")
def final_decisions(spark, d):
    """QC-18, PRJ-08, AGG-24."""
    m = F.col("event_id") % 5
    x = T.read(spark, d, "events").select(F.col("event_type").alias("kind"), F.when(m == 0, " keep ").when(m == 1, "").when(m == 2, "Remove").when(m == 4, "maybe").alias("manual"), F.when(F.col("value") > 50, "Exclude").otherwise("review").alias("automatic"))
    return annotations.apply_decisions(x).groupBy("kind", "final").agg(F.count("*").alias("n"))


_SQL_CROSS = _SQL_NEAR.replace("min(doc_id) AS key FROM h GROUP BY hi, lo", f"min(doc_id) AS key, bool_or({_SPLIT} = 'train') AS in_train, bool_or({_SPLIT} = 'valid') AS in_valid, bool_or({_SPLIT} = 'test') AS in_test FROM h GROUP BY hi, lo")


@query(_SQL_CROSS + """ SELECT a_key, b_key, 'near' AS kind FROM pr JOIN o a ON a.key = a_key JOIN o b ON b.key = b_key WHERE distance <= 3 AND ((a.in_train AND (b.in_valid OR b.in_test)) OR (a.in_valid AND (b.in_train OR b.in_test)) OR (a.in_test AND (b.in_train OR b.in_valid)))
UNION ALL SELECT key, key, 'exact' FROM o WHERE in_train::INT + in_valid::INT + in_test::INT > 1""")
def cross_split_duplicates(spark, d):
    """DUP-04: hashes shared between splits (exact), and pairs of different hashes at most 3 bits apart that span splits."""
    h = dedup.simhash(T.read(spark, d, "documents"), "doc_id", "text").withColumn("split", F.expr(_SPLIT)).withColumnRenamed("doc_id", "key")
    return dedup.cross_split(h, 3)


@query("""WITH e AS (SELECT o_custkey % 50 AS a, o_orderkey % 40 AS b, (o_orderkey * 7 % 6)::INT AS distance FROM orders) SELECT least(a, b) AS a, greatest(a, b) AS b, min(distance) AS distance, count(*) AS n FROM e WHERE a <> b GROUP BY 1, 2""")
def least_edges(spark, d):
    """DUP-08."""
    e = T.read(spark, d, "orders").select((F.col("o_custkey") % 50).alias("u"), (F.col("o_orderkey") % 40).alias("v"), (F.col("o_orderkey") * 7 % 6).cast("int").alias("distance"))
    return e.filter("u <> v").groupBy(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(F.min("distance").alias("distance"), F.count("*").alias("n"))


@query(f"""WITH c AS (SELECT regexp_extract(text, '^(\\S+)', 1) AS clip, {_SPLIT} AS split FROM documents) SELECT clip, count(*) FILTER (WHERE split = 'train') AS train, count(*) FILTER (WHERE split = 'valid') AS valid, count(*) FILTER (WHERE split = 'test') AS test, string_agg(DISTINCT split, ' | ' ORDER BY split) AS splits FROM c GROUP BY clip HAVING count(DISTINCT split) > 1""")
def clip_leakage(spark, d):
    """DUP-11, SPL-07, AGG-18: source clips found in more than one split."""
    c = T.read(spark, d, "documents").select(F.regexp_extract("text", r"^(\S+)", 1).alias("clip"), F.expr(_SPLIT).alias("split"))
    one = c.groupBy("clip").agg(*(F.count_if(F.col("split") == s).alias(s) for s in ("train", "valid", "test")), F.array_sort(F.collect_set("split")).alias("s"))
    return one.filter(F.size("s") > 1).select("clip", "train", "valid", "test", F.array_join("s", " | ").alias("splits"))


@query(r"SELECT page_id, coalesce(lower(nullif(regexp_extract(url, '([A-Za-z_]+)(\d{3,})', 1), '')) || '_block_' || lpad((regexp_extract(url, '([A-Za-z_]+)(\d{3,})', 2)::BIGINT // 25)::VARCHAR, 4, '0'), '') AS hint FROM (SELECT page_id, 'clip' || (page_id * 37) || '_' || 'Extract' || lpad((page_id * 3)::VARCHAR, 3, '0') AS url FROM pages)")
def sequence_hints(spark, d):
    """STR-03, GEO-18: the first run of letters before three or more digits, and its block of 25."""
    k = F.col("page_id")
    name = F.concat(F.lit("clip"), (k * 37).cast("string"), F.lit("_Extract"), F.lpad((k * 3).cast("string"), F.greatest(F.lit(3), F.length((k * 3).cast("string"))), F.lit("0")))
    return T.read(spark, d, "pages").select("page_id", audit.sequence_hint(name).alias("hint"))


# --- manifests ------------------------------------------------------------------------------------------------------


@query("""SELECT d.doc_id, d.lang, l.quality, md5('fold:' || d.source)[1:1] AS fold FROM documents d JOIN labels l USING (doc_id)""")
def folds_with_features(spark, d):
    """JOI-01, PRJ-01."""
    return T.read(spark, d, "documents").select("doc_id", "lang", "source").join(T.read(spark, d, "labels").select("doc_id", "quality"), "doc_id").select("doc_id", "lang", "quality", F.substring(F.md5(F.concat(F.lit("fold:"), "source").cast("binary")), 1, 1).alias("fold"))


@query("""SELECT (SELECT count(*) FROM documents) AS left_rows, (SELECT count(*) FROM labels) AS right_rows, (SELECT count(*) FROM documents ANTI JOIN labels USING (doc_id)) AS only_left, (SELECT count(*) FROM labels ANTI JOIN documents USING (doc_id)) AS only_right, (SELECT count(*) FROM documents JOIN labels USING (doc_id) WHERE n_chars % 2 <> quality) AS unequal""")
def aligned_tables(spark, d):
    """JOI-08, SET-03: two tables meant to hold the same keys and truths, as one row of counts from one full join."""
    a = T.read(spark, d, "documents").select("doc_id", (F.col("n_chars") % 2).alias("truth"))
    return audit.alignment(a, T.read(spark, d, "labels").select("doc_id", F.col("quality").alias("truth")), "doc_id", "truth")


@query("""WITH u AS (SELECT page_id, url, replace(CASE WHEN page_id % 3 = 0 THEN 'C:\\data\\' || replace(upper(url), '/', '\\') WHEN page_id % 3 = 1 THEN url ELSE 'x' END, '\\', '/') AS raw FROM pages),
m AS (SELECT page_id, raw, (SELECT min(p.page_id) FROM pages p WHERE p.url = raw) AS exact, (SELECT min(p.page_id) FROM pages p WHERE ends_with(lower(raw), lower(p.url))) AS tail FROM u) SELECT page_id, coalesce(exact, tail) AS found FROM m""")
def suffix_lookup(spark, d):
    """JOI-09, PRJ-07: the exact path first, else the first file whose path ends the given one; probed by suffix, not by comparing all pairs."""
    p = T.read(spark, d, "pages").select("page_id", "url")
    raw = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("C:\\data\\"), F.translate(F.upper("url"), "/", "\\"))).when(F.col("page_id") % 3 == 1, F.col("url")).otherwise("x")
    return audit.by_suffix(p.select("page_id", raw.alias("raw")), "page_id", "raw", p.select(F.col("page_id").alias("found"), F.col("url").alias("path")), "path", "found")


@query("""SELECT 'excluded_label' AS expectation, count(*) FILTER (WHERE o_orderstatus = 'P') AS violations FROM orders UNION ALL SELECT 'class_in_range', count(*) FILTER (WHERE NOT coalesce(o_custkey % 6 BETWEEN 0 AND 5, false)) FROM orders UNION ALL SELECT 'no_null_key', count(*) FILTER (WHERE o_orderkey IS NULL) FROM orders UNION ALL SELECT 'unique_key', (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)) UNION ALL SELECT 'finite', count(*) FILTER (WHERE NOT coalesce(isfinite(o_totalprice), true)) FROM orders""")
def manifest_expectations(spark, d):
    """EXP-01, QC-16, FLT-01..09."""
    o = T.read(spark, d, "orders")
    return audit.expectations(o, {"excluded_label": ~F.col("o_orderstatus").isin("P"), "class_in_range": (F.col("o_custkey") % 6).between(0, 5), "no_null_key": F.col("o_orderkey").isNotNull(), "finite": F.coalesce(F.abs("o_totalprice") != float("inf"), F.lit(True))}, unique="o_orderkey")


@query("SELECT 'CAP' || lpad((max(TRY_CAST(regexp_extract('CAP' || lpad(c_custkey::VARCHAR, 6, '0'), '(\\d+)$', 1) AS BIGINT)) + 1)::VARCHAR, 6, '0') AS next_id FROM customer".replace("\\\\", "\\"))
def next_capture_id(spark, d):
    """SRC-14."""
    return audit.next_id(T.read(spark, d, "customer").select(F.format_string("CAP%06d", "c_custkey").alias("id")), "id", "CAP", 6)


@query("""WITH s AS (SELECT user_id % 24 AS subject, count(DISTINCT date_trunc('day', ts)) AS sessions, count(*) AS captures FROM events GROUP BY 1) SELECT *, rank() OVER (ORDER BY captures DESC, subject) AS place FROM s""")
def subject_sessions(spark, d):
    """AGG-23, ORD-01, ORD-02, ORD-09: the rank is over one row a subject."""
    s = T.read(spark, d, "events").groupBy((F.col("user_id") % 24).alias("subject")).agg(F.count_distinct(F.date_trunc("day", "ts")).alias("sessions"), F.count("*").alias("captures"))
    return s.withColumn("place", F.row_number().over(Window.orderBy(F.desc("captures"), "subject")).cast("bigint"))


@query("SELECT o_orderpriority AS label, count(*) AS n FROM orders GROUP BY 1")
def sorted_value_counts(spark, d):
    """AGG-01, AGG-03."""
    return T.read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("label")).agg(F.count("*").alias("n")).orderBy("label")


@query("SELECT doc_id AS id, 'documents' AS part FROM documents UNION ALL SELECT page_id, 'pages' FROM pages UNION ALL SELECT item_id, 'benchmark' FROM benchmark")
def union_of_splits(spark, d):
    """SET-02, PRJ-02."""
    one = lambda t, k: T.read(spark, d, t).select(F.col(k).alias("id"), F.lit(t).alias("part"))
    return one("documents", "doc_id").unionByName(one("pages", "page_id")).unionByName(one("benchmark", "item_id"))


@query("SELECT fold, count(*) AS shared FROM (SELECT c_nationkey % 5 AS fold, c_mktsegment FROM customer INTERSECT SELECT (c_nationkey + 1) % 5, c_mktsegment FROM customer) GROUP BY fold")
def shared_subjects(spark, d):
    """SET-04: keys found on both sides of a split; none would mean that they are disjoint."""
    c = T.read(spark, d, "customer")
    a, b = c.select((F.col("c_nationkey") % 5).alias("fold"), "c_mktsegment"), c.select(((F.col("c_nationkey") + 1) % 5).alias("fold"), "c_mktsegment")
    return a.intersect(b).groupBy("fold").agg(F.count("*").alias("shared"))


# --- splits ---------------------------------------------------------------------------------------------------------


_PICK = "CASE WHEN greatest(0, r0) >= greatest(0, r1) AND greatest(0, r0) >= greatest(0, r2) THEN 0 WHEN greatest(0, r1) >= greatest(0, r2) THEN 1 ELSE 2 END"


@query(f"""WITH RECURSIVE c AS (SELECT c_nationkey AS grp, count(*) AS n FROM customer GROUP BY 1), g AS (SELECT grp, n, row_number() OVER (ORDER BY n DESC, md5('split:' || grp), grp) AS nth FROM c), t AS (SELECT sum(n)::BIGINT AS n FROM c),
s AS (SELECT 0::BIGINT AS nth, floor(n * 0.70::DOUBLE)::BIGINT AS r0, floor(n * 0.15::DOUBLE)::BIGINT AS r1, (n - floor(n * 0.70::DOUBLE) - floor(n * 0.15::DOUBLE))::BIGINT AS r2, -1 AS pick FROM t
UNION ALL SELECT g.nth, r0 - CASE WHEN p = 0 THEN g.n ELSE 0 END, r1 - CASE WHEN p = 1 THEN g.n ELSE 0 END, r2 - CASE WHEN p = 2 THEN g.n ELSE 0 END, p FROM (SELECT *, {_PICK} AS p FROM s) s JOIN g ON g.nth = s.nth + 1)
SELECT grp, n, CASE pick WHEN 0 THEN 'train' WHEN 1 THEN 'valid' ELSE 'test' END AS split FROM s JOIN g USING (nth)""")
def group_split_greedy(spark, d):
    """SPL-02."""
    c = T.read(spark, d, "customer")
    return folds.greedy_split(c.groupBy(F.col("c_nationkey").alias("grp")).agg(F.count("*").alias("n")), "grp", "n", c.count())


_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
_SPREAD = f"round(sqrt(({' + '.join(f'pow(n{i} - ({chr(43).join(f' n{j} ' for j in range(5))}) / 5, 2)' for i in range(5))}) / 5), 9)"
# the cost of giving the next group to fold f: the mean, over classes, of the spread between folds
_COST = lambda f: "round((" + " + ".join(f"list_aggregate([{', '.join(f'(h[{5 * g + c + 1}]' + (f' + n{c}' if g == f else '') + f') / w{c}' for g in range(5))}], 'stddev_pop')" for c in range(5)) + ") / 5, 12)"
_ROWS = lambda f: " + ".join(f"h[{5 * f + c + 1}] + n{c}" for c in range(5))


@query(f"""WITH RECURSIVE k AS (SELECT c_nationkey AS grp, {', '.join(f"count(*) FILTER (WHERE c_mktsegment = '{s}') AS n{i}" for i, s in enumerate(_SEGMENTS))} FROM customer GROUP BY 1),
t AS (SELECT {', '.join(f'greatest(1, sum(n{i})) AS w{i}' for i in range(5))} FROM k), g AS (SELECT *, row_number() OVER (ORDER BY {_SPREAD} DESC, {', '.join(f'n{i} DESC' for i in range(5))}, md5('42:' || grp), grp) AS nth FROM k, t),
s AS (SELECT 0::BIGINT AS nth, [0::DOUBLE FOR x IN range(25)] AS h, -1 AS fold UNION ALL
SELECT nth, [h[x + 1] + CASE WHEN x // 5 = f THEN [n0, n1, n2, n3, n4][x % 5 + 1] ELSE 0 END FOR x IN range(25)], f FROM (SELECT g.*, s.h, list_sort([{', '.join(f"[{_COST(f)}, {_ROWS(f)}, {f}]" for f in range(5))}])[1][3]::INT AS f FROM s JOIN g ON g.nth = s.nth + 1))
SELECT grp, fold FROM s JOIN g USING (nth)""")
def stratified_group_folds(spark, d):
    """SPL-03, SPL-04."""
    return folds.stratified_folds(T.read(spark, d, "customer").select(F.col("c_nationkey").alias("grp"), "c_mktsegment"), "grp", "c_mktsegment", list(_SEGMENTS))


@query()
def augmented_rows(spark, d):
    """SPL-08: statistical, tested by its invariants."""
    return rounded(folds.augment(T.read(spark, d, "supplier").select((F.col("s_nationkey") % 3).alias("label"), F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("f1"), (F.col("s_suppkey") * 0.5).alias("f2")), "label", "key", ["f1", "f2"], [1, 2], 40))
