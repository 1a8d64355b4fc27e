"""Token counts as delta-maintained rollups (operator 5).

A store holds additive totals (documents, tokens) by source, language and tokenizer version. Changes come in batches of signed rows: +1 for an insert,
-1 for a delete, and for a revised count the difference of the two counts with sign 0 for documents. A batch is summed by key before and in the shuffle
(a hot source costs one row a task) and written to a folder of its own that no one else knows. What counts is the *log*: numbered entries, each made whole by one rename that
fails where the number is taken. An entry names the folders that it adds, the batches in them, and the folders that it replaces.

* ``commit`` adds a folder and its batch id. If another writer took the number, the log is read again: the same id is then known and nothing is added, so retries,
  replays after a lost driver and two writers of one batch change nothing.
* ``compact`` writes the totals of all folders to a new one and replaces them in one entry; a crash before it leaves the old folders, one after it the new one, never both. Replaced folders stay
  for readers that began before; ``vacuum`` deletes what the log no longer names.

The log needs a file system whose rename is atomic (HDFS, local); the driver reads one small entry a commit. Batch ids are kept for good.

Tokenizers (``TOKENIZERS``) count marks of the UTF-8 bytes, vectorised over Arrow batches; any Column serves as well. Nulls: null text has 0 tokens; null source and lang are keys of
their own. Keys whose documents and tokens are both 0 again stay out of ``totals``. Empty batches commit nothing but their id. Repeated rows count each. Other columns are ignored.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm._spark import by_text, cut, join_hot, shared_dir, text_hash
from tarn.llm._words import ALNUM, SPACED, chunks

KEY = ["source", "lang", "tokenizer"]
#: for each tokenizer version, the bytes that make up words (a token a word) and those that are a token each
TOKENIZERS = {
    # runs of other than white space
    "spaced-1": (SPACED, np.zeros(256, bool)),
    # words (ASCII letters and digits, all beyond ASCII) and single marks
    "marks-2": (ALNUM, ~ALNUM & (np.arange(256) > 0x20) & (np.arange(256) < 0x7F)),
}
_SCHEMA = "source string, lang string, tokenizer string, docs bigint, tokens bigint"


def inserts(docs: DataFrame, tokenizer: str, tokens: Column | str, sign: int = 1) -> DataFrame:
    """Signed rows of documents added (sign 1) or taken away (-1)."""
    n = F.col(tokens) if isinstance(tokens, str) else tokens
    return docs.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(sign).cast("bigint").alias("docs"), (n * sign).cast("bigint").alias("tokens"))


def revisions(docs: DataFrame, tokenizer: str, old: Column | str, new: Column | str) -> DataFrame:
    """Signed rows of counts that were revised."""
    old, new = (F.col(x) if isinstance(x, str) else x for x in (old, new))
    return docs.filter(~old.eqNullSafe(new)).select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(0).cast("bigint").alias("docs"), (new - old).cast("bigint").alias("tokens"))


def tokens(text: pa.Array) -> list[np.ndarray]:
    """Tokens of each text under every tokenizer."""
    out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in TOKENIZERS]
    for _, _, data, offsets in chunks(text):
        for own, (words, single) in zip(out, TOKENIZERS.values(), strict=True):
            inside = words[data]
            begins = inside.copy()
            begins[1:] &= ~inside[:-1]
            first = offsets[:-1][offsets[:-1] < len(data)]
            begins[first] = inside[first]
            total = np.concatenate([[0], np.cumsum(begins | single[data])])
            own.append(np.diff(total[offsets]))
    return [np.concatenate(x) for x in out]


def counted(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` and, for each tokenizer, the count of each document's tokens (- in its name is _)."""
    own = [f"k{i}" for i in range(len(keep))]
    names = [k.replace("-", "_") for k in TOKENIZERS]

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in own), *map(pa.array, tokens(batch.column("body")))], [*own, *names])

    return by_text(docs, keep, text, run, ", ".join(f"{n} bigint" for n in names))


class Rollup:
    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = (path or f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}").rstrip("/")

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm.org.apache.hadoop.fs, root.getFileSystem(conf), conf

    def _log(self) -> list[dict]:
        """The entries of the log, in order."""
        fs, files, _ = self._files()
        root = fs.Path(f"{self.path}/log")
        if not files.exists(root):
            return []
        names = sorted(x.getPath().getName() for x in files.listStatus(root))
        out = []
        for name in (n for n in names if n.isdigit()):
            stream = files.open(fs.Path(f"{self.path}/log/{name}"))
            try:
                out.append(json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
            finally:
                stream.close()
        return out

    def _append(self, number: int, entry: dict) -> bool:
        """Make entry ``number`` of the log; False if there is one."""
        fs, files, conf = self._files()
        draft = fs.Path(f"{self.path}/log/.draft-{uuid.uuid4().hex}")
        stream = files.create(draft, False)
        try:
            stream.write(json.dumps(entry).encode())
        finally:
            stream.close()
        context = fs.FileContext.getFileContext(draft.toUri(), conf)
        try:
            context.rename(draft, fs.Path(f"{self.path}/log/{number:012d}"), self.spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0))
        except Exception as e:
            files.delete(draft, False)
            if "FileAlreadyExistsException" in str(e):
                return False
            raise
        return True

    @staticmethod
    def _state(log: list[dict]) -> tuple[set[str], set[str]]:
        """(batches, folders that count)."""
        batches: set[str] = set()
        folders: set[str] = set()
        for entry in log:
            batches |= set(entry["batches"])
            folders = (folders - set(entry["replaces"])) | set(entry["adds"])
        return batches, folders

    def committed(self) -> set[str]:
        """The ids of all committed batches."""
        return self._state(self._log())[0]

    def _write(self, sums: DataFrame) -> str:
        name = f"data-{uuid.uuid4().hex}"
        sums.write.parquet(f"{self.path}/{name}")
        return name

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Add a batch once; False if it was committed before."""
        log, name = self._log(), None
        while batch not in self._state(log)[0]:
            name = name or self._write(deltas.groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")))
            if self._append(len(log), {"batches": [batch], "adds": [name], "replaces": []}):
                return True
            log = self._log()
        return False

    def _sums(self, folders: set[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], _SCHEMA)
        each = self.spark.read.schema(_SCHEMA).parquet(*(f"{self.path}/{d}" for d in sorted(folders)))
        return each.groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).filter("docs <> 0 or tokens <> 0")

    def totals(self) -> DataFrame:
        return self._sums(self._state(self._log())[1])

    def compact(self) -> bool:
        """Fold all folders in one; False if there is nothing to fold, or another writer came first."""
        log = self._log()
        folders = self._state(log)[1]
        if len(folders) < 2:
            return False
        return self._append(len(log), {"batches": [], "adds": [self._write(self._sums(folders))], "replaces": sorted(folders)})

    def vacuum(self) -> int:
        """Delete the folders that the log replaced or never named; call it when no commit or older reader is under way."""
        fs, files, _ = self._files()
        keep = self._state(self._log())[1]
        gone = [x.getPath() for x in files.listStatus(fs.Path(self.path)) if x.getPath().getName().startswith("data-") and x.getPath().getName() not in keep]
        for path in gone:
            files.delete(path, True)
        return len(gone)


def digest(docs: DataFrame) -> DataFrame:
    """All documents are inserted under two tokenizers, the first with the byte count as a first guess that a later batch revises; copies of a text (all but its least doc_id) are deleted; every batch is replayed once."""
    one, two = TOKENIZERS
    base = docs.select("doc_id", "source", "lang", text_hash("text").alias("mark"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("guess"), "text")
    light = cut(counted(base, ["doc_id", "source", "lang", "mark", "guess"]))
    a, b = (k.replace("-", "_") for k in (one, two))
    first = cut(light.groupBy("mark").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")).filter("rows > 1"))
    copies = join_hot(light, first, "mark", "rows").filter(F.col("doc_id") > F.col("first"))
    store = Rollup(docs.sparkSession)
    batches = {
        "1-insert": inserts(light, one, "guess"),
        "2-revise": revisions(light, one, "guess", a),
        "3-second": inserts(light, two, b),
        "4-delete": inserts(copies, one, a, -1).unionByName(inserts(copies, two, b, -1)),
    }
    for name, deltas in [*batches.items(), *batches.items()]:
        store.commit(name, deltas)
    return store.totals()


ORACLE_SQL = r"""
WITH d AS (
  SELECT source, lang, doc_id, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS a,
         coalesce(len(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]')), 0) AS b
  FROM documents
), k AS (SELECT * FROM d WHERE doc_id IS NULL OR doc_id = first)
SELECT source, lang, 'spaced-1' AS tokenizer, count(*)::BIGINT AS docs, sum(a)::BIGINT AS tokens FROM k GROUP BY source, lang
UNION ALL
SELECT source, lang, 'marks-2', count(*)::BIGINT, sum(b)::BIGINT FROM k GROUP BY source, lang
"""
