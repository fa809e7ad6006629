"""Writers that lay the given tables out in the input formats.

They make the source readers run on data that grows with the tables: the
conversations become question/answer JSON lines, labelled documents a CSV
and folders of JSON files.  All writing is done by Spark tasks; the only
driver-side step is renaming the JSON files (metadata only, one call per file).
"""

from __future__ import annotations

import csv
import io
import math
import uuid
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import hash32
from . import files, zipcsv
from .readers import NULL_IN_PATH, QA_AI, QA_HUMAN, QA_QUESTION

JSON_FILE_ROWS = 1000  # texts per written JSON file
ARCHIVE_ROWS = 50_000  # texts per written zip archive
TURNS_PER_RECORD = 64  # conversation turns per question/answer record
_NO_LABEL = "null"  # in a file key, the kind of texts without a label


def conversations_to_qa(conv: DataFrame, turns_per_record: int = TURNS_PER_RECORD) -> DataFrame:
    """Question/answer records: system turn as question, user and assistant turns as answers.

    A record holds the answers of one block of ``turns_per_record`` turns
    (``part`` = turn div block size), so no record or task ever collects a
    whole conversation, however long.  The question is a per-conversation
    aggregate (``min_by``, bounded state) joined to every block.
    """
    def answers(role):
        return F.transform(
            F.sort_array(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))),
            lambda s: s["text"])
    q = conv.groupBy("conv_id").agg(
        F.min_by(F.when(F.col("role") == "system", F.col("text")),
                 F.when(F.col("role") == "system", F.col("turn"))).alias(QA_QUESTION))
    blocks = (conv.filter(F.col("role").isin("user", "assistant"))
              .groupBy("conv_id", F.floor(F.col("turn") / turns_per_record).alias("part"))
              .agg(answers("user").alias(QA_HUMAN), answers("assistant").alias(QA_AI)))
    return blocks.join(q, "conv_id").select(F.col("conv_id").alias("id"), "part",
                                            QA_QUESTION, QA_HUMAN, QA_AI)


def write_qa_jsonl(conv: DataFrame, path: str, broken_every: int | None = None) -> str:
    """Write JSON lines; with ``broken_every`` = k, records with hash % k == 0 are cut in half."""
    rec = conversations_to_qa(conv)
    line = F.to_json(F.struct(*[F.col(c) for c in ("id", "part", QA_QUESTION, QA_HUMAN, QA_AI)]))
    if broken_every:
        cut = F.pmod(hash32("broken", F.concat_ws(":", "id", "part")), F.lit(broken_every)) == 0
        line = F.when(cut, F.substring(line, 1, F.floor(F.length(line) / 2).cast("int"))).otherwise(line)
    rec.select(line.alias("value")).write.mode("overwrite").text(path)
    return path


def write_labelled_csv(ex: DataFrame, path: str, keep_unknown: bool = False) -> str:
    """CSV with header ``text,generator,doc_id``; generator 'human' for label 0.  A null generator is a missing field, which
    readers skip; with ``keep_unknown`` it is a quoted empty one, which they keep."""
    gen = F.when(F.col("label") == 0, F.lit("human")).otherwise(F.concat(F.lit("gen_"), F.col("source")))
    (ex.select("text", (F.coalesce(gen, F.lit("")) if keep_unknown else gen).alias("generator"), F.col("example_id").alias("doc_id"))
       .write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"')
       .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
       .csv(path))
    return path


def write_zipped_csv(ex: DataFrame, root: str, archives: int | None = None, members: int = 3) -> str:
    """Zip archives of CSV members (header ``text,label``; generator 'human' for label 0), besides a member of
    another kind and one under ``__MACOSX``.  Every task streams its archives and moves them into place when they are
    whole; there is one archive for some ``ARCHIVE_ROWS`` rows, at least four."""
    archives = archives or max(4, math.ceil(ex.count() / ARCHIVE_ROWS))
    gen = F.when(F.col("label") == 0, F.lit("human")).otherwise(F.concat(F.lit("gen_"), F.col("source")))
    slot = F.pmod(hash32("zip", "example_id"), F.lit(archives * members))
    rows = ex.select(F.floor(slot / members).cast("int").alias("archive"), F.pmod(slot, F.lit(members)).cast("int").alias("member"),
                     "text", gen.alias("generator"))
    rows = rows.repartition(archives, "archive").sortWithinPartitions("archive", "member")

    def write(batches):
        system, folder = files.resolve(root)
        system.create_dir(folder)
        at = archive = lines = None

        def close():
            lines.flush()
            lines.close()
            archive.writestr("readme.txt", "no table")
            archive.writestr(f"{zipcsv.SKIPPED_PREFIX}/m0.csv", "text,label\n" + "x" * 99 + ",human\n")
            archive.close()
            out.close()
            system.move(temporary, f"{folder}/part-{at[0]}.zip")

        for pdf in batches:
            for a, m, text, generator in pdf.itertuples(index=False):
                if at is None or at[0] != a:
                    if at is not None:
                        close()
                    temporary = f"{folder}/.{uuid.uuid4().hex}"
                    out = system.open_output_stream(temporary)
                    archive, at = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED), (a, None)
                if at[1] != m:
                    if at[1] is not None:
                        lines.close()
                    lines = io.TextIOWrapper(archive.open(f"data/m{m}.csv", "w", force_zip64=True), encoding="utf-8", newline="")
                    record = csv.writer(lines)
                    record.writerow(["text", "label"])
                    at = (a, m)
                record.writerow([text, generator])
        if at is not None:
            close()
            yield pd.DataFrame({"archive": [at[0]]})

    rows.mapInPandas(write, "archive int").count()
    return root


def write_poly_json(spark: SparkSession, ex: DataFrame, root: str, file_rows: int = JSON_FILE_ROWS) -> str:
    """Folders ``<root>/<domain>/{gpt,hum}-<bucket>.json`` in three shapes.

    Shape per (domain, label): a list of strings, a list of objects with the
    text under ``text`` / ``essay`` / ``content``, or an object keyed by id (an
    id that comes again in a file: by id and place).  Each file holds about
    ``file_rows`` texts (bounded groups).  A null domain or label is
    ``NULL_IN_PATH`` in the path.
    """
    n = ex.count()
    nb = max(1, math.ceil(n / file_rows))
    kind = (F.when(F.col("label") == 1, F.lit("gpt")).when(F.col("label").isNull(), F.lit(_NO_LABEL))
             .otherwise(F.lit("hum")))
    x = ex.select("example_id", "text", F.col("domain"), kind.alias("kind"),
                  F.pmod(hash32("file", "example_id"), F.lit(nb)).alias("bucket"))
    slot = F.pmod(hash32("key", "example_id"), F.lit(3))
    obj = F.struct(F.when(slot == 0, F.col("text")).otherwise(F.lit("")).alias("text"),
                   F.when(slot == 1, F.col("text")).otherwise(F.lit("")).alias("essay"),
                   F.when(slot == 2, F.col("text")).otherwise(F.lit("")).alias("content"))
    g = x.groupBy("domain", "kind", "bucket").agg(
        F.sort_array(F.collect_list(F.struct("example_id", "text", obj.alias("obj")))).alias("items"))

    def name(s, i):
        again = F.get("items", i - 1)["example_id"] == s["example_id"]
        return F.when(again, F.concat_ws("-", s["example_id"].cast("string"), i.cast("string"))).otherwise(s["example_id"].cast("string"))
    shape = F.pmod(hash32("shape", F.concat_ws(":", "domain", "kind")), F.lit(3))
    body = (F.when(shape == 0, F.to_json(F.transform("items", lambda s: s["text"])))
             .when(shape == 1, F.to_json(F.transform("items", lambda s: s["obj"])))
             .otherwise(F.to_json(F.map_from_entries(F.transform(
                 "items", lambda s, i: F.struct(name(s, i), s["text"]))))))
    key = F.concat_ws("__", "kind", F.col("bucket").cast("string"), F.coalesce("domain", F.lit(NULL_IN_PATH)))
    staging = root.rstrip("/") + "_staging"
    g.select(key.alias("file_key"), body.alias("value")).write.mode("overwrite") \
        .partitionBy("file_key").text(staging)
    _place_files(spark, staging, root)
    return root


def _place_files(spark: SparkSession, staging: str, root: str) -> None:
    """Move ``staging/file_key=K__B__D/part-*`` to ``root/D/K-B.json`` (Hadoop FS renames)."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    Path = jvm.org.apache.hadoop.fs.Path
    src = Path(staging)
    fs = src.getFileSystem(conf)
    fs.mkdirs(Path(root))
    for st in fs.listStatus(src):
        name = st.getPath().getName()
        if not st.isDirectory() or not name.startswith("file_key="):
            continue
        kind, bucket, domain = name[len("file_key="):].split("__", 2)
        if kind == _NO_LABEL:
            kind = f"label-{NULL_IN_PATH}"
        target_dir = Path(f"{root.rstrip('/')}/{domain}")
        fs.mkdirs(target_dir)
        parts = [p for p in fs.listStatus(st.getPath()) if p.getPath().getName().startswith("part-")]
        for i, p in enumerate(parts):
            suffix = "" if i == 0 else f"-{i}"
            fs.rename(p.getPath(), Path(f"{root.rstrip('/')}/{domain}/{kind}-{bucket}{suffix}.json"))
