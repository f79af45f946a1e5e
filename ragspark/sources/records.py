"""JSON lines in and out, question banks, answer keys and run logs."""

from __future__ import annotations

import hashlib
import io
import json
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StringType, StructField, StructType
from pyspark.sql.window import Window

QUESTION = "id bigint, formato string, pregunta string, opciones map<string,string>, area string"


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Rows of JSON lines in a declared schema; blank lines give none, broken ones fail."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_log(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows of a run's log up to the first line of a file that cannot be read, as one cut off by a crash."""
    lines = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("_file"), F.posexplode(F.split("value", "\n")).alias("_n", "_line")).filter(F.trim("_line") != "")
    held = StructType([*schema.fields, StructField("_broken", StringType())])
    rows = lines.withColumn("_row", F.from_json("_line", held, {"columnNameOfCorruptRecord": "_broken"}))
    cut = F.max(F.col("_row._broken").isNotNull().cast("int")).over(
        Window.partitionBy("_file").orderBy("_n").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("_cut", cut).filter("_cut = 0").select("_row.*").drop("_broken")


def _not_finite(df: DataFrame) -> Column:
    bad = F.lit(False)
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            bad = bad | F.coalesce(F.isnan(f.name) | (F.abs(f.name) == float("inf")), F.lit(False))
    return bad


def write_jsonl(df: DataFrame, path: str, order: list[str] | None = None, mode: str = "error") -> int:
    """JSON lines without null fields, in ``order`` within files; a number that is not finite fails the write. Returns the number of rows."""
    checked = df.filter(F.when(_not_finite(df), F.raise_error(F.lit("a number is not finite"))).otherwise(F.lit(True)))
    seen = Observation("written")
    placed = (checked.repartitionByRange(*order).sortWithinPartitions(*order) if order else checked).observe(seen, F.count(F.lit(1)).alias("n"))
    placed.write.mode(mode).option("ignoreNullFields", "true").json(path)
    return seen.get["n"]


def load_bank(closed: DataFrame, open_: DataFrame, archived: bool = False) -> DataFrame:
    """Both lists of a question bank as one, approved ones only unless ``archived``, with the position in (formato, id) order."""
    both = closed.withColumn("formato", F.lit("cerrada")).unionByName(
        open_.withColumn("formato", F.coalesce("formato", F.lit("abierta"))), allowMissingColumns=True)
    return (both if archived else both.filter("state = 'approved'")).orderBy("formato", "id")


def chosen_questions(questions: DataFrame, ids: list[int] | None = None) -> DataFrame:
    """The questions with the given ids, all if none are given; an unknown id is an error."""
    if not ids:
        return questions
    found = questions.filter(F.col("id").isin(ids))
    missing = set(ids) - {r["id"] for r in found.select("id").distinct().collect()}
    if missing:
        raise ValueError(f"unknown question ids: {sorted(missing)}")
    return found


def search_text(question: Column, options: Column) -> Column:
    """A question and its options, by letter, one on a line."""
    values = F.transform(F.array_sort(F.map_entries(options)), lambda e: e["value"])
    return F.concat_ws("\n", question, F.array_join(values, "\n"))


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def read_json(spark: SparkSession, path: str):
    """One JSON document, as Python values, from any storage that Spark reads."""
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def write_json(spark: SparkSession, value, path: str) -> None:
    """One JSON document as a single file; numbers that are not finite are an error."""
    place, files = _at(spark, path)
    out = files.create(place, True)
    try:
        out.write(bytearray((json.dumps(value, ensure_ascii=False, indent=2, allow_nan=False) + "\n").encode()))
    finally:
        out.close()


# -- runs -----------------------------------------------------------------------------------------------------------------------------------


def append_run(answers: DataFrame, traces: DataFrame, path: str) -> int:
    """Append finished items to a run: the traces first, so that an answer is never without one. Returns the number of answers."""
    write_jsonl(traces, f"{path}/traces", mode="append")
    return write_jsonl(answers, f"{path}/answers", mode="append")


def finished(spark: SparkSession, path: str, answer: StructType, trace: StructType) -> tuple[DataFrame, DataFrame]:
    """Answers and traces of the items that are in both logs, the last of a repeated id."""
    logs = []
    for name, schema in (("answers", answer), ("traces", trace)):
        rows = read_log(spark, f"{path}/{name}", schema)
        logs.append(rows.groupBy("id").agg(F.max(F.struct(*[c for c in rows.columns if c != "id"])).alias("_r")).select("id", "_r.*"))
    answers, traces = logs
    return answers.join(traces.select("id"), "id", "left_semi"), traces.join(answers.select("id"), "id", "left_semi")


def finalise_run(spark: SparkSession, path: str, answer: StructType, trace: StructType) -> int:
    """Rewrite both logs sorted by id, with the items that are in both; the old ones are replaced when the new ones are whole."""
    answers, traces = finished(spark, path, answer, trace)
    n = write_jsonl(answers, f"{path}/answers.new", ["id"], "overwrite")
    write_jsonl(traces, f"{path}/traces.new", ["id"], "overwrite")
    for name in ("traces", "answers"):
        old, files = _at(spark, f"{path}/{name}")
        files.delete(old, True)
        files.rename(_at(spark, f"{path}/{name}.new")[0], old)
    return n


def latest_unfinished(runs: DataFrame, split: str) -> DataFrame:
    """Of runs(nombre, split, terminada, ids) the last by name of a split that has not ended and is not of chosen ids."""
    return runs.filter((F.col("split") == split) & ~F.coalesce("terminada", F.lit(False)) & F.col("ids").isNull()).orderBy(F.desc("nombre")).limit(1)


# -- packages -------------------------------------------------------------------------------------------------------------------------------


def members(name: str, data: bytes) -> Iterator[tuple[str, bytes]]:
    """Files of a package and of the packages within it, by path."""
    with zipfile.ZipFile(io.BytesIO(data)) as package:
        for info in package.infolist():
            if info.is_dir():
                continue
            path, body = f"{name}/{info.filename}", package.read(info)
            if info.filename.lower().endswith(".zip"):
                yield from members(path, body)
            else:
                yield path, body


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """``paquete``, ``ruta``, ``carpeta``, ``base``, ``extension``, ``sha256`` and ``contenido`` of the files in all packages at ``path``."""
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"], strict=True):
                rows = []
                for where, body in members(name.rsplit("/", 1)[-1], data):
                    folder, _, file = where.rpartition("/")
                    stem, dot, extension = file.rpartition(".")
                    rows.append((name, where, folder, stem if dot else file, (dot + extension).lower() if dot else "", hashlib.sha256(body).hexdigest(), body))
                yield pd.DataFrame(rows, columns=["paquete", "ruta", "carpeta", "base", "extension", "sha256", "contenido"])

    schema = "paquete string, ruta string, carpeta string, base string, extension string, sha256 string, contenido binary"
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(each, schema)


def preferred(files: DataFrame, extensions: tuple[str, ...] = (".docx", ".doc", ".pdf")) -> DataFrame:
    """Of the files with one folder and stem the one of the first of ``extensions``; other kinds go."""
    rank = F.array_position(F.array(*map(F.lit, extensions)), F.col("extension"))
    best = Window.partitionBy("carpeta", "base").orderBy(rank, "ruta")
    return files.filter(F.col("extension").isin(*extensions)).withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")


def distinct_contents(files: DataFrame, name: Column) -> DataFrame:
    """The first file by path of each content, with ``doc_id``: ``name``, and ``_k`` behind it from the second file of a name on."""
    first = files.withColumn("_n", F.row_number().over(Window.partitionBy("sha256").orderBy("ruta"))).filter("_n = 1").withColumn("_name", name)
    k = F.row_number().over(Window.partitionBy("_name").orderBy("ruta"))
    return first.withColumn("_k", k).withColumn("doc_id", F.when(F.col("_k") > 1, F.concat_ws("_", "_name", "_k")).otherwise(F.col("_name"))).drop("_n", "_k", "_name")


ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50}


def roman(text: str) -> int:
    """A roman numeral up to 89; other letters count nothing."""
    values = [ROMAN.get(c, 0) for c in text]
    return sum(-a if b > a else a for a, b in zip(values, [*values[1:], 0], strict=True))


def chapter_order(path: str) -> tuple[list[int], int, int]:
    """Part, title and chapter as numbers, then whether it is an annex, and which."""
    numbers = [roman(m) for m in re.findall(r"(?:PARTE|T[íi]t(?:ulo)?|Cap)\s+([IVXL]+)\b", path)][:3]
    annex = re.search(r"(?i)Anexo\s*(\d+)", path)
    return numbers + [0] * (3 - len(numbers)), int(annex is not None), int(annex[1]) if annex else 0


def in_chapter_order(files: DataFrame, path: str = "ruta") -> DataFrame:
    """``orden``, by which a document's files sort: chapters by number, their annexes behind them."""
    def key(paths: pd.Series) -> pd.DataFrame:
        rows = [chapter_order(p) for p in paths]
        return pd.DataFrame({"capitulo": [r[0] for r in rows], "anexo": [r[1] for r in rows], "numero": [r[2] for r in rows], "ruta": paths})

    order = F.pandas_udf(key, "capitulo array<int>, anexo int, numero int, ruta string")
    return files.withColumn("orden", order(F.col(path)))


def card_fields(text: Column, labels: list[str], title: str | None = None) -> Column:
    """Map of the labels "X:" in a card's text to what stands behind each, up to the next; ``title`` ends the card and has the rest.

    Labels within another word group ("Sala Decisión:") do not count.
    """
    clean = F.regexp_replace(text, r"(?U)[\u00A0\s]+", " ")
    cut = F.instr(clean, title) if title else F.lit(0)
    head = F.when(cut > 1, F.substr(clean, F.lit(1), cut - 1)).otherwise(clean)
    names = sorted(labels, key=len, reverse=True)
    pattern = "(?<!Sala )(" + "|".join(re.escape(x) for x in names) + "):"
    marked = F.regexp_replace(head, pattern, "\x01$1\x02")
    parts = F.filter(F.split(marked, "\x01"), lambda p: F.contains(p, F.lit("\x02")))
    entries = F.transform(parts, lambda p: F.struct(F.split_part(p, F.lit("\x02"), F.lit(1)).alias("k"), F.trim(F.split_part(p, F.lit("\x02"), F.lit(2))).alias("v")))
    # Of a label that comes again the first counts.
    once = F.array_distinct(F.transform(entries, lambda e: e["k"]))
    found = F.map_from_entries(F.transform(once, lambda k: F.struct(k, F.get(F.filter(entries, lambda e: e["k"] == k), F.lit(0))["v"])))
    if not title:
        return found
    rest = F.when(cut > 1, F.trim(F.substr(clean, cut + len(title)))).otherwise(F.lit(""))
    return F.map_concat(found, F.create_map(F.lit(title), rest))
