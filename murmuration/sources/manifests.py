"""Manifests, outputs and results as tables, and what is written from them."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ITEM = (
    "id string, slice string, split string, lang string, audio string, duration double, reference string, "
    "speakers array<struct<start:double,end:double,speaker:string>>, condition string, meta map<string,string>"
)
WORD = "struct<text:string,start:double,end:double,prob:double>"


#: The slices of the corpus in their order.
SLICES = ("en_clean", "en_talks", "en_accents", "en_business", "en_meeting", "es_fleurs", "es_mls", "es_dialects", "en_noise", "es_noise", "en_phone", "es_phone", "nospeech")


def read_manifest(spark: SparkSession, folder: str | list[str], slices: tuple[str, ...] | None = None, listing: DataFrame | None = None) -> DataFrame:
    """Items of JSON-lines manifests with a fixed schema (SRC-1).

    `folder` is a list of paths, or a folder of `slice=<name>` parts of which those in `slices` are read, in that order of `slice_no`;
    a slice that isn't there is warned of, none at all is an error. With a listing of audio paths, a slice that misses any is left out.
    """
    if isinstance(folder, str):
        base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        found = {f.getPath().getName().partition("=")[2] for f in base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(base)}
        wanted = slices or SLICES
        gone = [s for s in wanted if s not in found]
        if gone:
            warnings.warn(f"no manifest of {', '.join(gone)}", stacklevel=2)
        if len(gone) == len(wanted):
            raise FileNotFoundError(f"no slice of {folder} has a manifest")
        paths = [f"{folder}/slice={s}" for s in wanted if s in found]
        items = spark.read.option("basePath", folder).schema(ITEM).json(paths).where("id is not null")
        items = items.withColumn("slice_no", F.array_position(F.array(*map(F.lit, wanted)), F.col("slice")))
    else:
        items = spark.read.schema(ITEM).json(folder).where("id is not null")
    if listing is None:
        return items
    short = items.join(listing.select("audio").distinct(), "audio", "left_anti").select("slice").distinct()
    return items.join(short, "slice", "left_anti").select(*items.columns)


def rooted(items: DataFrame, root: str) -> DataFrame:
    """Relative audio paths under the data root; others as they are (SRC-2)."""
    return items.withColumn("audio", F.when(F.col("audio").startswith("/"), F.col("audio")).otherwise(F.concat(F.lit(f"{root.rstrip('/')}/"), "audio")))


def write_manifest(items: DataFrame, path: str, root: str = "") -> None:
    """One folder per slice, sorted by id; audio under the root is stored relative to it (SRC-2)."""
    at = f"{root.rstrip('/')}/"
    audio = F.when(F.lit(bool(root)) & F.col("audio").startswith(at), F.substring("audio", len(at) + 1, 1 << 30)).otherwise(F.col("audio"))
    items.withColumn("audio", audio).repartition("slice").sortWithinPartitions("slice", "id").write.partitionBy("slice").json(path)


def read_corpus(spark: SparkSession, path: str, columns: list[str], rows: DataFrame | None = None) -> DataFrame:
    """Only the columns, and only the rows of the given numbers (SRC-3); with `rows` (rn, and place if it has one) sorted as they were asked for."""
    df = spark.read.parquet(path).select(*columns)
    if rows is None:
        return df
    if "place" not in rows.columns:
        return df.join(rows, "rn", "left_semi")
    return df.join(rows.select("rn", "place"), "rn").orderBy("place").drop("place")


def read_outputs(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """Outputs of every system and item, a JSON document each, in files of their own or line by line, as they were written (SRC-4); `fresh` tells which still count."""
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def fresh(outputs: DataFrame, items: DataFrame, slack: float = 0.01) -> DataFrame:
    """Outputs whose fingerprint and duration agree with the item; one without fingerprint only if the key is empty (SRC-4)."""
    i = items.select("id", F.col("duration").alias("_d"), F.col("fingerprint").alias("_f"))
    same = (F.abs(F.col("duration") - F.col("_d")) <= slack) & (F.coalesce("fingerprint", F.lit("")) == F.coalesce("_f", F.lit("")))
    return outputs.join(i, "id").where(same).drop("_d", "_f")


def read_results(spark: SparkSession, path: str, record: str) -> DataFrame:
    """Records of the per_item arrays of results documents (SRC-5)."""
    return spark.read.schema(f"per_item array<struct<{record}>>").option("multiLine", True).json(path).select(F.inline("per_item"))


def engine_words(docs: DataFrame) -> DataFrame:
    """(file_id, chunk, pos, word fields) of maps from chunk to words, whose keys are strings in JSON (SRC-12)."""
    chunks = docs.select("file_id", F.explode("chunks").alias("chunk", "words"))
    return chunks.select("file_id", F.col("chunk").cast("int").alias("chunk"), F.posexplode("words").alias("pos", "w")).select("file_id", "chunk", "pos", "w.*")


def normalize_segments(raw: DataFrame) -> DataFrame:
    """Segments with start or start_time, end or end_time, speaker or speaker_id; blank texts dropped, non-numbers null (SRC-10)."""
    number = lambda *names: F.coalesce(*[F.expr(f"try_cast({n} as double)") for n in names])
    return raw.where(F.trim(F.coalesce("text", F.lit(""))) != "").select(
        "file_id", "pos", number("start", "start_time").alias("start"), number("end", "end_time").alias("end"), F.coalesce("speaker", "speaker_id").alias("speaker"), F.trim("text").alias("text")
    )


def read_chapters(spark: SparkSession, glob: str) -> DataFrame:
    """Chapters of transcript files of lines `uid reference` (SRC-11): named by the file's two folders, references joined in order of uid."""
    lines = spark.read.text(glob).select(F.col("value").alias("line"), F.input_file_name().alias("file")).where("trim(line) != ''")
    return chapters(lines.withColumn("chapter", F.array_join(F.slice(F.split("file", "/"), -3, 2), "-")))


def chapters(lines: DataFrame) -> DataFrame:
    """Lines `uid reference` joined per chapter, in order of pos if there is one, else of uid; without a chapter column the first two parts of the uid name it (SRC-11)."""
    cut = lines.withColumn("p", F.split("line", " ", 2)).withColumns({"uid": F.col("p")[0], "ref": F.col("p")[1]})
    if "chapter" not in lines.columns:
        cut = cut.withColumn("chapter", F.regexp_extract("uid", r"^([^-]*-[^-]*)", 1))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos" if "pos" in lines.columns else "uid", "ref"))), lambda x: x["ref"])
    return cut.groupBy("chapter").agg(F.array_join(ordered, " ").alias("reference"))
