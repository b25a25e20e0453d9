"""Readers with explicit schemas; nothing is inferred from the data."""

from __future__ import annotations

import fnmatch
import re
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import lexicon as L
from corpusloom.sources.json_arrays import read_json_array
from corpusloom.sources.writers import arrow_path
from corpusloom.session import input_bytes, materialize

TASK_FILES, TASK_BYTES = 20_000, 64 << 20  # text files of a task
READ_BYTES = 4 << 20  # texts that a task holds at once

QA_SCHEMA = "question string, ground_truth string, language string, category string, context string, answer string"
TRAINING_SCHEMA = "query string, pos array<string>, neg array<string>"
MIRAGE_SCHEMA = "map<string,array<struct<question:string,options:map<string,string>,answer:string>>>"
SESSION_SCHEMA = (
    "session_id string, messages array<struct<role:string,content:string,timestamp:string,"
    "metadata:map<string,string>>>, summary string, context map<string,string>"
)
REGISTRY_SCHEMA = (
    "id string, filename string, path string, size_bytes bigint, status string, chunk_count bigint, "
    "error_message string, created_at timestamp, updated_at timestamp"
)
PUBMED_SCHEMA = """
MedlineCitation struct<
  PMID: struct<_VALUE: string>,
  Article: struct<
    Journal: struct<Title: string, JournalIssue: struct<PubDate: struct<Year: string, Month: string, Day: string>>>,
    ArticleTitle: string,
    Abstract: struct<AbstractText: array<struct<_Label: string, _VALUE: string>>>,
    AuthorList: struct<Author: array<struct<LastName: string, ForeName: string>>>>,
  KeywordList: array<struct<Keyword: array<struct<_VALUE: string>>>>,
  MeshHeadingList: struct<MeshHeading: array<struct<DescriptorName: struct<_VALUE: string>>>>>,
PubmedData struct<ArticleIdList: struct<ArticleId: array<struct<_IdType: string, _VALUE: string>>>>
"""


def spread(df: DataFrame) -> DataFrame:
    """Give every task slot a share of a small input.

    A table of fewer full splits than slots would leave most of them idle in
    the text operators, which are bound by computation. Only such small tables
    (at most one split per slot) are redistributed; larger ones already come in
    enough splits and are left without a shuffle.
    """
    spark = df.sparkSession
    slots = spark.sparkContext.defaultParallelism
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return df.repartition(slots) if input_bytes(df) < split * slots else df


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """A table of parsed texts, spread over the slots when it is small."""
    return spread(spark.read.parquet(path))


def read_markdown_dir(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    """One row per file below ``path``: text, source (file name), path, file_size.

    Spark's own file index holds the status of every file on the driver, so
    folders are listed by the tasks here, level by level, and files are dealt
    by their path and read where they fall. Stores that Arrow does not open are
    left to Spark's reader.
    """
    listed = _listed_files(spark, path, glob)
    if listed is None:
        files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path, wholetext=True)
        return files.select(
            F.col("value").alias("text"),
            F.col("_metadata.file_name").alias("source"),
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_size").alias("file_size"),
        )
    size = listed.agg(F.count("*").alias("n"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes")).first()
    parts = max(spark.sparkContext.defaultParallelism, -(-size["n"] // TASK_FILES), -(-size["bytes"] // TASK_BYTES))

    def read(batches):
        for batch in batches:
            texts, held, at = [], 0, 0
            for i, (base, inner) in enumerate(zip(batch["base"].to_pylist(), batch["inner"].to_pylist()), 1):
                files = arrow_path(base)[0]
                packed = "detect" if inner.endswith((".gz", ".bz2", ".zst")) else None
                with files.open_input_stream(inner, compression=packed) as file:
                    texts.append(file.read())
                held += len(texts[-1])
                if held >= READ_BYTES or i == batch.num_rows:
                    rest = [batch[c].slice(at, i - at) for c in ("source", "path", "file_size")]
                    yield pa.record_batch([pa.array(texts, pa.binary()), *rest], ["text", "source", "path", "file_size"])
                    texts, held, at = [], 0, i

    rows = listed.repartition(parts, "path").mapInArrow(read, "text binary, source string, path string, file_size bigint")
    return rows.withColumn("text", F.col("text").cast("string"))


def _listed_files(spark: SparkSession, path: str, glob: str) -> DataFrame | None:
    """base, inner (Arrow's path), source, path, file_size of every file that fits ``glob``; None where Spark has to read."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    roots = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop)
    roots = [str(root.getPath()) for root in roots or []]
    try:
        level = [(root, arrow_path(root)[1]) for root in roots]
    except (pa.ArrowException, OSError):
        return None
    if not level:
        return None  # Spark's reader names the missing path
    wanted = re.compile("|".join(fnmatch.translate(g) for g in _braces(glob)))

    def ls(batches):
        from pyarrow.fs import FileSelector, FileType

        for batch in batches:
            for base, inner in zip(batch["base"].to_pylist(), batch["inner"].to_pylist()):
                files, _ = arrow_path(base)
                prefix = "file:" if base.startswith(("file:", "/")) else base[: len(base) - len(arrow_path(base)[1])]
                own = files.get_file_info(inner)
                found = [own] if own.type == FileType.File else files.get_file_info(FileSelector(inner))
                for at in range(0, len(found), 10_000):
                    some = [f for f in found[at : at + 10_000] if not _hidden(f.base_name)]
                    # as in Spark's readers, an empty file is no row
                    some = [f for f in some if f.type == FileType.Directory or (f.size and wanted.match(f.base_name))]
                    yield pa.RecordBatch.from_pydict({
                        "base": pa.array([base] * len(some), pa.string()), "inner": pa.array([f.path for f in some], pa.string()),
                        "source": pa.array([_uri_path(f.base_name) for f in some], pa.string()),
                        "path": pa.array([prefix + _uri_path(f.path) for f in some], pa.string()),
                        "file_size": pa.array([None if f.type == FileType.Directory else f.size for f in some], pa.int64()),
                    })

    folders, files = spark.createDataFrame(level, "base string, inner string"), None
    while True:
        spread_out = folders.repartition(spark.sparkContext.defaultParallelism, "inner")
        found = materialize(spread_out.mapInArrow(ls, "base string, inner string, source string, path string, file_size bigint"), "listed")
        here = found.filter("file_size IS NOT NULL")
        files = here if files is None else files.unionByName(here)
        folders = found.filter("file_size IS NULL").select("base", "inner")
        if folders.isEmpty():
            return files


def _hidden(name: str) -> bool:
    """Names that Spark's readers pass over."""
    if name.startswith(("_metadata", "_common_metadata")):
        return False
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _braces(glob: str) -> list[str]:
    """A pattern with {a,b} as patterns without."""
    found = re.search(r"\{([^{}]*)\}", glob)
    if not found:
        return [re.sub(r"\[\^", "[!", glob)]
    return [g for part in found[1].split(",") for g in _braces(glob[: found.start()] + part + glob[found.end() :])]


def _uri_path(path: str) -> str:
    """The path as Spark shows it: what a URI does not allow is escaped."""
    return "".join(c if ord(c) > 127 else quote(c, safe="/_-!.~'()*,;:$&+=@") for c in path)


def read_qa_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON arrays of question cases; absent text fields become ''. One file is read by as many tasks as it has splits."""
    rows = read_json_array(spark, path, QA_SCHEMA)
    filled = [F.coalesce(c, F.lit("")).alias(c) for c in ("question", "context", "answer")]
    return rows.select(*filled, "ground_truth", "language", "category")


def read_training_jsonl(spark: SparkSession, path: str, for_eval: bool = False) -> DataFrame:
    """JSON lines {query, pos, neg}; blank lines are skipped.

    ``for_eval`` keeps only rows with a query and at least one positive.
    """
    rows = spark.read.schema(TRAINING_SCHEMA).json(path).filter("query is not null or pos is not null")
    none = F.array().cast("array<string>")
    rows = rows.select(
        F.coalesce("query", F.lit("")).alias("query"), F.coalesce("pos", none).alias("pos"), F.coalesce("neg", none).alias("neg")
    )
    return rows.filter((F.length("query") > 0) & (F.size("pos") > 0)) if for_eval else rows


def read_mirage_json(spark: SparkSession, path: str, dataset: str = "all") -> DataFrame:
    """One JSON object {dataset: [question]}; 'all' unites the five known names."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", MIRAGE_SCHEMA).alias("sets"))
    rows = whole.select(F.explode("sets").alias("dataset", "items")).select("dataset", F.inline("items"))
    wanted = L.MIRAGE_DATASETS if dataset == "all" else [dataset]
    ordered = F.transform(F.map_entries("options"), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    return rows.filter(F.col("dataset").isin(wanted)).select("dataset", "question", ordered.alias("options"), "answer")


def read_sessions_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Sessions exploded to a row per message, with its timestamp and metadata and the session's summary and context.

    One JSON object per file, or one per line (as ``write_sessions_json``
    leaves them) with ``lines``. Absent metadata and contexts are empty maps.
    """
    rows = spark.read.schema(SESSION_SCHEMA).option("recursiveFileLookup", "true").json(path, multiLine=not lines)
    none = F.create_map().cast("map<string,string>")
    return rows.select("session_id", "summary", F.coalesce("context", none).alias("context"), F.posexplode("messages").alias("turn", "_m")).select(
        "session_id", F.col("turn").cast("bigint").alias("turn"), "_m.role", "_m.content", "_m.timestamp",
        F.coalesce("_m.metadata", none).alias("metadata"), "summary", "context",
    )


def read_pubmed_xml(spark: SparkSession, path: str) -> DataFrame:
    """Article records; rows without an identifier are dropped.

    Inline markup inside a title ends it, as only the leading text counts.
    """
    raw = spark.read.format("xml").option("rowTag", "PubmedArticle").schema(PUBMED_SCHEMA).load(path)
    art, cit = "MedlineCitation.Article", "MedlineCitation"

    def lead(c: F.Column) -> F.Column:
        return F.coalesce(F.substring_index(c, "<", 1), F.lit(""))

    def listed(path: str) -> F.Column:
        return F.filter(F.col(path), lambda x: x.isNotNull() & (x != ""))

    parts = F.transform(
        f"{art}.Abstract.AbstractText",
        lambda a: F.when(F.coalesce(a["_Label"], F.lit("")) != "", F.concat(a["_Label"], F.lit(": "), F.coalesce(a["_VALUE"], F.lit(""))))
        .otherwise(F.coalesce(a["_VALUE"], F.lit(""))),
    )
    authors = F.transform(
        F.filter(f"{art}.AuthorList.Author", lambda a: F.coalesce(a["LastName"], F.lit("")) != ""),
        lambda a: F.trim(F.concat(a["LastName"], F.lit(" "), F.coalesce(a["ForeName"], F.lit("")))),
    )
    when = F.col(f"{art}.Journal.JournalIssue.PubDate")
    date = F.concat_ws("-", when["Year"], when["Month"], F.when(when["Month"].isNotNull(), when["Day"]))
    ids = F.filter("PubmedData.ArticleIdList.ArticleId", lambda i: i["_IdType"] == "doi")
    none = F.array().cast("array<string>")
    keywords = F.flatten(F.transform(f"{cit}.KeywordList", lambda k: F.transform(k["Keyword"], lambda w: w["_VALUE"])))
    return raw.select(
        F.col(f"{cit}.PMID._VALUE").alias("pmid"),
        lead(F.col(f"{art}.ArticleTitle")).alias("title"),
        F.coalesce(F.array_join(parts, "\n"), F.lit("")).alias("abstract"),
        F.coalesce(authors, none).alias("authors"),
        F.coalesce(f"{art}.Journal.Title", F.lit("")).alias("journal"),
        F.when(when["Year"].isNotNull(), date).alias("pub_date"),
        F.get(ids, F.lit(0))["_VALUE"].alias("doi"),
        F.coalesce(F.filter(keywords, lambda k: k.isNotNull()), none).alias("keywords"),
        F.coalesce(
            F.filter(
                F.transform(f"{cit}.MeshHeadingList.MeshHeading", lambda m: m["DescriptorName"]["_VALUE"]),
                lambda k: k.isNotNull(),
            ),
            none,
        ).alias("mesh_terms"),
    ).filter("pmid is not null and pmid <> ''")


def recent_articles(
    articles: DataFrame, now: F.Column, days: int, max_results: int, sort: str = "date", date_col: str = "pub_date"
) -> DataFrame:
    """Articles dated within [now - days, now], by date or by a relevance column."""
    d = F.col(date_col).cast("date")
    kept = articles.filter((d >= F.date_sub(now.cast("date"), days)) & (d <= now.cast("date")))
    order = [F.desc(date_col)] if sort == "date" else [F.desc("relevance")]
    return kept.orderBy(*order, F.asc("pmid")).limit(max_results)
