"""Readers.  Schemas are explicit where the format carries none."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from urllib.parse import unquote

from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sectorscope.operators.sizing import local_table, lookup_join
from sectorscope.sources.paths import suffix

# Column names of the input tables.
EVENT_SCHEMA = "repo_nwo string, created_at timestamp"
FIRST_USE_NAMES = {"repo_nwo": "nwo", "first_claude_commit": "first_use_date"}
REPO_SCHEMA = "code string, name_repo string, description string, topics string, readme_content string"
LABEL_SCHEMA = "label int, code string"
_SLASHES = re.compile("(?<=^file):/+")


def _open(load: Callable[..., DataFrame], path: str) -> DataFrame:
    """Open a file; a missing path and an unreadable one are different errors."""
    try:
        return load(str(path))
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"Data file not found: {path}") from e
        raise ValueError(f"Failed to load file: {e}") from e
    except (PySparkException, Py4JError) as e:
        raise ValueError(f"Failed to load file: {e}") from e


def spread(rows: DataFrame, partitions: int | None) -> DataFrame:
    """The rows dealt to ``partitions`` tasks; as they are read without a number.

    A Parquet row group is read by one task: text jobs over files of few row groups, or over quoted
    CSV, should name one.  The rows move once, so leave it out where the files divide well.
    """
    return rows if partitions is None else rows.repartition(partitions)


def read_parquet(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Parquet table."""
    return spread(_open(spark.read.parquet, path), partitions)


def read_csv(spark: SparkSession, path: str, schema: str | None = None, multi_line: bool = True) -> DataFrame:
    """CSV with header; with ``schema``, its columns by name, wherever they stand in the file.

    Quoted line ends keep a file from being split; bulk input without any is split with
    ``multi_line=False``.  Outer blanks are kept.  Empty fields are null, quoted or not.  Without
    a schema all columns are text.
    """
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
    rows = _open(reader.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv, path)
    if schema is None:
        return rows
    wanted = T.StructType.fromDDL(schema)
    missing = [f.name for f in wanted if f.name not in rows.columns]
    if missing:
        raise ValueError(f"Columns not in {path}: {missing}")
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted])


def read_repos(
    spark: SparkSession, path: str, schema: str | None = None, partitions: int | None = None
) -> DataFrame:
    """Repository table by file type: parquet or CSV; ``partitions`` as in :func:`spread`."""
    kind = suffix(path)
    if kind == "parquet":
        return read_parquet(spark, path, partitions)
    if kind == "csv":
        return spread(read_csv(spark, path, schema), partitions)
    raise ValueError(f"Unsupported file format: .{kind}")


def read_events(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """JSON-lines events; only repository and time are parsed, times without offset are UTC.

    A broken line stops the job; without ``strict`` its broken fields are null, and
    :func:`broken_events` counts such lines.
    """
    return _open(event_reader(spark, strict), path)


def event_reader(spark: SparkSession, strict: bool = True) -> Callable[[str | Sequence[str]], DataFrame]:
    reader = spark.read.schema(EVENT_SCHEMA).option("timeZone", "UTC")
    return reader.option("mode", "FAILFAST" if strict else "PERMISSIVE").json


def observed_events(spark: SparkSession, path: str) -> tuple[DataFrame, Observation]:
    """Events as without ``strict``, and the numbers ``n_lines`` and ``n_broken`` of the same pass.

    The numbers are there when the first job over the events has ended.
    """
    reader = spark.read.schema(f"{EVENT_SCHEMA}, _broken string").option("timeZone", "UTC")
    lines = _open(reader.option("columnNameOfCorruptRecord", "_broken").json, path)
    seen = Observation()
    counted = lines.observe(seen, F.count(F.lit(1)).alias("n_lines"), F.count("_broken").alias("n_broken"))
    return counted.drop("_broken"), seen


def read_tools(
    tables: Mapping[str, Callable[[Sequence[str]], DataFrame]], paths: Mapping[str, str]
) -> tuple[DataFrame | None, list[str]]:
    """One scan over the files of all tools, with a ``tool`` column; and the tools without a file.

    ``tables`` has a reader for each tool; tools that share one are read together.  A row's tool follows
    from the path of its file.
    """
    missing, groups = [], {}
    for tool, path in paths.items():
        try:
            files = _open(lambda one, load=tables[tool]: load([one]), path).inputFiles()
        except FileNotFoundError:
            missing.append(tool)
            continue
        groups.setdefault(id(tables[tool]), (tables[tool], [], []))
        if str(path) not in groups[id(tables[tool])][1]:  # tools may share a file
            groups[id(tables[tool])][1].append(str(path))
        groups[id(tables[tool])][2].extend((_SLASHES.sub(":/", unquote(file)), tool) for file in files)
    parts = []
    for load, own_paths, files in groups.values():
        rows = load(own_paths)
        # Forms of a path differ in how they quote characters, and in the slashes of an empty host.
        plain = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
        named = rows.withColumn("_file", F.regexp_replace(plain, _SLASHES.pattern, ":/"))
        names = local_table(rows.sparkSession, sorted(set(files)), "_file string, tool string")
        parts.append(lookup_join(named, names, "_file", "inner").select("tool", *rows.columns))
    return (reduce(DataFrame.unionByName, parts) if parts else None), missing


def broken_events(spark: SparkSession, path: str) -> DataFrame:
    """Number of lines that cannot be read as events: one row, ``n_lines`` and ``n_broken``."""
    options = {"timeZone": "UTC", "columnNameOfCorruptRecord": "_broken"}
    lines = _open(spark.read.text, path).where(F.trim("value") != "")
    event = F.from_json("value", f"{EVENT_SCHEMA}, _broken string", options)
    return lines.select(event.alias("e")).agg(F.count("*").alias("n_lines"), F.count("e._broken").alias("n_broken"))


def read_first_use(spark: SparkSession, path: str) -> DataFrame:
    """Pre-computed first-use table with its columns renamed and the time as a UTC instant."""
    return resolve_first_use(read_parquet(spark, path))


def resolve_first_use(df: DataFrame) -> DataFrame:
    names = {old: new for old, new in FIRST_USE_NAMES.items() if old in df.columns}
    return df.withColumnsRenamed(names).withColumn("first_use_date", F.col("first_use_date").cast("timestamp"))


def resolve_repo_columns(df: DataFrame) -> DataFrame:
    """Common names for scoring input: ``name`` over ``name_repo``, ``readme`` over ``readme_content``."""
    for wanted, other in (("name", "name_repo"), ("readme", "readme_content")):
        if wanted not in df.columns and other in df.columns:
            df = df.withColumnRenamed(other, wanted)
    return df


def from_rows(spark: SparkSession, rows: Sequence[Mapping], schema: str) -> DataFrame:
    """A few repositories given as dicts; keys a row lacks become null."""
    names = [part.split()[0] for part in schema.split(",")]
    return spark.createDataFrame([tuple(row.get(n) for n in names) for row in rows], schema)


def read_label_json(spark: SparkSession, path: str) -> DataFrame:
    """Label map stored as one JSON object with ``id2label``; ids are text there."""
    maps = spark.read.schema("id2label map<string,string>").option("multiLine", True).json(str(path))
    pairs = maps.select(F.explode("id2label").alias("id", "code"))
    return pairs.select(F.col("id").cast("int").alias("label"), "code")


def read_report(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: read_parquet(spark, f"{path}/{name}") for name in ("metrics", "classes", "test_size")}
