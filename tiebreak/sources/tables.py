"""Table sources and sinks."""

from pyspark.sql import DataFrame, Observation, SparkSession

from ..operators.matches import deliveries_to_matches, matches_from_table

CANDIDATE_FILES = ["deliveries.parquet", "deliveries.csv", "matches.parquet", "matches.csv"]


def normalize_columns(df: DataFrame) -> DataFrame:
    """Header names stripped, lower case, blanks as underscores."""
    names = [c.strip().lower().replace(" ", "_") for c in df.columns]
    double = sorted({n for n in names if names.count(n) > 1})
    if double:
        raise ValueError(f"column names collide after normalisation: {double}")
    return df.toDF(*names)


def detect_format(df: DataFrame) -> str:
    """"matches" or "deliveries" by the columns; starts no job."""
    columns = set(df.columns)
    if {"winner", "team1"} <= columns:
        return "matches"
    if {"match_id", "batting_team"} <= columns:
        return "deliveries"
    raise ValueError(f"unrecognised format, columns: {df.columns}")


def path_exists(spark: SparkSession, path) -> bool:
    """Whether a file, folder or glob exists, on whatever file system it names."""
    jvm = spark._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop_path)
    return found is not None and len(found) > 0


def first_existing(spark, paths):
    for path in paths:
        if path_exists(spark, path):
            return path
    raise FileNotFoundError(f"no dataset found, tried: {list(paths)}")


def read_table(spark, path, schema=None, fmt=None) -> DataFrame:
    """CSV (with header), JSON, ORC or parquet by suffix; columns normalised.

    Give a schema for CSV: without one Spark reads the whole file twice.
    """
    fmt = fmt or next((f for f in ("csv", "json", "orc") if path.rstrip("/").endswith(f".{f}")), "parquet")
    reader = spark.read
    if fmt == "csv":
        reader = reader.option("header", True)
        if schema is None:
            reader = reader.option("inferSchema", True)
    if schema is not None:
        reader = reader.schema(schema)
    return normalize_columns(reader.format(fmt).load(path))


def load_matches(spark, paths=CANDIDATE_FILES, order_by=None, schema=None, fmt=None, keys=(),
                 order_col="match_id", **convert) -> DataFrame:
    """Matches from the first path that exists, whichever format it holds."""
    df = read_table(spark, first_existing(spark, paths), schema, fmt)
    if detect_format(df) == "matches":
        return matches_from_table(df, order_col, keys)
    if order_by is None:
        raise ValueError("deliveries need order_by, the columns that give the order of rows in a match")
    return deliveries_to_matches(df, order_by, keys=keys, **convert)


def write_table(df: DataFrame, path, fmt="parquet", partition_by=("season",), mode="overwrite"):
    """A product table. Partitioning by season lets later season filters skip files.

    ``mode="replace"`` puts the rows in the place of their own partitions only, such as a new season; the
    files of the others stay, and a second run leaves what the first did.
    """
    if mode == "replace":
        if not partition_by:
            raise ValueError("only the parts of a partitioned table can be replaced")
        writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").format(fmt)
    else:
        writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def write_observed(df: DataFrame, path, metrics, **options):
    """``write_table``, and the values of ``metrics`` (name -> aggregate column) over the rows, from the job that writes them."""
    seen = Observation()
    write_table(df.observe(seen, *(c.alias(name) for name, c in metrics.items())), path, **options)
    return seen.get
