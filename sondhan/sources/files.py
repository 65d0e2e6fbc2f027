"""Reading and writing article files."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sondhan.operators.numbering import number_rows

MENTION = T.StructType([T.StructField("text", T.StringType()), T.StructField("label", T.StringType()), T.StructField("start_char", T.IntegerType()), T.StructField("end_char", T.IntegerType())])
ARTICLE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("url", "title", "body", "date", "language", "source", "category")]
    + [T.StructField("tokens", T.IntegerType()), T.StructField("named_entities", T.ArrayType(MENTION)), T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("crawled_at", T.StringType())]
)


def read_jsonl(spark: SparkSession, path: str, strict: bool = False, schema: T.StructType = ARTICLE) -> DataFrame:
    """Articles of JSON lines; bad lines are skipped, or fail with ``strict``."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def count_rejects(spark: SparkSession, path: str, schema: T.StructType = ARTICLE) -> DataFrame:
    lines = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    full = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    parsed = lines.select(F.from_json("value", full, {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    return parsed.agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("r._corrupt").isNotNull()).alias("rejected"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)


def read_map(spark: SparkSession, path: str, value: str = "struct<en:string,bn:string,type:string>") -> DataFrame:
    """(key, value) rows of one JSON object."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string,{value}>")))


def systematic_sample(df: DataFrame, order: str, limit: int) -> DataFrame:
    """Every (total // limit)-th row in order, ``limit`` at most: the sampling operator."""
    total = df.count()
    stride = max(1, total // max(1, limit))
    return number_rows(df, [order], "__rn").filter(F.col("__rn") % stride == 0).orderBy(order).limit(limit).drop("__rn")


def append_once(df: DataFrame, path: str, url: str = "url") -> int:
    """Append valid articles whose address is not yet in the table; returns how many were new."""
    spark = df.sparkSession
    valid = df.filter(F.length(F.coalesce("body", F.lit(""))) > 100).filter(f"coalesce(`{url}`, '') <> '' and coalesce(title, '') <> ''").dropDuplicates([url])
    try:
        seen = spark.read.parquet(path).select(url)
        fresh = valid.join(seen, url, "left_anti")
    except Exception as e:  # no table yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        fresh = valid
    fresh = fresh.persist()
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(path)
    fresh.unpersist()
    return n


def write_by_language(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("language").json(f"{path}/by_language")
    df.write.mode("overwrite").json(f"{path}/all")


def write_parquet(df: DataFrame, path: str, codec: str = "snappy") -> None:
    """Tokens as integers (0 for null), dates as timestamps where they read as one, lists as JSON text."""
    lists = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
    out = df.withColumn("tokens", F.coalesce(F.col("tokens").cast("int"), F.lit(0))).withColumn("date", F.try_to_timestamp("date"))
    for name in lists:
        out = out.withColumn(name, F.to_json(name))
    out.write.mode("overwrite").option("compression", codec).parquet(path)


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row with the {nodes, edges} document for drawing; for bounded subgraphs."""
    n = nodes.agg(F.collect_list(F.struct(*nodes.columns)).alias("nodes"))
    e = edges.agg(F.collect_list(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), "weight")).alias("edges"))
    return n.crossJoin(F.broadcast(e)).select(F.to_json(F.struct("nodes", "edges")).alias("json"))


def _cell(v) -> str:
    return "-" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)


def markdown_table(df: DataFrame) -> str:
    """A report table of all rows of a small result."""
    head = "| " + " | ".join(df.columns) + " |\n|" + " --- |" * len(df.columns)
    return "\n".join([head, *("| " + " | ".join(map(_cell, r)) + " |" for r in df.toLocalIterator())])


def latex_table(df: DataFrame) -> str:
    """The same as a LaTeX tabular."""
    safe = lambda v: re.sub(r"([&%$#_{}])", r"\\\1", _cell(v))
    rows = [" & ".join(map(safe, r)) + r" \\" for r in df.toLocalIterator()]
    return "\n".join([rf"\begin{{tabular}}{{{'l' * len(df.columns)}}}", r"\hline", " & ".join(map(safe, df.columns)) + r" \\", r"\hline", *rows, r"\hline", r"\end{tabular}"])


def write_results(hits: DataFrame, path: str) -> None:
    """Hits as JSON lines and as CSV with a header: scores with three figures, '-' for missing texts and 0 for missing numbers."""
    hits.write.mode("overwrite").json(f"{path}/json")
    shown = []
    for f in hits.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType | T.FloatType):
            shown.append(F.format_string("%.3f", F.coalesce(c, F.lit(0.0))).alias(f.name))
        elif isinstance(f.dataType, T.NumericType):
            shown.append(F.coalesce(c, F.lit(0)).alias(f.name))
        else:
            shown.append(F.coalesce(c.cast("string"), F.lit("-")).alias(f.name))
    hits.select(*shown).write.mode("overwrite").option("header", True).csv(f"{path}/csv")


def convert_directory(spark: SparkSession, folder: str, out: str) -> dict[str, str]:
    """Every ``*.jsonl`` of a folder as Parquet; a file that fails does not stop the others.  Returns name to 'ok' or the error."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    done = {}
    for status in hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(hadoop):
        name = status.getPath().getName()
        if name.endswith(".jsonl"):
            try:
                write_parquet(read_jsonl(spark, f"{folder}/{name}", strict=True), f"{out}/{name.removesuffix('.jsonl')}")
                done[name] = "ok"
            except Exception as e:
                done[name] = type(e).__name__
    return done


def write_gexf(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A graph as one GEXF document in the lines of a text table; ``nodes``: (node, label), ``edges``: (src, dst, weight)."""
    safe = lambda c: F.replace(F.replace(F.replace(F.col(c).cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    line = lambda text: nodes.sparkSession.createDataFrame([(text,)], "value string")
    n = nodes.select(F.concat(F.lit('<node id="'), safe("node"), F.lit('" label="'), F.coalesce(safe("label"), F.lit("")), F.lit('"/>')).alias("value"))
    e = edges.select(F.concat(F.lit('<edge source="'), safe("src"), F.lit('" target="'), safe("dst"), F.lit('" weight="'), F.col("weight").cast("string"), F.lit('"/>')).alias("value"))
    parts = [line('<?xml version="1.0" encoding="UTF-8"?><gexf xmlns="http://gexf.net/1.3" version="1.3"><graph defaultedgetype="undirected"><nodes>'), n, line("</nodes><edges>"), e, line("</edges></graph></gexf>")]
    every = reduce(DataFrame.unionByName, [p.withColumn("__p", F.lit(i)) for i, p in enumerate(parts)])
    every.repartitionByRange("__p").sortWithinPartitions("__p").select("value").write.mode("overwrite").text(path)


def read_gexf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a GEXF document or of the parts ``write_gexf`` leaves."""
    rows = lambda tag, kind: spark.read.format("xml").option("rowTag", tag).schema(kind).load(path)
    nodes = rows("node", "_id string, _label string").select(F.col("_id").alias("node"), F.col("_label").alias("label"))
    return nodes, rows("edge", "_source string, _target string, _weight double").select(F.col("_source").alias("src"), F.col("_target").alias("dst"), F.col("_weight").alias("weight"))
