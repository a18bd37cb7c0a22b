"""Contract documents on storage: read a directory of schema files, write an export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactline.functions.names import split_identity

ENVELOPE = "AWSEvent"


def parse_contracts(df: DataFrame, content_col: str = "content") -> tuple[DataFrame, DataFrame]:
    """Rows with a `name` and document text to contracts, and the rows that could not be read.

    The content may be a JSON object, or a JSON string that holds one.
    """
    quoted = F.col(content_col).rlike(r'^[^{\[]*"')
    text = F.when(quoted, F.try_variant_get(F.try_parse_json(content_col), "$", "string")).otherwise(F.col(content_col))
    # Filters on `doc` stay above an explode; below it, each mention of `doc` in them would parse the text once more.
    out = df.withColumn("doc", F.explode(F.array(F.try_parse_json(text))))
    source, event_type = split_identity(F.col("name"))
    ok = F.col("doc").isNotNull() & F.col("name").isNotNull()
    good = out.where(ok).drop(content_col).withColumns({"source": source, "event_type": event_type})
    return good, out.where(~ok | ok.isNull()).drop("doc")


def read_contracts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Contracts from files `{SchemaName, SchemaVersion, Content, LastModified}`; bad files apart."""
    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("file"), F.try_parse_json("value").alias("f")
    )

    def member(name: str, kind: str):
        return F.coalesce(
            F.try_variant_get("f", f"$.{name}", kind),
            F.try_variant_get("f", f"$.{name[0].lower()}{name[1:]}", kind),
        )

    rows = files.select(
        "file",
        member("SchemaName", "string").alias("name"),
        F.coalesce(member("SchemaVersion", "int"), F.lit(1)).alias("version"),
        member("LastModified", "string").alias("last_modified"),
        F.to_json(member("Content", "variant")).alias("content"),
    )
    return parse_contracts(rows)


def write_contracts(df: DataFrame, path: str, fmt: str = "json", relaxed: bool = False) -> None:
    """Export documents partitioned by source, optionally relaxed first."""
    if relaxed:
        from pactline.operators.contracts import relax_documents

        df = relax_documents(df)
    out = df.withColumn("content", F.to_json("doc")).drop("doc")
    out.write.mode("overwrite").partitionBy("source").format(fmt).save(path)
