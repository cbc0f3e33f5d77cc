"""Loading, de-duplication, constraint audits, layout and output."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricetide import schemas

# --------------------------------------------------------------------------- reading

_TRUE = ("t", "true", "1", "y", "yes")
_FALSE = ("f", "false", "0", "n", "no")


def _as_string_schema(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, T.StringType(), True) for f in schema.fields])


def _typed(col: str, dtype: T.DataType) -> Column:
    c = F.trim(F.col(col))
    c = F.when(c == "", F.lit(None)).otherwise(c)
    if isinstance(dtype, T.BooleanType):
        low = F.lower(c)
        return (F.when(low.isin(*_TRUE), F.lit(True))
                .when(low.isin(*_FALSE), F.lit(False))
                .otherwise(F.lit(None).cast("boolean")))
    return c.cast(dtype)


def read_table(spark: SparkSession, name_or_schema, path: str, *, header: bool = True) -> DataFrame:
    """CSV with a header and declared columns; never infers.

    Every field is read as text and converted explicitly: booleans accept
    ``t``/``f`` (and true/false/1/0), empty fields are NULL.
    """
    schema = schemas.SCHEMAS[name_or_schema] if isinstance(name_or_schema, str) else name_or_schema
    raw = (spark.read.schema(_as_string_schema(schema)).option("header", header)
           .option("mode", "FAILFAST").csv(path))
    return raw.select(*[_typed(f.name, f.dataType).alias(f.name) for f in schema.fields])


def read_chunks(spark: SparkSession, name_or_schema, pattern: str) -> DataFrame:
    """All chunk files matching a glob (e.g. ``.../sales_chunks/chunk_*``) as one parallel read."""
    return read_table(spark, name_or_schema, pattern)


def read_jdbc(spark: SparkSession, url: str, table: str, *, partition_column: str | None = None,
              lower: int | None = None, upper: int | None = None, num_partitions: int = 64,
              properties: Mapping[str, str] | None = None) -> DataFrame:
    """Snapshot of an operational table over JDBC, range-split on a numeric key."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for k, v in (properties or {}).items():
        reader = reader.option(k, v)
    if partition_column is not None:
        reader = (reader.option("partitionColumn", partition_column)
                  .option("lowerBound", lower).option("upperBound", upper)
                  .option("numPartitions", num_partitions))
    return reader.load()


def append(base: DataFrame, chunk: DataFrame) -> DataFrame:
    return base.unionByName(chunk)


# --------------------------------------------------------------------------- de-duplication

def latest_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the one with the greatest ``order`` (DISTINCT ON ... ORDER BY .. DESC).

    Written as ``max(struct(order..., rest...))`` per key: a hash aggregate with
    a map-side partial step, so a key holding a third of the rows is reduced in
    every map task before the shuffle. Ties on ``order`` are broken by the
    remaining columns, so the pick is a function of the data.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    packed = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)],
                      *[F.col(c) for c in rest])
    agg = df.groupBy(*keys).agg(F.max(packed).alias("_best"))
    out = agg.select(*keys, *[F.col(f"_best._o{i}").alias(c) for i, c in enumerate(order)],
                     *[F.col(f"_best.{c}").alias(c) for c in rest])
    return out.select(*df.columns)


def distinct_keys(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols).distinct()


# --------------------------------------------------------------------------- fix-ups

# The one-row name/price overlay per vertical (product 1).
OVERRIDES = {
    "retail": {"product_id": 1, "product_name": "Fresh Red Delicious Apple", "base_price": "0.75"},
    "securities": {"product_id": 1, "product_name": "Apple", "base_price": "175.25"},
}


def overrides_frame(spark: SparkSession, vertical: str) -> DataFrame:
    o = OVERRIDES[vertical]
    return spark.createDataFrame(
        [(o["product_id"], o["product_name"], o["base_price"])],
        "product_id bigint, product_name string, base_price string",
    ).select("product_id", "product_name", F.col("base_price").cast("decimal(10,2)").alias("base_price"))


def apply_overrides(df: DataFrame, overrides: DataFrame, keys: Sequence[str] = ("product_id",)) -> DataFrame:
    """UPDATE .. SET cols WHERE key = ..: left join the overlay and coalesce its columns."""
    keys = list(keys)
    cols = [c for c in overrides.columns if c not in keys]
    ov = overrides.select(*keys, *[F.col(c).alias(f"_ov_{c}") for c in cols])
    joined = df.join(ov, keys, "left")
    return joined.select(*[F.coalesce(F.col(f"_ov_{c}"), F.col(c)).alias(c) if c in cols else F.col(c)
                           for c in df.columns])


VERTICAL = "vertical"


def with_vertical(df: DataFrame, vertical: str) -> DataFrame:
    return df.withColumn(VERTICAL, F.lit(vertical))


def write_verticals(tables: Mapping[str, DataFrame], root: str, *, vertical: str | None = None,
                    mode: str = "append") -> None:
    """Every table under ``root``, one folder per vertical; ``vertical`` tags tables that don't carry the column.

    Rows of a vertical are spread over the tasks that hold them, so one that
    holds most rows is still written by all tasks.
    """
    for name, df in tables.items():
        tagged = df if vertical is None else with_vertical(df, vertical)
        tagged.write.mode(mode).partitionBy(VERTICAL).parquet(f"{root}/{name}")


def read_verticals(spark: SparkSession, root: str, names: Sequence[str],
                   verticals: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """The tables written by :func:`write_verticals`, of all or some verticals (others' folders aren't read)."""
    out = {}
    for name in names:
        df = spark.read.option("basePath", f"{root}/{name}").parquet(f"{root}/{name}")
        df = df.withColumn(VERTICAL, F.col(VERTICAL).cast("string"))
        out[name] = df if verticals is None else df.where(F.col(VERTICAL).isin(list(verticals)))
    return out


def with_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """COALESCE each listed column with its default (a literal or a Column)."""
    out = []
    for c in df.columns:
        if c in defaults:
            d = defaults[c]
            d = d if isinstance(d, Column) else F.lit(d)
            out.append(F.coalesce(F.col(c), d.cast(df.schema[c].dataType)).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def register_views(tables: Mapping[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


# --------------------------------------------------------------------------- data dictionary

def annotate(df: DataFrame, comments: Mapping[str, str]) -> DataFrame:
    """Attach column comments as field metadata (kept by Parquet and the catalog)."""
    for col, text in comments.items():
        md = dict(df.schema[col].metadata)
        md["comment"] = text
        df = df.withMetadata(col, md)
    return df


def data_dictionary(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table, column, type, nullable, comment) of every column; schema metadata only."""
    rows = [(t, f.name, f.dataType.simpleString(), f.nullable, f.metadata.get("comment"))
            for t, df in tables.items() for f in df.schema.fields]
    return spark.createDataFrame(
        rows, "table string, column string, type string, nullable boolean, comment string")


# --------------------------------------------------------------------------- audits

def audit_pk(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that occur more than once, with their count."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") > 1))


def audit_not_null(df: DataFrame, cols: Iterable[str], table: str = "") -> DataFrame:
    """(table, column, null_count) for each listed column, in one pass."""
    cols = list(cols)
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    stack = ", ".join(f"'{c}', `{c}`" for c in cols)
    return counts.select(F.lit(table).alias("table_name"),
                         F.expr(f"stack({len(cols)}, {stack}) AS (column_name, null_count)"))


def audit_fk(child: DataFrame, fk: str, parent: DataFrame, pk: str, table: str = "") -> DataFrame:
    """Child key values without a parent row (NULL keys are not violations), with their count."""
    orphans = (child.filter(F.col(fk).isNotNull())
               .groupBy(F.col(fk).alias("value")).agg(F.count(F.lit(1)).alias("n"))
               .join(parent.select(F.col(pk).alias("value")), "value", "left_anti"))
    return orphans.select(F.lit(table).alias("table_name"), F.lit(fk).alias("column_name"), "value", "n")


def audit_constraints(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """All declared constraints of the source model over the given tables."""
    out: dict[str, DataFrame] = {}
    for name, keys in schemas.PRIMARY_KEYS.items():
        if name in tables and all(k in tables[name].columns for k in keys):
            out[f"pk:{name}"] = audit_pk(tables[name], keys)
    for name, schema in schemas.SCHEMAS.items():
        if name in tables:
            cols = [c for c in schemas.not_null_columns(schema) if c in tables[name].columns]
            if cols:
                out[f"not_null:{name}"] = audit_not_null(tables[name], cols, name)
    for child, fk, parent, pk in schemas.FOREIGN_KEYS:
        if child in tables and parent in tables:
            out[f"fk:{child}.{fk}"] = audit_fk(tables[child], fk, tables[parent], pk, child)
    return out


# --------------------------------------------------------------------------- layout and output

def write_serving(df: DataFrame, key: str, path: str, *, partitions: int | None = None,
                  mode: str = "overwrite") -> None:
    """Key-clustered copy: range partitioned and sorted on ``key``.

    Parquet row groups then carry tight min/max statistics on the key, so a
    point lookup ``key = ?`` reads one row group per file that can hold it —
    the role the reference's secondary indexes play.
    """
    n = partitions or df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    (df.repartitionByRange(int(n), key).sortWithinPartitions(key)
     .write.mode(mode).parquet(path))


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int, *, mode: str = "overwrite") -> None:
    """Bucketed, sorted catalog table: later joins on ``key`` need no shuffle."""
    (df.write.mode(mode).bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(table))


def analyze(spark: SparkSession, table: str, columns: Sequence[str] = ()) -> None:
    """Table and column statistics for the cost-based optimizer."""
    spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS")
    if columns:
        spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS FOR COLUMNS {', '.join(columns)}")


def column_statistics(spark: SparkSession, table: str, columns: Sequence[str]) -> DataFrame:
    """(column_name, minimum, maximum, nulls) as the catalog knows them after :func:`analyze`; catalog metadata only."""
    rows = []
    for c in columns:
        info = {r["info_name"]: r["info_value"] for r in spark.sql(f"DESCRIBE EXTENDED {table} {c}").collect()}
        rows.append((c, info["min"], info["max"], int(info["num_nulls"])))
    return spark.createDataFrame(rows, "column_name string, minimum string, maximum string, nulls bigint")


# JSON documents: NULL fields are kept, timestamps carry microseconds.
JSON_DOC_OPTIONS = {"ignoreNullFields": "false",
                    "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS",
                    "timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSSXXX"}


def json_doc(*cols) -> Column:
    return F.to_json(F.struct(*cols), JSON_DOC_OPTIONS)


def to_document(df: DataFrame, key: str | None = None) -> DataFrame:
    """One JSON document per row (JSON lines when written with ``write.text``)."""
    cols = [key] if key else []
    return df.select(*cols, json_doc(*df.columns).alias("doc"))


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)



def ingest_chunks(spark: SparkSession, name_or_schema, pattern_dir: str, out: str, checkpoint: str, *,
                  max_files_per_trigger: int = 1, available_now: bool = True):
    """Chunked CSV directory as a stream: each new chunk file is typed and appended to ``out`` (Parquet).

    The file sink and the checkpoint make the append exactly-once: a restarted
    ingest continues with the chunks it has not committed yet.
    """
    schema = schemas.SCHEMAS[name_or_schema] if isinstance(name_or_schema, str) else name_or_schema
    raw = (spark.readStream.schema(_as_string_schema(schema)).option("header", True)
           .option("maxFilesPerTrigger", int(max_files_per_trigger)).csv(pattern_dir))
    typed = raw.select(*[_typed(f.name, f.dataType).alias(f.name) for f in schema.fields])
    w = typed.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


# Column comments of the published views (our own wording).
VIEW_COMMENTS = {
    "inventory_item": {
        "product_id": "Product key; one row per product with at least one sale.",
        "live_price": "Current price: base price times popularity, promotion, stock, demand and name factors.",
        "last_update_time": "When the product row last changed; the freshness reference of the price.",
    },
    "dynamic_cart": {
        "product_id": "Product in the cart.",
        "product_name": "Name as stored on the cart line.",
        "category_id": "Category of the product.",
        "category_name": "Name of that category.",
        "price": "Live price of the product.",
        "available_stock": "Stock over all warehouses, counted once per cart line of the product.",
    },
    "category_totals": {
        "category_id": "Category, or offset + id for the 'Other' bucket of a parent's direct items.",
        "parent_id": "Parent category; NULL for roots.",
        "has_subcategory": "Whether the category has children.",
        "category_name": "Category name, or 'Other'.",
        "total": "Sum of live prices of cart products in the category and all its descendants.",
        "item_count": "Number of cart products in the category and all its descendants.",
    },
}


def describe_view(df: DataFrame, view: str) -> DataFrame:
    """Attach the view's column comments (field metadata travels into Parquet and the catalog)."""
    return annotate(df, {c: t for c, t in VIEW_COMMENTS[view].items() if c in df.columns})
