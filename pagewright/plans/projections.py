"""Document-shaped views of the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

# Layout of the fixed-pitch view: points, and parts of the type size.
SIZE, ADVANCE, LEFT, TOP, LEADING, DEPTH, RISE = 12.0, 7.2, 72.0, 720.0, 14.0, 0.22, 0.9


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page_ix, text, role): a conversation is a document, a turn a page."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"), (F.row_number().over(order) - 1).alias("page_ix"), "text", "role")


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line_ix, text, source, lang): a document is a page of lines."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("line_ix", "text"))


def glyphs(spark: SparkSession, sf_dir: str, per_page: int = 45) -> DataFrame:
    """(doc_id, page_ix, line_no, col, text, x0, y0, x1, y1, baseline, size): each document in fixed pitch.

    Every character of every line is laid out, ``per_page`` lines a page; ``line_no``
    counts through the document. Lines are dealt by page before they become
    characters, so operators on pages shuffle text and not characters.
    """
    paged = document_lines(spark, sf_dir).withColumn("page_ix", F.floor(F.col("line_ix") / per_page).cast("int")).select(
        "doc_id", "page_ix", "line_ix", "text").repartition("doc_id", "page_ix")
    shown = paged.select("doc_id", "page_ix", "line_ix", F.posexplode(F.split("text", "")).alias("col", "text")).where("text <> ''")
    baseline = F.lit(TOP) - LEADING * (F.col("line_ix") % per_page)
    return shown.select(
        "doc_id", "page_ix", F.col("line_ix").alias("line_no"), "col", "text",
        (LEFT + ADVANCE * F.col("col")).alias("x0"), (baseline - DEPTH * SIZE).alias("y0"),
        (LEFT + ADVANCE * (F.col("col") + 1)).alias("x1"), (baseline + RISE * SIZE).alias("y1"),
        baseline.alias("baseline"), F.lit(SIZE).alias("size"))


def runs(spark: SparkSession, sf_dir: str, per_page: int = 45) -> DataFrame:
    """(doc_id, page_ix, line_no, text, x0, y0, y1, advance): the lines of ``glyphs`` as fixed-pitch runs."""
    baseline = F.lit(TOP) - LEADING * (F.col("line_ix") % per_page)
    return document_lines(spark, sf_dir).select(
        "doc_id", F.floor(F.col("line_ix") / per_page).cast("int").alias("page_ix"), F.col("line_ix").alias("line_no"), "text", F.lit(LEFT).alias("x0"),
        (baseline - DEPTH * SIZE).alias("y0"), (baseline + RISE * SIZE).alias("y1"), F.lit(ADVANCE).alias("advance"))


def placed_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page_ix, op_ix, xref, w, h): images drawn on pages."""
    return table(spark, sf_dir, "lineitem").select(
        F.lit(0).cast("long").alias("doc_id"), F.col("l_orderkey").alias("page_ix"), F.col("l_linenumber").alias("op_ix"),
        F.col("l_partkey").alias("xref"), F.col("l_quantity").alias("w"), (F.col("l_extendedprice") / 1000).alias("h"))


def event_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page_ix, num, subtype, hidden, has_appearance, value): events as annotations."""
    return table(spark, sf_dir, "events").select(
        F.lit(0).cast("long").alias("doc_id"), F.col("user_id").alias("page_ix"), F.col("event_id").alias("num"),
        F.col("event_type").alias("subtype"), (F.col("value") < 20).alias("hidden"),
        (F.col("event_id") % 3 != 0).alias("has_appearance"), "value")


def web_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def line_key():
    """The name of a line item as an object."""
    return F.concat(F.lit("lineitem:"), F.col("l_orderkey").cast("string"), F.lit("/"), F.col("l_linenumber").cast("string"))


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): foreign keys as references between named objects."""
    t = lambda n: table(spark, sf_dir, n)
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = [
        *[t("lineitem").select(line_key().alias("src"), key(p, c).alias("dst")) for p, c in (("order:", "l_orderkey"), ("part:", "l_partkey"), ("supplier:", "l_suppkey"))],
        t("orders").select(key("order:", "o_orderkey").alias("src"), key("customer:", "o_custkey").alias("dst")),
        t("customer").select(key("customer:", "c_custkey").alias("src"), key("nation:", "c_nationkey").alias("dst")),
        t("supplier").select(key("supplier:", "s_suppkey").alias("src"), key("nation:", "s_nationkey").alias("dst")),
        t("nation").select(key("nation:", "n_nationkey").alias("src"), key("region:", "n_regionkey").alias("dst")),
    ]
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    return out
