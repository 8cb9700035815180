"""Annotations, form fields, bookmarks, links, metadata and placed images as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pagewright.functions.strings import stem
from pagewright.operators.graph import running_totals

# ---- annotations -----------------------------------------------------------------------------


def selected(subtypes: list[str] | None = None, widgets: bool = False, nums: list[int] | None = None) -> Column:
    """Predicate on (subtype, num): never popups; form widgets only if asked for; then by kind and number."""
    kind = F.lower("subtype")
    keep = kind != "popup"
    if not widgets:
        keep = keep & (kind != "widget")
    if subtypes:
        keep = keep & kind.isin([s.lower() for s in subtypes])
    if nums:
        keep = keep & F.col("num").isin(nums)
    return keep


def remove_annotations(annotations: DataFrame, condition: Column) -> DataFrame:
    """Without the rows of ``condition`` and without the popups that belong to them (popup: a num, or null)."""
    gone = annotations.where(condition)
    keys = gone.select("doc_id", "num")
    if "popup" in annotations.columns:
        keys = keys.unionByName(gone.where("popup is not null").select("doc_id", F.col("popup").alias("num")))
    return annotations.join(keys.distinct(), ["doc_id", "num"], "left_anti")


def flatten(annotations: DataFrame, condition: Column) -> DataFrame:
    """Adds ``fate``: hidden ones are dropped, those without an appearance kept, the others painted."""
    fate = (
        F.when(~condition, "kept").when(F.col("hidden"), "dropped").when(~F.col("has_appearance"), "kept").otherwise("painted"))
    return annotations.withColumn("fate", fate)


def first_pages(annotations: DataFrame) -> DataFrame:
    """(doc_id, num, page_ix): the first page that lists an annotation."""
    return annotations.groupBy("doc_id", "num").agg(F.min("page_ix").alias("page_ix"))


# ---- form fields -----------------------------------------------------------------------------


def qualified_names(nodes: DataFrame, most: int = 64) -> DataFrame:
    """(num, name): dotted names of a field tree (num, parent, title); untitled nodes add nothing."""
    now = nodes.select("num", F.col("parent").alias("_up"), F.coalesce("title", F.lit("")).alias("name"))
    titles = nodes.select(F.col("num").alias("_up"), F.col("parent").alias("_next"), F.coalesce("title", F.lit("")).alias("_t"))
    for _ in range(most):
        if now.where("_up is not null").isEmpty():
            break
        now = now.join(titles, "_up", "left").select(
            "num", F.col("_next").alias("_up"),
            F.when(F.coalesce("_t", F.lit("")) == "", F.col("name")).when(F.col("name") == "", F.col("_t")).otherwise(F.concat_ws(".", "_t", "name")).alias("name"))
    return now.select("num", "name")


def set_fields(fields: DataFrame, values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fields with new values, values that met no field).

    A value (doc_id, name, value) goes to the field of that full name, else to
    the first field (by ``num``) whose last dotted part it is.
    """
    exact = values.join(fields.select("doc_id", "name", "num"), ["doc_id", "name"], "left")
    last = fields.select("doc_id", "num", F.element_at(F.split("name", r"\."), -1).alias("_last"))
    first = last.groupBy("doc_id", "_last").agg(F.min("num").alias("_num"))
    met = exact.join(first, (exact["doc_id"] == first["doc_id"]) & (exact["name"] == first["_last"]), "left").select(
        exact["doc_id"], exact["name"], exact["value"], F.coalesce("num", "_num").alias("num"))
    chosen = met.where("num is not null").groupBy("doc_id", "num").agg(F.max_by("value", "name").alias("_value"))
    patched = fields.join(chosen, ["doc_id", "num"], "left").withColumn("value", F.coalesce("_value", "value")).drop("_value")
    return patched, met.where("num is null").drop("num")


def unclashed(fields: DataFrame) -> DataFrame:
    """Root names of merged forms made unique: the second ``t`` becomes ``t-2``, the next ``t-3``.

    By rank of arrival; where such a name is already taken, a further suffix
    follows, so names stay unique.
    """
    rank = F.row_number().over(Window.partitionBy("doc_id", "name").orderBy("num"))
    ranked = fields.withColumn("_r", rank)
    made = ranked.withColumn("_name", F.when(F.col("_r") == 1, F.col("name")).otherwise(F.concat_ws("-", "name", F.col("_r").cast("string"))))
    again = F.row_number().over(Window.partitionBy("doc_id", "_name").orderBy(F.col("_r"), "num"))
    return made.withColumn("_a", again).withColumn(
        "name", F.when(F.col("_a") == 1, F.col("_name")).otherwise(F.concat_ws("-", "_name", F.col("_a").cast("string")))).drop("_r", "_name", "_a")


# ---- bookmarks, links and metadata -----------------------------------------------------------


def carried_bookmarks(bookmarks: DataFrame, kept: DataFrame) -> DataFrame:
    """Bookmarks (doc_id, path, title, page_ix) of kept pages (doc_id, page_ix, new_ix); others move their children up.

    A page kept more than once is where it first is. The path of a child keeps
    only the parts of ancestors that stay.
    """
    first = kept.groupBy("doc_id", "page_ix").agg(F.min("new_ix").alias("new_ix"))
    stay = bookmarks.join(first, ["doc_id", "page_ix"])
    ancestors = stay.select("doc_id", F.col("path").alias("_a"))
    above = stay.select("doc_id", "path", F.explode(F.expr("transform(sequence(1, size(path)), i -> slice(path, 1, i))")).alias("_a"))
    depth = above.join(ancestors.distinct(), ["doc_id", "_a"]).groupBy("doc_id", "path").agg((F.count(F.lit(1)) - 1).cast("int").alias("depth"))
    return stay.join(depth, ["doc_id", "path"]).select("doc_id", "path", "depth", "title", F.col("new_ix").alias("page_ix"))


def visible_counts(bookmarks: DataFrame) -> DataFrame:
    """(doc_id, path, count): visible descendants of each bookmark, negative if it is closed.

    ``bookmarks`` has path and open; descendants below a closed one do not count.
    """
    pairs = bookmarks.select("doc_id", F.col("path").alias("child"), F.explode(F.expr("transform(sequence(1, greatest(size(path) - 1, 1)), i -> slice(path, 1, i))")).alias("path"))
    pairs = pairs.where(F.size("path") < F.size("child"))
    closed = bookmarks.where("not open").select("doc_id", F.col("path").alias("shut"))
    between = pairs.join(closed, "doc_id").where(
        (F.size("shut") > F.size("path")) & (F.size("shut") < F.size("child")) & (F.slice("child", F.lit(1), F.size("shut")) == F.col("shut"))
    ).select("doc_id", "path", "child").distinct()
    counted = pairs.join(between, ["doc_id", "path", "child"], "left_anti").groupBy("doc_id", "path").agg(F.count(F.lit(1)).alias("n"))
    return bookmarks.join(counted, ["doc_id", "path"], "left").select(
        "doc_id", "path", F.when(F.col("open"), F.coalesce("n", F.lit(0))).otherwise(-F.coalesce("n", F.lit(0))).alias("count"))


TITLE = r"(?is)<title[^>]*>(.*?)</title>"
HEADING = r"(?is)<h1[^>]*>(.*?)</h1>"
LINK = r"(?i)<a\s[^>]*href=\"([^\"]*)\""


def web_outline(pages: DataFrame) -> DataFrame:
    """(page_id, title, heading, n_links): outline and links of web pages."""
    return pages.select(
        "page_id", F.regexp_extract("html", TITLE, 1).alias("title"), F.regexp_extract("html", HEADING, 1).alias("heading"),
        F.regexp_count("html", F.lit(LINK)).cast("long").alias("n_links"))


def web_links(pages: DataFrame) -> DataFrame:
    """(page_id, link_ix, uri): one row a link."""
    return pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("link_ix", "uri"))


METADATA = ("title", "author", "subject", "keywords", "creator", "producer")


def patch_metadata(docs: DataFrame, patch: dict) -> DataFrame:
    """Set information fields: an absent or null value leaves a field, an empty one clears it."""
    out = {}
    for name, value in patch.items():
        if name not in METADATA:
            raise ValueError(f"unknown metadata field {name!r}")
        value = value if isinstance(value, Column) else F.lit(value).cast("string")
        old = F.col(name) if name in docs.columns else F.lit(None).cast("string")
        out[name] = F.when(value.isNull(), old).when(value == "", F.lit(None)).otherwise(value)
    return docs.withColumns(out) if out else docs


def strip_metadata(docs: DataFrame) -> DataFrame:
    return docs.withColumns({c: F.lit(None).cast("string") for c in METADATA if c in docs.columns})


# ---- placed images ---------------------------------------------------------------------------


def display_sizes(uses: DataFrame) -> DataFrame:
    """(xref, w, h): the largest size at which each image is shown."""
    return uses.groupBy("xref").agg(F.max("w").alias("w"), F.max("h").alias("h"))


def targets(images: DataFrame, sizes: DataFrame, dpi: float = 150.0, slack: float = 1.2) -> DataFrame:
    """Pixels that images (xref, width, height) need at ``dpi`` for their shown size, and whether to shrink them."""
    need = lambda shown, have: F.least(F.greatest(F.ceil(shown / 72.0 * dpi), F.lit(1)), have)
    sized = images.join(sizes, "xref", "left").withColumns({"new_w": need(F.col("w"), F.col("width")), "new_h": need(F.col("h"), F.col("height"))})
    return sized.withColumn("shrink", F.coalesce((F.col("width") > F.col("new_w") * slack) & (F.col("height") > F.col("new_h") * slack), F.lit(False)))


def reason_counts(images: DataFrame, reason: Column) -> DataFrame:
    """(reason, n): why images are skipped; nulls are not skipped."""
    return images.withColumn("reason", reason).where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


# ---- outputs ---------------------------------------------------------------------------------


def output_names(parts: DataFrame, template: str = "{stem}.pdf") -> DataFrame:
    """Adds ``out_name`` to (name, part, ...): {stem}, {index}, {total}, {n}; several parts get -index if nothing tells them apart.

    {n} counts outputs over the whole job by name and part, from running totals of
    the names, so no task sees all rows.
    """
    per = Window.partitionBy("name")
    counted = parts.withColumns({"_total": F.count(F.lit(1)).over(per), "_index": F.row_number().over(per.orderBy("part"))})
    if "{n}" in template:
        totals = parts.groupBy("name").agg(F.count(F.lit(1)).alias("_c"))
        starts = running_totals(totals, [], ["name"], "_c", "_start").select("name", "_start")
        counted = counted.join(starts, "name").withColumn("_n", F.col("_start") + F.col("_index"))
    else:
        counted = counted.withColumn("_n", F.lit(0))
    text = F.lit(template)
    for token, value in (("{stem}", stem(F.col("name"))), ("{index}", F.col("_index").cast("string")), ("{total}", F.col("_total").cast("string")), ("{n}", F.col("_n").cast("string"))):
        text = F.replace(text, F.lit(token), value)
    if "{index}" not in template and "{n}" not in template:
        text = F.when(F.col("_total") > 1, F.regexp_replace(text, F.lit(r"^(.*?)(\.[^.]*)?$"), F.concat(F.lit("$1-"), F.col("_index").cast("string"), F.lit("$2")))).otherwise(text)
    return counted.withColumn("out_name", text).drop("_total", "_index", "_n", "_start")


def corpus_report(docs: DataFrame) -> DataFrame:
    """One row a source: documents, documents with text, characters, and the longest."""
    n = F.length(F.coalesce("text", F.lit("")))
    return docs.groupBy("source").agg(
        F.count(F.lit(1)).alias("docs"), F.sum((n > 20).cast("long")).alias("with_text"), F.sum(n).alias("chars"), F.max(n).cast("long").alias("longest"))
