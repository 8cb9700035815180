"""Page algebra: operators on page tables (doc_id, page_ix, ...).

Every operator returns pages numbered from 0 without gaps within a document and
keeps the other columns. Windows are per document, so work spreads over
documents; page counts come from one small aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pagewright.functions import ranges

DOC, PAGE = "doc_id", "page_ix"


def counts(pages: DataFrame) -> DataFrame:
    """(doc_id, n): pages of each document."""
    return pages.groupBy(DOC).agg(F.count(F.lit(1)).alias("n"))


def renumber(pages: DataFrame, *order) -> DataFrame:
    """Number pages from 0 by ``order`` within a document."""
    rank = F.row_number().over(Window.partitionBy(DOC).orderBy(*(order or (PAGE,)))) - 1
    kept = [c for c in pages.columns if c != PAGE and c != "ord"]
    return pages.withColumn("_new", rank.cast("int")).select(*kept, F.col("_new").alias(PAGE))


def listed(pages: DataFrame, spec: str, strict: bool = True) -> DataFrame:
    """(doc_id, ord, page_ix): the pages of a range expression in the order written."""
    return counts(pages).select(DOC, F.posexplode(ranges.expand(spec, F.col("n"), strict)).alias("ord", PAGE))


def select(pages: DataFrame, spec: str, strict: bool = True) -> DataFrame:
    """Keep, reorder or repeat pages; a page listed twice is copied."""
    return renumber(listed(pages, spec, strict).join(pages, [DOC, PAGE]), "ord")


def extract(pages: DataFrame, spec: str, strict: bool = True) -> DataFrame:
    """New documents of the listed pages; a page listed twice comes once, where it is first."""
    first = listed(pages, spec, strict).groupBy(DOC, PAGE).agg(F.min("ord").alias("ord"))
    return renumber(first.join(pages, [DOC, PAGE]), "ord")


def delete(pages: DataFrame, spec: str, strict: bool = True) -> DataFrame:
    gone = listed(pages, spec, strict).select(DOC, PAGE).distinct()
    return renumber(pages.join(gone, [DOC, PAGE], "left_anti"))


def reverse(pages: DataFrame) -> DataFrame:
    return renumber(pages, F.col(PAGE).desc())


def move(pages: DataFrame, source: int, target: int) -> DataFrame:
    """Take page ``source`` out and put it back as page ``target``; other documents' pages stay where they lack it."""
    p = F.col(PAGE)
    if source < target:
        place = F.when(p == source, target).when((p > source) & (p <= target), p - 1).otherwise(p)
    else:
        place = F.when(p == source, target).when((p >= target) & (p < source), p + 1).otherwise(p)
    joined = pages.join(counts(pages), DOC)
    fits = F.greatest(F.lit(source), F.lit(target)) < F.col("n")
    return joined.withColumn(PAGE, F.when(fits, place).otherwise(p).cast("int")).drop("n")


def insert_blank(pages: DataFrame, at: int, count: int = 1) -> DataFrame:
    """Insert empty pages before page ``at`` (at the end of shorter documents); other columns of blanks are null."""
    sized = counts(pages)
    spot = F.least(F.lit(at), F.col("n")).cast("int")
    moved = pages.join(sized, DOC).withColumn(PAGE, F.when(F.col(PAGE) >= spot, F.col(PAGE) + count).otherwise(F.col(PAGE)).cast("int")).drop("n")
    blanks = sized.select(DOC, F.explode(F.sequence(spot, spot + count - 1)).alias(PAGE))
    return moved.unionByName(blanks, allowMissingColumns=True)


def split_every(pages: DataFrame, every: int) -> DataFrame:
    """Consecutive parts of ``every`` pages (0: one part): adds part, and page_ix counts within it."""
    if every <= 0:
        return pages.withColumn("part", F.lit(0))
    return pages.withColumns({"part": F.floor(F.col(PAGE) / every).cast("int"), PAGE: (F.col(PAGE) % every).cast("int")})


def split_ranges(pages: DataFrame, specs: list[str], strict: bool = True) -> DataFrame:
    """One part for each range expression."""
    out = None
    for k, spec in enumerate(specs):
        part = extract(pages, spec, strict).withColumn("part", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else pages.withColumn("part", F.lit(0)).limit(0)


def merge(pages: DataFrame, into: Column | str, *order) -> DataFrame:
    """Concatenate documents that share ``into``, by ``order`` (a document's columns; doc_id by default), then by page.

    Documents are counted first, and get their first page number from the counts
    before them; pages are then numbered within their own document, so one large
    target is no single task.
    """
    from .graph import running_totals

    target = F.col(into) if isinstance(into, str) else into
    marked = pages.withColumn("_into", target)
    keys = [c for c in order if c != DOC]
    sizes = marked.groupBy("_into", DOC).agg(F.count(F.lit(1)).alias("_n"), *[F.min(c).alias(f"_o{k}") for k, c in enumerate(keys)])
    place = [DOC if c == DOC else f"_o{keys.index(c)}" for c in order or (DOC,)]
    starts = running_totals(sizes, ["_into"], [*place, *([DOC] if DOC not in place else [])], "_n", "_start").select(
        F.col("_into").alias("_to"), F.col(DOC).alias("_doc"), "_start")
    rank = F.row_number().over(Window.partitionBy("_into", DOC).orderBy(PAGE)) - 1
    merged = marked.withColumn("_rank", rank).join(starts, F.col("_into").eqNullSafe(F.col("_to")) & F.col(DOC).eqNullSafe(F.col("_doc")))
    kept = [c for c in pages.columns if c not in (DOC, PAGE)]
    return merged.select(F.col("_into").alias(DOC), (F.col("_start") + F.col("_rank")).cast("int").alias(PAGE), F.col(DOC).alias("from_doc"), F.col(PAGE).alias("from_page"), *kept)


def numbered(pages: DataFrame, template: str, start: int = 1, spec: str | None = None, strict: bool = True) -> DataFrame:
    """Adds ``label``: the k-th listed page (all pages if ``spec`` is None) shows start + k; others null.

    ``{pages}`` is the last number shown, not the document's page count.
    """
    from pagewright.functions.strings import substitute

    chosen = listed(pages, spec if spec else "all", strict)
    total = chosen.groupBy(DOC).agg(F.count(F.lit(1)).alias("_total"))
    label = substitute(template, (F.col("ord") + start).cast("long"), (F.col("_total") + start - 1).cast("long"))
    shown = chosen.join(total, DOC).select(DOC, PAGE, label.alias("label"))
    return pages.join(shown, [DOC, PAGE], "left")


def nup(pages: DataFrame, per_sheet: int, sheet_w: float, sheet_h: float) -> DataFrame:
    """Adds sheet, slot and the slot's cell: 2 or 4 pages a sheet in reading order."""
    if per_sheet not in (2, 4):
        raise ValueError("per_sheet must be 2 or 4")
    columns = 2 if per_sheet == 4 or sheet_w >= sheet_h else 1
    rows = per_sheet // columns
    slot = F.col(PAGE) % per_sheet
    col, row = slot % columns, F.floor(slot / columns)
    cw, ch = sheet_w / columns, sheet_h / rows
    cell = F.struct((col * cw).alias("x0"), (sheet_h - (row + 1) * ch).alias("y0"), ((col + 1) * cw).alias("x1"), (sheet_h - row * ch).alias("y1"))
    return pages.withColumns({"sheet": F.floor(F.col(PAGE) / per_sheet).cast("int"), "slot": slot.cast("int"), "cell": cell})


def booklet(pages: DataFrame) -> DataFrame:
    """(doc_id, sheet, slot, page_ix): two pages a side in folding order; padding slots have a null page."""
    n, k = F.col("n"), F.col("_k")
    total = (F.ceil(n / 4) * 4).cast("int")
    sides = counts(pages).withColumn("_total", total).where("n > 0").select(DOC, "n", "_total", F.explode(F.expr("sequence(0, _total div 2 - 1)")).alias("_k"))
    low, high = k, F.col("_total") - 1 - k
    left = F.when(k % 2 == 0, high).otherwise(low)
    right = F.when(k % 2 == 0, low).otherwise(high)
    slots = sides.select(DOC, "n", F.col("_k").alias("sheet"), F.posexplode(F.array(left, right)).alias("slot", "_p"))
    return slots.select(DOC, "sheet", "slot", F.when(F.col("_p") < n, F.col("_p")).cast("int").alias(PAGE))


def to_spec(indices: DataFrame, key: str = DOC, index: str = PAGE) -> DataFrame:
    """(key, spec): the range expression of a set of pages; runs of three and more as a-b."""
    distinct = indices.select(key, index).distinct()
    island = F.col(index) - F.row_number().over(Window.partitionBy(key).orderBy(index))
    runs = distinct.withColumn("_i", island).groupBy(key, "_i").agg(F.min(index).alias("a"), F.max(index).alias("b"))
    a, b = (F.col("a") + 1).cast("string"), (F.col("b") + 1).cast("string")
    text = F.when(F.col("a") == F.col("b"), a).when(F.col("b") == F.col("a") + 1, F.concat_ws(", ", a, b)).otherwise(F.concat_ws("-", a, b))
    ordered = F.sort_array(F.collect_list(F.struct("a", text.alias("t"))))
    return runs.groupBy(key).agg(F.array_join(F.transform(ordered, lambda r: r["t"]), ", ").alias("spec"))


def page_text(pages: DataFrame, separator: str = "\n\f\n") -> DataFrame:
    """(doc_id, text): pages joined by form feeds."""
    ordered = F.sort_array(F.collect_list(F.struct(PAGE, F.coalesce("text", F.lit("")).alias("text"))))
    return pages.groupBy(DOC).agg(F.array_join(F.transform(ordered, lambda r: r["text"]), separator).alias("text"))


def shift_bookmarks(bookmarks: DataFrame, at: int, by: int, page: str = "page_ix") -> DataFrame:
    return bookmarks.withColumn(page, F.when(F.col(page) >= at, F.col(page) + by).otherwise(F.col(page)))


def compare(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, page_ix, diff): word differences of pages whose text changed, with missing pages as empty."""
    from pagewright.functions.strings import word_diff

    a = old.select(DOC, PAGE, F.coalesce("text", F.lit("")).alias("_a"))
    b = new.select(DOC, PAGE, F.coalesce("text", F.lit("")).alias("_b"))
    both = a.join(b, [DOC, PAGE], "full").fillna("", ["_a", "_b"]).where("_a <> _b")
    return both.select(DOC, PAGE, word_diff("_a", "_b").alias("diff"))
