"""Words, lines and paragraphs from positioned characters, and searching them."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from pagewright.functions import geometry as G, strings as S

PAGE = ("doc_id", "page_ix")
NEW_LINE, NEW_PARAGRAPH = 0.45, 1.9  # parts of the type size
LINE = "doc_id bigint, page_ix int, line_ix int, text string, x0 double, y0 double, x1 double, y1 double, baseline double, size double"


def _lines_of(rows: list[dict], spots: bool = False) -> list[dict]:
    """Lines of one page: glyphs by direction, then down the page, then along the line.

    A line takes the next glyph while its baseline is within 0.45 of the larger
    size of the mean baseline so far; a gap wider than half a space, or than
    0.12 of the size, becomes a space. With ``spots`` a line also has the glyph of
    each character of its text, None for a space that a gap stands for.
    """
    def turned(g):
        angle = round(math.degrees(math.atan2(g.get("dy") or 0.0, g["dx"])) / 5) % 72
        turn = math.radians(angle * 5)
        x, y = g["x0"], g["baseline"]
        return g, angle, x * math.cos(turn) + y * math.sin(turn), -x * math.sin(turn) + y * math.cos(turn), turn

    upright = lambda g: not g.get("dy") and (g.get("dx") is None or g["dx"] > 0)
    marked = [(g, 0, g["x0"], g["baseline"], 0.0) if upright(g) else turned(g) for g in rows]
    marked.sort(key=lambda m: (m[1], -m[3], m[2]))
    groups: list[list] = []
    angle, total, largest = None, 0.0, 0.0  # of the line so far
    for m in marked:
        size = m[0]["size"]
        if groups and m[1] == angle and abs(m[3] - total / len(groups[-1])) <= NEW_LINE * (size if size > largest else largest):
            groups[-1].append(m)
            total += m[3]
            if size > largest:
                largest = size
        else:
            groups.append([m])
            angle, total, largest = m[1], m[3], size
    out = []
    for line in groups:
        line.sort(key=lambda m: m[2])
        parts, end, at, spaced = [], None, [], False  # spaced: the text so far ends with a space
        level, across = abs(math.cos(line[0][4])), abs(math.sin(line[0][4]))
        for g, _, along, _, _ in line:
            shown = g["text"]
            if end is not None and along > end and not spaced and shown != " " and along - end > max(0.5 * (g.get("space_width") or 0.0), 0.12 * g["size"]):
                parts.append(" ")
                at.append(None)
                spaced = True
            if not spaced or not shown.isspace():
                parts.append(shown)
                at += [g] * len(shown)
                spaced = shown.endswith(" ")
            end = along + (g["x1"] - g["x0"]) * level + (g["y1"] - g["y0"]) * across
        text = "".join(parts)
        boxes = [m[0] for m in line]
        sizes = sorted(g["size"] for g in boxes)
        out.append({
            "text": text.strip(), "x0": min(b["x0"] for b in boxes), "y0": min(b["y0"] for b in boxes), "x1": max(b["x1"] for b in boxes),
            "y1": max(b["y1"] for b in boxes), "baseline": line[0][0]["baseline"], "size": sizes[len(sizes) // 2]})
        if spots:
            start = len(text) - len(text.lstrip())
            out[-1]["spots"] = at[start : start + len(out[-1]["text"])]
    return [o for o in out if o["text"]]


def _level_lines(text: list[str], x0, y0, x1, y1, baseline, size, space) -> list[dict]:
    """``_lines_of`` for upright glyphs, as arrays: lines take whole levels of equal baseline, since a glyph
    that may join makes its level's others join too."""
    order = np.lexsort((x0, -baseline))
    level = np.flatnonzero(np.concatenate([[True], np.diff(baseline[order]) != 0]))
    ends = np.append(level[1:], len(order))
    groups, total, count, largest = [], 0.0, 0, 0.0
    for a, b in zip(level.tolist(), ends.tolist()):
        base, first = float(baseline[order[a]]), float(size[order[a]])
        if groups and abs(base - total / count) <= NEW_LINE * max(largest, first):
            groups[-1][1] = b
        else:
            groups.append([a, b])
            total, count, largest = 0.0, 0, 0.0
        total, count, largest = total + base * (b - a), count + b - a, max(largest, float(size[order[a:b]].max()))
    out = []
    for a, b in groups:
        own = order[a:b]
        own = own[np.argsort(x0[own], kind="stable")]
        gap = np.zeros(len(own), bool)
        gap[1:] = x0[own][1:] - x1[own][:-1] > np.maximum(0.5 * space[own][1:], 0.12 * size[own][1:])
        parts, spaced = [], False  # spaced: the text so far ends with a space
        for k, wide in zip(own.tolist(), gap.tolist()):
            shown = text[k]
            if wide and not spaced and shown != " ":
                parts.append(" ")
                spaced = True
            if not spaced or not shown.isspace():
                parts.append(shown)
                spaced = shown.endswith(" ")
        line = "".join(parts).strip()
        if line:
            out.append({"text": line, "x0": x0[own].min(), "y0": y0[own].min(), "x1": x1[own].max(), "y1": y1[own].max(), "baseline": baseline[own[0]], "size": np.sort(size[own])[len(own) // 2]})
    return out


def _lines_table(table: pa.Table) -> pa.Table:
    has = set(table.column_names)
    column = lambda c: table.column(c).to_numpy()
    level = ("dy" not in has or not np.any(column("dy"))) and ("dx" not in has or np.all(column("dx") > 0))
    if level:
        space = column("space_width") if "space_width" in has else np.zeros(len(table))
        made = _level_lines(table.column("text").to_pylist(), *(column(c) for c in ("x0", "y0", "x1", "y1", "baseline", "size")), space)
    else:
        made = _lines_of(table.to_pylist())
    names = ["text", "x0", "y0", "x1", "y1", "baseline", "size"]
    n = len(made)
    columns = {"doc_id": pa.array([table.column("doc_id")[0].as_py()] * n, pa.int64()), "page_ix": pa.array([table.column("page_ix")[0].as_py()] * n, pa.int32()), "line_ix": pa.array(np.arange(n, dtype=np.int32))}
    columns |= {c: pa.array([m[c] for m in made], pa.string() if c == "text" else pa.float64()) for c in names}
    return pa.table(columns)


def lines(glyphs: DataFrame) -> DataFrame:
    """Exact line clustering, page by page: membership depends on the mean baseline of what came before.

    A page is the unit of work and is bounded by what a page holds; documents
    spread over the cluster.
    """
    used = [c for c in (*PAGE, "text", "x0", "y0", "x1", "y1", "baseline", "size", "dx", "dy", "space_width") if c in glyphs.columns]
    return glyphs.select(*used).groupBy(*PAGE).applyInArrow(_lines_table, LINE)


def lines_by_gap(glyphs: DataFrame) -> DataFrame:
    """Lines of upright text in built-in operators: a new line where the baseline moves from its predecessor's.

    Equal to ``lines`` where baselines within a line are level. Glyphs are gathered
    by baseline first, so windows see a row a baseline and not a row a glyph.
    """
    glyph = F.struct("x0", "x1", "size", "text")
    level = glyphs.groupBy(*PAGE, "baseline").agg(
        F.collect_list(glyph).alias("_g"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.max("size").alias("size"),
        F.min_by("size", "x0").alias("_first"), F.max_by("size", "x0").alias("_last"))
    order = Window.partitionBy(*PAGE).orderBy(F.col("baseline").desc())
    moved = F.abs(F.col("baseline") - F.lag("baseline").over(order)) > NEW_LINE * F.greatest("_first", F.lag("_last").over(order))
    island = level.withColumn("_new", F.coalesce(moved.cast("int"), F.lit(0))).withColumn(
        "line_ix", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    merged = island.groupBy(*PAGE, "line_ix").agg(
        F.array_sort(F.flatten(F.collect_list("_g"))).alias("_g"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        F.max("baseline").alias("baseline"), F.max("size").alias("size"))
    # A gap of 0.12 of the size between two characters that are no spaces becomes a space.
    text = F.expr("""array_join(transform(_g, (g, i) -> if(i > 0 and g.text <> ' ' and _g[i - 1].text <> ' ' and g.x0 - _g[i - 1].x1 > 0.12 * g.size, concat(' ', g.text), g.text)), '')""")
    return merged.select(*PAGE, "line_ix", F.trim(F.regexp_replace(text, r"(?U)\s+", " ")).alias("text"), "x0", "y0", "x1", "y1", "baseline", "size").where("text <> ''")


def paragraphs(lines: DataFrame) -> DataFrame:
    """(doc_id, page_ix, para_ix, text): lines joined while the baseline gap is at most 1.9 sizes."""
    order = Window.partitionBy(*PAGE).orderBy("line_ix")
    far = F.abs(F.lag("baseline").over(order) - F.col("baseline")) > NEW_PARAGRAPH * F.greatest("size", F.lit(1.0))
    marked = lines.withColumn("_new", F.coalesce(far.cast("int"), F.lit(0))).withColumn("para_ix", F.sum("_new").over(order).cast("int"))
    text = F.transform(F.sort_array(F.collect_list(F.struct("line_ix", "text"))), lambda r: r["text"])
    return marked.groupBy(*PAGE, "para_ix").agg(F.array_join(text, "\n").alias("text"))


def words(glyphs: DataFrame, line: str = "line_no") -> DataFrame:
    """(doc_id, page_ix, line, word_ix, text, x0, y0, x1, y1): runs between spaces with their boxes."""
    order = Window.partitionBy(*PAGE, line).orderBy("x0")
    counted = glyphs.withColumn("_w", F.sum((F.col("text") == " ").cast("int")).over(order)).where("text <> ' '")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "text"))), lambda g: g["text"]), "")
    boxed = counted.groupBy(*PAGE, line, "_w").agg(
        text.alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    rank = F.row_number().over(Window.partitionBy(*PAGE, line).orderBy("_w")) - 1
    return boxed.withColumn("word_ix", rank.cast("int")).drop("_w")


def run_words(runs: DataFrame, line: str = "line_no") -> DataFrame:
    """``words`` of fixed-pitch runs (doc_id, page_ix, line, text, x0, y0, y1, advance): places come from arithmetic, a row a word."""
    parts = runs.select(*PAGE, line, "x0", "y0", "y1", "advance", F.posexplode(F.split("text", " ")).alias("_k", "text"))
    before = Window.partitionBy(*PAGE, line).orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    full = (F.col("text") != "").cast("int")
    placed = parts.withColumns({"_at": F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)), "word_ix": F.coalesce(F.sum(full).over(before), F.lit(0)).cast("int")}).where("text <> ''")
    left = F.col("x0") + F.col("advance") * F.col("_at")
    return placed.select(*PAGE, line, "word_ix", "text", left.alias("x0"), "y0", (F.col("x0") + F.col("advance") * (F.col("_at") + F.length("text"))).alias("x1"), "y1")


def run_hits(runs: DataFrame, areas: DataFrame, line: str = "line_no", margin: float = 0.5) -> DataFrame:
    """(doc_id, page_ix, line, col): the characters of fixed-pitch runs that ``hit_glyphs`` would hit, a row a hit.

    A run meets the areas of its page; the columns that an area can reach come
    from arithmetic, and the exact rule judges those alone.
    """
    grown = areas.select(*PAGE, G.grow(F.struct(*[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]), margin).alias("area"))
    met = runs.join(grown, list(PAGE)).where((F.col("area.y0") <= F.col("y1")) & (F.col("y0") <= F.col("area.y1")))
    low = F.greatest(F.floor((F.col("area.x0") - F.col("x0")) / F.col("advance")) - 1, F.lit(0))
    high = F.least(F.ceil((F.col("area.x1") - F.col("x0")) / F.col("advance")) + 1, F.length("text") - 1)
    reached = met.withColumns({"_low": low.cast("int"), "_high": high.cast("int")}).where("_low <= _high")
    cols = reached.select(*PAGE, line, "area", "x0", "y0", "y1", "advance", F.explode(F.sequence("_low", "_high")).alias("col"))
    box = F.struct((F.col("x0") + F.col("advance") * F.col("col")).alias("x0"), "y0", (F.col("x0") + F.col("advance") * (F.col("col") + 1)).alias("x1"), "y1")
    return cols.where(G.hits(box, F.col("area"))).select(*PAGE, line, "col").distinct()


def matches(text: DataFrame, term: str, ignore_case: bool = True, whole_word: bool = False, column: str = "text") -> DataFrame:
    """Rows with ``n_matches``; non-overlapping, leftmost, over folded text."""
    return text.withColumn("n_matches", S.count_matches(F.col(column), term, ignore_case, whole_word))


def match_texts(text: DataFrame, term: str, ignore_case: bool = True, whole_word: bool = False, column: str = "text") -> DataFrame:
    """One row a match: match_ix, the folded text that matched."""
    found = F.regexp_extract_all(S.fold(F.col(column), ignore_case), F.lit(S.pattern(S.needle(term, ignore_case), whole_word)), F.lit(0))
    return text.select("*", F.posexplode(found).alias("match_ix", "match"))


def joined_lines(lines: DataFrame, keys: tuple[str, ...] = ("doc_id",), order: str = "line_ix") -> DataFrame:
    """Lines of a page as one text; a line break counts as one space."""
    ordered = F.sort_array(F.collect_list(F.struct(order, "text")))
    return lines.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda r: r["text"]), " ").alias("text"))


def redacted_text(text: DataFrame, term: str, mark: str = "█", ignore_case: bool = True, whole_word: bool = False, column: str = "text") -> DataFrame:
    """Each character of a match replaced by ``mark``; adds n_redacted. Only folds that keep lengths are matched."""
    flags = "(?iu)" if ignore_case else ""
    found = F.lit(flags + S.pattern(term, whole_word))
    return text.withColumns({
        "n_redacted": F.regexp_count(F.col(column), found).cast("long"),
        column: F.regexp_replace(F.col(column), found, F.lit(mark * len(term)))})


def hit_glyphs(glyphs: DataFrame, areas: DataFrame, margin: float = 0.5, cell: float = 64.0) -> DataFrame:
    """Glyphs in any area of their page: centre inside, or a quarter covered, of the area grown by ``margin``.

    Both sides are cut into square cells and meet by an equi-join on page and
    cell, so no pair is formed that lies apart; each glyph is judged per area.
    """
    grown = areas.select(*PAGE, G.grow(F.struct(*[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]), margin).alias("area"))
    span = lambda a, b: F.sequence(F.floor(a / cell).cast("int"), F.floor(b / cell).cast("int"))
    tiles = grown.withColumn("_cx", F.explode(span(F.col("area.x0"), F.col("area.x1")))).withColumn("_cy", F.explode(span(F.col("area.y0"), F.col("area.y1"))))
    keyed = glyphs.withColumn("_box", F.struct("x0", "y0", "x1", "y1"))
    placed = keyed.withColumn("_cx", F.explode(span(F.col("x0"), F.col("x1")))).withColumn("_cy", F.explode(span(F.col("y0"), F.col("y1"))))
    met = placed.join(tiles, [*PAGE, "_cx", "_cy"]).where(G.hits(F.col("_box"), F.col("area")))
    return met.select(*glyphs.columns).distinct()
