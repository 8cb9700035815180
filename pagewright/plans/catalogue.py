"""Named queries over the supplied tables, each with its DuckDB oracle where SQL can express it."""

from __future__ import annotations

import json
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pagewright.functions import geometry as G, strings as S
from pagewright.operators import graph, items, layout, pages as P
from pagewright.operators.storage import ship
from pagewright.plans import presets
from pagewright.plans.projections import (
    conversation_pages, document_lines, event_annotations, glyphs, line_key, placed_images, references, runs, table, web_pages)

TERM, WORD, SECRET = "the", "the", "License"
AREAS = [(0, 100.0, 600.0, 220.0, 660.0), (0, 300.0, 690.0, 420.0, 705.0)]


# ---- text ------------------------------------------------------------------------------------


def search_ci(spark, d):
    return layout.matches(document_lines(spark, d), TERM).groupBy("doc_id").agg(F.sum("n_matches").alias("n_matches"))


def search_whole_word(spark, d):
    return layout.matches(document_lines(spark, d), WORD, whole_word=True).groupBy("doc_id").agg(F.sum("n_matches").alias("n_matches"))


def search_across_lines(spark, d):
    return layout.matches(layout.joined_lines(document_lines(spark, d)), "on the").select("doc_id", "n_matches")


def redact_text(spark, d):
    lines = layout.redacted_text(document_lines(spark, d), SECRET, mark="#", ignore_case=False)
    return lines.where("n_redacted > 0").select("doc_id", "line_ix", "text", "n_redacted")


def page_text(spark, d):
    return P.page_text(conversation_pages(spark, d))


def page_words(spark, d):
    return layout.run_words(runs(spark, d)).select("doc_id", "line_no", "word_ix", "text", F.round("x0", 2).alias("x0"), F.round("x1", 2).alias("x1"))


def _numbered_lines(lines):
    """Lines of pages as lines of documents: line_ix counts through the document, baselines are those on the page."""
    order = Window.partitionBy("doc_id").orderBy("page_ix", "line_ix")
    return lines.select("doc_id", (F.row_number().over(order) - 1).alias("line_ix"), "text", F.round("baseline", 2).alias("baseline"))


def lines_from_glyphs(spark, d):
    return _numbered_lines(layout.lines(glyphs(spark, d)))


def lines_by_gap(spark, d):
    return _numbered_lines(layout.lines_by_gap(glyphs(spark, d)))


def paragraphs(spark, d):
    lines = document_lines(spark, d).where("text <> ''").select(
        "doc_id", F.lit(0).alias("page_ix"), "line_ix", "text", F.lit(12.0).alias("size"),
        (720.0 - 14.0 * F.col("line_ix") - F.when(F.col("line_ix") >= 3, 20.0).otherwise(0.0)).alias("baseline"))
    return layout.paragraphs(lines).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


def fold_text(spark, d):
    framed = F.concat(F.lit("“"), "text", F.lit("” – ﬁn"))
    return table(spark, d, "documents").select("doc_id", S.fold(framed, ignore_case=False).alias("folded"))


def wrap_text(spark, d):
    return document_lines(spark, d).select("doc_id", "line_ix", F.posexplode(S.wrap_text(288.0)("text")).alias("row_ix", "row"))


def measure_text(spark, d):
    lines = document_lines(spark, d)
    return lines.select("doc_id", "line_ix", F.round(S.measure(F.col("text"), 12.0, {"i": 222, "l": 222, "m": 833, "w": 722, " ": 278}, 556), 3).alias("width"))


def word_diff(spark, d):
    lines = document_lines(spark, d).select("doc_id", F.col("line_ix").alias("page_ix"), "text")
    changed = lines.withColumn("text", F.regexp_replace("text", r"\bthe\b", "that"))
    return P.compare(lines, changed)


def name_stems(spark, d):
    name = F.concat(F.lit("/in/"), F.coalesce("lang", F.lit("")), F.lit("/"), "source", F.lit("."), F.col("doc_id").cast("string"), F.lit(".pdf"))
    return table(spark, d, "documents").select("doc_id", S.stem(name).alias("stem"), S.human(F.col("n_chars") * 300).alias("size"), S.truthy(F.col("lang")).alias("flag"))


def document_bytes(spark, d):
    coded = table(spark, d, "documents").select("doc_id", "text", S.to_document_bytes(F.col("text")).alias("data"))
    return coded.select("doc_id", F.octet_length("data").cast("long").alias("n_bytes"), (S.from_document_bytes(F.col("data")) == F.col("text")).alias("same"))


# ---- pages -----------------------------------------------------------------------------------


def _pages(spark, d):
    return conversation_pages(spark, d)


def _brief(df):
    return df.select("doc_id", "page_ix", "text")


def select_pages(spark, d):
    return _brief(P.select(_pages(spark, d), "3-1,2,last", strict=False))


def extract_pages(spark, d):
    return _brief(P.extract(_pages(spark, d), "last,1,first", strict=False))


def select_odd(spark, d):
    return _brief(P.select(_pages(spark, d), "odd"))


def select_even(spark, d):
    return _brief(P.select(_pages(spark, d), "even"))


def delete_pages(spark, d):
    return _brief(P.delete(_pages(spark, d), "2,last", strict=False))


def reverse_pages(spark, d):
    return _brief(P.reverse(_pages(spark, d)))


def move_page(spark, d):
    return _brief(P.move(_pages(spark, d), 0, 2))


def insert_blank(spark, d):
    return _brief(P.insert_blank(_pages(spark, d), 1, 2))


def split_every(spark, d):
    return P.split_every(_pages(spark, d), 2).select("doc_id", "part", "page_ix", "text")


def merge_docs(spark, d):
    lines = document_lines(spark, d).withColumnRenamed("line_ix", "page_ix")
    return P.merge(lines, "source").select("doc_id", "page_ix", "from_doc", "from_page")


def page_numbers(spark, d):
    return P.numbered(_pages(spark, d), "ACME{page:6} of {pages}", 10).select("doc_id", "page_ix", "label")


def nup(spark, d):
    return P.nup(_pages(spark, d), 4, 841.89, 595.28).select("doc_id", "page_ix", "sheet", "slot", F.round("cell.x0", 2).alias("x0"), F.round("cell.y0", 2).alias("y0"))


def booklet(spark, d):
    return P.booklet(_pages(spark, d))


def indices_to_spec(spark, d):
    events = table(spark, d, "events")
    return P.to_spec(events.select("user_id", (F.col("event_id") % 40).alias("ix")), "user_id", "ix")


def shift_bookmarks(spark, d):
    return P.shift_bookmarks(_pages(spark, d).select("doc_id", "page_ix", F.col("text").alias("title")), 2, 3)


# ---- graph and duplicates --------------------------------------------------------------------


def dedupe_exact(spark, d):
    return graph.canonical(table(spark, d, "documents"), "doc_id", "text")


def dedupe_fixpoint(spark, d):
    """Parts of one brand and size are equal; suppliers of equal parts become equal in the next round."""
    objects = table(spark, d, "nation").select(
        (F.col("n_nationkey") + 1000).cast("long").alias("num"), F.substring("n_name", 1, 1).alias("content")).unionByName(
        table(spark, d, "customer").select((F.col("c_custkey") + 10000).cast("long").alias("num"), F.col("c_mktsegment").alias("content")))
    refs = table(spark, d, "customer").select(
        (F.col("c_custkey") + 10000).cast("long").alias("src"), F.lit(0).alias("slot"), (F.col("c_nationkey") + 1000).cast("long").alias("dst"))
    return graph.dedupe(objects, refs)


def reachable(spark, d):
    """From all orders and line items along the foreign keys."""
    orders = table(spark, d, "orders").select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("node"))
    roots = orders.unionByName(table(spark, d, "lineitem").select(line_key().alias("node")))
    return graph.reachable(references(spark, d), roots)


def inherit_attr(spark, d):
    """Customers inherit a rotation from nations, nations from regions."""
    t = lambda n: table(spark, d, n)
    none = F.lit(None).cast("long")
    rot = lambda c: F.when(c % 3 == 0, c * 90 % 360).cast("long")
    nodes = t("region").select((F.col("r_regionkey") + 1).cast("long").alias("num"), none.alias("parent"), (F.col("r_regionkey") * 90 % 360).cast("long").alias("rotation"))
    nodes = nodes.unionByName(t("nation").select((F.col("n_nationkey") + 100).cast("long").alias("num"), (F.col("n_regionkey") + 1).cast("long").alias("parent"), rot(F.col("n_nationkey")).alias("rotation")))
    nodes = nodes.unionByName(t("customer").select((F.col("c_custkey") + 1000).cast("long").alias("num"), (F.col("c_nationkey") + 100).cast("long").alias("parent"), rot(F.col("c_custkey")).alias("rotation")))
    return graph.inherit(nodes, "rotation").select("num", "rotation")


def remap_refs(spark, d):
    refs = table(spark, d, "orders").select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst"))
    renamed = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("old"), (F.col("c_custkey") + 500000).alias("new"))
    return graph.remap(refs, renamed)


def flatten_tree(spark, d):
    t = lambda n: table(spark, d, n)
    nodes = t("region").select((F.col("r_regionkey") + 1).cast("long").alias("num"), F.lit(None).cast("long").alias("parent"), F.col("r_regionkey").cast("int").alias("pos"))
    nodes = nodes.unionByName(t("nation").select((F.col("n_nationkey") + 100).cast("long").alias("num"), (F.col("n_regionkey") + 1).cast("long").alias("parent"), F.col("n_nationkey").cast("int").alias("pos")))
    return graph.flatten_tree(spark, nodes).select("num", "depth", F.array_join(F.col("path").cast("array<string>"), "/").alias("path"))


def name_tree(spark, d):
    leaves = table(spark, d, "region").select((F.col("r_regionkey") * 5).alias("low"), (F.col("r_regionkey") * 5 + 3).alias("high"), F.col("r_name").alias("value"))
    return graph.range_lookup(table(spark, d, "nation").select(F.col("n_nationkey").alias("key")), leaves).select("key", "value")


def image_display_size(spark, d):
    sizes = items.display_sizes(placed_images(spark, d))
    images = table(spark, d, "part").select(F.col("p_partkey").alias("xref"), (F.col("p_size") * 20).alias("width"), (F.col("p_size") * 15).alias("height"))
    return items.targets(images, sizes).select("xref", "w", "h", F.col("new_w").cast("long").alias("new_w"), F.col("new_h").cast("long").alias("new_h"), "shrink")


def extract_first_use(spark, d):
    return graph.first_use(placed_images(spark, d)).select("xref", "page_ix", "op_ix")


def skip_reasons(spark, d):
    part = table(spark, d, "part")
    reason = F.when(F.col("p_size") < 5, "too small").when(F.col("p_type").startswith("PROMO"), "unsupported filter").when(F.col("p_retailprice") > 1800, "mask")
    return items.reason_counts(part, reason)


# ---- annotations, fields, outline ------------------------------------------------------------


def hit_test(spark, d):
    docs = table(spark, d, "documents").select("doc_id").distinct()
    areas = docs.select("doc_id", F.explode(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("p", "x0", "y0", "x1", "y1"), a)]) for a in AREAS])).alias("a")).select("doc_id", F.col("a.p").alias("page_ix"), "a.x0", "a.y0", "a.x1", "a.y1")
    return layout.run_hits(runs(spark, d), areas).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_hit"))


def annot_select(spark, d):
    return event_annotations(spark, d).where(items.selected(["Click", "view"])).select("num", "page_ix", "subtype")


def annot_remove(spark, d):
    rest = items.remove_annotations(event_annotations(spark, d), F.col("hidden"))
    return rest.groupBy("subtype").agg(F.count(F.lit(1)).alias("n"))


def flatten_split(spark, d):
    return items.flatten(event_annotations(spark, d), F.col("subtype") != "error").groupBy("subtype", "fate").agg(F.count(F.lit(1)).alias("n"))


def annot_pages(spark, d):
    return items.first_pages(event_annotations(spark, d)).select("num", "page_ix")


def _fields(spark, d):
    events = table(spark, d, "events")
    return events.select(F.col("user_id").alias("doc_id"), F.concat(F.lit("form."), "event_type", F.lit("."), F.col("event_id").cast("string")).alias("name"),
                         F.col("event_id").alias("num"), F.get_json_object("props", "$.k").alias("value"))


def list_fields(spark, d):
    return _fields(spark, d)


def set_fields(spark, d):
    events = table(spark, d, "events")
    name = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("form."), "event_type", F.lit("."), F.col("event_id").cast("string"))).when(F.col("event_id") % 4 == 1, F.col("event_id").cast("string")).otherwise("nothing")
    values = events.select(F.col("user_id").alias("doc_id"), name.alias("name"), F.lit("new").alias("value")).where("name <> 'nothing'")
    return items.set_fields(_fields(spark, d), values)[0].select("doc_id", "num", "name", "value")


def bookmarks(spark, d):
    return items.web_outline(web_pages(spark, d))


def links(spark, d):
    return items.web_links(web_pages(spark, d))


def metadata_patch(spark, d):
    docs = items.web_outline(web_pages(spark, d)).select("page_id", "title", F.lit("someone").alias("author"))
    subject = F.when(F.col("page_id") % 3 == 0, F.lit("")).when(F.col("page_id") % 3 == 1, F.lit("web"))
    return items.patch_metadata(docs, {"author": "", "subject": subject, "title": None}).select("page_id", "title", "author", "subject")


# ---- geometry --------------------------------------------------------------------------------


def _boxed(spark, d):
    return placed_images(spark, d).select("page_ix", "op_ix", "xref", G.from_xywh(F.col("op_ix") * 10.0, F.lit(20.0), F.col("w") * 10, F.col("h") * 10).alias("r"))


def rect_algebra(spark, d):
    page = G.rect(F.lit(30.0), F.lit(30.0), F.lit(300.0), F.lit(400.0))
    b = _boxed(spark, d)
    cut = G.intersection(F.col("r"), page)
    return b.select("page_ix", "op_ix", G.intersects(F.col("r"), page).alias("meets"), G.contains(page, F.col("r")).alias("inside"),
                    F.round(G.overlap_area(F.col("r"), page), 3).alias("area"), F.round(cut["x1"], 3).alias("cut_x1"), G.contains_point(page, G.center(F.col("r"))).alias("mid"))


def rotate_normalise(spark, d):
    return placed_images(spark, d).select("page_ix", "op_ix", G.quarter_turn(F.col("op_ix") * 90 - 270).alias("quarter"), G.turned(F.col("op_ix") * 90, -180).alias("turned"))


def resize_fit(spark, d):
    m = {k: G.fit(F.col("r"), F.lit(0), 595.28, 841.89, k) for k in ("fit", "fill", "stretch")}
    return _boxed(spark, d).select("page_ix", "op_ix", F.round(m["fit"]["a"], 6).alias("fit"), F.round(m["fill"]["a"], 6).alias("fill"), F.round(m["stretch"]["d"], 6).alias("stretch_y"))


def place_anchor(spark, d):
    w, h = G.width(F.col("r")), G.height(F.col("r"))
    spots = {k: G.place(k, 612.0, 792.0, w, h, 36.0) for k in ("top-right", "center", "bottom-left")}
    return _boxed(spark, d).select("page_ix", "op_ix", F.round(spots["top-right"]["x"], 7).alias("tr_x"), F.round(spots["center"]["y"], 7).alias("c_y"), F.round(spots["bottom-left"]["x"], 4).alias("bl_x"))


def matrix_inverse(spark, d):
    m = G.then(G.scaling(F.col("w"), F.col("h")), G.matrix(1, 0.5, 0, 1, 3, F.col("op_ix")))
    p = G.apply(G.invert(m), G.apply(m, G.point(F.col("w"), F.col("op_ix"))))
    return placed_images(spark, d).select("page_ix", "op_ix", F.round(p["x"], 6).alias("x"), F.round(p["y"], 6).alias("y"))


def permissions(spark, d):
    e = table(spark, d, "events")
    bits = G.permission_bits(print=F.col("event_id") % 2 == 0, copy=F.col("event_id") % 3 == 0)
    return e.select("event_id", bits.alias("p"), G.permission(bits, "print").alias("may_print"), G.permission(bits, "copy").alias("may_copy"))


# ---- outputs and pipelines -------------------------------------------------------------------


def output_names(spark, d):
    parts = P.split_every(_pages(spark, d), 2).select("doc_id", "part").distinct()
    named = parts.select(F.concat(F.lit("talk-"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("name"), "part", "doc_id")
    return items.output_names(named, "{stem}.out.pdf").select("doc_id", "part", "out_name")


PRESET = json.dumps({"schema": 1, "name": "talks", "steps": [
    {"op": "reverse"}, {"op": "rotate", "pages": "odd", "degrees": 90}, {"op": "delete-pages", "pages": "last"}, {"op": "split", "every": 3}]})


def preset_pipeline(spark, d):
    out = presets.run(presets.Preset.from_json(PRESET), _pages(spark, d).select("doc_id", "page_ix", "text"))
    return out.select("doc_id", "part", "page_ix", "rotation", "text")


def corpus_scan(spark, d):
    return items.corpus_report(table(spark, d, "documents"))


def codec_roundtrip(spark, d):
    """Every document through the writer and the reader again, character by character."""
    from pagewright.sources import documents as docs_io

    return docs_io.round_trip(spark, table(spark, d, "documents")).select("doc_id", "n_pages", "same", "text_sha256")


def encrypted_files(spark, d):
    """Every document encrypted by each method, read with its password."""
    from pagewright.sources import documents as docs_io

    every = [{"method": m, "user": "open", "owner": "own"} for m in ("rc4", "aes128", "aes256")]
    trips = docs_io.encrypted_round_trips(spark, table(spark, d, "documents"), every)
    return trips.select("doc_id", "method", "encrypted", "n_pages", "text_sha256")


def damaged_files(spark, d):
    """Every document without its last 40 bytes, where the way to its index is: objects are found by scanning."""
    from pagewright.sources import documents as docs_io

    every = [docs_io.round_trip(spark, table(spark, d, "documents"), lost=40, compress=c).withColumn("compressed", F.lit(c)) for c in (False, True)]
    return every[0].unionByName(every[1]).select("doc_id", "compressed", "reconstructed", "n_pages", "text_sha256")


def image_files(spark, d):
    from pagewright.sources import documents as docs_io

    return docs_io.image_round_trip(table(spark, d, "documents"))


def _talk_files(spark, d):
    from pagewright.sources import documents as docs_io

    return docs_io.write(conversation_pages(spark, d).select(F.col("doc_id").cast("string").alias("name"), "page_ix", "text"))


def _redact_all(name, file):
    from pagewright.sources.codec import redaction

    return redaction.redact_text(file, list(range(len(file.pages()))), "the")


def redact_files(spark, d):
    """Each word part "the" redacted in files of conversations; the pages as read again, and what is left of it."""
    from pagewright.sources import documents as docs_io

    back = docs_io.pages(docs_io.edited(_talk_files(spark, d), _redact_all))
    return back.select(F.col("name").cast("bigint").alias("doc_id"), "page_ix", "text", S.count_matches(F.col("text"), "the").alias("n_left"))


def _outline_pages(name, file):
    from pagewright.operators.layout import _lines_of
    from pagewright.sources.codec import content, edit

    titles = ["\n".join(line["text"] for line in _lines_of(content.page_content(file, page)[0])) for _, page in file.pages()]
    edit.set_bookmarks(file, [{"path": [k // 2] if k % 2 == 0 else [k // 2, 0], "title": t, "page": k} for k, t in enumerate(titles)])


def bookmark_files(spark, d):
    """An outline over the pages of each file, every second one below its predecessor, as read again."""
    from pagewright.sources import documents as docs_io

    back = docs_io.bookmarks(docs_io.edited(_talk_files(spark, d), _outline_pages))
    return back.select(F.col("name").cast("bigint").alias("doc_id"), "page_ix", F.array_join(F.col("path").cast("array<string>"), "/").alias("path"), "title")


def field_files(spark, d):
    """A form document for each user, a field for each event, as read again."""
    from pagewright.sources import documents as docs_io

    rows = _fields(spark, d).select(F.col("doc_id").cast("string").alias("name"), F.regexp_replace("name", r"\.", "-").alias("field"), "value")
    back = docs_io.fields(docs_io.write_forms(rows))
    return back.select(F.col("name").cast("bigint").alias("doc_id"), "field", "kind", F.coalesce("value", F.lit("")).alias("value"))


def merge_files(spark, d):
    """Five conversations a job, merged into one file; its pages in order."""
    from pagewright.sources import batch, documents as docs_io

    files = _talk_files(spark, d).select(F.lpad("name", 12, "0").alias("name"), "data", F.floor(F.col("name").cast("bigint") / 5).cast("string").alias("job"))
    made = batch.run(presets.Preset("merged", mode="merge"), files)
    return docs_io.pages(made.select(F.col("job").alias("name"), "data")).select(F.col("name").cast("bigint").alias("job"), "page_ix", "text")


def preset_files(spark, d):
    """Conversations written as files, a preset run on each, and the outputs read again."""
    from pagewright.sources import batch, documents as docs_io

    steps = [{"op": "reverse"}, {"op": "delete-pages", "pages": "last"}, {"op": "stamp-text", "text": "{page}/{pages}"}, {"op": "split", "every": 3}]
    named = conversation_pages(spark, d).select(F.col("doc_id").cast("string").alias("name"), "page_ix", "text")
    made = batch.run(presets.Preset("files", steps), docs_io.write(named))
    back = docs_io.stamped_pages(made.select(F.col("out_name").alias("name"), "data"), 12.0)
    part = F.coalesce(F.try_element_at(F.split(F.regexp_replace("name", r"\.pdf$", ""), "-"), F.lit(2)).cast("int"), F.lit(1)) - 1
    return back.select(F.regexp_extract("name", r"^[0-9]+", 0).cast("bigint").alias("doc_id"), part.alias("part"), "page_ix", F.col("text").alias("turn"), "stamp")


def object_types(spark, d):
    """Objects of written files by type: what the writer makes of a document of n pages."""
    from pagewright.sources import documents as docs_io

    named = conversation_pages(spark, d).select(F.col("doc_id").cast("string").alias("name"), "page_ix", "text")
    found = docs_io.objects(docs_io.write(named))
    return found.groupBy(F.col("name").cast("bigint").alias("doc_id"), "type").agg(F.count(F.lit(1)).alias("n"))


def flate_roundtrip(spark, d):
    from pagewright.sources import documents as docs_io

    return docs_io.filter_round_trip(table(spark, d, "documents"))


NAMES = (
    "search_ci search_whole_word search_across_lines redact_text page_text page_words lines_from_glyphs lines_by_gap paragraphs fold_text wrap_text measure_text "
    "word_diff name_stems document_bytes select_pages extract_pages select_odd select_even delete_pages reverse_pages move_page insert_blank split_every merge_docs "
    "page_numbers nup booklet indices_to_spec shift_bookmarks dedupe_exact dedupe_fixpoint reachable inherit_attr remap_refs flatten_tree name_tree "
    "image_display_size extract_first_use skip_reasons hit_test annot_select annot_remove flatten_split annot_pages list_fields set_fields bookmarks links "
    "metadata_patch rect_algebra rotate_normalise resize_fit place_anchor matrix_inverse permissions output_names preset_pipeline corpus_scan codec_roundtrip preset_files object_types flate_roundtrip "
    "encrypted_files damaged_files image_files redact_files bookmark_files field_files merge_files"
).split()


def _shipped(query):
    """The query, with this package at hand in the workers of its session."""

    @wraps(query)
    def run(spark, d):
        ship(spark)
        return query(spark, d)

    return run


def queries() -> dict:
    return {name: _shipped(globals()[name]) for name in NAMES}


# ---- oracles ---------------------------------------------------------------------------------

_LINES = "(SELECT doc_id, source, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS line_ix FROM documents)"
_PAGES = "(SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS page_ix, count(*) OVER (PARTITION BY conv_id) AS n, text FROM conversations)"
_GLYPHS = f"""(SELECT doc_id, line_ix AS line_no, line_ix // 45 AS page_ix, col, substr(text, col + 1, 1) AS ch, 72 + 7.2 * col::DOUBLE AS x0, 72 + 7.2 * (col + 1)::DOUBLE AS x1,
  720 - 14.0::DOUBLE * (line_ix % 45) AS baseline FROM (SELECT *, unnest(range(length(text))) AS col FROM {_LINES}))"""
# A text's lines as layout gives them back: runs of white space as one space, blank lines left out.
_SHOWN = "array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(regexp_replace(l, '\\s+', ' ', 'g'))), lambda l: l <> ''), chr(10))"
# Ligatures as letters, then typographic characters as plain ones.
_FOLDED = "translate(replace(replace(replace(replace(replace(text, 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬀ', 'ff'), '{}', '{}')".format(S.FOLD_FROM, S.FOLD_TO.replace("'", "''"))
# Characters that the Windows encoding lacks.
_BEYOND = "regexp_matches(text, '[^\\x00-\\x7F\\xA0-\\x{FF}€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]')"
_IMAGES = "(SELECT l_orderkey AS page_ix, l_linenumber AS op_ix, l_partkey AS xref, l_quantity AS w, l_extendedprice / 1000 AS h FROM lineitem)"
_ANNOTS = "(SELECT user_id AS page_ix, event_id AS num, event_type AS subtype, value < 20 AS hidden, event_id % 3 <> 0 AS has_appearance FROM events)"
_BOXES = f"(SELECT page_ix, op_ix, op_ix * 10.0::DOUBLE AS x0, 20.0::DOUBLE AS y0, op_ix * 10.0::DOUBLE + w * 10 AS x1, 20.0::DOUBLE + h * 10 AS y1 FROM {_IMAGES})"
_FIELDS = "(SELECT user_id AS doc_id, 'form.' || event_type || '.' || event_id AS name, event_id AS num, json_extract_string(props, '$.k') AS value FROM events)"


def oracle_sql() -> dict[str, str]:
    count = lambda t, n: f"((length({t}) - length(replace({t}, '{n}', ''))) // {len(n)})"
    return {
        "search_ci": f"SELECT doc_id, sum({count('lower(text)', 'the')})::BIGINT AS n_matches FROM {_LINES} GROUP BY doc_id",
        "search_whole_word": f"SELECT doc_id, sum(len(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w = 'the')))::BIGINT AS n_matches FROM {_LINES} GROUP BY doc_id",
        "search_across_lines": f"SELECT doc_id, {count('t', 'on the')}::BIGINT AS n_matches FROM (SELECT doc_id, lower(string_agg(text, ' ' ORDER BY line_ix)) AS t FROM {_LINES} GROUP BY doc_id)",
        "redact_text": f"SELECT doc_id, line_ix, replace(text, 'License', '#######') AS text, {count('text', 'License')}::BIGINT AS n_redacted FROM {_LINES} WHERE contains(text, 'License')",
        "page_text": f"SELECT doc_id, string_agg(text, chr(10) || chr(12) || chr(10) ORDER BY page_ix) AS text FROM {_PAGES} GROUP BY doc_id",
        "page_words": f"""SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY w) - 1 AS word_ix, text, x0, x1 FROM (
            SELECT doc_id, line_no, w, string_agg(ch, '' ORDER BY col) AS text, round(min(x0), 2) AS x0, round(max(x1), 2) AS x1 FROM (
              SELECT *, sum((ch = ' ')::INT) OVER (PARTITION BY doc_id, line_no ORDER BY col) AS w FROM {_GLYPHS}) WHERE ch <> ' ' GROUP BY ALL)""",
        "lines_from_glyphs": _typed_lines(),
        "lines_by_gap": _typed_lines(),
        "paragraphs": f"""WITH l AS (SELECT doc_id, line_ix, text, 720.0 - 14.0 * line_ix - CASE WHEN line_ix >= 3 THEN 20.0 ELSE 0.0 END AS b FROM {_LINES} WHERE text <> ''),
            m AS (SELECT *, coalesce(abs(lag(b) OVER w - b) > 22.8, false)::INT AS k FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY line_ix)),
            g AS (SELECT *, sum(k) OVER (PARTITION BY doc_id ORDER BY line_ix) AS p FROM m),
            q AS (SELECT doc_id, p, length(string_agg(text, chr(10) ORDER BY line_ix)) AS n FROM g GROUP BY doc_id, p)
            SELECT doc_id, count(*) AS n, sum(n)::BIGINT AS chars FROM q GROUP BY doc_id""",
        "fold_text": f"SELECT doc_id, '\"' || {_FOLDED} || '\" - fin' AS folded FROM documents",
        # A row takes the next word if both fit into 40 characters; a longer word begins a row and is cut every 40.
        "wrap_text": rf"""WITH l AS (SELECT doc_id, line_ix, regexp_extract_all(text, '[^\s\x0B]+') AS w FROM {_LINES}),
            c AS (SELECT doc_id, line_ix, list_transform(w, lambda x: rtrim(regexp_replace(x, '(.{{{{40}}}})', '\1' || chr(10), 'g'), chr(10))) AS w FROM l),
            r AS (SELECT doc_id, line_ix, string_split(CASE WHEN len(w) = 0 THEN '' ELSE list_reduce(w, lambda a, x: a || CASE WHEN NOT contains(x, chr(10))
              AND length(x) + 1 + (CASE WHEN contains(a, chr(10)) THEN strpos(reverse(a), chr(10)) - 1 ELSE length(a) END) <= 40 THEN ' ' ELSE chr(10) END || x) END, chr(10)) AS rows FROM c)
            SELECT doc_id, line_ix, unnest(range(len(rows))) AS row_ix, unnest(rows) AS row FROM r""".replace("{{40}}", "{40}"),
        "measure_text": f"""SELECT doc_id, line_ix, round(12.0::DOUBLE / 1000 * (556 * length(text) - 334 * ({count('text', 'i')} + {count('text', 'l')}) + 277 * {count('text', 'm')} + 166 * {count('text', 'w')} - 278 * {count('text', ' ')}), 3) AS width FROM {_LINES}""",
        "name_stems": """SELECT doc_id, source || '.' || doc_id AS stem, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f KB', b / 1024) ELSE printf('%.1f MB', b / 1048576) END AS size,
            false AS flag FROM (SELECT *, n_chars * 300 AS b FROM documents)""",
        "document_bytes": "SELECT doc_id, CASE WHEN octet_length(encode(text)) = length(text) THEN length(text) ELSE 2 + 2 * length(text) END::BIGINT AS n_bytes, true AS same FROM documents",
        "select_pages": f"""WITH p AS {_PAGES}, o(ord, kind) AS (VALUES (1, 2), (2, 1), (3, 0), (4, 1), (5, -1)),
            s AS (SELECT doc_id, ord, text FROM p JOIN o ON page_ix = CASE WHEN kind = -1 THEN n - 1 ELSE kind END WHERE ord = 5 OR (ord <= 3 AND n >= 3) OR (ord = 4 AND n >= 2))
            SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS page_ix, text FROM s""",
        "extract_pages": f"SELECT doc_id, CASE WHEN page_ix = n - 1 THEN 0 ELSE 1 END AS page_ix, text FROM {_PAGES} WHERE page_ix = 0 OR page_ix = n - 1",
        "select_odd": f"SELECT doc_id, page_ix // 2 AS page_ix, text FROM {_PAGES} WHERE page_ix % 2 = 0",
        "select_even": f"SELECT doc_id, page_ix // 2 AS page_ix, text FROM {_PAGES} WHERE page_ix % 2 = 1",
        "delete_pages": f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_ix) - 1 AS page_ix, text FROM {_PAGES} WHERE page_ix <> n - 1 AND page_ix <> 1",
        "reverse_pages": f"SELECT doc_id, n - 1 - page_ix AS page_ix, text FROM {_PAGES}",
        "move_page": f"SELECT doc_id, CASE WHEN n < 3 OR page_ix > 2 THEN page_ix WHEN page_ix = 0 THEN 2 ELSE page_ix - 1 END AS page_ix, text FROM {_PAGES}",
        "insert_blank": f"SELECT doc_id, CASE WHEN page_ix >= 1 THEN page_ix + 2 ELSE page_ix END AS page_ix, text FROM {_PAGES} UNION ALL SELECT DISTINCT doc_id, unnest([1, 2]) AS page_ix, NULL AS text FROM {_PAGES}",
        "split_every": f"SELECT doc_id, page_ix // 2 AS part, page_ix % 2 AS page_ix, text FROM {_PAGES}",
        "merge_docs": f"SELECT source AS doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id, line_ix) - 1 AS page_ix, doc_id AS from_doc, line_ix AS from_page FROM {_LINES}",
        "page_numbers": f"SELECT doc_id, page_ix, 'ACME' || lpad((page_ix + 10)::VARCHAR, 6, '0') || ' of ' || (n + 9) AS label FROM {_PAGES}",
        "nup": f"SELECT doc_id, page_ix, page_ix // 4 AS sheet, page_ix % 4 AS slot, round((page_ix % 2) * 420.945::DOUBLE, 2) AS x0, round(595.28::DOUBLE - ((page_ix % 4) // 2 + 1) * 297.64::DOUBLE, 2) AS y0 FROM {_PAGES}",
        "booklet": f"""WITH c AS (SELECT doc_id, max(n) AS n, ((max(n) + 3) // 4) * 4 AS t FROM {_PAGES} GROUP BY doc_id),
            k AS (SELECT doc_id, n, t, unnest(range(t // 2)) AS sheet FROM c), s AS (SELECT *, unnest([0, 1]) AS slot FROM k),
            p AS (SELECT *, CASE WHEN (sheet + slot) % 2 = 0 THEN t - 1 - sheet ELSE sheet END AS p FROM s)
            SELECT doc_id, sheet, slot, CASE WHEN p < n THEN p END AS page_ix FROM p""",
        "indices_to_spec": """WITH d AS (SELECT DISTINCT user_id, event_id % 40 AS ix FROM events),
            i AS (SELECT *, ix - row_number() OVER (PARTITION BY user_id ORDER BY ix) AS k FROM d),
            r AS (SELECT user_id, min(ix) + 1 AS a, max(ix) + 1 AS b FROM i GROUP BY user_id, k)
            SELECT user_id, string_agg(CASE WHEN a = b THEN a::VARCHAR WHEN b = a + 1 THEN a || ', ' || b ELSE a || '-' || b END, ', ' ORDER BY a) AS spec FROM r GROUP BY user_id""",
        "shift_bookmarks": f"SELECT doc_id, CASE WHEN page_ix >= 2 THEN page_ix + 3 ELSE page_ix END AS page_ix, text AS title FROM {_PAGES}",
        "dedupe_exact": "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS canonical FROM documents",
        "dedupe_fixpoint": """WITH n AS (SELECT n_nationkey + 1000 AS num, min(n_nationkey + 1000) OVER (PARTITION BY n_name[1]) AS canonical FROM nation)
            SELECT num::BIGINT AS num, canonical::BIGINT AS canonical FROM n UNION ALL
            SELECT (c_custkey + 10000)::BIGINT, min(c_custkey + 10000) OVER (PARTITION BY c_mktsegment, canonical) FROM customer JOIN n ON n.num = c_nationkey + 1000""",
        "reachable": """WITH RECURSIVE l AS (SELECT *, 'lineitem:' || l_orderkey || '/' || l_linenumber AS node FROM lineitem),
            e AS (SELECT node AS src, 'order:' || l_orderkey AS dst FROM l UNION ALL SELECT node, 'part:' || l_partkey FROM l UNION ALL SELECT node, 'supplier:' || l_suppkey FROM l
              UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey FROM orders UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer
              UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation),
            r AS (SELECT 'order:' || o_orderkey AS node, 0 AS depth FROM orders UNION SELECT node, 0 FROM l UNION SELECT dst, depth + 1 FROM r JOIN e ON src = node)
            SELECT node, min(depth) AS depth FROM r GROUP BY node""",
        "inherit_attr": """WITH r AS (SELECT r_regionkey + 1 AS num, r_regionkey * 90 % 360 AS rot FROM region),
            n AS (SELECT n_nationkey + 100 AS num, coalesce(CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey * 90 % 360 END, rot) AS rot FROM nation JOIN r ON r.num = n_regionkey + 1),
            c AS (SELECT c_custkey + 1000 AS num, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_custkey * 90 % 360 END, rot) AS rot FROM customer JOIN n ON n.num = c_nationkey + 100)
            SELECT num::BIGINT AS num, rot::BIGINT AS rotation FROM r UNION ALL SELECT num, rot FROM n UNION ALL SELECT num, rot FROM c""",
        "remap_refs": "SELECT o_orderkey AS src, CASE WHEN o_custkey % 2 = 0 AND c_custkey IS NOT NULL THEN o_custkey + 500000 END AS dst FROM orders LEFT JOIN customer ON c_custkey = o_custkey",
        "flatten_tree": "SELECT (r_regionkey + 1)::BIGINT AS num, 0 AS depth, r_regionkey::VARCHAR AS path FROM region UNION ALL SELECT n_nationkey + 100, 1, n_regionkey || '/' || n_nationkey FROM nation",
        "name_tree": "SELECT n_nationkey AS key, r_name AS value FROM nation LEFT JOIN region ON n_nationkey BETWEEN r_regionkey * 5 AND r_regionkey * 5 + 3",
        "image_display_size": f"""WITH s AS (SELECT xref, max(w) AS w, max(h) AS h FROM {_IMAGES} GROUP BY xref),
            t AS (SELECT p_partkey AS xref, w, h, p_size * 20 AS pw, p_size * 15 AS ph,
              least(greatest(ceil(w / 72.0::DOUBLE * 150), 1), p_size * 20)::BIGINT AS new_w, least(greatest(ceil(h / 72.0::DOUBLE * 150), 1), p_size * 15)::BIGINT AS new_h FROM part LEFT JOIN s ON xref = p_partkey)
            SELECT xref, w, h, new_w, new_h, coalesce(pw > new_w * 1.2 AND ph > new_h * 1.2, false) AS shrink FROM t""",
        "extract_first_use": f"SELECT xref, page_ix, op_ix FROM (SELECT *, row_number() OVER (PARTITION BY xref ORDER BY page_ix, op_ix) AS r FROM {_IMAGES}) WHERE r = 1",
        "skip_reasons": "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN p_size < 5 THEN 'too small' WHEN p_type LIKE 'PROMO%' THEN 'unsupported filter' WHEN p_retailprice > 1800 THEN 'mask' END AS reason FROM part) WHERE reason IS NOT NULL GROUP BY reason",
        "hit_test": f"""WITH g AS (SELECT doc_id, line_no, col, x0, x1, baseline - 2.64::DOUBLE AS y0, baseline + 10.8::DOUBLE AS y1 FROM {_GLYPHS} WHERE page_ix = 0),
            a(ax0, ay0, ax1, ay1) AS (VALUES (99.5::DOUBLE, 599.5::DOUBLE, 220.5::DOUBLE, 660.5::DOUBLE), (299.5, 689.5, 420.5, 705.5)),
            o AS (SELECT DISTINCT doc_id, line_no, col FROM g, a WHERE ((x0 + x1) / 2 BETWEEN ax0 AND ax1 AND (y0 + y1) / 2 BETWEEN ay0 AND ay1)
              OR greatest(0, least(x1, ax1) - greatest(x0, ax0)) * greatest(0, least(y1, ay1) - greatest(y0, ay0)) >= 0.25 * (x1 - x0) * (y1 - y0))
            SELECT doc_id, count(*) AS n_hit FROM o GROUP BY doc_id""",
        "annot_select": f"SELECT num, page_ix, subtype FROM {_ANNOTS} WHERE lower(subtype) IN ('click', 'view')",
        "annot_remove": f"SELECT subtype, count(*) AS n FROM {_ANNOTS} WHERE NOT hidden GROUP BY subtype",
        "flatten_split": f"SELECT subtype, CASE WHEN subtype = 'error' THEN 'kept' WHEN hidden THEN 'dropped' WHEN NOT has_appearance THEN 'kept' ELSE 'painted' END AS fate, count(*) AS n FROM {_ANNOTS} GROUP BY ALL",
        "annot_pages": f"SELECT num, min(page_ix) AS page_ix FROM {_ANNOTS} GROUP BY num",
        "list_fields": f"SELECT * FROM {_FIELDS}",
        "set_fields": f"SELECT doc_id, num, name, CASE WHEN num % 4 IN (0, 1) THEN 'new' ELSE value END AS value FROM {_FIELDS}",
        "bookmarks": r"""SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) AS heading,
            len(regexp_extract_all(html, '(?i)<a\s[^>]*href="([^"]*)"'))::BIGINT AS n_links FROM pages""",
        "links": r"""SELECT page_id, unnest(range(len(u))) AS link_ix, unnest(u) AS uri FROM (SELECT page_id, regexp_extract_all(html, '(?i)<a\s[^>]*href="([^"]*)"', 1) AS u FROM pages)""",
        "metadata_patch": r"SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, NULL::VARCHAR AS author, CASE WHEN page_id % 3 = 1 THEN 'web' END AS subject FROM pages",
        "rect_algebra": f"""SELECT page_ix, op_ix, x0 < 300 AND x1 > 30 AND y0 < 400 AND y1 > 30 AS meets, x0 >= 30 AND y0 >= 30 AND x1 <= 300 AND y1 <= 400 AS inside,
            round(greatest(0, least(x1, 300) - greatest(x0, 30)) * greatest(0, least(y1, 400) - greatest(y0, 30)), 3) AS area,
            CASE WHEN x0 < 300 AND x1 > 30 AND y0 < 400 AND y1 > 30 THEN round(least(x1, 300), 3) END AS cut_x1,
            (x0 + x1) / 2 BETWEEN 30 AND 300 AND (y0 + y1) / 2 BETWEEN 30 AND 400 AS mid FROM {_BOXES}""",
        "rotate_normalise": f"SELECT page_ix, op_ix, (op_ix + 1) % 4 AS quarter, (op_ix * 90 + 180) % 360 AS turned FROM {_IMAGES}",
        "resize_fit": f"""SELECT page_ix, op_ix, round(least(595.28::DOUBLE / w, 841.89::DOUBLE / h), 6) AS fit, round(greatest(595.28::DOUBLE / w, 841.89::DOUBLE / h), 6) AS fill, round(841.89::DOUBLE / h, 6) AS stretch_y
            FROM (SELECT page_ix, op_ix, greatest(x1 - x0, 1) AS w, greatest(y1 - y0, 1) AS h FROM {_BOXES})""",
        "place_anchor": f"SELECT page_ix, op_ix, round(612.0::DOUBLE - (x1 - x0) - 36, 7) AS tr_x, round((792.0::DOUBLE - (y1 - y0)) / 2, 7) AS c_y, 36.0::DOUBLE AS bl_x FROM {_BOXES}",
        "matrix_inverse": f"SELECT page_ix, op_ix, round(w::DOUBLE, 6) AS x, op_ix::DOUBLE AS y FROM {_IMAGES}",
        "permissions": """SELECT event_id, (CASE WHEN event_id % 2 = 0 THEN 4 ELSE 0 END + CASE WHEN event_id % 3 = 0 THEN 16 ELSE 0 END + 4294963392 - 4294967296)::INT AS p,
            event_id % 2 = 0 AS may_print, event_id % 3 = 0 AS may_copy FROM events""",
        "output_names": f"""WITH p AS (SELECT DISTINCT doc_id, page_ix // 2 AS part, (n + 1) // 2 AS total FROM {_PAGES})
            SELECT doc_id, part, 'talk-' || doc_id || '.out' || CASE WHEN total > 1 THEN '-' || (part + 1) ELSE '' END || '.pdf' AS out_name FROM p""",
        "preset_pipeline": f"""WITH r AS (SELECT doc_id, n - 1 - page_ix AS ix, n, text FROM {_PAGES})
            SELECT doc_id, ix // 3 AS part, ix % 3 AS page_ix, CASE WHEN ix % 2 = 0 THEN 90 ELSE 0 END AS rotation, text FROM r WHERE ix < n - 1""",
        "codec_roundtrip": "SELECT doc_id, ((len(string_split(coalesce(text, ''), chr(10))) + 44) // 45)::BIGINT AS n_pages, true AS same, sha256(coalesce(text, '')) AS text_sha256 FROM documents",
        "preset_files": f"""WITH r AS (SELECT doc_id, n - 1 - page_ix AS ix, n, {_SHOWN} AS turn FROM {_PAGES})
            SELECT doc_id, ix // 3 AS part, ix % 3 AS page_ix, turn, (ix + 1) || '/' || (n - 1) AS stamp FROM r WHERE ix < n - 1""",
        "object_types": f"""WITH c AS (SELECT doc_id, max(n) AS n, count(DISTINCT coalesce(text, '')) AS bodies, max({_BEYOND}::INT) AS k FROM {_PAGES} GROUP BY doc_id)
            SELECT doc_id, 'dictionary' AS type, n + 3 + 2 * k AS n FROM c UNION ALL SELECT doc_id, 'stream', bodies + k FROM c""",
        "encrypted_files": "SELECT doc_id, unnest(['rc4', 'aes128', 'aes256']) AS method, true AS encrypted, ((len(string_split(coalesce(text, ''), chr(10))) + 44) // 45)::BIGINT AS n_pages, sha256(coalesce(text, '')) AS text_sha256 FROM documents",
        "damaged_files": "SELECT doc_id, unnest([false, true]) AS compressed, true AS reconstructed, ((len(string_split(coalesce(text, ''), chr(10))) + 44) // 45)::BIGINT AS n_pages, sha256(coalesce(text, '')) AS text_sha256 FROM documents",
        "image_files": """WITH b AS (SELECT doc_id, coalesce(text, '') AS t, octet_length(encode(coalesce(text, ''))) AS n FROM documents), h AS (SELECT *, greatest((n + 63) // 64, 1) AS h FROM b)
            SELECT doc_id, 1::BIGINT AS n_images, 64::BIGINT AS width, h::BIGINT AS height, sha256(t || repeat(' ', (h * 64 - n)::INTEGER)) AS pixels_sha256 FROM h""",
        "redact_files": f"""WITH r AS (SELECT doc_id, page_ix, {_SHOWN.replace("(l,", "(regexp_replace(l, 'the', ' ', 'gi'),")} AS text FROM {_PAGES})
            SELECT doc_id, page_ix, text, {count('lower(text)', 'the')}::BIGINT AS n_left FROM r""",
        "bookmark_files": f"SELECT doc_id, page_ix, CASE WHEN page_ix % 2 = 0 THEN (page_ix // 2)::VARCHAR ELSE (page_ix // 2) || '/0' END AS path, {_SHOWN} AS title FROM {_PAGES}",
        "field_files": f"SELECT doc_id, replace(name, '.', '-') AS field, 'text' AS kind, coalesce(value, '') AS value FROM {_FIELDS}",
        "merge_files": f"SELECT doc_id // 5 AS job, row_number() OVER (PARTITION BY doc_id // 5 ORDER BY doc_id, page_ix) - 1 AS page_ix, {_SHOWN} AS text FROM {_PAGES}",
        "flate_roundtrip": """SELECT doc_id, unnest(['FlateDecode', 'ASCIIHexDecode', 'ASCII85Decode', 'RunLengthDecode', 'ASCII85 of Flate', 'Flate with rows']) AS filter,
            octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes, sha256(coalesce(text, '')) AS text_sha256 FROM documents""",
        "corpus_scan": "SELECT source, count(*) AS docs, sum((length(text) > 20)::INT)::BIGINT AS with_text, sum(length(text))::BIGINT AS chars, max(length(text)) AS longest FROM documents GROUP BY source",
    }


def _typed_lines() -> str:
    return f"""WITH t AS (SELECT doc_id, line_ix AS line_no, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text, round(720 - 14.0::DOUBLE * (line_ix % 45), 2) AS baseline FROM {_LINES})
            SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS line_ix, text, baseline FROM t WHERE text <> ''"""
