"""Functions and operators of the page model against hand-made cases."""

import pytest
from pyspark.sql import functions as F

from pagewright.functions import geometry as G, ranges, strings as S
from pagewright.operators import graph, items, layout, pages as P
from pagewright.plans import presets


@pytest.mark.parametrize("spec,count,want", [
    ("1-3,7", 10, [0, 1, 2, 6]), ("8-", 10, [7, 8, 9]), ("-2", 10, [0, 1]), ("even", 5, [1, 3]), ("odd", 5, [0, 2, 4]), ("last, first, r2", 5, [4, 0, 3]),
    ("3-1", 5, [2, 1, 0]), ("3-r1", 5, [2, 3, 4]), ("all,*", 2, [0, 1, 0, 1]), ("", 3, []), (" , ", 3, []), ("nonsense", 0, []), ("even", 1, []), ("2,2", 3, [1, 1])])
def test_ranges(spark, spec, count, want):
    assert ranges.parse(spec, count) == want
    if spec != "nonsense":
        assert spark.range(1).select(ranges.expand(spec, F.lit(count)).alias("p")).first().p == want


@pytest.mark.parametrize("spec", ["0", "6", "x", "r0", "r6", "r2-r4", "1--2"])
def test_wrong_ranges(spark, spec):
    with pytest.raises(ranges.RangeError):
        ranges.parse(spec, 5)
    with pytest.raises(Exception):
        spark.range(1).select(ranges.expand(spec, F.lit(5))).collect()


def test_ranges_that_skip_what_is_not_there(spark):
    assert spark.range(1).select(ranges.expand("5,1,2-9,last", F.lit(3), strict=False).alias("p")).first().p == [0, 2]


@pytest.fixture(scope="module")
def book(spark):
    return spark.createDataFrame([(1, k, f"p{k}") for k in range(5)] + [(2, 0, "q0")], "doc_id bigint, page_ix int, text string")


def shown(df, doc=1):
    return [r.text for r in df.where(F.col("doc_id") == doc).orderBy("page_ix").collect()]


def test_page_edits(book):
    assert shown(P.select(book.where("doc_id = 1"), "3-1,2,last")) == ["p2", "p1", "p0", "p1", "p4"]
    assert shown(P.extract(book.where("doc_id = 1"), "2,1,2")) == ["p1", "p0"]
    assert shown(P.delete(book, "2,last", strict=False)) == ["p0", "p2", "p3"]
    assert shown(P.reverse(book)) == ["p4", "p3", "p2", "p1", "p0"]
    assert shown(P.move(book, 0, 2)) == ["p1", "p2", "p0", "p3", "p4"] and shown(P.move(book, 3, 1)) == ["p0", "p3", "p1", "p2", "p4"]
    assert shown(P.move(book, 0, 2), 2) == ["q0"]
    assert shown(P.insert_blank(book, 1, 2)) == ["p0", None, None, "p1", "p2", "p3", "p4"]
    assert shown(P.insert_blank(book, 99), 2) == ["q0", None]
    assert P.split_every(book, 2).select("part").distinct().count() == 3
    assert [r.text for r in P.merge(book, F.lit(9)).orderBy("page_ix").collect()] == ["p0", "p1", "p2", "p3", "p4", "q0"]
    with pytest.raises(Exception):
        P.delete(book, "2").collect()


def test_numbers_booklets_and_specs(spark, book):
    labels = P.numbered(book.where("doc_id = 1"), "A{page:3}/{pages} {nope} {page", 5, "2-3").orderBy("page_ix").collect()
    assert [r.label for r in labels] == [None, "A005/6 {nope} {page", "A006/6 {nope} {page", None, None]
    sides = P.booklet(book).where("doc_id = 1").orderBy("sheet", "slot").collect()
    assert [r.page_ix for r in sides] == [None, 0, 1, None, None, 2, 3, 4]
    cells = P.nup(book, 4, 800.0, 600.0).where("doc_id = 1 and page_ix = 2").first().cell
    assert (cells.x0, cells.y0, cells.x1, cells.y1) == (0, 0, 400, 300)
    odd = spark.createDataFrame([(1, k) for k in (0, 1, 2, 5, 7, 8, 8, 12)], "doc_id bigint, page_ix int")
    assert P.to_spec(odd).first().spec == "1-3, 6, 8, 9, 13"


def test_geometry(spark):
    box = G.rect(F.lit(10.0), F.lit(20.0), F.lit(0.0), F.lit(5.0))
    row = spark.range(1).select(
        box.alias("r"), G.place("top-right", 100.0, 50.0, 10.0, 5.0, 2.0).alias("tr"), G.place("center", 100.0, 50.0, 10.0, 6.0, 2.0).alias("c"),
        G.intersection(box, G.translate(box, 10.0, 0.0)).alias("touch"), G.intersects(box, G.translate(box, 9.0, 0.0)).alias("meet"),
        G.invert(G.matrix(1, 2, 2, 4, 0, 0)).alias("flat"), G.transform(box, G.rotation(F.lit(90.0))).alias("turned"),
        G.apply(G.display_to_user(box, F.lit(90)), G.apply(G.user_to_display(box, F.lit(90)), G.point(F.lit(3.0), F.lit(7.0)))).alias("back"),
        G.quarter_turn(F.lit(-90)).alias("q"), G.turned(F.lit(270), 180).alias("t"), G.permission_bits(print=True).alias("p"), G.permission_bits().alias("none")).first()
    assert tuple(row.r) == (0, 5, 10, 20) and tuple(row.tr) == (88, 43) and tuple(row.c) == (45, 22)
    assert row.touch is None and row.meet and row.flat is None and row.q == 3 and row.t == 90
    assert [round(v, 6) for v in row.turned] == [-20, 0, -5, 10] and tuple(row.back) == (3, 7)
    assert row.p - row.none == 4 and row.none == -3904
    assert G.page_size("A4-landscape")[0] > G.page_size("a4")[0]
    with pytest.raises(ValueError):
        G.page_size("a99")


def test_strings(spark):
    rows = [("“ﬁne” – co‑op x",), ("the cat; THE_cat the",), (None,), ("/a/b.c.pdf",), (".hidden",)]
    df = spark.createDataFrame(rows, "t string")
    got = df.select(S.fold("t" if False else F.col("t")).alias("f"), S.count_matches(F.col("t"), "the", whole_word=True).alias("n"), S.stem(F.col("t")).alias("s"), S.fold_exactly("t").alias("x")).collect()
    assert got[0].f == '"fine" - co‑op x' == got[0].x
    assert got[1].n == 2 and got[2].n == 0
    assert got[3].s == "b.c" and got[4].s == ".hidden"
    assert S.wrap_lines("aa bb cccccc d", 4, lambda c: 1) == ["aa", "bb", "cccc", "cc d"]
    assert S.diff_words("a b c", "a x c") == [("same", "a "), ("delete", "b"), ("insert", "x"), ("same", " c")]
    coded = spark.createDataFrame([("plain",), ("é€",)], "t string").select("t", S.from_document_bytes(S.to_document_bytes(F.col("t"))).alias("b")).collect()
    assert all(r.t == r.b for r in coded)


def test_sizes_round_halves_to_even(spark):
    """Labels of sizes are those of C's and Python's formats, ties and missing values too."""
    def label(n):
        return None if n is None else f"{n} B" if n < 1 << 10 else f"{n / (1 << 10):.1f} KB" if n < 1 << 20 else f"{n / (1 << 20):.1f} MB"

    sizes = [None, 0, 1, 1023, 1024, 1279, 1280, 1281, 1792, 211200, 364800, 1048524, 1048525, 1048575, 1048576, 1310719, 1310720, 1835008, 3 << 18, 1 << 40, (1 << 40) + (1 << 18), *range(1000, 1100000, 64)]
    got = spark.createDataFrame([(n,) for n in sizes], "n bigint").select("n", S.human(F.col("n")).alias("s")).collect()
    assert [r.s for r in got] == [label(r.n) for r in got]


def test_name_stems_of_missing_values(spark, tmp_path):
    from pagewright.plans import catalogue

    rows = [(1, "a", None, "src", 704), (2, "a", "en", None, 1216), (3, "a", "yes", "src", None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in catalogue.queries()["name_stems"](spark, str(tmp_path)).collect())
    assert got == [(1, "src.1", "206.2 KB", False), (2, None, "356.2 KB", False), (3, "src.3", None, True)]


def test_lines_follow_the_mean_baseline(spark):
    def glyph(text, x, y, size=10.0):
        return (1, 0, text, x, y - 2, x + 5, y + 9, y, size)

    rows = [glyph("a", 0.0, 100.0), glyph("b", 5.0, 102.0), glyph("c", 14.0, 104.0), glyph("d", 19.0, 106.5), glyph("e", 0.0, 90.0)]
    df = spark.createDataFrame(rows, "doc_id bigint, page_ix int, text string, x0 double, y0 double, x1 double, y1 double, baseline double, size double")
    text = [r.text for r in layout.lines(df).orderBy("line_ix").collect()]
    assert sorted("".join(text).replace(" ", "")) == list("abcde") and text[-1] == "e"


def test_hits_count_centres_and_quarters(spark):
    glyphs = spark.createDataFrame([(1, 0, "a", 0.0, 0.0, 10.0, 10.0), (1, 0, "b", 100.0, 0.0, 110.0, 10.0), (2, 0, "c", 0.0, 0.0, 10.0, 10.0)], "doc_id bigint, page_ix int, text string, x0 double, y0 double, x1 double, y1 double")
    areas = spark.createDataFrame([(1, 0, -50.0, -50.0, 2.6, 50.0), (1, 0, 104.0, 4.0, 300.0, 300.0)], "doc_id bigint, page_ix int, x0 double, y0 double, x1 double, y1 double")
    assert sorted(r.text for r in layout.hit_glyphs(glyphs, areas, margin=0.0).collect()) == ["a", "b"]
    assert [r.text for r in layout.hit_glyphs(glyphs, areas.limit(1), margin=-0.2).collect()] == []


def test_graph(spark):
    refs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "src string, dst string")
    got = {r.node: r.depth for r in graph.reachable(refs, spark.createDataFrame([("a",)], "node string")).collect()}
    assert got == {"a": 0, "b": 1, "c": 2}
    nodes = spark.createDataFrame([(1, None, 90), (2, 1, None), (3, 2, None), (4, 3, 180), (5, None, None), (6, 6, None)], "num bigint, parent bigint, rot int")
    assert {r.num: r.rot for r in graph.inherit(nodes, "rot").collect()} == {1: 90, 2: 90, 3: 90, 4: 180, 5: None, 6: None}
    objects = spark.createDataFrame([(1, "font"), (2, "font"), (3, "page"), (4, "page"), (5, "page")], "num bigint, content string")
    links = spark.createDataFrame([(3, 0, 1), (4, 0, 2), (5, 0, 5)], "src bigint, slot int, dst bigint")
    assert {r.num: r.canonical for r in graph.dedupe(objects, links).collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}
    tree = spark.createDataFrame([(1, None, False), (2, 1, False), (3, 2, True), (4, 1, True)], "num bigint, parent bigint, is_leaf boolean")
    assert sorted(r.num for r in graph.prune(tree, spark.createDataFrame([(3,)], "num bigint")).collect()) == [1, 4]


def test_fields_and_bookmarks(spark):
    fields = spark.createDataFrame([(1, 1, "a.name", "x"), (1, 2, "b.name", "y"), (1, 3, "c", "z")], "doc_id bigint, num bigint, name string, value string")
    values = spark.createDataFrame([(1, "b.name", "B"), (1, "name", "A"), (1, "none", "N")], "doc_id bigint, name string, value string")
    patched, missed = items.set_fields(fields, values)
    assert {r.num: r.value for r in patched.collect()} == {1: "A", 2: "B", 3: "z"} and [r.name for r in missed.collect()] == ["none"]
    clash = spark.createDataFrame([(1, 1, "t"), (1, 2, "t"), (1, 3, "t"), (1, 4, "u")], "doc_id bigint, num bigint, name string")
    assert {r.num: r.name for r in items.unclashed(clash).collect()} == {1: "t", 2: "t-2", 3: "t-3", 4: "u"}
    names = items.qualified_names(spark.createDataFrame([(1, None, "form"), (2, 1, None), (3, 2, "box")], "num bigint, parent bigint, title string"))
    assert {r.num: r.name for r in names.collect()} == {1: "form", 2: "form", 3: "form.box"}
    marks = spark.createDataFrame([(1, [0], "A", 0, False), (1, [0, 0], "B", 1, True), (1, [0, 0, 0], "C", 2, True), (1, [1], "D", 3, True)], "doc_id bigint, path array<int>, title string, page_ix int, open boolean")
    assert {tuple(r.path): r["count"] for r in items.visible_counts(marks).collect()} == {(0,): -2, (0, 0): 1, (0, 0, 0): 0, (1,): 0}
    kept = spark.createDataFrame([(1, 0, 4), (1, 2, 1), (1, 2, 3)], "doc_id bigint, page_ix int, new_ix int")
    assert {r.title: (r.depth, r.page_ix) for r in items.carried_bookmarks(marks, kept).collect()} == {"A": (0, 4), "C": (1, 1)}
    docs = spark.createDataFrame([("old", "me")], "title string, author string")
    assert tuple(items.patch_metadata(docs, {"title": "", "author": None, "subject": "s"}).first()) == (None, "me", "s")


def test_presets(book):
    made = presets.Preset.from_json('{"schema":1,"name":"n","extra":1,"steps":[{"op":"nup","perSheet":2,"sheet":"a4"}]}')
    assert made.steps[0]["per_sheet"] == 2 and presets.Preset.from_json(made.to_json()) == made
    for text in ('{"schema":2}', '{"name":" "}', '{"steps":[{"op":"rotate","degrees":45}]}', '{"steps":[{"op":"split","every":1},{"op":"reverse"}]}', '{"steps":[{"op":"fly"}]}',
                 '{"output":{"compressionLevel":11}}', '{"steps":[{"op":"stamp-text","text":""}]}', '{"steps":[{"op":"scale","factor":0}]}', "junk"):
        with pytest.raises(presets.PresetError):
            presets.Preset.from_json(text)
    steps = [{"op": "reverse"}, {"op": "blank-pages", "at": 1}, {"op": "page-numbers", "format": "{page}"}, {"op": "stamp-text", "text": "{page}/{pages}", "pages": "last"}, {"op": "rotate", "pages": "1", "degrees": 90},
             {"op": "resize", "size": "a5"}, {"op": "metadata", "title": "T"}, {"op": "strip-metadata"}, {"op": "select-pages", "pages": "all"}, {"op": "flatten"}, {"op": "compress-images"}]
    out = presets.run(presets.Preset("p", steps), book).where("doc_id = 1").orderBy("page_ix").collect()
    assert [r.text for r in out] == [None, "p4", "p3", "p2", "p1", "p0"] and out[0].rotation == 90 and out[1].rotation == 0
    assert out[-1].marks[:2] == ["number:6", "text:6/6"] and round(out[2].media_box.x1, 2) == 419.53
    merged = presets.run(presets.Preset("m", [{"op": "booklet"}], mode="merge"), book).collect()
    assert {r.doc_id for r in merged} == {1} and len(merged) == 4
    store = presets.Store(presets.builtins())
    assert presets.Store.from_json(store.to_json()).names() == sorted(presets.builtins())


def test_lines_by_levels_are_lines_by_glyphs():
    import random

    import numpy as np

    from pagewright.operators.layout import _level_lines, _lines_of

    rng = random.Random(6)
    for _ in range(200):
        rows = []
        for _ in range(rng.randint(1, 60)):
            x, size = rng.choice([rng.randint(0, 30) * 6.0, rng.random() * 200]), rng.choice([8.0, 12.0, 20.0])
            base = rng.choice([100.0, 103.0, 96.0, 90.0, 86.0, 70.0])
            rows.append({"text": rng.choice(["a", "b", " ", "\t", "fi", "c "]), "x0": x, "x1": x + 6.0, "y0": base - 2, "y1": base + 9, "baseline": base, "size": size, "space_width": rng.choice([0.0, 4.0])})
        columns = [np.array([r[c] for r in rows]) for c in ("x0", "y0", "x1", "y1", "baseline", "size", "space_width")]
        assert _level_lines([r["text"] for r in rows], *columns) == _lines_of(rows)


def test_words_and_hits_of_runs_are_those_of_their_characters(spark):
    from pyspark.sql import functions as F

    from pagewright.operators import layout

    lines = [(1, 0, 0, "two  words "), (1, 0, 1, ""), (1, 1, 2, " lead é 😀x"), (2, 0, 0, "a")]
    runs = spark.createDataFrame([(d, p, n, t, 10.0, 100.0 - 14 * n, 112.0 - 14 * n, 6.0) for d, p, n, t in lines], "doc_id bigint, page_ix int, line_no int, text string, x0 double, y0 double, y1 double, advance double")
    glyphs = runs.select("*", F.posexplode(F.split("text", "")).alias("col", "c")).where("c <> ''").select(
        "doc_id", "page_ix", "line_no", "col", F.col("c").alias("text"), (F.col("x0") + F.col("advance") * F.col("col")).alias("x0"), "y0", (F.col("x0") + F.col("advance") * (F.col("col") + 1)).alias("x1"), "y1")
    key = lambda df: sorted(tuple(r[c] for c in ("doc_id", "page_ix", "line_no", "word_ix", "text", "x0", "x1", "y0", "y1")) for r in df.collect())
    assert key(layout.run_words(runs)) == key(layout.words(glyphs))
    areas = spark.createDataFrame([(1, 0, 14.0, 90.0, 31.0, 104.0), (1, 0, 0.0, 0.0, 12.0, 300.0), (1, 1, 11.0, 60.0, 20.0, 75.0), (2, 0, 500.0, 0.0, 600.0, 300.0)], "doc_id bigint, page_ix int, x0 double, y0 double, x1 double, y1 double")
    spot = lambda df: sorted((r.doc_id, r.page_ix, r.line_no, r.col) for r in df.collect())
    hits = spot(layout.run_hits(runs, areas))
    assert hits == spot(layout.hit_glyphs(glyphs, areas)) and hits
