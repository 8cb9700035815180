"""Queries do the whole job: results against plain versions on documents beyond the old cuts."""

import hashlib
import re

import pytest

from pagewright.plans import catalogue


@pytest.fixture(scope="module")
def long_docs(spark, tmp_path_factory):
    """A folder with documents of many lines and of long lines."""
    folder = str(tmp_path_factory.mktemp("long"))
    texts = {1: "\n".join(f"line {k} of  many" for k in range(100)), 2: "word " * 300 + "end\n\n \n" + "x" * 700 + " last", 3: "", 4: "é 中文 😀 tail"}
    spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").selectExpr(
        "doc_id", "text", "'en' as lang", "'web' as source", "cast(length(text) as bigint) as n_chars").write.parquet(f"{folder}/documents.parquet")
    return folder, texts


def test_words_of_every_line(spark, long_docs):
    folder, texts = long_docs
    want = sorted((d, n, w, m[0], round(72 + 7.2 * m.start(), 2), round(72 + 7.2 * m.end(), 2))
                  for d, t in texts.items() for n, line in enumerate(t.split("\n")) for w, m in enumerate(re.finditer("[^ ]+", line)))
    assert sorted(tuple(r) for r in catalogue.page_words(spark, folder).collect()) == want


@pytest.mark.parametrize("query", ["lines_from_glyphs", "lines_by_gap"])
def test_lines_of_every_page(spark, long_docs, query):
    folder, texts = long_docs
    want = []
    for d, t in texts.items():
        kept = [(" ".join(line.split()), 720.0 - 14 * (n % 45)) for n, line in enumerate(t.split("\n")) if line.strip()]
        want += [(d, k, line, base) for k, (line, base) in enumerate(kept)]
    assert sorted(tuple(r) for r in getattr(catalogue, query)(spark, folder).collect()) == want


def test_whole_texts_come_back_from_files(spark, long_docs):
    folder, texts = long_docs
    got = {r.doc_id: (r.n_pages, r.same, r.text_sha256) for r in catalogue.codec_roundtrip(spark, folder).collect()}
    pages = {1: 3, 2: 1, 3: 1, 4: 1}
    assert got == {d: (pages[d], True, hashlib.sha256(t.encode()).hexdigest()) for d, t in texts.items()}


AWKWARD = ["tab\there  two  ", "\r x", "(a) \\ b) (", "\x00\x1f\x81\xa0", "", "ﬁ 中 😀 €", "x" * 3000]


@pytest.mark.parametrize("options", [{}, {"compress": False}, {"encryption": {"method": "aes256", "user": ""}}, {"encryption": {"method": "rc4", "user": ""}}])
def test_every_character_comes_back(options):
    from pagewright.sources import documents

    file = documents.container.load(documents._written([{"text": "\n".join(AWKWARD)}], options))
    pages, lines = documents.read_back(file, 45)
    assert pages == 1 and lines[: len(AWKWARD)] == AWKWARD and not any(lines[len(AWKWARD) :])


def test_a_lost_character_is_noticed(spark, monkeypatch):
    import pyarrow as pa

    from pagewright.sources import documents

    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["one 中 two\n\n" + "x" * 100, None]})
    assert next(documents._trip_kernel(45, {})([batch])).column("same").to_pylist() == [True, True]
    write = documents._written
    monkeypatch.setattr(documents, "_written", lambda rows, options: write([{"text": r["text"].replace("中", "?")} for r in rows], options))
    assert next(documents._trip_kernel(45, {})([batch])).column("same").to_pylist() == [False, True]


def test_files_hold_the_text_of_turns(spark, tmp_path):
    turns = [(1, k, f"Turn {k} says 3/4\n" + "long " * 50 + "\n" * 21 + "é 中 😀") for k in range(5)]
    spark.createDataFrame([(c, k, "user", t) for c, k, t in turns], "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    shown = {k: "\n".join(" ".join(line.split()) for line in t.split("\n") if line) for _, k, t in turns}
    got = sorted((r.part, r.page_ix, r.turn, r.stamp) for r in catalogue.preset_files(spark, str(tmp_path)).collect())
    assert got == [(ix // 3, ix % 3, shown[4 - ix], f"{ix + 1}/4") for ix in range(4)]
    assert {r.type: r.n for r in catalogue.object_types(spark, str(tmp_path)).collect()} == {"dictionary": 5 + 3 + 2, "stream": 5 + 1}


def test_whole_texts_are_folded_measured_and_titled(spark, long_docs, tmp_path):
    folder, texts = long_docs
    tail = "a" * 300 + " “late”"
    spark.createDataFrame([(1, tail)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert catalogue.fold_text(spark, str(tmp_path)).first().folded == '"' + "a" * 300 + ' "late"" - fin'
    wide = {"i": 222, "l": 222, "m": 833, "w": 722, " ": 278}
    want = {(d, n): sum(wide.get(c, 556) for c in line) * 12 / 1000 for d, t in texts.items() for n, line in enumerate(t.split("\n"))}
    got = {(r.doc_id, r.line_ix): r.width for r in catalogue.measure_text(spark, folder).collect()}
    assert got == pytest.approx(want, abs=1e-3)
    spark.createDataFrame([(1, k, "user", f"{k} " + tail) for k in range(4)], "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert sorted((r.page_ix, r.title) for r in catalogue.shift_bookmarks(spark, str(tmp_path)).collect()) == [(p, f"{k} " + tail) for p, k in ((0, 0), (1, 1), (5, 2), (6, 3))]


def test_all_orders_and_line_items_lead_on(spark, sf_dir):
    rows = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet").collect()
    edges: dict[str, set[str]] = {}
    for r in rows("lineitem"):
        edges.setdefault(f"lineitem:{r.l_orderkey}/{r.l_linenumber}", set()).update((f"order:{r.l_orderkey}", f"part:{r.l_partkey}", f"supplier:{r.l_suppkey}"))
    for name, kind, key, to, far in (("orders", "order", "o_orderkey", "customer", "o_custkey"), ("customer", "customer", "c_custkey", "nation", "c_nationkey"),
                                     ("supplier", "supplier", "s_suppkey", "nation", "s_nationkey"), ("nation", "nation", "n_nationkey", "region", "n_regionkey")):
        for r in rows(name):
            edges.setdefault(f"{kind}:{r[key]}", set()).add(f"{to}:{r[far]}")
    found = {n: 0 for n in edges if n.startswith("lineitem:")} | {f"order:{r.o_orderkey}": 0 for r in rows("orders")}
    frontier, depth = set(found), 0
    while frontier:
        depth += 1
        frontier = {t for n in frontier for t in edges.get(n, ())} - set(found)
        found |= dict.fromkeys(frontier, depth)
    assert {r.node: r.depth for r in catalogue.reachable(spark, sf_dir).collect()} == found
    assert any(n.startswith("part:") for n in found)
