"""Presets over files, fonts, and the commands."""

import json
import struct

import pytest

from pagewright.operators.layout import _lines_of
from pagewright.plans.presets import Preset, PresetError, builtins
from pagewright.sources import batch, documents
from pagewright.sources.codec import container, content, fonts, images

import numpy as np


def make(n, title="T"):
    file = container.new_file({"title": title})
    font = file.add(content.standard_font())
    for k in range(n):
        container.add_page(file, content.text_content([f"{title}{k}"], size=40), {"Font": {"F1": font}})
    return container.save(file)


def texts(data, password=""):
    file = container.load(data, password)
    return [" ".join(line["text"] for line in _lines_of(content.page_content(file, p)[0])) for _, p in file.pages()]


def run(steps, n=5, **options):
    return batch.run_files(Preset("p", steps, **options), [("dir/a.b.pdf", make(n), "")], {"logo": images.encode_png(np.zeros((2, 2, 3), np.uint8))})


@pytest.mark.parametrize("steps,want", [
    ([{"op": "select-pages", "pages": "3-1,2,last"}], ["T2", "T1", "T0", "T1", "T4"]), ([{"op": "delete-pages", "pages": "2,last"}], ["T0", "T2", "T3"]), ([{"op": "reverse"}], ["T4", "T3", "T2", "T1", "T0"]),
    ([{"op": "blank-pages", "at": 2, "count": 2}], ["T0", "", "", "T1", "T2", "T3", "T4"]), ([{"op": "blank-pages"}], ["T0", "T1", "T2", "T3", "T4", ""]),
    ([{"op": "delete-pages", "pages": "1"}, {"op": "page-numbers", "format": "n{page:2}/{pages}", "pages": "last"}], ["T1", "T2", "T3", "T4 n01/1"]),
    ([{"op": "nup", "per_sheet": 2}], ["T0 T1", "T2 T3", "T4"]), ([{"op": "booklet"}], ["T0", "T1", "T2", "T4 T3"]),
    ([{"op": "resize", "size": "a5"}, {"op": "scale", "factor": 2}, {"op": "rotate", "degrees": -90}, {"op": "flatten"}, {"op": "compress-images"}], ["T0", "T1", "T2", "T3", "T4"]),
    ([{"op": "stamp-image", "asset": "logo", "width": 50}], ["T0", "T1", "T2", "T3", "T4"])])
def test_steps_on_files(steps, want):
    assert [sorted(t.split()) for t in texts(run(steps)[0]["data"])] == [sorted(t.split()) for t in want]


def test_boxes_and_rotations_after_steps():
    file = container.load(run([{"op": "rotate", "degrees": 90, "pages": "1"}, {"op": "resize", "size": "a4"}])[0]["data"])
    boxes = [([round(v, 2) for v in p["MediaBox"]], p.get("Rotate", 0)) for _, p in file.pages()][:2]
    assert boxes == [([0, 0, 841.89, 595.28], 90), ([0, 0, 595.28, 841.89], 0)]


def test_outputs_and_names():
    parts = run([{"op": "split", "every": 2}])
    assert [(o["out_name"], o["pages"]) for o in parts] == [("a.b-1.pdf", 2), ("a.b-2.pdf", 2), ("a.b-3.pdf", 1)]
    named = run([{"op": "split", "ranges": ["2,1", "last"]}], output={**Preset().output, "filename": "{n}of{total}-{stem}.pdf"})
    assert [o["out_name"] for o in named] == ["1of2-a.b.pdf", "2of2-a.b.pdf"] and texts(named[0]["data"]) == ["T1", "T0"]
    merged = batch.run_files(builtins()["merge"], [("x.pdf", make(1, "X"), ""), ("y.pdf", make(2, "Y"), "")], {})
    assert merged[0]["out_name"] == "x-merged.pdf" and texts(merged[0]["data"]) == ["X0", "Y0", "Y1"] and merged[0]["sources"] == ["x.pdf", "y.pdf"]
    locked = batch.run_files(Preset("e", output={**Preset().output, "encryption": {"method": "aes128", "userPassword": "u"}}), [("x.pdf", make(1), "")], {})
    assert container.load(locked[0]["data"], "u").encrypted
    with pytest.raises(ValueError, match="bad.pdf"):
        batch.run_files(Preset(), [("bad.pdf", b"junk", "")], {})
    with pytest.raises(PresetError):
        run([{"op": "stamp-image", "asset": "none"}])


def test_metadata_steps():
    file = container.load(run([{"op": "strip-metadata"}, {"op": "metadata", "title": "é", "author": ""}])[0]["data"])
    assert file.metadata()["title"] == "é" and file.metadata()["author"] is None


def test_presets_over_a_table(spark, tmp_path, capsys):
    rows = spark.createDataFrame([("a.pdf", make(3, "A"), "j"), ("b.pdf", make(2, "B"), "j")], "name string, data binary, job string")
    out = {r.out_name: r.pages for r in batch.run(Preset("p", [{"op": "split", "every": 2}]), rows).collect()}
    assert out == {"a-1.pdf": 2, "a-2.pdf": 1, "b.pdf": 2}
    assert [r.pages for r in batch.run(builtins()["merge"], rows).collect()] == [5]
    assert documents.pages(batch.run(Preset("p", [{"op": "reverse"}]), rows).selectExpr("out_name as name", "data")).where("page_ix = 0").count() == 2
    from pagewright.__main__ import main

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.pdf").write_bytes(make(2, "Find"))
    main(["search", str(folder), "find1", "-i", "--word"])
    assert json.loads(capsys.readouterr().out.splitlines()[-1]) == {"name": "a.pdf", "page_ix": 1, "n_matches": 1}
    main(["run", str(folder), "split-single-pages", str(tmp_path / "out")])
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a-1.pdf", "a-2.pdf"]


def test_commands_over_a_folder(spark, tmp_path, capsys):
    from pagewright.__main__ import main
    from pagewright.sources.codec import edit, images

    folder, k = tmp_path / "in", iter(range(100))
    folder.mkdir()
    file = container.load(make(3, "Word"))
    edit.add_field(file, 0, "who", (72, 300, 200, 320))
    edit.add_annotation(file, 1, "Square", (10, 10, 50, 50), "note")
    (folder / "a.pdf").write_bytes(container.save(file))
    (folder / "b.pdf").write_bytes(make(2, "Other"))

    def run(command, *more, source=folder, password=None):
        out = tmp_path / f"out{next(k)}"
        main([command, str(source), str(out), *more, *(["--password", password] if password else [])])
        return {p.name: p.read_bytes() for p in sorted(out.iterdir())}, out

    def rows(command, source, *more):
        capsys.readouterr()
        main([command, str(source), *more])
        return [json.loads(line) for line in capsys.readouterr().out.splitlines()]

    opened = lambda made, name="a.pdf", password="": container.load(made[name], password)
    made, out = run("fill", "--set", "who=Ada", "--set", "nobody=x")
    assert [(r["field"], r["value"]) for r in rows("fields", out)] == [("who", "Ada")]
    assert edit.fields(opened(run("fill", "--set", "who=Ada", "--flatten")[0])) == []
    assert [(r["page_ix"], r["contents"]) for r in rows("annots", folder) if r["subtype"] == "Square"] == [(1, "note")]
    tree = tmp_path / "tree.json"
    tree.write_text(json.dumps([{"path": [0], "title": "é", "page": 1}]))
    made, out = run("set-bookmarks", str(tree))
    assert [(r["title"], r["page_ix"]) for r in rows("bookmarks", out) if r["name"] == "a.pdf"] == [("é", 1)]
    assert rows("bookmarks", run("set-bookmarks", source=out)[1]) == []
    made, out = run("redact", "--text", "word", "-i", "--pages", "1-2", "--area", "3:0,0,612,792")
    assert [r["page_ix"] for r in rows("search", out, "word", "-i")] == [] and b"".join(t.encode() for t in texts(made["b.pdf"]))
    with pytest.raises(SystemExit):
        run("redact")
    assert [len(opened(run(*args)[0]).pages()) for args in (("pages", "1,last"), ("delete", "1"), ("reverse",), ("blank", "--at", "1", "--count", "2"), ("nup",), ("booklet",), ("rotate", "90"), ("stamp", "hi"), ("numbers",))] == [2, 2, 3, 5, 2, 2, 3, 3, 3]
    assert sorted(run("split", "--every", "1")[0]) == ["a-1.pdf", "a-2.pdf", "a-3.pdf", "b-1.pdf", "b-2.pdf"]
    assert len(opened(run("merge")[0], "a-merged.pdf").pages()) == 5
    assert opened(run("meta", "--title", "T")[0]).metadata()["title"] == "T"
    assert opened(run("crop", "10,20,100,200")[0]).pages()[0][1]["CropBox"] == [10, 20, 110, 220]
    assert edit.page_at(opened(run("resize", "--size", "a5")[0]), 0)["MediaBox"][2] < 430
    made, out = run("encrypt", "--user", "pw", "--owner", "o", "--deny", "print")
    locked = opened(made, password="pw")
    assert locked.encrypted and locked.permissions & 4 == 0 and not opened(run("decrypt", source=out, password="pw")[0]).encrypted
    (folder / "p.png").write_bytes(images.encode_png(np.full((4, 6, 3), 9, np.uint8)))
    made, out = run("images", "--dpi", "72")
    assert list(made) == ["p.pdf"] and [n.endswith(".png") for n in run("extract-images", source=out)[0]] == [True]
    capsys.readouterr()
    main(["presets"])
    assert "split-single-pages" in capsys.readouterr().out
    main(["presets", str(tmp_path / "all.json")])
    assert "merge" in json.loads((tmp_path / "all.json").read_text())


def tiny_font():
    """Three glyphs: none, A (a box) and Á (made of A)."""
    box = struct.pack(">hhhhh", 1, 0, 0, 500, 700) + struct.pack(">HH", 3, 0) + bytes([1] * 4) + struct.pack(">hhhh", 0, 500, 0, -500) + struct.pack(">hhhh", 0, 0, 700, 0)
    box += b"\0" * (-len(box) % 4)
    made = struct.pack(">hhhhh", -1, 0, 0, 500, 700) + struct.pack(">HHbb", 0x0002, 1, 0, 0)
    made += b"\0" * (-len(made) % 4)
    spots = [0, 0, len(box), len(box) + len(made)]
    sub = struct.pack(">HHHHHHH", 4, 40, 0, 6, 4, 1, 2) + struct.pack(">HHH", 65, 193, 0xFFFF) + b"\0\0" + struct.pack(">HHH", 65, 193, 0xFFFF) + struct.pack(">HHH", 1 - 65 & 0xFFFF, 2 - 193 & 0xFFFF, 1) + struct.pack(">HHH", 0, 0, 0)
    head = bytearray(54)
    struct.pack_into(">H", head, 18, 1000)
    struct.pack_into(">h", head, 50, 1)
    hhea = bytearray(36)
    struct.pack_into(">hh", hhea, 4, 800, -200)
    struct.pack_into(">H", hhea, 34, 3)
    return fonts._assemble({"head": bytes(head), "hhea": bytes(hhea), "maxp": struct.pack(">IH", 0x10000, 3), "hmtx": struct.pack(">HhHhHh", 300, 0, 600, 0, 650, 0),
                            "cmap": struct.pack(">HHHHI", 0, 1, 3, 1, 12) + sub, "glyf": box + made, "loca": struct.pack(">4I", *spots)})


def test_fonts():
    font = fonts.TrueType(tiny_font())
    assert font.glyph("A") == 1 and font.glyph("Á") == 2 and font.glyph("z") == 0 and font.advance(2) == 650
    assert font.parts(2) == [1] and font.closure({2}) == {0, 1, 2}
    small = fonts.TrueType.__new__(fonts.TrueType)
    data = font.subset({2})
    assert data[:4] == b"\0\1\0\0" and small is not None
    file = container.new_file()
    ref, shown = fonts.embed(file, font, "AÁA")
    container.add_page(file, b"BT /F1 10 Tf 10 10 Td <" + shown.hex().encode() + b"> Tj ET", {"Font": {"F1": ref}})
    again = container.load(container.save(file))
    glyphs = content.page_content(again, again.pages()[0][1])[0]
    assert "".join(g["text"] for g in glyphs) == "AÁA" and [round(g["x0"], 1) for g in glyphs] == [10, 16, 22.5]
    with pytest.raises(fonts.FontProblem):
        fonts.TrueType(b"no font at all, just words")
    assert [fonts.glyph_text(n) for n in ("A", "eacute", "Scaron", "uni20AC", "u1F600", "comma", "fi", "nosuch", "a.alt")] == ["A", "é", "Š", "€", "😀", ",", "ﬁ", None, "a"]
    assert fonts.standard_name("Arial Bold Italic") == "Helvetica-BoldOblique" and fonts.standard_name("times") == "Times-Roman" and fonts.standard_name("Wingdings") is None
    assert fonts.encoding("WinAnsiEncoding", 0x80) == "€" and fonts.encoding("MacRomanEncoding", 0x8E) == "é"


def test_encodings_and_advances_of_standard_fonts():
    from pagewright.sources.codec import metrics
    from pagewright.sources.codec.values import Name

    assert [fonts.encoding("StandardEncoding", c) for c in (0x27, 0x60, 0x41, 0xA4, 0xA9, 0xAE, 0xB0, 0xD0, 0xE1, 0xFB, 0xFF)] == ["’", "‘", "A", "⁄", "'", "ﬁ", None, "—", "Æ", "ß", None]
    assert [fonts.encoding("Symbol", c) for c in (0x22, 0x61, 0x7E, 0xA3, 0xA5, 0xAA, 0xB3, 0xD6, 0xF2, 0xFF)] == ["∀", "α", "∼", "≤", "∞", None, "≥", "√", "∫", None]
    known = {("A", "Times-Roman"): 722, ("é", "Times-Roman"): 444, ("–", "Helvetica"): 556, ("Ž", "Helvetica"): 611, ("m", "Courier-Bold"): 600, ("W", "Helvetica-BoldOblique"): 944, ("¦", "Times-Bold"): 220, ("w", "ABCDEF+Arial"): 722}
    assert {k: metrics.advance(*k) for k in known} == known

    def shown(font, data):
        file = container.new_file()
        container.add_page(file, b"BT /F1 10 Tf 10 10 Td <" + data.hex().encode() + b"> Tj ET", {"Font": {"F1": file.add({"Type": Name("Font"), **font})}})
        file = container.load(container.save(file))
        return "".join(g["text"] for g in content.page_content(file, file.pages()[0][1])[0])

    assert shown({"Subtype": Name("Type1"), "BaseFont": Name("Symbol")}, b"ab\xa5") == "αβ∞"
    assert shown({"Subtype": Name("Type1"), "BaseFont": Name("Times-Roman")}, b"a'\xae") == "a’ﬁ"
    assert shown({"Subtype": Name("TrueType"), "BaseFont": Name("Any")}, b"a'\x80") == "a'€"
    assert shown({"Subtype": Name("Type1"), "BaseFont": Name("X"), "Encoding": {"BaseEncoding": Name("MacRomanEncoding"), "Differences": [65, Name("eacute"), Name("nosuch"), 67, Name("uni4E2D")]}}, b"ABCD\x8e") == "é中Dé"
