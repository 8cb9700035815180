"""Form fields through a save and a load: looks, kinds, choices, removal."""

import numpy as np
import pytest

from pagewright.operators.layout import _lines_of
from pagewright.sources.codec import container, content, edit, forms, images
from pagewright.sources.codec.values import Name


def sample():
    file = container.new_file({})
    container.add_page(file, b"", {})
    return file


def again(file):
    return container.load(container.save(file))


def look(file, name):
    """(text, x, y, size) of the characters of a field's first widget."""
    file = again(file)
    field = next(f for f in edit.fields(file) if f["name"] == name)
    form = file.resolve(edit.normal_appearance(file, file.resolve(field["widgets"][0])))
    glyphs, _ = content.page_content(file, {"Contents": container.Ref(0), "Resources": {"XObject": {"X": form}}} | {"Contents": content.Stream({}, b"/X Do")})
    return [(g["text"], g["x0"], g["baseline"], g["size"]) for g in glyphs]


@pytest.mark.parametrize("given,font,size,color", [
    (b"/F0 9.5 Tf 1 0 0 rg", "F0", 9.5, b"1 0 0 rg"), (b"0.5 g /Helv 0 Tf", "Helv", 0, b"0.5 g"), (b"2 -1 0 .25 k", None, 0, b"1 0 0 0.25 k"),
    (b"/A 1 Tf /B 2 Tf 0 g 1 g", "B", 2, b"1 g"), (b"12 Tf 1 rg (x", None, 0, b"0 g"), (b"", None, 0, b"0 g")])
def test_appearance_strings(given, font, size, color):
    assert forms.look_of(given) == forms.Look(font, size, color)


def test_cells_hold_one_character_each():
    file = sample()
    edit.add_field(file, 0, "pin", (0, 0, 100, 20), max_len=5, comb=True, size=10, value="12345678")
    assert edit.fields(file)[0]["value"] == "12345"
    got = look(file, "pin")
    wide = edit.text_width("1", 10)
    assert [(t, round(x, 3)) for t, x, _, _ in got] == [(str(k + 1), round(20 * k + (20 - wide) / 2, 3)) for k in range(5)]


def test_lines_wrap_and_align():
    file = sample()
    edit.add_field(file, 0, "note", (0, 0, 60, 60), multiline=True, size=10, align="right", value="aa bb cc dd ee ff\\nlast".replace("\\\\n", "\\n"))
    got = look(file, "note")
    lines = {}
    for t, x, y, _ in got:
        lines.setdefault(round(y, 2), []).append((t, x))
    shown = ["".join(t for t, _ in v) for _, v in sorted(lines.items(), reverse=True)]
    assert " ".join(shown).split()[:4] == ["aa", "bb", "cc", "dd"] and len(shown) >= 2
    for v in lines.values():
        right = v[-1][1] + edit.text_width(v[-1][0], 10)
        assert right == pytest.approx(58, abs=0.01)


def test_one_line_fits_its_box_and_passwords_are_hidden():
    file = sample()
    edit.add_field(file, 0, "long", (0, 0, 50, 20), value="a rather long text")
    edit.add_field(file, 0, "secret", (0, 30, 150, 50), value="abc", password=True)
    got = look(file, "long")
    assert got[0][3] < 20 * 0.72 and got[-1][1] + edit.text_width("t", got[-1][3]) <= 48.01
    assert "".join(t for t, *_ in look(file, "secret")) == "***" and edit.fields(file)[1]["value"] == "abc"


def test_choices_and_lists():
    file = sample()
    edit.add_field(file, 0, "size", (0, 0, 100, 20), kind="combo", options=[("s", "Small"), ("l", "Large")], value="l")
    edit.add_field(file, 0, "tags", (0, 30, 100, 90), kind="list", options=["a", "b", "c"], multiple=True, value=["c", "a"])
    file = again(file)
    found = {f["name"]: f for f in edit.fields(file)}
    assert found["size"]["kind"] == "combo" and found["size"]["value"] == "l" and found["size"]["options"] == [("s", "Small"), ("l", "Large")]
    assert "".join(t for t, *_ in look(file, "size")) == "Large"
    assert found["tags"]["values"] == ["c", "a"] and file.objects[found["tags"]["num"]]["I"] == [0, 2]
    assert "".join(t for t, *_ in look(file, "tags")) == "abc"
    edit.set_field(file, "size", "Small")
    assert edit.fields(again(file))[0]["value"] == "s"
    with pytest.raises(ValueError):
        edit.set_field(file, "tags", "z")


def test_radio_buttons_are_one_choice():
    file = sample()
    edit.add_field(file, 0, "color", (0, 0, 90, 30), kind="radio", options=[("r", "Red"), ("g", "Green"), ("b", "Blue")], value="g")
    file = again(file)
    field = edit.fields(file)[0]
    assert (field["kind"], field["value"], len(field["widgets"])) == ("radio", "g", 3)
    assert [str(file.resolve(w)["AS"]) for w in field["widgets"]] == ["Off", "g", "Off"]
    edit.set_field(file, "color", "Blue")
    assert edit.fields(again(file))[0]["value"] == "b"
    edit.set_field(file, "color", False)
    assert edit.fields(file)[0]["value"] == "Off"
    with pytest.raises(ValueError):
        edit.set_field(file, "color", "Pink")
    with pytest.raises(ValueError):
        edit.add_field(file, 0, "none", (0, 0, 9, 9), kind="radio")


def test_flags_borders_and_removal():
    file = sample()
    edit.add_field(file, 0, "a.b", (0, 0, 90, 30), required=True, read_only=True, background=(1, 1, 0), border=(0, 0, 1), tooltip="é", value="x")
    edit.add_field(file, 0, "c", (0, 40, 20, 60), kind="checkbox", options=["Sure"], value=True)
    file = again(file)
    first, second = edit.fields(file)
    assert first["flags"] & forms.REQUIRED and first["flags"] & forms.READ_ONLY and second["value"] == "Sure"
    body = file.data(file.resolve(edit.normal_appearance(file, file.resolve(first["widgets"][0]))))
    assert b"1 1 0 rg" in body and b"0 0 1 RG" in body
    assert forms.remove_field(file, "a.b") and not forms.remove_field(file, "a.b")
    file = again(file)
    assert [f["name"] for f in edit.fields(file)] == ["c"] and len(edit.annotations(file, 0)) == 1
    forms.remove_form(file)
    assert edit.fields(again(file)) == []
    with pytest.raises(ValueError):
        edit.add_field(file, 0, "x", (0, 0, 1, 1), kind="slider")


@pytest.mark.parametrize("turn", [0, 90])
def test_image_annotations_keep_their_shape(turn):
    file = container.new_file({})
    container.add_page(file, b"", {}, rotation=turn)
    png = images.encode_png(np.full((10, 20, 3), 7, np.uint8))
    edit.add_image_annotation(file, 0, (100, 100, 200, 200), png, opacity=0.5, text="logo", author="me")
    file = again(file)
    note = edit.annotations(file, 0)[0]
    assert (note["subtype"], note["contents"], note["author"]) == ("Stamp", "logo", "me")
    x0, y0, x1, y1 = note["rect"]
    assert sorted((round(x1 - x0), round(y1 - y0))) == [50, 100]
    assert edit.flatten(file, 0) == 1
    use = content.page_content(again(file), again(file).pages()[0][1])[1][0]
    assert sorted((round(use["w"]), round(use["h"]))) == [50, 100]


def test_turned_fields_and_watermarks():
    file = sample()
    ref = edit.add_field(file, 0, "up", (0, 0, 20, 100), size=10)
    file.objects[ref.num]["MK"] = {"R": 90}
    edit.set_field(file, "up", "ab")
    form = file.resolve(edit.normal_appearance(file, file.objects[ref.num]))
    assert form.head["BBox"] == [0, 0, 100, 20] and edit.flatten(file, 0) == 1
    a, b = content.page_content(again(file), again(file).pages()[0][1])[0]
    assert a["text"] + b["text"] == "ab" and abs(a["dx"]) < 1e-9 and b["y0"] > a["y0"] and 0 <= a["x0"] <= a["x1"] <= 20
    edit.watermark(file, "DRAFT")
    assert "".join(g["text"] for g in content.page_content(again(file), again(file).pages()[0][1])[0]).endswith("DRAFT")
