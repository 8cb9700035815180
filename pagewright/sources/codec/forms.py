"""Form fields: creation, values and how they look.

A field's look comes from its appearance string (font, size, colour), its flags
and its box. Text is laid out as cells (one a character), as wrapped lines, as a
list of options, or as one line; each of these is a list of (x, y, text) runs
that one writer turns into operators.
"""

from __future__ import annotations

from dataclasses import dataclass

from . import content as C, edit, values as V
from .container import File
from .values import Name, Ref, Stream

# Bits of field flags.
READ_ONLY, REQUIRED, MULTILINE, PASSWORD, RADIO, PUSH, COMBO, MULTISELECT, COMB, NO_TOGGLE = 1 << 0, 1 << 1, 1 << 12, 1 << 13, 1 << 15, 1 << 16, 1 << 17, 1 << 21, 1 << 24, 1 << 14
KINDS = ("text", "checkbox", "radio", "combo", "list")
PAD, LEADING = 2.0, 1.15
ASCENT, DESCENT, CAPITAL = 0.718, -0.207, 0.72  # of Helvetica, in parts of the size
YES = ("true", "yes", "on", "1", "checked", "x")
n = edit.n


@dataclass
class Look:
    """Font, size (0: as fits) and colour operator of an appearance string."""

    font: str | None = None
    size: float = 0.0
    color: bytes = b"0 g"


def look_of(appearance: bytes) -> Look:
    """What a default appearance string says; later operators win, colours are held to 0 to 1."""
    look, wanted = Look(), {"g": 1, "rg": 3, "k": 4}
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
    for op in C.operators(appearance):
        last = op.operands[-wanted.get(op.name, 2) :]
        if op.name == "Tf" and len(last) == 2 and isinstance(last[0], Name) and number(last[1]):
            look.font, look.size = str(last[0]), float(last[1])
        elif op.name in wanted and len(last) == wanted[op.name] and all(map(number, last)):
            look.color = b" ".join(n(min(max(float(v), 0.0), 1.0)) for v in last) + b" " + op.name.encode()
    return look


def fitting(text: str, width: float, height: float, base: str, most: float = 48.0) -> float:
    """The size at which one line of text fills its box, 4 at least."""
    size = min(max(height * CAPITAL, 4.0), most)
    wide = edit.text_width(text, size, base)
    return max(size * width / wide, 4.0) if wide > width > 0 else size


def cell_runs(text: str, count: int, w: float, h: float, size: float, base: str) -> list[tuple]:
    """One character in the middle of each of ``count`` equal cells."""
    cell, y = w / count, (h - size * CAPITAL) / 2
    return [(cell * k + (cell - edit.text_width(c, size, base)) / 2, y, c) for k, c in enumerate(text[:count])]


def line_runs(lines: list[str], w: float, top: float, size: float, base: str, align: int, edge: float) -> list[tuple]:
    """Lines below each other from the baseline ``top``, aligned left (0), centre (1) or right (2), as far as the box goes."""
    out, y = [], top
    for line in lines:
        wide = edit.text_width(line, size, base)
        out.append(({1: (w - wide) / 2, 2: w - edge - wide}.get(align, edge), y, line))
        y -= size * LEADING
        if y + ASCENT * size < 0:
            break
    return out


def _shown(runs: list[tuple], font: str, size: float, color: bytes) -> bytes:
    body = b"".join(b"1 0 0 1 %s %s Tm\n%s Tj\n" % (n(x), n(y), V.literal_bytes(C.encode_text(text))) for x, y, text in runs)
    return b"BT\n%s\n/%s %s Tf\n%sET\n" % (color, font.encode(), n(size), body)


def _inherited(file: File, node: dict, key: str):
    for _ in range(64):
        if not isinstance(node, dict):
            return None
        if file.resolve(node.get(key)) is not None:
            return file.resolve(node.get(key))
        node = file.resolve(node.get("Parent"))
    return None


def _font(file: File, name: str | None) -> tuple[str, object, str]:
    """(resource name, font, standard font that measures it) from the form's resources; Helvetica where there is none."""
    held = file.get(file.get(file.get(file.root, "AcroForm"), "DR"), "Font") or {}
    if name and name in held:
        return name, held[name], str(file.get(held[name], "BaseFont") or "Helvetica")
    return "Helv", held.get("Helv") or C.standard_font(), "Helvetica"


def draw_value(file: File, widget: dict, field: dict, values: list[str]) -> None:
    """Give a widget the look of its field's values."""
    x0, y0, x1, y1 = (float(file.resolve(v)) for v in file.resolve(widget["Rect"]))
    w, h = abs(x1 - x0), abs(y1 - y0)
    style = file.resolve(widget.get("MK")) or {}
    turn = round((file.resolve(style.get("R")) or 0) / 90) % 4 * 90
    matrix = {0: None, 90: [0, 1, -1, 0, w, 0], 180: [-1, 0, 0, -1, w, h], 270: [0, -1, 1, 0, 0, h]}[turn]
    if turn % 180:
        w, h = h, w
    edge_color, fill = (file.resolve(style.get(k)) for k in ("BC", "BG"))
    line = float(file.resolve((file.resolve(widget.get("BS")) or {}).get("W", 1)) or 0) if edge_color else 0.0
    given = _inherited(file, widget, "DA")
    if not isinstance(given, bytes):
        given = file.get(file.get(file.root, "AcroForm"), "DA")
    look = look_of(given if isinstance(given, bytes) else b"")
    name, font, base = _font(file, look.font)
    flags, align = field["flags"], _inherited(file, widget, "Q") or 0
    edge = line + PAD
    inner_w, inner_h = max(w - 2 * edge, 1.0), max(h - 2 * edge, 1.0)
    tint = lambda c: b" ".join(n(float(file.resolve(v))) for v in c) + {1: b" g", 3: b" rg", 4: b" k"}[len(c)]
    body = b""
    if fill:
        body += tint(fill) + b"\n0 0 %s %s re f\n" % (n(w), n(h))
    if edge_color and line:
        body += tint(edge_color).replace(b"rg", b"RG").replace(b" g", b" G").replace(b" k", b" K") + b"\n%s w\n%s %s %s %s re S\n" % (n(line), n(line / 2), n(line / 2), n(w - line), n(h - line))
    body += b"/Tx BMC\nq\n%s %s %s %s re W n\n" % (n(line), n(line), n(max(w - 2 * line, 0)), n(max(h - 2 * line, 0)))
    labels = dict(field["options"])
    if field["kind"] == "list":
        size, runs = look.size or 12.0, []
        y = h - edge - size * LEADING
        for value, label in field["options"]:
            if value in values:
                body += b"0.6 0.75 0.85 rg\n%s %s %s %s re f\n" % (n(line), n(y - size / 4), n(w - 2 * line), n(size * LEADING))
            runs.append((edge, y, label))
            y -= size * LEADING
            if y < -size * LEADING:
                break
    else:
        text = values[0] if values else ""
        text = labels.get(text, text) if field["kind"] == "combo" else "*" * len(text) if flags & PASSWORD else text
        if flags & COMB and field["max_len"]:
            size = look.size or max(min(inner_h * 0.75, w / field["max_len"] * 1.2), 4.0)
            runs = cell_runs(text, field["max_len"], w, h, size, base)
        elif flags & MULTILINE and field["kind"] == "text":
            from pagewright.functions.strings import wrap_lines

            size = look.size or 12.0
            runs = line_runs(wrap_lines(text, inner_w, lambda c: edit.text_width(c, size, base)), w, h - edge - ASCENT * size, size, base, align, edge)
        else:
            text = text.replace("\n", " ").replace("\r", " ")
            size = look.size or fitting(text, inner_w, inner_h, base)
            runs = line_runs([text], w, (h - (ASCENT - DESCENT) * size) / 2 - DESCENT * size, size, base, align, edge)
    body += _shown(runs, name, size, look.color) + b"Q\nEMC\n"
    head = {"Type": Name("XObject"), "Subtype": Name("Form"), "BBox": [0, 0, w, h], "Resources": {"Font": {name: font}}} | ({"Matrix": matrix} if matrix else {})
    widget["AP"] = {"N": file.add(Stream(head, body))}


def states(file: File, widget) -> list[str]:
    """The states that a button's widget can show, but Off."""
    return [k for k in file.resolve((file.resolve((file.resolve(widget) or {}).get("AP")) or {}).get("N")) or {} if k != "Off"]


def set_value(file: File, field: dict, value) -> None:
    """Set a field (a row of ``edit.fields``): text, a truth value, a state, an option by value or label, or a list of options."""
    node = file.objects[field["num"]]
    widgets = [file.resolve(r) for r in field["widgets"]]
    given = [str(v) for v in value] if isinstance(value, (list, tuple)) else ["true" if value is True else "false" if value is False else str(value)]
    if field["kind"] in ("checkbox", "radio"):
        known = [states(file, w) for w in widgets]
        wanted = given[0] if given else "false"
        every = [s for own in known for s in own]
        by_label = {label: state for (_, label), own in zip(field["options"], known) for state in own[:1]}
        state = wanted if wanted in every else by_label.get(wanted) or (every[0] if field["kind"] == "checkbox" and every and wanted.strip().lower() in YES else None)
        if field["kind"] == "radio" and state is None and wanted and wanted.strip().lower() not in ("false", "off"):
            raise ValueError(f"{field['name']}: no choice {wanted!r}")
        for widget, own in zip(widgets, known):
            widget["AS"] = Name(state if state in own else "Off")
        node["V"] = Name(state or "Off")
        return
    if field["kind"] in ("combo", "list"):
        by_label = {label: v for v, label in field["options"]}
        values = {v for v, _ in field["options"]}
        chosen = [v if v in values else by_label.get(v, v) for v in given if v]
        if field["kind"] == "list" and (lost := [v for v in chosen if v not in values]):
            raise ValueError(f"{field['name']}: no choice {lost[0]!r}")
        chosen = chosen if field["flags"] & MULTISELECT else chosen[:1]
        order = [v for v, _ in field["options"]]
        node["V"] = [V.to_text_bytes(v) for v in chosen] if len(chosen) > 1 else V.to_text_bytes(chosen[0] if chosen else "")
        node["I"] = sorted(order.index(v) for v in chosen if v in values)
    else:
        text = given[0] if given else ""
        chosen = [text[: field["max_len"]] if field["max_len"] else text]
        node["V"] = V.to_text_bytes(chosen[0])
    for widget in widgets:
        draw_value(file, widget, field, chosen)


def _form(file: File) -> dict:
    root = file.objects[file.trailer["Root"].num]
    form = file.resolve(root.get("AcroForm"))
    if form is None:
        root["AcroForm"] = file.add({"Fields": [], "DA": b"/Helv 0 Tf 0 g", "DR": {"Font": {"Helv": file.add(C.standard_font())}}})
        form = file.resolve(root["AcroForm"])
    return form


def _button(file: File, w: float, h: float, on: str, round_: bool) -> dict:
    """Appearances of a button that is on or off: a cross, or a disc."""
    head = {"Type": Name("XObject"), "Subtype": Name("Form"), "BBox": [0, 0, w, h]}
    if round_:
        k, r, a, b = 0.5523, min(w, h) / 4, w / 2, h / 2
        at = lambda x, y: b"%s %s " % (n(a + x * r), n(b + y * r))
        mark = at(1, 0) + b"m " + b"".join(
            at(x - k * y, y + k * x) + at(k * x - y, k * y + x) + at(-y, x) + b"c " for x, y in ((1, 0), (0, 1), (-1, 0), (0, -1))) + b"f\n"
    else:
        mark = b"1 w 2 2 m %s %s l 2 %s m %s 2 l S\n" % (n(w - 2), n(h - 2), n(h - 2), n(w - 2))
    return {"N": {on: file.add(Stream(dict(head), mark)), "Off": file.add(Stream(dict(head), b""))}}


def add_field(file: File, index: int, name: str, rect: tuple, kind: str = "text", value=None, options=(), multiline: bool = False, required: bool = False, read_only: bool = False,
              password: bool = False, max_len: int | None = None, comb: bool = False, multiple: bool = False, size: float = 0.0, color=(0, 0, 0), align: str = "left",
              background=None, border=None, border_width: float = 1.0, tooltip: str | None = None, widgets=()) -> Ref:
    """A field on a page; its name is new. Radio buttons take ``widgets`` as boxes, or share ``rect`` from left to right.

    ``options`` are values, or pairs of a value and a label.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown field kind {kind!r}")
    if not name or any(f["name"] == name for f in edit.fields(file)):
        raise ValueError(f"there is a field {name!r}, or it has no name")
    pairs = [(o, o) if isinstance(o, str) else tuple(o) for o in options]
    if kind == "radio" and not pairs:
        raise ValueError("a radio field needs options")
    page = edit.page_at(file, index)
    flags = (READ_ONLY * read_only | REQUIRED * required | MULTILINE * (multiline and kind == "text") | PASSWORD * (password and kind == "text") | COMB * (comb and bool(max_len))
             | (RADIO | NO_TOGGLE) * (kind == "radio") | COMBO * (kind == "combo") | MULTISELECT * (multiple and kind == "list"))
    node = {"FT": Name({"text": "Tx", "combo": "Ch", "list": "Ch"}.get(kind, "Btn")), "T": V.to_text_bytes(name), "Ff": flags,
            "DA": b"/Helv %s Tf %s rg" % (n(size), b" ".join(map(n, color))), "Q": ("left", "center", "right").index(align)}
    if max_len and kind == "text":
        node["MaxLen"] = max_len
    if pairs and kind != "checkbox":
        node["Opt"] = [V.to_text_bytes(b) for _, b in pairs] if kind == "radio" else [V.to_text_bytes(a) if a == b else [V.to_text_bytes(a), V.to_text_bytes(b)] for a, b in pairs]
    if tooltip:
        node["TU"] = V.to_text_bytes(tooltip)
    style = {k: list(map(float, c)) for k, c in (("BG", background), ("BC", border)) if c is not None}
    look = ({"MK": style} if style else {}) | ({"BS": {"W": float(border_width)}} if border is not None else {})

    def widget(box: tuple, own: dict) -> dict:
        return {"Type": Name("Annot"), "Subtype": Name("Widget"), "Rect": list(map(float, box)), "F": 4, **look, **own}

    if kind == "radio":
        step = (rect[2] - rect[0]) / len(pairs)
        boxes = list(widgets) or [(rect[0] + k * step, rect[1], rect[0] + (k + 1) * step, rect[3]) for k in range(len(pairs))]
        ref = file.add(node)
        node["Kids"] = [file.add(widget(box, {"Parent": ref, "AS": Name("Off"), "AP": _button(file, box[2] - box[0], box[3] - box[1], str(value_), True)}))
                        for box, (value_, _) in zip(boxes, pairs)]
        node["V"], shown = Name("Off"), node["Kids"]
    else:
        if kind == "checkbox":
            on = pairs[0][0] if pairs else "Yes"
            look |= {"AP": _button(file, rect[2] - rect[0], rect[3] - rect[1], on, False), "AS": Name("Off")}
            node["V"] = Name("Off")
        ref = file.add(widget(rect, node))
        shown = [ref]
    page["Annots"] = [*(file.resolve(page.get("Annots")) or []), *shown]
    form = _form(file)
    form["Fields"] = [*(file.resolve(form.get("Fields")) or []), ref]
    field = next(f for f in edit.fields(file) if f["name"] == name)
    if value not in (None, "") or kind in ("text", "combo", "list") and (style or kind == "list"):
        set_value(file, field, value if value is not None else "")
    return ref


def add_text_fields(file: File, index: int, rows: list[tuple]) -> None:
    """Many text fields at once on a page, from (name, box, value) rows with names that are new."""
    page, form = edit.page_at(file, index), _form(file)
    made = []
    for name, box, value in rows:
        node = {"Type": Name("Annot"), "Subtype": Name("Widget"), "Rect": list(map(float, box)), "F": 4, "FT": Name("Tx"), "T": V.to_text_bytes(name), "Ff": 0, "DA": b"/Helv 10 Tf 0 g", "V": V.to_text_bytes(value)}
        made.append(file.add(node))
        if value:
            draw_value(file, node, {"kind": "text", "flags": 0, "options": [], "max_len": None}, [value])
    page["Annots"] = [*(file.resolve(page.get("Annots")) or []), *made]
    form["Fields"] = [*(file.resolve(form.get("Fields")) or []), *made]


def remove_field(file: File, name: str) -> bool:
    """Drop a field and its widgets; whether there was one."""
    field = next((f for f in edit.fields(file) if f["name"] == name), None)
    if field is None:
        return False
    gone = {r.num for r in field["widgets"] if isinstance(r, Ref)} | {field["num"]}
    for index in range(len(file.pages())):
        page = edit.page_at(file, index)
        held = file.resolve(page.get("Annots"))
        if held:
            page["Annots"] = [r for r in held if getattr(r, "num", None) not in gone]
    edit.detach_fields(file, gone)
    return True


def remove_form(file: File) -> None:
    file.objects[file.trailer["Root"].num].pop("AcroForm", None)
