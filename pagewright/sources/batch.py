"""Presets over files: (name, data) rows in, output files out, a document a task.

Mode ``each`` maps over files; mode ``merge`` gathers the files of one job, which
is one document by definition, into one task per ``job``.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pagewright.functions.geometry import page_size
from pagewright.functions.ranges import parse
from pagewright.plans.presets import Preset, PresetError

from .codec import container, content, edit
from .codec.values import Ref, Stream, to_text_bytes

OUT = "job string, out_name string, data binary, pages int, bytes bigint, sources array<string>, warnings array<string>"


def stem(name: str) -> str:
    base = name.replace("\\", "/").rsplit("/", 1)[-1]
    head, dot, _ = base.rpartition(".")
    return head if dot and head else base


def _reorder(file: container.File, order: list[int]) -> None:
    """Pages in a new order; a page listed again is a copy."""
    pages, tree, kids, seen = file.pages(), file.root["Pages"], [], set()
    node = file.resolve(tree)
    for i in order:
        num, whole = pages[i]
        if num in seen:
            kids.append(file.add({**whole, "Parent": tree}))
        else:
            seen.add(num)
            file.objects[num] = {**whole, "Parent": tree}
            kids.append(Ref(num))
    node["Kids"], node["Count"] = kids, len(kids)


def _resize(file, indices, target=None, factor=None, mode="fit") -> None:
    for i in indices:
        page = edit.page_at(file, i)
        x0, y0, x1, y1 = (float(file.resolve(v)) for v in file.resolve(page["MediaBox"]))
        w, h = max(abs(x1 - x0), 1.0), max(abs(y1 - y0), 1.0)
        tw, th = target if target else (w * factor, h * factor)
        if target and (file.resolve(page.get("Rotate")) or 0) % 180:
            tw, th = th, tw
        sx, sy = tw / w, th / h
        if target and mode != "stretch":
            sx = sy = (min if mode == "fit" else max)(sx, sy)
        m = (sx, 0, 0, sy, (tw - w * sx) / 2 - min(x0, x1) * sx, (th - h * sy) / 2 - min(y0, y1) * sy)
        edit.wrap(file, page, b"q %s cm\n" % b" ".join(map(edit.n, m)), b"Q\n")
        page["MediaBox"] = [0, 0, tw, th]
        page.pop("CropBox", None)
        for ref in file.resolve(page.get("Annots")) or []:
            a = file.resolve(ref)
            if isinstance(a, dict) and "Rect" in a:
                r = [float(file.resolve(v)) for v in file.resolve(a["Rect"])]
                a["Rect"] = [r[0] * sx + m[4], r[1] * sy + m[5], r[2] * sx + m[4], r[3] * sy + m[5]]


def _sheets(file, slots: list[list[int | None]], w: float, h: float, columns: int, rows: int, margin: float) -> None:
    """Replace the pages by sheets that show them in cells, as large as fits and centred."""
    new = []
    for sheet in slots:
        body, forms = b"", {}
        for k, i in enumerate(sheet):
            if i is None:
                continue
            page = edit.page_at(file, i)
            x0, y0, x1, y1, turn = edit.box(file, page)
            pw, ph = (y1 - y0, x1 - x0) if turn % 180 else (x1 - x0, y1 - y0)
            cw, ch = w / columns, h / rows
            left, low = (k % columns) * cw + margin, h - (k // columns + 1) * ch + margin
            scale = min((cw - 2 * margin) / pw, (ch - 2 * margin) / ph)
            to = edit.display_matrix(x0, y0, x1, y1, turn)
            a, b, c, d, e, f = to
            back = (d, -b, -c, a, c * f - d * e, b * e - a * f)  # quarter turns have determinant 1
            form = Stream({"Type": edit.Name("XObject"), "Subtype": edit.Name("Form"), "BBox": [x0, y0, x1, y1], "Resources": page.get("Resources") or {}}, file.content(page))
            forms[f"P{k}"] = file.add(form)
            spot = (scale, 0, 0, scale, left + (cw - 2 * margin - pw * scale) / 2, low + (ch - 2 * margin - ph * scale) / 2)
            body += b"q\n%s cm\n/P%d Do\nQ\n" % (b" ".join(map(edit.n, content._times(back, spot))), k)
        new.append(container.add_page(file, body, {"XObject": forms}, w, h))
    node = file.resolve(file.root["Pages"])
    node["Kids"], node["Count"] = new, len(new)


def apply_step(file: container.File, step: dict, assets: dict[str, bytes], warnings: list[str]) -> None:
    """One step on a file; ``split`` is the caller's."""
    op, count = step["op"], len(file.pages())
    chosen = parse(step["pages"], count) if step.get("pages") is not None else list(range(count))
    if op == "select-pages":
        _reorder(file, chosen)
    elif op == "delete-pages":
        _reorder(file, [i for i in range(count) if i not in set(chosen)])
    elif op == "reverse":
        _reorder(file, list(range(count))[::-1])
    elif op == "rotate":
        for i in chosen:
            page = edit.page_at(file, i)
            page["Rotate"] = ((file.resolve(page.get("Rotate")) or 0) + step["degrees"]) % 360
    elif op == "stamp-text":
        edit.stamp_text(file, chosen, step["text"], step.get("size", 12), step.get("position", "center"), step.get("margin", 36), step.get("opacity", 1), step.get("rotation", 0), step.get("color", (0, 0, 0)), step.get("font", "Helvetica"), step.get("under", False))
    elif op == "stamp-image":
        if step["asset"] not in assets:
            raise PresetError(f"no asset {step['asset']!r}")
        edit.stamp_image(file, chosen, assets[step["asset"]], step.get("width"), step.get("height"), step.get("position", "center"), step.get("margin", 36), step.get("under", False))
    elif op == "page-numbers":
        start = step.get("start_at", 1)
        for k, i in enumerate(chosen or range(count)):
            text = number_text(step.get("format", "{page}"), start + k, start + len(chosen or range(count)) - 1)
            edit.stamp_text(file, [i], text, step.get("size", 10), step.get("position", "bottom-center"), step.get("margin", 24))
    elif op in ("metadata", "strip-metadata"):
        info = file.resolve(file.trailer.get("Info"))
        info = {} if op == "strip-metadata" or not isinstance(info, dict) else dict(info)
        if op == "strip-metadata":
            file.objects[file.trailer["Root"].num].pop("Metadata", None)
        for key in ("title", "author", "subject", "keywords", "creator", "producer"):
            if step.get(key) is not None:
                info.pop(key.capitalize(), None)
                if step[key]:
                    info[key.capitalize()] = to_text_bytes(step[key])
        file.trailer["Info"] = file.add(info)
    elif op == "resize":
        _resize(file, chosen, page_size(step["size"]) if step.get("size") else (step["width"], step["height"]), mode=step.get("mode", "fit"))
    elif op == "scale":
        _resize(file, chosen, factor=step["factor"])
    elif op == "blank-pages":
        at = step["at"] - 1 if step.get("at") else count
        near = file.pages()[max(min(at, count) - 1, 0)][1].get("MediaBox") if count else None
        near = [float(file.resolve(v)) for v in file.resolve(near)] if near else [0, 0, 612, 792]
        w, h = page_size(step["size"]) if step.get("size") else (near[2] - near[0], near[3] - near[1])
        n = step.get("count") or 1
        for _ in range(n):
            container.add_page(file, b"", {}, w, h)
        order = list(range(count))
        _reorder(file, order[:at] + list(range(count, count + n)) + order[at:])
    elif op == "flatten":
        forms, notes = step.get("forms", True), step.get("annotations", True)
        for i in range(count):
            edit.flatten(file, i, keep=lambda a: not (forms if a.get("Subtype") == "Widget" else notes))
        if forms:
            file.objects[file.trailer["Root"].num].pop("AcroForm", None)
    elif op in ("nup", "booklet"):
        w, h = page_size(step.get("sheet", "a4"))
        if step.get("landscape", op == "booklet") and w < h:
            w, h = h, w
        if op == "nup":
            k = step["per_sheet"]
            columns = 2 if k == 4 or w >= h else 1
            slots = [[i if i < count else None for i in range(s, s + k)] for s in range(0, count, k)]
            _sheets(file, slots, w, h, columns, k // columns, step.get("margin", 0))
        else:
            total = -(-count // 4) * 4
            page = lambda i: i if i < count else None
            sides = [[page(total - 1 - k), page(k)] if k % 2 == 0 else [page(k), page(total - 1 - k)] for k in range(total // 2)]
            _sheets(file, sides, w, h, 2, 1, step.get("margin", 0))
    elif op == "compress-images":
        done = edit.compress_images(file, step.get("dpi", 150), quality=step.get("quality", 75), convert_lossless=True, min_pixels=4096)
        warnings += [f"{n} images not compressed: {why}" for why, n in sorted(done["skipped"].items(), key=lambda kv: (-kv[1], kv[0]))]
    elif op != "split":
        raise PresetError(f"unknown step {op!r}")


def number_text(template: str, page: int, pages: int) -> str:
    import re

    def value(hit):
        name, _, width = hit[1].partition(":")
        v = {"page": page, "pages": pages}.get(name.strip())
        return hit[0] if v is None else f"{v:0{int(width)}d}" if width.strip().isdigit() and v >= 0 else str(v)

    return re.sub(r"\{([^}]*)\}", value, template)


def run_files(preset: Preset, inputs: list[tuple[str, bytes, str]], assets: dict[str, bytes]) -> list[dict]:
    """Outputs of one job: (name, data, password) inputs, merged first in mode ``merge``."""
    preset.validate()
    outputs, made = [], 0
    opened = []
    for name, data, password in inputs:
        try:
            opened.append((name, container.load(data or b"", password or "")))
        except Exception as e:
            raise ValueError(f"{name}: {e}") from e
    if preset.mode == "merge" and opened:
        jobs = [(f"{stem(opened[0][0])}-merged", [n for n, _ in opened], edit.merge([f for _, f in opened]))]
    else:
        jobs = [(stem(n), [n], f) for n, f in opened]
    given = preset.output
    secret = given.get("encryption")
    for base, sources, file in jobs:
        warnings: list[str] = []
        parts = [file]
        for step in preset.steps:
            if step["op"] == "split":
                count = len(file.pages())
                every = step.get("every")
                chunks = [list(range(k, min(k + every, count))) for k in range(0, count, every)] if every else [parse(r, count) for r in step["ranges"]]
                parts = [edit.extract(file, c) for c in chunks]
            else:
                apply_step(file, step, assets, warnings)
        for k, part in enumerate(parts, 1):
            made += 1
            template = given["filename"]
            name = template.replace("{stem}", base).replace("{index}", str(k)).replace("{total}", str(len(parts))).replace("{n}", str(made))
            if len(parts) > 1 and "{index}" not in template and "{n}" not in template:
                head, dot, tail = name.rpartition(".")
                name = f"{head}-{k}.{tail}" if dot else f"{name}-{k}"
            lock = secret and {"method": secret.get("method", "aes256"), "user": secret.get("userPassword", ""), "owner": secret.get("ownerPassword", ""), "metadata": secret.get("encryptMetadata", True)}
            data = container.save(part, given["compress"], given["compressionLevel"], given["objectStreams"], lock or None)
            outputs.append({"out_name": name, "data": data, "pages": len(part.pages()), "bytes": len(data), "sources": sources, "warnings": warnings})
    return outputs


def _kernel(preset: Preset, assets: dict[str, bytes]):
    kinds = pa.schema([("job", pa.string()), ("out_name", pa.string()), ("data", pa.binary()), ("pages", pa.int32()), ("bytes", pa.int64()), ("sources", pa.list_(pa.string())), ("warnings", pa.list_(pa.string()))])

    def merged(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["name"])
        return pa.Table.from_pylist([{"job": rows[0]["job"], **o} for o in run_files(preset, [(r["name"], r["data"], r["password"]) for r in rows], assets)], schema=kinds)

    def each(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pylist([{"job": row["job"], **o} for o in run_files(preset, [(row["name"], row["data"], row["password"])], assets)], schema=kinds)

    return merged, each


def run(preset: Preset, files: DataFrame, assets: dict[str, bytes] | None = None) -> DataFrame:
    """Output files of a preset over (name, data, password?, job?) rows; a file that cannot be read fails the job with its name."""
    preset.validate()
    has = set(files.columns)
    rows = files.select(
        (F.col("job") if "job" in has else F.lit("job")).alias("job"), "name", "data", (F.col("password") if "password" in has else F.lit(None).cast("string")).alias("password"))
    merged, each = _kernel(preset, assets or {})
    return rows.groupBy("job").applyInArrow(merged, OUT) if preset.mode == "merge" else rows.mapInArrow(each, OUT)
