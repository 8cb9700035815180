"""Presets: pipelines described in JSON and run over page tables.

A preset is checked on the driver and folded into one lazy plan. Steps run in
order and read page ranges against the pages that the step before left. Text and
image stamps add rows to the page's ``marks`` column; drawing them is the
writer's work.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from pagewright.functions import geometry as G
from pagewright.operators import items as I, pages as P

SCHEMA = 1
# Step names and the settings each may have.
STEPS = {
    "select-pages": {"pages"}, "delete-pages": {"pages"}, "rotate": {"pages", "degrees"},
    "stamp-text": {"pages", "text", "font", "size", "color", "opacity", "position", "rotation", "margin", "under"},
    "stamp-image": {"pages", "asset", "width", "height", "opacity", "position", "margin", "under"},
    "page-numbers": {"pages", "format", "position", "font", "size", "margin", "color", "start_at"},
    "metadata": set(I.METADATA), "strip-metadata": set(), "resize": {"pages", "size", "width", "height", "mode"},
    "scale": {"pages", "factor"}, "reverse": set(), "blank-pages": {"at", "count", "size"},
    "compress-images": {"dpi", "quality"}, "flatten": {"forms", "annotations"}, "nup": {"per_sheet", "sheet", "landscape", "margin", "frames"},
    "booklet": {"sheet", "landscape", "margin", "frames"}, "split": {"every", "ranges"},
}


class PresetError(ValueError):
    pass


@dataclass
class Preset:
    name: str = "untitled"
    steps: list[dict] = field(default_factory=list)
    mode: str = "each"
    description: str | None = None
    schema: int = SCHEMA
    output: dict = field(default_factory=lambda: {"compress": True, "compressionLevel": 6, "objectStreams": True, "encryption": None, "filename": "{stem}.pdf"})

    @classmethod
    def from_json(cls, text: str) -> "Preset":
        try:
            data = json.loads(text)
        except ValueError as e:
            raise PresetError(f"not JSON: {e}") from e
        made = cls(**{k: v for k, v in data.items() if k in cls.__dataclass_fields__ and k != "output"})
        made.output = {**made.output, **data.get("output", {})}
        made.steps = [_tidy(s) for s in made.steps]
        made.validate()
        return made

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2)

    def validate(self) -> None:
        if self.schema != SCHEMA:
            raise PresetError(f"schema {self.schema} is not supported")
        if not self.name.strip():
            raise PresetError("a preset needs a name")
        if self.mode not in ("each", "merge"):
            raise PresetError(f"unknown mode {self.mode!r}")
        if not 1 <= self.output["compressionLevel"] <= 10:
            raise PresetError("compressionLevel is 1 to 10")
        for k, step in enumerate(self.steps, 1):
            _check(step, k, last=k == len(self.steps))


def _tidy(step: dict) -> dict:
    """Settings in snake case; unknown ones are ignored."""
    alias = {"perSheet": "per_sheet", "startAt": "start_at"}
    known = STEPS.get(step.get("op"), set())
    named = {alias.get(k, k): v for k, v in step.items()}
    return {k: v for k, v in named.items() if k == "op" or k in known}


def _check(step: dict, k: int, last: bool) -> None:
    op = step.get("op")
    fail = lambda why: PresetError(f"step {k} ({op}): {why}")
    if op not in STEPS:
        raise fail("unknown step")
    if op in ("select-pages", "delete-pages") and "pages" not in step:
        raise fail("pages are missing")
    if op == "rotate" and step.get("degrees", 1) % 90:
        raise fail("degrees are a multiple of 90")
    if op in ("stamp-text", "stamp-image") and not 0 <= step.get("opacity", 1) <= 1:
        raise fail("opacity is 0 to 1")
    if op == "stamp-text" and not step.get("text"):
        raise fail("text is missing")
    if op == "stamp-image" and not step.get("asset"):
        raise fail("asset is missing")
    if op == "scale" and not step.get("factor", 0) > 0:
        raise fail("factor is above 0")
    if op == "nup" and step.get("per_sheet") not in (2, 4):
        raise fail("per_sheet is 2 or 4")
    if op == "resize":
        if step.get("size"):
            G.page_size(step["size"])
        elif not (step.get("width") and step.get("height")):
            raise fail("size, or width and height, are missing")
    if op == "split":
        if not last:
            raise fail("split is the last step")
        if not step.get("every") and not step.get("ranges"):
            raise fail("every or ranges are missing")


def _where(pages: DataFrame, spec: str | None, columns: dict) -> DataFrame:
    """``columns`` set on the listed pages (all if ``spec`` is null)."""
    if spec is None:
        return pages.withColumns(columns)
    chosen = P.listed(pages, spec).select(P.DOC, P.PAGE).distinct().withColumn("_hit", F.lit(True))
    joined = pages.join(chosen, [P.DOC, P.PAGE], "left")
    return joined.withColumns({c: F.when(F.col("_hit"), v).otherwise(F.col(c)) for c, v in columns.items()}).drop("_hit")


def _box() -> dict:
    return F.col("media_box")


def _marked(kind: str, text) -> object:
    return F.concat(F.coalesce("marks", F.array().cast("array<string>")), F.array(F.concat(F.lit(f"{kind}:"), text)))


def apply_step(pages: DataFrame, step: dict) -> DataFrame:
    """One step over pages (doc_id, page_ix, media_box, rotation, marks, ...)."""
    op, spec = step["op"], step.get("pages")
    if op == "select-pages":
        return P.select(pages, spec)
    if op == "delete-pages":
        return P.delete(pages, spec)
    if op == "reverse":
        return P.reverse(pages)
    if op == "rotate":
        return _where(pages, spec, {"rotation": G.turned(F.col("rotation"), step["degrees"])})
    if op in ("resize", "scale"):
        box = _box()
        if op == "resize":
            w, h = G.page_size(step["size"]) if step.get("size") else (step["width"], step["height"])
            w, h = F.lit(float(w)), F.lit(float(h))
            turned = G.swaps_axes(F.col("rotation"))
            w, h = F.when(turned, h).otherwise(w), F.when(turned, w).otherwise(h)
        else:
            w, h = G.width(box) * step["factor"], G.height(box) * step["factor"]
        return _where(pages, spec, {"media_box": G.rect(F.lit(0.0), F.lit(0.0), w, h)})
    if op == "blank-pages":
        at, count = step.get("at") or 0, step.get("count") or 1
        spot = at - 1 if at else 1 << 30
        made = P.insert_blank(pages, spot, count)
        from pyspark.sql import Window

        near = F.last("media_box", ignorenulls=True).over(Window.partitionBy(P.DOC).orderBy(P.PAGE))
        size = G.page_size(step.get("size") or "letter")
        fixed = G.rect(F.lit(0.0), F.lit(0.0), F.lit(size[0]), F.lit(size[1]))
        return made.withColumns({"media_box": F.coalesce("media_box", fixed if step.get("size") else F.coalesce(near, fixed)), "rotation": F.coalesce("rotation", F.lit(0))})
    if op == "stamp-text":
        counts = P.counts(pages)
        text = F.replace(F.replace(F.lit(step["text"]), F.lit("{page}"), (F.col(P.PAGE) + 1).cast("string")), F.lit("{pages}"), F.col("_n").cast("string"))
        return _where(pages.join(counts.withColumnRenamed("n", "_n"), P.DOC), spec, {"marks": _marked("text", text)}).drop("_n")
    if op == "stamp-image":
        return _where(pages, spec, {"marks": _marked("image", F.lit(step["asset"]))})
    if op == "page-numbers":
        shown = P.numbered(pages, step.get("format", "{page}"), step.get("start_at", 1), spec)
        return shown.withColumn("marks", F.when(F.col("label").isNotNull(), _marked("number", F.col("label"))).otherwise(F.col("marks"))).drop("label")
    if op == "metadata":
        return I.patch_metadata(pages, {k: step[k] for k in I.METADATA if k in step})
    if op == "strip-metadata":
        return I.strip_metadata(pages)
    if op == "flatten":
        return pages.withColumn("marks", _marked("flatten", F.lit(",".join(k for k in ("forms", "annotations") if step.get(k, True)))))
    if op == "compress-images":
        return pages.withColumn("marks", _marked("images", F.lit(str(step.get("dpi", 150)))))
    if op in ("nup", "booklet"):
        w, h = G.page_size(step.get("sheet", "a4"))
        if step.get("landscape", op == "booklet"):
            w, h = max(w, h), min(w, h)
        if op == "nup":
            slots = P.nup(pages, step["per_sheet"], w, h).select(P.DOC, "sheet", "slot", P.PAGE, "text")
        else:
            slots = P.booklet(pages).join(pages.select(P.DOC, P.PAGE, "text"), [P.DOC, P.PAGE], "left")
        ordered = F.sort_array(F.collect_list(F.struct("slot", F.coalesce("text", F.lit("")).alias("text"))))
        sheets = slots.groupBy(P.DOC, F.col("sheet").alias(P.PAGE)).agg(F.array_join(F.transform(ordered, lambda s: s["text"]), "\n").alias("text"))
        return sheets.withColumns({"media_box": G.rect(F.lit(0.0), F.lit(0.0), F.lit(w), F.lit(h)), "rotation": F.lit(0), "marks": F.array().cast("array<string>")})
    if op == "split":
        return P.split_every(pages, step["every"]) if step.get("every") else P.split_ranges(pages, step["ranges"])
    raise PresetError(f"unknown step {op!r}")


def run(preset: Preset, pages: DataFrame) -> DataFrame:
    """The pages of all outputs; mode ``merge`` concatenates the inputs first, named after the first of them."""
    preset.validate()
    if preset.mode == "merge":
        first = pages.agg(F.min(P.DOC)).first()[0]  # one value
        pages = P.merge(pages, F.lit(first)).drop("from_doc", "from_page")
    for name, kind in (("rotation", "int"), ("marks", "array<string>")):
        if name not in pages.columns:
            pages = pages.withColumn(name, F.lit(0) if name == "rotation" else F.array().cast(kind))
    if "media_box" not in pages.columns:
        pages = pages.withColumn("media_box", G.rect(F.lit(0.0), F.lit(0.0), F.lit(612.0), F.lit(792.0)))
    out = reduce(apply_step, preset.steps, pages)
    return out if "part" in out.columns else out.withColumn("part", F.lit(0))


def builtins() -> dict[str, Preset]:
    """Ready-made presets by name."""
    return {p.name: p for p in (
        Preset("compress"), Preset("merge", mode="merge"),
        Preset("encrypt-aes256", output={**Preset().output, "encryption": {"method": "aes256", "encryptMetadata": True}}),
        Preset("draft-watermark", [{"op": "stamp-text", "text": "DRAFT", "size": 96, "opacity": 0.2, "rotation": 45}]),
        Preset("split-single-pages", [{"op": "split", "every": 1}], output={**Preset().output, "filename": "{stem}-{index}.pdf"}),
    )}


class Store:
    """Presets by name, kept sorted."""

    def __init__(self, presets: dict[str, Preset] | None = None):
        self._held = dict(presets or {})

    def add(self, preset: Preset) -> None:
        preset.validate()
        self._held[preset.name] = preset

    def remove(self, name: str) -> Preset | None:
        return self._held.pop(name, None)

    def get(self, name: str) -> Preset | None:
        return self._held.get(name)

    def names(self) -> list[str]:
        return sorted(self._held)

    def __len__(self) -> int:
        return len(self._held)

    def to_json(self) -> str:
        return json.dumps({n: asdict(self._held[n]) for n in self.names()}, indent=2)

    @classmethod
    def from_json(cls, text: str) -> "Store":
        return cls({n: Preset.from_json(json.dumps(p)) for n, p in json.loads(text).items()})
