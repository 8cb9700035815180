"""Commands over a folder of documents: python -m pagewright COMMAND FOLDER ...

Commands that list print a JSON row a line. Commands that change files write one
for each input into the folder OUT, or one for all in ``merge``. Every command
reads the whole folder with Spark, a file a task.
"""

from __future__ import annotations

import argparse
import json

YES = {"action": "store_true"}
#: Listing commands and their settings.
LISTS = {"info": {}, "text": {}, "report": {}, "fields": {}, "annots": {}, "bookmarks": {}, "image-uses": {}, "search": {"term": {}, "-i": YES, "--word": YES, "--pages": {}}}
#: Commands that are one step of a preset: step, positional settings, options.
STEPS = {
    "pages": ("select-pages", {"pages": {}}, {}), "delete": ("delete-pages", {"pages": {}}, {}), "reverse": ("reverse", {}, {}),
    "rotate": ("rotate", {"degrees": {"type": int}}, {"pages": {}}),
    "resize": ("resize", {}, {"pages": {}, "size": {}, "width": {"type": float}, "height": {"type": float}, "mode": {"choices": ["fit", "fill", "stretch"]}}),
    "scale": ("scale", {"factor": {"type": float}}, {"pages": {}}),
    "blank": ("blank-pages", {}, {"at": {"type": int}, "count": {"type": int}, "size": {}}),
    "nup": ("nup", {}, {"per_sheet": {"type": int, "default": 2}, "sheet": {}, "margin": {"type": float}, "landscape": YES}),
    "booklet": ("booklet", {}, {"sheet": {}, "margin": {"type": float}}),
    "stamp": ("stamp-text", {"text": {}}, {"pages": {}, "size": {"type": float}, "position": {}, "opacity": {"type": float}, "rotation": {"type": float}, "margin": {"type": float}, "font": {}, "under": YES}),
    "numbers": ("page-numbers", {}, {"pages": {}, "format": {}, "position": {}, "size": {"type": float}, "start_at": {"type": int}}),
    "meta": ("metadata", {}, {k: {} for k in ("title", "author", "subject", "keywords", "creator", "producer")}),
    "strip": ("strip-metadata", {}, {}), "flatten": ("flatten", {}, {}), "compress": ("compress-images", {}, {"dpi": {"type": float}}),
    "split": ("split", {}, {"every": {"type": int}, "ranges": {"nargs": "+"}}),
}
#: Other commands that write files.
WRITERS = {
    "run": {"preset": {}}, "merge": {}, "decrypt": {}, "images": {"--dpi": {"type": float, "default": 150.0}}, "extract-images": {},
    "encrypt": {"--method": {"default": "aes256", "choices": ["rc4", "aes128", "aes256"]}, "--user": {"default": ""}, "--owner": {"default": ""}, "--deny": {"nargs": "*", "default": []}},
    "crop": {"box": {"help": "x,y,width,height of the page as shown"}, "--pages": {}}, "uncrop": {"--pages": {}},
    "fill": {"--data": {"help": "a JSON object of values by name"}, "--set": {"action": "append", "default": [], "help": "name=value"}, "--flatten": YES},
    "set-bookmarks": {"tree": {"nargs": "?", "help": "JSON rows of path, title, page, uri, open; none clears"}},
    "redact": {"--text": {"action": "append", "default": []}, "--area": {"action": "append", "default": [], "help": "page:x,y,width,height"}, "--pages": {}, "-i": YES, "--word": YES, "--no-fill": YES},
}


def _numbers(text: str, count: int, what: str) -> list[float]:
    try:
        found = [float(v) for v in text.split(",")]
    except ValueError:
        found = []
    if len(found) != count:
        raise SystemExit(f"{what} takes {count} numbers, not {text!r}")
    return found


def _chosen(spec: str | None, file) -> list[int]:
    from pagewright.functions.ranges import parse

    count = len(file.pages())
    return parse(spec, count) if spec else list(range(count))


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="pagewright", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, *places: str) -> argparse.ArgumentParser:
        one = commands.add_parser(name)
        for place in places:
            one.add_argument(place)
        one.add_argument("--password", default=None)
        return one

    for name, settings in LISTS.items():
        one = command(name, "folder")
        for key, how in settings.items():
            one.add_argument(key, **({"dest": "ignore_case"} if key == "-i" else {}), **how)
    for name, (_, places, options) in STEPS.items():
        one = command(name, "folder", "out")
        for key, how in places.items():
            one.add_argument(key, **how)
        for key, how in options.items():
            one.add_argument(f"--{key.replace('_', '-')}", dest=key, **how)
    for name, settings in WRITERS.items():
        one = command(name, *(("folder",) if name == "run" else ("folder", "out")))
        for key, how in settings.items():
            one.add_argument(key, **({"dest": "ignore_case"} if key == "-i" else {}), **how)
        if name == "run":
            one.add_argument("out")
    presets = commands.add_parser("presets")
    presets.add_argument("export", nargs="?", help="a file for the built-in presets")
    return parser


def _change(given):
    """The change that a command makes to a file, as a function of its name and the file."""
    from pagewright.sources.codec import edit, redaction

    if given.command == "crop":
        x, y, w, h = _numbers(given.box, 4, "crop")

        def crop(name, file):
            for i in _chosen(given.pages, file):
                page = edit.page_at(file, i)
                page["CropBox"] = list(redaction.user_areas(file, page, [(x, y, x + w, y + h)])[0])

        return crop
    if given.command == "uncrop":
        return lambda name, file: [edit.page_at(file, i).pop("CropBox", None) for i in _chosen(given.pages, file)] and None
    if given.command == "fill":
        values = json.loads(open(given.data).read()) if given.data else {}
        for pair in given.set:
            name, found, value = pair.partition("=")
            if not found:
                raise SystemExit(f"--set takes name=value, not {pair!r}")
            values[name] = value

        def fill(name, file):
            unknown = []
            for key, value in values.items():
                try:
                    edit.set_field(file, key, "" if value is None else value)
                except KeyError:
                    unknown.append(key)
            if given.flatten:
                edit.flatten_fields(file)
            return {"set": len(values) - len(unknown), "unknown": unknown}

        return fill
    if given.command == "set-bookmarks":
        items = json.loads(open(given.tree).read()) if given.tree else []
        return lambda name, file: edit.set_bookmarks(file, items)
    if given.command == "redact":
        areas: dict[int, list] = {}
        for area in given.area:
            page, _, place = area.partition(":")
            x, y, w, h = _numbers(place, 4, "--area page:")
            areas.setdefault(int(page) - 1, []).append((x, y, x + w, y + h))
        if not areas and not given.text:
            raise SystemExit("redact takes --text or --area")
        fill = None if given.no_fill else (0, 0, 0)

        def redact(name, file):
            reports = [redaction.redact_text(file, _chosen(given.pages, file), t, given.ignore_case, given.word, fill=fill) for t in given.text]
            reports += [redaction.redact(file, page, own, fill=fill) for page, own in areas.items() if page < len(file.pages())]
            return redaction.merged(reports)

        return redact
    return lambda name, file: None


def _listed(given, spark, files):
    from pyspark.sql import functions as F

    from pagewright.operators import layout
    from pagewright.sources import documents

    if given.command == "search":
        found = layout.matches(documents.pages(files), given.term, given.ignore_case, given.word).where("n_matches > 0")
        if given.pages:
            from pagewright.functions import ranges

            total = documents.docs(files).select("name", "n_pages")
            wanted = total.select("name", F.explode(ranges.expand(given.pages, F.col("n_pages"), strict=False)).alias("page_ix")).distinct()
            found = found.join(wanted, ["name", "page_ix"], "left_semi")
        return found.select("name", "page_ix", "n_matches")
    kinds = {"info": documents.docs, "text": documents.pages, "report": documents.report, "fields": documents.fields, "annots": documents.annotations, "bookmarks": documents.bookmarks, "image-uses": documents.images}
    return kinds[given.command](files)


def _written(given, spark, files):
    """(name, data) of the files that a command makes."""
    from pyspark.sql import functions as F

    from pagewright.plans.presets import Preset, builtins
    from pagewright.sources import batch, documents

    outputs = lambda preset, rows: batch.run(preset, rows).select(F.col("out_name").alias("name"), "data")
    if given.command == "run":
        known = builtins()
        return outputs(known[given.preset] if given.preset in known else Preset.from_json(open(given.preset).read()), files)
    if given.command in STEPS:
        step, places, options = STEPS[given.command]
        settings = {k: getattr(given, k) for k in (*places, *options)}
        return outputs(Preset(given.command, [{"op": step, **{k: v for k, v in settings.items() if v is not None and v is not False}}]), files)
    if given.command == "merge":
        return outputs(Preset("merge", mode="merge"), files)
    if given.command == "extract-images":
        return documents.image_data(files).select(F.concat_ws("", F.regexp_replace("name", r"\.pdf$", ""), F.lit("-"), F.col("num").cast("string"), F.lit("."), F.when(F.col("kind") == "jpeg", "jpg").otherwise("png")).alias("name"), "data")
    if given.command == "images":
        return documents.image_documents(documents.read(spark, given.folder, "*.{png,jpg,jpeg}"), given.dpi)
    lock = None
    if given.command == "encrypt":
        from pagewright.functions.geometry import PERMISSIONS as BITS

        denied = sum(1 << BITS[name] - 1 for name in given.deny)
        lock = {"encryption": {"method": given.method, "user": given.user, "owner": given.owner, "permissions": -4 & ~denied}}
    return documents.edited(files, _change(given), **(lock or {})).select("name", "data")


def main(argv: list[str] | None = None) -> None:
    given = _parser().parse_args(argv)
    if given.command == "presets":
        from pagewright.plans.presets import builtins

        if given.export:
            with open(given.export, "w") as out:
                out.write(json.dumps({k: json.loads(p.to_json()) for k, p in builtins().items()}, indent=2))
        else:
            for name, preset in builtins().items():
                print(f"{name:<20} {preset.description or ''}")
        return

    from pyspark.sql import SparkSession, functions as F

    from pagewright.operators.storage import ship
    from pagewright.sources import docbin, documents

    spark = SparkSession.builder.appName("pagewright").getOrCreate()
    ship(spark)
    files = documents.read(spark, given.folder).withColumn("password", F.lit(given.password).cast("string"))
    if given.command in LISTS:
        for row in _listed(given, spark, files).toLocalIterator():
            print(json.dumps(row.asDict(recursive=True), default=str, ensure_ascii=False))
        return
    docbin.register(spark)
    _written(given, spark, files).write.format("docbin").mode("append").option("path", given.out).save()


if __name__ == "__main__":
    main()
