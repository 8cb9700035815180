"""Exact deduplication by deterministic block naming (DataFrame functions only).

Each text, lower-cased in A-Z only, is cut into fixed-size byte blocks. Distinct
blocks are sorted and numbered; then adjacent names are paired, distinct pairs
are sorted and numbered, and so on until one integer is left per document. Two
texts are equal exactly when they end at the same level with the same name: a
name stands for one block or one pair, so by induction for one byte string, and
an odd last name is paired with null, which no other position can hold.

Blocks are sorted by (64-bit hash, bytes). Where a hash belongs to one distinct
block, the hash alone leads from the block to its name; the few hashes shared
by several blocks are told apart by their bytes, so names never collide.

Scale: block bytes cross the network once, after map-side distinct. The rounds
move (row key, position, name) only and halve each time; there are
log2(longest text / block size) of them. A hot text gives one distinct block
row per task, and joins back from names are sort-merge joins on equi-keys that
adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .scratch import packed, stored, unpacked

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ("_id", "_sha")
#: Second half of a pair whose text has no further name; no name has this value.
NOTHING = -(1 << 63)


def ascii_lower(text):
    """Lower-case A-Z and nothing else; null becomes the empty text."""
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _numbered(distinct: DataFrame, order: list[str], name: str, label: str, few: bool = False) -> DataFrame:
    """Sort distinct rows and give each an integer that grows with its place; stored, so it is fixed."""
    return stored(distinct.orderBy(*order).withColumn(name, F.monotonically_increasing_id()), label, few)


def _named_pieces(pieces: DataFrame) -> DataFrame:
    """Level 0: ``pieces`` with a name in place of each block."""
    carried = [c for c in pieces.columns if c not in ("h", "block")]
    blocks = pieces.select("h", "block").distinct()
    by_hash = _numbered(blocks.groupBy("h").agg(F.count(F.lit(1)).alias("c")), ["h"], "name", "hashes")
    named = pieces.select(*carried, "h").join(by_hash.where("c = 1").select("h", "name"), "h").select(*carried, "name")
    shared = by_hash.where("c > 1").select("h")
    if shared.isEmpty():
        return named
    told_apart = _numbered(
        pieces.select("h", "block").join(shared, "h", "left_semi").distinct(), ["h", "block"], "_n", "shared"
    ).select("h", "block", (-1 - F.col("_n")).alias("name"))
    return named.unionByName(pieces.join(told_apart, ["h", "block"]).select(*carried, "name"))


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 1024,
               hash_bits: int = 64) -> DataFrame:
    """One row per distinct (id, normalised text): _id, _sha (binary), copies, level, name.

    (level, name) is equal exactly for equal normalised texts. ``copies`` counts
    repeated rows. ``hash_bits`` narrows the routing hash, to exercise shared
    hashes in tests; names stay collision-free at any width.
    """
    rows = docs.select(F.col(id_col).alias("_id"), ascii_lower(F.col(text_col)).cast("binary").alias("_data")).select(
        "_id", F.unhex(F.sha2("_data", 256)).alias("_sha"), "_data",
        F.greatest(F.lit(1), F.ceil(F.octet_length("_data") / block_bytes)).cast("int").alias("n"),
    )
    cut = F.expr(
        f"transform(sequence(0, n - 1), i -> named_struct('pos', i, 'block', substring(_data, i * {block_bytes} + 1, {block_bytes})))"
    )
    h = F.xxhash64("block") if hash_bits == 64 else F.xxhash64("block").bitwiseAND((1 << hash_bits) - 1)
    pieces = rows.select(*KEY, "n", F.inline(cut)).withColumn("h", h)

    # A repeated row repeats each (key, pos), so their count is the number of copies.
    state = stored(
        _named_pieces(pieces).groupBy(*KEY, "pos").agg(
            F.min("name").alias("name"), F.count(F.lit(1)).alias("copies"), F.min("n").alias("n")
        ), "level",
    )
    level, finished = 0, []
    while True:
        finished.append(state.where("n = 1").select(*KEY, "copies", F.lit(level).alias("level"), "name"))
        going = state.where("n > 1")
        if going.isEmpty():
            break
        level += 1
        pairs = going.groupBy(*KEY, F.expr("pos div 2").cast("int").alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("l"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(NOTHING)).alias("r"),
            F.max("copies").alias("copies"), F.max(F.expr("(n + 1) div 2")).cast("int").alias("n"),
        )
        names = _numbered(pairs.select("l", "r").distinct(), ["l", "r"], "name", "pairs", few=True)
        state = stored(pairs.join(names, ["l", "r"]).select(*KEY, "pos", "name", "copies", "n"), "level", few=True)
    out = finished[0]
    for part in finished[1:]:
        out = out.unionByName(part)
    return out


def assignments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Of equal texts (A-Z lower-cased, null as empty) the row with the largest id
    stays. Null ids rank below all others; a group of null ids only has keep_id
    null and keeps one row. Rows repeated with the same id and text are copies
    like any other: group_size counts each and one of them is kept. An empty
    table gives an empty result; other columns are not read.
    """
    found = identities(docs, id_col, text_col, **options)
    # Stored, so that both sides of the join are dealt anew and a hot name can be split.
    groups = stored(found.groupBy("level", "name").agg(F.max("_id").alias("keep_id"), F.sum("copies").alias("group_size")), "groups")
    turn = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_turn")
    return found.join(groups, ["level", "name"]).select("*", turn).select(
        F.col("_id").alias(id_col), "keep_id", F.col("group_size").cast("long").alias("group_size"),
        (F.col("_id").eqNullSafe(F.col("keep_id")) & (F.col("_turn") == 1)).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns (see ``assignments``).

    Of rows repeated with the same id and text, an arbitrary one stays. Columns of
    any name pass through.
    """
    kept = stored(assignments(docs, id_col, text_col, **options).select(F.col(id_col).alias("k_id"), F.col("text_sha256").alias("k_sha"), "kept"), "kept")
    on = F.col("id").eqNullSafe(F.col("k_id")) & (F.col("sha") == F.col("k_sha"))
    rows = packed(docs, id=F.col(id_col), sha=F.sha2(ascii_lower(F.col(text_col)).cast("binary"), 256))
    stay = rows.join(kept.where("kept").drop("kept"), on, "left_semi")
    repeated = kept.groupBy("k_id", "k_sha").count().where("count > 1").select("k_id", "k_sha")
    if repeated.isEmpty():
        return unpacked(stay)
    once = stay.join(repeated, on, "left_anti")
    many = stay.join(repeated, on, "left_semi").dropDuplicates(["id", "sha"])
    return unpacked(once.unionByName(many))
