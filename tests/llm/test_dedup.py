"""Exact, substring and near deduplication against brute force, with awkward rows."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from pagewright.llm import blocknames, dartminhash, phrases

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id bigint, text string, name string, h string, root string"


def rows(texts, start=0):
    return [(None if i == "null" else i + start, t, "n", "x", "y") for i, t in texts]


def frame(spark, pairs):
    return spark.createDataFrame([(i, t, "n", "x", "y") for i, t in pairs], DOCS)


AWKWARD = [
    (1, "Abc"), (2, "aBC"), (3, None), (4, ""), (5, "ÀB"), (6, "àb"), (7, "Àb"), (8, "x" * 5000), (9, "X" * 5000), (10, "x" * 4999 + "y"),
    (11, "same"), (11, "same"), (11, "other"), (None, "same"), (None, "lonely"), (None, "lonely"), (12, "x" * 1024), (13, "x" * 2048), (14, "x" * 3072),
]


def normal(text):
    return (text or "").translate(FOLD)


@pytest.mark.parametrize("bits", [64, 1])
def test_exact_names_agree_with_equality(spark, bits):
    got = blocknames.assignments(frame(spark, AWKWARD), block_bytes=16, hash_bits=bits).collect()
    assert len(got) == len(AWKWARD)
    groups = {}
    for i, t in AWKWARD:
        groups.setdefault(normal(t), []).append(i)
    want = sorted(
        ((i, max([x for x in groups[normal(t)] if x is not None], default=None), len(groups[normal(t)]), hashlib.sha256(normal(t).encode()).hexdigest())
         for i, t in AWKWARD), key=str)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == want
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_keeps_one_row_of_each_text_with_its_columns(spark):
    kept = blocknames.deduplicated(frame(spark, AWKWARD)).collect()
    assert sorted(normal(r.text) for r in kept) == sorted({normal(t) for _, t in AWKWARD})
    assert kept[0].asDict().keys() == {"doc_id", "text", "name", "h", "root"}


CLASHING = "_k_sha _k_id k_id k_sha sha id kept n_id n_th th key maybe row _n_hash _n_key _n_maybe root node".split()


@pytest.mark.parametrize("kept_rows", [blocknames.deduplicated, dartminhash.near_deduplicated])
def test_kept_rows_keep_columns_of_any_name(spark, kept_rows):
    rows = [(1, "a b c"), (2, "A b c"), (3, None), (3, None), (None, "x"), (4, "d e f g h i j")]
    docs = spark.createDataFrame([(i, t, *[f"{n}{i}" for n in CLASHING]) for i, t in rows], "doc_id bigint, text string, " + ", ".join(f"`{n}` string" for n in CLASHING))
    got = kept_rows(docs)
    assert got.columns == docs.columns
    got = got.collect()
    assert len(got) == 4 and all(r[n] == f"{n}{r.doc_id}" for r in got for n in CLASHING)


def test_exact_of_an_empty_table(spark):
    empty = frame(spark, AWKWARD).limit(0)
    assert blocknames.assignments(empty).count() == 0 and blocknames.deduplicated(empty).count() == 0


def words(text):
    return (text or "").encode().split()


def removed_by_hand(pairs, length):
    first = {}
    for i, t in pairs:
        w = words(t)
        for k in range(len(w) - length + 1):
            g = tuple(w[k : k + length])
            key = i if i is not None else float("inf")
            first[g] = min(first.get(g, float("inf")), key)
    out = []
    for i, t in pairs:
        w = words(t)
        gone = set()
        for k in range(len(w) - length + 1):
            if first[tuple(w[k : k + length])] < (i if i is not None else float("inf")):
                gone.update(range(k, k + length))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return sorted(out, key=str)


def passages(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefg") + rng.choice("xyz") + str(rng.randint(0, 30))
    run = lambda n: [word() for _ in range(n)]
    shared = [run(60), run(50), run(49), run(130)]
    docs = []
    for i in range(40):
        text = []
        for _ in range(rng.randint(0, 4)):
            text += rng.choice([run(rng.randint(1, 80)), rng.choice(shared), rng.choice(shared)[rng.randint(0, 10) :]])
        docs.append((i, rng.choice([" ", "\n", "  "]).join(text)))
    edited = docs[3][1].split()
    if edited:
        edited[len(edited) // 2] = "EDIT"
    docs += [(100, " ".join(edited)), (101, docs[5][1]), (5, docs[5][1]), (None, docs[6][1]), (102, None), (103, ""), (104, " \t\n "), (105, "la " * 300), (106, "la " * 170)]
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_removal_by_hand(spark, seed):
    docs = passages(seed)
    got = phrases.removals(frame(spark, docs), shard_bytes=4000, with_text=True).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in got), key=str) == removed_by_hand(docs, 50)


def test_rows_of_one_id_with_several_texts(spark):
    rng = random.Random(12)
    run = lambda n, tag: [f"{tag}{rng.randint(0, 10**6)}" for _ in range(n)]
    shared = run(70, "s")
    docs = [(1, " ".join(run(20, "a") + shared + run(20, "b")))]
    edge = run(30, "e")
    for k in range(12):  # the same id, the same stretch around what doc 1 has, different ends
        docs.append((50, " ".join(run(60 + k, "x") + edge + shared[5:] + run(40, "y"))))
    docs += [(None, " ".join(run(9, "n") + edge + shared + run(30, "z"))) for _ in range(4)]
    got = phrases.removals(frame(spark, docs), shard_bytes=900, with_text=True).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in got), key=str) == removed_by_hand(docs, 50)
    assert all(r.n_removed >= 65 for r in got if r.doc_id != 1)


def test_occurrences_come_from_the_automaton():
    import numpy as np
    import pyarrow as pa

    from pagewright.llm import textkernels as T

    run = " ".join(f"w{k}" for k in range(60))
    words, at = T.word_hashes(pa.array(["q q q " + run, "w0 " + run + " z"]), T.byte_class(T.SPACES))
    grams, start = T.Grams(words), np.array([3])
    passage = [-5, 50, int(T.signed(grams.runs(start, 50))[0]), int(T.signed(grams.runs(start, 50, 1))[0])]
    kinds = [("h", pa.int64()), ("phrase", pa.list_(pa.int32())), ("off", pa.int32()), ("t", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("lo", pa.int64())]
    rows = [[4, None, *passage, 9], [4, phrases._numbers(words[8:18]).tolist(), None, None, None, None, None], [4, None, *passage, 7], [4, None, *passage, 7]]
    known = phrases._Passages(pa.table(list(map(list, zip(*rows))), schema=pa.schema(kinds)))
    # Found in both texts, though no position was given for either.
    assert np.flatnonzero(known.covered(words, at, np.array([9, 8]))).tolist() == [*range(3, 53), *range(64, 114)]
    assert not known.covered(words, at, np.array([7, 6])).any()
    known.automaton = phrases.ahocorasick.Automaton(phrases.ahocorasick.STORE_INTS)
    known.automaton.add_word("another phrase", 0)
    known.automaton.make_automaton()
    assert not known.covered(words, at, np.array([9, 8])).any()


def test_substring_of_an_empty_table_and_a_long_text(spark):
    assert phrases.removals(frame(spark, AWKWARD).limit(0)).count() == 0
    long = " ".join(f"w{k}" for k in range(150_000))
    got = phrases.removals(frame(spark, [(1, "w5 " * 3 + long), (2, long[: len(long) // 2].rsplit(" ", 1)[0] + " end")])).collect()
    by = {r.doc_id: r for r in got}
    assert by[1].n_removed == 0 and by[2].n_removed == by[2].n_words - 1


def shingles(text, by_count=False, n=5):
    w = [x.decode() for x in (text or "").translate(FOLD).encode().split()]
    if not w:
        return frozenset()
    grams = [tuple(w[k : k + n]) for k in range(len(w) - n + 1)] or [tuple(w)]
    if not by_count:
        return frozenset(grams)
    seen = {}
    return frozenset((g, seen.setdefault(g, 0), seen.__setitem__(g, seen[g] + 1))[:2] for g in grams)


def classes_by_hand(pairs, by_count=False):
    sets = [shingles(t, by_count) for _, t in pairs]
    root = list(range(len(pairs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(pairs)):
        for b in range(a):
            same = normal(pairs[a][1]).split() == normal(pairs[b][1]).split() if sets[a] else pairs[a][1:] == pairs[b][1:] or not (pairs[a][1] or pairs[b][1])
            both = len(sets[a] & sets[b])
            if same or sets[a] and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                root[find(a)] = find(b)
    groups = {}
    for k in range(len(pairs)):
        groups.setdefault(find(k), []).append(k)
    big = 1 << 62
    return sorted(
        ((pairs[k][0], min((pairs[m][0] if pairs[m][0] is not None else big) for m in g) % big or (0 if any(pairs[m][0] == 0 for m in g) else None), len(g))
         for g in groups.values() for k in g), key=str)


def near_copies(seed):
    rng = random.Random(seed)
    docs = []
    for base in range(6):
        text = [f"{rng.choice('abcdef')}{rng.randint(0, 500)}" for _ in range(rng.choice([8, 60, 200]))]
        for _ in range(rng.randint(2, 12)):
            copy = list(text)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 5, 12])):
                copy[rng.randrange(len(copy))] = f"e{rng.randint(0, 99999)}"
            docs.append((len(docs) + 1, rng.choice([" ", "\n"]).join(copy)))
    return docs + [(900, "one two"), (901, "One  two"), (902, None), (903, ""), (904, " "), (905, "solo"), (1, docs[0][1]), (None, docs[2][1])]


@pytest.mark.parametrize("seed,by_count", [(1, False), (2, False), (3, True)])
def test_near_classes_by_hand(spark, seed, by_count):
    docs = near_copies(seed)
    got = dartminhash.near_classes(frame(spark, docs), by_count=by_count, growth=2).collect()
    assert sorted(((r.doc_id, r.class_id, r.class_size) for r in got), key=str) == classes_by_hand(docs, by_count)
    assert sum(r.kept for r in got) == len({(r.class_id, r.class_size) for r in got if r.class_id not in (902, 904)}) + 2


def test_near_keeps_one_row_of_each_class(spark):
    docs = near_copies(4)
    kept = dartminhash.near_deduplicated(frame(spark, docs)).collect()
    verdicts = dartminhash.near_classes(frame(spark, docs)).where("kept").collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(r.doc_id) for r in verdicts)
    assert dartminhash.near_deduplicated(frame(spark, docs).limit(0)).count() == 0


def test_signatures_agree_as_often_as_sets_do():
    import numpy as np

    rng = np.random.default_rng(0)
    pool = rng.integers(1, 1 << 62, 3000).astype(np.uint64)
    a, b = pool[:1000], pool[200:1200]  # Jaccard 800 / 1200
    row = np.repeat([0, 1], 1000)
    sig = dartminhash.signatures(row, np.concatenate([a, b]), np.array([1000, 1000]), 2048)
    assert abs((sig[0] == sig[1]).mean() - 2 / 3) < 0.04
    small = dartminhash.signatures(np.array([0]), pool[:1], np.array([1, 0]), 128)
    assert (small[0] != 0).all() and (small[1] == 0).all()


def test_components_of_a_chain_and_a_cycle(spark):
    from pagewright.llm.components import components

    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    got = dict(components(spark.createDataFrame(edges, "u bigint, v bigint")).collect())
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 102: 100}
