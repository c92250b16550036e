import random

import brute
import pytest

from frameline.llm.decontaminate import find_leaks
from frameline.llm.links import component_roots
from frameline.llm.ngram_join import allocate, bands, jaccard_components


def near_copies(n, seed=3):
    """A large group of near copies of one text, some linked only through others."""
    r = random.Random(seed)
    base = [f"w{r.randrange(500)}" for _ in range(120)]
    out = []
    for k in range(n):
        w = list(base)
        for _ in range(r.randrange(6)):
            w[r.randrange(len(w))] = f"x{r.randrange(9)}"
        out.append((1000 + k, " ".join(w)))
    return out


@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80), (1, 50)])
def test_components_equal_all_pairs(spark, n, num):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{brute.SF}/documents.parquet").collect()] + near_copies(60)
    rows += [(5000, None), (5001, ""), (5002, " \t "), (5003, "One"), (5004, "one"), (5005, "one two"), (5006, "a b c d e f g h i j k l"), (5007, "a b c d e f g h i j k l m"), (5008, "ONE TWO"), (5008, "one two")]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, sig int, node int").repartition(5)
    got = jaccard_components(docs, "doc_id", "text", n, num, 100).collect()
    want = brute.components(rows, n, num, 100)
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    sizes = sorted((i, len(brute.shingles(t, n))) for i, t in rows)
    assert sorted((r["doc_id"], r["n_shingles"]) for r in got) == sizes


def test_join_of_rows_without_ids_and_of_nothing(spark):
    docs = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (2, "a b c")], "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"]) for r in jaccard_components(docs, "doc_id", "text").collect()}
    assert got == {(None, None), (1, 1), (2, 1)}
    assert jaccard_components(docs.limit(0), "doc_id", "text").count() == 0


def test_allocation_moves_to_deletions_as_a_band_grows():
    every = bands(80, 100)
    few, many = allocate(every, {8: 100}), allocate(every, {8: 10**10})
    assert few[8].twice == 0 and many[8].twice > 0
    assert all(b.segments + b.twice == b.differ + 1 for b in many)


def test_deletion_neighbourhoods_lose_no_link(spark, monkeypatch):
    from frameline.llm import ngram_join

    monkeypatch.setattr(ngram_join, "allocate", lambda every, sizes: [ngram_join.Band(b.low, b.high, b.differ, (b.differ + 1) // 2) for b in every])
    rows = near_copies(50, 9)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(docs, "doc_id", "text").collect()}
    assert got == brute.components(rows, 3, 90, 100)


def test_roots_of_chains_and_repeats(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 300), (None, 4)]
    got = {r["node"]: r["root"] for r in component_roots(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(1, 41)} | {101: 100, 300: 200}
    assert component_roots(spark.createDataFrame([], "a long, b long")).count() == 0


def test_leaks_equal_all_windows(spark):
    docs, items = (spark.read.parquet(f"{brute.SF}/{t}.parquet") for t in ("documents", "benchmark"))
    item_rows = [(r["item_id"], r["text"]) for r in items.collect()]
    w = brute.words(item_rows[0][1])
    doc_rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    doc_rows += [(9001, None), (9002, ""), (9003, item_rows[1][1].upper()), (9004, "pre fix " + " ".join(w) + " post"), (9005, " ".join(w[:-1])), (9006, " ".join(w[: len(w) // 2])), (9007, " ".join([*w[:-2], "other", *w[-2:]]))]
    item_rows += [(901, None), (902, "too short"), (903, item_rows[0][1])]
    given = spark.createDataFrame([(i, t, 0) for i, t in doc_rows], "doc_id long, text string, start int")
    got = find_leaks(given.union(given.filter("doc_id = 9003")), "doc_id", "text", spark.createDataFrame(item_rows, "item_id long, text string"), "item_id", "text")
    found = {(r["doc_id"], r["item_id"]): r["similarity"] for r in got.collect()}
    want = brute.leaks(doc_rows, item_rows)
    assert set(found) == set(want) and {(9003, 1), (9004, 0), (9004, 903)} <= set(found)
    assert not [k for k in want if abs(found[k] - want[k]) > 1e-9]


def test_leaks_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    none = docs.limit(0)
    assert find_leaks(docs, "doc_id", "text", none, "doc_id", "text").count() == 0
    assert find_leaks(none, "doc_id", "text", docs, "doc_id", "text").count() == 0


def test_leaks_that_no_shared_shingle_aligns(spark):
    """Documents near the threshold, among them ones that reach it only between the starts that shared shingles name."""
    r = random.Random(11)
    items = [(k, " ".join(f"i{k}x{j}" for j in range(size))) for k, size in enumerate((64, 64, 40, 90, 25, 9, 5))] + [(50, " ".join("a b c d e f".split() * 9))]
    docs = []
    for k, text in items:
        w = text.split()
        for changes in range(7):
            for _ in range(6):
                v = list(w)
                for _ in range(changes):
                    at = r.randrange(len(v))
                    v[at : at + r.randrange(2)] = [f"n{r.randrange(99)}"] * r.randrange(3)
                docs.append((len(docs), " ".join([*(f"p{r.randrange(50)}" for _ in range(r.randrange(30))), *v, *(f"s{j}" for j in range(r.randrange(30)))])))
        if len(w) == 64:
            v = ["first", *w[1:31], "in", "two", *w[31:-1], "last"]
            docs += [(len(docs) + j, " ".join([*(f"p{j}{x}" for x in range(10 * j)), *v, "and", "more", "words"])) for j in range(4)]
    want = brute.leaks(docs, items)
    assert sum(0.8 <= x < 0.83 for x in want.values()) >= 8 and len(docs) > len(want) > 100
    schema = "id long, text string"
    got = {(x["doc_id"], x["item_id"]): x["similarity"] for x in find_leaks(spark.createDataFrame(docs, schema), "id", "text", spark.createDataFrame(items, schema), "id", "text").collect()}
    assert got == pytest.approx(want)


def test_leaks_in_long_and_repeated_texts(spark):
    item = " ".join(f"w{k}" for k in range(30))
    long = " ".join(["x y z"] * 20_000) + " " + " ".join([item] * 40) + " " + " ".join(["q r"] * 20_000)
    docs = spark.createDataFrame([(1, long), (1, "other text of the same id"), (1, "other text of the same id"), (2, item), (2, item), (3, None)], "doc_id long, text string")
    got = find_leaks(docs, "doc_id", "text", spark.createDataFrame([(7, item), (7, item), (8, "x y z x y z x y z")], "item_id long, text string"), "item_id", "text").collect()
    assert sorted((x["doc_id"], x["item_id"], x["similarity"], x["word_start"]) for x in got) == [(1, 7, 1.0, 60_000), (1, 8, 1.0, 0), (2, 7, 1.0, 0)]


def test_fingerprints_within_the_radius_always_meet(spark):
    from frameline.llm.decontaminate import PRINT, RADIUS, near_fingerprints

    r = random.Random(5)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    words = lambda x: [signed((x >> (64 * k)) & ((1 << 64) - 1)) for k in range(len(PRINT))]
    base = r.getrandbits(64 * len(PRINT))
    rows = []
    for apart in range(100):
        x = base
        for b in r.sample(range(64 * len(PRINT)), apart):
            x ^= 1 << b
        rows.append((apart, 9, *words(x)))
    prints = ", ".join(f"{f} long" for f in PRINT)
    windows = spark.createDataFrame([*rows, (500, 8, *words(base))], f"window long, size int, {prints}")
    items = spark.createDataFrame([(1, 9, *words(base))], f"item long, size int, {prints}")
    assert {x["window"] for x in near_fingerprints(windows, items).collect()} == set(range(RADIUS + 1))


def test_spanning_pairs_join_what_all_pairs_join_and_take_the_nearest():
    import numpy as np

    from frameline.llm.ngram_join import _spanning

    def groups(a, b):
        root = list(range(60))
        for x, y in zip(a, b, strict=True):
            old, new = root[x], root[y]
            root = [new if r == old else r for r in root]
        return root

    rng = np.random.default_rng(3)
    for n in (1, 5, 40, 400):
        a, b = rng.integers(0, 60, (2, n))
        far = rng.integers(0, 4, n).astype(float)  # many ties
        kept = _spanning(a, b, far)
        every, some = groups(a, b), groups(a[kept], b[kept])
        assert all((every[i] == every[j]) == (some[i] == some[j]) for i in range(60) for j in range(60))
        assert kept.size == 60 - len(set(every))
        least, root = 0.0, list(range(60))  # weight of a least forest, by taking pairs in order
        for k in np.argsort(far, kind="stable"):
            x, y = root[a[k]], root[b[k]]
            if x != y:
                least += far[k]
                root = [y if r == x else r for r in root]
        assert far[kept].sum() == least


def test_group_of_copies_that_differ_from_their_first_is_one_component(spark):
    """Copies in a long chain, each near to the next one only, among many that nearly link: nothing may be lost to the spanning pairs."""
    import random

    from frameline.llm.ngram_join import jaccard_components

    rng = random.Random(8)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(120):
        words = list(base)
        for k in rng.sample(range(90), rng.choice([0, 1, 2, 3])):
            words[k] = f"x{i}_{k}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_components(docs, "doc_id", "text", n=5, num=80, den=100).collect()}
    sets = [{tuple(t.split()[k : k + 5]) for k in range(86)} for _, t in rows]
    root = list(range(120))
    for i in range(120):
        for j in range(i):
            if len(sets[i] & sets[j]) * 100 >= 80 * len(sets[i] | sets[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    assert got == {i: root[i] for i in range(120)} and 1 < len(set(root)) < 120


def test_index_rows_meet_across_packs(spark, monkeypatch):
    """Buckets of many packs, index rows that very many nodes have, and rows that one node has twice."""
    from frameline.llm import ngram_join

    for name, rows in (("PACK", 400), ("BUCKET", 150), ("CUT", 16)):
        monkeypatch.setattr(ngram_join, name, rows)
    r = random.Random(5)
    rows = [(k, 10 * k, k, [7, -(1 << 63), *sorted(r.sample(range(-3000, 3000), 6))] if k % 3 else [k + 10**6]) for k in range(1500)]
    rows += [(k, d1, d2, sigs) for k, d1, d2, sigs in rows if k % 50 == 0] + [(9, -1, -1, [5, 7]), (4000, 8, 8, [7, 4001])]  # repeated rows, and two that are no nodes
    index = spark.createDataFrame(rows, "doc_id long, d1 long, d2 long, sigs array<long>").repartition(7)
    got = ngram_join.met_nodes(index, spark.createDataFrame([(k, 10 * k, k) for k in range(1500)], "node long, d1 long, d2 long"))
    nodes = {}
    for k, d1, d2, sigs in rows:
        if (d1, d2) == (10 * k, k):
            for s in sigs:
                nodes.setdefault(s, set()).add(k)
    want = [(s, k, min(own)) for s, own in nodes.items() if len(own) > 1 for k in own]
    assert sorted(map(tuple, got.select("sig", "node", "center").collect())) == sorted(want) and len(nodes[7]) == 1000
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "explode" not in plan.lower() and "HashAggregate" not in plan  # no row of Spark's for each index row
    assert ngram_join.met_nodes(index.limit(0), index.select("doc_id", "d1", "d2").toDF("node", "d1", "d2")).count() == 0


def test_index_rows_of_a_document_do_not_grow_with_the_corpus():
    """Sixty times the documents take as many index rows each, and hardly any of these meet by chance."""
    from frameline.llm.ngram_join import _at_least, chance_rows, index_rows

    every, few = bands(80, 100), {k: 1000 for k in range(5, 30)}
    many = {k: 60 * n for k, n in few.items()}
    rows = [sum(n * index_rows(allocate(every, sizes)[k]) for k, n in sizes.items()) / sum(sizes.values()) for sizes in (few, many)]
    assert rows[0] <= rows[1] < 1.03 * rows[0]
    assert all(chance_rows(allocate(every, sizes)[k]) < 2 for sizes in (few, many) for k in sizes)
    assert abs(_at_least(2, 10, 0.1) - 0.2639010709) < 1e-9 and _at_least(11, 10, 0.1) < 1e-9 and _at_least(0, 10, 0.1) == 1


def test_index_rows_are_not_written_as_a_table(spark, monkeypatch):
    from frameline.llm import ngram_join

    kinds = []
    monkeypatch.setattr(ngram_join, "written", lambda df, label, f=ngram_join.written: kinds.extend(t for _, t in df.dtypes) or f(df, label))
    rows = [*near_copies(40, 4), (7, "one text of several words"), (7, "another text under the same id"), (8, "another text under the same id"), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in ngram_join.jaccard_components(docs, "doc_id", "text").collect()}
    assert {i: c for (i, _), c in got.items() if i >= 1000} == brute.components(rows[:40], 3, 90, 100)
    assert got[7, 3] == got[7, 4] == got[8, 4] == 7 and got[9, 0] == 9
    assert kinds and not [k for k in kinds if k.startswith("array")]


def test_packed_numbers_come_back():
    import numpy as np
    import pyarrow as pa

    from frameline.llm.ngram_join import _numbers, _planes

    x = np.array([0, -1, 1 << 62, -(1 << 63), 77], np.int64)
    for part in (x, x[1:3], x[:0]):
        assert _numbers(pa.scalar(_planes(part), pa.binary())).tolist() == part.tolist()
