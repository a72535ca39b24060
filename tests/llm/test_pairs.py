"""Joins of shingles and vectors, components, URL cascades."""

import random

import numpy as np
import pytest

from kvloom.llm import graph, queries, shingles, trie, url_filter, vectors
from tests.conftest import SF
from tests.llm.fixtures import LONG, ROWS, docs, empty
from tests.rows import of_duck, of_spark


def closure(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("in_task", [True, False])
def test_components(spark, monkeypatch, in_task):
    if not in_task:
        monkeypatch.setattr(graph, "EDGES", 3)
    rng = random.Random(7)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 130)] + [(200, i) for i in range(201, 240)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = closure({n for p in links for n in p}, links)
    assert {n: c for n, c in got.items()} == {n: want[n] for n in got}
    assert {n for a, b in links if a != b for n in (a, b)} == set(got)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingle_sets(rows):
    out = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out.setdefault(i, []).append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    return out


def brute_force(rows):
    sets = [(i, s) for i, many in shingle_sets(rows).items() for s in many if s and i is not None]
    links = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[k + 1 :] if 100 * len(x & y) >= 75 * len(x | y)]
    return closure({i for i, _ in rows if i is not None}, links)


def near_copies(seed, bases=6, copies=12):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(40)]
    rows = []
    for _ in range(bases):
        base = [word() for _ in range(rng.choice([4, 30, 80]))] + (passage if rng.random() < 0.7 else [])
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = word()
            rows.append((len(rows), " ".join(w)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,block", [(1, 2000), (2, 4), (3, 4), (4, 3)])
def test_join_equals_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(shingles, "BLOCK", block)
    monkeypatch.setattr(shingles, "PIVOTS", 2)
    monkeypatch.setattr(shingles, "HOT", 5)
    rows = near_copies(seed)
    got = shingles.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_force(rows)
    sets = shingle_sets(rows)
    assert all(r["n_shingles"] == len(sets[r["doc_id"]][0]) for r in got)


def test_many_batches_and_hot_shingles(spark, monkeypatch):
    monkeypatch.setattr(shingles, "BATCH_SHINGLES", 200)
    monkeypatch.setattr(shingles, "HOT", 3)
    rows = near_copies(9, bases=8, copies=15)
    got = shingles.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_force(rows)


def test_join_edge_cases(spark):
    got = shingles.near_duplicates(docs(spark)).collect()
    want = brute_force([(i, t) for i, t, _ in ROWS])
    assert len(got) == len(ROWS)
    for r in got:
        assert r["component_id"] == want.get(r["doc_id"])
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_shingles"] == by[2]["n_shingles"] == by[3]["n_shingles"] == 0 and by[4]["n_shingles"] == 1
    assert by[2]["component_id"] == 2 and by[7]["component_id"] == 6 and by[10]["component_id"] == 9
    assert shingles.near_duplicates(empty(spark)).count() == 0


def test_an_id_of_several_texts_is_one_document(spark):
    a, b, c = ("one two three four five six seven eight nine ten " + x for x in ("alpha", "beta", "gamma delta epsilon zeta eta theta iota kappa"))
    rows = [(3, a), (5, a), (5, c), (9, c), (7, "alone here"), (5, "nothing like it"), (5, ""), (8, b), (8, b), (6, "x"), (6, None)]
    got = shingles.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == sorted((i, brute_force(rows)[i]) for i, _ in rows)
    assert brute_force(rows)[9] == 3


@pytest.mark.parametrize("size", [1, 50])
def test_many_ranges(spark, monkeypatch, size):
    monkeypatch.setattr(shingles, "RANGE_SHINGLES", size)
    monkeypatch.setattr(shingles, "TASK_SETS", 5)
    rows = near_copies(11, bases=4, copies=8)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert shingles.ranges_for(df, shingles.F.octet_length("text") / shingles.TEXT_BYTES) >= 64
    assert {r["doc_id"]: r["component_id"] for r in shingles.near_duplicates(df).collect()} == brute_force(rows)


def test_trie_prunes_and_finds():
    rng = random.Random(3)
    tokens = [sorted(rng.sample(range(30), rng.randrange(1, 25))) for _ in range(80)]
    sizes = [len(t) for t in tokens]
    sets = graph.Sets(len(tokens))
    trie.similar(tokens, sizes, range(len(tokens)), 75, sets)
    links = [(a, b) for a in range(80) for b in range(a) if 100 * len(set(tokens[a]) & set(tokens[b])) >= 75 * len(set(tokens[a]) | set(tokens[b]))]
    assert {i: sets.find(i) for i in range(80)} == closure(range(80), links)


# vectors


def vector_rows(seed, n=160, width=24):
    rng = np.random.RandomState(seed)
    centre = rng.normal(size=(8, width))
    rows = []
    for i in range(n):
        v = centre[rng.randint(8)] + rng.normal(size=width) * rng.choice([0.05, 0.25, 1.5])
        rows.append((i, [float(x) for x in v]))
    rows += [(n + k, list(rows[k][1])) for k in range(10)]  # copies
    rows += [(n + 10, [2 * x for x in rows[3][1]])]  # the same direction
    bad = [None, [0.0] * width, [float("nan")] * width, [float("inf"), *[1.0] * (width - 1)], [None, *[1.0] * (width - 1)], [1.0, 2.0], []]
    return rows, [(n + 20 + k, v) for k, v in enumerate(bad)]


def vector_brute_force(rows):
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    s = x @ x.T >= 0.95
    np.fill_diagonal(s, False)
    ids = [i for i, _ in rows]
    groups = closure(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(s), strict=True)])
    return {i: (int(k), groups[i]) for i, k in zip(ids, s.sum(1), strict=True)}


def single(v):
    """Components as an array<float> column keeps them."""
    return None if v is None else [None if x is None else float(np.float32(x)) for x in v]


@pytest.mark.parametrize("kind,seed,cell", [("double", 1, 1 << 20), ("float", 2, 1 << 20), ("float", 3, 24 * 40), ("double", 4, 24 * 10), ("float", 5, 24)])
def test_vectors_equal_brute_force(spark, monkeypatch, kind, seed, cell):
    monkeypatch.setattr(vectors, "CELL", cell)
    monkeypatch.setattr(vectors, "LEAF", 5)
    good, bad = vector_rows(seed)
    if kind == "float":
        good = [(i, single(v)) for i, v in good]
    df = spark.createDataFrame([(i, v, 0, 1) for i, v in good + bad], f"vec_id long, embedding array<{kind}>, label int, links int").repartition(3)
    want = vector_brute_force(good) | {i: (0, i) for i, _ in bad}
    got = vectors.near_vectors(df).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert sum(k for k, _ in want.values()) > 50


@pytest.mark.parametrize("cell", [1 << 20, 300])
def test_vectors_of_every_length_are_joined(spark, monkeypatch, cell):
    monkeypatch.setattr(vectors, "CELL", cell)
    rows, want = [], {}
    for k, width in enumerate((1, 2, 3, 24, 33)):
        good = [(i + 1000 * k, single(v)) for i, v in vector_rows(k, n=60, width=width)[0]]
        rows += good
        want |= vector_brute_force(good)
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == want


def test_vectors_whose_coordinates_tie(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CELL", 16 * 50)
    rng = np.random.RandomState(4)
    x = rng.choice([-1.0, 1.0], (300, 16))
    x[100:200] = x[:100]
    x[200:, 3:] = x[:100, 3:]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == vector_brute_force(rows)
    t = vectors.rotate(x)[:, :4]
    home = vectors.Cells(t, 4).home(t, np.arange(300))
    assert np.bincount(home, minlength=16).max() <= 60


def test_cells_reach_whatever_is_near():
    rng = np.random.RandomState(5)
    for x in (rng.normal(size=(400, 6)), rng.choice([0.0, 1.0], (400, 6)), np.zeros((400, 6))):
        cells = vectors.Cells(x[:100], 7)
        home = cells.home(x, np.arange(400))
        row, cell = cells.reached(x, 0.5)
        reached = set(zip(row.tolist(), cell.tolist(), strict=True))
        assert len(reached) == len(row)
        near = ((x[:, None] - x[None]) ** 2).sum(2) <= 0.5
        assert all((i, home[k]) in reached for i, k in zip(*np.nonzero(near), strict=True))
        for y in (None, x[200:]):
            a = x[:200]
            got = {(int(i[p]), int(k[q])) for i, k, near_ in vectors.meetings(a, y, 0.5) for p, q in zip(*np.nonzero(near_), strict=True)}
            d = ((a[:, None] - (a if y is None else y)[None]) ** 2).sum(2)
            want = {(int(p), int(q)) for p, q in zip(*np.nonzero(d <= 0.5 - 1e-4), strict=True)}
            some = {(int(p), int(q)) for p, q in zip(*np.nonzero(d <= 0.5 + 1e-4), strict=True)}
            if y is None:
                assert not any((q, p) in got for p, q in got)
                got, want = got | {(q, p) for p, q in got}, {(p, q) for p, q in want if p != q}
            assert want <= got <= some


def test_rotation_keeps_lengths():
    x = np.random.RandomState(1).normal(size=(20, 13))
    t = vectors.rotate(x)
    assert t.shape == (20, 16) and np.allclose((t * t).sum(1), 1)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    assert np.allclose(t @ t.T, u @ u.T)


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vectors.near_vectors(none).count() == 0
    null = spark.createDataFrame([(1, None), (1, None)], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in vectors.near_vectors(null).collect()] == [(1, 0, 1, True)] * 2


# URLs


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, rule int")


def judged(spark, urls, listed, rules=None):
    keys = spark.createDataFrame([(k,) for k in listed], "key string")
    return url_filter.filter_urls(pages(spark, urls), url_filter.RULES if rules is None else rules, keys)


def test_url_parts_and_rules(spark):
    urls = ["HTTP://WWW.Example.ORG/es/x?q=1#z", "https://a.org", "http://a.com/de/1", "http://x.com/fr/", "nothing", None, "", "x://?a/b", "s://H.net#a://b/c", "http://org/", "http://notorg/", "https://sub.example.org/en/12", "http://a.org?x://y/es/"]
    rows = judged(spark, urls, ["h.net"]).orderBy("page_id").collect()
    got = [(r["host"], r["path"], r["rule"], r["verdict"]) for r in rows]
    assert got[0] == ("www.example.org", "/es/x", "example.org/es/", "block")
    assert got[1] == ("a.org", "", None, "allow") and got[2][2:] == ("com/de/", "block") and got[3][2:] == ("com/fr/", "allow")
    assert got[4] == got[5] == got[6] == ("", "", None, "allow") and got[7] == ("", "", None, "allow")
    assert got[8] == ("h.net", "", None, "block") and got[9][2:] == ("org/", "allow") and got[10][2] is None
    assert got[11][2:] == ("example.org/en/1", "block") and got[12][:2] == ("a.org", "")


@pytest.mark.parametrize("seed,most", [(1, None), (3, 30)])
def test_cascade_is_exact(spark, monkeypatch, seed, most):
    if most is not None:
        monkeypatch.setattr(url_filter, "MOST_BYTES", most)  # then there are several cascades
    rng = random.Random(seed)
    hosts = [".".join("".join(rng.choice("abc") for _ in range(3)) for _ in range(rng.randrange(1, 4))) for _ in range(700)]
    listed = rng.sample(hosts, 60) + ["absent.host", hosts[0].upper()]
    rows = judged(spark, [f"http://{h}/p" for h in hosts], listed, rules=[]).collect()
    low = {k.lower() for k in listed}
    for r in rows:
        assert (r["verdict"] == "block") == any(s in low for s in url_filter.suffixes(r["host"]))
    assert len({r["verdict"] for r in rows}) == 2


def test_cascades_follow_the_listed_keys(spark, monkeypatch):
    keys = spark.range(6000).selectExpr("concat('k', id) AS key", "id % 60 = 0 AS listed")
    (one,) = url_filter.cascades(keys)
    assert one.bytes < 6000 / 8 and one.listed([f"k{i}" for i in range(6000)]).tolist() == [i % 60 == 0 for i in range(6000)]
    monkeypatch.setattr(url_filter, "MOST_BYTES", 60)
    many = url_filter.cascades(keys)
    assert len(many) > 2
    got = {r["key"]: r["p"] for r in keys.selectExpr("key", f"pmod(xxhash64(key), {len(many)}) AS p").collect()}
    for k, part in got.items():
        assert url_filter.part_of(k, len(many)) == part and many[part].listed([k])[0] == (int(k[1:]) % 60 == 0)


def test_url_edge_cases(spark):
    assert judged(spark, [], ["a.b"]).count() == 0
    assert [r["verdict"] for r in judged(spark, ["http://a.b/", "http://a.b/"], []).collect()] == ["allow"] * 2


def test_url_query_equals_sql(spark, duck):
    assert of_spark(queries.QUERIES["op9_url_filter"](spark, SF)) == of_duck(duck.sql(queries.ORACLES["op9_url_filter"]))


def test_long_text_is_one_document(spark):
    out = shingles.near_duplicates(spark.createDataFrame([(1, LONG), (2, LONG + " end")], "doc_id long, text string")).collect()
    assert {r["component_id"] for r in out} == {1}
