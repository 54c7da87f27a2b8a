import random
import re
from collections import defaultdict

import xxhash

from gatehouse.llm import queries, simhash
from gatehouse.llm.components import chained, components
from gatehouse.llm._scratch import Scratch


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius=2):
    ids = [i for i, _ in prints]
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(prints):
        for j, b in prints[:n]:
            if (a ^ b).bit_count() <= radius:
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: root(i) for i in ids}


def test_fingerprint_matches_plain_version():
    texts = [None, "", " \t\n", "One", "one TWO", "É a b c", "a b c a b c d", "x\x1cy z w", "w " * 500, "Straße ÄÖ ab cd"]
    for t in texts:
        assert simhash.fingerprint(t) == plain_fingerprint(t), t


def test_bk_tree_finds_all_within_radius():
    rng = random.Random(1)
    centre = rng.getrandbits(64)
    values = list({centre ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(6))) for _ in range(400)})
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for q in values[:50] + [rng.getrandbits(64)]:
        assert {tree.values[n] for n in tree.within(q, 2)} == {v for v in values if (v ^ q).bit_count() <= 2}


def test_documents_against_brute_force(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choice(words) for _ in range(120)) for _ in range(12)]
    rows = [(0, None), (1, ""), (2, "only"), (3, "two words"), (4, base[0]), (4, base[0])]
    for i in range(5, 120):
        text = base[i % 12].split()
        for _ in range(rng.randrange(3)):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], "doc_id long, text string, fp string, keeper int")
    for shard_rows in (4, 512):
        got = simhash.near_duplicates(docs, shard_rows=shard_rows).collect()
        assert len(got) == len(rows)
        want = plain_components([(i, plain_fingerprint(t)) for i, t in dict(rows).items()])
        text = dict(rows)
        for r in got:
            assert int(r.fingerprint, 16) == plain_fingerprint(text[r.doc_id])
            assert r.component_id == want[r.doc_id]
    kept = simhash.near_duplicates(docs, carry=True)
    assert [c for c in kept.columns] == ["doc_id", "text", "fp", "fingerprint", "component_id", "keeper"]
    keepers = [r.doc_id for r in kept.where("keeper").collect()]
    assert sorted(keepers) == sorted(set(want.values()))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).collect() == []


def test_components_of_paths_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    groups = defaultdict(set)
    for n, c in got.items():
        groups[c].add(n)
    assert groups == {0: set(range(41)), 100: set(range(100, 140)), 200: {200, 201, 202}}


def test_similarity_against_all_pairs(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(5000)]
    rows = [(0, None, "x"), (1, "", "x"), (2, "a b", "x"), (3, "a b", "y"), (4, "a c", "x")]
    for group in range(40):
        base = [rng.choice(words) for _ in range(200)]
        for _ in range(3):
            text = list(base)
            for _ in range(rng.randrange(7)):
                text[rng.randrange(200)] = rng.choice(words)
            rows.append((len(rows), " ".join(text), "x"))
    grams = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").split()) else set() for i, t, _ in rows}
    parent = {i: i for i, _, _ in rows}
    for n, (i, _, _) in enumerate(rows):
        for j, _, _ in rows[:n]:
            a, b = grams[i], grams[j]
            if a == b or len(a & b) >= 0.8 * len(a | b):
                x, y = sorted((parent[i], parent[j]))
                parent = {k: x if v == y else v for k, v in parent.items()}
    docs = spark.createDataFrame(rows, "doc_id long, text string, keeper string")
    for shard_rows in (8, 512):
        got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, carry=True, shingle=5, similarity=0.8, shard_rows=shard_rows).collect()}
        assert all(parent[i] == parent[c] for i, c in got.items())  # never too much
        assert sum(got[i] == parent[i] for i in got) >= 0.98 * len(rows)


def similar_pairs(rng, n, size=204, edits=4):
    """Pairs of texts of 200 shingles of five words whose similarity is 0.8 or just above."""
    out = []
    for i in range(n):
        left = [f"w{i}_{rng.randrange(10**6)}" for _ in range(size)]
        right = list(left)
        for k in range(edits):
            right[20 + 40 * k] = f"edit{i}_{k}"
        out.append((" ".join(left), " ".join(right[:size - 1])))  # 4 edits cost 5 shingles each, the cut one more
    return out


def test_recall_at_the_similarity_does_not_depend_on_the_corpus(spark):
    bands = simhash.band_count(0.8, 1e-4)
    assert (1 - 0.8**simhash._PER_BAND) ** bands <= 1e-4 < (1 - 0.8**simhash._PER_BAND) ** (bands - 1)
    pairs = similar_pairs(random.Random(3), 300)
    grams = lambda t: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)}
    for a, b in pairs:
        assert 0.8 <= len(grams(a) & grams(b)) / len(grams(a) | grams(b)) < 0.82
    rows = [(2 * i + k, t) for i, p in enumerate(pairs) for k, t in enumerate(p)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.near_duplicates(docs, carry=True, shingle=5, similarity=0.8).collect()
    assert sum(r.component_id == r.doc_id - r.doc_id % 2 for r in got) == len(rows)


def test_one_group_of_edited_copies_against_brute_force(spark):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(5000)]
    base = [rng.choice(words) for _ in range(200)]
    texts = []
    for _ in range(300):
        text = list(base)
        for _ in range(rng.randrange(3, 8)):
            text[rng.randrange(200)] = rng.choice(words)
        texts.append(text)
    grams = [{tuple(t[k : k + 5]) for k in range(196)} for t in texts]
    want = list(range(300))
    links = 0
    for i in range(300):
        for j in range(i):
            if len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j]):
                links += 1
                a, b = sorted((want[i], want[j]))
                want = [a if x == b else x for x in want]
    assert links > 40 and len(set(want)) > 100
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    for shard_rows in (40, 512):
        got = simhash.near_duplicates(docs, carry=True, shingle=5, similarity=0.8, shard_rows=shard_rows).collect()
        assert {r.doc_id: r.component_id for r in got} == dict(enumerate(want))


def test_texts_of_one_repeated_phrase_stay_apart(spark):
    rows = [(i, "very common phrase " * 200 + " ".join(f"own{i}_{k}" for k in range(150))) for i in range(4)]
    rows += [(4, rows[0][1].upper().replace(" ", "\n")), (5, rows[1][1] + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in simhash.near_duplicates(docs, carry=True, shingle=5, similarity=0.8).collect()}
    assert {i: r.component_id for i, r in got.items()} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 0, 5: 1}


def test_texts_of_one_fingerprint_stay_apart(spark):
    rows = [(i, "again " * 400 + " ".join(f"own{i}_{k}" for k in range(150))) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.near_duplicates(docs, carry=True, shingle=5, similarity=0.8).collect()
    assert len({r.fingerprint for r in got}) == 1
    assert {r.doc_id: r.component_id for r in got} == {0: 0, 1: 1, 2: 2}


def test_chains_join_what_the_edges_join(spark):
    rng = random.Random(9)
    edges = [(leaf, rng.randrange(5) if leaf % 2 else 500 + rng.randrange(3)) for leaf in range(10, 400) for _ in range(12)]
    df = spark.createDataFrame(edges, "a long, b long")
    thin = chained(df)
    assert thin.count() < 420
    scratch = Scratch(spark, "test")
    assert {tuple(r) for r in components(thin, scratch).collect()} == {tuple(r) for r in components(df, scratch).collect()}


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    prints = [(r.doc_id, plain_fingerprint(r.text)) for r in docs]
    want = plain_components(prints)
    got = queries.op8_simhash(spark, sf)
    assert got.columns[:3] == ["doc_id", "fingerprint", "component_id"]
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got.collect()} == {(i, f"{p:016x}", want[i]) for i, p in prints}


def test_a_very_long_text_among_short_ones(spark):
    text = " ".join(f"w{i * i % 7919}" for i in range(200_000))
    docs = spark.createDataFrame([(1, text), (2, text + " end"), (3, "short")], "doc_id long, text string")
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert got[1].fingerprint == f"{plain_fingerprint(text):016x}" and got[2].component_id == 1 and got[3].component_id == 3
