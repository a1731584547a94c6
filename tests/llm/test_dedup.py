import hashlib
import itertools
import math
import random
import time
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewright.llm import blocks, common, embedding_dedup, exact_dedup, simhash_dedup
from tidewright.sources import scratch


def closure(nodes, links):
    """Smallest reachable node of each node, by plain search."""
    near = {n: {n} for n in nodes}
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    out = {}
    for n in nodes:
        seen, todo = {n}, [n]
        while todo:
            for m in near[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        out[n] = min(seen)
    return out


def test_components_of_paths_stars_and_pairs(spark):
    links = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(200, 201), (201, 200), (300, 300)]
    scratch = common.Scratch(spark, "t")
    got = {r["node"]: r["root"] for r in common.components(scratch, spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {n for ab in links for n in ab} - {300}
    assert got == {n: r for n, r in closure(nodes, [x for x in links if x != (300, 300)]).items()}
    empty = common.components(common.Scratch(spark, "t"), spark.createDataFrame([], "a long, b long"))
    assert empty.count() == 0 and empty.columns == ["node", "root"]


def test_local_components():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 60, 40), rng.integers(0, 60, 40)
    want = closure(range(60), list(zip(a.tolist(), b.tolist(), strict=True)))
    assert common.local_components(60, a, b).tolist() == [want[k] for k in range(60)]


def test_blocked_meets_every_pair(spark):
    rows = spark.createDataFrame([(1, k) for k in range(23)] + [(2, 50), (2, 51)], "key int, node long")
    got = blocks.blocked(rows, ["key"], "node", 5).collect()
    groups = {}
    for r in got:
        groups.setdefault((r["key"], r["bi"], r["bj"]), []).append((r["node"], r["block"]))
    met = set()
    for (key, i, j), members in groups.items():
        for (a, x), (b, y) in itertools.combinations(members, 2):
            if {x, y} == {i, j}:
                met.add((key, *sorted((a, b))))
    assert met == {(1, a, b) for a, b in itertools.combinations(range(23), 2)} | {(2, 50, 51)}


def near_vectors():
    rng = np.random.default_rng(5)
    base = rng.standard_normal((30, 8))
    rows = []
    for k, v in enumerate(base):
        rows.append((v, k % 3))
        for s in range(k % 4):
            rows.append((v + rng.standard_normal(8) * 0.08 * s, k % 3))
    rows += [(base[0], 0), (base[0] * 3, 0), (base[0], 1)]
    return [(i, [float(x) for x in v], int(lab)) for i, (v, lab) in enumerate(rows)]


@pytest.mark.parametrize("bucket_rows,block_rows", [(128, 1024), (4, 6)])
def test_embeddings_against_brute_force(spark, bucket_rows, block_rows):
    rows = near_vectors()
    nan, inf = float("nan"), float("inf")
    odd = [(900, None, 0), (901, [0.0] * 8, 0), (902, [nan] * 8, 0), (903, [1.0, None] + [0.0] * 6, 0), (904, [inf] + [0.0] * 7, 0), (905, rows[0][1], None), (906, [], 0), (907, [1.0, 2.0], 0)]
    df = spark.createDataFrame([(i, v, lab, "x") for i, v, lab in rows + odd], "vec_id long, embedding array<double>, label int, n_links string")
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df, bucket_rows=bucket_rows, block_rows=block_rows, recall=1 - 1e-9).collect()}
    links = []
    for (i, u, a), (j, v, b) in itertools.combinations(rows, 2):
        x, y = np.array(u), np.array(v)
        if a == b and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
            links.append((i, j))
    want = closure([r[0] for r in rows] + [r[0] for r in odd], links)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert {i: r["n_links"] for i, r in got.items()} == {i: sum(i in ab for ab in links) for i in want}
    assert all(r["kept"] == (i == want[i]) for i, r in got.items())


def test_embeddings_empty_and_null_ids(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    got = embedding_dedup.near_duplicates(spark.createDataFrame([(None, [1.0, 0.0], 1), (4, [1.0, 0.0], 1), (4, [1.0, 0.0], 1)], schema)).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], r["component_id"]) for r in got) == [("4", 2, 4), ("4", 2, 4), ("None", 2, 4)]


def test_table_plan_keeps_recall_at_any_size():
    for n in (10, 10_000, 10**9):
        bits, tables = embedding_dedup.plan_tables(n, 0.93, 0.999, 128)
        p = (1 - np.arccos(0.93) / np.pi) ** bits
        assert 1 - (1 - p) ** tables >= 0.999 and n / 2**bits <= 128 or bits == 2


def test_bucket_keys_do_not_depend_on_the_rows_beside():
    rng = np.random.default_rng(3)
    unit = embedding_dedup.unit_rows(rng.standard_normal((700, 24)).astype(np.float32))
    whole = embedding_dedup.bucket_keys(unit, 5, 7, 1)
    pick = rng.permutation(700)[:300]
    assert np.array_equal(whole[pick], embedding_dedup.bucket_keys(unit[pick], 5, 7, 1)) and whole.max() < 32


def test_embeddings_of_floats_lengths_and_a_hot_copy(spark):
    rng = np.random.default_rng(9)
    rows = [(k, [float(x) for x in rng.standard_normal(6 if k % 3 else 9).astype(np.float32)], "l") for k in range(40)]
    rows += [(100 + k, [1.0] * 6, "l") for k in range(200)] + [(400, [2.0] * 6, "l"), (401, [1.0] * 9, "l")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df, recall=1 - 1e-9).collect()}
    links = [(i, j) for (i, u, _), (j, v, _) in itertools.combinations(rows, 2) if len(u) == len(v) and np.dot(u, v) / np.sqrt(np.dot(u, u) * np.dot(v, v)) >= 0.93]
    want = closure([r[0] for r in rows], links)
    assert {i: r["component_id"] for i, r in got.items()} == want and got[150]["n_links"] >= 200
    assert {i: r["n_links"] for i, r in got.items()} == {i: sum(i in ab for ab in links) for i in want}


def exact_want(rows, keep):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    pick = max if keep == "largest" else min
    out = []
    for i, t in rows:
        g = groups[t or ""]
        best = pick((x for x in g if x is not None), default=None)
        out.append((i, best, len(g), i == best, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("budget", [1 << 20, 300])
def test_exact_duplicates(spark, keep, budget):
    long = "ab " * 40_000
    rows = [(1, "a"), (2, None), (3, ""), (4, "a"), (5, "a "), (6, long), (7, long), (8, long + "x"), (9, "é"), (10, "é"), (None, "a"), (None, "only"), (11, "b"), (11, "b"), (12, "\x00\n")]
    rows += [(20 + k, "hot") for k in range(60)] + [(100 + k, f"text {k % 7} " * (k % 5)) for k in range(60)]
    df = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, kept string, group_size int").repartition(5)
    got = exact_dedup.exact_duplicates(df, keep=keep, budget=budget)
    assert got.columns[:2] == ["doc_id", "text"] and "kept" in got.columns
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got.collect()), key=str) == exact_want(rows, keep)
    assert exact_dedup.exact_duplicates(df.limit(0)).count() == 0


def test_exact_duplicates_write_no_table(spark):
    root = Path(scratch.shared_root(spark).removeprefix("file:"))
    before = set(root.glob("exact_dedup-*"))
    df = spark.createDataFrame([(k, f"text {k % 3}") for k in range(12)], "doc_id long, text string")
    got = exact_dedup.exact_duplicates(df)
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in got.collect()) == [(k, k % 3, 4) for k in range(12)]
    assert set(root.glob("exact_dedup-*")) == before


def test_exact_duplicates_keep_columns_of_their_own_names(spark):
    rows = [(1, "a", "p", 1, 2, 3, 4, 5), (2, "a", "q", 1, 2, 3, 4, 5), (3, None, "r", 1, 2, 3, 4, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _keep string, _rows int, sha int, Size int, its int, low int")
    got = exact_dedup.exact_duplicates(df)
    assert got.columns == [*df.columns, "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(tuple(r)[:11] for r in got.collect()) == sorted((*r, k, n, k == r[0]) for r, k, n in zip(rows, (1, 1, 3), (2, 2, 1), strict=True))


def test_patricia_trie_spills_whole_subtrees():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 12))).encode() for _ in range(400)]
    trie, found = exact_dedup.PatriciaTrie(), {}
    def take(rows):
        for t, (low, high, n) in rows:
            a = found.setdefault(t, [low, high, 0])
            found[t] = [min(a[0], low), max(a[1], high), a[2] + n]
    for i, t in enumerate(texts):
        trie.insert(t, i, i, 1)
        if i % 50 == 49:
            take(trie.spill())
    take(trie.walk())
    want = {}
    for i, t in enumerate(texts):
        a = want.setdefault(t, [i, i, 0])
        want[t] = [a[0], i, a[2] + 1]
    assert found == want


def plain_fingerprint(text, words):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    parts = []
    for c in low:
        if c in " \t\n\x0b\x0c\r":
            parts.append("")
        elif not parts:
            parts.append(c)
        else:
            parts[-1] += c
    parts = [p for p in parts if p]
    if not parts:
        return 0
    shingles = [" ".join(parts[k : k + words]) for k in range(max(1, len(parts) - words + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", ["", "  \n", "One", "one two three", "A b c d e f g h", "É É É x \x1c y z", "w " * 5000, "a b c d a b c d a b c d", "日本 語 の テスト です ね"])
@pytest.mark.parametrize("words", [4, 5])
def test_fingerprint(text, words):
    assert simhash_dedup.fingerprint(text, words) == plain_fingerprint(text, words)


def test_forest_finds_all_within_radius():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    values = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(6)]))
    tree = np.sort(rng.integers(0, 3, len(values)))
    forest = simhash_dedup.Forest(values, tree)
    root = np.array([forest.root[t] for t in tree.tolist()])
    got = {(q, i) for a, b in forest.search(values, root, 4) for q, i in zip(a.tolist(), b.tolist(), strict=True)}
    want = {(q, i) for q in range(len(values)) for i in range(len(values)) if tree[q] == tree[i] and int(values[q] ^ values[i]).bit_count() <= 4}
    assert got == want


@pytest.mark.parametrize("block_rows", [4096, 3])
def test_simhash_against_brute_force(spark, block_rows):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(40):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 60, 200]))]
        rows.append(" ".join(words))
        for _ in range(rng.randint(0, 3)):
            other = list(words)
            if other:
                other[rng.randrange(len(other))] = "changed"
            rows.append("  ".join(other))
    docs = [(i, t) for i, t in enumerate(rows)] + [(900, None), (901, " "), (902, rows[3]), (902, rows[3])]
    df = spark.createDataFrame([(i, t, "z") for i, t in docs], "doc_id long, text string, fingerprint string")
    got = simhash_dedup.near_duplicates(df, words=4, radius=4, block_rows=block_rows).collect()
    fps = {i: plain_fingerprint(t or "", 4) for i, t in docs}
    links = [(a, b) for a, b in itertools.combinations(fps, 2) if (fps[a] ^ fps[b]).bit_count() <= 4]
    want = closure(fps, links)
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == sorted((i, f"{fps[i]:016x}", want[i]) for i, _ in docs)


def test_simhash_empty_null_ids_and_one_of_each(spark):
    schema = "doc_id long, text string, lang string"
    assert simhash_dedup.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([(5, "a b c d e f", "en"), (3, "a b c d e f", None), (None, "a b c d e f", "en"), (9, "other words in this one here", "en")], schema)
    assert sorted((str(r["doc_id"]), r["component_id"]) for r in simhash_dedup.near_duplicates(df).collect()) == [("3", 3), ("5", 3), ("9", 9), ("None", 3)]
    kept = simhash_dedup.one_of_each(df)
    assert kept.columns == df.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["3", "9", "None"]


def jaccard(a, b, words=5):
    def cut(t):
        w = t.lower().split()
        return {" ".join(w[k : k + words]) for k in range(max(1, len(w) - words + 1))}

    x, y = cut(a), cut(b)
    return len(x & y) / len(x | y)


def test_wide_simhash_links_similar_and_no_other_texts(spark):
    rng = random.Random(7)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = []
    for _ in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([40, 150, 400]))]
        rows.append(" ".join(words))
        for _ in range(2):
            other = list(words)
            for _ in range(max(1, len(words) // 120)):
                other[rng.randrange(len(other))] = "changed"
            rows.append(" ".join(other))
        rows.append(" ".join(rng.choice(vocabulary) if rng.random() < 0.3 else w for w in words))
    df = spark.createDataFrame(list(enumerate(rows)) + [(900, None), (901, ""), (None, rows[0])], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash_dedup.similar_components(df).collect()}
    near = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if a // 4 == b // 4 and jaccard(rows[a], rows[b]) >= 0.85]
    assert len(near) > 40 and np.mean([got[a] == got[b] for a, b in near]) > 0.95
    assert all(got[a] // 4 == a // 4 for a in range(len(rows)))
    assert all(got[a] == a for a in range(3, len(rows), 4))
    assert got[901] == 900 == got[900] and got[None] == got[0]
    assert simhash_dedup.similar_components(df.limit(0)).count() == 0


def shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for d in folders for f in Path(d.getPath()).rglob("shuffle_*.data")}


def test_scratch_leaves_no_shuffle_files(spark):
    before, own = shuffle_files(spark), scratch.Scratch(spark, "t")
    got = own.save(spark.range(1000).repartition(3, "id"), "t")
    got = own.save(got.repartition(3, "id"), "t2")
    until = time.time() + 10
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.1)
    assert not left and got.count() == 1000


def test_wide_simhash_in_rounds(spark, monkeypatch):
    assert simhash_dedup.rounds(94, 10**6) == [range(0, 94)]
    assert [t for r in simhash_dedup.rounds(273, 24) for t in r] == list(range(273)) and max(map(len, simhash_dedup.rounds(273, 24))) <= 24
    rng = random.Random(12)
    rows = [t for _ in range(30) for t in planted(rng, [2, 5])]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    dealt = []
    links = simhash_dedup.shard_links

    def noted(rows, *more):
        dealt.append({r["band"] for r in rows.select("band").distinct().collect()})
        return links(rows, *more)

    monkeypatch.setattr(simhash_dedup, "shard_links", noted)
    got = {r["doc_id"]: r["component_id"] for r in simhash_dedup.similar_components(df, round_rows=1).collect()}
    assert got == {k: k // 3 * 3 for k in range(90)}
    # no table is left out or searched twice, and no round deals out more than 24
    assert sorted(t for some in dealt for t in some) == list(range(94)) and max(map(len, dealt)) <= 24


def planted(rng, changes):
    """A text of 400 different words, and copies of it with so many words, far from each other, changed."""
    words = [f"w{rng.randrange(10**9)}" for _ in range(400)]
    out = [" ".join(words)]
    for c in changes:
        other = list(words)
        for k in range(c):
            other[10 + 30 * k] = f"x{rng.randrange(10**9)}"
        out.append(" ".join(other))
    return out


@pytest.mark.parametrize("block_rows", [4096, 3])
def test_wide_simhash_verifies_the_shingles(spark, block_rows):
    rng = random.Random(11)
    # 8 changed words leave a similarity of 0.82, 9 one of 0.796, 11 one of 0.756
    rows = [t for k in range(40) for t in planted(rng, [(8,), (9,), (11,), (2, 9, 9)][k % 4])]
    rows += ["a b c d e f g " * 40 + " ".join(f"t{k}{n}" for n in range(9)) for k in range(3)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash_dedup.similar_components(df, block_rows=block_rows).collect()}
    sure = closure(range(len(rows)), [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if jaccard(rows[a], rows[b]) >= 0.8])
    assert all(sure[a] == sure[b] for a, b in got.items()) and sum(got[a] == b for a, b in sure.items()) >= len(rows) - 2


@pytest.mark.parametrize("rows", [10, 10**4, 10**6, 10**8])
def test_sampled_tables_hold_the_recall_at_the_radius(rows):
    bits, tables = simhash_dedup.sampled_tables(rows, 56, 256, 0.99, 64)
    alike = math.comb(200, bits) / math.comb(256, bits)
    assert rows / 2**bits <= 64 and 0.99 <= 1 - (1 - alike) ** tables < 0.991
    rng = np.random.default_rng(3)
    places = simhash_dedup.sampled_places(bits, tables, 256, 9)
    differing = rng.permuted(np.tile(np.arange(256) < 56, (1000, 1)), axis=1)
    assert np.mean([(~d[places]).all(axis=1).any() for d in differing]) > 0.975


@pytest.mark.parametrize("blocks_of", [1, 2])
def test_alike_edges_against_brute_force(blocks_of):
    rng = np.random.default_rng(8)
    sets = []
    for _ in range(30):
        base = rng.integers(0, 5000, 60).astype("<u8")
        sets += [np.unique(np.concatenate([base[rng.random(60) < 0.93], rng.integers(0, 5000, 2).astype("<u8")])) for _ in range(5)]
    block = np.arange(len(sets)) % blocks_of
    got = simhash_dedup.alike_edges(sets, rng.integers(0, 99, (len(sets), 4), dtype=np.uint64), block, 0.8, first=2)
    near = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if (blocks_of == 1 or block[a] != block[b]) and len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b])) >= 0.8]
    assert len(near) > 30 and closure(range(len(sets)), got) == closure(range(len(sets)), near) and {(min(e), max(e)) for e in got} <= set(near)


def test_forest_edges_are_a_forest():
    rng = np.random.default_rng(5)
    fp = np.uint64(7) ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64))
    fp = np.unique(fp ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)))
    pdf = pd.DataFrame({"nid": np.arange(len(fp)), "f0": fp.view(np.int64), "band": 0, "value": 0, "bi": 0, "bj": 0, "block": 0})
    got = simhash_dedup.forest_edges(pdf, 4, ["f0"], "nid", step=50)
    assert len(got) < len(fp) and set(closure(range(len(fp)), got.itertuples(index=False)).values()) == {0}


def test_forest_of_wide_values():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, (20, 4), dtype=np.uint64)
    values = np.concatenate([base, base ^ np.uint64(5), base ^ np.uint64(1 << 40)])
    forest = simhash_dedup.Forest(values, np.zeros(len(values), np.int64))
    got = {(q, i) for a, b in forest.search(values, np.zeros(len(values), np.int64), 12) for q, i in zip(a.tolist(), b.tolist(), strict=True)}
    assert got == {(q, i) for q in range(60) for i in range(60) if sum(int(x ^ y).bit_count() for x, y in zip(values[q], values[i], strict=True)) <= 12}


def test_spark_hash_is_the_contracts(spark):
    got = spark.createDataFrame([("a b c d é",)], "t string").select(F.xxhash64("t")).first()[0]
    assert got % 2**64 == xxhash.xxh64_intdigest("a b c d é".encode(), 42)


@pytest.mark.parametrize("first", [1, 3, 32])
def test_forest_edges_against_brute_force(first):
    """Whole shards and shards cut into block pairs, with groups of near copies of all sizes."""
    rng = np.random.default_rng(12)
    for _ in range(12):
        n = int(rng.integers(1, 200))
        fp = rng.integers(0, 2**63, 8, dtype=np.uint64)[rng.integers(0, 8, n)]
        for _ in range(int(rng.integers(0, 6))):
            fp = fp ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
        rows = pd.DataFrame({"nid": np.arange(n), "f0": fp.view(np.int64), "band": 0, "value": rng.integers(0, 3, n), "block": rng.integers(0, 2, n)})
        hot = rows["value"] == 2
        parts = [rows[~hot].assign(block=0, bi=0, bj=0)] + [rows[hot & rows["block"].isin([i, j])].assign(bi=i, bj=j) for i, j in ((0, 0), (0, 1), (1, 1))]
        pdf = pd.concat(parts, ignore_index=True)
        near = []
        for _, g in pdf.groupby(["band", "value", "bi", "bj"]):
            for a, b in itertools.combinations(g.itertuples(), 2):
                if (a.bi == a.bj or a.block != b.block) and int(np.uint64(a.f0 & (2**64 - 1)) ^ np.uint64(b.f0 & (2**64 - 1))).bit_count() <= 4:
                    near.append((a.nid, b.nid))
        got = simhash_dedup.forest_edges(pdf, 4, ["f0"], "nid", step=50, first=first)
        assert closure(range(n), got.itertuples(index=False)) == closure(range(n), near)


def test_a_group_of_near_copies_takes_time_of_its_size():
    rng = np.random.default_rng(1)
    fp = np.repeat(rng.integers(0, 2**63, (1, 4), dtype=np.uint64), 20_000, 0)
    for _ in range(12):
        fp[np.arange(len(fp)), rng.integers(0, 4, len(fp))] ^= np.uint64(1) << rng.integers(0, 64, len(fp)).astype(np.uint64)
    pdf = pd.DataFrame({"nid": np.arange(len(fp)), **{f"f{k}": fp[:, k].view(np.int64) for k in range(4)}, "band": 0, "value": 0, "bi": 0, "bj": 0, "block": 0})
    start = time.process_time()
    assert len(simhash_dedup.forest_edges(pdf, 56, [f"f{k}" for k in range(4)], "nid")) == len(fp) - 1
    assert time.process_time() - start < 20
