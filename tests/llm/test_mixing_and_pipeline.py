import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewright.llm import mixing
from tidewright.llm.common import Scratch


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Sharing and resharing step by step, as the contract tells it."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    out = {s: 0.0 for s in names}
    left, open_ = share * sum(sizes.values()), set(names)
    while left > 1e-9 and open_:
        total = sum(w[s] for s in open_)
        add = {s: left * w[s] / total for s in open_}
        left = 0.0
        for s, x in add.items():
            out[s] += x
            if out[s] >= most * sizes[s]:
                left += out[s] - most * sizes[s]
                out[s] = float(most * sizes[s])
                open_.discard(s)
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, 1.5) for r in rows], "doc_id long, text string, source string, target double")


ROWS = [(k, "w " * (k % 37 + 1), ["a", "b", "c", None, "é", "z"][0 if k % 3 else k % 6]) for k in range(300)] + [(900, None, "a"), (901, "", "tiny"), (902, "one", "tiny"), (None, "x y", "b"), (902, "one", "tiny")]


def test_mix(spark):
    df = table(spark, ROWS)
    got = mixing.mix(df).collect()
    again = mixing.mix(df.repartition(7)).collect()
    key = lambda rows: sorted((str(r["doc_id"]), r["size"], r["source_size"], r["target"], r["taken"], tuple(r["drawn_shards"])) for r in rows)
    assert key(got) == key(again) and len(got) == len(ROWS)
    sizes, taken, most = {}, {}, {}
    for r in got:
        assert r["size"] == words(r["text"]) and 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["size"] * len(r["drawn_shards"])
        s = r["source"]
        sizes[s] = sizes.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
        most[s] = max(most.get(s, 0), r["size"])
    want = plain_targets(sizes)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], want[r["source"]], rel_tol=1e-9)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(2, most[s] / 2), s
    assert math.isclose(sum(want.values()), 1.5 * sum(sizes.values()))


def test_shards_share_the_draws(spark):
    got = mixing.mix(table(spark, ROWS), shards=8).select(F.explode("drawn_shards").alias("s")).groupBy("s").count().collect()
    counts = {r["s"]: r["count"] for r in got}
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 3


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_shards_draw_the_runs_that_the_tree_gives_them(spark, shards, monkeypatch):
    """A plain replay: the tree's quotas, one after the other, taken from the passes over each source's permuted blocks."""
    seen = {}
    tree_of = mixing.splitting_tree

    def watched(plan, n, seed):
        tree = tree_of(plan, n, seed)
        seen["tree"] = tree.collect()
        seen["plan"] = {r["source"]: r for r in plan.collect()}
        return tree

    monkeypatch.setattr(mixing, "splitting_tree", watched)
    got = mixing.mix(table(spark, ROWS), shards=shards).collect()
    key = lambda i, t: hashlib.md5(f"{'' if i is None else i}:{words(t)}:20".encode()).hexdigest()
    drawn = {}
    for source, plan in seen["plan"].items():
        blocks = sorted({key(i, t) for i, t, s in ROWS if s == source})
        size = {key(i, t): 0 for i, t, s in ROWS if s == source}
        for i, t, s in ROWS:
            if s == source:
                size[key(i, t)] += words(t)
        left, order = plan["target"] - plan["passes"] * sum(size.values()), blocks * plan["passes"]
        for b in blocks if left > 0 else []:
            if size[b] > left:
                rest = [x for x in blocks[blocks.index(b) :] if abs(size[x] - left) < left]
                order += [min(rest, key=lambda x: (abs(size[x] - left), x))] if rest else []
                break
            order.append(b)
            left -= size[b]
        assert len(order) == plan["draws"]
        ends = [r["until"] for r in sorted((r for r in seen["tree"] if r["source"] == source), key=lambda r: r["shard"])]
        for n, b in enumerate(order):
            drawn.setdefault((source, b), []).append(next(k for k, end in enumerate(ends) if n < end))
    for r in got:
        want = drawn.get((r["source"], key(r["doc_id"], r["text"])), [])
        assert sorted(r["drawn_shards"]) == sorted(want) and r["taken"] == r["size"] * len(want)


def test_mix_keeps_columns_of_its_own_names_and_long_texts(spark):
    rows = [(k, "w " * (k + 1), "s", k, k, "z", k) for k in range(9)] + [(9, "long word " * 150_000, "t", 1, 2, "y", 3), (10, None, None, 1, 2, "x", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _mix_key long, key long, its string, shard long")
    got = mixing.mix(df)
    assert got.columns == [*df.columns, "size", "source_size", "target", "drawn_shards", "taken"]
    assert sorted((r["doc_id"], r["_mix_key"], r["key"], r["its"]) for r in got.collect()) == sorted((r[0], r[3], r[4], r[5]) for r in rows)
    mixed = mixing.mixed_rows(df)
    assert mixed.columns == [*df.columns, "shard_"] and all(r["shard"] == r["doc_id"] or r["doc_id"] > 8 for r in mixed.collect())


@pytest.mark.parametrize("total,marked,taken", [(10**6, 4 * 10**5, 5 * 10**5), (10**9, 3 * 10**8, 5 * 10**8)])
def test_wide_splits_follow_the_exact_distribution(spark, total, marked, taken):
    draw = mixing.hypergeometric(f"{total}L", f"{marked}L", f"{taken}L", "u")
    rows = spark.createDataFrame([(q,) for q in (0.001, 0.1587, 0.5, 0.8413, 0.999)], "u double").select("u", F.expr(draw).alias("x")).collect()
    mean = taken * marked / total
    spread = math.sqrt(mean * (total - marked) / total * (total - taken) / (total - 1))
    for r in rows:
        assert abs((r["x"] - mean) / spread - {0.001: -3.0902, 0.1587: -0.9998, 0.5: 0, 0.8413: 0.9998, 0.999: 3.0902}[r["u"]]) < 0.01 + 1 / spread


def test_bins_follow_the_rows():
    for n in (0, 1, 100, 10**6, 10**11):
        bins = 16 ** mixing.bin_digits(n)
        assert bins >= n / bins and bins <= 16 * max(1, n) ** 0.5 * 16


def test_mixed_rows(spark):
    df = table(spark, ROWS).drop("target")
    plan = {(r["doc_id"], r["size"]): r for r in mixing.mix(df).collect()}
    rows = mixing.mixed_rows(df)
    assert rows.columns == ["doc_id", "text", "source", "shard"]
    n = rows.count()
    assert n == sum(len(r["drawn_shards"]) for r in mixing.mix(df).collect()) and plan


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "a", "s")], [(1, "a b c", None), (2, "d", None)]])
def test_mix_of_little(spark, rows):
    got = mixing.mix(table(spark, rows)).collect()
    assert len(got) == len(rows) and all(r["taken"] <= 2 * r["size"] for r in got)


def test_hypergeometric_margins_and_distribution(spark):
    for total, marked, taken in ((10, 4, 5), (7, 7, 3), (5, 0, 2), (40, 13, 40), (1000, 300, 500)):
        rows = spark.range(4000).select(((F.col("id") + 0.5) / 4000).alias("u"))
        draw = mixing.hypergeometric(f"{total}L", f"{marked}L", f"{taken}L", "u")
        x = np.array([r[0] for r in rows.select(F.expr(draw).alias("x")).collect()])
        assert x.min() >= max(0, taken + marked - total) and x.max() <= min(taken, marked)
        mean, n = taken * marked / total, total
        spread = math.sqrt(max(mean * (n - marked) / n * (n - taken) / max(n - 1, 1), 0))
        assert abs(x.mean() - mean) <= 0.05 + 0.02 * spread and abs(x.std() - spread) <= 0.05 + 0.05 * spread


def test_tree_keeps_every_quota(spark):
    plan = spark.createDataFrame([("a", 0, 1_000_003), ("b", 1, 0), (None, 2, 17), ("d", 3, 250)], "source string, place long, draws long")
    for shards in (1, 2, 5, 8):
        tree = mixing.splitting_tree(plan, shards, 1).collect()
        assert len(tree) == 4 * shards
        for s, n in (("a", 1_000_003), ("b", 0), (None, 17), ("d", 250)):
            until = [r["until"] for r in sorted((r for r in tree if r["source"] == s), key=lambda r: r["shard"])]
            assert until[-1] == n and until == sorted(until)


SF = "/root/testdata/sf0.001"


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scratch = Scratch(spark, "test")
    sizes = [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = scratch.save(stage(spark, docs, SF), f"s{k}")
        if k < 4:
            assert out.columns == docs.columns, name
        sizes.append(out.count())
        if k == 1:
            texts = [r["text"] for r in out.collect()]
            assert len(texts) == len(set(texts))
            best = {}
            for r in docs.collect():
                best[r["text"]] = max(best.get(r["text"], -1), r["doc_id"])
            assert {r["doc_id"] for r in out.collect()} == set(best.values())
        if k == 3:
            draws = {}
            for r in out.collect():
                draws[r["doc_id"]] = draws.get(r["doc_id"], 0) + 1
            assert max(draws.values()) <= 2 and set(draws) <= {r["doc_id"] for r in docs.collect()}
        docs = out
    assert sizes[0] >= sizes[1] >= sizes[2] >= sizes[3] and sizes[4] == sizes[5] > 0
    assert all(len(r["ids"]) == 4 * r["n_tokens"] and hashlib.sha256(r["ids"]).hexdigest() == r["ids_sha256"] for r in docs.collect())


def test_pipeline_runs(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_near_duplicate_stage_against_brute_force(spark):
    docs = {r["text"] or "": r for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()}
    rows = [(r["doc_id"], t) for t, r in docs.items()]
    for k in range(8):
        base = [f"p{k}x{n}" for n in range(400)]
        # 8 words far from each other leave a similarity of 0.82, 9 one of 0.796
        rows.append((10**6 + 10 * k, " ".join(base)))
        for c in (8, 9):
            rows.append((10**6 + 10 * k + c, " ".join(f"q{c}{w}" if n % 30 == 10 and n < 30 * c else w for n, w in enumerate(base))))
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[i] = {tuple(w[n : n + 5]) for n in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(sets)
    root = {i: i for i in ids}
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both / max(1, len(sets[a]) + len(sets[b]) - both) >= 0.8 or sets[a] == sets[b]:
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    got = corpus_pipeline.simhash_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(i for i, r in root.items() if i == r)
