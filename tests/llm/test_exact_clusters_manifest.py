"""Block naming, bisector clustering and the Merkle manifest against brute force,
on edge rows: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import hashlib
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from burstlens.llm import clustering, manifest, naming, topk
from burstlens.llm.common import whole
from burstlens.llm.queries import QUERIES
from tests.llm.test_operators import texts

CLASH = ("row", "name", "level", "rank", "part", "pos", "n", "grp", "digest", "again", "members", "steps", "cluster", "x")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def frame(spark, rows, parts=3):
    out = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return out.select("*", *(F.lit("clash").alias(c) for c in CLASH)).repartition(parts)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    own = [(i, t, "en" if i % 2 else None, rnd.choice(["a", "b", "é", None, ""]), len(t or "")) for i, t in enumerate(texts())]
    own += [(100 + i, (t or "").upper(), None, "hot", None) for i, t in enumerate(texts())]
    own += [(200 + i, "the same text for a third of the rows " * 3, "en", "hot", 3) for i in range(60)]
    own += [own[6], own[6], own[-1], (None, own[-1][1], "en", "hot", 3), (None, "no id", None, None, None), (None, "no id", None, None, None)]
    own += [(300, "x" * 20000 + "end", "en", "long", 1), (301, "x" * 20000 + "enD", "en", "long", 1), (302, "x" * 20000 + "ene", "en", "long", 1)]
    return own


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("block", [7, 1024])
def test_exact_dedup(spark, rows, block):
    got = naming.deduplicate(frame(spark, rows), block=block).collect()
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(lowered(t), []).append(i)
    assert len(got) == len(rows)
    assert sorted(r["text_sha256"] for r in got) == sorted(sha(lowered(t)) for _, t, *_ in rows)
    by = {sha(t): ids for t, ids in groups.items()}
    for r in got:
        ids = by[r["text_sha256"]]
        assert r["group_size"] == len(ids) and r["keep_id"] == max((i for i in ids if i is not None), default=None)
    kept = [r for r in got if r["kept"]]
    assert sorted(r["text_sha256"] for r in kept) == sorted(by) and all(r["doc_id"] == r["keep_id"] for r in kept)
    assert len({(r["level"], r["name"]) for r in got}) == len(by)


def test_exact_dedup_of_nothing(spark, rows):
    assert naming.deduplicate(frame(spark, rows).limit(0)).count() == 0


def test_colliding_hashes_keep_names_apart(spark, monkeypatch):
    """All values share one hash and stand in many partitions, interleaved."""
    monkeypatch.setattr(naming.F, "xxhash64", lambda *_: F.lit(7).cast("long"))
    items = spark.range(900).selectExpr("id as row", "1L as n", "0L as pos", "cast(cast(id % 5 as string) as binary) as item")
    got = naming.named(items, ["item"], 6).collect()
    names = {}
    for r in got:
        names.setdefault(r["row"] % 5, set()).add(r["name"])
    assert all(len(v) == 1 for v in names.values()) and len(set.union(*names.values())) == 5


def test_hot_block_has_one_name_in_many_partitions(spark):
    items = spark.range(4000).select(F.col("id").alias("row"), F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("pos"),
                                     F.when(F.col("id") % 4 < 3, F.lit("hot")).otherwise(F.col("id").cast("string")).cast("binary").alias("item"))
    got = naming.named(items, ["item"], 16)
    assert got.filter("row % 4 < 3").select("name").distinct().count() == 1
    assert got.select("name").distinct().count() == 1001


def brute_clusters(vectors, k, rounds, scale, seed):
    kept = [(i, [math.floor(v * scale) if abs(v) < 2 ** 53 else int(v) * scale for v in x]) for i, x in vectors]
    cents = [x for _, x in sorted(((sha(f"{seed}:{i}"), x) for i, x in kept if i is not None))[:k]]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    for turn in range(rounds + 1):
        best = [min(range(len(cents)), key=lambda j: (far(x, cents[j]), j)) for _, x in kept]
        if turn < rounds:
            for j in range(len(cents)):
                own = [x for (_, x), b in zip(kept, best) if b == j]
                if own:
                    cents[j] = [sum(col) // len(own) for col in zip(*own)]
    dist = [far(x, cents[b]) for (_, x), b in zip(kept, best)]
    top = (1 << 63) - 1
    return sorted(((i if i is not None else -1), b, min(d, top), min(sum(e for e, c in zip(dist, best) if c == b), top), min(sum(dist), top),
                   sha(",".join(map(str, cents[b])))) for (i, _), b, d in zip(kept, best, dist))


@pytest.mark.parametrize("big", [0.0, 3e8, 1e307])
def test_clusters(spark, big):
    rnd = random.Random(5)
    good = [(i, [rnd.choice([-1.0, -1e-20, 0.25, 0.5, rnd.random()]) for _ in range(4)]) for i in range(120)]
    good += [(200 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(50)] + [good[3], good[3], (None, [0.1, 0.2, 0.3, 0.4])]
    good += [(300, [big, -big, 1.0, 0.0]), (301, [big, big, 1.0, 0.0])] if big else []
    bad = [(400, None), (401, [1.0, 2.0, 3.0]), (402, [1.0, None, 2.0, 3.0]), (403, [float("nan"), 1.0, 1.0, 1.0]),
           (404, [float("inf"), 1.0, 1.0, 1.0]), (405, [])]
    vectors = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>").select(
        "*", *(F.lit("clash").alias(c) for c in CLASH)).repartition(5)
    found, _ = clustering.cluster(vectors, k=7, rounds=3, scale=64, dims=4)
    got = sorted(((r["vec_id"] if r["vec_id"] is not None else -1), *tuple(r)[1:]) for r in found.collect())
    assert got == brute_clusters(good, 7, 3, 64, 1)


def test_few_and_no_vectors(spark):
    vectors = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    found, cents = clustering.cluster(vectors, dims=2)
    assert len(cents) == 2 and {r["cluster"] for r in found.collect()} == {0}  # a tie: the smaller number
    found, cents = clustering.cluster(vectors.limit(0), dims=2)
    assert found.count() == 0 and cents == []


def test_bisectors_agree_with_distances():
    rnd = random.Random(9)
    cents = [[rnd.randint(-3, 3) for _ in range(5)] for _ in range(16)]
    import numpy as np
    x = np.array([[rnd.randint(-4, 4) for _ in range(5)] for _ in range(3000)])  # many exact ties
    won = clustering.Bisectors(cents).winners(x)
    all_far = ((x[:, None, :] - np.array(cents)[None]) ** 2).sum(2)
    assert (won == all_far.argmin(1)).all()


def test_limbs_restore_numbers():
    for v in (0, 1, -1, 1 << 31, -(1 << 32), 3 ** 200, -(7 ** 150)):
        assert sum(x << (clustering.LIMB * i) for i, x in clustering.limbs(v)) == v


def test_topk_floor_and_overflow(spark):
    rows = [(0, [1.0, 1.0]), (1, [-1e-20, 0.0]), (2, [0.0, 0.0]), (3, [1e307, 0.0]), (4, [-1e307, -0.5])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["vec_id"], r["score"]) for r in topk.top_k(vectors, vectors.filter("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(3, (1 << 63) - 1), (2, 0), (1, -256), (4, -(1 << 63))]
    assert whole(-1e-20, 256) == -1 and whole(1e307, 256) == int(1e307) * 256


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(nodes):
    """(root, one list of (left, right) a node) by the definition."""
    paths, own = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf_at, at in enumerate(own):
            run = nodes[at - at % 3:at - at % 3 + 3]
            paths[leaf_at].append(("".join(run[:at % 3]), "".join(run[at % 3 + 1:])))
        nodes, own = [sha("".join(nodes[i:i + 3])) for i in range(0, len(nodes), 3)], [at // 3 for at in own]
    return nodes[0], paths


def brute_manifest(rows):
    def leaf(i, t, lang, source, n):
        return sha("".join(map(enc, (i, source, lang, n, t))))

    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in sources:
        own = sorted(((i is not None, i or 0, leaf(i, t, la, s, n), i, t, la, n) for i, t, la, src, n in rows if src == s), key=lambda r: r[:3])
        trees.append((s, own, *climb([r[2] for r in own])))
    root, tops = climb([t[2] for t in trees])
    out = []
    for (s, own, sub, paths), top in zip(trees, tops):
        for (_, _, first, i, t, la, n), path in zip(own, paths):
            path = path + top
            cut = t.replace("\n", "") if t is not None and i is not None and zlib.crc32(str(i).encode()) % 2 == 0 else t
            now = leaf(i, cut, la, s, n)
            for left, right in path:
                now = sha(left + now + right)
            out.append((i if i is not None else -1, first, sub, root, sha("".join(a + b for a, b in path)), now, now == root))
    return sorted(out)


def op13(spark, data, monkeypatch):
    monkeypatch.setattr("burstlens.llm.queries.documents", lambda *_: data)
    got = QUERIES["op13_merkle_manifest"](spark, "")
    return sorted(((r["doc_id"] if r["doc_id"] is not None else -1), *tuple(r)[1:]) for r in got.collect())


def test_manifest(spark, rows, monkeypatch):
    want = brute_manifest(rows)
    assert op13(spark, frame(spark, rows), monkeypatch) == want
    assert any(not r[-1] for r in want) and any(r[-1] for r in want)
    assert op13(spark, frame(spark, rows).limit(0), monkeypatch) == []
    assert op13(spark, frame(spark, rows[:1]), monkeypatch) == brute_manifest(rows[:1])  # the leaf is the root


def test_manifest_recurses_over_blocks(spark, monkeypatch):
    """2300 rows of one source are four blocks of 729, 400 sources of a row each one block."""
    many = [(i, f"text {i % 7}\n", "en", "hot", i) for i in range(2300)] + [(5000 + i, None, None, f"s{i}", None) for i in range(400)]
    assert op13(spark, frame(spark, many, 7), monkeypatch) == brute_manifest(many)


@pytest.mark.parametrize("n", [2, 9, 10, 730])
def test_manifest_at_powers(spark, monkeypatch, n):
    many = [(i, "t", None, "one", 1) for i in range(n)]
    assert op13(spark, frame(spark, many, 2), monkeypatch) == brute_manifest(many)
    assert manifest.BLOCK == 729
