"""Merkle manifest against a plain tree, multiproofs against a search, with ties, nulls and many small groups."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i:i + 3]) for i in range(0, len(levels[-1]), 3)])
    proofs = []
    for i in range(len(leaves)):
        steps = []
        for level in levels[:-1]:
            a = i - i % 3
            steps.append(("".join(level[a:i]), "".join(level[i + 1:a + 3])))
            i //= 3
        proofs.append(steps)
    return levels[-1][0], proofs


def leaf(*values):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def manifest(rows):
    """(leaf, source, subroot, root, joined siblings) of rows (doc_id, source, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(((r[0] is not None, r[0] or 0), leaf(*r)))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x for _, x in sorted(groups[s])]) for s in names}
    root, above = tree([trees[s][0] for s in names])
    return sorted((x, s or "", trees[s][0], root, "".join(a + b for a, b in steps + top))
                  for s, top in zip(names, above) for (_, x), steps in zip(sorted(groups[s]), trees[s][1]))


def make(seed=4):
    rng = random.Random(seed)
    sizes = [(None, 5), ("a", 1), ("b", 400), ("é", 28), ("z", 3), ("zz", 27), ("", 2)] + [(f"s{i}", rng.randint(1, 9)) for i in range(40)]
    rows = [(rng.randint(0, 10**6), s, f"t{rng.random()}\n") for s, m in sizes for _ in range(m)]
    rows += [(7, "b", "same")] * 5 + [(None, "b", "x"), (None, None, None), (3, "b", ""), (3, "b", None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("per_part, stride", [(16_384, 12), (10, 2), (37, 1)])
def test_matches_plain_tree(spark, per_part, stride):
    from ledgerwise.llm.merkle import fold, leaf_hash, prove, siblings

    rows = make()
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, text string, leaf string").repartition(7)
    got = prove(df, F.col("doc_id"), F.col("source"), leaf_hash(F.col("doc_id"), F.col("source"), F.col("text")),
                {"other": F.col("text")}, per_part=per_part, stride=stride)
    got = got.withColumn("folded", fold(F.col("leaf"), F.col("steps"))).withColumn("s", siblings(F.col("steps"))).collect()
    assert sorted((r.leaf, r.grp or "", r.subroot, r.root, r.s) for r in got) == manifest(rows)
    assert all(r.folded == r.root for r in got) and sorted(r.other or "" for r in got) == sorted(t or "" for _, _, t in rows)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28, 100])
def test_multiproofs_are_minimal_and_sufficient(n):
    from ledgerwise.llm.merkle import climb, missing, sizes

    rng = random.Random(n)
    leaves = [digest(str(i)) for i in range(n)]
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i:i + 3]) for i in range(0, len(levels[-1]), 3)])
    root, proofs = tree(leaves)
    assert sizes(n) == [len(x) for x in levels]
    for _ in range(20):
        own = sorted(rng.sample(range(n), rng.randint(1, n)))
        need = list(missing(own, n))
        got, sides = climb({i: leaves[i] for i in own}, n, {(a, i): levels[a][i] for a, i in need})
        assert got == root and len(set(need)) == len(need)
        assert all([sides[a][i // 3**a] for a in range(len(sides))] == proofs[i] for i in own)
        for skipped in need:  # without any one of them the root can't be derived
            with pytest.raises(KeyError):
                climb({i: leaves[i] for i in own}, n, {(a, i): levels[a][i] for a, i in need if (a, i) != skipped})


def test_query_finds_tampering(spark, tmp_path):
    from ledgerwise.llm.queries import op12_merkle_manifest

    rows = [(i, ["x", None, "y"][i % 3], "en", i, ["a\nb", "plain", None, "", "\n"][i % 5]) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in op12_merkle_manifest(spark, str(tmp_path)).collect()}
    for i, s, lang, n, t in rows:
        changed = zlib.crc32(str(i).encode()) % 2 == 0 and t is not None and "\n" in t
        assert got[i].verified == (not changed) and (got[i].folded_root == got[i].root) == got[i].verified
        assert got[i].leaf == leaf(i, s, lang, n, t)


def test_empty_and_single(spark):
    from ledgerwise.llm.merkle import fold, prove

    df = spark.createDataFrame([(1, None, "a")], "doc_id long, source string, text string")
    args = (F.col("doc_id"), F.col("source"), F.sha2("text", 256))
    assert prove(df.limit(0), *args).collect() == []
    (r,) = prove(df, *args).withColumn("f", fold(F.col("leaf"), F.col("steps"))).collect()
    assert r.leaf == r.subroot == r.root == r.f and r.steps == []
