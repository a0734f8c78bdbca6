"""The manifest against a tree built in plain Python, and the forest's merge against any order of merging."""

import hashlib
import random
import zlib

import pytest

from sparrowgrid.llm import merkle
from sparrowgrid.llm.common import settle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.fixture(autouse=True)
def _settled(spark):
    settle(spark)


def hexed(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return hexed("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(nodes):
    out = [nodes]
    while len(nodes) > 1:
        nodes = [hexed("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)]
        out.append(nodes)
    return out


def path(tree, i):
    """Siblings to the left and right of leaf ``i`` and of each node above it."""
    for level in tree[:-1]:
        a = i // 3 * 3
        yield "".join(level[a:i]), "".join(level[i + 1 : a + 3])
        i //= 3


def brute(rows):
    bytewise = lambda s: (s is not None, (s or "").encode())
    sources = sorted({r[1] for r in rows}, key=bytewise)
    trees, order = [], []
    for s in sources:
        mine = sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        order.append(mine)
        trees.append(levels([leaf(r) for r in mine]))
    top = levels([t[-1][0] for t in trees])
    out = []
    for k, (mine, tree) in enumerate(zip(order, trees, strict=True)):
        for i, r in enumerate(mine):
            siblings = [*path(tree, i), *path(top, k)]
            folded = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                folded = leaf((*r[:4], r[4].replace("\n", "")))
            for left, right in siblings:
                folded = hexed(left + folded + right)
            root = top[-1][0]
            out.append((r[0], leaf(r), tree[-1][0], root, hexed("".join(a + b for a, b in siblings)), folded, folded == root))
    return sorted(out, key=str)


def sample(seed, n=400):
    rng = random.Random(seed)
    source = lambda: rng.choice([None, "", "hot", "hot", "hot", "é", "z", "Z", f"own{rng.randrange(60)}"])
    text = lambda: rng.choice([None, "", "a\nb", "\n", "é\n😀", "plain", "x" * 30_000 + "\n"])
    rows = [(i, source(), rng.choice([None, "en"]), rng.choice([None, i]), text()) for i in rng.sample(range(-50, 10_000), n)]
    # repeated rows, a repeated id with another text, null ids
    return rows + rows[:3] * 3 + [(rows[0][0], rows[0][1], "xx", None, "other"), (None, "hot", None, None, None), (None, "hot", "en", 1, "t")]


@pytest.mark.parametrize("seed, per_part", [(1, 7), (2, 60), (3, 1 << 16)])
def test_manifest(spark, seed, per_part):
    rows = sample(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = merkle.manifest(df, per_part)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_one_row_none_and_other_columns(spark):
    rows = [(5, None, None, None, "a\nb")]
    df = spark.createDataFrame([(*rows[0], 1, 2, "k", "r")], SCHEMA + ", tree long, part int, key string, root string")
    assert [tuple(r) for r in merkle.manifest(df).collect()] == brute(rows)
    assert merkle.manifest(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_merge_is_associative(seed):
    rng = random.Random(seed)
    counts = [rng.choice([1, 2, 3, 4, 10, 40]) for _ in range(rng.choice([1, 2, 9, 20]))]
    sizes = dict(enumerate(counts)) | {merkle.TOP: len(counts)}
    leaves = [((t, 0, i), hexed(f"{t} {i}")) for t, n in enumerate(counts) for i in range(n)]
    rng.shuffle(leaves)
    parts = []
    while leaves:
        part = merkle.Forest(dict(sizes))
        part.put(leaves[: (k := rng.randrange(1, 12))])
        parts.append(part.edge())
        leaves = leaves[k:]
    while len(parts) > 1:
        a, b = (parts.pop(rng.randrange(len(parts))) for _ in range(2))
        parts.append(a.merge(b))
    want = levels([levels([hexed(f"{t} {i}") for i in range(n)])[-1][0] for t, n in enumerate(counts)])[-1][0]
    assert list(parts[0].open.values()) == [want]
