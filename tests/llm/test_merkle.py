"""The Merkle manifest against a plain tree, on odd rows, on groups over a block, and against SQL."""

import hashlib
import random
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import merkle
from tidemark.llm import queries as Q


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def told(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(nodes):
    """The root of ordered nodes and, for each of them, what stands left and right on its way up."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(at):
            start = p - p % 16
            paths[k].append(("".join(nodes[start:p]), "".join(nodes[p + 1 : start + 16])))
        nodes = [sha("".join(nodes[k : k + 16])) for k in range(0, len(nodes), 16)]
        at = [p // 16 for p in at]
    return nodes[0], paths


def fold(node, path):
    for left, right in path:
        node = sha(left + node + right)
    return node


def plain(rows):
    """(doc_id, text, lang, source, n_chars) rows -> the query's rows."""
    leaf = lambda r, text: sha("".join(map(told, (r[0], r[3], r[2], r[4], text))))
    lower = lambda t: t and "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in order}
    root, tops = climb([trees[s][0] for s in order]) if order else (None, [])
    out = []
    for s, top in zip(order, tops, strict=True):
        for (_, _, node, r), path in zip(sorted(groups[s], key=lambda x: x[:3]), trees[s][1], strict=True):
            bent = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            back = fold(leaf(r, lower(r[1])) if bent else node, path + top)
            out.append((r[0], node, trees[s][0], root, sha("".join(a + b for a, b in path + top)), back, back == root))
    return Counter(out)


COLS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def got(spark, folder):
    return Counter(tuple(r[c] for c in COLS) for r in Q.op12_merkle_manifest(spark, folder).collect())


def test_odd_rows(spark, docs, stored):
    rnd = random.Random(3)
    rows = [(k, rnd.choice([None, "", "Ab c", "é😀 TEXT", "x" * 5000]), rnd.choice([None, "en"]), rnd.choice([None, "", "b", "é", "hot", "hot", "hot"])) for k in range(-20, 320)]
    rows += [(None, "A", None, "hot"), (None, "b", None, None), (7, "Twice", None, "b"), (7, "Twice", None, "b"), (500, "Lone", "de", "zz")] + [(1000 + k, "Q", None, f"t{k}") for k in range(20)]
    full = [(*r, len(r[1]) if r[1] is not None else None) for r in rows]
    clash = docs(rows).withColumn("grp", F.lit(1)).withColumn("at", F.lit(2)).withColumn("node", F.lit(3)).withColumn("leaf", F.lit("x")).withColumn("path", F.lit(0)).withColumn("bent", F.lit(0))
    folder = stored(documents=clash)
    found = got(spark, folder)
    assert found == plain(full)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT doc_id, text, lang, source, n_chars FROM '{folder}/documents.parquet/*.parquet'")
    want = con.sql(Q.OP12_SQL)
    at = [want.columns.index(c) for c in COLS]
    once = lambda rows: Counter(x for x in rows if x[0] != 7)  # noqa: E731 - twins are told apart by place only
    assert once(tuple(r[k] for k in at) for r in want.fetchall()) == once(found.elements())


@pytest.mark.parametrize("n", [1, 16, 17, 256, 257, 4096, 4097, 5000])
def test_sizes(spark, n):
    rows = spark.range(n).select(F.lit("g").alias("s"), "id", F.sha2(F.col("id").cast("string"), 256).alias("d"))
    root, paths = climb([sha(str(k)) for k in range(n)])
    out = {r.id: r for r in merkle.with_proofs(rows, "s", "id", "d", keep=("id",)).select("id", "leaf", "root", "subroot", "path").collect()}
    assert len(out) == n
    for k in {0, 1, n // 2, n - 1} & set(range(n)):
        assert (out[k].leaf, out[k].root, out[k].subroot) == (sha(str(k)), root, root)
        assert [(s.left, s.right) for s in out[k].path] == paths[k]


def test_no_rows(spark, docs, stored):
    assert not got(spark, stored(documents=docs([])))


def test_depth_is_exact(spark):
    ns = [1, 2, 16, 17, 256, 257, 4096, 4097, 65536, 65537, 16**12, 16**12 + 1]
    rows = spark.createDataFrame([(n,) for n in ns], "n long").select("n", merkle.depth(F.col("n")).alias("d")).collect()
    assert [r.d for r in rows] == [0, 1, 1, 2, 2, 3, 3, 4, 4, 5, 12, 13]
