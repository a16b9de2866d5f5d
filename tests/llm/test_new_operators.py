"""The prefix trie, the suffix dedup and the hard negatives against brute force and DuckDB."""

import hashlib
import pathlib
import random
import zlib
from collections import Counter, defaultdict

import brute
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import talkweave.llm as llm
from talkweave.llm import negatives, suffixes, trie

llm.load()
SMALL = "/root/testdata/sf0.001"


def sql_rows(path, name, tables):
    con = duckdb.connect()
    for t in tables:
        files = f"{path}/{t}.parquet" + ("/*.parquet" if pathlib.Path(f"{path}/{t}.parquet").is_dir() else "")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{files}')")
    return sorted(con.execute(llm.ORACLE_SQL[name]).fetchall(), key=str)


# --- prefix trie ----------------------------------------------------------------
TURNS = [
    (0, 1, "user", "a b"), (0, 2, "assistant", "c"), (0, None, None, "first"), (0, 3, "user", None), (1, 1, "user", "a b"), (1, 1, "user", "a b"),
    (2, 5, "", ""), (2, 6, "x", "same"), (22, 5, "", ""), (22, 6, "x", "same"), (40, 1, "user", "only"), (45, 0, "user", "q"), (45, 1, "user", "q"),
    (None, 1, "user", "no conversation"), (None, None, None, None), (7, 1, "user", "w " * 30_000), (7, 2, "é", "😀 x\ty"), (-3, 1, "user", "negative"),
    *[(60 + i, t, "user", f"turn {t if i % 3 else t * i}") for i in range(40) for t in range(i % 7)], *[(200, t, "u", f"deep {t % 5}") for t in range(120)],
    *[(201, t, "u", f"deep {t % 5}") for t in range(90)],
]


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    paths = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        # The remainder has the sign of the number, as in SQL.
        paths[c] = tuple(own.get(c - int(np.fmod(c, 20)), [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, cs in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in children
            saved[k[:d]] += (len(cs) - 1) * len(brute.words(k[-1][1])) if k else 0
    ends = {k: ",".join(map(str, sorted(c for c in cs if paths[c] == k))) for k, cs in members.items()}
    return sorted(
        ((min(cs), len(k), min(members[k[:-1]]) if k else None, len(cs), children[k], leaves[k], saved[k], hashlib.sha256(ends[k].encode()).hexdigest())
         for k, cs in members.items()), key=str,
    )


@pytest.fixture(scope="module")
def talks(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("talks"))
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS c", "2 AS pos", "3 AS k1", "'x' AS words", "4 AS depth")
    df.repartition(3).write.parquet(f"{path}/full/conversations.parquet")
    df.limit(0).write.parquet(f"{path}/empty/conversations.parquet")
    return path


@pytest.mark.parametrize("folder", ["full", "empty", SMALL])
def test_trie_query(spark, talks, folder):
    path = folder if folder == SMALL else f"{talks}/{folder}"
    got = sorted(map(tuple, llm.QUERIES["op11_prefix_trie"](spark, path).collect()), key=str)
    rows = spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert got == brute_trie(map(tuple, rows))
    assert got == sql_rows(path, "op11_prefix_trie", ["conversations"])


@pytest.mark.parametrize("unit, band, span, ends, limit", [(2, 1 << 20, 1000, 2, 1 << 20), (5, 3, 4, 1000, 3)])
def test_trie_does_not_depend_on_units(spark, talks, unit, band, span, ends, limit):
    ordered = trie.in_order(trie.turns_of(spark.read.parquet(f"{talks}/full/conversations.parquet"), "conv_id", "turn", "role", "text"), span)
    head = F.crc32(F.col("c").cast("string").cast("binary")) % 4
    nodes = trie.prefix_trie(*trie.with_heads(ordered, F.col("c") - F.col("c") % 20, head, 3), unit, band, span, ends, limit)
    assert sorted(map(tuple, nodes.collect()), key=str) == brute_trie(TURNS)


def test_queue_spills_in_order():
    rng, queue, out, held = random.Random(3), trie.Queue(50), [], []
    for _ in range(4000):
        if rng.random() < 0.6 or not held:
            item = (rng.randrange(1000), rng.random())
            queue.push(item)
            held.append(item)
        else:
            held.sort()
            assert queue.least() == held[0]
            out.append(queue.pop() == held.pop(0))
    assert queue.runs and all(out)


# --- suffix dedup --------------------------------------------------------------
def brute_repeats(texts):
    raws = [(t or "").encode() for t in texts]
    counts = Counter(r[i:i + 200] for r in raws for i in range(len(r) - 199))
    out = []
    for r in raws:
        covered = bytearray(len(r))
        for i in range(len(r) - 199):
            if counts[r[i:i + 200]] > 1:
                covered[i:i + 200] = b"\1" * 200
        spans = sum(bool(x) and not (i and covered[i - 1]) for i, x in enumerate(covered))
        out.append((len(r), sum(covered), spans, hashlib.sha256(bytes(x for x, y in zip(r, covered) if not y)).hexdigest()))
    return out


def texts_of(seed):
    rng = random.Random(seed)
    make = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    shared = [make(n) for n in (190, 195, 199, 200, 201, 205, 260, 330, 500, 900)]
    texts = [None, "", "x" * 199, "y" * 200, "z" * 201, "ab" * 300, "abc" * 70 + "q", "a" * 3000, "w " * 40_000]
    for _ in range(60):
        t = make(rng.randrange(0, 400))
        for _ in range(rng.randrange(0, 4)):
            t += rng.choice(shared) + make(rng.randrange(0, 300))
        texts.append(t)
    # Near copies: a different few characters in each.
    base = make(1500)
    for k in range(25):
        b = list(base)
        for _ in range(rng.randrange(1, 8)):
            b[rng.randrange(len(b))] = f"#{k}"
        texts.append("".join(b))
    return texts + [texts[12]] * 3


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_dedup(spark, tmp_path, seed):
    texts = texts_of(seed)
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS k", "3 AS spans", "'x' AS kept", "4 AS name")
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = llm.QUERIES["op12_suffix_dedup"](spark, str(tmp_path)).collect()
    want = [(i, *w) for (i, _), w in zip(rows, brute_repeats(texts))]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_suffix_dedup_shards_and_rounds(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "SHARD", 100)
    texts = texts_of(3)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, body string").withColumn("spans", F.lit(1))
    rows = suffixes.without_repeats(df, "body", (1, 3)).collect()
    for r, (n, removed, spans, digest) in zip(sorted(rows, key=lambda r: r["id"]), brute_repeats(texts)):
        assert (sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"])) == (removed, spans)
        assert hashlib.sha256(r["kept"]).hexdigest() == digest and len(r["kept"]) == n - removed


@pytest.mark.parametrize("folder", ["edges", "empty", SMALL])
def test_suffix_dedup_tables(spark, tables, folder):
    path = tables.get(folder, folder)
    got = llm.QUERIES["op12_suffix_dedup"](spark, path).collect()
    docs = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, got), key=str) == sorted(((i, *w) for (i, _), w in zip(docs, brute_repeats([t for _, t in docs]))), key=str)


def test_long_texts_are_worked_on_in_pieces(monkeypatch):
    monkeypatch.setattr(suffixes, "BATCH", 1 << 10)
    lengths = [5000, 200, 70, 0, 133, 40_000]
    offsets = np.cumsum([0, *lengths])
    texts = suffixes.Texts(np.arange(len(lengths)), np.zeros(offsets[-1], np.uint8), offsets)
    parts = list(texts.samples())
    want = [a + i for a, n in zip(offsets, lengths) for i in range(n - suffixes.SAMPLE + 1) if i % suffixes.PERIOD in suffixes.COVER]
    assert len(parts) > 3 and np.concatenate(parts).tolist() == want
    starts, ends = np.array([3, 900, 7000]), np.array([700, 6000, 7001])
    found = list(suffixes.pieces(starts, ends))
    assert max(map(len, found)) <= 1 << 10 and np.concatenate(found).tolist() == [i for a, b in zip(starts, ends) for i in range(a, b)]
    opened, closed = suffixes.merged(np.array([5, 0, 20, 30]), np.array([9, 5, 40, 35]))
    assert (opened.tolist(), closed.tolist()) == ([0, 20], [9, 40])


def test_cover_has_every_difference():
    assert {(int(a) - int(b)) % suffixes.PERIOD for a in suffixes.COVER for b in suffixes.COVER} == set(range(suffixes.PERIOD))


# --- hard negatives --------------------------------------------------------------
@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(-3, 6, 8)], int(rng.integers(0, 4))) for i in range(400)]
    rows += [(i, [1.0] * 8, 1) for i in range(400, 500)]  # one hot vector
    rows += [(50, [2.0] * 8, 1), (3, rows[3][1], rows[3][2]), (600, None, 1), (601, [None] * 8, 1), (602, [float("nan")] * 8, 1), (603, [float("inf")] * 8, 1),
             (650, [1.0, 2.0], 2), (651, [1.0, 1.5], 2), (652, [1.0, 1.0], 3), (653, [], 1), (None, [1.0] * 8, 1), (654, [1.0] * 8, None), (700, [-1.0] * 8, 9)]
    path = str(tmp_path_factory.mktemp("vectors"))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS v", "2 AS a", "3 AS place")
    df.write.parquet(f"{path}/full/embeddings.parquet")
    df.limit(0).write.parquet(f"{path}/empty/embeddings.parquet")
    return path


@pytest.mark.parametrize("folder", ["full", "empty", SMALL])
def test_hard_negatives(spark, vectors, folder):
    path = folder if folder == SMALL else f"{vectors}/{folder}"
    got = sorted(map(tuple, llm.QUERIES["op13_hard_negatives"](spark, path).collect()), key=str)
    if folder == "full":
        # The anchor with id 50 counts once; SQL without that rule would count both rows.
        con = duckdb.connect()
        con.execute(f"CREATE TABLE embeddings AS SELECT * FROM read_parquet('{path}/embeddings.parquet/*.parquet')")
        mine = [r for r in got if r[0] != 50]
        assert mine == [r for r in sorted(con.execute(llm.ORACLE_SQL["op13_hard_negatives"]).fetchall(), key=str) if r[0] != 50] and len(mine) < len(got)
    else:
        assert got == sql_rows(path, "op13_hard_negatives", ["embeddings"])


@pytest.mark.parametrize("scale", [1e2, 1e6, 1e12, 1e30])
def test_residue_products_are_exact(scale):
    rng = np.random.default_rng(5)
    a, b = (np.floor(rng.normal(size=(n, 1500)) * scale) for n in (6, 9))
    left, right = (negatives.Vectors(np.arange(len(x)), np.zeros(len(x), int), x, np.arange(len(x))) for x in (a, b))
    exact = np.array([[sum(int(x) * int(y) for x, y in zip(p, q)) for q in b] for p in a], dtype=object)
    got = left.scores(slice(0, 6), right, slice(0, 9))
    assert (got == np.clip(exact, -(1 << 63), (1 << 63) - 1)).all()


def test_negatives_do_not_depend_on_slices(spark, vectors):
    df = spark.read.parquet(f"{vectors}/full/embeddings.parquet")
    anchor = F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False))
    one, many = (
        sorted(map(tuple, negatives.hard_negatives(df, "vec_id", "embedding", F.col("label"), anchor, slices=n).collect()), key=str) for n in (1, 7)
    )
    assert one == many and one
