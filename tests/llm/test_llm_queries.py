"""The queries against row-wise models, on hand-made edge cases and on the given tables."""

import pathlib
from collections import Counter, defaultdict

import brute
import pytest
from pyspark.sql import functions as F

from talkweave import llm
from talkweave.llm import quality

llm.load()
SMALL = "/root/testdata/sf0.001"
FOLDERS = ["edges", *([SMALL] if pathlib.Path(SMALL).exists() else [])]
NAMES = sorted(llm.QUERIES)


def rows_of(spark, tables, folder, name):
    path = tables.get(folder, folder)
    return path, [r.asDict() for r in llm.QUERIES[name](spark, path).collect()]


def documents(spark, path):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]


def same(got, want):
    assert Counter(map(repr, got)) == Counter(map(repr, want))


def test_names():
    assert sorted(n.split("_")[0] for n in NAMES) == sorted(f"op{i}" for i in range(1, 14))


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, tables, name):
    assert llm.QUERIES[name](spark, tables["empty"]).collect() == []


@pytest.mark.parametrize("folder", FOLDERS)
def test_secrets(spark, tables, folder):
    path, rows = rows_of(spark, tables, folder, "op1_secret_scan")
    same([(r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in rows], [(i, *brute.secrets(t)) for i, t in documents(spark, path)])


@pytest.mark.parametrize("folder", FOLDERS)
def test_personal_data(spark, tables, folder):
    path, rows = rows_of(spark, tables, folder, "op8_pii")
    same([(r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in rows], [(i, *brute.personal(t)) for i, t in documents(spark, path)])


@pytest.mark.parametrize("folder", FOLDERS)
def test_quality_rules(spark, tables, folder):
    path, rows = rows_of(spark, tables, folder, "op7_quality_rules")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    same([(r["doc_id"], *(r[n] for n in names)) for r in rows], [(i, *brute.quality(t)) for i, t in documents(spark, path)])
    assert not any(r["kept"] and r["base_failed"] for r in rows)
    tests = [
        lambda r: r["n_words"] < 20, lambda r: 100 * r["n_repeat_words"] > 30 * r["n_words"], lambda r: 100 * r["n_symbols"] > 50 * r["n_words"],
        lambda r: 100 * r["n_dup_lines"] > 30 * r["n_lines"], lambda r: 100 * r["n_upper"] > 60 * r["word_chars"], lambda r: r["word_chars"] > 40 * r["n_words"],
    ]
    failed = [[name for (name, _), fails in zip(quality.FAILS, tests) if fails(r)] for r in rows]
    sole = Counter(f[0] for f in failed if len(f) == 1)
    for r, f in zip(rows, failed):
        assert r["kept"] == (not f) and r["kept_v2"] == (not {*f} - {"shouting", "long_words"})
        assert (r["sole_rule"], r["sole_docs"]) == ((f[0], sole[f[0]]) if len(f) == 1 else (None, None))


@pytest.mark.parametrize("folder", FOLDERS)
def test_sharding(spark, tables, folder):
    path, rows = rows_of(spark, tables, folder, "op2_sharding")
    same(
        [(r["doc_id"], r["size"], r["text_crc32"]) for r in rows],
        [(i, len((t or "").encode()) + 1, brute.crc(t)) for i, t in documents(spark, path)],
    )
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 16)
    assert set(slots) <= set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.mark.parametrize("folder", FOLDERS)
def test_jaccard_join(spark, tables, folder):
    path, rows = rows_of(spark, tables, folder, "op5_ngram_jaccard")
    docs = documents(spark, path)
    want = brute.groups({i: t for i, t in docs if i is not None}, 4, 85)
    assert len(rows) == len(docs)
    for r in rows:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]], r


@pytest.mark.parametrize("folder", FOLDERS)
def test_topk(spark, tables, folder):
    path, rows = rows_of(spark, tables, folder, "op6_topk_search")
    import duckdb

    con = duckdb.connect()
    files = f"{path}/embeddings.parquet" + ("/*.parquet" if pathlib.Path(f"{path}/embeddings.parquet").is_dir() else "")
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{files}')")
    want = con.execute(llm.ORACLE_SQL["op6_topk_search"]).fetchall()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows) == sorted(want)


@pytest.mark.parametrize("folder", FOLDERS)
def test_packing(spark, tables, folder):
    import zlib

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    path, rows = rows_of(spark, tables, folder, "op10_packing")
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    parts, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        parts[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    # Rows with one id: the pieces are those of all of them.
    want = defaultdict(list)
    for key, text in documents(spark, path):
        ids = np.array([*model.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want[key].append(ids)
    for key, texts in want.items():
        left = sorted((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in parts[key])
        for ids in texts:
            at = 0
            while at < len(ids):
                fits = [x for x in left if x[0] == at and x[3] == len(ids) and x[2] == zlib.crc32(ids[at:at + x[1]].tobytes())]
                assert fits
                left.remove(fits[0])
                at += fits[0][1]
            assert at == len(ids)
        assert not left
    for placed in sequences.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r["length"] for r in rows)
    assert total <= 1024 * len(sequences) and (folder == "edges" or total >= 0.97 * 1024 * len(sequences))


@pytest.mark.parametrize("folder", FOLDERS)
def test_html(spark, tables, folder):
    path, rows = rows_of(spark, tables, folder, "op9_html_extraction")
    assert len(rows) == spark.read.parquet(f"{path}/pages.parquet").count()
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
    if folder == "edges":
        assert sorted(r["text"] for r in rows) == ["", "", "<" * 3000, "a b & c", "a b & c", "x"]
    else:
        assert all(r["text"] for r in rows)


@pytest.mark.parametrize("folder", FOLDERS)
def test_perplexity_rows(spark, tables, folder):
    path, rows = rows_of(spark, tables, folder, "op4_quality_classifier")
    want = [(i, len(brute.words(t))) for i, t in documents(spark, path)]
    same([(r["doc_id"], r["n_words"]) for r in rows], want)
    assert all((r["perplexity"] is None) == (r["n_words"] == 0) for r in rows)
    assert not any(r["kept"] for r in rows if r["n_words"] == 0)
    # The verdict follows from the columns, up to the rounding of exp and log at the threshold itself.
    judged = [r for r in rows if r["judged_perplexity"] is not None and r["threshold"] is not None]
    assert all(r["kept"] == (r["judged_perplexity"] <= r["threshold"]) for r in judged if abs(r["judged_perplexity"] / r["threshold"] - 1) > 1e-9)


@pytest.mark.parametrize("folder", FOLDERS)
def test_mixing_rows(spark, tables, folder):
    path, rows = rows_of(spark, tables, folder, "op3_source_mixing")
    same([(r["doc_id"], r["tokens"]) for r in rows], [(i, len(brute.words(t))) for i, t in documents(spark, path)])
    assert all(0 <= r["rate"] <= 4 and abs(r["p_good"] + r["p_plain"] + r["p_toxic"] - 1) < 1e-6 for r in rows)


@pytest.mark.parametrize("folder", FOLDERS)
def test_pipeline(spark, tables, folder):
    import corpus_pipeline as P

    path = tables.get(folder, folder)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    given = docs.columns
    for name, stage in P.STAGES[:-1]:
        out = P.saved(stage(spark, docs, path), f"test-{name}")
        assert out.columns == given
        ids = [r[0] for r in out.select("doc_id").collect()]
        assert {*ids} <= {r[0] for r in docs.select("doc_id").collect()}
        if name == "near_duplicates":
            want = brute.groups({r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] is not None}, 5, 80)
            assert {i for i in ids if i is not None} == {i for i, (_, c) in want.items() if i == c}
        if name == "secrets":
            assert all(brute.secrets(r["text"])[:3] == [0, 0, 0] for r in out.collect())
            assert out.count() == docs.count()
        docs = out
    assert P.STAGES[-1][1](spark, docs, path).agg(F.sum("length")).first()[0] is not None or docs.count() == 0
