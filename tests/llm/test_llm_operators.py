"""Interfaces of the operators beyond the queries."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from talkweave.llm import common, html, mixing, packing, perplexity, pii, quality, secrets, shards, shingles, spans, tokens, topk


def test_ledger_scans_unseen_pairs_only(spark):
    versions = spark.createDataFrame([("a", "token=abcdefghijklmn"), ("b", "token=abcdefghijklmn"), ("c", "x")], "path string, text string")
    found, scanned = secrets.scan_unseen(versions, "path", "text")
    assert found.count() == 1 and scanned.count() == 2
    again, more = secrets.scan_unseen(versions, "path", "text", scanned=scanned)
    assert again.count() == 0 and more.count() == 0
    newer = [secrets.RULES[0]._replace(version=2), *secrets.RULES[1:]]
    third, ledger = secrets.scan_unseen(versions, "path", "text", newer, scanned)
    assert [r["version"] for r in third.collect()] == [2]
    assert {tuple(r["rules"]) for r in ledger.collect()} == {("assign@2",)}
    back = secrets.secret_findings(versions, "path", third, newer).collect()
    assert sorted((r["path"], r["n_assign"]) for r in back) == [("a", 1), ("b", 1), ("c", 0)]


def test_stored_ledger_takes_in_deliveries(spark, tmp_path):
    first = spark.createDataFrame([("a", "token=abcdefghijklmn"), ("b", None)], "path string, text string")
    second = spark.createDataFrame([("c", "token=abcdefghijklmn"), ("d", "x 0123456789abcdef0")], "path string, text string")
    folder = f"{tmp_path}/ledger"
    assert secrets.extend_ledger(first, "path", "text", folder, "1").count() == 1
    for _ in range(2):
        # Taken in again, a delivery replaces itself; what the first one held is not scanned again.
        found = secrets.extend_ledger(second, "path", "text", folder, "2")
        assert found.count() == 2
        assert spark.read.parquet(f"{folder}/scanned/delivery=2").count() == 1
    secrets.extend_ledger(first.union(second), "path", "text", folder, "3")
    assert spark.read.parquet(f"{folder}/scanned/delivery=3").count() == 0
    back = secrets.secret_findings(first.union(second), "path", found).collect()
    assert sorted((r["path"], r["n_assign"], r["n_hex"]) for r in back) == [("a", 1, 0), ("b", 0, 0), ("c", 1, 0), ("d", 0, 1)]


def test_shards_are_written_in_slot_order(spark, tmp_path):
    rows = spark.range(500).select(F.col("id"), F.lit(200_000).cast("long").alias("size"), F.lit("t").alias("text"))
    done = shards.shuffled_shards(rows, "id", "size", 3, bucket_bytes=1 << 20)
    assert done.count() == 500
    again = shards.shuffled_shards(rows, "id", "size", 3, bucket_bytes=1 << 20)
    assert sorted(map(tuple, done.collect())) == sorted(map(tuple, again.collect()))
    shards.write_shards(done, f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == 500 and set(back.columns) == {"id", "size", "text", "shard", "slot"}


def test_ablations(spark):
    docs = spark.createDataFrame([(1, "short"), (2, " ".join(f"w{i}" for i in range(50))), (3, "*** " * 40)], "doc_id long, text string")
    rows = quality.ledger(docs, "doc_id")
    assert {r["doc_id"] for r in rows.filter(quality.passes()).collect()} == {2}
    effect = {r["rule"]: (r["fails"], r["only"]) for r in quality.ablations(rows).collect()}
    assert effect["few_words"] == (1, 1) and effect["symbols"] == (1, 0) and effect["repeated"] == (1, 0)


@pytest.mark.parametrize("seed", range(3))
def test_bins_hold_every_limit(seed):
    draw = np.random.default_rng(seed)
    sizes = np.stack([draw.integers(1, 101, 300), np.ones(300, int), draw.integers(0, 41, 300)], axis=1)
    limits = np.array([100, 5, 40])
    bins = packing.fill(sizes, limits)
    assert sorted(i for b in bins for i in b) == list(range(300))
    assert all((sizes[b].sum(axis=0) <= limits).all() for b in bins)


@pytest.mark.parametrize("seed", range(5))
def test_threshold_search_is_exact(seed):
    draw = np.random.default_rng(seed)
    v = draw.integers(-3, 4, (500, 6)).astype(float)
    ids = draw.permutation(500)
    lists = topk.SortedLists(ids, v)
    for q in v[:20]:
        own = ids[0]
        best, scores = lists.top(own, q, 7)
        want = sorted((-(x @ q), i) for x, i in zip(v, ids) if i != own)[:7]
        assert [(-s, ids[b]) for b, s in zip(best, scores)] == want


@pytest.mark.parametrize("seed", range(8))
def test_trie_finds_exactly_the_similar_sets(seed):
    draw = np.random.default_rng(seed)
    percent = 70
    base = [draw.choice(60, draw.integers(1, 30), replace=False) for _ in range(12)]
    sets = [np.unique(np.concatenate([b[1:], draw.integers(0, 60, draw.integers(1, 3))])).astype(np.uint64) for b in base for _ in range(4)]
    trie = shingles.Trie(percent)
    for k, s in enumerate(sets):
        trie.add(k, s)
    for x in sets:
        common = [len(np.intersect1d(x, y)) for y in sets]
        want = [k for k, (y, c) in enumerate(zip(sets, common)) if 100 * c >= percent * (len(x) + len(y) - c)]
        assert sorted(trie.similar(x)) == want


def test_sketches_rule_out_no_link():
    draw = np.random.default_rng(2)
    for _ in range(200):
        x = np.unique(draw.integers(0, 1 << 62, draw.integers(1, 900)).astype(np.uint64) << np.uint64(1))
        y = np.unique(np.concatenate([x[draw.random(len(x)) > 0.08], draw.integers(0, 1 << 62, len(x) // 12).astype(np.uint64)]))
        common = len(np.intersect1d(x, y))
        if 100 * common >= 85 * (len(x) + len(y) - common):
            a, b = (np.frombuffer(shingles.sketch(s), np.uint8) for s in (x, y))
            assert shingles.possible(85, len(x), len(y), a, b)


@pytest.mark.parametrize("seed", range(4))
def test_cells_join_all_components_with_few_links(seed):
    draw = np.random.default_rng(seed)
    words = draw.integers(0, 1 << 62, 4000).astype(np.uint64)
    sets = []
    for g in range(6):
        base = np.unique(words[draw.integers(0, 4000, draw.integers(20, 90))])
        sets += [base[np.sort(draw.choice(len(base), draw.integers(len(base) - 8, len(base) + 1), replace=False))] for _ in range(15)]
    keys = draw.permutation(1000)[:len(sets)].tolist()
    # A few components are known before.
    roots = [k if i % 5 else keys[i - i % 15] for i, k in enumerate(keys)]
    links = [
        (a, b) for i, (a, x) in enumerate(zip(keys, sets)) for b, y in zip(keys[:i], sets)
        if 100 * (c := len(np.intersect1d(x, y))) >= 85 * (len(x) + len(y) - c)
    ]
    got = list(shingles.cell_links(85, keys, roots, sets, np.sort(words[:50])))
    assert {frozenset(p) for p in got} <= {frozenset(p) for p in links} and len(got) < len(set(roots))

    def parts(pairs):
        joined = shingles.Roots()
        for a, b in [*zip(keys, roots), *pairs]:
            joined.join(a, b)
        return [joined.of(a) == joined.of(b) for a in keys for b in keys]

    assert parts(got) == parts(links)


def test_large_cells_and_chains_keep_every_link(spark, monkeypatch):
    import brute

    monkeypatch.setattr(shingles, "CELL", 4)
    monkeypatch.setattr(shingles, "FREQUENT", 3)
    draw = np.random.default_rng(1)
    texts = {}
    for g in range(6):
        line = [f"g{g}w{i}" for i in range(60)]
        for c in range(12):
            # Each copy differs a little more from the first, so links form chains.
            texts[g * 100 + c] = " ".join([*line[c:], *[f"t{c}x{i}" for i in range(c % 3)]])
    for i in range(30):
        texts[1000 + i] = " ".join(["a common passage of some words that many hold"] * 1 + [f"u{draw.integers(1e9)}" for _ in range(draw.integers(1, 9))])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in shingles.similar_groups(docs, 4, 85).collect()}
    assert got == brute.groups(texts, 4, 85)


def test_kneser_ney_against_plain_counts(spark):
    texts = ["a b a b c", "a b d", "b c a", "a b a", "c c a b", "d a b c"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    model, bigrams = perplexity.train(docs, min_share=1e-9)
    counts = {r["key"]: r["n"] for r in bigrams.collect()}
    size = len(model.vocabulary)
    for before in {k >> 20 for k in counts}:
        keys = np.array([(before << 20) | c for c in range(size)], np.int64)
        low = model.lower(keys) + np.where(np.arange(size) == perplexity.UNKNOWN, model.spread, 0.0)
        n = np.array([counts.get(int(k), 0) for k in keys])
        assert np.exp(low + model.gain(keys, n)).sum() == pytest.approx(1.0)
    rows = perplexity.scored(docs.selectExpr("monotonically_increasing_id() AS doc_id", "text", "'en' AS lang"), model, bigrams).collect()
    assert len(rows) == len(texts) and all(r["log_prob"] < 0 for r in rows)


def test_scores_do_not_depend_on_blocks_or_shards(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 13}" for j in range(i % 17)), "en") for i in range(200)], "doc_id long, text string, lang string")
    model, bigrams = perplexity.train(docs.select("text"), min_share=1e-9)
    one = {r["doc_id"]: r["log_prob"] for r in perplexity.scored(docs, model, bigrams).collect()}
    monkeypatch.setattr(perplexity, "HOT", 5)
    monkeypatch.setattr(perplexity, "BLOCK_DOCS", 7)
    monkeypatch.setattr(perplexity, "SHARD_WORDS", 100)
    two = {r["doc_id"]: r["log_prob"] for r in perplexity.scored(docs.repartition(5), model, bigrams).collect()}
    assert one.keys() == two.keys() and all(one[k] == pytest.approx(two[k]) for k in one)


def test_documents_are_scored_in_parts(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 13}" for j in range(i % 17)), "en") for i in range(200)], "doc_id long, text string, lang string")
    model, bigrams = perplexity.train(docs.select("text"), min_share=1e-9)
    monkeypatch.setattr(perplexity, "SHARD_WORDS", 100)
    written, save = [], common.saved
    monkeypatch.setattr(common, "saved", lambda df, *rest: written.append(save(df, *rest)) or written[-1])
    assert perplexity.scored(docs, model, bigrams).count() == 200
    parts = [df.count() for df in written if "log_prob" in df.columns]
    assert len(parts) == perplexity.PARTS and sum(parts) == 200 and max(parts) < 70


def test_word_hashes_split_as_words():
    import brute
    import pyarrow as pa

    texts = ["a b", "", "  x\ty ", "b", "é😀 a", "\x85a\xa0b", "a b"]
    ids = {}
    for _, data, offsets in tokens.chunks(pa.array(texts), 4):
        for h, r in zip(*tokens.word_hashes(data, offsets)):
            ids.setdefault(int(h), 0)
    assert len(ids) == len({w for t in texts for w in brute.words(t)})


def test_word_hashes_tell_long_words_apart():
    import pyarrow as pa

    # A word of 1,024 letters by the parity of the bits of each place, and its complement: equal under polynomials modulo 2 ** 64.
    bits = [i.bit_count() % 2 for i in range(1024)]
    texts = ["".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits), "ab", "ba", "a" * 1024, "b" + "a" * 1023]
    found = [int(h) for _, data, offsets in tokens.chunks(pa.array(texts)) for h in tokens.word_hashes(data, offsets)[0]]
    assert len(set(found)) == len(texts)
    upper = [int(h) for _, data, offsets in tokens.chunks(pa.array([t.upper() for t in texts])) for h in tokens.word_hashes(data, offsets, True)[0]]
    assert upper == found


def test_rates_meet_reachable_targets(spark):
    draw = np.random.default_rng(3)
    rows = [(int(t), [float(a), float(1 - a - b), float(b)]) for t, a, b in zip(draw.integers(10, 900, 500), draw.uniform(0.5, 0.9, 500), draw.uniform(0, 0.1, 500))]
    rows += [(200, [0.0, 0.05, 0.95])] * 60
    df = spark.createDataFrame(rows, "tokens long, p array<double>")
    residuals = mixing.fit_rates(df, np.array([0.75, 0.25, 0.0]), ridge=1e-3, tolerance=1e-2)
    out = mixing.with_rates(df, residuals, "p", "rate", ridge=1e-3).collect()
    t, p, r = (np.array([x[n] for x in out]) for n in ("tokens", "p", "rate"))
    assert (r >= 0).all()
    share = (t * r) @ p / t.sum()
    assert abs(share[0] - 0.75) < 0.02 and share[2] < 0.03
    replayed, *_ = mixing.rates_of(residuals, p, 1e-3, mixing.MAX_RATE)
    assert np.allclose(r, replayed)


@pytest.mark.parametrize("seed", range(2))
def test_rates_against_the_minimum(spark, seed):
    draw = np.random.default_rng(seed)
    t = draw.integers(1, 2000, 400)
    p = draw.dirichlet([0.6, 0.3, 0.1], 400)
    targets = np.array([0.9, 0.1, 0.0])
    df = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(t, p)], "tokens long, p array<double>")
    rates = mixing.with_rates(df, mixing.fit_rates(df, targets), "p", "rate").collect()
    got = np.array([r["rate"] for r in rates])
    # Plain projected gradient steps in memory, very many of them.
    t, p = np.array([r["tokens"] for r in rates]), np.array([r["p"] for r in rates])
    present = t @ p / t.sum()
    r = np.ones(400)
    for _ in range(60_000):
        gap = (t * r) @ p / t.sum() - targets
        r = np.clip(r - (p @ (gap / present) + mixing.RIDGE * (r - 1)) / (1 + mixing.RIDGE), 0.0, mixing.MAX_RATE)
    assert np.sqrt((t * (got - r) ** 2).sum() / t.sum()) < 1e-3
    assert np.abs(got - r).max() < 1e-2


PAGE = """<html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a>Menu one two three</a></ul></nav>
<header><p>Head words here</p></header><div class="ad">Buy now very cheap</div><div class="cookie-notice">We use cookies a lot</div>
<article><h1>Title &amp; more</h1><p>First <b>bold</b>
 text<br>next<p>Second&nbsp;para &lt;x&gt;</p><form>Your name <input></form><div id="comments"><p>I like it very much indeed</p></div></article>
<aside>Side words</aside><footer>&copy; foot</footer></body></html>"""


def test_article_text():
    assert html.extract(PAGE, {}) == "Title & more\n\nFirst bold text next\n\nSecond para <x>"


def test_page_without_article_takes_the_best_region():
    page = "<body>" + "<a>x</a>" * 30 + "<div><p>" + "many words here " * 20 + "</p><p>and some more</p></div>" + "<a>y</a>" * 30
    text = html.extract(page, {"a": -3.0, "/a": -3.0})
    assert "many words" in text and "and some more" in text and "x" not in text.split()


def test_largest_region():
    assert html.best_region([1.0, -2.0, 3.0, -1.0, 2.0, -9.0, 3.0]) == (2, 5)
    assert html.best_region([-1.0]) == (0, 0)


def test_spans_count_code_points(spark):
    df = spark.createDataFrame([("b", "😀 aaaa é aaaa")], "blob string, text string")
    rows = spans.find_spans(df, [spans.Rule("a", 1, "a{4}")]).orderBy("start").collect()
    assert [(r["start"], r["end"]) for r in rows] == [(2, 6), (9, 13)]


def test_a_block_holds_no_more_documents_than_places(spark, monkeypatch):
    monkeypatch.setattr(perplexity, "HOT", 0)
    # The first text closes its block in mid-batch, so the next one would close only at 69,999 documents.
    texts = ["x y " * 1_000_000, *["a b c d" if i % 2 else "d c b a" for i in range(69_999)]]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").coalesce(1)
    model, bigrams = perplexity.train(spark.createDataFrame([("a b c d",), ("a b c",), ("d a b",)], "text string"), min_share=1e-9)
    found = perplexity.scored(docs, model, bigrams).filter("doc_id > 0").groupBy(F.expr("doc_id % 2")).agg(F.min("log_prob"), F.max("log_prob"), F.count("*")).collect()
    assert sum(r[3] for r in found) == 69_999 and all(r[1] == pytest.approx(r[2]) for r in found)


def test_rare_words_keep_their_counts(spark, monkeypatch):
    texts = [" ".join(f"w{(i * j * j + j) % (7 + i)}" for j in range(30)) for i in range(20)] + ["once only", "w1 once2 w2 once"]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate([*texts, "never w1 seen", ""])], "doc_id long, text string, lang string")
    trusted = docs.filter(f"doc_id < {len(texts)}").select("text")

    def scores(min_share, hot):
        monkeypatch.setattr(perplexity, "HOT", hot)
        model, table = perplexity.train(trusted, min_share)
        return len(model.vocabulary), table.count(), {r["doc_id"]: r["log_prob"] for r in perplexity.scored(docs, model, table).collect()}

    # Where a word's statistics are kept changes no score.
    sent, rows, one = scores(1e-9, 1 << 16)
    for share in (0.03, 1.0):
        size, more, two = scores(share, 3)
        assert size < sent and more > rows
        assert one.keys() == two.keys() and all(one[k] == pytest.approx(two[k], rel=1e-5) for k in one)


def test_packed_sequences_hold_ids_and_loss(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    texts = ["a prompt and its answer " * k for k in range(1, 40)]
    want = [[*model.encode(t, add_special_tokens=False).ids, 0] for t in texts]
    docs = spark.createDataFrame([(i, t, None if i == 3 else i % 7) for i, t in enumerate(texts)], "doc_id long, text string, answer int")
    rows = packing.pack_documents(docs, limit=64, loss_limit=32, loss=F.col("answer")).collect()
    got, sequences = {}, {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        got.setdefault(r["doc_id"], []).extend(r["ids"])
        own = len(want[r["doc_id"]]) if r["doc_id"] == 3 else r["doc_id"] % 7
        bears = range(len(want[r["doc_id"]]) - own, len(want[r["doc_id"]]))
        assert r["loss_tokens"] == sum(at in bears for at in range(r["start"], r["start"] + r["length"]))
        sequences.setdefault(r["sequence_id"], []).append(r)
    assert [got[i] for i in range(len(texts))] == want
    assert all(sum(r["length"] for r in s) <= 64 and sum(r["loss_tokens"] for r in s) <= 32 for s in sequences.values())


def test_shard_files_hold_whole_records_in_even_buckets(spark, monkeypatch):
    written = []
    monkeypatch.setattr(shards, "saved", lambda df, purpose, folders: written.append(common.saved(df, purpose, folders)) or written[-1])
    # Half of the rows have no key and are equal.
    rows = spark.range(2000).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("id"), F.lit("t").alias("text"), F.lit(1 << 16).cast("long").alias("size"))
    done = shards.shuffled_shards(rows, "id", "size", 4, bucket_bytes=4 << 20).collect()
    assert len(done) == 2000 and len({r["shard"] for r in done if r["id"] is None}) == 1
    files = written[0]
    assert {"shard", "bucket", "c0", "c1", "c2"} <= set(files.columns) and files.filter("c1 = 't'").count() == 2000
    assert files.groupBy("shard", "bucket").count().agg(F.max("count")).first()[0] <= 2 * 64
    for shard in {r["shard"] for r in done}:
        slots = [r["slot"] for r in done if r["shard"] == shard]
        assert sorted(slots) == list(range(len(slots)))


def test_pipeline_filters_rows_not_ids(spark, tmp_path):
    import corpus_pipeline

    one, two, three = (" ".join(f"{p}{i}" for i in range(40)) for p in "abc")
    rows = [(None, one), (5, one), (7, two), (7, two), (None, three), (None, three), (7, one), (None, "")]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    got = corpus_pipeline.near_duplicates(spark, docs, "").select("doc_id", "text").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [(5, one), (7, two), (None, three), (None, "")]))
    # Without trusted text only rows without words go, whatever other rows of their id do.
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.quality(spark, docs, str(tmp_path)).count() == 7
    spark.createDataFrame([(5, 1, 0), (7, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/more/labels.parquet")
    kept = corpus_pipeline.quality(spark, docs, f"{tmp_path}/more").collect()
    assert all(r["text"] for r in kept)


def test_thresholds_cover_all_candidates_and_whole_matches(spark):
    rows = spark.range(4000).select(F.lit("b").alias("blob"), F.col("id").alias("start"), (F.col("id") + 9).alias("end"), (F.col("id") % 2).cast("double").alias("label"), F.lit(0).alias("vector"))
    fit, held_out = pii.folds(rows, 100)
    every = rows.filter("xxhash64(blob, start, end) % 4 = 0").count()
    assert fit.count() == 100 and held_out.count() == every > 900
    text = spark.createDataFrame([("b", "tel " + "1" * 100 + "-" * 2 + "2" * 50)], "blob string, text string")
    found = pii.features(spans.find_spans(text, [pii.GENERATORS[0]], context=pii.CONTEXT)).collect()
    assert [(r["digits"], r["dashes"], r["size"]) for r in found] == [(150.0, 2.0, 152.0)]


@pytest.mark.parametrize("page", [
    "<div class='layout has-sidebar'><article><h1>Head</h1><p>Body text of it</article></div>",
    "<div class='layout sidebar'><div id=menu>x</div><main><h1>Head</h1><p>Body text of it</main></div>",
    "<div class='no-sidebar'><article class='post related-posts-on related'><h2 id='related'>Head</h2><p>Body text of it</article></div>",
    "<article><div class='entry-header header'><h1 class='banner'>Head</h1></div><p>Body text of it<div class='ad wide'>Buy</div></article>",
])
def test_marks_leave_content_and_headings(page):
    assert html.extract(page, {}) == "Head\n\nBody text of it"


@pytest.mark.parametrize("name", [
    "comment-list", "reader-comments", "ad-slot", "advertisement-box", "cookie-banner", "site-menu", "post-meta share-buttons", "user-comments",
    "userComments", "comment-body", "newsletter-signup", "google_ad_1",
])
def test_marks_inside_and_without_articles(name):
    extra = f"<div class='{name}'><p>{'Not of the text at all ' * 30}</div>"
    assert html.extract(f"<article><h1>Head</h1><p>Body text of it{extra}</article>", {}) == "Head\n\nBody text of it"
    assert html.extract(f"<body><div><h1>A head of five words</h1><p>Body text of it</div>{extra}</body>", {}) == "A head of five words\n\nBody text of it"


@pytest.mark.parametrize("name", ["has-comments", "no-ads", "ad-free", "social-science-body", "post comments-open", "shareholders", "address", "navy"])
def test_other_names_stay(name):
    assert html.extract(f"<article><h1>Head</h1><div class='{name}' data-class='ad'><p>Body text of it</div></article>", {}) == "Head\n\nBody text of it"


def test_comments_as_articles_and_hidden_text():
    page = (
        "<main><article class='post'><h1>Head</h1><p>Body text of it<p hidden>not<p style='color:red; display:none'>shown</p></article>"
        "<div class='comments-area'><article class='comment-body'><p>" + "A reader says much " * 40 + "</article></div></main>"
    )
    assert html.extract(page, {}) == "Head\n\nBody text of it"


def test_class_words_have_weights(spark):
    page = "<article><p class='x'>a b c</p></article><div class='column'><p class='column'>d</p></div>"
    weights = html.tag_weights(spark.createDataFrame([(page,)] * 30, "html string"), "html")
    assert weights["p"] == -1.0 and weights[".column"] < -3 and weights[".?"] == 0 and weights["div"] < -4
    bare = "<div><p>" + "word " * 20 + "</p></div><p class='column'>e f</p>"
    assert html.extract(bare, weights) == ("word " * 20).strip()


@pytest.mark.parametrize("seed", range(20))
def test_region_against_all_runs(seed):
    scores = [float(x) for x in np.random.default_rng(seed).integers(-4, 5, 40)]
    runs = [(sum(scores[i:j]), i, j) for i in range(40) for j in range(i + 1, 41)]
    start, end = html.best_region(scores)
    assert sum(scores[start:end]) == max(0.0, max(runs)[0])


@pytest.mark.parametrize("page", [
    "<b>" * 150_000 + "</i>" * 150_000, "<a " * 300_000, "<a \"" * 250_000, "<li><ul>" + "<b>" * 100_000 + "<li></li>" * 60_000,
    "<p class='ad'>" * 70_000, "<script>" * 120_000, "<article>" * 100_000, "<!--" * 250_000, "<a b='<c \"" * 90_000,
])
def test_broken_pages_take_linear_time(page):
    from time import process_time

    began = process_time()
    html.extract(page, {})
    assert process_time() - began < 5


def test_html_of_given_pages(spark):
    """The given pages have their text in one article; an own reading of it by patterns."""
    import html as entities
    import re

    def text(page):
        body = re.search("(?s)<article>(.*)</article>", page)[1]
        blocks = re.split(r"</?(?:p|h1|h2|div|ul|ol|li|section|blockquote)>", body.replace("<br>", " "))
        lines = [" ".join(entities.unescape(re.sub("<[^>]*>", "", b)).split()) for b in blocks]
        return "\n\n".join(line for line in lines if line)

    path = "/root/testdata/sf0.001"
    rows = html.op9(spark, path).collect()
    want = {r["page_id"]: text(r["html"]) for r in spark.read.parquet(f"{path}/pages.parquet").collect()}
    assert {r["page_id"]: r["text"] for r in rows} == want


def test_texts_are_encoded_run_by_run():
    """Words that differ in marks share their letters' run, and every text has the tokenizer's ids (op10)."""
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(packing.TOKENIZER)
    encode, model = packing.RunTokenizer(path), Tokenizer.from_file(path)

    def ids_of(texts):
        column = pa.array(texts, pa.string())
        out = []
        for at, data, offsets in tokens.chunks(column, 40):
            ids, n = encode(column.slice(at, len(offsets) - 1), data, offsets)
            out += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
        return out

    assert ids_of(["so heatre, heatre. heatre!! it's"]) == [[*model.encode("so heatre, heatre. heatre!! it's", add_special_tokens=False).ids, 0]]
    assert {r for r in encode.known if "heatre" in r} == {" heatre"} and " it's" in encode.known
    draw = random.Random(5)
    parts = ["a", "B", "é", "×", "'s", "7", "²", "\n", "\n\n", "\t", " ", "  ", "\x1c", "\0", "\x85", "\u3000", "Ā", "漢", "х", "!", "<|endoftext|>", "Ġ", "ª"]
    texts = ["".join(draw.choice(parts) + draw.choice(["", "", " "]) for _ in range(draw.randrange(12))) for _ in range(3000)]
    assert ids_of(texts) == [[*e.ids, 0] for e in model.encode_batch(texts, add_special_tokens=False)]


def test_rows_with_texts_are_shuffled_in_parts(spark, monkeypatch):
    """The links of many pairs and cells are found part by part, and all of them (op5, pipeline)."""
    words = [f"w{i}" for i in range(40)]
    rows = [(g * 100 + i, " ".join([f"g{g}", *words[:30 + g % 7], f"x{i % 3}"])) for g in range(30) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    parts = []
    monkeypatch.setattr(shingles, "saved_parts", lambda tables, purpose: parts.append(len(tables)) or common.saved_parts(tables, purpose))
    one = {r.doc_id: r.component_id for r in shingles.similar_groups(docs, 4, 85).collect()}
    assert set(parts) == {1}
    monkeypatch.setattr(shingles, "PART_ROWS", 1)
    assert {r.doc_id: r.component_id for r in shingles.similar_groups(docs, 4, 85).collect()} == one
    assert shingles.PARTS in parts and len(set(one.values())) < len(one)
