"""Quality by the perplexity of an interpolated modified Kneser-Ney bigram model.

The model is trained on all trusted text and keeps the counts of every word and every bigram.  Words
that make up at least the share ``min_share`` of it (so at most ``1 / min_share`` words) have classes and
are sent to the tasks with their statistics, so that they are scored in place.  All other words go by
their hash: their statistics are joined with the bigrams they are in, and what a rare word or a bigram
adds to the score of an unseen one stays in shards by hash, which grow with the input.  Scoring sends
each shard the rare words and bigrams of blocks of documents (distinct per document, with counts), joins
them there and returns partial sums per document and cell.  It runs in up to ``PARTS`` parts of the documents, one after another, so
that only one part's bigrams are on disk at a time.  The few most frequent bigrams are scored in place,
so that no shard has a hot key.

Thresholds are quantiles by language of held-out trusted documents that the model has not seen.

Defined results: null or wordless text has null perplexity and is not kept; a null or unseen language
uses the quantile over all languages; without any trusted text every document with words is kept.
Repeated rows are scored as often as they occur; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkweave.llm import register
from talkweave.llm.common import dropped, saved, saved_parts, table, whole
from talkweave.llm.tokens import chunks, mixed, word_hashes

MIN_SHARE = 1e-5
HOT = 1 << 16
SENT_IDS = 2_000_000
FOLDS = 5
QUANTILE = 0.995
SLACK = 1.5
PRIOR_WORDS = 20
SHARD_WORDS = 8_000_000
BLOCK_WORDS = 2_000_000
BLOCK_DOCS = 60_000
PARTS = 6
GAIN_PARTS = 3
GAIN_ROWS = 1 << 20
PLACES = 1 << 16
EDGE, UNKNOWN, FIRST = 0, 1, 2
SHIFT = np.int64(20)
# Sign bit of the ids of words without a class, and of the keys of bigrams that hold one.
RARE = np.uint64(1 << 63)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """(doc_id, fold) of documents labelled good and not toxic; fold 0 is held out."""
    good = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t")
    )
    return good.filter("q = 1 AND t = 0").select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).alias("fold"))


def _counted(docs: DataFrame, names: list[str], keys_of) -> DataFrame:
    """(names, n) over all texts; ``keys_of`` maps (words, rows, number of rows) of a chunk to a column per name."""

    def run(batches):
        for batch in batches:
            for _, data, offsets in chunks(batch.column(0)):
                columns = [c.view(np.int64) for c in keys_of(*word_hashes(data, offsets), len(offsets) - 1)]
                first, order = _runs(columns, np.lexsort(columns))
                n = np.diff(first, append=len(order))
                yield pa.RecordBatch.from_arrays([*[pa.array(c[order[first]]) for c in columns], pa.array(n.astype(np.int64))], [*names, "n"])

    schema = ", ".join(f"{n} long" for n in [*names, "n"])
    return docs.select(whole(F.col("text")).alias("t")).mapInArrow(run, schema).groupBy(*names).agg(F.sum("n").alias("n"))


def _runs(columns: list[np.ndarray], order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts of runs of equal rows in the given order, the order)."""
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        c = c[order]
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new), order


def bigram_keys(before: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Keys of bigrams of word ids: both classes side by side, or a hash if a word has none."""
    hashed = mixed(mixed(before.view(np.uint64)) * np.uint64(3) + last.view(np.uint64)) | RARE
    return np.where((before < 0) | (last < 0), hashed.view(np.int64), (before << SHIFT) | last)


class Vocabulary:
    """Word hash -> class, for the frequent words."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes)

    def __len__(self) -> int:
        return len(self.hashes) + FIRST

    def classes(self, words: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(words), UNKNOWN, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
        return np.where(self.hashes[at] == words, at + FIRST, UNKNOWN).astype(np.int64)

    def ids(self, words: np.ndarray) -> np.ndarray:
        """The class of a word, or else its hash with the sign bit set."""
        classes = self.classes(words)
        return np.where(classes == UNKNOWN, (words | RARE).view(np.int64), classes)

    def pairs(self, words: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(id of the word before, id, row) for every word and the end of every text."""
        each = np.bincount(rows, minlength=n_rows) + 2
        stops = np.cumsum(each)
        line = np.full(int(stops[-1]) if n_rows else 0, EDGE, np.int64)
        line[np.arange(len(words)) + 2 * rows + 1] = self.ids(words)
        inner = np.ones(max(len(line) - 1, 0), bool)
        inner[stops[:-1] - 1] = False
        return line[:-1][inner], line[1:][inner], np.repeat(np.arange(n_rows), each - 1)


def discounts(ones: float, twos: float, threes: float, fours: float) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more, from counts of counts."""
    if not ones or not twos:
        return np.array([0.0, 0.5, 0.5, 0.5])
    y = ones / (ones + 2 * twos)
    d = [0.0, 1 - 2 * y * twos / ones, 2 - 3 * y * threes / twos, 3 - 4 * y * fours / threes if threes else 1.5]
    return np.clip(np.array(d), 0.0, [0.0, 1.0, 2.0, 3.0])


class Model:
    """What is sent to the tasks: discounts and the statistics of the words that have a class.

    ``words`` has a row per distinct word of the trusted text and one for the edge: id, total, n1, n2, n3
    (bigrams it begins, in all and by count) and kinds (distinct words before it).
    """

    spread = 0.0  # unseen words are one class, whose probability is not divided further

    def __init__(self, vocabulary: Vocabulary, counts: list, words: DataFrame):
        size = len(vocabulary)
        self.vocabulary = vocabulary
        self.d = discounts(*counts)
        exact = [F.sum((F.col("kinds") == i).cast("double")) for i in (1, 2, 3, 4)]
        *few, above, mass, types = words.agg(
            *exact, F.sum((F.col("kinds") > 2).cast("double")), F.sum(F.col("kinds").cast("double")), F.count(F.lit(1))
        ).first()
        self.cut, self.mass = discounts(*few), mass
        # The share of the lower order that is dealt out evenly to all words and the unseen one.
        self.floor = float(self.cut[1:] @ [few[0], few[1], above]) / mass / (types + 1)
        # At most one row per word of the vocabulary.
        sent = words.filter("id >= 0").toArrow()
        total, one, two, three, kinds = np.zeros((5, size))
        for values, name in ((total, "total"), (one, "n1"), (two, "n2"), (three, "n3"), (kinds, "kinds")):
            values[sent["id"].to_numpy()] = sent[name].to_numpy()
        self.total = total
        self.back = np.ones(size)
        seen = total > 0
        self.back[seen] = np.maximum((np.stack([one, two, three], axis=1)[seen] @ self.d[1:]) / total[seen], 1e-9)
        self.unigram = np.maximum(kinds - self.cut[np.minimum(kinds, 3).astype(int)], 0) / mass + self.floor

    def rare(self, words: DataFrame) -> DataFrame:
        """(id, total, back, unigram) of the words without a class."""
        cut = F.when(F.col("kinds") > 2, float(self.cut[3])).when(F.col("kinds") == 2, float(self.cut[2])).otherwise(float(self.cut[1]))
        held = sum(F.col(f"n{i}") * float(self.d[i]) for i in (1, 2, 3))
        return words.filter("id < 0").select(
            "id", F.col("total").cast("double").alias("total"), F.greatest(held / F.col("total"), F.lit(1e-9)).alias("back"),
            (F.greatest(F.col("kinds") - cut, F.lit(0.0)) / self.mass + self.floor).alias("unigram"),
        )

    def lower(self, key: np.ndarray) -> np.ndarray:
        """log probability through the lower order, of keys of classes."""
        return np.log(self.back[key >> SHIFT] * self.unigram[key & ((1 << SHIFT) - 1)])

    def gain(self, key: np.ndarray, n: np.ndarray) -> np.ndarray:
        """What the bigram's own count adds to the log probability through the lower order, for keys of classes."""
        before, last = key >> SHIFT, key & ((1 << SHIFT) - 1)
        return self.gain_of(n, self.total[before], self.back[before], self.unigram[last])

    def gain_of(self, n: np.ndarray, total: np.ndarray, back: np.ndarray, unigram: np.ndarray) -> np.ndarray:
        return np.log1p(np.maximum(n - self.d[np.minimum(n, 3)], 0) / total / (back * unigram))


def _with(bigrams: DataFrame, side: str, rare: DataFrame, names: list[str]) -> DataFrame:
    """``bigrams`` with the columns ``names`` of the rare word in column ``side``; null where that word has a class."""
    own = rare.select(F.col("id").alias(side), *names)
    nulls = [F.lit(None).cast("double").alias(n) for n in names]
    found = bigrams.filter(F.col(side) < 0).join(own, side).select(*bigrams.columns, *names)
    return bigrams.filter(F.col(side) >= 0).select("*", *nulls).unionByName(found)


def train(trusted: DataFrame, min_share: float = MIN_SHARE) -> tuple[Model, DataFrame] | None:
    """The model and its saved table (key, n, gain) of bigrams and rare words from trusted (text); None without any word.

    The gain of a rare word is over an unseen word, that of a bigram over the lower order of its words.
    """
    types = saved(_counted(trusted, ["key"], lambda w, rows, n: [w]), "lm-words")
    total = types.agg(F.sum("n")).first()[0]
    if not total:
        return None
    frequent = types.filter(F.col("n") >= max(2.0, total * min_share)).select("key").toArrow()["key"].to_numpy()
    dropped(types)
    vocabulary = Vocabulary(frequent.astype(np.int64).view(np.uint64))
    bigrams = saved(_counted(trusted, ["before", "last"], lambda w, rows, n: vocabulary.pairs(w, rows, n)[:2]), "lm-bigrams")
    many = [F.sum((F.col("n") == i).cast("double")) for i in (1, 2, 3, 4)]
    contexts = bigrams.groupBy(F.col("before").alias("id")).agg(
        F.sum("n").alias("total"), many[0].alias("n1"), many[1].alias("n2"), F.sum((F.col("n") > 2).cast("double")).alias("n3")
    )
    # Every word stands before another or the edge, and behind one.
    follows = bigrams.groupBy(F.col("last").alias("id")).agg(F.count(F.lit(1)).alias("kinds"))
    words = saved(contexts.join(follows, "id"), "lm-statistics")
    model = Model(vocabulary, list(bigrams.agg(*many).first()), words)
    rare = model.rare(words)

    def gains(batches):
        for batch in batches:
            before, last, n, *rest = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            at, to = np.maximum(before, 0), np.maximum(last, 0)
            values = [np.where(ids < 0, v, own) for v, ids, own in zip(rest, (before, before, last), (model.total[at], model.back[at], model.unigram[to]))]
            gain = model.gain_of(n, *values).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array(bigram_keys(before, last)), batch.column(2), pa.array(gain)], ["key", "n", "gain"])

    # Bigrams are joined in parts, so that only one part's shuffles are on disk at a time.
    parts = max(1, min(GAIN_PARTS, int(total) // (SHARD_WORDS // 2)))
    part_of = F.pmod(F.xxhash64("before", "last"), F.lit(parts))
    full = [_with(_with(bigrams.filter(part_of == i), "before", rare, ["total", "back"]), "last", rare, ["unigram"]) for i in range(parts)]
    of_words = rare.select(
        F.col("id").alias("key"), F.col("total").cast("long").alias("n"), (F.log("back") + F.log("unigram") - float(np.log(model.floor))).cast("float").alias("gain")
    )
    both = saved_parts([*[part.mapInArrow(gains, "key long, n long, gain float") for part in full], of_words], "lm-gains")
    dropped(bigrams, words)
    return model, both


def _planes(values: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, which the shuffle's compression makes small."""
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def _unplanes(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


CELL = "shard int, kind int, block long, key long, n long, doc_id long, lang string, score double, payload binary"
_CELL = pa.schema([
    ("shard", pa.int32()), ("kind", pa.int32()), ("block", pa.int64()), ("key", pa.int64()), ("n", pa.int64()),
    ("doc_id", pa.int64()), ("lang", pa.string()), ("score", pa.float64()), ("payload", pa.binary()),
])


# A document, or a cell's partial sums of the documents of a block.
PART = "block long, key long, n long, doc_id long, lang string, score double, payload binary"
_PART = ["block", "key", "n", "doc_id", "lang", "score", "payload"]


def _batch(size: int, /, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in _CELL], schema=_CELL
    )


def _shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (mixed(keys.view(np.uint64)) % np.uint64(shards)).astype(np.int32)


def _gain_cells(shards: int):
    """Gains (key, gain) -> cells of the sorted keys of a shard and their gains."""

    def run(batches):
        held, size = [], 0

        def cells():
            keys, gains = (np.concatenate(c) for c in zip(*held))
            order = np.argsort(keys)
            keys, gains = keys[order], gains[order].astype(np.float32)
            shard = _shard_of(keys, shards)
            for s in np.unique(shard):
                own = shard == s
                raw = _planes(np.diff(keys[own], prepend=0)) + _planes(gains[own])
                yield _batch(1, shard=[s], kind=[0], block=[0], n=[int(own.sum())], payload=[raw])

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += batch.num_rows
            if size >= GAIN_ROWS:
                yield from cells()
                held, size = [], 0
        if size:
            yield from cells()

    return run


def _cells(sent, shards: int, part: int = 0):
    """Documents -> a row per document scored by the lower order and hot bigrams, and cells of rare words and other bigrams."""

    def run(batches):
        model, hot_keys, hot_gains = sent
        first = (part << 48) + (TaskContext.get().partitionId() << 24)
        block, held, n_docs, n_words = first, [], 0, 0

        def cells():
            keys, docs = (np.concatenate(c) for c in zip(*held))
            # Documents of a key are in order already.
            first, order = _runs([keys, docs], np.argsort(keys, kind="stable"))
            n = np.diff(first, append=len(order))
            keys, docs = keys[order[first]], docs[order[first]]
            shard = _shard_of(keys, shards)
            for s in np.unique(shard):
                own = shard == s
                raw = [
                    _planes(np.diff(keys[own], prepend=0)), _planes(docs[own].astype(np.uint16)),
                    _planes(np.minimum(n[own], 0xFFFFFFFF).astype(np.uint32)),
                ]
                yield _batch(1, shard=[s], kind=[1], block=[block], n=[int(own.sum())], payload=[b"".join(raw)])

        for batch in batches:
            for row, data, offsets in chunks(batch.column(1)):
                words, rows = word_hashes(data, offsets)
                size = len(offsets) - 1
                if held and n_docs + size > PLACES:
                    yield from cells()
                    block, held, n_docs, n_words = block + 1, [], 0, 0
                before, last, doc = model.vocabulary.pairs(words, rows, size)
                score = np.bincount(doc, model.lower((np.where(before < 0, UNKNOWN, before) << SHIFT) | np.where(last < 0, UNKNOWN, last)), size)
                rare = last < 0
                key, doc = np.concatenate([bigram_keys(before, last), last[rare]]), np.concatenate([doc, doc[rare]])
                if len(hot_keys):
                    at = np.minimum(np.searchsorted(hot_keys, key), len(hot_keys) - 1)
                    hot = hot_keys[at] == key
                    score += np.bincount(doc[hot], hot_gains[at[hot]], size)
                else:
                    hot = np.zeros(len(key), bool)
                yield _batch(
                    size, shard=np.full(size, block % shards), kind=np.full(size, 2), block=np.full(size, block),
                    key=np.arange(n_docs, n_docs + size), n=np.bincount(rows, minlength=size),
                    doc_id=batch.column(0).slice(row, size).cast(pa.int64()), lang=batch.column(2).slice(row, size),
                    score=score,
                )
                held.append((key[~hot], doc[~hot] + n_docs))
                n_docs, n_words = n_docs + size, n_words + len(key)
                if n_words >= BLOCK_WORDS or n_docs >= BLOCK_DOCS:
                    yield from cells()
                    block, held, n_docs, n_words = block + 1, [], 0, 0
        if held:
            yield from cells()

    return run


def _joined():
    """A shard's cells of gains, then those of its documents, and documents, in this order -> partial sums per document."""

    def run(batches):
        shard, keys, gains, ready = None, [], [], False
        for batch in batches:
            kind, shards = batch.column(1).to_numpy(), batch.column(0).to_numpy()
            starts = np.flatnonzero(np.diff(shards * 4 + kind, prepend=-1))
            for a, b in zip(starts, [*starts[1:], len(kind)]):
                part = batch.slice(a, b - a)
                if shards[a] != shard:
                    shard, keys, gains, ready = shards[a], [], [], False
                if kind[a] == 0:
                    for n, raw in zip(part.column(4).to_pylist(), part.column(8).to_pylist()):
                        keys.append(np.cumsum(_unplanes(raw[:8 * n], np.int64)))
                        gains.append(_unplanes(raw[8 * n:], np.float32))
                    continue
                if kind[a] == 2:
                    yield part.select(_PART)
                    continue
                if not ready:
                    known = np.concatenate(keys or [np.zeros(0, np.int64)])
                    order = np.argsort(known)
                    keys, gains, ready = [known[order]], np.concatenate(gains or [np.zeros(0)])[order].astype(float), True
                for block, n, raw in zip(part.column(2).to_pylist(), part.column(4).to_pylist(), part.column(8).to_pylist()):
                    if not len(keys[0]):
                        continue
                    key = np.cumsum(_unplanes(raw[:8 * n], np.int64))
                    doc, times = _unplanes(raw[8 * n:10 * n], np.uint16), _unplanes(raw[10 * n:], np.uint32)
                    at = np.minimum(np.searchsorted(keys[0], key), len(keys[0]) - 1)
                    hit = keys[0][at] == key
                    score = np.bincount(doc[hit], gains[at[hit]] * times[hit])
                    some = np.flatnonzero(score)
                    sums = _batch(1, block=[block], n=[len(some)], payload=[_planes(some.astype(np.uint16)) + score[some].tobytes()])
                    yield sums.select(_PART)

    return run


def _summed(rows: pa.Table) -> pa.Table:
    """The documents of a block with the sums of their parts."""
    docs, cells = rows.filter(pc.is_null(rows["payload"])), rows.filter(pc.is_valid(rows["payload"]))
    score, place = np.zeros(PLACES), docs["key"].to_numpy()
    score[place] = docs["score"].to_numpy()
    for n, raw in zip(cells["n"].to_pylist(), cells["payload"].to_pylist()):
        score[_unplanes(raw[:2 * n], np.uint16)] += np.frombuffer(raw[2 * n:])
    return pa.table([docs["doc_id"], docs["lang"], docs["n"], pa.array(score[place])], ["doc_id", "lang", "n_words", "log_prob"])


def scored(docs: DataFrame, model: Model, gains: DataFrame, keep: bool = True) -> DataFrame:
    """(doc_id, lang, n_words, log_prob) of every document (doc_id, text, lang), saved; without ``keep`` the table ``gains`` is deleted."""
    hot = gains.orderBy(F.desc("n"), "key").limit(HOT).toArrow()
    keys = hot["key"].to_numpy()
    order = np.argsort(keys)
    sent = (model, keys[order], hot["gain"].to_numpy()[order].astype(float))
    words = gains.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-int(words) // (SHARD_WORDS // 2)))
    parts = min(PARTS, shards)
    packed = saved(gains.select("key", "gain").mapInArrow(_gain_cells(shards), CELL), "lm-packed")
    if not keep:
        dropped(gains)
    found = []
    for part in range(parts):
        # Of equal texts, each with an id of its own, every part has some.
        own = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)) == part)
        rows = own.select("doc_id", whole(F.col("text")).alias("text"), F.col("lang").cast("string"))
        both = packed.unionByName(rows.mapInArrow(_cells(sent, shards, part), CELL))
        sums = both.repartition(shards, "shard").sortWithinPartitions("shard", "kind", "block").mapInArrow(_joined(), PART)
        found.append(sums.groupBy("block").applyInArrow(_summed, "doc_id long, lang string, n_words long, log_prob double"))
    out = saved_parts(found, "lm-scores")
    dropped(packed)
    return out


def judged(
    docs: DataFrame, labels: DataFrame, min_share: float = MIN_SHARE, quantile: float = QUANTILE, key: str = "doc_id"
) -> DataFrame:
    """(key, lang, n_words, perplexity, judged_perplexity, threshold, kept) of every document (doc_id, text, lang, and a long ``key``).

    Perplexity is per word.  For the decision, short texts are drawn to their language's median as if by
    ``PRIOR_WORDS`` more words, which gives ``judged_perplexity``; a document goes if that lies above its
    language's quantile of held-out trusted documents, with half as much again for slack.
    """
    trusted = trusted_ids(labels)
    training = trusted.filter("fold != 0").select("doc_id")
    if training.count() <= SENT_IDS:
        training = F.broadcast(training)
    trained = train(docs.select("doc_id", "text").join(training, "doc_id", "left_semi").select("text"), min_share)
    if trained is None:
        rows = docs.select(key, "lang", F.size(F.filter(F.split(whole(F.col("text")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long").alias("n_words"))
        blank = F.lit(None).cast("double")
        return rows.select("*", blank.alias("perplexity"), blank.alias("judged_perplexity"), blank.alias("threshold"), (F.col("n_words") > 0).alias("kept"))
    keyed = docs.select(F.col(key).alias("doc_id"), "text", "lang")
    scores = scored(keyed, *trained, keep=False).withColumnRenamed("doc_id", key).withColumn("nll", -F.col("log_prob") / (F.col("n_words") + 1))
    unseen = trusted.filter("fold = 0").select("doc_id")
    if key != "doc_id":
        unseen = docs.select("doc_id", key).join(unseen, "doc_id", "left_semi").select(key)
    held_out = saved(
        scores.filter("n_words > 0").join(unseen, key, "left_semi")
        .select("lang", "nll", "n_words"),
        "lm-held-out",
    )

    def by_language(rows: DataFrame, value, share: float, name: str) -> tuple[DataFrame, float | None]:
        at = F.percentile_approx(value, F.lit(share), F.lit(10000)).alias(name)
        return rows.groupBy("lang").agg(at), rows.agg(at).first()[0]

    medians, median = by_language(held_out, F.col("nll"), 0.5, "middle")

    def drawn(rows: DataFrame) -> DataFrame:
        middle = F.coalesce("middle", F.lit(median).cast("double"))
        pulled = (F.col("nll") * (F.col("n_words") + 1) + middle * PRIOR_WORDS) / (F.col("n_words") + 1 + PRIOR_WORDS)
        return rows.join(F.broadcast(medians), "lang", "left").withColumn("drawn", pulled)

    cuts, cut = by_language(drawn(held_out), F.col("drawn"), quantile, "cut")
    limit = F.coalesce("cut", F.lit(cut).cast("double")) + float(np.log(SLACK))
    rows = drawn(scores).join(F.broadcast(cuts), "lang", "left")
    return rows.select(
        key, "lang", "n_words", F.when(F.col("n_words") > 0, F.exp("nll")).alias("perplexity"),
        F.when(F.col("n_words") > 0, F.exp("drawn")).alias("judged_perplexity"), F.exp(limit).alias("threshold"),
        ((F.col("n_words") > 0) & F.coalesce(F.col("drawn") <= limit, F.lit(True))).alias("kept"),
    )


@register("op4_quality_classifier")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return judged(table(spark, folder, "documents").select("doc_id", "text", "lang"), table(spark, folder, "labels"))
