"""Vector bin packing of token sequences by the dot-product heuristic.

Texts are tokenized once and cut into pieces of at most one sequence.  Pieces are dealt by hash into
groups of about ``GROUP`` pieces, and each group is packed on its own: the open sequence takes, of
the pieces that fit in every dimension (tokens, segments, loss-bearing tokens), the one whose size
vector has the largest dot product with the room that is left.
"""

from __future__ import annotations

import codecs
import json
import os
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkweave.llm import register
from talkweave.llm.common import saved, table, whole
from talkweave.llm.tokens import chunks

SEQUENCE = 1024
SEGMENTS = 256
GROUP = 4096
# Runs that a worker keeps, and the characters of the longest of them.
KEPT_RUNS = 1 << 18
KEPT_LENGTH = 100
# Bytes of the texts that are encoded at once; a longer text stands alone.
PART_BYTES = 4 << 20
TOKENIZER = "byte_bpe_50k.json"
# The byte-level pre-tokenizer cuts words into runs of letters, of digits and of marks, and single line breaks.
LETTER, DIGIT, MARK, BREAK = 1, 2, 3, 4
_KIND, _WHITE = np.zeros(256, np.uint8), np.zeros(256, bool)
for _kind, _bytes in ((MARK, range(33, 127)), (LETTER, [*range(65, 91), *range(97, 123)]), (DIGIT, range(48, 58)), (BREAK, [10]), (0, b"'")):
    _KIND[list(_bytes)] = _kind
_WHITE[[*range(9, 14), *range(28, 33)]] = True
# The letters that stand for the bytes in a byte-level vocabulary.
_SEEN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_PLACE = {b: 256 + i for i, b in enumerate(sorted({*range(256)}.difference(_SEEN)))}
SPELLED = "".join(chr(_PLACE.get(b, b)) for b in range(256))


def gathered(flat: np.ndarray, lengths: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Parts of ``flat``, which lie end to end in it with these lengths, in another order."""
    starts, taken = np.cumsum(lengths) - lengths, lengths[order]
    return flat[np.repeat(starts[order] - np.cumsum(taken) + taken, taken) + np.arange(taken.sum())]


def runs_of(data: np.ndarray, offsets: np.ndarray, whole_rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte of each run, whether it is plain) of UTF-8 texts; runs are encoded one by one.

    A byte-level tokenizer never joins characters across a single space between two characters that are not white
    space.  Texts are cut there, and what lies between is cut into runs where it has only ASCII characters, without
    apostrophes, which may begin a contraction, and letters up to U+017F.  ``whole_rows`` are not cut.
    """
    kind, white = _KIND[data], _WHITE[data]
    lead = np.flatnonzero((data >= 0xC2) & (data <= 0xC5))
    one, two = data[lead], data[lead + 1]
    letter = (one > 0xC3) | ((one == 0xC3) & (two != 0x97) & (two != 0xB7)) | ((one == 0xC2) & np.isin(two, [0xAA, 0xB5, 0xBA]))
    kind[lead[letter]] = kind[lead[letter] + 1] = LETTER
    # Characters that may be white space begin with these bytes.
    white[lead[one == 0xC2]] = white[lead[one == 0xC2] + 1] = True
    lead = np.flatnonzero((data >= 0xE1) & (data <= 0xE3))
    white[lead] = white[lead + 1] = white[lead + 2] = True
    some = np.diff(offsets) > 0
    firsts, lasts = offsets[:-1][some], offsets[1:][some] - 1
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = white[:-1], white[1:]
    before[firsts] = after[lasts] = False
    lone = ~(before | after)
    border = lone & (data == 0x20)
    border[firsts] = border[lasts] = False
    plain = (kind > 0) & (lone | (kind != BREAK)) | border
    if whole_rows.any():
        inside = np.repeat(whole_rows, np.diff(offsets))
        border[inside] = plain[inside] = False
    opens = border.copy()
    opens[firsts] = True
    words = np.flatnonzero(opens)
    whole_words = np.logical_or.reduceat(~plain, words) if len(words) else np.zeros(0, bool)
    # The space before a word belongs to its first run.
    spaces = np.flatnonzero(border)
    kind[spaces] = kind[spaces + 1]
    cuts = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    runs = opens.copy()
    runs[cuts[~whole_words[np.searchsorted(words, cuts, "right") - 1]]] = True
    starts = np.flatnonzero(runs)
    return starts, ~whole_words[np.cumsum(opens[starts]) - 1]


class RunTokenizer:
    """Token ids of whole texts, each followed by id 0.

    Every different run (see ``runs_of``) of a part is encoded once, and the ids of the first ``KEPT_RUNS`` runs met are kept.
    A text for another tokenizer than byte-level BPE, or with a special token, is one run.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cutter, bpe = spec["pre_tokenizer"] or {}, spec["model"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.by_runs = (
            cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True) and not cutter["add_prefix_space"]
            and spec["normalizer"] is None and bpe["type"] == "BPE"
            and not any(bpe.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix"))
        )
        # The place of each kept run, the numbers of ids by place, and the ids end to end.
        self.known: dict[str, int] = {}
        self.kept = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _encode(self, runs: list[str], plain: np.ndarray) -> list[list[int]]:
        out = [e.ids for e in self.model.encode_batch_fast([r for r, p in zip(runs, plain) if not p], add_special_tokens=False)]
        spelled = "\0".join(r for r, p in zip(runs, plain) if p)
        # The model takes plain runs as they are, without a search for their borders.
        letters = codecs.charmap_decode(spelled.encode(), "strict", SPELLED)[0].split(SPELLED[0]) if spelled else []
        tokenize = self.model.model.tokenize
        others, plains = iter(out), iter(letters)
        return [[t.id for t in tokenize(next(plains))] if p else next(others) for p in plain]

    def _runs(self, runs: list[str], plain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of each run, numbers of ids by place, ids end to end) of different runs."""
        lengths, flat = self.kept
        places = np.fromiter((self.known.get(r, -1) for r in runs), np.int64, len(runs))
        missing = np.flatnonzero(places < 0)
        if len(missing):
            new = [runs[i] for i in missing.tolist()]
            # The shortest are kept while there is room.
            sizes = np.fromiter(map(len, new), np.int64, len(new))
            order = np.argsort(sizes, kind="stable")
            missing, new = missing[order], [new[i] for i in order.tolist()]
            places[missing] = len(lengths) + np.arange(len(missing))
            fresh = self._encode(new, plain[missing].tolist())
            lengths = np.concatenate([lengths, np.fromiter(map(len, fresh), np.int64, len(fresh))])
            flat = np.concatenate([flat, np.fromiter(chain.from_iterable(fresh), np.int32)])
            short = min(KEPT_RUNS - len(self.known), int((sizes <= KEPT_LENGTH).sum()))
            if short:
                self.known.update(zip(new[:short], places[missing[:short]].tolist()))
                kept = lengths[:len(self.known)].copy()
                self.kept = kept, flat[:kept.sum()].copy()
        return places, lengths, flat

    def __call__(self, texts: pa.Array, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each text) of an array without nulls, whose bytes and offsets these are."""
        import pyarrow.compute as pc

        whole_rows = np.full(len(texts), not self.by_runs)
        for token in self.special:
            whole_rows |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        starts, plain = runs_of(data, offsets, whole_rows)
        bounds = pa.py_buffer(np.append(starts, len(data)).astype(np.int32))
        coded = pa.StringArray.from_buffers(len(starts), bounds, pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        codes = coded.indices.to_numpy()
        first = np.zeros(len(coded.dictionary), bool)
        first[codes[plain]] = True
        places, lengths, flat = self._runs(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), first)
        # The last place is that of the final 0.
        lengths, flat = np.append(lengths, 1), np.append(flat, np.int32(0))
        ends = np.searchsorted(starts, offsets[1:])
        order = np.insert(places[codes], ends, len(lengths) - 1)
        sums = np.concatenate([[0], np.cumsum(lengths[order])])
        return gathered(flat, lengths, order), np.diff(sums[np.append(0, ends + np.arange(1, len(ends) + 1))])


# The worker's tokenizers, kept from task to task where Python workers are reused.
_HELD: dict[str, RunTokenizer] = {}


def _tokenizer(path: str) -> RunTokenizer:
    """The worker's tokenizer for a file, kept from task to task where Python workers are reused."""
    if path not in _HELD:
        _HELD[path] = RunTokenizer(path)
    return _HELD[path]


def pieces(
    docs: DataFrame, key: str, text: Column, tokenizer: str = TOKENIZER, limit: int = SEQUENCE, loss: bool | Column = True
) -> DataFrame:
    """(key, start, length, ids, doc_tokens, loss_tokens): the pieces of every text with their token ids.

    A text is its ids and then id 0; null text is empty and so the single id 0.  ``loss`` says
    whether the tokens of these rows bear loss; as a column it is the number of tokens at the end of
    each row's text that do (an answer after its prompt, the final 0 included), null for all of them.
    ``tokenizer`` names a public vocabulary file or is a path.
    """
    def cut(batches):
        import public_tokenizers

        encode = _tokenizer(tokenizer if os.path.sep in tokenizer else public_tokenizers.path(tokenizer))
        for batch in batches:
            for at, data, offsets in chunks(batch.column(1), PART_BYTES):
                rows = len(offsets) - 1
                part = batch.slice(at, rows)
                ids, total = encode(part.column(1), data, offsets)
                cuts = -(-total // limit)
                row = np.repeat(np.arange(rows), cuts)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * limit
                length = np.minimum(limit, total[row] - start)
                # The pieces of a text are its ids from end to end.
                bounds = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids))
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), pa.array(start), pa.array(length), lists, pa.array(total[row]), part.column(2).take(take)],
                    [key, "start", "length", "ids", "doc_tokens", "_loss"],
                )

    kind = docs.schema[key].dataType.simpleString()
    share = loss.cast("long") if isinstance(loss, Column) else F.lit(None if loss else 0).cast("long")
    rows = docs.select(key, whole(text).alias("_text"), share.alias("_loss")).mapInArrow(
        cut, f"`{key}` {kind}, start long, length long, ids array<int>, doc_tokens long, _loss long"
    )
    # Loss begins so many tokens before the end of the text.
    opens = F.greatest("start", F.col("doc_tokens") - F.coalesce("_loss", "doc_tokens"))
    return rows.withColumn("loss_tokens", F.greatest(F.col("start") + F.col("length") - opens, F.lit(0).cast("long"))).drop("_loss")


def with_digests(rows: DataFrame) -> DataFrame:
    """``rows`` with ``ids_crc32``, of little-endian 32-bit ids, in place of ``ids``."""
    keep = [f for f in rows.schema.fields if f.name != "ids"]

    def digest(batches):
        for batch in batches:
            ids = batch.column(batch.num_columns - 1)
            flat, bounds = ids.values.to_numpy().astype("<i4", copy=False), ids.offsets.to_numpy()
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(crc, pa.int64())], [*[f.name for f in keep], "ids_crc32"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)
    return rows.select(*[f.name for f in keep], "ids").mapInArrow(digest, f"{schema}, ids_crc32 long")


def fill(sizes: np.ndarray, limits: np.ndarray) -> list[list[int]]:
    """Bins of item places; every item is within ``limits`` in each dimension."""
    scaled = sizes / limits
    full = np.flatnonzero((sizes == limits).any(axis=1))
    bins = [[int(i)] for i in full]
    left = np.setdiff1d(np.arange(len(sizes)), full)
    left = left[np.argsort(-scaled[left].sum(axis=1), kind="stable")]
    while len(left):
        # The largest piece opens the sequence.
        taken, room = [int(left[0])], limits - sizes[left[0]]
        left = left[1:]
        while len(left):
            fits = np.flatnonzero((sizes[left] <= room).all(axis=1))
            if not len(fits):
                break
            best = fits[np.argmax(scaled[left[fits]] @ (room / limits))]
            taken.append(int(left[best]))
            room = room - sizes[left[best]]
            left = np.delete(left, best)
        bins.append(taken)
    return bins


def packed(parts: DataFrame, limits: dict[str, int], length: str = "length", group: int = GROUP) -> DataFrame:
    """``parts`` with ``sequence_id`` and ``offset``; the sums of each column in ``limits`` hold per sequence.

    ``parts`` should be a saved table: it is counted to find the number of groups.
    """
    groups = max(1, -(-parts.count() // group))
    dims = list(limits)
    caps = np.array([limits[d] for d in dims], np.int64)

    def place(table: pa.Table) -> pa.Table:
        sizes = np.stack([table[d].to_numpy() for d in dims], axis=1)
        lengths = table[length].to_numpy()
        first = table["_g"][0].as_py() << 24
        sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for b, members in enumerate(fill(sizes, caps)):
            sequence[members] = first + b
            offset[members] = np.cumsum(lengths[members]) - lengths[members]
        return table.drop_columns(["_g"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    spread = F.pmod(F.xxhash64(*parts.columns), F.lit(groups)).alias("_g")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema.fields)
    return parts.select("*", spread).groupBy("_g").applyInArrow(place, f"{schema}, sequence_id long, offset long")


def pack_documents(
    docs: DataFrame, tokenizer: str = TOKENIZER, limit: int = SEQUENCE, segments: int = SEGMENTS, loss_limit: int = SEQUENCE,
    loss: bool | Column = True,
) -> DataFrame:
    """Documents (doc_id, text) as packed sequences: the pieces with their token ids, sequence and offset; ``loss`` as in ``pieces``.

    Defined results: a null or empty text is one piece with the single id 0; rows without id, repeated ids and repeated rows are
    packed each for itself; a text that spells a special token gets that token's id, as the tokenizer gives it; an empty table
    gives an empty result; other columns are not read.
    """
    parts = saved(pieces(docs, "doc_id", F.col("text"), tokenizer, min(limit, loss_limit), loss), "pieces")
    counted = parts.withColumn("segments", F.lit(1).cast("long"))
    done = packed(counted, {"length": limit, "segments": segments, "loss_tokens": loss_limit})
    return done.select("doc_id", "start", "length", "ids", "doc_tokens", "loss_tokens", "sequence_id", "offset")


@register("op10_packing")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return with_digests(pack_documents(table(spark, folder, "documents"))).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )
