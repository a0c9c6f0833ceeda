"""Ranked lexical search by a hybrid of term-at-a-time and document-at-a-time
evaluation (operator 13).

Every item of a query table ranks all documents by a BM25-like score in
integers: the sum over its terms of weight * saturated term frequency.

* The index cuts documents into chunks of about ``CHUNK_BYTES`` of text.  A
  chunk holds an inverted list per term: documents in order and frequencies.
  Terms that no item can hold are left out by a bit table of fixed size over
  hashes of the items' terms; it may let others pass, never misses one.
* Document frequencies, N and L are summed over the chunks' term tables.
* Items travel to ``shards`` groups of chunks.  A task streams its chunks and
  carries each item's k best and their floor from chunk to chunk, so later
  chunks start from a high floor.
* Within a chunk an item's short lists are taken term at a time: their scores
  are summed into accumulators, one per document.  The accumulators then count
  as a single list with bounds of its own beside the long lists, and these are
  taken document at a time, in windows of documents in order.  A window whose
  summed bounds stay below the floor is skipped.  In the others the lists with
  the smallest bounds, which together cannot reach the floor, only get probed
  for documents that the rest has nominated and that can still reach it.

Bounds are exact maxima, so the result is exact; documents that tie with the
floor are kept, as they may win by id.

Defined results: a null or empty text holds no term and is in no statistic;
an item without terms, or whose terms no document holds, has no rows; rows of
one item_id are one item with the terms of all; a null item_id is an item;
repeated document rows are ranked each; a null doc_id comes last among equal
scores; terms of weight 0 add nothing; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, bounded_batches, column, exchange_width, flat_text, int64s, squeeze, stretch_out
from .wordseq import Words, split_words

K = 10
CHUNK_BYTES = 16 << 20
#: A list is short if at most one of so many documents of a chunk is in it.
SHORT = 32
#: Documents of a window, as a power of two.
WINDOW_BITS = 10
#: Bits of the table of terms that items may hold.
GATE_BITS = 1 << 20
ITEMS_AT_ONCE = 4096

#: What separates terms: bytes below 128 other than digits and letters; A-Z is lower-cased.
_FOLD = np.full(256, 32, np.uint8)
for _first, _last, _shift in ((0x30, 0x39, 0), (0x41, 0x5A, 32), (0x61, 0x7A, 0), (0x80, 0xFF, 0)):
    _FOLD[_first:_last + 1] = np.arange(_first + _shift, _last + _shift + 1)

INDEX = "chunk long, documents long, words long, ids binary, lengths binary, terms array<string>, sizes array<int>, places binary, counts binary"


def terms_of(texts: pa.Array) -> Words:
    """Terms of every text."""
    data, off = flat_text(texts)
    folded = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(off), pa.py_buffer(_FOLD[data]))
    return split_words(folded)


def gate_bits(vocab: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(t) % GATE_BITS for t in vocab.cast(pa.large_binary()).to_pylist()), np.int64, len(vocab))


def item_terms(items: DataFrame) -> DataFrame:
    """``(item_id, term, bit)``: the distinct terms of every item."""
    bounded_batches(items.sparkSession)

    def split(batches):
        for batch in batches:
            w = terms_of(column(batch, "text"))
            key = np.unique(w.doc * max(1, len(w.vocab)) + w.code)
            at, code = np.divmod(key, max(1, len(w.vocab)))
            yield pa.RecordBatch.from_arrays(
                [batch["item_id"].take(pa.array(at)), w.vocab.take(pa.array(code)).cast(pa.string()), pa.array(gate_bits(w.vocab)[code])],
                ["item_id", "term", "bit"])

    return (items.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
            .mapInArrow(split, "item_id long, term string, bit long").distinct())


def index(docs: DataFrame, gate: np.ndarray | None = None) -> DataFrame:
    """A row per chunk of ``docs(doc_id, text)``, with an inverted list for
    each term whose bit of ``gate`` is set (every term without one)."""
    bounded_batches(docs.sparkSession)
    names = [f.split()[0] for f in INDEX.split(", ")]

    def chunk_row(tab: pa.Table, number: int) -> pa.RecordBatch:
        w = terms_of(column(tab, "text"))
        n, rows = np.diff(w.off), tab.num_rows
        use = np.ones(len(w.code), bool) if gate is None else gate[gate_bits(w.vocab)][w.code]
        key, tf = np.unique(w.code[use] * rows + w.doc[use], return_counts=True)
        code, place = np.divmod(key, max(1, rows))
        lists, first = np.unique(code, return_index=True)
        sizes = np.diff(np.r_[first, len(code)])
        row = [(TaskContext.get().partitionId() << 24) + number, int((n > 0).sum()), int(n.sum()),
               raw(int64s(tab, "doc_id"), np.int64), raw(n, np.int64), w.vocab.take(pa.array(lists)).to_pylist(), sizes.tolist(),
               raw(place, np.int32), raw(tf, np.int32)]
        kinds = [pa.int64()] * 3 + [pa.binary()] * 2 + [pa.list_(pa.string()), pa.list_(pa.int32())] + [pa.binary()] * 2
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], names)

    def chunks(batches):
        have, size, number = [], 0, 0
        for batch in batches:
            have, size = [*have, batch], size + batch.nbytes
            if size >= CHUNK_BYTES:
                yield chunk_row(pa.Table.from_batches(have), number)
                have, size, number = [], 0, number + 1
        if have:
            yield chunk_row(pa.Table.from_batches(have), number)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(chunks, INDEX)


def raw(x: np.ndarray, kind) -> bytes:
    return squeeze(np.ascontiguousarray(x, kind).tobytes())


def back(blob: bytes, kind) -> np.ndarray:
    return np.frombuffer(stretch_out(blob), kind)


def length_norms(n: np.ndarray, documents: int, words: int) -> np.ndarray:
    """m of every document length."""
    if 90 * int(n.max(initial=0)) * documents < 1 << 63:
        return 10 + 90 * n * documents // words
    return np.array([10 + 90 * int(x) * documents // words for x in n], np.int64)


class Chunk:
    """A chunk ready for search: saturated frequencies of all postings, and
    their maxima per list and window of documents."""

    def __init__(self, ids, n, terms, sizes, places, tf, documents: int, words: int):
        self.ids, self.rows = ids, len(ids)
        self.windows = (self.rows >> WINDOW_BITS) + 1
        self.number = {t: i for i, t in enumerate(terms)}
        self.ends = np.r_[0, np.cumsum(sizes)].astype(np.int64)
        self.places = places.astype(np.int64)
        tf = tf.astype(np.int64)
        self.worth = 1_000_000_000 * tf // (1000 * tf + 8 * length_norms(n, documents, words)[self.places])
        # where each list's postings of a window begin
        whose = np.repeat(np.arange(len(sizes)), sizes) * self.windows + (self.places >> WINDOW_BITS)
        self.cuts = np.searchsorted(whose, np.arange(len(sizes) * self.windows + 1))

    def size(self, i: int) -> int:
        return int(self.ends[i + 1] - self.ends[i])


class Postings:
    """A list to take document at a time: a long list, or the accumulators."""

    def __init__(self, places: np.ndarray, scores: np.ndarray, cuts: np.ndarray):
        self.places, self.scores, self.cuts = places, scores, cuts
        self.bounds = np.zeros(len(cuts) - 1, np.int64)
        full = np.flatnonzero(np.diff(cuts))
        if len(full):
            self.bounds[full] = np.maximum.reduceat(scores, cuts[full])

    def window(self, w: int):
        part = slice(self.cuts[w], self.cuts[w + 1])
        return self.places[part], self.scores[part]


def summed(places: list[np.ndarray], scores: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Scores summed by document."""
    at, s = np.concatenate(places), np.concatenate(scores)
    order = np.argsort(at, kind="stable")
    at, s = at[order], s[order]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return at[first], np.add.reduceat(s, first)


def lists_of(chunk: Chunk, terms: list[tuple[str, int]]) -> list[Postings]:
    """The lists to walk: accumulators of the short lists first, if any."""
    mine = [(chunk.size(i), i, w) for t, w in terms if (i := chunk.number.get(t)) is not None]
    short = [(i, w) for n, i, w in mine if n * SHORT <= chunk.rows]
    walked = []
    if short:
        parts = [slice(chunk.ends[i], chunk.ends[i + 1]) for i, _ in short]
        at, s = summed([chunk.places[p] for p in parts], [chunk.worth[p] * w for p, (_, w) in zip(parts, short)])
        walked.append(Postings(at, s, np.searchsorted(at, np.arange(chunk.windows + 1) << WINDOW_BITS)))
    for n, i, w in mine:
        if n * SHORT > chunk.rows:
            part = slice(chunk.ends[i], chunk.ends[i + 1])
            cuts = chunk.cuts[i * chunk.windows:(i + 1) * chunk.windows + 1] - chunk.ends[i]
            walked.append(Postings(chunk.places[part], chunk.worth[part] * w, cuts))
    return walked


def search_window(lists: list[Postings], w: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of a window that reach the floor, and their scores."""
    lists = sorted((x for x in lists if x.bounds[w]), key=lambda x: x.bounds[w])
    below = np.cumsum([x.bounds[w] for x in lists])  # what lists up to here can add at most
    probed = int(np.searchsorted(below, floor))  # these alone stay below the floor
    at, s = summed(*zip(*(x.window(w) for x in lists[probed:])))
    for j in range(probed - 1, -1, -1):
        open_ = s + below[j] >= floor
        at, s = at[open_], s[open_]
        if not len(at):
            break
        places, scores = lists[j].window(w)
        where = np.minimum(np.searchsorted(places, at), len(places) - 1)
        s = s + np.where(places[where] == at, scores[where], 0)
    open_ = s >= floor
    return at[open_], s[open_]


class Best:
    """The k best documents of an item so far."""

    def __init__(self, k: int):
        self.k, self.floor = k, 1
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.r_[self.scores, scores], np.r_[self.ids, ids]
        order = np.lexsort((i, -s))[:self.k]
        self.scores, self.ids = s[order], i[order]
        if len(order) == self.k:
            self.floor = max(1, int(self.scores[-1]))


def search_chunk(chunk: Chunk, terms: list[tuple[str, int]], best: Best) -> None:
    lists = lists_of(chunk, terms)
    if not lists:
        return
    bounds = np.sum([x.bounds for x in lists], axis=0)
    for w in np.flatnonzero(bounds >= best.floor).tolist():
        if bounds[w] >= best.floor:  # the floor may have risen
            at, s = search_window(lists, w, best.floor)
            if len(at):
                best.add(s, chunk.ids[at])


HITS = "item_id long, doc_id long, score long"


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """``item_id, rank, doc_id, score`` of each item's ``k`` best documents."""
    spark = docs.sparkSession
    wanted = item_terms(items).checkpoint()
    gate = np.zeros(GATE_BITS, bool)  # at most GATE_BITS numbers come to the driver
    gate[column(wanted.select("bit").distinct().toArrow(), "bit").to_numpy()] = True
    chunks = index(docs, gate).checkpoint()
    total = chunks.agg(F.sum("documents").alias("n"), F.sum("words").alias("l")).first()
    documents, words = total.n or 0, total.l or 0
    n_items = wanted.select("item_id").distinct().count()

    held = (chunks.select(F.explode(F.arrays_zip("terms", "sizes")).alias("x"))
            .groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.sizes").alias("df")))
    weight = F.floor(1000 * F.log((F.lit(2.0 * documents) + 2) / (2.0 * F.col("df") + 1))).cast("long")
    asked = (wanted.join(held, "term").select("item_id", "term", weight.alias("w")).where("w > 0")
             .groupBy("item_id").agg(F.collect_list(F.struct("term", "w")).alias("asks")))

    shards, groups = exchange_width(spark), max(1, -(-n_items // ITEMS_AT_ONCE))
    group = F.pmod(F.xxhash64("item_id"), F.lit(groups)).cast("int").alias("group")
    fields = [f.split()[0] for f in INDEX.split(", ")][1:]
    queries = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), group, F.lit(-1).cast("long").alias("chunk"),
                           "item_id", "asks", *[F.lit(None).alias(f) for f in fields])
    data = chunks.select(F.pmod(F.xxhash64("chunk"), F.lit(shards)).cast("int").alias("shard"),
                         F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), "chunk",
                         F.lit(None).cast("long").alias("item_id"), F.lit(None).alias("asks"), *fields)
    # a group's items come before its chunks
    dealt = queries.unionByName(data).repartition(shards, "shard", "group").sortWithinPartitions("shard", "group", "chunk")

    def run(batches):
        at, open_ = None, {}

        def hits():
            cols = [[], [], []]
            for item, (_, best) in open_.items():
                cols[0] += [item] * len(best.ids)
                cols[1] += [None if i == NULL_ID else i for i in best.ids.tolist()]
                cols[2] += best.scores.tolist()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["item_id", "doc_id", "score"])

        for batch in batches:
            for r in range(batch.num_rows):
                def value(name):
                    return batch[name][r].as_py()
                if at != (value("shard"), value("group")):
                    yield hits()
                    at, open_ = (value("shard"), value("group")), {}
                if value("chunk") < 0:
                    open_[value("item_id")] = [(a["term"], a["w"]) for a in value("asks")], Best(k)
                elif open_:
                    chunk = Chunk(back(value("ids"), np.int64), back(value("lengths"), np.int64), value("terms"), np.array(value("sizes"), np.int64),
                                  back(value("places"), np.int32), back(value("counts"), np.int32), documents, max(1, words))
                    for terms, best in open_.values():
                        search_chunk(chunk, terms, best)
        yield hits()

    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return (dealt.mapInArrow(run, HITS).withColumn("rank", rank).where(F.col("rank") <= k)
            .select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
