"""Substring dedup by automata of repeated phrases (operator 5).

A window is ``length`` consecutive words of one document.  Three steps:

1. *Candidates.*  Of every window one ``gram``-word phrase is its sample
   (the one with the smallest hash).  A window whose sample occurs in one
   document only cannot recur (``sharing.py``).
2. *Confirmation.*  Candidate windows are compared across the corpus by a
   128-bit fingerprint of the whole word sequence.  A bucket sends each
   distinct window once, with its smallest doc_id, so hot passages are
   pre-aggregated; a shard confirms those that at least two documents hold.
3. *Location.*  Every bucket compiles Aho-Corasick automata of the sample
   phrases of the confirmed passages that concern it (sharded, so that each
   stays small) and streams all its documents through them, word by word.
   Around each located phrase, the confirmed windows that start in a document
   with a smaller doc_id too lose their words.

To the automaton a word of a passage is a number written in few letters; the
first letter of a word has an alphabet of its own, so matches start and end
at words, and documents are set apart by a letter that no passage has.

Defined results: a null text has no words; a document shorter than a window
loses nothing; rows of one doc_id never remove each other's words; a null
doc_id counts as larger than every other; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import (NULL_ID, column, exchange_width, in_buckets, int64s, is_member, mix, pack, run_starts,
                     sliding_min, split_by, squeeze, stretch_out, unboxed, unpack)
from .sharing import gathered, reduced, shared_values
from .wordseq import Words, sequence_hashes, split_words, whole, word_hashes

LENGTH = 13
GRAM = 6
#: Phrases that one automaton holds.
SHARD_WORDS = 50_000
#: Letters at each place of a word.  A node of the automaton looks through
#: its children one by one, so there must not be many.
LETTERS = 256
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
WINDOWS = "dest int, bucket int, prints binary, docs binary, multi binary"
CONFIRMED = "bucket int, prints binary, docs binary"


def window_samples(words: Words, hashes: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    low = sliding_min(mix(sequence_hashes(hashes[words.code, 0], gram)), length - gram + 1)
    return low, whole(words.off, len(low), length)


def sample_values(tab: pa.Table, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    words = split_words(column(tab, "text"))
    ids = int64s(tab, "doc_id")
    low, valid = window_samples(words, word_hashes(words.vocab), length, gram)
    at = run_starts(low, valid)
    rank = np.cumsum(np.r_[0, ids[1:] != ids[:-1]])
    return low[at], rank[words.doc[at]]


def window_prints(words: Words, hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(mix(sequence_hashes(hashes[words.code, c], length)) for c in (0, 1))


def grouped(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by the pair (a, b), and where each group of equal pairs starts."""
    order = np.argsort(a, kind="stable")
    if len(order) == 0:
        return order, order
    x, y = a[order], b[order]
    if np.any((x[1:] == x[:-1]) & (y[1:] != y[:-1])):
        order = np.lexsort((b, a))
        x, y = a[order], b[order]
    return order, np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])])


def candidate_windows(left: pa.Table, right: pa.Table, length: int, gram: int, shards: int) -> pa.Table:
    out = {k: [] for k in ("dest", "bucket", "prints", "docs", "multi")}
    known = gathered(right, shards)
    if left.num_rows and len(known):
        tab = unboxed(left)
        words = split_words(column(tab, "text"))
        ids = int64s(tab, "doc_id")
        hashes = word_hashes(words.vocab)
        low, valid = window_samples(words, hashes, length, gram)
        at = run_starts(low, valid)
        hit = np.zeros(len(low), bool)
        hit[at] = True
        run = np.cumsum(hit) - 1
        member = is_member(reduced(low[at], shards), known)
        starts = np.flatnonzero(valid & (member[run] if len(at) else valid))
        a, b = (p[starts] for p in window_prints(words, hashes, length))
        docs = ids[words.doc[starts]]
        order, first = grouped(a, b)
        if len(first):
            last = np.r_[first[1:], len(order)] - 1
            a, b, docs = a[order], b[order], docs[order]  # rows are in doc_id order within a group
            multi = docs[first] != docs[last]
            a, b, docs = a[first], b[first], docs[first]
            order, ends = split_by((a % np.uint64(shards)).astype(np.int32), shards)
            bucket = int(column(left, "bucket")[0].as_py())
            for s in range(shards):
                part = order[ends[s]:ends[s + 1]]
                if len(part):
                    for k, v in zip(out, (s, bucket, pack(np.c_[a[part], b[part]]), pack(docs[part]),
                                          squeeze(np.packbits(multi[part]).tobytes()))):
                        out[k].append(v)
    kinds = {"dest": pa.int32(), "bucket": pa.int32()}
    return pa.table({k: pa.array(v, kinds.get(k, pa.binary())) for k, v in out.items()})


def confirm(tab: pa.Table) -> pa.Table:
    bucket = column(tab, "bucket").to_numpy()
    prints = [unpack(x, np.uint64).reshape(-1, 2) for x in column(tab, "prints").to_pylist()]
    docs = np.concatenate([unpack(x, np.int64) for x in column(tab, "docs").to_pylist()])
    multi = np.concatenate([np.unpackbits(np.frombuffer(stretch_out(x), np.uint8), count=len(p)).astype(bool)
                            for x, p in zip(column(tab, "multi").to_pylist(), prints)])
    home = np.repeat(bucket, [len(p) for p in prints])
    both = np.concatenate(prints)
    order, first = grouped(both[:, 0], both[:, 1])
    sizes = np.diff(np.r_[first, len(order)])
    least = np.repeat(np.minimum.reduceat(docs[order], first), sizes)
    keep = (np.repeat(sizes, sizes) > 1) | multi[order]
    order, least = order[keep], least[keep]
    deal, ends = split_by(home[order], int(bucket.max()) + 1)
    out_b = [int(b) for b in np.unique(home[order])]
    parts = [deal[ends[b]:ends[b + 1]] for b in out_b]
    return pa.table({"bucket": pa.array(out_b, pa.int32()),
                     "prints": pa.array([pack(both[order[p]]) for p in parts], pa.binary()),
                     "docs": pa.array([pack(least[p]) for p in parts], pa.binary())})


def lettered(code: np.ndarray, letters: int) -> tuple[str, int]:
    """Word numbers as a string, and its letters per word.  -1 (a word of no
    passage, or the gap between documents) is written in code point 1."""
    places, top = 1, int(code.max(initial=-1)) + 1
    while letters ** places < top:
        places += 1
    digits = np.stack([code // letters ** p % letters for p in reversed(range(places))], axis=1)
    digits[:, 1:] += letters
    digits[code < 0] = -1
    return (digits.ravel() + 2).astype("<u4").tobytes().decode("utf-32-le"), places


def locate(code: np.ndarray, starts: np.ndarray, length: int, letters: int = LETTERS) -> np.ndarray:
    """Compile the phrases of ``length`` words that start at ``starts`` of
    ``code`` (word numbers, -1 between documents) and stream ``code`` through
    the automaton: where each occurrence starts."""
    used = np.unique(code[(starts[:, None] + np.arange(length)).ravel()])
    at = np.searchsorted(used, code)
    at[at == len(used)] = 0
    text, per = lettered(np.where(used[at] == code, at, -1), letters)
    machine = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for s in starts.tolist():
        machine.add_word(text[s * per:(s + length) * per])
    machine.make_automaton()
    return (np.fromiter((end for end, _ in machine.iter(text)), np.int64) + 1) // per - length


def confirmed(prints: np.ndarray, a: np.ndarray, b: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which windows have a confirmed print, and its place in ``prints``
    (sorted pairs)."""
    starts = starts[is_member(a[starts], prints[:, 0])]
    at = np.searchsorted(prints[:, 0], a[starts])
    while len(at):  # equal first halves are next to each other
        other = prints[at, 1] != b[starts]
        step = other & (at + 1 < len(prints))
        step[step] = prints[at[step] + 1, 0] == a[starts[step]]
        if not step.any():
            return starts[~other], at[~other]
        at[step] += 1
    return starts, at


def removed_words(words: Words, ids: np.ndarray, found: pa.Table, length: int, gram: int) -> np.ndarray:
    """Which words of a bucket's documents go."""
    prints = np.concatenate([unpack(x, np.uint64).reshape(-1, 2) for x in column(found, "prints").to_pylist()])
    docs = np.concatenate([unpack(x, np.int64) for x in column(found, "docs").to_pylist()])
    order = np.lexsort((prints[:, 1], prints[:, 0]))
    prints, docs = prints[order], docs[order]
    hashes = word_hashes(words.vocab)
    a, b = window_prints(words, hashes, length)
    starts, at = confirmed(prints, a, b, np.flatnonzero(whole(words.off, len(a), length)))
    doc = words.doc
    later = docs[at] < ids[doc[starts]]  # windows that start in a document with a smaller id too
    starts = starts[later]
    # the sample phrase of each such window
    grams = mix(sequence_hashes(hashes[words.code, 0], gram))
    span = length - gram + 1
    inside = grams[starts[:, None] + np.arange(span)] if len(starts) else np.zeros((0, span), np.uint64)
    phrase = starts + np.argmin(inside, axis=1)
    _, once = np.unique(grams[phrase], return_index=True)
    phrase = np.sort(phrase[once])
    gap = np.flatnonzero(np.diff(doc, prepend=-1) > 0)
    code = np.insert(words.code, gap, -1)  # document d's words move on by the gaps up to it
    moved = np.arange(len(words.code)) + np.searchsorted(gap, np.arange(len(words.code)), side="right")
    home = np.full(len(code), -1)
    home[moved] = np.arange(len(words.code))
    seen = np.zeros(len(words.code) + 1, bool)
    # Automata are sharded by phrases; each streams all documents of the bucket.
    for p in range(0, len(phrase), SHARD_WORDS):
        seen[home[locate(code, moved[phrase[p:p + SHARD_WORDS]], gram)]] = True
    count = np.cumsum(np.r_[0, seen])
    starts = starts[count[starts + span] > count[starts]]  # confirmed windows around a located phrase
    edge = np.zeros(len(words.code) + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + length, -1)
    return np.cumsum(edge)[:-1] > 0


def cut_documents(left: pa.Table, right: pa.Table, length: int, gram: int, with_kept: bool) -> pa.Table:
    fields = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string()}
    if with_kept:
        fields["kept"] = pa.string()
    if left.num_rows == 0:
        return pa.table({k: pa.array([], t) for k, t in fields.items()})
    tab = unboxed(left)
    ids = int64s(tab, "doc_id")
    words = split_words(column(tab, "text"))
    gone = removed_words(words, ids, right, length, gram) if right.num_rows else np.zeros(len(words.code), bool)
    n = np.diff(words.off)
    lost = np.diff(np.r_[0, np.cumsum(gone)][words.off])
    lists = pa.LargeListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n - lost)]), words.flat.filter(pa.array(~gone)))
    kept = pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.large_binary())
    out = {"doc_id": [None if i == NULL_ID else i for i in ids.tolist()], "n_words": n, "n_removed": lost,
           "kept_sha256": [hashlib.sha256(x.as_buffer() or b"").hexdigest() for x in kept]}
    if with_kept:
        out["kept"] = kept.cast(pa.large_string()).cast(pa.string())
    return pa.table({k: pa.array(out[k], t) for k, t in fields.items()})


def phrase_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_kept: bool = False) -> DataFrame:
    """Remove every word covered by a window of ``length`` words that also
    starts in a document with a smaller doc_id.  One row per document;
    ``with_kept`` adds the kept words joined by one space."""
    width = exchange_width(docs.sparkSession)
    buckets, shards = 4 * width, width
    dealt = in_buckets(docs, buckets)
    shared = shared_values(dealt, lambda t: sample_values(t, length, gram), shards)
    found = (dealt.groupBy("bucket").cogroup(shared.groupBy("bucket"))
             .applyInArrow(lambda a, b: candidate_windows(a, b, length, gram, shards), WINDOWS)
             .groupBy("dest").applyInArrow(confirm, CONFIRMED))
    return (dealt.groupBy("bucket").cogroup(found.groupBy("bucket"))
            .applyInArrow(lambda a, b: cut_documents(a, b, length, gram, with_kept),
                          RESULT + ", kept string" * with_kept))
