"""Suffix-array dedup by depth-limited radix sort (operator 3).

A suffix is the text from one byte on.  Two documents repeat a window of
``length`` bytes exactly where two of their suffixes agree on that many
leading bytes, so suffixes need only be ordered that deep: groups that are
still equal at the threshold are exactly the repeated windows.

Ordering every suffix of the corpus would move many times its size.  The
radix sort therefore runs most significant digit first, and its first pass
runs over a sample of the suffixes:

1. *Sampled pass.*  Of every window, one ``gram``-byte piece is its sample:
   the one with the smallest hash.  Equal windows have equal samples at the
   same place, so a window whose sample occurs in one document only is
   unique and drops out (``sharing.py``).
2. *Digit passes.*  The surviving suffixes are dealt over shards by sample.
   Each bucket sends a distinct stretch of such suffixes once, with its
   smallest doc_id, so a passage in a third of the corpus costs one stretch
   per bucket.  A shard refines groups by digits of eight bytes; groups held
   by a single stretch drop out after each pass.  What is left at the
   threshold are the repeated windows, by comparison of all their bytes.
3. *Marking.*  Buckets hear the smallest doc_id of each repeated window and
   mark the bytes of the windows in documents with a larger one.

Defined results: a null text is empty; a document shorter than ``length``
loses nothing; a repeat inside one document removes nothing by itself; rows
of one doc_id never remove each other's bytes; a null doc_id counts as
larger than every other; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import (NULL_ID, column, exchange_width, flat_text, in_buckets, int64s, is_member, mix, pack,
                     run_starts, slices, sliding_min, split_by, squeeze, stretch_out, unboxed, unpack)
from .sharing import gathered, reduced, shared_values

LENGTH = 50
GRAM = 24
STEP_BYTES = 1 << 20
#: Parts of a shard, by sample, that are sorted one after the other.
PARTS = 8
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
REMAINDER = RESULT + ", kept binary"
STRETCH = "dest int, bucket int, kind int, blob binary, lens binary, docs binary, refs binary"
FOUND = "bucket int, kind int, refs binary, lens binary, docs binary"


def words_at(buf: np.ndarray) -> np.ndarray:
    """Eight bytes from every position on, as integers (an unaligned view)."""
    return np.ndarray((max(0, len(buf) - 7),), "<u8", np.ascontiguousarray(buf), 0, (1,))


def gram_hashes(buf: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` (a multiple of 8) bytes from every position on."""
    w = np.empty(max(0, len(buf) - 7), np.uint64)
    view = words_at(buf)
    for o in range(8):  # contiguous copies: arithmetic on the view is slow
        w[o::8] = view[o::8]
    n = len(buf) - gram + 1
    h = np.zeros(max(0, n), np.uint64)
    for k in range(gram // 8):
        part = w[8 * k:8 * k + max(0, n)] * np.uint64([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB][k % 3])
        part ^= part >> np.uint64(32)
        h = h * np.uint64(0x100000001B3) + part
    return mix(h)


def samples(buf: np.ndarray, off: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Sample of the window that starts at each byte, and which starts are
    windows of one document."""
    low = sliding_min(gram_hashes(buf, gram), length - gram + 1)
    valid = np.ones(len(low), bool)
    for a, b in zip(off[:-1], off[1:]):
        valid[max(a, b - length + 1):b] = False
    return low, valid


def sample_values(tab: pa.Table, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    buf, off = flat_text(column(tab, "text"))
    ids = int64s(tab, "doc_id")
    vals, docs = [], []
    for i, j in slices(off, STEP_BYTES):
        base = off[i]
        low, valid = samples(buf[base:off[j]], off[i:j + 1] - base, length, gram)
        at = run_starts(low, valid)
        vals.append(low[at])
        docs.append(np.searchsorted(off, at + base, side="right") - 1)
    doc = np.concatenate(docs) if docs else np.zeros(0, np.int64)
    # rows of one doc_id count as one document
    rank = np.cumsum(np.r_[0, ids[1:] != ids[:-1]]) if len(ids) else ids
    return (np.concatenate(vals) if vals else np.zeros(0, np.uint64)), rank[doc] if len(doc) else doc


def stretches(left: pa.Table, right: pa.Table, length: int, gram: int, shards: int) -> pa.Table:
    """Distinct stretches of surviving suffixes of a bucket, by shard, and
    (kind 1, addressed to the bucket itself) where each one occurs.  A
    stretch's reference to a shard is its number times ``PARTS`` plus its part."""
    out = {k: [] for k in ("dest", "bucket", "kind", "blob", "lens", "docs", "refs")}
    known = gathered(right, shards)
    if left.num_rows and len(known):
        bucket = int(column(left, "bucket")[0].as_py())
        tab = unboxed(left)
        buf, off = flat_text(column(tab, "text"))
        ids = int64s(tab, "doc_id")
        number: dict[bytes, int] = {}
        ref, at_doc, at_pos, first, shard, part_of, size = [], [], [], [], [], [], []
        for i, j in slices(off, STEP_BYTES):
            base = off[i]
            low, valid = samples(buf[base:off[j]], off[i:j + 1] - base, length, gram)
            at = run_starts(low, valid)
            ends = at + 1
            if len(at):  # a run ends where the next begins or validity ends
                stop = np.flatnonzero(~valid)
                nxt = np.searchsorted(stop, at)
                ends = np.r_[stop, len(low)][nxt]
                ends[:-1] = np.minimum(ends[:-1], at[1:])
            hit = is_member(reduced(low[at], shards), known)
            at, ends = at[hit], ends[hit]
            doc = np.searchsorted(off, at + base, side="right") - 1
            raw = buf[base:off[j]].tobytes()
            value = reduced(low[at], shards)
            place, piece = (value % np.uint64(shards)).tolist(), (value // np.uint64(shards) % np.uint64(PARTS)).tolist()
            for a, e, d, s, q in zip(at.tolist(), ends.tolist(), doc.tolist(), place, piece):
                key = raw[a:e + length - 1]
                n = number.setdefault(key, len(number))
                if n == len(first):
                    first.append(ids[d])
                    shard.append(s)
                    part_of.append(q)
                    size.append(len(key))
                ref.append(n)
                at_doc.append(d)
                at_pos.append(a + base - off[d])
        if number:
            keys = list(number)
            order, ends = split_by(np.array(shard, np.int32), shards)
            lens, mins = np.array(size, np.int64), np.array(first, np.int64)
            sent = np.arange(len(keys)) * PARTS + np.array(part_of)
            for s in range(shards):
                part = order[ends[s]:ends[s + 1]]
                if len(part):
                    for k, v in (("dest", s), ("bucket", bucket), ("kind", 0), ("blob", squeeze(b"".join([keys[p] for p in part]))),
                                 ("lens", pack(lens[part])), ("docs", pack(mins[part])), ("refs", pack(sent[part]))):
                        out[k].append(v)
            for k, v in (("dest", shards + bucket), ("bucket", bucket), ("kind", 1), ("blob", b""),
                         ("lens", pack(np.array(at_pos, np.int64))), ("docs", pack(np.array(at_doc, np.int64))),
                         ("refs", pack(np.array(ref, np.int64)))):
                out[k].append(v)
    kinds = {"dest": pa.int32(), "bucket": pa.int32(), "kind": pa.int32()}
    return pa.table({k: pa.array(v, kinds.get(k, pa.binary())) for k, v in out.items()})


def refine(word: np.ndarray, group: np.ndarray, sizes_from: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One digit pass.  Rows lie group by group (``sizes_from``: where each
    group starts).  Returns an order of the rows that lies group by group of
    equal digits, and the starts of these finer groups."""
    same = word == word[sizes_from][group]
    mixed = np.zeros(len(sizes_from), bool)
    mixed[group[~same]] = True
    rows = np.flatnonzero(mixed[group])
    order = np.arange(len(word))
    if len(rows):
        order[rows] = rows[np.lexsort((word[rows].byteswap(), group[rows]))]
    g, w = group[order], word[order]
    return order, np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (w[1:] != w[:-1])])


def repeated_windows(buf: np.ndarray, start: np.ndarray, stretch: np.ndarray, docs: np.ndarray,
                     length: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the suffixes (at ``start`` of ``buf``, of a stretch with
    smallest doc_id ``docs[stretch]``) that another stretch shares through
    ``length`` bytes, and the smallest doc_id of their group."""
    idx = np.arange(len(start))
    group, starts = np.zeros(len(idx), np.int64), np.zeros(min(1, len(idx)), np.int64)
    view = words_at(np.r_[buf, np.zeros(8, np.uint8)])
    for depth in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        if len(idx) == 0:
            return idx, idx
        order, starts = refine(view[start[idx] + depth], group, starts)
        idx = idx[order]
        sizes = np.diff(np.r_[starts, len(idx)])
        keep = sizes > 1
        idx = idx[np.repeat(keep, sizes)]
        sizes = sizes[keep]
        starts = np.cumsum(np.r_[0, sizes])[:-1]
        group = np.repeat(np.arange(len(sizes)), sizes)
    if len(idx) == 0:
        return idx, idx
    return idx, np.repeat(np.minimum.reduceat(docs[stretch[idx]], starts), sizes)


def sort_shard(tab: pa.Table, length: int, shards: int) -> pa.Table:
    """Digit passes over one shard; rows addressed to a bucket pass through."""
    dest, bucket, kind = (column(tab, c).to_numpy() for c in ("dest", "bucket", "kind"))
    blobs, lens, docs, refs = (column(tab, c).to_pylist() for c in ("blob", "lens", "docs", "refs"))
    out = {"bucket": [], "kind": [], "refs": [], "lens": [], "docs": []}

    def emit(*row):
        for k, v in zip(out, row):
            out[k].append(v)

    if dest[0] >= shards:
        for r in range(tab.num_rows):
            emit(bucket[r], 1, refs[r], lens[r], docs[r])
    else:
        buf = np.frombuffer(b"".join(map(stretch_out, blobs)), np.uint8)
        lens = [unpack(x, np.int64) for x in lens]
        size = np.concatenate(lens)
        mins = np.concatenate([unpack(x, np.int64) for x in docs])
        ref = np.concatenate([unpack(x, np.int64) for x in refs])
        home = np.repeat(bucket, [len(x) for x in lens])
        begin = np.cumsum(np.r_[0, size])[:-1]
        found = []
        for part in range(PARTS):
            some = np.flatnonzero(ref % PARTS == part)
            windows = size[some] - length + 1
            stretch = np.repeat(some, windows)
            inner = np.arange(windows.sum()) - np.repeat(np.cumsum(np.r_[0, windows])[:-1], windows)
            least = mins[stretch]
            idx, low = repeated_windows(buf, begin[stretch] + inner, stretch, mins, length)
            least[idx] = low
            if len(least):
                cut = np.flatnonzero(np.r_[True, (stretch[1:] != stretch[:-1]) | (least[1:] != least[:-1])])
                found.append((stretch[cut], inner[cut], np.diff(np.r_[cut, len(least)]), least[cut]))
        own, inner, runs, least = map(np.concatenate, zip(*found))
        order, ends = split_by(home[own], int(bucket.max()) + 1)
        for b in np.unique(home):
            at = order[ends[b]:ends[b + 1]]
            emit(int(b), 0, pack(ref[own[at]] // PARTS), pack(np.c_[inner[at], runs[at]]), pack(least[at]))
    kinds = {"bucket": pa.int32(), "kind": pa.int32()}
    return pa.table({k: pa.array(v, kinds.get(k, pa.binary())) for k, v in out.items()})


def removed_mask(ids: np.ndarray, off: np.ndarray, found: pa.Table, length: int) -> np.ndarray:
    """Which bytes of a bucket's documents go."""
    kind = column(found, "kind").to_numpy()
    blob = {c: column(found, c).to_pylist() for c in ("refs", "lens", "docs")}

    def joined(k: int, c: str) -> np.ndarray:
        parts = [unpack(x, np.int64) for x, y in zip(blob[c], kind) if y == k]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    ref, pos, doc = joined(1, "refs"), joined(1, "lens"), joined(1, "docs")
    run_ref, runs, low = joined(0, "refs"), joined(0, "lens").reshape(-1, 2), joined(0, "docs")
    order = np.argsort(run_ref, kind="stable")
    run_ref, runs, low = run_ref[order], runs[order], low[order]
    a = np.searchsorted(run_ref, ref)
    n = np.searchsorted(run_ref, ref, side="right") - a
    occ = np.repeat(np.arange(len(ref)), n)
    run = np.arange(n.sum()) - np.repeat(np.cumsum(np.r_[0, n])[:-1], n) + a[occ] if len(occ) else occ
    go = low[run] < ids[doc[occ]]
    occ, run = occ[go], run[go]
    start = off[doc[occ]] + pos[occ] + runs[run, 0]
    edge = np.zeros(off[-1] + 1, np.int32)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + runs[run, 1] + length - 1, -1)
    return np.cumsum(edge)[:-1] > 0


def cut_documents(left: pa.Table, right: pa.Table, length: int, with_kept: bool) -> pa.Table:
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_kept
    out: dict[str, list] = {k: [] for k in names}
    if left.num_rows:
        tab = unboxed(left)
        buf, off = flat_text(column(tab, "text"))
        ids = int64s(tab, "doc_id")
        gone = removed_mask(ids, off, right, length) if right.num_rows else np.zeros(len(buf), bool)
        count = np.cumsum(np.r_[0, gone.astype(np.int64)])
        for k, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
            n = int(count[b] - count[a])
            g = gone[a:b]
            kept = (buf[a:b][~g] if n else buf[a:b]).tobytes()
            out["doc_id"].append(None if ids[k] == NULL_ID else int(ids[k]))
            out["n_bytes"].append(b - a)
            out["n_removed"].append(n)
            out["n_spans"].append(int(g[0]) + int(np.count_nonzero(g[1:] & ~g[:-1])) if n else 0)
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            if with_kept:
                out["kept"].append(kept)
    kinds = {"kept_sha256": pa.string(), "kept": pa.binary()}
    return pa.table({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()})


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_kept: bool = False) -> DataFrame:
    """Remove every byte covered by a ``length``-byte string that also starts
    in a document with a smaller doc_id.  ``gram`` is a multiple of 8 and at
    most ``length``.  One row per document; ``with_kept`` adds the remaining
    bytes themselves."""
    width = exchange_width(docs.sparkSession)
    buckets, shards = 2 * width, width
    dealt = in_buckets(docs, buckets)
    shared = shared_values(dealt, lambda t: sample_values(t, length, gram), shards)
    found = (dealt.groupBy("bucket").cogroup(shared.groupBy("bucket"))
             .applyInArrow(lambda a, b: stretches(a, b, length, gram, shards), STRETCH)
             .groupBy("dest").applyInArrow(lambda t: sort_shard(t, length, shards), FOUND))
    return (dealt.groupBy("bucket").cogroup(found.groupBy("bucket"))
            .applyInArrow(lambda a, b: cut_documents(a, b, length, with_kept), REMAINDER if with_kept else RESULT))
