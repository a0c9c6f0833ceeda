"""Line dedup by content-defined chunks of lines (operator 10).

A document's lines (between line feeds) are hashed, and a rolling hash over
the last ``window`` line hashes chooses where a chunk ends, so an inserted
or missing line moves the boundaries near it and no others.  A chunk has at
least ``least`` lines; what remains at the end of a document is a chunk too.
Chunks of one line never go.

A multi-line chunk that recurs anywhere is removed but for its first
occurrence, by (doc_id, line).  Chunk hashes only nominate: the hashes that
several places share are found first (``sharing.py``), then the bytes of the
nominated chunks are compared, each distinct chunk sent once per bucket.

Chunks leave the edges of a repeated passage, and passages shorter than a
chunk.  With ``edges`` a second round of the same kind looks up every pair of
neighbouring lines that no removed chunk holds, and a pair goes whose first
occurrence ends before it begins.  Pairs inside a removed chunk stand in the
chunk's first occurrence too, so all runs of two or more lines that occurred
before go whole, wherever chunks end.

Defined results: a null text has no lines and an empty remainder; an empty
text is one empty line; rows of one doc_id with equal chunks at the same
line keep both; a null doc_id counts as larger than every other; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from .common import (NULL_ID, column, exchange_width, in_buckets, int64s, mix, pack, split_by, squeeze, stretch_out, unboxed,
                     unpack)
from .sharing import BITS, gathered, shared_values

WINDOW = 2
MEAN = 4
LEAST = 2
MASK = (1 << 64) - 1
RESULT = "doc_id long, n_lines long, n_removed long, n_chunks long, n_chunks_removed long, kept_sha256 string"
NOMINATED = "dest int, bucket int, kind int, blob binary, lens binary, firsts binary, refs binary"
MARKED = "bucket int, box binary"
FIRSTS = "bucket int, kind int, refs binary, firsts binary"


def chunk_ends(hashes: list[int], window: int = WINDOW, mean: int = MEAN, least: int = LEAST) -> list[int]:
    """Line numbers at which chunks end (exclusive)."""
    ends, begin = [], 0
    for i in range(len(hashes)):
        roll = 0
        for h in hashes[max(0, i - window + 1):i + 1]:
            roll = (roll * 0x9E3779B97F4A7C15 + h) & MASK
        roll ^= roll >> 29
        if i + 1 - begin >= least and (roll * 0xBF58476D1CE4E5B9 & MASK) >> 40 & 0xFFFFFF < (1 << 24) // mean:
            ends.append(i + 1)
            begin = i + 1
    if begin < len(hashes):
        ends.append(len(hashes))
    return ends


def chunks(raw: bytes | None, **how) -> tuple[list[bytes], list[int]]:
    """Lines of a text and the ends of its chunks."""
    if raw is None:
        return [], []
    lines = raw.split(b"\n")
    return lines, chunk_ends([xxhash.xxh3_64_intdigest(x) for x in lines], **how)


def documents(tab: pa.Table):
    """``(number, doc_id, lines, chunk bounds)`` in a fixed order."""
    ids = int64s(tab, "doc_id").tolist()
    for d, raw in enumerate(column(tab, "text").cast(pa.large_binary())):
        lines, ends = chunks(raw.as_py())
        yield d, ids[d], lines, list(zip([0, *ends[:-1]], ends))


def chunk_places(tab: pa.Table):
    """``(number, doc_id, lines, [(chunk, begin, end, hash)])`` of the chunks
    of several lines."""
    for d, i, lines, bounds in documents(tab):
        yield d, i, lines, [(c, a, b, xxhash.xxh3_64_intdigest(b"\n".join(lines[a:b])))
                            for c, (a, b) in enumerate(bounds) if b - a > 1]


def marked_documents(tab: pa.Table):
    """``(number, doc_id, lines, number of chunks, bounds of the removed
    ones)`` of documents out of :func:`marked`."""
    ids = int64s(tab, "doc_id").tolist()
    for d, (raw, n, cut) in enumerate(zip(column(tab, "text").cast(pa.large_binary()), column(tab, "n_chunks").to_pylist(),
                                          column(tab, "cut").to_pylist())):
        raw = raw.as_py()
        yield d, ids[d], [] if raw is None else raw.split(b"\n"), n, list(zip(cut[::2], cut[1::2]))


def pair_places(tab: pa.Table):
    """As :func:`chunk_places`, of the pairs of neighbouring lines that no
    removed chunk holds."""
    for d, i, lines, _, cut in marked_documents(tab):
        inside = {k for a, b in cut for k in range(a, b - 1)}
        h = [xxhash.xxh3_64_intdigest(x) for x in lines]
        pairs = mix(np.array(h[:-1], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.array(h[1:], np.uint64)).tolist()
        yield d, i, lines, [(a, a, a + 2, p) for a, p in enumerate(pairs) if a not in inside]


def hashes_of(tab: pa.Table, places_of) -> tuple[np.ndarray, np.ndarray]:
    vals = [p[3] for _, _, _, places in places_of(tab) for p in places]
    return np.array(vals, np.uint64), np.arange(len(vals))  # a second place in the same document counts too


def nominate(left: pa.Table, right: pa.Table, shards: int, places_of) -> pa.Table:
    out = {k: [] for k in ("dest", "bucket", "kind", "blob", "lens", "firsts", "refs")}
    known = set(gathered(right, shards).tolist())
    if left.num_rows and known:
        bucket = int(column(left, "bucket")[0].as_py())
        number: dict[bytes, int] = {}
        shard, first, places = [], [], []
        for d, i, lines, spans in places_of(unboxed(left)):
            for c, a, b, h in spans:
                if (h // shards & (1 << BITS) - 1) * shards + h % shards in known:
                    n = number.setdefault(b"\n".join(lines[a:b]), len(number))
                    if n == len(shard):
                        shard.append(h % shards)
                        first.append((i, a))
                    places.append((n, d, c))
        keys, first = list(number), np.array(first, np.int64).reshape(-1, 2)
        order, ends = split_by(np.array(shard, np.int32), shards)
        for s in range(shards):
            part = order[ends[s]:ends[s + 1]]
            if len(part):
                texts = [keys[p] for p in part]
                for k, v in zip(out, (s, bucket, 0, squeeze(b"".join(texts)), pack(np.array([len(t) for t in texts], np.int64)),
                                      pack(first[part]), pack(part))):
                    out[k].append(v)
        if places:
            for k, v in zip(out, (shards + bucket, bucket, 1, b"", b"", b"", pack(np.array(places, np.int64)))):
                out[k].append(v)
    kinds = {"dest": pa.int32(), "bucket": pa.int32(), "kind": pa.int32()}
    return pa.table({k: pa.array(v, kinds.get(k, pa.binary())) for k, v in out.items()})


def compare(tab: pa.Table, shards: int) -> pa.Table:
    """First place of each distinct chunk, by its bytes; rows addressed to a
    bucket pass through."""
    out = {k: [] for k in ("bucket", "kind", "refs", "firsts")}
    rows = {c: column(tab, c).to_pylist() for c in tab.column_names}
    least: dict[bytes, tuple[int, int]] = {}
    texts = []
    for blob, lens, firsts, dest in zip(rows["blob"], rows["lens"], rows["firsts"], rows["dest"]):
        texts.append([])
        if dest < shards:
            blob, end = stretch_out(blob), np.cumsum(unpack(lens, np.int64)).tolist()
            for a, b, place in zip([0, *end], end, map(tuple, unpack(firsts, np.int64).reshape(-1, 2).tolist())):
                text = blob[a:b]
                texts[-1].append(text)
                if text not in least or place < least[text]:
                    least[text] = place
    for k, bucket in enumerate(rows["bucket"]):
        own = rows["dest"][k] < shards
        for c, v in zip(out, (bucket, 0 if own else 1, rows["refs"][k],
                              pack(np.array([least[t] for t in texts[k]], np.int64)) if own else b"")):
            out[c].append(v)
    kinds = {"bucket": pa.int32(), "kind": pa.int32()}
    return pa.table({k: pa.array(v, kinds.get(k, pa.binary())) for k, v in out.items()})


def boxed(tab: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, tab.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(tab.combine_chunks())
    return sink.getvalue().to_pybytes()


def first_places(right: pa.Table) -> tuple[dict[int, tuple[int, int]], dict[tuple[int, int], int]]:
    """First place of each nominated text, and the text at each place, of a
    bucket."""
    first: dict[int, tuple[int, int]] = {}
    place: dict[tuple[int, int], int] = {}
    for kind, refs, firsts in zip(*(column(right, c).to_pylist() for c in ("kind", "refs", "firsts"))):
        if kind == 0:
            first.update(zip(unpack(refs, np.int64).tolist(), map(tuple, unpack(firsts, np.int64).reshape(-1, 2).tolist())))
        else:
            place.update(((d, c), n) for n, d, c in unpack(refs, np.int64).reshape(-1, 3).tolist())
    return first, place


def decided(left: pa.Table, right: pa.Table):
    """``(doc_id, lines, kept lines, number of chunks, bounds of the removed
    chunks)`` of a bucket's documents, in the order of :func:`unboxed`."""
    first, place = first_places(right)
    for d, i, lines, bounds in documents(left):
        kept, cut = [], []
        for c, (a, b) in enumerate(bounds):
            n = place.get((d, c))
            if n is not None and first[n] < (i, a):
                cut.append((a, b))
            else:
                kept += lines[a:b]
        yield i, lines, kept, len(bounds), cut


def marked(left: pa.Table, right: pa.Table) -> pa.Table:
    """The documents of a bucket, boxed again with what the chunks decided."""
    if left.num_rows == 0:
        return pa.table({"bucket": pa.array([], pa.int32()), "box": pa.array([], pa.binary())})
    tab = unboxed(left)
    told = [(n, [x for ab in cut for x in ab]) for _, _, _, n, cut in decided(tab, right)]
    tab = (tab.append_column("n_chunks", pa.array([n for n, _ in told], pa.int64()))
           .append_column("cut", pa.array([c for _, c in told], pa.list_(pa.int64()))))
    return pa.table({"bucket": pa.array([column(left, "bucket")[0].as_py()], pa.int32()), "box": pa.array([boxed(tab)], pa.binary())})


def decided_with_edges(left: pa.Table, right: pa.Table):
    """As :func:`decided`, of documents out of :func:`marked`: pairs of lines
    that stand elsewhere before are not kept either."""
    first, place = first_places(right)
    pairs: dict[int, list[tuple[int, int]]] = {}
    for (d, a), n in place.items():
        pairs.setdefault(d, []).append((a, n))
    for d, i, lines, n_chunks, cut in marked_documents(left):
        gone = {k for a, b in cut for k in range(a, b)}
        for a, n in pairs.get(d, ()):
            j, b = first[n]
            if j < i or j == i and b + 2 <= a:
                gone.update((a, a + 1))
        yield i, lines, [x for k, x in enumerate(lines) if k not in gone], n_chunks, cut


def cut_documents(left: pa.Table, right: pa.Table, decide) -> pa.Table:
    names = ["doc_id", "n_lines", "n_removed", "n_chunks", "n_chunks_removed", "kept_sha256"]
    out: dict[str, list] = {k: [] for k in names}
    for i, lines, kept, n_chunks, cut in decide(unboxed(left), right) if left.num_rows else ():
        row = (None if i == NULL_ID else i, len(lines), len(lines) - len(kept), n_chunks, len(cut),
               hashlib.sha256(b"\n".join(kept)).hexdigest())
        for k, v in zip(out, row):
            out[k].append(v)
    return pa.table({k: pa.array(v, pa.string() if k == "kept_sha256" else pa.int64()) for k, v in out.items()})


def cut_rows(left: pa.Table, right: pa.Table, schema: pa.Schema, decide) -> pa.Table:
    """The documents themselves, with what remains of their texts."""
    if left.num_rows == 0:
        return schema.empty_table()
    tab = unboxed(left)
    texts = [None if t is None else b"\n".join(k) for t, (_, _, k, _, _) in
             zip(column(tab, "text").to_pylist(), decide(tab, right))]
    text = pa.array(texts, pa.binary()).cast(pa.string())
    rest = column(tab, "rest") if "rest" in tab.column_names else None
    cols = []
    for field in schema:
        if field.name == "text":
            cols.append(text)
        elif field.name == "doc_id":
            cols.append(column(tab, "doc_id"))
        elif field.name == "n_chars":
            cols.append(pc.utf8_length(text).cast(field.type))
        else:
            cols.append(rest.field(field.name).cast(field.type))
    return pa.table(cols, schema=schema)


def found(dealt: DataFrame, shards: int, places_of) -> DataFrame:
    """First places, by their bytes, of the texts that several places share."""
    shared = shared_values(dealt, lambda t: hashes_of(t, places_of), shards)
    return (dealt.groupBy("bucket").cogroup(shared.groupBy("bucket"))
            .applyInArrow(lambda a, b: nominate(a, b, shards, places_of), NOMINATED)
            .groupBy("dest").applyInArrow(lambda t: compare(t, shards), FIRSTS))


def rounds(dealt: DataFrame, shards: int, edges: bool):
    """Grouped documents with what was found, and how that decides."""
    firsts = found(dealt, shards, chunk_places)
    if not edges:
        return dealt.groupBy("bucket").cogroup(firsts.groupBy("bucket")), decided
    again = dealt.groupBy("bucket").cogroup(firsts.groupBy("bucket")).applyInArrow(marked, MARKED)
    return again.groupBy("bucket").cogroup(found(again, shards, pair_places).groupBy("bucket")), decided_with_edges


def line_dedup(docs: DataFrame, edges: bool = False) -> DataFrame:
    """One row per document: what was removed, and a digest of the rest."""
    width = exchange_width(docs.sparkSession)
    both, decide = rounds(in_buckets(docs, 2 * width), width, edges)
    return both.applyInArrow(lambda a, b: cut_documents(a, b, decide), RESULT)


def without_repeated_lines(docs: DataFrame, edges: bool = False) -> DataFrame:
    """The documents with all their columns: ``text`` is what remains, and
    ``n_chars`` (if there) its length; a null text stays null."""
    width = exchange_width(docs.sparkSession)
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    both, decide = rounds(in_buckets(docs, 2 * width, others), width, edges)
    schema = to_arrow_schema(docs.schema)
    return both.applyInArrow(lambda a, b: cut_rows(a, b, schema, decide), docs.schema)
