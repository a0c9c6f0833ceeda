"""Token ids of whole texts, word by word.

The word BPE drops white space and joins nothing across it, so a text's ids
are its words' ids one after the other.  Distinct words are few beside the
words of a batch of texts: only they are looked up in a bounded table that
each worker keeps, and those it lacks are encoded in bulk."""

from __future__ import annotations

import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .wordseq import split_words

#: Words a worker remembers before it starts over, and the longest of them.
REMEMBER = 400_000
LONGEST = 64
#: Texts that are worked on at once.
AT_ONCE = 600


class WordEncoder:
    def __init__(self, path: str):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task a core
        from tokenizers import Tokenizer, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        self.bare = Tokenizer(self.full.model)  # for lower-case ASCII words: nothing to normalise or split
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocab = self.full.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            self.ends[i] = token.endswith("</w>")
        #: A special token sets the words of a line apart: what stands between two is encoded by itself.
        self.gap, self.gap_id = max(((t.content, i) for i, t in self.full.get_added_tokens_decoder().items() if t.special), key=lambda x: x[1])
        self.marks = [self.encode(c) for c in (",", ".")]
        self.known: dict[bytes, bytes] = {}

    def encode(self, text: str) -> bytes:
        return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def lines(self, tokenizer, words: list[str], gap: str, cuts) -> list[bytes]:
        """Ids of each word: lines of words are encoded and cut up again."""
        out: list[bytes] = []
        parts = [words[k:k + 200] for k in range(0, len(words), 200)]
        for part, enc in zip(parts, tokenizer.encode_batch_fast([gap.join(x) for x in parts], add_special_tokens=False)):
            ids = np.array(enc.ids, "<u4")
            begin, end = cuts(ids)
            if len(begin) == len(part):
                raw = ids.tobytes()
                out += [raw[a:b] for a, b in zip((begin * 4).tolist(), (end * 4).tolist())]
            else:
                out += [self.encode(w) for w in part]
        return out

    def learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        plain, other, odd = [], [], []
        for w in words:
            if w.isalpha() and w.islower():
                plain.append(w)
            else:
                (odd if self.gap.encode() in w else other).append(w)

        def at_ends(ids):
            cut = np.flatnonzero(self.ends[ids]) + 1
            return np.r_[0, cut[:-1]], cut

        def at_gaps(ids):
            cut = np.flatnonzero(ids == self.gap_id)
            return np.r_[0, cut + 1], np.r_[cut, len(ids)]

        out = dict(zip(plain, self.lines(self.bare, [w.decode() for w in plain], " ", at_ends)))
        out.update(zip(other, self.lines(self.full, [w.decode("utf-8", "replace") for w in other], self.gap, at_gaps)))
        out.update((w, self.encode(w.decode("utf-8", "replace"))) for w in odd)
        return out

    def looked_up(self, keys: list[bytes]) -> list[bytes]:
        if len(self.known) > REMEMBER:
            self.known.clear()
        found = list(map(self.known.get, keys))
        new = [k for k, x in zip(keys, found) if x is None]
        if new:
            more = self.learn(new)
            self.known.update((k, x) for k, x in more.items() if len(k) <= LONGEST)
            found = [more[k] if x is None else x for k, x in zip(keys, found)]
        return found

    def ids(self, texts: pa.Array):
        """Ids of every text, in order."""
        for k in range(0, len(texts), AT_ONCE):
            words = split_words(texts.slice(k, AT_ONCE))
            # a word of ASCII letters goes by its small letters, and a stop or comma after it by itself
            plain = pc.match_substring_regex(words.vocab, r"^[A-Za-z]+[.,]?$")
            stem = pc.ascii_lower(pc.ascii_rtrim(words.vocab, ",."))
            keys = pc.if_else(plain, stem, words.vocab).dictionary_encode()
            found = self.looked_up(keys.dictionary.cast(pa.large_binary()).to_pylist()) + self.marks
            size = np.array([len(x) for x in found]) // 4
            first = np.cumsum(np.r_[0, size])[:-1]
            flat = np.frombuffer(b"".join(found), "<u4")
            tail = np.zeros(len(words.vocab), np.int64)
            for n, mark in enumerate(",.", len(found) - 2):
                ends = pc.and_(plain, pc.ends_with(words.vocab, mark)).to_numpy(zero_copy_only=False)
                tail[ends] = n
            stem_of, tail = keys.indices.to_numpy(zero_copy_only=False)[words.code], tail[words.code]
            unit = np.c_[stem_of, tail].ravel()
            real = np.c_[np.ones(len(tail), bool), tail > 0].ravel()
            count = np.where(real, size[unit], 0)
            end = np.cumsum(np.r_[0, count])
            ids = flat[np.repeat(first[unit] - end[:-1], count) + np.arange(end[-1])]
            bound = end[2 * words.off]
            for a, b in zip(bound[:-1].tolist(), bound[1:].tolist()):
                yield ids[a:b]


def encoder(path: str) -> WordEncoder:
    """This worker's encoder for a vocabulary file, kept between tasks."""
    kept = sys.modules.setdefault("tillpoint_worker_encoders", types.ModuleType("tillpoint_worker_encoders")).__dict__
    if path not in kept:
        kept[path] = WordEncoder(path)
    return kept[path]
