"""Token ids of whole blocks of text, each distinct word encoded once.

A unit is a word with the white space before it. Both tokenizers here never join characters across the start of a
unit, so a text's ids are those of its units, one after another (tests hold this against plain encoding).
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np

from tessaria.llm.blocks import Block, PrefixHash, SPACE, U, Words, word_hashes, words

#: White space beyond ASCII, which ties words together in the split pattern; rows with it are encoded whole.
WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indexes starts[i] .. starts[i]+counts[i]-1 of every i, one after another."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An index of each distinct value, and every value's place among them."""
    _, index, place = np.unique(h, return_index=True, return_inverse=True)
    return index, place


class ByteBpe:
    """Byte-level BPE over a rank file; the ids are those of the JSON file of the same vocabulary."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for piece, rank in ranks.items():
            self.sizes[rank] = len(piece)

    def plain(self, text: bytes) -> np.ndarray:
        return np.asarray(self.encoding.encode_ordinary(text.decode("utf-8", "replace")), np.uint32)

    def encode(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, and per row its first id's place (with the total at the end)."""
        w, data, offsets = words(block), block.data, block.offsets
        n = len(offsets) - 1
        size = np.diff(offsets)
        whole = np.zeros(n, bool)
        some = size > 0
        whole[some] = SPACE[data[offsets[:-1][some]]] | SPACE[data[offsets[1:][some] - 1]]
        at = [m.start() for m in WIDE_SPACE.finditer(data)] if (data >= 0xC2).any() else []
        whole[np.searchsorted(offsets, np.asarray(at, np.int64), "right") - 1] = True
        keep = ~whole[w.rows]
        head = np.zeros(len(w.start), bool)
        head[w.first[:-1][np.diff(w.first) > 0]] = True
        begin = np.where(head, w.start, np.concatenate(([0], w.end[:-1])))
        begin, end, head, rows = begin[keep], w.end[keep], head[keep], w.rows[keep]
        if len(begin):
            h = PrefixHash(data.astype(U) + U(1)).of(begin, end) ^ (head.astype(U) * U(0xA5A5A5A5A5A5A5A5))
            index, place = distinct(h)
            raw = data.tobytes()
            units = [b"\n" + raw[a:b] if f else raw[a:b] for a, b, f in zip(begin[index].tolist(), end[index].tolist(), head[index].tolist(), strict=True)]
            ids = np.asarray(self.encoding.encode_to_numpy(b"".join(units).decode("utf-8", "replace"), disallowed_special=()), np.uint32)
            stop = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum([len(u) for u in units])) + 1
            first = np.concatenate(([0], stop[:-1])) + head[index]
            count = (stop - first)[place]
            flat = ids[spread(first[place], count)]
            sums = np.zeros(len(count) + 1, np.int64)
            np.cumsum(count, out=sums[1:])
            places = sums[np.searchsorted(rows, np.arange(n + 1))]
        else:
            flat, places = np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
        if whole.any():
            parts, shift, last = [], np.zeros(n + 1, np.int64), 0
            for i in np.flatnonzero(whole).tolist():
                own = self.plain(block.text(i))
                parts += [flat[last : places[i]], own]
                last = places[i]
                shift[i + 1] = len(own)
            flat, places = np.concatenate([*parts, flat[last:]]), places + np.cumsum(shift)
        return flat, places


@lru_cache(maxsize=2)
def byte_bpe(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


@lru_cache(maxsize=2)
def sentence_model(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    is_byte = np.array([model.is_byte(i) for i in range(model.get_piece_size())])
    return model, is_byte


def word_pieces(block: Block, w: Words, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of every word: all ids, the words' counts of ids, and which ids are single bytes."""
    model, is_byte = sentence_model(path)
    index, place = distinct(word_hashes(block, w))
    raw = block.data.tobytes()
    found = model.encode([raw[a:b].decode("utf-8", "replace") for a, b in zip(w.start[index].tolist(), w.end[index].tolist(), strict=True)], num_threads=1) if len(index) else []
    count = np.fromiter(map(len, found), np.int64, len(found))
    ids = np.fromiter((x for own in found for x in own), np.int32, int(count.sum()))
    first = np.concatenate(([0], np.cumsum(count)[:-1])) if len(count) else count
    return ids[spread(first[place], count[place])], count[place], is_byte
