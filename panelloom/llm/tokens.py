"""Byte-pair ids of whole texts, fast: equal pieces between spaces are encoded once for a batch."""

from __future__ import annotations

import base64
import functools
import itertools

import numpy as np
import pyarrow as pa

from panelloom.llm.common import utf8

#: In the tokenizer's pattern no word ever holds white space except in front, so that a text may be cut before white
#: space after any other character; here after printable ASCII and the letters whose first byte is 0xC3.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SOLID = np.zeros(256, bool)
_SOLID[0x21:0x7F] = True
_SPECIAL = b"<|endoftext|>"
_LANES = 4
_MASKS = np.array([[(1 << (8 * min(8, max(0, n - 8 * k)))) - 1 for k in range(_LANES)] for n in range(8 * _LANES + 1)],
                  np.uint64)
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_CACHED = 1 << 16


class Encoder:
    """Ids as `tokenizers` gives them for `json_path` with add_special_tokens=False.

    Texts that hold the special token's own string go to that library; the others are cut at spaces, each
    different piece is encoded once from the same vocabulary's ranks and the ids are gathered. Equality with the
    library is tested.
    """

    def __init__(self, json_path: str, ranks_path: str):
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                        special_tokens={})._core_bpe.encode_ordinary
        self.json_path = json_path
        self.known: dict[bytes, list[int]] = {}
        self._library = None

    def library(self):
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.json_path)
        return self._library

    def _pieces(self, pieces: list[bytes]) -> list[list[int]]:
        if len(self.known) >= _CACHED:
            self.known.clear()
        known, encode = self.known, self.encode
        for piece in pieces:
            if piece not in known:
                known[piece] = encode(piece.decode())
        return [known[piece] for piece in pieces]

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where those of each row start (one more entry than rows). Null has none."""
        raw, at = utf8(column)
        n = len(raw)
        rows = len(at) - 1
        if not n:
            return np.zeros(0, np.uint32), np.zeros(rows + 1, np.int64)
        cut = _SPACE[raw]
        solid = _SOLID[raw]
        solid[1:] |= raw[:-1] == 0xC3
        cut[1:] &= solid[:-1]
        cut[at[:-1][at[:-1] < n]] = True
        starts = np.flatnonzero(cut)
        sizes = np.diff(starts, append=n)
        padded = np.concatenate([raw, np.zeros(8 * _LANES, np.uint8)])
        lanes = np.ndarray(n + 8 * (_LANES - 1) + 1, "<u8", padded, strides=(1,))
        masks = _MASKS[np.minimum(sizes, 8 * _LANES)]
        keys = [lanes[starts + 8 * k] & masks[:, k] for k in range(_LANES)]
        mixed = sizes.astype(np.uint64)
        for k in range(_LANES):
            mixed = (mixed ^ (mixed >> np.uint64(29))) * _MIX[3 - k] + keys[k] * _MIX[k]
        order = np.argsort(mixed)
        new = np.ones(len(starts), bool)
        same = sizes[order[1:]] == sizes[order[:-1]]
        for key in keys:
            same &= key[order[1:]] == key[order[:-1]]
        new[1:] = ~same | (sizes[order[1:]] > 8 * _LANES)  # longer ones are not compared, each counts as different
        which = np.empty(len(starts), np.int64)
        which[order] = np.cumsum(new) - 1
        firsts = order[new]
        text = raw.tobytes()
        ids = self._pieces([text[a: a + m] for a, m in zip(starts[firsts].tolist(), sizes[firsts].tolist())])
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(lengths.sum()))
        begins = np.cumsum(lengths) - lengths
        counts = lengths[which]
        ends = np.cumsum(counts)
        out = flat[np.repeat(begins[which] - (ends - counts), counts) + np.arange(ends[-1])]
        ends = np.concatenate([[0], ends])
        offsets = ends[np.searchsorted(starts, at)]
        return self._special(text, at, out, offsets) if _SPECIAL in text else (out, offsets)

    def _special(self, text, at, ids, offsets):
        parts, lengths = [], []
        for i in range(len(at) - 1):
            own = ids[offsets[i]: offsets[i + 1]]
            if _SPECIAL in text[at[i]: at[i + 1]]:
                own = np.array(self.library().encode(text[at[i]: at[i + 1]].decode(), add_special_tokens=False).ids,
                               np.uint32)
            parts.append(own)
            lengths.append(len(own))
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(lengths)])


@functools.lru_cache(maxsize=1)
def encoder(json_name: str = "byte_bpe_50k.json", ranks_name: str = "byte_bpe_50k.tiktoken") -> Encoder:
    """One for each Python worker."""
    import public_tokenizers

    return Encoder(public_tokenizers.path(json_name), public_tokenizers.path(ranks_name))
