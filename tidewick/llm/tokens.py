"""Token ids of whole texts by a byte-level BPE file, for use inside Arrow tasks.

A block of texts is cut into the pieces that the file's pattern makes of them,
by numpy over the UTF-8 bytes; each distinct piece of the block is merged once
and its ids are looked up for every place. Texts with characters outside Latin
and general punctuation, or with an added token of the file, go to the
`tokenizers` library whole; so does every text where the file is of another kind.
"""

from __future__ import annotations

import itertools
import json

import numpy as np
import pyarrow as pa

LETTER, DIGIT, SPACE, OTHER = 1, 2, 3, 4
#: Bytes of text that are cut and merged at once.
BLOCK = 12 << 20
#: Pieces of more bytes are merged by the tokenizers library, whose time grows with n log n.
LONG_PIECE = 500

# Letters, digits and white space among U+0080..U+00BF, white space among U+2000..U+203F (last bytes).
C2_LETTERS, C2_DIGITS, C2_SPACES = (0xAA, 0xB5, 0xBA), (0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE), (0x85, 0xA0)
E280_SPACES = (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)

ASCII = np.full(256, OTHER, dtype=np.int8)
ASCII[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
ASCII[0x30:0x3A] = DIGIT
ASCII[[*range(0x09, 0x0E), 0x20]] = SPACE


def byte_letters() -> dict[str, int]:
    """The letter by which a byte-level vocabulary writes each byte: printable Latin-1 as itself, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def classes(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class of the character that each byte belongs to, and the bytes of characters that are left to the library."""
    out = ASCII[b]
    away = np.zeros(len(b), dtype=bool)
    lead = np.flatnonzero(b >= 0xC0)
    if not len(lead):
        return out, away
    first, second = b[lead], b[np.minimum(lead + 1, len(b) - 1)]
    third = b[np.minimum(lead + 2, len(b) - 1)]
    kind = np.full(len(lead), OTHER, dtype=np.int8)
    kind[(first >= 0xC3) & (first <= 0xC9)] = LETTER
    kind[(first == 0xC3) & ((second == 0x97) | (second == 0xB7))] = OTHER
    c2 = first == 0xC2
    for values, k in ((C2_LETTERS, LETTER), (C2_DIGITS, DIGIT), (C2_SPACES, SPACE)):
        kind[c2 & np.isin(second, values)] = k
    e2 = first == 0xE2
    kind[e2 & (second == 0x80) & np.isin(third, E280_SPACES)] = SPACE
    kind[e2 & (second == 0x81) & (third == 0x9F)] = SPACE
    known = (first < 0xC9) | ((first == 0xC9) & (second < 0x90)) | (e2 & ((second == 0x80) | ((second == 0x81) & (third < 0xB0)) | ((second == 0x82) & (third >= 0xA0))))
    away[lead[~known]] = True
    out[lead] = kind
    out[np.minimum(lead + 1, len(b) - 1)] = kind
    three = lead[e2]
    out[np.minimum(three + 2, len(b) - 1)] = kind[e2]
    return out, away


def piece_starts(b: np.ndarray, cls: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where the pieces of the pattern begin; `begins` are the places where texts begin (sorted, each below len(b))."""
    fresh = np.zeros(len(b), dtype=bool)
    fresh[begins] = True
    start = fresh.copy()
    start[1:] |= cls[1:] != cls[:-1]
    rs = np.flatnonzero(start)
    re_ = np.append(rs[1:], len(b))
    rc = cls[rs]
    goes_on = np.append(~fresh[rs[1:]], False)  # the next run belongs to the same text
    # A run of white space gives its last character to what follows, if that is a space, or stands alone before it.
    sp = np.flatnonzero((rc == SPACE) & goes_on)
    p = re_[sp] - 1
    for _ in range(2):
        p = np.where((b[p] & 0xC0) == 0x80, p - 1, p)
    start[p] = True
    joined = b[p] == 0x20
    start[re_[sp[joined]]] = False
    # An apostrophe alone before s, t, m, d, re, ve or ll takes these letters with it.
    ap = np.flatnonzero((rc == OTHER) & (re_ - rs == 1) & (b[rs] == 0x27) & start[rs] & goes_on)
    ap = ap[rc[np.minimum(ap + 1, len(rc) - 1)] == LETTER]
    if len(ap):
        n, end = rs[ap + 1], re_[ap + 1]
        x, y = b[n], np.where(n + 1 < end, b[np.minimum(n + 1, len(b) - 1)], 0)
        two = ((x == 0x72) & (y == 0x65)) | ((x == 0x76) & (y == 0x65)) | ((x == 0x6C) & (y == 0x6C))
        k = np.where(np.isin(x, (0x73, 0x74, 0x6D, 0x64)), 1, np.where(two, 2, 0))
        took = k > 0
        start[n[took]] = False
        rest = (n + k)[took & (n + k < end)]
        start[rest] = True
    return np.flatnonzero(start)


class Encoder:
    """Ids by a tokenizer file (its JSON text)."""

    def __init__(self, text: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(text)
        self.added: list[bytes] = []
        self.merge = None
        spec = json.loads(text)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and model["type"] == "BPE"
        options = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        if plain and not any(model.get(k) for k in options):
            self.ranked(spec)

    def ranked(self, spec: dict) -> None:
        """Merges by rank, if the file's merges stand in the order of the ids that they make."""
        import tiktoken

        letters, vocabulary = byte_letters(), spec["model"]["vocab"]
        added = {t["content"] for t in spec.get("added_tokens", ())}
        ranks = {bytes(letters[c] for c in t): i for t, i in vocabulary.items() if t not in added}
        made = [vocabulary["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in spec["model"]["merges"]]
        if made == sorted(made) and len(set(made)) == len(made) and len(ranks) == 256 + len(made) and max(ranks.values()) == len(ranks) - 1:
            self.merge = tiktoken.Encoding("file", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
            self.added = [t.encode() for t in added]

    def plainly(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def pieces(self, distinct: list[bytes]) -> list[list[int]]:
        merge, whole = self.merge, self.whole
        return [merge(x) if len(x) <= LONG_PIECE else whole.encode(x.decode(), add_special_tokens=False).ids for x in distinct]

    def block(self, data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """Ids of each of the texts data[at[i]:at[i + 1]]."""
        sizes = np.diff(at)
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(sizes)
        if not len(data):
            return out
        whole = np.zeros(len(sizes), dtype=bool)
        if self.merge is None:
            whole[:] = sizes > 0
        else:
            cls, away = classes(data)
            far = np.flatnonzero(away)
            whole[np.searchsorted(at, far, "right") - 1] = True
            raw = data.tobytes()
            for t in self.added:
                i = raw.find(t)
                while i >= 0:
                    whole[int(np.searchsorted(at, i, "right")) - 1] = True
                    i = raw.find(t, i + 1)
        odd = np.flatnonzero(whole)
        for i in odd:
            out[i] = self.plainly([data[at[i] : at[i + 1]].tobytes().decode()])[0]
        good = np.flatnonzero(~whole & (sizes > 0))
        if not len(good):
            return out
        if len(odd):
            keep = np.repeat(~whole, sizes)
            data, cls = data[keep], cls[keep]
        ends = np.cumsum(sizes[good])
        begins = ends - sizes[good]
        starts = piece_starts(data, cls, begins)
        offsets = np.append(starts, len(data)).astype(np.int32)
        cut = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        ids = self.pieces(cut.dictionary.to_pylist())
        length = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(length.sum()))
        place = np.cumsum(length) - length
        which = cut.indices.to_numpy()
        n = length[which]
        first = np.cumsum(n) - n
        every = flat[np.arange(int(n.sum())) + np.repeat(place[which] - first, n)]
        bounds = np.append(first, len(every))[np.append(np.searchsorted(starts, begins), len(starts))]
        for i, a, z in zip(good, bounds[:-1], bounds[1:], strict=True):
            out[i] = every[a:z]
        return out

    def encode(self, column: pa.Array):
        """Yields, block by block, the row of the block's first text and the ids of its texts; null counts as empty."""
        if pa.types.is_null(column.type):
            column = column.cast(pa.string())
        column = column.fill_null("")
        wide = pa.types.is_large_string(column.type)
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        i = 0
        while i < len(column):
            j = max(i + 1, int(np.searchsorted(at, at[i] + BLOCK, "right")) - 1)
            yield i, self.block(buf[at[i] : at[j]], at[i : j + 1] - at[i])
            i = j
