"""Pre-tokens of whole Arrow text columns as numpy arrays, by the character classes of the tokenizers' patterns.

Two patterns share their classes (white space, letter, number, other) and the contractions `'s 't 're 've 'm 'll 'd`:

- ``word``: runs of letters, single numbers, runs of others; white space is dropped.
- ``byte``: runs of letters, of numbers and of others, each with one blank before it where there is one; of a
  longer run of white space all but the last character is a pre-token, as is what is left of it.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tallymark.llm.words import Words, raw

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: Unicode's White_Space.
WHITE_SPACE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point."""
    known = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((known.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[WHITE_SPACE] = SPACE
    return table


def byte_classes(data: np.ndarray) -> np.ndarray:
    """The class of the character that each byte of UTF-8 belongs to."""
    table = classes()
    out = table[:256][data]
    wide = np.flatnonzero(data >= 0xC0)
    if len(wide):
        last = len(data) - 1
        lead = data[wide].astype(np.int64)
        tail = [data[np.minimum(wide + k, last)].astype(np.int64) & 0x3F for k in (1, 2, 3)]
        point = np.where(
            lead < 0xE0,
            (lead & 0x1F) << 6 | tail[0],
            np.where(lead < 0xF0, (lead & 0x0F) << 12 | tail[0] << 6 | tail[1], (lead & 0x07) << 18 | tail[0] << 12 | tail[1] << 6 | tail[2]),
        )
        kind = table[point]
        out[wide] = kind
        for k, least in ((1, 0xC0), (2, 0xE0), (3, 0xF0)):
            some = lead >= least
            out[wide[some] + k] = kind[some]
    return out


def contractions(data: np.ndarray, kind: np.ndarray, starts: np.ndarray, heads: np.ndarray) -> None:
    """Put the starts right around contractions: an apostrophe that begins a pre-token and is followed by their letters."""
    marks = np.flatnonzero((data == 0x27) & starts)
    if not len(marks):
        return
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    fresh = np.zeros(len(data) + 3, bool)
    fresh[heads] = True
    one, two = padded[marks + 1], padded[marks + 2]
    pair = (((one == ord("r")) | (one == ord("v"))) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    single = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    single &= ~fresh[marks + 1]
    pair &= ~fresh[marks + 1] & ~fresh[marks + 2]
    some = single | pair
    marks, size = marks[some], np.where(single[some], 2, 3)
    starts[marks + 1] = False
    after = marks + size
    after = after[after < len(data)]
    starts[after] |= kind[after] == LETTER


def split(texts: pa.Array, pattern: str) -> Words:
    """The pre-tokens of normalised texts; ``names`` of ``byte`` pre-tokens include their blank."""
    data, offsets = raw(texts)
    n = len(data)
    kind = byte_classes(data)
    head = (data & 0xC0) != 0x80
    heads = offsets[:-1][np.diff(offsets) > 0]
    starts = np.ones(n, bool)
    starts[1:] = kind[1:] != kind[:-1]
    if pattern == "word":
        starts |= kind == NUMBER
    starts[heads] = True
    starts &= head
    if pattern == "word":
        starts &= kind != SPACE
    else:
        first = np.flatnonzero(starts)
        follows = first[1:][(kind[first[:-1]] == SPACE) & (kind[first[1:]] != SPACE)]
        fresh = np.zeros(n, bool)
        fresh[heads] = True
        follows = follows[~fresh[follows]]
        last = follows - 1  # of the white space before
        while (back := ~head[last]).any():
            last = last - back
        starts[last] = True
        starts[follows[data[last] == 0x20]] = False
    contractions(data, kind, starts, heads)
    begin = np.flatnonzero(starts)
    if pattern == "word":
        inside = kind != SPACE
        place = np.cumsum(inside, dtype=np.int64)
        bounds = np.append(place[begin] - 1, place[-1] if n else 0)
        held = data[inside]
    else:
        bounds, held = np.append(begin, n), data
    names = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(held))])
    coded = names.dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return Words(ids, np.searchsorted(begin, offsets), coded.dictionary, begin, np.diff(bounds), data, offsets)


def normalised(texts: pa.Array, tokenizer) -> tuple[pa.Array, np.ndarray]:
    """Texts as the word tokenizer's normaliser leaves them, and which of them may hold special strings.

    Below U+0180 (but for U+0130) its composition changes nothing and its lower case is one character for one, so
    Arrow's serves; the other texts go through the library's own normaliser.
    """
    data, offsets = raw(texts)
    odd = data >= 0xC6
    odd[:-1] |= (data[:-1] == 0xC4) & (data[1:] == 0xB0)
    special = np.zeros(len(data), bool)
    special[:-1] = (data[:-1] == ord("<")) & (data[1:] == ord("|"))

    def holds(marks: np.ndarray) -> np.ndarray:
        found = np.zeros(len(texts), bool)
        found[np.searchsorted(offsets, np.flatnonzero(marks), "right") - 1] = True
        return found

    slow, direct = holds(odd), holds(special)
    lower = pc.utf8_lower(texts)
    if slow.any():
        whole = lower.to_pylist()
        for i in np.flatnonzero(slow & ~direct).tolist():
            whole[i] = tokenizer.normalizer.normalize_str(texts[i].as_py())
        lower = pa.array(whole, pa.large_string())
    if direct.any():
        lower = pc.if_else(pa.array(direct), pa.scalar("", pa.large_string()), lower)
    return lower, direct
