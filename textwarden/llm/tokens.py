"""Token ids of whole texts by the tokenizers library, with a bounded memory of pieces already encoded.

A byte-level vocabulary parts a text before it merges. ``_parts`` makes the
same parts for a whole Arrow column at once, as far as bytes alone can tell
them; only parts never met before reach the library, and the ids of a column
are gathered from those of its distinct parts.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import worker_memory

#: Parts remembered per Python worker (200 bytes each); beyond that the older half is forgotten. It changes no result.
REMEMBERED = 700_000
#: Bytes of texts that are parted at once; a longer text is parted alone.
SLICE = 4_000_000
END_ID = 0

#: Kinds of bytes. ``ODD`` may be white space or belong to it, ``SEEN`` is visible; words with either go through the whole tokenizer.
BLANK, LETTER, DIGIT, SIGN, LINE, ODD, SEEN, NONE = range(8)


def _kinds() -> np.ndarray:
    """The kind of each byte. Letters are those up to U+023F, of which every version of Unicode says the same."""
    kinds = np.full(256, ODD, np.uint8)
    kinds[0x21:0x7F] = SIGN
    kinds[0x30:0x3A] = DIGIT
    kinds[0x41:0x5B] = kinds[0x61:0x7B] = LETTER
    kinds[0x80:0xC0] = kinds[0xC3:0xC9] = LETTER  # what follows a first byte, and first bytes of U+00C0 on
    kinds[0xC9:0xE1] = kinds[0xE4:0xF5] = SEEN  # neither white space nor letters that are known for sure
    kinds[0x20], kinds[0x0A], kinds[0x27] = BLANK, LINE, SEEN  # an apostrophe starts parts such as 's
    return kinds


KINDS = _kinds()


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _tokenizer(path: str):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True  # their names in a text are ordinary text
    return tok


def _cuts_at_blanks(path: str) -> bool:
    """Whether a vocabulary is of the kind that starts a new piece at a blank before a visible character."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    splitter = made.get("pre_tokenizer") or {}
    plain = splitter.get("type") == "ByteLevel" and splitter.get("use_regex", True) and not splitter.get("add_prefix_space")
    added = all(t.get("special") for t in made.get("added_tokens") or [])
    return bool(plain and added and made.get("normalizer") is None and not made.get("truncation") and not made.get("padding"))


def _byte_letters() -> np.ndarray:
    """The letter by which a byte-level vocabulary writes each byte: itself where it can be printed, else from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    letters = np.arange(256, dtype="<u2")
    letters[hidden] = 256 + np.arange(len(hidden))
    return letters


LETTERS = _byte_letters()
_NUL = chr(LETTERS[0])


def _encode(tok, texts: list[str]) -> list[bytes]:
    return [array("I", e.ids).tobytes() for e in tok.encode_batch_fast(texts, add_special_tokens=False)]


def _merge(model, parts: list[bytes]) -> list[bytes]:
    """Ids of parts that the splitter leaves whole, by the model of the tokenizer alone."""
    if not parts:
        return []
    written = LETTERS[np.frombuffer(b"\0".join(parts), np.uint8)].tobytes().decode("utf-16-le").split(_NUL)
    return [array("I", [t.id for t in model.tokenize(w)]).tobytes() for w in written]


def _parts(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the parts of texts start, and which of them need the whole tokenizer.

    ``data`` holds the bytes of texts one after the other, ``ends`` the place
    after each text that is not empty. A word starts at a blank before a
    visible character. In words of known letters, digits, signs and single or
    double line ends a part starts wherever the kind changes, and at each line
    end; a word with anything else is one part for the whole tokenizer.
    """
    kind = KINDS[data]
    lead = np.flatnonzero(data == 0xC3)
    follow = data[np.minimum(lead + 1, len(data) - 1)]
    kind[lead[(follow == 0x97) | (follow == 0xB7)]] = SEEN  # the signs of multiplication and division
    after = np.empty_like(kind)
    after[:-1] = kind[1:]
    after[ends - 1] = NONE
    plain = np.zeros(8, bool)
    plain[[LETTER, DIGIT, SIGN]] = True
    visible = plain.copy()
    visible[SEEN] = True

    blank = kind == BLANK
    word = blank & visible[after]
    odd = (kind >= ODD) | (blank & ~word)
    lines = np.flatnonzero(kind == LINE)
    behind = after[np.minimum(lines + 1, len(data) - 1)]
    odd[lines[~(plain[after[lines]] | ((after[lines] == LINE) & plain[behind]))]] = True
    word[0] = True
    word[ends[:-1]] = True

    words = np.flatnonzero(word)
    whole = np.zeros(len(words), bool)
    whole[np.searchsorted(words, np.flatnonzero(odd), "right") - 1] = True
    inside = np.zeros(len(kind), bool)
    inside[1:] = ((kind[1:] != kind[:-1]) | (kind[1:] == LINE)) & ~blank[:-1]
    if whole.any():
        whole_bytes = np.repeat(whole, np.diff(words, append=len(data)))
        starts = np.flatnonzero(word | (inside & ~whole_bytes))
        return starts, whole_bytes[starts]
    starts = np.flatnonzero(word | inside)
    return starts, np.zeros(len(starts), bool)


def _ids_of(memory: dict, parts: pa.Array, codes: np.ndarray, whole: np.ndarray, remembered: int) -> list[bytes]:
    """Ids of the distinct ``parts``; ``whole`` says of each of the ``codes`` whether its part needs the whole tokenizer."""
    keys = parts.to_pylist()
    young, old = memory["pieces"], memory["older"]
    found = list(map(young.get, keys))
    missing = []
    for i, ids in enumerate(found):
        if ids is None:
            ids = old.get(keys[i])
            if ids is None:
                missing.append(i)
            else:
                found[i] = young[keys[i]] = ids
    if missing:
        slow = np.zeros(len(keys), bool)
        slow[codes[whole]] = True
        fast = [i for i in missing if not slow[i]]
        rest = [i for i in missing if slow[i]]
        for i, ids in zip(fast, _merge(memory["tokenizer"].model, [keys[i] for i in fast]), strict=True):
            found[i] = young[keys[i]] = ids
        for i, ids in zip(rest, _encode(memory["tokenizer"], [keys[i].decode() for i in rest]), strict=True):
            found[i] = young[keys[i]] = ids
    if len(young) > remembered // 2:
        memory["older"], memory["pieces"] = young, {}
    return found


def _slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``SLICE`` bytes, or of one longer text."""
    at, last = 0, len(offsets) - 1
    while at < last:
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, "right")) - 1)
        yield at, upto
        at = upto


def encode_arrays(texts: pa.Array | list[str | None], path: str, remembered: int = REMEMBERED) -> Iterator[np.ndarray]:
    """For each text its ids with the end id, as unsigned 32-bit integers.

    Words come again and again, so each distinct part of the texts is encoded
    once; joined, their ids are those of the whole text. With a vocabulary of
    another kind whole texts are encoded. None and "" give the end id alone.
    """
    memory = worker_memory(f"tokens of {path}")
    if not memory:
        memory.update(tokenizer=_tokenizer(path), pieces={}, older={}, cut=_cuts_at_blanks(path))
    texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
    if not memory["cut"]:
        for ids in _encode(memory["tokenizer"], [t or "" for t in texts.to_pylist()]):
            yield np.append(np.frombuffer(ids, np.uint32), np.uint32(END_ID))
        return
    texts = texts.cast(pa.large_string()).fill_null("")
    _, places, held = texts.buffers()
    offsets = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    for first, upto in _slices(offsets):
        bounds = offsets[first : upto + 1]
        size = int(bounds[-1] - bounds[0])
        if not size:
            yield from np.full((upto - first, 1), END_ID, np.uint32)
            continue
        data = np.frombuffer(held, np.uint8, size, int(bounds[0]))
        bounds = bounds - bounds[0]
        starts, whole = _parts(data, bounds[1:][np.diff(bounds) > 0])
        ends = pa.py_buffer(np.append(starts, size))
        parts = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, ends, pa.py_buffer(data)]).dictionary_encode()
        codes = parts.indices.to_numpy()
        found = _ids_of(memory, parts.dictionary, codes, whole, remembered)
        # The end id is one more part, behind the last part of each text.
        found.append(array("I", [END_ID]).tobytes())
        last = np.searchsorted(starts, bounds[1:])
        codes = np.insert(codes, last, len(found) - 1)
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat, begin = np.frombuffer(b"".join(found), np.uint32), np.cumsum(lengths) - lengths
        upon = np.cumsum(lengths[codes])
        ids = flat[np.repeat(begin[codes] - upon + lengths[codes], lengths[codes]) + np.arange(upon[-1])]
        yield from np.split(ids, upon[last + np.arange(len(last))][:-1])


def encode(texts: pa.Array | list[str | None], path: str, remembered: int = REMEMBERED) -> list[bytes]:
    """The same as little-endian unsigned 32-bit integers."""
    return [ids.astype("<u4", copy=False).tobytes() for ids in encode_arrays(texts, path, remembered)]
