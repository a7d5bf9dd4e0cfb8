"""Token ids of whole texts by the tokenizers library, with a memo of words.

Both vocabularies split a text before their merges, and never across the place where a
word ends and a run of spaces or line ends begins. So a text's ids are those of its parts
between such places, and each part has to be encoded once. Texts with other white space
or with the name of a special token are encoded whole.

The parts of a batch of texts are told apart in Arrow; Python sees each different one once.
Those that are new are encoded many to a call, in one string, and told apart by the bytes
of their tokens, or by a word between them where tokens do not keep their bytes.

A vocabulary that lower-cases texts and cuts letters from all else before its merges has
fewer parts: texts are lower-cased, and words cut from what follows them, in Arrow. Words
of a to z go straight to the merges then, and the last token of each tells them apart.
"""

from __future__ import annotations

import functools
import gc
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from gritsieve.llm.common import held

CACHED_PARTS = 250_000  # of the younger and of the older half of the memo
MEMO_BYTES = 48 << 20  # of each half, with what Python's objects take
ENTRY_BYTES = 150  # a part's name, its ids and its place, besides their contents
TOGETHER = 500  # new parts in one string
ODD_SPACE = re.compile("[\0\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
DOUBLE_SPACE = re.compile("[ \n][ \n]")
PARTS = re.compile("[ \n]*[^ \n]+|[ \n]+")
BETWEEN = "\x01"
MARK = re.compile("[\u0300-\u036f]")  # of accents that are put together with the letter before
#: Normalisers and pre-tokenizers for which a letter's case, and a space behind a letter
#: that no letter or digit follows, make no difference; the suffix of last tokens.
LOWERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
CUTS = {
    "type": "Split", "behavior": "Removed", "invert": True,
    "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
}
LAST = "</w>"
WORD_ENDS = r"([a-z])([!-/:-@\[-`{-~])"


class Encoder:
    """Encodes texts to arrays of 16-bit or 32-bit ids, each followed by ``end``."""

    def __init__(self, path: str, end: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.end = np.array([] if end is None else [end], self.type).tobytes()
        names = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(names) or "(?!)", re.IGNORECASE)
        ids = [x.ids for x in self.tokenizer.encode_batch_fast([" a\nb", "a", "b"], add_special_tokens=False)]
        self.drops_space = ids[0] == ids[1] + ids[2]
        between = self.tokenizer.encode(BETWEEN, add_special_tokens=False).ids
        self.between = between[0] if self.drops_space and len(between) == 1 else None
        self.lengths = None if self.drops_space else self._lengths()
        self.merges = None  # encodes words of a to z, with a space between them
        if self.between is not None and _lowers(path):
            self.merges = Tokenizer(self.tokenizer.model)
            self.merges.pre_tokenizer = WhitespaceSplit()
            pieces = map(self.tokenizer.id_to_token, range(self.tokenizer.get_vocab_size()))
            self.last = np.array([(x or "").endswith(LAST) for x in pieces])
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # what was known before known became full
        self.size = 0

    def _lengths(self) -> np.ndarray | None:
        """Bytes of each token, if tokens keep the bytes of a text, one character for each."""
        pieces = map(self.tokenizer.id_to_token, range(self.tokenizer.get_vocab_size()))
        lengths = np.array([len(x or "") for x in pieces])
        probe = " É\nx \u4e00y ~"
        ids = self.tokenizer.encode(probe, add_special_tokens=False).ids
        return lengths if lengths[ids].sum() == len(probe.encode()) else None

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, self.type) for x in found]

    def _cut(self, parts: list[str], ids: np.ndarray) -> list[bytes] | None:
        """The ids of each part from those of all parts in one string; None if they do not fit."""
        if self.between is not None:
            cuts = np.flatnonzero(ids == self.between)
            if len(cuts) != len(parts) - 1:
                return None
            return self._sliced(ids, np.r_[0, cuts + 1], np.r_[cuts, len(ids)])
        over = np.r_[0, np.cumsum(self.lengths[ids])]
        ends = np.cumsum([len(x.encode()) for x in parts])
        cuts = np.searchsorted(over, ends)
        if over[-1] != ends[-1] or (over[cuts] != ends).any():
            return None
        return self._sliced(ids, np.r_[0, cuts[:-1]], cuts)

    def _sliced(self, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
        data, size = ids.tobytes(), self.type.itemsize
        return [data[a:b] for a, b in zip((starts * size).tolist(), (ends * size).tolist())]

    def _fresh(self, parts: list[str]) -> list[bytes]:
        """The ids of each of these strings."""
        if self.between is None and self.lengths is None:
            return [x.tobytes() for x in self._ids(parts)]
        groups = [parts[i : i + TOGETHER] for i in range(0, len(parts), TOGETHER)]
        joint = "" if self.between is None else f" {BETWEEN} "
        out = []
        for group, ids in zip(groups, self._ids([joint.join(x) for x in groups])):
            out += self._cut(group, ids) or [x.tobytes() for x in self._ids(group)]
        return out

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of each of these words of a to z."""
        groups = [words[i : i + TOGETHER] for i in range(0, len(words), TOGETHER)]
        out = []
        for group, found in zip(groups, self.merges.encode_batch_fast([" ".join(x) for x in groups], add_special_tokens=False)):
            ids = np.array(found.ids, self.type)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(group):
                out += self._sliced(ids, np.r_[0, ends[:-1]], ends)
            else:
                out += [x.tobytes() for x in self._ids(group)]
        return out

    def _parts(self, text: str) -> list[str] | None:
        """The parts of a text that has to be looked at character by character, by name: a
        word stands for itself behind a space, or in a vocabulary without spaces for itself;
        "\n..." and "\0..." for what follows them, with the line end or exactly. None: the
        text has to be encoded whole, []: it has no such places and is split in Arrow."""
        if ODD_SPACE.search(text) or self.special.search(text) or BETWEEN in text:
            return None
        if self.merges is not None and not text.isascii() and MARK.search(text):
            return None
        if self.drops_space or (text and text[0] not in " \n" and text[-1] not in " \n" and not DOUBLE_SPACE.search(text)):
            return []
        return ["\0" + x for x in PARTS.findall(text)]

    def _learn(self, missing: list[str]) -> None:
        older = self.older
        again = {x: older[x] for x in missing if x in older}
        new = [x for x in missing if x not in again]
        if self.merges is not None:
            plain, other = [], []
            for x in new:
                (plain if x.isascii() and x.isalpha() else other).append(x)
            new = plain + other
            ids = self._words(plain) + self._fresh(other)
        elif self.drops_space:
            ids = self._fresh(new)
        else:
            exact, after = ([x for x in new if (x[:1] == "\0") is kind] for kind in (True, False))
            new = exact + after
            ids = [x.tobytes() for x in self._ids([x[1:] for x in exact])]
            ids += self._fresh([x if x[:1] == "\n" else " " + x for x in after])
        again.update(zip(new, ids))
        self.known.update(again)
        self.size += sum(map(len, again)) + sum(map(len, again.values())) + ENTRY_BYTES * len(again)

    def _split(self, texts: list[str]) -> pa.ListArray:
        """The names of the parts of texts whose words have one space or line end between them."""
        plain = pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " " if self.drops_space else " \n")
        if not self.drops_space:
            first, nothing = (pa.scalar(x, pa.large_string()) for x in ("\0", ""))
            plain = pc.binary_join_element_wise(first, plain, nothing)
        if self.merges is not None:
            plain = pc.replace_substring_regex(pc.ascii_lower(plain), WORD_ENDS, r"\1 \2")
        return pc.split_pattern(plain, " ")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. No cycles arise here, so Python need not look for any among
        the many small objects."""
        gc.disable()
        try:
            return self._encoded(texts)
        finally:
            gc.enable()

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        kinds = [self._parts(text) for text in texts]
        out: list[np.ndarray | None] = [None] * len(texts)
        whole = [i for i, kind in enumerate(kinds) if kind is None]
        for i, ids in zip(whole, self._ids([texts[i] for i in whole])):
            out[i] = np.frombuffer(ids.tobytes() + self.end, self.type)
        simple = [i for i, kind in enumerate(kinds) if kind == []]
        others = [i for i, kind in enumerate(kinds) if kind]
        lists = self._split([texts[i] for i in simple])
        odd = [part for i in others for part in kinds[i]]
        flat = pa.concat_arrays([lists.flatten(), pa.array(odd, pa.large_string())]).dictionary_encode()
        sizes = np.r_[np.diff(lists.offsets.to_numpy()), [len(kinds[i]) for i in others]].astype(np.int64)

        if len(self.known) > CACHED_PARTS or self.size > MEMO_BYTES:
            self.older, self.known, self.size = self.known, {}, 0
        names = flat.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.known.get, names))
        if holes := [i for i, x in enumerate(ids) if x is None]:
            self._learn([names[i] for i in holes])
            for i in holes:
                ids[i] = self.known[names[i]]
        every = pa.array(ids, pa.large_binary()).take(flat.indices)  # one after the other in its buffer
        _, places, data = every.buffers()
        joined = memoryview(data) if data else b""
        cuts = np.frombuffer(places, np.int64)[np.r_[0, np.cumsum(sizes)]].tolist() if len(every) else [0] * (len(sizes) + 1)
        for i, a, b in zip([*simple, *others], cuts[:-1], cuts[1:]):
            out[i] = np.frombuffer(b"".join((joined[a:b], self.end)), self.type)
        return out


@functools.cache
def _lowers(path: str) -> bool:
    """Whether this vocabulary is one of those that LOWERS and CUTS are about."""
    with open(path, encoding="utf-8") as file:
        known = json.load(file)
    normalizers = (known["normalizer"] or {}).get("normalizers")
    cuts, *rest = (known["pre_tokenizer"] or {}).get("pretokenizers") or [None]
    bytes_only = [(x["type"], x.get("add_prefix_space"), x.get("use_regex")) for x in rest] == [("ByteLevel", False, False)]
    model = known["model"]
    return normalizers == LOWERS and cuts == CUTS and bytes_only and model.get("end_of_word_suffix") == LAST


def encoder(path: str, end: int | None = None) -> Encoder:
    """This process's encoder for a vocabulary file."""
    return held(("tokens", path, end), lambda: Encoder(path, end))
