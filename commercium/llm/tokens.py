"""Token ids of whole texts from a public tokenizer, with a cache of words.

A text is cut where the tokenizer always cuts too, each new word is tokenized once
by the library, and a text's ids are its words' ids in a row.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa

from commercium.llm.text import Words, chunks, mix, text_bytes

CHUNK_BYTES = 1 << 20
#: Bytes of all arrays of known words, beyond which a worker starts anew.
CACHE_BYTES = 1 << 26
_ODD = -1
_loaded: dict[tuple[str, bool, bool], "Encoder"] = {}


class Encoder:
    """Ids of texts, equal to the library's on the whole text.

    Words are known by 128 bits of hash. Where the tokenizer keeps white space
    (byte-level), a word is taken with the one space or newline before it; texts with
    other gaps between words go to the library whole. Where it drops white space,
    every word stands alone. Texts that hold the literal of an added token go to the
    library whole; with ``plain`` literals are ordinary text. With ``front`` every text is
    taken with a space before it.
    """

    #: Finds literals of added tokens in texts, if a text can hold any.
    literals: re.Pattern[bytes] | None = None

    front = False

    def __init__(self, path: str, plain: bool = False, front: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.front = front
        added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        if added and not plain:
            self.literals = re.compile(b"|".join(re.escape(t) for t in sorted(added)))
        self.keep_spaces = self.whole("a b") != self.whole("a  b")
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self._empty()

    #: Arrays with an item for each known word, in the order they were learned, and of their parts in a row.
    _words, _parts = ("checks", "first", "count"), ("pool",)

    def _empty(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted
        self.slot = np.zeros(0, np.int64)  # which word has each of them
        self.checks = np.zeros(0, np.uint64)
        self.first = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.pool = np.zeros(0, self.type)

    def _cached_bytes(self) -> int:
        return sum(getattr(self, name).nbytes for name in ("keys", "slot", *self._words, *self._parts))

    #: What stands before a word of each form.
    leads = ("", " ", "\n")

    def _whole(self, text: str, keys: np.ndarray | None, k: int) -> list[int]:
        return self.whole(text)

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(" " * self.front + text, add_special_tokens=False).ids

    def _ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``words`` in a row, and where each word's begin."""
        made = self.tokenizer.encode(words, is_pretokenized=True, add_special_tokens=False)
        owner = np.array(made.word_ids, np.int64)
        return np.array(made.ids, self.type), np.searchsorted(owner, np.arange(len(words) + 1))

    def _learned(self, words: list[str]) -> dict[str, np.ndarray]:
        """What is to be appended to the arrays of words and parts, but for the checks."""
        ids, places = self._ids_of(words)
        count = np.diff(places)
        if self.keep_spaces:
            count[self._odd(words)] = _ODD
        return {"first": places[:-1] + len(self.pool), "count": count, "pool": ids}

    @staticmethod
    def _odd(words: list[str]) -> list[int]:
        """Words that begin with further white space and belong to a longer gap."""
        return [k for k, w in enumerate(words) if w[w[0] in " \n" :][:1].isspace()]

    def _learn(self, keys: np.ndarray, checks: np.ndarray, words: list[str]) -> None:
        new = {"checks": checks, **self._learned(words)}
        slots = len(self.slot) + np.arange(len(keys))
        for name, more in new.items():
            old = getattr(self, name)
            setattr(self, name, np.concatenate([old, more.astype(old.dtype)]))
        order = np.argsort(np.concatenate([self.keys, keys]), kind="stable")
        self.keys = np.concatenate([self.keys, keys])[order]
        self.slot = np.concatenate([self.slot, slots])[order]

    def _form(self, data: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """For each word 0 (nothing before it), 1 (a space) or 2 (a newline); which texts have other gaps."""
        begins = np.zeros(len(words.start), bool)
        begins[words.bounds[:-1][words.count > 0]] = True
        gap = np.where(begins, 0, words.start - np.roll(words.end, 1))
        before = data[np.maximum(words.start - 1, 0)]
        form = np.where(begins, int(self.front), np.where(before == 32, 1, 2)).astype(np.uint64)
        bad = (gap > 1) | (~begins & (before != 32) & (before != 10))
        return form, bad

    def _chunk(self, data: np.ndarray, places: np.ndarray, keys: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        words = Words(data, places)
        texts = len(places) - 1
        whole = np.zeros(texts, bool)
        form = np.zeros(len(words.start), np.uint64)
        if self.keep_spaces:
            form, bad = self._form(data, words)
            owner = words.text_of()
            whole[owner[bad]] = True
            some = words.count > 0
            edge = np.zeros(texts, bool)
            edge[some] = (words.start[words.bounds[:-1][some]] != places[:-1][some]) | (
                words.end[words.bounds[1:][some] - 1] != places[1:][some]
            )
            whole |= edge | (~some & ((np.diff(places) > 0) | self.front))
        if self.literals is not None:
            hits = [m.start() for m in self.literals.finditer(data.tobytes())]
            whole[np.searchsorted(places, hits, "right") - 1] = True
        key = mix(words.hash + form)
        check = mix(words.second() ^ form)
        _, sample, inverse = np.unique(key, return_index=True, return_inverse=True)
        if len(key) and (check[sample][inverse] != check).any():
            raise ValueError("two words share a hash")
        if self._cached_bytes() > CACHE_BYTES:
            self._empty()
        at = np.searchsorted(self.keys, key[sample])
        known = np.zeros(len(sample), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == key[sample][inside]
        if not known.all():
            raw = data.tobytes()
            new = sample[~known]
            lead = self.leads
            spans = zip(form[new].tolist(), words.start[new].tolist(), words.end[new].tolist(), strict=True)
            texts_of = [lead[f] + raw[a:b].decode("utf-8", "replace") for f, a, b in spans]
            self._learn(key[new], check[new], texts_of)
            at = np.searchsorted(self.keys, key[sample])
        own = self.slot[at]
        if (self.checks[own] != check[sample]).any():
            raise ValueError("two words share a hash")
        entry = own[inverse]
        count = self.count[entry]
        if self.keep_spaces:
            whole[owner[count == _ODD]] = True
        if whole.any():
            count = np.where(whole[words.text_of()], 0, count)
        ids, count = self._spell(entry, count, words, form, keys)
        bounds = np.concatenate([[0], np.cumsum(count)])[words.bounds]
        if whole.any():
            parts, sizes = [], np.diff(bounds)
            for k in range(texts):
                if whole[k]:
                    text = data[places[k] : places[k + 1]].tobytes().decode("utf-8", "replace")
                    part = np.array(self._whole(text, keys, k), self.type)
                    sizes[k] = len(part)
                else:
                    part = ids[bounds[k] : bounds[k + 1]]
                parts.append(part)
            ids, bounds = np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)])
        return ids, bounds

    def _spell(
        self, entry: np.ndarray, count: np.ndarray, words: Words, form: np.ndarray, texts: np.ndarray | None
    ) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each has; words of ``count`` 0 have none."""
        shift = np.repeat(self.first[entry] - (np.cumsum(count) - count), count)
        return self.pool[shift + np.arange(len(shift))], count

    def encode(self, column: pa.Array, keys: np.ndarray | None = None):
        """(first text, ids, bounds) for stretches of texts; text first + k has ids[bounds[k]:bounds[k + 1]].

        ``keys`` are numbers of the texts for encoders whose ids depend on them.
        """
        data, places = text_bytes(column)
        for a, b in chunks(places, CHUNK_BYTES):
            own = None if keys is None else keys[a:b]
            yield a, *self._chunk(data[places[a] : places[b]], places[a : b + 1] - places[a], own)


def encoder(path: str, plain: bool = False, front: bool = False) -> Encoder:
    """The encoder of a file, kept for the life of a worker."""
    key = (path, plain, front)
    if key not in _loaded:
        _loaded[key] = Encoder(*key)
    return _loaded[key]
