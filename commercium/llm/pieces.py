"""Encoding with a SentencePiece merge vocabulary under seeded merge-dropout, and decoding.

Merges run on an agenda, best score first and leftmost among equals. With dropout each
merge taken from the agenda is skipped if a hash of it falls below the rate, keyed by seed,
document, the word's place, the two positions and the merged piece. So each occurrence of
a word is drawn for itself; all segmentations decode to the text.

The agendas of many words run side by side: a round takes from each the best merge that
its hash does not skip. A word's plain merges and ids are kept; an occurrence that skips
none of them has these ids, the others go through the rounds.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commercium.llm.text import Words, mix, salt
from commercium.llm.tokens import Encoder

RATE = 0.1
#: Words of more symbols run an agenda of their own, as rounds cost the square of a word's length.
SHORT = 48
_ON_I, _ON_J, _ON_ID = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93
_MASK = 0xFFFFFFFFFFFFFFFF
_SPACE = "▁"
_LITERAL = "▁ in a text"
_NONE = np.int64(1) << 62
_loaded: dict[tuple, "PieceEncoder"] = {}


def _mixed(x: int) -> int:
    """mix() of one number."""
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & _MASK
    return x ^ x >> 31


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... of each stretch in a row."""
    ends = np.cumsum(count)
    return np.repeat(first - (ends - count), count) + np.arange(int(ends[-1]) if len(ends) else 0)


class Vocabulary:
    """Pieces of a model file: ids and scores of ordinary pieces, ids of single bytes."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.id, self.score, self.byte = {}, {}, {}
        self.bytes = []
        for k in range(model.get_piece_size()):
            piece = model.id_to_piece(k)
            if model.is_byte(k):
                self.byte[int(piece[3:5], 16)] = k
                self.bytes.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(k) or model.is_unknown(k) or model.is_unused(k):
                self.bytes.append(b"")
            else:
                self.id[piece] = k
                self.score[piece] = model.get_score(k)
                self.bytes.append(piece.replace(_SPACE, " ").encode())

    def segment(self, lead: int, word: str, rate: float, key: int) -> list[int]:
        """Ids of ``lead`` spaces and a word, by an agenda. ``key`` seeds the dropout; ``rate`` 0 is the plain encoding.

        The character that stands for a space in pieces is written as bytes where the word
        itself has it.
        """
        symbols = [_SPACE] * lead + [_LITERAL if c == _SPACE else c for c in word]
        n = len(symbols)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        score, agenda = self.score, []
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            if pair in score:
                agenda.append((-score[pair], i, pair, i + 1))
        heapq.heapify(agenda)
        limit = int(rate * (1 << 32))
        while agenda:
            _, i, pair, j = heapq.heappop(agenda)
            if not symbols[i] or not symbols[j] or symbols[i] + symbols[j] != pair or right[i] != j:
                continue
            if limit:
                merge = (i * _ON_I + j * _ON_J + self.id[pair] * _ON_ID) & _MASK
                if _mixed(key + merge & _MASK) >> 32 < limit:
                    continue
            symbols[i], symbols[j] = pair, ""
            after = right[i] = right[j]
            if after >= 0:
                left[after] = i
                new = pair + symbols[after]
                if new in score:
                    heapq.heappush(agenda, (-score[new], i, new, after))
            before = left[i]
            if before >= 0:
                new = symbols[before] + pair
                if new in score:
                    heapq.heappush(agenda, (-score[new], before, new, i))
        out = []
        for symbol in symbols:
            if symbol:
                known = self.id.get(symbol)
                if known is not None:
                    out.append(known)
                else:
                    out += [self.byte[b] for b in (_SPACE if symbol == _LITERAL else symbol).encode()]
        return out


class Merges:
    """The merges of a vocabulary over numbered symbols, run for many words side by side.

    A symbol is the id of a piece, or beyond the ids a code point that is no piece.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.size = len(vocabulary.bytes)
        self.span = self.size + 0x110001
        self.literal = self.span - 1  # the character for a space where a text itself has it
        number = dict(vocabulary.id)
        number |= {c: self.size + ord(c) for piece in vocabulary.id for c in piece if c not in number}
        ranks = {score: rank for rank, score in enumerate(sorted(set(vocabulary.score.values()), reverse=True))}
        rows = []
        for piece, made in vocabulary.id.items():
            for k in range(1, len(piece)):
                left, right = number.get(piece[:k]), number.get(piece[k:])
                if left is not None and right is not None:
                    rows.append((left * self.span + right, made, ranks[vocabulary.score[piece]]))
        table = np.array(sorted(rows), np.int64).reshape(-1, 3)
        self.pairs, self.made, self.rank = (np.ascontiguousarray(c) for c in table.T)
        self.of_char = np.arange(self.span, dtype=np.int64)[self.size :].copy()
        for symbol, k in vocabulary.id.items():
            if len(symbol) == 1:
                self.of_char[ord(symbol)] = k
        self.of_char[ord(_SPACE)] = self.literal

    def symbols(self, leads: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all words, each after its lead of spaces (0 or 1), in a row, and how many each has."""
        count = np.array([len(w) for w in words], np.int64)
        code = np.frombuffer("".join(words).encode("utf-32-le", "replace"), np.uint32)
        out = np.full(int(count.sum() + leads.sum()), self.vocabulary.id[_SPACE], np.int64)
        body = np.ones(len(out), bool)
        starts = np.cumsum(count + leads) - (count + leads)
        body[starts[leads > 0]] = False
        out[body] = self.of_char[code]
        return out, count + leads

    def ids(self, symbols: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of symbols in a row, code points that are no piece as their bytes, and how many each word has."""
        odd = np.flatnonzero(symbols >= self.size)
        if not len(odd):
            return symbols, count
        byte, spelled = self.vocabulary.byte, {}
        for s in np.unique(symbols[odd]).tolist():
            char = _SPACE if s == self.literal else chr(s - self.size)
            spelled[s] = [byte[b] for b in char.encode("utf-8", "replace")]
        width = np.ones(len(symbols), np.int64)
        width[odd] = [len(spelled[s]) for s in symbols[odd].tolist()]
        out = np.repeat(symbols, width)
        at = np.cumsum(width)[odd] - width[odd]
        out[_ranges(at, width[odd])] = [b for s in symbols[odd].tolist() for b in spelled[s]]
        ends = np.concatenate([[0], np.cumsum(width)])[np.concatenate([[0], np.cumsum(count)])]
        return out, np.diff(ends)

    def run(
        self, symbols: np.ndarray, count: np.ndarray, keys: np.ndarray | None = None, limit: int = 0
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(symbols, count, merges, merge count) of each word after all its merges.

        With a ``limit`` merges whose hash with the word's key falls below it are skipped.
        ``merges`` are the numbers of those made, in their order.
        """
        symbols, owner = symbols.copy(), np.repeat(np.arange(len(count)), count)
        place = _ranges(np.zeros(len(count), np.int64), count)
        best, made = np.full(len(symbols), _NONE), np.zeros(len(symbols), np.int64)
        done, merged = [], []

        def price(at: np.ndarray) -> None:
            """Rank and result of joining the symbol at each place with the next."""
            best[at] = _NONE
            at = at[(at >= 0) & (at + 1 < len(symbols))]
            at = at[owner[at] == owner[at + 1]]
            if not len(at) or not len(self.pairs):
                return
            pair = symbols[at] * self.span + symbols[at + 1]
            k = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            hit = self.pairs[k] == pair
            at, k = at[hit], k[hit]
            if limit:
                stays = mix(keys[owner[at]] + self._number(place[at], place[at + 1], self.made[k])) >> np.uint64(32) >= np.uint64(limit)
                at, k = at[stays], k[stays]
            best[at], made[at] = self.rank[k], self.made[k]

        price(np.arange(len(symbols)))
        while len(symbols):
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            # The smallest rank of each word, leftmost among equals.
            low = np.minimum.reduceat(best, first)
            over = np.repeat(low == _NONE, np.diff(np.append(first, len(symbols))))
            if over.any():
                done.append((owner[over], symbols[over]))
                stay = ~over
                symbols, owner, place, best, made = (x[stay] for x in (symbols, owner, place, best, made))
                continue
            same = np.flatnonzero(best == np.repeat(low, np.diff(np.append(first, len(symbols)))))
            at = same[np.concatenate([[True], owner[same][1:] != owner[same][:-1]])]
            merged.append((owner[at], self._number(place[at], place[at + 1], made[at])))
            symbols[at] = made[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, owner, place, best, made = (x[keep] for x in (symbols, owner, place, best, made))
            at = at - np.arange(len(at))  # one symbol of each word before is gone
            price(np.unique(np.concatenate([at, at[at > 0] - 1])))
        words = len(count)
        return *self._by_word(done, words, np.int64), *self._by_word(merged, words, np.uint64)

    @staticmethod
    def _number(i: np.ndarray, j: np.ndarray, made: np.ndarray) -> np.ndarray:
        i, j, made = (x.astype(np.uint64) for x in (i, j, made))
        return i * np.uint64(_ON_I) + j * np.uint64(_ON_J) + made * np.uint64(_ON_ID)

    @staticmethod
    def _by_word(parts: list[tuple[np.ndarray, np.ndarray]], words: int, kind: type) -> tuple[np.ndarray, np.ndarray]:
        owner = np.concatenate([p[0] for p in parts] or [np.zeros(0, np.int64)])
        value = np.concatenate([p[1] for p in parts] or [np.zeros(0, kind)])
        return value[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=words)


class PieceEncoder(Encoder):
    """Ids of texts under merge-dropout, drawn for every occurrence of a word.

    Known words have their symbols, plain merges and plain ids. Without ``reuse`` every
    occurrence goes through the rounds, with the same ids.
    """

    leads = (_SPACE, _SPACE, "\n")
    _words = ("checks", "first", "count", "at_symbol", "symbols_of", "at_merge", "merges_of")
    _parts = ("pool", "symbols", "merges")

    def __init__(self, path: str, rate: float, seed: int, reuse: bool = True):
        self.vocabulary = Vocabulary(path)
        self.table = Merges(self.vocabulary)
        self.rate, self.seed, self.reuse = rate, seed, reuse
        self.keep_spaces = True
        self.type = np.dtype("<u2" if len(self.vocabulary.bytes) <= 1 << 16 else "<u4")
        self._empty()

    def _empty(self) -> None:
        super()._empty()
        self.at_symbol, self.symbols_of = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.at_merge, self.merges_of = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.symbols, self.merges = np.zeros(0, np.int32), np.zeros(0, np.uint64)

    def _learned(self, words: list[str]) -> dict[str, np.ndarray]:
        leads = np.array([w[0] == _SPACE for w in words], np.int64)
        bodies = [w[1:] if lead else w for w, lead in zip(words, leads.tolist(), strict=True)]
        symbols, many = self.table.symbols(leads, bodies)
        short = many <= SHORT
        symbols, many = symbols[np.repeat(short, many)], np.where(short, many, 0)
        made, count, merges, merged = self.table.run(symbols, many)
        ids, count = self.table.ids(made, count)
        if not short.all():
            long = [self.vocabulary.segment(int(leads[k]), bodies[k], 0.0, 0) for k in np.flatnonzero(~short).tolist()]
            places = np.cumsum(count) - count
            ids = np.insert(ids, np.repeat(places[~short], [len(x) for x in long]), [i for x in long for i in x])
            count[~short] = [len(x) for x in long]
        return {
            "first": np.cumsum(count) - count + len(self.pool),
            "count": count,
            "pool": ids,
            "at_symbol": np.cumsum(many) - many + len(self.symbols),
            "symbols_of": many,
            "symbols": symbols,
            "at_merge": np.cumsum(merged) - merged + len(self.merges),
            "merges_of": merged,
            "merges": merges,
        }

    def _spell(
        self, entry: np.ndarray, count: np.ndarray, words: Words, form: np.ndarray, texts: np.ndarray | None
    ) -> tuple[np.ndarray, np.ndarray]:
        limit = int(self.rate * (1 << 32))
        if not limit or not len(entry):
            return super()._spell(entry, count, words, form, texts)
        at = np.flatnonzero(count)
        word = entry[at]
        place = np.arange(len(entry)) - np.repeat(words.bounds[:-1], words.count)
        keys = np.zeros(len(words.count), np.uint64) if texts is None else texts
        key = self._keys(np.repeat(keys, words.count)[at], place[at])
        long, many = self.symbols_of[word] == 0, self.merges_of[word]
        draw = mix(np.repeat(key, many) + self.merges[_ranges(self.at_merge[word], many)]) >> np.uint64(32)
        again = ~long
        if self.reuse:  # only where a plain merge is skipped
            again = np.bincount(np.repeat(np.arange(len(at)), many)[draw < np.uint64(limit)], minlength=len(at)) > 0
        pool, first, size = [self.pool], self.first[word], self.count[word].copy()
        held = len(self.pool)
        redo = np.flatnonzero(again)
        symbols = self.symbols[_ranges(self.at_symbol[word[redo]], self.symbols_of[word[redo]])].astype(np.int64)
        made, left, _, _ = self.table.run(symbols, self.symbols_of[word[redo]], key[redo], limit)
        ids, left = self.table.ids(made, left)
        first[redo], size[redo] = held + np.cumsum(left) - left, left
        pool.append(ids.astype(self.type))
        held += len(ids)
        for k in np.flatnonzero(long).tolist():
            body = words.data[words.start[at[k]] : words.end[at[k]]].tobytes().decode("utf-8", "replace")
            lead, body = (0, "\n" + body) if form[at[k]] == 2 else (1, body)
            own = self.vocabulary.segment(lead, body, self.rate, int(key[k]))
            first[k], size[k] = held, len(own)
            pool.append(np.array(own, self.type))
            held += len(own)
        out = np.zeros(len(count), np.int64)
        out[at] = size
        return np.concatenate(pool)[_ranges(first, size)], out

    def _keys(self, keys: np.ndarray, places: np.ndarray) -> np.ndarray:
        """A number for each occurrence, from its text's key, the seed and its place."""
        return mix(mix(keys + salt(self.seed + 1)) + places.astype(np.uint64))

    def _whole(self, text: str, keys: np.ndarray | None, k: int) -> list[int]:
        # No piece holds a space after another character, so each run of spaces begins a part.
        parts = [(len(lead), word) for lead, word in re.findall("( *)([^ ]*)", " " + text) if lead] if text else []
        own = np.full(len(parts), 0 if keys is None else keys[k], np.uint64)
        drawn = self._keys(own, np.arange(len(parts))).tolist()
        segment, rate = self.vocabulary.segment, self.rate
        return [i for (lead, word), key in zip(parts, drawn, strict=True) for i in segment(lead, word, rate, key)]

    def whole(self, text: str) -> list[int]:
        return self._whole(text, None, 0)


class Decoder:
    """Texts from ids: the bytes of their pieces in a row, without the space put in front."""

    def __init__(self, vocabulary: Vocabulary):
        self.body = np.frombuffer(b"".join(vocabulary.bytes), np.uint8)
        self.count = np.array([len(b) for b in vocabulary.bytes], np.int64)
        self.first = np.cumsum(self.count) - self.count

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        count = self.count[ids]
        ends = np.cumsum(count)
        source = np.repeat(self.first[ids] - (ends - count), count)
        body = self.body[source + np.arange(len(source))].tobytes()
        places = np.concatenate([[0], ends])[bounds].tolist()
        return [body[a + 1 : b] for a, b in zip(places, places[1:], strict=False)]


def piece_encoder(path: str, rate: float, seed: int) -> PieceEncoder:
    """The encoder of a file and its settings, kept for the life of a worker."""
    key = (path, rate, seed)
    if key not in _loaded:
        _loaded[key] = PieceEncoder(*key)
    return _loaded[key]


def encode_documents(docs: DataFrame, model: str, rate: float = RATE, seed: int = 0) -> DataFrame:
    """doc_id and ids (array of int) of each text; NULL and empty texts have none."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = piece_encoder(model, rate, seed)
        for batch in batches:
            keys = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            for first, ids, bounds in own.encode(batch.column(2), keys):
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(bounds) - 1),
                        pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32))),
                    ],
                    names=["doc_id", "ids"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", F.xxhash64(F.col("doc_id").cast("string"), F.lit(seed)), "text")
    return keyed.mapInArrow(encode, f"doc_id {kind}, ids array<int>")


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and text of each row of ids, by the bytes of their pieces."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(piece_encoder(model, 0.0, 0).vocabulary)
        for batch in batches:
            lists = batch.column(1)
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            bounds = np.concatenate([[0], np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy())])
            texts = [t.decode("utf-8", "replace") for t in decoder.decode(ids, bounds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(decode, f"doc_id {kind}, text string")


def piece_digests(docs: DataFrame, model: str, rate: float = RATE, seed: int = 0) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): n_tokens, ids_crc32, lossless.

    Every whole text is encoded under dropout and decoded again; ``lossless`` says
    whether the bytes came back. ids_crc32 is over little-endian unsigned 32-bit ids.
    NULL and empty texts have no ids. Equal seeds give equal ids on any cluster.
    Repeated rows are encoded alike; a NULL doc_id is a key like any other; further
    columns are ignored; an empty table gives no rows.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = piece_encoder(model, rate, seed)
        decoder = Decoder(own.vocabulary)
        for batch in batches:
            keys = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            texts = pa.compute.fill_null(batch.column(2), "").cast(pa.binary()).to_pylist()
            for first, ids, bounds in own.encode(batch.column(2), keys):
                back = decoder.decode(ids, bounds)
                ids = ids.astype("<u4")
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(back)),
                        pa.array(np.diff(bounds)),
                        pa.array([zlib.crc32(ids[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.int64()),
                        pa.array([x == y for x, y in zip(back, texts[first:], strict=False)]),
                    ],
                    names=["doc_id", "n_tokens", "ids_crc32", "lossless"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", F.xxhash64(F.col("doc_id").cast("string"), F.lit(seed)), "text")
    return keyed.mapInArrow(digest, f"doc_id {kind}, n_tokens long, ids_crc32 long, lossless boolean")
