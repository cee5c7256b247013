"""Token ids of whole texts by a public tokenizer file, with a cache of the pieces that its pre-tokenizer never joins.

A piece is encoded once and then looked up, which is exact as long as the piece's borders are borders for the
pre-tokenizer too. Both kinds of file split there:

* "words" (word-level BPE that drops white space): at any ASCII white space;
* "bytes" (byte-level BPE that keeps white space): before a single space, and around other runs of white space. Texts
  with white space outside ASCII are encoded whole. In texts whose white space is single spaces and line ends between
  words, a piece is written without its space: it begins with a line end, or with NUL at the text's begin, or else has one.

Texts that may hold a special token (they contain "<|") are encoded whole as well.
"""

from __future__ import annotations

import os
import re
from array import array
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tessera.llm.hashes import column_hashes, word_hashes

END_ID = 1
_WORD = re.compile(r"\w+")
_SPACED = re.compile(r" ?[^ \t-\r]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+")
_WIDE_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


#: A piece of one letter run (after a line end or the text's begin, or else a space) with other ASCII signs behind it. Letters
#: of Latin-1 are in composed form already and have one lower-case form, so the library's normalizer does to them what
#: lower-casing does.
_LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
_SIGNS = r"!-/:-@\[-`{-~"
_PLAIN = rf"\A(?P<mark>[\x00\n]?)(?P<letters>[{_LETTERS}]+)(?P<tail>[{_SIGNS}]*)\z"
_PLAIN_WORD = _PLAIN.replace(r"[\x00\n]?", "")
#: Pieces whose ids are gathered at once.
_AT_ONCE = 1 << 16


def _byte_letters() -> dict[int, int]:
    """The letters that byte-level files write for bytes: printable ones as they are, the others from 256 on, in order."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in kept]
    return {b: 256 + i for i, b in enumerate(others)}


_BYTE_LETTERS = _byte_letters()
_ID = attrgetter("id")
#: A space and the letters of Latin-1, as such files write their bytes.
_SPELLING = {c: "".join(chr(_BYTE_LETTERS.get(b, b)) for b in chr(c).encode()) for c in (32, *range(0xC0, 0x100))}


def terms_of_all(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The 32-bit hashes of the texts' words, folded, whatever stands between them, end to end, and how many are each text's."""
    found = [_WORD.findall(t.casefold()) for t in texts]
    return _short(word_hashes([w.encode(errors="surrogatepass") for x in found for w in x])), np.fromiter(map(len, found), np.int64, len(found))


def terms_of(text: str) -> np.ndarray:
    """One text's."""
    return terms_of_all([text])[0]


def _short(hashed: np.ndarray) -> np.ndarray:
    return (hashed >> np.uint64(32)).astype(np.uint32).view(np.int32)


#: White space that the short writing of pieces can't tell apart.
_UNEVEN = ("  ", "\n ", " \n", "\n\n", "\t", "\r", "\x0b", "\x0c", "\0")


def ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each range, one range after the other."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if total < 1 << 30 and (not total or int(begin.max()) < 1 << 30) else np.int64
    out = np.repeat((begin - (ends - size)).astype(kind), size)
    out += np.arange(total, dtype=kind)
    return out


class Store:
    """A growing array of numbers, in a buffer that doubles."""

    def __init__(self, kind) -> None:
        self.buffer, self.n = np.zeros(1024, kind), 0

    @property
    def values(self) -> np.ndarray:
        return self.buffer[: self.n]

    def before(self, *more: np.ndarray) -> np.ndarray:
        """The numbers with others behind them, which don't stay."""
        upto = self.n
        for x in more:
            if upto + len(x) > len(self.buffer):
                self.buffer = np.concatenate([self.buffer[:upto], np.zeros(max(upto, len(x)) + len(x), self.buffer.dtype)])
            self.buffer[upto : upto + len(x)] = x
            upto += len(x)
        return self.buffer[:upto]

    def add(self, values: np.ndarray) -> None:
        self.n = len(self.before(values))

    def become(self, values: np.ndarray) -> None:
        self.buffer, self.n = values.copy(), len(values)


class Columns:
    """Runs of numbers, by place, held as columns and not as objects: end to end in one array."""

    def __init__(self, kind) -> None:
        self.numbers, self._begin, self._size = Store(kind), Store(np.int64), Store(np.int64)

    values = property(lambda self: self.numbers.values)
    begin = property(lambda self: self._begin.values)
    size = property(lambda self: self._size.values)

    def add(self, values: np.ndarray, size: np.ndarray) -> None:
        self._begin.add(self.numbers.n + np.cumsum(size) - size)
        self.numbers.add(values)
        self._size.add(size)

    def keep(self, places: np.ndarray) -> None:
        size = self.size[places]
        self.numbers.become(self.values[ranges(self.begin[places], size)])
        self._begin.become(np.cumsum(size) - size)
        self._size.become(size)


class Known:
    """Texts and the places of their numbers in some columns. Their 64-bit hashes are kept in order, so what a look-up costs
    follows what is looked up; texts are compared where hashes meet."""

    def __init__(self, *columns: Columns) -> None:
        self.keys, self.columns = pa.array([], pa.large_string()), columns
        self.hashes, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def places(self, keys: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """The places of different keys, and those of them that have no numbers yet. These come behind the others, in order."""
        hashed = column_hashes(keys)
        order = np.argsort(hashed)
        below = np.empty(len(keys), np.int64)
        below[order] = np.searchsorted(self.hashes, hashed[order])
        met = np.flatnonzero(below < len(self.hashes))
        met = met[self.hashes[below[met]] == hashed[met]]
        found = np.full(len(keys), -1, np.int64)
        there = self.at[below[met]]
        same = pc.equal(self.keys.take(pa.array(there)), keys.take(pa.array(met))).to_numpy(zero_copy_only=False)
        found[met[same]] = there[same]
        lacking = order[found[order] < 0]
        new = np.sort(lacking)
        fresh = keys.take(pa.array(new))
        found[new] = len(self.keys) + np.arange(len(new))
        self.hashes, self.at = np.insert(self.hashes, below[lacking], hashed[lacking]), np.insert(self.at, below[lacking], found[lacking])
        self.keys = pa.concat_arrays([self.keys, fresh])
        return found, fresh

    def bound(self, room: int, places: np.ndarray) -> None:
        """If there are more than room, only places stay."""
        if len(self.keys) > room:
            self.keys = self.keys.take(pa.array(places))
            hashed = column_hashes(self.keys)
            self.at = np.argsort(hashed)
            self.hashes = hashed[self.at]
            for c in self.columns:
                c.keep(places)


def _joined(found: list[bytes], kind) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(found), kind), np.fromiter(map(len, found), np.int64, len(found)) // np.dtype(kind).itemsize


def _merged(first: np.ndarray, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Runs of numbers (end to end, sizes) from a where `first` is true and from b elsewhere, each in order."""
    place = np.argsort(np.argsort(~first, kind="stable"), kind="stable")
    size = np.concatenate([a[1], b[1]])
    begin = np.cumsum(size) - size
    return np.concatenate([a[0], b[0]])[ranges(begin[place], size[place])], size[place]


class CachedTokenizer:
    """One for each Python worker. It remembers up to `room` pieces besides those of the last call; when there are more it keeps
    the last call's, so what is frequent stays."""

    def __init__(self, path: str, kind: str, room: int = 1_000_000, with_terms: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.kind, self.room, self.with_terms = kind, room, with_terms
        self.ids, self.terms, self.run_ids = Columns(np.uint32), Columns(np.int32), Columns(np.uint32)
        self.pieces, self.runs = Known(self.ids, self.terms), Known(self.run_ids)

    def split(self, text: str) -> str | list[str] | None:
        """A text that is cut at single spaces ("words": at white space), or its pieces, or None: encode it whole."""
        if "<|" in text:
            return None
        if self.kind == "words":
            return text
        if _WIDE_SPACE.search(text):
            return None
        if any(x in text for x in _UNEVEN) or text[:1] == " " or text[-1:] == " ":
            return [p[1:] if p[0] == " " and len(p) > 1 and p[1] > " " else "\0" + p for p in _SPACED.findall(text)] if "\0" not in text else None
        return "\0" + text.replace("\n", " \n")

    def _spelled(self, piece: str) -> str:
        """The piece of the text that split() wrote."""
        if self.kind == "words":
            return piece
        return piece[1:] if piece[:1] == "\0" else piece if piece[:1] == "\n" else " " + piece

    def _runs(self, fresh: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of letter runs, by the library's model: each is a single pre-token."""
        ids, sizes, model, space = array("I"), array("q"), self.model.tokenize, _SPELLING[32]
        for letters in fresh:
            found = model(letters.replace(" ", space) if letters.isascii() else letters.translate(_SPELLING))
            ids.extend(map(_ID, found))
            sizes.append(len(found))
        return np.frombuffer(ids, np.uint32), np.frombuffer(sizes, np.int64)

    def _whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return _joined([array("I", x.ids).tobytes() for x in self.library.encode_batch_fast(texts, add_special_tokens=False)], np.uint32)

    def _plain_ids(self, mark: pa.Array, letters: pa.Array, tail: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces that are a mark, one letter run, and signs: those three one after the other."""
        if self.kind == "words":
            letters = pc.utf8_lower(letters)
        else:
            letters = pc.if_else(pc.equal(mark, ""), pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), letters, pa.scalar("", pa.large_string())), letters)
        named, signs = letters.dictionary_encode(), tail.dictionary_encode()
        at, fresh = self.runs.places(named.dictionary)
        self.run_ids.add(*self._runs(fresh.to_pylist()))
        sign_ids, sign_size = self._batch(signs.dictionary.to_pylist())
        line = np.frombuffer(self._whole("\n"), np.uint32)
        # Three ranges a piece in one array of runs, line ends and signs.
        every, known = self.run_ids.numbers.before(line, sign_ids), self.run_ids.numbers.n
        run, sign = at[named.indices.to_numpy()], signs.indices.to_numpy()
        has_line = pc.equal(mark, "\n").to_numpy(zero_copy_only=False)
        sign_begin = known + len(line) + np.cumsum(sign_size) - sign_size
        begin = np.stack([np.full(len(run), known, np.int64), self.run_ids.begin[run], sign_begin[sign]], 1)
        size = np.stack([np.where(has_line, len(line), 0), self.run_ids.size[run], sign_size[sign]], 1)
        ids = every[ranges(begin.ravel(), size.ravel())]
        self.runs.bound(self.room, at)
        return ids, size.sum(axis=1)

    def _learn(self, fresh: pa.Array) -> None:
        """Adds the ids of pieces, in order, and their terms."""
        found = pc.extract_regex(fresh, _PLAIN_WORD if self.kind == "words" else _PLAIN)
        plain = found.is_valid()
        mark, letters, tail = (pc.struct_field(found.filter(plain), k) for k in ("mark", "letters", "tail"))
        others = [self._spelled(p) for p in fresh.filter(pc.invert(plain)).to_pylist()]
        plain = plain.to_numpy(zero_copy_only=False)
        self.ids.add(*_merged(plain, self._plain_ids(mark, letters, tail), self._batch(others)))
        if not self.with_terms:
            self.terms.add(np.zeros(0, np.int32), np.zeros(len(fresh), np.int64))
            return
        # A letter run is one word, but for underscores behind it; all but one of its letters fold to one letter.
        more = pc.or_(pc.match_substring(tail, "_"), pc.match_substring(letters, "\xdf"))
        one = _short(column_hashes(pc.utf8_lower(letters.filter(pc.invert(more)))))
        less = terms_of_all([a + b for a, b in zip(letters.filter(more).to_pylist(), tail.filter(more).to_pylist())])
        of_plain = _merged(~more.to_numpy(zero_copy_only=False), (one, np.ones(len(one), np.int64)), less)
        self.terms.add(*_merged(plain, of_plain, terms_of_all(others)))

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray | None]]:
        """Each text's ids, and its terms."""
        ids, lengths, terms, counts = self.encode_all(texts)
        cut = lambda x, n: np.split(x, np.cumsum(n)[:-1]) if len(n) else []
        return list(zip(cut(ids, lengths), cut(terms, counts) if self.with_terms else [None] * len(lengths)))

    def encode_all(self, texts: list[str], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None]:
        """ids of all texts one after the other (uint32; each with end_id behind it) and how many are each text's; the texts'
        terms likewise, with_terms. A piece is looked up once, however often the texts hold it, and columns do the rest."""
        split = [self.split(t) for t in texts]
        even = [i for i, x in enumerate(split) if isinstance(x, str)]
        odd = [i for i, x in enumerate(split) if isinstance(x, list)]
        whole = [i for i, x in enumerate(split) if x is None]
        cut = pc.ascii_split_whitespace if self.kind == "words" else lambda x: pc.split_pattern(x, " ")
        lists = cut(pa.array([split[i] for i in even], pa.large_string()))
        pieces_of = [pc.list_value_length(lists).to_numpy(zero_copy_only=False), np.array([len(split[i]) for i in odd], np.int64), np.ones(len(whole), np.int64)]
        pieces_of = np.concatenate(pieces_of).astype(np.int64)
        named = pa.concat_arrays([lists.flatten(), pa.array([p for i in odd for p in split[i]], pa.large_string())]).dictionary_encode()
        pieces, index = named.dictionary, named.indices.to_numpy()
        del split, lists, named
        order = np.argsort(np.array(even + odd + whole, np.int64), kind="stable")

        def spread(store: Columns, places: np.ndarray, of_whole: tuple[np.ndarray, np.ndarray], end: int | None) -> tuple[np.ndarray, np.ndarray]:
            """The numbers of all texts: those of the store, then of texts encoded whole, then the end, as ranges of one array."""
            own, own_size = of_whole
            every = store.numbers.before(own, np.array([] if end is None else [end], own.dtype))
            begin = np.concatenate([store.begin[places], store.numbers.n + np.cumsum(own_size) - own_size, [len(every) - 1]])
            size = np.concatenate([store.size[places], own_size, [1]])
            at = np.concatenate([index, len(places) + np.arange(len(whole), dtype=index.dtype)])
            upto = np.cumsum(pieces_of)
            if end is not None:
                at, upto = np.insert(at, upto, len(begin) - 1), upto + np.arange(1, len(upto) + 1)
            out = np.concatenate([every[ranges(begin[x], size[x])] for x in np.array_split(at, len(at) // _AT_ONCE + 1)])
            text_ends = np.concatenate([[0], np.cumsum(size[at])])[upto]
            lengths = np.diff(np.concatenate([[0], text_ends]))
            if odd or whole:  # back into the order of the texts
                begins = text_ends - lengths
                out, lengths = out[ranges(begins[order], lengths[order])], lengths[order]
            return out, lengths

        places, fresh = self.pieces.places(pieces)
        self._learn(fresh)
        ids, lengths = spread(self.ids, places, _joined([self._whole(texts[i]) for i in whole], np.uint32), end_id)
        terms, counts = spread(self.terms, places, terms_of_all([texts[i] for i in whole]), None) if self.with_terms else (None, None)
        self.pieces.bound(self.room, places)
        pa.default_memory_pool().release_unused()
        return ids, lengths, terms, counts


_tokenizers: dict[tuple, CachedTokenizer] = {}


def tokenizer(*made_of) -> CachedTokenizer:
    """The worker's tokenizer for a file, made at first use."""
    if made_of not in _tokenizers:
        _tokenizers[made_of] = CachedTokenizer(*made_of)
    return _tokenizers[made_of]


def groups(batch, text_column: int, chars: int = 8_000_000):
    """Slices of a batch, each with texts of about `chars` characters at most, but a row at least."""
    at = size = 0
    texts: list[str] = []
    for t in batch.column(text_column):
        texts.append(t.as_py() or "")
        size += len(texts[-1])
        if size >= chars:
            yield batch.slice(at, len(texts)), texts
            at, size, texts = at + len(texts), 0, []
    if texts:
        yield batch.slice(at), texts
