"""Token ids of whole texts by a public tokenizer: each different pre-token of a batch is encoded once, then ids are gathered."""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex

END_ID = 0
#: Bytes of the pre-tokens that are encoded in one call; pre-tokens that a worker remembers at most (some 50 bytes each), and the
#: bytes of the longest that are kept. None changes a result.
CHUNK, WORDS, KEPT = 4_000, 400_000, 64

#: Kinds of characters in the pattern of byte-level pre-tokens, and the alphabet of byte-level BPE vocabularies.
LETTER, NUMBER, SPACE = 1, 2, 3
PRINTED = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]

_shared: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this worker, loaded once."""
    if path not in _shared:
        _shared[path] = Encoder(path)
    return _shared[path]


def default_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def _kinds() -> np.ndarray:
    """The kind of every code point; 0 for what is neither letter, number nor white space."""
    at = np.delete(np.arange(0x110000, dtype="<u4"), slice(0xD800, 0xE000))
    text = at.tobytes().decode("utf-32-le")
    kinds = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for run in regex.finditer(pattern, text):
            kinds[at[run.start() : run.end()]] = kind
    return kinds


class Encoder:
    """Same ids as ``Tokenizer.encode(text, add_special_tokens=False)``.

    The pre-tokens of byte-level tokenizers are found for all texts of a batch at once. They recur, so each different one of a batch
    is encoded once, many in one call, and the frequent ones are remembered. Texts with added tokens, and those of other kinds of
    tokenizer, are encoded as a whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        kind = repr(self.tokenizer.pre_tokenizer)
        self.cuts = kind.startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in kind and self.tokenizer.normalizer is None
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = "|".join(added)
        self.kept = pa.array([], pa.string())
        self.flat, self.sizes, self.uses = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if self.cuts:
            self._learn_alphabet()

    def _learn_alphabet(self) -> None:
        spare = iter(range(256, 512))
        self.alphabet = np.array([b if b in PRINTED else next(spare) for b in range(256)], "<u4")
        self.kinds = _kinds()
        blank, line = (chr(self.alphabet[ord(c)]) for c in " \n")
        vocabulary = self.tokenizer.get_vocab()
        self.blank = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.blank[[number for token, number in vocabulary.items() if token.startswith(blank)]] = True
        self.line = vocabulary.get(line, -1)
        byte = {chr(char): b for b, char in enumerate(self.alphabet.tolist())}
        over = [token for token in vocabulary if (line in token or blank in token[1:]) and all(char in byte for char in token)]
        #: No merge goes from a word to a blank or a line end, or from a line end to a word.
        self.apart = self.line >= 0 and all(bytes(byte[char] for char in token).decode(errors="replace").isspace() for token in over)

    def _starts(self, points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """Where pre-tokens begin in the code points of texts, which begin at ``firsts``.

        The pattern takes runs of one kind. The last character of white space before something else is cut off; a blank goes with what
        follows. A lone quote that no blank precedes takes the ends of English contractions with it."""
        n = len(points)
        kinds = self.kinds[points]
        opens = np.zeros(n + 1, bool)
        opens[firsts] = opens[n] = True
        begins = opens.copy()
        begins[1:n] |= kinds[1:] != kinds[:-1]
        runs = np.flatnonzero(begins)
        starts, ends = runs[:-1], runs[1:]
        kind, followed = kinds[starts], ~opens[ends]
        space = ends[(kind == SPACE) & followed]
        begins[space - 1] = True
        begins[space[points[space - 1] == ord(" ")]] = False
        quote = starts[(points[starts] == ord("'")) & (ends - starts == 1) & followed]
        quote = quote[begins[quote]]
        one = quote[np.isin(points[quote + 1], [ord(c) for c in "stmd"])]
        more = quote[quote + 2 < n]
        more = more[~opens[more + 2]]
        pairs = points[more + 1].astype(np.int64) * 128 + points[more + 2]
        two = more[np.isin(pairs, [ord(a) * 128 + ord(b) for a, b in ("re", "ve", "ll")]) & (points[more + 2] < 128)]
        for found, length in ((one, 2), (two, 3)):
            begins[found + 1] = False
            begins[found + length] = True
        return np.flatnonzero(begins[:n])

    def _pre_tokens(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """All pre-tokens of texts, one after the other, and how many each text has."""
        data, cuts = _bytes(texts)
        if not len(data):
            return pa.array([], pa.string()), np.zeros(len(texts), np.int64)
        text = str(data, "utf-8")
        if len(text) == len(data):
            places = self._starts(np.frombuffer(data, np.uint8), cuts[:-1][cuts[:-1] < len(data)])
        else:
            points = np.frombuffer(text.encode("utf-32-le"), "<u4")
            at = np.flatnonzero(np.frombuffer(data, np.int8) >= -64)
            places = at[self._starts(points, np.searchsorted(at, cuts[:-1][cuts[:-1] < len(data)]))]
        many = np.diff(np.searchsorted(places, cuts))
        offsets = pa.py_buffer(np.append(places, len(data)).astype(np.int32))
        return pa.StringArray.from_buffers(len(places), offsets, pa.py_buffer(data)), many

    def _called(self, words: pa.Array) -> np.ndarray:
        """Ids of words that are written one after the other."""
        found = array("I")
        data, cuts = _bytes(words)
        chars = self.alphabet[np.frombuffer(data, np.uint8)]
        firsts = np.flatnonzero(np.diff(cuts[:-1] // CHUNK, prepend=-1))
        for first, last in zip(cuts[firsts].tolist(), [*cuts[firsts[1:]].tolist(), len(data)], strict=False):
            found.extend([t.id for t in self.model.tokenize(chars[first:last].tobytes().decode("utf-32-le"))])
        return np.array(found, "<u4")

    def _encoded(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different pre-tokens, and how many each has.

        Many are encoded in one call: words after a blank begin at each id whose token begins with one, others get a line end behind."""
        blank, white = (x.to_numpy(zero_copy_only=False) for x in (pc.starts_with(words, " "), pc.utf8_is_space(words)))
        group = np.where(white | (not self.apart), 2, np.where(blank, 0, 1))
        parts = [np.flatnonzero(group == k) for k in range(3)]
        spaced, bare, rest = (words.take(pa.array(part)) for part in parts)
        flat = self._called(spaced)
        sizes = np.diff(np.flatnonzero(np.append(self.blank[flat], True)))
        lined = self._called(pc.binary_join_element_wise(bare, "", "\n"))
        marks = np.flatnonzero(lined == self.line)
        each = [self._called(rest.slice(i, 1)) for i in range(len(rest))]
        flat = np.concatenate([flat, lined[lined != self.line], *each])
        sizes = np.concatenate([sizes, np.diff(marks, prepend=-1) - 1, np.array([len(ids) for ids in each], np.int64)])
        order = np.empty(len(words), np.int64)
        order[np.concatenate(parts)] = np.arange(len(words))
        return _gathered(flat, sizes, order)

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, each with the id that ends a document, and how many each text has."""
        odd = np.full(len(texts), not self.cuts)
        if self.cuts and self.added:
            odd = pc.match_substring_regex(texts, self.added).to_numpy(zero_copy_only=False)
        pieces, pieces_of = self._pre_tokens(texts.filter(pa.array(~odd)) if odd.any() else texts)
        coded = pieces.dictionary_encode()
        words, index = coded.dictionary, coded.indices.to_numpy()
        held = pc.fill_null(pc.index_in(words, value_set=self.kept), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(held < 0)
        missing = words.take(pa.array(new))
        flat, sizes = self._encoded(missing) if len(missing) else (np.zeros(0, "<u4"), np.zeros(0, np.int64))
        whole = [self.tokenizer.encode(text, add_special_tokens=False).ids for text in texts.filter(pa.array(odd)).to_pylist()]
        # Entries: what is remembered, the new pre-tokens, the texts that are encoded as a whole, the end.
        n = len(self.sizes)
        held[new] = n + np.arange(len(new))
        rest = [*whole, [END_ID]]
        all_ids = np.concatenate([self.flat, flat, *[np.array(ids, "<u4") for ids in rest]])
        all_sizes = np.concatenate([self.sizes, sizes, [len(ids) for ids in rest]])
        many = np.ones(len(texts), np.int64)
        many[~odd] = pieces_of
        ends = np.cumsum(many + 1)
        order = np.full(int(ends[-1]) if len(ends) else 0, len(all_sizes) - 1)
        inner = np.ones(len(order), bool)
        inner[ends - 1] = False
        cut = np.repeat(~odd, many)
        inner = np.flatnonzero(inner)
        order[inner[cut]] = held[index]
        order[inner[~cut]] = n + len(new) + np.arange(len(whole))
        self.uses[held[held < n]] += 1
        self._remember(missing, flat, sizes)
        found, taken = _gathered(all_ids, all_sizes, order)
        return found, np.diff(np.append(0, np.cumsum(taken)[ends - 1]))

    def _remember(self, words: pa.Array, flat: np.ndarray, sizes: np.ndarray) -> None:
        """Keep the ids of new pre-tokens; when they are too many, those that no batch has met again are forgotten."""
        short = np.flatnonzero(pc.binary_length(words).to_numpy(zero_copy_only=False) <= KEPT)
        if len(self.kept) + len(short) > WORDS:
            used = np.flatnonzero(self.uses)[: WORDS // 2]
            self.kept, self.uses = self.kept.take(pa.array(used)), self.uses[used] // 2
            self.flat, self.sizes = _gathered(self.flat, self.sizes, used)
        short = short[: WORDS - len(self.kept)]
        ids, many = _gathered(flat, sizes, short)
        self.kept = pa.concat_arrays([self.kept, words.take(pa.array(short))])
        self.uses = np.append(self.uses, np.zeros(len(short), np.int64))
        self.flat, self.sizes = np.concatenate([self.flat, ids]), np.concatenate([self.sizes, many])

    def ids(self, text: str, end: bool = True) -> np.ndarray:
        """Ids of ``text`` as unsigned 32-bit integers, with the id that ends a document."""
        found = self.batch(pa.array([text], pa.string()))[0]
        return found if end else found[:-1]


def _bytes(texts: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The bytes of texts without nulls, and where each begins, with the end."""
    if not len(texts):
        return memoryview(b""), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(texts.type)
    cuts = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return memoryview(texts.buffers()[2] or b"")[cuts[0] : cuts[-1]], cuts - cuts[0]


def _gathered(flat: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of entries in ``order``, and how many each has."""
    taken = sizes[order]
    upto = np.cumsum(taken)
    places = np.arange(int(upto[-1]) if len(upto) else 0) + np.repeat((np.cumsum(sizes) - sizes)[order] - upto + taken, taken)
    return flat[places], taken
