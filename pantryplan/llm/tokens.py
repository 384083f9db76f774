"""Exact BPE encoding by tree concatenation.

A text longer than a leaf is cut into leaves, wherever that falls. Leaves are encoded by
themselves and joined two by two: each join is mended by re-encoding a window around
it, which grows until its outermost tokens equal those of both sides. Windows start and
end where white space begins behind another character; no token and no piece of a
pre-tokenizer that keeps spaces crosses such a place, and none looks back across it, so
what stands outside a window is not changed by the join. Special tokens are cut out
first, as the library does.

A stretch without white space that is longer than a leaf is one node of that tree and goes
through a tree of its own by tokens: adjacent tokens of a BPE encoding are compatible pair
by pair, and a sequence all of whose adjacent pairs are compatible is the encoding, so
agreement at both ends of the window proves the joined sequence.

Leaves and windows of well-known letters may be encoded by a faster library that has
been given the same merges (``fast``), any others by the tokenizers library.
"""

from __future__ import annotations

import functools
import itertools
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pantryplan.llm.common import release_memory

#: White space of the tokenizers' patterns; Python's \s also has 1C-1F.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _gather(values: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs numbered ``at`` of adjacent runs of these sizes, one after another, and their sizes."""
    size = sizes[at]
    starts, ends = (np.cumsum(sizes) - sizes)[at], np.cumsum(size)
    return values[np.repeat(starts - (ends - size), size) + np.arange(size.sum())], size


class PieceEncoder:
    """Encodes texts as the library's ``encode(text, add_special_tokens=False)``."""

    def __init__(self, path: str, leaf_chars: int = 2048, cache_pieces: int = 100_000, fast: bool = True):
        from tokenizers import Tokenizer

        self.path, self.tok = path, Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        spec = json.loads(self.tok.to_str())
        pre = json.dumps(spec["pre_tokenizer"])
        self.keeps_space = '"Split"' not in pre
        self.tree = self.keeps_space and spec["normalizer"] is None
        self.split = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+" if self.keeps_space else f"[^{_SPACE}]+").findall
        self.leaf_chars, self.cache_pieces = leaf_chars, cache_pieces
        self.cache: dict[str, bytes] = {}
        #: Units by number, and their ids one after another.
        self.known, self.known_ids, self.known_sizes = {"\n": 0}, np.zeros(0, "<u4"), np.zeros(1, np.int64)
        #: Joins mended so far: of whole texts, and of pieces without a space.
        self.joins, self.piece_joins = 0, 0
        #: Where white space begins behind another character.
        self.safe = re.compile(f"(?<=[^{_SPACE}])[{_SPACE}]").search
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

        self.units = None
        mark = spec["model"].get("end_of_word_suffix")
        if not self.keeps_space and mark:
            #: Whether a token ends what the pre-tokenizer made.
            self.ends = np.zeros(max(spec["model"]["vocab"].values()) + 1 + len(self.special), bool)
            self.ends[[i for t, i in spec["model"]["vocab"].items() if t.endswith(mark)]] = True
            # of well-known letters: what the pre-tokenizer makes of lower-case text, each encoded by itself
            self.odd = re.compile(r"[^\t\n\r -~\xa0-\xac\xae-\xff]").search
            letter, digit = r"a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe"
            pattern = rf"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{digit}]|[^\s{letter}{digit}]+"
            self.units, self.units_lines = re.compile(pattern).findall, re.compile(rf"{pattern}|\n").findall
        self.merger = self._merger(spec) if fast else None

    def _merger(self, spec: dict):
        """The same merges in a faster library, for texts of well-known letters; None if they can't be ranked so.

        Ids of the vocabulary must follow the order of merges. Where words have an
        end mark, a byte 0 stands for it, which such texts don't have.
        """
        import tiktoken

        vocab, mark = spec["model"]["vocab"], spec["model"].get("end_of_word_suffix") or ""
        merged = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in spec["model"]["merges"]]
        if any(b <= a for a, b in zip(merged, merged[1:])):
            return None
        chars, special = _byte_chars(), self.special
        order = sorted((i, t) for t, i in vocab.items() if t not in special)
        if self.keeps_space:
            self.odd = re.compile(r"[^\t\n\r -~\xa0-\xac\xae-\u0220\u0391-\u03a1\u03a3-\u03ce\u0410-\u044f\u2010-\u2027\u3041-\u3094\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]").search
            ranks, pattern = {bytes(chars[c] for c in t): i for i, t in order}, r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        elif mark:
            ranks, to_id = {b"\0": 0} | {bytes([b]): b for b in range(1, 256)}, {chars[t]: i for i, t in order if len(t) == 1}
            for i, t in order:
                if t.endswith(mark) or len(t) > 1:
                    token = bytes(chars[c] for c in t.removesuffix(mark)) + b"\0" * t.endswith(mark)
                    to_id[len(ranks)] = i
                    ranks[token] = len(ranks)
            if len(to_id) != len(ranks):
                return None
            self.to_id = np.array([to_id[r] for r in range(len(ranks))], "<u4")
            pattern = r"[^\x00]+\x00"
        else:
            return None
        return tiktoken.Encoding("same", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    @property
    def token_bytes(self) -> list[bytes]:
        return token_table(self.path)

    def _batch(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _fill(self, missing: list[str]) -> None:
        short = [p for p in missing if len(p) <= self.leaf_chars or not self.tree]
        for i in range(0, len(short), 4096):
            part = short[i : i + 4096]
            for p, ids in zip(part, self._batch(part)):
                self.cache[p] = np.asarray(ids, "<u4").tobytes()
        for p in missing:
            if p not in self.cache:
                self.cache[p] = np.asarray(self.encode_long(p), "<u4").tobytes()

    def _listed(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of well-known units one after another, and how many each has: they are encoded as one text, in which tokens with an end mark show where each ends."""
        ids = np.asarray(self._batch([" ".join(units)])[0], "<u4")
        sizes = np.diff(np.flatnonzero(self.ends[ids]) + 1, prepend=0)
        if len(sizes) != len(units) or sizes.sum() != len(ids):
            each = self._batch(units)
            ids, sizes = np.array([i for e in each for i in e], "<u4"), np.fromiter(map(len, each), np.int64, len(each))
        return ids, sizes

    def _by_words(self, texts: list[str]) -> list[bytes]:
        """Ids of texts of well-known letters: each distinct word of all of them is cut into units once, and each unit is encoded once as long as it is known."""
        lists = pc.utf8_split_whitespace(pc.utf8_lower(pa.array(texts, pa.large_string())))
        words = lists.flatten().dictionary_encode()
        # a line end, which is no unit and has no ids, behind each word
        distinct = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words.dictionary)], pa.int32()), words.dictionary.cast(pa.string())), "\n")[0].as_py()
        units = self.units_lines(distinct + "\n")
        if len(self.known) > self.cache_pieces or len(self.known_ids) > 10 * self.cache_pieces:
            self.known, self.known_ids, self.known_sizes = {"\n": 0}, np.zeros(0, "<u4"), np.zeros(1, np.int64)
        at = np.fromiter(map(self.known.get, units, itertools.repeat(-1)), np.int64, len(units))
        new = np.flatnonzero(at < 0).tolist()
        if new:
            missing = list(dict.fromkeys(map(units.__getitem__, new)))
            found = [self._listed(missing[i : i + 4096]) for i in range(0, len(missing), 4096)]
            self.known.update(zip(missing, itertools.count(len(self.known))))
            self.known_ids, self.known_sizes = (np.concatenate(x) for x in zip((self.known_ids, self.known_sizes), *found))
            at[new] = [self.known[units[i]] for i in new]
        ids, sizes = _gather(self.known_ids, self.known_sizes, at)
        ids, sizes = _gather(ids, np.diff(np.cumsum(sizes)[at == 0], prepend=0), words.indices.to_numpy())
        cuts = np.concatenate([[0], np.cumsum(sizes)])[np.asarray(lists.offsets)].tolist()
        return [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]

    def _by_pieces(self, text: str) -> bytes:
        plain = self.units and "<|" not in text and not self.odd(text)
        pieces = self.units(text.lower()) if plain else self.split(text)
        if len(self.cache) > self.cache_pieces:
            self.cache.clear()
        missing = set(pieces).difference(self.cache)
        if missing:
            self._fill(sorted(missing))
        out = b"".join(map(self.cache.__getitem__, pieces))
        for p in missing:
            if len(p) > 64:
                del self.cache[p]
        return out

    def _is_plain(self, text: str) -> bool:
        half = self.leaf_chars // 2
        return "<|" not in text and not self.odd(text) and all(" " in text[i : i + half] for i in range(0, len(text) - half, half))

    def encode_bytes(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if self.merger is not None or self.units is None:
            return [self._encode_text(text) if text else b"" for text in texts]
        plain = [bool(text) and "<|" not in text and not self.odd(text) for text in texts]
        words = iter(self._by_words([text for text, p in zip(texts, plain) if p]))
        return [next(words) if p else self._encode_text(text) if text else b"" for text, p in zip(texts, plain)]

    def _leaf(self, text: str) -> bytes:
        return self._merged(text) if self.merger is not None and self._is_plain(text) else self._by_pieces(text)

    def _encode_text(self, text: str) -> bytes:
        if not self.tree or len(text) <= self.leaf_chars:
            return self._leaf(text)
        out = []
        for part in self.special_split.split(text) if self.special_split else [text]:
            if part in self.special:
                out.append(np.array([self.special[part]], "<u4").tobytes())
            elif part:
                out.append(self._concatenated(part))
        return b"".join(out)

    def cuts(self, text: str, size: int) -> list[int]:
        """Places that cut a text into leaves of ``size`` characters, but for stretches without a safe place, which stay whole."""
        out = [0]
        while len(text) - out[-1] > size:
            at = out[-1] + size
            if self._before(text, out[-1], at) == out[-1]:
                at = self._after(text, at, len(text))
                if at == len(text):
                    break
            out.append(at)
        return [*out, len(text)]

    def _concatenated(self, text: str) -> bytes:
        """Ids of a text without special tokens."""
        cuts = self.cuts(text, self.leaf_chars)
        return self.joined(text, [(a, b, np.frombuffer(self._leaf(text[a:b]), "<u4")) for a, b in zip(cuts, cuts[1:])]).tobytes()

    def joined(self, text: str, nodes: list[tuple[int, int, np.ndarray]]) -> np.ndarray:
        """Ids of a text from those of adjacent parts of it (start, stop, ids), two by two."""
        while len(nodes) > 1:
            pairs = zip(nodes[::2], nodes[1::2])
            joined = [(a, c, self._mended(text, a, b, c, left, right)) for (a, b, left), (_, c, right) in pairs]
            nodes = joined + nodes[len(joined) * 2 :]
        return nodes[0][2]

    def _merged(self, text: str) -> bytes:
        if self.keeps_space:
            return self.merger.encode_to_numpy(text, disallowed_special=()).tobytes()
        marked = "\0".join([*self.units(text.lower()), ""])
        return self.to_id[self.merger.encode_to_numpy(marked, disallowed_special=())].tobytes()

    def _before(self, text: str, start: int, stop: int) -> int:
        """The last safe place before ``stop``; ``start`` if there is none behind it."""
        width = 64
        while True:
            low, found = max(start, stop - width), None
            at = low
            while (m := self.safe_from(text, at, stop)) is not None:
                found, at = m, m + 1
            if found is not None and found > start:
                return found
            if low == start:
                return start
            width *= 4

    def _after(self, text: str, start: int, stop: int) -> int:
        """The first safe place from ``start`` on; ``stop`` if there is none."""
        found = self.safe_from(text, start, stop)
        return stop if found is None else found

    def safe_from(self, text: str, start: int, stop: int) -> int | None:
        m = self.safe(text, start, stop)
        return m.start() if m else None

    @functools.cached_property
    def token_sizes(self) -> np.ndarray:
        return np.array([len(x) for x in self.token_bytes])

    def _mended(self, text: str, start: int, cut: int, stop: int, left: np.ndarray, right: np.ndarray, width: int = 32) -> np.ndarray:
        """The encoding of text[start:stop] from those of text[start:cut] and text[cut:stop]."""
        self.joins += 1
        while True:
            a, b = self._before(text, start, max(cut - width, start)), self._after(text, min(cut + width, stop), stop)
            # tokens of both sides inside the window; None where none of them ends at its edge
            k = len(left) if a == start else self._count(left[::-1], len(text[a:cut].encode()))
            m = len(right) if b == stop else self._count(right, len(text[cut:b].encode()))
            if k is not None and m is not None:
                window = np.frombuffer(self._leaf(text[a:b]), "<u4")
                if (a == start or window[0] == left[-k]) and (b == stop or window[-1] == right[m - 1]):
                    return np.concatenate([left[: len(left) - k], window, right[m:]])
            width *= 2

    def _count(self, ids: np.ndarray, size: int) -> int | None:
        """How many tokens from the first on have ``size`` bytes together."""
        ends = np.cumsum(self.token_sizes[ids[:size]])
        at = int(np.searchsorted(ends, size))
        return at + 1 if at < len(ends) and ends[at] == size else None

    def encode_long(self, piece: str) -> list[int]:
        """Ids of a piece without white space to split at, by tree concatenation."""
        out: list[int] = []
        for part in self.special_split.split(piece) if self.special_split else [piece]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                units = [part[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(part)]
                short = iter(self._batch([u for u in units if len(u) <= self.leaf_chars]))
                for u in units:
                    out += next(short) if len(u) <= self.leaf_chars else self._tree(u)
        return out

    def _tree(self, unit: str) -> list[int]:
        cuts = [*range(0, len(unit) - 1, self.leaf_chars), len(unit)]
        nodes = self._batch([unit[a:b] for a, b in zip(cuts, cuts[1:])])
        while len(nodes) > 1:
            nodes = [self._join(*nodes[i : i + 2]) if i + 1 < len(nodes) else nodes[i] for i in range(0, len(nodes), 2)]
        return nodes[0]

    def _join(self, left: list[int], right: list[int], width: int = 8) -> list[int]:
        """The encoding of the concatenation of two encoded strings."""
        table = self.token_bytes
        self.piece_joins += 1
        while True:
            a, b = max(0, len(left) - width), min(len(right), width)
            while a > 0 and (table[left[a]][0] & 0xC0) == 0x80:  # a window starts and ends between characters
                a -= 1
            while b < len(right) and (table[right[b]][0] & 0xC0) == 0x80:
                b += 1
            window = self.tok.encode(b"".join(table[i] for i in left[a:] + right[:b]).decode(), add_special_tokens=False).ids
            if (a == 0 or window[0] == left[a]) and (b == len(right) or window[-1] == right[b - 1]):
                return left[:a] + window + right[b:]
            width *= 2

    def decode(self, ids: list[int]) -> str:
        return decode(ids, self.token_bytes)


@functools.lru_cache(maxsize=4)
def token_table(path: str) -> list[bytes]:
    """The bytes of each token by id: all that decoding needs, without an encoder."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    vocab, chars = spec["model"]["vocab"] | special, _byte_chars()
    out = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        out[i] = token.encode() if token in special else bytes(chars[c] for c in token)
    del spec, vocab
    release_memory()
    return out


def decode(ids: list[int], table: list[bytes]) -> str:
    """As the library's ``decode(ids, skip_special_tokens=False)`` for a byte-level decoder."""
    return b"".join(map(table.__getitem__, ids)).decode("utf-8", "replace")


@functools.lru_cache(maxsize=4)
def encoder(path: str, leaf_chars: int = 2048, fast: bool = True) -> PieceEncoder:
    """One encoder for each Python worker: its tables and cache outlive a batch."""
    made = PieceEncoder(path, leaf_chars, fast=fast) if fast else PieceEncoder(path, leaf_chars, cache_pieces=600_000, fast=False)
    release_memory()
    return made
