"""BPE by speculation: greedy longest matches are proposed, checked pair by pair, and only words that fail are merged exactly.

A sequence of tokens is what BPE makes of a word if every token is what BPE makes of its own
bytes and no two neighbours would have been cut elsewhere. Whether two neighbours fit depends
on them alone, so verdicts are kept, and new pairs of a batch are decided together in NumPy by
walking the two tokens' merge trees towards each other.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

# Fixed value: the public pre-tokenisation pattern of byte-level BPE (with Unicode's white space spelt out).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: A piece that starts like this, or is empty, has to be read together with what stands before it.
_OPEN = r"^$|^[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
#: Most pieces and most of their bytes that one worker remembers.
CACHE_PIECES = 250_000
CACHE_BYTES = 10_000_000
#: Stands between words in a sweep; no byte's character, so no match crosses it.
_BORDER = "\u0100"
_NEVER = np.int64(2**62)


def _byte_chars() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself, or the next free code point from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    rest = [b for b in range(256) if chr(b) not in out]
    return out | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """A byte-level BPE vocabulary (tokenizer.json). Tokens are numbered inside by the order in which merges make them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        model, chars = data["model"], _byte_chars()
        if model["type"] != "BPE" or data.get("normalizer") or (data.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or data["pre_tokenizer"].get("add_prefix_space") or model.get("ignore_merges"):
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        special = [t for t in data.get("added_tokens", [])]
        if any(t[k] for t in special for k in ("lstrip", "rstrip", "single_word", "normalized")):
            raise ValueError(f"{path} has added tokens that take white space or are normalised")
        self.special = {t["content"]: t["id"] for t in special}
        self._cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if special else None
        vocab = model["vocab"]
        to_bytes = lambda s: bytes(chars[c] for c in s)
        words = [bytes([b]) for b in range(256)]
        inner = {w: i for i, w in enumerate(words)}
        back = {b: c for c, b in chars.items()}
        outer = [vocab[back[b]] for b in range(256)]
        left, right = [-1] * 256, [-1] * 256
        for pair in model["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            a, b = to_bytes(a), to_bytes(b)
            inner.setdefault(a + b, len(words))
            words.append(a + b)
            outer.append(vocab["".join(back[x] for x in a + b)])
            left.append(inner[a])
            right.append(inner[b])
        self.words, self.ids = words, np.array(outer, np.uint32)
        self._inner = inner
        self._left, self._right = np.array(left, np.int64), np.array(right, np.int64)
        n = len(words)
        keys = self._left[256:] * n + self._right[256:]
        order = np.argsort(keys, kind="stable")
        self._pair_keys, self._pair_made = keys[order], np.arange(256, n)[order]
        self._merge = dict(zip(keys.tolist(), range(256, n)))
        self._n = n
        # all tokens, as strings of one character a byte; a longest match from the left never skips a byte
        self._greedy = ahocorasick.Automaton()
        for i, w in enumerate(words):
            self._greedy.add_word(w.decode("latin-1"), i)
        self._greedy.make_automaton()
        self._bytes = np.empty(max(int(self.ids.max()), *self.special.values(), 0) + 1 if special else int(self.ids.max()) + 1, object)
        self._bytes[:] = b""
        for w, i in zip(words, outer):
            self._bytes[i] = w
        for s, i in self.special.items():
            self._bytes[i] = s.encode()
        self._split = regex.compile(PATTERN)
        self._whole = np.full(n, -1, np.int8)
        self.words_seen = self.words_merged = 0
        self.forget()

    def forget(self) -> None:
        """Drop what encoding remembered."""
        self._slots: dict[str, int] = {}
        self._size = 0
        self._flat, self._used = np.zeros(1 << 16, np.uint32), 0
        self._ends = np.zeros(1 << 14, np.int64)

    # -- words ----------------------------------------------------------------------------

    def _propose(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest matches of all words in one sweep: (tokens, where each word begins and the end)."""
        got = np.fromiter((x for pair in self._greedy.iter_long(_BORDER.join(words)) for x in pair), np.int64).reshape(-1, 2)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(len(words))
        return got[:, 1].copy(), np.concatenate([[0], np.searchsorted(got[:, 0], ends)])

    def _merged(self, word: bytes) -> list[int]:
        """Exact merging: the earliest merge first, the leftmost among equals."""
        tokens = list(word)
        n, last = len(tokens), len(tokens)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merge, base = self._merge, self._n
        heap = [(made, i) for i in range(n - 1) if (made := merge.get(tokens[i] * base + tokens[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            made, i = heapq.heappop(heap)
            if tokens[i] < 0 or (j := after[i]) >= last or merge.get(tokens[i] * base + tokens[j]) != made:
                continue
            tokens[i], tokens[j] = made, -1
            after[i] = k = after[j]
            if k < last:
                before[k] = i
                if (new := merge.get(made * base + tokens[k])) is not None:
                    heapq.heappush(heap, (new, i))
            if (h := before[i]) >= 0 and (new := merge.get(tokens[h] * base + made)) is not None:
                heapq.heappush(heap, (new, h))
        return [t for t in tokens if t >= 0]

    # -- checks ---------------------------------------------------------------------------

    def _made_by(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token that merging a and b makes, or _NEVER."""
        keys = a * self._n + b
        at = np.minimum(np.searchsorted(self._pair_keys, keys), len(self._pair_keys) - 1)
        return np.where(self._pair_keys[at] == keys, self._pair_made[at], _NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE, given the bytes of a and then of b, leaves just these two tokens; for many pairs at once.

        Undoing the merges of both tokens, latest first, shows every state in which an end of a
        met a beginning of b. The pair fits unless a merge across the border would then have come
        before the one that was undone."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        fits, open_ = np.ones(len(a), bool), np.arange(len(a))
        x, y, limit = a.copy(), b.copy(), np.full(len(a), _NEVER - 1)
        while len(open_):
            bad = self._made_by(x, y) < limit
            fits[open_[bad]] = False
            go = ~bad
            open_, x, y = open_[go], x[go], y[go]
            later = x > y
            # the later of both merges is undone; the left one wins the bytes at the border when both are the same merge
            limit = np.where(later, x, y + 1)
            single = np.where(later, x, y) < 256
            nx, ny = np.where(later & ~single, self._right[x], x), np.where(~later & ~single, self._left[y], y)
            # a byte can't be undone, and as it is the later one, the other is a byte too
            go = ~single
            open_, x, y, limit = open_[go], nx[go], ny[go], limit[go]
        return fits

    def _all_whole(self, tokens: np.ndarray) -> np.ndarray:
        """Whether each token is what BPE makes of its own bytes."""
        new = np.unique(tokens[self._whole[tokens] < 0])
        for t in new.tolist():
            self._whole[t] = self._merged(self.words[t]) == [t]
        return self._whole[tokens] > 0

    def _merged_all(self, words: list[bytes]) -> list[list[int]]:
        """Exact merging of many words: a round joins, in every word at once, the earliest merge (the leftmost of equals)."""
        out: list = [None] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for low, high in ((0, 12), (12, 24), (24, 48)):
            at = np.flatnonzero((sizes > low) & (sizes <= high))
            if len(at):
                tokens = np.frombuffer(b"".join(words[i].ljust(high, b"\0") for i in at), np.uint8).reshape(-1, high).astype(np.int64)
                left = sizes[at]
                column = np.arange(high - 1)
                made = np.where(column < left[:, None] - 1, self._made_by(tokens[:, :-1], tokens[:, 1:]), _NEVER)
                while len(at):
                    j = made.argmin(1)
                    rows = np.arange(len(at))
                    best = made[rows, j]
                    done = best == _NEVER
                    if done.any():
                        for i, row, n in zip(at[done].tolist(), tokens[done].tolist(), left[done].tolist()):
                            out[i] = row[:n]
                        go = ~done
                        at, tokens, left, made, j, best = at[go], tokens[go], left[go], made[go], j[go], best[go]
                        rows = np.arange(len(at))
                        if not len(at):
                            break
                    tokens[rows, j] = best
                    after = np.arange(high) + (np.arange(high) > j[:, None])
                    tokens = np.take_along_axis(tokens, np.minimum(after, high - 1), 1)
                    made = np.take_along_axis(made, np.minimum(after[:, :-1], high - 2), 1)
                    left -= 1
                    ahead = np.minimum(j + 1, high - 1)
                    made[rows, np.minimum(j, high - 2)] = np.where(j < left - 1, self._made_by(tokens[rows, j], tokens[rows, ahead]), _NEVER)
                    back = np.maximum(j - 1, 0)
                    made[rows, back] = np.where(j > 0, self._made_by(tokens[rows, back], tokens[rows, j]), made[rows, back])
                    made[column >= left[:, None] - 1] = _NEVER
        for i in np.flatnonzero(sizes > 48):
            out[i] = self._merged(words[i])
        return out

    def words_to_tokens(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens (numbered inside) of all words and where each word begins: proposed, checked, merged exactly where a check fails."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(1, np.int64)
        tokens, starts = self._propose([w.decode("latin-1") for w in words])
        self.words_seen += len(words)
        fits = np.append(self._all_whole(tokens), True)
        inside = np.ones(len(tokens), bool)
        inside[starts[1:] - 1] = False  # the last of a word has no neighbour in it
        at = np.flatnonzero(inside)
        keys, where = np.unique(tokens[at] * self._n + tokens[np.minimum(at + 1, len(tokens) - 1)], return_inverse=True)
        fits[at] &= self.compatible(keys // self._n, keys % self._n)[where]
        failed = np.flatnonzero(~np.logical_and.reduceat(fits[:-1], starts[:-1]))
        self.words_merged += len(failed)
        if not len(failed):
            return tokens, starts
        exact = self._merged_all([words[i] for i in failed.tolist()])
        sizes = np.diff(starts)
        good = np.ones(len(words), bool)
        good[failed] = False
        kept = tokens[np.repeat(good, sizes)]
        sizes[failed] = np.fromiter(map(len, exact), np.int64, len(exact))
        out = np.empty(int(sizes.sum()), np.int64)
        put = np.repeat(good, sizes)
        out[put] = kept
        out[~put] = np.fromiter((t for x in exact for t in x), np.int64, int((~put).sum()))
        return out, np.concatenate([[0], np.cumsum(sizes)])

    # -- texts ----------------------------------------------------------------------------

    def _learn(self, pieces: list[str]) -> None:
        """Tokens of pieces not met before."""
        words: dict[bytes, int] = {}
        order: list[int] = []  # words by number; special tokens as -1 - id
        bounds = []
        find, cut = self._split.findall, self._cut
        for piece in pieces:
            for part in cut.split(piece) if cut and any(s in piece for s in self.special) else (piece,):
                if part in self.special:
                    order.append(-1 - self.special[part])
                elif part:
                    order += [words.setdefault(w.encode("utf-8", "surrogatepass"), len(words)) for w in find(part)]
            bounds.append(len(order))
            self._size += len(piece)
        tokens, starts = self.words_to_tokens(list(words))
        sizes = np.append(np.diff(starts), 1)  # the last stands for any special token
        places = np.array(order, np.int64)
        special = places < 0
        word = np.where(special, len(words), places)
        n = sizes[word]
        ends = np.cumsum(n)
        first = np.append(starts[:-1], len(tokens))[word]
        ids = np.append(self.ids[tokens], np.uint32(0))[np.repeat(first - (ends - n), n) + np.arange(int(n.sum()))]
        ids[(ends - n)[special]] = -1 - places[special]
        piece_ends = np.concatenate([[0], ends])[np.array(bounds)] + self._used
        known = len(self._slots)
        self._slots.update(zip(pieces, range(known, known + len(pieces))))
        need, room = self._used + len(ids), len(self._flat)
        if need > room:
            self._flat = np.concatenate([self._flat, np.zeros(max(need - room, room), np.uint32)])
        self._flat[self._used : need] = ids
        self._used = need
        if known + len(pieces) + 1 > len(self._ends):
            self._ends = np.concatenate([self._ends, np.zeros(max(len(pieces) + 1, len(self._ends)), np.int64)])
        self._ends[known + 1 : known + 1 + len(pieces)] = piece_ends

    def _slots_of(self, pieces: list[str]) -> np.ndarray:
        if missing := [p for p in dict.fromkeys(pieces) if p not in self._slots]:
            self._learn(missing)
        return np.fromiter((self._slots[p] for p in pieces), np.int64, len(pieces))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text begins and the end). A null text counts as empty.

        Texts are cut before each single space that something other than white space follows;
        the pattern never joins across such a place, so pieces are encoded once and looked up."""
        if len(self._slots) > CACHE_PIECES or self._size > CACHE_BYTES:
            self.forget()
        if texts.offset:
            texts = texts.take(pa.array(np.arange(len(texts))))
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        lists = pc.split_pattern(texts, " ")
        flat = lists.flatten()
        offsets = lists.offsets.to_numpy()
        first = np.zeros(len(flat), bool)
        first[offsets[:-1]] = True
        coded = flat.dictionary_encode()
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        known, index = coded.dictionary, coded.indices.to_numpy()
        odd_piece = pc.match_substring_regex(known, _OPEN).to_numpy(zero_copy_only=False)
        odd = odd_piece[index] & ~first
        # in a text with special tokens, white space before one isn't followed by anything
        slow = np.zeros(len(texts), bool)
        if odd.any():
            slow[np.searchsorted(offsets, np.flatnonzero(odd), side="right") - 1] = True
        for s in self.special:
            slow |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        per_text = np.diff(offsets)
        use = ~np.repeat(slow, per_text)
        rest = use & ~first
        spaced = np.unique(index[rest])
        table = np.zeros(len(known), np.int64)
        if len(spaced):
            table[spaced] = self._slots_of([f" {p}" for p in known.take(pa.array(spaced)).to_pylist()])
        slots = table[index]
        heads = np.flatnonzero(use & first)
        if len(heads):
            slots[heads] = self._slots_of(flat.take(pa.array(heads)).to_pylist())
        if slow.any():
            parts, begin = [], 0
            for i in np.flatnonzero(slow):
                parts += [slots[offsets[begin] : offsets[i]], self._slots_of(self._pieces(texts[int(i)].as_py()))]
                per_text[i] = len(parts[-1])
                begin = i + 1
            slots = np.concatenate([*parts, slots[offsets[begin] :]])
        n = self._ends[slots + 1] - self._ends[slots]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        ids = self._flat[np.repeat(self._ends[slots] - (ends - n), n) + np.arange(total)]
        bounds = np.concatenate([[0], np.cumsum(per_text)])
        return ids, np.concatenate([[0], ends])[bounds].astype(np.int64)

    def _pieces(self, text: str) -> list[str]:
        """The pieces of a text with runs of white space or special tokens."""
        if self._cut and any(s in text for s in self.special):
            return [text]
        out: list[str] = []
        for i, p in enumerate(text.split(" ")):
            if i and (not p or p[0].isspace() or regex.match(r"[\p{Z}\x85\x1c-\x1f]", p)):
                out[-1] += f" {p}"
            else:
                out.append(f" {p}" if i else p)
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of some ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(self._bytes[ids].tolist()).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    """The vocabulary at a path, read once in each Python worker."""
    return Bpe(path)
