"""Byte-pair encoding and decoding with a ready vocabulary, by dynamic programming over prefixes.

For every prefix of a word the last token of the prefix's encoding is unique.  It is one of the
vocabulary's tokens that end there (found by a suffix-link automaton over all tokens) and is the one
that is *compatible* with the last token of the prefix before it: encoding the two tokens' joined text
gives back just these two.  The table of last tokens is filled from left to right; following it back
from the word's end gives the exact ids, with no merge queue.  The tables of many words are filled
together, a position at a time.

Compatibility is decided by running the merges of both tokens in rank order along their common border:
the right spine of the left token's merge tree and the left spine of the right token's.  If a merge
across the border would come first, the pair is not compatible.

Defined cases: null text is encoded as empty; an empty text has no ids and decodes to the empty text.
Texts of any length are read whole and never cut.  Repeated rows are encoded alike, and of equal ranks the leftmost merge goes
first, as in the library; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import common

#: A worker remembers recent chunks up to so many bytes and as many of older ones, and no longer chunk than so many letters
#: (bounds on memory, not on results).
REMEMBERED, LONGEST = 96 << 20, 256
#: What a remembered chunk takes beside its texts, about.
ENTRY = 400
#: Places of the table of pieces' counts (a power of two, ten bytes each); pairs of tokens remembered.
COUNTED, FITS = 1 << 22, 1_600_000
#: Bits of the places of the table of pairs that many words are looked up in at once (eight bytes each).
FIT_BITS = 21
#: Texts are encoded together up to so many bytes and rows, and a longer text alone; pieces of one table of last tokens, and the
#: longest one's bytes.  Fewer pieces than ``FEW``, and longer ones, are encoded one by one.
TOGETHER, ROWS_TOGETHER, ABREAST, LONG, FEW = 1 << 20, 500, 1 << 16, 64, 48
#: The symbol after a word's last byte.
_END = 256
#: White space that str.split() knows beyond the Unicode property.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_NEVER = 1 << 60
#: Of a chunk's part: the decimal ids and the decoded text, each joined by one space, and the number of ids.
_IDS, _DECODED, _NUMBER = itemgetter(0), itemgetter(1), itemgetter(2)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte: itself, or else the next above 255."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown}
    rest = [b for b in range(256) if b not in set(shown)]
    return letters | {chr(256 + k): b for k, b in enumerate(rest)}


class Coder:
    """Encodes and decodes texts as a tokenizer file of the "BPE with word ends" kind defines it."""

    def __init__(self, raw: bytes | str) -> None:
        spec = json.loads(raw)
        model = spec["model"]
        if model["end_of_word_suffix"] != "</w>" or model.get("continuing_subword_prefix") or model.get("byte_fallback"):
            raise ValueError("only byte-level BPE with </w> word ends is supported")
        self.names: dict[int, str] = {i: t for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names.update({i: t for t, i in self.special.items()})
        self._specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self._pieces = regex.compile(split["pattern"]["Regex"]).findall
        self._pieces_of_lines = regex.compile(f"(?:{split['pattern']['Regex']})|\n").findall
        letters = byte_letters()
        texts: dict[int, list[int]] = {}
        for name, i in model["vocab"].items():
            body, end = (name[:-4], [_END]) if name.endswith("</w>") and name != "</w>" else (name, [])
            texts[i] = [letters[c] for c in body] + end
        self._length = {i: len(t) for i, t in texts.items()}
        vocab = model["vocab"]
        self._merge: dict[tuple[int, int], int] = {}
        self._parts: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, made = vocab[left], vocab[right], vocab[left + right]
            self._merge[a, b] = rank
            self._parts.setdefault(made, (rank, a, b))
        self._right: dict[int, list[tuple[int, int]]] = {}
        self._left: dict[int, list[tuple[int, int]]] = {}
        self._fits: dict[int, bool] = {}
        self._whole: dict[int, bool] = {}
        self._build({i: text for i, text in texts.items() if self._stands(i)})
        #: Special tokens stand among chunks with a space before them, which no chunk has.
        self._fixed = {f" {t}": (str(i), t, 1) for t, i in self.special.items()}
        self._memo: dict[str, tuple[str, str, int]] = dict(self._fixed)
        self._older: dict[str, tuple[str, str, int]] = {}
        self._words: dict[str, list[int]] = {}
        self._held = self._words_held = 0
        #: Whether a chunk without ids was met.
        self._some_empty = False
        self._known = np.zeros(COUNTED, dtype=np.uint64)
        self._counts = np.zeros(COUNTED, dtype=np.uint16)
        #: Whether a text's tokens are those of its words: no special token holds a space.
        self.by_word = not any(any(c.isspace() for c in t) for t in self.special)

    def _build(self, texts: dict[int, list[int]]) -> None:
        """A trie of all tokens with suffix links; ``_token`` and ``_shorter`` list the tokens ending at a state, longest first.

        A step's key is the state times 512 plus the symbol.
        """
        step: dict[int, int] = {}
        token, depth = [-1], [0]
        children: list[list[tuple[int, int]]] = [[]]
        for i, text in texts.items():
            node = 0
            for c in text:
                nxt = step.get(node << 9 | c)
                if nxt is None:
                    nxt = step[node << 9 | c] = len(token)
                    token.append(-1)
                    depth.append(depth[node] + 1)
                    children.append([])
                    children[node].append((c, nxt))
                node = nxt
            token[node] = i
        link, shorter = [0] * len(token), [0] * len(token)
        todo = deque(n for _, n in children[0])
        while todo:
            node = todo.popleft()
            shorter[node] = link[node] if token[link[node]] >= 0 else shorter[link[node]]
            for c, child in children[node]:
                up = link[node]
                while up and up << 9 | c not in step:
                    up = link[up]
                link[child] = step.get(up << 9 | c, 0)
                todo.append(child)
        self._step, self._link, self._token, self._shorter, self._depth = step, link, token, shorter, depth

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """From the border symbol up to the token: each piece with the rank of the merge that ends it."""
        memo = self._left if side else self._right
        if (known := memo.get(token)) is None:
            pieces, ends = [token], [_NEVER]
            while (parts := self._parts.get(pieces[-1])) is not None:
                ends.append(parts[0])
                pieces.append(parts[1] if side else parts[2])
            known = memo[token] = list(zip(reversed(pieces), reversed(ends), strict=True))
        return known

    def _border_merge(self, a: int, b: int) -> tuple[int, int] | None:
        """The pieces of a and b that merge across their border when both are encoded side by side, if any."""
        right, left = self._spine(a, 0), self._spine(b, 1)
        i = j = 0
        while True:
            (p, ends_p), (q, ends_q) = right[i], left[j]
            across = self._merge.get((p, q), _NEVER)
            # Of equal ranks the leftmost goes first: the left token's own merge, then the border, then the right's.
            if across < ends_p and across <= ends_q:
                return p, q
            if ends_p == ends_q == _NEVER:
                return None
            if ends_p <= ends_q:
                i += 1
            else:
                j += 1

    def _stands(self, token: int) -> bool:
        """Whether the token's text encodes to the token alone."""
        if (known := self._whole.get(token)) is None:
            parts = self._parts.get(token)
            known = parts is None or self._stands(parts[1]) and self._stands(parts[2]) and self._border_merge(parts[1], parts[2]) == parts[1:]
            self._whole[token] = known
        return known

    def _compatible(self, a: int, b: int) -> bool:
        if len(self._fits) > FITS:
            self._fits.clear()
        known = self._fits[a << 20 | b] = self._border_merge(a, b) is None
        return known

    def word_ids(self, word: str) -> list[int]:
        """The ids of one pre-token (never empty)."""
        text = [*word.encode("utf-8", "surrogatepass"), _END]
        last, state = [-1] * (len(text) + 1), 0
        step, link, token, shorter, length, fits = self._step, self._link, self._token, self._shorter, self._length, self._fits
        end = 0
        for c in text:
            end += 1
            while (onward := step.get(state << 9 | c)) is None and state:
                state = link[state]
            state = onward or 0
            at = state if token[state] >= 0 else shorter[state]
            while at:
                t = token[at]
                before = last[end - length[t]] if length[t] < end else -2
                if before == -2:
                    last[end] = t
                    break
                if before >= 0:
                    fit = fits.get(before << 20 | t)
                    if self._compatible(before, t) if fit is None else fit:
                        last[end] = t
                        break
                at = shorter[at]
        out, end = [], len(text)
        while end:
            out.append(last[end])
            end -= self._length[last[end]]
        return out[::-1]

    @cached_property
    def _tables(self) -> _Tables:
        """The automaton with its suffix links followed, as arrays; made when many words come together for the first time."""
        depth, link = np.array(self._depth), np.array(self._link)
        keys, child = np.fromiter(self._step.keys(), np.int64, len(self._step)), np.fromiter(self._step.values(), np.int32, len(self._step))
        parent, symbol = keys >> 9, keys & 511
        # A state without onward steps of its own has those of its link.
        own = np.full(len(depth), -1, dtype=np.int64)
        owners = np.union1d(parent[symbol != _END], [0])
        own[owners] = np.arange(len(owners))
        row, onward, end = np.zeros(len(depth), np.int64), np.zeros((len(owners), 256), np.int32), np.zeros(len(depth), np.int32)
        by_depth, edges = np.argsort(depth, kind="stable"), np.argsort(depth[parent], kind="stable")
        levels = range(int(depth.max()) + 2)
        cut, cut_edges = np.searchsorted(depth[by_depth], levels), np.searchsorted(depth[parent][edges], levels)
        for d in levels[:-1]:
            states, at = by_depth[cut[d] : cut[d + 1]], edges[cut_edges[d] : cut_edges[d + 1]]
            if d:
                row[states], end[states] = row[link[states]], end[link[states]]
            mine = states[own[states] >= 0]
            onward[own[mine]] = onward[row[mine]]
            row[mine] = own[mine]
            last = symbol[at] == _END
            end[parent[at[last]]] = child[at[last]]
            at = at[~last]
            onward[own[parent[at]], symbol[at]] = child[at]
        token, shorter = np.array(self._token), np.array(self._shorter)
        length = np.zeros(max(self.names) + 1, dtype=np.int64)
        length[list(self._length)] = list(self._length.values())
        ids = range(len(length))
        return _Tables(
            onward.ravel(), row * 256, end, np.where(token >= 0, np.arange(len(token)), shorter), shorter, token, depth, length,
            np.full(1 << FIT_BITS, -1, dtype=np.int64), pa.array([str(i) for i in ids]), pa.array([self.names.get(i) for i in ids]),
        )

    def _fit_all(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the tokens of each pair are compatible."""
        table, fits = self._tables.fits, self._fits
        key = a << 20 | b
        # A pair has one place in the table; the latest pair there is the one remembered.
        slot = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FIT_BITS)
        slot = slot.astype(np.int64)
        known = table.take(slot)
        out = (known & 1).astype(bool)
        missing = np.flatnonzero(known >> 1 != key)
        if len(missing):
            new, first, inverse = np.unique(key[missing], return_index=True, return_inverse=True)
            found = [fits.get(k) for k in new.tolist()]
            made = np.array([self._compatible(k >> 20, k & 0xFFFFF) if fit is None else fit for k, fit in zip(new.tolist(), found, strict=True)])
            out[missing] = made[inverse]
            table[slot[missing[first]]] = new << 1 | made
        return out

    def words_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many pre-tokens, one word's after the other's, and the bounds of each word's."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        order = np.argsort(-sizes, kind="stable")
        alone = max(int((sizes > LONG).sum()), min(len(words), FEW))
        which, made, counts = [order[:alone]], [], []
        each = [self.word_ids(words[k]) for k in order[:alone].tolist()]
        made.append(np.fromiter(chain.from_iterable(each), np.int64))
        counts.append(np.fromiter(map(len, each), np.int64, len(each)))
        for lo in range(alone, len(words), ABREAST):
            which.append(order[lo : lo + ABREAST])
            ids, n = self._abreast([raw[k] for k in which[-1].tolist()], sizes[which[-1]])
            made.append(ids)
            counts.append(n)
        at, n = np.concatenate(which), np.concatenate(counts)
        starts = np.empty(len(words), dtype=np.int64)
        starts[at] = np.cumsum(n) - n
        count = np.empty(len(words), dtype=np.int64)
        count[at] = n
        bounds = np.concatenate([[0], np.cumsum(count)])
        return np.concatenate(made)[_ranges(starts, count)], bounds

    def _abreast(self, raw: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words given as bytes, longest first, and the number of each word's.  ``last[e, w]``: as in ``word_ids``."""
        tables, n, longest = self._tables, len(raw), int(sizes[0])
        data, starts = np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum(sizes) - sizes
        last = np.full((longest + 2, n), -1, dtype=np.int64)
        last[0] = -2
        flat, state = last.ravel(), np.zeros(n, dtype=np.int64)
        for p in range(longest + 1):
            # Words with a byte here, and after them those that end here.
            inside, here = np.searchsorted(-sizes, -p, side="left"), np.searchsorted(-sizes, -p, side="right")
            state[:inside] = tables.onward.take(tables.row.take(state[:inside]) + data.take(starts[:inside] + p))
            state[inside:here] = tables.end.take(state[inside:here])
            at, who = tables.first.take(state[:here]), np.arange(here)
            while len(who):
                t = tables.token.take(at)
                before = flat.take((p + 1 - tables.depth.take(at)) * n + who)
                good = before == -2
                ask = np.flatnonzero(before >= 0)
                good[ask] = self._fit_all(before.take(ask), t.take(ask))
                # The root, which has no token, ends a word's search.
                good &= at > 0
                last[p + 1, who[good]] = t[good]
                left = np.flatnonzero(~good & (at > 0))
                at, who = tables.shorter.take(at.take(left)), who.take(left)
        count, steps, who, end = np.zeros(n, dtype=np.int64), [], np.arange(n), sizes + 1
        while len(who):
            t = flat.take(end * n + who)
            if (t < 0).any():
                raise ValueError("the vocabulary lacks a token for a byte")
            steps.append((who, t))
            count[who] += 1
            end = end - tables.length.take(t)
            who, end = who[end > 0], end[end > 0]
        out, ends = np.empty(int(count.sum()), dtype=np.int64), np.cumsum(count)
        for k, (who, t) in enumerate(steps):
            out[ends[who] - 1 - k] = t
        return out, count

    def chunk_ids(self, chunk: str) -> list[int]:
        out: list[int] = []
        for piece in self._pieces(chunk):
            ids = self._words.get(piece)
            if ids is None:
                ids = self.word_ids(piece)
                if len(piece) <= LONGEST:
                    self._words_held += 40 * len(ids) + len(piece) + ENTRY
                    if self._words_held > REMEMBERED:
                        self._words.clear()
                        self._words_held = 0
                    self._words[piece] = ids
            out += ids
        return out

    @staticmethod
    def normalise(text: str) -> str:
        """NFC and lower case, letter by letter (no special final sigma); white space stays, as it only separates."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def _made(self, chunks: list[str]) -> list[tuple[str, str, int]]:
        """The parts of chunks, none of them twice."""
        if len(chunks) < FEW:
            each = [self.chunk_ids(c) for c in chunks]
            self._some_empty |= not all(each)
            return [(" ".join(map(str, ids)), self.decode(ids), len(ids)) for ids in each]
        if max(map(len, chunks)) > LONGEST:
            short = [c for c in chunks if len(c) <= LONGEST]
            made = dict(zip(short, self._made(short), strict=True))
            return [made.get(c) or self._made([c])[0] for c in chunks]
        index = {"\n": 0}
        codes = np.array([index.setdefault(p, len(index)) for p in self._pieces_of_lines("\n".join(chunks))])
        ids, bounds = self.words_ids(list(index)[1:])
        lines = codes == 0
        chunk, code = np.cumsum(lines)[~lines], codes[~lines] - 1
        counts = np.diff(bounds)[code]
        ids = ids[_ranges(bounds[code], counts)]
        sums = np.bincount(chunk, weights=counts, minlength=len(chunks)).astype(np.int64)
        offsets = pa.array(np.concatenate([[0], np.cumsum(sums)]).astype(np.int32))
        self._some_empty |= not sums.all()
        numbers, names = (pc.binary_join(pa.ListArray.from_arrays(offsets, of.take(pa.array(ids))), " ").to_numpy(zero_copy_only=False).tolist() for of in (self._tables.numbers, self._tables.names))
        return list(zip(numbers, names, sums.tolist(), strict=True))

    def _look_up(self, chunks: list[str]) -> list[tuple[str, str, int]]:
        """Each chunk's part: one remembered, from the older half of these, or else made."""
        parts = list(map(self._memo.get, chunks))
        if None in parts:
            at = [k for k, p in enumerate(parts) if p is None]
            missing: dict = dict.fromkeys(map(chunks.__getitem__, at))
            names = list(missing)
            for lo in range(0, len(names), ABREAST):
                some = names[lo : lo + ABREAST]
                found = dict(zip(some, map(self._older.get, some), strict=True))
                new = [c for c, p in found.items() if p is None]
                found.update(zip(new, self._made(new), strict=True))
                missing.update(found)
                self._remember(found)
            for k in at:
                parts[k] = missing[chunks[k]]
        return parts

    def _remember(self, found: dict[str, tuple[str, str, int]]) -> None:
        if max(map(len, found)) > LONGEST:
            found = {c: p for c, p in found.items() if len(c) <= LONGEST}
        held = sum([len(c) + len(p[0]) + len(p[1]) for c, p in found.items()]) + ENTRY * len(found)
        if self._held + held > REMEMBERED:
            self._older, self._memo, self._held = self._memo, dict(self._fixed), 0
        self._held += held
        self._memo.update(found)

    def _chunks(self, text: str) -> list[str]:
        """What stands between white space, and the special tokens."""
        out: list[str] = []
        for part in self._specials.split(text) if self._specials else (text,):
            if part in self.special:
                out.append(f" {part}")
                continue
            part = self.normalise(part)
            out += self._pieces(part) if _SEPARATORS.search(part) else part.split()
        return out

    def _parts_of(self, text: str) -> list[tuple[str, str, int]]:
        return self._look_up(self._chunks(text))

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for ids, _, n in self._parts_of(text or "") if n for i in ids.split(" ")]

    def decode(self, ids: list[int]) -> str:
        """The tokens' names joined by one space, as the library does for a file without a decoder."""
        return " ".join(self.names[i] for i in ids)

    def both(self, text: str | None) -> tuple[str, str, int]:
        """Decimal ids and decoded text, each joined by one space, and the number of ids."""
        return next(self.both_all([text]))

    def both_all(self, texts: list[str | None]) -> Iterator[tuple[str, str, int]]:
        """``both`` of each text, where the words of all of them that are not remembered are encoded together."""
        each = [self._chunks(x or "") for x in texts]
        parts, first = self._look_up(list(chain.from_iterable(each)) if len(each) > 1 else each[0] if each else []), 0
        for chunks in each:
            of = parts[first : first + len(chunks)]
            first += len(chunks)
            if self._some_empty:
                of = [p for p in of if p[2]]
            yield " ".join(map(_IDS, of)), " ".join(map(_DECODED, of)), sum(map(_NUMBER, of))

    def count(self, text: str | None) -> int:
        return sum([p[2] for p in self._parts_of(text or "")])

    def count_rows(self, run: common.Run) -> np.ndarray:
        """Each row's number of tokens, without encoding the rows.

        Words of plain letters, digits and signs are split by their bytes, other words by the tokenizer's own pattern;
        the tokens of each different piece are counted once and looked up by the piece's hash.
        """
        if not self.by_word:
            return np.array([self.count(run.data[a:b].tobytes().decode("utf-8", "replace")) for a, b in zip(run.offsets[:-1], run.offsets[1:], strict=True)], dtype=np.int64)
        total = np.zeros(run.rows, dtype=np.int64)
        for piece in common.pieces(run):
            data, offsets = piece.data, piece.offsets
            words = common.words_of(piece)
            if not len(words.starts):
                continue
            kind = _KIND[data]
            other = kind == _OTHER
            if len(data) > 1:
                # Signs among the letters of two bytes, and the one whose lower case is two letters.
                other[1:] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)) | (data[:-1] == 0xC4) & (data[1:] == 0xB0)
            odd = np.zeros(len(words.starts), dtype=bool)
            odd[np.searchsorted(words.starts, np.flatnonzero(other), side="right") - 1] = True
            if odd.any():
                # Bytes of odd words take no part in the plain pieces.
                at = np.flatnonzero(odd)
                kind = kind.copy()
                lengths = words.ends[at] - words.starts[at]
                first = np.cumsum(lengths) - lengths
                kind[np.arange(lengths.sum()) - np.repeat(first, lengths) + np.repeat(words.starts[at], lengths)] = _OTHER
                self._add(total, data, offsets, words.starts[at], words.ends[at], self.count)
            lower = common.LOWER_BYTE[data]
            for what, of in ((_LETTERS, self._tokens_of), (_SIGNS, self._tokens_of)):
                found = common.spans(kind == what, offsets)
                self._add(total, lower, offsets, found.starts, found.ends, of)
            digits = np.flatnonzero(kind == _DIGITS)
            if len(digits):
                each = np.array([self._tokens_of(chr(b)) for b in range(48, 58)], dtype=np.int64)
                total += _sums_by_row(each[data[digits] - 48], digits, offsets)
        return total

    def _tokens_of(self, piece: str) -> int:
        return len(self.word_ids(self.normalise(piece)))

    def _add(self, total: np.ndarray, data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, of: Callable[[str], int]) -> None:
        """Adds the tokens of the spans to their rows."""
        if not len(starts):
            return
        h = common.hash_spans(data, starts, ends)
        # A hash has one place in the table; the latest piece there is the one remembered.
        slot = (h & np.uint64(COUNTED - 1)).astype(np.int64)
        counts = self._counts[slot].astype(np.int64)
        missing = np.flatnonzero(self._known[slot] != h)
        if len(missing):
            new, first, inverse = np.unique(h[missing], return_index=True, return_inverse=True)
            at = missing[first]
            made = np.array([of(data[a:b].tobytes().decode("utf-8", "replace")) for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)], dtype=np.int64)
            counts[missing] = made[inverse]
            # Larger counts are made anew each time.
            small = made < np.iinfo(np.uint16).max
            self._known[slot[at][small]] = new[small]
            # Of two new pieces with one place numpy keeps the last in both tables alike.
            self._counts[slot[at][small]] = made[small]
        total += _sums_by_row(counts, starts, offsets)


@dataclass
class _Tables:
    """What a state's row number times 256 plus a byte leads to, and a word's end; the first state upward that ends a token, and the next;
    each state's token and depth; each token's length; pairs' keys times two plus whether they fit; the ids as text and the tokens' names."""

    onward: np.ndarray
    row: np.ndarray
    end: np.ndarray
    first: np.ndarray
    shorter: np.ndarray
    token: np.ndarray
    depth: np.ndarray
    length: np.ndarray
    fits: np.ndarray
    numbers: pa.Array
    names: pa.Array


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``starts[i], starts[i] + 1, ...``, ``counts[i]`` of them, for each i in turn."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def _sums_by_row(values: np.ndarray, starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values)])
    bounds = np.searchsorted(starts, offsets)
    return sums[bounds[1:]] - sums[bounds[:-1]]


#: Kinds of bytes in a text that is split without the tokenizer's pattern.  Letters: a-z, A-Z and both bytes of the Latin letters
#: U+00C0 to U+017F; digits; signs: other ASCII.  An apostrophe (contractions), "<" (special tokens), control characters that
#: may separate, and all other bytes make a word odd.
_SPACES, _LETTERS, _DIGITS, _SIGNS, _OTHER = range(5)
_KIND = np.full(256, _OTHER, dtype=np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = _SPACES
_KIND[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), 0xC3, 0xC4, 0xC5]] = _LETTERS
_KIND[48:58] = _DIGITS
_KIND[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) not in "'<"]] = _SIGNS


_coders: dict[str, Coder] = {}


def coder_of(raw: bytes) -> Coder:
    """One coder a worker and vocabulary."""
    key = hashlib.sha256(raw).hexdigest()
    if key not in _coders:
        _coders.clear()
        _coders[key] = Coder(raw)
    return _coders[key]


def ship(spark, path: str | None = None):
    """The vocabulary file (of fixed size, under 2 MB) for all workers; only the driver needs the path."""
    common.prepare(spark)
    with open(path or default_vocabulary(), "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _over_texts(shipped, fields: list[tuple[str, pa.DataType]], of: Callable[[Coder, str | None], tuple]) -> Callable:
    """A map over batches of (id, text): ``of``'s values become the columns after the id."""
    schema = pa.schema([("doc_id", pa.int64()), *fields])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(shipped.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                rows = [of(coder, x.as_py()) for x in part.column(1)]
                columns = [pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(fields)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], schema=schema)

    return over


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def encode(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array<int>) of every whole text."""
    over = _over_texts(ship(docs.sparkSession, vocabulary), [("ids", pa.list_(pa.int32()))], lambda coder, text: (coder.encode(text),))
    return _texts(docs, id_col, text_col).mapInArrow(over, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of every row of ids; null ids give the empty text."""
    over = _over_texts(ship(encoded.sparkSession, vocabulary), [("text", pa.string())], lambda coder, ids: (coder.decode(ids or []),))
    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(over, "doc_id long, text string")


def token_counts(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and n_tokens of every whole text."""
    shipped = ship(docs.sparkSession, vocabulary)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(shipped.value)
        for batch in batches:
            for run in common.runs(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(run.first, run.rows), pa.array(coder.count_rows(run))], schema=schema)

    return _texts(docs, id_col, text_col).mapInArrow(over, "doc_id long, n_tokens long")


def round_trip_digests(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the written ids and of the decoded text, of every whole text."""
    shipped = ship(docs.sparkSession, vocabulary)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(shipped.value)
        for batch in batches:
            for part in _together(batch):
                rows = [(n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()) for ids, decoded, n in coder.both_all(part.column(1).to_pylist())]
                columns = [pa.array([r[k] for r in rows], field.type) for k, field in enumerate(list(schema)[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], schema=schema)

    return _texts(docs, id_col, text_col).mapInArrow(over, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _together(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Neighbouring rows of some ``TOGETHER`` bytes of text (column 1); a longer text stands alone."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < batch.num_rows:
        before = int(sizes[lo - 1]) if lo else 0
        hi = min(max(int(np.searchsorted(sizes, before + TOGETHER, side="right")), lo + 1), lo + ROWS_TOGETHER)
        yield batch.slice(lo, min(hi, batch.num_rows) - lo)
        lo = hi
