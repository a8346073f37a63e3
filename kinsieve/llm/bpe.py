"""Exact BPE by dynamic programming over prefixes.

For every prefix of a word there is exactly one token that the BPE encoding of that prefix
ends with. It is the one vocabulary entry that (1) is a suffix of the prefix and (2) is
compatible with the last token of what stands before it, that is, BPE leaves the two
next to each other as they are. An automaton over the vocabulary finds the entries
of (1), a memoised test decides (2). The table of last tokens holds the count of tokens of
every prefix too; back-pointers give the ids. Time is linear in a word's length whatever it
is, so a word of a million letters is no special case. That holds for counts of all prefixes of a
text too, but for a prefix that ends within a character's own combining marks.

What stands before the merges (Unicode form, case, splitting) follows the tokenizer's own
file: common characters by plain rules, all others by the library's own normalizer.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import ahocorasick

#: Unicode White_Space.
BLANK = "\t-\r \x85\xa0  -     　"
CHUNK = re.compile(f"[^{BLANK}]+")
#: Below U+0250, composed form is the identity, and letters can be told without tables; U+0130 changes its length in lower case.
PLAIN = re.compile("[\x00-įı-ɏ]*")
#: Marks that end a word and, alone behind it, are a word of their own.
MARKS = frozenset(".,;:!?")
CACHED_CHUNKS = 350_000
CACHED_WORDS = 250_000
CACHED_PAIRS = 800_000
END = "\x00"  # behind a word's last symbol; byte-level spelling has no such character


def byte_letters() -> list[str]:
    """The spelling of each byte in byte-level vocabularies: printable ones stand for themselves, others follow from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


@cache
def joining() -> frozenset[str]:
    """Characters that composition may join to the one before, though they are no combining marks by class."""
    second = {d.split(" ")[1] for c in range(0x110000) if (d := unicodedata.decomposition(chr(c))) and d[0] != "<" and " " in d}
    return frozenset(chr(int(x, 16)) for x in second) | frozenset(map(chr, [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]))


def clusters(text: str) -> list[str]:
    """The text in pieces that composition leaves apart."""
    tied = joining()
    cuts = [i for i, c in enumerate(text) if not i or not (unicodedata.combining(c) or c in tied)]
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True)]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Recent(dict):
    """What ``make`` made of recent keys: up to ``most`` of them, and as many of the generation before. Keys of more than 64 characters are made anew."""

    def __init__(self, make: Callable[[str], object], most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str) -> object:
        out = self.old.get(key)
        if out is None:
            out = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = out
        return out


class WordBpe:
    """A tokenizer file whose model is BPE with an end-of-word suffix."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.library = Tokenizer.from_file(path)
        self.pieces: dict[int, tuple[str, ...]] = {}
        self.ranks: dict[tuple[str, str], int] = {}
        for rank, pair in enumerate(model["merges"]):
            self.ranks.setdefault(tuple(pair) if isinstance(pair, list) else tuple(pair.split(" ")), rank)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        # the file's own pattern, for text of plain characters
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(split["pattern"]["Regex"])
        letters = byte_letters()
        self.letters = letters
        self.bytes_of = {c: b for b, c in enumerate(letters)}
        self.spelled = {i: "".join(letters[b] for b in chr(i).encode()) for i in range(0x250) if i > 0x20}
        self.plain_spelling = all(self.spelled[i] == chr(i) for i in range(0x21, 0x7F))
        auto = ahocorasick.Automaton()
        for token, i in self.vocab.items():
            if token in self.special:
                continue
            ends = token.endswith(self.suffix)
            key = token[: -len(self.suffix)] + END if ends else token
            auto.add_word(key, (i, len(key)))
            body = token[: -len(self.suffix)] if ends else token
            self.pieces[i] = (*body[:-1], body[-1] + self.suffix) if ends and body else tuple(body)
        auto.make_automaton()
        self.automaton = auto
        self.text_of = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self._pairs: dict[int, bool] = {}
        self._alone: dict[int, bool] = {}
        self.longest = max(len(t) for t in self.vocab)
        self.letter = regex.compile(r"\p{L}+")
        self.other = regex.compile(r"[^\s\p{L}\p{N}]+")
        self._words = Recent(self.word_ids, CACHED_WORDS)
        self._counts = Recent(self.word_count, CACHED_WORDS)
        self._forms = Recent(self.library.normalizer.normalize_str, CACHED_WORDS)

    # -- the merges, for single tokens and pairs only

    def merged(self, symbols: tuple[str, ...]) -> list[str]:
        """BPE by its definition: the pair of least rank first, the leftmost of equals."""
        parts = list(symbols)
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                r = ranks.get((parts[k], parts[k + 1]))
                if r is not None and (best is None or r < best):
                    best, at = r, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def alone(self, token: int) -> bool:
        """Whether BPE makes this token of its own text."""
        if (known := self._alone.get(token)) is None:
            known = self._alone[token] = [self.vocab.get(x) for x in self.merged(self.pieces[token])] == [token]
        return known

    def compatible(self, left: int, right: int) -> bool:
        """Whether BPE makes just these two tokens of their joined text."""
        key = left << 32 | right
        if (known := self._pairs.get(key)) is None:
            known = [self.vocab.get(x) for x in self.merged(self.pieces[left] + self.pieces[right])] == [left, right]
            if len(self._pairs) >= CACHED_PAIRS:
                self._pairs.clear()
            self._pairs[key] = known
        return known

    # -- the table

    def table(self, spelled: str) -> tuple[list[int], list[int], list[int]]:
        """For each prefix of the word's spelling: its last token (-1: none), that token's length, the count of tokens."""
        n = len(spelled)
        last, size, count = [-1] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        alone, compatible, pairs = self.alone, self.compatible, self._pairs
        done = -1
        for end, (token, length) in self.automaton.iter(spelled):
            if end == done:
                continue
            start = end + 1 - length
            if start:
                before = last[start]
                if before < 0:
                    continue
                fits = pairs.get(before << 32 | token)
                if fits is None:
                    fits = compatible(before, token)
                if not fits:
                    continue
            elif not alone(token):
                continue
            last[end + 1], size[end + 1], count[end + 1] = token, length, count[start] + 1
            done = end  # it is the only one
        return last, size, count

    def spell(self, word: str) -> str:
        return "".join(map(self.letters.__getitem__, word.encode()))

    def word_ids(self, spelled: str) -> tuple[int, ...]:
        """The ids of one word in byte-level spelling, by following the back-pointers."""
        whole = spelled + END
        last, size, _ = self.table(whole)
        out, at = [], len(whole)
        while at:
            if last[at] < 0:
                raise ValueError("the vocabulary doesn't cover this word")
            out.append(last[at])
            at -= size[at]
        out.reverse()
        return tuple(out)

    def spelled_ids(self, spelled: str) -> tuple[int, ...]:
        """The same, with what was found before kept."""
        return self._words[spelled]

    def word_count(self, spelled: str) -> int:
        """The count that the table has for the whole word."""
        last, _, count = self.table(spelled + END)
        if last[-1] < 0:
            raise ValueError("the vocabulary doesn't cover this word")
        return count[-1]

    def words(self, chunk: str) -> list[str]:
        """The words, in byte-level spelling, that the tokenizer makes of a chunk without white space."""
        body, tail = (chunk, ()) if chunk[-1] not in MARKS else (chunk[:-1], (chunk[-1],))
        if body.isalpha():  # nearly all chunks: one word, perhaps a mark behind it
            if body.isascii():
                return [body.lower(), *tail]
            if PLAIN.fullmatch(body):
                return [self.spell(body.lower()), *tail]
        if PLAIN.fullmatch(chunk):
            return [self.spell(w) for w in self.split.findall(chunk.lower())]
        normal = self.library.normalizer.normalize_str(chunk)
        return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def parts(self, chunk: str) -> list[str]:
        """The chunk, cut before and behind strings of special tokens."""
        if self.special_split and "<|" in chunk:
            return [p for p in self.special_split.split(chunk) if p]
        return [chunk]

    def chunk_ids(self, chunk: str) -> tuple[int, ...]:
        """The ids of a chunk without white space. No word reaches across white space, so a text's ids are its chunks' ids."""
        out: tuple[int, ...] = ()
        for p in self.parts(chunk):
            if p in self.special:
                out += (self.special[p],)
            else:
                for w in self.words(p):
                    out += self.spelled_ids(w)
        return out

    def chunk_count(self, chunk: str) -> int:
        """The count of tokens of a chunk without white space, from its words' tables; no ids are made."""
        return sum(1 if p in self.special else sum(map(self._counts.__getitem__, self.words(p))) for p in self.parts(chunk))

    def encode(self, text: str) -> list[int]:
        return [i for c in CHUNK.findall(text) for i in self.chunk_ids(c)]

    def decode(self, ids: list[int]) -> str:
        """As the library's decode without a decoder: the tokens' spellings, joined by spaces."""
        return " ".join(self.text_of[i] for i in ids if i in self.text_of)

    # -- counts of prefixes

    def prefix_counts(self, text: str) -> list[int]:
        """The count of tokens of ``text[:k]`` for every k from 0 to len(text)."""
        out, base, pos = [0], 0, 0
        for m in CHUNK.finditer(text):
            out += [base] * (m.start() - pos)
            out += [base + x for x in self.chunk_prefixes(m.group())]
            base, pos = out[-1], m.end()
        out += [base] * (len(text) - pos)
        return out

    def chunk_prefixes(self, chunk: str) -> list[int]:
        """The counts of a chunk's prefixes of 1, 2, ... characters."""
        out, base, plain = [], 0, ""
        for p in self.parts(chunk):
            if p in self.special:  # until its last character is there, it is text like that before it
                out += [base + x for x in self.text_prefixes(plain + p)[len(plain) : -1]]
                base += (self.text_prefixes(plain)[-1] if plain else 0) + 1
                out.append(base)
                plain = ""
            else:
                out += [base + x for x in self.text_prefixes(p)]
                plain = p
        return out

    def text_prefixes(self, text: str) -> list[int]:
        """The counts of the prefixes of a text without white space and special tokens.

        Each word's table is filled once. A prefix that ends inside a word closes it there: its last token is one
        with the end-of-word suffix that fits the table's entries, and no longer than the longest of those.
        """
        if PLAIN.fullmatch(text):
            low = text.lower()
            return self._closed([(self.spell(w.group()), w.start(), w.end()) for w in self.split.finditer(low)], low)[1:]
        pieces = clusters(text)
        forms = [self._forms[x] for x in pieces]
        normal = "".join(forms)
        words = [(w, a, b) for w, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(normal)]
        closed = self._closed(words, normal)
        out, at, now, table = [], 0, 0, None
        for piece, form in zip(pieces, forms, strict=True):
            for k in range(1, len(piece)):  # a prefix that ends before all marks of a character are there
                while now + 1 < len(words) and words[now + 1][1] < at:
                    now += 1
                if table is None or table[0] != now:
                    table = (now, *self.table(words[now][0]))
                out.append(self._with_tail(words[now], normal, at, self.library.normalizer.normalize_str(piece[:k]), closed, table[1], table[3]))
            at += len(form)
            out.append(closed[at])
        return out

    def _closed(self, words: list[tuple[str, int, int]], normal: str) -> list[int]:
        """The counts of all prefixes of normalized text that consists of ``words`` (spelling, start, end)."""
        out = [0]
        for spelled, a, b in words:
            before = out[-1]
            if normal[a] == "'" and b - a > 1 and self.letter.match(normal, a + 1):  # a clitic; its prefixes are split otherwise
                out += [before + self._split_count(normal[a:k]) for k in range(a + 1, b + 1)]
                continue
            last, _, count = self.table(spelled)
            at = 0
            for ch in normal[a:b]:
                at += len(ch.encode())
                out.append(before + self._ended(spelled, at, "", last, count))
        return out

    def _split_count(self, normal: str) -> int:
        return sum(self._counts[self.spell(x)] for x in self.split.findall(normal))

    def _with_tail(self, word: tuple[str, int, int], normal: str, at: int, tail: str, closed: list[int], last: list[int], count: list[int]) -> int:
        """The count of tokens of ``normal[:at] + tail``, where ``word`` is that which ``at`` ends or stands in."""
        spelled, a, b = word
        if not at:
            return self._split_count(tail)
        if at <= b and normal[a] != "'" and any(x.fullmatch(tail) and x.fullmatch(normal, at - 1, at) for x in (self.letter, self.other)):
            return closed[a] + self._ended(spelled, len(normal[a:at].encode()), self.spell(tail), last, count)
        return closed[a] + self._split_count(normal[a:at] + tail)

    def _ended(self, spelled: str, end: int, tail: str, last: list[int], count: list[int]) -> int:
        """The count of tokens of the word ``spelled[:end] + tail``, from the table of ``spelled``."""
        low = max(0, end - self.longest)
        near, stop = spelled[low:end] + tail, end + len(tail)
        more: dict[int, tuple[int, int]] = {}  # what the table would have behind ``end``

        def fitting(e: int, suffix: str) -> Iterator[tuple[int, int]]:
            for start in range(max(0, e - self.longest), e):
                token = self.vocab.get(near[start - low : e - low] + suffix)
                if token is None:
                    continue
                before, so_far = (last[start], count[start]) if start <= end else more.get(start, (-1, 0))
                if self.alone(token) if start == 0 else before >= 0 and self.compatible(before, token):
                    yield token, so_far + 1

        for e in range(end + 1, stop + 1):
            more[e] = next(fitting(e, ""), (-1, 0))
        for _, n in fitting(stop, self.suffix):
            return n
        raise ValueError("the vocabulary doesn't cover this word")


_MODELS: dict[str, WordBpe] = {}


def model(path: str) -> WordBpe:
    """The tokenizer at ``path``, loaded once in each Python worker."""
    if path not in _MODELS:
        _MODELS[path] = WordBpe(path)
    return _MODELS[path]
