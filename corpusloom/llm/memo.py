"""Exact tokenisation with the ``tokenizers`` library, remembered by word.

A text is cut only where no token of its tokenizer can span the cut. Each distinct piece is
encoded by the library itself, once per worker, and the pieces are put together again. Texts
with white space that the argument doesn't cover go to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

#: Pieces that a worker remembers, at about 180 bytes each; longer ones than LONG aren't remembered.
#: The first FREE come in at once, others when they come again in another slice of texts.
MEMO_ENTRIES, FREE, LONG = 500_000, 200_000, 64
#: Words that are encoded as lines of one text.
_AT_ONCE = 512
#: Longer texts are encoded by parts of about so many characters, where the tokenizer allows it.
PART_CHARS = 1 << 18
#: Marks that never share a token with a letter before them, in either tokenizer.
_TAIL = ".,;:!?"
_SPACES = str.maketrans("\t\n\r", "   ")
_CUT = re.compile(r"\S(?= \S)")


@lru_cache(maxsize=4)
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for every core
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def _spec(path: str) -> dict:
    return json.loads(load(path).to_str())


def _plain_specials(spec: dict) -> bool:
    """Special strings neither hold white space nor swallow it from beside them."""
    return not any(a["lstrip"] or a["rstrip"] or re.search(r"\s", a["content"]) for a in spec.get("added_tokens", []))


def drops_white_space(path: str) -> bool:
    """True if the tokenizer turns runs of white space into one space and then drops it.

    Then no token, merge or special string reaches over ASCII white space, and normal form C
    composes nothing over it, so a text's tokens are those of its white-space-separated pieces.
    """
    spec = _spec(path)
    norm = spec.get("normalizer") or {}
    pre = spec.get("pre_tokenizer") or {}
    split = (pre.get("pretokenizers") or [pre])[0]
    return _plain_specials(spec) and split.get("type") == "Split" and split.get("behavior") == "Removed" and bool(split.get("invert")) and any(
        p.get("type") == "Replace" and p.get("pattern") == {"Regex": r"\s+"} and p.get("content") == " " for p in norm.get("normalizers", [norm])
    )


def starts_words_at_spaces(path: str) -> bool:
    """True for byte-level pre-tokens in which a space only ever begins a token.

    Between two characters that are not white space, a single space or newline then always
    begins a token, and what stands on either side is encoded alone.
    """
    spec = _spec(path)
    pre = spec.get("pre_tokenizer") or {}
    return _plain_specials(spec) and not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")


def _each(t, pieces: list[str]) -> list[list[int]]:
    return [e.ids for e in t.encode_batch_fast(pieces, add_special_tokens=False)]


def _bytes(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


class _Memo:
    """What comes first is remembered, and then what comes again; the rest is encoded each time."""

    def __init__(self, path: str):
        self.t, self.memo, self.met = load(path), {}, bytearray(1 << 22)  # met: by hash, what has come before

    def learn(self, words: set[str]) -> dict:
        """Values of words that the memo lacks; a letter and marks after it are encoded apart."""
        get, new, bare, cut = self.memo.get, {}, set(), []
        for w in words:
            core = w.rstrip(_TAIL)
            if len(core) < len(w) and core and core[-1].isalpha():
                value = get(core)
                if value is None:
                    bare.add(core)
                    cut.append((w, core))
                else:
                    new[w] = self.join(value, w[len(core):])
            else:
                bare.add(w)
        bare = list(bare)
        new.update(zip(bare, self.values(bare)))
        for w, core in cut:
            new[w] = self.join(new[core], w[len(core):])
        room = MEMO_ENTRIES - len(self.memo)
        if room > 0:
            keep, met, last = [], self.met, len(self.met) - 1
            free = FREE - len(self.memo)
            for w, x in new.items():
                if len(w) <= LONG:
                    at = hash(w) & last
                    if met[at] or len(keep) < free:
                        keep.append((w, x))
                    met[at] = 1
            self.memo.update(keep[:room])
        return new


class Counter(_Memo):
    """Counts the tokens of whole texts."""

    def __init__(self, path: str):
        super().__init__(path)
        self.by_word, self.marks = drops_white_space(path), {}

    def values(self, words: list[str]) -> list[int]:
        return list(map(len, _each(self.t, words)))

    def join(self, core: int, tail: str) -> int:
        if tail not in self.marks:
            self.marks[tail] = len(self.t.encode(tail, add_special_tokens=False).ids)
        return core + self.marks[tail]

    def count(self, texts: list[str]) -> list[int]:
        if not self.by_word:
            return [len(e.ids) for e in self.t.encode_batch(texts, add_special_tokens=False)]
        get, out, waiting, missing = self.memo.get, [], [], set()
        for k, text in enumerate(texts):
            words = text.translate(_SPACES).split(" ") if "\t" in text or "\r" in text else text.replace("\n", " ").split(" ")
            got = list(map(get, words))
            if None in got:
                lack = [w for w, n in zip(words, got) if n is None]
                waiting.append((k, lack))
                missing.update(lack)
                out.append(sum(n for n in got if n is not None))
            else:
                out.append(sum(got))
        if missing:
            new = self.learn(missing)
            for k, lack in waiting:
                out[k] += sum(map(new.__getitem__, lack))
        return out


class Encoder(_Memo):
    """Gives the ids of whole texts as bytes of little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        super().__init__(path)
        self.by_word, self.marks = starts_words_at_spaces(path), {}
        self.newline, self.heads = self.whole("\n"), {}  # heads: first words of lines
        self.line_end = int.from_bytes(self.newline, "little") if len(self.newline) == 4 else -1

    def whole(self, text: str) -> bytes:
        return _bytes(self.t.encode(text, add_special_tokens=False).ids)

    def _lines(self, words: list[str], lead: str) -> list[bytes]:
        """Ids of words that neither begin nor end with white space, many at a time as lines of one text: a newline between them is a token alone."""
        out = []
        some = [words[a:a + _AT_ONCE] for a in range(0, len(words), _AT_ONCE)]
        for group, e in zip(some, self.t.encode_batch_fast([lead + ("\n" + lead).join(x) for x in some], add_special_tokens=False)):
            ids = np.array(e.ids, dtype="<u4")
            cuts = np.flatnonzero(ids == self.line_end)
            if len(cuts) == len(group) - 1:
                data, ends = ids.tobytes(), [*(4 * cuts).tolist(), 4 * len(ids)]
                out += [data[a:b] for a, b in zip([0, *(4 * cuts + 4).tolist()], ends)]
            else:
                out += map(_bytes, _each(self.t, [lead + w for w in group]))
        return out

    def values(self, words: list[str]) -> list[bytes]:
        """Ids with the space before them; b"x" marks what must not be cut off from its text."""
        good = [w for w in words if w and w.strip() == w]
        if len(good) == len(words):
            return self._lines(words, " ")
        found = dict(zip(good, self._lines(good, " ")))
        return [found.get(w, b"x") for w in words]

    def join(self, core: bytes, tail: str) -> bytes:
        if core == b"x":
            return core
        if tail not in self.marks:
            self.marks[tail] = self.whole(tail)
        return core + self.marks[tail]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return [self.whole(t) for t in texts]
        out = []
        for text in texts:
            if len(text) <= PART_CHARS:
                out.append(None)
            else:  # part by part, so that memory doesn't grow with the words of a text
                out.append(b"".join(self._parts([(p, bool(k))])[0] for k, p in enumerate(parts(text))))
        short = iter(self._parts([(t, False) for t, x in zip(texts, out) if x is None]))
        return [next(short) if x is None else x for x in out]

    def _parts(self, texts: list[tuple[str, bool]]) -> list[bytes]:
        """Ids of texts, each with a space before it or not."""
        get, plans, missing = self.memo.get, [], set()
        for text, _ in texts:
            # a leading space stands in for the one that the first word lacks
            lines = [line.split(" ") for line in text.split("\n")]
            got = [list(map(get, line)) for line in lines]
            for line, have in zip(lines, got):
                if None in have:
                    missing.update(w for w, x in zip(line, have) if x is None)
            plans.append((lines, got))
        new = self.learn(missing) if missing else {}
        out, heads, places = [], [], []
        for k, (lines, got) in enumerate(plans):
            spaced = texts[k][1]
            parts, first = [], []
            for line, have in zip(lines, got):
                if None in have:
                    have = [new[w] if x is None else x for w, x in zip(line, have)]
                if b"x" in have:
                    parts = None
                    break
                first.append(None if spaced and not first else line[0])
                parts.append(b"".join(have if first[-1] is None else have[1:]))
            if parts is None:
                out.append(self.whole(" " * spaced + texts[k][0]))
            else:
                # the first word of each line has no space before it
                places.append((len(out), first, parts))
                heads += first
                out.append(b"")
        want = {w for w in heads if w is not None}
        bare = [w for w in want if w not in self.heads]
        start = dict(zip(bare, self._lines(bare, "")))
        for w in want.difference(start):
            start[w] = self.heads[w]
        if len(self.heads) < MEMO_ENTRIES // 8:
            self.heads.update((w, x) for w, x in start.items() if len(w) <= LONG)
        start[None] = b""
        for k, first, parts in places:
            out[k] = self.newline.join([start[w] + p for w, p in zip(first, parts)])
        return out


def parts(text: str) -> list[str]:
    """Cuts a text at single spaces between characters that aren't white space; the spaces go.

    A token begins at each such space, so the parts, with the space before all but the first,
    have the tokens of the text.
    """
    out, at = [], 0
    while len(text) - at > PART_CHARS and (m := _CUT.search(text, at + PART_CHARS)):
        out.append(text[at:m.end()])
        at = m.end() + 1
    return [*out, text[at:]]


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One for each worker process, so that what it remembers serves all its tasks."""
    return Counter(path)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
