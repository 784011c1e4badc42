"""A byte-pair tokenizer compiled, on demand, into a deterministic transducer that counts tokens.

The transducer reads the bytes of one pre-token. Its state is what the rest of
the pre-token can still depend on: the start positions from which a
vocabulary token may reach beyond the byte just read, each with the last token
of the encoding up to there and its token count relative to the current one.
Byte-pair merging is such that a token sequence is the encoding of its text
exactly when every two neighbours stay two tokens when encoded alone, so one
start position fits at each step and the automaton is deterministic. States
and transitions are made when first met and kept; both are bounded by the
vocabulary, not by the corpus. A transition is annotated with the change of
the token count; a separate annotation holds for a byte that ends its
pre-token.
"""

from __future__ import annotations

import json
import re
import unicodedata

import regex

#: Unicode White_Space, which unlike str.split() leaves out U+001C to U+001F.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_SPLIT = re.compile(f"[{_SPACE}]+")
_GAP = re.compile(f"[{_SPACE}]")
_ODD = re.compile("[\x1c-\x1f]")
#: Scripts without combining marks, in which lower-casing first changes nothing.
_FAR = re.compile("[^\x00-\u024f]")
_STOP = re.compile("(?<=[a-z\xdf-\xf6\xf8-\xff])([.,])(?=[ \n]|$)")


def stretches(text: str) -> list[str]:
    """A text as stretches without white space that are tokenized each by itself.

    Where it is safe, letters are lowered first and a full stop or comma after
    a word stands alone, so that there are fewer different stretches.
    """
    if not _FAR.search(text):
        text = _STOP.sub(r" \1", text.lower()) if "<|" not in text else text
    return text.split() if not _ODD.search(text) else [w for w in _SPLIT.split(text) if w]


def drops_white_space(spec: dict) -> bool:
    """Whether a tokenizer file's ids of a text are those of its stretches: letters lowered, white space only a border, nothing added."""
    model, normalizer, split, after = spec["model"], spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}, spec.get("post_processor")
    steps = [n["type"] for n in normalizer.get("normalizers", [])]
    pattern = ((split.get("pretokenizers") or [{}])[0].get("pattern") or {}).get("Regex", "")
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) and t["content"].startswith("<|") for t in spec["added_tokens"])
    kept = {"[^\\s\\p{L}\\p{N}]+", "[\\p{L}]+", "[\\p{N}]"} <= set(pattern.split("|")) and "\\s" not in pattern.replace("[^\\s", "")
    removed = (split.get("pretokenizers") or [{}])[0].get("behavior") == "Removed"
    return model["type"] == "BPE" and bool(model.get("end_of_word_suffix")) and steps == ["NFC", "Replace", "Lowercase"] and kept and removed and plain and not after


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself where printable, else from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Transducer:
    """Token counts of white-space-free stretches under a tokenizer file of the word-end byte-level BPE kind."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        steps = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or steps != ["NFC", "Replace", "Lowercase"] or spec["post_processor"]:
            raise ValueError(f"{path}: only lower-casing byte-level BPE with word ends is compiled")
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"])) if spec["added_tokens"] else None
        letters, end = byte_letters(), model["end_of_word_suffix"]

        def symbol(token: str) -> tuple[bytes, bool]:
            last = token.endswith(end)
            return bytes(letters[c] for c in (token[: -len(end)] if last else token)), last

        vocabulary = [*model["vocab"]]
        number = {t: i for i, t in enumerate(vocabulary)}
        #: By token: the two it is merged from, and when; -1 for single bytes.
        self.halves: list[tuple[int, int]] = [(-1, -1)] * len(number)
        self.made = [-1] * len(number)
        self.merges: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(m.split(" ") if isinstance(m, str) else m for m in model["merges"]):
            a, b = number[pair[0]], number[pair[1]]
            self.merges.setdefault((a, b), rank)
            whole = number[pair[0] + pair[1]]
            if self.made[whole] < 0:
                self.made[whole], self.halves[whole] = rank, (a, b)
        self.inner, self.final = {}, {}
        for token, i in number.items():
            text, last = symbol(token)
            (self.final if last else self.inner)[text] = i
        self.stems = {t[:i] for t in (*self.inner, *self.final) for i in range(1, len(t))}
        self.fitting: dict[tuple[int, int], bool] = {}
        self.states: dict[tuple, int] = {}
        self.keys: list[tuple] = []
        self.next: list[dict[int, tuple[int, int]]] = []
        self.last: list[dict[int, int]] = []
        self.start = self._state(((b"", -1, 0),))

    def _state(self, key: tuple) -> int:
        """key: (bytes since a start position, token that ends there, its count less the current count), longest first."""
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = len(self.keys)
            self.keys.append(key)
            self.next.append({})
            self.last.append({})
        return found

    def _apart(self, a: int, b: int) -> bool:
        """Whether two neighbours stay two tokens.

        Going back in time, the later-made of the two is taken apart (the
        right one, where they were made by the same merge: merging runs from
        the left). No pair that then meets at their border may have a merge
        that would have come first.
        """
        before = 1 << 60
        while True:
            if self.merges.get((a, b), 1 << 60) < before:
                return False
            if self.made[a] > self.made[b]:
                before, a = self.made[a], self.halves[a][1]
            elif self.made[b] >= 0:
                before, b = self.made[b] + 1, self.halves[b][0]
            else:
                return True

    def _fits(self, before: int, token: int) -> bool:
        if before < 0:
            return True
        found = self.fitting.get((before, token))
        if found is None:
            found = self.fitting[before, token] = self._apart(before, token)
        return found

    def _token(self, state: int, byte: bytes, tokens: dict[bytes, int]) -> tuple[int, int]:
        for since, before, count in self.keys[state]:
            token = tokens.get(since + byte)
            if token is not None and self._fits(before, token):
                return token, count + 1
        raise ValueError(f"no token ends with byte {byte!r}")

    def step(self, state: int, byte: int) -> tuple[int, int]:
        """The next state and the change of the count, for a byte inside a pre-token."""
        found = self.next[state].get(byte)
        if found is None:
            read, stems = bytes((byte,)), self.stems
            token, change = self._token(state, read, self.inner)
            live = [(grown, before, count - change) for since, before, count in self.keys[state] if (grown := since + read) in stems]
            live.append((b"", token, 0))
            found = self.next[state][byte] = self._state(tuple(live)), change
        return found

    def finish(self, state: int, byte: int) -> int:
        """The change of the count for the last byte of a pre-token; the start state follows."""
        found = self.last[state].get(byte)
        if found is None:
            found = self.last[state][byte] = self._token(state, bytes((byte,)), self.final)[1]
        return found

    def count_piece(self, piece: bytes) -> int:
        state, total, step = self.start, 0, self.next
        for byte in piece[:-1]:
            state, change = step[state].get(byte) or self.step(state, byte)
            total += change
        return total + self.finish(state, piece[-1])

    def normal(self, text: str) -> str:
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def count_word(self, word: str) -> int:
        """Tokens of a stretch without white space. Special strings count one token each."""
        parts = self.special.split(word) if self.special and "<" in word else [word]
        return len(parts) - 1 + sum(self.count_piece(p.encode("utf-8")) for part in parts if part for p in self.pattern.findall(self.normal(part)))


class Memo(dict):
    """Values by stretch, in two generations of LIMIT each: what was not asked for since the last change goes."""

    LIMIT = 700_000

    def __init__(self):
        super().__init__()
        self.before: dict = {}

    def made(self, word: str):
        raise NotImplementedError

    def __missing__(self, word: str):
        value = self.before.get(word)
        if value is None:
            value = self.made(word)
        if len(word) <= 64:
            if len(self) >= self.LIMIT:
                self.before = dict(self)
                self.clear()
            self[word] = value
        return value


class WordCounts(Memo):
    """Path-compressed transitions: from the start state over a whole stretch back to it, with the tokens it emits."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer = transducer

    def made(self, word: str) -> int:
        return self.transducer.count_word(word)

    def of(self, text: str) -> int:
        return sum(map(self.__getitem__, stretches(text)))


#: What the machine has read of an open pre-token: a mode, the state before its last byte, and that byte.
#: Modes: nothing open, letters, other characters, or the beginning of a contraction.
State = tuple[str, tuple, int]
START: State = ("", (), 0)
_ENDINGS = {"s": "", "t": "", "m": "", "d": "", "r": "e", "v": "e", "l": "l"}
#: Places in a text where a pre-token ends whatever came before: white space, and between ASCII characters of different classes.
_RESET = rf"[{_SPACE}]|(?<=[A-Za-z])(?=[!-@\[-`{{-~])|(?<=[0-9])(?=[!-~])|(?<=[!-~])(?=[0-9])|(?<=[!-&(-/:-@\[-`{{-~])(?=[A-Za-z])"
_FIRST, _LAST = regex.compile(_RESET), regex.compile("(?r)" + _RESET)


class Machine:
    """The whole tokenizer as one machine over characters: pre-tokens are told apart by mode, tokens counted by the transducer."""

    def __init__(self, transducer: Transducer):
        self.transducer = transducer
        self.counts = WordCounts(transducer)

    def _class(self, c: str) -> str:
        if _GAP.match(c):
            return " "
        kind = unicodedata.category(c)[0]
        return kind if kind in "LN" else "O"

    def _feed(self, state: State, text: str, mode: str) -> tuple[State, int]:
        """More characters of the open pre-token, or of a new one where none is open."""
        t, total = self.transducer, 0
        at, data = t._state(state[1]) if state[0] else t.start, text.encode("utf-8")
        for byte in (bytes((state[2],)) if state[0] else b"") + data[:-1]:
            at, change = t.step(at, byte)
            total += change
        return (mode, t.keys[at], data[-1]), total

    def close(self, state: State) -> int:
        """Tokens that the open pre-token still emits."""
        mode, key, last = state
        if not mode:
            return 0
        if mode[0] == "'":  # no contraction after all: an apostrophe and perhaps a letter
            return sum(self.transducer.count_piece(c.encode()) for c in mode)
        return self.transducer.finish(self.transducer._state(key), last)

    def step(self, state: State, c: str) -> tuple[State, int]:
        mode, kind = state[0], self._class(c)
        if mode == "'" and c in _ENDINGS:
            return (START, self.transducer.count_piece(f"'{c}".encode())) if not _ENDINGS[c] else (("'" + c, (), 0), 0)
        if len(mode) == 2 and c == _ENDINGS[mode[1]]:
            return START, self.transducer.count_piece((mode + c).encode())
        if len(mode) == 2 and kind == "L":
            return self._and(self.transducer.count_piece(b"'"), self._feed(START, mode[1] + c, "L"))
        if mode == "'" and kind == "O":
            return self._feed(START, "'" + c, "O")
        if mode == kind and kind in "LO":
            return self._feed(state, c, mode)
        total = self.close(state)
        if kind == " ":
            return START, total
        if kind == "N":
            return START, total + self.transducer.count_piece(c.encode("utf-8"))
        return (("'", (), 0), total) if c == "'" else self._and(total, self._feed(START, c, kind))

    @staticmethod
    def _and(count: int, result: tuple[State, int]) -> tuple[State, int]:
        return result[0], count + result[1]

    def run(self, state: State, text: str) -> tuple[State, int]:
        total = 0
        for c in self.transducer.normal(text):
            state, change = self.step(state, c)
            total += change
        return state, total

    def cut(self, text: str, size: int) -> list[str]:
        """Pieces of about ``size`` characters: none begins with a character that could join the one before it, none splits a special string."""
        special, cuts, at = self.transducer.special, [0], size
        while at < len(text):
            while at < len(text) and text[at] >= "\u0300":
                at += 1
            for found in special.finditer(text, max(0, at - 64), at + 64) if special else ():
                if found.start() < at < found.end():
                    at = found.end()
            if at < len(text) and text[at] < "\u0300":
                cuts.append(at)
                at += size
        return [text[i:j] for i, j in zip(cuts, [*cuts[1:], len(text)], strict=True)]

    def map_of(self, piece: str) -> ChunkMap:
        """A piece's map. Between its first and its last reset the count does not depend on the entry state; what is open at its end is run from the start state."""
        out = ChunkMap("")
        for n, part in enumerate(self.transducer.special.split(piece) if self.transducer.special and "<|" in piece else [piece]):
            if n:
                out = out.then(ChunkMap("", True, 1, START), self)
            first = _FIRST.search(part)
            if not first:
                out = out.then(ChunkMap(part), self)
            else:
                last = _LAST.search(part).end()
                state, count = self.run(START, part[last:])
                out = out.then(ChunkMap(part[: first.start()], True, self.counts.of(part[first.start() : last]) + count, state), self)
        return out


class ChunkMap:
    """A chunk as a map from the state it is entered in to the state it is left in and the tokens emitted on the way.

    Up to its first reset what a chunk does depends on the entry state: that
    ``head`` is run for the states met. At a reset every state becomes the
    start state, so from there on the ``count`` and the ``exit`` state are
    known. A chunk without a reset is all head.
    """

    __slots__ = ("head", "reset", "count", "exit")

    def __init__(self, head: str, reset: bool = False, count: int = 0, exit: State = START):
        self.head, self.reset, self.count, self.exit = head, reset, count, exit

    def apply(self, entry: State, machine: Machine) -> tuple[State, int]:
        state, count = machine.run(entry, self.head)
        return (self.exit, count + machine.close(state) + self.count) if self.reset else (state, count)

    def then(self, other: ChunkMap, machine: Machine) -> ChunkMap:
        """The map of both chunks in a row; associative."""
        if not self.reset:
            return ChunkMap(self.head + other.head, other.reset, other.count, other.exit)
        state, count = other.apply(self.exit, machine)
        return ChunkMap(self.head, True, self.count + count, state)

    def total(self, machine: Machine) -> int:
        """The count when the text begins and ends with this chunk."""
        state, count = self.apply(START, machine)
        return count + machine.close(state)


def scan(maps: list[ChunkMap], machine: Machine) -> ChunkMap:
    """All maps composed, neighbours first, in a tree of logarithmic depth."""
    while len(maps) > 1:
        maps = [maps[i].then(maps[i + 1], machine) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    return maps[0] if maps else ChunkMap("")
