"""Byte-pair encoding by what ends at each prefix.

The encoding of a string is the only sequence of tokens of which no two neighbours would have merged
otherwise. So the last token of each prefix's encoding follows from those of shorter prefixes: it is the
token t that ends there and that is compatible with the last token before t. One pass over a string gives
the exact encoding of all its prefixes. Tests hold this against the library.
"""

from __future__ import annotations

import json

from tokenizers import Tokenizer

#: Stands for the end-of-word suffix; belongs to the symbol before it.
MARK = ""
#: Neighbours whose compatibility is kept before the memo starts anew, and the longest string that any memo keeps.
MEMO, MEMO_LENGTH = 1_000_000, 64
INFINITE = 1 << 60


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


LETTERS = {i: c for i, c in enumerate(byte_letters())}


def letters(text: str) -> str:
    """A text's UTF-8 bytes in those letters."""
    return text.encode("utf-8", "surrogatepass").decode("latin-1").translate(LETTERS)


class Memo(dict):
    """From strings to what make() gives for them. Of two generations of entries the older goes when the younger is full."""

    def __init__(self, most: int):
        super().__init__()
        self.most = most
        self.old: dict[str, bytes] = {}

    def make(self, key: str) -> bytes:
        raise NotImplementedError

    def __missing__(self, key: str) -> bytes:
        if (out := self.old.get(key)) is None:
            out = self.make(key)
        if len(key) <= MEMO_LENGTH:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = out
        return out


class Merges:
    """A vocabulary and its ranked merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model = whole["model"]
        #: The library's normaliser and cutter, without its vocabulary.
        empty = model | {"vocab": {}, "merges": [], "unk_token": None}
        self.library = Tokenizer.from_str(json.dumps(whole | {"model": empty, "added_tokens": [], "post_processor": None, "decoder": None}))
        self.suffix = model.get("end_of_word_suffix") or ""
        own = (lambda t: t[: -len(self.suffix)] + MARK if t.endswith(self.suffix) else t) if self.suffix else str
        self.ids = {own(t): i for t, i in model["vocab"].items()}
        self.names = {i: t for t, i in model["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in whole["added_tokens"]}
        self.rank: dict[tuple[str, str], int] = {}
        self.parts: dict[str, tuple[str, str]] = {}
        for i, m in enumerate(model["merges"]):
            a, b = map(own, m.split(" ") if isinstance(m, str) else m)
            self.rank.setdefault((a, b), i)
            self.parts.setdefault(a + b, (a, b))
        #: From each end of a token to itself if it is a token (one object for all uses), else to an empty string.
        self.tails = {t[i:]: "" for t in self.ids for i in range(len(t)) if t[i:] != MARK}
        self.tails.update({t: t for t in self.ids if t != MARK})
        self.longest = max(len(t) for t in self.ids)
        self.left: dict[str, list[tuple[str, int]]] = {}
        self.right: dict[str, list[tuple[str, int]]] = {}
        self.known: dict[tuple[str, str], bool] = {}

    def spine(self, token: str, side: int) -> list[tuple[str, int]]:
        """The pieces that stand at one end of a token while it is merged, each with the rank of the merge that ends it."""
        memo = self.right if side else self.left
        if (out := memo.get(token)) is None:
            out, until, x = [], INFINITE, token
            while True:
                out.append((x, until))
                if x not in self.parts:
                    break
                until, x = self.rank[self.parts[x]], self.parts[x][side]
            memo[token] = out
        return out

    def compatible(self, a: str, b: str) -> bool:
        """Whether a and b stay apart when their letters are merged together."""
        if (out := self.known.get((a, b))) is None:
            out, before = True, self.spine(b, 0)
            for x, until_x in self.spine(a, 1):
                for y, until_y in before:
                    r = self.rank.get((x, y))
                    if r is not None and r < until_x and r <= until_y:  # of two equal merges the left one comes first
                        out = False
            if len(self.known) > MEMO:
                self.known.clear()
            self.known[a, b] = out
        return out

    def last_tokens(self, word: str) -> tuple[list[str], list[int]]:
        """For each prefix of a word in letters, the last token of its encoding and the number of tokens."""
        n = len(word)
        marked = n > 1 and word[-1] == MARK
        last, count = [""] * (n + 1), [0] * (n + 1)
        tail, known = self.tails.get, self.known.get
        for end in range(1, n + 1):
            if marked and end == n - 1:
                continue
            for start in range(end - 2 if marked and end == n else end - 1, -1, -1):
                if not (token := tail(word[start:end])):
                    if token is None:
                        break
                elif not start:
                    last[end], count[end] = token, 1
                    break
                elif before := last[start]:
                    if (apart := known((before, token))) is None:
                        apart = self.compatible(before, token)
                    if apart:
                        last[end], count[end] = token, count[start] + 1
                        break
        return last, count


class Transducer:
    """Takes a word's letters and gives out each token once no later letter can change it.

    The encoding of any longer prefix ends with one token of at most `lookahead` letters, so it goes on
    from the encoding of one of the last `lookahead` prefixes. A token that all of those share is stable.
    The lookahead is the longest token of the merge list. Only the window's last tokens and the tokens that
    are not yet stable are kept, however long the word is.
    """

    def __init__(self, merges: Merges):
        self.merges, self.lookahead = merges, merges.longest
        self.begin()

    def begin(self) -> None:
        self.word = ""  # the letters from self.base on
        self.base = 0
        self.last: list[str] = [""]  # last token of the prefix that ends at base + i
        self.out = 0  # where the next token to be given out starts

    def feed(self, symbols: str) -> list[str]:
        """Takes the next letters (with MARK after the one that ends a word); gives the tokens that are now stable."""
        last, word, first = self.last, self.word + symbols, not self.base
        tail, known, compatible = self.merges.tails.get, self.merges.known.get, self.merges.compatible
        n = len(word)
        marked = symbols[-1:] == MARK
        for end in range(len(self.word) + 1, n + 1):
            found, start = "", end
            if marked and end >= n - 1:
                if end < n:  # no symbol ends between a letter and its mark
                    last.append(found)
                    continue
                start -= 1
            while start:
                start -= 1
                if not (token := tail(word[start:end])):
                    if token is None:
                        break
                elif not start and first:
                    found = token
                elif before := last[start]:
                    if (apart := known((before, token))) is None:
                        apart = compatible(before, token)
                    if apart:
                        found = token
                        break
            last.append(found)
        self.word = word
        return self.settle() if n >= 2 * self.lookahead else []

    def chain(self, end: int) -> list[int]:
        """Where the tokens of the prefix up to `end` start, back to the first that is not given out."""
        starts, stop = [], self.out - self.base
        while end > stop:
            end -= len(self.last[end])
            starts.append(end)
        return starts[::-1]

    def settle(self) -> list[str]:
        n = len(self.word)
        ways = [self.chain(e) + [e] for e in range(n - self.lookahead + 1, n + 1) if self.last[e]]
        shared = set(ways[0]).intersection(*ways[1:])
        stop = max(shared)
        tokens = self.tokens(ways[0], stop)
        drop = max(0, min(stop, n - self.lookahead))
        self.out = self.base + stop
        self.word, self.last, self.base = self.word[drop:], self.last[drop:], self.base + drop
        return tokens

    def tokens(self, way: list[int], stop: int) -> list[str]:
        return [self.word[a:b] for a, b in zip(way, way[1:], strict=False) if b <= stop]

    def end(self) -> list[str]:
        """The rest of the word's tokens."""
        way = self.chain(len(self.word)) + [len(self.word)]
        out = self.tokens(way, len(self.word))
        self.begin()
        return out

    def encode(self, word: str) -> list[str]:
        """All tokens of a word in letters, fed in pieces of the lookahead."""
        step = self.lookahead
        if len(word) <= step:
            return self.feed(word) + self.end()
        out: list[str] = []
        at = 0
        while at < len(word):
            stop = at + step if at + step + 1 < len(word) else len(word)  # the mark stays with its letter
            out += self.feed(word[at:stop])
            at = stop
        return out + self.end()
