"""BPE encoding by backtracking over longest token matches, and decoding by an offset table.

The tokenizer file gives a vocabulary, ranked merges, an end-of-word mark and a
word pattern; nothing is trained. A text is cut at the added tokens, then
normalised (NFC, lower case) and cut into words, and each word is encoded
exactly as if its merges had been applied one by one:

* An Aho-Corasick automaton over the vocabulary gives the longest token that
  starts at each place of a word, in one run over it.
* From the left, the longest token is tried that is *compatible* with the one
  before it, then the next shorter one that is a prefix of it. Where none is
  left, the encoder goes one token back; a place once found dead is not tried
  again, so the work is linear in the word.
* Two tokens are compatible if no merge across their border would have come
  before the merges that made them. The answers are kept in a pair table.

Encoded words are kept in a dictionary of bounded size, which changes no
result. Decoding reads the tokens' strings from one block of bytes by an offset
table, and joins them by blanks, as a tokenizer without a decoder does.

Null texts are empty texts: no ids, and the empty string decoded. Texts of any
length are encoded in blocks that end at white space.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import in_slices, map_exactly, text_or_empty

#: Words kept encoded by a worker before it starts afresh.
KEPT_WORDS = 200_000
#: Characters of a text, and ids, that are worked on at once.
BLOCK_CHARS = 1_000_000
BLOCK_IDS = 250_000
#: Token pairs whose compatibility is remembered before a worker starts afresh.
KEPT_PAIRS = 100_000
#: Stands for the end-of-word mark inside the automaton; no byte is written so.
END = "\ue000"
FOREVER = 1 << 60


def byte_letters() -> list[str]:
    """The printable letter of each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(others)) for b in range(256)]


class Merges:
    """The vocabulary with what decides whether two tokens may stand side by side."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        self.marked = {(t[: -len(suffix)] + END if suffix and t.endswith(suffix) else t): i for t, i in vocab.items()}
        self.length = {i: len(t) for t, i in self.marked.items()}
        self.rank: dict[int, int] = dict.fromkeys(vocab.values(), -1)
        self.halves: dict[int, tuple[int, int]] = {}
        self.made: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(merges):
            token = vocab[a + b]
            self.rank[token] = rank
            self.halves[token] = (vocab[a], vocab[b])
            self.made[vocab[a], vocab[b]] = rank
        self.pairs: dict[tuple[int, int], bool] = {}
        sound = {t: i for t, i in self.marked.items() if self._sound(i)}
        self.automaton = ahocorasick.Automaton()
        for t, i in sound.items():
            self.automaton.add_word(t, (len(t), i))
        self.automaton.make_automaton()
        self.shorter: dict[int, int | None] = {}
        for t, i in sound.items():
            self.shorter[i] = next((sound[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in sound), None)

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """Tokens that bordered the token's outer side while it grew, each with the rank that ended it."""
        out, until = [], FOREVER
        while True:
            out.append((token, until))
            if token not in self.halves:
                return out
            until = self.rank[token]
            token = self.halves[token][side]

    def _crossed(self, left: int, right: int, before: int) -> bool:
        """Does a merge over the border come before rank ``before`` and before its two sides are gone?

        Equal merges are applied from left to right: one inside the left side goes
        first, one inside the right side goes after.
        """
        rights = self._edge(right, 0)
        for x, x_until in self._edge(left, 1):
            for y, y_until in rights:
                rank = self.made.get((x, y))
                if rank is not None and rank < x_until and rank <= y_until and rank < before:
                    return True
        return False

    def _sound(self, token: int) -> bool:
        """Is the token what its own string is encoded as?"""
        if token not in self.halves:
            return True
        a, b = self.halves[token]
        return self._sound(a) and self._sound(b) and not self._crossed(a, b, self.rank[token])

    def compatible(self, left: int, right: int) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            known = self.pairs[left, right] = not self._crossed(left, right, FOREVER)
        return known

    def encode(self, word: str) -> list[int]:
        """Ids of one word, written in byte letters with the end mark."""
        longest: list[int | None] = [None] * len(word)
        reach = [0] * len(word)
        for end, (n, token) in self.automaton.iter(word):
            if n > reach[end - n + 1]:
                reach[end - n + 1], longest[end - n + 1] = n, token
        ids: list[int] = []
        dead = set()
        at, token = 0, longest[0]
        while at < len(word):
            while token is not None:
                end = at + self.length[token]
                if end not in dead and (not ids or self.compatible(ids[-1], token)):
                    break
                token = self.shorter[token]
            if token is not None:
                ids.append(token)
                at = end
                token = longest[at] if at < len(word) else None
            elif ids:
                dead.add(at)
                last = ids.pop()
                at -= self.length[last]
                token = self.shorter[last]
            else:
                raise ValueError(f"no tokens for {word!r}")
        return ids


class Words(dict):
    """Word to packed ids; starts afresh at its bound."""

    def __init__(self, merges: Merges, end: str):
        super().__init__()
        self.merges, self.end = merges, end
        self.letters = dict(enumerate(byte_letters()))

    def __missing__(self, word: str) -> bytes:
        spelled = word.encode().decode("latin-1").translate(self.letters) + self.end
        packed = np.array(self.merges.encode(spelled), dtype="<u4").tobytes()
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = packed
        return packed


class Tokenizer:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        suffix = model.get("end_of_word_suffix") or ""
        self.words = Words(Merges(model["vocab"], merges, suffix), END if suffix else "")
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.added = {t: np.array([i], dtype="<u4").tobytes() for t, i in added.items()}
        alternatives = "|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True))
        self.specials = regex.compile(f"({alternatives})") if added else None
        self.pattern = regex.compile(word_pattern(spec))
        strings = {i: t for t, i in {**model["vocab"], **added}.items()}
        texts = [strings.get(i, "").encode() + b" " for i in range(max(strings) + 1)]
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        self.block = np.frombuffer(b"".join(texts), dtype=np.uint8)

    def pieces(self, text: str) -> Iterator[str]:
        """Blocks of a text that end before white space."""
        at = 0
        while len(text) - at > BLOCK_CHARS:
            cut = regex.compile(r"\p{White_Space}").search(text, at + BLOCK_CHARS)
            end = cut.start() if cut else len(text)
            yield text[at:end]
            at = end
        yield text[at:]

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.specials and "<" in text:
            parts = self.specials.split(text)
        else:
            parts = [text]
        out = []
        for part in parts:
            if part in self.added:
                out.append(self.added[part])
                continue
            for piece in self.pieces(part):
                # letter by letter: no special form for a sigma at a word's end
                plain = unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower()
                out.append(b"".join(map(self.words.__getitem__, self.pattern.findall(plain))))
        return b"".join(out)

    def decode(self, packed: bytes) -> Iterator[bytes]:
        """The decoded text in UTF-8, block by block."""
        ids = np.frombuffer(packed, dtype="<u4")
        for at in range(0, len(ids), BLOCK_IDS):
            some = ids[at : at + BLOCK_IDS]
            start = self.offsets[some]
            size = self.offsets[some + 1] - start
            ends = np.cumsum(size)
            place = np.arange(ends[-1]) + np.repeat(start - ends + size, size)
            joined = self.block[place]
            yield (joined[:-1] if at + BLOCK_IDS >= len(ids) else joined).tobytes()


def word_pattern(spec: dict) -> str:
    """The words' pattern, with white space by its Unicode property."""
    steps = spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]])
    pattern = next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split")
    return pattern.replace(r"\s", r"\p{White_Space}")


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def encode(docs: DataFrame, path: str, keep_ids: bool = True, keep_text: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), and the packed ids and decoded text if asked for."""
    fields = "doc_id {}, n_tokens long, ids_sha256 string, decoded_sha256 string".format(dict(docs.dtypes)["doc_id"])
    fields += ", ids binary" * keep_ids + ", decoded string" * keep_text

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = tokenizer(path)
        for frame in in_slices(frames):
            rows = []
            for text in frame["text"]:
                packed = coder.encode(text)
                digest, parts = hashlib.sha256(), []
                for part in coder.decode(packed):
                    digest.update(part)
                    if keep_text:
                        parts.append(part)
                row = (len(packed) // 4, hashlib.sha256(packed).hexdigest(), digest.hexdigest())
                rows.append(row + (packed,) * keep_ids + (b"".join(parts).decode(),) * keep_text)
            names = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids + ["decoded"] * keep_text
            out = pd.DataFrame(rows, columns=names)
            out.insert(0, "doc_id", frame["doc_id"].to_numpy())
            yield out

    return map_exactly(docs.select("doc_id", text_or_empty().alias("text")), run, fields)
