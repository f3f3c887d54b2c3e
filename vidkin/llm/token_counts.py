"""Word-piece token counts without building pieces.

A trie over the vocabulary carries, per node, a failure link and the number of tokens popped when
following it (linear longest-match). Reading a word moves along the trie; where no child fits, the
popped count is added and the failure link followed, so each character costs amortised constant time
and no piece is ever built. Only where some beginning of the word can't be covered by entries at all is there no
link; the rest of such a word is matched by trying (its length times that of the longest entry). A vocabulary
with every single byte, as with `every_entry`, has no such word. Counts of words are kept in a bounded memo.

With `every_entry` words are read as their UTF-8 bytes, in the vocabulary's own byte letters, so that
entries of part of a character count too and no character lies outside. A word ends with an end mark that is part of the vocabulary's word-final entries. Text is lower-cased
and cut into runs of letters, single digits and runs of other characters.

Defined results: null and empty texts, and white space alone, have 0 tokens; a character (with `every_entry`
a byte) outside the vocabulary counts as one token by itself; repeated rows are counted alike; an empty table gives an
empty result; other columns are ignored. Texts are read whole.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from .store import bound_batches

END = "\0"
_WORDS = regex.compile(r"[\p{L}\p{M}]+|\p{N}|[^\s\p{L}\p{M}\p{N}]+")
SCHEMA = "doc_id long, n_words long, n_tokens long"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[str, int]:
    """The public byte-level alphabet: printable Latin-1 bytes stand for themselves, others for 256 and up."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


_LETTERS = {b: c for c, b in _byte_letters().items()}


def byte_letters(word: str) -> str:
    """The word's UTF-8 bytes as letters of the byte-level alphabet; plain ASCII stays."""
    return word if word.isascii() and word.isprintable() and " " not in word else "".join(map(_LETTERS.__getitem__, word.encode("utf-8", "surrogatepass")))


def byte_vocabulary(path: str) -> list[str]:
    """All entries in byte letters, word-final ones with END; special tokens alone are left out."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special = {t["content"] for t in model.get("added_tokens", [])}
    out = []
    for e in model["model"]["vocab"]:
        final = e.endswith("</w>")
        body = e[:-4] if final else e
        if body and e not in special:
            out.append(body + END * final)
    return out


def load_vocabulary(path: str) -> list[str]:
    """Entries as text (UTF-8 decoded), word-final ones with END; those that aren't whole characters are left out."""
    letters, out = _byte_letters(), []
    with open(path, encoding="utf-8") as f:
        entries = json.load(f)["model"]["vocab"]
    for e in entries:
        final = e.endswith("</w>")
        body = e[:-4] if final else e
        if body and all(c in letters for c in body):
            try:
                out.append(bytes(letters[c] for c in body).decode() + END * final)
            except UnicodeDecodeError:
                continue
    return out


class Automaton:
    """child: per node a dict char -> node; link, popped: where to go when no child fits, and how many
    tokens are then complete. link < 0: the string read so far has no longest-match continuation."""

    def __init__(self, vocabulary: Iterable[str]):
        child: list[dict[str, int]] = [{}]
        token, depth = [False], [0]
        for entry in vocabulary:
            at = 0
            for c in entry:
                nxt = child[at].get(c)
                if nxt is None:
                    nxt = child[at][c] = len(child)
                    child.append({})
                    token.append(False)
                    depth.append(depth[at] + 1)
                at = nxt
            token[at] = True
        link, popped = np.full(len(child), -1, np.int64), np.zeros(len(child), np.int64)
        # Breadth first: a node's link comes from its parent's.
        order = [(n, c, 0) for c, n in child[0].items()]
        k = 0
        while k < len(order):
            node, c, parent = order[k]
            k += 1
            if token[node]:
                link[node], popped[node] = 0, 1
            elif parent:
                at, count = link[parent], popped[parent]
                while at >= 0 and c not in child[at]:
                    count += popped[at]
                    at = link[at] if at else -1
                if at >= 0:
                    link[node], popped[node] = child[at][c], count
            order += [(n, d, node) for d, n in child[node].items()]
        self.child, self.depth, self.link, self.popped = child, depth, link.tolist(), popped.tolist()

    def count(self, word: str) -> int:
        """Tokens of greedy longest matching of word + END; the end mark alone doesn't count."""
        child, link, popped = self.child, self.link, self.popped
        at = total = 0
        text = word + END
        n, i = len(text), 0
        while i <= n:
            c = text[i] if i < n else None
            nxt = child[at].get(c) if c is not None else None
            if nxt is not None:
                at, i = nxt, i + 1
                continue
            if at == 0:
                if c is None:
                    break
                if c != END:
                    total += 1  # outside the vocabulary
                i += 1
                continue
            if link[at] < 0:
                return total + self._plain(text[i - self.depth[at] :])
            total += popped[at]
            at = link[at]
        return total

    def _plain(self, text: str) -> int:
        """Greedy longest matching by trying; only where a prefix isn't coverable by entries."""
        total = i = 0
        while i < len(text):
            at, best, j = 0, 0, i
            while j < len(text) and (at := self.child[at].get(text[j], -1)) > 0:
                j += 1
                if self.link[at] == 0 and self.popped[at] == 1:
                    best = j
            total += bool(best) or text[i] != END
            i = best or i + 1
        return total


class Counts(dict):
    """word -> tokens; emptied at its bound."""

    def __init__(self, automaton: Automaton, letters: Callable[[str], str] = str, bound: int = 200_000):
        super().__init__()
        self.automaton, self.letters, self.bound = automaton, letters, bound

    def __missing__(self, word: str) -> int:
        if len(self) >= self.bound:
            self.clear()
        value = self[word] = self.automaton.count(self.letters(word))
        return value


def token_counts(docs: DataFrame, vocabulary: str | None = None, every_entry: bool = False) -> DataFrame:
    """doc_id, n_words, n_tokens for each row of docs. every_entry: read UTF-8 bytes, with all entries of the
    vocabulary; otherwise characters, with the entries that are whole characters."""
    path = vocabulary or default_vocabulary()
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = Counts(Automaton(byte_vocabulary(path)), byte_letters) if every_entry else Counts(Automaton(load_vocabulary(path)))
        for batch in batches:
            words = [_WORDS.findall((t or "").lower()) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "n_words": [len(w) for w in words], "n_tokens": [sum(map(counts.__getitem__, w)) for w in words]})

    return docs.select("doc_id", "text").mapInPandas(run, SCHEMA)
