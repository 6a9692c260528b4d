"""Token counts by a linear longest-match automaton.

The vocabulary is a trie of byte strings. Every node has a failure link and the number of tokens that are popped when
it is followed, so that a word's greedy longest-match pieces are counted in one pass over its bytes, without building
a piece. Words are runs without ASCII white space, each with the word mark (a space) before it.

A word that the vocabulary can't spell counts as one unknown token. Counts of words seen are kept per task, within a bound.

Edge cases: null or blank texts have no words and no tokens; repeated rows give repeated results; extra columns aren't read.
"""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
KEPT_WORDS = 200_000


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes as: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def byte_vocabulary(path: str) -> dict[str, int]:
    with open(path, encoding="utf-8") as f:
        return json.load(f)["model"]["vocab"]


def vocabulary_bytes(vocabulary: Iterable[str]) -> list[bytes]:
    letters = byte_letters()
    return [bytes(letters[c] for c in token) for token in vocabulary if all(c in letters for c in token)]


class Automaton:
    """edges: node << 8 | byte -> node; failure link and popped tokens per node (-1: no way to go on); pops at a word's end."""

    def __init__(self, tokens: Iterable[bytes]):
        self.edges: dict[int, int] = {}
        letters, final = [(-1, 0)], [False]
        for token in tokens:
            node = 0
            for byte in token:
                key = node << 8 | byte
                if key not in self.edges:
                    self.edges[key] = len(final)
                    letters.append((node, byte))
                    final.append(False)
                node = self.edges[key]
            final[node] = bool(token)
        n = len(final)
        self.fail, self.pop, self.end = [-1] * n, [0] * n, [-1] * n
        children: list[list[int]] = [[] for _ in range(n)]
        for node in range(1, n):
            children[letters[node][0]].append(node)
        self.end[0] = 0
        queue = deque(children[0])
        while queue:
            node = queue.popleft()
            queue.extend(children[node])
            parent, byte = letters[node]
            if final[node]:
                self.fail[node], self.pop[node] = 0, 1
            else:
                at, popped = self.fail[parent], self.pop[parent]
                while at >= 0 and (at << 8 | byte) not in self.edges:
                    popped += self.pop[at]
                    at = self.fail[at]
                if at >= 0:
                    self.fail[node], self.pop[node] = self.edges[at << 8 | byte], popped
            to = self.fail[node]
            if to >= 0 and self.end[to] >= 0:
                self.end[node] = self.pop[node] + self.end[to]

    def count(self, word: bytes) -> int:
        edges, fail, pop = self.edges, self.fail, self.pop
        node = total = 0
        for byte in word:
            while (to := edges.get(node << 8 | byte)) is None:
                total += pop[node]
                node = fail[node]
                if node < 0:
                    return 1
            node = to
        return total + self.end[node] if self.end[node] >= 0 else 1


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_words, n_tokens. path: a byte-level vocabulary, present on every executor."""

    def run(batches):
        automaton = Automaton(vocabulary_bytes(byte_vocabulary(path)))
        known: dict[str, int] = {}
        for pdf in batches:
            words, tokens = [], []
            for text in pdf["text"].fillna("").astype(str):
                found = WORDS.findall(text)
                total = 0
                for word in found:
                    n = known.get(word)
                    if n is None:
                        n = automaton.count(b" " + word.encode("utf-8", "surrogatepass"))
                        if len(known) >= KEPT_WORDS:
                            known.clear()
                        if len(word) < 64:
                            known[word] = n
                    total += n
                words.append(len(found))
                tokens.append(total)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_words": words, "n_tokens": tokens})

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInPandas(run, "doc_id long, n_words long, n_tokens long")
