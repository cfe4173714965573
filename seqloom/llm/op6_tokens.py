"""Token counts by a linear longest-match automaton.

A word's tokens are the vocabulary pieces that greedy longest match takes from the
left, the end of the word being a character of its own. The vocabulary is a trie;
each node has a failure link (where matching goes on once the node's text can't be
continued) and the number of tokens that are then complete. So a word is counted in
one pass over its characters and no piece is ever built. A word that no sequence of
pieces covers counts as one unknown token.

The vocabulary, a public file whose path is a parameter, says how words are found:
compatibility with its normaliser (NFC, lower case) and its split pattern. Counts of
distinct words are remembered in each task.

Defined results: null and empty texts have no words and no tokens; rows are counted
one by one, so ties, repeated rows, empty tables and further columns change nothing.
Long texts are read in bounded runs of matches, whole; a word of any length takes
time in proportion to it.
"""

from __future__ import annotations

import json
import unicodedata
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import map_batches, table, texts_of
from seqloom.llm.op7_bpe import byte_characters

REMEMBERED = 500_000
AT_ONCE = 200_000
END = "\n"  # no byte stands for it


class LongestMatch:
    """The automaton. ``count`` gives a word's number of tokens, None where the pieces don't cover it; a free piece is matched and not counted."""

    def __init__(self, pieces, free: str = ""):
        self.next: list[dict[str, int]] = [{}]
        piece = [False]
        for p in chain(pieces, [free] * bool(free)):
            at = 0
            for c in p:
                to = self.next[at].get(c)
                if to is None:
                    to = self.next[at][c] = len(self.next)
                    self.next.append({})
                    piece.append(False)
                at = to
            piece[at] = True
        uncounted = at if free else -1
        n = len(self.next)
        self.link: list[int] = [-1] * n
        self.popped = [0] * n
        level = [0]
        while level:
            below = []
            for u in level:
                for c, v in self.next[u].items():
                    if piece[v]:
                        self.link[v], self.popped[v] = 0, int(v != uncounted)
                    else:
                        z, popped = self.link[u], self.popped[u]
                        while z >= 0 and c not in self.next[z]:
                            popped += self.popped[z]
                            z = self.link[z]
                        if z >= 0:
                            self.link[v], self.popped[v] = self.next[z][c], popped
                    below.append(v)
            level = below

    def count(self, word: str) -> int | None:
        follow, link, popped = self.next, self.link, self.popped
        at = total = 0
        for c in word:
            while (to := follow[at].get(c)) is None:
                total += popped[at]
                at = link[at]
                if at < 0:
                    return None
            at = to
        while at:
            total += popped[at]
            at = link[at]
            if at < 0:
                return None
        return total


class WordCounter:
    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        end = spec["model"]["end_of_word_suffix"]
        # where no piece takes the word's end along, the end is no token of its own
        self.automaton = LongestMatch((p.removesuffix(end) + END if p.endswith(end) else p for p in spec["model"]["vocab"]), free=END)
        self.matches = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.shown = dict(enumerate(byte_characters()))
        self.known: dict[str, int] = {}

    def tokens(self, word: str) -> int:
        """The number of tokens, minus one for an unknown word."""
        found = self.automaton.count(word.encode().decode("latin-1").translate(self.shown) + END)
        return -1 if found is None else found

    def count(self, text: str) -> tuple[int, int, int]:
        """(words, tokens, unknown words)."""
        found = (m[0] for m in self.matches.finditer(low)) if len(low := unicodedata.normalize("NFC", text).lower()) > 4 * AT_ONCE else iter(self.matches.findall(low))
        words = tokens = unknown = 0
        while part := list(islice(found, AT_ONCE)):
            words += len(part)
            try:
                counts = list(map(self.known.__getitem__, part))
            except KeyError:
                fresh = {w for w in part if w not in self.known}
                if len(self.known) + len(fresh) > REMEMBERED:
                    self.known, fresh = {}, set(part)
                self.known.update((w, self.tokens(w)) for w in fresh)
                counts = list(map(self.known.__getitem__, part))
            bad = counts.count(-1)
            tokens += sum(counts) + 2 * bad
            unknown += bad
        return words, tokens, unknown


def token_counts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str | None = None) -> DataFrame:
    """``(id, n_words, n_tokens, n_unknown)``, a row a row."""

    def make():
        import public_tokenizers

        counter = WordCounter(path or public_tokenizers.path("word_bpe_49k.json"))

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts = [counter.count(t) for t in texts_of(batch.column(1))]
            words, tokens, unknown = zip(*counts, strict=True) if counts else ((), (), ())
            return pa.RecordBatch.from_pydict({id_column: batch.column(0), "n_words": pa.array(words, pa.int64()), "n_tokens": pa.array(tokens, pa.int64()), "n_unknown": pa.array(unknown, pa.int64())})

        return run

    plain = docs.select(id_column, F.col(text_column).cast("string").alias("_text"))
    schema = plain.drop("_text").schema.add("n_words", "long").add("n_tokens", "long").add("n_unknown", "long")
    return map_batches(plain, make, schema, rows=64)


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
