"""Edit-aware token counts on segment trees of pre-tokens.

A document's text is split into pre-tokens, and each pre-token's tokens
are counted.  A tree over blocks of pre-tokens holds the sums of
characters and tokens of its subtrees.  An edit re-encodes only from the
last boundary that it can't have moved to the first old boundary after it,
then replaces those pre-tokens and renews the sums above them.

The splitting pattern looks at most CONTEXT characters past a pre-token
and never back, so a boundary that far before the edit stays, and from a
boundary after it everything is as before.

The tokenizer's file is a parameter; the driver reads it and sends its
bytes, of bounded size, to the executors.

Defined cases: null text is empty and has 0 tokens; an edit may be empty
or reach from end to end; repeated rows repeat; an empty table gives an
empty result; columns besides doc_id and text are not looked at.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-token pattern that goes with the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CONTEXT = 3
BLOCK = 64
#: Pre-tokens whose counts a worker remembers.
REMEMBERED = 400_000
#: The edits of the query: longer numbers are masked.
MASKED = regex.compile(r"[0-9]{6,}")
MASK = "0"


class Counter:
    """Token counts of pre-tokens by a byte-level BPE vocabulary."""

    def __init__(self, vocabulary: bytes) -> None:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        self.bpe = tiktoken.Encoding("counted", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.find = regex.compile(PATTERN)
        self.known: dict[str, int] = {}

    def counts(self, pieces: list[str]) -> list[int]:
        known = self.known
        out = [known.get(p, 0) for p in pieces]
        if 0 in out:
            if len(known) > REMEMBERED:
                known.clear()
            for i, n in enumerate(out):
                if not n:
                    p = pieces[i]
                    n = known.get(p) or len(self.bpe.encode_ordinary(p))
                    if len(p) <= 32:
                        known[p] = n
                    out[i] = n
        return out


class TokenTree:
    """Token sums of one text under edits."""

    def __init__(self, text: str, counter: Counter) -> None:
        self.text, self.counter, self.encoded = text, counter, 0
        pieces = counter.find.findall(text)
        sizes, counts = list(map(len, pieces)), counter.counts(pieces)
        self.blocks = [(sizes[i : i + BLOCK], counts[i : i + BLOCK]) for i in range(0, len(sizes), BLOCK)] or [([], [])]
        self._build()

    def _build(self) -> None:
        n = 1
        while n < len(self.blocks):
            n *= 2
        self.width = n
        self.chars, self.tokens = [0] * (2 * n), [0] * (2 * n)
        for i, (sizes, counts) in enumerate(self.blocks):
            self.chars[n + i], self.tokens[n + i] = sum(sizes), sum(counts)
        for i in range(n - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def _block_at(self, at: int) -> tuple[int, int]:
        """The block that holds a character, and where the block begins."""
        node, before = 1, 0
        while node < self.width:
            node *= 2
            if at >= before + self.chars[node] and self.chars[node + 1]:
                before += self.chars[node]
                node += 1
        return node - self.width, before

    def edit(self, start: int, end: int, put: str) -> int:
        """Replace text[start:end]; returns the number of characters encoded again."""
        old, shift = self.text, len(put) - (end - start)
        self.text = new = old[:start] + put + old[end:]
        first, begin = self._block_at(max(0, start - CONTEXT))
        sizes, counts = self.blocks[first]
        keep, at = 0, begin
        while keep < len(sizes) and at + sizes[keep] <= start - CONTEXT:
            at += sizes[keep]
            keep += 1
        # Old boundaries from here on, read block by block.
        last, index, bound = first, keep, at
        fresh, now = [], at
        for m in self.counter.find.finditer(new, at):
            fresh.append(m.group())
            now = m.end()
            if now < start + len(put):
                continue
            while bound < now - shift and last < len(self.blocks):
                if index < len(self.blocks[last][0]):
                    bound += self.blocks[last][0][index]
                    index += 1
                elif last + 1 < len(self.blocks):
                    last, index = last + 1, 0
                else:
                    break
            if bound == now - shift and bound >= end:
                break
        else:
            last, index = len(self.blocks) - 1, len(self.blocks[-1][0])
        self.encoded += now - at
        more = self.counter.counts(fresh)
        tail = self.blocks[last]
        whole = sizes[:keep] + list(map(len, fresh)) + tail[0][index:], counts[:keep] + more + tail[1][index:]
        if last == first and len(whole[0]) <= 2 * BLOCK:
            self.blocks[first] = whole
            node = self.width + first
            chars, tokens = sum(whole[0]) - self.chars[node], sum(whole[1]) - self.tokens[node]
            while node:
                self.chars[node] += chars
                self.tokens[node] += tokens
                node //= 2
        else:
            self.blocks[first : last + 1] = [(whole[0][i : i + BLOCK], whole[1][i : i + BLOCK]) for i in range(0, max(1, len(whole[0])), BLOCK)]
            self._build()
        return now - at


def number_masks(text: str) -> list[tuple[int, int, str]]:
    return [(*m.span(), MASK) for m in MASKED.finditer(text)]


def _count(vocabulary, edits: Callable[[str], list[tuple[int, int, str]]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary.value)
        for batch in batches:
            out = []
            # One text at a time becomes a string; its tree goes before the next.
            for value in batch.column(1):
                tree = TokenTree(value.as_py() or "", counter)
                before, size, todo = tree.total, len(tree.text), edits(tree.text)
                for start, end, put in reversed(todo):
                    tree.edit(start, end, put)
                out.append((size, before, len(todo), tree.total, tree.encoded))
            cols = zip(*out, strict=True) if out else [[]] * 5
            names = ["doc_id", "n_chars", "n_tokens", "n_edits", "n_tokens_edited", "n_encoded_again"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.array(c, np.int64)) for c in cols)], names)

    return run


def count_tokens(docs: DataFrame, path: str = DEFAULT, edits: Callable[[str], list[tuple[int, int, str]]] = number_masks) -> DataFrame:
    """doc_id, n_chars, n_tokens, n_edits, n_tokens_edited, n_encoded_again for every row.

    `edits` gives a text's edits, (start, end, replacement), in order and
    without overlap.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(Path(path).read_bytes())
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(
        _count(vocabulary, edits),
        "doc_id bigint, n_chars bigint, n_tokens bigint, n_edits bigint, n_tokens_edited bigint, n_encoded_again bigint",
    )


def op9(docs: DataFrame) -> DataFrame:
    return count_tokens(docs)
