"""Token counts that follow edits.

A text is cut into leaves of whole pre-tokens, so that the counts of the leaves add up. A segment tree over the leaves holds sums
of tokens and of characters. An edit finds its leaves from the sums of characters, changes their text, takes in a
neighbour wherever the boundary no longer begins a pre-token for certain, encodes what it touched anew and updates the sums above
it. The rest of the text is not encoded again, also where new leaves change the tree's shape.

Trees are kept: `plant` makes a table of the leaves of every text, `edited` takes that table and gives the next one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from onefold.llm import common
from onefold.llm.bpe import CODED_BYTES, SAME_CLASSES, WordBPE, word_bpe
from onefold.llm.secrets import _matches

VOCABULARY, LEAF = "byte_bpe_50k.json", 256
#: What the edits of `masks` replace.
MASKED, MASK = r"[A-Za-z0-9._+-]+@[A-Za-z0-9.-]+|[0-9]{6,}", "<masked>"

TREES = "doc_id long, text string, leaf_chars array<int>, leaf_tokens array<int>"
EDITED = TREES + ", n_tokens long, n_edits long, n_chars_recoded long"
RESULT = "doc_id long, n_tokens long, n_edits long, n_tokens_after long, n_chars_after long, n_chars_recoded long"

_SAME = "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in SAME_CLASSES).replace("[", r"\[") + "]"
_LETTER, _NUMBER, _OTHER = (rf"[{x}&&{_SAME}]" for x in (r"\p{L}", r"\p{N}", r"[^\s\p{L}\p{N}']"))
#: Where a pre-token begins whatever is around: a space or line end after other characters (a space only before such), and a change among letters, numbers and signs but the apostrophe.
_CUT = regex.compile(rf"(?V1)(?<=\S)(?= \S|\n)|(?<={_LETTER})(?={_NUMBER}|{_OTHER})|(?<={_NUMBER})(?={_LETTER}|{_OTHER})|(?<={_OTHER})(?={_LETTER}|{_NUMBER})")


def leaves(text: str, size: int = LEAF) -> list[str]:
    """The text in pieces of about `size` characters; all but the first begin where a pre-token does."""
    out, at = [], 0
    while len(text) - at > size and (found := _CUT.search(text, at + size)):
        out.append(text[at : found.start()])
        at = found.start()
    return [*out, text[at:]]


def counts(texts: list[str], bpe: WordBPE) -> list[int]:
    """Tokens of each of some leaves."""
    return [len(packed) // bpe.dtype.itemsize for packed in bpe.encode(texts)]


class TokenTree:
    """The leaves of one text under a segment tree of sums: node 1 is the root, node i has the children 2i and 2i + 1."""

    def __init__(self, texts: list[str], tokens: list[int], bpe: WordBPE, size: int = LEAF):
        self.bpe, self.size, self.recoded = bpe, size, 0
        self._plant(texts, tokens)

    @classmethod
    def of(cls, text: str, bpe: WordBPE, size: int = LEAF) -> TokenTree:
        """The tree of a text that none is kept of."""
        texts = leaves(text, size)
        return cls(texts, counts(texts, bpe), bpe, size)

    def _plant(self, texts: list[str], tokens: list[int]) -> None:
        self.texts, self.width = texts, 1 << (len(texts) - 1).bit_length()
        fill = [0] * (self.width - len(texts))
        self.tokens, self.chars = [0] * self.width + tokens + fill, [0] * self.width + [len(x) for x in texts] + fill
        for node in range(self.width - 1, 0, -1):
            self._sum(node)

    def _sum(self, node: int) -> None:
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def text(self) -> str:
        return "".join(self.texts)

    def _leaf(self, at: int) -> tuple[int, int]:
        """The leaf that holds character `at` (the last one, for the text's end), and the place in it."""
        node = 1
        while node < self.width:
            node *= 2
            if at >= self.chars[node] and self.chars[node + 1]:
                at -= self.chars[node]
                node += 1
        return node - self.width, at

    def _neighbour(self, leaf: int, step: int) -> int | None:
        """The next leaf with text."""
        leaf += step
        while 0 <= leaf < len(self.texts) and not self.texts[leaf]:
            leaf += step
        return leaf if 0 <= leaf < len(self.texts) else None

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces the characters from start to end (not included), both within the text, by `new`."""
        if not 0 <= start <= end <= self.chars[1]:
            raise ValueError("the edit is outside of the text")
        first, a = self._leaf(start)
        last, b = self._leaf(end) if end > start else (first, a)
        text = self.texts[first][:a] + new + self.texts[last][b:]
        touched = set(range(first, last + 1))
        while True:  # boundaries that no longer begin a pre-token, or can't be told to
            before, after = self._neighbour(min(touched), -1), self._neighbour(max(touched), 1)
            if before is not None and not _CUT.match(self.texts[before][-1] + text[:2], 1):
                text = self.texts[before] + text
                touched.add(before)
            elif after is not None and not (text and _CUT.match(text[-1] + self.texts[after][:2], 1)):
                text += self.texts[after]
                touched.add(after)
            else:
                break
        self.recoded += len(text)
        lo, hi = min(touched), max(touched)
        parts = leaves(text, self.size)
        found = counts(parts, self.bpe)
        if len(parts) > hi - lo + 1:  # the shape changes, the other leaves keep their counts
            old = self.tokens[self.width : self.width + len(self.texts)]
            self._plant([*self.texts[:lo], *parts, *self.texts[hi + 1 :]], [*old[:lo], *found, *old[hi + 1 :]])
            return
        empty = hi - lo + 1 - len(parts)
        nodes = set()
        for leaf, part, n in zip(range(lo, hi + 1), [*parts, *[""] * empty], [*found, *[0] * empty], strict=True):
            self.texts[leaf], node = part, self.width + leaf
            self.tokens[node], self.chars[node] = n, len(part)
            nodes.add(node >> 1)
        while nodes:
            for node in nodes:
                if node:
                    self._sum(node)
            nodes = {node >> 1 for node in nodes if node > 1}

    def kept(self) -> tuple[list[int], list[int]]:
        """Characters and tokens of the leaves that have any."""
        rows = [(len(x), n) for x, n in zip(self.texts, self.tokens[self.width :], strict=False) if x] or [(0, 0)]
        return [c for c, _ in rows], [n for _, n in rows]


def masks(text: Column) -> Column:
    """Edits that mask e-mail addresses and long numbers: array of start, end, new, in code points of the text, from its end to its start."""
    found = F.when(text.rlike(MASKED), F.reverse(_matches(text, MASKED, 0, 0, 1))).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int,text:string>>"))
    return F.transform(found, lambda x: F.struct(x["start"].cast("int").alias("start"), x["end"].cast("int").alias("end"), F.lit(MASK).alias("new")))


def _lists(rows: list[list[int]]) -> pa.Array:
    return pa.array(rows, pa.list_(pa.int32()))


def plant(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """The trees of `docs` (doc_id, text), `TREES`: characters and tokens of the leaves of every text, one row a row.

    Null texts are empty, and an empty text is one leaf; a null doc_id stays null; repeated rows have a tree each; other columns are
    ignored, whatever their names. An empty table gives no rows.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for step in common.steps(batches, "text", CODED_BYTES):
            cut = [leaves(text) for text in step.column("text").to_pylist()]
            n = np.array(counts([leaf for one in cut for leaf in one], bpe), np.int32)
            at = np.concatenate([[0], np.cumsum([len(one) for one in cut])]).astype(np.int32)
            chars = np.array([len(leaf) for one in cut for leaf in one], np.int32)
            yield pa.RecordBatch.from_arrays([step.column("doc_id"), step.column("text"), *[pa.ListArray.from_arrays(pa.array(at), pa.array(x)) for x in (chars, n)]], ["doc_id", "text", "leaf_chars", "leaf_tokens"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), common.text_of(docs).alias("text")).mapInArrow(run, TREES)


def edited(trees: DataFrame, edits: Column, vocabulary: str | None = None) -> DataFrame:
    """The trees (`TREES`, as `plant` or this made them) after `edits`, an array of (start, end, new) for each: `EDITED`.

    Edits are applied in turn, each to the text that the ones before left. Only leaves that they touch are encoded, so n_chars_recoded
    tells what it cost; n_tokens is the count before. Null edits are none, a null `new` deletes. An edit outside of its text is an
    error. An empty table gives no rows.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for step in common.steps(batches, "text"):
            texts, chars, tokens = (step.column(x).to_pylist() for x in ("text", "leaf_chars", "leaf_tokens"))
            before, done, recoded = [sum(x) for x in tokens], [], []
            for i, changes in enumerate(step.column("edits").to_pylist()):
                done.append(len(changes))
                recoded.append(0)
                if not changes:
                    continue
                ends = np.cumsum(chars[i]).tolist()
                tree = TokenTree([texts[i][a:b] for a, b in zip([0, *ends], ends, strict=False)], tokens[i], bpe)
                for change in changes:
                    tree.edit(change["start"], change["end"], change["new"] or "")
                texts[i], (chars[i], tokens[i]), recoded[i] = tree.text, tree.kept(), tree.recoded
            columns = [pa.array(texts, pa.string()), _lists(chars), _lists(tokens), *[pa.array(x, pa.int64()) for x in (before, done, recoded)]]
            yield pa.RecordBatch.from_arrays([step.column("doc_id"), *columns], [x.split()[0] for x in EDITED.split(", ")])

    edits = F.coalesce(edits, F.array().cast("array<struct<start:int,end:int,new:string>>"))
    return trees.select("doc_id", "text", "leaf_chars", "leaf_tokens", edits.alias("edits")).mapInArrow(run, EDITED)


def recount(trees: DataFrame, edits: Column, vocabulary: str | None = None) -> DataFrame:
    """`RESULT` for every tree: tokens before and after `edits`. Cases as in `edited`."""
    total = lambda column: F.aggregate(column, F.lit(0).cast("long"), lambda acc, x: acc + x)
    found = edited(trees, edits, vocabulary)
    return found.select("doc_id", "n_tokens", "n_edits", total("leaf_tokens").alias("n_tokens_after"), total("leaf_chars").alias("n_chars_after"), "n_chars_recoded")
