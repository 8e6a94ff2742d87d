"""Edit-aware token counts: pre-token segment trees, re-encoded only where edits touch them.

A text is split into pre-tokens; about ``LEAF`` of them make a leaf, and above the leaves stand sums by twos, of characters and
of tokens, up to the root. ``build_trees`` makes a tree for each document; it is a column like others, and can be kept in a table.
``update_trees`` applies edits to texts and their trees. The leaf that an edit touches is found from the root down, by sums of
characters. Pre-tokens are split anew from the leaf before the edit, which is boundary context, until a new boundary falls on the
start of an old leaf behind the edit: from there on the split is the old one. Only leaves between are encoded again. The new
pre-tokens are dealt to as many leaves as there were, as long as these don't get more than twice as full, and then only the
sums above them are renewed. Counts before and after are read from the root.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.spans import united
from vellum.llm.pii import base_spans
from vellum.llm.shared import pieces, table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that splits texts into pre-tokens for this vocabulary (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEAF = 64
#: A pre-token's end depends on so many characters behind it.
LOOKAHEAD = 2
#: Counts of pre-tokens that a task remembers, and the characters of the longest one.
REMEMBERED, LONGEST_REMEMBERED = 200_000, 64

Levels = list[list[int]]


class Counter:
    """Splits texts into pre-tokens and counts their tokens."""

    def __init__(self, path: str):
        import regex
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        self.encoding = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(PATTERN)
        self.known: dict[str, int] = {}

    def tokens(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            n = len(self.encoding.encode_ordinary(piece))
            if len(piece) <= LONGEST_REMEMBERED:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[piece] = n
        return n

    def tree(self, text: str) -> Tree:
        pieces = self.split.findall(text)
        groups = [pieces[i : i + LEAF] for i in range(0, len(pieces), LEAF)]
        return Tree(levels([sum(map(len, g)) for g in groups]), levels([sum(map(self.tokens, g)) for g in groups]))


def levels(values: list[int]) -> Levels:
    """Sums by twos over values, from the leaves up to one root."""
    made = [values or [0]]
    while len(made[-1]) > 1:
        below = made[-1]
        made.append([sum(below[i : i + 2]) for i in range(0, len(below), 2)])
    return made


def renew(sums: Levels, start: int, new: list[int]) -> int:
    """Puts new values on leaves from start on, in place, and renews the sums above them; how many of these there were."""
    end, n = start + len(new), 0
    sums[0][start:end] = new
    for below, above in zip(sums, sums[1:], strict=False):
        start, end = start // 2, (end + 1) // 2
        above[start:end] = [sum(below[2 * i : 2 * i + 2]) for i in range(start, end)]
        n += end - start
    return n


@dataclass
class Tree:
    """Sums of characters and of tokens, level by level."""

    chars: Levels
    tokens: Levels

    def leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds the character at a place, and its start; the end of all for places behind."""
        if place >= self.chars[-1][0]:
            return len(self.chars[0]), self.chars[-1][0]
        leaf, start = 0, 0
        for level in reversed(self.chars[:-1]):
            leaf *= 2
            if place >= start + level[leaf]:
                start += level[leaf]
                leaf += 1
        return leaf, start

    def replace(self, parts: list[tuple[int, int, list[int], list[int]]]) -> tuple[Tree, int]:
        """The tree with leaves start to end replaced, for each part (start, end, characters, tokens), and how many sums are new."""
        made = Tree([[*level] for level in self.chars], [[*level] for level in self.tokens])
        if all(end - start == len(chars) for start, end, chars, _ in parts):
            return made, sum(renew(made.chars, start, chars) + renew(made.tokens, start, tokens) for start, _, chars, tokens in parts)
        for start, end, chars, tokens in reversed(parts):
            made.chars[0][start:end] = chars
            made.tokens[0][start:end] = tokens
        made = Tree(levels(made.chars[0]), levels(made.tokens[0]))
        return made, sum(map(len, made.chars[1:] + made.tokens[1:]))


def apply_edits(text: str, edits: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for start, end, new in edits:
        out += [text[at:start], new]
        at = end
    return "".join([*out, text[at:]])


def dealt(lengths: list[int], counts: list[int], leaves: int) -> tuple[list[int], list[int]]:
    """Sums of pre-tokens by leaf: as many leaves as there were, unless they would get more than twice as full."""
    n = len(lengths)
    if n > 2 * LEAF * leaves:
        leaves = -(-n // LEAF)
    cuts = [n * i // leaves for i in range(leaves + 1)] if leaves else [0]
    part = lambda x: [sum(x[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    return part(lengths), part(counts)


def recount(counter: Counter, old: str, tree: Tree, edits: list[tuple[int, int, str]]) -> tuple[str, Tree, int, int]:
    """The edited text, its tree, how many characters were encoded again and how many sums were renewed.

    edits: disjoint (start, end, text), in order.
    """
    if not edits:
        return old, tree, 0, 0
    new = apply_edits(old, edits)
    n_leaves = len(tree.chars[0])
    parts = []
    encoded = shift = k = 0
    while k < len(edits):
        first, start = tree.leaf_at(max(0, edits[k][0] - LOOKAHEAD))
        if first == n_leaves:  # only the empty text has no place before its end
            first, start = 0, 0
        at, lengths, counts, leaf = start + shift, [], [], None
        position = at
        for m in counter.split.finditer(new, at):
            lengths.append(len(m[0]))
            counts.append(counter.tokens(m[0]))
            position = m.end()
            while k < len(edits) and edits[k][0] + shift < position:  # edits that lie before this boundary of the new text
                shift += len(edits[k][2]) - (edits[k][1] - edits[k][0])
                k += 1
            back = position - shift
            clear = k == 0 or back >= edits[k - 1][1]
            if clear and (k == len(edits) or back + LOOKAHEAD <= edits[k][0]):
                found, begin = tree.leaf_at(back)
                if begin == back and found > first:
                    leaf = found
                    break
        if leaf is None:
            leaf = n_leaves
            while k < len(edits):
                shift += len(edits[k][2]) - (edits[k][1] - edits[k][0])
                k += 1
        encoded += position - at
        parts.append((first, leaf, *dealt(lengths, counts, leaf - first)))
    made, renewed = tree.replace(parts)
    return new, made, encoded, renewed


def tree_batches(name: str):
    """Of batches of (doc_id, text, edits): the same with the tree of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(SparkFiles.get(name))
        for batch in pieces(batches):
            trees = [counter.tree(text or "") for text in batch.column(1).to_pylist()]
            sums = [pa.array([getattr(t, side) for t in trees], SUMS) for side in ("chars", "tokens")]
            yield pa.RecordBatch.from_arrays([*batch.columns, *sums], [*batch.schema.names, "tree_chars", "tree_tokens"])

    return run


def update_batches(name: str):
    """Of batches of (doc_id, text, edits, tree_chars, tree_tokens): counts, the text after its edits and its tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(SparkFiles.get(name))
        for batch in pieces(batches):
            rows = []
            for text, edits, chars, tokens in zip(*(batch.column(k).to_pylist() for k in range(1, 5)), strict=True):
                edits = [(e["start"], e["end"], e["text"]) for e in edits or []]
                new, tree, encoded, renewed = recount(counter, text or "", Tree(chars, tokens), edits)
                rows.append((tokens[-1][0], tree.tokens[-1][0], len(edits), encoded, renewed, tree.chars[-1][0], new, tree.chars, tree.tokens))
            kinds = [pa.int64()] * 6 + [pa.string(), SUMS, SUMS]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))],
                ["doc_id", "n_tokens", "n_tokens_after", "n_edits", "chars_encoded", "sums_renewed", "chars_after", "text", "tree_chars", "tree_tokens"],
            )

    return run


SUMS = pa.list_(pa.list_(pa.int64()))
TREE = "tree_chars array<array<bigint>>, tree_tokens array<array<bigint>>"
EDITS = "array<struct<start:int,end:int,text:string>>"


def shipped(docs: DataFrame, tokenizer: str) -> str:
    """The name under which executors have the vocabulary; its path need only exist where the driver runs."""
    docs.sparkSession.sparkContext.addFile(tokenizer)
    return os.path.basename(tokenizer)


def build_trees(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, text, edits of docs, and tree_chars and tree_tokens: sums by level, leaves first, the root last."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("edits").cast(EDITS).alias("edits"))
    return read.mapInArrow(tree_batches(shipped(docs, tokenizer)), f"doc_id long, text string, edits {EDITS}, {TREE}")


def update_trees(trees: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Token counts before and after edits, and text and tree after them, of each row of trees (as from build_trees())."""
    schema = "doc_id long, n_tokens long, n_tokens_after long, n_edits long, chars_encoded long, sums_renewed long, chars_after long, text string, "
    return trees.select("doc_id", "text", "edits", "tree_chars", "tree_tokens").mapInArrow(update_batches(shipped(trees, tokenizer)), schema + TREE)


def count_edited(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Token counts of each row of docs (doc_id, text, edits) before and after its edits.

    edits: array of struct (start, end, text), disjoint and in order, places in code points; null or empty for none. A null
    text counts as empty. n_tokens and n_tokens_after are the roots of the tree before and after; chars_encoded and sums_renewed tell
    what the edits cost. Repeated rows are counted each; a null doc_id stays null; other columns are not read. An empty table gives an
    empty result.
    """
    return update_trees(build_trees(docs, tokenizer), tokenizer)


def redaction_edits(docs: DataFrame) -> DataFrame:
    """doc_id, text, edits: what the redaction of base personal data would change; overlapping spans are one, of the kind that starts first."""
    found = base_spans(docs.select("doc_id", "text", F.col("text").alias("_text")))
    spans = F.sort_array(F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("text"))))
    return found.select("doc_id", F.col("_text").alias("text"), united(spans, ["start", "end", "text"]).alias("edits"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    edited = redaction_edits(table(spark, sf_dir, "documents"))
    return count_edited(edited).select("doc_id", "n_tokens", "n_tokens_after", "n_edits", "chars_encoded", "chars_after")
