"""Edit-aware token counts.

A document is kept as a segment tree.  Its leaves are runs of whole pre-tokens of
about `LEAF_CHARS` characters, each with its characters and its BPE tokens; inner
nodes hold sums.  Leaves are cut only where a pre-token ends whatever the rest of
the text is, which two characters tell: in front of a blank behind anything else,
between letters, digits and other marks (but not from an apostrophe to a letter).  So leaves can be encoded
by themselves and their counts add up to the count of the whole, for code and
languages without blanks too.

`trees` computes what is kept of each document: characters and tokens of its leaves
and a hash of its text.  An edit (replace code points [start, stop) by a text) takes the kept
tree, finds its leaves from the character sums, takes in the neighbour whose cut it
touches (the boundary context), re-encodes those leaves only and updates the sums
above them.  A tree whose hash isn't that of the text is built anew.

Defined cases: a null text counts as empty, with 0 tokens; positions are clipped to
the text, a stop before start deletes nothing; null edits are skipped, a null
replacement is empty; edits apply in order, each to the result of those before;
repeated rows are counted each; extra columns are ignored; an empty table gives an
empty result; a very long text is a tree of many leaves, a run of letters without any cut one leaf.
"""

from __future__ import annotations

import base64
import os
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import regex
import tiktoken
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import checkpoint_folder, lean

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public pre-token pattern of these ranks.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEAF_CHARS = 512
#: A leaf that edits have grown to this many times LEAF_CHARS makes the tree be built anew.
GROWN = 8
_CUT = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])|(?<=[^\s\p{L}\p{N}'])(?=[\p{L}\p{N}])|(?<=')(?=\p{N})")


@lru_cache(maxsize=2)
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def shipped(spark: SparkSession, path: str) -> str:
    """Sends the ranks to all executors with the job; the name by which `located` finds them there."""
    sc = spark.sparkContext
    if not any(f.endswith("/" + os.path.basename(path)) for f in sc.listFiles):
        sc.addFile(path)
    return os.path.basename(path)


def located(path: str) -> str:
    """The shipped file of this name, on an executor."""
    return SparkFiles.get(path) if os.sep not in path else path


def cut(text: str, size: int = LEAF_CHARS) -> list[str]:
    """The text in runs of whole pre-tokens of at least `size` characters (the last may be shorter)."""
    out, at = [], 0
    while m := _CUT.search(text, at + size):
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


class TokenTree:
    """Segment tree over leaves; node i has children 2i and 2i + 1, leaves start at `base`."""

    def __init__(self, text: str | None, path: str = RANKS, counts: list[int] | None = None):
        self.encoding = encoding(located(path))
        self.encoded_chars = 0
        self._build(cut(text or ""), counts)

    def _count(self, text: str) -> int:
        self.encoded_chars += len(text)
        return len(self.encoding.encode_ordinary(text))

    def _build(self, leaves: list[str], counts: list[int] | None = None) -> None:
        self.base = base = 1 << max(0, (len(leaves) - 1).bit_length())
        self.leaves = leaves + [""] * (base - len(leaves))
        if counts is None:
            self.encoded_chars += sum(map(len, leaves))
            counts = [len(self.encoding.encode_ordinary(x)) for x in leaves]
        self.tokens = [0] * base + list(counts) + [0] * (base - len(leaves))
        self.chars = [0] * base + [len(x) for x in self.leaves]
        for i in range(base - 1, 0, -1):
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join(self.leaves)

    def find(self, at: int) -> tuple[int, int]:
        """Leaf and offset of a character; past the end: the last leaf with text."""
        if at >= self.chars[1]:
            i = 1
            while i < self.base:
                i = 2 * i + (self.chars[2 * i + 1] > 0)
            return i - self.base, self.chars[i]
        i = 1
        while i < self.base:
            i *= 2
            if at >= self.chars[i]:
                at -= self.chars[i]
                i += 1
        return i - self.base, at

    def _beside(self, leaf: int, step: int) -> int | None:
        leaf += step
        while 0 <= leaf < self.base:
            if self.leaves[leaf]:
                return leaf
            leaf += step
        return None

    def edit(self, start: int, stop: int, new: str) -> None:
        n = self.chars[1]
        start = min(max(start, 0), n)
        stop = min(max(stop, start), n)
        a, offset = self.find(start)
        b, end = self.find(stop)
        head, tail = self.leaves[a][:offset], self.leaves[b][end:]
        if offset < 2 and (left := self._beside(a, -1)) is not None:
            head, a = self.leaves[left] + head, left
        # The last letter of b, or the cut behind it, is touched.
        while not tail and (right := self._beside(b, 1)) is not None:
            tail, b = self.leaves[right], right
        pieces = cut(head + new + tail)
        room = b - a + 1
        if len(pieces) > room:
            pieces[room - 1 :] = ["".join(pieces[room - 1 :])]
        pieces += [""] * (room - len(pieces))
        for leaf, piece in zip(range(a, b + 1), pieces):
            self.leaves[leaf] = piece
            self.tokens[self.base + leaf] = self._count(piece) if piece else 0
            self.chars[self.base + leaf] = len(piece)
        lo, hi = (self.base + a) // 2, (self.base + b) // 2
        while lo:
            for i in range(lo, hi + 1):
                self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]
                self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            lo, hi = lo // 2, hi // 2
        if max(map(len, pieces)) > GROWN * LEAF_CHARS and len(cut(max(pieces, key=len))) > 1:
            self._build(cut(self.text()))


def text_hash(text: str | None) -> int:
    """Of what a kept tree was built from: 63 bits over all characters."""
    return xxhash.xxh3_64_intdigest((text or "").encode("utf-8", "surrogatepass"), seed=LEAF_CHARS) >> 1


def _trees(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for b in batches:
            at = b.schema.get_field_index("text")
            chars, tokens, hashes = [], [], []
            for text in b.column(at).to_pylist():
                t = TokenTree(text, path)
                used = [i for i in range(t.base) if t.leaves[i]]
                chars.append([t.chars[t.base + i] for i in used])
                tokens.append([t.tokens[t.base + i] for i in used])
                hashes.append(text_hash(text))
            kept = (pa.array(chars, pa.list_(pa.int32())), pa.array(tokens, pa.list_(pa.int32())), pa.array(hashes, pa.int64()))
            for name, column in zip(TREE, kept):
                b = b.append_column(name, column)
            yield b

    return run


#: Columns of a kept tree.
TREE = ("leaf_chars", "leaf_tokens", "tree_hash")


def trees(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """docs with what has to be kept of each row's tree (inner sums follow): leaf_chars, leaf_tokens, tree_hash."""
    lean(docs.sparkSession)
    docs = docs.drop(*TREE)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "leaf_chars array<int>, leaf_tokens array<int>, tree_hash long"])
    return docs.mapInArrow(_trees(shipped(docs.sparkSession, path)), schema)


def kept_tree(text: str, chars: list[int] | None, tokens: list[int] | None, known: int | None, path: str = RANKS) -> TokenTree:
    """The tree of trees() without encoding anything; built anew if it isn't this text's."""
    if chars is None or tokens is None or len(chars) != len(tokens) or sum(chars) != len(text) or known != text_hash(text):
        return TokenTree(text, path)
    t = TokenTree("", path)
    t._build([text[j - n : j] for n, j in zip(chars, accumulate(chars))] or [""], tokens or [0])
    return t


def _recount(path: str, kept: bool):
    names = ["doc_id", "n_tokens", "n_edits", "n_tokens_edited", "n_chars_edited", "n_chars_encoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for ident, text, edits, *tree in zip(*(c.to_pylist() for c in b.columns)):
                t = kept_tree(text or "", *tree, path) if kept else TokenTree(text, path)
                before, n = t.n_tokens, 0
                if not kept:
                    t.encoded_chars = 0
                for e in edits or ():
                    if e is not None and e["start"] is not None and e["stop"] is not None:
                        t.edit(e["start"], e["stop"], e["new"] or "")
                        n += 1
                rows.append((ident, before, n, t.n_tokens, t.n_chars, t.encoded_chars))
            cols = list(zip(*rows)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

    return run


_OUT = "doc_id long, n_tokens long, n_edits long, n_tokens_edited long, n_chars_edited long, n_chars_encoded long"


def count_edited(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """Counts before and after the edits of each row, and the characters that had to be encoded for the edits.

    docs: doc_id, text, edits array<struct<start, stop, new>>, and, where kept from
    before, the columns of `trees`: then only what edits touch is encoded.
    """
    lean(docs.sparkSession)
    kept = {*TREE} <= {*docs.columns}
    cols = [F.col("doc_id").cast("long"), F.col("text"), F.col("edits").cast("array<struct<start:bigint,stop:bigint,new:string>>").alias("edits")]
    return docs.select(*cols, *(TREE if kept else [])).mapInArrow(_recount(shipped(docs.sparkSession, path), kept), _OUT)


#: Edits of each document in the registered query.
N_EDITS = 4


def standard_edits(docs: DataFrame, n: int = N_EDITS) -> DataFrame:
    """docs with a column edits: n replacements, insertions and deletions at hashed places, of up to 24 characters."""
    size = F.length(F.coalesce("text", F.lit("")))

    def one(i: F.Column) -> F.Column:
        h = lambda salt, m: F.pmod(F.xxhash64(F.lit(salt), "doc_id", i), F.lit(m) if isinstance(m, int) else m)
        start = h(1, size + 1)
        length = F.when(h(2, 3) == 0, F.lit(0).cast("long")).otherwise(h(3, 24))
        new = F.when(h(2, 3) == 1, F.lit("")).otherwise(F.substring(F.col("text"), (h(4, size + 1) + 1).cast("int"), h(5, 24).cast("int")))
        return F.struct(start.alias("start"), (start + length).alias("stop"), new.alias("new"))

    return docs.withColumn("edits", F.transform(F.sequence(F.lit(1), F.lit(n)), one))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of all documents, kept as Parquet in the shared folder, then edited from there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_folder(spark)}/trees-{uuid.uuid4().hex}"
    trees(docs.select("doc_id", "text")).write.parquet(folder)
    return count_edited(standard_edits(spark.read.parquet(folder)))
