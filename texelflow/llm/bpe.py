"""Byte-level BPE by monoid tree reduction.

The reduction runs over two kinds of neighbours, and no text or match goes another way.

Text: a text is halved down to leaves of at most LEAF_CHARS characters, each split by the pattern on its own, and
neighbours are joined. What the pattern takes at a place depends on the characters from there to one after the end
of the match only, so the left side's matches that end two characters before the seam are final. From the first
other one the window is split again, match by match, until a match begins where one of the right side does; from
there on the right side's matches hold, as splitting has no memory.

Match: the bytes of a match are halved down to single bytes, and neighbours are joined: the tokens beside the seam
are encoded again in a window that grows until the pairs of tokens at its two borders are stable. A sequence of BPE
tokens is the encoding of its bytes if and only if each adjacent pair is the encoding of its own bytes; pairs
inside both halves and inside the window hold that by construction, so checking the two border pairs proves
the result. Results of short byte strings are kept, up to a number of them, as words come again.

Decoding concatenates the tokens' bytes.

Defined results: null and empty texts have no tokens; columns other than the id and the text aren't read, so they
may have any name; repeated rows give repeated results; an empty table gives an empty result; no ties arise, as
ranks are different; a text of any length is encoded whole.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, text_of

#: A text of more characters is halved.
LEAF_CHARS = 128
#: Kept results: of byte strings up to KEPT_BYTES, at most KEPT of them.
KEPT, KEPT_BYTES = 1 << 18, 48


class Kept(dict):
    """Results of a function by argument; emptied when it holds KEPT."""

    def __init__(self, of):
        super().__init__()
        self.of = of

    def __missing__(self, x):
        got = self.of(x)
        if len(x) <= KEPT_BYTES:
            if len(self) >= KEPT:
                self.clear()
            self[x] = got
        return got


def white_space_of_unicode(pattern: str) -> str:
    """The pattern with white space in the sense of Unicode's property, as the splitters of these files have it."""
    return pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")


class TreeBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF_CHARS):
        import regex

        self.leaf = leaf
        self.ranks = ranks
        self.split = regex.compile(white_space_of_unicode(pattern))
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for b, i in ranks.items():
            self.bytes_of[i] = b
        self.stable: dict[int, bool] = {}
        self.kept, self.windows = Kept(self._halves), Kept(self._window)
        self.words = Kept(lambda word: self._halves(word.encode()))
        self.joins = self.seams = 0

    # ---- the bytes of a match

    def _window(self, data: bytes) -> list[int]:
        """The merges of a window, by least rank, the leftmost first."""
        rank = self.ranks.get
        none = len(self.bytes_of)
        parts = [data[i : i + 1] for i in range(len(data))]
        pairs = [rank(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs and (least := min(pairs)) < none:
            at = pairs.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = rank(parts[at - 1] + parts[at], none)
            if at < len(pairs):
                pairs[at] = rank(parts[at] + parts[at + 1], none)
        return [self.ranks[p] for p in parts]

    def _stable(self, a: int, b: int) -> bool:
        key = a << 32 | b
        got = self.stable.get(key)
        if got is None:
            if len(self.stable) >= KEPT:
                self.stable.clear()
            got = self.stable[key] = self.windows[self.bytes_of[a] + self.bytes_of[b]] == [a, b]
        return got

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The monoid's operation on the tokens of neighbouring byte strings of one match."""
        if not left or not right:
            return left or right
        self.joins += 1
        bytes_of, a, b = self.bytes_of, left[-1], right[0]
        window = self.windows[bytes_of[a] + bytes_of[b]]
        if len(window) == 2 and window[0] == a:  # nothing at the seam changes
            return left + right
        i = j = 1
        while True:
            left_ok = i == len(left) or self._stable(left[-i - 1], window[0])
            right_ok = j == len(right) or self._stable(window[-1], right[j])
            if left_ok and right_ok:
                return left[: len(left) - i] + window + right[j:]
            i = i if left_ok else min(2 * i, len(left))
            j = j if right_ok else min(2 * j, len(right))
            window = self.windows[self.decode(left[len(left) - i :] + right[:j])]

    def _halves(self, data: bytes) -> list[int]:
        if len(data) < 2:
            return [self.ranks[data]] if data else []
        mid = len(data) // 2
        return self.join(self.kept[data[:mid]], self.kept[data[mid:]])

    # ---- the matches of a text

    def matches(self, text: str) -> list[str]:
        """The pattern's matches, by joining the leaves' ones, neighbours first."""
        n, leaf = len(text), self.leaf
        parts = [(at, min(at + leaf, n), self.split.findall(text, at, min(at + leaf, n))) for at in range(0, n, leaf)]
        while len(parts) > 1:
            up = [self._seam(text, *parts[k], *parts[k + 1]) for k in range(0, len(parts) - 1, 2)]
            parts = up + parts[len(up) * 2 :]
        return parts[0][2] if parts else []

    def _seam(self, text: str, lo: int, mid: int, left: list[str], _: int, hi: int, right: list[str]) -> tuple[int, int, list[str]]:
        self.seams += 1
        at, keep = mid, len(left)  # at: where the last kept match ends
        while keep and at > mid - 2:
            keep -= 1
            at -= len(left[keep])
        begin, k, again = mid, 0, left[:keep]
        match = self.split.match
        while at < hi:
            while begin < at:
                begin += len(right[k])
                k += 1
            if begin == at:
                break
            end = match(text, at, hi).end()
            again.append(text[at:end])
            at = end
        else:
            k = len(right)
        again += right[k:]
        return lo, hi, again

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.words.__getitem__, self.matches(text))))

    def decode(self, ids: list[int]) -> bytes:
        """Concatenation up the tree; join() of byte strings is that of all leaves at once."""
        return b"".join(map(self.bytes_of.__getitem__, ids))


@functools.lru_cache(4)
def loaded(ranks_path: str, pattern: str) -> TreeBpe:
    with open(ranks_path, "rb") as f:  # an installed file of each executor's Python, not a data table
        return TreeBpe({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)


def _ranks(name: str) -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def encode_decode(docs: DataFrame, ranks: str = "byte_bpe_50k.tiktoken", id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row a document: id, n_tokens, ids (if with_ids), decoded bytes' and ids' digests."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = loaded(*_ranks(ranks))
        decimal = [str(i) for i in range(len(tree.bytes_of))]
        for batch in batches:
            n, ids_sha, text_sha, kept = [], [], [], []
            for text in batch.column(1):
                ids = tree.encode(text.as_py())
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(tree.decode(ids)).hexdigest())
                if with_ids:
                    kept.append(ids)
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(kept, pa.list_(pa.int32()))] if with_ids else []), names + (["ids"] if with_ids else []))

    out = arrow_map(docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")), run, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else ""))
    return out.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, ranks: str = "byte_bpe_50k.tiktoken", id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row a document: id and the decoded bytes; null ids give null."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = loaded(*_ranks(ranks))
        for batch in batches:
            out = [None if x is None else tree.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "bytes"])

    return arrow_map(encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")), run, f"id {kind}, bytes binary").withColumnRenamed("id", id_col)
