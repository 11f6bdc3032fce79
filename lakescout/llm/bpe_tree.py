"""Byte-level BPE encoding and decoding as a reduction over a monoid of encoded spans.

A text is halved until a span is short; a short span is encoded directly, and two neighbouring spans are
joined by encoding again only a window around the cut. The window grows on either side until it ends at a
*settled* place, or at the end of its span.

Why a settled place proves that nothing outside changes: a place is settled if the character before it is
no white space and the character after it is a space, tab or line end. In ``PATTERN`` white space can only
begin a match or fill one whole (``\\s+``), so no match of any text runs across such a place; the match to
its left ends there whether the text goes on or not, and matching goes on from there without looking back.
Merges never cross matches. So the ids before the window's start and after its end are those of the joined
text, for every text around them, and joining is associative.
"""

from __future__ import annotations

import base64
import hashlib

import tiktoken
from pyspark.sql import DataFrame

from lakescout.llm.common import arrow_schema, held, map_batches, rows_to_batch, slices

BREAKS = frozenset(" \t\n\r")
LEAF_CHARS = 2048
LEAF_IDS = 4096


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def codec(path: str, pattern: str | None = None) -> TreeCodec:
    """The codec of a rank file, made once in each Python worker."""
    return held(__name__, f"{path} {pattern}", lambda: TreeCodec(path, pattern))


class TreeCodec:
    """Encode by tree reduction and decode by concatenation up the tree."""

    def __init__(self, path: str, pattern: str | None = None, leaf_chars: int = LEAF_CHARS, leaf_ids: int = LEAF_IDS):
        if pattern is None:
            import public_tokenizers

            pattern = public_tokenizers.PATTERN
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.leaf = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.piece = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.piece[rank] = piece
        self.decimal = [str(i) for i in range(len(self.piece))]
        self.leaf_chars, self.leaf_ids = leaf_chars, leaf_ids

    def encode(self, text: str) -> list[int]:
        return self._span(text, 0, len(text))

    def _span(self, text: str, low: int, high: int) -> list[int]:
        if high - low <= self.leaf_chars:
            return self.leaf(text[low:high])
        cut = (low + high) // 2
        return self._join(text, low, cut, high, self._span(text, low, cut), self._span(text, cut, high))

    def _join(self, text: str, low: int, cut: int, high: int, left: list[int], right: list[int]) -> list[int]:
        start, end = self._settled_before(text, low, cut), self._settled_after(text, cut, high)
        kept = self._without(left, len(text[start:cut].encode()), last=True)
        rest = self._without(right, len(text[cut:end].encode()), last=False)
        return left[:kept] + self.leaf(text[start:end]) + right[rest:]

    def _without(self, ids: list[int], size: int, last: bool) -> int:
        """Where to cut ids so that those of so many bytes at the end (last) or the start are apart."""
        at = len(ids) if last else 0
        while size > 0:
            at -= last
            size -= len(self.piece[ids[at]])
            at += not last
        assert size == 0, "a settled place lies between tokens"
        return at

    @staticmethod
    def _settled(text: str, at: int) -> bool:
        return text[at] in BREAKS and not text[at - 1].isspace()

    def _settled_before(self, text: str, low: int, cut: int) -> int:
        window, seen = 16, cut
        while seen > low:
            begin = max(low, cut - window)
            for at in range(seen - 1, begin, -1):
                if self._settled(text, at):
                    return at
            seen, window = begin + 1 if begin > low else low, window * 2
        return low

    def _settled_after(self, text: str, cut: int, high: int) -> int:
        window, seen = 16, cut + 1
        while seen < high:
            end = min(high, cut + window)
            for at in range(seen, end):
                if self._settled(text, at):
                    return at
            seen, window = max(seen, end), window * 2
        return high

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= self.leaf_ids:
            return b"".join(map(self.piece.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])

    def ids_digest(self, ids: list[int]) -> str:
        return hashlib.sha256(",".join(map(self.decimal.__getitem__, ids)).encode()).hexdigest()


def encode_documents(documents: DataFrame, ranks: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>): the ids of every whole text. A null text is as an empty one, which has no ids;
    repeated rows and null doc_ids give a row each."""
    path, ddl = ranks or default_ranks(), "doc_id long, ids array<int>"
    schema = arrow_schema(ddl)

    def run(batches):
        tree = codec(path)
        for _, keys, texts in slices(batches, "doc_id", "text"):
            yield rows_to_batch(schema, [keys, [tree.encode(t or "") for t in texts]])

    return map_batches(documents.selectExpr(f"cast(`{doc_id}` as bigint) doc_id", f"cast(`{text}` as string) text"), run, ddl)


def decode_documents(encoded: DataFrame, ranks: str | None = None) -> DataFrame:
    """(doc_id, text): the texts of (doc_id, ids). Bytes that are no UTF-8 become U+FFFD; null ids give a null text."""
    path, ddl = ranks or default_ranks(), "doc_id long, text string"
    schema = arrow_schema(ddl)

    def run(batches):
        tree = codec(path)
        for _, keys, ids in slices(batches, "doc_id", "ids"):
            yield rows_to_batch(schema, [keys, [None if i is None else tree.decode(i).decode("utf-8", "replace") for i in ids]])

    return map_batches(encoded.selectExpr("cast(doc_id as bigint) doc_id", "cast(ids as array<int>) ids"), run, ddl)


def round_trip_digests(documents: DataFrame, ranks: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode every whole text, decode its ids and hash both.

    The same kernels as ``encode_documents`` and ``decode_documents``, but ids and bytes stay in the worker.
    """
    path, ddl = ranks or default_ranks(), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema = arrow_schema(ddl)

    def run(batches):
        tree = codec(path)
        for _, keys, texts in slices(batches, "doc_id", "text"):
            counts, encoded, decoded = [], [], []
            for t in texts:
                ids = tree.encode(t or "")
                counts.append(len(ids))
                encoded.append(tree.ids_digest(ids))
                decoded.append(hashlib.sha256(tree.decode(ids)).hexdigest())
            yield rows_to_batch(schema, [keys, counts, encoded, decoded])

    return map_batches(documents.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text"), run, ddl)
