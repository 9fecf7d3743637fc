"""Token counts by byte-pair merging with a heap and a linked list.

The vocabulary is a sentencepiece BPE model with byte fallback: a text gets a
leading space, spaces become U+2581, and the adjacent pair whose joined piece has
the best score (ties: the leftmost) is merged until none is left. Only the count
is needed: initial symbols minus merges, plus the extra bytes of the symbols that
are no piece and fall back to their UTF-8 bytes. No identifiers are produced.

No piece of the vocabulary joins the end of a word to a following space or a
letter to a non-letter (checked when the vocabulary is loaded, else coarser
chunks are used), so merges never cross the chunks of ``CHUNK`` and a text's
count is the sum over its chunks. Each Python worker remembers the counts of up
to ``memo_size`` chunks; beyond that chunks are counted afresh, so memory is
bounded and the result the same.

Defined cases: a null text is empty; an empty text has 0 tokens; repeated rows
and ties need nothing; an empty table gives an empty result; other columns are
ignored whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text

SPACE = "▁"
# a run of spaces and then letters, or non-letters, or nothing
# (superscripts and fractions are no letters here: some pieces join them to signs)
CHUNK = re.compile(f"[ {SPACE}]*(?:[^\\W\\d_¹²³¼½¾]+|(?:[^\\w {SPACE}]|[\\d_¹²³¼½¾])+)|[ {SPACE}]+")
# coarser: cut only before a run of spaces
COARSE = re.compile(f"[ {SPACE}]*[^ {SPACE}]+|[ {SPACE}]+")


def load_ranks(model_file: str) -> dict[str, int]:
    """Piece -> rank (0 merges first) of the ordinary pieces of a model file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ids = [i for i in range(sp.get_piece_size())
           if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    by_score = sorted(ids, key=lambda i: -sp.get_score(i))
    return {sp.id_to_piece(i): rank for rank, i in enumerate(by_score)}


def chunk_pattern(ranks: dict[str, int]) -> re.Pattern | None:
    """The finest chunking that no piece crosses; None: whole texts."""
    for pattern in (CHUNK, COARSE):
        if all(pattern.fullmatch(p) and len(pattern.findall(p)) == 1 for p in ranks):
            return pattern
    return None


def count_tokens(chunk: str, ranks: dict[str, int]) -> int:
    """Tokens of one chunk: the lowest-rank pair is popped from the heap and merged
    in a doubly linked list of symbols until the heap is empty."""
    syms = list(chunk.replace(" ", SPACE))
    n = len(syms)
    left = list(range(-1, n - 1))
    right = list(range(1, n + 1))
    heap = []
    for i in range(n - 1):
        rank = ranks.get(syms[i] + syms[i + 1])
        if rank is not None:
            heap.append((rank, i, len(syms[i]) + len(syms[i + 1])))
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, size = heapq.heappop(heap)
        a = syms[i]
        if a is None:
            continue
        j = right[i]
        # stale entries name a symbol that has grown or lost its neighbour since
        if j >= n or len(a) + len(syms[j]) != size:
            continue
        merged = a + syms[j]
        syms[i], syms[j] = merged, None
        merges += 1
        k = right[i] = right[j]
        if k < n:
            left[k] = i
            rank = ranks.get(merged + syms[k])
            if rank is not None:
                heapq.heappush(heap, (rank, i, len(merged) + len(syms[k])))
        h = left[i]
        if h >= 0:
            rank = ranks.get(syms[h] + merged)
            if rank is not None:
                heapq.heappush(heap, (rank, h, len(syms[h]) + len(merged)))
    extra = 0
    for s in syms:
        if s is not None and s not in ranks:  # a single character: its bytes
            extra += len(s.encode("utf-8", "surrogatepass")) - 1
    return n - merges + extra


class ChunkCounts(dict):
    """Counts of chunks met before, up to a number of them."""

    def __init__(self, ranks: dict[str, int], most: int):
        super().__init__()
        self.ranks, self.most = ranks, most

    def __missing__(self, chunk: str) -> int:
        n = count_tokens(chunk, self.ranks)
        if len(self) < self.most and len(chunk) <= 64:
            self[chunk] = n
        return n


_MEMO: dict[tuple[str, int], ChunkCounts] = {}  # of this Python worker, by vocabulary and size


def vocabulary_key(ranks: dict[str, int]) -> str:
    """Names a vocabulary by its content."""
    h = hashlib.sha256()
    for piece, rank in ranks.items():
        h.update(f"{len(piece)}:{piece}{rank};".encode("utf-8", "surrogatepass"))
    return h.hexdigest()


def count_text(text: str, memo: ChunkCounts, pattern: re.Pattern | None) -> int:
    if not text:
        return 0
    chunks = pattern.findall(" " + text) if pattern else [" " + text]
    return sum(map(memo.__getitem__, chunks))


def _count_batches(batches: Iterator[pa.RecordBatch], ranks, key: str, pattern, memo_size: int) -> Iterator[pa.RecordBatch]:
    memo = _MEMO.get((key, memo_size))
    if memo is None:
        _MEMO.clear()  # a worker keeps the words of one vocabulary
        memo = _MEMO[key, memo_size] = ChunkCounts(ranks.value, memo_size)
    for batch in batches:
        counts = [count_text(t.as_py(), memo, pattern) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())],
                                         ["doc_id", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, model_file: str, memo_size: int = 600_000) -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of every whole text.

    The ranks (one entry per piece, bounded by the vocabulary) are broadcast."""
    ranks = load_ranks(model_file)
    pattern = chunk_pattern(ranks)
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    text = whole_text()
    rows = docs.select("doc_id", text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(partial(_count_batches, ranks=shared, key=vocabulary_key(ranks), pattern=pattern, memo_size=memo_size),
                           f"doc_id {kind}, n_bytes long, n_tokens long")
