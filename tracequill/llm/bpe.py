"""Byte-level BPE by DuckDB recursive queries, one run per block of a partition.

A block's distinct words (matches of the split pattern) become token lists. Each
recursion step unnests their token-position rows, joins adjacent pairs to the
merge table, takes each word's leftmost pair of minimum rank and contracts it,
until no word has a pair left. Words that a worker's earlier blocks had repeatedly are not
encoded again (at most ``KNOWN_WORDS``). Decoding joins token rows to the vocabulary and
aggregates their bytes in order. Documents are put together from their words, so
no shuffle is needed.

Words over ``LONG_WORD`` bytes (encoded files, long rules) are contracted by a heap of
pairs instead, in the same order, as a recursion takes a step per merge: n log n steps for n bytes.

Defined results: null text is empty; an empty text has no tokens and the digests of
nothing; a text may be as long as a string can be, and one word of any length; of equal
pairs the leftmost contracts first; repeated rows give repeated results; an empty table gives an empty result; extra columns are ignored; special
tokens in a text are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import tempfile
from collections.abc import Iterator
from functools import cache

import duckdb
import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONG_WORD = 200
#: A block ends at so many distinct words, or so many words, which bounds a worker's memory.
BLOCK_DISTINCT = 200_000
BLOCK_WORDS = 4_000_000
#: Up to so many words that stood in a block twice or more, about 300 bytes each, are remembered for the worker's next blocks.
KNOWN_WORDS = 150_000

_SHORT = """
WITH RECURSIVE s AS (
  SELECT w, l, true AS live FROM short_words
  UNION ALL
  SELECT s.w, CASE WHEN best.r IS NULL THEN l ELSE l[:best.i - 1] || [best.r] || l[best.i + 2:] END, best.r IS NOT NULL
  FROM s LEFT JOIN (
    SELECT w, min(r) AS r, arg_min(i, (r::BIGINT << 32) | i) AS i FROM (
      SELECT w, unnest(range(1, len(l)))::INT AS i,
             unnest(list_transform(range(1, len(l)), lambda j: (l[j]::BIGINT << 32) | l[j + 1])) AS pair
      FROM s WHERE live) JOIN merges USING (pair)
    GROUP BY w) best ON s.w = best.w
  WHERE live
)
SELECT w, l FROM s WHERE NOT live
"""

_DECODE = """
SELECT w, string_agg(h, '' ORDER BY i) AS h FROM (
  SELECT w, unnest(l) AS token, unnest(range(1, len(l) + 1)) AS i FROM encoded) JOIN vocabulary USING (token)
GROUP BY w
"""


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@cache
def reclassified() -> tuple[tuple[int, int, str], ...]:
    """Ranges of characters that the tokenizer library's Unicode tables class otherwise than this one's, each with a stand-in.

    Their releases differ: letters and numbers that the older one does not know are
    other characters there. Computed once, on the driver.
    """
    everything = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    stand_in: dict[int, str] = {}
    for known, kind in (("\u00df", r"\p{L}"), ("\u00b2", r"\p{N}")):
        probe = tiktoken.Encoding("probe", pat_str=kind, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        theirs, ours = set(probe.decode(probe.encode_ordinary(everything))), set(regex.findall(kind, everything))
        stand_in |= {ord(c): known for c in theirs - ours}
        stand_in = {ord(c): "\uffff" for c in ours - theirs} | stand_in
    out: list[tuple[int, int, str]] = []
    for c, x in sorted(stand_in.items()):
        if out and out[-1][1] == c - 1 and out[-1][2] == x:
            out[-1] = (out[-1][0], c, x)
        else:
            out.append((c, c, x))
    return tuple(out)


def contracted(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one word: the leftmost pair of minimum rank contracts until none is left."""
    n = len(word)
    parts = [word[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    rank = [ranks.get(word[i : i + 2]) if i + 1 < n else None for i in range(n)]
    heap = [(r, i) for i, r in enumerate(rank) if r is not None]
    heapq.heapify(heap)

    def paired(i: int) -> None:
        rank[i] = ranks.get(parts[i] + parts[after[i]]) if after[i] < n else None
        if rank[i] is not None:
            heapq.heappush(heap, (rank[i], i))

    while heap:
        r, i = heapq.heappop(heap)
        if rank[i] != r:
            continue
        j = after[i]
        parts[i] += parts[j]
        after[i], rank[j] = after[j], None
        if after[j] < n:
            before[after[j]] = i
        paired(i)
        if before[i] >= 0:
            paired(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[parts[i]])
        i = after[i]
    return out


class Splitter:
    """Matches of the split pattern, as the tokenizer library finds them.

    Its white space is Unicode's, without the separators U+001C to U+001F.
    """

    def __init__(self, pattern: str, odd: tuple[tuple[int, int, str], ...]):
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.stand_in = {c: x for lo, hi, x in odd for c in range(lo, hi + 1)}
        self.is_odd = np.zeros(0x110000, bool)
        self.is_odd[list(self.stand_in)] = True

    def findall(self, text: str) -> list[str]:
        if text.isascii() or not self.is_odd[np.frombuffer(text.encode("utf-32-le"), np.uint32)].any():
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(self.stand_in))]


class Numbers(dict):
    """Numbers of words in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Block:
    """Documents as sequences of word numbers, until the block is full."""

    def __init__(self) -> None:
        self.words = Numbers()
        self.docs: list[tuple[int | None, np.ndarray]] = []
        self.n = 0

    def add(self, key: int | None, found: list[str]) -> None:
        self.docs.append((key, np.fromiter(map(self.words.__getitem__, found), np.int32, len(found))))
        self.n += len(found)

    def counts(self) -> np.ndarray:
        """How often each word stands in the block."""
        return np.bincount(np.concatenate([seq for _, seq in self.docs]), minlength=len(self.words))

    def full(self) -> bool:
        return len(self.words) >= BLOCK_DISTINCT or self.n >= BLOCK_WORDS


class Codec:
    """Vocabulary and merge table in an in-memory DuckDB of this worker."""

    def __init__(self, path: str, pattern: str, odd: tuple[tuple[int, int, str], ...], memory: str = "250MB"):
        self.ranks = load_ranks(path)
        self.split = Splitter(pattern, odd)
        self.known: dict[str, tuple[str, int, bytes]] = {}
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": memory, "preserve_insertion_order": False, "temp_directory": tempfile.gettempdir()})
        pairs, ranks = [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs.append(left << 32 | right)
                    ranks.append(rank)
        merges = pa.table({"pair": pa.array(pairs, pa.int64()), "r": pa.array(ranks, pa.int32())})  # noqa: F841
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges")
        vocabulary = pa.table({"token": pa.array(self.ranks.values(), pa.int32()), "h": [t.hex() for t in self.ranks]})  # noqa: F841
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM vocabulary")

    def encode_block(self, block: Block) -> tuple[list[str], list[int], list[bytes]]:
        """As :meth:`encode_words` for the words of ``block``; those of earlier blocks are known, those that it has twice or more become known."""
        words = list(block.words)
        rest = iter(zip(*self.encode_words([w for w in words if w not in self.known]), strict=True))
        found = [self.known.get(w) or next(rest) for w in words]
        own = {words[i]: found[i] for i in np.flatnonzero(block.counts() > 1).tolist()[:KNOWN_WORDS] if len(words[i]) <= LONG_WORD}
        together = self.known | own
        self.known = together if len(together) <= KNOWN_WORDS else own
        ids, sizes, decoded = zip(*found, strict=True) if found else ((), (), ())
        return list(ids), list(sizes), list(decoded)

    def encode_words(self, words: list[str]) -> tuple[list[str], list[int], list[bytes]]:
        """For each word: its ids joined by commas, their number, and the bytes they decode to."""
        if not words:
            return [], [], []
        raw = [w.encode() for w in words]
        whole = [self.ranks.get(b) for b in raw]
        far = [i for i, (b, r) in enumerate(zip(raw, whole, strict=True)) if r is None and len(b) > LONG_WORD]
        long_words = pa.table({"w": pa.array(far, pa.int32()), "l": pa.array([contracted(raw[i], self.ranks) for i in far], pa.list_(pa.int32()))})  # noqa: F841
        lengths = np.fromiter((len(b) if r is None else 1 for b, r in zip(raw, whole, strict=True)), np.int64, len(raw))
        flat = np.empty(int(lengths.sum()), np.int32)
        open_ = np.fromiter((r is None for r in whole), bool, len(raw))
        ends = np.cumsum(lengths)
        begins = ends - lengths
        flat[begins[~open_]] = np.fromiter((r for r in whole if r is not None), np.int32, int((~open_).sum()))
        is_byte = np.repeat(open_, lengths)
        flat[is_byte] = self.bytes[np.frombuffer(b"".join(b for b, r in zip(raw, whole, strict=True) if r is None), np.uint8)]
        del raw
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(flat))
        start = pa.table({"w": pa.array(np.arange(len(words)), pa.int32()), "l": lists, "open": pa.array(open_)})  # noqa: F841
        db = self.db
        db.execute("CREATE OR REPLACE TABLE start_ AS SELECT * FROM start")
        db.execute(f"CREATE OR REPLACE TABLE short_words AS SELECT w, l FROM start_ WHERE open AND len(l) <= {LONG_WORD}")
        db.execute(f"CREATE OR REPLACE TABLE encoded AS SELECT w, l FROM start_ WHERE NOT open UNION ALL {_SHORT_WRAPPED}")
        if far:
            db.execute("INSERT INTO encoded SELECT w, l FROM long_words")
        found = db.sql("SELECT array_to_string(l, ',') AS ids, len(l) AS n FROM encoded ORDER BY w").to_arrow_table()
        decoded = db.sql(f"SELECT unhex(h) AS b FROM ({_DECODE}) ORDER BY w").to_arrow_table()
        return found.column("ids").to_pylist(), found.column("n").to_pylist(), decoded.column("b").to_pylist()


_SHORT_WRAPPED = f"SELECT w, l FROM ({_SHORT})"


@cache
def codec(path: str, pattern: str, odd: tuple[tuple[int, int, str], ...]) -> Codec:
    return Codec(path, pattern, odd)


_ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_ENCODED_FULL = "doc_id long, ids array<int>, decoded binary"


def _digests(block: Block, engine: Codec) -> pa.RecordBatch:
    ids, sizes, decoded = engine.encode_block(block)
    size_of = np.array(sizes, np.int64)
    out: tuple[list, list, list, list] = ([], [], [], [])
    for key, seq in block.docs:
        at = seq.tolist()
        out[0].append(key)
        out[1].append(int(size_of[seq].sum()) if at else 0)
        out[2].append(hashlib.sha256(",".join(map(ids.__getitem__, at)).encode()).hexdigest())
        out[3].append(hashlib.sha256(b"".join(map(decoded.__getitem__, at))).hexdigest())
    return pa.RecordBatch.from_arrays(
        [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string())],
        ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    )


def _full(block: Block, engine: Codec) -> pa.RecordBatch:
    ids, _, decoded = engine.encode_block(block)
    rows = [(k, [int(x) for p in s.tolist() for x in ids[p].split(",")], b"".join(decoded[p] for p in s.tolist())) for k, s in block.docs]
    cols = list(zip(*rows, strict=True)) or [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.list_(pa.int32()), pa.binary()), strict=True)], ["doc_id", "ids", "decoded"])


def _run(docs: DataFrame, path: str, pattern: str, emit, schema: str) -> DataFrame:
    odd = reclassified()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine, block = codec(path, pattern, odd), Block()
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                block.add(key, engine.split.findall(text.as_py() or ""))
                if block.full():
                    yield emit(block, engine)
                    block = Block()
        if block.docs:
            yield emit(block, engine)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def encode_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, the token ids and the bytes they decode to."""
    return _run(docs, path, pattern, _full, _ENCODED_FULL)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """As :func:`encode_decode`, with counts and digests in place of ids and bytes."""
    return _run(docs, path, pattern, _digests, _ENCODED)


def op10_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(
        spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    )
