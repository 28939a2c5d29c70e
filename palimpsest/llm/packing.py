"""Best-fit packing by minimum bin slack.

Only the number of pieces of each length matters for packing, so the driver
holds one count for each length up to the capacity. For each bin the longest
piece left is set, and a subset-sum dynamic program over the lengths left, on
bitsets, finds the fullest combination that goes with it; that combination is
the fullest as long as its pieces last, so it is taken as often as they do and
then removed. This gives a schedule whose size depends on the capacity and not
on the data. Pieces are numbered within their length and find their sequence
and offset by that number.
"""

from __future__ import annotations

import array
import re
import sys
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm._common import binary_text, materialize, numbered, slices_by_bytes, utf8

#: letters that normalisation only lower-cases, then marks that the tokenizer keeps as a word of their own
SIMPLE = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?#*$%&|]*)").fullmatch
#: white space for Python but not for the tokenizer
NOT_SPACE = "\x1c\x1d\x1e\x1f"
MOST_CACHED = 400_000


class WordIds(dict):
    """Ids, as little-endian 32-bit integers, of texts without white space, kept by text.

    What is kept has two generations: when the younger is full it becomes the
    older, and words that are still met move back to the younger, so frequent
    words stay and memory is bounded.

    The tokenizer cuts at white space and at the border of letters and marks, so
    the ids of a text are those of its words, one after the other.
    """

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.encode = Tokenizer.from_file(path).encode
        self.older: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        ids = array.array("I", self.encode(text, add_special_tokens=False).ids)
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            m = SIMPLE(word)
            if m and (m[2] or not word.islower()):
                ids = self[m[1].lower()] + (self[m[2]] if m[2] else b"")
            else:
                ids = self.whole(word)
        if len(self) >= MOST_CACHED:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def of(self, text: str) -> bytes:
        if any(x in text for x in NOT_SPACE):
            return self.whole(text)
        return b"".join(map(self.__getitem__, text.split()))


_words: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _words:
        _words[path] = WordIds(path)
    return _words[path]


PIECES = ("doc_id", "piece", "start", "length", "ids_crc32")


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int, id_col: str, text_col: str, end_id: int = 0) -> DataFrame:
    """The pieces of every row: its ids and an end id, cut only where longer than the capacity."""
    id_type = docs.schema[id_col].dataType.simpleString()
    end = end_id.to_bytes(4, "little")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(tokenizer).of
        for whole in batches:
            for batch in slices_by_bytes(whole, "text", 1 << 22):
                rows, numbers, starts, lengths, crcs = [], [], [], [], []
                for row, raw in enumerate(batch.column("text").to_pylist()):
                    ids = ids_of(utf8(raw)) + end
                    for number, at in enumerate(range(0, len(ids), 4 * capacity)):
                        piece = ids[at : at + 4 * capacity]
                        rows.append(row)
                        numbers.append(number)
                        starts.append(at // 4)
                        lengths.append(len(piece) // 4)
                        crcs.append(zlib.crc32(piece))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(rows, pa.int64())),
                        pa.array(numbers, pa.int32()),
                        *(pa.array(x, pa.int64()) for x in (starts, lengths, crcs)),
                    ],
                    names=PIECES,
                )

    return docs.select(F.col(id_col).alias("doc_id"), binary_text(F.col(text_col)).alias("text")).mapInArrow(
        work, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long"
    )


def fullest(counts: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """The fullest set of available lengths within a capacity, as (length, copies), longest first.

    ``counts`` is in descending order of length. Bit s of a bitset is set if the
    lengths so far reach the sum s.
    """
    steps: list[tuple[int, int, int]] = []
    reached, mask = 1, (1 << (capacity + 1)) - 1
    for length, count in counts.items():
        most = min(count, capacity // length)
        taken = 0
        while taken < most:  # copies in doubling lots reach every number of copies
            lot = min(max(1, taken), most - taken) if taken else 1
            steps.append((length, lot, reached))
            reached |= (reached << (length * lot)) & mask
            taken += lot
        if reached >> capacity & 1:
            break
    left = reached.bit_length() - 1
    uses: dict[int, int] = {}
    for length, lot, before in reversed(steps):
        if not before >> left & 1:
            uses[length] = uses.get(length, 0) + lot
            left -= length * lot
    return sorted(uses.items(), reverse=True)


def minimum_bin_slack(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """A schedule of (number of equal bins, their lengths and copies) for all pieces."""
    left = dict(sorted(((n, c) for n, c in counts.items() if c > 0), reverse=True))
    schedule = []
    while left:
        longest = next(iter(left))
        left[longest] -= 1
        uses = dict(fullest({n: c for n, c in left.items() if c and n <= capacity - longest}, capacity - longest))
        left[longest] += 1
        uses[longest] = uses.get(longest, 0) + 1
        bins = min(left[n] // k for n, k in uses.items())
        for n, k in uses.items():
            left[n] -= bins * k
            if not left[n]:
                del left[n]
        schedule.append((bins, sorted(uses.items(), reverse=True)))
    return schedule


def pack_pieces(pieces: DataFrame, capacity: int) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces; ``pieces`` must be materialised."""
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # one for each length
    plan, used, sequence = [], {}, 0
    for bins, uses in minimum_bin_slack(counts, capacity):
        offset = 0
        for length, copies in uses:
            first = used.get(length, 0)
            plan.append((length, first, first + bins * copies, sequence, copies, offset))
            used[length] = first + bins * copies
            offset += length * copies
        sequence += bins
    table = pieces.sparkSession.createDataFrame(
        plan, "_length long, _from long, _to long, _sequence long, _copies long, _offset long"
    )
    spread = F.struct("doc_id", "piece", "ids_crc32")
    inside = F.col("_rank") - F.col("_from")
    return (
        numbered(pieces, "length", spread, "_rank", 256)
        .join(
            F.broadcast(table),  # bounded by the capacity
            (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")),
        )
        .withColumn("sequence_id", F.col("_sequence") + F.expr("(_rank - _from) div _copies"))
        .withColumn("offset", F.col("_offset") + (inside % F.col("_copies")) * F.col("length"))
        .select(*PIECES, "sequence_id", "offset")
    )


def pack_documents(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Return every piece of every row with its sequence and its place there.

    A null text is empty and, like an empty one, a piece of the end id alone;
    long texts are cut into pieces of the capacity; repeated rows and null ids
    are packed like any other; an empty table gives an empty result. Other
    columns are not read.
    """
    pieces = materialize(cut_pieces(docs, tokenizer, capacity, id_col, text_col))
    return pack_pieces(pieces, capacity).withColumnRenamed("doc_id", id_col)
