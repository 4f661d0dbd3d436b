"""Exchange of 64-bit keys in packed blocks between batches of documents and hash partitions.

Counting every n-gram or chunk of a corpus one row at a time costs far more than the counting. Here a
batch of documents (a few MB, dealt by hash) sends each hash partition one row: the batch's distinct
keys of that partition, packed, with a value for each. The partition joins the rows of all batches and
sends each batch one row of answers back, in the same order. A key comes from a batch at most once,
however often its documents hold it, so a hot key costs a partition one entry a batch.

Batches and partitions both grow with the input, so their rows would grow with its square. Beyond
ONE_HOP_BITS the keys therefore go by relays: a zone (the first half of a key's partition bits) of a group
of batches merges what its batches send and asks the zone's partitions once. Each hop fans out by the
square root of the partitions, so a row holds some 35 keys or more up to 256 TB of text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import give_back

#: Bytes of text in a batch, and of text for each hash partition.
BATCH_BYTES, PARTITION_BYTES = 4 << 20, 4 << 20
#: The column that deals documents to batches; it stands beside the struct of a document's own columns.
BATCH = "batch"
#: Bytes of a key that are sent besides the bits that choose its partition (to a relay, all eight).
KEY_BYTES, RELAY_KEY_BYTES = 6, 8
#: Up to so many partition bits (some 32 GB of text) batches ask partitions directly.
ONE_HOP_BITS = 13


def mixed64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads all 64 bits (the constants are those of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_RNG = np.random.default_rng(64)
BYTE = _RNG.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def hash_spans(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span data[start : start + length]; spans are not empty."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    firsts = np.zeros(len(lengths), np.int64)
    np.cumsum(lengths[:-1], out=firsts[1:])
    place = np.arange(int(lengths.sum())) - np.repeat(firsts, lengths)
    values = BYTE[data[np.repeat(starts, lengths) + place]]
    values *= powers(int(lengths.max()))[place]
    return mixed64(np.add.reduceat(values, firsts) + lengths.astype(np.uint64))


@dataclass
class Texts:
    """The texts of a batch as one byte array; document d is data[offsets[d] : offsets[d + 1]]."""

    data: np.ndarray
    offsets: np.ndarray

    @classmethod
    def of(cls, column: pa.ChunkedArray) -> Texts:
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in column.to_pylist()]
        return cls(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, document) of every word, in order."""
        none = np.zeros(0, np.int64)
        if not len(self.data):
            return none, none, none
        inside = ~BLANK[self.data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        at = self.offsets[:-1][self.offsets[:-1] < len(self.data)]
        first[at] |= inside[at]  # a word never runs over into the next document
        starts = np.flatnonzero(first)
        ids = np.cumsum(first) - 1
        lengths = np.bincount(ids[inside], minlength=len(starts)) if len(starts) else none
        return starts, lengths, np.searchsorted(self.offsets, starts, side="right") - 1


BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True


def batched(docs: DataFrame, total_bytes: int) -> DataFrame:
    """(BATCH, row): the rows of docs as one struct, whatever their columns are called, dealt to batches by
    the hash of doc_id, text and input partition (so rows that repeat do not all meet in one batch)."""
    n = max(1, -(-total_bytes // BATCH_BYTES))
    dealt = F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(n)).cast("long")  # of the type of `from`, as both are hashed
    return docs.select(dealt.alias(BATCH), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))


def rows_of(x: pa.Table) -> pa.Table:
    """The documents of a batch."""
    return pa.Table.from_struct_array(x.column("row"))


def partition_bits(total_bytes: int) -> int:
    return max(0, int(np.ceil(np.log2(max(total_bytes, 1) / PARTITION_BYTES)))) if total_bytes > PARTITION_BYTES else 0


def _pack(keys: np.ndarray, bits: int, key_bytes: int) -> bytes:
    """The key_bytes bytes of each key that follow its partition's bits."""
    shifted = (keys << np.uint64(bits)).astype(">u8")
    return shifted.view(np.uint8).reshape(-1, 8)[:, :key_bytes].tobytes()


def unpack(blob: bytes, key_bytes: int = KEY_BYTES) -> np.ndarray:
    """What _pack kept of the keys, as the low bytes of a number (all eight: in place)."""
    raw = np.frombuffer(blob, np.uint8).reshape(-1, key_bytes)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, 8 - key_bytes :] = raw
    return wide.view(">u8").ravel().astype(np.uint64)


def squeezed(values: np.ndarray) -> bytes:
    """Counts as a byte each; those of 255 and up follow whole."""
    return np.minimum(values, 255).astype(np.uint8).tobytes() + values[values >= 255].astype("<i8").tobytes()


def spread(blob: bytes, n: int) -> np.ndarray:
    values = np.frombuffer(blob, np.uint8, n).astype(np.int64)
    values[values == 255] = np.frombuffer(blob, "<i8", offset=n)
    return values


def whole(values: np.ndarray) -> bytes:
    return values.astype("<i8").tobytes()


def read_whole(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(blob, "<i8", n)


#: Ways to send a value for each key: (pack, unpack).
COUNTS, NUMBERS = (squeezed, spread), (whole, read_whole)


@dataclass(frozen=True)
class Join:
    """What partitions do with the entries (key, value) of all who ask, given by ids that tell equal keys apart.

    merge(ids, values, askers) -> a value for each id; answer(ids, values, askers, merged) -> an answer for
    each entry, merged being the answers to the ids of a merge further up, or None at the top.
    sent and answered are the ways (COUNTS, NUMBERS) in which values and answers travel.
    """

    merge: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
    answer: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None], np.ndarray]
    sent: tuple[Callable, Callable]
    answered: tuple[Callable, Callable]


#: from: who asks (a batch, or a group of batches); part: whom (a partition, or a zone).
REQUEST = pa.schema([("from", pa.int64()), ("part", pa.int64()), ("keys", pa.binary()), ("vals", pa.binary())])
ANSWER = pa.schema([("from", pa.int64()), ("part", pa.int64()), ("n", pa.int64()), ("answers", pa.binary())])
REQUEST_SQL, ANSWER_SQL = "`from` long, part long, keys binary, vals binary", "`from` long, part long, n long, answers binary"


def requests(asker: int, keys: np.ndarray, vals: np.ndarray, bits: int, pack: Callable[[np.ndarray], bytes], key_bytes: int = KEY_BYTES) -> pa.Table:
    """One row for each hash partition that has any of the keys (distinct, ascending)."""
    parts = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    cuts = np.flatnonzero(np.diff(parts, prepend=-1)) if len(keys) else np.zeros(0, np.int64)
    spans = list(zip(cuts, np.append(cuts[1:], len(keys))))
    packed = _pack(keys, bits, key_bytes)
    return pa.Table.from_arrays([
        pa.array([asker] * len(cuts), pa.int64()), pa.array(parts[cuts], pa.int64()),
        pa.array([packed[a * key_bytes : b * key_bytes] for a, b in spans], pa.binary()), pa.array([pack(vals[a:b]) for a, b in spans], pa.binary()),
    ], schema=REQUEST)


def _entries(x: pa.Table, unpack_values: Callable, key_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, ids, values, askers, where each row's entries start and end) of request rows, by asker."""
    blobs = x.column("keys").to_pylist()
    sizes = np.array([len(b) // key_bytes for b in blobs], np.int64)
    keys, ids = np.unique(unpack(b"".join(blobs), key_bytes), return_inverse=True)
    values = [unpack_values(b, int(n)) for b, n in zip(x.column("vals").to_pylist(), sizes)]
    askers = np.repeat(np.asarray(x.column("from")), sizes)
    return keys, ids, np.concatenate([np.zeros(0, np.int64), *values]), askers, np.concatenate([[0], np.cumsum(sizes)])


def _answers(x: pa.Table, found: np.ndarray, cuts: np.ndarray, pack: Callable) -> pa.Table:
    packed = [pack(found[a:b]) for a, b in zip(cuts, cuts[1:])]
    return pa.Table.from_arrays([x.column("from"), x.column("part"), pa.array(np.diff(cuts), pa.int64()), pa.array(packed, pa.binary())], schema=ANSWER)


def _joined(x: pa.Table, unpack_answers: Callable) -> np.ndarray:
    """The answers of all parts, in the order of the keys."""
    x = x.sort_by("part")
    parts = [unpack_answers(b, n) for b, n in zip(x.column("answers").to_pylist(), x.column("n").to_pylist())]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def zone_bits(bits: int, one_hop_bits: int = ONE_HOP_BITS) -> int:
    """Bits of a zone: 0 if batches ask partitions directly, else half of the partition's, rounded up."""
    return 0 if bits <= one_hop_bits else (bits + 1) // 2


def exchange(docs: DataFrame, bits: int, ask: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]], join: Join, finish: Callable[[pa.Table, np.ndarray], pa.Table], out_schema, one_hop_bits: int = ONE_HOP_BITS) -> DataFrame:
    """docs (as batched() gives them) -> finish's rows.

    ask(batch of docs) gives distinct ascending keys and a value for each; finish(batch of docs, answers
    in the order of its keys) makes the rows.
    """
    zoned = zone_bits(bits, one_hop_bits)
    group = 1 << zoned  # batches that share relays
    width = RELAY_KEY_BYTES if zoned else KEY_BYTES

    def send(x: pa.Table) -> pa.Table:
        give_back()
        keys, vals = ask(rows_of(x))
        return requests(x.column(BATCH)[0].as_py(), keys, vals, zoned or bits, join.sent[0], width)

    def meet(x: pa.Table) -> pa.Table:
        x = x.sort_by("from")
        _, ids, values, askers, cuts = _entries(x, join.sent[1], KEY_BYTES)
        return _answers(x, join.answer(ids, values, askers, None), cuts, join.answered[0])

    def merged(x: pa.Table) -> pa.Table:
        x = x.sort_by("from")
        zone, own = x.column("part")[0].as_py(), x.column("from")[0].as_py() // group
        keys, ids, values, askers, _ = _entries(x, join.sent[1], RELAY_KEY_BYTES)
        whole_keys = (keys >> np.uint64(zoned)) | np.uint64(zone << (64 - zoned))
        return requests(own * group + zone, whole_keys, join.merge(ids, values, askers), bits, join.sent[0])

    def handed(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("from")
        _, ids, values, askers, cuts = _entries(left, join.sent[1], RELAY_KEY_BYTES)
        return _answers(left, join.answer(ids, values, askers, _joined(right, join.answered[1])), cuts, join.answered[0])

    def end(left: pa.Table, right: pa.Table) -> pa.Table:
        give_back()
        return finish(rows_of(left), _joined(right, join.answered[1]))

    asked = docs.groupBy(BATCH).applyInArrow(send, REQUEST_SQL)
    if zoned:
        # A relay is named by its group of batches and its zone; it asks, and hands on, under that name.
        relay = (F.expr(f"`from` div {group}") * group + F.col("part")).alias("relay")
        relayed = asked.groupBy(relay).applyInArrow(merged, REQUEST_SQL)
        met = relayed.groupBy("part").applyInArrow(meet, ANSWER_SQL)
        answers = asked.groupBy(relay).cogroup(met.groupBy("from")).applyInArrow(handed, ANSWER_SQL)
    else:
        answers = asked.groupBy("part").applyInArrow(meet, ANSWER_SQL)
    return docs.groupBy(BATCH).cogroup(answers.groupBy("from")).applyInArrow(end, out_schema)
