"""Substring dedup by content-defined chunking with a gear rolling hash.

A text is cut after every byte at which the gear hash of the bytes before it has CUT_BITS zero bits, so
the cuts depend on at most 20 bytes of content and come back into step after an insertion; chunks over
MAX_CHUNK bytes are cut again where their hash is least, then by length. What
is told apart by digest are windows: the fewest neighbouring chunks that hold min_words whole words, from
every chunk on, and up to every chunk at which none of those ends. Of each window the first place
(smallest doc_id, then position) stays, and the chunks of windows elsewhere are repeats, so whatever goes
lies in min_words words or more that stand in one earlier place as well, at any size of the corpus;
shorter repeats (stock phrases, chance), however many follow each other, stay. Digests meet through
blocks.exchange, in packed rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.blocks import BLANK, COUNTS, NUMBERS, ONE_HOP_BITS, Join, Texts, batched, exchange, hash_spans, mixed64, partition_bits, powers
from quern.llm.common import doc_texts

#: A cut where CUT_BITS bits from bit WINDOW - 1 on are zero: chunks of 2^CUT_BITS bytes on average.
CUT_BITS, WINDOW, MAX_CHUNK, MIN_WORDS = 4, 17, 256, 18
_GEAR = np.random.default_rng(2016).integers(0, 1 << 32, 256, np.uint32)
#: Rows without doc_id come last in the order of first places.
LAST = np.iinfo(np.int64).max


def chunks(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, document) of every chunk, in order."""
    none = np.zeros(0, np.int64)
    n = len(texts.data)
    if not n:
        return none, none, none
    sizes = np.diff(texts.offsets)
    # The rolling hash starts anew in each document: 32 empty places go before it.
    lead = 32
    at = np.arange(n) + np.repeat(lead * np.arange(1, len(sizes) + 1), sizes)
    h = np.zeros(n + lead * (len(sizes) + 1), np.uint32)
    h[at] = _GEAR[texts.data]
    for k in (1, 2, 4, 8, 16):  # doubling: after the last step each place sums the 32 before it, shifted
        shifted = h[:-k] << np.uint32(k)
        h = h.copy()
        h[k:] += shifted
    cut = ((h[at] >> np.uint32(WINDOW - 1)) & np.uint32((1 << CUT_BITS) - 1)) == 0
    ends = texts.offsets[1:][sizes > 0] - 1
    cut[ends] = True
    stops = np.flatnonzero(cut) + 1
    starts = np.concatenate([[0], stops[:-1]])
    if (stops - starts).max() > MAX_CHUNK:
        # Periodic text may never cut: cut long chunks wherever the hash is at its least, in every period.
        rolling = h[at]
        least = np.repeat(np.minimum.reduceat(rolling, starts), stops - starts)
        cut |= np.repeat(stops - starts > MAX_CHUNK, stops - starts) & (rolling == least)
        stops = np.flatnonzero(cut) + 1
        starts = np.concatenate([[0], stops[:-1]])
    pieces = -(-(stops - starts) // MAX_CHUNK)
    if pieces.max() > 1:
        step = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts, stops = np.repeat(starts, pieces) + MAX_CHUNK * step, np.repeat(stops, pieces)
        stops = np.minimum(starts + MAX_CHUNK, stops)
    return starts, stops - starts, np.searchsorted(texts.offsets, starts, side="right") - 1


def _doc_ids(x: pa.Table) -> np.ndarray:
    return np.asarray(x.column("doc_id").combine_chunks().fill_null(LAST))


def window_digests(digest: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A hash of the digests from first to last of each window, from running sums of a polynomial in them."""
    power = powers(len(digest))
    inverse = np.full(len(power), pow(int(power[1]), -1, 1 << 64) if len(power) > 1 else 1, np.uint64)
    inverse[0] = 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(digest * power[: len(digest)], dtype=np.uint64)])
    return mixed64((sums[last + 1] - sums[first]) * np.multiply.accumulate(inverse)[first] + (last - first + 1).astype(np.uint64))


class Batch:
    """Chunks of a batch and their windows, with the smallest doc_id that holds each window's digest in it."""

    def __init__(self, x: pa.Table, min_words: int):
        self.texts = Texts.of(x.column("text"))
        self.start, self.length, self.document = chunks(self.texts)
        self.first, self.last = self.windows(min_words)
        digest = window_digests(hash_spans(self.texts.data, self.start, self.length), self.first, self.last)
        # Order of first places: doc_id, then the text for rows that share it, then position.
        ids = _doc_ids(x)
        rank = np.empty(len(ids), np.int64)
        raw, offsets = self.texts.data.tobytes(), self.texts.offsets
        rank[sorted(range(len(ids)), key=lambda i: (ids[i], raw[offsets[i] : offsets[i + 1]]))] = np.arange(len(ids))
        document = self.document[self.first]
        order = np.lexsort((np.arange(len(digest)), rank[document], digest)) if len(digest) else np.zeros(0, np.int64)
        self.keys, first, self.key_of = np.unique(digest[order], return_index=True, return_inverse=True)
        self.order, self.owner = order, ids[document[order[first]]] if len(order) else np.zeros(0, np.int64)
        self.is_first = np.zeros(len(digest), bool)
        self.is_first[order[first]] = True
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        self.key_of = self.key_of[back]

    def windows(self, min_words: int) -> tuple[np.ndarray, np.ndarray]:
        """(first chunk, last chunk) of every window, in order of position."""
        words, lengths, _ = self.texts.words()
        ends, stops, n = words + lengths, self.start + self.length, len(self.start)
        if len(words) < min_words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.searchsorted(words, self.start) + min_words - 1
        first = np.flatnonzero(at < len(words))
        last = np.searchsorted(stops, ends[at[first]])
        whole = self.document[first] == self.document[last]
        first, last = first[whole], last[whole]
        # No window from the left ends at these: without windows of their own, the ends of passages would stay.
        bare = np.ones(n, bool)
        bare[last] = False
        at = np.searchsorted(ends, stops, side="right") - min_words
        end = np.flatnonzero(bare & (at >= 0))
        begin = np.searchsorted(self.start, words[at[end]], side="right") - 1
        whole = self.document[begin] == self.document[end]
        first, last = np.concatenate([first, begin[whole]]), np.concatenate([last, end[whole]])
        order = np.lexsort((last, first))
        return first[order], last[order]

    def repeated(self, elsewhere: np.ndarray) -> np.ndarray:
        """Which chunks are repeats, given for each key whether its first place is in another batch."""
        again = ~self.is_first | elsewhere[self.key_of]
        n = len(self.start)
        opened = np.bincount(self.first[again], minlength=n + 1) - np.bincount(self.last[again] + 1, minlength=n + 1)
        return np.cumsum(opened)[:n] > 0

    def runs(self, repeated: np.ndarray, min_words: int) -> tuple[np.ndarray, ...]:
        """(start, stop, document, words, chunks) of the runs of repeats that go; start and stop in bytes, at word bounds."""
        none = np.zeros(0, np.int64)
        if not repeated.any():
            return none, none, none, none, none
        edge = np.diff(self.document, prepend=-1) != 0
        opens = repeated & (edge | ~np.concatenate([[False], repeated[:-1]]))
        closes = repeated & (np.append(edge[1:], True) | ~np.append(repeated[1:], False))
        start, last = self.start[opens], (self.start + self.length)[closes]
        document = self.document[opens]
        words, lengths, _ = self.texts.words()
        ends = words + lengths
        # Words that lie whole inside the run.
        a, b = np.searchsorted(words, start), np.searchsorted(ends, last, side="right")
        fits = b - a >= min_words
        chunks_of = np.flatnonzero(closes) - np.flatnonzero(opens) + 1
        a, b, document = a[fits], b[fits], document[fits]
        return words[a], ends[b - 1], document, b - a, chunks_of[fits]


def _first(ids: np.ndarray, owners: np.ndarray, askers: np.ndarray) -> np.ndarray:
    """The entry of each id that holds its first place: smallest doc_id, then (rows that share it) batch."""
    order = np.lexsort((askers, owners, ids))
    return order[np.flatnonzero(np.diff(ids[order], prepend=-1))]


def _least(ids: np.ndarray, owners: np.ndarray, askers: np.ndarray) -> np.ndarray:
    return owners[_first(ids, owners, askers)]


def _elsewhere(ids: np.ndarray, owners: np.ndarray, askers: np.ndarray, merged: np.ndarray | None) -> np.ndarray:
    """0 for the entry that holds the first place of its id, 1 for the others."""
    out = np.ones(len(ids), np.int64)
    out[_first(ids, owners, askers)] = 0
    return out if merged is None else out | merged[ids]


def _spans(docs: DataFrame, min_words: int, build, out_schema, one_hop_bits: int = ONE_HOP_BITS) -> DataFrame:
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]

    def ask(x: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        batch = Batch(x, min_words)
        return batch.keys, batch.owner.astype(np.int64)

    def finish(x: pa.Table, answers: np.ndarray) -> pa.Table:
        batch = Batch(x, min_words)
        repeated = batch.repeated(answers.astype(bool))
        return build(x, batch, batch.runs(repeated, min_words))

    join = Join(_least, _elsewhere, NUMBERS, COUNTS)
    return exchange(batched(docs, size), partition_bits(size), ask, join, finish, out_schema, one_hop_bits)


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, one_hop_bits: int = ONE_HOP_BITS) -> DataFrame:
    """One row per document: doc_id, has_repeats, n_chunks, removed_chunks, removed_words, spans, kept_chars.

    spans: array of (start, stop) in code points, stop excluded, the parts of the text that repeat an
    earlier place (of a smaller doc_id, or further up). A null or empty text has no chunks and no spans;
    of repeated rows the first stays; rows without doc_id come after all others; an empty table gives no
    rows; other columns are ignored.
    """

    def build(x: pa.Table, batch: Batch, runs) -> pa.Table:
        start, stop, document, words, in_run = runs
        rows = x.num_rows
        count = lambda d, w=None: np.bincount(d, weights=w, minlength=rows).astype(np.int64)
        lead = np.concatenate([[0], np.cumsum((batch.texts.data & 0xC0) != 0x80)])
        base, chars = lead[batch.texts.offsets[:-1]], np.diff(lead[batch.texts.offsets])
        spans: list[list[dict[str, int]]] = [[] for _ in range(rows)]
        gone = np.zeros(rows, np.int64)
        for a, b, d in zip(lead[start] - base[document], lead[stop] - base[document], document):
            spans[d].append({"start": int(a), "stop": int(b)})
            gone[d] += b - a
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        return pa.Table.from_arrays([
            x.column("doc_id"), pa.array([bool(s) for s in spans]), pa.array(count(batch.document)), pa.array(count(document, in_run)),
            pa.array(count(document, words)), pa.array(spans, kind), pa.array(chars - gone),
        ], names=["doc_id", "has_repeats", "n_chunks", "removed_chunks", "removed_words", "spans", "kept_chars"])

    schema = "doc_id long, has_repeats boolean, n_chunks long, removed_chunks long, removed_words long, spans array<struct<start:long,stop:long>>, kept_chars long"
    return _spans(doc_texts(docs), min_words, build, schema, one_hop_bits)


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the repeated spans cut out of text, and n_chars (if there) set anew; all columns kept.

    The blanks before a removed span go with it. A text that repeats others whole becomes empty; the
    row stays.
    """
    names = docs.columns

    def build(x: pa.Table, batch: Batch, runs) -> pa.Table:
        start, stop, document, *_ = runs
        if not len(start):
            return x
        texts = x.column("text").to_pylist()
        data, offsets = batch.texts.data, batch.texts.offsets
        chars = x.column("n_chars").to_pylist() if "n_chars" in names else None
        for d in np.unique(document):
            kept, at = [], int(offsets[d])
            for k in np.flatnonzero(document == d):
                end = int(start[k])
                while end > at and BLANK[data[end - 1]]:
                    end -= 1
                kept.append(data[at:end].tobytes())
                at = int(stop[k])
            kept.append(data[at : int(offsets[d + 1])].tobytes())
            texts[d] = b"".join(kept).decode("utf-8", "replace").strip(" \t\r\n\v\f")
            if chars:
                chars[d] = len(texts[d])
        out = x.set_column(names.index("text"), "text", pa.array(texts, pa.string()))
        return out.set_column(names.index("n_chars"), "n_chars", pa.array(chars, x.schema.field("n_chars").type)) if chars else out

    return _spans(docs, min_words, build, docs.schema)
