"""Stupid-backoff scores of every document under the corpus's own n-gram counts.

The n-grams of orders 1 to n are counted over all documents in tables partitioned by hash; each
document's n-grams are joined to the tables and their scores summed. Tables drop n-grams (of order 2
and up) seen fewer than min_count times, as an n-gram that only its own document holds tells nothing of
it; a dropped n-gram backs off. Counting and joining go through blocks.exchange, in packed rows.

    S(w | context) = count(context w) / count(context)   if count(context w) >= min_count
                     alpha * S(w | shorter context)      otherwise;  S(w) = count(w) / N
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.blocks import COUNTS, ONE_HOP_BITS, Join, Texts, batched, exchange, hash_spans, mixed64, partition_bits
from quern.llm.common import doc_texts, n_words

ORDER, ALPHA, MIN_COUNT = 2, 0.4, 2


def ngram_keys(texts: Texts, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order m, the key of the m-gram that ends at each word (valid from place m - 1), and each word's place."""
    starts, lengths, document = texts.words()
    word = hash_spans(texts.data, starts, lengths)
    n = len(word)
    new = np.flatnonzero(np.diff(document, prepend=-1)) if n else np.zeros(0, np.int64)
    place = np.arange(n) - np.repeat(new, np.diff(np.append(new, n)))
    keys = [word]
    for m in range(2, order + 1):
        before = np.zeros(n, np.uint64)
        before[1:] = keys[-1][:-1]
        keys.append(mixed64(before * np.uint64(0x9E3779B97F4A7C15) + word + np.uint64(m)))
    return keys, place


def _entries(keys: list[np.ndarray], place: np.ndarray) -> np.ndarray:
    return np.concatenate([k[place >= m] for m, k in enumerate(keys)])


def backoff_scores(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, min_count: int = MIN_COUNT, one_hop_bits: int = ONE_HOP_BITS) -> DataFrame:
    """One row per document: doc_id, n_words, log_score (natural log, summed over the words) and mean_log_score.

    A text without words (null, empty or blank) has log_score 0 and a null mean. Repeated rows are
    scored, and counted, as often as they occur; null doc_ids get their rows; an empty table gives none.
    """
    own = doc_texts(docs)
    size, total = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.coalesce(F.sum(n_words(F.col("text"))), F.lit(0))).first()

    def ask(x: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = np.unique(_entries(*ngram_keys(Texts.of(x.column("text")), order)), return_counts=True)
        return keys, counts

    def summed(ids: np.ndarray, counts: np.ndarray, askers: np.ndarray) -> np.ndarray:
        return np.bincount(ids, weights=counts).astype(np.int64)  # doubles are exact to 2^53

    def answer(ids: np.ndarray, counts: np.ndarray, askers: np.ndarray, merged: np.ndarray | None) -> np.ndarray:
        return (summed(ids, counts, askers) if merged is None else merged)[ids]

    def finish(x: pa.Table, answers: np.ndarray) -> pa.Table:
        texts = Texts.of(x.column("text"))
        keys, place = ngram_keys(texts, order)
        _, where = np.unique(_entries(keys, place), return_inverse=True)
        counted = answers[where]
        score, shorter, at = None, None, 0
        for m in range(order):
            valid = place >= m
            count = np.zeros(len(place), np.int64)
            count[valid] = counted[at : at + int(valid.sum())]
            at += int(valid.sum())
            if m == 0:
                score = np.log(np.maximum(count, 1) / max(total, 1))
            else:
                context = np.ones(len(place), np.int64)
                context[1:] = shorter[:-1]
                kept = valid & (count >= min_count)
                score = np.where(kept, np.log(np.maximum(count, 1) / np.maximum(context, 1)), score + np.where(valid, np.log(alpha), 0.0))
            shorter = count
        document = texts.words()[2]
        words = np.bincount(document, minlength=x.num_rows)
        total_score = np.bincount(document, weights=score, minlength=x.num_rows)
        mean = pa.array(total_score / np.maximum(words, 1), mask=words == 0)
        return pa.Table.from_arrays([x.column("doc_id"), pa.array(words.astype(np.int64)), pa.array(total_score), mean], names=["doc_id", "n_words", "log_score", "mean_log_score"])

    join = Join(summed, answer, COUNTS, COUNTS)
    return exchange(batched(own, size), partition_bits(size), ask, join, finish, "doc_id long, n_words long, log_score double, mean_log_score double", one_hop_bits)


LM_SQL = r"""
with w as (
  select doc_id, row_number() over () as rid, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents
), words as (
  select rid, doc_id, unnest(ws) as w, generate_subscripts(ws, 1) as i, ws from w
), grams as (
  select rid, i, w, case when i > 1 then ws[i - 1] end as before from words
), one as (
  select w, count(*) as c from grams group by w
), two as (
  select before, w, count(*) as c from grams where before is not null group by before, w
), scored as (
  select g.rid, case
      when g.before is null then ln(a.c / n.n)
      when t.c >= 2 then ln(t.c / b.c)
      else ln(0.4::double) + ln(a.c / n.n) end as s
  from grams g join one a on a.w = g.w left join one b on b.w = g.before left join two t on t.before = g.before and t.w = g.w,
       (select count(*)::double as n from grams) n
), summed as (
  select rid, count(*) as n, sum(s) as s from scored group by rid
)
select d.doc_id, coalesce(n, 0)::bigint as n_words, round(coalesce(s, 0), 4) as log_score, round(s / n, 6) as mean_log_score
from w d left join summed using (rid)
"""
