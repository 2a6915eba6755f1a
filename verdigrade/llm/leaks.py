"""Evaluation passages inside a corpus: rare n-gram seeds, then local alignment."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigrade.operators.skew import hot_keys, salted_join
from verdigrade.session import materialize

_WORD = re.compile(r"[^\W_]+")
_IGNORED = re.compile("['’‘ʼ´`­​-‍⁠﻿]")
#: Multipliers of the polynomial hash of a window of words.
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    """Words without letter case, punctuation, quote and emphasis marks; apostrophes join their halves."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return _WORD.findall(_IGNORED.sub("", text).casefold())


class _WordHash(dict):
    """word -> 64-bit hash, stable across processes; emptied when it has grown large."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_HASH = _WordHash()


def gram_hashes(tokens: list[str], n: int) -> np.ndarray:
    """64-bit hash of every window of n words, as int64; empty if there are fewer words."""
    if len(tokens) < n:
        return np.empty(0, np.int64)
    h = np.fromiter(map(_HASH.__getitem__, tokens), np.uint64, len(tokens))
    m = len(tokens) - n + 1
    out = np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = out * _BASE + h[i : i + m]
            out ^= out >> np.uint64(29)
    return out.view(np.int64)


def rarest_in_windows(counts: np.ndarray, window: int) -> np.ndarray:
    """Positions holding the least count of some `window` consecutive ones (the last on a tie)."""
    if len(counts) <= window:
        return np.array([len(counts) - 1 - int(np.argmin(counts[::-1]))]) if len(counts) else np.empty(0, int)
    view = np.lib.stride_tricks.sliding_window_view(counts, window)
    return np.unique(np.arange(len(view)) + window - 1 - np.argmin(view[:, ::-1], axis=1))


def smith_waterman(a: np.ndarray, b: np.ndarray, match: int = 2, mismatch: int = -1, gap: int = -1) -> tuple[int, int]:
    """Best local alignment score of two word sequences and the longest run of equal words they share.

    Row by row over a; the gap inside a row is a running maximum, so a row costs a few vector operations.
    """
    if not len(a) or not len(b):
        return 0, 0
    steps = np.arange(len(b)) * -gap
    prev, run, best, longest = np.zeros(len(b) + 1, np.int64), np.zeros(len(b) + 1, np.int64), 0, 0
    for x in a:
        same = b == x
        now = np.maximum(np.maximum(prev[:-1] + np.where(same, match, mismatch), prev[1:] + gap), 0)
        now = np.maximum.accumulate(now + steps) - steps
        prev = np.concatenate(([0], now))
        run = np.concatenate(([0], np.where(same, run[:-1] + 1, 0)))
        best, longest = max(best, int(now.max())), max(longest, int(run.max()))
    return best, longest


def _item_grams(items: DataFrame, n: int, item_id: str, text: str) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                g = gram_hashes(words(t), n)
                if len(g):
                    yield pa.record_batch([pa.array([i] * len(g), pa.int64()), pa.array(range(len(g)), pa.int32()), pa.array(g)], ["item_id", "pos", "h"])

    return items.select(F.col(item_id).cast("bigint"), text).mapInArrow(each, "item_id bigint, pos int, h bigint")


def item_seeds(items: DataFrame, docs: DataFrame, n: int, min_run: int, item_id: str = "item_id", item_text: str = "item_text", doc_text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(item_id, pos, h) of the seeds, and the corpus frequencies (h, df) of all grams of the items.

    The seeds of an item are, of every min_run - n + 1 consecutive n-grams, the one that the corpus and the
    other items have least often, among those that the corpus has at all. Any run of min_run words that a
    document shares with the item therefore holds at least one seed: a common phrase is never the only way to
    a document, and no seed has to be dropped for being common.
    """
    grams = materialize(_item_grams(items, n, item_id, item_text), "item-grams")
    wanted = grams.groupBy("h").agg(F.count(F.lit(1)).alias("in_items"))
    seen = _corpus_grams(docs, grams, n, doc_text)
    freq = wanted.join(seen, "h", "left").select("h", F.when(F.col("df") > 0, F.col("df") + F.col("in_items")).otherwise(F.lit(ABSENT)).alias("df"))

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        at = rarest_in_windows(pdf["df"].to_numpy(), min_run - n + 1)
        return pdf.iloc[at[pdf["df"].to_numpy()[at] < ABSENT]][["item_id", "pos", "h"]]

    seeds = grams.join(freq, "h").groupBy("item_id").applyInPandas(pick, "item_id bigint, pos int, h bigint")
    return materialize(seeds, "seeds"), freq


#: Frequency of a gram that the corpus doesn't have.
ABSENT = 1 << 62
#: Below so many bytes, measured on the objects themselves, items and hashes are sent to every task that reads the corpus.
SENT_BYTES = 64 << 20
#: Bits of the filter of item hashes that is sent where the hashes themselves are too many: 32 MB, whatever the input.
FILTER_BITS = 1 << 28
#: Stretches of documents that hold hits are passed on in batches of about so many words.
BATCH_WORDS = 1 << 18


def _sent(grams: DataFrame) -> np.ndarray | None:
    """The distinct gram hashes, sorted, eight bytes each, if they are proven to fit SENT_BYTES; else None."""
    hashes = grams.select("h").distinct()
    if hashes.limit(SENT_BYTES // 8 + 1).count() * 8 > SENT_BYTES:
        return None
    return np.sort(hashes.toArrow().column("h").to_numpy()) if SENT_BYTES else None


def _filter(grams: DataFrame) -> np.ndarray:
    """A bit for each value of the hashes modulo FILTER_BITS, as bytes; set by the distinct words of 64 bits that hold one."""
    at = F.pmod("h", F.lit(FILTER_BITS))
    words = grams.groupBy(F.shiftright(at, 6).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(h, 64) as int))")).alias("bits")).toArrow()  # at most FILTER_BITS / 64 rows
    out = np.zeros(FILTER_BITS >> 6, np.int64)
    out[words.column("w").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint8)


def _passes(g: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = g & np.int64(FILTER_BITS - 1)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _corpus_grams(docs: DataFrame, grams: DataFrame, n: int, text: str) -> DataFrame:
    """(h, df): how often each gram of the items occurs in the whole corpus."""
    known = _sent(grams)
    sent = docs.sparkSession.sparkContext.broadcast(known if known is not None else _filter(grams))
    keeps = _among if known is not None else _passes

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for t in b.column(0).to_pylist():
                g = gram_hashes(words(t), n)
                found.append(g[keeps(g, sent.value)])
            h, c = np.unique(np.concatenate(found) if found else np.empty(0, np.int64), return_counts=True)
            yield pa.record_batch([pa.array(h), pa.array(c.astype(np.int64))], ["h", "c"])

    counted = docs.select(text).mapInArrow(each, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("df"))
    return counted if known is not None else counted.join(grams.select("h").distinct(), "h", "left_semi")


def _among(g: np.ndarray, known: np.ndarray) -> np.ndarray:
    """For each of g whether known, which is sorted, has it."""
    if not len(known):
        return np.zeros(len(g), bool)
    at = np.searchsorted(known, g)
    at[at == len(known)] = 0
    return known[at] == g


def leaks(docs: DataFrame, items: DataFrame, min_run: int = 12, n: int = 6, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "item_text", min_share: float = 0.5) -> DataFrame:
    """(doc_id, item_id, longest_run, score, exact): documents that contain passages of the items.

    Seeds (item_seeds) are looked up in every window of n words of every whole document; around the hits of
    an item the document's words are aligned with the item (Smith-Waterman: 2 a match, -1 a mismatch or
    gap). exact: at least min_run consecutive words agree. Rows that are not exact are edited copies whose
    score reaches min_share of the item's best possible; below that nothing comes out.

    A document and an item are met through all of their seeds at once, so each pair is aligned once. Seeds
    and items go to the tasks as flat arrays while the bytes of these arrays stay below SENT_BYTES. Beyond it
    a filter of fixed size goes there instead, only windows that pass it leave the corpus, and they meet the
    seeds in a shuffled join in which seeds and items with many hits are salted. A text that many documents
    repeat is aligned for each of them in its own task, so no group of copies gathers anywhere.

    Defined results: null and empty texts hold no words; items shorter than min_run words can't be found;
    ties and repeated rows give one row a pair; empty tables give no row; other columns are not read.
    """
    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    items = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(item_text).alias("item_text")).where(F.col("item_id").isNotNull()).dropDuplicates(["item_id", "item_text"])
    seeds, _ = item_seeds(items, docs, n, min_run, "item_id", "item_text", "text")
    arrays = _item_arrays(seeds, items)
    if arrays is None:
        found = _shuffled(docs, items, seeds, n, min_run, min_share)
    else:
        found = docs.mapInArrow(_looked_up(docs.sparkSession.sparkContext.broadcast(arrays), n, min_run, min_share), _SCHEMA)
    return found.groupBy("doc_id", "item_id").agg(F.max("longest_run").alias("longest_run"), F.max("score").alias("score"), F.max("exact").alias("exact"))


_SCHEMA = "doc_id bigint, item_id bigint, longest_run int, score int, exact boolean"


def _item_arrays(seeds: DataFrame, items: DataFrame) -> tuple[np.ndarray, ...] | None:
    """(seed hashes sorted, the item of each, item ids, where each item's words begin, word hashes) if these arrays fit SENT_BYTES; else None.

    Their size is known before anything is collected: 16 bytes a seed, 16 an item and 8 a word.
    """
    pairs = seeds.select("h", "item_id").distinct()
    size = items.agg((F.count(F.lit(1)) * 16 + F.sum(F.length("item_text")) * 4).alias("n")).first()["n"] or 0  # a word and what parts it from the next are two characters at least
    if size > SENT_BYTES or size + 16 * pairs.limit((SENT_BYTES - size) // 16 + 1).count() > SENT_BYTES:
        return None
    got = pairs.orderBy("h", "item_id").toArrow()
    texts = items.where(F.col("item_text").isNotNull()).toArrow()
    parts = [_ids(words(t)) for t in texts.column("item_text").to_pylist()]
    begins = np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int64)
    return got.column("h").to_numpy(), got.column("item_id").to_numpy(), texts.column("item_id").to_numpy(), begins, np.concatenate(parts) if parts else np.empty(0, np.int64)


def _looked_up(sent, n: int, min_run: int, min_share: float):
    """Every document's windows looked up among the seeds, and the document aligned with the items found."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, owner, ids_of, begins, item_words = sent.value
        where: dict[int, list[int]] = {}
        for k, i in enumerate(ids_of.tolist()):
            where.setdefault(i, []).append(k)
        for b in batches:
            rows = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                tokens = words(t)
                g = gram_hashes(tokens, n)
                at = np.flatnonzero(_among(g, known))
                if not len(at) or d is None:
                    continue
                lo, hi = np.searchsorted(known, g[at], "left"), np.searchsorted(known, g[at], "right")
                hits: dict[int, list[int]] = {}
                for p, x, y in zip(at.tolist(), lo.tolist(), hi.tolist()):
                    for i in owner[x:y].tolist():
                        hits.setdefault(i, []).append(p)
                ids = _ids(tokens)
                for i, ps in hits.items():
                    if row := _judge(ids, ps, [item_words[begins[k] : begins[k + 1]] for k in where[i]], n, min_run, min_share):
                        rows.append((d, i, *row))
            yield pa.RecordBatch.from_pylist([dict(zip(_ARROW.names, r)) for r in rows], _ARROW)

    return each


_STRETCHES = pa.schema([("doc_id", pa.int64()), ("stretch", pa.list_(pa.int64())), ("hs", pa.list_(pa.int64())), ("ats", pa.list_(pa.int32()))])


def _stretches(sent, n: int, longest: int):
    """The stretches of documents around windows that pass the filter: all that an item of `longest` words can be aligned with."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_STRETCHES)], schema=_STRETCHES)

        rows, size = [], 0
        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                tokens = words(t)
                g = gram_hashes(tokens, n)
                at = np.flatnonzero(_passes(g, sent.value)) if d is not None else np.empty(0, int)
                ids, k = _ids(tokens) if len(at) else None, 0
                while k < len(at):  # a hit and those at most `longest` words after it share a stretch
                    upto = int(np.searchsorted(at, at[k] + longest, "right"))
                    begin = max(0, int(at[k]) - longest)
                    stretch = ids[begin : int(at[upto - 1]) + n + longest]
                    rows.append((d, stretch, g[at[k:upto]], at[k:upto] - begin))
                    size, k = size + len(stretch), upto
                if size > BATCH_WORDS:
                    yield batch()
                    rows, size = [], 0
        yield batch()

    return each


def _shuffled(docs: DataFrame, items: DataFrame, seeds: DataFrame, n: int, min_run: int, min_share: float) -> DataFrame:
    """The same by joins: only stretches around windows that pass a filter of fixed size leave the corpus."""
    longest = 2 * max(1, items.agg(F.max(F.length("item_text"))).first()[0] or 1)  # more than an item's words
    sent = docs.sparkSession.sparkContext.broadcast(_filter(seeds))
    read = docs.mapInArrow(_stretches(sent, n, longest), "doc_id bigint, stretch array<bigint>, hs array<bigint>, ats array<int>")
    around = materialize(read.withColumn("sid", F.monotonically_increasing_id()), "stretches")
    hits = around.select("sid", F.explode(F.arrays_zip("hs", "ats")).alias("x")).select("sid", F.col("x.hs").alias("h"), F.col("x.ats").alias("at"))
    pairs = seeds.select("h", "item_id").distinct()
    n_hits = hits.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    met = salted_join(hits, pairs, "h", "inner", hot_keys(n_hits, "h"), [F.col("sid"), F.col("at")])
    by_pair = met.groupBy("sid", "item_id").agg(F.collect_set("at").alias("ats"))  # the hits of one stretch
    n_pairs = by_pair.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    both = salted_join(by_pair.join(around.select("sid", "doc_id", "stretch"), "sid"), items, "item_id", "inner", hot_keys(n_pairs, "item_id"), [F.col("sid")])

    def align(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(r.doc_id, r.item_id, *x) for r in f.itertuples() if (x := _judge(np.asarray(r.stretch, np.int64), sorted(r.ats), [_ids(words(r.item_text))], n, min_run, min_share))]
            yield pd.DataFrame(rows, columns=_ARROW.names)

    return both.select("doc_id", "item_id", "stretch", "ats", "item_text").mapInPandas(align, _SCHEMA)


_ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("longest_run", pa.int32()), ("score", pa.int32()), ("exact", pa.bool_())])


def _ids(tokens: list[str]) -> np.ndarray:
    return np.fromiter(map(_HASH.__getitem__, tokens), np.uint64, len(tokens)).view(np.int64)


def _judge(doc: np.ndarray, hits: list[int], items: list[np.ndarray], n: int, min_run: int, min_share: float) -> tuple[int, int, bool] | None:
    """(longest run, score, exact) of the document around the hits, or None.

    Stretches of the document are as long as the item on both sides of a hit; hits within one stretch
    share an alignment, so the whole document is covered however long it is.
    """
    best = None
    for item in items:
        spans: list[list[int]] = []
        for p in hits:
            lo, hi = max(0, p - len(item)), min(len(doc), p + n + len(item))
            if spans and lo <= spans[-1][1]:
                spans[-1][1] = max(hi, spans[-1][1])
            else:
                spans.append([lo, hi])
        for lo, hi in spans:
            score, run = smith_waterman(item, doc[lo:hi])
            if (run >= min_run or len(item) >= min_run and score >= min_share * 2 * len(item)) and (best is None or (run, score) > best[:2]):
                best = (run, score, run >= min_run)
    return best
