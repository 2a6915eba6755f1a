"""Containers of fixed capacity filled with token sequences by deficit round-robin over the sources."""

from __future__ import annotations

import base64
from bisect import bisect_right, insort
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigrade.operators.ordered import running
from verdigrade.session import materialize

#: A public byte-level BPE as ranks; only the path is known here.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split into words that belongs to that vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts are encoded in stretches of so many characters, cut before white space, to bound memory.
STRETCH = 1 << 16

_LOADED: dict[str, object] = {}


def _encoder(path: str):
    if path not in _LOADED:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def n_tokens(text: str | None, path: str = TOKENIZER) -> int:
    """Tokens of the whole text. A cut between stretches falls before a space that follows a non-space,
    where a word of PATTERN begins in any case, so the sum is that of the text encoded at once."""
    if not text:
        return 0
    encode, total, at = _encoder(path).encode_ordinary, 0, 0
    while len(text) - at > STRETCH:
        end = at + STRETCH
        while end > at and not (text[end] == " " and not text[end - 1].isspace()):
            end -= 1
        if end == at:  # one word longer than a stretch
            end = next((i for i in range(at + STRETCH, len(text)) if text[i] == " " and not text[i - 1].isspace()), len(text))
        total, at = total + len(encode(text[at:end])), end
    return total + len(encode(text[at:]))


def token_counts(docs: DataFrame, id_col: str, text: str, source: str, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens), one row a document."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = pa.array([n_tokens(t, path) for t in b.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), counts], ["doc_id", "source", "tokens"])

    return docs.select(F.col(id_col).cast("bigint"), F.coalesce(F.col(source).cast("string"), F.lit("")), text).mapInArrow(each, "doc_id bigint, source string, tokens bigint")


class _Queue:
    """The waiting items of one source by size."""

    def __init__(self) -> None:
        self.by_size: dict[int, list] = {}
        self.sizes: list[int] = []

    def push(self, size: int, item) -> None:
        if size not in self.by_size:
            self.by_size[size] = []
            insort(self.sizes, size)
        self.by_size[size].append(item)

    def largest(self, space: float) -> int:
        """Size of the largest item of at most space; -1 if there is none."""
        i = bisect_right(self.sizes, space)
        return self.sizes[i - 1] if i else -1

    def pop(self, size: int):
        waiting = self.by_size[size]
        item = waiting.pop()
        if not waiting:
            del self.by_size[size]
            self.sizes.pop(bisect_right(self.sizes, size) - 1)
        return item


def fill(items: list[tuple[int, str, object]], capacity: int, shares: dict[str, float], deficits: dict[str, float]) -> list[tuple[object, int]]:
    """(item, container number) of items (size, source, item), each of at most capacity.

    Deficit round-robin: with each container every source that has items is credited its share of a capacity.
    The turn is always the source's that is owed most; it places its largest waiting item that fits, which
    may leave it in debt. A source without a fitting item waits for the next container, and a container is
    closed when no source has one. What is owed stays owed; large items come first, small ones fill the rest.
    """
    queues: dict[str, _Queue] = {}
    for size, source, item in sorted(items, key=lambda x: (x[0], x[1], str(x[2]))):
        queues.setdefault(source, _Queue()).push(size, item)
    owed = {s: float(deficits.get(s, 0.0)) for s in queues}
    weight = {s: shares.get(s, 0.0) or 1e-9 for s in queues}
    total, placed, number = sum(weight.values()), [], 0
    while queues:
        for s in queues:
            owed[s] += capacity * weight[s] / total
        turns = [(-owed[s], s) for s in queues]
        heapify(turns)
        space = capacity
        while turns:
            _, s = heappop(turns)
            size = queues[s].largest(space)
            if size < 0:
                continue
            placed.append((queues[s].pop(size), number))
            owed[s] -= size
            space -= size
            if queues[s].sizes:
                heappush(turns, (-owed[s], s))
            else:
                del queues[s]
                total -= weight[s]
        number += 1
        total = max(total, 1e-12)
    return placed


def pack(
    docs: DataFrame, capacity: int, id_col: str = "doc_id", text: str = "text", source: str = "source", tokenizer: str = TOKENIZER,
    mixture: dict[str, float] | None = None, tokens_per_shard: int = 4_000_000, refill_below: float = 0.97,
) -> DataFrame:
    """(doc_id, source, piece, n_pieces, first_token, tokens, in_mixture, container_id): where each document went.

    A document longer than the capacity is split into pieces of exactly the capacity, each of which fills a
    container, and a rest that is an item as any other; no other document is split. Items are spread over
    shards of about tokens_per_shard tokens by a hash of row and piece, so that no source, long document or
    repeated id gathers in a task; each shard is packed by deficit round-robin (fill). What each source is owed
    at the start of a shard is what all shards before it leave it, known from the shards' token sums before any
    shard is packed; so deficits carry across shards as they do across containers. Items of containers filled
    below refill_below, a few a shard, are packed once more together.

    mixture: the target share of tokens by source; that of the corpus by default, and then all documents are
    in it. A mixture other than the corpus's can't hold all of it: as many tokens are taken as the scarcest
    source allows at its share, from each source by a hash of its items, and packed to the target; the surplus,
    and sources without a share, go to containers of their own (in_mixture false) by their own proportions.

    Defined results: null and empty texts have no tokens and share a container with others; a null source is
    the source ''; rows with equal or null ids are packed each for itself; an empty table gives no row; a
    mixture of which some source has no tokens leaves everything to the surplus.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least one token")
    counts = materialize(token_counts(docs, id_col, text, source, tokenizer).withColumn("_row", F.monotonically_increasing_id()), "tokens")
    full, rest = F.floor(F.col("tokens") / F.lit(capacity)).cast("int"), F.col("tokens") % F.lit(capacity)
    items = (
        counts.withColumn("n_full", full)
        .withColumn("n_pieces", F.greatest(F.lit(1), full + (rest > 0).cast("int")))
        .withColumn("rest", rest)
        .withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)))
        .select(
            "doc_id", "source", "piece", "n_pieces", (F.col("piece") * F.lit(capacity).cast("bigint")).alias("first_token"),
            F.when(F.col("piece") < F.col("n_full"), F.lit(capacity)).otherwise(F.col("rest")).cast("bigint").alias("tokens"), F.xxhash64("_row", "piece").alias("_h"),
        )
    )
    args = (capacity, tokens_per_shard, refill_below)
    if mixture is None:
        return _packed(items, None, 0, *args).withColumn("in_mixture", F.lit(True)).select(*COLUMNS)
    total = sum(mixture.values())
    shares = {s: x / total for s, x in mixture.items() if x > 0}
    have = {r["source"]: r["n"] for r in counts.where(F.col("source").isin(*shares)).groupBy("source").agg(F.sum("tokens").alias("n")).collect()}  # a row a source of the mixture
    most = min((have.get(s, 0) / x for s, x in shares.items()), default=0)
    taken = {s: min(1.0, x * most / have[s]) for s, x in shares.items() if have.get(s)}
    part = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in taken.items() for x in kv)), F.col("source")), F.lit(0.0)) if taken else F.lit(0.0)
    drawn = F.pmod(F.xxhash64("_h", F.lit(7)), F.lit(1 << 30)) < part * (1 << 30)
    within = _packed(items.where(drawn), shares, 0, *args).withColumn("in_mixture", F.lit(True))
    return within.unionByName(_packed(items.where(~drawn), None, 2, *args).withColumn("in_mixture", F.lit(False))).select(*COLUMNS)


COLUMNS = ("doc_id", "source", "piece", "n_pieces", "first_token", "tokens", "in_mixture", "container_id")
#: Bits of a container's number within its shard, and of its shard within the round.
_IN_SHARD, _SHARDS = 30, 30


def _packed(items: DataFrame, shares: dict[str, float] | None, number: int, capacity: int, tokens_per_shard: int, refill_below: float) -> DataFrame:
    """The items with their containers, in rounds `number` and, for loosely filled containers, the next."""
    first = materialize(_round(items, shares, capacity, tokens_per_shard, number), "packed")
    used = first.groupBy("container_id").agg(F.sum("tokens").alias("used"))
    loose = first.join(used.where(F.col("used") < refill_below * capacity).select("container_id"), "container_id", "left_semi").drop("container_id")
    kept = first.join(used.where(F.col("used") >= refill_below * capacity).select("container_id"), "container_id", "left_semi")
    return kept.unionByName(_round(loose, shares, capacity, tokens_per_shard, number + 1)).drop("_h")


def _before(sums: DataFrame, tokens: str, keys: list[str]) -> DataFrame:
    """(_shard, keys..., had): tokens of the shards before each, without a window over all shards."""
    return running(sums, "_shard", [tokens], keys).select("_shard", *keys, (F.col(f"run_{tokens}") - F.col(tokens)).alias("had"))


def _shares(sums: DataFrame, shares: dict[str, float] | None) -> DataFrame:
    """(source, share): the given ones, or those of the tokens."""
    by_source = sums.groupBy("source").agg(F.sum("here").alias("tokens"))
    if shares is None:
        total = by_source.agg(F.sum("tokens").alias("all"))
        return by_source.crossJoin(F.broadcast(total)).select("source", (F.col("tokens") / F.greatest(F.col("all"), F.lit(1))).alias("share"))  # one row
    given = F.create_map(*(F.lit(x) for kv in shares.items() for x in kv)) if shares else F.lit(None).cast("map<string,double>")
    return by_source.select("source", F.coalesce(F.element_at(given, F.col("source")), F.lit(0.0)).alias("share"))


def _round(items: DataFrame, shares: dict[str, float] | None, capacity: int, tokens_per_shard: int, number: int) -> DataFrame:
    """The items with their containers, numbered within round `number`."""
    total, rows = items.agg(F.sum("tokens"), F.count(F.lit(1))).first()
    shards = max(1, -(-(total or 0) // tokens_per_shard), -(-rows // tokens_per_shard))
    shard: Column = F.pmod(F.col("_h"), F.lit(shards)).cast("int")
    items = items.withColumn("_shard", shard)
    at = items.groupBy("_shard", "source").agg(F.sum("tokens").alias("here"))
    if shards > 1:
        at = materialize(at, "shard-sums")
        ahead = _before(at.groupBy("_shard").agg(F.sum("here").alias("in_shard")), "in_shard", []).withColumnRenamed("had", "ahead")
        had = _before(at, "here", ["source"])
    else:
        ahead = at.select("_shard", F.lit(0).alias("ahead")).distinct()
        had = at.select("_shard", "source", F.lit(0).alias("had"))
    state = (
        had.join(ahead, "_shard")
        .join(_shares(at, shares), "source")
        .select("_shard", "source", "share", (F.col("share") * F.col("ahead") - F.col("had")).cast("double").alias("owed"))
        .toDF("_of", "source", "share", "owed")
    )

    def each(key: tuple, rows: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return rows.assign(container_id=[]).drop(columns="_shard")
        state = state.set_index("source")
        order = rows.sort_values(["_h", "doc_id", "source", "piece"], na_position="last").reset_index(drop=True)
        placed = fill(list(zip(order["tokens"].tolist(), order["source"].tolist(), range(len(order)))), capacity, state["share"].to_dict(), state["owed"].to_dict())
        base = (number << _IN_SHARD + _SHARDS) + (int(key[0]) << _IN_SHARD)
        out = order.iloc[[i for i, _ in placed]].drop(columns="_shard")
        return out.assign(container_id=[base + c for _, c in placed])

    schema = "doc_id bigint, source string, piece int, n_pieces int, first_token bigint, tokens bigint, _h bigint, container_id bigint"
    return items.groupBy("_shard").cogroup(state.groupBy("_of")).applyInPandas(each, schema)


def mixture_report(packed: DataFrame, mixture: dict[str, float] | None = None) -> DataFrame:
    """(source, target, tokens, share, most_over, most_under): how closely the containers in the mixture keep to the target.

    most_over, most_under: tokens by which a source was ahead of, or behind, its target share of all tokens
    placed up to then, at its worst, taken after every container in their order. Deficit round-robin bounds
    both by a container and an item as long as the source has items waiting; a source whose items all went
    to earlier containers of its shard falls behind until the next shard.
    """
    per = packed.where("in_mixture").groupBy("container_id", "source").agg(F.sum("tokens").alias("here"))
    per = materialize(per.withColumn("_shard", F.shiftright("container_id", _IN_SHARD)), "container-sources")
    shares = {s: x / sum(mixture.values()) for s, x in mixture.items()} if mixture else None
    boxes = per.groupBy("_shard", "container_id").agg(F.sum("here").alias("used"))
    upto = boxes.select("container_id", F.sum("used").over(Window.partitionBy("_shard").orderBy("container_id")).alias("all"), "used")  # the containers of a shard
    at = per.groupBy("_shard", "source").agg(F.sum("here").alias("here"))
    numbered = lambda df: df.withColumn("_shard", F.col("_shard").cast("bigint"))
    ahead = _before(numbered(at.groupBy("_shard").agg(F.sum("here").alias("in_shard"))), "in_shard", []).withColumnRenamed("had", "all_before")
    had = _before(numbered(at), "here", ["source"])
    mine = per.withColumn("mine", F.sum("here").over(Window.partitionBy("_shard", "source").orderBy("container_id")))
    met = mine.join(upto, "container_id").join(ahead, "_shard").join(had, ["_shard", "source"]).join(_shares(at, shares).withColumnRenamed("share", "target"), "source")
    after = F.col("had") + F.col("mine") - F.col("target") * (F.col("all_before") + F.col("all"))
    before = F.col("had") + F.col("mine") - F.col("here") - F.col("target") * (F.col("all_before") + F.col("all") - F.col("used"))
    total = boxes.agg(F.sum("used").alias("everything"))
    return (
        met.groupBy("source", "target")
        .agg(F.sum("here").alias("tokens"), F.greatest(F.max(after), F.lit(0.0)).alias("most_over"), F.greatest(F.max(-before), F.lit(0.0)).alias("most_under"))
        .crossJoin(F.broadcast(total))  # one row
        .select("source", "target", "tokens", (F.col("tokens") / F.greatest("everything", F.lit(1))).alias("share"), "most_over", "most_under")
    )


def packing_report(packed: DataFrame, capacity: int) -> DataFrame:
    """(n_containers, n_documents, tokens, fill): how full the containers are over all."""
    per = packed.groupBy("container_id").agg(F.sum("tokens").alias("used"))
    return per.agg(F.count(F.lit(1)).alias("n_containers"), F.sum("used").alias("tokens"), (F.sum("used") / (F.count(F.lit(1)) * F.lit(capacity))).alias("fill"))


def capacity_of(model_versions: DataFrame, model: str, resolved_version: str | None = None) -> int:
    """The context window of a model version; of several, the smallest. An unknown or null window is an error."""
    rows = model_versions.where(F.col("model") == model)
    if resolved_version is not None:
        rows = rows.where(F.col("resolved_version") == resolved_version)
    found = rows.agg(F.min("context_window")).first()[0]
    if found is None:
        raise ValueError(f"no context window is known for {model}")
    return int(found)
