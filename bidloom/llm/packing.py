"""Problem 7: fill fixed-capacity containers with documents, little space unused, splitting only what is too long.

Method: cost-balanced packing. A piece of n tokens costs LINEAR * n + QUADRATIC * n * n (the attention within it); the
pieces, in descending size, are assigned to the open container of lowest cost that still has room for them.

Scale: sizes are counted once for all capacities. Pieces are spread by a hash of their key over shards of about
``bins_per_shard`` containers and each shard is packed by itself, so memory per task is bounded whatever the number of
documents, and a shard can only leave its last few containers partly empty. Documents larger than the capacity are cut
into full containers plus a rest, so one huge document is only a row of its own.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidloom.session import bounded_rows, materialize

LINEAR, QUADRATIC = 1.0, 1.0 / 1024


@lru_cache(4)
def tokenizer(path: str, pattern: str):
    """A public byte-level BPE from its rank file; loaded once per Python worker."""
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def default_tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def token_counts(documents: DataFrame, doc_id: str, text: str, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens); null and empty texts have 0 tokens. Very long texts are encoded in whole."""
    if path is None or pattern is None:
        path, pattern = default_tokenizer()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokenizer(path, pattern).encode_ordinary
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": [len(encode(t)) if t else 0 for t in batch["text"]]})

    return documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInPandas(count, "doc_id long, n_tokens long")


def pack(sizes: np.ndarray, capacity: int, slack: int | None = None) -> np.ndarray:
    """Container number of each piece (sizes <= capacity): descending, to the lowest-cost container with room.

    As many containers are open from the start as the tokens need at least; one more is opened where a piece fits
    nowhere. One exception to the lowest cost keeps the unused space small: a container that the piece would fill to
    within ``slack`` tokens (capacity / 128 unless given) is taken first and so closed. Pieces of no tokens go to the
    fullest container. Ties go to the container opened first.
    """
    slack = capacity // 128 if slack is None else slack
    where = np.full(len(sizes), -1, np.int64)
    n = max(1, -(-int(sizes.sum()) // capacity))
    room, cost = [capacity] * n, [0.0] * n
    heap = [(0.0, k) for k in range(n)]  # by cost; entries with an old cost are skipped
    rooms = [(capacity, k) for k in range(n)]  # sorted
    for i in np.argsort(-sizes, kind="stable"):
        s = int(sizes[i])
        at = bisect_left(rooms, (s, -1))
        if at == len(rooms):
            k = len(room)
            room.append(capacity)
            cost.append(0.0)
            heapq.heappush(heap, (0.0, k))
            rooms.append((capacity, k))
        k = rooms[at][1]
        if rooms[at][0] - s > slack:
            aside = []
            while heap[0][0] != cost[heap[0][1]] or room[heap[0][1]] < s:
                x = heapq.heappop(heap)
                if x[0] == cost[x[1]]:
                    aside.append(x)
            k = heap[0][1]
            for x in aside:
                heapq.heappush(heap, x)
            at = bisect_left(rooms, (room[k], k))
        rooms.pop(at)
        room[k] -= s
        cost[k] += LINEAR * s + QUADRATIC * s * s
        insort(rooms, (room[k], k))
        heapq.heappush(heap, (cost[k], k))
        where[i] = k
    return where


def packed(sizes: DataFrame, specs: DataFrame, bins_per_shard: int = 1000, most_specs: int = 1000, pieces_per_shard: int = 500_000) -> DataFrame:
    """(spec_id, capacity, doc_id, piece, token_from, n_tokens, container) of every piece for every capacity.

    sizes: (doc_id, n_tokens), doc_id unique, n_tokens null counts as 0. A document is cut only if it is larger than
    the capacity: into full containers of its own ("F-...") and a rest that is packed with the others ("S-...").
    Specs with a null or non-positive capacity are ignored. An empty table of documents gives an empty result. A shard
    has about ``bins_per_shard`` containers and at most about ``pieces_per_shard`` pieces, so that very many empty texts,
    which need no space, do not fall into one.
    """
    rows = [r for r in bounded_rows(specs.select("spec_id", "capacity").distinct(), most_specs, "container_spec") if r["capacity"] and r["capacity"] > 0]
    sizes = materialize(sizes.select("doc_id", F.coalesce("n_tokens", F.lit(0)).alias("n")))
    schema = "spec_id int, capacity int, doc_id long, piece int, token_from long, n_tokens long, container string"
    if not rows:
        return sizes.sparkSession.createDataFrame([], schema)
    rest = [F.when(F.col("n") > r["capacity"], F.col("n") % r["capacity"]).otherwise(F.col("n")) for r in rows]
    totals = sizes.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(f"t{i}") for i, c in enumerate(rest)]).first()
    each = F.array(
        *[
            F.struct(
                F.lit(int(r["spec_id"])).alias("spec_id"),
                F.lit(int(r["capacity"])).alias("capacity"),
                F.when(F.col("n") > r["capacity"], F.floor(F.col("n") / r["capacity"])).otherwise(0).cast("int").alias("full"),
                rest[i].cast("long").alias("rest"),
                F.pmod(F.xxhash64("doc_id"), F.lit(max(1, round(totals[f"t{i}"] / r["capacity"] / bins_per_shard), totals["n"] // pieces_per_shard))).cast("int").alias("shard"),
            )
            for i, r in enumerate(rows)
        ]
    )
    pieces = sizes.select("doc_id", "n", F.explode(each).alias("s")).select("doc_id", "n", "s.*")
    whole = (
        pieces.where("full > 0")
        .select("*", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("piece"))
        .select(
            "spec_id", "capacity", "doc_id", "piece", (F.col("piece") * F.col("capacity").cast("long")).alias("token_from"), F.col("capacity").cast("long").alias("n_tokens"),
            F.concat_ws("-", F.lit("F"), "doc_id", "piece").alias("container"),
        )
    )

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id", kind="stable")
        capacity, shard = int(pdf["capacity"].iloc[0]), int(pdf["shard"].iloc[0])
        k = pack(pdf["rest"].to_numpy(), capacity)
        return pd.DataFrame(
            {
                "spec_id": pdf["spec_id"], "capacity": pdf["capacity"], "doc_id": pdf["doc_id"], "piece": pdf["full"], "token_from": pdf["full"].astype("int64") * capacity, "n_tokens": pdf["rest"],
                "container": [f"S-{shard}-{x}" for x in k],
            }
        )

    mixed = pieces.where("rest > 0 or full = 0").select("spec_id", "capacity", "doc_id", "full", "rest", "shard").groupBy("spec_id", "shard").applyInPandas(place, schema)
    return whole.unionByName(mixed)


def fill_report(pieces: DataFrame) -> DataFrame:
    """(spec_id, capacity, n_containers, n_tokens, n_unused): how full the containers of each capacity are."""
    used = pieces.groupBy("spec_id", "capacity", "container").agg(F.sum("n_tokens").alias("t"))
    sums = used.groupBy("spec_id", "capacity").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("t").alias("n_tokens"))
    return sums.select("*", (F.col("n_containers") * F.col("capacity") - F.col("n_tokens")).alias("n_unused"))
