r"""Conversation prefix trie, built as a Patricia tree over sorted conversations.

A conversation is the string of its turns' 16-byte digests (``path``); equal conversations become one
row, with how many they are and the digest of their ids. Paths are sorted by range into chunks of about
``TURNS`` turns, and each chunk builds the part of the tree that is its own: from the common prefixes of
neighbours a stack creates only branch, end and leaf points, each with the compressed edge above it, and
sums up conversations, leaves and saved words when a point is closed. Unary nodes inside an edge have
its members; their sums are the suffix sums of the edge, and Spark expands them last.

What two chunks share is the path down to the common prefix of the last conversation of one and the
first of the next. Those nodes (the root, and the seams) come out of every chunk with what hangs below
them there, are added up by their digest, and are settled from the deepest up in one small task: there are
two seams a chunk, each as long as what two neighbours share.

Ids of equal conversations meet as sorted strings of ``BLOCK`` consecutive ids, made before the
shuffle that brings them together, and are hashed as they stream by: a conversation that a third of all
equal costs a row per block and no memory.

Defined cases: a null role or text is empty, a null turn comes first, turns that tie are ordered by the
digest of role and text, repeated rows are turns of their own; rows without a conv_id belong to no
conversation and are left out; a conversation may have no turns, its end is the root; no conversations
give no nodes; other columns of the input are left out, so their names don't matter. A conversation is
one row, and its path 16 bytes a turn, whatever the length of its texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tributary.llm.shared import bounded, release, saved

WORD = r"[^\x20\x09-\x0D]+"
SIZE = 16
#: Turns in a chunk of the sorted conversations.
TURNS = 100_000
#: Ids that are joined before the shuffle of equal conversations.
BLOCK = 4096
#: Conversations of one family: those of a family begin with turns of its first one.
FAMILY, MOST_SHARED = 20, 3

NONE = hashlib.sha256(b"").hexdigest()
SEQUENCES = "path binary, words array<int>, n long, conv_id long, ends string"
PARTS = "seam boolean, key binary, parent_key binary, parent_conv_id long, conv_id long, depth long, words long, n_convs long, n_children long, n_leaves long, saved array<long>, ends string"
SEAMS = "key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"


def digested(turns: DataFrame) -> DataFrame:
    """Per conv_id: ``turns``, in order, as structs of the digest of (role, text) and the words of the text."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    key = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    rows = turns.where(F.col("conv_id").isNotNull()).select("conv_id", F.struct("turn", key.alias("key"), F.regexp_count(text, F.lit(WORD)).alias("words")).alias("turn"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))


def rebuilt(convs: DataFrame) -> DataFrame:
    """Conversations that begin with the first h turns of their family's first, h by crc32 of the id."""
    family = F.col("conv_id") - F.col("conv_id") % FAMILY
    heads = convs.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("family"), F.slice("turns", 1, MOST_SHARED).alias("head"))
    h = (F.crc32(F.encode(F.col("conv_id").cast("string"), "utf-8")) % (MOST_SHARED + 1)).cast("int")
    met = convs.withColumn("family", family).join(heads, "family", "left").withColumn("h", h)
    none = F.slice("turns", 1, 0)
    return met.select("conv_id", F.concat(F.slice(F.coalesce("head", none), F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


def distinct_paths(convs: DataFrame) -> DataFrame:
    """Distinct conversations: path, words of each turn, how many, smallest conv_id, digest of the ids."""
    path = F.unhex(F.array_join(F.transform("turns", lambda x: x["key"]), ""))
    rows = convs.select("conv_id", path.alias("path"), F.transform("turns", lambda x: x["words"]).alias("words"), F.floor(F.col("conv_id") / BLOCK).alias("block"))
    ids = F.array_join(F.sort_array(F.collect_list("conv_id")), ",")
    blocks = rows.groupBy("path", "block").agg(F.first("words").alias("words"), F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), ids.alias("ids"))
    return blocks.repartition("path").sortWithinPartitions("path", "block").mapInPandas(hashed, SEQUENCES)


def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per path out of the blocks of its ids, which come in order."""
    own = None
    for frame in frames:
        out = []
        for path, words, n, conv, ids in zip(frame["path"], frame["words"], frame["n"], frame["conv_id"], frame["ids"], strict=True):
            if own is not None and own[0] == path:
                own[2] += n
                own[4].update(b"," + ids.encode())
                continue
            if own is not None:
                out.append((*own[:4], own[4].hexdigest()))
            own = [path, words, n, conv, hashlib.sha256(ids.encode())]
        yield pd.DataFrame(out, columns=["path", "words", "n", "conv_id", "ends"])
    if own is not None:
        yield pd.DataFrame([(*own[:4], own[4].hexdigest())], columns=["path", "words", "n", "conv_id", "ends"])


def common(a: bytes, b: bytes) -> int:
    """Turns that two paths share from the start."""
    low, high = 0, min(len(a), len(b)) // SIZE
    while low < high:
        middle = (low + high + 1) // 2
        if a[low * SIZE : middle * SIZE] == b[low * SIZE : middle * SIZE]:
            low = middle
        else:
            high = middle - 1
    return low


@dataclass
class Point:
    """A branch, end or leaf point, with what is known of its subtree so far."""

    depth: int
    n: int = 0
    conv: int | None = None
    ends: str | None = None
    children: int = 0
    leaves: int = 0
    saved: int = 0
    edges: list[dict] = field(default_factory=list)  # of its children, until its smallest member is known

    def add(self, n: int, conv: int, leaves: int = 0, saved: int = 0, child: bool = False) -> None:
        self.n, self.conv = self.n + n, conv if self.conv is None else min(self.conv, conv)
        self.children, self.leaves, self.saved = self.children + child, self.leaves + leaves, self.saved + saved


def seam_key(path: bytes, depth: int) -> bytes:
    return hashlib.md5(path[: depth * SIZE]).digest()


def grown(chunk: pd.DataFrame) -> pd.DataFrame:
    """The compressed tree of one chunk: edges that are its own, and its part of the seams.

    chunk: distinct conversations, and how many turns the first shares with the chunk before (left), the
    last with the one behind (right).
    """
    chunk = chunk.sort_values("path")
    rows = list(zip(chunk["path"], chunk["words"], chunk["n"], chunk["conv_id"], chunk["ends"], strict=True))
    left, right = int(chunk["left"].iloc[0]), int(chunk["right"].iloc[0])
    (first, first_words), (last, last_words) = rows[0][:2], rows[-1][:2]
    shared = [0, *(common(a[0], b[0]) for a, b in zip(rows, rows[1:], strict=False))]
    from_first = list(accumulate(shared[1:], min, initial=len(first) // SIZE))
    to_last = list(accumulate(shared[:0:-1], min, initial=len(last) // SIZE))[::-1]
    both = min(left, from_first[-1])  # depths at which the first path's seam is the last's too
    seams = {("first", d): Point(d) for d in range(left + 1)} | {("last", d): Point(d) for d in range(both + 1, right + 1)}
    done: list[dict] = []
    stack: list[Point] = []

    def close(to: int, words, seam: tuple[str, int]) -> None:
        """End the points deeper than `to` of the path whose words and seam these are."""
        while stack and stack[-1].depth > to:
            x = stack.pop()
            above = stack[-1].depth if stack else seam[1]
            if to > above:  # the next path leaves inside this edge
                stack.append(Point(to))
                above = to
            x.leaves = x.leaves or 1
            # from the bottom of the edge up: sums of (n - 1) times the words
            sums = list(accumulate(((x.n - 1) * int(w) for w in words[above : x.depth][::-1]), initial=x.saved))[1:]
            edge = {"conv_id": x.conv, "depth": x.depth, "n_convs": x.n, "n_children": x.children, "n_leaves": x.leaves, "saved": sums[::-1], "ends": x.ends, "seam": False}
            done.extend(e | {"parent_conv_id": x.conv} for e in x.edges)
            if stack:
                stack[-1].edges.append(edge)
            else:
                done.append(edge | {"parent_key": seam_key(first if seam[0] == "first" else last, seam[1])})
            (stack[-1] if stack else seams[seam]).add(x.n, x.conv, x.leaves, sums[-1], child=True)

    before = None
    for (path, words, n, conv, ends), share, a, b in zip(rows, shared, from_first, to_last, strict=True):
        a, b = min(a, left), min(b, right)
        seam = ("first", a) if a >= b else ("last", b)
        if before:
            close(share, *before)
        before = words, seam
        here = Point(len(path) // SIZE) if len(path) // SIZE > seam[1] else seams[seam]
        here.add(n, conv)
        here.ends = ends
        if here.depth > seam[1]:
            stack.append(here)
    close(-1, *before)
    for (side, d), x in seams.items():
        path, words = (first, first_words) if side == "first" else (last, last_words)
        own = {"key": seam_key(path, d), "parent_key": seam_key(path, d - 1) if d else None, "words": int(words[d - 1]) if d else 0, "seam": True}
        done.append(own | {"conv_id": x.conv, "depth": d, "n_convs": x.n, "n_children": x.children, "n_leaves": x.leaves, "saved": [x.saved], "ends": x.ends})
    names = [c.split()[0] for c in PARTS.split(", ")]
    out = pd.DataFrame(done, columns=names)
    return out.astype({c: "Int64" for c in names if f"{c} long" in PARTS})


def bounds_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for x in frames:
        share = lambda a, b: [0 if p is None or q is None else common(p, q) for p, q in zip(a, b, strict=True)]
        yield pd.DataFrame({"chunk": x["chunk"], "left": share(x["before"], x["first"]), "right": share(x["last"], x["after"])})


def settled(seams: pd.DataFrame) -> pd.DataFrame:
    """The nodes that chunks share, added up from the deepest to the root."""
    seams = seams.sort_values("depth", ascending=False)
    rows = {r.key: r for r in seams.itertuples(index=False)}
    total = {k: Point(r.depth, r.n_convs, None if pd.isna(r.conv_id) else int(r.conv_id), r.ends, r.n_children, r.n_leaves, r.saved) for k, r in rows.items()}
    for k, r in rows.items():
        x = total[k]
        x.leaves = x.leaves if x.children else 1
        x.saved += (x.n - 1) * r.words
        if r.parent_key is not None:
            total[r.parent_key].add(x.n, x.conv, x.leaves, x.saved, child=True)
    out = [(k, x.conv, x.depth, total[rows[k].parent_key].conv if x.depth else None, x.n, x.children, x.leaves, x.saved, x.ends) for k, x in total.items()]
    frame = pd.DataFrame(out, columns=[c.split()[0] for c in SEAMS.split(", ")])
    return frame.astype({"parent_conv_id": "Int64"})


def trie(convs: DataFrame) -> DataFrame:
    """The nodes of the trie of ``digested`` (or ``rebuilt``) conversations.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256.
    """
    paths = saved(distinct_paths(convs), "paths")
    turns = paths.agg(F.sum(F.size("words"))).first()[0] or 0
    chunks = saved(paths.repartitionByRange(1 + turns // TURNS, "path").withColumn("chunk", F.spark_partition_id()), "chunks")
    by_chunk = Window.orderBy("chunk")  # one row per chunk
    ends = chunks.groupBy("chunk").agg(F.min("path").alias("first"), F.max("path").alias("last"))
    ends = ends.select("chunk", "first", "last", F.lag("last").over(by_chunk).alias("before"), F.lead("first").over(by_chunk).alias("after"))
    bounds = saved(ends.mapInPandas(bounds_of, "chunk int, left int, right int"), "bounds")
    release(paths)
    parts = saved(chunks.join(bounds, "chunk").groupBy("chunk").applyInPandas(lambda x: grown(x), PARTS), "parts")
    release(chunks, bounds)
    seams = parts.where("seam").groupBy("key").agg(
        *(F.first(c).alias(c) for c in ("parent_key", "depth", "words")),
        F.min("conv_id").alias("conv_id"), F.max("ends").alias("ends"), F.sum(F.col("saved")[0]).alias("saved"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves")),
    )
    nodes = saved(seams.withColumn("tree", F.lit(0)).groupBy("tree").applyInPandas(lambda x: settled(x), SEAMS), "seams")
    # an edge below a seam learns its parent's member; the table of seams has the size that Spark sees
    above = nodes.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("seam_conv_id"))
    edges = parts.where(~F.col("seam")).join(above, "parent_key", "left").withColumn("above", F.coalesce("parent_conv_id", "seam_conv_id"))
    inner = edges.select("*", F.posexplode("saved").alias("at", "saved_tokens"))
    bottom = F.col("at") == F.size("saved") - 1
    inner = inner.select(
        "conv_id",
        (F.col("depth") - F.size("saved") + 1 + F.col("at")).alias("depth"),
        F.when(F.col("at") == 0, F.col("above")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        "n_convs",
        F.when(bottom, F.col("n_children")).otherwise(1).cast("long").alias("n_children"),
        "n_leaves", "saved_tokens",
        F.when(bottom, F.col("ends")).alias("ends"),
    )
    both = inner.unionByName(nodes.drop("key"))
    return both.withColumn("ends_sha256", F.coalesce("ends", F.lit(NONE))).drop("ends")


def op11(turns: DataFrame) -> DataFrame:
    bounded(turns.sparkSession)
    convs = saved(digested(turns), "conversations")
    nodes = trie(rebuilt(convs))
    release(convs)
    return nodes
