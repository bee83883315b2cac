"""SimHash near-duplicates, linked through vantage-point trees.

A text's fingerprint has a bit set when more than half of its shingles' hashes
have it.  Distinct fingerprints are dealt to shards by a vantage-point tree: a
node has a vantage fingerprint and a radius, and a fingerprint's Hamming
distance to the vantage says on which side it lies.  A fingerprint within the
link distance of the border is also sent, as a guest, to the other side: by the
triangle inequality every linked pair then meets in the home shard of each of
its two ends.  Within a shard the tree goes on until leaves are small enough to
compare bit by bit.

A shard returns a spanning forest of its links, never all pairs of a group, and
the forests' connected components are found by Spark joins.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.llm.common import cut, pick, stored
from tillscope.llm.components import components
from tillscope.llm.worker import kept

SEED = 42
#: Distinct fingerprints that a shard should hold.
SHARD_SIZE = 25_000
#: Most shards of a tree, and sampled fingerprints for each; this bounds what the driver gathers.
MOST_SHARDS = 16_384
SAMPLE_PER_SHARD = 32
#: Fingerprints of a leaf that are compared bit by bit.
LEAF = 512
#: Vantage candidates tried at a node.
CANDIDATES = 8
#: Shingles hashed at a time.
BLOCK = 50_000

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words(text: str) -> list[bytes]:
    """Words between space, tab, line and page breaks, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split()


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of the text's shingles, repeats included; 0 for a text without words."""
    own = words(text or "")
    if not own:
        return 0
    joined, ends = b" ".join(own), np.cumsum([len(w) + 1 for w in own]) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    count = max(1, len(own) - shingle + 1)
    last = ends[shingle - 1:] if len(own) >= shingle else ends[-1:]
    pairs, votes, hashed = list(zip(begins[:count].tolist(), last.tolist())), np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, count, BLOCK):
        h = np.array([hashed(joined[a:b], SEED) for a, b in pairs[at:at + BLOCK]], dtype="<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` (the fingerprint as a signed long), one row for each input row."""
    rows = pick(docs, doc_id=id_col, text=text_col).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("simhash")
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column("text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return rows.mapInArrow(run, "doc_id long, fp long")


def _distance(fps: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(fps ^ vantage).astype(np.int16)


def choose(fps: np.ndarray, reach: int, rng: np.random.Generator) -> tuple[np.uint64, int] | None:
    """Vantage and radius that send the fewest to both sides, or None if nothing splits them."""
    best = None
    for vantage in rng.choice(fps, min(CANDIDATES, len(fps)), replace=False):
        upto = np.cumsum(np.bincount(_distance(fps, vantage), minlength=65))
        for radius in np.flatnonzero((upto >= 0.3 * len(fps)) & (upto <= 0.7 * len(fps))):
            both = upto[min(64, radius + reach)] - (upto[radius - reach] if radius >= reach else 0)
            lopsided = abs(upto[radius] / len(fps) - 0.5)
            cost = both / len(fps) + lopsided / 2
            if best is None or cost < best[0]:
                best = (cost, vantage, int(radius))
    return best and best[1:]


def sides(fps, home, vantage, radius: int, reach: int):
    """Fingerprints and home flags of the inner and of the outer side.

    What lies on a side is at home there if it was at home before; what lies
    within ``reach`` of the border is a guest on the other side.
    """
    d = _distance(fps, vantage)
    inside, near_inside, near_outside = d <= radius, d <= radius + reach, d > radius - reach
    return ((fps[near_inside], (home & inside)[near_inside]), (fps[near_outside], (home & ~inside)[near_outside]))


def build_tree(sample: np.ndarray, shards: int, reach: int) -> dict:
    """Tree with about ``shards`` leaves, chosen on a sample; every fingerprint has its place in it."""
    rng, number = np.random.default_rng(SEED), [0]

    def grow(fps: np.ndarray, leaves: int) -> dict:
        split = choose(fps, reach, rng) if leaves > 1 and len(fps) >= 16 else None
        if split is None:
            number[0] += 1
            return {"leaf": number[0] - 1}
        inner = _distance(fps, split[0]) <= split[1]
        mine = max(1, round(leaves * inner.mean()))
        return {"vantage": split[0], "radius": split[1], "in": grow(fps[inner], mine),
                "out": grow(fps[~inner], max(1, leaves - mine))}

    return grow(sample, shards)


def route(tree: dict, fps: np.ndarray, home: np.ndarray, reach: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(shard, fingerprints, home flags)`` of each shard that these fingerprints reach."""
    if not len(fps):
        return
    if "leaf" in tree:
        yield tree["leaf"], fps, home
        return
    for side, (own, at_home) in zip(("in", "out"), sides(fps, home, tree["vantage"], tree["radius"], reach)):
        yield from route(tree[side], own, at_home, reach)


class Forest:
    """Union of linked fingerprints by their positions; each class points to its smallest position."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, at: np.ndarray) -> np.ndarray:
        while True:
            up = self.parent[at]
            if np.array_equal(up, at):
                return at
            self.parent[at] = self.parent[up]
            at = up

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.roots(a), self.roots(b)
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.parent, np.maximum(ra, rb), np.minimum(ra, rb))


def _masks(reach: int) -> np.ndarray:
    """All 64-bit masks with 1 to ``reach`` bits."""
    ones, level, out = np.uint64(1) << np.arange(64, dtype=np.uint64), np.zeros(1, np.uint64), []
    for _ in range(reach):
        level = np.unique(level[:, None] | ones[None, :])
        out.append(level)
    found = np.unique(np.concatenate(out)) if out else level[:0]
    return found[found != 0]


def shard_links(fps: np.ndarray, home: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest ``(fingerprint, smallest of its class)`` of the shard's links that touch a home fingerprint."""
    order = np.argsort(fps)
    fps, home = fps[order], home[order]
    forest, rng, todo = Forest(len(fps)), np.random.default_rng(SEED), [np.arange(len(fps))]
    todo = [(todo[0], home)]
    while todo:
        at, mine = todo.pop()
        if not mine.any():
            continue
        split = None
        if len(at) > LEAF:
            split = choose(fps[at], reach, rng)
        if split is not None:
            d = _distance(fps[at], split[0])
            inner, low, high = d <= split[1], d <= split[1] + reach, d > split[1] - reach
            if low.sum() < 0.95 * len(at) and high.sum() < 0.95 * len(at):
                todo += [(at[low], (mine & inner)[low]), (at[high], (mine & ~inner)[high])]
                continue
        own = at[mine]
        if len(at) <= 8 * LEAF:
            for k in range(0, len(own), LEAF):
                near = np.bitwise_count(fps[own[k:k + LEAF], None] ^ fps[None, at]) <= reach
                a, b = np.nonzero(near)
                forest.link(own[k:k + LEAF][a], at[b])
        else:  # a crowd that no vantage splits: look up every mask of the reach instead of comparing pairs
            crowd = fps[at]
            for mask in _masks(reach):
                wanted = fps[own] ^ mask
                found = np.minimum(np.searchsorted(crowd, wanted), len(crowd) - 1)
                hit = crowd[found] == wanted
                forest.link(own[hit], at[found[hit]])
    roots = forest.roots(np.arange(len(fps)))
    moved = np.flatnonzero(roots != np.arange(len(fps)))
    return fps[moved], fps[roots[moved]]


def links(fps: DataFrame, reach: int = 2, shard_size: int = SHARD_SIZE) -> DataFrame:
    """Edges ``a, b`` that join all of the distinct fingerprints ``fp`` within ``reach`` bits of each other."""
    count = fps.count()
    shards = min(MOST_SHARDS, -(-count // shard_size)) or 1
    sample = fps.orderBy(F.xxhash64("fp"), "fp").limit(shards * SAMPLE_PER_SHARD) if shards > 1 else fps.limit(0)
    own = np.array([r["fp"] for r in sample.collect()], dtype=np.int64).view(np.uint64)
    tree = build_tree(own, shards, reach)

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine = batch.column("fp").to_numpy().view(np.uint64)
            for shard, dealt, home in route(tree, mine, np.ones(len(mine), bool), reach):
                yield pa.RecordBatch.from_pydict({"shard": np.full(len(dealt), shard, np.int32),
                                                  "fp": dealt.view(np.int64), "home": home})

    def link(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        a, b = shard_links(group["fp"].to_numpy().view(np.uint64), group["home"].to_numpy(dtype=bool), reach)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return fps.mapInArrow(deal, "shard int, fp long, home boolean").groupBy("shard").applyInPandas(
        link, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3, reach: int = 2, id_col: str = "doc_id",
                    text_col: str = "text", shard_size: int = SHARD_SIZE) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row.

    Texts whose fingerprints differ in ``reach`` bits or fewer are linked;
    ``component_id`` is the smallest doc_id reachable over links.

    * null and empty texts have fingerprint zero and are linked like any other;
    * rows that repeat an id or a text each give a row; a null id counts for
      reachability but is never a component's smallest id (null if it has no other);
    * texts of any length are hashed whole, in blocks;
    * an empty table gives an empty result; other columns are ignored.
    """
    own = stored(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    classes = cut(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    # roots are fingerprints; a component's id is the least document of its fingerprints
    rooted = components(links(classes.select("fp"), reach, shard_size))
    reached = cut(rooted.join(classes, rooted["node"] == classes["fp"]).select("node", "root", "least"))
    # tables of their own, so that the joins can be split where a component or a fingerprint is hot
    ids = cut(reached.groupBy("root").agg(F.min("least").alias("component_id")))
    joined = cut(reached.join(ids, "root").select(F.col("node").alias("fp"), "component_id"))
    by_class = cut(classes.join(joined, "fp", "left").select(
        "fp", F.coalesce("component_id", "least").alias("component_id")))
    return own.join(by_class, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
