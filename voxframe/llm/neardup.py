"""P4: near-duplicate responses, by tensored banding.

Within one question, texts of ``MIN_WORDS`` or more different words are near-duplicates from a Jaccard similarity of
``threshold`` of their word sets on.

Two small collections of ``BANDS`` minhash bands each (``BAND_WIDTH`` minhashes a band) are worked out per text.  A table
key is a *pair* of one band from either collection, so ``BANDS ** 2`` tables of ``2 * BAND_WIDTH`` rows cost only
``2 * BANDS * BAND_WIDTH`` minhashes instead of ``2 * BANDS ** 2 * BAND_WIDTH``.  Two texts of similarity s meet with probability
``(1 - (1 - s ** BAND_WIDTH) ** BANDS) ** 2``: 0.965 at 0.7, 0.996 at 0.8, over 0.999 from 0.85 on.

What keeps it cheap:

* texts with the same word set are one node from the start (its id is a hash of question and words), so copies, however many,
  neither enter a bucket twice nor make pairs there;
* a bucket row is three numbers: the bucket, the node, and a sketch: the parities of ``SKETCH_BITS`` classes of words and the number of words.  Each differing
  bit needs a differing word, so a pair whose sketches differ in more bits than the threshold allows differing words cannot be a
  near-duplicate; that test is exact on the safe side and runs in the join condition, before a pair is written anywhere;
* buckets of a band value that more than ``BLOCK_ROWS`` nodes share are cut into blocks (``common.spread``); counting the six band values of a node tells
  which these are without counting its 36 buckets;
* texts are fetched for candidate pairs only, and verified on the words themselves.

No bucket is capped and no text is cut.  Defined cases: null texts and texts of fewer words take no part; a repeated key counts
once (if its deliveries differ, each text links it, but never to itself); an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import NON_WORD_PATTERN, WORD_PATTERN, map_columns, shared_checkpoint, spread

MIN_WORDS = 20
THRESHOLD = (7, 10)
BANDS = 6
BAND_WIDTH = 2
SKETCH_BITS = 56
BLOCK_ROWS = 4_000
_SEED = 20240229
#: A word count that says "this many or more": such a text is not ruled out by its sketch.
MANY = 255


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    made = np.random.default_rng(_SEED)
    odd = made.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return odd, made.integers(0, 1 << 63, n, dtype=np.uint64)


def _avalanche(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def sketch_batch(scopes: list, texts: list[str], min_words: int) -> dict[str, list]:
    """Word sets of a batch of texts as node ids, sketches and the bands of the two collections.

    ``at`` are the positions of the texts with enough words.
    """
    word, drop = regex.compile(WORD_PATTERN), regex.compile(NON_WORD_PATTERN)
    memo: dict[str, int] = {}
    at, forms, flat, edges, seeds = [], [], [], [0], []
    for i, text in enumerate(texts):
        low = text.lower()
        words = set(word.findall(low))
        if len(words) < min_words:
            continue
        for w in words:
            h = memo.get(w)
            if h is None:
                h = memo[w] = xxhash.xxh3_64_intdigest(w)
            flat.append(h)
        at.append(i)
        edges.append(len(flat))
        forms.append(xxhash.xxh3_64_intdigest(drop.sub("", low)) - (1 << 63))
        seeds.append(xxhash.xxh3_64_intdigest(str(scopes[i])))
    if not at:
        return {"at": [], "node": [], "form": [], "sketch": [], "left": [], "right": []}
    h = np.array(flat, dtype=np.uint64)
    starts = np.array(edges[:-1])
    with np.errstate(over="ignore"):
        mixed = _avalanche(h)
        node = np.add.reduceat(_avalanche(mixed ^ np.uint64(0x5851F42D4C957F2D)), starts) ^ np.bitwise_xor.reduceat(mixed, starts)
        node = _avalanche(node ^ np.array(seeds, dtype=np.uint64))
        bit = np.uint64(1) << (mixed % np.uint64(SKETCH_BITS))
        sketch = np.bitwise_xor.reduceat(bit, starts) | np.minimum(np.diff(edges), MANY).astype(np.uint64) << np.uint64(SKETCH_BITS)
        a, b = _coefficients(2 * BANDS * BAND_WIDTH)
        least = np.stack([np.minimum.reduceat(_avalanche(h * x + y), starts) for x, y in zip(a, b)])
        bands = []
        for k in range(2 * BANDS):
            joined = np.array(seeds, dtype=np.uint64) ^ np.uint64(k + 1)  # tables of one scope are its own
            for row in least[k * BAND_WIDTH : (k + 1) * BAND_WIDTH]:
                joined = _avalanche(joined * np.uint64(0x9E3779B97F4A7C15) + row)
            bands.append(joined)
    sides = np.stack(bands, axis=1).view(np.int64)
    return {
        "at": at,
        "node": node.view(np.int64).tolist(),
        "form": forms,
        "sketch": sketch.view(np.int64).tolist(),
        "left": sides[:, :BANDS].tolist(),
        "right": sides[:, BANDS:].tolist(),
    }


_NODE_SCHEMA = "node bigint, form bigint, sketch bigint, `left` array<bigint>, `right` array<bigint>"


def nodes(responses: DataFrame, key: str, scope: str, text: str, min_words: int) -> DataFrame:
    """One row per text with enough words: its key and text, and the node, form, sketch and bands."""
    kinds = dict(responses.dtypes)

    def run(columns: dict[str, list]) -> dict[str, list]:
        got = sketch_batch(columns["scope"], columns["text"], min_words)
        at = got.pop("at")
        return {"key": [columns["key"][i] for i in at], "text": [columns["text"][i] for i in at]} | got

    # n different words need n characters and n - 1 between them
    source = responses.where(F.length(text) >= 2 * min_words - 1).select(
        F.col(key).alias("key"), F.col(scope).alias("scope"), F.col(text).alias("text")
    )
    return map_columns(source, run, f"key {kinds[key]}, text string, {_NODE_SCHEMA}")


def _met(a: DataFrame, b: DataFrame, keys: list[str], threshold: tuple[int, int]) -> DataFrame:
    """Pairs of nodes with equal keys that their sketches do not rule out."""
    p, q = threshold
    a, b = a.alias("a"), b.alias("b")
    words = lambda s: F.shiftrightunsigned(f"{s}.sketch", SKETCH_BITS)
    differing = F.bit_count(F.col("a.sketch").bitwiseXOR(F.col("b.sketch")).bitwiseAND(F.lit((1 << SKETCH_BITS) - 1)))
    # a similarity of p/q leaves at most (q - p) / (q + p) of the summed sizes as differing words
    possible = (p + q) * differing <= (q - p) * (words("a") + words("b"))
    return (
        a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys])
        .where(F.col("a.node") < F.col("b.node"))
        .where(possible | (F.greatest(words("a"), words("b")) >= MANY))
        .select(F.col("a.node").alias("node_a"), F.col("b.node").alias("node_b"))
    )


def _candidates(sets: DataFrame, threshold: tuple[int, int], block_rows: int) -> DataFrame:
    """Pairs of nodes that share a table and that the sketch does not rule out."""
    bands = sets.select("node", "sketch", "right", F.posexplode("left").alias("i", "x"))
    hot = shared_checkpoint(bands.groupBy("i", "x").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block_rows).select("i", "x"))
    bucket = F.explode(F.transform("right", lambda y, j: F.xxhash64("x", y, F.col("i") * BANDS + j))).alias("bucket")
    cold = bands.join(hot, ["i", "x"], "left_anti").select(bucket, "node", "sketch")
    found = _met(cold, cold, ["bucket"], threshold)
    if not hot.isEmpty():
        warm = bands.join(hot, ["i", "x"], "left_semi").select(bucket, "node", "sketch")
        found = found.unionByName(_met(*spread(warm, warm, ["bucket"], "node", block_rows), ["bucket", "block"], threshold))
    return found.distinct()


def near_duplicates(
    responses: DataFrame,
    key: str = "response_key",
    scope: str = "question_id",
    text: str = "response_text",
    min_words: int = MIN_WORDS,
    threshold: tuple[int, int] = THRESHOLD,
    block_rows: int = BLOCK_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """``(links, members)``: verified links between classes, and the class of every key.

    A class is a word set with a squeezed form: ``members`` has ``key, node, form``, ``links`` has
    ``node_a, form_a, node_b, form_b`` with different forms.
    """
    p, q = threshold
    made = shared_checkpoint(nodes(responses, key, scope, text, min_words))
    members = made.select("key", "node", "form").distinct()
    sets = made.select("node", "sketch", "left", "right").distinct()
    forms = made.groupBy("node").agg(F.min("form").alias("lo"), F.max("form").alias("hi"))
    within = forms.where("lo <> hi").select(F.col("node").alias("node_a"), F.col("node").alias("node_b"))
    pairs = shared_checkpoint(_candidates(sets, threshold, block_rows).unionByName(within))
    # only texts of a pair leave their place
    met = pairs.select(F.col("node_a").alias("node")).union(pairs.select("node_b")).distinct()
    classes = shared_checkpoint(made.join(met, "node", "left_semi").groupBy("node", "form").agg(F.min("text").alias("text")))
    joined = (
        pairs.join(classes.select(F.col("node").alias("node_a"), F.col("form").alias("form_a"), F.col("text").alias("text_a")), "node_a")
        .join(classes.select(F.col("node").alias("node_b"), F.col("form").alias("form_b"), F.col("text").alias("text_b")), "node_b")
        .where("form_a <> form_b AND (node_a <> node_b OR form_a < form_b)")
    )

    def verify(columns: dict[str, list]) -> dict[str, list]:
        word = regex.compile(WORD_PATTERN)
        out: dict[str, list] = {n: [] for n in ("node_a", "form_a", "node_b", "form_b")}
        for i, (x, y) in enumerate(zip(columns["text_a"], columns["text_b"])):
            left, right = set(word.findall(x.lower())), set(word.findall(y.lower()))
            if q * len(left & right) >= p * len(left | right):
                for n in out:
                    out[n].append(columns[n][i])
        return out

    links = shared_checkpoint(map_columns(joined, verify, "node_a bigint, form_a bigint, node_b bigint, form_b bigint"))
    return links, members


def near_pairs(responses: DataFrame, key: str = "response_key", **options) -> DataFrame:
    """Pairs of keys, the smaller first, of near-duplicate texts that differ when squeezed."""
    links, members = near_duplicates(responses, key=key, **options)
    side = lambda s: members.select(F.col("node").alias(f"node_{s}"), F.col("form").alias(f"form_{s}"), F.col("key").alias(f"key_{s}"))
    return (
        links.join(side("a"), ["node_a", "form_a"])
        .join(side("b"), ["node_b", "form_b"])
        .where("key_a <> key_b")
        .select(F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b"))
        .distinct()
    )


def near_groups(responses: DataFrame, key: str = "response_key", **options) -> DataFrame:
    """One row per key with its group (the smallest key linked to it, directly or not) and its number of links.

    Groups are found on classes (``components``).  Keys of one class share its links; keys without a link stay their own group.
    """
    links, members = near_duplicates(responses, key=key, **options)
    c = F.struct("node", "form")
    side = lambda s: F.struct(F.col(f"node_{s}").alias("node"), F.col(f"form_{s}").alias("form")).alias(s)
    links = links.select(side("a"), side("b"))
    size = members.groupBy(c.alias("c")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first"))
    rooted = size.join(components(links), "c", "left").select("c", F.coalesce("root", "c").alias("root"), "first", "n")
    label = rooted.groupBy("root").agg(F.min("first").alias("label"))
    edges = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = edges.join(size.select(F.col("c").alias("b"), "n"), "b").groupBy(F.col("a").alias("c")).agg(F.sum("n").alias("links"))
    return (
        members.select("key", c.alias("c"))
        .join(rooted.join(label, "root").select("c", "label"), "c")
        .join(degree, "c", "left")
        .groupBy(F.col("key").alias(key))
        .agg(F.min("label").alias("group_key"), F.sum(F.coalesce("links", F.lit(0))).cast("long").alias("links"))
    )
