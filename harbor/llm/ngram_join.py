"""All links of texts by the Jaccard similarity of their word n-grams, and what they connect.

Rows of equal n-gram sets are one node. The join of nodes is cut vertically: the global
order of n-grams, rare ones first, is cut into fragments; the overlap of a pair is counted
in each fragment by itself and summed per pair.

1. A set of n elements can only be linked if, of its n - ceil(0.8 n) + k first elements in
   any global order, k are in another set too (of the linked one; k for the smaller of the
   two). With hashes as order and k about a quarter of n this leaves out most nodes, and
   only these first elements are moved.
2. What is left is judged by its whole sets: 0.8 n elements must be in other sets. Elements
   of two sets or more are ranked by frequency; the ranks are the global order.
3. Pairs that share a first element by rank are candidates (the smaller set of a pair needs
   to show fewer). Nodes are first compared with the most central node of what they share,
   and what is linked is one class from then on: a large group of near copies costs a test
   a node. Then all candidates of different classes are counted, until none is left.
4. The overlap of a candidate is counted in each fragment by itself, so that no set is
   moved whole, and the counts are summed.

Nothing is capped: every linked pair of different classes is a candidate.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harbor.llm.common import text_slices, trimmed, whole_text
from harbor.llm.words import mix
from harbor.operators.components import connected_components
from harbor.sources.scratch import discard, materialize

WORDS = 5
PERCENT = 80
WITNESSES = 4  # one of so many elements more is shown in the first step
FRAGMENTS = 4
SEGMENT = 8192  # elements of a set in a fragment at most, on average
STAR_ROUNDS = 3

# In common with any linked set, at least; and with one that is not smaller, on size alone.
LEAST_COMMON = f"((size * {PERCENT} + 99) div 100)"
LEAST_OF_LARGER = f"((size * {2 * PERCENT} + {99 + PERCENT}) div {100 + PERCENT})"

ROW = "row"
SIGNED = "row long, doc_id long, text_hash long, n_shingles long, key binary, shown array<long>"


# ---------------------------------------------------------------- sets of texts


def shown_at_first(size: np.ndarray) -> np.ndarray:
    """How many elements of a set are shown in the first step."""
    return np.where(size > 0, size - (size * PERCENT + 99) // 100 + size // WITNESSES + 1, 0)


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs of five words of each text, letters A to Z in lower case: text and hash, sorted by both.

    A text of fewer words is one run; one without words has none.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, text = lists.flatten(), np.repeat(np.arange(len(texts)), np.asarray(lists.value_lengths()))
    some = pc.greater(pc.binary_length(words), 0)
    coded, text = words.filter(some).dictionary_encode(), text[np.asarray(some)]
    of_word = np.array([xxhash.xxh3_64_intdigest(word) for word in coded.dictionary.to_pylist()], np.uint64)
    values = mix(of_word)[np.asarray(coded.indices)] if len(text) else np.zeros(0, np.uint64)
    weights = mix(np.arange(1, WORDS + 1, dtype=np.uint64)) | np.uint64(1)
    counts = np.bincount(text, minlength=len(texts))
    firsts = np.cumsum(counts) - counts
    begin = np.flatnonzero(text[: max(0, len(text) - WORDS + 1)] == text[WORDS - 1 :])
    found = np.zeros(len(begin), np.uint64)
    for place in range(WORDS):
        found += values[begin + place] * weights[place]
    docs = text[begin]
    short = np.flatnonzero((counts > 0) & (counts < WORDS))
    if len(short):
        whole = counts[short].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for place in range(WORDS - 1):
            has = counts[short] > place
            whole[has] += values[firsts[short[has]] + place] * weights[place]
        docs, found = np.concatenate([docs, short]), np.concatenate([found, whole])
    found = mix(found)
    order = np.lexsort((found, docs))
    docs, found = docs[order], found[order]
    new = np.ones(len(found), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (found[1:] != found[:-1])
    return docs[new], found[new]


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(values.view(np.int64)))


def _keys(found: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> list[bytes | None]:
    """What names the set of each text; nothing for an empty one."""
    return [
        hashlib.blake2b(found[end - size : end].tobytes(), digest_size=16).digest() if size else None
        for end, size in zip(ends.tolist(), sizes.tolist(), strict=True)
    ]


def signed_rows(rows: DataFrame) -> DataFrame:
    """``rows(row, doc_id, text_hash, text)`` with the size of the set, its name and its first elements by hash."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches, "words"):
            for a, b in text_slices(batch.column(3)):
                docs, found = shingle_sets(batch.column(3).slice(a, b - a))
                sizes = np.bincount(docs, minlength=b - a)
                ends = np.cumsum(sizes)
                shown = shown_at_first(sizes)
                nth = np.arange(len(found)) - np.repeat(ends - sizes, sizes)
                columns = [batch.column(n).slice(a, b - a) for n in range(3)]
                columns += [pa.array(sizes), pa.array(_keys(found, ends, sizes), pa.binary()), _lists(found[nth < shown[docs]], shown)]
                yield pa.RecordBatch.from_arrays(columns, [ROW, "doc_id", "text_hash", "n_shingles", "key", "shown"])

    return rows.mapInArrow(sign, SIGNED)


def whole_sets(texts: DataFrame) -> DataFrame:
    """key and shingles of the distinct sets of ``texts(text)``; what repeats within a part comes once."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches, "words"):
            for a, b in text_slices(batch.column(0)):
                docs, found = shingle_sets(batch.column(0).slice(a, b - a).unique())
                sizes = np.bincount(docs, minlength=1)
                keys = _keys(found, np.cumsum(sizes), sizes)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), _lists(found, sizes)], ["key", "shingles"])

    sets = texts.select("text").mapInArrow(cut, "key binary, shingles array<long>").filter("key is not null")
    return sets.groupBy("key").agg(F.first("shingles").alias("shingles"))


# ---------------------------------------------------------------- steps 1 and 2: nodes that may have links


def _lone(each: DataFrame) -> DataFrame:
    """Of ``each(node, shingle)``, the number of elements of a node that no other node has."""
    owners = each.groupBy("shingle").agg(F.count("*").alias("n"), F.min("node").alias("node")).filter("n = 1")
    return owners.groupBy("node").agg(F.count("*").alias("lone"))


def _hopeful(signed: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes that step 1 leaves: node, key, size, text_hash."""
    copies = signed.select(ROW, "key").join(nodes.select("key", "node"), "key").filter(F.col(ROW) != F.col("node")).select(ROW)
    single = signed.filter("n_shingles > 0").join(materialize(copies, "copies", few=True), ROW, "left_anti").withColumnRenamed(ROW, "node")
    lone = _lone(single.select("node", F.explode("shown").alias("shingle")))
    sizes = single.select("node", "key", "text_hash", F.col("n_shingles").alias("size"), F.size("shown").alias("n_shown"))
    enough = F.expr(f"n_shown - coalesce(lone, 0) >= {LEAST_COMMON} div {WITNESSES} + 1")
    return sizes.join(lone, "node", "left").filter(enough).select("node", "key", "size", "text_hash")


def ranked_sets(sets: DataFrame) -> DataFrame:
    """``sets(node, size, shingles)`` as node, size, n_shared, ranks: its elements of several sets, rare ones first.

    Sets with too few of them are left out.
    """
    each = sets.select("node", F.explode("shingles").alias("shingle"))
    common = each.groupBy("shingle").agg(F.count("*").alias("n")).filter("n > 1")
    order = common.orderBy("n", "shingle").select("shingle", F.monotonically_increasing_id().alias("rank"))
    order = materialize(order, "order", few=True)
    ranks = each.join(order, "shingle").groupBy("node").agg(F.sort_array(F.collect_list("rank")).alias("ranks"))
    ranked = sets.select("node", "size").join(ranks, "node").select("node", "size", F.size("ranks").alias("n_shared"), "ranks")
    return materialize(ranked.filter(f"n_shared >= {LEAST_COMMON}"), "ranked", few=True)


# ---------------------------------------------------------------- step 3: candidates


def first_ranks(ranked: DataFrame) -> DataFrame:
    """A row for every rank that a set shows: rank, node, size, n_shared, its place, and whether it shows it to larger sets."""
    shown = F.expr(f"slice(ranks, 1, n_shared - {LEAST_COMMON} + 1)")
    each = ranked.select("node", "size", "n_shared", F.posexplode(shown).alias("place", "rank"))
    return each.withColumn("small", F.expr(f"place <= n_shared - {LEAST_OF_LARGER}"))


def _may_link(a: str, b: str) -> Column:
    """Whether two shown ranks leave room for enough common elements: those before both, this one, those after both."""
    most = f"least({a}.place, {b}.place) + least({a}.n_shared - {a}.place, {b}.n_shared - {b}.place)"
    return F.expr(f"({most}) * {100 + PERCENT} >= {PERCENT} * ({a}.size + {b}.size)")


PAIR = ["a", "b", "size_a", "size_b"]


def _stars(posts: DataFrame) -> DataFrame:
    """Each node with one node of each other class that it meets: the most central one of the rank, by what it shares."""
    central = F.struct(F.col("n_shared") / F.col("size"), -F.col("node"))
    heads = posts.groupBy("rank").agg(F.max_by(F.struct("node", "root", "size", "n_shared", "place"), central).alias("h"))
    met = posts.alias("x").join(heads, "rank").filter(F.expr("x.root <> h.root") & _may_link("x", "h"))
    together = met.groupBy("x.node", "x.size", F.col("h.root").alias("other"), F.col("h.node").alias("b"), F.col("h.size").alias("size_b"))
    together = together.agg(F.count("*").alias("n"))
    best = together.groupBy(F.col("node").alias("a"), F.col("size").alias("size_a"), "other")
    best = best.agg(F.max_by(F.struct("b", "size_b"), F.struct("n", -F.col("b"))).alias("best"))
    return best.select("a", "best.b", "size_a", "best.size_b")


def candidates(posts: DataFrame) -> DataFrame:
    """All pairs of nodes of different classes that share a shown rank and may be linked."""
    left, right = posts.filter("small").alias("x"), posts.alias("y")
    ordered = F.expr("x.size < y.size or (x.size = y.size and x.node < y.node)")
    pairs = left.join(right, (F.col("x.rank") == F.col("y.rank")) & ordered & F.expr("x.root <> y.root") & _may_link("x", "y"))
    return pairs.select(F.expr("x.node AS a"), F.expr("y.node AS b"), F.expr("x.size AS size_a"), F.expr("y.size AS size_b")).distinct()


# ---------------------------------------------------------------- step 4: partial overlaps


def segments(ranked: DataFrame) -> DataFrame:
    """The sets cut at common ranks: node, fragment, segment. A fragment holds about the same number of elements."""
    longest = ranked.agg(F.max("n_shared")).first()[0] or 0
    fragments = max(FRAGMENTS, -(-longest // SEGMENT))
    shares = [n / fragments for n in range(1, fragments)]
    cuts = ranked.select(F.explode("ranks").alias("rank")).agg(F.percentile_approx("rank", shares, 10_000)).first()[0] or []

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limits = np.array(cuts, np.int64)
        for batch in trimmed(batches, "words"):
            ranks, sizes = np.asarray(batch.column(1).flatten()), np.asarray(batch.column(1).value_lengths())
            row = np.repeat(np.arange(batch.num_rows), sizes)
            fragment = np.searchsorted(limits, ranks, "right")
            starts = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (fragment[1:] != fragment[:-1]))) if len(ranks) else np.zeros(0, np.int64)
            lengths = np.diff(np.append(starts, len(ranks)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row[starts])), pa.array(fragment[starts], pa.int32()), _lists(ranks, lengths)],
                ["node", "fragment", "segment"],
            )

    return ranked.select("node", "ranks").mapInArrow(cut, "node long, fragment int, segment array<long>")


def counted(pairs: DataFrame, cut: DataFrame) -> DataFrame:
    """``pairs(a, b, size_a, size_b)`` that are linked, with their number of common elements, summed over fragments.

    The second sets are looked up first: where they are few, as the centres of large groups are, they
    are small enough for the engine to send them to the tasks.
    """
    wanted = cut.join(pairs.select(F.col("b").alias("node")).distinct(), "node", "left_semi")
    of_a = cut.select(F.col("node").alias("a"), "fragment", F.col("segment").alias("of_a"))
    of_b = wanted.select(F.col("node").alias("b"), "fragment", F.col("segment").alias("of_b"))
    both = pairs.join(of_a, "a").join(of_b, ["b", "fragment"])
    partial = both.select(*PAIR, F.size(F.array_intersect("of_a", "of_b")).alias("n"))
    sums = partial.groupBy(*PAIR).agg(F.sum("n").alias("common"))
    return sums.filter(f"common * {100 + PERCENT} >= {PERCENT} * (size_a + size_b)").select("a", "b", "common", "size_a", "size_b")


# ---------------------------------------------------------------- classes


def _merged(roots: DataFrame, new: DataFrame) -> DataFrame:
    """``roots(id, root)`` after ``new`` links: components of the few classes that these join."""
    edges = new.join(roots.select(F.col("id").alias("a"), F.col("root").alias("ra")), "a")
    edges = edges.join(roots.select(F.col("id").alias("b"), F.col("root").alias("rb")), "b")
    edges = materialize(edges.select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "joined", few=True)
    ends = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    tops = connected_components(ends, edges).select(F.col("id").alias("root"), F.col("root").alias("top"))
    return materialize(roots.join(tops, "root", "left").select("id", F.coalesce("top", "root").alias("root")), "roots", few=True)


def _open(posts: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of ranks that nodes of several classes show, with the classes of today."""
    rooted = posts.drop("root").join(roots.withColumnRenamed("id", "node"), "node")
    spans = rooted.groupBy("rank").agg(F.min("root").alias("least"), F.max("root").alias("greatest"))
    return rooted.join(spans.filter("least <> greatest").select("rank"), "rank", "left_semi")


def classes(ranked: DataFrame) -> DataFrame:
    """id and root of every node of ``ranked``: what links connect has one root."""
    cut = materialize(segments(ranked), "segments", few=True)
    roots = ranked.select(F.col("node").alias("id"), F.col("node").alias("root"))
    posts = first_ranks(ranked)
    stars = STAR_ROUNDS
    while True:
        posts = materialize(_open(posts, roots), "open", few=True)
        if posts.isEmpty():
            return roots
        pairs = materialize(_stars(posts) if stars else candidates(posts), "pairs", few=True)
        new = materialize(counted(pairs, cut), "links", few=True)
        linked = not new.isEmpty()
        if linked:
            roots = _merged(roots, new)
        if not stars:
            return roots
        stars = stars - 1 if linked else 0


def _prepared(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signed rows, nodes (key, node, least id), and the ranked sets of nodes that may have links."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("text"))
    rows = rows.select(F.monotonically_increasing_id().alias(ROW), "doc_id", F.xxhash64("text").alias("text_hash"), "text")
    signed = materialize(signed_rows(rows), "signed")
    nodes = signed.filter("n_shingles > 0").groupBy("key").agg(F.min(ROW).alias("node"), F.min("doc_id").alias("least"))
    nodes = materialize(nodes, "nodes", few=True)
    hopeful = materialize(_hopeful(signed, nodes), "hopeful", few=True)
    wanted = hopeful.select("text_hash").distinct()
    texts = rows.select("text_hash", "text").join(wanted, "text_hash", "left_semi")
    sets = whole_sets(texts).join(hopeful.select("key", "node", "size"), "key").select("node", "size", "shingles")
    sets = materialize(sets, "sets")
    ranked = ranked_sets(sets)
    discard(sets)
    return signed, nodes, ranked


def ngram_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a row of ``docs``: doc_id, n_shingles (the size of its set), component_id (the least doc_id that links reach).

    Sets hold the distinct runs of five words of the whole text, A to Z in lower case, words being what blanks and the
    characters 9 to 13 separate; a text of fewer words is one run. Rows are linked if 100 times the common elements
    are at least 80 times all elements of both; rows of equal sets are. A null text is empty; a text without words has no
    element and no link. A null id is no least one unless all ids of a component are null. Rows repeat as they come;
    extra columns are left behind; an empty table gives no rows.
    """
    signed, nodes, ranked = _prepared(docs, doc_id, text)
    roots = classes(ranked).withColumnRenamed("id", "node")
    rooted = materialize(roots.join(nodes, "node"), "rooted", few=True)
    reached = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("key", "component_id")
    of_key = nodes.join(reached, "key", "left").select("key", F.coalesce("component_id", "least").alias("component_id"))
    rows = signed.select("doc_id", "n_shingles", "key").join(of_key, "key", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"))


def ngram_links(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """All links as pairs of sets, and which rows have them: (doc_id, node) and (a, b, common, size_a, size_b).

    Each link of different sets comes once. Rows of one set are linked without being listed as pairs.
    """
    signed, nodes, ranked = _prepared(docs, doc_id, text)
    posts = materialize(first_ranks(ranked).withColumn("root", F.col("node")), "posts")
    members = signed.filter("n_shingles > 0").join(nodes.select("key", "node"), "key").select("doc_id", "node")
    return members, counted(materialize(candidates(posts), "pairs"), materialize(segments(ranked), "segments"))
