"""Near-duplicates: DartMinHash signatures, banded joining, exact verification.

1. Rows of equal texts become one node.
2. Nodes that agree in a whole band of their signatures share a bucket.
3. Each node is compared with the head of a bucket that it shares the most buckets
   with; components of the links found become the first classes. Inside a class no
   further pair needs a test, so a large group of copies costs a test per node.
4. Buckets that still hold nodes of several classes are open. A node there can only
   be linked if enough of its shingles occur in other nodes of open buckets; of two
   nodes the smaller number of such shingles bounds what they share. All pairs of
   nodes of different classes in an open bucket that meet the bound are tested.

No pair that shares a bucket stays untested unless it is already in one class or
cannot reach the threshold, so classes are those of all links among such pairs.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harbor.llm.common import ROW, has_rows, numbered, text_slices, trimmed, whole_text, with_row
from harbor.llm.dart_minhash import bands, in_parts
from harbor.llm.words import shingles, words_of
from harbor.operators.components import connected_components
from harbor.sources.scratch import discard, materialize

SHINGLE_WORDS = 5
SIMILARITY = 0.8
# A pair of similarity s shares a band with probability 1 - (1 - s ** BAND_ROWS) ** BANDS:
# all but 8 in a million at 0.8, one in 6,000 at 0.2.
BANDS, BAND_ROWS = 64, 8
# One bit of each coordinate makes a sketch. Of two sets of similarity 0.8 a tenth of these bits
# differs on average; more than 5.5 standard deviations above that does not occur.
COORDINATES = BANDS * BAND_ROWS
MOST_DIFFERENT = int(0.1 * COORDINATES + 5.5 * (0.09 * COORDINATES) ** 0.5)
DECIDING_ROUNDS = 1
BATCH_BYTES = 250_000


def text_shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return shingles(words_of(texts), SHINGLE_WORDS)


def band_keys(rows: DataFrame) -> DataFrame:
    """``rows`` with ``text`` replaced by ``bands`` and ``sketch`` of its signature; a text without words has no bands."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches, "words"):
            texts = batch.column(batch.num_columns - 1)
            for a, b in text_slices(texts, BATCH_BYTES):
                doc, found = text_shingles(texts.slice(a, b - a).to_pylist())
                signature = in_parts(doc, found, np.ones(len(found)), b - a, COORDINATES)
                keys, bits = bands(signature, BAND_ROWS), np.packbits((signature & np.uint64(1)).astype(bool), axis=1)
                some = np.bincount(doc, minlength=b - a) > 0
                offsets = np.concatenate([[0], np.cumsum(some * BANDS)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[some].ravel().view(np.int64)))
                sketches = pa.FixedSizeListArray.from_arrays(pa.array(bits.view(np.int64).ravel()), COORDINATES // 64)
                columns = [*batch.slice(a, b - a).columns[:-1], lists, sketches.cast(pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "bands", "sketch"])

    schema = rows.drop("text").selectExpr("*", "array(0L) AS bands", "array(0L) AS sketch").schema
    return rows.mapInArrow(sign, schema)


def shingle_sets(rows: DataFrame) -> DataFrame:
    """``rows(node, text)`` as node, shingles."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches, "words"):
            texts = batch.column(1)
            for a, b in text_slices(texts, BATCH_BYTES):
                doc, found = text_shingles(texts.slice(a, b - a).to_pylist())
                offsets = np.searchsorted(doc, np.arange(b - a + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], ["node", "shingles"])

    return rows.select("node", "text").mapInArrow(cut, "node long, shingles array<long>")


def links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose shingle sets have a Jaccard similarity of SIMILARITY or more."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a")), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b")), "b")
    common = F.size(F.array_intersect("of_a", "of_b"))
    return both.filter(_reaches(common, F.size("of_a"), F.size("of_b"))).select("a", "b")


def _reaches(common: Column, a: Column, b: Column) -> Column:
    """Whether ``common`` shared elements give sets of ``a`` and ``b`` the similarity, without division."""
    return common * (1 + SIMILARITY) >= (a + b) * SIMILARITY - 1e-9


def _open(members: DataFrame) -> DataFrame:
    """Rows of the buckets that hold nodes of several classes."""
    spans = members.groupBy("bucket").agg(F.min("root").alias("least"), F.max("root").alias("greatest"))
    return members.join(spans.filter("least <> greatest").select("bucket"), "bucket", "left_semi")


def _with_bound(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Add to each node of ``members`` its number of shingles and of those that other nodes there have; drop hopeless ones."""
    nodes = sets.join(members.select("node").distinct(), "node", "left_semi")
    # Half of a hash halves the shuffle; where two meet by chance the bound is only less tight.
    each = nodes.select("node", F.explode("shingles").alias("shingle")).withColumn("shingle", F.expr("int(shingle & 2147483647)"))
    lone = each.groupBy("shingle").agg(F.count("*").alias("n"), F.min("node").alias("node")).filter("n = 1")
    lone = lone.groupBy("node").agg(F.count("*").alias("lone"))
    sizes = nodes.select("node", F.size("shingles").alias("size")).join(lone, "node", "left")
    sizes = sizes.select("node", "size", (F.col("size") - F.coalesce("lone", F.lit(0))).alias("shared"))
    hopeful = sizes.filter(_reaches(F.col("shared"), F.col("size"), F.col("shared")))
    return members.drop("size", "shared").join(materialize(hopeful, "hopeful", few=True), "node")


def near_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for every row of ``docs``: its number, doc_id, class_id, kept.

    Two texts are linked if their sets of runs of five lower-case words have a Jaccard
    similarity of 0.8 or more; a text of fewer words is one run. A class is all that
    links connect, named by its least doc_id; the row with that id stays, the first
    read one of several. Equal texts are always in one class, also those without words.
    A null text is empty; a null id comes after all others. An empty table gives no rows.
    """
    texts = with_row(docs).select(ROW, F.col(doc_id).alias("doc_id"), whole_text(text).alias("text"))
    texts = texts if has_rows(docs) else materialize(texts, "numbered", dense=True)
    keyed = texts.select(ROW, "doc_id", F.unhex(F.sha2("text", 256)).alias("key"), "text")
    signed = materialize(band_keys(keyed), "signed")
    nodes = materialize(signed.groupBy("key").agg(F.min(ROW).alias("node")), "nodes", few=True)
    copies = signed.select(ROW, "key").join(nodes, "key").filter(F.col(ROW) != F.col("node")).select(ROW)
    banded = signed.join(materialize(copies, "copies", few=True), ROW, "left_anti")
    banded = banded.select(F.col(ROW).alias("node"), "bands", "sketch")

    each = banded.select("node", F.explode("bands").alias("bucket"))
    heads = each.groupBy("bucket").agg(F.min("node").alias("head"), F.count("*").alias("n")).filter("n > 1")
    heads = materialize(heads.select("bucket", "head"), "heads", few=True)
    members = materialize(each.join(heads, "bucket"), "members")
    discard(heads)
    candidates = materialize(members.select("node").distinct(), "candidates", few=True)
    sets = texts.select(F.col(ROW).alias("node"), "text").join(candidates, "node", "left_semi")
    sets = materialize(shingle_sets(sets), "sets")
    if not has_rows(docs):
        discard(texts)

    together = members.filter("node <> head").groupBy("node", "head").agg(F.count("*").alias("n"))
    stars = together.groupBy(F.col("node").alias("a")).agg(F.max_by("head", F.struct("n", -F.col("head"))).alias("b"))
    found = materialize(links(stars, sets), "links", few=True)
    roots = connected_components(candidates.withColumnRenamed("node", "id"), found)

    # One test of each node with each other class that it meets joins most of what belongs together.
    rounds = DECIDING_ROUNDS
    while True:
        met, members = members, materialize(_open(_rooted(members, roots)), "open", few=True)
        discard(met)
        if members.isEmpty():
            break
        bounded = _with_bound(members, sets)
        if rounds:
            pairs = _pairs_with_heads(bounded)
        else:
            bounded = _with_bound(_open(bounded), sets)
            pairs = _open_pairs(bounded.join(banded, "node"))
        new = materialize(links(pairs, sets), "links", few=True)
        linked = not new.isEmpty()
        if linked:
            roots = _merged(roots, new)
        if not rounds:
            break
        rounds = rounds - 1 if linked else 0
    discard(sets)
    discard(members)

    classed = nodes.join(roots.withColumnRenamed("id", "node"), "node", "left")
    classed = materialize(classed.select("key", F.coalesce("root", "node").alias("root")), "classed", few=True)
    rows = materialize(signed.select(ROW, "doc_id", "key").join(classed, "key").drop("key"), "rooted")
    order = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", ROW)
    firsts = rows.groupBy("root").agg(F.min(order).alias("first"))
    first = materialize(firsts, "firsts", few=True)
    return rows.join(first, "root").select(
        ROW, "doc_id", F.col("first.doc_id").alias("class_id"), (F.col(ROW) == F.col(f"first.{ROW}")).alias("kept")
    )


def _merged(roots: DataFrame, new: DataFrame) -> DataFrame:
    """``roots`` after ``new`` links between nodes: components of the few roots that these join."""
    edges = new.join(roots.select(F.col("id").alias("a"), F.col("root").alias("ra")), "a")
    edges = edges.join(roots.select(F.col("id").alias("b"), F.col("root").alias("rb")), "b")
    edges = materialize(edges.select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "joined", few=True)
    joined = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    tops = connected_components(joined, edges).select(F.col("id").alias("root"), F.col("root").alias("top"))
    return materialize(roots.join(tops, "root", "left").select("id", F.coalesce("top", "root").alias("root")), "roots", few=True)


def _rooted(members: DataFrame, roots: DataFrame) -> DataFrame:
    return members.drop("root").join(roots.withColumnRenamed("id", "node"), "node")


def _pairs_with_heads(members: DataFrame) -> DataFrame:
    """Of each node and each other class among the heads of its buckets, the pair that shares the most buckets.

    The head of an open bucket is its member with the most shingles in common with
    others, relative to its size: the likeliest centre of a group.
    """
    promise = F.struct(F.col("shared") / F.col("size"), -F.col("node"))
    heads = members.groupBy("bucket").agg(
        F.max_by(F.struct("node", "root", "size", "shared"), promise).alias("head")
    )
    pairs = members.drop("head").join(heads, "bucket").filter(F.col("root") != F.col("head.root"))
    pairs = pairs.filter(_reaches(F.least("shared", "head.shared"), F.col("size"), F.col("head.size")))
    together = pairs.groupBy("node", F.col("head.root").alias("other"), F.col("head.node").alias("b")).agg(F.count("*").alias("n"))
    best = together.groupBy(F.col("node").alias("a"), "other").agg(F.max_by("b", F.struct("n", -F.col("b"))).alias("b"))
    return best.select("a", "b")


def _open_pairs(members: DataFrame) -> DataFrame:
    """All pairs of different classes that share a bucket and may reach the similarity, each from its first shared bucket."""
    names = ("node", "root", "size", "shared", "bands", "sketch")
    left = members.select("bucket", *(F.col(name).alias(f"{name}_a") for name in names))
    right = members.select("bucket", *(F.col(name).alias(f"{name}_b") for name in names))
    may = (F.col("node_a") < F.col("node_b")) & (F.col("root_a") != F.col("root_b"))
    may &= _reaches(F.least("shared_a", "shared_b"), F.col("size_a"), F.col("size_b"))
    different = [F.bit_count(F.get("sketch_a", F.lit(n)).bitwiseXOR(F.get("sketch_b", F.lit(n)))) for n in range(COORDINATES // 64)]
    may &= sum(different[1:], different[0]) <= MOST_DIFFERENT
    same = F.zip_with("bands_a", "bands_b", lambda a, b: a == b)
    may &= F.get("bands_a", F.array_position(same, True).cast("int") - 1) == left["bucket"]
    return left.join(right, (left["bucket"] == right["bucket"]) & may).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each class, with all their columns."""
    rows = numbered(docs)
    dropped = materialize(near_classes(rows, doc_id, text).filter(~F.col("kept")).select(ROW), "dropped", few=True)
    return rows.join(dropped, ROW, "left_anti").drop(ROW)
