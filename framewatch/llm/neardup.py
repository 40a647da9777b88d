"""Near duplicates by Jaccard similarity of word shingles: a MinHash LSH forest, then exact verification.

Documents with the same set of shingles are one class and are handled once. Each
of TREES trees labels a class with DEPTH min-hashes, eight bits of each, one after
the other in a 64-bit number, so that sorted labels are the leaves of a prefix trie
and a node of it is a run of neighbours with one prefix. The table sorted by tree
and label is written once. Matching begins with whole labels and shortens the
prefix by a min-hash at a time: classes under one node are candidates, all of them
are verified, and the links found say how many were missed at this length (a pair of
similarity s meets with 1 - (1 - s^length)^TREES, so it stands for one over that
many). It ends where the recall so estimated reaches the target at every similarity.

Members of a node are linked to its least member (a star, not all pairs); within the
components of these links every pair of alike sizes is compared exactly, by counting
common shingles in blocks of bounded size, so that no link is lost to the star and
none is written out per pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewatch.llm.common import Marks, kept, runs_of, slices, texts
from framewatch.llm.components import components
from framewatch.llm.words import grams, mix, words

SHINGLE = 5
THRESHOLD = 0.8
#: A label has eight bits for each of eight min-hashes.
TREES, DEPTH, BITS, RECALL = 32, 8, 8, 0.999
#: Width of the similarities for each of which the recall is estimated.
BAND = 0.02
#: Classes of one component that are compared in one task; larger components are compared in pairs of blocks.
BLOCK = 1024
#: Shingles that a block matrix has columns for at a time.
COLUMNS = 4096


def meeting(similarity: np.ndarray, length: int, trees: int = TREES) -> np.ndarray:
    """The chance that two classes share a prefix of ``length`` in some tree."""
    return 1 - (1 - np.asarray(similarity, float) ** length) ** trees


def shingles(column: pa.LargeStringArray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text (sorted within it), and where each text's begin. A text of fewer words than ``size`` has one, of all its words; one without words has none."""
    w = words(column)
    row = w.row_of_word()
    count = np.diff(w.offsets)
    g = grams(w.hashes, size)
    inside = np.flatnonzero(row[: len(g)] == row[size - 1 :]) if len(g) else np.zeros(0, np.int64)
    value, owner = [g[inside]], [row[inside]]
    for n in range(1, size):
        short = np.flatnonzero(count == n)
        if len(short):
            value.append(grams(w.hashes, n)[w.offsets[short]])
            owner.append(short)
    value, owner = np.concatenate(value), np.concatenate(owner)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    return value, np.searchsorted(owner, np.arange(len(column) + 1))


def labels(value: np.ndarray, offsets: np.ndarray, trees: int = TREES) -> np.ndarray:
    """text x tree: the labels, the first min-hash in the highest bits. Every text has shingles."""
    rng = np.random.default_rng(20240607)
    a = rng.integers(1, 1 << 63, (trees, DEPTH), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((len(offsets) - 1, trees), np.uint64)
    for t in range(trees):
        label = np.zeros(len(offsets) - 1, np.uint64)
        for i in range(DEPTH):
            v = value * a[t, i]
            v ^= v >> np.uint64(29)
            v *= np.uint64(0xBF58476D1CE4E5B9)
            label = label << np.uint64(BITS) | mix(np.minimum.reduceat(v, offsets[:-1])) >> np.uint64(64 - BITS)
        out[:, t] = label
    return out


def _label(trees: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            value, offsets = shingles(texts(batch.column("text")))
            size = np.diff(offsets)
            full = np.flatnonzero(size)
            doc = batch.column("doc_id").take(pa.array(full))
            if not len(full):
                continue
            # the class: two sums over the set
            at = offsets[:-1][full]
            one = mix(np.add.reduceat(mix(value), at) + size[full].astype(np.uint64)).view(np.int64)
            two = np.add.reduceat(mix(value ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at).view(np.int64)
            keys = labels(value, np.append(at, len(value)), trees).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1) * trees, pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([doc, pa.array(one), pa.array(two), pa.array(size[full].astype(np.int32)), lists], names=["doc_id", "c1", "c2", "n", "labels"])

    return run


def _nodes(length: int):
    """Links (a, b) from each member of a node to the least one nearby; nodes at an edge of what is seen at once also give (tree, prefix, a), since more of them may lie beyond."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            tree, label, rep, part = (batch.column(c).to_numpy() for c in ("tree", "label", "rep", "part"))
            prefix = label >> (BITS * (DEPTH - length))
            apart = part[1:] != part[:-1]
            new = np.concatenate([[True], apart | (tree[1:] != tree[:-1]) | (prefix[1:] != prefix[:-1])])
            first = np.flatnonzero(new)
            least = np.minimum.reduceat(rep, first)
            node = np.cumsum(new) - 1
            linked = np.flatnonzero(rep != least[node])
            cut = np.flatnonzero(apart)
            edge = np.unique(np.concatenate([[0, len(first) - 1], node[cut], node[cut + 1]]))
            none = np.zeros(len(linked), bool), np.ones(len(edge), bool)
            column = lambda x, y, hide: pa.array(np.concatenate([x, y]), mask=np.concatenate(hide))
            yield pa.RecordBatch.from_arrays(
                [
                    column(tree[linked], tree[first[edge]], (~none[0], ~none[1])), column(prefix[linked], prefix[first[edge]], (~none[0], ~none[1])),
                    column(least[node[linked]], least[edge], (none[0], ~none[1])), column(rep[linked], least[edge], none),
                ],
                names=["tree", "prefix", "a", "b"],
            )

    return run


def candidate_links(forest: DataFrame, length: int) -> DataFrame:
    """Distinct links (a, b) that join all classes under one node of a tree at depth ``length``."""
    found = kept(forest.mapInArrow(_nodes(length), "tree int, prefix long, a long, b long"), "nodes")
    edges = found.filter("tree is not null").select("tree", "prefix", "a")
    over = edges.join(edges.groupBy("tree", "prefix").agg(F.min("a").alias("m")), ["tree", "prefix"]).filter("a != m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return found.filter("b is not null").select("a", "b").unionByName(over).distinct()


def _sets(wanted: Marks | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            if wanted is not None:
                keep = wanted(batch.column("doc_id").to_numpy())
                batch = batch.filter(pa.array(keep))
                if not batch.num_rows:
                    continue
            value, offsets = shingles(texts(batch.column("text")))
            binary = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * 8).astype(np.int32)), pa.py_buffer(value)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), binary], names=["rep", "shingles"])

    return run


def common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of ``left`` shares with each of ``right``."""
    both = np.concatenate([*left, *right])
    found, column, times = np.unique(both, return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1
    row = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in [*left, *right]])
    use = times[column] > 1
    row, column = row[use], number[column[use]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(left), len(right)), np.int64)
    for low in range(0, int(column.max(initial=-1)) + 1, COLUMNS):
        a, b = np.searchsorted(column, [low, low + COLUMNS])
        m = np.zeros((len(left) + len(right), COLUMNS), np.float32)
        m[row[a:b], column[a:b] - low] = 1
        out += (m[: len(left)] @ m[len(left) :].T).astype(np.int64)
    return out


def _verify(threshold: float, length: int, trees: int):
    """Per class and task: links to other classes (in documents), and the least class reached within the task; once a task, the links by band of similarity and how many they stand for."""
    exact = Fraction(str(threshold)).limit_denominator(10**9)  # compared in integers, so that ties count at any size
    above, below = exact.numerator, exact.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs_of(batches, ["comp", "i", "j"]):
            rep, copies, block = (table.column(c).to_numpy() for c in ("rep", "copies", "block"))
            sets = [np.frombuffer(b, np.uint64) for b in table.column("shingles").to_pylist()]
            i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
            left = np.flatnonzero(block == i)
            right = np.flatnonzero(block == j) if j != i else left
            if not len(left) or not len(right):
                continue
            size = np.array([len(s) for s in sets], np.int64)
            shared = common([sets[x] for x in left], [sets[x] for x in right])
            both = size[left][:, None] + size[right][None, :]
            linked = shared * (above + below) >= above * both
            links = np.zeros(len(rep), np.int64)
            if i == j:
                np.fill_diagonal(linked, False)
                links[left] = linked @ copies[right]
            else:
                links[left] += linked @ copies[right]
                links[right] += linked.T @ copies[left]
            once = np.triu(linked) if i == j else linked
            similar = shared[once] / (both[once] - shared[once])
            band = ((similar - threshold) / BAND).astype(int)
            found, stands = np.bincount(band).astype(float), np.bincount(band, 1 / meeting(similar, length, trees))
            root = rep.copy()
            while True:
                was = root.copy()
                big = np.iinfo(np.int64).max
                to_left = np.where(linked, root[right][None, :], big).min(axis=1, initial=big)
                root[left] = np.minimum(root[left], to_left)
                to_right = np.where(linked, root[left][:, None], big).min(axis=0, initial=big)
                root[right] = np.minimum(root[right], to_right)
                if (root == was).all():
                    break
            once_a_task = [[found, stands] if n == 0 else None for n in range(len(rep))]
            bands = pa.array([None if x is None else [v.tolist() for v in x] for x in once_a_task], pa.list_(pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(root), pa.array(links), bands], names=["rep", "root", "links", "bands"])

    return run


def verified(links: DataFrame, rows: DataFrame, groups: DataFrame, threshold: float, length: int, trees: int) -> DataFrame:
    """(rep, root, links, bands) of the classes in ``links``: all pairs within a component whose sizes allow a link, compared once each.

    Classes are dealt by component and size (steps of 1/threshold; only equal and
    neighbouring steps can hold a link), then into blocks of about BLOCK.
    """
    candidates = kept(components(links).select(F.col("id").alias("rep"), F.col("root").alias("comp")), "candidates")
    wanted = Marks(candidates, "rep") if candidates.count() <= Marks.ITEMS else None
    asked = rows if wanted is not None else rows.join(candidates.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    sets = asked.mapInArrow(_sets(wanted), "rep long, shingles binary")
    step = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(-np.log(threshold))) + 1e-9).cast("long")
    members = candidates.join(groups.select("rep", "copies", "n"), "rep").withColumn("step", step)
    sizes = members.groupBy("comp", "step").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("long").alias("blocks"))
    sizes = sizes.groupBy("comp").agg(F.map_from_entries(F.collect_list(F.struct("step", "blocks"))).alias("sizes"))
    members = members.join(sizes, "comp").withColumn("own", F.pmod(F.xxhash64("rep"), F.element_at("sizes", F.col("step"))))
    block = lambda step, nth: step * F.lit(1 << 32) + nth
    of = lambda step: F.coalesce(F.try_element_at("sizes", step), F.lit(0))
    others = lambda step: F.transform(F.filter(F.sequence(F.lit(0).cast("long"), of(step)), lambda x: x < of(step)), lambda x: block(step, x))
    blocks = F.concat(*(others(F.col("step") + d) for d in (-1, 0, 1)))
    members = members.withColumn("block", block(F.col("step"), F.col("own"))).withColumn("p", F.transform(blocks, lambda x: F.struct(F.least(x, "block").alias("i"), F.greatest(x, "block").alias("j"))))
    dealt = members.join(sets, "rep").dropDuplicates(["rep"]).withColumn("p", F.explode("p")).select("comp", "p.i", "p.j", "block", "rep", "copies", "shingles")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(n, "comp", "i", "j").sortWithinPartitions("comp", "i", "j")
    return kept(dealt.mapInArrow(_verify(threshold, length, trees), "rep long, root long, links long, bands array<array<double>>"), "checked")


def estimated_recall(checked: DataFrame) -> float:
    """The least share of links that were found in any band of similarity with links, by what the found ones stand for; 1 without links."""
    bands = checked.filter("bands is not null").select(F.posexplode(F.arrays_zip(F.col("bands")[0].alias("found"), F.col("bands")[1].alias("stands"))).alias("band", "x"))
    sums = bands.groupBy("band").agg(F.sum("x.found").alias("found"), F.sum("x.stands").alias("stands")).filter("found > 0").collect()
    return min((r.found / r.stands for r in sums), default=1.0)


def classes(docs: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, copy_of, n_links for each document.

    Two documents are linked if the Jaccard similarity of their shingle sets is
    ``threshold`` or more. class_id is the least doc_id of the component of links;
    copy_of the least doc_id with the same set; n_links counts the other documents
    linked to this one, copies included. A text that is null or has no words has no
    links and is its own class. Repeated rows of one doc_id count as copies.
    A null doc_id takes part in nothing and gets nulls and 0 links. Columns other
    than doc_id and text, whatever their names, play no part.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull())
    labelled = kept(rows.mapInArrow(_label(trees), "doc_id long, c1 long, c2 long, n int, labels array<long>"), "labels")
    same = ["c1", "c2", "n"]
    groups = kept(labelled.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    heads = kept(labelled.join(groups, same).filter("doc_id = rep").select("rep", "labels").dropDuplicates(["rep"]), "heads")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    leaves = heads.select("rep", F.posexplode("labels").alias("tree", "label")).repartitionByRange(n, "tree", "label", "rep").sortWithinPartitions("tree", "label", "rep")
    forest = kept(leaves.withColumn("part", F.spark_partition_id()), "forest")
    for length in range(DEPTH, 0, -1):
        checked = verified(candidate_links(forest, length), rows, groups, threshold, length, trees)
        if estimated_recall(checked) >= recall:
            break
    roots = components(checked.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counts = checked.groupBy("rep").agg(F.sum("links").alias("links"))
    result = groups.join(counts, "rep", "left").join(roots.select(F.col("id").alias("rep"), "root"), "rep", "left")
    result = result.select(*same, "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("class_id"))
    found = labelled.select("doc_id", *same).distinct().join(result, same).select(F.col("doc_id").alias("_id"), "class_id", F.col("rep").alias("copy_of"), "n_links")
    # A doc_id with several texts takes the least class of them.
    found = found.groupBy("_id").agg(F.min("class_id").alias("class_id"), F.min("copy_of").alias("copy_of"), F.max("n_links").alias("n_links"))
    return docs.select("doc_id").join(found, F.col("doc_id") == F.col("_id"), "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("copy_of", "doc_id").alias("copy_of"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class: that of its least doc_id. Rows with a null doc_id stay; of repeated rows of one id one stays."""
    ids = classes(docs).filter("doc_id = class_id or doc_id is null").filter("doc_id is not null").select("doc_id").distinct()
    first = docs.filter("doc_id is not null").join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return first.select(*docs.columns).unionByName(docs.filter("doc_id is null"))
