"""Near-duplicate groups by a signature-coordinate inverted join.

1.  A document's set is its distinct 3-word shingles.  Equal sets form a class, and
    one row per class goes on: copies, however many, cost nothing further.  With two
    measures a document has a set for each, and a class is equal in both.
2.  A class has a MinHash signature of ``COORDINATES`` values.  Coordinate-value pairs
    that one class alone has are dropped; a class with fewer than ``matches`` left has
    no partner.  Of c left it is posted under its c - matches + 1 rarest: two classes
    that agree on matches pairs meet in one of those lists (prefix filter).
3.  Each list counts collisions coordinate by coordinate and skips pairs that can no
    longer reach matches.  A task returns a spanning forest of its matching pairs, never
    the pairs, so its output is bounded by its input.
4.  The forests' components are candidate groups.  Their members' texts are read, and
    every pair's exact Jaccard similarity is taken from counts of shared shingles; a
    task again returns a spanning forest of the links.
5.  Components of these forests are the near-duplicate groups.

Lists and candidate groups are compared in two rounds.  First a group is cut into blocks
of bounded rows and shingles; each block also gets the group's hubs, a few members
chosen by hash, so the variants of one text are tied together though each travels once.
Then only what this left apart goes on: of a group whose members are not all tied, those
outside its largest part, the outsiders, meet every block.  All pairs have been compared
then, but for pairs that are tied already.  A group of g variants that hubs tie costs
g rows; one with o outsiders costs g * o / block more, which is quadratic only where
candidates are many and links are few.

Two sets of similarity 0.85 agree on fewer than 16 of 32 coordinates with a chance of
6e-7, of similarity 0.8 on fewer than 14 with 1.2e-6; links are exact in any case.  Null
texts and texts without words have an empty set and are linked with nothing.  Rows
without doc_id stay apart, with a null component.  Rows that share a doc_id share a
component.  Texts are never cut.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import common

COORDINATES = 32
#: (words, percent, matches): two sets of shingles of so many words are linked from percent on, and meet on so many coordinates.
CONTRACT = ((3, 85, 16),)
#: The pipeline links by either measure.
EITHER = (*CONTRACT, (5, 80, 14))
#: Rows of a block of a list and of a candidate group, and shingles of a block; expected hubs of a group.
BLOCK, TEXT_BLOCK, SHINGLE_BLOCK, HUBS = 256, 256, 2_000_000, 8
#: So many candidates' ids, about 40 bytes each, are broadcast to pick their texts; beyond, texts are joined by shuffle.
BROADCAST_IDS = 500_000


class Shingler:
    """Distinct shingle hashes of a text and their MinHash signature."""

    def __init__(self):
        import numpy as np
        import xxhash

        self.words = common.Remembered(xxhash.xxh64_intdigest, 100_000)
        rng = np.random.default_rng(20240607)
        self.factors = (rng.integers(0, 2**63, (COORDINATES, 1), dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
        self.masks = rng.integers(0, 2**63, (COORDINATES, 1), dtype=np.uint64)

    def hashes(self, text: str):
        """uint64 hashes of the text's words."""
        import numpy as np

        words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the six ASCII spaces only
        return np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))

    def set_of(self, h, words: int):
        """Sorted distinct uint64 hashes of the shingles of ``words`` words, from the words' hashes."""
        import numpy as np

        if len(h) == 0:
            return h
        width = min(words, len(h))
        mixed = np.full(len(h) - width + 1, width, np.uint64)
        for i in range(width):
            mixed = (mixed ^ h[i : len(h) - width + 1 + i]) * np.uint64(0x9FB21C651E98DF25)
            mixed ^= mixed >> np.uint64(32)
        return np.unique(mixed)

    def signature(self, shingles):
        import numpy as np

        low = np.full(COORDINATES, 2**32 - 1, np.uint32)
        for at in range(0, len(shingles), 8192):
            x = (shingles[None, at : at + 8192] ^ self.masks) * self.factors
            x ^= x >> np.uint64(31)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            low = np.minimum(low, (x >> np.uint64(32)).min(axis=1).astype(np.uint32))
        return low.view(np.int32)


def sketches(docs: DataFrame, measures: tuple = CONTRACT) -> DataFrame:
    """(doc_id, n_shingles, digest, signatures) of every row; digest and signatures are null for empty sets.

    n_shingles is the first measure's; signatures has one for each measure.
    """
    widths = [words for words, _, _ in measures]

    def start():
        import hashlib

        shingler = common.per_process("shingles", Shingler)

        def one(text):
            h = shingler.hashes(text)
            if len(h) == 0:
                return 0, None, None
            sets = [shingler.set_of(h, words) for words in widths]
            return len(sets[0]), hashlib.blake2b(b"".join(x.tobytes() for x in sets), digest_size=16).digest(), [shingler.signature(x).tolist() for x in sets]

        return lambda keys, texts: [keys[0], *map(list, zip(*map(one, texts)))]

    return common.map_texts(docs, ["doc_id"], "doc_id long, n_shingles long, digest binary, signatures array<array<int>>", start)


def classes(rows: DataFrame) -> DataFrame:
    """(digest, rep, n, weight, signatures): one row per set, named by its smallest doc_id; its rows and shingles."""
    known = rows.where("digest is not null and doc_id is not null")
    first = [F.first(c).alias(n) for c, n in (("n_shingles", "weight"), ("signatures", "signatures"))]
    return known.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), *first)


def held_pairs(sets: DataFrame, matches: int, measure: int = 0) -> DataFrame:
    """(rep, held): each class's shared coordinate-value pairs as (n, coordinate, value), rarest first."""
    pairs = sets.select("rep", F.posexplode(F.col("signatures")[measure]).alias("coordinate", "value"))
    shared = pairs.groupBy("coordinate", "value").agg(F.count("*").alias("n")).where("n > 1")
    met = pairs.join(shared.hint("merge"), ["coordinate", "value"])  # pairs are 32 a class, which Spark's guess of their size misses
    held = met.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("n", "coordinate", "value"))).alias("held"))
    return held.where(F.size("held") >= matches)


def listed(held: DataFrame, matches: int) -> DataFrame:
    """(list, n, blocks, rep, coordinates, values): each class under its rarest pairs; n: the list's classes."""
    part = lambda name: F.transform("held", lambda x: x[name]).alias(name + "s")
    posts = F.explode(F.slice("held", F.lit(1), F.size("held") - (matches - 1))).alias("post")
    rows = held.select("rep", part("coordinate"), part("value"), posts)
    group = F.xxhash64("post.coordinate", "post.value").alias("list")
    n = F.col("post.n")
    return rows.select(group, n.alias("n"), F.ceil(n / F.lit(BLOCK)).alias("blocks"), "rep", "coordinates", "values")


def first_deal(rows: DataFrame) -> DataFrame:
    """rows (list, n, blocks, rep, ..) with key and side 0: each row in its block, and hubs in all blocks of their list."""
    own = F.pmod(F.xxhash64("rep"), F.col("blocks"))
    hub = (F.col("blocks") > 1) & (F.pmod(F.xxhash64("rep", F.lit(5)), F.ceil(F.col("n") / F.lit(HUBS))) == 0)
    at = F.when(hub, F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array(own))
    dealt = rows.withColumn("_at", F.explode(at))
    return dealt.withColumns({"key": F.xxhash64("list", "_at"), "side": F.lit(0)}).drop("_at")


def apart(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(list, rep, outside, out_blocks) of the lists of members (list, rep) whose classes are not all tied by labels."""
    known = members.join(common.by_rows(labels.select(F.col("node").alias("rep"), "component"), labels.count()), "rep", "left")
    known = common.settled(known.select("list", "rep", F.coalesce("component", "rep").alias("part")))
    parts = known.groupBy("list", "part").agg(F.count("*").alias("n"))
    main = parts.groupBy("list").agg(F.max(F.struct("n", "part")).alias("main"), F.sum("n").alias("all"), F.count("*").alias("parts"))
    main = main.where("parts > 1").select("list", F.col("main.part").alias("main"), F.ceil((F.col("all") - F.col("main.n")) / F.lit(BLOCK)).alias("out_blocks"))
    main = common.settled(main)
    return known.join(common.by_rows(main, main.count()), "list").select("list", "rep", (F.col("part") != F.col("main")).alias("outside"), "out_blocks")


def second_deal(rows: DataFrame) -> DataFrame:
    """rows (list, blocks, rep, outside, out_blocks, ..) with key and side: all members (1) in their block meet every block of outsiders (2)."""
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    own, out = F.pmod(F.xxhash64("rep"), F.col("blocks")), F.pmod(F.xxhash64("rep", F.lit(9)), F.col("out_blocks"))
    entry = lambda a, b, side: F.struct(a.alias("a"), b.alias("b"), F.lit(side).alias("side"))
    member = F.transform(upto(F.col("out_blocks")), lambda c: entry(own, c, 1))
    outsider = F.transform(upto(F.col("blocks")), lambda b: entry(b, out, 2))
    dealt = rows.withColumn("_at", F.explode(F.when(F.col("outside"), F.concat(member, outsider)).otherwise(member)))
    return dealt.withColumns({"key": F.xxhash64("list", "_at.a", "_at.b"), "side": F.col("_at.side")}).drop("_at")


def _tables(batches):
    """Tables of the rows of one key, from batches sorted by key in the first column."""
    import numpy as np
    import pyarrow as pa

    held, last = [], None
    for batch in batches:
        keys = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if last is not None and keys[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = keys[a]
    if held:
        yield pa.Table.from_batches(held)


def forest(n: int, a, b):
    """For each of n nodes the smallest node it reaches over the edges (a, b)."""
    import numpy as np

    label = np.arange(n)
    while len(a):
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == before).all():
            break
    return label


def matching(matrix, sides, matches: int):
    """Index pairs of rows that agree on ``matches`` columns; columns are counted until a pair cannot reach that."""
    import numpy as np

    n, width = matrix.shape
    counts = np.zeros((n, n), np.uint8)
    half = width // 2
    for k in range(half):
        counts += matrix[:, k, None] == matrix[None, :, k]
    alive = np.triu(counts >= matches - (width - half), 1)
    if sides.any():
        alive &= sides[:, None] != sides[None, :]
    a, b = np.nonzero(alive)
    count = counts[a, b].astype(np.int64)
    for k in range(half, width):
        count += matrix[a, k] == matrix[b, k]
        if k % 4 == 3:
            keep = count >= matches - (width - 1 - k)
            a, b, count = a[keep], b[keep], count[keep]
    keep = count >= matches
    return a[keep], b[keep]


def _edges(reps, a, b):
    import numpy as np
    import pyarrow as pa

    root = forest(len(reps), a, b)
    moved = np.flatnonzero((root != np.arange(len(reps))) & (reps[root] != reps))
    return pa.RecordBatch.from_pydict({"a": reps[root[moved]], "b": reps[moved]}) if len(moved) else None


def candidate_edges(posted: DataFrame, matches: int) -> DataFrame:
    """(a, b): spanning forests of the matching pairs of each key's rows."""

    def run(batches):
        import numpy as np

        for rows in _tables(batches):
            if rows.num_rows < 2:
                continue
            rows = rows.combine_chunks()
            reps, sides = rows.column("rep").to_numpy(), rows.column("side").to_numpy()
            column, value = rows.column("coordinates").chunk(0), rows.column("values").chunk(0)
            sizes = np.diff(column.offsets.to_numpy())
            matrix = np.repeat(-1 - np.arange(len(reps), dtype=np.int64)[:, None] - 2**40, COORDINATES, axis=1)  # agrees with no other row
            matrix[np.repeat(np.arange(len(reps)), sizes), column.flatten().to_numpy()] = value.flatten().to_numpy()
            found = _edges(reps, *matching(matrix, sides, matches))
            if found is not None:
                yield found

    dealt = posted.select("key", "rep", "side", "coordinates", "values").repartition("key").sortWithinPartitions("key", "rep")
    return dealt.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (a, b): the smallest node that each reaches.

    Forests of overlapping lists name many roots for one node, so first each node keeps its
    smallest root, and its other roots are tied to that one, which leaves about one edge a
    node.  Then labels go to neighbours and to the label's own label, until none changes;
    each round is written to the shared folder and the one before removed.  Rows here are
    two or three integers; those of a node that very many edges share are split where the
    session's adaptive execution finds a skewed join.
    """
    spark = edges.sparkSession
    known, first_path = common.written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    first = known.groupBy("b").agg(F.min("a").alias("m"))
    tied = known.join(common.by_rows(first, known.count()), "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    fewer = first.select(F.col("m").alias("a"), "b").unionByName(tied).distinct()
    both, path = common.written(fewer.unionByName(fewer.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    common.remove(spark, first_path)
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("component"))
    labels, last = common.written(labels, "labels")
    nodes = labels.count()
    while True:
        theirs = labels.select(F.col("node").alias("b"), F.col("component").alias("low"))
        near = both.join(common.by_rows(theirs, nodes), "b").groupBy(F.col("a").alias("node")).agg(F.min("low").alias("low"))
        nearer = labels.join(common.by_rows(near, nodes), "node").select("node", F.col("component").alias("old"), F.least("component", "low").alias("component"))
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("above"))
        moved, at = common.written(nearer.join(common.by_rows(up, nodes), "component").select("node", "old", F.least("component", "above").alias("component")), "labels")
        common.remove(spark, last)
        labels, last = moved.select("node", "component"), at
        if moved.where("old <> component").isEmpty():
            common.remove(spark, path)
            return labels


def linked_pairs(sets: list, sides, percent: int):
    """Index pairs with percent * union <= 100 * intersection; shared shingles are counted for all pairs at once."""
    import numpy as np

    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    _, at, having = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = (np.cumsum(having > 1) - 1)[at]  # shingles of one set alone are shared with none
    row, shared = np.repeat(np.arange(n), sizes), having[at] > 1
    row, column = row[shared], column[shared]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((n, n), np.float32)
    last = int(column[-1]) + 1 if len(column) else 0
    for low in range(0, last, 4096):
        a, b = np.searchsorted(column, [low, low + 4096])
        hit = np.zeros((n, min(4096, last - low)), np.float32)
        hit[row[a:b], column[a:b] - low] = 1
        both += hit @ hit.T
    linked = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
    if sides.any():
        linked &= sides[:, None] != sides[None, :]
    return np.nonzero(np.triu(linked, 1))


def candidate_groups(sets: DataFrame, measures: tuple) -> DataFrame:
    """(node, component): the components of the classes that agree on enough coordinates, by any measure."""
    spark = sets.sparkSession
    held = [common.written(held_pairs(sets, matches, k), "held") for k, (_, _, matches) in enumerate(measures)]
    posted = [listed(df, matches) for (df, _), (_, _, matches) in zip(held, measures)]
    edges = [candidate_edges(first_deal(rows), matches) for rows, (*_, matches) in zip(posted, measures)]
    labels = components(reduce(DataFrame.unionByName, edges))
    more = []
    for rows, (*_, matches) in zip(posted, measures):
        long = rows.where("blocks > 1")
        left = common.settled(apart(long.select("list", "rep"), labels))
        n = left.count()
        if n:
            more.append(candidate_edges(second_deal(long.join(common.by_rows(left, n), ["list", "rep"])), matches))
    if more:
        known = labels.select(F.col("component").alias("a"), F.col("node").alias("b"))
        labels = components(reduce(DataFrame.unionByName, [known, *more]))
    for _, path in held:
        common.remove(spark, path)
    return labels


def members_of(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """(list, n, blocks, rep): the candidate groups' classes; blocks are bounded in rows and in shingles."""
    rows = common.settled(sets.select(F.col("rep").alias("node"), "weight").join(common.by_rows(groups, groups.count()), "node"))
    sizes = rows.groupBy("component").agg(F.count("*").alias("n"), F.sum("weight").alias("shingles"))
    sized = common.join_groups(rows, common.settled(sizes), "component", "n", rows.count())
    blocks = F.greatest(F.ceil(F.col("n") / F.lit(TEXT_BLOCK)), F.ceil(F.col("shingles") / F.lit(SHINGLE_BLOCK)))
    blocks = F.least(F.greatest(blocks, F.lit(1)), F.col("n"))
    return sized.select(F.col("component").alias("list"), "n", blocks.alias("blocks"), F.col("node").alias("rep"))


def with_texts(docs: DataFrame, members: DataFrame) -> DataFrame:
    """members (rep, ..) with their texts; the texts of other rows do not leave the tasks that read them, up to BROADCAST_IDS members."""
    few = members.count() <= BROADCAST_IDS
    texts = docs.select(docs["doc_id"].cast("long").alias("rep"), common.text_of(docs).alias("text"))
    return texts.join(F.broadcast(members) if few else members.hint("merge"), "rep")


def linked_edges(dealt: DataFrame, measures: tuple) -> DataFrame:
    """(a, b): spanning forests of the exact links, by any measure, of each key's rows (key, rep, side, text)."""

    def run(batches):
        import numpy as np

        shingler = common.per_process("shingles", Shingler)
        for rows in _tables(batches):
            if rows.num_rows < 2:
                continue
            reps, sides = rows.column("rep").to_numpy(), rows.column("side").to_numpy()
            hashes = [shingler.hashes(t.as_py()) for t in rows.column("text")]
            links = [linked_pairs([shingler.set_of(h, words) for h in hashes], sides, percent) for words, percent, _ in measures]
            found = _edges(reps, *map(np.concatenate, zip(*links)))
            if found is not None:
                yield found

    return dealt.select("key", "rep", "side", "text").repartition("key").sortWithinPartitions("key", "rep").mapInArrow(run, "a long, b long")


def confirmed(docs: DataFrame, groups: DataFrame, sets: DataFrame, measures: tuple = CONTRACT) -> DataFrame:
    """(node, component): the components of the exact links within candidate groups (node, component)."""
    members = common.settled(members_of(groups, sets))
    labels = components(linked_edges(first_deal(with_texts(docs, members)), measures))
    long = members.where("blocks > 1")
    left = common.settled(long.join(common.by_rows(apart(long.select("list", "rep"), labels), long.count()), ["list", "rep"]))
    if left.isEmpty():
        return labels
    more = linked_edges(second_deal(with_texts(docs, left)), measures)
    return components(labels.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(more))


def near_duplicates(docs: DataFrame, measures: tuple = CONTRACT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs; n_shingles is the first measure's."""
    rows = common.settled(sketches(docs, measures), "sketches")
    sets = common.settled(classes(rows), "classes")
    links = confirmed(docs, candidate_groups(sets, measures), sets, measures)
    links = common.by_rows(links.withColumnRenamed("node", "rep"), links.count())
    named = sets.select("digest", "rep", "n").join(links, "rep", "left").where("n > 1 or component is not null")
    named = common.settled(named.select("digest", "n", F.coalesce("component", "rep").alias("class_component")))
    found = common.join_groups(rows.select("doc_id", "n_shingles", "digest"), named, "digest", "n", rows.count())
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("class_component", "doc_id"))
    found = found.select("doc_id", "n_shingles", component.alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))
