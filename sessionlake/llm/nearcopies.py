"""Near copies: SimHash anchors find the candidates, exact similarity decides.

Two texts are near copies if the Jaccard similarity of their sets of five-word
shingles is at least 0.8. That is far more than three bits of a fingerprint,
so a text gets a fingerprint of twelve words instead of one, from its distinct
two-word shingles, of which an edit touches least. Each word is covered as in
``simhash``: two blocks of 31 bits, every block at its home anchor and at the
others within covering radius plus one bit. Texts that meet at one of
the 24 homes, and whose sizes and whole fingerprints allow it, are
candidates. How many near copies meet is stated in ``meeting_chance``.

Every candidate is decided by its exact similarity. Texts with one set of
shingles are one node, so exact copies make no pairs. Candidates are grouped
twice: first texts with a common home, 24 rows a text, then those that
meet at an anchor from different groups. So the anchors that a large group of
copies has for itself carry no rows on. Inside a group each text is compared
with the resident of its homes with most company in all, which is what a group
of copies was made from if that is there; where this leaves more than one
component, every two texts of the group are compared inside a task: links
leave it, pairs do not.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize
from . import bitmap
from .batches import of_texts
from .components import connected_components
from .simhash import keep_first, replicate, residents, row_keys, shingle_hashes

SHINGLE = 5
#: Similarity from which two texts are near copies, as a fraction of whole numbers.
ALIKE, OF = 4, 5
#: Words of a wide fingerprint, and its shingles.
PRINT_WORDS, PRINT_SHINGLE = 12, 2
#: Shingles of the texts that are compared in one task at once.
BLOCK_SHINGLES = 200_000
#: Rows of one anchor that one task compares; anchors with more are cut into a grid.
CELL_ROWS = 4096

_FACTORS = np.random.default_rng(42).integers(0, 1 << 63, PRINT_WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text; none without words."""
    return np.unique(shingle_hashes(text, width))


def wide_print(text: str | None) -> np.ndarray:
    """Fingerprint of PRINT_WORDS words of 64 bits: the majority of as many mixed hashes of each distinct shingle, a slice of a long text at a time."""
    shingles = shingle_set(text, PRINT_SHINGLE)
    counts = np.zeros(64 * PRINT_WORDS, dtype=np.int64)
    for at in range(0, len(shingles), 255):  # as many as a byte counts
        mixed = shingles[at : at + 255, None] * _FACTORS
        mixed = (mixed ^ (mixed >> np.uint64(32))) * _MIX
        mixed ^= mixed >> np.uint64(29)
        counts += np.unpackbits(mixed.astype("<u8", copy=False).view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(shingles), bitorder="little").view("<i8")


def meeting_chance(similarity: float, blocks: int = 2 * PRINT_WORDS) -> float:
    """Chance that two sets of equal size meet at an anchor, by the Jaccard similarity of their distinct PRINT_SHINGLE-word shingles.

    A bit differs with chance p = angle / pi. Two blocks meet if one lies
    within 2 of the other's home: always up to one differing bit, and where a
    bit towards a home is among the differing ones for two or three (chance
    of either side about 6 of 32).
    """
    p = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    exactly = lambda d: math.comb(31, d) * p**d * (1 - p) ** (31 - d)
    return 1 - (1 - exactly(0) - exactly(1) - 6 / 32 * (exactly(2) + exactly(3))) ** blocks


def most_bits(similarity: float, words: int = PRINT_WORDS) -> int:
    """Differing bits of a whole wide fingerprint that sets this alike stay within: five standard errors above what is expected."""
    n, p = 64 * words, math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    return math.ceil(n * p + 5 * math.sqrt(n * p * (1 - p)))


def _sketch(batches: Iterator[pd.DataFrame], width: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        node, size, prints = [], [], []
        for text in batch["text"]:
            shingles = shingle_set(text, width)
            node.append(xxhash.xxh3_64_intdigest(shingles.tobytes()))
            size.append(len(shingles))
            prints.append(wide_print(text) if len(shingles) else [])
        yield pd.DataFrame({"k_row": batch["k_row"], "k_text": batch["k_text"], "node": np.array(node, dtype=np.uint64).view(np.int64), "size": np.array(size, dtype=np.int64), "prints": prints})


def _decide(sets: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
    """Of ``pairs`` those whose sets are at least ALIKE / OF similar, in whole numbers."""
    shingles = dict(zip(sets["node"].tolist(), sets["shingles"]))
    kept = []
    for a, b in zip(pairs["a"].tolist(), pairs["b"].tolist()):
        x, y = shingles[a], shingles[b]
        if len(x) > len(y):
            x, y = y, x
        if ALIKE * len(y) <= OF * len(x):  # sets of other sizes cannot be alike
            shared = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
            kept.append((ALIKE + OF) * shared >= ALIKE * (len(x) + len(y)))
        else:
            kept.append(False)
    return pairs.loc[np.array(kept, dtype=bool), ["a", "b"]]


def _alike(pairs: DataFrame, groups: DataFrame, sets: DataFrame) -> DataFrame:
    """Of ``pairs`` (a, b), both of one of ``groups`` (node, root), those whose sets are similar enough.

    The sets of a group that pairs connect meet in one task, each once, however
    many pairs it is in; of more than BLOCK_SHINGLES in all the pairs are dealt
    to a grid of blocks, and a set goes to the blocks that ask for it.
    """
    joined = groups.join(sets.select("node", F.size("shingles").alias("size")), "node")
    blocks = joined.groupBy("root").agg(F.ceil(F.sum("size") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    places = materialize(joined.join(blocks, "root").select("node", "root", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")), "near-places")
    one, other = (places.select(F.col("node").alias(end), *((["root"]) if end == "a" else []), F.col("block").alias(f"of_{end}")) for end in ("a", "b"))
    dealt = pairs.join(one, "a").join(other, "b").select("root", F.least("of_a", "of_b").alias("i"), F.greatest("of_a", "of_b").alias("j"), "a", "b")
    dealt = materialize(dealt, "near-dealt")
    wanted = dealt.select("root", "i", "j", F.explode(F.array("a", "b")).alias("node")).distinct()
    held = wanted.join(sets, "node").select(F.col("root").alias("h_root"), F.col("i").alias("h_i"), F.col("j").alias("h_j"), "node", "shingles")
    return held.groupBy("h_root", "h_i", "h_j").cogroup(dealt.groupBy("root", "i", "j")).applyInPandas(_decide, "a long, b long")


def _whole_cells(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Rows of complete cells, and where each cell starts and the last one ends; the partition is sorted by cell, which may run over batches."""
    held: list[pd.DataFrame] = []
    for batch in chain(batches, (None,)):
        rows = pd.concat([*held, *([batch] if batch is not None else [])], ignore_index=True) if held or batch is not None else pd.DataFrame()
        if not len(rows):
            continue
        cells = rows[keys].to_numpy()
        starts = np.concatenate(([0], np.flatnonzero((cells[1:] != cells[:-1]).any(axis=1)) + 1, [len(rows)]))
        if batch is not None:
            held, rows, starts = [rows.iloc[starts[-2] :]], rows.iloc[: starts[-2]], starts[:-1]
        if len(rows):
            yield rows, starts


def _like(prints: np.ndarray, size: np.ndarray, ones: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Whether fingerprints and sizes of rows ``ones`` (n) and ``others`` (m) let them be alike: (n, m)."""
    apart = np.bitwise_count((prints[ones][:, None, :] ^ prints[others][None, :, :]).view(np.uint64)).sum(axis=2, dtype=np.int64)
    x, y = size[ones][:, None], size[others][None, :]
    return (apart <= most_bits(ALIKE / OF)) & (ALIKE * x <= OF * y) & (ALIKE * y <= OF * x)


def _tie_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges with the components that the pairs of each cell have which could be alike: breadth first from every resident, each row tied once."""
    for rows, starts in _whole_cells(batches, ["anchor", "i", "j"]):
        node, home, size = rows["node"].to_numpy(), rows["home"].to_numpy(dtype=bool), rows["size"].to_numpy()
        prints = np.array(rows["prints"].tolist(), dtype=np.int64).reshape(len(rows), -1)
        out_a, out_b = [], []
        for start, end in zip(starts[:-1].tolist(), starts[1:].tolist()):
            left = np.arange(start, end)
            while len(left) and home[left].any():
                front = left[home[left]][:1]
                left, seed = left[left != front[0]], front[0]
                while len(front) and len(left):
                    near = np.zeros(len(left), dtype=bool)
                    step = max(1, 200_000 // len(left))
                    for at in range(0, len(front), step):
                        some = front[at : at + step]
                        near |= (_like(prints, size, some, left) & (home[some][:, None] | home[left][None, :])).any(axis=0)
                    front, left = left[near], left[~near]
                    out_a.append(np.full(len(front), node[seed]))
                    out_b.append(node[front])
        none = np.zeros(0, dtype=np.int64)
        yield pd.DataFrame({"a": np.concatenate(out_a or [none]), "b": np.concatenate(out_b or [none])})


def _candidates(rest: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (a, b) between texts that share an anchor, one of them at home there, and could be alike; fewer than rows.

    Rows (anchor, node, home); ``nodes`` has size and prints. An anchor with more than
    CELL_ROWS rows is cut into a grid: a row goes to one column of every line
    and, at home, to every column of one line.
    """
    many = rest.groupBy("anchor").agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("parts"), F.count_if("home").alias("residents"))
    many = materialize(many.filter("residents > 0").select("anchor", "parts"), "near-anchors")
    dealt = rest.join(many, "anchor").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    cells = F.expr("transform(sequence(0, parts - 1), x -> struct(least(x, part) AS i, greatest(x, part) AS j))")
    dealt = dealt.withColumn("cell", F.explode(cells)).select("anchor", "cell.*", "node", "home").join(nodes.select("node", "size", "prints"), "node")
    number = int(rest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(number, "anchor", "i", "j").sortWithinPartitions("anchor", "i", "j", "node").mapInPandas(_tie_cells, "a long, b long")


def _decide_cell(rows: pd.DataFrame) -> pd.DataFrame:
    """Links between texts of one cell, of both its blocks, whose sets are alike; none within what is joined already.

    A bitmap of each set bounds what two sets share from above: the bits in
    common, and as many elements as found their bit taken. Only where this
    bound allows it the sets themselves are compared, in whole numbers.
    """
    rows = rows.assign(size=rows["shingles"].map(len)).sort_values(["size", "node"], ignore_index=True)
    node, size, block, sets = rows["node"].to_numpy(), rows["size"].to_numpy(), rows["block"].to_numpy(), rows["shingles"].tolist()
    joined = np.unique(rows["top"].to_numpy(), return_inverse=True)[1]
    words = 1 << max(0, int(size.mean() * 16 / 64)).bit_length()
    bits = np.zeros((len(rows), words), dtype=np.uint64)
    for n, x in enumerate(sets):
        place = np.unique(np.asarray(x).view(np.uint64) % np.uint64(64 * words))
        np.bitwise_or.at(bits[n], (place // np.uint64(64)).astype(np.int64), np.uint64(1) << (place % np.uint64(64)))
    taken = size - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    apart = rows["i"].iat[0] != rows["j"].iat[0]
    out_a, out_b = [], []
    for n in range(len(rows)):
        end = int(np.searchsorted(size, size[n] * OF // ALIKE, side="right"))
        others = np.arange(n + 1, end)
        others = others[(joined[others] != joined[n]) & (~apart | (block[others] != block[n]))]
        most = np.bitwise_count(bits[others] & bits[n]).sum(axis=1, dtype=np.int64) + taken[n]
        for m in others[(ALIKE + OF) * most >= ALIKE * (size[n] + size[others])].tolist():
            if joined[m] == joined[n]:
                continue
            shared = len(np.intersect1d(sets[n], sets[m], assume_unique=True))
            if (ALIKE + OF) * shared >= ALIKE * (size[n] + size[m]):
                out_a.append(node[n])
                out_b.append(node[m])
                joined[joined == joined[m]] = joined[n]
    return pd.DataFrame({"a": np.array(out_a, dtype=np.int64), "b": np.array(out_b, dtype=np.int64)})


def _alike_in_groups(grouped: DataFrame, sets: DataFrame) -> DataFrame:
    """Links that join the texts of each group (node, root, top, size) which are alike and not joined already.

    No pair leaves its task. A group of more than BLOCK_SHINGLES is cut into
    blocks and each two blocks meet in one task, so a set goes to as many
    tasks as its group has blocks.
    """
    blocks = grouped.groupBy("root").agg(F.ceil(F.sum("size") / BLOCK_SHINGLES).cast("int").alias("blocks"), F.count_distinct("top").alias("tops")).filter("tops > 1").select("root", "blocks")
    placed = grouped.join(blocks, "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    cells = F.expr("transform(sequence(0, blocks - 1), x -> struct(least(x, block) AS i, greatest(x, block) AS j))")
    dealt = materialize(placed.withColumn("cell", F.explode(cells)).select("root", "cell.*", "node", "top", "block"), "near-dealt")
    return dealt.join(sets, "node").groupBy("root", "i", "j").applyInPandas(_decide_cell, "a long, b long")


def _groups(nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(node, root) of all candidates, (anchor, node) of the homes that texts share, and edges (a, b) of those that meet elsewhere only.

    Most of a large group of copies is joined at its homes. An anchor that
    only one group comes to adds nothing to it and goes before anything is
    joined to its rows.
    """
    homes = materialize(residents(nodes), "near-homes")
    shared = homes.groupBy("anchor").count().filter("count > 1").select("anchor")
    lived = materialize(homes.join(shared, "anchor", "left_semi"), "near-lived")
    at_home = materialize(_candidates(lived.withColumn("home", F.lit(True)), nodes), "near-at-home")
    first = connected_components(at_home)
    known = nodes.join(first, "node", "left").select("node", "prints", F.coalesce("root", "node").alias("group"))
    cells = materialize(replicate(known, also=("group",)), "near-cells")
    split = cells.groupBy("anchor").agg(F.min("group").alias("x"), F.max("group").alias("y"), F.max("home").alias("lived")).filter("lived and x != y").select("anchor")
    met = materialize(cells.join(split, "anchor", "left_semi").select("anchor", "node", "home"), "near-met")
    across = materialize(_candidates(met, nodes), "near-across")
    return connected_components(first.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(across)), lived, across


def near_copies(keyed: DataFrame, *, width: int = SHINGLE) -> DataFrame:
    """k_row, k_text and root for every row of ``keyed`` (``k_row``, ``k_text``, ``text``).

    root is the same for all texts that links of the exact similarity join;
    texts without words have one root, texts shorter than a shingle are one
    shingle. (k_row, k_text) must tell texts apart. Texts are told apart by
    64-bit hashes of their sets of shingles.
    """
    prints = materialize(
        of_texts(keyed).select("k_row", "k_text", "text").mapInPandas(lambda batches: _sketch(batches, width), "k_row long, k_text long, node long, size long, prints array<long>"),
        "near-prints",
    )
    nodes = materialize(prints.filter(F.size("prints") > 0).groupBy("node").agg(F.first("size").alias("size"), F.first("prints").alias("prints")), "near-nodes")
    groups, lived, across = _groups(nodes)

    @F.pandas_udf("array<long>")
    def shingles(texts: pd.Series) -> pd.Series:
        return pd.Series([np.sort(shingle_set(t, width).view(np.int64)) for t in texts])

    # only the texts of groups are shuffled
    wanted = materialize(prints.join(groups, "node", "left_semi").groupBy("node").agg(F.min(F.struct("k_row", "k_text")).alias("k")).select("node", "k.*"), "near-wanted")
    texts = bitmap.semi_join(keyed.select("k_row", "k_text", "text"), wanted, ["k_row", "k_text"]).dropDuplicates(["k_row", "k_text"]).join(wanted, ["k_row", "k_text"])
    sets = materialize(texts.select("node", shingles("text").alias("shingles")), "near-sets")

    # one resident for each text, of all its homes
    here = materialize(lived.join(groups, "node"), "near-here")
    company = here.groupBy("anchor", "root").agg(F.count("*").alias("texts")).filter("texts > 1")
    weights = here.join(company, ["anchor", "root"]).groupBy("node").agg(F.sum("texts").alias("weight"))
    first = here.join(weights, "node").groupBy("anchor", "root").agg(F.max(F.struct("weight", "node")).alias("first"))
    stars = here.join(first, ["anchor", "root"]).groupBy(F.col("node").alias("a")).agg(F.max("first").alias("first"))
    stars = stars.select("a", F.col("first.node").alias("b")).unionByName(across).filter("a != b").distinct()
    links = materialize(_alike(stars, groups, sets), "near-links")
    roots = connected_components(links).withColumnRenamed("root", "top")
    grouped = materialize(groups.join(roots, "node", "left").join(nodes.select("node", "size"), "node").select("node", "root", F.coalesce("top", "node").alias("top"), "size"), "near-grouped")
    roots = connected_components(links.unionByName(_alike_in_groups(grouped, sets)))
    return prints.join(roots, "node", "left").select("k_row", "k_text", F.coalesce("root", "node").alias("root"))


def keep_one(docs: DataFrame, *, width: int = SHINGLE) -> DataFrame:
    """One row of ``docs`` (``doc_id``, ``text``) for each component of near copies, columns unchanged: see ``simhash.keep_first``.

    Null texts count as empty; texts without words form one component; rows
    with a null doc_id take part; repeated rows are copies. An empty table
    gives an empty table.
    """
    keyed = row_keys(docs)
    return keep_first(docs, near_copies(keyed, width=width))
