"""SimHash near-duplicates by anchor-point covering.

Two fingerprints of 64 bits that differ in at most three bits differ in at
most one bit of their first 31 bits or of their next 31. Each block of 31 bits
is covered by the perfect Hamming code: every block lies within radius 1 of
exactly one code word, its home anchor. A fingerprint is replicated to the
anchors within 2 (covering radius plus the threshold of one bit) of each
block: its home and fifteen others. Anchors that are no one's home are left
out where the replicas are made. Whatever is within one bit of a block
therefore visits that block's home, and comparing visitors with residents at
each anchor finds every link. Only distinct fingerprints take part, and
what an anchor hands on is not the pairs but edges with the same components.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bitmap
from .batches import of_texts
from .components import connected_components
from ..scratch import materialize

SHINGLE, SEED, THRESHOLD = 3, 42, 3
_BLOCK = 31
#: Residents, and rows in all, of one anchor that one task compares; anchors with more are cut into a grid of cells.
CELL_ROWS = 8192
_POSITIONS = np.arange(1, _BLOCK + 1, dtype=np.int64)


def shingle_hashes(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """XXH64 of each run of ``width`` words, repeats included; of the whole sequence if it is shorter."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: only A-Z are lowered, only ASCII blanks split
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[width - 1 :] if len(words) >= width else ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[: len(last)].tolist(), last.tolist())), dtype=np.uint64, count=len(last))


def majority(words: np.ndarray) -> np.ndarray:
    """Signed 64-bit words of the bits that are set in over half of the rows of ``words`` (n, w)."""
    counts = np.zeros(64 * words.shape[1], dtype=np.int64)
    for i in range(0, len(words), 255):  # as many as a byte counts
        part = np.ascontiguousarray(words[i : i + 255], dtype="<u8")
        counts += np.unpackbits(part.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(words), bitorder="little").view("<i8")


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """Signed 64-bit SimHash: a bit is set where over half of the hashes have it; 0 without words."""
    return int(majority(shingle_hashes(text, width)[:, None])[0])


def _prints(width: int):
    @F.pandas_udf("long")
    def fingerprints(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, width) for t in texts], dtype="int64")

    return fingerprints


def with_fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """``doc_id`` and ``fp`` (long) of every row; whole texts, null as empty."""

    return of_texts(docs).select("doc_id", _prints(width)("text").alias("fp"))


def anchors(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For 31-bit values: row numbers, anchors (code words) within distance 2, and whether each is the home."""
    syndrome = np.zeros(len(blocks), dtype=np.int64)
    for position in _POSITIONS:
        syndrome ^= np.where((blocks >> (position - 1)) & 1, position, 0)
    rows = np.arange(len(blocks))
    on_code = syndrome == 0
    home = np.where(on_code, blocks, blocks ^ (1 << np.maximum(syndrome - 1, 0)))
    out_rows, out_anchor, out_home = [rows], [home], [np.ones(len(blocks), dtype=bool)]
    off = rows[~on_code]
    for i in _POSITIONS:  # flipping two positions whose numbers xor to the syndrome leads to a code word
        j = syndrome[off] ^ i
        some = off[i < j]
        out_rows.append(some)
        out_anchor.append(blocks[some] ^ (1 << (i - 1)) ^ (1 << ((syndrome[some] ^ i) - 1)))
        out_home.append(np.zeros(len(some), dtype=bool))
    return np.concatenate(out_rows), np.concatenate(out_anchor), np.concatenate(out_home)


def _places(prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each 31-bit block of fingerprints (n, w): rows, keys of their anchors, whether it is the home, and the word to check by.

    The key has the block's number as its lowest part. A block is checked by
    the word after its own, which tells more of the rest.
    """
    words = prints.shape[1]
    for block in range(2 * words):
        rows, anchor, home = anchors((prints[:, block // 2] >> (_BLOCK * (block % 2))) & ((1 << _BLOCK) - 1))
        yield rows, anchor * (2 * words) + block, home, prints[:, (block // 2 + 1) % words]


def _slots(keys: np.ndarray) -> np.ndarray:
    return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)).astype(np.int64)


def _as_words(batch: pd.DataFrame) -> np.ndarray:
    return np.array(batch["prints"].tolist(), dtype=np.int64).reshape(len(batch), -1)


def residents(prints: DataFrame) -> DataFrame:
    """(anchor, node) of each ``node`` at the homes of its blocks, for ``prints`` as in ``replicate``."""

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            node = batch["node"].to_numpy(dtype=np.int64)
            for rows, keys, home, _ in _places(_as_words(batch)):
                yield pd.DataFrame({"anchor": keys[home], "node": node[rows[home]]})

    return prints.select("node", "prints").mapInPandas(deal, "anchor long, node long")


def replicate(prints: DataFrame, bits: int = bitmap.BITS, also: Sequence[str] = ()) -> DataFrame:
    """(anchor, node, check, home) of each ``node`` at its anchors, for ``prints`` (node long, prints array of longs); long columns ``also`` go with the node.

    Visits to anchors that are no one's home find nothing. A bitmap of all
    homes drops them before they are shuffled, as far as its fixed size goes.
    """

    def homes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield bitmap.words_of(np.concatenate([_slots(keys[home]) % bits for _, keys, home, _ in _places(_as_words(batch))] or [np.zeros(0, dtype=np.int64)]))

    marks = prints.sparkSession.sparkContext.broadcast(bitmap.collect_words(prints.select("prints").mapInPandas(homes, "word long, mask long"), bits))  # bits / 8 bytes

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            node = batch["node"].to_numpy(dtype=np.int64)
            for rows, keys, home, check in _places(_as_words(batch)):
                keep = home | bitmap.is_set(marks.value, _slots(keys))
                rows = rows[keep]
                yield pd.DataFrame({"anchor": keys[keep], "node": node[rows], "check": check[rows], "home": home[keep], **{c: batch[c].to_numpy(dtype=np.int64)[rows] for c in also}})

    return prints.select("node", "prints", *also).mapInPandas(deal, ", ".join(["anchor long, node long, check long, home boolean", *[f"{c} long" for c in also]]))


def _links(fp: np.ndarray, home: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges with the components of the links between residents and visitors of one cell.

    Breadth first from each resident not yet reached; every row is compared
    from once, a resident with all rows not reached, a visitor with the
    residents among them.
    """
    out_a, out_b = [], []
    left = np.arange(len(fp))  # rows not reached yet
    reached = np.zeros(len(fp), dtype=bool)
    for seed in np.flatnonzero(home).tolist():
        if reached[seed]:
            continue
        reached[seed] = True
        front = np.array([seed])
        while len(front):
            left = left[~reached[left]]
            found = []
            for members, others in ((front[home[front]], left), (front[~home[front]], left[home[left]])):
                rows = max(1, 2_000_000 // max(1, len(others)))
                for s in range(0, len(members), rows):
                    others = others[~reached[others]]
                    if not len(others):
                        break
                    near = (np.bitwise_count((fp[members[s : s + rows], None] ^ fp[None, others]).view(np.uint64)) <= threshold).any(axis=0)
                    new = others[near]
                    reached[new] = True
                    found.append(new)
            front = np.concatenate(found) if found else np.zeros(0, dtype=np.int64)
            out_a.append(np.full(len(front), fp[seed]))
            out_b.append(fp[front])
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate(out_a or [none]), np.concatenate(out_b or [none])


def _compare(batches: Iterator[pd.DataFrame], threshold: int) -> Iterator[pd.DataFrame]:
    """Compare the rows of each cell. The partition is sorted by cell; a cell may run over batches."""
    keys = ["anchor", "i", "j"]
    held: list[pd.DataFrame] = []
    for batch in batches:
        if held:
            batch = pd.concat([*held, batch], ignore_index=True)
        if not len(batch):
            continue
        cells = batch[keys].to_numpy()
        same = (cells[1:] == cells[:-1]).all(axis=1)
        back = np.flatnonzero(~same)
        start_last = int(back[-1]) + 1 if len(back) else 0
        held = [batch.iloc[start_last:]]
        if start_last:
            yield _compare_whole(batch.iloc[:start_last], same[: start_last - 1], threshold)
    if held:
        rest = held[0]
        yield _compare_whole(rest, np.ones(max(0, len(rest) - 1), dtype=bool), threshold)


def _compare_whole(rows: pd.DataFrame, same: np.ndarray, threshold: int) -> pd.DataFrame:
    """Edges of complete cells; ``same[k]``: rows k and k + 1 share a cell."""
    out_a, out_b = [], []
    if len(rows):
        fp, home = rows["fp"].to_numpy(dtype=np.int64), rows["home"].to_numpy(dtype=bool)
        cuts = np.concatenate(([0], np.flatnonzero(~same) + 1, [len(rows)]))
        size = np.diff(cuts)
        pairs = cuts[:-1][size == 2]  # most cells with company hold two rows: all at once
        near = (home[pairs] | home[pairs + 1]) & (fp[pairs] != fp[pairs + 1]) & (np.bitwise_count((fp[pairs] ^ fp[pairs + 1]).view(np.uint64)) <= threshold)
        out_a.append(fp[pairs[near]])
        out_b.append(fp[pairs[near] + 1])
        for start, n in zip(cuts[:-1][size > 2].tolist(), size[size > 2].tolist()):
            a, b = _links(fp[start : start + n], home[start : start + n], threshold)
            out_a.append(a)
            out_b.append(b)
    none = np.zeros(0, dtype=np.int64)
    return pd.DataFrame({"a": np.concatenate(out_a or [none]), "b": np.concatenate(out_b or [none])})


def near_links(fingerprints: DataFrame, *, threshold: int = THRESHOLD, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Edges (a, b) with the components that links of at most ``threshold`` (at most 3) bits give column ``fp`` (distinct longs).

    Per cell, each row that links reach is tied to the row they reach it from
    first, so the result has no more rows than replicas, while its components
    are those of all links. Anchors with more than ``cell_rows`` rows are cut
    into a grid: every row goes to one column of it, residents also to one
    line, so each pair still meets and no cell holds more than about two such
    numbers, whether residents or visitors crowd the anchor.
    """
    if threshold > 3:
        raise ValueError("two blocks with one bit each cover three differing bits at most")
    replicas = materialize(replicate(fingerprints.select(F.col("fp").alias("node"), F.array("fp").alias("prints"))), "simhash-replicas")
    crowded = (
        replicas.groupBy("anchor").agg(F.count("*").alias("n"), F.count_if("home").alias("residents")).filter((F.col("n") > cell_rows) & (F.col("residents") > 0))
        .select("anchor", F.ceil(F.col("residents") / cell_rows).cast("int").alias("lines"), F.ceil(F.col("n") / cell_rows).cast("int").alias("columns"))
    )
    crowded = materialize(crowded, "simhash-crowded")
    grid = replicas.select("anchor", F.col("node").alias("fp"), "home").join(crowded, "anchor", "left").withColumns({"lines": F.coalesce("lines", F.lit(1)), "columns": F.coalesce("columns", F.lit(1))})
    place = lambda purpose, of: F.pmod(F.xxhash64("fp", F.lit(purpose)), F.col(of)).cast("int")
    grid = grid.withColumns({"line": place("line", "lines"), "column": place("column", "columns")})
    in_column = "transform(sequence(0, lines - 1), x -> struct(x as i, column as j, home and x = line as home))"
    in_line = "transform(filter(sequence(0, columns - 1), x -> home and x != column), x -> struct(line as i, x as j, true as home))"
    cells = grid.select("anchor", "fp", F.explode(F.expr(f"concat({in_column}, {in_line})")).alias("cell")).select("anchor", "cell.*", "fp")
    parts = int(fingerprints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cells.select("anchor", "i", "j", "fp", "home").repartition(parts, "anchor", "i", "j").sortWithinPartitions("anchor", "i", "j", "fp")
    return dealt.mapInPandas(lambda batches: _compare(batches, threshold), "a long, b long")


def near_duplicates(docs: DataFrame, *, width: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, fp and component_id for every row of ``docs`` (``doc_id``, ``text``).

    component_id is the smallest doc_id that links of at most ``threshold``
    differing bits reach, the row itself included. Texts without words have
    fingerprint 0 and link like any other; rows with a null doc_id take part,
    but never name a component unless all its ids are null. Repeated rows
    stay. Extra columns are ignored. An empty table gives an empty table.
    """
    prints = materialize(with_fingerprints(docs, width), "simhash-prints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    roots = connected_components(near_links(distinct, threshold=threshold)).withColumnRenamed("node", "fp")
    known = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    linked = known.join(roots.select("root").distinct(), "root", "left_semi")
    named = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    ids = materialize(known.join(named, "root", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id")), "simhash-ids")
    return prints.join(ids, "fp").select("doc_id", "fp", "component_id")


def row_keys(docs: DataFrame) -> DataFrame:
    """``docs`` with ``k_row``, the doc_id (a whole number) or, where it is null, a number made from the text above the usual ids, and ``k_text``, the text's hash."""
    stand_in = F.xxhash64("text").bitwiseAND(F.lit((1 << 61) - 1)) + F.lit(1 << 62)
    return docs.withColumn("k_row", F.coalesce(F.col("doc_id").cast("long"), stand_in)).withColumn("k_text", F.xxhash64("text"))


def keep_first(docs: DataFrame, found: DataFrame) -> DataFrame:
    """One row of ``docs`` for each ``root`` of ``found`` (k_row, k_text, root), columns unchanged: the one with the smallest doc_id.

    Of texts under the winning id the one with the smallest hash stays, and of
    rows that repeat both, the one whose columns sort first. A null doc_id
    goes as ``row_keys`` numbers it. Rows that neither lose nor repeat stay
    where they are; only the others' keys decide, by a join.
    """
    key = ["k_row", "k_text"]
    least = found.groupBy("root").agg(F.min(F.struct(*key)).alias("k"))
    winners = materialize(least.select("k.*").distinct(), "simhash-winners")
    counted = found.groupBy(*key).count()
    losers = counted.join(winners, key, "left_anti").select(*key)
    repeated = materialize(counted.filter("count > 1").select(*key).join(winners, key, "left_semi"), "simhash-repeated")
    moved = losers.unionByName(repeated).select(F.xxhash64(*key).alias("key"))
    marks = docs.sparkSession.sparkContext.broadcast(bitmap.bitmap_of(moved, "key"))  # bitmap.BITS / 8 bytes
    keyed = row_keys(docs)
    in_question = bitmap.may_hold(marks, F.xxhash64(*key))
    kept = keyed.filter(in_question).join(winners, key, "left_semi")
    if not repeated.isEmpty():
        row = F.struct("text", *[c for c in docs.columns if c != "text"])
        again = kept.join(repeated, key, "left_semi").select(*key, row.alias("row")).groupBy(*key).agg(F.min("row").alias("row"))
        kept = kept.join(repeated, key, "left_anti").select(*docs.columns).unionByName(again.select("row.*").select(*docs.columns))
    return keyed.filter(~in_question).select(*docs.columns).unionByName(kept.select(*docs.columns))


def keep_one(docs: DataFrame, *, width: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """One row of ``docs`` for each component of linked fingerprints, columns unchanged: see ``keep_first``."""
    prints = materialize(row_keys(of_texts(docs)).select("k_row", "k_text", _prints(width)("text").alias("fp")), "simhash-rows")
    roots = connected_components(near_links(prints.select("fp").distinct(), threshold=threshold)).withColumnRenamed("node", "fp")
    return keep_first(docs, prints.join(roots, "fp", "left").select("k_row", "k_text", F.coalesce("root", "fp").alias("root")))
