"""Jaccard self-join of word n-gram sets, searched through token-group matrices.

1. Every document's set is cut into k parts by the value of its token hashes,
   where k exceeds the largest symmetric difference of a linked pair.  So two
   linked documents have one part in common, and the hashes of the parts are
   keys that route documents, exactly, to the neighbourhoods they may have
   links in.  A neighbourhood is named by the least document of a key.  Linked
   documents share a known least number of keys, so a key that very many hold
   (a common passage) routes only documents with as many such keys.
2. Neighbourhoods are packed into blocks of up to BLOCK_TOKENS tokens.  In a
   block similar documents are put into groups of GROUP_SETS, and a matrix
   holds the union of the tokens of each group.  A query document's overlap
   with a union bounds its overlap with every member; only groups whose bound
   reaches the threshold are opened, and their members compared.
3. Links join into components.  Documents that are known to be in one
   component are not compared again; one pass for every document outside the
   largest component finds all others.

A neighbourhood with more tokens is cut into blocks that each hold its least
document too; what a block can't tie to it is looked up in the other blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm import words as W
from corvane.llm.components import connected_components
from corvane.llm.shared import bounded_batches, possible_matches, tidy
from corvane.scratch import SPLITS_PER_FILE, discard, join_groups, unused, written

WIDTH = 5
SIMILARITY = (80, 100)
BAND_RATIO = 1.5
#: The keys are matched in so many rounds, a range of hashes in each; what a round shuffles is gone before the next.
ROUNDS = 4
#: A key of more sets is hot: it routes only sets that may have links which share no other key.
HOT_KEY = 256
#: Most tokens of a block (but for a single longer document).
BLOCK_TOKENS = 500_000
#: Documents of a token group.
GROUP_SETS = 8
#: Most documents whose ids are broadcast; more are joined by shuffle.
BROADCAST_IDS = 2_000_000

_PART = np.uint64(0xD6E8FEB86659FD93)
_BAND = np.uint64(0xA0761D6478BD642F)


def token_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct tokens of all rows, row by row; tokens of each row)."""
    data, offsets = W.text_bytes(column)
    data = W.LOWER[data]
    starts, ends, counts = W.word_bounds(data, offsets, W.NON_BLANK)
    value, row = W.shingles(W.word_hashes(data, starts, ends), counts, width)
    by = np.argsort(value)
    rows = row[by]
    if len(counts) < 1 << 16:
        rows = rows.astype(np.uint16)  # sorted by radix
    by = by[np.argsort(rows, kind="stable")]
    value, row = value[by], row[by]
    new = np.ones(len(value), dtype=np.bool_)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    return value[new], np.bincount(row[new], minlength=len(counts))


class Parts:
    """Bands of set sizes, and the number of parts in each."""

    def __init__(self, similarity: tuple[int, int]):
        self.share, self.of = similarity
        self.edges = np.array([1], dtype=np.int64)

    def _reach(self, most: int) -> None:
        while self.edges[-1] <= most:
            last = int(self.edges[-1])
            self.edges = np.append(self.edges, max(last + 1, int(last * BAND_RATIO)))
        difference = (self.edges[1:] - 1) * (self.of - self.share) // self.share
        #: Parts that may be empty in a set before the keys of empty parts are needed as well.
        self.spare = np.array([self._spare(int(low), int(d)) for low, d in zip(self.edges[:-1], difference, strict=True)])
        self.parts = difference + 1 + self.spare

    @staticmethod
    def _spare(low: int, difference: int) -> int:
        """Enough that few of the band's smallest sets have more empty parts: the mean and two deviations."""
        spare = 0
        while difference and spare < difference + 2:
            parts = difference + 1 + spare
            share = np.exp(-low / parts)
            deviation = np.sqrt(parts * max(0.0, share - (1 + low / parts) * share * share))
            if parts * share + 2 * deviation <= spare:
                break
            spare += 1
        return spare

    def keys(self, tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(keys, keys of each row, keys that each row has in common with any linked set at least).

        A row uses the bands of all sizes that a smaller linked set can have.
        Linked sets differ in fewer parts than there are by 1 + spare; of those
        only the ones that are empty in both have no key.
        """
        self._reach(int(sizes.max(initial=1)))
        own = np.searchsorted(self.edges, sizes, "right") - 1
        least = np.searchsorted(self.edges, -(-sizes * self.share // self.of), "right") - 1
        out, rows = [], []
        need = np.full(len(sizes), np.iinfo(np.int32).max, dtype=np.int64)
        for back in range(int((own - least).max(initial=0)) + 1):
            chosen = (sizes > 0) & (own - back >= least)
            got, row = self._band(tokens, sizes, chosen, own - back, need)
            out.append(got)
            rows.append(row)
        keys, row = np.concatenate(out), np.concatenate(rows)
        by = np.argsort(row.astype(np.uint16) if len(sizes) < 1 << 16 else row, kind="stable")
        return keys[by], np.bincount(row, minlength=len(sizes)), need

    def _band(self, tokens: np.ndarray, sizes: np.ndarray, chosen: np.ndarray, band: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(sizes)), sizes)
        if not chosen.all():
            inside = chosen[row]
            tokens, row = tokens[inside], row[inside]
        if not len(tokens):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        count = np.where(chosen, self.parts[np.maximum(band, 0)], 0)
        part = ((tokens >> np.uint64(32)) * count[row].astype(np.uint64)) >> np.uint64(32)
        new = np.ones(len(part), dtype=np.bool_)
        new[1:] = (part[1:] != part[:-1]) | (row[1:] != row[:-1])
        first = np.flatnonzero(new)
        total = np.add.reduceat(W.mix(tokens), first)
        of, part = row[first], part[first]
        name = part * _PART + (band[of] + 1).astype(np.uint64) * _BAND
        keys = W.mix(total + name)
        empty = count - np.bincount(of, minlength=len(sizes))
        many = [(keys, of)]
        spare = self.spare[np.maximum(band, 0)]
        np.minimum(need, np.where(chosen, np.maximum(1, 1 + spare - empty), need), out=need)
        for r in np.flatnonzero(chosen & (empty > spare)):
            missing = np.setdiff1d(np.arange(count[r], dtype=np.uint64), part[of == r])
            many.append((W.mix(missing * _PART + band[r : r + 1].astype(np.uint64) * _BAND + _BAND), np.full(len(missing), r)))
        return np.concatenate([k for k, _ in many]), np.concatenate([r for _, r in many])


def _sets(docs: DataFrame, width: int, similarity: tuple[int, int]) -> DataFrame:
    """(id, n, rep, one, two, need, keys): keys only in the first document of each set that a task has seen; rep is that document.

    one and two are hashes of the whole set.
    """
    schema = T.StructType([docs.schema["id"], T.StructField("n", T.LongType()), T.StructField("rep", docs.schema["id"].dataType), *[T.StructField(c, T.LongType()) for c in ("one", "two", "need")], T.StructField("keys", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int, int], object] = {}
        parts = Parts(similarity)
        for batch in batches:
            tokens, sizes = token_sets(batch.column(1), width)
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tokens)])
            other = np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.mix(tokens))])
            ends = np.cumsum(sizes)
            one, two = total[ends] - total[ends - sizes], other[ends] - other[ends - sizes]
            ids = batch.column(0).to_pylist()
            reps, first = [], np.zeros(len(ids), dtype=np.bool_)
            for k, (i, x) in enumerate(zip(ids, zip(sizes.tolist(), one.tolist(), two.tolist(), strict=True), strict=True)):
                if i is None or not x[0]:
                    reps.append(i)
                    continue
                first[k] = x not in seen
                reps.append(seen.setdefault(x, i))
            keys, counts, need = parts.keys(tokens[np.repeat(first, sizes)], np.where(first, sizes, 0))
            where = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            lists = pa.ListArray.from_arrays(where, pa.array(keys.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(reps, batch.column(0).type), *[pa.array(x.view(np.int64)) for x in (one, two, need)], lists], names=["id", "n", "rep", "one", "two", "need", "keys"])

    return docs.mapInArrow(tidy(run), schema)


def _token_table(docs: DataFrame, width: int) -> DataFrame:
    """(id, tokens): the sorted tokens as little-endian bytes; of repeated rows a task gives one."""
    schema = T.StructType([docs.schema["id"], T.StructField("tokens", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[object, int]] = set()
        for batch in batches:
            tokens, sizes = token_sets(batch.column(1), width)
            where = np.concatenate([[0], np.cumsum(sizes * 8)]).tolist()
            raw = tokens.tobytes()
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.mix(tokens))])
            ends = np.cumsum(sizes)
            names, sets = [], []
            for k, x in enumerate(zip(batch.column(0).to_pylist(), (total[ends] - total[ends - sizes]).tolist(), strict=True)):
                if sizes[k] and x not in seen:
                    seen.add(x)
                    names.append(x[0])
                    sets.append(raw[where[k] : where[k + 1]])
            yield pa.RecordBatch.from_arrays([pa.array(names, batch.column(0).type), pa.array(sets, pa.binary())], names=["id", "tokens"])

    return docs.mapInArrow(tidy(run), schema)


class TokenGroups:
    """The token-group matrix of some sets, and the components found so far.

    The matrix is stored sparse: for each token the groups whose union has it.
    ``asked`` counts the groups that queries were bounded against, ``opened``
    those whose members were compared.
    """

    def __init__(self, sets: list[np.ndarray], similarity: tuple[int, int]):
        self.share, self.of = similarity
        m = len(sets)
        order = sorted(range(m), key=lambda i: (*sets[i][:3].tolist(), len(sets[i])))  # like sets have the same least tokens
        self.order = np.array(order)
        self.sizes = np.array([len(sets[i]) for i in order])
        _, self.tokens = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.groups = -(-m // GROUP_SETS)
        self.least = np.minimum.reduceat(self.sizes, np.arange(self.groups) * GROUP_SETS)
        cells = np.unique(self.tokens.astype(np.int64) * self.groups + np.repeat(np.arange(m) // GROUP_SETS, self.sizes))
        self.columns = cells % self.groups
        self.row_ends = np.cumsum(np.bincount(cells // self.groups))
        self.row_starts = np.concatenate([[0], self.row_ends[:-1]])
        self.mark = np.zeros(len(self.row_ends), dtype=np.uint8)
        self.label = np.arange(m)
        self.members = [[i] for i in range(m)]
        self.links: list[tuple[int, int]] = []
        self.asked = self.opened = 0

    @staticmethod
    def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """starts[0], starts[0] + 1, ... of all ranges, one after the other."""
        return np.arange(int(sizes.sum())) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)

    def overlaps(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(groups whose union has any of the tokens, how many of them it has)."""
        start = self.row_starts[own]
        columns = self.columns[self._ranges(start, self.row_ends[own] - start)]
        if len(columns) < self.groups:
            return np.unique(columns, return_counts=True)
        bound = np.bincount(columns, minlength=self.groups)
        some = np.flatnonzero(bound)
        return some, bound[some]

    def look_up(self, i: int) -> np.ndarray:
        """The sets linked with set ``i`` that aren't known to be in its component (positions in ``order``)."""
        own, n = self.tokens[self.starts[i] : self.ends[i]], int(self.sizes[i])
        low, high = -(-n * self.share // self.of), n * self.of // self.share
        group, bound = self.overlaps(own)
        least = self.least[group]
        need = -(-self.share * (n + np.maximum(least, low)) // (self.share + self.of))
        group = group[(bound >= need) & (least <= high)]
        sets = (group[:, None] * GROUP_SETS + np.arange(GROUP_SETS)).ravel()
        sets = sets[sets < len(self.sizes)]
        size = self.sizes[sets]
        sets = sets[(self.label[sets] != self.label[i]) & (size >= low) & (size <= high)]
        self.asked += self.groups
        self.opened += len(np.unique(sets // GROUP_SETS))
        if not len(sets):
            return sets
        size = self.sizes[sets]
        self.mark[own] = 1
        hit = self.mark[self.tokens[self._ranges(self.starts[sets], size)]]
        self.mark[own] = 0
        common = np.add.reduceat(hit, np.cumsum(size) - size, dtype=np.int64)
        return sets[self.of * common >= self.share * (n + size - common)]

    def tie(self, i: int) -> None:
        for j in self.look_up(i).tolist():
            a, b = int(self.label[i]), int(self.label[j])
            if a != b:
                if len(self.members[a]) < len(self.members[b]):
                    a, b = b, a
                self.label[self.members[b]] = a
                self.members[a] += self.members[b]
                self.members[b] = []
                self.links.append((i, j))

    def tie_all(self) -> None:
        """Find all links that join components: look up every set outside the largest component."""
        done = np.zeros(len(self.label), dtype=np.bool_)
        while True:
            largest = max(range(len(self.members)), key=lambda k: len(self.members[k]))
            rest = np.flatnonzero(~done & (self.label != largest)).tolist()
            if not rest:
                break
            for i in rest[: max(64, len(rest) // 4)]:
                self.tie(i)
                done[i] = True


def _search_blocks(members: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Links within each (leader, block) of members (leader, block, id, anchor, asks, tokens).

    Returns (u, v, leader, block, asked, opened): links; for sets without a
    known tie to the anchor, where there is one, a row with v null; and a row
    without u with the counts of groups.  With ``asks`` set in some rows, only
    those are looked up, and there are no rows with v null.
    """
    of_id = members.schema["id"].dataType
    counts = [T.StructField(c, T.LongType()) for c in ("asked", "opened")]
    schema = T.StructType([T.StructField("u", of_id), T.StructField("v", of_id), T.StructField("leader", of_id), T.StructField("block", T.IntegerType()), *counts])

    def run(table: pa.Table) -> pa.Table:
        ids, asks = table.column("id").to_pylist(), table.column("asks").to_pylist()
        leader, block, anchor = (table.column(c)[0].as_py() for c in ("leader", "block", "anchor"))
        near = TokenGroups([np.frombuffer(x, dtype=np.uint64) for x in table.column("tokens").to_pylist()], similarity)
        name = [ids[i] for i in near.order]
        rows = []
        if any(asks):
            for i in np.flatnonzero([asks[k] for k in near.order]).tolist():
                near.tie(i)
        else:
            near.tie_all()
            if anchor is not None:
                rows = [(name[i], None) for i in np.flatnonzero(near.label != near.label[name.index(anchor)]).tolist()]
        rows += [(name[i], name[j]) for i, j in near.links]
        u, v = [u for u, _ in rows], [v for _, v in rows]
        none = [None] * len(rows)
        kind = table.column("id").type
        return pa.table({"u": pa.array([*u, None], kind), "v": pa.array([*v, None], kind), "leader": pa.array([leader] * (len(rows) + 1), kind), "block": pa.array([block] * (len(rows) + 1), pa.int32()), "asked": pa.array([*none, near.asked], pa.int64()), "opened": pa.array([*none, near.opened], pa.int64())})

    return members.groupBy("leader", "block").applyInArrow(run, schema)


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, similarity: tuple[int, int] = SIMILARITY, report: dict[str, int] | None = None) -> DataFrame:
    """(id, n_shingles, component_id): one row per row of ``docs``.

    Words are runs of non-blanks with A-Z lower-cased; a document's set holds
    its distinct runs of ``width`` words, or all its words as one if it has
    fewer.  Two documents link when their sets' Jaccard similarity is at least
    similarity[0] / similarity[1]; the component is the least id reachable.
    Null, empty and blank texts have an empty set and link with nothing; of
    very long texts the whole set is compared.  Rows with a null id get a null
    component and link nothing.  Rows that share an id are one document with
    the links of either.  Other columns are ignored, whatever their names, and
    an empty table gives an empty result.  ``report`` gets the numbers of token
    groups that queries were bounded against (asked) and that were opened.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sets = written(_sets(slim, width, similarity), "sets", SPLITS_PER_FILE)
    # equal sets of different tasks: a link to the least document of the set, and no part in the search
    firsts = sets.where(F.size("keys") > 0)
    equal = firsts.groupBy("n", "one", "two").agg(F.min("id").alias("least"), F.count("*").alias("c")).where("c > 1").drop("c")
    copies = written(firsts.select("id", "n", "one", "two").join(equal, ["n", "one", "two"]).where("id <> least").select("id", "one", "two", "least"), "copies")
    searched = firsts.join(F.broadcast(copies) if copies.count() <= BROADCAST_IDS else copies, ["id", "one", "two"], "left_anti")
    rounds = []
    for k in range(ROUNDS):
        keyed = searched.select("id", F.explode("keys").alias("key")).where(F.pmod("key", F.lit(ROUNDS)) == k)
        live = written(keyed.groupBy("key").agg(F.min("id").alias("leader"), F.count("*").alias("n")).where("n > 1"), "keys")
        matched = join_groups(possible_matches(keyed, live, "key"), live, "key", "n")
        rounds.append(written(matched.groupBy("leader", "id", (F.col("n") > HOT_KEY).alias("hot")).agg(F.count("*").alias("common")), "near"))
        discard(live)
    shared = written(reduce(DataFrame.union, rounds).groupBy("leader", "id", "hot").agg(F.sum("common").alias("common")), "near")
    discard(*rounds)
    # a document with fewer shared keys than a link needs has none; one with fewer hot keys than that shares a key that isn't hot with all it links to
    need = firsts.groupBy("id").agg(F.min("need").alias("need"))
    have = shared.groupBy("id").agg(F.sum("common").alias("have"), F.sum(F.when(F.col("hot"), F.col("common")).otherwise(0)).alias("have_hot"))
    asked = written(have.join(need, "id").where("have >= need").select("id", (F.col("have_hot") >= F.col("need")).alias("all_hot")), "asked")
    few = asked.count() <= BROADCAST_IDS
    some = F.broadcast(asked) if few else asked
    left = shared.join(some, "id").where("not hot or all_hot").select("leader", "id").distinct()
    groups = left.groupBy("leader").agg(F.min("id").alias("anchor"), F.count("*").alias("n")).where("n > 1")
    groups = written(groups, "groups")
    near = written(join_groups(left, groups, "leader", "n").select("leader", "id", "anchor"), "near")
    slim_sets = written(sets.select("id", "n", "rep"), "sizes")
    discard(sets)  # the keys are matched
    tokens = written(_token_table(slim.join(some, "id", "left_semi"), width), "tokens", SPLITS_PER_FILE)
    # neighbourhoods are packed into blocks; one with more tokens is cut, and each of its blocks holds the anchor, its least document
    weight = near.join(tokens.groupBy("id").agg(F.sum(F.octet_length("tokens") / 8).alias("w")), "id")
    cuts = written(weight.groupBy("leader").agg(F.ceil(F.sum("w") / BLOCK_TOKENS).cast("int").alias("blocks"), F.sum("w").alias("w")), "cuts")
    packs = max(1, -(-int(cuts.where("blocks = 1").agg(F.sum("w")).first()[0] or 0) // BLOCK_TOKENS))
    cut = F.col("blocks") > 1
    block = F.when(~cut, F.array(F.pmod(F.xxhash64("leader"), F.lit(packs)).cast("int"))).when(F.col("id") == F.col("anchor"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")))
    dealt = join_groups(near, cuts, "leader", "w").select(F.when(cut, F.col("leader")).alias("leader"), "blocks", "id", F.when(cut, F.col("anchor")).alias("anchor"), F.explode(block).alias("block"))
    placed = written(dealt.distinct(), "placed")
    members = placed.join(tokens, "id").select("leader", "block", "id", "anchor", F.lit(False).alias("asks"), "tokens")
    first = written(_search_blocks(members, similarity), "links")
    # sets of cut neighbourhoods that their own block doesn't tie to the anchor ask all other blocks
    loose = first.where("u is not null and v is null").select("leader", F.col("u").alias("id"), F.col("block").alias("own")).join(cuts.where("blocks > 1").select("leader", "blocks"), "leader")
    links = first.where("v is not null").select("u", "v")
    if report is not None:
        report.update(first.agg(F.sum("asked").alias("asked"), F.sum("opened").alias("opened")).first().asDict())
    if not loose.isEmpty():
        asking = loose.select("leader", "id", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).where("block <> own")
        there = placed.where("blocks > 1").join(asking.select("leader", "block").distinct(), ["leader", "block"], "left_semi")
        rows = asking.select("leader", "block", "id", F.col("id").alias("anchor"), F.lit(True).alias("asks")).unionByName(there.select("leader", "block", "id", "anchor", F.lit(False).alias("asks")))
        links = links.union(_search_blocks(rows.join(tokens, "id").select("leader", "block", "id", "anchor", "asks", "tokens"), similarity).where("v is not null").select("u", "v"))
    parts = written(connected_components(links.union(copies.select("id", "least"))), "components")
    discard(copies, shared, asked, groups, near, tokens, cuts, placed, first)
    lowest = slim_sets.where("n > 0 and id is not null").groupBy("rep").agg(F.min("id").alias("low"))
    named = lowest.join(parts, F.col("rep") == F.col("node"), "left").select("rep", "low", F.coalesce("component", "rep").alias("component"))
    labels = named.groupBy("component").agg(F.min("low").alias("label"), F.count("*").alias("n"))
    by_rep = join_groups(named.select("rep", "component"), written(labels, "labels"), "component", "n").select(F.col("rep").alias("of_rep"), "label")
    out = slim_sets.join(by_rep, (F.col("rep") == F.col("of_rep")) & (F.col("n") > 0), "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("label", "id").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` that are the least document of their component, all columns, whatever their names.

    Rows with null ids and with texts without words stay; of repeated rows
    (same id and text) one does.  Texts of any length are compared whole; an
    empty table gives an empty result.
    """
    found = ngram_components(docs, id_col, text_col, **settings)
    one, rows = unused(docs.columns, "_id", "_rows")
    same = F.col(id_col).isNull() | (F.col(id_col) == F.col("component_id"))
    kept = written(found.where(same).groupBy(F.col(id_col).alias(one)).agg(F.count("*").alias(rows)), "kept")
    few = kept.count() <= BROADCAST_IDS
    out = docs.join(F.broadcast(kept) if few else kept, docs[id_col].eqNullSafe(F.col(one)))
    once = out.where(F.col(rows) == 1).drop(one, rows)
    if kept.where(F.col(rows) > 1).isEmpty():
        return once
    return once.unionByName(out.where(F.col(rows) > 1).drop(one, rows).dropDuplicates([id_col, text_col]))
