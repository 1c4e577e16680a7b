"""N-gram Jaccard join with a token-group matrix.

A document is the set of its word n-grams (normal form: lower case, letters and digits), the tokens. The join finds all
pairs of documents whose sets have a Jaccard similarity of at least a threshold:

1. One pass over the text hashes each document's n-grams to a set; documents with equal sets
   (exact copies) collapse to one set, so a group of thousands of copies costs as much as one document from here on.
2. Sets are partitioned into *bins* of similar ones. Two sets that have two of their ``KEYS`` smallest hashes in
   common share a cell, and the cell of a set that most others share is its home bin. A set also visits the bins that are home
   to sets it shares a cell with, each once. Only numbers are shuffled for this, no tokens.
3. A bin sorts its residents into groups of ``GROUP`` similar sets. The token-group matrix holds the union of each group's whole
   token sets, hashed to 16 bits; the number of a query's tokens whose hash is in a union bounds the overlap with every member of
   the group from above. Groups whose bound reaches the overlap that the sizes ask for are opened, and the query's
   exact overlap with each member is counted. Each pair is compared in one bin only.
4. Bins of more than ``BIN`` residents are cut into blocks; what visits a bin visits all its blocks, and residents the blocks before
   their own. So no task holds more than a block and what is compared with it, which streams by.
5. Texts are never shuffled, and blocks are opened in slices: for each slice the texts are read again, where its sets go (a narrow table
   within the bound of a broadcast) is joined to them, and only their token sets are shuffled, once. A slice's shuffle files go before the next begins,
   so disk holds one of ``SLICES`` parts of what is compared, however often sets visit blocks.

Recall. The bound never loses a pair; only step 2 can. Of the KEYS smallest hashes of the union of two sets, each
lies in both with the chance of their similarity j, and two must: the loss is (1 - j) ** KEYS + KEYS * j * (1 - j) ** (KEYS - 1),
1.1 % at j = 0.5, 0.2 % at 0.6. It depends on neither the size of the table nor on how many sets share a token. Sets of at most KEYS
tokens lose nothing: all their tokens are keys, and pairs with a single common token (of sets of one and of two tokens, at 0.5)
are joined by that token. Every row is a query; no list of partners or candidates is capped.

classes() gives a row for each document instead of a row for each pair: its class (what a chain of pairs connects) and its number of links
(the pairs that it is in). Every block adds up the links of its sets and sends a star for each of its components, so a class of
many documents costs as many rows, not their square; the links add up to twice the pairs of jaccard_join. Near copies of one text aren't opened
group by group there: a lower bound settles most of their pairs in sums, a product of matrices counts the others (bin_links); both are exact.

Defined results. Null or empty text, or text without letters or digits: no n-grams, no partner (in classes() a class of its own).
A text of fewer than n words is one gram of all its words; a very long one is a large set like any other. Repeated rows of one doc_id and text count
once. In jaccard_join a null doc_id can't be named in a pair and is left out, and a doc_id with different texts takes part with each of them, so a pair
of documents has a row for each pair of their sets, and is never paired with itself. classes() and drop_near_copies judge every row by its own text, whatever its
doc_id: a doc_id's different texts are a document each and may be linked. A class is named by its least doc_id that isn't null (null if it has
none; where doc_ids repeat, unlike texts may bear one name). Ties can't arise: a pair reaches the threshold or not. Only ``doc_id`` and ``text`` are
read; other columns may have any name. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import _text as T
from ._spark import BROADCAST_BYTES, COLUMN_BYTES, ROW_BYTES, durable, only, release, row_key, sweep, without
from .components import groups, roots, unite

N, THRESHOLD = 3, 0.5
#: Smallest hashes of a set, two of which make a cell; sets in a group of the token-group matrix; residents in a block of a bin;
#: tokens, and entries of a matrix, that are handled at once; tokens of visitors that a block's residents meet at once.
KEYS, GROUP, BIN, TOKENS, ENTRIES, MEET = 10, 16, 2048, 1_000_000, 32_000_000, 8_000_000
#: Columns of the matrix of near copies at most: tokens that at least OFTEN of a block's residents have.
COLUMNS, OFTEN = 2048, 8
#: Bytes of token sets in a slice, unless that makes more than so many slices (more only where the table of visits asks for it).
SLICE_BYTES, SLICES = 1_000_000_000, 8


def set_hash(grams: np.ndarray) -> int:
    """Hash of a whole set, whatever its order."""
    with np.errstate(over="ignore"):
        return np.add.reduce(grams * T.U64(0xD6E8FEB86659FD93) ^ (grams >> T.U64(29)))


def signatures(n: int):
    """Of each text: the number of its n-grams, a hash of the whole set (of a text without n-grams, its row), the smallest hashes."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, offsets = T.words(batch["text"])
        row = batch["row"].to_numpy()
        sizes, wholes, keys = [], [], []
        for k in range(batch.num_rows):
            s = T.gram_set(hashes[offsets[k] : offsets[k + 1]], n)
            sizes.append(len(s))
            wholes.append(set_hash(s) if len(s) else row[k].view(T.U64))
            keys.append(s[:KEYS])
        at = np.cumsum([0, *map(len, keys)])
        flat = np.concatenate([*keys, np.zeros(0, T.U64)])
        return pa.record_batch(
            [batch["doc_id"], batch["row"], pa.array(sizes, pa.int32()), pa.array(T.signed(np.array(wholes, T.U64)), pa.int64()), T.ragged(T.signed(flat), at, pa.int64())],
            ["doc_id", "row", "size", "whole", "keys"],
        )

    return T.per_slice(fn)


def gram_sets(n: int):
    """Of each text: its whole n-gram set, beside the number of its documents and its visits."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, offsets = T.words(batch["text"])
        sets = [T.gram_set(hashes[a:b], n) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        at = np.cumsum([0, *map(len, sets)])
        flat = np.concatenate([*sets, np.zeros(0, T.U64)])
        wholes = T.signed(np.array([set_hash(s) for s in sets], T.U64))
        return pa.record_batch([batch["n"], batch["visits"], pa.array(wholes, pa.int64()), T.ragged(T.signed(flat), at, pa.int64())], ["n", "visits", "whole", "grams"])

    return T.per_slice(fn)


def needed(a: np.ndarray, b: np.ndarray | int, threshold: float) -> np.ndarray:
    """Least overlap of two sets of these sizes at this Jaccard similarity."""
    return np.ceil(threshold / (1 + threshold) * (a + b) - 1e-9)


def parts(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``most`` tokens, or of one row."""
    a = 0
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        yield a, b
        a = b


def hits(table: np.ndarray, place: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of the table's rows at the places of each row's tokens."""
    return np.add.reduceat(table[place], offsets[:-1] - offsets[0], axis=0, dtype=np.int32)


def in_order(flat: np.ndarray, offsets: np.ndarray, mine: np.ndarray) -> np.ndarray:
    """Similar sets beside each other: they have the same smallest tokens."""
    second = np.minimum(offsets[mine] + 1, offsets[mine + 1] - 1)
    return mine[np.lexsort((flat[second], flat[offsets[mine]]))]


def askers(size: np.ndarray, mine: np.ndarray, rank: np.ndarray, starts: np.ndarray, ends: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Which sets are queries to which groups: those of similar sizes that are visitors or have members after them. And the least size of a
    member that counts for them."""
    smallest, largest = np.minimum.reduceat(size[mine], starts), np.maximum.reduceat(size[mine], starts)
    low = np.maximum(smallest, np.ceil(size[:, None] * threshold - 1e-9))
    return (low <= np.minimum(largest, np.floor(size[:, None] / threshold + 1e-9))) & (rank[:, None] < ends - 1), low


def opened(flat: np.ndarray, offsets: np.ndarray, mine: np.ndarray, rank: np.ndarray, starts: np.ndarray, ends: np.ndarray, can: np.ndarray, low: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By the token-group matrix: the pairs of queries and members among those that may be (``can``), and their similarities."""
    size = np.diff(offsets).astype(np.float64)
    ask = np.flatnonzero(can.any(axis=1))
    if len(starts) > 1 and len(ask):
        bucket = (flat >> T.U64(48)).astype(np.int64)
        tokens = bucket if len(ask) == len(size) else bucket[np.repeat(can.any(axis=1), np.diff(offsets))]
        at = np.cumsum(np.append(0, np.diff(offsets)[ask]))
        wanted = np.flatnonzero(can.any(axis=0))
        width = max(1, min(len(wanted), ENTRIES >> 16))
        for g0 in range(0, len(wanted), width):
            gs = wanted[g0 : g0 + width]
            union = np.zeros((1 << 16, len(gs)), np.uint8)
            for c, g in enumerate(gs):
                for k in mine[starts[g] : ends[g]]:
                    union[bucket[offsets[k] : offsets[k + 1]], c] = 1
            for a, b in parts(at, max(1, ENTRIES // len(gs))):
                bound = hits(union, tokens[at[a] : at[b]], at[a : b + 1])
                here = np.ix_(ask[a:b], gs)
                can[here] &= bound >= needed(size[ask[a:b], None], low[here], threshold)
    for g in np.flatnonzero(can.any(axis=0)):
        members = mine[starts[g] : ends[g]]
        each = [flat[offsets[k] : offsets[k + 1]] for k in members]
        tokens = np.unique(np.concatenate(each))
        table = np.zeros((len(tokens) + 1, len(members)), np.uint8)  # the last row: tokens that the group hasn't
        for k, x in enumerate(each):
            table[np.searchsorted(tokens, x), k] = 1
        queries = np.flatnonzero(can[:, g])
        at = np.cumsum(np.append(0, np.diff(offsets)[queries]))
        for a, b in parts(at, TOKENS):
            theirs = np.concatenate([flat[offsets[q] : offsets[q + 1]] for q in queries[a:b]])
            place = np.searchsorted(tokens, theirs)
            place[tokens[np.minimum(place, len(tokens) - 1)] != theirs] = len(tokens)
            both = hits(table, place, at[a : b + 1])
            sim = both / (size[queries[a:b], None] + size[members] - both)
            i, j = np.nonzero((sim >= threshold) & (rank[queries[a:b], None] < rank[members]))
            yield queries[a + i], members[j], sim[i, j]


def grouped(m: int, mine: np.ndarray, k: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rank of each of m sets among the residents (-1 for visitors), and where groups of residents start and end; the first k have groups of their own."""
    rank = np.full(m, -1)
    rank[mine] = np.arange(len(mine))
    starts = np.concatenate([np.arange(0, k, GROUP), np.arange(k, len(mine), GROUP)])
    return rank, starts, np.append(starts[1:], len(mine))


def bin_pairs(flat: np.ndarray, offsets: np.ndarray, resident: np.ndarray, threshold: float, first: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a resident with another set of the bin, and their similarities, by the token-group matrix. Sets are sorted
    token hashes, all of them in ``flat``. Unless it is the first time that these residents come, only pairs with visitors."""
    mine = in_order(flat, offsets, np.flatnonzero(resident))
    rank, starts, ends = grouped(len(offsets) - 1, mine)
    can, low = askers(np.diff(offsets).astype(np.float64), mine, rank, starts, ends, threshold)
    if not first:
        can[mine] = False
    found = list(opened(flat, offsets, mine, rank, starts, ends, can, low, threshold))
    none = np.zeros(0, np.int64)
    left, right, similar = zip(*found, strict=True) if found else ([], [], [])
    return np.concatenate([none, *left]), np.concatenate([none, *right]), np.concatenate([np.zeros(0), *similar])


def consensus(flat: np.ndarray, offsets: np.ndarray, mine: np.ndarray) -> np.ndarray:
    """The tokens that at least half of the residents have."""
    tokens, count = np.unique(np.concatenate([flat[offsets[k] : offsets[k + 1]] for k in mine]), return_counts=True)
    return tokens[2 * count >= len(mine)]


def near_links(flat: np.ndarray, offsets: np.ndarray, n: np.ndarray, margin: np.ndarray, whole: float, mine: np.ndarray, ask: np.ndarray, rank: np.ndarray, threshold: float, links: np.ndarray) -> None:
    """Add to ``links`` what near copies of one text have in each other (see bin_links): residents ``mine``, by falling margin, and queries ``ask``, each a
    query to the residents before it. Those whose margins settle it are the first so many residents, so sums settle them. The overlap of the others is
    counted, by a product of matrices over the tokens that many residents have, and by lists of those that have the other tokens."""
    size, held = np.diff(offsets), np.diff(offsets)[mine]
    ask = ask[np.argsort(-margin[ask], kind="stable")]
    limit = np.where(rank[ask] >= 0, rank[ask], len(mine))
    sure = np.minimum(np.searchsorted(-margin[mine], margin[ask] - whole, side="right"), limit)
    links[ask] += np.cumsum(np.append(0, n[mine]))[sure]
    by = np.zeros(len(mine) + 1, np.int64)
    np.add.at(by, sure, n[ask])
    links[mine] += by[::-1].cumsum()[::-1][1:]
    some = sure < limit
    ask, sure, limit = ask[some], sure[some], limit[some]
    if not len(ask):
        return
    tokens, place, count = np.unique(np.concatenate([flat[offsets[k] : offsets[k + 1]] for k in mine]), return_inverse=True, return_counts=True)
    holder = np.repeat(np.arange(len(mine)), held)
    often = np.argsort(-count, kind="stable")[:COLUMNS]
    often = often[count[often] >= OFTEN]
    column = np.full(len(tokens), -1)
    column[often] = np.arange(len(often))
    table = np.zeros((len(mine), len(often)), np.float32)
    dense = column[place] >= 0
    table[holder[dense], column[place[dense]]] = 1
    holder, start = holder[np.argsort(place, kind="stable")], np.cumsum(count) - count
    for a, b in parts(np.cumsum(np.append(0, size[ask])), TOKENS // 4):
        q, c0, c1 = ask[a:b], int(sure[a:b].min()), int(limit[a:b].max())
        theirs = np.concatenate([flat[offsets[k] : offsets[k + 1]] for k in q])
        row, place = np.repeat(np.arange(b - a), size[q]), np.minimum(np.searchsorted(tokens, theirs), len(tokens) - 1)
        known = tokens[place] == theirs
        row, place = row[known], place[known]
        dense = column[place] >= 0
        mask = np.zeros((b - a, len(often)), np.float32)
        mask[row[dense], column[place[dense]]] = 1
        both = (mask @ table[c0:c1].T).astype(np.float64)
        row, place = row[~dense], place[~dense]
        for x, y in parts(np.cumsum(np.append(0, count[place])), MEET // 2):
            k = count[place[x:y]]
            h = holder[np.repeat(start[place[x:y]] - np.cumsum(k) + k, k) + np.arange(k.sum())]
            here = (h >= c0) & (h < c1)
            np.add.at(both, (np.repeat(row[x:y], k)[here], h[here] - c0), 1)
        at = np.arange(c0, c1)
        hit = (both / (size[q, None] + held[c0:c1] - both) >= threshold) & (at >= sure[a:b, None]) & (at < limit[a:b, None])
        links[q] += hit @ n[mine[c0:c1]]
        links[mine[c0:c1]] += n[q] @ hit


def bin_links(flat: np.ndarray, offsets: np.ndarray, resident: np.ndarray, n: np.ndarray, threshold: float, first: bool = True, count: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """What the pairs of bin_pairs with two common tokens or more add up to: of each set, the root of its component, and the sum of ``n`` over its
    partners (without ``count`` only components are right).

    Near copies of one text needn't be compared one by one. Two sets with c and d of the tokens of any set P have at least c + d - |P| in common, so
    with margins v = c - t / (1 + t) * size they reach t for certain where their margins add up to |P|. P is what the residents agree on. What
    reaches t with the set of the greatest margin for certain is one component; near_links adds up its links. All other pairs are left to the groups."""
    m, size, mine = len(offsets) - 1, np.diff(offsets).astype(np.float64), in_order(flat, offsets, np.flatnonzero(resident))
    parent, links, near = np.arange(m), np.zeros(m, np.int64), np.zeros(m, bool)
    if len(mine) > GROUP and len(p := consensus(flat, offsets, mine)):
        has = p[np.minimum(np.searchsorted(p, flat), len(p) - 1)] == flat
        share = threshold / (1 + threshold)
        # Such sizes at least, so that what is settled has two common tokens; a little more than |P|, so that rounding settles nothing.
        margin = np.where(size >= 1 / share, np.add.reduceat(has, offsets[:-1], dtype=np.int64) - share * size, -np.inf)
        whole, best = len(p) + 1e-6, int(np.argmax(margin))
        near = margin + margin[best] >= whole
        unite(parent, np.flatnonzero(near), np.full(int(near.sum()), best))
        inner = mine[near[mine]]
        mine = np.concatenate([inner[np.argsort(-margin[inner], kind="stable")], mine[~near[mine]]])
    k = int(near[mine].sum())
    rank, starts, ends = grouped(m, mine, k)
    if count and k:
        near_links(flat, offsets, n, margin, whole, mine[:k], np.flatnonzero(near if first else near & ~resident), rank, threshold, links)
    can, low = askers(size, mine, rank, starts, ends, threshold)
    if not first:
        can[mine] = False
    can[np.ix_(near, ends <= k)] = False
    for i, j, sim in opened(flat, offsets, mine, rank, starts, ends, can, low, threshold):
        more = sim * (size[i] + size[j]) / (1 + sim) > 1.5
        i, j = i[more], j[more]
        unite(parent, i, j)
        np.add.at(links, i, n[j])
        np.add.at(links, j, n[i])
    return roots(parent, np.arange(m)), links


def open_bins(threshold: float, stars: bool, count: bool = True):
    """For ``mapInArrow`` over rows sorted by bin and block, residents first: the pairs of every block. With stars: of every set that has
    a partner in the block, another of its component there (or itself), and the number of documents that its partners have (without ``count``
    some number). Pairs of a single common token are left to by_one_token."""

    def met(held: list[tuple], last: int | None) -> tuple:
        """whole, resident, n, offsets, flat of what is held; without repeated rows, also of the last one before."""
        whole, resident, n, sizes, flat = (np.concatenate(x) for x in zip(*held, strict=True))
        keep = np.append(True, whole[1:] != whole[:-1])
        if last is not None:
            keep &= resident | (whole != last)
        if not keep.all():
            flat = flat[np.repeat(keep, sizes)]
            whole, resident, n, sizes = whole[keep], resident[keep], n[keep], sizes[keep]
        return whole, resident, n, np.concatenate([[0], np.cumsum(sizes)]), flat

    def pairs(now: tuple, first: bool) -> Iterator[pa.RecordBatch]:
        whole, resident, n, offsets, flat = now
        if len(whole) < 2 or not resident.any():
            return
        if stars:
            root, links = bin_links(flat, offsets, resident, n, threshold, first, count)
            k = np.flatnonzero((links > 0) | (root != np.arange(len(whole))))
            if len(k):
                yield pa.record_batch([pa.array(whole[k]), pa.array(whole[root[k]]), pa.array(links[k])], ["a", "b", "links"])
            return
        i, j, sim = bin_pairs(flat, offsets, resident, threshold, first)
        size = np.diff(offsets)
        more = sim * (size[i] + size[j]) / (1 + sim) > 1.5
        i, j, sim = i[more], j[more], sim[more]
        if len(i):
            yield pa.record_batch([pa.array(whole[i]), pa.array(whole[j]), pa.array(sim)], ["a", "b", "jaccard"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now, first, tokens, last = None, True, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch["home"].to_numpy(), batch["block"].to_numpy().astype(np.int64)], 1)
            whole, resident, n = batch["whole"].to_numpy(), batch["resident"].to_numpy(zero_copy_only=False), batch["n"].to_numpy()
            lists = batch["grams"]
            flat, at = lists.flatten().to_numpy().view(T.U64), np.asarray(lists.offsets)
            at = at - at[0]
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if (key := tuple(keys[a])) != now:
                    if held:
                        yield from pairs(met(held, last), first)
                    held, now, first, tokens, last = [], key, True, 0, None
                sizes = np.diff(at[a : b + 1])
                held.append((whole[a:b], resident[a:b], n[a:b], sizes, flat[at[a] : at[b]]))
                tokens += int(sizes[~resident[a:b]].sum())
                if tokens > MEET:
                    yield from pairs(here := met(held, last), first)
                    r = int(here[1].sum())  # the residents stay
                    offsets = here[3][: r + 1]
                    last = int(whole[b - 1])
                    held, first, tokens = [(here[0][:r], here[1][:r], here[2][:r], np.diff(offsets), here[4][: offsets[-1]])], False, 0
        if held:
            yield from pairs(met(held, last), first)

    return run


def bins(sets: DataFrame) -> DataFrame:
    """home, block, whole, resident: the blocks that every set is in or visits, without those where it would be alone."""
    token = sets.select("whole", "size", F.explode("keys").alias("token"))
    shared = token.withColumn("n", F.count("*").over(W.partitionBy("token"))).where("n > 1")
    alive = shared.groupBy("whole", "size").agg(F.array_sort(F.collect_list("token")).alias("ts")).where(F.size("ts") > 1)
    two = F.flatten(F.transform("ts", lambda x, i: F.transform(F.slice("ts", i + 2, KEYS), lambda y: F.xxhash64(x, y))))
    cell = alive.select("whole", "size", F.explode(two).alias("cell")).withColumn("n", F.count("*").over(W.partitionBy("cell"))).where("n > 1")
    cells = F.array_sort(F.collect_list(F.struct("n", "cell")))
    homes = durable(cell.groupBy("whole", "size").agg(cells.alias("cs")).select("whole", "size", F.element_at("cs", -1)["cell"].alias("home"), F.col("cs.cell").alias("cells")), "homes")
    sweep(sets.sparkSession)
    # Of two sets with different homes, the one with the greater home visits the other's.
    at = homes.select("whole", "home", F.explode("cells").alias("cell"))
    others = at.groupBy("cell").agg(F.collect_set("home").alias("hs")).where(F.size("hs") > 1)
    visits = at.join(others, "cell").select("whole", F.explode(F.filter("hs", lambda h: h < F.col("home"))).alias("home")).distinct()
    place = F.row_number().over(W.partitionBy("home").orderBy("size", "whole")) - 1
    residents = homes.select("home", "whole", "size").withColumn("block", F.floor(place / BIN).cast("int"))
    tops = residents.where("block > 0").groupBy("home").agg(F.max("block").alias("top"))
    visitors = visits.join(tops, "home", "left").select("home", F.explode(F.sequence(F.lit(0), F.coalesce("top", F.lit(0)))).alias("block"), "whole", F.lit(False).alias("resident"))
    earlier = residents.where("block > 0").select("home", F.explode(F.sequence(F.lit(0), F.col("block") - 1)).alias("block"), "whole", F.lit(False).alias("resident"))
    every = residents.select("home", "block", "whole", F.lit(True).alias("resident")).unionByName(earlier).unionByName(visitors)
    out = durable(every.withColumn("n", F.count("*").over(W.partitionBy("home", "block"))).where("n > 1").drop("n"), "bins")
    release(homes)
    sweep(sets.sparkSession)
    return out


def by_one_token(sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs of small sets that reach the threshold with a single common token: joined by it and by their sizes. n_a and n_b: the number of
    documents of each."""
    most = int(1 / threshold + 1e-9)
    small = sets.where(F.size("keys") <= most).select("whole", "size", "n", "keys", F.explode("keys").alias("token"))
    want = small.select("token", F.col("whole").alias("a"), F.col("size").alias("size_a"), F.col("n").alias("n_a"), F.col("keys").alias("keys_a"), F.explode(F.when(2 * F.col("size") <= most + 1, F.sequence("size", most + 1 - F.col("size")))).alias("size"))
    pairs = want.join(small.withColumnsRenamed({"whole": "b", "n": "n_b"}), ["token", "size"]).where((F.size(F.array_intersect("keys_a", "keys")) == 1) & ((F.col("size_a") < F.col("size")) | (F.col("a") < F.col("b"))))
    return pairs.select("a", "b", (F.lit(1.0) / (F.col("size_a") + F.col("size") - 1)).alias("jaccard"), "n_a", "n_b")


def slices(visits: int, tokens: int) -> int:
    """In how many slices so many visits, of sets of so many tokens altogether, are made."""
    narrow = -(-visits * (ROW_BYTES + 5 * COLUMN_BYTES) // BROADCAST_BYTES)
    return max(1, narrow, min(SLICES, -(-8 * tokens // SLICE_BYTES)))


def similar_sets(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, stars: bool = False, count: bool = True) -> tuple[DataFrame, DataFrame]:
    """(sets, pairs). Sets: ``whole``, the number of the set, and ``docs``, the documents (row_key, doc_id) that have it. Pairs: the numbers a and b of
    two different sets, and their Jaccard similarity; with ``stars`` only as many (a, b) as connect what is similar, b = a included,
    and ``links``, parts of the number of documents with sets similar to a (without ``count`` no such number). Both are durable."""
    if not 1 / KEYS <= threshold <= 1:
        raise ValueError(f"the threshold must lie between {1 / KEYS} and 1")
    spark = docs.sparkSession
    docs = only(docs, doc_id="long", text="string").withColumn("row", row_key())
    signed = docs.mapInArrow(signatures(n), "doc_id long, row long, size int, whole long, keys array<long>").groupBy("whole", "size")
    # A doc_id with several texts may have several sets: a set is known by its own number.
    signed = durable(signed.agg(F.collect_set(F.struct("row", "doc_id")).alias("docs"), F.first("keys").alias("keys")), "sets")
    sweep(spark)
    sets = signed.select("whole", "size", F.size("docs").cast("long").alias("n"), "keys")
    by_one = by_one_token(sets, threshold)
    if stars:
        by_one = by_one.select(F.explode(F.array(F.struct("a", "b", F.col("n_b").alias("links")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("n_a").alias("links")))).alias("x")).select("x.*")
    near = [durable(by_one.select("a", "b", "links" if stars else "jaccard"), "near")]
    one = signed.select("whole", "size", F.size("docs").cast("long").alias("n"), F.array_min("docs")["row"].alias("row"))
    visits = bins(sets)
    where = durable(visits.join(one, "whole").select("row", "size", "n", "home", "block", "resident", F.xxhash64("home", "block").alias("part")), "visits")
    release(visits)
    rows, tokens = where.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    parts = slices(rows, tokens)
    for k in range(parts if rows else 0):
        mine = where.where(F.pmod("part", F.lit(parts)) == k).groupBy("row", "n").agg(F.collect_list(F.struct("home", "block", "resident")).alias("visits"))
        mine = durable(mine, "slice")
        texts = docs.select("row", "text").join(F.broadcast(mine), "row").select("text", "n", "visits")
        grams = texts.mapInArrow(gram_sets(n), "n long, visits array<struct<home: long, block: int, resident: boolean>>, whole long, grams array<long>")
        grams = grams.select("whole", "n", "grams", F.inline("visits")).repartition("home", "block").sortWithinPartitions("home", "block", F.desc("resident"), "whole")
        near.append(durable(grams.mapInArrow(open_bins(threshold, stars, count), "a long, b long, " + ("links long" if stars else "jaccard double")), "near"))
        release(mine)
        sweep(spark)
    release(where)
    out = near[0]
    for more in near[1:]:
        out = out.unionByName(more)
    return signed.select("whole", "docs"), out


def jaccard_join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """doc_a < doc_b, jaccard: all pairs of documents of at least this similarity, exact copies (1.0) included."""
    sets, near = similar_sets(docs.where("doc_id is not null"), n, threshold)
    named = sets.select("whole", F.array_sort(F.array_distinct("docs.doc_id")).alias("docs"))
    twins = named.where(F.size("docs") > 1).select("docs", F.posexplode("docs").alias("k", "doc_a"))
    twins = twins.select("doc_a", F.explode(F.slice("docs", F.col("k") + 2, F.size("docs"))).alias("doc_b"), F.lit(1.0).alias("jaccard"))
    side = lambda c: named.select(F.col("whole").alias(c), F.col("docs").alias(f"docs_{c}"))
    cross = near.join(side("a"), "a").join(side("b"), "b").select("jaccard", F.explode("docs_a").alias("x"), "docs_b").select("jaccard", "x", F.explode("docs_b").alias("y"))
    cross = cross.where("x <> y").select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"), "jaccard")
    return twins.unionByName(cross)


def classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, links of every document (a doc_id and a text): the least doc_id of those that a chain of pairs of at least this similarity
    connects with it, and the number of documents that reach it with this one, exact copies included."""
    sets, near = similar_sets(docs, n, threshold, stars=True)
    label = groups(near.select("a", "b")).withColumnRenamed("node", "whole")
    links = near.groupBy(F.col("a").alias("whole")).agg(F.sum("links").alias("links"))
    named = sets.select("whole", F.array_min(F.filter("docs.doc_id", lambda x: x.isNotNull())).alias("least"), "docs")
    named = named.join(links, "whole", "left").join(label, "whole", "left").withColumn("label", F.coalesce("label", "whole"))
    named = durable(named, "named")
    least = named.groupBy("label").agg(F.min("least").alias("class_id"))
    sweep(docs.sparkSession)
    return named.join(least, "label").select(F.explode("docs.doc_id").alias("doc_id"), "class_id", (F.coalesce("links", F.lit(0)) + F.size("docs") - 1).alias("links"))


def copies(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """row_key of the rows that a group can spare: of every group that the pairs connect, the document with the least doc_id stays
    (a null one only where there is no other; then the least row_key)."""
    sets, near = similar_sets(docs, n, threshold, stars=True, count=False)
    label = groups(near.select("a", "b"))
    row = sets.join(label, sets.whole == label.node, "left").select(F.coalesce("label", "whole").alias("label"), F.explode("docs").alias("d"))
    row = row.select("label", F.struct(F.col("d.doc_id").isNull().alias("unnamed"), "d.doc_id", "d.row").alias("d"))
    least = row.groupBy("label").agg(F.min("d").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    return durable(row.join(least, "label").where("d <> least").select("d.row").distinct(), "copies")


def drop_near_copies(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` without those of copies(). Rows with the same doc_id and the same text are one document: they stay or go together.
    Rows without n-grams (null or empty texts) stay. All columns are kept."""
    return without(docs, copies(docs, n, threshold))
