"""N-gram Jaccard join by a token-group matrix (op 2).

Two documents link when the Jaccard similarity of their shingle sets is at
least ``percent`` / 100. The result is exact: one row a document with its
component. No pairs are made inside groups of copies:

1. Equal sets are one node (a 64-bit hash of the set), whatever their number.
2. Grouping: nodes with a common min-hash and alike bottom sketches are compared
   with a leader (several where many nodes meet); those that link form groups.
   Inside a group all is settled, so from here on a group counts as one.
3. Token-group matrix: each token (shingle) has the groups that contain it, i.e.
   each group's token union is stored by token. For a query node Q and a group G
   the number of Q's tokens in G's union bounds the overlap of Q with any member:
   a linked member has at least ceil(percent * |Q| / 100) of Q's tokens. The
   matrix holds the tokens of a fixed zone of the hash range, and tokens of more
   than ``WIDE`` groups are only counted; at most
   floor((100 - percent) * |Q| / 100) of Q's tokens may be missing, so a member
   shares at least zone(Q) - wide(Q) - missing(Q) of the rest. Groups that reach
   this bound are opened: their members of fitting size are compared exactly.
   A group of one node is bounded by the overlap that this very pair needs; what
   such a bound has settled from one side isn't opened again from the other.
   The first (Z - missing) / 2 of Q's Z zone tokens, in hash order, are its prefix: token
   ranges withhold the common tokens that may lie there. All ranges together withhold no
   more than the prefix has, which is added to what a pair has, so no pair is lost that
   reaches the bound; pairs that share some tokens here and there make no rows. Where all
   of Q's tokens of a range are prefix, its wide tokens there aren't counted either: common
   and wide tokens of such a range are no more than the prefix tokens in it.
   What two groups of one node have in common is the same from either side: such a pair
   has one row, with what both may miss of each other and the shorter of both prefixes.
4. Nodes whose bound is below one (short ones, and those made of wide tokens)
   can only be missed among each other. They go through 3 again with the whole
   hash range; few are left of them, which go on with a growing ``WIDE`` until none
   is left: with no token too wide the bound is positive for every node. As these
   nodes mostly have their wide tokens in common, here each token range judges its
   pairs itself (the more of a node's tokens it has, the fewer pass, so not before few are left),
   so that no row is made for a pair that only shares a passage: a pair that
   links may miss M of Q's tokens, hence in some token range no more than M
   times the share of Q's tokens that lie in it. A pair that has what this asks for
   has one of Q's rarest tokens there: only these look for groups, and what such a
   pair has in all is counted for it alone. Ranges that say nothing about Q make no
   pairs of it.

Full sets are made again from the texts of the nodes that are compared. Tokens
travel in binary blocks, a row for each task and token range. What goes to the
driver are counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldpulse.llm.common import WHITE, discard, shuffle_parts, written
from fieldpulse.llm.graph import components
from fieldpulse.llm.shingles import mixed, shingle_sets

PERCENT = 80
#: Share of the hash range whose tokens make the first matrix, as a numerator of 2 ** 16.
ZONE = 21000
#: Min-hashes for grouping, and tokens of a bottom sketch.
MIN_HASHES, SKETCH = 4, 16
#: Leaders where more than ``CROWD`` nodes have a min-hash in common; else one.
LEADERS, CROWD = 8, 16
#: Groups of a token up to which it makes candidates, in the first matrix.
WIDE = 8
#: Tokens that a task gathers before it writes its blocks, and those meant for a token range.
FLUSH, RANGE_TOKENS = 1_000_000, 1_000_000
#: Pairs of a token range that are counted at once, before they are added to the counts so far.
CHUNK = 2_000_000
#: Cells of an array of counts (nodes x groups); more are counted span by span.
CELLS = 4_000_000
#: Groups of tokens that are looked at at once where whole sets are judged.
PROBES = 1_000_000
#: Tasks that share the nodes of a token range where whole sets are judged, at most.
SHARES = 16
#: Sums of pairs that a task keeps before it passes them on.
MOST_SUMS = 4_000_000
#: Node ids that may be broadcast to fetch their texts; more go through a shuffle.
BROADCAST_IDS = 1_000_000


def _binary(x: np.ndarray) -> bytes:
    return x.astype("<u8").tobytes()


def _tokens(x: bytes) -> np.ndarray:
    return np.frombuffer(x, "<u8")


def node_of(own: np.ndarray) -> int:
    """64-bit id of a set: a random sum over its members and their number."""
    total = np.sum(mixed(own ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)
    return int(mixed(np.array([total + np.uint64(len(own))]))[0].view(np.int64))


def document_sets(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, node (null without shingles), n, min-hashes, sketch, zone tokens and their number of every row."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            nodes, sizes, mins, sketches, zones = [], [], [], [], []
            top = np.uint64(ZONE << 48)
            for own in shingle_sets(part["text"].tolist()):
                nodes.append(node_of(own) if len(own) else None)
                sizes.append(len(own))
                mins.append([int(mixed(own + np.uint64(k + 1)).min().view(np.int64)) for k in range(MIN_HASHES)] if len(own) else [])
                sketches.append(_binary(own[:SKETCH]))
                zones.append(_binary(own[:np.searchsorted(own, top)]))
            yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "text_hash": part["text_hash"], "node": pd.array(nodes, "Int64"), "n": sizes, "mins": mins, "sketch": sketches, "zone": zones, "z": [len(x) // 8 for x in zones]})

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    return rows.mapInPandas(run, "doc_id long, text_hash long, node long, n long, mins array<long>, sketch binary, zone binary, z long")


def _fits(a, b):
    """Whether sets of these sizes can link."""
    return (F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT)


def _alike(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) whose bottom sketches (sa, sb) share half of their common bottom."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            keep = []
            for x, y in zip(part["sa"], part["sb"]):
                x, y = _tokens(x), _tokens(y)
                bottom = np.union1d(x, y)[:min(len(x), len(y))]
                keep.append(2 * np.isin(bottom, np.intersect1d(x, y, assume_unique=True)).sum() >= len(bottom))
            yield part.loc[keep, ["a", "b"]]

    return pairs.mapInPandas(run, "a long, b long")


def _fetch(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, set) of the wanted nodes (distinct), made from the text of each node's first document."""
    ids = written(nodes.join(wanted, "node").select("node", F.col("doc_id").alias("_doc")), "ids")
    few = ids.count() <= BROADCAST_IDS

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            # another document with this doc_id may have another text: then its set is another node
            rows = [(k, _binary(own)) for k, own in zip(part["node"].tolist(), shingle_sets(part["text"].tolist())) if len(own) and node_of(own) == k]
            yield pd.DataFrame(rows, columns=["node", "set"])

    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = texts.join(F.broadcast(ids) if few else ids, F.col("_id").eqNullSafe(F.col("_doc"))).select("node", "text")
    # repeated rows give a set twice
    out = written(found.mapInPandas(run, "node long, set binary").dropDuplicates(["node"]), "sets")
    discard(ids)
    return out


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that link, by their full sets (which are then discarded)."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            keep = []
            for x, y in zip(part["x"], part["y"]):
                x, y = _tokens(x), _tokens(y)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            yield part.loc[keep, ["a", "b"]]

    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    out = written(both.select("a", "b", "x", "y").mapInPandas(run, "a long, b long"), "links")
    discard(sets)
    return out


def grouping_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b): nodes with leaders of those that have a min-hash in common, if they look alike.

    Leaders are the nodes of least hash, by ``LEADERS`` hashes: they are mostly
    the same ones for all min-hashes of a family.
    """
    keys = nodes.select("node", F.posexplode("mins").alias("k", "m"))
    least = lambda i: F.min_by("node", F.xxhash64("node", F.lit(i)))
    leaders = keys.groupBy("k", "m").agg(F.count(F.lit(1)).alias("many"), *[least(i).alias(f"l{i}") for i in range(LEADERS)]).where("many > 1")
    crowd = F.array_distinct(F.array(*[f"l{i}" for i in range(LEADERS)]))
    leaders = leaders.select("k", "m", F.when(F.col("many") > CROWD, crowd).otherwise(F.array("l0")).alias("leaders"))
    pairs = (keys.join(leaders, ["k", "m"]).select("node", F.explode("leaders").alias("leader")).where("node <> leader")
             .select(F.greatest("node", "leader").alias("a"), F.least("node", "leader").alias("b")).distinct())
    one, other = (nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in "ab")
    return _alike(pairs.join(one, "a").join(other, "b").where(_fits(F.col("na"), F.col("nb"))).select("a", "b", "sa", "sb"))


BLOCK = "part int, node binary, comp binary, size binary, alone binary, zone binary, before binary, held binary, entry binary, token binary, wide binary"
FOUND = "q long, g long, hits long, wide long"


def _blocks(parts: Iterator[pd.DataFrame], ranges: int, top: int, limit: int, whole: bool = False) -> Iterator[pd.DataFrame]:
    """Token-range blocks of rows (node, comp, n, tokens, alone): entries (token, node) by token.

    A block has of each node: size, whether its group has no other node, tokens
    below ``top``, how many of these come before the range and how many lie in it.

    A token that more than ``limit`` groups of this task have is wide for sure:
    it goes on as such, and its nodes get their count here, but for ranges that are
    wholly their prefix (with whole sets: in
    its range, from the tokens that each node holds there), so that no token
    brings more than its groups' nodes up to the limit from a task.
    """
    rows: list[tuple] = []
    size = 0

    def flush() -> pd.DataFrame:
        node = np.array([r[0] for r in rows], np.int64)
        comp = np.array([r[1] for r in rows], np.int64)
        n = np.array([r[2] for r in rows], np.int64)
        zone = np.array([len(r[3]) // 8 for r in rows], np.int64)
        alone = np.array([r[4] for r in rows], np.uint8)
        before = np.zeros(len(rows), np.int64)
        token = np.concatenate([_tokens(r[3]) for r in rows])
        owner = np.repeat(np.arange(len(rows)), [len(r[3]) // 8 for r in rows])
        order = np.lexsort((comp[owner], token))
        token, owner = token[order], owner[order]
        new = np.concatenate([[True], token[1:] != token[:-1]])
        run = np.cumsum(new) - 1
        groups = np.bincount(run[new | np.concatenate([[True], comp[owner][1:] != comp[owner][:-1]])], minlength=run[-1] + 1)
        known = (groups > limit)[run]
        kept_back, many = prefix(zone, _missing(n, np.zeros(len(rows), np.int64))), np.zeros(len(rows), np.int64)
        out = []
        place = lambda t: ((t >> np.uint64(32)) * np.uint64(ranges) // np.uint64(max(1, top >> 32))).astype(np.int64)
        at = place(token)
        for p in np.unique(at).tolist():
            lo, hi = np.searchsorted(at, [p, p + 1])
            mine, entry, held = np.unique(owner[lo:hi], return_inverse=True, return_counts=True)
            keep = ~known[lo:hi]
            many[mine] += np.where(before[mine] + held <= kept_back[mine], 0, np.bincount(entry[~keep], minlength=len(mine)))
            out.append({"part": p, "node": node[mine].tobytes(), "comp": comp[mine].tobytes(), "size": n[mine].astype(np.uint32).tobytes(), "alone": alone[mine].tobytes(),
                        "zone": zone[mine].astype(np.uint32).tobytes(), "before": before[mine].astype(np.uint32).tobytes(), "held": held.astype(np.uint32).tobytes(),
                        "entry": entry[keep].astype(np.uint16 if len(mine) <= 65536 else np.uint32).tobytes(), "token": token[lo:hi][keep].astype(np.uint32).tobytes(),
                        "wide": np.unique(token[lo:hi][~keep]).astype(np.uint32).tobytes()})
            before[mine] += held
        who = np.flatnonzero(many)
        if len(who) and not whole:
            out.append({"part": -1, "node": node[who].tobytes(), "size": many[who].tobytes()})
        return pd.DataFrame(out, columns=["part", "node", "comp", "size", "alone", "zone", "before", "held", "entry", "token", "wide"])

    for part in parts:
        for r in part.itertuples(index=False, name=None):
            if len(r[3]):
                rows.append(r)
                size += len(r[3]) // 8
                if size >= FLUSH:
                    yield flush()
                    rows, size = [], 0
    if rows:
        yield flush()


def _missing(n: np.ndarray, other: np.ndarray) -> np.ndarray:
    """How many tokens a set of ``n`` may miss in a set of at least ``other`` tokens that it links with."""
    least = np.maximum(other, -(-n * PERCENT // 100))
    return n - -(-(n + least) * PERCENT // (100 + PERCENT))


def prefix(zone: np.ndarray, missing: np.ndarray) -> np.ndarray:
    """How many of a set's ``zone`` tokens are its prefix, where a linked set misses up to ``missing`` of them."""
    return np.maximum(zone - missing, 0) // 2


def withheld(prefix: np.ndarray, before: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Common tokens that a range keeps to itself: those of the prefix that lie in it, after ``before`` tokens in earlier ranges."""
    return np.clip(prefix - before, 0, held)


class _Counts:
    """Sums by key below ``cells``: in an array where more hits come than that has cells, else by sorting chunks."""

    def __init__(self, cells: int, coming: int) -> None:
        self.array = np.zeros(cells) if cells <= min(CELLS, coming) else None
        self.keys, self.hits, self.waiting = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0

    def add(self, keys: np.ndarray, hits: np.ndarray) -> None:
        self.keys.append(keys)
        self.hits.append(hits)
        self.waiting += len(keys)
        if self.waiting >= max(CHUNK, len(self.keys[0])):
            self._sum()

    def _sum(self) -> None:
        keys, hits = np.concatenate(self.keys), np.concatenate(self.hits)
        self.keys, self.hits, self.waiting = [keys[:0]], [hits[:0]], 0
        if self.array is not None:
            self.array += np.bincount(keys, weights=hits, minlength=len(self.array))
        else:
            found, at = np.unique(keys, return_inverse=True)
            self.keys, self.hits = [found], [np.bincount(at, weights=hits, minlength=len(found)).astype(np.int64)]

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        self._sum()
        if self.array is None:
            return self.keys[0], self.hits[0]
        keys = np.flatnonzero(self.array)
        return keys, self.array[keys].astype(np.int64)


def _shares(steps: np.ndarray, which: np.ndarray, groups: int) -> list[tuple[int, int]]:
    """Spans of nodes (indexes ``which``) to be counted one after the other: several where an array serves them best."""
    nodes = int(which.max()) + 1
    if int(steps.sum()) < nodes * groups:
        return [(0, nodes)]
    width = max(1, CELLS // groups)
    return [(k, min(nodes, k + width)) for k in range(0, nodes, width)]


def _judged(which: np.ndarray, run: np.ndarray, weight: np.ndarray, begin: np.ndarray, end: np.ndarray, key: np.ndarray, fits, need: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(q, g, hits) of the pairs with at least ``need`` hits (nodes that need none have no pairs).

    Entries: node (``which``), token (``run``), hits that it counts for and the
    span of the token's groups, ``begin`` to ``end`` in the ascending ``key`` (run * groups + group).
    ``fits(entries, spots)``: whether these groups of the token are others, and of fitting size.
    """
    width = end - begin
    order = np.lexsort((width, which))
    own = which[order]
    first = np.searchsorted(own, np.arange(len(need) + 1))
    upto = np.concatenate([[0], np.cumsum(weight[order])])
    # hits of an entry and those behind it, which have commoner tokens; the last ones alone don't make what is needed
    rest = upto[first[own + 1]] - upto[:-1]
    probes = order[(need[own] > 0) & (rest >= need[own])]
    share = np.cumsum(width[probes]) // PROBES
    found, carried = [(np.zeros(0, np.int64),) * 3], np.zeros(0, np.int64)
    for a, b in zip(*_edges(share)):
        e = probes[a:b]
        entry = np.repeat(e, width[e])
        spot = np.arange(len(entry)) - np.repeat(np.cumsum(width[e]) - width[e], width[e]) + begin[entry]
        ok = fits(entry, spot)
        pairs = np.unique(np.concatenate([carried, which[entry[ok]] * np.int64(groups) + key[spot[ok]] % groups]))
        # the last node's pairs wait for its further entries
        last = which[e[-1]] if b < len(probes) and which[probes[b]] == which[e[-1]] else len(need)
        carried, pairs = pairs[pairs // groups >= last], pairs[pairs // groups < last]
        for k in range(0, len(pairs), PROBES):
            q, g = np.divmod(pairs[k:k + PROBES], groups)
            hits, live, at = np.zeros(len(q), np.int64), np.arange(len(q)), first[q]
            while len(live):
                entry = order[at]
                want = run[entry] * np.int64(groups) + g[live]
                spot = np.minimum(np.searchsorted(key, want), len(key) - 1)
                hits[live] += np.where((key[spot] == want) & fits(entry, spot), weight[entry], 0)
                at = at + 1
                more = at < first[q[live] + 1]
                live, at = live[more], at[more]
                may = hits[live] + rest[at] >= need[q[live]]
                live, at = live[may], at[may]
            enough = hits >= need[q]
            found.append((q[enough], g[enough], hits[enough]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _edges(x: np.ndarray) -> tuple[list[int], list[int]]:
    """Begins and ends of the runs of equal values."""
    at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])).tolist() if len(x) else []
    return at, [*at[1:], len(x)][:len(at)]


def _match(blocks: pd.DataFrame, limit: int, whole: bool, share: int = 0, shares: int = 1) -> pd.DataFrame:
    """One token range: (q, g, hits) for each node and other group with a common token, and (q, wide) counts.

    Two groups of one node have one row, that of the greater node.

    With ``whole`` sets only the pairs that this range lets through, and as
    ``wide`` the size of each node about which this range says nothing; of
    the nodes q those of one share, by hash.
    """
    own = lambda column, kind: [np.frombuffer(x, kind) for x in blocks[column]]
    nodes, comps, sizes, tokens = own("node", np.int64), own("comp", np.int64), own("size", np.uint32), own("token", np.uint32)
    entries = [np.frombuffer(x, np.uint16 if len(k) <= 65536 else np.uint32) for x, k in zip(blocks["entry"], nodes)]
    # every node of the range with its size, tokens in the range, and those of them that are not wide
    names, at = np.unique(np.concatenate(nodes), return_inverse=True)
    total, zone, before, held, plain, alone = (np.zeros(len(names), np.int64) for _ in range(6))
    for into, values in ((total, sizes), (zone, own("zone", np.uint32)), (before, own("before", np.uint32)), (held, own("held", np.uint32)), (alone, own("alone", np.uint8)), (plain, [np.bincount(e, minlength=len(k)) for e, k in zip(entries, nodes)])):
        np.maximum.at(into, at, np.concatenate(values).astype(np.int64))
    groups_, at = np.unique(np.concatenate(comps), return_inverse=True)
    smallest = np.full(len(groups_), np.iinfo(np.int64).max)
    np.minimum.at(smallest, at, np.concatenate(sizes).astype(np.int64))

    node, comp, size = (np.concatenate([x[e] for x, e in zip(xs, entries)]) for xs in (nodes, comps, sizes))
    size, token, wide = size.astype(np.int64), np.concatenate(tokens), np.unique(np.concatenate(own("wide", np.uint32)))
    # a token without company is of no use: most are so
    order = np.argsort(token, kind="stable")
    token = token[order]
    same = token[1:] == token[:-1]
    keep = np.concatenate([same, [False]])[:len(token)] | np.concatenate([[False], same])[:len(token)] | np.isin(token, wide)
    order, token = order[keep], token[keep]
    node, comp, size = node[order], comp[order], size[order]
    order = np.lexsort((node, comp, token))
    token, node, comp, size = token[order], node[order], comp[order], size[order]
    again = np.zeros(len(token), bool)
    again[1:] = (token[1:] == token[:-1]) & (node[1:] == node[:-1])
    token, node, comp, size = token[~again], node[~again], comp[~again], size[~again]
    if len(token):
        new = np.concatenate([[True], token[1:] != token[:-1]])
        run = np.cumsum(new) - 1
        group_new = new | np.concatenate([[True], comp[1:] != comp[:-1]])
        groups = np.bincount(run[group_new], minlength=run[-1] + 1)
        is_wide = ((groups > limit) | np.isin(token[new], wide))[run]
        use = ~is_wide & (groups > 1)[run]
    else:
        is_wide = use = np.zeros(0, bool)
    who, many = np.unique(node[is_wide], return_counts=True)
    plain[np.searchsorted(names, who)] -= many
    past = (before + held > prefix(zone, _missing(total, np.zeros(len(names), np.int64))))[np.searchsorted(names, who)]
    who, many = who[past], many[past]
    if whole:
        silent = plain * total <= _missing(total, np.zeros(len(names), np.int64)) * held
        ours = mixed(names.view(np.uint64)) % np.uint64(shares) == share
        who, many = names[silent & ours], total[silent & ours]
    out = [pd.DataFrame({"q": who, "g": 0, "hits": 0, "wide": many})]
    if use.any():
        node, comp, size, run, group = node[use], comp[use], size[use], run[use], (np.cumsum(group_new) - 1)[use]
        # tokens of the same nodes (those of a passage) count as one, as often as they are
        start = np.concatenate([[True], run[1:] != run[:-1]])
        run = np.cumsum(start) - 1
        mark = np.add.reduceat(mixed(node.view(np.uint64)), np.flatnonzero(start)) + np.bincount(run).astype(np.uint64)
        _, one, alike = np.unique(mark, return_index=True, return_counts=True)
        times = np.zeros(len(mark), np.int64)
        times[one] = alike
        stays = (times > 0)[run]
        node, comp, size, run, group = node[stays], comp[stays], size[stays], run[stays], group[stays]
        # every entry with every other group of its token: step over the groups of the run
        edge = np.concatenate([[True], group[1:] != group[:-1]])
        first, index = np.flatnonzero(edge), np.cumsum(edge) - 1
        of_run = run[first]
        lo, hi = np.minimum.reduceat(size, first), np.maximum.reduceat(size, first)
        begin, end = np.searchsorted(of_run, run, "left"), np.searchsorted(of_run, run, "right")
        which, of = np.searchsorted(names, node), np.searchsorted(groups_, comp[first])
        met: list[tuple] = []
        # another group, with a member that has this token and whose size fits
        fits = lambda e, g: (g != index[e]) & (hi[g] * 100 >= size[e] * PERCENT) & (lo[g] * PERCENT <= size[e] * 100)
        if whole:
            need = np.where(ours, plain - _missing(total, np.zeros(len(names), np.int64)) * held // total, 0)
            met.append(_judged(which, run, times[run], begin, end, of_run * np.int64(len(groups_)) + of, fits, need, len(groups_)))
        for lo_q, hi_q in [] if whole else _shares(end - begin, which, len(groups_)):
            ours = np.flatnonzero((which >= lo_q) & (which < hi_q))
            counts = _Counts((hi_q - lo_q) * len(groups_), int((end - begin)[ours].sum()))
            for step in range(int((end - begin)[ours].max(initial=0))):
                ours = ours[begin[ours] + step < end[ours]]
                g = begin[ours] + step
                ok = fits(ours, g)
                entry, g = ours[ok], g[ok]
                counts.add((which[entry] - lo_q) * np.int64(len(groups_)) + of[g], times[run[entry]])
            key, hit = counts.result()
            met.append((lo_q + key // len(groups_), key % len(groups_), hit))
        q, g, hit = (np.concatenate(x) for x in zip(*met))
        if whole:
            through = (plain[q] - hit) * total[q] <= _missing(total[q], smallest[g]) * held[q]
            q, g, hit = q[through], g[through], hit[through]
        else:
            # the node of the other group, where both are groups of one (whose name is the node's)
            other = np.minimum(np.searchsorted(names, groups_[g]), len(names) - 1)
            both = (alone[q] > 0) & (alone[other] > 0) & (names[other] == groups_[g])
            once = ~both | (q > other)
            q, g, hit, other, both = q[once], g[once], hit[once], other[once], both[once]
            keeps = lambda x, y: withheld(prefix(zone[x], _missing(total[x], y)), before[x], held[x])
            back = np.where(both, np.minimum(keeps(q, total[other]), keeps(other, total[q])), keeps(q, np.zeros(len(q), np.int64)))
            hit = hit - back
            q, g, hit = q[hit > 0], g[hit > 0], hit[hit > 0]
        out.append(pd.DataFrame({"q": names[q], "g": groups_[g], "hits": hit, "wide": 0}))
    return pd.concat(out)[["q", "g", "hits", "wide"]].astype("int64")


def matrix(nodes: DataFrame, tokens: DataFrame, top: int, limit: int, whole: bool) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs (a, b) of nodes that reach the bound, and the nodes (node) whose bound says nothing.

    ``nodes``: node, comp, many (nodes of its group), n, z. ``tokens``: node and
    its ``z`` tokens below ``top``. Every node must be in both. With ``whole`` sets
    the token ranges judge the pairs.
    """
    total = nodes.agg(F.sum("z")).first()[0] or 0
    ranges = max(1, min(2 * shuffle_parts(nodes.sparkSession), total // RANGE_TOKENS))
    shares = max(1, min(SHARES, shuffle_parts(nodes.sparkSession) // (2 * ranges))) if whole else 1
    rows = tokens.join(nodes.select("node", "comp", "n", "many"), "node").select("node", "comp", "n", "tokens", F.col("many") == 1)
    blocks = written(rows.mapInPandas(lambda parts: _blocks(parts, ranges, top, limit, whole), BLOCK), "blocks")

    def match(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # the ranges of a task come one after the other; their counts are summed before rows are made
        sums, fresh, waiting, gathered = pd.DataFrame({"q": [], "g": [], "hits": [], "wide": []}).astype("int64"), [], 0, []

        def add(found: pd.DataFrame) -> None:
            nonlocal sums, fresh, waiting
            fresh.append(found)
            waiting += len(found)
            if waiting >= max(CHUNK, len(sums)):
                sums, fresh, waiting = pd.concat([sums, *fresh]).groupby(["q", "g"], as_index=False, sort=False).sum(), [], 0

        for rows in parts:
            for k, range_rows in rows.groupby("part", sort=True):
                if k < 0:
                    add(pd.DataFrame({"q": np.frombuffer(b"".join(range_rows["node"]), np.int64), "g": 0, "hits": 0, "wide": np.frombuffer(b"".join(range_rows["size"]), np.int64)}))
                    continue
                if gathered and gathered[0]["part"].iloc[0] != k:
                    add(_match(pd.concat(gathered), limit, whole, int(gathered[0]["part"].iloc[0]) % shares, shares))
                    gathered = []
                gathered.append(range_rows)
            if len(sums) >= MOST_SUMS:
                # more than a task should hold: these go on as rows, and are summed after the shuffle
                yield sums
                sums = sums.iloc[:0]
        if gathered:
            add(_match(pd.concat(gathered), limit, whole, int(gathered[0]["part"].iloc[0]) % shares, shares))
        yield pd.concat([sums, *fresh]).groupby(["q", "g"], as_index=False, sort=False).sum()

    # a task has several ranges; the tasks' own counts (part -1) are dealt out by row
    tasks = max(1, min(ranges * shares, shuffle_parts(nodes.sparkSession) // 2))
    if shares > 1:
        # few ranges with much work each: every task has a range's tokens, and a share of its nodes to look for
        blocks_of = blocks.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).withColumn("part", F.col("part") * shares + F.col("_share")).drop("_share")
    else:
        blocks_of = blocks
    key = F.when(F.col("part") >= 0, F.col("part")).otherwise(-1 - F.pmod(F.xxhash64("node"), F.lit(ranges)).cast("int"))
    found = written(blocks_of.repartition(tasks, key).sortWithinPartitions("part").mapInPandas(match, FOUND), "found")
    discard(blocks)
    wide = found.where("wide > 0").groupBy(F.col("q").alias("node")).agg(F.sum("wide").alias("w"))

    def need(z, w, missing):
        """What a pair has to have at least, of which the ranges may have withheld the prefix."""
        slack = F.lit(0) if whole else F.greatest(F.floor((z - missing) / 2), F.lit(0))
        return (z - w - missing - slack).cast("long")

    sure = nodes.join(wide, "node", "left").withColumn("w", F.coalesce("w", F.lit(0))).withColumn(
        "need", need(F.col("z"), F.col("w"), F.col("n") - F.ceil(F.col("n") * PERCENT / 100)))
    sure = written(sure.select("node", "comp", "many", "n", "z", "w", "need"), "bound")

    hits = found.where("hits > 0").groupBy("q", "g").agg(F.sum("hits").alias("hits"))
    asked = hits.join(sure.select(F.col("node").alias("q"), *[F.col(c).alias(f"{c}_q") for c in ("many", "n", "z", "w", "need")]), "q")
    members = sure.select(F.col("comp").alias("g"), F.col("node").alias("b"), *[F.col(c).alias(f"{c}_b") for c in ("many", "n", "z", "w", "need")])
    fits, sure_q, sure_b = _fits(F.col("n_q"), F.col("n_b")), F.col("need_q") >= 1, F.col("need_b") >= 1
    alone = (F.col("many_q") == 1) & (F.col("many_b") == 1)
    # the member's own row about a group of one decides better
    settled = (F.col("many_q") == 1) & (F.col("many_b") > 1) & sure_b
    if whole:
        # the ranges have judged; of two rows about groups of one, one is enough
        opened = asked.where(sure_q).join(members, (asked.g == members.g) & fits & ~settled & ~(alone & sure_b & (F.col("q") < F.col("b"))))
    else:
        # a group of one: the overlap that this pair needs, seen from every side of which the bound says something
        overlap = F.ceil((F.col("n_q") + F.col("n_b")) * PERCENT / F.lit(100 + PERCENT))
        reached = lambda x: F.col("hits") >= need(F.col(f"z_{x}"), F.col(f"w_{x}"), F.col(f"n_{x}") - overlap)
        pair = (sure_q | sure_b) & (~sure_q | reached("q")) & (~sure_b | reached("b"))
        least = F.ceil(F.col("n_q") * PERCENT / 100)
        known = F.col("z_q") - F.col("w_q") - F.greatest(F.floor((F.col("z_q") - F.col("n_q") + least) / 2), F.lit(0))
        group = sure_q & ((F.col("many_b") > 1) | (F.col("hits") >= known - F.col("n_q") + overlap))
        # (a row whose own bound says nothing may be that of a pair)
        asked = asked.where((~sure_q & (F.col("many_q") == 1)) | (sure_q & (F.col("hits") >= F.col("need_q"))))
        opened = asked.join(members, (asked.g == members.g) & fits & ~settled & F.when(alone, pair).otherwise(group))
    pairs = opened.select(F.greatest("q", "b").alias("a"), F.least("q", "b").alias("b")).distinct()
    pairs = written(pairs, "pairs")
    discard(found)
    return pairs, sure.where("need < 1").select("node")


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links), class and text_hash of every row of ``docs``.

    ``class`` is the component's own id (null without shingles), ``text_hash`` tells rows of one doc_id apart.

    Null and empty texts, and texts without words, have no shingles and link
    with nothing: their component is their own doc_id. Repeated rows and equal
    texts are one node; rows with one doc_id and different texts are different
    nodes. Null doc_ids never name a component (unless it has no other).
    """
    sets = written(document_sets(docs), "documents", codec="snappy")
    # a node's first document stands for it; null doc_ids only if there is no other
    nodes = written(sets.where("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("z").alias("z"), F.first("mins").alias("mins"), F.first("sketch").alias("sketch")), "nodes")
    ends = lambda p: p.select(F.col("a").alias("node")).union(p.select("b")).distinct()

    pairs = written(grouping_pairs(nodes), "pairs")
    links = _linked(pairs, _fetch(docs, nodes, ends(pairs)))
    comps = written(components(links), "comps")
    sizes = comps.groupBy("comp").agg(F.count(F.lit(1)).alias("many"))
    grouped = nodes.select("node", "doc_id", "n", "z").join(comps.join(sizes, "comp"), "node", "left")
    grouped = written(grouped.withColumns({"comp": F.coalesce("comp", "node"), "many": F.coalesce("many", F.lit(1))}), "grouped")

    every = [comps.where("node <> comp").select(F.col("node").alias("a"), F.col("comp").alias("b"))]
    first = grouped.select("node", F.col("doc_id").alias("_first"))
    tokens = sets.where("node is not null").select("node", "doc_id", F.col("zone").alias("tokens")).join(first, "node").where(
        F.col("doc_id").eqNullSafe(F.col("_first"))).select("node", "tokens")
    part, top, limit, whole = grouped, ZONE << 48, WIDE, False
    while True:
        pairs, unsure = matrix(part, tokens, top, limit, whole)
        if not pairs.isEmpty():
            every.append(_linked(pairs, _fetch(docs, nodes, ends(pairs))))
        unsure = written(unsure, "unsure")
        if unsure.isEmpty():
            break
        part = written(part.join(unsure, "node").withColumn("z", F.col("n")), "rest")
        if top < 1 << 64:
            tokens, top = _fetch(docs, nodes, unsure).withColumnRenamed("set", "tokens"), 1 << 64
        else:
            tokens, limit, whole = tokens.join(unsure, "node"), limit * 8, True

    classes = written(sets.select("doc_id", "text_hash", "node", "n"), "classes")
    discard(sets)
    if len(every) > 1:
        edges = every[0]
        for more in every[1:]:
            edges = edges.union(more)
        comps = written(components(edges), "comps")
    of = nodes.select("node", "doc_id").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = of.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    named = of.join(least, "comp").select("node", "component_id", F.col("comp").alias("class"))
    return classes.select("doc_id", "text_hash", "node", F.col("n").alias("n_shingles")).join(named, "node", "left").select(
        "doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "class", "text_hash")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each class the least doc_id stays, documents without shingles all stay.

    Of rows with that doc_id one stays (the one with the least hash of its text).
    """
    found = written(join(docs), "classes")
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    stay = found.where("class is not null").groupBy("class").agg(F.min(first).alias("s")).select(F.col("s.doc_id").alias("_id"), F.col("s.text_hash").alias("_hash"))
    text_hash = F.xxhash64(F.coalesce("text", F.lit("")))
    # the rows go in a struct, whatever their other columns are called
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").cast("long").alias("_doc"), text_hash.alias("_of"),
                       (F.btrim(F.coalesce("text", F.lit("")), F.lit(WHITE)) == "").alias("_bare"))
    kept = rows.where(~F.col("_bare")).join(stay, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_of") == F.col("_hash")), "left_semi")
    return kept.dropDuplicates(["_doc", "_of"]).select("_row.*").union(rows.where("_bare").select("_row.*"))
