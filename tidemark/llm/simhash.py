"""SimHash near-duplicates with a generalised pigeonhole search.

A document's fingerprint has bit b set if over half of its shingles' 64-bit hashes have it set. Fingerprints that
differ in at most ``most`` bits are linked. The bits are grouped into partitions, correlated bits together; each
partition gets a threshold of its own, and the thresholds add up to ``most - partitions + 1``: two linked
fingerprints then agree within its threshold in at least one partition. Number of partitions and thresholds come from
dynamic programming on the probes and candidates estimated on a sample of fingerprints; they decide the cost, never
the result. Every distinct fingerprint is put at its own key of each partition and probes all keys within the
threshold; whole fingerprints that meet at a key are compared, and only a spanning forest of the links there is kept.
Keys with very many rows are dealt over several tasks in a grid.

For the stricter use on similar texts, longer fingerprints of ``PLANES`` times 64 bits confirm a link; ``near_copies``
takes such links as candidates only, so the forest then holds links themselves, the most similar ones first.

Defined results: words are runs of characters other than ASCII white space, A-Z lower-cased; fewer words than a
shingle has make one shingle; no words (or null) make fingerprint zero, linked like any other; repeated rows and
repeated ids each give a row; a null doc_id is never a component's name while another is in it; an empty table gives
no rows. Other columns are not carried.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import looked_up, settled
from .components import components

SEED = 42
#: 64-bit planes of a long fingerprint, the first being the fingerprint itself.
PLANES = 4
#: Shingles hashed at a time, fingerprints in the planning sample, and rows of one key that a task takes.
STRIDE, SAMPLE, KEY_ROWS = 200_000, 2_048, 40_000
#: Costs of a probe row and of a compared candidate (only their ratio matters), and most probes of a partition.
PROBE_COST, CANDIDATE_COST, MOST_PROBES = 1.0, 0.003, 1_000


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, shingle: int) -> Iterator[np.ndarray]:
    """The 64-bit hashes of a text's shingles, with repeats, some at a time."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return
    whole, sizes = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts, n = ends - sizes, max(1, len(words) - shingle + 1)
    first, last = starts[:n], ends[min(shingle, len(words)) - 1 :]
    hashed = xxhash.xxh64_intdigest
    for at in range(0, n, STRIDE):
        some = [hashed(whole[a:b], SEED) for a, b in zip(first[at : at + STRIDE].tolist(), last[at : at + STRIDE].tolist(), strict=True)]
        yield np.array(some, np.uint64)


def fingerprint_of(hashes: Iterable[np.ndarray], planes: int = 1) -> list[int]:
    """The planes of a fingerprint; hashes of planes after the first are mixed from the shingle's hash."""
    counts, n = np.zeros((planes, 64), np.int64), 0
    for h in hashes:
        n += len(h)
        for p in range(planes):
            x = h if p == 0 else _mixed(h + np.uint64(p * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            counts[p] += np.unpackbits(x.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits((2 * counts > n).astype(np.uint8), axis=1, bitorder="little").view("<u8").reshape(-1).tolist()


def fingerprint(text: str | None, shingle: int, planes: int = 1) -> list[int]:
    return fingerprint_of(shingle_hashes(text, shingle), planes)


def fingerprints(documents: DataFrame, shingle: int, planes: int = 1, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and ``f``: the planes as an array of longs."""

    @F.pandas_udf("array<bigint>")
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([np.array(fingerprint(t, shingle, planes), np.uint64).view(np.int64) for t in texts])

    return documents.select(*keep, made(F.col("text")).alias("f"))


@dataclass(frozen=True)
class Partition:
    bits: tuple[int, ...]
    threshold: int  # -1: not probed

    def masks(self) -> np.ndarray:
        """All differences within the threshold; no difference comes first."""
        width = range(len(self.bits))
        return np.array([sum(1 << b for b in some) for e in range(self.threshold + 1) for some in combinations(width, e)], np.int64)

    def keys(self, f: np.ndarray) -> np.ndarray:
        out = np.zeros(len(f), np.int64)
        for k, b in enumerate(self.bits):
            out |= (((f >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)).astype(np.int64)
        return out


def ball(width: int, radius: int) -> int:
    return sum(math.comb(width, e) for e in range(radius + 1))


def grouped_bits(sample: np.ndarray, groups: int) -> list[tuple[int, ...]]:
    """The 64 bits in groups of even size, each grown from its most correlated bits."""
    bits = np.unpackbits(sample.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
    spread = bits.std(0)
    centred = (bits - bits.mean(0)) / np.where(spread > 0, spread, 1)
    like = np.abs(centred.T @ centred) / max(1, len(bits))
    np.fill_diagonal(like, 0)
    free, out = set(range(64)), []
    for g in range(groups):
        size = len(free) // (groups - g)
        seed = max(sorted(free), key=lambda b: like[b, sorted(free)].sum())
        group = [seed]
        free.remove(seed)
        while len(group) < size:
            near = max(sorted(free), key=lambda b: like[b, group].sum())
            group.append(near)
            free.remove(near)
        out.append(tuple(sorted(group)))
    return out


def plan(sample: np.ndarray, n: int, most: int) -> list[Partition]:
    """The cheapest partitions and thresholds for n fingerprints like those of the sample."""
    if len(sample) < 2:
        sample = np.array([0, (1 << 64) - 1], np.uint64)
    best_cost, best = math.inf, []
    half = len(sample) // 2
    differences = (sample[:half, None] ^ sample[None, half : half + 512]).ravel()
    for m in range(1, min(most + 1, 16) + 1):
        groups, goal = grouped_bits(sample, m), most - m + 1
        costs = []
        for bits in groups:
            mask = np.uint64(sum(1 << b for b in bits))
            near = np.bincount(np.bitwise_count(differences & mask), minlength=65).cumsum() / max(1, len(differences))
            cost = {-1: 0.0}
            for e in range(min(len(bits), most) + 1):
                if ball(len(bits), e) > MOST_PROBES:
                    break
                expected = max(near[e], ball(len(bits), e) / 2.0 ** len(bits))
                cost[e] = PROBE_COST * ball(len(bits), e) + CANDIDATE_COST * n * expected
            costs.append(cost)
        table: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for cost in costs:  # sums of thresholds so far -> cheapest way
            step: dict[int, tuple[float, tuple[int, ...]]] = {}
            for done, (paid, chosen) in table.items():
                for e, c in cost.items():
                    if paid + c < step.get(done + e, (math.inf,))[0]:
                        step[done + e] = (paid + c, (*chosen, e))
            table = step
        if goal in table and table[goal][0] < best_cost:
            best_cost, best = table[goal][0], [Partition(b, e) for b, e in zip(groups, table[goal][1], strict=True)]
    return [p for p in best if p.threshold >= 0]


class Meeting:
    """Rows that meet at one key: planes (rows x planes), names, and whether the key is the row's own."""

    def __init__(self, planes: np.ndarray, names: np.ndarray, own: np.ndarray, most: int, confirm: int | None):
        order = np.lexsort((~own, names))
        first = np.ones(len(order), bool)
        first[1:] = names[order][1:] != names[order][:-1]
        order = order[first]  # a name once, as own if it is
        self.planes, self.names, self.own = planes[order], names[order], own[order]
        self.most, self.confirm = most, confirm

    def near(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Linked pairs between rows a and rows b, as places in a and in b."""
        i, j = np.nonzero(np.bitwise_count(self.planes[a, 0][:, None] ^ self.planes[b, 0][None, :]) <= self.most)
        if self.confirm is not None and len(i):
            apart = np.bitwise_count(self.planes[a[i]] ^ self.planes[b[j]]).sum(1, dtype=np.int64)
            i, j = i[apart <= self.confirm], j[apart <= self.confirm]
        return i, j

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        """Links that connect the same rows as all links between an own row and any row."""
        every, mine = np.arange(len(self.names)), np.nonzero(self.own)[0]
        left, right, size = [], [], 0
        for at in range(0, len(mine), step := max(1, 1_000_000 // max(1, len(every)))):
            some = mine[at : at + step]
            i, j = self.near(some, every)
            apart = some[i] != j
            left.append(some[i][apart])
            right.append(j[apart])
            size += int(apart.sum())
            if size > 4 * len(every) + 1000:
                return self._searched() if self.confirm is None else self._nearest()
        return self._joined(np.concatenate(left), np.concatenate(right)) if size else (self.names[:0], self.names[:0])

    def _joined(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parent: dict[int, int] = {}

        def top(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = parent[up]
                x = up
            return x

        if self.confirm is not None:  # the links themselves, those with the most similar long fingerprints first
            order = np.argsort(np.bitwise_count(self.planes[left] ^ self.planes[right]).sum(1, dtype=np.int64), kind="stable")
            left, right = left[order], right[order]
        kept = []
        for x, y in zip(left.tolist(), right.tolist(), strict=True):
            a, b = top(x), top(y)
            if a != b:
                parent[max(a, b)] = min(a, b)
                kept.append((x, y))
        if self.confirm is not None:
            return self.names[[a for a, _ in kept]], self.names[[b for _, b in kept]]
        pairs = [(x, top(x)) for x in parent if top(x) != x]
        return self.names[[a for a, _ in pairs]], self.names[[b for _, b in pairs]]

    def _nearest(self) -> tuple[np.ndarray, np.ndarray]:
        """A forest of the most similar links, grown row by row, for keys with very many confirmed links."""
        rest, none = np.arange(len(self.names)), 1 << 30
        best, source = np.full(len(rest), none), np.zeros(len(rest), np.int64)
        a, b = [], []
        while rest.size:
            k = int(best[rest].argmin())
            if best[rest[k]] == none:
                roots = np.flatnonzero(self.own[rest])
                if not roots.size:
                    break
                k = int(roots[0])
            else:
                a.append(source[rest[k]])
                b.append(rest[k])
            new, rest = rest[k], np.delete(rest, k)
            bits = np.bitwise_count(self.planes[rest] ^ self.planes[new])
            apart = bits.sum(1, dtype=np.int64)
            closer = (bits[:, 0] <= self.most) & (apart <= self.confirm) & (self.own[rest] | self.own[new]) & (apart < best[rest])
            best[rest[closer]], source[rest[closer]] = apart[closer], new
        return self.names[a], self.names[b]

    def _searched(self) -> tuple[np.ndarray, np.ndarray]:
        """Breadth first, for keys with very many links: rows once reached are not compared again."""
        rest, a, b = np.arange(len(self.names)), [], []
        while (roots := rest[self.own[rest]]).size:
            root, frontier = roots[0], roots[:1]
            rest = rest[rest != root]
            while frontier.size and rest.size:
                some, frontier = frontier[:256], frontier[256:]
                found = np.zeros(len(rest), bool)
                for kind in (True, False):  # a row that only probes meets own rows only
                    part = some[self.own[some] == kind]
                    targets = np.nonzero(~found & (self.own[rest] | kind))[0]
                    for at in range(0, len(targets), 20_000):
                        _, j = self.near(part, rest[targets[at : at + 20_000]])
                        found[targets[at : at + 20_000][np.unique(j)]] = True
                new, rest = rest[found], rest[~found]
                a.append(self.names[new])
                b.append(np.full(len(new), self.names[root]))
                frontier = np.concatenate([frontier, new])
        return np.concatenate(a or [self.names[:0]]), np.concatenate(b or [self.names[:0]])


def links(distinct: DataFrame, most: int, confirm: int | None = None, key_rows: int = KEY_ROWS) -> DataFrame:
    """(a, b) links that connect the names of the (name, f) rows as all links would."""
    n = distinct.count()
    sample = distinct.orderBy(F.xxhash64("name"), "name").limit(SAMPLE).select(F.col("f")[0].alias("f")).toPandas()["f"]
    partitions = plan(sample.to_numpy(np.int64).view(np.uint64), n, most)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = [p.masks() for p in partitions]
        for batch in batches:
            names = batch.column("name").to_numpy()
            planes = batch.column("f").flatten().to_numpy().reshape(len(names), -1)
            for k, (p, mask) in enumerate(zip(partitions, masks, strict=True)):
                keys = p.keys(planes[:, 0].view(np.uint64))
                for at in range(0, len(mask), few := 16):
                    some = mask[at : at + few]
                    places = (np.int64(k) << np.int64(56)) | (keys[:, None] ^ some[None, :])
                    columns = [places.ravel(), np.repeat(names, len(some)), *[np.repeat(x, len(some)) for x in planes.T], np.tile(some == 0, len(names))]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["place", "name", *wide, "own"])

    first = distinct.select(F.size("f").alias("n")).first()
    wide = [f"f{k}" for k in range(first["n"] if first else 1)]
    kind = "place long, name long, " + ", ".join(f"{w} long" for w in wide) + ", own boolean"
    met = distinct.select("name", "f").mapInArrow(probe, kind)
    crowded = met.groupBy("place").agg(F.sum(F.col("own").cast("long")).alias("o"), F.count("*").alias("c")).where((F.col("o") > 0) & (F.col("c") > key_rows))
    crowded = settled(crowded.select("place", F.ceil(F.col("o") * 4 / key_rows).cast("int").alias("rows"), F.ceil(F.col("c") * 2 / key_rows).cast("int").alias("cols")))
    met = met.withColumn("cell", F.lit(0))
    if crowded.count():  # own rows go to their row of the grid, all rows (as probes) to their column
        spread = met.join(crowded, "place", "left")
        row, col = F.pmod(F.xxhash64("name"), F.col("rows")), F.pmod(F.xxhash64("name", F.lit(1)), F.col("cols"))
        upto = lambda c: F.sequence(F.lit(0), (F.col(c) - 1).cast("bigint"))
        as_own = F.transform(upto("cols"), lambda c: F.struct((row * F.col("cols") + c).cast("int").alias("cell"), F.lit(True).alias("own")))
        as_probe = F.transform(upto("rows"), lambda r: F.struct((r * F.col("cols") + col).cast("int").alias("cell"), F.lit(False).alias("own")))
        cells = F.when(F.col("rows").isNull(), F.array(F.struct(F.lit(0).alias("cell"), F.col("own").alias("own")))).when(F.col("own"), F.concat(as_own, as_probe)).otherwise(as_probe)
        met = spread.withColumn("to", F.explode(cells)).select("place", "name", *wide, F.col("to.own").alias("own"), F.col("to.cell").alias("cell"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            places, cells = rows["place"].to_numpy(), rows["cell"].to_numpy()
            names, own = rows["name"].to_numpy(), rows["own"].to_numpy(zero_copy_only=False)
            planes = np.stack([rows[w].to_numpy() for w in wide], 1).view(np.uint64)
            edges = np.flatnonzero((places[1:] != places[:-1]) | (cells[1:] != cells[:-1])) + 1
            bounds = np.concatenate([[0], edges, [len(places)]])
            a, b = [], []
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if e - s > 1 and own[s:e].any():
                    x, y = Meeting(planes[s:e], names[s:e], own[s:e], most, confirm).forest()
                    a.append(x)
                    b.append(y)
            if a and (total := np.concatenate(a)).size:
                pairs = np.unique(np.stack([total, np.concatenate(b)], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            places, cells = batch["place"].to_numpy(), batch["cell"].to_numpy()
            last = int(np.flatnonzero((places != places[-1]) | (cells != cells[-1])).max(initial=-1)) + 1
            if last or (held[0]["place"][0].as_py(), held[0]["cell"][0].as_py()) != (places[-1], cells[-1]):
                yield from linked(pa.Table.from_batches([*held[:-1], batch.slice(0, last)]))
                held = [batch.slice(last)]
        if held:
            yield from linked(pa.Table.from_batches(held))

    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return met.repartition(parts, "place", "cell").sortWithinPartitions("place", "cell").mapInArrow(meet, "a long, b long")


def near_duplicates(documents: DataFrame, shingle: int = 5, most: int = 4, keep: tuple[str, ...] = (), doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, kept columns, f, component_id) of every row: the smallest id that links connect with the row's, its own included."""
    made = settled(fingerprints(documents, shingle, 1, (doc_id, *keep)).withColumn("name", F.col("f")[0]))
    distinct = settled(made.groupBy("name").agg(F.first("f").alias("f"), F.min(doc_id).alias("least"), F.count("*").alias("rows")))
    root = components(links(distinct.select("name", "f"), most)).select(F.col("v").alias("name"), "root")
    named = settled(distinct.join(root, "name", "left").select("name", "rows", "least", F.coalesce("root", "name").alias("component")))
    of = named.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    called = settled(looked_up(named, of, "component").select("name", "rows", "component_id"))
    return looked_up(made, called, "name", "rows").select(doc_id, *keep, "f", "component_id")
