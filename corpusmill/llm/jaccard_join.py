"""N-gram Jaccard join by universe-partition pigeonhole, with exact verification.

A document's set holds its distinct word shingles. Sets are put into bands by size, so that partners are in the same or the next
band. For a band, a hash deals the universe of shingles into segments. Two sets with the wanted similarity differ in at most H
shingles, so of H + 1 + g segments at least g + 1 are equal; of (H + 1) / 2 segments at least one differs by one shingle
at most. Which of the two a band uses is decided by cost, from the number of sets in the band:

* whole segments: one signature for each segment, with g spare segments. Weak segments, which hold nothing but frequent shingles (or
  nothing at all), are left out of sets that have g of them at most, so that a pair still has an equal one that is not weak; other
  sets index theirs as well. Shingles are frequent if `hot_share` of all classes have them; they are counted over all rows;
* one-deletion neighbourhoods: signatures of each segment and of each segment less one shingle, for small sets.

Sets that share a signature are candidates. Of unlike sets a few share one by chance, more of them the more sets there are, so these are told
apart before their texts are fetched: a set has a sketch of about as many bits as shingles, each of which turns one over. Sketches of two sets
differ in no more bits than the sets differ in shingles, so a pair that differs in more than the similarity allows is no candidate, and none is
lost. A group of one signature is not expanded into pairs: in a window, sets with nearly the sketch of the first are hung on it, and the first
stands for them with the `slack` that this takes; over all windows, equal groups are one, the first member is compared with the others, and
those that are not near it with all. The connected components of the links that remain are the clusters in which all candidates lie. The
texts of candidates are fetched by a shuffle join, compressed. A cluster's texts meet in blocks of `block_bytes`: sets are
compared exactly, by the words, through an inverted index; a member is compared with all others unless links have joined it to the block's
first large component already, and only links that join components are returned. A cluster of several blocks has some pivots, which are
sent to each of its blocks, so that a large group of near copies becomes one component there; what is outside the cluster's largest component
(and that only) is then compared with all its blocks. So a large group of near copies costs one comparison a member, and no
link between components is missed. Equal sets are one class, which is compared once.

Null and empty texts have the empty set, which is linked with nothing. A text with fewer words than a shingle has one
shingle, the whole. Repeated rows are copies; rows of one id count as one document. Rows without an id link with nothing and have no
component. Very long texts are handled whole; a task has to hold one. An empty table gives an empty result. Only the id and text columns are read.

Shingles are hashed to 64 bits for counts and signatures, and classes (equal sets) to 128 bits; other links are decided on the words.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, release, skew_safe_join, text_bytes, tidy, windows, word_codes
from .components import connected_components, forest

_U = np.uint64
#: Members of a cluster of several blocks that are sent to each of its blocks.
PIVOTS = 8
#: Most 64-bit words of a sketch. Beyond it unlike sets of over 70,000 shingles may seem near.
SKETCH_WORDS = 512
#: Words that are compared for one group at most; a larger one, whose members are not near its first, is linked as it is.
GROUP_WORK = 2_000_000_000


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _lower_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    return word_codes(pc.ascii_lower(texts.view(pa.string())))


def shingles(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its shingles."""
    bounds, codes, distinct = _lower_words(texts)
    h = np.fromiter(map(xxhash.xxh64_intdigest, distinct), np.uint64, len(distinct))[codes] if len(codes) else np.zeros(0, np.uint64)
    total = np.full(max(0, len(h) - k + 1), k, np.uint64)
    for i in range(k):
        total = _mix(total * _U(3) + h[i : i + len(total)])
    out = []
    for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if z - a >= k or z == a:
            out.append(np.unique(total[a : max(a, z - k + 1)]))
        else:
            one = np.array([z - a], np.uint64)
            for x in h[a:z]:
                one = _mix(one * _U(3) + x)
            out.append(one)
    return out


def exact_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Of each text the numbers of its distinct shingles; equal numbers are equal words, in these texts."""
    bounds, codes, distinct = _lower_words(pa.array(texts, pa.binary()))
    grams, width = codes, 1  # grams[i]: the number of the `width` words from i on
    while width < k:
        step = min(width, k - width)
        n = max(0, len(codes) - width - step + 1)
        grams = np.unique(grams[:n] * (len(codes) + 1) + grams[step : step + n], return_inverse=True)[1]
        width += step
    short: dict[tuple, int] = {}
    out = []
    for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if z - a >= k or z == a:
            out.append(np.unique(grams[a : max(a, z - k + 1)]))
        else:
            out.append(np.array([len(codes) + short.setdefault(tuple(codes[a:z].tolist()), len(short))]))
    return out


def _class(h: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    digest = xxhash.xxh3_128_digest(h.tobytes())
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def band_starts(percent: int, most: int) -> list[int]:
    """The smallest size of each band; partners of a size are in its band or the next, or the one before."""
    starts = [1]
    while starts[-1] <= most:
        starts.append(starts[-1] * 100 // percent + 1)
    return starts


def allocate(starts: list[int], in_band: dict[int, int], percent: int, hot: float = 0.0) -> list[tuple[str, int, int]]:
    """For each pair of bands (k, k or k + 1): ("whole", segments, spare) or ("deletion", segments, 0), whichever costs less. hot: the share of frequent shingles in all sets."""
    plans = []
    for k in range(len(starts) - 1):
        largest = starts[k + 1] - 1
        most = (100 - percent) * (largest + largest * 100 // percent) // (100 + percent)
        sets = in_band.get(k, 0) + in_band.get(k + 1, 0)
        halves = (most + 2) // 2
        best = (halves + largest, ("deletion", halves, 0))
        for spare in range(0, most + 8):
            segments = most + 1 + spare
            weak = segments * math.exp(-starts[k] * (1 - hot) / segments)
            # sets with more than `spare` weak segments, by the tail of a Poisson distribution
            tail = 1 - sum(math.exp(-weak + i * math.log(weak) - math.lgamma(i + 1)) for i in range(spare + 1)) if weak > 0 else 0
            cost = segments + sets * max(0.0, tail) * weak
            if cost < best[0]:
                best = (cost, ("whole", segments, spare))
        plans.append(best[1])
    return plans


def signatures(sets: list[np.ndarray], starts: list[int], plans: list[tuple[str, int, int]], hot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(index of the set, signature) of every signature of the sets. hot: sorted hashes of frequent shingles."""
    sizes = np.array([len(h) for h in sets])
    bands = np.searchsorted(starts, sizes, "right") - 1
    owners: list[np.ndarray] = []
    found: list[np.ndarray] = []
    for shift in (0, 1):
        big, kinds, spares = [], [], []
        for i, h in enumerate(sets):
            k = int(bands[i]) - shift
            if not len(h) or k < 0:
                continue
            kind, segments, spare = plans[k]
            if kind == "whole":
                big.append(i)
                kinds.append((k, segments))
                spares.append(spare)
                continue
            mixed = _mix(h + _U(k))
            at = (mixed >> _U(32)) % _U(segments)
            for s in range(segments):
                own = mixed[at == s]
                total = own.sum(dtype=np.uint64) if len(own) else _U(0)
                sig = _mix(np.append(total - own, total) * _U(2 * segments + 1) + _U((k << 20) + s))
                owners.append(np.full(len(sig), i))
                found.append(sig)
        if not big:
            continue
        length = sizes[big]
        h = np.concatenate([sets[i] for i in big])
        cold = np.ones(len(h), bool)
        if hot is not None and len(hot):
            cold = hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] != h
        k = np.array([x[0] for x in kinds])
        m = np.array([x[1] for x in kinds])
        mixed = _mix(h + np.repeat(k, length).astype(np.uint64))
        at = ((mixed >> _U(32)) % np.repeat(m, length).astype(np.uint64)).astype(np.int64)
        offset = np.concatenate([[0], np.cumsum(m)])
        cell = np.repeat(offset[:-1], length) + at
        count = np.bincount(cell, minlength=offset[-1])
        low = np.bincount(cell, (mixed & _U(0xFFFFFFFF)).astype(float), offset[-1]).astype(np.uint64)
        high = np.bincount(cell, (mixed >> _U(32)).astype(float), offset[-1]).astype(np.uint64)
        owner = np.repeat(np.arange(len(big)), m)
        segment = np.arange(offset[-1]) - np.repeat(offset[:-1], m)
        sig = _mix(_mix(low + high * _U(0x9E3779B97F4A7C15)) + (k[owner].astype(np.uint64) << _U(40)) + (segment.astype(np.uint64) << _U(12)) + count.astype(np.uint64))
        weak = np.bincount(cell, cold, offset[-1]) == 0
        use = ~weak | (np.bincount(owner, weak, len(big)) > np.array(spares))[owner]
        owners.append(np.array(big)[owner[use]])
        found.append(sig[use])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(owners), np.concatenate(found)


def sketch(h: np.ndarray) -> np.ndarray:
    """Bits, at least as many as shingles up to a limit; each is whether an odd number of the shingles has this place."""
    n = 64 * min(SKETCH_WORDS, 1 << max(1, (max(1, len(h)) - 1 >> 6).bit_length()))
    odd = np.bincount((_mix(h + _U(0x5851F42D4C957F2D)) & _U(n - 1)).astype(np.int64), minlength=n) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def own_slack(n: np.ndarray, percent: int) -> np.ndarray:
    """Sets of n and m shingles that are similar differ in own_slack(n) + own_slack(m) at most."""
    return -(-(100 - percent) * n // (100 + percent))


def distances(sketches: np.ndarray, first: np.ndarray, width: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The bits in which sketches x[i] and y[i] differ; a wider one is folded. sketches: one behind the other, each from `first` on."""
    out = np.zeros(len(x), np.int64)
    kinds = width[x] << 32 | width[y]
    for kind in np.unique(kinds):
        at = np.flatnonzero(kinds == kind)
        wide = (int(kind) >> 32, int(kind) & 0xFFFFFFFF)
        step = max(1, (1 << 18) // max(wide))
        for begin in range(0, len(at), step):
            part = at[begin : begin + step]
            own = (sketches[first[i[part]][:, None] + np.arange(w)].reshape(len(part), -1, min(wide)) for i, w in zip((x, y), wide, strict=True))
            a, b = (np.bitwise_xor.reduce(m, axis=1) for m in own)
            out[part] = np.bitwise_count(a ^ b).sum(axis=1)
    return out


@tidy
def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (null, a, b), and rows (sig, a, slack beyond the class's own) sorted by them: the links, a forest for each batch, and the groups of two classes and more that have a signature in common."""

    def grouped(sig: np.ndarray, cid: np.ndarray, slack: np.ndarray) -> pa.RecordBatch:
        last = np.concatenate([(sig[1:] != sig[:-1]) | (cid[1:] != cid[:-1]), [True]])  # of a class that several tasks have read, the row with the largest slack
        sig, cid, slack = sig[last], cid[last], slack[last]
        first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        size = np.diff(np.append(first, len(sig)))
        use = np.repeat(size > 1, size)
        cid, slack, size = cid[use], slack[use], size[size > 1]
        first = np.concatenate([[0], np.cumsum(size)])
        if len(size):
            # near copies have many signatures in common: equal groups once
            key = np.add.reduceat(_mix(_mix(cid.view(np.uint64)) + slack.astype(np.uint64)), first[:-1])
            once = np.zeros(len(size), bool)
            once[np.unique(key, return_index=True)[1]] = True
            use = np.repeat(once, size)
            cid, slack, size = cid[use], slack[use], size[once]
            first = np.concatenate([[0], np.cumsum(size)])
        bounds, none = pa.array(first, pa.int32()), pa.nulls(len(size), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, pa.ListArray.from_arrays(bounds, pa.array(cid, pa.int64())), pa.ListArray.from_arrays(bounds, pa.array(slack, pa.int64()))], ["a", "b", "members", "slack"])

    held = [np.zeros(0, np.int64)] * 3
    for batch in batches:
        linked = batch.column("sig").is_null().to_numpy(zero_copy_only=False)
        given, rows = batch.filter(pa.array(linked)), batch.filter(pa.array(~linked))
        links = forest(given.column("a").to_numpy(), given.column("b").to_numpy())
        yield pa.RecordBatch.from_arrays([*links.columns, pa.nulls(len(links), pa.list_(pa.int64())), pa.nulls(len(links), pa.list_(pa.int64()))], ["a", "b", "members", "slack"])
        if rows.num_rows:
            held = [np.concatenate([x, rows.column(c).to_numpy()]) for x, c in zip(held, ("sig", "a", "b"), strict=True)]
            ended = np.searchsorted(held[0], held[0][-1])  # the last group may go on
            if ended:
                yield grouped(*(x[:ended] for x in held))
                held = [x[ended:] for x in held]
    if len(held[0]):
        yield grouped(*held)


def near_links(cid: np.ndarray, slack: np.ndarray, sketches: np.ndarray, first: np.ndarray, width: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the members of each group that are near by their sketches, or joined by such. begins: where each group begins, and the end."""
    size = np.diff(begins)
    center = np.repeat(begins[:-1], size)
    at = np.arange(len(cid))
    near = distances(sketches, first, width, center, at) <= slack[center] + slack
    a, b = [cid[center[near]]], [cid[near]]
    for g in np.flatnonzero((np.add.reduceat(~near, begins[:-1]) > 0) & (size > 2)).tolist():
        own = at[begins[g] : begins[g + 1]]
        label = np.where(near[own], 0, np.arange(len(own)))
        rest = np.flatnonzero(label)
        if len(rest) * int(width[own].sum()) > GROUP_WORK:
            a.append(np.full(len(rest), cid[own[0]]))
            b.append(cid[own[rest]])
            continue
        for x in rest.tolist():
            if label[x]:  # the others are compared with this one, unless they are in the first one's component too
                y = np.flatnonzero(distances(sketches, first, width, np.full(len(own), own[x]), own) <= slack[own[x]] + slack[own])
                joined = np.unique(label[y])
                if len(joined) > 1:
                    a.append(np.full(len(y), cid[own[x]]))
                    b.append(cid[own[y]])
                    label[np.isin(label, joined)] = joined[0]
    a, b = np.concatenate(a), np.concatenate(b)
    return a[a != b], b[a != b]


@tidy
def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (gid, a, slack, bits) sorted by group: the links of near members, a forest for each window."""
    held: list[pa.RecordBatch] = []

    def linked(rows: pa.Table) -> pa.RecordBatch:
        gid, bits = rows.column("gid").to_numpy(), rows.column("bits")
        width = pc.binary_length(bits).to_numpy().astype(np.int64) >> 3
        begins = np.append(np.flatnonzero(np.concatenate([[True], gid[1:] != gid[:-1]])), len(gid))
        flat = np.frombuffer(b"".join(bits.to_pylist()), np.uint64)
        return forest(*near_links(rows.column("a").to_numpy(), rows.column("slack").to_numpy().astype(np.int64), flat, np.cumsum(width) - width, width, begins))

    for batch in windows(batches, "bits", 4 << 20):
        held.append(batch)
        rows = pa.Table.from_batches(held)
        gid = batch.column("gid").to_numpy()
        ended = rows.num_rows - batch.num_rows + int(np.argmax(gid == gid[-1]))  # the last group may go on
        if len(held) > 1 and gid[0] == gid[-1] and held[-2].column("gid")[-1].as_py() == gid[-1]:
            continue
        if ended:
            yield linked(rows.slice(0, ended))
            held = rows.slice(ended).to_batches()
            release()
    if held:
        yield linked(pa.Table.from_batches(held))


def _joining_links(members: list[tuple[int, int | None, bool, bytes]], percent: int, k: int) -> list[tuple[int, int]]:
    """Links that join the components of a cluster. members: (id, label, outside, text).

    Without labels all pairs are looked at. Else members have the label of the component that they are in already, and each of those that are
    outside is compared with those that are not.
    """
    known = members[0][1] is not None
    outside = np.array([o for _, _, o, _ in members])
    if known and not outside.any():
        return []
    sets = exact_sets([text for *_, text in members], k)
    sizes = np.array([len(x) for x in sets])
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    postings = np.repeat(np.arange(len(sets)), sizes)[order]
    bounds = np.concatenate([[0], np.cumsum(np.bincount(every))])
    parent = np.arange(len(sets))
    if known:
        _, first, of = np.unique(np.array([x for _, x, _, _ in members]), return_index=True, return_inverse=True)
        parent = first[of]
    weight = np.ones(len(sets), np.int64)

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links, hub = [], None
    for x in np.flatnonzero(outside) if known else range(len(sets)):
        if hub is None and x >= 32 and not known:
            hub = int(weight.argmax())  # stays the same from here: of two members that are skipped, both are in its component
        if hub is not None and find(x) == find(hub):
            continue
        both = np.bincount(np.concatenate([postings[bounds[s] : bounds[s + 1]] for s in sets[x].tolist()]), minlength=len(sets))
        near = 100 * both >= percent * (sizes + sizes[x] - both)
        near[x] = False
        if known:
            near &= ~outside
        for y in np.flatnonzero(near):
            a, b = find(x), find(int(y))
            if a != b:
                parent[max(a, b)] = min(a, b)
                weight[min(a, b)] += weight[max(a, b)]
                links.append((members[x][0], members[int(y)][0]))
    return links


def _verify(percent: int, k: int):
    @tidy
    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by (cluster, i, j, outside): the links that are found in each (cluster, i, j)."""
        press, held, mine = zstandard.ZstdDecompressor(), [], None

        def close() -> pa.RecordBatch:
            links = _joining_links(held, percent, k) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([x for _, x in links], pa.int64())], ["a", "b"])

        for batch in windows(batches, "z", 4 << 20):
            for cluster, i, j, outside, label, rep, z in zip(*(batch.column(c).to_pylist() for c in ("cluster", "i", "j", "outside", "label", "rep", "z")), strict=True):
                if (cluster, i, j) != mine:
                    if held:
                        yield close()
                    held, mine = [], (cluster, i, j)
                held.append((rep, label, outside, press.decompress(z)))
            release()
        if held:
            yield close()

    return test


def _meet(rows: DataFrame, percent: int, words: int) -> DataFrame:
    """Links (a, b) of rows (cluster, i, j, outside, label, rep, z) that have cluster, i and j in common."""
    met = rows.select("cluster", "i", "j", "outside", "label", "rep", "z").repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "outside", "rep", "z")
    return materialize(met.mapInArrow(_verify(percent, words), "a long, b long"), "links")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, percent: int = 85, block_bytes: int = 8 << 20, hot_share: float = 0.002, rounds: int = 1) -> DataFrame:
    """For each row: doc_id, n_shingles, component_id (smallest id reachable by links of similarity percent / 100 or more).

    Signatures are met in so many `rounds`, each of which reads the texts again and holds its part of the signatures on disk.
    """
    texts = text_bytes(docs, text_col, F.col(id_col).cast("long").alias("doc_id"))

    @tidy
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row's set size, class and sketch; and rows (shingle, how many distinct sets of a window have it) of the shingles that are frequent there."""
        for batch in windows(batches, size=8 << 20):
            sets = shingles(batch.column("text"), words)
            ids = [_class(h) for h in sets]
            size, none = len(sets), pa.nulls(len(sets), pa.int64())
            bits = pa.array([sketch(h).tobytes() for h in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(h) for h in sets], pa.int64()), pa.array([x for x, _ in ids], pa.int64()), pa.array([x for _, x in ids], pa.int64()), none, bits], ["doc_id", "n", "cid", "cid2", "shingle", "bits"])
            one = dict(zip(ids, sets, strict=True))
            shingle, n = np.unique(np.concatenate(list(one.values())), return_counts=True)
            often = n >= max(2, hot_share * size)
            shingle, n = shingle[often].view(np.int64), n[often]
            none = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.array(n, pa.int64()), none, none, pa.array(shingle), pa.nulls(len(n), pa.binary())], ["doc_id", "n", "cid", "cid2", "shingle", "bits"])
            release()

    found = materialize(texts.mapInArrow(describe, "doc_id long, n long, cid long, cid2 long, shingle long, bits binary"), "sets")
    rows = found.where("shingle is null").drop("shingle", "bits")
    usable = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    classes = materialize(rows.where(usable).groupBy("cid", "cid2").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.count("*").alias("k")), "classes")
    n_rows, n_classes, most, n_shingles = classes.agg(F.coalesce(F.sum("k"), F.lit(0)), F.count("*"), F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    # at most (shingles of an average class) / hot_share of them, however many rows there are
    frequent = found.where("shingle is not null").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= max(8, hot_share * n_classes)).toArrow()
    hot = np.sort(frequent.column("shingle").to_numpy().view(np.uint64))
    share = min(0.99, int(pc.sum(frequent.column("n")).as_py() or 0) / max(1, n_shingles))
    starts = band_starts(percent, most)
    band = F.size(F.filter(F.array(*[F.lit(s) for s in starts]), lambda s: s <= F.col("n"))) - 1
    plans = allocate(starts, {r.band: r.k for r in classes.groupBy(band.alias("band")).agg(F.count("*").alias("k")).collect()}, percent, share)
    shared = docs.sparkSession.sparkContext.broadcast((starts, plans, hot))

    def shared_signatures(turn: int) -> DataFrame:
        """The links and groups of those signatures whose remainder by `rounds` is `turn`."""

        @tidy
        def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """(sig, a, slack beyond its own): each signature of a window with its first class there, and those whose sketch is not nearly the first one's; (null, a, b): links from it to the others."""
            seen: set[tuple[int, int]] = set()
            starts, plans, hot = shared.value
            for batch in windows(batches, size=4 << 20):
                sets, ids = [], []
                for h in shingles(batch.column("text"), words):
                    if len(h) and (c := _class(h)) not in seen:
                        seen.add(c)
                        sets.append(h)
                        ids.append(c[0])
                if len(seen) > 200_000:
                    seen.clear()
                owner, sig = signatures(sets, starts, plans, hot)
                mine = sig % _U(rounds) == turn
                owner, sig = owner[mine], sig[mine]
                if not len(sig):
                    continue
                order = np.argsort(sig, kind="stable")
                sig, owner = sig[order].view(np.int64), owner[order]
                bits = [sketch(h) for h in sets]
                width = np.array([len(x) for x in bits])
                slack = own_slack(np.array([len(h) for h in sets]), percent)
                begins = np.concatenate([[True], sig[1:] != sig[:-1]])
                first = np.maximum.accumulate(np.where(begins, np.arange(len(sig)), 0))
                more = np.flatnonzero(~begins)
                pair, of = np.unique(owner[first[more]] * len(sets) + owner[more], return_inverse=True)
                x, y = pair // len(sets), pair % len(sets)
                apart = distances(np.concatenate(bits), np.cumsum(width) - width, width, x, y)
                like = (apart <= slack[y] // 2) & (width[x] == width[y])
                cid, extra = np.array(ids, np.int64), np.zeros(len(sig), np.int64)
                np.maximum.at(extra, first[more[like[of]]], (slack[y] + apart - slack[x])[of[like[of]]])
                links = forest(cid[x[like & (x != y)]], cid[y[like & (x != y)]])
                yield pa.RecordBatch.from_arrays([pa.nulls(len(links), pa.int64()), links.column("a"), links.column("b")], ["sig", "a", "b"])
                kept = np.ones(len(sig), bool)
                kept[more[like[of]]] = False
                sig, cid, extra = sig[kept], cid[owner[kept]], extra[kept]
                for at in range(0, len(sig), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 100_000]) for x in (sig, cid, extra)], ["sig", "a", "b"])
                del sets, owner, sig, cid, order, begins, first, kept, extra, bits, mine
                release()

        signed = texts.where("doc_id is not null").mapInArrow(index, "sig long, a long, b long")
        signed = signed.repartition(F.coalesce(F.col("sig"), F.xxhash64("a", "b"))).sortWithinPartitions("sig", "a", "b")
        return materialize(signed.mapInArrow(_groups, "a long, b long, members array<long>, slack array<long>"), "groups")

    # the signatures of all rounds together would take several times the disk of the texts
    parts = [shared_signatures(turn) for turn in range(rounds)]
    grouped = functools.reduce(DataFrame.unionByName, parts)
    groups = grouped.where("members is not null").select("members", "slack").distinct()
    asked = groups.select(F.xxhash64("members", "slack").alias("gid"), F.explode(F.arrays_zip("members", "slack")).alias("m")).select("gid", F.col("m.members").alias("a"), F.col("m.slack").alias("slack"))
    own = F.ceil(F.col("n") * (100 - percent) / (100 + percent))
    sketches = found.where("shingle is null").where(usable).select(F.col("cid").alias("a"), own.alias("own"), "bits").dropDuplicates(["a"])
    asked = asked.join(sketches.hint("merge"), "a").select("gid", "a", (F.col("slack") + F.col("own")).alias("slack"), "bits").repartition("gid").sortWithinPartitions("gid", "a")
    near = asked.mapInArrow(_near, "a long, b long").unionByName(grouped.where("members is null").select("a", "b"))
    clusters = connected_components(near, contracted=True)
    for part in parts:
        discard(part)
    clusters = clusters.unionByName(clusters.select(F.col("label").alias("node"), "label").distinct())
    named = materialize(clusters.withColumnRenamed("node", "cid").join(classes.select("cid", "rep"), "cid").select("rep", F.col("label").alias("cluster")).distinct(), "named")

    @tidy
    def pressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in windows(batches, size=4 << 20):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([press.compress(t) for t in batch.column("text").to_pylist()], pa.binary()), pc.binary_length(batch.column("text"))], ["rep", "z", "bytes"])

    # always by shuffle, whatever the number of candidates
    fetched = texts.where("doc_id is not null").mapInArrow(pressed, "rep long, z binary, bytes int").join(named.hint("merge"), "rep").dropDuplicates(["rep", "cluster", "z"])
    held = materialize(fetched, "texts")
    sizes = held.groupBy("cluster").agg(F.ceil(F.sum(F.col("bytes") + 100) / block_bytes).cast("int").alias("blocks"), F.count("*").alias("k"))
    sizes = materialize(sizes, "blocks")
    placed = skew_safe_join(held, sizes, ["cluster"], "k", n_rows)
    zero, alone = F.lit(0), F.lit(False)
    placed = placed.select("cluster", F.pmod(F.xxhash64("rep"), "blocks").cast("int").alias("i"), zero.alias("j"), alone.alias("outside"), F.lit(None).cast("long").alias("label"), "rep", "z", "bytes", "blocks")
    large = sizes.where("blocks > 1").limit(1).count() > 0
    if not large:
        links = _meet(placed, percent, words)
    else:
        placed = materialize(placed, "placed")
        big = placed.where("blocks > 1")
        order = Window.partitionBy("cluster").orderBy(F.xxhash64("rep", F.lit(1)), "rep", "z")
        pivots = big.withColumn("place", F.row_number().over(order)).where(F.col("place") <= PIVOTS)
        sent = pivots.withColumn("to", F.explode(F.sequence(zero, F.col("blocks") - 1))).where("to <> i").drop("place", "i").withColumnRenamed("to", "i")
        links = _meet(placed.unionByName(sent), percent, words)
        # what is outside the largest component of its cluster meets each block of it
        joined = connected_components(links)
        big = big.drop("label").join(joined.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
        big = materialize(big, "big")
        counted = big.groupBy("cluster", "label").agg(F.count("*").alias("k"))
        hubs = counted.groupBy("cluster").agg(F.max_by("label", F.struct("k", "label")).alias("hub"), F.sum("k").alias("k"))
        outside = materialize(skew_safe_join(big, hubs, ["cluster"], "k", n_rows).where("label <> hub").drop("hub"), "outside")
        rest = outside.groupBy("cluster").agg(F.ceil(F.sum(F.col("bytes") + 100) / block_bytes).cast("int").alias("more"))
        rest = rest.join(counted.groupBy("cluster").agg(F.sum("k").alias("k")), "cluster")
        base = skew_safe_join(big, rest, ["cluster"], "k", n_rows).drop("j").withColumn("j", F.explode(F.sequence(zero, F.col("more") - 1)))
        sent = skew_safe_join(outside, rest, ["cluster"], "k", n_rows).withColumn("j", F.pmod(F.xxhash64("rep", F.lit(2)), "more").cast("int")).withColumn("outside", F.lit(True))
        sent = sent.withColumnRenamed("i", "own").withColumn("i", F.explode(F.sequence(zero, F.col("blocks") - 1))).where("i <> own")
        more = _meet(base.drop("more").unionByName(sent.drop("own", "more")), percent, words)
        links = more.unionByName(joined.select(F.col("node").alias("a"), F.col("label").alias("b")))
        for made in (placed, big, outside):
            discard(made)
    labels = connected_components(links)
    discard(held)
    # labels come to classes first, of which no two share a representative, and then to rows
    named = classes.join(labels, classes.rep == labels.node, "left").select("cid", "cid2", "k", F.coalesce("label", "rep").alias("component_id"))
    linked = skew_safe_join(rows.where(usable), named, ["cid", "cid2"], "k", n_rows).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.unionByName(rows.where(~usable).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
