"""Exact Jaccard join of documents' word-shingle sets by regions of their metric space, and its components.

The distance is 1 - Jaccard, a metric; two documents link within ``R = 1 - percent / 100``.

* **First regions.**  No document can part a whole corpus: within 1 - 2R of one pivot there are at most 1 / 2R disjoint sets,
  and nearly all of a corpus' sets are nearly disjoint, so windows of 2R around Voronoi regions of any
  sampled documents copy nearly every document to nearly every region (README has figures).  So the first pivots are the
  sets of one shingle: a document goes to those of its ``R * n + 1`` first shingles, rare ones first, as a
  linked document lacks ``R * n`` of its shingles at most.  This is a prefix filter; sizes and
  places in the order leave out what can't link.
* **Large regions.**  A region of over ``LEAF`` documents (near copies, mostly) first has all of them compared to
  ``STARS`` of its documents; what links makes one component, and later only pairs of different components count.
  Of the pairs that are left, those that connect a region like a tree come first, then what they leave in different components.
* **Voronoi regions.**  What is left of a large region is parted by documents drawn from it as pivots, about ``PIVOTS`` of them.
  A document's home is its nearest pivot p; it is replicated to every pivot q with
  d(x, q) <= d(x, p) + 2R, as by the triangle inequality a document linked to x has no other home.  Regions of over ``WIDE`` documents are parted
  again, with pivots of their own.  Where all lie within the windows of all, so that parting ends, the
  documents outside the largest component are compared to the region in blocks of ``WIDE``.
* **Bound, then exact.**  Distances within large regions are those of the documents' counts of shingles by ``SKETCH`` hash
  classes.  That weighted Jaccard distance is a metric too and never exceeds the documents' own, so windows
  in it lose nothing.  Pairs within R by it are compared by their whole sets of 64-bit shingle hashes.

The order of shingles takes rare ones first by a table of counts of fixed size (``2**COUNT_BITS``), made
from all documents.  It only affects speed: the join is exact in any order.

A shingle that many documents hold is no single task's: a task that meets one more than ``LEAF`` times deals the
rest of its rows over ``SALTS`` keys.  Rows of large regions stream through; ``LEAF`` of them are held, later ``WIDE``.

Equal sets are one node from the start, so copies are never expanded.  A document with fewer words than
a shingle has one, the whole sequence; null texts and those without words have none and link to
nothing.  Repeated rows are members like any other; null ids are members but never a component's id.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberscope.llm.common import checkpointed, few_files, looked_up, merge, removed, rewritten, small_batches, swept, tidy
from emberscope.llm.components import components

#: Similar: 100 * intersection >= PERCENT * union.
PERCENT, WORDS = 90, 3
LEAF, STARS, PIVOTS, WIDE, SALTS = 32, 1, 16, 2048, 16
SKETCH, COUNT_BITS, CHUNKS, HEAVY_BITS, WANTED_BITS = 128, 21, 512, 20, 23
#: Bytes of text that are hashed together, and words whose runs are.
PORTION, RUNS = 1 << 20, 1 << 16


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: A number for each byte, the same for A-Z as for a-z; which bytes end a word; powers for a byte's place in its word.
LETTERS = mixed(np.arange(1, 257, dtype=np.uint64))
LETTERS[65:91] = LETTERS[97:123]
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
BASE = 0x9E3779B97F4A7C15
POWERS = np.cumprod(np.full(64, BASE, dtype=np.uint64))


def hashed_words(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words of the bytes start, and their 64-bit hashes; ``first`` flags bytes at which a text starts."""
    solid = ~SPACE[data]
    begins = solid & first
    begins[1:] |= solid[1:] & ~solid[:-1]
    starts, letters = np.flatnonzero(begins), data[solid]
    at = np.flatnonzero(begins[solid])
    if not len(at):
        return starts, np.zeros(0, dtype=np.uint64)
    sizes = np.diff(np.append(at, len(letters)))
    powers = POWERS if sizes.max() <= len(POWERS) else np.cumprod(np.full(sizes.max(), BASE, dtype=np.uint64))
    place = np.arange(len(letters)) - np.repeat(at, sizes)
    return starts, mixed(np.add.reduceat(LETTERS[letters] * powers[place], at) + sizes.astype(np.uint64))


def portions(data: np.ndarray, first: np.ndarray):
    """(start, end) of about PORTION bytes each, none of which cuts a word."""
    at = 0
    while at < len(data):
        end, step = min(at + PORTION, len(data)), PORTION
        while end < len(data):
            breaks = np.flatnonzero(SPACE[data[end - step : end]] | first[end - step : end])
            breaks = breaks[breaks + end - step > at]
            if len(breaks):
                end = int(breaks[-1]) + end - step
                break
            end = min(end + step, len(data))  # a word longer than a portion
        yield at, end
        at = end


def chained(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words, from the words' own."""
    out = np.full(max(len(h) - size + 1, 0), size, dtype=np.uint64)
    for i in range(size):
        out = mixed(out * np.uint64(BASE) + h[i : i + len(out)])
    return out


def shingles(texts, words: int):
    """For each text of an Arrow array the sorted distinct hashes of its shingles; only A-Z and ASCII white space are special."""
    import pyarrow as pa

    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype="<i8")[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets[:-1]] = True
    first = first[:-1]
    starts, hashes = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint64)]
    for a, b in portions(data, first):
        at, h = hashed_words(data[a:b], first[a:b])
        starts.append(at + a)
        hashes.append(h)
    ends, h = np.searchsorted(np.concatenate(starts), offsets).tolist(), np.concatenate(hashes)
    del starts, hashes
    upto = 0  # runs holds those of words from ``since`` to ``upto``, whole texts
    for i, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
        if b > upto:
            since, last = a, int(np.searchsorted(ends, a + RUNS, side="right")) - 1
            upto = ends[max(last, i + 1)]
            runs = chained(h[since:upto], words)
        if b - a < words:
            yield chained(h[a:b], b - a) if b > a else h[:0]
        else:
            out = np.sort(runs[a - since : b - since - words + 1])
            new = np.ones(len(out), dtype=bool)
            np.not_equal(out[1:], out[:-1], out=new[1:])
            yield out[new]


def bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - COUNT_BITS)).astype(np.int64)


def counted(words: int):
    """Over Arrow batches of text: this task's table of shingle counts, in chunks; counts stop at 65535."""

    def run(batches):
        import pyarrow as pa

        counts = np.zeros(1 << COUNT_BITS, dtype=np.uint32)
        for batch in batches:
            for s in shingles(batch.column(0), words):
                np.add.at(counts, bucket(s), np.uint32(1))  # a plain 1 is fifteen times slower
        small = np.minimum(counts, 65535).astype("<u2").reshape(CHUNKS, -1)
        if counts.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([c.tobytes() for c in small], pa.binary())], ["chunk", "counts"])

    return run


def added(table):
    """The sum of one chunk's tables, and the sum of its counts."""
    import pyarrow as pa

    total = sum(np.frombuffer(c.as_py(), dtype="<u2").astype(np.uint32) for c in table.column("counts"))
    chunk = table.column("chunk")[0].as_py()
    return pa.table({"chunk": pa.array([chunk], pa.int32()), "counts": pa.array([total.astype("<u4").tobytes()], pa.binary()), "total": pa.array([int(total.sum())], pa.int64())})


def flagged(mean: float):
    """Over Arrow batches of (chunk, counts): (chunk, flags), a bit for each class that is over the mean by far."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            flags = [np.packbits(np.frombuffer(c.as_buffer(), dtype="<u4") > mean + 8 * np.sqrt(mean) + 16).tobytes() for c in batch.column("counts")]
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), pa.array(flags, pa.binary())], ["chunk", "flags"])

    return run


def joined_bits(rows, chunks: int, bits: int) -> bytes:
    """A bit table of fixed size from its (chunk, flags); chunks that are missing are empty."""
    each = (1 << bits) // chunks // 8
    out = bytearray(each * chunks)
    for chunk, flags in zip(*rows.toArrow().to_pydict().values()):
        out[chunk * each : (chunk + 1) * each] = flags
    return bytes(out)


def frequent(docs: DataFrame, text: str, words: int) -> bytes:
    """Bits of the hash classes that hold a frequent shingle: 2**COUNT_BITS of them for any input."""
    sums = docs.select(docs[text].alias("t")).mapInArrow(tidy(counted(words)), "chunk int, counts binary").groupBy("chunk").applyInArrow(added, "chunk int, counts binary, total bigint")
    sums = checkpointed(few_files(sums))
    mean = (sums.agg(F.sum("total")).first()[0] or 0) / (1 << COUNT_BITS)
    return joined_bits(sums.select("chunk", "counts").mapInArrow(flagged(mean), "chunk int, flags binary"), CHUNKS, COUNT_BITS)


def sketched(s: np.ndarray) -> bytes:
    """Counts by class in the narrowest of one, two and four bytes that holds them all."""
    counts = np.bincount((s & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
    return counts.astype("<u1" if counts.max(initial=0) < 1 << 8 else "<u2" if counts.max() < 1 << 16 else "<u4").tobytes()


def unsketched(sketches: list[bytes]) -> np.ndarray:
    """One row of counts for each sketch."""
    kinds = {SKETCH: "<u1", 2 * SKETCH: "<u2", 4 * SKETCH: "<u4"}
    if all(len(s) == SKETCH for s in sketches):
        return np.frombuffer(b"".join(sketches), dtype="<u1").reshape(-1, SKETCH).astype(np.int32)
    return np.array([np.frombuffer(s, dtype=kinds[len(s)]) for s in sketches], dtype=np.int32).reshape(-1, SKETCH)


def signed(words: int, percent: int, hot):
    """Over Arrow batches whose last column is text: in its place n, set digest (h1, h2), prefix and sketch."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        flags = np.unpackbits(np.frombuffer(hot.value, dtype=np.uint8)).astype(bool)
        for batch in batches:
            sizes, h1, h2, prefixes, sketches = [], [], [], [], []
            for s in shingles(batch.column(batch.num_columns - 1), words):
                digest = xxhash.xxh3_128_digest(s.tobytes())
                common = flags[bucket(s)]
                sizes.append(len(s))
                h1.append(int.from_bytes(digest[:8], "big", signed=True))
                h2.append(int.from_bytes(digest[8:], "big", signed=True))
                prefixes.append(np.concatenate([s[~common], s[common]])[: len(s) - -(-len(s) * percent // 100) + 1].view(np.int64))
                sketches.append(sketched(s))
            own = [pa.array(sizes, pa.int32()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *own], [*batch.schema.names[:-1], "n", "h1", "h2", "prefix", "sketch"])

    return run


def needed(n1, n2, percent: int):
    """The least intersection of linked sets of these sizes."""
    return -(-percent * (n1 + n2) // (100 + percent))


def able(x: dict, y: dict, percent: int) -> np.ndarray:
    """Whether sizes and places in the order allow a link: what they share lies from those places on."""
    return np.minimum(x["n"] - x["pos"], y["n"] - y["pos"]) >= needed(x["n"], y["n"], percent)


def cut(rows: dict, a, b) -> dict:
    return {k: v[a:b] for k, v in rows.items()}


def starts_of(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys start."""
    change = np.zeros(max(len(keys[0]) - 1, 0), dtype=bool)
    for k in keys:
        change |= k[1:] != k[:-1]
    return np.flatnonzero(np.concatenate([[True], change])) if len(keys[0]) else np.zeros(0, dtype=np.int64)


PLACED = "key long, salt int, node long, n long, pos long"


def placed(batches):
    """Over Arrow batches of (node, n, prefix): a row for each of the document's first regions.

    Once a task has met a shingle (by its class of 2**HEAVY_BITS) more than LEAF times, it salts what follows and tells the
    region so by a row with node -1.
    """
    import pyarrow as pa

    met = np.zeros(1 << HEAVY_BITS, dtype=np.int64)
    for batch in batches:
        lists = batch.column("prefix")
        key = lists.flatten().to_numpy(zero_copy_only=False)
        sizes = np.diff(lists.offsets.to_numpy())
        node, n = (np.repeat(batch.column(c).to_numpy().astype(np.int64), sizes) for c in ("node", "n"))
        pos = np.arange(len(key)) - np.repeat(np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
        classes = (key & ((1 << HEAVY_BITS) - 1)).astype(np.int64)
        met += np.bincount(classes, minlength=len(met))
        heavy = met[classes] > LEAF
        salt = np.where(heavy, 1 + (mixed(node.view(np.uint64)) % np.uint64(SALTS)).astype(np.int64), 0)
        marks = np.unique(key[heavy])
        none = np.zeros(len(marks), dtype=np.int64)
        columns = [np.concatenate(c) for c in ((marks, key), (none, salt), (none - 1, node), (none, n), (none, pos))]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(columns)], ["key", "salt", "node", "n", "pos"])


REGIONS = "a long, b long, key long, n long, pos long"


def regions(percent: int):
    """Over Arrow batches of PLACED, by key, salt and node, a key's and salt's rows together.

    Gives the pairs (a, b) of small regions and, of large ones, those with the first STARS rows; and the members
    of large regions as rows (a, null, key, n, pos).
    """
    names = ("key", "salt", "node", "n", "pos")

    def stars(pivots, rows):
        for i in range(len(pivots["node"])):
            good = able(cut(pivots, i, i + 1), rows, percent) & (rows["node"] > pivots["node"][i])
            yield np.full(int(good.sum()), pivots["node"][i]), rows["node"][good], None

    def large(rows, pivots):
        yield from stars(pivots, rows)
        yield rows["node"], None, rows

    def closed(rows):
        starts = starts_of(rows["key"], rows["salt"])
        sizes = np.diff(np.append(starts, len(rows["key"])))
        marked = rows["node"][starts] < 0
        wide = (sizes - marked > LEAF) | marked | (rows["salt"][starts] > 0)
        for s, n, m in zip(starts[wide], sizes[wide], marked[wide]):
            own = cut(rows, s, s + n)
            own = {k: v[own["node"] >= 0] for k, v in own.items()} if m else own
            yield from large(own, cut(own, 0, STARS))
        small = np.repeat(~wide, sizes)
        rows = {k: v[small] for k, v in rows.items()}
        for d in range(1, LEAF):
            x, y = cut(rows, 0, max(len(rows["key"]) - d, 0)), cut(rows, d, None)
            same = x["key"] == y["key"]
            if not same.any():
                break
            good = same & able(x, y, percent)
            yield x["node"][good], y["node"][good], None

    def found(batches):
        held, open_ = {k: np.zeros(0, dtype=np.int64) for k in names}, None
        for batch in batches:
            rows = {k: batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in names}
            if open_ is not None:  # the rest of a large region
                other = (rows["key"] != open_["key"][0]) | (rows["salt"] != open_["salt"][0])
                own = int(other.argmax()) if other.any() else len(other)
                yield from large(cut(rows, 0, own), open_)
                rows = cut(rows, own, None)
                if not len(rows["key"]):
                    continue
                open_ = None
            rows = {k: np.concatenate([held[k], rows[k]]) for k in names}
            starts = starts_of(rows["key"], rows["salt"])
            if not len(starts):
                continue
            yield from closed(cut(rows, 0, starts[-1]))
            held = cut(rows, starts[-1], None)
            members = {k: v[held["node"] >= 0] for k, v in held.items()}
            if len(members["key"]) > LEAF:
                open_ = cut(members, 0, STARS)
                yield from large(members, open_)
                held = cut(held, 0, 0)
        yield from closed(held)

    def run(batches):
        import pyarrow as pa

        for a, b, rows in found(batches):
            if len(a):
                own = [pa.nulls(len(a), pa.int64())] * 3 if rows is None else [pa.array(rows[k], pa.int64()) for k in ("key", "n", "pos")]
                b = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), b, *own], ["a", "b", "key", "n", "pos"])

    return run


def distances(x: np.ndarray, n, y: np.ndarray, m) -> np.ndarray:
    """Weighted Jaccard distances of counts: one row of x, of sum n, to each of y, of sums m."""
    apart = np.abs(y - x).sum(axis=1)
    return 2 * apart / np.maximum(n + m + apart, 1)


MEMBER = "root long, region long, own boolean, node long, n long, pos long, label long, sketch binary"
NAMES = MEMBER.replace(",", "").split()[::2]


def homes(percent: int):
    """Over Arrow batches of MEMBER with its region's pivots (node, n, sketch): the member with its home's and windows' pivots.

    ``cells``: nodes of the pivots that it goes to, the home first.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            region = batch.column("region").to_numpy()
            cells: list = [None] * len(region)
            n, x = batch.column("n").to_numpy(), unsketched(batch.column("sketch").to_pylist())
            for one in np.unique(region):
                at = np.flatnonzero(region == one)
                pivots = batch.column("pivots")[int(at[0])].as_py()
                names, sizes = np.array([p["node"] for p in pivots]), np.array([p["n"] for p in pivots])
                y = unsketched([p["sketch"] for p in pivots])
                for i in at:
                    d = distances(x[i], n[i], y, sizes)
                    order = np.argsort(d, kind="stable")
                    cells[i] = names[order[d[order] <= d[order[0]] + 2 * (1 - percent / 100) + 1e-9]].tolist()
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in NAMES], pa.array(cells, pa.list_(pa.int64()))], [*NAMES, "cells"])

    return run


def leaves(percent: int, forest: bool):
    """Over Arrow batches of MEMBER with ``held``, by region, held rows first, a region's rows together: pairs (root, a, b, n_a, n_b).

    Held rows are compared to each other and to the others.  A pair needs an own row, two labels, sizes and places that
    allow a link, and counts within R.  ``forest``: of those only what connects labels that the region's earlier
    pairs don't connect, the nearest first; that is fewer pairs than rows.  Where others are left out there is a row (root, -1, -1, 0, 0).
    """
    names = ("root", "region", "held", "own", "node", "n", "pos", "label")

    def against(x, y, up):
        """Pairs of a row of x and one of y; ``up`` leads from a label to one that it is connected to."""

        def root(label):
            while (above := up.get(label, label)) != label:
                up[label] = label = up.get(above, above)
            return label

        for i in range(len(x["node"])):
            good = (x["label"][i] != y["label"]) & (x["own"][i] | y["own"]) & able(cut(x, i, i + 1), y, percent)
            at = np.flatnonzero(good)
            if len(at):
                apart = np.abs(y["sketch"][at] - x["sketch"][i]).sum(axis=1)
                near = apart <= x["n"][i] + y["n"][at] - 2 * needed(x["n"][i], y["n"][at], percent)
                at, apart = at[near], apart[near]
            if len(at) and forest:
                new, mine = [], root(int(x["label"][i]))
                for j in at[np.argsort(apart, kind="stable")]:
                    other = root(int(y["label"][j]))
                    if other != mine:
                        up[other] = mine
                        new.append(j)
                if len(new) < len(at) and None not in up:
                    up[None] = None
                    yield x["root"][i : i + 1], *np.array([[-1], [-1], [0], [0]])
                at = np.array(new, dtype=np.int64)
            if len(at):
                yield np.full(len(at), x["root"][i]), np.full(len(at), x["node"][i]), y["node"][at], np.full(len(at), x["n"][i]), y["n"][at]

    def found(batches):
        held = None
        for batch in batches:
            rows = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in names}
            rows["sketch"] = unsketched(batch.column("sketch").to_pylist())
            starts = starts_of(rows["region"])
            for s, e in zip(starts, np.append(starts[1:], len(rows["region"]))):
                own = cut(rows, s, e)
                if held is None or held["region"][0] != own["region"][0]:
                    held, up = cut(own, 0, 0), {}
                kept = int(own["held"].sum())
                new, others = cut(own, 0, kept), cut(own, kept, None)
                yield from against(new, held, up)
                for i in range(kept):
                    yield from against(cut(new, i, i + 1), cut(new, i + 1, None), up)
                held = {k: np.concatenate([held[k], new[k]]) for k in new} if kept else held
                yield from against(others, held, up)
                if not len(held["region"]):
                    held = None

    def run(batches):
        import pyarrow as pa

        for root, a, b, n, m in found(batches):
            turned = a > b
            columns = [root, *[np.where(turned, y, x) for x, y in ((a, b), (b, a), (n, m), (m, n))]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["root", "a", "b", "n_a", "n_b"])

    return run


def possible(percent: int):
    """Over Arrow batches of (a, b, n_a, n_b, sketch_a, sketch_b): the pairs that the sketches' bound allows."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                x, y = (unsketched(batch.column(c).to_pylist()) for c in ("sketch_a", "sketch_b"))
                n = sum(batch.column(c).to_numpy().astype(np.int64) for c in ("n_a", "n_b"))
                # |x - y| has n - 2 * intersection elements, and the sketches differ by no more.
                good = np.abs(x - y).sum(axis=1) <= n - 2 * needed(n, 0, percent)
                yield batch.filter(pa.array(good)).select(["a", "b", "n_a", "n_b"])

    return run


def marked(batches):
    """Over Arrow batches of hashes: (chunk, flags) of this task's classes of them, a bit each."""
    import pyarrow as pa

    flags = np.zeros(1 << WANTED_BITS, dtype=bool)
    for batch in batches:
        flags[batch.column(0).to_numpy() & ((1 << WANTED_BITS) - 1)] = True
    if flags.any():
        chunks = np.packbits(flags).reshape(CHUNKS, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([c.tobytes() for c in chunks], pa.binary())], ["chunk", "flags"])


def any_of(table):
    """One chunk's flags of all tasks."""
    import pyarrow as pa

    flags = np.bitwise_or.reduce([np.frombuffer(c.as_py(), dtype=np.uint8) for c in table.column("flags")])
    return pa.table({"chunk": pa.array([table.column("chunk")[0].as_py()], pa.int32()), "flags": pa.array([flags.tobytes()], pa.binary())})


def wanted(bits):
    """Over Arrow batches of (hash, ...): the rows whose hash class is flagged."""

    def run(batches):
        import pyarrow as pa

        flags = np.unpackbits(np.frombuffer(bits.value, dtype=np.uint8)).astype(bool)
        for batch in batches:
            yield batch.filter(pa.array(flags[batch.column(0).to_numpy() & ((1 << WANTED_BITS) - 1)]))

    return run


def sets_of(words: int):
    """Over Arrow batches of (node, h1, h2, text): (node, set) where the text's set has that digest."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            nodes, sets = [], []
            for node, h1, h2, s in zip(*[c.to_pylist() for c in batch.columns[:3]], shingles(batch.column(3), words)):
                s = s.tobytes()
                if xxhash.xxh3_128_digest(s) == h1.to_bytes(8, "big", signed=True) + h2.to_bytes(8, "big", signed=True):
                    nodes.append(node)
                    sets.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], ["node", "set"])

    return run


def compared(batches):
    """Over Arrow batches of (a, b, n_a, n_b, x, y): (a, b, n_a, n_b, both), the size of the intersection of sets x and y."""
    import pyarrow as pa

    for batch in batches:
        both = []
        for x, y in zip(batch.column("x"), batch.column("y")):
            x, y = (np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in (x, y))
            at = np.minimum(np.searchsorted(x, y), len(x) - 1)
            both.append(int((x[at] == y).sum()))
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(both, pa.int64())], [*batch.schema.names[:4], "both"])


class Join:
    """One join's tables: every row's signature, the distinct sets, and their links as they are found."""

    def __init__(self, docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), words: int = WORDS, percent: int = PERCENT):
        self.words, self.percent, self.keep, self.spark = words, percent, keep, docs.sparkSession
        small_batches(self.spark)
        # _h finds a row's text again: of equal rows any one will do.
        self.docs = docs.select(docs["doc_id"].alias("_id"), docs[text].alias("_text"), F.xxhash64(docs["doc_id"], docs[text]).alias("_h"), *[docs[c].alias(f"_k{i}") for i, c in enumerate(keep)])
        hot = self.spark.sparkContext.broadcast(frequent(docs, text, words))
        rows = self.docs.select("_id", "_h", *[f"_k{i}" for i in range(len(keep))], "_text")
        kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
        rows = rows.mapInArrow(tidy(signed(words, percent, hot)), f"{kinds}n int, h1 long, h2 long, prefix array<long>, sketch binary")
        self.rows, _ = rewritten(rows.withColumn("_row", F.monotonically_increasing_id()), few=False)
        sets = self.rows.filter("n > 0").groupBy("n", "h1", "h2").agg(
            F.min("_row").alias("node"), F.min_by("_h", "_row").alias("_h"), F.min("_id").alias("least"), F.count("*").alias("rows"), F.first("prefix").alias("prefix"), F.first("sketch").alias("sketch"))
        self.sets, _ = rewritten(sets.select("node", "_h", "least", "rows", "prefix", "sketch", *[F.col(c).alias(f"s_{c}") for c in ("n", "h1", "h2")]), few=False)
        swept(self.spark)

    def sets_for(self, pairs: DataFrame) -> DataFrame:
        """(node, set) of the nodes of ``pairs``; a table of fixed size tells most other texts apart before they are shuffled."""
        nodes = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct()
        active, at = rewritten(self.sets.select("node", "s_h1", "s_h2", "_h").join(merge(nodes), "node").withColumnRenamed("_h", "_of"))
        flags = active.select("_of").mapInArrow(tidy(marked), "chunk int, flags binary").groupBy("chunk").applyInArrow(any_of, "chunk int, flags binary")
        bits = self.spark.sparkContext.broadcast(joined_bits(flags, CHUNKS, WANTED_BITS))
        texts = self.docs.select("_h", "_text").mapInArrow(tidy(wanted(bits)), "_h long, _text string")
        texts = texts.join(merge(active), F.col("_h") == F.col("_of")).select("node", "s_h1", "s_h2", "_text")
        sets, _ = rewritten(texts.mapInArrow(tidy(sets_of(self.words)), "node long, set binary").dropDuplicates(["node"]), few=False)
        removed(self.spark, at)
        swept(self.spark)
        return sets

    def possible(self, pairs: DataFrame) -> DataFrame:
        """(a, b, n_a, n_b) of the pairs that the sketches allow."""
        side = lambda s: self.sets.select(F.col("node").alias(f"node_{s}"), F.col("s_n").alias(f"n_{s}"), F.col("sketch").alias(f"sketch_{s}"))
        pairs = pairs.join(merge(side("a")), F.col("a") == F.col("node_a")).join(merge(side("b")), F.col("b") == F.col("node_b"))
        return pairs.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(tidy(possible(self.percent)), "a long, b long, n_a int, n_b int")

    def linked(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that link, by their whole sets, of pairs (a, b, n_a, n_b)."""
        pairs, at = rewritten(pairs)
        swept(self.spark)
        sets = self.sets_for(pairs)
        pairs = pairs.withColumns({c: F.col(c).cast("long") for c in ("n_a", "n_b")})
        both = pairs.join(merge(sets.select(F.col("node").alias("node_a"), F.col("set").alias("x"))), F.col("a") == F.col("node_a"))
        both = both.join(merge(sets.select(F.col("node").alias("node_b"), F.col("set").alias("y"))), F.col("b") == F.col("node_b"))
        sizes = both.select("a", "b", "n_a", "n_b", "x", "y").mapInArrow(tidy(compared), "a long, b long, n_a long, n_b long, both long")
        union = F.col("n_a") + F.col("n_b") - F.col("both")
        out, _ = rewritten(sizes.filter(100 * F.col("both") >= self.percent * union).select("a", "b"))
        removed(self.spark, at)
        swept(self.spark)
        return out

    def labels(self) -> DataFrame:
        """(node, label) of the sets that link to another one."""
        spread = self.sets.select("node", F.col("s_n").cast("long").alias("n"), "prefix").mapInArrow(tidy(placed), PLACED)
        found, at = rewritten(spread.repartition("key", "salt").sortWithinPartitions("key", "salt", "node").mapInArrow(tidy(regions(self.percent)), REGIONS), few=False)
        swept(self.spark)
        pairs, _ = rewritten(found.filter("b is not null").select("a", "b").distinct())
        links = self.linked(self.possible(pairs))
        labels = components(links)
        members = found.filter("b is null").select(F.col("key").alias("region"), F.col("a").alias("node"), "n", "pos")
        # First what connects each region if the counts are right, so that of near copies not all pairs are left; then all that is left.
        left = self.left_over(members, labels, True)
        if left is not None:
            roots = left.filter("a < 0").select(F.col("root").alias("_r")).distinct()
            tree, _ = rewritten(left.filter("a >= 0").drop("root").distinct().join(merge(pairs), ["a", "b"], "left_anti"))
            links, labels = self.extended(links, labels, tree)
            left = self.left_over(members.join(merge(roots), F.col("region") == F.col("_r"), "left_semi"), labels, False)
        if left is not None:
            known = pairs.unionAll(tree.select("a", "b"))
            links, labels = self.extended(links, labels, left.drop("root").distinct().join(merge(known), ["a", "b"], "left_anti"))
        removed(self.spark, at)
        return labels

    def extended(self, links: DataFrame, labels: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(links, labels) with the pairs that link."""
        new = self.linked(pairs)
        if new.isEmpty():
            return links, labels
        links = links.unionAll(new)
        return links, components(links)

    def left_over(self, members: DataFrame, labels: DataFrame, forest: bool) -> DataFrame | None:
        """Pairs (root, a, b, n_a, n_b) of different labels within large regions (region, node, n, pos) that may link; None if there are none to look at."""
        at, _ = rewritten(members.join(merge(labels), "node", "left").withColumn("label", F.coalesce("label", "node")), few=False)
        at, _ = rewritten(self.sized(at), few=False)
        if at.isEmpty():
            return None
        sketches = self.sets.select(F.col("node").alias("_n"), "sketch")
        table = at.join(merge(sketches), F.col("node") == F.col("_n")).select(F.col("region").alias("root"), "region", F.lit(True).alias("own"), "node", "n", "pos", "label", "sketch", "size")
        found = []
        while True:
            table, _ = rewritten(table, few=False)
            swept(self.spark)
            small, large = table.filter(F.col("size") <= WIDE), table.filter(F.col("size") > WIDE)
            found.append(self.leaf_pairs(small.withColumn("held", F.lit(True)), forest))
            if large.isEmpty():
                break
            table = self.sized(self.parted(large, found, forest))
        out = found[0]
        for more in found[1:]:
            out = out.unionAll(more)
        return out

    @staticmethod
    def sized(members: DataFrame) -> DataFrame:
        """``members`` of regions of more than one label, with their region's ``size``."""
        several = members.groupBy("region").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size")).filter("lo < hi")
        return members.join(merge(several.select(F.col("region").alias("_r"), "size")), F.col("region") == F.col("_r")).drop("_r")

    def leaf_pairs(self, rows: DataFrame, forest: bool) -> DataFrame:
        kept = rows.select(*NAMES, "held")
        pairs, _ = rewritten(kept.repartition("region").sortWithinPartitions("region", F.desc("held")).mapInArrow(tidy(leaves(self.percent, forest)), "root long, a long, b long, n_a long, n_b long"))
        swept(self.spark)
        return pairs

    def parted(self, table: DataFrame, found: list[DataFrame], forest: bool) -> DataFrame:
        """MEMBER rows of the Voronoi regions of ``table`` (MEMBER and its region's ``size``); pairs of regions that don't part go to ``found``."""
        # A pivot by a share of the hashes, and the least hash so that there is one.
        h = F.xxhash64("region", "node")
        drawn = F.abs(h % 1_000_000) * F.col("size") < PIVOTS * 1_000_000
        one = F.struct("node", "n", "sketch")
        pivots = table.filter("own").groupBy("region").agg(F.min_by(one, h).alias("first"), F.collect_list(F.when(drawn, one)).alias("drawn"))
        pivots, _ = rewritten(pivots.select(F.col("region").alias("_r"), F.array_distinct(F.concat(F.array("first"), "drawn")).alias("pivots")))
        # A large region's rows are many for its one row of pivots: Spark splits such a join's partitions.
        members = table.join(merge(pivots), F.col("region") == F.col("_r"))
        at, _ = rewritten(members.select(*NAMES, "pivots").mapInArrow(tidy(homes(self.percent)), f"{MEMBER}, cells array<long>"), few=False)
        cells = at.select("region", F.explode("cells").alias("cell")).groupBy("region", "cell").agg(F.count("*").alias("n"))
        cells = cells.groupBy("region").agg(F.max("n").alias("most"), F.sum("n").alias("copies"))
        labels = at.groupBy("region", "label").agg(F.count("*").alias("n")).groupBy(F.col("region").alias("_r")).agg(F.max_by("label", "n").alias("largest"), F.sum("n").alias("size"))
        state = cells.join(merge(labels), F.col("region") == F.col("_r"))
        parts = (F.col("most") <= 0.8 * F.col("size")) & (F.col("copies") <= 4 * F.col("size"))
        state, _ = rewritten(state.select("_r", parts.alias("parts"), "largest", F.ceil(F.col("size") / WIDE).alias("blocks")))
        at = at.join(merge(state), F.col("region") == F.col("_r"))
        block = F.pmod(F.xxhash64("node"), F.col("blocks"))
        among = F.when(F.col("label") == F.col("largest"), F.array(block)).otherwise(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
        dense = at.filter("not parts").withColumn("block", F.explode(among)).withColumn("held", F.col("block") == block)
        found.append(self.leaf_pairs(dense.withColumn("region", F.xxhash64("region", "block")), forest))
        own = F.col("own") & (F.col("cell") == F.col("cells")[0])
        children = at.filter("parts").withColumn("cell", F.explode("cells")).select("root", F.xxhash64("region", "cell").alias("region"), own.alias("own"), "node", "n", "pos", "label", "sketch")
        out, _ = rewritten(children, few=False)
        swept(self.spark)
        return out

    def result(self) -> DataFrame:
        """``keep``, n_shingles, component_id (smallest id of the component), and of each row its id, number and component's label."""
        labels = self.labels().select(F.col("node").alias("_node"), "label")
        sets = self.sets.select("node", "least", "rows", "s_n", "s_h1", "s_h2").join(merge(labels), F.col("node") == F.col("_node"), "left")
        sets = sets.withColumn("label", F.coalesce("label", "node"))
        ids = sets.groupBy(F.col("label").alias("_label")).agg(F.min("least").alias("component_id"))
        digest = lambda *of: F.concat_ws(":", *of)
        sets, _ = rewritten(sets.join(merge(ids), F.col("label") == F.col("_label")).select(digest("s_n", "s_h1", "s_h2").alias("_set"), "rows", "component_id", "label"))
        out = looked_up(self.rows.drop("prefix", "sketch").withColumn("_set", digest("n", "h1", "h2")), "_set", sets, "_row")
        names = [F.col(f"_k{i}").alias(c) for i, c in enumerate(self.keep)]
        component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("_id"))
        return out.select(*names, F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"), "_id", "_row", F.when(F.col("n") > 0, F.col("label")).alias("_label"))


def join(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``keep``, n_shingles and component_id of every row of ``docs``."""
    return Join(docs, text, keep, words, percent).result().select(*keep, "n_shingles", "component_id")


def identity(docs: DataFrame) -> Column:
    """A digest of the whole row."""
    own = [docs[c].cast("string") for c in docs.columns]
    return F.md5(F.concat(*[F.coalesce(F.concat(F.length(c), F.lit(":"), c), F.lit("-")) for c in own]))


def one_of_each(docs: DataFrame, text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest id (then the least digest of the row); rows without shingles all stay."""
    names = docs.columns
    keyed = docs.select(*[docs[c].alias(f"_c{i}") for i, c in enumerate(names)], identity(docs).alias("_key"))
    found = Join(docs.select("doc_id", docs[text].alias("_t"), identity(docs).alias("_key")), "_t", ("_key",), words, percent).result()
    first = F.struct(F.col("_id").isNull().alias("unnamed"), F.col("_id").alias("id"), F.col("_key").alias("key"))
    kept = found.filter("_label is not null").groupBy("_label").agg(F.min(first).alias("f")).select(F.col("f.key").alias("_kept"), F.lit(True).alias("_one"))
    bare = found.filter("_label is null").select(F.col("_key").alias("_kept"), F.lit(False).alias("_one")).distinct()
    stays = keyed.join(merge(kept.unionAll(bare)), F.col("_key") == F.col("_kept"))
    one = stays.filter("_one").dropDuplicates(["_key"])
    return one.unionAll(stays.filter("not _one")).select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(names)])
