"""SimHash near-duplicates with pivot distance tables.

Fingerprints come from 3-word shingles; two of them link if they differ in 2 bits or fewer, and a document's component
is the smallest id reachable over links.

Only distinct fingerprints are compared. The 64 bits are read as 8 bands of 8; two fingerprints with at most 2
differing bits agree in at least 6 bands, so each is filed under its 28 choices of 6 bands, and no link is lost. All
members of a file agree in 48 bits, so no file holds more than 65,536 fingerprints, whatever the data: a group that
holds a third of all rows is either few distinct fingerprints or many files.

Within a file only the 16 bits of the two bands that were left out differ. Pivots are the zero fingerprint and the ones
of every block of ``BLOCK_BITS`` bits; the distances to them are a table with a row for each member, which gives the
number of ones in each block. By the triangle inequality two members within ``RADIUS`` differ by at most that in any
coordinate, and by at most that in all blocks together, since blocks don't overlap. So members are sorted by their
coordinates, each looks up only the ``_offsets`` that may hold a partner, and the survivors are compared bit by bit.
This is one path for files of any size, and far below the square of a large one. A file yields the edges of a spanning
forest, never all of its pairs.

Components of the forests' union come from alternating star contractions over the distinct fingerprints.

``representatives`` keeps one row of each group that links of similarity 0.8 or more form: exact Jaccard of the sets of
5-word shingles. No number of differing bits follows from a similarity, so fingerprints of five words and their links
only give the first pairs to verify, which unite large groups at little cost. The rest come from an exact join, which
loses no pair: in one order of all shingles, the first ``n - ceil(0.8 n) + 1`` of two such sets of n have one in
common. Any order gives the same pairs; this one is by the number of rows that have a shingle, counted over all rows, so
that shingles of one row come first. These meet no other set and needn't be known by name: a set that has as many of
them as its first shingles are has no similar one and is left out, and of the others only those first shingles are sent
that more rows have. Passages that many texts quote come last, so unlike texts seldom meet however many there are.

Counting takes about five bytes a shingle. Texts are gathered in chunks; a chunk sends each of ``buckets`` ranges of
hashes the next 32 bits of its shingles there and the places of their texts in the chunk, and gets back those that more
rows have, with their number. A shingle is known by these bits: two that agree in them count as one, which changes the
order for all texts alike, never the pairs.

Sets also carry the parities of their shingles in ``PARITIES`` classes: where two sets differ in k of these they differ
in k shingles at least, which discards dissimilar pairs unseen. Pairs that are already in one group aren't verified
again; so that large groups are found before their pairs are listed, each set first meets only ``FEW`` others, in a
shuffled order, in each of its files. The join that follows lists what is left: pairs of sets that may be similar and are
in different groups by then. Two sets that share a shingle and also the one before it in the common order have met
there, so of each run of shared shingles only the first lists them. Pairs between a large group and its outliers still
grow with the square of the group; texts are sent to verify them once for each block of pairs, not for each pair.

Defined cases: null or empty text has the fingerprint 0, linked like any other; texts of one or two words have one
shingle, the whole sequence; rows repeated with one id are one document with several fingerprints; rows without an id
link like others but don't name their component, which has no name (null) if none of its rows has an id; an empty table
gives an empty result; other columns are not used, and pass through ``representatives``, whatever their names; texts are
handled whole.
"""

from __future__ import annotations

import uuid
from functools import reduce
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHash, dropped, fresh, give_back, joined_by_key, quoted, slices, stored, windows, word_ids

SHINGLE, SEED, RADIUS = 3, 42, 2
BANDS, BAND_BITS = 8, 8
#: Near copies: words of a shingle, and the least Jaccard similarity as a fraction.
NEAR_SHINGLE, NEAR = 5, (4, 5)
#: Shingles and texts of a chunk at most (a longer text alone); characters of text for each bucket, which bounds its shingles.
CHUNK, CHUNK_TEXTS, BUCKET_CHARS = 2_000_000, 60_000, 6_000_000
#: Powers of two that the number of buckets keeps to.
LEAST_BUCKETS, MOST_BUCKETS = 11, 16
#: For the meetings that unite large groups, and the classes of shingles whose parities are kept.
FEW, PARITIES = 4, 256
#: Texts and characters of a part, on average; pairs are verified in blocks of two parts.
PART_TEXTS, PART_CHARS = 128, 1_000_000
ODD = [f"odd{k}" for k in range(PARITIES // 64)]
LONGS = ", ".join(f"{c} long" for c in ODD)
#: Bits of a block; the pivot table has a column for each of the blocks of the two free bands.
BLOCK_BITS = 2
BLOCKS = 2 * BAND_BITS // BLOCK_BITS
#: Pairs that are compared at a time.
STEP = 1 << 20
#: The choices of the bands that are left out.
CHOICES = list(combinations(range(BANDS), RADIUS))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode().lower().split()  # bytes.lower() changes A-Z alone
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return _majority(xxhash.xxh64_digest(joined, SEED), 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_digest
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist())]
    return _majority(b"".join(hashes), len(hashes))


def _majority(digests: bytes, n: int) -> int:
    """A bit is set if over half of the big-endian digests have it."""
    counts, step = np.zeros(64, np.int64), 8 << 16
    for at in range(0, len(digests), step):  # bounds the unpacked bits
        block = np.frombuffer(digests[at : at + step], np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) for each row."""
    rows = docs.select(F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(text)).alias("text"))

    def run(batches):
        for batch in chain.from_iterable(map(slices, batches)):
            fps = [fingerprint(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])
        give_back()

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def lowest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and edges (a, b): the smallest node of each one's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (jump := new[new]).tobytes() != new.tobytes():
            new = jump
        if (new == label).all():
            return label
        label = new


def pivot_table(free: np.ndarray) -> np.ndarray:
    """Ones in each block of the free bits, from distances to pivots: |x ^ block| = |x| + |block| - 2 * ones in the block."""
    pivots = [((1 << BLOCK_BITS) - 1) << (k * BLOCK_BITS) for k in range(BLOCKS)]
    far = [np.bitwise_count(free ^ p).astype(np.int64) for p in (0, *pivots)]
    return np.stack([(far[0] + BLOCK_BITS - f) // 2 for f in far[1:]])


def _offsets() -> list[tuple[int, ...]]:
    """Differences of coordinates that a link may have, one of each two opposite ones."""
    out: list[tuple[int, ...]] = [()]
    for _ in range(BLOCKS):
        out = [(*o, d) for o in out for d in range(-BLOCK_BITS, BLOCK_BITS + 1) if sum(map(abs, o)) + abs(d) <= RADIUS]
    return [o for o in out if o >= (0,) * BLOCKS]


OFFSETS = _offsets()


def linked_pairs(file: np.ndarray, fp: np.ndarray, choice: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between members of one file; ``fp`` holds distinct values within a file."""
    free = _sixteen(fp, choice)
    table, base = pivot_table(free), BLOCK_BITS + 1
    weight = base ** np.arange(BLOCKS)
    key = file * base**BLOCKS + (table * weight[:, None]).sum(0)
    order = np.argsort(key, kind="stable")
    key, free, table = key[order], free[order], table[:, order]
    left, right = [], []
    for offset in OFFSETS:
        fits = np.ones(len(key), bool)
        for k, d in enumerate(offset):
            if d:
                fits &= (table[k] + d >= 0) & (table[k] + d <= BLOCK_BITS)
        here = np.nonzero(fits)[0]
        wanted = key[here] + int(np.dot(offset, weight))
        low, high = np.searchsorted(key, wanted, "left"), np.searchsorted(key, wanted, "right")
        if not any(offset):
            low = here + 1  # of two in one cell, the later one is the partner
        here, low, count = here[high > low], low[high > low], (high - low)[high > low]
        ends = np.cumsum(count)
        at = 0
        while at < len(here):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP, "right")))
            n = count[at:to]
            a = np.repeat(here[at:to], n)
            b = np.repeat(low[at:to] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            near = np.bitwise_count(free[a] ^ free[b]) <= RADIUS
            left.append(order[a[near]])
            right.append(order[b[near]])
            at = to
    return np.concatenate(left) if left else np.empty(0, int), np.concatenate(right) if right else np.empty(0, int)


def _sixteen(fp: np.ndarray, choice: np.ndarray) -> np.ndarray:
    """The bits of the two bands that each one's file leaves out."""
    take = lambda bands: (fp >> (bands[choice] * BAND_BITS).astype(np.uint64)) & np.uint64((1 << BAND_BITS) - 1)
    i, j = np.array(CHOICES).T
    return (take(i) << np.uint64(BAND_BITS) | take(j)).astype(np.int64)


def _forests(batches):
    """Batches of (choice, key, fp), sorted by choice and key, to edges (fp, lowest fp of its part of the file)."""
    held: pa.Table | None = None

    def edges(table):
        choice, key = table.column(0).to_numpy(), table.column(1).to_numpy()
        fp = table.column(2).to_numpy().view(np.uint64)
        both = np.nonzero((choice[1:] != choice[:-1]) | (key[1:] != key[:-1]))[0]
        file = np.zeros(len(fp), np.int64)
        file[both + 1] = 1
        file = np.cumsum(file)
        size = np.bincount(file)
        some = size[file] > 1
        fp, file, choice = fp[some], file[some], choice[some]
        if not len(fp):
            return None
        a, b = linked_pairs(file, fp, choice)
        low = lowest(len(fp), a, b)
        moved = np.nonzero(low != np.arange(len(fp)))[0]
        return pa.RecordBatch.from_arrays([pa.array(fp[moved].view(np.int64)), pa.array(fp[low[moved]].view(np.int64))], ["a", "b"]) if len(moved) else None

    for batch in batches:
        now = pa.Table.from_batches([batch])
        held = now if held is None else pa.concat_tables([held, now])
        c, k = held.column(0).to_numpy(), held.column(1).to_numpy()
        cut = np.nonzero((c != c[-1]) | (k != k[-1]))[0]  # the last file may go on
        if len(held) >= 20_000 and len(cut):
            end = int(cut[-1]) + 1
            if (out := edges(held.slice(0, end))) is not None:
                yield out
            held = held.slice(end)
    if held is not None and len(held) and (out := edges(held)) is not None:
        yield out


def links(fps: DataFrame) -> DataFrame:
    """``fps`` (fp, distinct) -> edges a, b that connect what links connect."""
    band = lambda k: F.shiftrightunsigned("fp", k * BAND_BITS).bitwiseAND(F.lit(255))
    files = []
    for n, out in enumerate(CHOICES):
        mask = sum(255 << (k * BAND_BITS) for k in range(BANDS) if k not in out)
        files.append(F.struct(F.lit(n).alias("choice"), F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("key")))
    rows = fps.select("fp", F.explode(F.array(*files)).alias("f")).select(F.col("f.choice").alias("choice"), F.col("f.key").alias("key"), "fp")
    rows = rows.repartition("choice", "key").sortWithinPartitions("choice", "key", "fp")
    return rows.mapInArrow(_forests, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) -> node, root: the least node of each component, by alternating star contractions.

    Each round sends every node's larger neighbours, then its smaller ones, to the least of them; both use grouped
    minima (combined before the shuffle) and a join, so that a node with many neighbours stays spread out. It ends
    when a round changes no edge. Rounds end in tables in the shared folder.
    """
    pairs = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    while True:
        # large star: v > u goes to the least of u and its neighbours
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: u's smaller neighbours, and u, go to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        before, pairs = pairs, stored(small, "links")
        dropped(before)
        now = pairs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if now == seen or not now[0]:
            break
        seen = now
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for every row."""
    marks = stored(fingerprints(docs, doc_id, text), "fingerprints")
    fps = stored(marks.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")), "fingerprint-sets")
    roots = components(links(fps.select("fp"))).withColumnRenamed("node", "fp")
    of = fps.join(roots, "fp", "left").select("fp", "low", "n", F.coalesce("root", "fp").alias("root"))
    least = of.groupBy("root").agg(F.min("low").alias("component_id"))
    out = joined_by_key(marks, of.join(least, "root").select("fp", "component_id", "n"), "fp", "n", marks.count())
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(text: str | None, cache: WordHash, k: int = NEAR_SHINGLE) -> np.ndarray:
    """Hashes of a text's different shingles, sorted; a text of fewer words has one, all of it."""
    words = (text or "").encode().lower().split()
    return np.unique(windows(word_ids(words, cache), min(k, len(words)))) if words else np.empty(0, np.uint64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * NEAR[1] >= NEAR[0] * (len(a) + len(b) - both)


def parities(shingles: np.ndarray) -> np.ndarray:
    """Whether an odd number of the set's shingles is in each class, as words of 64 bits."""
    odd = np.bincount((shingles >> np.uint64(56)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def prefix_length(n: int) -> int:
    """So many shingles of a set of ``n``, in any common order, meet those of every similar set."""
    return n - -(-n * NEAR[0] // NEAR[1]) + 1 if n else 0


def packed(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The bytes of ``values``, cut at these places into binary values."""
    offsets = (cuts * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def unpacked(column: pa.ChunkedArray, kind) -> tuple[np.ndarray, np.ndarray]:
    """What ``packed`` has packed, and the number of values of each row."""
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), kind), np.array([len(x) for x in parts], np.int64) // np.dtype(kind).itemsize


def bucket_bits(texts: DataFrame) -> int:
    chars = texts.agg(F.sum(F.length("text").cast("double"))).first()[0] or 0
    return min(MOST_BUCKETS, max(LEAST_BUCKETS, int(chars // BUCKET_CHARS).bit_length()))


def shingle_marks(texts: DataFrame, bits: int) -> DataFrame:
    """``texts`` (doc_id, text_key, text) -> doc_id, text_key, fp, sig (hash of the set), n (its size) and its parities for
    each row, whose chunk is null; and for each chunk what it sends to 2^``bits`` buckets: low (32 bits of its shingles), and
    step and high (how much further each one's text is than the last one's, in two bytes). In bucket -1 are the sigs (low)
    and sizes (step) of its texts."""
    kind = texts.schema["doc_id"].dataType.simpleString()
    marks = ["doc_id", "text_key", "fp", "sig", "n", *ODD]
    parts = ["chunk", "bucket", "low", "step", "high"]

    def sent(doc_type, sets: list[np.ndarray], sigs: list[int]) -> pa.RecordBatch:
        sizes = np.array([len(x) for x in sets], np.int64)
        shingles, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        bucket = (shingles >> np.uint64(64 - bits)).astype(np.uint16)
        order = np.argsort(bucket, kind="stable")  # a bucket's texts stay in order
        at, starts = np.unique(bucket[order], return_index=True)
        cuts = np.append(starts, len(order))
        owner = owner[order]
        step = np.diff(owner, prepend=0)
        step[starts] = owner[starts]
        low = ((shingles[order] << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
        one = np.array([0, len(sets)])
        head = [packed(np.array(sigs, np.uint64), one), packed(sizes, one), pa.array([b""])]
        body = [packed(low, cuts), packed((step & 255).astype(np.uint8), cuts), packed((step >> 8).astype(np.uint8), cuts)]
        chunk, rows = uuid.uuid4().int >> 65, len(at) + 1
        arrays = [pa.array(np.full(rows, chunk)), pa.array(np.append(-1, at.astype(np.int64))), *[pa.concat_arrays([h, b]) for h, b in zip(head, body)]]
        nulls = [pa.nulls(rows, doc_type), *[pa.nulls(rows, pa.int64())] * (len(marks) - 1)]
        return pa.RecordBatch.from_arrays([*nulls, *arrays], [*marks, *parts])

    def run(batches):
        cache = WordHash(200_000)
        sets, names, held, doc_type = [], [], 0, None
        for batch in chain.from_iterable(map(slices, batches)):
            doc_type = batch.column(0).type
            fps, sigs, sizes, odd = [], [], [], []
            for text in batch.column(2).to_pylist():
                own = shingle_set(text, cache)
                fps.append(fingerprint(text, NEAR_SHINGLE))
                sigs.append(xxhash.xxh3_64_intdigest(own.tobytes()))
                sizes.append(len(own))
                odd.append(parities(own))
                if sets and (held + len(own) > CHUNK or len(sets) >= CHUNK_TEXTS):
                    yield sent(doc_type, sets, names)
                    sets, names, held = [], [], 0
                sets.append(own)
                names.append(sigs[-1])
                held += len(own)
            long = lambda v: pa.array(np.array(v, np.uint64).view(np.int64))
            words = map(pa.array, np.ascontiguousarray(np.array(odd, np.int64).reshape(-1, len(ODD)).T))
            none = [pa.nulls(len(fps), t) for t in (pa.int64(), pa.int64(), *[pa.binary()] * 3)]
            arrays = [batch.column(0), batch.column(1), long(fps), long(sigs), long(sizes), *words, *none]
            yield pa.RecordBatch.from_arrays(arrays, [*marks, *parts])
        if sets:
            yield sent(doc_type, sets, names)
        sets = None
        give_back()

    schema = f"doc_id {kind}, text_key long, fp long, sig long, n long, {LONGS}, chunk long, bucket long, low binary, step binary, high binary"
    return texts.select("doc_id", "text_key", "text").mapInArrow(run, schema)


def _repeated(table: pa.Table) -> pa.Table:
    """What chunks send to one bucket -> for each of them the shingles that more rows have (low), the places of their
    texts in the chunk, and the numbers of rows."""
    low, count = unpacked(table["low"], np.uint32)
    step = unpacked(table["step"], np.uint8)[0] + 256 * unpacked(table["high"], np.uint8)[0].astype(np.int64)
    row, starts = np.repeat(np.arange(len(count)), count), np.cumsum(count) - count
    place = np.cumsum(step)
    place -= (place[starts] - step[starts])[row]
    _, which, rows = np.unique(low, return_inverse=True, return_counts=True)
    rows = rows[which]
    more = rows > 1
    cuts = np.append(0, np.cumsum(np.bincount(row[more], minlength=len(count))))
    out = [table["chunk"].combine_chunks(), table["bucket"].combine_chunks(), packed(low[more], cuts), packed(place[more].astype(np.uint16), cuts), packed(rows[more].astype(np.uint32), cuts)]
    return pa.Table.from_arrays(out, ["chunk", "bucket", "low", "place", "rows"]).filter(pa.array(np.diff(cuts) > 0))


def _firsts(table: pa.Table) -> pa.Table:
    """What one chunk gets back, and its bucket -1 -> sig, n, alone (shingles that no other row has) and firsts (those of
    its first shingles that other rows have, in order) of texts that have some."""
    bucket = table["bucket"].to_numpy()
    head = int(np.nonzero(bucket < 0)[0][0])
    sig, size = np.frombuffer(table["low"][head].as_py(), np.int64), np.frombuffer(table["place"][head].as_py(), np.int64)
    table = table.filter(pa.array(bucket >= 0))
    low, count = unpacked(table["low"], np.uint32)
    text, rows = unpacked(table["place"], np.uint16)[0].astype(np.int64), unpacked(table["rows"], np.uint32)[0]
    shingle = np.repeat(table["bucket"].to_numpy(), count) << 32 | low
    order = np.lexsort((shingle, rows, text))
    text, shingle = text[order], shingle[order]
    shared = np.bincount(text, minlength=len(size))
    alone = size - shared
    wanted = np.array([prefix_length(k) for k in size.tolist()], np.int64) - alone
    shingle = shingle[np.arange(len(text)) - (np.cumsum(shared) - shared)[text] < wanted[text]]
    some = (wanted > 0) & (shared > 0)
    cuts = np.append(0, np.cumsum(np.clip(np.minimum(wanted, shared), 0, None)[some]))
    return pa.Table.from_arrays([pa.array(sig[some]), pa.array(size[some]), pa.array(alone[some]), packed(shingle, cuts)], ["sig", "n", "alone", "firsts"])


def first_shingles(marks: DataFrame) -> DataFrame:
    """``shingle_marks`` -> sig, alone, firsts for each set that may have a similar one."""
    sent = marks.where("bucket >= 0").select("chunk", "bucket", "low", "step", "high")
    back = sent.groupBy("bucket").applyInArrow(_repeated, "chunk long, bucket long, low binary, place binary, rows binary")
    heads = marks.where("bucket < 0").select("chunk", "bucket", "low", F.col("step").alias("place"), F.col("high").alias("rows"))
    lists = back.unionByName(heads).groupBy("chunk").applyInArrow(_firsts, "sig long, n long, alone long, firsts binary")
    return lists.groupBy("sig").agg(F.first("alone").alias("alone"), F.first("firsts").alias("firsts"))


def _entries(batches):
    """(sig, root, n, parities, alone, firsts) -> a row for each of the first shingles, with its place and the one before it
    (the first one that other rows have has the set's own sig there)."""
    for batch in chain.from_iterable(map(slices, batches)):
        firsts = [np.frombuffer(b, np.int64) for b in batch.column(batch.num_columns - 1).to_pylist()]
        count = [len(x) for x in firsts]
        *spread, alone = [np.repeat(batch.column(k).to_numpy(), count) for k in range(batch.num_columns - 1)]
        place = np.concatenate([np.arange(c) for c in count]).astype(np.int64)
        shingle = np.concatenate(firsts)
        before = np.where(place > 0, np.roll(shingle, 1), spread[0])
        yield pa.RecordBatch.from_arrays([pa.array(shingle), *map(pa.array, spread), pa.array(alone + place), pa.array(before)], ["shingle", "sig", "root", "n", *ODD, "place", "before"])
    give_back()


def _meetings(few: int | None = None):
    """(shingle, sig, root, n, parities, place, before), sorted by shingle and n -> pairs of sets that may be similar, of different
    roots; or, sorted by shingle in any order, those among each one and the next ``few``."""

    def pairs(table):
        key, sig, root, n, *odd, place, before = (c.to_numpy() for c in table.columns)
        alive, lag = np.nonzero(key[:-1] == key[1:])[0], 1
        while len(alive) and (few is None or lag <= few):
            a, b = alive, alive + lag
            if few is None:  # sizes grow with the lag
                alive = alive[n[a] * NEAR[1] >= n[b] * NEAR[0]]
                a, b = alive, alive + lag
            # where this is the first shingle they share, at most so many are; elsewhere the first one's file has the pair
            most = np.minimum(n[a] - place[a], n[b] - place[b])
            may = (root[a] != root[b]) & (most * (NEAR[0] + NEAR[1]) >= NEAR[0] * (n[a] + n[b]))
            if few is None:
                may &= before[a] != before[b]
            a, b = a[may], b[may]
            differ = sum(np.bitwise_count((x[a] ^ x[b]).view(np.uint64)).astype(np.int64) for x in odd)
            may = differ * (NEAR[0] + NEAR[1]) <= (NEAR[1] - NEAR[0]) * (n[a] + n[b])
            if may.any():
                x, y = sig[a[may]], sig[b[may]]
                both = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])
            lag += 1
            alive = alive[alive + lag < len(key)]
            alive = alive[key[alive] == key[alive + lag]]

    def run(batches):
        held: pa.Table | None = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            key = held.column(0).to_numpy()
            cut = np.nonzero(key != key[-1])[0]  # the last file may go on
            if len(held) >= 50_000 and len(cut):
                yield from pairs(held.slice(0, int(cut[-1]) + 1))
                held = held.slice(int(cut[-1]) + 1)
        if held is not None and len(held):
            yield from pairs(held)
        held = None
        give_back()

    return run


def in_blocks(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with the block in which they are compared; ``sizes``: sig and chars of their texts.

    Pairs go to the least set that is near both. What goes there is cut into parts of ``PART_TEXTS`` and ``PART_CHARS`` on
    average, and a block holds pairs between two of them: a text is sent once for each part that it has pairs with, not for
    each pair."""
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("b"), F.least("a", "m").alias("m"))
    near = both.join(near, "b").groupBy("a").agg(F.min("m").alias("m"))
    of = lambda c: near.select(F.col("a").alias(c), F.col("m").alias(f"near_{c}"))
    keyed = stored(pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", F.least("near_a", "near_b").alias("key")), "near-keys")
    there = keyed.select("key", F.col("a").alias("sig")).union(keyed.select("key", "b")).distinct().join(sizes, "sig")
    parts = there.groupBy("key").agg(F.ceil(F.greatest(F.count(F.lit(1)) / PART_TEXTS, F.sum("chars") / PART_CHARS, F.lit(1))).alias("parts"))
    parts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).join(parts, "key")
    x, y = (F.pmod(F.xxhash64(c), "parts") for c in ("a", "b"))
    block = F.xxhash64("key", F.least(x, y), F.greatest(x, y)).alias("block")
    out = stored(joined_by_key(keyed, parts, "key", "n", keyed.count()).select(block, "a", "b"), "near-blocks")
    dropped(keyed)
    return out


def _compared(batches):
    """(block, a, b, text), sorted by block, the texts (of a; b is null) before the pairs -> the pairs that are similar."""
    cache, block, known = WordHash(200_000), None, {}
    for batch in chain.from_iterable(map(slices, batches)):
        keep = []
        for at, a, b, text in zip(*(c.to_pylist() for c in batch.columns)):
            if at != block:
                block, known = at, {}
            if b is None:
                known[a] = shingle_set(text, cache)
            keep.append(b is not None and similar(known[a], known[b]))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    known = None
    give_back()


def verified(pairs: DataFrame, sets: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b: sig) whose whole texts are similar. ``sets``: sig and text_key of one text that has it."""
    pairs = stored(pairs.where("a <> b").distinct(), "near-pairs")
    wanted = pairs.select(F.col("a").alias("sig")).union(pairs.select("b")).distinct().join(sets.select("sig", F.col("text_key").alias("_key")), "sig")
    whole = texts.select("text_key", "text").join(wanted, F.col("text_key") == F.col("_key")).groupBy("sig").agg(F.first("text").alias("text"))
    whole = stored(whole.select("sig", F.coalesce(F.length("text"), F.lit(0)).alias("chars"), "text"), "near-texts")
    blocks = in_blocks(pairs, whole.select("sig", "chars"))
    sent = blocks.select("block", F.col("a").alias("sig")).union(blocks.select("block", "b")).distinct().join(whole, "sig")
    rows = sent.select("block", F.col("sig").alias("a"), F.lit(None).cast("long").alias("b"), "text")
    rows = rows.unionByName(blocks.select("block", "a", "b", F.lit(None).cast("string").alias("text")))
    rows = rows.repartition("block").sortWithinPartitions("block", F.col("b").isNotNull())
    out = stored(rows.mapInArrow(_compared, "a long, b long"), "near-links")
    dropped(pairs, whole, blocks)
    return out


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_key and root (what the rows of a group have in common) for every row: groups by exact similarity."""
    texts = docs.select(F.col(quoted(doc_id)).alias("doc_id"), F.xxhash64(quoted(text)).alias("text_key"), F.col(quoted(text)).alias("text"))
    every = stored(shingle_marks(texts, bucket_bits(texts)), "near-chunks")
    marks = stored(every.where("chunk IS NULL").select("doc_id", "text_key", "fp", "sig", "n", *ODD), "near-marks")
    lists = stored(first_shingles(every), "near-firsts")
    dropped(every)
    sets = stored(marks.groupBy("sig").agg(F.min("text_key").alias("text_key"), F.min("fp").alias("fp"), *[F.first(c).alias(c) for c in ("n", *ODD)]), "near-sets")
    # what fingerprints link, by the least set of each fingerprint
    least = stored(sets.groupBy("fp").agg(F.min("sig").alias("low")), "near-fingerprints")
    of = lambda c: least.select(F.col("fp").alias(c), F.col("low").alias(f"low_{c}"))
    first = sets.join(least, "fp").select(F.col("sig").alias("a"), F.col("low").alias("b"))
    first = first.unionByName(links(least.select("fp")).join(of("a"), "a").join(of("b"), "b").select(F.col("low_a").alias("a"), F.col("low_b").alias("b")))
    found = [verified(first, sets, texts)]
    groups = lambda: components(reduce(DataFrame.unionByName, found)).withColumnRenamed("node", "sig")

    def met(few: int | None, *order) -> DataFrame:
        rooted = lists.join(sets, "sig").join(groups(), "sig", "left").select("sig", F.coalesce("root", "sig").alias("root"), "n", *ODD, "alone", "firsts")
        entries = rooted.mapInArrow(_entries, f"shingle long, sig long, root long, n long, {LONGS}, place long, before long")
        return entries.repartition("shingle").sortWithinPartitions("shingle", *order).mapInArrow(_meetings(few), "a long, b long")

    found.append(verified(met(FEW, F.xxhash64("sig", "shingle")), sets, texts))
    found.append(verified(met(None, "n", "sig"), sets, texts))
    roots = groups()
    dropped(sets, lists, least, *found)
    return marks.select("doc_id", "text_key", "sig").join(roots, "sig", "left").select("doc_id", "text_key", F.coalesce("root", "sig").alias("root"))


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near copies: that of the smallest id (null ids last), then of the least text hash; of rows
    equal in both, one. Rows without an id, or with one id and different texts, are documents of their own."""
    key, first_id, first_key = fresh(docs.columns, "key", "first_id", "first_key")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias(first_id), F.col("text_key").alias(first_key))
    first = near_copies(docs, doc_id, text).groupBy("root").agg(F.min(order).alias("r")).select(f"r.{first_id}", f"r.{first_key}")
    rows = docs.withColumn(key, F.xxhash64(quoted(text)))
    kept = rows.join(first, F.col(quoted(doc_id)).eqNullSafe(F.col(first_id)) & (F.col(key) == F.col(first_key)), "left_semi")
    return kept.dropDuplicates([doc_id, key]).drop(key)
