"""Substring dedup by fixed-block anchors.

A window of 20 words that starts earlier elsewhere is a repeat, and its words are removed. Blocks of 10 words, laid
end to end in every text, are the anchors: a repeat of 20 words or more always holds a whole block of its other place.

1. Probe. Every 10-word window of every text, blocks marked, goes to the bucket of its hash. Where a bucket holds a
   block and another window of the same hash, all of these places are hits. About 7 bytes a window are shuffled, however
   many buckets there are: hash remainders and gaps between places within a chunk of texts, whose directory of texts
   goes once to the part where its hits meet again.
2. Extend. Hits grow to the words around them: only 20-word windows that hold a hit can be repeats. Each gets a
   96-bit key of its words and the first place of each key stays; the union of the others, window by window, is
   every maximal repeat, exactly.
3. Remove. Places go back to their texts by id and text hash, as hits do, and the kept words are joined.

A passage that a third of all texts share sends one entry for each chunk of texts (about a million words), not for each text:
repeats within a chunk are settled there. The number of buckets follows the number of words, so neither a bucket nor
the odds of a false hit grow with the input (false hits only cost work; step 2 checks all words). A chunk is cut into
``FANOUT`` buckets at most, and only those that get something are visited; where more are needed, tasks that each gather
the same buckets of many chunks cut them again. Each step ends in a table in the shared folder.

Defined cases: ids are whole numbers, or what a cast to long takes (their order is that of the documents; other ids are an
error); null text has no words and an empty kept text; texts of under 20 words are kept whole; equal rows with
one id count as one document, and both lose the same words; rows of one id with different texts are ordered by a hash
of the text; null ids come before all others; windows are judged on the input alone; other columns are not used;
an empty table gives an empty result; very long texts are handled whole, as chunks of their own.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, WordHash, chunks, covered, dropped, give_back, mixed, quoted, second_windows, stored, windows, word_ids

WINDOW, BLOCK = 20, 10
#: Bytes of text in a chunk, and windows for each bucket.
CHUNK, PER_BUCKET = 6_000_000, 1_000_000
#: Buckets at most that a chunk is cut into at once, and bytes that are gathered to be cut again.
FANOUT, GATHER = 4096, 96_000_000
#: Entries at most in a piece of what a chunk settles itself.
PIECE = 100_000
NULL_ID = -(1 << 63)
#: What a blob holds: entries with the rest of their hashes, with whole hashes, places that are settled, a directory.
REST, WHOLE, SETTLED, DIRECTORY = range(4)


def buckets_for(docs: DataFrame, text: str = "text") -> int:
    """Enough buckets that each has about ``PER_BUCKET`` windows (of words of 5 bytes)."""
    size = docs.agg(F.sum(F.octet_length(quoted(text)))).first()[0] or 0
    return 1 + size // (5 * PER_BUCKET)


def text_key(data: bytes) -> int:
    """What Spark's xxhash64 gives for the text; it tells rows of one id apart."""
    value = xxhash.xxh64_intdigest(data, 42)
    return value - (1 << 64) if value >> 63 else value


def _bucket(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> U64(32)) * U64(n) >> U64(32)).astype(np.int64)


def _places(ids: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words of some texts in a row, the text of each word, and the start of each text."""
    sizes = np.array([len(i) for i in ids], np.int64)
    flat = np.concatenate(ids) if ids else np.empty(0, U64)
    return flat, np.repeat(np.arange(len(ids)), sizes), np.cumsum(sizes) - sizes


def _packed(doc_key: np.ndarray, doc: np.ndarray, pos: np.ndarray, *columns: np.ndarray) -> bytes:
    """Entries as bytes: keys of the texts that occur, entries of each, positions as gaps, further columns."""
    first = np.nonzero(np.concatenate(([True], doc[1:] != doc[:-1])))[0]
    counts = np.diff(np.append(first, len(doc))).astype(np.uint32)
    gaps = np.diff(pos, prepend=0)
    gaps[first] = pos[first]
    wide = gaps.max(initial=0) > 0xFFFF
    head = struct.pack("<IIB", len(first), len(pos), int(wide))
    return b"".join([head, doc_key[doc[first]].tobytes(), counts.tobytes(), gaps.astype(np.uint32 if wide else np.uint16).tobytes(), *(c.tobytes() for c in columns)])


def _unpacked(blob: bytes, key_width: int, *kinds) -> tuple:
    """Keys of the texts, the text of each entry, positions, further columns."""
    docs, n, wide = struct.unpack_from("<IIB", blob)
    at = 9
    keys = np.frombuffer(blob, np.int64, docs * key_width, at).reshape(docs, key_width)
    at += keys.nbytes
    counts = np.frombuffer(blob, np.uint32, docs, at).astype(np.int64)
    at += 4 * docs
    gaps = np.frombuffer(blob, np.uint32 if wide else np.uint16, n, at).astype(np.int64)
    at += gaps.size * (4 if wide else 2)
    sums = np.cumsum(gaps)
    first = np.cumsum(counts) - counts
    base = np.where(first > 0, sums[first - 1], 0) if docs else first
    out = []
    for kind in kinds:
        out.append(np.frombuffer(blob, kind, n, at))
        at += out[-1].nbytes
    return (keys, np.repeat(np.arange(docs, dtype=np.int32), counts), (sums - np.repeat(base, counts)).astype(np.int32), *out)


def _joined(parts: list[tuple], key_width: int) -> list[np.ndarray]:
    """Unpacked entries in one: distinct keys in order, the number of each entry's key, positions, further columns."""
    if not parts:
        return [np.empty((0, key_width), np.int64), np.empty(0, np.int32), np.empty(0, np.int32)]
    keys = np.concatenate([p[0] for p in parts])
    order = np.lexsort([keys[:, k] for k in range(key_width - 1, -1, -1)])
    new = _new_docs(keys[order])
    number = np.empty(len(keys), np.int32)
    number[order] = np.cumsum(new) - 1
    base = np.cumsum([0, *(len(p[0]) for p in parts)])
    who = np.concatenate([number[b + p[1]] for b, p in zip(base, parts)])
    return [keys[order][new], who, *(np.concatenate(c) for c in zip(*(p[2:] for p in parts)))]


def _settled(doc_key: np.ndarray, doc: np.ndarray, pos: np.ndarray, n: int) -> list[tuple[int, bytes]]:
    """Entries that need no bucket, in pieces that are spread over all: none gets a large share of them."""
    out = []
    for at in range(0, len(doc), PIECE):
        d, p = doc[at : at + PIECE], pos[at : at + PIECE]
        blob = bytes((SETTLED,)) + _packed(doc_key, d, p)
        out.append((xxhash.xxh64_intdigest(blob) % n, blob))
    return out


def _table(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "blob"])


def _split(bucket: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Entries of each bucket that has some, in their order."""
    if not len(bucket):
        return []
    order = np.argsort(bucket.astype(np.uint16) if bucket.max() < 1 << 16 else bucket, kind="stable")
    sorted_ = bucket[order]
    ends = np.append(np.nonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1])))[0], len(order))
    return [(int(sorted_[x]), order[x:y]) for x, y in zip(ends, ends[1:])]


def _finer(n: int, width: int, *kinds):
    """Blobs of coarse buckets, of many chunks, to the ``n`` buckets themselves; what is settled passes."""

    def cut(parts):
        names, who, pos, keys, *more = _joined(parts, width)
        order = np.lexsort((pos, who))
        who, pos, keys, more = who[order], pos[order].astype(np.int64), keys[order], [m[order] for m in more]
        return _table([(b, bytes((WHOLE,)) + _packed(names, who[x], pos[x], keys[x], *(m[x] for m in more))) for b, x in _split(_bucket(keys, n))])

    def run(batches):
        parts, size = [], 0
        for batch in batches:
            for value in batch.column(1):
                blob = value.as_py()
                if blob[0] != WHOLE:
                    yield _table([(xxhash.xxh64_intdigest(blob) % n, blob)])
                    continue
                parts.append(_unpacked(blob[1:], width, *kinds))
                size += len(blob)
                if size >= GATHER:
                    yield cut(parts)
                    parts, size = [], 0
        if parts:
            yield cut(parts)
        parts = None
        give_back()

    return run


def _bucketed(entries: DataFrame, n: int, width: int, *kinds) -> DataFrame:
    """(bucket, blob) with ``n`` buckets, from what chunks were cut into."""
    if n <= FANOUT:
        return entries
    spread = F.pmod(F.xxhash64("blob"), F.lit(-(-n // FANOUT)))
    return entries.repartition("bucket", spread).mapInArrow(_finer(n, width, *kinds), "bucket long, blob binary")


def _repeated(keys: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In sorted order: which entries have a key in common with another, and which are the first of theirs."""
    s = keys[order]
    first = np.concatenate(([True], s[1:] != s[:-1]))
    last = np.concatenate((s[1:] != s[:-1], [True]))
    return ~(first & last), first


def _probe(n_buckets: int):
    """(id, text) -> per bucket: the chunk's directory, hits found within it, then its distinct 10-word windows."""
    fan = min(n_buckets, FANOUT)

    def run(batches):
        cache = WordHash(200_000)
        for rows in chunks(batches, CHUNK, lambda r: len(r[1] or "")):
            texts = [(r[1] or "").encode() for r in rows]
            doc_key = np.array([(NULL_ID if r[0] is None else r[0], text_key(t)) for r, t in zip(rows, texts)], np.int64).reshape(-1, 2)
            flat, doc, start = _places([word_ids(t.split(), cache) for t in texts], BLOCK)
            keys = windows(flat, BLOCK)
            if not len(keys):
                continue
            at = np.nonzero(doc[: len(keys)] == doc[BLOCK - 1 :])[0]
            keys, doc = keys[at], doc[at]
            if not len(keys):
                continue
            block = (at - start[doc]) % BLOCK == 0
            order = np.argsort(keys, kind="stable")
            again, first = _repeated(keys, order)
            group = np.cumsum(first) - 1
            anchored = np.bincount(group, weights=block[order]) > 0
            lone = order[first]  # the first place of each key; flags: a block among them (1), more than one (2)
            flags = anchored.astype(np.uint8) | (again[first].astype(np.uint8) << 1)
            back = np.argsort(lone, kind="stable")
            lone, flags = lone[back], flags[back]
            # the name of a chunk follows from its rows: a task that runs again gives it the same
            chunk = np.array([[xxhash.xxh3_64_intdigest(doc_key.tobytes())]], np.uint64).view(np.int64)
            of = np.zeros(len(at), np.int32)
            out = [(int(chunk[0, 0]) % n_buckets, bytes((DIRECTORY,)) + chunk.tobytes() + np.column_stack((doc_key, start)).tobytes())]
            for b, some in _split(_bucket(keys[lone], fan)):
                e = lone[some]
                if n_buckets > fan:
                    out.append((b, bytes((WHOLE,)) + _packed(chunk, of[e], at[e], keys[e], flags[some])))
                else:
                    out.append((b, bytes((REST,)) + _packed(chunk, of[e], at[e], keys[e].astype(np.uint32), flags[some])))
            local = np.sort(order[again])
            if len(local):  # settled here; any bucket passes them on
                out.extend(_settled(chunk, of[local], at[local], n_buckets))
            yield _table(out)
        cache = rows = texts = flat = doc = keys = out = None
        give_back()

    return run


PARTS = pa.schema([("part", pa.int64()), ("blob", pa.binary())])


def _new_docs(keys: np.ndarray) -> np.ndarray:
    """Where a text begins among sorted entries."""
    return np.concatenate(([True], (keys[1:] != keys[:-1]).any(1)))


def _dealt(done: list[tuple], n: int, width: int) -> list[tuple[int, bytes]]:
    """Places, packed for ``n`` parts of what they are places of (texts or chunks): as many rows at most."""
    names, who, pos = _joined(done, width)
    if not len(pos):
        return []
    part = np.zeros(len(names), U64)
    for k in range(width):  # many texts may lack an id, so all of the name counts
        part = mixed(part ^ mixed(names[:, k].astype(U64)))
    part = (part % U64(n)).astype(np.int64)
    order = np.lexsort((pos, who, part[who]))
    who, pos = who[order], pos[order].astype(np.int64)
    of = part[who]
    ends = np.append(np.nonzero(np.concatenate(([True], of[1:] != of[:-1])))[0], len(of))
    return [(int(of[x]), bytes((SETTLED,)) + _packed(names, who[x:y], pos[x:y])) for x, y in zip(ends, ends[1:])]


def _parts(rows: list[tuple[int, bytes]]) -> pa.Table:
    give_back()
    return pa.Table.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], schema=PARTS)


def _rows(keys: np.ndarray, who: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Keys that have places, and these (sorted, uint32) for each."""
    order = np.lexsort((pos, who))
    who, pos = who[order], pos[order].astype(np.uint32)
    ends = np.searchsorted(who, np.arange(len(keys) + 1))
    some = np.nonzero(ends[1:] > ends[:-1])[0]
    return keys[some], [pos[ends[k] : ends[k + 1]].tobytes() for k in some.tolist()]


def _texts(found: list[tuple[np.ndarray, list[bytes]]], column: str) -> pa.Table:
    keys = np.concatenate([k for k, _ in found]) if found else np.empty((0, 2), np.int64)
    return pa.Table.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array([b for _, bs in found for b in bs], pa.binary())], ["doc_key", "text_key", column])


def _places_of_texts(table: pa.Table) -> pa.Table:
    """One part's blobs to a row for each text."""
    return _texts([_rows(*_joined([_unpacked(b.as_py()[1:], 2) for b in table.column("blob")], 2))], "places")


def _hits_of_texts(table: pa.Table) -> pa.Table:
    """One part's directories, and the hits of their chunks, to a row for each text that has some."""
    directory, hits = {}, []
    for value in table.column("blob"):
        blob = value.as_py()
        if blob[0] == DIRECTORY:
            directory[int.from_bytes(blob[1:9], "little", signed=True)] = np.frombuffer(blob, np.int64, offset=9).reshape(-1, 3)
        else:
            hits.append(_unpacked(blob[1:], 1))
    names, who, pos = _joined(hits, 1)
    order = np.argsort(who, kind="stable")
    ends = np.searchsorted(who[order], np.arange(len(names) + 1))
    found = []
    for k, name in enumerate(names[:, 0].tolist()):
        texts, at = directory[name], pos[order[ends[k] : ends[k + 1]]].astype(np.int64)
        text = np.searchsorted(texts[:, 2], at, "right") - 1  # of those that start there the last, which isn't empty
        found.append(_rows(texts[:, :2], text, at - texts[text, 2]))
    return _texts(found, "hits")


def _hits(table: pa.Table, n: int) -> pa.Table:
    """One bucket's entries to the places of hits; directories go to the parts of their chunks."""
    fresh, done, rows = [], [], []
    for value in table.column("blob"):
        blob = value.as_py()
        if blob[0] == DIRECTORY:
            name = np.frombuffer(blob, np.int64, 1, 1)
            rows.append((int(mixed(mixed(name.astype(U64)))[0] % U64(n)), blob))
        elif blob[0] == SETTLED:
            done.append(_unpacked(blob[1:], 1))
        else:
            names, who, pos, rest, flag = _unpacked(blob[1:], 1, np.uint64 if blob[0] == WHOLE else np.uint32, np.uint8)
            fresh.append((names, who, pos, rest.astype(np.uint32), flag))
    if fresh:
        names, who, pos, rest, flag = _joined(fresh, 1)
        del fresh
        order = np.argsort(rest, kind="stable")
        again, first = _repeated(rest, order)
        group = np.cumsum(first) - 1
        anchored = np.bincount(group, weights=(flag & 1)[order]) > 0
        hit = np.sort(order[again & anchored[group]])
        done.append((names, who[hit], pos[hit]))
        del names, who, pos, rest, flag, order, again, first, group, anchored, hit
    return _parts(rows + _dealt(done, n, 1))


def _candidates(n_buckets: int):
    """(key, text, hits) -> per bucket: repeats found within the chunk, then the 20-word windows that hold a hit."""
    fan = min(n_buckets, FANOUT)

    def run(batches):
        cache = WordHash(200_000)
        for rows in chunks(batches, CHUNK, lambda r: len(r[1] or "")):
            texts = [(r[1] or "").encode() for r in rows]
            order = [(r[0], text_key(t)) for r, t in zip(rows, texts)]
            at = sorted(range(len(rows)), key=order.__getitem__)
            at = [i for n, i in enumerate(at) if not n or order[i] != order[at[n - 1]]]  # equal rows are one document
            doc_key = np.array([order[i] for i in at], np.int64).reshape(-1, 2)
            flat, doc, start = _places([word_ids(texts[i].split(), cache) for i in at], WINDOW)
            keys, more = windows(flat, WINDOW), second_windows(flat, WINDOW).astype(np.uint32)
            if not len(keys):
                continue
            hit = np.zeros(len(flat) + 1, np.int64)
            for n, i in enumerate(at):
                hit[start[n] + np.frombuffer(rows[i][2], np.uint32).astype(np.int64)] = 1
            upto = np.concatenate(([0], np.cumsum(hit)))
            begin = np.arange(len(keys))
            near = upto[begin + WINDOW - BLOCK + 1] > upto[begin]  # a 10-word window of it is a hit
            e = np.nonzero(near & (doc[: len(keys)] == doc[WINDOW - 1 :]))[0]
            if not len(e):
                continue
            keys, more, doc, pos = keys[e], more[e], doc[e], (e - start[doc[e]])
            order_ = np.lexsort((more, keys))  # stable: the first place in order comes first
            s, m = keys[order_], more[order_]
            first = np.concatenate(([True], (s[1:] != s[:-1]) | (m[1:] != m[:-1])))
            out = []
            gone = np.sort(order_[~first])
            lone = np.sort(order_[first])
            for b, some in _split(_bucket(keys[lone], fan)):
                x = lone[some]
                out.append((b, bytes((WHOLE,)) + _packed(doc_key, doc[x], pos[x], keys[x], more[x])))
            if len(gone):
                out.extend(_settled(doc_key, doc[gone], pos[gone], n_buckets))
            yield _table(out)
        cache = rows = flat = doc = keys = out = None
        give_back()

    return run


def _later(table: pa.Table, n: int) -> pa.Table:
    """One bucket's windows to the places of those that aren't the first of their key."""
    fresh, done = [], []
    for value in table.column("blob"):
        blob = value.as_py()
        if blob[0] == SETTLED:
            done.append(_unpacked(blob[1:], 2))
        else:
            fresh.append(_unpacked(blob[1:], 2, np.uint64, np.uint32))
    if fresh:
        names, who, pos, h, m = _joined(fresh, 2)
        del fresh
        order = np.lexsort((pos, who, m, h))
        h, m = h[order], m[order]
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (m[1:] != m[:-1])))
        del h, m
        who, pos = who[order], pos[order]
        first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))  # the first place of each one's key
        later = (who != who[first]) | (pos != pos[first])  # equal rows share it
        done.append((names, who[later], pos[later]))
        del names, who, pos, order, new, first, later
    return _parts(_dealt(done, n, 2))


def repeated_places(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_key, text_key and places (start words, uint32 bytes) of all 20-word windows that start earlier elsewhere."""
    rows = docs.select(F.col(quoted(doc_id)).cast("long").alias("doc_key"), F.col(quoted(text)).alias("text"))
    n = buckets_for(docs, text)
    probes = _bucketed(rows.mapInArrow(_probe(n), "bucket long, blob binary"), n, 1, np.uint64, np.uint8)
    found = probes.groupBy("bucket").applyInArrow(lambda t: _hits(t, n), "part long, blob binary")
    hits = stored(found.groupBy("part").applyInArrow(_hits_of_texts, "doc_key long, text_key long, hits binary"), "anchor-hits")
    # a stretch of hits has at most this many windows of 20 words about it
    about = hits.agg(F.sum(F.length("hits") / 4), F.count(F.lit(1))).first()
    m = 1 + int((about[0] or 0) + (WINDOW - BLOCK) * about[1]) // PER_BUCKET
    near = rows.withColumns({"doc_key": F.coalesce("doc_key", F.lit(NULL_ID)), "text_key": F.xxhash64("text")}).join(hits, ["doc_key", "text_key"]).select("doc_key", "text", "hits")
    entries = _bucketed(near.mapInArrow(_candidates(m), "bucket long, blob binary"), m, 2, np.uint64, np.uint32)
    found = entries.groupBy("bucket").applyInArrow(lambda t: _later(t, m), "part long, blob binary")
    out = stored(found.groupBy("part").applyInArrow(_places_of_texts, "doc_key long, text_key long, places binary"), "repeats")
    dropped(hits)
    return out


def _removed(batches):
    names = ["doc_id", "text", "n_words", "n_removed"]
    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            part = batch.slice(start, 500)
            kept, counts, gone = [], [], []
            for text, places in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                words = (text or "").encode().split()
                counts.append(len(words))
                if places:
                    at = np.frombuffer(places, np.uint32).astype(np.int64)
                    mask = covered(at, WINDOW, len(words))
                    words = [words[k] for k in np.nonzero(~mask)[0].tolist()]
                gone.append(counts[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(kept, pa.string()), pa.array(counts, pa.int64()), pa.array(gone, pa.int64())], names)


def _digested(batches):
    for batch in _removed(batches):
        sha = [hashlib.sha256(t.encode()).hexdigest() for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def dedup_substrings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """doc_id, text (the kept words joined by one space), n_words, n_removed for every row; or, with ``digest``, the
    kept text's SHA-256 (kept_sha256) in its place."""
    repeats = repeated_places(docs, doc_id, text)
    rows = docs.select(F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(text)).alias("text"))
    same = (F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)) == F.col("doc_key")) & (F.xxhash64("text") == F.col("text_key"))
    marked = rows.join(repeats, same, "left")
    marked = marked.select("doc_id", "text", "places")
    kind = rows.schema["doc_id"].dataType.simpleString()
    if digest:
        return marked.mapInArrow(_digested, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")
    return marked.mapInArrow(_removed, f"doc_id {kind}, text string, n_words long, n_removed long")
