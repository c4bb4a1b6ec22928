"""Quality rules with line sequence labelling by a linear-chain conditional random field.

Each line gets a few yes/no features (length, symbols, separators, capitals, repetition, ...). A chain over the lines
of a text with the states content and boilerplate is decoded by Viterbi; the share of a text's characters that lie in
content lines decides: at least ``MIN_CONTENT`` keeps it, unless a base rule has failed.

The field is trained here, on all lines of a bounded sample of labelled documents (``SAMPLE`` at most go to the driver).
Lines have no labels, so these are made: lines of documents of low quality are boilerplate, and so are lines of good ones
that recur in the sample after ``RECURS`` or more different lines (licenses, footers; copies of a document repeat what
precedes, too); other lines of good documents are content. For every two good documents there is one more into which a
stretch of lines of a bad one is spliced, so that the chain learns where content begins and ends. Training maximises the
likelihood by gradient steps with forward-backward; chains are cut into pieces of ``PIECE`` lines for it. Since made
labels call some lines of good documents boilerplate, content's weight is then raised in steps of ``RAISE``, ``RAISES`` at
most, until the share ``KEEP`` of the good documents that pass the base rules is kept.

Base rules: fewer than 20 words, or over 30% of the words in 8-word windows that occur twice or more in the text.

Defined cases: null or empty text has no words and fails; a text of blank lines likewise; without labels a fixed
field of zero weights labels every line content; very long texts and lines are handled whole, in training too; repeated
rows and other columns have no effect on each other; null ids are never in the sample; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, U64, WordHash, chunks, covered, mixed, quoted, slices, windows, word_ids

SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
MIN_CONTENT = 0.5
#: Documents of the training sample at most, lines of a piece, different lines before one that recurs.
SAMPLE, PIECE, RECURS = 2000, 256, 3
#: Calibration on the sample.
KEEP, RAISE, RAISES = 0.9995, 0.25, 4
FEATURES = ("bias", "short", "medium", "long", "some symbols", "many symbols", "separators", "capitals", "repeats", "very repetitive", "seen before", "ends a sentence", "digits", "few letters", "exclaims", "legal", "opens the text", "closes the text")
CLOSES = FEATURES.index("closes the text")
#: Words of legal and navigation lines.
LEGAL = (b"license", b"copyright", b"rights reserved", b"cookie", b"privacy policy", b"terms of", b"newsletter", b"subscribe", b"log in", b"sign up")
_CAPS, _DIGITS, _ENDS = bytes(range(65, 91)), bytes(range(48, 58)), (b".", b"!", b"?", b":", b'"')
_LOWER = bytes(range(97, 123)) + bytes(range(128, 256))


def without(data: bytes, chars: bytes) -> int:
    return len(data) - len(data.translate(None, chars))


def line_features(line: bytes, words: list[bytes], seen: bool, first: bool) -> tuple[int, ...]:
    """Indices of the features that hold."""
    n, size = len(words), len(line)
    symbols, caps, distinct = without(line, SYMBOLS), without(line, _CAPS), len(set(words))
    on = [0, 1 if n < 5 else 2 if n < 15 else 3]
    if symbols:
        on.append(5 if symbols * 5 >= n else 4)
    if b" | " in line:
        on.append(6)
    if caps * 3 > size:
        on.append(7)
    if n > 3 and distinct * 10 < n * 6:
        on.append(9 if distinct * 10 < n * 3 else 8)
    if seen:
        on.append(10)
    if line.rstrip(WHITE).endswith(_ENDS):
        on.append(11)
    if without(line, _DIGITS) * 10 > size:
        on.append(12)
    if (caps + without(line, _LOWER)) * 2 < size:
        on.append(13)
    if line.count(b"!!") * 4 > n:
        on.append(14)
    low = line.lower()
    if any(w in low for w in LEGAL):
        on.append(15)
    if first:
        on.append(16)
    return tuple(on)


class LineField:
    """State 0 is boilerplate, 1 is content. emit: features x 2; step: 2 x 2; start: 2."""

    def __init__(self, emit=None, step=None, start=None):
        self.emit = np.zeros((len(FEATURES), 2)) if emit is None else np.asarray(emit, float)
        self.step = np.zeros((2, 2)) if step is None else np.asarray(step, float)
        self.start = np.zeros(2) if start is None else np.asarray(start, float)
        if emit is None:
            self.emit[0] = (0.0, 1.0)

    def parts(self) -> tuple:
        return self.emit.tolist(), self.step.tolist(), self.start.tolist()

    def scores(self, lines: list[tuple[int, ...]]) -> np.ndarray:
        return np.array([self.emit[list(f)].sum(0) for f in lines])

    def viterbi(self, scores: list[tuple[float, float]]) -> list[int]:
        """Best states; of equal paths the one with content later in the chain."""
        (s00, s01), (s10, s11) = self.step.tolist()
        a, b = self.start[0] + scores[0][0], self.start[1] + scores[0][1]
        back = []
        for e0, e1 in scores[1:]:
            from0, from1 = int(b + s10 >= a + s00), int(b + s11 >= a + s01)
            back.append((from0, from1))
            a, b = (b + s10 if from0 else a + s00) + e0, (b + s11 if from1 else a + s01) + e1
        state = int(b >= a)
        out = [state]
        for pair in reversed(back):
            state = pair[state]
            out.append(state)
        return out[::-1]

    def train(self, texts: list[list[tuple[int, ...]]], states: list[list[int]], rounds: int = 80, rate: float = 0.5, decay: float = 1e-3) -> None:
        """Gradient ascent with Adagrad on the conditional likelihood, each round over all texts."""
        batches = _batches(texts, states)
        total = sum(len(b.x) for b in batches)
        sums = [np.full_like(p, 1e-8) for p in (self.emit, self.step, self.start)]
        for _ in range(rounds if total else 0):
            grads = [np.zeros_like(p) for p in (self.emit, self.step, self.start)]
            for b in batches:
                for g, more in zip(grads, self._gradient(b)):
                    g += more
            for param, g, s in zip((self.emit, self.step, self.start), grads, sums):
                g = g / total - decay * param
                s += g * g
                param += rate * g / np.sqrt(s)

    def _gradient(self, b: _Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the likelihood: what the labels have less what the field expects."""
        live, pairs, longest = b.live, b.live[:, 1:, None, None], b.x.shape[1]
        e = b.x @ self.emit
        ahead, behind = np.zeros_like(e), np.zeros_like(e)
        ahead[:, 0] = self.start * b.first[:, None] + e[:, 0]
        for j in range(1, longest):
            new = np.logaddexp.reduce(ahead[:, j - 1, :, None] + self.step, axis=1) + e[:, j]
            ahead[:, j] = np.where(live[:, j, None], new, ahead[:, j - 1])
        for j in range(longest - 2, -1, -1):
            new = np.logaddexp.reduce(self.step + (e[:, j + 1] + behind[:, j + 1])[:, None, :], axis=2)
            behind[:, j] = np.where(live[:, j + 1, None], new, 0)
        z = np.logaddexp.reduce(ahead[:, -1], axis=1)
        p = np.exp(ahead + behind - z[:, None, None]) * live[..., None]
        pp = np.exp(ahead[:, :-1, :, None] + self.step + (e[:, 1:] + behind[:, 1:])[:, :, None, :] - z[:, None, None, None]) * pairs
        gold_step = np.einsum("ijk,ijl->kl", b.gold[:, :-1] * live[:, 1:, None], b.gold[:, 1:])
        return np.einsum("ijf,ijk->fk", b.x, b.gold - p), gold_step - pp.sum((0, 1)), ((b.gold - p)[:, 0] * b.first[:, None]).sum(0)


class _Batch:
    """Pieces of chains, padded to one length: features, labels as two columns, which lines exist, which piece is a first."""

    def __init__(self, pieces: list[tuple[list[tuple[int, ...]], list[int], bool]]):
        longest = max(len(t) for t, _, _ in pieces)
        self.x = np.zeros((len(pieces), longest, len(FEATURES)))
        self.gold = np.zeros((len(pieces), longest, 2))
        self.live = np.zeros((len(pieces), longest), bool)
        self.first = np.array([f for _, _, f in pieces], float)
        for i, (text, states, _) in enumerate(pieces):
            for j, (f, s) in enumerate(zip(text, states)):
                self.x[i, j, list(f)] = 1
                self.gold[i, j, s] = 1
            self.live[i, : len(text)] = True


def _batches(texts, states) -> list[_Batch]:
    """Pieces of about equal length together."""
    by_size: dict[int, list] = {}
    for text, state in zip(texts, states):
        for at in range(0, len(text), PIECE):
            piece = (text[at : at + PIECE], state[at : at + PIECE], at == 0)
            by_size.setdefault(len(piece[0]).bit_length(), []).append(piece)
    return [_Batch(pieces[k : k + 2000]) for _, pieces in sorted(by_size.items()) for k in range(0, len(pieces), 2000)]


def text_lines(data: bytes) -> tuple[list[tuple[int, ...]], list[int], int]:
    """Features and sizes (bytes) of the lines with a word, and how many equal an earlier line."""
    feats, sizes, dup, seen = [], [], 0, set()
    for line in data.split(b"\n"):
        words = line.split()
        if words:
            again = line in seen
            dup += again
            seen.add(line)
            feats.append(line_features(line, words, again, not feats))
            sizes.append(len(line))
    if feats:
        feats[-1] += (CLOSES,)
    return feats, sizes, dup


def line_labels(docs: list[tuple[int, list[tuple[int, ...]], list[int]]]) -> tuple[list, list]:
    """(quality, features of lines, hashes of lines) of documents -> chains and their states, spliced ones too."""
    before: dict[int, set[int]] = {}
    for quality, _, hashes in docs:
        if quality == 1:
            for last, line in zip([0, *hashes], hashes):
                before.setdefault(line, set()).add(last)
    texts = [feats for _, feats, _ in docs]
    states = [[int(quality == 1 and len(before[h]) < RECURS) for h in hashes] for quality, _, hashes in docs]
    good = [k for k, (quality, feats, _) in enumerate(docs) if quality == 1 and len(feats) > 1]
    bad = [k for k, (quality, feats, _) in enumerate(docs) if quality != 1 and feats]
    for n, k in enumerate(good[::2] if bad else []):
        host, guest = texts[k], bad[n % len(bad)]
        at = 1 + (n * 7919) % len(host)
        some = slice(0, 1 + (n * 104_729) % min(len(texts[guest]), len(host)))
        texts.append(host[:at] + texts[guest][some] + host[at:])
        states.append(states[k][:at] + states[guest][some] + states[k][at:])
    return texts, states


def content_share(field: LineField, lines: list[tuple[int, ...]], sizes) -> float:
    """The share of the bytes of a text's lines that lie in content lines."""
    states = field.viterbi([tuple(x) for x in field.scores(lines).tolist()]) if lines else []
    return sum(s for s, k in zip(sizes, states) if k) / max(1, sum(sizes))


def calibrated(field: LineField, good: list[tuple[list[tuple[int, ...]], list[int]]], min_content: float = MIN_CONTENT) -> LineField:
    """``field`` with content's weight raised until ``good`` (features and sizes of lines) are kept."""
    for _ in range(RAISES):
        if sum(content_share(field, lines, sizes) >= min_content for lines, sizes in good) >= KEEP * len(good):
            break
        field.emit[0, 1] += RAISE
    return field


def trained_field(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text: str = "text", doc_id: str = "doc_id") -> LineField:
    """A field fitted on at most ``sample`` labelled documents, taken in order of a hash of the id."""
    known = labels.where("quality IS NOT NULL").select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    rows = docs.select(F.col(quoted(doc_id)).alias("_doc"), F.col(quoted(text)).alias("_text")).join(F.broadcast(known), F.col("_doc") == F.col("_id"))

    def features(batches):
        cache = WordHash()
        for batch in chain.from_iterable(map(slices, batches)):
            packed, hashes, bytes_, passed = [], [], [], []
            for t in batch.column(0).to_pylist():
                data = (t or "").encode()
                words = data.split()
                feats, sizes, _ = text_lines(data)
                packed.append(b"".join(bytes((len(f), *f)) for f in feats))
                hashes.append(np.array([xxhash.xxh3_64_intdigest(x) for x in data.split(b"\n") if x.split()], np.uint64).tobytes())
                bytes_.append(np.array(sizes, np.uint64).tobytes())
                repeats = repeat_words([word_ids(words, cache)])[0]
                passed.append(bool(len(words) >= MIN_WORDS and 100 * repeats <= MAX_REPEAT_PERCENT * len(words)))
            arrays = [pa.array(x, pa.binary()) for x in (packed, hashes, bytes_)]
            yield pa.RecordBatch.from_arrays([batch.column(1), *arrays, pa.array(passed)], ["quality", "lines", "hashes", "sizes", "passed"])

    got = rows.select("_text", "quality").mapInArrow(features, "quality int, lines binary, hashes binary, sizes binary, passed boolean").collect()
    made, good = [], []
    for quality, packed, hashes, sizes, passed in sorted((r.quality, bytes(r.lines), bytes(r.hashes), bytes(r.sizes), r.passed) for r in got):
        lines, at = [], 0
        while at < len(packed):
            lines.append(tuple(packed[at + 1 : at + 1 + packed[at]]))
            at += 1 + packed[at]
        made.append((quality, lines, np.frombuffer(hashes, np.uint64).tolist()))
        if quality == 1 and passed:
            good.append((lines, np.frombuffer(sizes, np.uint64).tolist()))
    field = LineField()
    field.train(*line_labels(made))
    return calibrated(field, good)


def quality_rules(docs: DataFrame, field: LineField, text: str = "text", doc_id: str = "doc_id", min_content: float = MIN_CONTENT) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, content_lines, n_lines, content_share (by bytes of lines) for every row."""
    parts = field.parts()

    def run(batches):
        crf, cache = LineField(*parts), WordHash()
        emit, memo = crf.emit, {}

        def score(f):
            if (s := memo.get(f)) is None:
                s = memo[f] = tuple(emit[list(f)].sum(0).tolist())
            return s

        for rows in chunks(batches, 2_000_000, lambda r: len(r[1] or "")):
            out, ids = [], []
            for doc, body in rows:
                body = body or ""
                data = body.encode()
                words = data.split()
                ids.append(word_ids(words, cache))
                feats, sizes, dup = text_lines(data)
                states = crf.viterbi([score(f) for f in feats]) if feats else []
                inside = sum(s for s, k in zip(sizes, states) if k)
                white = without(data, WHITE)
                out.append([doc, len(words), len(body) - white, without(data, SYMBOLS), dup, sum(states), inside / sum(sizes) if sizes else 0.0, len(sizes)])
            repeats = repeat_words(ids)
            cols = list(zip(*out))
            n = np.array(cols[1])
            failed = (n < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n)
            kept = ~failed & (np.array(cols[6]) >= min_content)
            long = lambda v: pa.array(v, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], kind), long(cols[1]), long(cols[2]), long(cols[3]), long(cols[4]), long(repeats), pa.array(failed), pa.array(kept), long(cols[5]), long(cols[7]), pa.array(cols[6], pa.float64())],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_lines", "n_lines", "content_share"],
            )

    rows = docs.select(F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(text)).alias("text"))
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(rows.schema["doc_id"].dataType)
    name = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {name}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_lines long, n_lines long, content_share double")


def repeat_words(ids: list[np.ndarray]) -> np.ndarray:
    """For each text, the words in windows that occur twice or more in it."""
    sizes = np.array([len(i) for i in ids], np.int64)
    out = np.zeros(len(ids), np.int64)
    flat = np.concatenate(ids) if ids else np.empty(0, U64)
    keys = windows(flat, WINDOW)
    if not len(keys):
        return out
    doc = np.repeat(np.arange(len(ids)), sizes)
    start = np.nonzero(doc[: len(keys)] == doc[WINDOW - 1 :])[0]  # windows within one text
    with np.errstate(over="ignore"):
        keys = keys[start] ^ mixed(doc[start].astype(U64) + U64(1))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    again = np.zeros(len(keys), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    mask = covered(start[again], WINDOW, len(flat))
    return np.bincount(doc[mask], minlength=len(ids)).astype(np.int64)
