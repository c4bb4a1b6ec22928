"""Byte-level BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a piece of text there is one last token of its encoding. It is found among the tokens that end
there: an automaton of the vocabulary's suffix matches (a trie of the tokens whose states have failure links to their
longest suffixes; no state for inner substrings of tokens, which match nothing) lists them, and token t is the last one if
the last token stored for the prefix before t may stand next to t, that is, if BPE run over the bytes of both gives
just the two again. Following back from the whole piece through the stored last tokens emits the ids. Each byte of a
piece is handled once, with at most as many tests as there are tokens that end in it, so a piece of any length takes
linear time and no merge queue.

Whether two tokens may be neighbours is tested by undoing merges on the side that was merged later, and looking for a
pair across the seam that would have been merged earlier than that; results are remembered.

Pieces come from the tokenizer file's own pre-tokenizer pattern; added tokens are cut out before. The file is read on
each worker, from a path that is a parameter.

Defined cases: null text is the empty text (no ids, decoded empty); other columns pass through, whatever their names; empty tables and
repeated rows need nothing special. Texts are handled whole.
"""

from __future__ import annotations

import gc
import hashlib
import json
from array import array
from itertools import accumulate, chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import quoted, with_columns

#: Fixed value: the split pattern of byte-level pre-tokenizers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: What a worker remembers at most: ids of words between spaces, ids of pieces, tests of neighbours, beginnings of pieces.
#: Longer ones aren't kept.
WORDS, PIECES, SEAMS, HEADS, LONGEST = 200_000, 100_000, 200_000, 100_000, 64
#: Texts held as Python objects at a time.
ROWS = 256
#: Bytes of a beginning: pieces that share it share its states and last tokens.
HEAD = 6


_WIDE = regex.compile(r" \s|\s ").search


def byte_of_letter() -> dict[str, int]:
    """The letters that stand for bytes: printable ones for themselves, the rest from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte, model = byte_of_letter(), spec["model"]
        if model["type"] != "BPE" or spec.get("normalizer") or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("only byte-level BPE without normalizer and prefix space is supported")
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        vocab = model["vocab"]
        # nodes: the 256 bytes (rank = byte), then one for each merge in order of rank; node numbers compare as ranks
        names = [*({b: c for c, b in to_byte.items()}[b] for b in range(256))]
        node = {n: i for i, n in enumerate(names)}
        halves, pairs = array("i", [i for b in range(256) for i in (b, b)]), array("i")
        for pair in model["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            if (made := a + b) not in node:
                node[made] = len(names)
                names.append(made)
                halves.extend((node[a], node[b]))
            pairs.extend((node[a], node[b], node[made]))
        ids, length = array("i", [vocab[n] for n in names]), array("i", map(len, names))
        spelled = bytes(to_byte[c] for n in names for c in n)
        known = {s for s in vocab if s not in self.added}
        more = {vocab[s]: bytes(to_byte[c] for c in s) for s in known - set(names)}
        # the file's own objects go before the tables are made, else they would be scattered among them
        del spec, model, vocab, names, node, known
        self.id_of, self.length = ids.tolist(), length.tolist()
        self.halves = halves
        self.merge: dict[int, int] = {}
        for k in range(0, len(pairs), 3):
            self.merge.setdefault(pairs[k] << 20 | pairs[k + 1], pairs[k + 2])
        ends = [0, *accumulate(length)]
        words = [spelled[i:j] for i, j in zip(ends, ends[1:])]
        self.text_of = dict(zip(self.id_of, words)) | more | {i: s.encode() for s, i in self.added.items()}
        self._automaton(words)
        self.fits: dict[int, bool] = {}
        self.goto: dict[int, int] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.heads: dict[bytes, tuple[int, list[int]]] = {}
        self.decimal = [str(i) for i in range(max(self.text_of) + 1)]
        self.split = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.added, key=len, reverse=True)) + ")").split if self.added else None

    def _automaton(self, words: list[bytes]) -> None:
        """A trie of the tokens with failure links; ends[state]: the tokens that end there, longest first."""
        step: dict[int, int] = {}  # state << 8 | byte -> state
        own, below = array("i", [-1]), [b""]
        for number, word in enumerate(words):
            at = 0
            for b in word:
                if (to := step.get(at << 8 | b)) is None:
                    to = step[at << 8 | b] = len(own)
                    own.append(-1)
                    below.append(b"")
                    below[at] += bytes((b,))
                at = to
            own[at] = number
        fail, ends, queue = array("i", bytes(4 * len(own))), [()] * len(own), array("i", [step[b] for b in below[0]])
        for at in queue:
            ends[at] = (own[at], *ends[fail[at]]) if own[at] >= 0 else ends[fail[at]]
            for b in below[at]:
                back, to = fail[at], step[at << 8 | b]
                while back and back << 8 | b not in step:
                    back = fail[back]
                fail[to] = step.get(back << 8 | b, 0)
                queue.append(to)
        self.step, self.fail, self.ends = step, fail, ends

    def may_follow(self, left: int, right: int) -> bool:
        """Whether BPE over both tokens' bytes gives the two tokens again."""
        if len(self.fits) >= SEAMS:
            self.fits.clear()
        found = self.fits[left << 20 | right] = self._seam_holds(left, right)
        return found

    def _next(self, state: int, b: int) -> int:
        at = state
        while at and at << 8 | b not in self.step:
            at = self.fail[at]
        if len(self.goto) >= SEAMS:
            self.goto.clear()
        to = self.goto[state << 8 | b] = self.step.get(at << 8 | b, 0)
        return to

    def _seam_holds(self, left: int, right: int) -> bool:
        # ``before``: a merge over the seam counts only if its rank is lower than this one's
        before = len(self.length)
        while True:
            over = self.merge.get(left << 20 | right)
            if over is not None and over < before:
                return False
            if left < 256 and right < 256:
                return True
            # undo the later merge; of equal tokens the right one, since BPE merges from the left
            if left > right:
                before, left = left, self.halves[2 * left + 1]
            else:
                before, right = right + 1, self.halves[2 * right]

    def _extend(self, last: list[int], state: int, more: bytes) -> int:
        """Append to ``last`` the last token of each prefix that ends in ``more``; the automaton's state after it."""
        goto, fits, ends, length, add, end = self.goto.get, self.fits.get, self.ends, self.length, last.append, len(last)
        for b in more:
            end += 1
            if (to := goto(state << 8 | b)) is None:
                to = self._next(state, b)
            state = to
            for token in ends[state]:
                start = end - length[token]
                if start:
                    left = last[start - 1]
                    if (fit := fits(left << 20 | token)) is None:
                        fit = self.may_follow(left, token)
                    if not fit:
                        continue
                add(token)
                break
        return state

    def _new_head(self, head: bytes) -> tuple[int, list[int]]:
        last: list[int] = []
        if len(self.heads) >= HEADS:
            self.heads.clear()
        kept = self.heads[head] = self._extend(last, 0, head), last
        return kept

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        if len(piece) > HEAD:
            head = piece[:HEAD]
            state, known = self.heads.get(head) or self._new_head(head)
            last = known.copy()
            self._extend(last, state, piece[HEAD:])
        else:
            last = []
            self._extend(last, 0, piece)
        out, at, id_of, length = [], len(piece), self.id_of, self.length
        while at:
            token = last[at - 1]
            out.append(id_of[token])
            at -= length[token]
        out.reverse()
        return tuple(out)

    def _new_piece(self, piece: str) -> tuple[int, ...]:
        ids = self.encode_piece(piece.encode())
        if len(piece) <= LONGEST:
            if len(self.pieces) >= PIECES:
                self.pieces.clear()
            self.pieces[piece] = ids
        return ids

    def _run(self, text: str) -> tuple[int, ...]:
        known, new = self.pieces.get, self._new_piece
        return tuple(chain.from_iterable([known(p) or new(p) for p in self.split(text)]))

    def _new_word(self, word: str) -> tuple[int, ...]:
        # letters alone with their space are one piece
        ids = self.encode_piece((" " + word).encode()) if word.isalpha() else self._run(" " + word)
        if len(word) <= LONGEST:
            if len(self.words) >= WORDS:
                self.words.clear()
            self.words[word] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        """Ids of ``text``. A space between two characters that aren't white always begins a piece, so a text without
        other white next to its spaces falls apart into words that are encoded, and remembered, on their own."""
        ids: list[int] = []
        known, new = self.words.get, self._new_word
        for k, part in enumerate(self.cut(text) if self.cut else [text]):
            if k % 2:
                ids.append(self.added[part])
            elif part:
                if part[0] == " " or part[-1] == " " or _WIDE(part):
                    ids.extend(self._run(part))
                else:
                    first, *words = part.split(" ")
                    ids.extend(self._run(first))
                    ids.extend(chain.from_iterable([known(w) or new(w) for w in words]))
        return ids

    def decode(self, ids: list[int]) -> str:
        """Bytes of all tokens, read as UTF-8; what isn't UTF-8 becomes U+FFFD. Added tokens stay."""
        return b"".join(map(self.text_of.__getitem__, ids)).decode("utf-8", "replace")


def _tokenizer(path: str, at: int, digest: bool):
    """Ids and their number, or the number and digests, of the texts in column ``at``."""

    def made():
        gc.disable()  # nothing here makes cycles; the collector would walk what is remembered again and again
        bpe = None  # made for this partition only, and if it has rows: workers that wait for other tasks hold no tables
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

        def encoded(columns):
            nonlocal bpe
            bpe = bpe or ByteBPE(path)
            ids = [bpe.encode(t or "") for t in columns[at].to_pylist()]
            counts = pa.array([len(i) for i in ids], pa.int64())
            if not digest:
                return [pa.array(ids, pa.list_(pa.int32())), counts]
            return [counts, pa.array([sha(",".join(map(bpe.decimal.__getitem__, i))) for i in ids]), pa.array([sha(bpe.decode(i)) for i in ids])]

        return encoded

    return made


def encode_documents(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with token_ids (array<int>) and n_tokens (long); columns of these names are replaced."""
    docs = docs.drop("token_ids", "n_tokens")
    return with_columns(docs, _tokenizer(path, docs.columns.index(text), False), ROWS, token_ids="array<int>", n_tokens="bigint")


def token_digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids and of the text decoded from them."""
    docs = docs.selectExpr(f"{quoted(doc_id)} AS doc_id", f"{quoted(text)} AS text")
    return with_columns(docs, _tokenizer(path, 1, True), ROWS, "text", n_tokens="bigint", ids_sha256="string", decoded_sha256="string")
