"""SentencePiece encoding and decoding (operator 5) as a weighted finite-state transducer.

Three transducers are compiled from the model file on the driver and sent to the tasks as arrays:

* the normaliser writes a space for every space or U+2581 and one before each text (as the model asks);
* the pieces are a trie over characters with an output at every piece, and characters without a piece are spelt
  with the byte pieces (byte fallback);
* the merge order allows piece b after piece a, at no cost, if merging by score leaves the border between the two
  alone, and else at infinite cost in the tropical semiring. For a model of kind BPE this is what its scores mean.

Composing a text with them gives a lattice in which one path has finite cost to every position; the shortest path
is found position by position, for all distinct stretches of a run of documents at once. Pieces don't go over the
border of two characters where the second alone is a space, nor over a character without a piece, so texts are cut
there and equal stretches are encoded once. The ids are those of the library that the model is made for.

Defined results: a null or empty text has no ids. Decoding gives the normalised text: U+2581 comes back as a space.
Extra columns are not read; rows that repeat are encoded alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.llm.base import table
from creditloom.llm.passages import _list
from creditloom.llm.words import WORD_BASE, mix, range_hashes, slices

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
LONG = 96  # longer stretches are encoded one by one
SLICE = 4 << 20


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


class Pairs:
    """Map from pairs of small numbers to numbers, looked up for whole arrays; -1 where there is none."""

    def __init__(self, a: np.ndarray, b: np.ndarray, value: np.ndarray):
        bits = max(10, int(2 * len(value)).bit_length() + 1)
        self.mask = (1 << bits) - 1
        self.keys = np.full(self.mask + 1, -1, dtype=np.int64)
        self.values = np.full(self.mask + 1, -1, dtype=np.int32)
        for k, v in zip(((a.astype(np.int64) << 32) | b).tolist(), value.tolist()):
            at = self._slot(np.array([k]))[0]
            while self.keys[at] >= 0:
                at = (at + 1) & self.mask
            self.keys[at], self.values[at] = k, v

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (mix(key.view(np.uint64) if key.dtype == np.int64 else key.astype(np.uint64)) & np.uint64(self.mask)).astype(np.int64)

    def get(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.int64) << 32) | b
        at = self._slot(key)
        found = self.keys[at]
        out = np.where(found == key, self.values[at], np.int32(-1))
        todo = np.flatnonzero((found != key) & (found >= 0))
        at = at[todo]
        while len(todo):
            at = (at + 1) & self.mask
            found = self.keys[at]
            hit = found == key[todo]
            out[todo[hit]] = self.values[at[hit]]
            go = ~hit & (found >= 0)
            todo, at = todo[go], at[go]
        return out


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol-buffer message; fixed-width ones are passed over."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = message[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(message):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
        elif tag & 7 == 2:
            n = number()
            yield tag >> 3, message[at:at + n]
            at += n
        else:
            at += 4 if tag & 7 == 5 else 8


class Transducer:
    """The compiled model. Pieces are numbered anew: single characters first, then merged pieces by falling score."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        parts: dict[int, bytes] = {k: v for k, v in _fields(model.serialized_model_proto()) if k in (2, 3)}
        trainer, normaliser = dict(_fields(parts.get(2, b""))), dict(_fields(parts.get(3, b"")))
        if trainer.get(3, 1) != 2 or not trainer.get(35, 0):
            raise ValueError("only models of kind BPE with byte fallback can be compiled")
        if normaliser.get(2) or normaliser.get(4, 1):
            raise ValueError("only a normaliser without character rules that keeps spaces can be compiled")
        self.prefix = bool(normaliser.get(3, 1))
        ids = range(model.get_piece_size())
        self.bytes_at = np.zeros(256, dtype=np.int32)
        plain = []
        for i in ids:
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes_at[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                plain.append((len(piece) > 1, -model.get_score(i) if len(piece) > 1 else 0, i, piece))
        plain.sort()
        names = [p[3] for p in plain]
        order = {name: k for k, name in enumerate(names)}
        splits, alive = self._derive(names, order)
        if any(len(n) > 1 and SPACE in n[1:] and set(n) != {SPACE} and SPACE in n.lstrip(SPACE) for n in names):
            raise ValueError("a piece goes over the border of two words")
        self.ids = np.array([p[2] for p in plain], dtype=np.int32)
        self.left, self.right = np.array(splits, dtype=np.int64).T.copy()
        self.length = np.array([len(n) for n in names], dtype=np.int32)
        merges = [(order[n[:k]], order[n[k:]], i) for i, n in enumerate(names) for k in range(1, len(n)) if n[:k] in order and n[k:] in order]
        self.merges = Pairs(*(np.array(x) for x in zip(*merges)))
        self.merge_of = {(a, b): i for a, b, i in merges}
        # The trie: arcs (state, character class) -> state, and the piece that ends at a state.
        classes, self.classes = {}, np.full(0x110000, -1, dtype=np.int32)
        arcs, ends = {}, [-1]
        for i, name in enumerate(names):
            state = 0
            for c in name:
                k = classes.setdefault(c, len(classes))
                if (state, k) not in arcs:
                    arcs[state, k] = len(ends)
                    ends.append(-1)
                state = arcs[state, k]
            ends[state] = i if alive[i] else -1
        for c, k in classes.items():
            self.classes[ord(c)] = k if c in order else -1
        self.classes[32] = self.space = classes[SPACE]
        self.arcs = Pairs(*(np.array(x) for x in zip(*[(s, k, t) for (s, k), t in arcs.items()])))
        self.arc_of = arcs
        self.ends = np.array(ends, dtype=np.int32)
        self.longest = max(map(len, names))
        spelt = [b""] * len(ids)
        for i, name in zip(self.ids.tolist(), names):
            spelt[i] = name.replace(SPACE, " ").encode()
        for byte, i in enumerate(self.bytes_at.tolist()):
            spelt[i] = bytes([byte])
        self.spelt = np.frombuffer(b"".join(spelt), np.uint8)
        self.spelt_at = np.concatenate([[0], np.cumsum([len(s) for s in spelt])])

    @staticmethod
    def _derive(names: list[str], order: dict[str, int]) -> tuple[list[tuple[int, int]], list[bool]]:
        """The last merge that makes each piece from its characters, and whether merging ends at the piece at all."""
        splits, alive = [], []
        for i, name in enumerate(names):
            parts, last = list(name), (i, i)
            while len(parts) > 1:
                made = [order.get(a + b, len(names)) for a, b in zip(parts, parts[1:])]
                best = min(made)
                if best == len(names):
                    break
                k = made.index(best)
                last = (order[parts[k]], order[parts[k + 1]])
                parts[k:k + 2] = [parts[k] + parts[k + 1]]
            alive.append(len(parts) == 1)
            splits.append(last if len(parts) == 1 else (i, i))
        return splits, alive

    def allowed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves the border between pieces a and b alone: cost 0, or infinite.

        Merges are taken back in turn, the later of the two pieces first. A merge over the border that comes before
        the one just taken back would have been made instead.
        """
        out = np.ones(len(a), dtype=bool)
        at, a, b = np.arange(len(a)), a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), np.iinfo(np.int32).max, dtype=np.int64)
        while len(at):
            over = self.merges.get(a, b)
            stops = (over >= 0) & (over < limit)
            out[at[stops]] = False
            left_first = a > b
            a_can, b_can = self.right[a] != a, self.left[b] != b
            cut_a = np.where(left_first, a_can, a_can & ~b_can)
            cut_b = np.where(left_first, b_can & ~a_can, b_can)
            limit = np.where(cut_a, a, b + 1)
            a, b = np.where(cut_a, self.right[a], a), np.where(cut_b, self.left[b], b)
            go = ~stops & (cut_a | cut_b)
            at, a, b, limit = at[go], a[go], b[go], limit[go]
        return out

    def _lattice(self, chars: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Piece of every length from every character: [length - 1, start], -1 if none. ``ends``: of the stretch."""
        out = np.full((self.longest, len(chars)), -1, dtype=np.int32)
        start, state = np.arange(len(chars)), np.zeros(len(chars), dtype=np.int64)
        for n in range(self.longest):
            inside = start + n < ends[start]
            start, state = start[inside], state[inside]
            state = self.arcs.get(state, chars[start + n])
            start, state = start[state >= 0], state[state >= 0].astype(np.int64)
            if not len(start):
                break
            out[n, start] = self.ends[state]
        return out

    def _paths(self, chars: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of each stretch chars[first:first + size], one after the other, and how many each has."""
        order = np.argsort(-size, kind="stable")
        start, size_of = first[order], size[order]
        ends = np.zeros(len(chars), dtype=np.int64)
        covered = np.repeat(first + size, size)
        ends[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())] = covered
        lattice = self._lattice(chars, ends)
        last = np.full(len(chars), -1, dtype=np.int64)  # the piece that ends the path to after this character
        for j in range(1, int(size_of[0]) + 1 if len(size_of) else 1):
            end = start[:np.searchsorted(-size_of, -j, side="right")] + j
            for n in range(min(j, self.longest), 0, -1):
                piece = lattice[n - 1, end - n]
                at = np.flatnonzero(piece >= 0)
                if not len(at):
                    continue
                good = at if n == j else at[self.allowed(last[end[at] - n - 1], piece[at])]
                last[end[good] - 1] = piece[good]
                rest = np.ones(len(end), dtype=bool)
                rest[good] = False
                end = end[rest]
                if not len(end):
                    break
        # Back along the paths.
        at, unit = first + size, np.arange(len(first))
        found, owner = [], []
        while len(at):
            piece = last[at - 1]
            found.append(piece)
            owner.append(unit)
            at = at - self.length[piece]
            go = at > first[unit]
            at, unit = at[go], unit[go]
        if not found:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        step = np.concatenate([np.full(len(o), -k) for k, o in enumerate(owner)])
        owner, found = np.concatenate(owner), np.concatenate(found)
        return found[np.lexsort((step, owner))], np.bincount(owner, minlength=len(first))

    def _allowed_one(self, a: int, b: int) -> bool:
        limit = len(self.ids)
        while True:
            if self.merge_of.get((a, b), limit) < limit:
                return False
            a_can, b_can = self.right[a] != a, self.left[b] != b
            if a_can and (a > b or not b_can):
                limit, a = a, int(self.right[a])
            elif b_can:
                limit, b = b + 1, int(self.left[b])
            else:
                return True

    def _long_path(self, chars: list[int], known: dict) -> list[int]:
        """As _paths for one long stretch, character by character."""
        last, back, open_states = [], [], []
        for j, c in enumerate(chars):
            open_states.append((j, 0))
            open_states = [(i, self.arc_of[s, c]) for i, s in open_states if (s, c) in self.arc_of]
            for i, state in open_states:
                piece = int(self.ends[state])
                if piece < 0:
                    continue
                pair = (last[i - 1], piece) if i else None
                if pair and pair not in known:
                    known[pair] = self._allowed_one(*pair)
                if not pair or known[pair]:
                    last.append(piece)
                    back.append(i)
                    break
        out, at = [], len(chars)
        while at:
            out.append(last[at - 1])
            at = back[at - 1]
        return out[::-1]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has."""
        mark = " " if self.prefix else ""
        whole = [mark + t if t else "" for t in texts]
        sizes = np.array([len(t) for t in whole], dtype=np.int64)
        code = np.frombuffer("".join(whole).encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(code):
            return np.zeros(0, dtype=np.int32), np.zeros(len(texts), dtype=np.int64)
        kind = self.classes[code]
        odd, space = kind < 0, kind == self.space
        begins = odd.copy()
        begins[0] = True
        begins[1:] |= odd[:-1] | (space[1:] & ~space[:-1])
        begins[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        first = np.flatnonzero(begins)
        after = np.append(first[1:], len(code))
        names = range_hashes(code.astype(np.uint64) + np.uint64(1), first, after, WORD_BASE)
        _, sample, unit = np.unique(names, return_index=True, return_inverse=True)
        begin, size = first[sample], (after - first)[sample]
        plain, long = ~odd[begin] & (size <= LONG), ~odd[begin] & (size > LONG)
        # Distinct stretches side by side, then their pieces in the same order.
        pieces: list = [None] * len(sample)
        counts = np.zeros(len(sample), dtype=np.int64)
        at = np.flatnonzero(plain)
        spread = np.cumsum(size[at]) - size[at]
        chars = kind[np.repeat(begin[at] - spread, size[at]) + np.arange(size[at].sum())]
        flat, n = self._paths(chars, spread, size[at])
        counts[at] = n
        extra, known = [], {}
        for k in np.flatnonzero(long):
            pieces[k] = self.ids[self._long_path(kind[begin[k]:begin[k] + size[k]].tolist(), known)]
        for k in np.flatnonzero(odd[begin]):
            pieces[k] = self.bytes_at[list(chr(code[begin[k]]).encode("utf-8", "surrogatepass"))]
        place = np.zeros(len(sample), dtype=np.int64)
        place[at] = np.cumsum(n) - n
        total = int(n.sum())
        for k in np.flatnonzero(~plain):
            place[k], counts[k] = total, len(pieces[k])
            total += len(pieces[k])
            extra.append(pieces[k])
        flat = np.concatenate([self.ids[flat], *extra]).astype(np.int32)
        each = counts[unit]
        before = np.cumsum(each) - each
        out = flat[np.repeat(place[unit] - before, each) + np.arange(each.sum())]
        doc = np.repeat(np.arange(len(texts)), sizes)[first]
        return out, np.bincount(doc, weights=each, minlength=len(texts)).astype(np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The normalised texts of the given ids."""
        size = self.spelt_at[ids + 1] - self.spelt_at[ids]
        before = np.cumsum(size) - size
        data = self.spelt[np.repeat(self.spelt_at[ids] - before, size) + np.arange(size.sum())].tobytes()
        bounds = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        cut = int(self.prefix)
        return [data[a:b].decode("utf-8", "replace")[cut:] for a, b in zip(bounds, bounds[1:])]


def encoded(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """doc_id, n_tokens, token_ids, round_trip: whether decoding gives the normalised text again."""
    model = docs.sparkSession.sparkContext.broadcast(Transducer(model_file or default_model()))  # a few MB, by the vocabulary

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=SLICE):
                texts = part.column("text").to_pylist()
                ids, counts = model.value.encode(texts)
                back = model.value.decode(ids, counts)
                good = [(t or "").replace(SPACE, " ") == b for t, b in zip(texts, back)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(counts), _list(ids, counts, pa.int32()), pa.array(good)],
                    ["doc_id", "n_tokens", "token_ids", "round_trip"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, n_tokens long, token_ids array<int>, round_trip boolean")


def decoded(tokens: DataFrame, model_file: str | None = None) -> DataFrame:
    """doc_id and text of rows of (doc_id, token_ids); null ids give an empty text."""
    model = tokens.sparkSession.sparkContext.broadcast(Transducer(model_file or default_model()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("token_ids")
            counts = pc.fill_null(ids.value_lengths(), 0).to_numpy(zero_copy_only=False)
            texts = model.value.decode(ids.flatten().to_numpy(zero_copy_only=False), counts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts)], ["doc_id", "text"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "token_ids").mapInArrow(work, f"doc_id {kind}, text string")


def op5_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return encoded(table(spark, folder, "documents"))
