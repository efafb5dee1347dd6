"""Best-fit packing of tokenized documents into fixed-length sequences.

Every document is tokenized whole, closed by an end id and cut only where it exceeds a sequence. Pieces are dealt
by hash into groups of bounded size; within a group a vector best-fit places pieces, longest first, into the
open bin that the residual token, document-count and attention-cost capacities favour: least weighted residual
norm, or greatest weighted dot product of demand and residual. Every constraint must hold. What each group leaves in
poorly filled bins is dealt again, as long as that at least halves it or until one group holds it, so that the number of part-filled
bins doesn't grow with the number of groups; pieces that no others complete (such as halves and a bit) stay as they are.

Defined results: a null or empty text is one piece holding the end id only; a repeated row is packed again; a null id
stays null; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, slices, written
from .words import random_table, word_hashes, word_spans

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

#: Letters of which each has one lower-case form and no composition, then marks that never join letters.
PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)")
#: Bytes of text taken together.
CHUNK_BYTES = 2 << 20


class WordTokenizer:
    """Ids of whole texts, as little-endian unsigned 32-bit numbers.

    With words=True the tokenizer must lower-case, drop white space and split letters from marks; the ids of a text are then those
    of its words in turn, and of a plain word those of its letters and its marks. Words of many texts are hashed at once, by random
    tables of this process, and each different one is looked up in a table of up to `limit` words, from which the longest unused go.
    A second hash is compared for every word; where it differs, the texts are tokenized whole.
    """

    _open: dict[tuple[str, bool], WordTokenizer] = {}

    def __init__(self, path: str, words: bool, limit: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.words, self.limit, self.round = Tokenizer.from_file(path), words, limit, 0
        self.letters, self.older, self.marks = {}, {}, {"": b""}
        self.tables = [random_table(), random_table()]
        self._keep(*np.zeros((2, 0), np.uint64), *np.zeros((3, 0), np.int64))
        self.flat = np.zeros(0, "<u4")
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        self.shown = {b: chr(256 + i) for i, b in enumerate(hidden)}
        samples = ["word", "straße", "élan", "a", "internationalisation"]
        self.direct = words and [self._model(w) for w in samples] == self._encode(samples)

    @classmethod
    def of(cls, path: str, words: bool) -> WordTokenizer:
        """One per Python worker."""
        if (path, words) not in cls._open:
            cls._open[path, words] = cls(path, words)
        return cls._open[path, words]

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _model(self, letters: str) -> bytes:
        """The ids of lower-case letters, by the tokenizer's model alone: its alphabet shows each byte as one character."""
        shown = letters if letters.isascii() else letters.encode().decode("latin-1").translate(self.shown)
        return np.array([x.id for x in self.tokenizer.model.tokenize(shown)], "<u4").tobytes()

    def _of_letters(self, letters: str) -> bytes:
        ids = self.letters.get(letters)
        if ids is None:
            ids = self.older.get(letters)
            if ids is None:
                ids = self._model(letters) if self.direct else self._encode([letters])[0]
            if len(self.letters) > self.limit // 6:
                self.older, self.letters = self.letters, {}
            self.letters[letters] = ids
        return ids

    def _of_marks(self, marks: str) -> bytes:
        if marks not in self.marks:
            if len(self.marks) > 10_000:
                self.marks = {"": b""}
            self.marks[marks] = self._encode([marks])[0]
        return self.marks[marks]

    def _of_word(self, word: str) -> bytes:
        match = PLAIN.fullmatch(word)
        return self._of_letters(match[1].lower()) + self._of_marks(match[2]) if match else self._encode([word])[0]

    def _learn(self, keys: np.ndarray, checks: np.ndarray, words: list[str]) -> None:
        ids = [*map(self._of_word, words)]
        size = np.array([len(x) // 4 for x in ids], np.int64)
        start = len(self.flat) + np.cumsum(size) - size
        self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(ids), "<u4")])
        new = (keys, checks, start, size, np.full(len(keys), self.round))
        self._keep(*map(np.concatenate, zip((self.keys, self.checks, self.start, self.size, self.used), new)))

    def _keep(self, keys: np.ndarray, checks: np.ndarray, start: np.ndarray, size: np.ndarray, used: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.checks, self.start, self.size, self.used = keys[order], checks[order], start[order], size[order], used[order]

    def _forget(self) -> None:
        """Halves the table, the longest unused words first, once it exceeds its limit."""
        if len(self.keys) <= self.limit:
            return
        kept = np.sort(np.argsort(-self.used, kind="stable")[: self.limit // 2])
        self._keep(self.keys[kept], self.checks[kept], self.start[kept], self.size[kept], self.used[kept])
        self.flat = self.flat[spans(self.start, self.size)]
        self.start = np.cumsum(self.size) - self.size

    def _chunk(self, texts: list[bytes]) -> list[bytes]:
        data = b"\n".join(texts) + b"\n"
        raw = np.frombuffer(data, np.uint8)
        starts, ends = word_spans(raw)
        if not len(starts):
            return [b""] * len(texts)
        hashed, second = word_hashes(raw, starts, ends, *self.tables)
        found, inverse = np.unique(hashed, return_inverse=True)
        place = np.empty(len(found), np.int64)
        place[inverse] = np.arange(len(inverse))
        checks = second[place]
        self.round += 1
        at = np.searchsorted(self.keys, found)
        new = np.ones(len(found), bool) if not len(self.keys) else self.keys[np.minimum(at, len(self.keys) - 1)] != found
        if (checks[inverse] != second).any() or (self.checks[at[~new]] != checks[~new]).any():
            return self._encode([t.decode() for t in texts])
        if new.any():
            some = place[new]
            self._learn(found[new], checks[new], [data[s:e].decode() for s, e in zip(starts[some].tolist(), ends[some].tolist())])
            at = np.searchsorted(self.keys, found)
        self.used[at] = self.round
        size = self.size[at][inverse]
        ids = self.flat[spans(self.start[at][inverse], size)]
        limits = np.cumsum([len(t) + 1 for t in texts])
        ends_of = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(starts, limits)].tolist()
        self._forget()
        return [ids[s:e].tobytes() for s, e in zip([0, *ends_of], ends_of)]

    def many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. Texts longer than a chunk are parted at white space."""
        if not self.words:
            return [x for t in texts for x in self._encode([t])]
        out: list[list[bytes]] = [[] for _ in texts]
        held, size = [], 0

        def flush() -> None:
            nonlocal held, size
            for (i, _), ids in zip(held, self._chunk([x for _, x in held])):
                out[i].append(ids)
            held, size = [], 0

        for i, text in enumerate(texts):
            for part in parted(text.encode()):
                if held and size + len(part) > CHUNK_BYTES:
                    flush()
                held.append((i, part))
                size += len(part)
        if held:
            flush()
        return [b"".join(x) for x in out]

    def ids(self, text: str) -> bytes:
        return self.many([text])[0]


def parted(text: bytes) -> Iterator[bytes]:
    """Parts of at most CHUNK_BYTES that end before white space; longer only where a word is."""
    at = 0
    while len(text) - at > CHUNK_BYTES:
        cut = max(text.rfind(blank, at + 1, at + CHUNK_BYTES) for blank in (b" ", b"\n", b"\t", b"\r"))
        if cut < 0:
            cut = min((x for x in (text.find(blank, at + CHUNK_BYTES) for blank in (b" ", b"\n", b"\t", b"\r")) if x >= 0), default=len(text))
        yield text[at:cut]
        at = cut
    yield text[at:]


def spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Every place of the spans in turn."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 1, max_tokens: int = 4096, words: bool = True, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents: doc_id, piece, start, length, ids_crc32 and, if asked for, ids as array<int>."""
    end, width = np.array([end_id], "<u4").tobytes(), 4 * max_tokens
    schema = PIECES + (", ids array<int>" if with_ids else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer.of(tokenizer_path, words)
        for batch in slices(batches, 1024):
            out: list[list] = [[] for _ in names]
            for doc_id, found in zip(batch.column(0).to_pylist(), tokenizer.many([x.as_py() or "" for x in batch.column(1)])):
                ids = found + end
                for n, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    row = (doc_id, n, at // 4, len(part) // 4, zlib.crc32(part), np.frombuffer(part, "<u4").astype(np.int32) if with_ids else None)
                    for column, value in zip(out, row):
                        column.append(value)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)
        give_back()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, schema)


def best_fit(lengths: np.ndarray, max_tokens: int, max_docs: int, max_cost: float, weights: tuple[float, float, float], rule: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset, tokens left in each bin) of pieces that come longest first. A piece costs length squared in attention."""
    n = len(lengths)
    capacity, weight = np.array([max_tokens, max_docs, max_cost], float), np.array(weights, float)
    left, ids = np.empty((3, n)), np.empty(n, np.int64)
    bins, offsets, opened, live = np.empty(n, np.int64), np.empty(n, np.int64), 0, 0
    tokens_left = np.full(n, max_tokens, np.int64)
    shortest = lengths[-1] if n else 0
    for i, length in enumerate(lengths.tolist()):
        need = (length, 1, float(length) ** 2)
        if need[0] > max_tokens or need[2] > max_cost:
            raise ValueError("a piece exceeds the capacity of an empty sequence")
        fits = np.flatnonzero((left[0, :live] >= length) & (left[1, :live] >= 1) & (left[2, :live] >= need[2]))
        if len(fits):
            rest = left[:, fits]
            if rule == "norm":
                score = sum(weight[k] * ((rest[k] - need[k]) / capacity[k]) ** 2 for k in range(3) if weight[k])
                at = fits[np.argmin(score)]
            else:
                score = sum(weight[k] * (rest[k] / capacity[k]) * (need[k] / capacity[k]) for k in range(3) if weight[k])
                at = fits[np.argmax(score)]
        else:
            at, live = live, live + 1
            left[:, at], ids[at], opened = capacity, opened, opened + 1
        b = ids[at]
        bins[i], offsets[i] = b, max_tokens - tokens_left[b]
        tokens_left[b] -= length
        left[:, at] -= need
        if left[0, at] < shortest or left[1, at] < 1:
            live -= 1
            left[:, at], ids[at] = left[:, live], ids[live]
    return bins, offsets, tokens_left[:opened]


def _placed(table: pa.Table, first: int, **limits) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    order = np.lexsort([table[c].fill_null(-1).to_numpy() for c in ("row", "ids_crc32", "piece", "doc_id", "length")])[::-1]
    table = table.take(pa.array(order))
    bins, offsets, left = best_fit(table["length"].to_numpy(), **limits)
    table = table.append_column("sequence_id", pa.array(first + bins)).append_column("offset", pa.array(offsets))
    return table, bins, left


def _group_packer(base: int, cut: float, last: bool, limits: dict):
    def placed(table: pa.Table) -> pa.Table:
        first = base + (table["part"][0].as_py() << 28)
        out, bins, left = _placed(table.drop_columns(["part"]), first, **limits)
        return out.append_column("poor", pa.array((left[bins] > cut) & (not last)))

    return placed


def pack(parts: DataFrame, max_tokens: int = 4096, max_docs: int = 4096, max_cost: float | None = None, weights: tuple[float, float, float] = (1.0, 0.001, 0.001), rule: str = "norm", group_rows: int = 8192, slack: float = 0.002) -> DataFrame:
    """parts (doc_id, piece, start, length, ids_crc32) with the sequence and offset of each.

    Groups hold group_rows pieces on average, dealt by row, so that copies of a row spread. Sequences with more than slack of their tokens unused are packed
    again with those of the other groups, until one group holds them or a round leaves more than half of them.
    """
    if rule not in ("norm", "dot"):
        raise ValueError("rule is norm or dot")
    limits = {"max_tokens": max_tokens, "max_docs": max_docs, "max_cost": float(max_tokens) ** 2 if max_cost is None else max_cost, "weights": weights, "rule": rule}
    columns = [x.split()[0] for x in PIECES.split(", ")]
    todo, done, stage = written(parts.select(*columns, F.monotonically_increasing_id().alias("row")), "pieces"), [], 0
    before = None
    while True:
        rows = todo.count()
        groups = max(1, -(-rows // group_rows))
        last = groups == 1 or (before is not None and rows > before // 2)
        base, cut = stage << 56, slack * max_tokens

        placed = _group_packer(base, 0 if last else cut, last, limits)
        spread = F.pmod(F.xxhash64("row", F.lit(stage)), F.lit(groups)).alias("part")
        out = todo.select(*columns, "row", spread).groupBy("part").applyInArrow(placed, PACKED.replace(", sequence_id", ", row long, sequence_id") + ", poor boolean")
        if last:
            done.append(out.drop("poor", "row"))
            break
        out = written(out, "packed")
        done.append(out.where(~F.col("poor")).drop("poor", "row"))
        todo, before, stage = out.where("poor").select(*columns, "row"), rows, stage + 1
    packed = done[0]
    for more in done[1:]:
        packed = packed.unionByName(more)
    return packed
