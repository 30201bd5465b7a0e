"""Byte-level BPE with long unsplit text encoded in pieces.

Merges never cross the stretches (pre-tokens) that the tokenizer cuts a text into, but one such
stretch may be a whole text of letters. Long text is therefore halved down to leaves, these are
encoded apart, and halves are joined up a tree. At a join inside a stretch a window of tokens on
both sides is encoded again, and grows until its first token equals the left side's and its last
the right side's (or the window has reached the stretch's end). Then every two neighbours of the
joined sequence stand next to each other in some valid encoding, which makes the whole one valid:
the first merge to break a boundary would be seen by the two tokens at that boundary alone. So the
result equals the encoding of the whole exactly.

A text is cut where white space follows a character that is none (a stretch always ends there), or
where the characters on both sides show how the pre-tokenizer's pattern behaves: inside a run of
letters, digits, signs or white space, or between two runs. Only characters whose class is the same
in Unicode 3.2 and today are trusted; a text without any such place is encoded in one piece.

Ordinary texts are encoded where they are read: units of white space and a word are told apart by a
64-bit hash, and each is sent to the library once for a worker's table. Texts of over ``SPREAD``
bytes are cut into parts, and the parts of all of them are dealt to all tasks, encoded once for each
distinct text, and joined by the same rule; what meets in one task is one text's tokens.

Defined cases: a null text is empty and has no tokens; a special token's string in a text is that
token, as the library has it; repeated rows each get their tokens, whatever their doc_id; an empty
table gives an empty result; columns other than doc_id and text are ignored. Decoding: null ids are
an empty text, ids outside the vocabulary are skipped, bytes that are no UTF-8 become U+FFFD, all
as the library does.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import buffers as B
from .tables import read
from .tokens import WordEncoder, byte_characters
from .workers import kept

BYTE_BPE = "byte_bpe_50k.json"
LEAF = 2048  # bytes of a text that are encoded at once where no white space parts it
PART = 1 << 18  # bytes of a part of a long text
SPREAD = 4 << 20  # bytes of a text from which its parts go to many tasks
KNOWN_IDS = 8 << 20  # ids that a worker's table of units holds before it starts again
REACH = 256  # bytes on both sides of the wanted place in which a cut is looked for first


@dataclass
class Tokens:
    """Tokens of a piece; head, tail: how many belong to its first and to its last stretch."""

    ids: np.ndarray
    head: int
    tail: int


@dataclass
class Units:
    """Pieces of rows that are encoded independently; see ``tokens.WordEncoder``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        return B.hash_runs(self.data, np.append(self.start, len(self.data)))


def firm(data: np.ndarray) -> np.ndarray:
    """Whether each byte surely ends a character that is no white space in any version of Unicode."""
    before, two = np.concatenate([[0], data[:-1]]), np.concatenate([[0, 0], data[:-2]])[: len(data)]
    out = ((data > 0x20) & (data < 0x7F)) | (data >= 0x80)
    odd = (before == 0xC2) & ((data == 0x85) | (data == 0xA0))
    odd |= (two == 0xE1) & (((before == 0x9A) & (data == 0x80)) | ((before == 0xA0) & (data == 0x8E)))
    odd |= (two == 0xE2) & (before == 0x80) & ((data <= 0x8B) | (data == 0xA8) | (data == 0xA9) | (data == 0xAF))
    odd |= (two == 0xE2) & (before == 0x81) & (data == 0x9F)
    odd |= (two == 0xE3) & (before == 0x80) & (data == 0x80)
    return out & ~odd


def kind(character: str) -> str:
    """L letter, N digit, S ASCII white space, O other, or nothing where versions of Unicode may differ."""
    now, then = unicodedata.category(character), unicodedata.ucd_3_2_0.category(character)
    if now[0] != then[0] or now == "Cn":
        return ""
    if character in " \t\n\v\f\r":
        return "S"
    return "" if now == "Cc" or now[0] == "Z" else now[0] if now[0] in "LN" else "O"


def place(chars: str, i: int, specials: list[str]) -> bool | None:
    """A cut before chars[i]: False between two stretches, True inside one, None if it can't be told.

    Stretches are those of the pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
    """
    for s in specials:
        if chars.find(s, max(0, i - len(s) + 1), i + len(s) - 1) >= 0:
            return None
    if any(chars.startswith(s, i) or chars.endswith(s, 0, i) for s in specials):
        return False
    a, b = kind(chars[i - 1]), kind(chars[i])
    after = kind(chars[i + 1]) if i + 1 < len(chars) else "end"
    if not (a and b and after):
        return None
    if b == "S":
        if a != "S":
            return False
        # all white space but the last before a word is one stretch
        return after in ("S", "end") or any(chars.startswith(s, i + 1) for s in specials)
    if a == "S":
        return None
    if a == b == "L":
        return None if "'" in chars[max(0, i - 3) : i] else True
    if a == b == "O" and chars[i] == "'" and after == "L" or a == "O" and b == "L" and chars[i - 1] == "'":
        return None
    return a == b


def cut(text: bytes, near: int, specials: list[str]) -> tuple[int, bool] | None:
    """A place to cut the text (in bytes, and whether it is inside a stretch), about as near as there is one."""
    reach = REACH
    margin = max([4, *(len(s) + 2 for s in specials)])
    while True:
        lo, hi = max(0, near - reach), min(len(text), near + reach)
        while lo and text[lo] & 0xC0 == 0x80:
            lo -= 1
        while hi < len(text) and text[hi] & 0xC0 == 0x80:
            hi += 1
        chars = text[lo:hi].decode()
        first, last = (1 if lo == 0 else margin), (len(chars) - 1 if hi == len(text) else len(chars) - margin)
        middle = (first + last) // 2
        inside = None
        for d in range(max(last - middle, middle - first) + 1):
            for i in dict.fromkeys((middle - d, middle + d)):
                if first <= i <= last:
                    found = place(chars, i, specials)
                    if found is False:
                        return lo + len(chars[:i].encode()), False
                    if found and inside is None:
                        inside = i
            if d >= 32 and inside is not None:
                break
        if inside is not None:
            return lo + len(chars[:inside].encode()), True
        if lo == 0 and hi == len(text):
            return None
        reach *= 4


def cuts(text: bytes, size: int, specials: list[str]) -> list[tuple[int, bool]]:
    """Places that cut a text into parts of about size bytes."""
    out: list[tuple[int, bool]] = []
    for near in range(size, len(text) - size // 2, size):
        found = cut(text, near, specials)
        if found and (out[-1][0] if out else 0) < found[0] < len(text):
            out.append(found)
    return out


class ByteEncoder(WordEncoder):
    """The library's own ids of a byte-level tokenizer without a normalizer, from a table of units."""

    def __init__(self, path: str, leaf: int = LEAF, part: int = PART):
        super().__init__(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of over 16 bits")
        self.leaf, self.part = leaf, part
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.windows = 0  # encoded again at joins

    def encode_units(self, data: np.ndarray, offsets: np.ndarray):
        if self.used > KNOWN_IDS:
            self._reset()
        return super().encode_units(data, offsets)

    def _units(self, data: np.ndarray, offsets: np.ndarray) -> Units:
        begins = np.flatnonzero(~B.NOT_SPACE[data[1:]] & firm(data)[:-1]) + 1
        rows = offsets[:-1][np.diff(offsets) > 0]
        start = np.unique(np.concatenate([rows, begins]))
        return Units(data, start, np.append(start[1:], len(data))[: len(start)], np.searchsorted(start, offsets))

    def _new_ids(self, texts: list[str]) -> list[list[int]]:
        long = {i: t.encode() for i, t in enumerate(texts) if 4 * len(t) > self.leaf}
        short = [t for i, t in enumerate(texts) if i not in long]
        rest = iter(self.tokenizer.encode_batch_fast(short, add_special_tokens=False))
        return [self.tree(long[i]).ids.tolist() if i in long else next(rest).ids for i in range(len(texts))]

    def _leaf(self, text: bytes) -> Tokens:
        found = self.tokenizer.encode(text.decode(), add_special_tokens=False)
        words = np.array(found.word_ids, np.int64) if found.ids else np.zeros(0, np.int64)
        other = np.flatnonzero(words[1:] != words[:-1]) + 1 if len(words) else words
        n = len(found.ids)
        return Tokens(np.array(found.ids, np.uint16), int(other[0]) if len(other) else n, n - int(other[-1]) if len(other) else n)

    def tree(self, text: bytes) -> Tokens:
        """Halves encoded on their own and joined."""
        if len(text) <= self.leaf:
            return self._leaf(text)
        found = cut(text, len(text) // 2, self.specials)
        if found is None:
            return self._leaf(text)
        return self.joined(self.tree(text[: found[0]]), self.tree(text[found[0] :]), found[1])

    def joined(self, left: Tokens, right: Tokens, inside: bool) -> Tokens:
        if not inside:
            return Tokens(np.concatenate([left.ids, right.ids]), left.head, right.tail)
        width = 4
        while True:
            a, b = min(width, left.tail), min(width, right.head)
            ends, begins = left.ids[len(left.ids) - a :].tolist(), right.ids[:b].tolist()
            new = [t.id for t in self.model.tokenize("".join(map(self.model.id_to_token, ends + begins)))]
            self.windows += 1
            if (a == left.tail or new[0] == ends[0]) and (b == right.head or new[-1] == begins[-1]):
                break
            width *= 2
        ids = np.concatenate([left.ids[: len(left.ids) - a], np.array(new, np.uint16), right.ids[b:]])
        more = left.tail - a + len(new) + right.head - b  # of the stretch that holds the cut
        head = left.head if left.head < len(left.ids) else more
        tail = right.tail if right.tail < len(right.ids) else more
        return Tokens(ids, head, tail)

    def part_of(self, text: bytes) -> Tokens:
        """A part by its units; the first and the last one also tell its head and tail."""
        data = np.frombuffer(text, np.uint8)
        ids, _, units = self.encode_units(data, np.array([0, len(data)]))
        first = self.tree(text[: units.end[0]])
        last = first if len(units.start) == 1 else self.tree(text[units.start[-1] :])
        return Tokens(ids, first.head, last.tail)

    def all_joined(self, parts: list[Tokens], inside: list[bool]) -> Tokens:
        """Parts joined by halves; inside has a flag for each place between two of them."""
        if len(parts) == 1:
            return parts[0]
        half = len(parts) // 2
        return self.joined(self.all_joined(parts[:half], inside[: half - 1]), self.all_joined(parts[half:], inside[half:]), inside[half - 1])

    def long_text(self, text: bytes) -> np.ndarray:
        at = cuts(text, self.part, self.specials)
        edges = [0, *(p for p, _ in at), len(text)]
        return self.all_joined([self.part_of(text[a:b]) for a, b in zip(edges, edges[1:], strict=False)], [x for _, x in at]).ids


def byte_encoder(path: str, leaf: int = LEAF, part: int = PART) -> ByteEncoder:
    return kept(("byte encoder", path, leaf, part), lambda: ByteEncoder(path, leaf, part))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(BYTE_BPE)


def _lists(flat: np.ndarray, size: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(flat.astype(np.int32)))


def encode(documents: DataFrame, tokenizer: str | None = None, spread: int = SPREAD, leaf: int = LEAF, part: int = PART) -> DataFrame:
    """doc_id and ids array<int> of each row."""
    path = tokenizer or tokenizer_path()
    rows = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    of_id = rows.schema["doc_id"].dataType.simpleString()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = byte_encoder(path, leaf, part)
        for batch in batches:
            for lo, hi, data, offsets in B.slices(batch.column(1)):
                if hi - lo == 1 and len(data) > part:
                    ids = words.long_text(data.tobytes())
                    size = np.array([len(ids)])
                else:
                    ids, size = words.encode(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), _lists(ids, size)], ["doc_id", "ids"])

    def in_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("text_key", pa.string()), ("part", pa.int32()), ("inside", pa.bool_()), ("piece", pa.string())])
        specials = byte_encoder(path, leaf, part).specials
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = text.as_buffer().to_pybytes()
                at = [*cuts(data, part, specials), (len(data), False)]
                begin = 0
                for k, (end, inside) in enumerate(at):
                    yield pa.RecordBatch.from_pylist([{"text_key": key, "part": k, "inside": inside, "piece": data[begin:end].decode()}], schema)
                    begin = end

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = byte_encoder(path, leaf, part)
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                found = words.part_of(row.column(3)[0].as_buffer().to_pybytes())
                yield pa.RecordBatch.from_arrays([*row.columns[:3], _lists(found.ids, np.array([len(found.ids)])), pa.array([found.head], pa.int32()), pa.array([found.tail], pa.int32())], ["text_key", "part", "inside", "ids", "head", "tail"])

    def together(parts: pa.Table) -> pa.Table:
        words = byte_encoder(path, leaf, part)
        parts = parts.sort_by("part")
        pieces = [Tokens(x.values.to_numpy().astype(np.uint16), h, t) for x, h, t in zip(parts["ids"], parts["head"].to_pylist(), parts["tail"].to_pylist(), strict=True)]
        ids = words.all_joined(pieces, parts["inside"].to_pylist()[:-1]).ids
        return pa.table({"text_key": parts["text_key"].combine_chunks()[:1], "all_ids": _lists(ids, np.array([len(ids)]))})

    short = rows.where(F.octet_length("text") <= spread).mapInArrow(whole, f"doc_id {of_id}, ids array<int>")
    long = rows.where(F.octet_length("text") > spread).withColumn("text_key", F.sha2("text", 256))
    parts = long.select("text_key", "text").mapInArrow(in_parts, "text_key string, part int, inside boolean, piece string").dropDuplicates(["text_key", "part"])
    encoded = parts.mapInArrow(each, "text_key string, part int, inside boolean, ids array<int>, head int, tail int").groupBy("text_key").applyInArrow(together, "text_key string, all_ids array<int>")
    keyed = long.select("doc_id", F.col("text_key").alias("own_key"))
    return short.unionByName(keyed.join(encoded, F.col("own_key") == F.col("text_key")).select("doc_id", F.col("all_ids").alias("ids")))


class ByteDecoder:
    """The bytes of every id, one after another."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        words = Tokenizer.from_file(path)
        byte = {c: b for b, c in byte_characters().items()}
        n = words.get_vocab_size(with_added_tokens=True)
        tokens = [words.id_to_token(i) or "" for i in range(n)]
        raw = [bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t in tokens]
        self.n, self.data = n, np.frombuffer(b"".join(raw), np.uint8)
        self.size = np.array([*map(len, raw), 0], np.int64)  # the last for ids of no token
        self.start = np.cumsum(self.size) - self.size

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        ids = np.where((ids < 0) | (ids >= self.n), self.n, ids)
        size = self.size[ids]
        raw = self.data[B.ragged(self.start[ids], size)].tobytes()
        at = np.concatenate([[0], np.cumsum(size)])[offsets].tolist()
        return [raw[a:b].decode(errors="replace") for a, b in zip(at, at[1:], strict=False)]


def decode(encoded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, ids and text of rows with ids array<int>."""
    path = tokenizer or tokenizer_path()
    rows = encoded.select("doc_id", F.coalesce(F.col("ids").cast("array<int>"), F.array().cast("array<int>")).alias("ids"))
    of_id = rows.schema["doc_id"].dataType.simpleString()

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = kept(("byte decoder", path), lambda: ByteDecoder(path))
        for batch in batches:
            column = batch.column(1)
            ends = column.offsets.to_numpy().astype(np.int64)
            flat = column.values.fill_null(-1).to_numpy()
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + PART // 4, "right")) - 1)
                text = table.decode(flat[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo])
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns), pa.array(text, pa.string())], ["doc_id", "ids", "text"])
                lo = hi

    return rows.mapInArrow(texts, f"doc_id {of_id}, ids array<int>, text string")


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = decode(encode(read(spark, sf_dir, "documents")))
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
