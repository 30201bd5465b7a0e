"""Language identification with segmentation-marginalised unigrams.

Every language has probabilities over one fixed public vocabulary of subword pieces. The score of
a word is the sum, over all ways of cutting it into pieces, of the product of their
probabilities; a forward pass over positions computes it. A text's score is the sum of its words'
logarithms. Probabilities are learned by expectation maximisation over the words of a bounded
sample (``docs_per_lang``) of labelled rows; the expectation step is a Spark job over the word
table, and only ``languages x pieces`` sums reach the driver, so labels are names of languages,
not free text.

Words are runs of letters (and any other non-ASCII characters) of the lower-cased whole text, with
a mark in front. A word of any length is scored whole: the forward pass keeps the positions that a
piece can still reach, rescaled as it goes. Only learning takes words of over ``LEARN_BYTES`` in
parts of that length, the mark in front of the first. Single bytes are pieces of a small fixed
probability, so every word has a segmentation. Pieces that hold anything but letters and the mark
can't occur in a word and are left out; no other piece is.

Defined cases: null texts and texts without a letter are ``und`` with score 0; without any
labelled row every text is ``und``; equal scores go to the smaller name; rows with a null lang
teach nothing; rows of equal lang and text teach once; repeated rows are scored alike; an empty
table gives an empty result; a very long text costs time in proportion, and memory in proportion
to its longest word; kept columns named lang_pred, score or held_out give way to
the operator's own, all others stay as they are. Words are cached by a 64-bit hash, at most
``CACHE`` at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import buffers as B
from .tables import read, settled
from .workers import KeyTable, kept, release

VOCABULARY = "piece_bpe_32k.model"
DOCS_PER_LANG = 1500
ROUNDS = 3
TASKS = 12
LEARN_BYTES = 32
BYTE_P, CACHE = 1e-7, 300_000
CELLS = 100_000  # bytes of words in one forward pass
MARK = 0x5F  # begins each word
LETTER = B.byte_class(b"abcdefghijklmnopqrstuvwxyz") | (np.arange(256) >= 128)
_IN_WORD = LETTER | B.byte_class(bytes([MARK]))
FOUND = ("lang_pred", "score", "held_out")


def public_pieces(name: str = VOCABULARY) -> list[bytes]:
    """The vocabulary's pieces that can occur in a marked word; their order is fixed."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    out = {}
    for i in range(model.get_piece_size()):
        if model.is_byte(i) or model.is_control(i) or model.is_unknown(i):
            continue
        piece = model.id_to_piece(i)
        raw = piece.encode().replace("▁".encode(), bytes([MARK]))
        if chr(MARK) not in piece and _IN_WORD[np.frombuffer(raw, np.uint8)].all() and MARK not in raw[1:]:
            out[raw] = None
    return list(out)


class Trie:
    """Pieces as a table of transitions from state to state; 0 is the root, none no such piece. Built on the driver and broadcast."""

    def __init__(self, pieces: list[bytes]):
        nodes: dict[bytes, int] = {b"": 0}
        for p in pieces:
            for k in range(1, len(p) + 1):
                nodes.setdefault(p[:k], len(nodes))
        used = sorted({b for p in pieces for b in p})
        self.column = np.zeros(256, np.int64)  # 0: in no piece
        self.column[used] = 1 + np.arange(len(used))
        kind = np.uint16 if len(nodes) < 65535 else np.uint32
        self.none = kind(np.iinfo(kind).max)
        self.next = np.full((len(nodes), len(used) + 1), self.none, kind)
        for prefix, i in nodes.items():
            if prefix:
                self.next[nodes[prefix[:-1]], self.column[prefix[-1]]] = i
        self.piece = np.full(len(nodes), -1, np.int32)
        self.piece[[nodes[p] for p in pieces]] = np.arange(len(pieces))
        self.longest = max(map(len, pieces), default=0)


def pieces_in(t: Trie, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, length, piece) of every piece in the words data[offsets[i]:offsets[i + 1]], by length."""
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data))
    own, state = np.arange(len(data)), np.zeros(len(data), t.next.dtype)
    at, length, piece = [own[:0]], [own[:0]], [t.piece[:0]]
    column = t.column[data]
    for k in range(1, t.longest + 1):
        fits = left[own] >= k
        own, state = own[fits], state[fits]
        state = t.next[state, column[own + k - 1]]
        own, state = own[state != t.none], state[state != t.none]
        if not len(own):
            break
        hit = t.piece[state] >= 0
        at.append(own[hit])
        length.append(np.full(int(hit.sum()), k))
        piece.append(t.piece[state[hit]])
    return np.concatenate(at), np.concatenate(length), np.concatenate(piece)


def steps(t: Trie, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each position within the words, from the first on: (word, length, piece) of the pieces there."""
    at, length, piece = pieces_in(t, data, offsets)
    word = np.searchsorted(offsets, at, "right") - 1
    place = at - offsets[word]
    order = np.argsort(place, kind="stable")
    cuts = np.searchsorted(place[order], np.arange(int(np.diff(offsets).max(initial=0)) + 1))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield word[order[a:b]], length[order[a:b]], piece[order[a:b]]


def word_scores(t: Trie, data: np.ndarray, offsets: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Logarithm of the summed probability of all segmentations of each word (which begin with the mark), by language.

    alpha has the positions that a piece can still reach, as a ring, each word's divided by what
    it had at the last position; the divisors' logarithms are summed.
    """
    lens, width = np.diff(offsets), t.longest + 1
    alpha = np.zeros((len(lens), width, p.shape[1]))
    alpha[:, 0] = 1
    total = np.zeros((len(lens), p.shape[1]))
    for s, (word, length, piece) in enumerate(steps(t, data, offsets)):
        now = alpha[:, s % width].copy()
        alpha[:, s % width] = 0
        if s and s % 16 == 0:
            live = lens > s
            scale = now[live]
            total[live] += np.log(scale)
            alpha[live] /= scale[:, None]
            now[live] = 1
        alpha[:, (s + 1) % width] += now * BYTE_P
        alpha[word, (s + length) % width] += now[word] * p[piece]
        done = np.flatnonzero(lens == s + 1)
        if len(done):
            total[done] += np.log(alpha[done, (s + 1) % width])
    return total


def expected(t: Trie, data: np.ndarray, offsets: np.ndarray, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected uses of each piece by language over words of at most LEARN_BYTES and the mark; weight[word, language] counts the words."""
    lens, found = np.diff(offsets), list(steps(t, data, offsets))
    alpha = np.zeros((len(lens), len(found) + 1, p.shape[1]))
    alpha[:, 0] = 1
    for s, (word, length, piece) in enumerate(found):
        alpha[:, s + 1] += alpha[:, s] * BYTE_P
        alpha[word, s + length] += alpha[word, s] * p[piece]
    beta = np.zeros_like(alpha)
    beta[np.arange(len(lens)), lens] = 1
    scale = weight / alpha[np.arange(len(lens)), lens]
    out = np.zeros_like(p)
    for s in range(len(found) - 1, -1, -1):
        word, length, piece = found[s]
        beta[:, s] += beta[:, s + 1] * BYTE_P
        use = p[piece] * beta[word, s + length]
        np.add.at(beta[:, s], word, use)
        np.add.at(out, piece, alpha[word, s] * use * scale[word])
    return out


def marked(data: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words (runs of data one after another) with the mark in front of each, and their offsets."""
    offsets = np.concatenate([[0], np.cumsum(lens + 1)])
    out = np.full(offsets[-1], MARK, np.uint8)
    inside = np.ones(len(out), bool)
    inside[offsets[:-1]] = False
    out[inside] = data
    return out, offsets


def learnable(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marked words in parts of at most LEARN_BYTES and a mark, with their offsets and each part's word."""
    data, offsets = marked(data, np.diff(offsets))
    parts = np.maximum(1, -(-(np.diff(offsets) - 1) // LEARN_BYTES))
    nth = B.ragged(np.zeros(len(parts), np.int64), parts)
    start = np.repeat(offsets[:-1], parts) + nth * LEARN_BYTES + (nth > 0)
    return data, np.concatenate([start, offsets[-1:]]), np.repeat(np.arange(len(parts)), parts)


class Model:
    """Languages with piece probabilities, p[piece, language], and the trie of the pieces."""

    def __init__(self, langs: list[str], p: np.ndarray, trie: Trie | None):
        self.langs, self.p, self.trie, self.tag = langs, p, trie, uuid.uuid4().hex

    def known(self) -> tuple[KeyTable, np.ndarray]:
        """Scores of known words, kept by the worker for this model."""
        return kept(("langid", self.tag), lambda: (KeyTable(CACHE), np.zeros((CACHE, len(self.langs)))))


def learn(labelled: DataFrame, vocabulary: str = VOCABULARY, docs_per_lang: int = DOCS_PER_LANG, rounds: int = ROUNDS) -> Model:
    """From rows of lang and text. About docs_per_lang rows of each language are drawn by a hash of the text."""
    labelled = labelled.where("lang is not null and text is not null").select("lang", F.col("text").cast("string"))
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((0, 0)), None)
    place = {x: i for i, x in enumerate(langs)}
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, docs_per_lang / sizes[k]))])
    drawn = labelled.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < F.get(F.array(share[F.col("lang")]), F.lit(0)) * (1 << 20)).distinct()

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in B.slices(pc.utf8_lower(batch.column(1))):
                words = B.Words(data, offsets, LETTER)
                body, at = words.compact()
                lang = np.array([place[x] for x in batch.column(0).slice(lo, hi - lo).to_pylist()])
                keys = B.hash_runs(body, at)
                if len(keys):
                    _, one, n = np.unique(B.mixed(keys ^ lang[words.row].astype(np.uint64)), return_index=True, return_counts=True)
                    text = [body[at[i] : at[i + 1]].tobytes() for i in one]
                    yield pa.RecordBatch.from_arrays([pa.array(lang[words.row[one]], pa.int32()), pa.array(text, pa.binary()), pa.array(n, pa.int64())], ["lang", "word", "n"])

    table = drawn.mapInArrow(count_words, "lang int, word binary, n long")
    # the sample is bounded, and so is its word table: a few tasks, as each one sends sums of all pieces
    table = settled(table.groupBy("lang", "word").agg(F.sum("n").alias("n")).coalesce(TASKS))
    pieces = public_pieces(vocabulary)
    n_pieces, trie = len(pieces), Trie(pieces)
    tree = table.sparkSession.sparkContext.broadcast(trie)
    p = np.full((n_pieces, len(langs)), 1 / n_pieces)
    for _ in range(rounds):
        shared = table.sparkSession.sparkContext.broadcast(p)

        def uses(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            release()
            t, total = tree.value, np.zeros_like(shared.value)
            for batch in batches:
                for lo, hi, data, offsets in B.slices(batch.column(1), 1 << 16):
                    data, at, word = learnable(data, offsets)
                    weight = np.zeros((len(word), len(langs)))
                    lang, n = (batch.column(i).slice(lo, hi - lo).to_numpy()[word] for i in (0, 2))
                    weight[np.arange(len(word)), lang] = n
                    total += expected(t, data, at, shared.value, weight)
            piece, lang = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int32()), pa.array(lang, pa.int32()), pa.array(total[piece, lang])], ["piece", "lang", "n"])

        sums = table.mapInArrow(uses, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n"))
        total = np.full_like(p, 0.01)
        got = sums.toArrow()
        np.add.at(total, (got.column("piece").to_numpy(), got.column("lang").to_numpy()), got.column("n").to_numpy())
        p = total / total.sum(0)
        shared.destroy()
    tree.destroy()
    return Model(langs, p, trie)


def _new_scores(t: Trie, p: np.ndarray, body: np.ndarray, at: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Scores of the words ``which``, about CELLS bytes of words of like lengths at a time."""
    lens = at[which + 1] - at[which]
    order = np.argsort(lens, kind="stable")
    out = np.empty((len(which), p.shape[1]))
    for g in np.split(order, np.flatnonzero(np.diff(np.cumsum(lens[order] + t.longest) // CELLS)) + 1):
        own = which[g]
        out[g] = word_scores(t, *marked(body[B.ragged(at[own], lens[g])], lens[g]), p)
    return out


def _text_scores(m: Model, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The best language (its place; -1 for none) and the posterior under equal priors of each text."""
    index, known = m.known()
    best, posterior = np.full(len(text), -1), np.zeros(len(text))
    lettered = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    for lo, hi, data, offsets in B.slices(pc.utf8_lower(text)):
        words = B.Words(data, offsets, LETTER)
        body, at = words.compact()
        if not len(words.row):
            continue
        keys, one, back = np.unique(B.hash_runs(body, at), return_index=True, return_inverse=True)
        place = index.find(keys)
        if len(index) + int((place < 0).sum()) > CACHE:
            index.clear()
            place[:] = -1
        new = np.flatnonzero(place < 0)
        if len(new) > CACHE:  # more words in one slice than the cache holds
            scores = _new_scores(m.trie, m.p, body, at, one)
        else:
            if len(new):
                place[new] = index.add(keys[new])
                known[place[new]] = _new_scores(m.trie, m.p, body, at, one[new])
            scores = known[place]
        total = np.stack([np.bincount(words.row, scores[back, j], hi - lo) for j in range(len(m.langs))], 1)
        ok = lettered[lo:hi] & (words.counts > 0)
        with np.errstate(under="ignore"):
            posterior[lo:hi] = np.where(ok, 1 / np.exp(total - total.max(1, keepdims=True)).sum(1), 0)
        best[lo:hi] = np.where(ok, total.argmax(1), -1)
    return best, posterior


def predict(documents: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with lang_pred and score (the posterior under equal priors)."""
    keep = [c for c in keep if c not in FOUND[:2]]
    if not model.langs:
        return documents.select(*keep, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = documents.sparkSession.sparkContext.broadcast(model)
    names = pa.array([*model.langs, "und"])
    at = keep.index("text") if "text" in keep else len(keep)  # sent once

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, posterior = _text_scores(shared.value, batch.column(at))
            lang = names.take(pa.array(np.where(best < 0, len(names) - 1, best)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], lang, pa.array(posterior)], [*keep, "lang_pred", "score"])

    out = documents.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    return documents.select(*keep, *([F.col("text").cast("string")] if at == len(keep) else [])).mapInArrow(score, out)


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2


def identify(documents: DataFrame, keep: list[str], labels: DataFrame | None = None) -> DataFrame:
    """Learns from the rows of labels (documents, unless given) outside the held-out fold, and predicts all of documents."""
    model = learn((documents if labels is None else labels).where(~held_out()))
    keep = [c for c in keep if c not in FOUND]
    return predict(documents.withColumn("held_out", held_out()), model, [*keep, "held_out"])


def of_known_language(documents: DataFrame, least: float) -> DataFrame:
    """The rows of documents, as they are, whose text has a language with a score of at least ``least``."""
    model = learn(documents.where(~held_out()))
    if not model.langs:
        return documents.where(F.lit(False))
    shared, at = documents.sparkSession.sparkContext.broadcast(model), documents.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, posterior = _text_scores(shared.value, batch.column(at))
            yield batch.filter(pa.array((best >= 0) & (posterior >= least)))

    return documents.mapInArrow(keep, documents.schema)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read(spark, sf_dir, "documents"), ["doc_id"])
