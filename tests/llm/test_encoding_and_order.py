"""Byte-level BPE in pieces, filters in every order, and fill-in-the-middle, against slow versions."""

import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.comparing import SMALL
from tests.llm.test_llm import HARD, empty, hard, small_documents
from wakeline.llm import buffers as B
from wakeline.llm import fill_middle, filter_audit, tree_bpe

SPACE = "[\\x20\\x09-\\x0D]"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- op11 -------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tree_bpe.tokenizer_path())


ATOMS = ["a", "b", "s", "t", "re", "'", "'s", "'re", " ", "  ", "\n", "1", "22", "日本", "é", "!", "<|endoftext|>", "<|", "the", " ", "　", "\u0085", "😀", "\x00", "aaaa", "Ა"]


@pytest.mark.parametrize("leaf", [8, 40])
def test_pieces_equal_the_whole(library, leaf):
    r, words = random.Random(leaf), tree_bpe.ByteEncoder(tree_bpe.tokenizer_path(), leaf, 70)
    for _ in range(250):
        some = r.sample(ATOMS, r.randint(1, 5))
        text = "".join(r.choice(some) for _ in range(r.randint(1, 300)))
        want, raw = library.encode(text, add_special_tokens=False).ids, text.encode()
        data = np.frombuffer(raw, np.uint8)
        assert words.encode(data, np.array([0, len(data)]))[0].tolist() == want, text
        assert words.tree(raw).ids.tolist() == want, text
        assert words.long_text(raw).tolist() == want, text
    assert words.windows > 1000


def test_windows_grow_until_both_sides_agree(library):
    """Runs of one character are encoded from their start, so a join changes tokens far from it."""
    words = tree_bpe.ByteEncoder(tree_bpe.tokenizer_path(), 64)
    for text in ("a" * 5000, "=" * 3001, " " * 4097 + "x", "ab" * 3000, "日" * 1500, "123" * 999):
        assert words.tree(text.encode()).ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_a_table_of_units_that_is_full_starts_again(library, monkeypatch):
    monkeypatch.setattr(tree_bpe, "KNOWN_IDS", 50)
    words = tree_bpe.ByteEncoder(tree_bpe.tokenizer_path())
    for k in range(30):
        text = f"word{k} other{k * 7} and more, " * 3
        data = np.frombuffer(text.encode(), np.uint8)
        assert words.encode(data, np.array([0, len(data)]))[0].tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("spread", [tree_bpe.SPREAD, 1000, 0])
def test_rows_equal_the_library(spark, library, spread):
    rows = [*HARD, (20, "x" * 9000), (20, "x" * 9000), (21, "a<|endoftext|>b  <|endoftext|>"), (22, "日本語" * 2000 + " end")]
    got = tree_bpe.decode(tree_bpe.encode(hard(spark, rows), spread=spread, leaf=256, part=2000)).collect()
    want = [(i, library.encode(t or "", add_special_tokens=False).ids, t or "") for i, t in rows]
    order = lambda x: (x[0] is None, x[0], x[1])
    assert sorted(((r.doc_id, r.ids, r.text) for r in got), key=order) == sorted(want, key=order)


def test_ids_of_no_text(spark, library):
    ids = [[50256, 31, -1, 99999, 72], [165, 229], None, []]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(ids)], "doc_id long, ids array<int>")
    got = {r.doc_id: r.text for r in tree_bpe.decode(rows).collect()}
    assert got == {k: library.decode([i for i in x or [] if 0 <= i <= 50256], skip_special_tokens=False) for k, x in enumerate(ids)}


def test_no_rows_of_tokens(spark):
    assert tree_bpe.decode(tree_bpe.encode(empty(spark))).count() == 0


def test_op11_equals_the_library(spark, library):
    want = {}
    for i, text, _ in small_documents():
        ids = library.encode(text or "", add_special_tokens=False).ids
        want[i] = (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in tree_bpe.op11_byte_bpe(spark, SMALL).collect()} == want


# ---- op12 -------------------------------------------------------------------------------------


def brute_audit(documents, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    rows = []
    for i, text, source in documents:
        t = text or ""
        words = re.findall("[^\\x20\\x09-\\x0D]+", t)
        same = [j for j, other, _ in documents if (other or "") == t and j is not None]
        rows.append((source or "", {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and any(j < i for j in same),
        }, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        share = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[1][f]]
                share[f] += len(gone)
                left = [r for r in left if not r[1][f]]
                out[part, order, step] = [len(left), len(gone), sum(r[1][f] for r in own) - len(gone), sum(r[1][f] and sum(r[1].values()) == 1 for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (p, order, step), figures in out.items():
            if p == part:
                figures.append(share[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def audited(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def test_every_order_against_walking_it(spark):
    r = random.Random(3)
    texts = [None, "", "A B", "aa bb cc", " ".join(f"w{k}" for k in range(250)), "cost $ " * 150, "same " * 300, " ".join(f"W{k}" for k in range(199)) + " #", "ß" * 300]
    documents = [(r.choice([None, -5, 1, 2, 3, 3, 7, 9]), r.choice(texts), r.choice([None, "", "web", "book"])) for _ in range(120)]
    labels = [(1, 1, 0), (1, 0, 1), (2, None, 1), (3, 1, None), (7, 0, 0), (None, 1, 1), (99, 1, 1), (9, 1, 1), (9, 1, 1)]
    rows = spark.createDataFrame([(*d, "x", 1, 2) for d in documents], "doc_id long, text string, source string, part string, fails int, n long")
    said = spark.createDataFrame([(*x, 5) for x in labels], "doc_id long, quality int, toxic int, labelled long")
    got = audited(filter_audit.audit(filter_audit.cells(filter_audit.failures(rows), said)))
    assert got == brute_audit(documents, labels)
    assert len(got) == 600 * 3


def test_no_documents_and_no_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(filter_audit.cells(filter_audit.failures(empty(spark)), none)).count() == 0
    got = audited(filter_audit.audit(filter_audit.cells(filter_audit.failures(hard(spark)), none)))
    assert got == brute_audit([(i, t, f"s{(i or 0) % 2}") for i, t in HARD], [])


# ---- op13 -------------------------------------------------------------------------------------

UNIT = re.compile(f"{SPACE}*[^\\x20\\x09-\\x0D]+|{SPACE}+")


def brute_middle(doc_id, text):
    t = text or ""
    units = UNIT.findall(t)
    digest = sha("42:" + ("" if doc_id is None else str(doc_id)))
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, t
    if h[3] % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_words_of_eight_bytes_mark_unit_ends():
    r = random.Random(8)
    texts = ["".join(r.choice(" \t\r\x08\x0e\x1f!ab\x7fé日😀\xa0") for _ in range(r.randint(0, 40))) for _ in range(800)]
    for _, _, data, offsets in B.slices(pa.array(texts), 3000):
        lo = [0]
        units = fill_middle.Units(data, offsets)
        raw = [data[a:b].tobytes().decode() for a, b in zip(offsets, offsets[1:], strict=False)]
        want = [np.cumsum([0, *(len(u.encode()) for u in UNIT.findall(t))]) for t in raw]
        assert units.n.tolist() == [len(w) - 1 for w in want]
        for k in range(max(units.n) + 1):
            lo = np.minimum(k, units.n)
            assert units.end(lo).tolist() == [w[j] for w, j in zip(want, lo, strict=True)]


def test_forms_and_round_trip(spark):
    rows = [*HARD, *((100 + k, t) for k, t in enumerate(["<P", "a <M> b", "x<", "<S", " lead", "trail \n", "P>", "a<b>c " * 9, "é " * 700] * 12)), (None, None)]
    made = fill_middle.fill_in_middle(hard(spark, rows)).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in made), key=str)
    assert got == sorted(((i, *brute_middle(i, t), t or "") for i, t in rows), key=str)
    assert {r.form for r in made} == {"plain", "spm", "psm"}


def test_no_rows_to_cut(spark):
    assert fill_middle.fill_in_middle(empty(spark)).count() == 0
