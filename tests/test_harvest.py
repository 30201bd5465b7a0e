"""Sessions with cuts that later traffic proves wrong, with answers by hand, and a slow walk over random ones."""

import random

import pytest
from pyspark.sql import functions as F

from wakeline.operators import harvest, spread

TURNS = "session string, id long, ts_epoch double, has_body boolean, body_sha string, user_text string"
FETCHES = "session string, id long, path string, n long, tokens long"
CUTS = "session string, id long, pos long, path string, pointer string, target string, tokens long, applied boolean"


A, B, QUIET = "app/a.py", "app/b.py", "go on"


def turn(fetches=None, cuts=(), text=QUIET, sha=None):
    """fetches: {path: (n, tokens)}, None for a turn without a body; cuts: (path, tokens, applied)."""
    return fetches, cuts, text, sha


def blank(n):
    return [turn({})] * n


CUT_A = turn({}, [(A, 40, True)])
AGAIN = turn({A: (1, 5)})
# name: (turns, seconds between them, labels by (turn, scope, key), (cut reads, enforced, in shadow, tokens paid again))
CASES = {
    "cut, then fetched again": ([turn({A: (1, 50)}, [(A, 40, True)]), turn({A: (2, 60)})], 30, {(1, "targets", "1.0"): ("keep", "re-read", 60, 40, 2)}, (1, 1, 0, 60)),
    "in shadow it costs nothing": ([turn({A: (1, 50)}, [(A, 40, False)]), turn({A: (2, 60)})], 30, {(1, "targets", "1.0"): ("keep", "would-be-live", 0, 40, 2)}, (1, 0, 1, 0)),
    "a search lists the file, which is no fetch": ([turn({A: (1, 50)}, [(A, 40, True)]), turn({A: (1, 50)})], 30, {}, (1, 0, 0, 0)),
    "nothing after the last turn": ([turn({A: (1, 50)}), turn({A: (1, 50)}, [(A, 40, True)])], 30, {}, (1, 0, 0, 0)),
    "a complaint": ([turn({}), turn({}, text="No, that is wrong"), turn(None), turn({}, text="try again")], 30, {(1, "slots", "turn"): ("bad", "correction", None, None, 2)}, (0, 0, 0, 0)),
    "the same body twice, then a complaint": ([turn({}, sha="x"), turn({}, text="No, that is wrong", sha="x")], 30, {(1, "slots", "turn"): ("bad", "re-run", None, None, 2)}, (0, 0, 0, 0)),
    "the same body too late": ([turn({}, sha="x"), turn({}, sha="x")], 1801, {}, (0, 0, 0, 0)),
    "no body in between": ([turn({A: (1, 50)}, [(A, 40, True)]), turn(None, [(A, 9, True)]), turn({A: (1, 50)}), turn({A: (2, 7)})], 30, {(1, "targets", "1.0"): ("keep", "re-read", 7, 40, 4)}, (1, 1, 0, 7)),
    "two spellings": ([turn({}, [("x/retry.py", 40, True), ("/repo/x/retry.py", 41, True)]), turn({"/repo/x/retry.py": (1, 60)})], 30, {(1, "targets", "1.0"): ("keep", "re-read", 60, 40, 2)}, (1, 1, 0, 60)),
    "twenty turns": ([CUT_A, *blank(19), AGAIN], 30, {(1, "targets", "1.0"): ("keep", "re-read", 5, 40, 21)}, (1, 1, 0, 5)),
    "twenty-one turns": ([CUT_A, *blank(20), AGAIN], 30, {}, (1, 0, 0, 0)),
    "1,800 seconds": ([CUT_A, *blank(1), AGAIN], 900, {(1, "targets", "1.0"): ("keep", "re-read", 5, 40, 3)}, (1, 1, 0, 5)),
    "1,802 seconds": ([CUT_A, *blank(1), AGAIN], 901, {}, (1, 0, 0, 0)),
    "the nearest cut, the first observation": ([turn({}, [(A, 1, True)]), turn({}, [(A, 2, False)]), turn({A: (1, 10)}), turn({A: (2, 20), B: (1, 3)})], 30, {(2, "targets", "2.0"): ("keep", "would-be-live", 0, 2, 3)}, (2, 0, 2, 0)),
}


def test_cases(spark):
    turns, fetches, cuts = [], [], []
    for name, (bodies, step, _, _) in CASES.items():
        for k, (seen, cut, text, sha) in enumerate(bodies, 1):
            turns.append((name, k, float(k * step), seen is not None, sha or f"sha{k}", text))
            fetches += [(name, k, p, n, t) for p, (n, t) in (seen or {}).items()]
            cuts += [(name, k, i, p, f"message:{k}.{i}", f"{k}.{i}", t, a) for i, (p, t, a) in enumerate(cut)]
    turns, fetches, cuts = (spark.createDataFrame(x, s) for x, s in ((turns, TURNS), (fetches, FETCHES), (cuts, CUTS)))
    files = harvest.file_observations(turns, fetches, cuts).persist()
    labels = harvest.harvest_labels(files, harvest.turn_observations(turns)).persist()
    got = {name: {} for name in CASES}
    for r in labels.collect():
        got[r.session][r.request_id, r.scope, r.key] = (r.verdict, r.source.removeprefix("implicit:"), r.regret_tok, r.evicted_tok, r.at_id)
    assert got == {name: case[2] for name, case in CASES.items()}
    figures = {name: [0, 0, 0, 0] for name in CASES}
    for r in files.collect():
        own = figures[r.session]
        own[(harvest.CUT, harvest.RE_READ, harvest.WOULD_BE).index(r.source)] += r.n
        own[3] += r.regret_tok or 0
    assert {k: tuple(v) for k, v in figures.items()} == {name: case[3] for name, case in CASES.items()}
    s = harvest.harvest_summary(turns, files, labels).first()
    total = [sum(case[3][i] for case in CASES.values()) for i in range(4)]
    n = sum(len(case[0]) for case in CASES.values())
    assert (s.requests_scanned, s.bodies_available, s.skipped_no_body) == (n, n - 2, 2)
    assert (s.evicted_reads_seen, s.enforced, s.shadow, s.refetch_tok_paid, s.wrong_drops, s.labels_written) == (*total, total[1] + total[2], 9)
    assert s.per_1k == round(1000 * s.wrong_drops / n, 1)
    assert {r.source: (r.labels, r.regret_tok) for r in harvest.harvest_by_source(labels).collect()}["implicit:would-be-live"] == (2, 0)


def walk(turns, fetches, cuts, window, seconds):
    """The same, one turn after another over everything."""
    same = lambda a, b: a == b or a.endswith("/" + b) or b.endswith("/" + a)
    out, rows = [], {}
    for s, i, ts, body, *_ in turns:
        rows.setdefault(s, []).append((i, ts or 0, body))
    for s, own in rows.items():
        own.sort()
        before = {}
        for j, (i, ts, body) in enumerate(own):
            if not body:
                continue
            now = {p: (n, t) for s2, k, p, n, t in fetches if (s2, k) == (s, i)}
            for p, (n, t) in sorted(now.items()):
                if n <= before.get(p, 0):
                    continue
                for i2, ts2, body2 in own[max(0, j - window) : j][::-1]:
                    if not body2:
                        continue
                    if ts - ts2 > seconds:
                        break
                    live = []
                    for c in sorted(x for x in cuts if x[:2] == (s, i2)):
                        if not any(same(c[3], q[3]) for q in live):
                            live.append(c)
                    hit = next((c for c in live if same(c[3], p)), None)
                    if hit:
                        out.append((s, i2, i, p, hit[5], before.get(p, 0), t if hit[7] else 0))
                        break
            before = {p: n for p, (n, _) in now.items()}
    return sorted(out)


@pytest.mark.parametrize("chunk", [3, 7, 2048])
def test_chunks_change_nothing(spark, chunk):
    r = random.Random(chunk)
    turns, fetches, cuts = [], [], []
    for s in "ab":
        ts, gone = 0.0, False
        for i in range(60):
            ts += r.choice([5, 30, 400])
            gone = r.random() < (0.85 if gone else 0.2)  # runs of turns without a body, longer than a chunk
            turns.append((s, i * 10, ts, not gone, f"h{r.randint(0, 9)}", QUIET))
            fetches += [(s, i * 10, p, r.randint(1, 3), r.randint(1, 9)) for p in ("x/a.py", "a.py", "b/c.py", "c.py") if r.random() < 0.5]
            cuts += [(s, i * 10, k, r.choice(["a.py", "x/a.py", "y/a.py", "c.py"]), None, f"{i}.{k}", 1, r.random() < 0.5) for k in range(r.randint(0, 3))]
    frames = [spark.createDataFrame(x, y) for x, y in zip((turns, fetches, cuts), (TURNS, FETCHES, CUTS), strict=True)]
    got = harvest.file_observations(*frames, window=5, seconds=900.0, chunk=chunk).where(F.col("source") != harvest.CUT)
    assert sorted((x.session, x.request_id, x.at_id, x.path, x.target, x.before, x.regret_tok) for x in got.collect()) == walk(turns, fetches, cuts, 5, 900.0)


def test_decisions(spark):
    schema = "request_id long, pos int, slot string, applied boolean, candidates array<struct<target: string, keep: boolean, tokens: long, index: int>>, proof struct<applied: boolean, dropped: array<struct<kind: string, id: string, pointer: string, tokens: long, index: int>>>"
    rows = [
        (1, 0, "compact", True, [("m", False, 9, 0)], None),
        (1, 1, "all", False, None, (False, [("tool", "t", None, 1, None), ("message", "4", None, 7, 4), ("message", "5", "p5", None, 5)])),
        (2, 0, "compact", False, [("a", False, 3, 1), ("b", True, 3, 2), ("c", None, None, 3)], None),
        (2, 1, "effort", True, None, None),
        (3, 0, "compact", True, [("a", False, 3, 1)], (True, [])),
    ]
    got = sorted((r.request_id, r["index"], r.pointer, r.target, r.tokens, r.applied) for r in harvest.dropped(spark.createDataFrame(rows, schema)).collect())
    assert got == [(1, 4, "message:4", "4", 7, False), (1, 5, "p5", "5", 0, False), (2, 1, "message:a", "a", 3, True), (2, 3, "message:c", "c", 0, True)]
    seen = spark.createDataFrame([(1, 2, "X/a.py", False), (1, 4, "b.py", True), (1, 5, "c.py", False), (2, 0, "d.py", False)], "request_id long, idx int, path string, is_search boolean")
    cuts = harvest.cut_reads(harvest.dropped(spark.createDataFrame(rows, schema)), seen)
    assert sorted((r.request_id, r["index"], r.path) for r in cuts.collect()) == [(1, 4, "x/a.py"), (1, 5, "c.py"), (2, 1, "d.py")]


def test_numbers_and_neighbours_do_not_depend_on_the_stretch(spark):
    r = random.Random(2)
    rows = [(r.choice(["a", "b", None]), i, r.randint(0, 9)) for i in r.sample(range(-50, 300), 200)]
    df = spark.createDataFrame(rows, "k string, i long, v int")
    for width in (1, 7, 1000):
        got = spread.previous(spread.numbered(df, ["k"], "i", "no", width), ["k"], "i", ["i", "v"], "prev", width).collect()
        for k in ("a", "b", None):
            own = sorted((x for x in got if x.k == k), key=lambda x: x.i)
            assert [x.no for x in own] == list(range(len(own)))
            assert [x.prev for x in own] == [None, *((x.i, x.v) for x in own[:-1])]


def test_no_rows(spark):
    turns, fetches, cuts = (spark.createDataFrame([], x) for x in (TURNS, FETCHES, CUTS))
    files = harvest.file_observations(turns, fetches, cuts)
    labels = harvest.harvest_labels(files, harvest.turn_observations(turns))
    s = harvest.harvest_summary(turns, files, labels).first()
    assert labels.count() == 0 and s.requests_scanned == 0 and s.per_1k is None


# a person's verdict, what traffic says of files and of turns, the slot, and what comes out of it
TRUTH = [
    (None, [], [], "compact", (None, None, None)),
    ("good", [], [], "compact", ("good", "human", None)),
    ("uncertain", [], [], "compact", ("uncertain", None, None)),
    ("good", [("keep", "implicit:re-read")], [], "compact", ("good", "human+implicit", "keep")),
    ("good", [], [("bad", "implicit:re-run")], "compact", ("good", "human", "exclude")),
    ("bad", [("keep", "implicit:re-read")], [], "compact", ("mixed", "mixed", "keep")),
    ("bad", [("keep", "implicit:re-read")], [], "effort", ("bad", "human", None)),
    (None, [("keep", "implicit:re-read")], [("bad", "implicit:correction")], "compact", ("keep", "implicit:correction+re-read", "keep")),
    (None, [], [("bad", "implicit:correction")], "effort", ("exclude", "implicit:correction", "exclude")),
    ("uncertain", [], [("bad", "implicit:re-run")], "compact", ("exclude", "implicit:re-run", "exclude")),
    (None, [("drop", "implicit:re-read")], [], "compact", ("exclude", "implicit:re-read", "exclude")),
    ("bad", [("keep", None)], [], "compact", ("bad", "human", None)),
]


def test_truth_table_of_the_merge(spark):
    from wakeline.operators import verdicts

    people = [(k, slot, human) for k, (human, _, _, slot, _) in enumerate(TRUTH) if human]
    said = [(k, scope, *x) for k, (_, targets, slots, _, _) in enumerate(TRUTH) for scope, rows in (("targets", targets), ("slots", slots)) for x in rows]
    people = spark.createDataFrame(people, "request_id long, slot string, verdict string")
    traffic = spark.createDataFrame(said, "request_id long, scope string, verdict string, source string")
    got = {(r.request_id, r.slot): (r.verdict, r.label_source, r.implicit_label) for r in verdicts.label_view(people, traffic).collect()}
    assert {k: got.get((k, slot)) for k, (_, _, _, slot, _) in enumerate(TRUTH)} == {k: want if human or a or b else None for k, (human, a, b, _, want) in enumerate(TRUTH)}
