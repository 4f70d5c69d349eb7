"""What keeps the core's queries within bounds on large tables: no shuffles of words, filters that lose nothing."""

import random
from collections import Counter


from seqloom.operators import cluster as C
from seqloom.operators import reads as R
from seqloom.operators import words as W


def test_words_are_counted_where_they_are_read(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ABCZ") for _ in range(rng.randint(1, 90))) for _ in range(300)] + ["ÄBCDÄBCDE", "ABCDEFGHIJKLMNOP" * 9, ""]
    rows = [(k, t, len(t)) for k, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "seq_idx long, seq string, len int")
    assert "Exchange" not in W.kmer_counts(table, 5)._jdf.queryExecution().executedPlan().toString()
    for extra in ([], [(7, "ABCABCABC", 9), (None, "ABCABC", 6), (None, "BCABCA", 6)]):
        for k in (2, 5, 14):
            want = Counter((i, t[at : at + k]) for i, t, n in rows + extra for at in range(n - k + 1))
            got = W.kmer_counts(spark.createDataFrame(rows + extra, table.schema), k).collect()
            assert {(r["seq_idx"], r["word"]): r["n"] for r in got} == want and len(got) == len(want)
    bases = spark.createDataFrame([(1, "ACGTNACGTACGTU", 14)], table.schema)
    assert {r["word"]: r["n"] for r in W.kmer_counts(bases, 4, "base").collect()} == {"ACGT": 3, "CGTA": 1, "GTAC": 1, "TACG": 1}


def test_a_screen_joins_only_what_can_pass(spark, monkeypatch):
    rng = random.Random(8)
    letters = "ARNDCQEGHILKMFPSTWYV"
    references = [(k, "".join(rng.choice(letters) for _ in range(rng.randint(30, 200)))) for k in range(70)]
    queries = [(k, "".join(rng.choice(letters) for _ in range(rng.randint(20, 300)))) for k in range(150)]
    queries += [(200 + k, "".join(c if rng.random() < 0.85 else rng.choice(letters) for c in rng.choice(references)[1])) for k in range(40)]
    frame = lambda rows: spark.createDataFrame([(i, s, len(s)) for i, s in rows], "seq_idx long, seq string, len int")
    lengths = C.Lengths(least=0.4, less=90)
    met = []
    kept = C.W.candidate_pairs
    monkeypatch.setattr(C.W, "candidate_pairs", lambda q, *a: met.append(q.count()) or kept(q, *a))
    key = lambda df: sorted(tuple(r) for r in df.select("q_idx", "r_idx", "strand", "look_pos", "look_rank", "identity").collect())
    for kind, k, identity in (("protein", 4, 0.7), ("base", 5, 0.8)):
        turn = (lambda rows: [(i, s.translate(str.maketrans(letters, "ACGT" * 5))) for i, s in rows]) if kind == "base" else list
        q, r = frame(turn(queries)), frame(turn(references))
        got = key(C.matches(q, r, identity, k, kind, same=False, lengths=lengths))
        few = met[-1]
        with monkeypatch.context() as m:
            m.setattr(C, "NEAR_LETTERS", -1)
            assert key(C.matches(q, r, identity, k, kind, same=False, lengths=lengths)) == got
        assert met[-1] == 190 and (few < 60 or kind == "base") and len(got) > 10


def test_overlaps_meet_only_in_what_overlaps(spark):
    rng = random.Random(17)
    word = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    common, other = word(30), word(40)
    # All begin or end alike, but only two overlap.
    rows = [(k, word(60) + common if k % 2 else common + word(60)) for k in range(400)] + [(900, other + word(90)), (901, word(70) + other)]
    table = spark.createDataFrame([(i, s, len(s)) for i, s in rows], "seq_idx long, seq string, len int")
    found = R.overlaps(table, 20)
    got = {tuple(r) for r in found.collect()}
    want = set()
    for i, q in rows:
        for strand, text in (("+", q), ("-", q.translate(str.maketrans("ACGT", "TGCA"))[::-1])):
            for j, r in rows:
                if len(r) > len(q) or len(r) == len(q) and j < i:
                    for phase, m in ((1, max((m for m in range(20, len(text)) if m <= len(r) and text[:m] == r[-m:]), default=0)), (2, max((m for m in range(20, len(text) + 1) if text[-m:] == r[:m]), default=0))):
                        if m:
                            want.add((i, j, phase, m, strand))
    assert got == want
    assert (901, 900, 2, 40, "+") in got
    assert "q_seq" not in found._jdf.queryExecution().optimizedPlan().toString()


def _shared(q, r, k, kind):
    cut = lambda s: [w for w in (s[j : j + k] for j in range(len(s) - k + 1)) if kind == "protein" or not set(w) - set("ACGT")]
    mine, other = sorted(cut(q)), sorted(cut(r))
    both = Counter(mine) & Counter(other)
    return sum(both.values()), min((mine.index(w) for w in both), default=None), len(q) - k + 1 - len(mine)


def test_candidates_are_counted_block_against_block(spark, monkeypatch):
    from seqloom.operators import blocks as B

    monkeypatch.setattr(B, "BLOCK_ROWS", 17)
    monkeypatch.setattr(B, "QUERIES", 5)
    rng = random.Random(31)
    for kind, letters, k, identity in (("protein", "ACD", 3, 0.8), ("base", "ACGTN", 3, 0.8), ("protein", "ACDEFGHIKLMNPQRSTVWY", 6, 0.9)):
        seeds = ["".join(rng.choice(letters) for _ in range(rng.randint(k + 1, 160))) for _ in range(20)]
        texts = seeds + ["".join(c if rng.random() < 0.95 else rng.choice(letters) for c in s)[: rng.randint(k + 1, 200)] for s in seeds * 3] + ["A" * 400, "A" * 300, "A" * 300]
        rows = [(3 * n - 50, s) for n, s in enumerate(texts)]
        table = spark.createDataFrame([(i, s, len(s)) for i, s in rows] + [(None, "A" * 90, 90)], "seq_idx long, seq string, len int")
        need = {r["seq_idx"]: r["w"] for r in table.select("seq_idx", W.required_counts(table["len"], k, identity, 2 if kind == "protein" else 4, kind)[2].alias("w")).collect()}
        some, want = {}, {}
        for i, q in rows:
            found = []
            for j, r in rows:
                if (-len(r), j) < (-len(q), i):
                    n, look, skipped = _shared(q, r, k, kind)
                    wanted = max(need[i] - skipped, 1) if skipped else need[i]
                    if n >= 2:
                        some[i, j] = n, look + skipped
                    if n >= max(wanted, 1) and len(q) - k + 2 - look - skipped >= wanted:
                        found.append((look + skipped, -len(r), j, n))
            want |= {(i, j): (n, look, rank + 1) for rank, (look, _, j, n) in enumerate(sorted(found))}
        pairs = W.candidate_pairs(table, table, k, identity, kind)
        assert {(r["q_idx"], r["r_idx"]): (r["shared"], r["look_pos"], r["look_rank"]) for r in pairs.collect()} == want and len(want) > 30
        shared = W.shared_words(table, table, k, kind, least=2)
        got = shared.collect()
        assert {(r["q_idx"], r["r_idx"]): (r["shared"], r["look_pos"]) for r in got} == some and len(got) == len(some)
        for plan in (pairs, shared):
            text = plan._jdf.queryExecution().optimizedPlan().toString()
            assert "q_words" not in text and "explode" not in text
        assert "hashpartitioning" not in shared._jdf.queryExecution().executedPlan().toString()


def test_overlaps_of_long_repeats_are_hashed_in_constant_time(spark):
    """Each place of a text of one short word begins and ends like others do; a hash over all letters for each of them takes minutes."""
    import time

    rows = [(1, "AC" * 40_000), (2, "AC" * 25_000 + "A"), (3, "GT" * 20_000), (4, "T" * 30 + "AC" * 20)]
    table = spark.createDataFrame([(i, s, len(s)) for i, s in rows], "seq_idx long, seq string, len int").repartition(1)
    start = time.time()
    got = {tuple(r) for r in R.overlaps(table, 20).collect()}
    assert time.time() - start < 40
    full = lambda q, r, strand: {(q, r, phase, m, strand) for phase, m in _brute(dict(rows)[q], dict(rows)[r], strand)}
    want = set().union(*[full(q, r, strand) for q, r in ((2, 1), (3, 1), (3, 2), (4, 1), (4, 2), (4, 3)) for strand in "+-"])
    assert got == want and len(want) > 8


def _brute(q, r, strand):
    q = q if strand == "+" else q.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    one = next((m for m in range(min(len(q) - 1, len(r)), 19, -1) if q[:m] == r[-m:]), None)
    two = next((m for m in range(min(len(q), len(r)), 19, -1) if q[-m:] == r[:m]), None)
    return [(phase, m) for phase, m in ((1, one), (2, two)) if m]


def test_overlap_clusters_need_no_pairs(spark, monkeypatch):
    """The greedy rule over equal starts and ends gives what it gives over the pairs, whose number grows with the square."""
    rng = random.Random(12)
    base = "".join(rng.choice("ACGT") for _ in range(150))
    turned = base[::-1].translate(str.maketrans("ACGT", "TGCA"))
    texts = [of[at : at + rng.randint(22, 70)] for of, at in ((rng.choice([base, turned]), rng.randrange(120)) for _ in range(60))] + ["AC" * 20, "CA" * 15, base[:40], base[:40]]
    rows = [(k, t) for k, t in enumerate(texts) if len(t) > 10]
    reps, want = [], {}
    for i, q in sorted(rows, key=lambda r: (-len(r[1]), r[0])):
        met = [(phase, -m, strand == "-", no, strand, rep) for no, (rep, r) in enumerate(reps) for strand in "+-" for phase, m in _brute(q, r, strand)]
        if met:
            phase, m, _, no, strand, rep = min(met)
            want[i] = (rep, no, False, phase, -m, strand)
        else:
            want[i] = (i, len(reps), True, None, None, None)
            reps.append((i, q))
    monkeypatch.setattr(R, "overlaps", None)
    got = C.overlap_clusters(spark.createDataFrame([(i, s, len(s)) for i, s in rows], "seq_idx long, seq string, len int"), 20)
    assert {r["seq_idx"]: (r["rep_idx"], r["cluster_no"], r["is_rep"], r["phase"], r["overlap"], r["strand"]) for r in got.collect()} == want
    assert 3 < len(reps) < len(rows) - 10
