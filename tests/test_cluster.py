"""Alignment, candidates and clustering against a serial model written for clarity."""

import math
import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators import cluster as C
from seqloom.operators import reads as R
from seqloom.operators import verify as V
from seqloom.operators import words as W
from seqloom.operators.verify import BONUS, UNIT, Limits, Scoring, align, diagonal_test, encode, limited

PROTEIN = "ARNDCQEGHILKMFPSTWYV"
ORDER = {letter: k for k, letter in enumerate(PROTEIN)}


def serial_align(q, r, left, centre, right, scoring):
    """Cell by cell in plain Python; identical letters on the path."""
    n1, n2 = len(q), len(r)
    gap, ext = scoring.gap * UNIT, scoring.extend * UNIT
    score, back = {}, {}
    for i in range(n1 + 1):
        for j in range(max(0, i + left), min(n2, i + right) + 1):
            if i == 0 or j == 0:
                score[i, j], back[i, j] = ext * (i + j), "" if i == j else "left" if i == 0 else "top"
                continue
            s = scoring.matrix[q[i - 1]][r[j - 1]] * UNIT
            if s > 0:
                s += BONUS[abs(j - i - centre) & 3]
            best, way = score[i - 1, j - 1] + s, "diagonal"
            open_ = ext if i == n1 or j == n2 else gap
            if (i, j - 1) in score and j - 1 - i >= left:
                other = score[i, j - 1] + (ext if back[i, j - 1] == "left" else open_)
                if other > best:
                    best, way = other, "left"
            if (i - 1, j) in score and j - i + 1 <= right:
                other = score[i - 1, j] + (ext if back[i - 1, j] == "top" else open_)
                if other > best:
                    best, way = other, "top"
            score[i, j], back[i, j] = best, way
    i, j = (n2 - left, n2) if n2 - n1 < left else (n1, min(n2, n1 + right))
    same = 0
    while i > 0 and j > 0:
        way = back[i, j]
        if way == "diagonal":
            same += q[i - 1] == r[j - 1]
            i, j = i - 1, j - 1
        elif way == "left":
            j -= 1
        else:
            i -= 1
    return int(same)


def serial_diagonal(q, r, band, least, identity, word):
    n1, n2 = len(q), len(r)
    total = n1 + n2 - 1
    votes, heavy = [0] * (total + 1), [0] * (total + 1)
    for i in range(n1 - word + 1):
        for j in range(n2 - word + 1):
            if all(q[i + k] == r[j + k] for k in range(word)):
                votes[n1 - 1 + j - i] += 1
                heavy[n1 - 1 + j - i] += 1 + sum(q[i + k] != q[i + k + 1] for k in range(word - 1))
    low = max(least - 1, 0)
    high = total - low
    last = min(low + band - 1, high)
    run, peak, tallest, start, end = 0, 0, 0, low, last
    for d in range(low, last + 1):
        run += heavy[d]
        if heavy[d] > tallest:
            tallest, peak = heavy[d], d
    best = run
    for k, j in zip(range(low, total), range(last + 1, high)):
        run += heavy[j] - heavy[k]
        if run > best:
            best, start, end = run, k + 1, j
            if heavy[j] > tallest:
                tallest, peak = heavy[j], j
    reach = int((1 - identity) * (total - peak if peak > n1 else peak)) + 1
    while start < peak and (peak - start > reach or votes[start] < 1):
        start += 1
    while end > peak and (end - peak > reach or votes[end] < 1):
        end -= 1
    return sum(votes[start : end + 1]), start - n1 + 1, peak - n1 + 1, end - n1 + 1


def mutated(rng, seq, letters, changes):
    seq = list(seq)
    for _ in range(changes):
        at = rng.randrange(len(seq))
        kind = rng.random()
        if kind < 0.7:
            seq[at] = rng.choice(letters)
        elif kind < 0.85:
            del seq[at]
        else:
            seq.insert(at, rng.choice(letters))
    return "".join(seq)


@pytest.mark.parametrize("kind", ["protein", "base"])
def test_alignment_and_diagonals(kind):
    rng = random.Random(kind)
    scoring = Scoring.protein() if kind == "protein" else Scoring.base()
    letters = PROTEIN if kind == "protein" else "ACGT"
    qs, rs, bands, want = [], [], [], []
    for _ in range(40):
        r = "".join(rng.choice(letters) for _ in range(rng.randint(20, 60)))
        q = mutated(rng, r, letters, rng.randint(0, 12))
        q, r = encode(q, scoring), encode(r, scoring)
        least = max(1, int(0.6 * len(q)))
        test = diagonal_test(q, r, min(20, len(q) + len(r) - 2), least, 0.7, scoring.word)
        assert test == serial_diagonal(q.tolist(), r.tolist(), min(20, len(q) + len(r) - 2), least, 0.7, scoring.word)
        _, left, centre, right = test
        if right < len(r) and left > -len(q) and left <= right:
            qs.append(q), rs.append(r), bands.append((left, centre, right))
            want.append(serial_align(q.tolist(), r.tolist(), left, centre, right, scoring))
    assert len(want) > 25
    assert align(qs, rs, np.array(bands), scoring)[:, 0].tolist() == want


def test_alignment_details():
    scoring = Scoring.protein()
    q, r = "ACDEFGHIKLMNPQRSTVWY", "ACDEFGHIKWWWLMNPQRSTVWA"
    made = align([encode(q, scoring)], [encode(r, scoring)], np.array([[-1, 0, 4]]), scoring)[0]
    assert made[[V.IDENTICAL, V.Q_FROM, V.Q_TO, V.R_FROM, V.R_TO, V.UNEQUAL, V.GAPS, V.COLUMNS]].tolist() == [19, 0, 19, 0, 22, 1, 1, 23]
    # The best stretch leaves out the unequal end.
    assert made[[V.BEST_Q_FROM, V.BEST_Q_TO, V.BEST_R_FROM, V.BEST_R_TO, V.LOCAL_IDENTICAL, V.LOCAL_COLUMNS]].tolist() == [0, 18, 0, 21, 19, 22]


def test_limits(spark):
    rows = spark.createDataFrame([(10, 20, 0, 9, 5, 14, 0.1), (10, 20, 2, 6, 0, 4, 0.1)], "q_len int, r_len int, q_from long, q_to long, r_from long, r_to long, distance float")
    rows = rows.selectExpr("*", "q_from AS best_q_from", "q_to AS best_q_to", "r_from AS best_r_from", "r_to AS best_r_to")
    pick = lambda **k: [r["q_from"] for r in limited(rows, Limits(**k)).collect()]
    assert pick() == [0, 2] and pick(query_share=0.6) == [0] and pick(reference_share=0.5) == [0] and pick(query_left=5) == [0, 2]
    assert pick(unmatched=0) == [0] and pick(unmatched=3) == [0, 2] and pick(most_distance=0.05) == [] and pick(least=11) == [] and pick(shortest=0.6) == []


def test_score_matrix_is_symmetric_and_known():
    m = Scoring.protein().matrix
    assert all(m[i][j] == m[j][i] for i in range(21) for j in range(21))
    assert m[ORDER["W"]][ORDER["W"]] == 11 and m[ORDER["W"]][ORDER["C"]] == -2 and m[ORDER["D"]][ORDER["E"]] == 2


def serial_cluster(records, identity, k):
    """The greedy loop itself, for proteins: longest first, first match in look order."""
    scoring = Scoring.protein()
    order = sorted(records, key=lambda r: (-len(r[1]), r[0]))
    reps, result = [], {}
    code = {letter: chr(65 + n) for n, letter in enumerate(PROTEIN)}

    def required(n):
        rest = (n - k) / (n * k)
        out = []
        for m, share in ((2, 1 - (1 - identity) * 2), (k, 1 - (1 - identity) * k)):
            old = max(0, int(share * n))
            strict = max(0, n - m - int(m * math.ceil((1 - identity) * n)))
            new = (identity - (1.0 - rest)) / rest
            out.append(int(new * strict + (1.0 - new) * old) if identity > 1.0 - rest else old)
        old, strict = int(identity * n) - 2 + 1, max(0, n - 2 - int(2 * math.ceil((1 - identity) * n)))
        new = (identity - (1.0 - rest)) / rest
        return int(new * strict + (1.0 - new) * old) if identity > 1.0 - rest else old, *out

    for idx, seq in order:
        n = len(seq)
        letters, shorts, words = required(n)
        mine = sorted("".join(code[c] for c in seq[i : i + k]) for i in range(n - k + 1))
        touched = []
        for rank, (r_idx, r_seq, r_words) in enumerate(reps):
            shared = sum(min(mine.count(w), r_words.count(w)) for w in set(mine) & set(r_words))
            if shared and shared >= words:
                look = min(mine.index(w) for w in set(mine) & set(r_words))
                if n - k + 1 - look + 1 >= words:
                    touched.append((look, rank, r_idx, r_seq))
        for _, rank, r_idx, r_seq in sorted(touched):
            q, r = encode(seq, scoring), encode(r_seq, scoring)
            found, left, centre, right = serial_diagonal(q.tolist(), r.tolist(), min(20, n + len(r) - 2), letters, identity, 2)
            if found < shorts or not (right < len(r) and left > -n and left <= right):
                continue
            same = serial_align(q.tolist(), r.tolist(), left, centre, right, scoring)
            if same >= letters and float(np.float32(same) / np.float32(n)) >= identity:
                result[idx] = (r_idx, rank)
                break
        else:
            result[idx] = (idx, len(reps))
            reps.append((idx, seq, ["".join(code[c] for c in seq[i : i + k]) for i in range(n - k + 1)]))
    return result


def test_clustering_equals_the_serial_loop(spark):
    rng = random.Random(8)
    records = []
    for _ in range(8):
        seed = "".join(rng.choice(PROTEIN) for _ in range(rng.randint(30, 50)))
        for _ in range(rng.randint(1, 6)):
            records.append((len(records), mutated(rng, seed, PROTEIN, rng.randint(0, 6))))
    table = spark.createDataFrame([(i, s, len(s)) for i, s in records], "seq_idx long, seq string, len int")
    got = {r["seq_idx"]: (r["rep_idx"], r["cluster_no"]) for r in C.cluster(table, 0.8, 3).collect()}
    assert got == serial_cluster(records, 0.8, 3)


@pytest.mark.parametrize("seed", range(4))
def test_rounds_equal_the_serial_rule(spark, seed):
    rng = random.Random(seed)
    n = 30
    pairs = [(q, r) for q in range(n) for r in range(q) if rng.random() < 0.12]
    reps = set()
    for q in range(n):
        if not any(r in reps for a, r in pairs if a == q):
            reps.add(q)
    nodes = spark.createDataFrame([(i,) for i in range(n)], "seq_idx long")
    got = C.select_representatives(nodes, spark.createDataFrame(pairs, "q_idx long, r_idx long")).collect()
    assert {r["seq_idx"] for r in got} == reps and len(got) == len(reps)


def test_screen_finds_mutants_and_novel_ones(spark):
    rng = random.Random(2)
    refs = [(i, "".join(rng.choice(PROTEIN) for _ in range(40))) for i in range(5)]
    queries = [(10 + i, mutated(rng, s, PROTEIN, 2)) for i, s in refs] + [(99, "".join(rng.choice(PROTEIN) for _ in range(40)))]
    make = lambda rows: spark.createDataFrame([(i, s, len(s)) for i, s in rows], "seq_idx long, seq string, len int")
    got = {r["q_idx"]: r["r_idx"] for r in C.screen(make(queries), make(refs), 0.8, 3).collect()}
    assert got == {10 + i: i for i in range(5)}
    assert [r["seq_idx"] for r in C.novel(make(queries), make(refs), 0.8, 3).collect()] == [99]


def test_screen_keeps_to_lengths_and_divides_by_the_shorter(spark):
    """By default a reference is at least as long as the query; looser bounds let a longer query in, whose identity is the share of the reference."""
    rng = random.Random(12)
    long = "".join(rng.choice(PROTEIN) for _ in range(60))
    make = lambda rows: spark.createDataFrame([(i, s, len(s)) for i, s in rows], "seq_idx long, seq string, len int")
    queries, references = make([(10, long), (11, long[:50])]), make([(0, long[:54])])
    got = {r["q_idx"]: r["identity"] for r in C.screen(queries, references, 0.8, 3).collect()}
    assert set(got) == {11} and got[11] == 1.0
    got = {r["q_idx"]: r["identity"] for r in C.screen(queries, references, 0.8, 3, lengths=C.Lengths(least=0.5, less=20)).collect()}
    assert set(got) == {10, 11} and got[10] == 1.0
    assert C.screen(queries, references, 0.8, 3, lengths=C.Lengths(more=2)).count() == 0


def test_candidates_equal_a_full_join(spark):
    """Prefix-filtered pairs against all pairs of words, with multiplicity, ties and repeated words; proteins and bases with unknown letters."""
    rng = random.Random(13)
    for kind, letters, k in (("protein", "ACDE", 2), ("base", "ACGTN", 3)):
        records = [(i, "".join(rng.choice(letters) for _ in range(rng.randint(k, 25)))) for i in range(40)]
        records += [(40, records[0][1]), (41, mutated(rng, records[1][1], letters, 1)), (42, "A" * 20), (43, "A" * 18)]
        table = spark.createDataFrame([(i, s, len(s)) for i, s in records], "seq_idx long, seq string, len int")
        cut = {i: sorted(w for w in (s[j : j + k] for j in range(len(s) - k + 1)) if kind == "protein" or "N" not in w) for i, s in records}
        want = {}
        for q, s in records:
            skipped = max(0, len(s) - k + 1) - len(cut[q])
            for r, t in records:
                if (len(t), -r) > (len(s), -q) and q != r:
                    shared = sum(min(cut[q].count(w), cut[r].count(w)) for w in set(cut[q]))
                    if shared >= 3:
                        want[q, r] = (shared, min(cut[q].index(w) for w in set(cut[q]) & set(cut[r])) + skipped)
        got = {(r["q_idx"], r["r_idx"]): (r["shared"], r["look_pos"]) for r in W.shared_words(table, table, k, kind, least=3).collect()}
        assert got == want and len(want) > 20


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(14)
    seqs = ["".join(rng.choice("ACGT") for _ in range(rng.choice([20, 35, 50]))) for _ in range(12)]
    for s in list(seqs):
        for _ in range(4):
            t = list(s)
            for _ in range(rng.randint(0, 5)):
                t[rng.randrange(len(t))] = rng.choice("ACGT")
            seqs.append("".join(t))
    table = spark.createDataFrame([(i, s, len(s)) for i, s in enumerate(seqs)], "seq_idx long, seq string, len int")
    for errors, block in ((0, 10), (3, 10), (2, 30)):
        got = {(r["q_idx"], r["r_idx"], r["mismatches"]) for r in R.near_duplicates(table, errors, block).collect()}
        want = set()
        for i, q in enumerate(seqs):
            for j, r in enumerate(seqs[:i]):
                wrong = sum(a != b for a, b in zip(q, r, strict=False))
                if len(q) == len(r) and q[:block] == r[:block] and wrong <= errors:
                    want.add((i, j, wrong))
        assert got == want and want


def test_ranges_number_as_one_window(spark, monkeypatch):
    from seqloom.operators import order as O

    rows = spark.createDataFrame([(k, (k * 37) % 50) for k in range(400)], "id long, key long")
    want = {r["id"]: r["place"] for r in O.with_place(rows, [F.desc("key"), F.asc("id")]).collect()}
    monkeypatch.setattr(O, "RANGE_ROWS", 60)
    assert {r["id"]: r["place"] for r in O.with_place(rows, [F.desc("key"), F.asc("id")]).collect()} == want
    monkeypatch.setattr(W, "SALT_ROWS", 90)
    lengths = rows.select(F.col("id").alias("seq_idx"), (F.col("key") % 3 + 5).cast("int").alias("len"))
    got = {r["seq_idx"]: r["rank"] for r in W.length_ranks(lengths).collect()}
    order = sorted(((k * 37) % 50 % 3 + 5, -k) for k in range(400))[::-1]
    assert got == {-k: n for n, (_, k) in enumerate(order)}


def test_hits_and_hierarchy_follow_the_files(spark):
    """Lines of a hit table with and without coordinates, and a hierarchy in which only the input's order tells rows apart."""
    from seqloom.operators import members as M

    rows = [(0, 0, "a", 120, True, None), (0, 1, "b", 110, False, "97.50%"), (0, 2, "c", 100, False, "3:102:5:104/95.00%"), (1, 0, "d", 90, False, "1:90:1:90/+/96.67%")]
    table = spark.createDataFrame(rows, "cluster_no long, member_pos int, id string, len long, is_rep boolean, iden string")
    got = [r["value"] for r in M.hit_lines(M.hit_table(table)).orderBy("cluster_no", "place").collect()]
    assert got == ["b\ta\t97.50\t-96.5\t-2\t0\t97.50%\t\t\t\t0\t-277.5", "c\ta\t95.00\t100\t5\t0\t3\t102\t5\t104\t0\t270", "d\t\t96.67\t90\t2\t0\t1\t90\t1\t90\t0\t258"]
    levels = [(i, 1, level, cid, rep) for level, cells in ((1, {"x": (0, 0), "y": (0, 1), "z": (1, 1), "u": (0, 0)}), (2, {"x": (5, 0), "y": (5, 1), "z": (4, 0), "u": (5, 0)})) for i, (cid, rep) in cells.items()]
    tree = spark.createDataFrame(levels, "id string, len int, level int, cid long, rep int")
    ordinals = spark.createDataFrame([("u", 9), ("x", 3), ("y", 1), ("z", 2)], "id string, ordinal int")
    assert [r["id"] for r in M.sort_hierarchy(tree, ordinals).orderBy("place").collect()] == ["z", "y", "x", "u"]
    with pytest.raises(ValueError):
        M.sort_hierarchy(tree, ordinals, levels=3)


def test_overlaps_equal_brute_force(spark):
    rng = random.Random(15)
    base = "".join(rng.choice("ACGT") for _ in range(200))
    turned = base[::-1].translate(str.maketrans("ACGT", "TGCA"))
    seqs = []
    for _ in range(30):
        of, start = rng.choice([base, turned]), rng.randrange(150)
        seqs.append(of[start : start + rng.randint(6, 45)])
    seqs += ["A" * 20, "A" * 25, "ACACACACACACAC", "CACACACACACA", seqs[0]]
    table = spark.createDataFrame([(i, s, len(s)) for i, s in enumerate(seqs)], "seq_idx long, seq string, len int")
    for least, share in ((8, 0.0), (5, 0.6)):
        got = {(r["q_idx"], r["r_idx"], r["phase"], r["overlap"], r["strand"]) for r in R.overlaps(table, least, share).collect()}
        want = set()
        for i, s in enumerate(seqs):
            for strand, q in (("+", s), ("-", s[::-1].translate(str.maketrans("ACGT", "TGCA")))):
                for j, r in enumerate(seqs):
                    if (len(r), -j) > (len(q), -i) and i != j:
                        low = max(least, int(len(q) * share))
                        for phase, found in ((1, [m for m in range(low, min(len(q) - 1, len(r)) + 1) if q[:m] == r[-m:]]), (2, [m for m in range(low, min(len(q), len(r)) + 1) if q[-m:] == r[:m]])):
                            if found:
                                want.add((i, j, phase, max(found), strand))
        assert got == want and len(want) > 20


def test_sizes_by_length_carry_the_last_length(spark):
    from seqloom.operators import members as M

    rows = [(0, 0, "a", 120, True), (1, 0, "b", 110, False), (1, 1, "c", 100, False), (2, 0, "d", 200, True), (2, 1, "e", 5, False), (2, 2, "f", 5, False)]
    table = spark.createDataFrame(rows, "cluster_no long, member_pos int, id string, len long, is_rep boolean")
    got = [tuple(r) for r in M.size_by_length(table, "1,2-3,4-up,7,2-up", "1-149,150-250,151-up").orderBy("place").collect()]
    assert got == [(0, "1", 1, 1, 1, 0, 0), (1, "2-3", 5, 2, 1, 1, 0), (2, "4-up", 0, 0, 0, 0, 0), (3, "7", 0, None, 0, 0, 0), (4, "2-up", 5, 2, 1, 1, 0), (5, "Total", 11, 5, 3, 2, 0)]


def test_chimeras_are_told_from_their_parents(spark):
    from seqloom.operators import chimera as H

    rng = random.Random(21)
    a, b, c, other = ("".join(rng.choice("ACGT") for _ in range(160)) for _ in range(4))
    rows = [(0, a, 50), (1, b, 40), (2, a[:80] + b[80:], 5), (3, c, 30), (4, mutated(rng, a, "ACGT", 0)[:159] + "A", 4), (5, b[:70] + other[70:], 6), (6, b[:60] + c[60:], 3), (7, c[:90] + a[90:], 1), (8, other[:40], 9)]
    table = spark.createDataFrame(rows, "cluster_no long, seq string, abundance long")
    got = {r["cluster_no"]: (r["parent_1"], r["parent_2"]) for r in H.chimeric_clusters(table).collect()}
    assert got == {2: (0, 1), 6: (1, 3)}  # 7 is too rare to be judged
    assert H.chimeric_clusters(table, least=1).count() == 3 and H.chimeric_clusters(table, ratio=20.0).count() == 0
    assert H.chimeric_clusters(table.limit(2)).count() == 0
    members = table.select("cluster_no", F.explode(F.sequence(F.lit(1), F.col("abundance"))).alias("m"))
    one, two = H.split_by_chimeras(members, H.chimeric_clusters(table))
    assert two.select("cluster_no", "parent_1", "parent_2").distinct().orderBy("cluster_no").collect() == [(0, 0, 1), (1, 1, 2)]
    assert one.groupBy("cluster_no").count().orderBy("cluster_no").first()["count"] == 50


def serial_chimeras(rows, shared=30, percent=1.0, ratio=1.0, least=2):
    """One sequence after the other, against all that may be parents; ``rows`` are (cluster, letters, abundance)."""
    prefix = len(os.path.commonprefix([s for _, s, _ in rows]))
    primer, found, listed = prefix if prefix >= 15 else 0, {}, []
    wrong = lambda a, b: sum(x != y for x, y in zip(a, b))

    def run(a, b, most):
        for k, (x, y) in enumerate(zip(a, b)):
            most -= x != y
            if most < 0:
                return k
        return min(len(a), len(b))

    for cluster, q, abundance in sorted((r for r in rows if r[2] >= least), key=lambda r: (-r[2], r[0])):
        n = len(q)
        few, more = (int(np.float32(f) * np.float32(n) * np.float32(percent)) for f in (0.01, 0.015))
        met = {}
        for at in range(primer, n - shared + 1) if n >= 2 * shared + primer else ():
            for k, (_, r, _) in enumerate(listed):
                for place in range(primer, len(r) - shared + 1):
                    if r[place : place + shared] == q[at : at + shared]:
                        met.setdefault(k, {}).setdefault(place - at, []).append(1)
        starts, ends, near = [], [], []
        for k, shifts in met.items():
            of, r, size = listed[k]
            if size < int(np.float32(abundance) * np.float32(ratio)):
                continue
            head = run(q, r, few)
            if head >= primer + shared:
                starts.append((of, r, head))
            for shift in sorted(shifts, key=lambda s: (-len(shifts[s]), s))[:2]:
                low, high = max(0, -shift), min(n, len(r) - shift)
                tail = run(q[low:high][::-1], r[low + shift : high + shift][::-1], few)
                if tail >= shared:
                    ends.append((high - tail, of, r, shift))
                    break
                tail = 0
            x = (head + n - tail) // 2
            near.append(wrong(q[:x], r) + wrong(q[x:], r[x + shift :]) if head + tail >= n else wrong(q, r))
        closest = min((w for w in near if w <= more), default=None)
        if closest is not None and closest <= few:
            continue
        allowed = more if closest is None else closest
        ends.sort(key=lambda e: e[0])
        for a, r_a, head in starts:
            for begin, b, r, shift in ends:
                x = (head + begin) // 2
                if begin <= head and a != b and cluster not in found and wrong(q[:x], r) > allowed + few and wrong(q[x:], r_a[x:]) > allowed + few and wrong(q[:x], r_a) + wrong(q[x:], r[x + shift :]) <= allowed:
                    found[cluster] = (a, b)
        if cluster not in found:
            listed.append((cluster, q, abundance))
    return found


@pytest.mark.parametrize("seed", range(3))
def test_chimeras_equal_the_serial_rule(spark, monkeypatch, seed):
    """Copies of chimeras, chimeras of chimeras, repeats, short ones and shifted ends, in blocks and pieces of any size."""
    from seqloom.operators import chimera as H

    rng = random.Random(seed)
    draw = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    seqs = [draw(rng.randint(80, 260)) for _ in range(8)] + [draw(9) * 12, draw(5) * 20, draw(40)]
    for _ in range(45):
        a, b = rng.choice(seqs), rng.choice(seqs)
        cut = rng.randint(20, 120)
        made = rng.choice([a[:cut] + b[cut:], a[:cut] + b[cut + rng.randint(-3, 3) :], mutated(rng, a, "ACGT", rng.randint(0, 4)), a[rng.randint(0, 9) :]])
        seqs.append(made if made else draw(30))
    seqs = list(dict.fromkeys(seqs))
    rows = [(k, s, rng.randint(1, 9) if k > 10 else rng.randint(5, 30)) for k, s in enumerate(seqs)]
    table = spark.createDataFrame(rows, "cluster_no long, seq string, abundance long")
    if seed:
        monkeypatch.setattr(H, "BLOCK_LETTERS", 1500)
        monkeypatch.setattr(H, "MEETINGS", 60)
        monkeypatch.setattr(H, "AT_ONCE", 200)
        monkeypatch.setattr(H, "OFTEN", seed - 1)
    for percent, ratio in ((1.0, 1.0), (2.5, 0.5))[: 1 + (seed == 1)]:
        got = {r["cluster_no"]: (r["parent_1"], r["parent_2"]) for r in H.chimeric_clusters(table, percent=percent, ratio=ratio).collect()}
        assert got == serial_chimeras(rows, percent=percent, ratio=ratio) and got


def test_repeats_are_judged_in_time(spark):
    """Long sequences of few words, each of which meets all the others in each place: 1.5 billion meetings of words."""
    from seqloom.operators import chimera as H

    rng = random.Random(4)
    draw = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    rows = [(10 * k + j, word * (9000 // k) + draw(40 + j), 40) for k, word in ((4, draw(4)), (6, draw(6))) for j in range(10)]
    table = spark.createDataFrame(rows, "cluster_no long, seq string, abundance long")
    began = time.monotonic()
    assert H.chimeric_clusters(table).count() == 0
    assert time.monotonic() - began < 40
