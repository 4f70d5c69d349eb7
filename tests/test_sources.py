"""Record and cluster files, reads, and streams."""

import gzip

from seqloom.operators import cluster as C
from seqloom.operators import reads as R
from seqloom.operators.words import divide
from seqloom.sources import records as S
from seqloom.streaming import screens


def test_fasta_and_gzip(spark, tmp_path):
    text = b">one first\nACDEFGHIKLMN\nPQ rst*\n>two\nshort\n> three_is_a_long_identifier x\nACDEFGHIKLMNPQ\n>bad\nACD3EFGHIKLMNP\n@four\nACGTACGTACGTA\n+\nIIIIIIIIIIIII\n"
    (tmp_path / "a.fa").write_bytes(text)
    (tmp_path / "b.fa.gz").write_bytes(gzip.compress(text))
    got = S.read_sequences(spark, str(tmp_path)).orderBy("file", "record_no").collect()
    want = [(0, "one", "ACDEFGHIKLMNPQRST"), (2, "three_is_a_long_ide", "ACDEFGHIKLMNPQ"), (4, "four", "ACGTACGTACGTA")]
    assert [(r["record_no"], r["id"], r["seq"]) for r in got] == want * 2
    assert bytes(got[0]["raw_record"]) == text[: text.index(b">two")]
    assert S.read_sequences(spark, str(tmp_path / "a.fa"), trim=5).first()["seq"] == "ACDEF"


def test_reads_and_text(spark, tmp_path):
    (tmp_path / "r.fq").write_bytes(b"@a x\nacgt\n+\n@III\n@b\nGG\n+\nII\n")
    reads = S.read_reads(spark, str(tmp_path / "r.fq"))
    got = [(r["read_idx"], r["des"], r["seq"], r["qual"]) for r in reads.orderBy("read_idx").collect()]
    assert got == [(0, "a x", "ACGT", "@III"), (1, "b", "GG", "II")]
    assert [r["value"] for r in S.reads_as_text(reads).orderBy("read_idx").collect()] == ["@a x\nACGT\n+\n@III", "@b\nGG\n+\nII"]


def test_cluster_file_round_trip(spark, tmp_path):
    text = ">Cluster 0\n0\t20aa, >x... *\n1\t18aa, >y...z... at 1:18:1:18/98.10%\n>Cluster 3\n0\t9aa, >w... *\n"
    (tmp_path / "c.txt").write_text("0\t5aa, >lost... *\n" + text)
    rows = S.read_members(spark, str(tmp_path / "c.txt"))
    got = [(r["cluster_no"], r["member_pos"], r["len"], r["id"], r["is_rep"], r["iden"]) for r in rows.orderBy("cluster_no", "member_pos").collect()]
    assert got == [(0, 0, 20, "x", True, None), (0, 1, 18, "y...z", False, "98.10%"), (3, 0, 9, "w", True, None)]
    lines = [r["value"] for r in S.members_as_text(rows).orderBy("cluster_no", "member_pos").collect()]
    assert "\n".join(lines) + "\n" == text.replace("1:18:1:18/", "")


def make(spark, seqs):
    return spark.createDataFrame([(i, s, len(s)) for i, s in enumerate(seqs)], "seq_idx long, seq string, len int")


def test_linked_reads(spark):
    pairs = spark.createDataFrame([(0, "AAACCCGGGTTT", "GGTTTAAACCCG"), (1, "AAAA", "CCCC")], "read_idx long, seq_1 string, seq_2 string")
    # The reverse complement of the first mate 2 is CGGGTTTAAACC: it overlaps the end CGGGTTT.
    got = R.link_reads(pairs, 5, 0).collect()
    assert [(r["read_idx"], r["contig"], r["overlap"], r["mismatch_no"]) for r in got] == [(0, "AAACCCGGGTTTAAACC", 7, 0)]
    wrong = spark.createDataFrame([(0, "AAACCCGGGTTT", "GGTTTAAACACG")], "read_idx long, seq_1 string, seq_2 string")
    got = R.link_reads(wrong, 5, 1).orderBy("allele").collect()
    assert [r["contig"] for r in got] == ["AAACCCGGGTTTAAACC", "AAACCCGTGTTTAAACC"] and {r["mismatch_no"] for r in got} == {1}


def test_duplicate_and_overlap_clusters(spark):
    base = "ACGTTGCATGCAAGGCTTACCATGACTTGACGATCGGATTACAGCATG"
    near = base[:40] + "A" + base[41:] if base[40] != "A" else base[:40] + "C" + base[41:]
    got = {r["seq_idx"]: r["rep_idx"] for r in C.duplicate_clusters(make(spark, [base, near, base, base[::-1]]), 1).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3}
    tail = base[20:] + "GGGG"
    got = {r["seq_idx"]: r["rep_idx"] for r in C.overlap_clusters(make(spark, [base, tail[:36], base[::-1][:30]]), 20).collect()}
    assert got == {0: 0, 1: 0, 2: 2}


def test_divide_and_segments(spark, tmp_path):
    table = make(spark, ["A" * n for n in (50, 40, 30, 20, 10, 5)])
    segments = divide(table, 3)
    assert {r["seq_idx"]: r["segment"] for r in segments.collect()} == {0: 0, 1: 0, 2: 1, 3: 1, 4: 1, 5: 1}
    S.write_segments(table, segments, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 12
    assert divide(table, 0).count() == 0


def test_streamed_screen(spark, tmp_path):
    refs = make(spark, ["ACDEFGHIKLMNPQRSTVWYACDEFGHIKL"])
    make(spark, ["ACDEFGHIKLMNPQRSTVWYACDEFGHIKL", "W" * 30]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("seq_idx long, seq string, len int").parquet(str(tmp_path / "in"))
    found = []
    query = screens.screen(stream, refs, 0.9, 3, lambda rows, _: found.extend(rows.collect()), str(tmp_path / "checkpoint"))
    query.processAllAvailable()
    query.stop()
    assert [r["q_idx"] for r in found] == [0]


def test_cluster_lines_with_places_and_strands(spark):
    clusters = spark.createDataFrame(
        [(0, 0, 0, True, "+", 1.0, None, None, None, None, None), (2, 0, 0, False, "-", 0.5, 0.25, 10, 1, 2, 11), (1, 1, 1, True, "+", 1.0, None, None, None, None, None)],
        "seq_idx long, rep_idx long, cluster_no long, is_rep boolean, strand string, identity float, distance float, q_from long, q_to long, r_from long, r_to long",
    )
    records = spark.createDataFrame([(0, "a", 12, b">a x\nACGT\n"), (1, "b", 11, b">b\nAC\n"), (2, "c", 10, b">c\nA\n")], "seq_idx long, id string, len int, raw_record binary")
    lines = S.members_as_text(S.cluster_members(clusters, records, "base", places=True, distances=True), "nt").orderBy("cluster_no", "member_pos").collect()
    assert [r["value"] for r in lines] == [">Cluster 0", "0\t12nt, >a... *", "1\t10nt, >c... at 10:1:2:11/-/50.00%/25.00%", ">Cluster 1", "0\t11nt, >b... *"]
    assert [bytes(r["raw_record"]) for r in S.representative_records(records, clusters).orderBy("seq_idx").collect()] == [b">a x\nACGT\n", b">b\nAC\n"]


def test_lines_are_written_in_order_and_hierarchies_read(spark, tmp_path):
    lines = spark.createDataFrame([(1, 0, "c"), (0, 1, "b"), (0, 0, "a"), (2, 0, "d")], "x int, y int, value string")
    S.write_lines(lines, str(tmp_path / "out"), ["x", "y"])
    files = sorted((tmp_path / "out").glob("part-*"))
    assert "".join(f.read_text() for f in files) == "a\nb\nc\nd\n"
    (tmp_path / "t.tsv").write_text("p\t12\t0\t1\t5\t0\t\t\nq\t9\t0\t0\n")
    got = [(r["id"], r["len"], r["level"], r["cid"], r["rep"]) for r in S.read_hierarchy(spark, str(tmp_path / "t.tsv")).orderBy("ordinal", "level").collect()]
    assert got == [("p", 12, 1, 0, 1), ("p", 12, 2, 5, 0), ("q", 9, 1, 0, 0)]


def test_labels_behind_a_double_bar(spark):
    rows = spark.createDataFrame([("a||b",), ("a",), ("a||",), ("a||b||c",)], "id string")
    got = [tuple(r) for r in rows.select(*S.split_label(rows["id"])).collect()]
    assert got == [("a", "b"), ("a", None), ("a", None), ("a", "b||c")]


def test_duplicates_by_depth_and_fraction(spark):
    """Without a given block the leading letters that must agree grow with the read; a fraction allows errors by length."""
    import random

    rng = random.Random(3)
    base = "".join(rng.choice("ACGT") for _ in range(400))
    change = lambda s, at: s[:at] + ("A" if s[at] != "A" else "C") + s[at + 1 :]
    # Reads of 35 and 400: the block has 30 letters, and 30 + 10 * 6 ** 2 = 390 of the long ones.
    seqs = [base, change(base, 395), change(base, 200), "".join(rng.choice("ACGT") for _ in range(35))]
    got = {r["seq_idx"]: r["rep_idx"] for r in C.duplicate_clusters(make(spark, seqs), 1).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3}
    got = {r["seq_idx"]: r["rep_idx"] for r in C.duplicate_clusters(make(spark, [*seqs, change(change(base, 394), 396)]), 0.005).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3, 4: 0}
    # A prefix of a longer read is its duplicate where lengths may differ.
    got = {r["seq_idx"]: r["rep_idx"] for r in C.duplicate_clusters(make(spark, [base, base[:100], base[1:90]]), 0, same_length=False).collect()}
    assert got == {0: 0, 1: 0, 2: 2}
