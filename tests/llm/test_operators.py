"""The operators against brute force, on small tables that hold the awkward cases."""

import math
import os
import random
import zlib
from collections import Counter, defaultdict
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqloom.llm import ann, fingerprint, linededup, lm, minhash, mixing, packing, subwords, tokencount, toxicity, urls
from seqloom.llm.common import prepare
from seqloom.llm.components import components
from seqloom.llm.subwords import VOCABULARY, Subwords

WORDS = ["the", "of", "and", "to", "in", "a", "is", "that"] + [a + b for a in ("th", "on", "er", "an", "re", "ti", "Öl") for b in ("ing", "ed", "ly", "ou", "ea", "ñe")]


def made_texts(n: int, seed: int = 1) -> list[str]:
    rng = random.Random(seed)
    return ["\n".join(" ".join(rng.choice(WORDS) for _ in range(rng.randint(3, 25))) for _ in range(rng.randint(1, 6))) for _ in range(n)]


def documents(spark, seed: int = 1, n: int = 60):
    """Texts with exact and near copies, null and empty ones, a null doc_id, a repeated row and extra columns."""
    rng = random.Random(seed)
    texts = made_texts(n, seed)
    texts += [texts[0], texts[0], texts[1]]
    for k in range(6):
        words = texts[k].split(" ")
        words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    texts += [None, "", "   \n\t ", "x", "word " * 3000, "ünï çødé \U0001f600 text", texts[2].upper()]
    rows = [(i * 3 + 1, t, ["src0", "src1", "src2", None][i % 7 % 4], 5) for i, t in enumerate(texts)]
    rows += [(None, "no id at all here", "src0", 1), rows[4]]
    schema = "doc_id long, text string, source string, size long"
    return spark.createDataFrame(rows, schema), rows


def shingles(text: str | None) -> set:
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


@pytest.fixture(autouse=True)
def prepared(spark):
    prepare(spark)


# --- packing -------------------------------------------------------------------------------------


def test_subwords_equal_the_tokenizer_file():
    import public_tokenizers
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [*made_texts(30), "", "a  b \n c\t\t d", "<|endoftext|> x", "it's ’ \U0001f600  ", "\x00\x85\xa0 x"]
    ours = Subwords()
    for text in texts:
        assert ours.encode(text).tolist() == reference.encode(text, add_special_tokens=False).ids


def test_words_are_cut_in_one_go():
    encoder = Subwords()
    words = [*" ".join(made_texts(20)).split(), "it's", "don't", "<|endoftext|>", "a\xa0", "\xa0b", "\x85", "\u2003x", "3.14", "'s", "ünï", "\U0001f600", "a\x1cb", "全文"] * 2
    flat, sizes = encoder.encode_words(words)
    want, want_sizes = encoder.encode_many([" " + w for w in words])
    assert flat.tolist() == want.tolist() and sizes.tolist() == want_sizes.tolist()
    assert encoder.encode_words([])[0].tolist() == []


@pytest.mark.parametrize("n", [0, 1, 7, 400, 5000])
def test_plan_holds_every_piece_once_and_is_tight(n):
    rng = np.random.default_rng(n)
    lengths = np.clip(rng.lognormal(6.4, 1.0, n).astype(int), 1, 2048)
    counts = dict(zip(*[x.tolist() for x in np.unique(lengths, return_counts=True)], strict=True))
    runs = packing.plan_runs(counts)
    got = defaultdict(int)
    for times, contents in runs:
        assert sum(contents) <= 2048
        for length in contents:
            got[length] += times
    assert dict(got) == counts
    assert sum(t for t, _ in runs) <= -(-int(lengths.sum()) // 2048) * 1.02 + 2


def best_fit_decreasing(counts: dict[int, int]) -> int:
    fill = packing._Fill(2048)
    for length in sorted(counts, reverse=True):
        fill.put(length, counts[length])
    return sum(t for t, _ in fill.runs())


@pytest.mark.parametrize("kind", ["documents", "lognormal", "uniform", "middle"])
def test_configured_sequences_stand(kind):
    """Grouped large pieces stay together as configured, and no more sequences are made than by best fit alone (one in a thousand, on made lengths)."""
    import pyarrow.parquet as pq

    rng = np.random.default_rng(7)
    if kind == "documents":
        texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
        lengths = [n for t in texts for _, n in packing.cut_pieces(len(Subwords().encode(t or "")) + 1, 2048)]
    else:
        lengths = {"lognormal": np.clip(rng.lognormal(6.4, 1, 4000).astype(int), 1, 2048), "uniform": rng.integers(1, 2049, 4000), "middle": rng.integers(300, 900, 4000)}[kind].tolist()
    counts = {k: lengths.count(k) for k in set(lengths)}
    runs = packing.plan_runs(counts)
    ours, best = sum(t for t, _ in runs), best_fit_decreasing(counts)
    assert ours <= best if kind in ("documents", "middle") else ours <= 1.005 * best
    # The plan that stands is one of those tried: all sequences that its grouping configured are in it, whole.
    for groups, part in packing.PLANS:
        if sum(t for t, _ in packing._pack_once(counts, 2048, groups, part)) == ours:
            made = [(t, c) for t, c in packing.configured(counts, 2048, groups, part)[0] if len(c) > 1]
            break
    held = defaultdict(int)
    for times, contents in runs:
        for k in range(2, len(contents) + 1):
            held[contents[:k]] += times
    wanted = defaultdict(int)
    for times, contents in made:
        wanted[contents] += times
    assert wanted and all(held[c] >= t for c, t in wanted.items())
    assert sum(wanted.values()) >= 3


def test_pack_keeps_other_columns(spark):
    rows = spark.createDataFrame([(k % 9 + 1, f"s{k}", k, "r", 5) for k in range(300)], "length int, salt string, rank int, row string, offset int")
    got = packing.pack(rows, 32).collect()
    assert sorted((r["length"], r["salt"], r["rank"], r["row"]) for r in got) == sorted((k % 9 + 1, f"s{k}", k, "r") for k in range(300))
    taken = defaultdict(int)
    for r in got:
        taken[r["sequence_id"]] += r["length"]
    assert max(taken.values()) <= 32 and sum(taken.values()) == sum(r["length"] for r in got)


def test_pack_documents(spark):
    docs, rows = documents(spark)
    got = packing.pack_documents(docs, 256).collect()
    encoder = Subwords()
    want = []
    for doc_id, text, *_ in rows:
        ids = np.append(encoder.encode(text or ""), 0).astype("<u4")
        head = len(ids) % 256 or 256 if len(ids) > 256 else len(ids)
        cuts = [0, *range(head, len(ids) + 1, 256)]
        want += [(doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(pairwise(cuts))]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted([tuple(r)[:5] for r in got], key=key) == sorted(want, key=key)
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack_documents(docs.limit(0)).count() == 0


# --- token counts --------------------------------------------------------------------------------


def test_token_counts(spark):
    docs, rows = documents(spark)
    by_id = lambda r: (r[0] is None, r[0] or 0, r[1])
    got = sorted(((r["doc_id"], r["tokens"]) for r in tokencount.count_documents(docs).collect()), key=by_id)
    assert got == sorted(((i, len(Subwords().encode(t or ""))) for i, t, *_ in rows), key=by_id)
    assert tokencount.count_documents(docs.limit(0)).count() == 0
    negative = spark.createDataFrame([(-5, "a b c"), (2**62 + 3, "d")], "doc_id long, text string")
    assert {r["doc_id"] for r in tokencount.count_documents(negative).collect()} == {-5, 2**62 + 3}


def test_end_string_in_a_text_is_counted(spark):
    texts = ["<|endoftext|>", "<|endoftext|>" * 3, "a <|endoftext|> b", "a b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["tokens"] for r in tokencount.count_documents(docs).collect()}
    encoding = subwords._encoding(None)
    assert got == {k: len(encoding.encode_ordinary(t)) for k, t in enumerate(texts)}
    assert got[0] > 1 and got[2] > got[3]



@pytest.mark.parametrize("block,end", [(1, 3), (7, 40), (1000, 3), (3, 77)])
def test_scan_stitches_blocks_and_files(spark, tmp_path, block, end):
    """Against the whole stream in one piece; with rare end ids documents go over several files."""
    rng = np.random.default_rng(block)
    want = []
    for folder, files in (("a", 7), ("b", 3), ("c", 1)):
        (tmp_path / folder).mkdir()
        parts = [rng.integers(0, end + 2, int(rng.integers(0, 60))).astype("<u2") for _ in range(files)]
        for k, ids in enumerate(parts):
            (tmp_path / folder / f"f{k}.bin").write_bytes(ids.tobytes())
        whole = np.concatenate(parts)
        begin = 0
        for at in [*np.flatnonzero(whole == end).tolist(), len(whole)]:
            if at < len(whole) or begin < len(whole):
                want.append((folder, at - begin, whole[begin : min(at, begin + tokencount.KEY_IDS)].tolist()))
            begin = at + 1
    got = [(r["file"].rsplit("/", 2)[1], r["tokens"], list(r["head"])) for r in tokencount.scan(spark, str(tmp_path), end, block).collect()]
    assert sorted(got) == sorted(want)


def test_long_texts_have_their_own_files(spark, monkeypatch):
    monkeypatch.setattr(tokencount, "LONG_TEXT", 50)
    monkeypatch.setattr(tokencount, "FILE_ROWS", 2)
    texts = made_texts(20) + ["a b " * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["tokens"] for r in tokencount.count_documents(docs).collect()} == {i: len(Subwords().encode(t)) for i, t in enumerate(texts)}


# --- fingerprints --------------------------------------------------------------------------------


def test_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "RANGE_BYTES", 700)
    monkeypatch.setattr(fingerprint, "RANGES_AT_ONCE", 3)
    docs, rows = documents(spark)
    got = fingerprint.edited_fingerprints(docs).collect()
    assert len(got) == len(rows)
    import hashlib

    order = sorted(((i, t or "") for i, t, *_ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = defaultdict(set)
    for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        half = len(t) // 2
        want[i].add(hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest())
    of_text = {}
    text_of = {i: t or "" for i, t, *_ in rows}
    for r in got:
        assert r["edited_sha256"] in want[r["doc_id"]] and r["n_chars"] == len(text_of[r["doc_id"]])
        assert of_text.setdefault(text_of[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert len(set(of_text.values())) >= len({t for t in of_text if t.split()}) - 3
    assert fingerprint.edited_fingerprints(docs.limit(0)).count() == 0


def test_sketch_estimates_containment(spark):
    words = [f"w{i}" for i in range(4000)]
    rows = spark.createDataFrame([(" ".join(words), " ".join(words[:800]))], "a string, b string")
    a, b = fingerprint.sketch(F.col("a")), fingerprint.sketch(F.col("b"))
    r = rows.select(fingerprint.containment(b, a).alias("in_large"), fingerprint.containment(a, b).alias("in_small"), F.size(a).alias("n"), (fingerprint.merge(a, b) == a).alias("union")).first()
    assert r["in_large"] == 1.0 and abs(r["in_small"] - 0.2) < 0.05 and abs(r["n"] - 999) < 120 and r["union"]


# --- near duplicates -----------------------------------------------------------------------------


def test_near_duplicate_classes(spark):
    docs, rows = documents(spark, n=40)
    got = {r["doc_id"]: r["class_id"] for r in minhash.classes(docs).collect()}
    sets = {i: shingles(t) for i, t, *_ in rows if i is not None}

    def connected(least: float) -> dict:
        parent = {i: i for i in sets}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a in sets:
            for b in sets:
                union = len(sets[a] | sets[b])
                if a < b and (not union or len(sets[a] & sets[b]) / union >= least):
                    parent[max(root(a), root(b))] = min(root(a), root(b))
        return {i: root(i) for i in sets}

    # Rare shingles weigh up to half as much again, so the two measures agree but near the threshold.
    surely, maybe = connected(0.88), connected(0.7)
    for a in sets:
        assert got[a] == got[surely[a]] and maybe[got[a]] == maybe[a]
    assert minhash.classes(docs.limit(0)).count() == 0


def test_weighted_sampling_estimates_weighted_jaccard():
    rng = np.random.default_rng(0)
    hashes = rng.integers(0, 2**63, 400).astype(np.uint64)
    w1, w2 = np.ones(400), np.ones(400)
    w1[:100], w2[:100], w1[300:], w2[350:] = 3.0, 1.5, 1.5, 1.2
    sampler = minhash.Sampler(samples=1500)
    s1, s2 = (sampler.signatures(hashes, sampler.steps(w), np.array([0]))[0] for w in (w1, w2))
    assert abs((s1 == s2).mean() - np.minimum(w1, w2).sum() / np.maximum(w1, w2).sum()) < 0.06


def test_across_rules_out_no_pair_that_is_alike():
    rng = np.random.default_rng(3)
    for _ in range(200):
        base = rng.integers(0, 2**63, 60).astype(np.uint64)
        other = base.copy()
        k = rng.integers(0, 20)
        other[:k] = rng.integers(0, 2**63, k)
        weights = {int(h): w for h, w in zip(np.concatenate((base, other)), rng.choice([1.0, 1.1, 1.3, 1.5], 120), strict=True)}
        w = [np.array([weights[int(h)] for h in x]) for x in (base, other)]
        p = [np.frombuffer(minhash.parities(x, y, np.array([0, len(x)]))[0].tobytes(), np.uint64) for x, y in zip((base, other), w, strict=True)]
        shared = sum(weights[h] for h in {*map(int, base)} & {*map(int, other)})
        total = w[0].sum() + w[1].sum()
        odd = np.bitwise_count(p[0] ^ p[1])
        apart = odd[: len(odd) // 2].sum() + minhash.HEAVY * odd[len(odd) // 2 :].sum()
        assert apart <= total - 2 * shared + 1e-6


def test_across_keeps_alike_texts_of_unequal_tf(spark):
    words = [f"w{k}" for k in range(300)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words + words[:60]))], "doc_id long, text string")
    idf = np.full_like(minhash.idf_table(minhash.document_counts(docs), 2), 1.2)
    members = minhash.signatures(docs, idf).withColumn("bucket", F.lit(1).cast("long")).withColumn("root", F.col("key")).withColumn("parts", F.lit(2).cast("long"))
    pairs = minhash.across(members, 0.8)
    texts = docs.select(F.unhex(F.md5("text")).alias("key"), "text")
    every = members.select(F.col("key").alias("a")).crossJoin(members.select(F.col("key").alias("b"))).where("a < b")
    assert minhash.verified(every, texts, idf).first()["likeness"] >= 0.8
    assert pairs.count() == 1


def weighted_classes(rows, threshold=0.8) -> dict:
    """By brute force: classes by equal texts, or a weighted Jaccard similarity of TF-IDF shingles that reaches the threshold."""
    words = {i: (t or "").encode().lower().split() for i, t in rows}
    tf = {i: Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter() for i, w in words.items()}
    df, n = Counter(s for i, _ in rows for s in tf[i]), max(2, len(rows))
    weight = {i: {s: (1 + math.log(n / min(df[s], n)) / (2 * math.log(n))) * (1 + math.log(k)) for s, k in c.items()} for i, c in tf.items()}
    parent = {i: i for i in tf}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in tf:
        for b in tf:
            if a < b:
                shared = sum(min(w, weight[b].get(s, 0)) for s, w in weight[a].items())
                total = sum(weight[a].values()) + sum(weight[b].values()) - shared
                if (not total and not tf[a] and not tf[b]) or (total and shared / total >= threshold):
                    parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in tf}


@pytest.mark.parametrize("block", [2048, 3])
def test_classes_are_those_of_weighted_jaccard(spark, monkeypatch, block):
    """Near copies of all degrees around the threshold: the very classes of the brute force, but for a pair or two that share no band."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(31)
    vocabulary, rows = [f"v{k}" for k in range(3000)], []
    for _ in range(30):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(40, 150))]
        rows.append((len(rows), " ".join(base)))
        for _ in range(rng.randint(1, 4)):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 35))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(words + words[: rng.choice([0, 0, 5, 12])])))
    got = {r["doc_id"]: r["class_id"] for r in minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = weighted_classes(rows)
    assert 30 < len(set(want.values())) < len(rows) - 20
    assert sum(got[i] != want[i] for i in want) <= len(rows) // 50


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 340)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- lines ---------------------------------------------------------------------------------------


def later_lines(rows) -> dict:
    lines = [(i, k, frozenset(line.encode().lower().split())) for i, t in rows for k, line in enumerate((t or "").split("\n"))]
    lines = sorted(x for x in lines if x[2])
    lines.sort(key=lambda x: x[:2])
    found = defaultdict(list)
    for n, (i, k, s) in enumerate(lines):
        if any(5 * len(s & t) >= 4 * len(s | t) for _, _, t in lines[:n]):
            found[i].append(k)
    return dict(found)


def linked_lines(rows) -> tuple[dict, dict, set]:
    """By brute force: links and class of each document, and all pairs of similar lines, the later one first."""
    lines = sorted((i, k, frozenset(x.encode().lower().split())) for i, t in rows for k, x in enumerate((t or "").split("\n")) if x.split())
    links, parent, pairs = defaultdict(int), {i: i for i, _ in rows}, set()
    for n, a in enumerate(lines):
        for b in lines[:n]:
            if 5 * len(a[2] & b[2]) >= 4 * len(a[2] | b[2]):
                pairs.add((a[:2], b[:2]))
                links[a[0]] += 1
                links[b[0]] += 1
                low, high = sorted((parent[a[0]], parent[b[0]]))
                parent = {i: low if p == high else p for i, p in parent.items()}
    return dict(links), parent, pairs


def line_rows(seed: int, long: int) -> list:
    rng = random.Random(seed)
    base = [[rng.choice(WORDS) + str(rng.randrange(3)) for _ in range(rng.randint(3, 30))] for _ in range(20)]
    base += [[f"u{k}x{j}" for j in range(long)] for k in range(2)]
    rows = []
    for i in range(90):
        lines = []
        for _ in range(rng.randint(1, 3)):
            words = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2, 4, len(words) // 6])):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            lines.append(" ".join(words))
        rows.append((i, "\n".join(lines)))
    # A line like many different earlier lines.
    common = [f"c{k}" for k in range(20)]
    rows += [(200 + k, " ".join([*common, f"own{k}"])) for k in range(15)] + [(300, " ".join(common))]
    return [*rows, (400, None), (401, ""), (402, "\n\n"), (403, rows[0][1]), (404, "nothing like it\n\n")]


@pytest.mark.parametrize("small,block,words,gathered", [(48, 50_000, 1 << 17, 40), (3, 4, 40, 100)])
def test_line_dedup_is_exact(spark, monkeypatch, small, block, words, gathered):
    monkeypatch.setattr(linededup, "SMALL_GROUP", small)
    monkeypatch.setattr(linededup, "BLOCK_LINES", block)
    monkeypatch.setattr(linededup, "BLOCK_WORDS", words)
    monkeypatch.setattr(linededup, "GATHERED", gathered)
    monkeypatch.setattr(linededup, "PART_BYTES", 4000)
    rows = line_rows(9 + small, 300)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc"]: r for r in linededup.line_links(docs).collect()}
    links, parent, pairs = linked_lines(rows)
    assert {i: list(r["removed_lines"]) for i, r in got.items() if r["removed_lines"]} == later_lines(rows)
    assert {i: r["n_links"] for i, r in got.items()} == links and got[300]["n_links"] == 15
    assert {i: r["class_id"] for i, r in got.items()} == {i: parent[i] for i in links}
    clean = {r["doc_id"]: r["text"] for r in linededup.without_later_copies(docs).collect()}
    for i, text in rows:
        gone = got[i]["removed_lines"] if i in got else []
        assert clean[i] == (None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone))
    if small != 3:
        return
    # Pairs of first lines of sets, and later copies, are pairs by brute force; every pair of different sets is there.
    near = {((r["doc"], r["line"]), (r["near_doc"], r["near_line"])) for r in linededup.similar_pairs(docs).collect()}
    sets = {(i, k): frozenset(x.encode().lower().split()) for i, t in rows for k, x in enumerate((t or "").split("\n"))}
    assert near <= pairs and {frozenset((sets[a], sets[b])) for a, b in near} == {frozenset((sets[a], sets[b])) for a, b in pairs if sets[a] != sets[b]}
    first = {((r["doc"], r["line"]), (r["first_doc"], r["first_line"])) for r in linededup.later_copies(docs).collect()}
    assert first <= pairs and {a for a, _ in first} == {a for a, _ in pairs}
    assert linededup.line_links(docs.limit(0)).count() == 0 and linededup.without_later_copies(docs.limit(0)).count() == 0


def test_long_lines_are_exact(spark):
    """Lines whose parities are folded: near copies of several lengths, and others that only share common words."""
    rng = random.Random(4)
    common, rows = [f"c{k}" for k in range(300)], []
    for n in (100, 130, 260, 700, 1500, 3000):
        for _ in range(3):
            words = [*rng.sample(common, n // 10), *(f"r{rng.random()}" for _ in range(n - n // 10))]
            rows.append((len(rows), " ".join(words)))
            for changes in (n // 20, n // 10, n // 8, n // 7):
                other = [rng.choice(common) if k < changes else w for k, w in enumerate(rng.sample(words, n - changes // 3))]
                rows.append((len(rows), " ".join(other)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    links, _, pairs = linked_lines(rows)
    assert len(pairs) > 40
    assert {r["doc"]: r["n_links"] for r in linededup.line_links(docs).collect()} == links


def test_rows_that_share_an_id(spark):
    rows = [(1, "one two three four"), (2, "one two three four\nits own words"), (2, "unlike anything else seen before here\nmore of it"), (2, "unlike anything else seen before here\nmore of it"), (3, "its own words")]
    docs = spark.createDataFrame([(i, t, "mine", 7, "x") for i, t in rows], "doc_id long, text string, doc string, line int, links string")
    got = sorted((r["doc_id"], r["text"]) for r in linededup.without_later_copies(docs).collect())
    # Whichever of the identical rows comes first keeps its lines.
    assert got == sorted([(1, rows[0][1]), (2, "its own words"), (2, rows[2][1]), (2, ""), (3, "")])
    assert {(r["doc"], r["line"], r["links"]) for r in linededup.without_later_copies(docs).collect()} == {("mine", 7, "x")}


def test_very_many_lines_of_one_text():
    text = "\n".join(["a b"] * 10 + ["c"] * ((1 << 20) + 10))
    seen, words = 0, 0
    for _, number, _, _, sizes in linededup.line_words(pa.array([text])):
        assert number[0] == seen and (sizes >= 0).all()
        seen, words = seen + len(number), words + int(sizes.sum())
    assert (seen, words) == ((1 << 20) + 20, (1 << 20) + 30)


def test_rarity_of_very_common_words():
    assert linededup._rarity(np.array([0, 1, 2, 1 << 32, 1 << 62])).tolist() == [0, 0, 4, 128, 248]


def test_short_lines_are_compared(spark):
    rows = [(1, "Read more\none two three four\nword word word"), (2, "read  More\n\none two three four five\nword"), (3, "more\n \t\nmore read\n全文一行没有空格"), (4, "全文一行没有空格\nread less")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc"]: list(r["removed_lines"]) for r in linededup.removed_lines(docs).collect()}
    assert got == {2: [0, 2, 3], 3: [2], 4: [0]}


def test_needed_overlap():
    for n in range(1, 40):
        for m in range(1, 40):
            least = next((o for o in range(0, 80) if 5 * o >= 4 * (n + m - o)), None)
            assert int(linededup.needed(n, m)) == least


# --- mixing --------------------------------------------------------------------------------------


def test_mixing(spark):
    docs, rows = documents(spark)
    got = mixing.mix(docs, keep=["doc_id", "source"]).collect()
    again = mixing.mix(docs.repartition(7), keep=["doc_id", "source"]).collect()
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)
    assert sorted(got, key=key) == sorted(again, key=key)
    assert len(got) == len(rows)
    sums, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        sums[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    total = sum(sums.values())
    names = sorted((s for s in sums if s is not None)) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    want, left, open_ = {}, 1.5 * total, set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level >= 2 * sums[s]}
        for s in over or open_:
            want[s] = 2.0 * sums[s] if over else weight[s] * level
        left -= sum(want[s] for s in over)
        open_ -= over or open_
    for s in names:
        assert math.isclose(target[s], want[s], rel_tol=1e-9) and abs(taken[s] - want[s]) <= 1
    assert mixing.mix(docs.limit(0)).count() == 0


# --- nearest neighbours --------------------------------------------------------------------------


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 16))
    x[700:720] = x[3]
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x.astype(np.float32))]
    rows += [(5000, None), (5020, [0.0] * 16), (5040, [float("nan")] + [1.0] * 15), (5060, [None] + [1.0] * 15), (5080, [1.0] * 3), (5100, []), (None, [1.0] * 16)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.search(table, "vec_id", "embedding", table.where("vec_id % 20 = 0"), k=20).collect()
    found = defaultdict(list)
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found[r["query_id"]].append((r["id"], r["score"]))
    assert set(found) == set(range(0, 1500, 20))
    x = x.astype(np.float32).astype(np.float64)
    right = 0
    for q, near in found.items():
        exact = x @ x[q]
        order = sorted((i for i in range(len(x)) if i != q), key=lambda i: (-round(exact[i], 12), i))[:20]
        right += len(set(order) & {i for i, _ in near})
        assert len(near) == 20 and all(abs(exact[i] - s) < 1e-9 for i, s in near)
        assert all((-a[1], a[0]) < (-b[1], b[0]) for a, b in pairwise(near))
    assert right >= 0.95 * 20 * len(found)
    few = spark.createDataFrame(rows[:4], "vec_id long, embedding array<float>")
    assert ann.search(few, "vec_id", "embedding", few.where("vec_id = 0"), k=20).count() == 3
    assert ann.search(table.limit(0), "vec_id", "embedding", table.limit(0)).count() == 0


def test_recall_of_few_candidates(spark):
    """One row in forty is scored exactly: at least nine in ten of the nearest are among them. Scored exactly, all are."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 32))
    x = centres[rng.integers(0, 40, 8000)] + 0.8 * rng.normal(size=(8000, 32))
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    rows += [(7, x[7].tolist()), (7, (x[7] + 1).tolist())]  # one vector of a repeated id counts
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    x[7] = min(x[7].tolist(), (x[7] + 1).tolist())
    asked = table.where("vec_id % 400 = 0")
    score = x[::400] @ x.T
    score[np.arange(20), np.arange(0, 8000, 400)] = -np.inf
    want = {400 * k: set(np.argsort(-row)[:20].tolist()) for k, row in enumerate(score)}
    for exact, least in ((False, 0.9), (True, 1.0)):
        found = defaultdict(set)
        for r in ann.search(table, "vec_id", "embedding", asked, k=20, rerank=200, fit_vectors=4000, exact=exact).collect():
            found[r["query_id"]].add(r["id"])
        assert sum(len(want[q] & found[q]) for q in want) >= least * 20 * len(want)


def test_codes_and_norms():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 16)).astype(np.float32)
    model = ann.fit(x, books=6, words=64)
    codes = model.encode(x)
    error = ((model.decode(codes) - x) ** 2).sum(1).mean() / (x**2).sum(1).mean()
    one = ((model.decode(model.encode(x, beam=1)) - x) ** 2).sum(1).mean() / (x**2).sum(1).mean()
    assert error < 0.25 and error <= one


# --- language model ------------------------------------------------------------------------------


def test_attention_gradients():
    rng = np.random.default_rng(0)
    sizes = {"E": (lm.CLASSES, lm.WIDTH), "P": (lm.WINDOW, lm.WIDTH), "Q": (lm.WIDTH,) * 2, "K": (lm.WIDTH,) * 2, "V": (lm.WIDTH,) * 2}
    sizes |= {"U1": (lm.WIDTH, lm.GROUPS), "U2": (lm.GROUPS, lm.WIDTH, lm.MEMBERS), "B1": (lm.CLASSES, lm.GROUPS), "B2": (lm.CLASSES, lm.GROUPS, lm.MEMBERS)}
    w = {k: rng.normal(0, 0.4, s) for k, s in sizes.items()}
    before, target = rng.integers(0, lm.CLASSES, (3, lm.WINDOW)), rng.integers(-1, lm.CLASSES, (3, lm.WINDOW))
    mask = np.tril(np.ones((lm.WINDOW, lm.WINDOW)))
    _, grads = lm.loss_and_gradients(w, before, target, mask)
    for k, g in grads.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        ends = []
        for step in (1e-5, -1e-5):
            w[k][at] += step
            ends.append(lm.loss_and_gradients(w, before, target, mask)[0])
            w[k][at] -= step
        assert abs((ends[0] - ends[1]) / 2e-5 - g[at]) < 1e-5 + 1e-3 * abs(g[at]), k


def test_probabilities_of_all_classes_add_up_to_one():
    rng = np.random.default_rng(5)
    w = {"E": (lm.CLASSES, lm.WIDTH), "P": (lm.WINDOW, lm.WIDTH), "Q": (lm.WIDTH, lm.WIDTH), "K": (lm.WIDTH, lm.WIDTH), "V": (lm.WIDTH, lm.WIDTH)}
    w |= {"U1": (lm.WIDTH, lm.GROUPS), "U2": (lm.GROUPS, lm.WIDTH, lm.MEMBERS), "B1": (lm.CLASSES, lm.GROUPS), "B2": (lm.CLASSES, lm.GROUPS, lm.MEMBERS)}
    w = {k: rng.normal(0, 0.3, size).astype(np.float32) for k, size in w.items()}
    t = lm.Attention(np.zeros(1, np.int64), np.zeros(1), w, 0, np.full(lm.CLASSES, 1 / lm.CLASSES)).tables()
    before = rng.integers(0, lm.CLASSES, (1, lm.WINDOW))
    heard = lm.Attention._heard(before, t, np.tril(np.ones((lm.WINDOW, lm.WINDOW), np.float32)))[0]
    x = w["E"][before[0]] + w["P"]
    a = np.tril(np.exp(x @ w["Q"] @ (x @ w["K"]).T / math.sqrt(lm.WIDTH)))
    assert np.allclose(heard, x + a / a.sum(1, keepdims=True) @ (x @ w["V"]), atol=1e-4)
    found = lm.Attention._probability(np.repeat(heard, lm.CLASSES, 0), np.repeat(before[0], lm.CLASSES), np.tile(np.arange(lm.CLASSES), lm.WINDOW), t)
    assert np.allclose(found.reshape(lm.WINDOW, -1).sum(1), 1, atol=1e-4)


def test_windows_score_each_place_once():
    for n in [1, 5, 31, 32, 33, 56, 57, 200]:
        start, _, fresh = lm.windows(np.array([n]))
        seen = [s + p for s, f in zip(start, fresh, strict=True) for p in range(f, lm.WINDOW) if s + p < n]
        assert sorted(seen) == list(range(n))


def test_model_is_a_distribution_and_batches_agree():
    encoder, opens = Subwords(), lm.opening_ids()
    sample = [np.append(lm.subwords_of(pa.array([t]), encoder)[0], VOCABULARY - 1).astype(np.int64) for t in made_texts(60)]
    flat, cut = np.concatenate(sample), np.concatenate(([0], np.cumsum([len(s) for s in sample])))
    counts = np.bincount(flat, minlength=VOCABULARY)
    classes = lm.class_of_ids(counts, *lm.neighbours(flat, np.ones(len(flat) - 1), lm.common_ids(counts)))
    sizes = np.concatenate([lm.sizes_of_words(s, opens) for s in sample])
    start = lm.starts_so_far(flat, sizes)
    pairs, n = np.unique(np.stack((start, flat))[:, start >= 0], axis=1, return_counts=True)
    starts = lm.Starts.made(pairs[0], pairs[1], n)
    model = lm.fit(counts, classes, np.zeros((lm.CLASSES, lm.CLASSES)), sample, VOCABULARY - 1, opens, starts)
    words = [np.flatnonzero(opens[s])[np.diff(np.append(np.flatnonzero(opens[s]), len(s))) > 1][0] for s in sample[:3]]
    for s, at in zip(sample, words, strict=False):
        head = s[: at + 1]  # ends with the first id of a word of several: what follows is known from starts, or begins a word
        every = np.array([[*head, k] for k in range(VOCABULARY)])
        some, all_ = starts.look_up(np.stack((np.full(VOCABULARY, head[-1]), np.arange(VOCABULARY)), 1).reshape(-1), np.full(VOCABULARY, 2))
        followed = tuple(np.concatenate((np.zeros((VOCABULARY, len(head)), np.float32), x[1::2, None]), 1).reshape(-1) for x in (some, all_))
        nothing = tuple(np.zeros(len(head), np.float32) for _ in range(2))
        total = np.exp(model.score(every.reshape(-1), np.arange(len(every) + 1) * len(every[0]), None, followed) - model.score(head, np.array([0, len(head)]), None, nothing)[0]).sum()
        assert abs(total - 1) < 1e-3
    alone = [model.score(s, np.array([0, len(s)]))[0] for s in sample]
    assert np.allclose(model.score(flat, cut), alone, rtol=1e-4)


def test_held_out_scores_beat_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sums = lm.score(docs).where("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert sums[1] > 0.99 * sums[0]


def test_words_of_slices():
    texts = pa.array([None, "Ünï A\x85b", *made_texts(30), ""])
    for low in (0, 1, 7):
        flat, row = lm.words_of(texts.slice(low, 20))
        want = [(w.decode(), k) for k, t in enumerate(texts.slice(low, 20).to_pylist()) for w in (t or "").encode().lower().split()]
        assert list(zip(flat.to_pylist(), row.tolist(), strict=True)) == want


@pytest.mark.parametrize("chunk,bucket", [(1 << 30, 1 << 30), (2000, 1500)])
def test_lm_scores(spark, monkeypatch, chunk, bucket):
    monkeypatch.setattr(lm, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(lm, "BUCKET_BYTES", bucket)
    docs, rows = documents(spark, n=80)
    got = lm.score(docs).collect()
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, *_ in rows}
    words = lambda t: [w.decode() for w in (t or "").encode().lower().split()] + [None]
    counts = defaultdict(int)
    for i, t, *_ in rows:
        if not held[i]:
            for w in words(t):
                counts[w] += 1
    total, distinct = sum(counts.values()), len(counts)
    text_of = {i: t for i, t, *_ in rows}
    assert len(got) == len(rows)
    for r in got:
        w = words(text_of[r["doc_id"]])
        base = sum(math.log10((counts.get(x, 0) + 1) / (total + distinct + 1)) for x in w)
        assert r["held_out"] == held[r["doc_id"]] and r["n_tokens"] == len(w) and r["train_tokens"] == total
        assert r["n_known"] == sum(counts.get(x, 0) > 0 for x in w)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["score"] < 0
    assert lm.score(docs.limit(0)).count() == 0


# --- toxicity ------------------------------------------------------------------------------------


def test_segments_are_maximal():
    """Against the definition: repeatedly the best run, then what is left on both sides of it."""
    rng = random.Random(5)
    for _ in range(300):
        n = rng.randint(1, 30)
        at = sorted(rng.sample(range(n), rng.randint(0, min(n, 12))))
        # Scores whose sums are never equal, so that the best run is one.
        value = [rng.choice([1, 1, -1]) * (rng.randint(1, 9) + rng.random()) for _ in at]
        gap, special = 1.0, dict(zip(at, value, strict=True))
        full = [special.get(k, -gap) for k in range(n)]

        def best(low, high):
            runs = [(sum(full[a : b + 1]), a, b) for a in range(low, high) for b in range(a, high)]
            runs = [r for r in runs if r[0] > 0]
            if not runs:
                return []
            top = max(r[0] for r in runs)
            _, a, b = min((r for r in runs if r[0] > top - 1e-9), key=lambda r: r[2] - r[1])
            return [*best(low, a), (top, a, b), *best(b + 1, high)]

        got = toxicity.segments(np.array(at, dtype=np.int64), np.array(value, dtype=float), gap)
        want = best(0, n)
        assert [g[1:] for g in got] == [w[1:] for w in want]
        assert all(abs(g[0] - w[0]) < 1e-9 for g, w in zip(got, want, strict=True))


def test_passages_and_repeated_ids(spark):
    rows = [(k, f"{t} idiot scum" if k % 3 == 0 else t) for k, t in enumerate(made_texts(150, 4))]
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k, _ in rows], "doc_id long, toxic int")
    repeated = rows + [(1, f"other text {k}") for k in range(40)] + [(7, None), (7, "word " * 20_000 + "idiot scum")]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in repeated], "doc_id long, text string, toxicity double")
    model = toxicity.fit_documents(docs, labels)
    found = toxicity.find_passages(docs.where("doc_id = 7"), model).collect()
    assert sorted(len(r["passages"]) for r in found)[-1] == 1 and any(p["last"] == 20_001 for r in found for p in r["passages"])
    scored = toxicity.score_documents(docs, model)
    assert scored.columns == ["doc_id", "text", "toxicity"] and scored.count() == len(repeated)


def test_toxicity_is_fitted_in_a_task(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "fit", lambda rows: (sorted(rows), os.getpid()))
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)], "doc_id long, toxic int")
    rows, process = toxicity.fit_documents(docs, labels)
    assert rows == sorted((f"text {k}", k % 2) for k in range(20) if zlib.crc32(str(k).encode()) % 5) and process != os.getpid()


def test_toxicity(spark):
    rng = random.Random(6)
    texts, labels = made_texts(400, 3), []
    for k in range(len(texts)):
        bad = k % 6 == 0
        if bad:
            words = texts[k].split(" ")
            for _ in range(4):
                words.insert(rng.randrange(len(words) + 1), rng.choice(["idiot", "vequing", "vequed", "scum"]))
            texts[k] = " ".join(words)
        labels.append((k, int(bad)))
    rows = [(k, t) for k, t in enumerate(texts)] + [(900, None), (901, ""), (None, "idiot scum idiot vequly scum")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame([*labels, (900, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit_documents(docs, table)
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.score_documents(docs, model).collect()}
    wrong = sum((got[k] >= 0.5) != bool(y) for k, y in labels)
    assert wrong <= 8 and got[None] > 0.5 and got[901] < 0.5 and got[900] < 0.5
    assert model.passages("the of and idiot scum idiot in the")[0][2:] == (3, 5)
    empty = toxicity.fit_documents(docs, table.limit(0))
    assert 0 <= empty.score("idiot") <= 1
    assert toxicity.score_documents(docs.limit(0), model).count() == 0


# --- urls ----------------------------------------------------------------------------------------


def test_url_rules(spark):
    cases = [
        ("http://a.NET/x", "a.net", "/x", "net/", "block"),
        ("https://a.example.net/en/1?x#y", "a.example.net", "/en/1", "example.net/en/", "allow"),
        ("https://example.net/en", "example.net", "/en", "net/", "block"),
        ("ftp://Example.com/de/", "example.com", "/de/", "example.com/de/", "block"),
        ("x://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
        ("x://b.org/fr/2/3", "b.org", "/fr/2/3", "org/fr/", "allow"),
        ("http://net", "net", "", None, "allow"),
        ("http://c.org?x=/fr/", "c.org", "", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        ("http://d.com/a://b/c", "d.com", "/a://b/c", None, "allow"),
        (None, "", "", None, "allow"),
    ]
    pages = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "page_id long, url string")
    labels = spark.createDataFrame([(0, 0)], "page_id long, bad int")
    got = {r["page_id"]: r for r in urls.judge(pages, labels).collect()}
    for k, (_, host, path, rule, verdict) in enumerate(cases):
        assert (got[k]["host"], got[k]["path"], got[k]["rule"], got[k]["verdict"]) == (host, path, rule, verdict), cases[k]
    assert urls.judge(pages.limit(0), labels).count() == 0


def test_url_templates_reject_what_is_labelled_bad(spark):
    rows = [(k, f"http://h.com/{'spam' if k % 2 else 'news'}/{k}/page") for k in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(0, 400, 3)], "page_id long, bad int")
    got = urls.judge(pages, labels).collect()
    assert all((r["verdict"] == "block") == (r["page_id"] % 2 == 1) for r in got)
    assert {r["template"] for r in got} == {"/=spam/#/=page", "/=news/#/=page"}


def test_url_sections_of_a_small_share_are_judged(spark):
    rows = [(k, f"http://h.com/s{k % 40}/{k}") for k in range(1600)]
    deep = "/".join("abcde")
    rows += [(k, f"http://deep.com/{deep}/{'bad' if k % 2 else 'good'}/{k}/end") for k in range(2000, 2200)]
    labels = [(k, int(k % 40 == 7 if k < 2000 else k % 2)) for k, _ in rows]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {r["page_id"]: r for r in urls.judge(pages, spark.createDataFrame(labels, "page_id long, bad int")).collect()}
    assert len(got) == len(rows)
    assert {k for k, r in got.items() if r["verdict"] == "block"} == {k for k, b in labels if b}
    assert {got[k]["template"] for k in (7, 47)} == {"/=s7/#"} and got[0]["template"] == "/=s0|+38/#"
    assert got[2001]["template"] == "/" + "/".join(f"={c}" for c in "abcde") + "/=bad/#/=end"
    one = spark.createDataFrame([(1, "http://x.com/a/1/b")], "page_id long, url string")
    assert urls.judge(one, spark.createDataFrame([], "page_id long, bad int")).first()["template"] == "/*/#/*"


def template_tree(rows: list) -> dict:
    """By brute force, node by node in one process: the template of each (id, host, path, labelled, bad)."""
    wild = lambda s: "#" if any(c in "0123456789" for c in s) else "*"
    made, nodes = {}, defaultdict(list)
    for i, host, path, labelled, bad in rows:
        parts = [s for s in path.split("/") if s]
        if parts:
            nodes[host, ""].append((i, parts, labelled, bad))
        else:
            made[i] = ""
    level = 0
    while nodes:
        after = defaultdict(list)
        for (host, prefix), held in nodes.items():
            if len(held) == 1:
                i, parts, *_ = held[0]
                made[i] = "/".join([prefix, *map(wild, parts[level:])])
                continue
            times = Counter(p[level] for _, p, *_ in held)
            name = {s: "=" + s if n >= urls.LEAST_URLS else wild(s) for s, n in times.items()}
            counts = defaultdict(lambda: [0, 0, 0, 0])
            for _, p, labelled, bad in held:
                for k, v in enumerate((1, labelled, bad, int(len(p) == level + 1))):
                    counts[name[p[level]]][k] += v
            kinds = defaultdict(list)
            for b in counts:
                kinds[tuple(counts[b])].append(b)
            order = sorted(((c, min(b), len(b)) for c, b in kinds.items()), key=lambda x: (-x[0][0], x[1]))
            lead = urls.similar_branches(*zip(*(c for c, _, _ in order)), [n for *_, n in order])
            joined = defaultdict(list)
            for (c, _, _), k in zip(order, lead):
                joined[order[k][1]] += kinds[c]
            branch = {b: "|".join(sorted(bs)) if len(bs) <= urls.SPELLED else f"{first}|+{len(bs) - 1}" for first, bs in joined.items() for b in bs}
            for i, p, labelled, bad in held:
                prefix_ = f"{prefix}/{branch[name[p[level]]]}"
                if len(p) == level + 1:
                    made[i] = prefix_
                else:
                    after[host, prefix_].append((i, p, labelled, bad))
        nodes, level = after, level + 1
    return made


def test_method_verdicts_equal_a_tree_in_one_process(spark):
    rng = random.Random(17)
    sections = ["news", "spam", "shop", "x1", "about", "deals", "p"]
    rows = []
    for k in range(500):
        host = rng.choice(["a.com", "a.com", "b.com", "c.com", f"h{rng.randrange(30)}.com"])
        parts = [rng.choice(sections)] + [rng.choice([str(rng.randrange(40)), "list", f"t{rng.randrange(6)}"]) for _ in range(rng.randrange(3))]
        bad = int(rng.random() < (0.9 if parts[0] in ("spam", "deals") else 0.05))
        rows.append((k, f"http://{host}/{'/'.join(parts)}", bad if rng.random() < 0.7 else None))
    rows += [(600, "http://empty.com", 1), (601, None, None), (602, "http://a.com//spam//1/", 1)]
    pages = spark.createDataFrame([(i, u) for i, u, _ in rows], "page_id long, url string")
    labels = spark.createDataFrame([(i, b) for i, _, b in rows], "page_id long, bad int")
    got = {r["page_id"]: r for r in urls.judge(pages, labels, []).collect()}
    plain = [(i, got[i]["host"], got[i]["path"], int(b is not None), b or 0) for i, _, b in rows]
    made = template_tree(plain)
    assert {i: r["template"] for i, r in got.items()} == made
    k, b = sum(x[3] for x in plain), sum(x[4] for x in plain)
    everywhere = (b + 1) / (k + 2)
    of = lambda key: (sum(x[3] for x in plain if key(x)), sum(x[4] for x in plain if key(x)))
    for i, host, *_ in plain:
        hk, hb = of(lambda x, h=host: x[1] == h)
        tk, tb = of(lambda x, h=host, t=made[i]: x[1] == h and made[x[0]] == t)
        impurity = (tb + urls.PRIOR * (hb + urls.PRIOR * everywhere) / (hk + urls.PRIOR)) / (tk + urls.PRIOR)
        assert math.isclose(got[i]["impurity"], impurity) and got[i]["verdict"] == ("block" if impurity > urls.REJECT else "allow")
    assert len({r["verdict"] for r in got.values()}) == 2


def test_different_branches_are_told_apart():
    # Shares of bad ones of 0.9 and 0.1 among many differ, among few they may be the same.
    assert urls.similar_branches([200, 200], [200, 200], [180, 20], [0, 0]) == [0, 1]
    assert urls.similar_branches([4, 4], [4, 4], [3, 1], [0, 0]) == [0, 0]
    assert urls.similar_branches([300, 300, 300], [0, 300, 0], [0, 290, 0], [300, 300, 0]) == [0, 0, 2]
