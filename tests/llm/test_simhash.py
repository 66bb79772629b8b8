import random

import pytest
import xxhash

from pagewright.llm import components, similar, simhash


def plain_fingerprint(text, k):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(fps, bits):
    group = dict.fromkeys(fps)
    for f in group:
        if group[f] is None:
            group[f], todo = f, [f]
            while todo:
                x = todo.pop()
                for y in group:
                    if group[y] is None and (x ^ y).bit_count() <= bits:
                        group[y] = f
                        todo.append(y)
    return group


def expected(rows, k, bits):
    fps = [plain_fingerprint(t, k) for _, t in rows]
    group = plain_groups(fps, bits)
    least = {}
    for (i, _), f in zip(rows, fps):
        if i is not None:
            least[group[f]] = min(i, least.get(group[f], i))
    return sorted(((i, f, least.get(group[f])) for (i, _), f in zip(rows, fps)), key=str)


def found(df):
    return sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in df.collect()), key=str)


@pytest.mark.parametrize(("k", "bits"), [(4, 4), (5, 9)])
def test_against_plain_python(documents, k, bits):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert found(simhash.near_duplicates(documents, k, bits)) == expected(rows, k, bits)


def test_hard_rows(hard, clashing, empty):
    want = expected([(r.doc_id, r.text) for r in hard.collect()], 4, 4)
    assert found(simhash.near_duplicates(hard, 4, 4)) == want
    assert found(simhash.near_duplicates(clashing, 4, 4)) == want
    assert found(simhash.near_duplicates(empty, 4, 4)) == []
    assert similar.without_duplicates(empty).count() == 0
    kept = similar.without_duplicates(clashing)
    assert kept.columns == clashing.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 4, 6, 7, 8]


def signed(f):
    return f - 2**64 if f >> 63 else f


def near_fingerprints(n, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(4):
        centre = rng.getrandbits(64)
        for _ in range(n):
            f = centre
            for _ in range(rng.randint(0, 6)):
                f ^= 1 << rng.randrange(64)
            out.append(f)
    return sorted({*out, *(rng.getrandbits(64) for _ in range(n))})


def test_known_trees_are_not_linked_again(spark):
    fps = near_fingerprints(40, 3)
    df = spark.createDataFrame([(signed(f), 0) for f in fps], "fp long, root long")
    assert simhash.links_within(df, 4, most_in_bucket=4).count() == 0


@pytest.mark.parametrize("most", [6, 10_000])
@pytest.mark.parametrize("bits", [4, 7])
def test_crowded_buckets_lose_no_link(spark, most, bits):
    fps = near_fingerprints(14, most)
    df = spark.createDataFrame([(signed(f), signed(f)) for f in fps], "fp long, root long")
    forest = components.Forest()
    for r in simhash.links_within(df, bits, most_in_bucket=most).collect():
        a, b = r.a % 2**64, r.b % 2**64
        assert (a ^ b).bit_count() <= bits
        forest.join(a, b)
    want = plain_groups(fps, bits)
    groups = lambda of: sorted(sorted(f for f in fps if of(f) == g) for g in {of(f) for f in fps})
    assert groups(forest.root) == groups(want.get)


def test_copies_go_and_others_stay(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(4000)]
    texts = [rng.choices(words, k=300) for _ in range(60)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rows += [(100 + i, " ".join(t)) for i, t in enumerate(texts[:20])]
    rows += [(200 + i, " ".join([*t[:150], "changed", *t[151:]])) for i, t in enumerate(texts[:20])]
    kept = {r.doc_id for r in similar.without_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(range(60))


def test_rows_without_or_with_one_id_go_only_for_their_group(spark):
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(200)) for _ in range(8)]
    rows = [(None, t) for t in texts[:4]] + [(7, t) for t in texts[4:]] + [(None, texts[0]), (7, texts[4]), (8, texts[5]), (None, texts[6])]
    got = [(r.doc_id, r.text) for r in similar.without_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([(None, t) for t in texts[:4]] + [(7, t) for t in texts[4:]], key=str)


def plain_similar(texts, least=0.8):
    """Groups of texts by exact similarity of all pairs that share a shingle."""
    sets = []
    for t in texts:
        words = (t or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    owners = {}
    for i, s in enumerate(sets):
        for x in s or {()}:
            owners.setdefault(x, []).append(i)
    forest, met = components.Forest(), set()
    for own in owners.values():
        met |= {(a, b) for k, a in enumerate(own) for b in own[k + 1 :]}
    for a, b in met:
        both = len(sets[a] & sets[b])
        if not sets[a] or both >= least * (len(sets[a]) + len(sets[b]) - both):
            forest.join(a, b)
    return [forest.root(i) for i in range(len(texts))]


def changed(rng, words, text, n):
    out = list(text)
    for at in rng.sample(range(len(out)), n):
        out[at] = rng.choice(words)
    return out


def test_stage_against_exact_similarity(spark):
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(4000)]
    texts = [rng.choices(words, k=200) for _ in range(120)]
    rows = [*texts, *(changed(rng, words, t, n) for t in texts for n in (2, 4, 6, 9, 14))]
    rows = [" ".join(r) for r in rows]
    group = plain_similar(rows)
    want = {min(i for i, h in enumerate(group) if h == g) for g in group}
    got = {r.doc_id for r in similar.without_duplicates(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert len(want) < 0.75 * len(rows) and want <= got and len(got - want) <= 0.01 * len(rows)


def test_stage_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: r[0])
    group = plain_similar([t for _, t in rows])
    first = {}
    for (i, _), g in zip(rows, group):
        first.setdefault(g, i)
    got = {r.doc_id for r in similar.without_duplicates(docs).collect()}
    assert set(first.values()) <= got and len(got) - len(first) <= 2


def test_no_link_between_different_texts_is_lost(spark):
    rng = random.Random(21)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(4000)]
    bases = [rng.choices(words, k=120) for _ in range(12)]
    rows = [" ".join(r) for t in bases for r in (changed(rng, words, t, rng.choice((1, 2, 3, 4, 5))) for _ in range(25))]
    group = plain_similar(rows)
    want = {min(i for i, h in enumerate(group) if h == g) for g in group}
    got = {r.doc_id for r in similar.without_duplicates(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert 24 < len(want) < 0.75 * len(rows) and got == want


def test_prefixes_of_similar_sets_meet():
    import numpy as np

    rng = np.random.default_rng(4)
    for _ in range(300):
        n, shared = int(rng.integers(1, 60)), int(rng.integers(0, 60))
        pool = np.unique(rng.integers(0, 2**63, 200, dtype=np.uint64) * np.uint64(2))
        both, x, y = pool[:shared], pool[60 : 60 + n // 4], pool[100 : 100 + n // 5]
        a, b = np.sort(np.concatenate([both, x])), np.sort(np.concatenate([both, y]))
        ranked = np.sort(rng.permutation(pool)[:50])
        rank = rng.permutation(50)
        if len(a) and len(b) and similar.similarity(a, b) >= 0.8:
            assert np.intersect1d(similar.prefix(a, ranked, rank, 0.8), similar.prefix(b, ranked, rank, 0.8)).size
        apart = int(np.bitwise_count(np.frombuffer(similar.parity(a), np.uint8) ^ np.frombuffer(similar.parity(b), np.uint8)).sum())
        assert apart <= np.setxor1d(a, b).size


def test_wide_parities_never_exceed_the_difference():
    import numpy as np

    rng = np.random.default_rng(8)
    for a_only, both, b_only in ((0, 0, 0), (0, 0, 5), (1, 0, 0), (3, 60, 7), (0, 250, 20), (40, 500, 0), (300, 900, 500), (0, 1 << 19, 9)):
        pool = np.unique(rng.integers(0, 2**63, 2 * (a_only + both + b_only), dtype=np.uint64) * np.uint64(2))
        pool = rng.permutation(pool)[: a_only + both + b_only]
        a, b = np.sort(pool[: a_only + both]), np.sort(pool[a_only:])
        x, y = similar.wide_parity(a), similar.wide_parity(b)
        assert similar.odd_ranges(x, y) == similar.odd_ranges(y, x) <= a_only + b_only
        assert a_only + b_only < 20 or similar.odd_ranges(x, y) > 0.5 * (a_only + b_only)
    half = similar.wide_parity(np.sort(rng.permutation(pool)[:600])), similar.wide_parity(np.sort(rng.permutation(pool)[:600]))
    assert similar.odd_ranges(*half) > 1200 * 0.2 / 1.8  # no text is read for such a pair


def test_texts_are_joined_only_with_pairs_that_may_be_alike(spark, monkeypatch):
    rng = random.Random(31)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(4000)]
    shared = rng.choices(words, k=400)
    rows = [" ".join([*shared, *rng.choices(words, k=800)]) for _ in range(12)]  # a third in common: too long for 256 bits of parity
    near = changed(rng, words, rows[0].split(), 26)
    rows.append(" ".join(near))
    counts, write = {}, similar.written

    def told(df, name):
        out = write(df, name)
        counts[name] = counts.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(similar, "written", told)
    got = {r.doc_id for r in similar.without_duplicates(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    group = plain_similar(rows)
    assert got == {min(i for i, h in enumerate(group) if h == g) for g in group} and len(got) == 12
    assert counts["pairs"] > 60 and counts["texts"] <= 2


def test_a_crowd_of_near_copies_stays_few_rows(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(4000)]
    text = rng.choices(words, k=100)
    near = [" ".join(changed(rng, words, text, 1)) for _ in range(400)]
    far = [" ".join(changed(rng, words, text, 12)) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate([*near, *far])), "doc_id long, text string")
    kept = {r.doc_id for r in similar.without_duplicates(docs).collect()}
    assert len(kept & set(range(400))) == 1 and len(kept) > 390


@pytest.mark.parametrize("chunk", [1 << 19, 3])
def test_components_of_chains_stars_and_loops(spark, monkeypatch, chunk):
    monkeypatch.setattr(components, "CHUNK", chunk)
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(7, 7), (9, 8), (8, 9), (9, 8)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(120)]
    rng.shuffle(links)
    forest = components.Forest()
    for a, b in links:
        forest.join(a, b)
    want = {x: forest.root(x) for a, b in links for x in (a, b) if a != b}
    df = spark.createDataFrame(links, "a long, b long").repartition(5)
    got = components.connected_components(df).collect()
    assert {r.node: r.root for r in got} == want and len(got) == len(want)
    assert components.connected_components(df.where("false")).count() == 0


def test_each_pair_is_told_in_its_first_bucket_alone():
    import numpy as np

    rng = np.random.default_rng(3)
    for flips in (0, 1, 3, 12, 30, 44):
        a = rng.integers(0, 2**63, 3, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        b = a.copy()
        for bit in rng.choice(192, flips, replace=False):
            b[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
        both = np.stack([a, b])
        buckets = [[similar.variant(both[r : r + 1, bit // 64], bit)[0] for bit in range(192)] for r in (0, 1)]
        common = [bit for bit in range(192) if buckets[0][bit] == buckets[1][bit]]
        told = [bit for bit in common if len(similar.at_home(np.array([buckets[0][bit]] * 2), both, np.array([[0, 1]])))]
        assert told == common[:1]
